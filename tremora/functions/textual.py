"""Text, identity and encoding: built-in expressions where Spark has them, Arrow functions for NFKC, UUIDv5, base32."""

from __future__ import annotations

import base64
import hashlib
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalize_ascii(text: Column) -> Column:
    """Runs of white space become one space, ends are trimmed, nothing left is null: for text known to be ASCII."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


@F.pandas_udf(StringType())
def normalize_text(text: pd.Series) -> pd.Series:
    """NFKC, then as normalize_ascii: for any text."""
    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()) or None)


def canonical_decimal(number: Column, places: int | None = None) -> Column:
    """Plain decimal text without trailing zeros; places: rounded half to even first."""
    exact = number.cast("decimal(38,18)")
    exact = exact if places is None else F.bround(exact, places)
    text = F.regexp_replace(exact.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(text.isin("-0", ""), "0").otherwise(text)


def canonical_json(**columns: Column) -> Column:
    """Compact JSON with sorted keys; nulls are written."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def content_id(payload: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(payload.cast("binary"), 256), 1, 16)


NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "tremora")


@F.pandas_udf(StringType())
def stable_uuid(joined: pd.Series) -> pd.Series:
    """UUIDv5 of parts joined by NUL."""
    return joined.map(lambda x: None if x is None else str(uuid.uuid5(NAMESPACE, x)))


@F.pandas_udf(StringType())
def stable_token(joined: pd.Series) -> pd.Series:
    """26 lower-case base32 digits of the SHA-256 of parts joined by NUL."""
    return joined.map(lambda x: None if x is None else base64.b32encode(hashlib.sha256(x.encode()).digest()).decode().lower()[:26])


def joined_parts(*parts: Column) -> Column:
    return F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


@F.pandas_udf(StringType())
def repair_place(place: pd.Series) -> pd.Series:
    """Text that was GB18030 but was read as Latin-1, read anew; only where the result has Chinese characters. Spark's
    own decode knows that charset under a legacy setting only, so this is an Arrow function."""
    han = lambda x: any("\u4e00" <= c <= "\u9fff" for c in x)

    def again(x: str | None) -> str | None:
        if x is None or x.isascii() or han(x) or max(x) > "\xff":
            return x
        try:
            new = x.encode("latin-1").decode("gb18030")
        except UnicodeDecodeError:
            return x
        return new if han(new) else x

    return place.map(again)


#: Signs that count as a dash, and class words with the one that stands for them.
DASHES = "[\u2010\u2011\u2012\u2013\u2014\u2015\uff0d_]+"
CLASS_WORDS = {"断裂带": "断裂", "断层": "断裂"}


def loose_name(name: Column) -> Column:
    """A normalised name with runs of dashes and underlines as '-' and one word for each class; null for a blank name
    and for a number, with or without sign and decimals."""
    plain = F.regexp_replace(name, DASHES, "-")
    for word, one in CLASS_WORDS.items():
        plain = F.replace(plain, F.lit(word), F.lit(one))
    return F.when((name == "") | name.rlike(r"^[+-]?\d+(\.\d+)?$"), F.lit(None)).otherwise(plain)


def geometry_key(points: Column) -> Column:
    """One key for a line and its reverse: the lesser of both directions, hashed. points: array of text vertices."""
    return F.sha2(F.least(F.array_join(points, ";"), F.array_join(F.reverse(points), ";")), 256)


def cell_id(size_km: float, row: Column, column: Column) -> Column:
    return F.format_string(f"g{round(size_km * 1_000_000):08d}_r%+08d_c%+08d", row.cast("long"), column.cast("long"))


def safe_path(path: Column) -> Column:
    """A relative path with forward slashes; null for absolute ones, drives and steps upwards."""
    plain = F.regexp_replace(path, r"\\", "/")
    return F.when(plain.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|^$"), F.lit(None)).otherwise(F.regexp_replace(plain, r"(^|/)\./", "$1"))


# --- sets of flags -------------------------------------------------------------------------------------------------


def flags(**conditions: Column) -> Column:
    """The sorted names of the conditions that hold."""
    named = F.array(*[F.when(c, F.lit(n)) for n, c in sorted(conditions.items())])
    return F.filter(named, lambda x: x.isNotNull())


def flag_union(column: str) -> Column:
    """As an aggregate: the sorted union of lists."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def without_adjacent_repeats(points: Column) -> Column:
    return F.filter(points, lambda x, i: (i == 0) | (x != F.get(points, i - 1)))


def bounding_box(x: str, y: str) -> Column:
    """As an aggregate."""
    return F.struct(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))
