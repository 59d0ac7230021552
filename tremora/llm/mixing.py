"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, natively.

Nulls, ties and odd rows: a null text has size 0; a null source is a source of its own, last in order; a null doc_id
counts as the empty text when rows are put in seeded order; repeated rows are rows of their own; an empty table gives
an empty result; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import WORD_PATTERN, written


def hex_number(text: Column) -> Column:
    """32 bits of an md5 as a number; md5 because every SQL engine has the same."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def apportion(parties: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """Adds ``got``: of each group's ``seats``, those of each party under the highest quotients weight / (2 k - 1).

    Seats that every divisor near the exact one gives are given outright; only about three quotients a party are
    ranked for the rest, so the work follows the number of parties and not that of seats. Ties go to the smaller key.
    """
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    v, n = F.col(weight).cast("double"), F.col(seats).cast("double")
    total, half = F.sum(v).over(whole), F.sum(F.when(v > 0, 1).otherwise(0)).over(whole) / F.lit(2.0)
    near = lambda m: F.when((total > 0) & (m > 0), F.floor(v * m / total + 0.5)).otherwise(0).cast("long")
    sure = parties.withColumn("sure", F.greatest(F.lit(0).cast("long"), near(n - half) - 1)).withColumn("most", near(n + half) + 1)
    left = sure.withColumn("open", F.col(seats) - F.sum("sure").over(whole))
    quotients = left.filter((v > 0) & (F.col(seats) > 0)).select(*group, key, "open", F.explode(F.sequence(F.col("sure") + 1, F.col("most") + 1)).alias("k"), v.alias("v"))
    ranked = quotients.withColumn("r", F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy((F.col("v") / (2 * F.col("k") - 1)).desc(), key, "k")))
    won = ranked.filter(F.col("r") <= F.col("open")).groupBy(*group, key).agg(F.count("*").alias("extra"))
    return left.join(won, [*group, key], "left").withColumn("got", F.col("sure") + F.coalesce("extra", F.lit(0))).drop("sure", "most", "open", "extra")


def targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Adds ``target`` to (src, size): shares of all sizes by weight; none above cap times its size, the excess reshared.

    One ordered pass instead of rounds: in order of cap * size / weight, the level at which those before are full is
    the first that doesn't pass the next one's own limit. The table has one row a source."""
    by_name = Window.orderBy("src")
    order = Window.orderBy("limit", "src")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("most", cap * F.col("size")).withColumn("limit", F.col("most") / F.col("weight"))
    total = F.sum("size").over(Window.partitionBy(F.lit(0)))
    full = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = rows.withColumn("total", total).withColumn("level", (total - full) / rest)
    at = F.min(F.when(F.col("level") <= F.col("limit"), F.struct("limit", "src", "level"))).over(Window.partitionBy(F.lit(0)))
    return levels.withColumn("target", F.coalesce(F.least(F.col("most").cast("double"), F.col("weight") * at["level"]), F.col("most").cast("double"))).select("src", "size", "rows", "total", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block_tokens: int = 16, docs_per_shard: int = 50_000, seed: str = "mix-1", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; source, shard, passes; last (words taken in the last
    pass) with place, part, start and blocks, which tell where they lie; and the columns in ``carry``.

    Each source is dealt into shards of about docs_per_shard rows, so that a hot source is no single task. Blocks of
    block_tokens words go to sources, and within a source to shards, by highest quotients. A shard is a stream of its
    documents in seeded order; its quota takes whole passes over the stream and, of the last pass, blocks at even
    steps from a seeded start. How much of a document lies in taken blocks is closed arithmetic on its place in the
    stream: no block is ever a row.
    """
    src = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = docs.select(
        "doc_id", "source", *[F.col(c).alias(f"carried_{c}") for c in carry], src.alias("src"), F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + "|"), name)).alias("place"), hex_number(F.concat(F.lit(seed + "#"), name)).alias("deal"),
    )
    sources = targets(sized.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), weights, cap)
    sources = apportion(sources.withColumn("seats", F.round(F.col("total") / block_tokens).cast("long")), [], "src", "target", "seats")
    sources = sources.select("src", F.col("size").alias("source_size"), "target", F.col("got").alias("source_blocks"), F.ceil(F.col("rows") / docs_per_shard).cast("long").alias("shards"))
    sources = written(sources, "sources")
    dealt = sized.join(sources, "src").withColumn("shard", F.pmod("deal", "shards"))
    stream = Window.partitionBy("src", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("end", F.sum("size").over(stream))
    shards = dealt.groupBy("src", "shard").agg(F.sum("size").alias("length"), F.first("source_blocks").alias("source_blocks"))
    quotas = apportion(shards, ["src"], "shard", "length", "source_blocks").select(
        "src", "shard", "length", F.col("got").alias("quota"), F.ceil(F.col("length") / block_tokens).cast("long").alias("blocks"),
    )
    asked = F.col("quota") * block_tokens
    quotas = quotas.withColumn("passes", F.when(F.col("length") > 0, F.least(F.lit(cap).cast("long"), F.floor(asked / F.col("length")))).otherwise(0).cast("long"))
    part = F.when((F.col("length") > 0) & (F.col("passes") < cap), F.least(F.col("blocks"), F.round((asked - F.col("passes") * F.col("length")) / block_tokens).cast("long"))).otherwise(0).cast("long")
    start = F.when(F.col("blocks") > 0, F.pmod(hex_number(F.concat_ws("|", F.lit(seed), "src", F.col("shard").cast("string"))), F.col("blocks"))).otherwise(0).cast("long")
    quotas = quotas.withColumn("part", part).withColumn("start", start)

    def before(words: Column) -> Column:
        """Words in taken blocks of the last pass among the first ``words`` of the stream."""
        block = F.floor(words / block_tokens).cast("long")
        taken = lambda j: F.floor((j * F.col("part") + F.col("start")) / F.col("blocks")).cast("long")
        return taken(block) * block_tokens + (taken(block + 1) - taken(block)) * (words - block * block_tokens)

    last = F.when((F.col("part") > 0) & (F.col("size") > 0), before(F.col("end")) - before(F.col("end") - F.col("size"))).otherwise(0)
    joined = placed.join(quotas, ["src", "shard"]).withColumn("last", last.cast("long"))
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("last")).cast("long").alias("taken"), "source", "shard", "passes",
        "last", (F.col("end") - F.col("size")).alias("place"), "part", "start", "blocks", *[f"carried_{c}" for c in carry],
    )


def apply(docs: DataFrame, block_tokens: int = 512, **options) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as the mix takes it whole, and once more with
    the words that lie in taken blocks where it takes a part. n_chars, if there, follows the text."""
    mixed = mix(docs, block_tokens=block_tokens, carry=tuple(docs.columns), **options)
    taken = lambda j: F.floor((j * F.col("part") + F.col("start")) / F.col("blocks"))
    block = lambda i: F.floor((F.col("place") + i) / block_tokens)
    words = F.filter(F.regexp_extract_all("carried_text", F.lit(WORD_PATTERN), F.lit(0)), lambda _, i: taken(block(i) + 1) > taken(block(i)))
    rest = F.when(F.col("last") == F.col("size"), F.col("carried_text")).otherwise(F.array_join(words, " "))
    copies = F.concat(F.array_repeat("carried_text", F.col("passes").cast("int")), F.when(F.col("last") > 0, F.array(rest)).otherwise(F.array().cast("array<string>")))
    rows = mixed.filter("taken > 0").withColumn("mixed_text", F.explode(copies))
    new = {"text": F.col("mixed_text"), "n_chars": F.length("mixed_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[(new.get(c) if new.get(c) is not None else F.col(f"carried_{c}")).alias(c) for c in docs.columns])
