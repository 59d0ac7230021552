"""MinHash near-dedup: DartMinHash signatures of weighted word shingles, banding, exact verification, components.

The elements of a text are its shingles of five words, weighted by how often they come; a text of fewer words is one
shingle. Similarity is the weighted Jaccard index: the sum of the lesser weights over that of the greater ones.

Nulls, ties and odd rows: a null or blank text is in a class of its own; rows without a doc_id are classed like others,
and a class whose rows all have none has a null class_id; a class is represented by its least doc_id, rows without one
last; repeated rows share a class; rows of one doc_id with different texts are texts of their own, told apart by a hash
of 64 bits; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm import tokens
from tremora.llm.common import bounded_batches, lean, pack, release, unpack, written
from tremora.llm.components import blocks, resolved

PORTION = 8 << 20
STEP, TURN = 0xD6E8FEB86659FD93, np.uint64(0xA0761D6478BD642F)


def turned(i: int) -> np.uint64:
    return np.uint64(i * STEP % 2**64)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each different shingle, in order of both."""
    words = tokens.words(texts)
    h, starts = tokens.hashes(words.dictionary)[0][words.codes], words.starts
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - width + 1, 0))
    inner = np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(np.maximum(sizes - width + 1, 0))[:-1])), np.maximum(sizes - width + 1, 0))
    value = tokens.sequence_hashes(h, width)[starts[doc] + inner] if len(doc) else np.zeros(0, np.uint64)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        own = [tokens.sequence_hashes(h[starts[i] : starts[i + 1]], int(sizes[i]))[0] + np.uint64(sizes[i]) for i in short]
        doc, value = np.concatenate((doc, short)), np.concatenate((value, np.array(own, np.uint64)))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])))) if len(doc) else np.zeros(0, np.int64)
    return doc[first], value[first], np.diff(np.append(first, len(doc)))


def throw(value: np.ndarray, weight: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """All darts of each element up to its limit of rank: element, rank, coordinate and name.

    An element's darts are a Poisson process of rate 1 over weight and rank that depends on its hash alone; it keeps
    those below its weight. Weights are cut into regions 0-1, 1-2, 2-4, 4-8...; along the ranks of a region of width
    w, gaps are exponential with mean 1 / w. Most elements of a long text end at the first gap."""
    out: list[tuple] = []
    lower, width, region = 0.0, 1.0, 0
    live = np.arange(len(value))
    while len(live):
        seed = tokens.mix(value[live] + turned(region + 1))
        at, rank, j = live, np.zeros(len(live)), 0
        while len(at):
            x = tokens.mix(seed + turned(j))
            rank = rank - np.log1p(-(x >> np.uint64(11)).astype(np.float64) * 2.0**-53) / width
            near = rank <= limit[at]
            at, rank, seed, x = at[near], rank[near], seed[near], x[near]
            y = tokens.mix(x ^ TURN)
            inside = lower + width * ((y >> np.uint64(32)).astype(np.float64) * 2.0**-32) < weight[at]
            out.append((at[inside], rank[inside], (y[inside] & np.uint64(0xFFFFFFFF)) % np.uint64(k), y[inside]))
            j += 1
        region, lower, width = region + 1, lower + width, max(1.0, lower + width)
        live = live[weight[live] > lower]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """The earliest dart of each coordinate, (texts, k). The limit of rank is set so that about k (ln k + 1) darts
    come to a text; where a coordinate has none, that text is thrown again with twice the limit."""
    total = np.bincount(doc, weight, texts)
    out, todo, scale = np.zeros((texts, k), np.uint64), np.unique(doc), 1.0
    limits = np.zeros(texts)
    while len(todo):
        limits[todo] = scale * k * (math.log(k) + 1) / total[todo]
        member = np.zeros(texts, bool)
        member[todo] = True
        use = np.flatnonzero(member[doc])
        at, rank, coordinate, name = throw(value[use], weight[use].astype(np.float64), limits[doc[use]], k)
        cell = doc[use][at] * k + coordinate.astype(np.int64)
        order = np.lexsort((name, rank, cell))
        first = order[np.concatenate(([True], cell[order][1:] != cell[order][:-1]))] if len(order) else order
        out.reshape(-1)[cell[first]] = name[first]
        full = np.bincount(cell[first] // k, minlength=texts) == k
        todo, scale = todo[~full[todo]], scale * 2
    return out


def banded(signature: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each band of adjacent coordinates."""
    parts = signature.reshape(len(signature), bands, -1)
    h = tokens.mix(parts[..., 0])
    for i in range(1, parts.shape[2]):
        h = tokens.joined(h, parts[..., i])
    return h.view(np.int64)


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """row, doc_id, th and k1, k2 (hashes of the text), has (whether it has words) and bands: a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.portions(batch, PORTION):
                texts = part.column("text").fill_null("")
                doc, value, count = shingles(texts, width)
                h = banded(signatures(doc, value, count, len(texts), bands * rows), bands)
                has = np.bincount(doc, minlength=len(texts)) > 0
                key = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.as_py()) for x in texts), np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, bands), pa.int32()), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(has), lists], names=["doc_id", "th", "k1", "k2", "has", "bands"])

    bounded_batches(docs.sparkSession)
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows_.mapInArrow(lean(run), "doc_id long, th long, k1 long, k2 long, has boolean, bands array<long>").withColumn("row", F.monotonically_increasing_id())


def counted(docs: DataFrame, width: int) -> DataFrame:
    """node, values and counts (packed) of each text's different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.portions(batch, PORTION):
                doc, value, count = shingles(part.column("text").fill_null(""), width)
                edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
                cut = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([pack(value[a:b]) for a, b in cut], pa.binary()), pa.array([pack(count[a:b].astype(np.uint32)) for a, b in cut], pa.binary())], names=["node", "values", "counts"])

    return docs.mapInArrow(lean(run), "node long, values binary, counts binary")


def weighted_jaccard(v1: np.ndarray, c1: np.ndarray, v2: np.ndarray, c2: np.ndarray) -> float:
    _, i, j = np.intersect1d(v1, v2, assume_unique=True, return_indices=True)
    common = float(np.minimum(c1[i], c2[j]).sum())
    return common / (float(c1.sum()) + float(c2.sum()) - common)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is at least ``least``. A hub's set is joined to its pairs by joins that
    Spark splits; no pair of rows is ever made that a band did not propose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for v1, c1, v2, c2 in zip(*[batch.column(c) for c in ("v1", "c1", "v2", "c2")], strict=True):
                keep.append(weighted_jaccard(unpack(v1.as_py(), "u8"), unpack(c1.as_py(), "u4"), unpack(v2.as_py(), "u8"), unpack(c2.as_py(), "u4")) >= least)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("values").alias("v1"), F.col("counts").alias("c1"))
    right = sets.select(F.col("node").alias("b"), F.col("values").alias("v2"), F.col("counts").alias("c2"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "v1", "c1", "v2", "c2").mapInArrow(lean(run), "a long, b long")


def marked(docs: DataFrame) -> DataFrame:
    """node and marks of each of the sets: 32 bits of the hash of each occurrence of a shingle, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for v, c in zip(batch.column("values"), batch.column("counts"), strict=True):
                values, counts = unpack(v.as_py(), "u8"), unpack(c.as_py(), "u4").astype(np.int64)
                copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                marks.append(pack(np.sort((tokens.mix(np.repeat(values, counts) + copy.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(marks, pa.binary())], names=["node", "marks"])

    return docs.select("node", "values", "counts").mapInArrow(lean(run), "node long, marks binary")


def near(first: pa.Table, second: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of all pairs across roots, one of either table, that may be as similar as ``least``. Two multisets share no
    more occurrences than marks, so none that is gets lost."""
    left, right = ({c: t.column(c).to_numpy() for c in ("node", "root", "i", "j")} for t in (first, second))
    sets = [[unpack(x.as_py(), "u4") for x in t.column("marks")] for t in (first, second)]
    sizes = np.array([len(x) for x in sets[1]])
    names, codes = np.unique(np.concatenate(sets[1]), return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(len(names) + 1))
    by_code = owner[order]
    a, b = [], []
    for k, marks in enumerate(sets[0]):
        own, times = np.unique(marks, return_counts=True)
        at = np.searchsorted(names, own)
        hit = names[np.minimum(at, len(names) - 1)] == own
        at, times = at[hit], times[hit]
        counts = starts[at + 1] - starts[at]
        entries = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts[at], counts)
        common = np.bincount(by_code[entries], np.repeat(times, counts), len(sizes))
        close = (common * (1 + least) >= least * (len(marks) + sizes) - 1e-6) & (right["root"] != left["root"][k])
        if left["i"][k] == left["j"][k]:
            close &= right["node"] > left["node"][k]
        other = right["node"][close]
        a.append(np.full(len(other), left["node"][k]))
        b.append(other)
    return np.concatenate(a), np.concatenate(b)


def crossing(open_: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different roots among all members of a bucket that may be links: two blocks of a bucket at a time
    compare their marks, so a text is sent once for each two blocks and pairs that are no links never are rows."""

    def run(first: pa.Table, second: pa.Table) -> pa.Table:
        a, b = near(first, second.rename_columns(first.column_names), least) if len(first) and len(second) else (np.zeros(0, np.int64),) * 2
        return pa.table([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    marks = written(marked(sets.join(open_.select("node").distinct().hint("merge"), "node", "left_semi")), "marks")
    x, y = (t.join(marks.hint("merge"), "node").select("bucket", "i", "j", "node", "root", "marks") for t in blocks(open_))
    y = y.withColumnsRenamed({c: f"{c}_" for c in y.columns})
    return x.groupBy("bucket", "i", "j").cogroup(y.groupBy("bucket_", "i_", "j_")).applyInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, width: int = 5, least: float = 0.8, bands: int = 24, rows: int = 5) -> DataFrame:
    """doc_id, class_id (its class's least doc_id), n_class, representative (1 for one row of each class) and th, a hash
    of the text.

    Equal texts are one node. Every pair of texts that share a bucket in some band is checked, or both are in one class
    already; see resolved(). With 24 bands of 5 rows a pair of similarity 0.8 shares a bucket with probability 0.9999."""
    rows_ = written(signed(docs, width, bands, rows), "signed")
    nodes = written(rows_.filter("has").groupBy("th", "k1", "k2").agg(F.first("bands").alias("bands")), "nodes")
    members = nodes.select(F.col("th").alias("node"), F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = written(members.join(shared, "bucket"), "buckets")
    wanted = members.select("node").distinct()
    named = docs.select(F.xxhash64("text").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    sets = written(counted(named.join(wanted.hint("merge"), "node", "left_semi"), width).dropDuplicates(["node"]), "sets")
    roots = resolved(members, lambda pairs: verified(pairs, sets, least), lambda open_: verified(written(crossing(open_, sets, least), "near"), sets, least))
    release(members, sets)
    named_rows = rows_.select("doc_id", "th", "row", "has").join(roots, F.col("th") == F.col("node"), "left").withColumn("root", F.coalesce("root", "th")).drop("node")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("row"))
    whole = named_rows.filter("has").groupBy("root").agg(F.count("*").alias("n_class"), F.min(first).alias("first"))
    out = named_rows.join(whole, "root", "left")
    class_id = F.when(F.col("has"), F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.when(F.col("has"), F.col("n_class")).otherwise(1).alias("n_class"), (~F.col("has") | (F.col("row") == F.col("first.row"))).cast("int").alias("representative"), "th")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with all columns of docs."""
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__th": F.xxhash64("text")})
    kept = classes(docs, **options).filter("representative = 1").select(F.col("doc_id").alias("__kept_id"), F.col("th").alias("__kept_th")).distinct()
    same = F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__th") == F.col("__kept_th"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["__id", "__th"]).drop("__id", "__th")
