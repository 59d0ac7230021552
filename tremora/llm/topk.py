"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz pruning.

Nulls, ties and odd rows: vectors that are null, or hold a null or non-finite component, and rows without an id take no
part; a shorter vector counts as padded with zeros; repeated equal rows are candidates of their own and one query;
rows with a query's id are no candidates of it; ties go to the smaller id; a query with no candidate gives no row; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import written

BANDS = 64


def quantised(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (packed int64 of floor(scale * x)), norm: of each usable row."""
    width = table.select(F.max(F.size("embedding"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs, norms = [], [], []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if i is None or x is None or any(c is None or not math.isfinite(c) for c in x):
                    continue
                v = np.zeros(max(width, 1), np.int64)
                v[: len(x)] = np.floor(np.array(x, np.float64) * scale)
                ids.append(i)
                vs.append(v.tobytes())
                norms.append(float(np.sqrt((v.astype(np.float64) ** 2).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vs, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "v", "norm"])

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, v binary, norm double")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    data = [x.as_py() for x in column]
    return np.frombuffer(b"".join(data), np.int64).reshape(len(data), -1) if data else np.zeros((0, 1), np.int64)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of all rows of a with all of b: by floating point where that is exact."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k highest of one query's scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search_block(q_ids, q, q_norm, floor, ids, v, norm, rotation, lead, k, tile=1024):
    """Rows (query place, candidate place, score) of one block against one block of queries.

    Candidates come by descending length in tiles. A tile is left when the longest of it can't reach a query's k-th
    score (Cauchy-Schwarz on lengths); a pair is left when the inner product of the leading rotated parts, and that of
    the lengths of the rest, can't. Only what remains is computed, in integers."""
    order = np.lexsort((ids, -norm))
    ids, v, norm = ids[order], v[order], norm[order]
    qr, vr = q @ rotation, v @ rotation
    q_rest, v_rest = (np.sqrt((x[:, lead:] ** 2).sum(1)) for x in (qr, vr))
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
    floor = floor.copy()
    for a in range(0, len(ids), tile):
        b = min(a + tile, len(ids))
        slack = 1e-9 * q_norm * norm[a] + 1e-6
        live = np.flatnonzero(q_norm * norm[a] + slack >= floor)
        if not len(live):
            break
        bound = qr[live, :lead] @ vr[a:b, :lead].T + np.outer(q_rest[live], v_rest[a:b])
        open_ = (bound + slack[live, None] >= floor[live, None]) & (ids[a:b][None, :] != q_ids[live][:, None])
        some = np.flatnonzero(open_.any(1))
        columns = np.flatnonzero(open_.any(0))
        products = exact_products(q[live[some]], v[a:b][columns])
        for row, i in enumerate(some):
            mine = open_[i][columns]
            at, scores = columns[mine] + a, products[row][mine]
            j = live[i]
            at, scores = np.concatenate((kept[j][0], at)), np.concatenate((kept[j][1], scores))
            top = best(scores, ids[at], k)
            kept[j] = (at[top], scores[top])
            if len(top) == k:
                floor[j] = max(floor[j], float(kept[j][1][-1]))
    return [(j, at, s) for j, (p, scores) in enumerate(kept) for at, s in zip(order[p].tolist(), scores.tolist(), strict=True)]


def top_k(table: DataFrame, k: int = 5, every: int = 50, block: int = 16_384, query_block: int = 2_048, seeds: int = 4_096, sample: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of each row with vec_id % every = 0.

    The rotation comes from a sample of at most ``sample`` rows and the first floors from the ``seeds`` longest
    vectors; both only decide how much is pruned. All rows are dealt into bands of length and those into blocks of
    about ``block`` rows by hash, so equal lengths are no hot block. A query is sent to the blocks whose longest vector
    can still reach its floor; each pair of blocks is one task's group, of bounded size.
    """
    vectors = written(quantised(table), "vectors")
    size = vectors.count()
    queries = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "v"])
    fitted = matrix(pa.array([bytes(r.v) for r in vectors.orderBy(F.xxhash64("vec_id"), "v").limit(sample).select("v").collect()])).astype(np.float64)
    rotation = np.linalg.svd(fitted.T @ fitted)[2].T if len(fitted) else np.eye(1)
    spread = np.cumsum(((fitted @ rotation) ** 2).sum(0)) if len(fitted) else np.ones(1)
    lead = int(np.searchsorted(spread, 0.7 * spread[-1])) + 1
    longest = vectors.orderBy(F.desc("norm"), "vec_id", "v").limit(seeds).collect()
    s_ids, s_v = np.array([r.vec_id for r in longest], np.int64), matrix(pa.array([bytes(r.v) for r in longest], pa.binary()))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, scores = np.array(batch.column("vec_id").to_pylist(), np.int64), exact_products(matrix(batch.column("v")), s_v).astype(np.float64)
            scores[ids[:, None] == s_ids[None, :]] = -np.inf
            low = -np.partition(-scores, k - 1, 1)[:, k - 1] if scores.shape[1] >= k else np.full(len(ids), -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("norm"), pa.array(low)], names=["vec_id", "v", "norm", "floor"])

    edges = sorted(set(vectors.approxQuantile("norm", [i / BANDS for i in range(1, BANDS)], 0.005))) if size else []
    band = sum((F.when(F.col("norm") > e, 1).otherwise(0) for e in edges), F.lit(0))
    banded = vectors.withColumn("band", band)
    bands = {r.band: (r.n, r.longest) for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}  # BANDS rows at most
    parts = {b: max(1, math.ceil(n / block)) for b, (n, _) in bands.items()}
    n_queries = queries.count()
    q_blocks = max(1, math.ceil(n_queries / query_block))
    number = lambda m: F.element_at(F.create_map(*[F.lit(x) for pair in m.items() for x in pair]), F.col("band")) if m else F.lit(1)
    placed = banded.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), number(parts).cast("long")).cast("int"))
    dealt = placed.select("band", "part", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"), "vec_id", "v", "norm")
    blocks = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(n).alias("parts"), F.lit(float(bands[b][1])).alias("longest")) for b, n in sorted(parts.items())]) if parts else F.array().cast("array<struct<band int, parts int, longest double>>")
    asked = queries.mapInArrow(floors, "vec_id long, v binary, norm double, floor double").withColumn("q_block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(q_blocks)).cast("int"))
    sent = asked.select("q_block", "vec_id", "v", "norm", "floor", F.explode(blocks).alias("b")).filter(F.col("norm") * F.col("b.longest") * (1 + 1e-9) + 1e-6 >= F.col("floor"))
    sent = sent.select(F.col("b.band").alias("band"), F.explode(F.sequence(F.lit(0), F.col("b.parts") - 1)).alias("part"), "q_block", "vec_id", "v", "norm", "floor")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "q_v", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.int64())], names=names)
        ids, v, norm = left.column("vec_id").to_numpy(), matrix(left.column("v")), left.column("norm").to_numpy()
        q_ids, q, q_norm, floor = right.column("vec_id").to_numpy(), matrix(right.column("v")), right.column("norm").to_numpy(), right.column("floor").to_numpy()
        found = search_block(q_ids, q, q_norm, floor, ids, v, norm, rotation, lead, k)
        rows = [(int(q_ids[j]), q[j].tobytes(), int(ids[i]), s) for j, i, s in found]
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=names)

    key = ["band", "part", "q_block"]
    pairs = dealt.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(run, "query_id long, q_v binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "q_v").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
