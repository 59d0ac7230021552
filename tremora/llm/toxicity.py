"""Toxicity: a classifier chain. Categories are predicted one after another; the linear model of a later one also gets
the probabilities of the earlier ones, out of fold while it is trained. Categories before the last are columns of the
labels, or groups of the toxic training texts by the words they share.

Nulls, ties and odd rows: a null text counts as empty; labels that are null or neither 0 nor 1 teach nothing; without
labels of both kinds a category's probability is the share of label 1 (0 without any); a null label of another category
counts as 0; a null doc_id is held out of learning; repeated rows are rows of their own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import bounded_batches, lean, release, written
from tremora.llm.quality import held_out
from tremora.llm.tokens import portions

PORTION = 2 << 20
#: Bytes that end a word here: all but letters, digits and those above 127; A to Z become a to z.
SPLITTER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> dict[bytes, int]:
    """Each different word of a whole text and its count."""
    out: dict[bytes, int] = {}
    for w in (text or "").encode().translate(SPLITTER).split():
        out[w] = out.get(w, 0) + 1
    return out


class Linear(NamedTuple):
    weights: np.ndarray
    bias: float


def fit_linear(rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, ridge: float = 0.1, steps: int = 200) -> Linear:
    """Logistic regression by Newton steps on a diagonal bound. Entries (rows, columns) of the sparse part are 1;
    dense columns follow them."""
    n, d = len(y), width + dense.shape[1]
    share = float(np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4))
    w, b = np.zeros(d), float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Linear(w, b if n else float(np.log(1e-4)))
    momentum, mb = np.zeros(d), 0.0
    for _ in range(steps):
        look, lb = w + 0.8 * momentum, b + 0.8 * mb
        z = np.clip(np.bincount(rows, look[columns], n) + dense @ look[width:] + lb, -30, 30)
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 0.02)
        load = 1 + np.bincount(rows, minlength=n)  # a bound of how much the columns of a row move together
        grad = np.concatenate((np.bincount(columns, g[rows], width), dense.T @ g)) + ridge * look
        curve = np.concatenate((np.bincount(columns, (h * load)[rows], width), (dense**2).T @ (h * load))) + ridge
        new, nb = look - grad / curve, lb - g.sum() / (h * load).sum()
        momentum, mb, w, b = new - w, nb - b, new, nb
    return Linear(w, b)


class Chain(NamedTuple):
    names: tuple[str, ...]
    vocabulary: dict[bytes, int]
    models: tuple[Linear, ...]

    def predict(self, found: list[list[int]]) -> np.ndarray:
        """Probabilities of every category; found holds the vocabulary columns of each text."""
        rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
        columns = np.array([c for x in found for c in x], np.int64)
        width, out = len(self.vocabulary), np.zeros((len(found), 0))
        for m in self.models:
            z = np.bincount(rows, m.weights[columns], len(found)) + out @ m.weights[width : width + out.shape[1]] + m.bias
            out = np.column_stack((out, 1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def fit_columns(found: list[list[int]], vocabulary: dict[bytes, int], labels: dict[str, np.ndarray], folds: int = 4) -> Chain:
    """Trains one model a category, in the given order. found: the vocabulary columns of each row. To train category k,
    the probabilities of each earlier category come from models that have not seen the row's fold."""
    n = len(found)
    rows, columns = np.repeat(np.arange(n), [len(x) for x in found]), np.array([c for x in found for c in x], np.int64)
    fold = np.arange(n) % folds
    given, models = np.zeros((n, 0)), []
    for y in labels.values():
        y = y.astype(np.float64)
        models.append(fit_linear(rows, columns, given, y, len(vocabulary)))
        outside = np.zeros(n)
        for k in range(folds):
            learn = fold != k
            place = np.cumsum(learn) - 1
            entries = learn[rows]
            m = fit_linear(place[rows[entries]], columns[entries], given[learn], y[learn], len(vocabulary))
            z = np.bincount(rows, m.weights[columns], n) + given @ m.weights[len(vocabulary) :] + m.bias
            outside[~learn] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[~learn]
        given = np.column_stack((given, outside))
    return Chain(tuple(labels), vocabulary, tuple(models))


def kinds(found: list[list[int]], toxic: np.ndarray, strongest: int = 64, k: int = 2, rounds: int = 10) -> dict[str, np.ndarray]:
    """Categories of the toxic rows where labels name none: k groups by spherical k-means over the ``strongest`` first
    columns, started from rows that share the least. A row without any of them is in none."""
    at = np.flatnonzero(toxic == 1)
    x = np.zeros((len(at), strongest))
    for i, j in enumerate(at.tolist()):
        x[i, [c for c in found[j] if c < strongest]] = 1
    size = np.sqrt((x**2).sum(1))
    x[size > 0] /= size[size > 0, None]
    held = np.flatnonzero(size > 0)
    out = {f"kind_{g + 1}": np.zeros(len(toxic), np.int64) for g in range(k)}
    if len(held) < k:
        return out
    centres = x[held[:1]]
    while len(centres) < k:
        centres = np.vstack((centres, x[held[np.argmin((x[held] @ centres.T).max(1))]]))
    group = np.zeros(len(held), np.int64)
    for _ in range(rounds):
        group = np.argmax(x[held] @ centres.T, 1)
        centres = np.stack([x[held[group == g]].sum(0) if (group == g).any() else centres[g] for g in range(k)])
        centres /= np.maximum(np.sqrt((centres**2).sum(1)), 1e-12)[:, None]
    for g in range(k):
        out[f"kind_{g + 1}"][at[held[group == g]]] = 1
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = 10_000, most_terms: int = 4_096, least: int = 3, strong: float = 3.0, folds: int = 5, categories: tuple[str, ...] = ()) -> Chain:
    """Fits on at most ``most`` labelled rows outside the held-out fold, the first by a hash of their ids. categories:
    columns of labels that come before ``toxic`` in the chain; without any, kinds() makes them from the texts.

    Words are counted by Spark. The driver gets ``most_terms`` words at most, those whose share among toxic rows differs
    from that among the others the most and by ``strong`` deviations, and for each row the numbers of those it holds."""
    wanted = ["toxic", *categories]
    known = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(f"y_{c}") for c in wanted])
    ys = [f"y_{c}" for c in wanted]
    chosen = written(known.filter(~held_out(F.col("doc_id"), folds)).orderBy(F.xxhash64("doc_id"), "doc_id", *ys).limit(most), "toxicity")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # ``most`` rows of a few numbers
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", *ys, F.xxhash64("text")).limit(most)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, PORTION):
                words = [sorted(terms(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[part.column(y) for y in ys], pa.array(words, pa.list_(pa.binary()))], names=["doc_id", *ys, "words"])

    schema = "doc_id long, " + ", ".join(f"{y} int" for y in ys) + ", "
    held = written(rows.mapInArrow(lean(bags), schema + "words array<binary>"), "toxicity-words")
    n1, n = (int(x or 0) for x in held.agg(F.sum("y_toxic"), F.count("*")).first())
    counts = held.select("y_toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("y_toxic") == 0).alias("without"), F.count_if(F.col("y_toxic") == 1).alias("within"))
    p, q = (F.col("within") + 0.5) / (max(n1, 1) + 1), (F.col("without") + 0.5) / (max(n - n1, 1) + 1)
    strength = F.abs(p - q) / F.sqrt(p * (1 - p) / max(n1, 1) + q * (1 - q) / max(n - n1, 1))
    top = counts.withColumn("strength", F.round(strength, 9)).filter((F.col("without") + F.col("within") >= least) & (F.col("strength") >= strong)).orderBy(F.desc("strength"), "word").limit(most_terms).collect()
    vocabulary = {bytes(r.word): i for i, r in enumerate(top)}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(c for w in words if (c := vocabulary.get(w)) is not None) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(y) for y in ys], pa.array(found, pa.list_(pa.int32()))], names=["doc_id", *ys, "found"])

    got = sorted((tuple(r) for r in held.mapInArrow(numbers, schema + "found array<int>").collect()), key=lambda r: (r[0], r))
    release(chosen, held)
    found, toxic = [list(r[-1]) for r in got], np.array([r[1] for r in got], np.int64)
    given = {c: np.array([r[2 + i] for r in got], np.int64) for i, c in enumerate(categories)}
    return fit_columns(found, vocabulary, (given or kinds(found, toxic)) | {"toxic": toxic})


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, a probability for each category and ``flagged`` (1 if the last reaches threshold): a narrow map."""
    names = [f"p_{x}" for x in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = chain.vocabulary.get
        for batch in batches:
            for part in portions(batch, PORTION):
                found = [[c for w in set((t or "").encode().translate(SPLITTER).split()) if (c := get(w)) is not None] for t in part.column("text").to_pylist()]
                p = chain.predict(found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(p[:, i]) for i in range(len(names))]], names=["doc_id", *names])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{x} double" for x in names))
    return rows.withColumn("flagged", (F.col(names[-1]) >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5, **options) -> DataFrame:
    """doc_id, held_out, score (the last category's probability), predicted, and each category's probability."""
    chain = train(docs, labels, folds=folds, **options)
    scored = score(docs, chain, threshold)
    return scored.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), F.col("p_toxic").alias("score"), F.col("flagged").alias("predicted"), *[f"p_{x}" for x in chain.names])
