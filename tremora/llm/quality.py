"""Quality classifier: histogram gradient-boosted trees over document statistics, traversed as flat arrays.

Nulls, ties and odd rows: a null text counts as empty and gets a score like any other; labels that are null or neither
0 nor 1 teach nothing; of several labels for one doc_id each counts; without labels of both kinds the score is the
share of label 1 (0.5 without any); repeated rows are rows of their own; a null doc_id is held out of learning; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import bounded_batches, lean
from tremora.llm.tokens import portions, sequence_hashes

PORTION = 2 << 20
STATISTICS = ("bytes", "words", "lines", "word_length", "line_words", "different_words", "different_lines", "repeated_fours", "upper", "digits", "punctuation", "stops", "symbols", "marks", "bars", "ends", "non_ascii", "controls", "compressed", "entropy", "longest_word", "short_lines")
KINDS = np.zeros((9, 256))
for row, members in enumerate((range(65, 91), range(48, 58), b"!\"'(),-.:;?", b".,", b"#$%&*+/<=>@\\^_`{}~", b"!?", b"|", b"\x7f", range(128, 256))):
    KINDS[row, list(members)] = 1
KINDS[7, [*range(9), *range(14, 32)]] = 1


def runs_of_four(words: list[bytes]) -> np.ndarray:
    """A hash of each four adjacent words; the words' own places in a dictionary stand for them."""
    place: dict[bytes, int] = {}
    codes = np.array([place.setdefault(w, len(place)) for w in words], np.uint64)
    return sequence_hashes(codes, 4)


def statistics(text: str | None) -> list[float]:
    """STATISTICS of one whole text; all of them 0 where there is nothing to measure."""
    data = (text or "").encode()
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    w = max(len(words), 1)
    upper, digits, punctuation, stops, symbols, marks, bars, controls, wide = (KINDS @ counts / n).tolist()
    share = counts[counts > 0] / n
    fours = runs_of_four(words)
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(len(lines), 1)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(len(lines))), sum(map(len, words)) / w, len(words) / max(len(lines), 1), len(set(words)) / w,
        len(set(lines)) / max(len(lines), 1), 1 - len(np.unique(fours)) / max(len(fours), 1), upper, digits, punctuation, stops, symbols, marks, bars, ends, wide, controls,
        len(zlib.compress(data, 1)) / n, float(-(share * np.log2(share)).sum()), float(max(map(len, words), default=0)), sum(len(x) < 30 for x in lines) / max(len(lines), 1),
    ]


def measured(batch: pa.RecordBatch) -> np.ndarray:
    """STATISTICS of each text of a batch, a row each."""
    return np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float64)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of each row: a narrow map."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, PORTION):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(measured(part).tolist(), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, x array<double>")


class Forest(NamedTuple):
    """Complete trees of one depth, flattened: node i of a tree has the children 2 i + 1 and 2 i + 2."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # go right if x > threshold
    leaf: np.ndarray  # (trees, leaves)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: every row of x goes down a tree at a time, level by level."""
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += leaf[node - inner]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Forest:
    """Boosting of the logistic loss by second-order gain over histograms of quantile bins."""
    p = float(y.mean()) if len(y) else 0.5
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or not 0 < p < 1:
        p = min(max(p, 1e-3), 1 - 1e-3)
        return Forest(float(np.log(p / (1 - p))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    base, n, f = float(np.log(p / (1 - p))), *x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) for j in range(f)]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    raw, made = np.full(n, base), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        node, feature, threshold = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            hist = np.stack([[np.bincount(at * bins + code[:, j], v, width * bins).reshape(width, bins) for v in (g, h)] for j in range(f)])
            left = hist.cumsum(-1)
            total = left[..., -1:]
            gain = (left[:, 0] ** 2 / (left[:, 1] + ridge)) + ((total - left)[:, 0] ** 2 / ((total - left)[:, 1] + ridge)) - total[:, 0] ** 2 / (total[:, 1] + ridge)
            gain[(left[:, 1] < least / 4) | ((total - left)[:, 1] < least / 4)] = 0
            for i in range(width):
                j, b = np.unravel_index(int(gain[:, i].argmax()), (f, bins))
                if gain[j, i, b] > 1e-9 and b < len(cuts[j]):
                    feature[first + i], threshold[first + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        raw += leaf[at]
        made.append((feature, threshold, leaf))
    return Forest(base, *[np.stack(x) for x in zip(*made, strict=True)])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32(doc_id as text) mod folds is 0; so for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000, folds: int = 5, **options) -> Forest:
    """Fits on at most ``most`` labelled rows outside the held-out fold, the first by a hash of their ids. They are
    chosen by id alone, so that statistics are computed for these texts only."""
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = named.filter(~held_out(F.col("doc_id"), folds)).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most).select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id", "left_semi")  # at most ``most`` ids
    rows = document_statistics(texts).join(known.join(F.broadcast(chosen), "doc_id", "left_semi"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(most).collect()
    x, y = np.array([r.x for r in rows], np.float64).reshape(len(rows), len(STATISTICS)), np.array([r.y for r in rows], np.float64)
    return fit(x, y, **options)


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score of each row: statistics and a vectorised traversal in one narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, PORTION):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(forest.scores(measured(part)))], names=["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, train(docs, labels, folds=folds, **options))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, **options) -> DataFrame:
    """The rows of docs, all their columns, whose score reaches the threshold: trained as in classify(), then a narrow
    map in which no text is shuffled."""
    forest = train(docs, labels, folds=folds, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, PORTION):
                yield part.filter(pa.array(forest.scores(measured(part)) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)
