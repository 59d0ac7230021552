"""Substring dedup: exact windows of words behind a count-min prefilter.

Texts are dealt into chunks of bounded size by hash. Each chunk counts the windows of its own texts in a sparse
saturating count-min sketch; the chunks' sketches are merged block by block, and each chunk gets back one bit for every
cell of its own that is counted twice or more. No sketch is ever whole in one place, so its width follows the input.
A second pass groups exactly only the windows that all rows of the sketch estimate repeated; an overestimate costs
work and an underestimate is not possible, so none is lost.

Nulls, ties and odd rows: a null or empty text has no words and keeps nothing; texts shorter than a window lose
nothing; rows without a doc_id come after all others; several rows of one doc_id are documents one after another, by
chunk and text; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tremora.llm import tokens
from tremora.llm.common import chunk_count, pack, text_bytes, unpack, with_chunk

LAST = np.iinfo(np.int64).max
SKETCH = "line int, block int, chunk int, n int, low binary, high binary, twice binary"
REPLY = "chunk int, line int, block int, n int, repeated binary"
FIRSTS = "bucket int, chunk int, h1 binary, h2 binary, at binary, ids binary, runs binary"
COPIES = "chunk int, at binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.table([pa.array([], kinds[k]) for _, k in fields], names=[n for n, _ in fields])


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    base = empty(schema)
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(base.schema)], names=base.column_names) if rows else base


class Chunk:
    """The texts of one chunk in document order, their words and the hashes of their windows."""

    def __init__(self, rows: pa.Table, window: int):
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text")
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i].as_py())) if len(set(ids)) < len(ids) else sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        self.words = tokens.words(texts.take(pa.array(order, pa.int64())))
        h1, h2 = tokens.hashes(self.words.dictionary)
        starts = self.words.starts
        valid = np.zeros(len(self.words.codes), bool)
        sizes = np.diff(starts)
        long_ = sizes >= window
        edge = np.zeros(len(valid) + 1, np.int64)
        np.add.at(edge, starts[:-1][long_], 1)
        np.add.at(edge, starts[1:][long_] - window + 1, -1)
        valid[:] = np.cumsum(edge)[:-1] > 0
        self.at = np.flatnonzero(valid)  # where windows start
        self.h1 = tokens.sequence_hashes(h1[self.words.codes], window)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.h2 = tokens.sequence_hashes(h2[self.words.codes], window)[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def cells(self, line: int, bits: int) -> np.ndarray:
        """The cell of each window in one row of the sketch."""
        return tokens.mix(self.h1 + np.uint64(line) * self.h2) >> np.uint64(64 - bits)

    def order_ids(self) -> np.ndarray:
        """For each window, its document's id; those without one come last."""
        ids = np.array([LAST if i is None else i for i in self.ids], np.int64)
        return np.repeat(ids, np.diff(self.words.starts))[self.at]


def encode(cells: np.ndarray, universe_bits: int) -> tuple[bytes, bytes, int]:
    """Elias-Fano: low bytes as they are, the rest as a unary bitmap; also the number of low bits."""
    n = len(cells)
    low_bits = 8 * max(0, math.ceil((universe_bits - math.log2(n) - 2) / 8))
    low = (cells & np.uint64((1 << low_bits) - 1)).astype({0: np.uint8, 8: np.uint8, 16: np.uint16}.get(low_bits, np.uint64))
    high = (cells >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(high[-1]) + 1, np.uint8)
    unary[high] = 1
    return (low.tobytes() if low_bits else b""), np.packbits(unary).tobytes(), low_bits


def decode(low: bytes, high: bytes, n: int, universe_bits: int) -> np.ndarray:
    low_bits = 8 * max(0, math.ceil((universe_bits - math.log2(n) - 2) / 8))
    cells = (np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8))) - np.arange(n)) << low_bits
    return cells + np.frombuffer(low, {8: np.uint8, 16: np.uint16}.get(low_bits, np.uint64)).astype(np.int64) if low_bits else cells


def later_copies(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether an earlier place has the same pair of hashes."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((np.arange(len(h1)), h2, h1))
        a, b = h1[order], h2[order]
        same = a[1:] == a[:-1]
    out = np.zeros(len(h1), bool)
    out[order[1:][same & (b[1:] == b[:-1])]] = True
    return out


def sketch_chunk(rows: pa.Table, window: int, depth: int, bits: int, block_bits: int) -> pa.Table:
    """The chunk's own sketch: for each row and block, the cells that its windows fall in and which do so twice."""
    chunk, number, out = Chunk(rows, window), rows.column("chunk")[0].as_py(), []
    inner = bits - block_bits
    for line in range(depth):
        cells, counts = np.unique(chunk.cells(line, bits), return_counts=True)
        edges = np.searchsorted(cells, np.arange((1 << block_bits) + 1, dtype=np.uint64) << np.uint64(inner))
        for block in range(1 << block_bits):
            a, b = edges[block], edges[block + 1]
            if a < b:
                low, high, _ = encode(cells[a:b] & np.uint64((1 << inner) - 1), inner)
                out.append((line, block, number, int(b - a), low, high, np.packbits(counts[a:b] > 1).tobytes()))
    return table_of(out, SKETCH)


def merge_block(rows: pa.Table, bits: int, block_bits: int) -> pa.Table:
    """The sum of all chunks' counts in one block, and for each chunk which of its cells reach two."""
    inner, lists = bits - block_bits, []
    total = np.zeros(1 << inner, np.uint8)
    for x in rows.to_pylist():
        cells = decode(x["low"], x["high"], x["n"], inner)
        counts = 1 + np.unpackbits(np.frombuffer(x["twice"], np.uint8), count=x["n"])
        total[cells] = np.minimum(total[cells] + counts, 2)
        lists.append((x, cells))
    return table_of([(x["chunk"], x["line"], x["block"], x["n"], np.packbits(total[c] > 1).tobytes()) for x, c in lists], REPLY)


def estimated(chunk: Chunk, replies: pa.Table, depth: int, bits: int) -> np.ndarray:
    """Which windows every row of the merged sketch counts twice or more."""
    mask = np.ones(len(chunk.at), bool)
    got = sorted(zip(*[replies.column(c).to_pylist() for c in ("line", "block", "n", "repeated")], strict=True))
    for line in range(depth):
        cells = chunk.cells(line, bits)
        order = np.argsort(cells)
        new = np.ones(len(cells), bool)
        new[1:] = cells[order][1:] != cells[order][:-1]
        flags = [np.unpackbits(np.frombuffer(r, np.uint8), count=n) for x, _, n, r in got if x == line]
        flags = np.concatenate(flags) if flags else np.zeros(0, np.uint8)
        mask[order] &= flags[np.cumsum(new) - 1].astype(bool)
    return mask


def first_places(rows: pa.Table, replies: pa.Table, window: int, depth: int, bits: int, buckets: int) -> pa.Table:
    """Of each window estimated repeated, its first place in the chunk, dealt by hash: a passage that a third of all
    documents hold comes once from each chunk."""
    if not rows.num_rows:
        return empty(FIRSTS)
    chunk, number = Chunk(rows, window), rows.column("chunk")[0].as_py()
    if not len(chunk.at):
        return empty(FIRSTS)
    picked = np.flatnonzero(estimated(chunk, replies, depth, bits))
    picked = picked[~later_copies(chunk.h1[picked], chunk.h2[picked])]
    ids, bucket, out = chunk.order_ids()[picked], (chunk.h2[picked] % np.uint64(buckets)).astype(np.int64), []
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        part = order[edges[b] : edges[b + 1]]
        if len(part):
            mine, w = ids[part], picked[part]
            runs = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            out.append((b, number, pack(chunk.h1[w]), pack(chunk.h2[w]), pack(chunk.at[w].astype(np.uint32)), pack(mine[runs]), pack(np.diff(np.append(runs, len(mine))).astype(np.uint32))))
    return table_of(out, FIRSTS)


def resolve(rows: pa.Table) -> pa.Table:
    """Of the chunks' first places of equal windows all but the first of all, back to their chunks."""
    parts = rows.to_pylist()
    h1, h2, at = (np.concatenate([unpack(x[c], d) for x in parts]) for c, d in (("h1", "u8"), ("h2", "u8"), ("at", "u4")))
    ids = np.concatenate([np.repeat(unpack(x["ids"], "i8"), unpack(x["runs"], "u4")) for x in parts])
    chunk = np.repeat([x["chunk"] for x in parts], [len(x["at"]) // 4 for x in parts])
    order = np.lexsort((at, chunk, ids, h2, h1))
    later = np.zeros(len(order), bool)
    later[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    gone = order[later]
    gone = gone[np.argsort(chunk[gone], kind="stable")]
    edges = np.flatnonzero(np.diff(chunk[gone])) + 1
    return table_of([(int(chunk[g[0]]), pack(at[g])) for g in np.split(gone, edges) if len(g)], COPIES)


def cut(rows: pa.Table, copies: pa.Table, window: int, keep_text: bool) -> pa.Table:
    """Each document without the words that a window with an earlier equal covers."""
    if not rows.num_rows:
        return empty(RESULT)
    chunk = Chunk(rows, window)
    removed = chunk.at[later_copies(chunk.h1, chunk.h2)]
    removed = np.unique(np.concatenate([removed, *[unpack(x, "u4").astype(np.int64) for x in copies.column("at").to_pylist()]]))
    codes, starts = chunk.words.codes, chunk.words.starts
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[removed] += 1
    edge[removed + window] -= 1
    kept = np.cumsum(edge)[:-1] == 0
    ends = np.concatenate(([0], np.cumsum(kept)))[starts]
    lists = pa.LargeListArray.from_arrays(pa.array(ends), chunk.words.dictionary.take(pa.array(codes[kept])))
    texts = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))
    n_words = np.diff(starts)
    sha = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts])
    text = texts.cast(pa.large_string()).cast(pa.string()) if keep_text else pa.nulls(len(texts), pa.string())
    return pa.table([pa.array(chunk.ids, pa.int64()), pa.array(n_words), pa.array(n_words - np.diff(ends)), sha, text], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def dedup(docs: DataFrame, window: int = 20, depth: int = 2, load: int = 4, chunk_bytes: int = 16 << 20, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text left; null unless keep_text) of every document.

    Removed are the words covered by a window of ``window`` words whose words also start earlier: in a smaller doc_id,
    or earlier in the same document. ``load``: cells of each of the ``depth`` rows for each expected window. Texts are
    shuffled once, to their chunks; Spark uses that exchange for all three passes over them.
    """
    total = text_bytes(docs)
    chunks = chunk_count(total, chunk_bytes)
    block_bits = max(0, (chunks - 1).bit_length())
    bits = max(block_bits + 8, math.ceil(math.log2(max(1, load * total / 6))))
    placed = with_chunk(docs, chunks)

    def sketch(t: pa.Table) -> pa.Table:
        return sketch_chunk(t, window, depth, bits, block_bits)

    def merge(t: pa.Table) -> pa.Table:
        return merge_block(t, bits, block_bits)

    def firsts(t: pa.Table, replies: pa.Table) -> pa.Table:
        return first_places(t, replies, window, depth, bits, 1 << block_bits)

    def finish(t: pa.Table, copies: pa.Table) -> pa.Table:
        return cut(t, copies, window, keep_text)

    replies = placed.groupBy("chunk").applyInArrow(sketch, SKETCH).groupBy("line", "block").applyInArrow(merge, REPLY)
    copies = placed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(firsts, FIRSTS).groupBy("bucket").applyInArrow(resolve, COPIES)
    return placed.groupBy("chunk").cogroup(copies.groupBy("chunk")).applyInArrow(finish, RESULT)
