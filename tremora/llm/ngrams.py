"""LM scoring: an interpolated bigram model in Elias-Fano tries that hold quantised smoothed probabilities.

Texts are dealt into chunks of bounded size. Each chunk first sends its words with their counts in training texts to the
shards that own them and gets the counts over all texts back. Then it sends every different pair of neighbours once,
with its count and its context's count, to the shards of tries. A shard sums the pairs, builds its trie and answers each
chunk's questions; the chunk then scores its texts. The whole model is never in one place: its shards grow in number
with the input. A context that is a large part of all tokens is split over as many shards as its count asks for.

Smoothing: absolute discounting, interpolated, p(w | h) = q(w | h) + (1 - sum of q(v | h) over all v) p(w) with
p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). The trie holds q, which is (c(h w) - D) / c(h) for a pair seen and 0 for any
other, cut down to one of 255 steps of a log scale; since the rest of the mass is taken from the stored values, the
probabilities of all words and of the unknown one sum to 1 for every context. c(w), c(h), N and V are exact.

Nulls, ties and odd rows: a null text is empty and has its end token alone; rows without a doc_id are held out;
repeated rows are documents of their own and are learned as often as they come; without training texts N and V are 0;
an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import mmap
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tremora.llm import tokens
from tremora.llm.common import chunk_count, pack, text_bytes, unpack, with_chunk
from tremora.llm.substrings import table_of

END, BEGIN = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x1B873593CC9E2D51)
#: What is taken off each pair's count.
DISCOUNT = 0.75
#: Steps of the quantised scale for each factor of ten: 254 of them reach down to 10 ** -12.65.
STEPS = 20
#: Value of each code; 0 stands for a pair never seen, or one of less than the least value.
VALUES = np.concatenate(([0.0], 10.0 ** (-np.arange(255) / STEPS)))
PRINT = np.uint64(24)  # a successor's fingerprint is the upper 40 bits of its hash
#: A context with more of all tokens than this part of a shard's share is split.
SPLIT = 4
WORDS = "shard int, chunk int, keys binary, counts binary"
COUNTED = "chunk int, kind int, shard int, known long, total long, values binary, sums binary"
PAIRS = "shard int, chunk int, keys binary, totals binary, runs binary, next binary, counts binary"
LEVELS = "shard int, contexts long, pairs long, levels binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack40(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(data: bytes | pa.Buffer) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8)
    out = np.zeros((len(flat) // 5, 8), np.uint8)
    out[:, :5] = flat.reshape(-1, 5)
    return out.view("<u8").ravel()


def codes_of(q: np.ndarray) -> np.ndarray:
    """The code of the greatest value that is not above q."""
    steps = np.ceil(-STEPS * np.log10(q) - 1e-9).astype(np.int64)
    return np.where(steps < 255, steps + 1, 0).astype(np.uint8)


class Bits:
    """Packed bits with the number of ones before each block of 128, where the i-th one or zero is found in place."""

    BLOCK = 16  # bytes

    @staticmethod
    def build(bits: np.ndarray) -> bytes:
        packed = np.packbits(bits)
        packed = np.concatenate((packed, np.zeros(-len(packed) % Bits.BLOCK, np.uint8))).reshape(-1, Bits.BLOCK)
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed).sum(1, dtype=np.int64))))
        return np.array([len(packed), len(bits)], "<i8").tobytes() + before.astype("<i8").tobytes() + packed.tobytes()

    def __init__(self, data: memoryview):
        n, self.length = np.frombuffer(data[:16], "<i8").tolist()
        self.before = np.frombuffer(data[16 : 24 + 8 * n], "<i8")
        self.size = 24 + 8 * n + Bits.BLOCK * n
        self.blocks = np.frombuffer(data[24 + 8 * n : self.size], np.uint8).reshape(n, Bits.BLOCK)

    def select(self, i: np.ndarray, one: bool) -> np.ndarray:
        """Where the i-th (from 0) one or zero stands; the length of all where there is none."""
        before = self.before if one else np.arange(len(self.before)) * (8 * Bits.BLOCK) - self.before
        block = np.searchsorted(before, i, "right") - 1
        there = block < len(self.blocks)
        block = np.where(there, block, 0)
        if not len(self.blocks):
            return np.full(len(i), self.length)
        rows = self.blocks[block] if one else ~self.blocks[block]
        counts = np.cumsum(np.bitwise_count(rows), 1, dtype=np.int16)
        rest = (i - before[block]).astype(np.int64)
        byte = np.minimum((counts <= rest[:, None]).sum(1), Bits.BLOCK - 1)
        own = np.arange(len(i))
        rest = rest - np.where(byte > 0, counts[own, byte - 1], 0)
        bit = PLACE[rows[own, byte], np.clip(rest, 0, 7)]
        return np.where(there, np.minimum(block * (8 * Bits.BLOCK) + byte * 8 + bit, self.length), self.length)


#: Place of the i-th one (column) of a byte (row), from its highest bit; 8 where there is none.
PLACE = np.full((256, 8), 8, np.int64)
for _byte in range(256):
    _ones = [b for b in range(8) if _byte >> (7 - b) & 1]
    PLACE[_byte, : len(_ones)] = _ones


class EliasFano:
    """A non-decreasing sequence of numbers: low bits side by side in whole bytes, high bits in unary, read in place."""

    @staticmethod
    def build(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        width = min(7, max(0, round((math.log2(universe / n) - 1) / 8))) if n and universe > n else 0
        values = values.astype("<u8")
        lows = values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        ones = (values >> np.uint64(8 * width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return np.array([n, width], "<i8").tobytes() + lows + Bits.build(unary)

    def __init__(self, data: memoryview):
        self.n, self.width = np.frombuffer(data[:16], "<i8").tolist()
        at = 16 + self.n * self.width
        self.lows = np.frombuffer(data[16:at], np.uint8).reshape(self.n, self.width)
        self.high = Bits(data[at:])
        self.size = at + self.high.size

    def low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), 8), np.uint8)
        out[:, : self.width] = self.lows[i]
        return out.view("<u8").ravel()

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i."""
        return ((self.high.select(i, True) - i).astype(np.uint64) << np.uint64(8 * self.width)) | self.low(i)

    def find(self, wanted: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The place in start..stop of each wanted value, -1 where it is not. Two zeros of the unary bits bound the
        places with its high part; among these low bits decide."""
        high, low = (wanted >> np.uint64(8 * self.width)).astype(np.int64), wanted & np.uint64((1 << 8 * self.width) - 1)
        first = np.where(high > 0, self.high.select(np.maximum(high - 1, 0), False) - high + 1, 0)
        start = np.maximum(start, first)
        stop = np.minimum(stop, self.high.select(high, False) - high)
        last = stop.copy()
        open_ = np.flatnonzero(start < stop)
        while open_.size:
            middle = (start[open_] + stop[open_]) >> 1
            below = self.low(middle) < low[open_]
            start[open_[below]] = middle[below] + 1
            stop[open_[~below]] = middle[~below]
            open_ = open_[start[open_] < stop[open_]]
        out = np.full(len(wanted), -1, np.int64)
        inside = np.flatnonzero(start < last)
        hit = inside[self.low(start[inside]) == low[inside]]
        out[hit] = start[hit]
        return out


def build_trie(contexts: np.ndarray, totals: np.ndarray, runs: np.ndarray, successors: np.ndarray, counts: np.ndarray) -> bytes:
    """The levels of one shard: sorted contexts, monotone pointers to their successors, these relative to their
    context, a code of one byte for each pair's smoothed probability, and the sum of the stored ones of each context."""
    pointers = np.concatenate(([0], np.cumsum(runs))).astype(np.uint64)
    relative = (np.repeat(np.arange(len(contexts), dtype=np.uint64), runs) << np.uint64(40)) + successors
    codes = codes_of((counts - DISCOUNT) / np.repeat(totals, runs))
    masses = np.add.reduceat(VALUES[codes], pointers[:-1].astype(np.int64)) if len(contexts) else np.zeros(0)
    parts = [EliasFano.build(contexts, 1 << 64), EliasFano.build(pointers, len(successors) + 1), EliasFano.build(relative, max(1, len(contexts)) << 40), masses.tobytes(), codes.tobytes()]
    return b"".join(parts)


class Trie:
    """A shard's levels, read in place from a buffer or from a memory-mapped file."""

    def __init__(self, levels: bytes | memoryview):
        data, parts, at = memoryview(levels), [], 0
        for _ in range(3):
            parts.append(EliasFano(data[at:]))
            at += parts[-1].size
        self.contexts, self.pointers, self.relative = parts
        self.masses = np.frombuffer(data[at : at + 8 * self.contexts.n], "<f8")
        self.codes = np.frombuffer(data[at + 8 * self.contexts.n :], np.uint8)

    @classmethod
    def open(cls, path: str) -> Trie:
        """The levels in a file, mapped: pages are read as searches come to them."""
        with open(path, "rb") as f:
            return cls(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))

    def find(self, contexts: np.ndarray, runs: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each asked pair, 0 where there is none, and the stored mass of each asked context."""
        out, mass = np.zeros(len(successors), np.uint8), np.zeros(len(contexts))
        if not self.contexts.n or not len(contexts):
            return out, mass
        rank = self.contexts.find(contexts, np.zeros(len(contexts), np.int64), np.full(len(contexts), self.contexts.n))
        there = np.flatnonzero(rank >= 0)
        start, stop = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        start[there], stop[there] = self.pointers.get(rank[there]).astype(np.int64), self.pointers.get(rank[there] + 1).astype(np.int64)
        mass[there] = self.masses[rank[there]]
        asked = np.flatnonzero(np.repeat(rank >= 0, runs))
        wanted = (np.repeat(np.maximum(rank, 0).astype(np.uint64), runs)[asked] << np.uint64(40)) + successors[asked]
        place = self.relative.find(wanted, np.repeat(start, runs)[asked], np.repeat(stop, runs)[asked])
        out[asked[place >= 0]] = self.codes[place[place >= 0]]
        return out, mass


def is_held_out(doc_id: int | None, folds: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0


class Chunk:
    """Tokens of one chunk: places in ``hashes``, where the end token and the start context come after the words."""

    def __init__(self, rows: pa.Table, folds: int, shards: int):
        self.ids = rows.column("doc_id").to_pylist()
        self.held = np.array([is_held_out(i, folds) for i in self.ids], bool)
        words = tokens.words(rows.column("text"), lower=True)
        known = tokens.hashes(words.dictionary)[0]
        self.hashes = np.concatenate((known, [END, BEGIN])).astype(np.uint64)
        sizes = np.diff(words.starts)
        self.starts = words.starts + np.arange(len(sizes) + 1)
        self.tokens = np.full(len(words.codes) + len(sizes), len(known), np.int32)
        inner = np.ones(len(self.tokens), bool)
        inner[self.starts[1:] - 1] = False
        self.tokens[inner] = words.codes
        self.learned = np.repeat(~self.held, sizes + 1)
        self.shards = shards
        self.mixed = tokens.mix(self.hashes)
        self.word_shard = (self.mixed % np.uint64(shards)).astype(np.int64)
        self.words = np.lexsort((self.hashes[:-1], self.word_shard[:-1]))  # words and the end token by shard and hash

    def counted(self, chunk: int) -> pa.Table:
        """What each shard gets of this chunk: its words with their counts in training texts."""
        counts = np.bincount(self.tokens[self.learned], minlength=len(self.hashes))[self.words]
        edges = np.searchsorted(self.word_shard[self.words], np.arange(self.shards + 1))
        return table_of([(s, chunk, pack(self.hashes[self.words[a:b]]), pack(counts[a:b].astype(np.uint32))) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b], WORDS)

    def told(self, answers: pa.Table) -> None:
        """Takes in the counts over all texts, and from them how far each context is split."""
        known, total, shard, values = (answers.column(c) for c in ("known", "total", "shard", "values"))
        self.different, self.total = sum(known.to_pylist()), sum(total.to_pylist())
        self.count = np.zeros(len(self.hashes), np.int64)
        self.count[self.words] = np.concatenate([unpack(values[int(i)].as_py(), "<i8") for i in np.argsort(shard.to_numpy())])
        self.count[-1] = self.count[-2]  # every text learned has one start and one end
        self.salts = 1 + self.count * self.shards * SPLIT // max(1, self.total)

    def pair(self) -> None:
        """Different pairs that a trie may hold, by shard, context and successor, and where each context's run begins.
        A context that is split is asked for in all of its shards, for its mass."""
        n = len(self.hashes)
        context = np.empty(len(self.tokens), np.int64)
        context[1:] = self.tokens[:-1]
        context[self.starts[:-1]] = n - 1
        self.context = context.astype(np.int32)
        context *= n
        context += self.tokens
        pair, of = np.unique(context, return_inverse=True)
        self.pair_of = of.astype(np.int32)
        head, tail = (pair // n).astype(np.int32), (pair % n).astype(np.int32)
        del context, pair, of
        self.asked = np.flatnonzero((self.count[head] > 0) & (self.count[tail] > 0))
        head, tail = head[self.asked], tail[self.asked]
        salt = ((self.mixed[tail] >> np.uint64(8)) % self.salts[head].astype(np.uint64)).astype(np.int64)
        seen = np.unique(head)
        split = seen[self.salts[seen] > 1]
        extra_head = np.repeat(split, self.salts[split]).astype(np.int32)
        extra_salt = np.arange(len(extra_head)) - np.repeat(np.cumsum(self.salts[split]) - self.salts[split], self.salts[split])
        heads, salts = np.concatenate((head, extra_head)), np.concatenate((salt, extra_salt))
        shard = (tokens.mix(self.hashes[heads] + salts.astype(np.uint64)) % np.uint64(self.shards)).astype(np.int32)
        print40 = self.hashes >> PRINT
        # an entry without a successor comes first in its run
        follow = np.concatenate((print40[tail] + np.uint64(1), np.zeros(len(extra_head), np.uint64)))
        order = np.lexsort((follow, self.hashes[heads], shard))
        self.follow, self.heads, self.pair_shard = follow[order], heads[order], shard[order]
        self.entry = order  # below len(asked): a pair; else a context alone
        change = np.ones(len(order), bool)
        change[1:] = (self.pair_shard[1:] != self.pair_shard[:-1]) | (self.heads[1:] != self.heads[:-1])
        self.first = np.flatnonzero(change)

    def asking(self, chunk: int) -> pa.Table:
        """What each shard of tries gets of this chunk: pairs by context with counts, contexts with counts of all texts."""
        times = np.zeros(len(self.entry), np.int64)
        real = self.entry < len(self.asked)
        times[real] = np.bincount(self.pair_of[self.learned], minlength=int(self.pair_of.max(initial=-1)) + 1)[self.asked[self.entry[real]]]
        runs = np.add.reduceat(real.astype(np.int64), self.first) if len(self.first) else np.zeros(0, np.int64)
        edges = np.searchsorted(self.pair_shard, np.arange(self.shards + 1))
        by_run = np.searchsorted(self.first, edges)
        out = []
        for s in range(self.shards):
            a, b, c, d = edges[s], edges[s + 1], by_run[s], by_run[s + 1]
            if a < b:
                heads, mine = self.heads[self.first[c:d]], times[a:b][real[a:b]]
                more = np.flatnonzero(mine >= 255).astype(np.uint32)
                counts = np.array([len(more)], "<u4").tobytes() + pack(more) + pack(mine[more].astype(np.uint32)) + np.minimum(mine, 255).astype(np.uint8).tobytes()
                out.append((s, chunk, pack(self.hashes[heads]), pack(self.count[heads]), pack(runs[c:d].astype(np.uint32)), pack40(self.follow[a:b][real[a:b]] - np.uint64(1)), counts))
        return table_of(out, PAIRS)

    def scored(self, answers: pa.Table) -> pa.Table:
        """RESULT of each text, from the codes of its pairs and the mass of its contexts."""
        order = np.argsort(answers.column("shard").to_numpy())
        values, sums = answers.column("values"), answers.column("sums")
        codes = np.zeros(int(self.pair_of.max(initial=-1)) + 1, np.uint8)
        mass = np.zeros(len(self.hashes))
        if len(order):
            real = self.entry < len(self.asked)
            codes[self.asked[self.entry[real]]] = np.concatenate([unpack(values[int(i)].as_py(), "u1") for i in order])
            np.add.at(mass, self.heads[self.first], np.concatenate([unpack(sums[int(i)].as_py(), "<f8") for i in order]))
        share = (self.count + 0.1) / (self.total + 0.1 * (self.different + 1))
        p = VALUES[codes[self.pair_of]] + (1.0 - mass)[self.context] * share[self.tokens]
        by_text = lambda x: np.add.reduceat(x, self.starts[:-1])
        known = by_text((self.count[self.tokens] > 0).astype(np.int64))
        return pa.table([pa.array(self.ids, pa.int64()), pa.array(self.held), pa.array(np.diff(self.starts)), pa.array(known), pa.array(np.full(len(self.ids), self.total, np.int64)), pa.array(by_text(np.log10(share)[self.tokens])), pa.array(by_text(np.log10(p)))], names=[x.split(" ")[0] for x in RESULT.split(", ")])


def buffers(column: pa.ChunkedArray) -> list[pa.Buffer]:
    """The values of a binary column without a copy."""
    return [x.as_buffer() for x in column]


def word_counts(rows: pa.Table, chunks: int) -> pa.Table:
    """A shard's answers to every chunk: counts of its words over all texts."""
    keys, counts, chunk = buffers(rows.column("keys")), buffers(rows.column("counts")), rows.column("chunk").to_pylist()
    different, place = np.unique(np.concatenate([unpack(x, "<u8") for x in keys]), return_inverse=True)
    summed = np.bincount(place, np.concatenate([unpack(x, "<u4") for x in counts]), len(different)).astype(np.int64)
    known, total, shard = int((summed > 0).sum()), int(summed.sum()), rows.column("shard")[0].as_py()
    edges = np.cumsum([0] + [len(x) // 8 for x in keys])
    found = {c: pack(summed[place[a:b]]) for c, a, b in zip(chunk, edges, edges[1:], strict=False)}
    return table_of([(c, 0, shard, known, total, found.get(c, b""), None) for c in range(chunks)], COUNTED)


def pair_counts(data: pa.Buffer) -> np.ndarray:
    n = int(np.frombuffer(data[:4], "<u4")[0])
    more, large = np.frombuffer(data[4 : 4 + 4 * n], "<u4"), np.frombuffer(data[4 + 4 * n : 4 + 8 * n], "<u4")
    out = np.frombuffer(data[4 + 8 * n :], np.uint8).astype(np.uint32)
    out[more] = large
    return out


def merged_pairs(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Contexts, their counts, runs, successors and summed counts of the learned pairs of all chunks."""
    head, total, tail, counts = [], [], [], []
    for k, t, r, n, c in zip(*[buffers(rows.column(x)) for x in ("keys", "totals", "runs", "next", "counts")], strict=True):
        runs, number = unpack(r, "<u4"), pair_counts(c)
        learned = number > 0
        head.append(np.repeat(unpack(k, "<u8"), runs)[learned])
        total.append(np.repeat(unpack(t, "<i8"), runs)[learned])
        tail.append(unpack40(n)[learned])
        counts.append(number[learned])
    head, total, tail, counts = (np.concatenate(x) for x in (head, total, tail, counts))
    order = np.lexsort((tail, head))
    head, tail = head[order], tail[order]
    new = np.ones(len(head), bool)
    new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
    first = np.flatnonzero(new)
    summed = np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    head, tail, total = head[first], tail[first], total[order[first]]
    start = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1]))) if len(head) else np.zeros(0, np.int64)
    return head[start], total[start], np.diff(np.append(start, len(head))), tail, summed


def answered(rows: pa.Table) -> pa.Table:
    """A shard's answers to the chunks that asked it, one after another: codes of pairs, mass of contexts."""
    trie, out = Trie(build_trie(*merged_pairs(rows))), []
    shard = rows.column("shard")[0].as_py()
    for chunk, k, r, n in zip(rows.column("chunk").to_pylist(), *[buffers(rows.column(x)) for x in ("keys", "runs", "next")], strict=True):
        codes, mass = trie.find(unpack(k, "<u8"), unpack(r, "<u4").astype(np.int64), unpack40(n))
        out.append((chunk, 1, shard, 0, 0, codes.tobytes(), mass.tobytes()))
    return table_of(out, COUNTED)


def asked_by(docs: DataFrame, folds: int, chunk_bytes: int, shard_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The placed texts, the answers on words and the questions on pairs."""
    size = text_bytes(docs)
    chunks, shards = chunk_count(size, chunk_bytes), chunk_count(size, shard_bytes)
    placed = with_chunk(docs, chunks)

    def count(t: pa.Table) -> pa.Table:
        return Chunk(t, folds, shards).counted(t.column("chunk")[0].as_py())

    def reply(t: pa.Table) -> pa.Table:
        return word_counts(t, chunks)

    def ask(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table_of([], PAIRS)
        chunk = Chunk(t, folds, shards)
        chunk.told(answers)
        chunk.pair()
        return chunk.asking(t.column("chunk")[0].as_py())

    words = placed.groupBy("chunk").applyInArrow(count, WORDS).groupBy("shard").applyInArrow(reply, COUNTED)
    return placed, words, placed.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(ask, PAIRS), shards


def model(docs: DataFrame, folds: int = 10, chunk_bytes: int = 10 << 20, shard_bytes: int = 6 << 20) -> DataFrame:
    """The trie of every shard, as bytes that Trie reads in place: to be written where a model is wanted as files."""

    def build(t: pa.Table) -> pa.Table:
        pairs = merged_pairs(t)
        return table_of([(t.column("shard")[0].as_py(), len(pairs[0]), len(pairs[3]), build_trie(*pairs))], LEVELS)

    return asked_by(docs, folds, chunk_bytes, shard_bytes)[2].groupBy("shard").applyInArrow(build, LEVELS)


def score(docs: DataFrame, folds: int = 10, chunk_bytes: int = 10 << 20, shard_bytes: int = 6 << 20) -> DataFrame:
    """RESULT of every document: learned from those whose crc32(doc_id as text) mod folds is not 0, scored on all.
    Texts are shuffled once, to their chunks; Spark uses that exchange for all three passes over them."""
    placed, words, pairs, shards = asked_by(docs, folds, chunk_bytes, shard_bytes)

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return RESULT_SCHEMA.empty_table()
        kind = answers.column("kind").to_numpy()
        chunk = Chunk(t, folds, shards)
        chunk.told(answers.filter(pa.array(kind == 0)))
        chunk.pair()
        return chunk.scored(answers.filter(pa.array(kind == 1)))

    answers = words.unionByName(pairs.groupBy("shard").applyInArrow(answered, COUNTED))
    return placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, RESULT)


RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
