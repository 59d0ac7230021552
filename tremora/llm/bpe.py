"""Byte-level BPE, encoded and decoded as the public tokenizers library does.

Nulls, ties and odd rows: a null text is the empty text (no token); very long words go through a heap instead of the
rank array; equal lowest ranks merge leftmost first; repeated rows are rows of their own; an empty table gives an empty
result; columns other than doc_id and text are not read. Special tokens written out in a text become their ids.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tremora.llm.common import bounded_batches, lean
from tremora.llm.tokens import portions

#: Fixed value: the pattern by which public byte-level vocabularies split a text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of more bytes take the heap: a scan of the rank array would cost the square of their length.
SHORT = 96
#: Bytes of text in work at a time.
PORTION = 2 << 20
NONE = 1 << 30
EMPTY, SPREAD = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pieces = {i: bytes(symbols[c] for c in t) if all(c in symbols for c in t) else t.encode() for t, i in vocab.items()}
        self.pieces |= {i: t.encode() for t, i in self.special.items()}
        self.single = np.zeros(256, np.int64)
        for c, b in symbols.items():
            self.single[b] = vocab[c]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))
        self.made = np.zeros(len(spec["model"]["merges"]), np.int64)  # the id that each rank makes
        for rank, made in self.merges.values():
            self.made[rank] = made
        self.table()
        self.pattern = regex.compile(SPLIT)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        top = max(self.pieces) + 1
        self.bytes_of = pa.array([self.pieces.get(i, b"") for i in range(top)], pa.large_binary())
        self.decimals = pa.array([str(i) for i in range(top)], pa.large_string())

    def table(self) -> None:
        """Ranks by pair in open addressing, so that a whole array of pairs is looked up at once."""
        bits = max(4, int(len(self.merges) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.ranks = np.full((1 << bits) + 64, EMPTY, np.uint64), np.full((1 << bits) + 64, NONE, np.int64)
        pairs = np.array(list(self.merges), np.uint64)
        for key, at, (rank, _) in zip(pairs, ((pairs * SPREAD) >> self.shift).tolist(), self.merges.values(), strict=True):
            while self.keys[at] != EMPTY:
                at += 1
            self.keys[at], self.ranks[at] = key, rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, NONE where there is none."""
        pairs = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = ((pairs * SPREAD) >> self.shift).astype(np.int64)
        found, out = self.keys[at], self.ranks[at]
        out[found != pairs] = NONE
        open_ = np.flatnonzero((found != pairs) & (found != EMPTY))
        while len(open_):
            at[open_] += 1
            found = self.keys[at[open_]]
            hit = found == pairs[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != EMPTY)]
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. Parts of all short words lie in one array, beside it the rank of each part with its right
        neighbour. A round takes the leftmost lowest rank of every word, deletes that boundary and refreshes the two
        neighbouring ranks; words without a rank leave."""
        out: list[list[int]] = [[]] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(size > SHORT):
            out[i] = self.merge_long(self.single[np.frombuffer(words[i], np.uint8)].tolist())
        live = np.flatnonzero((size > 0) & (size <= SHORT))
        if not len(live):
            return out
        ids, size = self.single[np.frombuffer(b"".join([words[i] for i in live]), np.uint8)], size[live]
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        ranks = np.full(len(ids), NONE, np.int64)
        ranks[:-1] = self.rank(ids[:-1], ids[1:])
        ranks[start + size - 1] = NONE
        while len(live):
            best = np.minimum.reduceat((ranks << np.int64(32)) | np.arange(len(ranks)), start)
            low = best >> np.int64(32)
            if (done := low == NONE).any():
                flat = ids.tolist()
                for i, a, n in zip(live[done].tolist(), start[done].tolist(), size[done].tolist(), strict=True):
                    out[i] = flat[a : a + n]
                kept = np.repeat(~done, size)
                ids, ranks, gone = ids[kept], ranks[kept], np.cumsum(np.where(done, size, 0))
                start, best, low = (start - gone)[~done], (best & np.int64(0xFFFFFFFF)) - gone, low[~done]
                live, size, best = live[~done], size[~done], best[~done]
                if not len(live):
                    break
            else:
                best &= np.int64(0xFFFFFFFF)
            ids[best] = self.made[low]
            ranks[best] = ranks[best + 1]
            boundary = np.ones(len(ids), bool)
            boundary[best + 1] = False
            ids, ranks = ids[boundary], ranks[boundary]
            shift = np.arange(len(start))
            start, best, size = start - shift, best - shift, size - 1
            at = best[best > start] - 1
            ranks[at] = self.rank(ids[at], ids[at + 1])
            at = best[best < start + size - 1]
            ranks[at] = self.rank(ids[at], ids[at + 1])
        return out

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges by a heap over a linked list: n log n for words of any length."""
        n, find = len(ids), self.merges.get
        after, ahead, live = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := find(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                ahead[after[j]] = i
            for k in (ahead[i], i):
                if k >= 0 and after[k] >= 0 and (m := find(ids[k] << 32 | ids[after[k]])):
                    heapq.heappush(heap, (m[0], k, ids[k], ids[after[k]], m[1]))
        return [x for x, alive in zip(ids, live, strict=True) if alive]

    def split(self, text: str) -> list[str | int]:
        """Words of a text before the merges; special tokens as their ids."""
        tail = text[-1:]
        if text[text[:1] == " " :].isalpha():
            return [text]
        if tail in ".,!" and tail and (head := text[:-1])[head[:1] == " " :].isalpha():
            return [head, tail]
        if not self.specials or not self.specials.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*self.pattern.findall(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where those of each text begin.

        A text is cut before each space: no token reaches over a single one. Each different stretch is split into
        words once, and each different word merged once. A text with a run of spaces is split as a whole."""
        plain = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = plain.flatten().dictionary_encode()
        part = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + 1
        part[np.concatenate(([0], np.cumsum(counts)[:-1]))[counts > 0]] -= 1  # even: the first of a text, no space before it
        odd = pc.match_substring(texts, "  ").to_numpy(zero_copy_only=False)
        for x in self.special:
            odd |= " " in x and pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        used = np.zeros(2 * len(coded.dictionary), bool)
        used[part[np.repeat(~odd, counts)]] = True
        keys, place = np.flatnonzero(used), np.cumsum(used) - 1
        known = coded.dictionary.take(pa.array(keys >> 1)).to_pylist()
        split = [self.split(x if first else " " + x) for x, first in zip(known, (keys & 1 == 0).tolist(), strict=True)]
        split += [self.split(x) for x in texts.filter(pa.array(odd)).to_pylist()]
        index: dict[str | int, int] = {}
        flat = [index.setdefault(w, len(index)) for x in split for w in x]
        ids = self.merge([w.encode() if type(w) is str else b"" for w in index])
        for w, i in index.items():
            if type(w) is int:
                ids[i] = [w]
        words = Ragged.of(ids)
        stretches = Ragged(np.array(flat, np.int64), Ragged.ends([len(x) for x in split])).map(words)
        stretch = np.empty(len(part), np.int64)
        stretch[:] = place[part]
        whole, at = np.repeat(odd, counts), Ragged.ends(counts)
        stretch[at[:-1][odd & (counts > 0)]] = len(keys) + np.arange(int((odd & (counts > 0)).sum()))
        whole[at[:-1][odd & (counts > 0)]] = False
        done = Ragged(stretch[~whole], Ragged.ends(np.where(odd, np.minimum(counts, 1), counts))).map(stretches)
        return done.values, done.at

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes of each text: the vocabulary's byte strings, one after another."""
        found = self.bytes_of.take(pa.array(ids))
        _, ends, data = found.buffers()
        ends, data = np.frombuffer(ends, np.int64)[: len(ids) + 1], memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in itertools.pairwise(ends[at].tolist())]

    def decimal(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The ids of each text in decimal, joined by commas."""
        lists = pa.LargeListArray.from_arrays(pa.array(at), self.decimals.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(",", pa.large_string())).to_pylist()


class Ragged(NamedTuple):
    """Lists of numbers, one after another: list i is values[at[i]:at[i + 1]]."""

    values: np.ndarray
    at: np.ndarray

    @staticmethod
    def ends(sizes) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64)))).astype(np.int64)

    @classmethod
    def of(cls, lists: list[list[int]]) -> Ragged:
        return cls(np.fromiter(itertools.chain.from_iterable(lists), np.int64), cls.ends([len(x) for x in lists]))

    def map(self, other: Ragged) -> Ragged:
        """Each number replaced by that list of the other."""
        sizes = (other.at[1:] - other.at[:-1])[self.values]
        ends = self.ends(sizes)
        from_ = np.repeat(other.at[self.values] - ends[:-1], sizes) + np.arange(ends[-1])
        return Ragged(other.values[from_], ends[self.at])


LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker, kept between tasks."""
    if path not in LOADED:
        LOADED[path] = Vocabulary(path)
    return LOADED[path]


def encode(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (null unless keep_ids), ids_sha256 (of the decimal ids joined by commas), decoded_sha256.

    A narrow map: no shuffle, and a batch of texts at a time in memory. The vocabulary file must lie at ``path`` on
    every machine, as installed packages do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, sha = vocabulary(path), hashlib.sha256
        for batch in batches:
            for part in portions(batch, PORTION):
                ids, at = vocab.encode(part.column("text").fill_null("").cast(pa.large_string()))
                named, back = vocab.decimal(ids, at), vocab.decode(ids, at)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())) if keep_ids else pa.nulls(part.num_rows, pa.list_(pa.int32()))
                coded = [sha(x.encode()).hexdigest() for x in named]
                decoded = [sha(y.decode("utf-8", "replace").encode()).hexdigest() for y in back]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), lists, pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
