"""Media columns: documents as ordered text and media references, resolved by digest; lossless storage of payloads.

Nulls, ties and odd rows: a null text is the empty payload (one padded block); null HTML is a page without items; a
reference whose digest no payload has keeps its place with a null payload; equal payloads are stored and resolved by
one digest; repeated rows are pages of their own; empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import written
from tremora.llm.tokens import portions

SIDE = 576
PORTION = 8 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<position int, kind string, text string, digest string, caption string>"


def padded(data: bytes, unit: int = SIDE) -> bytes:
    """data with bytes 255 up to a positive multiple of unit."""
    return data + b"\xff" * (unit - len(data) % unit if len(data) % unit or not data else 0)


def png_encode(payload: bytes, width: int = SIDE, level: int = 6) -> bytes:
    """8-bit grey samples, width to a row, as a PNG: lossless."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # a filter byte 0 before each row
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def png_decode(stored: bytes) -> bytes:
    """The samples of a PNG that png_encode wrote; raises if it is damaged."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], (0, 0)
    while at < len(stored):
        size, kind = struct.unpack_from(">I4s", stored, at)
        body, crc = stored[at + 8 : at + 8 + size], stored[at + 8 + size : at + 12 + size]
        if struct.unpack(">I", crc)[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    return lines[:, 1:].tobytes()


class Items(HTMLParser):
    """Text and media references of a page in reading order. A figure's caption, before or after, belongs to all of its
    media; an image without one has its alt text. The caption of a figure without media is text, and so is one outside
    a figure. Scripts and styles are no text; templates and noscript parts are none if they are closed."""

    BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "nav", "figure", "figcaption", "blockquote", "pre", "title", "body", "head", "header", "footer"}
    SILENT = {"script", "style", "template", "noscript"}
    MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source"}

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.buffer: list[str] = []
        self.closings = {x: len(re.findall(f"</{x}", html, re.IGNORECASE)) for x in ("template", "noscript")}
        self.silent: list[str] = []
        self.figures: list[tuple[list[dict], list[str]]] = []  # media and caption of each open figure
        self.captioning = False

    def flush(self) -> None:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", "".join(self.buffer)).strip(" ")
        self.buffer = []
        if not text:
            return
        if self.captioning:
            self.figures[-1][1].append(text)
        else:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def close_figure(self, ended: bool = True) -> None:
        """Gives the innermost figure's caption to its media. A caption that nothing ended, in a figure that nothing
        ended, is its first stretch alone: the rest is text."""
        self.flush()
        media, caption = self.figures.pop()
        rest = caption if not media else [] if ended or not self.captioning else caption[1:]
        caption = caption if ended or not self.captioning else caption[:1]
        self.captioning = False
        for item in media:
            item["caption"] = " ".join(caption) or item["caption"]
        self.items += [{"kind": "text", "text": x, "digest": None, "caption": None} for x in rest]

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT and self.closings.get(tag, 1) > 0:
            self.silent.append(tag)
        if self.silent:
            return
        if tag in self.BREAKS or tag in self.MEDIA:
            self.flush()
        if tag == "figure":
            self.captioning = False
            self.figures.append(([], []))
        elif tag == "figcaption":
            self.captioning = bool(self.figures)
        elif tag in self.MEDIA:
            given = dict(attrs)
            place = given.get("src") or ""
            item = {"kind": self.MEDIA[tag], "text": place, "digest": place.removeprefix("sha256:") if place.startswith("sha256:") else None, "caption": given.get("alt")}
            self.items.append(item)
            if self.figures:
                self.figures[-1][0].append(item)

    def handle_startendtag(self, tag, attrs):
        if tag not in self.SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.closings:
            self.closings[tag] -= 1
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass
            return
        if self.silent:
            return
        if tag in self.BREAKS:
            self.flush()
        if tag == "figcaption":
            self.captioning = False
        elif tag == "figure" and self.figures:
            self.close_figure()

    def handle_data(self, data):
        if not self.silent:
            self.buffer.append(data)


def page_items(html: str | None) -> list[dict]:
    """The items of one page, numbered from 0."""
    parser = Items(html or "")
    parser.feed(html or "")
    parser.close()
    parser.flush()
    while parser.figures:
        parser.close_figure(ended=False)
    return [{"position": i} | x for i, x in enumerate(parser.items)]


def sequences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key and items: each page's ordered text and media-reference structs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            for part in portions(batch, PORTION, "html"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([page_items(x.as_py()) for x in part.column("html")], kind)], names=[key, "items"])

    rows = pages.select(F.col(key).cast("long").alias(key), "html")
    return rows.mapInArrow(run, f"{key} long, items array<{ITEM}>")


def interleave(pages: DataFrame, media: DataFrame, key: str = "page_id") -> DataFrame:
    """key and items: each page's sequence with ``media``, a struct of the other columns of the media table, resolved
    by digest. key must tell pages apart. The media table has one row a digest, so a digest that a third of all
    references name adds no rows and Spark splits its side of the join; text items take no part in it."""
    resolved = F.struct(*[F.col(c) for c in media.columns if c != "digest"])
    items = sequences(pages, key)
    asked = items.select(key, F.explode("items").alias("item")).filter(F.col("item.digest").isNotNull()).select(key, F.col("item.position").alias("position"), F.col("item.digest").alias("digest"))
    found = asked.join(media.select("digest", resolved.alias("media")), "digest").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("position", "media"))).alias("found"))
    whole = F.transform("items", lambda x: F.struct(x["position"].alias("position"), x["kind"].alias("kind"), x["text"].alias("text"), x["digest"].alias("digest"), x["caption"].alias("caption"), F.try_element_at(F.col("found"), x["position"]).alias("media")))
    return items.join(found, key, "left").select(key, whole.alias("items"))


def page_summary(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, n_text, n_media, n_captions and items_sha256 (of kind and text of all items, a line each) of every page."""
    items = sequences(pages, key)
    kind = lambda k: F.size(F.filter("items", lambda x: (x["kind"] == "text") == F.lit(k)))
    lines = F.array_join(F.transform("items", lambda x: F.concat(x["kind"], F.lit(" "), x["text"])), "\n")
    captions = F.size(F.filter("items", lambda x: x["caption"].isNotNull()))
    return items.select(key, kind(True).alias("n_text"), kind(False).alias("n_media"), captions.alias("n_captions"), F.sha2(lines.cast("binary"), 256).alias("items_sha256"))


def stored_documents(docs: DataFrame) -> DataFrame:
    """page_id, doc_id, n_bytes, html and media of every text: a page with one figure that names its payload by digest.
    media, the PNG, is null where the same task has stored that digest before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in portions(batch, PORTION):
                rows = []
                for key, doc, text in zip(*[part.column(c).to_pylist() for c in ("page_id", "doc_id", "text")], strict=True):
                    data = (text or "").encode()
                    payload = padded(data)
                    digest = hashlib.sha256(payload)
                    png = None if digest.digest() in seen else png_encode(payload)
                    if len(seen) < 1_000_000:  # beyond that a copy may be stored twice
                        seen.add(digest.digest())
                    caption = escape(f"document {doc}, {len(data)} bytes")
                    rows.append((key, doc, len(data), f'<article><h1>{caption}</h1><figure><img src="sha256:{digest.hexdigest()}"><figcaption>{caption}</figcaption></figure></article>', digest.hexdigest(), png))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "doc_id", "n_bytes", "html", "digest", "media"])

    rows = docs.select(F.monotonically_increasing_id().alias("page_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "page_id long, doc_id long, n_bytes long, html string, digest string, media binary")


def feature_text(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the eight commonest with their counts."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float((np.arange(256) * counts).sum()) / len(samples)
    spread = float((((np.arange(256) - mean) ** 2) * counts).sum() / len(samples)) ** 0.5
    top = np.lexsort((np.arange(256), -counts))[:8]
    return f"mean={mean:.6f};sd={spread:.6f};entropy={float(-(share * np.log2(share)).sum()):.6f};top=" + ",".join(f"{i}:{counts[i]}" for i in top.tolist())


def media_features(media: DataFrame) -> DataFrame:
    """One row a digest: sizes, hashes and features of the payload as read back from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, cell in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
                stored = cell.as_py()
                payload = png_decode(stored)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_text(payload)))
            if rows:
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = media.filter(F.col("media").isNotNull()).select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in rows.columns[1:]])


def document_media(docs: DataFrame) -> DataFrame:
    """The digest columns of every document: payloads stored once as PNG in a table of the shared folder, read back,
    and resolved through the interleaved sequences of pages that name them."""
    stored = written(stored_documents(docs), "media")
    pages = interleave(stored.select("page_id", "html"), media_features(stored))
    figure = F.element_at(F.filter("items", lambda x: x["digest"].isNotNull()), 1)
    got = stored.select("page_id", "doc_id", "n_bytes").join(pages.select("page_id", figure.alias("figure")), "page_id")
    fields = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return got.select("doc_id", "n_bytes", *[F.col(f"figure.media.{c}").alias(c) for c in fields], F.col("figure.caption").alias("caption"), F.col("figure.position").alias("position"))
