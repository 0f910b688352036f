"""Media columns: pages as ordered sequences of text and media references.

A page's HTML is parsed into items in order of appearance: text, or a reference with its digest and caption. References
are joined by digest with the stored media, so each stored object is read and measured once, however many pages show
it; items keep their positions and captions.

Media are stored in a column of a Parquet table, as grey images of 8-bit samples, 64 a row: a short header, then the
samples. Payloads are padded with bytes 0 to a positive multiple of 64, which keeps them whole. What is measured is what
that table gives back.

Rows: a null page is empty and has no items; a reference whose digest isn't stored keeps its item with null media;
repeated pages keep a row each; null payloads count as empty; an empty table gives an empty one; only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import forget, ship, written

WIDTH = 64
ITEM = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
ITEM_ARROW = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
BLOCKS = {"p", "div", "section", "article", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "br", "hr", "header", "footer", "main", "nav", "body", "title"}
SILENT = {"script", "style", "noscript", "template"}
MEDIA = {"img", "video", "audio", "source"}


def to_image(payload: bytes) -> bytes:
    padded = payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))
    return b"P5\n%d %d\n255\n" % (WIDTH, len(padded) // WIDTH) + padded


def from_image(stored: bytes) -> bytes:
    magic, size, top, samples = stored.split(b"\n", 3)
    w, h = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(samples) != w * h:
        raise ValueError("not a stored image")
    return samples


def features(samples: bytes) -> str:
    """Mean, deviation, entropy in bits and the mean step between rows, in thousandths, from whole numbers as far as they go."""
    a = np.frombuffer(samples, np.uint8)
    n = np.bincount(a, minlength=256)
    level, size = np.arange(256), len(a)
    total, squares = int(n @ level), int(n @ (level * level))
    some = n[n > 0] / size
    rows = a.reshape(-1, WIDTH)
    step, pairs = int(np.abs(np.diff(rows.astype(np.int16), axis=0)).sum()), max(1, size - WIDTH)
    entropy = abs(float((some * np.log2(some)).sum()))
    return f"mean={(1000 * total + size // 2) // size};dev={round(1000 * math.sqrt(size * squares - total * total) / size)};entropy={round(1000 * entropy)};step={(1000 * step + pairs // 2) // pairs}"


class Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.words, self.quiet, self.figure, self.caption = [], [], 0, [], None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.quiet += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = []
        if tag == "figcaption":
            self.caption = []
        at = dict(attrs)
        src = at.get("src") or ""
        if tag in MEDIA and src:
            self.flush()
            item = {"position": len(self.items), "kind": "media", "text": None, "digest": src.removeprefix("sha256:") if src.startswith("sha256:") else hashlib.sha256(src.encode()).hexdigest(), "caption": at.get("alt")}
            self.items.append(item)
            self.figure.append(item)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.quiet = max(0, self.quiet - 1)
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.figure:
                item["caption"] = text or item["caption"]
            self.caption = None
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = []

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            (self.words if self.caption is None else self.caption).append(data)


def items(html: str | None) -> list[dict]:
    p = Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.items


def interleaved(pages: DataFrame) -> DataFrame:
    """pages (id, html) with items, the ordered sequence of each."""
    ship(pages.sparkSession)
    kind = pages.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([items(h) for h in b.column(1).to_pylist()], ITEM_ARROW)], names=["id", "items"])

    return pages.select("id", "html").mapInArrow(run, f"id {kind}, items {ITEM}")


def stored(media: DataFrame) -> DataFrame:
    """media (digest, payload) as a written table (digest, n_bytes, media) whose media column holds the stored form. Payloads
    stay in their tasks; each task stores a digest once, so that one which a third of all rows have costs a row a task."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            rows = []
            for digest, x in zip(b.column(0).to_pylist(), b.column(1)):
                if digest not in seen:
                    seen.add(digest)
                    payload = x.as_py() or b""
                    rows.append((digest, len(payload), to_image(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], names=["digest", "n_bytes", "media"])

    return written(media.select("digest", "payload").mapInArrow(run, "digest string, n_bytes long, media binary"), "media")


def measured(media: DataFrame) -> DataFrame:
    """media (digest, n_bytes, media), as read from where it is stored: what the stored bytes hold, one row per row."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(2):
                image = x.as_py()
                back = from_image(image)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), features(back)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("digest", "n_bytes", "media").mapInArrow(run, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolve(pages: DataFrame, media: DataFrame) -> DataFrame:
    """pages (id, html), media (digest, payload; repeated digests hold equal payloads): one row per item with what its
    digest resolves to. Media are stored, read back and measured where they lie; the join then moves small rows, and Spark
    can split a digest that a third of all pages show."""
    table = stored(media)
    known = written(measured(table).dropDuplicates(["digest"]), "measures")
    forget(table)
    refs = interleaved(pages).select("id", F.explode_outer("items").alias("item")).select("id", "item.*")
    return refs.join(known, "digest", "left")
