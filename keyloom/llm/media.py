"""Media columns: interleaved sequences of text and media references, resolved by digest.

HTML parsing turns a page into an ordered array of structs, text or media reference, each with its position and a
reference with its caption.  A media table holds stored forms under their SHA-256.  References, parsed once, meet it by
digest: with what a reader gets from a stored form (size, digests, features), so that only small structs move, or with
the payload itself.  Positions and captions stay on the side of the page.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, staged
from .graph import counted, unique_join

#: A stored form is an 8-bit greyscale image of this width: header, then one byte a sample.
WIDTH = 64
_MEDIA_TAGS = frozenset(("img", "video", "audio", "source", "embed"))
_HIDDEN = frozenset(("script", "style", "template"))
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split())


def padded(text: Column) -> Column:
    """A text's payload: its UTF-8 bytes and zero bytes up to a positive multiple of WIDTH."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    fill = F.greatest(F.ceil(F.octet_length(raw) / WIDTH), F.lit(1)) * WIDTH - F.octet_length(raw)
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), fill.cast("int"))))


def stored(payload: Column) -> Column:
    """The stored form of a payload."""
    return F.concat(F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(payload) / WIDTH).cast("long").cast("string"), F.lit("\n255\n")).cast("binary"), payload)


def read_image(raw: bytes) -> np.ndarray:
    """A stored form's samples, one row for each line of the image; ValueError where it is none."""
    head = raw[:40].split(b"\n", 3)
    if len(head) < 4 or head[0] != b"P5" or head[2] != b"255":
        raise ValueError("not a stored image")
    width, height = map(int, head[1].split())
    samples = np.frombuffer(raw, np.uint8, offset=sum(map(len, head[:3])) + 3)
    if len(samples) != width * height:
        raise ValueError("samples are missing")
    return samples.reshape(height, width)


def describe(image: np.ndarray) -> str:
    """Features of an image: its size, mean, spread, edges along rows and columns, and the share of each sixteenth of the range."""
    flat = image.ravel()
    counts = np.bincount(flat, minlength=256)
    levels = np.arange(256)
    mean = counts @ levels / len(flat)
    spread = max(0.0, counts @ (levels * levels) / len(flat) - mean * mean) ** 0.5
    across = np.abs(np.diff(image.astype(np.int16), axis=1)).mean()
    down = np.abs(np.diff(image.astype(np.int16), axis=0)).mean() if len(image) > 1 else 0.0
    shares = ",".join(f"{x / len(flat):.4f}" for x in counts.reshape(16, 16).sum(1))
    return f"{image.shape[1]}x{image.shape[0]};{mean:.4f};{spread:.4f};{across:.4f};{down:.4f};{shares}"


_INFO = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("payload", pa.binary())])
_INFO_SQL = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, payload binary"


def read_media(media: DataFrame, payloads: bool = False) -> DataFrame:
    """Rows (digest, media) -> what each stored form holds, read back from its bytes, and with `payloads` the payload as well.

    Unreadable or null forms give nothing.
    """
    schema = _INFO if payloads else _INFO.remove(_INFO.get_field_index("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {name: [] for name in _INFO.names}
            for digest, cell in zip(rows.column("digest").to_pylist(), rows.column("media"), strict=True):
                raw = cell.as_py()
                try:
                    image = read_image(raw or b"")
                except ValueError:
                    continue
                payload = image.tobytes()
                found = digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), describe(image), payload if payloads else None
                for name, x in zip(_INFO.names, found, strict=True):
                    out[name].append(x)
            yield batch(out, schema)

    return media.select("digest", "media").mapInArrow(run, _INFO_SQL if payloads else _INFO_SQL.rpartition(",")[0])


class _Figure:
    """A figure that is open: its media items, the text items of its caption, and how many media came before that."""

    def __init__(self):
        self.media: list[dict] = []
        self.caption: list[dict] = []
        self.open = False
        self.seen: int | None = None


class _Page(HTMLParser):
    """Collects a page's items in their order.

    A caption's text is collected as text items, which go once the figure ends and has media to carry them; in a figure
    without media they stay.  A figure that the page never closes has the media before its caption, or else the first
    one, and of a caption that is never closed the text up to the next block.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.figures: list[_Figure] = []
        self.hidden: str | None = None
        self.depth = 0

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
            if self.figures and self.figures[-1].open:
                self.figures[-1].caption.append(self.items[-1])

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            self.depth += tag == self.hidden
            return
        if tag in _HIDDEN:
            self.hidden, self.depth = tag, 1
            return
        if tag in _BLOCKS or tag in _MEDIA_TAGS:
            self.flush()
        known = dict(attrs)
        if tag in _MEDIA_TAGS and known.get("src"):
            self.items.append({"kind": "media", "text": None, "ref": reference(known["src"]), "caption": known.get("alt")})
            if self.figures:
                self.figures[-1].media.append(self.items[-1])
        elif tag == "figure":
            self.figures.append(_Figure())
        elif tag == "figcaption" and self.figures:
            figure = self.figures[-1]
            figure.open, figure.seen = True, len(figure.media)

    def handle_endtag(self, tag):
        if self.hidden:
            self.depth -= tag == self.hidden
            if not self.depth:
                self.hidden = None
            return
        if tag in _BLOCKS:
            self.flush()
        if tag == "figcaption" and self.figures:
            self.figures[-1].open = False
        elif tag == "figure" and self.figures:
            self.finish(self.figures.pop(), True)

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)

    def finish(self, figure: _Figure, closed: bool) -> None:
        media = figure.media if closed else figure.media[: figure.seen] or figure.media[:1]
        parts = figure.caption[:1] if figure.open and not closed else figure.caption
        if media and parts:
            text = " ".join(x["text"] for x in parts)
            for item in media:
                item["caption"] = text
            for item in parts:
                item["kind"] = None

    def result(self) -> list[dict]:
        self.flush()
        while self.figures:
            self.finish(self.figures.pop(), False)
        return [{"position": k} | item for k, item in enumerate(x for x in self.items if x["kind"])]


def reference(src: str) -> str:
    """A media reference's key: the digest it names, the digest of data it carries, or else the address itself."""
    if src.startswith("data:") and ";base64," in src:
        try:
            return hashlib.sha256(base64.b64decode(src.partition(";base64,")[2])).hexdigest()
        except (binascii.Error, ValueError):
            return src
    return src.removeprefix("sha256:")


def parse_page(html: str | None) -> list[dict]:
    """A page -> its items (position, kind, text, ref, caption); a null or empty page has none."""
    page = _Page()
    page.feed(html or "")
    page.close()
    return page.result()


_ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
_ITEM_PA = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])


def items(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows (key, html) -> key and the ordered array `items`."""
    kind = pages.schema[key].dataType.simpleString()
    ids = pages.select(F.col(key).alias("id"), "html")
    schema = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal schema
        for rows in batches:
            schema = schema or pa.schema([("id", rows.schema.field("id").type), ("items", pa.list_(_ITEM_PA))])
            yield batch({"id": rows.column("id"), "items": [parse_page(x) for x in rows.column("html").to_pylist()]}, schema)

    return ids.mapInArrow(run, f"id {kind}, items array<{_ITEM}>").withColumnRenamed("id", key)


def resolve(references: DataFrame, media: DataFrame, payloads: bool = False) -> DataFrame:
    """References (with a column ref, written already) joined by digest with the media table (digest, media).

    The column `media` says what read_media gets from the stored form, with `payloads` the payload included.  Each digest
    is met once, however often it is stored; one that many references name is dealt out.  References without a stored
    form stay, with nulls.
    """
    info = read_media(media, payloads).groupBy("digest").agg(F.any_value(F.struct(*[n for n in _INFO.names[1:] if payloads or n != "payload"])).alias("media"))
    info = info.withColumnRenamed("digest", "ref")
    return unique_join(references, info if payloads else staged(info, "media"), "ref", counted(references.where(F.col("ref").isNotNull()), "ref"), how="left")


def interleave(pages: DataFrame, media: DataFrame, key: str = "page_id", payloads: bool = False) -> DataFrame:
    """Pages (key, html) and media (digest, media) -> one row per item: key, position, kind, text, ref, caption, media.

    Pages are parsed once.  Defined cases: a null or empty page has no items; a reference that no stored form answers
    keeps its position and caption with a null `media`; text items have a null `media`; repeated pages give their items
    again; other columns are ignored; empty tables give no rows.
    """
    one = items(pages, key).select(key, F.explode("items").alias("i")).select(key, "i.*")
    return resolve(staged(one, "items"), media, payloads)


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) as a page each that refers to the document's payload, interleaved with its stored form.

    -> doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.  The stored forms
    are written as a media table and read back from its files.  Defined cases: a null text is an empty one, whose payload
    is one line of zeros; a null doc_id stays null; rows that share a doc_id or a text are each described; other columns
    are ignored; an empty table gives no rows.
    """
    image = stored(padded(F.col("text")))
    page = F.concat(F.lit('<figure><img src="sha256:'), F.sha2("media", 256), F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit("</figcaption></figure>"))
    kept = staged(docs.select("doc_id", image.alias("media"), F.octet_length(F.coalesce(F.col("text"), F.lit(""))).alias("n_bytes")), "stored")
    pages = kept.select("doc_id", page.alias("html"))
    found = interleave(pages, kept.select(F.sha2("media", 256).alias("digest"), "media"), "doc_id").where(F.col("kind") == "media")
    return found.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), "media.*")
