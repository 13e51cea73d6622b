"""Media columns: interleaved sequences of text and media references, resolved by digest.

``interleave`` parses HTML into an ordered array of parts: text, or a media reference with its caption.
``store_media`` keeps payloads as 8-bit greyscale PNG images (64 samples a row, lossless) in a Parquet
table of the shared folder, ``read_media`` decodes the stored bytes and derives features, and ``resolve``
joins references to them by digest, so that positions and captions stay beside what they belong to.
Payload bytes are never shuffled: only digests and features are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import column_bytes, cut_lineage, map_batches, stable_columns, store_rows

ROW = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_PART = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
PARTS = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"
_SKIP = {"script", "style", "template", "noscript"}
_BREAK = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "figure", "blockquote", "ul", "ol", "table"}
_MEDIA = {"img", "video", "audio", "source", "embed"}


class _Parts(HTMLParser):
    """Collects parts. A figure's captions are held until it ends, then given to its media, wherever those stood in it;
    without media the caption is a text part in its place."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.words: list[str] = []
        self.skip = 0
        self.figure: int | None = None  # parts before the open figure
        self.captions: list[tuple[int, str]] = []  # of the open figure: parts before it, text
        self.in_caption = False

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text and self.in_caption:
            self.captions.append((len(self.parts), text))
        elif text:
            self.parts.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SKIP:
            self.skip += 1
        if self.skip:
            return
        if tag in _BREAK:
            self.flush()
        if tag == "figure":
            self.end_figure()
            self.figure = len(self.parts)
        elif tag == "figcaption":
            self.flush()
            self.in_caption = self.figure is not None  # outside a figure it is plain text
        elif tag in _MEDIA and (ref := dict(attrs).get("src")):
            self.flush()
            alt = dict(attrs).get("alt")
            self.parts.append({"kind": "media", "text": None, "ref": ref, "caption": alt or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and not self.skip:
            self.flush()
            self.in_caption = False
        elif tag == "figure" and not self.skip:
            self.end_figure()
        if tag in _BREAK and not self.skip:
            self.flush()

    def end_figure(self) -> None:
        self.flush()
        self.in_caption = False
        media = [p for p in self.parts[self.figure :] if p["kind"] == "media"] if self.figure is not None else []
        if media and self.captions:
            caption = " ".join(text for _, text in self.captions)
            for part in media:
                part["caption"] = caption
        else:
            for at, text in reversed(self.captions):
                self.parts.insert(at, {"kind": "text", "text": text, "ref": None, "caption": None})
        self.figure, self.captions = None, []

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.words.append(data)


def parse_parts(html: str) -> list[dict]:
    """Ordered parts of a page, numbered from 0; what a broken page holds before its end is kept. All text outside scripts,
    styles, templates and noscript stands in a text part or a caption; a caption takes the place of media's alternative text."""
    own = _Parts()
    own.feed(html)
    own.close()
    own.end_figure()
    return [{"pos": pos, **part} for pos, part in enumerate(own.parts)]


def interleave(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``parts``: text and media references in document order.

    Null and empty html have no parts; truncated, deeply nested and very long pages are read to their end; repeated rows
    stay; an empty table gives no rows. Other columns pass as they are (none may be called ``parts``)."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields] + [f"parts {PARTS}"])
    names = pages.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [parse_parts(raw.decode("utf-8", "replace")) for raw in column_bytes(batch, html)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(_PART))], [*names, "parts"])

    return map_batches(pages, step, schema)


def encode_samples(payload: bytes) -> bytes:
    """A greyscale PNG of ROW samples a row; the payload's length must be a positive multiple of ROW."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def decode_samples(media: bytes) -> np.ndarray:
    """Samples of an image that ``encode_samples`` made; a damaged one raises."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, width, height = 8, b"", 0, 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            body += data
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:]


def pad(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of ROW."""
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def store_media(documents: DataFrame) -> DataFrame:
    """(digest, n_bytes, media): each text's image under the SHA-256 of the text, written and read back."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_bytes(batch, "text")
            for first in range(0, len(texts), 256):
                part = texts[first : first + 256]
                arrays = [pa.array([hashlib.sha256(raw).hexdigest() for raw in part]), pa.array([len(raw) for raw in part], pa.int64()), pa.array([encode_samples(pad(raw)) for raw in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["digest", "n_bytes", "media"])

    return store_rows(map_batches(stable_columns(documents, "text"), step, "digest string, n_bytes long, media binary"), "media")


FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(stored: DataFrame) -> DataFrame:
    """Features of the stored bytes, a row per digest."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, n_bytes, media in zip(*[c.to_pylist() for c in batch.columns]):
                samples = decode_samples(media)
                payload = samples.tobytes()
                means = [samples[part].mean() if len(part) else 0.0 for part in np.array_split(np.arange(len(samples)), 4)]
                feature = f"{samples.shape[1]}x{samples.shape[0]};" + ",".join(f"{m:.3f}" for m in means) + f";{float(samples.std()):.3f}"
                out.append((digest, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*out)) if out else [[]] * 8
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in FEATURES.split(", ")])

    rows = map_batches(stored.select("digest", "n_bytes", "media"), step, FEATURES)
    return rows.groupBy("digest").agg(*[F.min(x.split()[0]).alias(x.split()[0]) for x in FEATURES.split(", ")[1:]])


def resolve(sequences: DataFrame, features: DataFrame, scheme: str = "media:") -> DataFrame:
    """A row per media part of ``sequences`` (with ``parts``) whose digest is known, beside its position,
    caption and features; ``resolve_sequences`` keeps text parts and unknown references too. A digest that many references share is split by the adaptive join: both sides
    are plain shuffles."""
    refs = sequences.select(*[c for c in sequences.columns if c not in ("parts", "html")], F.explode("parts").alias("part"))
    refs = refs.filter((F.col("part.kind") == "media") & F.col("part.ref").startswith(scheme))
    refs = refs.select(*[c for c in refs.columns if c != "part"], F.col("part.pos").alias("pos"), F.col("part.caption").alias("caption"), F.substring("part.ref", len(scheme) + 1, 64).alias("digest"))
    return refs.join(cut_lineage(features), "digest")


PAYLOAD = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def resolve_sequences(sequences: DataFrame, features: DataFrame, scheme: str = "media:") -> DataFrame:
    """``sequences`` with whole interleaved ``parts``: every text and media part in its place, media parts with
    their caption and ``payload``, a struct of the features of their digest (null where the digest is unknown or
    the reference has another scheme). Pages without parts keep an empty array.

    Only positions and digests are joined: a digest that many pages share is a plain shuffled join that adaptive
    execution splits, and what meets again for a page is bounded by that page.
    """
    pages = cut_lineage(sequences.withColumn("tidewell_uid", F.monotonically_increasing_id()))
    part = pages.select("tidewell_uid", F.explode("parts").alias("part")).filter((F.col("part.kind") == "media") & F.col("part.ref").startswith(scheme))
    refs = part.select("tidewell_uid", F.col("part.pos").alias("pos"), F.substring("part.ref", len(scheme) + 1, 64).alias("digest"))
    found = refs.join(cut_lineage(features), "digest").groupBy("tidewell_uid").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct(*PAYLOAD)))).alias("tidewell_found"))
    rows = pages.join(found, "tidewell_uid", "left")
    parts = F.transform("parts", lambda p: p.withField("payload", F.try_element_at("tidewell_found", p["pos"])))
    return rows.withColumn("parts", parts).drop("tidewell_uid", "tidewell_found")


def media_digests(documents: DataFrame) -> DataFrame:
    """Every document as a page with one figure: its text stored as media, found again by digest.

    Null text is stored as empty; empty text is one row of zero samples. Equal texts share one digest and
    all values; repeated rows stay repeated; null ids stay null. Texts of any length are one image. Extra
    columns are ignored, an empty table gives no rows.
    """
    own = stable_columns(documents, "doc_id", "text")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("without id"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    html = F.concat(F.lit("<article><p>Document "), name, F.lit('</p><figure><img src="media:'), digest, F.lit('"><figcaption>Text of document '), name, F.lit("</figcaption></figure></article>"))
    sequences = interleave(own.select("doc_id", html.alias("html")))
    return resolve(sequences, read_media(store_media(own))).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption"
    )
