"""Media columns: documents as sequences of text and media references (operator 10).

HTML is parsed into an ordered array of structs: texts, and references with the
digest they name and their caption (figcaption of the same figure, else alt).
Payloads are stored losslessly as 8-bit grey PNG and looked up by digest with a
join; payloads with the same digest are stored, read back and measured once.
Positions are places in the array, so captions and payloads stay aligned.

Defined cases: a null text is empty (its payload is one row of 255); null html
is an empty sequence; a caption that isn't closed ends with its figure or at the
next block, and is text where its figure holds no media; tags that don't match
are ignored; very long texts are one payload; references without a digest or with one that is not stored
keep null payload columns; repeated rows and null ids are kept; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swissline.llm.common import parallelism, table

WIDTH = 576
PAD = 255
_PNG = b"\x89PNG\r\n\x1a\n"
_BLOCKS = ("p", "div", "li", "td", "h1", "h2", "h3", "h4", "article", "section")
_MEDIA_TAGS = ("img", "video", "audio", "source")
_DIGEST = re.compile(r"(?:sha256[:/-]|media:)([0-9a-f]{64})")
SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,digest:string,caption:string>>"
STORED = "digest string, media binary"
RESOLVED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, samples string"


# ---------------------------------------------------------------- stored form
def payload_of(text: str | None) -> bytes:
    """UTF-8 filled with 255 to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a filter byte of 0 before each row
    lines[:, 1:] = rows
    out = [_PNG]
    for kind, data in ((b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes(), 1)), (b"IEND", b"")):
        out += [struct.pack(">I", len(data)), kind, data, struct.pack(">I", zlib.crc32(kind + data))]
    return b"".join(out)


def decode_png(media: bytes) -> bytes:
    """Samples of an 8-bit grey PNG with unfiltered rows, as encode_png stores them."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            w, h, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
            shape = h, w
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def sample_features(payload: bytes) -> str:
    """Figures of the samples, the same for equal payloads."""
    x = np.frombuffer(payload, np.uint8)
    count = np.bincount(x, minlength=256)
    p = count[count > 0] / len(x)
    edges = int((np.diff(x.astype(np.int16)) != 0).sum())
    return f"{WIDTH}x{len(x) // WIDTH} mean={x.mean():.4f} std={x.std():.4f} entropy={-(p * np.log2(p)).sum():.4f} levels={len(p)} edges={edges}"


# ---------------------------------------------------------------- pages
class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.buffer, self.hidden, self.figure, self.caption, self.early = [], [], 0, None, None, None

    def flush(self):
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "figure":
            self.end_figure()
        elif tag in _BLOCKS and "".join(self.caption or ()).strip():
            self.end_caption()
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figure":
            self.flush()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in _MEDIA_TAGS and (a.get("src") or a.get("data-digest")):
            self.flush()
            ref = a.get("src") or ""
            found = _DIGEST.search(a.get("data-digest") and "sha256:" + a["data-digest"] or ref)
            self.items.append({"kind": "media", "text": None, "ref": ref, "digest": found and found[1], "caption": a.get("alt")})
        elif tag not in ("a", "b", "i", "em", "strong", "span", "code", "sub", "sup", "small", "u"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" or tag in _BLOCKS and "".join(self.caption or ()).strip():
            self.end_caption()
        if tag == "figure":
            self.end_figure()
        if tag in _BLOCKS or tag == "figure":
            self.flush()

    def end_caption(self):
        """Gives an open caption to the media of its figure; before any it waits for them."""
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        if self.figure is None:
            self.buffer = [text]
            self.flush()
        elif text and not self.give(text):
            self.early = text

    def give(self, text):
        media = [x for x in self.items[self.figure :] if x["kind"] == "media"]
        for item in media:
            item["caption"] = text
        return bool(media)

    def end_figure(self):
        """What has waited for media is text where none came."""
        self.end_caption()
        self.flush()
        if self.early is not None and not self.give(self.early):
            self.buffer = [self.early]
            self.flush()
        self.figure = self.early = None

    def handle_data(self, data):
        if not self.hidden:
            (self.buffer if self.caption is None else self.caption).append(data)


def parse_page(page: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(page or "")
    p.close()
    p.end_figure()
    return [{"position": i, **x} for i, x in enumerate(p.items)]


def page_sequences(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """key, sequence: the ordered texts and references of each page."""
    kind = pages.schema[key].dataType.simpleString()
    fields = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "ref", "digest", "caption"))]))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [parse_page(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, fields)], [key, "sequence"])

    return pages.select(key, column).mapInArrow(run, f"{key} {kind}, sequence {SEQUENCE}")


def references(sequences: DataFrame, key: str) -> DataFrame:
    """One row for each reference, with its position, caption and the length of its sequence."""
    each = sequences.select(key, F.size("sequence").alias("n_items"), F.explode(F.filter("sequence", lambda x: x.kind == "media")).alias("m"))
    return each.select(key, "n_items", "m.position", "m.ref", "m.digest", "m.caption")


def resolve(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """Joins references with their stored payloads, read back and measured once a digest."""
    spark = refs.sparkSession

    def once(batches):
        seen = set()
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1)):
                if digest not in seen:
                    seen.add(digest)
                    media = media.as_py()
                    payload = decode_png(media)
                    rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), sample_features(payload)))
            if rows:
                names = [x.split()[0] for x in RESOLVED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    known = stored.repartition(max(2, parallelism(spark)), "digest").mapInArrow(once, RESOLVED)
    return refs.join(known, "digest", "left")


# ---------------------------------------------------------------- documents as media
def document_media(docs: DataFrame) -> DataFrame:
    """digest, media: the stored payload of each text, once for each digest of a task."""

    def run(batches):
        seen = set()
        for b in batches:
            rows, size = [], 0
            for text in b.column(0):
                payload = payload_of(text.as_py())
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in seen:
                    seen.add(digest)
                    rows.append((digest, encode_png(payload)))
                    size += len(rows[-1][1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["digest", "media"])
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["digest", "media"])

    return docs.select("text").mapInArrow(run, STORED)


def document_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, html: the text's paragraphs around a figure that refers to its payload."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sizes, pages = [], []
                for text in part.column(1).to_pylist():
                    payload, n = payload_of(text), len((text or "").encode())
                    head, *rest = (html_lib.escape(x, quote=False) for x in (text or "").split("\n"))
                    figure = f'<figure><img src="media:{hashlib.sha256(payload).hexdigest()}"><figcaption>{n} bytes in {len(payload) // WIDTH} rows</figcaption></figure>'
                    pages.append(f"<article><p>{head}</p>{figure}{''.join(f'<p>{x}</p>' for x in rest)}</article>")
                    sizes.append(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(pages)], ["doc_id", "n_bytes", "html"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, html string")


def op10_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pages = document_pages(docs).select(F.struct("doc_id", "n_bytes").alias("page"), "html")
    out = resolve(references(page_sequences(pages, "page"), "page"), document_media(docs))
    feature = F.concat_ws(" ", "samples", F.concat(F.lit("item="), "position"), F.concat(F.lit("of="), "n_items"), F.concat(F.lit("caption="), F.regexp_replace("caption", " ", "_")))
    return out.select("page.doc_id", "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
