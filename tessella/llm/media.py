"""Media columns: interleaved document sequences.

HTML is parsed into the ordered sequence of a document: text structs and media-reference structs, each with its position, the
references with digest and caption. Payloads are stored once per digest in a media table, as lossless 8-bit grey PNG images of 64
samples a row, and references are resolved by a join on the digest. What is computed from a payload is computed once
per stored payload from the bytes read back, before the join, so a payload with many references is neither copied nor decoded again.

Null text or html: empty. Broken markup is read as far as the parser gets; a size that is no whole number of at most 18 digits is null. An empty payload is padded to 64 zero bytes. A reference without stored payload keeps its place with null media columns.
Equal payloads share one stored form. A text of any length is one payload, stored and described whole. Repeated rows stay; extra columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import LenientParser, map_rows, read, table

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEDIA_TAGS = frozenset(("img", "audio", "video", "source"))
BLOCK_TAGS = frozenset("p div h1 h2 h3 h4 h5 h6 li tr td th article section blockquote pre table ul ol figure br hr header footer main aside nav".split())


def padded(payload: bytes, unit: int = WIDTH) -> bytes:
    return payload + bytes(-len(payload) % unit if payload else unit)


def encode_png(samples: bytes, level: int = 6) -> bytes:
    """8-bit grey samples, WIDTH to a row, as a PNG with filter 0."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + chunk(b"IEND", b"")


def decode_png(png: bytes) -> bytes:
    """The samples of what encode_png() made; chunk sums are checked."""
    if not png.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, data, width = len(_SIGNATURE), [], 0
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, _, depth, colour, _, _, _ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Size, mean, spread, a histogram of 16 levels and a hash of the columns that are brighter than the mean."""
    a = np.frombuffer(samples, np.uint8)
    columns = a.reshape(-1, WIDTH).sum(0, dtype=np.int64)
    bits = int.from_bytes(np.packbits(columns * WIDTH > int(columns.sum())).tobytes(), "big")
    levels = np.bincount(a >> 4, minlength=16)
    squares = int(np.dot(levels_all := np.bincount(a, minlength=256), np.arange(256, dtype=np.int64) ** 2))
    mean = int(np.dot(levels_all, np.arange(256))) / len(a)
    return f"{WIDTH}x{len(a) // WIDTH};mean={mean:.4f};sd={max(0.0, squares / len(a) - mean * mean) ** 0.5:.4f};levels={'.'.join(map(str, levels.tolist()))};columns={bits:016x}"


class SequenceParser(LenientParser):
    """Items (kind, text, digest, caption, n_bytes) in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.parts: list[str] = []
        self.skip, self.figure, self.in_caption = 0, None, False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text and self.in_caption and self.figure is not None:
            for i in self.items[self.figure :]:
                if i[0] == "media":
                    i[3] = text
        elif text:
            self.items.append(["text", text, None, None, None])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in MEDIA_TAGS and a.get("src"):
            self.flush()
            src, n = a["src"], a.get("data-bytes") or ""
            self.items.append(["media", None, src.removeprefix("sha256:"), a.get("alt"), int(n) if n.isascii() and n.isdecimal() and len(n) < 19 else None])
        elif tag == "figcaption":
            self.flush()
            self.in_caption = True
        elif tag in BLOCK_TAGS:
            self.flush()
            if tag == "figure":
                self.figure = len(self.items)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self.flush()
            self.in_caption = False
        elif tag in BLOCK_TAGS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)


def sequence(html: str | None) -> list[list]:
    p = SequenceParser()
    p.read(html or "")
    p.flush()
    return p.items


def parse_sequences(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per item: (key, position, kind, text, digest, caption, n_bytes)."""

    def work(batches: Iterator[list[list]]):
        for keys, pages in batches:
            rows = [(k, at, *item) for k, page in zip(keys, pages, strict=True) for at, item in enumerate(sequence(page))]
            if rows:
                yield [list(c) for c in zip(*rows, strict=True)]

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df, [key, html], work, f"`{key}` {kind}, position int, kind string, text string, digest string, caption string, n_bytes long")


def store_media(df: DataFrame, payload: str = "text") -> DataFrame:
    """The media table (digest, media) of a column of payloads, one row per digest, written to the shared folder and read from there."""

    def work(batches: Iterator[list]):
        for (values,) in batches:
            done: dict[str, bytes] = {}
            for v in values.cast("binary").to_pylist():
                data = padded(v or b"")
                if (digest := hashlib.sha256(data).hexdigest()) not in done:
                    done[digest] = encode_png(data)
            yield [list(done), list(done.values())]

    return table(map_rows(df, [payload], work, "digest string, media binary", arrow=True).dropDuplicates(["digest"]), "media")


def media_features(media: DataFrame) -> DataFrame:
    """From the stored bytes: (digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""

    def work(batches: Iterator[list[list]]):
        for digests, stored in batches:
            rows = []
            for d, m in zip(digests, stored, strict=True):
                s = decode_png(m)
                rows.append((d, len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(s)))
            yield [list(c) for c in zip(*rows, strict=True)]

    return map_rows(media, ["digest", "media"], work, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """Each item with what the media table (or its features) holds for its digest. Text items don't take part in the join."""
    refs, texts = sequences.where(F.col("kind") == "media"), sequences.where(F.col("kind") != "media")
    return refs.join(media, "digest", "left").unionByName(texts, allowMissingColumns=True)


def payload_digest(text: str) -> Column:
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(data)
    pad = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.sha2(F.concat(data, F.unhex(F.repeat(F.lit("00"), pad))), 256)


def illustrated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A small page for each document, whose figure refers to the document's payload by digest."""
    name, n = F.coalesce(F.col(key).cast("string"), F.lit("")), F.octet_length(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    html = F.concat(
        F.lit("<article><p>Document "), name, F.lit('</p><figure><img src="sha256:'), payload_digest(text), F.lit('" data-bytes="'), n.cast("string"), F.lit('"><figcaption>Bytes of document '), name, F.lit("</figcaption></figure><p>"), n.cast("string"), F.lit(" bytes</p></article>")
    )
    return df.select(key, html.alias("html"))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a media payload: stored, read back, described, and resolved from its reference."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    items = parse_sequences(illustrated(docs), "doc_id", "html").where(F.col("kind") == "media")
    out = resolve(items, media_features(store_media(docs)))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
