"""Media columns: store, sniff, validate and carve media bytes.

An Aho-Corasick automaton finds every signature in one pass over the bytes. A format's validator then follows the
structure from there (chunk lengths, checksums, trailers) and gives the item's length, or rejects the hit. The item at
offset 0 decides the type, whatever was declared; items further in are carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_slices, read_table, tidy

BLOCK, MAX_SLICE = 64, 16 << 20

#: Fixed values of the public formats: magic bytes, where they stand in an item, and the kind they announce.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, "png"),
    (b"\xff\xd8\xff", 0, "jpeg"),
    (b"GIF87a", 0, "gif"),
    (b"GIF89a", 0, "gif"),
    (b"BM", 0, "bmp"),
    (b"RIFF", 0, "riff"),
    (b"%PDF-", 0, "pdf"),
    (b"PK\x03\x04", 0, "zip"),
    (b"\x1f\x8b\x08", 0, "gzip"),
    (b"OggS", 0, "ogg"),
    (b"fLaC", 0, "flac"),
    (b".snd", 0, "au"),
    (b"ftyp", 4, "mp4"),
]
#: Media types of the kinds that validators return.
MIME = {
    "png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "wav": "audio/wav", "webp": "image/webp",
    "avi": "video/x-msvideo", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip", "ogg": "application/ogg",
    "flac": "audio/flac", "au": "audio/basic", "mp4": "video/mp4",
}
RIFF_FORMS = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}


class Marks:
    """Where trailers and end records stand in the bytes, found once; and where walks from part to part led nowhere."""

    def __init__(self, b: bytes):
        self.b, self.found, self.dead = b, {}, set()

    def of(self, mark: bytes) -> list[int]:
        """All positions of a mark, in order."""
        if mark not in self.found:
            at, listed = self.b.find(mark), []
            while at >= 0:
                listed.append(at)
                at = self.b.find(mark, at + 1)
            self.found[mark] = listed
        return self.found[mark]

    def last(self, mark: bytes, begin: int, end: int) -> int:
        """The last position from begin at which the mark ends by end, or -1."""
        listed = self.of(mark)
        i = bisect_right(listed, end - len(mark)) - 1
        return listed[i] if i >= 0 and listed[i] >= begin else -1

    def next(self, mark: bytes, begin: int) -> int:
        listed = self.of(mark)
        i = bisect_left(listed, begin)
        return listed[i] if i < len(listed) else -1

    def headers(self) -> list[int]:
        """Headers of PDF: with a digit behind."""
        if "pdf" not in self.found:
            self.found["pdf"] = [i for i in self.of(b"%PDF-") if self.b[i + 5 : i + 6].isdigit()]
        return self.found["pdf"]

    def archives(self) -> dict[int, int]:
        """Where ZIP archives begin, by their end records, and where the first such record's archive ends."""
        if "zip" not in self.found:
            b, ends = self.b, {}
            for end in self.of(b"PK\x05\x06"):
                if end + 22 <= len(b):
                    size, offset, comment = struct.unpack_from("<IIH", b, end + 12)
                    at = end - size - offset
                    if at >= 0 and b[at + offset : at + offset + 4] == b"PK\x01\x02" and end + 22 + comment <= len(b):
                        ends.setdefault(at, end + 22 + comment)
            self.found["zip"] = ends
        return self.found["zip"]

    def walk(self, kind: str, at: int, step):
        """Where a chain of parts ends that begins at `at`: step(i) gives the next part's place, a negative number less one
        than minus the end, or None. A place from which a walk failed is not walked from again."""
        path, i = [], at
        while i is not None and i >= 0 and (kind, i) not in self.dead:
            path.append((kind, i))
            i = step(i)
        if i is None or i >= 0:
            self.dead.update(path)
            return None
        return -i - 1


def _png(b: bytes, at: int, marks: Marks):
    def chunk(i):
        n = int.from_bytes(b[i : i + 4], "big")
        if i + 12 + n > len(b) or zlib.crc32(memoryview(b)[i + 4 : i + 8 + n]) != int.from_bytes(b[i + 8 + n : i + 12 + n], "big"):
            return None
        return -(i + 12) - 1 if b[i + 4 : i + 8] == b"IEND" else i + 12 + n

    end = marks.walk("png", at + 8, chunk) if b[at + 8 : at + 16] == b"\0\0\0\x0dIHDR" else None
    return ("png", end - at) if end else None


def _jpeg(b: bytes, at: int, marks: Marks):
    def segment(i):
        if i + 4 > len(b) or b[i] != 0xFF:
            return -(i + 2) - 1 if b[i : i + 2] == b"\xff\xd9" else None
        if b[i + 1] == 0xD9:
            return -(i + 2) - 1
        n = int.from_bytes(b[i + 2 : i + 4], "big")
        if n < 2 or i + 2 + n > len(b):
            return None
        if b[i + 1] != 0xDA:
            return i + 2 + n
        i += 2 + n  # entropy-coded data: up to the next marker that is neither stuffing nor a restart
        while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b) and (b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7):
            i += 2
        return i if i >= 0 else None

    end = marks.walk("jpeg", at + 2, segment)
    return ("jpeg", end - at) if end else None


def _gif(b: bytes, at: int, marks: Marks):
    def block(i):
        if i >= len(b):
            return None
        if b[i] == 0x3B:
            return -(i + 1) - 1
        if b[i] == 0x21:
            i += 2
        elif b[i] == 0x2C and i + 10 <= len(b):
            i += 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 0x80 else 0)
        else:
            return None
        while i < len(b) and b[i]:
            i += 1 + b[i]
        return i + 1

    if at + 13 > len(b):
        return None
    end = marks.walk("gif", at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0), block)
    return ("gif", end - at) if end else None


def _bmp(b: bytes, at: int, marks: Marks):
    if at + 30 > len(b):
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    ok = header in (12, 40, 52, 56, 108, 124) and reserved == 0 and 14 + header <= start <= size <= len(b) - at
    return ("bmp", size) if ok else None


def _riff(b: bytes, at: int, marks: Marks):
    kind = RIFF_FORMS.get(bytes(b[at + 8 : at + 12]))
    size = int.from_bytes(b[at + 4 : at + 8], "little")
    if kind is None or size < 4 or at + 8 + size > len(b):
        return None
    i, end = at + 12, at + 8 + size
    while i + 8 <= end:  # the chunks must fill the form exactly
        n = int.from_bytes(b[i + 4 : i + 8], "little")
        i += 8 + n + (n & 1)
    return (kind, 8 + size) if i == end or i == end + 1 else None


def _pdf(b: bytes, at: int, marks: Marks):
    """To the last trailer before the next header that has a trailer of its own."""
    headers = marks.headers()
    i = bisect_left(headers, at)
    if i == len(headers) or headers[i] != at:
        return None
    last = marks.last(b"startxref", at, max(marks.last(b"%%EOF", at, len(b)), at))
    following = headers[i + 1] if i + 1 < len(headers) else -1
    end = marks.last(b"%%EOF", at, following if 0 <= following < last else len(b))
    return ("pdf", end + 5 - at) if end > 0 and 0 < marks.next(b"startxref", at) <= end - len(b"startxref") else None


def _zip(b: bytes, at: int, marks: Marks):
    end = marks.archives().get(at)
    return ("zip", end - at) if end else None


def _gzip(b: bytes, at: int, marks: Marks):
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    try:
        d, i = zlib.decompressobj(31), at
        while not d.eof and i < len(b):  # in pieces: what comes out is not kept
            piece = bytes(b[i : i + 65536])
            d.decompress(piece, 1 << 20)
            while d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
            i += len(piece)
        return ("gzip", i - at - len(d.unused_data)) if d.eof else None
    except zlib.error:
        return None


def _ogg(b: bytes, at: int, marks: Marks):
    def page(i):
        if b[i : i + 5] != b"OggS\0" or i + 27 > len(b):
            return -i - 1
        n = b[i + 26]
        size = 27 + n + sum(b[i + 27 : i + 27 + n])
        return i + size if i + size <= len(b) else None

    end = marks.walk("ogg", at, page)
    return ("ogg", end - at) if end and end > at else None


def _flac_head(b: bytes, at: int) -> int | None:
    """Where the frames begin."""
    i, first = at + 4, True
    while i + 4 <= len(b):
        kind, n = b[i], int.from_bytes(b[i + 1 : i + 4], "big")
        if first and (kind & 0x7F or n != 34) or i + 4 + n > len(b):
            return None
        i, first = i + 4 + n, False
        if kind & 0x80:
            return i
    return None


def _flac(b: bytes, at: int, marks: Marks):
    """Frames carry no length, so the item reaches to the end of the bytes."""
    return ("flac", len(b) - at) if _flac_head(b, at) else None


def _au(b: bytes, at: int, marks: Marks):
    if at + 24 > len(b):
        return None
    start, size, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    ok = 24 <= start and 1 <= coding <= 27 and 0 < rate < 1 << 20 and 0 < channels < 256
    size = len(b) - at - start if size == 0xFFFFFFFF else size
    return ("au", start + size) if ok and 0 <= size <= len(b) - at - start else None


def _mp4(b: bytes, at: int, marks: Marks):
    i = at
    while i + 8 <= len(b) and b[i + 4 : i + 8].isalnum():
        n = int.from_bytes(b[i : i + 4], "big")
        if n < 8 or i + n > len(b):
            break
        i += n
    return ("mp4", i - at) if i > at + 8 else None


VALIDATORS = {"png": _png, "jpeg": _jpeg, "gif": _gif, "bmp": _bmp, "riff": _riff, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "ogg": _ogg, "flac": _flac, "au": _au, "mp4": _mp4}


@lru_cache(1)
def _automaton():
    found = ahocorasick.Automaton()
    for magic, offset, kind in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic) + offset, kind))
    found.make_automaton()
    return found


def sniff(data: bytes, declared: str | None = None) -> dict:
    """What the bytes are: type, status (ok, corrected, unknown), length, and the items carved from within.

    An item that lies in another carved one is part of it and is not listed again; but what lies behind the head of FLAC,
    whose end is not known, is."""
    hits = sorted((end + 1 - back, kind) for end, (back, kind) in _automaton().iter(data.decode("latin-1")) if end + 1 >= back)
    marks = Marks(data)
    whole, carved, covered = None, [], 0
    for at, kind in hits:
        if at and at < covered:
            continue
        if item := VALIDATORS[kind](data, at, marks):
            if at == 0:
                whole = item
            else:
                carved.append((item[0], at, item[1]))
                covered = _flac_head(data, at) if kind == "flac" else at + item[1]
    kind, length = whole or (None, len(data))
    mime = MIME.get(kind, "application/octet-stream")
    status = "unknown" if kind is None else "ok" if declared == mime else "corrected"
    return {"type": mime, "status": status, "length": length, "carved": carved}


def wav_of(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as 8-bit mono samples in a RIFF/WAVE file."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def wav_samples(media: bytes) -> bytes:
    """The samples of a RIFF/WAVE file, found by walking its chunks."""
    i = 12
    while i + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, i)
        if name == b"data":
            return media[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def sniff_column(df: DataFrame, id_col: str, data_col: str, declared_col: str | None = None) -> DataFrame:
    """Sniff a binary column: id, type, status, length, carved (array of kind, offset, length).

    Null bytes count as empty: type application/octet-stream, status unknown, length 0, nothing carved."""
    out = f"{id_col} {df.schema[id_col].dataType.simpleString()}, type string, status string, length long, carved array<struct<kind:string,offset:long,length:long>>"

    def run(batches):
        for b in batches:
            for part in bounded_slices(b, "data_", MAX_SLICE):
                rows = []
                for key, data, declared in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    s = sniff(data or b"", declared)
                    rows.append((key, s["type"], s["status"], s["length"], [dict(zip(("kind", "offset", "length"), c, strict=True)) for c in s["carved"]]))
                schema = pa.schema([(id_col, part.schema.field(0).type), ("type", pa.string()), ("status", pa.string()), ("length", pa.int64()), ("carved", pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))])
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    return df.select(F.col(id_col), F.col(data_col).alias("data_"), declared.alias("declared_")).mapInArrow(tidy(run), out)


def media_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every text stored as 8-bit samples, read back and described.

    Null and empty texts are a payload of 64 zero bytes. Rows are independent of each other: repeated rows repeat their
    result, and an empty table gives none. Long texts are stored whole; the validators take time in proportion to them.
    Columns besides doc_id and the text are not read. feature: sniffed type|status|length|carved kind@offset+length,...
    The declared type is that of unknown bytes, so the signature of the stored form always corrects it."""
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def one(text):
        n, payload = padded(text)
        media = wav_of(payload)
        back = wav_samples(media)
        s = sniff(media, "application/octet-stream")
        feature = f"{s['type']}|{s['status']}|{s['length']}|" + ",".join(f"{k}@{at}+{size}" for k, at, size in s["carved"])
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in out.split(", ")]
        for b in batches:
            for part in bounded_slices(b, "text", MAX_SLICE):
                cols = list(zip(*map(one, (x.as_py() for x in part.column("text"))), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), out)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read_table(spark, sf_dir, "documents"))


def _sql_le32(n: str) -> str:
    """A number's four bytes, lowest first, as hexadecimal digits."""
    return "printf('" + "%02X" * 4 + "', " + ", ".join(f"(({n}) >> {k}) & 255" for k in (0, 8, 16, 24)) + ")"


# The stored form byte by byte; `feature` holds where no text has media inside, as in all test tables.
OP1_SQL = """
WITH bits AS (SELECT [list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for i in range(256)] AS t),
raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT doc_id, b, octet_length(b) AS n, greatest(64, (octet_length(b) + 63) // 64 * 64) AS m FROM raw),
payloads AS (SELECT doc_id, n, m, b || repeat('\\x00'::BLOB, m - n) AS p FROM sized),
tails AS (SELECT *, right(hex(p), 128) AS h, 'audio/wav|corrected|' || (m + 44) || '|' AS feature,
  unhex('52494646' || {riff} || '57415645666D742010000000010001' || '00401F0000401F00000100080064617461' || {data}) || p AS media FROM payloads)
SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(p) AS payload_sha256,
  xor(list_reduce(list_prepend(4294967295, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT for i in range(64)]), lambda c, x: xor(c >> 8, bits.t[(xor(c, x) & 255) + 1])), 4294967295) AS tail_crc32,
  (m + 44)::BIGINT AS media_bytes, sha256(media) AS media_sha256, feature FROM tails, bits
""".format(riff=_sql_le32("m + 36"), data=_sql_le32("m"))
