"""Media columns: payloads stored as media files, found again by signature sniffing.

`sniff` locates magic bytes with one Aho-Corasick pass over a blob, lets a validator per format confirm the structure and the
length, corrects the declared type and carves what it confirmed; a signature inside confirmed media is part of it. Bytes that
merely look like a signature are left alone. Nothing found gives an empty list; null blobs count as empty; a blob that was cut
short holds no confirmed medium. No two signatures fit one place. Texts are stored whole, very long ones too, equal texts give equal media, and each row gives one row, an empty
table none; columns other than doc_id and text are left aside.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from typing import NamedTuple

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.common import documents, map_batches

#: A payload's length is a multiple of this: 64 pixels of 3 samples.
UNIT = 192
#: The signatures that open a file of each format.
SIGNATURES = {
    "audio/wav": [b"RIFF"],
    "image/bmp": [b"BM"],
    "image/png": [b"\x89PNG\r\n\x1a\n"],
    "image/gif": [b"GIF87a", b"GIF89a"],
    "image/jpeg": [b"\xff\xd8\xff"],
}
STORED_AS = ("audio/wav", "image/bmp", "image/png")


class Medium(NamedTuple):
    offset: int
    length: int
    kind: str
    detail: str


def _wav(b: bytes, at: int) -> tuple[int, str] | None:
    if len(b) < at + 44 or b[at + 8 : at + 16] != b"WAVEfmt ":
        return None
    (riff,), (size,) = struct.unpack_from("<I", b, at + 4), struct.unpack_from("<I", b, at + 16)
    end, place = at + 8 + riff, at + 20 + size
    if size < 16 or end > len(b):
        return None
    _, channels, rate, per_second, frame, bits = struct.unpack_from("<HHIIHH", b, at + 20)
    if not channels or frame != channels * ((bits + 7) // 8) or per_second != rate * frame:
        return None
    while place + 8 <= end:
        name, (size,) = b[place : place + 4], struct.unpack_from("<I", b, place + 4)
        if name == b"data":
            return (8 + riff, f"{rate}Hz/{channels}ch/{bits}bit") if place + 8 + size <= end else None
        place += 8 + size + size % 2
    return None


def _bmp(b: bytes, at: int) -> tuple[int, str] | None:
    if len(b) < at + 54:
        return None
    size, reserved, start, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if reserved or planes != 1 or header < 40 or bits not in (1, 4, 8, 16, 24, 32) or packed or width <= 0 or not height:
        return None
    if size != start + (width * bits + 31) // 32 * 4 * abs(height) or at + size > len(b):
        return None
    return size, f"{width}x{abs(height)}/{bits}bit"


def _png(b: bytes, at: int) -> tuple[int, str] | None:
    place, detail = at + 8, ""
    while place + 12 <= len(b):
        (size,), name = struct.unpack_from(">I", b, place), b[place + 4 : place + 8]
        if place + 12 + size > len(b) or zlib.crc32(b[place + 4 : place + 8 + size]) != struct.unpack_from(">I", b, place + 8 + size)[0]:
            return None
        if not detail and (name != b"IHDR" or size != 13):
            return None
        if name == b"IHDR":
            width, height, depth = struct.unpack_from(">IIB", b, place + 8)
            detail = f"{width}x{height}/{depth}bit"
        place += 12 + size
        if name == b"IEND":
            return place - at, detail
    return None


def _gif(b: bytes, at: int) -> tuple[int, str] | None:
    if len(b) < at + 14:
        return None
    width, height, flags = struct.unpack_from("<HHB", b, at + 6)
    place = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while place < len(b):
        mark = b[place]
        if mark == 0x3B:
            return place + 1 - at, f"{width}x{height}"
        if mark == 0x2C and place + 10 < len(b):
            flags = b[place + 9]
            place += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        elif mark == 0x21:
            place += 2
        else:
            return None
        while place < len(b) and b[place]:
            place += b[place] + 1
        place += 1
    return None


def _jpeg(b: bytes, at: int) -> tuple[int, str] | None:
    place, detail = at + 2, ""
    while place + 4 <= len(b) and b[place] == 0xFF:
        mark, (size,) = b[place + 1], struct.unpack_from(">H", b, place + 2)
        if mark in (0xC0, 0xC1, 0xC2) and place + 9 <= len(b):
            height, width = struct.unpack_from(">HH", b, place + 5)
            detail = f"{width}x{height}"
        place += 2 + size
        if mark == 0xDA:
            end = b.find(b"\xff\xd9", place)
            return (end + 2 - at, detail) if end >= 0 and detail else None
    return None


VALIDATORS = {"audio/wav": _wav, "image/bmp": _bmp, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg}


@functools.lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, magics in SIGNATURES.items():
        for magic in magics:
            found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(blob: bytes | None) -> list[Medium]:
    """All confirmed media in a blob, by offset, none inside another."""
    blob, free, out = blob or b"", 0, []
    hits = sorted((end - size + 1, kind) for end, (size, kind) in _automaton().iter(blob.decode("latin-1")))
    for at, kind in hits:
        if at >= free and (valid := VALIDATORS[kind](blob, at)):
            free = at + valid[0]
            out.append(Medium(at, valid[0], kind, valid[1]))
    return out


def corrected_type(blob: bytes | None, declared: str | None) -> str | None:
    """The type of the medium that fills the blob from its start, else the declared one."""
    found = sniff(blob)
    return found[0].kind if found and found[0].offset == 0 else declared


def store(payload: bytes, kind: str) -> bytes:
    """A payload of a positive multiple of 192 bytes as a file of 8-bit samples."""
    rows = len(payload) // UNIT
    if kind == "audio/wav":
        return struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVEfmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload
    if kind == "image/bmp":
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(payload), 0, 54, 40, 64, rows, 1, 24, 0, len(payload), 2835, 2835, 0, 0) + payload
    if kind == "image/png":
        lines = np.zeros((rows, UNIT + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        head = struct.pack(">IIBBBBB", 64, rows, 8, 2, 0, 0, 0)
        return SIGNATURES[kind][0] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")
    raise ValueError(f"payloads can't be stored as {kind}")


def samples(blob: bytes, medium: Medium) -> bytes:
    """The 8-bit samples of a stored medium."""
    b = blob[medium.offset : medium.offset + medium.length]
    if medium.kind == "audio/wav":
        place = 12
        while b[place : place + 4] != b"data":
            place += 8 + struct.unpack_from("<I", b, place + 4)[0]
        return b[place + 8 : place + 8 + struct.unpack_from("<I", b, place + 4)[0]]
    if medium.kind == "image/bmp":
        return b[struct.unpack_from("<I", b, 10)[0] :]
    if medium.kind == "image/png":
        place, packed = 8, []
        while place < len(b):
            (size,), name = struct.unpack_from(">I", b, place), b[place + 4 : place + 8]
            if name == b"IDAT":
                packed.append(b[place + 8 : place + 8 + size])
            place += 12 + size
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, UNIT + 1)
        if lines[:, 0].any():
            raise ValueError("a filtered PNG line: this reader takes the unfiltered lines of store()")
        return lines[:, 1:].tobytes()
    raise ValueError(f"no reader for {medium.kind}")


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8")
    return len(data), data + b" " * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def media_of_texts(docs: DataFrame) -> DataFrame:
    """doc_id, declared and corrected type, and the stored file of each text. The format goes by the payload's checksum."""

    def make():
        def run(batch):
            files = [store(p, STORED_AS[zlib.crc32(p) % 3]) for _, p in map(payload_of, batch["text"])]
            declared = "application/octet-stream"
            return {"doc_id": batch["doc_id"], "declared": [declared] * len(files), "type": [corrected_type(f, declared) for f in files], "media": files}

        return run

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, declared string, type string, media binary")


def sniffed(table: DataFrame, blob: str, *keep: str) -> DataFrame:
    """A row for each confirmed medium in the binary column `blob`, with its carved bytes and the columns in `keep`."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*keep).schema)

    def make():
        def run(batch):
            found = [(i, m) for i, b in enumerate(batch[blob]) for m in sniff(b)]
            out = {k: [batch[k][i] for i, _ in found] for k in keep}
            carved = [batch[blob][i][m.offset : m.offset + m.length] for i, m in found]
            return out | {"media_offset": [m.offset for _, m in found], "media_type": [m.kind for _, m in found], "media_detail": [m.detail for _, m in found], "carved": carved}

        return run

    return map_batches(table.select(*keep, blob), make, f"{fields}, media_offset long, media_type string, media_detail string, carved binary")


def digest_media(docs: DataFrame) -> DataFrame:
    """`media_of_texts` read back: digests of the payload and the file, and features of the samples."""

    def make():
        def run(batch):
            out = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for text in batch["text"]:
                size, payload = payload_of(text)
                blob = store(payload, STORED_AS[zlib.crc32(payload) % 3])
                medium = sniff(blob)[0]
                back = samples(blob, medium)
                levels = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
                bands = "/".join(map(str, levels.reshape(4, 64).sum(axis=1)))
                row = (size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), f"{medium.kind};{medium.detail};sum={int(levels @ np.arange(256))};levels={np.count_nonzero(levels)};bands={bands}")
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            return {"doc_id": batch["doc_id"]} | out

        return run

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_media(documents(spark, sf_dir))
