"""Stored media read back by other readers: the wave module, and a BMP and a PNG reader of this test's own."""

import io
import struct
import wave
import zlib

import pytest

from lexweave.llm import media


def padded(text):
    data = (text or "").encode()
    return data + b" " * (192 - len(data) % 192 if len(data) % 192 or not data else 0)


def read_wav(blob):
    with wave.open(io.BytesIO(blob)) as f:
        assert (f.getnchannels(), f.getsampwidth()) == (1, 1)
        return f.readframes(f.getnframes())


def read_bmp(blob):
    assert blob[:2] == b"BM" and struct.unpack_from("<I", blob, 2)[0] == len(blob)
    start, (width, height, _, bits) = struct.unpack_from("<I", blob, 10)[0], struct.unpack_from("<iiHH", blob, 18)
    line = (width * bits // 8 + 3) // 4 * 4
    return b"".join(blob[start + i * line : start + i * line + width * bits // 8] for i in range(height))


def read_png(blob):
    assert blob[:8] == b"\x89PNG\r\n\x1a\n"
    at, head, data = 8, None, b""
    while at < len(blob):
        (size,), name = struct.unpack_from(">I", blob, at), blob[at + 4 : at + 8]
        body = blob[at + 8 : at + 8 + size]
        assert struct.unpack_from(">I", blob, at + 8 + size)[0] == zlib.crc32(name + body)
        head, data = (body if name == b"IHDR" else head), data + (body if name == b"IDAT" else b"")
        at += 12 + size
    width, height, depth, colour = struct.unpack_from(">IIBB", head)
    assert (depth, colour, name) == (8, 2, b"IEND")
    raw = zlib.decompress(data)
    lines = [raw[i * (1 + 3 * width) : (i + 1) * (1 + 3 * width)] for i in range(height)]
    assert all(line[0] == 0 for line in lines)
    return b"".join(line[1:] for line in lines)


READERS = {"audio/wav": read_wav, "image/bmp": read_bmp, "image/png": read_png}


@pytest.mark.parametrize("kind", media.STORED_AS)
def test_other_readers_get_the_payload(kind):
    for text in (None, "", "a" * 191, "a" * 192, "é" * 500, "\x00\xff RIFF BM" * 3000, "x" * 2_000_000):
        size, payload = media.payload_of(text)
        assert payload == padded(text) and size == len((text or "").encode())
        assert READERS[kind](media.store(payload, kind)) == payload
