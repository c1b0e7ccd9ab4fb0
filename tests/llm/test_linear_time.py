"""Long texts made to be searched again and again; sniffed media and read pages in linear time."""

import random
import struct
import time
import zlib

import numpy as np
import pytest
from lustra.llm import html_extract, media

FINDER = media.automaton()
PLAIN = html_extract.Classifier(np.zeros((0, html_extract.N_FEATURES)), np.zeros(0))


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


HEAD = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13))


def took(job, make):
    """Seconds for half a megabyte and for one."""
    out = []
    for n in (1 << 19, 1 << 20):
        data = make(n)
        began = time.process_time()
        job(data)
        out.append(time.process_time() - began)
    return out


@pytest.mark.parametrize(
    "unit", [b"\0\0\0\x08ftyp", b"OggS" + bytes(23), b"\x89PNG\r\n\x1a\n", HEAD + struct.pack(">I", 200_000) + b"IDAT", b"GIF89a\1\0\1\0\0\0\0\x21\xf9", b"RIFF\0\x10\0\0WAVE", b"MThd" + struct.pack(">IHHH", 6, 1, 60_000, 96) + b"MTrk\0\0\0\0", b"\xff\xd8\xff\xff\0\2", b"ID3\4" + bytes(6) + b"\xff\xe3\x10\0", b"PK\3\4PK\5\6", b"%PDF-1%%EOF"]
)
def test_sniffing(unit):
    half, whole = took(lambda d: media.sniff(d, FINDER), lambda n: (unit * (n // len(unit) + 1))[:n])
    assert whole < 3 * half + 0.5 and whole < 20


@pytest.mark.parametrize("unit", ["<a ", "<![CDATA[", "<svg>", '<a ">"', "<a<", "<!", "</svg ", "<div>", "<div></p>", "</p>", "<a '\">", "<b class=x>"])
def test_pages(unit):
    half, whole = took(lambda h: html_extract.main_text(h, PLAIN), lambda n: (unit * (n // len(unit) + 1))[:n])
    assert whole < 3 * half + 0.5 and whole < 20


def test_checksums():
    r = random.Random(1)
    data = r.randbytes(300_000)
    marks = media.Marks(data, {}, [])
    for _ in range(200):
        a, b = sorted((r.randrange(300_001), r.randrange(300_001)))
        assert marks.checksum(a, b) == zlib.crc32(data[a:b])


def test_roads():
    r = random.Random(2)
    onward = {p: p + r.randint(1, 9) for p in range(3000)}
    road = media.Road(lambda p: onward.get(p))
    for _ in range(2000):
        p, steps, goal = r.randrange(3000), r.randint(0, 40), r.randrange(3020)
        way = [p]
        while way[-1] in onward:
            way.append(onward[way[-1]])
        assert road.after(p, steps) == (way[steps] if steps < len(way) else None)
        assert road.passes(p, goal) == (goal in way)


def test_media_in_media():
    """Parts that several starts share, and ends that only some of them reach."""
    gif = b"GIF89a\1\0\1\0\0\0\0" + b"\x21\xf9\4abcd\0" + b"\x2c" + bytes(9) + b"\2\3abc\0" + b"\x3b"
    track = b"MTrk" + struct.pack(">I", 3) + b"abc"
    midi = lambda n: b"MThd" + struct.pack(">IHHH", 6, 1, n, 96)
    page = lambda flag, body: b"OggS\0" + bytes([flag]) + bytes(20) + bytes([1, len(body)]) + body
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    png = HEAD + chunk(b"IDAT", bytes(range(256)) * 300) + chunk(b"IEND", b"")
    wave = media.to_wave(b"abc" * 5)
    parts = [
        (gif, "image/gif"), (midi(2) + track * 2, "audio/midi"), (page(0, b"a") + page(4, b"b"), "application/ogg"), (box(b"ftyp", b"isom") + box(b"moov", b"a"), "video/mp4"),
        (png, "image/png"), (wave, "audio/wav"), (b"RIFF" + struct.pack("<I", 4) + b"WEBP", "image/webp"), (b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2abc\xff\xd9", "image/jpeg"),
    ]
    r = random.Random(3)
    for _ in range(30):
        data, want = b"", []
        for body, kind in r.sample(parts, 5):
            data += b"-" * r.randint(1, 9)
            want.append((len(data), len(body), kind))
            data += body
        found = media.sniff(data + b"-", FINDER)
        assert set(want) <= set(found) and all(any(a <= x[0] and x[0] + x[1] <= a + n for a, n, _ in want) for x in found)
    assert media.sniff(midi(3) + track * 2, FINDER) == [] and [x[:2] for x in media.sniff(midi(1) + track * 2, FINDER)] == [(0, 25)]
    assert media.sniff(wave[:-2], FINDER) == [] and media.sniff(gif[:-1], FINDER) == [] and media.sniff(png[:-1], FINDER) == []
