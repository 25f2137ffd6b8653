"""FLAC: round trips, an independent scalar reader, and damage."""

import numpy as np
import pytest

from hindcast.llm import flac, media


class Scalar:
    """A plain bit reader for one mono 8-bit stream, written apart from the operator."""

    def __init__(self, data):
        self.bits = "".join(f"{b:08b}" for b in data)
        self.at = 0

    def u(self, n):
        v = int(self.bits[self.at : self.at + n] or "0", 2)
        self.at += n
        return v

    def s(self, n):
        v = self.u(n)
        return v - (1 << n) if v >> (n - 1) else v

    def rice(self, k):
        q = 0
        while not self.u(1):
            q += 1
        v = q << k | self.u(k)
        return v >> 1 if v % 2 == 0 else -(v >> 1) - 1

    def stream(self):
        assert self.u(32) == 0x664C6143
        last = 0
        while not last:
            last, kind, size = self.u(1), self.u(7), self.u(24)
            begin = self.at
            if kind == 0:
                self.at += 80 + 20 + 3
                assert self.u(5) == 7
                samples = self.u(36)
            self.at = begin + 8 * size
        out = []
        while len(out) < samples:
            out += self.frame()
        return bytes(v + 128 for v in out)

    def frame(self):
        assert self.u(32) == 0xFFF82402
        lead = self.u(8)
        extra = 0 if lead < 128 else f"{lead:08b}".index("0") - 1
        self.at += 8 * extra + 8
        assert self.u(1) == 0
        kind = self.u(6)
        assert self.u(1) == 0
        n = flac.BLOCK
        if kind == 0:
            x = [self.s(8)] * n
        elif kind == 1:
            x = [self.s(8) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [self.s(8) for _ in range(order)]
            if kind < 32:
                c, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
            else:
                precision, shift = self.u(4) + 1, self.s(5)
                c = [self.s(precision) for _ in range(order)]
            assert self.u(2) == 0
            parts = 1 << self.u(4)
            for p in range(parts):
                k = self.u(4)
                for _ in range(n // parts - (order if p == 0 else 0)):
                    x.append(self.rice(k) + (sum(a * b for a, b in zip(c, reversed(x[-order:] if order else []), strict=True)) >> shift))
        self.at = -(-self.at // 8) * 8 + 16
        return x


RNG = np.random.default_rng(3)
CASES = [
    b"",
    b"a",
    b"the cat sat on the mat. " * 400,
    bytes(RNG.integers(0, 256, 3000, dtype=np.uint8)),
    bytes(576),
    bytes((128 + 100 * np.sin(np.arange(5000) / 9)).astype(np.uint8)),
    bytes([0] * 575 + [255]) * 3,
    "naïve façade ß ".encode() * 90,
]


def padded(raw):
    return raw + b"\xff" * (max(-(-len(raw) // 576), 1) * 576 - len(raw))


def test_round_trip_and_scalar_reader():
    payloads = [padded(c) for c in CASES]
    streams = flac.encode_many(payloads)
    assert flac.decode_many(streams) == payloads
    assert [Scalar(s).stream() for s in streams] == payloads
    assert flac.encode_many(payloads[2:3]) == streams[2:3]
    kinds = {s[flac.open_stream(s)["frames"] + 6] >> 1 for s in streams}
    assert {0, 1} & kinds and len(kinds) > 2


def test_seek():
    payload = padded(CASES[2])
    stream = flac.encode_many([payload])[0]
    for sample in (0, 575, 576, 5000, len(payload) - 1):
        block = sample // 576 * 576
        assert flac.seek(stream, sample) == payload[block : block + 576]
    with pytest.raises(IndexError):
        flac.seek(stream, len(payload))


@pytest.mark.parametrize("where", [0, 30, -1, -3, -200])
def test_damage_is_found(where):
    stream = bytearray(flac.encode_many([padded(CASES[2])])[0])
    stream[where] ^= 0x10
    with pytest.raises(flac.Damaged):
        flac.decode_many([bytes(stream)])


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "é" * 1000, 3), (3, "é" * 1000, 4)], "doc_id long, text string, media long")
    rows = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.media_sha256) for r in media.round_trip(docs).collect()}
    assert {x[:3] for x in rows} == {(1, 0, 576), (2, 0, 576), (3, 2000, 2304)}
    assert len(rows) == 3
    assert media.read_media(media.encode_media(docs)).count() == 4
    assert media.round_trip(docs.limit(0)).count() == 0
