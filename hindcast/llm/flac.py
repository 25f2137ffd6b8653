"""FLAC for byte payloads: an encoder and a decoder that work on many frames at once.

Payloads are mono 8-bit PCM (byte minus 128) in blocks of 576 samples. The encoder picks for each
frame the shortest of a constant, a verbatim, a fixed predictor of order 0 to 2 and a quantised linear
predictor of order 2, with one Rice parameter for each of four partitions. The decoder reads any mono
stream of this block size with those subframe kinds and any order up to 32: it checks every header's
CRC-8 and every frame's CRC-16 and the stream's MD5, reads Rice residuals of all frames in step
(sample by sample across frames, so that the serial code is a vector operation), and restores samples
by the predictors. A SEEKTABLE holds sample offsets of frames.

Formats and constants are those of RFC 9639.
"""

from __future__ import annotations

import hashlib

import numpy as np

BLOCK = 576
SEEK_EVERY = 1
RATE_CODE, RATE = 4, 8000
LPC_SHIFT, LPC_PRECISION = 6, 8
PARTITION_ORDER = 2
PARTITIONS = 1 << PARTITION_ORDER


def crc_table(polynomial: int, width: int) -> np.ndarray:
    """Remainders of all bytes."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    c = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        c = np.where(c & top, (c << 1) ^ polynomial, c << 1) & mask
    return c.astype(np.uint32)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def crc16_shift() -> np.ndarray:
    """Remainders of two-byte words, for two bytes a step."""
    v = np.arange(65536, dtype=np.uint32)
    c = CRC16[v >> 8]
    return (((c << 8) & 0xFFFF) ^ CRC16[(c >> 8) ^ (v & 255)]).astype(np.uint32)


CRC16_WORD = crc16_shift()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16_all(buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of each span of the buffer; spans go in step, those of odd size begin with a byte alone."""
    c = np.zeros(len(start), dtype=np.uint32)
    pos, left = start.astype(np.int64).copy(), size.astype(np.int64).copy()
    odd = left % 2 == 1
    c[odd] = CRC16[buffer[pos[odd]]]
    pos[odd] += 1
    left[odd] -= 1
    order = np.argsort(-left, kind="stable")
    c, pos, left = c[order], pos[order], left[order]
    live = len(left)
    for done in range(0, int(left[0]) if live else 0, 2):
        while live and left[live - 1] <= done:
            live -= 1
        at = pos[:live] + done
        word = (buffer[at].astype(np.uint32) << 8) | buffer[at + 1]
        c[:live] = CRC16_WORD[c[:live] ^ word]
    out = np.empty_like(c)
    out[order] = c
    return out


def utf8_number(n: int) -> bytes:
    """The frame number as the format codes it, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >= 1 << (5 * size + 1) and size < 7:
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> size) & 0xFF | n, *reversed(tail)])


def frame_header(n: int) -> bytes:
    head = bytes([0xFF, 0xF8, 0x20 | RATE_CODE, 0x02]) + utf8_number(n)
    return head + bytes([crc8(head)])


_HEADERS: list[bytes] = []


def headers(n: int) -> list[bytes]:
    while len(_HEADERS) < min(n, 4096):
        _HEADERS.append(frame_header(len(_HEADERS)))
    return _HEADERS[:n] if n <= 4096 else _HEADERS + [frame_header(i) for i in range(4096, n)]


def zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def predictors(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
    """Coefficients of the order-2 linear predictor by frame, and residuals as (order, array) by kind."""
    x64 = x.astype(np.float32)
    r0 = np.einsum("ij,ij->i", x64, x64)
    r1 = np.einsum("ij,ij->i", x64[:, 1:], x64[:, :-1])
    r2 = np.einsum("ij,ij->i", x64[:, 2:], x64[:, :-2])
    det = r0 * r0 - r1 * r1
    ok = det > 1e-3 * np.maximum(r0 * r0, 1)
    det = np.where(ok, det, 1)
    a = np.stack([np.where(ok, (r1 * r0 - r1 * r2) / det, 0), np.where(ok, (r2 * r0 - r1 * r1) / det, 0)], axis=1)
    q = np.clip(np.rint(a * (1 << LPC_SHIFT)), -(1 << (LPC_PRECISION - 1)), (1 << (LPC_PRECISION - 1)) - 1).astype(np.int32)
    d1 = x[:, 1:] - x[:, :-1]
    guess = (q[:, :1] * x[:, 1:-1] + q[:, 1:] * x[:, :-2]) >> LPC_SHIFT
    return q, [(0, x), (1, d1), (2, d1[:, 1:] - d1[:, :-1]), (2, x[:, 2:] - guess)], ok


def rice_plan(r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Rice parameters of each frame's partitions, and bits of each frame's residual."""
    u = zigzag(r)
    size = BLOCK // PARTITIONS
    cut = [(max(p * size - order, 0), (p + 1) * size - order) for p in range(PARTITIONS)]
    ks = np.empty((len(r), PARTITIONS), dtype=np.int32)
    bits = np.full(len(r), 6, dtype=np.int64)
    for p, (a, b) in enumerate(cut):
        part = u[:, a:b]
        mean = part.sum(axis=1) / (b - a)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1e-9)) + 1), 0, 14).astype(np.int32)
        ks[:, p] = k
        bits += 4 + (1 + k) * (b - a) + (part >> k[:, None]).sum(axis=1)
    return ks, bits


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, each a positive multiple of the block size long."""
    counts = [len(p) // BLOCK for p in payloads]
    x = (np.frombuffer(b"".join(payloads), dtype=np.uint8).astype(np.int32) - 128).reshape(-1, BLOCK)
    frames = len(x)
    q, kinds, fits = predictors(x)
    plans = [rice_plan(r, order) for order, r in kinds]
    sizes = np.stack([np.full(frames, 8 * BLOCK), *(bits + 8 * order for (order, _), (_, bits) in zip(kinds, plans, strict=True))])
    sizes[4] += np.where(fits, 4 + 5 + 2 * LPC_PRECISION, 1 << 30)
    choice = sizes.argmin(axis=0)  # 0 verbatim, 1..3 fixed 0..2, 4 linear predictor
    choice[(x == x[:, :1]).all(axis=1)] = 5
    bodies: list[bytes] = [b""] * frames
    for kind in range(6):
        rows = np.flatnonzero(choice == kind)
        if not len(rows):
            continue
        if kind == 0:
            raw = x[rows].astype(np.int8).tobytes()
            made = [b"\x02" + raw[i * BLOCK : (i + 1) * BLOCK] for i in range(len(rows))]
        elif kind == 5:
            made = [bytes([0, v & 255]) for v in x[rows, 0].tolist()]
        else:
            order, r = kinds[kind - 1]
            made = pack(x[rows], r[rows], order, plans[kind - 1][0][rows], q[rows] if kind == 4 else None)
        for i, body in zip(rows.tolist(), made, strict=True):
            bodies[i] = body
    heads = headers(max(counts, default=0))
    parts: list[bytes] = []
    for n in counts:
        parts += heads[:n]
    framed = [h + b for h, b in zip(parts, bodies, strict=True)]
    size = np.array([len(f) for f in framed], dtype=np.int64)
    start = np.cumsum(size) - size
    crc = crc16_all(np.frombuffer(b"".join(framed), dtype=np.uint8), start, size).astype(">u2").tobytes()
    out, at = [], 0
    for payload, n in zip(payloads, counts, strict=True):
        own = [framed[i] + crc[2 * i : 2 * i + 2] for i in range(at, at + n)]
        out.append(metadata(payload, own) + b"".join(own))
        at += n
    return out


def pack(x: np.ndarray, r: np.ndarray, order: int, ks: np.ndarray, q: np.ndarray | None) -> list[bytes]:
    """Subframes of frames with one predictor kind: fields as (value, bits) laid into a bit matrix row by row."""
    n = len(x)
    kind = (8 + order if q is None else 32 + order - 1) << 1
    values = [np.full((n, 1), kind), x[:, :order] & 255]
    widths = [np.full((n, 1), 8), np.full((n, order), 8)]
    if q is not None:
        values += [np.full((n, 1), LPC_PRECISION - 1), np.full((n, 1), LPC_SHIFT), q & ((1 << LPC_PRECISION) - 1)]
        widths += [np.full((n, 1), 4), np.full((n, 1), 5), np.full((n, order), LPC_PRECISION)]
    values.append(np.full((n, 1), PARTITION_ORDER))
    widths.append(np.full((n, 1), 6))
    u, size = zigzag(r), BLOCK // PARTITIONS
    for p in range(PARTITIONS):
        k = ks[:, p : p + 1]
        part = u[:, max(p * size - order, 0) : (p + 1) * size - order]
        values += [k, (part & ((1 << k) - 1)) | (1 << k)]
        widths += [np.full((n, 1), 4), (part >> k) + 1 + k]
    value, width = np.concatenate(values, axis=1).astype(np.uint64), np.concatenate(widths, axis=1).astype(np.int64)
    end = np.cumsum(width, axis=1)
    total = (end[:, -1] + 7) // 8
    row = np.cumsum(total + 8) - (total + 8)
    # A field has at most 16 significant bits, so it lies in three bytes; zeros before them need no writing. Fields share
    # only the bytes at their ends and no bits, so sums over three byte lanes are the union.
    last = row[:, None] * 8 + end - 1
    byte = (last >> 3).ravel()
    shifted = (value << (np.uint64(7) - (last & 7).astype(np.uint64))).ravel()
    length = int(row[-1] + total[-1] + 8) if n else 0
    lanes = np.zeros(length + 3, dtype=np.float64)
    for lane in range(3):
        part = ((shifted >> np.uint64(8 * lane)) & np.uint64(255)).astype(np.float64)
        add = np.bincount(np.maximum(byte - lane, 0), weights=part, minlength=length + 3)
        lanes += add[: length + 3]
    data = lanes.astype(np.uint8).tobytes()
    return [data[a : a + t] for a, t in zip(row.tolist(), total.tolist(), strict=True)]


def metadata(payload: bytes, frames: list[bytes]) -> bytes:
    """Marker, STREAMINFO and SEEKTABLE."""
    sizes = [len(f) for f in frames]
    samples = len(payload)
    packed = (RATE << 44) | (0 << 41) | (7 << 36) | samples
    digest = hashlib.md5((np.frombuffer(payload, dtype=np.uint8) ^ np.uint8(128)).tobytes()).digest()
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + digest
    points, at = [], 0
    for i, size in enumerate(sizes):
        if i % SEEK_EVERY == 0:
            points.append((i * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + BLOCK.to_bytes(2, "big"))
        at += size
    seek = b"".join(points)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek


class Damaged(ValueError):
    """The stream breaks the format or a checksum."""


def open_stream(stream: bytes) -> dict:
    """STREAMINFO, seek points and the offset of the first frame."""
    if stream[:4] != b"fLaC":
        raise Damaged("no marker")
    at, found = 4, {"seek": []}
    while True:
        kind, size = stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            found |= {"block": int.from_bytes(body[:2], "big"), "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            found["seek"] = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, size, 18)]
        last = stream[at] & 128
        at += 4 + size
        if last:
            break
    if (found.get("block"), found.get("channels"), found.get("bits")) != (BLOCK, 1, 8):
        raise Damaged("only mono 8-bit streams in blocks of 576 are read")
    return found | {"frames": at}


class Bits:
    """Reads bit fields at one position per frame, all frames in step."""

    def __init__(self, buffer: np.ndarray):
        padded = np.concatenate([buffer, np.zeros(16, np.uint8)])
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(buffer) + 8]
        big = np.zeros(len(buffer) + 8, dtype=np.uint64)
        for i in range(8):
            big |= padded[i : i + len(big)].astype(np.uint64) << np.uint64(8 * (7 - i))
        self.big = big

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """The next 57 bits or more, at the top of 64."""
        return self.big[pos >> 3] << (pos & 7).astype(np.uint64)

    def take(self, pos: np.ndarray, n: int) -> np.ndarray:
        out = (self.peek(pos) >> np.uint64(64 - n)).astype(np.int64) if n else np.zeros(len(pos), np.int64)
        pos += n
        return out

    def rice(self, pos: np.ndarray, k: np.ndarray) -> np.ndarray:
        """One Rice code per frame; long unary parts are read piece by piece."""
        top = self.peek(pos) >> np.uint64(16)
        q = 47 - np.floor(np.log2(np.maximum(top, 1).astype(np.float64))).astype(np.int64)
        long = top == 0
        if long.any():
            q[long] = 0
            for i in np.flatnonzero(long).tolist():
                p, n = int(pos[i]), 0
                while not (int(self.big[p >> 3]) << (p & 7) >> 63) & 1:
                    p, n = p + 1, n + 1
                    if p >= 8 * len(self.big):
                        raise Damaged("residual runs over the end")
                q[i] = n
        pos += q + 1
        rest = np.where(k > 0, self.peek(pos) >> np.minimum(64 - k, 63).astype(np.uint64), 0).astype(np.int64)
        pos += k
        u = (q << k) | rest
        return (u >> 1) ^ -(u & 1)


def signed(v: np.ndarray, bits: int) -> np.ndarray:
    return v - ((v >> (bits - 1)) << bits)


def decode_many(streams: list[bytes]) -> list[bytes]:
    """Payloads of streams; every checksum is verified."""
    infos = [open_stream(s) for s in streams]
    frames = [i["samples"] // BLOCK for i in infos]
    buffer = np.frombuffer(b"".join(streams), dtype=np.uint8)
    base = np.cumsum([0] + [len(s) for s in streams])
    bits = Bits(buffer)
    total = sum(frames)
    x = np.empty((total, BLOCK), dtype=np.int32)
    row0 = np.cumsum([0] + frames)
    # Frames of one stream follow each other; frame starts come from the seek table, and between two points
    # frames are read one after another, in step across all streams and points.
    start, row, left = [], [], []
    for s, info in enumerate(infos):
        points = info["seek"] or [(0, 0)]
        for j, (sample, offset) in enumerate(points):
            first = sample // BLOCK
            until = points[j + 1][0] // BLOCK if j + 1 < len(points) else frames[s]
            start.append(int(base[s]) + info["frames"] + offset)
            row.append((int(row0[s]) + first, first))
            left.append(until - first)
    pos = np.array(start, dtype=np.int64)
    rows = np.array([r for r, _ in row], dtype=np.int64)
    numbers = np.array([n for _, n in row], dtype=np.int64)
    left = np.array(left, dtype=np.int64)
    stop = np.repeat(base[1:], [len(i["seek"]) or 1 for i in infos])
    while (live := left > 0).any():
        p, r, n, end = pos[live], rows[live], numbers[live], stop[live]
        after = read_frames(bits, buffer, p, n, x, r, end)
        pos[live], rows[live], numbers[live], left[live] = after, r + 1, n + 1, left[live] - 1
    raw = (x + 128).astype(np.uint8)
    out = []
    for s, info in enumerate(infos):
        payload = raw[row0[s] : row0[s + 1]].tobytes()
        if hashlib.md5((np.frombuffer(payload, dtype=np.uint8) ^ np.uint8(128)).tobytes()).digest() != info["md5"]:
            raise Damaged("MD5 of the samples")
        out.append(payload)
    return out


def read_frames(bits: Bits, buffer: np.ndarray, start: np.ndarray, number: np.ndarray, x: np.ndarray, rows: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """One frame at each start; returns where each ends. Samples go to x[rows]."""
    pos = start * 8
    if (start + 8 > stop).any() or (bits.take(pos, 32) != 0xFFF80002 | (0x20 | RATE_CODE) << 8).any():
        raise Damaged("frame header")
    for i, (s, n) in enumerate(zip(start.tolist(), number.tolist(), strict=True)):
        head = headers(n + 1)[n] if n < 4096 else frame_header(n)
        if buffer[s : s + len(head)].tobytes() != head:
            raise Damaged("frame number or CRC-8")
        pos[i] = 8 * (s + len(head))
    kind = bits.take(pos, 8) >> 1
    out = np.empty((len(start), BLOCK), dtype=np.int64)
    for k in np.unique(kind).tolist():
        at = np.flatnonzero(kind == k)
        p = pos[at]
        if k == 0:
            out[at] = signed(bits.take(p, 8), 8)[:, None]
        elif k == 1:
            byte = (p >> 3)[:, None] + np.arange(BLOCK)
            out[at] = buffer[np.minimum(byte, len(buffer) - 1)].astype(np.int8)
            p += 8 * BLOCK
        elif 8 <= k <= 12 or k >= 32:
            out[at] = predicted(bits, p, k)
        else:
            raise Damaged("subframe kind")
        pos[at] = p
    end = (pos + 7) // 8
    if (end + 2 > stop).any():
        raise Damaged("frame runs over the end")
    if (crc16_all(buffer, start, end - start) != (buffer[end].astype(np.uint32) << 8 | buffer[end + 1])).any():
        raise Damaged("CRC-16")
    x[rows] = out
    return end + 2


FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def predicted(bits: Bits, p: np.ndarray, kind: int) -> np.ndarray:
    """Subframes with a predictor: warm-up, coefficients, Rice residual, restoration."""
    n, order = len(p), kind - 8 if kind < 32 else kind - 31
    x = np.empty((n, BLOCK), dtype=np.int64)
    for i in range(order):
        x[:, i] = signed(bits.take(p, 8), 8)
    if kind < 32:
        coefficients, shift = np.tile(np.array(FIXED[order], dtype=np.int64), (n, 1)), np.zeros(n, np.int64)
    else:
        precision = bits.take(p, 4) + 1
        if (precision != precision[0]).any():  # streams of other encoders: by precision
            raise Damaged("linear predictors of mixed precision in one step")
        shift = signed(bits.take(p, 5), 5)
        coefficients = np.stack([signed(bits.take(p, int(precision[0])), int(precision[0])) for _ in range(order)], axis=1)
    method = bits.take(p, 2)
    porder = bits.take(p, 4)
    if (method > 0).any() or (porder != porder[0]).any():
        raise Damaged("residual coding method")
    size = BLOCK >> int(porder[0])
    k = np.zeros(n, dtype=np.int64)
    for i in range(order, BLOCK):
        if i == order or i % size == 0:
            k = bits.take(p, 4)
            if (k == 15).any():
                raise Damaged("escaped partition")
        x[:, i] = bits.rice(p, k)
    if order == 1 and kind < 32:
        np.cumsum(x, axis=1, out=x)
    elif order:
        back = np.ascontiguousarray(x.T)
        c = coefficients.T
        for i in range(order, BLOCK):
            guess = c[0] * back[i - 1]
            for j in range(1, order):
                guess = guess + c[j] * back[i - 1 - j]
            back[i] += guess >> shift
        x = back.T
    return x


def seek(stream: bytes, sample: int) -> bytes:
    """The block that holds a sample, read from the nearest seek point before it."""
    info = open_stream(stream)
    if not 0 <= sample < info["samples"]:
        raise IndexError(sample)
    first, offset = max(p for p in info["seek"] or [(0, 0)] if p[0] <= sample)
    buffer = np.frombuffer(stream, dtype=np.uint8)
    bits, at = Bits(buffer), np.array([info["frames"] + offset], dtype=np.int64)
    x = np.empty((1, BLOCK), dtype=np.int32)
    for number in range(first // BLOCK, sample // BLOCK + 1):
        at = read_frames(bits, buffer, at, np.array([number]), x, np.zeros(1, np.int64), np.array([len(buffer)]))
    return (x[0] + 128).astype(np.uint8).tobytes()
