"""FLAC media columns: lossless storage of bytes as 8-bit samples, and decoding to PCM blocks.

The writer makes fixed-size blocks of BLOCK samples, each with the cheapest of fixed predictors of order 0 to 2 and a
linear predictor of order LPC_ORDER, Rice-coded residuals, checksums of header and frame, an MD5 of the samples and
a seek table. The reader takes mono streams of the format's constant, verbatim, fixed and linear subframes, both
Rice methods, all partition orders and escaped partitions. Frames are located by sync code, header checksum and
running number, and every frame's CRC-16 and each stream's MD5 are verified; all frames of a batch are then decoded
sample by sample side by side, so the work per sample is a few array operations over thousands of frames. A
stream whose frames can't be located that way is walked frame by frame.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plus, slices, table, texts

BLOCK, BITS, RATE = 192, 8, 8000
LPC_ORDER, LPC_PRECISION, LPC_SHIFT = 4, 8, 6
#: A seek point for every so many frames.
SEEK_FRAMES = 64
#: Samples that are coded at one time.
BATCH = 256 << 10
#: Fixed predictors as linear ones.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """A stream that is no FLAC, or whose checksums don't hold."""


def _crc_table(poly: int, width: int) -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        crc = np.where(crc >> (width - 1), (crc << 1) ^ poly, crc << 1) & ((1 << width) - 1)
    return crc.astype(np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crcs(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """The checksum of each run of bytes, all runs side by side."""
    crc = np.zeros(len(starts), np.uint16)
    if not len(starts):
        return crc
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
    for i in range(int(lengths[0])):
        n = alive[i]
        byte = buffer[starts[:n] + i]
        if width == 8:
            crc[:n] = CRC8[crc[:n] ^ byte]
        else:
            crc[:n] = CRC16[(crc[:n] >> 8) ^ byte] ^ (crc[:n] << np.uint16(8))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _frame_number(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to six bytes per number (below 2 ** 31) in the format's UTF-8-like code, and how many count."""
    size = 1 + (number >= 1 << 7) + (number >= 1 << 11) + (number >= 1 << 16) + (number >= 1 << 21) + (number >= 1 << 26)
    out = np.zeros((len(number), 6), np.uint8)
    lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])
    for i in range(6):
        part = number >> np.maximum(0, 6 * (size - 1 - i))
        out[:, i] = np.where(i == 0, np.where(size == 1, number, lead[size] | part), 0x80 | (part & 63))
    return out, size


def _linear(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of each row's best linear predictor, by Levinson's recursion on its autocorrelation."""
    f = x.astype(np.float32)
    auto = [np.einsum("ij,ij->i", f[:, : f.shape[1] - k], f[:, k:]).astype(np.float64) for k in range(LPC_ORDER + 1)]
    error = auto[0] * 1.0001 + 1e-9
    a = np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (auto[i + 1] - sum(a[:, j] * auto[i - j] for j in range(i))) / error
        before = a[:, :i].copy()
        a[:, i] = k
        for j in range(i):
            a[:, j] = before[:, j] - k * before[:, i - 1 - j]
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = 1 << (LPC_PRECISION - 1)
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -top, top - 1).astype(np.int32)


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frames of blocks x (frames, BLOCK) int32, end to end, and the bytes of each."""
    n = len(x)
    one = np.diff(x, axis=1, prepend=0)
    residuals = [x, one, np.diff(one, axis=1, prepend=0)]
    coefs = _linear(x)
    predicted = np.zeros_like(x)
    for j in range(LPC_ORDER):
        predicted[:, LPC_ORDER:] += coefs[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : BLOCK - 1 - j]
    residuals.append(x - (predicted >> LPC_SHIFT))
    orders = (0, 1, 2, LPC_ORDER)
    sums = np.stack([np.abs(r[:, o:]).sum(1) + 16 * o for r, o in zip(residuals, orders, strict=True)])
    sums[3] += 40
    kind = sums.argmin(0)
    order = np.array(orders)[kind]
    is_lpc = kind == 3
    residual = residuals[0].copy()
    for k in (1, 2, 3):
        residual[kind == k] = residuals[k][kind == k]
    u = _zigzag(residual)
    body = np.arange(BLOCK)[None, :] >= order[:, None]
    u[~body] = 0
    guess = np.clip(np.log2(np.maximum(u.sum(1) / BLOCK, 1)).astype(np.int64), 0, 13)
    tries = np.stack([np.maximum(guess - 1, 0), guess, guess + 1])
    cost = np.stack([(u >> t[:, None]).sum(1) + BLOCK * t for t in tries])
    k = tries[cost.argmin(0), np.arange(n)]

    number, size = _frame_number(numbers)
    head = 5 + size
    bits_of = np.where(body, (u >> k[:, None]) + 1 + k[:, None], BITS)
    sub = 8 + np.where(is_lpc, 9 + LPC_ORDER * LPC_PRECISION, 0) + 10
    lengths = head + (sub + bits_of.sum(1) + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    # Within a frame: subframe header, warm-up, coefficients, residual header, residual.
    base = (starts + head) * 8
    ends = np.cumsum(bits_of, axis=1)
    begins = ends - bits_of
    at = base[:, None] + 8 + begins + np.where(body, (sub - 8)[:, None], 0)
    width = np.where(body, k[:, None] + 1, BITS)
    value = np.where(body, (1 << k[:, None]) | (u & ((1 << k[:, None]) - 1)), x & 0xFF)
    at = np.where(body, at + (u >> k[:, None]), at)
    fields = [(at.ravel(), value.ravel(), width.ravel())]
    kind_code = np.where(is_lpc, 0x20 | (LPC_ORDER - 1), 0x08 | order)
    fields.append((base, kind_code << 1, np.full(n, 8)))
    warm = base + 8 + order * BITS
    if is_lpc.any():
        w = warm[is_lpc]
        fields.append((w, np.full(len(w), ((LPC_PRECISION - 1) << 5) | LPC_SHIFT), np.full(len(w), 9)))
        for j in range(LPC_ORDER):
            fields.append((w + 9 + j * LPC_PRECISION, coefs[is_lpc, j] & ((1 << LPC_PRECISION) - 1), np.full(len(w), LPC_PRECISION)))
    fields.append((warm + sub - 18, k, np.full(n, 10)))
    pos, val, wid = (np.concatenate(c).astype(np.int64) for c in zip(*fields, strict=True))
    shifted = val << (24 - (pos & 7) - wid)
    total = int(lengths.sum())
    out = np.zeros(total + 3)
    for i, shift in enumerate((16, 8, 0)):
        out += np.bincount((pos >> 3) + i, (shifted >> shift) & 0xFF, total + 3)
    out = out[:total].astype(np.uint8)
    out[starts], out[starts + 1], out[starts + 2], out[starts + 3] = 0xFF, 0xF8, 0x14, 0x02
    for i in range(int(size.max(initial=0))):
        there = size > i
        out[starts[there] + 4 + i] = number[there, i]
    out[starts + head - 1] = _crcs(out, starts, head - 1, 8)
    crc = _crcs(out, starts, lengths - 2, 16)
    out[starts + lengths - 2], out[starts + lengths - 1] = crc >> 8, crc & 0xFF
    return out, lengths


def _stream_info(samples: int, sizes: np.ndarray, md5: bytes) -> bytes:
    packed = (RATE << 44) | ((BITS - 1) << 36) | samples
    return struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose size must be a positive multiple of BLOCK."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    if any(len(p) % BLOCK or not p for p in payloads):
        raise ValueError("payloads must be whole blocks")
    x = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128).reshape(-1, BLOCK)
    numbers = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
    parts, sizes = [], []
    for at in range(0, len(x), BATCH // BLOCK):
        data, lengths = encode_frames(x[at : at + BATCH // BLOCK], numbers[at : at + BATCH // BLOCK])
        parts.append(data.tobytes())
        sizes.append(lengths)
    frames, lengths = b"".join(parts), np.concatenate(sizes)
    ends = np.cumsum(lengths)
    out, first = [], 0
    for payload, n in zip(payloads, counts, strict=True):
        own = lengths[first : first + n]
        offsets = np.concatenate([[0], np.cumsum(own)[:-1]])
        seek = b"".join(struct.pack(">QQH", i * BLOCK, int(offsets[i]), BLOCK) for i in range(0, n, SEEK_FRAMES))
        samples = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = _stream_info(len(payload), own, hashlib.md5(samples).digest())
        start = int(ends[first - 1]) if first else 0
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + frames[start : int(ends[first + n - 1])])
        first += n
    return out


class Stream:
    """A stream's metadata: block size, sample count, bits, MD5, where frames start and the seek points."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise FlacError("no FLAC marker")
        at, last, self.seek, info = 4, False, [], None
        while not last:
            if at + 4 > len(data):
                raise FlacError("metadata ends early")
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                info = body
            elif kind == 3:
                self.seek = sorted(p[:2] for i in range(0, len(body), 18) if (p := struct.unpack(">QQH", body[i : i + 18]))[0] != (1 << 64) - 1)
            at += 4 + size
        if info is None or len(info) < 34:
            raise FlacError("no stream info")
        packed = int.from_bytes(info[10:18], "big")
        self.block, self.first = int.from_bytes(info[2:4], "big"), at
        self.channels, self.bits, self.samples, self.md5 = ((packed >> 41) & 7) + 1, ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1), info[18:34]
        if self.channels != 1 or self.bits > 16:
            raise FlacError("only mono streams of at most 16 bits are read")

    def seek_to(self, sample: int) -> tuple[int, int]:
        """The last seek point at or before a sample: its sample, and its byte in the stream."""
        at = bisect_right(self.seek, (sample, math.inf)) - 1
        sample_at, offset = self.seek[at] if at >= 0 else (0, 0)
        return sample_at, self.first + offset


def _bits(buffer: np.ndarray, pos: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """Up to 24 bits from each position on, as unsigned numbers."""
    at = pos >> 3
    word = (buffer[at].astype(np.int64) << 24) | (buffer[at + 1].astype(np.int64) << 16) | (buffer[at + 2].astype(np.int64) << 8) | buffer[at + 3]
    return ((word << (pos & 7)) & 0xFFFFFFFF) >> (32 - width)


def _signed(value: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    top = np.left_shift(1, np.asarray(width) - 1)
    return (value ^ top) - top


def _sizes(code: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Block sizes by header code; extra is what the header holds for codes 6 and 7."""
    return np.where(code == 1, 192, np.where(code < 6, 576 << np.clip(code - 2, 0, 3), np.where(code < 8, extra + 1, 256 << np.clip(code - 8, 0, 7))))


def _headers(buffer: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(valid, number, block size, header bytes) of what may be frame headers; the buffer has 16 bytes of padding."""
    code = (buffer[at + 2] >> 4).astype(np.int64)
    rate = buffer[at + 2] & 15
    lead = buffer[at + 4].astype(np.int64)
    more = np.where(lead < 0x80, 0, np.where(lead < 0xE0, 1, np.where(lead < 0xF0, 2, np.where(lead < 0xF8, 3, np.where(lead < 0xFC, 4, 5)))))
    number = np.where(more == 0, lead, lead & ((1 << np.maximum(0, 6 - more)) - 1))
    valid = ((lead < 0x80) | (lead >= 0xC0)) & (lead < 0xFE) & (code > 0)
    for i in range(5):
        byte = buffer[at + 5 + i].astype(np.int64)
        here = more > i
        valid &= ~here | ((byte & 0xC0) == 0x80)
        number = np.where(here, (number << 6) | (byte & 63), number)
    tail = at + 5 + more
    wide = np.where(code == 6, 1, np.where(code == 7, 2, 0))
    extra = np.where(code == 6, buffer[tail], buffer[tail].astype(np.int64) * 256 + buffer[tail + 1])
    size = 5 + more + wide + np.where(rate == 12, 1, np.where(rate >= 13, 2, 0))
    valid &= (rate != 15) & (_crcs(buffer, at, size, 8) == buffer[at + size])
    return valid, number, _sizes(code, extra), size + 1


def _decode_frames(buffer: np.ndarray, body: np.ndarray, blocks: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frames, largest block) of the frames whose subframes begin at byte `body`, and the bit where each ends."""
    n, longest = len(body), int(blocks.max())
    pos = body.astype(np.int64) * 8
    code = _bits(buffer, pos + 1, 6)
    wasted = _bits(buffer, pos + 7, 1)
    pos = pos + 8
    waste = np.zeros(n, np.int64)
    if wasted.any():
        run = np.zeros(n, np.int64)
        while True:
            zero = wasted.astype(bool) & (_bits(buffer, pos + run, 1) == 0)
            if not zero.any():
                break
            run[zero] += 1
        waste = np.where(wasted, run + 1, 0)
        pos = pos + waste
    bits = bits - waste
    constant, verbatim, fixed, linear = code == 0, code == 1, (code & 0x38) == 8, code >= 32
    if not (constant | verbatim | fixed | linear).all() or (fixed & ((code & 7) > 4)).any():
        raise FlacError("reserved subframe type")
    order = np.where(fixed, code & 7, np.where(linear, (code & 31) + 1, 0))
    most = int(order.max())
    x = np.zeros((n, longest), np.int64)
    single = np.where(constant, 1, np.where(verbatim, blocks, order))
    for i in range(int(single.max())):
        here = single > i
        x[here, i] = _signed(_bits(buffer, pos[here], bits[here]), bits[here])
        pos[here] += bits[here]
    x[constant] = x[constant, :1]
    coefs = np.zeros((n, max(1, most)), np.int64)
    shift = np.zeros(n, np.int64)
    for o in range(1, min(4, most) + 1):
        coefs[fixed & (order == o), :o] = FIXED[o]
    if linear.any():
        at = pos[linear]
        precision = _bits(buffer, at, 4) + 1
        shift[linear] = _signed(_bits(buffer, at + 4, 5), 5)
        at = at + 9
        own = np.zeros((int(linear.sum()), most), np.int64)
        for j in range(most):
            here = order[linear] > j
            own[here, j] = _signed(_bits(buffer, at[here], precision[here]), precision[here])
            at[here] += precision[here]
        coefs[linear, :most] = own
        pos[linear] = at
        if (shift < 0).any():
            raise FlacError("negative shift")
    coded = fixed | linear
    if coded.any():
        which = np.flatnonzero(coded)
        p, o, c, s = pos[which], order[which], coefs[which], shift[which]
        method = _bits(buffer, p, 2)
        if (method > 1).any():
            raise FlacError("reserved residual method")
        wide = 4 + method
        part = blocks[which] >> _bits(buffer, p + 2, 4)
        size = blocks[which]
        p = p + 6
        k, raw = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        y = np.ascontiguousarray(x[which].T)
        same_parts = bool((part == part[0]).all() and (size == size[0]).all())
        escaped = False
        rows = np.arange(len(which))
        low = int(o.min())
        for i in range(longest):
            if i % int(part[0]) == 0 if same_parts else True:
                new = (i % part == 0) & (i < size)
                if i == 0:
                    new[:] = True
                if new.any():
                    k[new] = _bits(buffer, p[new], wide[new])
                    p[new] += wide[new]
                    escape = new & (k == (1 << wide) - 1)
                    raw[new] = 0
                    if escape.any():
                        raw[escape] = _bits(buffer, p[escape], 5) + 1
                        p[escape] += 5
                        escaped = True
            if i < low:
                continue
            every = i >= most and same_parts and not escaped
            here = rows if every else np.flatnonzero((i >= o) & (i < size))
            if not len(here):
                continue
            q0, k0 = (p, k) if every else (p[here], k[here])
            at = q0 >> 3
            word = (buffer[at].astype(np.int64) << 24) | (buffer[at + 1].astype(np.int64) << 16) | (buffer[at + 2].astype(np.int64) << 8) | buffer[at + 3]
            word = (word << (q0 & 7)) & 0xFFFFFFFF
            zeros = 32 - np.frexp(word.astype(np.float64))[1]
            far = np.flatnonzero((word < 256) | (zeros + 1 + k0 > 24))  # the code may go past these bits
            u = (zeros << k0) | ((word >> np.maximum(0, 31 - zeros - k0)) & ((1 << k0) - 1))
            step = zeros + 1 + k0
            if len(far):
                begin, run = q0[far], np.zeros(len(far), np.int64)
                while True:
                    window = _bits(buffer, np.minimum(begin + run, 8 * (len(buffer) - 8)), 16)
                    more = 16 - np.frexp(window.astype(np.float64))[1]  # none where the one bit is reached
                    run += more
                    if not more.any():
                        break
                    if (run > 8 * len(buffer)).any():
                        raise FlacError("a residual has no end")
                u[far] = (run << k0[far]) | np.where(k0[far] > 0, _bits(buffer, begin + run + 1, np.maximum(1, k0[far])), 0)
                step[far] = run + 1 + k0[far]
            r = (u >> 1) ^ -(u & 1)
            if escaped and (raw[here] > 0).any():
                is_raw = raw[here] > 0
                width = raw[here] - 1
                value = np.where(width > 0, _signed(_bits(buffer, q0, np.maximum(width, 1)), np.maximum(width, 1)), 0)
                r = np.where(is_raw, value, r)
                step = np.where(is_raw, width, step)
            if every:
                predicted = c[:, 0] * y[i - 1] if most else 0
                for j in range(1, most):
                    predicted = predicted + c[:, j] * y[i - 1 - j]
                y[i] = r + (predicted >> s) if most else r
                p = q0 + step
            else:
                predicted = np.zeros(len(here), np.int64)
                for j in range(min(most, i)):
                    predicted += c[here, j] * y[i - 1 - j, here]
                y[i, here] = r + (predicted >> s[here])
                p[here] = q0 + step
        x[which] = y.T
        pos[which] = p
    return x << waste[:, None], pos


def read_at(data: bytes, sample: int, count: int) -> np.ndarray:
    """`count` samples from `sample` on (fewer at the end), decoded from the last seek point before them; frames before it are not read."""
    stream = Stream(data)
    begin, at = stream.seek_to(sample)
    stop = min(sample + count, stream.samples)
    return _walk(data, stream, begin, at, stop)[sample - begin : stop - begin] if stop > sample else np.zeros(0, np.int64)


def _walk(data: bytes, stream: Stream, got: int = 0, at: int = 0, most: int | None = None) -> np.ndarray:
    """The samples of one stream, frame after frame; from sample `got` at byte `at`, up to `most`."""
    buffer = np.frombuffer(data + bytes(32), np.uint8)
    at, parts, begin, most = at or stream.first, [], got, stream.samples if most is None else most
    while got < most:
        if at + 6 > len(data):
            raise FlacError("the stream ends early")
        here = np.array([at])
        valid, _, blocks, size = _headers(buffer, here)
        if buffer[at] != 0xFF or buffer[at + 1] & 0xFE != 0xF8 or not valid[0]:
            raise FlacError(f"no frame at byte {at}")
        samples, end = _decode_frames(buffer, here + size, blocks, np.array([stream.bits]))
        stop = (int(end[0]) + 7) // 8 + 2
        if _crcs(buffer, here, np.array([stop - at]), 16)[0]:
            raise FlacError(f"checksum of the frame at byte {at}")
        parts.append(samples[0])
        at, got = stop, got + len(samples[0])
    return np.concatenate(parts)[: most - begin] if parts else np.zeros(0, np.int64)


def decode(media: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream. Raises FlacError for a checksum that doesn't hold."""
    streams = [Stream(m) for m in media]
    buffer = np.frombuffer(b"".join(media) + bytes(32), np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(m) for m in media])]).astype(np.int64)
    found = np.flatnonzero((buffer[:-32] == 0xFF) & (buffer[1:-31] == 0xF8))
    owner = np.searchsorted(begins, found, "right") - 1
    firsts = begins[:-1] + [s.first for s in streams]
    keep = found >= firsts[owner] if len(found) else np.zeros(0, bool)
    found, owner = found[keep], owner[keep]
    valid, number, blocks, size = _headers(buffer, found) if len(found) else (np.zeros(0, bool),) * 4
    found, owner, number, blocks, size = (a[valid] for a in (found, owner, number, blocks, size))
    counts = np.array([-(-s.samples // s.block) for s in streams])
    have = np.bincount(owner, minlength=len(media))
    starts_at = np.cumsum(have) - have
    in_order = np.ones(len(media), bool)
    wrong = number != np.arange(len(found)) - starts_at[owner]
    in_order[owner[wrong]] = False
    ok = in_order & (have == counts)
    ends = np.append(found[1:], begins[-1]) if len(found) else found
    last = np.append(owner[1:] != owner[:-1], True) if len(found) else np.zeros(0, bool)
    ends = np.where(last, begins[owner + 1], ends)
    bad = _crcs(buffer, found, ends - found, 16) != 0
    ok[owner[bad]] = False
    use = ok[owner]
    out: list[np.ndarray | None] = [None] * len(media)
    if use.any():
        bits = np.array([s.bits for s in streams])[owner[use]]
        at, sizes = (found + size)[use], blocks[use]
        flat = []
        for i in range(0, len(at), BATCH // BLOCK):
            cut = slice(i, i + BATCH // BLOCK)
            x, _ = _decode_frames(buffer, at[cut], sizes[cut], bits[cut])
            flat.append(x.ravel() if (sizes[cut] == x.shape[1]).all() else x[np.arange(x.shape[1])[None, :] < sizes[cut][:, None]])
        samples = np.concatenate(flat)
        got = np.bincount(owner[use], sizes, len(media)).astype(np.int64)
        first = np.cumsum(got) - got
        for i in np.flatnonzero(ok):
            out[i] = samples[first[i] : first[i] + streams[i].samples]
    for i, stream in enumerate(streams):
        if out[i] is None:
            out[i] = _walk(media[i], stream)
        if stream.md5 != bytes(16) and hashlib.md5(_pcm(out[i], stream.bits)).digest() != stream.md5:
            raise FlacError("the samples' MD5 differs")
    return out


def _pcm(samples: np.ndarray, bits: int) -> bytes:
    """Signed little-endian bytes."""
    return samples.astype(np.int8 if bits <= 8 else "<i2").tobytes()


def _padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


def store(docs: DataFrame, column: str = "text", media: str = "media") -> DataFrame:
    """`docs` without `column`, with `n_bytes` long and the FLAC stream `media` of its UTF-8 bytes, blank-padded to whole blocks.

    Null and empty texts are one block of blanks. Repeated rows stay; texts may have any length.
    """
    keep = docs.drop("n_bytes", media)
    rest = [c for c in keep.columns if c != column]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, BATCH):
            data = texts(part, column)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array([len(t) for t in data], pa.int64()), pa.array(encode([_padded(t) for t in data]), pa.binary())], [*rest, "n_bytes", media])

    return keep.mapInArrow(work, plus(keep.drop(column), f"n_bytes long, `{media}` binary"))


def blocks_of(media: bytes, samples: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first sample, byte of the stream where a reader that seeks there begins, samples) of each PCM block of `size` samples."""
    stream = Stream(media)
    for at in range(0, len(samples), size):
        yield at, stream.seek_to(at)[1], samples[at : at + size]


def read_back(stored: DataFrame, media: str = "media", seconds: float = 1.0) -> DataFrame:
    """`stored` without its media, with media_bytes, media_sha256 and what decoding gives: payload_bytes, payload_sha256, tail_crc32, feature.

    All are gathered from the stream's PCM blocks in order. The feature holds the samples' sum, sum of squares, sign changes,
    least and greatest value, the number of blocks, and the last block's first sample and stream byte. Null media: nulls.
    A stream that is damaged raises FlacError. Columns of `stored` with these names are replaced.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    stored = stored.drop(*(n for n in names if n != media))
    rest = [c for c in stored.columns if c != media]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    size = max(1, int(RATE * seconds))

    def facts(stream: bytes, samples: np.ndarray) -> tuple:
        digest, tail, total, energy, turns, blocks, last, low, high = hashlib.sha256(), b"", 0, 0, 0, 0, None, [], []
        first = seek = 0
        for first, seek, x in blocks_of(stream, samples, size):
            payload = (x + 128).astype(np.uint8).tobytes()
            digest.update(payload)
            tail = (tail + payload)[-16:]
            minus = np.signbit(x)
            turns += int(np.count_nonzero(minus[1:] != minus[:-1])) + (last is not None and bool(minus[0] != last))
            blocks, last, total, energy = blocks + 1, minus[-1], total + int(x.sum()), energy + int((x * x).sum())
            low.append(int(x.min()))
            high.append(int(x.max()))
        feature = f"sum={total};energy={energy};turns={turns};min={min(low)};max={max(high)};blocks={blocks};last={first}@{seek}" if blocks else ""
        return len(samples), digest.hexdigest(), zlib.crc32(tail), len(stream), hashlib.sha256(stream).hexdigest(), feature

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, media, BATCH):
            raw = part.column(media).to_pylist()
            there = [m for m in raw if m is not None]
            found = iter([facts(m, x) for m, x in zip(there, decode(there), strict=True)] if there else [])
            rows = [next(found) if m is not None else (None,) * 6 for m in raw]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [*rest, *names])

    kept = stored.drop(media)
    return stored.mapInArrow(work, plus(kept, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"))


def pcm_blocks(stored: DataFrame, media: str = "media", seconds: float = 1.0) -> DataFrame:
    """A row per block of decoded sound: the other columns, block_no int, first_sample long, n_samples int, stream_byte long, pcm binary.

    first_sample is the block's place in the stream; stream_byte is where a reader that seeks there begins, by the seek
    table (`read_at` reads from there). PCM is signed and little-endian. Columns of `stored` with these names are replaced.
    """
    stored = stored.drop(*(n for n in ("block_no", "first_sample", "n_samples", "stream_byte", "pcm") if n != media))
    rest = [c for c in stored.columns if c != media]
    size = max(1, int(RATE * seconds))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, media, BATCH):
            raw = part.column(media).to_pylist()
            rows = []
            there = [i for i, m in enumerate(raw) if m is not None]
            for i, x in zip(there, decode([raw[i] for i in there]) if there else [], strict=True):
                bits = Stream(raw[i]).bits
                rows += [(i, at // size, at, len(own), seek, _pcm(own, bits)) for at, seek, own in blocks_of(raw[i], x, size)]
            if rows:
                own = list(zip(*rows, strict=True))
                which = pa.array(own[0], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(which) for c in rest), pa.array(own[1], pa.int32()), pa.array(own[2], pa.int64()), pa.array(own[3], pa.int32()), pa.array(own[4], pa.int64()), pa.array(own[5], pa.binary())], [*rest, "block_no", "first_sample", "n_samples", "stream_byte", "pcm"])

    return stored.mapInArrow(work, plus(stored.drop(media), "block_no int, first_sample long, n_samples int, stream_byte long, pcm binary"))


def op1_flac(spark, sf_dir: str) -> DataFrame:
    """The stored stream's facts for every document, read back. Null and empty texts are 192 blanks; repeated rows stay, and equal texts have equal values."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_back(store(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
