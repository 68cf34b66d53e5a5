"""Static range asymmetric numeral system over token ids, many blocks at a time.

A 64-bit state and 32-bit renormalisation with frequencies scaled to 2**20. A block holds ``LANES`` interleaved states
and is independent of all others: its checkpoint (place, size, tokens, checksum) is all that a decoder needs.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LANES = 64
STEPS = 512
BLOCK = LANES * STEPS
MAGIC = b"LDSRANS1"
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<8sIQII")
_MARK = np.dtype([("first", "<u8"), ("tokens", "<u4"), ("at", "<u8"), ("size", "<u4"), ("crc", "<u4")])


class Table:
    """Frequencies scaled to 2**SCALE; every id that occurs has one of at least 1."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.float64)
        seen = np.flatnonzero(counts)
        if not len(seen):
            seen, counts = np.array([0]), np.ones(1)
        if len(seen) > 1 << (SCALE - 1):
            raise ValueError("too many distinct ids for the scale")
        f = np.maximum(1, np.floor(counts[seen] * ((1 << SCALE) / counts[seen].sum()))).astype(np.int64)
        order = np.argsort(-f, kind="stable")
        over = int(f.sum()) - (1 << SCALE)
        k = 0
        while over:  # the most frequent ids take up what rounding left or took
            i = order[k % len(order)]
            step = -over if over < 0 else min(over, max(0, int(f[i]) // 2))
            f[i] -= over if over < 0 else step
            over = 0 if over < 0 else over - step
            k += 1
        self.freq = np.zeros(int(seen[-1]) + 1, np.uint64)
        self.freq[seen] = f
        self.cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.freq)[:-1]])
        self.fill = int(seen[order[0]])
        self.crc = zlib.crc32(self.freq.tobytes())
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_shard(ids: np.ndarray, table: Table, group: int = 64) -> bytes:
    """All tokens of a shard: header, checkpoints, blocks."""
    n, marks, body, at = len(ids), [], [], 0
    for first in range(0, n, BLOCK * group):
        part = ids[first : first + BLOCK * group]
        nb = -(-len(part) // BLOCK)
        full = np.full(nb * BLOCK, table.fill, np.int64)
        full[: len(part)] = part
        sym = full.reshape(nb, STEPS, LANES)
        x = np.full((nb, LANES), _LOW, np.uint64)
        masks, words = np.empty((STEPS, nb, LANES), bool), np.empty((STEPS, nb, LANES), np.uint32)
        for t in range(STEPS - 1, -1, -1):
            f = table.freq[sym[:, t]]
            m = x >= (f << np.uint64(63 - SCALE))
            masks[t], words[t] = m, x  # the low half of the state
            x = np.where(m, x >> np.uint64(32), x)
            q = x // f
            x = (q << np.uint64(SCALE)) + (x - q * f) + table.cum[sym[:, t]]
        for b in range(nb):
            data = x[b].astype("<u8").tobytes() + words[:, b][masks[:, b]].astype("<u4").tobytes()
            marks.append((first + b * BLOCK, min(BLOCK, len(part) - b * BLOCK), at, len(data), zlib.crc32(data)))
            body.append(data)
            at += len(data)
    return _HEAD.pack(MAGIC, len(marks), n, LANES, table.crc) + np.array(marks, _MARK).tobytes() + b"".join(body)


def checkpoints(data: bytes) -> np.ndarray:
    """The block directory of a shard."""
    magic, blocks, _, lanes, _ = _HEAD.unpack_from(data)
    if magic != MAGIC or lanes != LANES:
        raise ValueError("not a shard of this format")
    return np.frombuffer(data, _MARK, blocks, _HEAD.size)


def decode_blocks(data: bytes, table: Table, which: range | None = None, group: int = 64) -> np.ndarray:
    """Tokens of the blocks ``which`` (all by default); raises ValueError on a wrong table or a damaged block."""
    marks = checkpoints(data)
    if _HEAD.unpack_from(data)[4] != table.crc:
        raise ValueError("shard was written with another frequency table")
    base, out = _HEAD.size + marks.nbytes, []
    chosen = marks if which is None else marks[which.start : which.stop]
    mask = np.uint64((1 << SCALE) - 1)
    for g in range(0, len(chosen), group):
        part = chosen[g : g + group]
        raw = [data[base + int(m["at"]) : base + int(m["at"]) + int(m["size"])] for m in part]
        for m, r in zip(part, raw, strict=True):
            if zlib.crc32(r) != m["crc"]:
                raise ValueError(f"block at token {m['first']} is damaged")
        x = np.stack([np.frombuffer(r, "<u8", LANES) for r in raw]).astype(np.uint64)
        stream = np.concatenate([*(np.frombuffer(r, "<u4", -1, 8 * LANES) for r in raw), np.zeros(1, np.uint32)]).astype(np.uint64)
        ptr = np.cumsum([0, *((len(r) - 8 * LANES) // 4 for r in raw[:-1])])
        got = np.empty((len(raw), STEPS, LANES), np.uint32)
        for t in range(STEPS):
            slot = x & mask
            s = table.slots[slot]
            got[:, t] = s
            x = table.freq[s] * (x >> np.uint64(SCALE)) + slot - table.cum[s]
            m = x < _LOW
            rank = np.cumsum(m, axis=1)
            x = np.where(m, (x << np.uint64(32)) | stream[np.minimum(ptr[:, None] + rank - 1, len(stream) - 1)], x)
            ptr = ptr + rank[:, -1]
        out += [got[i].reshape(-1)[: int(m["tokens"])] for i, m in enumerate(part)]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
