"""CRC-32C for many byte strings at once.

All strings advance by one byte together, so a step is one gather over a 256-entry table. Long strings
are cut into pieces that are checked side by side and put together by the operator that appends zeros.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected
PIECE = 1024


@lru_cache
def byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


@lru_cache
def piece_shift() -> np.ndarray:
    """Four tables: the register's bytes, moved over PIECE zero bytes."""
    t = byte_table()
    state = (np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
    for _ in range(PIECE):
        state = t[state & 0xFF] ^ (state >> 8)
    return state


def registers(pieces: list[bytes], start: np.ndarray) -> np.ndarray:
    """The raw registers after each piece, from the given ones."""
    t, out = byte_table(), start.astype(np.uint32)
    sizes = np.array([len(p) for p in pieces], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes, state = sizes[order], out[order]
    width = int(sizes[0]) if len(sizes) else 0
    block = np.zeros((len(pieces), width), np.uint8)
    for row, i in enumerate(order.tolist()):
        block[row, : sizes[row]] = np.frombuffer(pieces[i], np.uint8)
    block = np.ascontiguousarray(block.T)
    for col in range(width):
        live = int(np.searchsorted(-sizes, -col, side="left"))  # rows longer than col
        part = state[:live]
        state[:live] = t[(part ^ block[col, :live]) & 0xFF] ^ (part >> 8)
    out = np.empty_like(state)
    out[order] = state
    return out


def crc32c_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: int = 2048) -> np.ndarray:
    """The CRC-32C of each span of ``data`` (uint8); spans of up to PIECE bytes are gathered ``rows`` at a time."""
    out, t = np.zeros(len(starts), np.uint32), byte_table()
    order = np.argsort(-sizes, kind="stable")
    long = int(np.searchsorted(-sizes[order], -PIECE, side="left"))
    if long:
        out[order[:long]] = crc32c_many([data[a : a + n].tobytes() for a, n in zip(starts[order[:long]].tolist(), sizes[order[:long]].tolist(), strict=True)])
    for at in range(long, len(order), rows):
        some = order[at : at + rows]
        n = sizes[some]
        block = data[np.minimum(starts[some] + np.arange(int(n[0]))[:, None], len(data) - 1)] if n[0] else np.zeros((0, len(some)), np.uint8)
        live = np.searchsorted(-n, -np.arange(int(n[0])), side="left")  # spans longer than each column
        state = np.full(len(some), 0xFFFFFFFF, np.uint32)
        for col, k in enumerate(live.tolist()):
            part = state[:k]
            state[:k] = t[(part ^ block[col, :k]) & 0xFF] ^ (part >> 8)
        out[some] = state ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """The CRC-32C of each value."""
    pieces, owner, first = [], [], []
    for i, v in enumerate(values):
        head = len(v) % PIECE if len(v) > PIECE else len(v)
        cuts = [v[:head], *(v[a : a + PIECE] for a in range(head, len(v), PIECE))]
        first.extend([True] + [False] * (len(cuts) - 1))
        owner.extend([i] * len(cuts))
        pieces.extend(cuts)
    raw = registers(pieces, np.where(first, np.uint32(0xFFFFFFFF), np.uint32(0))) if pieces else np.zeros(0, np.uint32)
    out, tables = np.zeros(len(values), np.uint32), None
    for i, r, new in zip(owner, raw.tolist(), first, strict=True):
        if not new:
            tables = piece_shift() if tables is None else tables
            s = int(out[i])
            r ^= int(tables[0][s & 255] ^ tables[1][s >> 8 & 255] ^ tables[2][s >> 16 & 255] ^ tables[3][s >> 24])
        out[i] = r
    return out ^ np.uint32(0xFFFFFFFF)


def crc32c(value: bytes) -> int:
    return int(crc32c_many([value])[0])
