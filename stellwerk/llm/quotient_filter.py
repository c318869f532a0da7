"""Counting quotient filters as byte columns: lossless, compact and mergeable counters of packed keys.

A key of ``2 * half`` bits (``half`` up to 63) is held as two lanes of ``half`` bits. ``permuted`` shuffles all keys
of that width one-to-one (a Feistel network), so equal spread needs no hash that could collide, and ``restored`` is its
inverse. A filter sorts the permuted keys and splits each into a quotient, its first bits, and the full
remainder. Of the quotients it keeps one bit each (occupied or not), of the entries one bit (last of its quotient
or not), the remainder in as few bytes as it needs, and the count in as few bytes as the largest one needs.
Merging filters decodes them in order and adds the counts of equal keys.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from stellwerk.llm.columnar import mix

Keys = tuple[np.ndarray, np.ndarray]
_ROUNDS = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Filter(NamedTuple):
    """Keys in ``size`` entries, with ``quotient`` bits of quotient."""

    size: int
    quotient: int
    occupied: bytes
    ends: bytes
    remainders: bytes
    counts: bytes


def half_bits(ids: int, length: int) -> int:
    """Bits of each of the two lanes that hold ``length`` ids below ``ids``."""
    bits = max(int(ids - 1).bit_length(), 1)
    if bits * length > 126:
        raise ValueError(f"{ids} ids do not fit {126 // length} bits each")
    return -(-bits * length // 2)


def packed(ids: list[np.ndarray], n_ids: int) -> Keys:
    """Ids side by side, the first one leftmost, as two lanes."""
    bits, half = max(int(n_ids - 1).bit_length(), 1), half_bits(n_ids, len(ids))
    left, right = np.zeros(len(ids[0]), np.uint64), np.zeros(len(ids[0]), np.uint64)
    for i, values in enumerate(reversed(ids)):
        low, values = i * bits, values.astype(np.uint64)
        if low >= half:
            left |= values << np.uint64(low - half)
        else:
            right |= (values << np.uint64(low)) & np.uint64((1 << half) - 1)
            if low + bits > half:
                left |= values >> np.uint64(half - low)
    return left, right


def unpacked(keys: Keys, n_ids: int, length: int) -> list[np.ndarray]:
    """The ids that ``packed`` put together."""
    bits, half = max(int(n_ids - 1).bit_length(), 1), half_bits(n_ids, length)
    left, right = keys
    out = []
    for i in range(length):
        low = i * bits
        if low >= half:
            value = left >> np.uint64(low - half)
        else:
            value = right >> np.uint64(low)
            if low + bits > half:
                value |= left << np.uint64(half - low)
        out.append((value & np.uint64((1 << bits) - 1)).astype(np.int64))
    return out[::-1]


def permuted(keys: Keys, half: int) -> Keys:
    left, right = keys
    mask = np.uint64((1 << half) - 1)
    for c in _ROUNDS:
        left, right = right, left ^ (mix(right + c) & mask)
    return left, right


def restored(keys: Keys, half: int) -> Keys:
    left, right = keys
    mask = np.uint64((1 << half) - 1)
    for c in reversed(_ROUNDS):
        left, right = right ^ (mix(left + c) & mask), left
    return left, right


def counted(keys: Keys, half: int, counts: np.ndarray | None = None) -> tuple[Keys, np.ndarray]:
    """Each key once, in order, with the sum of its counts (one each if none are given)."""
    left, right = keys
    if not len(left):
        return keys, np.zeros(0, np.int64)
    if half <= 32:
        whole = (left << np.uint64(half)) | right
        if counts is None:
            whole.sort()
        else:
            order = np.argsort(whole, kind="stable")  # filters are in order already: their runs are merged
            whole = whole[order]
        left, right = whole >> np.uint64(half), whole & np.uint64((1 << half) - 1)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
    new = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
    first = np.flatnonzero(new)
    if counts is None:
        sums = np.diff(np.append(first, len(left)))
    else:
        sums = np.add.reduceat(counts[order], first)
    return (left[first], right[first]), sums.astype(np.int64)


def _to_bytes(values: np.ndarray, bits: int) -> bytes:
    """The last bytes of each value, as many as ``bits`` need."""
    wide = np.ascontiguousarray(values.astype(">u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(wide[:, 8 - (bits + 7) // 8 :]).tobytes()


def _from_bytes(data: bytes, n: int, bits: int) -> np.ndarray:
    wide, size = np.zeros((n, 8), np.uint8), (bits + 7) // 8
    if size:
        wide[:, 8 - size :] = np.frombuffer(data, np.uint8).reshape(n, size)
    return wide.view(">u8").ravel().astype(np.uint64)


def encode(keys: Keys, counts: np.ndarray, bits: tuple[int, int]) -> Filter:
    """A filter of permuted keys, in order and each once; ``bits`` of the left and the right lane."""
    (left, right), (left_bits, right_bits) = keys, bits
    n = len(left)
    q = min(n.bit_length(), left_bits)
    rest = left_bits - q
    quotients = left >> np.uint64(rest)
    occupied = np.zeros(1 << q, bool)
    occupied[quotients.astype(np.int64)] = True
    ends = np.append(quotients[1:] != quotients[:-1], True) if n else np.zeros(0, bool)
    remainders = _to_bytes(left & np.uint64((1 << rest) - 1), rest) + _to_bytes(right, right_bits)
    widest = int(counts.max(initial=1)).bit_length()
    return Filter(n, q, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainders, _to_bytes(counts, widest))


def decode(f: Filter, bits: tuple[int, int]) -> tuple[Keys, np.ndarray]:
    """The permuted keys of a filter, in order, and their counts."""
    left_bits, right_bits = bits
    if not f.size:
        return (np.zeros(0, np.uint64),) * 2, np.zeros(0, np.int64)
    rest = left_bits - f.quotient
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(f.occupied, np.uint8), count=1 << f.quotient))
    ends = np.unpackbits(np.frombuffer(f.ends, np.uint8), count=f.size).astype(np.int64)
    run = np.cumsum(ends) - ends  # the entry's place among the occupied quotients
    split = f.size * ((rest + 7) // 8)
    left = _from_bytes(f.remainders[:split], f.size, rest) | (occupied[run].astype(np.uint64) << np.uint64(rest))
    counts = _from_bytes(f.counts, f.size, 8 * (len(f.counts) // f.size)).astype(np.int64)
    return (left, _from_bytes(f.remainders[split:], f.size, right_bits)), counts


def merged(filters: list[Filter], bits: tuple[int, int]) -> tuple[Keys, np.ndarray]:
    """Keys of all filters, in order, with the sums of their counts."""
    parts = [decode(f, bits) for f in filters]
    left, right, counts = (np.concatenate(x) for x in zip(*[(*keys, n) for keys, n in parts]))
    return counted((left, right), max(bits), counts)
