"""Counting quotient filters over packed word-id n-grams: lossless counters in few bytes.

An n-gram of word ids is packed into limbs of given bit widths and permuted by
an invertible mix (an unbalanced Feistel network), which spreads it evenly. The
leading bits of the result name a bucket, the next ones the quotient; what is left is
the remainder, kept in full. A filter holds one bucket: the number of entries per quotient,
the remainders in quotient order, and the counts (one byte, longer ones apart).
Nothing is lost: bucket, quotient and remainder give the n-gram back.
Sorted filters of one bucket merge by adding counts.
"""

from __future__ import annotations

import numpy as np

from tickframe.llm.shingles import scramble

ROUNDS = 3
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HEAD = np.dtype([("entries", "<u4"), ("bits", "u1"), ("run_bytes", "u1"), ("large", "<u4")])

Limbs = list[np.ndarray]


def _masks(widths: tuple[int, ...]) -> list[np.uint64]:
    return [np.uint64((1 << w) - 1) for w in widths]


def permute(limbs: Limbs, widths: tuple[int, ...]) -> Limbs:
    """An invertible mix of at least two limbs; every limb ends up dependent on all of them."""
    out, masks, n = list(limbs), _masks(widths), len(limbs)
    with np.errstate(over="ignore"):
        for step in range(1, ROUNDS * n + 1):
            i = step % n
            out[i] = out[i] ^ scramble(out[i - 1] + np.uint64(step) * _STEP) & masks[i]
    return out


def restore(limbs: Limbs, widths: tuple[int, ...]) -> Limbs:
    out, masks, n = list(limbs), _masks(widths), len(limbs)
    with np.errstate(over="ignore"):
        for step in range(ROUNDS * n, 0, -1):
            i = step % n
            out[i] = out[i] ^ scramble(out[i - 1] + np.uint64(step) * _STEP) & masks[i]
    return out


def summed(limbs: Limbs, widths: tuple[int, ...], counts: np.ndarray | None = None) -> tuple[Limbs, np.ndarray]:
    """Distinct entries in ascending order with their counts added up (1 each without ``counts``)."""
    size = len(limbs[0])
    if not size:
        return limbs, np.zeros(0, np.int64)
    if sum(widths) <= 64:  # one sort key
        key = limbs[0]
        for x, w in zip(limbs[1:], widths[1:]):
            key = (key << np.uint64(w)) | x
        order = None if counts is None else np.argsort(key)
        key = np.sort(key) if order is None else key[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, limbs = key[start], []
        for x, w in zip(_masks(widths)[::-1], widths[::-1]):
            limbs.insert(0, key & x)
            key = key >> np.uint64(w)
    else:
        order = np.lexsort(limbs[::-1])
        limbs = [x[order] for x in limbs]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in limbs])
        start = np.flatnonzero(new)
        limbs = [x[start] for x in limbs]
    total = np.diff(np.r_[start, size]) if counts is None else np.add.reduceat(counts[order], start)
    return limbs, total.astype(np.int64)


def merged(parts: list[tuple[Limbs, np.ndarray]], widths: tuple[int, ...]) -> tuple[Limbs, np.ndarray]:
    """Sorted entry lists as one, counts added."""
    if len(parts) == 1:
        return parts[0]
    return summed([np.concatenate(x) for x in zip(*[limbs for limbs, _ in parts])], widths,
                  np.concatenate([c for _, c in parts]))


def _low_bytes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :-(-width // 8)]).tobytes()


def to_filter(limbs: Limbs, counts: np.ndarray, widths: tuple[int, ...], bucket_bits: int) -> bytes:
    """The filter of one bucket from its sorted entries (permuted limbs)."""
    n = len(counts)
    bits = min(max(n.bit_length() - 1, 0), widths[0] - bucket_bits)
    left = widths[0] - bucket_bits - bits
    quotient = (limbs[0] >> np.uint64(left)) & np.uint64((1 << bits) - 1)
    runs = np.bincount(quotient.astype(np.int64), minlength=1 << bits)
    run_bytes = 1 if runs.max(initial=0) < 256 else 4
    large = counts >= 255
    head = np.array([(n, bits, run_bytes, large.sum())], _HEAD)
    rest = limbs[0] & np.uint64((1 << left) - 1)
    return b"".join([head.tobytes(), runs.astype(f"<u{run_bytes}").tobytes(), _low_bytes(rest, left),
                     *[_low_bytes(x, w) for x, w in zip(limbs[1:], widths[1:])],
                     np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()])


def from_filter(data: bytes, widths: tuple[int, ...], bucket: int, bucket_bits: int) -> tuple[Limbs, np.ndarray]:
    """The sorted entries that :func:`to_filter` stored."""
    head = np.frombuffer(data, _HEAD, 1)[0]
    n, bits, at = int(head["entries"]), int(head["bits"]), _HEAD.itemsize
    runs = np.frombuffer(data, f"<u{head['run_bytes']}", 1 << bits, at)
    at += runs.nbytes
    left = widths[0] - bucket_bits - bits
    limbs = []
    for width in (left, *widths[1:]):
        size = -(-width // 8)
        full = np.zeros((n, 8), np.uint8)
        full[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
        limbs.append(full.view("<u8").ravel().astype(np.uint64))
        at += n * size
    quotient = np.repeat(np.arange(1 << bits, dtype=np.uint64), runs)
    limbs[0] |= (quotient | np.uint64(bucket << bits)) << np.uint64(left)
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", int(head["large"]), at + n)
    return limbs, counts


def by_bucket(limbs: Limbs, counts: np.ndarray, widths: tuple[int, ...], bucket_bits: int):
    """``(bucket, filter)`` for every bucket that the sorted entries touch."""
    bucket = (limbs[0] >> np.uint64(widths[0] - bucket_bits)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for lo, hi in zip(start, [*start[1:], len(bucket)]):
        yield int(bucket[lo]), to_filter([x[lo:hi] for x in limbs], counts[lo:hi], widths, bucket_bits)
