"""Counting quotient filters: lossless sorted counters of packed n-grams.

An n-gram of up to three word ids is packed into two halves and permuted by a Feistel network,
which can be undone. The first bits of the permuted key choose a range, the next ones are the
quotient, and all other bits are kept as the remainder, so that nothing is lost and nothing
collides. A filter has one bit for every quotient (is it occupied), one for every slot (does it end
the run of its quotient), the remainders, and counters of one byte with longer ones aside. Filters
of one range are sorted alike and merge in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rounds of the permutation and their odd multipliers.
ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def half_bits(most_id: int) -> int:
    """Bits u so that ids up to most_id have 2 u bits at most; a packed n-gram has halves of 3 u."""
    u = max(1, -(-int(most_id).bit_length() // 2))
    if u > 16:
        raise ValueError("word ids beyond 32 bits")
    return u


def pack(a: np.ndarray, b: np.ndarray, c: np.ndarray, u: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves of three ids each."""
    a, b, c = (x.astype(np.uint64) for x in (a, b, c))
    return a << np.uint64(u) | b >> np.uint64(u), (b & np.uint64((1 << u) - 1)) << np.uint64(2 * u) | c


def unpack(left: np.ndarray, right: np.ndarray, u: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, whole = np.uint64((1 << u) - 1), np.uint64((1 << 2 * u) - 1)
    b = (left & low) << np.uint64(u) | right >> np.uint64(2 * u)
    return tuple(x.astype(np.int64) for x in (left >> np.uint64(u), b, right & whole))


def _mixed(half: np.ndarray, by: int, bits: int) -> np.ndarray:
    h = (half + np.uint64(1)) * np.uint64(by)
    return (h ^ h >> np.uint64(29)) * np.uint64(by) >> np.uint64(64 - bits)


def permute(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    for by in ROUNDS:
        left, right = right, left ^ _mixed(right, by, bits)
    return left, right


def unpermute(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    for by in reversed(ROUNDS):
        left, right = right ^ _mixed(left, by, bits), left
    return left, right


def _to_bytes(values: np.ndarray, bits: int) -> bytes:
    """The low bits of every value in as few whole bytes as hold them."""
    width = -(-bits // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() if width else b""


def _from_bytes(data: bytes, bits: int, n: int) -> np.ndarray:
    width = -(-bits // 8)
    out = np.zeros((n, 8), np.uint8)
    if width:
        out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def summed(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(left):
        return left, right, n
    order = np.lexsort((right, left))
    left, right, n = left[order], right[order], n[order]
    first = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    return left[first], right[first], np.add.reduceat(n, first)


@dataclass(frozen=True)
class QuotientFilter:
    """Counters of permuted keys of one range (`skip` leading bits, left out of the filter)."""

    half: int  # bits of a half
    skip: int  # bits that the range fixes
    q: int  # bits of the quotient
    n: int  # slots
    occupied: bytes
    runends: bytes
    remainders: bytes
    counters: bytes

    @classmethod
    def build(cls, left: np.ndarray, right: np.ndarray, n: np.ndarray, half: int, skip: int) -> QuotientFilter:
        """From sorted distinct keys of one range."""
        # About one slot for each quotient.
        q = min(max(len(left).bit_length() - 1, 0), half - skip)
        rest = half - skip - q
        inside = left & np.uint64((1 << (half - skip)) - 1)
        quotient = (inside >> np.uint64(rest)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        runends = np.r_[quotient[1:] != quotient[:-1], True] if len(quotient) else np.zeros(0, bool)
        remainders = _to_bytes(inside & np.uint64((1 << rest) - 1), rest) + _to_bytes(right, half)
        long = n >= 255
        counters = np.where(long, 255, n).astype(np.uint8).tobytes() + n[long].astype("<u8").tobytes()
        return cls(half, skip, q, len(left), np.packbits(occupied).tobytes(), np.packbits(runends).tobytes(), remainders, counters)

    def entries(self, range_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The permuted keys in order and their counts; `range_`: the leading bits."""
        none = np.zeros(0, np.uint64)
        if not self.n:
            return none, none, np.zeros(0, np.int64)
        rest = self.half - self.skip - self.q
        quotients = np.flatnonzero(np.unpackbits(np.frombuffer(self.occupied, np.uint8), count=1 << self.q))
        ends = np.unpackbits(np.frombuffer(self.runends, np.uint8), count=self.n)
        quotient = quotients[np.cumsum(ends) - ends].astype(np.uint64)
        wide = -(-rest // 8) * self.n
        low = _from_bytes(self.remainders[:wide], rest, self.n)
        right = _from_bytes(self.remainders[wide:], self.half, self.n)
        counts = np.frombuffer(self.counters[: self.n], np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(self.counters[self.n :], "<u8").astype(np.int64)
        left = np.uint64(range_) << np.uint64(self.half - self.skip) | quotient << np.uint64(rest) | low
        return left, right, counts


def merged(filters: list[QuotientFilter], range_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted entries of filters of one range, counts of equal keys added."""
    size = sum(f.n for f in filters)
    left, right, n, at = np.empty(size, np.uint64), np.empty(size, np.uint64), np.empty(size, np.int64), 0
    for f in filters:
        to = slice(at, at := at + f.n)
        left[to], right[to], n[to] = f.entries(range_)
    return summed(left, right, n)
