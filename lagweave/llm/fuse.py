"""Static binary-fuse filters: a key's three cells, in neighbouring segments, add up (xor) to its 8-bit fingerprint."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Seeds tried before the array is made larger.
TRIES = 20


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit keys for each seed: multiply and shift, twice."""
    h = keys.astype("u8") + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


@dataclass
class BinaryFuse:
    """About 9 bits a key; no key that it was built from is denied, and one in 256 of all others is affirmed."""

    seed: int
    length: int  # of a segment, a power of two
    segments: int  # in which a key's first cell may lie
    cells: np.ndarray

    def places(self, h: np.ndarray) -> np.ndarray:
        """[3, key]: a cell in each of three segments in a row."""
        first = ((h >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)
        bits, mask = int(self.length).bit_length() - 1, np.uint64(self.length - 1)
        inside = [h & mask, (h >> np.uint64(bits)) & mask, (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) if bits else h & mask]
        return np.stack([(first + np.uint64(k)) * np.uint64(self.length) + x for k, x in enumerate(inside)]).astype("i8")

    @staticmethod
    def prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(24)) ^ (h >> np.uint64(48))) & np.uint64(255)).astype("u1")

    def __contains__(self, key: int) -> bool:
        return bool(self.may_hold(np.array([key]))[0])

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        h = mixed(keys, self.seed)
        a, b, c = self.cells[self.places(h)]
        return (a ^ b ^ c) == self.prints(h)


def shape(n: int, larger: float = 1.0) -> tuple[int, int]:
    """A segment's length and the number of segments a first cell may lie in, for n keys."""
    length = 1 << min(18, max(0, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) * larger
    return length, max(1, int(np.ceil(room / length)) - 2)


def peeled(places: np.ndarray, cells: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the cell each one has to itself among the keys still there); None if some keys share all their cells.

    A cell's count and the xor of its keys' numbers tell which key is alone in it; all such keys leave in one round.
    """
    n = places.shape[1]
    numbers = np.arange(n)
    count = np.bincount(places.ravel(), minlength=cells)
    held = np.zeros(cells, "i8")
    np.bitwise_xor.at(held, places.ravel(), np.tile(numbers, 3))
    rounds, left, alone = [], n, np.flatnonzero(count == 1)
    while len(alone):
        keys, at = np.unique(held[alone], return_index=True)  # a key alone in several cells leaves by one of them
        rounds.append((keys, alone[at]))
        left -= len(keys)
        gone = places[:, keys]
        np.subtract.at(count, gone.ravel(), 1)
        np.bitwise_xor.at(held, gone.ravel(), np.tile(keys, 3))
        touched = np.unique(gone)
        alone = touched[count[touched] == 1]
    return None if left else rounds


def build(keys: np.ndarray) -> BinaryFuse:
    """The filter of these 64-bit keys; equal ones count once."""
    keys = np.unique(np.asarray(keys))
    for attempt in range(8 * TRIES):
        length, segments = shape(len(keys), 1.2 ** (attempt // TRIES))
        found = BinaryFuse(attempt, length, segments, np.zeros((segments + 2) * length, "u1"))
        h = mixed(keys, attempt)
        places, prints = found.places(h), found.prints(h)
        rounds = peeled(places, len(found.cells))
        if rounds is None:
            continue
        for own, cell in reversed(rounds):  # a round's cells are no other key's of that round, so all are set at once
            a, b, c = found.cells[places[:, own]]
            found.cells[cell] = prints[own] ^ a ^ b ^ c  # the cell itself is still 0
        return found
    raise ValueError("no filter was found")
