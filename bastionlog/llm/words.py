"""Words of texts as numpy arrays: byte spans, 64-bit hashes and hashes of word windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
PIECE_BYTES = 1 << 20


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse_base = base, _inverse(base)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (
                np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))), dtype=np.uint64)
                for b in (self.base, self.inverse_base)
            )
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS = Powers(BYTE_BASE), Powers(WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_class(chosen) -> np.ndarray:
    """A table of 256 flags from a rule on the byte's value."""
    return np.array([bool(chosen(b)) for b in range(256)])


#: Bytes of words that white space alone parts: everything but 0x20 and 0x09 to 0x0D.
NOT_BLANK = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of lower-cased words of letters, digits and whatever is not ASCII.
WORD_BYTES = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def spans(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of bytes in the class."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = member[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are in order and do not overlap.

    Works through pieces of about a megabyte (or one longer span), so memory follows the number of
    spans, not the length of the text times the size of a hash.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + PIECE_BYTES, side="right")))
        last = int(ends[stop - 1])
        up, down = BYTE_POWERS.upto(last - base + 1)
        total = np.zeros(last - base + 1, dtype=np.uint64)
        np.cumsum((data[base:last].astype(np.uint64) + np.uint64(1)) * up[: last - base], out=total[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes, by its start."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = WORD_POWERS.upto(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[size:] - total[:n]) * down[:n])


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def shards(texts: Sequence[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into runs of at most ``most`` bytes; a longer text is a run of its own."""
    begin = total = 0
    for i, text in enumerate(texts):
        if i > begin and total + len(text) > most:
            yield begin, i
            begin, total = i, 0
        total += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def joined(texts: Sequence[bytes], member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end, parted by a blank: bytes, word starts, word ends, first word of each text
    (one more entry than texts)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts, ends = spans(data, member)
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return data, starts, ends, first
