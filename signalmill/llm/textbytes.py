"""Vectorised hashing of byte strings, shared by the operators on shingles and on byte windows."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(0, 1 << 63, size=(2, 256), dtype=np.uint64) * U(2) + U(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**n modulo 2**64; kept between calls, grown when longer texts come."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        out = np.full(max(n + 1, 1 << 14) * 5 // 4, U(base))
        out[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(out)
    return have[: n + 1]


class Rolling:
    """Hashes of any ranges of a string of bytes, or of word hashes: a polynomial modulo 2**64 over prefix sums of random values."""

    def __init__(self, raw: np.ndarray, which: int = 0):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        value = _BYTES[which][raw] if raw.dtype == np.uint8 else mixed(raw + U(which)) | U(1)
        np.cumsum(value * powers(BASE, n)[:n], out=self.sums[1:])
        self.back = powers(INVERSE, n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all k-byte strings; one round of mixing, enough to order them at random."""
        n = len(self.sums) - 1 - k
        if n < 0:
            return np.zeros(0, np.uint64)
        h = (self.sums[k:] - self.sums[: n + 1]) * self.back[: n + 1]
        h ^= h >> U(29)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(32)
        return h


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of an unbroken run from which each of its characters is a word.
RUN = 300


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a UTF-8 text.

    Words stand between white space (Unicode's too) and go without the punctuation at their
    ends. In scripts without spaces (Han, kana, Thai, Lao, Khmer, Burmese) and in unbroken
    runs of RUN bytes every character is a word.
    """
    n = len(raw)
    gap, letter, begin = _SPACE[raw], _LETTER[raw], np.zeros(n + 4, bool)
    at = np.flatnonzero(raw >= 0xC2)
    if len(at):
        lead, b, c = raw[at], raw[np.minimum(at + 1, n - 1)], raw[np.minimum(at + 2, n - 1)]
        wide = (lead == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        wide |= (lead == 0xE3) & (b == 0x80) | (lead == 0xEF) & (b == 0xBC) & ((c <= 0x8F) | (c >= 0x9A) & (c <= 0xA0))
        for i in (at[(lead == 0xC2) & ((b == 0xA0) | (b == 0x85))], at[wide]):
            gap[i] = gap[i + 1] = True
        gap[at[wide] + 2] = True
        signs = at[(lead == 0xE2) & ((b == 0x80) | (b == 0x81))]
        letter[signs] = letter[signs + 1] = letter[signs + 2] = False
        signs = at[lead == 0xC2]
        letter[signs] = letter[signs + 1] = False
        alone = (lead == 0xE3) & (b > 0x80) | (lead >= 0xE4) & (lead <= 0xE9) | (lead == 0xE0) & (b >= 0xB8) & (b <= 0xBB)
        alone |= (lead == 0xE1) & ((b >= 0x80) & (b <= 0x82) | (b == 0x9E) | (b == 0x9F)) | (lead == 0xEF) & (b >= 0xA4) & (b <= 0xAB)
        begin[at[alone]] = begin[at[alone] + 3] = True
        alone = at[(lead == 0xF0) & (b >= 0xA0) & (b <= 0xAF)]
        begin[alone] = begin[alone + 4] = True
    begin = begin[:n]
    shut = gap & ~np.concatenate([[True], gap[:-1]])
    begin = (begin | np.concatenate([[True], gap[:-1]])[:n]) & ~gap

    def cut() -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(begin | shut)
        first = begin[edge]
        return edge[first], np.append(edge[1:], n)[: len(edge)][first]

    start, end = cut()
    long = np.flatnonzero(end - start >= RUN)
    if len(long):
        for i in long:
            begin[start[i] : end[i]] |= raw[start[i] : end[i]] & 0xC0 != 0x80
        start, end = cut()
    letters = np.flatnonzero(letter & ~gap)
    upto = np.concatenate([[0], np.cumsum(letter & ~gap)])
    a, z = upto[start], upto[end]
    some = z > a
    start[some], end[some] = letters[a[some]], letters[z[some] - 1] + 1
    return Rolling(raw).of(start, end), start, end


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, words `[^\\x20\\x09-\\x0D]+` in lower-case A-Z.

    Fewer words than k make one shingle of all of them; no words make none. All texts are
    hashed in one go.
    """
    raw = np.frombuffer(b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"\n", np.uint8)
    low = _LOWER[raw]
    gap = _SPACE[low]
    change = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    start, end = change[::2], change[1::2]
    words = Rolling(low).of(start, end)
    lengths = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
    grams = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        grams = mixed(grams * U(BASE) + words[j : j + len(grams)])
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = mixed(h * U(BASE) + w)
            out.append(mixed(h + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
