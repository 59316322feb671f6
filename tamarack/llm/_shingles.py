"""Word shingles of whole Arrow batches as 64-bit hashes."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


_OTHER = re.compile(r"[^\x00-\x7f]")


class _Bare(dict):
    """character -> the character without its accents; an accent alone -> nothing."""

    def __missing__(self, char: str) -> str:
        value = self[char] = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        return value


_bare = _Bare()

_M = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """word -> signed 64-bit hash, the same in every process; forgets all when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)
        return value


_ids = _Ids()


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else _OTHER.sub(lambda m: _bare[m.group()], text)


def words(text: str) -> list[str]:
    """Runs of letters and digits after lower-casing and dropping accents."""
    return WORD.findall(fold(text))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words, in order; empty if there are fewer words."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * _M + ids[i : i + n]
        return mix(h)


#: Code points whose words are hashed together; a longer text is hashed by itself.
CHUNK = 100_000

_SPACE, _DROPPED, _SEVERAL = np.uint64(0), np.uint64(1), np.uint64(2)  # every letter has a larger value


class _Letters:
    """Value of each code point: of its letter or digit without accents, or why it has none."""

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, bool)
        self.value = np.zeros(0x110000, np.uint64)
        self.power = np.ones(1, np.uint64)

    def of(self, points: np.ndarray) -> np.ndarray:
        if not self.known[points].all():
            for p in np.unique(points[~self.known[points]]).tolist():
                bare = _bare[chr(p)] if p > 127 else chr(p)
                if len(bare) == 1:
                    self.value[p] = (int(mix(np.array([ord(bare) + 1], np.uint64) * _M)[0]) | 4) if bare.isalnum() else _SPACE
                else:
                    self.value[p] = _SEVERAL if bare else _DROPPED
                self.known[p] = True
        return self.value[points]

    def powers(self, n: int) -> np.ndarray:
        """Powers of an odd number for the first n places in a word."""
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                self.power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _M)]))
        return self.power


_letters = _Letters()


def _chunk_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    value = _letters.of(points)
    if (value == _SEVERAL).any():  # letters that come apart into several, such as Hangul syllables
        lowered = [fold(t) for t in texts]
        points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        value = _letters.of(points)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    kept = np.flatnonzero(value != _DROPPED)
    value = value[kept]
    inside = np.concatenate([[False], value != _SPACE, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, after = edges[::2], edges[1::2]
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    lengths = after - first
    at = np.cumsum(lengths) - lengths  # of each word among the letters
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    with np.errstate(over="ignore"):
        letters = value[inside[1:-1]] * _letters.powers(int(lengths.max()))[place]
        ids = mix(np.add.reduceat(letters, at))
    return ids, np.searchsorted(kept[first], ends)


def batch_word_ids(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, the same for the same word in every process.

    Works on the letters of many texts at once; words are those of :func:`words`.
    """
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        size, end = 0, k
        while end < len(texts) and (end == k or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        ids, ends = _chunk_ids(texts[k:end])
        starts = np.concatenate([[0], ends[:-1]])
        out += [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        k = end
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def shingle_set(text: str, k: int) -> np.ndarray:
    """Distinct shingles of a text, sorted."""
    return distinct(shingles(batch_word_ids([text])[0], k))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """:func:`shingle_set` of each text."""
    return [distinct(shingles(w, k)) for w in batch_word_ids(texts)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted distinct sets; 0 if both are empty."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def content_class(text: str, shingle: np.ndarray) -> bytes:
    """16 bytes that two texts share if their shingle sets are equal; without shingles, if the texts are."""
    if len(shingle):
        return xxhash.xxh3_128_digest(shingle.tobytes())
    return xxhash.xxh3_128_digest(b"\0" + text.encode("utf-8", "surrogatepass"))
