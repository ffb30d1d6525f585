"""Vectorised word and shingle hashing over blocks of UTF-8 texts.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; A-Z are
lower-cased first. A word's 64-bit hash is a random-table polynomial over its
bytes, computed for a whole block of texts at once with prefix sums; a
shingle's hash mixes its words' hashes in order. Null and empty texts have no
words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

# Fixed seed: hashes must agree between executors and between runs.
_RNG = np.random.default_rng(0x5EED_0001)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: For terms: everything but ASCII letters and digits and bytes of other scripts separates.
PUNCTUATION = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
_P = np.uint64(0x9E3779B97F4A7C55)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _P), ("down", _P_INV)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def blocks(texts: Sequence[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about ``limit`` bytes together, with the index of their first."""
    first, size, run = 0, 0, []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if run and size + len(raw) > limit:
            yield first, run
            first, size, run = i, 0, []
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def word_hashes(raws: list[bytes], separators: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the offsets of each text's words (one more than texts).

    With ``prefixes``, the beginnings of so many bytes of longer words follow each text's words.
    """
    between = bytes([int(np.flatnonzero(separators)[0])])
    flat = np.frombuffer(between.join([*raws, b""]) or between, dtype=np.uint8)
    space = separators[flat]
    word = ~space
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[flat] * up[: len(flat)], out=sums[1:])
    lengths = np.fromiter((len(r) + 1 for r in raws), dtype=np.int64, count=len(raws))
    at = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    if not prefixes:
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), at
    spans = [(starts, ends), *((starts[long], starts[long] + n) for n in prefixes for long in [ends - starts > n])]
    hashes = np.concatenate([mix((sums[b] - sums[a]) * down[a] + np.uint64(64 * (i > 0)) + (b - a).astype(np.uint64)) for i, (a, b) in enumerate(spans)])
    text = np.concatenate([np.searchsorted(at, np.flatnonzero(ends - starts > n) if i else np.arange(len(starts)), side="right") for i, n in enumerate((0, *prefixes))])
    order = np.argsort(text, kind="stable")
    return hashes[order], np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(at))[1:])])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one text; of the whole text if it has fewer, and none without words."""
    n = len(words)
    if n == 0:
        return words
    k_here = min(k, n)
    out = np.full(n - k_here + 1, np.uint64(k_here), dtype=np.uint64)
    for j in range(k_here):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[j : n - k_here + 1 + j])
    return out


def shingle_sets(texts: Sequence[str | None], k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for _, raws in blocks(texts):
        words, at = word_hashes(raws)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(shingle_hashes(words[a:b], k))
