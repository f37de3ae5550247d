"""Words and shingle sets of a text, inside Python tasks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hashes of words (bytes), computed once per word; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def folded_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z: just what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: list[bytes], cache: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash per run of k words, in text order; fewer words make one shingle, no words none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    k_eff = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k_eff + 1, k_eff, np.uint64)
        for j in range(k_eff):
            out = out * _BASE + h[j:n - k_eff + 1 + j]
        return mixed(out)


def folded(text: str | None) -> bytes:
    return text.encode("utf-8", "replace").lower() if text else b""


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BREAK = re.compile(rb"[\t-\r ]")
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64))
#: Bytes hashed at a time. A word is a polynomial in _STEP over the values of its bytes, taken from running sums of
#: its block. 3 modulo 8 keeps permuted letters apart; longer words, where regular patterns might meet, use xxhash.
_BLOCK = 1 << 18
_LONG = 512
_STEP = 0xF1357AEA2E62A9C3


def _powers(step: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.r_[np.uint64(1), np.multiply.accumulate(np.full(_BLOCK - 1, step, np.uint64))]


_POWER, _UNPOWER = _powers(_STEP), _powers(pow(_STEP, -1, 1 << 64))


def _block_words(data: bytes, at: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of ``data[at:stop]``, which cuts no word."""
    letters = np.frombuffer(data, np.uint8, stop - at, at)
    edge = np.flatnonzero(np.diff(_SEPARATOR[letters], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if stop - at > _BLOCK:  # one word without end
        h = np.zeros(len(start), np.uint64)
    else:
        with np.errstate(over="ignore"):
            sums = np.zeros(stop - at + 1, np.uint64)
            np.cumsum(_LETTER[letters] * _POWER[:stop - at], out=sums[1:])
            h = (sums[end] - sums[start]) * _UNPOWER[start]
    for i in np.flatnonzero(end - start > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[at + start[i]:at + end[i]])
    return start + at, h


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the words of a folded text, block by block."""
    found, at = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))], 0
    while at < len(data):
        stop = min(at + _BLOCK, len(data))
        if stop < len(data):
            last = np.flatnonzero(_SEPARATOR[np.frombuffer(data, np.uint8, stop - at, at)])
            if len(last):
                stop = at + int(last[-1]) + 1
            else:
                after = _BREAK.search(data, stop)
                stop = after.start() if after else len(data)
        found.append(_block_words(data, at, stop))
        at = stop
    return np.concatenate([p for p, _ in found]), np.concatenate([h for _, h in found])


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = out * _BASE + h[j:n + j]
        return mixed(out)


def _group_sets(group: list[bytes], k: int) -> Iterator[np.ndarray]:
    place, h = word_hashes(b"\n".join(group))
    with np.errstate(over="ignore"):
        h = mixed(h)
    first = np.searchsorted(place, np.cumsum([0, *(len(d) + 1 for d in group)]))
    runs = _runs(h, k) if len(h) >= k else h[:0]
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        own = np.sort(runs[lo:hi - k + 1]) if hi - lo >= k else _runs(h[lo:hi], hi - lo) if hi > lo else h[:0]
        yield own[np.r_[True, own[1:] != own[:-1]]] if len(own) > 1 else own


def shingle_sets(texts: Iterable[bytes], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of runs of k words per folded text, in order; fewer words make one run, none none.

    Texts are hashed together in groups of about a block, as most are short.
    """
    group: list[bytes] = []
    held = 0
    for data in texts:
        group.append(data)
        held += len(data)
        if held >= _BLOCK:
            yield from _group_sets(group, k)
            group, held = [], 0
    if group:
        yield from _group_sets(group, k)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    return next(shingle_sets([folded(text)], k))
