"""Sets of word n-grams, as sorted 64-bit hashes, for whole Arrow columns of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are hashed at once; a longer word is hashed as a whole.
CHUNK = 1 << 19
#: The bytes that separate words.
SPACES = b" \t\n\x0b\x0c\r"

_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_BASE = 0x5851F42D4C957F2D
#: A number for each byte, where A-Z have those of a-z.
_BYTES = np.random.default_rng(11).integers(1, 1 << 64, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SPACES)] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """x with its bits spread, one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """The powers of the base and of its inverse modulo 2^64, as far as they were needed, CHUNK at least."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            most = max(n, CHUNK)
            found = _powers(_BASE, most), _powers(pow(_BASE, -1, 1 << 64), most)
            if n > CHUNK:
                return found  # a long word; not kept
            cls.up, cls.down = found
        return cls.up, cls.down


def _word_hashes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in some bytes, and where it starts; no word goes across a border.

    A word's hash is the sum of its bytes' numbers times the powers of a base, which
    a running sum over all the bytes gives for each word.
    """
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders], last[borders - 1] = inside[borders], inside[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _Powers.of(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    length = (ends - starts + 1).astype(np.uint64)
    return mixed((sums[ends + 1] - sums[starts]) * down[starts] + length * _SPREAD[0]), starts


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of data of about CHUNK bytes that no word goes across."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(end, at + CHUNK)
        if to < end:
            border = offsets[np.searchsorted(offsets, to, side="right") - 1]
            spaces = np.flatnonzero(~_IN_WORD[data[at:to]])
            to = max(int(border), at + int(spaces[-1]) + 1 if len(spaces) else 0)
            if to <= at:  # a word that is longer: up to its end
                to = end
                for low in range(at + CHUNK, end, CHUNK):
                    spaces = np.flatnonzero(~_IN_WORD[data[low : low + CHUNK]])
                    if len(spaces):
                        to = low + int(spaces[0])
                        break
                to = min(to, int(offsets[np.searchsorted(offsets, at, side="right")]))
        yield at, to
        at = to


def ngram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-grams as sorted hashes: A-Z lower-cased, words cut at ASCII white space.

    With fewer than n words, the whole sequence is the one n-gram; without words, or
    for null, there is none.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.empty(0, np.uint8)
    hashes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for at, to in _chunks(data, offsets):
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, side="right")]
        h, s = _word_hashes(data[at:to], inner - at)
        hashes.append(h)
        starts.append(s + at)
    h, place = np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)

    def grams(h: np.ndarray, size: int) -> np.ndarray:
        out = np.full(max(0, len(h) - size + 1), size, np.uint64)
        for i in range(size):
            out = mixed((out ^ h[i : len(h) - size + 1 + i]) * _SPREAD[i % 3])
        return out

    whole = grams(h, n)
    for i, (a, b) in enumerate(zip(place[:-1].tolist(), place[1:].tolist())):
        if a == b or not texts[i].is_valid:
            yield np.empty(0, np.uint64)
        elif b - a < n:
            yield grams(h[a:b], b - a)
        else:
            yield np.unique(whole[a : b - n + 1])
