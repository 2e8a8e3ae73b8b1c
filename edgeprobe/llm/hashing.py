"""64-bit hashes of words and numbers, whole texts at a time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

GOLD = 0x9E3779B97F4A7C15
M = np.uint64(GOLD)
#: Words of more bytes than this are hashed one by one.
LONG = 64
#: Bytes of a text that are hashed at once (each takes some 40 bytes of memory meanwhile).
SEGMENT = 1 << 18
#: Bytes of short texts that are hashed together.
TOGETHER = 1 << 15
_SPACE = re.compile(rb"[\t-\r ]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: For each byte and for each place in a word a 64-bit number; a word's hash is the mixed sum of their products.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * M)
_PLACE = mix(np.arange(257, 257 + LONG, dtype=np.uint64) * M) | np.uint64(1)
#: The product by place and byte, 0 for white space.
_PRODUCT = _PLACE[:, None] * _BYTE
_PRODUCT[:, [32, *range(9, 14)]] = 0
_PRODUCT = _PRODUCT.ravel()


def _segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and where it starts."""
    b = np.frombuffer(data, np.uint8)
    space = np.ones(len(b) + 2, bool)
    np.logical_or(b == 32, b - np.uint8(9) < 5, out=space[1:-1])  # below 9 it wraps
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    first = start[0]
    next_start = np.append(start[1:], len(b))
    reach = next_start - start
    at = np.arange(first, len(b)) - np.repeat(start, reach)
    if reach.max() > LONG:
        np.minimum(at, LONG - 1, out=at)
    at <<= 8
    at |= b[first:]
    out = mix(np.add.reduceat(_PRODUCT[at], start - first))
    size = end - start
    if size.max() > LONG:
        for i in np.flatnonzero(size > LONG):
            out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out, start


def word_hashes(text: bytes) -> np.ndarray:
    """The hash of each word of a text that is lower-cased already; ASCII white space parts words."""
    if len(text) <= SEGMENT:
        return _segment(text)[0]
    out, at = [], 0
    while at < len(text):
        m = _SPACE.search(text, min(at + SEGMENT, len(text)))
        end = m.end() if m else len(text)
        if end - at <= 2 * SEGMENT:
            out.append(_segment(text[at:end])[0])
        else:  # there is a very long word among them: the others together, the long ones each by itself
            words = text[at:end].split()
            own = np.zeros(len(words), np.uint64)
            short = [i for i, w in enumerate(words) if len(w) <= LONG]
            own[short] = _segment(b" ".join([words[i] for i in short]))[0]
            for i, w in enumerate(words):
                if len(w) > LONG:
                    own[i] = xxhash.xxh3_64_intdigest(w)
            out.append(own)
        at = end
    return np.concatenate(out)


def hashes_of_texts(texts: Iterable[bytes], end: int) -> Iterator[np.ndarray]:
    """For each text, lower-cased already, the hashes of its words and then ``end``; short texts are hashed together."""
    few, size = [], 0
    for text in texts:
        few.append(text)
        size += len(text) + 1
        if size >= TOGETHER:
            yield from _together(few, end)
            few, size = [], 0
    yield from _together(few, end)


def _together(texts: list[bytes], end: int) -> Iterator[np.ndarray]:
    if len(texts) > 1 and len(texts[-1]) >= TOGETHER:  # the last one by itself, which may have many segments
        yield from _together(texts[:-1], end)
        texts = texts[-1:]
    if len(texts) > 1:
        hashes, start = _segment(b"\n".join(texts))
        ends = np.searchsorted(start, np.cumsum([len(x) + 1 for x in texts]))
        yield from np.split(np.insert(hashes, ends, np.uint64(end)), (ends + np.arange(1, len(ends) + 1))[:-1])
    else:
        for text in texts:
            yield np.append(word_hashes(text), np.uint64(end))
