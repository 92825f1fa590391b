"""Word shingles of whole texts as 64-bit hashes, by numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z in lower case. A word's hash is a polynomial over a
random table of its bytes, taken from prefix sums; a shingle's hash mixes those of its words. Two different
words or shingles meet in one hash with a chance of about 2**-64.
"""

from __future__ import annotations

import re

import numpy as np

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_CHUNK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(1, 2**64, 256, np.uint64)
_POSITION = _rng.integers(1, 2**64, 16, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher: a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                have = getattr(self, name)
                setattr(self, name, np.concatenate([have, have * np.uint64(pow(base, size, 2**64))]))
        return self.up, self.down


_POWERS = _Powers()


def _words_of(data: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of lower-cased ``data``, and the number of words that start before each of ``begins``."""
    part = np.frombuffer(data, np.uint8)
    blank = np.concatenate(([True], _IS_BLANK[part], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    up, down = _POWERS.to(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTES[part] * up[: len(part)], out=sums[1:])
    starts, ends = edges[::2], edges[1::2]
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, begins)


def _long(text: bytes) -> np.ndarray:
    """Hash of each word of a text of any length, by pieces that end between words."""
    data, out, at = text.lower(), [np.empty(0, np.uint64)], 0
    while at < len(data):
        cut = _BLANK.search(data, at + _CHUNK)
        end = cut.start() if cut else len(data)
        out.append(_words_of(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(out)


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each UTF-8 text, one set after the other, and where each begins (one entry more).

    A text with fewer words than ``width`` has the whole sequence as one shingle; one without words has none. Texts are taken
    together, so callers hand over about a megabyte at a time; a longer text is hashed in pieces.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    if sizes.sum() <= _CHUNK:
        begins = np.concatenate(([0], np.cumsum(sizes + 1)))
        words, at = _words_of(b" ".join(texts).lower(), begins)
    else:
        each = [_long(x) for x in texts]
        words, at = np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))
    n = max(len(words) - width + 1, 0)
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed += words[i : i + n] * _POSITION[i]
    mixed = mix(mixed + np.uint64(width << 32))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            x = mixed[a : b - width + 1]
            x.sort()
            new = np.empty(len(x), bool)
            new[0] = True
            np.not_equal(x[1:], x[:-1], out=new[1:])
            out.append(x[new])
        elif b > a:
            out.append(mix(np.atleast_1d((words[a:b] * _POSITION[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a))))
        else:
            out.append(words[:0])
    found = np.concatenate(out) if out else words
    return found, np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The set of one text; null has none."""
    return shingle_sets([(text or "").encode("utf-8", "surrogatepass")], width)[0]


def set_keys(features: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each set, the same for equal sets."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(features + np.uint64(0xD1B54A32D192ED03)))))
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def parity(features: np.ndarray, least: int = 512, most: int = 1 << 16) -> bytes:
    """A power of two of bits, about one to two a feature, each the parity of the features that fall on it.

    Two sets' bits differ in as many places as they have different features at most, also after the longer bitmap is
    folded onto the shorter one's length.
    """
    size = min(most, max(least, 1 << max(len(features) - 1, 1).bit_length()))
    bits = np.bincount(((features >> np.uint64(40)) % np.uint64(size)).view(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(bits).tobytes()
