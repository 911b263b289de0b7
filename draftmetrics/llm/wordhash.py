"""64-bit hashes of words for many texts at once, in blocks of bounded memory.

Words of up to ``LONG`` bytes are polynomials modulo 2^64 with a random value for each
byte.  Such polynomials have known collisions between long words, so a longer word's
hash is a keyed digest.  Two given words share a hash with a chance of about 2^-63.
"""

from __future__ import annotations

import hashlib

import numpy as np

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once (more only where one word is longer).
BLOCK_BYTES = 1 << 20
#: Bytes of the longest word that is hashed as a polynomial.
LONG = 64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def separators(is_word: callable) -> bytes:
    """A translation table: A-Z to a-z, bytes for which ``is_word`` is false to 0, NUL (if a word byte) to 255."""
    out = bytearray(256)
    for b in range(256):
        c = b + 32 if 65 <= b <= 90 else b
        out[b] = (c or 255) if is_word(c) else 0
    return bytes(out)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def hash_words(texts: list[str | None], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, in order; words of each text).  A line break must be a separator of ``table``."""
    raw = [(t or "").encode() for t in texts]
    first = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
    flat = b"\n".join(raw).translate(table) + b"\0"
    hashes, starts, at = [], [], 0
    while at < len(flat):
        end = len(flat) if len(flat) - at <= BLOCK_BYTES else flat.index(b"\0", at + BLOCK_BYTES - 1) + 1
        buf = np.frombuffer(flat, np.uint8, end - at, at)
        word = np.concatenate([[False], buf != 0])
        edge = np.flatnonzero(word[1:] != word[:-1])
        a, b = edge[::2], edge[1::2]  # the block ends with a separator
        if len(a):
            up, down = _power(len(buf))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up, dtype=np.uint64)])
            found = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            for k in np.flatnonzero(b - a > LONG).tolist():
                found[k] = int.from_bytes(hashlib.blake2b(buf[a[k] : b[k]].tobytes(), digest_size=8, key=b"long words").digest(), "little")
            hashes.append(found)
            starts.append(a + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    doc = np.searchsorted(first, np.concatenate(starts), side="right") - 1
    return np.concatenate(hashes), np.bincount(doc, minlength=len(texts))
