"""Sets of hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}

#: Bits of a set's signature, and of a long set's wide signature (powers of two).
SIGNATURE_BITS = 1024
WIDE_BITS = 16_384
#: A word of so many bytes or more is hashed by a digest, so that no text needs arrays of its whole length.
LONG_WORD = 1 << 16
#: Bytes of a long text that are hashed at once.
SLICE = 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        _powers["up"] = np.cumprod(np.full(size, _BASE, dtype=np.uint64))
        _powers["down"] = np.cumprod(np.full(size, pow(_BASE, -1, 2**64), dtype=np.uint64))
    return _powers["up"], _powers["down"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z as a-z) of UTF-8 texts, and the range of words of each text (len + 1 bounds)."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_tables(len(data))
    total = np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)])
    total = np.concatenate([np.zeros(1, np.uint64), total])
    hashes = mix((total[last] - total[first]) * down[first])
    for i in np.flatnonzero(last - first >= LONG_WORD):
        hashes[i] = _long_word(data[first[i] : last[i]].tobytes())
    return hashes, np.searchsorted(first, begins)


def _long_word(word: bytes) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(word.lower(), digest_size=8).digest(), "little"))


def _sliced_hashes(text: bytes) -> np.ndarray:
    """Hashes of all words of one long text, SLICE bytes or a little more at a time."""
    parts, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE:
            white = _WHITE.search(text, at + SLICE)
            end = white.start() if white else len(text)
        if end - at > SLICE + LONG_WORD:  # the slice ends in a long word, which stands alone
            begin = max(text.rfind(bytes([c]), at, at + SLICE) for c in b" \t\n\x0b\x0c\r") + 1 or at
            parts += [word_hashes([text[at:begin]])[0], np.array([_long_word(text[begin:end])])]
        else:
            parts.append(word_hashes([text[at:end]])[0])
        at = end
    return np.concatenate(parts)


def sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as ascending 64-bit hashes; with fewer words, the whole sequence as one shingle."""
    if len(texts) == 1 and len(texts[0]) > SLICE:
        words = _sliced_hashes(texts[0])
        bounds = np.array([0, len(words)])
    else:
        words, bounds = word_hashes(texts)
    run = words.copy()
    for j in range(1, min(k, len(words))):  # a chunk of fewer words has no k-word shingles
        run[: len(words) - j] = mix(run[: len(words) - j] * np.uint64(_BASE) + words[j:])
    shingles = mix(run + np.uint64(k))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(shingles[a : b - k + 1]))
        elif b > a:
            h = words[a : a + 1].copy()
            for j in range(a + 1, b):
                h = mix(h * np.uint64(_BASE) + words[j : j + 1])
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit digest as two signed 64-bit integers."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def signature(shingles: np.ndarray, bits: int = SIGNATURE_BITS) -> bytes:
    """Parity of the shingles in each of `bits` hash classes.

    Each shingle that two sets don't share flips one bit, so two signatures differ in no more bits than the sets differ in shingles.
    """
    parity = np.bincount((shingles >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def of_batch(batch: pa.RecordBatch, k: int, limit: int = 1 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, set) of each row of a batch with columns doc_id, text; a null text has the empty set."""
    from .common import byte_lengths, text_chunks

    ids, texts = batch.column(0).to_pylist(), batch.column(1)
    for a, b in text_chunks(byte_lengths(texts), limit):
        yield from zip(ids[a:b], sets([t or b"" for t in texts[a:b].cast(pa.binary()).to_pylist()], k), strict=True)
