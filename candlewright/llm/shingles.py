"""Word shingles of whole texts as 64-bit hashes, and MinHash signatures, vectorised over batches of documents."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
SPACES = b" \t\n\x0b\x0c\r"
#: Words up to this many bytes are hashed in lanes of eight; longer ones by BLAKE2b.
LANED = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[list(SPACES)] = True
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def lane(padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 7 of each word as one number, with zeros after its end. padded: bytes with eight more at the end."""
    view = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    return view[starts + 8 * k] & MASKS[np.clip(sizes - 8 * k, 0, 8)]


def name_words(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes and length: eight bytes at a time, each lane mixed into what came before, so no
    sum of terms can cancel; words over LANED bytes by BLAKE2b."""
    sizes = ends - starts
    with np.errstate(over="ignore"):
        out = mix(sizes.astype(np.uint64) + BASE)
        at = np.arange(len(starts))
        for k in range(LANED // 8):
            at = at[sizes[at] > 8 * k]
            if not len(at):
                break
            out[at] = mix((out[at] ^ lane(padded, starts[at], sizes[at], k)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(2 * k + 1))
        for i in np.flatnonzero(sizes > LANED):
            digest = blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = np.uint64(int.from_bytes(digest, "little"))
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z taken as a-z), and the index of the text that it stands in."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" " * 9, dtype=np.uint8)]
    space = SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    return name_words(buf, starts, ends), np.searchsorted(np.cumsum(sizes), starts, "right")


def shingle_sets(texts: list[str | None], width: int, chunk: int = 1 << 19) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order.

    A text of fewer words than `width`, but at least one, has its whole sequence of words as its one shingle; a text
    without words, or null, has none.
    """
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size < chunk):
            some.append((texts[at] or "").encode())
            size, at = size + len(some[-1]), at + 1
        words, doc = word_hashes(some)
        count = np.bincount(doc, minlength=len(some))
        first = np.concatenate([[0], np.cumsum(count)])
        with np.errstate(over="ignore"):
            grams = words.copy()
            for k in range(1, width):
                grams = mix(grams[: max(0, len(words) - k)] * np.uint64(0xA0761D6478BD642F) + words[k:])
        for k in range(len(some)):
            if count[k] >= width:
                yield np.unique(grams[first[k] : first[k + 1] - width + 1])
            elif count[k]:
                with np.errstate(over="ignore"):
                    whole = words[first[k] : first[k] + 1]
                    for w in words[first[k] + 1 : first[k + 1]]:
                        whole = mix(whole * np.uint64(0xA0761D6478BD642F) + w)
                    yield mix(whole + np.uint64(count[k]))
            else:
                yield np.zeros(0, dtype=np.uint64)


def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        flips = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(2 * seed + 1))
        return flips, mix(flips + np.uint64(seed)) | np.uint64(1)


def signature(shingles: np.ndarray, flips: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """MinHash: for each permutation the smallest 32-bit value over the set."""
    best = np.full(len(flips), 0xFFFFFFFF, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(shingles), 256):
            part = (shingles[lo : lo + 256, None] ^ flips) * odds
            np.minimum(best, (part >> np.uint64(32)).min(axis=0), out=best)
    return best.astype("<u4")


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: two sums over its shingles."""
    with np.errstate(over="ignore"):
        return int(shingles.sum(dtype=np.uint64).astype(np.int64)), int(mix(shingles ^ BASE).sum(dtype=np.uint64).astype(np.int64))


def sketch(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the numbers of shingles in as many buckets as bits, as 64-bit numbers. Those of two sets differ in at
    most as many bits as the sets differ in elements: the parities of what only one of them has."""
    counts = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")
