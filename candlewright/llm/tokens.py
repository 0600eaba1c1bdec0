"""Tokenization of whole texts on executors, vectorised over batches, equal to the library's ids."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from candlewright.llm.shingles import LANED, lane, name_words

#: The split and normalizer that the vectorised path stands for; another file takes the library's path for every text.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, MARK = range(4)


def _byte_classes() -> np.ndarray:
    """Classes of single bytes; the bytes of two-byte letters are letters, which _classify checks in pairs."""
    out = np.full(256, MARK, dtype=np.uint8)
    out[[9, 10, 13, 32]] = SPACE
    out[48:58] = DIGIT
    out[97:123] = out[65:91] = out[128:] = LETTER
    return out


CLASSES = _byte_classes()
CONTROL = np.zeros(256, dtype=bool)
CONTROL[:32] = CONTROL[127] = True
CONTROL[[9, 10, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Encoder:
    """Encodes texts to bytes of little-endian unsigned 32-bit ids.

    The tokenizer encodes each pre-token by itself, so a text's ids are its pre-tokens' ids in order. Pre-tokens of a
    batch are found by byte classes, named by 64-bit hashes of their lower-cased bytes, and looked up together in a
    sorted table of at most `room` encodings; those not used lately make room. A name only finds an entry: the bytes of
    every pre-token are then compared with those that its ids were made of, and a text in which any differ goes through
    the library whole. New ones are encoded in one call: the last id of each ends a word, so the ids are parted there.
    A chunk with an apostrophe is one entry, encoded whole. Texts with a pre-token of over LANED bytes, with other than
    ASCII and the Latin letters of U+00C0-U+00FF, U+0152 and U+0153, with control characters, or with a mark of a
    special token, go through the library whole.
    """

    def __init__(self, path: str, room: int = 400_000):
        import json

        from tokenizers import Tokenizer

        self.room = room
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", ())]
        end = (spec.get("model") or {}).get("end_of_word_suffix")
        marks = all(x["content"].startswith("<|") for x in spec.get("added_tokens", ()))
        self.fast = bool(end) and marks and pre[0].get("pattern", {}).get("Regex") == KNOWN_SPLIT and kinds == ["NFC", "Replace", "Lowercase"]
        if self.fast:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(end)]] = True
        self._clear()

    def _clear(self) -> None:
        self.names = np.zeros(0, np.uint64)  # sorted
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int64)  # of the entries' own bytes
        self.raw = np.zeros(8, np.uint8)  # those bytes, one entry after another as learnt, and eight more
        self.raw_at = np.zeros(0, np.int64)
        self.turn = 0

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, names: np.ndarray, words: list[bytes], whole: np.ndarray) -> None:
        """Add encodings of new entries; names are sorted and not yet known."""
        sizes, parts = np.zeros(len(words), np.int64), []
        one = np.flatnonzero(~whole)
        if len(one):
            text = b" ".join([words[i] for i in one]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(one):  # never so with the known file; the library's own answer for each
                whole = np.ones(len(words), dtype=bool)
            else:
                sizes[one] = np.diff(np.concatenate([[0], at]))
                parts.append(ids)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        base = len(self.ids) + sum(map(len, parts))
        for i in np.flatnonzero(whole):
            ids = np.frombuffer(self.plain(words[i].decode()), dtype="<u4")
            starts[i], sizes[i], base = base, len(ids), base + len(ids)
            parts.append(ids)
        where = np.searchsorted(self.names, names)
        self.ids = np.concatenate([self.ids, *parts]).astype(np.uint32)
        self.names, self.starts = np.insert(self.names, where, names), np.insert(self.starts, where, starts)
        self.sizes, self.used = np.insert(self.sizes, where, sizes), np.insert(self.used, where, self.turn)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.lengths, self.raw_at = np.insert(self.lengths, where, lengths), np.insert(self.raw_at, where, len(self.raw) - 8 + np.cumsum(lengths) - lengths)
        self.raw = np.concatenate([self.raw[:-8], np.frombuffer(b"".join(words) + bytes(8), dtype=np.uint8)])

    def _evict(self) -> None:
        """Keep the half used last."""
        keep = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        sizes = self.sizes[keep]
        ids = self.ids[_runs(self.starts[keep], sizes)]
        self.names, self.used, self.sizes, self.ids = self.names[keep], self.used[keep], sizes, ids
        self.starts = np.cumsum(sizes) - sizes
        self.lengths = self.lengths[keep]
        self.raw = np.concatenate([self.raw[_runs(self.raw_at[keep], self.lengths)], np.zeros(8, np.uint8)])
        self.raw_at = np.cumsum(self.lengths) - self.lengths

    def batch(self, column) -> list[bytes]:
        """Ids of each text of an Arrow string column; null and empty texts have none."""
        import pyarrow as pa

        column = column.cast(pa.large_string())
        if not self.fast:
            return [self.plain(t) if t else b"" for t in column.to_pylist()]
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        out: list[bytes] = []
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 20), "right")) - 1)
            data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[lo] : offsets[hi]]
            out += self._some(data, offsets[lo : hi + 1] - offsets[lo])
            lo = hi
        return out

    def _some(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        n, docs = len(data), len(offsets) - 1
        if not n:
            return [b""] * docs
        cls, low = CLASSES[data], LOWER[data]
        wide = data >= 128
        odd = CONTROL[data]
        if wide.any():
            at = np.flatnonzero(wide)
            here = data[at]
            before = np.where(at > 0, data[at - 1], 0)
            lead = (here == 0xC3) | (here == 0xC5)
            latin = (before == 0xC3) & (here >= 0x80) & (here <= 0xBF) & (here != 0x97) & (here != 0xB7)
            oe = (before == 0xC5) & ((here == 0x92) | (here == 0x93))
            odd[at[~(lead | latin | oe)]] = True
            low[at[latin & (here <= 0x9E)]] += 0x20
            low[at[oe]] = 0x93
        bar = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        odd[bar] = True
        slow = np.zeros(docs, dtype=bool)
        if odd.any():
            slow[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
            for k in np.flatnonzero(slow):
                cls[offsets[k] : offsets[k + 1]] = SPACE
        edge = np.empty(n, dtype=bool)
        edge[0] = True
        np.not_equal(cls[1:], cls[:-1], out=edge[1:])
        edge |= cls == DIGIT
        inner = offsets[offsets < n]
        edge[inner] = True
        quotes = np.flatnonzero((data == 0x27) & (cls == MARK))
        opaque = np.zeros(0, np.int64)
        if len(quotes):
            first = cls != SPACE
            first[1:] &= (cls[:-1] == SPACE) | edge_at(n, inner)[1:]
            chunk = np.cumsum(first)
            flagged = np.zeros(int(chunk[-1]) + 1, dtype=bool)
            flagged[chunk[quotes]] = True
            inside = flagged[chunk] & (cls != SPACE)
            edge &= ~inside | first
            opaque = np.flatnonzero(inside & first)
        at = np.flatnonzero(edge)
        ends = np.append(at[1:], n)
        word = cls[at] != SPACE
        at, ends = at[word], ends[word]
        long = np.flatnonzero(ends - at > LANED)
        if len(long):
            slow[np.searchsorted(offsets, at[long], "right") - 1] = True
            fit = ends - at <= LANED
            at, ends = at[fit], ends[fit]
        if len(at):
            padded = np.concatenate([low, np.zeros(LANED + 8, np.uint8)])
            lengths = ends - at
            names = name_words(padded, at, ends)
            some, first, back = np.unique(names, return_index=True, return_inverse=True)
            self.turn += 1
            if len(self.names) > self.room:
                self._evict()
            place = np.searchsorted(self.names, some)
            new = np.ones(len(some), dtype=bool)
            inbound = place < len(self.names)
            new[inbound] = self.names[place[inbound]] != some[inbound]
            if new.any():
                k = first[new]
                raw = low.tobytes()
                words = [raw[a:b] for a, b in zip(at[k].tolist(), ends[k].tolist(), strict=True)]
                self._learn(some[new], words, np.isin(at[k], opaque))
                place = np.searchsorted(self.names, some)
            self.used[place] = self.turn
            entry = place[back]
            other = self.lengths[entry] != lengths
            left = np.flatnonzero(~other)
            for j in range(LANED // 8):
                left = left[lengths[left] > 8 * j]
                if not len(left):
                    break
                other[left] |= lane(self.raw, self.raw_at[entry[left]], lengths[left], j) != lane(padded, at[left], lengths[left], j)
            if other.any():  # two pre-tokens of one name
                slow[np.searchsorted(offsets, at[other], "right") - 1] = True
            sizes = self.sizes[entry]
            ids = self.ids[_runs(self.starts[entry], sizes)].astype("<u4")
            upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(at, offsets, "left")]
        else:
            ids, upto = np.zeros(0, "<u4"), np.zeros(docs + 1, np.int64)
        raw, cuts = ids.tobytes(), (4 * upto).tolist()
        out = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k in np.flatnonzero(slow):
            out[k] = self.plain(data[offsets[k] : offsets[k + 1]].tobytes().decode())
        return out


def edge_at(n: int, places: np.ndarray) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[places] = True
    return out


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of runs that start at `starts` and are `sizes` long, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder in each Python worker."""
    return Encoder(path)
