"""Token ids of many texts at once, remembering words by hash.

White space never matters to the tokenizer, so a text's ids are those of its parts between ASCII white space; a plain Latin
word followed by plain punctuation splits there. Parts are found and hashed (64 bits, A-Z as a-z) with arrays over a chunk of texts;
only parts not yet known are encoded, plain stems all together, one after another. Texts with special strings go through
the tokenizer whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .word_hash import BLANK, byte_sums, span_hashes, word_spans

PUNCTUATION = ".,;:!?#%*&$|+-=/()[]{}\"@_~^`\\"      # no apostrophe: some begin a contraction
CHUNK = 1 << 18                     # bytes of text encoded at once
TABLE_BITS = 20                     # slots of the memory of words at first
MORE_BITS = 1                       # times it may double before it is emptied
POOL = 1 << 23                      # ids held by it, from which on it is emptied

_MARK = np.isin(np.arange(256), list(PUNCTUATION.encode()))
_TAIL, _WHOLE = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)     # tell tails and whole words from stems


class Memory:
    """Ids by hash: an open-addressed table. Entry 0 is empty; ``whole`` marks stems that must not be cut off their words."""

    def __init__(self, bits: int = TABLE_BITS):
        self.bits, self.most_bits = bits, bits + MORE_BITS
        self.clear()

    def _slots(self) -> None:
        self.mask = np.uint64((1 << self.bits) - 1)
        self.room = int(0.6 * (1 << self.bits))
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.places = np.zeros(int(self.mask) + 1, np.int32)

    def clear(self) -> None:
        self._slots()
        self.start, self.size = np.zeros(self.room + 1, np.int32), np.zeros(self.room + 1, np.int32)
        self.whole = np.zeros(self.room + 1, bool)
        self.ids, self.used, self.count = np.zeros(1 << 16, np.uint32), 0, 1

    def make_room(self, entries: int) -> None:
        """Room for so many more: the slots double as long as they may, then all is forgotten."""
        if self.used > POOL:
            self.clear()
        while self.count + entries > self.room:
            if self.bits == self.most_bits:
                self.clear()
                break
            have = np.flatnonzero(self.keys)
            keys, places = self.keys[have], self.places[have]
            self.bits += 1
            self._slots()
            more = np.zeros(self.room + 1 - len(self.start), np.int32)
            self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
            self.whole = np.concatenate([self.whole, more.astype(bool)])
            self._put(keys, places)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where unknown."""
        slot = (keys & self.mask).astype(np.int64)
        have = self.keys[slot]
        out = np.where(have == keys, self.places[slot], -1)
        left = np.flatnonzero((have != keys) & (have != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & int(self.mask)
            have = self.keys[slot]
            hit = have == keys[left]
            out[left[hit]] = self.places[slot[hit]]
            go = ~hit & (have != 0)
            left, slot = left[go], slot[go]
        return out

    def add(self, keys: np.ndarray, lists: list[np.ndarray], whole: list[bool]) -> None:
        """Distinct keys not yet known."""
        n = len(keys)
        sizes = np.array([len(x) for x in lists], np.int64)
        total = int(sizes.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
        entry = np.arange(self.count, self.count + n)
        self.start[entry], self.size[entry], self.whole[entry] = self.used + np.cumsum(sizes) - sizes, sizes, whole
        if total:
            self.ids[self.used:self.used + total] = np.concatenate(lists)
        self.used += total
        self.count += n
        self._put(keys, entry)

    def _put(self, keys: np.ndarray, entry: np.ndarray) -> None:
        left, slot = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]            # of several for one slot the last stays
            put = self.keys[slot] == keys[left]
            self.places[slot[put]] = entry[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & int(self.mask)


class Encoder:
    """Ids of whole texts, each followed by ``end``."""

    def __init__(self, path: str, end: int, bits: int = TABLE_BITS):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end = np.array([end], np.uint32)
        self.memory = Memory(bits)

    def plain_ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn_stems(self, keys: np.ndarray, found: list[str]) -> None:
        lists: list[np.ndarray] = [self.end[:0]] * len(found)
        whole = [True] * len(found)
        low = []
        for i, stem in enumerate(found):
            x = stem.lower()
            if stem.isalpha() and x.isalpha() and max(x) < "ɐ" and max(stem) < "ɐ":
                whole[i] = False
                low.append((i, x))
        if low:
            ids = self.plain_ids(" ".join([x for _, x in low]))
            cuts = np.flatnonzero(self.closes[ids]) + 1
            if len(cuts) == len(low):
                for (i, _), part in zip(low, np.split(ids, cuts[:-1]), strict=True):
                    lists[i] = part
            else:                                               # a word whose end id is unusual: one by one
                for i, x in low:
                    lists[i] = self.plain_ids(x)
        self.memory.add(keys, lists, whole)

    def _entries(self, keys: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray, stems: bool) -> np.ndarray:
        """Entries of the spans; unknown ones are learned."""
        entry = self.memory.find(keys)
        unknown = np.flatnonzero(entry < 0)
        if len(unknown):
            new, first = np.unique(keys[unknown], return_index=True)
            at = unknown[first]
            found = [raw[a:b].decode(errors="replace") for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            if stems:
                self._learn_stems(new, found)
            else:
                self.memory.add(new, [self.plain_ids(x) for x in found], [False] * len(new))
            entry[unknown] = self.memory.find(keys[unknown])
        return entry

    def _chunk(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between ``at``, one after another, and where each text's begin."""
        start, end = word_spans(data, at)
        self.memory.make_room(2 * len(start) + 2)
        docs, n = len(at) - 1, len(start)
        first = np.searchsorted(start, at)
        slots = np.zeros(2 * n, np.int64)                       # per word: stem or whole word, then tail
        if n:
            raw, sums = data.tobytes(), byte_sums(data)
            last = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))     # last byte that is no mark
            cut = np.maximum(last[end - 1] + 1, start)
            some = np.flatnonzero(cut > start)
            stem = self._entries(span_hashes(sums, start[some], cut[some]), raw, start[some], cut[some], True)
            slots[2 * some] = stem
            tail = cut < end
            kept = some[self.memory.whole[stem]]
            if len(kept):
                slots[2 * kept] = self._entries(span_hashes(sums, start[kept], end[kept]) ^ _WHOLE, raw, start[kept], end[kept], False)
                tail[kept] = False
            tailed = np.flatnonzero(tail)
            if len(tailed):
                slots[2 * tailed + 1] = self._entries(span_hashes(sums, cut[tailed], end[tailed]) ^ _TAIL, raw, cut[tailed], end[tailed], False)
        sizes = self.memory.size[slots].astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        source = np.arange(begin[-1]) + np.repeat(self.memory.start[slots] - begin[:-1], sizes)
        return self.memory.ids[source], begin[2 * first] if docs else begin[:0]

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text, in parts cut at white space."""
        out, i = [], 0
        while i < len(data):
            j = min(len(data), i + CHUNK)
            if j < len(data):
                blanks = np.flatnonzero(BLANK[data[i:j]])
                if len(blanks):
                    j = i + int(blanks[-1]) + 1
                else:                                           # a word longer than a chunk stays whole
                    more = np.flatnonzero(BLANK[data[j:]])
                    j = j + int(more[0]) + 1 if len(more) else len(data)
            out.append(self._chunk(data[i:j], np.array([0, j - i]))[0])
            i = j
        return np.concatenate(out)

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
                part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                special = np.flatnonzero((part[:-1] == 0x3C) & (part[1:] == 0x7C))
                special = set((np.searchsorted(at, special, "right") - 1).tolist())
                if len(part) > CHUNK and not special:
                    yield np.concatenate([self._long(part), self.end])
                else:
                    ids, begin = self._chunk(part, at) if len(special) < j - i else (self.end[:0], np.zeros(j - i + 1, np.int64))
                    for k in range(j - i):
                        own = self.plain_ids(part[at[k]:at[k + 1]].tobytes().decode(errors="replace")) if k in special else ids[begin[k]:begin[k + 1]]
                        yield np.concatenate([own, self.end])
                i = j
