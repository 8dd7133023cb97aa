"""Byte-level BPE ids of whole texts, at the speed of a word cache.

The tokenizers library gives every id.  A text is cut at single spaces whose two neighbours are not white space: the
pre-tokenizer always starts a new piece there, so the parts can be encoded apart.  numpy looks all parts of a batch up
in a table at once, by length and bytes, so that no two parts are ever taken for one; each part that the table does not
hold is encoded once by the library.  A text with any other run of white space, or with the string of an added token
(`<|endoftext|>`), which the library finds before it cuts a text up, is encoded whole.
"""

from __future__ import annotations

import numpy as np

from .common import SHORT, edges, mix

#: Parts that a worker remembers (about 40 MB); what comes later is remembered for its block only.
CACHE_PARTS = 400_000
SLOTS = 1 << 20
#: Bytes of text that are cut up at once.
BLOCK = 1 << 20
#: Bytes of the longest part that is remembered.
LONGEST = 256
_masks = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1] * (SHORT - 7), dtype=np.uint64)


def default_tokenizer() -> str:
    """The path of the public tokenizer file that the queries name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache_parts = min(cache_parts, SLOTS // 2)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # ids whose token begins with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.keys, self.numbers = np.zeros((3, SLOTS), dtype=np.uint64), np.zeros(SLOTS, dtype=np.int32)
        self.long: dict[tuple[bytes, bool], int] = {}  # the numbers of longer parts
        self.flat, self.used = np.empty(1 << 20, dtype=np.uint32), 0
        self.first, self.count, self.n = np.zeros(1 << 18, dtype=np.int64), np.zeros(1 << 18, dtype=np.int32), 0

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return (mix(mix(keys[0]) + keys[1] * np.uint64(3) + keys[2]) >> np.uint64(44)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key (first bytes, last bytes, size and place) in the table, or -1."""
        out = np.full(keys.shape[1], -1, dtype=np.int32)
        left, slot = np.arange(keys.shape[1]), self._slots(keys)
        while len(left):
            tag = self.keys[2, slot]
            hit = (tag == keys[2, left]) & (self.keys[0, slot] == keys[0, left]) & (self.keys[1, slot] == keys[1, left])
            out[left[hit]] = self.numbers[slot[hit]]
            on = ~hit & (tag != 0)
            left, slot = left[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def _insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        slot = self._slots(keys)
        while len(slot):
            free = np.flatnonzero(self.keys[2, slot] == 0)
            _, pick = np.unique(slot[free], return_index=True)
            done = free[pick]
            self.keys[:, slot[done]], self.numbers[slot[done]] = keys[:, done], numbers[done]
            on = np.ones(len(slot), dtype=bool)
            on[done] = False
            keys, numbers, slot = keys[:, on], numbers[on], (slot[on] + 1) & (SLOTS - 1)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str], head: np.ndarray) -> None:
        """Number the parts on from self.n; a count of -1 says that a part can't be cut off its text."""
        count = np.full(len(parts), -1, dtype=np.int32)
        safe = np.array([bool(p) and p == p.strip() for p in parts], dtype=bool)
        inner, heads = np.flatnonzero(safe & ~head), np.flatnonzero(safe & head)
        ids = np.array([i for a in range(0, len(inner), 500) for x in self._whole([" " + " ".join(parts[k] for k in inner[a : a + 500])]) for i in x], dtype=np.uint32)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) == len(inner):  # else some token with a space stands where no part begins: leave them to whole texts
            count[inner] = np.diff(np.append(starts, len(ids)))
        else:
            ids = ids[:0]
        own = self._whole([parts[k] for k in heads])
        count[heads] = [*map(len, own)]
        ids = np.concatenate([ids, np.array([i for x in own for i in x], dtype=np.uint32)])
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(need, len(self.flat)), dtype=np.uint32)])
        if self.n + len(parts) > len(self.first):
            more = max(len(parts), len(self.first))
            self.first, self.count = np.concatenate([self.first, np.zeros(more, dtype=np.int64)]), np.concatenate([self.count, np.zeros(more, dtype=np.int32)])
        self.flat[self.used : need] = ids
        order = np.concatenate([inner, heads])
        first, real = np.zeros(len(parts), dtype=np.int64), np.maximum(count[order], 0)
        first[order] = self.used + np.cumsum(real) - real
        self.first[self.n : self.n + len(parts)], self.count[self.n : self.n + len(parts)] = first, count
        self.used, self.n = need, self.n + len(parts)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as uint32; a null text has none."""
        out, block, size = [], [], 0
        for t in texts:
            raw = t.encode() if t else b""
            if block and size + len(raw) + 1 > BLOCK:
                out += self._block(block)
                block, size = [], 0
            block.append(raw)
            size += len(raw) + 1
        return out + (self._block(block) if block else [])

    def _block(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b" " + b" ".join(texts)
        space = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 32)
        begin, end = space + 1, np.append(space[1:], len(raw))
        size = end - begin
        doc = np.searchsorted(space, np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]))  # the first part of each text
        head = np.zeros(len(space), dtype=bool)
        head[doc] = True
        tag = size * 2 + head + 1
        number = np.full(len(space), -1, dtype=np.int32)
        short = np.flatnonzero(size <= SHORT)
        keys = np.stack([*edges(raw, begin[short], end[short]), tag[short].astype(np.uint64)])
        number[short] = self._find(keys)
        mark = self.n, self.used
        new = np.flatnonzero(number[short] < 0)
        order = new[np.lexsort(keys[:, new])]
        fresh_key = np.ones(len(order), dtype=bool)
        fresh_key[1:] = (keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)
        first = order[fresh_key]
        at = short[first]
        number[short[order]] = self.n + np.cumsum(fresh_key) - 1
        parts = [raw[x:y] for x, y in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
        heads = head[at].tolist()
        longer: dict[tuple[bytes, bool], int] = {}
        for k in np.flatnonzero(size > SHORT).tolist():
            key = raw[begin[k] : end[k]], bool(head[k])
            n = self.long.get(key, longer.get(key, -1))
            if n < 0:
                n = longer[key] = self.n + len(parts)
                parts.append(key[0])
                heads.append(key[1])
            number[k] = n
        if parts:
            self._learn([x.decode() for x in parts], np.array(heads, dtype=bool))
        n = self.count[number]
        real = np.maximum(n, 0)
        ends = np.cumsum(real)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.first[number] - (ends - real), real)]
        cut = np.append(np.append(0, ends)[doc], ends[-1])
        bad = np.logical_or.reduceat(n < 0, doc)
        for token in self.added:
            if token in raw:
                bad |= np.array([token in t for t in texts])
        out = [ids[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        for k in np.flatnonzero(bad):
            out[k] = np.array(self._whole([texts[k].decode()])[0] if texts[k] else [], dtype=np.uint32)
        if parts:
            if self.n <= self.cache_parts:
                self._insert(keys[:, first], np.arange(mark[0], mark[0] + len(first), dtype=np.int32))
                self.long |= {k: n for k, n in longer.items() if len(k[0]) <= LONGEST}
            else:
                self.n, self.used = mark
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of the file; its cache serves all tasks that the worker runs."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
