"""Token ids of very many distinct words at once, by the merges of a byte-pair vocabulary.

A word of plain Latin letters is one piece to the tokenizer, whatever stands round it,
and its pieces come from merging pairs of symbols, the pair of the lowest rank first,
of equal ones the leftmost.  All words take their next merge together, as rows of
arrays; neighbours are linked, so a merge looks up two new pairs only.  Everything that
is not such a word is left to the tokenizer itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

#: Letters of a word that is merged here, bytes of one that is remembered, words that are merged together.
LETTERS, LONGEST, TOGETHER = 20, 64, 16_384
#: Marks of which a run at the end of a word of letters is a piece of its own.
MARKS = ".,!?;:|#*$%&<>()-_=+/\\\"@~^`[]{}"
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_all_plain = frozenset(_LETTERS).issuperset
_NONE = np.int32(2**31 - 1)


class Merges:
    """Ids of plain words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner, self.last = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        for letter in _LETTERS:
            for byte, symbol in zip(letter.encode(), level.pre_tokenize_str(letter)[0][0], strict=True):
                self.inner[byte], self.last[byte] = vocabulary.get(symbol, -1), vocabulary.get(symbol + end, -1)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, _NONE).astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << np.int64(32) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def ids(self, words: list[str]) -> Iterable[tuple[str, bytes | None]]:
        """(word, its ids in bytes) of plain words in lower case; None where a symbol is not in the vocabulary."""
        raw = sorted(((w.encode(), w) for w in words), key=lambda x: len(x[0]))
        for begin in range(0, len(raw), TOGETHER):
            part = raw[begin : begin + TOGETHER]
            yield from zip([w for _, w in part], self._together([x for x, _ in part]), strict=True)

    def _together(self, raw: list[bytes]) -> list[bytes | None]:
        sizes = np.array([len(x) for x in raw])
        n, width = len(raw), int(sizes[-1])
        flat = np.zeros((n, width + 1), np.uint8)
        flat[np.arange(width + 1)[None, :] < sizes[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        rows = np.arange(n)
        symbol = self.inner[flat]
        symbol[rows, sizes - 1] = self.last[flat[rows, sizes - 1]]
        there = np.arange(width + 1)[None, :] < sizes[:, None]
        known = ((symbol >= 0) | ~there).all(1)
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = after - 2
        rank = np.full((n, width + 1), _NONE, np.int32)
        rank[:, :-1] = self._ranks(symbol[:, :-1], symbol[:, 1:])
        rank[np.arange(width + 1)[None, :] >= sizes[:, None] - 1] = _NONE
        live = rows[known]
        while len(live):
            at = rank[live].argmin(1)
            lowest = rank[live, at]
            some = lowest < _NONE
            live, at, lowest = live[some], at[some], lowest[some]
            gone = after[live, at]
            symbol[live, at] = self.merged[lowest]
            there[live, gone] = False
            rank[live, gone] = _NONE
            follows = after[live, gone]
            after[live, at] = follows
            inside = follows < sizes[live]
            r, p, q = live[inside], at[inside], follows[inside]
            before[r, q] = p
            rank[live, at] = _NONE
            rank[r, p] = self._ranks(symbol[r, p], symbol[r, q])
            previous = before[live, at]
            inside = previous >= 0
            r, p, q = live[inside], previous[inside], at[inside]
            rank[r, p] = self._ranks(symbol[r, p], symbol[r, q])
        counts = there.sum(1)
        out = symbol[there].astype("<u4").tobytes()
        ends = np.cumsum(counts) * 4
        return [out[e - 4 * c : e] if k else None for c, e, k in zip(counts.tolist(), ends.tolist(), known.tolist(), strict=True)]


class WordIds(dict):
    """White-space separated word -> its ids as bytes.

    The tokenizer drops white space and looks at nothing beyond it, so a text's ids
    are those of its words.  Marks at the end of a word of letters are a piece of their own.
    """

    def __init__(self, path: str, memory: int):
        super().__init__()
        self.tokenizer, self.merges, self.memory = Tokenizer.from_file(path), Merges(path), memory

    def _encoded(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, words: list[str]) -> list[bytes]:
        """Ids of each of the words; they are distinct, and no more than a bounded text holds."""
        if len(self) >= self.memory:
            self.clear()
        parts = []
        for word in words:
            if word not in self:
                stem = word.rstrip(MARKS)
                low = stem.lower()
                if low and len(low) <= LETTERS and len(word) <= LONGEST and _all_plain(low):
                    parts.append((word, low, word[len(stem) :]))
                elif len(word) <= LONGEST:
                    self[word] = self._encoded(word)
        for low, found in self.merges.ids(list({low for _, low, _ in parts if low not in self})):
            self[low] = self._encoded(low) if found is None else found
        for word, low, tail in parts:
            if tail and tail not in self:
                self[tail] = self._encoded(tail)
            self[word] = self[low] + self[tail] if tail else self[low]
        # A long word is not remembered.
        return [self._encoded(word) if ids is None else ids for word, ids in zip(words, map(self.get, words), strict=True)]
