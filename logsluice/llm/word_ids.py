"""Token ids of texts, each distinct word tokenized once in a worker."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from logsluice.llm.words import Words, byte_set, split_words

#: Words a worker remembers; beyond that it forgets all of them and goes on.
REMEMBERED = 1 << 19
_SEPARATORS = byte_set((0x20, 0x20), (0x0A, 0x0A))
_LETTER = byte_set((ord("a"), ord("z")))
_POINT = byte_set((ord("."), ord(".")), (ord(","), ord(",")))
_TOGETHER = 500


def _points(lower: np.ndarray) -> np.ndarray:
    """A point or comma between an ASCII letter and a separator is a word of its own."""
    found = np.zeros(len(lower), dtype=bool)
    found[1:-1] = _POINT[lower[1:-1]] & _LETTER[lower[:-2]] & _SEPARATORS[lower[2:]]
    return found


class RememberedIds:
    """Ids of texts whose words are encoded one by one and remembered by a 64-bit hash."""

    def __init__(self):
        self._forget()

    def _split(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        raise NotImplementedError

    def _encode_words(self, words: list[str]) -> list[np.ndarray]:
        raise NotImplementedError

    def _text(self, data: np.ndarray, words: Words, i: int) -> str:
        return data[words.starts[i] : words.ends[i]].tobytes().decode()

    def _forget(self) -> None:
        self._keys = np.zeros(0, np.uint64)
        self._at = self._sizes = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        found = self._encode_words(words)
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        at = len(self._ids) + np.cumsum(sizes) - sizes
        keys = np.concatenate([self._keys, hashes])
        order = np.argsort(keys, kind="stable")
        self._keys = keys[order]
        self._at = np.concatenate([self._at, at])[order]
        self._sizes = np.concatenate([self._sizes, sizes])[order]
        self._ids = np.concatenate([self._ids, *found]).astype(np.uint32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, each closed by ``end`` if given, and the place where each row's ids begin."""
        words = self._split(data, offsets)
        distinct, first, each = np.unique(words.hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self._keys, distinct)
        known = place < len(self._keys)
        known[known] = self._keys[place[known]] == distinct[known]
        if not known.all():
            if len(self._keys) + np.count_nonzero(~known) > REMEMBERED:
                self._forget()
                known[:] = False
            self._learn(distinct[~known], [self._text(data, words, i) for i in first[~known].tolist()])
            place = np.searchsorted(self._keys, distinct)
        of_word = place[each]
        sizes = self._sizes[of_word]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        body = self._ids[np.repeat(self._at[of_word] - upto[:-1], sizes) + np.arange(upto[-1])]
        if end is None:
            return body, upto[words.first]
        rows = upto[words.first] + np.arange(len(words.first))
        ids = np.empty(len(body) + len(offsets) - 1, dtype=np.uint32)
        is_end = np.zeros(len(ids), dtype=bool)
        is_end[rows[1:] - 1] = True
        ids[is_end] = end
        ids[~is_end] = body
        return ids, rows


class WordIds(RememberedIds):
    """Ids by a tokenizer that drops white space and lower-cases, so that it works word by word.

    Its pattern must end a token at a space or line break and between a letter and a point or
    comma, and letters A-Z must count as a-z, as in the vocabulary this is used with; then the
    ids of a text are those of its words in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._zero = self._encode(["0"])[0]

    def _split(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        return split_words(data, offsets, _SEPARATORS, _points)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in found]

    def _encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Many words a call, with the digit 0 between them, unless they hold one."""
        ids: list[np.ndarray | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if "0" not in w]
        held = set(plain)
        alone = [i for i in range(len(words)) if i not in held]
        groups = [plain[i : i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        joined = self._encode([" 0 ".join(words[i] for i in group) for group in groups])
        for group, found in zip(groups, joined, strict=True):
            cuts = np.flatnonzero(found == self._zero[0])
            if len(cuts) != len(group) - 1:
                alone += group
                continue
            for i, part in zip(group, np.split(found, cuts), strict=True):
                ids[i] = part[1:] if i != group[0] else part
        for i, part in zip(alone, self._encode([words[i] for i in alone]), strict=True):
            ids[i] = part
        return ids


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each worker process."""
    return WordIds(path)
