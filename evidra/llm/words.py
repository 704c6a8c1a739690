"""Ids of texts word by word, for byte-level patterns that part a text before each lone space and around each lone line end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered in each of two generations, apart for words at a line's start and after a space.
MAX_WORDS = 250_000
#: Characters of texts that are taken apart at once.
MAX_CHARS = 1_000_000
#: Fixed value: the pattern for which the rule below holds.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, about MAX_CHARS at a time."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size > MAX_CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


class WordIds:
    """Packed ids of texts.

    Where lone spaces and lone line ends are the only white space of a text and none follows
    another, the pattern parts it before each of them and after each line end, so its ids are
    those of its words (with the space before them) in turn. Any other text is encoded whole.
    many(strings) encodes strings in sorted order, whole(text) a whole text.
    """

    def __init__(self, many: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], by_word: bool = True, most: int = MAX_WORDS):
        self.many, self.whole, self.by_word, self.most = many, whole, by_word, most
        self.line_end = whole("\n")
        self.young: list[dict[str, bytes | None]] = [{}, {}]  # at a line's start, after a space; None: the rule doesn't hold
        self.old: list[dict[str, bytes | None]] = [{}, {}]

    def _meet(self, words: set[str], spaced: int) -> None:
        young, old = self.young[spaced], self.old[spaced]
        new = []
        for w in words:
            if w in old:
                young[w] = old[w]
            elif w.split() == [w]:
                new.append(w)
            else:  # empty, or with other white space in it
                young[w] = None
        new.sort()
        young.update(zip(new, self.many([" " + w for w in new] if spaced else new), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for some in chunks(texts):
            out += self._some(some) if self.by_word else map(self.whole, some)
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        lines = [[x.split(" ") for x in t.split("\n")] for t in texts]
        self._meet({ws[0] for x in lines for ws in x}.difference(self.young[0]), 0)
        self._meet(set().union(*(ws[1:] for x in lines for ws in x)).difference(self.young[1]), 1)
        head, tail, end = self.young[0].__getitem__, self.young[1].__getitem__, self.line_end
        out = []
        for text, x in zip(texts, lines, strict=True):
            try:
                out.append(end.join([head(ws[0]) + b"".join(map(tail, ws[1:])) for ws in x]))
            except TypeError:  # a word without ids
                out.append(self.whole(text) if text else b"")
        for k in (0, 1):
            if len(self.young[k]) > self.most:
                self.old[k], self.young[k] = self.young[k], {}
        return out


class _Words(dict):
    """Packed ids of words, None where the rule doesn't hold; a new word is encoded when it is first asked for. Two generations of most words at most."""

    def __init__(self, spaced: Callable[[str], bytes | None], plain: Callable[[str], bytes | None], line_end: bytes, most: int):
        super().__init__()
        self.spaced, self.plain, self.line_end, self.most, self.old = spaced, plain, line_end, most, {}

    def known(self, word: str) -> bytes | None:
        return self.get(word) or self.old.get(word)

    def __missing__(self, word: str) -> bytes | None:
        ids = self.old.get(word)
        if ids is None:
            if word[:1] != "\n":
                ids = self.spaced(word)
            elif (ids := self.plain(word[1:])) is not None:
                ids = self.line_end + ids
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class BulkWordIds:
    """As WordIds, for Arrow arrays of texts: the library splits them and tells their distinct words, each of which is looked up once an array.

    spaced(word) encodes a word after a space, plain(word) one without; both give None for what isn't one word.
    """

    def __init__(self, spaced: Callable[[str], bytes | None], plain: Callable[[str], bytes | None], whole: Callable[[str], bytes], most: int):
        self.plain, self.whole = plain, whole
        self.words = _Words(spaced, plain, whole("\n"), most)

    def __call__(self, texts: pa.StringArray) -> list[bytes]:
        """A word after a line end keeps it in front, so that one look-up gives both."""
        if not len(texts):
            return []
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts, coded = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        ids = list(map(self.words.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        odds = np.zeros(len(coded) + 1, np.int64)
        if None in ids:
            odd = np.array([x is None for x in ids])[coded.indices.to_numpy()]
            odd[starts[:-1]] = False  # the first word has no space before it and is judged apart
            odds[1:] = np.cumsum(odd)
            ids = [x or b"" for x in ids]
        taken = pa.array(ids, pa.binary()).take(coded.indices)
        ends, data = np.frombuffer(taken.buffers()[1], np.int32), memoryview(taken.buffers()[2] or b"")
        out = []
        for k, first in enumerate(parts.values.take(pa.array(starts[:-1])).to_pylist()):
            a, b = int(starts[k]), int(starts[k + 1])
            head = self.plain(first) if odds[a] == odds[b] else None
            if head is not None:
                out.append(head + bytes(data[ends[a + 1] : ends[b]]))
            else:
                text = texts[k].as_py()
                out.append(self.whole(text) if text else b"")
        return out
