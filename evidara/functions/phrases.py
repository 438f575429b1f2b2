"""Many keys looked for in many texts at once."""

from __future__ import annotations

from collections.abc import Iterable

#: Keys that are looked for one by one; more are looked for together.
FEW = 24


class Phrases:
    """``found(text)``: the keys that occur in a text, anywhere, also within words.

    Keys and texts are comparison keys: words parted by single blanks. A key of several words
    lies across blanks of the text: its first word ends a word of the text, its last one
    begins one, and those between are whole words, which a trie follows.
    """

    def __init__(self, keys: Iterable[str]):
        self.keys = sorted({k for k in keys if k})
        self.inner: set[str] = set()
        self.sizes: list[int] = []
        self.root: dict = {}
        self.memo: dict[str, tuple] = {}
        if len(self.keys) > FEW:
            for k in self.keys:
                first, *rest = k.split(" ")
                if not rest:
                    self.inner.add(k)
                    continue
                node = self.root
                for w in rest[:-1]:
                    node = node.setdefault(w, {})
                # None leads to what ends here: by last word, then by first word, the key
                node.setdefault(None, {}).setdefault(rest[-1], {})[first] = k
            self.sizes = sorted({len(k) for k in self.inner})

    def _within(self, word: str) -> tuple:
        got = self.memo.get(word)
        if got is None:
            got = tuple({word[i : i + n] for n in self.sizes if n <= len(word) for i in range(len(word) - n + 1)} & self.inner)
            if len(self.memo) < 500_000:
                self.memo[word] = got
        return got

    def found(self, text: str) -> set[str]:
        if len(self.keys) <= FEW:
            return {k for k in self.keys if k in text}
        out: set[str] = set()
        words = text.split(" ")
        if self.inner:
            for w in set(words):
                out.update(self._within(w))
        root, ends_at_once = self.root, None in self.root
        for i in range(len(words) - 1):
            if not ends_at_once and words[i + 1] not in root:
                continue
            node, j = root, i + 1
            while node is not None:
                ends = node.get(None)
                if ends:
                    w = words[j]
                    for n in range(1, len(w) + 1):
                        heads = ends.get(w[:n])
                        if heads:
                            before = words[i]
                            for m in range(len(before)):
                                k = heads.get(before[m:])
                                if k is not None:
                                    out.add(k)
                node = node.get(words[j])
                j += 1
                if j == len(words):
                    break
        return out
