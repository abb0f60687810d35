"""Words within a few edits of a list, found by the deletions both share instead of by scanning the list."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

#: Letters of the longest word that has misspellings.
LONGEST = 40


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transposition of neighbours, or most + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
    return row[-1]


def deletions(word: str, most: int) -> set[str]:
    """The word with up to `most` letters left out, in every way."""
    return {word} | {"".join(word[i] for i in keep) for n in range(1, min(most, len(word)) + 1) for keep in combinations(range(len(word)), len(word) - n)}


class Near:
    """An index of words: two words within k edits share a string that each becomes by leaving out up to k letters.

    Its size is that of the words times their deletions (about half the square of a word's letters for two edits), and a
    look-up costs the deletions of one word, whatever the number of words. Words above LONGEST letters are not indexed: they
    are found by nothing but themselves. With `prefix`, only so many first letters are indexed: an alignment of k edits leaves at
    most k letters of either prefix without a partner in the other, so nothing is missed, and the index is smaller.
    """

    def __init__(self, words: Iterable[str], most: int, prefix: int | None = None):
        self.prefix = prefix
        self.most, self.words = most, sorted({w for w in words if len(w) <= LONGEST})
        self.longest = max(map(len, self.words), default=0)
        self.of: dict[int, list[int] | int] = {}
        for i, w in enumerate(self.words):
            for d in deletions(w[:prefix], most):
                h = hash(d)
                at = self.of.get(h)
                if at is None:
                    self.of[h] = i
                elif isinstance(at, int):
                    self.of[h] = [at, i]
                else:
                    at.append(i)

    def maybe(self, word: str, most: int | None = None) -> set[int]:
        """Places of the words that may be within `most` edits; all that are, and few more."""
        out: set[int] = set()
        if len(word) > self.longest + self.most:
            return out
        for d in deletions(word[: self.prefix], self.most if most is None else min(most, self.most)):
            at = self.of.get(hash(d))
            if at is not None:
                out.update((at,) if isinstance(at, int) else at)
        return out

    def find(self, word: str, most: int | None = None) -> list[tuple[int, str]]:
        """(edits, word) of all words within `most` edits, nearest first, then in order."""
        k = self.most if most is None else min(most, self.most)
        found = ((edits(word, self.words[i], k), self.words[i]) for i in self.maybe(word, k))
        return sorted((d, w) for d, w in found if d <= k)
