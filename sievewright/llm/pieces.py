"""Cutting text into the pieces that byte-level merges work on, through caches of bounded size.

A single space between two characters that are no white space always begins a piece. So a text is cut
there first (``str.split``), and only parts not seen before meet the pattern. Parts that touch other white space
make their whole text take the plain way, the pattern over all of it: results never depend on the shortcut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import regex

#: Entries of each of the two generations of a cache.
CACHE_ENTRIES = 250_000


def regular(part: str) -> bool:
    return bool(part) and not part[0].isspace() and not part[-1].isspace()


class Generations:
    """A cache of at most twice ``entries``: what is used again outlives what is not."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.entries, self.young, self.old = entries, {}, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """The keys without a value; the others can be read from ``young`` until the next call."""
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    new.append(k)
        return new


class Parts:
    """Values of texts, by the parts between their spaces; ``value`` maps lists of pieces to their values."""

    def __init__(self, pattern: str, value: Callable[[list[list[str]]], list], entries: int = CACHE_ENTRIES):
        self.find, self.value, self.cache = regex.compile(pattern).findall, value, Generations(entries)

    def fill(self, parts: Iterable[str]) -> None:
        """Compute all parts that are missing, together; ``None`` for a part that needs its neighbours."""
        new = self.cache.missing(parts)
        ok = [p for p in new if regular(p)]
        young = self.cache.young
        young.update(dict.fromkeys(new))
        young.update(zip(ok, self.value([self.find(" " + p) for p in ok]), strict=True))

    def of(self, texts: list[str]) -> list[list]:
        """For each text the values of its parts in order; concatenated or added up they are the text's value."""
        cut = [t.split(" ") for t in texts]
        heads = [c[0] for c in cut]
        self.fill({p for c in cut for p in c[1:]})
        get, out = self.cache.young.get, []
        for k, c in enumerate(cut):
            values = list(map(get, c[1:]))
            if (len(c) > 1 and heads[k][-1:].isspace()) or (len(c) > 1 and not heads[k]) or None in values:
                out.append(None)
            else:
                out.append(values)
        first = self.value([self.find(texts[k] if out[k] is None else heads[k]) for k in range(len(cut))])
        return [[first[k]] if out[k] is None else [first[k], *out[k]] for k in range(len(cut))]
