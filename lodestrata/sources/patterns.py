"""Many byte strings searched for in one pass."""

from __future__ import annotations

import ahocorasick


class Patterns:
    """Finds all patterns at once by an automaton, so that the time doesn't grow with their number. Equal patterns may repeat."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        where: dict[str, list[int]] = {}
        for k, p in enumerate(patterns):
            if p:
                where.setdefault(p.decode("latin-1"), []).append(k)
        self.automaton = ahocorasick.Automaton()
        for text, numbers in where.items():
            self.automaton.add_word(text, (len(text), tuple(numbers)))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def __reduce__(self):
        return Patterns, (self.patterns,)

    def places(self, data: bytes) -> list[tuple[int, int]]:
        """(place, pattern) of all occurrences in order; those of one pattern don't overlap, the first ones count."""
        if self.empty:
            return []
        out, free = [], {}
        for last, (n, numbers) in self.automaton.iter(data.decode("latin-1")):
            at = last - n + 1
            for k in numbers:
                if at >= free.get(k, 0):
                    out.append((at, k))
                    free[k] = last + 1
        return sorted(out)

    def within(self, data: bytes) -> list[int]:
        """The patterns that occur, in their order."""
        if self.empty:
            return []
        return sorted({k for _, (_, numbers) in self.automaton.iter(data.decode("latin-1")) for k in numbers})
