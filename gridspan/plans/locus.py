"""Places in words: `chr1:10k..chr1:20k`, `x=chr1; y=*`, and back."""

from __future__ import annotations

import re

#: Units of numbers.
UNITS = {"": 1, "da": 10, "h": 100, "k": 1_000, "m": 1_000_000, "g": 1_000_000_000}
NUMBER = re.compile(r"([+-]?[0-9][0-9,]*(?:\.[0-9]+)?) *(da|h|k|m|g)?(?:bp)?$", re.IGNORECASE)


def number(words: str) -> int | None:
    found = NUMBER.match(words.strip())
    return int(float(found[1].replace(",", "")) * UNITS[(found[2] or "").lower()]) if found else None


class Places:
    """Contigs (name, length in base pairs) in display order."""

    def __init__(self, contigs: list[tuple[str, int]]):
        self.contigs, self.start, at = contigs, {}, 0
        for name, length in contigs:
            self.start[name] = at
            at += length
        self.genome = at

    def contig(self, words: str) -> str | None:
        """The contig of that name, else the first that contains it, in either case."""
        words = words.strip().lower()
        names = [n for n, _ in self.contigs]
        return next((n for n in names if n.lower() == words), next((n for n in names if words and words in n.lower()), None))

    def _length(self, name: str) -> int:
        return dict(self.contigs)[name]

    def interval(self, words: str) -> tuple[int, int]:
        """`*`, `start`, `end`, `5m`, `chr`, `chr:pos`, `chr:pos+-w`, `a..b`, with or without
        brackets, in base pairs over all contigs."""
        words = words.strip().strip("[]").strip()
        if ".." in words:
            a, b = words.split("..", 1)
            return self.interval(a)[0], self.interval(b)[1]
        if words == "*" or not words:
            return 0, self.genome
        if words.lower() in ("start", "end"):
            at = 0 if words.lower() == "start" else self.genome
            return at, at
        if (n := number(words)) is not None:
            return n, n
        name, _, place = words.partition(":")
        contig = self.contig(name)
        if contig is None:
            raise ValueError(f"no contig is called {name}")
        first = self.start[contig]
        if not place:
            return first, first + self._length(contig)
        place, _, width = place.partition("+-")
        at = {"start": 0, "end": self._length(contig)}.get(place.strip().lower(), number(place))
        if at is None:
            raise ValueError(f"{place} is no place")
        w = number(width) if width else 0
        return first + at - w, first + at + w

    def area(self, words: str) -> tuple[int, int, int, int]:
        """`x=...; y=...`, or one interval for both axes."""
        parts = dict(p.split("=", 1) for p in (q.strip() for q in words.split(";")) if "=" in p)
        if not parts:
            both = [p for p in words.split(";") if p.strip()]
            x, y = (both * 2)[:2] if len(both) < 2 else both[:2]
        else:
            parts = {k.strip().lower(): v for k, v in parts.items()}
            x, y = parts.get("x", "*"), parts.get("y", "*")
        return (*self.interval(x), *self.interval(y))

    def readable(self, at: int) -> str:
        """A place over all contigs as `chr:pos`."""
        if at < 0 or at >= self.genome:
            return "start" if at < 0 else "end"
        name = next(n for n, length in self.contigs if self.start[n] <= at < self.start[n] + length)
        return f"{name}:{at - self.start[name]:,}"
