"""Many patterns over a text by one automaton.

Every match of a pattern holds one of its needles, so one Aho-Corasick pass over the lower-cased text, for all patterns
together, gives the few places where a pattern can match. Where every match begins with a needle, the pattern is tried
at the needles only; else in stretches around them, as long as a match can be with runs of white space or of word characters
of RUN characters at most. A text with a longer run, or with one of the letters that equal an ASCII letter only when
case is ignored, is scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cached_property

RUN = 40
_LONG_SPACE = re.compile(r"\s{%d}" % (RUN + 1))
#: Of every so many characters, a long run has four or more in a row.
_STRIDE, _FOUR_SPACES = RUN // 4, re.compile(r"\s{4}")
ODD_CASE = re.compile("[İıſK]")


def long_space(text: str) -> bool:
    """Whether a run of white space is longer than RUN."""
    return bool(_FOUR_SPACES.search(text[::_STRIDE]) and _LONG_SPACE.search(text))


def heads(parsed) -> list[str]:
    """Strings of two letters or more one of which every match begins with; [] when no such strings are known."""
    run, parsed = "", list(parsed)
    for i, (op, arg) in enumerate(parsed):
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
        elif not run and name == "MAX_REPEAT" and arg[0] == 0:  # what may be left out, and what follows
            found, rest = heads(arg[2]), heads(parsed[i + 1 :])
            return found + rest if found and rest else []
        elif run or name not in ("AT", "ASSERT", "ASSERT_NOT"):
            found = [run]
            if not run and name == "SUBPATTERN":
                found = heads(arg[-1])
            elif not run and name == "BRANCH":
                parts = [heads(part) for part in arg[1]]
                found = [h for part in parts for h in part] if all(parts) else []
            return found if found and min(map(len, found)) > 1 else []
    return [run] if len(run) > 1 else []


def width(parsed) -> int:
    """The most characters that a match can have, an endless repetition counting RUN times."""
    total = 0
    for op, arg in parsed:
        name = str(op)
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            total += width(arg[2]) * (int(arg[1]) if int(arg[1]) < 1000 else RUN)
        elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
            total += width(arg[-1] if name == "SUBPATTERN" else arg)
        elif name == "BRANCH":
            total += max(width(part) for part in arg[1])
        elif name in ("LITERAL", "NOT_LITERAL", "IN", "ANY", "CATEGORY", "RANGE"):
            total += 1
        elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
            raise ValueError(f"a pattern with {name}")
    return total


class Taken:
    """Disjoint intervals in order, with a logarithmic overlap test."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        return not ((i and self.ends[i - 1] > a) or (i < len(self.starts) and self.starts[i] < b))

    def add(self, a: int, b: int) -> None:
        i = bisect_right(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


class Led:
    """An alternation kept apart by what its alternatives begin with: digits, or words whose places are known.

    ``whole`` is the alternation, ``digits`` the alternatives that begin with a digit, which the search for a digit finds
    fast, ``words`` the others and ``after`` gives more places for these. No place begins both kinds, so taking the first
    of the two at every step gives the matches of ``whole``.
    """

    def __init__(self, whole: re.Pattern, digits: re.Pattern, words: re.Pattern, after=None):
        self.whole, self.digits, self.words, self.after = whole, digits, words, after

    def finditer(self, text: str):
        return self.whole.finditer(text)

    def spans(self, text: str, places: list[int]) -> list[tuple[int, int]]:
        """The disjoint matches from left to right."""
        if self.after is not None:
            places = places + self.after(text)
        search, digit = self.digits.search, self.digits.search(text)
        if not places:
            return [hit.span() for hit in self.digits.finditer(text)] if digit else []
        words = [hit for at in sorted(set(places)) if (hit := self.words.match(text, at))]
        out, free = [], 0
        for word in words:
            a, b = word.span()
            while digit and digit.start() < a:
                out.append(digit.span())
                free = digit.end()
                digit = search(text, free)
            if a >= free:
                out.append((a, b))
                free = b
                if digit and digit.start() < free:
                    digit = search(text, free)
        while digit:
            out.append(digit.span())
            digit = search(text, digit.end())
        return out


class Finder:
    """Hits of several lexicons of (label, pattern, needles, heads, longest match), in one pass over a text."""

    def __init__(self, lexicons: dict[str, list]):
        self.lexicons = lexicons
        self.entries = [(name, *entry) for name, entries in lexicons.items() for entry in entries]
        self.led = [i for i, entry in enumerate(self.entries) if isinstance(entry[2], Led)]
        self.alone = {i for i, entry in enumerate(self.entries) if len(lexicons[entry[0]]) == 1}
        self.needed = {i: entry[3] for i, entry in enumerate(self.entries) if entry[3] and entry[4] and not set(entry[3]) <= set(entry[4]) and i not in self.led}
        self.headed = {i: entry[2].match for i, entry in enumerate(self.entries) if entry[4] and i not in self.led}
        self.always = [i for i, entry in enumerate(self.entries) if i not in self.led and not entry[3] and not entry[4]]

    @cached_property
    def automaton(self):
        import ahocorasick

        by_needle: dict[str, list[int]] = {}
        for i, (_, _, _, needles, heads, _) in enumerate(self.entries):
            for needle in heads or needles:
                by_needle.setdefault(needle, []).append(i)
        automaton = ahocorasick.Automaton()
        for needle, entries in by_needle.items():
            automaton.add_word(needle, (len(needle) - 1, entries))
        automaton.make_automaton()
        return automaton

    def places(self, text: str, longest_token: int) -> dict[int, list[tuple[int, int]]]:
        """Of every entry that may match, in order, where its needles are: (start, last); None for the whole text."""
        if longest_token > RUN or long_space(text) or (not text.isascii() and ODD_CASE.search(text)):
            return dict.fromkeys(range(len(self.entries)))
        found: dict[int, list[tuple[int, int]]] = dict.fromkeys(self.always)
        found.update((i, []) for i in self.led)
        low, lacking = text.lower(), set()
        for end, (back, entries) in self.automaton.iter(low):
            for i in entries:
                if i in found:
                    found[i].append((end - back, end))
                elif i not in lacking:
                    # A match that begins with a head holds a needle, too.
                    if i in self.needed and not any(needle in low for needle in self.needed[i]):
                        lacking.add(i)
                    else:
                        found[i] = [(end - back, end)]
        return dict(sorted(found.items()))

    def matches(self, i: int, text: str, places) -> list[tuple[int, int]]:
        """The disjoint matches of an entry from left to right."""
        _, _, pattern, _, heads, reach = self.entries[i]
        if places is None:
            return [hit.span() for hit in pattern.finditer(text)]
        if isinstance(pattern, Led):
            return pattern.spans(text, [start for start, _ in places])
        out, free = [], 0
        if heads:
            for start, _ in places if len(places) == 1 else sorted(places):
                if start >= free and (hit := pattern.match(text, start)):
                    out.append(hit.span())
                    free = max(hit.end(), start + 1)
            return out
        stretches: list[list[int]] = []
        for start, last in sorted(places):
            lo, hi = max(0, start - reach - 1), last + reach + 2
            if stretches and lo <= stretches[-1][1]:
                stretches[-1][1] = max(hi, stretches[-1][1])
            else:
                stretches.append([lo, hi])
        return [hit.span() for lo, hi in stretches for hit in pattern.finditer(text, lo, hi)]

    def hits(self, text: str, longest_token: int) -> dict[str, list[tuple[str, int, int]]]:
        """(label, start, end) by lexicon in text order; within a lexicon an earlier entry wins an overlap."""
        out: dict[str, list[tuple[str, int, int]]] = {name: [] for name in self.lexicons}
        taken: dict[str, Taken] = {}
        for i, places in self.places(text, longest_token).items():
            if i in self.headed and places and len(places) == 1:
                hit = self.headed[i](text, places[0][0])
                spans = [hit.span()] if hit else ()
            else:
                spans = self.matches(i, text, places)
            if spans:
                name, label = self.entries[i][:2]
                if i in self.alone:  # the matches of one pattern are disjoint and in order
                    out[name] = [(label, a, b) for a, b in spans]
                    continue
                held = taken.setdefault(name, Taken())
                for a, b in spans:
                    if held.free(a, b):
                        held.add(a, b)
                        out[name].append((label, a, b))
        for name in taken:
            if len(out[name]) > 1:
                out[name].sort(key=lambda s: s[1:])
        return out
