"""Does a text stop before its end? A classifier of endings, fitted on all texts.

Texts with a final mark are complete, but for marks that stand for a cut (an ellipsis, a replacement character) and
periods inside a number. Other endings are judged by what all texts show of places that are surely no cuts, because
the text goes on behind them: which segments without a final mark are whole (a sign-off, a sum) and are not merely the
beginning of longer segments; with which words list items end; and which numbers stand before a final period.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

COMPLETE, ITEM, INCOMPLETE = 0, 1, 2

SENTENCE = re.compile(r"(?<=[.!?…])[\"”»)]*\s+")
BULLET = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s+")
TERMINAL = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
CLOSED = re.compile(r"[)\]”»\"`>*_]$")
DOTS = re.compile(r"(?:\.{2,}|…)[\s.…]*$")
MARKS = re.compile(r"(?:�|\s*[\[(<](?:\.{3}|…|cut|truncated|snip)[\])>])+$", re.IGNORECASE)
NUMBER_END = re.compile(r"(\S+)\s+[^\s\d]*(\d[\d.,:]*)\.$")
PAID = re.compile(r"\d\s*[€$£]$")
#: Marks after which more must stand; a quotation mark only where it opens.
OPEN = frozenset(",;:-–—(/….[{¿¡&+@=<|„“‘'’\"`*_")
OPENED = re.compile(r"""(?:^|[\s(])["'‘’“„`*_]$""")  # behind a blank
LETTER_APOSTROPHE = re.compile(r"""(?:^|[\s(])[^\W\d_]*[^\W\d_]['’]$""")
LAST_NUMBER = re.compile(r"[#PT]$")  # masked; a number may itself be cut
PRICE, TIME, DIGITS = re.compile(r"\d+[.,]\d\d(?!\d)"), re.compile(r"\d{1,2}:\d\d(?!\d)"), re.compile(r"\d+")


ZEROS = bytes.maketrans(b"123456789", b"000000000")


def shape_of(text: str) -> bytes:
    """Texts of one shape are masked alike: their digits stand at the same places."""
    return text.encode("utf-8", "surrogatepass").translate(ZEROS)


def mask(text: str) -> str:
    """Numbers by their shape, blanks as one."""
    return " ".join((DIGITS.sub("#", TIME.sub("T", PRICE.sub("P", text))) if DIGITS.search(text) else text).split())


def segments(text: str) -> list[str]:
    """Lines of a list as they are, other lines cut into sentences."""
    out: list[str] = []
    for line in text.strip().split("\n"):
        out += [line] if BULLET.match(line) else [s for s in SENTENCE.split(line) if s and not s.isspace()]
    return out


def visible_end(text: str) -> str:
    return text.rstrip("​‌‍﻿⁠ \t\r\n\xa0")


def last_segments(end: str) -> list[str]:
    """The segments of the last line."""
    return segments(end.strip().rsplit("\n", 1)[-1])


def open_end(text: str) -> str | None:
    """The last segment, masked, if it is no list item and has no final mark."""
    parts = last_segments(visible_end(text))
    return mask(parts[-1]) if parts and not BULLET.match(parts[-1]) and (not TERMINAL.search(parts[-1]) or DOTS.search(parts[-1])) else None


def start_of(segment: str) -> str:
    """What a segment that goes on where this one ends begins with: dots and a last number, which may be cut, taken off."""
    return LAST_NUMBER.sub("", DOTS.sub("", segment))


class Starts:
    """Beginnings in order, each with the next shorter one that it begins with itself (-1: none)."""

    def __init__(self, starts: Iterable[str]):
        self.ordered = sorted(set(starts))
        self.shorter: list[int] = []
        open_: list[int] = []
        for k, s in enumerate(self.ordered):
            while open_ and not s.startswith(self.ordered[open_[-1]]):
                open_.pop()
            self.shorter.append(open_[-1] if open_ else -1)
            open_.append(k)

    def longest(self, segment: str) -> int:
        """The longest beginning of a segment: what stands between it and the segment in order begins with it."""
        k = bisect_right(self.ordered, segment) - 1
        while k >= 0 and not segment.startswith(self.ordered[k]):
            k = self.shorter[k]
        return k

    def totals(self, counts: dict[str, int]) -> dict[str, int]:
        """From counts by the longest beginning, those by every beginning."""
        out = [counts.get(s, 0) for s in self.ordered]
        for k in range(len(out) - 1, -1, -1):  # shorter ones come before
            if self.shorter[k] >= 0:
                out[self.shorter[k]] += out[k]
        return dict(zip(self.ordered, out))


#: What is counted: segments by their longest beginning, segments that are open ends elsewhere, words and word pairs of list items, numbers.
BEGUN, WHOLE, WORD_IN_LIST, PAIR_IN_LIST, NUMBER = range(5)
HEAD = 4  # characters by which most segments are told from all beginnings


class Tally:
    """Counts of texts: (kind, what) to how often, and of words and pairs in list items how often they end one; counts of
    parts of the texts add up."""

    def __init__(self, open_ends: Iterable[str]):
        self.whole = frozenset(open_ends)
        self.starts = Starts(map(start_of, self.whole))
        self.heads = {s[:HEAD] for s in self.starts.ordered}
        self.short = any(len(s) < HEAD for s in self.heads)
        self.n: Counter[tuple[int, str]] = Counter()
        self.ends: Counter[tuple[int, str]] = Counter()
        self.seen: dict[bytes, list[tuple[int, str]]] = {}  # of segments, as many recur, if only with other numbers

    def segment(self, part: str) -> tuple[list[tuple[int, str]], str | None]:
        """What a segment counts for, and the number it ends with."""
        shape = shape_of(part)
        counted = self.seen.get(shape)
        if counted is None:
            counted = []
            if part[:HEAD] in self.heads or not part[:HEAD].isalpha() or self.short:  # letters are masked by themselves: all others begin with none
                masked = mask(part)
                k = self.starts.longest(masked)
                counted = [(BEGUN, self.starts.ordered[k])] if k >= 0 else []
                if masked in self.whole:
                    counted.append((WHOLE, masked))
            if len(self.seen) >= 1 << 15:
                self.seen.clear()
            self.seen[shape] = counted
        m = NUMBER_END.search(" ".join(part.split()[-2:])) if part[-1:] == "." and (part[-2:-1].isdecimal() or part[-2:-1] in (".", ",", ":")) else None
        return counted, f"{m[1].lower()} {mask(m[2])}" if m else None

    def add(self, text: str) -> None:
        parts = segments(visible_end(text))
        for k, part in enumerate(parts):
            inside = k + 1 < len(parts)
            if BULLET.match(part):
                words = BULLET.sub("", part).split()
                pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
                for w in words:
                    self.n[WORD_IN_LIST, w] += 1
                for w in pairs:
                    self.n[PAIR_IN_LIST, w] += 1
                if inside and pairs:
                    self.ends[WORD_IN_LIST, words[-1]] += 1
                    self.ends[PAIR_IN_LIST, pairs[-1]] += 1
                continue
            counted, number = self.segment(part)
            for x in counted:
                self.n[x] += 1
            if inside and number:
                self.n[NUMBER, number] += 1


#: Least counts: of an open end to be asked about, of an end of list items, of a pair that decides by itself, of a number; least
#: share of the places where a word or pair stands that end an item, and largest share of longer segments.
LEAST_OPEN, LEAST_END, LEAST_PAIR, LEAST_NUMBER, RARE, LONGER = 3, 2, 8, 2, 0.03, 0.2


@dataclass
class Endings:
    """What complete endings look like."""

    whole: set[str] = field(default_factory=set)
    words: set[str] = field(default_factory=set)  # end list items
    pairs: dict[tuple[str, str], bool] = field(default_factory=dict)  # often seen in list items: may they end one?
    numbers: set[tuple[str, str]] = field(default_factory=set)

    @staticmethod
    def asked(open_ends: dict[str, int]) -> dict[str, int]:
        """Open ends that may be whole, by how often they stand at the end of a text."""
        return {s: n for s, n in open_ends.items() if n >= LEAST_OPEN and len(s.split()) > 1}

    @staticmethod
    def of(open_ends: dict[str, int], counts: Iterable[tuple[int, str, int, int]]) -> Endings:
        """From open ends (see `asked`) and the counts of all texts: kind, what, how often, how often at the end of an item."""
        out = Endings()
        begun: dict[str, int] = {}
        equal: dict[str, int] = {}
        for kind, what, n, ends in counts:
            if kind == BEGUN:
                begun[what] = n
            elif kind == WHOLE:
                equal[what] = n
            elif kind == WORD_IN_LIST:
                if ends >= LEAST_END and ends >= RARE * n:
                    out.words.add(what)
            elif kind == PAIR_IN_LIST:
                if n >= LEAST_PAIR:
                    out.pairs[tuple(what.split(" "))] = ends > 0 and ends >= RARE * n
            elif n >= LEAST_NUMBER:
                out.numbers.add(tuple(what.split(" ", 1)))
        upto = Starts(map(start_of, open_ends)).totals(begun)
        out.whole = {s for s, n in open_ends.items() if upto[start_of(s)] - equal.get(s, 0) <= LONGER * n}
        return out

    @staticmethod
    def fit(texts: Iterable[str]) -> Endings:
        """From texts at hand; `truncation.fit_endings` does the same over a table."""
        texts = list(texts)
        open_ends = Endings.asked(Counter(s for s in map(open_end, texts) if s is not None))
        tally = Tally(open_ends)
        for t in texts:
            tally.add(t)
        return Endings.of(open_ends, [(*k, n, tally.ends[k]) for k, n in tally.n.items()])

    def state(self, text: str) -> int:
        """COMPLETE, INCOMPLETE, or ITEM: a whole list item, after which a list may well have gone on."""
        end = visible_end(text)
        if not end:
            return COMPLETE
        if end[-1] in ".!?" and end[-2:-1].isalpha():
            return COMPLETE
        tail = end[-64:]
        if MARKS.search(tail):
            return INCOMPLETE
        dotted = DOTS.search(tail)
        if not dotted and TERMINAL.search(tail):
            m = NUMBER_END.search(tail) if tail[-1] == "." and tail[-2:-1].isdigit() else None
            return COMPLETE if m is None or (m[1].lower(), mask(m[2])) in self.numbers or "." in m[2] or ":" in m[2] or "," in m[2] else INCOMPLETE
        final = end[-1]
        bare = bool(OPENED.search(tail)) or (bool(LETTER_APOSTROPHE.search(tail)) and not re.search(r"(?:^|[\s(])['‘’]\w", end.rsplit("\n", 1)[-1]))
        if not bare and (CLOSED.search(tail) or final in "'’"):
            return COMPLETE
        if final in "€$£" and not PAID.search(tail):
            return INCOMPLETE
        if not final.isalnum() and final not in OPEN and not dotted:
            return COMPLETE  # an emoji, a currency sign
        parts = last_segments(end)
        if mask(parts[-1]) in self.whole:
            return COMPLETE
        line = end.rsplit("\n", 1)[-1]
        if BULLET.match(line):
            words = BULLET.sub("", line).split()
            if len(words) > 1 and self.pairs.get((words[-2], words[-1]), words[-1] in self.words):
                return ITEM
        return INCOMPLETE
