"""What a line must hold before any of a list of patterns can match it, derived from the patterns themselves.

Every pattern is walked once; each stretch of it with finitely many spellings (joined characters,
small sets, choices, options) is a set of literals of which every match holds one. The set whose
shortest literal is longest becomes the pattern's cue, so the filter can save work but never a match.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from re import _constants as C
from re import _parser

import ahocorasick

#: Zero-width marks of a literal: no word goes on before it, or after it, only blanks of the line come before it, or an edge of a word is there.
BEGIN, END, FIRST, EDGE = "\0", "\1", "\2", "\3"
#: Most spellings of one stretch.
MOST = 400
#: Characters that match i or s without case though they are not so in lower case.
ODD = ["ı", "ſ", "i̇"]
_FEED = re.compile("\n")


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _bare(x: str) -> str:
    return x.strip(BEGIN + END + FIRST + EDGE)


def _joined(a: str, b: str) -> str:
    """Two adjacent stretches; marks within the whole say nothing more."""
    if not _bare(a):
        return b if b[:1] in (BEGIN, FIRST, EDGE) or not a else a[:1] + b
    return a.rstrip(END) + b.lstrip(BEGIN + FIRST + EDGE) if _bare(b) else a.rstrip(END) + (END if END in a[-1:] + b else "")


class _Walk:
    """A sequence read so far: ``now``, the spellings of the open stretch, and ``found``, the sets of the closed ones.

    ``fold``: the stretch holds without case. ``head``: the first stretch, None while it is open.
    """

    def __init__(self) -> None:
        self.now, self.fold, self.found, self.head = {""}, False, [], None

    def join(self, more: set[str], fold: bool) -> None:
        joined = {_joined(a, b) for a in self.now for b in more} if len(self.now) * len(more) <= 4 * MOST else set()
        if joined and len(joined) <= MOST:
            self.now, self.fold = joined, self.fold or fold
        else:
            self.end()
            if len(more) <= MOST:
                self.now, self.fold = more, fold

    def end(self) -> None:
        """Closes the stretch; what follows is not next to it."""
        if self.head is None:
            self.head = self.now, self.fold
        if all(_bare(x) for x in self.now):
            self.found.append((self.now, self.fold))
        self.now, self.fold = {""}, False


def _members(items: list) -> set[str] | None:
    """The characters of a set, or None for a large or negated one."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg))
        elif op is C.RANGE and arg[1] - arg[0] < MOST:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 70 else None


def _no_word(op: object, arg: tuple, ahead: bool) -> bool:
    """Whether an item says that no character of a word comes next to it."""
    if op is not C.ASSERT_NOT or (arg[0] > 0) != ahead or len(arg[1]) != 1 or arg[1][0][0] is not C.IN:
        return False
    items = arg[1][0][1]
    return (C.CATEGORY, C.CATEGORY_WORD) in items and items[0][0] is not C.NEGATE


def _walk(items: Sequence, fold: bool) -> _Walk:
    """Reads a sequence; where it has few spellings as a whole, ``head`` stays None and they are in ``now``."""
    w = _Walk()
    for op, arg in items:
        if op is C.LITERAL:
            w.join({chr(arg)}, fold)
        elif op is C.IN and (m := _members(arg)):
            w.join(m, fold)
        elif op is C.AT:
            if arg is C.AT_BOUNDARY:
                w.now = {(x or EDGE) if not _bare(x) else x.rstrip(END) + (END if _word(x.rstrip(END)[-1]) else "") for x in w.now}
            elif arg is C.AT_BEGINNING:
                w.now = {x if _bare(x) else FIRST for x in w.now}
        elif op in (C.ASSERT, C.ASSERT_NOT):
            if _no_word(op, arg, False) and w.now == {""}:
                w.now = {BEGIN}
            elif _no_word(op, arg, True):
                w.now = {x.rstrip(END) + END if _bare(x) else x for x in w.now}
        elif op in (C.SUBPATTERN, C.BRANCH):
            parts = [_walk(arg[3], (fold or bool(arg[1] & re.I)) and not arg[2] & re.I)] if op is C.SUBPATTERN else [_walk(x, fold) for x in arg[1]]
            heads = [p.head or (p.now, p.fold) for p in parts]
            w.join(set().union(*(h[0] for h in heads)), any(h[1] for h in heads))
            if any(p.head for p in parts):
                w.end()
                each = [_best(p) for p in parts]
                if all(each):
                    w.found.append((set().union(*(x for x, _ in each)), any(f for _, f in each)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = arg
            if w.now == {FIRST} and least == 0 and list(inner) == [(C.IN, [(C.CATEGORY, C.CATEGORY_SPACE)])]:
                w.head = w.head or ({""}, False)
                continue
            part = _walk(inner, fold)
            if part.head is None and most == 1:
                w.join(part.now | {""} if least == 0 else part.now, part.fold)
                continue
            for _ in range(min(least, 4) if part.head is None else 0):
                w.join(part.now, part.fold)
            w.end()
            if least:
                w.found += part.found
        else:
            w.end()
    if w.head is not None:
        w.end()
    return w


def _best(w: _Walk) -> tuple[set[str], bool] | None:
    found = w.found if w.head is not None or not all(map(_bare, w.now)) else [(w.now, w.fold)]
    return max(found, key=lambda x: (min(len(_bare(y)) for y in x[0]), -len(x[0])), default=None)


def cues_of(pattern: str) -> tuple[set[str], bool]:
    """Literals with marks of which every match of the pattern holds one, and whether they are in lower case.

    Raises ValueError for a pattern that can match without any.
    """
    parsed = _parser.parse(pattern)
    best = _best(_walk(parsed, bool(parsed.state.flags & re.I)))
    if best is None:
        raise ValueError(f"no literal is needed by {pattern}")
    out: set[str] = set()
    for x in best[0]:
        bare = _bare(x)
        begin = x[0] if x[0] in (BEGIN, FIRST) else BEGIN if x[0] == EDGE and _word(bare[0]) else ""
        out.add(begin + (bare.lower() if best[1] else bare) + (END if x[-1] == END and _word(bare[-1]) else ""))
    return out, best[1]


class _Finder:
    """An automaton over cues with their marks, each of which stands for some bits."""

    def __init__(self, cues: Mapping[str, int]):
        plain: dict[str, dict] = {}
        for c, bits in cues.items():
            marks = plain.setdefault(_bare(c), {})
            m = c[0] if c[0] in (BEGIN, FIRST) else "", c[-1] == END
            marks[m] = marks.get(m, 0) | bits
        self.automaton = ahocorasick.Automaton() if plain else None
        for bare, marks in plain.items():
            self.automaton.add_word(bare, (len(bare), tuple((*m, bits) for m, bits in marks.items())))
        if plain:
            self.automaton.make_automaton()

    def ends(self, text: str) -> Iterator[tuple[int, int]]:
        """Where cues end whose marks hold, with their bits; the lines of the text are told apart by line feeds."""
        for end, (length, marks) in self.automaton.iter(text) if self.automaton else ():
            at, after, found = end + 1 - length, text[end + 1 : end + 2], 0
            for begin, ends, bits in marks:
                if ends and after and _word(after):
                    continue
                if not begin or not at or (not _word(text[at - 1]) if begin == BEGIN else not text[text.rfind("\n", 0, at) + 1 : at].strip()):
                    found |= bits
            if found:
                yield end, found


class Prefilter:
    """For groups of patterns, each with a bit: which groups can match a line. A group that is not named matches none."""

    def __init__(self, groups: Mapping[int, Sequence[str]]):
        written: dict[str, int] = {}
        lower = dict.fromkeys(ODD, sum(groups))
        for bit, patterns in groups.items():
            for p in patterns:
                cues, fold = cues_of(p)
                to = lower if fold else written
                for c in cues:
                    to[c] = to.get(c, 0) | bit
        self.as_written, self.in_lower = _Finder(written), _Finder(lower)

    def __call__(self, line: str) -> int:
        found = 0
        for finder, x in ((self.as_written, line), (self.in_lower, line.lower())):
            for _, bits in finder.ends(x):
                found |= bits
        return found

    def lines(self, text: str, low: str) -> dict[int, int]:
        """The numbers of the lines of a text, given as it is and in lower case, that may match, with the bits of what may."""
        found: dict[int, int] = {}
        for finder, x in ((self.as_written, text), (self.in_lower, low)):
            starts: list[int] = []
            for end, bits in finder.ends(x):
                starts = starts or [0, *(m.end() for m in _FEED.finditer(x))]
                i = bisect_right(starts, end) - 1
                found[i] = found.get(i, 0) | bits
        return found


def prefilter(patterns: Sequence[str]) -> Prefilter:
    return Prefilter({1: patterns})
