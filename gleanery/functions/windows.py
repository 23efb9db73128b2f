"""Find-all over a text that comes in pieces, equal to find-all over the whole.

An attempt to match at a place looks at no more of the text than its pattern lets
it.  Without unbounded repeats that is a number of characters.  With them, it is
what the characters say that no unbounded repeat takes, the *barriers*: each one
that an attempt passes is taken by one of its bounded parts, which are so many and
no more.  ``<a href="[^"]*"`` passes at most ten quotes, say, and ``a.*b`` two line
feeds.  So an attempt is decided when enough barriers lie behind its place, and what
no undecided attempt can look at is forgotten.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as ops
from re import _parser as parser
from typing import NamedTuple

from gleanery.functions.regex import Matcher, character

# Characters that are gathered before they are searched.
WINDOW = 1 << 20
# Bounded parts of more characters than this call for the whole text.
MAX_BARRIERS = 1 << 20

# By name, as the parser's own constants cannot be sent to the workers.
_SINGLE = ("LITERAL", "NOT_LITERAL", "IN", "ANY")
_REPEAT = ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT")


class Reach(NamedTuple):
    """An attempt looks ``behind`` characters back, and ahead no further than the
    ``barriers``-th character from its place on that ``barrier`` finds, any character
    if that is None."""

    behind: int
    barriers: int
    barrier: re.Pattern | None


class _NoReach(Exception):
    """The pattern says nothing about how far an attempt looks."""


def _character(op, value) -> str:
    """The source of an element that takes one character."""
    source = character(op, value)
    if source is None:
        raise _NoReach
    return source


class _Measure:
    """Goes through a parsed pattern once."""

    def __init__(self):
        self.behind, self.repeated = 0, set()

    def bounded(self, items) -> int:
        """How many characters the bounded parts of ``items`` take at most, those
        that look-arounds look at among them."""
        total = 0
        for op, value in items:
            if op.name in _SINGLE:
                total += 1
            elif op is ops.BRANCH:
                total += max(map(self.bounded, value[1]))
            elif op.name in _REPEAT:
                if value[1] is ops.MAXREPEAT:
                    self.unbounded(value[2])
                else:
                    total += value[1] * self.bounded(value[2])
            else:
                total += sum(map(self.bounded, self._parts(op, value)))
        return total

    def unbounded(self, items) -> None:
        """Note every character that an unbounded repeat of ``items`` takes."""
        for op, value in items:
            if op.name in _SINGLE:
                self.repeated.add(_character(op, value))
            elif op is ops.BRANCH:
                for branch in value[1]:
                    self.unbounded(branch)
            elif op.name in _REPEAT:
                self.unbounded(value[2])
            else:
                for part in self._parts(op, value):
                    self.unbounded(part)

    def _parts(self, op, value) -> list:
        """What else an element is made of."""
        if op in (ops.AT, ops.FAILURE):
            return []
        if op is ops.ATOMIC_GROUP:
            return [value]
        if op is ops.SUBPATTERN and not (value[1] or value[2]):
            return [value[3]]
        if op in (ops.ASSERT, ops.ASSERT_NOT):
            if value[0] < 0:
                self.behind += value[1].getwidth()[1]
            return [value[1]]
        # References to groups; flags of a part, which change what others mean.
        raise _NoReach


def reach(pattern: str) -> Reach | None:
    """How far an attempt to match ``pattern`` looks; None if it may be any far."""
    parsed = parser.parse(pattern, re.IGNORECASE)
    measure = _Measure()
    try:
        barriers = measure.bounded(parsed)
    except _NoReach:
        return None
    if barriers > MAX_BARRIERS:
        return None
    barrier = None
    if measure.repeated:
        flags = parsed.state.flags & (re.IGNORECASE | re.DOTALL | re.ASCII)
        barrier = re.compile(f"(?!{'|'.join(sorted(measure.repeated))})[\\s\\S]", flags)
    # One more ends the attempt, and one more keeps it off the end of the piece,
    # where "$" holds; in front, one keeps it off the beginning.
    return Reach(measure.behind + 1, barriers + 2, barrier)


class _Progress:
    """Where the search for one definition is, in characters from the beginning."""

    def __init__(self, found: Reach):
        self.reach = found
        # The next attempt, and whether an empty match there is known already.
        self.at, self.skip = 0, False
        self.decided = -1
        # Places of the last barriers that have come.
        self.last = []

    def come(self, piece: str, begin: int) -> None:
        """Note the barriers of a piece: its last ones, from the end."""
        wanted, barrier = self.reach.barriers, self.reach.barrier
        if barrier is None:
            self.decided = begin + len(piece) - wanted
            return
        found, high, width = [], len(piece), 256
        while high and len(found) < wanted:
            low = max(high - width, 0)
            found = [begin + m.start() for m in barrier.finditer(piece, low, high)] + found
            high, width = low, 2 * width
        self.last = (self.last + found)[-wanted:]
        if len(self.last) == wanted:
            self.decided = self.last[0]

    def keep_from(self) -> int:
        return max(self.at - self.reach.behind, 0)


def reaches(matcher: Matcher) -> dict[int, Reach]:
    """The reach of the definitions that have one, by number."""
    found = {i: reach(d.pattern) for i, d in enumerate(matcher.definitions)}
    return {i: one for i, one in found.items() if one is not None}


class WindowSearch:
    """Matches of definitions that have a reach, in a text that comes in pieces.

    ``feed`` and ``finish`` give (index, match) of the matches that are decided by
    then; those of a definition are in order.
    """

    def __init__(self, matcher: Matcher, reaches: dict[int, Reach], window: int = WINDOW):
        self.matcher, self.window = matcher, window
        self.progress = {i: _Progress(found) for i, found in reaches.items()}
        self.text, self.begin = "", 0
        self.waiting, self.size = [], 0

    def feed(self, piece: str) -> Iterator[tuple[int, str]]:
        self.waiting.append(piece)
        self.size += len(piece)
        # A text that cannot be forgotten is gone through ever more rarely.
        if self.size >= max(self.window, len(self.text)):
            yield from self._search(final=False)

    def finish(self) -> Iterator[tuple[int, str]]:
        yield from self._search(final=True)

    def _search(self, final: bool) -> Iterator[tuple[int, str]]:
        piece, self.waiting, self.size = "".join(self.waiting), [], 0
        end = self.begin + len(self.text)
        self.text += piece
        candidates = set(self.matcher.candidates(self.text))
        for i, progress in self.progress.items():
            if piece:
                progress.come(piece, end)
            if final:
                progress.decided = end + len(piece)
            if progress.at > progress.decided:
                continue
            if i in candidates:
                yield from self._matches(i, progress)
            if progress.at <= progress.decided:
                progress.at, progress.skip = progress.decided + 1, False
        kept = min((p.keep_from() for p in self.progress.values()), default=end + len(piece))
        kept = min(kept, end + len(piece))
        self.text, self.begin = self.text[kept - self.begin:], kept

    def _matches(self, i: int, progress: _Progress) -> Iterator[tuple[int, str]]:
        found = self.matcher.pattern(i).finditer(self.text, progress.at - self.begin)
        if progress.skip:
            next(found, None)
        last, decided = None, progress.decided - self.begin
        for match in found:
            if match.start() > decided:
                break
            last = match
            yield i, match.group()
        if last is not None:
            progress.at, progress.skip = last.end() + self.begin, last.end() == last.start()
