"""Find-all with Python ``re`` semantics (ignore case, Unicode).

Two ways to run a pattern:

* *native*: ``regexp_extract_all`` on the JVM, patterns as literals, so each is
  compiled once per task;
* *python*: one Arrow UDF that evaluates all patterns over a batch.

``dialect="auto"`` picks native only for a few patterns on which both engines
are known to agree, and the UDF for everything else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import itemgetter, or_
from re import _constants as ops
from re import _parser as parser
from typing import NamedTuple

import pyarrow as pa
try:
    import ahocorasick
except ImportError:  # literals are then looked for one by one
    ahocorasick = None
from pyspark.sql import Column
from pyspark.sql import functions as F

DIALECTS = ("auto", "native", "python")

# Ignore case, Unicode case folding, Unicode classes, and only \n ends a line.
# A pattern of the agreed shapes needs no Unicode classes, and no case folding
# either if it has no letter; both cost time.
NATIVE_FLAGS = "(?iuUd)"
NATIVE_FLAGS_AGREED = "(?iud)"
NATIVE_FLAGS_NO_LETTER = "(?d)"

# The non-ASCII characters that equal an ASCII letter when case
# is ignored but do not become that letter in lower case.
FOLDS_TO_ASCII = ("\u0130", "\u0131", "\u017f")

# Up to this many definitions the JVM is as fast as the Arrow UDF; with more,
# the substring test of Python (see required_literals) wins, by a factor of two
# at 20 definitions.  Measured; see the README.
MAX_NATIVE = 2

# From this many literals on, one automaton for all is faster than a substring
# search for each.  Measured; see the README.
MIN_AUTOMATON = 24
_NUMBER = itemgetter(1)

HIT_TYPE = "struct<definition:string,name_matches:array<string>,content_matches:array<string>>"

# The shapes on which the two engines agree: ASCII literals, escaped
# punctuation, lower-case or digit classes, greedy counts on a single
# character, plain groups.  A group may be optional but not repeated, because
# Java recurses once per repetition.
_COUNT = r"(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})(?![?+*{])"
_SINGLE = r"(?:[A-Za-z0-9 _@#%&=~\"'<>/:;,!`-]|\\[-.\\/^$*+?()\[\]{}|@#%&=~\"'<>:;,!]|\\[ntrf]|\.)"
_CLASS = (
    r"\[\^?(?:[a-z]-[a-z]|[0-9]-[0-9]|[A-Za-z0-9 _@#%=~\"'<>/:;,!.*+?(){}$`|]"
    r"|\\[-.\\/^$*+?()\[\]{}|]|\\[ntrf])+-?\]"
)
_TOKEN = rf"(?:(?:{_SINGLE}|{_CLASS})(?:{_COUNT})?|\((?:\?:)?|\)\??(?![?+*{{])|[\^$|])"
_AGREED = re.compile(rf"{_TOKEN}+")
_EMPTY_BRANCH = re.compile(r"(?:^|\(|\(\?:|\|)(?:\||\)|$)")


# By name, as the parser's own constants cannot be sent to the workers.
_CATEGORY = {"CATEGORY_DIGIT": r"\d", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_SPACE": r"\s",
             "CATEGORY_NOT_SPACE": r"\S", "CATEGORY_WORD": r"\w", "CATEGORY_NOT_WORD": r"\W"}


class Definition(NamedTuple):
    """A named regular expression."""

    definition: str
    pattern: str


def as_definitions(definitions) -> list[Definition]:
    """Accept a mapping, or a sequence of pairs, of name and pattern."""
    pairs = definitions.items() if hasattr(definitions, "items") else definitions
    result = [Definition(*pair) for pair in pairs]
    if not result:
        raise ValueError("no definitions to search with")
    if len({d.definition for d in result}) != len(result):
        raise ValueError("definition names must be unique")
    return result


def rejection(pattern: str) -> str | None:
    """Why ``pattern`` is no valid definition, or None if it is valid."""
    try:
        re.compile(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError) as e:
        return f"invalid regular expression: {e}"
    return None


def runs_native(pattern: str) -> bool:
    """True if the JVM finds the same matches as Python for ``pattern``.

    Patterns that can match the empty string are out: Java also finds one
    between the two halves of a surrogate pair.
    """
    if not _AGREED.fullmatch(pattern):
        return False
    bare = re.sub(r"\\.|\[\^?(?:\\.|[^\]\\])+\]", "x", pattern)
    if "|" in bare and ("^" in bare or "$" in bare or _EMPTY_BRANCH.search(bare)):
        return False
    return re.compile(pattern, re.IGNORECASE).search("") is None


def split_by_engine(definitions: Sequence[Definition], dialect: str):
    """Definitions for the native path and for the Python path."""
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}, not {dialect!r}")
    if dialect == "python":
        return [], list(definitions)
    if dialect == "native":
        return list(definitions), []
    if len(definitions) <= MAX_NATIVE and all(runs_native(d.pattern) for d in definitions):
        return list(definitions), []
    return [], list(definitions)


def required_literals(pattern: str) -> tuple[str, ...]:
    """ASCII texts, in lower case, one of which every match must contain.

    Empty if the pattern has no such texts.  A record without any of them
    cannot match, and looking for plain substrings is far cheaper than running
    the pattern.
    """
    needed = _needed(parser.parse(pattern, re.IGNORECASE))
    return max(needed, key=lambda texts: min(map(len, texts)), default=())


def _needed(items) -> list[tuple[str, ...]]:
    """Every group of texts of which a match of ``items`` must contain one."""
    needed, run = [], ""

    def end_run():
        nonlocal run
        if run:
            needed.append((run,))
        run = ""

    def walk(items):
        nonlocal run
        for op, value in items:
            if op is ops.LITERAL and value < 128:
                run += chr(value).lower()
            elif op is ops.SUBPATTERN:
                walk(value[3])
            elif op is not ops.AT:
                end_run()
                if op is ops.MAX_REPEAT and value[0] > 0:
                    needed.extend(_needed(value[2]))
                elif op is ops.BRANCH:
                    groups = [_needed(branch) for branch in value[1]]
                    if all(groups):
                        best = [max(g, key=lambda texts: min(map(len, texts))) for g in groups]
                        needed.append(tuple(text for texts in best for text in texts))

    walk(items)
    end_run()
    return needed


def fold(text: Column) -> Column:
    """Lower case text for substring tests, NULL where those are not decisive."""
    odd = [F.contains(text, F.lit(c)) for c in FOLDS_TO_ASCII]
    return F.when(~(odd[0] | odd[1] | odd[2]), F.lower(text))


def native_pattern(pattern: str) -> Column:
    if not runs_native(pattern):
        flags = NATIVE_FLAGS
    elif re.search("[A-Za-z]", re.sub(r"\\[ntrf]", "", pattern)):
        flags = NATIVE_FLAGS_AGREED
    else:
        flags = NATIVE_FLAGS_NO_LETTER
    return F.lit(flags + pattern)


def _may_match(folded: Column | None, pattern: str) -> Column | None:
    literals = () if folded is None else required_literals(pattern)
    if not literals:
        return None
    holds = reduce(or_, [F.contains(folded, F.lit(literal)) for literal in literals])
    return F.coalesce(holds, F.lit(True))


def find_all(text: Column, pattern: str, folded: Column | None = None) -> Column:
    """All matches of ``pattern`` in order; NULL text has none.

    With ``folded`` (see ``fold``) the pattern only runs on text that holds one
    of its required literals.
    """
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, native_pattern(pattern), F.lit(0))
    may_match = _may_match(folded, pattern)
    if may_match is not None:
        found = F.when(may_match, found)
    return F.coalesce(found, none)


def contains(text: Column, pattern: str, folded: Column | None = None) -> Column:
    """True if ``pattern`` occurs in ``text``; false for NULL."""
    occurs = F.regexp_like(text, native_pattern(pattern))
    may_match = _may_match(folded, pattern)
    if may_match is not None:
        occurs = may_match & occurs
    return F.coalesce(occurs, F.lit(False))


def _python_fold(value: str | None) -> str | None:
    if value is None or any(c in value for c in FOLDS_TO_ASCII):
        return None
    return value.lower()


def character(op, value) -> str | None:
    """The source of a parsed element that takes one character; None for another, or if
    it has no source that is known here."""
    if op.name == "ANY":
        return "."
    if op.name == "LITERAL":
        return f"\\U{value:08x}"
    if op.name == "NOT_LITERAL":
        return f"[^\\U{value:08x}]"
    if op.name != "IN":
        return None
    parts = []
    for kind, item in value:
        if kind is ops.NEGATE:
            parts.append("^")
        elif kind is ops.LITERAL:
            parts.append(f"\\U{item:08x}")
        elif kind is ops.RANGE:
            parts.append(f"\\U{item[0]:08x}-\\U{item[1]:08x}")
        elif kind is ops.CATEGORY and item.name in _CATEGORY:
            parts.append(_CATEGORY[item.name])
        else:
            return None
    return f"[{''.join(parts)}]"


def leading_run(pattern: str) -> str | None:
    """The source of the character of which ``pattern`` begins with any number, if it
    does and matches no empty text."""
    parsed = parser.parse(pattern, re.IGNORECASE)
    if parsed.state.flags & ~(re.IGNORECASE | re.UNICODE) or not parsed.getwidth()[0]:
        return None
    op, value = parsed[0]
    if op.name not in ("MAX_REPEAT", "MIN_REPEAT") or value[1] is not ops.MAXREPEAT \
            or len(value[2]) != 1:
        return None
    return character(*value[2][0])


class RunPattern:
    """A pattern that begins with a run of a character, searched as ``re`` does, in time
    that does not grow with the square of the runs.

    Where an attempt fails, those from the later places of the same run fail too: each
    would try what follows the run at some of the places at which the first has.  So an
    attempt is made only where a search begins and behind another character.
    """

    groups = 0

    def __init__(self, pattern: str, run: str):
        self._here = re.compile(pattern, re.IGNORECASE)
        self._later = re.compile(f"(?<!{run})(?:{pattern})", re.IGNORECASE)

    def search(self, value: str, at: int = 0) -> re.Match | None:
        return self._here.match(value, at) or self._later.search(value, at)

    def finditer(self, value: str, at: int = 0) -> Iterator[re.Match]:
        while (found := self.search(value, at)) is not None:
            yield found
            at = found.end()

    def findall(self, value: str) -> list[str]:
        return [m.group() for m in self.finditer(value)]


def compiled(pattern: str) -> re.Pattern | RunPattern:
    run = leading_run(pattern)
    return re.compile(pattern, re.IGNORECASE) if run is None else RunPattern(pattern, run)


class Matcher:
    """Definitions as the Python workers search with them.

    Patterns are compiled when a text first needs them, and the literals of many
    definitions are looked for all at once, by one automaton.
    """

    def __init__(self, definitions: Sequence[Definition]):
        self.definitions = list(definitions)
        self.literals = [required_literals(d.pattern) for d in self.definitions]
        #: Definitions that may match any text.
        self.always = [i for i, texts in enumerate(self.literals) if not texts]
        self._compiled, self._automaton = {}, None

    def __getstate__(self):
        return {**self.__dict__, "_compiled": {}, "_automaton": None}

    @staticmethod
    def fold(value: str | None) -> str | None:
        """Lower case for substring tests, None where those are not decisive."""
        return _python_fold(value)

    def pattern(self, i: int) -> re.Pattern | RunPattern:
        if i not in self._compiled:
            self._compiled[i] = compiled(self.definitions[i].pattern)
        return self._compiled[i]

    def _literal_automaton(self):
        """The automaton and, for each literal by number, the definitions it is of."""
        if self._automaton is None:
            owners = {}
            for i, texts in enumerate(self.literals):
                for literal in texts:
                    owners.setdefault(literal, []).append(i)
            automaton = None
            if len(owners) >= MIN_AUTOMATON and ahocorasick is not None:
                automaton = ahocorasick.Automaton()
                for number, literal in enumerate(owners):
                    automaton.add_word(literal, number)
                automaton.make_automaton()
            self._automaton = automaton, list(owners.items())
        return self._automaton

    def candidates(self, value: str | None) -> list[int]:
        """The definitions that may match ``value``, in order."""
        if value is None:
            return []
        folded = _python_fold(value)
        if folded is None:
            return list(range(len(self.definitions)))
        automaton, owners = self._literal_automaton()
        if automaton is None:
            held = {i for literal, of in owners if literal in folded for i in of}
        else:
            numbers = set(map(_NUMBER, automaton.iter(folded)))
            held = {i for number in numbers for i in owners[number][1]}
        return sorted(held.union(self.always))

    def find_all(self, i: int, value: str | None) -> list[str]:
        rx = self.pattern(i)
        return [m.group() for m in rx.finditer(value)] if rx.groups else rx.findall(value)

    def search(self, name: str | None, text: str | None) -> list[tuple]:
        """(definition, matches in name, matches in text) of what matches."""
        in_name, in_text = set(self.candidates(name)), set(self.candidates(text))
        hits = []
        for i in sorted(in_name | in_text):
            names = self.find_all(i, name) if i in in_name else []
            texts = self.find_all(i, text) if i in in_text else []
            if names or texts:
                hits.append((self.definitions[i].definition, names, texts))
        return hits

    def matching(self, name: str | None, text: str | None) -> list[str]:
        """The definitions that match."""
        def occurring(value):
            return {i for i in self.candidates(value) if self.pattern(i).search(value)}

        return [self.definitions[i].definition for i in sorted(occurring(name) | occurring(text))]


def python_search(definitions: Sequence[Definition]):
    """A function of name and text that gives the hits as tuples."""
    return Matcher(definitions).search


def python_hits(name: Column, text: Column, definitions: Sequence[Definition]) -> Column:
    """``array<HIT_TYPE>`` of the definitions that match, by Python ``re``."""
    search = python_search(definitions)
    strings = pa.list_(pa.string())
    hit = pa.struct([("definition", pa.string()), ("name_matches", strings),
                     ("content_matches", strings)])

    @F.arrow_udf(f"array<{HIT_TYPE}>")
    def hits(names: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [search(n, t) for n, t in zip(names.to_pylist(), texts.to_pylist())]
        return pa.array(rows, type=pa.list_(hit))

    return hits(name, text)


def python_matching(name: Column, text: Column, definitions: Sequence[Definition]) -> Column:
    """Names of the definitions that match anywhere, by Python ``re``."""
    matcher = Matcher(definitions)

    @F.arrow_udf("array<string>")
    def matching(names: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [matcher.matching(n, t) for n, t in zip(names.to_pylist(), texts.to_pylist())]
        return pa.array(rows, type=pa.list_(pa.string()))

    return matching(name, text)
