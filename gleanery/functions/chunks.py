"""The matches of a record as chunks: rows of bounded size, however many there are.

A chunk is (definition, chunk, whole, name_matches, content_matches).  Chunks of a
record and definition are numbered from 0, and their matches stand in order, those in
the name first.  ``whole`` says that a chunk is the only one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from gleanery.functions.regex import Matcher
from gleanery.functions.windows import WINDOW, Reach, WindowSearch, reaches

# A chunk ends with this many matches, or when they have this many characters.
CHUNK_MATCHES, CHUNK_CHARS = 100_000, 16 << 20
IN_NAME, IN_TEXT = 0, 1

CHUNK_SCHEMA = ("definition string, chunk bigint, whole boolean, name_matches array<string>,"
                " content_matches array<string>")


class _Open:
    """The chunk of a definition that still takes matches."""

    def __init__(self):
        self.number, self.held, self.count, self.size = 0, ([], []), 0, 0

    def next(self) -> None:
        self.number, self.held, self.count, self.size = self.number + 1, ([], []), 0, 0


class ChunkSearch:
    """Searches records one by one.

    ``window`` characters are searched at a time where a text comes in pieces, for
    the definitions whose reach allows it.
    """

    def __init__(self, definitions, chunk_matches: int = CHUNK_MATCHES, window: int = WINDOW):
        self.matcher = Matcher(definitions)
        self.reaches: dict[int, Reach] = reaches(self.matcher)
        self.chunk_matches, self.window = chunk_matches, window

    def _name(self, i: int) -> str:
        return self.matcher.definitions[i].definition

    def whole(self, name: str | None, text: str | None) -> Iterator[tuple]:
        """The chunks of a record whose text is at hand."""
        longest = max(len(name or ""), len(text or ""))
        # A text has one match more than characters at most.
        if longest < self.chunk_matches and longest <= CHUNK_CHARS:
            for definition, names, texts in self.matcher.search(name, text):
                if len(names) + len(texts) <= self.chunk_matches:
                    yield definition, 0, True, names, texts
                else:
                    yield from self._cut(definition, names, texts)
            return
        yield from self._chunks(self._found(name, [] if text is None else [text], False))

    def pieces(self, name: str | None, pieces: Iterable[str]) -> Iterator[tuple]:
        """The chunks of a record whose text comes in pieces."""
        yield from self._chunks(self._found(name, pieces, True))

    def _cut(self, definition, names, texts) -> Iterator[tuple]:
        size = self.chunk_matches
        for number, at in enumerate(range(0, len(names) + len(texts), size)):
            low = max(at - len(names), 0)
            high = max(at + size - len(names), 0)
            yield definition, number, False, names[at:at + size], texts[low:high]

    def _found(self, name, pieces, cut: bool) -> Iterator[tuple[int, int, str]]:
        """(definition, scope, match), in order within a definition and scope."""
        for i in self.matcher.candidates(name):
            for match in self.matcher.pattern(i).finditer(name):
                yield i, IN_NAME, match.group()
        within = self.reaches if cut else {}
        search = WindowSearch(self.matcher, within, self.window)
        rest = len(within) < len(self.matcher.definitions)
        kept = []
        for piece in pieces:
            if within:
                yield from ((i, IN_TEXT, match) for i, match in search.feed(piece))
            if rest:
                kept.append(piece)
        yield from ((i, IN_TEXT, match) for i, match in search.finish())
        if kept:
            text = "".join(kept)
            kept.clear()
            for i in self.matcher.candidates(text):
                if i not in within:
                    for match in self.matcher.pattern(i).finditer(text):
                        yield i, IN_TEXT, match.group()

    def _chunks(self, found) -> Iterator[tuple]:
        open_chunks: dict[int, _Open] = {}
        for i, scope, match in found:
            chunk = open_chunks.get(i)
            if chunk is None:
                chunk = open_chunks[i] = _Open()
            size = len(match)
            if chunk.count >= self.chunk_matches \
                    or chunk.count and chunk.size + size > CHUNK_CHARS:
                yield self._name(i), chunk.number, False, *chunk.held
                chunk.next()
            chunk.held[scope].append(match)
            chunk.count += 1
            chunk.size += size
        for i, chunk in sorted(open_chunks.items()):
            yield self._name(i), chunk.number, chunk.number == 0, *chunk.held
