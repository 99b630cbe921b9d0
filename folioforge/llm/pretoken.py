"""Splitting text into pre-tokens exactly as a tokenizer library does.

The `regex` module and the libraries carry different Unicode versions, so a few
recently assigned characters are letters to one and symbols to the other.  The
splitter therefore asks the library for the class of each character it has not
met before and, where the two disagree, splits a proxy of the text in which the
character is replaced by a plain one of the library's class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import regex

#: One plain character for each class a pre-token pattern can tell apart.
LETTER, NUMBER, SPACE, OTHER = "x", "1", "　", "!"
_CLASS = ((regex.compile(r"\p{L}"), LETTER), (regex.compile(r"\p{N}"), NUMBER), (regex.compile(r"\s"), SPACE))
#: Texts above this length are split as a stream, so that the list of pieces stays small.
STREAM_CHARS = 1 << 20


def regex_class(char: str) -> str:
    return next((c for pattern, c in _CLASS if pattern.match(char)), OTHER)


class Splitter:
    """Yields lists of pre-tokens; `library_class` names the library's class of a character."""

    def __init__(self, pattern: str, library_class: Callable[[str], str]) -> None:
        self.pattern = regex.compile(pattern)
        self.library_class = library_class
        self.known: set[str] = set(map(chr, range(128)))
        self.proxy: dict[int, str] = {}

    def _learn(self, chars: set[str]) -> None:
        for char in chars:
            wanted = self.library_class(char)
            if wanted != regex_class(char):
                self.proxy[ord(char)] = wanted
        self.known |= chars

    def lists(self, text: str) -> Iterator[list[str]]:
        if not text.isascii():
            new = set(text) - self.known
            if new:
                self._learn(new)
            if self.proxy:
                stand_in = text.translate(self.proxy)
                if stand_in != text:
                    spans = (m.span() for m in self.pattern.finditer(stand_in))
                    while block := [text[a:b] for a, b in islice(spans, 65536)]:
                        yield block
                    return
        if len(text) <= STREAM_CHARS:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(found, 65536)):
            yield block
