"""What the parsers share."""

from __future__ import annotations

import sys

#: Calls that one step of nesting may take; frames of Python functions live on the heap, so the limit only has to be high enough.
CALLS = 60


def allow_nesting(text: str) -> None:
    """Let the parsers follow whatever nesting a text of this many openings can have."""
    openings = sum(text.count(c) for c in "([{<?!~-+*&:`") + 1_000
    sys.setrecursionlimit(max(sys.getrecursionlimit(), min(CALLS * openings, 2**31 - 1)))


class Fault(Exception):
    """A place where the text is not of the language."""

    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


class Errors(list):
    """Errors found so far; at most one for a place."""

    def note(self, fault: Fault) -> None:
        if not self or self[-1][0] != fault.at:
            self.append((fault.at, fault.message))
