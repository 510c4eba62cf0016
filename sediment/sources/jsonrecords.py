"""JSON records with the type and the presence of every key, from lines in any state of order.

A record is a balanced JSON object and may span lines. Lines outside records
that begin with neither brace nor bracket are skipped, as are values that don't
parse or aren't objects, and what grows beyond MOST_LINES lines or MOST_CHARS
characters. A file is read in splits; a split begins with the lines that the
one before left open.
"""

from __future__ import annotations

import json
import re

MOST_LINES, MOST_CHARS = 1000, 1_000_000
#: The column that holds the type tag of each key that a record has.
TYPES = "record: types"
_TOKEN = re.compile(r'["\\{}\[\]]')


def tag(v) -> str:
    """The type tag of a JSON value."""
    if v is None:
        return "null"
    if isinstance(v, str):
        return "str" if v.strip() else "empty-string"
    return {bool: "bool", int: "int", float: "float"}.get(type(v), "structured")


def text(v) -> str | None:
    """The text form of a JSON value; nested ones stay JSON."""
    if v is None:
        return None
    out = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)
    if not out.isascii():  # a lone surrogate has no bytes
        out = out.encode("utf-8", "surrogatepass").decode("utf-8", "replace")
    return out


def _parsed(raw: str):
    try:
        return json.loads(raw)
    except (ValueError, RecursionError):
        return None


class Assembler:
    """Puts lines together to records; counts lines joined to records and lines skipped."""

    def __init__(self, open_lines: list[str] = ()):
        self.joined = self.skipped = 0
        self._reset()
        for line in open_lines:
            self.feed(line)

    def _reset(self) -> None:
        self.held: list[str] = []
        self.chars, self.depth, self.quoted, self.escaped = 0, 0, False, False

    def feed(self, line: str) -> dict | None:
        """The record that ends with this line."""
        s = line.strip()
        if not s:
            return None
        if not self.held:
            if s[0] not in "{[":
                self.skipped += 1
                return None
            if len(line) < MOST_CHARS:
                v = _parsed(line)
                if isinstance(v, dict):
                    return v
        self.held.append(line)
        self.chars += len(line) + 1
        if len(self.held) > MOST_LINES or self.chars > MOST_CHARS:
            return self._skip()
        self._measure(line)
        if self.depth > 0:
            return None
        v = _parsed("\n".join(self.held))
        if not isinstance(v, dict):
            return self._skip()
        self.joined += len(self.held) - 1
        self._reset()
        return v

    def _skip(self) -> None:
        self.skipped += len(self.held)
        self._reset()

    def _measure(self, line: str) -> None:
        """Brackets outside strings; a string and an escape may go on in the next line."""
        skip = 0 if self.escaped and self.quoted else -1
        for m in _TOKEN.finditer(line):
            c, at = m[0], m.start()
            if at == skip:
                continue
            if self.quoted:
                if c == "\\":
                    skip = at + 1
                elif c == '"':
                    self.quoted = False
            elif c == '"':
                self.quoted = True
            elif c in "{[":
                self.depth += 1
            elif c in "]}":
                self.depth -= 1
        # an escape at the line's end takes the line break
        self.escaped = False


def document(raw: str, wrappers: tuple[str, ...]) -> list[dict]:
    """The objects of a JSON document: of an array, or of the first wrapper that holds a list."""
    v = json.loads(raw)
    if isinstance(v, dict):
        v = next((v[k] for k in wrappers if isinstance(v.get(k), list)), None)
    return [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []
