"""Query text to tokens."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import ParseError

TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|//[^\n]*|/\*.*?\*/)
    |(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?)
    |(?P<int>0x[0-9a-fA-F]+|0o[0-7]+|\d+)
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op>=~|<>|<=|>=|\+=|\.\.|::|[-+*/%^=<>()\[\]{},.:;|$])""",
    re.VERBOSE | re.DOTALL,
)
ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.DOTALL)
PLAIN = {"t": "\t", "n": "\n", "r": "\r", "\\": "\\", '"': '"', "'": "'", "/": "/"}


class Token(NamedTuple):
    kind: str
    text: str
    at: int


def unquoted(text: str, at: int) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        if m[2] not in PLAIN:
            raise ParseError(f"unknown escape \\{m[2]} in the string at {at}")
        return PLAIN[m[2]]

    made = ESCAPE.sub(one, text[1:-1])
    return made.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in made) else made


def tokenise(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    out.append(Token("end", "", at))
    return out
