"""JSON out of text that is not quite JSON: cut off, fenced, with comments, commas too many or too few, or stray backslashes.

A scanner keeps a stack of open brackets and writes clean JSON as it goes; what is
still open at the end is closed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<text>"(?:[^"\\]|\\.|\\\Z)*(?:"|\Z))|(?P<fence>```)|(?P<sign>[{}\[\],:])|(?P<word>[^\s"{}\[\],:/`]+)|.""", re.S)
_ESCAPE = re.compile(r'\\(?:u[0-9a-fA-F]{4}|["\\/bfnrt])|\\|[\x00-\x1f]')
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
#: How other languages write the three words of JSON.
WORDS = {"true": "true", "false": "false", "null": "null", "True": "true", "False": "false", "None": "null", "NaN": "null", "undefined": "null"}


def text_token(raw: str) -> str:
    """A string as JSON has it: closed, with backslashes that mean nothing doubled and signs of control written out."""
    inside = raw[1:-1] if len(raw) > 1 and raw.endswith('"') and not re.search(r"(?<!\\)(?:\\\\)*\\\"\Z", raw) else raw[1:]
    return '"' + _ESCAPE.sub(lambda m: m[0] if len(m[0]) > 1 else "\\\\" if m[0] == "\\" else json.dumps(m[0])[1:-1], inside) + '"'


def word_token(word: str, last: bool) -> str:
    """A bare word as a value: a number, a word of JSON (one cut off at the end of the text is completed), else a string."""
    if word in WORDS:
        return WORDS[word]
    if _NUMBER.fullmatch(word):
        return word
    if last:
        whole = [w for w in ("true", "false", "null") if w.startswith(word)]
        if whole:
            return whole[0]
        if word == "-" or _NUMBER.fullmatch(word.rstrip("+-.eE")):
            return word.rstrip("+-.eE") or "null"
    return json.dumps(word)


def _no_constant(name: str) -> None:
    raise ValueError(name)


_PLAIN = json.JSONDecoder(parse_constant=_no_constant)


def tolerant(text: str | None) -> str | None:
    """The first object in a text (the first array where there is none) as JSON; null if there is neither."""
    at = -1 if text is None else text.find("{")
    if at < 0:
        at = -1 if text is None else text.find("[")
    if at < 0:
        return None
    try:  # most texts hold JSON that needs no repair
        return text[at : _PLAIN.raw_decode(text, at)[1]]
    except (ValueError, RecursionError):
        pass
    out: list[str] = []
    # Of each open bracket: its sign, what it waits for (key, colon, value or comma), whether it has an element, and a key without a value so far.
    stack: list[list] = []

    def put(value: str) -> None:
        if stack:
            top = stack[-1]
            out.append(("," if top[2] else "") + (top[3] + ":" if top[0] == "{" else "") + value)
            top[1:] = ["comma", True, None]
        else:
            out.append(value)

    def close() -> None:
        top = stack[-1]
        if top[0] == "{" and top[1] == "value":
            put("null")
        out.append("}" if top[0] == "{" else "]")
        stack.pop()

    end = len(text)
    for m in _TOKEN.finditer(text, at):
        kind, token = m.lastgroup, m[0]
        if kind == "fence":
            break
        top = stack[-1] if stack else ["", "value", False, None]
        if kind in ("text", "word") or token in ("{", "["):
            if top[1] == "comma":  # one is missing
                top[1] = "key" if top[0] == "{" else "value"
            if top[1] == "key" and kind:
                if kind != "sign":
                    top[1], top[3] = "colon", text_token(token) if kind == "text" else json.dumps(token)
                continue
            if kind == "sign":
                put(token)
                stack.append([token, "key" if token == "{" else "value", False, None])
            else:
                put(text_token(token) if kind == "text" else word_token(token, not text[m.end() : end].strip()))
        elif token == ":":
            if top[1] == "colon":
                top[1] = "value"
        elif token == ",":
            if top[0] == "{" and top[1] == "value":
                put("null")
            if top[1] == "comma":
                top[1] = "key" if top[0] == "{" else "value"
            elif top[1] == "colon":
                top[1], top[3] = "key", None
        elif token in ("}", "]"):
            opener = "{" if token == "}" else "["
            if any(s[0] == opener for s in stack):
                while stack[-1][0] != opener:
                    close()
                close()
                if not stack:
                    return "".join(out)
    while stack:
        close()
    return "".join(out)


def tolerant_json(text: Column) -> Column:
    """``tolerant`` as a variant column."""

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([tolerant(t) for t in texts], dtype=object)

    return F.try_parse_json(clean(text.cast("string")))
