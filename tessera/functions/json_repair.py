"""Broken JSON made whole: a state machine over brackets, strings and escapes, in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BARE = re.compile(r"[^\s,:\[\]{}\"]+")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')
_LITERALS = ("true", "false", "null")


def unfenced(text: str) -> str:
    """What stands within the first code fence, if there is one."""
    for mark in ("```json", "```"):
        if mark in text:
            return text.split(mark, 1)[1].split("```", 1)[0].strip()
    return text.strip()


def _refused(name: str):
    raise ValueError(name)


def valid(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_refused)
    except (ValueError, RecursionError):
        return False
    return True


def _string(text: str, at: int) -> tuple[str, int]:
    """The string that opens at `at`, closed, with whole escapes only, and the place behind it."""
    out, i = ['"'], at + 1
    while i < len(text):
        c = text[i]
        if c == '"':
            i += 1
            break
        if c == "\\":
            whole = _ESCAPE.match(text, i)
            if whole:
                out.append(whole[0])
                i = whole.end()
            elif re.fullmatch(r"\\(?:u[0-9a-fA-F]{0,3})?", text[i:]):  # cut off here
                i = len(text)
            else:
                out.append("\\\\")
                i += 1
            continue
        out.append(json.dumps(c)[1:-1] if c < " " else c)
        i += 1
    return "".join(out) + '"', i


def _scalar(word: str) -> str | None:
    """A bare word as a value: a literal, cut off or not, the number that it begins with, else a string; None if nothing of it is left."""
    for known in _LITERALS:
        if known.startswith(word.lower()):
            return known
    if word[0] in "-0123456789":
        number = _NUMBER.match(word)
        if number and (number.end() == len(word) or re.fullmatch(r"[.eE+-]+", word[number.end() :])):
            return number[0]
        if word == "-":
            return None
    return json.dumps(word, ensure_ascii=False)


def repaired(text: str | None) -> str | None:
    """Valid JSON of a text, null where it holds none.

    A valid text stays as it is. Otherwise what stands in a code fence counts, from the first bracket (a text without any: its first
    value). Open strings, arrays and objects are closed, cut escapes, numbers and literals are ended, a key without a colon goes, one without a value
    gets null, commas that nothing follows go, missing ones come, and what follows the closing bracket is left out.
    """
    if text is None or valid(text):
        return text
    whole, text = text, unfenced(text)
    if text != whole and valid(text):
        return text
    found = re.search(r"[\[{]", text)
    i = found.start() if found else 0
    out: list[str] = []
    stack: list[str] = []
    some: list[bool] = []  # whether each open bracket has an element
    key, colon = None, False  # of the innermost object: a key that waits for its value, and whether its colon came

    def begin():
        """What stands before an element: its comma, and its key."""
        nonlocal key, colon
        if stack:
            if some[-1]:
                out.append(",")
            some[-1] = True
            if key is not None:
                out.append(key + ":")
        key, colon = None, False

    def close():
        nonlocal key, colon
        if stack[-1] == "{" and key is not None and colon:
            begin()
            out.append("null")
        key, colon = None, False
        some.pop()
        out.append("}" if stack.pop() == "{" else "]")

    while i < len(text):
        c = text[i]
        if c in "{[":
            if stack and stack[-1] == "{" and key is None:
                key = '""'
            begin()
            out.append(c)
            stack.append(c)
            some.append(False)
            i += 1
        elif c in "}]":
            want = "{" if c == "}" else "["
            if want in stack:
                while stack[-1] != want:
                    close()
                close()
            i += 1
        elif c == ":":
            colon = colon or key is not None
            i += 1
        elif c == ",":
            if stack and stack[-1] == "{" and key is not None:
                if colon:
                    begin()
                    out.append("null")
                key, colon = None, False
            i += 1
        elif c.isspace():
            i += 1
        else:
            if c == '"':
                value, i = _string(text, i)
            else:
                word = _BARE.match(text, i)
                i = word.end()
                value = _scalar(word[0])
            if value is None or not stack and c != '"' and value[0] == '"':  # words outside of all brackets are no JSON
                continue
            if stack and stack[-1] == "{" and not colon:
                key = value if value[0] == '"' else json.dumps(value)
            else:
                begin()
                out.append(value)
        if not stack and out:
            break
    while stack:
        close()
    return "".join(out) or None


def each_once(texts: pd.Series) -> pd.Series:
    """repaired() of each text; equal ones of a batch are mended once."""
    known = {t: repaired(t) for t in texts.dropna().unique()}
    return pd.Series([known.get(t) for t in texts], dtype=object)


def repair(column: Column | str) -> Column:
    """repaired() of each row."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return each_once(texts)

    return run(column)
