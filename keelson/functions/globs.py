"""Glob patterns as anchored regular expressions that Java, RE2 and Python agree on.

`*` and `?` don't cross a slash, `[a-z]` and `[^a]` are classes, a backslash quotes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

from ..errors import BadPattern


def to_regex(pattern: str) -> str:
    out, at, n = [], 0, len(pattern)

    def quoted(i: int) -> tuple[str, int]:
        if pattern[i] == "\\":
            i += 1
            if i >= n:
                raise BadPattern(pattern)
        return pattern[i], i + 1

    while at < n:
        c = pattern[at]
        if c == "*":
            out.append("[^/]*")
            at += 1
        elif c == "?":
            out.append("[^/]")
            at += 1
        elif c == "[":
            at += 1
            negated = at < n and pattern[at] == "^"
            at += negated
            ranges = []
            while at < n and (pattern[at] != "]" or not ranges):
                if pattern[at] in "-]":
                    raise BadPattern(pattern)
                low, at = quoted(at)
                high = low
                if at + 1 < n and pattern[at] == "-":
                    if pattern[at + 1] == "]":
                        raise BadPattern(pattern)
                    high, at = quoted(at + 1)
                ranges.append((low, high))
            if at >= n or not ranges:
                raise BadPattern(pattern)
            at += 1
            body = "".join(f"\\x{{{ord(a):X}}}-\\x{{{ord(b):X}}}" for a, b in ranges if a <= b)
            if not body:
                out.append("[^\\x{0}-\\x{10FFFF}]" if not negated else "(?s:.)")
            else:
                out.append(f"[{'^' * negated}{body}]")
        else:
            c, at = quoted(at)
            out.append(re.sub(r"([\\.+*?()\[\]{}|^$])", r"\\\1", c))
    return f"^(?:{''.join(out)})$"


def matches(name: Column, pattern: str) -> Column:
    if pattern == "*":
        return ~name.contains("/")
    return name.rlike(to_regex(pattern))
