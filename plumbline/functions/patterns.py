"""Literal text that a regular expression can't match without, for a cheap test before it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between bars that stand outside groups and classes."""
    parts, depth, inside, at = [""], 0, False, 0
    while at < len(pattern):
        piece = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        at += len(piece)
        inside = piece != "]" if inside else piece == "["
        depth += 0 if inside else (piece == "(") - (piece == ")")
        if piece == "|" and not depth and not inside:
            parts.append("")
        else:
            parts[-1] += piece
    return parts


def factor(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern without outer bars holds; empty if there is none.

    Groups and classes count as unknown, and so do letters where case is ignored.
    """
    any_case = pattern.startswith("(?i)")
    runs, depth, inside = [""], 0, False
    for piece in re.findall(r"\\.|\{[^}]*\}|.", pattern.removeprefix("(?i)"), re.S):
        plain = piece[1] if len(piece) == 2 and piece[0] == "\\" and not piece[1].isalnum() else piece if len(piece) == 1 and piece not in "\\.[](){}*+?|^$" else ""
        outside = not depth and not inside
        if piece in ("*", "?") or piece.startswith("{"):
            runs[-1] = runs[-1][:-1]  # what stands before may be missing
        if plain and outside and not (any_case and plain.isalpha()):
            runs[-1] += plain
        else:
            runs.append("")
        inside = piece != "]" if inside else piece == "["
        depth += 0 if inside else (piece == "(") - (piece == ")")
    return max(runs, key=len)


def matches(text: Column, pattern: str) -> Column:
    """Whether a text matches; the expression is only tried on texts that hold a literal factor of each alternative's."""
    factors = [factor(p) for p in alternatives(pattern)]
    test = text.rlike(pattern)
    if not all(factors):
        return test
    held = None
    for f in dict.fromkeys(factors):
        held = F.contains(text, F.lit(f)) if held is None else held | F.contains(text, F.lit(f))
    return held & test
