"""Character classes that don't depend on the Unicode version of a library."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from itertools import chain

import regex

# The letters and numbers that Unicode 14, 15 and 16 added to those of Unicode 13.
LETTERS = (
    (0x870, 0x887), (0x889, 0x88E), (0x8B5, 0x8B5), (0x8C8, 0x8C9), (0xC5D, 0xC5D), (0xCDD, 0xCDD), (0x170D, 0x170D), (0x171F, 0x171F),
    (0x1B4C, 0x1B4C), (0x1C89, 0x1C8A), (0x2C2F, 0x2C2F), (0x2C5F, 0x2C5F), (0x9FFD, 0x9FFF), (0xA7C0, 0xA7C1), (0xA7CB, 0xA7CD), (0xA7D0, 0xA7D1),
    (0xA7D3, 0xA7D3), (0xA7D5, 0xA7DC), (0xA7F2, 0xA7F4), (0x10570, 0x1057A), (0x1057C, 0x1058A), (0x1058C, 0x10592), (0x10594, 0x10595), (0x10597, 0x105A1),
    (0x105A3, 0x105B1), (0x105B3, 0x105B9), (0x105BB, 0x105BC), (0x105C0, 0x105F3), (0x10780, 0x10785), (0x10787, 0x107B0), (0x107B2, 0x107BA), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x10F70, 0x10F81), (0x11071, 0x11072), (0x11075, 0x11075), (0x1123F, 0x11240), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11740, 0x11746), (0x11AB0, 0x11ABF), (0x11BC0, 0x11BE0),
    (0x11F02, 0x11F02), (0x11F04, 0x11F10), (0x11F12, 0x11F33), (0x12F90, 0x12FF0), (0x1342F, 0x1342F), (0x13441, 0x13446), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16A70, 0x16ABE), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1AFF0, 0x1AFF3), (0x1AFF5, 0x1AFFB), (0x1AFFD, 0x1AFFE), (0x1B11F, 0x1B122), (0x1B132, 0x1B132),
    (0x1B155, 0x1B155), (0x1DF00, 0x1DF1E), (0x1DF25, 0x1DF2A), (0x1E030, 0x1E06D), (0x1E290, 0x1E2AD), (0x1E4D0, 0x1E4EB), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    (0x1E7E0, 0x1E7E6), (0x1E7E8, 0x1E7EB), (0x1E7ED, 0x1E7EE), (0x1E7F0, 0x1E7FE), (0x2A6DE, 0x2A6DF), (0x2B735, 0x2B739), (0x2EBF0, 0x2EE5D), (0x31350, 0x323AF),
)
NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x11F50, 0x11F59), (0x16130, 0x16139), (0x16AC0, 0x16AC9), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1D2C0, 0x1D2D3), (0x1E4F0, 0x1E4F9), (0x1E5F1, 0x1E5FA),
)
#: White space, inside a class.
SPACE = "\\t-\\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN_SPACE = "\\t-\\r \x85\xa0"


def _runs(points: list[int]) -> str:
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


@functools.cache
def _own(kind: str) -> frozenset[int]:
    """The code points of letters (L) or numbers (N) of Unicode 16, by Python's tables, of 13 to 16, and those above."""
    more = {"L": LETTERS, "N": NUMBERS}[kind]
    own = {c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind}
    return frozenset(own.union(*(range(a, b + 1) for a, b in more)))


@functools.cache
def inside(kind: str, latin: bool = False) -> str:
    """What stands for a kind (L, N or S, white space) inside a class of the regex module; or, for texts of Latin-1 alone, of re."""
    if kind == "S":
        return LATIN_SPACE if latin else SPACE
    if latin:
        return _runs([c for c in range(256) if c in _own(kind)])
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    theirs = set(map(ord, regex.findall(rf"\p{{{kind}}}", every)))
    more, less = sorted(_own(kind) - theirs), sorted(theirs - _own(kind))
    with_more = rf"\p{{{kind}}}{_runs(more)}"
    return f"[[{with_more}]--[{_runs(less)}]]" if less else with_more


@functools.cache
def finder(pattern: str, latin: bool = False):
    """The compiled pattern, with letters, numbers and white space of fixed tables for \\p{L}, \\p{N}, \\s and \\S."""
    out, at, in_class = [], 0, False
    while at < len(pattern):
        met = next((k for k in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(k, at)), None)
        if met == r"\S":
            out.append(f"[^{inside('S', latin)}]")
        elif met:
            own = inside("S" if met == r"\s" else met[3], latin)
            out.append(own if in_class else f"[{own}]")
        elif pattern[at] == "\\":
            met = pattern[at : at + 2]
            out.append(met)
        else:
            met = pattern[at]
            in_class = met == "[" or (in_class and met != "]")
            out.append(met)
        at += len(met)
    return re.compile("".join(out)) if latin else regex.compile("".join(out), regex.V1)


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
