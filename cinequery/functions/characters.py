"""Classes of characters as regular-expression ranges, built from the Unicode tables of the interpreter."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable


#: Code points to look at: beyond these there are ideographs without a decomposition and private use only.
CODE_POINTS = (*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE1000))


def spans(wanted: Callable[[str], bool]) -> list[tuple[int, int]]:
    """First and last of the wanted code points that follow one another."""
    out: list[list[int]] = []
    for code in CODE_POINTS:
        if wanted(chr(code)):
            if out and out[-1][1] == code - 1:
                out[-1][1] = code
            else:
                out.append([code, code])
    return [(a, b) for a, b in out]


def ranges(wanted: Callable[[str], bool]) -> str:
    """Body of a character class that holds exactly the wanted code points."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans(wanted))


def java_ranges(wanted: Callable[[str], bool]) -> str:
    """The same in the notation of the JVM."""
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans(wanted))


# Code points that Unicode lists as Default_Ignorable beside the format characters,
# and format characters that are drawn all the same (number and verse signs set around digits).
_IGNORABLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF)]
_DRAWN = [(0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0xFFF9, 0xFFFB)]


_IGNORABLE_SET, _DRAWN_SET = ({chr(c) for a, b in t for c in range(a, b + 1)} for t in (_IGNORABLE, _DRAWN))


def undrawn(c: str) -> bool:
    """Whether a character leaves no mark and no space on the screen."""
    return c in _IGNORABLE_SET or unicodedata.category(c) == "Cf" and c not in _DRAWN_SET


#: Nonspacing marks (category Mn), and characters that are not drawn.
MARKS = ranges(lambda c: unicodedata.category(c) == "Mn")
UNDRAWN = ranges(undrawn)
