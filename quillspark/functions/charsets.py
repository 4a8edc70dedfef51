"""Character classes, generated from the Unicode database as explicit ranges.

One source for the JVM's regular expressions, Python's and DuckDB's, whose own classes
follow different Unicode versions.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

#: What a letter's name says about its script, asked in this order.
_NAME_HINTS = (
    ("Arab", ("ARABIC",)),
    ("Armn", ("ARMENIAN",)),
    ("Beng", ("BENGALI",)),
    ("Cyrl", ("CYRILLIC",)),
    ("Deva", ("DEVANAGARI",)),
    ("Geor", ("GEORGIAN",)),
    ("Hebr", ("HEBREW",)),
    ("Jpan", ("HIRAGANA", "KATAKANA")),
    ("Latn", ("LATIN",)),
    ("Telu", ("TELUGU",)),
    ("Hani", ("CJK UNIFIED IDEOGRAPH", "CJK COMPATIBILITY IDEOGRAPH")),
)
SCRIPTS = tuple(sorted(s for s, _ in _NAME_HINTS))


def script_of(char: str) -> str | None:
    """The script of a letter, None for all else."""
    if not char.isalpha():
        return None
    name = unicodedata.name(char, "")
    return next((script for script, hints in _NAME_HINTS if any(h in name for h in hints)), None)


@lru_cache(maxsize=1)
def ranges() -> dict[str, list[tuple[int, int]]]:
    """Code point ranges of each script's letters, and ``word``: letters and marks."""
    out: dict[str, list[tuple[int, int]]] = {s: [] for s in (*SCRIPTS, "word", "letter")}

    def add(name: str, cp: int) -> None:
        have = out[name]
        if have and have[-1][1] == cp - 1:
            have[-1] = (have[-1][0], cp)
        else:
            have.append((cp, cp))

    for cp in range(sys.maxunicode + 1):
        char = chr(cp)
        category = unicodedata.category(char)
        if category[0] == "L":
            add("letter", cp)
            add("word", cp)
            if (script := script_of(char)) is not None:
                add(script, cp)
        elif category[0] == "M":
            add("word", cp)
    return out


def char_class(name: str) -> str:
    r"""A class for Java and RE2: ``[\x{41}-\x{5A}...]``."""
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges()[name]) + "]"


@lru_cache(maxsize=64)
def java_class(name: str) -> str:
    """The same class for Java, which tests the ranges of a class one after the other.

    ASCII is settled first; the other ranges stand in groups, each behind the one range that
    spans it, so that a character meets a few dozen tests in place of hundreds.
    """
    low = [(a, min(b, 0x7F)) for a, b in ranges()[name] if a < 0x80]
    high = [(max(a, 0x80), b) for a, b in ranges()[name] if b >= 0x80]
    text = lambda rs: "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in rs)
    groups = [high[i : i + 24] for i in range(0, len(high), 24)]
    inner = "".join(f"[[{text([(g[0][0], g[-1][1])])}]&&[{text(g)}]]" for g in groups)
    beyond = f"[[^\\x00-\\x7F]&&[{inner}]]" if inner else ""
    return f"[{text(low)}{beyond}]"


def python_class(name: str) -> str:
    return "[" + "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges()[name]) + "]"


def token_pattern(of=char_class) -> str:
    """A word: letters and marks, with single plain apostrophes between them."""
    c = of("word")
    return f"{c}+(?:'{c}+)*"
