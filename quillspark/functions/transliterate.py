"""Uyghur Arabic text in the Latin, Cyrillic and New Script alphabets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..resources import fixed
from .text import nfkc


def _convert(text: Column, column: int) -> Column:
    """Letters of two characters one by one, then single ones at once; the rest is deleted."""
    source = {row[0]: row[column] for row in fixed.UYGHUR}
    out = nfkc(text)
    for a, b in source.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    single = [(a, b) for a, b in source.items() if len(b) == 1]
    gone = [a for a, b in source.items() if not b]
    return F.translate(out, "".join(a for a, _ in single) + "".join(gone), "".join(b for _, b in single))


def uyghur_latin(text: Column) -> Column:
    return _convert(text, 1)


def uyghur_cyrillic(text: Column) -> Column:
    out = _convert(text, 2)
    for pair, one in (("йа", "я"), ("йу", "ю"), ("йо", "ё")):
        out = F.replace(out, F.lit(pair), F.lit(one))
    return out


def uyghur_new_script(text: Column) -> Column:
    return _convert(text, 3)
