"""Text widths in ems of the text's own height, from a documented table of character classes, and geometry flags.

Fixed values, hundredths of an em: newline 0; wide East Asian 100; blank 35; narrow letters and points 40; capitals,
Cyrillic capitals and digits 90; everything else 75. Counting characters by class keeps the sum exact and in codegen.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = {
    "wide": (100, r"\u1100-\u115F\u2E80-\u303E\u3041-\u33FF\u3400-\u4DBF\u4E00-\u9FFF\uA000-\uA4CF\uAC00-\uD7A3\uF900-\uFAFF\uFE30-\uFE6F\uFF01-\uFF60\uFFE0-\uFFE6"),
    "blank": (35, " "),
    "narrow": (40, r"fijlrtI.,:;'|!()\[\]"),
    "broad": (90, r"A-HJ-Z0-9А-Я"),
    "none": (0, r"\n"),
}
OTHER = 75


def em_width(s: Column) -> Column:
    total, known = F.lit(0), F.lit(0)
    for width, chars in CLASSES.values():
        n = F.regexp_count(s, F.lit(f"[{chars}]"))
        total, known = total + n * width, known + n
    return (total + (F.length(s) - known) * OTHER).cast("double") / 100.0


_PYTHON = [(w, re.compile(f"[{c}]")) for w, c in CLASSES.values()]


@lru_cache(maxsize=1 << 16)
def hundredths(s: str) -> int:
    """em_width times 100 of a Python string; words come again and again."""
    total, known = 0, 0
    for width, chars in _PYTHON:
        n = len(chars.findall(s))
        total, known = total + n * width, known + n
    return total + (len(s) - known) * OTHER


#: em_width in DuckDB: {0} is the string.
def em_width_sql(s: str) -> str:
    def re2(chars: str) -> str:
        return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", chars).replace("'", "''")

    n = {k: f"length(regexp_replace({s}, '[^{re2(c)}]', '', 'g'))" for k, (_, c) in CLASSES.items()}
    total = " + ".join(f"{n[k]} * {w}" for k, (w, _) in CLASSES.items())
    return f"(cast({total} + (length({s}) - {' - '.join(n.values())}) * {OTHER} as double) / 100.0)"


def rendered_width(s: Column, height: Column, factor: Column | None = None) -> Column:
    w = em_width(s) * height
    return w * F.when(F.coalesce(factor, F.lit(0.0)) > 0, factor).otherwise(1.0) if factor is not None else w


def left_edge(x: Column, ax: Column, width: Column, halign: Column) -> Column:
    return F.when(halign.isin(1, 4), ax - width / 2).when(halign == 2, ax - width).otherwise(x)


def align_x(x: Column, align_point: Column, halign: Column) -> Column:
    return F.when(halign.isin(1, 2, 4), F.coalesce(align_point, x)).otherwise(x)


def is_flat(rotation: Column, vertical: Column) -> Column:
    """Within a degree of level, not set vertically."""
    turn = F.pmod(rotation, F.lit(360.0))
    return ~vertical & ((turn <= 1.0) | (turn >= 359.0))


def fits_like_a_line(kind: Column, box_width: Column, raw: Column) -> Column:
    """Single-line kinds, and multi-line text without a box or without a line break."""
    return kind.isin("TEXT", "ATTRIB", "PDF") | ((kind == "MTEXT") & ((F.coalesce(box_width, F.lit(0.0)) == 0) | ~raw.contains("\\P")))


def spare_lines(clear: Column, height: Column, most: int = 2) -> Column:
    n = F.floor((clear - 0.35 * height) / (1.45 * height))
    return F.when((height > 0) & (clear > 0), F.greatest(F.lit(0), F.least(F.lit(most), n))).otherwise(0).cast("int")


def nearest_rank(values: Column, share: float) -> Column:
    """The value at index int(n * share) of the sorted array; no interpolation."""
    return F.get(F.array_sort(values), F.least(F.floor(F.size(values) * share).cast("int"), F.size(values) - 1))


def upper_median(values: Column) -> Column:
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def is_vertical(font: Column, big_font: Column, flags: Column) -> Column:
    """A style set vertically: an @ before a font's name, or the style's vertical bit."""
    return F.coalesce(font, F.lit("")).startswith("@") | F.coalesce(big_font, F.lit("")).startswith("@") | (F.coalesce(flags, F.lit(0)).bitwiseAND(4) != 0)


# Entity counts up to which a picture keeps its width, and the pixels a picture may have.
RENDER_STEPS = [(50_000, 4000), (200_000, 3000), (500_000, 2200)]
RENDER_LEAST, RENDER_PIXELS = 1600, 16_000_000


def render_size(entities: Column, width: Column, height: Column) -> Column:
    """struct(w, h) in pixels: as wide as the number of entities affords, shrunk evenly to the pixels allowed."""
    wide = F.lit(RENDER_LEAST)
    for most, px in reversed(RENDER_STEPS):
        wide = F.when(entities <= most, px).otherwise(wide)
    tall = wide * height / width
    by = F.least(F.lit(1.0), F.sqrt(F.lit(float(RENDER_PIXELS)) / (wide * tall)))
    return F.struct(F.floor(wide * by).alias("w"), F.floor(tall * by).alias("h"))
