"""Wrapping text into measured room, narrowing, and the verdict per segment.

The wrap is a search: up to nine factors, each a fold over words whose state depends on all before it. As one column
expression it multiplies into a plan too large to compile, so it is one Arrow-batched function; widths come from the same
table as measure.em_width and are integers of hundredths, so both agree to the last digit.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import measure as M
from sheetloom.functions import text as X

#: From no narrowing to the narrowest that is still readable, in hundredths.
FACTORS = [100, 95, 90, 85, 80, 75, 70, 65, 60]
FIT = "lines array<string>, wf double, over boolean"


def greedy(text: str, caps: list[float], factor: float = 1.0, cjk: bool = False) -> list[str]:
    """Lines of a greedy wrap: line i holds caps[i] / factor, the last cap repeats, a word is never split."""
    glue, lines, at = "" if cjk else " ", [], 0
    gap = M.hundredths(glue)
    for paragraph in text.split("\n"):
        held: list[str] = []
        width = 0
        for word in list(paragraph) if cjk else paragraph.split(" "):
            own = M.hundredths(word)
            started = any(held)
            if started and (width + gap + own) / 100.0 > caps[min(at, len(caps) - 1)] / factor:
                lines.append(glue.join(held))
                at, held, width = at + 1, [word], own
            elif started:
                held.append(word)
                width += gap + own
            else:
                held, width = [word], own
        lines.append(glue.join(held))
        at += 1
    return [x for x in lines if x] or [""]


def folded(lines: list[str], limit: int, cjk: bool) -> list[str]:
    """Lines beyond the limit become part of the last one."""
    return lines if len(lines) <= limit else [*lines[: limit - 1], ("" if cjk else " ").join(lines[limit - 1 :])]


def settled(text: str, room: list[float], limit: int, cjk: bool = False) -> tuple[bool, int, list[str]]:
    """(overflow, factor in hundredths, lines) in a room: a list of caps that holds `limit` lines.

    The number of lines never grows as the factor falls, so the widest factor that fits is found by bisection. Where none
    does, the text overflows at the narrowest.
    """
    if max(room, default=0) <= 0:
        return False, 100, greedy(text, [1e9], 1.0, cjk)[:limit]
    tried: dict[int, list[str]] = {}

    def fits(k: int) -> bool:
        tried[k] = greedy(text, room, FACTORS[k] / 100.0, cjk)
        return len(tried[k]) <= limit

    k = bisect_left(range(len(FACTORS)), True, key=fits)
    return (False, FACTORS[k], tried[k]) if k < len(FACTORS) else (True, FACTORS[-1], folded(tried[k - 1], limit, cjk))


def rooms(text: str, caps: list[float], beside: list[float], most: int, spare: int) -> Iterator[tuple[int, list[float], int]]:
    """(rank, caps, lines) of the places a text may take, the preferred first; rank 1 counts only where rank 0 overflows."""
    yield 0, caps, most
    if spare > 0:
        yield 0, caps, most + spare
    if beside and beside != caps:
        even = M.hundredths(text) / 100.0 / max(most, 1) * 1.05
        yield 1, [min(wide, max(own, even)) for own, wide in zip(caps, beside, strict=False)], most


def best_fit(text: str, caps: list[float], beside: list[float], most: int, spare: int = 0, cjk: bool = False) -> tuple[list[str], float, bool]:
    """(lines, factor, overflow) of the best room: no overflow, then rank, then the widest factor, then the order of rooms."""
    over, _, hundredths, _, lines = min(((o, rank, -f, n, x) for n, (rank, room, limit) in enumerate(rooms(text, caps, beside, most, spare)) for o, f, x in [settled(text, room, limit, cjk)]), key=lambda z: z[:4])
    return lines, -hundredths / 100.0, over


def wrap_best(rows: DataFrame, cjk: bool = False) -> DataFrame:
    """rows (text, caps, caps_max, max_lines, spare) with fit: struct(lines, wf, over)."""

    @F.pandas_udf(FIT)
    def run(text: pd.Series, caps: pd.Series, caps_max: pd.Series, most: pd.Series, spare: pd.Series) -> pd.DataFrame:
        out = [best_fit(t or "", [float(x or 0) for x in c], [float(x or 0) for x in m], int(n), int(k), cjk) for t, c, m, n, k in zip(text, caps, caps_max, most, spare, strict=True)]
        return pd.DataFrame(out, columns=["lines", "wf", "over"])

    return rows.withColumn("fit", run("text", "caps", "caps_max", "max_lines", "spare"))


def wrap_at(rows: DataFrame, cjk: bool = False) -> DataFrame:
    """rows (text, caps, width_factor, max_lines) with forced: lines at the given factor, the rest folded into the last."""

    @F.pandas_udf("array<string>")
    def run(text: pd.Series, caps: pd.Series, factor: pd.Series, most: pd.Series) -> pd.Series:
        out = []
        for t, c, f, n in zip(text, caps, factor, most, strict=True):
            out.append(folded(greedy(t or "", [float(x or 0) for x in c], float(f), cjk), n, cjk))
        return pd.Series(out)

    return rows.withColumn("forced", run("text", "caps", "width_factor", "max_lines"))


def flag(overflow: Column, factor: Column) -> Column:
    return F.when(overflow, "overflow").when(factor < 0.85, "tight").when(factor < 1.0, "long").otherwise("")


def assess(segments: DataFrame, instances: DataFrame, translations: DataFrame, cjk: bool = False) -> DataFrame:
    """(id, source_em, target_em, ratio, flag, suggested_width_factor, lines_used, cap_em) of segments with a translation.

    instances: (id, inst, caps, caps_max, max_lines, spare). Without any known capacity only growth is judged. Unrounded.
    """
    t = segments.select("id", "source").join(translations.select("id", "target"), "id")
    t = t.withColumn("text", X.display_text(F.col("target")))
    t = t.withColumn("source_em", M.em_width(X.display_text(F.col("source")))).withColumn("target_em", M.em_width(F.col("text")))
    t = t.withColumn("ratio", F.when(F.col("source_em") > 0, F.col("target_em") / F.col("source_em")).otherwise(1.0))
    best = wrap_best(t.select("id", "text").join(instances, "id"), cjk)
    per = best.groupBy("id").agg(F.min("fit.wf").alias("wf"), F.max(F.size("fit.lines")).alias("used"), F.max("fit.over").alias("over"), F.max(F.coalesce(F.array_max("caps"), F.lit(0.0))).alias("most"), F.min(F.coalesce(F.array_max("caps"), F.lit(0.0))).alias("cap_em"))
    known = F.coalesce(F.col("most"), F.lit(0.0)) > 0
    out = t.join(per, "id", "left")
    return out.select("id", "source_em", "target_em", "ratio", F.when(known, flag(F.col("over"), F.col("wf"))).otherwise(F.when(F.col("ratio") > 1.6, "long").otherwise("")).alias("flag"), F.when(known, F.col("wf")).otherwise(1.0).alias("suggested_width_factor"), F.when(known, F.col("used")).alias("lines_used"), F.when(known, F.col("cap_em")).alias("cap_em"))


def histogram(fits: DataFrame) -> DataFrame:
    return fits.groupBy(F.when(F.col("flag") == "", "ok").otherwise(F.col("flag")).alias("flag")).agg(F.count("*").alias("n"))


def worst(fits: DataFrame, n: int = 8) -> DataFrame:
    return fits.where(F.col("flag").isin("overflow", "tight")).orderBy("suggested_width_factor", "id").limit(n)
