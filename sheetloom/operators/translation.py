"""Memory, the translator boundary, validation and shortening."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.functions import text as X
from sheetloom.sources.stages import checkpointed

BATCH = 60
ATTEMPTS = 2
#: Rows of a pass of shortening that one task joins.
JOINED = 250_000
#: A translator: rows (id, source) of one batch to (id, target, note).
Translator = Callable[[pd.DataFrame], pd.DataFrame]


def layered(seed: DataFrame, learned: DataFrame) -> DataFrame:
    """(source, target): learned entries replace seeded ones. Keys are exact, padding included."""
    both = seed.select("source", "target", F.lit(0).alias("rank")).unionByName(learned.select("source", "target", F.lit(1).alias("rank")))
    return both.groupBy("source").agg(F.max_by("target", F.struct("rank", "target")).alias("target"))


def hits(segments: DataFrame, memory: DataFrame) -> DataFrame:
    """Segments with a remembered target; a blank memory value is a miss."""
    return segments.join(memory.where(F.col("target") != ""), "source")


def misses(segments: DataFrame, memory: DataFrame) -> DataFrame:
    return segments.join(memory.where(F.col("target") != ""), "source", "left_anti")


def learn(memory: DataFrame, pairs: DataFrame) -> DataFrame:
    """Memory with all non-blank pairs put in."""
    fresh = pairs.where((F.trim("source") != "") & (F.trim("target") != "")).groupBy("source").agg(F.max("target").alias("target"))
    return memory.join(fresh, "source", "left_anti").unionByName(fresh)


def learned_count(memory: DataFrame, pairs: DataFrame) -> DataFrame:
    """(n): pairs that differ from the memory."""
    fresh = pairs.where((F.trim("source") != "") & (F.trim("target") != "")).groupBy("source").agg(F.max("target").alias("target"))
    old = memory.select("source", F.col("target").alias("old"))
    return fresh.join(old, "source", "left").where(~F.col("target").eqNullSafe(F.col("old"))).agg(F.count("*").alias("n"))


def mock(segments: DataFrame, lang: str = "EN") -> DataFrame:
    """The default translator, without Python: tags around every piece of text."""
    return segments.withColumns({"target": X.mock_translate(F.col("source"), lang), "ok": F.lit(True), "note": F.lit("")})


def _ask(rows: pd.DataFrame, translate: Translator) -> list[tuple]:
    """(id, source, target, note) for each row. A batch that fails is halved; a single row that fails is not ok."""
    try:
        got = translate(rows)[["id", "target", "note"]]
        answers: dict = {}
        for i, t, n in zip(got["id"].tolist(), got["target"].tolist(), got["note"].tolist(), strict=True):
            answers.setdefault(i, []).append((t, n))
        return [(i, s, t, n) for i, s in zip(rows["id"].tolist(), rows["source"].tolist(), strict=True) for t, n in answers.get(i, [(None, None)])]
    except Exception as e:  # noqa: BLE001  whatever a translator raises
        if len(rows) == 1:
            return [(rows["id"].iloc[0], rows["source"].iloc[0], None, f"failed: {e}")]
        half = len(rows) // 2
        return _ask(rows[:half], translate) + _ask(rows[half:], translate)


def translate(segments: DataFrame, translator: Translator, batch: int = BATCH) -> DataFrame:
    """(id, target, ok, note): batches within partitions, then one retry alone for rows without markers in place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        marks = lambda s: sorted(re.findall("⟦([0-9]+)⟧", s or ""))
        good = lambda s, t: isinstance(t, str) and t.strip() != "" and marks(s) == marks(t)
        for frame in frames:
            done: list[tuple] = []
            for at in range(0, len(frame), batch):
                out = _ask(frame[at : at + batch], translator)
                bad = [not good(s, t) and not (isinstance(n, str) and n.startswith("failed")) for _, s, t, n in out]
                done += [z for z, again in zip(out, bad, strict=True) if not again]
                for (i, s, _, _), again in zip(out, bad, strict=True):
                    if again:
                        done += _ask(pd.DataFrame({"id": [i], "source": [s]}), translator)
            ok = [good(s, t) for _, s, t, _ in done]
            # One table a frame; it used to be several a batch of 60 rows.
            yield pd.DataFrame({"id": [z[0] for z in done], "target": [t if k else s for (_, s, t, _), k in zip(done, ok, strict=True)], "ok": ok, "note": [(n if isinstance(n, str) else "") if k else "left as it was" for (_, _, _, n), k in zip(done, ok, strict=True)]}, columns=["id", "target", "ok", "note"])

    return segments.select("id", "source").mapInPandas(run, "id string, target string, ok boolean, note string")


def reassemble(segments: DataFrame, remembered: DataFrame, fresh: DataFrame) -> DataFrame:
    """Remembered and fresh targets, one row a segment, in segment order."""
    cols = ["id", "target", "ok", "note"]
    both = remembered.select("id", "target", F.lit(True).alias("ok"), F.lit("from memory").alias("note")).unionByName(fresh.select(*cols))
    return segments.select("id").join(both, "id", "left").select("id", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("note", F.lit("")).alias("note"))


def within_budget(source: str, target: str, budget: str) -> Column:
    """Not blank, markers in place, visible length no greater than the budget."""
    t = F.col(target)
    return (F.trim(t) != "") & X.markers_ok(F.col(source), t) & (F.length(X.display_text(t)) <= F.col(budget))


def shorten(rows: DataFrame, shorter: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS) -> DataFrame:
    """(id, target, shortened) of all rows (id, source, target, budget): at most `attempts` passes of those over budget.

    shorter gives (id, target). An answer within budget is taken; a row that none brings there keeps the target it had.
    The rows of a pass are kept as a table, dealt so that a task holds about JOINED of them however many there are; otherwise a task would sort all passes at once.
    """
    fine = within_budget("source", "target", "budget")
    done, left = [rows.where(fine).select("id", "target", F.lit(False).alias("shortened"))], checkpointed(rows.where(~fine))
    for _ in range(attempts):
        parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-left.count() // JOINED))
        left = left.repartition(parts, "id")
        tried = left.join(shorter(left).select("id", F.col("target").alias("new")).repartition(parts, "id").hint("merge"), "id", "left")
        tried = checkpointed(tried.withColumn("_good", F.coalesce(within_budget("source", "new", "budget"), F.lit(False))))
        done.append(tried.where("_good").select("id", F.col("new").alias("target"), F.lit(True).alias("shortened")))
        left = tried.where("not _good").drop("new", "_good")
    return reduce(DataFrame.unionByName, [*done, left.select("id", "target", F.lit(False).alias("shortened"))])


def payload(id: str, text: str, *optional: str) -> Column:
    """One request per segment as JSON; optional fields appear only where they are set."""
    return F.to_json(F.struct(F.col(id).alias("id"), F.col(text).alias("text"), *optional))


def counters(answers: DataFrame) -> DataFrame:
    """One row (ok, from_memory, shortened, attention) of answers (id, ok, note, shortened)."""
    return answers.agg(F.count_if("ok").alias("ok"), F.count_if(F.col("note") == "from memory").alias("from_memory"), F.count_if("shortened").alias("shortened"), F.count_if(~F.col("ok")).alias("attention"))


def progress(batched: DataFrame, done: DataFrame) -> DataFrame:
    """(job_id, batch, seen): answers at hand after each batch of a job, what memory gave first. done: (job_id, n) from memory."""
    sizes = batched.groupBy("job_id", "batch").agg(F.count("*").alias("n"))
    w = Window.partitionBy("job_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return sizes.join(done.select("job_id", F.col("n").alias("held")), "job_id", "left").select("job_id", "batch", (F.sum("n").over(w) + F.coalesce("held", F.lit(0))).alias("seen"))


def batches(segments: DataFrame, order: str, size: int = BATCH) -> DataFrame:
    """The batch number of each segment within its job."""
    n = F.row_number().over(Window.partitionBy("job_id").orderBy(order))
    return segments.withColumn("batch", F.floor((n - 1) / size).cast("long"))
