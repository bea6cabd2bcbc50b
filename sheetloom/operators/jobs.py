"""Jobs, folders, spending: relational operators over the job documents and the usage log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRASH_DAYS = 14


def priced(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Adds usd: tokens by class times the model's rate; unknown models take the `default` row, missing classes count 0."""
    rates = [(c, p) for c, p in (("input", "p_in"), ("output", "p_out"), ("cache_read", "p_read"), ("cache_write", "p_write")) if p in pricing.columns]
    known = pricing.where("model <> 'default'").select("model", *(F.col(p).alias(f"k_{p}") for _, p in rates))
    other = pricing.where("model = 'default'").select(*(F.col(p).alias(f"d_{p}") for _, p in rates)).limit(1)
    out = usage.join(known, "model", "left").join(F.broadcast(other), F.lit(True), "left")  # one row
    tokens = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in usage.columns else F.lit(0)
    usd = sum((tokens(c) * F.coalesce(f"k_{p}", f"d_{p}", F.lit(0.0)) for c, p in rates), F.lit(0.0)) / 1e6
    return out.select(*usage.columns, usd.alias("usd"))


def spend_totals(cost: DataFrame, now: Column) -> DataFrame:
    day, month = F.to_date("at") == F.to_date(now), F.date_trunc("month", "at") == F.date_trunc("month", now)
    total = lambda ok: F.sum(F.when(ok, F.col("usd")).otherwise(0.0))
    return cost.agg(F.sum("usd").alias("all_usd"), total(month).alias("month_usd"), total(day).alias("today_usd"), F.sum("input").alias("tokens_in"), F.sum("output").alias("tokens_out"), F.count_distinct("job_id").alias("jobs"))


def spend_per_job(cost: DataFrame) -> DataFrame:
    return cost.groupBy("job_id").agg(F.sum("usd").alias("usd"), F.sum("input").alias("tokens_in"), F.sum("output").alias("tokens_out"))


def spend_rollup(cost: DataFrame) -> DataFrame:
    """Sums by month, by month and day, and in all."""
    return cost.rollup(F.date_format("at", "yyyy-MM").alias("month"), F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.sum("usd").alias("usd"), F.count("*").alias("n"))


def folders(jobs: DataFrame) -> DataFrame:
    """(client, project, n) with defaults for what is blank."""
    named = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d)).alias(c)
    return jobs.select(named("client", "Unfiled"), named("project", "General")).groupBy("client", "project").agg(F.count("*").alias("n"))


def deletable(jobs: DataFrame, client: str) -> DataFrame:
    """The jobs of a folder; none while one of them runs."""
    mine = jobs.where(F.coalesce(F.nullif(F.trim("client"), F.lit("")), F.lit("Unfiled")) == client)
    busy = mine.agg(F.count_if(F.col("status").isin("running", "waiting")).alias("busy"))
    return mine.join(F.broadcast(busy), F.lit(True)).where("busy = 0").drop("busy")  # one row


def update_job(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Non-blank fields of changes (id; client, project, status as there are) replace."""
    named = [c for c in ("client", "project", "status") if c in changes.columns]
    new = changes.select("id", *(F.nullif(F.trim(c), F.lit("")).alias(f"n_{c}") for c in named))
    return jobs.join(new, "id", "left").select(*(F.coalesce(f"n_{c}", c).alias(c) if c in named else jobs[c] for c in jobs.columns))


def set_flag(flags: Column, place: Column, note: Column | None) -> Column:
    """The map with the place's note put in, or taken out for None."""
    rest = F.map_filter(flags, lambda k, _: k != place)
    return rest if note is None else F.map_concat(rest, F.create_map(place, note))


def trash(jobs: DataFrame, now: Column) -> DataFrame:
    """Deleted jobs still kept, with their age in days."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("deleted_at")) / 86400.0
    return jobs.where("deleted_at is not null").withColumn("deleted_days_ago", age).where(F.col("deleted_days_ago") <= TRASH_DAYS)


def purged(jobs: DataFrame, now: Column) -> DataFrame:
    """Deleted jobs whose time in the trash is over."""
    return jobs.where((F.unix_timestamp(now) - F.unix_timestamp("deleted_at")) / 86400.0 > TRASH_DAYS)


def restored(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs with those of `ids` taken out of the trash."""
    back = jobs.join(ids.select("id", F.lit(True).alias("back")).distinct(), "id", "left")
    return back.withColumn("deleted_at", F.when(F.col("back"), None).otherwise(F.col("deleted_at"))).select(*jobs.columns)


def upload_type(name: Column, head: Column) -> Column:
    """dwg, dxf or pdf by the name's ending, if the first bytes agree; else null."""
    low, start = F.lower(name), F.decode(F.substring(head, 1, 64), "ISO-8859-1")
    return F.when(low.endswith(".dwg") & start.startswith("AC10"), "dwg").when(low.endswith(".dxf") & start.rlike(r"^\s*0\s+SECTION|^AutoCAD Binary"), "dxf").when(low.endswith(".pdf") & start.startswith("%PDF-"), "pdf")


def download(made: Column) -> Column:
    """The format to hand out of those that were made."""
    return F.when(F.array_contains(made, "dwg"), "dwg").when(F.array_contains(made, "dxf"), "dxf").when(F.array_contains(made, "pdf"), "pdf")


def stage_timing(log: DataFrame) -> DataFrame:
    """(stage, runs, seconds): from a stage's first entry in the log to its last."""
    return log.groupBy("stage").agg(F.count("*").alias("runs"), (F.unix_micros(F.max(F.col("at")).cast("timestamp")) - F.unix_micros(F.min(F.col("at")).cast("timestamp"))).cast("double").alias("us")).select("stage", "runs", (F.col("us") / 1e6).alias("seconds"))


def with_text(worst: DataFrame, segments: DataFrame) -> DataFrame:
    """The tightest segments with their source texts."""
    return worst.join(segments.select("id", "source"), "id", "left")


def listing(jobs: DataFrame, run_state: DataFrame) -> DataFrame:
    return jobs.join(run_state, "id", "left").withColumn("state", F.coalesce("state", F.lit("idle"))).orderBy(F.desc("id"))


def sheets(layouts: DataFrame, frames: DataFrame, clusters: DataFrame) -> DataFrame:
    """Layouts win over frames, frames over clusters: of each job (job_id, …) the best kind it has."""
    ranked = layouts.withColumn("rank", F.lit(0)).unionByName(frames.withColumn("rank", F.lit(1))).unionByName(clusters.withColumn("rank", F.lit(2)))
    best = ranked.groupBy("job_id").agg(F.min("rank").alias("rank"))
    return ranked.join(best, ["job_id", "rank"], "left_semi").drop("rank")


def diagnostics(stages: DataFrame, fit_histogram: DataFrame, worst: DataFrame) -> DataFrame:
    """(section, line) of stages, flags and the tightest segments."""
    return (
        stages.select(F.lit("stage").alias("section"), F.concat_ws(" ", "name", "seconds").alias("line"))
        .unionByName(fit_histogram.select(F.lit("fit").alias("section"), F.concat_ws(": ", "flag", F.col("n").cast("string")).alias("line")))
        .unionByName(worst.select(F.lit("worst").alias("section"), F.concat_ws(" ", "id", "flag", *(["source"] if "source" in worst.columns else [])).alias("line")))
    )


def created(jobs: DataFrame, new: DataFrame, stamp: Column) -> DataFrame:
    """jobs with new ones (client, project; the rest of a job's columns if there): blank names get their defaults, ids are the
    stamp and, if that is taken, the stamp with the next free number behind it."""
    fields = [f.name for f in jobs.schema]
    name = lambda c, value: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(value)).alias(c)
    rest = [F.col(c) if c in new.columns else F.lit("new" if c == "status" else None).cast(jobs.schema[c].dataType).alias(c) for c in fields if c not in ("id", "client", "project")]
    taken = jobs.where(F.col("id").startswith(stamp)).agg(F.coalesce(F.max(F.coalesce(F.regexp_extract("id", r"-(\d{3})$", 1).try_cast("int"), F.lit(0))), F.lit(-1)).alias("last"))
    nth = F.row_number().over(Window.orderBy("client", "project")) + F.col("last")  # the jobs of one request
    rows = new.join(taken, F.lit(True)).withColumn("nth", nth)
    ids = F.when(F.col("nth") == 0, stamp).otherwise(F.concat(stamp, F.lit("-"), F.lpad(F.col("nth").cast("string"), 3, "0"))).alias("id")
    return jobs.unionByName(rows.select(ids, name("client", "Unfiled"), name("project", "General"), *rest))
