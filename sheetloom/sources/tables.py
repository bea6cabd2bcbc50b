"""Inputs: parquet tables, and the drawing-like relations that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions import text as X

#: Documents that make up one derived drawing set; every spatial key carries its number.
DOCS_A_JOB = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """One row a line of a document, whole; empty lines go."""
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length("line") > 0)


def text_items(docs: DataFrame) -> DataFrame:
    """Positioned text items: scripts, kinds, places and coordinates follow from the keys of the line."""
    d, p, line = F.col("doc_id"), F.col("pos"), F.col("line")
    mod = lambda c, n: F.pmod(c, F.lit(n))
    plain = (
        F.when(F.col("lang") == "de", F.translate(line, "aeinorstu", "аеинорсту"))
        .when(F.col("lang") == "fr", F.translate(line, "aeinorstu", "あえいのおらすとう"))
        .when(F.col("lang") == "es", F.translate(F.lower(line), "abcdefghijklmnopqrstuvwxyzáéíóúñü", "000111222333444555666777888999000"))
        .otherwise(line)
    )
    kind = F.element_at(F.array(*(F.lit(k) for k in ("TEXT", "MTEXT", "ATTRIB", "DIMENSION", "TEXT"))), (mod(d, 5) + 1).cast("int"))
    place = F.when(mod(d, 3) == 0, "model").when(mod(d, 3) == 1, F.concat(F.lit("paper:"), "source")).otherwise(F.concat(F.lit("block:"), "source"))
    out = lines(docs).select(
        F.floor(d / DOCS_A_JOB).cast("long").alias("job_id"),
        F.concat(F.lit("d"), d.cast("string"), F.lit(":"), p.cast("string")).alias("handle"),
        "doc_id", p.cast("int").alias("pos"), kind.alias("kind"), place.alias("place"), F.col("source").alias("layer"), plain.alias("plain"),
        (2.5 + mod(d, 3) * 0.5).cast("double").alias("height"),
        (mod(d, 10) * 40.0 + mod(d, 7) * 3.0 + mod(p, 3) * 2.0).cast("double").alias("x"),
        (-mod(p, 200) * 3.5 - F.floor(d / 10) * 1000.0).cast("double").alias("y"),
    )
    return out.withColumn("lang", X.detect_lang(F.col("plain")))


def rules(lineitem: DataFrame) -> DataFrame:
    """Vertical rules of the derived drawings, one a row of lineitem: (job_id, place, pos, lo, hi)."""
    k = F.col("l_orderkey")
    return lineitem.select(
        F.floor(F.pmod("l_suppkey", F.lit(100)) / 10).cast("long").alias("job_id"),
        F.when(k % 3 == 0, "model").otherwise("other").alias("place"),
        (F.pmod("l_partkey", F.lit(10)) * 40.0 + 30.0 + F.col("l_quantity") / 10.0).cast("double").alias("pos"),
        (-F.pmod("l_suppkey", F.lit(100)) * 1000.0 - (F.col("l_linenumber") + 5) * 70.0).cast("double").alias("lo"),
        (-F.pmod("l_suppkey", F.lit(100)) * 1000.0 - F.col("l_linenumber") * 10.0).cast("double").alias("hi"),
    )


def usage(events: DataFrame) -> DataFrame:
    """Usage log: the event type stands for the model, its value for the tokens."""
    n = F.floor(F.coalesce("value", F.lit(0.0)) * 100).cast("long")
    return events.select("event_id", F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_type").alias("model"), n.alias("input"), F.floor(n / 4).cast("long").alias("output"))


def pricing(spark: SparkSession) -> DataFrame:
    """Dollars per million tokens; `default` serves models without a row."""
    return spark.createDataFrame([("click", 3.0, 15.0), ("purchase", 15.0, 75.0), ("default", 1.0, 5.0)], "model string, p_in double, p_out double")


#: The same relations in DuckDB, as leading common table expressions.
TEXT_ITEM_SQL = f"""l0 as (select doc_id, lang, source, string_split(text, chr(10)) a from documents),
lines as (select doc_id, lang, source, u.pos - 1 as pos, a[u.pos] line from l0, lateral (select unnest(range(1, len(a) + 1)) as pos) u),
ti0 as (select cast(floor(doc_id / {DOCS_A_JOB}) as bigint) job_id, concat('d', cast(doc_id as varchar), ':', cast(pos as varchar)) handle, doc_id, cast(pos as int) pos,
 case cast(doc_id % 5 as int) when 0 then 'TEXT' when 1 then 'MTEXT' when 2 then 'ATTRIB' when 3 then 'DIMENSION' else 'TEXT' end kind,
 case cast(doc_id % 3 as int) when 0 then 'model' when 1 then concat('paper:', source) else concat('block:', source) end place, source layer,
 case lang when 'de' then translate(line, 'aeinorstu', 'аеинорсту') when 'fr' then translate(line, 'aeinorstu', 'あえいのおらすとう')
  when 'es' then translate(lower(line), 'abcdefghijklmnopqrstuvwxyzáéíóúñü', '000111222333444555666777888999000') else line end plain,
 cast(2.5 + (doc_id % 3) * 0.5 as double) height, cast((doc_id % 10) * 40.0 + (doc_id % 7) * 3.0 + (pos % 3) * 2.0 as double) x,
 cast(-(pos % 200) * 3.5 - floor(doc_id / 10) * 1000.0 as double) y from lines where length(line) > 0),
ti as (select *, case when regexp_matches(plain, '[\\x{{0400}}-\\x{{04FF}}]') then 'ru' when regexp_matches(plain, '[\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{FF66}}-\\x{{FF9F}}]') then 'ja'
 when regexp_matches(plain, '[A-Za-z]') then 'en' else 'none' end lang from ti0)"""

RULE_SQL = """rule as (select cast(floor((l_suppkey % 100) / 10) as bigint) job_id, case cast(l_orderkey % 3 as int) when 0 then 'model' else 'other' end place,
 cast((l_partkey % 10) * 40.0 + 30.0 + l_quantity / 10.0 as double) pos, cast(-(l_suppkey % 100) * 1000.0 - (l_linenumber + 5) * 70.0 as double) lo,
 cast(-(l_suppkey % 100) * 1000.0 - l_linenumber * 10.0 as double) hi from lineitem)"""

USAGE_SQL = """usage as (select event_id, user_id job_id, ts "at", event_type model, cast(floor(coalesce(value, 0.0) * 100) as bigint) input, cast(floor(floor(coalesce(value, 0.0) * 100) / 4) as bigint) output from events),
pricing as (select * from (values ('click', 3.0::double, 15.0::double), ('purchase', 15.0::double, 75.0::double), ('default', 1.0::double, 5.0::double)) t(model, p_in, p_out))"""
