"""The run with paragraphs, stages on disk, keys that keep drawings apart, and every query with its SQL counterpart."""

import os

import pytest
from pyspark.sql import functions as F

from sheetloom import schema
from sheetloom.operators import cluster, review, segments, spatial, translation
from sheetloom.plans import pipeline, queries
from sheetloom.sources import stages

SF = "/root/testdata/sf0.001"
ITEM = "job_id long, ord long, handle string, kind string, place string, layer string, plain string, lang string, height double, x double, y double"


def drawing(spark, jobs=(1, 2)):
    rows = []
    for j in jobs:
        rows += [(j, 1, "a", "TEXT", "model", "l", "первая строка текста,", "ru", 2.0, 0.0, 20.0), (j, 2, "b", "TEXT", "model", "l", "вторая строка текста", "ru", 2.0, 0.0, 16.0), (j, 3, "c", "MTEXT", "model", "l", "отдельно", "ru", 2.0, 300.0, 16.0)]
    return spark.createDataFrame(rows, ITEM)


def none(spark, ddl):
    return spark.createDataFrame([], ddl)


def test_paragraphs_are_part_of_the_run_and_jobs_stay_apart(spark):
    rules = none(spark, "job_id long, place string, pos double, lo double, hi double")
    run = pipeline.run_all(drawing(spark), rules, none(spark, "source string, target string"))
    assert {(x.job_id, x.source) for x in run.segments.collect()} == {(j, s) for j in (1, 2) for s in ("первая строка текста, вторая строка текста", "отдельно")}
    inst = {(x.job_id, x.inst): x for x in run.instances.collect()}
    assert inst[1, "a"].handles == ["a", "b"] and inst[1, "a"].max_lines == 2 and len(inst[1, "a"].caps) == 2
    plan = run.plan.collect()
    # Equal handles in two drawings do not multiply rows.
    written = [(x.id[0], x.handle) for x in plan if x.action == "update"]
    assert sorted(written) == [(j, h) for j in "12" for h in "abc"]
    both = " ".join(x.new_text for x in sorted(plan, key=lambda x: x.handle) if x.id[0] == "1" and x.handle in "ab")
    assert both.split() == "[EN]первая строка текста, вторая строка текста[/EN]".split()


def test_answers_that_overflow_are_shortened_and_assessed_anew(spark):
    rules = spark.createDataFrame([(1, "model", 26.0, 0.0, 100.0), (2, "model", 26.0, 0.0, 100.0)], "job_id long, place string, pos double, lo double, hi double")
    items = spark.createDataFrame([(1, 1, "a", "TEXT", "model", "l", "план", "ru", 2.0, 0.0, 20.0)], ITEM)
    memory = spark.createDataFrame([("план", "a very long answer that never fits beside a wall")], "source string, target string")
    long = pipeline.run_all(items, rules, memory)
    assert long.fits.first().flag == "overflow"
    short = pipeline.run_all(items, rules, memory, shorter=lambda rows: rows.select("id", F.lit("plan").alias("target")))
    assert short.fits.first().flag == "" and [x.new_text for x in short.plan.collect()] == ["plan"]


def test_shortening_keeps_every_row(spark):
    rows = spark.createDataFrame([("1", "s", "long answer", 4), ("2", "s", "ok", 4), ("3", "s", "hopeless", 1)], "id string, source string, target string, budget int")
    tries = []

    def shorter(left):
        tries.append(1)
        return left.select("id", F.when(F.col("id") == "1", "tiny" if len(tries) > 1 else "still long").otherwise(None).alias("target"))

    got = {x.id: (x.target, x.shortened) for x in translation.shorten(rows, shorter).collect()}
    assert got == {"1": ("tiny", True), "2": ("ok", False), "3": ("hopeless", False)} and len(tries) == 2


def test_a_pass_of_shortening_asks_once_a_row(spark):
    """Passes used to be planned into each other, so a task sorted all of them at once and each row was asked for again and again."""
    asked = spark.sparkContext.accumulator(0)

    def count(s):
        asked.add(1)
        return "still too long"

    rows = spark.createDataFrame([(str(i), "s", "long answer", 4) for i in range(20)], "id string, source string, target string, budget int")
    ask = F.udf(count, "string").asNondeterministic()
    out = translation.shorten(rows, lambda left: left.select("id", ask("source").alias("target")))
    assert out.count() == 20 and out.where("shortened").isEmpty() and asked.value == 2 * 20


def test_stages_change_at_once(spark, tmp_path):
    path = str(tmp_path / "stage")
    one = spark.createDataFrame([("1", "a", True, "")], schema.TRANSLATION)
    stages.write_stage(one, path)
    first = stages.read_stage(spark, path, schema.TRANSLATION)
    stages.write_stage(one.withColumn("target", F.lit("b")), path)
    # Who holds the old version still reads it whole.
    assert first.first().target == "a" and stages.read_stage(spark, path, schema.TRANSLATION).first().target == "b"
    assert sorted(f for f in os.listdir(f"{path}/{stages.LOG}") if not f.endswith(".crc")) == ["000000000001", "000000000002"]


def test_long_rules_meet_their_place_without_cells(spark):
    items = drawing(spark, (1,))
    rules = spark.createDataFrame([(1, "model", 60.0, -1e9, 1e9), (2, "model", 61.0, -1e9, 1e9)], "job_id long, place string, pos double, lo double, hi double")
    got = {x.handle: x.wall_r for x in spatial.wall_gaps(items, rules).collect()}
    assert got["a"] == 60.0 and got["b"] == 60.0


def test_clusters_do_not_cross_drawings(spark):
    pts = spark.createDataFrame([(j, "model", 10 * j + i, float(i), 0.0) for j in (1, 2) for i in range(5)], "job_id long, place string, node long, px double, py double")
    got = cluster.cluster_boxes(cluster.clusters(pts, 2.0))
    assert sorted((x.job_id, x.n) for x in got.collect()) == [(1, 5), (2, 5)]
    merged = cluster.merge_boxes(got)
    assert merged.count() == 2
    gaps = spatial.side_gaps(spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0), (1, 2, 5.0, 0.0, 6.0, 1.0), (2, 3, 2.0, 0.0, 3.0, 1.0)], "job_id long, box long, x0 double, y0 double, x1 double, y1 double"))
    assert {x.box: x.right for x in gaps.collect()} == {1: 4.0, 2: None, 3: None}


def test_reports_hold_few_texts_and_count_all(spark):
    rows = spark.createDataFrame([(f"{i:03}", "overflow", True, True, f"t{i}", "s", ["p"]) for i in range(200)], "id string, fit string, approved boolean, ok boolean, display string, source string, places array<string>")
    row = review.to_check(rows).first()
    assert row.n == 200 and row.shown == [f"t{i}" for i in range(review.SHOWN)]


def test_place_lists():
    assert segments.sources_for("en") == ["ru", "ja"]


@pytest.mark.parametrize("name", ["entity_items", "mtext_plain", "patch_plan_of_paragraphs", "merged_boxes", "frames_by_layer", "greedy_wrap", "latin_forms", "page_line_texts", "block_rules", "tag_errors", "sheets_framed", "span_leftovers", "report_text", "layouts_in_order"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    assert sorted(tuple(map(str, (r[c] for c in cols))) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
