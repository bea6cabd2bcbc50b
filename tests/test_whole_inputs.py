"""Registered queries on inputs that a cut of texts or a filter of rows would change."""

import random
import re

from pyspark.sql import functions as F

from sheetloom.functions import measure as M
from sheetloom.functions import text as X
from sheetloom.plans import queries
from sheetloom.sources import tables

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_lines_are_whole(spark, tmp_path):
    start = "x" * 60 + " "
    a, b, c = start + "план", start + "этаж", "y" * 33_000 + " план"
    write(spark, tmp_path, "documents", [(100, f"{a}\n\n{b}\n{c}", "en", "s", 1), (101, f"{b}\n{start}", "en", "s", 1), (102, None, "en", "s", 1)], DOC)
    run = lambda name: queries.queries()[name](spark, str(tmp_path)).collect()
    assert {x.lang: x.n for x in run("inventory_by_lang")} == {"ru": 4, "en": 1}
    assert {x.handle: x.em for x in run("em_width")} == {h: M.hundredths(t) / 100 for h, t in (("d100:0", a), ("d100:2", b), ("d100:3", c), ("d101:0", b), ("d101:1", start))}
    assert {x.source: x.n for x in run("segments_dedup")} == {a: 1, b: 2, c: 1}
    assert {x.target for x in run("mock_translate")} == {f"[EN]{t}[/EN]" for t in (a, b, c, start)}


def test_long_numbers_do_not_overflow_the_stack(spark):
    piece = r"(?:[-+±%.,:/\d\s×xX*#°'\"()\[\]φΦ@=<>~_]|%%[cCdDpPuUoO]|mm|cm|m|kg|kN|MPa|Hz|V|A|W|kW|kVA|Ø|DN|PN|№)+"
    r = random.Random(8)
    texts = ["".join(r.choice(["%", "%%", "c", "cm", "m", "D", "DN", "P", "N", "PN", "Pa", "k", "VA", "V", "7", " ", "x", "q"]) for _ in range(r.randint(0, 7))) for _ in range(3000)]
    texts += ["000 111 " * 5000, "5mm " * 9000, "5V " * 9000 + "q"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.is_protected(F.col("t")).alias("p")).collect()
    assert all(x.p == bool(re.fullmatch(piece, x.t)) for x in got) and 500 < sum(x.p for x in got) < 2500


def test_reviewed_and_wrapped_texts_are_whole(spark, tmp_path):
    text = "word " * 400 + "end"
    write(spark, tmp_path, "documents", [(1, text, "en", "s", len(text)), (3, text, "en", "s", len(text))], DOC)
    write(spark, tmp_path, "labels", [(1, 1, 0)], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "conversations", [(7, 1, "user", text)], "conv_id long, turn long, role string, text string")
    run = lambda name: queries.queries()[name](spark, str(tmp_path)).collect()
    assert {x.id: x.target for x in run("review_table")} == {1: text, 3: ""}
    assert [tuple(x) for x in run("remembered_pairs")] == [(text, text)]
    wrapped = run("greedy_wrap")
    assert [x.lines.replace("|", " ") for x in wrapped] == [text] and wrapped[0].over
    assert [tuple(x) for x in run("fit_histogram")] == [("overflow", 1)]


def test_every_row_of_lineitem_is_a_rule(spark):
    rows = [(k, k % 10, k, 1, 5.0) for k in (1, 2, 3, 50, 51, 99)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    want = sorted((k // 10, "other" if k % 3 else "model", k % 10 * 40.0 + 30.5, -k * 1000.0 - 420.0, -k * 1000.0 - 10.0) for k, *_ in rows)
    assert sorted(tuple(x) for x in tables.rules(li).collect()) == want


def test_every_conversation_is_remembered_or_fresh(spark, tmp_path):
    rows = [(k, 1, "user", f"text {k}") for k in (1, 2, 3, 4, 5, 7)] + [(None, 1, "user", "no key"), (9, 1, "USER", "same"), (8, 1, "USER", "same"), (11, 1, "user", " ")]
    write(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    # New are the texts of 1, 3, 5, 7 and of the row without a key; "same" is known with the same role.
    assert queries.queries()["memory_upsert_count"](spark, str(tmp_path)).first()[0] == 5
