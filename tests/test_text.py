"""String functions on small hand-written cases."""

import random

import pytest
from pyspark.sql import functions as F

from sheetloom.functions import measure as M
from sheetloom.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("r")).first().r


def many(spark, values, f):
    return [r.r for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").orderBy("i").select(f(F.col("s")).alias("r")).collect()]


def test_language_tags(spark):
    assert many(spark, ["План", "図面", "ｶﾅ", "Plan", "+0.000", "図面 А", ""], X.detect_lang) == ["ru", "ja", "ja", "en", "none", "ru", "none"]


def test_translatable(spark):
    values = ["А", "Л1", "ОК-9.1", "Д-9л", "СП", "100 mm", " 　", "План"]
    assert many(spark, values, lambda s: X.is_translatable(F.lit("TEXT"), s, X.detect_lang(s), ["ru"])) == [False] * 4 + [True, False, False, True]


def test_masks(spark):
    assert one(spark, r"A\PB", X.mask) == "A⟦1⟧B" and one(spark, r"A\PB", X.codes) == [r"\P"]
    assert one(spark, "%%C160", lambda s: X.mask(s, X.PLAIN_CODE)) == "⟦1⟧160"
    assert one(spark, "<>x", lambda s: X.mask(s, X.DIMENSION_CODE)) == "⟦1⟧x"


@pytest.mark.parametrize(("marked", "held", "out"), [("⟦1⟧a", ["c1"], "c1a"), ("a", ["{", "}"], "{a}"), ("⟦1⟧⟦1⟧", ["c1"], "c1"), ("⟦9⟧a", ["c1"], "c1a"), ("b⟦2⟧a⟦1⟧", ["x", "y"], "byax")])
def test_unmask(spark, marked, held, out):
    assert one(spark, marked, lambda s: X.unmask(s, F.array(*(F.lit(c) for c in held)))) == out


def test_unmask_undoes_mask(spark):
    r = random.Random(1)
    values = ["".join(r.choice([r"\P", "a", "{", "}", "%%c", r"\fArial|b0;", r"\W0.8;", "я", " "]) for _ in range(r.randint(0, 12))) for _ in range(200)]
    assert many(spark, values, lambda s: X.unmask(X.mask(s), X.codes(s))) == values


def test_markers(spark):
    pairs = [("⟦1⟧⟦2⟧", "⟦2⟧x⟦1⟧", True), ("⟦1⟧", "⟦1⟧⟦1⟧", False), ("", "", True)]
    got = spark.createDataFrame(pairs, "a string, b string, want boolean").select((X.markers_ok(F.col("a"), F.col("b")) == F.col("want")).alias("r")).collect()
    assert all(x.r for x in got)


def test_edges(spark):
    assert tuple(one(spark, "⟦1⟧a⟦2⟧", X.strip_edges)) == ("⟦1⟧", "a", "⟦2⟧")
    assert tuple(one(spark, "⟦1⟧ ⟦2⟧", X.strip_edges)) == ("", "⟦1⟧ ⟦2⟧", "")


def test_mock(spark):
    assert many(spark, ["a⟦1⟧b", " ", "⟦1⟧"], X.mock_translate) == ["[EN]a[/EN]⟦1⟧[EN]b[/EN]", " ", "⟦1⟧"]


def test_places(spark):
    assert many(spark, ["page:19", "paper:ПОС", "block:b", "model", "", None], X.place_name) == ["page 19", "sheet ПОС", "block b", "model space", "", ""]


def test_latin(spark):
    assert one(spark, "・ＡＢＣ　1\nГОСТ Р 1 СПб СП", X.latinize) == "- ABC 1\nGOST R 1 СПб SP"
    assert one(spark, "Ａ・　", X.ascii_forms) == "A· "


def test_rich_text(spark):
    assert one(spark, r"{\fArial|b0|c204;a\P}b", X.mtext_plain) == "a\nb"
    assert many(spark, [r"\W0.8;a", r"{\W0.5;a}b", "a", r"\W0;a"], X.mtext_width_factor) == [0.8, 1.0, 1.0, 1.0]
    assert many(spark, [r"\W0.8;a", "a"], lambda s: X.narrow_mtext(s, F.lit(0.5))) == [r"\W0.4;a", r"\W0.5;a"]
    assert tuple(one(spark, r"\fRomans|c0;a\fMS Gothic;b", lambda s: X.swap_fonts(s, "Arial", ["gothic"]))) == (r"\fArial|c0;a\fMS Gothic;b", 1)
    assert one(spark, r"\fA|c204;a\fA|c1;b{\fA|c0;\fB;c}\fA|c9;d", X.simplify_mtext) == r"\fA|c0;ab{\fB;c}d"


def test_rows_and_names(spark):
    assert one(spark, "ab     cd", lambda s: X.repad(s, F.lit("x   y"))) == "x      y"
    assert one(spark, "担当 山田 太郎", lambda s: X.name_note(F.lit("ja"), s)) == "name reading unverified"
    assert [tuple(x) for x in one(spark, "ab図面c", X.script_runs)] == [("ab", False), ("図面", True), ("c", False)]


def test_shifted_text(spark):
    word = "План этажа"
    away = "".join(chr(c.encode("cp1251")[0] + 0x17A) if ord(c) > 0x7E else c for c in word)
    assert many(spark, [away, "plain", word], X.decode_shift) == [word, "plain", word]


def test_answers(spark):
    got = one(spark, 'ok ```json\n{"s1": "a", "s2": {"t": "b", "note": "n"}}\n```', X.parse_answers)
    assert [tuple(x) for x in got] == [("s1", "a", ""), ("s2", "b", "n")]


def test_widths_agree(spark):
    values = ["", "abc", "図面 ABC", "Привет, Мир!", "ｶﾅ\n(1)[2]", "iljt.,;:"]
    assert many(spark, values, M.em_width) == [M.hundredths(v) / 100.0 for v in values]


def test_string_functions_are_linear_in_the_number_of_codes(spark):
    import time

    from pyspark.sql import functions as F

    from sheetloom.functions import text as X

    def took(n):
        df = spark.createDataFrame([("a<b>" * n,)] * 4, "t string").repartition(4)
        m = df.select(X.mask(F.col("t"), r"(<[^>]+>)").alias("m"), X.codes(F.col("t"), r"(<[^>]+>)").alias("c"))
        out = m.select(X.unmask(F.col("m"), F.col("c")).alias("u"), X.mock_translate(F.col("m")).alias("k"))
        began = time.time()
        rows = out.collect()
        assert rows[0].u == "a<b>" * n and rows[0].k.count("⟧") == n
        return time.time() - began

    took(200)
    assert took(16_000) < 12 * max(took(4_000), 0.25)
