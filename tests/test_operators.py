"""Operators on small inputs, some against naive models."""

import random

from pyspark.sql import functions as F

from sheetloom.functions import measure as M
from sheetloom.operators import cluster, fit, jobs, review, segments, spatial, translation
from sheetloom.plans import pipeline
from sheetloom.sources import entities

ITEM = "job_id long, ord long, handle string, kind string, place string, layer string, plain string, lang string, height double, x double, y double"


def item(n, plain, x, y, h=2.0, lang="ru", place="model", kind="TEXT", layer="l"):
    return (1, n, f"h{n}", kind, place, layer, plain, lang, h, float(x), float(y))


def test_neighbours_and_walls_against_all_pairs(spark):
    r = random.Random(1)
    rows = [item(i, "a" * r.randint(1, 20), r.randint(0, 300), r.randint(0, 60), r.choice([1.0, 2.0, 5.0]), place=r.choice("pq")) for i in range(120)]
    rules = [(1, r.choice("pq"), float(r.randint(0, 400)), float(a := r.randint(-20, 60)), float(a + r.randint(0, 90))) for _ in range(40)]
    want = {}
    box = lambda t: (t[9], t[9] + max(M.hundredths(t[6]) / 100 * t[8], t[8]))
    for a in rows:
        (l, e), h = box(a), a[8]
        reach, right = max(6 * (e - l), 60 * h), []
        for b in rows:
            if b is not a and b[4] == a[4] and abs(b[10] - a[10]) <= 3 * h and abs(b[10] - a[10]) < 0.7 * max(h, b[8]) and 0.5 * h <= box(b)[0] - l <= reach:
                right.append(box(b)[0] - l)
        near = [w for w in rules if w[1] == a[4] and w[3] <= a[10] + 1.2 * h and w[4] >= a[10] - 0.2 * h]
        if not any(l + 0.3 * h <= w[2] < e - 0.3 * h for w in near):
            right += [w[2] - l for w in near if w[2] >= e - 0.3 * h and w[2] - l <= reach]
        if right:
            want[a[2]] = max(min(right) - 0.3 * h, e - l)
    got = {x.handle: x.avail for x in spatial.available_widths(spark.createDataFrame(rows, ITEM), spark.createDataFrame(rules, "job_id long, place string, pos double, lo double, hi double")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_room_below(spark):
    rows = [item(1, "wide text", 0, 20), item(2, "under", 0, 10), item(3, "aside", 500, 15)]
    floors = spark.createDataFrame([(1, "model", 14.0, -5.0, 100.0)], "job_id long, place string, pos double, lo double, hi double")
    got = {x.handle: x.clear for x in spatial.room_below(spark.createDataFrame(rows, ITEM), floors).collect()}
    assert got == {"h1": 6.0}


def test_paragraphs(spark):
    rows = [item(1, "первая строка текста,", 0, 20), item(2, "вторая строка текста", 0, 16), item(3, "- пункт списка один", 0, 12), item(4, "далеко вправо ушла", 90, 12)]
    ja = [item(5, "これは一行目の文章", 0, 20, lang="ja", layer="j"), item(6, "これは二行目の文章", 0, 16, lang="ja", layer="j")]
    got = {x.handle: (x.paragraph, x.line) for x in segments.paragraphs(spark.createDataFrame(rows + ja, ITEM)).collect()}
    assert got == {"h1": ("h1", 0), "h2": ("h1", 1), "h3": ("h3", 0), "h4": ("h4", 0), "h5": ("h5", 0), "h6": ("h6", 0)}


def test_segments_keep_the_first(spark):
    rows = [(1, 2, "b", "A", ["y"], "p", "ru", "L2", 9.0), (1, 1, "a", "A", ["x"], "p", "ru", "L1", 3.0), (1, 3, "c", "B", [], "q", "ru", "L1", 1.0), (2, 1, "d", "A", [], "p", "ru", "L", 1.0)]
    got = {(x.job_id, x.id): x for x in segments.segments(spark.createDataFrame(rows, "job_id long, ord long, handle string, marked string, codes array<string>, plain string, lang string, layer string, height double"), ["ord"]).collect()}
    first = got[1, "s00001"]
    assert (first.source, first.codes, first.max_height, first.context, first.handles, first.codes_conflict) == ("A", ["x"], 9.0, "L1, L2", ["a", "b"], True)
    assert set(got) == {(1, "s00001"), (1, "s00002"), (2, "s00001")}


def test_wrapping():
    w = M.hundredths("word") / 100
    assert fit.settled("word word", [3 * w], 1) == (False, 100, ["word word"])
    assert fit.settled("word word", [2 * w], 1)[1] < 100
    assert fit.settled("word word word word", [w], 2) == (True, 60, ["word", "word word word"])
    assert fit.settled("x" * 90, [1.0], 1) == (False, 100, ["x" * 90])
    assert fit.settled("a b", [0.0], 1) == (False, 100, ["a b"])
    assert fit.greedy("aa bb\ncc", [M.hundredths("aa") / 100, 99.0]) == ["aa", "bb", "cc"]
    assert fit.best_fit("word word word", [w], [w], 1, spare=2)[0] == ["word"] * 3
    r = random.Random(2)
    for _ in range(200):
        words = ["x" * r.randint(1, 9) for _ in range(r.randint(1, 12))]
        assert " ".join(fit.settled(" ".join(words), [r.uniform(2, 9)], r.randint(1, 4))[2]).split() == words


def test_translator_retries(spark):
    def shaky(rows):
        if len(rows) > 2 or (rows["id"] == "bad").any():
            raise RuntimeError("no")
        return rows.assign(target=rows["source"].str.upper(), note="")[["id", "target", "note"]]

    got = {x.id: x for x in translation.translate(spark.createDataFrame([(str(i), f"a⟦{i}⟧") for i in range(7)] + [("bad", "b")], "id string, source string"), shaky).collect()}
    assert all(got[str(i)].ok and got[str(i)].target == f"A⟦{i}⟧" for i in range(7)) and not got["bad"].ok


def test_memory(spark):
    pair = "source string, target string"
    mem = translation.layered(spark.createDataFrame([("a", "1"), ("b", "2")], pair), spark.createDataFrame([("b", "3"), ("c", "")], pair))
    assert {tuple(x) for x in mem.collect()} == {("a", "1"), ("b", "3"), ("c", "")}
    probe = spark.createDataFrame([("a",), ("c",), ("a ",)], "source string")
    assert [x.source for x in translation.hits(probe, mem).collect()] == ["a"] and {x.source for x in translation.misses(probe, mem).collect()} == {"c", "a "}
    assert translation.learned_count(mem, spark.createDataFrame([("a", "1"), ("b", "9"), ("d", " ")], pair)).first().n == 1


def test_clusters_against_union(spark):
    r = random.Random(3)
    pts = [(i, float(r.randint(0, 150)), float(r.randint(0, 150))) for i in range(150)]
    root = {i: i for i, *_ in pts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in pts:
        for b in pts:
            if abs(a[1] - b[1]) <= 8 and abs(a[2] - b[2]) <= 8:
                root[max(find(a[0]), find(b[0]))] = min(find(a[0]), find(b[0]))
    got = {x.node: x.label for x in cluster.clusters(spark.createDataFrame(pts, "node long, px double, py double"), 8.0).collect()}
    assert len({(got[i], find(i)) for i in got}) == len(set(got.values())) == len({find(i) for i in root})
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0, 5), (2, 4.0, 4.0, 9.0, 9.0, 5), (3, 8.0, 0.0, 12.0, 5.0, 5), (4, 50.0, 50.0, 60.0, 60.0, 5)], "box long, x0 double, y0 double, x1 double, y1 double, n long")
    assert sorted((x.x0, x.x1, x.n) for x in cluster.merge_boxes(boxes).collect()) == [(0.0, 12.0, 15), (50.0, 60.0, 5)]


def test_cost_and_checks(spark):
    use = spark.createDataFrame([(1, "m", 1_000_000, None), (2, "other", 0, 2_000_000)], "job_id long, model string, input long, output long")
    price = spark.createDataFrame([("m", 3.0, 15.0), ("default", 1.0, 5.0)], "model string, p_in double, p_out double")
    assert {x.job_id: x.usd for x in jobs.priced(use, price).collect()} == {1: 3.0, 2: 10.0}
    table = spark.createDataFrame([("1", "overflow", False, True, "t", "s", ["p"]), ("2", "", True, False, "", "src\nx", None)], "id string, fit string, approved boolean, ok boolean, display string, source string, places array<string>")
    got = {(x.place, x.kind): x.shown for x in review.to_check(table, spark.createDataFrame([("p", " ")], "place string, note string")).collect()}
    assert got == {("p", "wider than the space"): ["t"], ("p", "not approved, so left in the original language"): ["t"], ("somewhere not recorded", "the model was unsure"): ["src x"], ("p", "flagged by the reviewer"): ["no note given"]}


def test_verification(spark):
    g = spark.createDataFrame([(1, 2.0), (1, 2.0), (3, 4.0)], "a int, b double")
    f = review.fingerprint(g, ["a", "b"])
    assert review.verify(f, review.fingerprint(g.orderBy(F.desc("a")), ["a", "b"]), 1, 2, 1).first().ok
    assert review.verify(f, review.fingerprint(g.where("a = 1"), ["a", "b"]), 1, 1).first().problems == ["geometry: 3 before, 2 after"]
    assert review.verify(f, review.fingerprint(g.withColumn("b", F.col("b") + 1), ["a", "b"]), 1, 1).first().problems == ["geometry moved"]


def test_entity_scan(spark):
    from sheetloom import schema

    e = lambda n, t, text=None, flags=0, attribs=None, cells=None, space="model": (1, space, n, t, f"e{n}", "l", "s", text, flags, 1.0, 0.0, 0.0, attribs, cells, None, False)
    rows = [e(1, "TEXT", "ПЛАН"), e(2, "MTEXT", r"А\PБ"), e(3, "INSERT", attribs=[("T", "марка"), ("U", " ")]), e(4, "DIMENSION", "<>"), e(5, "DIMENSION", "<> шт"), e(6, "ACAD_TABLE", cells=["", "ячейка"]), e(7, "ATTDEF", "x", 2), e(8, "ATTDEF", "y", 0), e(9, "MLEADER", "выноска"), e(10, "OLE2FRAME"), e(11, "FOO", "lost"), e(12, "TEXT", "z", space="block:*Model_Space")]
    df = spark.createDataFrame(rows, schema.ENTITY)
    got = {x.handle: (x.kind, x.plain, x.lang) for x in entities.items(df).collect()}
    assert got == {"e1": ("TEXT", "ПЛАН", "ru"), "e2": ("MTEXT", "А\nБ", "ru"), "e3:T": ("ATTRIB", "марка", "ru"), "e5": ("DIMENSION", "  шт", "ru"), "e6:1": ("TABLE_CELL", "ячейка", "ru"), "e7": ("ATTDEF", "x", "en"), "e9": ("MLEADER", "выноска", "ru")}
    assert entities.unreachable(df).first().type == "OLE2FRAME" and entities.uncollected(df).first()["sample"] == "lost"


def test_rules_and_cells(spark):
    from sheetloom import schema

    v = lambda *p: [{"x": float(a), "y": float(b)} for a, b in p]
    rows = [(1, "model", 1, "LWPOLYLINE", "e", "l", "s", None, 0, 0.0, 0.0, 0.0, None, None, v((0, 0), (0, 10), (5, 10), (5, 0)), True)]
    got = sorted((x.pos, x.lo, x.hi) for x in entities.rule_lines(spark.createDataFrame(rows, schema.ENTITY)).collect())
    assert got == [(0.0, 0.0, 10.0), (5.0, 0.0, 10.0)]
    tags = [("t", 0, 301, "CELL_VALUE"), ("t", 1, 1, "tail"), ("t", 2, 2, "head"), ("t", 3, 304, "ACVALUE_END"), ("t", 4, 1, "outside"), ("t", 5, 301, "CELL_VALUE"), ("t", 6, 304, "ACVALUE_END")]
    assert sorted((x.cell, x.value) for x in entities.cell_texts(spark.createDataFrame(tags, "handle string, pos int, code int, value string")).collect()) == [(0, "headtail"), (1, "")]


def test_whole_run(spark):
    rows = [item(1, "План этажа", 0, 0), item(2, "План этажа", 300, 0), item(3, "123", 0, 50), item(4, "図面の名前", 0, 90, lang="ja")]
    none = spark.createDataFrame([("図面の名前", "Drawing")], "source string, target string")
    run = pipeline.run_all(spark.createDataFrame(rows, ITEM), spark.createDataFrame([], "job_id long, place string, pos double, lo double, hi double"), none)
    table = {x.source: x for x in run.table.collect()}
    assert table["План этажа"].target == "[EN]План этажа[/EN]" and table["図面の名前"].note == "from memory" and all(x.approved for x in table.values())
    plan = [(x.handle, x.action, x.new_text) for x in run.plan.orderBy("handle").collect()]
    assert [p[:2] for p in plan if p[1] == "update"] == [("h1", "update"), ("h2", "update"), ("h4", "update")] and plan[-1][2] == "Drawing"


def test_best_met_against_all_pairs(spark):
    """Equal ends, empty stretches, ties in the order and texts on top of each other, with open and with closed ends."""
    rng = random.Random(5)
    stretch = lambda least: (lo := float(rng.randrange(9)), lo + rng.randrange(least, 6))
    a = [(rng.randrange(2), *stretch(1), float(rng.randrange(5))) for _ in range(150)]
    b = [(rng.randrange(2), *stretch(0), float(rng.randrange(5)), rng.randrange(100)) for _ in range(60)]
    for closed in (False, True):
        for strict in (False, True):
            want = {}
            for k, lo, hi, at in a:
                met = [v for j, l2, h2, t, v in b if j == k and (t < at or (t == at and not strict)) and ((l2 <= hi and h2 >= lo) if closed else (l2 < hi and h2 > lo))]
                if met:
                    want[k, lo, hi, at] = max(met)
            got = spatial.best_met(spark.createDataFrame(a, "k int, lo double, hi double, at double"), spark.createDataFrame(b, "k int, lo double, hi double, at double, value int"), ["k"], closed, strict)
            assert {tuple(r)[:4]: r.best for r in got.collect()} == want


def test_gaps_between_sheets_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(2), n, x := float(rng.randrange(12)), y := float(rng.randrange(12)), x + rng.randrange(4), y + rng.randrange(4)) for n in range(70)]
    got = {r.box: (r.right, r.left, r.above, r.below) for r in spatial.side_gaps(spark.createDataFrame(rows, "job_id int, box long, x0 double, y0 double, x1 double, y1 double")).collect()}
    least = lambda ds: min((d for d in ds if d >= 0), default=None)
    for j, n, x0, y0, x1, y1 in rows:
        o = [r for r in rows if r[0] == j and r[1] != n]
        beside, stacked = [r for r in o if r[3] <= y1 and r[5] >= y0], [r for r in o if r[2] <= x1 and r[4] >= x0]
        assert got[n] == (least(r[2] - x1 for r in beside), least(x0 - r[4] for r in beside), least(r[3] - y1 for r in stacked), least(y0 - r[5] for r in stacked))


def test_sheets_of_a_job_do_not_all_meet_each_other(spark):
    """Every join of the gaps carries a place beside the job, so that it cannot pair up a drawing."""
    boxes = spark.range(50).selectExpr("1 job_id", "id box", "id % 7 * 10.0D x0", "id % 5 * 10.0D y0", "id % 7 * 10.0D + 3 x1", "id % 5 * 10.0D + 3 y1")
    joins = [x for x in spatial.side_gaps(boxes)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and all("lo#" in x or "hi#" in x or "edge#" in x or "box#" in x for x in joins)


def test_edges_of_neighbours_meet_a_row_once(spark):
    """Hundreds of texts on one spot are one edge of their row: what is searched does not grow with their pairs."""
    rows = [item(n, "аа", (n % 3) * 30, 0.0) for n in range(300)]
    got = spatial.neighbours(spark.createDataFrame(rows, ITEM))
    assert "handle <> " not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "NOT (o#" not in plan
    width = 2 * 0.75 * 2.0
    assert {r.handle: (r.gap_r, r.gap_l) for r in got.collect()} == {f"h{n}": (30.0 if n % 3 < 2 and 30 <= max(6 * width, 120) else None, 30.0 if n % 3 else None) for n in range(300)}
