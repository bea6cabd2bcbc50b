"""Nearest things: small places compared at once, large ones by a tree or in rows, both against all pairs."""

import random

import pytest

from sheetloom.operators import spatial
from sheetloom.plans import queries

ITEM = "job_id long, place string, handle string, kind string, height double, x double, y double, plain string, own_w double, rotation double, vertical boolean"
RULE = "job_id long, place string, pos double, lo double, hi double"


def drawing(n=120):
    r = random.Random(4)
    place = lambda: (r.randrange(2), r.choice(["model", "p"]))
    texts = [(*place(), f"h{i}", "TEXT", r.choice([2.0, 2.5, 3.0]), float(r.randrange(60)), float(r.randrange(12)), "a", float(r.randrange(9)), r.choice([0.0, 0.0, 90.0]), r.random() < 0.1) for i in range(n)]
    rules = [(0, r.choice(["model", "p"]), float(r.randrange(70)), lo := float(r.randrange(12)), lo + r.randrange(6)) for _ in range(40)]
    return texts, rules


def least(ds):
    return min(ds, default=None)


@pytest.mark.parametrize("at_once", [4096, 0])
def test_nearest_things_against_all_pairs(spark, monkeypatch, at_once):
    monkeypatch.setattr(spatial, "AT_ONCE", at_once)
    texts, rules = drawing()
    items = spark.createDataFrame(texts, ITEM).selectExpr("*", "1.0D width_factor", "0 halign", "0.0D ax")
    rows = spark.createDataFrame(rules, RULE)
    gaps = {x.handle: (x.gap_r, x.gap_l) for x in spatial.neighbours(items).collect()}
    walls = {x.handle: (x.crosses, x.wall_r, x.wall_l) for x in spatial.wall_gaps(items, rows).collect()}
    below = {x.handle: x.clear for x in spatial.room_below(items, rows).collect()}
    for j, p, n, _, h, x, y, _, own, turn, up in texts:
        w = max(own, h)
        reach, flat = max(6 * w, 60 * h), turn == 0 and not up
        beside = [t for t in texts if t[:2] == (j, p) and t[2] != n and t[9] == 0 and abs(t[6] - y) <= 3 * h and abs(t[6] - y) < 0.7 * max(h, t[4])]
        right = least(d for t in beside if 0.5 * h <= (d := t[5] - x) <= reach)
        left = least(d for t in beside if 0.5 * h <= (d := x + w - (t[5] + max(t[8], t[4]))) <= reach)
        assert gaps.get(n, (None, None)) == ((right, left) if flat else (None, None))
        met = [r for r in rules if r[:2] == (j, p) and r[3] <= y + 1.2 * h and r[4] >= y - 0.2 * h] if flat else []
        crosses = any(x + 0.3 * h <= r[2] < x + w - 0.3 * h for r in met)
        wall = [least(d for r in met if r[2] >= x + w - 0.3 * h and (d := r[2] - x) <= reach), least(d for r in met if r[2] < x + 0.3 * h and (d := x + w - r[2]) <= reach)]
        assert walls.get(n) is None if not met else walls[n][0] == crosses and (crosses or walls[n][1:] == tuple(wall))
        under = [y - (t[6] + t[4]) for t in texts if t[:2] == (j, p) and t[2] != n and t[6] < y - 1e-9 and t[5] < x + own and t[5] + t[8] > x]
        under += [y - r[2] for r in rules if r[:2] == (j, p) and r[2] < y - 1e-9 and r[3] < x + own and r[4] > x]
        assert below.get(n) == (max(min(under), 0.0) if under and flat and own > 0 else None)


def test_small_places_are_not_multiplied(spark, monkeypatch):
    """Every text used to become a row a level of a tree, even where no rule is."""
    def tree(*_):
        raise AssertionError("rows are multiplied")

    monkeypatch.setattr(spatial, "_met_by_tree", tree)
    texts, rules = drawing()
    items, rows = spark.createDataFrame(texts, ITEM), spark.createDataFrame(rules, RULE)
    widths = spatial.available_widths(items, rows)
    assert widths.count() and spatial.room_below(items, rows).count()
    assert {x.job_id for x in spatial.wall_gaps(items, rows).collect()} == {0}


def test_groups_go_on_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        items = spark.range(40).selectExpr("id div 20 job_id", "'m' place", "concat('h', id) handle", "'TEXT' kind", "2.0D height", "id % 20 * 10.0D x", "0.0D y", "'a' plain", "2.0D own_w")
        got = {x.handle: (x.gap_r, x.gap_l) for x in spatial.neighbours(items).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {f"h{i}": (10.0 if i % 20 < 19 else None, 10.0 if i % 20 else None) for i in range(40)}


def test_capacity_moves_widths_and_no_texts(spark):
    plan = queries.queries()["capacity_single"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "em#" in plan and "plain#" not in plan and "text#" not in plan
