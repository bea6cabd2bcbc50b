"""Clusters without pairs of points: against brute force, on dense places, on odd coordinates."""

import random

import pytest

from sheetloom.operators import cluster, sheets


def _brute(pts, gap, links=()):
    up = {n: n for n, _, _ in pts}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    near = [(a[0], b[0]) for i, a in enumerate(pts) for b in pts[:i] if abs(a[1] - b[1]) <= gap and abs(a[2] - b[2]) <= gap]
    for a, b in [*near, *links]:
        lo, hi = sorted((root(a), root(b)))
        up[hi] = lo
    return {n: root(n) for n, _, _ in pts}


@pytest.mark.parametrize("seed", [1, 3])
def test_clusters_equal_brute_force(spark, seed):
    r = random.Random(seed)
    at = (lambda: r.uniform(-60, 60)) if seed < 3 else (lambda: r.randrange(-30, 30) * 2.0)  # the last: many exactly a gap apart
    pts = [(i, at(), at()) for i in range(500)]
    links = [(3, 400), (7, 9)]
    df = spark.createDataFrame(pts, "node long, px double, py double")
    got = {x.node: x.label for x in cluster.clusters(df, 4.0, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == _brute(pts, 4.0, links)


def test_corners(spark):
    pts = [(1, 0.0, 0.0), (2, 10.0, 10.0), (3, 20.0, 0.0), (4, 30.1, 10.0), (5, 30.1, -10.1), (6, 100.0, 4.0), (7, 104.0, 0.0), (8, 113.0, 13.5), (9, 109.0, 14.5)]
    got = {x.node: x.label for x in cluster.clusters(spark.createDataFrame(pts, "node long, px double, py double"), 10.0).collect()}
    assert got == _brute(pts, 10.0)


def test_a_crowded_place_makes_no_pairs(spark):
    """Pairs would be 800 million."""
    n = 40000
    pts = spark.range(n).selectExpr("id as node", "cast(id % 200 as double) / 100 as px", "cast(id div 200 as double) / 100 as py")
    out = cluster.clusters(pts, 5.0)
    assert [tuple(x) for x in out.groupBy("label").count().collect()] == [(0, n)]


def test_places_that_are_not_finite_stand_alone(spark):
    pts = [(1, float("nan"), 0.0), (2, float("nan"), 0.0), (3, float("inf"), 0.0), (4, 0.0, 0.0), (5, 1.0, 0.0)]
    got = {x.node: x.label for x in cluster.clusters(spark.createDataFrame(pts, "node long, px double, py double"), 2.0).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


@pytest.mark.parametrize(("few", "cuts"), [(250_000, 4), (10, 0), (150, 9)])
def test_components_in_a_task_in_rounds_and_after_cuts(spark, monkeypatch, few, cuts):
    """One task used to be no way at all: a chain took a round for each of its halvings."""
    monkeypatch.setattr(cluster, "FEW", few)
    monkeypatch.setattr(cluster, "CUTS", cuts)
    if few > 10:
        monkeypatch.setattr(cluster, "_in_rounds", None)
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 130), r.randrange(100, 130)) for _ in range(300)] + [(70, 70)]
    names = [f"n{i:03}" for i in range(140)]
    nodes, df = spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a string, b string")
    want = _brute([(i, 1e3 * i, 0.0) for i in range(140)], 1.0, edges)
    assert {x.node: x.label for x in cluster.components(nodes, df).collect()} == {names[a]: names[b] for a, b in want.items()}


def test_boxes_from_cells_are_those_of_points(spark):
    r = random.Random(2)
    rows = [(i % 2, "model", i, r.choice([None, i // 7]), float(r.randrange(80)), float(r.randrange(80))) for i in range(300)]
    df = spark.createDataFrame(rows, "job_id long, place string, node long, entity long, px double, py double")
    got = {tuple(x) for x in cluster.boxes_of_clusters(df, 2.5, 2, ["job_id", "entity"]).select("job_id", "box", "x0", "y0", "x1", "y1", "n").collect()}
    want = set()
    for j in (0, 1):
        of = [x for x in rows if x[0] == j]
        links = [(a[2], b[2]) for a in of for b in of if a[3] is not None and a[3] == b[3] and a[2] < b[2]]
        label = _brute([(x[2], x[4], x[5]) for x in of], 2.5, links)
        for box in set(label.values()):
            m = [x for x in of if label[x[2]] == box]
            if len(m) > 1:
                want.add((j, box, min(x[4] for x in m), min(x[5] for x in m), max(x[4] for x in m), max(x[5] for x in m), len(m)))
    assert got == want


def test_texts_on_one_spot_are_one_row(spark, monkeypatch):
    """Every text used to be sorted in the one window of its job and joined to its cell."""
    seen, real = [], cluster.boxes_of_clusters

    def count(points, *rest):
        seen.append(points.count())
        return real(points, *rest)

    monkeypatch.setattr(cluster, "boxes_of_clusters", count)
    items = spark.range(3000).selectExpr("1L job_id", "concat('h', id) handle", "'model' place", "'TEXT' kind", "2.0D height", "id % 4 * 3.0D + id div 4 % 2 * 900 x", "id % 3 * 4.0D y")
    got = sheets.discovered(items).collect()
    assert seen == [24] and [(x.nth, x.n) for x in got] == [(1, 1500), (2, 1500)]
