"""Drawings carried through, read from tag streams and expanded; sheets, stages under concurrent writers, streams that stop, ordered outputs."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from sheetloom import schema
from sheetloom.operators import apply, jobs, outputs, sheets
from sheetloom.plans import pipeline
from sheetloom.sources import blocks, entities, stages, tagstream
from sheetloom.streaming import spend

ENTITY = "job_id long, space string, ord long, type string, handle string, layer string, style string, text string, flags int, height double, x double, y double, attribs array<struct<tag:string,text:string>>, cells array<string>, vertices array<struct<x:double,y:double>>, closed boolean"


#: A remembered answer that needs more than one line.
LONG = ("слишком длинный текст для такой узкой ячейки", "an answer of many words that no narrow cell can hold on one line, " * 2)


def entity(job, space, ord_, type_, handle, text=None, x=0.0, y=0.0, height=2.0, attribs=None, cells=None, vertices=None, closed=False):
    return (job, space, ord_, type_, handle, "l", "st", text, 2, height, x, y, attribs, cells, vertices, closed)


def drawing(spark, jobs_=(1, 2)):
    rows = []
    for j in jobs_:
        rows += [
            entity(j, "model", 1, "TEXT", "a", "первая строка текста,", 0.0, 20.0), entity(j, "model", 2, "TEXT", "b", "вторая строка текста", 0.0, 16.0), entity(j, "model", 3, "MTEXT", "c", r"{\fArial|b0;отдельно}", 300.0, 16.0),
            entity(j, "model", 4, "INSERT", "d", attribs=[("T", "план"), ("U", "7")], x=600.0), entity(j, "model", 5, "ACAD_TABLE", "e", cells=["", "этаж"], x=900.0), entity(j, "model", 6, "DIMENSION", "f", "<> шт", x=1200.0),
            entity(j, "model", 7, "LINE", "g", vertices=[(0.0, 0.0), (0.0, 9.0)]), entity(j, "block:k", 8, "TEXT", "h", "слишком длинный текст для такой узкой ячейки", 0.0, 50.0), entity(j, "block:k", 9, "LINE", "i", vertices=[(30.0, 0.0), (30.0, 99.0)]), entity(j, "block:k", 10, "LINE", "u", vertices=[(0.0, 0.0), (90.0, 0.0)]),
        ]
    return spark.createDataFrame(rows, ENTITY)


def test_a_drawing_is_written_and_verified(spark):
    e = drawing(spark)
    done = pipeline.run_drawing(e, spark.createDataFrame([LONG], "source string, target string"))
    after = {(r.job_id, r.handle): r for r in done.after.collect()}
    for j in (1, 2):
        assert " ".join(after[j, h].text for h in "ab").split() == "[EN]первая строка текста, вторая строка текста[/EN]".split()
        # The codes of rich text come back around the answer, fonts pointed anew.
        assert after[j, "c"].text.endswith(r"{\fNoto|b0;[EN]отдельно[/EN]}") or after[j, "c"].text == r"[EN]{\fNoto|b0;отдельно}[/EN]"
        assert [tuple(a) for a in after[j, "d"].attribs] == [("T", "[EN]план[/EN]"), ("U", "7")] and after[j, "e"].cells == ["", "[EN]этаж[/EN]"]
        assert after[j, "f"].text == "<>[EN] шт[/EN]" and after[j, "g"].text is None
        lines = sorted((r for k, r in after.items() if k[0] == j and k[1].startswith("h")), key=lambda r: r.added)
        assert [r.added for r in lines] == list(range(len(lines))) and len(lines) > 1 and all(r.y == 50.0 - 1.45 * 2.0 * r.added for r in lines)
    assert done.conflicts.count() == 0 and {(r.job_id, r.ok) for r in done.verdicts.collect()} == {(1, True), (2, True)}
    moved = done.after.withColumn("x", F.when((F.col("handle") == "d") & (F.col("job_id") == 2), 601.0).otherwise(F.col("x")))
    assert {r.job_id: r.problems for r in apply.verified(e, moved).collect()} == {1: [], 2: ["geometry changed"]}
    gone = done.after.where("job_id = 1")
    assert {r.job_id: r.ok for r in apply.verified(e, gone).collect()} == {1: True, 2: False}


def test_writes_that_are_not_in_force_come_back(spark):
    e = drawing(spark, (1,))
    rows = [
        (1, "a", "TEXT", 1, "update", "one", 0.5, None, None, None), (1, "a", "TEXT", 2, "update", "two", None, None, None, None), (1, "zz", "TEXT", 3, "update", "x", None, None, None, None), (1, "g", "LINE", 4, "update", "x", None, None, None, None),
        (1, "d:T", "ATTRIB", 5, "update", "t", None, None, None, None), (1, "d:X", "ATTRIB", 6, "update", "t", None, None, None, None), (1, "e:1", "TABLE_CELL", 7, "update", "c", None, None, None, None), (1, "e:9", "TABLE_CELL", 8, "update", "c", None, None, None, None),
        (1, "b", "TEXT", 9, "skip", "no", None, None, None, None), (1, "b", "TEXT", 10, "insert", "below", 0.8, None, 1, 7.0), (2, "a", "TEXT", 11, "update", "other job", None, None, None, None), (1, "c", "MTEXT", 12, "update", None, None, None, None, None),
    ]
    plan = spark.createDataFrame(rows, "job_id long, handle string, kind string, seq long, action string, text string, width double, box double, below int, y double")
    after, conflicts = apply.applied(e, plan)
    assert sorted((r.handle, r.seq, r.reason) for r in conflicts.collect()) == [("a", 1, "written over"), ("a", 11, "no such entity"), ("d:X", 6, "no such entity"), ("e:9", 8, "no such entity"), ("g", 4, "takes no text"), ("zz", 3, "no such entity")]
    got = {r.handle: r for r in after.collect()}
    assert got["a"].text == "two" and got["b"].text == "вторая строка текста" and got["c"].text == r"{\fArial|b0;отдельно}" and got["e"].cells == ["", "c"] and got["d"].attribs[0].text == "t"
    assert (got["b+1"].text, got["b+1"].y, got["b+1"].width_factor, got["b+1"].added) == ("below", 7.0, 0.8, 1)
    empty = apply.applied(e.limit(0), plan)
    assert empty[0].count() == 0 and empty[1].count() == 10
    assert apply.applied(e, plan.limit(0))[0].count() == e.count()


def test_floors_take_the_room_below(spark):
    e = spark.createDataFrame([entity(1, "model", 1, "TEXT", "a", "слишком длинный текст для такой узкой ячейки", 0.0, 50.0), entity(1, "model", 2, "LINE", "w", vertices=[(30.0, 0.0), (30.0, 99.0)])], ENTITY)
    floor = spark.createDataFrame([entity(1, "model", 3, "LINE", "f", vertices=[(-5.0, 49.5), (60.0, 49.5)])], ENTITY)
    ground = spark.createDataFrame([entity(1, "model", 4, "LINE", "u", vertices=[(-5.0, 0.0), (60.0, 0.0)])], ENTITY)
    none = spark.createDataFrame([LONG], "source string, target string")
    inserted = lambda d: pipeline.run_drawing(d, none).after.where("added > 0").count()
    assert inserted(e.union(ground)) > 0 and inserted(e.union(floor)) == 0


def test_entities_that_cannot_be_read_are_one_row(spark):
    rows = [
        entity(1, "model", 1, "TEXT", "a", "план", height=None), entity(1, "model", 2, "TEXT", "b", "этаж"), entity(1, "model", 3, "MTEXT", "c", "дом", x=float("nan")), entity(1, "model", 4, "ACAD_TABLE", "d", cells=["x", None]),
        entity(1, "model", 5, "LINE", "e", vertices=[(0.0, 0.0)]), entity(1, "model", 6, "INSERT", "f", attribs=[(None, "t")]), entity(1, "block:*Model_Space", 7, "TEXT", None, "x"), entity(1, "model", 8, "TEXT", None, None),
    ]
    e = spark.createDataFrame(rows, ENTITY)
    got = sorted((r.ord, r.kind, r.handle, r.plain, r.lang) for r in entities.items(e, tolerant=True).collect())
    assert got == [
        (1, "TEXT", "a", "[unreadable: height is not a number]", "none"), (2, "TEXT", "b", "этаж", "ru"), (3, "MTEXT", "c", "[unreadable: place is not a number]", "none"), (4, "ACAD_TABLE", "d", "[unreadable: cell without value]", "none"),
        (5, "LINE", "e", "[unreadable: too few vertices]", "none"), (6, "INSERT", "f", "[unreadable: attribute without tag]", "none"), (8, "TEXT", "?", "[unreadable: no handle]", "none"),
    ]
    assert {r.handle for r in entities.items(e).where("handle is not null").collect()} >= {"a", "b", "c"}
    carried = entities.items(e.withColumn("box_width", F.lit(9.0))).where("handle = 'b'").first()
    assert carried.box_width == 9.0 and carried.width_factor == 1.0


def test_references_compose_end_at_cycles_and_levels(spark):
    cols = ENTITY + ", block string, xscale double, yscale double, rotation double"
    ref = lambda space, ord_, to, x, y, s=1.0, turn=0.0: (*entity(1, space, ord_, "INSERT", f"r{ord_}", x=x, y=y), to, s, s, turn)
    line = lambda space, ord_: (*entity(1, space, ord_, "LINE", f"l{ord_}", vertices=[(1.0, 0.0), (1.0, 4.0)]), None, None, None, None)
    rows = [ref("model", 1, "p", 10.0, 0.0), ref("block:p", 2, "q", 0.0, 100.0, 2.0, 90.0), ref("block:q", 3, "p", 5.0, 5.0), ref("block:q", 4, "z", 0.0, 0.0), line("block:p", 5), line("block:q", 6), line("block:z", 7), ref("model", 8, "absent", 0.0, 0.0)]
    e = spark.createDataFrame(rows, cols)
    up = sorted((r.place, r.pos, r.lo, r.hi) for r in entities.rule_lines(e).collect())
    assert up == [("block:p", 1.0, 0.0, 4.0), ("block:q", 1.0, 0.0, 4.0), ("block:q", 1.0, 0.0, 4.0), ("block:q", 6.0, 5.0, 9.0), ("block:z", 1.0, 0.0, 4.0), ("model", 11.0, 0.0, 4.0)]
    # Turned by a right angle and twice as large, a line of q lies level: (1, 0)-(1, 4) becomes (0, 2)-(-8, 2) before the shifts.
    flat = sorted((r.place, r.pos, r.lo, r.hi) for r in entities.rule_lines(e, vertical=False).collect())
    assert flat == [("block:p", 102.0, -8.0, 0.0), ("block:p", 102.0, -8.0, 0.0), ("model", 102.0, 2.0, 10.0)]
    ways = lambda n: sorted("/".join(r.way) for r in blocks.placements(e, levels=n).where("place = 'model'").collect())
    assert ways(1) == ["absent", "p"] and ways(2) == ["absent", "p", "p/q"] and ways(9) == ["absent", "p", "p/q", "p/q/z"]
    base = spark.createDataFrame([(1, "p", 1.0, 2.0)], "job_id long, name string, bx double, by double")
    assert [(r.e, r.f) for r in blocks.placements(e, base, 1).where("place = 'model' and name = 'p'").collect()] == [(9.0, -2.0)]


def test_a_scan_stops_at_an_entity(spark):
    box = [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)]
    e = spark.createDataFrame([entity(1, "model", k, "LWPOLYLINE", f"p{k}", vertices=box, closed=True) for k in range(5)], ENTITY)
    assert entities.rule_lines(e, limit=3).count() == 4 and entities.rule_lines(e, limit=4).count() == 4 and entities.rule_lines(e, limit=5).count() == 6


def test_a_space_keeps_all_of_its_rules(spark):
    """A space used to lose what came after 400,000 rules."""
    line = spark.createDataFrame([entity(1, "model", 0, "LINE", "l", vertices=[(1.0, 0.0), (1.0, 4.0)])], ENTITY)
    n = 400_100
    assert entities.rule_lines(spark.range(n).select(F.col("id").alias("ord")).crossJoin(line.drop("ord"))).count() == n


TAGS = """  0\nSECTION\n  2\nENTITIES\n  0\nTEXT\n  5\nA1\n  8\nl\n 40\n2.5\n 10\n1.5\n 20\n-2\n  1\n0\n  0\nTEXT\n  5\n0\n  1\nLINE\n 40\nhigh\n  0\nLWPOLYLINE\n  5\nP\n 70\n1\n 10\n0\n 20\n0\n 10\n5\n 20\n0\n  0\nLINE\n  5\nL\n 10\n1\n 20\n2\n 11\n3\n 21\n4
  0\nMTEXT\n  5\nM\n  3\nфи\n  1\nло^Jx\nbroken\n  0\nACAD_TABLE\n  5\nT\n301\nCELL_VALUE\n  1\ntail\n  2\nhead \n304\nACVALUE_END\n301\nCELL_VALUE\n304\nACVALUE_END\n  0\nINSERT\n  5\nI\n  2\nblk\n 41\n2\n 50\n90\n  0\nENDSEC\n  0\nEOF\n"""


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_splits_of_any_size_give_the_same_records(tmp_path, ending):
    path = tmp_path / "a.dxf"
    path.write_bytes(TAGS.replace("\n", ending).encode())
    whole = [(r.offset, r.type, r.tags) for r in tagstream.records(str(path), 0, path.stat().st_size)]
    assert [t for _, t, _ in whole] == ["SECTION", "TEXT", "TEXT", "LWPOLYLINE", "LINE", "MTEXT", "ACAD_TABLE", "INSERT", "ENDSEC", "EOF"]
    size = path.stat().st_size
    for step in (1, 2, 3, 7, 50, 1000):
        parts = [(r.offset, r.type, r.tags) for a in range(0, size, step) for r in tagstream.records(str(path), a, min(a + step, size))]
        assert parts == whole


def test_small_splits_of_large_inputs_share_tasks(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.dxf").write_text(TAGS * 20)
    path = str(tmp_path)
    reader = tagstream.TagReader(None, {"path": path, "splitbytes": "5", "maxtasks": "12"})
    parts = reader.partitions()
    assert len(parts) <= 12 + 3 and sum(p.end - p.start for p in parts) == sum(f.stat().st_size for f in tmp_path.iterdir())
    whole = sorted(tuple(r) for r in tagstream.read_tags(spark, path, schema="file string, ord long, type string").collect())
    assert sorted((p.path, r.offset, r.type) for p in parts for r in tagstream.records(p.path, p.start, p.end)) == whole
    assert tagstream.read_tags(spark, path, split_bytes=5).rdd.getNumPartitions() <= tagstream.MAX_TASKS + 3


def test_tag_streams_as_a_data_source(spark, tmp_path):
    (tmp_path / "job_id=4").mkdir()
    (tmp_path / "job_id=4" / "a.dxf").write_text(TAGS)
    (tmp_path / "job_id=4" / "empty.dxf").write_text("")
    path = str(tmp_path)
    got = {r.handle: r for r in tagstream.read_tags(spark, path, split_bytes=64).collect()}
    assert (got["A1"].text, got["A1"].height, got["A1"].x, got["A1"].y, got["A1"]._corrupt_record) == ("0", 2.5, 1.5, -2.0, None)
    assert got["0"].height is None and "high" in got["0"]._corrupt_record and got["M"].text == "фило\nx" and got["M"]._corrupt_record is not None
    assert got["P"].closed and [tuple(v) for v in got["P"].vertices] == [(0.0, 0.0), (5.0, 0.0)] and [tuple(v) for v in got["L"].vertices] == [(1.0, 2.0), (3.0, 4.0)]
    assert got["T"].cells == ["head tail", ""] and (got["I"].block, got["I"].xscale, got["I"].rotation) == ("blk", 2.0, 90.0)
    assert [tuple(r)[1:] for r in tagstream.error_count(tagstream.read_tags(spark, path)).collect()] == [(10, 2)]
    assert tagstream.read_tags(spark, path, mode="DROPMALFORMED").count() == 8
    with pytest.raises(Exception, match="malformed record"):
        tagstream.read_tags(spark, path, mode="FAILFAST").collect()
    pruned = tagstream.read_tags(spark, path, schema="handle string, layer string", only={"type": ["TEXT", "LINE"], "handle": ["A1", "L"]})
    assert sorted(tuple(r) for r in pruned.collect()) == [("A1", "l"), ("L", None)]
    with pytest.raises(Exception, match="cannot be confined"):
        tagstream.read_tags(spark, path, only={"height": ["1"]}).collect()
    both = tagstream.read_tags(spark, path)
    assert both.where("type = 'TEXT'").count() == 2 and both.count() == 10
    e = tagstream.entities(both)
    assert {r.job_id for r in e.collect()} == {4} and {r.handle for r in e.where("bad is not null").collect()} == {"0", "M"}


def test_drawings_written_as_tags_come_back(spark, tmp_path):
    e = drawing(spark)
    tagstream.write_tags(e, str(tmp_path / "out"))
    back = tagstream.entities(tagstream.read_tags(spark, str(tmp_path / "out"), split_bytes=100))
    keep = lambda df: sorted((r.job_id, r.space, r.type, r.handle, r.text, str(r.attribs), str(r.cells), str(r.vertices)) for r in df.select("job_id", "space", "type", "handle", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("attribs", F.array().cast("array<struct<tag:string,text:string>>")).alias("attribs"), F.coalesce("cells", F.array().cast("array<string>")).alias("cells"), F.coalesce("vertices", F.array().cast("array<struct<x:double,y:double>>")).alias("vertices")).collect())
    assert keep(back) == keep(e) and back.where("bad is not null").count() == 0


def test_rows_of_glyphs_stream_over_batches(spark):
    """Spans fold one after the other whatever the batches are, without a call a span."""
    rng = random.Random(3)
    rows = [(s, o, rng.choice([0.0, 1.0, 2.0, 4.0]), rng.uniform(0, 30), 5.0) for s in range(40) for o in range(rng.choice([1, 2, 9]))]
    want = {}
    for s in range(40):
        row, first, last = -1, None, None
        for _, o, y, x, size in (r for r in rows if r[0] == s):
            if first is None or abs(y - first) > 0.3 * size or x < last - 0.5 * size:
                row, first = row + 1, y
            last = x
            want[s, o] = row
    rng.shuffle(rows)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = entities.glyph_rows(spark.createDataFrame(rows, "span long, ord long, y double, x double, size double"))
        assert {(r.span, r.ord): r.row for r in found.collect()} == want
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def plain_window(box, texts):
    x0, y0, x1, y1 = box
    for x, y, h in texts:
        if x0 <= x <= x1 and y0 <= y <= y1:
            y0, y1 = min(y0, y - h * 0.25), max(y1, y + h * 1.25)
    return x0, y0, x1, y1


def test_frames_stretch_in_the_order_of_the_scan(spark):
    r = random.Random(7)
    texts = [(r.uniform(0, 30), r.uniform(-40, 60), r.choice([1.0, 4.0, 12.0])) for _ in range(300)]
    items = spark.createDataFrame([(1, k, f"h{k}", "TEXT", "model", x, y, h) for k, (x, y, h) in enumerate(texts)], "job_id long, ord long, handle string, kind string, place string, x double, y double, height double")
    boxes = [(k, r.uniform(0, 20), r.uniform(-30, 40)) for k in range(12)]
    frames = spark.createDataFrame([(1, k, "", x, y, x + 8, y + 5) for k, x, y in boxes], "job_id long, box long, name string, x0 double, y0 double, x1 double, y1 double")
    pad = 0.02 * 8
    want = sorted(plain_window((x - pad, y - pad, x + 8 + pad, y + 5 + pad), texts) for _, x, y in boxes)
    got = sorted((w.x0, w.y0, w.x1, w.y1) for w in sheets.framed(frames, items).collect())
    assert all(abs(a - b) < 1e-9 for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True))


def test_a_sheet_alone_and_no_sheet(spark):
    t = [(1, k, f"h{k}", "TEXT", "model", 10.0 * (k % 5), 0.0, 2.0) for k in range(10)] + [(2, 1, "h", "TEXT", "model", 0.0, 0.0, 2.0)] + [(3, k, f"h{k}", "TEXT", "model", 1e6 * k, 0.0, 2.0) for k in range(4)]
    items = spark.createDataFrame(t, "job_id long, ord long, handle string, kind string, place string, x double, y double, height double")
    got = sheets.discovered(items).collect()
    assert [(s.job_id, s.nth, s.n) for s in got] == [(1, 1, 10)]
    room = 0.12 * 40 + 30 * 2
    height = (40 + 2 * room) / 1.6
    s = got[0]
    assert (s.x0, s.x1) == (-room, 40 + room) and abs((s.y1 - s.y0) - max(2 * room, height)) < 1e-9


def test_eight_writers_lose_no_update(spark, tmp_path):
    path, like = str(tmp_path / "stage"), "id string, n int"
    kind = spark.createDataFrame([], like).schema
    numbers, failed = [], []

    def work(k):
        try:
            for step in range(2):
                numbers.append(stages.update_stage(spark, path, kind, lambda held, k=k, step=step: held.union(spark.createDataFrame([(f"{k}-{step}", k)], kind)), tries=200))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and sorted(numbers) == list(range(1, 17))
    assert sorted(r.id for r in stages.read_stage(spark, path, kind).collect()) == sorted(f"{k}-{step}" for k in range(8) for step in range(2))


def test_a_late_or_killed_writer_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "stage")
    kind = spark.createDataFrame([], "id string").schema
    one = spark.createDataFrame([("a",)], kind)
    assert stages.write_stage(one, path) == 1
    with pytest.raises(stages.StageConflict):
        stages.commit_stage(spark.createDataFrame([("late",)], kind), path, 0)
    stages._write_rows(spark.createDataFrame([("killed before its entry",)], kind), path)
    assert not stages._entered(spark, path, 1, {"rows": "v-other"})
    assert [r.id for r in stages.read_stage(spark, path, kind).collect()] == ["a"] and stages.current(spark, path)[0] == 1
    with pytest.raises(Exception, match="no version"):
        stages.read_stage(spark, str(tmp_path / "none"), kind)


def test_created_jobs_have_ids_of_their_own(spark, tmp_path):
    path = str(tmp_path / "jobs")
    for rows in ([("", " ")], [("acme", "x"), (None, None)]):
        new = spark.createDataFrame(rows, "client string, project string")
        stages.update_stage(spark, path, schema.JOB, lambda held, new=new: jobs.created(held, new, F.lit("20240101-1200")))
    got = {(r.id, r.client, r.project, r.status) for r in stages.read_stage(spark, path, schema.JOB).collect()}
    assert got == {("20240101-1200", "Unfiled", "General", "new"), ("20240101-1200-001", "Unfiled", "General", "new"), ("20240101-1200-002", "acme", "x", "new")}


def test_a_stream_that_stops_and_resumes_counts_each_row_once(spark, tmp_path):
    like = "event_id long, job_id long, at timestamp, model string, input long, output long"
    pricing = spark.createDataFrame([("m", 2.0, 4.0), ("default", 1.0, 1.0)], "model string, p_in double, p_out double")
    folder, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")

    def arrive(n, rows):
        spark.createDataFrame(rows, "event_id long, job_id long, at string, model string, input long, output long").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{folder}/{n}")

    def run():
        spend.start_daily(spend.file_stream(spark, folder, spark.createDataFrame([], like).schema, files_a_batch=1), pricing, out, check, late="2 days").awaitTermination()
        return {str(r.day)[:10]: (round(r.usd * 1e6), r.n) for r in spend.daily_totals(spark, out).collect()}

    arrive(1, [(1, 1, "2024-01-01 10:00:00", "m", 10, 10), (2, 1, "2024-01-02 10:00:00", "m", 1, 0)])
    assert run() == {"2024-01-01": (60, 1), "2024-01-02": (2, 1)}
    arrive(2, [(3, 2, "2024-01-01 23:00:00", "x", 5, 5), (4, 2, "2024-01-09 01:00:00", "m", 0, 1)])  # late, but not too late
    assert run() == {"2024-01-01": (70, 2), "2024-01-02": (2, 1), "2024-01-09": (4, 1)}
    assert run() == run() == {"2024-01-01": (70, 2), "2024-01-02": (2, 1), "2024-01-09": (4, 1)}  # nothing new: nothing counts twice
    arrive(3, [(5, 1, "2024-01-02 11:00:00", "m", 100, 0), (6, 1, "2024-01-08 11:00:00", "m", 3, 0)])  # the first is behind the watermark
    assert run() == {"2024-01-01": (70, 2), "2024-01-02": (2, 1), "2024-01-08": (6, 1), "2024-01-09": (4, 1)}
    # A batch that is run again replaces its own output.
    spark.read.parquet(f"{out}/batch=1").count()
    batch = spend.daily_spend(spark.read.parquet(f"{folder}/1", f"{folder}/2"), pricing)
    assert {str(r.day)[:10]: (round(r.usd * 1e6), r.n) for r in batch.collect()} == {"2024-01-01": (70, 2), "2024-01-02": (2, 1), "2024-01-09": (4, 1)}


def test_positions_and_files_follow_the_keys(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randint(0, 50), k) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = outputs.positioned(df, ["a", "b"], 4).orderBy("position").collect()
    assert [(x.a, x.b) for x in got] == sorted(rows) and [x.position for x in got] == list(range(500))
    outputs.write_sorted(df, str(tmp_path / "o"), ["a", "b"], 4)
    files = outputs.file_order(spark.read.parquet(str(tmp_path / "o")), ["a", "b"]).collect()
    assert len(files) > 1 and all(x.sorted and x.follows for x in files) and sum(x.n for x in files) == 500
    df.write.parquet(str(tmp_path / "p"))
    assert not all(x.sorted and x.follows for x in outputs.file_order(spark.read.parquet(str(tmp_path / "p")), ["a", "b"]).collect())
    assert outputs.positioned(df.limit(0), ["a"]).count() == 0


def test_spans_without_a_line_open_one(spark):
    box = "page long, span long, x0 double, y0 double, x1 double, y1 double, dir string"
    spans = spark.createDataFrame([(1, 1, 0.0, 0.0, 4.0, 4.0, "h"), (1, 2, 50.0, 0.0, 60.0, 4.0, "h"), (1, 3, 55.0, 1.0, 58.0, 3.0, "h"), (1, 4, 55.0, 1.0, 58.0, 3.0, "v"), (1, 5, 56.0, 1.0, 57.0, 3.0, "v"), (2, 1, 0.0, 0.0, 1.0, 1.0, "h")], box)
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 4.0, "h"), (1, 1, 0.0, 0.0, 9.0, 4.0, "h")], "page long, line int, x0 double, y0 double, x1 double, y1 double, dir string")
    got = {(r.page, r.span): r.line for r in entities.home_lines(spans, lines).collect()}
    assert got == {(1, 1): 0, (1, 2): 2, (1, 3): 2, (1, 4): 3, (1, 5): 3, (2, 1): 0}


def test_frames_at_one_place_meet_texts_once(spark):
    """2,000 frames at one place and 20,000 texts are 40 million pairs if each frame meets its texts."""
    frames = spark.range(2000).selectExpr("1L as job_id", "id as box", "'' as name", "0D as x0", "0D as y0", "10D as x1", "10D as y1")
    items = spark.range(20000).selectExpr("1L as job_id", "id as ord", "'model' as place", "'TEXT' as kind", "1D as height", "5D as x", "cast(9 + id % 40 as double) as y")
    out = sheets.framed(frames, items).select("y1").distinct().collect()
    assert len(out) == 1 and out[0].y1 > 48
