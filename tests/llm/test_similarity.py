"""Near duplicates, similar lines and neighbours against brute force."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd

from sheetloom.llm import ann, linededup, neardup


def text(r, n, words=400):
    return " ".join(f"w{r.randint(0, words)}" for _ in range(n))


def edited(r, t, k):
    w = t.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
    return " ".join(w)


def test_near_duplicates(spark):
    r = random.Random(5)
    base = [text(r, 200) for _ in range(12)]
    rows = [(i, t, "clash") for i, t in enumerate(base)]
    rows += [(100 + 10 * i + k, edited(r, t, k), "") for i, t in enumerate(base[:6]) for k in range(1, 9)]
    rows += [(300, base[0], ""), (301, base[0], ""), (302, "", ""), (303, None, ""), (304, " \n", ""), (305, "two words", ""), (306, "two words", ""), rows[3], (307, text(r, 30_000), ""), (None, base[1], "")]
    shingles = {}
    for i, (_, t, _) in enumerate(rows):
        w = (t or "").split()
        if w:
            shingles[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    root = {i: i for i in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in shingles:
        for j in shingles:
            both = sum((shingles[i] & shingles[j]).values())
            if i < j and both >= 0.8 * (sum(shingles[i].values()) + sum(shingles[j].values()) - both):
                root[find(j)] = find(i)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    want = Counter((rows[i][0], min((x for x in members[find(i)] if x is not None), default=None), len(members[find(i)])) for i in range(len(rows)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    assert Counter(map(tuple, neardup.op9(docs).collect())) == want
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter({k[1]: 1 for k in want})


def test_blocks_of_a_band_find_the_same(spark, monkeypatch):
    r = random.Random(8)
    base = text(r, 150)
    rows = [(i, edited(r, base, r.randint(0, 14))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, neardup.op9(docs).collect()))
    monkeypatch.setattr(neardup, "BLOCK", 3)
    assert sorted(map(tuple, neardup.op9(docs).collect())) == whole


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = r.integers(1, 5, 300).astype(float), r.integers(1, 5, 300).astype(float)
    b[:60] = 0.5
    sig = neardup.signatures(2, np.repeat([0, 1], 300), np.concatenate([h, h]), np.concatenate([a, b]), coordinates=2048)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_empty_near_duplicates(spark):
    assert neardup.op9(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def similar_lines(rows):
    """Brute force: a line goes if an earlier one has the same set or Jaccard of 0.8 or more."""
    lines = [(i, k, frozenset(x.split())) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.split()]
    out = defaultdict(list)
    for n, (i, k, s) in enumerate(lines):
        if any(5 * len(s & q) >= 4 * len(s | q) for _, _, q in lines[:n]):
            out[i].append(k)
    return out


def test_lines(spark, monkeypatch):
    r = random.Random(9)
    seed = [text(r, n, 60) for n in (1, 3, 6, 10, 15, 20, 30, 70, 150)]
    rows = [(i, "\n".join(edited(r, r.choice(seed), r.randint(0, 3)) for _ in range(r.randint(1, 6)))) for i in range(60)]
    rows += [(60, ""), (61, None), (62, "\n\n \n"), (63, "same\nsame\n\nsame x"), (64, "\t".join(seed[5].split()))]
    want = similar_lines(rows)
    for heads, hot in ((4, linededup.HOT), (1, 2), (4, 2), (2, 20)):
        monkeypatch.setattr(linededup, "HEADS", heads)
        monkeypatch.setattr(linededup, "HOT", hot)
        docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_removed int")
        got = {x.doc_id: [int(k) for k in x.removed.split(",") if k] for x in linededup.op10(docs).collect()}
        assert got == {i: want.get(i, []) for i, _ in rows}
    kept = {x.doc_id: x.text for x in linededup.without_removed(docs).collect()}
    for i, t in rows:
        lines = [x for k, x in enumerate((t or "").split("\n")) if k not in want.get(i, [])]
        assert kept.get(i) == (t if not want.get(i) else "\n".join(lines) if any(x.split() for x in lines) else None)


def test_lines_shuffled_last_pass_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 1)
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "z")], "doc_id long, text string")
    assert sorted(map(tuple, linededup.op10(docs).select("doc_id", "n_removed").where("doc_id is not null").collect())) == [(1, 0), (1, 0), (2, 1)]
    assert linededup.op10(docs.limit(0)).count() == 0


def test_neighbours_exact_in_one_list(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 1000)
    r = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)], 0) for i in range(300)]
    same = rows[5][1]
    rows += [(1000 + 100 * i, same, 0) for i in range(20)] + [(400, None, 0), (500, [0.0] * 8, 0), (600, [1.0] * 3, 0), (700, [float("nan")] * 8, 0), rows[100]]
    got = ann.op3(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).toPandas()
    v = pd.DataFrame([(i, np.array(x)) for i, x, _ in rows[:320]], columns=["vec_id", "v"])
    want = ann.brute(v, v[v.vec_id % 100 == 0])
    key = ["query_id", "rank", "vec_id"]
    assert got[key].sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()


def test_recall_of_posting_lists(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=16)]) for i in range(6000)]
    got = ann.op3(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    v = pd.DataFrame([(i, np.array(x)) for i, x in rows], columns=["vec_id", "v"])
    want = ann.brute(v, v[v.vec_id % 100 == 0])
    assert len(got) == len(want)
    assert len(want.merge(got, on=["query_id", "vec_id"])) >= 0.9 * len(want)


def test_lists_are_balanced_and_pruning_prunes():
    r = np.random.default_rng(4)
    centres = r.normal(size=(150, 32))
    x = centres[r.integers(0, 150, 20_000)] + 0.2 * r.normal(size=(20_000, 32))
    g = ann.CentroidGraph(x[:8000], 78)
    row, lists = g.posted(x)
    sizes = np.bincount(lists, minlength=78)
    assert set(row) == set(range(len(x))) and len(row) <= 2 * len(x) and sizes.max() <= 4 * sizes.mean()
    asked = r.choice(len(x), 100, replace=False)
    ids, d = g.nearest(ann._lifted(x[asked]), max(ann.BEAM, g.reach))
    found, scored = 0, 0
    for i, q in enumerate(asked):
        inside = set(row[np.isin(lists, ids[i][(ids[i] >= 0) & (d[i] <= d[i, 0] * g.ratio)])]) - {q}
        order = np.argsort(((x - x[q]) ** 2).sum(1))[1:11]
        found, scored = found + len(inside & set(order)), scored + len(inside)
    assert found >= 900 and scored <= 0.1 * len(x) * len(asked)


def test_neighbours_of_few(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in ann.op3(few).collect()] == [(0, 1, 1, 1.0)]
    assert ann.op3(few.limit(0)).count() == 0


def test_one_of_each_with_null_and_repeated_ids(spark):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    a, b, c = words("a", 60), words("b", 60), words("c", 60)
    rows = [(None, a), (None, a), (1, b), (None, b), (2, c), (3, b), (2, b), (4, ""), (None, None)]
    got = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((x.doc_id, x.text) for x in got) == Counter([(None, a), (1, b), (2, c), (4, ""), (None, None)])


def test_lines_of_documents_that_share_an_id_stay_apart(spark):
    """34 bits of these texts' hashes are equal and their ids are null: keys that hold no more would mix their lines."""
    one, two = "p7368 q r\np7368 q r\nlast a7368 one", "s55524 t u\nv55524 w x\ny55524 z k"
    docs = spark.createDataFrame([(None, one), (None, two)], "doc_id long, text string")
    assert sorted((x.n_removed, x.removed) for x in linededup.op10(docs).collect()) == [(0, ""), (1, "1")]
    assert {x.text for x in linededup.without_removed(docs).collect()} == {"p7368 q r\nlast a7368 one", two}


def test_postings_and_pairs_of_lines_carry_one_word_in_the_order_of_keys(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 3)
    rows = [(k % 7 if k % 5 else None, f"alpha{k % 4} beta gamma delta{k % 9} epsilon zeta eta\ntheta{k}\nalpha{k % 4} beta gamma delta{k % 9} epsilon zeta") for k in range(40)]
    j = linededup._Join(spark.createDataFrame(rows, "doc_id long, text string"))
    met = j.met()
    assert met.columns == ["x", "y", "token", "id", "np", "bm", "w0", "w1"]
    found = j.sets.orderBy("d", "h", "t").collect()
    ids = [x.id for x in found]
    assert ids == sorted(set(ids)) and {x.d for x in found} >= {linededup._NO_ID, 1, 6}
    assert met.where("x is not null and y >= x").count() == 0
    assert {x for r in met.collect() for x in (r.x, r.y, r.id)} - {None} <= set(ids)
    assert "prefix" not in j.lines.columns


def test_texts_are_split_and_hashed_once_for_the_ranks_and_sets_of_lines(spark, monkeypatch):
    calls, tables, files = [], [], []
    split, write = linededup._lines, linededup.stash

    def kept(df):
        tables.append(write(df))
        files.append([Path(x.removeprefix("file:")) for x in tables[-1].inputFiles()])
        return tables[-1]

    monkeypatch.setattr(linededup, "_lines", lambda docs: calls.append(1) or split(docs))
    monkeypatch.setattr(linededup, "stash", kept)
    j = linededup._Join(spark.createDataFrame([(k, f"common rare{k} common\n\n common  other{k % 3}") for k in range(20)], "doc_id long, text string"))
    assert len(calls) == 1
    assert tables[0].columns == ["d", "h", "t", "hashes"] and files[0] and not any(x.exists() for x in files[0])
    bucket = spark.sql(f"select xxhash64('common') & {linededup.RANK_BUCKETS - 1}").first()[0]
    assert j.rank[bucket] == 42 and sum(x > 0 for x in j.rank) == 24  # 40 lines have it; 20 and 3 other tokens
    j.met()
    assert tables[-2].columns == ["token"]  # of long lists, counted once for all that reads the lists
