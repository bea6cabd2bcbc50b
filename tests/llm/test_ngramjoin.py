"""Linked documents against brute force over all pairs."""

import random
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetloom.llm import ngramjoin as nj


def prose(r, n, vocabulary=3000):
    return " ".join(f"w{r.randint(0, vocabulary)}" for _ in range(n))


def edited(r, text, k):
    w = text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
    return " ".join(w)


def plain(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = []
    for _, text in rows:
        w = [x for x in (text or "").translate(low).replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        held.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(held):
        for j in range(i):
            b = held[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(j)] = find(i)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    return Counter((rows[i][0], len(held[i]), min((x for x in members[find(i)] if x is not None), default=None)) for i in range(len(rows)))


def corpus(seed):
    r = random.Random(seed)
    passage = prose(r, 60)
    base = [prose(r, n) for n in (3, 5, 6, 12, 40, 40, 120, 120, 300, 900)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + 20 * i + k, edited(r, t, k // 2)) for i, t in enumerate(base) for k in range(12)]
    chain = base[6]
    for k in range(10):  # each links with the next, the ends do not
        chain = edited(r, chain, 2)
        rows.append((500 + k, chain))
    rows += [(600 + k, f"{prose(r, 15)} {passage} {prose(r, 15)}") for k in range(12)]
    rows += [(700 + k, " ".join([passage] * 3 + [prose(r, k)])) for k in range(0, 20, 2)]
    rows += [(800, base[4].upper()), (801, base[4].replace(" ", "\n\t")), (802, None), (803, ""), (804, " \r\n"), (805, "two words"), (806, "Two Words"), (None, base[8]), (None, "alone with null"), (3, "again three"), rows[5], (807, "é É ß"), (808, "é é ß")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block", "few"), [(1, nj.BLOCK, nj.FEW), (2, 3, 0)])
def test_components_equal_brute_force(spark, monkeypatch, seed, block, few):
    rows = corpus(seed)
    monkeypatch.setattr(nj, "BLOCK", block)
    monkeypatch.setattr(nj, "_possible", partial(nj._possible, most=few))
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], "doc_id long, text string, node int, token string, n long, label long")
    out = nj.op13(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, out.collect())) == plain(rows)


def test_blocks_of_one_shingle_find_links_across_classes(spark, monkeypatch):
    """Many documents that share one rare shingle: classes that no first point joins are joined by trees over blocks."""
    r = random.Random(3)
    shared = "one two three four five six seven"
    rows = []
    for g in range(30):
        own = prose(r, 30 + g)
        rows += [(10 * g + k, f"{shared} {edited(r, own, k)}") for k in range(3)]
    monkeypatch.setattr(nj, "BLOCK", 5)
    monkeypatch.setattr(nj, "_possible", partial(nj._possible, most=1))
    assert Counter(map(tuple, nj.op13(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == plain(rows)


def test_no_rows_and_only_blanks(spark):
    assert nj.op13(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert sorted(map(tuple, nj.op13(spark.createDataFrame([(2, None), (1, " ")], "doc_id long, text string")).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_a_very_long_text(spark):
    r = random.Random(4)
    long = prose(r, 60_000, 10**6)
    rows = [(2, long), (1, edited(r, long, 300)), (3, prose(r, 60_000, 10**6))]
    assert Counter(map(tuple, nj.op13(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == plain(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 90), st.integers(0, 30))
def test_trees_pass_over_no_link(seed, count, other):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, 400, dtype=np.uint64)
    held = []
    for _ in range(count + other):
        size = int(r.integers(1, 60))
        at = int(r.integers(0, 300))
        held.append(np.unique(np.concatenate([base[at : at + size], r.integers(0, 2**63, int(r.integers(0, 6)), dtype=np.uint64)])))
    n = np.array([len(h) for h in held])
    groups = nj.groups_of(n)
    vectors = [np.bincount((h & np.uint64(g - 1)).astype(np.int64), minlength=g) for h, g in zip(held, groups, strict=True)]
    label = r.integers(0, count + other, count + other)
    left = np.arange(count)
    for one, two in ((left, left), (left, np.arange(count, count + other))):
        if not len(two):
            continue
        found = list(nj.candidates(n, label, vectors, one, two))
        pairs = {tuple(sorted(p)) for p in found}
        assert len(pairs) == len(found)
        want = {(min(p, q), max(p, q)) for p in one for q in two if p != q and label[p] != label[q] and nj.linked(held[p], held[q])}
        assert want <= pairs
        assert all(nj.overlap_bound(vectors[p], vectors[q]) >= len(np.intersect1d(held[p], held[q])) for p, q in found)
