import re

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_act(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mixing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns and docs.count() <= before
            assert docs.where("n_chars <> length(text)").isEmpty() or k == 0
            before = docs.count()
    assert docs.columns == [*columns, "copy"] and docs.count() > 0


def test_contaminated_spans_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    docs = spark.createDataFrame([(1, f"{'plain words here ' * 60}\n{item}", "en", "s", 1), (2, item, "en", "s", 1), (3, "clean text", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.benchmark(spark, docs, SF).collect()}
    assert set(out) == {1, 3} and out[3].text == "clean text"
    assert item[:60] not in out[1].text and out[1].n_chars == len(out[1].text)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["lang_pred", "score", "removed", "class_id", "n_class", "n_words", "n_hit", "clean_text", "copies", "size", "h", "d", "t"]


def awkward(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, ties, a very long text, and columns of clashing names."""
    import random

    r = random.Random(4)
    voc = {"en": "the house of water and stone near long river bank where people walk".split(), "de": "das haus von wasser und stein nahe dem langen fluss wo leute gehen".split()}
    text = lambda l, n: "\n".join(" ".join(r.choice(voc[l]) + r.choice(["", "s", "en", str(r.randint(0, 999))]) for _ in range(12)) for _ in range(n))
    rows = [(i, text(l := r.choice(["en", "de"]), r.randint(2, 6)), l, r.choice(["a", "b", None]), 1) for i in range(60)]
    near = rows[3][1].split(" ")
    near[20] = "changed"
    rows += [(100, rows[3][1], "en", "a", 1), (101, " ".join(near), "en", "b", 1), (102, None, "en", "a", None), (103, "", None, "b", 0), (104, " \n\n ", "de", None, 4), (None, text("de", 3), "de", "a", 1), (None, None, None, None, None)]
    rows += [rows[5], rows[5], (5, text("en", 2), "en", "z", 1), (106, text("en", 4000), "en", "a", 1), (107, "— 12 !?", None, "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHING:
        docs = docs.selectExpr("*", f"concat('own', doc_id) as {c}")
    return docs


def test_stages_take_awkward_rows(spark, tmp_path):
    from collections import Counter

    from pyspark.sql import functions as F

    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = awkward(spark)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        assert docs.columns == (columns if k < 4 else [*columns, "copy"])
        # Columns that the stages do not own come through unchanged.
        own = {x.doc_id: x.score for x in before}
        assert all(x.score == own[x.doc_id] for x in after)
        if name == "language_id":
            assert {x.doc_id for x in before} - {x.doc_id for x in after} == {102, 103, 104, 107}
            assert all(x.text is not None for x in after)
        if name == "line_dedup":
            seen, want = [], {}
            # Rows that repeat an id and a text are one document; of one id, texts have some fixed order.
            key = lambda x: (x.doc_id is not None, x.doc_id or 0)
            pairs = sorted({(key(x), x.text) for x in before})
            tied = {k for k, n in Counter(k for k, _ in pairs).items() if n > 1}
            for at, text in pairs:
                kept = []
                for line in text.split("\n"):
                    s = frozenset(line.split())
                    if not s or not any(5 * len(s & q) >= 4 * len(s | q) for q in seen):
                        kept.append(line)
                    if s:
                        seen.append(s)
                want[at, text] = "\n".join(kept)
            expected = Counter((x.doc_id, want[key(x), x.text]) for x in before if key(x) not in tied and want[key(x), x.text].strip())
            assert Counter((x.doc_id, x.text) for x in after if key(x) not in tied) == expected
        if name == "near_dedup":
            assert len({x.text for x in after}) == len(after)
        if name == "mixing":
            assert {x.copy for x in after} <= {1, 2}
    assert docs.where(F.col("doc_id") == 106).count() >= 1


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
    assert out.columns == [*docs.columns, "copy"]


def shingles(text):
    from collections import Counter

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts):
    """For each text the number of its class: weighted Jaccard of five-word shingles of 0.8 or more links, over all pairs that share one."""
    bags = [shingles(t) for t in texts]
    root, holders = list(range(len(bags))), {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, bag in enumerate(bags):
        met = {j for s in bag for j in holders.get(s, ())}
        for j in met:
            both = sum((bag & bags[j]).values())
            if both >= 0.8 * (bag.total() + bags[j].total() - both):
                root[find(i)] = find(j)
        for s in bag:
            holders.setdefault(s, []).append(i)
    return [find(i) for i in range(len(bags))]


def test_every_stage_against_brute_force_on_its_own_input(spark, tmp_path):
    """The whole table of the smallest size, stage by stage; the line stage is held in the test above and by its SQL."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    windows = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(item.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name == "language_id":
            assert {r.doc_id for r in after} == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
        if name == "near_dedup":
            ids = sorted(before)
            of = dict(zip(ids, classes([before[i].text for i in ids]), strict=True))
            first = {}
            for i in ids:
                first.setdefault(of[i], i)
            assert {r.doc_id for r in after} == set(first.values()) and all(r.text == before[r.doc_id].text for r in after)
        if name == "decontaminate":
            want = {}
            for i, r in before.items():
                w = words(r.text)
                hit = [False] * len(w)
                for size in {len(x) for x in windows}:
                    for k in range(len(w) - size + 1):
                        if tuple(w[k : k + size]) in windows:
                            hit[k : k + size] = [True] * size
                if sum(hit) <= corpus_pipeline.MAX_CONTAMINATED * len(w):
                    want[i] = [x for x, h in zip(w, hit, strict=True) if not h]
            assert {r.doc_id: words(r.text) for r in after} == want
            assert any(len(words(before[i].text)) > len(w) for i, w in want.items())
        if name == "mixing":
            size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in before.items()}
            weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted({r.source for r in before.values()}))}
            held, taken = dict.fromkeys(weight, 0), dict.fromkeys(weight, 0)
            for i, r in before.items():
                held[r.source] += size[i]
            for r in after:
                taken[r.source] += size[r.doc_id]
            open_, left, target = dict(weight), 1.5 * sum(held.values()), {}
            while True:
                share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
                full = [s for s in open_ if share[s] > 2 * held[s]]
                if not full:
                    break
                for s in full:
                    target[s] = 2 * held[s]
                    left -= target[s]
                    del open_[s]
            target |= share
            assert all(abs(taken[s] - target[s]) <= max(0.01 * target[s], max(n for i, n in size.items() if before[i].source == s)) for s in target)
