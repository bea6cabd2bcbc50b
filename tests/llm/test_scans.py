"""Decontamination, personal data, secrets, language and mixing against plain re-implementations of their contracts."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import pytest

from sheetloom.llm import decontaminate, langid, mixing, pii, secrets

BW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_decontamination(spark, limit):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(["Alpha", "beta", "gämma", "d4", "x"]) for _ in range(n))
    items = [(1, text(14)), (2, text(4)), (10, text(10)), (3, ""), (4, None), (5, "Zeta-eta; zeta"), (6, text(14))]
    docs = [(i, f"{text(20)}, {items[i % 7][1] or ''}\n{text(6)}", 5) for i in range(40)] + [(90, "", 0), (91, None, 0), (None, "ZETA eta Zeta", 0), (90, "", 0)]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string, n_hit int"), spark.createDataFrame(items, "item_id long, text string"), keep=["doc_id", "text"], max_bytes=limit).collect()
    assert len(got) == len(docs)
    for row in got:
        w, hit, found = BW.findall(low(row.text)), set(), set()
        for i, t in items:
            v = BW.findall(low(t))
            n = min(10, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(i))
        assert (row.n_words, row.n_hit, row.hit_items) == (len(w), len(hit), sorted(found))
        assert BW.findall(low(row.clean_text)) == [x for k, x in enumerate(w) if k not in hit] or hit
        if not hit:
            assert row.clean_text == row.text


def test_decontamination_digest_and_empty(spark):
    bench = spark.createDataFrame([(2, "a b"), (10, "b c")], "item_id long, text string")
    out = decontaminate.op7(spark.createDataFrame([(1, "A b C", "")], "doc_id long, text string, x string"), bench).collect()[0]
    assert tuple(out) == (1, 3, 3, 2, hashlib.sha256(b"10,2").hexdigest(), True)
    assert decontaminate.op7(spark.createDataFrame([(1, "A b C")], "doc_id long, text string"), bench.limit(0)).collect()[0].contaminated is False
    assert decontaminate.op7(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def test_rules_of_personal_data_match_the_patterns():
    r = random.Random(6)
    for _ in range(3000):
        t = "".join(r.choice("0123456789.+-@ ()ab:_%é\n") for _ in range(r.randint(0, 60)))
        want = sorted((k, *m.span()) for k, (p, ok) in KINDS.items() for m in re.finditer(p, t) if ok(m[0]))
        assert sorted(pii.rule_spans(t)) == want, t
    assert pii.rule_spans("4111 1111 1111 1111") == [("card", 0, 19)]


def test_the_field_adds_and_keeps(spark):
    rows = [(1, "call (743) 555-3824 now", 0), (2, "joe [at] mail [dot] com", 0), (3, "x +1 (523) 555-1055 or 10.0.0.7", 0), (4, "on 2024-01-02 10:11 page 12, 1,000,000 of 12345678", 0), (5, None, 0), (6, "", 0), (6, "", 0), (7, "9" * 100_000, 0)]
    got = {x.doc_id: x for x in pii.op2(spark.createDataFrame(rows, "doc_id long, text string, n_ip int")).collect()}
    assert got[1].spans == "phone:5:19" and got[1].n_phone == 0
    assert got[2].spans == "email:0:23"
    assert got[3].spans == "phone:2:19,ip:23:31" and got[3].n_added == 0
    assert [got[i].spans for i in (4, 5, 6, 7)] == [""] * 4
    masked = pii.detect(spark.createDataFrame(rows, "doc_id long, text string, n_ip int")).where("doc_id = 3").first()
    assert masked.masked == "x <phone> or <ip>"


def test_regions_are_whole():
    w = pii.weights()
    phones = ["555-123-4567", "555-234-5678", "555-345-6789", "555-456-7890", "555-567-8901", "555-678-9012"]
    text = " ".join(phones)
    assert [text[a:b] for k, a, b in pii.field_spans(text, w)] == phones
    assert pii.regions(" ".join(phones * 500)) == [(0, 3000 * 13 - 1)]
    assert pii.field_spans("host 10[.]20[.]30[.]40 is up", w) == [("ip", 5, 22)]
    long = "a" * 60 + " (at) " + "b" * 60 + " (dot) com"
    assert pii.field_spans(f"mail {long} today", w) == [("email", 5, 5 + len(long))]
    assert pii.regions("1 2 3, x@y and a @ b") == []
    assert pii.regions("a@b. cc@d.ee") == [(0, 12)]


def test_weights_are_the_same_on_every_fit():
    assert (pii.weights.__wrapped__() == pii.weights()).all()


def test_rules_of_secrets_match_the_patterns():
    r, ok = random.Random(7), []
    pats = {"assign": r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    for _ in range(3000):
        t = " ".join(r.choice(["Token", "=", "api_key:", "paSSword", "'x'", "deadbeef" * r.randint(1, 5), "AKIA" + "Q7" * r.randint(3, 12), "ſecret=abcdefgh", "abc123+/"]) for _ in range(r.randint(1, 9))).replace(" ", r.choice(["", " "]))
        want = [(k, *m.span()) for k, p in pats.items() for m in re.finditer(p, t) if (len(m[1]) >= 6 if k == "assign" else len(m[0]) >= (20 if k == "access" else 24))]
        assert sorted(s[:3] for s in secrets.rule_spans(t)) == sorted(want), t
        ok += want
    assert {k for k, *_ in ok} == set(pats)


def test_random_tokens_of_any_make_are_candidates():
    r, small = random.Random(9), "abcdefghijklmnopqrstuvwxyz"
    for alphabet, n in ((small + small.upper() + "0123456789", 20), (small + small.upper() + "0123456789", 32), (small + small.upper(), 24), (small, 24), (small + small.upper() + "0123456789+/", 40)):
        tokens = ["".join(r.choice(alphabet) for _ in range(n)) for _ in range(1000)]
        assert sum(bool(secrets.loose_spans(f"x {t} y")) for t in tokens) >= 970, (len(alphabet), n)
    long = "".join(r.choice(small + small.upper() + "0123456789+/") for _ in range(50_000))
    assert secrets.loose_spans(f"k {long}==") == [(2, 50_004, long + "==")]
    words = ["internationalisation", "chpfheitschverheiten", "erlichschereinbelich", "donaudampfschifffahrtsgesellschaft", "the_order_of_the_pages", "src/main/resources/templates", "-" * 40, "0" * 40, "anticonstitutionnellement"]
    assert [w for w in words if secrets.loose_spans(w)] == []


def test_ownership_separates_examples_from_live(spark):
    live, example = "q7Zk29LmXw81RtYv63Bn", "Hs83kdLq02PxWm47ZtRv"
    rows = [(1, f"key {live} here", "a"), (2, f"see {example}", "a"), (3, f"see {example}", "b"), (4, f"token = {live}", None), (5, None, "a"), (6, "", None), (6, "", None)]
    got = {x.doc_id: x for x in secrets.op4(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, n_live int")).collect()}
    assert got[2].n_live == got[3].n_live == 0 and got[2].n_copied == 1
    # The value of document 1 is also assigned under the null owner, so two owners hold it.
    assert got[1].spans == "" and got[4].spans == f"assign:0:{8 + len(live)}"
    alone = secrets.op4(spark.createDataFrame(rows[:3], "doc_id long, text string, source string")).where("doc_id = 1").first()
    assert alone.spans == f"live:4:{4 + len(live)}" and alone.n_owner_specific == 1
    assert secrets.op4(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_ownership_is_a_share_and_repetition_by_one_owner_stays_live(spark):
    one, two, wide = "q7Zk29LmXw81RtYv63Bn", "Hs83kdLq02PxWm47ZtRv", "Pw41xbNs96VcTk28LgQz"
    rows = [(i, f"key {one} here", "o0") for i in range(40)] + [(100, f"same {two} text", "o0"), (101, f"same {two} text", "o1")]
    rows += [(200 + i, f"see {wide}" if i < 5 else "plain", f"o{i}") for i in range(20)]
    got = {x.doc_id: x for x in secrets.op4(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].n_live == 1 for i in range(40))
    assert got[100].n_live == got[101].n_live == 1
    assert all(got[200 + i].n_live == 0 and got[200 + i].n_copied == 1 for i in range(5))


def test_language(spark):
    r = random.Random(2)
    voc = {"aa": "tha sho ren mik dol", "bb": "que été çon leur bien", "cc": "ung der schö mit groß"}
    make = lambda l, n: " ".join(r.choice(voc[l].split()) + r.choice(voc[l].split()) for _ in range(n))
    rows = [(i, make(l := r.choice(list(voc)), 40), l, 0.0) for i in range(240)]
    half = f"{make('aa', 60)} {make('bb', 30)}"
    rows += [(900, half, None, 0.0), (901, None, "aa", 0.0), (902, "12 34 !?", None, 0.0), (903, "", None, 0.0), (904, "— ♥", None, 0.0), (None, make("cc", 9), None, 0.0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {x.doc_id: x for x in langid.op6(docs).collect()}
    truth = {i: l for i, _, l, _ in rows[:240]}
    assert all(got[i].lang_pred == l for i, l in truth.items())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    assert got[900].lang_pred == "aa" and got[900].lang_set.startswith("aa=0.6") and "bb=0.3" in got[900].lang_set
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (901, 902, 903, 904))
    assert got[None].lang_pred == "cc" and all(0 <= x.score <= 1 for x in got.values())
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    assert langid.op6(docs.limit(0)).count() == 0
    assert {x.lang_pred for x in langid.op6(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("lang is null").limit(3)).collect()} <= {"und"}


def levels(sizes, share=1.5, cap=2.0):
    """Water filling: raise all open sources by weight until they reach their caps or the budget is spent."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), share * sum(sizes.values())
    open_ = {s for s in order if sizes[s]}
    while open_ and left > 1e-9:
        step = min(left / sum(w[s] for s in open_), *((cap * sizes[s] - target[s]) / w[s] for s in open_))
        for s in open_:
            target[s] += step * w[s]
            left -= step * w[s]
        open_ = {s for s in open_ if target[s] < cap * sizes[s] - 1e-9}
    return target


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * 3 for _ in range(r.randint(0, 200))), r.choice(["b", "a", "é", "z", "Z", None]), 1) for i in range(900)]
    rows += [(i, "x " * 40, "tiny", 1) for i in range(2000, 2006)] + [(3000, None, "void", 1), (3001, "", None, 1), (None, "a b", "a", 1), rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    got = mixing.op5(docs).collect()
    assert Counter((x.doc_id, x.size) for x in got) == Counter((i, len((t or "").split())) for i, t, _, _ in rows)
    total = Counter()
    for _, t, s, _ in rows:
        total[s] += len((t or "").split())
    want = levels(dict(total))
    source = {i: s for i, _, s, _ in rows}
    took = Counter()
    for x in got:
        s = source[x.doc_id]
        took[s] += x.taken
        assert x.source_size == total[s] and abs(x.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= x.taken <= 2 * x.size and (not x.size or x.taken % x.size == 0)
    assert all(abs(took[s] - t) <= max(0.01 * t, 40) for s, t in want.items())
    again = mixing.op5(docs.repartition(7)).collect()
    assert Counter((x.doc_id, x.taken) for x in again) == Counter((x.doc_id, x.taken) for x in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns[:4], "copy"]
    assert Counter(x.doc_id for x in mixed.collect()) == Counter({k: n for k, n in sum((Counter({x.doc_id: x.taken // x.size}) for x in got if x.size), Counter()).items() if n})
    assert mixing.op5(docs.limit(0)).count() == 0


def test_rates_are_exponential_in_size(spark):
    """The dual's solution: log r is linear in size, and the constraint holds exactly before rounding."""
    import math

    hist = spark.createDataFrame([("s", n, 3) for n in range(1, 60)], "sk string, size long, n long")
    total = sum(3 * n for n in range(1, 60))
    goals = spark.createDataFrame([("s", total, 177, 0.7 * total)], "sk string, source_size long, n_docs long, target double")
    x = mixing.solve(hist, goals).first()
    took = sum(3 * n * min(2, math.exp(x.lam * n * x.scale)) for n in range(1, 60))
    assert abs(took - 0.7 * total) < 1e-6 * total and x.lam < 0


def test_free_spans_equal_the_plain_test_and_stay_linear():
    import time

    from sheetloom.llm.spans import free, masked

    r = random.Random(12)
    make = lambda n, most: [("k", a := r.randint(0, most), a + r.randint(1, 9)) for _ in range(n)]
    for _ in range(300):
        spans, taken = make(r.randint(0, 12), 60), make(r.randint(0, 12), 60)
        assert free(spans, taken) == [s for s in spans if all(s[2] <= a or s[1] >= b for _, a, b in taken)]
    many, began = make(100_000, 10**7), time.time()
    free(many, many)
    assert time.time() - began < 5
    assert masked("ab cd ef", [("x", 0, 2), ("y", 1, 5), ("z", 6, 8)]) == "<x> <z>"


def segmentations(n, segments):
    """Every set of segments without overlap, as lists in order."""
    if n == 0:
        yield []
        return
    yield from segmentations(n - 1, segments)
    for s in segments:
        if s[1] == n:
            yield from ([*x, s] for x in segmentations(s[0], segments))


def test_decoding_finds_the_best_of_all_segmentations():
    w = pii.weights()
    for text in ("call 743 555 3824 or 10.0.0.7", "joe@a.de 555-123-4567", "4111 1111 1111 1111 12", "isbn 978-316-1484"):
        cuts, segments = pii._lattice(text, 0, len(text))
        n = len(cuts) - 1
        score = lambda f: max((float(w[k, f].sum()) for k, ok in enumerate(pii._allowed(f)) if ok), default=-1e9)
        scored = [(i, j, score(f), f) for i, j, f in segments if score(f) > -1e8]
        best = max(sum(s[2] for s in x) for x in segmentations(n, scored))
        got = pii._decode(n, segments, w)
        by = {(i, j): f for i, j, f in segments}
        assert abs(sum(float(w[pii.KINDS.index(k), by[i, j]].sum()) for k, i, j in got) - best) < 1e-9
        assert all(a[2] <= b[1] for a, b in zip(got, got[1:], strict=False))


def test_precision_and_recall_on_windows_that_were_not_trained_on():
    w, right, wrong, missed = pii.weights(), 0, 0, 0
    for text, a, b, kind in pii._training_windows(random.Random(777), 1500):
        got, want = set(pii.field_spans(text, w)), {(kind, a, b)} if kind != "none" else set()
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right >= 0.98 * (right + wrong) and right >= 0.95 * (right + missed)
    assert pii.field_spans("isbn 978-316-1484", w) == [] and pii.field_spans("order 743-555-3824", w) == []


def test_empty_table_of_personal_data(spark):
    assert pii.op2(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mixture_inference_against_plain_em():
    import itertools
    import math

    import numpy as np

    r = np.random.default_rng(6)
    langs, table = 6, np.log(r.dirichlet(np.full(langid.BUCKETS, 0.05) + 1e-6, 6).T + 1e-9).astype(np.float32)
    texts = [" ".join("".join(chr(97 + x) for x in r.integers(0, 26, 5)) for _ in range(n)).encode() for n in (3, 8, 25, 60)]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    got, known = langid.infer(data, offsets, table)
    assert known.all()
    for k, t in enumerate(texts):
        own = np.frombuffer(t, np.uint8)
        buckets, at, _ = langid._trigrams(own, np.array([0, len(own)]))
        words = [m.span() for m in re.finditer(rb"[a-z]+", t)]
        units = [words[i : i + langid.UNIT_WORDS] for i in range(0, len(words), langid.UNIT_WORDS)]
        like = []
        for u in units:
            inside = [b for b, p in zip(buckets, at, strict=True) if u[0][0] <= p < u[-1][1]]
            ll = [langid.TEMPER * sum(float(table[b, j]) for b in inside) for j in range(langs)]
            like.append([math.exp(x - max(ll)) for x in ll])

        def em(share, steps):
            for _ in range(steps):
                resp = [[p * q / sum(a * b for a, b in zip(row, share, strict=True)) for p, q in zip(row, share, strict=True)] for row in like]
                share = [sum(x[j] for x in resp) / len(like) for j in range(langs)]
            return share, sum(math.log(sum(p * q for p, q in zip(row, share, strict=True))) for row in like)

        full, _ = em([1 / langs] * langs, langid.EM_STEPS)
        order = sorted(range(langs), key=lambda j: -full[j])
        most = max(1, sum(s * len(like) >= langid.LEAST_UNITS for s in full))
        tries = []
        for size in range(1, most + 1):
            share, total = em([1 / size if j in order[:size] else 0.0 for j in range(langs)], langid.EM_STEPS if size > 1 else 0)
            tries.append((total - 0.5 * (size - 1) * math.log(len(like)), -size, share))
        want = max(tries)[2]
        assert np.allclose(got[k], want, atol=1e-5), k


def test_more_than_four_languages_can_be_found():
    import numpy as np

    letters = ["ab", "cd", "ef", "gh", "ij", "kl"]
    table = np.full((langid.BUCKETS, 6), -12.0, np.float32)
    r = random.Random(5)
    say = lambda j, n: " ".join("".join(r.choice(letters[j]) for _ in range(5)) for _ in range(n))
    for j in range(6):
        t = np.frombuffer(say(j, 400).encode(), np.uint8)
        table[langid._trigrams(t, np.array([0, len(t)]))[0], j] = -2.0
    text = " ".join(say(j, 40) for j in range(6)).encode()
    share, _ = langid.infer(np.frombuffer(text, np.uint8), np.array([0, len(text)]), table)
    assert (share[0] > 0.1).sum() == 6


def test_window_set_is_small():
    import sys

    text = " ".join(f"word{i}" for i in range(100_000))
    s = decontaminate.WindowSet([("1", text)], 10)
    held = len(s.text) + sum(x.nbytes for part in s.parts.values() for x in part)
    assert held + sys.getsizeof(s.item_ids) < 5 * len(text) + (1 << 20)


def test_ownership_over_a_generated_corpus(spark):
    """Random values in prose, some of one owner (live), some copied by most owners: the whole query against counts in plain Python."""
    r = random.Random(21)
    alphabet = string.ascii_letters + string.digits
    value = lambda: "".join(r.choice(alphabet) for _ in range(r.randint(24, 44)))
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 11)))
    owners = [f"org{k}" for k in range(12)]
    copied, live = [value() for _ in range(20)], [value() for _ in range(150)]
    docs = []
    for k in range(400):
        words = [word() for _ in range(r.randint(3, 60))]
        if k < 240:
            words.insert(r.randrange(len(words)), copied[k % 20])  # every copied value is in the hands of all owners
        if k % 3 == 0:
            words.insert(r.randrange(len(words)), live[k // 3 % 150])
        docs.append((k, " ".join(words), owners[k // 20 % 12 if k < 240 else k % 5]))
    docs += [docs[0], (900, None, "org1"), (901, "", None)]
    holders: dict[str, set] = {}
    found = {}
    for i, text, owner in docs:
        base = secrets.rule_spans(text) if text else []
        spans = [(a, b, v) for a, b, v in (secrets.loose_spans(text) if text else []) if all(b <= s[1] or s[2] <= a for s in base)]
        found[i] = (base, spans)
        for v in [s[3] for s in base] + [v for _, _, v in spans]:
            holders.setdefault(v, set()).add(owner or "")
    everyone = len({o or "" for _, _, o in docs})
    is_copied = lambda v: len(holders[v]) >= 2 and len(holders[v]) > secrets.COPIED_SHARE * everyone
    order = {k: n for n, k in enumerate(secrets.KINDS)}
    want = {}
    for i, (base, spans) in found.items():
        base = [s[:3] for s in base]
        kept = [("live", a, b) for a, b, v in spans if not is_copied(v)]
        told = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(xs), key=lambda s: (s[1], order[s[0]], s[2])))
        want[i] = (hashlib.sha256(told(base).encode()).hexdigest(), told(base + kept), len(kept))
    got = secrets.op4(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert len(got) == len(docs) and {x.doc_id: (x.base_sha256, x.spans, x.n_live) for x in got} == want
    text = {i: t for i, t, _ in docs}
    flagged = {text[x.doc_id][int(a) : int(b)] for x in got for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k == "live"}
    used = {v for v in live if any(v in (t or "") for t in text.values())}
    assert len(flagged & used) >= 0.97 * len(used) and not flagged & set(copied) and len(flagged - used) <= 0.02 * len(flagged)
