"""Suffix and phrase dedup against brute force over every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sheetloom.llm import phrasededup, repeats, suffixdedup

SCHEMA = "doc_id long, text string, n_bytes string, kept string"


def corpus(seed: int) -> list[tuple]:
    """Noise, shared passages, exact and near copies, repeats inside a document, nulls, repeated rows, non-ASCII."""
    r = random.Random(seed)
    noise = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(n))
    passage, long = noise(90), noise(260)
    near = long.split()
    near[120] = "changed"
    texts = [noise(50), noise(200), f"{noise(30)} {passage} {noise(40)}", f"{passage} {noise(10)}", long, long, " ".join(near), f"{passage} x {passage}", "", None, " \n ", "x" * 1500, noise(3), f"{noise(9)} {passage[40:480]}"]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, passage, "", "")]


def words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(tokens: list[list], n: int) -> list[list[bool]]:
    seen = Counter(tuple(t[i : i + n]) for t in tokens for i in range(len(t) - n + 1))
    out = []
    for t in tokens:
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if seen[tuple(t[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append(gone)
    return out


def runs(gone):
    return sum(g and not p for p, g in zip([False, *gone], gone, strict=False))


@pytest.mark.parametrize("hot", [1024, 0])
def test_suffix_dedup_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    rows = corpus(1)
    data = [list((t or "").encode()) for _, t, _, _ in rows]
    want = Counter((i, len(b), sum(g), runs(g), hashlib.sha256(bytes(x for x, z in zip(b, g, strict=True) if not z)).hexdigest(), sum(m)) for (i, *_), b, g, m in zip(rows, data, brute(data, 400), brute(data, 256), strict=True))
    got = suffixdedup.op1(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_short"]
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("hot", [1024, 0])
def test_phrase_dedup_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    rows = corpus(2)
    tokens = [words(t) for _, t, _, _ in rows]
    want = Counter((i, len(w), sum(g), hashlib.sha256(" ".join(x for x, z in zip(w, g, strict=True) if not z).encode()).hexdigest()) for (i, *_), w, g in zip(rows, tokens, brute(tokens, 35), strict=True))
    assert Counter(map(tuple, phrasededup.op8(spark.createDataFrame(rows, SCHEMA)).collect())) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffixdedup.op1(none).count() == phrasededup.op8(none).count() == 0


def test_general_interface_returns_text(spark):
    rows = [(1, "é" * 500, "", ""), (2, "é" * 500, "", ""), (3, "kept", "", "")]
    got = {r.doc_id: r.kept for r in suffixdedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "", 2: "", 3: "kept"}


def test_deep_groups_hold_all_common_prefixes():
    r = random.Random(3)
    strings = ["".join(r.choice("ab") for _ in range(r.randint(1, 9))).encode() for _ in range(60)]
    best = {}
    for depth, members in suffixdedup.deep_groups(strings):
        for i in members:
            for j in members:
                if i != j:
                    best[i, j] = max(best.get((i, j), 0), depth)
    for i, a in enumerate(strings):
        for j, b in enumerate(strings):
            if i != j:
                assert best[i, j] == suffixdedup.common(a, b)


def test_shallow_groups_are_the_equal_prefixes():
    data = np.frombuffer(b"abcdefgh" * 20 + b"abcdefgX" + bytes(64), np.uint8)
    groups = suffixdedup.shallow_groups(np.arange(0, 168), data)
    raw = data.tobytes()
    want = Counter(raw[i : i + 32] for i in range(168))
    assert sorted(len(g) for g in groups) == sorted(n for n in want.values() if n > 1)


def test_runs_place_every_window_once():
    r = np.random.default_rng(0)
    codes, bounds = r.integers(0, 4, 500, dtype=np.uint64), np.array([0, 0, 120, 130, 500])
    row, lo, hi, anchor, _, _ = repeats.runs(codes, bounds, 30, 8)
    windows = [(int(k), int(w)) for k, a, b in zip(row, lo, hi, strict=True) for w in range(a, b + 1)]
    assert windows == [(k, w) for k in range(4) for w in range(bounds[k], bounds[k + 1] - 29)]
    assert ((anchor >= hi) & (anchor <= lo + 22)).all()


def test_runs_in_stretches_have_the_same_windows_and_anchors():
    r = np.random.default_rng(4)
    codes = r.integers(1, 40, 900).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bounds = np.array([0, 0, 5, 130, 131, 700, 700, 900])

    def windows(most):
        row, lo, hi, anchor, gram, _ = repeats.runs(codes, bounds, 20, 6, most)
        return sorted((int(a), int(w), int(x), int(g)) for a, b, c, x, g in zip(row, lo, hi, anchor, gram, strict=True) for w in range(b, c + 1))

    whole = windows(10_000)
    assert len(whole) == sum(max(0, n - 19) for n in np.diff(bounds))
    for most in (1, 7, 100, 333):
        assert windows(most) == whole
