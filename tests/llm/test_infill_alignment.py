import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetloom.llm import alignment, infill

TEXTS = [
    None, "", " ", "a", "The quick  brown fox.", "naïve café — дом стоит у реки", "tab\tand\nnewline  \n\n x", "漢字かな交じり文 と english", "<|endoftext|> is plain text, as is <s>",
    "has ▁ inside", "emoji 👩‍👩‍👧 here 😀😀", "don't we'll I'm", "x" * 300, " leading and trailing ", "nbsp  y  z　 w", "\x00 nul \x7f del", "can't can't can't can't", "a <P> mark", "123 4567 89 0",
]


def documents(spark, rows, extra=True):
    cols = "doc_id long, text string" + (", n string, form long, batch long, h1 string, pairs int" if extra else "")
    return spark.createDataFrame([(*r, *(("x", 1, 2, "y", 3) if extra else ())) for r in rows], cols)


def plain_alignment(rows):
    """Tokens, groups, links and counts by two loops over spans."""
    a, b = alignment.ByteLevel(alignment.VOCABULARY_A), alignment.Pieces(alignment.VOCABULARY_B)

    def spans(tokenizer, text):
        ids = tokenizer.encode([text])[0]
        ends = np.cumsum([len(tokenizer.bytes[i]) for i in ids])
        return (list(zip(ids, [0, *ends[:-1]], ends, strict=True))) if b"".join(tokenizer.bytes[i] for i in ids) == b" " + text.encode() else None

    held, links = defaultdict(set), {}
    out = {}
    for k, (_, text) in enumerate(rows):
        both = [spans(t, text) for t in (a, b)] if text else [None, None]
        if None in both:
            continue
        x, y = both
        links[k] = [(i, j) for i, s, e in x for j, p, q in y if s < q and p < e]
        ends = sorted({e for _, _, e in x} & {e for _, _, e in y})
        groups = [[[str(i) for i, _, e in side if lo < e <= hi] for side in both] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
        out[k] = [len(x), len(y), len(groups), hashlib.sha256(";".join("|".join(",".join(s) for s in g) for g in groups).encode()).hexdigest()]
        for pair in links[k]:
            held[pair].add(k)
    count = {pair: len(ks) for pair, ks in held.items()}
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    result = []
    for k, (doc_id, _) in enumerate(rows):
        if k in out:
            n_a, n_b, groups, digest = out[k]
            result.append((doc_id, n_a, n_b, groups, len(links[k]), sum(count[p] == top[p[0]] for p in links[k]), sum(count[p] for p in links[k]), digest))
        else:
            result.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
    return Counter(result)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("limits", [alignment.Limits(), alignment.Limits(stretch=7, piece=40, pairs=30)])
def test_alignment_equals_spans(spark, limits):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "a"), (None, "a"), (3, "a"), (3, "other words"), (70, " ".join(t for t in TEXTS if t and "▁" not in t) * 3), (71, "word " * 200), (72, "ab" * 90 + "▁ c")]
    df = alignment.op11(documents(spark, rows).repartition(3), limits=limits)
    assert df.columns == NAMES
    assert Counter(tuple(r) for r in df.collect()) == plain_alignment(rows)


def encoded(texts, limits=alignment.Limits()):
    """(ids of A, ids of B) a text, through the piecewise encoder."""
    import pyarrow as pa

    e = alignment.Encoder(alignment.VOCABULARY_A, alignment.VOCABULARY_B, limits)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64())] * 3 + [pa.array(texts, pa.string())], ["h1", "h2", "n", "text"])
    got = defaultdict(lambda: ([], []))
    refused = set()
    for part in e.events(batch):
        for h1, side, ids in zip(part.column("h1").to_pylist(), part.column("side").to_pylist(), part.column("ids").to_pylist(), strict=True):
            if side < 0:
                refused.add(h1)
            else:
                got[h1][side].extend(np.frombuffer(ids, e.packed).tolist())
    return [None if k in refused else got[k] for k in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab's  \t\n 　 é世д.1😀\x1c\x85▁"), min_size=1, max_size=25), min_size=1, max_size=6))
def test_pieces_give_the_tokens_of_the_whole_text(texts):
    a, b = alignment.ByteLevel(alignment.VOCABULARY_A), alignment.Pieces(alignment.VOCABULARY_B)
    for text, got in zip(texts, encoded(texts), strict=True):
        x, y = a.encode([text])[0], b.encode([text])[0]
        good = all(b"".join(t.bytes[i] for i in ids) == b" " + text.encode() for t, ids in ((a, x), (b, y)))
        assert (got is not None) == good
        if good:
            assert got == (x, y)


def test_a_long_text_is_encoded_in_pieces():
    text = "Ein sehr langer Satz, дом у реки 漢字 and  so on.\n" * 3000
    whole = encoded([text])
    assert encoded([text], alignment.Limits(piece=5000)) == whole
    assert whole[0][0] == alignment.ByteLevel(alignment.VOCABULARY_A).encode([text])[0]


def test_a_worker_encodes_what_recurs_once(monkeypatch):
    asked = []
    encode = alignment.ByteLevel.encode
    monkeypatch.setattr(alignment.ByteLevel, "encode", lambda self, texts: asked.extend(texts) or encode(self, texts))
    texts = [f"once{k % 50} другое once{k % 7}-x once▁inside{k % 3}" if k % 9 == 0 else f"once{k % 50} once{k % 7}-x" for k in range(600)]
    first = encoded(texts)
    assert encoded(texts[::-1])[::-1] == first  # two batches of one worker
    assert len(asked) == len(set(asked)) == 50 + 7 + 1 + 1
    assert [t is None for t in first] == [k % 9 == 0 for k in range(600)]


@pytest.mark.parametrize(("known", "word"), [(3, 48), (40, 4), (1, 1)])
def test_memory_of_pieces_is_bounded_and_changes_nothing(known, word):
    texts = [f"word{k % 50} другое {k % 7} can't {'long' * (k % 5)} {'▁' * (k % 11 == 0)}x" for k in range(300)]
    a, b = alignment.ByteLevel(alignment.VOCABULARY_A), alignment.Pieces(alignment.VOCABULARY_B)
    alignment.known.cache_clear()
    for at in range(0, 300, 20):
        part = texts[at : at + 20]
        want = [None if "▁" in t else (a.encode([t])[0], b.encode([t])[0]) for t in part]
        assert encoded(part, alignment.Limits(known=known, word=word)) == want
        held = alignment.known(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
        assert len(held.new) <= known and len(held.old) <= known
        assert max(map(len, [*held.new, *held.old]), default=0) <= word
    alignment.known.cache_clear()


def test_alignment_of_no_rows(spark):
    assert alignment.op11(documents(spark, [])).collect() == []
    assert [tuple(r) for r in alignment.op11(documents(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()] == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]


def plain_infill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{text[:p]}<S>{text[q:]}<M>{text[p:q]}" if form == "psm" else f"<S>{text[q:]}<P>{text[:p]}<M>{text[p:q]}"
    return n, form, p, q - p, out


def test_infill_equals_slices_of_code_points(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 6)] + [(None, "null id"), (5, "<S"), (6, "P><P"), (900, "ab<" * 40), (901, "дом ab 漢字😀" * 50_000)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((i, *plain_infill(i, t)[:4], digest(plain_infill(i, t)[4]), digest(t or "")) for i, t in rows)
    df = infill.op12(documents(spark, rows))
    assert df.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert Counter(tuple(r) for r in df.collect()) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_infill_keeps_other_columns_and_takes_no_rows(spark):
    out = infill.fill_in_middle(documents(spark, [(1, "some text"), (1, "some text")]))
    assert set(out.columns) == {"doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "batch", "h1", "pairs"}
    assert out.distinct().count() == 1 and out.count() == 2 and out.first()["n"] == 9
    assert infill.op12(documents(spark, [])).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abé世😀д \n"), max_size=60), st.integers(1, 9))
def test_runs_find_every_cut(text, block):
    held, infill.BLOCK = infill.BLOCK, block
    try:
        data = text.encode()
        runs = infill.Runs.of(np.frombuffer(data, np.uint8))
    finally:
        infill.BLOCK = held
    assert runs.n == len(text)
    assert [runs.offset(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert (runs.width[1:] != runs.width[:-1]).all()
