"""Language identification by multilingual mixture inference.

A document is a sequence of units of UNIT_WORDS words; each unit comes from one of the learned languages with a
likelihood given by hashed letter trigrams (with word boundaries). Expectation-maximisation estimates the document's
language proportions; nested sets of its most likely languages, as many as account for half a unit each, are then compared by
likelihood minus half a log(units) per free proportion, and the best set is kept. All documents of an Arrow slice run through the iterations at once.

Training counts trigrams over every labelled document outside the held-out quarter; partial counts per task, then sums by
(language, bucket). The model has languages x BUCKETS numbers, whatever the corpus, and only it reaches the driver.

Defined results: text that is null or has no letters is `und` with score 0; without any labelled document everything is
`und`. A null doc_id counts as the empty text. Equal rows get equal results. Of equal
proportions the language first by name is named. A text of any length is scored whole, in one pass over its n-grams; an empty table gives no rows; columns named like a result's are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, map_text, set_aside, sliced, utf8, word_bounds

BUCKETS = 1 << 15
UNIT_WORDS = 4
EM_STEPS = 12
#: A language joins the nested sets that are compared if it accounts for so many of a document's units.
LEAST_UNITS = 0.5
SMOOTHING = 0.5
#: Likelihoods of neighbouring trigrams depend on each other; so much of their sum counts.
TEMPER = 0.5
REJECT_BELOW = 0.4

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the two-byte Latin-1 capitals."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 32
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams centred on letter bytes, the positions of these, and the folded bytes."""
    low = _folded(data)
    letters = np.where(_LETTER[low], low, np.uint8(0x20)).astype(np.uint32)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    left, right = np.full(len(data), 0x20, np.uint32), np.full(len(data), 0x20, np.uint32)
    if len(data):
        left[1:], right[:-1] = letters[:-1], letters[1:]
        left[first[:-1]] = 0x20
        right[first[1:]] = 0x20
    at = np.flatnonzero(letters != 0x20)
    code = ((left[at] << np.uint32(16)) | (letters[at] << np.uint32(8)) | right[at]) * np.uint32(0x9E3779B1)
    return (code >> np.uint32(17)).astype(np.int64), at, low


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and BUCKETS x languages log-likelihoods from (text, lang), rows without either left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            data, offsets = utf8(batch.column("text"))
            buckets, at, _ = _trigrams(data, offsets)
            bounds = np.searchsorted(at, offsets)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                rows = np.flatnonzero(langs == lang)
                total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total += np.bincount(np.concatenate([buckets[bounds[r] : bounds[r + 1]] for r in rows]), minlength=BUCKETS)
        for lang, total in counts.items():
            keep = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keep), pa.string()), pa.array(keep.astype(np.int32)), pa.array(total[keep])], ["lang", "bucket", "n"])

    seen = docs.select("text", "lang").where("text is not null and lang is not null")
    sums = seen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    index = {x: i for i, x in enumerate(langs)}
    if got.num_rows:
        table[got.column("bucket").to_numpy(), [index[x] for x in got.column("lang").to_pylist()]] += got.column("n").to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _em(like: np.ndarray, row: np.ndarray, starts: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by row after `steps` rounds, and log-likelihoods. like: unit likelihoods, each row scaled to a maximum of 1."""
    n = np.diff(np.append(starts, len(like)))[:, None]
    for _ in range(steps):
        g = like * share[row]
        g /= np.maximum(g.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(g, starts, axis=0) / n
    total = np.add.reduceat(np.log(np.maximum((like * share[row]).sum(axis=1), 1e-300)), starts)
    return share, total


def infer(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: proportions of the chosen language set (zero outside it), and whether there was anything to judge."""
    rows, n_lang = len(offsets) - 1, table.shape[1]
    out, known = np.zeros((rows, n_lang)), np.zeros(rows, bool)
    buckets, at, low = _trigrams(data, offsets)
    starts, _, bounds = word_bounds(low, offsets, _LETTER)
    if not len(starts) or not n_lang:
        return out, known
    word_row = np.repeat(np.arange(rows), np.diff(bounds))
    within = np.arange(len(starts)) - bounds[:-1][word_row]
    unit = np.flatnonzero(within % UNIT_WORDS == 0)
    row_of_unit = word_row[unit]
    first_tri = np.searchsorted(at, starts[unit])
    ll = np.add.reduceat(table[buckets], first_tri, axis=0).astype(np.float64) * TEMPER
    like = np.exp(ll - ll.max(axis=1, keepdims=True))
    present, firsts = np.unique(row_of_unit, return_index=True)
    row = np.searchsorted(present, row_of_unit)
    share, _ = _em(like, row, firsts, np.full((len(present), n_lang), 1 / n_lang), EM_STEPS)
    ranked = np.argsort(-share, axis=1, kind="stable")
    units = np.diff(np.append(firsts, len(like)))
    count = np.maximum(1, (share * units[:, None] >= LEAST_UNITS).sum(axis=1))
    best, chosen = np.full(len(present), -np.inf), np.zeros_like(share)
    for size in range(1, int(count.max()) + 1):
        # Only documents with so many languages go on, with their units alone.
        wide = np.flatnonzero(count >= size)
        mine = np.isin(row, wide)
        local = np.searchsorted(wide, row[mine])
        mask = np.zeros((len(wide), n_lang))
        np.put_along_axis(mask, ranked[wide, :size], 1 / size, axis=1)
        sub, total = _em(like[mine], local, np.searchsorted(local, np.arange(len(wide))), mask, EM_STEPS if size > 1 else 0)
        score = total - 0.5 * (size - 1) * np.log(units[wide])
        better = score > best[wide]
        best[wide[better]], chosen[wide[better]] = score[better], sub[better]
    out[present], known[present] = chosen, True
    return out, known


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.StringType())]


def _lettered(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """Columns of `keep` (all of docs by default) with lang_pred, score and lang_set (language=proportion, largest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> dict:
        langs, table = shared.value
        data, offsets = utf8(batch.column("text"))
        share, known = infer(data, offsets, table)
        pred, score, sets = [], [], []
        for i, (p, ok) in enumerate(zip(share, known, strict=True)):
            # Bytes over 0x7F may still be no letters; only then is the text looked at again.
            if not ok or not (np.any(_LETTER[_folded(data[offsets[i] : offsets[i + 1]][:64])] & (data[offsets[i] : offsets[i + 1]][:64] < 0x80)) or _lettered(batch.column("text")[i].as_py())):
                pred.append("und"), score.append(0.0), sets.append("")
                continue
            k = int(p.argmax())
            pred.append(langs[k])
            score.append(float(min(1.0, p[k])))
            sets.append(",".join(f"{langs[j]}={p[j]:.4f}" for j in np.argsort(-p, kind="stable") if p[j] > 0))
        return {"lang_pred": pred, "score": score, "lang_set": sets}

    return map_text(docs, kernel, FIELDS, docs.columns if keep is None else keep, limit=max(1 << 14, SLICE_BYTES * 8 // max(8, len(model[0]))))


def op6(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~is_held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_set")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is found with a proportion of REJECT_BELOW or more."""
    model = train(docs.where(~is_held_out(F.col("doc_id"))))
    free, back = set_aside(docs, [f.name for f in FIELDS])
    out = identify(free, model).where((F.col("lang_pred") != "und") & (F.col("score") >= REJECT_BELOW))
    return out.select(*free.columns).withColumnsRenamed(back)
