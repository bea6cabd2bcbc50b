"""Repeated passages by phrase automata.

A word goes if a window of WINDOW words that covers it also starts anywhere else in the corpus. Candidates come from
anchors (see repeats). In each shard of contexts, recurring windows are confirmed word for word, maximal stretches of
confirmed windows become passages, and the distinct passages are compiled into Aho-Corasick automata of at most
AUTOMATON_SYMBOLS symbols; all contexts of the shard stream through each and every occurrence of a passage is located.
Words enter an automaton as SYMBOLS characters of separate alphabets, so a match can only begin at a word and no node has
more than BASE children. A shard holds whole groups of an anchor gram, and equal windows have equal anchors: no occurrence
of a passage lies in another shard, so streaming a document is streaming its contexts, each to its one shard.

Defined results: null text has no words; a text under WINDOW words keeps all; repeated rows are repeats of each other.
A text of any length is read whole, alone in its slice; an empty table gives no rows; only doc_id and text are looked at.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import BYTE_CODES, NON_SPACE, covered, map_text, prefix_sums, sha256_hex, slice_hashes, utf8, word_bounds
from .repeats import Context, Tokens, with_spans

WINDOW = 35
GRAM = 15
BASE, SYMBOLS = 128, 3
AUTOMATON_SYMBOLS = 1_500_000


def _read(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, object]:
    starts, ends, bounds = word_bounds(data, offsets, NON_SPACE)
    return slice_hashes(prefix_sums(BYTE_CODES[data]), starts, ends), bounds, (starts, ends)


def _cut(data: np.ndarray, places: object, a: int, b: int) -> bytes:
    starts, ends = places
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True))


def _encoded(words: list[bytes], numbers: dict[bytes, int]) -> str:
    """SYMBOLS characters a word, the k-th from the k-th alphabet."""
    out = []
    for w in words:
        n = numbers.setdefault(w, len(numbers))
        for k in range(SYMBOLS):
            out.append(chr(0x100 + k * BASE + n % BASE) if k < SYMBOLS - 1 else chr(0x100 + k * BASE + n))
            n //= BASE
    return "".join(out)


def _stretches(flags: list[bool]) -> list[tuple[int, int]]:
    """First and last of each maximal run of true."""
    edge = np.flatnonzero(np.diff(np.array([False, *flags, False]).astype(np.int8)))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def passages(texts: list[str], times: list[int], window: int = WINDOW) -> list[str]:
    """Distinct maximal stretches of windows that occur twice or more, from encoded contexts."""
    size = window * SYMBOLS
    seen: Counter[str] = Counter()
    for t, n in zip(texts, times, strict=True):
        for i in range(0, len(t) - size + 1, SYMBOLS):
            seen[t[i : i + size]] += n
    out: dict[str, None] = {}
    for t in texts:
        for a, b in _stretches([seen[t[i : i + size]] > 1 for i in range(0, len(t) - size + 1, SYMBOLS)]):
            out[t[a * SYMBOLS : b * SYMBOLS + size]] = None
    return list(out)


def locate(texts: list[str], found: list[str]) -> list[tuple[int, int, int]]:
    """(text, first word, end word) of every occurrence of every passage; automata are built one after the other."""
    out, at = [], 0
    while at < len(found):
        automaton, held = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0
        while at < len(found) and held < AUTOMATON_SYMBOLS:
            automaton.add_word(found[at], len(found[at]))
            held, at = held + len(found[at]), at + 1
        automaton.make_automaton()
        for i, t in enumerate(texts):
            out += [(i, (end + 1 - n) // SYMBOLS, (end + 1) // SYMBOLS) for end, n in automaton.iter(t)]
    return out


def resolve(shard: list[Context], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(context, first, last) window starts that recur, as the shard's automata locate them."""
    numbers: dict[bytes, int] = {}
    words = [c.data.split(b" ") for c in shard]
    texts = [_encoded(w, numbers) for w in words]
    found = passages(texts, [c.times for c in shard], window)
    return [(i, a, b - window) for i, a, b in locate(texts, found) if shard[i].times == 1]


TOKENS = Tokens(
    read=_read,
    cut=_cut,
    window=WINDOW,
    gram=GRAM,
    slice_bytes=2 << 20,
    resolve=resolve,
    hashes=lambda data: _read(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0],
)

FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())]


def dedup(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, the counts, kept_sha256 of the kept words joined by spaces, and these as text (kept)."""

    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in FIELDS}
        data, offsets = utf8(batch.column("text"))
        starts, ends, bounds = word_bounds(data, offsets, NON_SPACE)
        for k, spans in enumerate(batch.column("spans").to_pylist()):
            a, b = int(bounds[k]), int(bounds[k + 1])
            gone = covered(b - a, np.array([s["a"] for s in spans]), np.array([s["b"] for s in spans])) if spans else np.zeros(b - a, bool)
            rest = b" ".join(data[s:e].tobytes() for s, e in zip(starts[a:b][~gone].tolist(), ends[a:b][~gone].tolist(), strict=True))
            out["n_words"].append(b - a)
            out["n_removed"].append(int(gone.sum()))
            out["kept_sha256"].append(sha256_hex(rest))
            out["kept"].append(rest.decode() if keep_text else None)
        return out

    return map_text(with_spans(docs, TOKENS), kernel, FIELDS, ["doc_id"])


def op8(docs: DataFrame) -> DataFrame:
    return dedup(docs, keep_text=False).drop("kept")
