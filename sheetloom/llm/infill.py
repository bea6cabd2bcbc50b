"""Fill-in-the-middle training texts: documents cut in three, with the middle moved to the end.

A text is held as runs of one character class, here the number of bytes of a code point in UTF-8: a maximal run of equal
classes is one row of (units before it, bytes before it, bytes a unit). A cut at unit k is found by binary search among the
units before each run, and its byte offset is arithmetic: bytes before + (k - units before) * bytes a unit. Plain ASCII is
one run, so nothing is kept a unit; a long text is encoded a block at a time, and only its runs stay.

Cuts and form are drawn from a hash of the seed and doc_id, so every run gives the same result and no row looks at another.

Defined results: null text is empty; empty texts and texts that hold one of the marks stay plain; a null doc_id is hashed as
no digits; repeated rows give equal rows; a text of any length is handled whole; an empty table gives no rows; columns of the
input that have the name of an output column are replaced by it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100 documents, these stay plain; of 100 that are cut, these have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes of a text that are encoded at once.
BLOCK = 1 << 20

#: Bytes of the code point that a byte begins; 0 within one.
WIDTH = np.zeros(256, np.int64)
WIDTH[:0x80], WIDTH[0xC0:0xE0], WIDTH[0xE0:0xF0], WIDTH[0xF0:] = 1, 2, 3, 4

FIELDS = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
]


@dataclass
class Runs:
    """Maximal runs of one class: units and bytes before each, bytes a unit; and the units of the text."""

    units: np.ndarray
    starts: np.ndarray
    width: np.ndarray
    n: int

    @classmethod
    def of(cls, data: np.ndarray) -> Runs:
        units, starts, widths, n, last = [], [], [], 0, 0
        for at in range(0, len(data), BLOCK):
            width = WIDTH[data[at : at + BLOCK]]
            lead = np.flatnonzero(width)
            if not len(lead):
                continue
            width = width[lead]
            new = np.ones(len(lead), bool)
            new[0], new[1:] = width[0] != last, width[1:] != width[:-1]
            first = np.flatnonzero(new)
            units.append(n + first)
            starts.append(at + lead[first])
            widths.append(width[first])
            n, last = n + len(lead), width[-1]
        units, starts, widths = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (units, starts, widths))
        return cls(units, starts, widths, n)

    def offset(self, cut: int) -> int:
        """The byte at which unit `cut` begins; cut may be n."""
        if not cut:
            return 0
        run = int(np.searchsorted(self.units, cut, "right")) - 1
        return int(self.starts[run] + (cut - self.units[run]) * self.width[run])


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def infilled(text: bytes, drawn: tuple[int, ...], plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, units of prefix and middle (null if plain), output."""
    runs = Runs.of(np.frombuffer(text, np.uint8))
    one, two, three = (m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
    if not text or any(m in text for m in (one, two, three)) or drawn[2] % 100 >= 100 - plain:
        return runs.n, "plain", None, None, text
    low, high = sorted(h % (runs.n + 1) for h in drawn[:2])
    a, b = runs.offset(low), runs.offset(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if drawn[3] % 100 < suffix_first:
        return runs.n, "spm", low, high - low, b"".join((two, suffix, one, prefix, three, middle))
    return runs.n, "psm", low, high - low, b"".join((one, prefix, two, suffix, three, middle))


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The columns of docs, and n, form, prefix_chars, middle_chars and output, the text to train on."""

    def kernel(batch: pa.RecordBatch) -> dict[str, list]:
        data, offsets = utf8(batch.column("text"))
        rows = [infilled(data[a:b].tobytes(), draws(i, seed), plain, suffix_first) for i, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True)]
        out = dict(zip(("n", "form", "prefix_chars", "middle_chars", "output"), zip(*rows, strict=True), strict=True))
        return out | {"output": pa.array(out["output"], pa.binary()).cast(pa.string())}

    return map_text(docs, kernel, FIELDS, docs.columns)


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: marks stand nowhere in it, and none can arise where a part meets a mark, so the first of each divides."""
    after = lambda c, left: F.substring(c, F.length(left) + F.lit(len(PREFIX) + 1), F.length(c))
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    first = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = after(body, first)
    second = F.substring_index(rest, MIDDLE, 1)
    middle = after(rest, second)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def op12(docs: DataFrame) -> DataFrame:
    out = fill_in_middle(docs.select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
