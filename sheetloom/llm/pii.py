"""Personal data: fixed rules, and a semi-Markov conditional random field that adds what the rules miss.

The field scores whole candidate segments of a token window (runs of digits, runs of letters, single other characters)
by features of the segment as a unit: digit and group counts, Luhn, quads in range, separators used, an at sign or its
spelled form inside, the words around it. A segment of an entity spans at most MAX_SEGMENT tokens, so the dynamic
programme that picks boundaries and types jointly is linear in the window. Weights are fitted by gradient ascent on the
exact conditional likelihood (semi-Markov forward-backward) over windows generated from TEMPLATES with a fixed seed; no
corpus text goes in. Windows are all regions of a text, however long, that
cheap patterns show to hold enough digits or an at sign.

Defined results: null or empty text has no spans; equal rows are judged alike; spans of the field that overlap a span of
the rules are dropped, so the rules' spans always stand. A text of any length is
read whole, the field decodes its regions alone; an empty table gives no rows; only doc_id and text are looked at.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text
from .spans import Span, digest, free, joined, masked

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
MAX_SEGMENT = 24
#: Size of the generated training set, gradient steps, seed.
TRAIN_WINDOWS, TRAIN_ROUNDS, SEED = 400, 40, 11

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot begin inside a run of digits whose start failed, hence the look-behind: linear on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def rule_spans(text: str) -> list[Span]:
    """The fixed rules: leftmost, non-overlapping per kind; failing matches are dropped without a retry."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, last := m.end()))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _DIGITS.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---------------------------------------------------------------- the field

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\S\n]+|.", re.S)
# Regions worth decoding, whole: digits in groups of any number, and what surrounds an at sign, spelled out or not. All
# repeats are possessive, so both stay linear; MAX_SEGMENT bounds what is scored inside.
_NUMBERS = re.compile(r"[(+]?[0-9]++(?:(?:\[\.\]|[()./+\x20-])++[0-9]++)*+")
_AHEAD = re.compile(r"\x20?[A-Za-z0-9.-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20\.\x20?|(?<=\.)\x20)[A-Za-z0-9.-]++)*+")
_DOT_WORD = re.compile(r"(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2}")
_AT = re.compile(r"\(at\)|\[at\]|@")
_CUES = {"phone": ("phone", "tel", "call", "mobile", "fax", "cell"), "card": ("card", "visa", "credit", "amex"), "ip": ("ip", "host", "server", "address"), "email": ("mail", "email", "contact", "write"), "other": ("isbn", "order", "invoice", "ref", "serial", "part", "version", "id", "sku", "no")}
_FEATURES = ["bias", "tokens>1", "has_at", "has_dot_word", "plus", "paren_open", "d<7", "d7-9", "d10-11", "d12-13", "d14-15", "d16-19", "d>19", "luhn", "quad", "quad_bad", "groups1", "groups2", "groups3", "groups4", "groups>4", "even4", "sep_space", "sep_dash", "sep_dot", "sep_slash", "letters", "edge_space", "edge_punct", "joined_left", "joined_right", "first3", "year_like", *(f"cue_{k}" for k in _CUES)]
_INDEX = {f: i for i, f in enumerate(_FEATURES)}


def _segment_features(text: str, a: int, b: int) -> list[str]:
    """Whole-span features of text[a:b]."""
    s = text[a:b]
    groups = re.findall("[0-9]+", s)
    d = "".join(groups)
    n = len(d)
    f = ["bias"]
    at = bool(_AT.search(s))
    if at:
        f.append("has_at")
        if re.search(r"(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,}\Z", s):
            f.append("has_dot_word")
    if s[0] == "+":
        f.append("plus")
    if s[0] == "(":
        f.append("paren_open")
    f.append("d<7" if n < 7 else "d7-9" if n < 10 else "d10-11" if n < 12 else "d12-13" if n < 14 else "d14-15" if n < 16 else "d16-19" if n < 20 else "d>19")
    if 14 <= n <= 19 and luhn(d):
        f.append("luhn")
    if len(groups) == 4 and re.fullmatch(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\x20\.\x20)[0-9]{1,3}){3}", s):
        f.append("quad" if all(int(g) < 256 for g in groups) else "quad_bad")
    f.append(f"groups{len(groups)}" if 1 <= len(groups) <= 4 else "groups>4")
    if len(groups) == 4 and all(len(g) == 4 for g in groups):
        f.append("even4")
    f += [name for c, name in ((" ", "sep_space"), ("-", "sep_dash"), (".", "sep_dot"), ("/", "sep_slash")) if c in s]
    if re.search(r"[^\W\d_]", s) and not at:
        f.append("letters")
    if s[0].isspace() or s[-1].isspace():
        f.append("edge_space")
    if s[0] in ".-/)" or s[-1] in ".-/(+":
        f.append("edge_punct")
    if a and (text[a - 1].isalnum() or (a > 1 and text[a - 1] in "-./" and text[a - 2].isalnum())):
        f.append("joined_left")
    if b < len(text) and (text[b].isalnum() or (b + 1 < len(text) and text[b] in "-./" and text[b + 1].isalnum())):
        f.append("joined_right")
    if len(groups) == 3 and len(groups[0]) == 3 and len(groups[1]) == 3 and len(groups[2]) == 4:
        f.append("first3")
    if groups and re.fullmatch("(?:19|20)[0-9]{2}", groups[0]):
        f.append("year_like")
    left = text[max(0, a - 24) : a].lower()
    f += [f"cue_{k}" for k in _CUES if any(re.search(rf"\b{c}\b", left) for c in _CUES[k])]
    return f


def _lattice(text: str, lo: int, hi: int) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Token boundaries of text[lo:hi], and the segments (i, j, feature numbers) an entity may take."""
    cuts = [lo, *(m.end() for m in _TOKEN.finditer(text, lo, hi))]
    segments = []
    for i in range(len(cuts) - 1):
        if not (text[cuts[i]].isalnum() or text[cuts[i]] in "+("):
            continue
        for j in range(i + 1, min(len(cuts), i + 1 + MAX_SEGMENT)):
            if text[cuts[j] - 1].isalnum() and (cuts[j] - cuts[i]) >= 7:
                segments.append((i, j, [_INDEX[f] for f in _segment_features(text, cuts[i], cuts[j])]))
    return cuts, segments


def _allowed(features: list[int]) -> list[bool]:
    """What a segment must show to be of a type by the type's own definition; all else is left to the weights."""
    have = {_FEATURES[f] for f in features}
    digits = {"phone": {"d10-11", "d12-13", "d14-15"}, "card": {"d14-15", "d16-19"}}
    needs = {"email": {"has_at", "has_dot_word"}, "ip": {"quad"}, "card": {"luhn"}, "phone": set()}
    return [needs[k] <= have and (k not in digits or bool(digits[k] & have)) for k in KINDS]


def _decode(n: int, segments: list[tuple[int, int, list[int]]], w: np.ndarray) -> list[tuple[str, int, int]]:
    """Viterbi over segmentations: a token outside entities scores 0; an entity segment scores its type's weights."""
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    ending: dict[int, list] = {}
    for i, j, f in segments:
        ending.setdefault(j, []).append((i, f))
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, f in ending.get(j, ()):
            scores = np.where(_allowed(f), w[:, f].sum(axis=1), -np.inf)
            k = int(scores.argmax())
            if best[i] + scores[k] > best[j]:
                best[j], back[j] = best[i] + scores[k], (i, k)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((KINDS[k], i, j))
            j = i
    return out[::-1]


def _gradient(n: int, segments: list[tuple[int, int, list[int]]], gold: set[tuple[int, int, int]], w: np.ndarray, grad: np.ndarray) -> None:
    """Adds observed minus expected feature counts of one window."""
    x = np.zeros((len(segments), len(_FEATURES)))
    for r, (_, _, f) in enumerate(segments):
        x[r, f] = 1
    scores = np.where(np.array([_allowed(f) for _, _, f in segments]), x @ w.T, -np.inf)
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for r, (i, j, _) in enumerate(segments):
        by_end.setdefault(j, []).append(r)
        by_start.setdefault(i, []).append(r)
    with np.errstate(invalid="ignore"):
        total = np.logaddexp.reduce(scores, axis=1)
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[segments[r][0]] + total[r] for r in by_end.get(j, ()))])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[segments[r][1]] + total[r] for r in by_start.get(i, ()))])
    for r, (i, j, f) in enumerate(segments):
        p = np.exp(scores[r] + (ahead[i] + behind[j] - ahead[n]))
        for k in range(len(KINDS)):
            if (i, j, k) in gold and np.isfinite(scores[r, k]):
                p[k] -= 1
        grad[:, f] -= p[:, None]


#: Sentence frames of the training windows; {x} is the entity or the decoy.
TEMPLATES = ["{x}", "call {x} now", "phone {x}", "tel: {x}", "my number is {x}.", "mail {x} today", "contact {x}", "card {x}", "paid with card {x} on", "host {x} is up", "ip {x}", "server {x} down", "the {x} of", "see {x}, and", "page {x}", "from {x} to"]
OTHER_TEMPLATES = ["isbn {x}", "order {x} shipped", "invoice no {x}", "ref {x}", "serial {x},", "part {x}", "version {x}", "id {x}", "sku {x}"]


def _training_windows(rng: random.Random, count: int) -> list[tuple[str, int, int, str]]:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8)))

    def card() -> str:
        s = rng.choice("3456") + d(14)
        s += next(c for c in "0123456789" if luhn(s + c))
        return rng.choice([s, " ".join(s[i : i + 4] for i in range(0, 16, 4)), "-".join(s[i : i + 4] for i in range(0, 16, 4))])

    def decoy() -> str:
        return rng.choice([d(4) + "-" + d(2) + "-" + d(2), d(16) if not luhn(x := d(16)) else x[:-1] + str((int(x[-1]) + 1) % 10), d(9), d(7), f"{d(1)}.{d(2)}.{d(1)}", f"{d(3)}.{d(2)}", d(20), f"{d(2)}/{d(2)}/{d(4)}", d(5) + " " + d(5), d(1) + "," + d(3) + "," + d(3), f"{d(4)} - {d(4)}", d(12), d(14), " ".join(d(rng.randint(1, 3)) for _ in range(6)), f"9{d(2)}.{d(3)}.9{d(2)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}", f"20{d(2)}-{d(2)}-{d(2)} {d(2)}:{d(2)}", f"19{d(2)}-{d(2)}-{d(2)} {d(2)}", f"20{d(2)}.{d(2)}.{d(2)} {d(2)}.{d(2)}", f"{d(4)} {d(4)} {d(3)}", f"{d(6)}-{d(6)}"])

    made = {
        "phone": lambda: rng.choice([f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"{d(3)} {d(3)} {d(4)}"]),
        "card": card,
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "email": lambda: word() + rng.choice(["@", " (at) ", "(at)", " [at] "]) + word() + rng.choice([".", " (dot) ", "[dot]"]) + rng.choice(["com", "org", "net", "de"]),
        "none": decoy,
    }
    out = []
    for _ in range(count):
        kind = rng.choice(["phone", "card", "ip", "email", "none", "none", "none"])
        x, t = made[kind](), rng.choice(TEMPLATES)
        if kind == "none" and rng.random() < 0.4:  # numbers shaped like an entity that their frame calls something else
            x, t = rng.choice([decoy(), f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}"]), rng.choice(OTHER_TEMPLATES)
        at = t.index("{x}")
        out.append((t.replace("{x}", x), at, at + len(x), kind))
    return out


@functools.cache
def weights(count: int = TRAIN_WINDOWS, rounds: int = TRAIN_ROUNDS, seed: int = SEED) -> np.ndarray:
    """One row of feature weights a kind; AdaGrad on the L2-penalised conditional log-likelihood; the same on every run."""
    data = []
    for text, a, b, kind in _training_windows(random.Random(seed), count):
        cuts, segments = _lattice(text, 0, len(text))
        gold = {(cuts.index(a), cuts.index(b), KINDS.index(kind))} if kind != "none" else set()
        data.append((len(cuts) - 1, segments, gold))
    w, seen = np.zeros((len(KINDS), len(_FEATURES))), np.full((len(KINDS), len(_FEATURES)), 1e-6)
    for _ in range(rounds):
        grad = np.zeros_like(w)
        for n, segments, gold in data:
            if segments:
                _gradient(n, segments, gold, w, grad)
        grad -= 0.05 * w
        seen += grad * grad
        w += 0.6 * grad / np.sqrt(seen)
    return w


def regions(text: str) -> list[tuple[int, int]]:
    """Maximal parts of the text that may hold entities, in order; parts that overlap are one."""
    found = [m.span() for m in _NUMBERS.finditer(text) if m.end() - m.start() >= 8]
    for at in _AT.finditer(text):
        lo = at.start() - (text[at.start() - 1 : at.start()] == " ")
        name = lo
        while lo and text[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        m = _AHEAD.match(text, at.end()) if lo < name else None
        if m and _DOT_WORD.search(text, at.end(), m.end()):
            found.append((lo, m.end()))
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def field_spans(text: str, w: np.ndarray) -> list[Span]:
    """Spans that the field finds in the regions of the whole text; offsets in code points."""
    out = []
    for lo, hi in regions(text):
        cuts, segments = _lattice(text, lo, hi)
        if segments:
            out += [(k, cuts[i], cuts[j]) for k, i, j in _decode(len(cuts) - 1, segments, w)]
    return out


def find(text: str | None, w: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Spans of the rules, and those that the field adds."""
    if not text:
        return [], []
    base = rule_spans(text)
    return base, free(field_spans(text, w), base)


FIELDS = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("masked", T.StringType())]


def detect(docs: DataFrame, keep: list[str] | None = None, mask: bool = True) -> DataFrame:
    """Columns of `keep` (all of docs by default) with counts of the rules, digests, spans and the text with spans masked."""
    shared = docs.sparkSession.sparkContext.broadcast(weights())

    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in FIELDS}
        for text in batch.column("text").to_pylist():
            base, added = find(text, shared.value)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(digest(base, KINDS))
            out["spans"].append(joined(base + added, KINDS))
            out["n_added"].append(len(added))
            out["masked"].append(masked(text, base + added) if mask and text else text if mask else None)
        return out

    return map_text(docs, kernel, FIELDS, docs.columns if keep is None else keep)


def op2(docs: DataFrame) -> DataFrame:
    return detect(docs.select("doc_id", "text"), keep=["doc_id"], mask=False).select("doc_id", *(F.col(f"n_{k}") for k in KINDS), "base_sha256", "spans", "n_added")
