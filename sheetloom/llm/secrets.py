"""Secret scans: fixed rules, and ownership frequency over the whole corpus for what looks random but fits no rule.

A candidate is a rule's value, or a whole run of at least MIN_CANDIDATE token characters, however long, that reads as
random: pairs of neighbours are weighed under a model of words and one of random characters. Hashes of candidates are counted over the corpus by distinct repositories and distinct owners. A value
that two owners or more hold, and more than COPIED_SHARE of all owners, is a copied example (documentation, a fixture, a
vendored file). Any other is live-looking, in however many repositories its owners repeat it, and its spans are added
under the kind "live" where no rule's span stands.

Shuffles: one aggregation of (hash, owner, repository) to distinct triples with partial aggregation, one of those to
counts, which are written as a table, and one equi-join of candidates (not texts) with that table, which adaptive execution can
split if a hash is hot. The texts are read once and never shuffle: the scan leaves a narrow table of spans, and only rows with candidates
take part in the joins.

Defined results: null or empty text has no spans. A null owner or repository counts as one value of its own. Repeated
rows are one repository if their ids are equal. The rules' spans stand whatever the frequencies say. A text of any length
is read whole; an empty table gives no rows; other columns than id, text, owner and repository are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_text, stash
from .spans import Span, free

KINDS = ["assign", "access", "hex", "live"]
RULES = KINDS[:3]
MIN_CANDIDATE, MIN_ENTROPY = 20, 3.0
#: Pairs of letters frequent in English, German, French and Spanish words.
COMMON_PAIRS = frozenset("th he in er an re ed on es st en at to nt ha nd ou ea ng as or ti is et it ar te se hi of de le la el os al ue ra ci ch ie ei ge un ic be sc ve li au me ne so qu ai ui us em ll om io il ur ro ma ri ta na no da do di lo mi mo pa pe po pr tr ca co ac ad ag am ar av ce ct ec eg em ep ev ey ho ht ig ii im ir iv ke ki kl ko la ld lt ly nc ni nk ns nu ol op ot ow pf pl rd rk rl rm rn rs rt ru sa sh si ss su sp tz tt tu ub uc ud ue ug ul um ut ux ve vi wa we wh wi wo ye ze zu zw ah ab bl bo br bu fa fe fi fo fr ga gi gl go gr gu ja je ju lu mu pu ob eu ba bi cr cl cu dr du ex".split())
#: Bits for words against randomness of a pair: common letters, other letters, small to capital, letter beside digit.
COMMON, RARE, RISE, MIXED = 1.6, -2.0, -2.3, -2.4
#: A value of two owners or more is a copied example if more than this share of all owners hold it.
COPIED_SHARE = 0.2

# ASCII makes IGNORECASE fold A-Z alone.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_LOOSE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}+")


def rule_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value): leftmost, non-overlapping per kind; failing matches are dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    return out


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def wordiness(s: str) -> float:
    """Bits by which the pairs of neighbours in s look like words rather than random characters."""
    total = 0.0
    for pair, n in Counter(zip(s, s[1:], strict=False)).items():
        a, b = pair
        if a.isalpha() and b.isalpha():
            total += n * (RISE if a.islower() and b.isupper() else COMMON if (a + b).lower() in COMMON_PAIRS else RARE)
        elif a.isalnum() and b.isalnum() and a.isdigit() != b.isdigit():
            total += n * MIXED
    return total


def looks_random(s: str) -> bool:
    """Pairs unlike those of words; runs with many groups of digits pass whatever their letters are."""
    if sum(c.isalpha() for c in s) < 4 or (e := entropy(s)) < MIN_ENTROPY:
        return False
    return wordiness(s) < 0 or (e >= 3.3 and sum(c.isdigit() for c in s) >= 4 and len(re.findall("[0-9]+", s)) >= 3)


def loose_spans(text: str) -> list[tuple[int, int, str]]:
    """Maximal runs of token characters that look random."""
    return [(*m.span(), m[0]) for m in _LOOSE.finditer(text) if looks_random(m[0])]


def _code(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and found: the spans of the rules, then the loose ones under the kind "live", each with its value's hash."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("hash", T.LongType())])
    fields = [T.StructField("found", T.ArrayType(span))]

    def kernel(batch: pa.RecordBatch) -> dict:
        found = []
        for text in batch.column("text").to_pylist():
            base = rule_spans(text) if text else []
            taken: list[Span] = [b[:3] for b in base]
            loose = [("live", a, b, v) for a, b, v in (loose_spans(text) if text else []) if free([("live", a, b)], taken)]
            found.append([{"kind": k, "a": a, "b": b, "hash": _code(v)} for k, a, b, v in base + loose])
        return {"found": found}

    return map_text(docs, kernel, fields, keep)


def ownership(found: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """hash, owners, repositories, copied: distinct owners and repositories of each candidate value in the corpus, all of whose rows are in found."""
    everyone = found.select(F.coalesce(owner.cast("string"), F.lit("")).alias("owner")).distinct().agg(F.count("*").alias("all_owners"))
    each = found.where(F.size("found") > 0).select(F.explode("found.hash").alias("hash"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository")).distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    counts = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    return counts.crossJoin(F.broadcast(everyone)).withColumn("copied", (F.col("owners") >= 2) & (F.col("owners") > COPIED_SHARE * F.col("all_owners"))).drop("all_owners")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, kind, a, b, hash, owners, repositories, copied: one row a candidate span."""
    found = cut(candidates(docs.select("doc_id", "text", F.col(owner).alias("_o"), F.col(repository).alias("_r")), ["doc_id", "_o", "_r"]))
    return _judged(found)


def _judged(found: DataFrame) -> DataFrame:
    each = found.where(F.size("found") > 0).select(*(c for c in found.columns if c != "found"), F.explode("found").alias("f")).select("*", "f.*").drop("f")
    # A table of its own: candidates and counts meet from two exchanges, and the part of a hot hash can be split.
    return each.join(stash(ownership(found, F.col("_o"), F.col("_r"))), "hash", "left")


def op4(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    sliced = docs.select("doc_id", "text", F.col(owner).alias("_o"), F.col(repository).alias("_r"))
    found = cut(candidates(sliced, ["doc_id", "_o", "_r"]).withColumn("rid", F.monotonically_increasing_id()))
    live = _judged(found).groupBy("rid").agg(F.collect_list(F.when((F.col("kind") == "live") & ~F.col("copied"), F.struct("kind", "a", "b", "hash"))).alias("live"), F.count_if("copied").alias("n_copied"), F.count_if(~F.col("copied")).alias("n_owner_specific"))
    has = found.where(F.size("found") > 0).join(live, "rid", "left")
    none = found.where(F.size("found") == 0).withColumn("live", F.lit(None).cast(live.schema["live"].dataType)).withColumns({"n_copied": F.lit(0), "n_owner_specific": F.lit(0)})
    out = has.unionByName(none)
    base = F.filter("found", lambda f: f["kind"] != "live")
    rank = lambda f: F.array_position(F.array(*(F.lit(k) for k in KINDS)), f["kind"])
    told = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(F.array_distinct(spans), lambda f: F.struct(f["a"].alias("a"), rank(f).alias("k"), f["b"].alias("b"), f["kind"].alias("kind")))), lambda f: F.concat_ws(":", f["kind"], f["a"], f["b"])), ",")
    n = lambda k: F.size(F.filter("found", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(n(k) for k in RULES), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.concat(base, F.coalesce("live", F.array().cast(live.schema["live"].dataType)))).alias("spans"), F.coalesce(F.size("live"), F.lit(0)).cast("long").alias("n_live"), F.col("n_copied").cast("long"), F.col("n_owner_specific").cast("long"))

