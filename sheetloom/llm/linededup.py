"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line is the set of its distinct tokens (runs outside [\\x20\\x09-\\x0D]), each a 48-bit hash under the rank of its rarity:
the tokens of all lines are counted in RANK_BUCKETS hash buckets, so the table that orders them has a fixed size. A
line goes if an earlier line (by doc_id, then text hash, then place) has Jaccard similarity of 0.8 or more with it; a
blank line stays.

1. Lines with equal token sets collapse to the earliest (partial aggregation, so a hot line is one row a task).
2. Each distinct set posts the tokens of its prefix, the rarest n - ceil(0.8 n) + 1. Postings meet by token under the
   length, index-prefix and positional filters, and a parity bitmap of 64 bits (192 between long lines) bounds the symmetric difference.
3. Lists of up to HOT postings meet as they are, so their pairs grow with the postings alone. Postings of longer lists
   are set apart and first meet the earliest of each of HEADS shares of their list; a line that passes the filters with
   one of them meets its whole lists only if verification refuses that pair, every other line does so at once. A list of
   near copies therefore costs a few pairs a line, and no match is passed over.
4. Pairs are verified on the 64-bit token sets of the lines, read again from the texts.

A line's key is (d, h, t): doc_id, a 64-bit hash of the text, and 34 bits of another one over the line's number, the same in
every run. Texts that share a doc_id (all nulls share one) are thus told apart by 98 bits. The distinct sets are sorted by key and
numbered, so postings and pairs carry a number of one word, which has the order of keys.

Defined results: null text has no lines; rows that repeat a doc_id and text are one document; a null doc_id comes first;
equal doc_ids with different texts are ordered by their hashes. Empty texts are one blank line; a text of any length is
read line by line. An empty table gives no rows; other columns are not looked at. whatever their
names; where rows are returned whole, they keep theirs.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, parts_for, stash

RANK_BUCKETS = 1 << 16
HEADS = 4
#: Postings of a token up to which all of them meet.
HOT = 512
#: Lines with more tokens get the wider bitmap.
LONG = 96
#: Postings of a shuffle partition, at most about; bounds the hash tables in which lists meet.
PARTITION_ROWS = 1_000_000

_NO_ID = -(1 << 63)
#: Bits of a line's key that count lines.
_LINE_BITS = 30
_KEY = ["d", "h", "t"]
_ROW = ["id", "np", "bm", "w0", "w1"]
_PAIR = ["x", "y"]
#: A document's key.
_DOC = ["d", "h", "u"]


def _blanked(text: Column) -> Column:
    """Other blanks than newlines become spaces; texts without any, nearly all, are not copied."""
    odd = ["\t", "\x0b", "\x0c", "\r"]
    found = F.contains(text, F.lit(odd[0]))
    for c in odd[1:]:
        found = found | F.contains(text, F.lit(c))
    return F.when(found, F.translate(text, "".join(odd), "    ")).otherwise(text)


def _hashes(line: Column) -> Column:
    """Distinct hashes of a blanked line's tokens: splitting at one character is far cheaper than at a class."""
    return F.array_except(F.transform(F.split(line, " "), lambda t: F.xxhash64(t)), F.array(F.xxhash64(F.lit(""))))


def _held(df: DataFrame, **computed: Column) -> DataFrame:
    """Adds columns that are computed once: what stands behind a generator is not copied into the expressions that use it."""
    for name, c in computed.items():
        df = df.withColumn(f"__{name}", c)
        df = df.select(*(x for x in df.columns if x != f"__{name}"), F.explode(F.array(f"__{name}")).alias(name))
    return df


def _doc_key() -> list[Column]:
    """d, h and u of a row of documents."""
    return [F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), F.xxhash64("text").alias("h"), F.call_function("shiftright", F.xxhash64(F.lit(11), "text"), F.lit(_LINE_BITS)).alias("u")]


def _line_key(u: Column, ln: Column) -> Column:
    return F.call_function("shiftleft", u, F.lit(_LINE_BITS)).bitwiseOR(ln.cast("long")).alias("t")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(*_doc_key(), _blanked(F.col("text")).alias("text"))


def _lines(docs: DataFrame) -> DataFrame:
    """(d, h, t, line)"""
    rows = _keyed(docs).select(*_DOC, F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return rows.select("d", "h", _line_key(F.col("u"), F.col("ln")), "line")


def _places(keys: DataFrame, *more: str) -> DataFrame:
    """(d, h, u, lns) from line keys; lns are line numbers, or structs of them and more columns."""
    at = keys.select("d", "h", F.call_function("shiftright", F.col("t"), F.lit(_LINE_BITS)).alias("u"), F.col("t").bitwiseAND(F.lit((1 << _LINE_BITS) - 1)).cast("int").alias("ln"), *more)
    return at.groupBy(*_DOC).agg(F.collect_set(F.struct("ln", *more) if more else "ln").alias("lns"))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(d, h, t, hashes) of the lines that have tokens."""
    return _held(_lines(docs), hashes=_hashes(F.col("line"))).where(F.size("hashes") > 0).select(*_KEY, "hashes")


def ranks(hashed: DataFrame) -> list[int]:
    """Rarity of each hash bucket: the logarithm, in eighths of a bit, of its number of tokens in all lines."""
    counts = hashed.select(F.explode("hashes").alias("x")).groupBy(F.col("x").bitwiseAND(F.lit(RANK_BUCKETS - 1)).alias("b")).agg(F.count("*").alias("n"))
    out = [0] * RANK_BUCKETS
    for row in counts.collect():  # RANK_BUCKETS rows at most
        out[row.b] = min(511, int(8 * math.log2(row.n + 1)))
    return out


def token_sets(hashed: DataFrame, rank: list[int]) -> DataFrame:
    """(d, h, t, toks): distinct tokens, rarest first, as ranks over the upper 48 bits of hashes. The ranks are one constant of the plan."""
    table = F.from_json(F.lit(json.dumps([r << 48 for r in rank], separators=(",", ":"))), "array<bigint>")
    code = lambda x: F.get(table, x.bitwiseAND(F.lit(RANK_BUCKETS - 1)).cast("int")).bitwiseOR(F.shiftrightunsigned(x, 16))
    # Columns of a table may be null for all Spark knows; without that, it sorts plain longs.
    return _held(hashed, toks=F.sort_array(F.transform("hashes", lambda x: F.coalesce(code(x), F.lit(0).cast("long"))))).select(*_KEY, "toks")


def _need(a: Column, b: Column) -> Column:
    """Least overlap of sets of sizes a and b at similarity 0.8: ceil(4 (a + b) / 9)."""
    return F.floor((4 * (a + b) + 8) / 9)


def _earlier(y: dict[str, Column], x: dict[str, Column]) -> Column:
    return y["id"] < x["id"]


def _index(s: dict[str, Column]) -> Column:
    """The posting is in the shorter prefix by which the smaller of two sets is found."""
    return s["p"] <= s["n"] - F.floor((8 * s["n"] + 8) / 9)


def _near(x: dict[str, Column], y: dict[str, Column], least: Column, most: Column) -> Column:
    """Filters on sizes (least, most: those of x and y), positions and bitmaps."""
    need = _need(x["n"], y["n"])
    part = lambda c: F.bit_count(x[c].bitwiseXOR(y[c]))
    rest = lambda s: s["bm"].bitwiseXOR(s["w0"]).bitwiseXOR(s["w1"])
    bits = F.when(least > LONG, part("w0") + part("w1") + F.bit_count(rest(x).bitwiseXOR(rest(y)))).otherwise(part("bm"))
    return (5 * least >= 4 * most) & (1 + F.least(x["n"] - x["p"] - 1, y["n"] - y["p"] - 1) >= need) & (bits <= x["n"] + y["n"] - 2 * need)


def _row(prefix: str = "") -> dict[str, Column]:
    """The columns of a posting; np packs the size n of its set and its place p."""
    np = F.col(f"{prefix}np")
    return {k: F.col(f"{prefix}{k}") for k in _ROW} | {"n": F.shiftright(np, 32).cast("int"), "p": np.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")}


def _solid(df: DataFrame) -> DataFrame:
    """Columns that cannot be null get no null filters, so all uses of a list share one exchange."""
    return df.select(*(F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in df.dtypes))


class _Join:
    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs.select("doc_id", "text")
        # Texts are split and hashed once: the table of hashes is counted, ordered by the counts, and goes before any lists are made.
        hashed = stash(hashed_lines(self.docs))
        self.rank = ranks(hashed)
        n = F.size("toks")
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        parity = lambda take: F.aggregate("toks", F.lit(0).cast("long"), lambda a, x: take(a, x))
        part = lambda k: F.when(n > LONG, parity(lambda a, x: F.when(x.bitwiseAND(F.lit(192)) == 64 * k, a.bitwiseXOR(bit(x))).otherwise(a))).otherwise(F.lit(0).cast("long")).alias(f"w{k}")
        # 31 bits are enough to meet by: what meets by chance is verified like the rest.
        prefix = F.transform(F.slice("toks", 1, n - F.floor((4 * n + 4) / 5).cast("int") + 1), lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
        t = token_sets(hashed, self.rank).select(
            *_KEY, n.alias("n"), F.xxhash64("toks").alias("s1"), F.xxhash64(F.lit(3), "toks").alias("s2"),
            parity(lambda a, x: a.bitwiseXOR(bit(x))).alias("bm"), part(0), part(1), prefix.alias("prefix"),
        )
        lines = stash(t)
        drop_stash(hashed)
        first = lines.groupBy("s1", "s2").agg(F.min(F.struct(*_KEY, "n", "bm", "w0", "w1", "prefix")).alias("f"), F.count("*").alias("times"))
        # Ranges of keys, sorted inside: numbers ascend with the keys. They are read from the table only, so they are the same for all that asks.
        self.sets = stash(first.select("s1", "s2", "times", "f.*").orderBy(*_KEY).withColumn("id", F.monotonically_increasing_id()))
        self.lines = stash(lines.select(*_KEY, "s1", "s2"))
        drop_stash(lines)

    def met(self) -> DataFrame:
        """Pairs of numbers out of lists of up to HOT postings, token null; and the postings of the other lists, x null."""
        rows = self.sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
        posted = self.sets.select("id", "n", "bm", "w0", "w1", F.posexplode("prefix").alias("p", "token"))
        posted = _solid(posted.select("token", "id", (F.col("n") * F.lit(1 << 32) + F.col("p")).alias("np"), "bm", "w0", "w1")).repartition(max(parts_for(posted), rows // PARTITION_ROWS), "token")
        # The tokens of long lists, at most one in HOT postings, are counted once and are a table for all uses of the lists.
        hot = stash(posted.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("token"))
        listed = posted.join(hot.withColumn("hot", F.lit(True)).hint("shuffle_hash"), "token", "left")
        cold = listed.where("hot is null").drop("hot")
        # The larger set meets the index prefix of the smaller. The filter names `hot` so that all lists are read from one exchange.
        found = listed.where(F.when(F.col("hot").isNull(), _index(_row())).otherwise(False)).select("token", *(F.col(k).alias(f"y_{k}") for k in _ROW))
        x, y = _row(), _row("y_")
        smaller = (y["n"] < x["n"]) | ((y["n"] == x["n"]) & _earlier(y, x))
        both = cold.join(found, "token").where(smaller & _near(x, y, y["n"], x["n"]))
        pairs = both.select(F.greatest("id", "y_id").alias("x"), F.least("id", "y_id").alias("y"))
        return stash(pairs.unionByName(listed.where("hot").select("token", *_ROW), allowMissingColumns=True))

    def _against(self, probes: DataFrame, posted: DataFrame) -> DataFrame:
        """Pairs of the probes and the earlier postings of their tokens that may match."""
        x, y = _row(), _row("y_")
        other = posted.select("token", *(F.col(k).alias(f"y_{k}") for k in _ROW))
        index = F.when(x["n"] > y["n"], _index(y)).when(x["n"] < y["n"], _index(x)).otherwise(_index(x) | _index(y))
        both = probes.join(other, "token").where(_earlier(y, x) & _near(x, y, F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])) & index)
        return both.select(x["id"].alias("x"), y["id"].alias("y"))

    def headed(self, hot: DataFrame) -> DataFrame:
        """Pairs of hot postings with the earliest of each share of their list."""
        share = F.pmod(F.xxhash64("id"), F.lit(HEADS))
        heads = hot.groupBy("token", share.alias("share")).agg(F.min(F.struct(*_ROW)).alias("head")).select("token", "head.*")
        return self._against(hot, heads)

    def tokens_of(self, ids: DataFrame, few: bool) -> DataFrame:
        """Numbers and toks of the sets with these numbers, from the texts. few: the places are a table first, and if it is small no text is shuffled."""
        places = _places(self.sets.select(*_KEY, "id").join(ids, "id", "left_semi"), "id")
        places = stash(places) if few else places.hint("shuffle_hash")
        cutout = _held(_keyed(self.docs).join(places, _DOC).select("text", "lns"), all=F.split("text", "\n"))
        line = cutout.select(F.explode(F.transform("lns", lambda n: F.struct(n["id"].alias("id"), F.get("all", n["ln"]).alias("line")))).alias("w"))
        return line.select("w.id", _hashes(F.col("w.line")).alias("toks")).dropDuplicates(["id"])

    def matched(self, pairs: DataFrame, few: bool = False) -> DataFrame:
        """Numbers of the sets x of which a pair has similarity 0.8 or more."""
        pairs = stash(pairs.select(*_PAIR).distinct())
        side = lambda s: pairs.select(F.col(s).alias("id"))
        toks = stash(self.tokens_of(side("x").union(side("y")), few))
        a, b = (toks.select(F.col("id").alias(s), F.col("toks").alias(f"{s}_toks")) for s in "xy")
        shared = F.size("x_toks") - F.size(F.array_except("x_toks", "y_toks"))  # one hash table a pair; an intersection takes two
        both = pairs.join(a, "x").join(b, "y").where(9 * shared >= 4 * (F.size("x_toks") + F.size("y_toks")))
        out = stash(both.select(F.col("x").alias("id")).distinct())
        drop_stash(pairs, toks)
        return out


def removed_lines(docs: DataFrame) -> DataFrame:
    """(d, h, u, removed): per document with lines to go, their numbers from 0; d is doc_id (null: the least long), h and u the key of its text."""
    j = _Join(docs)
    met = j.met()
    cold, hot = met.where("token is null").select(*_PAIR), met.where("token is not null").select("token", *_ROW)
    named = lambda pairs: pairs.select(F.col("x").alias("id"))
    short = stash(j.headed(hot).distinct())
    whole = j._against(hot.join(named(short), "id", "left_anti"), hot)
    gone = j.matched(cold.union(short).union(whole))
    refused = named(short).distinct().join(gone, "id", "left_anti")
    gone = gone.union(j.matched(j._against(hot.join(refused, "id", "left_semi"), hot), few=True))
    keys = j.sets.join(gone.withColumn("gone", F.lit(True)), "id", "left").where("gone or times > 1")
    keys = keys.select("s1", "s2", *(F.col(c).alias(f"f{c}") for c in _KEY), F.col("gone").isNotNull().alias("gone"))
    out = j.lines.select(*_KEY, "s1", "s2").join(keys, ["s1", "s2"]).where("gone or d <> fd or h <> fh or t <> ft")
    return _places(out.select(*_KEY)).select(*_DOC, F.sort_array("lns").alias("removed"))


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, comma-joined)."""
    out = removed_lines(docs)
    keyed = docs.select("doc_id", *_doc_key(), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    return keyed.join(out, _DOC, "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"))


def without_removed(docs: DataFrame) -> DataFrame:
    """The rows of docs with the removed lines cut from text; a document left without words by it goes."""
    keys = [f"__line_{c}" for c in _DOC]
    out = removed_lines(docs).select(*(F.col(c).alias(k) for c, k in zip(_DOC, keys, strict=True)), F.col("removed").alias("__line_gone"))
    keyed = docs.withColumns(dict(zip(keys, _doc_key(), strict=True)))
    # Numbers that stay, by one set difference: the work is linear in the lines of a text, however many go.
    cut = _held(keyed.join(out, keys, "left"), __line_all=F.when(F.col("__line_gone").isNotNull(), F.split("text", "\n")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__line_all") - 1), "__line_gone"), lambda i: F.get("__line_all", i))
    joined = cut.withColumn("__line_kept", F.when(F.col("__line_gone").isNotNull(), kept))
    text = F.coalesce(F.array_join("__line_kept", "\n"), F.col("text"))
    return joined.where(F.col("__line_kept").isNull() | F.exists("__line_kept", lambda line: line.rlike(r"[^\x20\x09-\x0D]"))).select(*(text.alias("text") if c == "text" else c for c in docs.columns))
