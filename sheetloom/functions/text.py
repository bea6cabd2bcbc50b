"""String functions, Column to Column, inside the JVM unless said otherwise.

Java's \\s, \\d and \\w are ASCII unless (?U) is set; patterns that must see full-width blanks or digits set it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, format-code grammar, protected strings, marks, transliterations, as the data model names them.
CYRILLIC = r"[\u0400-\u04FF]"
JAPANESE = r"[\u3040-\u30FF\u4E00-\u9FFF\uFF66-\uFF9F]"
FORMAT_CODE = r"(\\[fF][^;]*;|\\[HWCTQApX][^;]*;|\\S[^;]*;|\\[LlOoKk]|\\P|\\~|\\\\|\\\{|\\\}|\{|\}|%%[cCdDpPuUoO]|%%\d{3})"
PLAIN_CODE = r"(%%[cCdDpPuUoO]|%%\d{3})"
DIMENSION_CODE = r"(%%[cCdDpPuUoO]|%%\d{3}|<>)"
MARK = r"\u27E6(\d+)\u27E7"
#: One piece of a string of numbers and units. A repeated group would recurse once a piece, too deep for long lines; %%DN and %%PN are signs before a unit.
PROTECTED_PIECE = r"(?U)%%(?:[DP]N|[cCdDpPuUoO])|[-+±.,:/\d\s×xX*#°'\"()\[\]φΦ@=<>~_]+|%|mm|cm|m|kg|kN|MPa|Hz|V|A|W|kW|kVA|Ø|DN|PN|№"
GRID_CODE = r"(?U)^\s*(?:[А-ЯЁ]|[А-ЯЁ]{1,2}\d{1,3})\s*$"
ELEMENT_MARK = r"(?U)^\s*[А-ЯЁ]{1,3}-?\d+(?:[.,]\d+)*[а-яё*]?\s*$"
JAPANESE_NAME = r"(?<![\u4E00-\u9FFF])[\u4E00-\u9FFF]{1,3}[ \u3000][\u4E00-\u9FFF]{1,3}(?![\u4E00-\u9FFF])"
SHEET_NUMBER = r"(?U)^\s*([A-Z]{1,3})\s*[-‐−ー–]\s*(\d{1,3})\s*$"
FRAME_WORDS = ["図枠", "図面枠", "frame", "border", "рамк", "титул"]
STANDARDS = [("ГОСТ Р", "GOST R"), ("ГОСТ", "GOST"), ("СНиП", "SNiP"), ("СанПиН", "SanPiN"), ("СП", "SP"), ("ТУ", "TU"), ("ПУЭ", "PUE"), ("ППБ", "PPB"), ("НПБ", "NPB"), ("РД", "RD"), ("АР", "AR"), ("ОВ", "OV"), ("ВК", "VK"), ("ЭОМ", "EOM"), ("ЭО", "EO"), ("ЭМ", "EM"), ("ИОС", "IOS"), ("ПОС", "POS"), ("КЖ", "KZh"), ("КМ", "KM"), ("ГП", "GP"), ("ТХ", "TKh"), ("СС", "SS"), ("ПЗ", "PZ"), ("ПБ", "PB"), ("ИТП", "ITP"), ("ГКЛ", "GKL"), ("ПВХ", "PVC")]
CODEPAGE_SHIFTS = [0x17A, 0x109, 0xFA]

_BLANKS = "(?U)^\\s+|\\s+$"


def bound(f: Callable[..., Column], *cols: Column) -> Column:
    """f of the columns, each computed once: what stands in a lambda is otherwise computed again for every element."""
    held = F.array(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(cols))))
    return F.get(F.transform(held, lambda z: f(*(z[f"c{i}"] for i in range(len(cols))))), F.lit(0))


def strip(s: Column) -> Column:
    """Trim of all Unicode blanks."""
    return F.regexp_replace(s, _BLANKS, "")


def detect_lang(s: Column) -> Column:
    """ru before ja before en, by the mere presence of a character of the script; else none."""
    return F.when(s.rlike(CYRILLIC), "ru").when(s.rlike(JAPANESE), "ja").when(s.rlike("[A-Za-z]"), "en").otherwise("none")


def is_protected(s: Column) -> Column:
    """Made of numbers, signs and units alone."""
    return (s != "") & (F.regexp_replace(s, PROTECTED_PIECE, "") == "")


def is_translatable(kind: Column, plain: Column, lang: Column, sources: list[str]) -> Column:
    """Not blank, no grid code or element mark, not only numbers and units (dimensions are exempt), of a source language."""
    code = plain.rlike(GRID_CODE) | plain.rlike(ELEMENT_MARK)
    return (strip(plain) != "") & ~code & ((kind == "DIMENSION") | ~is_protected(plain)) & lang.isin(sources)


def codes(s: Column, pattern: str = FORMAT_CODE) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(1))


def mask(s: Column, pattern: str = FORMAT_CODE) -> Column:
    """The i-th code becomes a numbered marker; codes() has what they stood for."""
    def put(parts: Column, last: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p, i: F.when(i < last, F.concat(p, F.lit("⟦"), (i + 1).cast("string"), F.lit("⟧"))).otherwise(p)), "")

    return bound(lambda parts: bound(put, parts, F.size(parts) - 1), F.split(s, pattern, -1))


def marker_ids(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(MARK), F.lit(1)), lambda x: x.cast("int"))


def unmask(s: Column, held: Column) -> Column:
    """Each marker is put back once; unknown and repeated ones go; codes that lost theirs go first, closing braces last."""
    def fill(parts: Column, first: Column, held: Column) -> Column:
        # first: for every marker its number if it is the first of that number, else 0; the piece before it takes the code.
        return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(held, F.nullif(F.get(first, i), F.lit(0)) - 1), F.lit("")))), "")

    def whole(ids: Column, parts: Column, held: Column) -> Column:
        # The least place of each number, by sorting (number, place) once.
        order = F.array_sort(F.transform(ids, lambda n, i: F.struct(n.alias("n"), i.alias("i"))))
        heads = bound(lambda o: F.filter(o, lambda z, k: (k == 0) | (F.get(o, k - 1)["n"] != z["n"])), order)
        at = F.map_from_entries(F.transform(heads, lambda z: F.struct(z["i"], z["n"])))
        return bound(lambda seen: bound(lambda first: fill(parts, first, held), F.transform(ids, lambda n, i: F.coalesce(F.try_element_at(seen, i), F.lit(0)))), at)

    def lost(held: Column, ids: Column) -> Column:
        gone = F.array_except(F.transform(held, lambda c, i: i + 1), ids)
        codes = bound(lambda h, g: F.transform(g, lambda i: F.get(h, i - 1)), held, gone)
        return F.struct(F.array_join(F.filter(codes, lambda c: c != "}"), "").alias("open"), F.array_join(F.filter(codes, lambda c: c == "}"), "").alias("close"))

    def put(ids: Column, parts: Column, held: Column) -> Column:
        return bound(lambda sides, text: F.concat(sides["open"], text, sides["close"]), lost(held, ids), whole(ids, parts, held))

    return bound(put, marker_ids(s), F.split(s, MARK, -1), held)


def markers_ok(source: Column, target: Column) -> Column:
    """Equal multisets of markers."""
    return F.array_sort(marker_ids(source)) == F.array_sort(marker_ids(target))


def display_text(s: Column) -> Column:
    return F.regexp_replace(s, MARK, "")


def strip_edges(s: Column) -> Column:
    """struct(pre, core, suf): markers at both ends split off; with no core left, the whole string is the core."""
    run = r"(?:\u27E6\d+\u27E7\s*)*"
    pre, suf = F.regexp_extract(s, f"^({run})", 1), F.regexp_extract(s, r"((?:\s*\u27E6\d+\u27E7)*)$", 1)
    core = F.substring(s, F.length(pre) + 1, F.length(s) - F.length(pre) - F.length(suf))
    empty = (F.length(pre) + F.length(suf) >= F.length(s)) | (strip(core) == "")
    return F.struct(F.when(empty, "").otherwise(pre).alias("pre"), F.when(empty, s).otherwise(core).alias("core"), F.when(empty, "").otherwise(suf).alias("suf"))


def clean_answer(s: Column, cjk: bool = False) -> Column:
    if cjk:
        return strip(s)
    return strip(F.array_join(F.transform(F.split(F.replace(s, F.lit("\u3000"), F.lit(" ")), "\n"), strip), "\n"))


def mock_translate(s: Column, lang: str = "EN") -> Column:
    """Every non-blank piece between markers in a pair of tags."""
    parts, marks = F.split(s, MARK, -1), F.regexp_extract_all(s, F.lit(r"(\u27E6\d+\u27E7)"), F.lit(1))
    tag = lambda p: F.when(strip(p) == "", p).otherwise(F.concat(F.lit(f"[{lang}]"), p, F.lit(f"[/{lang}]")))
    return bound(lambda ps, ms: F.array_join(F.transform(ps, lambda p, i: F.concat(tag(p), F.coalesce(F.get(ms, i), F.lit("")))), ""), parts, marks)


def place_name(place: Column) -> Column:
    named = F.when(place == "model", F.lit("model space")).otherwise(F.coalesce(place, F.lit("")))
    for prefix, word in (("page:", "page "), ("paper:", "sheet "), ("block:", "block ")):
        named = F.when(place.startswith(prefix), F.concat(F.lit(word), F.substring(place, len(prefix) + 1, 1 << 20))).otherwise(named)
    return named


def place_order(name: Column) -> list[Column]:
    """Pages by number first, then the rest by name."""
    page = F.regexp_extract(name, r"^page (\d+)$", 1)
    return [(page == "").asc(), F.try_to_number(page, F.lit("999999999")).asc(), name.asc()]


def join_lines(parts: Column, lang: Column) -> Column:
    trimmed = F.transform(parts, strip)
    return F.when(lang.isin("ja", "zh"), F.array_join(trimmed, "")).otherwise(F.array_join(trimmed, " "))


def name_note(lang: Column, source: Column) -> Column:
    return F.when((lang == "ja") & source.rlike(JAPANESE_NAME), "name reading unverified").otherwise("")


def excerpt(s: Column, n: int = 40) -> Column:
    return F.substring(F.replace(strip(s), F.lit("\n"), F.lit(" ")), 1, n)


def ascii_forms(s: Column) -> Column:
    """Full-width ASCII, the ideographic blank and middle dots to their plain forms."""
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.translate(s, full + "\u3000・･", "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ··")


def nfkc(s: Column) -> Column:
    """No built-in normalises Unicode; one Arrow batch at a time."""
    import pandas as pd

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(s)


def latinize(s: Column) -> Column:
    """For Latin-script output: compatibility forms, bullets, dashes, then names of standards as whole words."""
    out = F.translate(nfkc(s), "・･", "··")
    out = F.regexp_replace(out, r"(?m)^([^\S\n]*)[·•]\s*", "$1- ")
    out = F.translate(out, "〜～", "––")
    for name, latin in STANDARDS:
        out = F.regexp_replace(out, rf"(?U)(?<![А-Яа-яЁё\w]){name}(?![А-Яа-яЁё])", latin)
    return out


def mtext_plain(raw: Column) -> Column:
    """Line codes to newlines, blanks to blanks, escapes to themselves, all else of the grammar away."""
    out = F.regexp_replace(raw, r"\\[fFHWCTQApXS][^;]*;|\\[LlOoKk]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\\P", "\n"), r"\\~", "\u00a0")
    return F.regexp_replace(F.regexp_replace(out, r"(?<!\\)[{}]", ""), r"\\([\\{}])", "$1")


def mtext_width_factor(raw: Column) -> Column:
    """The first width code outside braces; 1 without one or at 0."""
    flat = raw
    for _ in range(8):
        flat = F.regexp_replace(flat, r"\{[^{}]*\}", "")
    w = F.regexp_extract(flat, r"\\W([0-9.]+);", 1).try_cast("double")
    return F.when(w > 0, w).otherwise(1.0)


def narrow_mtext(raw: Column, factor: Column) -> Column:
    """Scales every width code by factor, or puts one first; within 1 % of 1 nothing changes."""
    parts, found = F.split(raw, r"\\W[0-9.]+;", -1), F.regexp_extract_all(raw, F.lit(r"\\W([0-9.]+);"), F.lit(1))
    number = lambda v: F.regexp_replace(F.format_string("%.4f", v), r"\.?0+$", "")
    code = lambda v: F.concat(F.lit("\\W"), number(v), F.lit(";"))
    scaled = bound(lambda ps, fs, by: F.array_join(F.transform(ps, lambda p, i: F.concat(p, F.when(i < F.size(fs), code(F.get(fs, i).try_cast("double") * by)).otherwise(""))), ""), parts, found, factor)
    return F.when(F.abs(factor - 1) <= 0.01, raw).when(F.size(found) > 0, scaled).otherwise(F.concat(code(factor), raw))


def swap_fonts(raw: Column, face: str, fine: list[str]) -> Column:
    """struct(text, swapped): inline fonts to `face`, unless a name holds one of `fine`."""
    pattern = r"\\[fF]([^;|]*)([^;]*;)"
    parts, names, tails = F.split(raw, r"\\[fF][^;]*;", -1), F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)), F.regexp_extract_all(raw, F.lit(pattern), F.lit(2))
    keep = lambda n: F.exists(F.array(*(F.lit(x) for x in fine)), lambda x: F.contains(F.lower(n), F.lower(x)))
    code = lambda n, tail: F.concat(F.lit("\\f"), F.when(keep(n), n).otherwise(face), tail)
    text = bound(lambda ps, ns, ts: F.array_join(F.transform(ps, lambda p, i: F.concat(p, F.coalesce(code(F.get(ns, i), F.get(ts, i)), F.lit("")))), ""), parts, names, tails)
    return F.struct(text.alias("text"), F.size(F.filter(names, lambda n: ~keep(n))).alias("swapped"))


def simplify_mtext(raw: Column) -> Column:
    """Neutral code page in font codes, then font codes that repeat the font in force go, with a stack of brace scopes."""
    tokens = F.regexp_extract_all(F.regexp_replace(raw, r"(\\[fF][^;]*\|c)\d+", "$10"), F.lit(r"((?s)\\[fF][^;]*;|\\.|\{|\}|[^\\{}]+|\\)"), F.lit(1))
    start = F.struct(F.lit("").alias("out"), F.array(F.lit("")).alias("stack"))

    def step(a: Column, t: Column) -> Column:
        top = F.element_at(a["stack"], -1)
        rest = F.slice(a["stack"], 1, F.greatest(F.size(a["stack"]) - 1, F.lit(0)))
        font = t.rlike(r"^\\[fF][^;]*;$")
        stack = F.when(t == "{", F.array_append(a["stack"], top)).when((t == "}") & (F.size(a["stack"]) > 1), rest).when(font, F.array_append(rest, t)).otherwise(a["stack"])
        return F.struct(F.concat(a["out"], F.when(font & (t == top), "").otherwise(t)).alias("out"), stack.alias("stack"))

    return F.coalesce(F.aggregate(tokens, start, step)["out"], F.lit(""))


def repad(source: Column, target: Column) -> Column:
    """Spacing of a `label   value` row rebuilt at the source's offsets; only if both have as many parts."""
    gap = r"[ \u3000]{3,}"
    heads, new = F.split(source, gap, -1), F.transform(F.split(strip(target), r"[ \u3000]{2,}", -1), strip)
    gaps = F.regexp_extract_all(source, F.lit(f"({gap})"), F.lit(1))

    def build(heads: Column, gaps: Column, new: Column) -> Column:
        # Each part is padded on its own: what it takes up is where it begins less where the one before ended.
        step = lambda i: F.length(F.get(heads, i - 1)) + F.length(F.get(gaps, i - 1))
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        end = F.aggregate(
            F.sequence(F.lit(0), F.size(new) - 1), start,
            lambda a, i: bound(lambda at, out, p: F.struct(F.when(i == 0, p).otherwise(F.concat(out, F.repeat(F.lit(" "), F.greatest(F.lit(1), at - F.length(out))), p)).alias("out"), at.alias("at")), F.when(i == 0, 0).otherwise(a["at"] + step(i)), a["out"], F.get(new, i)),
        )
        return end["out"]

    return F.when((F.size(gaps) > 0) & (F.size(new) == F.size(gaps) + 1), bound(build, heads, gaps, new)).otherwise(target)


def script_runs(s: Column) -> Column:
    """Maximal runs of CJK and other characters: array of struct(text, cjk)."""
    wide = r"[\u3000-\u30FF\u4E00-\u9FFF\uFF00-\uFFEF]"
    found = F.regexp_extract_all(s, F.lit(f"({wide}+|[^{wide[1:-1]}]+)"), F.lit(1))
    return F.transform(found, lambda t: F.struct(t.alias("text"), t.rlike(f"^{wide}").alias("cjk")))


def _codepoints(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), F.ascii)


def codepage_shift(s: Column) -> Column:
    """The constant by which a string's Cyrillic was shifted; 0 if none explains half of its upper characters."""
    high = F.filter(_codepoints(s), lambda o: o > 0x7E)
    n = F.size(high)
    good = lambda d: F.size(F.filter(high, lambda o: (o - d >= 0xC0) & (o - d <= 0xFF)))
    best = F.array_max(F.array(*(F.struct(good(d).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(CODEPAGE_SHIFTS))))
    cyrillic = F.size(F.filter(high, lambda o: (o >= 0x400) & (o <= 0x4FF)))
    return F.when((n == 0) | (2 * cyrillic > n), 0).when(best["n"] >= F.greatest(F.lit(1), F.floor(n / 2)), best["d"]).otherwise(0)


def decode_shift(s: Column) -> Column:
    """Undoes codepage_shift: code points back by the shift, read as windows-1251."""
    upper = bytes(range(0x80, 0x100)).decode("cp1251", "replace")

    def undone(d: Column, chars: Column) -> Column:
        moved = lambda c: F.ascii(c) - d
        return F.transform(chars, lambda c: F.when((F.ascii(c) > 0x7E) & (moved(c) >= 0x80) & (moved(c) <= 0xFF), F.substr(F.lit(upper), moved(c) - 0x7F, F.lit(1))).otherwise(c))

    d = codepage_shift(s)
    return F.when(d == 0, s).otherwise(F.array_join(bound(undone, d, F.filter(F.split(s, ""), lambda c: c != "")), ""))


def sanity(s: Column) -> Column:
    """Share of characters that technical text in Latin or Cyrillic would have."""
    # The characters that count as sane.
    fine = r"[ -~\u0400-\u045F\u00A0\u00B0-\u00B3\u00B9\u00D7\u00F7\u00AB\u00BB\u2013\u2014\u2018\u2019\u201C\u201D\u2026\u2116\u2022\u2032\u2033\u2103\u2205\u00D8\u00F8\u2300]"
    return F.when(F.length(s) == 0, 1.0).otherwise((F.length(s) - F.length(F.regexp_replace(s, fine, ""))) / F.length(s))


def best_reading(candidates: list[Column]) -> Column:
    """The first reading with sanity of .97 or more, else the sanest, earlier ones first."""
    best = F.array_max(F.array(*(F.struct(F.when(sanity(c) >= 0.97, 2.0).otherwise(sanity(c)).alias("n"), F.lit(-i).alias("i"), c.alias("c")) for i, c in enumerate(candidates))))
    return best["c"]


def parse_answers(answer: Column) -> Column:
    """A model's answer to array of struct(id, target, note): fences off, outermost braces, strings or objects as values."""
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    flat = F.from_json(body, "map<string,string>")
    pair = lambda e: F.struct(e["key"].alias("id"), F.coalesce(F.get_json_object(e["value"], "$.t"), F.get_json_object(e["value"], "$.text"), e["value"]).alias("target"), F.coalesce(F.get_json_object(e["value"], "$.note"), F.lit("")).alias("note"))
    return F.transform(F.map_entries(flat), pair)


def strip_preview_fonts(raw: Column) -> Column:
    """For drawing: rich text with Japanese in it loses its font codes, so that a font with the glyphs is used."""
    return F.when(raw.rlike(JAPANESE), F.regexp_replace(raw, r"\\[fF][^;]*;", "")).otherwise(raw)


def cache_slug(parts: list[Column]) -> Column:
    """A file name from the parts of a cache key."""
    return F.regexp_replace(F.concat_ws("_", *parts), "[^0-9A-Za-z]+", "_")
