"""Repeated byte strings by suffix sorting.

Every byte that a LENGTH-byte string covers goes, if that string also starts anywhere else in the corpus; matches never
cross documents. Candidates come from anchors (see repeats); the contexts of one recurring gram are then decided by the
order of their suffixes from the anchor on, sorted deep-shallow: a multikey quicksort over 8-byte characters to SHALLOW
bytes, and for each group that still agrees a blind trie (branching positions only, one full comparison an insertion),
which yields order and common prefixes at once. A context's window that begins d bytes before the anchor starts elsewhere
too, if some suffix under a trie node of depth LENGTH - d or more is preceded by the same d bytes: node by node, members
are put in the order of what precedes them and neighbours compared.

A second pass with SHORT bytes marks shorter passages that repeat, of some forty words, without removing them: n_short
counts the bytes they cover. It is the same search with another length.

Defined results: null text is empty; a text shorter than LENGTH keeps all its bytes; repeated rows are repeats of each
other. Texts are their UTF-8 bytes; the operator that returns text drops what is left of a cut character. A text of any
length is read whole, alone in its slice; an empty table gives no rows; only doc_id and text are looked at, and results have no other columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import BYTE_CODES, covered, map_text, sha256_hex, utf8
from .repeats import Context, Tokens, with_spans

LENGTH = 400
GRAM = 200
#: Length of strings whose repeats are counted only, and the gram that anchors them.
SHORT, SHORT_GRAM = 256, 64
SHALLOW = 32


def shallow_groups(starts: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """Multikey quicksort of the suffixes at `starts`, 8 bytes a character, to SHALLOW bytes: groups of equal ones, in order.

    `data` is padded with SHALLOW bytes. A level sorts all unsettled suffixes by (group, character) at once.
    """
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, SHALLOW, 8):
        at = starts[order] + depth
        char = np.zeros(len(order), np.uint64)
        for k in range(8):
            char = (char << np.uint64(8)) | data[at + k]
        by = np.lexsort((char, group))
        order, group, char = order[by], group[by], char[by]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (char[1:] != char[:-1])
        group = np.cumsum(new)
        # Suffixes that are alone have found their place.
        alone = new & np.append(new[1:], True)
        order, group = order[~alone], group[~alone]
    return np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else []


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix; the first `at` bytes are known to agree."""
    lo, hi = at, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


@dataclass
class Node:
    """A branching point of a blind trie: only the depth and the bytes that differ there; key -1 is a string's end."""

    depth: int
    children: dict[int, Node | int] = field(default_factory=dict)


def _key(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_trie(strings: list[bytes]) -> Node | int:
    """Trie over the numbers of distinct strings. An insertion goes down by branching bytes alone, compares once, then splits."""
    root: Node | int = 0
    for i in range(1, len(strings)):
        s, path, at = strings[i], [], root
        while isinstance(at, Node):
            path.append(at)
            key = _key(s, at.depth)
            at = at.children[key] if key in at.children else next(iter(at.children.values()))
        other = strings[at]
        n = common(s, other)
        parent = None
        for node in path:
            if node.depth >= n:
                break
            parent = node
        below = root if parent is None else parent.children[_key(s, parent.depth)]
        if isinstance(below, Node) and below.depth == n:
            below.children[_key(s, n)] = i
            continue
        node = Node(n, {_key(other, n): below, _key(s, n): i})
        if parent is None:
            root = node
        else:
            parent.children[_key(s, parent.depth)] = node
    return root


def deep_groups(strings: list[bytes]) -> list[tuple[int, list[int]]]:
    """(common prefix, members) of every trie node, and of every set of equal strings, in suffix order within a node."""
    equal: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        equal.setdefault(s, []).append(i)
    distinct = list(equal)
    out = [(len(s), m) for s, m in equal.items() if len(m) > 1]
    root = blind_trie(distinct)
    if isinstance(root, int):
        return out
    under: dict[int, list[int]] = {}
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo += [(c, False) for c in node.children.values() if isinstance(c, Node)]
            continue
        members = []
        for k in sorted(node.children):
            c = node.children[k]
            members += under.pop(id(c)) if isinstance(c, Node) else equal[distinct[c]]
        under[id(node)] = members
        out.append((node.depth, members))
    return out


def resolve(shard: list[Context], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(context, first, last) window starts such that the union of these windows is all that recurs in the context."""
    data = np.frombuffer(b"".join(c.data for c in shard) + bytes(SHALLOW), np.uint8)
    begin = np.cumsum([0, *(len(c.data) for c in shard)])[:-1]
    out = []
    for group in shallow_groups(begin + np.array([c.anchor for c in shard]), data):
        members = [shard[i] for i in group]
        before = [c.data[: c.anchor][::-1] for c in members]
        most, least = [-1] * len(members), [length] * len(members)
        for depth, inside in deep_groups([c.data[c.anchor :] for c in members]):
            order = sorted(inside, key=before.__getitem__)
            match = [common(before[a], before[b]) for a, b in zip(order, order[1:], strict=False)]
            for k, i in enumerate(order):
                left = max(match[k - 1] if k else 0, match[k] if k < len(match) else 0)
                if left >= length - depth:
                    most[i], least[i] = max(most[i], left), min(least[i], max(0, length - depth))
        out += [(int(group[i]), c.anchor - most[i], c.anchor - least[i]) for i, c in enumerate(members) if most[i] >= 0 and c.times == 1]
    return out


TOKENS = Tokens(
    read=lambda data, offsets: (BYTE_CODES[data], offsets, None),
    cut=lambda data, _, a, b: data[a:b].tobytes(),
    window=LENGTH,
    gram=GRAM,
    slice_bytes=1 << 20,
    resolve=resolve,
    hashes=lambda data: BYTE_CODES[np.frombuffer(data, np.uint8)],
)
SHORT_TOKENS = replace(TOKENS, window=SHORT, gram=SHORT_GRAM, resolve=lambda shard: resolve(shard, SHORT))

FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("n_short", T.LongType()), T.StructField("kept", T.StringType())]


def dedup(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, the counts, kept_sha256 of the remaining bytes, and these as text (kept)."""

    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in FIELDS}
        data, offsets = utf8(batch.column("text"))
        for k, (spans, more) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("more").to_pylist(), strict=True)):
            own = data[offsets[k] : offsets[k + 1]]
            mask = lambda xs, n=len(own): covered(n, np.array([s["a"] for s in xs]), np.array([s["b"] for s in xs])) if xs else np.zeros(n, bool)
            gone = mask(spans)
            out["n_short"].append(int(mask(more).sum()))
            rest = own[~gone].tobytes()
            out["n_bytes"].append(len(own))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            out["kept_sha256"].append(sha256_hex(rest))
            out["kept"].append(rest.decode(errors="ignore") if keep_text else None)
        return out

    return map_text(with_spans(docs, TOKENS, SHORT_TOKENS), kernel, FIELDS, ["doc_id"])


def op1(docs: DataFrame) -> DataFrame:
    return dedup(docs, keep_text=False).drop("kept")
