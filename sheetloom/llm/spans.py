"""Span bookkeeping that the personal-data and secret detectors share."""

from __future__ import annotations

from bisect import bisect_left

from .common import sha256_hex

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then by the place of the kind in `kinds`; comma-joined."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], order[s[0]], s[2])))


def digest(spans: list[Span], kinds: list[str]) -> str:
    return sha256_hex(joined(spans, kinds).encode())


def union(spans: list[Span]) -> list[tuple[int, int]]:
    """Disjoint stretches that the spans cover, in order; stretches that only touch stay apart."""
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def free(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of `spans` that overlap none of `taken`: one look-up among the stretches that these cover."""
    held = union(taken)
    starts = [a for a, _ in held]

    def clear(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or held[k - 1][1] <= a

    return [s for s in spans if clear(s[1], s[2])]


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the first stands for all."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
