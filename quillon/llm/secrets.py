"""Secret scans: fixed patterns, and sliding-window Shannon entropy with an allow-list.

A candidate string is a run of token characters. Each of the character classes
is scanned on its own with a window of fixed width whose entropy is kept by
incremental counts; windows at or over the class's threshold make an "entropy"
span unless an allow-list rule explains the string. Base spans are never
suppressed. Offsets are code points, end exclusive; null and empty: no spans.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame

from quillon.llm.batches import map_texts

KINDS = ("assign", "access", "hex")
ENTROPY = "entropy"

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Width of the sliding window in characters.
WINDOW = 20
#: By class, narrowest first: its characters and the least entropy in bits of a window.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]{20,}"), 3.0),
    ("alnum", re.compile(r"[0-9A-Za-z]{20,}"), 3.7),
    ("base64", re.compile(r"[0-9A-Za-z+/_=-]{20,}"), 3.9),
)
_CANDIDATE = re.compile(r"[0-9A-Za-z+/_=-]{20,}")
_DIGIT, _LOWER, _UPPER = re.compile(r"[0-9]"), re.compile(r"[a-z]"), re.compile(r"[A-Z]")
#: Strings that look random but are no secret.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"[0-9_=+/-]+"),  # numbers, dates, rules
    re.compile(r"[A-Za-z_=+/-]+"),  # words, paths, identifiers without a digit
    re.compile(r"(?:[A-Za-z]+[/_-]){2,}[A-Za-z]*[0-9]{0,4}"),  # paths and slugs
    re.compile(r"[A-Za-z_/=+-]+[0-9]{1,4}"),  # a numbered name
)
#: Parts of a string that are there to be replaced: what is left beside them is judged by itself.
_PLACEHOLDER = re.compile(r"(?i:0123456789abcdef|abcdefghij|example|placeholder|changeme|x{6,})")
_CLOG = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def window_entropies(s: str, width: int = WINDOW) -> list[float]:
    """Shannon entropy in bits of each window of `width` characters, by incremental counts."""
    if len(s) < width:
        return []
    clog = _CLOG if width == WINDOW else [0.0, *(c * math.log2(c) for c in range(1, width + 1))]
    counts: dict[str, int] = {}
    total = 0.0
    out = []
    top = math.log2(width)
    for i, ch in enumerate(s):
        n = counts.get(ch, 0)
        counts[ch] = n + 1
        total += clog[n + 1] - clog[n]
        if i >= width:
            old = s[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += clog[n - 1] - clog[n]
        if i >= width - 1:
            out.append(top - total / width)
    return out


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """(start, string) of the strings to be scanned: candidates that no allow-list rule explains, without placeholders in them."""
    for cand in _CANDIDATE.finditer(text):
        if any(rule.fullmatch(cand[0]) for rule in ALLOWED):
            continue
        at = cand.start()
        for stop in [*_PLACEHOLDER.finditer(cand[0]), None]:
            end = cand.start() + stop.start() if stop else cand.end()
            if end - at >= WINDOW:
                yield at, text[at:end]
            at = cand.start() + stop.end() if stop else at


def entropy_spans(text: str) -> list[tuple[str, int, int]]:
    """Maximal unions of high-entropy windows of the candidates."""
    found = []
    for start, s in candidates(text):
        if not _DIGIT.search(s) or not (_LOWER.search(s) or _UPPER.search(s)):
            continue
        spans = []
        for _, chars, least in CLASSES:
            for run in chars.finditer(s):
                if _DIGIT.search(run[0]):
                    spans += [start + run.start() + i for i, h in enumerate(window_entropies(run[0])) if h >= least]
        merged: list[tuple[int, int]] = []
        for a in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], a + WINDOW)
            else:
                merged.append((a, a + WINDOW))
        found += [(ENTROPY, a, b) for a, b in merged]
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind."""
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=_by_start)


_RANK = {k: i for i, k in enumerate((*KINDS, ENTROPY))}


def _by_start(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], _RANK[span[0]], span[2]


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those with entropy spans that no base span covers."""
    base = base_spans(text)
    first, reach = [a for _, a, _ in base], list(accumulate((b for _, _, b in base), max))  # how far base spans that start no later go
    more = [s for s in entropy_spans(text) if not (at := bisect_right(first, s[1])) or reach[at - 1] < s[2]]
    return base, sorted([*base, *more], key=_by_start) if more else base


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_<kind> of base spans, base spans and all spans as kind:start:end lists. One row per input row.

    Null and empty texts have no spans; null keys and repeated rows give a row
    each, an empty table none. Other columns, whatever their names, are not
    read. Work grows with a text's length, however long.
    """

    def run(texts: list) -> list[list]:
        rows = []
        for t in texts:
            base, every = find_spans(t) if t else ([], [])
            n = {k: 0 for k in KINDS}
            for k, _, _ in base:
                n[k] += 1
            rows.append([*n.values(), *(",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in (base, every))])
        return [list(c) for c in zip(*rows, strict=True)]

    schema = ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string"
    return map_texts(df, [key], text, run, schema)
