"""Personal data: base detectors, and offset-preserving deobfuscation before the same detectors.

A transducer rewrites disguises (homoglyphs, full-width, mathematical and other
compatibility forms, character references, spelled digits, "[at]"/"(dot)" and
the like) into plain characters and keeps, for each character
it writes, the span of source characters it stands for. The detectors run on the
source and on the rewritten text; spans of the latter are mapped back.

Offsets are code points, end exclusive. Null and empty texts give no spans.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable
from itertools import chain

from pyspark.sql import DataFrame

from quillon.llm.batches import map_texts

KINDS = ("email", "ip", "card", "phone")

_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits whose start could match, and no
# step back into a run can help, so both forms find what the plain ones find.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Look-alike letters of other scripts and the Latin letter each stands for.
_HOMOGLYPHS = dict(
    zip(
        "АВЕКМНОРСТХаеорсухіјѕԁѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν",
        "ABEKMHOPCTXaeopcyxijsdvABEZHIKMNOPTYXoav",
        strict=True,
    )
)
_INVISIBLE = "​‌‍⁠﻿­"
# Spelled digits from 0 to 9 in English, German, French and Spanish.
_SPELLED = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGITS = {w: str(i) for line in _SPELLED for i, w in enumerate(line.split())} | {"oh": "0"}
_WORD = "(?:" + "|".join(sorted(_DIGITS, key=lambda w: (-len(w), w))) + ")"
_RUN = rf"\b(?:(?i:plus)[\x20-])?(?i:{_WORD})(?:[\x20,-]{{1,2}}(?i:{_WORD}))*\b"
# Common last parts of host names, taken whatever stands before; words that are no host, and words that end none unless listed.
_TOP = "com|org|net|edu|gov|info|biz|io|ai|dev|app|co|uk|us|eu|de|fr|es|it|nl|ch|at|be|pl|ru|jp|cn|in|br|au|ca|mx"
_NO_HOST = "the|a|an|this|that|these|those|each|every|any|some|one|which|what|his|her|its|our|their|my|your"
_NO_TOP = "on|of|and|or|is|was|were|are|the|to|as|by|if|with|for|from|that|this|he|she|they|we|you|not|but|so"
_HOST = rf"(?:(?!(?i:{_NO_HOST})\b)[A-Za-z0-9-]{{1,63}}[\x20\t]{{1,3}}(?i:dot)[\x20\t]{{1,3}}){{1,4}}(?:(?i:{_TOP})|(?!(?i:{_NO_TOP})\b)[A-Za-z]{{2,24}})\b"


#: Characters that identifiers are made of.
_PLAIN = _LOCAL | frozenset("@()")


def _char_table() -> dict[str, str]:
    table: dict[str, str] = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.category(c) == "Nd":
            table[c] = str(unicodedata.digit(c))  # decimal digits of all scripts
        elif unicodedata.decomposition(c).startswith("<") and (plain := unicodedata.normalize("NFKC", c)) in _PLAIN and c not in "ªº":  # but ordinals of plain prose
            table[c] = plain
    return table | _HOMOGLYPHS | dict.fromkeys(_INVISIBLE, "") | {"。": ".", "‐": "-", "‑": "-"}


def _runs(chars: Iterable[str]) -> str:
    """Characters as ranges of a pattern's class: single ones beyond 16 bits are tried one by one."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


_CHARS = _char_table()
_BEYOND = re.compile(r"[^\x00-\x7F]")
_RULES = re.compile(
    r"(?P<char>(?![\x00-\x7F])[" + _runs(_CHARS) + "])"
    r"|(?P<code>&\#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});|&(?:commat|period);|%(?:40|2[EeBbDd]))"
    r"|(?P<at>[\x20\t]{0,3}[\[({<][\x20\t]{0,3}(?i:at|arroba|arobase)[\x20\t]{0,3}[\])}>][\x20\t]{0,3})"
    r"|(?P<dot>[\x20\t]{0,3}[\[({<][\x20\t]{0,3}(?i:dot|punto|point|punkt)[\x20\t]{0,3}[\])}>][\x20\t]{0,3})"
    rf"|(?P<at2>(?<=[A-Za-z0-9])[\x20\t]{{1,3}}(?i:at)[\x20\t]{{1,3}}(?={_HOST}))"
    r"|(?P<at3>(?<=[A-Za-z0-9])[\x20\t]{1,3}(?i:arroba|arobase)[\x20\t]{1,3}(?=[A-Za-z0-9]))"
    r"|(?P<dot2>(?<=[A-Za-z0-9])[\x20\t]{1,3}(?i:dot|punto|punkt)[\x20\t]{1,3}(?=[A-Za-z0-9]))"
    rf"|(?P<spelled>{_RUN})"
)
# What a text, in lower case, without any disguise that the rules could turn into an identifier does not hold.
_CODE = re.compile("&\\#|&commat;|&period;|%40|%2[ebd]")
_SIGN = re.compile(r"[\[({<][\x20\t]{0,3}(?:at|arroba|arobase|dot|punto|point|punkt)[\x20\t]{0,3}[\])}>]|[\x20\t](?:dot|punto|punkt|arroba|arobase)[\x20\t]")


def _may_hide(text: str) -> bool:
    low = text.lower()
    if not _CHARS.keys().isdisjoint(_BEYOND.findall(text)) or _SIGN.search(low) or _CODE.search(low):
        return True
    words = low.replace(",", " ").replace("-", " ").replace(".", " ").split()
    if _DIGITS.keys().isdisjoint(words):
        return False
    digit = [w in _DIGITS or w[-1] in "0123456789" for w in words]  # two digits side by side, one of them spelled
    return any(a and b and not (x[-1].isdigit() and y[-1].isdigit()) for a, b, x, y in zip(digit, digit[1:], words, words[1:], strict=False))


_SPOKEN = re.compile(rf"(?i:{_WORD}|plus)")


def _email(text: str) -> list[tuple[int, int]]:
    found, free = [], 0
    for m in _TAIL.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            free = m.end()
    return found


def _ip(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _card(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def _phone(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]


_DETECT = dict(zip(KINDS, (_email, _ip, _card, _phone), strict=True))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base detectors by kind, then start."""
    return [(kind, a, b) for kind in KINDS for a, b in _DETECT[kind](text)]


def decoded(code: str) -> str | None:
    """The plain character that a character reference or a percent escape stands for, None if it is none of an identifier's."""
    if code[0] == "%":
        c = chr(int(code[1:], 16))
    elif code[1] != "#":
        c = {"&commat;": "@", "&period;": "."}[code]
    else:
        n = int(code[3:-1], 16) if code[2] in "xX" else int(code[2:-1])
        c = chr(n) if n <= sys.maxunicode else ""
    c = _CHARS.get(c, c)
    return c if c in _PLAIN else None


def normalise(text: str) -> tuple[str, array, array]:
    """The rewritten text; for each of its characters, start and end of the source it stands for."""
    parts, starts, ends, at = [], array("q"), array("q"), 0

    def keep(a: int, b: int) -> None:
        parts.append(text[a:b])
        starts.extend(range(a, b))
        ends.extend(range(a + 1, b + 1))

    def write(new: str, a: int, b: int) -> None:
        parts.append(new)
        starts.extend([a] * len(new))
        ends.extend([b] * len(new))

    for m in _RULES.finditer(text):
        keep(at, m.start())
        at = m.end()
        kind = m.lastgroup
        if kind == "char":
            write(_CHARS[m[0]], *m.span())
        elif kind == "code":
            plain = decoded(m[0])
            if plain is None:
                keep(*m.span())
            else:
                write(plain, *m.span())
        elif kind == "spelled":
            for w in _SPOKEN.finditer(m[0]):
                write(_DIGITS.get(w[0].lower(), "+"), m.start() + w.start(), m.start() + w.end())
        else:
            write("@" if kind.startswith("at") else ".", *m.span())
    keep(at, len(text))
    return "".join(parts), starts, ends


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: base and deobfuscated ones that no base span of their kind covers."""
    base = base_spans(text)
    if not _may_hide(text):
        return base, base
    plain, starts, ends = normalise(text)
    more = set()
    covers = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}  # of one kind, in order and apart
    first = {k: [a for a, _ in v] for k, v in covers.items()}
    for kind, a, b in base_spans(plain):
        start, end = starts[a], ends[b - 1]
        at = bisect_right(first[kind], start) - 1
        if at < 0 or covers[kind][at][1] < end:
            more.add((kind, start, end))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(chain(base, more), key=lambda s: (order[s[0]], s[1], s[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(df: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """key, n_<kind> of base spans, base and all spans as kind:start:end lists, and the redacted text.

    Null text: no spans and a null redacted text; empty text: no spans. Null keys
    and repeated rows give a row each, an empty table none. `keep` names further
    columns to carry along; others, whatever their names, are not read. Work and
    memory grow with a text's length, however long: a text that may hide
    something takes some 40 bytes for each of its characters in its task.
    """

    def run(texts: list) -> list[list]:
        rows = []
        for t in texts:
            base, every = find_spans(t) if t else ([], [])
            n = {k: 0 for k in KINDS}
            for k, _, _ in base:
                n[k] += 1
            rows.append([*n.values(), written(base), written(every), redact(t, every) if t else t])
        return [list(c) for c in zip(*rows, strict=True)]

    schema = ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string, redacted string"
    return map_texts(df, [key, *(keep or [])], text, run, schema)
