"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glidepath.llm.common import text_groups

# The base patterns, their kinds in the order of ties, and the least length of what counts.
KINDS = ("assign", "access", "hex", "entropy")
_WORD = "(?:{})".format("|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(_WORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
MIN_VALUE, MIN_ACCESS = 8, 16

#: Character classes: the runs of each class inside a candidate, window, least bits per character.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASSES = ((re.compile("[0-9a-fA-F]{20,}"), 20, 3.0), (CANDIDATE, 20, 3.8))
_DIGITS = frozenset("0123456789")
#: Allow list: candidates that look random and are not secret, as a whole, and parts of candidates.
ALLOWED = re.compile(
    r"[A-Z]?[a-z]+|[A-Z]+|(?:[A-Z]?[a-z]+[-_/])+[A-Z]?[a-z]+|(?:[A-Z]+[-_/])+[A-Z]+|(?:[A-Z][a-z]+)+"  # words, word-lists, CamelCase
    r"|[-_=+/]+",
)
HARMLESS = re.compile(
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F])"  # UUID
    r"|wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"  # in many manuals
    r"|EXAMPLE|example|x{4,}|X{4,}|0123456789|abcdefgh|ABCDEFGH",
)
_C_LOG_C = [0.0, 0.0] + [c * math.log2(c) for c in range(2, 65)]


def entropy_spans(value: str, window: int, least: float) -> list[tuple[int, int]]:
    """Parts of `value` covered by windows with `least` bits per character or more, joined where windows overlap or touch.

    The window slides one character at a time; only the two counts that change enter the sum of c log c.
    """
    if least > math.log2(window) or len(value) < window:
        return []
    counts: dict[str, int] = {}
    total, base, spans = 0.0, math.log2(window), []
    for i, c in enumerate(value):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _C_LOG_C[n + 1] - _C_LOG_C[n]
        if i >= window:
            gone = value[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += _C_LOG_C[n - 1] - _C_LOG_C[n]
        if i >= window - 1 and base - total / window >= least - 1e-9:
            a, b = i - window + 1, i + 1
            if spans and spans[-1][1] >= a:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping per kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def entropy_hits(text: str) -> list[tuple[int, int, int]]:
    """Spans of the sliding windows of all classes over the runs of each class in candidate strings, joined where they overlap or touch.

    A candidate that the allow list matches in whole is left out; a harmless part only cuts the candidate in two. Windows of decimal
    digits alone count in no class.
    """
    out = []
    for m in CANDIDATE.finditer(text):
        if ALLOWED.fullmatch(m.group()):
            continue
        edges = [m.start(), *[e for h in HARMLESS.finditer(text, m.start(), m.end()) for e in h.span()], m.end()]
        spans = []
        for start, end in zip(edges[::2], edges[1::2]):
            for runs, window, least in CLASSES:
                for r in runs.finditer(text, start, end):
                    value = r.group()
                    if not ALLOWED.fullmatch(value) and not _DIGITS.issuperset(value):
                        spans += [(r.start() + a, r.start() + b) for a, b in entropy_spans(value, window, least)]
        joined_: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if joined_ and joined_[-1][1] >= a:
                joined_[-1] = (joined_[-1][0], max(b, joined_[-1][1]))
            else:
                joined_.append((a, b))
        out += [(a, 3, b) for a, b in joined_]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_spans string, spans string"


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: how many spans of each kind its whole text holds, the base spans, and all spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Entropy spans that a base span covers whole are left
    out; others may overlap base spans. One pass without a shuffle. Null texts count as empty; an empty table gives no rows.
    """
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches):
        for part, texts in text_groups(batches):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), texts):
                base = base_spans(text) if text else []
                more = [s for s in entropy_hits(text) if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)] if text else []
                n = [sum(s[1] == k for s in base) for k in range(3)]
                rows.append((doc, *n, len(more), joined(base), joined(sorted(base + more))))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)

