"""Secret scan: fixed patterns, and sliding-window Shannon entropy by character class over candidate strings.

Entropy of a window of w characters is log2(w) - sum(c*log2(c))/w over its character counts c.  Moving the window
by one changes two counts, so a candidate costs time in proportion to its length.  Windows over the limit
merge into spans; an allow-list takes known harmless ones out.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")


@dataclass(frozen=True)
class CharClass:
    """A span kind, its characters, the window's length, the least entropy in bits, and whether a window needs both a letter and a digit."""

    kind: str
    run: str
    window: int
    bits: float
    mixed: bool


CLASSES = (CharClass("entropy_hex", r"[0-9A-Fa-f]+", 24, 3.0, False), CharClass("entropy_base64", r"[A-Za-z0-9+/_=-]+", 20, 3.9, True))
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Searched in the candidate with the 12 characters before it.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F])",
    r"(?i)sha(?:1|256|384|512)[-:=]",
    r"(?i)example|placeholder|changeme|dummy|xxxx",
    r"(?i)abcdefghij|0123456789",
    r"://",
)


def entropy_spans(text: str, start: int, run: str, window: int, bits: float, mixed: bool) -> list[tuple[int, int]]:
    """Merged windows of run (at start in its text) with at least so many bits."""
    if len(run) < window:
        return []
    counts: dict[str, int] = {}
    total, letters, digits, out = 0.0, 0, 0, []
    most = (math.log2(window) - bits) * window + 1e-9
    cost = lambda c: c * math.log2(c) if c > 1 else 0.0
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += cost(c + 1) - cost(c)
        counts[ch] = c + 1
        letters += ch.isalpha()
        digits += ch.isdigit()
        if i >= window:
            old = run[i - window]
            c = counts[old]
            total += cost(c - 1) - cost(c)
            counts[old] = c - 1
            letters -= old.isalpha()
            digits -= old.isdigit()
        if i >= window - 1 and total <= most and (not mixed or letters and digits):
            a, b = start + i - window + 1, start + i + 1
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], b
            else:
                out.append((a, b))
    return out


def scanner(classes=CLASSES, candidate: str = CANDIDATE, allowed=ALLOWED):
    """text -> spans (kind, start, end) in order of start, then kind."""
    find = re.compile(candidate)
    runs = [(c, re.compile(c.run)) for c in classes]
    allow = [re.compile(p) for p in allowed]

    def scan(text: str) -> list[tuple[str, int, int]]:
        spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
        starts = sorted(spans, key=lambda s: s[1])
        reach = list(accumulate((s[2] for s in starts), max))  # the furthest end of the spans up to each start
        starts = [s[1] for s in starts]

        def covered(a: int, b: int) -> bool:
            """Whether one of the fixed patterns' spans holds all of a to b."""
            k = bisect_right(starts, a)
            return k > 0 and reach[k - 1] >= b

        for m in find.finditer(text):
            around = text[max(0, m.start() - 12) : m.end()]
            if any(p.search(around) for p in allow):
                continue
            own: list[tuple[int, int, str]] = []  # by start; none overlap
            for c, run in runs:
                for r in run.finditer(m[0]):
                    for a, b in entropy_spans(text, m.start() + r.start(), r[0], c.window, c.bits, c.mixed):
                        before = bisect_left(own, (b,)) - 1
                        if not (before >= 0 and own[before][1] > a) and not covered(a, b):
                            insort(own, (a, b, c.kind))
            spans += [(kind, a, b) for a, b, kind in own]
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]) if s[0] in KINDS else len(KINDS), s[2]))

    return scan


def scan_secrets(df: DataFrame, text_col: str = "text", out_col: str = "spans", classes=CLASSES, candidate: str = CANDIDATE, allowed=ALLOWED) -> DataFrame:
    """df with out_col, an array of (kind, start, end): all spans of each whole text, in code points, end exclusive.

    Null and empty texts give an empty array.  Every row of df stays, once for each time it is there, whatever
    its other columns hold; a column of df named out_col is replaced.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [f for f in df.schema if f.name != out_col]
    schema = T.StructType([*kept, T.StructField(out_col, T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]
    source = text_col if text_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(classes, candidate, allowed)
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t or "")] for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, arrow.field(out_col).type)], names=[*names, out_col])

    assert source or text_col == out_col
    return df.select(*[F.col(f"`{n}`") for n in names], F.col(text_col).alias("__text")).mapInArrow(run, schema)
