"""Secret scan in DataFrame functions only: fixed patterns, and sliding-window Shannon entropy.

Patterns find assignments, access keys and hex strings. Besides, every run of token characters that
mixes letters and digits is a candidate of the narrowest character class it fits (hex, alnum,
base64). A window of WINDOW characters slides over it; the sum of n*log2(n) over character counts
is updated from the counts of the entering and the leaving character, which are then changed in
place, and the entropy of the
window is log2(WINDOW) - sum / WINDOW. A candidate is a secret if any window reaches its class's
threshold and no allow-list pattern fits it. The logarithms are integers of a fixed table, so that
results don't depend on the order of additions.

Spans are (start, end, kind) in code points, end exclusive. Nothing is shuffled and no text is
exploded. Defined cases: null and empty texts have no spans; very long texts are scanned whole, in the
memory of the text; spans of equal start are ordered by kind; repeated rows are scanned each on their
own; empty table, empty result; further input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed

# The patterns of the base kinds, in the order in which kinds sort.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
    "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# Runs are matched whole, so a least length in the pattern drops the same matches as a later test.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Counts are packed: a count of up to WINDOW takes CELL_BITS bits, CELLS of them make a number.
CELL_BITS = WINDOW.bit_length()
CELLS = 60 // CELL_BITS
#: Bits of entropy that a window must reach, by character class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
#: Candidates that one of these finds are no secrets.
ALLOW = (
    "(?i)example|sample|placeholder|dummy|xxxx|changeme",
    "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "(?i)0123456789|abcdefghij",
    "^(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4})(?:[-_/=+](?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4}))+$",
)
SCALE = 1_000_000
NLOGN = [round(SCALE * n * math.log2(n)) if n else 0 for n in range(WINDOW + 1)]


def most_sum(bits: float) -> int:
    """The largest sum of n*log2(n) of a window whose entropy reaches bits."""
    return round(SCALE * WINDOW * (math.log2(WINDOW) - bits))


SPAN = "array<struct<start:int,kind:int,end:int,s:string>>"


def found(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches with their places: the lengths of the pieces between
    matches and of the matches are added up."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(gaps, hits, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("s")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["s"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["s"].alias("s"))
        return F.when(x["s"].isNull(), acc).otherwise(
            F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))
        )

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def lowest_sum(s: Column) -> Column:
    """Over the windows of a string of SYMBOLS, the least sum of n*log2(n) of character counts. The
    accumulator holds the window's count of every symbol, CELL_BITS bits each, CELLS to a number; a step
    changes the cells of the entering and of the leaving character."""
    table = F.array(*[F.lit(x).cast("long") for x in NLOGN])
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    gone = F.concat(F.array_repeat(F.lit(-1), WINDOW), codes)

    def f(n: Column) -> Column:
        return F.element_at(table, n.cast("int") + 1)

    def cell(counts: Column, code: Column) -> Column:
        number = F.element_at(counts, F.floor(code / CELLS).cast("int") + 1)
        return F.call_function("shiftright", number, CELL_BITS * F.pmod(code, F.lit(CELLS))).bitwiseAND(F.lit((1 << CELL_BITS) - 1))

    def at(code: Column, slot: Column) -> Column:
        here = F.floor(code / CELLS) == slot
        return F.when(here, F.call_function("shiftleft", F.lit(1).cast("long"), CELL_BITS * F.pmod(code, F.lit(CELLS)))).otherwise(F.lit(0).cast("long"))

    def step(acc: Column, x: Column) -> Column:
        counts, enter, leave = acc["counts"], x["enter"], x["leave"]
        full = leave >= 0
        had = F.when(full, cell(counts, F.greatest(leave, F.lit(0))))
        less = F.when(full, f(had - 1) - f(had)).otherwise(F.lit(0).cast("long"))
        before = cell(counts, enter) - F.when(leave == enter, 1).otherwise(0)
        total = acc["sum"] + less + f(before + 1) - f(before)
        now = F.transform(counts, lambda c, slot: c + at(enter, slot) - F.when(full, at(leave, slot)).otherwise(F.lit(0).cast("long")))
        return F.struct(
            now.alias("counts"), total.alias("sum"), (acc["n"] + 1).alias("n"),
            F.when(acc["n"] >= WINDOW - 1, F.least(acc["low"], total)).otherwise(acc["low"]).alias("low"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), -(-len(SYMBOLS) // CELLS)).alias("counts"),
        F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(2**62).alias("low"),
    )
    steps = F.zip_with(codes, F.slice(gone, 1, F.size(codes)), lambda e, g: F.struct(e.alias("enter"), g.alias("leave")))
    return F.aggregate(steps, start, step, lambda acc: acc["low"])


def high_entropy(s: Column) -> Column:
    limit = (
        F.when(s.rlike("^[0-9a-fA-F]+$"), most_sum(THRESHOLDS["hex"]))
        .when(s.rlike("^[A-Za-z0-9]+$"), most_sum(THRESHOLDS["alnum"]))
        .otherwise(most_sum(THRESHOLDS["base64"]))
    )
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    for pattern in ALLOW:
        mixed = mixed & ~s.rlike(pattern)
    return F.when(mixed, lowest_sum(s) <= limit).otherwise(F.lit(False))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<start,kind,end,s>>, sorted by start, then kind (an index into
    KINDS). Entropy spans that lie inside a pattern's span are left out, as found already."""
    src = keyed(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    t = F.col("text")
    none = F.array().cast(SPAN)

    def where(test: Column, spans: Column) -> Column:
        return F.when(test, spans).otherwise(none)

    assign = where(
        (t.contains(":") | t.contains("=")) & t.rlike(ASSIGN),
        F.filter(found(t, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= 12),
    )
    access = where(t.contains("AKIA"), found(t, ACCESS, 1))
    hexes = where(t.rlike("[0-9a-f]{16}"), found(t, HEX, 2))
    # A secret of this kind has a digit; few texts do.
    entropy = where(t.rlike("[0-9]") & t.rlike(CANDIDATE), F.filter(found(t, CANDIDATE, 3), lambda x: high_entropy(x["s"])))
    base = src.select("doc_id", F.concat(assign, access, hexes).alias("base"), entropy.alias("more"))
    new = F.filter(
        "more", lambda x: ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"]))
    )
    return base.select("doc_id", F.array_sort(F.concat("base", new)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ","
    )


def secret_report(spans: DataFrame) -> DataFrame:
    """Counts by kind and the joined spans of what scan_secrets returns."""

    def n(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return spans.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(spans_text(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        n(3).alias("n_entropy"),
    )
