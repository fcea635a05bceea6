"""Line deduplication by overlapping three-line windows.

Every three consecutive lines of a text are a window, known by a 128-bit hash. Of a window that
occurs more than once anywhere, the first occurrence (least id, then least text hash, then least
line) stays; the lines of every later one are covered, except those that the first occurrence, in
the same text, covers itself. Covered ranges of a text are merged and their lines removed.

Windows are counted with sums before the shuffle, and the join of windows with the repeated ones may
be split where it is skewed, so one window may fill a third of the table. Texts are shuffled once.

Defined cases: null text stays null, with no lines; a text of fewer than three lines has no window
and stays; windows of blank lines only don't count; rows equal in id and text are one document and
all get the same result; null ids come first; a text may lose all its lines and is then empty;
empty table, empty result; further columns are carried unchanged by dedup_documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keyed, rows_of, ship

WINDOW = 3


def windows_of(rows: DataFrame) -> DataFrame:
    """doc_id, k (hash of id and text), pos, h1, h2 of all windows."""
    lines = rows.select("doc_id", "k", F.split("text", "\n", -1).alias("x"))
    shifted = [F.col("x").alias("l0")] + [F.slice("x", i + 1, F.greatest(F.size("x"), F.lit(1))).alias(f"l{i}") for i in range(1, WINDOW)]
    flat = lines.where(F.size("x") >= WINDOW).select(
        "doc_id", "k", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w")
    )
    parts = [F.col(f"w.l{i}") for i in range(WINDOW)]
    blank = parts[0].isNotNull()
    for p in parts:
        blank = blank & ~p.rlike(r"[^\x20\x09-\x0D]")
    return flat.where(parts[-1].isNotNull() & ~blank).select(
        "doc_id", "k", "pos", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(7), *parts).alias("h2")
    )


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_lines(rows: DataFrame) -> DataFrame:
    """doc_id, k, removed array<struct<start,end>>: merged line ranges, for documents that lose any.
    rows: doc_id, k, text."""
    windows = windows_of(rows)
    repeated = (
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "k", "pos")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    )
    hits = windows.join(repeated, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k") == F.col("first.k"))
    start = F.when(own & (F.col("pos") == F.col("first.pos")), F.col("pos") + WINDOW).when(
        own, F.greatest("pos", F.col("first.pos") + WINDOW)
    )
    covered = hits.select("doc_id", "k", F.coalesce(start, "pos").alias("a"), (F.col("pos") + WINDOW).alias("b"))
    each = covered.where("a < b").groupBy("doc_id", "k").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    ship(rows.sparkSession)
    schema = each.schema
    kind = schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            merged = []
            for (lists,) in rows_of(batch.select([2])):
                for ranges in lists:
                    merged.append([{"start": a, "end": b} for a, b in merge_ranges([(r["a"], r["b"]) for r in ranges])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(merged, span)], ["doc_id", "k", "removed"]
            )

    return each.mapInArrow(run, f"doc_id {kind}, k bigint, removed array<struct<start:int,end:int>>")


def cut(lines: Column, removed: Column) -> Column:
    """The lines outside the ranges, joined. lines must be a stored column, as it is read once for
    each range."""
    n = F.size(lines)
    ends = F.concat(F.array(F.lit(0)), F.transform(removed, lambda r: r["end"]))
    begins = F.concat(F.transform(removed, lambda r: r["start"]), F.array(n))
    gaps = F.zip_with(ends, begins, lambda e, b: F.struct(e.alias("e"), b.alias("b")))
    stay = F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["e"] + 1, g["b"] - g["e"])))
    return F.array_join(stay, "\n")


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """Input rows with the text cleaned; with report also n_lines, n_removed and removed (merged line
    ranges, end exclusive)."""
    key = F.xxhash64(id_col, text_col)
    rows = keyed(docs, doc_id=id_col, text=text_col).where("text is not null")
    removed = repeated_lines(rows.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), "text"))
    names = {x: fresh(docs, f"__{x}") for x in ("k", "lines", "id", "key", "cut")}
    left = docs.withColumns({names["k"]: key, names["lines"]: F.split(F.col(f"`{text_col}`"), "\n", -1)}).drop(text_col)
    right = removed.select(
        F.col("doc_id").alias(names["id"]), F.col("k").alias(names["key"]), F.col("removed").alias(names["cut"])
    )
    on = (F.col(names["k"]) == F.col(names["key"])) & F.col(f"`{id_col}`").eqNullSafe(F.col(names["id"]))
    both = left.join(right, on, "left")
    lines, gone = F.col(names["lines"]), F.col(names["cut"])
    text = F.when(gone.isNull(), F.array_join(lines, "\n")).otherwise(cut(lines, gone)).alias(text_col)
    out = [text if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if report:
        lost = F.aggregate(gone, F.lit(0), lambda acc, r: acc + r["end"] - r["start"])
        out += [
            F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(lost, F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce(gone, F.array().cast("array<struct<start:int,end:int>>")).alias("removed"),
        ]
    return both.select(*out)
