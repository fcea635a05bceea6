"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are lower-cased runs of letters and digits; scripts written without spaces give a token for each
character. A mask names the token positions that a seed hashes and so ignores the others. MASKS are
chosen so that of any SPAN aligned tokens with at most MISSES substitutions at least one placement of
one mask avoids all substitutions: the seeds find every such overlap. Around each hit the two texts
are compared token by token on the hit's diagonal; an overlap counts if SPAN aligned tokens around
the hit have at most MISSES differences.

Items of fewer than SPAN tokens must occur whole: with at most one substitution from ONE_MISS tokens on
(their masks are the even and the odd positions, one of which a substitution leaves alone), unchanged
below. Items of fewer than min_item tokens (a parameter, by default none) are left out.

Seeds of the benchmark are broadcast in blocks of at most `block` tokens (items are cut into overlapping
segments), one pass over the documents for each block, so a broadcast stays small whatever the
benchmark's size. A benchmark of more than `passes` blocks is joined by a shuffle of seeds instead; the
result is the same. Documents' texts are not shuffled; hits are summed up before they are.

Defined cases: null and empty texts have no tokens and no hits; very long texts are compared whole; an
overlap that several seeds find counts each of them as a hit; rows that share a doc_id are reported
together; repeated items of one item_id likewise; empty tables, empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keyed

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
SPAN = 13
MISSES = 2
ONE_MISS = 7
REACH = max(m[-1] for m in MASKS) + 1
SEGMENT = 4096
OVERLAP = 32
BLOCK = 200_000
PASSES = 4
#: Scripts that don't part words by spaces: Thai and Lao, Myanmar, Khmer, kana, ideographs. Ranges, which are
#: searched for several times faster than scripts by name.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"


def tokens(text: Column) -> Column:
    wide = (F.octet_length(text) > F.length(text)) & text.rlike(UNSPACED)
    apart = F.when(wide, F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    return F.filter(F.split(F.lower(apart), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def seed(mask: tuple[int, ...], number: int, h: str, pos: str) -> Column:
    """Hash of the tokens that a mask names, from pos on."""
    return F.xxhash64(F.lit(number), *[F.get(F.col(h), F.col(pos) + o) for o in mask])


def seeds_of(rows: DataFrame, masks: list[tuple[int, ...]], h: str, pos: str) -> DataFrame:
    """A row for each position and mask, with columns seed and mask."""
    each = F.array(*[F.struct(F.lit(k).alias("mask"), seed(m, k, h, pos).alias("seed")) for k, m in enumerate(masks)])
    cols = rows.columns
    return rows.select("*", F.posexplode(h).alias(pos, "_")).select(*cols, pos, F.inline(each))


def segments(items: DataFrame, min_item: int) -> DataFrame:
    """item_id, n (tokens of the item), seg (hash of id, text and start), g (token hashes)."""
    rows = items.where("text is not null").select(
        "item_id", F.xxhash64("item_id", "text").alias("k"), hashed(F.col("text")).alias("h")
    )
    rows = rows.select("*", F.size("h").alias("n")).where(F.col("n") >= max(1, min_item))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - OVERLAP, F.lit(0)), F.lit(SEGMENT - OVERLAP))
    cut = rows.select("item_id", "k", "n", "h", F.explode(starts).alias("s"))
    return cut.select(
        "item_id", "n", F.xxhash64("k", "s").alias("seg"), F.slice("h", F.col("s") + 1, SEGMENT).alias("g")
    ).dropDuplicates(["seg"])


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of n tokens that must occur whole."""
    return [tuple(range(0, n, 2)), tuple(range(1, n, 2))] if n >= ONE_MISS else [tuple(range(n))]


def find_overlaps(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", masks: tuple[tuple[int, ...], ...] = MASKS, span: int = SPAN, misses: int = MISSES,
    block: int = BLOCK, passes: int = PASSES, min_item: int = 1,
) -> DataFrame:
    """doc_id, item_id, matched (most equal tokens among span aligned ones, or among those of a shorter
    item), n_hits (seed hits on accepted overlaps)."""
    known = segments(keyed(items, item_id=item_col, text=item_text_col), min_item)
    size = known.agg(F.sum(F.size("g")).alias("n"), F.collect_set(F.when(F.col("n") < span, F.col("n"))).alias("short")).first()
    blocks = max(1, -(-(size["n"] or 0) // block))
    # Masks, each with the length of the items it is for (0: those of span tokens and more).
    every = [(0, m) for m in masks] + [(n, m) for n in sorted(size["short"]) for m in short_masks(n)]
    rows = keyed(docs, doc_id=id_col, text=text_col).where("text is not null")
    rows = rows.select("doc_id", hashed(F.col("text")).alias("h"))
    if blocks > passes:
        hits = shuffled_hits(keyed(docs, doc_id=id_col, text=text_col), known, every, span)
    else:
        places, hits = seeds_of(rows, [m for _, m in every], "h", "p"), None
        for b in range(blocks):
            own = known.where(F.pmod("seg", F.lit(blocks)) == b) if blocks > 1 else known
            seeds, dims = item_seeds(own, every, span), own.select(F.col("seg").alias("seg2"), "item_id", "n", "g")
            part = places.join(F.broadcast(seeds), F.col("seed") == F.col("seed2")).join(
                F.broadcast(dims), F.col("seg") == F.col("seg2")
            )
            part = part.select("doc_id", "item_id", "n", matched_around(span).alias("matched"))
            hits = part if hits is None else hits.unionAll(part)
    least = F.when(F.col("n") >= span, span - misses).otherwise(F.col("n") - F.when(F.col("n") >= ONE_MISS, 1).otherwise(0))
    return hits.where(F.col("matched") >= least).groupBy("doc_id", "item_id").agg(
        F.max("matched").alias("matched"), F.count("*").alias("n_hits")
    )


def item_seeds(own: DataFrame, every: list, span: int) -> DataFrame:
    """seed2, seg, q of the segments' seeds: each mask on the items it is for, within the segment."""
    fits = F.lit(False)
    for k, (n, m) in enumerate(every):
        this = (F.col("n") == n) & (F.col("q") == 0) if n else F.col("n") >= span
        fits = fits | ((F.col("mask") == k) & this & (F.col("q") + m[-1] < F.size("g")))
    seeds = seeds_of(own.select("seg", "n", "g"), [m for _, m in every], "g", "q").where(fits)
    return seeds.select(F.col("seed").alias("seed2"), "seg", "q")


def shuffled_hits(rows: DataFrame, known: DataFrame, every: list, span: int) -> DataFrame:
    """doc_id, item_id, n, matched of all seed hits, for a benchmark of any size. Seeds travel without
    texts; the tokens around a hit are looked up afterwards, by row (a hash of id and text: equal rows
    are looked up once) and by segment."""
    texts = rows.where("text is not null").withColumn("r", F.xxhash64("doc_id", "text"))
    texts = texts.select("doc_id", "r", hashed(F.col("text")).alias("h"))
    places = seeds_of(texts.select("r", "h"), [m for _, m in every], "h", "p").select("r", "p", "seed")
    hits = places.join(item_seeds(known, every, span), F.col("seed") == F.col("seed2")).select("r", "p", "seg", "q")
    some = texts.join(hits.select("r").distinct(), "r", "left_semi").groupBy("r").agg(F.first("doc_id").alias("doc_id"), F.first("h").alias("h"))
    # Rows equal in id and text have each hit as often as there are such rows already.
    found = hits.join(some, "r").join(known.select("seg", "item_id", "n", "g"), "seg")
    return found.select("doc_id", "item_id", "n", matched_around(span).alias("matched"))


def matched_around(span: int) -> Column:
    """Equal tokens on the diagonal of a hit: the most in span aligned ones around it, or all of a
    short item. The last span comparisons are the bits of one integer that is shifted on."""

    def step(acc: Column, j: Column) -> Column:
        same = F.coalesce(F.get("h", F.col("p") + j) == F.get("g", F.col("q") + j), F.lit(False)).cast("int")
        last = (F.shiftleft(acc["last"], 1) + same).bitwiseAND(F.lit((1 << span) - 1))
        return F.struct(
            last.alias("last"),
            F.greatest(acc["most"], F.bit_count(last)).alias("most"),
            (acc["all"] + same).alias("all"),
        )

    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("most"), F.lit(0).alias("all"))
    offsets = F.sequence(F.lit(1 - span), F.lit(span - 1))
    return F.aggregate(offsets, start, step, lambda acc: F.when(F.col("n") >= span, acc["most"]).otherwise(acc["all"]))


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Input rows, all columns unchanged, without the documents that overlap an item. Rows are told
    apart by id and text."""
    key, name = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), fresh(docs, "__row")
    rows = docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    gone = find_overlaps(rows, items, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, key == F.col(name), "left_anti")
