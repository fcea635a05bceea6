"""Filters and classifications of papers, blocks and tables. Column expressions only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import let, strip
from ..schema import any_of, holds_any


def _one_of(words: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(*words)


def lowered(text: Column) -> Column:
    """Lower case, with one letter for mu and the micro sign."""
    return F.translate(F.lower(text), "µ", "μ")


def keyword_hits(low: Column, keywords, words: bool = True) -> Column:
    """Sum of each keyword's matches in a text (lowered), ignoring case; overlapping keywords count each on
    their own. A keyword is a pattern; with words it must stand between word boundaries. Single plain
    words are looked up among the text's words, all in one pass; other plain texts are counted by what
    their removal takes away, or searched for only where the text holds them; patterns take a pass each."""
    small = [k.lower().replace("µ", "μ") for k in keywords]
    plain = [k for k in small if words and re.fullmatch(r"\w+", k)]
    total = F.lit(0)
    if plain:
        tally = {w: plain.count(w) for w in plain}
        tokens = F.split(low, r"(?U)\W+")
        for times in sorted(set(tally.values())):
            some = [w for w, n in tally.items() if n == times]
            total = total + times * F.size(F.filter(tokens, _one_of(some)))
    for k in small:
        if k in plain:
            continue
        count = F.regexp_count(low, F.lit(f"(?iU)\\b{k}\\b" if words else f"(?iU){k}"))
        if not set(k) & set("\\.^$*+?{}[]|()"):
            gone = F.floor((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)).cast("int")
            count = F.when(low.contains(k), count).otherwise(0) if words else gone
        total = total + count
    return F.when(low.isNotNull(), total)


def precheck(
    papers: DataFrame, text_col: str = "text", toxins=vocab.TOXIN_KEYWORDS, kinetics=vocab.KINETICS_KEYWORDS,
    units=vocab.UNIT_KEYWORDS, min_toxins: int = 1, min_kinetics: int = 2, chars: int = 30_000,
) -> DataFrame:
    """Adds toxin_hits, kinetics_hits, unit_hits, skip and reason (O-F1, O-S3). The feature reads the
    first `chars` characters. A paper without text is not skipped."""
    low = F.col("__low")
    out = papers.withColumn("__low", lowered(F.substring(text_col, 1, chars))).withColumns(
        {
            "toxin_hits": keyword_hits(low, toxins),
            "kinetics_hits": keyword_hits(low, kinetics),
            "unit_hits": keyword_hits(low, units, words=False),
        }
    ).drop("__low")
    few_toxins, few_kinetics = F.col("toxin_hits") < min_toxins, F.col("kinetics_hits") < min_kinetics
    reason = (
        F.when(F.col(text_col).isNull(), "no_text")
        .when(few_toxins, F.format_string("too few toxin keywords (%s)", "toxin_hits"))
        .when(few_kinetics, F.format_string("too few kinetics keywords (%s)", "kinetics_hits"))
        .otherwise("pass")
    )
    skip = F.coalesce(few_toxins | few_kinetics, F.lit(False))
    return out.withColumns({"skip": skip, "reason": reason})


def precheck_summary(checked: DataFrame) -> DataFrame:
    """total, passed, skipped, skip_rate (O-F2)."""
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("skip")).alias("passed"),
        F.count_if("skip").alias("skipped"),
        F.coalesce(F.avg(F.col("skip").cast("int")), F.lit(0.0)).alias("skip_rate"),
    )


def is_reference_list(text: Column, share: float = 0.7, entries=vocab.REFERENCE_ENTRIES) -> Column:
    """Three lines or more, of which over a share look like references; blank lines count as lines
    (O-F5)."""
    lines = F.split(text, "\n", -1)
    hits = F.size(F.filter(lines, lambda x: (strip(x) != "") & any_of([x.rlike(f"(?iU){p}") for p in entries])))
    return (F.size(lines) >= 3) & (hits / F.size(lines) > share)


def block_reason(
    text: Column, min_chars: int = 100, share: float = 0.7, keywords=vocab.DATA_KEYWORDS
) -> Column:
    """Why a text block goes, by the first test that it fails; 'kept' if it stays, null if it is
    empty (O-F3 to O-F7)."""
    title = strip(F.substring(text, 1, 50))
    header = F.lower(strip(F.substring(text, 1, 100)))
    out = (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
        .when(F.length(text) < min_chars, "too_short")
        .when(any_of([title.rlike(f"(?iU){p}") for p in vocab.REFERENCE_TITLES]), "reference_section")
        .when(is_reference_list(text, share), "reference_entries")
        .when(any_of([header.rlike(f"(?iU){p}") for p in vocab.NON_DATA_HEADERS]), "non_data_section")
    )
    return out.when(~holds_any(F.lower(text), keywords), "no_keywords").otherwise("kept") if keywords else out.otherwise("kept")


def filter_blocks(blocks: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """Rows of blocks with their reason; keep with where("reason = 'kept'") (O-F8: by row, so
    duplicates of a kept block are judged alike)."""
    return blocks.withColumn("reason", block_reason(strip(F.col(text_col)), **rules))


def caption_passes(caption: Column, exclude=vocab.CAPTION_EXCLUDE) -> Column:
    """Blank captions pass; excluded words don't (O-F15)."""
    low = F.lower(F.coalesce(caption, F.lit("")))
    return (F.trim(low) == "") | ~holds_any(low, exclude)


def table_header(body: Column) -> Column:
    """Lower-case header part: <thead>, else the first row; null if neither is there."""
    head = F.regexp_extract(body, r"(?s)<thead>.*?</thead>", 0)
    row = F.regexp_extract(body, r"(?s)<tr[^>]*>.*?</tr>", 0)
    return F.lower(F.nullif(F.when(head != "", head).otherwise(row), F.lit("")))


def route_table(body: Column, parses: Column, keywords=vocab.KINETIC_HEADERS, min_chars: int = 100) -> Column:
    """skip, vision or text, with the reason, for a table's HTML (O-F16). parses: whether a grid can be
    read from it (sources.grids.grid_ok)."""
    head = table_header(body)
    blank = body.isNull() | (body == "")
    return (
        F.when(~blank & head.isNotNull() & ~holds_any(head, keywords), "skip:no_kinetic_keywords")
        .when(blank | (F.length(body) < min_chars), "vision:html_incomplete")
        .when(parses, "text:grid_read")
        .otherwise("vision:grid_failed")
    )


def route_stats(routed: DataFrame, route_col: str = "route") -> DataFrame:
    """Tables by route, and their share (O-G20)."""
    counts = routed.groupBy(F.col(route_col).alias("route")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def bio_paragraphs(
    papers: DataFrame, key: str, text_col: str = "text", words_col: str | None = None, patterns=vocab.BIO_PATTERNS,
    most: int = 8000, fallback: int = 5000,
) -> DataFrame:
    """key, excerpt: the paragraphs that carry identifying facts (O-F17). Paragraphs of 30 characters
    or more, once each by their first 100, that match a pattern, two of the row's own words, or are a
    short section title. Fewer than three: the head of the text instead."""
    paras = F.split(F.col(text_col), r"\n\s*\n")
    paras = F.when(F.size(paras) < 5, F.split(F.col(text_col), r"(?<=[.!?])\s+")).otherwise(paras)
    own = F.col(words_col) if words_col else F.array().cast("array<string>")

    def relevant(p: Column) -> Column:
        low = F.lower(p)
        custom = F.size(F.filter(own, lambda w: (F.length(w) > 2) & low.contains(F.lower(w)))) >= 2
        return any_of([p.rlike(f"(?i){x}") for x in patterns]) | custom | (holds_any(low, vocab.BIO_SECTIONS) & (F.length(p) < 200))

    kept = F.filter(F.transform(paras, strip), lambda p: (F.length(p) >= 30) & relevant(p))
    # Sorted by head and place, the first of each head stands behind another head.
    heads = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.lower(F.substring(p, 1, 100)).alias("h"), i.alias("i"), p.alias("p"))))
    once = let(heads, lambda s: F.filter(s, lambda x, j: (j == 0) | (x["h"] != F.get(s, j - 1)["h"])))
    firsts = F.transform(F.array_sort(F.transform(once, lambda x: F.struct(x["i"], x["p"]))), lambda x: x["p"])
    papers = papers.select(key, F.col(text_col).alias("__t"), firsts.alias("__f"))
    text_col, firsts = "__t", F.col("__f")
    text = F.array_join(firsts, "\n\n")
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n\n[... cut ...]"))).otherwise(text)
    return papers.select(
        key, F.when(F.size(firsts) < 3, F.substring(text_col, 1, fallback)).otherwise(cut).alias("excerpt")
    )
