"""Operators on a paper's ordered blocks: windows, captions, merging, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_markdown_references, split_column, strip


def block_text() -> Column:
    """The first of text, content, body and para that is there, trimmed (O-P4)."""
    return strip(F.coalesce(*[F.col(c) for c in ("text", "content", "body", "para")]))


def joined(words: Column) -> Column:
    """A caption or footnote list as one text (O-P6)."""
    return F.array_join(words, " ")


def figure_contexts(blocks: DataFrame, paper: str = "paper_name", order: str = "block_id") -> DataFrame:
    """Image blocks with a path, and their caption: their own, else the next block's if it is a text
    that starts like one (O-P8)."""
    w = Window.partitionBy(paper).orderBy(order)
    following = F.lead(F.when(F.col("type") == "text", F.col("text"))).over(w)
    rows = blocks.withColumn("__next", following)
    path = F.coalesce(F.nullif("img_path", F.lit("")), F.nullif("image_path", F.lit("")))
    caption = F.nullif(F.coalesce(joined(F.col("image_caption")), F.lit("")), F.lit(""))
    after = F.when(F.col("__next").rlike(r"(?i)^(Figure|Fig\.?)\s+\d+"), F.col("__next"))
    return rows.where((F.col("type") == "image") & path.isNotNull()).select(
        paper, order, path.alias("image_path"), F.coalesce(caption, after, F.lit("No caption available")).alias("caption")
    )


def merge_text_blocks(
    blocks: DataFrame, paper: str = "paper_name", order: str = "block_id", size: int = 50_000
) -> DataFrame:
    """paper, first block, type, content: neighbouring text blocks as one, broken at other blocks and
    where a run passes 1.5 sizes, long ones split at paragraphs; equations, tables and images stay as
    they are, other blocks go (O-X9, O-X11)."""
    w = Window.partitionBy(paper).orderBy(order)
    rows = blocks.withColumn("__t", strip(F.coalesce("text", F.lit("")))).withColumn("__text", F.col("type") == "text")
    rows = rows.withColumn("__run", F.sum((~F.col("__text")).cast("int")).over(w))
    runs = rows.where("__text and __t != ''").groupBy(paper, "__run").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__t").alias("t")))).alias("parts")
    )

    def grow(acc: Column, x: Column) -> Column:
        n = F.length(x["t"])
        new = (F.size(acc["out"]) == 0) | (acc["n"] + n > int(size * 1.5))
        last = F.try_element_at(acc["out"], F.lit(-1))
        item = F.struct(x["o"].alias("o"), x["t"].alias("t"))
        more = F.struct(last["o"].alias("o"), F.concat(last["t"], F.lit("\n\n"), x["t"]).alias("t"))
        out = F.when(new, F.concat(acc["out"], F.array(item))).otherwise(
            F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(more))
        )
        return F.struct(out.alias("out"), F.when(new, n).otherwise(acc["n"] + n).alias("n"))

    kind = runs.schema["parts"].dataType.simpleString()
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("n"))
    merged = runs.select(paper, F.inline(F.aggregate("parts", start, grow, lambda a: a["out"])))
    texts = merged.select(
        paper, F.col("o").alias(order), F.lit("text").alias("type"),
        F.posexplode(F.when(F.length("t") <= size, F.array("t")).otherwise(split_column(F.when(F.length("t") > size, F.col("t")), size))).alias("part", "content"),
    )
    others = blocks.where(F.col("type").isin("equation", "table", "image")).select(
        paper, order, "type", F.lit(0).alias("part"), F.col("text").alias("content")
    )
    return texts.unionByName(others)


def context_windows(
    records: DataFrame, blocks: DataFrame, reach: int = 5, most: int = 8000, table_chars: int = 2000,
    keys: tuple[str, ...] = ("paper_name", "rec_idx"), paper: str = "paper_name", order: str = "block_id",
) -> DataFrame:
    """keys and context: texts of the blocks within reach of the record's block, in order, table bodies
    and the whole cut to a length (O-J8). records: keys, block_no; blocks: paper, order, type, text. A
    range join that is an equi join on the paper and on each block number in reach, so it hashes."""
    b = blocks.select(
        F.col(paper).alias("__p"), F.col(order).alias("__b"),
        F.when(F.col("type") == "table", F.substring("text", 1, table_chars)).otherwise(F.col("text")).alias("__t"),
    )
    last = blocks.groupBy(F.col(paper).alias("__lp")).agg(F.max(order).alias("__last"))
    near = records.select(*keys, F.coalesce("block_no", F.lit(0)).alias("__n"))
    near = near.join(last, F.col(paper) == F.col("__lp")).where("__n <= __last")
    near = near.select(*keys, F.explode(F.sequence(F.col("__n") - reach, F.col("__n") + reach)).alias("__at"))
    hits = near.join(b, (F.col(paper) == F.col("__p")) & (F.col("__at") == F.col("__b"))).where("__t is not null and __t != ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", "__t"))), lambda x: x["__t"]), "\n\n")
    return hits.groupBy(*keys).agg(F.substring(text, 1, most).alias("context"))


def find_table(requests: DataFrame, blocks: DataFrame, paper: str = "paper_name", order: str = "block_id") -> DataFrame:
    """For each request (paper, table_id) the table block meant: its caption holds the id, else 'table N',
    else it is the N-th (O-J9). Adds block and tier; null where there is none."""
    w = Window.partitionBy(paper).orderBy(order)
    tables = blocks.where(F.col("type") == "table").select(
        F.col(paper).alias("__p"), F.col(order).alias("__b"), F.row_number().over(w).alias("__k"),
        F.lower(F.coalesce(joined(F.col("table_caption")), F.lit(""))).alias("__c"),
    )
    digits = F.regexp_replace("table_id", r"\D", "")
    asked = requests.withColumn("__n", digits)
    has = F.col("__n") != ""
    tier = (
        F.when(F.col("__c").contains(F.lower("table_id")), 1)
        .when(has & (F.col("__c").contains(F.concat(F.lit("table "), "__n")) | F.col("__c").contains(F.concat(F.lit("table"), "__n"))), 2)
        .when(has & (F.col("__k") == F.col("__n").try_cast("int")), 3)
    )
    hits = asked.join(tables, F.col(paper) == F.col("__p")).withColumn("__tier", tier).where("__tier is not null")
    best = hits.groupBy(paper, "table_id").agg(F.min(F.struct("__tier", "__b")).alias("m"))
    return requests.join(best, [paper, "table_id"], "left").select(
        *requests.columns, F.col("m.__b").alias("block"), F.col("m.__tier").alias("tier")
    )


def global_context(papers: DataFrame, blocks: DataFrame, words: str = "words", most_blocks: int = 15, table_chars: int = 2500, most: int = 12_000) -> DataFrame:
    """paper_name, context: the first blocks that name a section, one of the paper's words (array
    column) or a number with a lower-case unit (O-F18)."""
    sections = r"abstract|results|discussion|kinetic|characteri[sz]ation|table|conclusion"
    number = r"\d+(?:\.\d+)?\s*(?:μm|nm|s-1|min-1|°c)"
    b = blocks.join(papers.select(F.col("paper_name").alias("__p"), F.col(words).alias("__w")), F.col("paper_name") == F.col("__p"))
    lower = F.lower(F.coalesce("text", F.lit("")))
    hit = lower.rlike(sections) | lower.rlike(number) | F.exists("__w", lambda w: (w != "") & lower.contains(F.lower(w)))
    w = Window.partitionBy("paper_name").orderBy("block_id")
    first = b.where(hit).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most_blocks)
    body = F.when(F.col("type") == "table", F.substring("text", 1, table_chars)).otherwise(F.col("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", body.alias("t")))), lambda x: x["t"]), "\n\n")
    return first.groupBy("paper_name").agg(F.substring(text, 1, most).alias("context"))


def cut_points(rows: DataFrame, order: str, parts: int, seen: int = 1024) -> list:
    """Values of a column that cut it into about equal parts: from `seen` rows by hash. They only say where
    work is cut."""
    some = rows.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order), order).limit(seen)
    values = sorted({r[0] for r in some.collect()})
    return values[:: max(1, -(-len(values) // parts))][1:]


def numbered_batches(rows: DataFrame, size: int, *order: str, by: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """Adds batch: rows in order, `size` to a batch (O-O4). Without a key, the order's first column is cut into
    parts that are numbered each on their own, from the number of rows before them."""
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    cuts = cut_points(rows, order[0], parts)
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(order[0]) >= c)) if cuts else F.lit(0)
    cut = rows.withColumn("__part", F.coalesce(part, F.lit(0)))
    before, starts = 0, []
    for r in sorted(cut.groupBy("__part").count().collect()):
        starts.append((r[0], before))
        before += r[1]
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "__p int, __before bigint"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    numbered = cut.withColumn("__at", place).join(start, F.col("__part") == F.col("__p"))
    return numbered.withColumn("batch", F.floor((F.col("__at") + F.col("__before")) / size).cast("int")).drop("__part", "__p", "__at", "__before")


def original_text(papers: DataFrame, blocks: DataFrame, most: int = 100_000, mark: str = "\n\n[... text cut ...]") -> DataFrame:
    """paper_name, text for an aggregating model (O-X11): the paper's own text (papers: paper_name, text)
    without its references, else its text and table blocks in order, cut to a length with a mark."""
    body = F.coalesce("content", "text", F.lit(""))
    item = F.when(F.col("type") == "text", body).when(F.col("type") == "table", F.concat(F.lit("[TABLE]\n"), body))
    parts = blocks.select("paper_name", F.struct(F.col("block_id").alias("i"), item.alias("t")).alias("x")).where("x.t is not null")
    parts = parts.groupBy("paper_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("__b"))
    own = F.nullif(cut_markdown_references(F.coalesce("text", F.lit(""))), F.lit(""))
    text = F.coalesce(own, "__b", F.lit(""))
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)
    return papers.join(parts, "paper_name", "left").select("paper_name", cut.alias("text"))
