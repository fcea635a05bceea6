"""Registered queries of the extraction operators on the test tables, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as X
from ..functions import values as V
from ..operators import blocks, enrichment, evaluation, filters, merging, reports
from ..operators import records as R
from ..schema import count_true, filled, normalise
from ..sources import answers, grids, sinks
from ..streaming.usage import usage_windows
from .derived import RECORDS_SQL, SCORE_SQL, records, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The pre-check searches for its whole vocabulary; words that occur in the test corpus are added to it, or
# stand in for the domain's words elsewhere.
TOXINS, KINETICS = (*vocab.TOXIN_KEYWORDS, "les"), (*vocab.KINETICS_KEYWORDS, "of", "and", "die", "que", "est")
UNITS = (*vocab.UNIT_KEYWORDS, "er", "en")
DATA = ("ing", "ung", "ment")
SUBSTRATES, OTHER_SUBSTRATES = ("economy", "standard", "promo"), ("medium",)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def with_records(sql: str, score: bool = False) -> str:
    more = f", scored AS (SELECT *, {SCORE_SQL} AS confidence_score FROM rec)" if score else ""
    return f"WITH {RECORDS_SQL}{more} {sql}"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).withColumn("confidence_score", R.confidence())


KEY = ["paper_name", "rec_idx"]

# ---------------------------------------------------------------- papers and blocks


_HEAD = "lower(substr(text, 1, 30000))"


def _hits_sql(words) -> str:
    """One-word keywords among the text's words; the others by a search each."""
    tokens = f"regexp_split_to_array({_HEAD}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')"
    plain = ", ".join(f"'{w}'" for w in words if re.fullmatch(r"\w+", w))
    parts = [f"len(list_filter({tokens}, lambda x: x IN ({plain})))"]
    for w in words:
        if not re.fullmatch(r"\w+", w):
            edge = "(^|[^\\p{L}\\p{M}\\p{N}_])" if ord(w[0]) > 127 else "\\b"
            parts.append(f"len(regexp_extract_all({_HEAD}, '{edge}{w}\\b'))")
    return " + ".join(parts)


# A circumflex is an anchor in these patterns, so units with one are never found.
_UNIT_SQL = " + ".join(f"(length({_HEAD}) - length(replace({_HEAD}, '{u}', ''))) // {len(u)}" for u in UNITS if "^" not in u)
_PRECHECK_SQL = f"""
WITH h AS (SELECT doc_id, {_hits_sql(TOXINS)} AS toxin_hits, {_hits_sql(KINETICS)} AS kinetics_hits, {_UNIT_SQL} AS unit_hits FROM documents),
c AS (SELECT *, toxin_hits < 1 OR kinetics_hits < 2 AS skip FROM h)
"""


def _prechecked(spark: SparkSession, sf: str) -> DataFrame:
    return filters.precheck(table(spark, sf, "documents").select("doc_id", "text"), toxins=TOXINS, kinetics=KINETICS, units=UNITS)


@query(
    _PRECHECK_SQL
    + """SELECT doc_id, toxin_hits, kinetics_hits, unit_hits, skip,
    CASE WHEN toxin_hits < 1 THEN 'too few toxin keywords (' || toxin_hits || ')'
         WHEN kinetics_hits < 2 THEN 'too few kinetics keywords (' || kinetics_hits || ')' ELSE 'pass' END AS reason FROM c"""
)
def precheck_documents(spark, sf):
    return _prechecked(spark, sf).drop("text")


@query(
    _PRECHECK_SQL
    + "SELECT count(*) AS total, count(*) FILTER (NOT skip) AS passed, count(*) FILTER (skip) AS skipped, avg(skip::INT) AS skip_rate FROM c"
)
def precheck_summary(spark, sf):
    return filters.precheck_summary(_prechecked(spark, sf))


_ENTRY = "(?i)(doi:\\s*10\\.\\d{4,}|https?://doi\\.org/|\\(\\d{4}\\)\\.|et\\s+al\\.\\s*\\(\\d{4}\\)|^\\s*\\[\\d+\\]|^\\s*\\d+\\.\\s+\\w+,\\s+\\w+\\..*\\(\\d{4}\\))"
_BLOCKS_SQL = f"""
WITH d AS (SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN 'References' || chr(10) || repeat(' ', 60) || text
    WHEN 2 THEN 'Funding' || repeat(' ', 120) || text WHEN 3 THEN replace(text, '.' || chr(10), ' (2020).' || chr(10)) || ' (2020).' ELSE text END AS t FROM documents),
s AS (SELECT doc_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM d),
l AS (SELECT doc_id, t, string_split(t, chr(10)) AS lines FROM s),
r AS (SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) < 100 THEN 'too_short'
    WHEN regexp_matches(trim(substr(t, 1, 50), ' ' || chr(10)), '(?i)^(references?|bibliography|citations?)$') THEN 'reference_section'
    WHEN len(lines) >= 3 AND len(list_filter(lines, lambda x: regexp_matches(x, '{_ENTRY}'))) / len(lines) > 0.7 THEN 'reference_entries'
    WHEN regexp_matches(lower(trim(substr(t, 1, 100), ' ' || chr(10))), '^(abstract|keywords?|acknowledgments?|funding)\\s*$') THEN 'non_data_section'
    WHEN NOT (contains(lower(t), 'ing') OR contains(lower(t), 'ung') OR contains(lower(t), 'ment')) THEN 'no_keywords' ELSE 'kept' END AS reason FROM l)
"""


def _blocks(spark, sf):
    d = table(spark, sf, "documents")
    t, kind = F.col("text"), F.col("doc_id") % 10
    text = (
        F.when(kind == 1, F.concat(F.lit("References\n" + " " * 60), t))
        .when(kind == 2, F.concat(F.lit("Funding" + " " * 120), t))
        .when(kind == 3, F.concat(F.replace(t, F.lit(".\n"), F.lit(" (2020).\n")), F.lit(" (2020).")))
        .otherwise(t)
    )
    return filters.filter_blocks(d.select("doc_id", text.alias("text")), keywords=DATA)


@query(_BLOCKS_SQL + "SELECT doc_id, reason FROM r")
def block_filter_documents(spark, sf):
    return _blocks(spark, sf).select("doc_id", "reason")


@query(_BLOCKS_SQL + "SELECT reason, count(*) AS n FROM r GROUP BY reason")
def block_filter_stats(spark, sf):
    return _blocks(spark, sf).groupBy("reason").agg(F.count("*").alias("n"))


_CUT_SQL = """
WITH d AS (SELECT doc_id, regexp_replace(text, '\\s+$', '') AS text, doc_id % 3 AS k FROM documents),
t AS (SELECT doc_id, k, CASE k WHEN 0 THEN text || chr(10) || 'References ' || chr(10) || 'A. B.' WHEN 1 THEN text || chr(10) || '1. Ab' || chr(10) || '[2] Cd' || chr(10) || '3. Ef' ELSE text END AS full_text, text FROM d)
SELECT doc_id, length(text) AS n, md5(text) AS digest FROM t
"""


@query(_CUT_SQL)
def strip_references(spark, sf):
    k, t = F.col("doc_id") % 3, X.rstrip(F.col("text"))
    more = F.when(k == 0, F.concat(t, F.lit("\nReferences \nA. B."))).when(k == 1, F.concat(t, F.lit("\n1. Ab\n[2] Cd\n3. Ef"))).otherwise(t)
    cut = table(spark, sf, "documents").select("doc_id", X.cut_references(more).alias("t"))
    return cut.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query(
    """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || '   x' || chr(10) || chr(10) || chr(10) || ' y ',
    ' +', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' \\n', chr(10), 'g'), '\\n ', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents"""
)
def clean_whitespace(spark, sf):
    t = X.clean_whitespace(F.concat("text", F.lit("   x\n\n\n y ")))
    return table(spark, sf, "documents").select("doc_id", F.md5(t).alias("digest"))


def _latex_sql() -> str:
    def sub(text: str, pattern: str, by: str, flags: str = "g") -> str:
        return f"regexp_replace({text}, '{pattern}', '{by}', '{flags}')"

    def tidy(hit: str) -> str:
        return sub(sub(hit, r"(\d)\s+\.\s+(\d)", r"\1.\2"), r"(\d)\s+(\d)", r"\1\2")

    def within(text: str, pattern: str) -> str:
        hits = f"regexp_extract_all({text}, '{pattern}', 1)"
        return f"""array_to_string(list_transform(list_zip(regexp_split_to_array({text}, '{pattern}'), {hits}), lambda x: x[1] || coalesce({tidy("x[2]")}, '')), '')"""

    out = sub(sub("t", r"\s*~\s*", " "), r"\\mathrm\s*\{([^}]*)\}", r"\1")
    for pattern, unit in vocab.LATEX_UNITS:
        out = sub(out, pattern, unit, "gi")
    out = sub(sub(out, r"\\mu\s+", "μ"), r"\\mu([A-Z])", r"μ\1")
    rest = sub(sub("b", r"\\[a-zA-Z]+\s*", ""), r"[\$\{\}]", "")
    spaces = sub(sub(sub(sub("c", " +", " "), r"\n{3,}", "\n\n"), r" \n", "\n"), r"\n ", "\n")
    start, end = "$( 0 . 3 3 ~ \\mu \\mathrm { M } )$ ", " $3 9 . 3 ~ \\mu \\mathrm { M }$"
    return f"""WITH x AS (SELECT doc_id, '{start}' || text || '{end}' AS t FROM documents), y AS (SELECT doc_id, {out} AS a0 FROM x),
    z AS (SELECT doc_id, {within("a0", r"[$]\s*\(\s*([^)]+)\s*\)\s*[$]")} AS a1 FROM y), v AS (SELECT doc_id, {within("a1", r"[$]\s*([^$]+)\s*[$]")} AS b FROM z),
    w AS (SELECT doc_id, {rest} AS c FROM v) SELECT doc_id, {sub(spaces, r"^\s+|\s+$", "")} AS text FROM w"""


@query(_latex_sql())
def latex_clean(spark, sf):
    t = F.concat(F.lit("$( 0 . 3 3 ~ \\mu \\mathrm { M } )$ "), "text", F.lit(" $3 9 . 3 ~ \\mu \\mathrm { M }$"))
    return table(spark, sf, "documents").select("doc_id", X.preprocess(t).alias("text"))


def _dealt_sql(size: int) -> str:
    """From texts d (key, t): p, q, u, e and step, which deal the units of long texts, paragraphs and the sentences
    of paragraphs that are too long, to chunks one after the other; then dealt (key, chunk, text)."""
    new = f"step.i > 0 AND (fresh OR used + length(t) > {size})"
    return f"""
p AS (SELECT key, unnest(string_split(t, chr(10) || chr(10))) AS para, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS pi FROM d WHERE length(t) > {size}),
q AS (SELECT key, pi, CASE WHEN length(para) > {size} THEN string_split(replace(para, '. ', '.' || chr(10)), chr(10)) ELSE [para] END AS us, length(para) > {size} AS long FROM p),
u AS (SELECT key, pi, long, unnest(us) AS t, generate_subscripts(us, 1) AS k FROM q),
e AS MATERIALIZED (SELECT key, t, long AND k = 1 AS fresh, length(t) + CASE WHEN long THEN 0 ELSE 2 END AS w, row_number() OVER (PARTITION BY key ORDER BY pi, k) AS i FROM u),
step AS (SELECT DISTINCT key, 0::BIGINT AS i, 0 AS g, 0::BIGINT AS used FROM e UNION ALL
  SELECT e.key, e.i, CASE WHEN {new} THEN g + 1 ELSE g END, CASE WHEN {new} THEN CASE WHEN fresh THEN w ELSE length(t) END ELSE used + w END
  FROM step JOIN e ON e.key = step.key AND e.i = step.i + 1),
dealt AS (SELECT key, g AS chunk, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM step JOIN e USING (key, i) GROUP BY key, g UNION ALL SELECT key, 0, t FROM d WHERE length(t) <= {size})"""


_SMART_SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id AS key, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents WHERE text IS NOT NULL),{_dealt_sql(2000)}
SELECT key AS doc_id, chunk, text FROM dealt"""


@query(_SMART_SQL)
def smart_chunks(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(X.split_column(F.replace("text", F.lit("\n"), F.lit("\n\n")), 2000)).alias("chunk", "text"))


_OVERLAP_SQL = """WITH RECURSIVE s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?。！？]+[.!?。！？]+') AS x, text FROM documents),
n AS (SELECT doc_id, CASE WHEN len(x) > 0 THEN x ELSE list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> '') END AS x FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM n),
step AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, -1 AS g, 0::BIGINT AS room FROM e UNION ALL
  SELECT e.doc_id, e.i, CASE WHEN g < 0 OR room + length(t) > 2000 THEN g + 1 ELSE g END, CASE WHEN g < 0 OR room + length(t) > 2000 THEN length(t) ELSE room + length(t) END
  FROM step JOIN e ON e.doc_id = step.doc_id AND e.i = step.i + 1),
grp AS MATERIALIZED (SELECT doc_id, g, list(t ORDER BY i) AS l FROM step JOIN e USING (doc_id, i) GROUP BY doc_id, g)
SELECT a.doc_id, a.g AS chunk, CASE WHEN b.l IS NULL THEN '' ELSE '[CONTEXT]: ' || array_to_string(b.l[greatest(len(b.l) - 1, 1):], ' ') || chr(10) || chr(10) END || array_to_string(a.l, ' ') AS text
FROM grp a LEFT JOIN grp b ON b.doc_id = a.doc_id AND b.g = a.g - 1"""


@query(_OVERLAP_SQL)
def overlap_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.overlap_column(F.col("text"), 2000, 2)).alias("chunk", "text"))


_BIO_SQL = f"""WITH d AS (SELECT doc_id, text, regexp_split_to_array(text, '\\n\\s*\\n') AS a, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS b FROM documents),
p AS (SELECT doc_id, text, list_filter(list_transform(CASE WHEN len(a) < 5 THEN b ELSE a END, lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: length(l) >= 30
  AND (regexp_matches(l, '(?i)\\bthe\\b|\\d{{4}}') OR (length(l) < 200 AND ({" OR ".join(f"contains(lower(l), '{w}')" for w in vocab.BIO_SECTIONS)})))) AS k FROM d),
h AS (SELECT *, list_transform(k, lambda l: lower(substr(l, 1, 100))) AS heads FROM p),
f AS (SELECT doc_id, text, list_filter(k, lambda l, i: list_position(heads, lower(substr(l, 1, 100))) = i) AS x FROM h),
j AS (SELECT doc_id, text, len(x) AS n, array_to_string(x, chr(10) || chr(10)) AS t FROM f)
SELECT doc_id, CASE WHEN n < 3 THEN substr(text, 1, 5000) WHEN length(t) > 8000 THEN substr(t, 1, 8000) || chr(10) || chr(10) || '[... cut ...]' ELSE t END AS excerpt FROM j"""


@query(_BIO_SQL)
def bio_paragraphs(spark, sf):
    return filters.bio_paragraphs(table(spark, sf, "documents"), "doc_id", patterns=(r"\bthe\b", r"\d{4}"))


_PAGES_SQL = """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text:grid_read' WHEN 1 THEN 'skip:no_kinetic_keywords' WHEN 2 THEN 'vision:html_incomplete' WHEN 3 THEN 'vision:grid_failed'
  ELSE CASE WHEN coalesce(length(html), 0) < 100 THEN 'vision:html_incomplete' ELSE 'vision:grid_failed' END END AS route, page_id % 3 <> 0 AS caption_passes FROM pages
"""


def page_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """page_id, body: tables whose grid can be read, without kinetic words, too short, not readable, and the
    pages' own HTML, which holds no table."""
    k = F.col("page_id") % 5
    row = "<tr><td>Km</td><td>" + "1" * 60 + "</td></tr>"
    body = (
        F.when(k == 0, f"<table><tr><td>Km</td><td>kcat</td></tr>{row}</table>")
        .when(k == 1, "<table><thead><tr><th>Name</th></tr></thead></table>" + " " * 80)
        .when(k == 2, "<tr><td>kcat</td></tr>")
        .when(k == 3, "Km and kcat, but no table at all" + "." * 100)
        .otherwise(F.col("html"))
    )
    return table(spark, sf, "pages").select("page_id", "url", body.alias("body"))


@query(_PAGES_SQL)
def page_header_route(spark, sf):
    caption = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Primer list of "), "url")).otherwise(F.col("url"))
    return page_bodies(spark, sf).select(
        "page_id", filters.route_table(F.col("body"), grids.grid_ok(F.col("body"))).alias("route"),
        filters.caption_passes(caption, exclude=("primer", "sequence")).alias("caption_passes"),
    )


def _turn_blocks(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(
        F.col("conv_id").alias("paper_name"), F.col("turn").cast("int").alias("block_id"),
        F.when(F.col("turn") % 3 == 0, "image").otherwise("text").alias("type"),
        F.when(F.col("turn") % 3 == 1, F.concat(F.lit("Fig. 1 "), "text")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("turn") % 3 == 0, "a.png").alias("img_path"), F.lit(None).cast("string").alias("image_path"),
        F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("own"), F.lit("caption"))).alias("image_caption"),
    )


@query(
    """WITH b AS (SELECT conv_id AS paper_name, turn::INT AS block_id, lead(CASE WHEN turn % 3 = 1 THEN 'Fig. 1 ' || text END) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, turn FROM conversations)
    SELECT paper_name, block_id, 'a.png' AS image_path, CASE WHEN paper_name % 2 = 0 THEN 'own caption' ELSE coalesce(nxt, 'No caption available') END AS caption
    FROM b WHERE turn % 3 = 0"""
)
def next_block_caption(spark, sf):
    return blocks.figure_contexts(_turn_blocks(spark, sf))


@query(
    """SELECT c.conv_id AS paper_name, c.turn::INT AS rec_idx, substr(string_agg(d.text, chr(10) || chr(10) ORDER BY d.turn), 1, 8000) AS context
    FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn BETWEEN c.turn - 2 AND c.turn + 2 WHERE d.text <> '' GROUP BY ALL"""
)
def block_context_window(spark, sf):
    b = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("paper_name"), F.col("turn").cast("int").alias("block_id"), F.lit("text").alias("type"), "text"
    )
    r = b.select("paper_name", F.col("block_id").alias("rec_idx"), F.col("block_id").alias("block_no"))
    return blocks.context_windows(r, b, reach=2)


# Runs of text blocks lie between images; a run has two blocks at most, which stay apart beyond 1.5 sizes.
_MERGED_SQL = f"""WITH RECURSIVE b AS (SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 3 = 1 THEN 'Fig. 1 ' || text ELSE text END, '^\\s+|\\s+$', '', 'g') AS t FROM conversations WHERE turn % 3 > 0),
f AS (SELECT *, turn // 3 AS run FROM b WHERE t <> ''),
w AS (SELECT *, min(turn) OVER r AS head, sum(length(t)) OVER r AS total FROM f WINDOW r AS (PARTITION BY conv_id, run)),
d AS MATERIALIZED (SELECT struct_pack(c := conv_id, o := CASE WHEN total > 1500 THEN turn ELSE head END) AS key, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS t FROM w GROUP BY 1),{_dealt_sql(1000)}
SELECT key.c AS paper_name, key.o::INT AS block_id, 'text' AS type, chunk::INT AS part, text AS content FROM dealt
UNION ALL SELECT conv_id, turn::INT, 'image', 0, text FROM conversations WHERE turn % 3 = 0"""


@query(_MERGED_SQL)
def merged_text_blocks(spark, sf):
    return blocks.merge_text_blocks(_turn_blocks(spark, sf), size=1000)


@query(
    """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE turn % 2 = 1)
    SELECT DISTINCT c.conv_id AS paper_name, CASE WHEN c.conv_id % 3 = 1 THEN 'Tab. 2' ELSE 'Table 2' END AS table_id, t.turn::INT AS block,
      CASE WHEN t.turn IS NULL THEN NULL WHEN t.k = 1 THEN 1 + c.conv_id % 3 ELSE 3 END::INT AS tier
    FROM conversations c LEFT JOIN t ON c.conv_id = t.conv_id AND t.k = CASE WHEN c.conv_id % 3 < 2 THEN 1 ELSE 2 END"""
)
def table_lookup(spark, sf):
    """By the id in a caption, by its number there, and by place."""
    named = (F.col("turn") == 1) & (F.col("conv_id") % 3 < 2)
    b = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("paper_name"), F.col("turn").cast("int").alias("block_id"), F.when(F.col("turn") % 2 == 1, "table").otherwise("text").alias("type"),
        F.when(named, F.array(F.lit("See"), F.lit("TABLE 2."))).otherwise(F.array(F.lit("no"), F.lit("name"))).alias("table_caption"),
    )
    asked = b.select("paper_name", F.when(F.col("paper_name") % 3 == 1, "Tab. 2").otherwise("Table 2").alias("table_id")).distinct()
    return blocks.find_table(asked, b)


# ---------------------------------------------------------------- records


@query(with_records("SELECT paper_name, rec_idx, confidence_score FROM scored", True))
def confidence_score(spark, sf):
    return scored(spark, sf).select(*KEY, "confidence_score")


@query(
    with_records(
        """SELECT count(*) AS total, round(avg(confidence_score), 2) AS avg_score, count(*) FILTER (confidence_score >= 4) AS high_quality,
    count(*) FILTER (confidence_score = 3) AS medium_quality, count(*) FILTER (confidence_score = 2) AS low_quality, 0 AS score_1,
    count(*) FILTER (confidence_score = 2) AS score_2, count(*) FILTER (confidence_score = 3) AS score_3, 0 AS score_4, 0 AS score_5 FROM scored WHERE confidence_score > 1""",
        True,
    )
)
def validated_summary(spark, sf):
    return R.score_summary(R.validated(records(spark, sf)))


@query(
    with_records(
        """SELECT count(*) AS total_records, count(DISTINCT paper_name) AS total_papers, count(*) FILTER (confidence_score = 3) AS good,
    count(*) FILTER (confidence_score = 2) AS medium, count(*) FILTER (confidence_score = 1) AS poor,
    100.0::DOUBLE * count(*) FILTER (confidence_score = 3) / count(*) AS good_percent, 100.0::DOUBLE * count(*) FILTER (confidence_score = 2) / count(*) AS medium_percent,
    100.0::DOUBLE * count(*) FILTER (confidence_score = 1) / count(*) AS poor_percent FROM scored""",
        True,
    )
)
def quality_report(spark, sf):
    return reports.quality_report(scored(spark, sf))


@query(
    with_records(
        """SELECT paper_name, count(*) AS total_records, avg(confidence_score) AS avg_score, count(*) FILTER (confidence_score = 3) AS score_3,
    count(*) FILTER (confidence_score = 2) AS score_2, count(*) FILTER (confidence_score = 1) AS score_1 FROM scored GROUP BY paper_name""",
        True,
    )
)
def paper_quality(spark, sf):
    return reports.paper_quality(scored(spark, sf))


@query(
    with_records(
        """, low AS (SELECT * FROM scored WHERE confidence_score < 3), f AS (
    SELECT 'enzyme_name' AS field, count(*) FILTER (enzyme_name IS NULL) AS n FROM low UNION ALL SELECT 'Km_value', count(*) FILTER (Km_value IS NULL) FROM low
    UNION ALL SELECT 'kcat_value', count(*) FILTER (kcat_value IS NULL) FROM low UNION ALL SELECT 'kcat_Km_value', count(*) FROM low
    UNION ALL SELECT 'degradation_efficiency', count(*) FILTER (degradation_efficiency IS NULL) FROM low
    UNION ALL SELECT 'organism_info', count(*) FILTER (organism IS NULL) FROM low UNION ALL SELECT 'ph', count(*) FILTER (ph IS NULL AND optimal_ph IS NULL) FROM low
    UNION ALL SELECT 'temperature', count(*) FROM low UNION ALL SELECT 'ec_number', count(*) FILTER (ec_number IS NULL) FROM low
    UNION ALL SELECT 'enzyme_full_name', count(*) FILTER (enzyme_full_name IS NULL) FROM low)
    SELECT field, n FROM f WHERE n > 0 ORDER BY n DESC, field LIMIT 10""",
        True,
    )
)
def missing_fields_top10(spark, sf):
    return reports.missing_fields(scored(spark, sf))


@query(
    with_records(
        """SELECT CASE WHEN enzyme_name IS NULL OR substrate IS NULL THEN 'missing_core_fields'
    WHEN Km_value IS NULL AND kcat_value IS NULL AND degradation_efficiency IS NULL THEN 'missing_kinetics_only'
    WHEN organism IS NULL THEN 'missing_organism_only' WHEN ph IS NULL AND optimal_ph IS NULL THEN 'missing_conditions_only' ELSE 'incomplete_data' END AS pattern,
    count(*) AS n FROM scored WHERE confidence_score <= 2 GROUP BY 1""",
        True,
    )
)
def failure_patterns(spark, sf):
    return reports.failure_patterns(scored(spark, sf).where("confidence_score <= 2"))


@query(with_records("SELECT paper_name, rec_idx, confidence_score FROM scored WHERE confidence_score <= 2 ORDER BY md5(paper_name || ':' || rec_idx || ':0'), paper_name, rec_idx LIMIT 20", True))
def low_quality_sample(spark, sf):
    return reports.low_quality_sample(scored(spark, sf)).select(*KEY, "confidence_score")


# Each of the three checks, in their order, on records that are made to fail it.
_CONSTRAINT_SQL = """, low AS (SELECT paper_name, rec_idx, lower(substrate) AS s, lower(coalesce(notes, '')) AS nt, ec_number,
      CASE WHEN rec_idx % 9 = 0 THEN 'made less toxic' WHEN rec_idx % 9 = 1 THEN 'an Epoxide forms' ELSE '' END AS extra FROM rec),
    q AS (SELECT *, CASE WHEN ec_number IS NULL AND contains(nt, 'crude extract') THEN 'Crude extract/mixture detected: ''crude extract'''
      WHEN contains(s, 'medium') THEN 'Non-mycotoxin substrate: ''' || s || ''''
      WHEN contains(extra, 'Epoxide') THEN 'Bioactivation detected: ''epoxide''' END AS reject_reason FROM low),
    c AS (SELECT *, CASE WHEN reject_reason IS NULL THEN 'passed' WHEN contains(reject_reason, 'Crude') THEN 'no_sequence' WHEN contains(reject_reason, 'substrate') THEN 'non_mycotoxin' ELSE 'bioactivation' END AS reject_bucket FROM q)"""


def _constrained(spark, sf):
    extra = F.when(F.col("rec_idx") % 9 == 0, "made less toxic").when(F.col("rec_idx") % 9 == 1, "an Epoxide forms")
    rows = records(spark, sf).withColumns({"uniprot_id": F.col("ec_number"), "notes": F.concat_ws("; ", "notes", extra)})
    return R.quality_constraints(rows, False, SUBSTRATES, OTHER_SUBSTRATES)


@query(with_records(_CONSTRAINT_SQL + " SELECT paper_name, rec_idx, reject_reason, reject_bucket FROM c"))
def quality_constraints(spark, sf):
    return _constrained(spark, sf).select(*KEY, "reject_reason", "reject_bucket")


@query(
    with_records(
        _CONSTRAINT_SQL
        + """ SELECT count(*) AS total, count(*) FILTER (reject_bucket = 'passed') AS passed, count(*) FILTER (reject_bucket <> 'passed') AS rejected,
    count(*) FILTER (reject_bucket = 'no_sequence') AS rejected_no_sequence, count(*) FILTER (reject_bucket = 'non_mycotoxin') AS rejected_non_mycotoxin,
    count(*) FILTER (reject_bucket = 'bioactivation') AS rejected_bioactivation, 0 AS rejected_other, 100.0::DOUBLE * count(*) FILTER (reject_bucket <> 'passed') / count(*) AS rejection_rate FROM c"""
    )
)
def constraint_stats(spark, sf):
    return R.constraint_stats(_constrained(spark, sf))


@query(
    with_records(
        """, s AS (SELECT paper_name, rec_idx, (enzyme_name IS NOT NULL)::INT + (enzyme_type IS NOT NULL)::INT + 2 * (Km_value IS NOT NULL OR kcat_value IS NOT NULL)::INT
    + (degradation_efficiency IS NOT NULL)::INT + (product IS NOT NULL)::INT + (ph IS NOT NULL)::INT AS quality_score FROM rec)
    SELECT *, quality_score < 3 AS low_quality FROM s"""
    )
)
def record_filter_score(spark, sf):
    return R.additive_score(records(spark, sf), 3).select(*KEY, "quality_score", "low_quality")


_KNOWN = "(contains(lower(substrate), 'economy') OR contains(lower(substrate), 'standard') OR contains(lower(substrate), 'promo'))"


@query(with_records(f"SELECT paper_name, rec_idx, substrate FROM rec WHERE {_KNOWN} OR substrate = 'LARGE'"))
def substrate_filter(spark, sf):
    judged = spark.createDataFrame([("LARGE",)], "substrate string")
    return R.substrate_filter(records(spark, sf), SUBSTRATES, judged).select(*KEY, "substrate")


@query(with_records(f"SELECT DISTINCT substrate FROM rec WHERE NOT {_KNOWN}"))
def unknown_substrates(spark, sf):
    return R.unknown_substrates(records(spark, sf), SUBSTRATES)


@query(
    with_records(
        """, w AS (SELECT *, coalesce(organism, 'None') || '|' || coalesce(mutations, '') AS variant FROM scored),
    f AS (SELECT paper_name, rec_idx, enzyme_name, enzyme_full_name, enzyme_type, ec_number, optimal_ph,
      first_value(enzyme_full_name IGNORE NULLS) OVER e AS b1, first_value(enzyme_type IGNORE NULLS) OVER e AS b2, first_value(ec_number IGNORE NULLS) OVER e AS b3,
      first_value(optimal_ph IGNORE NULLS) OVER v AS b4 FROM w
      WINDOW e AS (PARTITION BY paper_name, enzyme_name ORDER BY confidence_score DESC, contains(block_id, 'table_block_4') DESC, contains(block_id, 'text_block') DESC, rec_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
      v AS (PARTITION BY paper_name, enzyme_name, variant ORDER BY confidence_score DESC, rec_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT paper_name, rec_idx, CASE WHEN enzyme_name IS NULL THEN enzyme_full_name ELSE coalesce(enzyme_full_name, b1) END AS enzyme_full_name,
      CASE WHEN enzyme_name IS NULL THEN enzyme_type ELSE coalesce(enzyme_type, b2) END AS enzyme_type, CASE WHEN enzyme_name IS NULL THEN ec_number ELSE coalesce(ec_number, b3) END AS ec_number,
      CASE WHEN enzyme_name IS NULL THEN optimal_ph ELSE coalesce(optimal_ph, b4) END AS optimal_ph FROM f""",
        True,
    )
)
def intra_paper_fill(spark, sf):
    return R.fill_within_paper(scored(spark, sf)).select(*KEY, "enzyme_full_name", "enzyme_type", "ec_number", "optimal_ph")


@query(
    with_records(
        """SELECT paper_name, rec_idx, CASE Km_unit WHEN 'mM' THEN Km_value * 1000 WHEN 'um' THEN Km_value WHEN 'nM' THEN Km_value / 1000 END AS km_um, 'μM' AS km_unit,
    CASE kcat_unit WHEN 'min-1' THEN kcat_value / 60 END AS kcat_s, 's^-1' AS kcat_unit FROM rec"""
    )
)
def unit_normalise(spark, sf):
    km, kcat = V.convert(F.col("Km_value"), F.col("Km_unit"), V.CONCENTRATION), V.convert(F.col("kcat_value"), F.col("kcat_unit"), V.RATE)
    return records(spark, sf).select(*KEY, km["value"].alias("km_um"), km["unit"].alias("km_unit"), kcat["value"].alias("kcat_s"), kcat["unit"].alias("kcat_unit"))


@query(
    with_records(
        """SELECT paper_name, rec_idx, lower(coalesce(enzyme_name, '')) AS enzyme, lower(substrate) AS substrate, lower(coalesce(mutations, '')) AS mutations FROM rec"""
    )
)
def entity_keys(spark, sf):
    return records(spark, sf).select(*KEY, merging.entity_key().alias("k")).select(*KEY, "k.*")


_VOTE_SQL = with_records(
    """, k AS (SELECT *, lower(coalesce(enzyme_name, '')) || '|' || lower(substrate) || '|' || lower(coalesce(mutations, '')) AS vk,
    (enzyme_name IS NOT NULL)::INT + 1 + (organism IS NOT NULL)::INT + (Km_value IS NOT NULL)::INT + (kcat_value IS NOT NULL)::INT + (degradation_efficiency IS NOT NULL)::INT
    + (product IS NOT NULL)::INT + (ph IS NOT NULL)::INT + (ec_number IS NOT NULL)::INT AS c FROM rec)
    SELECT paper_name, any_value(lower(coalesce(enzyme_name, ''))) AS enzyme, any_value(lower(substrate)) AS substrate, count(DISTINCT model)::INT AS votes,
      first(rec_idx ORDER BY -c, model, rec_idx) AS rec_idx, first(Km_value ORDER BY -c, model, rec_idx) FILTER (Km_value IS NOT NULL) AS Km_value,
      first(kcat_value ORDER BY -c, model, rec_idx) FILTER (kcat_value IS NOT NULL) AS kcat_value, first(ec_number ORDER BY -c, model, rec_idx) FILTER (ec_number IS NOT NULL) AS ec_number
    FROM k GROUP BY paper_name, vk HAVING count(DISTINCT model) >= 2"""
)


@query(_VOTE_SQL)
def majority_vote(spark, sf):
    v = merging.majority_vote(records(spark, sf))
    return v.select(
        "paper_name", F.lower(F.coalesce("enzyme_name", F.lit(""))).alias("enzyme"), F.lower("substrate").alias("substrate"), "votes", "rec_idx",
        "Km_value", "kcat_value", "ec_number",
    )


_VOTED = (
    "enzyme_name", "enzyme_full_name", "enzyme_type", "ec_number", "organism", "mutations", "substrate", "Km_value", "Km_unit", "kcat_value", "kcat_unit",
    "degradation_efficiency", "ph", "optimal_ph", "notes",
)


@query(
    with_records(
        f""", k AS (SELECT *, lower(coalesce(enzyme_name, '')) || '|' || lower(substrate) || '|' || lower(coalesce(mutations, '')) AS vk,
    (enzyme_name IS NOT NULL)::INT + 1 + (organism IS NOT NULL)::INT + (Km_value IS NOT NULL)::INT + (kcat_value IS NOT NULL)::INT + (degradation_efficiency IS NOT NULL)::INT
    + (product IS NOT NULL)::INT + (ph IS NOT NULL)::INT + (ec_number IS NOT NULL)::INT AS c FROM rec)
    SELECT paper_name, count(DISTINCT model)::INT AS votes, {", ".join(f"first({c} ORDER BY -c, model, rec_idx) FILTER ({c} IS NOT NULL) AS {c}" for c in _VOTED)},
      {", ".join(f"first({c} ORDER BY -c, model, rec_idx) AS {c}" for c in ("rec_idx", "model", "source_type", "block_id", "doi"))} FROM k GROUP BY paper_name, vk HAVING count(DISTINCT model) >= 2"""
    )
)
def vote_and_merge(spark, sf):
    """No two keys of the vote are one entity here, so the merge passes its rows on."""
    return merging.vote_and_merge(records(spark, sf)).select("paper_name", "votes", *_VOTED, "rec_idx", "model", "source_type", "block_id", "doi")


def _positions(spark, sf):
    """Each model's records of a paper, numbered in order."""
    rows = records(spark, sf).drop("rec_idx")
    w = Window.partitionBy("paper_name", "model").orderBy("old")
    return records(spark, sf).withColumnRenamed("rec_idx", "old").withColumn("rec_idx", F.row_number().over(w) - 1).select("rec_idx", "old", *rows.columns)


@query(
    with_records(
        """, n AS (SELECT *, row_number() OVER (PARTITION BY paper_name, model ORDER BY rec_idx) - 1 AS pos FROM rec),
    v AS (SELECT paper_name, pos, model, 'substrate' AS field, substrate AS value FROM n UNION ALL SELECT paper_name, pos, model, 'enzyme_name', enzyme_name FROM n
      UNION ALL SELECT paper_name, pos, model, 'Km_unit', Km_unit FROM n UNION ALL SELECT paper_name, pos, model, 'organism', organism FROM n
      UNION ALL SELECT paper_name, pos, model, 'ec_number', ec_number FROM n),
    t AS (SELECT paper_name, pos, field, value, count(*) AS votes, min(model) AS fst FROM v WHERE value IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, sum(votes) OVER (PARTITION BY paper_name, pos, field) AS total, row_number() OVER (PARTITION BY paper_name, pos, field ORDER BY votes DESC, fst, value) AS k FROM t)
    SELECT paper_name, pos AS rec_idx, field, value, votes, total::BIGINT AS total, CASE WHEN votes = total THEN 'high' WHEN votes >= total * 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE k = 1"""
    )
)
def positional_vote(spark, sf):
    fields = ("substrate", "enzyme_name", "Km_unit", "organism", "ec_number")
    return merging.positional_votes(_positions(spark, sf), fields).drop("alternatives")


_PLACED = ("Km_value", "Km_unit", "kcat_value", "kcat_unit", "ph", "substrate", "enzyme_name", "organism", "enzyme_full_name", "ec_number")
_PLACED_REST = ("old", "source_type", "block_id", "doi", "enzyme_type", "mutations", "degradation_efficiency", "optimal_ph", "notes")


def _placed_sql() -> str:
    def said(f: str) -> str:
        if f in ("Km_value", "kcat_value", "ph"):
            return f"CASE WHEN {f} <> 0 THEN round({f}, 4)::VARCHAR END"
        return f"CASE WHEN {f} NOT IN ('', 'Unknown', 'N/A') THEN {f} END"

    votes = " UNION ALL ".join(f"SELECT paper_name, pos, model, '{f}' AS field, {said(f)} AS value FROM n" for f in _PLACED)
    wide = ", ".join(f"max(value) FILTER (field = '{f}'){'::DOUBLE' if f in ('Km_value', 'kcat_value', 'ph') else ''} AS {f}" for f in _PLACED)
    return f""", n AS (SELECT *, rec_idx AS old, row_number() OVER (PARTITION BY paper_name, model ORDER BY rec_idx) - 1 AS pos FROM rec),
    v AS ({votes}), t AS (SELECT paper_name, pos, field, value, count(*) AS votes, min(model) AS fst FROM v WHERE value IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, sum(votes) OVER (PARTITION BY paper_name, pos, field) AS total, row_number() OVER (PARTITION BY paper_name, pos, field ORDER BY votes DESC, fst, value) AS k FROM t),
    w AS (SELECT paper_name, pos, {wide}, round(avg((votes = total)::INT), 6) AS consensus_rate FROM r WHERE k = 1 GROUP BY paper_name, pos),
    a AS (SELECT *, row_number() OVER (PARTITION BY paper_name, pos ORDER BY model) AS z FROM n)
    SELECT a.paper_name, a.pos AS rec_idx, {", ".join(f"w.{f}" for f in _PLACED)}, w.consensus_rate, {", ".join(f"a.{f}" for f in _PLACED_REST)}
    FROM a LEFT JOIN w ON a.paper_name = w.paper_name AND a.pos = w.pos WHERE z = 1"""


@query(with_records(_placed_sql()))
def positional_records(spark, sf):
    found = merging.positional_record(_positions(spark, sf)).withColumn("consensus_rate", F.round("consensus_rate", 6))
    return found.select(*KEY, *_PLACED, "consensus_rate", *_PLACED_REST)


_FOLD_SQL = " OR ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for c in ("enzyme_name", "enzyme_full_name", "substrate") for w in vocab.FOLD_KEYWORDS)


@query(
    with_records(
        f""", t AS (SELECT *, kcat_value IS NOT NULL AND kcat_unit IS NULL AS lone, coalesce(Km_unit = 'um', false) AS odd, {_FOLD_SQL} AS fold FROM rec)
    SELECT paper_name, rec_idx, Km_value, Km_unit, CASE WHEN NOT lone THEN kcat_value END AS kcat_value, kcat_unit, odd AS km_unit_odd, lone OR odd OR fold AS flagged,
      CASE WHEN lone OR odd OR fold THEN 'medium' ELSE 'high' END AS confidence, lone AS noted FROM t"""
    )
)
def post_validate(spark, sf):
    rows = R.post_validate(records(spark, sf).withColumns({"confidence": F.lit("high"), "before": F.coalesce("notes", F.lit(""))}))
    flag = F.coalesce("ambiguity_flag", F.lit(""))
    odd = flag.contains("Km_value=") & flag.contains("invalid unit")
    noted = F.coalesce("notes", F.lit("")) != F.col("before")
    return rows.select(*KEY, "Km_value", "Km_unit", "kcat_value", "kcat_unit", odd.alias("km_unit_odd"), (flag != "").alias("flagged"), "confidence", noted.alias("noted"))


@query(
    with_records(
        """, w AS (SELECT paper_name, rec_idx, row_number() OVER (PARTITION BY paper_name ORDER BY rec_idx) - 1 AS i, count(*) OVER (PARTITION BY paper_name) AS n FROM rec)
    SELECT paper_name, rec_idx, 'text_block_' || least(i // greatest(1, n // 7), 6) AS block_label FROM w"""
    )
)
def provenance_labels(spark, sf):
    return R.provenance(records(spark, sf), F.lit(7)).select(*KEY, "block_label")


# Of the three condition rows of every paper, those that fit a record by name and variant, in order.
_CONDITIONS_SQL = """, n AS (SELECT paper_name, rec_idx, optimal_ph::DOUBLE AS ph, lower(coalesce(enzyme_name, '')) AS n, mutations AS m FROM rec),
    f AS (SELECT *, (contains(n, 'brand#1') OR contains('brand#1', n)) AND m IS NULL AS first, coalesce((contains(n, 'brand#2') OR contains('brand#2', n)) AND m = 'E186R', false) AS second,
      coalesce((contains(n, 'brand') OR contains('brand', n)) AND m = 'E186R', false) AS third FROM n)
    SELECT paper_name, rec_idx, coalesce(ph, CASE WHEN first THEN 7.5::DOUBLE WHEN third THEN 9.0::DOUBLE END) AS optimal_ph,
      CASE WHEN second THEN 37.0::DOUBLE WHEN third THEN 50.0::DOUBLE END AS optimal_temperature_value, CASE WHEN second OR third THEN '°C' END AS optimal_temperature_unit FROM f"""


@query(with_records(_CONDITIONS_SQL))
def condition_fill(spark, sf):
    rows = [(0, "Brand#1", None, 7.5, None), (1, "brand#2", "e186r", None, 37.0), (2, "brand", "E186R", 9.0, 50.0)]
    each = spark.createDataFrame(rows, "cond_idx int, enzyme_name string, mutation string, optimal_ph double, optimal_temperature_value double")
    conditions = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("paper_name")).crossJoin(F.broadcast(each))
    filled_rows = R.fill_conditions(records(spark, sf), conditions)
    return filled_rows.select(*KEY, F.col("optimal_ph").cast("double").alias("optimal_ph"), "optimal_temperature_value", "optimal_temperature_unit")


@query(
    with_records(
        """, e AS (SELECT p_brand AS name, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY p_brand)
    SELECT paper_name, rec_idx, CASE WHEN enzyme_name IS NOT NULL THEN 'P' || id END AS uniprot_id FROM rec LEFT JOIN e ON enzyme_name = name"""
    )
)
def enrich_top1(spark, sf):
    entries = table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entry_id"), F.col("p_brand").alias("protein_name"),
        F.lit(None).cast("string").alias("gene_name"), F.lit("").alias("organism"), F.lit(True).alias("reviewed"), F.col("p_partkey").alias("position"),
    )
    rows = records(spark, sf).withColumn("organism", F.lit(""))
    return enrichment.enrich(rows, entries, threshold=0.0).select(*KEY, "uniprot_id")


# ---------------------------------------------------------------- evaluation


def _split(spark, sf):
    rows = records(spark, sf)
    return rows.where("model = 'm1' OR model = 'm2'"), rows.where("model = 'm0'")


@query(
    with_records(
        """SELECT count(*) FILTER (model <> 'm0') AS predicted, count(*) FILTER (model = 'm0') AS gold,
    (SELECT count(*) FROM (SELECT doi FROM rec WHERE model <> 'm0' INTERSECT SELECT doi FROM rec WHERE model = 'm0')) AS matched_dois FROM rec"""
    )
)
def overall_counts(spark, sf):
    return evaluation.overall(*_split(spark, sf))


# ---------------------------------------------------------------- tokens, reviews


@query("SELECT conv_id, turn, CASE WHEN text = '' THEN 0 ELSE greatest(1, ceil(length(text) / 4))::BIGINT END AS tokens FROM conversations")
def token_estimate(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", V.estimate_tokens(F.col("text")).alias("tokens"))


def _usage(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.when(F.col("event_type") == "error", "ZhipuAIClient").otherwise(F.col("event_type")).alias("provider"),
        F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("model"), (F.col("event_id") % 1000).alias("prompt_tokens"),
        (F.col("user_id") % 500).alias("completion_tokens"), F.when(F.col("event_id") % 7 == 0, "estimated").otherwise("api").alias("source"),
        (F.col("event_id") % 11 == 0).alias("is_multimodal"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("task"),
    )


_USAGE_SQL = """WITH u AS (SELECT CASE WHEN event_type = 'error' THEN 'zhipuaiclient' ELSE event_type END AS provider, 'u' || (user_id % 3) AS model, event_id % 1000 AS pt, user_id % 500 AS ct,
    event_id % 7 = 0 AS est, event_id % 11 = 0 AS mm, CASE WHEN event_id % 5 > 0 THEN event_type END AS task, event_type FROM events)"""


@query(
    _USAGE_SQL
    + """ SELECT CASE grouping(provider, model) WHEN 3 THEN 'total' WHEN 1 THEN 'provider' ELSE 'model' END AS level, provider, model, sum(pt)::BIGINT AS prompt_tokens, sum(ct)::BIGINT AS completion_tokens,
    sum(pt + ct)::BIGINT AS total_tokens, count(*) AS request_count, count(*) FILTER (est) AS estimated_requests, count(*) FILTER (mm) AS multimodal_requests,
    CASE WHEN provider = 'zhipuaiclient' THEN sum(pt) / 1e6 * 0.4 + sum(ct) / 1e6 * 0.8 ELSE 0 END AS cost, CASE WHEN provider = 'zhipuaiclient' THEN 'CNY' ELSE '' END AS currency
    FROM u GROUP BY GROUPING SETS ((), (provider), (provider, model))"""
)
def token_usage_rollup(spark, sf):
    return reports.token_summary(_usage(spark, sf)).withColumn("cost", F.col("cost"))


@query(
    """WITH u AS (SELECT CASE WHEN event_type = 'error' THEN 'ZhipuAIClient' ELSE event_type END AS provider, 'u' || (user_id % 3) AS model, event_id % 1000 + user_id % 500 AS t,
    coalesce(CASE WHEN event_id % 5 > 0 THEN event_type END, 'unspecified') AS task FROM events)
    SELECT task, provider, model, sum(t)::BIGINT AS total_tokens, count(*) AS request_count FROM u GROUP BY GROUPING SETS ((task, provider, model), (task))"""
)
def tokens_by_task(spark, sf):
    return reports.tokens_by_task(_usage(spark, sf))


@query(
    """SELECT CASE WHEN event_id % 3 = 0 THEN 10 ELSE 5 + event_id % 1000 END AS prompt, CASE WHEN event_id % 3 = 2 THEN event_id % 10 ELSE 0 END AS answer, event_id FROM events"""
)
def usage_fields(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    usage = (
        F.when(i % 3 == 0, F.lit('{"total_tokens": 10}'))
        .when(i % 3 == 1, F.format_string('{"prompt_tokens": %d}', 5 + i % 1000))
        .otherwise(F.format_string('{"input_tokens": %d, "output_tokens": %d}', 5 + i % 1000, i % 10))
    )
    u = V.usage_tokens(F.parse_json(usage))
    return e.select(u["prompt"].alias("prompt"), u["completion"].alias("answer"), "event_id")


@query(
    with_records(
        """, v AS (SELECT paper_name, rec_idx // 8 AS rec, CASE rec_idx % 3 WHEN 0 THEN 'MATCH' WHEN 1 THEN CASE WHEN kcat_value IS NULL THEN 'MATCH' ELSE 'MISMATCH' END ELSE 'UNCERTAIN' END AS s,
      50 + paper_name % 100 AS n FROM rec)
    SELECT paper_name, rec AS rec_idx, count(*) FILTER (s = 'MISMATCH') AS mismatch_count, count(*) FILTER (s = 'MATCH') AS match_count,
      CASE WHEN max(n) < 100 THEN 'UNCERTAIN' WHEN count(*) FILTER (s = 'MISMATCH') > 0 THEN 'FAIL' WHEN count(*) FILTER (s = 'MATCH') >= 3 THEN 'PASS' ELSE 'UNCERTAIN' END AS verdict
    FROM v GROUP BY paper_name, rec"""
    )
)
def cross_validation(spark, sf):
    k = F.col("rec_idx") % 3
    status = F.when(k == 0, "MATCH").when(k == 1, F.when(F.col("kcat_value").isNull(), "MATCH").otherwise("MISMATCH")).otherwise("UNCERTAIN")
    rows = records(spark, sf).select(
        "paper_name", F.floor(F.col("rec_idx") / 8).cast("int").alias("rec_idx"), status.alias("status"), (50 + F.col("paper_name") % 100).alias("context_chars")
    )
    return reports.verdicts(rows)


@query(
    with_records(
        """, d AS (SELECT paper_name, CASE WHEN enzyme_name IS NULL OR (Km_value IS NULL AND kcat_value IS NULL AND degradation_efficiency IS NULL) THEN 'REJECTED'
      WHEN organism IS NOT NULL THEN 'APPROVED' ELSE 'NEEDS_REVIEW' END AS d FROM rec)
    SELECT paper_name, count(*) FILTER (d = 'REJECTED') AS rejected, count(*) FILTER (d = 'APPROVED') AS approved, count(*) FILTER (d = 'NEEDS_REVIEW') AS needs_review,
      CASE WHEN count(*) FILTER (d = 'REJECTED') > 0 THEN 'REJECTED' WHEN count(*) FILTER (d = 'NEEDS_REVIEW') > 0 THEN 'NEEDS_REVIEW' ELSE 'APPROVED' END AS overall FROM d GROUP BY paper_name"""
    )
)
def review_rollup(spark, sf):
    return reports.review_rollup(R.review_rules(records(spark, sf)))


@query("SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch, doc_id FROM documents")
def paper_batches(spark, sf):
    """The numbering is over (id), a narrow row, in one sort."""
    return blocks.numbered_batches(table(spark, sf, "documents").select("doc_id"), 50, "doc_id").select("batch", "doc_id")


# ---------------------------------------------------------------- answers, sinks, streams


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN 0 WHEN 4 THEN 1 WHEN 3 THEN 1 ELSE 2 END AS n, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE 'E' || doc_id END AS enzyme FROM documents"""
)
def parse_answers(spark, sf):
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    a = F.concat(F.lit('{"enzyme_name": "E'), i, F.lit('", "Km_value": 1.5}'))
    answer = (
        F.when(k == 0, F.concat(F.lit("["), a, F.lit(", "), a, F.lit("]")))
        .when(k == 1, F.concat(F.lit("Here:\n```json\n["), a, F.lit(","), a, F.lit(",]\n```")))
        .when(k == 2, F.concat(F.lit("["), a, F.lit(" "), a, F.lit("]")))
        .when(k == 3, F.concat(F.lit("["), a, F.lit(', {"enzyme_name": "cut o')))
        .when(k == 4, a)
        .otherwise("no data")
    )
    found = table(spark, sf, "documents").select("doc_id", X.records_column(answer).alias("r"))
    return found.select("doc_id", F.size("r").alias("n"), F.get_json_object(F.get("r", F.lit(0)), "$.enzyme_name").alias("enzyme"))


_FLAT_EMPTY = (
    "preparation_level", "uniprot_id", "pdb_id", "ncbi_protein_id", "substrate_matrix", "detection_method", "buffer_system", "enzyme_concentration_value",
    "enzyme_concentration_unit", "cofactors", "source_organism_strain", "vmax_unit", "kcat_km_unit", "reaction_time_unit", "temperature_unit", "optimal_temperature_unit",
)
_FLAT_NULL = ("vmax_value", "kcat_km_value", "reaction_time_value", "temperature_value", "optimal_temperature_value")


@query(
    with_records(
        f"""SELECT paper_name AS paper, rec_idx, enzyme_name, ec_number AS enzyme_ec_number, organism AS source_organism_name, NULL::BOOLEAN AS is_recombinant, rec_idx % 2 = 0 AS is_wild_type,
    mutations, substrate AS substrate_name, CASE rec_idx % 3 WHEN 0 THEN 10.5::DOUBLE END AS substrate_initial_concentration_value, CASE rec_idx % 3 WHEN 0 THEN 'μM each' END AS substrate_initial_concentration_unit,
    Km_value AS km_value, Km_unit AS km_unit, kcat_value, kcat_unit, degradation_efficiency, ph AS ph_value, optimal_ph, paper_name || '/' || rec_idx AS notes,
    CASE WHEN product IS NOT NULL THEN '[{{"name":"' || product || '"' || CASE WHEN toxicity_change IS NOT NULL THEN ',"toxicity_change":"' || toxicity_change || '"' ELSE '' END || '}}]' END AS reaction_products,
    doi, source_type, {", ".join(f"NULL::VARCHAR AS {c}" for c in _FLAT_EMPTY)}, {", ".join(f"NULL::DOUBLE AS {c}" for c in _FLAT_NULL)} FROM rec"""
    )
)
def csv_flatten(spark, sf):
    """All columns of the flat table."""
    i = F.col("rec_idx")
    given = F.when(i % 3 == 0, " 10.5  μM each").when(i % 3 == 1, "10.5μM")
    rows = records(spark, sf).withColumns(
        {"substrate_concentration": given, "is_wild_type": i % 2 == 0, "uniprot_id": F.lit("P1"), "notes": F.concat_ws("/", "paper_name", "rec_idx")}
    )
    key = F.split("notes", "/")
    return sinks.flat(rows).select(key[0].cast("bigint").alias("paper"), key[1].cast("int").alias("rec_idx"), "*")


@query(
    with_records(
        """SELECT coalesce(enzyme_name, '') AS enzyme_name, coalesce(organism, '') AS organism, coalesce(substrate, '') AS substrate_name, count(*) AS n_records,
    last(Km_value ORDER BY paper_name, rec_idx) FILTER (Km_value IS NOT NULL) AS Km_value FROM rec GROUP BY 1, 2, 3"""
    )
)
def relational_model(spark, sf):
    t = sinks.relational(records(spark, sf))
    joined = t["kinetic_parameters"].join(t["enzymes"], "enzyme_id").join(t["substrates"], "substrate_id")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return joined.select(blank("enzyme_name"), blank("organism"), blank("substrate_name"), "n_records", "Km_value")


@query(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS value
    FROM events GROUP BY ALL"""
)
def usage_windows_hourly(spark, sf):
    w = usage_windows(table(spark, sf, "events")).drop("users")
    return w.withColumns({"value": F.round("value", 2), **{c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}})


@query(
    with_records(
        "SELECT paper_name, rec_idx, (enzyme_name IS NOT NULL)::INT + (organism IS NOT NULL)::INT + 1 + (Km_value IS NOT NULL)::INT AS n_filled FROM rec"
    )
)
def normalised_schema(spark, sf):
    rows = normalise(records(spark, sf).drop("strain", "gene_name"))
    n = count_true(*[filled(F.col(c), k) for c, k in (("enzyme_name", "string"), ("organism", "string"), ("substrate", "string"), ("Km_value", "double"), ("strain", "string"))])
    return rows.select(*KEY, n.alias("n_filled"))


def queries() -> dict[str, Query]:
    from . import coverage  # noqa: F401  adds its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return precheck_documents(spark, sf)


__all__ = ["queries", "oracle_sql", "flagship", "answers"]
