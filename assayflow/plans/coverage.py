"""Registered queries of the smaller operators: names, cuts, scores, candidates, reports, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import blocks, enrichment, evaluation, filters, merging, reports
from ..operators import records as R
from ..schema import RECORD_DDL
from ..sources import answers, grids
from .chain import ChainRules, post_process, review_process
from .derived import SCORE_SQL, records, table
from .queries import KEY, OTHER_SUBSTRATES, SUBSTRATES, _split, page_bodies, query, with_records


def _i() -> Column:
    return F.col("rec_idx")


# ---------------------------------------------------------------- texts


@query(
    """WITH d AS (SELECT doc_id, text, doc_id % 3 AS k FROM documents WHERE NOT contains(text, '#'))
    SELECT doc_id, md5(CASE k WHEN 2 THEN text || chr(10) || 'no header' ELSE text END) AS markdown,
      md5(regexp_replace(CASE k WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'Tables 1 rest' ELSE text || chr(10) || 'no header' END, '^\\s+|\\s+$', '', 'g')) AS paper,
      md5(CASE k WHEN 2 THEN text ELSE 'H' || chr(10) || '2. Methods' || chr(10) || text END) AS introduction FROM d"""
)
def section_cuts(spark, sf):
    """The cuts of two other extractors' reference sections, and of the introduction."""
    k, t = F.col("doc_id") % 3, F.col("text")
    markdown = F.concat(t, F.when(k == 0, "\nReferences\nA. B.").when(k == 1, "\n参考文献\nA. B.").otherwise("\nno header"))
    paper = F.concat(t, F.when(k == 0, "\n## Literature Cited\nA. B.").when(k == 1, "\n# References [1] A. Table 1 rest").otherwise("\nno header"))
    intro = F.when(k == 2, t).otherwise(F.concat(F.lit("H\n1. Introduction\nleft out\n2. Methods\n"), t))
    cut = (X.cut_markdown_references(markdown), X.cut_paper_references(paper), X.cut_introduction(intro))
    names = ("markdown", "paper", "introduction")
    d = table(spark, sf, "documents").where(~t.contains("#"))
    return d.select("doc_id", *[F.md5(c).alias(n) for c, n in zip(cut, names, strict=True)])


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"tool": "t", "n": ' || doc_id || '}' WHEN 1 THEN '{"tool_name": "u"}' END AS call FROM documents"""
)
def tool_calls(spark, sf):
    k = F.col("doc_id") % 4
    fenced = F.concat(F.lit('Look:\n```json\n{"tool": "t", "n": '), F.col("doc_id").cast("string"), F.lit("}\n```"))
    answer = F.when(k == 0, fenced).when(k == 1, 'I ask {"tool_name": "u"}').when(k == 2, '{"tool": broken').otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", X.tool_call(answer).alias("call"))


_LOOSE = "CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'NaN' ELSE ' 1,234.5 ' END"


@query(
    f"""SELECT conv_id, turn, conv_id % 4 = 3 AS has_value, CASE WHEN conv_id % 4 = 3 THEN 1234.5::DOUBLE WHEN conv_id % 4 = 2 THEN 'NaN'::DOUBLE END AS number,
    lower(regexp_replace(trim({_LOOSE} || '  A  b '), '\\s+', ' ', 'g')) AS normal,
    (CASE WHEN role = '' THEN 0 ELSE greatest(1, ceil(length(role) / 4)) END + CASE WHEN text = '' THEN 0 ELSE greatest(1, ceil(length(text) / 4)) END + 1024 * (turn % 2))::BIGINT AS tokens
    FROM conversations"""
)
def value_forms(spark, sf):
    k = F.col("conv_id") % 4
    loose = F.when(k == 1, "  ").when(k == 2, "NaN").when(k == 3, " 1,234.5 ")
    mixed = F.when(loose.isNotNull(), F.concat(loose, F.lit("  A  b ")))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", V.has_value(loose).alias("has_value"), V.number(loose).alias("number"),
        F.when(mixed.isNotNull(), V.normal_text(mixed)).alias("normal"),
        V.estimate_chat_tokens(F.col("role"), F.col("text"), F.col("turn") % 2).alias("tokens"),
    )


@query(
    """WITH b AS (SELECT conv_id AS paper_name, turn, text, lower(text) AS low, conv_id % 2 = 0 AS named FROM conversations),
    h AS (SELECT *, row_number() OVER (PARTITION BY paper_name ORDER BY turn) AS r FROM b
      WHERE regexp_matches(low, 'abstract|results|discussion|kinetic|characteri[sz]ation|table|conclusion') OR regexp_matches(low, '\\d+(?:\\.\\d+)?\\s*(?:μm|nm|s-1|min-1|°c)')
        OR (named AND contains(low, 'the')))
    SELECT paper_name, substr(string_agg(CASE WHEN turn % 2 = 1 THEN substr(text, 1, 40) ELSE text END, chr(10) || chr(10) ORDER BY r), 1, 300) AS context FROM h WHERE r <= 3 GROUP BY paper_name"""
)
def global_context(spark, sf):
    c = table(spark, sf, "conversations")
    papers = c.select(F.col("conv_id").alias("paper_name")).distinct()
    papers = papers.withColumn("words", F.when(F.col("paper_name") % 2 == 0, F.array(F.lit("THE"), F.lit(""))).otherwise(F.array(F.lit(""))))
    b = c.select(
        F.col("conv_id").alias("paper_name"), F.col("turn").alias("block_id"), F.when(F.col("turn") % 2 == 1, "table").otherwise("text").alias("type"), "text"
    )
    return blocks.global_context(papers, b, most_blocks=3, table_chars=40, most=300)


@query(
    """WITH b AS (SELECT conv_id AS paper_name, string_agg(CASE WHEN turn % 3 = 1 THEN '[TABLE]' || chr(10) || text ELSE text END, chr(10) || chr(10) ORDER BY turn) FILTER (turn % 3 < 2) AS t FROM conversations GROUP BY conv_id),
    f AS (SELECT paper_name, CASE paper_name % 2 WHEN 0 THEN 'own text' ELSE coalesce(t, '') END AS text FROM b)
    SELECT paper_name, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || chr(10) || chr(10) || '[... text cut ...]' ELSE text END AS text FROM f"""
)
def original_texts(spark, sf):
    c = table(spark, sf, "conversations")
    papers = c.select(F.col("conv_id").alias("paper_name")).distinct()
    papers = papers.withColumn("text", F.when(F.col("paper_name") % 2 == 0, "own text\nReferences\nA. B."))
    kind = F.when(F.col("turn") % 3 == 0, "text").when(F.col("turn") % 3 == 1, "table").otherwise("image")
    b = c.select(F.col("conv_id").alias("paper_name"), F.col("turn").alias("block_id"), kind.alias("type"), F.lit(None).cast("string").alias("content"), "text")
    return blocks.original_text(papers, b, 200)


# ---------------------------------------------------------------- names


@query(
    with_records(
        """SELECT paper_name, rec_idx, CASE WHEN enzyme_name IS NOT NULL THEN enzyme_name END AS core,
      CASE rec_idx % 4 WHEN 0 THEN 'Bacillus subtilis' WHEN 1 THEN 'Escherichia coli K12' WHEN 2 THEN 'Bacillus' ELSE organism END AS species,
      CASE rec_idx % 3 WHEN 0 THEN 'Aflatoxin B1' WHEN 1 THEN 'T-2 toxin' ELSE substrate END AS compound,
      CASE rec_idx % 5 WHEN 1 THEN 'RefSeq_Protein' WHEN 2 THEN 'EMBL-GenBank-DDBJ_CDS' END AS mapped_by,
      CASE WHEN ec_number IS NOT NULL THEN 'Oxidoreductases' WHEN rec_idx % 2 = 0 THEN 'Lyases' END AS ec_class, mutations IS NOT NULL AS is_mutation,
      CASE WHEN notes IS NOT NULL THEN 'crude' WHEN rec_idx % 7 = 0 THEN 'immobilized' WHEN rec_idx % 7 = 1 THEN 'cell_free' WHEN rec_idx % 7 = 2 THEN 'partially_purified'
        WHEN rec_idx % 7 = 3 THEN 'commercial' ELSE 'free' END AS state,
      CASE WHEN rec_idx % 11 = 0 THEN 'full_sequence' WHEN ec_number IS NOT NULL THEN 'database_id' WHEN enzyme_full_name IS NOT NULL THEN 'gene_name_only' ELSE 'none' END AS availability FROM rec"""
    )
)
def name_forms(spark, sf):
    def pick(k: int, *values):
        out = F.lit(None).cast("string")
        for n, v in reversed(list(enumerate(values))):
            out = F.when(_i() % k == n, v).otherwise(out)
        return out

    tagged = F.concat(pick(4, F.lit("His6-"), F.lit("GFP-6xHis-"), F.lit("mbp-"), F.lit("")), "enzyme_name", pick(3, F.lit("-His"), F.lit(""), F.lit("-FLAG")))
    species = F.coalesce(pick(4, F.lit("B. subtilis"), F.lit(" e coli K12"), F.lit("Bacillus sp.")), "organism")
    compound = F.coalesce(pick(3, F.lit("AFB1 standard"), F.lit(" t2 ")), "substrate")
    accession = pick(5, F.lit("NC_1"), F.lit("WP_000001"), F.lit("ABC12345"), F.lit("P12345"))
    ec = F.coalesce("ec_number", F.when(_i() % 2 == 0, "4.-.-.-").otherwise("4.1"))
    words = pick(7, F.lit("Immobilised on beads"), F.lit("cell-free"), F.lit("Partially purified"), F.lit("from Sigma"))
    return records(spark, sf).select(
        *KEY, V.strip_tags(tagged).alias("core"), V.expand_organism(species).alias("species"), V.compound_name(compound).alias("compound"),
        V.genbank_source(accession).alias("mapped_by"), V.ec_class(ec).alias("ec_class"), V.is_mutation(F.concat("mutations", F.lit("/A1C"))).alias("is_mutation"),
        V.enzyme_state(F.coalesce("notes", words)).alias("state"),
        V.sequence_availability(F.when(_i() % 11 == 0, "MKV"), [F.lit(""), F.col("ec_number")], F.col("enzyme_full_name")).alias("availability"),
    )


_HEADERS = ("Km (μM)", "kcat (s-1)", "kcat/Km", "Vmax/E0", "kcat (nmol/min/mg)", "Km, app", "Enzyme")


@query(
    """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'Km_value' WHEN 1 THEN 'kcat_value' WHEN 2 THEN 'kcat_Km_value' WHEN 3 THEN 'kcat_value' END AS field,
    CASE WHEN page_id % 2 = 0 THEN 7.4::DOUBLE END AS ph, CASE WHEN page_id % 3 = 0 THEN page_id::DOUBLE END AS temperature_value, CASE WHEN page_id % 3 = 0 THEN '°C' END AS temperature_unit FROM pages"""
)
def header_meanings(spark, sf):
    """Column headers of tables, and conditions from captions."""
    i = F.col("page_id")
    header = F.element_at(F.array(*map(F.lit, _HEADERS)), (i % 7).cast("int") + 1)
    caption = F.concat_ws(" ", F.lit("Constants"), F.when(i % 2 == 0, "at pH 7.4"), F.when(i % 3 == 0, F.concat(F.lit("and "), i.cast("string"), F.lit(" °C"))))
    return table(spark, sf, "pages").select("page_id", V.header_field(header).alias("field"), F.inline(F.array(V.caption_conditions(caption))))


@query(
    with_records(
        """SELECT paper_name, rec_idx, coalesce(ph, CASE WHEN rec_idx % 7 < 3 THEN 6.0::DOUBLE END) AS ph, CASE WHEN rec_idx % 7 < 3 THEN 37.0::DOUBLE END AS temperature_value,
      CASE WHEN rec_idx % 7 < 3 THEN '°C' END AS temperature_unit FROM rec"""
    )
)
def caption_rows(spark, sf):
    rows = records(spark, sf)
    captions = rows.where(_i() % 7 < 3).select("paper_name", "block_id").distinct().withColumn("caption", F.lit("Values at pH of 6 and 37 °C"))
    return R.apply_caption(rows, captions).select(*KEY, "ph", "temperature_value", "temperature_unit")


@query(
    with_records(
        """SELECT paper_name, enzyme_name, arg_max(Km_value, (degradation_efficiency, -Km_value)) AS optimum, max(Km_value) FILTER (degradation_efficiency > 60) AS highest_stable
      FROM rec WHERE Km_value IS NOT NULL AND degradation_efficiency IS NOT NULL GROUP BY paper_name, enzyme_name"""
    )
)
def optimum_of_profile(spark, sf):
    return R.optimum(records(spark, sf), ("paper_name", "enzyme_name"), "Km_value", "degradation_efficiency", 60)


@query(
    with_records(
        """SELECT paper_name, rec_idx, CASE rec_idx % 4 WHEN 0 THEN Km_value / 60 WHEN 1 THEN Km_value WHEN 2 THEN Km_value / 3600 END AS rate,
      CASE rec_idx % 4 WHEN 0 THEN Km_value * 1000 WHEN 1 THEN Km_value * 1000000 WHEN 2 THEN Km_value / 60 END AS efficiency,
      CASE rec_idx % 4 WHEN 0 THEN Km_value / 60 WHEN 1 THEN Km_value / 3600 WHEN 2 THEN Km_value * 24 ELSE Km_value END AS hours FROM rec"""
    )
)
def prompt_units(spark, sf):
    def unit(*names: str):
        return F.element_at(F.array(*map(F.lit, names)), (_i() % 4).cast("int") + 1)

    km = F.col("Km_value")
    rate = V.convert(km, unit("min⁻¹", "S⁻¹", "h-1", "furlong"), V.PROMPT_RATE)
    efficiency = V.convert(km, unit("mM⁻¹s⁻¹", "μM⁻¹s⁻¹", "M-1min-1", "x"), V.EFFICIENCY)
    hours = V.convert(km, unit("min", " Seconds ", "days", "h"), V.TIME)
    return records(spark, sf).select(*KEY, rate["value"].alias("rate"), efficiency["value"].alias("efficiency"), hours["value"].alias("hours"))


# ---------------------------------------------------------------- scores and candidates

_CANDIDATE_SQL = """, c AS (SELECT paper_name, rec_idx, enzyme_name AS e, s AS org, CASE WHEN rec_idx % 3 = 0 THEN 'cotA' END AS gene,
      CASE WHEN rec_idx % 2 = 0 THEN coalesce(enzyme_name, 'x') || ' protein' ELSE 'other name' END AS protein,
      CASE rec_idx % 5 WHEN 0 THEN upper(s) WHEN 1 THEN 'Homo sapiens' WHEN 2 THEN split_part(s, ' ', 1) || ' other' WHEN 3 THEN NULL ELSE split_part(s, ' ', 1) || ' ' || split_part(s, ' ', 2) || ' strain 1' END AS found,
      CASE WHEN rec_idx % 4 = 0 THEN 'COTA' END AS found_gene, rec_idx % 7 < 3 AS reviewed
    FROM (SELECT *, CASE WHEN rec_idx % 6 > 0 THEN 'B. ' || coalesce(organism, 'none') END AS s FROM rec))"""


@query(
    with_records(
        _CANDIDATE_SQL
        + """, p AS (SELECT *, trim(replace(lower(coalesce(org, '')), '.', '')) AS a, trim(replace(lower(coalesce(found, '')), '.', '')) AS b, lower(coalesce(e, '')) AS le FROM c),
    q AS (SELECT *, regexp_split_to_array(a, '\\s+') AS pa, regexp_split_to_array(b, '\\s+') AS pb FROM p)
    SELECT paper_name, rec_idx, round(least(1.0, CASE WHEN gene IS NOT NULL AND found_gene IS NOT NULL THEN 0.5 ELSE 0 END
      + CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 0.3 WHEN len(pa) >= 2 AND len(pb) >= 2 THEN CASE WHEN pa[1] = pb[1] AND pa[2] = pb[2] THEN 0.25 WHEN pa[1] = pb[1] THEN 0.15 ELSE 0 END
        WHEN contains(a, b) OR contains(b, a) THEN 0.15 ELSE 0 END + CASE WHEN reviewed THEN 0.2 ELSE 0 END
      + CASE WHEN contains(lower(protein), le) THEN 0.1 WHEN length(le) > 3 AND contains(' ' || lower(protein) || ' ', ' ' || le || ' ') THEN 0.05 ELSE 0 END)::DOUBLE, 6) AS score FROM q"""
    )
)
def match_scores(spark, sf):
    s = F.when(_i() % 6 > 0, F.concat(F.lit("B. "), F.coalesce("organism", F.lit("none"))))
    word = F.split(s, " ")
    found = (
        F.when(_i() % 5 == 0, F.upper(s)).when(_i() % 5 == 1, "Homo sapiens").when(_i() % 5 == 2, F.concat(word[0], F.lit(" other")))
        .when(_i() % 5 == 4, F.concat(word[0], F.lit(" "), word[1], F.lit(" strain 1")))
    )
    protein = F.when(_i() % 2 == 0, F.concat(F.coalesce("enzyme_name", F.lit("x")), F.lit(" protein"))).otherwise("other name")
    score = enrichment.match_score(F.col("enzyme_name"), s, F.when(_i() % 3 == 0, "cotA"), protein, found, F.when(_i() % 4 == 0, "COTA"), _i() % 7 < 3)
    return records(spark, sf).select(*KEY, F.round(score, 6).alias("score"))


def _detective(spark, sf):
    def text(test, value):
        return F.when(test, value)

    f = F.struct(
        text(_i() % 2 == 0, F.lit("Bacillus")).alias("organism"), text(_i() % 3 == 0, F.lit("strain 168")).alias("reference_strain"), text(_i() % 5 < 3, F.lit("cotA")).alias("gene_name"),
        F.col("ec_number"), (F.col("Km_value") + 40).alias("molecular_weight_kda"), F.when(_i() % 4 == 0, 1500).alias("gene_length_bp"), F.when(_i() % 4 < 2, 510).alias("protein_length_aa"),
    )
    genes = F.when(_i() % 5 == 0, F.array(F.lit("x"), F.lit("COTA"))).when(_i() % 5 == 1, F.array(F.lit("cotA2")))
    c = F.struct(
        (_i() % 2 == 1).alias("reviewed"), F.lit("Bacillus subtilis strain 168").alias("organism"), genes.alias("gene_names"),
        F.array(F.lit("1.10.3.2")).alias("ec_numbers"), F.lit(60000).alias("mass"), F.lit(500).alias("length"),
    )
    return records(spark, sf).select(*KEY, f.alias("f"), c.alias("c"))


_DETECTIVE_SQL = """, p AS (SELECT paper_name, rec_idx, least(1.0, (CASE WHEN rec_idx % 2 = 1 THEN 0.15 ELSE 0.2 END) + CASE WHEN rec_idx % 3 = 0 THEN 0.1 ELSE 0 END
      + CASE rec_idx % 5 WHEN 0 THEN 0.2 WHEN 1 THEN 0.1 ELSE 0 END + CASE WHEN ec_number IS NOT NULL THEN 0.15 ELSE 0 END
      + CASE WHEN abs((Km_value + 40) * 1000 - 60000) / ((Km_value + 40) * 1000) < 0.1 THEN 0.15 WHEN abs((Km_value + 40) * 1000 - 60000) / ((Km_value + 40) * 1000) < 0.2 THEN 0.08 ELSE 0 END
      + CASE WHEN rec_idx % 4 = 0 THEN 0.1 ELSE 0 END + CASE WHEN rec_idx % 4 < 2 THEN 0.15 ELSE 0 END)::DOUBLE AS s, rec_idx % 2 = 0 AS org, rec_idx % 5 = 0 AS gene,
      ec_number IS NOT NULL AS ec, rec_idx % 4 < 2 AS len, rec_idx % 2 = 1 AS reviewed FROM rec)"""


@query(
    with_records(
        _DETECTIVE_SQL
        + """ SELECT paper_name, rec_idx, round(s, 6) AS score, CASE WHEN round(s, 6) >= 0.9 THEN 'High' WHEN round(s, 6) >= 0.7 THEN 'Medium' WHEN round(s, 6) >= 0.5 THEN 'Low' ELSE 'Very Low' END AS band,
      coalesce(nullif(array_to_string([x for x in [CASE WHEN org THEN 'organism Bacillus subtilis strain 168' END, CASE WHEN gene THEN 'gene cotA' END, CASE WHEN ec THEN 'EC 1.10.3.2' END,
        CASE WHEN len THEN 'length 500 aa' END, CASE WHEN reviewed THEN 'reviewed entry' END] if x IS NOT NULL], ', '), ''), 'no fact in common') AS facts FROM p"""
    )
)
def detective_scores(spark, sf):
    d = _detective(spark, sf).withColumn("score", F.round(enrichment.detective_score(F.col("f"), F.col("c")), 6))
    why = enrichment.reasoning(F.col("f"), F.col("c"), F.col("score"))
    return d.select(*KEY, "score", enrichment.confidence_band(F.col("score")).alias("band"), F.regexp_replace(why, r" \(score .*\)$", "").alias("facts"))


@query(
    with_records(
        _DETECTIVE_SQL
        + """, l AS (SELECT paper_name, rec_idx, s, CASE WHEN round(s, 6) >= 0.9 THEN 'High' WHEN round(s, 6) >= 0.7 THEN 'Medium' WHEN round(s, 6) >= 0.5 THEN 'Low' ELSE 'Very Low' END AS band,
      coalesce(nullif(array_to_string([x for x in [CASE WHEN org THEN 'organism Bacillus subtilis strain 168' END, CASE WHEN gene THEN 'gene cotA' END, CASE WHEN ec THEN 'EC 1.10.3.2' END,
        CASE WHEN len THEN 'length 500 aa' END, CASE WHEN reviewed THEN 'reviewed entry' END] if x IS NOT NULL], ', '), ''), 'no fact in common') AS facts FROM p)
    SELECT paper_name, rec_idx, 'search' AS name, md5('search: ' || CASE WHEN rec_idx % 2 = 0 THEN '1 candidate' ELSE '2 candidates' END || chr(10) || '1. P1: ' || facts || ' (score ' || printf('%.2f', round(s, 6)) || ', ' || band || ')'
      || CASE WHEN rec_idx % 2 = 1 THEN chr(10) || '2. P2: ' || facts || ' (score 0.00, Very Low)' ELSE '' END) AS digest FROM l"""
    )
)
def detective_reports(spark, sf):
    d = _detective(spark, sf).withColumn("score", F.round(enrichment.detective_score(F.col("f"), F.col("c")), 6))

    def candidate(name: str, score: Column) -> Column:
        return F.struct(F.lit(name).alias("entry_id"), score.alias("score"), *[F.col(f"c.{x}").alias(x) for x in ("reviewed", "organism", "gene_names", "ec_numbers", "mass", "length")])

    one, two = candidate("P1", F.col("score")), candidate("P2", F.lit(0.0).cast("double"))
    rows = d.select(*KEY, F.lit("search").alias("name"), F.col("f").alias("fingerprint"), F.when(_i() % 2 == 0, F.array(one)).otherwise(F.array(one, two)).alias("candidates"))
    rows = rows.withColumn("name", F.concat_ws("/", "name", *KEY))
    got = enrichment.detective_report(rows)
    key = F.split("name", "/")
    report = F.regexp_replace("report", r"^search/\d+/\d+", "search")
    return got.select(key[1].cast("bigint").alias("paper_name"), key[2].cast("int").alias("rec_idx"), key[0].alias("name"), F.md5(report).alias("digest"))


@query(
    """WITH r AS (SELECT p_brand AS brand, 'E' || (p_partkey % 40) AS entry_id, p_partkey AS position, p_retailprice AS score, 0 AS s FROM part WHERE p_size < 30
      UNION ALL SELECT p_brand, 'E' || (p_partkey % 40), p_partkey, p_retailprice, 1 FROM part WHERE p_size >= 10),
    o AS (SELECT *, row_number() OVER (PARTITION BY brand, entry_id ORDER BY s, position) AS k FROM r),
    t AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC, position) AS rank FROM o WHERE k = 1)
    SELECT brand, entry_id, position, score, rank::INT AS rank FROM t WHERE rank <= 5"""
)
def merged_candidates(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_brand").alias("brand"), F.concat(F.lit("E"), (F.col("p_partkey") % 40).cast("string")).alias("entry_id"), F.col("p_partkey").alias("position"),
        F.col("p_retailprice").alias("score"), "p_size",
    )
    both = enrichment.merge_candidates(p.where("p_size < 30").drop("p_size"), p.where("p_size >= 10").drop("p_size"), ["brand"])
    return enrichment.top_candidates(both, ["brand"], 5)


@query(
    """SELECT 'P' || p_partkey AS entry_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS protein_name, p_type AS organism, p_size % 3 = 0 AS reviewed,
    CASE WHEN p_size % 4 = 0 THEN 'g1,s1,s2,g2' ELSE 'g1' END AS genes, CASE WHEN p_size % 2 = 0 THEN '1.1.1.1' END AS ecs, p_size AS length FROM part"""
)
def parsed_entries(spark, sf):
    size = F.col("p_size")

    def js(text: str):
        return F.lit(text)

    def value(c):
        return F.concat(js('{"value": "'), c, js('"}'))

    names = F.when(size % 2 == 0, F.concat(js('{"recommendedName": {"fullName": '), value(F.col("p_name")), js(', "ecNumbers": [{"value": "1.1.1.1"}]}}')))
    names = names.otherwise(F.concat(js('{"submissionNames": [{"fullName": '), value(F.col("p_brand")), js("}]}")))
    genes = F.when(size % 4 == 0, '[{"geneName": {"value": "g1"}, "synonyms": [{"value": "s1"}, {"value": "s2"}]}, {"geneName": {"value": "g2"}}]').otherwise('[{"geneName": {"value": "g1"}}]')
    kind = F.when(size % 3 == 0, "UniProtKB reviewed (Swiss-Prot)").otherwise("UniProtKB unreviewed (TrEMBL)")
    entry = F.concat(
        js('{"primaryAccession": "P'), F.col("p_partkey").cast("string"), js('", "entryType": "'), kind, js('", "organism": {"scientificName": "'), F.col("p_type"),
        js('"}, "proteinDescription": '), names, js(', "genes": '), genes, js(', "sequence": {"length": '), size.cast("string"), js("}}"),
    )
    got = enrichment.parse_entries(table(spark, sf, "part").select(entry.alias("json")))
    return got.select(
        "entry_id", "protein_name", "organism", "reviewed", F.array_join("gene_names", ",").alias("genes"), F.array_join("ec_numbers", ",").alias("ecs"), "length"
    )


_ENTRIES = [
    # One good hit by name and organism; two by gene; short name as gene; genus only; without tags; one weak hit.
    ("A1", "Brand#11", "g", "Bacillus subtilis", True, 1), ("B1", "x", "cotA", "Bacillus subtilis", False, 2), ("B2", "Brand#12 laccase", "cotA", "Bacillus subtilis", True, 3),
    ("C1", "y", "b-13", "Bacillus subtilis", True, 4), ("C2", "z", "b-13", "Bacillus subtilis", True, 5), ("D1", "Brand#14", None, "Bacillus cereus", True, 6),
    ("D2", "Brand#14", None, "Bacillus cereus", True, 7), ("E1", "Brand#15", None, "Bacillus subtilis", True, 8), ("E2", "Brand#15", None, "Bacillus subtilis", False, 9),
    ("F1", "Brand#21", None, "Bacillus subtilis", False, 10),
]


def _cascade(spark, sf):
    b = F.col("enzyme_name")
    name = F.when(b == "Brand#13", "b-13").when(b == "Brand#15", "His6-Brand#15").otherwise(b)
    rows = records(spark, sf).withColumns(
        {"enzyme_name": name, "gene_name": F.when(b == "Brand#12", "CotA"), "organism": F.lit("B. subtilis"), "genbank_id": F.when(_i() % 10 == 0, "WP_1")}
    )
    entries = spark.createDataFrame(_ENTRIES, "entry_id string, protein_name string, gene_name string, organism string, reviewed boolean, position int")
    return enrichment.enrich(rows, entries, 0.55)


_CASCADE_SQL = """, c AS (SELECT paper_name, rec_idx, CASE WHEN rec_idx % 10 = 0 THEN 'skipped' WHEN enzyme_name IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#14', 'Brand#15') THEN 'filled'
      WHEN enzyme_name = 'Brand#21' THEN 'below_threshold' ELSE 'none' END AS enrichment, enzyme_name AS b, enzyme_full_name AS f FROM rec),
    h AS (SELECT *, CASE WHEN enrichment = 'filled' THEN b END AS hit FROM c)"""


@query(
    with_records(
        _CASCADE_SQL
        + """ SELECT paper_name, rec_idx, enrichment, CASE hit WHEN 'Brand#11' THEN 'A1' WHEN 'Brand#12' THEN 'B2' WHEN 'Brand#13' THEN 'C1' WHEN 'Brand#14' THEN 'D1' WHEN 'Brand#15' THEN 'E1' END AS uniprot_id,
      CASE hit WHEN 'Brand#11' THEN 'Brand#11' WHEN 'Brand#12' THEN 'Brand#12 laccase' WHEN 'Brand#13' THEN 'y' WHEN 'Brand#14' THEN 'Brand#14' WHEN 'Brand#15' THEN 'Brand#15' ELSE f END AS enzyme_full_name,
      CASE hit WHEN 'Brand#11' THEN 'g' WHEN 'Brand#13' THEN 'b-13' ELSE CASE WHEN b = 'Brand#12' THEN 'CotA' END END AS gene_name,
      CASE WHEN hit IN ('Brand#12', 'Brand#13', 'Brand#15') THEN 'Bacillus subtilis' WHEN hit = 'Brand#14' THEN 'Bacillus cereus' ELSE 'B. subtilis' END AS organism,
      CASE WHEN hit = 'Brand#15' THEN 'Brand#15' END AS core_name FROM h"""
    )
)
def enrich_cascade(spark, sf):
    """All strategies, several and single hits, tags, abbreviated organisms."""
    return _cascade(spark, sf).select(*KEY, "enrichment", "uniprot_id", "enzyme_full_name", "gene_name", "organism", "core_name")


@query(
    with_records(
        _CASCADE_SQL
        + """ SELECT count(*) AS total, count(*) FILTER (enrichment = 'skipped') AS skipped, count(*) FILTER (enrichment = 'none') AS none, count(*) FILTER (enrichment = 'filled') AS filled,
      count(*) FILTER (enrichment = 'below_threshold') AS below_threshold, 100.0::DOUBLE * count(*) FILTER (enrichment = 'filled') / count(*) AS coverage FROM h"""
    )
)
def enrichment_stats(spark, sf):
    return enrichment.enrichment_stats(_cascade(spark, sf))


@query(
    with_records(
        _CASCADE_SQL
        + """ SELECT 'state' AS section, enrichment AS name, count(*) AS n FROM h GROUP BY enrichment UNION ALL
    SELECT 'found', CASE WHEN hit = 'Brand#15' THEN 'without tags' ELSE 'by name or gene' END, count(*) FROM h WHERE hit IS NOT NULL GROUP BY 2"""
    )
)
def enrichment_report(spark, sf):
    return enrichment.enrichment_report(_cascade(spark, sf)).where("section <> 'confidence'")


@query(
    with_records(
        """, s AS (SELECT p_type AS name, min(p_partkey) AS k FROM part GROUP BY p_type) SELECT paper_name, rec_idx, 'C' || k AS substrate_smiles,
      CASE WHEN rec_idx % 2 = 0 THEN 'own' WHEN rec_idx % 3 = 0 THEN 'MKV' END AS sequence FROM rec JOIN s ON lower(substrate) = lower(name)"""
    )
)
def looked_up(spark, sf):
    """Structures of substrates and sequences by accession."""
    p = table(spark, sf, "part")
    compounds = p.groupBy(F.upper("p_type").alias("name")).agg(F.concat(F.lit("C"), F.min("p_partkey").cast("string")).alias("smiles"))
    rows = records(spark, sf).withColumns({"uniprot_id": F.when(_i() % 3 == 0, "P1"), "sequence": F.when(_i() % 2 == 0, "own")})
    sequences = spark.createDataFrame([("P1", "MKV"), ("P2", None)], "entry_id string, sequence string")
    return enrichment.with_sequences(enrichment.with_smiles(rows, compounds), sequences).select(*KEY, "substrate_smiles", "sequence")


# ---------------------------------------------------------------- clean-up, reports, answers


@query(
    with_records(
        """SELECT paper_name, rec_idx, CASE rec_idx % 3 WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 25.0::DOUBLE END AS temperature_value, CASE WHEN rec_idx % 2 = 0 THEN 7.5::DOUBLE END AS ph, enzyme_name,
      '9' AS thermal_stability, 'b' || rec_idx AS block_id, CASE WHEN rec_idx % 2 = 0 THEN 'odd' ELSE 'even,odd' END AS dropped FROM rec"""
    )
)
def clean_fields(spark, sf):
    parts = F.concat_ws(
        ", ",
        F.when(_i() % 3 == 0, '"temperature": 30').when(_i() % 3 == 1, '"temperature": 30, "temperature_value": 25').otherwise('"temperature": 30, "temperature_value": null'),
        F.when(_i() % 2 == 0, '"pH": 7.5').otherwise('"even": 1'), F.concat(F.lit('"enzyme_name": '), F.coalesce(F.to_json(F.array("enzyme_name")).substr(F.lit(2), F.length(F.to_json(F.array("enzyme_name"))) - 2), F.lit("null"))),
        F.lit('"thermal_stability": "9", "odd": {"a": 1}'), F.concat(F.lit('"block_id": "b'), _i().cast("string"), F.lit('"')),
    )
    raw = records(spark, sf).select(*KEY, F.parse_json(F.concat(F.lit("{"), parts, F.lit("}"))).alias("record"))
    raw = raw.withColumn("dropped", F.array_join(R.other_keys(raw), ","))
    return R.clean_duplicate_fields(raw).select(*KEY, "temperature_value", "ph", "enzyme_name", "thermal_stability", "block_id", "dropped")


@query(
    with_records(
        """SELECT 'ec' AS "check", count(*) AS total, count(*) FILTER (ec_number IS NOT NULL) AS verified, 0 AS failed, count(*) FILTER (ec_number IS NULL) AS unchecked FROM rec UNION ALL
      SELECT 'doi', count(*), count(*) FILTER (rec_idx % 2 = 0), count(*) FILTER (rec_idx % 2 = 1), 0 FROM rec"""
    )
)
def verification_summary(spark, sf):
    r = records(spark, sf)
    ec = r.select(F.lit("ec").alias("check"), F.when(F.col("ec_number").isNotNull(), True).alias("verified"))
    return reports.verification_summary(ec.unionByName(r.select(F.lit("doi").alias("check"), (_i() % 2 == 0).alias("verified"))))


@query(
    with_records(
        """, p AS (SELECT s_suppkey AS k FROM supplier), b AS (SELECT k % 2 AS batch, count(*) AS papers, count(*) FILTER (k % 5 > 1) AS processed, count(*) FILTER (k % 5 = 0) AS skipped,
      count(*) FILTER (k % 5 = 1) AS failed, avg(k) FILTER (k % 5 > 1) AS s FROM p GROUP BY k % 2)
    SELECT sum(papers)::BIGINT AS papers, sum(processed)::BIGINT AS processed, sum(skipped)::BIGINT AS skipped, sum(failed)::BIGINT AS failed,
      (SELECT count(*) FROM rec)::BIGINT AS records, (SELECT count(*) FILTER (source_type = 'table') FROM rec)::BIGINT AS table_records, (SELECT count(*) FILTER (source_type = 'text') FROM rec)::BIGINT AS text_records,
      (SELECT count(*) FILTER (source_type = 'figure') FROM rec)::BIGINT AS figure_records, round(sum(s * processed) / sum(processed), 6) AS avg_seconds FROM b"""
    )
)
def run_statistics(spark, sf):
    """Two batches, and their sum."""
    k = F.col("s_suppkey")
    state = F.when(k % 5 == 0, "skipped").when(k % 5 == 1, "failed").otherwise("processed")
    papers = table(spark, sf, "supplier").select(k.alias("paper_name"), state.alias("status"), k.cast("double").alias("seconds"))
    r, batches = records(spark, sf), None
    for b in (0, 1):
        one = reports.run_statistics(papers.where(F.col("paper_name") % 2 == b), r.where(F.col("paper_name") % 2 == b))
        batches = one if batches is None else batches.unionByName(one)
    return reports.summed_runs(batches).withColumn("avg_seconds", F.round("avg_seconds", 6))


_ROUTES_SQL = """WITH p AS (SELECT page_id, html, page_id % 5 AS k FROM pages), r AS (SELECT CASE k WHEN 0 THEN 'text:grid_read' WHEN 1 THEN 'skip:no_kinetic_keywords'
    WHEN 2 THEN 'vision:html_incomplete' WHEN 3 THEN 'vision:grid_failed' ELSE CASE WHEN html IS NULL OR length(html) < 100 THEN 'vision:html_incomplete' ELSE 'vision:grid_failed' END END AS route FROM p)"""


@query(_ROUTES_SQL + " SELECT route, count(*) AS n, count(*) / (SELECT count(*) FROM r) AS share FROM r GROUP BY route")
def route_stats(spark, sf):
    """Counts of page_header_route."""
    rows = page_bodies(spark, sf)
    return filters.route_stats(rows.select("page_id", filters.route_table(F.col("body"), grids.grid_ok(F.col("body"))).alias("route")))


@query(
    """SELECT o_custkey AS paper_name, max(o_orderkey) AS batch, arg_max(o_totalprice, o_orderkey) AS total, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey"""
)
def last_batch_wins(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("paper_name"), F.col("o_orderkey").alias("batch"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))
    return reports.last_batch_wins(o)


@query(
    with_records(
        """, d AS (SELECT *, CASE WHEN enzyme_name IS NULL OR (Km_value IS NULL AND kcat_value IS NULL AND degradation_efficiency IS NULL) THEN 'REJECTED'
      WHEN organism IS NOT NULL THEN 'APPROVED' ELSE 'NEEDS_REVIEW' END AS decision FROM rec)
    SELECT paper_name, rec_idx, decision FROM d WHERE decision <> 'APPROVED'"""
    )
)
def human_review(spark, sf):
    return R.needs_human(R.drop_internal(R.review_rules(records(spark, sf)).withColumn("_id", F.lit(1)))).select(*KEY, "decision")


@query(
    with_records(
        """, s AS (SELECT *, 'm' || (rec_idx % 2) AS mm FROM rec) SELECT paper_name, count(*) AS n, count(DISTINCT mm) AS models FROM s WHERE (paper_name % 2 = 0 AND mm = 'm0') OR paper_name % 2 = 1 GROUP BY paper_name"""
    )
)
def first_model_fallback(spark, sf):
    """Aggregated papers as they are; the others from their first model."""
    rows = records(spark, sf).withColumn("model", F.concat(F.lit("m"), (_i() % 2).cast("string")))
    out = answers.first_model_fallback(rows.where(F.col("paper_name") % 2 == 1), rows.where(F.col("paper_name") % 2 == 0))
    return out.groupBy("paper_name").agg(F.count("*").alias("n"), F.count_distinct("model").alias("models"))


@query(
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'synthesis' WHEN 1 THEN 'draft' ELSE NULL END AS stage FROM documents"""
)
def staged_answers(spark, sf):
    """An empty synthesis gives way to the draft; without either there is nothing."""
    k = F.col("doc_id") % 3
    synthesis = F.when(k == 0, '[{"a": "synthesis"}]').when(k == 1, "[]")
    draft = F.when(k < 2, '```json\n[{"a": "draft"},]\n```')
    chosen = X.records_column(answers.staged_answer(synthesis, draft))
    return table(spark, sf, "documents").select("doc_id", F.get_json_object(F.get(chosen, F.lit(0)), "$.a").alias("stage"))


@query(
    with_records("""SELECT paper_name, rec_idx, m AS model FROM rec, (SELECT unnest(['a', 'b', 'c']) AS m) WHERE source_type = 'table'""")
)
def replicated_tables(spark, sf):
    models = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "model string")
    return answers.replicate(records(spark, sf).where("source_type = 'table'").drop("model"), models).select(*KEY, "model")


@query(
    with_records(
        """SELECT paper_name, rec_idx, 'Judge {"substrate":"' || substrate || '"' || CASE WHEN mutations IS NOT NULL THEN ',"mutations":"' || mutations || '"' ELSE '' END || '} for ' || coalesce(enzyme_name, '') AS prompt FROM rec"""
    )
)
def prompts(spark, sf):
    r = records(spark, sf)
    return r.select(*KEY, answers.prompt("Judge {record} for {name}", record=answers.key_fields(("substrate", "mutations")), name=F.col("enzyme_name")).alias("prompt"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) WHEN turn % 4 = 1 THEN 'content' WHEN turn % 4 = 2 THEN 'para' END AS said, CASE WHEN turn % 2 = 0 THEN 'a b' ELSE '' END AS caption FROM conversations"""
)
def block_texts(spark, sf):
    k = F.col("turn") % 4
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(k == 0, F.col("text")).alias("text"), F.when(k == 1, " content\n").alias("content"), F.lit(None).cast("string").alias("body"),
        F.when(k == 2, "\tpara").alias("para"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("words"),
    )
    return rows.select("conv_id", "turn", blocks.block_text().alias("said"), blocks.joined(F.col("words")).alias("caption"))


# ---------------------------------------------------------------- evaluation

_NEAR = " + ".join(
    f"coalesce(CASE WHEN abs(g.{c}) < 1e-12 THEN abs(p.{c} - g.{c}) <= 1e-12 ELSE abs(p.{c} - g.{c}) <= 0.05 * abs(g.{c}) END, false)::INT"
    for c in ("Km_value", "kcat_value", "degradation_efficiency")
)
#: Gold rows take their predictions one after the other: step k gives the k-th gold row of every paper its best one.
ALIGNED_SQL = f"""
, f AS MATERIALIZED (SELECT paper_name, rec_idx, model, lower(coalesce(enzyme_name, '')) AS e, lower(substrate) AS s, lower(coalesce(organism, '')) AS o, enzyme_name, substrate, organism, Km_value, kcat_value, degradation_efficiency FROM rec),
gold AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY paper_name ORDER BY rec_idx) - 1 AS i FROM f WHERE model = 'm0'),
pred AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY paper_name ORDER BY rec_idx) - 1 AS j FROM f WHERE model <> 'm0'),
pts AS (SELECT g.paper_name, i, j, 3 * (g.e = p.e)::INT + 3 * (g.s = p.s)::INT + (g.o = p.o)::INT + {_NEAR} AS n FROM gold g JOIN pred p USING (paper_name)),
opt AS MATERIALIZED (SELECT paper_name, i, list(j ORDER BY n DESC, j) AS js FROM pts WHERE n >= 3 GROUP BY paper_name, i),
papers AS MATERIALIZED (SELECT paper_name, count(*) AS n FROM gold GROUP BY paper_name),
step AS (SELECT paper_name, -1 AS i, -1::BIGINT AS j, bitstring('0', (SELECT max(j) + 1 FROM pred)::INT) AS used FROM papers UNION ALL
  SELECT paper_name, i, coalesce(b, -1), CASE WHEN b IS NULL THEN used ELSE set_bit(used, b::INT, 1) END FROM (
    SELECT step.paper_name, step.i + 1 AS i, list_filter(opt.js, lambda x: get_bit(step.used, x::INT) = 0)[1] AS b, step.used AS used
    FROM step JOIN papers ON step.paper_name = papers.paper_name AND step.i + 1 < papers.n LEFT JOIN opt ON opt.paper_name = step.paper_name AND opt.i = step.i + 1)),
pair AS (SELECT paper_name, i, j FROM step WHERE i >= 0)"""


@query(with_records(ALIGNED_SQL + " SELECT '10.1000/' || paper_name AS doi, i::INT AS gold, j::INT AS prediction FROM pair").replace("WITH", "WITH RECURSIVE", 1))
def gold_alignment(spark, sf):
    return evaluation.align(*_split(spark, sf)).where("gold IS NOT NULL").select("doi", "gold", "prediction")


def _metric_sql() -> str:
    parts = []
    for f in evaluation.FIELDS:
        if f == "kcat_Km_value":
            parts.append(f"SELECT '{f}' AS field, false AS g, false AS p, true AS same FROM b")
        elif f in evaluation.TEXTS:
            parts.append(f"SELECT '{f}' AS field, g{f} IS NOT NULL AS g, p{f} IS NOT NULL AS p, lower(g{f}) = lower(p{f}) AS same FROM b")
        else:
            parts.append(f"SELECT '{f}' AS field, g{f} IS NOT NULL AS g, p{f} IS NOT NULL AS p, abs(p{f} - g{f}) <= 0.05 * abs(g{f}) AS same FROM b")
    cols = [f for f in evaluation.FIELDS if f != "kcat_Km_value"]
    both = ", ".join(f"gold.{f} AS g{f}, pred.{f} AS p{f}" for f in cols)
    alone = ", ".join(f"NULL, pred.{f}" for f in cols)
    return f"""{ALIGNED_SQL}, b AS (SELECT {both} FROM pair JOIN gold USING (paper_name, i) LEFT JOIN pred ON pred.paper_name = pair.paper_name AND pred.j = pair.j
    UNION ALL SELECT {alone} FROM pred JOIN papers USING (paper_name) WHERE NOT EXISTS (SELECT 1 FROM pair WHERE pair.paper_name = pred.paper_name AND pair.j = pred.j)),
    t AS ({" UNION ALL ".join(parts)}), c AS (SELECT coalesce(t.field, '(micro)') AS field, count(*) FILTER (g AND p AND same) AS tp, count(*) FILTER (p AND NOT (g AND coalesce(same, false))) AS fp,
      count(*) FILTER (g AND NOT (p AND coalesce(same, false))) AS fn FROM t GROUP BY GROUPING SETS ((t.field), ())),
    r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall FROM c)
    SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::DOUBLE AS f1 FROM r"""


@query(with_records(_metric_sql()).replace("WITH", "WITH RECURSIVE", 1))
def field_prf1(spark, sf):
    return evaluation.field_metrics(evaluation.align(*_split(spark, sf)))


@query()
def ablation_overall(spark, sf):
    """Every configuration against the gold set."""
    predictions, gold = _split(spark, sf)
    configs = merging.configurations(predictions, keep=evaluation.FIELDS).withColumn("doi", F.concat(F.lit("10.1000/"), F.col("paper_name").cast("string")))
    return evaluation.ablation_metrics(configs, gold)[1]


@query()
def reviewed_records(spark, sf):
    """The chain before a review."""
    entries = spark.createDataFrame(_ENTRIES, "entry_id string, protein_name string, gene_name string, organism string, reviewed boolean, position int")
    rules = ChainRules(toxins=SUBSTRATES, others=OTHER_SUBSTRATES)
    return review_process(records(spark, sf), rules, entries).select(*KEY, *[c for c in RECORD_DDL if c != "products"], "enrichment", "match_score")


@query(
    with_records(
        """, w AS (SELECT *, CASE WHEN rec_idx % 4 = 0 THEN 'Unknown' ELSE organism END AS org FROM scored),
    f AS (SELECT paper_name, rec_idx, enzyme_name, org, enzyme_type, first_value(CASE WHEN org <> 'Unknown' THEN org END IGNORE NULLS) OVER e AS b1, first_value(enzyme_type IGNORE NULLS) OVER e AS b2 FROM w
      WINDOW e AS (PARTITION BY paper_name, enzyme_name ORDER BY confidence_score DESC, contains(block_id, 'table_block_4') DESC, contains(block_id, 'text_block') DESC, rec_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT paper_name, rec_idx, CASE WHEN enzyme_name IS NOT NULL AND (org IS NULL OR org = 'Unknown') THEN coalesce(b1, org) ELSE org END AS organism,
      CASE WHEN enzyme_name IS NULL THEN enzyme_type ELSE coalesce(enzyme_type, b2) END AS enzyme_type FROM f""",
        True,
    )
)
def review_fill(spark, sf):
    """The fill of the review chain: organism too, and 'Unknown' is blank."""
    rows = records(spark, sf).withColumn("confidence_score", R.confidence())
    rows = rows.withColumn("organism", F.when(_i() % 4 == 0, "Unknown").otherwise(F.col("organism")))
    return R.fill_within_paper(rows, ("enzyme_type", "organism"), (), unknown=("Unknown",)).select(*KEY, "organism", "enzyme_type")


# ---------------------------------------------------------------- merging and the chain

_TOLD = ("enzyme_full_name", "enzyme_type", "ec_number", "organism", "Km_value", "Km_unit", "kcat_value", "kcat_unit", "degradation_efficiency", "product", "toxicity_change", "ph", "optimal_ph")
_LED = ("rec_idx", "model", "source_type", "block_id", "doi", "enzyme_name", "substrate", "mutations")


def fold_sql(src: str, by: tuple[str, ...], name: str = "merged") -> str:
    """The greedy merge of src's entities, as recursive SQL: an entity's state is the record that takes in others and
    the list of those left. Step by step the first of them that agrees is taken in, or, if none does, the
    record is done and the next one begins."""
    cols = (*_LED, *_TOLD, "notes", "confidence_score")
    keys = ", ".join((*by, "e_", "s_", "m_"))
    weight = "CASE {}.source_type WHEN 'table' THEN 3 WHEN 'figure' THEN 2 ELSE 1 END".format
    x, y = "now", "rest[i]"
    near = f"""({x}.Km_value IS NULL OR {y}.Km_value IS NULL OR {x}.Km_value = {y}.Km_value
        OR (coalesce({x}.Km_unit = {y}.Km_unit, true) AND abs({x}.Km_value - {y}.Km_value) / ((abs({x}.Km_value) + abs({y}.Km_value)) / 2) <= 0.1))"""
    both = ", ".join(
        [f"{c} := lead.{c}" for c in _LED] + [f"{c} := coalesce(lead.{c}, other.{c})" for c in _TOLD]
        + ["notes := CASE WHEN lead.notes <> other.notes THEN lead.notes || '; ' || other.notes ELSE coalesce(lead.notes, other.notes) END",
           "confidence_score := greatest(coalesce(lead.confidence_score, 0), coalesce(other.confidence_score, 0))"]
    )
    return f"""
{name}_ent AS MATERIALIZED (SELECT {keys}, list(struct_pack({", ".join(f"{c} := {c}" for c in cols)}) ORDER BY rec_idx) AS rows
  FROM (SELECT *, lower(trim(coalesce(enzyme_name, ''))) AS e_, lower(trim(coalesce(substrate, ''))) AS s_, lower(trim(coalesce(mutations, ''))) AS m_ FROM {src}) GROUP BY ALL),
{name}_fold AS (SELECT {keys}, rows[1] AS now, rows[2:] AS rest, CASE WHEN false THEN rows[1] END AS done FROM {name}_ent UNION ALL
  SELECT {keys}, CASE WHEN k IS NULL THEN rest[1] ELSE struct_pack({both}) END, list_filter(rest, lambda x, i: i <> coalesce(k, 1)), CASE WHEN k IS NULL THEN now END
  FROM (SELECT *, CASE WHEN {weight("now")} >= {weight("rest[k]")} THEN now ELSE rest[k] END AS lead, CASE WHEN {weight("now")} >= {weight("rest[k]")} THEN rest[k] ELSE now END AS other
    FROM (SELECT *, list_filter(range(1, len(rest) + 1), lambda i: {near})[1] AS k FROM {name}_fold WHERE now IS NOT NULL))),
{name} AS (SELECT {", ".join(by)}, unnest(done) FROM {name}_fold WHERE done IS NOT NULL)"""


_SHOWN = (*_LED, *[c for c in _TOLD if c not in ("product", "toxicity_change")], "notes", "confidence_score")


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query(recursive(with_records(f", {fold_sql('scored', ('paper_name',))} SELECT paper_name, {', '.join(_SHOWN)} FROM merged", True)))
def merge_records(spark, sf):
    scored = records(spark, sf).withColumn("confidence_score", R.confidence())
    return merging.merge_records(scored).select("paper_name", *_SHOWN)


_VOTES_SQL = """votes AS (SELECT paper_name FROM rec GROUP BY paper_name, lower(coalesce(enzyme_name, '')) || '|' || lower(substrate) || '|' || lower(coalesce(mutations, '')) HAVING count(DISTINCT model) >= 2)"""


@query(
    recursive(
        with_records(
            f""", runs AS (SELECT *, NULL::INT AS confidence_score, model || '_only' AS config FROM rec UNION ALL SELECT *, NULL, 'students_union' FROM rec), {fold_sql("runs", ("paper_name", "config"))},
    {_VOTES_SQL} SELECT config, count(*) AS n FROM merged GROUP BY config UNION ALL SELECT 'majority_vote', count(*) FROM votes"""
        )
    )
)
def ablation_configs(spark, sf):
    c = merging.configurations(records(spark, sf))
    return c.groupBy("config").agg(F.count("*").alias("n"))


_CHAIN_SQL = """, ok AS (SELECT * FROM scored WHERE confidence_score > 1 AND NOT contains(lower(coalesce(notes, '')), 'crude extract') AND NOT contains(lower(substrate), 'medium')),
    w AS (SELECT *, coalesce(organism, 'None') || '|' || coalesce(mutations, '') AS variant FROM ok),
    f AS (SELECT *, first_value(enzyme_full_name IGNORE NULLS) OVER e AS b1, first_value(enzyme_type IGNORE NULLS) OVER e AS b2, first_value(ec_number IGNORE NULLS) OVER e AS b3, first_value(optimal_ph IGNORE NULLS) OVER v AS b4 FROM w
      WINDOW e AS (PARTITION BY paper_name, enzyme_name ORDER BY confidence_score DESC, contains(block_id, 'table_block_4') DESC, contains(block_id, 'text_block') DESC, rec_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
      v AS (PARTITION BY paper_name, enzyme_name, variant ORDER BY confidence_score DESC, rec_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    g AS (SELECT * EXCLUDE (enzyme_full_name, enzyme_type, ec_number, optimal_ph), coalesce(enzyme_full_name, b1) AS enzyme_full_name, coalesce(enzyme_type, b2) AS enzyme_type, coalesce(ec_number, b3) AS ec_number,
      coalesce(optimal_ph, b4) AS optimal_ph FROM f), """


@query(
    recursive(
        with_records(
            _CHAIN_SQL
            + fold_sql("g", ("paper_name",))
            + f""" SELECT paper_name, {", ".join(c for c in _SHOWN if c != "confidence_score")}, {SCORE_SQL} AS confidence_score FROM merged
    WHERE contains(lower(substrate), 'economy') OR contains(lower(substrate), 'standard') OR contains(lower(substrate), 'promo')""",
            True,
        )
    )
)
def final_records(spark, sf):
    """The whole chain."""
    rules = ChainRules(toxins=SUBSTRATES, others=OTHER_SUBSTRATES, known=SUBSTRATES)
    return post_process(records(spark, sf), rules).select("paper_name", *_SHOWN)


# ---------------------------------------------------------------- tables


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '| Enzyme | Km |' || chr(10) || '|---|---|' || chr(10) || '| e' || page_id || ' | 1.5 |' || chr(10) || '| e' || page_id || ' | 2 & 3 |'
      WHEN 1 THEN '| a | a | b |' || chr(10) || '|---|---|---|' || chr(10) || '| ' || page_id || ' |  |  |' WHEN 2 THEN '[unparsed] no table' END AS markdown,
    CASE page_id % 4 WHEN 0 THEN 'Enzyme,Km;e' || page_id || ',1.5;e' || page_id || ',2 & 3' WHEN 1 THEN 'a,a,b;' || page_id ELSE '' END AS cells, page_id % 4 = 0 AS readable FROM pages"""
)
def page_grids(spark, sf):
    """Spanning cells, missing cells, no table, and no text."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    spanning = F.concat(F.lit("<table><tr><th> Enzyme</th><th>Km</th></tr><tr><td rowspan='2'>e"), i, F.lit("</td><td>1.5</td></tr><tr><td>2 &amp;\n3</td></tr></table><table><tr><td>x</td></tr></table>"))
    missing = F.concat(F.lit("<tr><th colspan=2>a</th><th>b</th></tr><tr><td>"), i, F.lit("</td></tr>"))
    body = F.when(k == 0, spanning).when(k == 1, missing).when(k == 2, "no table")
    cells = F.array_join(F.transform(grids.grid_rows(body), lambda r: F.array_join(r, ",")), ";")
    return table(spark, sf, "pages").select("page_id", grids.grid_markdown(body).alias("markdown"), cells.alias("cells"), grids.grid_ok(body).alias("readable"))
