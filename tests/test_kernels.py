"""Order-dependent operators and literals against plain Python written for the test."""

import json
import random

import pytest
from pyspark.sql import functions as F

from assayflow.functions import text as X
from assayflow.functions import values as V
from assayflow.operators import blocks, enrichment, evaluation, filters, merging, records, reports
from assayflow.schema import FIELDS, RECORD_DDL, normalise
from assayflow.sources import answers, grids, papers, sinks
from assayflow.streaming import usage

RECORD = "paper_name string, rec_idx int, model string, source_type string, block_id string, " + ", ".join(f"{k} {v}" for k, v in RECORD_DDL.items())


def frame(spark, rows):
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    base = {"paper_name": "p", "model": "m0", "source_type": "text", "block_id": "text_block_0"}
    return spark.createDataFrame([tuple((base | {"rec_idx": i} | r).get(n) for n in names) for i, r in enumerate(rows)], RECORD)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


# ---------------------------------------------------------------- literals


def test_tags_and_names(spark):
    for name, want in (("His6-OPH", "OPH"), ("GST-Laccase", "Laccase"), ("GFP-His6-CotA", "CotA"), ("Laccase", "Laccase")):
        assert one(spark, V.strip_tags(F.col("n")), n=name) == want
    for name, want in (("B. subtilis", "Bacillus subtilis"), ("E. coli", "Escherichia coli"), ("Bacillus sp.", "Bacillus")):
        assert one(spark, V.expand_organism(F.col("n")), n=name) == want
    assert one(spark, V.compound_name(F.col("n")), n="AFB1 (pure)") == "Aflatoxin B1"
    assert one(spark, V.ec_class(F.col("n")), n="1.10.3.2") == "Oxidoreductases"
    assert one(spark, V.ec_class(F.col("n")), n="9.1") is None


def test_units(spark):
    for value, unit, table, want in (
        (10.5, "mM", V.CONCENTRATION, (10500.0, "μM")), (0.15, "M", V.CONCENTRATION, (150000.0, "μM")),
        (250.0, "nM", V.CONCENTRATION, (0.25, "μM")), (120.0, "min-1", V.RATE, (2.0, "s^-1")),
        (3.0, "furlong", V.TIME, (None, "furlong")), (2.0, "d", V.TIME, (48.0, "h")),
    ):
        assert tuple(one(spark, V.convert(F.col("v"), F.col("u"), table), v=value, u=unit)) == want


def test_text_functions(spark):
    t = "A $( 0 . 3 3 ~ \\mu \\mathrm { M } )$ b.\n\n\n\nc \nREFERENCES\n1. Smith"
    assert one(spark, X.preprocess(F.col("t")), t=t).startswith("A 0.33 ")
    assert "Smith" not in one(spark, X.preprocess(F.col("t")), t=t)
    assert one(spark, X.cut_introduction(F.col("t")), t="x\nIntroduction\nabc\nMethods\nyes") == "x\nMethods\nyes"
    assert one(spark, X.cut_introduction(F.col("t")), t="x\nIntroduction\nabc") == "x\nIntroduction\nabc"
    assert one(spark, X.cut_paper_references(F.col("t")), t="a\n## References\nb") == "a"
    assert one(spark, X.cut_markdown_references(F.col("t")), t="a\nreferences\nb") == "a"
    assert one(spark, X.cut_references(F.col("t")), t="a\n1. Ab\nx\n1. Ab\n2. Cd\n(3) Ef\n") == "a\n1. Ab\nx"
    assert X.overlap_chunks("A b. C d! E f? tail", 6, 1) == ["A b.", "[CONTEXT]: A b.\n\n C d!", "[CONTEXT]:  C d!\n\n E f?"]
    assert all(len(c) <= 60 for c in X.split_text("\n\n".join(f"word {i}. next {i}" for i in range(40)), 50))


def test_parse_records():
    good = [{"a": 1}, {"a": 2}]
    for answer in (json.dumps(good), "x ```json\n" + json.dumps(good) + "\n``` y", '[{"a": 1},{"a": 2},]', '[{"a": 1} {"a": 2}]', '[{"a": 1}, {"a": 2}, {"a'):
        assert [json.loads(x) for x in X.parse_records(answer)] == good, answer
    assert X.parse_records('{"a": "}"}') == ['{"a": "}"}']
    assert X.parse_records("none") == X.parse_records(None) == X.parse_records("[1, 2]") == []


def test_precheck_vocabulary(spark):
    text = "Aflatoxin B1: km, Km and kcat/km; kcat 3 s^-1"
    row = filters.precheck(spark.createDataFrame([("p", text), ("q", None), ("r", "km kcat")], "k string, text string")).orderBy("k").collect()
    assert (row[0].toxin_hits, row[0].kinetics_hits, row[0].skip) == (1, 6, False)
    assert not row[1].skip and row[2].skip


def test_constraints(spark):
    rows = [
        {"enzyme_name": "Laccase", "substrate": "AFB1", "uniprot_id": "P1"},
        {"enzyme_name": "crude enzyme", "substrate": "AFB1"},
        {"enzyme_name": "x", "substrate": "ABTS", "gene_name": "g", "organism": "o"},
        {"enzyme_name": "x", "substrate": "AFB1", "uniprot_id": "P1", "notes": "bioactivation seen"},
        {"enzyme_name": "x", "substrate": None},
    ]
    got = [r.reject_bucket for r in records.quality_constraints(frame(spark, rows)).orderBy("rec_idx").collect()]
    assert got == ["passed", "no_sequence", "non_mycotoxin", "bioactivation", "non_mycotoxin"]


def test_post_validate(spark):
    rows = [{"Km_value": 5.0}, {"Km_value": 5000.0, "Km_unit": "parsec"}, {"Km_value": 5.0, "Km_unit": "mM"}]
    a, b, c = records.post_validate(frame(spark, rows)).orderBy("rec_idx").collect()
    assert a.Km_value is None and "AUTO-CORRECTED" in a.notes
    assert b.Km_value == 5000.0 and b.ambiguity_flag.startswith("Unusual unit format") and "outside" in b.ambiguity_flag
    assert c.ambiguity_flag is None


# ---------------------------------------------------------------- merging


def slow_merge(rows, tolerance=0.1):
    """Pairs are absorbed one at a time, from the first record on."""
    out, rest = [], [dict(r) for r in rows]
    while rest:
        now = rest.pop(0)
        again = True
        while again:
            again = False
            for i, r in enumerate(rest):
                x, y = now["Km_value"], r["Km_value"]
                near = x is None or y is None or x == y or abs(x - y) / ((x + y) / 2) <= tolerance
                if near and (now["enzyme_name"], now["substrate"]) == (r["enzyme_name"], r["substrate"]):
                    rank = {"table": 3, "figure": 2, "text": 1}
                    lead, other = (now, r) if rank[now["source_type"]] >= rank[r["source_type"]] else (r, now)
                    now = {k: lead[k] if lead[k] is not None else other[k] for k in lead}
                    rest.pop(i)
                    again = True
                    break
        out.append((now["enzyme_name"], now["substrate"], now["Km_value"], now["ph"], now["organism"], now["source_type"]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_merge(spark, seed):
    rng = random.Random(seed)
    rows = [
        {
            "enzyme_name": rng.choice("abc"), "substrate": rng.choice("xy"), "Km_value": rng.choice([None, 1.0, 1.05, 1.2, 5.0]),
            "ph": rng.choice([None, 7.0, 8.0]), "organism": rng.choice([None, "o"]), "source_type": rng.choice(["table", "text", "figure"]),
        }
        for _ in range(60)
    ]
    got = merging.merge_records(frame(spark, rows)).select("enzyme_name", "substrate", "Km_value", "ph", "organism", "source_type")
    assert sorted(map(tuple, got.collect()), key=str) == slow_merge(rows)


def test_merge_across_batches(spark):
    """Entities of one record and of many, in Arrow batches of a few rows."""
    rng = random.Random(5)
    rows = [{"enzyme_name": rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4), "substrate": "s", "Km_value": rng.choice([None, 1.0, 2.0]), "source_type": "text"} for _ in range(200)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = merging.merge_records(frame(spark, rows).coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    blank = {"ph": None, "organism": None}
    assert sorted(((r.enzyme_name, r.substrate, r.Km_value, r.ph, r.organism, r.source_type) for r in got), key=str) == slow_merge([blank | r for r in rows])


def test_merge_mutation_names(spark):
    rows = [
        {"enzyme_name": "E186R", "enzyme_full_name": "CotA-laccase", "substrate": "s", "source_type": "table"},
        {"enzyme_name": "CotA", "mutations": "E186R", "substrate": "S ", "ph": 7.0, "notes": "n"},
    ]
    (r,) = merging.merge_records(frame(spark, rows)).collect()
    assert (r.enzyme_name, r.mutations, r.ph, r.source_type) == ("CotA", "E186R", 7.0, "table")


def test_positional_vote(spark):
    rows = [{"model": m, "rec_idx": 0, "substrate": s, "Km_value": k} for m, s, k in (("a", "x", 1.0), ("b", "y", 1.0), ("c", "y", 0.0))]
    got = {r.field: r for r in merging.positional_votes(frame(spark, rows)).collect()}
    assert (got["substrate"].value, got["substrate"].confidence) == ("y", "medium")
    assert (got["Km_value"].value, got["Km_value"].total, got["Km_value"].confidence) == ("1.0", 2, "high")


# ---------------------------------------------------------------- evaluation


def test_alignment_and_metrics(spark):
    rng = random.Random(8)
    rows = lambda n: [
        {"doi": f"10.1/{rng.randrange(4)}", "rec_idx": i, "enzyme_name": rng.choice(["a", "B", None]), "substrate": rng.choice(["s", "t"]),
         "organism": rng.choice([None, "o"]), "Km_value": rng.choice([None, 1.0, 1.04, 2.0])}
        for i in range(n)
    ]
    preds, gold = rows(30), rows(20)
    ddl = "doi string, rec_idx int, enzyme_name string, substrate string, organism string, Km_value double, kcat_value double, kcat_Km_value double, degradation_efficiency double"
    make = lambda r: spark.createDataFrame([tuple(x.get(c.split(" ")[0]) for c in ddl.split(", ")) for x in r], ddl)
    text = lambda v: (v or "").lower()

    def score(p, g):
        s = 3 * (text(p["enzyme_name"]) == text(g["enzyme_name"])) + 3 * (p["substrate"] == g["substrate"]) + (p["organism"] == g["organism"])
        near = g["Km_value"] is not None and p["Km_value"] is not None and abs(p["Km_value"] - g["Km_value"]) <= 0.05 * g["Km_value"]
        return s + near

    tp = fp = fn = 0
    want = {}
    for doi in {g["doi"] for g in gold}:
        ps, used, pairs = [p for p in preds if p["doi"] == doi], set(), []
        for g in (g for g in gold if g["doi"] == doi):
            best = max(((score(p, g), -i) for i, p in enumerate(ps) if i not in used), default=(0, 0))
            i = -best[1] if best[0] >= 3 else -1
            used.add(i)
            pairs.append(i)
            p = ps[i] if i >= 0 else None
            have_p, have_g = p is not None and p["Km_value"] is not None, g["Km_value"] is not None
            right = have_p and have_g and abs(p["Km_value"] - g["Km_value"]) <= 0.05 * g["Km_value"]
            tp, fp, fn = tp + right, fp + (have_p and not right), fn + (have_g and not right)
        fp += sum(p["Km_value"] is not None for i, p in enumerate(ps) if i not in used)
        want[doi] = pairs
    aligned = evaluation.align(make(preds), make(gold))
    got = {doi: [] for doi in want}
    for r in sorted((r for r in aligned.collect() if r.gold is not None), key=lambda r: r.gold):
        got[r.doi].append(r.prediction)
    assert got == want
    km = next(r for r in evaluation.field_metrics(aligned).collect() if r.field == "Km_value")
    assert (km.tp, km.fp, km.fn) == (tp, fp, fn)


def test_alignment_by_numbers(spark):
    """Without a common name two numbers and the organism, or three numbers, make a pair; zero only fits zero."""
    ddl = "doi string, rec_idx int, enzyme_name string, substrate string, organism string, Km_value double, kcat_value double, kcat_Km_value double, degradation_efficiency double"
    gold = [("d", 0, "a", "s", "o", 10.0, 20.0, None, None), ("d", 1, "b", "t", None, 0.0, 5.0, 7.0, None), ("d", 2, "c", "u", "o", 1.0, None, None, None)]
    preds = [
        ("D ", 0, "x", "y", "o", 10.4, 20.9, None, None), ("d", 1, "x", "y", "z", 0.0, 5.0, 7.3, 1.0), ("d", 2, "x", "y", "o", 1.0, None, None, None),
        ("d", 3, "x", "y", "z", 1e-13, 5.0, 7.0, None), ("e", 0, "a", "s", "o", 1.0, None, None, None), ("", 0, "a", "s", "o", 1.0, None, None, None),
    ]
    got = evaluation.align(spark.createDataFrame(preds, ddl).repartition(3), spark.createDataFrame(gold, ddl))
    assert sorted((r.gold, r.prediction) for r in got.collect() if r.gold is not None) == [(0, 0), (1, 1), (2, -1)]
    assert sorted(r.prediction for r in got.collect() if r.gold is None) == [2, 3]


def test_ablation_metrics(spark):
    gold = frame(spark, [{"enzyme_name": "a", "substrate": "s", "Km_value": 1.0}, {"enzyme_name": "b", "substrate": "t"}]).withColumn("doi", F.lit("10.1/x"))
    runs = [("One", "a", "s", 1.0), ("One", "b", "t", None), ("two", "a", "s", 3.0), ("three", "q", "r", 9.0)]
    rows = [{"rec_idx": i, "model": c, "enzyme_name": e, "substrate": s, "Km_value": k} for i, (c, e, s, k) in enumerate(runs)]
    configs = frame(spark, rows).withColumn("config", F.col("model")).withColumn("doi", F.when(F.col("model") == "three", "10.1/y").otherwise("10.1/X"))
    by_field, each = evaluation.ablation_metrics(configs, gold)
    got = each.collect()
    assert [(r.config, r.tp, r.fp, r.fn, r.predicted_records, r.matched_gold_dois, r.gold_records) for r in got] == [
        ("One", 5, 0, 0, 2, 1, 2), ("two", 2, 1, 3, 1, 1, 2), ("three", 0, 0, 5, 1, 0, 2),
    ]
    assert {(r.config, r.tp) for r in by_field.collect() if r.field == "Km_value"} == {("One", 1), ("two", 0), ("three", 0)}


def test_ablation_metrics_read_once(spark):
    """The configurations are evaluated once for all metrics, not at all before; a configuration without DOIs has its row."""
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rng = random.Random(5)
    row = lambda i: {"rec_idx": i, "enzyme_name": rng.choice(["a", "B ", "", None]), "substrate": rng.choice(["s", "T", None]), "organism": rng.choice(["o", None]),
                     "Km_value": rng.choice([None, 1.0, 1.04, 0.0]), "kcat_value": rng.choice([None, 2.0, 2.2]), "degradation_efficiency": rng.choice([None, 5.0])}
    doi = lambda k: F.concat(F.lit("10.1/"), (F.col("rec_idx") * 7 % k).cast("string"))
    gold = frame(spark, [row(i) for i in range(60)]).withColumn("doi", doi(5))
    configs = frame(spark, [row(i) for i in range(150)]).withColumn("config", F.concat(F.lit("c"), (F.col("rec_idx") % 4).cast("string")))
    configs = configs.withColumn("doi", F.when(F.col("config") != "c3", doi(6)).otherwise(" "))
    by_field, each = evaluation.ablation_metrics(configs.mapInArrow(watch, configs.schema), gold)
    assert seen.value == 0
    got = {r.config: r for r in each.collect()}
    assert seen.value == 150
    assert (got["c3"].predicted_records, got["c3"].matched_gold_dois, got["c3"].tp, got["c3"].fp) == (0, 0, 0, 0)
    assert {r.gold_records for r in got.values()} == {60}
    fields = {(r.config, *r[1:]) for r in by_field.collect()}
    for c in ("c0", "c1", "c2", "c3"):
        own = configs.where(F.col("config") == c)
        assert {r[1:] for r in fields if r[0] == c} == {tuple(r) for r in evaluation.field_metrics(evaluation.align(own, gold)).collect()}


def test_alignment_of_many_dois(monkeypatch):
    """Several DOIs and result sets at once give what the plain loop gives, however the pairs are cut."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = [
        {"doi": f"d{rng.randrange(6)}", "side": rng.randrange(2), "config": None, "enzyme_name_key": rng.choice("ab") * rng.randrange(2), "substrate_key": rng.choice("stuv"),
         "organism_key": rng.choice(["", "o"]), "Km_value": rng.choice([None, 0.0, 1.0, 1.04]), "kcat_value": rng.choice([None, 3.0, float("inf")]), "kcat_Km_value": None,
         "degradation_efficiency": rng.choice([None, 7.0, 7.2])}
        for _ in range(400)
    ]
    for r in rows:
        r["config"] = rng.choice(["x", "y"]) if r["side"] else None
    rows.sort(key=lambda r: (r["doi"], r["side"], r["config"] or ""))

    def points(g, p):
        n = sum(k * (g[f"{c}_key"] == p[f"{c}_key"]) for c, k in (("enzyme_name", 3), ("substrate", 3), ("organism", 1)))
        near = lambda a, b: abs(b - a) <= (1e-12 if abs(a) < 1e-12 else 0.05 * abs(a))
        return n + sum(g[c] is not None and p[c] is not None and near(g[c], p[c]) for c in evaluation.NUMBERS)

    def slow(least):
        used, pairs = set(), set()
        for i, g in enumerate(rows):
            for name in ("x", "y") if not g["side"] else ():
                free = [j for j, p in enumerate(rows) if p["config"] == name and p["doi"] == g["doi"] and j not in used]
                best = max(free, key=lambda j: (points(g, rows[j]), -j), default=None)
                if best is not None and points(g, rows[best]) >= least:
                    used.add(best)
                    pairs.add((i, best))
        return pairs

    ddl = pa.schema([(k, pa.float64() if k in evaluation.NUMBERS else pa.int32() if k == "side" else pa.string()) for k in rows[0]])
    table = pa.Table.from_pylist(rows, ddl)
    for most, size in ((1 << 20, 50_000), (1, 40), (50, 1)):
        monkeypatch.setattr(evaluation, "MOST_PAIRS", most)
        monkeypatch.setattr(evaluation, "CHUNK", size)
        for least in (3.0, 1.0):
            at, got = 0, set()
            for part in evaluation.chunks(iter(table.to_batches(max_chunksize=17))):
                g, p = evaluation.Chunk(part).pairs(least)
                got |= set(zip((g + at).tolist(), (p + at).tolist(), strict=True))
                at += part.num_rows
            assert at == len(rows) and got == slow(least)


# ---------------------------------------------------------------- blocks, sources, sinks, streams


def test_blocks(spark, tmp_path):
    folder = tmp_path / "in" / "paper_a"
    folder.mkdir(parents=True)
    listed = [
        {"type": "text", "text": "Title doi 10.1234/abc.def."}, {"type": "text", "text": ["two", "parts"]}, {"type": "image", "img_path": "i.png"},
        {"type": "text", "text": "Figure 1 shows."}, {"type": "table", "table_caption": ["Table 1", "rates"], "table_body": "<table></table>"},
    ]
    (folder / "a_content_list.json").write_text(json.dumps(listed))
    (folder / "full.md").write_text("whole\ntext")
    (folder / "metadata.json").write_text("{}")
    other = tmp_path / "in" / "paper_b"
    other.mkdir()
    (other / "b_content_list.json").write_text(json.dumps({"content": listed[:1]}))
    root = str(tmp_path / "in")
    b = papers.content_blocks(spark, root)
    assert b.count() == 6 and b.where("block_id = 1 and paper_name = 'paper_a'").first().text == "two parts"
    assert [r.paper_name for r in papers.paper_dirs(spark, root).collect()] == ["paper_a", "paper_b"]
    assert papers.full_texts(spark, root).first().text == "whole\ntext"
    dois = papers.resolve_doi(papers.paper_dirs(spark, root).withColumn("meta_doi", F.lit(None).cast("string")), b).collect()
    assert {r.doi for r in dois} == {"10.1234/abc.def"}
    assert blocks.figure_contexts(b).first().caption == "Figure 1 shows."
    asked = spark.createDataFrame([("paper_a", "Table 1"), ("paper_a", "Table 9")], "paper_name string, table_id string")
    assert {(r.table_id, r.block) for r in blocks.find_table(asked, b).collect()} == {("Table 1", 4), ("Table 9", None)}
    outputs = spark.createDataFrame([("paper_a", "json"), ("paper_a", "csv"), ("paper_b", "json")], "paper_name string, kind string")
    assert [r.paper_name for r in papers.not_done(papers.paper_dirs(spark, root), outputs).collect()] == ["paper_b"]
    seen = []
    q = usage.stream_papers(spark, root, str(tmp_path / "cp"), lambda df, i: seen.extend(r.paper_name for r in df.collect()))
    q.awaitTermination(120)
    assert seen == ["paper_a"]


def test_grids():
    html = "<tr><th>a</th><th>b</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr>"
    assert grids.read_grid(html) == [["a", "b"], ["1", "2"], ["1", "3"]]
    assert grids._ok(html) and not grids._ok("<p>") and not grids._ok(None)
    assert grids._markdown(html).splitlines()[1] == "|---|---|"


def test_sinks(spark, tmp_path):
    rows = frame(spark, [{"enzyme_name": "e", "substrate": "s", "substrate_concentration": "10.5 μM", "products": [("a", None)]}, {"enzyme_name": "f"}])
    assert len(sinks.flat(rows).columns) == 41
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    sinks.write_papers(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert len(json.loads(sinks.paper_json(rows).first().records)) == 2
    assert {k: v.count() for k, v in sinks.relational(rows).items()} == {"enzymes": 2, "substrates": 2, "kinetic_parameters": 2, "products": 1}
    assert normalise(rows).columns[: len(FIELDS)] == list(FIELDS)


def test_answers(spark):
    text = json.dumps([{"enzyme_name": "e"}])
    requests = spark.createDataFrame([("p", "d", "b", "text", "m", "t", "prompt")], "paper_name string, doi string, block_id string, source_type string, model string, task string, prompt string")
    got = answers.ask(requests, lambda r: (text, None), base=0.0)
    rec = answers.answered_records(got).first()
    assert (rec.model, rec.rec_idx, json.loads(rec.record)) == ("m", 0, {"enzyme_name": "e"})
    assert answers.unreadable(got.withColumn("response_text", F.lit("no"))).first().dump is not None
    tries = []

    def limited(r):
        tries.append(r)
        raise RuntimeError("429")

    assert answers.with_retry(limited, tries=2, base=0.0)({}) == (None, None) and len(tries) == 3


def test_clean_duplicate_fields(spark):
    raw = spark.createDataFrame([(1, '{"temperature": 30, "pH": 7, "ph": null, "enzyme_name": "e", "other": 1, "thermal_stability": "9", "source_in_document": {"doi": "d"}}')], "k int, j string")
    raw = raw.select("k", F.parse_json("j").alias("record"))
    r = records.clean_duplicate_fields(raw).first()
    assert (r.temperature_value, r.ph, r.enzyme_name, r.thermal_stability, r.source_in_document, r.block_id) == (30.0, None, "e", "9", '{"doi":"d"}', None)
    assert "other" not in r and raw.select(records.other_keys(raw)).first()[0] == ["other"]


def test_scores(spark):
    s = lambda *a: one(spark, enrichment.match_score(*[F.lit(x) for x in a]), z="z")
    assert s("lac", "B. subtilis", "cotA", "lac protein", "B subtilis", "COTA", True) == pytest.approx(1.0)
    assert s("abcd efgh", "A b", None, "abcd", "A c", None, False) == pytest.approx(0.15 + 0.025)
    assert one(spark, enrichment.confidence_band(F.lit(0.75)), z="z") == "Medium"


def test_streaming_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    batch = usage.usage_windows(events).select(F.sum("n")).first()[0]
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = usage.stream_usage(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), late="0 seconds")
    q.awaitTermination(180)
    closed = spark.read.parquet(str(tmp_path / "out")).select(F.sum("n")).first()[0]
    assert 0.9 * batch <= closed <= batch


def test_tokens(spark):
    rows = [("OpenAI", "m", 1_000_000, 0, "api", False, None), ("ZhipuAIClient", "m", 1_000_000, 500_000, "estimated", True, "t")]
    u = spark.createDataFrame(rows, "provider string, model string, prompt_tokens long, completion_tokens long, source string, is_multimodal boolean, task string")
    got = {(r.level, r.provider): r for r in reports.token_summary(u).collect()}
    assert got["provider", "zhipuaiclient"].cost == pytest.approx(0.8)
    assert got["total", None].request_count == 2
    assert one(spark, V.estimate_tokens(F.col("t")), t="酶ab cd") == 1 + 2


def test_enrich_of_many_alike(spark, sf, monkeypatch):
    """Alike entries count as several candidates, the first of the best is taken, and the query passes all."""
    from assayflow.plans import queries

    rows = [{"enzyme_name": n, "organism": "Bacillus subtilis"} for n in ("CotA", "Lcc1", "OPH")]
    entries = [(f"A{i}", "CotA", None, "Bacillus subtilis", False, i) for i in range(5, 0, -1)]
    entries += [("B1", "CotA", None, "Bacillus subtilis", True, 9), ("B2", "CotA", None, "Bacillus subtilis", True, 8)]
    entries += [("C1", "Lcc1", None, "Bacillus subtilis", False, 2), ("C2", "Lcc1", None, "Bacillus subtilis", False, 1)]
    entries += [("D1", "OPH", None, "Bacillus subtilis", False, 1)]
    table = spark.createDataFrame(entries, "entry_id string, protein_name string, gene_name string, organism string, reviewed boolean, position int")
    got = {r.rec_idx: (r.uniprot_id, r.enrichment) for r in enrichment.enrich(frame(spark, rows), table).collect()}
    assert got == {0: ("B2", "filled"), 1: ("C2", "filled"), 2: (None, "below_threshold")}
    given = []
    monkeypatch.setattr(queries.enrichment, "enrich", lambda rows, entries, **_: given.append(entries) or rows)
    queries.enrich_top1(spark, sf)
    assert given[0].count() == spark.read.parquet(f"{sf}/part.parquet").count()


def test_no_row_caps(spark):
    """Every provider has its price and every model its records, however many there are."""
    models = spark.range(1001).selectExpr("concat('m', id) AS model")
    assert answers.replicate(frame(spark, [{}]), models).count() == 1001
    prices = spark.range(10_001).selectExpr("concat('p', id) AS p", "1.0D AS price_in", "1.0D AS price_out", "'USD' AS currency")
    used = spark.range(10_001).selectExpr(
        "concat('P', id) AS provider", "'m' AS model", "1L AS prompt_tokens", "1L AS completion_tokens", "'api' AS source", "false AS is_multimodal"
    )
    got = reports.token_summary(used, prices).where("level = 'provider'")
    assert got.where("currency = 'USD' AND cost > 0").count() == 10_001
