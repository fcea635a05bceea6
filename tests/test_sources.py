"""Sources, sinks and prompts that have no query: files, workbooks, providers, run folders."""

import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F
from test_kernels import frame, one

from assayflow.operators import merging, reports
from assayflow.sources import answers, papers, prompts, sinks


def workbook(path, rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared, cells = [], []
    for r, row in enumerate(rows, 1):
        line = []
        for c, value in enumerate(row):
            at = f"{chr(65 + c)}{r}"
            if value is None:
                continue
            if isinstance(value, str):
                shared.append(value)
                line.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                line.append(f'<c r="{at}"><v>{value}</v></c>')
        cells.append(f'<row r="{r}">{"".join(line)}</row>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{s}</t></r></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")


def test_gold_sheets(spark, tmp_path):
    header = [" Enzyme", "Substrate ", "Km (μM)", "Source DOI"]
    rows = [["CotA", "AFB1", 5.5, "https://doi.org/10.1/X"], ["OPH", None, None, "10.1/x"], ["z", "y", 1, None]]
    workbook(tmp_path / "gold.xlsx", [header, *rows])
    (tmp_path / "gold.csv").write_text("\n".join(",".join("" if x is None else str(x) for x in r) for r in [header, *rows]))
    for name in ("gold.xlsx", "gold.csv"):
        got = papers.gold_rows(spark, str(tmp_path / name)).orderBy("rec_idx").collect()
        assert [(r.rec_idx, r.enzyme_name, r.substrate, r.Km_value, r.doi, r.organism) for r in got] == [
            (0, "CotA", "AFB1", "5.5", "10.1/x", None), (1, "OPH", None, None, "10.1/x", None),
        ]


def test_result_files_and_settings(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a.json").write_text(json.dumps({"p": [{"x": 1}, {"x": 2}], "q": []}))
    got = papers.result_files(spark, str(tmp_path / "out")).collect()
    assert [(r.paper_name, r.rec_idx, json.loads(r.record)) for r in got] == [("p", 0, {"x": 1}), ("p", 1, {"x": 2})]
    (tmp_path / "s.json").write_text('{"models": ["a", "b"], "km_tolerance": 0.2, "other": 1}')
    assert papers.Settings.load(str(tmp_path / "s.json")) == papers.Settings(models=("a", "b"), km_tolerance=0.2)
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "table.v2.txt").write_text("Read {table}\nnow")
    assert [tuple(r) for r in prompts.prompt_files(spark, str(tmp_path / "prompts")).collect()] == [("table.v2", "Read {table}\nnow")]


def test_folders_names_and_images(spark, tmp_path):
    for name in ("b_paper/images/x.JPG", "a_paper/full.md", "a_paper/metadata.json", "loose.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text('{"doi": "10.1/m"}')
    root = str(tmp_path / "in")
    assert [r.paper_name for r in papers.all_dirs(spark, root).collect()] == ["a_paper", "b_paper"]
    assert [r.paper_name for r in papers.all_dirs(spark, root, 1).collect()] == ["a_paper"]
    assert [tuple(r) for r in papers.metadata(spark, root).collect()] == [("a_paper", "10.1/m")]
    assert one(spark, papers.doi_from_name(F.col("n")), n="10.1_a_b") == "10.1/a_b" and one(spark, papers.doi_from_name(F.col("n")), n="paper_1") == "paper_1"
    for size, want in (((1024, 4000), (1024, 4000)), ((2048, 1024), (1024, 512)), ((2000, 4000), (512, 1024))):
        w, h = one(spark, papers.scaled_size(F.lit(size[0]), F.lit(size[1])), z="z")
        assert (w, h) == want
    row = spark.createDataFrame([("", "x/y.png", None, None)], "img_path string, image_path string, table_img string, table_image string")
    assert row.select(papers.image_path(F.lit("/d"))).first()[0] == "/d/images/y.png"


def test_ablation_and_run_files(spark, tmp_path):
    rows = frame(spark, [{"model": m, "enzyme_name": "a", "substrate": "s", "Km_value": 1.0, "rec_idx": i} for i, m in enumerate(("m0", "m1", "m1"))]).withColumn("doi", F.lit("10.1/x"))
    configs = merging.configurations(rows).withColumn("doi", F.lit("10.1/x"))
    usage = spark.createDataFrame([("P", "m", 5, 6, "t")], "provider string, model string, prompt_tokens long, completion_tokens long, task string")
    sinks.write_ablation(configs, rows.where("rec_idx = 0"), usage, str(tmp_path / "ab"))
    overall = spark.read.option("header", "true").csv(str(tmp_path / "ab" / "metrics_overall")).collect()
    assert [float(r.f1) for r in overall] == sorted((float(r.f1) for r in overall), reverse=True) and len(overall) == 4
    predictions = spark.read.json(str(tmp_path / "ab" / "predictions")).collect()
    assert all(len(json.loads(r.records)) == r.record_count for r in predictions)
    assert spark.read.option("header", "true").csv(str(tmp_path / "ab" / "usage_by_task")).count() == 2
    stats = reports.run_statistics(spark.createDataFrame([("p", "processed", 2.0)], "paper_name string, status string, seconds double"), rows, rows.limit(1))
    failed = spark.createDataFrame([("q", "no text")], "paper_name string, error string")
    sinks.write_run(rows, stats, failed, str(tmp_path / "run"))
    got = spark.read.json(str(tmp_path / "run" / "statistics")).first()
    assert (got.papers, got.records, got.merged_records, got.merged_away) == (1, 3, 1, 2)
    assert spark.read.json(str(tmp_path / "run" / "failed")).first().error == "no text"
    svg = sinks.bar_chart([("a<b", 0.25), ("c", 1.5)], "F1 & more")
    assert svg.index("1.500") < svg.index("0.250") and "a&lt;b" in svg and "F1 &amp; more" in svg
    report = sinks.optimisation_report([("missing_core_fields", 3), ("incomplete_data", 1)], [{"paper_name": "p"}], lambda c: ["ph"])
    assert "missing_core_fields: 3 (75.0%)" in report and "p: missing ph" in report


def test_prompts(spark):
    rows = frame(spark, [{"model": m, "enzyme_name": e, "substrate": "s", "Km_value": k} for m, e, k in (("b", "x", 1.0), ("a", "y", None), ("b", "", 2.5))])
    got = prompts.candidates_by_model(rows, 1).first().candidates
    assert got == '## a\n1. {"enzyme_name":"y","substrate":"s"}\n\n## b\n1. {"enzyme_name":"x","substrate":"s","Km_value":1.0}\n... and 1 more'
    text = one(spark, prompts.assembled("table", caption=F.col("c"), footnote=F.lit(None).cast("string"), table=F.lit("T"), context=F.lit("{caption}")), c="C")
    assert "Caption: C\nFootnote: \nTable:\nT" in text
    assert one(spark, prompts.assembled("substrate", {"substrate": "Q {names}"}, names=F.col("n")), n="N") == "Q N"


def test_providers(spark):
    """Payloads and answers of four shapes, over HTTP; a busy server is asked again."""
    seen = []
    replies = {
        "openai": {"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 3}},
        "anthropic": {"content": [{"type": "text", "text": "hi"}], "usage": {"input_tokens": 3}},
        "gemini": {"candidates": [{"content": {"parts": [{"text": "hi"}]}}], "usageMetadata": {"promptTokenCount": 3}},
        "ollama": {"message": {"content": "hi"}, "prompt_eval_count": 3},
    }

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            shape = self.path.strip("/")
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((shape, body, dict(self.headers)))
            busy = len(seen) == 1
            self.send_response(429 if busy else 200)
            self.end_headers()
            self.wfile.write(b"{}" if busy else json.dumps(replies[shape]).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        call = prompts.http_call({s: (prompts.Provider(f"{url}/{s}", s, "k"), "name") for s in replies}, "Be exact.")
        retried = answers.with_retry(call, base=0.0)
        used = {"openai": "prompt_tokens", "anthropic": "input_tokens", "gemini": "prompt_token_count", "ollama": "prompt_tokens"}
        for shape, name in used.items():
            text, usage = retried({"model": shape, "prompt": "ask"})
            assert text == "hi" and json.loads(usage)[name] == 3
    finally:
        server.shutdown()
    assert [s for s, _, _ in seen] == ["openai", "openai", "anthropic", "gemini", "ollama"]
    assert seen[2][1]["system"] == "Be exact." and seen[2][2]["X-Api-Key"] == "k"
    picture = [("image/png", "AAAA")]
    for shape in replies:
        assert "AAAA" in json.dumps(prompts.payload(prompts.Provider(url, shape), "m", "", "look", picture))


def test_tools_and_table_fallback(spark):
    names = "paper_name string, doi string, block_id string, source_type string, model string, task string, prompt string"
    requests = spark.createDataFrame([("p", "d", "b1", "text", "m", "t", "plain"), ("p", None, "b2", "text", "m", "t", "needs"), ("p", "d", "b3", "text", "m", "t", "endless")], names)

    def call(r):
        if r["prompt"] == "plain":
            return "[]", None
        if r["prompt"].startswith("endless") or "Tool result" not in r["prompt"]:
            return '{"tool": "look"}', None
        return r["prompt"].split("\n")[-1], None

    got = answers.ask_with_tools(requests, call, F.concat(F.lit("found "), "block_id"), rounds=2, keep=lambda df, r: df.cache(), base=0.0)
    assert {r.block_id: r.response_text for r in got.collect()} == {"b1": "[]", "b2": "found b2", "b3": None}
    base = got.select("paper_name", "doi", "model", "task", "source_type", "usage", "block_id")
    fused = base.withColumn("response_text", F.when(F.col("block_id") == "b1", '[{"a": 1}]'))
    alone = base.withColumn("response_text", F.lit('[{"a": 2}]'))
    both = answers.table_answers(fused, alone).collect()
    assert {r.block_id: json.loads(r.response_text)[0]["a"] for r in both} == {"b1": 1, "b2": 2, "b3": 2}
