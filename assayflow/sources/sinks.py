"""Writing results: per paper, flat, relational, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FIELDS


def write_papers(records: DataFrame, path: str) -> None:
    """A folder of JSON lines for each paper (O-K1)."""
    records.repartition("paper_name").write.mode("overwrite").partitionBy("paper_name").json(path)


def paper_json(records: DataFrame) -> DataFrame:
    """paper_name and its records, in order, as one JSON list (O-K2)."""
    cols = [c for c in FIELDS if c in records.columns]
    item = F.struct(F.col("rec_idx").alias("__i"), F.struct(*cols).alias("r"))
    return records.groupBy("paper_name").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"])).alias("records")
    )


def write_final(records: DataFrame, path: str) -> None:
    paper_json(records).write.mode("overwrite").json(path)


def flat(records: DataFrame) -> DataFrame:
    """The flat table's columns, in order (O-K3). Identifiers stay empty there; a concentration is split
    at its first space if a number comes before it."""
    none = F.lit(None).cast("string")
    parts = F.split(F.trim("substrate_concentration"), r"\s+", 2)
    value = F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("double"))
    products = F.when(F.size("products") > 0, F.to_json("products"))

    def source(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("unknown")) if name in records.columns else F.lit("unknown")

    c = F.col
    return records.select(
        c("enzyme_name"), c("ec_number").alias("enzyme_ec_number"), c("organism").alias("source_organism_name"),
        c("strain").alias("source_organism_strain"), c("is_recombinant"), c("is_wild_type"), none.alias("preparation_level"),
        none.alias("uniprot_id"), none.alias("pdb_id"), none.alias("ncbi_protein_id"), c("mutations"),
        c("substrate").alias("substrate_name"), value.alias("substrate_initial_concentration_value"),
        F.when(value.isNotNull(), F.get(parts, F.lit(1))).alias("substrate_initial_concentration_unit"), none.alias("substrate_matrix"),
        c("Km_value").alias("km_value"), c("Km_unit").alias("km_unit"), c("Vmax_value").alias("vmax_value"), c("Vmax_unit").alias("vmax_unit"),
        c("kcat_value"), c("kcat_unit"), c("kcat_Km_value").alias("kcat_km_value"), c("kcat_Km_unit").alias("kcat_km_unit"),
        c("degradation_efficiency"), c("reaction_time_value"), c("reaction_time_unit"), none.alias("detection_method"),
        c("temperature_value"), c("temperature_unit"), c("ph").alias("ph_value"), none.alias("buffer_system"),
        none.alias("enzyme_concentration_value"), none.alias("enzyme_concentration_unit"), none.alias("cofactors"),
        products.alias("reaction_products"), c("optimal_ph"), c("optimal_temperature_value"), c("optimal_temperature_unit"), c("notes"),
        source("doi").alias("doi"), source("source_type").alias("source_type"),
    )


def write_csv(records: DataFrame, path: str) -> None:
    """An empty table still writes its header."""
    flat(records).write.mode("overwrite").option("header", "true").csv(path)


def write_report(report: DataFrame, path: str, kind: str = "json") -> None:
    """A small report (O-K4 to O-K8)."""
    out = report.coalesce(1).write.mode("overwrite")
    out.option("header", "true").csv(path) if kind == "csv" else out.json(path)


def write_ablation(configurations: DataFrame, gold: DataFrame, usage: DataFrame, path: str) -> None:
    """The files of an ablation (O-K7, O-K8): predictions (a JSON list for each paper and configuration), scores
    by field and overall (best F1 first), usage records and tokens by task."""
    from ..operators.evaluation import ablation_metrics
    from ..operators.reports import tokens_by_task

    cols = [c for c in FIELDS if c in configurations.columns]
    item = F.struct(F.col("rec_idx").alias("__i"), F.struct(*cols).alias("r"))
    each = configurations.groupBy("paper_name", "doi", "config").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"])).alias("records"), F.count("*").alias("record_count")
    )
    each.write.mode("overwrite").json(f"{path}/predictions")
    by_field, overall = ablation_metrics(configurations, gold)
    write_report(by_field, f"{path}/metrics_by_field", "csv")
    write_report(overall, f"{path}/metrics_overall", "csv")
    usage.write.mode("overwrite").option("header", "true").csv(f"{path}/usage_records")
    write_report(tokens_by_task(usage), f"{path}/usage_by_task", "csv")


def write_run(records: DataFrame, statistics: DataFrame, failed: DataFrame, path: str) -> None:
    """The final records, the run's statistics and the papers that failed (O-K2). failed: paper_name, error."""
    write_final(records, f"{path}/records")
    write_report(statistics, f"{path}/statistics")
    failed.write.mode("overwrite").json(f"{path}/failed")


def relational(records: DataFrame) -> dict[str, DataFrame]:
    """enzymes, substrates, kinetic_parameters and products with surrogate keys (O-K11). Keys are hashes
    of the natural keys, so no table is numbered in one task; of a substrate's structures the last
    record's wins."""
    key = lambda *c: F.xxhash64(*[F.coalesce(F.col(x), F.lit("")) for x in c])
    rows = records.withColumns({"enzyme_id": key("enzyme_name", "organism"), "substrate_id": key("substrate")})
    order = F.struct("paper_name", "rec_idx")
    # Null and empty text have one key; the name is then empty.
    named = lambda c: F.max(F.coalesce(c, F.lit(""))).alias(c)
    enzymes = rows.groupBy("enzyme_id").agg(
        named("enzyme_name"), named("organism"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("enzyme_full_name", "ec_number", "uniprot_id")],
    )
    substrates = rows.groupBy("substrate_id").agg(
        F.max(F.coalesce("substrate", F.lit(""))).alias("substrate_name"),
        F.max_by("substrate_smiles", F.when(F.col("substrate_smiles").isNotNull(), order)).alias("smiles"),
    )
    values = ["Km_value", "Km_unit", "kcat_value", "kcat_unit", "kcat_Km_value", "kcat_Km_unit", "degradation_efficiency"]
    kinetics = rows.groupBy("enzyme_id", "substrate_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in values], F.count("*").alias("n_records")
    )
    products = rows.select("enzyme_id", "substrate_id", F.explode("products").alias("p")).select(
        "enzyme_id", "substrate_id", F.col("p.name").alias("product_name"), F.col("p.toxicity_change").alias("toxicity_change")
    ).distinct()
    return {"enzymes": enzymes, "substrates": substrates, "kinetic_parameters": kinetics, "products": products}


def optimisation_report(patterns: list[tuple[str, int]], cases: list[dict], missing) -> str:
    """Markdown advice from a small aggregate and at most five cases (O-K6)."""
    advice = {
        "missing_kinetics_only": "Ask for Km, kcat, kcat/Km or degradation in every row.",
        "missing_organism_only": "Ask for the organism and strain from methods.",
        "missing_conditions_only": "Ask for pH and temperature, also from captions.",
        "missing_core_fields": "Ask for enzyme and substrate names before values.",
        "incomplete_data": "Ask for identifiers: EC number, full name, accession.",
    }
    total = sum(n for _, n in patterns) or 1
    lines = ["# Prompt report", "", "## Patterns", *[f"- {p}: {n} ({100 * n / total:.1f}%)" for p, n in sorted(patterns, key=lambda x: -x[1])]]
    lines += ["", "## Advice", *[f"- {advice[p]}" for p, n in patterns if n and p in advice], "", "## Cases"]
    lines += [f"- {c.get('paper_name')}: missing {', '.join(missing(c))}" for c in cases[:5]]
    return "\n".join(lines)


def bar_chart(bars: list[tuple[str, float]], title: str, most: float = 1.0, width: int = 640) -> str:
    """A bar chart of a small frame as SVG, largest bar on top (O-K9)."""
    from xml.sax.saxutils import escape

    rows = sorted(bars, key=lambda b: (-b[1], b[0]))
    left, step = 200, 28
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{60 + step * len(rows)}" font-family="sans-serif" font-size="13">']
    out.append(f'<text x="{left}" y="24" font-size="16">{escape(title)}</text>')
    for k, (name, value) in enumerate(rows):
        y = 40 + step * k
        size = round((width - left - 70) * min(max(value, 0.0), most) / most, 1)
        out.append(f'<text x="{left - 8}" y="{y + 15}" text-anchor="end">{escape(name)}</text>')
        out.append(f'<rect x="{left}" y="{y}" width="{size}" height="20" fill="#35618f"/>')
        out.append(f'<text x="{left + size + 6}" y="{y + 15}">{value:.3f}</text>')
    return "\n".join([*out, "</svg>"])
