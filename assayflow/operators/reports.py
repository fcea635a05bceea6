"""Reports: quality, failures, tokens, reviews, runs. Partial aggregates throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..schema import blank, filled
from .records import kinetics

S = "confidence_score"


def quality_report(records: DataFrame) -> DataFrame:
    """total_records, total_papers, good, medium, poor and their percentages (O-G9)."""
    s = F.coalesce(S, F.lit(0))
    n = F.nullif(F.count("*"), F.lit(0))
    tests = {"good": s >= 3, "medium": s == 2, "poor": s < 2}
    return records.agg(
        F.count("*").alias("total_records"), F.count_distinct("paper_name").alias("total_papers"),
        *[F.count_if(t).alias(k) for k, t in tests.items()],
        *[F.coalesce(100.0 * F.count_if(t) / n, F.lit(0.0)).alias(f"{k}_percent") for k, t in tests.items()],
    )


def paper_quality(records: DataFrame) -> DataFrame:
    s = F.coalesce(S, F.lit(0))
    return records.groupBy("paper_name").agg(
        F.count("*").alias("total_records"), F.avg(s).alias("avg_score"), *[F.count_if(s == k).alias(f"score_{k}") for k in (3, 2, 1)]
    )


def missing_fields(records: DataFrame, most: int = 10) -> DataFrame:
    """field, n: the fields that records of a score under 3 lack most (O-G9, O-O1); ties by name."""
    def null(*names: str) -> Column:
        out = F.lit(True)
        for c in names:
            out = out & F.col(c).isNull()
        return out

    tests = {
        "enzyme_name": blank(F.col("enzyme_name")), "substrate": blank(F.col("substrate")),
        "Km_value": null("Km_value"), "kcat_value": null("kcat_value"), "kcat_Km_value": null("kcat_Km_value"),
        "degradation_efficiency": null("degradation_efficiency"),
        "organism_info": blank(F.col("organism")) & blank(F.col("strain")), "ph": null("ph", "optimal_ph"),
        "temperature": null("temperature_value", "optimal_temperature_value"),
        "ec_number": blank(F.col("ec_number")), "enzyme_full_name": blank(F.col("enzyme_full_name")),
    }
    names = F.array_compact(F.array(*[F.when(t, k) for k, t in tests.items()]))
    rows = records.where(F.coalesce(S, F.lit(0)) < 3).select(F.explode(names).alias("field"))
    return rows.groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field").limit(most)


def failure_pattern() -> Column:
    """(O-G10)"""
    has_kinetics = kinetics("degradation_efficiency")
    conditions = F.coalesce("ph", F.col("optimal_ph").try_cast("double"), "temperature_value", "optimal_temperature_value").isNotNull()
    conditions = conditions | F.col("optimal_ph").isNotNull()
    organism = filled(F.col("organism")) | filled(F.col("strain"))
    return (
        F.when(blank(F.col("enzyme_name")) | blank(F.col("substrate")), "missing_core_fields")
        .when(~has_kinetics, "missing_kinetics_only")
        .when(~organism, "missing_organism_only")
        .when(~conditions, "missing_conditions_only")
        .otherwise("incomplete_data")
    )


def failure_patterns(records: DataFrame) -> DataFrame:
    return records.groupBy(failure_pattern().alias("pattern")).agg(F.count("*").alias("n"))


def low_quality_sample(records: DataFrame, most: int = 20, worst: int = 2, seed: int = 0) -> DataFrame:
    """A sample of records of a score up to `worst`; the same for the same seed (O-O2)."""
    key = F.md5(F.concat_ws(":", F.col("paper_name").cast("string"), F.col("rec_idx").cast("string"), F.lit(seed).cast("string")))
    return records.where(F.coalesce(S, F.lit(0)) <= worst).orderBy(key, "paper_name", "rec_idx").limit(most)


# ---------------------------------------------------------------- tokens


def price_table(spark: SparkSession, prices: dict = vocab.PRICES) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in prices.items()], "p string, price_in double, price_out double, currency string")


def token_summary(usage: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Tokens, requests and cost in all, by provider and by provider and model (O-G11): one pass with
    grouping sets; prices (a row a provider) are joined afterwards."""
    rows = usage.withColumn("provider", F.lower("provider"))
    sums = rows.groupingSets([[], [F.col("provider")], [F.col("provider"), F.col("model")]], "provider", "model").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.count("*").alias("request_count"),
        F.count_if(F.col("source") == "estimated").alias("estimated_requests"), F.count_if("is_multimodal").alias("multimodal_requests"),
        F.grouping_id().alias("level"),
    )
    prices = F.broadcast(price_table(usage.sparkSession)) if prices is None else prices
    cost = F.col("prompt_tokens") / 1e6 * F.coalesce("price_in", F.lit(0.0)) + F.col("completion_tokens") / 1e6 * F.coalesce("price_out", F.lit(0.0))
    return sums.join(prices, F.col("provider") == F.col("p"), "left").select(
        F.element_at(F.create_map(F.lit(3), F.lit("total"), F.lit(1), F.lit("provider"), F.lit(0), F.lit("model")), F.col("level").cast("int")).alias("level"),
        "provider", "model", "prompt_tokens", "completion_tokens", "total_tokens", "request_count", "estimated_requests", "multimodal_requests",
        cost.alias("cost"), F.coalesce("currency", F.lit("")).alias("currency"),
    )


def tokens_by_task(usage: DataFrame) -> DataFrame:
    """By task, provider and model, and by task, most tokens first (O-G12)."""
    rows = usage.withColumn("task", F.coalesce("task", F.lit("unspecified")))
    return (
        rows.groupingSets([[F.col("task"), F.col("provider"), F.col("model")], [F.col("task")]], "task", "provider", "model")
        .agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.count("*").alias("request_count"))
        .orderBy(F.desc("total_tokens"), "task", "provider", "model")
    )


# ---------------------------------------------------------------- validation and review


def verdicts(validations: DataFrame, keys: tuple[str, ...] = ("paper_name", "rec_idx")) -> DataFrame:
    """Verdict of each record from its fields' status rows and the length of its context (O-G16, O-J7)."""
    short = F.max(F.coalesce("context_chars", F.lit(0))) < 100
    mismatch, match = F.count_if(F.col("status") == "MISMATCH"), F.count_if(F.col("status") == "MATCH")
    return validations.groupBy(*keys).agg(
        mismatch.alias("mismatch_count"), match.alias("match_count"),
        F.when(short, "UNCERTAIN").when(mismatch > 0, "FAIL").when(match >= 3, "PASS").otherwise("UNCERTAIN").alias("verdict"),
    )


def review_rollup(reviewed: DataFrame, by: tuple[str, ...] = ("paper_name",)) -> DataFrame:
    """Counts of decisions and the paper's own: rejected before needs review before approved; unknown
    decisions need review (O-G17)."""
    d = F.col("decision")
    rejected, approved = F.count_if(d == "REJECTED"), F.count_if(d == "APPROVED")
    review = F.count("*") - rejected - approved
    return reviewed.groupBy(*by).agg(
        rejected.alias("rejected"), approved.alias("approved"), review.alias("needs_review"),
        F.when(rejected > 0, "REJECTED").when(review > 0, "NEEDS_REVIEW").otherwise("APPROVED").alias("overall"),
    )


def verification_summary(checks: DataFrame) -> DataFrame:
    """Verified, failed and unchecked by kind of check (O-G18)."""
    ok = F.col("verified")
    return checks.groupBy("check").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("verified"), F.count_if(~ok).alias("failed"), F.count_if(ok.isNull()).alias("unchecked")
    )


def run_statistics(papers: DataFrame, records: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Papers by outcome, records by source, mean seconds, and with merged records their number and what the
    merge took away (O-G19). papers: status, seconds."""
    p = papers.agg(
        F.count("*").alias("papers"), *[F.count_if(F.col("status") == s).alias(s) for s in ("processed", "skipped", "failed")],
        F.avg(F.when(F.col("status") == "processed", F.col("seconds"))).alias("avg_seconds"),
    )
    r = records.agg(F.count("*").alias("records"), *[F.count_if(F.col("source_type") == s).alias(f"{s}_records") for s in ("table", "text", "figure")])
    out = p.crossJoin(r)
    if merged is None:
        return out
    out = out.crossJoin(merged.agg(F.count("*").alias("merged_records")))
    return out.withColumn("merged_away", F.col("records") - F.col("merged_records"))


def summed_runs(runs: DataFrame) -> DataFrame:
    """Statistics of several batches as one (O-G19): counts add up, mean seconds by papers processed."""
    counts = [c for c in runs.columns if c != "avg_seconds"]
    mean = F.sum(F.col("avg_seconds") * F.col("processed")) / F.nullif(F.sum(F.when(F.col("avg_seconds").isNotNull(), F.col("processed"))), F.lit(0))
    return runs.agg(*[F.sum(c).alias(c) for c in counts], mean.alias("avg_seconds"))


def last_batch_wins(batches: DataFrame, key: str = "paper_name", batch: str = "batch") -> DataFrame:
    """Of each key the row of the last batch (O-U4)."""
    cols = [c for c in batches.columns if c != key]
    return batches.groupBy(key).agg(F.max_by(F.struct(*cols), batch).alias("r")).select(key, "r.*")
