"""Operators on records: scoring, constraints, filling, checking. Column expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.values import caption_conditions
from ..schema import RECORD_DDL, any_of, blank, count_true, filled, first_held, holds_any, known

ORDER = ("paper_name", "rec_idx")


# ---------------------------------------------------------------- projections


# Keys besides the schema's that a clean-up keeps, and three old names.
KEPT_KEYS = (
    "thermal_stability", "thermal_stability_unit", "thermal_stability_time", "thermal_stability_time_unit",
    "_aggregation_notes", "_model_comparison", "_confidence", "_source_location", "_id", "_source_file", "_source_model",
    "_source_block_id", "_source_type", "source_in_document", "block_id",
)
OLD_KEYS = {"temperature_value": "temperature", "ph": "pH", "optimal_temperature_value": "optimal_temperature"}


def other_keys(raw: DataFrame, record_col: str = "record") -> Column:
    """Keys of a VARIANT record that a clean-up drops, sorted (O-U3)."""
    keys = F.json_object_keys(F.to_json(F.col(record_col)))
    return F.array_sort(F.array_except(keys, F.array(*map(F.lit, [*RECORD_DDL, *KEPT_KEYS, *OLD_KEYS.values()]))))


def clean_duplicate_fields(raw: DataFrame, record_col: str = "record", keep: tuple[str, ...] = KEPT_KEYS) -> DataFrame:
    """From a VARIANT record, the schema's fields, and `keep` as text columns (a nested value as JSON); three
    old names stand in where the new name is absent (a new name that holds null wins). Other keys go
    (O-P2). A key that the frame has as a column already gives way to it."""
    keep = tuple(k for k in keep if k not in raw.columns)
    old = OLD_KEYS
    keys = F.json_object_keys(F.to_json(F.col(record_col)))
    cols = []
    for name, kind in {**RECORD_DDL, **dict.fromkeys(keep, "string")}.items():
        value = F.try_variant_get(F.col(record_col), f"$.{name}", kind)
        if name in keep:
            value = F.coalesce(value, F.nullif(F.to_json(F.try_variant_get(F.col(record_col), f"$.{name}", "variant")), F.lit("null")))
        if name in old:
            before = F.try_variant_get(F.col(record_col), f"$.{old[name]}", kind)
            value = F.when(~F.array_contains(keys, name), before).otherwise(value)
        cols.append(value.alias(name))
    return raw.select(*[c for c in raw.columns if c != record_col], *cols)


def drop_internal(df: DataFrame, names=("_model_comparison", "_confidence", "_source_location", "_id", "_source_model")) -> DataFrame:
    """Without internal fields (O-P3)."""
    return df.drop(*names)


def provenance(records: DataFrame, n_blocks: Column, prefix: str = "text_block") -> DataFrame:
    """Approximate block of each record: the paper's records dealt evenly, in order, to its blocks
    (O-P5). Adds block_label."""
    paper = Window.partitionBy("paper_name")
    i = F.row_number().over(paper.orderBy("rec_idx")) - 1
    per_block = F.greatest(F.lit(1), F.floor(F.count("*").over(paper) / F.greatest(n_blocks, F.lit(1))))
    at = F.least(F.floor(i / per_block), n_blocks - 1)
    return records.withColumn("block_label", F.concat(F.lit(f"{prefix}_"), at.cast("string")))


# ---------------------------------------------------------------- scores and validation


def kinetics(*extra: str) -> Column:
    return any_of([F.col(c).isNotNull() for c in ("Km_value", "kcat_value", "kcat_Km_value", *extra)])


def confidence() -> Column:
    """Score 1 to 3 of a record (O-G7)."""
    core = filled(F.col("enzyme_name")) & filled(F.col("substrate")) & kinetics("degradation_efficiency")
    ids = any_of([filled(F.col(c)) for c in ("uniprot_id", "genbank_id", "pdb_id", "sequence")])
    bonus = count_true(filled(F.col("ec_number")), filled(F.col("enzyme_full_name")), ids)
    products = F.coalesce(F.size("products") > 0, F.lit(False))
    toxicity = F.coalesce(F.exists("products", lambda p: filled(p["toxicity_change"])), F.lit(False))
    degradation = F.col("degradation_efficiency").isNotNull()
    conditions = any_of(
        [F.col(c).isNotNull() for c in ("ph", "optimal_ph", "temperature_value", "optimal_temperature_value")]
    )
    organism = filled(F.col("organism")) | filled(F.col("strain"))
    important = count_true(kinetics(), degradation, products, toxicity, organism, conditions)
    three = ((important >= 3) | (degradation & products & toxicity)) & (bonus >= 1)
    return F.when(~F.coalesce(core, F.lit(False)), 1).when(three, 3).otherwise(2)


def validated(records: DataFrame) -> DataFrame:
    """Scored; records of score 1 go (O-F14)."""
    return records.withColumn("confidence_score", confidence()).where(F.col("confidence_score") > 1)


def score_summary(records: DataFrame) -> DataFrame:
    """total, mean score, the older five-step bands and histogram (O-G8)."""
    s = F.col("confidence_score")
    return records.agg(
        F.count("*").alias("total"), F.round(F.avg(s), 2).alias("avg_score"), F.count_if(s >= 4).alias("high_quality"),
        F.count_if(s == 3).alias("medium_quality"), F.count_if(s == 2).alias("low_quality"),
        *[F.count_if(s == k).alias(f"score_{k}") for k in range(1, 6)],
    )


def additive_score(records: DataFrame, least: int = 2) -> DataFrame:
    """Adds quality_score, reasons and low_quality (O-F13)."""
    has_kinetics = kinetics("Vmax_value")
    products = F.coalesce(F.size("products") > 0, F.lit(False))
    conditions = any_of([F.col(c).isNotNull() for c in ("ph", "temperature_value", "reaction_time_value")])
    degradation = F.col("degradation_efficiency").isNotNull()
    score = count_true(filled(F.col("enzyme_name")), filled(F.col("enzyme_type")), degradation, products, conditions)
    reasons = F.array_compact(
        F.array(
            F.when(blank(F.col("enzyme_name")), "missing enzyme_name"),
            F.when(blank(F.col("enzyme_type")), "missing enzyme_type"),
            F.when(has_kinetics, "has kinetic parameters"),
            F.when(degradation, "has degradation efficiency"),
            F.when(products, "has products"),
            F.when(conditions, "has experimental conditions"),
        )
    )
    score = score + 2 * has_kinetics.cast("int")
    return records.withColumns({"quality_score": score, "reasons": reasons, "low_quality": score < least})


# ---------------------------------------------------------------- constraints


# The texts of the reasons below; buckets are told from their words.


def low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def sequence_reason(strict: bool = False, crude=vocab.CRUDE_KEYWORDS) -> Column:
    """Why a record fails the sequence check; null if it passes."""
    ids = any_of([filled(F.col(c)) for c in ("uniprot_id", "genbank_id", "pdb_id", "sequence")])
    gene = filled(F.col("gene_name")) & filled(F.col("organism"))
    found = first_held(F.concat_ws(" ", low("enzyme_name"), low("enzyme_full_name"), low("notes")), crude)
    out = F.when(ids | gene, F.lit(None).cast("string")).when(
        found.isNotNull(), F.concat(F.lit("Crude extract/mixture detected: '"), found, F.lit("'"))
    )
    return out.when(F.lit(strict), "No sequence identifier or gene name (strict mode)")


def substrate_reason(strict: bool = False, toxins=vocab.TOXIN_SUBSTRATES, others=vocab.NON_TOXIN_SUBSTRATES) -> Column:
    name = F.trim(low("substrate"))
    return (
        F.when(name == "", "No substrate specified")
        .when(holds_any(name, others), F.concat(F.lit("Non-mycotoxin substrate: '"), name, F.lit("'")))
        .when(holds_any(name, toxins), F.lit(None).cast("string"))
        .when(F.lit(strict), F.concat(F.lit("Unknown substrate '"), name, F.lit("' (strict mode)")))
    )


def detox_reason(strict: bool = False, bad=vocab.BIOACTIVATION_KEYWORDS, good=vocab.DETOX_KEYWORDS) -> Column:
    parts = F.flatten(
        F.transform(
            F.coalesce("products", F.array().cast("array<struct<name:string,toxicity_change:string>>")),
            lambda p: F.array(F.lower(F.coalesce(p["name"], F.lit(""))), F.lower(F.coalesce(p["toxicity_change"], F.lit("")))),
        )
    )
    text = F.concat(F.array_join(parts, " "), F.lit(" "), low("notes"))
    found = first_held(text, bad)
    nothing = blank(F.col("products"), "array") | (F.trim(text) == "")
    return (
        F.when(found.isNotNull(), F.concat(F.lit("Bioactivation detected: '"), found, F.lit("'")))
        .when(holds_any(text, good) | nothing, F.lit(None).cast("string"))
        .when(F.lit(strict), "No clear detoxification evidence (strict mode)")
    )


def quality_constraints(records: DataFrame, strict: bool = False, toxins=vocab.TOXIN_SUBSTRATES, others=vocab.NON_TOXIN_SUBSTRATES) -> DataFrame:
    """Adds reject_reason (null: passes), by the first check that fails, and its bucket (O-F9, O-F10)."""
    reason = F.coalesce(sequence_reason(strict), substrate_reason(strict, toxins, others), detox_reason(strict))
    text = F.lower(F.concat(F.lit("REJECT: "), reason))
    bucket = (
        F.when(reason.isNull(), "passed")
        .when(holds_any(text, ("sequence", "crude", "extract", "commercial", "mixture", "lysate")), "no_sequence")
        .when(holds_any(text, ("mycotoxin", "substrate")), "non_mycotoxin")
        .when(holds_any(text, ("toxic", "activation")), "bioactivation")
        .otherwise("other")
    )
    return records.withColumns({"reject_reason": reason, "reject_bucket": bucket})


def constraint_stats(checked: DataFrame) -> DataFrame:
    b = F.col("reject_bucket")
    names = ("no_sequence", "non_mycotoxin", "bioactivation", "other")
    return checked.agg(
        F.count("*").alias("total"), F.count_if(b == "passed").alias("passed"), F.count_if(b != "passed").alias("rejected"),
        *[F.count_if(b == n).alias(f"rejected_{n}") for n in names],
        F.coalesce(100.0 * F.count_if(b != "passed") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("rejection_rate"),
    )


def known_substrate(names=vocab.KNOWN_SUBSTRATES) -> Column:
    """Whether a known name is part of the substrate or the other way round (O-F11)."""
    s = F.trim(low("substrate"))
    return filled(F.col("substrate")) & any_of([s.contains(n) | F.lit(n).contains(s) for n in names])


def substrate_filter(records: DataFrame, names=vocab.KNOWN_SUBSTRATES, accepted: DataFrame | None = None) -> DataFrame:
    """Records of known substrates; of the others those whose exact name is in accepted (substrate), a
    table of names judged once each. Without it all unknown ones go (O-F12)."""
    known_row = F.coalesce(known_substrate(names), F.lit(False))
    if accepted is None:
        return records.where(known_row)
    judged = accepted.select(F.col("substrate").alias("__judged")).distinct()
    # Rows that are known already ask for no name, so a frequent one isn't shuffled to one task.
    asks = F.when(~known_row, F.col("substrate"))
    return records.join(judged, asks == F.col("__judged"), "left").where(known_row | F.col("__judged").isNotNull()).select(*records.columns)


def unknown_substrates(records: DataFrame, names=vocab.KNOWN_SUBSTRATES) -> DataFrame:
    """Distinct names that a judge has to decide on."""
    return records.where(~F.coalesce(known_substrate(names), F.lit(False)) & filled(F.col("substrate"))).select("substrate").distinct()


# ---------------------------------------------------------------- filling


def fill_within_paper(
    records: DataFrame, basic=("enzyme_full_name", "enzyme_type", "ec_number", "gene_name"),
    conditions=("optimal_ph", "optimal_temperature_value", "optimal_temperature_unit"), unknown: tuple[str, ...] = (),
) -> DataFrame:
    """Blank fields from the paper's other records of the same enzyme name (O-G3): basic fields from
    the best record that has them, optimum fields from the best of the same organism and variant.
    Texts in `unknown` count as blank in basic fields.
    Templates use the values from before. The organism/strain step of the same rule fills nothing,
    as its key is what it fills."""
    score = -F.coalesce("confidence_score", F.lit(0))
    held = lambda part: -F.coalesce(F.col("block_id").contains(part), F.lit(False)).cast("int")
    variant = F.concat(
        F.coalesce("organism", F.lit("None")), F.lit("|"),
        F.when(F.coalesce("is_wild_type", F.lit(False)), "wild_type").otherwise(F.coalesce("mutations", F.lit(""))),
    )
    rows = records.withColumn("__variant", variant)
    out, new = rows, {}
    for n, (fields, keys, order) in enumerate(
        (
            (basic, ("paper_name", "enzyme_name"), F.struct(score.alias("s"), held("table_block_4").alias("t"), held("text_block").alias("x"), "rec_idx")),
            (conditions, ("paper_name", "enzyme_name", "__variant"), F.struct(score.alias("s"), "rec_idx")),
        )
    ):
        best = []
        for f in fields:
            missing = blank(F.col(f), RECORD_DDL[f])
            if unknown and fields is basic and RECORD_DDL[f] == "string":
                missing = missing | F.col(f).isin(*unknown)
            best.append(F.min_by(F.col(f), F.when(~missing, order)).alias(f"__{f}"))
            new[f] = F.when(missing, F.coalesce(f"__{f}", f)).otherwise(F.col(f))
        if best:
            # An aggregate is summed up before its shuffle, and the join can be split at a frequent name.
            found = rows.where(filled(F.col("enzyme_name"))).groupBy(*[F.col(k).alias(f"__k{n}_{k}") for k in keys]).agg(*best)
            out = out.join(found, [F.col(k) == F.col(f"__k{n}_{k}") for k in keys], "left")
    return out.withColumns(new).select(*records.columns)


def fill_conditions(records: DataFrame, conditions: DataFrame, path_order: str = "cond_idx") -> DataFrame:
    """Null optimum fields from condition rows (paper_name, cond_idx, enzyme_name, mutation,
    optimal_ph, optimal_temperature_value) of which one name contains the other and the variant is the
    same; the first row that has the value wins (O-J4). The join is on the paper, the theta test within."""
    c = conditions.select(
        F.col("paper_name").alias("__p"), F.col(path_order).alias("__i"), F.lower(F.coalesce("enzyme_name", F.lit(""))).alias("__e"),
        F.col("mutation").alias("__m"), F.col("optimal_ph").cast("double").cast("string").alias("__ph"),
        F.col("optimal_temperature_value").cast("double").alias("__t"),
    )
    name = low("enzyme_name")
    names = name.contains(F.col("__e")) | F.col("__e").contains(name)
    wild = blank(F.col("__m")) & blank(F.col("mutations"))
    variants = wild | F.coalesce(F.upper("__m") == F.upper("mutations"), F.lit(False))
    keys = records.select("paper_name", "rec_idx", "enzyme_name", "mutations")
    best = (
        keys.join(c, (F.col("paper_name") == F.col("__p")) & names & variants)
        .groupBy("paper_name", "rec_idx")
        .agg(
            F.min(F.when(F.col("__ph").isNotNull(), F.struct("__i", "__ph"))).alias("__bp"),
            F.min(F.when(F.col("__t").isNotNull(), F.struct("__i", "__t"))).alias("__bt"),
        )
    )
    out = records.join(best, ["paper_name", "rec_idx"], "left")
    fills = F.col("optimal_temperature_value").isNull() & F.col("__bt").isNotNull()
    return out.withColumns(
        {
            "optimal_ph": F.coalesce("optimal_ph", "__bp.__ph"),
            "optimal_temperature_unit": F.when(fills, "°C").otherwise(F.col("optimal_temperature_unit")),
            "optimal_temperature_value": F.coalesce("optimal_temperature_value", "__bt.__t"),
        }
    ).select(*records.columns)


def apply_caption(records: DataFrame, captions: DataFrame, keys: tuple[str, ...] = ("paper_name", "block_id")) -> DataFrame:
    """Conditions of a table's caption in those of its rows that state none (O-R7). captions: keys, caption."""
    c = captions.select(*keys, caption_conditions(F.col("caption")).alias("__c"))
    out = records.join(c, list(keys), "left")
    by = {x: F.coalesce(x, f"__c.{x}") for x in ("ph", "temperature_value")}
    unit = F.when(F.col("temperature_value").isNull(), F.col("__c.temperature_unit")).otherwise(F.col("temperature_unit"))
    return out.withColumns({"temperature_unit": unit, **by}).select(*records.columns)


def optimum(measured: DataFrame, keys: tuple[str, ...], value: str = "temperature", activity: str = "activity", kept: float = 0.0) -> DataFrame:
    """keys, optimum (the value of the highest activity, the lowest such) and highest_stable (the highest value
    with more than `kept` activity), from rows of a profile (O-R6)."""
    known_rows = measured.where(F.col(value).isNotNull() & F.col(activity).isNotNull())
    best = F.max(F.struct(F.col(activity).alias("a"), (-F.col(value)).alias("v")))["v"]
    return known_rows.groupBy(*keys).agg((-best).alias("optimum"), F.max(F.when(F.col(activity) > kept, F.col(value))).alias("highest_stable"))


# ---------------------------------------------------------------- checks after merging
# The texts of flags, issues and notes, which are part of the result.


def post_validate(records: DataFrame, units=vocab.ALLOWED_UNITS, ranges=vocab.RANGES, folds=vocab.FOLD_KEYWORDS) -> DataFrame:
    """A value without unit is removed with a note; unusual units, values out of range and fold
    words in names are flagged; flags lower the confidence (O-G22). Adds ambiguity_flag, confidence."""
    have = records.columns
    confidence_in = F.col("confidence") if "confidence" in have else F.lit(None).cast("string")
    flag_in = F.col("ambiguity_flag") if "ambiguity_flag" in have else F.lit(None).cast("string")
    issues, notes, first_flags, new = [], [], [], {}
    for p in ("Km", "kcat", "Vmax", "kcat_Km"):
        v, u = F.col(f"{p}_value"), F.col(f"{p}_unit")
        text = v.cast("string")
        lone = v.isNotNull() & blank(u)
        odd = v.isNotNull() & filled(u) & ~u.isin(*units[p])
        least, most = ranges[p]
        out = v.isNotNull() & ((v < least) | (v > most))
        issues += [
            F.when(lone, F.format_string(f"{p}_value has value (%s) but missing unit - possible fold-change misuse", text)),
            F.when(odd, F.format_string(f"{p}_value=%s has invalid unit '%s'", text, u)),
            F.when(out, F.format_string(f"{p}_value=%s outside typical range ({least:g}-{most:g})", text)),
        ]
        first_flags += [
            F.when(odd, F.format_string(f"Unusual unit format: {p}_unit='%s'", u)),
            F.when(out, F.format_string(f"Unusual value: {p}_value=%s (check if correct)", text)),
        ]
        notes.append(F.when(lone, F.format_string(f" | AUTO-CORRECTED: Removed {p}_value=%s (no unit, likely fold-change)", text)))
        new[f"{p}_value"] = F.when(~lone, v)
        new[f"{p}_unit"] = F.when(~lone, u)
    for f in ("enzyme_name", "enzyme_full_name", "substrate"):
        held = F.col(f).isNotNull() & holds_any(F.lower(F.col(f)), folds)
        issues.append(F.when(held, F.format_string(f"Field '{f}' contains fold-change keywords: '%s'", F.col(f))))
    every = F.array_compact(F.array(*issues))
    note = F.array_join(F.array_compact(F.array(*notes)), "")
    before = F.coalesce(F.nullif(flag_in, F.lit("")), *first_flags)
    after = F.array_join(F.filter(F.array(before, F.array_join(every, "; ")), lambda x: F.coalesce(x, F.lit("")) != ""), "; ")
    return records.withColumns(
        new
        | {
            "notes": F.when(note != "", F.concat(F.coalesce("notes", F.lit("")), note)).otherwise(F.col("notes")),
            "ambiguity_flag": F.when(F.size(every) > 0, after).otherwise(flag_in),
            "confidence": F.when((F.size(every) > 0) & (confidence_in == "high"), "medium").otherwise(confidence_in),
        }
    )


def review_rules(records: DataFrame) -> DataFrame:
    """Adds decision. The policy's plain rules, standing in for a reviewer model (O-F22)."""
    name = low("enzyme_name")
    rejected = F.col("enzyme_name").contains("/") | name.rlike("immobili[sz]ed|@|nanoparticle|beads") | ~kinetics("degradation_efficiency")
    complete = filled(F.col("enzyme_name")) & filled(F.col("substrate")) & filled(F.col("organism"))
    return records.withColumn(
        "decision", F.when(F.coalesce(rejected, F.lit(True)), "REJECTED").when(complete, "APPROVED").otherwise("NEEDS_REVIEW")
    )


def needs_human(reviewed: DataFrame) -> DataFrame:
    """Records that a person has to see (O-F21)."""
    return reviewed.where(F.coalesce(F.col("decision"), F.lit("")) != "APPROVED")
