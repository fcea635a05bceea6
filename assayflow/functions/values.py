"""Value functions over columns: normal forms, matches, units, tokens, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import strip


def normal_text(c: Column) -> Column:
    """Trimmed, lower case, one space between words; empty for null (O-X14)."""
    return F.regexp_replace(F.lower(strip(F.coalesce(c.cast("string"), F.lit("")))), r"(?U)\s+", " ")


def normal_doi(c: Column) -> Column:
    out = normal_text(c)
    for part in ("https://doi.org/", "http://doi.org/", "doi:"):
        out = F.replace(out, F.lit(part), F.lit(""))
    return strip(out)


def number(c: Column) -> Column:
    """A double from text with thousands commas; null if it is none."""
    return F.replace(strip(c.cast("string")), F.lit(","), F.lit("")).try_cast("double")


def has_value(c: Column) -> Column:
    return c.isNotNull() & (strip(c.cast("string")) != "") & (F.lower(c.cast("string")) != "nan")


def numbers_match(found: Column, gold: Column, tolerance: float = 0.05, least: float = 1e-12) -> Column:
    """Within a share of the gold value; both missing match."""
    near = F.when(F.abs(gold) < least, F.abs(found - gold) <= least).otherwise(F.abs(found - gold) / F.abs(gold) <= tolerance)
    return F.when(found.isNull() & gold.isNull(), True).when(found.isNull() | gold.isNull(), False).otherwise(near)



# Target unit, and the spellings of each unit with what to do to a value.
CONCENTRATION = ("μM", (
    (("mm", "millimolar"), "*", 1000), (("m", "molar"), "*", 1000000), (("nm", "nanomolar"), "/", 1000),
    (("μm", "um", "micromolar"), "*", 1),
))
RATE = ("s^-1", (
    (("min^-1", "min-1", "/min"), "/", 60), (("h^-1", "h-1", "/h", "hr^-1"), "/", 3600), (("s^-1", "s-1", "/s"), "*", 1),
))
# What prompts ask for besides, the superscript spellings and the catalytic efficiency.
PROMPT_RATE = ("s^-1", (
    (("min⁻¹", "min^-1", "min-1", "/min"), "/", 60), (("h⁻¹", "h^-1", "h-1", "/h"), "/", 3600),
    (("s⁻¹", "s^-1", "s-1", "/s"), "*", 1),
))
EFFICIENCY = ("M^-1 s^-1", (
    (("mm⁻¹s⁻¹", "mm^-1s^-1", "mm-1s-1", "/mm/s"), "*", 1000), (("μm⁻¹s⁻¹", "um-1s-1", "μm^-1s^-1", "/μm/s"), "*", 1000000),
    (("m⁻¹min⁻¹", "m^-1min^-1", "m-1min-1", "/m/min"), "/", 60), (("mm⁻¹min⁻¹", "mm^-1min^-1", "mm-1min-1", "/mm/min"), "*", 1000 / 60),
    (("m⁻¹s⁻¹", "m^-1s^-1", "m-1s-1", "/m/s"), "*", 1),
))
TIME = ("h", (
    (("min", "mins", "minutes"), "/", 60), (("s", "sec", "seconds"), "/", 3600), (("d", "day", "days"), "*", 24),
    (("h", "hr", "hrs", "hours"), "*", 1),
))


def convert(value: Column, unit: Column, table: tuple) -> Column:
    """struct(value, unit) in the table's target unit. A missing value or unit gives no value in that
    unit; an unknown unit gives no value and stays, trimmed and in lower case (O-X15)."""
    target, kinds = table
    low = F.lower(F.trim(unit))
    missing = value.isNull() | unit.isNull() | (unit == "")
    out, name = F.lit(None).cast("double"), low
    for spellings, how, k in reversed(kinds):
        hit = low.isin(*spellings)
        out = F.when(hit, value * F.lit(float(k)) if how == "*" else value / F.lit(float(k))).otherwise(out)
        name = F.when(hit, F.lit(target)).otherwise(name)
    return F.struct(
        F.when(~missing, out).alias("value"), F.when(missing, F.lit(target)).otherwise(name).alias("unit")
    )


def estimate_tokens(text: Column) -> Column:
    """Ideographs count one, four other characters one; at least one unless empty (O-X16)."""
    cjk = F.regexp_count(text, F.lit("[\\u4e00-\\u9fff]"))
    count = F.greatest(F.lit(1), cjk + F.ceil((F.length(text) - cjk) / 4))
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(count).cast("long")


def estimate_chat_tokens(role: Column, text: Column, images: Column) -> Column:
    """Of one message: its role, its text and 1024 for each image."""
    return estimate_tokens(role) + estimate_tokens(text) + 1024 * images


def usage_tokens(usage: Column) -> Column:
    """struct(prompt, completion) of a usage object (VARIANT) by its three spellings; a total alone
    counts as prompt; null if nothing is there (O-X17)."""

    def pick(*names: str) -> Column:
        return F.coalesce(*[F.try_variant_get(usage, f"$.{n}", "bigint") for n in names], F.lit(0).cast("bigint"))

    prompt = pick("prompt_tokens", "input_tokens", "prompt_token_count")
    answer = pick("completion_tokens", "output_tokens", "candidates_token_count")
    total = pick("total_tokens", "total_token_count")
    p = F.when((prompt == 0) & (answer == 0), total).otherwise(prompt)
    return F.when((p > 0) | (answer > 0), F.struct(p.alias("prompt"), answer.alias("completion")))


def strip_tags(name: Column, patterns=vocab.TAGS, rounds: int = 10) -> Column:
    """Without purification and fusion tags: in each round the first pattern of the list that is found
    goes (O-X18)."""

    def one(acc: Column, _: Column) -> Column:
        out = acc
        for p in reversed(patterns):
            q = f"(?i){p}"
            out = F.when(acc.rlike(q), F.trim(F.trim(F.regexp_replace(acc, q, ""), F.lit("-")))).otherwise(out)
        return out

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), name, one)


def expand_organism(name: Column, genera: dict[str, str] = vocab.GENERA) -> Column:
    """Genus in full; without an unspecified species (O-X19)."""
    clean = F.trim(name)
    clean = F.when(
        clean.rlike(r" sp\.?$"), F.trim(F.replace(F.replace(clean, F.lit(" sp."), F.lit("")), F.lit(" sp"), F.lit("")))
    ).otherwise(clean)
    parts = F.split(clean, r"\s+")
    first = F.lower(F.element_at(parts, 1))
    table = F.create_map(*[F.lit(x) for k, v in genera.items() for x in (f"{k}.", v, k, v)])
    genus = F.try_element_at(table, first)
    return F.when(
        genus.isNotNull(), F.concat_ws(" ", genus, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " "))
    ).otherwise(clean)


def compound_name(name: Column, aliases: dict[str, str] = vocab.COMPOUND_ALIASES) -> Column:
    """The full name of an abbreviated compound, else of its first word, else the name (O-X20)."""
    table = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k, v)])
    low = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.element_at(F.split(low, " "), 1)), name)


def genbank_source(identifier: Column) -> Column:
    """Which database maps an accession (O-X21)."""
    return (
        F.when(identifier.rlike("^(NC_|NZ_)"), F.lit(None).cast("string"))
        .when(identifier.rlike("^(NP_|WP_|YP_)"), "RefSeq_Protein")
        .when(identifier.rlike(r"^[A-Z]{3}\d{5}"), "EMBL-GenBank-DDBJ_CDS")
    )


def ec_class(ec: Column) -> Column:
    """Name of an EC number's main class; null if the number is malformed (O-F20)."""
    names = ("Oxidoreductases", "Transferases", "Hydrolases", "Lyases", "Isomerases", "Ligases", "Translocases")
    main = F.regexp_extract(ec, r"^(\d+)\.(?:\d+|-)\.(?:\d+|-)\.(?:\d+|-)$", 1)
    return F.try_element_at(F.array(*map(F.lit, names)), F.when(main != "", main.cast("int")).otherwise(F.lit(99)))


def is_mutation(name: Column) -> Column:
    """E186R, or several joined by slashes (O-F19)."""
    return F.coalesce(F.trim(name).rlike(r"^[A-Z]\d+[A-Z](/[A-Z]\d+[A-Z])*$"), F.lit(False))


def enzyme_state(text: Column) -> Column:
    """State of a preparation from its words (O-R1)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.rlike("immobili[sz]ed"), "immobilized")
        .when(t.rlike("cell[- ]free"), "cell_free")
        .when(t.rlike("partially purified"), "partially_purified")
        .when(t.rlike("crude|supernatant|lysate"), "crude")
        .when(t.rlike("commercial|sigma|novozyme"), "commercial")
        .otherwise("free")
    )


def sequence_availability(sequence: Column, ids: list[Column], gene: Column) -> Column:
    """(O-R2)"""
    any_id = F.coalesce(*[F.nullif(c, F.lit("")) for c in ids]).isNotNull()
    return (
        F.when(F.coalesce(sequence, F.lit("")) != "", "full_sequence")
        .when(any_id, "database_id")
        .when(F.coalesce(gene, F.lit("")) != "", "gene_name_only")
        .otherwise("none")
    )


# A table header's meaning, and what makes it none of them.
HEADERS = (
    ("kcat_Km_value", r"k\s*_?cat\s*/\s*k\s*_?m|catalytic efficiency|specificity constant"),
    ("kcat_value", r"k\s*_?cat|turnover (?:number|rate)|v_?max\s*/\s*\[?e_?0?\]?"),
    ("Km_value", r"^\s*k\s*_?m\b|michaelis"),
)
HEADER_REJECTS = r"mg\s*(?:-1|⁻¹|\^-1)|/\s*mg|,\s*app|apparent|inhibit|relative"


def header_field(header: Column) -> Column:
    """The record field that a table's column header means (O-R3); null for none: rates by mass, apparent and
    conditional values don't count."""
    low = F.lower(F.coalesce(header, F.lit("")))
    out = F.lit(None).cast("string")
    for field, pattern in reversed(HEADERS):
        out = F.when(low.rlike(pattern), field).otherwise(out)
    return F.when(~low.rlike(HEADER_REJECTS), out)


def caption_conditions(caption: Column) -> Column:
    """struct(ph, temperature_value, temperature_unit) that a table's caption states for all its rows (O-R7)."""
    ph = F.regexp_extract(caption, r"(?i)\bpH\s*(?:=|of|was)?\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    t = F.regexp_extract(caption, r"(-?\d+(?:\.\d+)?)\s*°\s*C", 1).try_cast("double")
    return F.struct(ph.alias("ph"), t.alias("temperature_value"), F.when(t.isNotNull(), "°C").alias("temperature_unit"))
