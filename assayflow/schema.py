"""The record schema, and the helpers for missing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and order of the record's fields.
_TEXT = (
    "enzyme_name enzyme_full_name enzyme_type ec_number gene_name uniprot_id genbank_id pdb_id sequence organism strain"
).split()
RECORD_DDL: dict[str, str] = {
    **{c: "string" for c in _TEXT},
    "is_recombinant": "boolean", "is_wild_type": "boolean", "mutations": "string", "substrate": "string",
    "substrate_smiles": "string", "substrate_concentration": "string", "Km_value": "double", "Km_unit": "string",
    "Vmax_value": "double", "Vmax_unit": "string", "kcat_value": "double", "kcat_unit": "string",
    "kcat_Km_value": "double", "kcat_Km_unit": "string", "degradation_efficiency": "double",
    "reaction_time_value": "double", "reaction_time_unit": "string",
    "products": "array<struct<name:string,toxicity_change:string>>", "temperature_value": "double",
    "temperature_unit": "string", "ph": "double", "optimal_ph": "string", "optimal_temperature_value": "double",
    "optimal_temperature_unit": "string", "notes": "string", "confidence_score": "int",
}
FIELDS = tuple(RECORD_DDL)
BLOCK = (
    "type string, text string, content string, body string, para string, table_body string, html string, "
    "markdown_table string, table_caption array<string>, table_footnote array<string>, image_caption array<string>, "
    "img_path string, image_path string, table_img string, table_image string, latex_text string"
)


def blank(c: Column, kind: str = "string") -> Column:
    """Null, empty text or empty list; a number is blank only as null."""
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def filled(c: Column, kind: str = "string") -> Column:
    return ~blank(c, kind)


def known(c: Column, kind: str = "string") -> Column:
    """The value, null if blank."""
    return F.when(filled(c, kind), c)


def count_true(*tests: Column) -> Column:
    """How many of the tests hold."""
    return reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(False)).cast("int") for t in tests])


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def holds_any(text: Column, words) -> Column:
    """Whether a text contains one of the words as a substring."""
    return any_of([text.contains(w) for w in words])


def first_held(text: Column, words) -> Column:
    """The first word of the list that the text contains; null if none."""
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: text.contains(w)), F.lit(0))


def normalise(df: DataFrame) -> DataFrame:
    """All record fields, missing ones as null, in order, then whatever else there is."""
    have = set(df.columns)
    cols = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in RECORD_DDL.items()]
    return df.select(*cols, *[c for c in df.columns if c not in RECORD_DDL])
