"""Model answers as a table: recorded ones are replayed, live ones come from an injected caller.

Columns: paper_name, doi, block_id, source_type, model, task, response_text, usage (JSON). All
parsing, voting and accounting starts here, so results repeat (O-S13, O-L1 to O-L9).
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import records_column, tool_call
from ..runtime import ship

RESPONSES = (
    "paper_name string, doi string, block_id string, source_type string, model string, task string, response_text string, usage string"
)


def with_retry(call: Callable[[dict], tuple[str, str]], tries: int = 3, base: float = 2.0, most: float = 30.0):
    """The call, repeated after a rate limit with doubled, jittered waits (O-L10)."""

    def run(request: dict) -> tuple[str | None, str | None]:
        for n in range(tries + 1):
            try:
                return call(request)
            except Exception as e:  # noqa: BLE001  a provider's own errors
                limited = any(x in str(e).lower() for x in ("429", "rate", "too many"))
                if not limited or n == tries:
                    return None, None
                time.sleep(min(most, base * 2**n) * random.uniform(0.5, 1.5))
        return None, None

    return run


def ask(requests: DataFrame, call: Callable[[dict], tuple[str, str]], **retry) -> DataFrame:
    """RESPONSES of live calls; a call that fails for good has null text. requests: RESPONSES without
    its last two columns, and prompt."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = with_retry(call, **retry)
        for frame in frames:
            got = [one(r) for r in frame.to_dict("records")]
            frame["response_text"] = [g[0] for g in got]
            frame["usage"] = [g[1] for g in got]
            yield frame.drop(columns="prompt")

    ship()
    return requests.mapInPandas(run, RESPONSES)


def answered_records(responses: DataFrame, order: str = "response_id") -> DataFrame:
    """paper_name, model, source_type, doi, block_id, rec_idx, record (JSON): the records of all
    answers, numbered within a paper and model by block, then place."""
    rows = responses.select(
        "paper_name", "model", "source_type", "doi", "block_id", F.posexplode(records_column(F.col("response_text"))).alias("place", "record")
    )
    w = Window.partitionBy("paper_name", "model").orderBy("source_type", "block_id", "place", "record")
    return rows.withColumn("rec_idx", F.row_number().over(w) - 1).drop("place")


def unreadable(responses: DataFrame) -> DataFrame:
    """Answers without a record, with a short name of their text (O-K10)."""
    return responses.where(F.size(records_column(F.col("response_text"))) == 0).withColumn(
        "dump", F.substring(F.md5(F.coalesce("response_text", F.lit(""))), 1, 8)
    )


def replicate(records: DataFrame, models: DataFrame) -> DataFrame:
    """Shared table records for every model (O-J10)."""
    return records.drop("model").crossJoin(models.select("model").distinct())


def first_model_fallback(aggregated: DataFrame, students: DataFrame) -> DataFrame:
    """Aggregated records; papers without any get those of their first model (O-L6)."""
    missing = students.join(aggregated.select("paper_name").distinct(), "paper_name", "left_anti")
    first = missing.groupBy("paper_name").agg(F.min("model").alias("model"))
    return aggregated.unionByName(missing.join(first, ["paper_name", "model"], "left_semi").select(*students.columns), allowMissingColumns=True)


def staged_answer(synthesis: Column, draft: Column) -> Column:
    """Extractor, reviewer and synthesiser: an empty synthesis falls back to the draft, an empty draft
    to no records (O-L5)."""
    empty = synthesis.isNull() | (F.size(records_column(synthesis)) == 0)
    return F.when(empty, F.coalesce(draft, F.lit("[]"))).otherwise(synthesis)


def ask_with_tools(requests: DataFrame, call: Callable[[dict], tuple[str, str]], tool: Column, rounds: int = 3, keep: Callable[[DataFrame, int], DataFrame] = lambda df, r: df, **retry) -> DataFrame:
    """RESPONSES of a model that may ask for tools (O-L6). tool: the result of a request in column `call` (JSON
    text), as a column. In each of `rounds` rounds the rows that ask for one are sent again with the result
    below their prompt; one that still asks then has null text, for first_model_fallback. keep: stores a
    round's answers, so that no call is made twice."""
    done, left = None, requests
    for r in range(rounds + 1):
        said = keep(ask(left, call, **retry), r)
        wants = said.withColumn("call", tool_call(F.col("response_text")))
        final = wants.where("call is null" if r < rounds else "true")
        final = final.withColumn("response_text", F.when(F.col("call").isNull(), F.col("response_text"))).drop("call")
        done = final if done is None else done.unionByName(final)
        if r == rounds:
            break
        asked = wants.where("call is not null").withColumn("__result", tool).drop("response_text", "usage")
        ids = [c for c in requests.columns if c != "prompt"]
        left = requests.alias("a").join(asked.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ids])
        more = F.concat(F.col("a.prompt"), F.lit("\n\nTool result:\n"), F.coalesce(F.col("b.__result").cast("string"), F.lit("none")))
        left = left.select(*[F.col(f"a.{c}") for c in ids], more.alias("prompt"))
        requests = left
    return done


def table_answers(fused: DataFrame, text_only: DataFrame) -> DataFrame:
    """Answers about tables: those read from image and text together, else from the text alone (O-L2). Both:
    RESPONSES; a block counts as answered when its answer holds a record."""
    keys = ["paper_name", "block_id", "model"]
    good = fused.where(F.size(records_column(F.col("response_text"))) > 0)
    return good.unionByName(text_only.join(good.select(*keys).distinct(), keys, "left_anti").select(*fused.columns))


def prompt(template: str, **columns: Column) -> Column:
    """A prompt template with {name} places filled from columns (O-P7)."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def key_fields(names: tuple[str, ...] = ("enzyme_name", "substrate", "organism", "mutations", "Km_value", "Km_unit", "kcat_value", "kcat_unit")) -> Column:
    """The filled key fields of a record as JSON, for a prompt."""
    return F.to_json(F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in names]))


def messages(system: Column, user: Column, image: Column | None = None) -> Column:
    """Chat messages in the common shape; an image goes as a data URL (O-P9)."""
    text = F.struct(F.lit("text").alias("type"), user.alias("text"), F.lit(None).cast("string").alias("image_url"))
    parts = F.array(text)
    if image is not None:
        parts = F.concat(parts, F.array(F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), image.alias("image_url"))))
    none = F.array().cast("array<struct<type:string,text:string,image_url:string>>")
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content"), none.alias("parts")),
        F.struct(F.lit("user").alias("role"), user.alias("content"), parts.alias("parts")),
    )
