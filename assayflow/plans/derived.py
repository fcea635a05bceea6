"""Records, papers and blocks derived from the test tables, so that every record operator has rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import normalise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier is a paper, a line item one of its records, line numbers are extraction models."""
    li, p, s = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    rows = li.withColumn("rec_idx", F.row_number().over(w) - 1)
    # Suppliers first: the window has left the rows by supplier.
    rows = rows.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    flag = F.col("l_returnflag")
    source = F.when(flag == "A", "table").when(flag == "N", "text").otherwise("figure")
    products = F.array(F.struct(F.concat("p_type", F.lit(" acid")).alias("name"), F.when(F.col("l_linestatus") == "O", "less toxic").alias("toxicity_change")))
    out = rows.select(
        F.col("l_suppkey").alias("paper_name"), "rec_idx", F.concat(F.lit("m"), (F.col("l_linenumber") % 3).cast("string")).alias("model"),
        source.alias("source_type"), F.concat(source, F.lit("_block_"), (F.col("rec_idx") % 7).cast("string")).alias("block_id"),
        F.concat(F.lit("10.1000/"), F.col("l_suppkey").cast("string")).alias("doi"),
        F.when(F.col("l_quantity") != 13, F.col("p_brand")).alias("enzyme_name"),
        F.when(F.col("l_linenumber") == 5, F.concat("p_brand", F.lit("-lyase"))).alias("enzyme_full_name"),
        F.when(F.col("l_linenumber") % 2 == 0, "hydrolase").alias("enzyme_type"),
        F.col("p_type").alias("substrate"), F.when(F.col("l_linestatus") == "O", "E186R").alias("mutations"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("organism"),
        F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).alias("Km_value"),
        F.when(F.col("l_tax") > 0.02, F.when(flag == "A", "mM").when(flag == "N", "um").otherwise("nM")).alias("Km_unit"),
        F.when(F.col("l_discount") > 0.05, F.round(F.col("l_discount") * 100)).alias("kcat_value"),
        F.when((F.col("l_discount") > 0.05) & (F.col("l_linenumber") != 2), "min-1").alias("kcat_unit"),
        F.when(F.col("l_tax") > 0.05, F.round(F.col("l_tax") * 1000)).alias("degradation_efficiency"),
        F.when(F.col("l_linenumber") == 4, products).alias("products"),
        F.when(F.col("l_linenumber") < 4, F.lit(7.0).cast("double")).alias("ph"),
        F.when(F.col("l_linenumber") == 1, "6.5").alias("optimal_ph"),
        F.when(F.col("p_size") < 10, "1.10.3.2").alias("ec_number"),
        F.when(F.col("l_linenumber") == 6, F.concat(F.lit("crude extract of "), "p_brand")).alias("notes"),
    )
    keep = ("paper_name", "rec_idx", "model", "source_type", "block_id", "doi")
    return normalise(out).select(*keep, *[c for c in normalise(out).columns if c not in keep])


#: The same view for DuckDB, as a common table expression.
RECORDS_SQL = """
rec AS (
  SELECT l_suppkey AS paper_name, rec_idx, 'm' || (l_linenumber % 3) AS model,
    CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'N' THEN 'text' ELSE 'figure' END AS source_type,
    CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'N' THEN 'text' ELSE 'figure' END || '_block_' || (rec_idx % 7) AS block_id,
    '10.1000/' || l_suppkey AS doi,
    CASE WHEN l_quantity <> 13 THEN p_brand END AS enzyme_name,
    CASE WHEN l_linenumber = 5 THEN p_brand || '-lyase' END AS enzyme_full_name,
    CASE WHEN l_linenumber % 2 = 0 THEN 'hydrolase' END AS enzyme_type,
    p_type AS substrate, CASE WHEN l_linestatus = 'O' THEN 'E186R' END AS mutations,
    CASE WHEN s_acctbal >= 0 THEN s_name END AS organism,
    CASE WHEN l_tax > 0.02 THEN l_quantity END AS Km_value,
    CASE WHEN l_tax > 0.02 THEN CASE l_returnflag WHEN 'A' THEN 'mM' WHEN 'N' THEN 'um' ELSE 'nM' END END AS Km_unit,
    CASE WHEN l_discount > 0.05 THEN round(l_discount * 100) END AS kcat_value,
    CASE WHEN l_discount > 0.05 AND l_linenumber <> 2 THEN 'min-1' END AS kcat_unit,
    CASE WHEN l_tax > 0.05 THEN round(l_tax * 1000) END AS degradation_efficiency,
    CASE WHEN l_linenumber = 4 THEN p_type || ' acid' END AS product,
    CASE WHEN l_linenumber = 4 AND l_linestatus = 'O' THEN 'less toxic' END AS toxicity_change,
    CASE WHEN l_linenumber < 4 THEN CAST(7.0 AS DOUBLE) END AS ph,
    CASE WHEN l_linenumber = 1 THEN '6.5' END AS optimal_ph,
    CASE WHEN p_size < 10 THEN '1.10.3.2' END AS ec_number,
    CASE WHEN l_linenumber = 6 THEN 'crude extract of ' || p_brand END AS notes
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) - 1 AS rec_idx FROM lineitem) l
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)"""

#: Score of a record, on the columns of rec.
SCORE_SQL = """
CASE WHEN enzyme_name IS NULL OR substrate IS NULL OR (Km_value IS NULL AND kcat_value IS NULL AND degradation_efficiency IS NULL) THEN 1
  WHEN ((Km_value IS NOT NULL OR kcat_value IS NOT NULL)::INT + (degradation_efficiency IS NOT NULL)::INT + (product IS NOT NULL)::INT
        + (toxicity_change IS NOT NULL)::INT + (organism IS NOT NULL)::INT + (ph IS NOT NULL OR optimal_ph IS NOT NULL)::INT >= 3
        OR (degradation_efficiency IS NOT NULL AND product IS NOT NULL AND toxicity_change IS NOT NULL))
    AND (ec_number IS NOT NULL OR enzyme_full_name IS NOT NULL) THEN 3
  ELSE 2 END"""
