"""Table sources.

``accounts`` is the row entity every operator works on: one row per order
with a role (train / test / ref), a 0/1 label, short and wide categoricals,
tri-state service columns, a month count and two amounts.  It plays the
part of the churn table (train + test + reference population) and is built
from the driver's TPC-H-like parquet tables with ordinary joins and one
aggregate, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATEGORICALS = ["pri", "seg", "nation", "region"]
SERVICES = ["svc_return", "svc_accept", "svc_keep", "svc_bulk",
            "svc_disc", "svc_tax", "svc_open", "svc_late"]
NUMERICS = ["tenure", "monthly", "total"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV scan with a declared schema (A1): no inference pass, and bad
    text becomes null through ``try_cast`` downstream, not an error."""
    return spark.read.schema(schema).option("header", True).csv(path)


def _tri(flag_count: str) -> Column:
    return (F.when(F.col("n_items_raw").isNull(), F.lit("None"))
            .when(F.col(flag_count) > 0, F.lit("Yes")).otherwise(F.lit("No")))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation ⋈ region ⟕ per-order lineitem aggregate.

    Plan: the lineitem aggregate and orders are both shuffled on the order
    key (one exchange each, partial aggregation map-side); customer joins
    orders on its key; nation and region are the fixed 25 / 5 row TPC
    dimensions and are broadcast.
    """
    o = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "o_orderpriority")
    c = load(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", "n_name", "r_name")

    def k(pred):
        return F.sum(F.when(pred, 1).otherwise(0))

    li = (load(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n_items_raw"),
               k(F.col("l_returnflag") == "R").alias("k_ret"),
               k(F.col("l_returnflag") == "A").alias("k_acc"),
               k(F.col("l_returnflag") == "N").alias("k_non"),
               k(F.col("l_quantity") > 40).alias("k_blk"),
               k(F.col("l_discount") >= 0.08).alias("k_dsc"),
               k(F.col("l_tax") >= 0.07).alias("k_tax"),
               k(F.col("l_linestatus") == "O").alias("k_opn"),
               k(F.year("l_shipdate") >= 1999).alias("k_lat")))

    key = F.col("o_orderkey")
    df = (o.join(c, o.o_custkey == c.c_custkey)
          .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
          .join(li, key == F.col("l_orderkey"), "left"))
    return df.select(
        key.alias("id"),
        F.when(key % 10 < 7, "train").when(key % 10 < 9, "test")
         .otherwise("ref").alias("role"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.col("o_orderpriority").alias("pri"),
        F.col("c_mktsegment").alias("seg"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
        ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1)
        .cast("int").alias("tenure"),
        F.col("c_acctbal").alias("monthly"),
        F.col("o_totalprice").alias("total"),
        F.coalesce(F.col("n_items_raw"), F.lit(0)).cast("long").alias("n_items"),
        _tri("k_ret").alias("svc_return"),
        _tri("k_acc").alias("svc_accept"),
        _tri("k_non").alias("svc_keep"),
        _tri("k_blk").alias("svc_bulk"),
        _tri("k_dsc").alias("svc_disc"),
        _tri("k_tax").alias("svc_tax"),
        _tri("k_opn").alias("svc_open"),
        _tri("k_lat").alias("svc_late"),
    )


def accounts_once(spark: SparkSession, sf_dir: str, scores: bool = False,
                  columns: list[str] | None = None) -> DataFrame:
    """``accounts`` (optionally with scores; of these ``columns``, if given)
    materialised once as parquet in the shared checkpoint folder, for plans
    that read it in several jobs (train and test sides, quantile boundaries,
    fitted tables): the lineitem aggregation and the joins then run once, not
    once per job."""
    from ..session import cut_lineage
    df = accounts(spark, sf_dir)
    if scores:
        df = with_scores(df)
    return cut_lineage(df.select(*columns) if columns else df, "accounts")


def _hundredths(*terms: Column) -> Column:
    """Exact decimal sum (in hundredths, integer arithmetic) as a double:
    equals a SQL engine's DECIMAL result cast to DOUBLE, so ties between
    equal scores survive exactly."""
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total.cast("double") / F.lit(100.0)


def _svc_return_100() -> Column:
    return F.when(F.col("svc_return") == "Yes", 100).otherwise(0)


def _logit_core() -> Column:
    # 0.02 * (40 - tenure) + [svc_return = Yes] - 0.6
    return _hundredths(2 * (40 - F.col("tenure")), _svc_return_100(), F.lit(-60))


def with_scores(df: DataFrame) -> DataFrame:
    """Planted label ``y_sig`` and two fixed scores ``s_a`` / ``s_b``.

    They stand in for a trained model wherever an exact oracle is needed
    (AUC, blending, calibration, sweeps); the noise is a modular hash of
    the id, so the whole thing is a pure function of the row.
    """
    noise = ((F.col("id") * 7919 + 17) % 10007) / F.lit(10007.0)
    noise_b = ((F.col("id") * 104729 + 29) % 10007) / F.lit(10007.0)
    # 0.02 * (40 - tenure) + [svc_return = Yes] + 0.8 * [urgent]
    sig_fixed = _hundredths(2 * (40 - F.col("tenure")), _svc_return_100(),
                            F.when(F.col("pri") == "1-URGENT", 80).otherwise(0))
    sig = sig_fixed + F.lit(3.0) * (noise - F.lit(0.5))
    e = F.exp(-_logit_core())
    return df.select(
        "*",
        (sig > F.lit(0.6)).cast("int").alias("y_sig"),
        (F.lit(1.0) / (F.lit(1.0) + e)).alias("s_a"),
        (F.lit(0.7) / (F.lit(1.0) + e) + F.lit(0.3) * noise_b).alias("s_b"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scores(accounts(spark, sf_dir))


# ---------------------------------------------------------------------------
# Derived edge inputs (nulls, blanks, unseen and padded values); the driver
# tables contain no nulls, so these are produced from the row id.
# ---------------------------------------------------------------------------

def text_amount() -> Column:
    """Amount arriving as text, blank for every 50th id."""
    return F.when(F.col("id") % 50 == 0, F.lit(" ")).otherwise(
        F.col("monthly").cast("string"))


def padded_category() -> Column:
    """Category with surrounding spaces, null for every 37th id."""
    return F.when(F.col("id") % 37 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(" "), F.col("pri"), F.lit(" ")))


def unseen_category() -> Column:
    """``pri`` with a value that only the test rows carry."""
    return F.when((F.col("role") == "test") & (F.col("id") % 97 == 0),
                  F.lit("ZZZ")).otherwise(F.col("pri"))
