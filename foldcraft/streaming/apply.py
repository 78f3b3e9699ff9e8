"""Incremental application of fitted encodings to arriving rows.

The reference reads every input once and has no stream; the only
operation with an incremental form is "apply fitted statistics to new
unlabelled rows" (the test side of I1 / J1).  This module expresses it in
Structured Streaming: a stream-static left join of the arriving rows with
the fitted (col, value) table, written per micro-batch.  The fitted table
is static and small (bounded by category counts), so the join is a
broadcast inside every micro-batch and the stream keeps no state.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fitted_table(fit: DataFrame, cols: Sequence[str], label: str = "y", m: float = 10.0) -> DataFrame:
    """Smoothed encodings (I1) of ``cols`` as a wide-per-column lookup:
    (col, value, enc) plus the prior row (col = '__prior__')."""
    arr = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
    prior = fit.agg(F.avg(label).alias("p"))
    st = (fit.select(F.col(label).alias("_y"), F.explode(arr).alias("kv"))
          .groupBy("kv.col", "kv.value").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s")))
    enc = st.crossJoin(F.broadcast(prior)).select(
        "col", "value", ((F.col("s") + F.lit(m) * F.col("p")) / (F.col("n") + F.lit(m))).alias("enc"))
    return enc.unionByName(prior.select(F.lit("__prior__").alias("col"), F.lit(None).cast("string").alias("value"),
                                        F.col("p").alias("enc")))


def apply_encodings(stream: DataFrame, table: DataFrame, cols: Sequence[str],
                    prefix: str = "te_") -> DataFrame:
    """Stream-static joins: every micro-batch of ``stream`` gets one
    encoded column per input column; unseen values get the prior."""
    prior = table.filter(F.col("col") == "__prior__").select(F.col("enc").alias("_prior"))
    out = stream.crossJoin(F.broadcast(prior))
    for c in cols:
        t = table.filter(F.col("col") == c).select(F.col("value").alias(f"_v_{c}"), F.col("enc").alias(f"_e_{c}"))
        out = out.join(t, out[c].cast("string") == t[f"_v_{c}"], "left")
    return out.select(*stream.columns, *[F.coalesce(F.col(f"_e_{c}"), F.col("_prior")).alias(f"{prefix}{c}")
                                         for c in cols])


def start(stream: DataFrame, table: DataFrame, cols: Sequence[str], sink_path: str, checkpoint: str):
    """Run the encoder as a streaming query writing parquet (exactly-once
    through the checkpoint in the shared folder)."""
    return (apply_encodings(stream, table, cols).writeStream.format("parquet")
            .option("path", sink_path).option("checkpointLocation", checkpoint)
            .outputMode("append").start())
