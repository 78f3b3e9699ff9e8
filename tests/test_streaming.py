"""Streaming application of fitted encodings equals the batch result."""

import os
import tempfile

from pyspark.sql import functions as F

from foldcraft.operators import encode as E
from foldcraft.sources import tables as T
from foldcraft.streaming import apply as S

from .conftest import SF_SMALL


def test_stream_matches_batch(spark):
    a = T.accounts(spark, SF_SMALL)
    fit = a.filter(F.col("role") == "train")
    cols = ["pri", "seg"]
    table = S.fitted_table(fit, cols, m=10.0).cache()
    src = tempfile.mkdtemp(prefix="fc-stream-src-")
    test = a.filter(F.col("role") == "test").select("id", "pri", "seg")
    test.write.mode("overwrite").parquet(os.path.join(src, "batch0"))
    stream = spark.readStream.schema(test.schema).parquet(os.path.join(src, "batch0"))
    q = (S.apply_encodings(stream, table, cols).writeStream.format("memory").queryName("fc_stream_out")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("fc_stream_out").select("id", "te_pri", "te_seg")
    want = E.encode_full(fit, test, cols, {"te": E.smoothed(10)}, prefix_fmt="te_{col}").select("id", "te_pri", "te_seg")
    a_ = sorted((r.id, round(r.te_pri, 12), round(r.te_seg, 12)) for r in got.collect())
    b_ = sorted((r.id, round(r.te_pri, 12), round(r.te_seg, 12)) for r in want.collect())
    assert a_ == b_ and len(a_) > 0
