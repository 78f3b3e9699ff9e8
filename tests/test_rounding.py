"""round6 (Spark column and SQL text) equals DuckDB's round(x, 6) bit for
bit, including ties, signed zeros, NaN, infinities and overflow; and the
chunked standardisation equals a direct per-group computation."""

import math
import random
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldcraft.session import round6, round6_sql


def _values():
    rnd = random.Random(7)
    vals = [0.0, -0.0, 5e-7, -5e-7, 0.49999999999999994e-6, 1.5e-6, 2.5e-6, -2.5e-6,
            float("nan"), float("inf"), float("-inf"), 4.5e9, 4.4999e9, 123456789.1234565,
            -987654.3210005, 1e300, -1e-300]
    for _ in range(3000):
        k = rnd.random()
        if k < .4:
            vals.append(round(rnd.uniform(-100, 100), 7))  # near ties
        elif k < .6:
            vals.append((rnd.randint(-10**9, 10**9) + 0.5) / 1e6)  # exact-looking ties
        elif k < .8:
            vals.append(rnd.uniform(-1, 1) * 10 ** rnd.randint(-12, 12))
        else:
            vals.append(struct.unpack("d", struct.pack("Q", rnd.getrandbits(64)))[0])
    return vals


def _same(p, q):
    if q is None or (isinstance(q, float) and math.isnan(q)):
        return p is not None and math.isnan(p)
    return repr(p) == repr(q)


def test_round6_matches_duckdb(spark, duck):
    vals = _values()
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i long, x double")
    got = df.select("i", round6(F.col("x")).alias("a"), F.expr(round6_sql("x")).alias("b")).orderBy("i").collect()
    pdf = pd.DataFrame({"i": range(len(vals)), "x": vals})  # noqa: F841 (scanned by DuckDB)
    want = duck.execute("select i, round(x, 6) from pdf order by i").fetchall()
    bad = [(vals[i], a, b, r) for (i, a, b), (_, r) in zip(got, want) if not (_same(a, r) and _same(b, r))]
    assert not bad, bad[:5]


def test_standardize_matches_direct(spark):
    from foldcraft.operators.stats import standardize
    rnd = random.Random(3)
    rows = [(g, i, "fit" if i % 3 else "other", *[rnd.gauss(g, 1 + j) for j in range(20)])
            for g in range(3) for i in range(40)]
    names = [f"c{j}" for j in range(20)]
    df = spark.createDataFrame(rows, ["g", "i", "part", *names])
    got = {(r["g"], r["i"]): r for r in standardize(df, names, "g", F.col("part") == "fit").collect()}
    pdf = pd.DataFrame(rows, columns=["g", "i", "part", *names])
    fit = pdf[pdf.part == "fit"].groupby("g")
    mu, sd = fit[names].mean(), fit[names].std(ddof=0)
    for _, r in pdf.iterrows():
        for n in names:
            want = (r[n] - mu.loc[r.g, n]) / sd.loc[r.g, n]
            assert got[(r.g, r.i)][n] == pytest.approx(want, rel=1e-9, abs=1e-12)
