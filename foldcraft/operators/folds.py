"""Folds, hold-outs, class parts, rebalanced sets and pseudo-label rows.

Every assignment is a pure function of (seed, id, label): rows are ordered
by ``md5('<seed>:<id>')`` inside their label and numbered exactly with the
hash-bucket kernel, so fold sizes differ by at most one per class, folds
do not depend on partitioning, and a recomputed partition after executor
loss gets the same folds.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import row_number_by_hash, row_number_by_value


def seeded_key(seed, id_col: str = "id") -> Column:
    """md5 hex of '<seed>:<id>' (same text in Spark and DuckDB)."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", s.cast("string"), F.col(id_col).cast("string")))


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, label: str = "y",
                     id_col: str = "id", out: str = "fold",
                     segments: Sequence[str] = ()) -> DataFrame:
    """K1: fold = (row number inside label by seeded hash) mod k."""
    r = row_number_by_hash(df, seeded_key(seed, id_col), [*segments, label],
                           out="_rn", tiebreak=id_col, required=label)
    return r.withColumn(out, (F.col("_rn") % k).cast("int")).drop("_rn", "_rn_n")


def multi_seed_folds(df: DataFrame, seeds: Sequence[int] = (11, 42, 99), k: int = 5,
                     label: str = "y", id_col: str = "id") -> DataFrame:
    """K4: one fold column per seed, as rows (seed, id, fold)."""
    ex = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    r = row_number_by_hash(ex, seeded_key(F.col("seed"), id_col), ["seed", label],
                           out="_rn", tiebreak=id_col, required=label)
    return r.withColumn("fold", (F.col("_rn") % k).cast("int")).drop("_rn", "_rn_n")


def nested_folds(df: DataFrame, k_outer: int = 5, k_inner: int = 5, seed: int = 42,
                 label: str = "y", id_col: str = "id", fold: str = "fold",
                 inner_seed_offset: bool = True, keep_own: bool = False) -> DataFrame:
    """K2: for every outer fold f, the rows of its training part (fold != f)
    get an inner fold numbered *within that part* with seed ``seed + f``.

    Output: one row per (outer, row of outer-train) with ``ofold`` and
    ``ifold``; ``df`` must carry ``fold``.  ``keep_own`` also keeps each
    row's copy for its own outer fold (the validation part) with ifold -1.
    """
    ex = df.withColumn("ofold", F.explode(F.array(*[F.lit(i) for i in range(k_outer)])))
    s = (F.col("ofold") + F.lit(seed)) if inner_seed_offset else F.lit(seed)
    inner = ex.filter(F.col("ofold") != F.col(fold))
    r = row_number_by_hash(inner, seeded_key(s, id_col), ["ofold", label],
                           out="_rn", tiebreak=id_col, required=label, stored=True)
    r = r.withColumn("ifold", (F.col("_rn") % k_inner).cast("int")).drop("_rn", "_rn_n")
    if keep_own:
        own = ex.filter(F.col("ofold") == F.col(fold)).withColumn("ifold", F.lit(-1))
        r = r.unionByName(own)
    return r


def stratified_holdout(df: DataFrame, frac: float = 0.2, seed: int = 42, label: str = "y",
                       id_col: str = "id", segments: Sequence[str] = ()) -> DataFrame:
    """K3 (stratified): the first ceil(frac * n_class) rows of each class (of
    each segment) in seeded-hash order are validation."""
    r = row_number_by_hash(df, seeded_key(seed, id_col), [*segments, label], out="_rn", tiebreak=id_col,
                           required=label)
    return r.withColumn("is_valid", (F.col("_rn") < F.ceil(F.col("_rn_n") * frac))
                        .cast("int")).drop("_rn", "_rn_n")


def plain_holdout(df: DataFrame, frac: float = 0.2, seed: int = 42,
                  id_col: str = "id") -> DataFrame:
    """K3 (plain): first ceil(frac * n) rows in seeded-hash order."""
    r = row_number_by_hash(df, seeded_key(seed, id_col), [], out="_rn", tiebreak=id_col)
    return r.withColumn("is_valid", (F.col("_rn") < F.ceil(F.col("_rn_n") * frac))
                        .cast("int")).drop("_rn", "_rn_n")


def near_equal_parts(df: DataFrame, parts: int = 5, order_col: str = "id",
                     segments: Sequence[str] = ()) -> DataFrame:
    """K5: ``ntile(parts)`` over ``order_col``: the first n mod parts parts get
    one extra row.  Computed from the exact distributed row number."""
    r = row_number_by_value(df, order_col, segments, out="_rn", tiebreak=order_col)
    n, rn = F.col("_rn_n"), F.col("_rn")
    q = F.floor(n / parts)
    rem = n - q * parts
    big = rem * (q + 1)
    part = F.when(rn < big, F.floor(rn / (q + 1))).otherwise(
        rem + F.floor((rn - big) / F.greatest(q, F.lit(1))))
    return r.withColumn("part", (part + 1).cast("int")).drop("_rn", "_rn_n")


def rebalanced_sets(df: DataFrame, parts: int = 5, per_other_part: float = 20000,
                    seed: int = 42, label: str = "y", id_col: str = "id") -> DataFrame:
    """K6: set i = majority part i + ``per_other_part`` rows (below 1: that
    share of the rows) sampled (seeded hash order) from every other majority
    part + all minority rows.

    The sample is an exact top-n per (set, part) computed with the bucketed
    row number: only buckets with sampled rows are shuffled.  Output (set_id,
    id, part).
    """
    counts = df.groupBy(label).count()
    # majority label: a 2-row aggregate
    counts = counts.withColumn("count", F.when(F.col(label).isNotNull(), F.col("count")).otherwise(
        F.raise_error(F.concat(F.col("count").cast("string"), F.lit(f" rows have no {label}")))))
    maj = counts.orderBy(F.desc("count"), F.asc(label)).limit(1).select(
        F.col(label).alias("_maj"))
    d = df.crossJoin(F.broadcast(maj))  # one-row side
    major = d.filter(F.col(label) == F.col("_maj")).drop("_maj")
    minor = d.filter(F.col(label) != F.col("_maj")).drop("_maj")
    p = near_equal_parts(major, parts, id_col)
    sets = F.explode(F.array(*[F.lit(i) for i in range(1, parts + 1)]))
    ex = p.withColumn("set_id", sets)
    own = ex.filter(F.col("part") == F.col("set_id"))
    other = ex.filter(F.col("part") != F.col("set_id"))
    key = seeded_key(F.concat_ws(":", F.lit(str(seed)), F.col("set_id").cast("string"),
                                 F.col("part").cast("string")), id_col)

    def wanted(n):
        return F.lit(per_other_part) if per_other_part >= 1 else F.ceil(n * F.lit(float(per_other_part)))

    sampled = row_number_by_hash(other, key, ["set_id", "part"], out="_rn", tiebreak=id_col, wanted=wanted).drop("_rn", "_rn_n")
    pos = minor.withColumn("set_id", sets).withColumn("part", F.lit(0))
    cols = ["set_id", id_col, "part"]
    return own.select(*cols).unionByName(sampled.select(*cols)).unionByName(pos.select(*cols))


def pseudo_rows(test: DataFrame, score: str, threshold: float = 0.95,
                label: str = "y") -> DataFrame:
    """B6 + K7: confident test rows (p > t or p < 1 - t) labelled [p > .5],
    tagged role='pseudo' and fold=-1 so they join every fold's fit set."""
    conf = test.filter((F.col(score) > threshold) | (F.col(score) < 1 - threshold))
    return (conf.withColumn(label, (F.col(score) > 0.5).cast("int"))
            .withColumn("role", F.lit("pseudo")).withColumn("fold", F.lit(-1)))


def inspection_sample(df: DataFrame, n: int = 10, seed: int = 42,
                      id_col: str = "id") -> DataFrame:
    """N rows in seeded-hash order (TakeOrdered: per-partition top-n)."""
    return df.orderBy(seeded_key(seed, id_col), F.col(id_col)).limit(n)
