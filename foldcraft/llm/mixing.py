"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order (md5 of seed
and doc_id).  A document's virtual finish time is the source's words up to
and including it, divided by the source's target; as a target may be up to
``max_repeat`` times what the source has, each document queues once per
pass, later passes behind the whole earlier one.  All queues are merged by
finish time and the merged order is cut at the total budget.

Distribution.  Both prefix sums (within a source, and over the merged order)
are taken in buckets: about sqrt(rows) buckets, so that neither a bucket's
window nor the table of bucket totals grows beyond sqrt(rows), even when one
source holds most rows.  Shuffle keys and virtual time are both uniform over
their range, which keeps the buckets even.  Only (doc_id, source, size) is
moved, never the text.

Defined results: a null text has size 0; documents of size 0 take nothing;
null source is a source of its own, last in order; a null doc_id is shuffled
by the word "null"; repeated rows queue as separate documents; an empty
table gives an empty result; sources whose documents are all empty have
target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import documents, text_of, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
SEED = "mix"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) for rows (source, size).

    Weights repeat over the sources in code point order, null last.  Targets
    share ``share`` x all sizes by weight; one that exceeds ``max_repeat`` x
    its source's size stops there and the excess is shared again by weight
    until none is above.  The fixed point is found in one pass: sources are
    capped in the order of cap / weight, so the level L at which targets are
    min(cap, L x weight) follows from running sums over that order.

    The table has one row per source: its windows run over metadata.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    wt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                      (F.pmod(F.row_number().over(
                          Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(n)) + 1).cast("int"))
    t = by_source.withColumn("w", wt).withColumn(
        "cap", F.lit(float(max_repeat)) * F.col("source_size"))
    every = Window.partitionBy()
    order = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # level if exactly the sources before this one were capped
    t = t.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every)
                               - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("w").over(behind))
    # first source not capped at its own level sets the level of all behind it
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    first_free = F.first(free, ignorenulls=True).over(
        Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return t.select("source", "source_size",
                    F.coalesce(first_free * F.col("w"), F.col("cap")).alias("target"))


def fair_queue(sizes: DataFrame, targets: DataFrame, max_repeat: int = MAX_REPEAT,
               seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, pass, finish) of every document and pass,
    before the cut.  ``sizes`` has (doc_id, source, size), stored."""
    n_buckets = max(16, math.isqrt(max(1, sizes.count())))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    d = (sizes.filter("size > 0").withColumn("key", key)
         .withColumn("b", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
                                 * n_buckets / F.lit(1 << 32), F.lit(n_buckets)).cast("int")))
    totals = d.groupBy("source", "b").agg(F.sum("size").alias("bn"))
    earlier = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "b", F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("off"))
    offsets = (offsets.join(targets, offsets["source"].eqNullSafe(targets["source"]))
               .select(offsets["source"].alias("o_source"), F.col("b").alias("o_b"), "off",
                       "source_size", "target"))
    within = (Window.partitionBy("source", "b").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("cum", F.sum("size").over(within))
    q = d.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("b") == F.col("o_b")))
    q = q.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
    return q.select("doc_id", "source", "size", "key", "pass",
                    ((F.col("pass") * F.col("source_size") + F.col("off") + F.col("cum"))
                     / F.col("target")).alias("finish"))


def cut_at_budget(queue: DataFrame, budget: Column | float, n_rows: int) -> DataFrame:
    """The rows of ``queue`` (stored) whose running size in the order of
    finish time stays within ``budget``.  Virtual time 1 is the moment at
    which every source has met its target, so buckets of equal virtual time
    hold about equal sizes; the running total is taken over bucket totals
    first and inside a bucket second."""
    n_buckets = max(16, math.isqrt(max(1, n_rows)))
    q = queue.withColumn("fb", F.least(F.floor(F.col("finish") * n_buckets), F.lit(1 << 40)))
    totals = q.groupBy("fb").agg(F.sum("size").alias("bn"))
    off = totals.select(F.col("fb").alias("o_fb"), F.coalesce(F.sum("bn").over(
        Window.orderBy("fb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    order = (Window.partitionBy("fb").orderBy("finish", F.col("source").asc_nulls_last(), "key", "doc_id", "size")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    q = q.join(off, F.col("fb") == F.col("o_fb"))
    return q.withColumn("position", F.col("off") + F.sum("size").over(order)).filter(
        F.col("position") <= budget).drop("fb", "o_fb", "off")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT,
        seed: str = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mixes ``docs`` (doc_id, text, source).  A source's taken words are
    within one of its documents, and one of any other source, of its target:
    a document is taken whole or not, so a source of few long documents can
    be far from a small target.

    Returns (sizes, targets, taken): the (doc_id, source, size) of every row,
    the target of every source, and one row per taken copy (doc_id, source,
    size, pass, finish, position), position being the running number of
    words in the mix."""
    sizes = cut_lineage(docs.select("doc_id", "source", F.size(words_of(text_of(F.col("text"))))
                                    .cast("long").alias("size")), "mix-sizes")
    targets = cut_lineage(source_targets(sizes, weights, share, max_repeat), "mix-targets")
    queue = cut_lineage(fair_queue(sizes, targets, max_repeat, seed), "mix-queue")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0  # one number
    return sizes, targets, cut_at_budget(queue, budget, queue.count())


def mix_report(docs: DataFrame, **params) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``;
    rows equal in doc_id, source and size share their copies evenly."""
    sizes, targets, taken = mix(docs, **params)
    copies = taken.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    rows = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    c = (rows.join(copies, rows["doc_id"].eqNullSafe(copies["doc_id"])
                   & rows["source"].eqNullSafe(copies["source"]) & (rows["size"] == copies["size"]), "left")
         .select(rows["doc_id"], rows["source"], rows["size"], "rows",
                 F.coalesce("copies", F.lit(0)).alias("copies")))
    # row j of r equal rows takes the copies j, j + r, ...
    c = c.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    own = F.floor((F.col("copies") + F.col("rows") - 1 - F.col("j")) / F.col("rows"))
    t = targets.withColumnRenamed("source", "t_source")
    return c.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * own).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: ``docs`` (any columns, among them doc_id, text and
    source) with each row as often as the mix takes it, in no order."""
    taken = mix(docs, **params)[2].groupBy("doc_id", "source", "size").agg(
        F.count(F.lit(1)).alias("copies")).select(*[F.col(c).alias(f"_t_{c}") for c in ("doc_id", "source", "size", "copies")])
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
                    F.size(words_of(text_of(docs["text"]))).cast("long").alias("_size"))
    # equal rows share the copies: row j of r takes the copies j, j + r, ..., in
    # the order of their texts, so that reruns agree
    equal = Window.partitionBy("_row.doc_id", "_row.source", "_size")
    d = d.select("_row", "_size", (F.row_number().over(equal.orderBy(F.xxhash64("_row.text"))) - 1).alias("_j"),
                 F.count(F.lit(1)).over(equal).alias("_rows"))
    j = d.join(taken, F.col("_row.doc_id").eqNullSafe(F.col("_t_doc_id"))
               & F.col("_row.source").eqNullSafe(F.col("_t_source")) & (F.col("_size") == F.col("_t_size")))
    own = F.floor((F.col("_t_copies") + F.col("_rows") - 1 - F.col("_j")) / F.col("_rows"))
    return j.select("_row", F.explode(F.array_repeat(F.lit(0), own.cast("int")))).select("_row.*")


def op6_mixing(spark, sf_dir):
    """op6: every document's share in the mix."""
    return mix_report(documents(spark, sf_dir))


OP6_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
         lambda x: x <> '')) AS BIGINT) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w
  FROM sizes GROUP BY source),
-- targets by repeated sharing: those above twice their source stop there
fill AS (
  SELECT 0 AS step, source, source_size, w, false AS capped,
    w * (1.5::DOUBLE * sum(source_size) OVER () / sum(w) OVER ()) AS target FROM src
  UNION ALL
  SELECT step + 1, source, source_size, w, capped OR target > 2 * source_size,
    CASE WHEN capped OR target > 2 * source_size THEN 2.0::DOUBLE * source_size
         ELSE w * ((1.5::DOUBLE * sum(source_size) OVER ()
                    - sum(CASE WHEN capped OR target > 2 * source_size THEN 2.0::DOUBLE * source_size ELSE 0 END) OVER ())
                   / sum(CASE WHEN capped OR target > 2 * source_size THEN 0 ELSE w END) OVER ()) END
  FROM fill WHERE step < (SELECT count(*) FROM src)),
targets AS (SELECT source, source_size, target FROM fill WHERE step = (SELECT max(step) FROM fill)),
q AS (
  SELECT s.doc_id, s.source, s.size, p.pass, md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')) AS k,
    t.source_size, t.target,
    sum(s.size) OVER (PARTITION BY s.source, p.pass ORDER BY md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')),
      s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) p(pass)
  WHERE s.size > 0),
cut AS (
  SELECT doc_id, source, size, sum(size) OVER (
    ORDER BY (pass * source_size + cum)::DOUBLE / target, source ASC NULLS LAST, k, doc_id, size
    ROWS UNBOUNDED PRECEDING) AS position FROM q),
taken AS (
  SELECT doc_id, count(*) AS copies FROM cut
  WHERE position <= (SELECT sum(target) FROM targets) GROUP BY doc_id)
SELECT s.doc_id, s.size, t.source_size, t.target, CAST(s.size * coalesce(k.copies, 0) AS BIGINT) AS taken
FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k ON k.doc_id = s.doc_id
"""
