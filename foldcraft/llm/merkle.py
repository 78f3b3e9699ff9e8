"""Merkle manifest of a dataset: a digest of every row, a tree of digests per
group, a root over the groups, and a proof per row.

A row's leaf is the SHA-256 of its fields, each with its length, so no two
rows share an encoding.  Per group (``lang``) leaves ascend by ``doc_id``; at
every level runs of FAN consecutive nodes become one parent, the digest of
their digests, until one node is left.  These subroots, in the order of their
groups, are the leaves of one more tree, whose last node is the root.

Levels by windows.  A level is a table (grp, pos, n, node): n nodes per group
at the places pos.  A node's slot is pos mod FAN, its run has min(FAN, n - (pos
- slot)) nodes.  Fixed-offset lag and lead columns (FAN - 1 each) hold the
neighbours; masked by slot and run length they are the siblings left and right
of the node, and the rows of slot 0 hash the whole run into the parent.

A proof is the list of (left, right) digests from leaf to root.  It is put
together from the top: a node's proof is its own siblings before its parent's
proof.  Folding hashes left, node and right up the list; a leaf belongs to the
dataset if that gives the root.

Distribution.  Texts are read once, for the leaves; digests alone are sorted,
by (grp, doc_id, leaf) over ranges, and numbered by the ranges' counts.  A
window's partition is a block of BLOCK places, which is a multiple of FAN, so
no run is torn and a group that holds most rows is many tasks.  A level has an
eighth of the rows of the one below; the driver sees the number of levels, one
number.  Every level is a stored table.

Defined results: null fields are encoded as "-", which no value is; null
groups are a group, the first; null doc_ids are the first leaves of their
group; rows that share a doc_id are ordered by their leaf, rows repeated whole
have equal leaves but places and proofs of their own; a single leaf is its
subroot, and a single subroot the root (then the proof is empty, its digest
that of the empty string); an empty table gives an empty result.  Columns
beyond those of the leaf are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import row_number_in_order
from ..session import cut_lineage
from .common import documents

FAN = 8
#: places of one window partition, a multiple of FAN
BLOCK = FAN ** 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(fields: list[Column]) -> Column:
    """Digest of a row: "-" for a null, else byte length, colon, value."""
    values = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def leaf_table(docs: DataFrame, changed: Column, fields=FIELDS, group: str = "lang", order: str = "doc_id",
               text: str = "text") -> DataFrame:
    """(doc_id, grp, leaf, changed_leaf): the digest of every row, and that of
    the row with ``changed`` as its text; grp is never null and sorts as the
    group does, null first."""
    grp = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    other = [changed if f == text else F.col(f) for f in fields]
    return docs.select(F.col(order).alias("doc_id"), grp.alias("grp"), leaf_of([F.col(f) for f in fields]).alias("leaf"),
                       leaf_of(other).alias("changed_leaf"))


def _siblings(level: DataFrame) -> DataFrame:
    """Adds slot, and the siblings' digests left and right of each node and
    the whole run's, as strings."""
    w = Window.partitionBy("grp", "block").orderBy("pos")
    slot, run = F.col("slot"), F.col("run")
    cols = []
    for k in range(1, FAN):
        cols += [F.lag("node", k).over(w).alias(f"b{k}"), F.lead("node", k).over(w).alias(f"a{k}")]
    d = level.withColumn("slot", F.col("pos") % FAN).withColumn(
        "run", F.least(F.lit(FAN), F.col("n") - F.col("pos") + F.col("slot"))).withColumn("block", F.floor(F.col("pos") / BLOCK))
    d = d.select("*", *cols)
    left = [F.when(slot >= k, F.col(f"b{k}")).otherwise(F.lit("")) for k in range(FAN - 1, 0, -1)]
    right = [F.when(slot + k < run, F.col(f"a{k}")).otherwise(F.lit("")) for k in range(1, FAN)]
    return d.select(*level.columns, "slot", F.concat(*left).alias("left"), F.concat(*right).alias("right"))


def tree_levels(leaves: DataFrame) -> list[DataFrame]:
    """The tree above ``leaves`` (grp, pos, n, node): stored tables, the leaves
    first, of (grp, pos, n, node, left, right).  A group stops at its single
    node, which is there without siblings; ``n`` = 1 marks it."""
    levels = []
    level = leaves
    while True:
        one = level.filter("n = 1").withColumns({"left": F.lit(None).cast("string"), "right": F.lit(None).cast("string")})
        more = _siblings(level.filter("n > 1")).drop("slot")
        stored = cut_lineage(more.unionByName(one), "merkle-level")
        levels.append(stored)
        if not (stored.agg(F.max("n")).first()[0] or 0) > 1:  # one number
            return levels
        runs = stored.filter((F.col("n") > 1) & (F.col("pos") % FAN == 0))
        level = runs.select("grp", F.floor(F.col("pos") / FAN).alias("pos"), F.ceil(F.col("n") / FAN).alias("n"),
                            digest(F.col("node"), F.col("right")).alias("node"))


def subroots(levels: list[DataFrame]) -> DataFrame:
    """(grp, node) of every group."""
    tops = [x.filter("n = 1").select("grp", "node") for x in levels]
    return reduce(DataFrame.unionByName, tops)


def _step() -> Column:
    return F.struct("left", "right")


NO_STEPS = "CAST(array() AS array<struct<left: string, right: string>>)"


def proofs(levels: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """(grp, pos, top, path) of every leaf: the top node of its group and its
    (left, right) digests from the leaf to that node, followed by the group's
    own path in ``above`` (a_grp, a_path, root)."""
    down = None
    for level in reversed(levels):
        top = level.filter("n = 1").select("grp", "pos", F.col("node").alias("top"), F.expr(NO_STEPS).alias("path"))
        if above is not None:
            top = top.join(above, F.col("grp") == F.col("a_grp")).select("grp", "pos", "top", F.col("a_path").alias("path"))
        own = top
        if down is not None:
            up = down.select(F.col("grp").alias("u_grp"), F.col("pos").alias("u_pos"), "top", F.col("path").alias("u_path"))
            d = level.filter("n > 1").join(up, (F.col("grp") == F.col("u_grp")) & (F.floor(F.col("pos") / FAN) == F.col("u_pos")))
            own = own.unionByName(d.select("grp", "pos", "top", F.concat(F.array(_step()), F.col("u_path")).alias("path")))
        # the leaves' proofs are read once, the others by the level below
        down = own if level is levels[0] else cut_lineage(own, "merkle-proofs")
    return down


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its proof give."""
    return F.aggregate(path, node, lambda acc, x: digest(x["left"], acc, x["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, from the leaf's up."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Stored rows with their place ``pos`` in their group and its size ``n``."""
    return row_number_in_order(rows, "grp", order, "pos").withColumnRenamed("pos_n", "n")


def manifest(leaves: DataFrame) -> DataFrame:
    """For ``leaves`` (doc_id, grp, leaf, ...), stored: every row with its
    subroot, the root, and its path to the root."""
    rows = cut_lineage(_placed(leaves, ["doc_id", "leaf"]), "merkle-leaves")
    levels = tree_levels(rows.select("grp", "pos", "n", F.col("leaf").alias("node")))
    tops = subroots(levels).withColumnRenamed("grp", "name").withColumn("grp", F.lit(""))
    tops = cut_lineage(_placed(tops, ["name"]), "merkle-subroots")
    upper = tree_levels(tops.select("grp", "pos", "n", "node"))
    over = proofs(upper).withColumnsRenamed({"pos": "p_pos", "top": "root", "path": "a_path"}).drop("grp")
    over = cut_lineage(tops.join(over, F.col("pos") == F.col("p_pos")).select(
        F.col("name").alias("a_grp"), "a_path", "root"), "merkle-over")
    own = proofs(levels, over).withColumnsRenamed({"grp": "p_grp", "pos": "p_pos", "top": "subroot"})
    d = rows.join(own, (F.col("grp") == F.col("p_grp")) & (F.col("pos") == F.col("p_pos"))).drop("p_grp", "p_pos", "n")
    # one row, the root of all
    return d.crossJoin(F.broadcast(over.select("root").limit(1)))


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def op11_merkle(spark, sf_dir):
    """op11: digests, proof and the verdict on a third of tampered rows."""
    lowered = F.when(tampered(F.col("doc_id")), F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    leaves = cut_lineage(leaf_table(documents(spark, sf_dir), lowered), "merkle-digests")
    d = manifest(leaves).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                                fold(F.col("changed_leaf"), F.col("path")).alias("folded_root"))
    return d.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS[:4]) + " || {0})"

OP11_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1
    THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
rows0 AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295::BIGINT) AS crc FROM documents, crc_table),
leaf AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_LEAF.format(_FIELD.format('text'))} AS leaf,
    CASE WHEN crc % 3 = 0 THEN {_LEAF.format(_FIELD.format(f"translate(text, '{UPPER}', '{LOWER}')"))} END AS other
  FROM rows0),
up AS (
  SELECT 0 AS level, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY grp) AS n, leaf AS node FROM leaf
  UNION ALL
  SELECT level + 1, grp, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY level, grp, pos // 8),
sub AS (SELECT grp, node FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, grp, node FROM sub
  UNION ALL
  SELECT level + 1, pos // 8, (any_value(n) + 7) // 8, '', sha256(string_agg(node, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY level, pos // 8),
nodes AS (
  SELECT false AS upper, level, grp, pos, n, node FROM up
  UNION ALL SELECT true, level, '', pos, n, node FROM top),
sib AS (
  SELECT a.upper, a.level, a.grp, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.upper = b.upper AND a.level = b.level AND a.grp = b.grp AND a.pos // 8 = b.pos // 8
  WHERE a.n > 1 GROUP BY ALL),
walk AS (
  SELECT u.grp, l.doc_id, u.pos AS leaf_pos, false AS upper, 0 AS level, u.pos, u.n, '' AS proof, coalesce(l.other, l.leaf) AS node
  FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf) l
  JOIN up u ON u.level = 0 AND u.grp = l.grp AND u.pos = l.pos
  UNION ALL
  SELECT w.grp, w.doc_id, w.leaf_pos, w.upper OR w.n = 1, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END,
    CASE WHEN w.n = 1 THEN t.pos ELSE w.pos // 8 END, CASE WHEN w.n = 1 THEN t.n ELSE (w.n + 7) // 8 END,
    CASE WHEN w.n = 1 THEN w.proof ELSE w.proof || s.l || s.r END,
    CASE WHEN w.n = 1 THEN w.node ELSE sha256(s.l || w.node || s.r) END
  FROM walk w LEFT JOIN top t ON t.level = 0 AND t.grp = w.grp AND w.n = 1
  LEFT JOIN sib s ON s.upper = w.upper AND s.level = w.level AND s.grp = CASE WHEN w.upper THEN '' ELSE w.grp END
    AND s.pos = w.pos AND w.n > 1
  WHERE NOT (w.upper AND w.n = 1))
SELECT w.doc_id, u.node AS leaf, sub.node AS subroot, root.node AS root, sha256(w.proof) AS proof_sha256,
  w.node AS folded_root, w.node = root.node AS verified
FROM walk w JOIN up u ON u.level = 0 AND u.grp = w.grp AND u.pos = w.leaf_pos
JOIN sub ON sub.grp = w.grp JOIN top root ON root.n = 1 WHERE w.upper AND w.n = 1
"""
