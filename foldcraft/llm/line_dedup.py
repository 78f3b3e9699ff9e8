"""Line dedup: repeated runs of lines, found with a suffix array.

A document is the sequence of its lines that hold a word (blank lines are
left alone).  Suffixes are sorted by prefix doubling: the rank of a suffix
by its first 2k lines follows from the ranks by k lines of the suffix and of
the suffix k lines on.  Suffixes that share a prefix form one interval of
the suffix array, a longest-common-prefix interval; an interval of one
suffix is final and drops out, so each round handles repeated runs alone and
the rounds end when no run of that length repeats.

In each interval the suffix with the smallest (doc_id, line) is the first
copy, all others start a later copy.  Deleted are the lines of every later
copy of a run that has ``min_lines`` lines or more (a power of two), and of
every later copy of a single line with ``min_words`` words or more.  Runs
overlap, so copied runs of any length are covered by their windows of
``min_lines`` lines.

The longest later copy of a document is found to the line.  Its doubling stops
at some k with a run of k to 2k - 1 lines; the remaining bits of the length
follow from the ranks of the smaller powers, highest first: a suffix's prefix
grows by j lines if an earlier suffix of its interval has the same rank by j
lines behind the prefix.  The intervals are refined with it, and those without
a suffix in question drop out.

Distribution.  Lines travel as 64-bit hashes; texts move once, in the last
join.  Intervals are counted with map-side aggregation, so a line that a
third of all documents share is one row per map task; joins back to the
suffixes read stored tables on both sides, which lets adaptive execution
split a hot interval.  Ranks come from running sums over buckets of an
interval's distinct continuations, or of the lines' hashes; both a bucket and
the list of an interval's buckets grow with the square root of the suffixes.

Defined results: null and empty texts have no lines and stay as they are (a
null text stays null); a document's own earlier lines count as earlier
copies; rows that share a doc_id are told apart by their text's hash, rows
repeated whole share one result and do not count as copies of each other;
null doc_ids come first in the order; an empty table gives an empty result.
Two different lines are taken for equal if their 64-bit hashes agree
(probability about n^2 / 2^65 for n distinct lines).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import documents, text_key, text_of, words_of

MIN_LINES = 2
MIN_WORDS = 1
#: ranges of the hash by which single lines are ranked, and places of one
#: bucket, at least
RANGES, WIDTH = 4096, 1024


def _has_word(line):
    """Whether a line holds a word; looks at it up to its first character only."""
    return line.rlike(r"[^ \t\n\x0B\f\r]")


def line_table(docs: DataFrame, count_words: bool = True) -> DataFrame:
    """(doc_id, tkey, s, w, lid): word-holding lines, their place s in the
    document, word count (1 unless they are counted) and hash."""
    text = text_of(F.col("text"))
    lines = F.filter(F.split(text, "\n"), _has_word)
    rows = docs.select("doc_id", text_key(text).alias("tkey"), lines.alias("lines")).select(
        "doc_id", "tkey", F.posexplode("lines").alias("s", "line"))
    w = F.size(words_of(F.col("line"))) if count_words else F.lit(1)
    return rows.select("doc_id", "tkey", "s", w.alias("w"), F.xxhash64("line").alias("lid"))


def _start():
    return F.struct(F.col("doc_id"), F.col("s"))


def _first_ranks(intervals: DataFrame, n_lines: int) -> DataFrame:
    """Adds r, the number of repeated suffixes with a smaller first line
    (by hash)."""
    ranges = max(RANGES, math.isqrt(n_lines))
    iv = intervals.withColumn("range", F.shiftright("lid", 64 - (ranges - 1).bit_length()))
    totals = iv.groupBy("range").agg(F.sum("n").alias("rn"))
    # a row per range: the square root of the lines
    off = totals.select(F.col("range").alias("o_range"), F.coalesce(F.sum("rn").over(
        Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    before = Window.partitionBy("range").orderBy("lid").rowsBetween(Window.unboundedPreceding, -1)
    return (iv.join(F.broadcast(off), F.col("range") == F.col("o_range"))
            .select("lid", "first", (F.col("off") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("r")))


def _next_ranks(intervals: DataFrame, width: int) -> DataFrame:
    """(r, nxt, first, r2): ranks of the refined intervals: r and the number
    of suffixes in smaller continuations nxt of r."""
    iv = intervals.withColumn("bucket", F.floor(F.col("nxt") / width))
    earlier = Window.partitionBy("r").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    off = iv.groupBy("r", "bucket").agg(F.sum("n").alias("bn")).select(
        F.col("r").alias("o_r"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("off"))
    before = Window.partitionBy("r", "bucket").orderBy("nxt").rowsBetween(Window.unboundedPreceding, -1)
    iv = iv.withColumn("own", F.coalesce(F.sum("n").over(before), F.lit(0)))
    j = iv.join(off, (F.col("r") == F.col("o_r")) & (F.col("bucket") == F.col("o_bucket")))
    return j.select("r", "nxt", "first", (F.col("r") + F.col("off") + F.col("own")).alias("r2"))


def repeated_suffixes(lines: DataFrame):
    """Yields (k, suffixes) for k = 1, 2, 4, ...: the suffixes (doc_id, tkey,
    s, w, r, later) whose first k lines occur more than once, their rank and
    whether an equal run starts earlier.  ``lines`` is stored; so are the
    yielded tables.  Ends before the first empty one."""
    iv = cut_lineage(_first_ranks(lines.groupBy("lid").agg(
        F.count(F.lit(1)).alias("n"), F.min(_start()).alias("first")).filter("n > 1"), lines.count()), "line-intervals")
    t = cut_lineage(lines.join(iv, "lid").select(
        "doc_id", "tkey", "s", "w", "r", (~F.col("first").eqNullSafe(_start())).alias("later")), "line-suffixes")
    k = 1
    while not t.isEmpty():
        yield k, t
        ahead = Window.partitionBy("doc_id", "tkey").orderBy("s").rangeBetween(k, k)
        pairs = t.select("doc_id", "tkey", "s", "w", "r", F.first("r").over(ahead).alias("nxt")).filter(
            "nxt is not null")
        pairs = cut_lineage(pairs, "line-pairs")
        iv = pairs.groupBy("r", "nxt").agg(F.count(F.lit(1)).alias("n"), F.min(_start()).alias("first")).filter(
            "n > 1")
        iv = cut_lineage(iv, "line-intervals")
        iv = cut_lineage(_next_ranks(iv, max(WIDTH, math.isqrt(pairs.count()))), "line-ranks")
        t = cut_lineage(pairs.join(iv, ["r", "nxt"]).select(
            "doc_id", "tkey", "s", "w", F.col("r2").alias("r"),
            (~F.col("first").eqNullSafe(_start())).alias("later")), "line-suffixes")
        k *= 2


def longest_copies(levels: dict[int, DataFrame], tops: DataFrame) -> DataFrame:
    """(doc_id, tkey, longest): the exact length of each document's longest
    later copy.  ``tops`` (doc_id, tkey, top), stored, has the largest power of
    two of lines that starts one; ``levels`` the suffixes of every power.

    The table of states holds suffixes (doc_id, tkey, s) by the prefix of
    ``base`` lines that they share with their group; ``ask`` marks those whose
    length is wanted, the others are what these may share more lines with."""
    state = None
    for k, t in levels.items():
        if k == 1:
            continue
        own = tops.filter(F.col("top") == k).select(F.col("doc_id").alias("w_doc"), F.col("tkey").alias("w_key"))
        d = t.join(own, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("tkey") == F.col("w_key")), "left").select(
            F.lit(k).alias("k"), F.lit(k).alias("base"), F.xxhash64(F.lit(k), "r").alias("grp"), "doc_id", "tkey", "s",
            (F.col("w_key").isNotNull() & F.col("later")).alias("ask"))
        state = d if state is None else state.unionByName(d)
    short = tops.filter("top = 1").select("doc_id", "tkey", F.lit(1).alias("longest"))
    if state is None:
        return short

    def asked(d: DataFrame) -> DataFrame:
        """The groups in which something is asked."""
        some = d.groupBy("k", "base", "grp").agg(F.max("ask").alias("any")).filter("any").select(
            F.col("k").alias("a_k"), F.col("base").alias("a_base"), F.col("grp").alias("a_grp"))
        return d.join(some, (F.col("k") == F.col("a_k")) & (F.col("base") == F.col("a_base")) & (F.col("grp") == F.col("a_grp")), "left_semi")

    state = cut_lineage(asked(state), "line-lengths")
    j = max(levels) // 2
    while j >= 1:
        behind = levels[j].select(F.col("doc_id").alias("n_doc"), F.col("tkey").alias("n_key"), F.col("s").alias("n_s"), F.col("r").alias("n_r"))
        open_ = state.filter(F.col("k") > j)
        x = open_.join(behind, F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("tkey") == F.col("n_key")) & (
            F.col("s") + F.col("base") == F.col("n_s"))).select(*state.columns, "n_r")
        x = cut_lineage(x, "line-behind")
        longer = x.groupBy("k", "base", "grp", "n_r").agg(
            F.min(_start()).alias("first"), F.max(F.when(F.col("ask"), _start())).alias("last")).filter(F.col("last") > F.col("first"))
        longer = longer.select(*[F.col(c).alias(f"g_{c}") for c in ("k", "base", "grp", "n_r", "first")])
        same = (F.col("k") == F.col("g_k")) & (F.col("base") == F.col("g_base")) & (F.col("grp") == F.col("g_grp")) & (
            F.col("n_r") == F.col("g_n_r"))
        grown = x.join(longer, same).select(
            "k", (F.col("base") + j).alias("base"), F.xxhash64("grp", "base", "n_r").alias("grp"), "doc_id", "tkey", "s",
            (F.col("ask") & ~F.col("g_first").eqNullSafe(_start())).alias("ask"))
        grown = cut_lineage(grown, "line-grown")
        done = grown.filter("ask").select(F.col("k").alias("d_k"), (F.col("base") - j).alias("d_base"), F.col("doc_id").alias("d_doc"),
                                          F.col("tkey").alias("d_key"), F.col("s").alias("d_s")).withColumn("d", F.lit(True))
        rest = open_.join(done, (F.col("k") == F.col("d_k")) & (F.col("base") == F.col("d_base")) & F.col("doc_id").eqNullSafe(F.col("d_doc"))
                          & (F.col("tkey") == F.col("d_key")) & (F.col("s") == F.col("d_s")), "left").select(
            *[c for c in state.columns if c != "ask"], (F.col("ask") & F.col("d").isNull()).alias("ask"))
        state = cut_lineage(state.filter(F.col("k") <= j).unionByName(asked(rest.unionByName(grown))), "line-lengths")
        j //= 2
    exact = state.filter("ask").groupBy("doc_id", "tkey").agg(F.max("base").alias("longest"))
    return short.unionByName(exact)


def later_copies(lines: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, exact: bool = True) -> DataFrame:
    """(doc_id, tkey, gone, longest) for documents that hold a later copy:
    the places of the lines to delete, and the lines of the longest run that
    is a later copy (not ``exact``: its largest power of two)."""
    found, levels = None, {}
    for k, t in repeated_suffixes(lines):
        levels[k] = t
        later = t.filter("later")
        if k == 1 and min_lines > 1:
            gone = F.when(F.col("w") >= min_words, F.array("s"))
        elif k == min_lines:
            gone = F.sequence(F.col("s"), F.col("s") + (k - 1))
        else:
            gone = F.lit(None).cast("array<int>")
        part = later.select("doc_id", "tkey", F.lit(k).alias("k"), gone.alias("gone"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return lines.limit(0).select("doc_id", "tkey", F.array("s").alias("gone"), F.lit(0).alias("longest"))
    gone = found.groupBy("doc_id", "tkey").agg(
        F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.max("k").alias("longest"))
    if not exact:
        return gone
    gone = cut_lineage(gone, "line-gone")
    long = longest_copies(levels, gone.select("doc_id", "tkey", F.col("longest").alias("top"))).select(
        F.col("doc_id").alias("l_doc"), F.col("tkey").alias("l_key"), F.col("longest").alias("l_longest"))
    return gone.join(long, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("tkey") == F.col("l_key"))).select(
        "doc_id", "tkey", "gone", F.col("l_longest").alias("longest"))


def delete_later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, exact: bool = True) -> DataFrame:
    """``docs`` (any columns, among them doc_id and text) with later copies
    cut out of ``text``, and the new struct column ``line_dedup`` (n_lines,
    n_removed, longest).  Store the result before filtering on its new
    columns: a filter pushed down would compute them per line."""
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    docs = docs.drop("line_dedup")
    lines = cut_lineage(line_table(docs, min_words > 1), "lines")
    gone = cut_lineage(later_copies(lines, min_lines, min_words, exact), "line-copies").select(
        F.col("doc_id").alias("_g_doc"), F.col("tkey").alias("_g_key"), F.struct("gone", "longest").alias("_g"))
    others = [c for c in docs.columns if c != "text"]
    d = docs.select(F.struct(*[docs[c] for c in others]).alias("_row"), docs["text"].alias("_text"),
                    docs["doc_id"].alias("_d_doc"), text_key(text_of(docs["text"])).alias("_d_key"))
    j = d.join(gone, F.col("_d_doc").eqNullSafe(F.col("_g_doc")) & (F.col("_d_key") == F.col("_g_key")), "left")
    j = j.select("_row", "_text", "_g", F.split(text_of(F.col("_text")), "\n").alias("_lines"))
    # places among all lines of the lines that hold a word
    j = j.select("_row", "_text", "_g", "_lines", F.filter(
        F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: _has_word(F.get("_lines", i))).alias("_places"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1),
                          F.transform("_g.gone", lambda s: F.get("_places", s)))
    text = F.when(F.size("_g.gone") > 0, F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
                  ).otherwise(F.col("_text"))
    stats = F.struct(F.size("_places").cast("long").alias("n_lines"),
                     F.coalesce(F.greatest(F.size("_g.gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
                     F.coalesce("_g.longest", F.lit(0)).cast("long").alias("longest"))
    out = j.select("_row", text.alias("_text"), stats.alias("_stats"))
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c)
                        for c in docs.columns], F.col("_stats").alias("line_dedup"))


def op2_line_dedup(spark, sf_dir):
    """op2: per document the lines with a word, how many are deleted as later
    copies, the lines of the longest run that is a later copy, and the hash of
    the kept text (null read as empty)."""
    d = delete_later_copies(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed",
                    F.col("line_dedup.longest").alias("longest_copy"),
                    F.sha2(text_of(F.col("text")).cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l0 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
l AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s, md5(line) AS h
  FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
gone AS (
  SELECT doc_id, s FROM (SELECT *, min((doc_id, s)) OVER (PARTITION BY h) AS first FROM l) x WHERE first < (doc_id, s)),
-- lines with an equal line earlier, by the distance of the two: neighbours of
-- one distance are runs
pairs AS (
  SELECT b.doc_id, a.doc_id AS other, b.s - a.s AS off, b.s FROM l a JOIN l b ON a.h = b.h AND (a.doc_id, a.s) < (b.doc_id, b.s)),
runs AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT *, s - row_number() OVER (PARTITION BY doc_id, other, off ORDER BY s) AS island FROM pairs) x
  GROUP BY doc_id, other, off, island),
kept AS (
  SELECT l0.doc_id, string_agg(l0.line, chr(10) ORDER BY l0.i) AS text
  FROM l0 LEFT JOIN l ON l.doc_id = l0.doc_id AND l.i = l0.i
  LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.s = l.s WHERE g.s IS NULL GROUP BY l0.doc_id)
SELECT d.doc_id, CAST(coalesce(a.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(b.n, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(c.k, 0) AS BIGINT) AS longest_copy, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) n FROM l GROUP BY 1) a USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) n FROM gone GROUP BY 1) b USING (doc_id)
LEFT JOIN (SELECT doc_id, max(n) k FROM runs GROUP BY 1) c USING (doc_id)
LEFT JOIN kept USING (doc_id)
"""
