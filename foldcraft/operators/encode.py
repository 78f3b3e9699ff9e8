"""Target encoding: smoothed, per-fold, nested out-of-fold, statistics,
auto-smoothed, pair encodings, one-hot.

Plan shape (all variants):

* rows are unpivoted to (col, value, scope..., y) and aggregated once to
  (col, value, scope...) -> (n, s).  Partial aggregation happens map-side,
  so a hot category collapses before the exchange;
* "every fold but f" is a subtraction from the totals, never a re-scan;
  all folds' fit tables come from that single aggregate;
* the fit tables are (categories x folds); they are applied to the rows with
  one left join per encoded column, whose strategy follows from the stored
  table's size at run time.

Encodings are functions of (n, s, prior, prior variance), so a 0/1 label's
std / min / max need no second pass.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .folds import nested_folds

EncFn = Callable[[Column, Column, Column, Column], Column]


# ---------------------------------------------------------------- encoders

def smoothed(m: float) -> EncFn:
    """(s + m * prior) / (n + m); with m = 0 and n = 0 -> prior."""
    def f(n, s, prior, var):
        if m == 0:
            return F.when(n > 0, s / n).otherwise(prior)
        return (s + F.lit(float(m)) * prior) / (n + F.lit(float(m)))
    return f


def raw_mean(default: float = 0.5) -> EncFn:
    """Unsmoothed mean, unseen -> default."""
    def f(n, s, prior, var):
        return F.when(n > 0, s / n).otherwise(F.lit(default))
    return f


def label_std(n, s, prior, var):
    """I5 std (ddof=1) of a 0/1 label from (n, s); n < 2 -> 0."""
    p = s / n
    return F.when(n > 1, F.sqrt(n / (n - 1) * p * (1 - p))).otherwise(F.lit(0.0))


def label_min(n, s, prior, var):
    return F.when(n > 0, F.when(s == n, 1.0).otherwise(0.0)).otherwise(F.lit(0.0))


def label_max(n, s, prior, var):
    return F.when(n > 0, F.when(s > 0, 1.0).otherwise(0.0)).otherwise(F.lit(0.0))


def auto_smoothed(n, s, prior, var):
    """Empirical-Bayes shrinkage (Micci-Barreca 2001):
    lambda = n*tau2 / (n*tau2 + sigma_i^2), tau2 = label variance of the fit
    set, sigma_i^2 = within-category (population) variance; enc =
    lambda*mean_i + (1-lambda)*prior; undefined lambda or n = 0 -> prior."""
    p = s / n
    sig2 = p * (1 - p)
    den = n * var + sig2
    lam = n * var / den
    return F.when((n > 0) & (den != 0), lam * p + (1 - lam) * prior).otherwise(prior)


# ------------------------------------------------------------ aggregation

def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Wide categoricals -> (keep..., col, value) rows; one shuffle then
    serves every column."""
    arr = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
                    for c in cols])
    return df.select(*keep, F.explode(arr).alias("_kv")).select(
        *keep, "_kv.col", "_kv.value")


def label_stats(df: DataFrame, cols: Sequence[str], scope: Sequence[str],
                label: str = "y") -> DataFrame:
    """(col, value, scope...) -> n, s over the rows of ``df``."""
    long = unpivot(df, cols, [*scope, label])
    return long.groupBy("col", "value", *scope).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(F.col(label)).cast("double").alias("s"))


def exclude_each(stats: DataFrame, keys: Sequence[str], fold: str,
                 folds: Sequence[int]) -> DataFrame:
    """For every f in ``folds``: totals over ``fold`` minus the rows of
    fold f, per ``keys``.  Rows whose ``fold`` is outside ``folds`` (e.g.
    pseudo rows, fold = -1) stay in every fit set."""
    keys = list(keys)
    tot = stats.groupBy(*keys).agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    fl = stats.sparkSession.createDataFrame([(int(f),) for f in folds], [fold])
    grid = tot.crossJoin(F.broadcast(fl))  # k-row side, fixed size
    own = stats.select(*[F.col(c).alias(f"_x_{c}") for c in [*keys, fold]], "n", "s")
    on = F.col(fold) == F.col(f"_x_{fold}")
    for c in keys:  # a null category has an own fold to leave out, too
        on = on & F.col(c).eqNullSafe(F.col(f"_x_{c}"))
    j = grid.join(own, on, "left")
    return j.select(*keys, fold,
                    (F.col("tn") - F.coalesce(F.col("n"), F.lit(0.0))).alias("n"),
                    (F.col("ts") - F.coalesce(F.col("s"), F.lit(0.0))).alias("s"))


def prior_table(labels: DataFrame, scope_keys: Sequence[str], label: str = "y") -> DataFrame:
    """(scope) -> prior mean and population variance of the fit set."""
    return labels.groupBy(*scope_keys).agg(
        (F.sum(label) / F.count(F.lit(1))).alias("prior"),
        F.var_pop(F.col(label).cast("double")).alias("pvar"))


def _apply(rows: DataFrame, table: DataFrame, cols: Sequence[str], keys: Sequence[str],
           outputs: dict[str, EncFn], prefix_fmt: str, defaults: dict[str, Column]) -> DataFrame:
    """Left-join every encoded column's fit table onto the rows.

    ``table`` is (keys..., col, value, n, s, prior, pvar).  The encodings
    are materialised once (they feed one join per column); each join's
    strategy follows from the size of its column's part at run time.
    """
    enc = table.select(*keys, "col", "value",
                       *[fn(F.col("n"), F.col("s"), F.col("prior"), F.col("pvar")).alias(name)
                         for name, fn in outputs.items()])
    enc = cut_lineage(enc, "encodings")
    vkey = {c: f"_v{i}" for i, c in enumerate(cols)}
    out = rows.select("*", *[F.col(c).cast("string").alias(vkey[c]) for c in cols])
    names = {}
    for c in cols:
        t = enc.filter(F.col("col") == c).select(
            *keys, F.col("value").alias(vkey[c]),
            *[F.col(nm).alias(f"_e_{vkey[c]}_{nm}") for nm in outputs])
        out = out.join(t, on=[*keys, vkey[c]], how="left")
        for nm in outputs:
            names[prefix_fmt.format(col=c, stat=nm)] = F.coalesce(F.col(f"_e_{vkey[c]}_{nm}"), defaults[nm])
    return out.select(*rows.columns, *[e.alias(n) for n, e in names.items()])


# -------------------------------------------------------------- operators

def encode_full(fit: DataFrame, rows: DataFrame, cols: Sequence[str],
                outputs: dict[str, EncFn], prefix_fmt: str = "te_{col}",
                label: str = "y", unseen: float | None = None) -> DataFrame:
    """Fit on all of ``fit`` and apply to ``rows``; unseen
    values get the prior (or ``unseen``)."""
    st = label_stats(fit, cols, [], label).withColumn("_one", F.lit(1))
    pr = prior_table(fit.withColumn("_one", F.lit(1)), ["_one"], label)
    table = st.join(F.broadcast(pr), "_one")  # one-row side
    r = rows.withColumn("_one", F.lit(1)).join(
        F.broadcast(pr.select("_one", F.col("prior").alias("_prior"))), "_one")
    dflt = F.lit(float(unseen)) if unseen is not None else F.col("_prior")
    return _apply(r, table, cols, ["_one"], outputs, prefix_fmt,
                  {k: dflt for k in outputs}).drop("_one", "_prior")


def encode_per_fold(train: DataFrame, test: DataFrame, cols: Sequence[str], k: int,
                    outputs: dict[str, EncFn], prior_scope: str = "fold",
                    prefix_fmt: str = "te_{col}", label: str = "y",
                    extra_fit: DataFrame | None = None, joined: DataFrame | None = None) -> DataFrame:
    """For each fold f fit on train rows with fold != f (plus
    ``extra_fit`` rows, e.g. pseudo labels, in every fold) and apply to the
    fold's training rows (part='fit', they see their own label), its
    validation rows (part='valid') and the test rows (part='test').

    ``prior_scope``: 'fold' = mean of the fold's fit labels (I2);
    'global' = mean over all train labels (I4).
    ``joined``: further columns by id (the label, if wanted, is one of them),
    joined to the rows before these are repeated per fold.
    Output: (fold, id, part, encoded columns...).
    """
    train = cut_lineage(train.select("id", label, "fold", *cols), "folds")
    test = test.select("id", *cols)
    fit_rows = train if extra_fit is None else train.unionByName(
        extra_fit.select(*train.columns))
    st = label_stats(fit_rows, cols, ["fold"], label)
    table = exclude_each(st, ["col", "value"], "fold", range(k))
    lab = fit_rows.groupBy("fold").agg(F.count(F.lit(1)).cast("double").alias("n"),
                                       F.sum(label).cast("double").alias("s"))
    lab = lab.withColumn("col", F.lit("_")).withColumn("value", F.lit("_"))
    pr = exclude_each(lab, ["col", "value"], "fold", range(k))
    if prior_scope == "global":
        tot = fit_rows.agg((F.sum(label) / F.count(F.lit(1))).alias("g"),
                           F.var_pop(F.col(label).cast("double")).alias("gv"))
        pr = pr.crossJoin(F.broadcast(tot)).select(
            "fold", F.col("g").alias("prior"), F.col("gv").alias("pvar"))
    else:
        pr = pr.select("fold", (F.col("s") / F.col("n")).alias("prior"),
                       (F.col("s") / F.col("n") * (1 - F.col("s") / F.col("n"))).alias("pvar"))
    table = table.join(F.broadcast(pr), "fold")  # k rows
    folds = train.sparkSession.createDataFrame([(i,) for i in range(k)], ["_f"])
    rows = train.withColumn("_test", F.lit(False)).unionByName(test.withColumn("_test", F.lit(True)), allowMissingColumns=True)
    if joined is not None:
        rows = rows.drop(label).join(joined, "id")
    part = F.when(F.col("_test"), "test").when(F.col("fold") == F.col("_f"), "valid").otherwise("fit")
    rows = rows.crossJoin(F.broadcast(folds)).withColumn("part", part).drop("fold", "_test").withColumnRenamed("_f", "fold")
    rows = rows.join(F.broadcast(pr.select("fold", F.col("prior").alias("_prior"))), "fold")
    out = _apply(rows, table, cols, ["fold"], outputs, prefix_fmt,
                 {k_: F.col("_prior") for k_ in outputs})
    return out.drop("_prior")


def encode_nested(train: DataFrame, test: DataFrame, cols: Sequence[str], k_outer: int,
                  k_inner: int, outputs: dict[str, EncFn], seed: int = 42,
                  prior_scope: str = "outer", prefix_fmt: str = "te_{col}",
                  label: str = "y", defaults: dict[str, float] | None = None,
                  nested: DataFrame | None = None, computed: dict[str, Column] | None = None) -> DataFrame:
    """Nested out-of-fold encoding.

    Outer-train rows (fold != outer) are encoded from the other inner folds
    of the outer-train set (no row sees its own label); validation and test
    rows are encoded from the whole outer-train set.  ``train`` must carry
    ``fold``.  ``prior_scope``: 'outer' = outer-train mean for every fit set
    (fixed prior), 'fit' = mean / variance of the actual fit set (sklearn's
    cross-fitting).  ``nested``: precomputed ``nested_folds(...,
    keep_own=True)`` rows (folds held fixed).  ``computed``: those of ``cols``
    that are expressions of other columns of the rows; they are made where they
    are read, so that the exchanges carry the columns they need and not them.
    Output (ofold, id, part, encoded...).
    """
    # The fold-assigned rows feed the aggregate, the label priors and the
    # rows to encode: cut their lineage once (reliable checkpoint in the
    # shared folder) instead of recomputing the fixture join per branch.
    # Outer-train rows get inner folds, the outer fold's own rows are its
    # validation part: one exploded frame, materialised once (it feeds the
    # aggregate, the label priors and the rows to encode).
    computed = computed or {}
    carried = [c for c in train.columns if c not in ("id", label, "fold", *computed)] if computed else list(cols)
    made = [computed[c].alias(c) for c in cols if c in computed]
    train = train.select("id", label, "fold", *carried)
    given = [c for c in cols if c not in computed]
    test = test.select("id", *given, *made)
    if nested is None:
        nested = nested_folds(train, k_outer, k_inner, seed, label, keep_own=True)
    allrows = cut_lineage(nested.select("id", label, "fold", *carried, "ofold", "ifold"), "nested")
    allrows = allrows.select("id", label, "fold", *given, *made, "ofold", "ifold")
    nf = allrows.filter(F.col("ifold") >= 0)
    st = label_stats(nf, cols, ["ofold", "ifold"], label)
    inner_fit = exclude_each(st, ["col", "value", "ofold"], "ifold", range(k_inner))
    outer_full = (st.groupBy("col", "value", "ofold")
                  .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
                  .withColumn("ifold", F.lit(-1)))
    table = inner_fit.unionByName(outer_full)

    lab = nf.groupBy("ofold", "ifold").agg(F.count(F.lit(1)).cast("double").alias("n"),
                                           F.sum(label).cast("double").alias("s"))
    lab = lab.withColumn("col", F.lit("_")).withColumn("value", F.lit("_"))
    lab_fit = exclude_each(lab, ["col", "value", "ofold"], "ifold", range(k_inner))
    lab_out = (lab.groupBy("col", "value", "ofold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
               .withColumn("ifold", F.lit(-1)))
    p = (F.col("s") / F.col("n"))
    pr = lab_fit.unionByName(lab_out).select("ofold", "ifold", p.alias("prior"),
                                             (p * (1 - p)).alias("pvar"))
    if prior_scope == "outer":
        po = pr.filter(F.col("ifold") == -1).select("ofold", F.col("prior").alias("_po"),
                                                    F.col("pvar").alias("_pv"))
        pr = pr.join(po, "ofold").select("ofold", "ifold", F.col("_po").alias("prior"),
                                         F.col("_pv").alias("pvar"))
    table = table.join(F.broadcast(pr), ["ofold", "ifold"])  # k_outer*(k_inner+1) rows

    fit_rows = nf.withColumn("part", F.lit("fit"))
    valid = allrows.filter(F.col("ifold") < 0).withColumn("part", F.lit("valid"))
    outers = train.sparkSession.createDataFrame([(i,) for i in range(k_outer)], ["ofold"])
    te = (test.crossJoin(F.broadcast(outers)).withColumn("ifold", F.lit(-1))
          .withColumn("part", F.lit("test")))
    rows = fit_rows.unionByName(valid, allowMissingColumns=True).unionByName(
        te, allowMissingColumns=True)
    rows = rows.join(F.broadcast(pr.select("ofold", "ifold", F.col("prior").alias("_prior"))),
                     ["ofold", "ifold"])
    dd = {nm: (F.lit(float(defaults[nm])) if defaults and nm in defaults else F.col("_prior"))
          for nm in outputs}
    out = _apply(rows, table, cols, ["ofold", "ifold"], outputs, prefix_fmt, dd)
    return out.drop("_prior")


def cross_columns(df: DataFrame, cols: Sequence[str], r: int = 2, sep: str = "___",
                  null_text: str = "nan") -> tuple[DataFrame, list[str]]:
    """Every r-combination of ``cols`` as a string key;
    null parts become the literal ``null_text`` (G20)."""
    names = []
    exprs = []
    for combo in combinations(cols, r):
        nm = sep.join(combo)
        names.append(nm)
        exprs.append(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(null_text))
                                        for c in combo]).alias(nm))
    return df.select("*", *exprs), names


def logit_powers(c: Column, eps: float = 1e-5) -> list[Column]:
    """Clip to [eps, 1-eps], z = ln(m / (1 - m)); z, z^2, z^3."""
    m = F.least(F.greatest(c, F.lit(eps)), F.lit(1 - eps))
    z = F.log(m / (1 - m))
    return [z, z * z, z * z * z]


#: cells (fit sets x pairs x code pairs) whose encodings are held by every
#: task as arrays: 24 bytes each
MAX_CELLS = 4_000_000

#: rows that are looked up and sent at a time: their values stay in a core's cache
LOOK_UP_ROWS = 2_000


def pair_logits(train: DataFrame, test: DataFrame, cols: Sequence[str], k_outer: int, k_inner: int, m: float = 20,
                seed: int = 42, label: str = "y", null_text: str = "nan", max_cells: int = MAX_CELLS,
                finish: Callable[[Column], Column] = lambda z: z) -> tuple[DataFrame, list[str]]:
    """I8 (+ E14, D12, D13): every pair of ``cols`` as one category, nested
    out-of-fold encoding smoothed by ``m``, its logit z, z^2 and z^3,
    standardised by mean and population deviation over each outer fold's
    training rows, then ``finish`` (rounding, say).  Returns (ofold, id, part,
    z1_a___b, z2_.., z3_..) and the names.

    * Levels are coded per column, once per row, before the rows are repeated
      per outer fold, and a row carries them as one number; a pair is the number
      code_a * n_b + code_b (its cell); (n, s) are counted per (outer, inner, pair, cell).
    * Encodings, powers, and their moments follow from that table: a training
      row's value depends on its cell and inner fold alone, so the mean over
      rows is a mean over cells weighted by n.  So does ``finish``, which works
      on cells, not on rows.  The rows are read twice, to count and to look up;
      nothing row-sized is stored beyond the folds.
    * The cells of all fit sets (at most ``max_cells``) are arrays: a task
      counts its rows into them, and a row takes its values by index from those
      that every task gets: no row per pair, no join and no shuffle.  With more
      cells, rows unfold to (row, pair), are grouped, meet the stored table
      once and fold up again.
    """
    names = [f"{a}___{b}" for a, b in combinations(cols, 2)]
    out = [f"z{p}_{n}" for n in names for p in (1, 2, 3)]
    text = [F.coalesce(F.col(c).cast("string"), F.lit(null_text)).alias(c) for c in cols]
    train = cut_lineage(train.select("id", label, "fold", *text), "pair-train")
    # levels of the training rows; unseen ones get a code of their own
    codes = [f"_k{i}" for i in range(len(cols))]
    indexer = StringIndexer(inputCols=list(cols), outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    sizes = [len(levels) + 1 for levels in indexer.labelsArray]
    packs, radix = [[]], 1  # a row's codes are the digits of as few numbers as hold them
    for i, size in enumerate(sizes):
        if radix * size > 2 ** 62:
            packs.append([])
            radix = 1
        packs[-1].append((i, radix))
        radix *= size
    packed = [f"_p{j}" for j in range(len(packs))]
    number = [reduce(lambda x, y: x + y, [F.col(codes[i]).cast("long") * r for i, r in own]).alias(p) for p, own in zip(packed, packs)]
    coded_train = indexer.transform(train).select("id", label, "fold", *number)
    rows = nested_folds(coded_train, k_outer, k_inner, seed, label, keep_own=True)
    rows = cut_lineage(rows.select("id", F.col(label).cast("double").alias("_y"), "ofold", "ifold", *packed), "nested")
    pairs = list(combinations(range(len(cols)), 2))
    starts, n_cells = [], 0
    for a, b in pairs:
        starts.append(n_cells)
        n_cells += sizes[a] * sizes[b]
    n_sets = k_outer * (k_inner + 1)
    outers = train.sparkSession.createDataFrame([(i,) for i in range(k_outer)], ["ofold"])
    test = indexer.transform(test.select("id", *text)).select("id", *number)
    test = test.crossJoin(F.broadcast(outers)).withColumn("ifold", F.lit(-1))  # k_outer rows
    part = F.when(F.col("ifold") >= 0, "fit").otherwise("valid")
    every = rows.withColumn("part", part).unionByName(test.withColumn("part", F.lit("test")), allowMissingColumns=True)

    def cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Per row, the first cell of its fit set; per pair and row, the cell
        among the fit set's."""
        k = np.empty((len(codes), batch.num_rows), np.int64)
        for p, own in zip(packed, packs):
            rest = batch.column(p).to_numpy()
            for i, _ in own:
                above = rest // sizes[i]
                k[i], rest = rest - above * sizes[i], above
        sets = batch.column("ofold").to_numpy().astype(np.int64) * (k_inner + 1) + batch.column("ifold").to_numpy() + 1
        return sets * n_cells, np.array([k[a] * sizes[b] + k[b] + s for (a, b), s in zip(pairs, starts)])

    by_index = n_cells * n_sets <= max_cells
    code = {i: F.expr(f"{p} div {r} % {sizes[i]}") for p, own in zip(packed, packs) for i, r in own}
    unfolded = F.array(*[(code[a] * sizes[b] + code[b] + s).cast("int") for (a, b), s in zip(pairs, starts)])
    fit_rows = rows.filter("ifold >= 0")
    if by_index:
        st = _count_in_arrays(fit_rows, cells, packed, n_cells, n_sets, k_inner)
    else:
        st = fit_rows.select("ofold", "ifold", "_y", F.explode(unfolded).alias("cell")).groupBy("ofold", "ifold", "cell").agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("s"))
    st = cut_lineage(st, "pair-counts")
    total = st.groupBy("ofold", "cell").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    inner = st.join(total, ["ofold", "cell"]).select("ofold", "ifold", "cell", "n", (F.col("tn") - F.col("n")).alias("fn"),
                                                     (F.col("ts") - F.col("s")).alias("fs"))
    # inner folds without a row in the cell: the fit set has the whole of it
    folds = train.sparkSession.createDataFrame([(i,) for i in range(-1, k_inner)], ["ifold"])
    grid = total.crossJoin(F.broadcast(folds))  # k_inner + 1 rows
    prior = rows.filter("ifold >= 0").groupBy(F.col("ofold").alias("p_ofold")).agg(
        F.avg("_y").alias("prior"), F.count(F.lit(1)).cast("double").alias("rows"))
    own = inner.select(*[F.col(c).alias(f"o_{c}") for c in inner.columns])
    t = grid.join(own, (F.col("ofold") == F.col("o_ofold")) & (F.col("ifold") == F.col("o_ifold")) & (F.col("cell") == F.col("o_cell")), "left")
    t = t.join(F.broadcast(prior), F.col("ofold") == F.col("p_ofold"))  # a row per outer fold
    enc = (F.coalesce("o_fs", "ts") + F.lit(float(m)) * F.col("prior")) / (F.coalesce("o_fn", "tn") + F.lit(float(m)))
    z = [x.alias(f"z{p}") for p, x in enumerate(logit_powers(enc), 1)]
    at = F.array_max(F.filter(F.array(*[F.lit(s) for s in starts]), lambda x: x <= F.col("cell")))
    t = cut_lineage(t.select("ofold", "ifold", "cell", at.alias("start"), F.coalesce("o_n", F.lit(0.0)).alias("n"), "rows", "prior", *z), "pair-cells")
    mean = t.groupBy("ofold", "start").agg(*[(F.sum(F.col("n") * F.col(f"z{p}")) / F.max("rows")).alias(f"mu{p}") for p in (1, 2, 3)])
    mean = mean.select(F.col("ofold").alias("m_ofold"), F.col("start").alias("m_start"), "mu1", "mu2", "mu3")
    joined = t.join(mean, (F.col("ofold") == F.col("m_ofold")) & (F.col("start") == F.col("m_start")))
    dev = joined.groupBy("ofold", "start").agg(*[F.sqrt(F.sum(F.col("n") * (F.col(f"z{p}") - F.col(f"mu{p}")) ** 2) / F.max("rows"))
                                                 .alias(f"d{p}") for p in (1, 2, 3)],
                                               *[F.max(f"mu{p}").alias(f"mu{p}") for p in (1, 2, 3)], F.max("prior").alias("prior"))
    scale = {p: F.when(F.col(f"d{p}") == 0, F.lit(1.0)).otherwise(F.col(f"d{p}")) for p in (1, 2, 3)}
    dev = cut_lineage(dev.select("ofold", "start", *[F.col(f"mu{p}") for p in (1, 2, 3)], *[scale[p].alias(f"d{p}") for p in (1, 2, 3)],
                                 *[x.alias(f"u{p}") for p, x in enumerate(logit_powers(F.col("prior")), 1)]), "pair-moments")
    by = dev.select(F.col("ofold").alias("m_ofold"), F.col("start").alias("m_start"), "mu1", "mu2", "mu3", "d1", "d2", "d3")
    std = t.join(F.broadcast(by), (F.col("ofold") == F.col("m_ofold")) & (F.col("start") == F.col("m_start"))).select(  # pairs x k_outer rows
        "ofold", "ifold", "cell", "start", *[finish((F.col(f"z{p}") - F.col(f"mu{p}")) / F.col(f"d{p}")).alias(f"z{p}") for p in (1, 2, 3)])
    # a cell that the outer fold's training rows don't have: the prior
    unseen = dev.select("ofold", "start", *[finish((F.col(f"u{p}") - F.col(f"mu{p}")) / F.col(f"d{p}")).alias(f"z{p}") for p in (1, 2, 3)])
    if not by_index:
        long = every.select("ofold", "ifold", "id", "part", unfolded.alias("cells"))
        return _pairs_by_join(long, std, unseen, starts, names).select("ofold", "id", "part", *out), out
    return _pairs_by_index(every.select("ofold", "ifold", "id", "part", *packed), cells, std, unseen, starts, n_cells, k_inner, n_sets, out), out


def _count_in_arrays(fit_rows: DataFrame, cells: Callable, packed: Sequence[str], n_cells: int, n_sets: int, k_inner: int) -> DataFrame:
    """(ofold, ifold, cell, n, s): a task adds its rows up in arrays of all
    cells and returns those it has met; the tasks' sums are grouped."""
    def count(batches):
        n, s = np.zeros(n_sets * n_cells), np.zeros(n_sets * n_cells)
        held, size = [], 0

        def add():
            at = np.concatenate([k for k, _ in held])
            n[:] += np.bincount(at, minlength=len(n))
            s[:] += np.bincount(at, np.concatenate([y for _, y in held]), len(s))
            held.clear()

        for b in batches:
            first, cell = cells(b)
            held.append(((cell + first).ravel(), np.tile(b.column("_y").to_numpy(), len(cell))))
            size += cell.size
            if size >= len(n):  # adding costs a pass over the arrays
                add()
                size = 0
        if held:
            add()
        met = np.flatnonzero(n)
        sets, cell = met // n_cells, met % n_cells
        for i in range(0, len(met), 100_000):
            w = slice(i, i + 100_000)
            yield pa.RecordBatch.from_pydict({
                "ofold": (sets[w] // (k_inner + 1)).astype(np.int32), "ifold": (sets[w] % (k_inner + 1) - 1).astype(np.int32),
                "cell": cell[w].astype(np.int32), "n": n[met[w]], "s": s[met[w]]})

    some = fit_rows.select("ofold", "ifold", "_y", *packed).mapInArrow(count, "ofold int, ifold int, cell int, n double, s double")
    return some.groupBy("ofold", "ifold", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _pairs_by_index(coded: DataFrame, cells: Callable, std: DataFrame, unseen: DataFrame, starts: list[int], n_cells: int, k_inner: int,
                    n_sets: int, out: list[str]) -> DataFrame:
    """Looks rows' cells up in arrays that every task holds."""
    values = np.empty((n_sets, n_cells, 3))
    place = {s: i for i, s in enumerate(starts)}
    ends = [*starts[1:], n_cells]
    for r in unseen.toPandas().itertuples():  # a row per outer fold and pair
        i = place[r.start]
        values[r.ofold * (k_inner + 1):(r.ofold + 1) * (k_inner + 1), starts[i]:ends[i]] = (r.z1, r.z2, r.z3)
    known = std.select("ofold", "ifold", "cell", "z1", "z2", "z3").toPandas()  # at most MAX_CELLS rows
    values[known.ofold * (k_inner + 1) + known.ifold + 1, known.cell] = known[["z1", "z2", "z3"]]
    shipped = coded.sparkSession.sparkContext.broadcast(np.ascontiguousarray(values.reshape(n_sets * n_cells, 3)))

    def look_up(batches):
        table = shipped.value
        for b in batches:
            first, cell = cells(b)
            cell += first
            for i in range(0, b.num_rows, LOOK_UP_ROWS):
                own = b.slice(i, LOOK_UP_ROWS)
                found = table.take(np.ascontiguousarray(cell[:, i:i + LOOK_UP_ROWS].T).ravel(), axis=0).ravel()
                ends = np.arange(0, found.size + 1, len(out), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("ofold", "id", "part")),
                                                  pa.ListArray.from_arrays(pa.array(ends), pa.array(found))], names=["ofold", "id", "part", "_z"])

    # a row comes back as one array: reading hundreds of columns of a batch, value by value, costs twice the time
    schema = coded.select("ofold", "id", "part").schema.add("_z", T.ArrayType(T.DoubleType(), False), False)
    return coded.mapInArrow(look_up, schema).selectExpr("ofold", "id", "part", *[f"_z[{i}] AS `{name}`" for i, name in enumerate(out)])


def _pairs_by_join(coded: DataFrame, std: DataFrame, unseen: DataFrame, starts: list[int], names: list[str]) -> DataFrame:
    """Joins the cells of all pairs in one go."""
    std = cut_lineage(std.drop("start"), "pair-values").toDF("v_ofold", "v_ifold", "v_cell", "z1", "z2", "z3")
    long = coded.select("ofold", "ifold", "id", "part", F.posexplode("cells").alias("pair", "cell"))
    j = long.join(std, (F.col("ofold") == F.col("v_ofold")) & (F.col("ifold") == F.col("v_ifold")) & (F.col("cell") == F.col("v_cell")), "left")
    number = F.array(*[F.lit(s) for s in starts])
    no = unseen.select(F.col("ofold").alias("n_ofold"), (F.array_position(number, F.col("start")) - 1).cast("int").alias("n_pair"),
                       *[F.col(f"z{p}").alias(f"n{p}") for p in (1, 2, 3)])
    j = j.join(F.broadcast(no), (F.col("ofold") == F.col("n_ofold")) & (F.col("pair") == F.col("n_pair")))  # k_outer x pairs rows
    return j.groupBy("ofold", "ifold", "id", "part").agg(*[
        F.max(F.when(F.col("pair") == i, F.coalesce(f"z{p}", f"n{p}"))).alias(f"z{p}_{n}") for i, n in enumerate(names) for p in (1, 2, 3)])


#: levels per column that one-hot columns are made for, without a list given
MAX_LEVELS = 1000


def one_hot(train: DataFrame, rows: DataFrame, cols: Sequence[str], prefix_sep: str = "_",
            levels: dict[str, Sequence[str]] | None = None, max_levels: int = MAX_LEVELS) -> DataFrame:
    """0/1 columns for the sorted train levels without the first;
    unseen levels get all zeros.  The ``levels`` name the columns; without
    them they are read from ``train``, at most ``max_levels`` a column (more
    are an error, none is left out)."""
    if levels is None:
        counts = train.agg(*[F.count_distinct(c).alias(c) for c in cols]).first()  # one row
        for c in cols:
            if counts[c] > max_levels:
                raise ValueError(f"{c} has {counts[c]} levels, more than {max_levels}: name those wanted")
        found = unpivot(train, cols, []).distinct().filter("value is not null").collect()  # bounded by max_levels
        levels = {c: [r["value"] for r in found if r["col"] == c] for c in cols}
    exprs = []
    for c in cols:
        for v in sorted(levels[c])[1:]:
            exprs.append(F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
                         .alias(f"{c}{prefix_sep}{v}"))
    return rows.select("*", *exprs)
