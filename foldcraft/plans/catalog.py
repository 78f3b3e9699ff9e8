"""Registered queries: one Spark plan per operator, each paired (where SQL
can express it) with an independent SQL text for the DuckDB oracle.

Every query reads the driver's tables through the ``accounts`` / ``scored``
fixtures, so its work grows with them.  Doubles are rounded to 6 decimals
and integers cast to BIGINT in both the Spark and the SQL result.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..oracle_sql import with_base
from ..operators import encode as E
from ..operators import folds as K
from ..session import cut_lineage, round6, round6_sql
from ..functions import scalar as S
from ..sources import tables as T

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def L(c):  # bigint output
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


def R(c):  # rounded double output
    if isinstance(c, str):  # one parsed expression instead of a chain of column calls
        return F.expr(round6_sql(f"CAST(`{c}` AS DOUBLE)"))
    return round6(c)


TE_COLS = ["pri_u", "seg", "nation", "region", "svc_return"]
SEED = 42
K_OUTER = 5
K_INNER = 5


NGRAM_BASE = ["pri", "seg", "region", "svc_return"]
PAIR_BASE = ["pri_u", "seg", "nation", "region", "svc_return", "svc_open"]
NGRAM_FEATS = [f for r, b in ((2, NGRAM_BASE), (3, NGRAM_BASE))
               for f in S.ngram_features(b, "___") if f.name.count("___") == r - 1]
PAIR_FEATS = [f for f in S.ngram_features(PAIR_BASE, "___") if f.name.count("___") == 1]
NGRAM_TE_COLS = [f.name for f in NGRAM_FEATS]
_EXTRA = list({f.name: f for f in NGRAM_FEATS + PAIR_FEATS}.values())
PAIR_COLS = [f.name for f in PAIR_FEATS]


def _te_frame(spark, sf, crosses: bool = False, more: tuple = ()):
    """id, role, y and the encoded columns, stored; ``crosses`` adds the
    n-grams' columns and the n-grams, ``more`` further columns."""
    wide = ["svc_open"] if crosses else []
    a = T.accounts_once(spark, sf, columns=list(dict.fromkeys(
        ["id", "role", "y", "pri", *[c for c in TE_COLS if c != "pri_u"], *wide, *more])))
    a = a.withColumn("pri_u", T.unseen_category())
    if not crosses:
        return a
    return a.select("*", *[f.col().alias(f.name) for f in _EXTRA])


def _train_folds(spark, sf, k=K_OUTER, crosses: bool = False):
    a = _te_frame(spark, sf, crosses)
    tr = a.filter(F.col("role") == "train")
    return K.stratified_folds(tr, k=k, seed=SEED), a.filter(F.col("role") == "test")


# SQL fragments --------------------------------------------------------------

def sql_md5(seed_expr: str, id_expr: str = "id") -> str:
    return f"md5(concat_ws(':', cast({seed_expr} as varchar), cast({id_expr} as varchar)))"


TE_BASE = ("te_base as (select *, " + ", ".join(f'{f.sql} as "{f.name}"' for f in _EXTRA)
           + " from (select id, role, y, case when role = 'test' and id % 97 = 0 then 'ZZZ' else pri end as pri_u,"
           " pri, seg, nation, region, svc_return, svc_open, s_a from scored))")

FOLDS_SQL = f"""folds as (select *, cast((row_number() over (partition by y order by {sql_md5("'42'")}) - 1) % 5 as int) as fold
  from te_base where role = 'train')"""

NESTED_SQL = f"""nested as (select o.ofold, f.*, cast((row_number() over (partition by o.ofold, f.y
  order by {sql_md5('42 + o.ofold', 'f.id')}) - 1) % 5 as int) as ifold
  from folds f cross join (select range as ofold from range(5)) o where f.fold <> o.ofold)"""


# ---------------------------------------------------------------- step 1

@query("union_roles", with_base("""
select cast(id as bigint) as id, role, cast(case when role = 'test' then -1 else y end as bigint) as y,
  pri, cast(tenure as bigint) as tenure, round(monthly, 6) as monthly
from accounts"""))
def q_union_roles(spark, sf):
    """Train (labelled) + test (unlabelled) + reference, one frame
    with a role column; split back is a filter on role."""
    a = T.accounts(spark, sf)
    train = a.filter(F.col("role") == "train")
    test = a.filter(F.col("role") == "test").drop("y")
    ref = a.filter(F.col("role") == "ref")
    u = train.unionByName(test, allowMissingColumns=True).unionByName(ref)
    # the unlabelled role carries no label: -1 marks it in the output
    return u.select(L("id").alias("id"), "role", L(F.coalesce("y", F.lit(-1))).alias("y"), "pri",
                    L("tenure").alias("tenure"), R("monthly").alias("monthly"))


@query("coerce_fill", with_base("""
, t as (select id, tenure, n_items,
  try_cast(case when id % 50 = 0 then ' ' else cast(monthly as varchar) end as double) as amt from accounts)
select cast(id as bigint) as id, cast(amt is null as bigint) as miss_amt,
  round(coalesce(amt, 0), 6) as amt_zero,
  round(coalesce(amt, (select median(amt) from t)), 6) as amt_median,
  round(coalesce(amt, cast(tenure * n_items as double)), 6) as amt_product,
  cast((select count(*) - count(amt) from t) as bigint) as n_missing
from t"""))
def q_coerce_fill(spark, sf):
    """Text -> number (bad text -> null), missing flag on the raw
    value, three fills (0, median, product), missing count."""
    a = T.accounts(spark, sf)
    t = a.select("id", "tenure", "n_items", T.text_amount().try_cast("double").alias("amt"))
    med = G.exact_quantiles(t, "amt", [0.5]).select(F.col("q").alias("med"))  # one row
    stats = t.agg((F.count(F.lit(1)) - F.count("amt")).alias("n_missing")).crossJoin(med)
    j = t.crossJoin(F.broadcast(stats))  # one-row side
    return j.select(
        L("id").alias("id"), L(F.col("amt").isNull()).alias("miss_amt"),
        R(F.coalesce("amt", F.lit(0.0))).alias("amt_zero"),
        R(F.coalesce("amt", "med")).alias("amt_median"),
        R(F.coalesce("amt", (F.col("tenure") * F.col("n_items")).cast("double"))).alias("amt_product"),
        L("n_missing").alias("n_missing"))


@query("clean_category", with_base("""
select cast(id as bigint) as id,
  coalesce(trim(case when id % 37 = 0 then null else concat(' ', pri, ' ') end), 'missing') as pri_clean,
  cast(coalesce(case trim(case when id % 41 = 0 then null when y = 1 then ' Yes ' else 'No ' end)
    when 'Yes' then 1 when 'No' then 0 end, 0) as bigint) as label,
  cast(tenure as varchar) as cat_tenure, cast(cast(total as decimal(18, 2)) as varchar) as cat_total
from accounts"""))
def q_clean_category(spark, sf):
    """C4 category clean (trim, null -> 'missing'); C5 tolerant Yes/No
    label; C7 number -> string category."""
    a = T.accounts(spark, sf)
    txt = F.when(F.col("id") % 41 == 0, F.lit(None).cast("string")).when(
        F.col("y") == 1, F.lit(" Yes ")).otherwise(F.lit("No "))
    lab = F.trim(txt)
    return a.select(
        L("id").alias("id"),
        F.coalesce(F.trim(T.padded_category()), F.lit("missing")).alias("pri_clean"),
        L(F.coalesce(F.when(lab == "Yes", 1).when(lab == "No", 0), F.lit(0))).alias("label"),
        F.col("tenure").cast("string").alias("cat_tenure"),  # C7: integer -> category text
        # An amount by its decimal digits, as the text of a double differs between engines
        F.col("total").cast("decimal(18, 2)").cast("string").alias("cat_total"))


# fixed values: ordinal codes of the fixture's priority and segment columns
PRI_ORDINAL = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}
SEG_ORDINAL = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3}


def _case_sql(col, mapping):
    return "case " + " ".join(f"when {col} = '{k}' then {v}" for k, v in mapping.items()) + " else 0 end"


@query("ordinal_map", with_base(f"""
select cast(id as bigint) as id,
  cast({_case_sql("case when role = 'test' and id % 97 = 0 then 'ZZZ' else pri end", PRI_ORDINAL)} as bigint) as pri_code,
  cast({_case_sql('seg', SEG_ORDINAL)} as bigint) as seg_code
from accounts"""))
def q_ordinal_map(spark, sf):
    """Ordinal code from a literal map, default 0 (unseen included)."""
    a = T.accounts(spark, sf).withColumn("pri_u", T.unseen_category())

    def code(c, mp):
        e = None
        for k, v in mp.items():
            e = (F.when(F.col(c) == k, v) if e is None else e.when(F.col(c) == k, v))
        return e.otherwise(0)
    return a.select(L("id").alias("id"), L(code("pri_u", PRI_ORDINAL)).alias("pri_code"),
                    L(code("seg", SEG_ORDINAL)).alias("seg_code"))


def _te_full_sql(cols, m, fit_filter="role = 'train'"):
    ctes = [TE_BASE, f"prior as (select avg(y) as p from te_base where {fit_filter})"]
    sel = []
    joins = []
    for i, c in enumerate(cols):
        ctes.append(f"e{i} as (select {c} as v, (sum(y) + {m} * (select p from prior)) / (count(*) + {m}) as e "
                    f"from te_base where {fit_filter} group by {c})")
        joins.append(f"left join e{i} on e{i}.v = b.{c}")
        sel.append(f"round(coalesce(e{i}.e, (select p from prior)), 6) as te_{c}")
    return with_base(f"select cast(b.id as bigint) as id, b.role, {', '.join(sel)}\nfrom te_base b "
                     + "\n".join(joins), ",\n".join(ctes))


@query("te_smoothed", _te_full_sql(TE_COLS, 10))
def q_te_smoothed(spark, sf):
    """Smoothed mean encoding (m=10) fitted on all train rows, applied to
    every row; unseen -> prior."""
    a = _te_frame(spark, sf)
    fit = a.filter(F.col("role") == "train")
    out = E.encode_full(fit, a, TE_COLS, {"te": E.smoothed(10)}, prefix_fmt="te_{col}")
    return out.select(L("id").alias("id"), "role", *[R(f"te_{c}").alias(f"te_{c}") for c in TE_COLS])


@query("te_whole_table", _te_full_sql(TE_COLS, 3, "role <> 'test'"))
def q_te_whole_table(spark, sf):
    """Whole-table (non-CV) encoding, m=3, fit on every labelled row."""
    a = _te_frame(spark, sf)
    fit = a.filter(F.col("role") != "test")
    out = E.encode_full(fit, a, TE_COLS, {"te": E.smoothed(3)}, prefix_fmt="te_{col}")
    return out.select(L("id").alias("id"), "role", *[R(f"te_{c}").alias(f"te_{c}") for c in TE_COLS])


# ---------------------------------------------------------------- step 2

@query("stratified_folds", with_base(
    "select cast(id as bigint) as id, cast(y as bigint) as y, cast(fold as bigint) as fold from folds",
    TE_BASE + ",\n" + FOLDS_SQL))
def q_stratified_folds(spark, sf):
    """K1: 5 stratified folds, seed 42."""
    f, _ = _train_folds(spark, sf)
    return f.select(L("id").alias("id"), L("y").alias("y"), L("fold").alias("fold"))


@query("nested_folds", with_base(
    "select cast(ofold as bigint) as ofold, cast(id as bigint) as id, cast(ifold as bigint) as ifold from nested",
    TE_BASE + ",\n" + FOLDS_SQL + ",\n" + NESTED_SQL))
def q_nested_folds(spark, sf):
    """K2: inner folds numbered within every outer-train set, seed 42+outer."""
    f, _ = _train_folds(spark, sf)
    n = K.nested_folds(f, K_OUTER, K_INNER, SEED)
    return n.select(L("ofold").alias("ofold"), L("id").alias("id"), L("ifold").alias("ifold"))


@query("holdout_split", with_base(f"""
select cast(id as bigint) as id,
  cast(row_number() over (partition by y order by {sql_md5("'42'")}) - 1
       < ceil(0.2 * count(*) over (partition by y)) as bigint) as strat_valid,
  cast(row_number() over (order by {sql_md5("'7'")}) - 1 < ceil(0.2 * count(*) over ()) as bigint) as plain_valid
from accounts where role = 'train'"""))
def q_holdout_split(spark, sf):
    """K3: stratified 80/20 hold-out and a plain 80/20 hold-out."""
    a = T.accounts(spark, sf).filter(F.col("role") == "train")
    s = K.stratified_holdout(a, 0.2, SEED).withColumnRenamed("is_valid", "strat_valid")
    p = K.plain_holdout(s, 0.2, 7).withColumnRenamed("is_valid", "plain_valid")
    return p.select(L("id").alias("id"), L("strat_valid").alias("strat_valid"),
                    L("plain_valid").alias("plain_valid"))


@query("majority_parts", with_base("""
select cast(id as bigint) as id, cast(ntile(5) over (order by id) as bigint) as part
from accounts where role = 'train' and y = 0"""))
def q_majority_parts(spark, sf):
    """K5: majority class split into 5 near-equal parts in id order."""
    a = T.accounts(spark, sf).filter((F.col("role") == "train") & (F.col("y") == 0))
    p = K.near_equal_parts(a, 5, "id")
    return p.select(L("id").alias("id"), L("part").alias("part"))


# ---------------------------------------------------------------- step 3

def _fold_fit_sql(cols, m, prior_global=False):
    """I2 / I4 oracle: per-fold fit (fold != f), applied to all train rows
    (fit / valid) and test rows, expressed with counts per (fold, value)."""
    ctes = [TE_BASE, FOLDS_SQL,
            "fl as (select range as f from range(5))",
            "lab as (select fl.f, sum(case when x.fold <> fl.f then x.y else 0 end) * 1.0e0 / "
            "sum(case when x.fold <> fl.f then 1 else 0 end) as p from folds x cross join fl group by fl.f)"]
    if prior_global:
        ctes[-1] = "lab as (select fl.f, (select avg(y) from folds) as p from fl)"
    rows = ("rows_ as (select fl.f, r.id, case when r.fold = fl.f then 'valid' else 'fit' end as part, "
            + ", ".join(f"r.{c}" for c in cols) + " from folds r cross join fl union all "
            "select fl.f, t.id, 'test' as part, " + ", ".join(f"t.{c}" for c in cols)
            + " from te_base t cross join fl where t.role = 'test')")
    ctes.append(rows)
    sel, joins = [], []
    for i, c in enumerate(cols):
        ctes.append(f"s{i} as (select fl.f, x.{c} as v, sum(case when x.fold <> fl.f then 1 else 0 end) as n, "
                    f"sum(case when x.fold <> fl.f then x.y else 0 end) as s from folds x cross join fl group by fl.f, x.{c})")
        joins.append(f"left join s{i} on s{i}.f = r.f and s{i}.v = r.{c}")
        sel.append(f"round(coalesce((s{i}.s + {m} * lab.p) / (s{i}.n + {m}), lab.p), 6) as te_{c}")
    body = (f"select cast(r.f as bigint) as fold, cast(r.id as bigint) as id, r.part, {', '.join(sel)}\n"
            "from rows_ r join lab on lab.f = r.f\n" + "\n".join(joins))
    return with_base(body, ",\n".join(ctes))


@query("te_fold_fit", _fold_fit_sql(TE_COLS, 10))
def q_te_fold_fit(spark, sf):
    """Per fold f fit on train rows of other folds (prior = their mean),
    applied to the fold's fit rows, validation rows and test rows."""
    tr, te = _train_folds(spark, sf)
    out = E.encode_per_fold(tr, te, TE_COLS, K_OUTER, {"te": E.smoothed(10)})
    return out.select(L("fold").alias("fold"), L("id").alias("id"), "part",
                      *[R(f"te_{c}").alias(f"te_{c}") for c in TE_COLS])


@query("te_global_prior", _fold_fit_sql(TE_COLS, 10, prior_global=True))
def q_te_global_prior(spark, sf):
    """I4: per-fold fit with the prior taken over all train labels."""
    tr, te = _train_folds(spark, sf)
    out = E.encode_per_fold(tr, te, TE_COLS, K_OUTER, {"te": E.smoothed(10)},
                            prior_scope="global")
    return out.select(L("fold").alias("fold"), L("id").alias("id"), "part",
                      *[R(f"te_{c}").alias(f"te_{c}") for c in TE_COLS])


def _nested_sql(cols, stat_exprs: dict[str, str], defaults: dict[str, str], prior_scope="outer",
                parts=False, fit_src="nested"):
    """Nested OOF oracle.  ``stat_exprs`` are SQL over n, s, p (prior), v
    (prior variance) of the fit set; ``defaults`` replace a missing match."""
    ctes = [TE_BASE, FOLDS_SQL, NESTED_SQL,
            "fi as (select o.ofold, i.ifold from (select range as ofold from range(5)) o, "
            "(select range as ifold from range(-1, 5)) i)",
            # fit-set label totals: ifold = -1 -> whole outer-train, else outer-train minus ifold
            "labs as (select fi.ofold, fi.ifold, count(*) as n, sum(x.y) as s from fi join nested x "
            "on x.ofold = fi.ofold and x.ifold <> fi.ifold group by fi.ofold, fi.ifold)"]
    if prior_scope == "outer":
        ctes.append("pr as (select l.ofold, l.ifold, cast(o.s as double) / o.n as p, (cast(o.s as double) / o.n) * (1 - cast(o.s as double) / o.n) as v "
                    "from labs l join labs o on o.ofold = l.ofold and o.ifold = -1)")
    else:
        ctes.append("pr as (select ofold, ifold, cast(s as double) / n as p, (cast(s as double) / n) * (1 - cast(s as double) / n) as v from labs)")
    qc = [f'"{c}"' for c in cols]
    cl = ", ".join(f"t.{c}" for c in qc)
    ctes.append("rows_ as (select ofold, ifold, id, 'fit' as part, " + ", ".join(qc) + " from nested "
                "union all select fold, -1, id, 'valid', " + ", ".join(qc) + " from folds "
                "union all select o.ofold, -1, t.id, 'test', " + cl +
                " from te_base t cross join (select range as ofold from range(5)) o where t.role = 'test')")
    sel, joins = [], []
    for i, c in enumerate(cols):
        ctes.append(f"s{i} as (select fi.ofold, fi.ifold, x.\"{c}\" as v, count(*) as n, sum(x.y) as s from fi "
                    f"join nested x on x.ofold = fi.ofold and x.ifold <> fi.ifold group by fi.ofold, fi.ifold, x.\"{c}\")")
        joins.append(f"left join s{i} on s{i}.ofold = r.ofold and s{i}.ifold = r.ifold and s{i}.v = r.\"{c}\"")
        for nm, ex in stat_exprs.items():
            e = (ex.replace("{n}", f"s{i}.n").replace("{s}", f"s{i}.s")
                 .replace("{p}", "pr.p").replace("{v}", "pr.v"))
            d = defaults[nm].replace("{p}", "pr.p")
            v = f"case when s{i}.n is null then {d} else {e} end"
            sel.append((f"{v}" if parts else f"round({v}, 6)") + f' as "{nm.format(col=c)}"')
    body = (f"select cast(r.ofold as bigint) as ofold, cast(r.id as bigint) as id, r.part, {', '.join(sel)}\n"
            "from rows_ r join pr on pr.ofold = r.ofold and pr.ifold = r.ifold\n" + "\n".join(joins))
    if parts:
        return ctes, body
    return with_base(body, ",\n".join(ctes))


def _nested_query(spark, sf, cols, outputs, prefix_fmt, defaults=None, prior_scope="outer", computed=None, base=()):
    """``computed``: the columns of ``cols`` made from those of ``base``."""
    tr, te = _train_folds(spark, sf)
    if computed:
        tr, te = tr.select("id", "y", "fold", *base), te.select("id", *base)
    out = E.encode_nested(tr, te, cols, K_OUTER, K_INNER, outputs, SEED,
                          prior_scope=prior_scope, prefix_fmt=prefix_fmt, defaults=defaults, computed=computed)
    names = [prefix_fmt.format(col=c, stat=nm) for c in cols for nm in outputs]
    return out.select(L("ofold").alias("ofold"), L("id").alias("id"), "part",
                      *[R(n).alias(n) for n in names])


@query("te_nested_oof", _nested_sql(TE_COLS, {"te_{col}": "({s} + 5 * {p}) / ({n} + 5)"},
                                    {"te_{col}": "{p}"}))
def q_te_nested_oof(spark, sf):
    """I3 (flagship): nested out-of-fold smoothed encoding, m=5: outer-train
    rows from the other inner folds, validation / test from the whole
    outer-train; prior = outer-train mean."""
    return _nested_query(spark, sf, TE_COLS, {"te": E.smoothed(5)}, "te_{col}")


@query("te_std_min_max", _nested_sql(
    TE_COLS,
    {"te1_{col}_std": "case when {n} > 1 then sqrt(cast({n} as double) / ({n} - 1) * (cast({s} as double) / {n}) * (1 - cast({s} as double) / {n})) else 0 end",
     "te1_{col}_min": "case when {s} = {n} then 1.0 else 0.0 end",
     "te1_{col}_max": "case when {s} > 0 then 1.0 else 0.0 end"},
    {"te1_{col}_std": "0", "te1_{col}_min": "0", "te1_{col}_max": "0"}))
def q_te_std_min_max(spark, sf):
    """Nested inner-fold label std (ddof=1) / min / max; unseen -> 0."""
    return _nested_query(spark, sf, TE_COLS,
                         {"std": E.label_std, "min": E.label_min, "max": E.label_max},
                         "te1_{col}_{stat}", defaults={"std": 0.0, "min": 0.0, "max": 0.0})


@query("te_auto_smooth", _nested_sql(
    TE_COLS,
    {"te_auto_{col}": "case when {n} * {v} + (cast({s} as double) / {n}) * (1 - cast({s} as double) / {n}) = 0 then {p} "
                      "else ({n} * {v} / ({n} * {v} + (cast({s} as double) / {n}) * (1 - cast({s} as double) / {n}))) "
                      "* (cast({s} as double) / {n}) + (1 - {n} * {v} / ({n} * {v} + (cast({s} as double) / {n}) "
                      "* (1 - cast({s} as double) / {n}))) * {p} end"},
    {"te_auto_{col}": "{p}"}, prior_scope="fit"))
def q_te_auto_smooth(spark, sf):
    """Empirical-Bayes auto smoothing, cross-fitted on the inner folds
    (prior and variance of each fit set), full outer-train for val/test."""
    return _nested_query(spark, sf, TE_COLS, {"auto": E.auto_smoothed}, "te_auto_{col}",
                         prior_scope="fit")


@query("te_ngram_mean", _nested_sql(NGRAM_TE_COLS, {"te_ng_{col}": "cast({s} as double) / {n}"},
                                    {"te_ng_{col}": "0.5"}))
def q_te_ngram_mean(spark, sf):
    """Unsmoothed nested inner-fold mean of n-gram crosses; unseen -> 0.5."""
    return _nested_query(spark, sf, NGRAM_TE_COLS, {"ng": E.raw_mean(0.5)}, "te_ng_{col}",
                         defaults={"ng": 0.5}, computed={f.name: f.col() for f in NGRAM_FEATS}, base=NGRAM_BASE)


def _pairs_logit_sql():
    ctes, body = _nested_sql(PAIR_COLS, {"te_{col}": "({s} + 20 * {p}) / ({n} + 20)"},
                             {"te_{col}": "{p}"}, parts=True)
    ctes = list(ctes) + [f"enc as ({body})"]
    zs = []
    for c in PAIR_COLS:
        m = f'least(greatest("te_{c}", 1e-5), 1 - 1e-5)'
        z = f"ln({m} / (1 - {m}))"
        zs += [f'{z} as "z1_{c}"', f'power({z}, 2) as "z2_{c}"', f'power({z}, 3) as "z3_{c}"']
    ctes.append("zz as (select ofold, id, part, " + ", ".join(zs) + " from enc)")
    names = [f"z{p}_{c}" for c in PAIR_COLS for p in (1, 2, 3)]
    st = ", ".join(f'avg("{n}") as "mu_{n}", stddev_pop("{n}") as "sd_{n}"' for n in names)
    ctes.append(f"st as (select ofold, {st} from zz where part = 'fit' group by ofold)")
    sel = ", ".join(f'round((zz."{n}" - st."mu_{n}") / case when st."sd_{n}" = 0 then 1 else st."sd_{n}" end, 6) as "{n}"'
                    for n in names)
    return with_base(f"select zz.ofold, zz.id, zz.part, {sel} from zz join st on st.ofold = zz.ofold",
                     ",\n".join(ctes))


@query("te_pairs_logit", _pairs_logit_sql())
def q_te_pairs_logit(spark, sf):
    """I8 (+E14, D12, D13): all 15 pairs of 6 categoricals, nested OOF
    encoding with m=20, logit and its square / cube, then standardised with
    mean / population std fitted on each outer fold's training rows."""
    tr, te = _train_folds(spark, sf, crosses=True)
    z, names = E.pair_logits(tr, te, PAIR_BASE, K_OUTER, K_INNER, 20, SEED, finish=R)  # rounds cells, not rows
    return z.select(L("ofold").alias("ofold"), L("id").alias("id"), "part", *names)


#: 15 categories: the wide ones, the services, and three small numbers
ALL_BASE = ["pri_u", "seg", "nation", "region", *T.SERVICES, "month", "year", "n_items"]
ALL_PAIRS = [(a, b) for i, a in enumerate(ALL_BASE) for b in ALL_BASE[i + 1:]]


def _all_pairs_sql():
    """105 pairs in long form: one aggregate, one join, one fold-up."""
    base = ("te_base as (select id, role, y, case when role = 'test' and id % 97 = 0 then 'ZZZ' else pri end as pri_u, seg, nation, region, "
            + ", ".join(T.SERVICES) + ", cast(((tenure % 12) + 12) % 12 as varchar) as month, cast(cast(floor(tenure / 12.0) as bigint) as varchar) as year, "
            "cast(n_items as varchar) as n_items from accounts)")
    keys = "[" + ", ".join(f"concat({a}, '___', {b})" for a, b in ALL_PAIRS) + "]"
    clip = "least(greatest(e, 1e-5), 1 - 1e-5)"
    ctes = [base, FOLDS_SQL, NESTED_SQL,
            f"rows_ as (select ofold, ifold, id, 'fit' as part, y, {keys} as ks from nested "
            f"union all select fold, -1, id, 'valid', y, {keys} from folds "
            f"union all select o, -1, id, 'test', null, {keys} from te_base, range(5) r(o) where role = 'test')",
            "long as (select ofold, ifold, id, part, y, unnest(ks) as v, unnest(range(1, 106)) as p from rows_)",
            "st as (select ofold, ifold, p, v, count(*) as n, sum(y) as s from long where part = 'fit' group by all)",
            "tot as (select ofold, p, v, sum(n) as n, sum(s) as s from st group by all)",
            "prior as (select ofold, avg(y) as q from nested group by ofold)",
            "enc as (select t.ofold, i.i as ifold, t.p, t.v, (t.s - coalesce(x.s, 0) + 20 * q) / (t.n - coalesce(x.n, 0) + 20) as e "
            "from tot t cross join range(-1, 5) i(i) join prior on prior.ofold = t.ofold "
            "left join st x on x.ofold = t.ofold and x.ifold = i.i and x.p = t.p and x.v = t.v)",
            f"zz as (select l.ofold, l.id, l.part, l.p, ln({clip} / (1 - {clip})) as z from (select l.*, coalesce(c.e, q) as e "
            "from long l join prior on prior.ofold = l.ofold left join enc c on c.ofold = l.ofold and c.ifold = l.ifold and c.p = l.p and c.v = l.v) l)",
            "mom as (select ofold, p, " + ", ".join(f"avg(power(z, {k})) as mu{k}, stddev_pop(power(z, {k})) as sd{k}" for k in (1, 2, 3))
            + " from zz where part = 'fit' group by ofold, p)",
            "std as (select zz.ofold, id, part, zz.p, " + ", ".join(
                f"(power(z, {k}) - mu{k}) / case when sd{k} = 0 then 1 else sd{k} end as z{k}" for k in (1, 2, 3))
            + " from zz join mom on mom.ofold = zz.ofold and mom.p = zz.p)"]
    sel = ", ".join(f'round(max(z{k}) filter (p = {i}), 6) as "z{k}_{a}___{b}"' for i, (a, b) in enumerate(ALL_PAIRS, 1) for k in (1, 2, 3))
    return with_base(f"select cast(ofold as bigint) as ofold, cast(id as bigint) as id, part, {sel} from std group by ofold, id, part", ",\n".join(ctes))


@query("te_all_pairs", _all_pairs_sql())
def q_te_all_pairs(spark, sf):
    """I8 (+E14, D12, D13) whole: all 105 pairs of 15 categories, three
    standardised powers of each pair's nested encoding: 315 columns."""
    a = T.accounts_once(spark, sf, columns=["id", "role", "y", "pri", "seg", "nation", "region", *T.SERVICES, "tenure", "n_items"])
    a = a.withColumns({"pri_u": T.unseen_category(), "month": F.pmod("tenure", F.lit(12)), "year": F.floor(F.col("tenure") / 12)})
    tr = K.stratified_folds(a.filter(F.col("role") == "train"), K_OUTER, SEED)
    z, names = E.pair_logits(tr, a.filter(F.col("role") == "test"), ALL_BASE, K_OUTER, K_INNER, 20, SEED, finish=R)
    return z.select(L("ofold").alias("ofold"), L("id").alias("id"), "part", *names)


PSEUDO_T = 0.95


def steep_sql(s: str) -> str:
    """A steeper fixed score, s^8 / (s^8 + (1 - s)^8): the stand-in is flat
    (.20 to .77), so that it never is confident.  The same multiplications in
    both engines."""
    def p8(x):
        p4 = f"(({x} * {x}) * ({x} * {x}))"
        return f"({p4} * {p4})"
    return f"({p8(s)} / ({p8(s)} + {p8(f'(1.0e0 - {s})')}))"


SP_SQL = steep_sql("s_a")


def _pseudo_fold_sql(cols, m):
    """I9 oracle: per-fold fit over (train rows of other folds + every pseudo
    row); pseudo rows are test rows with score p > t or < 1-t, label [p > .5]."""
    sql = _fold_fit_sql(cols, m)
    aug = (f"aug as (select * from folds union all by name select * replace (cast({SP_SQL} > 0.5 as int) as y), -1 as fold "
           f"from te_base where role = 'test' and ({SP_SQL} > {PSEUDO_T} or {SP_SQL} < 1 - {PSEUDO_T}))")
    sql = sql.replace("fl as (select range as f from range(5))", aug + ",\nfl as (select range as f from range(5))")
    return sql.replace("from folds x cross join fl", "from aug x cross join fl")


@query("te_pseudo_augmented", _pseudo_fold_sql(TE_COLS, 10))
def q_te_pseudo_augmented(spark, sf):
    """Per-fold encoding fitted on the fold's training rows plus all
    pseudo-labelled test rows (confident fixed score, t = .95)."""
    a = T.with_scores(_te_frame(spark, sf, more=("tenure",))).withColumn("s_p", F.expr(SP_SQL))
    tr = K.stratified_folds(a.filter(F.col("role") == "train"), k=K_OUTER, seed=SEED)
    te = a.filter(F.col("role") == "test")
    ps = K.pseudo_rows(te, "s_p", PSEUDO_T)
    out = E.encode_per_fold(tr, te, TE_COLS, K_OUTER, {"te": E.smoothed(10)}, extra_fit=ps)
    return out.select(L("fold").alias("fold"), L("id").alias("id"), "part",
                      *[R(f"te_{c}").alias(f"te_{c}") for c in TE_COLS])


# fixed values: TPC-H domain levels of the one-hot encoded columns
ONE_HOT_LEVELS = {
    "pri_u": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "seg": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
}


@query("one_hot", with_base(
    "select cast(id as bigint) as id, " + ", ".join(
        f"cast(coalesce({c} = '{v}', false) as int) as \"{c}_{v}\"" for c, lv in ONE_HOT_LEVELS.items() for v in lv[1:])
    + " from te_base", TE_BASE))
def q_one_hot(spark, sf):
    """One-hot of train levels with the first (sorted) level dropped;
    unseen test values get all zeros."""
    cols = dict.fromkeys(["id", "role", "pri", *(c for c in ONE_HOT_LEVELS if c != "pri_u")])
    a = T.accounts_once(spark, sf, columns=list(cols)).withColumn("pri_u", T.unseen_category())
    out = E.one_hot(a.filter(F.col("role") == "train"), a, list(ONE_HOT_LEVELS))
    keep = [c for c in out.columns if any(c.startswith(p + "_") for p in ONE_HOT_LEVELS)
            and c not in a.columns]
    return out.select(L("id").alias("id"), *keep)


# ---------------------------------------------------------------- step 4

def _group_query(group):
    feats = S.GROUPS[group]

    def fn(spark, sf):
        a = T.accounts(spark, sf)
        return a.select(L("id").alias("id"), *[S.spark_out(f) for f in feats])
    fn.__doc__ = f"Row-wise feature group '{group}' (projection only)."
    sql = with_base("select cast(id as bigint) as id, " + ", ".join(S.sql_out(f) for f in feats) + " from accounts")
    REGISTRY[group] = (fn, sql)


for _g in S.GROUPS:
    _group_query(_g)


def _feature_table(spark, sf, set_name="core", keep_original=True):
    a = T.accounts(spark, sf)
    orig = [L(c).alias(c) if c in ("tenure", "n_items") else (R(c).alias(c) if c in ("monthly", "total") else c)
            for c in S.ORIGINALS] if keep_original else []
    return a.select(L("id").alias("id"), "role", L("y").alias("y"), *orig,
                    *[S.spark_out(f) for f in S.feature_set(set_name)])


def _feature_table_sql(set_name="core", keep_original=True):
    orig = ["pri", "seg", "nation", "region", "cast(tenure as bigint) as tenure", "round(monthly, 6) as monthly",
            "round(total, 6) as total", "cast(n_items as bigint) as n_items"] if keep_original else []
    cols = ["cast(id as bigint) as id", "role", "cast(y as bigint) as y", *orig,
            *[S.sql_out(f) for f in S.feature_set(set_name)]]
    return with_base("select " + ", ".join(cols) + " from accounts")


@query("feature_table_core", _feature_table_sql("core", False))
def q_feature_table_core(spark, sf):
    """The 'core' feature set without the original columns."""
    return _feature_table(spark, sf, "core", False)


@query("feature_table_full", _feature_table_sql("full", True))
def q_feature_table_full(spark, sf):
    """The 'full' feature set with the originals kept: the wide
    feature table written per role by the feature-table sink."""
    return _feature_table(spark, sf, "full", True)


# ---------------------------------------------------------------- step 5

from ..operators import binning as H  # noqa: E402
from ..operators import rank as G  # noqa: E402
from ..operators import stats as ST  # noqa: E402

FREQ_COLS = ["tenure", "n_items", "total", "tenure_gap"]


@query("freq_encoding", with_base(
    "select cast(id as bigint) as id, " + ", ".join(
        f"round(case when {c} is null then 0.0e0 else count({c}) over (partition by {c}) / count({c}) over () end, 6) "
        f"as freq_{c}" for c in FREQ_COLS)
    + " from (select *, case when id % 41 = 0 then null else tenure end as tenure_gap from accounts) g"))
def q_freq_encoding(spark, sf):
    """relative frequency of the exact value over train+test+reference;
    tenure_gap has nulls, which do not count."""
    a = T.accounts(spark, sf).withColumn("tenure_gap", F.when(F.col("id") % 41 != 0, F.col("tenure")))
    out = ST.frequency_encoding(a, FREQ_COLS)
    return out.select(L("id").alias("id"), *[R(f"freq_{c}").alias(f"freq_{c}") for c in FREQ_COLS])


def _cnt_frame(spark, sf):
    a = T.accounts(spark, sf)
    return a.select("id", "pri", "nation", T.padded_category().alias("pri_pad"),
                    F.concat("nation", "seg", "pri").alias("nsp"))


CNT_COLS = ["pri", "nation", "pri_pad", "nsp"]
CNT_SQL_BASE = ("cb as (select id, pri, nation, case when id % 37 = 0 then null else concat(' ', pri, ' ') end as pri_pad, "
                "concat(nation, seg, pri) as nsp from accounts)")


@query("category_counts", with_base(
    "select cast(id as bigint) as id, " + ", ".join(
        f"cast(count(*) over (partition by {c}) as bigint) as cnt_{c}, "
        f"cast(count(*) over (partition by {c}) <= 50 as bigint) as rare_{c}" for c in CNT_COLS)
    + " from cb", CNT_SQL_BASE))
def q_category_counts(spark, sf):
    """category count over all rows (nulls are a value) and rarity flag
    (count <= 50), for raw, padded-with-nulls and crossed columns."""
    out = ST.category_counts(_cnt_frame(spark, sf), CNT_COLS)
    return out.select(L("id").alias("id"), *[x for c in CNT_COLS for x in (
        L(f"cnt_{c}").alias(f"cnt_{c}"), L(f"rare_{c}").alias(f"rare_{c}"))])


GS_PAIRS = [("pri", "tenure"), ("pri", "monthly"), ("seg", "total"), ("nation", "monthly"), ("total", "monthly")]


def _gs_sql():
    sel = []
    for cat, num in GS_PAIRS:
        m = f"avg({num}) over (partition by {cat})"
        sd = f"coalesce(stddev_samp({num}) over (partition by {cat}), 0)"
        sel += [f"round({m}, 6) as {cat}_{num}_mean", f"round({num} - {m}, 6) as {cat}_{num}_diff",
                f"round(({num} - {m}) / ({sd} + 1e-6), 6) as {cat}_{num}_norm"]
    return with_base("select cast(id as bigint) as id, " + ", ".join(sel) + " from accounts")


@query("group_stats", _gs_sql())
def q_group_stats(spark, sf):
    """Group mean, difference and normalised difference (sample
    std, single-row group -> std 0) for 5 (category, number) pairs."""
    # stored: every category's statistics and the rows read it
    a = T.accounts_once(spark, sf, columns=list(dict.fromkeys(["id", *[c for pair in GS_PAIRS for c in pair]])))
    out = ST.group_stats(a, GS_PAIRS)
    names = [f"{c}_{n}_{s}" for c, n in GS_PAIRS for s in ("mean", "diff", "norm")]
    return out.select(L("id").alias("id"), *[R(n).alias(n) for n in names])


LRC_COLS = ["pri", "seg", "region", "svc_return"]


@query("label_rate_compare", with_base(
    "select coalesce(a.col, b.col) as col, coalesce(a.value, b.value) as value, "
    "round(coalesce(a.r, 0), 6) as rate_train, round(coalesce(b.r, 0), 6) as rate_ref from "
    "(" + " union all ".join(f"select '{c}' as col, {c} as value, avg(y) as r from accounts where role = 'train' group by {c}"
                             for c in LRC_COLS) + ") a full join "
    "(" + " union all ".join(f"select '{c}' as col, {c} as value, avg(y) as r from accounts where role = 'ref' group by {c}"
                             for c in LRC_COLS) + ") b on a.col = b.col and a.value = b.value"))
def q_label_rate_compare(spark, sf):
    """label rate by category in train vs reference, aligned, missing 0."""
    a = T.accounts(spark, sf)
    out = ST.label_rate_compare(a.filter(F.col("role") == "train"), a.filter(F.col("role") == "ref"), LRC_COLS)
    return out.select("col", "value", R("rate_a").alias("rate_train"), R("rate_b").alias("rate_ref"))


CORR_COLS = ["tenure", "monthly", "total", "n_items"]


@query("corr_matrix", with_base(" union all ".join(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from accounts"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:])))
def q_corr_matrix(spark, sf):
    """Pearson correlation of every pair of numeric columns."""
    out = ST.correlation_pairs(T.accounts(spark, sf), CORR_COLS)
    return out.select("a", "b", R("corr").alias("corr"))


@query("histogram", with_base("""
select role, cast(bin as bigint) as bin, cast(count(*) as bigint) as n,
  round(count(*) / (max(n_by) * max(width)), 6) as density
from (select role, least(floor((total - lo) / ((hi - lo) / 60)), 59) as bin, (hi - lo) / 60 as width,
        count(*) over (partition by role) as n_by
      from accounts, (select min(total) as lo, max(total) as hi from accounts) m) t
group by role, bin"""))
def q_histogram(spark, sf):
    """60-bin equal-width histogram of the amount with density, per role."""
    out = ST.histogram(T.accounts(spark, sf), "total", 60, "role")
    return out.select("role", L("bin").alias("bin"), L("n").alias("n"), R("density").alias("density"))


@query("score_histogram", with_base("""
select cast(y_sig as bigint) as y, cast(bin as bigint) as bin, cast(count(*) as bigint) as n,
  round(count(*) / (max(n_by) * max(width)), 6) as density
from (select y_sig, least(floor((s_b - lo) / ((hi - lo) / 80)), 79) as bin, (hi - lo) / 80 as width,
        count(*) over (partition by y_sig) as n_by
      from scored, (select min(s_b) as lo, max(s_b) as hi from scored) m) t
group by y_sig, bin"""))
def q_score_histogram(spark, sf):
    """80-bin histogram of a score by class."""
    out = ST.histogram(T.accounts_once(spark, sf, scores=True, columns=["s_b", "y_sig"]), "s_b", 80, "y_sig")
    return out.select(L("y_sig").alias("y"), L("bin").alias("bin"), L("n").alias("n"), R("density").alias("density"))


@query("box_summary", with_base(" union all ".join(
    f"select cast(y as bigint) as y, '{c}' as col, round(min({c}), 6) as min, round(quantile_cont({c}, 0.25), 6) as q1, "
    f"round(quantile_cont({c}, 0.5), 6) as median, round(quantile_cont({c}, 0.75), 6) as q3, "
    f"round(max({c}), 6) as max from accounts group by y" for c in ["tenure", "monthly", "total"])))
def q_box_summary(spark, sf):
    """five-number summary per class."""
    out = ST.five_numbers(T.accounts(spark, sf), ["tenure", "monthly", "total"], "y")
    return out.select(L("y").alias("y"), "col", *[R(c).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@query("crosstab", with_base("""
select pri, cast(sum(case when y = 0 then 1 else 0 end) as bigint) as n_0,
  cast(sum(case when y = 1 then 1 else 0 end) as bigint) as n_1 from accounts group by pri"""))
def q_crosstab(spark, sf):
    """cross-tabulation of priority by label."""
    out = ST.crosstab(T.accounts(spark, sf), "pri", "y", [0, 1])
    return out.select("pri", L("n_0").alias("n_0"), L("n_1").alias("n_1"))


# fixed values: bin edges of the fixture's month count and amounts
TENURE_EDGES_H1 = [0, 6, 12, 24, 100]
MONTHLY_EDGES_H1 = [0, 2500, 5000, 7500, 10000]
TENURE_EDGES_H2 = [0, 1, 3, 6, 12, 24, 36, 48, 60, 72, 10000]
TOTAL_EDGES_H2 = [0, 50000, 100000, 200000, 300000, 400000]


def _label_sql(x, edges):
    parts = [f"when {x} > {a} and {x} <= {b} then '({H._fmt(a)}, {H._fmt(b)}]'" for a, b in zip(edges[:-1], edges[1:])]
    return "case " + " ".join(parts) + " else 'nan' end"


def _code_sql(x, edges, lowest=True):
    arr = "[" + ", ".join(f"{float(e)}" for e in edges) + "]::double[]"
    lo, hi = float(edges[0]), float(edges[-1])
    inside = f"({x} > {lo} and {x} <= {hi})" + (f" or {x} = {lo}" if lowest else "")
    code = f"len(list_filter({arr}, lambda e: e < {x})) - 1"
    if lowest:
        code = f"case when {x} = {lo} then 0 else {code} end"
    return f"case when {x} is not null and ({inside}) then {code} else -1 end"


@query("fixed_bins", with_base(
    f"select cast(id as bigint) as id, {_label_sql('tenure', TENURE_EDGES_H1)} as tenure_label, "
    f"{_label_sql('monthly', MONTHLY_EDGES_H1)} as monthly_label, "
    f"cast({_code_sql('tenure', TENURE_EDGES_H1, False)} as bigint) as tenure_code_open, "
    f"cast({_code_sql('tenure', TENURE_EDGES_H2)} as bigint) as tenure_bin, "
    f"cast({_code_sql('total', TOTAL_EDGES_H2)} as bigint) as total_bin from accounts"))
def q_fixed_bins(spark, sf):
    """H1 / H2: right-closed fixed-edge bins: interval labels with outside
    -> 'nan', codes with / without the lowest edge, outside -> -1."""
    a = T.accounts(spark, sf)
    return a.select(
        L("id").alias("id"),
        H.interval_label(F.col("tenure"), TENURE_EDGES_H1).alias("tenure_label"),
        H.interval_label(F.col("monthly"), MONTHLY_EDGES_H1).alias("monthly_label"),
        L(H.right_closed_code(F.col("tenure"), TENURE_EDGES_H1, False)).alias("tenure_code_open"),
        L(H.right_closed_code(F.col("tenure"), TENURE_EDGES_H2)).alias("tenure_bin"),
        L(H.right_closed_code(F.col("total"), TOTAL_EDGES_H2)).alias("total_bin"))


def _qedges_sql(c, q):
    probs = "[" + ", ".join(repr(i / q) for i in range(q + 1)) + "]::double[]"
    return f"(select list_sort(list_distinct(quantile_cont({c}, {probs}))) from accounts)"


def _qcode_sql(c, q):
    e = _qedges_sql(c, q)
    return (f"case when {c} = {e}[1] then 0 when {c} > {e}[1] and {c} <= {e}[-1] "
            f"then len(list_filter({e}, lambda v: v < {c})) - 1 else -1 end")


@query("quantile_bins", with_base(
    f"select cast(id as bigint) as id, cast({_qcode_sql('monthly', 40)} as bigint) as monthly_qbin, "
    f"cast({_qcode_sql('total', 60)} as bigint) as total_qbin from accounts"))
def q_quantile_bins(spark, sf):
    """H3: quantile-edge bins fitted on the union (q=40 / q=60, linear
    quantiles, duplicate edges dropped), then right-closed codes."""
    a = T.accounts_once(spark, sf, columns=["id", "monthly", "total"])
    d = H.with_right_closed_code(a, "monthly", H.quantile_edges(a, "monthly", 40), "monthly_qbin")
    d = H.with_right_closed_code(d, "total", H.quantile_edges(a, "total", 60), "total_qbin")
    return d.select(*[L(c).alias(c) for c in ("id", "monthly_qbin", "total_qbin")])


def _kbins_sql(c, n):
    probs = "[" + ", ".join(repr(i / n) for i in range(n + 1)) + "]::double[]"
    full = f"(select list_sort(list_distinct(quantile_cont({c}, {probs}))) from accounts)"
    e = f"list_slice({full}, 2, len({full}) - 1)"
    return f"len(list_filter({e}, lambda v: v <= {c}))"


#: fixed values: the reference's bins on the amount, the small amount and the
#: month count, and the two that were here before
KBINS = {"total_k4000": ("total", 4000), "monthly_k200": ("monthly", 200), "tenure_k25": ("tenure", 25),
         "total_k25": ("total", 25), "tenure_k200": ("tenure", 200)}


@query("kbins_codes", with_base("select cast(id as bigint) as id, " + ", ".join(
    f"cast({_kbins_sql(c, n)} as bigint) as {name}" for name, (c, n) in KBINS.items()) + " from accounts"))
def q_kbins_codes(spark, sf):
    """H4: ordinal quantile discretiser (4000 bins of the amount, 200 of the
    small amount, 25 of the month count), left-closed, ends clipped; fitted
    once on all rows and applied by binary search."""
    a = T.accounts_once(spark, sf, columns=["id", "total", "monthly", "tenure"])
    d = a
    for name, (c, n) in KBINS.items():
        d = H.with_left_closed_code(d, c, H.quantile_edges(a, c, n)[1:-1], name)
    return d.select(L("id").alias("id"), *[L(c).alias(c) for c in KBINS])


# fixed values: signed deviation bands (edges and labels)
DEV_EDGES = [float("-inf"), -500000, -100000, -10000, 0, 10000, 100000, 500000, float("inf")]
DEV_LABELS = ["<=-500k", "-500k..-100k", "-100k..-10k", "-10k..0", "0..10k", "10k..100k", "100k..500k", ">500k"]


def _bands_sql(x):
    parts = []
    for (a, b), lab in zip(zip(DEV_EDGES[:-1], DEV_EDGES[1:]), DEV_LABELS):
        lo = "" if a == float("-inf") else f"{x} > {a}"
        hi = "" if b == float("inf") else f"{x} <= {b}"
        cond = " and ".join(p for p in (lo, hi) if p)
        parts.append(f"when {cond} then '{lab}'")
    return "case " + " ".join(parts) + " end"


@query("deviation_bands", with_base(
    f"select 'dev_band' as kind, {_bands_sql('(total - tenure * monthly)')} as bucket, cast(count(*) as bigint) as n, "
    "round(avg(y), 6) as rate from accounts where role = 'train' group by 2 union all "
    "select 'tenure_mod12', cast(((tenure % 12) + 12) % 12 as varchar), cast(count(*) as bigint), round(avg(y), 6) "
    "from accounts where role = 'train' group by 2"))
def q_deviation_bands(spark, sf):
    """H5 + F8: label rate by signed deviation band and by month-of-year."""
    a = T.accounts(spark, sf).filter(F.col("role") == "train")
    dev = F.col("total") - F.col("tenure") * F.col("monthly")
    b1 = a.groupBy(H.bands(dev, DEV_EDGES, DEV_LABELS).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")).withColumn("kind", F.lit("dev_band"))
    b2 = a.groupBy(F.pmod("tenure", F.lit(12)).cast("string").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")).withColumn("kind", F.lit("tenure_mod12"))
    u = b1.unionByName(b2)
    return u.select("kind", "bucket", L("n").alias("n"), R("rate").alias("rate"))


CODE_COLS = ["pri_pad", "seg", "nation", "svc_return"]


@query("sorted_codes", with_base(
    "select cast(id as bigint) as id, " + ", ".join(
        f"cast(coalesce((select k from (select v, dense_rank() over (order by v) - 1 as k from "
        f"(select distinct {c} as v from cb2 where {c} is not null)) d where d.v = cb2.{c}), -1) as bigint) as code_{c}"
        for c in CODE_COLS) + " from cb2",
    "cb2 as (select id, case when id % 37 = 0 then null else concat(' ', pri, ' ') end as pri_pad, seg, nation, "
    "svc_return from accounts)"))
def q_sorted_codes(spark, sf):
    """G2r: category code = sorted position over all rows, null -> -1."""
    a = T.accounts(spark, sf).withColumn("pri_pad", T.padded_category())
    out = G.sorted_codes(a, a, CODE_COLS)
    return out.select(L("id").alias("id"), *[L(f"code_{c}").alias(f"code_{c}") for c in CODE_COLS])


FS_COLS = ["pri_u", "seg", "nation"]


@query("first_seen_codes", with_base(
    "select cast(b.id as bigint) as id, " + ", ".join(
        f"cast(coalesce((select k from (select v, row_number() over (order by f, v) - 1 as k from "
        f"(select {c} as v, min(id) as f from te_base where role = 'train' group by {c})) d where d.v = b.{c}), -1) "
        f"as bigint) as fcode_{c}" for c in FS_COLS) + " from te_base b", TE_BASE))
def q_first_seen_codes(spark, sf):
    """G3r: first-appearance codes fitted on train (factorize), unseen -> -1."""
    a = _te_frame(spark, sf)
    out = G.first_seen_codes(a.filter(F.col("role") == "train"), a, FS_COLS)
    return out.select(L("id").alias("id"), *[L(f"fcode_{c}").alias(f"fcode_{c}") for c in FS_COLS])


@query("label_encode", with_base(
    "select cast(id as bigint) as id, " + ", ".join(
        f"cast((select k from (select v, dense_rank() over (order by v) - 1 as k from "
        f"(select distinct {c} as v from accounts where role = 'train')) d where d.v = a.{c}) as bigint) as idx_{c}"
        for c in ("pri", "seg")) + " from accounts a"))
def q_label_encode(spark, sf):
    """G4r: label encoding fitted on train (alphabetical), applied to all
    rows; an unseen level raises (StringIndexer handleInvalid='error')."""
    from pyspark.ml.feature import StringIndexer
    a = T.accounts(spark, sf)
    si = StringIndexer(inputCols=["pri", "seg"], outputCols=["idx_pri", "idx_seg"],
                       stringOrderType="alphabetAsc", handleInvalid="error")
    m = si.fit(a.filter(F.col("role") == "train"))
    return m.transform(a).select(L("id").alias("id"), L("idx_pri").alias("idx_pri"), L("idx_seg").alias("idx_seg"))


# ---------------------------------------------------------------- step 6

RANK_COLS = ["tenure", "monthly", "total", "n_items"]


@query("pct_rank", with_base(
    "select cast(id as bigint) as id, " + ", ".join(
        f"round((cast(rank() over (order by {c}) as double) - 1 + (cast(count(*) over (partition by {c}) as double) + 1) / 2)"
        f" / count(*) over (), 6) as rank_{c}" for c in RANK_COLS) + " from accounts"))
def q_pct_rank(spark, sf):
    """G1r: average-tie percentile rank over train+test+reference."""
    out = G.pct_rank(T.accounts(spark, sf), RANK_COLS)
    return out.select(L("id").alias("id"), *[R(f"rank_{c}").alias(f"rank_{c}") for c in RANK_COLS])


def _auc_sql_from(src: str, seg_cols: str = "score", label: str = "y", score: str = "s") -> str:
    """Rank-sum (Mann-Whitney) form of AUC with average tie ranks."""
    return (f"select {seg_cols}, round((sum(case when {label} = 1 then ra else 0 end) - sum({label}) * (sum({label}) + 1) / 2.0)"
            f" / (sum({label}) * (count(*) - sum({label}))), 6) as auc, cast(sum({label}) as bigint) as n_pos, "
            f"cast(count(*) - sum({label}) as bigint) as n_neg from (select {seg_cols}, {label}, "
            f"cast(rank() over (partition by {seg_cols} order by {score}) as double) + "
            f"(cast(count(*) over (partition by {seg_cols}, {score}) as double) - 1) / 2 as ra from {src}) r group by {seg_cols}")


@query("auc_exact", with_base(_auc_sql_from(
    "(select 's_a' as score, y_sig as y, s_a as s from scored union all select 's_b', y_sig, s_b from scored)")))
def q_auc_exact(spark, sf):
    """Exact ROC AUC with ties averaged, for two fixed scores."""
    sc = T.accounts_once(spark, sf, scores=True, columns=["s_a", "s_b", "y_sig"])
    long = sc.select(F.explode(F.array(
        F.struct(F.lit("s_a").alias("score"), F.col("s_a").alias("s"), F.col("y_sig").alias("y")),
        F.struct(F.lit("s_b").alias("score"), F.col("s_b").alias("s"), F.col("y_sig").alias("y")))).alias("r")
    ).select("r.*")
    out = G.auc(long, "s", "y", ["score"])
    return out.select("score", R("auc").alias("auc"), L("n_pos").alias("n_pos"), L("n_neg").alias("n_neg"))


SIG_FOLDS_SQL = (f"sf as (select *, cast((row_number() over (partition by y_sig order by {sql_md5(chr(39) + '42' + chr(39))}) - 1) % 5 "
                 "as int) as fold from scored where role = 'train')")


@query("auc_by_fold", with_base(
    "select cast(fold as bigint) as fold, auc, round(avg(auc) over (), 6) as mean_auc, "
    "round(stddev_pop(auc) over (), 6) as std_auc, min(auc) over () as min_auc, max(auc) over () as max_auc "
    "from (select fold, (sum(case when y_sig = 1 then ra else 0 end) - sum(y_sig) * (sum(y_sig) + 1) / 2.0) "
    "/ (sum(y_sig) * (count(*) - sum(y_sig))) as auc from (select fold, y_sig, cast(rank() over (partition by fold order by s_a) as double)"
    " + (cast(count(*) over (partition by fold, s_a) as double) - 1) / 2 as ra from sf) r group by fold) x",
    SIG_FOLDS_SQL).replace("select cast(fold as bigint) as fold, auc,", "select cast(fold as bigint) as fold, round(auc, 6) as auc,")
    .replace("min(auc) over () as min_auc, max(auc) over () as max_auc", "round(min(auc) over (), 6) as min_auc, round(max(auc) over (), 6) as max_auc"))
def q_auc_by_fold(spark, sf):
    """AUC per validation fold, mean / population std / min / max."""
    from pyspark.sql import Window
    sc = T.accounts_once(spark, sf, scores=True, columns=["id", "role", "s_a", "y_sig"]).filter(F.col("role") == "train")
    f = K.stratified_folds(sc, 5, SEED, label="y_sig")
    a = G.auc(f, "s_a", "y_sig", ["fold"])
    w = Window.partitionBy()  # 5-row table
    return a.select(L("fold").alias("fold"), R("auc").alias("auc"), R(F.avg("auc").over(w)).alias("mean_auc"),
                    R(F.stddev_pop("auc").over(w)).alias("std_auc"), R(F.min("auc").over(w)).alias("min_auc"),
                    R(F.max("auc").over(w)).alias("max_auc"))


@query("scan_scored", with_base(
    "select cast(id as bigint) as id, role, cast(y as bigint) as y, pri, seg, nation, region, cast(tenure as bigint) as tenure, "
    "round(monthly, 6) as monthly, round(total, 6) as total, cast(n_items as bigint) as n_items, "
    + ", ".join(T.SERVICES) + ", cast(y_sig as bigint) as y_sig, round(s_a, 6) as s_a, round(s_b, 6) as s_b from scored"))
def q_scan_scored(spark, sf):
    """A1 / A3: the scanned, joined row table with its planted label and
    fixed scores (the input every other query starts from)."""
    s = T.scored(spark, sf)
    return s.select(L("id").alias("id"), "role", L("y").alias("y"), "pri", "seg", "nation", "region",
                    L("tenure").alias("tenure"), R("monthly").alias("monthly"), R("total").alias("total"),
                    L("n_items").alias("n_items"), *T.SERVICES, L("y_sig").alias("y_sig"),
                    R("s_a").alias("s_a"), R("s_b").alias("s_b"))


# ---------------------------------------------------------------- step 7

from ..operators import reference as J  # noqa: E402

REF_COLS = ["pri", "seg", "region", "svc_return", "tenure"]
REF_PAIRS = [("pri", "seg"), ("pri", "region"), ("pri", "svc_return"), ("seg", "region"),
             ("seg", "svc_return"), ("region", "svc_return")]
NUM_REF = ["tenure", "monthly", "total"]


REF_READ = ["id", "role", "y_sig", "pri", "seg", "nation", "region", "svc_return", "tenure", "monthly", "total"]


def _ref_frames(spark, sf):
    s = T.accounts_once(spark, sf, scores=True, columns=REF_READ)
    return s, s.filter(F.col("role") == "ref")


def _orig_sql_cols(alias="a"):
    single = [f"coalesce((select avg(y_sig) from scored r where r.role = 'ref' and r.{c} = {alias}.{c}), 0.5) as orig_{c}"
              for c in REF_COLS]
    pairs = [f"coalesce((select avg(y_sig) from scored r where r.role = 'ref' and r.{x} = {alias}.{x} and r.{y} = {alias}.{y}), 0.5)"
             f" as orig_{x}_{y}" for x, y in REF_PAIRS]
    return single, pairs


def _orig_frame(spark, sf):
    s, ref = _ref_frames(spark, sf)
    out = J.ref_rate(s, ref, REF_COLS, "y_sig")
    return J.ref_rate_pairs(out, ref, REF_PAIRS, "y_sig")


_single, _pairs = _orig_sql_cols()


@query("ref_rate", with_base(
    "select cast(id as bigint) as id, " + ", ".join(f"round({e.rsplit(' as ', 1)[0]}, 6) as {e.rsplit(' as ', 1)[1]}"
                                                    for e in _single) + " from scored a"))
def q_ref_rate(spark, sf):
    """Reference label rate per value of 4 categoricals and the month
    count; unseen -> 0.5."""
    s, ref = _ref_frames(spark, sf)
    out = J.ref_rate(s, ref, REF_COLS, "y_sig")
    return out.select(L("id").alias("id"), *[R(f"orig_{c}").alias(f"orig_{c}") for c in REF_COLS])


@query("ref_rate_pairs", with_base(
    "select cast(id as bigint) as id, " + ", ".join(f"round({e.rsplit(' as ', 1)[0]}, 6) as {e.rsplit(' as ', 1)[1]}"
                                                    for e in _pairs) + " from scored a"))
def q_ref_rate_pairs(spark, sf):
    """Reference label rate per value pair (6 pairs of 4)."""
    s, ref = _ref_frames(spark, sf)
    out = J.ref_rate_pairs(s, ref, REF_PAIRS, "y_sig")
    return out.select(L("id").alias("id"), *[R(f"orig_{a}_{b}").alias(f"orig_{a}_{b}") for a, b in REF_PAIRS])


SUBSET_SQL = {"ch": "and r.y_sig = 1", "nc": "and r.y_sig = 0", "all": ""}


def _pct_sql(k, c, alias="a"):
    cond = SUBSET_SQL[k]
    return (f"(select count(*) from scored r where r.role = 'ref' {cond} and r.{c} < {alias}.{c}) / "
            f"(select count(*) from scored r where r.role = 'ref' {cond})")


@query("ref_pct_rank", with_base(
    "select cast(id as bigint) as id, " + ", ".join(
        f"round({_pct_sql(k, c)}, 6) as pct_{k}_{c}" for c in NUM_REF for k in SUBSET_SQL) + " from scored a"))
def q_ref_pct_rank(spark, sf):
    """Searchsorted-left percentile of each amount inside the
    reference churners / non-churners / all."""
    s, ref = _ref_frames(spark, sf)
    out = J.ref_pct(s, ref, NUM_REF, "y_sig")
    return out.select(L("id").alias("id"), *[R(f"pct_{k}_{c}").alias(f"pct_{k}_{c}")
                                             for c in NUM_REF for k in SUBSET_SQL])


@query("ref_pct_gap", with_base(
    "select cast(id as bigint) as id, " + ", ".join(
        f"round({_pct_sql('ch', c)} - {_pct_sql('nc', c)}, 6) as pctgap_{c}" for c in NUM_REF) + " from scored a"))
def q_ref_pct_gap(spark, sf):
    """Churner percentile minus non-churner percentile."""
    s, ref = _ref_frames(spark, sf)
    out = J.ref_pct(s, ref, NUM_REF, "y_sig")
    return out.select(L("id").alias("id"), *[R(F.col(f"pct_ch_{c}") - F.col(f"pct_nc_{c}")).alias(f"pctgap_{c}")
                                             for c in NUM_REF])


Z_COLS = ["tenure", "monthly", "total", "const1"]


def _z_sql():
    st = ", ".join(f"avg(case when y_sig = {v} then {c} end) as mu_{k}_{c}, "
                   f"stddev_pop(case when y_sig = {v} then {c} end) as sd_{k}_{c}"
                   for c in Z_COLS for k, v in (("ch", 1), ("nc", 0)))
    sel = []
    for c in Z_COLS:
        z = {k: f"(case when sd_{k}_{c} = 0 then 0.0 else ({c} - mu_{k}_{c}) / sd_{k}_{c} end)" for k in ("ch", "nc")}
        sel += [f"round({z['ch']}, 6) as z_ch_{c}", f"round({z['nc']}, 6) as z_nc_{c}",
                f"round(abs({z['ch']}) - abs({z['nc']}), 6) as zgap_{c}"]
    return with_base("select cast(id as bigint) as id, " + ", ".join(sel) + " from zb, st",
                     "zb as (select *, 1.0::double as const1 from scored),\n"
                     f"st as (select {st} from zb where role = 'ref')")


@query("ref_zscore", _z_sql())
def q_ref_zscore(spark, sf):
    """Z-scores against the reference churner / non-churner subsets
    (population std; std 0, e.g. a constant column, -> 0) and their gap."""
    s, ref = _ref_frames(spark, sf)
    s = s.withColumn("const1", F.lit(1.0))
    out = J.ref_zscore(s, ref.withColumn("const1", F.lit(1.0)), Z_COLS, "y_sig")
    names = [f"{p}_{c}" for c in Z_COLS for p in ("z_ch", "z_nc", "zgap")]
    return out.select(L("id").alias("id"), *[R(n).alias(n) for n in names])


QD_COLS = ["total", "tenure"]


def _qd_sql():
    st = ", ".join(f"quantile_cont(case when y_sig = {v} then {c} end, {q}) as q{int(q * 100)}_{k}_{c}"
                   for c in QD_COLS for k, v in (("ch", 1), ("nc", 0)) for q in (0.25, 0.5, 0.75))
    sel = []
    for c in QD_COLS:
        for q in (25, 50, 75):
            ch, nc = f"abs({c} - q{q}_ch_{c})", f"abs({c} - q{q}_nc_{c})"
            sel += [f"round({ch}, 6) as qd{q}_ch_{c}", f"round({nc}, 6) as qd{q}_nc_{c}",
                    f"round({nc} - {ch}, 6) as qdgap{q}_{c}"]
    return with_base("select cast(id as bigint) as id, " + ", ".join(sel) + " from scored, st",
                     f"st as (select {st} from scored where role = 'ref')")


@query("ref_quantile_dist", _qd_sql())
def q_ref_quantile_dist(spark, sf):
    """Distance to the reference subsets' quartiles and the gap nc - ch."""
    s, ref = _ref_frames(spark, sf)
    out = J.ref_quantile_dist(s, ref, QD_COLS, "y_sig")
    names = [f"{p}{q}_{k}_{c}" if p == "qd" else f"qdgap{q}_{c}"
             for c in QD_COLS for q in (25, 50, 75) for p, k in (("qd", "ch"), ("qd", "nc"), ("gap", None))]
    return out.select(L("id").alias("id"), *[R(n).alias(n) for n in names])


SEGS = ["seg", "region"]


@query("ref_segment_pct_rank", with_base(
    "select cast(id as bigint) as id, " + ", ".join(
        f"round(coalesce((select count(*) from segref r where r.{g} = a.{g} and r.monthly < a.monthly) / "
        f"nullif((select count(*) from segref r where r.{g} = a.{g}), 0), 0), 6) as segpct_{g}_monthly"
        for g in SEGS) + " from segrows a",
    "segrows as (select id, role, monthly, seg, case when id % 11 = 0 then 'REGION_X' else region end as region from scored),\n"
    "segref as (select * from segrows where role = 'ref')"))
def q_ref_segment_pct_rank(spark, sf):
    """Percentile of the small amount among reference rows of the same
    segment (segment, region); a segment absent from the reference -> 0."""
    s, _ = _ref_frames(spark, sf)
    s = s.withColumn("region", F.when(F.col("id") % 11 == 0, F.lit("REGION_X")).otherwise(F.col("region")))
    ref = s.filter(F.col("role") == "ref")
    out = s
    for g in SEGS:
        out = J.ref_segment_pct(out, ref, "monthly", g)
    return out.select(L("id").alias("id"), *[R(f"segpct_{g}_monthly").alias(f"segpct_{g}_monthly") for g in SEGS])


@query("ref_segment_resid", with_base(
    "select cast(id as bigint) as id, " + ", ".join(
        f"round(monthly - coalesce((select avg(monthly) from scored r where r.role = 'ref' and r.{g} = a.{g}), 0), 6)"
        f" as resid_{g}_monthly" for g in ["seg", "nation"]) + " from scored a"))
def q_ref_segment_resid(spark, sf):
    """Residual of the small amount from its segment's reference mean."""
    s, ref = _ref_frames(spark, sf)
    out = s
    for g in ["seg", "nation"]:
        out = J.ref_segment_resid(out, ref, "monthly", g)
    return out.select(L("id").alias("id"), *[R(f"resid_{g}_monthly").alias(f"resid_{g}_monthly")
                                             for g in ["seg", "nation"]])


# single-feature strength ------------------------------------------------------

#: fixed values: the reference's nine groups
FEATURE_GROUPS = {
    "single_rate": [f"orig_{c}" for c in REF_COLS],
    "cross_rate": [f"orig_{a}_{b}" for a, b in REF_PAIRS],
    **{f"{c}_rank": [f"{p}_{c}" for p in ("pct_ch", "pct_nc", "pct_all", "pctgap")] for c in NUM_REF},
    "total_quantile_distance": [f"{p}_total" for q in (25, 50, 75) for p in (f"qd{q}_ch", f"qd{q}_nc", f"qdgap{q}")],
    "digit": ["tenure_mod12", "tenure_last_digit"],
    "arithmetic": ["charges_deviation", "avg_monthly_charges"],
    "frequency": [f"freq_{c}" for c in NUM_REF],
}
DIGIT_SQL = {"tenure_mod12": "cast(((tenure % 12) + 12) % 12 as double)",
             "tenure_last_digit": "cast(cast(right(cast(tenure as varchar), 1) as int) as double)",
             "charges_deviation": "(total - tenure * monthly)", "avg_monthly_charges": "total / nullif(tenure + 1, 0)"}


def _strength_frame(spark, sf):
    """AUC of every single feature on the train rows.  All but the arithmetic
    ones are functions of a value (or pair), so they are computed once per
    value, with the value's counts: by role and label, of all rows and of the
    reference."""
    s, _ = _ref_frames(spark, sf)
    train, ref, pos = F.col("role") == "train", F.col("role") == "ref", F.col("y_sig") == 1

    def n(cond):
        return F.sum(cond.cast("long"))

    counts = {"pos": n(train & pos), "neg": n(train & ~pos), "ch": n(ref & pos), "nc": n(ref & ~pos), "n": F.count(F.lit(1))}
    keys = {f"orig_{c}": F.col(c).cast("string") for c in REF_COLS} | {
        f"orig_{a}_{b}": F.concat_ws("|", a, b) for a, b in REF_PAIRS}
    cells = s.select("role", "y_sig", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), k.alias("value")) for f, k in keys.items()]))
                     .alias("r")).select("role", "y_sig", "r.*").groupBy("feature", "value").agg(*[e.alias(k) for k, e in counts.items()])
    rate = F.coalesce(F.try_divide(F.col("ch"), F.col("ch") + F.col("nc")), F.lit(0.5))
    rates = cells.select("feature", rate.alias("s"), "pos", "neg")

    values = G.unpivot_numeric(s, NUM_REF, ["role", "y_sig"]).filter(F.col("value").isNotNull()).groupBy("col", "value").agg(
        *[e.alias(k) for k, e in counts.items()])
    values = cut_lineage(values.withColumn("all", F.col("ch") + F.col("nc")), "value-counts")
    quart = G.values_at_quantiles  # of the reference's churners and others, by value
    of = [values.filter(F.col("col") == "total").select(F.lit(k).alias("k"), "value", F.col(k).alias("c")).filter("c > 0") for k in ("ch", "nc")]
    q = quart(cut_lineage(of[0].unionByName(of[1]), "quartile-counts"), "value", "c", [0.25, 0.5, 0.75], ["k"])
    q = q.select("k", "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor(F.col("pos")))).alias("q"))
    q = q.agg(*[F.max(F.when((F.col("k") == k) & (F.col("p") == p), F.col("q"))).alias(f"q{int(100 * p)}_{k}")
                for k in ("ch", "nc") for p in (0.25, 0.5, 0.75)])
    rc = G.running_counts(values, "value", ["ch", "nc", "all", "n"], ["col"]).crossJoin(F.broadcast(q))  # one row
    x = F.col("value")
    below = {k: F.try_divide(F.col(f"{k}_before"), F.col(f"{k}_total")) for k in ("ch", "nc", "all")}
    dist = {(k, t): F.abs(x - F.col(f"q{t}_{k}")) for k in ("ch", "nc") for t in (25, 50, 75)}
    shared = {"pct_ch": below["ch"], "pct_nc": below["nc"], "pct_all": below["all"], "pctgap": below["ch"] - below["nc"],
              "freq": F.col("n") / F.col("n_total")}
    own = {"total": {f"qd{t}_{k}_total": d for (k, t), d in dist.items()} | {
               f"qdgap{t}_total": dist["nc", t] - dist["ch", t] for t in (25, 50, 75)},
           "tenure": {"tenure_mod12": F.pmod(x, F.lit(12.0)),
                      "tenure_last_digit": F.expr("right(cast(cast(value as bigint) as string), 1)").cast("double")}}
    by_value = [F.when(F.col("col") == c, F.struct(F.lit(f).alias("feature"), e.cast("double").alias("s")))
                for c in NUM_REF for f, e in ({f"{k}_{c}": e for k, e in shared.items()} | own.get(c, {})).items()]
    numbers = rc.select("pos", "neg", F.explode(F.array_compact(F.array(*by_value))).alias("r")).select("r.*", "pos", "neg")

    arith = {"charges_deviation": F.col("total") - F.col("tenure") * F.col("monthly"),
             "avg_monthly_charges": F.try_divide(F.col("total"), F.col("tenure") + 1)}
    rows = s.filter(train).select("y_sig", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), e.alias("s")) for f, e in arith.items()]))
                                  .alias("r")).select("r.*", F.col("y_sig").cast("long").alias("pos"), (1 - F.col("y_sig")).cast("long").alias("neg"))
    every = rates.unionByName(numbers).unionByName(rows).filter((F.col("pos") > 0) | (F.col("neg") > 0))
    a = G.auc_of_counts(every, "s", "pos", "neg", ["feature"])
    group = F.create_map(*[F.lit(v) for g, fs in FEATURE_GROUPS.items() for f in fs for v in (f, g)])
    return a.withColumn("grp", group[F.col("feature")]).withColumn("auc_adj", F.greatest(F.col("auc"), 1 - F.col("auc")))


def _strength_sql_src():
    s1, p1 = _orig_sql_cols()
    ranks = [f"{_pct_sql(k, c)} as pct_{k}_{c}" for c in NUM_REF for k in SUBSET_SQL]
    ranks += [f"{_pct_sql('ch', c)} - {_pct_sql('nc', c)} as pctgap_{c}" for c in NUM_REF]
    quart = "(select quantile_cont(total, {p}) from scored r where r.role = 'ref' and r.y_sig = {v})"
    dist = {(k, t): f"abs(total - {quart.format(p=t / 100, v=v)})" for k, v in (("ch", 1), ("nc", 0)) for t in (25, 50, 75)}
    dists = [f"{e} as qd{t}_{k}_total" for (k, t), e in dist.items()]
    dists += [f"{dist['nc', t]} - {dist['ch', t]} as qdgap{t}_total" for t in (25, 50, 75)]
    freqs = [f"(select count(*) from scored r where r.{c} = a.{c}) / (select count({c}) from scored) as freq_{c}" for c in NUM_REF]
    cols = ", ".join(s1 + p1 + ranks + dists + freqs + [f"{v} as {k}" for k, v in DIGIT_SQL.items()])
    feats = " union all ".join(f"select '{g}' as grp, '{f}' as feature, cast({f} as double) as s, y_sig as y from fx"
                               for g, fs in FEATURE_GROUPS.items() for f in fs)
    return [f"fx as materialized (select y_sig, {cols} from scored a where role = 'train')", f"lg as ({feats})"]


def _auc_named_sql():
    return ("select grp, feature, (sum(case when y = 1 then ra else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / "
            "(sum(y) * (count(*) - sum(y))) as auc from (select grp, feature, y, cast(rank() over (partition by grp, feature "
            "order by s) as double) + (cast(count(*) over (partition by grp, feature, s) as double) - 1) / 2 as ra from lg where s is not null) r "
            "group by grp, feature")


@query("single_feature_auc", with_base(
    "select grp, feature, round(auc, 6) as auc, round(greatest(auc, 1 - auc), 6) as auc_adj from au",
    ",\n".join(_strength_sql_src() + [f"au as ({_auc_named_sql()})"])))
def q_single_feature_auc(spark, sf):
    """AUC of every single feature of the nine groups on the train rows,
    max(a, 1 - a); one AUC job grouped by feature."""
    a = _strength_frame(spark, sf)
    return a.select("grp", "feature", R("auc").alias("auc"), R("auc_adj").alias("auc_adj"))


@query("feature_group_strength", with_base(
    "select grp, arg_max(feature, (round(greatest(auc, 1 - auc), 9), feature)) as best_feature, "
    "round(max(greatest(auc, 1 - auc)), 6) as best_auc from au group by grp", ",\n".join(_strength_sql_src() + [f"au as ({_auc_named_sql()})"])))
def q_feature_group_strength(spark, sf):
    """Best single-feature AUC per feature group."""
    a = _strength_frame(spark, sf)
    g = a.groupBy("grp").agg(F.max_by("feature", F.struct(F.round("auc_adj", 9), "feature")).alias("best_feature"),
                             F.max("auc_adj").alias("best_auc"))
    return g.select("grp", "best_feature", R("best_auc").alias("best_auc"))


# ---------------------------------------------------------------- step 8

@query("multi_seed_folds", with_base(
    "select cast(s.seed as bigint) as seed, cast(a.id as bigint) as id, cast((row_number() over (partition by s.seed, a.y "
    f"order by {sql_md5('s.seed', 'a.id')}) - 1) % 5 as bigint) as fold from accounts a, "
    "(select unnest([11, 42, 99]) as seed) s where a.role = 'train'"))
def q_multi_seed_folds(spark, sf):
    """K4: stratified folds repeated for seeds 11, 42, 99 (one job)."""
    a = T.accounts(spark, sf).filter(F.col("role") == "train")
    f = K.multi_seed_folds(a, (11, 42, 99), 5)
    return f.select(L("seed").alias("seed"), L("id").alias("id"), L("fold").alias("fold"))


#: share of every other majority part that a set samples: 20,000 of about
#: 92,000 rows in the reference
PER_OTHER_SHARE = 0.2175


@query("rebalanced_sets", with_base(f"""
select cast(set_id as bigint) as set_id, cast(id as bigint) as id, cast(part as bigint) as part from (
  select s.set_id, m.id, m.part from maj m join sets s on m.part = s.set_id
  union all
  select set_id, id, part from (
    select s.set_id, m.id, m.part, row_number() over (partition by s.set_id, m.part order by
      md5(concat_ws(':', '42', cast(s.set_id as varchar), cast(m.part as varchar), cast(m.id as varchar)))) - 1 as rn,
      count(*) over (partition by s.set_id, m.part) as n
    from maj m join sets s on m.part <> s.set_id) o where rn < ceil(n * {PER_OTHER_SHARE}::double)
  union all
  select s.set_id, a.id, 0 from accounts a, sets s where a.role = 'train' and a.y <> (select y from mj)) u""",
    "mj as (select y from accounts where role = 'train' group by y order by count(*) desc, y limit 1),\n"
    "maj as (select id, ntile(5) over (order by id) as part from accounts where role = 'train' and y = (select y from mj)),\n"
    "sets as (select range as set_id from range(1, 6))"))
def q_rebalanced_sets(spark, sf):
    """K6: five rebalanced training sets: majority part i + a hash-sampled
    share of every other part + all minority rows."""
    a = T.accounts(spark, sf).filter(F.col("role") == "train")
    r = K.rebalanced_sets(a, 5, PER_OTHER_SHARE, SEED)
    return r.select(L("set_id").alias("set_id"), L("id").alias("id"), L("part").alias("part"))


@query("pseudo_augment", with_base(
    "select cast(id as bigint) as id, role, cast(y as bigint) as y, cast(fold as bigint) as fold from ("
    f"select id, role, y, fold from folds union all select id, 'pseudo', cast({SP_SQL} > 0.5 as int), -1 from te_base "
    f"where role = 'test' and ({SP_SQL} > {PSEUDO_T} or {SP_SQL} < 1 - {PSEUDO_T}))", TE_BASE + ",\n" + FOLDS_SQL))
def q_pseudo_augment(spark, sf):
    """Training rows plus confident test rows as pseudo labels
    (fold -1: in every fold's training part, never validated); skipped
    when no row qualifies."""
    a = T.with_scores(_te_frame(spark, sf, more=("tenure",))).withColumn("s_p", F.expr(SP_SQL))
    tr = K.stratified_folds(a.filter(F.col("role") == "train"), 5, SEED)
    ps = K.pseudo_rows(a.filter(F.col("role") == "test"), "s_p", PSEUDO_T)
    cols = ["id", "role", "y", "fold"]
    out = tr.select(*cols)
    if ps.limit(1).count() > 0:  # the reference stops when no test row is confident
        out = out.unionByName(ps.select(*cols))
    return out.select(L("id").alias("id"), "role", L("y").alias("y"), L("fold").alias("fold"))


SCALE_POS = 3.44


@query("class_weights", with_base(
    f"select cast(id as bigint) as id, cast(y as bigint) as y, round(case when y = 1 then {SCALE_POS} else 1.0 end, 6) as w_spw, "
    "round(count(*) over () / (2.0 * count(*) over (partition by y)), 6) as w_bal from accounts where role = 'train'"))
def q_class_weights(spark, sf):
    """L4: per-row weights: scale_pos_weight and 'balanced' n / (2 n_class)."""
    a = T.accounts(spark, sf).filter(F.col("role") == "train")
    cnt = a.groupBy("y").agg(F.count(F.lit(1)).alias("n_c"))
    tot = cnt.agg(F.sum("n_c").alias("n"))
    w = cnt.crossJoin(tot).select("y", (F.col("n") / (2.0 * F.col("n_c"))).alias("w_bal"))  # 2 rows
    j = a.join(F.broadcast(w), "y")
    return j.select(L("id").alias("id"), L("y").alias("y"),
                    R(F.when(F.col("y") == 1, SCALE_POS).otherwise(1.0)).alias("w_spw"), R("w_bal").alias("w_bal"))


@query("inspection_sample", with_base(
    f"select cast(id as bigint) as id, role, pri, cast(tenure as bigint) as tenure from accounts order by {sql_md5(chr(39) + '42' + chr(39))}, id limit 10"))
def q_inspection_sample(spark, sf):
    """10 rows in seeded-hash order (a sample for inspection)."""
    s = K.inspection_sample(T.accounts(spark, sf), 10, SEED)
    return s.select(L("id").alias("id"), "role", "pri", L("tenure").alias("tenure"))


# ---------------------------------------------------------------- step 10

from ..operators import evaluate as N  # noqa: E402

TRAIN_SCORED = "ts as (select id, y_sig as y, s_a, s_b from scored where role = 'train')"


def _train_scored(spark, sf):
    return T.accounts_once(spark, sf, scores=True, columns=["id", "role", "y_sig", "s_a", "s_b"]).filter(
        F.col("role") == "train").select("id", F.col("y_sig").alias("y"), "s_a", "s_b")


NOISE_C = "(((id * 31337 + 7) % 10007) / 10007.0)"


@query("blend_weighted", with_base(
    "select cast(id as bigint) as id, round(0.6 * s_a + (1 - 0.6) * s_b, 6) as blend_w06, round((s_a + s_b) / 2, 6) as blend_eq, "
    "round((0.3 * s_a + 0.7 * s_b) / 2, 6) as blend_37_half, "
    f"round((2.0 * s_a + 1.0 * s_b + 1.0 * {NOISE_C}) / 4.0, 6) as blend_n from scored where role = 'train'"))
def q_blend_weighted(spark, sf):
    """Convex two-model blend, fixed mixes (the .3/.7
    mix halved as in the reference), and a weighted blend of three
    prediction tables joined on id."""
    s = T.scored(spark, sf).filter(F.col("role") == "train")
    s = s.withColumn("s_c", ((F.col("id") * 31337 + 7) % 10007) / F.lit(10007.0))
    n = N.blend_tables([(s.select("id", F.col("s_a").alias("p")), 2.0), (s.select("id", F.col("s_b").alias("p")), 1.0),
                        (s.select("id", F.col("s_c").alias("p")), 1.0)])
    x = s.join(n, "id")
    a, b = F.col("s_a"), F.col("s_b")
    return x.select(L("id").alias("id"), R(F.lit(0.6) * a + (F.lit(1.0) - F.lit(0.6)) * b).alias("blend_w06"),
                    R((a + b) / 2).alias("blend_eq"), R((F.lit(0.3) * a + F.lit(0.7) * b) / 2).alias("blend_37_half"),
                    R("blend").alias("blend_n"))


GRID = [round(0.30 + 0.05 * i, 2) for i in range(10)]


def _grid_sql(weights, extra=""):
    vals = ", ".join(f"({w!r})" for w in weights)
    src = (f"(select cast(g.w as double) as w, t.y, cast(g.w as double) * t.s_a + (1.0 - cast(g.w as double)) * t.s_b as s "
           f"from ts t, (values {vals}) g(w))")
    return src


@query("blend_grid", with_base(
    "select round(g.w, 6) as w, g.auc as auc, round(g.auc - greatest(sa.auc, sb.auc), 6) as gain from gr g, sa, sb",
    TRAIN_SCORED + ",\n" + f"gr as ({_auc_sql_from(_grid_sql(GRID), 'w')}),\n"
    f"sa as ({_auc_sql_from('(select 1 as k, y, s_a as s from ts)', 'k')}),\n"
    f"sb as ({_auc_sql_from('(select 1 as k, y, s_b as s from ts)', 'k')})"))
def q_blend_grid(spark, sf):
    """M2 + M6: OOF AUC of w*a + (1-w)*b for w = .30 ... .75 in one job, and
    the gain over the best single model."""
    t = _train_scored(spark, sf)
    g = N.weight_grid_auc(t, "s_a", "s_b", "y", GRID)
    single = G.auc(t.select(F.explode(F.array(
        F.struct(F.lit("a").alias("m"), F.col("s_a").alias("s"), F.col("y").alias("y")),
        F.struct(F.lit("b").alias("m"), F.col("s_b").alias("s"), F.col("y").alias("y")))).alias("r")).select("r.*"),
        "s", "y", ["m"]).agg(F.max("auc").alias("best_single"))
    j = g.crossJoin(F.broadcast(single))  # one row
    return j.select(R("w").alias("w"), R("auc").alias("auc"), R(R("auc") - R("best_single")).alias("gain"))


COARSE = [round(0.05 * i, 2) for i in range(21)]


@query("blend_refine", with_base(
    "select round(w, 6) as w, auc from fine",
    TRAIN_SCORED + ",\n" + f"coarse as ({_auc_sql_from(_grid_sql(COARSE), 'w')}),\n"
    "best as (select arg_max(w, auc) as w0 from (select w, auc, row_number() over (order by auc desc, w) as r from coarse) where r = 1),\n"
    "fw as (select distinct round(b.w0 + (range - 5) * 0.01, 2) as w from best b, range(11) "
    "where b.w0 + (range - 5) * 0.01 between -1e-9 and 1 + 1e-9),\n"
    "fine as (select w, (sum(case when y = 1 then ra else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as auc0 "
    "from (select f.w, t.y, cast(rank() over (partition by f.w order by cast(f.w as double) * t.s_a + (1.0 - cast(f.w as double)) * t.s_b) as double) "
    "+ (cast(count(*) over (partition by f.w, cast(f.w as double) * t.s_a + (1.0 - cast(f.w as double)) * t.s_b) as double) - 1) / 2 as ra "
    "from ts t, fw f) r group by w)").replace("select round(w, 6) as w, auc from fine", "select round(w, 6) as w, round(auc0, 6) as auc from fine"))
def q_blend_refine(spark, sf):
    """M3: bounded search for the blend weight: a coarse grid on [0, 1]
    (step .05), then a refined grid (step .01) around the best coarse
    weight; each grid is one AUC job."""
    t = _train_scored(spark, sf)
    coarse = N.weight_grid_auc(t, "s_a", "s_b", "y", COARSE)
    w0 = coarse.select("w", F.round("auc", 6).alias("a")).orderBy(F.desc("a"), "w").first()["w"]  # one scalar
    fine = sorted({round(w0 + (i - 5) * 0.01, 2) for i in range(11) if -1e-9 <= w0 + (i - 5) * 0.01 <= 1 + 1e-9})
    g = N.weight_grid_auc(t, "s_a", "s_b", "y", fine)
    return g.select(R("w").alias("w"), R("auc").alias("auc"))


SEARCH_STEPS = 20  # golden-section steps from [0, 1] to 1e-4


def _search_sql():
    """The same golden section, one CTE per step."""
    g = f"{N.GOLDEN!r}e0"

    def auc_at(cte, w):
        return (f"(select round((sum(case when y = 1 then ra else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) "
                f"from (select y, cast(rank() over (order by s) as double) + (cast(count(*) over (partition by s) as double) - 1) / 2 as ra "
                f"from (select t.y, c.{w} * t.s_a + (1.0e0 - c.{w}) * t.s_b as s from ts t, {cte} c) b) r)")

    ctes = [TRAIN_SCORED, f"p0 as materialized (select 0e0 as lo, 1e0 as hi, 1e0 - (1e0 - 0e0) * {g} as x, 0e0 + (1e0 - 0e0) * {g} as y)",
            f"s0 as materialized (select *, {auc_at('p0', 'x')} as fx, {auc_at('p0', 'y')} as fy from p0)"]
    for k in range(SEARCH_STEPS):
        ctes.append(f"n{k} as materialized (select *, case when l then hi - (hi - lo) * {g} else lo + (hi - lo) * {g} end as w from ("
                    f"select fx >= fy as l, case when fx >= fy then lo else x end as lo, case when fx >= fy then y else hi end as hi, "
                    f"case when fx >= fy then x else y end as kw, case when fx >= fy then fx else fy end as kf from s{k}) z)")
        ctes.append(f"s{k + 1} as materialized (select lo, hi, case when l then w else kw end as x, case when l then kw else w end as y, "
                    f"case when l then f else kf end as fx, case when l then kf else f end as fy from (select *, {auc_at(f'n{k}', 'w')} as f from n{k}) z)")
    return with_base(f"select round(case when fx >= fy then x else y end, 6) as w, round(greatest(fx, fy), 6) as auc from s{SEARCH_STEPS}",
                     ",\n".join(ctes))


@query("blend_search", _search_sql())
def q_blend_search(spark, sf):
    """M3: bounded search for the blend weight to 1e-4 by golden section over
    stored scores."""
    w, best = N.search_weight(_train_scored(spark, sf), "s_a", "s_b", "y")
    return spark.createDataFrame([(w, best)], "w double, auc double").select(R("w").alias("w"), R("auc").alias("auc"))


def _fold_scores(df):
    """Deterministic per-(seed, fold) test scores standing in for the
    models of a 3-seed x 5-fold run."""
    sf_ = df.crossJoin(F.broadcast(df.sparkSession.createDataFrame(
        [(s, f) for s in (11, 42, 99) for f in range(5)], ["seed", "fold"])))  # 15 rows
    noise = ((F.col("id") * 7919 + F.col("seed") * 31 + F.col("fold") * 17) % 1009) / F.lit(1009.0)
    return sf_.withColumn("p", F.lit(0.9) * F.col("s_a") + F.lit(0.1) * noise)


@query("fold_average", with_base(
    "select cast(id as bigint) as id, round(avg(p_seed), 6) as score from (select id, seed, avg(p) as p_seed from "
    "(select id, seed, fold, 0.9 * s_a + 0.1 * (((id * 7919 + seed * 31 + fold * 17) % 1009) / 1009.0) as p from scored, "
    "(select unnest([11, 42, 99]) as seed), (select range as fold from range(5)) where role = 'test') x group by id, seed) y group by id"))
def q_fold_average(spark, sf):
    """Test scores averaged over the 5 fold models, then over 3 seeds."""
    t = T.scored(spark, sf).filter(F.col("role") == "test").select("id", "s_a")
    p = _fold_scores(t)
    per_seed = p.groupBy("id", "seed").agg(F.avg("p").alias("p_seed"))
    return per_seed.groupBy("id").agg(R(F.avg("p_seed")).alias("score")).select(L("id").alias("id"), "score")


@query("model_corr", with_base(
    "select round(c, 6) as corr, case when c > 0.9 then 'high' when c < 0.7 then 'low' else 'moderate' end as verdict "
    "from (select corr(s_a, s_b) as c from ts)", TRAIN_SCORED))
def q_model_corr(spark, sf):
    """Correlation of two models' scores with verdict bands."""
    c = _train_scored(spark, sf).agg(F.corr("s_a", "s_b").alias("c"))
    return c.select(R("c").alias("corr"), F.when(F.col("c") > 0.9, "high").when(F.col("c") < 0.7, "low")
                    .otherwise("moderate").alias("verdict"))


@query("error_overlap", with_base(
    "select cast(sum(case when ra and rb then 1 else 0 end) as bigint) as both_right, "
    "cast(sum(case when not ra and not rb then 1 else 0 end) as bigint) as both_wrong, "
    "cast(sum(case when ra and not rb then 1 else 0 end) as bigint) as only_a, "
    "cast(sum(case when not ra and rb then 1 else 0 end) as bigint) as only_b, "
    "round(avg(cast(ra as double)), 6) as acc_a, round(avg(cast(rb as double)), 6) as acc_b, "
    "round(avg(cast(ra <> rb as double)), 6) as complementarity "
    "from (select cast(s_a > 0.5 as int) = y as ra, cast(s_b > 0.5 as int) = y as rb from ts)", TRAIN_SCORED))
def q_error_overlap(spark, sf):
    """Both right / both wrong / only A / only B at .5, accuracies and
    complementarity."""
    o = N.error_overlap(_train_scored(spark, sf), "s_a", "s_b", "y")
    return o.select(*[L(c).alias(c) for c in ("both_right", "both_wrong", "only_a", "only_b")],
                    *[R(c).alias(c) for c in ("acc_a", "acc_b", "complementarity")])


@query("calibration", with_base(
    "select m, cast(bin as bigint) as bin, round(avg(p), 6) as mean_pred, round(avg(y), 6) as pos_share, "
    "cast(count(*) as bigint) as n from (select m, p, y, greatest(ceil(p * 20) - 1, 0) as bin from "
    "(select 's_a' as m, s_a as p, y from ts union all select 's_b', s_b, y from ts)) group by m, bin", TRAIN_SCORED))
def q_calibration(spark, sf):
    """20-bin calibration curve for two scores, empty bins dropped."""
    t = _train_scored(spark, sf)
    out = None
    for m in ("s_a", "s_b"):
        c = N.calibration(t.select(F.col(m).alias("p"), "y"), "p", "y").withColumn("m", F.lit(m))
        out = c if out is None else out.unionByName(c)
    return out.select("m", L("bin").alias("bin"), R("mean_pred").alias("mean_pred"), R("pos_share").alias("pos_share"),
                      L("n").alias("n"))


@query("score_summary", with_base(
    "select m, cls, round(min(p), 6) as min, round(max(p), 6) as max, round(avg(p), 6) as mean, round(stddev_pop(p), 6) as std, "
    "round(avg(cast(p > 0.5 as double)), 6) as share_gt_05 from (select m, p, 'all' as cls from u union all "
    "select m, p, cast(y as varchar) from u) group by m, cls",
    TRAIN_SCORED + ",\nu as (select 's_a' as m, s_a as p, y from ts union all select 's_b', s_b, y from ts)"))
def q_score_summary(spark, sf):
    """Prediction distribution overall and by true class."""
    t = _train_scored(spark, sf)
    u = t.select(F.explode(F.array(F.struct(F.lit("s_a").alias("m"), F.col("s_a").alias("p"), F.col("y").alias("y")),
                                   F.struct(F.lit("s_b").alias("m"), F.col("s_b").alias("p"), F.col("y").alias("y"))))
                 .alias("r")).select("r.*")
    u2 = u.select("m", "p", F.explode(F.array(F.lit("all"), F.col("y").cast("string"))).alias("cls"))
    s = N.score_summary(u2, "p", ["m", "cls"])
    return s.select("m", "cls", *[R(c).alias(c) for c in ("min", "max", "mean", "std", "share_gt_05")])


@query("log_loss", with_base(
    "select m, round(avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))), 6) "
    "as log_loss from (select 's_a' as m, s_a as p, y from ts union all select 's_b', s_b, y from ts) group by m", TRAIN_SCORED))
def q_log_loss(spark, sf):
    """Log-loss of two scores."""
    t = _train_scored(spark, sf)
    out = None
    for m in ("s_a", "s_b"):
        c = N.log_loss(t.select(F.col(m).alias("p"), "y"), "p", "y").withColumn("m", F.lit(m))
        out = c if out is None else out.unionByName(c)
    return out.select("m", R("log_loss").alias("log_loss"))


SMOOTHINGS = [1, 3, 5, 10]


@query("smoothing_sweep", with_base(
    "select cast(m as bigint) as m, cast(f as bigint) as fold, col, value, round((s + m * p) / (n + m), 6) as enc from ("
    + " union all ".join(
        f"select fl.f, '{c}' as col, x.{c} as value, sum(case when x.fold <> fl.f then 1 else 0 end) as n, "
        f"sum(case when x.fold <> fl.f then x.y else 0 end) as s from folds x cross join fl group by fl.f, x.{c}"
        for c in TE_COLS) + ") st join lab on lab.f = st.f cross join (select unnest([" + ", ".join(map(str, SMOOTHINGS))
    + "]) as m) mm",
    TE_BASE + ",\n" + FOLDS_SQL + ",\nfl as (select range as f from range(5)),\n"
    "lab as (select fl.f as lf, sum(case when x.fold <> fl.f then x.y else 0 end) * 1.0e0 / "
    "sum(case when x.fold <> fl.f then 1 else 0 end) as p from folds x cross join fl group by fl.f)").replace(
    "join lab on lab.f = st.f", "join lab on lab.lf = st.f"))
def q_smoothing_sweep(spark, sf):
    """Per-fold encodings for every smoothing m in {1, 3, 5, 10} from
    one (col, value, fold) aggregate, exploded over m."""
    tr, _ = _train_folds(spark, sf)
    st = E.label_stats(tr, TE_COLS, ["fold"])
    fit = E.exclude_each(st, ["col", "value"], "fold", range(K_OUTER))
    lab = tr.groupBy("fold").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").cast("double").alias("s"))
    lab = lab.withColumn("col", F.lit("_")).withColumn("value", F.lit("_"))
    pr = E.exclude_each(lab, ["col", "value"], "fold", range(K_OUTER)).select(
        "fold", (F.col("s") / F.col("n")).alias("p"))
    ms = F.explode(F.array(*[F.lit(float(m)) for m in SMOOTHINGS])).alias("m")
    x = fit.join(F.broadcast(pr), "fold").select("*", ms)
    return x.select(L("m").alias("m"), L("fold").alias("fold"), "col", "value",
                    R((F.col("s") + F.col("m") * F.col("p")) / (F.col("n") + F.col("m"))).alias("enc"))


THRESHOLDS = [0.90, 0.92, 0.95, 0.97, 0.99, 0.995, 0.998]


@query("threshold_sweep", with_base(
    "select round(t, 6) as threshold, cast(sum(case when s_p > t or s_p < 1 - t then 1 else 0 end) as bigint) as n_pseudo, "
    "round(avg(case when s_p > t or s_p < 1 - t then 1.0 else 0.0 end), 6) as pct_pseudo, "
    "round(sum(case when (s_p > t or s_p < 1 - t) and cast(s_p > 0.5 as int) = y_sig then 1 else 0 end) * 1.0e0 / "
    "nullif(sum(case when s_p > t or s_p < 1 - t then 1 else 0 end), 0), 6) as agree_rate "
    f"from (select *, {SP_SQL} as s_p from scored) p, (select unnest([" + ", ".join(f"{t!r}" for t in THRESHOLDS)
    + "]::double[]) as t) where role = 'test' group by t"))
def q_threshold_sweep(spark, sf):
    """Pseudo-label count, share and label agreement for several
    confidence thresholds in one conditional-aggregation pass."""
    te = T.scored(spark, sf).filter(F.col("role") == "test").select("y_sig", F.expr(SP_SQL).alias("s_p"))
    tt = spark.createDataFrame([(float(t),) for t in THRESHOLDS], ["t"])
    x = te.crossJoin(F.broadcast(tt))  # 7 rows
    conf = (F.col("s_p") > F.col("t")) | (F.col("s_p") < 1 - F.col("t"))
    agree = conf & ((F.col("s_p") > 0.5).cast("int") == F.col("y_sig"))
    g = x.groupBy("t").agg(F.sum(conf.cast("int")).alias("n"), F.avg(conf.cast("double")).alias("pct"),
                           F.sum(agree.cast("int")).alias("k"))
    return g.select(R("t").alias("threshold"), L("n").alias("n_pseudo"), R("pct").alias("pct_pseudo"),
                    R(F.try_divide(F.col("k").cast("double"), F.col("n"))).alias("agree_rate"))


@query("topk_report", with_base(
    "select feature, auc_adj, cast(rk as bigint) as rank, cast(feature like '%pri%' as bigint) as is_named from ("
    "select feature, round(greatest(auc, 1 - auc), 6) as auc_adj, row_number() over (order by round(greatest(auc, 1 - auc), 6) desc, feature) as rk "
    "from au) where rk <= 5", ",\n".join(_strength_sql_src() + [f"au as ({_auc_named_sql()})"])))
def q_topk_report(spark, sf):
    """Top-5 features by single-feature AUC with their rank
    and a flag for names containing a substring (sort + limit on the small
    per-feature table)."""
    from pyspark.sql import Window
    a = _strength_frame(spark, sf).select("feature", R("auc_adj").alias("auc_adj"))
    w = Window.orderBy(F.desc("auc_adj"), "feature")  # one row per feature
    r = a.select("feature", "auc_adj", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= 5)
    return r.select("feature", "auc_adj", L("rank").alias("rank"), L(F.col("feature").contains("pri")).alias("is_named"))


# ---------------------------------------------------------------- step 11

@query("missing_report", with_base(
    "select col, cast(n_missing as bigint) as n_missing, cast(max(n_missing) over () as bigint) as max_missing from ("
    "select 'amt' as col, count(*) - count(try_cast(case when id % 50 = 0 then ' ' else cast(monthly as varchar) end as double)) as n_missing from accounts "
    "union all select 'pri_pad', count(*) - count(case when id % 37 = 0 then null else pri end) from accounts "
    "union all select 'monthly', count(*) - count(monthly) from accounts)"))
def q_missing_report(spark, sf):
    """Null count per column (raw values, before any fill) and the max."""
    from pyspark.sql import Window
    a = T.accounts(spark, sf).select(T.text_amount().try_cast("double").alias("amt"),
                                     T.padded_category().alias("pri_pad"), "monthly")
    cols = ["amt", "pri_pad", "monthly"]
    row = a.agg(*[(F.count(F.lit(1)) - F.count(c)).alias(c) for c in cols])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("n_missing"))
                                          for c in cols])).alias("r")).select("r.*")
    w = Window.partitionBy()  # 3-row table
    return long.select("col", L("n_missing").alias("n_missing"), L(F.max("n_missing").over(w)).alias("max_missing"))


@query("class_balance", with_base(
    "select role, cast(y as bigint) as y, cast(count(*) as bigint) as n, "
    "round(count(*) / sum(count(*)) over (partition by role), 6) as share from accounts group by role, y"))
def q_class_balance(spark, sf):
    """label counts and shares per role."""
    from pyspark.sql import Window
    g = T.accounts(spark, sf).groupBy("role", "y").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("role")  # 6-row table
    return g.select("role", L("y").alias("y"), L("n").alias("n"), R(F.col("n") / F.sum("n").over(w)).alias("share"))


# ---------------------------------------------------------------- step 9 (rows-only: fitted models)

from . import sweep as SW  # noqa: E402
from . import train as TR  # noqa: E402

MODEL_FOLDS = 3
MODEL_FEATURES = ["tenure", "monthly", "total", "n_items", "svc_yes_count", "is_urgent", "ISYES_svc_return",
                  "charges_deviation", "tenure_mod12"]


def _model_frame(spark, sf):
    s = T.scored(spark, sf)
    feats = {f.name: f for g in S.GROUPS.values() for f in g}
    cols = [feats[n].col().cast("double").alias(n) for n in MODEL_FEATURES if n in feats]
    base = [F.col(n).cast("double").alias(n) for n in MODEL_FEATURES if n not in feats]
    # stored: the folds' offsets, the train and the test rows read it
    x = cut_lineage(s.select("id", "role", F.col("y_sig").alias("y"), *base, *cols), "model-rows")
    tr = K.stratified_folds(x.filter(F.col("role") == "train"), MODEL_FOLDS, SEED)
    return tr, x.filter(F.col("role") == "test")


@query("gbt_oof")
def q_gbt_oof(spark, sf):
    """Boosted trees out of fold (3 folds, 10
    trees, early stopping on the held-out fold), OOF scores for train rows
    and fold-averaged test scores."""
    tr, te = _model_frame(spark, sf)
    scored, _ = TR.oof_scores(tr, te, MODEL_FEATURES, "y", lambda: TR.gbt("y", 10, 4, validation_col="_is_val"),
                              range(MODEL_FOLDS), early_stop=True)
    return TR.assemble_oof(scored)


@query("gbt_fold_report")
def q_gbt_fold_report(spark, sf):
    """Per-fold model size (trees kept after early stopping) and
    validation AUC of the boosted-tree OOF run."""
    tr, te = _model_frame(spark, sf)
    _, rep = TR.oof_scores(tr, te, MODEL_FEATURES, "y", lambda: TR.gbt("y", 10, 4, validation_col="_is_val"),
                           range(MODEL_FOLDS), early_stop=True)
    return rep


@query("logreg_oof")
def q_logreg_oof(spark, sf):
    """Standardised logistic regression with balanced class
    weights, out of fold."""
    tr, te = _model_frame(spark, sf)
    scored, _ = TR.oof_scores(tr, te, MODEL_FEATURES, "y", lambda n: TR.logreg("y", "w", c=1.0, n_fit=n),
                              range(MODEL_FOLDS), scale=True, balanced="w")
    return TR.assemble_oof(scored)


def _encoded_frame(spark, sf):
    """Fold encodings joined to the plain features: what a model per fold
    fits on and scores."""
    s = cut_lineage(T.scored(spark, sf).select("id", "role", F.col("y_sig").alias("y"), *TE_MODEL_COLS,
                                               *[F.col(c).cast("double").alias(c) for c in TE_PLAIN]), "model-rows")
    tr = cut_lineage(K.stratified_folds(s.filter(F.col("role") == "train"), MODEL_FOLDS, SEED), "model-train")
    te = s.filter(F.col("role") == "test")
    plain = tr.select("id", "y", *TE_PLAIN).unionByName(te.select("id", F.lit(None).cast("int").alias("y"), *TE_PLAIN))
    return cut_lineage(E.encode_per_fold(tr.select("id", "y", "fold", *TE_MODEL_COLS), te, TE_MODEL_COLS, MODEL_FOLDS,
                                         {"te": E.smoothed(20)}, joined=plain), "model-encodings")


TE_MODEL_COLS = ["pri", "seg", "nation", "svc_return", "svc_keep"]
TE_PLAIN = ["n_items", "monthly"]
TE_FEATURES = [f"te_{c}" for c in TE_MODEL_COLS] + TE_PLAIN


@query("te_models_oof")
def q_te_models_oof(spark, sf):
    """I2 + L1 / L2 / L5 / A7 / A5: per fold, encodings fitted on the other
    folds feed a boosted-tree and a logistic model, which score the fold and
    the test rows; one stored encoding table serves both models.  Columns
    gbt, logreg and their mean, blend."""
    rows = _encoded_frame(spark, sf)
    g = TR.assemble_oof(TR.encoded_scores(rows, TE_FEATURES, "y", lambda: TR.gbt("y", 10, 4), range(MODEL_FOLDS)))
    lr = TR.assemble_oof(TR.encoded_scores(rows, TE_FEATURES, "y", lambda n: TR.logreg("y", "w", c=1.0, n_fit=n),
                                           range(MODEL_FOLDS), scale=True, balanced="w"))
    return g.withColumnRenamed("score", "gbt").join(lr.withColumnRenamed("score", "logreg"), ["id", "part"]).withColumn(
        "blend", (F.col("gbt") + F.col("logreg")) / 2)


@query("oof_assembly", with_base(
    "select cast(id as bigint) as id, 'oof' as part, round(s_a + fold / 100.0, 6) as score from folds "
    "union all select cast(id as bigint), 'test', round(s_a + 0.02, 6) from te_base where role = 'test'",
    TE_BASE + ",\n" + FOLDS_SQL))
def q_oof_assembly(spark, sf):
    """Out-of-fold scores and fold-averaged test scores, assembled
    from fixed per-fold scores."""
    a = T.with_scores(_te_frame(spark, sf, more=("tenure",)))
    tr = K.stratified_folds(a.filter(F.col("role") == "train"), 5, SEED)
    te = a.filter(F.col("role") == "test").crossJoin(
        spark.createDataFrame([(i,) for i in range(5)], "fold int"))  # five rows
    s = tr.select("id", F.lit("oof").alias("part"), "fold", (F.col("s_a") + F.col("fold") / 100.0).alias("score"))
    s = s.unionByName(te.select("id", F.lit("test").alias("part"), "fold", (F.col("s_a") + F.col("fold") / 100.0).alias("score")))
    o = TR.assemble_oof(s)
    return o.select(L("id").alias("id"), "part", R("score").alias("score"))


#: stopping on AUC: boosting rounds, and rounds without a new best
ROUNDS, PATIENCE = 12, 4
CAT_FEATURES = ["pri", "seg", "nation", "svc_return", "svc_late"]
CAT_NUMBERS = ["tenure", "monthly", "total", "n_items"]


@query("best_iteration", with_base(f"""
select cast(fold as bigint) as fold, cast(best_iteration as bigint) as best_iteration, round(best_auc, 6) as best_auc,
  cast(stop as bigint) as stopped_at, round(last_auc, 6) as last_auc from (
  select fold, stop, arg_max(iteration, (auc, -iteration)) as best_iteration, max(auc) as best_auc,
    max(case when iteration = stop then auc end) as last_auc
  from (select *, coalesce(min(case when iteration - top_at >= 2 then iteration end) over (partition by fold),
          max(iteration) over (partition by fold)) as stop
        from (select *, (select min(b.iteration) from au b where b.fold = a.fold and b.iteration <= a.iteration
                and b.auc = (select max(c.auc) from au c where c.fold = a.fold and c.iteration <= a.iteration)) as top_at from au a) x) y
  where iteration <= stop group by fold, stop) z""",
    SIG_FOLDS_SQL + ",\nmarg as (select fold, y_sig, i as iteration, list_sum(margins[:i]) as m from (select fold, y_sig, ["
    + ", ".join(f"((s_a - 0.5) / {j} + (((id * {7919 + 31 * j}) % 1009) / 1009.0 - 0.5) * {0.03 * j * j!r})::double" for j in range(1, 9))
    + "] as margins from sf) x, range(1, 9) r(i)),\n"
    "au as (select fold, iteration, (sum(case when y_sig = 1 then ra else 0 end) - sum(y_sig) * (sum(y_sig) + 1) / 2.0) "
    "/ (sum(y_sig) * (count(*) - sum(y_sig))) as auc from (select fold, iteration, y_sig, cast(rank() over (partition by fold, iteration "
    "order by m) as double) + (cast(count(*) over (partition by fold, iteration, m) as double) - 1) / 2 as ra from marg) r group by fold, iteration)"))
def q_best_iteration(spark, sf):
    """Best iteration by validation AUC with stopping after two rounds
    without a new best, per fold, from fixed margins of eight rounds that
    first gain and then lose."""
    sc = T.accounts_once(spark, sf, scores=True, columns=["id", "role", "s_a", "y_sig"]).filter(F.col("role") == "train")
    f = K.stratified_folds(sc, 5, SEED, label="y_sig")
    noise = [(F.col("id") * (7919 + 31 * j)) % 1009 / F.lit(1009.0) - 0.5 for j in range(1, 9)]
    each = [(F.col("s_a") - 0.5) / j + noise[j - 1] * (0.03 * j * j) for j in range(1, 9)]
    sums = [reduce(lambda a, b: a + b, each[:j]) for j in range(1, 9)]
    best = TR.best_iterations(TR.staged_auc(f.select("fold", "y_sig", F.array(*sums).alias("margins")), "y_sig", ["fold"]), ["fold"], 2)
    return best.select(*[L(c).alias(c) for c in ("fold", "best_iteration", "stopped_at")], R("best_auc").alias("best_auc"),
                       R("last_auc").alias("last_auc"))


def _stopped_on_encodings(rows, rounds: int = ROUNDS, depth: int = 3, step: float = 0.3):
    """The encoded rows of every fold, boosted with stopping on the fold's AUC."""
    parts = {f: (rows.filter((F.col("fold") == f) & (F.col("part") == "fit")),
                 rows.filter((F.col("fold") == f) & (F.col("part") != "fit")).drop("fold")) for f in range(MODEL_FOLDS)}
    return TR.stopped_scores(parts, TR._stages(TE_FEATURES, False), lambda: TR.gbt("y", rounds, depth, step), "y", PATIENCE)


@query("gbt_stopped_oof")
def q_gbt_stopped_oof(spark, sf):
    """Boosted trees on each fold's encodings, cut at the
    iteration of best validation AUC; OOF scores and averaged test scores."""
    scores, _ = _stopped_on_encodings(_encoded_frame(spark, sf))
    return TR.assemble_oof(scores.withColumn("part", F.when(F.col("part") == "valid", "oof").otherwise("test")))


@query("gbt_best_iteration")
def q_gbt_best_iteration(spark, sf):
    """Best iteration and AUC per fold of the run above, and of a
    longer one with smaller steps (L2's long training)."""
    out, rows = None, _encoded_frame(spark, sf)
    for name, run in (("standard", {}), ("long", {"rounds": 2 * ROUNDS, "step": 0.1})):
        d = _stopped_on_encodings(rows, **run)[1].withColumn("training", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out.select("training", *[L(c).alias(c) for c in ("fold", "best_iteration", "stopped_at")], "best_auc", "last_auc")


def _rebalanced_models(spark, sf):
    """(scores, report) of one model per rebalanced set: categories unencoded,
    a fifth of each set held out, stopping on its AUC."""
    s = T.accounts_once(spark, sf, scores=True, columns=["id", "role", "y_sig", *CAT_FEATURES, *CAT_NUMBERS])
    s = s.withColumn("y", F.col("y_sig")).drop("y_sig")
    tr, te = s.filter(F.col("role") == "train"), s.filter(F.col("role") == "test")
    sets = K.rebalanced_sets(tr.select("id", "y"), 5, PER_OTHER_SHARE, SEED).select("set_id", "id")
    rows = K.stratified_holdout(sets.join(tr, "id"), 0.2, SEED, segments=["set_id"])
    rows = cut_lineage(rows.withColumn("part", F.when(F.col("is_valid") == 1, "valid").otherwise("fit")).drop("is_valid"), "sets")
    te = te.withColumn("part", F.lit("test"))
    keep = ["id", "part", "y", *CAT_FEATURES, *CAT_NUMBERS]
    parts = {i: (rows.filter((F.col("set_id") == i) & (F.col("part") == "fit")),
                 rows.filter((F.col("set_id") == i) & (F.col("part") == "valid")).select(*keep).unionByName(te.select(*keep)))
             for i in range(1, 6)}
    return TR.stopped_scores(parts, TR.categorical_stages(CAT_FEATURES, CAT_NUMBERS), lambda: TR.gbt("y", 10, 4, 0.3), "y",
                             PATIENCE, segment="set_id")


@query("rebalanced_gbt")
def q_rebalanced_gbt(spark, sf):
    """L6 + K6: one boosted-tree model with native categories per rebalanced
    set, stopped on the AUC of the set's held-out part, test scores averaged
    over the five sets."""
    scores, _ = _rebalanced_models(spark, sf)
    return scores.filter(F.col("part") == "test").groupBy("id").agg(F.avg("score").alias("score"))


@query("rebalanced_report")
def q_rebalanced_report(spark, sf):
    """L6 + L7: best iteration and held-out AUC of each rebalanced set's model."""
    _, report = _rebalanced_models(spark, sf)
    return report.select(*[L(c).alias(c) for c in ("set_id", "best_iteration", "stopped_at")], "best_auc", "last_auc")


PSEUDO_GBT_T = 0.9


def _pseudo_rounds(spark, sf):
    """Both rounds of every fold.  Returns (stored scores (round, fold, id,
    part, score, y), decisions (fold, auc_round1, auc_round2, keep_pseudo,
    auc_kept)): round 2 is kept if its AUC on the fold is higher."""
    tr, te = _model_frame(spark, sf)
    asm = TR.VectorAssembler(inputCols=MODEL_FEATURES, outputCol="features", handleInvalid="keep")
    tr_v, te_v = cut_lineage(asm.transform(tr)), cut_lineage(asm.transform(te))

    def both(f: int) -> DataFrame:
        fit, val = tr_v.filter(F.col("fold") != f), tr_v.filter(F.col("fold") == f)

        def score(model, n):
            every = val.select("id", "y", "features", F.lit("oof").alias("part")).unionByName(
                te_v.select("id", F.lit(None).cast("int").alias("y"), "features", F.lit("test").alias("part")))
            return cut_lineage(TR._prob(model.transform(every)).select(
                F.lit(n).alias("round"), F.lit(f).alias("fold"), "id", "part", "score", "y"), "round")

        first = score(TR.fit_ready(TR.gbt("y", 8, 4), fit, ["features", "y"]), 1)
        sure = first.filter((F.col("part") == "test") & ((F.col("score") > PSEUDO_GBT_T) | (F.col("score") < 1 - PSEUDO_GBT_T)))
        if sure.isEmpty():
            return first
        pseudo = te_v.select("id", "features").join(sure.select("id", (F.col("score") > 0.5).cast("int").alias("y")), "id")
        more = fit.select("features", "y").unionByName(pseudo.select("features", "y"))
        return first.unionByName(score(TR.fit_ready(TR.gbt("y", 8, 4), more, ["features", "y"]), 2))

    scores = reduce(DataFrame.unionByName, TR.in_parallel([lambda f=f: both(f) for f in range(MODEL_FOLDS)], 2))
    aucs = G.auc(scores.filter(F.col("part") == "oof"), "score", "y", ["fold", "round"])
    by = aucs.groupBy("fold").agg(*[F.max(F.when(F.col("round") == r, F.col("auc"))).alias(f"auc_round{r}") for r in (1, 2)])
    keep = F.coalesce(F.col("auc_round2") > F.col("auc_round1"), F.lit(False))
    by = by.select(F.col("fold").cast("int").alias("fold"), "auc_round1", "auc_round2", keep.alias("keep_pseudo"),
                   F.when(keep, F.col("auc_round2")).otherwise(F.col("auc_round1")).alias("auc_kept"))
    return scores, cut_lineage(by, "decisions")


@query("pseudo_gbt")
def q_pseudo_gbt(spark, sf):
    """K8: per fold, a second fit with confident test rows as pseudo
    labels; the pseudo round is kept only when the fold's AUC rises:
    validation AUC of both rounds and of the scores kept."""
    return _pseudo_rounds(spark, sf)[1]


@query("pseudo_gbt_scores")
def q_pseudo_gbt_scores(spark, sf):
    """K8: OOF scores and averaged test scores of the rounds kept; the
    decisions are joined to both rounds' stored scores."""
    scores, by = _pseudo_rounds(spark, sf)
    kept = by.select(F.col("fold").alias("d_fold"), F.when(F.col("keep_pseudo"), 2).otherwise(1).alias("d_round"))
    kept = scores.join(F.broadcast(kept), (F.col("fold") == F.col("d_fold")) & (F.col("round") == F.col("d_round")))  # a row per fold
    return TR.assemble_oof(kept)


REFIT_THRESHOLDS = [0.90, 0.92, 0.95, 0.97, 0.99]


def _threshold_refits(spark, sf):
    """Per threshold (0: no pseudo rows) the OOF scores of refitted models.
    Pseudo sets are nested, so a test row has one band, the number of
    thresholds that it passes, and every threshold's fit set is a filter."""
    tr, te = _model_frame(spark, sf)
    asm = TR.VectorAssembler(inputCols=MODEL_FEATURES, outputCol="features", handleInvalid="keep")
    tr_v = cut_lineage(asm.transform(tr).select("id", "y", "fold", "features"), "refit-train")
    te_v = cut_lineage(asm.transform(te).select("id", "features"), "refit-test")

    def model(fit):
        return TR.fit_ready(TR.gbt("y", 6, 4, 0.3), fit, ["y", "features"])

    def oof(m, f):
        return TR._prob(m.transform(tr_v.filter(F.col("fold") == f))).select("id", "y", "score")

    def first(f):
        m = model(tr_v.filter(F.col("fold") != f))
        cut_lineage(oof(m, f), "refit-base").write.mode("overwrite").parquet(f"{path}/band=0/fold={f}")
        return cut_lineage(TR._prob(m.transform(te_v)).select("id", "score"), "refit-test-scores")

    path = scratch_path(spark, "refits")
    tests = reduce(DataFrame.unionByName, TR.in_parallel([lambda f=f: first(f) for f in range(MODEL_FOLDS)], 3))
    mean = tests.groupBy("id").agg(F.avg("score").alias("score"))
    band = sum(((F.col("score") > t) | (F.col("score") < 1 - t)).cast("int") for t in REFIT_THRESHOLDS)
    pseudo = cut_lineage(te_v.join(mean, "id").select("id", "features", (F.col("score") > 0.5).cast("int").alias("y"),
                                                      band.alias("band")), "refit-pseudo")
    n = {r["band"]: r["count"] for r in pseudo.groupBy("band").count().collect()}  # a row per band
    total = sum(n.values())
    size = {j: sum(v for b, v in n.items() if b >= j) for j in range(1, len(REFIT_THRESHOLDS) + 1)}

    def again(j, f):
        return oof(model(tr_v.filter(F.col("fold") != f).select("y", "features").unionByName(
            pseudo.filter(F.col("band") >= j).select("y", "features"))), f)

    jobs = {(j, f): (lambda j=j, f=f: again(j, f)) for j in size if size[j] for f in range(MODEL_FOLDS)}
    scores = TR.scored_by(jobs, ("band", "fold"), path, spark, 4)
    return scores, size, total


@query("threshold_refits")
def q_threshold_refits(spark, sf):
    """Pseudo-label threshold sweep with refits: count and share of
    pseudo rows, OOF AUC, and its gain over the fit without any; a threshold
    that no row passes has no AUC."""
    scores, size, total = _threshold_refits(spark, sf)
    aucs = G.auc(scores, "score", "y", ["band"]).select("band", "auc")
    sweep = spark.createDataFrame([(j, t, size[j], size[j] / total if total else None) for j, t in enumerate(REFIT_THRESHOLDS, 1)],
                                  "j int, threshold double, n_pseudo long, pct_pseudo double")
    base = aucs.filter("band = 0").select(F.col("auc").alias("base_auc"))  # one row
    d = sweep.join(aucs, F.col("j") == F.col("band"), "left").crossJoin(F.broadcast(base))
    return d.select("threshold", "n_pseudo", "pct_pseudo", F.col("auc").alias("oof_auc"), "base_auc",
                    (F.col("auc") - F.col("base_auc")).alias("improvement"))


@query("feature_importance")
def q_feature_importance(spark, sf):
    """Gain importances sorted, with rank and a name flag."""
    from pyspark.sql import Window
    tr, _ = _model_frame(spark, sf)
    imp = TR.importances(tr, MODEL_FEATURES, "y", TR.gbt("y", 10, 4))
    w = Window.orderBy(F.desc("importance"), "feature")  # one row per feature
    return imp.select("feature", "importance", F.row_number().over(w).alias("rank"),
                      F.col("feature").contains("svc").cast("int").alias("is_named"))


# ---------------------------------------------------------------- step 11: sources / sinks round trips

from ..session import scratch_path  # noqa: E402
from ..sources import sinks as SK  # noqa: E402
from pyspark.sql import types as PT  # noqa: E402

CSV_SCHEMA = PT.StructType([
    PT.StructField("id", PT.LongType()), PT.StructField("role", PT.StringType()),
    PT.StructField("pri", PT.StringType()), PT.StructField("tenure", PT.IntegerType()),
    PT.StructField("monthly", PT.DoubleType()), PT.StructField("amount_text", PT.StringType())])


@query("csv_roundtrip", with_base(
    "select cast(id as bigint) as id, role, pri, cast(tenure as bigint) as tenure, round(monthly, 6) as monthly, "
    "round(try_cast(case when id % 50 = 0 then ' ' else cast(monthly as varchar) end as double), 6) as amount "
    "from accounts"))
def q_csv_roundtrip(spark, sf):
    """A1 + C1: CSV with header written to the shared folder and scanned
    back with a declared schema (no inference); blank text -> null."""
    a = T.accounts(spark, sf).select("id", "role", "pri", "tenure", "monthly", T.text_amount().alias("amount_text"))
    path = scratch_path(spark, "csv")
    a.write.mode("overwrite").option("header", True).csv(path)
    b = T.read_csv_table(spark, path, CSV_SCHEMA)
    return b.select(L("id").alias("id"), "role", "pri", L("tenure").alias("tenure"), R("monthly").alias("monthly"),
                    R(F.col("amount_text").try_cast("double")).alias("amount"))


@query("feature_sink_roundtrip", _feature_table_sql("core", False).replace(
    " from accounts", " from accounts where role = 'train'"))
def q_feature_sink_roundtrip(spark, sf):
    """A2 / A3: feature table written partitioned by role, the train role
    read back (partition pruning) with id and label."""
    ft = _feature_table(spark, sf, "core", False)
    path = SK.write_feature_table(ft, scratch_path(spark, "features"))
    return SK.read_feature_table(spark, path, "train").select(*ft.columns)


@query("prediction_sink_roundtrip", REGISTRY["fold_average"][1].replace(
    "round(avg(p_seed), 6) as score", "round(avg(p_seed), 6) as Churn"))
def q_prediction_sink_roundtrip(spark, sf):
    """A4 / A5: keyed prediction table (id, Churn) written and re-read."""
    p = REGISTRY["fold_average"][0](spark, sf)
    path = SK.write_predictions(p, scratch_path(spark, "predictions"))
    return spark.read.parquet(path)


@query("oof_sink_roundtrip", with_base(
    "select cast(id as bigint) as id, round(s_a, 6) as xgb, round(s_b, 6) as lgb, round((s_a + s_b) / 2, 6) as blend from ts",
    TRAIN_SCORED))
def q_oof_sink_roundtrip(spark, sf):
    """A5: keyed OOF table of two models and their blend written and re-read."""
    t = _train_scored(spark, sf).withColumn("mean", (F.col("s_a") + F.col("s_b")) / 2)
    path = SK.write_scores(t, scratch_path(spark, "oof"), {"s_a": "xgb", "s_b": "lgb", "mean": "blend"})
    return spark.read.parquet(path).select(L("id").alias("id"), *[R(c).alias(c) for c in ("xgb", "lgb", "blend")])


@query("conditional_update", with_base(
    "select cast(id as bigint) as id, round(s_a * (case when tenure > 60 then 0.5 else 1.0 end) "
    "* (case when svc_return = 'No' then 0.5 else 1.0 end), 6) as p from scored where role = 'test'"))
def q_conditional_update(spark, sf):
    """Two masked in-place halvings of a prediction, as a product of
    when/otherwise factors."""
    s = T.scored(spark, sf).filter(F.col("role") == "test")
    f1 = F.when(F.col("tenure") > 60, 0.5).otherwise(1.0)
    f2 = F.when(F.col("svc_return") == "No", 0.5).otherwise(1.0)
    return s.select(L("id").alias("id"), R(F.col("s_a") * f1 * f2).alias("p"))


def _numeric_feats():
    return [f for f in S.feature_set("full") if f.kind != "string"]


@query("feature_table_numeric", with_base(
    "select cast(id as bigint) as id, cast(tenure as bigint) as tenure, round(monthly, 6) as monthly, "
    "round(total, 6) as total, cast(n_items as bigint) as n_items, " + ", ".join(S.sql_out(f) for f in _numeric_feats()) + " from accounts"))
def q_feature_table_numeric(spark, sf):
    """Model matrix: the full feature table with id / label / role
    and every leftover string column dropped by schema."""
    from pyspark.sql.types import StringType
    ft = _feature_table(spark, sf, "full", True)
    strings = [f.name for f in ft.schema.fields if isinstance(f.dataType, StringType)]
    return ft.drop(*strings, "y")


GS_COLS = ["tenure", "monthly", "total", "n_items"]


@query("global_stats", with_base(" union all ".join(
    f"select '{c}' as col, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(min({c}), 6) as min, "
    f"round(max({c}), 6) as max, cast(count(distinct {c}) as bigint) as nunique from accounts" for c in GS_COLS)))
def q_global_stats(spark, sf):
    """global scalar statistics per column in one pass."""
    long = G.unpivot_numeric(T.accounts(spark, sf), GS_COLS, [])
    g = long.groupBy("col").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                F.min("value").alias("min"), F.max("value").alias("max"),
                                F.countDistinct("value").alias("nunique"))
    return g.select("col", *[R(c).alias(c) for c in ("mean", "std", "min", "max")], L("nunique").alias("nunique"))


@query("gbt_variants")
def q_gbt_variants(spark, sf):
    """L3 / L4: regularised (depth 1, min 3 rows per node), pruned (depth 4,
    minimum gain .5), deep (depth 8) and class-weighted boosted trees,
    out of fold; validation AUC per variant and fold."""
    tr, _ = _model_frame(spark, sf)
    asm = TR.VectorAssembler(inputCols=MODEL_FEATURES, outputCol="features", handleInvalid="keep")
    x = cut_lineage(asm.transform(tr.withColumn("w", F.when(F.col("y") == 1, SCALE_POS).otherwise(1.0))))
    variants = {"shallow": TR.gbt("y", 5, 1, min_instances=3), "pruned": TR.gbt("y", 5, 4, min_info_gain=0.5),
                "deep": TR.gbt("y", 5, 8), "weighted": TR.gbt("y", 5, 4, weight_col="w")}
    rows = []
    for name, est in variants.items():
        scored = None
        for f in range(MODEL_FOLDS):
            p = TR._prob(est.fit(x.filter(F.col("fold") != f)).transform(x.filter(F.col("fold") == f))).select(
                F.lit(name).alias("variant"), "fold", "score", "y")
            scored = p if scored is None else scored.unionByName(p)
        rows.append(scored)
    every = cut_lineage(reduce(DataFrame.unionByName, rows), "variants")
    return G.auc(every, "score", "y", ["variant", "fold"]).select("variant", L("fold").alias("fold"),
                                                                  F.col("auc").alias("val_auc"))


# ---------------------------------------------------------------- O3: cartesian parameter sweep

SWEEP_M = [1, 3, 5, 10, 20]
SWEEP_SETS = {"core": ["pri_u", "seg"], "full": TE_COLS}


def _sweep_sql():
    sig = ("te_sig as (select id, role, y_sig as y, case when role = 'test' and id % 97 = 0 then 'ZZZ' else pri end "
           "as pri_u, seg, nation, region, svc_return, tenure from scored)")
    folds = FOLDS_SQL.replace("folds as", "folds_s as").replace("from te_base", "from te_sig")
    ctes = [sig, folds, "fl as (select range as f from range(5))",
            "lab as (select fl.f as lf, sum(case when x.fold <> fl.f then x.y else 0 end) * 1.0e0 / "
            "sum(case when x.fold <> fl.f then 1 else 0 end) as p from folds_s x cross join fl group by fl.f)",
            "mm as (select unnest([" + ", ".join(map(str, SWEEP_M)) + "]) as m)"]
    sel = []
    for i, c in enumerate(TE_COLS):
        ctes.append(f"s{i} as (select fl.f, x.{c} as v, sum(case when x.fold <> fl.f then 1 else 0 end) as n, "
                    f"sum(case when x.fold <> fl.f then x.y else 0 end) as s from folds_s x cross join fl group by fl.f, x.{c})")
        sel.append(f"coalesce((s{i}.s + mm.m * lab.p) / (s{i}.n + mm.m), lab.p) as te_{c}")
    joins = " ".join(f"left join s{i} on s{i}.f = r.fold and s{i}.v = r.{c}" for i, c in enumerate(TE_COLS))
    ctes.append(f"enc as (select mm.m, r.id, r.y, r.tenure, {', '.join(sel)} from folds_s r cross join mm "
                f"join lab on lab.lf = r.fold {joins})")
    parts = []
    for name, cols in SWEEP_SETS.items():
        for keep in (0, 1):
            terms = [f"te_{c}" for c in cols] + (["(1 - tenure / 100.0)"] if keep else [])
            parts.append(f"select m, {keep} as keep_original, '{name}' as feature_set, y, "
                         f"({' + '.join(terms)}) / {len(terms)}.0 as s from enc")
    ctes.append("cfg as (" + " union all ".join(parts) + ")")
    body = ("select cast(m as bigint) as m, cast(keep_original as bigint) as keep_original, feature_set, "
            "round((sum(case when y = 1 then ra else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) "
            "as oof_auc from (select m, keep_original, feature_set, y, cast(rank() over (partition by m, keep_original, "
            "feature_set order by s) as double) + (cast(count(*) over (partition by m, keep_original, feature_set, s) as double)"
            " - 1) / 2 as ra from cfg) r group by m, keep_original, feature_set")
    return with_base(body, ",\n".join(ctes))


@query("param_sweep", _sweep_sql())
def q_param_sweep(spark, sf):
    """O3: smoothing x keep_original x feature_set (20 configurations) in one
    job: per-fold encodings for every smoothing from one aggregate, the
    validation rows scored by each configuration (mean of its encoded
    columns, plus the scaled month count when originals are kept), and
    OOF AUC grouped by configuration."""
    a = T.accounts_once(spark, sf, scores=True, columns=["id", "role", "pri", "tenure", "y_sig", *[
        c for c in TE_COLS if c != "pri_u"]]).withColumn("pri_u", T.unseen_category())
    tr = K.stratified_folds(a.filter(F.col("role") == "train").withColumn("y", F.col("y_sig")), 5, SEED)
    tr = cut_lineage(tr.select("id", "y", "fold", "tenure", *TE_COLS), "sweep_rows")
    st = E.label_stats(tr, TE_COLS, ["fold"])
    fit = E.exclude_each(st, ["col", "value"], "fold", range(5))
    lab = tr.groupBy("fold").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").cast("double").alias("s"))
    lab = lab.withColumn("col", F.lit("_")).withColumn("value", F.lit("_"))
    pr = E.exclude_each(lab, ["col", "value"], "fold", range(5)).select("fold", (F.col("s") / F.col("n")).alias("p"))
    ms = spark.createDataFrame([(float(m),) for m in SWEEP_M], ["m"])
    enc = (fit.join(F.broadcast(pr), "fold").crossJoin(F.broadcast(ms))  # k and |m| rows
           .select("m", "fold", "col", "value", ((F.col("s") + F.col("m") * F.col("p")) / (F.col("n") + F.col("m"))).alias("e")))
    enc = cut_lineage(enc, "sweep_enc")
    rows = tr.crossJoin(F.broadcast(ms)).join(F.broadcast(pr), "fold")
    for c in TE_COLS:
        t = enc.filter(F.col("col") == c).select("m", "fold", F.col("value").alias(f"_v_{c}"), F.col("e").alias(f"te_{c}"))
        rows = rows.withColumn(f"_v_{c}", F.col(c).cast("string")).join(t, ["m", "fold", f"_v_{c}"], "left")
        rows = rows.withColumn(f"te_{c}", F.coalesce(F.col(f"te_{c}"), F.col("p")))
    cfgs = []
    for name, cols in SWEEP_SETS.items():
        for keep in (0, 1):
            terms = [F.col(f"te_{c}") for c in cols] + ([1 - F.col("tenure") / 100.0] if keep else [])
            s = terms[0]
            for t_ in terms[1:]:
                s = s + t_
            cfgs.append(F.struct(F.lit(keep).alias("keep_original"), F.lit(name).alias("feature_set"),
                                 (s / float(len(terms))).alias("s")))
    long = rows.select("m", "y", F.explode(F.array(*cfgs)).alias("c")).select("m", "y", "c.*")
    out = G.auc(long, "s", "y", ["m", "keep_original", "feature_set"])
    return out.select(L("m").alias("m"), L("keep_original").alias("keep_original"), "feature_set",
                      R("auc").alias("oof_auc"))


@query("param_sweep_fits")
def q_param_sweep_fits(spark, sf):
    """O3: the 20 configurations (smoothing x keep originals x feature set)
    with a boosted model fitted for each and fold: every fold's encodings for
    all smoothings are one stored table, whose columns a configuration picks;
    its rows are counted in cells once, on which all models grow together
    (plans.sweep).  OOF AUC per configuration."""
    s = T.accounts_once(spark, sf, scores=True, columns=["id", "role", "pri", "tenure", "monthly", "y_sig", *[
        c for c in TE_COLS if c != "pri_u"]]).withColumn("pri_u", T.unseen_category()).withColumn("y", F.col("y_sig"))
    tr = cut_lineage(K.stratified_folds(s.filter(F.col("role") == "train"), MODEL_FOLDS, SEED), "sweep-train")
    plain = ["tenure", "monthly"]
    rows = cut_lineage(E.encode_per_fold(tr, tr.limit(0), TE_COLS, MODEL_FOLDS, {f"m{m}": E.smoothed(m) for m in SWEEP_M},
                                         prefix_fmt="te_{stat}_{col}", joined=tr.select("id", "y", *plain)), "sweep-encodings")

    scores = SW.sweep_scores(rows, SWEEP_SETS, [f"m{m}" for m in SWEEP_M], plain, "y", range(MODEL_FOLDS), TR.gbt("y", 4, 3, 0.3))
    scores = scores.select(F.expr("int(substring(encoding, 2))").alias("m"), F.col("keep").alias("keep_original"),
                           F.col("name").alias("feature_set"), "y", "score", "n")
    return G.auc(scores, "score", "y", ["m", "keep_original", "feature_set"], weight="n").select(
        L("m").alias("m"), L("keep_original").alias("keep_original"), "feature_set", F.col("auc").alias("oof_auc"))


@query("report_sink_roundtrip", REGISTRY["feature_group_strength"][1])
def q_report_sink_roundtrip(spark, sf):
    """A small report table (best feature per group) written as one CSV
    file with header and read back with its schema."""
    rep = REGISTRY["feature_group_strength"][0](spark, sf)
    path = SK.write_report(rep, scratch_path(spark, "report"))
    return spark.read.schema(rep.schema).option("header", True).csv(path)
