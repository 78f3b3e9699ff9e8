"""Row-wise feature registry (cleaning, math, digits, flags, counts, crosses).

Each feature is declared once with its Spark ``Column`` and the equivalent
SQL text used by the oracle; groups of features are what the reference's
scripts switch on and off (``core`` / ``full`` / keep originals).  All of
them are plain projections: they stay inside whole-stage codegen and never
shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import round6
from ..sources.tables import SERVICES


@dataclass(frozen=True)
class Feature:
    name: str
    col: Callable[[], Column]
    sql: str
    kind: str = "double"  # double | long | string


def c(n):
    return F.col(n)


def _nn(x):  # clip at zero before log / sqrt (G2)
    return F.greatest(x, F.lit(0.0))


def _pmod_sql(x, m):
    return f"((({x}) % {m}) + {m}) % {m}"


def _bround0(x):
    """Half-even rounding to an integer keeping the sign of zero (numpy's
    ``round(-0.4) == -0.0``)."""
    r = F.bround(x, 0)
    return F.when(r == 0, x * F.lit(0.0)).otherwise(r)


def _yes_count():
    return sum((c(s) == "Yes").cast("int") for s in SERVICES)


YES_COUNT_SQL = " + ".join(f"cast({s} = 'Yes' as int)" for s in SERVICES)


def _flag(e):
    return e.cast("long")


NUM_TRANSFORMS = [
    Feature("log1p_monthly", lambda: F.log1p(_nn(c("monthly"))), "ln(1 + greatest(monthly, 0))"),
    Feature("log1p_total", lambda: F.log1p(_nn(c("total"))), "ln(1 + greatest(total, 0))"),
    Feature("sqrt_monthly", lambda: F.sqrt(_nn(c("monthly"))), "sqrt(greatest(monthly, 0))"),
    Feature("inv1p_monthly", lambda: 1.0 / (1.0 + _nn(c("monthly"))), "1.0 / (1.0 + greatest(monthly, 0))"),
    Feature("sq_tenure", lambda: (c("tenure") * c("tenure")).cast("double"), "cast(tenure * tenure as double)"),
    Feature("sq_monthly", lambda: c("monthly") * c("monthly"), "monthly * monthly"),
    Feature("abs_monthly", lambda: F.abs(c("monthly")), "abs(monthly)"),
    Feature("sign_monthly", lambda: F.signum(c("monthly")), "cast(sign(monthly) as double)"),
    Feature("total_minus_monthly", lambda: c("total") - c("monthly"), "total - monthly"),
    Feature("tenure_x_monthly", lambda: c("tenure") * c("monthly"), "tenure * monthly"),
]

DIGITS = [
    Feature("tenure_mod10", lambda: F.pmod(c("tenure"), F.lit(10)), _pmod_sql("tenure", 10), "long"),
    Feature("tenure_mod12", lambda: F.pmod(c("tenure"), F.lit(12)), _pmod_sql("tenure", 12), "long"),
    Feature("tenure_years", lambda: F.floor(c("tenure") / 12), "floor(tenure / 12)", "long"),
    Feature("tenure_is_multiple_12", lambda: _flag(F.pmod(c("tenure"), F.lit(12)) == 0),
            f"cast({_pmod_sql('tenure', 12)} = 0 as bigint)", "long"),
    Feature("tenure_first_digit", lambda: F.substring(F.abs(c("tenure")).cast("string"), 1, 1).cast("int"),
            "cast(substr(cast(abs(tenure) as varchar), 1, 1) as int)", "long"),
    Feature("tenure_last_digit", lambda: F.expr("right(cast(tenure as string), 1)").cast("int"),
            "cast(right(cast(tenure as varchar), 1) as int)", "long"),
    Feature("mc_fractional", lambda: c("monthly") - F.floor(c("monthly")), "monthly - floor(monthly)"),
    Feature("mc_rounded_10", lambda: _bround0(c("monthly") / 10) * 10, "round_even(monthly / 10, 0) * 10"),
    Feature("mc_dev_from_round10", lambda: F.abs(c("monthly") - _bround0(c("monthly") / 10) * 10),
            "abs(monthly - round_even(monthly / 10, 0) * 10)"),
    Feature("mc_is_multiple_10", lambda: _flag(F.pmod(F.floor(c("monthly")), F.lit(10)) == 0),
            f"cast({_pmod_sql('floor(monthly)', 10)} = 0 as bigint)", "long"),
    Feature("mc_first_digit",
            lambda: F.substring(F.floor(F.abs(c("monthly"))).cast("long").cast("string"), 1, 1).cast("int"),
            "cast(substr(cast(cast(floor(abs(monthly)) as bigint) as varchar), 1, 1) as int)", "long"),
    Feature("tc_fractional", lambda: c("total") - F.floor(c("total")), "total - floor(total)"),
    Feature("tc_rounded_100", lambda: _bround0(c("total") / 100) * 100, "round_even(total / 100, 0) * 100"),
    Feature("tc_is_multiple_100", lambda: _flag(F.pmod(F.floor(c("total")), F.lit(100)) == 0),
            f"cast({_pmod_sql('floor(total)', 100)} = 0 as bigint)", "long"),
    Feature("tc_first_digit",
            lambda: F.substring(F.floor(F.abs(c("total"))).cast("long").cast("string"), 1, 1).cast("int"),
            "cast(substr(cast(cast(floor(abs(total)) as bigint) as varchar), 1, 1) as int)", "long"),
    Feature("tc_dev_from_round100", lambda: F.abs(c("total") - _bround0(c("total") / 100) * 100),
            "abs(total - round_even(total / 100, 0) * 100)"),
    Feature("tc_thousands_digit", lambda: F.floor(F.pmod(c("total") / 1000, F.lit(10.0))).cast("int"),
            f"cast(floor({_pmod_sql('total / 1000', '10.0')}) as int)", "long"),
]

SERVICE_COUNTS = [
    Feature("svc_yes_count", _yes_count, YES_COUNT_SQL, "long"),
    Feature("svc_no_count", lambda: sum((c(s) == "No").cast("int") for s in SERVICES),
            " + ".join(f"cast({s} = 'No' as int)" for s in SERVICES), "long"),
    Feature("svc_none_count", lambda: sum((c(s) == "None").cast("int") for s in SERVICES),
            " + ".join(f"cast({s} = 'None' as int)" for s in SERVICES), "long"),
    Feature("svc_other_count", lambda: sum(c(s).isin("No", "None").cast("int") for s in SERVICES),
            " + ".join(f"cast({s} in ('No', 'None') as int)" for s in SERVICES), "long"),
    Feature("value_services_count",
            lambda: sum((c(s) == "Yes").cast("int") for s in SERVICES[:4]),
            " + ".join(f"cast({s} = 'Yes' as int)" for s in SERVICES[:4]), "long"),
    Feature("num_services",
            lambda: sum(c(s).isin("Yes").cast("int") for s in SERVICES)
            + c("pri").isin("1-URGENT", "2-HIGH").cast("int"),
            YES_COUNT_SQL + " + cast(pri in ('1-URGENT', '2-HIGH') as int)", "long"),
    # Divide by the length of the list that is counted
    Feature("service_diversity", lambda: _yes_count() / float(len(SERVICES)),
            f"({YES_COUNT_SQL}) / {float(len(SERVICES))}"),
]

TRI_STATE = [f for s in SERVICES for f in (
    Feature(f"ISYES_{s}", (lambda s=s: _flag(c(s) == "Yes")), f"cast({s} = 'Yes' as bigint)", "long"),
    Feature(f"ISNO_{s}", (lambda s=s: _flag(c(s) == "No")), f"cast({s} = 'No' as bigint)", "long"),
    Feature(f"ISOTHER_{s}", (lambda s=s: _flag(~c(s).isin("Yes", "No"))),
            f"cast({s} not in ('Yes', 'No') as bigint)", "long"),
)]

RISK_FLAGS = [
    Feature("has_items", lambda: _flag(c("n_items") > 0), "cast(n_items > 0 as bigint)", "long"),
    Feature("is_urgent", lambda: _flag(c("pri") == "1-URGENT"), "cast(pri = '1-URGENT' as bigint)", "long"),
    Feature("is_automobile", lambda: _flag(c("seg") == "AUTOMOBILE"), "cast(seg = 'AUTOMOBILE' as bigint)", "long"),
    # The sum of two booleans is their OR
    Feature("return_or_late", lambda: _flag((c("svc_return") == "Yes") | (c("svc_late") == "Yes")),
            "cast(svc_return = 'Yes' or svc_late = 'Yes' as bigint)", "long"),
    Feature("return_and_late", lambda: _flag((c("svc_return") == "Yes") & (c("svc_late") == "Yes")),
            "cast(svc_return = 'Yes' and svc_late = 'Yes' as bigint)", "long"),
    Feature("guard_all", lambda: _flag((c("svc_accept") == "Yes") & (c("svc_keep") == "Yes")
                                       & (c("svc_disc") == "Yes") & (c("svc_tax") == "Yes")),
            "cast(svc_accept = 'Yes' and svc_keep = 'Yes' and svc_disc = 'Yes' and svc_tax = 'Yes' as bigint)",
            "long"),
    Feature("guard_any", lambda: _flag((c("svc_accept") == "Yes") | (c("svc_keep") == "Yes")
                                       | (c("svc_disc") == "Yes") | (c("svc_tax") == "Yes")),
            "cast(svc_accept = 'Yes' or svc_keep = 'Yes' or svc_disc = 'Yes' or svc_tax = 'Yes' as bigint)",
            "long"),
    Feature("risk_count", lambda: ((c("pri") == "1-URGENT").cast("int") + (c("seg") == "AUTOMOBILE").cast("int")
                                   + (c("svc_return") == "Yes").cast("int")),
            "cast(pri = '1-URGENT' as int) + cast(seg = 'AUTOMOBILE' as int) + cast(svc_return = 'Yes' as int)",
            "long"),
    Feature("risk_new_urgent", lambda: _flag((c("tenure") <= 12) & (c("pri") == "1-URGENT")),
            "cast(tenure <= 12 and pri = '1-URGENT' as bigint)", "long"),
    Feature("risk_no_accept", lambda: _flag((c("svc_accept") == "No") & (c("n_items") > 0)),
            "cast(svc_accept = 'No' and n_items > 0 as bigint)", "long"),
    Feature("automobile_no_tax", lambda: _flag((c("seg") == "AUTOMOBILE") & (c("svc_tax") == "No")),
            "cast(seg = 'AUTOMOBILE' and svc_tax = 'No' as bigint)", "long"),
    Feature("tenure_new", lambda: _flag(c("tenure") <= 12), "cast(tenure <= 12 as bigint)", "long"),
    Feature("tenure_long", lambda: _flag(c("tenure") > 36), "cast(tenure > 36 as bigint)", "long"),
    Feature("is_new_customer", lambda: _flag(c("tenure") <= 6), "cast(tenure <= 6 as bigint)", "long"),
    Feature("is_first_month", lambda: _flag(c("tenure") == 1), "cast(tenure = 1 as bigint)", "long"),
    Feature("monthly_high", lambda: _flag(c("monthly") > 7000), "cast(monthly > 7000 as bigint)", "long"),
    Feature("total_high", lambda: _flag(c("total") > 200000), "cast(total > 200000 as bigint)", "long"),
]


def _dev():
    return c("total") - c("tenure") * c("monthly")


DEV_SQL = "(total - tenure * monthly)"

def _months():
    return F.try_divide(c("total"), c("monthly") + 0.01)


MONTHS_SQL = "(total / nullif(monthly + 0.01, 0))"

CHARGE_RATIOS = [
    Feature("charges_deviation", _dev, DEV_SQL),
    Feature("abs_charges_dev", lambda: F.abs(_dev()), f"abs({DEV_SQL})"),
    Feature("dev_sign", lambda: F.signum(_dev()), f"cast(sign({DEV_SQL}) as double)"),
    # Tolerance instead of float32 equality
    Feature("dev_is_zero", lambda: _flag(F.abs(_dev()) < 1e-6), f"cast(abs({DEV_SQL}) < 1e-6 as bigint)", "long"),
    Feature("monthly_to_total_ratio", lambda: F.try_divide(c("monthly"), c("total") + 1),
            "monthly / nullif(total + 1, 0)"),
    Feature("total_to_monthly_ratio", lambda: F.try_divide(c("total"), c("monthly") + 1),
            "total / nullif(monthly + 1, 0)"),
    Feature("avg_monthly_charges", lambda: F.try_divide(c("total"), c("tenure") + 1), "total / nullif(tenure + 1, 0)"),
    Feature("charges_per_service", lambda: c("monthly") / (_yes_count() + 1), f"monthly / (({YES_COUNT_SQL}) + 1)"),
    Feature("total_per_item", lambda: c("total") / (c("n_items") + 0.01), "total / (n_items + 0.01)"),
    Feature("monthly_per_item", lambda: F.try_divide(c("monthly"), c("n_items") + 1e-3),
            "monthly / nullif(n_items + 1e-3, 0)"),
    Feature("tenure_x_total", lambda: c("tenure") * c("total"), "tenure * total"),
    Feature("charge_intensity", lambda: F.try_divide(c("monthly"), c("total") + 1e-6), "monthly / nullif(total + 1e-6, 0)"),
    Feature("actual_months", _months, MONTHS_SQL),
    Feature("months_diff", lambda: _months() - c("tenure"), f"{MONTHS_SQL} - tenure"),
    Feature("charge_stability", lambda: F.try_divide(F.abs(_dev()), c("total") + 1), f"abs({DEV_SQL}) / nullif(total + 1, 0)"),
    # halved for each of two household flags
    Feature("per_capita_charge", lambda: c("monthly") / F.when(c("svc_keep") == "Yes", 2).otherwise(1)
            / F.when(c("svc_bulk") == "Yes", 2).otherwise(1),
            "monthly / (case when svc_keep = 'Yes' then 2 else 1 end) / (case when svc_bulk = 'Yes' then 2 else 1 end)"),
    Feature("per_cost", lambda: c("monthly") / (_yes_count() + 1e-3), f"monthly / (({YES_COUNT_SQL}) + 1e-3)"),
]

# fixed values: ordinal codes used by the interaction features
PRI_CODE = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}


def _pri_code():
    e = None
    for k, v in PRI_CODE.items():
        e = F.when(c("pri") == k, v) if e is None else e.when(c("pri") == k, v)
    return e.otherwise(0)


PRI_CODE_SQL = "(case " + " ".join(f"when pri = '{k}' then {v}" for k, v in PRI_CODE.items()) + " else 0 end)"

# fixed values: ordinal codes of the segment
SEG_CODE = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3}


def _seg_code():
    e = F
    for k, v in SEG_CODE.items():
        e = e.when(c("seg") == k, v)
    return e.otherwise(0)


SEG_CODE_SQL = "(case " + " ".join(f"when seg = '{k}' then {v}" for k, v in SEG_CODE.items()) + " else 0 end)"
_RISK = next(f for f in RISK_FLAGS if f.name == "risk_count")

INTERACTIONS = [
    Feature("seg_tenure", lambda: (_seg_code() * c("tenure")).cast("double"), f"cast({SEG_CODE_SQL} * tenure as double)"),
    Feature("seg_monthly", lambda: _seg_code() * c("monthly"), f"{SEG_CODE_SQL} * monthly"),
    Feature("risk_tenure", lambda: (_RISK.col() * c("tenure")).cast("double"), f"cast(({_RISK.sql}) * tenure as double)"),
    Feature("pri_tenure", lambda: (_pri_code() * c("tenure")).cast("double"), f"cast({PRI_CODE_SQL} * tenure as double)"),
    Feature("pri_monthly", lambda: _pri_code() * c("monthly"), f"{PRI_CODE_SQL} * monthly"),
    Feature("service_tenure", lambda: (_yes_count() * c("tenure")).cast("double"),
            f"cast(({YES_COUNT_SQL}) * tenure as double)"),
    Feature("service_monthly", lambda: _yes_count() * c("monthly"), f"({YES_COUNT_SQL}) * monthly"),
    Feature("loyalty_score", lambda: _pri_code() * 10 + c("tenure") / 6.0, f"{PRI_CODE_SQL} * 10 + tenure / 6.0"),
    Feature("protection_score",
            lambda: sum((c(s) == "Yes").cast("int") for s in SERVICES[1:5]).cast("double"),
            "cast(" + " + ".join(f"cast({s} = 'Yes' as int)" for s in SERVICES[1:5]) + " as double)"),
]


def _cross(cols, sep):
    return F.concat_ws(sep, *[F.coalesce(c(x).cast("string"), F.lit("nan")) for x in cols])


def _cross_sql(cols, sep):
    return f"concat_ws('{sep}', " + ", ".join(f"coalesce(cast({x} as varchar), 'nan')" for x in cols) + ")"


CROSSES = [
    Feature("pri_seg", lambda: _cross(["pri", "seg"], "_"), _cross_sql(["pri", "seg"], "_"), "string"),
    Feature("region_return", lambda: _cross(["region", "svc_return"], "|"),
            _cross_sql(["region", "svc_return"], "|"), "string"),
    Feature("seg_late", lambda: _cross(["seg", "svc_late"], "_"), _cross_sql(["seg", "svc_late"], "_"), "string"),
    Feature("tenure_pri", lambda: _cross(["tenure", "pri"], "_"), _cross_sql(["tenure", "pri"], "_"), "string"),
    Feature("pri__seg__region", lambda: _cross(["pri", "seg", "region"], "__"),
            _cross_sql(["pri", "seg", "region"], "__"), "string"),
]

NGRAM_COLS = ["pri", "seg", "region", "svc_return", "svc_open", "nation"]


def ngram_features(cols=NGRAM_COLS, sep="___"):
    """2-combinations of ``cols`` and 3-combinations of its first four."""
    out = []
    for r, base in ((2, cols), (3, cols[:4])):
        for combo in combinations(base, r):
            out.append(Feature(sep.join(combo), (lambda combo=combo: _cross(list(combo), sep)),
                               _cross_sql(list(combo), sep), "string"))
    return out


GROUPS: dict[str, list[Feature]] = {
    "num_transforms": NUM_TRANSFORMS,
    "digit_features": DIGITS,
    "service_counts": SERVICE_COUNTS,
    "tri_state_flags": TRI_STATE,
    "risk_flags": RISK_FLAGS,
    "charge_ratios": CHARGE_RATIOS,
    "interaction_products": INTERACTIONS,
    "crosses": CROSSES,
    "ngrams": ngram_features(),
}

# Switchable feature sets
FEATURE_SETS = {
    "core": ["charge_ratios", "digit_features", "service_counts"],
    "full": list(GROUPS),
}
ORIGINALS = ["pri", "seg", "nation", "region", "tenure", "monthly", "total", "n_items"]


def spark_out(f: Feature) -> Column:
    e = f.col()
    if f.kind == "double":
        return round6(e).alias(f.name)
    if f.kind == "long":
        return e.cast("long").alias(f.name)
    return e.cast("string").alias(f.name)


def sql_out(f: Feature) -> str:
    q = f'"{f.name}"'
    if f.kind == "double":
        return f"round(cast({f.sql} as double), 6) as {q}"
    if f.kind == "long":
        return f"cast({f.sql} as bigint) as {q}"
    return f"cast({f.sql} as varchar) as {q}"


def feature_set(name: str) -> list[Feature]:
    return [f for g in FEATURE_SETS[name] for f in GROUPS[g]]
