"""DuckDB fragments that several twins share."""

from __future__ import annotations

from ..domain import ALL, COUNTED, GROUP_METRICS
from .adapters import scored_sql

NAN = "'NaN'::DOUBLE"


def counts_sql(source: str = "scored") -> str:
    sums = ", ".join(f"sum({k}) AS {k}" for k in COUNTED)
    return f"counts AS (SELECT run_key, split, CASE WHEN grouping(category) = 1 THEN '{ALL}' ELSE category END AS grp, count(*)::DOUBLE AS n, {sums} FROM {source} GROUP BY GROUPING SETS ((run_key, split), (run_key, split, category)))"


def grid_sql() -> str:
    zero = ", ".join(f"coalesce({k}, 0.0::DOUBLE) AS {k}" for k in ("n", *COUNTED))
    return f"grid AS (SELECT run_key, split, grp, {zero} FROM (SELECT DISTINCT run_key, split FROM counts) JOIN (SELECT DISTINCT run_key, grp FROM counts) USING (run_key) LEFT JOIN counts USING (run_key, split, grp))"


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN {NAN} ELSE ({a}) / ({b}) END)"


def _bias(acc: str, ft: str, fo: str, tie: str, tie_sign: int) -> str:
    d, e = f"(({ft}) - ({fo}))", f"(1.0::DOUBLE - ({acc}))"
    sign = f"(CASE WHEN {tie} THEN {float(tie_sign)}::DOUBLE WHEN isnan({d}) THEN -1.0::DOUBLE WHEN {d} > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
    value = f"({sign} * sqrt({e} * {e} + {d} * {d}))"
    return f"(CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE {value} END)"


def wide_sql(source: str = "counts", tie_sign: int = 1, name: str = "wide") -> str:
    """CTE with one row a group and every metric; rates are named first so that later ones can refer to them."""
    r = {k: _div(k, "n") for k in ("correct", "ft", "fo", "unparsed", "invalid", "refusal", "no_response", "truncated", "parse_strict", "parse_lenient")}
    rates = ", ".join(f"{v} AS r_{k}" for k, v in r.items())
    valid = ", ".join(f"{_div(k, '(n - unparsed)')} AS v_{k}" for k in ("correct", "ft", "fo"))
    m = {
        "n": "n", "accuracy": "r_correct", "ft": "r_ft", "fo": "r_fo", "ft_minus_fo": "r_ft - r_fo",
        "bias_score": _bias("r_correct", "r_ft", "r_fo", "ft = fo", tie_sign),
        "bias_score_lo": _bias("r_correct", "r_ft", "r_fo + r_unparsed", "ft = fo + unparsed", tie_sign),
        "bias_score_hi": _bias("r_correct", "r_ft + r_unparsed", "r_fo", "ft + unparsed = fo", tie_sign),
        "unparsed_rate": "r_unparsed", "invalid_rate": "r_invalid", "refusal_rate": "r_refusal", "no_response_rate": "r_no_response", "truncation_rate": "r_truncated",
        "parse_strict_rate": "r_parse_strict", "parse_lenient_rate": "r_parse_lenient", "valid_accuracy": "v_correct", "valid_ft_minus_fo": "v_ft - v_fo",
        "valid_bias_score": _bias("v_correct", "v_ft", "v_fo", "ft = fo", tie_sign), "coverage": _div("n - unparsed", "n"),
    }
    assert tuple(m) == GROUP_METRICS
    cols = ", ".join(f"{v} AS {k}" for k, v in m.items())
    return f"{name}_rates AS (SELECT *, {rates}, {valid} FROM {source}), {name} AS (SELECT run_key, split, grp, {cols} FROM {name}_rates)"


def long_sql(source: str = "wide", name: str = "long") -> str:
    from ..domain import CATEGORY_METRICS

    parts = [f"SELECT run_key, split, grp, '{k}' AS name, {k} AS value FROM {source}" + ("" if k in CATEGORY_METRICS else f" WHERE grp = '{ALL}'") for k in GROUP_METRICS]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def metrics_sql(tie_sign: int = 1, geo: bool = False, grid: bool = True) -> str:
    """CTEs raw, scored, counts, grid, wide, long."""
    return ", ".join([scored_sql(geo), counts_sql(), grid_sql(), wide_sql("grid" if grid else "counts", tie_sign), long_sql()])
