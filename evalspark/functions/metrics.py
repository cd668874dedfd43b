"""Group metrics as expressions over indicator counts; the order of operations is part of their definition."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..domain import SIGN_Z, TIE_SIGNS, check_domain

NAN = float("nan")


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; NaN where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(NAN))


def signed_bias(accuracy: Column, ft: Column, fo: Column, tie: Column, tie_sign: int) -> Column:
    """sigma * sqrt((1 - accuracy)^2 + (ft - fo)^2); sigma is the sign of ft - fo, or ``tie_sign`` when counts tie."""
    check_domain("tie_sign", tie_sign, TIE_SIGNS)
    error, diff = F.lit(1.0) - accuracy, ft - fo
    sigma = F.when(tie, F.lit(float(tie_sign))).when(F.isnan(diff), F.lit(-1.0)).when(diff > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    value = sigma * F.sqrt(error * error + diff * diff)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def group_metrics(tie_sign: int = 1) -> dict[str, Column]:
    """Every metric of a group from its columns n and the counted indicators."""
    n = F.col("n").cast("double")
    c = {k: F.col(k).cast("double") for k in ("correct", "ft", "fo", "unparsed", "invalid", "refusal", "no_response", "truncated", "parse_strict", "parse_lenient")}
    acc, ft, fo, lost = (ratio(c[k], n) for k in ("correct", "ft", "fo", "unparsed"))
    valid = n - c["unparsed"]
    v_acc, v_ft, v_fo = (ratio(c[k], valid) for k in ("correct", "ft", "fo"))
    tie = c["ft"] == c["fo"]
    return {
        "n": n,
        "accuracy": acc,
        "ft": ft,
        "fo": fo,
        "ft_minus_fo": ft - fo,
        "bias_score": signed_bias(acc, ft, fo, tie, tie_sign),
        "bias_score_lo": signed_bias(acc, ft, fo + lost, c["ft"] == c["fo"] + c["unparsed"], tie_sign),
        "bias_score_hi": signed_bias(acc, ft + lost, fo, c["ft"] + c["unparsed"] == c["fo"], tie_sign),
        "unparsed_rate": lost,
        "invalid_rate": ratio(c["invalid"], n),
        "refusal_rate": ratio(c["refusal"], n),
        "no_response_rate": ratio(c["no_response"], n),
        "truncation_rate": ratio(c["truncated"], n),
        "parse_strict_rate": ratio(c["parse_strict"], n),
        "parse_lenient_rate": ratio(c["parse_lenient"], n),
        "valid_accuracy": v_acc,
        "valid_ft_minus_fo": v_ft - v_fo,
        "valid_bias_score": signed_bias(v_acc, v_ft, v_fo, tie, tie_sign),
        "coverage": ratio(valid, n),
    }


def sign_is_decided(diff: Column, se: Column, z: float = SIGN_Z) -> Column:
    """Whether |diff| exceeds z standard errors, strictly; never for NaN or 0."""
    return F.coalesce(~F.isnan(diff) & ~F.isnan(se) & (diff != 0) & (F.abs(diff) > F.lit(z) * se), F.lit(False))


def null_if_not_finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def metric_key(split: Column, group: Column, name: Column) -> Column:
    return F.concat_ws("/", split, group, name)


def split_metric_key(key: Column) -> Column:
    """struct(split, grp, name); null unless there are three non-empty parts."""
    p = F.split(key, "/", -1)
    ok = (F.size(p) == 3) & F.forall(p, lambda x: x != "")
    return F.when(ok, F.struct(F.get(p, F.lit(0)).alias("split"), F.get(p, F.lit(1)).alias("grp"), F.get(p, F.lit(2)).alias("name")))


def spend(tokens: Column, credits: Column) -> Column:
    """What a ledger line bills: the larger of counted tokens (none: 0) and credits (none: tokens)."""
    return F.greatest(F.coalesce(tokens, F.lit(0.0)), credits)


def register_sql_functions(spark: SparkSession) -> None:
    """SQL functions that the optimizer inlines: eval_bias_score, eval_sign_decided, eval_spend."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION eval_bias_score(accuracy DOUBLE, ft DOUBLE, fo DOUBLE, tie_sign INT) RETURNS DOUBLE RETURN
        (CASE WHEN abs(ft - fo) <= 1e-12D THEN double(tie_sign) WHEN ft - fo > 0 THEN 1D ELSE -1D END) * sqrt((1 - accuracy) * (1 - accuracy) + (ft - fo) * (ft - fo)) + 0D""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION eval_sign_decided(diff DOUBLE, se DOUBLE) RETURNS BOOLEAN RETURN
        coalesce(NOT isnan(diff) AND NOT isnan(se) AND diff <> 0 AND abs(diff) > 1.96D * se, false)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION eval_spend(tokens DOUBLE, credits DOUBLE) RETURNS DOUBLE RETURN greatest(coalesce(tokens, 0D), credits)""")


def metric_at(metrics: Column, key: str) -> Column:
    """A metric of a map by its name; NaN if the map lacks it or holds null."""
    return F.coalesce(F.try_element_at(metrics, F.lit(key)), F.lit(float("nan")))
