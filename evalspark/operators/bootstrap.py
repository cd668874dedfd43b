"""Bootstrap errors from outcome patterns.

Items of a group that share all counted indicators are one pattern, so resampling items is a multinomial draw over
pattern counts: the shuffle carries a handful of patterns a group and the work does not depend on the number of items.
Draws are seeded by run and group, and patterns are sorted before drawing, so results do not depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import ALL, BOOT_REPLICATES, BOOT_SEED, CI_LEVEL, CI_REPLICATES, COUNTED


def cell_generator(seed: int, *names: object) -> np.random.Generator:
    """A stream of its own for every cell: the seed sequence takes the names, joined by a pipe, as further words."""
    return np.random.default_rng(np.random.SeedSequence([seed, *"|".join(map(str, names)).encode()]))


def patterns(scored: DataFrame) -> DataFrame:
    """(run_key, split, grp, indicators, items): distinct outcome patterns of every group."""
    base = scored.groupBy("run_key", "split", "category", *COUNTED).agg(F.count("*").alias("items"))
    pooled = base.groupBy("run_key", "split", *COUNTED).agg(F.sum("items").alias("items")).withColumn("grp", F.lit(ALL))
    return base.withColumnRenamed("category", "grp").unionByName(pooled)


def _bias(acc: np.ndarray, ft: np.ndarray, fo: np.ndarray, tie: np.ndarray, tie_sign: int) -> np.ndarray:
    d = ft - fo
    return np.where(tie, float(tie_sign), np.where(d > 0, 1.0, -1.0)) * np.sqrt((1 - acc) ** 2 + d**2) + 0.0


def _draw(pdf: pd.DataFrame, replicates: int, seed: int, tie_sign: int) -> tuple[float, dict[str, np.ndarray]]:
    pdf = pdf.sort_values(list(COUNTED), kind="stable")
    items = pdf["items"].to_numpy(np.int64)
    n = int(items.sum())
    drawn = cell_generator(seed, *pdf[["run_key", "split", "grp"]].iloc[0]).multinomial(n, items / n, size=replicates).astype(np.float64)
    c = {k: drawn @ pdf[k].to_numpy(np.float64) for k in ("correct", "ft", "fo", "unparsed")}
    acc, ft, fo = (c[k] / n for k in ("correct", "ft", "fo"))
    return n, {"accuracy": acc, "ft_minus_fo": ft - fo, "bias_score": _bias(acc, ft, fo, c["ft"] == c["fo"], tie_sign), "unparsed_rate": c["unparsed"] / n}


def _spread(x: np.ndarray) -> float:
    """Sample deviation of the replicates that are numbers; NaN if fewer than two are."""
    sound = np.ma.masked_invalid(x)
    return float(np.sqrt(sound.var() * sound.count() / (sound.count() - 1))) if sound.count() > 1 else float("nan")


def bootstrap_ses(scored: DataFrame, tie_sign: int = 1, replicates: int = BOOT_REPLICATES, seed: int = BOOT_SEED) -> DataFrame:
    """(run_key, split, grp, name, se) for the resampled metrics of every group."""
    kind = scored.schema["run_key"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, m = _draw(pdf, replicates, seed, tie_sign)
        return pd.DataFrame({"run_key": pdf["run_key"].iloc[0], "split": pdf["split"].iloc[0], "grp": pdf["grp"].iloc[0], "name": list(m), "se": [_spread(v) for v in m.values()]})

    return patterns(scored).groupBy("run_key", "split", "grp").applyInPandas(run, f"run_key {kind}, split string, grp string, name string, se double")


def bootstrap_se(scored: DataFrame, run_key: object, split: str, grp: str, name: str, **how: int) -> float:
    """The standard error of one metric of one group; only that group's rows are read. NaN if there is none."""
    rows = scored.where((F.col("run_key") == F.lit(run_key)) & (F.col("split") == split))
    if grp != ALL:
        rows = rows.where(F.col("category") == grp)
    got = bootstrap_ses(rows, **how).where((F.col("grp") == grp) & (F.col("name") == name)).first()
    return float("nan") if got is None else got["se"]


def bootstrap_intervals(scored: DataFrame, tie_sign: int = 1, replicates: int = CI_REPLICATES, level: float = CI_LEVEL, seed: int = BOOT_SEED) -> DataFrame:
    """(run_key, split, grp, name, se, lo, hi): percentile intervals of accuracy and of the absolute bias score."""
    kind = scored.schema["run_key"].dataType.simpleString()
    tail = (1 - level) / 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, m = _draw(pdf, replicates, seed, tie_sign)
        m = {"accuracy": m["accuracy"], "abs_bias_score": np.abs(m["bias_score"])}
        q = [np.quantile(v, [tail, 1 - tail]) for v in m.values()]
        return pd.DataFrame({"run_key": pdf["run_key"].iloc[0], "split": pdf["split"].iloc[0], "grp": pdf["grp"].iloc[0], "name": list(m), "se": [_spread(v) for v in m.values()], "lo": [x[0] for x in q], "hi": [x[1] for x in q]})

    return patterns(scored).groupBy("run_key", "split", "grp").applyInPandas(run, f"run_key {kind}, split string, grp string, name string, se double, lo double, hi double")


def drift(a: DataFrame, b: DataFrame, share: float = 0.15, least: float = 0.0015) -> DataFrame:
    """Groups whose two standard errors differ by more than ``share`` and more than ``least``."""
    key = ["run_key", "split", "grp", "name"]
    both = a.select(*key, F.col("se").alias("se_a")).join(b.select(*key, F.col("se").alias("se_b")), key)
    gap = F.abs(F.col("se_a") - F.col("se_b"))
    return both.where((gap > share * F.col("se_b")) & (gap > least))
