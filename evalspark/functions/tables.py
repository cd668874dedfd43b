"""SQL table functions: ``SELECT * FROM eval_summarize(TABLE(scored))``, and ``eval_counts`` for its first half.

``eval_counts`` works where the rows lie: each task adds its Arrow batches up by run, split and category and gives what it
has at its end, at most one row a group and task. ``eval_summarize`` deals its rows by run, as a run's groups are laid
out together, and takes scored rows or counts alike. Scored rows of one run are one task's, row by row; for many, nest the
two: ``eval_summarize(TABLE(SELECT * FROM eval_counts(TABLE(scored))))``. Counts made by GROUP BY with these names do too.

Defined cases: rows without a split only make their category a group of the run, rows without a category count in the
pooled group alone, null indicators count 0; groups that a split lacks have n 0 and NaN elsewhere; an empty table gives no
rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, SelectedColumn

from ..domain import ALL, CATEGORY_METRICS, COUNTED, GROUP_METRICS, TIE_SIGNS, check_domain
from ..runtime import ship_package

KEYS = ("run_key", "split", "category")
SUMS = ("n", *COUNTED)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def _bias(accuracy: np.ndarray, ft: np.ndarray, fo: np.ndarray, tie: np.ndarray, tie_sign: int) -> np.ndarray:
    error, diff = 1.0 - accuracy, ft - fo
    return np.where(tie, float(tie_sign), np.where(diff > 0, 1.0, -1.0)) * np.sqrt(error * error + diff * diff) + 0.0


def metric_arrays(c: dict[str, np.ndarray], tie_sign: int = 1) -> dict[str, np.ndarray]:
    """Every metric of each group from its counts, equal to the last bit to ``metrics.group_metrics``."""
    n, valid = c["n"], c["n"] - c["unparsed"]
    rate = {k: _ratio(c[k], n) for k in COUNTED}
    sound = {k: _ratio(c[k], valid) for k in ("correct", "ft", "fo")}
    acc, ft, fo, lost = (rate[k] for k in ("correct", "ft", "fo", "unparsed"))
    tie = c["ft"] == c["fo"]
    out = {f"{k}_rate": v for k, v in rate.items()} | {
        "n": n,
        "accuracy": acc,
        "ft": ft,
        "fo": fo,
        "ft_minus_fo": ft - fo,
        "bias_score": _bias(acc, ft, fo, tie, tie_sign),
        "bias_score_lo": _bias(acc, ft, fo + lost, c["ft"] == c["fo"] + c["unparsed"], tie_sign),
        "bias_score_hi": _bias(acc, ft + lost, fo, c["ft"] + c["unparsed"] == c["fo"], tie_sign),
        "truncation_rate": rate["truncated"],
        "valid_accuracy": sound["correct"],
        "valid_ft_minus_fo": sound["ft"] - sound["fo"],
        "valid_bias_score": _bias(sound["correct"], sound["ft"], sound["fo"], tie, tie_sign),
        "coverage": _ratio(valid, n),
    }
    return {k: out[k] for k in GROUP_METRICS}


def _wanted(table: AnalyzeArgument) -> tuple[DataType, list[SelectedColumn]]:
    """Type of the run key, and what is read of a table of scored rows (n is 1) or of counts (it has an n)."""
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(name) or TABLE(SELECT ...)")
    there = {f.name.lower(): f for f in table.dataType.fields}
    if lacking := [k for k in (*KEYS, *COUNTED) if k not in there]:
        raise ValueError(f"the table lacks {', '.join(lacking)}")
    number = lambda k: SelectedColumn(f"CAST(coalesce({k}, 0) AS DOUBLE)", alias=k)
    n = number("n") if "n" in there else SelectedColumn("1D", alias="n")
    return there["run_key"].dataType, [*map(SelectedColumn, KEYS), n, *map(number, COUNTED)]


class EvalCounts:
    """(run_key, split, category, n, indicators): what each task counted, batch by batch; the run key comes as a string."""

    def __init__(self) -> None:
        self.sums: dict[tuple, np.ndarray] = {}

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        columns = {k: batch.column(k).cast(pa.string()) for k in KEYS} | {k: batch.column(k).cast(pa.float64()) for k in COUNTED}
        columns["n"] = batch.column("n").cast(pa.float64()) if "n" in batch.schema.names else pa.array(np.ones(batch.num_rows))
        part = pa.table(columns).group_by(list(KEYS)).aggregate([(k, "sum") for k in SUMS])
        values = np.column_stack([part.column(f"{k}_sum").fill_null(0.0).to_numpy() for k in SUMS])
        for key, row in zip(zip(*(part.column(k).to_pylist() for k in KEYS), strict=True), values, strict=True):
            self.sums[key] = self.sums[key] + row if key in self.sums else row
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.sums:
            cells = np.stack(list(self.sums.values()))
            yield pa.table({k: pa.array(v, pa.string()) for k, v in zip(KEYS, zip(*self.sums, strict=True), strict=True)} | {k: cells[:, j] for j, k in enumerate(SUMS)})


class EvalSummarize:
    """(run_key, split, grp, name, value): all metrics of a run's pooled group, the short list of its categories."""

    @staticmethod
    def analyze(table: AnalyzeArgument, tie_sign: AnalyzeArgument | None = None) -> AnalyzeResult:
        if tie_sign is not None:
            check_domain("tie_sign", tie_sign.value, TIE_SIGNS)
        kind, columns = _wanted(table)
        out = StructType().add("run_key", kind)
        for k in ("split", "grp", "name"):
            out = out.add(k, StringType())
        return AnalyzeResult(schema=out.add("value", DoubleType()), partitionBy=[PartitioningColumn("run_key")], select=columns)

    def __init__(self) -> None:
        self.cells: dict[tuple[str, str], list[float]] = {}
        self.run, self.tie_sign = None, 1

    def eval(self, row: Row, tie_sign: int = 1) -> None:
        self.run, split, category, *counts = row
        self.tie_sign = tie_sign
        for group in (ALL,) if category is None else (ALL, category):
            held = self.cells.get((split, group))
            self.cells[split, group] = counts if held is None else [x + y for x, y in zip(held, counts, strict=True)]

    def terminate(self) -> Iterator[tuple]:
        splits, groups = ({key[j]: None for key in self.cells} for j in (0, 1))
        grid = [(s, g) for s in splits if s is not None for g in groups]
        counts = np.array([self.cells.get(key, [0.0] * len(SUMS)) for key in grid]).reshape(-1, len(SUMS))
        for name, values in metric_arrays({k: counts[:, j] for j, k in enumerate(SUMS)}, self.tie_sign).items():
            for (split, group), value in zip(grid, values.tolist(), strict=True):
                if group == ALL or name in CATEGORY_METRICS:
                    yield self.run, split, group, name, value


def register_table_functions(spark: SparkSession) -> None:
    """Make eval_counts and eval_summarize known to the session's SQL."""
    ship_package(spark)
    spark.udtf.register("eval_counts", F.arrow_udtf(EvalCounts, returnType=f"{', '.join(f'{k} string' for k in KEYS)}, {', '.join(f'{k} double' for k in SUMS)}"))
    spark.udtf.register("eval_summarize", F.udtf(EvalSummarize))
