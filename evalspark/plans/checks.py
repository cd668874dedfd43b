"""Registered queries over checks: excused differences, the worst deviation, drift of errors, units of a panel, equal sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domain import STAGE_LIMITS
from ..operators import bootstrap as B
from ..operators import verify as V
from ..sources import reference
from . import adapters as T
from .queries import query

_BALANCES = """ours AS (SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey % 11 <> 0),
    theirs AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + (c_custkey % 7) * 0.004 ELSE c_acctbal END AS value FROM customer WHERE c_custkey % 13 <> 0),
    pinned AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 20 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS pinned FROM customer WHERE c_custkey % 10 = 0),
    both_sides AS (SELECT key, ours.value AS ours, theirs.value AS theirs FROM ours FULL OUTER JOIN theirs USING (key))"""
_STATUS = "CASE WHEN ours IS NULL THEN 'missing' WHEN theirs IS NULL THEN 'extra' WHEN abs(ours - theirs) <= 0.01 THEN 'match' ELSE 'differs' END"


def _sides(spark, sf):
    c = T.table(spark, sf, "customer")
    ours = c.where("c_custkey % 11 <> 0").selectExpr("c_custkey AS key", "c_acctbal AS value")
    theirs = c.where("c_custkey % 13 <> 0").selectExpr("c_custkey AS key", "CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + (c_custkey % 7) * 0.004D ELSE c_acctbal END AS value")
    return V.reconcile(ours, theirs, ["key"], 0.01)


@query(f"WITH {_BALANCES}, r AS (SELECT *, {_STATUS} AS status FROM both_sides) SELECT key, ours, theirs, CASE WHEN status = 'differs' AND abs(ours - pinned) <= 0.01 THEN 'known' ELSE status END AS status FROM r LEFT JOIN pinned USING (key)")
def excused(spark, sf):
    """Balances of customers against altered ones, some of whose differences are listed with the right value."""
    listed = T.table(spark, sf, "customer").where("c_custkey % 10 = 0").selectExpr("c_custkey AS key", "CASE WHEN c_custkey % 20 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS pinned")
    return V.excuse(_sides(spark, sf), listed, ["key"], 0.01)


@query(f"WITH {_BALANCES} SELECT max(abs(ours - theirs)) AS worst, arg_max(CAST(key AS VARCHAR), (abs(ours - theirs), CAST(key AS VARCHAR))) AS at FROM both_sides WHERE ours IS NOT NULL AND theirs IS NOT NULL")
def worst_deviation(spark, sf):
    return V.worst_deviation(_sides(spark, sf).where("ours IS NOT NULL AND theirs IS NOT NULL"), ["key"])


_ERRORS = "SELECT l_suppkey % 6 AS run_key, l_returnflag AS split, l_linestatus AS grp, {name} AS name, stddev_samp({x}) AS se FROM lineitem GROUP BY l_suppkey % 6, l_returnflag, l_linestatus"
_FIRST = " UNION ALL ".join(_ERRORS.format(name=f"'{n}'", x=x) for n, x in (("quantity", "l_quantity"), ("discount", "l_discount")))
_OTHER = " UNION ALL ".join(_ERRORS.format(name=f"'{n}'", x=x) for n, x in (("quantity", "l_quantity * (1 + l_linenumber % 3 * 0.3)"), ("discount", "l_discount * (1 + l_linenumber % 2 * 0.01)")))


@query(f"WITH a AS ({_FIRST}), b AS ({_OTHER}) SELECT run_key, split, grp, name, a.se AS se_a, b.se AS se_b FROM a JOIN b USING (run_key, split, grp, name) WHERE abs(a.se - b.se) > 0.15 * b.se AND abs(a.se - b.se) > 0.0015")
def drift(spark, sf):
    """Errors of two measures of each group; the second quantity is spread wider, the second discount hardly."""
    T.table(spark, sf, "lineitem").createOrReplaceTempView("_drift_lineitem")
    side = lambda sql: spark.sql(sql.replace("FROM lineitem", "FROM _drift_lineitem"))
    return B.drift(side(_FIRST), side(_OTHER))


@query(f"""WITH p AS (SELECT 's' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN ['clean', 'paper'] ELSE ['clean'] END AS styles FROM supplier), u AS (SELECT name, unnest(styles) AS style FROM p)
    SELECT name || '__' || style AS unit, 'smoke/' || name || '__' || style AS key, 'logs/smoke/panel/' || name || '__' || style AS log_dir, {STAGE_LIMITS["smoke"]}::INT AS limit_per_category FROM u""")
def panel_units(spark, sf):
    """Suppliers as a panel, every third with both prompt styles."""
    panel = T.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN array('clean', 'paper') ELSE array('clean') END").alias("prompt_styles"))
    return reference.panel_units(panel, "smoke").select("unit", "key", "log_dir", "limit_per_category")


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AND (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AS equal, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS inside")
def same_customers(spark, sf):
    """Whether the customers of orders are exactly those of the table, or at least some of them."""
    equal, inside = V.same_members(T.table(spark, sf, "orders").selectExpr("o_custkey AS k"), T.table(spark, sf, "customer").selectExpr("c_custkey AS k"))
    return T.table(spark, sf, "customer").groupBy().agg(F.lit(equal).alias("equal"), F.lit(inside).alias("inside"))
