"""Command line: ``python -m evalspark.cli report|plan|run|ledger|verify|data|queries``.

Exit codes: 0 done, 1 a check or a unit failed, 2 bad arguments, 3 input missing, 4 the budget stopped the run."""

from __future__ import annotations

import argparse
import sys
import uuid
from datetime import UTC, datetime

from pyspark.sql import functions as F

from .operators import aggregate, bootstrap, history, recovery, report, verify
from .runtime import session
from .sources import jsonl, reference


#: Fixed format: a manual line's unit shows this much of its note.
NOTE_IN_KEY = 60


class _Booking(argparse.Action):
    """Two words, the second an amount."""

    def __call__(self, parser, namespace, values, option_string=None):
        try:
            setattr(namespace, self.dest, (values[0], float(values[1])))
        except ValueError:
            raise argparse.ArgumentError(self, f"an amount is wanted, not {values[1]!r}") from None


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evalspark", description=__doc__)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("report", help="score table (Parquet) -> Markdown report")
    r.add_argument("scored")
    r.add_argument("out")
    r.add_argument("--tie-sign", type=int, default=1, choices=(-1, 0, 1))
    r.add_argument("--runs", help="Parquet: run_key, config, group, reasoning, style, samples, reasoning_tokens; with it the whole report")
    r.add_argument("--ledger")
    u = sub.add_parser("run", help="run the units of an estimate table under a budget with the mock model")
    u.add_argument("estimates")
    u.add_argument("--ledger", required=True)
    u.add_argument("--limit", type=float, required=True)
    g = sub.add_parser("ledger", help="print the ledger and its sums, or add a manual line")
    g.add_argument("path")
    g.add_argument("--add", nargs=2, metavar=("NOTE", "USD"), action=_Booking)
    b = sub.add_parser("plan", help="estimates (Parquet: key, usd) under a budget")
    b.add_argument("estimates")
    b.add_argument("--ledger", required=True)
    b.add_argument("--limit", type=float, required=True)
    v = sub.add_parser("verify", help="two metric tables (Parquet: run_key, split, grp, name, value) within a tolerance")
    v.add_argument("ours")
    v.add_argument("theirs")
    v.add_argument("--tolerance", type=float, default=0.001)
    d = sub.add_parser("data", help="check item files against their manifest")
    d.add_argument("folder")
    sub.add_parser("queries", help="list the registered queries")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:  # wrong arguments, or help
        return int(e.code or 0)
    if args.command == "queries":
        from .plans import REGISTRY

        print("\n".join(REGISTRY))
        return 0
    spark = session(master=args.master)
    try:
        if args.command == "report":
            wide = aggregate.wide_metrics(aggregate.complete_grid(aggregate.group_counts(spark.read.parquet(args.scored))), args.tie_sign).cache()
            if args.runs:
                scored = spark.read.parquet(args.scored)
                ledger = jsonl.read_ledger(spark, args.ledger or f"{args.out}.no-ledger")
                text = report.monitoring_report(spark.read.parquet(args.runs), wide, bootstrap.bootstrap_ses(scored, args.tie_sign), reference.published_metrics(spark), ledger, args.scored)
            else:
                text = report.build_report([("Metrics", wide.orderBy("run_key", "split", "grp")), ("Rates", report.rate_flags(wide)), ("Order", report.overlap_flags(wide))])
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(text)
            return 0
        if args.command == "ledger":
            return _ledger(spark, args)
        if args.command == "run":
            return _run(spark, args)
        if args.command == "plan":
            done = jsonl.read_ledger(spark, args.ledger).where("status = 'ok'").select("key").distinct()
            history.budget_plan(spark.read.parquet(args.estimates), done, args.limit).show(1000, truncate=False)
            return 0
        if args.command == "verify":
            keys = ["run_key", "split", "grp", "name"]
            bad = verify.reconcile(spark.read.parquet(args.ours), spark.read.parquet(args.theirs), keys, args.tolerance).where(F.col("status") != "match").cache()
            bad.show(50, truncate=False)
            return int(bad.count() > 0)
        for m in reference_entries(spark, args.folder):
            jsonl.read_items(spark, f"{args.folder}/{m['name']}", m["sha256"], m["total"])
        return 0
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 3
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def _ledger(spark, args) -> int:
    """Print a ledger; spend that no run has written may be put into it first, each time as a line of its own."""
    if args.add is not None:
        about, spent = args.add
        name = f"hand-{uuid.uuid4().hex[:12]}"
        costs = dict.fromkeys(("cost_tokens", "cost_credits"), spent)
        recovery.book(recovery.open_ledger(spark, args.path), {"attempt": name, "key": f"manual/{about[:NOTE_IN_KEY]}", "stage": "manual", "status": "manual", "created": _now(), "note": about} | costs)
    lines = jsonl.read_ledger(spark, args.path)
    for part in (history.ledger_table(lines), history.ledger_sums(lines)):
        print(report.markdown_table(part, 6), end="\n\n")
    return 0


def _run(spark, args) -> int:
    """A rehearsal: no call is made and every unit costs its estimate; ``history.run_units`` takes the call of a real run.

    Each unit runs under a marker beside the ledger, and a marker that an earlier run left is settled first."""
    ledger, marker = recovery.open_ledger(spark, args.ledger), recovery.Marker(spark, f"{args.ledger.rstrip('/')}.inflight.json")
    billed = lambda: history.ledger_sums(jsonl.read_ledger(spark, args.ledger)).first()["billed_usd"]
    if left := recovery.recover(ledger, marker, billed):
        print(f"{left['key']}: an attempt was cut off; {left['cost_credits']:.6f} USD are booked", file=sys.stderr)
    done = {r["key"] for r in jsonl.read_ledger(spark, args.ledger).where("status = 'ok'").select("key").distinct().collect()}
    units = [r.asDict() for r in spark.read.parquet(args.estimates).orderBy("usd", "key").collect()]  # units of a panel
    rehearse = lambda u: {"stage": "full", "status": "ok", "cost_tokens": u["usd"], "note": "mock run: no call was made"}
    _, stopped = history.run_units(units, done, billed(), args.limit, lambda u: recovery.attempt_unit(ledger, marker, u, _now(), billed, rehearse))
    if stopped is not None:
        print(f"budget stop before {stopped}", file=sys.stderr)
        return 4
    return 0


def reference_entries(spark, folder: str) -> list:
    """The entries of a folder's manifest: one per item file."""
    return jsonl.read_manifest(spark, f"{folder}/manifest.json").collect()


if __name__ == "__main__":
    sys.exit(main())
