"""Attempts that may be killed at any step: a marker written ahead, and each attempt booked exactly once.

A unit's attempt is: write the marker, call, append the ledger line under the attempt's name, clear the marker. The next
run finds a marker that was left. If the ledger has the attempt's line, the kill came after the append, and only the
marker goes. Else the money that has left the account since the marker is booked as a line of status 'interrupted' under
the same name. Both the line and the booking are appends to a table with one row a name, so whatever is repeated adds
nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..runtime import cut
from ..sources import jsonl, schemas
from ..sources.commits import KeyedTable, adopt
from ..sources.files import Folder
from .history import interrupted_cost

ATTEMPTS = "attempt string, " + schemas.LEDGER.split(", ", 1)[1]


def ledger_table(spark: SparkSession, path: str) -> KeyedTable:
    """The ledger at ``path`` as a table with one line an attempt."""
    return KeyedTable(spark, path, ATTEMPTS, ["attempt"], "created")


def open_ledger(spark: SparkSession, path: str) -> KeyedTable:
    """The table at ``path`` to append to; a ledger of JSON lines is made one, its lines named by their numbers."""
    if jsonl.path_exists(spark, path) and not KeyedTable.is_one(spark, path):
        old = jsonl.read_ledger(spark, path)
        named = numbered(cut(old), [], ["line_no", "created", "key"], "_at")
        adopt(spark, path, named.withColumn("attempt", F.concat(F.lit("line-"), F.col("_at"))), lambda p: ledger_table(spark, p))
    return ledger_table(spark, path)


class Marker:
    """The attempt that is under way, one JSON file on a file system that the next driver sees too."""

    def __init__(self, spark: SparkSession, path: str):
        folder, _, self.name = path.rpartition("/")
        self.folder = Folder(spark, folder)

    def write(self, **fields: object) -> None:
        self.folder.replace(self.name, json.dumps(fields, sort_keys=True, ensure_ascii=False))

    def read(self) -> dict | None:
        """The fields; an absent or unreadable marker, or one that is no object, is None."""
        try:
            found = json.loads(self.folder.read(self.name)) if self.folder.exists(self.name) else None
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def clear(self) -> None:
        self.folder.delete(self.name)


def interrupted_lines(markers: DataFrame, ledger: DataFrame) -> DataFrame:
    """The lines of markers (attempt, key, config, style, stage, created, credits_before, credits_now) whose attempt the
    ledger does not have: no samples, no token cost, and the credits that went meanwhile. Markers that repeat an attempt
    are one, the first that was written."""
    first = markers.groupBy("attempt").agg(F.min_by(F.struct(*[F.col(c) for c in markers.columns if c != "attempt"]), "created").alias("m")).select("attempt", "m.*")
    lost = first.join(ledger.select("attempt"), "attempt", "left_anti")
    note = F.concat(F.lit("cut off before its line was written; credits since "), F.coalesce("created", F.lit("?")))
    return lost.select(
        "attempt", "key", "config", "style", "stage", F.lit("interrupted").alias("status"), "created", F.lit(0).cast("long").alias("samples"), F.lit(0.0).alias("cost_tokens"),
        interrupted_cost(F.col("credits_now"), F.coalesce("credits_before", F.lit(0.0))).alias("cost_credits"), note.alias("note"),
    )


def _lines(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [x.split()[0] for x in ATTEMPTS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ATTEMPTS)


def book(table: KeyedTable, line: dict) -> bool:
    """Append one line; False if its attempt has one already."""
    return table.append(_lines(table.spark, [line]))[0] == 1


def recover(table: KeyedTable, marker: Marker, credits: Callable[[], float]) -> dict | None:
    """Settle a marker that was left; returns the interrupted line if one was booked.

    ``credits`` reads the settled usage of the account; if it fails with OSError the marker stays for the next run.
    """
    left = marker.read()
    if left is None:
        return None
    spark, attempt = table.spark, str(left.get("attempt") or left.get("created") or "unknown")
    if not table.read().where(F.col("attempt") == attempt).isEmpty():
        marker.clear()
        return None
    try:
        now = float(credits())
    except OSError:
        return None
    text = lambda name: str(left.get(name, "")) if left.get(name) is not None else None
    row = (attempt, *(text(n) for n in ("key", "config", "style", "stage", "created")), float(left.get("credits_before") or 0.0), now)
    found = spark.createDataFrame([row], "attempt string, key string, config string, style string, stage string, created string, credits_before double, credits_now double")
    line = interrupted_lines(found, table.read()).first()
    booked = line is not None and book(table, line.asDict())
    marker.clear()
    return line.asDict() if booked else None


def attempt_unit(table: KeyedTable, marker: Marker, unit: dict, now: str, credits: Callable[[], float], call: Callable[[dict], dict]) -> dict:
    """Run one unit (key, config, style, stage) under a marker and book its line, which is returned."""
    about = {k: unit.get(k) for k in ("key", "config", "style", "stage")} | {"created": now, "attempt": uuid.uuid4().hex}
    marker.write(**about, credits_before=credits())
    line = about | call(unit)
    book(table, line)
    marker.clear()
    return line
