"""Tables that only grow and hold every key once, whoever writes them and however often.

Rows lie in folders of their own, one a commit. A commit counts when its numbered manifest exists, and a manifest is made
only if there is none of that number: of two writers one gets the number, the other looks at what has come and tries the
next. Only if the winner brought some of its keys are its rows written anew; line numbers go on from the manifest, so
rows need not change for another number. What a writer left when it was killed is in no manifest and is not read.

A commit may name its writer and batch; a batch of a writer is committed once, so a stream's batch that runs again adds
nothing. Every ``WHOLE``-th manifest repeats all entries, so a reader opens that and those after it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..operators.history import new_records
from .files import Folder

WHOLE = 50
MOST_TRIES = 100


class KeyedTable:
    """The table at ``path``: ``schema`` (DDL) without line_no; ``key`` columns; ``order`` of rows within a commit.

    ``read`` gives the rows with line_no, from 1 in order of commit and ``order``. A key must hold no null. Of rows of one
    batch with one key the first by ``order`` counts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: str, form: str = "json"):
        self.spark, self.folder, self.schema, self.key, self.order, self.form = spark, Folder(spark, path), schema, key, order, form

    @staticmethod
    def is_one(spark: SparkSession, path: str) -> bool:
        return Folder(spark, path).exists("commits")

    def entries(self) -> list[dict]:
        """The committed entries in order: commit, rows, first_line, writer, batch."""
        names = self.folder.names("commits")
        if not names:
            return []
        last = int(names[-1].removesuffix(".json"))
        out: list[dict] = []
        for version in range(last - last % WHOLE, last + 1):
            if version:  # version 0 is none: numbers begin at 1
                found = json.loads(self.folder.read(f"commits/{_name(version)}"))
                out = found["entries"] if found["whole"] else out + found["entries"]
        return out

    def _rows(self, entries: list[dict]) -> DataFrame:
        paths = [f"{self.folder.path}/data/commit={e['commit']}" for e in entries if e["rows"]]
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, place long, commit string")
        return self.spark.read.schema(f"{self.schema}, place long, commit string").option("basePath", f"{self.folder.path}/data").format(self.form).load(paths)

    def read(self) -> DataFrame:
        entries = self.entries()
        first = self.spark.createDataFrame([(e["commit"], e["first_line"]) for e in entries], "commit string, first_line long")
        rows = self._rows(entries).join(first, "commit")
        return rows.select((F.col("first_line") + F.col("place") - 1).alias("line_no"), *[F.col(f"`{c}`") for c in rows.columns if c not in ("commit", "place", "first_line")])

    def append(self, batch: DataFrame, writer: str = "", number: int | None = None) -> tuple[int, int]:
        """Add the rows whose keys are new, all or none of them; returns (added, left out). Columns that it lacks are null.

        With ``number`` the writer's batch of that number is added once and never again.
        """
        whole = batch.select(*[(F.col(f"`{f.name}`") if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.schema).schema])
        for k in self.key:
            whole = whole.withColumn(k, F.coalesce(k, F.raise_error(F.lit(f"a row without {k}")).cast(whole.schema[k].dataType)))
        whole = whole.cache()
        try:
            total, seen, held = whole.count(), self.entries(), None
            for _ in range(MOST_TRIES):
                if number is not None and any((e["writer"], e["batch"]) == (writer, number) for e in seen):
                    self._drop(held)
                    return 0, total
                held = held or self._write(whole, seen)
                if not held["rows"] and number is None:
                    self._drop(held)
                    return 0, total
                entry = held | {"first_line": 1 + sum(e["rows"] for e in seen), "writer": writer, "batch": number}
                if self._publish(len(seen) + 1, seen, entry):
                    return held["rows"], total - held["rows"]
                was, seen = len(seen), self.entries()
                if held["rows"] and self._clashes(held, seen[was:]):
                    self._drop(held)
                    held = None
            raise RuntimeError(f"{self.folder.path}: {MOST_TRIES} commits of others came first")
        finally:
            whole.unpersist()

    def _write(self, batch: DataFrame, seen: list[dict]) -> dict:
        """Rows that are new after ``seen``, in a folder that no manifest names yet."""
        commit = uuid.uuid4().hex
        path = f"{self.folder.path}/data/commit={commit}"
        fresh = new_records(self._rows(seen), batch, self.key, self.order)
        fresh = numbered(fresh, [], [self.order, *self.key], "place").select(*batch.columns, "place")
        fresh.write.format(self.form).option("ignoreNullFields", "false").save(path)
        rows = self.spark.read.schema("place long").format(self.form).load(path).count()
        return {"commit": commit, "rows": rows}

    def _clashes(self, held: dict, others: list[dict]) -> bool:
        return not self._rows([held]).join(self._rows(others).select(*self.key), self.key, "left_semi").isEmpty()

    def _publish(self, version: int, seen: list[dict], entry: dict) -> bool:
        whole = version % WHOLE == 0
        return self.folder.create(f"commits/{_name(version)}", json.dumps({"whole": whole, "entries": [*seen, entry] if whole else [entry]}, sort_keys=True))

    def _drop(self, held: dict | None) -> None:
        if held:
            self.folder.delete(f"data/commit={held['commit']}")

    def vacuum(self, seconds: float = 7 * 86400.0) -> int:
        """Delete folders that no manifest names and that are older than any writer can be; returns how many."""
        known = {f"commit={e['commit']}" for e in self.entries()}
        left = [n for n in self.folder.names("data") if n not in known and self.folder.age(f"data/{n}") >= seconds]
        for n in left:
            self.folder.delete(f"data/{n}")
        return len(left)


def adopt(spark: SparkSession, path: str, old: DataFrame, table_at: Callable[[str], KeyedTable]) -> None:
    """Make the files at ``path``, read as ``old``, a table; they stay as a hidden file beside it. A table whose making
    was cut off is made again from the start or, if only the last move is missing, moved."""
    above, _, name = path.rstrip("/").rpartition("/")
    folder, made = Folder(spark, above), f".{name}.table"
    table_at(f"{above}/{made}").append(old, "adopted", 0)
    folder.move(name, f".{name}.was")
    folder.move(made, name)


def _name(version: int) -> str:
    return f"{version:012d}.json"
