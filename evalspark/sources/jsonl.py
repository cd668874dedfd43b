"""JSON-lines scans and appends with declared schemas, and integrity checks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domain
from ..functions.numbering import prefix_sums
from ..runtime import cut
from . import schemas
from .files import Folder


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


DIGEST_CHUNK = 1 << 20
#: Splits whose numbers of lines may be broadcast, some 100 bytes each; beyond that the lines are joined by a shuffle.
BROADCAST_SPLITS = 100_000


def _opened(path: str):
    """A file as a stream, by the file system of its path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + path.removeprefix("file:").lstrip("/"))
    system, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(name)


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file under ``path``.

    Executors read in chunks, so a file of any size takes little memory, one task a file, for a digest has no parts. Where
    only Spark knows the file system, its reader hands over the whole file, of 2 GB at most.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name in pdf["path"]:
                digest = hashlib.sha256()
                try:
                    with _opened(name) as f:
                        while chunk := f.read(DIGEST_CHUNK):
                            digest.update(chunk)
                except (ValueError, ImportError, OSError):
                    out.append(None)
                else:
                    out.append(digest.hexdigest())
            yield pd.DataFrame({"path": pdf["path"], "sha256": out}, dtype=object)

    names = [unquote(x) for x in spark.read.format("binaryFile").load(path).inputFiles()]  # empty ones, too, have no row there
    listed = spark.createDataFrame([(n,) for n in names], "path string")
    found = listed.repartition(max(1, len(names)), "path").mapInPandas(run, "path string, sha256 string").cache()
    rest = [r["path"] for r in found.where("sha256 is null").select("path").collect()]  # names of files
    if not rest:
        return found
    whole = spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?])", r"\\\1", r) for r in rest]).select("path", F.sha2("content", 256).alias("whole"))
    digest = F.coalesce("sha256", "whole", F.lit(hashlib.sha256().hexdigest()))
    return found.join(whole, "path", "left").select("path", digest.alias("sha256"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of all lines of text files, blank ones too, from any number of splits.

    Lines of a split are counted in one pass and numbered where they are read in a second; what moves is one row a split,
    and lines stay in their order, as long as there are at most ``BROADCAST_SPLITS`` (some terabytes of text).
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("at")
    text = spark.read.text(path).select("value", place, F.monotonically_increasing_id().alias("id"))
    splits = text.groupBy("at").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    splits = splits.select("at.file", "at.start", "first", "lines")
    splits = cut(prefix_sums(splits, ["file"], ["start"], {"before": F.col("lines")}))
    splits = F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits
    same = (F.col("at.file") == F.col("file")) & (F.col("at.start") == F.col("start"))
    return text.join(splits, same).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), F.col("value").alias("line"))


def read_items(spark: SparkSession, path: str, sha256: str | None = None, total: int | None = None) -> DataFrame:
    """Items in order of id; digest and number of rows are checked first where they are given."""
    if sha256 is not None and (got := file_sha256(spark, path).first()["sha256"]) != sha256:
        raise ValueError(f"{path}: sha256 is {got}, the manifest says {sha256}")
    df = spark.read.schema(schemas.ITEMS + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    if bad := df.where("_corrupt is not null or id is null").select(F.coalesce("_corrupt", F.lit("an item without id"))).first():
        raise ValueError(f"{path}: not an item: {bad[0][:200]}")
    df = df.drop("_corrupt")
    if total is not None and (n := df.count()) != total:
        raise ValueError(f"{path}: {n} items, the manifest says {total}")
    return df.orderBy("id")


def write_items(items: DataFrame, path: str) -> None:
    items.orderBy("id").write.mode("overwrite").json(path)


def write_items_file(items: DataFrame, folder: str, name: str) -> dict:
    """One JSON-lines file of the items in order of id, and its sha256 and number of lines. A data set is one file by its
    format, so it is written by one task; it takes the old one's place when it is whole."""
    spark, at = items.sparkSession, Folder(items.sparkSession, folder)
    made = f".{name}.parts"
    items.orderBy("id").coalesce(1).write.mode("overwrite").json(f"{folder}/{made}")
    part = next(n for n in at.names(made) if n.startswith("part-"))
    at.move(f"{made}/{part}", name, over=True)
    at.delete(made)
    return {"sha256": file_sha256(spark, f"{folder}/{name}").first()["sha256"], "total": spark.read.text(f"{folder}/{name}").count()}


def write_dataset(items: DataFrame, folder: str, name: str, **about: object) -> dict:
    """Items as one file, and its entry in a plain manifest {name: entry} with sorted keys; returns the entry."""
    entry = write_items_file(items, folder, name) | about
    at = Folder(items.sparkSession, folder)
    old = json.loads(at.read("manifest.json")) if at.exists("manifest.json") else {}
    at.replace("manifest.json", json.dumps(old | {name: entry}, sort_keys=True, indent=2, ensure_ascii=False) + "\n")
    return entry


#: Fields of an entry of the published manifest, in order.
MANIFEST_ENTRY = (
    "dataset_version string, language string, commit string, file string, converter_version string, total bigint, categories map<string,bigint>, splits map<string,bigint>, "
    "category_splits map<string,bigint>, duplicate_ids bigint, duplicate_prompts bigint, sha256 string"
)


def manifest_entry(items: DataFrame, version: str, language: str, commit: str) -> dict:
    """What the published manifest says of items, but for their file: totals, counts by category and split (zeros too),
    by both where there are any, and how many ids and prompts repeat earlier ones."""
    from ..operators.aggregate import duplicates, manifest_counts

    named = items.withColumn("split", F.col("context_condition"))
    counts: dict[str, dict[str, int]] = {"category": {}, "split": {}, "category/split": {}}
    for r in manifest_counts(named, list(domain.CATEGORIES), list(domain.SPLITS)).collect():  # a row a category and split
        counts[r["kind"]][r["name"]] = r["n"]
    again = duplicates(named, "id", ["context", "question"]).first()
    in_order = lambda kind, names: {x: counts[kind][x] for x in names}
    return {
        "dataset_version": version, "language": language, "commit": commit, "converter_version": domain.CONVERTER_VERSION, "total": sum(counts["category"].values()),
        "categories": in_order("category", domain.CATEGORIES), "splits": in_order("split", domain.SPLITS), "category_splits": dict(sorted(counts["category/split"].items())),
        "duplicate_ids": again["duplicate_ids"], "duplicate_prompts": again["duplicate_contents"],
    }


def publish_dataset(items: DataFrame, folder: str, name: str, version: str, language: str, commit: str) -> dict:
    """Items as one file, and its entry in a manifest {converter_version, files: {name: entry}}; returns the entry.

    Entries of other files stay. The manifest is replaced at once, after the file is there.
    """
    spark = items.sparkSession
    about = manifest_entry(items, version, language, commit)
    written = write_items_file(items, folder, name)
    if written["total"] != about["total"]:
        raise ValueError(f"{name}: {written['total']} lines for {about['total']} items of known categories")
    whole = about | {"file": name, "sha256": written["sha256"]}
    entry = {f.split()[0]: whole[f.split()[0]] for f in MANIFEST_ENTRY.split(", ")}
    at = Folder(spark, folder)
    old = json.loads(at.read("manifest.json")) if at.exists("manifest.json") else {}
    files = old.get("files", {}) | {name: entry}
    at.replace("manifest.json", json.dumps({"converter_version": domain.CONVERTER_VERSION, "files": dict(sorted(files.items()))}, ensure_ascii=False, indent=2) + "\n")
    return entry


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name and the entry's fields, from a manifest {converter_version, files: {name: entry}} or a plain {name: entry}."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{path} is missing; build the dataset first")
    text = spark.read.text(path, wholetext=True)
    typed = MANIFEST_ENTRY.replace(" ", ":").replace(",:", ",")
    files = F.coalesce(F.from_json("value", f"files map<string,struct<{typed}>>")["files"], F.from_json("value", f"map<string,struct<{typed}>>"))
    return text.select(F.explode(files).alias("name", "entry")).select("name", "entry.*")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All lines; a missing file is an empty ledger, a line that is no JSON is an error that names its number, and JSON
    that is no object is left out. Files may be of any size: they are read in splits."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.LEDGER)
    if path_exists(spark, f"{path}/commits"):
        from ..operators.recovery import ledger_table

        return ledger_table(spark, path).read().drop("attempt")
    lines = numbered_lines(spark, path).where(F.trim("line") != "").withColumn("parsed", F.try_parse_json("line"))
    if bad := lines.where(F.col("parsed").isNull()).orderBy("file", "line_no").first():
        raise ValueError(f"{bad['file']}: line {bad['line_no']} is no JSON: {bad['line'][:200]}")
    return lines.where(F.startswith(F.schema_of_variant("parsed"), F.lit("OBJECT"))).select(F.from_json("line", schemas.LEDGER).alias("x")).select("x.*")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Records with neutral defaults for what old lines lack; null metric values read as NaN."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.HISTORY)
    whole = history_table(spark, path).read() if path_exists(spark, f"{path}/commits") else spark.read.schema(schemas.HISTORY).json(path)
    df = whole.where("config is not null")
    nan = lambda m: F.transform_values(F.coalesce(m, F.create_map().cast("map<string,double>")), lambda _, v: F.coalesce(v, F.lit(float("nan"))))
    return df.withColumns({
        "group": F.coalesce("group", F.lit("unknown")), "reasoning": F.coalesce("reasoning", F.lit("off")), "style": F.coalesce("style", F.lit("clean")),
        "samples": F.coalesce("samples", F.lit(0)), "reasoning_tokens": F.coalesce("reasoning_tokens", F.lit(0)), "metrics": nan(F.col("metrics")), "ses": nan(F.col("ses")),
    })


def json_safe(df: DataFrame, digits: int = 6) -> DataFrame:
    """NaN and infinite map values become null and others are rounded half even; Spark's JSON writer would quote NaN."""
    fix = lambda m: F.transform_values(m, lambda _, v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None).cast("double")).otherwise(F.bround(v, digits)))
    return df.withColumns({c: fix(F.col(c)) for c in ("metrics", "ses") if c in df.columns})


def history_table(spark: SparkSession, path: str):
    """The history at ``path`` as a table with one record a key, which several writers may append to."""
    from .commits import KeyedTable

    return KeyedTable(spark, path, schemas.HISTORY.split(", ", 1)[1], ["key"], "created")


def append_history(spark: SparkSession, batch: DataFrame, path: str) -> tuple[int, int]:
    """Append what is new by key; returns (added, skipped). Running it again adds nothing, nor do two writers add a key
    twice. Files of JSON lines that another program wrote (no table of commits) are the table's first commit."""
    from .commits import adopt

    if path_exists(spark, path) and not path_exists(spark, f"{path}/commits"):
        adopt(spark, path, spark.read.schema(schemas.HISTORY).json(path).where("config is not null").drop("line_no"), lambda p: history_table(spark, p))
    return history_table(spark, path).append(json_safe(batch.drop("line_no")))


def read_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Completions of successful runs under ``path`` (any depth), and the runs that are left out."""
    df = spark.read.option("recursiveFileLookup", True).parquet(path)
    good = (F.col("status") == "success") & F.col("id").isNotNull()
    return df.where(good), df.where(~F.coalesce(good, F.lit(False))).select("run_key", "status").distinct()
