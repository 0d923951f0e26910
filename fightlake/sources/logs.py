"""Folders of logs, rule definitions and history as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIN_FILE_BYTES = 50_000
#: What the bytes 0x80 to 0x9F are in Windows code page 1252 (unused ones become U+FFFD).
CP1252 = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))


def decoded(data: Column) -> Column:
    """Bytes as Windows-1252, with the default charset rules of Spark."""
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), CP1252)


def file_list(spark: SparkSession, folder: str, min_bytes: int = MIN_FILE_BYTES) -> DataFrame:
    """(path, name, size, modified) of the logs; ``x.txt`` hides ``x.txt.gz``; small plain files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,txt.gz}").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    files = files.withColumns({"name": F.regexp_extract("path", r"([^/]+?)(?:\.gz)?$", 1), "packed": F.col("path").endswith(".gz")})
    w = Window.partitionBy("name").orderBy("packed")
    return files.withColumn("n", F.row_number().over(w)).where((F.col("n") == 1) & (F.col("packed") | (F.col("size") >= min_bytes))).drop("n")


def read_logs(spark: SparkSession, folder: str, min_bytes: int = MIN_FILE_BYTES, only: DataFrame | None = None) -> DataFrame:
    """(log_path, line_number, line) of the logs in ``folder``, or of those in ``only`` (path).

    Files are the unit of parallel reading, as line numbers are counted from a file's first line. A file that can't be read
    gives the lines before the damage, or none, and never fails the job; :func:`file_errors` names those without any.
    """
    chosen = file_list(spark, folder, min_bytes) if only is None else only
    text = spark.read.option("pathGlobFilter", "*.{txt,txt.gz}").option("ignoreCorruptFiles", True).text(folder, wholetext=True)
    whole = text.select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:///").alias("path"), F.col("value").cast("binary").alias("data"))
    kept = whole.join(chosen.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path")).distinct(), "path", "left_semi")
    lines = kept.select(F.regexp_extract("path", r"([^/]+?)(?:\.txt)?(?:\.gz)?$", 1).alias("log_path"), F.posexplode(F.split(decoded(F.col("data")), "\r\n|\n|\r", -1)).alias("n", "line"))
    return lines.where("line <> ''").select("log_path", (F.col("n") + 1).cast("long").alias("line_number"), "line")


def changed_files(files: DataFrame, index: DataFrame, force: bool = False, version: int | None = None) -> DataFrame:
    """Files that the stored index (name, size, modified[, version]) does not know as they are now; another ``version`` of the index knows none."""
    if version is not None:
        index = index.where(F.col("version") == version) if "version" in index.columns else index.limit(0)
    return files if force else files.join(index.select("name", "size", "modified"), ["name", "size", "modified"], "left_anti")


def file_errors(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(name, size, modified, error) of files that gave no line: they are empty, or couldn't be read to the first one."""
    log = F.regexp_extract("name", r"^(.*?)(?:\.txt)?$", 1)
    rows = files.withColumn("log_path", log).join(lines.select("log_path").distinct(), "log_path", "left_anti")
    return rows.select("name", "size", "modified", F.lit("no line could be read").alias("error"))


def refreshed_index(files: DataFrame, index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index without rows of files that are gone or changed, plus the ``fresh`` ones."""
    kept = index.join(files.select("name", "size", "modified"), ["name", "size", "modified"], "left_semi")
    return kept.unionByName(fresh, allowMissingColumns=True)


def read_definitions(spark: SparkSession, *folders: str) -> DataFrame:
    """Boss definitions; a later folder's wins over the same id; documents that can't be read are skipped.

    Conditions nest without a limit, so each stays JSON text; :func:`fightlake.operators.conditions.definitions_of` reads them.
    """
    schema = (
        "id string, name string, boss_names array<string>, boss_npc_ids array<string>, encounter_trigger string, "
        "phases array<struct<id: string, name: string, difficulties: array<string>, start_trigger: string, conditions: array<string>, end_trigger: string>>, "
        "counters array<struct<id: string, name: string, increment_on: string, decrement_on: string, reset_on: string, initial_value: double>>, "
        "timers array<struct<id: string, label: string, duration_seconds: double, warn_seconds_before: double, trigger: string, conditions: array<string>, cancel_trigger: string, "
        "phases: array<string>, difficulties: array<string>, group_sizes: array<int>, repeat_interval_seconds: double, repeat_count: int, is_alert: boolean, "
        "announce_on_start: boolean, announce_target: boolean, voice_alert: boolean>>"
    )
    parts = [spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(f).withColumns({"rank": F.lit(i), "file": F.col("_metadata.file_name")}) for i, f in enumerate(folders)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    w = Window.partitionBy("id").orderBy(F.desc("rank"), "file")
    return rows.where("id is not null").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "rank")


def boss_table(definitions: DataFrame) -> DataFrame:
    """(boss_id, boss_name, def_rank, npc_ids, names) as :mod:`fightlake.operators.corpus` takes it."""
    empty = F.array().cast("array<string>")
    return definitions.select(F.col("id").alias("boss_id"), F.col("name").alias("boss_name"), F.col("file").alias("def_rank"), F.coalesce("boss_npc_ids", empty).alias("npc_ids"), F.coalesce("boss_names", empty).alias("names"))


def phase_table(definitions: DataFrame) -> DataFrame:
    return definitions.select(F.col("id").alias("boss_id"), F.posexplode("phases").alias("ord", "p")).select("boss_id", "ord", "p.*")


def timer_table(definitions: DataFrame) -> DataFrame:
    return definitions.select(F.col("id").alias("boss_id"), F.explode("timers").alias("t")).select("boss_id", F.col("t.id").alias("timer_id"), F.expr("t.* except (id)"))


def append_history(pulls: DataFrame, folder: str, batch: int | None = None) -> None:
    """Add pulls to the history. With the number of a ``batch``, what is there of that batch is replaced, so a batch that is told twice is stored once."""
    if batch is None:
        pulls.write.mode("append").parquet(f"{folder}/batch=-1")
    else:
        pulls.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def history_sink(folder: str):
    """For ``foreachBatch``: closed pulls of each batch go to the history once, however often the batch is run."""

    def put(pulls: DataFrame, batch: int) -> None:
        append_history(pulls.where("closed") if "closed" in pulls.columns else pulls, folder, batch)

    return put


def read_history(spark: SparkSession, folder: str, newest: int = 200) -> DataFrame:
    """The newest pulls of the history; a pull that several batches told of, as a stream that began anew does, counts once, as the last one told it."""
    rows = spark.read.option("mergeSchema", True).parquet(folder)
    key = [c for c in ("log_path", "pull_index", "start_ms") if c in rows.columns]
    if "pull_index" in key:
        last = Window.partitionBy(*key).orderBy(F.desc("batch"))
        rows = rows.withColumn("__n", F.row_number().over(last)).where("__n = 1 or batch = -1").drop("__n")
    return rows.drop("batch").orderBy(F.desc("log_path"), F.desc("start_ms")).limit(newest)
