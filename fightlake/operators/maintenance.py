"""Jobs on stored pulls and logs: slices, overlaps, imports, merges, rebuilds, exports and anonymous copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import half_even

#: A player's token: whatever stands between @ and the first # with digits, but for the signs that end a field.
TOKEN = r"@[^\]|]*?#\d+"


def line_slice(events: DataFrame, log_path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Events of a line range (inclusive; none given: the whole file). The filters reach the Parquet scan."""
    rows = events.where(F.col("log_path") == log_path)
    if start is not None:
        rows = rows.where(F.col("line_number") >= start)
    return rows if end is None else rows.where(F.col("line_number") <= end)


#: Lines of a bucket that ranges of lines meet by.
BUCKET = 4096


def _bucketed(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each bucket that a range of lines touches."""
    at = lambda c: F.floor(F.col(c) / BUCKET)
    return ranges.where(F.col(start) <= F.col(end)).withColumn("bucket", F.explode(F.sequence(at(start), at(end))))


def at_pointers(events: DataFrame, pointers: DataFrame) -> DataFrame:
    """Events with each pointer (log_path, start_line, end_line, pointer_id) whose range holds them; they meet by log and bucket of lines."""
    inside = F.col("line_number").between(F.col("start_line"), F.col("end_line"))
    rows = events.withColumn("bucket", F.floor(F.col("line_number") / BUCKET))
    return rows.join(_bucketed(pointers, "start_line", "end_line"), ["log_path", "bucket"]).where(inside).drop("bucket")


def overlapping(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """For each stored pull (stored_id, log_path, start_line, end_line) the first derived pull of its file that overlaps it."""
    d = derived.select("log_path", F.col("pull_index").alias("derived_index"), F.col("start_line").alias("d_start"), F.col("end_line").alias("d_end"), F.col("start_ms").alias("derived_start_ms"))
    both = _bucketed(stored, "start_line", "end_line").join(_bucketed(d, "d_start", "d_end"), ["log_path", "bucket"]).where("start_line <= d_end and end_line >= d_start")
    w = Window.partitionBy("stored_id").orderBy("d_start")
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "d_start", "d_end", "bucket")


def import_status(new: DataFrame, history: DataFrame) -> DataFrame:
    """New pulls with status: duplicate (known by file and lines), sliver (no damage) or imported."""
    key = ["log_path", "start_line", "end_line"]
    known = history.select(*key).distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("known"), "duplicate").when(~F.col("is_fight"), "sliver").otherwise("imported")
    return new.join(known, key, "left").withColumn("status", status).drop("known")


def merged(logs: DataFrame, order: str = "file_rank") -> DataFrame:
    """Events of several logs once each: the first by file and line of those equal in time, source, target, ability, effect and amount."""
    w = Window.partitionBy("timestamp", "source", "target", "ability", "effect_name", "amount").orderBy(order, "line_number")
    return logs.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def export_range(lines: DataFrame, pull: dict, more_ms: int = 5000) -> DataFrame:
    """Lines (log_path, line_number, t_ms, line) of a pull, the area line before it, and those within ``more_ms`` after, up to a line without time or back in time."""
    rows = lines.where(F.col("log_path") == pull["log_path"])
    inside = F.col("line_number").between(pull["start_line"], pull["end_line"]) | (F.col("line_number") == F.lit(pull.get("area_line")))
    w = Window.partitionBy("log_path").orderBy("line_number")
    last_ms = F.max(F.when(F.col("line_number") == pull["end_line"], F.col("t_ms"))).over(Window.partitionBy("log_path"))
    # The first line that ends the export is looked for among lines that could be it, without a limit of their number.
    tail = rows.where(F.col("line_number") >= pull["end_line"]).withColumns({"last_ms": last_ms, "before": F.lag("t_ms").over(w)}).where(F.col("line_number") > pull["end_line"])
    bad = F.coalesce(F.col("t_ms").isNull() | (F.col("t_ms") > F.col("last_ms") + more_ms) | (F.col("t_ms") < F.col("before")), F.lit(True))
    after = tail.withColumn("stop", F.min(F.when(bad, F.col("line_number"))).over(Window.partitionBy("log_path"))).where("stop is null or line_number < stop")
    return rows.where(F.coalesce(inside, F.lit(False))).unionByName(after.select(*lines.columns))


def rebuilt(history: DataFrame, events: DataFrame, version: int) -> DataFrame:
    """Stored pulls (stored_id, log_path, start_line, end_line, data_version, duration[, unverified]) brought up to ``version``.

    An older row is computed anew from the events of its own line range: ``rebuilt`` (duration and damage are those found), ``dropped`` (no fight) or
    ``unverified`` (the log is gone or has no event there; the row stays as it is and isn't tried again). Others are ``current``.
    """
    if "unverified" not in history.columns:
        history = history.withColumn("unverified", F.lit(False))
    stale = history.where((F.col("data_version") < version) & ~F.coalesce("unverified", F.lit(False)))
    found = at_pointers(events, stale.select("stored_id", "log_path", "start_line", "end_line"))
    ends = F.coalesce(F.min(F.when(F.col("is_combat_end"), F.col("t_ms"))), F.max("t_ms"))
    attack = F.col("is_damage") & F.col("ability").isNotNull() & (F.col("amount") > 0)
    fresh = found.groupBy("stored_id").agg(
        F.greatest((ends - F.min("t_ms")) / 1000, F.lit(0.001)).alias("new_duration"), F.max(attack).alias("is_fight"), F.sum(F.when(attack, F.col("amount").cast("decimal(18,2)"))).cast("double").alias("damage")
    )
    rows = history.join(fresh, "stored_id", "left")
    status = F.when(F.col("data_version") >= version, "current").when(F.col("is_fight").isNull(), "unverified").when(F.col("is_fight"), "rebuilt").otherwise("dropped")
    new = F.col("status") == "rebuilt"
    rows = rows.withColumn("status", status).withColumns({"duration": F.when(new, F.col("new_duration")).otherwise(F.col("duration")), "data_version": F.when(new, F.lit(version)).otherwise(F.col("data_version")), "unverified": F.col("status") == "unverified"})
    return rows.drop("new_duration", "is_fight")


def rebuild_report(rebuilt_rows: DataFrame) -> DataFrame:
    """How many rows there are of each status."""
    return rebuilt_rows.groupBy("status").count()


def history_listing(history: DataFrame, stats: DataFrame, n: int = 3) -> DataFrame:
    """Pulls, newest first, each with its top players by damage rate and whether its numbers couldn't be verified."""
    w = Window.partitionBy("log_path", "pull_index").orderBy(F.desc("dps"), "name")
    best = stats.where("is_player").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    tops = best.groupBy("log_path", "pull_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "dps"))), lambda x: F.concat(x["name"], F.lit(" "), half_even(x["dps"]).cast("string"))).alias("top"))
    rows = history.join(tops, ["log_path", "pull_index"], "left")
    return rows.select("log_path", "pull_index", "start_ms", half_even("duration", 1).alias("duration"), F.coalesce(F.array_join("top", ", "), F.lit("")).alias("top"), F.coalesce("unverified", F.lit(False)).alias("unverified")).orderBy(F.desc("log_path"), F.desc("start_ms"))


def anonymous_names(lines: DataFrame) -> DataFrame:
    """(log_path, token, new_token): players numbered by first appearance in their file."""
    tokens = lines.select("log_path", "line_number", F.posexplode(F.regexp_extract_all("line", F.lit(f"({TOKEN})"), F.lit(1))).alias("pos", "token"))
    first = tokens.groupBy("log_path", "token").agg(F.min(F.struct("line_number", "pos")).alias("at"))
    n = F.row_number().over(Window.partitionBy("log_path").orderBy("at"))
    return first.select("log_path", "token", F.concat(F.lit("@Player"), n, F.lit("#"), F.lpad(n.cast("string"), 8, "0")).alias("new_token"))


def anonymised(lines: DataFrame) -> DataFrame:
    """Lines with each player token replaced. Only the distinct tokens meet their names; a line is put together from its own."""
    names = anonymous_names(lines)
    tokens = lines.select("log_path", "line_number", F.posexplode(F.regexp_extract_all("line", F.lit(f"({TOKEN})"), F.lit(1))).alias("pos", "token"))
    new = tokens.join(names, ["log_path", "token"]).groupBy("log_path", "line_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new_token"))), lambda x: x["new_token"]).alias("new"))
    rows = lines.join(new, ["log_path", "line_number"], "left")
    text = F.array_join(F.zip_with(F.split("line", TOKEN, -1), "new", lambda part, token: F.concat(part, F.coalesce(token, F.lit("")))), "")
    return rows.withColumn("line", F.coalesce(F.when(F.col("new").isNotNull(), text), F.col("line"))).drop("new")


def kill_names(bosses: DataFrame) -> DataFrame:
    """(boss_id, name): names contained in the display name or containing it; all names where none is."""
    near = F.filter("names", lambda n: F.lower("boss_name").contains(F.lower(n)) | F.lower(n).contains(F.lower("boss_name")))
    return bosses.select("boss_id", F.explode(F.when(F.size(near) > 0, near).otherwise(F.col("names"))).alias("name"))


def hp_markers(phases: DataFrame) -> DataFrame:
    """(boss_id, percent) of phases whose own start trigger (JSON text) is hp_below."""
    of = lambda name: F.get_json_object("start_trigger", f"$.{name}")
    return phases.where(of("type") == "hp_below").select("boss_id", of("percent").cast("double").alias("percent"))


def lint_timers(timers: DataFrame) -> DataFrame:
    """Timers with a cancel trigger but no id."""
    return timers.where("cancel_trigger is not null and (timer_id is null or timer_id = '')")
