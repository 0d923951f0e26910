"""Folders of logs and definitions, and streams held against their batch twins."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from fightlake.operators import clock, effects, pulls, rules, stats
from fightlake.sources import logs as L
from fightlake.streaming import live
from tests.test_operators import FIELDS, NAMES, event


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "combat_2019-07-21_08_15_00_1.txt").write_bytes("[a] Ren\xe9\r\nsecond €\n\nfourth".encode("cp1252", "replace"))
    (tmp_path / "combat_2019-07-22_08_15_00_1.txt.gz").write_bytes(gzip.compress(b"packed\nlines"))
    (tmp_path / "combat_2019-07-21_08_15_00_1.txt.gz").write_bytes(gzip.compress(b"hidden by the plain file"))
    (tmp_path / "small.txt").write_bytes(b"x")
    (tmp_path / "other.csv").write_bytes(b"y" * 100)
    return tmp_path


def test_logs_are_read_decoded_and_numbered(spark, folder):
    got = sorted(tuple(r) for r in L.read_logs(spark, str(folder), 10).collect())
    name = "combat_2019-07-21_08_15_00_1"
    assert got == [(name, 1, "[a] Ren\xe9"), (name, 2, "second €"), (name, 4, "fourth"), ("combat_2019-07-22_08_15_00_1", 1, "packed"), ("combat_2019-07-22_08_15_00_1", 2, "lines")]


def test_only_changed_files_are_read_again(spark, folder):
    files = L.file_list(spark, str(folder), 10)
    index = files.select("name", "size", "modified").withColumn("summary", F.lit("old"))
    assert L.changed_files(files, index).count() == 0 and L.changed_files(files, index, force=True).count() == 2
    stale = index.withColumn("size", F.when(F.col("name").contains("07-22"), F.lit(1)).otherwise(F.col("size")))
    changed = L.changed_files(files, stale)
    assert [r.name for r in changed.collect()] == ["combat_2019-07-22_08_15_00_1.txt"]
    assert L.read_logs(spark, str(folder), only=changed).count() == 2
    fresh = changed.select("name", "size", "modified").withColumn("summary", F.lit("new"))
    assert sorted(r.summary for r in L.refreshed_index(files, stale, fresh).collect()) == ["new", "old"]


def test_a_bad_file_is_told_and_another_version_knows_nothing(spark, folder):
    (folder / "bad.txt.gz").write_bytes(b"\x1f\x8b\x08\x00 this is no gzip")
    files = L.file_list(spark, str(folder), 10)
    lines = L.read_logs(spark, str(folder), 10)
    assert lines.count() == 5 and [r.name for r in L.file_errors(files, lines).collect()] == ["bad.txt"]
    index = files.select("name", "size", "modified", F.lit(3).alias("version"))
    assert L.changed_files(files, index, version=3).count() == 0 and L.changed_files(files, index, version=4).count() == 3
    assert L.changed_files(files, index.drop("version"), version=3).count() == 3


def test_definitions_later_folder_wins(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    boss = {"id": "x", "name": "X", "boss_names": ["X"], "phases": [{"id": "p1", "name": "One"}, {"id": "p2", "name": "Two", "start_trigger": {"type": "hp_below", "percent": 50}}], "timers": [{"id": "", "label": "L", "cancel_trigger": {"type": "combat_end"}}]}
    (a / "x.json").write_text(json.dumps(boss))
    (b / "x.json").write_text(json.dumps(boss | {"name": "X2"}))
    (a / "bad.json").write_text("{not json")
    from fightlake.operators import maintenance

    got = L.read_definitions(spark, str(a), str(b))
    assert [(r.boss_id, r.boss_name) for r in L.boss_table(got).collect()] == [("x", "X2")]
    assert [r.percent for r in maintenance.hp_markers(L.phase_table(got)).collect()] == [50.0]
    assert maintenance.lint_timers(L.timer_table(got)).count() == 1


def test_history_keeps_the_newest(spark, tmp_path):
    rows = spark.createDataFrame([(f"log{i:02}", i) for i in range(30)], "log_path string, start_ms long")
    L.append_history(rows.limit(20), str(tmp_path / "h"))
    L.append_history(rows, str(tmp_path / "h"))
    assert L.read_history(spark, str(tmp_path / "h"), 5).first().log_path == "log29"


def drained(query):
    query.awaitTermination(300)
    assert query.exception() is None


def streamed(frame, tmp_path, live_form, mode="update", parts=3, once=True):
    """What a stream gives that gets the rows in files, in order of their lines: one list for each batch. With ``once``, the query starts anew for each."""
    live.use_state_store(frame.sparkSession)
    spark, lines = frame.sparkSession, sorted({r.line_number for r in frame.select("line_number").collect()})
    cuts = [lines[i * len(lines) // parts] for i in range(1, parts)]
    part = sum(((F.col("line_number") >= c).cast("int") for c in cuts), F.lit(0))
    found = {}

    def run(trigger):
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = live_form(stream).writeStream.outputMode(mode).foreachBatch(lambda df, n: found.__setitem__(n, df.collect())).option("checkpointLocation", str(tmp_path / "c"))
        drained(query.trigger(**trigger).start())

    for i in range(parts):
        frame.where(part == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        if once:
            run({"once": True})
    if not once:
        run({"availableNow": True})
    return [found[n] for n in sorted(found)]


def fighting(seed, logs=2, lines=60):
    rng = random.Random(seed)
    rows = []
    for log in range(logs):
        t = 0
        for line in range(lines):
            t += rng.choice([200, 1500, 3000, 4001, 9000])
            kind = rng.choice(["damage", "damage", "end", "start", "heal", "activate", "death", "none"])
            who = {"source": rng.choice("PQ"), "target": rng.choice("BC"), "target_is_player": rng.random() < 0.2, "avoidance": rng.choice([None, None, "dodge"]), "is_critical": rng.random() < 0.3}
            rows.append(event(line, t, kind, log_path=f"log{log}", amount=float(rng.randint(0, 90)), overheal=5.25, threat_delta=1.5, **who))
    return rows


def test_live_pulls_equal_the_batch(spark, tmp_path):
    table = spark.createDataFrame(fighting(3), FIELDS)
    found = [r for batch in streamed(table, tmp_path, live.live_pulls) for r in batch]
    last = {(r.log_path, r.pull_index): r for r in found}
    want = {(r.log_path, r.pull_index): (r.start_line, r.end_line, r.start_ms, r.end_ms, r.n_events) for r in pulls.pulls_of(pulls.with_pulls(table)).collect()}
    assert {k: tuple(map(int, r[2:7])) for k, r in last.items()} == want
    open_ = {r.log_path: max(k[1] for k in want if k[0] == r.log_path) for r in found}
    assert all(r.closed == (k[1] != open_[k[0]]) for k, r in last.items()) and len(want) > 10


def test_live_meter_is_that_of_the_open_pull_after_each_batch(spark, tmp_path):
    rows = fighting(5)
    table = spark.createDataFrame(rows, FIELDS)
    batches = streamed(table, tmp_path, live.live_meter)
    names = ["log_path", "pull_index", "name", "is_player", *stats.FIELDS, *stats.COUNTS]
    told = {}
    for i, batch in enumerate(batches):
        upto = table.where(F.col("line_number") < 60 * (i + 1) // 3)
        want = {tuple(r[c] for c in names) for r in stats.entity_stats(pulls.with_pulls(upto)).collect()}
        newest = {}
        for r in want:
            newest[r[0]] = max(newest.get(r[0], 0), r[1])
        assert {tuple(r[c] for c in names) for r in batch if not r.closed} == {r for r in want if r[1] == newest[r[0]]}
        told |= {(r.log_path, r.pull_index, r.name): tuple(r[c] for c in names) for r in batch}
    assert set(told.values()) == want and len({r[1] for r in want}) > 5
    # What is left in the state store belongs to the open pulls.
    state = spark.read.format("statestore").option("stateVarName", "totals").load(str(tmp_path / "c"))
    assert state.count() == sum(1 for r in want if r[1] == newest[r[0]])


def test_a_log_without_rows_is_told_as_ended_and_forgotten(spark, tmp_path):
    live.use_state_store(spark)
    early = [event(i, 1000 * i, "damage", log_path="old", amount=5.0) for i in range(3)]
    spark.createDataFrame(early, FIELDS).coalesce(1).write.parquet(str(tmp_path / "in" / "p0"))
    found = []

    def run():
        stream = spark.readStream.schema(FIELDS).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        drained(live.live_meter(stream, idle_ms=1).writeStream.outputMode("update").foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start())

    run()
    spark.createDataFrame([event(0, 0, "damage", log_path="new", amount=5.0)], FIELDS).coalesce(1).write.parquet(str(tmp_path / "in" / "p1"))
    run()
    assert sorted((r.name, r.damage_done, r.damage_taken) for r in found if r.log_path == "old" and r.closed) == [("B", 0.0, 15.0), ("P", 15.0, 0.0)]
    state = spark.read.format("statestore").option("stateVarName", "pull").load(str(tmp_path / "c"))
    assert state.selectExpr("key.log_path").distinct().count() <= 1


def effect_events(seed, spark):
    rng = random.Random(seed)
    more = "effect_name string, ability string, is_effect_removed boolean, is_charges_modified boolean, charges int"
    rows = []
    for row, t in zip(fighting(seed, 1, 150), range(0, 10**6, 700), strict=False):
        row = dict(zip(NAMES, row, strict=True))
        row |= {"t_ms": t + rng.randrange(500) + (20_000 if row["line_number"] >= 100 else 0), "is_combat_end": False, "is_combat_start": False}
        label = rng.choice(["Scorch", "Kolto Probe", "Kolto Shell", "Discharge"])
        removed, charged = rng.random() < 0.15, rng.random() < 0.2
        rows.append((*(row[n] for n in NAMES if n not in ("effect_name", "ability")), label if rng.random() < 0.6 else "Heal", label if rng.random() < 0.5 else None, removed, charged and not removed, rng.randint(0, 7)))
    schema = ", ".join(f for f in FIELDS.split(", ") if f.split()[0] not in ("effect_name", "ability"))
    return spark.createDataFrame(rows, f"{schema}, {more}")


def test_live_effects_equal_the_batch(spark, tmp_path):
    table = effect_events(11, spark)
    rules_ = effects.effect_rules(spark)
    batches = streamed(table, tmp_path, lambda s: live.live_effects(s, rules_))
    want = {tuple(r[c.split()[0]] for c in effects.TRACKED.split(", ")) for r in effects.tracked_effects(effects.effect_rows(pulls.with_pulls(table), rules_)).collect()}
    names = [c.split()[0] for c in effects.TRACKED.split(", ")]
    got = {tuple(r[c] for c in names) for batch in batches for r in batch if r.closed} | {tuple(r[c] for c in names) for r in batches[-1] if not r.closed}
    assert got == want and len({r[1] for r in want}) > 1 and any(r[9] for r in want) and any(r[8] for r in want)
    state = spark.read.format("statestore").option("stateVarName", "on").load(str(tmp_path / "c"))
    assert state.count() == sum(not r.closed for r in batches[-1])


def test_live_countdowns_equal_the_batch(spark, tmp_path):
    table = effect_events(12, spark).withColumn("is_death", F.col("line_number") % 11 == 0).withColumn("is_ability_activate", F.lit(False)).withColumn("effect_type", F.lit("ApplyEffect"))
    kept = [(1, "Burn", "scorch", "dot", 3000, 0), (2, "Burn", "discharge", "dot", 1500, 0), (3, "Probe", "kolto probe", "custom", 2500, 0), (4, "Shell", "shell", "cooldown", 4000, 0)]
    rules_ = spark.createDataFrame([(*r[:4], True, *r[4:]) for r in kept], "rule_id int, label string, keyword string, category string, when_applied boolean, duration_ms long, warn_ms long")
    batches = streamed(table, tmp_path, lambda s: live.live_countdowns(s, rules_))
    split = pulls.with_pulls(table)
    names = ["pull_index", "rule_id", "label", "category", "target", "line_number", "start_ms", "end_ms", "ended"]
    want = {tuple(r[c] for c in names) for r in rules.timer_intervals(rules.keyword_hits(split, rules_), split).collect()}
    last = max(r["t_ms"] for r in table.select("t_ms").collect())
    got = {tuple(r[c] for c in names) for batch in batches for r in batch if r.closed}
    assert {r for r in want if r[7] < last} <= got <= want and {r[8] for r in want} == {"expired", "refreshed", "died"} and len({r[0] for r in want}) > 1
    assert {(r.label, r.end_ms) for r in batches[-1] if not r.closed} == {(r[2], r[7]) for r in want - got}


def test_live_taunts_equal_the_batch_and_the_last_ones_are_remembered(spark, tmp_path):
    rng = random.Random(10)
    rows, t = [], 0
    for i in range(120):
        t += rng.choice([40, 200, 300, 900, 3000]) + (30_000 if i == 70 else 0)
        kind = rng.choice(["cast", "effect", "effect", "other"])
        if kind == "cast":
            rows.append(event(i, t, "activate", ability="Taunt", target="P", target_is_player=True))
        else:
            rows.append(event(i, t, "none", effect_type="ApplyEffect", effect_name="Taunt" if kind == "effect" else "x", target=rng.choice("XYZ")))
    rows += [event(200 + i, t + 100_000 * i + 60_000, "damage") for i in range(2)]
    frame = spark.createDataFrame(rows, FIELDS)
    found = [r for batch in streamed(frame, tmp_path, live.live_taunts) for r in batch]
    want = sorted((r.pull_index, r.at_ms, r.kind, r.hit, r.targets) for r in rules.taunts(pulls.with_pulls(frame)).collect())
    assert sorted((r.pull_index, r.at_ms, r.kind, r.hit, r.targets) for r in found) == want and len({r[0] for r in want}) > 1
    assert json.loads(found[-1].recent) == [[r.at_ms, r.kind, r.hit, r.targets] for r in found[-6:]]


def test_live_clock_equals_the_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for log in range(2):
        t = wall = 0
        for i in range(60):
            t += rng.choice([0, 100, 900])
            wall = max(wall, t + rng.choice([50, 50, 4000]))
            rows.append((f"l{log}", i, t, 1_000_000 + wall))
    frame = spark.createDataFrame(rows, "log_path string, line_number long, t_ms long, wall_ms long")
    got = {(r.log_path, r.line_number): r.at_ms for batch in streamed(frame, tmp_path, live.live_clock, "append") for r in batch}
    assert got == {(r.log_path, r.line_number): r.at_ms for r in clock.with_capped_clock(frame).collect()}
    for log in range(2):  # the rule step by step
        at = before = None
        for _, i, t, wall in (r for r in rows if r[0] == f"l{log}"):
            at = wall if at is None else at + min(wall - at, t - before)
            before = t
            assert got[f"l{log}", i] == at


def test_live_sessions_take_late_rows_in_any_order(spark, tmp_path):
    rng = random.Random(14)
    rows, lines = [], 0
    for user in "uv":
        t = 0
        for _ in range(80):
            t += rng.choice([100, 400, 1000, 1001, 2500])
            rows.append([user, t])
    rows.sort(key=lambda r: r[1] + rng.randrange(3000))  # up to three seconds out of order
    rows = [(u, t, i) for i, (u, t) in enumerate(rows)] + [("z", 10**6, 900), ("u", 50, 901), ("z", 2 * 10**6, 902)]  # 901 is far too late
    frame = spark.createDataFrame(rows, "user string, t_ms long, line_number long").withColumn("at", F.timestamp_millis("t_ms"))
    batches = streamed(frame, tmp_path, lambda s: live.live_sessions(s, "user", "at", 1000, "4 seconds"), "append", parts=8, once=False)
    got = sorted((r.user, r.start, r.end, r.n) for batch in batches for r in batch if r.user != "z")
    split = pulls.gap_sessions(frame.where("user <> 'z' and line_number <> 901"), "user", "t_ms", 1000)
    want = sorted((r.user, r.start, r.end, r.n) for r in split.groupBy("user", "session_index").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n")).collect())
    assert got == want and len(want) > 20


def test_growing_files_are_read_on_with_true_line_numbers(spark, tmp_path):
    from fightlake.sources.growing import GrowingLogs

    spark.dataSource.register(GrowingLogs)
    folder = tmp_path / "logs"
    folder.mkdir()
    found = []

    def run():
        stream = spark.readStream.format("growing_logs").load(str(folder))
        drained(stream.writeStream.foreachBatch(lambda df, _: found.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start())

    (folder / "a.txt").write_bytes("one\r\ntw\xf6\n\nhalf a li".encode("latin-1"))
    run()
    assert sorted(found) == [("a", 1, "one"), ("a", 2, "tw\xf6")]
    with (folder / "a.txt").open("ab") as f:
        f.write(b"ne\nthree\rfour\r\n")
    (folder / "b.txt").write_bytes(b"x" * 200_000 + b"\ny")
    run()
    assert sorted(found)[2:] == [("a", 4, "half a line"), ("a", 5, "three"), ("a", 6, "four"), ("b", 1, "x" * 200_000)]
    (folder / "b.txt").write_bytes(b"anew\n")  # another file of that name
    run()
    assert sorted(found)[5:] == [("b", 1, "anew"), ("b", 1, "x" * 200_000)]
    # The same lines as those of the finished file, read as a batch.
    whole = sorted(tuple(r) for r in L.read_logs(spark, str(folder), 0).where("log_path = 'a'").collect())
    assert whole == sorted(r for r in found if r[0] == "a")


def test_pieces_and_steps_of_growing_files_cover_all_lines(tmp_path, monkeypatch):
    from fightlake.sources import growing

    monkeypatch.setattr(growing, "PIECE", 700)
    monkeypatch.setattr(growing, "CHUNK", 64)
    rng = random.Random(3)
    text = {n: "".join("x" * rng.choice([0, 5, 40, 900]) + rng.choice(["\n", "\r\n", "\n\n", "\r"]) for _ in range(150)) + "\nlast" for n in "ab"}
    for n, t in text.items():
        (tmp_path / f"{n}.txt").write_bytes(t.encode())
    reader = growing._Reader({"path": str(tmp_path), "maxBytesPerTrigger": "1500"})
    reader.begun = True
    at, got, steps = {}, [], 0
    while (end := reader.latestOffset()) != at:
        steps += 1
        for piece in reader.partitions(at, end):
            got += [tuple(r.values()) for b in reader.read(piece) for r in b.to_pylist()]
        at = end
    import re

    want = [(n, i, x) for n, t in text.items() for i, x in enumerate(re.split("\r\n|\n|\r", t)[:-1], 1) if x]
    assert sorted(got) == sorted(want) and steps > 10


def test_a_batch_told_twice_is_stored_once(spark, tmp_path):
    rows = spark.createDataFrame([("log", 0, 10, True), ("log", 1, 20, True), ("log", 2, 30, False)], "log_path string, pull_index long, start_ms long, closed boolean")
    sink = L.history_sink(str(tmp_path / "h"))
    for batch, upto in ((0, 1), (0, 1), (1, 2), (1, 2)):
        sink(rows.where(F.col("pull_index") == upto - 1).unionByName(rows.where("not closed")), batch)
    L.append_history(rows.where("pull_index = 1"), str(tmp_path / "h"), 2)  # told again by a stream that began anew
    assert [(r.pull_index, r.start_ms) for r in L.read_history(spark, str(tmp_path / "h")).collect()] == [(1, 20), (0, 10)]


def test_what_a_display_stays_on(spark):
    pulls_ = spark.createDataFrame([("l", 0, 10), ("l", 1, 20), ("l", 2, 30), ("m", 0, 5)], "log_path string, pull_index long, start_ms long")
    totals = spark.createDataFrame([("l", 0, 5.0, 0.0), ("l", 1, 0.0, 3.0), ("l", 2, 0.0, 0.0)], "log_path string, pull_index long, damage_done double, healing_done double")
    assert sorted(tuple(r) for r in live.live_shown(pulls_, totals).collect()) == [("l", 1), ("m", 0)]
