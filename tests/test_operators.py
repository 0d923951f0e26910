"""Values worked out by hand, and the pull rule read row by row on random streams."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fightlake.operators import clock, forensics, maintenance, pulls, rules, stats, timeline

FIELDS = "log_path string, line_number long, t_ms long, source string, source_is_player boolean, source_npc_id string, target string, target_is_player boolean, target_npc_id string, hp_current double, hp_max double, ability string, effect_type string, effect_name string, amount double, is_critical boolean, overheal double, shield_absorbed double, avoidance string, threat_delta double, is_damage boolean, is_heal boolean, is_death boolean, is_combat_start boolean, is_combat_end boolean, is_area_entered boolean, is_ability_activate boolean, is_threat_modified boolean, is_interrupted boolean, is_hard_cc boolean, is_raid_buff_cast boolean"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def event(line, t, kind="activate", **more):
    flag = {"damage": "is_damage", "heal": "is_heal", "death": "is_death", "start": "is_combat_start", "end": "is_combat_end", "activate": "is_ability_activate", "area": "is_area_entered", "none": ""}[kind]
    row = dict.fromkeys(NAMES) | {"log_path": "log", "line_number": line, "t_ms": t, "source": "P", "source_is_player": True, "target": "B", "target_is_player": False, "ability": "a", "effect_type": "ApplyEffect" if kind in ("damage", "heal") else "Event", "effect_name": kind, "amount": 0.0, "is_critical": False, "overheal": 0.0, "shield_absorbed": 0.0, "threat_delta": 0.0}
    row |= {n: n == flag for n in NAMES if n.startswith("is_") and n != "is_critical"} | more
    return tuple(row[n] for n in NAMES)


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame(rows, FIELDS)


def by_hand(rows, timing):
    """The pull index of each (t, start, end, known) row, one after the other."""
    out, index, known, left, before, entered = [], 0, 0, None, None, None
    for t, start, end, touch in rows:
        cut = known and ((start and entered is not None and t - entered >= timing.enter) or (t - left > timing.trailing if left is not None else before is not None and t - before > timing.gap))
        if cut:
            index, known, left = index + 1, 0, None
        known += touch
        left = t if end and left is None else left
        entered = t if start else entered
        before = t
        out.append(index)
    return out


def test_pulls_are_those_of_a_row_by_row_reading(table):
    rng = random.Random(7)
    timing = pulls.Timing()
    rows, want = [], {}
    for log in range(60):
        t, seen = 0, []
        for line in range(60):
            t += rng.choice([0, 200, 1500, 3000, 4000, 4001, 5000, 8000, 8001, 9000, 31000])
            kind = rng.choice(["start", "end", "end", "none", "damage", "activate"] if log % 2 else ["none", "none", "none", "damage", "end", "none"])
            quiet = kind in ("none", "end", "start")
            who = {"source": None, "source_is_player": False} if quiet and rng.random() < 0.9 else {}
            rows.append(event(line, t, kind, log_path=f"log{log:02}", **who))
            seen.append((t, kind == "start", kind == "end", int(not who)))
        want[f"log{log:02}"] = by_hand(seen, timing)
    for block in (pulls.BLOCK, 7):
        got = {}
        for r in pulls.with_pulls(table(rows), timing, block).orderBy("log_path", "line_number").collect():
            got.setdefault(r.log_path, []).append(r.pull_index)
        assert got == want


def in_blocks(seen, timing, size):
    """The pull index of each (t, start, end, known) row, by blocks that are worked out apart and then put together."""
    marks, last, entered = [], None, None
    none = dict.fromkeys(("t_ms", "is_combat_start", "is_combat_end", "touch", "enter_ms", "areas", "area_line", "difficulty", "group_size"))
    for at in range(0, len(seen), size):
        marks.append(none | {"log_path": "log", "block": at // size, "line_number": None, "t_ms": last, "enter_ms": entered})
        for i, (t, start, end, touch) in enumerate(seen[at : at + size], at):
            marks.append(none | {"log_path": "log", "block": at // size, "line_number": i, "t_ms": t, "is_combat_start": start, "is_combat_end": end, "touch": bool(touch)})
            last, entered = t, t if start else entered
    kinds = [("log_path", "string"), *((n, "int64") for n in ("block", "line_number", "t_ms", "enter_ms", "area_line", "group_size")), *((n, "bool") for n in ("is_combat_start", "is_combat_end", "touch")), ("difficulty", "string"), ("areas", pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_pylist(marks, pa.schema(kinds))
    cut = len(marks) // 3
    found = pulls._composed(timing, pulls._block_entries(timing, iter([batch.slice(0, cut), batch.slice(cut)])))
    starts = [x for b in found for row in b.column("starts").to_pylist() for x in row]
    return [sum(x <= i for x in starts) for i in range(len(seen))]


def test_blocks_put_together_are_a_row_by_row_reading():
    timing, rng = pulls.Timing(), random.Random(17)
    for _ in range(5000):
        p, t, seen = rng.random(), 0, []
        for _ in range(rng.randint(1, 24)):
            t += rng.choice([0, 200, 1500, 3000, 4000, 4001, 8000, 8001, 31000])
            kind = rng.choice(["start", "end", "none", "none"])
            seen.append((t, kind == "start", kind == "end", int(rng.random() < p)))
        want = by_hand(seen, timing)
        for size in (1, 4, 9):
            assert in_blocks(seen, timing, size) == want, (seen, size)


def test_areas_and_difficulties_hold_on_over_blocks_and_pulls(spark, table):
    rows = [event(1, 0, "area"), event(2, 100, "damage"), event(3, 200, "area"), event(4, 300, "damage"), event(5, 90_000, "damage"), event(9, 90_100, "area"), event(10, 90_200, "damage")]
    named = {1: ("story", 8), 3: (None, 4), 9: ("master", 16)}
    scopes = spark.createDataFrame([(i, *v) for i, v in named.items()], "line_number long, difficulty string, group_size int")
    got = pulls.with_pulls(table(rows).join(scopes, "line_number", "left"), block=3).orderBy("line_number").collect()
    assert [(r.pull_index, r.area_line, r.scope_difficulty, r.scope_group_size) for r in got] == [(0, 1, "story", 8), (0, 1, "story", 8), (0, 3, "story", 8), (0, 3, "story", 8), (1, 3, "story", 8), (1, 9, "master", 16), (1, 9, "master", 16)]
    assert pulls.with_pulls(table(rows[:0])).count() == 0


def test_clock(spark):
    def run(*texts):
        rows = spark.createDataFrame([("l", i, x) for i, x in enumerate(texts)], "log_path string, line_number long, timestamp string")
        return [r.t_ms for r in clock.with_clock(rows.withColumn("raw_ms", clock.day_ms(F.col("timestamp")))).orderBy("line_number").collect()]

    night = run("23:59:57.100", "23:59:59.900", "00:00:01.000", "00:00:01.600")
    assert night == sorted(night) and night[-1] - night[0] == 4500
    back = run("15:40:11.500", "14:40:12.250", "14:40:13.000")
    assert back[1] == back[0] and back[2] > back[1]
    assert run("no time") == [0]
    rng = random.Random(2)
    times = [f"{rng.randrange(24):02d}:{rng.randrange(60):02d}:00" for _ in range(300)]
    rows = spark.createDataFrame([(f"l{i % 3}", i, x) for i, x in enumerate(times)], "log_path string, line_number long, timestamp string").withColumn("raw_ms", clock.day_ms(F.col("timestamp")))
    whole = {r.line_number: r.t_ms for r in clock.with_clock(rows).collect()}
    assert whole == {r.line_number: r.t_ms for r in clock.with_clock(rows, chunk=7).collect()} and len(whole) == 300
    names = spark.createDataFrame([("combat_2021-11-09_06_30_15_42",), ("other",)], "log_path string")
    a, b = clock.with_session_date(names).collect()
    assert (str(a.session_date), a.session_time, b.session_date) == ("2021-11-09", "06:30:15", None)


def test_stats_of_a_pull(table):
    rows = [event(1, 0, "start"), event(2, 1000, "damage", amount=300.0, is_critical=True), event(3, 2000, "damage", amount=0.0, avoidance="dodge"), event(4, 3000, "damage", amount=50.0, ability=None)]
    rows += [event(5, 4000, "heal", amount=100.0, overheal=120.0, target="P", target_is_player=True), event(6, 5000, "death", source="B", source_is_player=False, target="P", target_is_player=True), event(7, 10000, "end"), event(8, 12000, "damage", amount=200.0)]
    split = pulls.with_pulls(table(rows))
    (pull,) = pulls.pulls_of(split).collect()
    assert (pull.start_line, pull.end_line, pull.duration, pull.is_fight) == (1, 8, 10.0, True)
    got = {r["name"]: r for r in stats.with_rates(stats.entity_stats(split), pulls.pulls_of(split)).collect()}
    p = got["P"]
    assert (p.damage_done, p.damage_attempts, p.damage_avoided, p.damage_crits, p.deaths, p.healing_done, p.healing_overheal) == (500.0, 3, 1, 1, 1, 100.0, 120.0)
    assert (p.dps, p.ehps, p.crit_pct, p.accuracy_pct) == (50.0, 0.0, 50.0, 100 * 2 / 3)
    assert got["B"].damage_taken == 500.0 and not got["B"].is_player
    (b,) = stats.burst(split, "damage", 10).collect()
    assert b.burst == 30.0  # seconds 1 and 12 are over 10 apart


def test_rotation_and_idle_gaps(table):
    rows = [event(1, 0, "activate", ability="Key"), event(2, 1000, "damage", amount=1500.0), event(3, 2000, "damage", amount=1800.0, is_critical=True), event(4, 3000, "activate"), event(5, 8000, "activate"), event(6, 10000, "activate", ability="Key"), event(7, 12000, "damage", amount=1000.0), event(8, 15000, "activate", ability="Key")]
    one = table(rows).withColumn("pull_index", F.lit(0).cast("long"))
    a, b = sorted(timeline.rotation(one, "key").collect(), key=lambda r: r.segment)
    assert (a.dps, b.dps, a.crit_pct, a.casts) == (330.0, 200.0, 50.0, "Key,a,a")
    gaps = [(r.segment, r.at_ms, r.gap_ms) for r in timeline.idle_gaps(one, "key").orderBy("at_ms").collect()]
    assert gaps == [(1, 2999, 3000), (1, 7999, 5000)]


def test_death_window_report(table):
    rows = [event(1, 1000, "damage", source="B", source_is_player=False, target="P", target_is_player=True, amount=10.0), event(2, 14000, "damage", source="B", source_is_player=False, target="P", target_is_player=True, amount=30.0)]
    rows += [event(3, 15000, "damage", source=None, source_is_player=None, target="P", target_is_player=True, amount=5.0, ability=None, effect_name="Fall"), event(4, 20000, "death", source="B", source_is_player=False, target="P", target_is_player=True), event(5, 20000, "damage", source="B", source_is_player=False, target="P", target_is_player=True, amount=99.0)]
    windows = forensics.death_windows(table(rows).withColumn("pull_index", F.lit(0).cast("long")))
    assert sorted(r.line_number for r in windows.collect()) == [2, 3]
    (blow,) = forensics.killing_blows(windows).collect()
    assert (blow.ability, blow.killer, blow.amount, blow.total) == ("Fall", "Environment", 5.0, 35.0)


def test_taunts(table):
    cast = lambda line, t: event(line, t, "activate", ability="Taunt", target="P", target_is_player=True)
    effect = lambda line, t, target: event(line, t, "none", effect_type="ApplyEffect", effect_name="Taunt", target=target)
    rows = [cast(1, 0), effect(2, 300, "B"), cast(3, 5000), cast(4, 9000), effect(5, 20000, "X"), effect(6, 20100, "Y"), effect(7, 20340, "X"), effect(8, 21000, "Z")]
    got = rules.taunts(table(rows).withColumn("pull_index", F.lit(0).cast("long")), "P").collect()
    assert sorted((r.at_ms, r.kind, r.hit, r.targets) for r in got) == [(300, "single", True, "B"), (5000, "single", False, ""), (9000, "single", False, ""), (20340, "aoe", True, "X,Y"), (21000, "aoe", True, "Z")]


def test_effects_and_phases(spark):
    key = ("log", 0, "T", "E")
    rows = [(*key, i, t, what, 1000) for i, (t, what) in enumerate([(0, "apply"), (500, "apply"), (900, "tick"), (1600, "tick"), (1700, "end"), (3000, "tick")])]
    frame = spark.createDataFrame(rows, "log_path string, pull_index long, target string, effect string, line_number long, t_ms long, what string, duration_ms long")
    assert sorted((r.start_ms, r.end_ms, r.refreshes) for r in rules.effect_intervals(frame).collect()) == [(0, 1500, 1), (1600, 1700, 0), (3000, 4000, 0)]
    assert [r.start_ms for r in rules.expiring(rules.effect_intervals(frame), 1650).collect()] == [1600]
    shown = spark.range(1).select(rules.charges_left(F.lit(7), F.lit(3), F.lit(178000.0), F.lit(180000.0)).alias("x")).first().x
    assert round(shown / 1000, 2) == 75.14
    steps = spark.createDataFrame([("log", 0, 1, 10, 0, "p1", None), ("log", 0, 2, 20, 0, "p3", "p2"), ("log", 0, 3, 30, 0, "p2", "p1"), ("log", 0, 4, 40, 0, "p3", "p2")], "log_path string, pull_index long, line_number long, t_ms long, ord int, phase string, after string")
    assert [r.phase for r in rules.phase_changes(steps).orderBy("line_number").collect()] == ["p1", "p2", "p3"]


def test_kill_names_markers_lint_and_export(spark):
    bosses = spark.createDataFrame([("a", "Warden Oru of the Mill", ["Mill Rat", "Oru"]), ("b", "Two", ["X", "Y"])], "boss_id string, boss_name string, names array<string>")
    assert sorted((r.boss_id, r["name"]) for r in maintenance.kill_names(bosses).collect()) == [("a", "Oru"), ("b", "X"), ("b", "Y")]
    lines = spark.createDataFrame([("l", i, t, f"line {i}") for i, t in [(1, 0), (2, 5000), (3, 6000), (4, 7000), (5, 9000), (6, 8000), (7, 9500)]], "log_path string, line_number long, t_ms long, line string")
    got = maintenance.export_range(lines, {"log_path": "l", "start_line": 3, "end_line": 4, "area_line": 1})
    assert sorted(r.line_number for r in got.collect()) == [1, 3, 4, 5]


def test_anonymous_names_keep_pets_and_places(spark):
    rows = ["[x] [@Ilse Vane#55|(1,2)] [AreaEntered {8}: Old Quarry {1}]", "[x] [@Bo/Ro @2#7/Imp {1}:2] [@Ilse Vane#55]", "no names, no@numbers", "@A#1x@B#2|@A#1"]
    lines = spark.createDataFrame([("l", i, x) for i, x in enumerate(rows)], "log_path string, line_number long, line string")
    assert [r.line for r in maintenance.anonymised(lines).orderBy("line_number").collect()] == [
        "[x] [@Player1#00000001|(1,2)] [AreaEntered {8}: Old Quarry {1}]",
        "[x] [@Player2#00000002/Imp {1}:2] [@Player1#00000001]",
        "no names, no@numbers",
        "@Player3#00000003x@Player4#00000004|@Player3#00000003",
    ]


def test_rebuild_recomputes_from_its_own_lines(table):
    from fightlake.operators import maintenance as M

    rows = [event(1, 0, "start"), event(2, 1000, "damage", amount=40.0), event(3, 4000, "damage", amount=2.5), event(4, 5000, "end"), event(10, 9000, "heal", amount=9.0), event(11, 9500, "heal", amount=1.0)]
    spark = table(rows).sparkSession
    schema = "stored_id string, log_path string, start_line long, end_line long, data_version int, duration double, unverified boolean, damage_old int"
    stored = [("a", "log", 1, 4, 1, 99.0, False, 1), ("b", "log", 10, 11, 1, 99.0, None, 2), ("c", "log", 500, 900, 1, 99.0, False, 3), ("d", "log", 1, 4, 2, 7.0, False, 4), ("e", "gone", 1, 4, 1, 99.0, False, 5), ("f", "log", 1, 4, 1, 99.0, True, 6)]
    out = M.rebuilt(spark.createDataFrame(stored, schema), table(rows), 2)
    got = {r.stored_id: (r.status, r.duration, r.damage, r.data_version, r.unverified) for r in out.collect()}
    assert got == {
        "a": ("rebuilt", 5.0, 42.5, 2, False), "b": ("dropped", 99.0, None, 1, False), "c": ("unverified", 99.0, None, 1, True),
        "d": ("current", 7.0, None, 2, False), "e": ("unverified", 99.0, None, 1, True), "f": ("unverified", 99.0, None, 1, True),
    }
    assert {r.status: r["count"] for r in M.rebuild_report(out).collect()} == {"rebuilt": 1, "dropped": 1, "unverified": 3, "current": 1}


def test_joins_by_buckets_of_lines(spark):
    rng = random.Random(5)
    maintenance_bucket = maintenance.BUCKET
    ranges = lambda n: [(f"s{i}", f"l{rng.randrange(2)}", a := rng.randrange(30000), a + rng.choice([0, 5, 5000, 20000])) for i in range(n)]
    stored, derived = ranges(40), ranges(30)
    events = spark.range(0, 50000, 97).selectExpr("'l' || (id % 2) log_path", "id line_number")
    pointers = spark.createDataFrame(stored, "stored_id string, log_path string, start_line long, end_line long")
    got = sorted((r.stored_id, r.line_number) for r in maintenance.at_pointers(events, pointers).collect())
    assert got == sorted((s, n) for s, log, a, b in stored for n in range(0, 50000, 97) if log == f"l{n % 2}" and a <= n <= b) and maintenance_bucket < 5000
    found = spark.createDataFrame([(log, i, a, b, i * 10) for i, (_, log, a, b) in enumerate(derived)], "log_path string, pull_index long, start_line long, end_line long, start_ms long")
    first = {r.stored_id: r.derived_index for r in maintenance.overlapping(pointers, found).collect()}
    for s, log, a, b in stored:
        hits = sorted((x, i) for i, (_, other, x, y) in enumerate(derived) if other == log and a <= y and b >= x)
        assert first.get(s) in ([i for x, i in hits if x == hits[0][0]] if hits else [None])


def test_keyword_rules_with_gates_and_countdowns(table):
    from fightlake.operators import effects

    spark = table([event(1, 0)]).sparkSession
    hit = lambda line, t, name, **more: event(line, t, "none", **{"effect_type": "ApplyEffect", "effect_name": name, "ability": None, **more})
    rows = [hit(1, 0, "Scorch"), hit(2, 5000, "Scorch"), hit(3, 6000, "Scorch", target="C"), event(4, 9000, "death", target="C"), hit(5, 10000, "Scorch", source="Q"), hit(6, 11000, "Deflection", effect_type="RemoveEffect"), hit(7, 12000, "Adrenaline Rush", effect_type="RemoveEffect"), event(8, 13000, "activate", ability="Scorch"), hit(9, 14000, "Lucky Break", source="Q"), hit(10, 15000, "Lucky Break", source="Q"), hit(11, 16000, "Scorch", effect_type="ModifyCharges")]
    events = table(rows).withColumns({"pull_index": F.lit(0).cast("long"), "local_player": F.lit("P")})
    table_ = effects.timer_rules(spark)
    hits = rules.keyword_hits(events, table_)
    assert sorted((r.line_number, r.label) for r in hits.collect()) == [(1, "Scorch"), (2, "Scorch"), (3, "Scorch"), (7, "Adrenaline Rush (cooldown)"), (9, "Combat Rez (cooldown)"), (10, "Combat Rez (cooldown)")]
    spans = rules.timer_intervals(hits, events)
    assert sorted((r.line_number, r.start_ms, r.end_ms) for r in spans.collect()) == [(1, 0, 5000), (2, 5000, 35000), (3, 6000, 9000), (7, 12000, 192000), (9, 14000, 15000), (10, 15000, 315000)]
    stacked = rules.timer_intervals(hits.withColumn("category", F.lit("boss")), events)
    assert sorted((r.line_number, r.end_ms) for r in stacked.where("line_number < 4").collect()) == [(1, 30000), (2, 35000), (3, 36000)]
    gated = spark.createDataFrame([(1, "scorch", None, "P", "C", None, None), (2, "scorch", None, None, None, "b1", ["p2"])], "rule_id int, keyword string, when_applied boolean, only_source string, only_target string, required_boss string, required_phases array<string>")
    found = rules.keyword_hits(events.withColumns({"boss_id": F.lit("b1"), "phase_id": F.when(F.col("line_number") < 3, "p2").otherwise("p1")}), gated)
    assert sorted((r.rule_id, r.line_number) for r in found.collect()) == [(1, 3), (2, 1), (2, 2)]


def test_tracked_effects_and_charges(table):
    from fightlake.operators import effects

    spark = table([event(1, 0)]).sparkSession
    names = ["is_effect_removed", "is_charges_modified", "charges"]
    rows, more = [], []

    def add(t, name, ability=None, removed=False, charges=None, kind="none", **columns):
        rows.append(event(len(rows) + 1, t, kind, **{"effect_type": "ModifyCharges" if charges is not None else "ApplyEffect", "effect_name": name, "ability": ability, "target": "T", **columns}))
        more.append((len(rows), removed, charges is not None, charges))

    add(0, "Kolto Shell", "Kolto Shell")
    for left in (6, 5, 4, 3):
        add(2000, "Kolto Shell", "Kolto Shell", charges=left)
    add(3000, "Heal", "Kolto Pods")
    add(4000, "Heal", "Kolto Pods")
    add(6000, "Heal", "Kolto Pods")
    add(7000, "Kolto Probe", "Kolto Probe")
    add(8000, "Kolto Probe", "Kolto Probe", source="Q")
    add(9000, "Heal", "Kolto Probe")
    add(12000, "Kolto Probe", "Kolto Probe")
    add(13000, "Kolto Probe", "Kolto Probe", kind="activate")
    add(14000, "Death", None, kind="death")
    add(15000, "Rejuvenate", None)
    add(16000, "Rejuvenate", None, removed=True)
    flags = spark.createDataFrame(more, "line_number long, is_effect_removed boolean, is_charges_modified boolean, charges int")
    events = table(rows).join(flags, "line_number").withColumn("pull_index", F.lit(0).cast("long"))
    got = effects.tracked_effects(effects.effect_rows(events, effects.effect_rules(spark, "hot"), 20.0)).collect()
    assert sorted((r.source, r.effect, r.start_ms, r.end_ms, r.until_ms, r.refreshes, r.charges_lost) for r in got) == [
        ("P", "Kolto Pods", 3000, 5500, 5500, 0, 0), ("P", "Kolto Pods", 6000, 8500, 8500, 0, 0), ("P", "Kolto Probe", 7000, 14000, 29500, 1, 0),
        ("P", "Kolto Shell", 0, 14000, 180000, 0, 4), ("P", "Rejuvenate", 15000, 16000, 27500, 0, 0), ("Q", "Kolto Probe", 8000, 14000, 25500, 0, 0),
    ]
    shown = spark.range(1).select(rules.charges_left(F.lit(7), F.lit(3), F.lit(178000.0), F.lit(180000.0)).alias("x")).first().x
    assert abs(shown - (178000 - 4 * 180000 / 7)) < 1e-6 and len(effects.effect_list()) == 46


def test_chains_of_any_length(spark):
    starts = spark.createDataFrame([("l", 0, "t0", 5)], "log_path string, pull_index long, timer_id string, at_ms long")
    links = lambda pairs: spark.createDataFrame([(a, b, 10) for a, b in pairs], "timer_id string, next_id string, delay_ms int")
    got = rules.chained(starts, links([(f"t{i}", f"t{i + 1}") for i in range(9)])).collect()
    assert sorted((r.at_ms, r.timer_id) for r in got) == [(5 + 10 * i, f"t{i}") for i in range(10)]
    with pytest.raises(ValueError):
        rules.chained(starts, links([("t0", "t1"), ("t1", "t2"), ("t2", "t1")]))


def test_what_a_block_hands_on_grows_with_its_rows_alone():
    def handed(n):
        rows = [("log", 0, None, None, None, None, None)] + [("log", 0, i, i * 2 if i < n // 2 else i * 9000, False, i == 0, True) for i in range(n)]
        names = ("log_path", "block", "line_number", "t_ms", "is_combat_start", "is_combat_end", "touch")
        none = dict.fromkeys(("enter_ms", "areas", "area_line", "difficulty", "group_size"))
        kinds = [("log_path", pa.string()), *((c, pa.int64()) for c in names[1:4]), *((c, pa.bool_()) for c in names[4:]), *((c, pa.int64()) for c in none)]
        batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) | none for r in rows], pa.schema(kinds))
        (block,) = pulls._block_entries(pulls.Timing(), iter([batch]))
        return block

    assert handed(2000).nbytes < 6 * handed(500).nbytes


def test_blocks_of_a_batch_are_put_together_a_few_at_a_time():
    seen = [(i * 9000, False, False, 1) for i in range(1000)]
    assert in_blocks(seen, pulls.Timing(), 1) == list(range(1000))
    kinds = pa.list_(pa.struct([("known_before", pa.bool_()), ("until_ms", pa.int64()), ("known", pa.bool_()), ("left_ms", pa.int64()), ("kept", pa.bool_()), ("start", pa.int32())]))
    entry = [{"known_before": k, "until_ms": u, "known": True, "left_ms": None, "kept": False, "start": 0} for k in (False, True) for u in (-1, None)]
    n = 1000
    none = [pa.nulls(n, k) for k in (pa.list_(pa.int64()), pa.int64(), pa.string(), pa.int64())]
    columns = [pa.array(["log"] * n), pa.array(range(n)), pa.array([entry] * n, kinds), pa.array([[i] for i in range(n)]), pa.array([[-1]] * n, pa.list_(pa.int32())), *none]
    batch = pa.RecordBatch.from_arrays(columns, names=["log_path", "block", "entries", "lines", "following", "areas", "area_line", "difficulty", "group_size"])
    found = list(pulls._composed(pulls.Timing(), iter([batch])))
    assert max(b.num_rows for b in found) <= pulls.HANDED and [x for b in found for x in b.column("pull_index").to_pylist()] == list(range(n))
