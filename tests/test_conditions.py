"""Boss definitions on small pulls, with values by hand."""

import json

import pytest
from pyspark.sql import functions as F

from fightlake.operators import conditions as C
from fightlake.sources import logs as L
from tests.test_operators import FIELDS, event

MORE = ["ability_id", "is_effect_removed", "scope_difficulty", "scope_group_size"]


@pytest.fixture(scope="module")
def script(spark):
    def run(definition, rows, me=None, seen_line=1, **scope):
        """rows: (t_ms, kind, columns)."""
        data = []
        for i, (t, kind, more) in enumerate(rows, 1):
            own = {k: more.pop(k) for k in MORE if k in more}
            data.append((*event(i, t, kind, **more), 0, own.get("ability_id"), own.get("is_effect_removed", False), own.get("scope_difficulty", scope.get("difficulty")), own.get("scope_group_size", scope.get("group_size"))))
        events = spark.createDataFrame(data, f"{FIELDS}, pull_index long, ability_id string, is_effect_removed boolean, scope_difficulty string, scope_group_size int")
        matches = spark.createDataFrame([("log", 0, "b", seen_line)], "log_path string, pull_index long, boss_id string, seen_line long")
        player = spark.createDataFrame([("log", me)], "log_path string, local_player string") if me else None
        found = C.boss_script(events, matches, [{"id": "b", "boss_names": ["B"], **definition}], player).collect()
        return {what: sorted(((r.id, r.start_ms, r.end_ms, r.ended) if what == "timer" else (r.start_ms, r.id) if what == "phase" else (r.start_ms, r.id, r.value)) for r in found if r.what == what) for what in ("phase", "counter", "timer")}

    return run


def hp(t, percent, **more):
    return t, "none", {"hp_current": percent * 10.0, "hp_max": 1000.0, **more}


def cast(t, ability, source="B", **more):
    return t, "activate", {"ability": ability, "source": source, "source_is_player": False, **more}


PHASES = [{"id": "p1", "name": "One"}]
below = lambda percent, **more: {"type": "hp_below", "percent": percent, **more}
casts = lambda keyword, **more: {"type": "ability_cast", "keyword": keyword, **more}
timer = lambda id_, trigger, seconds=2, **more: {"id": id_, "label": id_.upper(), "duration_seconds": seconds, "trigger": trigger, **more}


def test_thresholds_fire_once_for_each_place_and_wait_for_their_gate(script):
    gate = {"type": "counter_compare", "counter_id": "c", "operator": "gte", "value": 1}
    found = script({"phases": PHASES, "counters": [{"id": "c", "increment_on": casts("roar")}], "timers": [timer("a", below(75)), timer("b", below(75)), timer("c", below(50), conditions=[gate])]},
                   [hp(0, 100), hp(1000, 70), hp(2000, 60), hp(3000, 40), cast(3500, "Roar"), hp(4000, 35), hp(5000, 30), hp(9000, 20)])
    assert found["timer"] == [("a", 1000, 3000, "expired"), ("b", 1000, 3000, "expired"), ("c", 4000, 6000, "expired")]
    assert found["counter"] == [(3500, "c", 1.0)] and found["phase"] == [(0, "p1")]


def test_phases_cycle_and_end(script):
    phases = [{"id": "p1"}, {"id": "p2", "start_trigger": casts("leap")}, {"id": "p3", "start_trigger": {"type": "phase_ended", "phase_id": "p2"}}, {"id": "px", "start_trigger": casts("leap"), "difficulties": ["hard"]}]
    phases[1]["end_trigger"] = {"type": "any_of", "conditions": [casts("land"), {"type": "combat_end"}]}
    phases[0]["start_trigger"] = {"type": "all_of", "conditions": [casts("reset"), {"type": "phase_active", "phase_ids": ["p3"]}]}
    rows = [hp(0, 100), cast(1000, "Reset"), cast(2000, "Leap"), cast(2500, "Leap"), cast(3000, "Land"), cast(3500, "Land"), cast(4000, "Reset"), cast(5000, "LEAPING")]
    assert script({"phases": phases}, rows, difficulty="easy")["phase"] == [(0, "p1"), (2000, "p2"), (3000, "p3"), (4000, "p1"), (5000, "p2")]
    phases.insert(0, phases.pop())  # first in order, and an unknown difficulty passes
    assert script({"phases": [*phases[1:2], *phases[:1], *phases[2:]]}, rows[:3])["phase"] == [(0, "p1"), (2000, "px")]


def test_timers_chain_repeat_and_are_cancelled(script):
    timers = [timer("t1", casts("go"), 3), timer("t2", {"type": "timer_expires", "timer_id": "t1"}, 2), timer("t3", {"type": "timer_expires", "timer_id": "t2"}, 1), timer("t4", {"type": "timer_started", "timer_id": "t1"}, 10, cancel_trigger=casts("stop"))]
    timers += [timer("t5", casts("go"), 2, repeat_interval_seconds=3, repeat_count=2), timer("t6", {"type": "timer_expires", "timer_id": "t4"}, 1), timer("t7", {"type": "timer_expires", "timer_id": "t5"}, 1)]
    found = script({"phases": PHASES, "timers": timers}, [hp(0, 100), cast(1000, "Go"), cast(6500, "Stop"), hp(20000, 90)])
    assert found["timer"] == [("t1", 1000, 4000, "expired"), ("t2", 4000, 6000, "expired"), ("t3", 6000, 7000, "expired"), ("t4", 1000, 6500, "cancelled"), ("t5", 1000, 9000, "expired"), ("t7", 9000, 10000, "expired")]
    loop = [timer("a", casts("go"), 4), timer("b", {"type": "timer_expires", "timer_id": "a"}, 4)]
    loop[0]["trigger"] = {"type": "any_of", "conditions": [casts("go"), {"type": "timer_expires", "timer_id": "b"}]}
    found = script({"phases": PHASES, "timers": loop}, [hp(0, 100), cast(1000, "Go"), hp(14000, 90)])
    assert found["timer"] == [("a", 1000, 5000, "expired"), ("a", 9000, 13000, "expired"), ("b", 5000, 9000, "expired"), ("b", 13000, 14000, "pull ended")]
    with pytest.raises(Exception, match="without end"):
        script({"phases": PHASES, "timers": [timer("a", {"type": "any_of", "conditions": [casts("go"), {"type": "timer_started", "timer_id": "a"}]}, 0)]}, [hp(0, 100), cast(1000, "Go")])


def test_combat_start_is_backdated_and_targets_have_their_own_timers(script):
    timers = [timer("s", {"type": "combat_start"}, 5), timer("x", {"type": "effect_applied", "keyword": "slime"}, 4, announce_target=True)]
    slime = lambda t, who, **more: (t, "none", {"effect_type": "ApplyEffect", "effect_name": "Slime", "target": who, **more})
    rows = [(0, "start", {}), (500, "start", {}), hp(1500, 100), slime(2000, "P1"), slime(3000, "P2"), slime(4000, "P1"), slime(5000, "P1", is_effect_removed=True), hp(30000, 90)]
    found = script({"phases": PHASES, "timers": timers}, rows, seen_line=3)
    assert found["timer"] == [("s", 500, 5500, "expired"), ("x", 2000, 4000, "refreshed"), ("x", 3000, 7000, "expired"), ("x", 4000, 8000, "expired")] and found["phase"] == [(1500, "p1")]


def test_leaves(script):
    timers = [
        timer("id", {"type": "ability_cast", "ability_ids": ["77"]}), timer("who", casts("bite", selector=["Rat"])), timer("gone", {"type": "effect_removed", "keyword": "ward"}),
        timer("dead", {"type": "entity_death", "selector": ["Rat"]}), timer("new", {"type": "npc_appears", "selector": ["Rat", "Crow"]}), timer("me", {**casts("gaze"), "target": "local_player"}),
        timer("no", {"type": "not", "condition": {"type": "phase_active", "phase_ids": ["p1"]}}), timer("none", {"type": "all_of", "conditions": []}), timer("odd", {"type": "unheard of"}),
        timer("small", casts("gaze"), group_sizes=[8]), timer("left", casts("gaze"), conditions=[{"type": "timer_time_remaining", "timer_id": "id", "operator": "lte", "value": 1}]),
        timer("reach", {"type": "counter_reaches", "counter_id": "n", "value": 2}), timer("moved", {"type": "counter_changes", "counter_id": "n"}),
    ]
    rows = [hp(0, 100), cast(1000, None, ability_id="77"), cast(1100, "Bite", "Cat"), cast(1200, "Bite", "Rat"), (1300, "none", {"effect_type": "RemoveEffect", "effect_name": "Ward", "is_effect_removed": True})]
    rows += [(1400, "death", {"target": "Rat"}), cast(1500, "Gaze", target="Q"), cast(2500, "Gaze", target="P"), cast(2600, "Peck", "Crow"), cast(2700, "Peck", "Crow"), hp(9000, 50)]
    counters = [{"id": "n", "increment_on": casts("gaze"), "decrement_on": casts("zzz"), "reset_on": {"type": "entity_death", "selector": ["Nobody"]}, "initial_value": 0}]
    found = script({"phases": PHASES, "timers": timers, "counters": counters}, rows, me="P", group_size=16)["timer"]
    assert sorted((i, t) for i, t, *_ in found) == sorted([("id", 1000), ("who", 1200), ("gone", 1300), ("dead", 1400), ("new", 1200), ("new", 2600), ("me", 2500), ("left", 2500), ("reach", 2500), ("moved", 1500), ("moved", 2500)])


def test_definitions_are_read_with_nested_conditions(spark, tmp_path):
    deep = {"type": "not", "condition": {"type": "any_of", "conditions": [casts("a"), {"type": "all_of", "conditions": [below(5), {"type": "entity_death", "selector": ["X"]}]}]}}
    boss = {"id": "x", "name": "X", "boss_names": ["X"], "phases": [{"id": "p1", "name": "One"}, {"id": "p2", "name": "Two", "start_trigger": deep, "conditions": [casts("b"), below(9)]}], "timers": [timer("t", deep, cancel_trigger=casts("c"))], "counters": [{"id": "c", "reset_on": deep}]}
    (tmp_path / "x.json").write_text(json.dumps(boss))
    table = L.read_definitions(spark, str(tmp_path))
    (found,) = C.definitions_of(table)
    assert found["phases"][1]["start_trigger"] == deep and found["phases"][1]["conditions"] == [casts("b"), below(9)] and found["timers"][0]["cancel_trigger"] == casts("c") and found["counters"][0]["reset_on"] == deep
    assert L.timer_table(table).select("timer_id", "label", F.get_json_object("trigger", "$.type").alias("type")).first() == ("t", "T", "not")


def test_phase_times(spark):
    rows = [("log", 0, "b", "phase", p, None, None, i, t, None, None, None) for i, (p, t) in enumerate([("p1", 1000), ("p2", 3000), ("p1", 5000), ("p3", 5000)])]
    got = C.phase_times(spark.createDataFrame(rows, C.SCRIPT), spark.createDataFrame([("log", 0, 500)], "log_path string, pull_index long, start_ms long"))
    assert [(r.nth, r.phase, r.offset, r.entries) for r in got.orderBy("nth").collect()] == [(0, "p1", 0.5, 2), (1, "p2", 2.5, 1), (2, "p3", 4.5, 1)]


def test_scopes_are_those_as_of_a_row(script):
    timers = [timer("m", casts("go"), difficulties=["master"]), timer("c", {"type": "timer_expires", "timer_id": "m"}, difficulties=["master"]), timer("s", casts("go"), difficulties=["story"], group_sizes=[8])]
    at = lambda name, size=8: {"scope_difficulty": name, "scope_group_size": size}
    rows = [hp(0, 100, **at("story")), cast(1000, "Go", **at("story")), (2000, "area", at("master")), cast(3000, "Go", **at("master")), (4000, "area", at("story", 16)), cast(6000, "Go", **at("story", 16)), hp(9000, 90, **at(None))]
    assert script({"phases": PHASES, "timers": timers}, rows)["timer"] == [("m", 3000, 5000, "expired"), ("s", 1000, 3000, "expired")]


def test_a_name_appears_once_for_all_conditions(script):
    new = lambda *names: {"type": "npc_appears", "selector": list(names)}
    timers = [timer("a", new("Rat"), conditions=[casts("never")]), timer("b", new("Rat", "Crow")), timer("c", new("Rat")), timer("d", new("Crow"))]
    rows = [hp(0, 100), cast(1000, "Peck", "Rat"), cast(2000, "Peck", "Rat"), cast(3000, "Peck", "Crow"), cast(4000, "Peck", "Crow"), hp(9000, 50)]
    assert script({"phases": PHASES, "timers": timers}, rows)["timer"] == [("b", 1000, 3000, "expired"), ("b", 3000, 5000, "expired")]


def test_a_difficulty_entered_in_an_earlier_pull_holds_on(spark):
    from fightlake.operators import pulls

    kinds = [(0, "area", "story"), (1000, "damage", None), (2000, "end", None), (60_000, "damage", None), (61_000, "cast", None), (62_000, "area", "master"), (63_000, "cast", None), (64_000, "damage", None)]
    rows = [(*event(i, t, "activate" if kind == "cast" else kind, ability="Go" if kind == "cast" else "a", source="B" if kind == "cast" else "P"), None, False, d, None) for i, (t, kind, d) in enumerate(kinds, 1)]
    split = pulls.with_pulls(spark.createDataFrame(rows, f"{FIELDS}, ability_id string, is_effect_removed boolean, difficulty string, group_size int"), block=3)
    matches = spark.createDataFrame([("log", 1, "b", 4)], "log_path string, pull_index long, boss_id string, seen_line long")
    found = C.boss_script(split, matches, [{"id": "b", "boss_names": ["B"], "phases": PHASES, "timers": [timer("m", casts("go"), 60, difficulties=["master"]), timer("s", casts("go"), 60, difficulties=["story"])]}])
    assert sorted((r.id, r.start_ms) for r in found.where("what = 'timer'").collect()) == [("m", 63_000), ("s", 61_000)]


def test_leaves_by_batches_are_those_of_the_row_conditions(spark):
    import random

    rng = random.Random(4)
    pick = lambda *xs: rng.choice(xs)
    rows = []
    for i in range(400):
        rows.append((i, pick("B", "Rat", "P", None), pick("B", "Rat", "P", None), pick(None, 10.0, 500.0), pick(None, 0.0, 1000.0), pick(None, "Big Leap", "roar"), pick(None, "77", "78"), pick(None, "Ward", "slime"), *(pick(True, False, None) for _ in range(5)), pick("P", None)))
    table = spark.createDataFrame(rows, "i int, source string, target string, hp_current double, hp_max double, ability string, ability_id string, effect_name string, is_combat_start boolean, is_combat_end boolean, is_ability_activate boolean, is_effect_removed boolean, is_death boolean, local_player string")
    leaves = [{"type": t} for t in ("combat_start", "combat_end", "effect_applied", "effect_removed", "ability_cast", "npc_appears", "entity_death")]
    leaves += [below(50), below(50, selector=["Rat"]), casts("LEAP"), casts("leap", selector=["Rat"]), casts(None, ability_ids=[77]), {"type": "effect_applied", "keyword": "WAR", "selector": ["B"]}, {"type": "effect_removed", "keyword": "slime"}]
    leaves += [{"type": "npc_appears", "selector": ["Rat", "P"]}, {"type": "entity_death", "selector": ["Rat"]}, {**casts("roar", selector=["B", "Rat"]), "target": "local_player"}]
    for names in (["B"], []):
        met = table.select("i", *[C.row_condition(x, names, F.col("local_player")).alias(f"c{n}") for n, x in enumerate(leaves)]).orderBy("i").collect()
        want = [[n for n in range(len(leaves)) if r[f"c{n}"]] for r in met]
        got = C.LeafMatcher({"boss_names": names, "timers": [{"trigger": x} for x in leaves]})(table.orderBy("i").toPandas()[C._LOOKED_AT])
        assert got == want and sum(map(len, got)) > 500


def test_hundreds_of_definitions_are_planned_at_once(spark):
    import time

    definitions = []
    for n in range(300):
        timers = [timer(f"t{i}", casts(f"skill {n} {i}"), cancel_trigger={"type": "entity_death", "selector": [f"X{i}"]}) for i in range(10)]
        definitions.append({"id": f"b{n}", "boss_names": [f"B{n}"], "phases": PHASES, "timers": timers})
    rows = [(*event(i, 1000 * i, "activate", ability=f"Skill {n} {i % 10}", source=f"B{n}", log_path=f"log{n}"), 0, None, False) for n in range(0, 300, 30) for i in range(1, 6)]
    events = spark.createDataFrame(rows, f"{FIELDS}, pull_index long, ability_id string, is_effect_removed boolean")
    matches = spark.createDataFrame([(f"log{n}", 0, f"b{n}", 1) for n in range(0, 300, 30)], "log_path string, pull_index long, boss_id string, seen_line long")
    began = time.time()
    found = C.boss_script(events, matches, definitions)
    found.explain("simple")
    assert time.time() - began < 5
    assert found.where("what = 'timer'").count() == 50


def test_thousands_of_keyword_rules_in_one_pass(spark):
    import time

    from fightlake.operators import rules

    table = spark.createDataFrame([(i, f"L{i}", f"word{i} ", True, "Boss" if i % 2 else "") for i in range(2000)], "rule_id int, label string, keyword string, when_applied boolean, only_source string")
    rows = [(*event(i, 1000 * i, "none", effect_type="ApplyEffect", effect_name=f"some WORD{i} here", source="Boss" if i % 3 else "Other"), 0) for i in range(0, 2000, 7)]
    began = time.time()
    hits = rules.keyword_hits(spark.createDataFrame(rows, f"{FIELDS}, pull_index long"), table)
    hits.explain("simple")
    assert time.time() - began < 5
    assert sorted((r.line_number, r.rule_id) for r in hits.collect()) == [(i, i) for i in range(0, 2000, 7) if i % 2 == 0 or i % 3]
