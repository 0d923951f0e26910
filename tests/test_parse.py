"""One row for each line shape of the grammar."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fightlake.functions import parse as P

HEAD = "[09:15:30.250] [@Mira#41|(7,7,7,7)|(64/80)] [Golem {909}:6|(1,1,1,1)|(30/120)] "


@pytest.fixture(scope="module")
def read(spark):
    def run(*lines):
        rows = [("log", i + 1, line) for i, line in enumerate(lines)]
        return sorted(P.parse_events(spark.createDataFrame(rows, "log_path string, line_number long, line string")).collect(), key=lambda r: r.line_number)

    return run


def test_amounts(read):
    heal, plain, damage, shield, echoed, parry, threat, charges = read(
        HEAD + "[Salve {5}] [ApplyEffect {6}: Heal {7}] (812* ~95)",
        HEAD + "[Salve {5}] [ApplyEffect {6}: Heal {7}] (640*)",
        HEAD + "[Cleave {5}] [ApplyEffect {6}: Damage {8}] (77 cold {9})",
        HEAD + "[Cleave {5}] [ApplyEffect {6}: Damage {8}] (51 heat {9} -shield {10} (1234 absorbed {11}))",
        HEAD + "[Cleave {5}] [ApplyEffect {6}: Damage {8}] (33 cold {9}(echoed {12}))",
        HEAD + "[Cleave {5}] [ApplyEffect {6}: Damage {8}] (0 -parry {13})",
        HEAD + "[] [Event {14}: ModifyThreat {15}] <-18.5>",
        HEAD + "[Husk {5}] [ModifyCharges {16}: Husk {5}] (5 charges {17})",
    )
    assert (heal.is_heal, heal.amount, heal.overheal, heal.is_critical) == (True, 812.0, 95.0, True)
    assert (plain.overheal, plain.is_critical) == (0.0, True)
    assert (damage.is_damage, damage.amount, damage.overheal, damage.is_critical) == (True, 77.0, 0.0, False)
    assert (shield.amount, shield.shield_absorbed) == (51.0, 1234.0)
    assert (echoed.amount, echoed.shield_absorbed) == (33.0, 0.0)
    assert (parry.amount, parry.avoidance) == (0.0, "parry")
    assert (threat.threat_delta, threat.ability) == (-18.5, None)
    assert charges.is_charges_modified and charges["values"] == ["5 charges {17}"]


def test_entities(read):
    same, npc, pet, boss, env = read(
        "[09:15:30.000] [@Ilse Vane#5500123|(1,2,3,4)|(900/900)] [=] [Stance {21}] [Event {3}: AbilityActivate {4}]",
        "[09:15:30.000] [Clay Golem {77001}:88002|(1,2,3,4)|(5/9)] [=] [ {66003}] [Event {3}: AbilityActivate {4}]",
        "[09:15:30.000] [@Ilse#12/Imp {30}:2|(0,0,0,0)|(1/2)] [] [] []",
        HEAD + "[x] []",
        "[09:15:30.250] [@Mira#41|(7,7,7,7)|(64/80)] [] [] [ApplyEffect {6}: Damage {8}] (45)",
        "[09:15:30.250] [@Mira#41]",
    )
    assert (same.target, same.target_is_player, same.hp_max) == ("Ilse Vane", True, None)
    assert (npc.target, npc.target_is_player, npc.target_npc_id, npc.ability, npc.ability_id) == ("Clay Golem", False, "77001", None, "66003")
    assert (pet.source, pet.source_is_player, pet.source_npc_id, pet.target) == ("Imp", False, "30", None)
    assert (boss.target, boss.target_npc_id, boss.hp_current, boss.hp_max) == ("Golem", "909", 30.0, 120.0)
    assert env.is_damage and env.ability is None and env.amount == 45.0


def test_kinds(read):
    death, mark, area, cc, buff, left = read(
        HEAD + "[] [Event {1}: Death {2}]",
        HEAD + "[x] [ApplyEffect {1}: Deathly Chill {2}]",
        HEAD + "[] [AreaEntered {1}: Old Quarry {2} 16 Player Veteran {3}]",
        HEAD + "[x] [ApplyEffect {1}: Stunned (Frost) {2}]",
        HEAD + "[Rally {1}] [Event {1}: AbilityActivate {2}]",
        HEAD + "[] [Event {1}: ExitCombat {2}]",
    )
    assert death.is_death and not mark.is_death
    assert (area.is_area_entered, area.group_size, area.difficulty) == (True, 16, "veteran")
    assert cc.is_hard_cc and buff.is_raid_buff_cast and left.is_combat_end and not left.is_combat_start


def balanced(text):
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")" and depth > 0)
        if c == "(" and depth == 1:
            start = i
        if c == ")" and depth == 0 and "(" in text[:i]:
            return text[start + 1 : i]
    return None


def test_first_group_against_a_plain_reading(spark):
    rng = random.Random(3)
    texts = ["", "()", "(", ")", "a) (b", "x (y) (z)", "((((5))))", "(1 (2) (3 (4 (5 (6)))) 7) 8"] + ["".join(rng.choice("(()) 1a") for _ in range(rng.randint(0, 14))) for _ in range(500)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", P.first_group(F.col("t")).alias("g")).collect():
        at = r.t.find("(")
        assert r.g == (balanced(r.t[at:]) if at >= 0 else None), r.t


def test_lines_of_any_brackets_against_a_plain_reading(read):
    rng = random.Random(4)
    lines = ["".join(rng.choice(["[", "]", "[a]", "[b {1}: c {2}]", " ", "x", "(3)"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    got = {r.line_number: r for r in read(*lines)}
    for i, line in enumerate(lines, 1):
        found = list(re.finditer(r"\[([^\[\]]*)\]", line.strip(" ")))
        if len(found) < 3:
            assert i not in got
            continue
        parts = [m[1] for m in found]
        name = lambda x: re.sub(r"\{[^{}]*\}", "", x).strip(" ").lstrip("@").strip(" ") or None
        assert got[i].timestamp == parts[0] and got[i].ability == (name(parts[3]) if len(parts) > 3 else None)
        assert got[i]["values"] == re.findall(r"\(([^()]*)\)", line.strip(" ")[found[min(len(found), 5) - 1].end() :])


def test_long_lines(read):
    n = 1_000_000
    lines = [HEAD + "[x] [ApplyEffect {1}: Damage {2}] (" + tail for tail in ("7 " + "a" * n + ")", "8" + "(" * 5000 + ")" * 5000 + ")", "(" * n, "9 " + "(b) " * (n // 4) + ")", "6)" + "()" * n)]
    assert [r.amount for r in read(*lines, "[" * n, "]" * n, "[]" * (n // 2), "x" * n, None)] == [7.0, 8.0, 0.0, 9.0, 6.0, 0.0]


def test_scalars_and_records(spark):
    r = spark.range(1).select(P.alacrity_scaled(F.lit(40.0), F.lit(25.0)).alias("a"), P.alacrity_scaled(F.lit(40.0), F.lit(0.0)).alias("b"), P.hp_percent(F.lit(300.0), F.lit(200.0)).alias("c")).first()
    assert (r.a, r.b, r.c) == (32.0, 40.0, 100.0)
    rows = spark.createDataFrame([({"event": "Healing", "caster": "x", "value": "5"},), ({"type": "odd"},)], "raw map<string, string>")
    one, two = P.normalise_records(rows).collect()
    assert (one.kind, one.source, one.amount) == ("heal", "x", 5.0) and two.kind == "unknown"


def test_rounding_goes_by_the_binary_value(spark):
    rng = random.Random(8)
    values = [2.675, 1.005, 0.5, 1.5, 2.5, -2.5, -0.125, 0.375, 1e6 + 0.05, 0.0, 2.5e-3] + [rng.uniform(-1e4, 1e4) for _ in range(500)] + [rng.randrange(-(10**6), 10**6) / 2**rng.randrange(12) for _ in range(500)] + [rng.randrange(10**6) / 1000 for _ in range(500)]
    for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", P.half_even("v").alias("a"), P.half_even("v", 1).alias("b"), P.half_even("v", 2).alias("c")).collect():
        assert (r.a, r.b, r.c) == (round(r.v), round(r.v, 1), round(r.v, 2))
