"""Standing rules for damage and healing over time, cooldowns and buffs, and the effects a player keeps on others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import folded, keywords_in
from .stats import PULL

#: Effects that deal damage over time: (name, seconds, whether alacrity shortens it).
DOTS = [
    ("Affliction", 18, True),
    ("Bleeding", 15, True),
    ("Bleeding (Deadly Saber)", 6, True),
    ("Bleeding (Draining Scream)", 6, True),
    ("Bleeding (Eviscerate)", 6, True),
    ("Bleeding (Rupture)", 9, True),
    ("Bleeding (Shatter)", 12, True),
    ("Burning (Burning Blade)", 6, True),
    ("Burning (Burning Purpose)", 6, True),
    ("Burning (Incendiary Missile)", 15, True),
    ("Burning (Incendiary Round)", 15, True),
    ("Burning (Plasma Brand)", 12, True),
    ("Burning (Priming Shot)", 15, True),
    ("Burning Purpose", 6, True),
    ("Corrosive Dart", 18, True),
    ("Corrosive Grenade (Op)", 24, True),
    ("Corrosive Grenade (Sniper)", 24, True),
    ("Creeping Terror", 18, True),
    ("Discharge", 18, True),
    ("Force Breach", 18, True),
    ("Force Rend", 9, True),
    ("Hemorrhaging Blast", 10, False),
    ("Incendiary Grenade", 9, False),
    ("Interrogation Probe", 18, True),
    ("Marked (Physical)", 45, True),
    ("Plasma Probe", 9, False),
    ("Plasmatize", 30, True),
    ("Sanguinary Shot", 10, False),
    ("Scorch", 30, True),
    ("Sever Force", 18, True),
    ("Shock Charge", 18, True),
    ("Shrap Bomb (Gunslinger)", 24, True),
    ("Shrap Bomb (Ruffian)", 24, True),
    ("Toxic Blast", 10, False),
    ("Vital Shot", 24, True),
    ("Weaken Mind", 18, True),
    ("Weakening Blast", 10, False),
]
#: Effects that heal or shield over time: (name, seconds, whether alacrity shortens it, charges). Those with charges count on whom they are on.
HOTS = [
    ("Force Armor", 30, False, None),
    ("Kolto Probe", 21, True, None),
    ("Kolto Pods", 2.5, False, None),
    ("Kolto Shell", 180, False, 7),
    ("Rejuvenate", 15, True, None),
    ("Resurgence", 15, True, None),
    ("Slow-release Medpac", 21, True, None),
    ("Static Barrier", 30, False, None),
    ("Trauma Probe", 180, False, 7),
]
#: Buffs that hasten: (name, seconds).
HASTES = [
    ("Mental Alacrity", 15),
    ("Metaphysical Alacrity", 15),
    ("Alacrity Boost", 30),
]
#: Defensive cooldowns: (name, seconds of the cooldown, seconds of the buff, whether the cooldown begins as the buff ends).
DEFENSIVES = [
    ("Adrenaline Rush", 180, 60, True),
    ("Battle Readiness", 120, 15, False),
    ("Deflection", 120, 12, False),
    ("Energy Shield", 120, 12, False),
    ("Enraged Defense", 120, 15, False),
    ("Focused Defense", 120, 15, False),
    ("Force Shroud", 60, 3, False),
    ("Invincible", 180, 10, False),
    ("Kolto Overload", 180, 60, True),
    ("Overcharge Saber", 120, 15, False),
    ("Power Yield", 60, 10, False),
    ("Reactive Shield", 120, 12, False),
    ("Resilience", 60, 3, False),
    ("Saber Ward", 90, 12, False),
    ("Warding Call", 180, 10, False),
]
#: What shows on a player who was revived, and the seconds until the next revival.
REVIVED, REVIVE_SECONDS = ("Tenuous Force", "Lucky Break", "Communication Breakdown", "Technical Difficulties"), 300

EFFECT_RULES = "ord int, label string, kind string, duration_ms long, scaled boolean, on_target boolean, max_charges int"
TIMER_RULES = "rule_id int, label string, keyword string, when_applied boolean, duration_ms long, warn_ms long, category string, only_local_player boolean, only_target_is_local_player boolean, scaled boolean"


def effect_list() -> list[tuple]:
    """(ord, label, kind, duration_ms, scaled, on_target, max_charges) of all effects over time."""
    rows = [(label, "dot", seconds, scaled, None) for label, seconds, scaled in DOTS] + [(label, "hot", seconds, scaled, charges) for label, seconds, scaled, charges in HOTS]
    return [(i, label, kind, round(1000 * seconds), scaled, charges is not None, charges) for i, (label, kind, seconds, scaled, charges) in enumerate(rows)]


def effect_rules(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """The over-time effects as a rule table."""
    return spark.createDataFrame([r for r in effect_list() if kind in (None, r[2])], EFFECT_RULES)


def timer_rules(spark: SparkSession) -> DataFrame:
    """All standing rules as countdowns for :func:`fightlake.operators.rules.keyword_hits`."""
    rows = [(label, label, True, ms, kind, not on_target, on_target, scaled) for _, label, kind, ms, scaled, on_target, _ in effect_list()]
    for label, cooldown, buff, begins_as_buff_ends in DEFENSIVES:
        rows.append((f"{label} (cooldown)", label, not begins_as_buff_ends, 1000 * cooldown, "cooldown", True, False, False))
        rows.append((label, label, True, 1000 * buff, "cooldown", True, False, False))
    rows += [(label, label, True, 1000 * seconds, "cooldown", True, False, False) for label, seconds in HASTES]
    rows += [("Combat Rez (cooldown)", keyword, True, 1000 * REVIVE_SECONDS, "cooldown", False, False, False) for keyword in REVIVED]
    return spark.createDataFrame([(i, label, keyword, applied, ms, 0, *more) for i, (label, keyword, applied, ms, *more) in enumerate(rows)], TIMER_RULES)


def defensive_cooldowns(spark: SparkSession) -> DataFrame:
    """(label, keyword, cooldown_ms) for :func:`fightlake.operators.forensics.cooldown_uses`."""
    rows = [(label, label, 1000 * cooldown) for label, cooldown, *_ in DEFENSIVES]
    return spark.createDataFrame(rows, "label string, keyword string, cooldown_ms long")


TRACKED = "log_path string, pull_index long, target string, source string, effect string, start_ms long, end_ms long, until_ms long, refreshes long, charges_lost long"


class _Tracked:
    """The effects on one target, as each of its rows moves them."""

    def __init__(self, key: tuple):
        self.on: dict[tuple, list[int]] = {}  # of each source and effect: start, end, refreshes, charges lost

    def row(self, source, effect, line_number, t_ms, what, duration_ms, charges, max_charges) -> list[tuple]:
        if what == "death":
            gone = [self._gone(k, t_ms) for k in list(self.on)]
            return [x for k in gone for x in k]
        key = (source, effect)
        out = self._gone(key, t_ms, only_if_over=True)
        if what == "end":
            out += self._gone(key, t_ms)
        elif what == "charges":
            if key in self.on and charges is not None:
                self.on[key][3] = max(0, max_charges - charges)
        elif what == "apply" and key in self.on:
            self.on[key] = [self.on[key][0], t_ms + duration_ms, self.on[key][2] + 1, 0]
        elif key not in self.on:
            self.on[key] = [t_ms, t_ms + duration_ms, 0, 0]
        return out

    def _gone(self, key: tuple, t: int, only_if_over: bool = False) -> list[tuple]:
        now = self.on.get(key)
        if now is None or (only_if_over and t < now[1]):
            return []
        del self.on[key]
        return [(*key, now[0], min(t, now[1]), now[1], now[2], now[3])]

    def end(self) -> list[tuple]:
        return [x for k, now in list(self.on.items()) for x in self._gone(k, now[1])]


def effect_rows(events: DataFrame, rules: DataFrame, alacrity_pct: float = 0.0) -> DataFrame:
    """Rows that move an effect, by its own name (apply, end, charges) or, as a tick, by the ability's; a target's death ends all that is on it.

    ``events`` needs ``is_effect_removed``, ``is_charges_modified`` and, for charges, ``charges``. Names are matched once a text, by number; what the
    number stands for comes by a join with the rule table.
    """
    c = F.col
    table = rules.limit(10_001).collect()
    if len(table) > 10_000:
        raise ValueError("more than 10000 effects")
    table = sorted(table, key=lambda r: r.ord)
    labels = [r.label for r in table]
    known = events.where("target is not null and ((source is not null and not is_ability_activate) or is_death)")
    number = lambda text: F.try_element_at(keywords_in(c(text), labels), F.lit(1))  # the first rule whose label the text holds
    known = known.withColumn("by_name", number("effect_name")).withColumn("by_ability", number("ability")).withColumn("number", F.when(~c("is_death"), F.coalesce("by_name", "by_ability")))
    length = lambda r: round(r.duration_ms / (1 + alacrity_pct / 100)) if r.scaled and alacrity_pct > 0 else r.duration_ms
    facts = events.sparkSession.createDataFrame([(i, r.label, length(r), r.max_charges) for i, r in enumerate(table)], "number int, effect string, duration_ms long, max_charges int")
    charges = c("charges").cast("int") if "charges" in events.columns else F.lit(None).cast("int")
    what = F.when(c("is_death"), "death").when(c("is_effect_removed"), "end").when(c("max_charges").isNotNull() & c("is_charges_modified"), "charges").when(c("by_name").isNotNull(), "apply").otherwise("tick")
    live = known.where("is_death or number is not null").join(facts, "number", "left")
    return live.select(*PULL, "target", F.when(~c("is_death"), c("source")).alias("source"), "effect", "line_number", "t_ms", what.alias("what"), "duration_ms", charges.alias("charges"), "max_charges")


def tracked_effects(rows: DataFrame) -> DataFrame:
    """Stretches of each player's effects on each target, from :func:`effect_rows`; ``until_ms`` is when the time would have been up."""
    return folded(rows.select(*PULL, "target", "source", "effect", "line_number", "t_ms", "what", "duration_ms", "charges", "max_charges"), [*PULL, "target"], ["line_number"], TRACKED, _Tracked)
