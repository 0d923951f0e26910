"""From log lines to typed events: native column expressions only, no join and no shuffle.

Line grammar: ``[time] [source] [target] [ability {id}] [type {id}: name {id}] (value ...) <threat>``.

A line is cut at its brackets once; later columns read the parts, and each pattern runs only for kinds of events that can have it. No pattern repeats a group without bound, so a line
may have any length; parentheses may be nested to any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Activations that count as a raid buff.
RAID_BUFFS = [
    "Transcendence", "Aegis Shield", "Predation", "Warding Shield", "Unlimited Power", "Inspiration",
    "Tactical Superiority", "Supercharged Celerity", "Stack the Deck", "Force Empowerment", "Bloodthirst", "Rally",
]
#: Marks of an attack that didn't land, and effect names that take control away.
AVOIDED = "miss|dodge|parry|deflect|resist"
HARD_CC = "stunned|incapacitated|asleep|sleeping|lifted"
#: A line that begins with so many brackets, each closed before the next opens.
_HEAD = r"^(?:[^\[\]]*\[[^\[\]]*\]){%d}"


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _bare(text: Column) -> Column:
    """Without ``{id}``."""
    return F.when(text.contains("{"), F.regexp_replace(text, r"\{[^{}]*\}", "")).otherwise(text)


def clean_name(text: Column) -> Column:
    """Without ``{id}`` and leading ``@``; empty becomes null."""
    return _some(F.trim(F.ltrim(F.trim(_bare(text)), F.lit("@"))))


def numeric_id(text: Column) -> Column:
    return F.when(text.contains("{"), _some(F.regexp_extract(text, r"\{(\d+)\}", 1)))


def _entity(field: Column) -> dict[str, Column]:
    token = F.substring_index(field, "|", 1)
    player_like = token.startswith("@")
    pet = player_like & token.contains("/")
    body = F.when(pet, F.substr(token, F.instr(token, "/") + 1, F.length(token))).otherwise(token)
    thing = _some(F.trim(F.substring_index(_bare(body), ":", 1)))
    player = _some(F.trim(F.regexp_replace(F.substr(token, F.lit(2), F.length(token)), r"#\d+$", "")))
    hp = F.trim(F.try_element_at(F.split(field, r"\|"), F.lit(3)), F.lit("() "))
    number = lambda i: F.when(hp.rlike(r"^\d+/\d+$"), F.split(hp, "/")[i].cast("double"))
    return {
        "name": F.when(player_like & ~pet, player).otherwise(thing),
        "is_player": F.coalesce(player_like & ~pet & (field != ""), F.lit(False)),
        "npc_id": F.when((~player_like | pet) & body.contains("{"), _some(F.regexp_extract(body, r"\{([^{}]*)\}", 1))),
        "hp_current": number(0),
        "hp_max": number(1),
    }


def first_group(text: Column) -> Column:
    """What is between the first parenthesis and the one that closes it, however deep; null where none does."""
    rest = F.substr(text, F.instr(text, "(") + 1, F.length(text))
    opened = lambda part: F.length(part) - F.length(F.replace(part, F.lit("("), F.lit("")))
    none = F.lit(None).cast("int")

    def step(acc: Column, part: Column) -> Column:
        """The parts seen, the parentheses still open, and the parts up to the one that closes the first."""
        n, depth = acc["n"] + 1, acc["depth"] + opened(part) - 1
        return F.struct(n.alias("n"), depth.alias("depth"), F.coalesce(acc["at"], F.when(depth == 0, n)).alias("at"))

    parts = F.split(rest, r"\)")
    start = F.struct(F.lit(0).alias("n"), F.lit(1).alias("depth"), none.alias("at"))
    closed = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step, lambda acc: acc["at"])
    simple = F.substring_index(rest, ")", 1)
    return F.when(text.contains("("), F.when(rest.contains(")") & ~simple.contains("("), simple).otherwise(F.call_function("substring_index", rest, F.lit(")"), closed)))


def remaining_charges(values: Column) -> Column:
    """``N charges`` from the value groups, else null."""
    found = F.filter(F.transform(values, lambda v: F.regexp_extract(v, r"^\s*(\d+) charges?\b", 1)), lambda x: x != "")
    return F.try_element_at(found, F.lit(1)).cast("int")


def _cut(lines: DataFrame) -> DataFrame:
    """(log_path, line_number, raw, parts) of lines with three brackets or more; parts: text and brackets in turn up to the fifth, then what follows."""
    raw = F.col("raw")
    every = F.regexp_extract_all("raw", F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    after = F.regexp_extract("raw", r"^(?:.*?\[[^\[\]]*\]){3,5}(.*)$", 1)
    turned = F.concat(F.flatten(F.transform(F.slice(every, 1, 5), lambda b: F.array(F.lit(""), b))), F.array(after))
    parts = F.when(raw.rlike(_HEAD % 5), F.split("raw", r"[\[\]]", 11)).otherwise(turned)
    rows = lines.select("log_path", "line_number", F.trim("line").alias("raw")).where(raw.rlike(_HEAD % 3) | (F.size(every) >= 3))
    return rows.select("log_path", "line_number", "raw", parts.alias("parts"))


def parse_events(lines: DataFrame) -> DataFrame:
    """Events of ``lines`` (log_path, line_number, line); a line of fewer than three brackets, or a null one, gives none."""
    part = lambda i: F.get("parts", F.lit(2 * i - 1))
    source, target, effect, tail = _entity(part(2)), _entity(part(3)), part(5), F.element_at("parts", -1)
    clock = F.regexp_extract(part(1), r"\d{1,2}:\d{2}:\d{2}(?:\.\d+)?", 0)
    rows = _cut(lines).select(
        "log_path", "line_number", "raw", tail.alias("tail"), clock.alias("clock"), part(1).alias("p1"),
        source["name"].alias("source"), source["is_player"].alias("source_is_player"), source["npc_id"].alias("source_npc_id"),
        (part(3) == "=").alias("same"), *[target[c].alias(f"_{c}") for c in ("name", "is_player", "npc_id")],
        target["hp_current"].alias("hp_current"), target["hp_max"].alias("hp_max"),
        clean_name(part(4)).alias("ability"), numeric_id(part(4)).alias("ability_id"),
        clean_name(F.substring_index(effect, ":", 1)).alias("effect_type"),
        F.when(effect.contains(":"), clean_name(F.substr(effect, F.instr(effect, ":") + 1, F.length(effect)))).alias("effect_name"),
        first_group(tail).alias("g"),
    )
    rows = rows.select(
        "log_path", "line_number", "raw",
        F.when(F.col("clock") == "", F.col("p1")).otherwise(F.col("clock")).alias("timestamp"),
        "source", "source_is_player", "source_npc_id",
        F.when(F.col("same"), F.col("source")).otherwise(F.col("_name")).alias("target"),
        F.when(F.col("same"), F.col("source_is_player")).otherwise(F.col("_is_player")).alias("target_is_player"),
        F.when(F.col("same"), F.col("source_npc_id")).otherwise(F.col("_npc_id")).alias("target_npc_id"),
        "hp_current", "hp_max", "ability", "ability_id", "effect_type", "effect_name",
        F.when(F.col("tail").contains("("), F.regexp_extract_all("tail", F.lit(r"\(([^()]*)\)"), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("values"),
        "g", "tail",
    )
    return with_flags(rows).drop("g", "tail")


def with_flags(rows: DataFrame) -> DataFrame:
    """Kinds of an event from effect type and name only, and the amounts of value group ``g`` and ``tail``."""
    low = F.lower(F.concat_ws(" ", "effect_type", "effect_name"))
    tight = F.replace(low, F.lit(" "), F.lit(""))
    kind = F.lower(F.coalesce("effect_type", F.lit("")))
    name = F.replace(F.lower(F.coalesce("effect_name", F.lit(""))), F.lit(" "), F.lit(""))
    number = lambda text, mark, pattern: F.when(F.col(text).contains(mark), F.regexp_extract(text, pattern, 1).try_cast("double"))
    rows = rows.withColumns({
        "is_damage": low.contains("damage"), "is_heal": low.contains("heal"),
        "is_death": (F.trim(kind) == "event") & (F.trim(F.lower(F.coalesce("effect_name", F.lit("")))) == "death"),
        "is_combat_start": tight.contains("entercombat"), "is_combat_end": tight.contains("exitcombat"), "is_area_entered": tight.contains("areaentered"),
        "is_effect_removed": F.replace(kind, F.lit(" "), F.lit("")).contains("removeeffect"),
        "is_charges_modified": F.replace(kind, F.lit(" "), F.lit("")).contains("modifycharges"),
        "is_ability_activate": name.contains("abilityactivate"), "is_threat_modified": name.contains("modifythreat"), "is_interrupted": name.contains("abilityinterrupt"),
    })
    hit = (F.col("is_damage") | F.col("is_heal")) & F.col("g").isNotNull()
    rows = rows.withColumn("lead", F.when(hit, F.regexp_extract("g", r"^\s*(-?\d+(?:\.\d+)?\*?)", 1)))
    group = r"(?i)(\d+)\s+Player\s+([A-Za-z_]+)"
    or_zero = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.withColumns({
        "is_hard_cc": F.col("source_is_player") & ~F.col("target_is_player") & ~F.col("is_effect_removed") & name.rlike(HARD_CC),
        "is_raid_buff_cast": F.coalesce(F.col("is_ability_activate") & F.col("source_is_player") & F.col("ability").isin(RAID_BUFFS), F.lit(False)),
        "group_size": F.when(F.col("is_area_entered"), F.regexp_extract("effect_name", group, 1).try_cast("int")),
        "difficulty": F.when(F.col("is_area_entered"), _some(F.lower(F.regexp_extract("effect_name", group, 2)))),
        "amount": or_zero(F.rtrim("lead", F.lit("*")).try_cast("double")),
        "is_critical": F.coalesce(F.col("lead").endswith("*"), F.lit(False)),
        "overheal": or_zero(F.when(F.col("is_heal"), number("g", "~", r"~(\d+(?:\.\d+)?)"))),
        "shield_absorbed": or_zero(F.when(F.col("is_damage"), number("g", "-shield", r"(?s)-shield\b.*?\((\d+(?:\.\d+)?)\s+absorbed"))),
        "avoidance": F.when(F.col("is_damage") & F.col("g").contains("-"), _some(F.regexp_extract("g", rf"-({AVOIDED})\b", 1))),
        "threat_delta": or_zero(F.when(F.col("is_threat_modified"), number("tail", "<", r"<(-?\d+(?:\.\d+)?)>"))),
    }).drop("lead")


def hp_percent(current: Column, most: Column) -> Column:
    return F.when(most > 0, F.least(F.greatest(100 * current / most, F.lit(0.0)), F.lit(100.0)))


def half_even(x: Column | str, places: int = 0) -> Column:
    """Rounded to so many places by the exact binary value, halves to the even side; a whole number where ``places`` is 0."""
    x = F.col(x) if isinstance(x, str) else x
    if not places:
        return F.rint(x).cast("long")
    unit = F.lit(10.0**places)

    def halves(v: Column) -> tuple[Column, Column]:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high

    # Only where the product shows a half exactly, its rounding error (Dekker's product) tells on which side the value lies.
    product = x * unit
    (a, b), (c, d) = halves(x), halves(unit)
    error = ((a * c - product) + a * d + b * c) + b * d
    low = F.floor(product).cast("double")
    tie = product == low + 0.5
    return F.when(tie & (error > 0), low + 1).when(tie & (error < 0), low).otherwise(F.rint(product)) / unit


def alacrity_scaled(seconds: Column, percent: Column) -> Column:
    return F.when(percent > 0, seconds / (1 + percent / 100)).otherwise(seconds)


#: Names of record keys, each with its other names, and of kinds.
KEYS = {"kind": ["kind", "event", "type"], "source": ["source", "attacker", "caster"], "target": ["target", "victim"], "ability": ["ability", "ability_name", "action"], "amount": ["amount", "value", "damage", "healing"], "timestamp": ["timestamp", "time"]}
KINDS = {"damage": "damage", "damaged": "damage", "heal": "heal", "healing": "heal", "death": "death", "killed": "death", "cast": "cast", "ability": "cast", "miss": "miss", "effect_applied": "effect_applied", "apply_effect": "effect_applied", "effect_removed": "effect_removed", "remove_effect": "effect_removed", "resource": "resource"}


def normalise_records(records: DataFrame, column: str = "raw") -> DataFrame:
    """Records with aliased keys (a map of strings in ``column``) as canonical columns; an unknown kind stays as ``unknown``."""
    pick = lambda names: F.coalesce(*[F.col(column)[n] for n in names])
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    kind = F.lower(F.trim(F.coalesce(*[F.nullif(F.col(column)[n], F.lit("")) for n in KEYS["kind"]])))
    named = [pick(names).alias(k) for k, names in KEYS.items() if k not in ("kind", "amount")]
    return records.select(F.coalesce(kinds[kind], F.lit("unknown")).alias("kind"), *named, F.coalesce(pick(KEYS["amount"]).try_cast("double"), F.lit(0.0)).alias("amount"), column)
