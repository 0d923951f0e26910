"""Queries on countdowns with shared labels, scopes and further measures, with their SQL; they join those of :mod:`queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conditions, corpus, pulls, rules, stats
from ..sources.shared import once
from . import adapter
from .adapter import TIMING
from .queries import PULLS, bosses, query, rounded, split, split_once
from .scripts import _RECOGNISED, DEFINITION

PULL = stats.PULL

#: (rule_id, label, keyword, category, duration, warning, announce at the start, repeat interval, repeats): rules 1 and 2 share label and
#: category, 3 shares the label only.
_SHARED = [
    (1, "Venom", "a3", "dot", 3_600_000, 600_000, True, None, 0),
    (2, "Venom", "a13", "dot", 1_200_000, 300_000, True, None, 0),
    (3, "Venom", "a1", "custom", 1_800_000, 600_000, False, 900_000, 2),
    (4, "Mend", "heal", "hot", 2_400_000, 0, True, None, 0),
    (5, "Slam", "damage", "boss", 900_000, 1_200_000, False, None, 0),
]
_VALUES = ", ".join(str(r).replace("None", "null::bigint").replace("True", "true").replace("False", "false") for r in _SHARED)
_SHARED_SQL = f"""{PULLS},
kr(rule_id, label, keyword, category, duration_ms, warn_ms, loud, every, times) as (values {_VALUES}),
kh as (
  select p.log_path, p.pull_index, p.target, p.line_number, p.t_ms, kr.*, duration_ms + coalesce(every * times, 0) whole, category in ('dot', 'hot', 'cooldown') fresh, category in ('dot', 'hot') mortal
  from p join kr on contains(lower(concat_ws(' ', ability, effect_name)), keyword)
  where not is_ability_activate and effect_type not in ('RemoveEffect', 'ModifyCharges')),
dd as (select log_path, pull_index, target, t_ms died from p where is_death),
nx as (
  select *, case when fresh then lead(t_ms) over (partition by log_path, pull_index, label, category, target order by t_ms, line_number, rule_id) end next_ms from kh),
di as (
  select nx.log_path, nx.pull_index, nx.target, nx.line_number, nx.rule_id, min(died) died
  from nx join dd on dd.log_path = nx.log_path and dd.pull_index = nx.pull_index and dd.target = nx.target and died >= t_ms where mortal group by all),
iv as (
  select nx.*, t_ms + whole due, least(t_ms + whole, coalesce(next_ms, 9e18::bigint), coalesce(died, 9e18::bigint)) end_ms, coalesce(died, 9e18::bigint) dies
  from nx left join di on di.log_path = nx.log_path and di.pull_index = nx.pull_index and di.target = nx.target and di.line_number = nx.line_number and di.rule_id = nx.rule_id),
cd as (select *, case when dies = end_ms then 'died' when next_ms < due and next_ms = end_ms then 'refreshed' else 'expired' end ended from iv)"""


def _shared_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_once(spark, sf_dir)
    schema = "rule_id int, label string, keyword string, category string, duration_ms long, warn_ms long, announce_on_start boolean, repeat_interval_ms long, repeat_count int"
    table = spark.createDataFrame(_SHARED, schema).withColumn("when_applied", F.lit(True))
    return rules.timer_intervals(rules.keyword_hits(rows, table), rows)


@query(f"{_SHARED_SQL} select log_path, pull_index, rule_id, label, category, target, line_number, t_ms start_ms, end_ms, ended from cd")
def shared_countdowns(spark, sf_dir):
    """Rules that share a label refresh each other's countdown on a target, if they are of one category that starts anew."""
    return _shared_intervals(spark, sf_dir).select(*PULL, "rule_id", "label", "category", "target", "line_number", "start_ms", "end_ms", "ended")


@query(f"""{_SHARED_SQL},
ro as (select *, r, case when r = 0 then t_ms else t_ms + duration_ms + (r - 1) * every end began, case when r = 0 then duration_ms else every end len from cd, unnest(range(0, times + 1)) u(r)),
ca as (
  select *, 'start' what, began at_ms, label as text from ro where r = 0 and loud
  union all select *, 'repeat', began, label from ro where r > 0 and (began < end_ms or (began = end_ms and ended = 'expired'))
  union all
  select *, 'warning', greatest(began + len - warn_ms, began), label || case when loud then ' ending' else ' soon' end
  from ro where warn_ms > 0 and greatest(began + len - warn_ms, began) < end_ms
  union all select *, 'zero', end_ms, label from ro where r = times and not loud and ended = 'expired')
select log_path, pull_index, rule_id, category, target, line_number, what, at_ms, text from ca""")
def countdown_announcements(spark, sf_dir):
    return rules.announcements(_shared_intervals(spark, sf_dir))


#: Timers that are scoped by difficulty and group size, of the boss that :data:`DEFINITION` is of.
SCOPED = {
    "id": "b1",
    "boss_names": [],
    "phases": [{"id": "p1", "name": "One"}],
    "timers": [
        {"id": "any", "label": "Any", "duration_seconds": 600, "trigger": {"type": "ability_cast", "keyword": "a1"}},
        {"id": "hard", "label": "Hard", "duration_seconds": 900, "trigger": {"type": "ability_cast", "keyword": "a"}, "difficulties": ["veteran", "master"]},
        {"id": "big", "label": "Big", "duration_seconds": 900, "trigger": {"type": "effect_applied", "keyword": "ward"}, "difficulties": ["story"], "group_sizes": [16]},
    ],
}
_SCOPED = f"""{_RECOGNISED},
ar as (select log_path, line_number, case k % 3 when 0 then 'story' when 1 then 'master' end difficulty, case when k % 2 = 0 then 8 else 16 end size from e where is_area_entered),
sc as (
  select p.log_path, p.line_number, last_value(difficulty ignore nulls) over w difficulty, last_value(case when difficulty is not null then size end ignore nulls) over w size
  from p left join ar using (log_path, line_number) window w as (partition by p.log_path order by p.line_number)),
bs as (
  select br.*, difficulty, size, is_ability_activate and contains(lower(coalesce(ability, '')), 'a1') one, is_ability_activate and contains(lower(coalesce(ability, '')), 'a') cast_a
  from br join sc using (log_path, line_number))"""


@query(f"""{_SCOPED} select log_path, pull_index, 'any' timer_id, line_number, t_ms start_ms from bs where one
union all select log_path, pull_index, 'hard', line_number, t_ms from bs where cast_a and coalesce(difficulty in ('veteran', 'master'), true)
union all select log_path, pull_index, 'big', line_number, t_ms from bs where not is_effect_removed and effect_name = 'Ward' and coalesce(difficulty = 'story', true) and coalesce(size = 16, true)""")
def scoped_timers(spark, sf_dir):
    """Timers by the difficulty and group size of the last area entered before each row, in whichever pull."""
    k, area = F.col("k"), F.col("is_area_entered")
    difficulty = F.when(area, F.when(k % 3 == 0, "story").when(k % 3 == 1, "master"))
    raw = adapter.events(spark, sf_dir).withColumns({"difficulty": difficulty, "group_size": F.when(k % 2 == 0, 8).otherwise(16)})
    rows = once(pulls.with_pulls(raw, TIMING), "split")
    found = conditions.boss_script(rows, corpus.first_match(rows, bosses(spark)), [SCOPED]).where("what = 'timer'")
    return found.select(*PULL, F.col("id").alias("timer_id"), "line_number", "start_ms")


#: The measures of leaderboards but the damage taken, which has a query of its own.
_MEASURES = {"damage": "damage_done", "healing": "healing_done", "threat": "threat", "deaths": "deaths", "casts": "ability_casts"}
_UNION = " union all ".join(f"select '{m}' measure, log_path, pull_index, name, {x}::double v from st" for m, x in _MEASURES.items())


@query(f"""{PULLS}, v as ({_UNION})
select measure, log_path, pull_index, name, v as value, sum(v::decimal(28,6)) over (partition by measure, log_path, pull_index)::double total,
  row_number() over (partition by measure, log_path, pull_index order by v desc, name)::int rank
from v where v > 0""")
def leaderboards(spark, sf_dir):
    """The other measures' leaderboards, one after the other."""
    entities = once(stats.entity_stats(split(spark, sf_dir)), "entities")
    out = None
    for measure, column in _MEASURES.items():
        rows = stats.leaderboard(entities.withColumn("v", F.col(column).cast("double")), "v").withColumn("measure", F.lit(measure))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""{_RECOGNISED},
fl as (
  select *, coalesce(target in ('B2', 'B3', 'B4') and hp_max <> 0 and hp_current / hp_max * 100 <= 70, false) low, is_ability_activate and contains(lower(coalesce(ability, '')), 'a1') act from br),
ph as (
  select log_path, pull_index, rn, line_number, t_ms, 'p1' phase, false used, true entered from fl where rn = 1
  union all
  select f.log_path, f.pull_index, f.rn, f.line_number, f.t_ms, case when goes = '' then ph.phase else goes end, used or goes = 'p2', goes <> ''
  from ph join (select fl.*, null from fl) f on f.log_path = ph.log_path and f.pull_index = ph.pull_index and f.rn = ph.rn + 1,
    lateral (select case when ph.phase = 'p3' and f.is_combat_start then 'p1' when ph.phase <> 'p2' and f.low and not ph.used then 'p2' when ph.phase = 'p2' and f.act then 'p3' else '' end goes) g),
fi as (select log_path, pull_index, phase, min(line_number) line, min(t_ms) t, count(*) entries from ph where entered group by 1, 2, 3)
select log_path, pull_index, (row_number() over (partition by log_path, pull_index order by t, line) - 1)::int nth, phase, round((t - start_ms) / 1000.0::double, 6) as offset, entries
from fi join pd using (log_path, pull_index)""")
def phase_times(spark, sf_dir):
    """Phases of each pull by their first entry, with seconds from the pull's start."""
    rows = split_once(spark, sf_dir)
    script = conditions.boss_script(rows, corpus.first_match(rows, bosses(spark)), [DEFINITION])
    return rounded(conditions.phase_times(script, pulls.pulls_of(rows)))
