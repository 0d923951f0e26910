"""Queries on boss definitions, effects, history and listings, with their SQL; they join those of :mod:`queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import half_even
from ..operators import conditions, corpus, effects, forensics, maintenance, pulls, rules, stats
from . import adapter
from .adapter import DUCK_EV
from .queries import _BOSS_SQL, _BOSSES, _SPAN, _TURNED, PULLS, bosses, index, query, rated, rounded, split, split_once, turned

PULL = stats.PULL

# ---- Boss definitions ----------------------------------------------------------------------------------------------------

#: One boss: phases by health, by a cast and by combat; timers with a chain, a cancel, a repeat and one from the start of combat.
DEFINITION = {
    "id": "b1",
    "boss_names": [],
    "phases": [
        {"id": "p1", "name": "One", "start_trigger": {"type": "combat_start"}, "conditions": [{"type": "phase_active", "phase_ids": ["p3"]}]},
        {"id": "p2", "name": "Two", "start_trigger": {"type": "hp_below", "percent": 70, "selector": ["B2", "B3", "B4"]}},
        {"id": "p3", "name": "Three", "start_trigger": {"type": "ability_cast", "keyword": "a1"}, "conditions": [{"type": "phase_active", "phase_ids": ["p2"]}]},
    ],
    "counters": [{"id": "casts", "increment_on": {"type": "ability_cast", "keyword": "a"}, "reset_on": {"type": "entity_death", "selector": ["U7", "U17", "U27"]}}],
    "timers": [
        {"id": "t1", "label": "Cast", "duration_seconds": 2400, "trigger": {"type": "ability_cast", "ability_ids": ["813", "817", "8112"]}, "cancel_trigger": {"type": "combat_end"}},
        {"id": "t2", "label": "After", "duration_seconds": 600, "trigger": {"type": "timer_expires", "timer_id": "t1"}},
        {"id": "t3", "label": "Start", "duration_seconds": 3600, "trigger": {"type": "combat_start"}},
        {"id": "t4", "label": "Ward", "duration_seconds": 300, "repeat_interval_seconds": 900, "repeat_count": 2, "trigger": {"type": "effect_applied", "keyword": "ward"}},
    ],
}
_RECOGNISED = f"""{PULLS}, {_BOSS_SQL}, bp as (select p.*, seen_line, max(p.t_ms) over (partition by p.log_path, p.pull_index) last_ms from p join ma using (log_path, pull_index) where boss_id = 'b1'),
br as (select *, row_number() over (partition by log_path, pull_index order by line_number) rn from bp where line_number >= seen_line)"""


def _script(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_once(spark, sf_dir)
    return conditions.boss_script(rows, corpus.first_match(rows, bosses(spark)), [DEFINITION])


# The machine read row by row: p2 can begin once a pull, from wherever; p3 from p2; p1 from p3.
@query(f"""{_RECOGNISED}, fl as (select *, coalesce(target in ('B2', 'B3', 'B4') and hp_max <> 0 and hp_current / hp_max * 100 <= 70, false) low, is_ability_activate and contains(lower(coalesce(ability, '')), 'a1') act from br),
ph as (select log_path, pull_index, rn, line_number, t_ms, 'p1' phase, false used, true entered from fl where rn = 1
  union all select f.log_path, f.pull_index, f.rn, f.line_number, f.t_ms, case when goes = '' then ph.phase else goes end, used or goes = 'p2', goes <> '' from ph join
    (select fl.*, null from fl) f on f.log_path = ph.log_path and f.pull_index = ph.pull_index and f.rn = ph.rn + 1,
    lateral (select case when ph.phase = 'p3' and f.is_combat_start then 'p1' when ph.phase <> 'p2' and f.low and not ph.used then 'p2' when ph.phase = 'p2' and f.act then 'p3' else '' end goes) g)
select log_path, pull_index, phase, line_number, t_ms start_ms from ph where entered""")
def boss_phases(spark, sf_dir):
    rows = _script(spark, sf_dir).where("what = 'phase'")
    return rows.select(*PULL, F.col("id").alias("phase"), "line_number", "start_ms")


@query(f"""{_RECOGNISED}, x as (select *, coalesce(is_death and target in ('U7', 'U17', 'U27'), false) back, is_ability_activate and contains(lower(coalesce(ability, '')), 'a') up from br),
y as (select *, sum(back::int) over (partition by log_path, pull_index order by line_number) era from x),
z as (select *, sum((up and not back)::int) over (partition by log_path, pull_index, era order by line_number) n from y),
w as (select *, lag(n) over (partition by log_path, pull_index order by line_number) before from z)
select log_path, pull_index, line_number, t_ms start_ms, n::double as value from w where n <> coalesce(before, 0)""")
def boss_counters(spark, sf_dir):
    rows = _script(spark, sf_dir).where("what = 'counter'")
    return rows.select(*PULL, "line_number", "start_ms", "value")


@query(f"""{_RECOGNISED}, ca as (select log_path, pull_index, line_number cl, t_ms ct from br where is_combat_end),
s1 as (select br.log_path, br.pull_index, 't1' id, br.t_ms start_ms, br.t_ms + 2400000 due, br.last_ms, min(ct) ct from br left join ca on ca.log_path = br.log_path and ca.pull_index = br.pull_index and cl > br.line_number
  where is_ability_activate and ability_id in ('813', '817', '8112') group by br.log_path, br.pull_index, br.line_number, br.t_ms, br.last_ms),
s2 as (select log_path, pull_index, 't2' id, due start_ms, due + 600000 due, last_ms, null::bigint ct from s1 where due <= last_ms and (ct is null or due <= ct)),
s3 as (select log_path, pull_index, 't3' id, max(t_ms) start_ms, max(t_ms) + 3600000 due, any_value(last_ms) last_ms, null::bigint ct from bp where is_combat_start and line_number <= seen_line group by 1, 2),
s4 as (select log_path, pull_index, 't4' id, t_ms start_ms, t_ms + 2100000 due, last_ms, null::bigint ct from br where not is_effect_removed and effect_name = 'Ward'),
u as (select * from s1 union all select * from s2 union all select * from s3 union all select * from s4)
select log_path, pull_index, id timer_id, start_ms, case when ct < due then ct when due <= last_ms then due else last_ms end end_ms, case when ct < due then 'cancelled' when due <= last_ms then 'expired' else 'pull ended' end ended from u""")
def boss_timers(spark, sf_dir):
    rows = _script(spark, sf_dir).where("what = 'timer'")
    return rows.select(*PULL, F.col("id").alias("timer_id"), "start_ms", "end_ms", "ended")


@query(f"""{PULLS}, {_BOSS_SQL}, tt(boss_id, timer_id, duration_ms) as (values ('b1', 'adds', 45000), ('b1', 'rage', 480000), ('b2', 'slam', 20000)),
en as (select log_path, pull_index, boss_id, arg_max(t_ms, line_number) start_ms from p join ma using (log_path, pull_index) where is_combat_start and line_number <= seen_line group by 1, 2, 3)
select log_path, pull_index, boss_id, timer_id, start_ms, start_ms + duration_ms end_ms from en join tt using (boss_id)""")
def combat_start_timers(spark, sf_dir):
    rows = split_once(spark, sf_dir)
    timers = spark.createDataFrame([("b1", "adds", 45000), ("b1", "rage", 480000), ("b2", "slam", 20000)], "boss_id string, timer_id string, duration_ms int")
    return rules.combat_start_timers(rows, corpus.first_match(rows, bosses(spark)), timers)


@query(f"""{PULLS}, x as (select *, sum(case when k % 3 = 0 then 1 when k % 7 = 0 then -1 else 0 end) over (partition by log_path, pull_index order by line_number) n from p)
select log_path, pull_index, min(line_number) line_number from x where n >= 3 group by 1, 2""")
def counter_edges(spark, sf_dir):
    k = F.col("k")
    counted = rules.counters(split(spark, sf_dir), k % 3 == 0, (k % 7 == 0) & (k % 3 != 0), F.lit(False), 0)
    return rules.counter_reaches(counted, 3)


@query(f"""{PULLS}, bt(boss_id, boss_name, def_rank, npc, name) as (values ('b2', 'U1 the Great', 1, null, 'U1'), ('b2', 'U1 the Great', 1, null, 'B5')),
sn as (select log_path, pull_index, line_number, source as name from p union all select log_path, pull_index, line_number, target from p),
hi as (select log_path, pull_index, line_number, boss_id, def_rank from sn join bt using (name) union all select log_path, pull_index, line_number, 'b1', 0 from p where is_death and target in ('U3', 'U33', 'U133') or is_combat_start)
select log_path, pull_index, boss_id, line_number seen_line from hi qualify row_number() over (partition by log_path, pull_index order by line_number, def_rank) = 1""")
def triggered_recognition(spark, sf_dir):
    """A boss without names of its own is told by its encounter trigger."""
    trigger = {"type": "any_of", "conditions": [{"type": "entity_death", "selector": ["U3", "U33", "U133"]}, {"type": "combat_start"}]}
    table = spark.createDataFrame([("b1", "Alpha", 0, [], []), _BOSSES[1]], "boss_id string, boss_name string, def_rank int, npc_ids array<string>, names array<string>")
    return corpus.first_match(split_once(spark, sf_dir), table, [{"id": "b1", "encounter_trigger": trigger}]).select(*PULL, "boss_id", "seen_line")


# ---- Effects ---------------------------------------------------------------------------------------------------------------

_LENGTH = 3_600_000
#: The rule row by row: at most one stretch ends at a row, and the last is open.
_FOLD = """ef as (select *, row_number() over (partition by {key} order by line_number, o) rn from eh),
eg as (select {key}, rn, false closes, null::bigint cs, null::bigint ce, 0 ca, case when what <> 'end' then t_ms end s, case when what <> 'end' then t_ms + ms end e, 0 a from ef where rn = 1
  union all select {fkey}, f.rn, g.s is not null and (f.t_ms >= g.e or f.what = 'end'), g.s, case when f.t_ms >= g.e then g.e else f.t_ms end, g.a,
    case when f.what = 'end' then null when g.s is null or f.t_ms >= g.e then f.t_ms else g.s end,
    case when f.what = 'end' then null when g.s is null or f.t_ms >= g.e or f.what = 'apply' then f.t_ms + f.ms else g.e end,
    case when g.s is null or f.t_ms >= g.e then 0 when f.what = 'apply' then g.a + 1 else g.a end
  from eg g join ef f on {on} and f.rn = g.rn + 1),
el as (select {key}, cs start_ms, ce end_ms, ca refreshes from eg where closes union all select {key}, s, e, a from eg where s is not null qualify row_number() over (partition by {key} order by rn desc) = 1 and rn = (select max(rn) from ef where {last}))"""


def _fold_sql(*key: str) -> str:
    names = ", ".join(key)
    return _FOLD.format(key=names, fkey=", ".join(f"f.{k}" for k in key), on=" and ".join(f"f.{k} = g.{k}" for k in key), last=" and ".join(f"ef.{k} = eg.{k}" for k in key))


@query(f"""{PULLS}, eh as (select log_path, pull_index, target, line_number, t_ms, 0 o, {_LENGTH} ms, case when is_heal then case when k % 3 = 0 then 'tick' else 'apply' end else 'end' end what from p where target is not null and (is_heal or is_death)),
{_fold_sql("log_path", "pull_index", "target")} select log_path, pull_index, target, 'Mend' effect, start_ms, end_ms, refreshes::bigint refreshes from el""")
def effect_intervals(spark, sf_dir):
    c = F.col
    rows = split(spark, sf_dir).where("target is not null")
    what = F.when(c("is_heal"), F.when(c("k") % 3 == 0, "tick").otherwise("apply")).when(c("is_death"), "end")
    sparse = rows.withColumn("what", what).where("what is not null").select(*PULL, "target", F.lit("Mend").alias("effect"), "line_number", "t_ms", "what", F.lit(_LENGTH).alias("duration_ms"))
    return rules.effect_intervals(sparse)


_LABELS = ["Scorch", "Kolto Probe", "Discharge", "Kolto Pods", "Plasmatize", "Kolto Shell"]
_MS = [30000, 21000, 18000, 2500, 30000, 180000]


# Row by row: a target's death ends all on it; charges tell how many are lost since the last application.
_TRACKED = f"""{PULLS},
lb as (select *, ['{"', '".join(_LABELS)}'][k % 6 + 1] label, [{", ".join(map(str, _MS))}][k % 6 + 1] * 300 ms, k % 6 = 5 shell from p where target is not null),
rw as (
  select log_path, pull_index, target, 'U' || (k % 4) source, label effect, line_number, t_ms, ms, case when shell then greatest(7 - charges, 0) end lost,
    case when is_effect_removed then 'end' when shell and is_charges_modified then 'charges' when effect_name = 'Ward' then 'apply' else 'tick' end what
  from lb where (effect_name = 'Ward' or is_heal) and not is_death),
ks as (select distinct log_path, pull_index, target, source, effect from rw),
eh as (
  select * from rw
  union all select log_path, pull_index, target, source, effect, line_number, t_ms, 0, null, 'end' from ks join (select log_path, pull_index, target, line_number, t_ms from lb where is_death) using (log_path, pull_index, target)),
ef as (select *, row_number() over (partition by log_path, pull_index, target, source, effect order by line_number) rn from eh),
eg as (
  select log_path, pull_index, target, source, effect, rn, null::bigint cs, null::bigint ce, null::bigint cu, 0 ca, 0 cl,
    case when what in ('apply', 'tick') then t_ms end s, case when what in ('apply', 'tick') then t_ms + ms end e, 0 a, 0 l
  from ef where rn = 1
  union all
  select f.log_path, f.pull_index, f.target, f.source, f.effect, f.rn, case when late or f.what = 'end' then g.s end, case when late then g.e when f.what = 'end' then f.t_ms end, g.e, g.a, g.l,
    case when f.what = 'end' or (f.what = 'charges' and late) then null when f.what = 'charges' then g.s when late or g.s is null then f.t_ms else g.s end,
    case when f.what = 'end' or (f.what = 'charges' and late) then null when f.what = 'charges' then g.e when late or g.s is null or f.what = 'apply' then f.t_ms + f.ms else g.e end,
    case when late or g.s is null then 0 when f.what = 'apply' then g.a + 1 else g.a end,
    case when late or g.s is null or f.what = 'apply' then 0 when f.what = 'charges' then coalesce(f.lost, g.l) else g.l end
  from (select *, null from eg) g join ef f on g.log_path = f.log_path and g.pull_index = f.pull_index and g.target = f.target and g.source = f.source and g.effect = f.effect and f.rn = g.rn + 1,
    lateral (select coalesce(f.t_ms >= g.e, false) late) o),
fin as (select *, row_number() over (partition by log_path, pull_index, target, source, effect order by rn desc) back from eg)
select log_path, pull_index, source, target, effect, cs start_ms, ce end_ms, cu until_ms, ca::bigint refreshes, cl::bigint charges_lost from eg where cs is not null
union all select log_path, pull_index, source, target, effect, s, e, e, a::bigint, l::bigint from fin where back = 1 and s is not null"""


@query(_TRACKED)
def standing_effects(spark, sf_dir):
    """Wards carry names of standing effects, healing the ability's; times are three hundredfold, as the adapter's events are minutes apart."""
    label = F.element_at(F.array(*map(F.lit, _LABELS)), F.col("k") % 6 + 1)
    ward = F.col("effect_name") == "Ward"
    rows = split(spark, sf_dir).withColumns({"source": F.concat(F.lit("U"), F.col("k") % 4), "effect_name": F.when(ward, label).otherwise(F.col("effect_name")), "ability": F.when(ward | F.col("is_heal"), label)})
    table = effects.effect_rules(spark).withColumn("duration_ms", F.col("duration_ms") * 300)
    return effects.tracked_effects(effects.effect_rows(rows, table)).select(*PULL, "source", "target", "effect", "start_ms", "end_ms", "until_ms", "refreshes", "charges_lost")


@query(f"""{PULLS}, lb as (select *, ['Saber Ward', 'Scorch', 'Lucky Break', 'Mental Alacrity'][k % 4 + 1] label from p where effect_name = 'Ward'),
tr(label, name, applied, ms) as (values ('Saber Ward', 'Saber Ward (cooldown)', true, 90000), ('Saber Ward', 'Saber Ward', true, 12000), ('Scorch', 'Scorch', true, 30000), ('Lucky Break', 'Combat Rez (cooldown)', true, 300000), ('Mental Alacrity', 'Mental Alacrity', true, 15000))
select log_path, pull_index, line_number, name label, ms::bigint duration_ms from lb join tr using (label) where effect_type = 'ApplyEffect'""")
def standing_timers(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, ("Saber Ward", "Scorch", "Lucky Break", "Mental Alacrity"))), F.col("k") % 4 + 1)
    rows = split(spark, sf_dir).withColumn("effect_name", F.when(F.col("effect_name") == "Ward", label).otherwise(F.col("effect_name"))).withColumn("ability", F.lit(None).cast("string"))
    return rules.keyword_hits(rows, effects.timer_rules(spark)).select(*PULL, "line_number", "label", "duration_ms")


# ---- More of each pull ---------------------------------------------------------------------------------------------------


@query(f"""{PULLS}, x as (select *, not leaves and not is_death live from c) select log_path, pull_index, source as name, 'cc' kind, coalesce(ability, effect_name) as key, count(*) n from x where live and is_hard_cc group by all
union all select log_path, pull_index, source, 'raid_buff', coalesce(ability, effect_name), count(*) from x where live and is_raid_buff_cast group by all""")
def casts_by_ability(spark, sf_dir):
    return stats.cast_breakdown(split(spark, sf_dir))


@query(f"{PULLS}, bo as (select log_path, pull_index, source as name, sum(amount::decimal(18,2))::double v from q where attack and target in ('B2', 'B5') group by all) select log_path, pull_index, name, round(v / duration, 6) boss_dps from bo join pd using (log_path, pull_index)")
def boss_rates(spark, sf_dir):
    rows = split_once(spark, sf_dir)
    damage = stats.target_filtered(rows, spark.createDataFrame([("B2",), ("B5",)], "name string"))
    return rounded(stats.with_boss_rate(damage, pulls.pulls_of(rows)).select(*PULL, "name", "boss_dps"))


@query(f"{_TURNED} select target as name, count(*) deaths from p where is_death and target_is_player group by 1")
def death_victims(spark, sf_dir):
    return forensics.victims(forensics.deaths_of(turned(split(spark, sf_dir))))


@query(f"""{_TURNED}, hw as (select h.log_path, h.pull_index, h.target, d.line_number death_line, h.line_number, h.k::double hp_current, 100::double hp_max from p d join p h using (log_path, pull_index, target)
  where d.is_death and d.target_is_player and not h.is_death and h.t_ms between d.t_ms - {_SPAN} and d.t_ms and h.line_number < d.line_number)
select *, row_number() over (partition by log_path, pull_index, target, death_line order by line_number desc)::int rank from hw qualify rank <= 60""")
def hp_before_death(spark, sf_dir):
    rows = turned(split_once(spark, sf_dir)).withColumns({"hp_current": F.col("k").cast("double"), "hp_max": F.lit(100.0)})
    return forensics.hp_samples(rows, 60, _SPAN).select(*PULL, "target", "death_line", "line_number", "hp_current", "hp_max", "rank")


@query(f"{PULLS} select log_path, pull_index, name, round_even(dps, 0)::bigint dps from ra where is_player")
def whole_rates(spark, sf_dir):
    return rated(spark, sf_dir).where("is_player").select(*PULL, "name", half_even("dps").alias("dps"))


# ---- History and listings --------------------------------------------------------------------------------------------------


@query(f"""{PULLS}, lb as (select *, case when pull_index % 2 = 0 then 'Alpha' when pull_index % 3 = 0 then 'Nobody' else 'U1 the Great' end label from pd),
kn(label, target) as (values ('Alpha', 'B2'), ('Alpha', 'U5'), ('U1 the Great', 'U1'), ('U1 the Great', 'B5'))
select log_path, pull_index, label, source as name, sum(amount::decimal(18,2))::double boss_damage, round(sum(amount::decimal(18,2))::double / any_value(duration), 6) boss_dps from q join lb using (log_path, pull_index) join kn using (label, target) where attack and amount <> 0 group by all""")
def history_boss_rates(spark, sf_dir):
    rows = split_once(spark, sf_dir)
    label = F.when(F.col("pull_index") % 2 == 0, "Alpha").when(F.col("pull_index") % 3 == 0, "Nobody").otherwise("U1 the Great")
    return rounded(corpus.labelled_boss_damage(stats.breakdown(rows, "damage", "target"), pulls.pulls_of(rows).withColumn("label", label), bosses(spark)))


@query(f"""with {DUCK_EV}, lg as (select distinct log_path from e), rq as (select line_number request_id, case when k % 5 = 0 then '../' || log_path || '.txt' else log_path || '.txt' end file, case when k % 7 = 0 then null else line_number end start_line, line_number + 10 end_line from e)
select request_id, log_path, log_path is null or start_line is null refused from rq left join (select log_path || '.txt' file, log_path from lg) using (file)""")
def pull_lookup(spark, sf_dir):
    """A request for each event: some name a file that the index doesn't have, some no line."""
    rows = adapter.events(spark, sf_dir)
    file, k = F.concat("log_path", F.lit(".txt")), F.col("k")
    requests = rows.select(F.col("line_number").alias("request_id"), F.when(k % 5 == 0, F.concat(F.lit("../"), file)).otherwise(file).alias("file"), F.when(k % 7 != 0, F.col("line_number")).alias("start_line"), (F.col("line_number") + 10).alias("end_line"))
    return corpus.lookup(requests, rows.select("log_path").distinct().withColumn("file", file)).select("request_id", "log_path", "refused")


@query(f"{PULLS} select log_path, pull_index, row_number() over (order by log_path desc, start_ms desc, pull_index desc)::int place from pd")
def pulls_newest_first(spark, sf_dir):
    return corpus.listed(pulls.pulls_of(split(spark, sf_dir)), F.desc("log_path"), F.desc("start_ms"), F.desc("pull_index")).select(*PULL, "place")


@query(f"{PULLS}, {_BOSS_SQL}, b as (select boss_id, count(*) pulls from ix where boss_id is not null group by 1) select boss_id, pulls, row_number() over (order by pulls desc, boss_id)::int place from b")
def bosses_by_pulls(spark, sf_dir):
    return corpus.listed(corpus.boss_summary(index(spark, sf_dir)), F.desc("pulls"), "boss_id").select("boss_id", "pulls", "place")


@query(f"{PULLS}, b as (select name, count(*) encounters from st where is_player group by 1) select name, encounters, row_number() over (order by encounters desc, name)::int place from b")
def players_by_encounters(spark, sf_dir):
    return corpus.listed(corpus.players_seen(stats.entity_stats(split(spark, sf_dir))), F.desc("encounters"), "name").select("name", "encounters", "place")


@query(f"""{PULLS}, tp as (select log_path, pull_index, name, round_even(dps, 0)::bigint v, row_number() over (partition by log_path, pull_index order by dps desc, name) r from ra where is_player)
select log_path, pull_index, start_ms, coalesce(string_agg(name || ' ' || v, ', ' order by r) filter (r <= 3), '') top, pull_index % 3 = 1 unverified from pd left join tp using (log_path, pull_index) group by 1, 2, 3""")
def history_list(spark, sf_dir):
    rows = split_once(spark, sf_dir)
    found = pulls.pulls_of(rows)
    entities = stats.with_rates(stats.entity_stats(rows), found)
    return maintenance.history_listing(found.withColumn("unverified", F.col("pull_index") % 3 == 1), entities).select(*PULL, "start_ms", "top", "unverified")


@query(f"{PULLS} select log_path, arg_max(pull_index, start_ms) filter (damage > 0 or healing > 0) pull_index from (select log_path, pull_index, start_ms, sum(damage_done) damage, sum(healing_done) healing from pd left join st using (log_path, pull_index) group by 1, 2, 3) group by 1")
def shown_pulls(spark, sf_dir):
    """Of each log, the pull that a display stays on: the last one with damage or healing."""
    rows = split_once(spark, sf_dir)
    return stats.shown(pulls.pulls_of(rows), stats.entity_stats(rows)).select(*PULL)
