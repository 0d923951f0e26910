"""Queries over the given tables, one or more for each group of operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import clock, corpus, forensics, maintenance, pulls, rules, stats, timeline
from ..sources.shared import once
from . import adapter
from .adapter import DUCK_EV, TIMING

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


# Row by row, as the rule is told: state after each line of each log.
PULLS = f"""with recursive {DUCK_EV},
n as (select *, row_number() over (partition by log_path order by line_number) rn, lag(t_ms) over (partition by log_path order by line_number) pt,
  last_value(case when is_combat_start then t_ms end ignore nulls) over (partition by log_path order by line_number rows between unbounded preceding and 1 preceding) pe from e),
s as (select log_path, rn, line_number, cast(0 as bigint) pull_index, case when is_combat_end then t_ms end left_ms from n where rn = 1
  union all
  select log_path, rn, line_number, case when cut then pull_index + 1 else pull_index end, coalesce(case when not cut then left_ms end, case when is_combat_end then t_ms end)
  from (select n.*, s.pull_index, s.left_ms, coalesce(n.is_combat_start and n.t_ms - n.pe >= {TIMING.enter}, false) or coalesce(case when s.left_ms is not null then n.t_ms - s.left_ms > {TIMING.trailing} else n.t_ms - n.pt > {TIMING.gap} end, false) cut
    from n join s on n.log_path = s.log_path and n.rn = s.rn + 1)),
p as (select e.*, s.pull_index, last_value(case when is_area_entered then e.line_number end ignore nulls) over (partition by e.log_path order by e.line_number) area_line from e join s using (log_path, line_number)),
pl as (select log_path, pull_index, min(line_number) start_line, max(line_number) end_line, max(area_line) area_line, min(t_ms) start_ms,
  coalesce(min(t_ms) filter (is_combat_end), max(t_ms)) end_ms, count(*) n_events, max((is_damage and ability is not null and amount > 0)::int) = 1 is_fight from p group by 1, 2),
pd as (select *, greatest((end_ms - start_ms) / 1000.0::double, 0.001::double) duration from pl),
c as (select p.*, is_combat_end and line_number = min(case when is_combat_end then line_number end) over (partition by log_path, pull_index) leaves from p),
q as (select *, not leaves and not is_death live, not leaves and is_damage and ability is not null attack, not leaves and is_heal heals from c),
r as (select log_path, pull_index, source name, true is_player, case when attack then amount end dd, null::double dt, null::double da, case when heals then amount end hd, case when heals then overheal end ho, case when live and is_threat_modified then threat_delta end th,
    attack::int att, (attack and avoidance is not null)::int av, (attack and avoidance is null and is_critical)::int cr, heals::int hc, (heals and is_critical)::int hcr,
    (live and is_ability_activate)::int ac, (live and is_interrupted)::int ti, (live and is_hard_cc)::int cc, (live and is_raid_buff_cast)::int rb, 0 de from q
  union all select log_path, pull_index, target, target_is_player, null::double, case when attack then amount end, case when attack then shield_absorbed end, null::double, null::double, null::double, 0, 0, 0, 0, 0, 0, 0, 0, 0, is_death::int from q where is_death or (attack and (amount <> 0 or shield_absorbed <> 0))),
st as (select log_path, pull_index, name, max(is_player::int) = 1 is_player, {", ".join(f"coalesce(sum({a}::decimal(18,2)), 0)::double {b}" for a, b in zip(("dd", "dt", "da", "hd", "ho", "th"), ("damage_done", "damage_taken", "damage_absorbed", "healing_done", "healing_overheal", "threat")))},
  {", ".join(f"sum({a})::bigint {b}" for a, b in zip(("att", "av", "cr", "hc", "hcr", "ac", "ti", "cc", "rb", "de"), ("damage_attempts", "damage_avoided", "damage_crits", "heal_casts", "heal_crits", "ability_casts", "times_interrupted", "cc_casts", "raid_buff_casts", "deaths")))}
  from r group by 1, 2, 3),
ra as (select st.*, duration, damage_done / duration dps, healing_done / duration hps, greatest(healing_done - healing_overheal, 0) / duration ehps, damage_taken / duration dtps, threat / duration tps, 60.0::double * ability_casts / duration apm,
  case when damage_absorbed + damage_taken > 0 then 100 * damage_absorbed / (damage_absorbed + damage_taken) else 0 end mitigation_pct, case when damage_attempts > 0 then 100.0::double * (damage_attempts - damage_avoided) / damage_attempts else 0 end accuracy_pct,
  case when damage_attempts > damage_avoided then 100.0::double * damage_crits / (damage_attempts - damage_avoided) else 0 end crit_pct, case when heal_casts > 0 then 100.0::double * heal_crits / heal_casts else 0 end heal_crit_pct
  from st join pd using (log_path, pull_index))"""


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulls.with_pulls(adapter.events(spark, sf_dir), TIMING)


def split_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written, for queries that read it more than once."""
    return once(split(spark, sf_dir), "split")


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_once(spark, sf_dir)
    return stats.with_rates(stats.entity_stats(rows), pulls.pulls_of(rows))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, as the SQL does."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"{PULLS} select log_path, line_number, pull_index, area_line from p")
def pull_splitting(spark, sf_dir):
    return split(spark, sf_dir).select("log_path", "line_number", "pull_index", "area_line")


@query(f"{PULLS} select * from pd")
def pull_table(spark, sf_dir):
    return pulls.pulls_of(split(spark, sf_dir))


@query(f"{PULLS} select * from pd where is_fight and duration >= {TIMING.sliver / 1000}")
def fight_filter(spark, sf_dir):
    return pulls.fights(pulls.pulls_of(split(spark, sf_dir)), TIMING)


@query(f"{PULLS} select * from st")
def pull_entity_stats(spark, sf_dir):
    return stats.entity_stats(split(spark, sf_dir))


_RATES = ["dps", "hps", "ehps", "dtps", "tps", "apm", "mitigation_pct", "accuracy_pct", "crit_pct", "heal_crit_pct"]


@query(f"{PULLS} select log_path, pull_index, name, is_player, {', '.join(f'round({r}, 6) {r}' for r in _RATES)} from ra")
def pull_entity_rates(spark, sf_dir):
    return rounded(rated(spark, sf_dir).select("log_path", "pull_index", "name", "is_player", *_RATES))


# ---- Parsing and the clock -------------------------------------------------------------------------------------------

_LINE = """'[' || lpad(cast((t_ms // 3600000) % 24 as {S}), 2, '0') || ':' || lpad(cast((t_ms // 60000) % 60 as {S}), 2, '0') || ':' || lpad(cast((t_ms // 1000) % 60 as {S}), 2, '0') || '.' || lpad(cast(t_ms % 1000 as {S}), 3, '0') || '] [@' || source || '#' || cast(100 + k as {S}) || '|(1,2,3,4)|(5/9)] ['
  || case k % 4 when 0 then 'Mob ' || cast(k as {S}) || ' {{99' || cast(k as {S}) || '}}:12|(0,0,0,0)|(' || cast(k as {S}) || '/100)' when 1 then '=' when 2 then '@' || source || '#7/Pet ' || cast(k as {S}) || ' {{55}}:3|(0,0,0,0)|(1/2)' else '@Ally' || cast(k as {S}) || '#8|(0,0,0,0)|(' || cast(k as {S}) || '/100)' end
  || '] [' || case when k % 6 = 0 then '' else 'Skill ' || cast(k as {S}) || ' {{81' || cast(k as {S}) || '}}' end || '] ['
  || case k % 8 when 0 then 'ApplyEffect {{1}}: Damage {{2}}] (' || cast(k * 10 as {S}) || case when k % 3 = 0 then '*' else '' end || ' energy {{3}} -shield {{4}} (' || cast(k as {S}) || ' absorbed {{5}}))'
    when 1 then 'ApplyEffect {{1}}: Heal {{2}}] (' || cast(k as {S}) || '.5* ~' || cast(k as {S}) || ')' when 2 then 'Event {{1}}: Death {{2}}]' when 3 then 'ApplyEffect {{1}}: Deathmark {{2}}]'
    when 4 then 'Event {{1}}: ModifyThreat {{2}}] <-' || cast(k as {S}) || '.25>' when 5 then 'ModifyCharges {{1}}: Shell {{2}}] (' || cast(k as {S}) || ' charges {{3}})'
    when 6 then 'ApplyEffect {{1}}: Damage {{2}}] (0 -dodge {{3}})' else 'AreaEntered {{1}}: Place {{2}} ' || cast(k as {S}) || ' Player Master {{3}}]' end"""
_LOG = "select 'combat_' || cast(user_id % 16 as {S}) log_path, event_id line_number, k, source, t_ms, {line} line from (select event_id, user_id, cast(regexp_extract(props, '[0-9]+', 0) as int) k, 'U' || cast(user_id as {S}) source, {MS} t_ms from events)"
_DUCK_LINES = _LOG.format(line=_LINE.format(S="varchar"), S="varchar", MS="epoch_us(ts)//1000")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the log's grammar, one an event, in sixteen files over many days each."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = raw.selectExpr("'combat_' || cast(user_id % 16 as string) log_path", "event_id line_number", "cast(regexp_extract(props, '[0-9]+', 0) as int) k", "'U' || cast(user_id as string) source", "unix_millis(cast(ts as timestamp)) t_ms")
    return rows.selectExpr("log_path", "line_number", "k", "source", "t_ms", _LINE.format(S="string").replace("//", " div ") + " line")


@query(f"""select line_number, regexp_extract(line, '[0-9][0-9]?:[0-9][0-9]:[0-9][0-9][.][0-9]+', 0) as "timestamp", source, true source_is_player,
  case k % 4 when 0 then 'Mob ' || k when 1 then source when 2 then 'Pet ' || k else 'Ally' || k end target, k % 4 in (1, 3) target_is_player, case k % 4 when 0 then '99' || k when 2 then '55' end target_npc_id,
  case k % 4 when 0 then k::double when 2 then 1::double when 3 then k::double end hp_current, case when k % 6 <> 0 then 'Skill ' || k end ability, case when k % 6 <> 0 then '81' || k end ability_id from ({_DUCK_LINES})""")
def parse_entities(spark, sf_dir):
    rows = parse.parse_events(log_lines(spark, sf_dir))
    return rows.select("line_number", "timestamp", "source", "source_is_player", "target", "target_is_player", "target_npc_id", "hp_current", "ability", "ability_id")


@query(f"""select line_number, k % 8 in (0, 6) is_damage, k % 8 = 1 is_heal, k % 8 = 2 is_death, k % 8 = 7 is_area_entered, k % 8 = 4 is_threat_modified, k % 8 = 5 is_charges_modified,
  case k % 8 when 0 then k * 10.0::double when 1 then k + 0.5::double else 0 end amount, (k % 8 = 0 and k % 3 = 0) or k % 8 = 1 is_critical, case when k % 8 = 1 then k::double else 0 end overheal,
  case when k % 8 = 0 then k::double else 0 end shield_absorbed, case when k % 8 = 6 then 'dodge' end avoidance, case when k % 8 = 4 then -k - 0.25::double else 0 end threat_delta,
  case when k % 8 = 7 then k end group_size, case when k % 8 = 7 then 'master' end difficulty, case when k % 8 = 5 then k end charges from ({_DUCK_LINES})""")
def parse_kinds_and_amounts(spark, sf_dir):
    rows = parse.parse_events(log_lines(spark, sf_dir)).withColumn("charges", F.when(F.col("is_charges_modified"), parse.remaining_charges(F.col("values"))))
    return rows.select("line_number", "is_damage", "is_heal", "is_death", "is_area_entered", "is_threat_modified", "is_charges_modified", "amount", "is_critical", "overheal", "shield_absorbed", "avoidance", "threat_delta", "group_size", "difficulty", "charges")


@query(f"""with d as (select log_path, line_number, t_ms % 86400000 raw from ({_DUCK_LINES})), b as (select *, lag(raw) over (partition by log_path order by line_number) pr from d)
select log_path, line_number, raw + sum(case when pr is null or raw >= pr then 0 when pr - raw > 43200000 then 86400000 else pr - raw end) over (partition by log_path order by line_number)::bigint t_ms from b""")
def log_clock(spark, sf_dir):
    rows = parse.parse_events(log_lines(spark, sf_dir)).withColumn("raw_ms", clock.day_ms(F.col("timestamp")))
    return clock.with_clock(rows, chunk=1 << 18).select("log_path", "line_number", "t_ms")


@query(f"with {DUCK_EV} select log_path, line_number, cast(substr(log_path, 8) as date) session_date, (cast(substr(log_path, 8) as timestamp) + t_ms % 86400000 * interval 1 millisecond) event_time from e")
def session_dates(spark, sf_dir):
    rows = clock.with_event_time(adapter.events(spark, sf_dir).withColumn("t_ms", F.col("t_ms") % 86400000))
    return rows.select("log_path", "line_number", "session_date", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


@query("""with b as (select user_id, event_id, case when epoch_us(ts)//1000 - lag(epoch_us(ts)//1000) over (partition by user_id order by ts) > 7200000 then 1 else 0 end late, ts from events)
select user_id, event_id, sum(late) over (partition by user_id order by ts)::bigint session_index from b""")
def gap_sessions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return pulls.gap_sessions(rows, "user_id", "ms", 7_200_000).select("user_id", "event_id", "session_index")


# ---- Of each pull ----------------------------------------------------------------------------------------------------


@query(f"{PULLS} select log_path, pull_index, source as name, coalesce(ability, effect_name) as key, sum(amount::decimal(18,2))::double total, count(*) hits from q where attack and amount <> 0 group by all")
def damage_by_ability(spark, sf_dir):
    return stats.breakdown(split(spark, sf_dir))


@query(f"{PULLS} select log_path, pull_index, source as name, target as key, sum(amount::decimal(18,2))::double total, count(*) hits from q where heals and amount <> 0 group by all")
def healing_by_target(spark, sf_dir):
    return stats.breakdown(split(spark, sf_dir), "healing", "target")


@query(f"""{PULLS}, t as (select log_path, pull_index, source as name, coalesce(ability, effect_name) as key, sum(amount::decimal(18,2))::double total, count(*) hits from q where attack and amount <> 0 group by all)
select *, row_number() over (partition by log_path, pull_index, name order by total desc, key)::int rank from t qualify rank <= 8""")
def top_abilities(spark, sf_dir):
    return stats.top(stats.breakdown(split(spark, sf_dir)), 8, "log_path", "pull_index", "name")


@query(f"{PULLS} select log_path, pull_index, name, damage_done, row_number() over (partition by log_path, pull_index order by damage_done desc, name)::int rank from st where is_player qualify rank <= 3")
def top_players(spark, sf_dir):
    rows = stats.players_only(stats.entity_stats(split(spark, sf_dir)))
    return stats.top(rows.select("log_path", "pull_index", "name", "damage_done"), 3, "log_path", "pull_index", by="damage_done", tie="name")


@query(f"{PULLS} select log_path, pull_index, name, damage_taken as value, sum(damage_taken::decimal(28,6)) over (partition by log_path, pull_index)::double total, row_number() over (partition by log_path, pull_index order by damage_taken desc, name)::int rank from st where damage_taken > 0")
def leaderboard_taken(spark, sf_dir):
    return stats.leaderboard(stats.entity_stats(split(spark, sf_dir)), "damage_taken")


@query(f"""{PULLS}, b as (select log_path, pull_index, source as name, t_ms // 1000 s, sum(amount::decimal(18,2)) v from q where attack and amount <> 0 group by all),
w as (select *, sum(v) over (partition by log_path, pull_index, name order by s range between 3600 preceding and current row) run from b) select log_path, pull_index, name, round(max(run)::double / 3600, 6) burst from w group by 1, 2, 3""")
def burst_damage(spark, sf_dir):
    return rounded(stats.burst(split(spark, sf_dir), "damage", 3600))


@query(f"{PULLS} select log_path, pull_index, source as name, sum(amount::decimal(18,2))::double boss_damage from q where attack and target in ('B2', 'B5') group by all")
def boss_damage(spark, sf_dir):
    return stats.target_filtered(split(spark, sf_dir), spark.createDataFrame([("B2",), ("B5",)], "name string"))


@query(f"""{PULLS}, g as (select log_path, pull_index, start_ms, duration, least(greatest(duration / 90, 75.0::double), 1500.0::double) width from pd),
pn as (select distinct log_path, pull_index, name from (select log_path, pull_index, source as name from p union all select log_path, pull_index, target from p where target_is_player)),
cells as (select log_path, pull_index, name, unnest(range(0, floor(duration / width)::bigint + 1))::int bucket from pn join g using (log_path, pull_index)),
su as (select log_path, pull_index, source as name, least(floor((t_ms - start_ms) / 1000.0::double / width), floor(duration / width))::int bucket, sum(case when is_damage then amount else 0 end::decimal(18,2)) d, sum(case when is_heal then amount else 0 end::decimal(18,2)) h
  from p join g using (log_path, pull_index) where amount > 0 and ((is_damage and ability is not null) or is_heal) group by all)
select log_path, pull_index, name, bucket, coalesce(d, 0)::double damage, coalesce(h, 0)::double healing from cells left join su using (log_path, pull_index, name, bucket)""")
def pull_timeline(spark, sf_dir):
    rows = split_once(spark, sf_dir)
    return timeline.timeline(rows, pulls.pulls_of(rows), 75)


# ---- Bosses and the archive --------------------------------------------------------------------------------------------

_BOSSES = [("b1", "Alpha", 0, ["702"], ["B2", "U5"]), ("b2", "U1 the Great", 1, [], ["U1", "B5"])]
_BOSS_SQL = """bt(boss_id, boss_name, def_rank, npc, name) as (values ('b1', 'Alpha', 0, '702', null), ('b2', 'U1 the Great', 1, null, 'U1'), ('b2', 'U1 the Great', 1, null, 'B5')),
kn(boss_id, name) as (values ('b1', 'B2'), ('b1', 'U5'), ('b2', 'U1')),
seen as (select log_path, pull_index, line_number, source as name, source_npc_id npc from p union all select log_path, pull_index, line_number, target, target_npc_id from p),
ma as (select log_path, pull_index, bt.boss_id, bt.boss_name, line_number seen_line from seen join bt on bt.npc = seen.npc or (bt.npc is null and bt.name = seen.name) qualify row_number() over (partition by log_path, pull_index order by line_number, def_rank) = 1),
dl as (select log_path, pull_index, target as name, max(line_number) died from p where is_death group by 1, 2, 3),
lf as (select log_path, pull_index, max(coalesce(died < seen_line, true)::int) = 1 alive from ma join kn using (boss_id) left join dl using (log_path, pull_index, name) group by 1, 2),
bd as (select log_path, pull_index, avg(case when is_player then (deaths > 0)::int end) dead, coalesce(sum(deaths) filter (is_player), 0)::bigint player_deaths, coalesce(sum(deaths) filter (not is_player), 0)::bigint npc_deaths, count(*) filter (not is_player) npc_count,
  coalesce(sum(damage_done::decimal(18,2)) filter (not is_player), 0)::double npc_damage from st group by 1, 2),
ix as (select pd.*, boss_id, boss_name, seen_line, player_deaths, npc_deaths, npc_count, npc_damage, case when boss_id is null then 'unknown' when not alive then 'kill' when dead >= 0.5 then 'wipe' else 'reset' end outcome
  from pd left join ma using (log_path, pull_index) left join lf using (log_path, pull_index) left join bd using (log_path, pull_index))"""


def bosses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_BOSSES, "boss_id string, boss_name string, def_rank int, npc_ids array<string>, names array<string>")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_once(spark, sf_dir)
    table = bosses(spark)
    return corpus.outcomes(pulls.pulls_of(rows), rows, corpus.first_match(rows, table), maintenance.kill_names(table), stats.entity_stats(rows))


@query(f"{PULLS}, {_BOSS_SQL} select log_path, pull_index, boss_id, boss_name, seen_line from ma")
def boss_recognition(spark, sf_dir):
    return corpus.first_match(split_once(spark, sf_dir), bosses(spark))


@query(f"{PULLS}, {_BOSS_SQL} select log_path, pull_index, boss_id, outcome, player_deaths, npc_deaths, npc_count, npc_damage from ix")
def pull_outcomes(spark, sf_dir):
    return index(spark, sf_dir).select("log_path", "pull_index", "boss_id", "outcome", "player_deaths", "npc_deaths", "npc_count", "npc_damage")


@query(f"""{PULLS}, {_BOSS_SQL} select boss_id, boss_name, count(*) pulls, count(*) filter (outcome = 'kill') kills, count(*) filter (outcome = 'wipe') wipes, count(*) filter (outcome = 'reset') resets,
  sum(duration::decimal(18,3))::double total_seconds, sum(player_deaths)::bigint deaths, max(duration) longest, list_sort(list(duration))[len(list(duration)) // 2 + 1] median, min(duration) filter (outcome = 'kill') fastest_kill,
  max(duration) filter (outcome = 'kill') slowest_kill, min(log_path) first_seen, max(log_path) last_seen, round(100.0::double * count(*) filter (outcome = 'kill') / count(*), 6) kill_pct from ix where boss_id is not null group by 1, 2""")
def boss_summary(spark, sf_dir):
    return rounded(corpus.boss_summary(index(spark, sf_dir)))


@query(f"{PULLS} select name, count(*) encounters, sum(damage_done::decimal(18,2))::double damage, sum(healing_done::decimal(18,2))::double healing, sum(deaths)::bigint deaths, case when sum(healing_done::decimal(18,2)) > sum(damage_done::decimal(18,2)) then 'healer' else 'damage' end as role from st where is_player group by 1")
def players_seen(spark, sf_dir):
    return corpus.players_seen(stats.entity_stats(split(spark, sf_dir)))


@query(f"{PULLS}, {_BOSS_SQL} select count(distinct log_path) sessions, count(*) encounters, count(boss_id) boss_encounters, count(distinct boss_id) bosses, min(log_path) first_log, max(log_path) last_log, (select count(distinct name) from st where is_player) player_count from ix")
def corpus_overview(spark, sf_dir):
    rows = split_once(spark, sf_dir)
    table = bosses(spark)
    entities = stats.entity_stats(rows)
    found = corpus.outcomes(pulls.pulls_of(rows), rows, corpus.first_match(rows, table), maintenance.kill_names(table), entities)
    return corpus.overview(found, entities)


@query(f"{PULLS} select log_path, name, count(*) pulls, round(avg(dps), 6) mean, round(max(dps), 6) best, round(avg(duration), 6) mean_duration, sum(deaths)::bigint deaths from ra where is_player group by 1, 2")
def nightly_rollup(spark, sf_dir):
    rows = rated(spark, sf_dir).where("is_player").groupBy("log_path", "name")
    return rounded(rows.agg(F.count("*").alias("pulls"), F.avg("dps").alias("mean"), F.max("dps").alias("best"), F.avg("duration").alias("mean_duration"), F.sum("deaths").alias("deaths")))


@query(f"""{PULLS}, o as (select *, (row_number() over (partition by name order by log_path, pull_index) - 1)::double i from ra where is_player), f as (select name, count(*) n, regr_slope(dps, i) slope, regr_intercept(dps, i) ic from o group by 1)
select name, n, round(slope, 5) slope, round(ic, 5) intercept, round(case when ic > 0 then 100 * slope * (n - 1) / ic end, 4) change_pct from f""")
def player_trend_fit(spark, sf_dir):
    fit = corpus.trend(rated(spark, sf_dir).where("is_player"), "dps")
    return fit.select("name", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("change_pct", 4).alias("change_pct"))


@query(f"{PULLS} select name, log_path, pull_index, round(dps, 6) dps, round(avg(dps) over (partition by name order by log_path, pull_index rows between 2 preceding and 4 following), 6) rolling from ra where is_player")
def rolling_trend(spark, sf_dir):
    return rounded(corpus.rolling_mean(rated(spark, sf_dir).where("is_player"), "dps", "name", "log_path", "pull_index").select("name", "log_path", "pull_index", "dps", "rolling"))


@query(f"""{PULLS}, a as (select name, dps, hps from ra where log_path = 'combat_2024-01-02' and pull_index = 1), b as (select name, dps, hps from ra where log_path = 'combat_2024-01-03' and pull_index = 1)
select name, round(coalesce(a.dps, 0), 6) dps_a, round(coalesce(b.dps, 0), 6) dps_b, round(coalesce(a.hps, 0), 6) hps_a, round(coalesce(b.hps, 0), 6) hps_b, round(coalesce(b.dps, 0) - coalesce(a.dps, 0), 6) dps_delta, round(coalesce(b.hps, 0) - coalesce(a.hps, 0), 6) hps_delta from a full join b using (name)""")
def compare_pulls(spark, sf_dir):
    return rounded(corpus.compare(rated(spark, sf_dir), ("combat_2024-01-02", 1), ("combat_2024-01-03", 1)))


@query(f"{PULLS} select log_path, pull_index, round(sum(damage_done::decimal(18,2))::double / any_value(duration), 6) raid_dps, round(sum(healing_done::decimal(18,2))::double / any_value(duration), 6) raid_hps from ra where is_player group by 1, 2")
def raid_rates(spark, sf_dir):
    rows = rated(spark, sf_dir).where("is_player").groupBy("log_path", "pull_index", "duration")
    sums = rows.agg(stats.exact_sum(F.col("damage_done")).alias("d"), stats.exact_sum(F.col("healing_done")).alias("h"))
    return rounded(sums.select("log_path", "pull_index", (F.col("d") / F.col("duration")).alias("raid_dps"), (F.col("h") / F.col("duration")).alias("raid_hps")))


# ---- Deaths, timelines and rotations -----------------------------------------------------------------------------------

_SPAN = 21_600_000  # the adapter's events are minutes apart
_DEATHS = f"""dw as (select h.*, d.line_number death_line, d.t_ms death_ms from p d join p h using (log_path, pull_index, target) where d.is_death and d.target_is_player and not h.is_death and h.t_ms between d.t_ms - {_SPAN} and d.t_ms and h.line_number < d.line_number)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Death windows of the events as :func:`turned` gives them."""
    return forensics.death_windows(turned(split_once(spark, sf_dir)), _SPAN)


def turned(rows: DataFrame) -> DataFrame:
    """The adapter's players hit NPCs and seldom meet; here NPCs hit players, and six players stand for all that are hit or die."""
    c, few = F.col, F.concat(F.lit("U"), F.col("k") % 6)
    return rows.withColumns({
        "source": F.when(c("is_damage"), c("target")).otherwise(c("source")), "source_is_player": c("source_is_player") & ~c("is_damage"),
        "target": F.when(c("is_damage") | c("is_death"), few).otherwise(c("target")), "target_is_player": c("target_is_player") | c("is_damage"),
    })


_TURNED = PULLS.replace("\np as (select e.*, s.pull_index", "\np0 as (select e.*, s.pull_index").replace("\npl as (", """
p as (select * replace (case when is_damage then target else source end as source, source_is_player and not is_damage as source_is_player,
  case when is_damage or is_death then 'U' || (k % 6) else target end as target, target_is_player or is_damage as target_is_player) from p0),
pl as (""")


@query(f"{_TURNED}, {_DEATHS} select log_path, pull_index, target, death_line, line_number, t_ms, death_ms from dw")
def death_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("log_path", "pull_index", "target", "death_line", "line_number", "t_ms", "death_ms")


_KEYED = "kd as (select *, coalesce(ability, effect_name) as key, source as by_ from dw where is_damage and amount > 0)"


@query(f"""{_TURNED}, {_DEATHS}, {_KEYED} select log_path, pull_index, target, death_line, key, sum(amount::decimal(18,2))::double total, count(*) hits, max(amount) biggest, count(distinct source) sources,
  row_number() over (partition by log_path, pull_index, target, death_line order by sum(amount::decimal(18,2)) desc, key)::int rank from kd group by 1, 2, 3, 4, 5 qualify rank <= 12""")
def death_report_by_ability(spark, sf_dir):
    return forensics.death_report(_windows(spark, sf_dir))


@query(f"""{_TURNED}, {_DEATHS}, {_KEYED} select log_path, pull_index, target, death_line, by_ as key, sum(amount::decimal(18,2))::double total, count(*) hits, max(amount) biggest, count(distinct source) sources,
  row_number() over (partition by log_path, pull_index, target, death_line order by sum(amount::decimal(18,2)) desc, by_)::int rank from kd group by 1, 2, 3, 4, 5 qualify rank <= 8""")
def death_report_by_source(spark, sf_dir):
    return forensics.death_report(_windows(spark, sf_dir), "by", 8)


_BLOWS = "kb as (select log_path, pull_index, target, death_line, key ability, by_ killer, amount, sum(amount::decimal(18,2)) over (partition by log_path, pull_index, target, death_line)::double total from kd qualify row_number() over (partition by log_path, pull_index, target, death_line order by line_number desc) = 1)"


@query(f"{_TURNED}, {_DEATHS}, {_KEYED}, {_BLOWS} select * from kb")
def killing_blows(spark, sf_dir):
    return forensics.killing_blows(_windows(spark, sf_dir))


@query(f"{_TURNED}, {_DEATHS}, {_KEYED}, {_BLOWS} select ability, count(*) count from kb group by 1 order by 2 desc, 1 limit 15")
def killing_abilities(spark, sf_dir):
    return forensics.killing_abilities(forensics.killing_blows(_windows(spark, sf_dir)))


@query(f"{_TURNED}, {_DEATHS}, {_KEYED} select log_path, pull_index, target, death_line, line_number, amount, row_number() over (partition by log_path, pull_index, target, death_line order by line_number desc)::int rank from kd qualify rank <= 40")
def last_hits(spark, sf_dir):
    return forensics.last_hits(_windows(spark, sf_dir)).select("log_path", "pull_index", "target", "death_line", "line_number", "amount", "rank")


@query(f"{PULLS} select log_path, pull_index, count(*) deaths, max(t_ms) - min(t_ms) span_ms, count(*) >= 5 and max(t_ms) - min(t_ms) < 3600000 is_wipe from p where is_death and target_is_player group by 1, 2")
def mass_deaths(spark, sf_dir):
    return forensics.mass_deaths(split(spark, sf_dir), 5, 3_600_000)


_COOLDOWNS = [("Shield", "A3", 1_200_000), ("Cloak", "A13", 7_200_000), ("Guard", "A7", 600_000)]


@query(f"""{PULLS}, cd(label, keyword, cooldown_ms) as (values ('Shield', 'A3', 1200000), ('Cloak', 'A13', 7200000), ('Guard', 'A7', 600000)),
us as (select log_path, pull_index, 'U' || (k % 6) target, label, cooldown_ms, t_ms from p join cd on contains(lower(ability), lower(keyword)) where is_ability_activate),
de as (select log_path, pull_index, 'U' || (k % 6) target, line_number death_line, t_ms death_ms from p where is_death and target_is_player)
select log_path, pull_index, target, death_line, death_ms, label, cooldown_ms, max(t_ms) used_ms, death_ms - max(t_ms) since_ms, death_ms - max(t_ms) >= cooldown_ms available, death_ms - max(t_ms) <= 12000 used_in_window
from de join us using (log_path, pull_index, target) where t_ms <= death_ms group by 1, 2, 3, 4, 5, 6, 7""")
def cooldown_availability(spark, sf_dir):
    few = F.concat(F.lit("U"), F.col("k") % 6)  # as players seldom meet in the adapter
    rows = split_once(spark, sf_dir).withColumns({"source": few, "target": F.when(F.col("is_death"), few).otherwise(F.col("target"))})
    return forensics.cooldown_uses(rows, spark.createDataFrame(_COOLDOWNS, "label string, keyword string, cooldown_ms int"))


_SEGMENTS = """bo as (select distinct log_path, pull_index, t_ms begin_ms from p where contains(lower(concat_ws(' ', ability, effect_name)), 'a4')),
sg as (select *, lead(begin_ms) over (partition by log_path, pull_index order by begin_ms) end_ms, row_number() over (partition by log_path, pull_index order by begin_ms)::int segment from bo qualify end_ms is not null),
ins as (select p.*, sg.begin_ms, sg.end_ms, sg.segment from p join sg on p.log_path = sg.log_path and p.pull_index = sg.pull_index and p.t_ms >= sg.begin_ms and p.t_ms < sg.end_ms)"""


@query(f"""{PULLS}, {_SEGMENTS}, su as (select log_path, pull_index, segment, begin_ms, end_ms, source as name, sum(case when is_damage and ability is not null then amount else 0 end::decimal(18,2))::double damage, sum(case when is_heal then greatest(amount - overheal, 0) else 0 end::decimal(18,2))::double healing,
  count(*) filter (is_damage and ability is not null) attacks, count(*) filter (is_damage and ability is not null and is_critical) crits, coalesce(string_agg(ability, ',' order by t_ms, line_number) filter (is_ability_activate), '') casts from ins group by all)
select log_path, pull_index, segment, name, damage, healing, attacks, crits, casts, round(damage / ((end_ms - begin_ms) / 1000.0::double), 6) dps, round(healing / ((end_ms - begin_ms) / 1000.0::double), 6) ehps, round(case when attacks > 0 then 100.0::double * crits / attacks else 0 end, 6) crit_pct from su""")
def rotation_segments(spark, sf_dir):
    return rounded(timeline.rotation(split_once(spark, sf_dir), "A4").drop("begin_ms", "end_ms"))


@query(f"""{PULLS}, {_SEGMENTS.replace("'a4'", "'a1'")}, ac as (select *, t_ms - lag(t_ms) over (partition by log_path, pull_index, segment, k % 3 order by t_ms, line_number) gap_ms from ins where is_ability_activate)
select log_path, pull_index, segment, 'U' || (k % 3) as name, t_ms - 1 at_ms, gap_ms from ac where gap_ms >= 1500""")
def idle_gaps(spark, sf_dir):
    """Three players stand for all, as the adapter's players seldom act twice in a segment."""
    rows = split_once(spark, sf_dir).withColumn("source", F.concat(F.lit("U"), F.col("k") % 3))
    return timeline.idle_gaps(rows, "A1")


@query(f"""{PULLS}, g as (select log_path, pull_index, start_ms, duration, least(greatest(duration / 90, 75.0::double), 1500.0::double) width from pd),
su as (select log_path, pull_index, source as name, least(floor((t_ms - start_ms) / 1000.0::double / width), floor(duration / width))::int bucket, case when is_damage then amount else 0 end d, case when is_heal then amount else 0 end h from p join g using (log_path, pull_index) where amount > 0 and ((is_damage and ability is not null) or is_heal)),
pn as (select distinct log_path, pull_index, name from (select log_path, pull_index, source as name from p union all select log_path, pull_index, target from p where target_is_player))
select log_path, pull_index, name, coalesce(sum(d::decimal(18,2)), 0)::double damage, coalesce(sum(h::decimal(18,2)), 0)::double healing, coalesce(sum(d::decimal(18,2)), 0)::double / 600 dps, coalesce(sum(h::decimal(18,2)), 0)::double / 600 hps from pn left join (select * from su where bucket between 0 and 7) using (log_path, pull_index, name) group by 1, 2, 3""")
def timeline_slice(spark, sf_dir):
    rows = split_once(spark, sf_dir)
    return timeline.slice_(timeline.timeline(rows, pulls.pulls_of(rows), 75), 0, 7, 600.0)


# ---- Rules -----------------------------------------------------------------------------------------------------------


def _thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "B2", 75.0), (2, "B2", 20.0), (3, "B5", 50.0)], "cond_id int, name string, percent double")


@query(f"{PULLS}, ru(cond_id, name, percent) as (values (1, 'B2', 75.0), (2, 'B2', 20.0), (3, 'B5', 50.0)) select log_path, pull_index, cond_id, min(line_number) line_number from p join ru on target = name where hp_max > 0 and 100 * hp_current / hp_max <= percent group by 1, 2, 3")
def hp_thresholds(spark, sf_dir):
    return rules.hp_below(split(spark, sf_dir), _thresholds(spark))


@query(f"{PULLS} select log_path, pull_index, target as name, min(line_number) first_line from p where not target_is_player group by 1, 2, 3")
def npc_first_seen(spark, sf_dir):
    return rules.npc_appears(split(spark, sf_dir))


@query(f"""{PULLS} select log_path, pull_index, line_number, last_value(case when target = 'B2' then 100 * hp_current / hp_max end ignore nulls) over w boss_hp, last_value(case when source = 'U1' then target end ignore nulls) over w boss_target from p
window w as (partition by log_path, pull_index order by line_number rows between unbounded preceding and current row)""")
def boss_state_as_of(spark, sf_dir):
    return rules.latest_hp(split(spark, sf_dir), "B2", "U1").select("log_path", "pull_index", "line_number", "boss_hp", "boss_target")


@query(f"""{PULLS}, x as (select *, case when k % 13 = 0 then 0 when k % 3 = 0 then 1 when k % 7 = 0 then -1 else 0 end d, sum((k % 13 = 0)::int) over (partition by log_path, pull_index order by line_number) era from p),
y as (select *, (2 + sum(d) over (partition by log_path, pull_index, era order by line_number))::bigint counter from x) select log_path, pull_index, line_number, counter, counter <> coalesce(lag(counter) over (partition by log_path, pull_index order by line_number), 2) changed from y""")
def counters(spark, sf_dir):
    k = F.col("k")
    rows = rules.counters(split(spark, sf_dir), k % 3 == 0, (k % 7 == 0) & (k % 3 != 0), k % 13 == 0, 2)
    return rows.select("log_path", "pull_index", "line_number", "counter", "changed")


_TREE = [
    (1, None, "any_of", None), (2, 1, "ability_cast", "a1"), (3, 1, "all_of", None), (4, 3, "effect_applied", "WARD"), (5, 3, "not", None), (6, 5, "effect_removed", "ward"),
    (7, None, "entity_death", "U7"), (8, None, "combat_start", None), (9, None, "effect_removed", "ard"), (10, None, "all_of", None),
]


_TREE_SQL = """lv as (select *, is_ability_activate and contains(lower(coalesce(ability, '')), 'a1') c2, not is_effect_removed and contains(lower(coalesce(effect_name, '')), 'ward') c4,
  is_effect_removed and contains(lower(coalesce(effect_name, '')), 'ward') c6, is_effect_removed and contains(lower(coalesce(effect_name, '')), 'ard') c9 from p),
cs as (select log_path, pull_index, line_number, unnest([case when c2 or (c4 and not c6) then 1 end, case when c2 then 2 end, case when c4 and not c6 then 3 end, case when c4 then 4 end,
  case when not c6 then 5 end, case when c6 then 6 end, case when is_death and target = 'U7' then 7 end, case when is_combat_start then 8 end, case when c9 then 9 end]) cond_id from lv)"""


@query(f"{PULLS}, {_TREE_SQL} select log_path, pull_index, line_number, cond_id from cs where cond_id is not null")
def condition_tree(spark, sf_dir):
    return rules.composed(split(spark, sf_dir), spark.createDataFrame(_TREE, "cond_id int, parent_id int, type string, keyword string"))


# The adapter has no difficulties; a log's day of the month stands for one, unknown on every fifth day.
@query(f"""{PULLS}, dy as (select *, case when day(log_path[8:]::date) % 5 <> 0 then case day(log_path[8:]::date) % 3 when 0 then 'story' when 1 then 'veteran' else 'master' end end difficulty from p),
sc(rule_id, difficulties) as (values (1, []::varchar[]), (2, ['veteran', 'master']), (3, ['story']))
select rule_id, log_path, count(*) n from dy join sc on len(difficulties) = 0 or difficulty is null or list_contains(difficulties, difficulty) group by 1, 2""")
def scope_gates(spark, sf_dir):
    day = F.dayofmonth(F.substr("log_path", F.lit(8)).cast("date"))
    rows = split(spark, sf_dir).withColumn("difficulty", F.when(day % 5 != 0, F.element_at(F.array(F.lit("story"), F.lit("veteran"), F.lit("master")), day % 3 + 1)))
    table = spark.createDataFrame([(1, []), (2, ["veteran", "master"]), (3, ["story"])], "rule_id int, difficulties array<string>")
    return rules.scoped(rows, table, "difficulties", "difficulty").groupBy("rule_id", "log_path").agg(F.count("*").alias("n"))


_RULES = [(1, "Poison", "a3", True, 1_800_000, 300_000), (2, "Mend", "heal", True, 3_600_000, 600_000)]
_RULE_SQL = """kr(rule_id, keyword, duration_ms, warn_ms) as (values (1, 'a3', 1800000, 300000), (2, 'heal', 3600000, 600000)),
kh as (select p.*, kr.* from p join kr on contains(lower(concat_ws(' ', ability, effect_name)), keyword) where not is_ability_activate and effect_type not in ('RemoveEffect', 'ModifyCharges')),
dd as (select log_path, pull_index, target, t_ms died from p where is_death),
ti as (select log_path, pull_index, rule_id, target, line_number, t_ms start_ms, duration_ms, warn_ms, lead(t_ms) over (partition by log_path, pull_index, rule_id, target order by t_ms, line_number) nx from kh),
tj as (select ti.log_path, ti.pull_index, rule_id, ti.target, line_number, start_ms, least(start_ms + any_value(duration_ms), coalesce(any_value(nx), 9e18::bigint), coalesce(min(died), 9e18::bigint)) end_ms, start_ms + any_value(duration_ms) - any_value(warn_ms) wm
  from ti left join dd on dd.log_path = ti.log_path and dd.pull_index = ti.pull_index and dd.target = ti.target and died >= start_ms group by 1, 2, 3, 4, 5, 6),
tv as (select log_path, pull_index, rule_id, target, line_number, start_ms, end_ms, case when wm < end_ms then wm end warn_at_ms from tj)"""


def _intervals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = split_once(spark, sf_dir)
    table = spark.createDataFrame(_RULES, "rule_id int, label string, keyword string, when_applied boolean, duration_ms long, warn_ms long")
    return rules.timer_intervals(rules.keyword_hits(rows, table), rows), rows


@query(f"{PULLS}, {_RULE_SQL} select log_path, pull_index, rule_id, line_number from kh")
def keyword_rule_hits(spark, sf_dir):
    table = spark.createDataFrame(_RULES, "rule_id int, label string, keyword string, when_applied boolean, duration_ms long, warn_ms long")
    return rules.keyword_hits(split(spark, sf_dir), table).select("log_path", "pull_index", "rule_id", "line_number")


@query(f"{PULLS}, {_RULE_SQL} select * from tv")
def countdown_intervals(spark, sf_dir):
    return _intervals(spark, sf_dir)[0].select("log_path", "pull_index", "rule_id", "target", "line_number", "start_ms", "end_ms", "warn_at_ms")


@query(f"{PULLS}, {_RULE_SQL} select log_path, pull_index, rule_id, target, line_number, n nth, start_ms + n * 60000 fires_ms from tv, unnest(range(0, 3)) u(n)")
def repeated_timers(spark, sf_dir):
    rows = _intervals(spark, sf_dir)[0].withColumns({"times": F.lit(2), "every": F.lit(60_000)})
    return rules.repeats(rows, "times", "every").select("log_path", "pull_index", "rule_id", "target", "line_number", "nth", "fires_ms")


@query(f"""{PULLS}, {_RULE_SQL}, ol as (select *, max(end_ms) over (partition by log_path, pull_index, rule_id, target order by start_ms, end_ms rows between unbounded preceding and 1 preceding) reach from tv),
cv as (select log_path, pull_index, rule_id, target, sum(greatest(end_ms - greatest(start_ms, coalesce(reach, start_ms)), 0))::bigint covered_ms from ol group by 1, 2, 3, 4)
select log_path, pull_index, rule_id, target, covered_ms, round(least(100.0::double * covered_ms / 1000 / duration, 100), 6) uptime_pct from cv join pd using (log_path, pull_index)""")
def buff_uptime(spark, sf_dir):
    found, rows = _intervals(spark, sf_dir)
    return rounded(rules.uptime(found, pulls.pulls_of(rows)).drop("duration"))


@query(f"""{PULLS}, st0 as (select log_path, pull_index, 't1' timer_id, t_ms at_ms from p where is_combat_start), ch(timer_id, next_id, delay_ms) as (values ('t1', 't2', 5000), ('t2', 't3', 7000), ('t2', 't4', 9000))
select * from st0 union all select log_path, pull_index, next_id, at_ms + delay_ms from st0 join ch using (timer_id)
union all select log_path, pull_index, b.next_id, at_ms + a.delay_ms + b.delay_ms from st0 join ch a using (timer_id) join ch b on b.timer_id = a.next_id""")
def chained_timers(spark, sf_dir):
    starts = split(spark, sf_dir).where("is_combat_start").select("log_path", "pull_index", F.lit("t1").alias("timer_id"), F.col("t_ms").alias("at_ms"))
    return rules.chained(starts, spark.createDataFrame([("t1", "t2", 5000), ("t2", "t3", 7000), ("t2", "t4", 9000)], "timer_id string, next_id string, delay_ms int"))


def _taunt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter's casts of A1 as taunts on oneself and its healing as their effects."""
    rows = split_once(spark, sf_dir)
    cast = F.col("is_ability_activate") & (F.col("k") % 3 == 1)
    return rows.withColumns({"ability": F.when(cast, F.lit("Taunt")).otherwise(F.col("ability")), "target": F.when(cast, F.col("source")).otherwise(F.col("target")), "effect_name": F.when(F.col("is_heal"), F.lit("Taunt")).otherwise(F.col("effect_name"))})


@query(f"""{PULLS}, tr as (select log_path, pull_index, source, line_number, t_ms, target, is_ability_activate and k % 3 = 1 c from p where (is_ability_activate and k % 3 = 1) or is_heal),
tn as (select *, sum(c::int) over w nc, last_value(case when c then t_ms end ignore nulls) over w ct from tr window w as (partition by log_path, pull_index, source order by line_number)),
th as (select *, row_number() over (partition by log_path, pull_index, source, nc, not c and coalesce(t_ms - ct <= 7200000, false) order by line_number) = 1 and not c and coalesce(t_ms - ct <= 7200000, false) hit from tn),
tg as (select *, sum(coalesce(t_ms - pt >= 3600000, true)::int) over (partition by log_path, pull_index, source order by line_number) g from (select *, lag(t_ms) over (partition by log_path, pull_index, source order by line_number) pt from th where not c and not hit))
select a.log_path, a.pull_index, a.source, coalesce(h.t_ms, a.t_ms) at_ms, 'single' kind, h.target is not null hit, coalesce(h.target, '') targets from th a left join th h on h.log_path = a.log_path and h.pull_index = a.pull_index and h.source = a.source and h.nc = a.nc and h.hit where a.c
union all select log_path, pull_index, source, max(t_ms), 'aoe', true, array_to_string(list_sort(list_distinct(list(target))), ',') from tg group by log_path, pull_index, source, g""")
def taunt_results(spark, sf_dir):
    return rules.taunts(_taunt_rows(spark, sf_dir), None, 7_200_000, 3_600_000)


# The first phase needs nothing, the second the first: a pull enters p1 at its first row at 75 %, p2 at the first at 20 % no earlier.
@query(f"""{PULLS}, ru(cond_id, name, percent) as (values (1, 'B2', 75.0), (2, 'B2', 20.0), (3, 'B5', 50.0)),
hb as (select log_path, pull_index, cond_id, min(line_number) line_number from p join ru on target = name where hp_max > 0 and 100 * hp_current / hp_max <= percent group by 1, 2, 3),
ht as (select hb.*, t_ms, row_number() over (partition by hb.log_path, hb.pull_index order by hb.line_number, cond_id) rn from hb join p using (log_path, pull_index, line_number)),
hs as (select log_path, pull_index, rn, line_number, t_ms, case when cond_id <> 2 then 'p' || cond_id end phase, cond_id <> 2 moved from ht where rn = 1
  union all select h.log_path, h.pull_index, h.rn, h.line_number, h.t_ms, case when h.cond_id <> 2 or s.phase = 'p1' then 'p' || h.cond_id else s.phase end, h.cond_id <> 2 or coalesce(s.phase = 'p1', false)
  from hs s join ht h on h.log_path = s.log_path and h.pull_index = s.pull_index and h.rn = s.rn + 1)
select log_path, pull_index, phase, line_number, t_ms from hs where moved""")
def phase_changes(spark, sf_dir):
    rows = split_once(spark, sf_dir)
    rows = rows.join(rules.hp_below(rows, _thresholds(spark)), ["log_path", "pull_index", "line_number"])
    triggers = rows.select("log_path", "pull_index", "line_number", "t_ms", F.col("cond_id").alias("ord"), F.concat(F.lit("p"), F.col("cond_id")).alias("phase"), F.when(F.col("cond_id") == 2, "p1").alias("after"))
    return rules.phase_changes(triggers)


# ---- Maintenance -------------------------------------------------------------------------------------------------------


@query(f"with {DUCK_EV} select line_number, source, target from e where log_path = 'combat_2024-01-05' and line_number between 1400 and 1500")
def line_range_scan(spark, sf_dir):
    return maintenance.line_slice(adapter.events(spark, sf_dir), "combat_2024-01-05", 1400, 1500).select("line_number", "source", "target")


_STORED = "sp as (select log_path || '/' || pull_index stored_id, log_path, start_line + 1 start_line, end_line + 2 end_line, pull_index, is_fight, duration, case when pull_index % 3 = 0 then 1 else 2 end data_version from pd)"


def _stored(spark: SparkSession, sf_dir: str, shift: int = 1) -> tuple[DataFrame, DataFrame]:
    found = once(pulls.pulls_of(split(spark, sf_dir)), "pulls")
    stored = found.selectExpr("log_path || '/' || pull_index stored_id", "log_path", f"start_line + {shift} start_line", f"end_line + {2 * shift} end_line", "pull_index", "duration", "case when pull_index % 3 = 0 then 1 else 2 end data_version")
    return stored, found


@query(f"{PULLS}, {_STORED} select stored_id, pointer.line_number from sp join e pointer on pointer.log_path = sp.log_path and pointer.line_number between sp.start_line and sp.end_line")
def events_at_pointers(spark, sf_dir):
    pointers = _stored(spark, sf_dir)[0].select("stored_id", "log_path", "start_line", "end_line")
    return maintenance.at_pointers(adapter.events(spark, sf_dir), pointers).select("stored_id", "line_number")


@query(f"{PULLS}, {_STORED} select stored_id, pd.pull_index derived_index, pd.start_ms derived_start_ms from sp join pd on pd.log_path = sp.log_path and sp.start_line <= pd.end_line and sp.end_line >= pd.start_line qualify row_number() over (partition by stored_id order by pd.start_line) = 1")
def overlap_backfill(spark, sf_dir):
    return maintenance.overlapping(*_stored(spark, sf_dir)).select("stored_id", "derived_index", "derived_start_ms")


@query(f"{PULLS} select log_path, pull_index, case when line_sum % 2 = 0 then 'duplicate' when not is_fight then 'sliver' else 'imported' end status from (select *, start_line + end_line line_sum from pd)")
def import_dedup(spark, sf_dir):
    """History knows each pull; of every other one its file is another, so that it counts as new."""
    stored, found = _stored(spark, sf_dir, 0)
    known = stored.withColumn("log_path", F.when((F.col("start_line") + F.col("end_line")) % 2 == 0, F.col("log_path")).otherwise("elsewhere"))
    return maintenance.import_status(found, known).select("log_path", "pull_index", "status")


@query(f"""{PULLS}, fi as (select *, case when pull_index % 3 <> 0 then 'current' when pull_index % 4 = 3 or pull_index % 7 = 3 then 'unverified' when is_fight then 'rebuilt' else 'dropped' end status from pd),
da as (select log_path, pull_index, sum(amount::decimal(18,2))::double damage from p where is_damage and ability is not null and amount > 0 group by 1, 2)
select log_path || '/' || pull_index stored_id, status, case when status = 'rebuilt' then duration else -1 end duration, case when status in ('rebuilt', 'dropped') then damage end damage, case when status = 'rebuilt' then 2 when pull_index % 3 = 0 then 1 else 2 end data_version, status = 'unverified' unverified from fi left join da using (log_path, pull_index)""")
def versioned_rebuild(spark, sf_dir):
    """Every pull as history has it: a third of an old version, some whose log is gone and some found unverified before."""
    stored, _ = _stored(spark, sf_dir, 0)
    old = stored.withColumns({"log_path": F.when(F.col("pull_index") % 4 == 3, "gone").otherwise(F.col("log_path")), "duration": F.lit(-1.0), "unverified": (F.col("pull_index") % 7 == 3) & (F.col("data_version") == 1)})
    return maintenance.rebuilt(old.drop("pull_index"), adapter.events(spark, sf_dir), 2).select("stored_id", "status", "duration", "damage", "data_version", "unverified")


@query(f"with {DUCK_EV}, u as (select 0 file_rank, * from e union all select 1, * replace (case when k % 2 = 0 then amount else amount + 1 end as amount) from e), t as (select * from u qualify row_number() over (partition by t_ms // 60000, source, target, ability, effect_name, amount order by file_rank, line_number) = 1) select line_number, file_rank from t")
def merged_logs(spark, sf_dir):
    rows = adapter.events(spark, sf_dir).withColumn("timestamp", F.floor(F.col("t_ms") / 60000))
    both = rows.withColumn("file_rank", F.lit(0)).unionByName(rows.withColumns({"file_rank": F.lit(1), "amount": F.when(F.col("k") % 2 == 0, F.col("amount")).otherwise(F.col("amount") + 1)}))
    return maintenance.merged(both).select("line_number", "file_rank")


@query(f"with {DUCK_EV}, f as (select log_path, source, min(line_number) m from e group by 1, 2), n as (select log_path, source, row_number() over (partition by log_path order by m) r from f) select log_path, line_number, 'hit by @Player' || r || '#' || lpad(r::varchar, 8, '0') || ' at [B1]' line from e join n using (log_path, source)")
def anonymised_lines(spark, sf_dir):
    rows = adapter.events(spark, sf_dir).select("log_path", "line_number", F.concat(F.lit("hit by @"), "source", F.lit("#77 at [B1]")).alias("line"))
    return maintenance.anonymised(rows)


@query(f"with {DUCK_EV} select log_path, max(line_number) filter (is_area_entered) area_line, coalesce(arg_max(source, line_number) filter (is_area_entered), arg_min(source, line_number)) local_player from e group by 1")
def local_players(spark, sf_dir):
    return corpus.local_players(adapter.events(spark, sf_dir))


@query(f"with {DUCK_EV} select distinct name from (select source as name from e union all select target from e where target_is_player)")
def player_names(spark, sf_dir):
    rows = adapter.events(spark, sf_dir)
    return rows.select(F.col("source").alias("name")).unionByName(rows.where("target_is_player").select(F.col("target").alias("name"))).distinct()
