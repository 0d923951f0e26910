"""The given ``events`` table as combat-log events, as one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.pulls import Timing

#: The table's events are minutes apart, so the game's seconds are taken as 75 times as long.
TIMING = Timing(gap=600_000, trailing=300_000, enter=2_250_000, sliver=375_000)

EV = """
b0 as (select *, cast(regexp_extract(props, '[0-9]+', 0) as int) k from events),
ev as (select 'combat_' || cast(cast(ts as date) as {S}) log_path, event_id line_number, {MS} t_ms,
  'U' || cast(user_id as {S}) source, true source_is_player, cast(null as {S}) source_npc_id,
  case when event_type = 'error' then 'U' || cast((user_id + k) % 150 as {S}) else 'B' || cast(k % 7 as {S}) end target,
  event_type = 'error' target_is_player, case when event_type <> 'error' then '70' || cast(k % 7 as {S}) end target_npc_id,
  case when event_type <> 'error' then cast((event_id * 37) % 1000 as double) end hp_current, case when event_type <> 'error' then cast(1000 as double) end hp_max,
  case when event_type = 'purchase' and k % 17 = 0 then cast(null as {S}) else 'A' || cast(k % 20 as {S}) end ability,
  '81' || cast(k % 20 as {S}) ability_id, case when event_type in ('purchase', 'click') then 'ApplyEffect'
    when event_type = 'view' and k % 11 in (3, 4, 5, 6) then case k % 11 when 3 then 'RemoveEffect' when 5 then 'ModifyCharges' else 'ApplyEffect' end else 'Event' end effect_type,
  case event_type when 'purchase' then 'Damage' when 'click' then 'Heal' when 'error' then 'Death'
    when 'signup' then case when k % 5 = 0 then 'EnterCombat' else 'AbilityActivate' end
    else case when k % 11 in (3, 4, 5, 6) then 'Ward' when k % 10 = 0 then 'ExitCombat' when k % 9 = 0 then 'ModifyThreat' when k % 7 = 0 then 'AbilityInterrupt' when k % 50 = 1 then 'AreaEntered' else 'AbilityActivate' end end effect_name,
  case when event_type in ('purchase', 'click') then cast(cast(value as decimal(18,2)) as double) else 0e0 end amount,
  event_type in ('purchase', 'click') and k % 4 = 0 is_critical,
  case when event_type = 'click' and k % 3 = 0 then cast(floor(value * 25) as double) / 100 else 0e0 end overheal,
  case when event_type = 'purchase' and k % 5 = 0 then cast(floor(value * 50) as double) / 100 else 0e0 end shield_absorbed,
  case when event_type = 'purchase' and k % 11 = 0 then 'dodge' end avoidance,
  k, event_type from b0),
e as (select *, effect_name = 'Damage' is_damage, effect_name = 'Heal' is_heal, effect_name = 'Death' is_death, effect_name = 'EnterCombat' is_combat_start,
  effect_name = 'ExitCombat' is_combat_end, effect_name = 'AreaEntered' is_area_entered,
  effect_type = 'RemoveEffect' is_effect_removed, effect_type = 'ModifyCharges' is_charges_modified, case when effect_type = 'ModifyCharges' then k % 8 end charges, effect_name = 'AbilityActivate' is_ability_activate,
  effect_name = 'ModifyThreat' is_threat_modified, effect_name = 'AbilityInterrupt' is_interrupted, effect_name = 'AbilityActivate' and k % 12 = 2 is_hard_cc,
  effect_name = 'AbilityActivate' and k % 10 = 3 is_raid_buff_cast, case when effect_name = 'ModifyThreat' then cast(k - 40 as double) else 0e0 end threat_delta from ev)
"""
SPARK_EV = EV.format(S="string", MS="unix_millis(cast(ts as timestamp))")
DUCK_EV = EV.format(S="varchar", MS="epoch_us(ts)//1000")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(f"with {SPARK_EV.replace('from events', 'from {events}')} select * from e", events=raw)
