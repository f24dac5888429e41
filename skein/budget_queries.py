"""Registered queries of choices within a budget: conversations to a row target, mixed to a dose, and held out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import budget
from skein.queries import query


def sizes(t) -> DataFrame:
    """Conversations with their turns; the first pool is that of every third one."""
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))


def _target(t) -> int:
    """Two fifths of all turns."""
    return int(t("conversations").count() * 2 // 5)


_ORDER = "('0x' || substr(md5(concat('{0}:', conv_id)), 1, 12))::bigint"
_ITEMS = "c as (select conv_id, count(*) as turns from conversations group by conv_id), b as (select count(*) * 2 // 5 as budget from conversations)"


@query(f"""with recursive {_ITEMS}, o as (select *, row_number() over (order by {_ORDER.format(3)}, conv_id) as i from c),
 g as (select 0::bigint as i, 0::bigint as total, null::bigint as conv_id, 0::bigint as turns, false as kept union all
  select o.i, g.total + case when g.total + o.turns <= budget then o.turns else 0 end, o.conv_id, o.turns, g.total + o.turns <= budget from g join o on o.i = g.i + 1, b)
 select conv_id, turns from g where kept""")
def row_target(t):
    """Conversations whose turns come as near to a target as the greedy choice allows."""
    return budget.take(sizes(t), "conv_id", "turns", _target(t), 3)


@query(f"""with recursive {_ITEMS}, o as (select *, conv_id % 3 = 0 as first, row_number() over (partition by conv_id % 3 = 0 order by {_ORDER.format(4)}, conv_id) as i from c),
 n as (select count(*) filter (first) as nf, count(*) filter (not first) as ns from o),
 g as (select 1::bigint as f, 1::bigint as s, 0::bigint as got, 0::bigint as total, null::bigint as conv_id, 0::bigint as turns, false as kept union all
  select g.f + o.first::int, g.s + (not o.first)::int, g.got + case when o.first and g.total + o.turns <= budget then o.turns else 0 end, g.total + case when g.total + o.turns <= budget then o.turns else 0 end, o.conv_id, o.turns, g.total + o.turns <= budget
  from g, b, n join o on o.first = (case when g.f > nf then false when g.s > ns then true else g.got < 0.3 * (g.total + 1) end) and o.i = case when o.first then g.f else g.s end)
 select conv_id, turns, conv_id % 3 = 0 as steered from g where kept""")
def dosed_target(t):
    """Conversations of two pools up to a target, three tenths of the turns from the first pool at every step."""
    return budget.mix(sizes(t), "conv_id", "turns", F.col("conv_id") % 3 == 0, _target(t), 0.3, 4).withColumn("steered", F.col("conv_id") % 3 == 0)


@query(f"""with recursive {_ITEMS} select conv_id, turns from c where conv_id not in (select conv_id from conversations where text like '%?%') and turns >= 3 order by {_ORDER.format(5)}, conv_id limit 20""")
def held_out_choice(t):
    """the first twenty conversations of three turns or more, in a seeded order, among those without a question."""
    asked = t("conversations").filter(F.col("text").contains("?")).select("conv_id")
    return budget.held_out(sizes(t), asked, "conv_id", "turns", 3, 20, 5)
