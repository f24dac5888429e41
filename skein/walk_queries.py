"""Registered queries of walks over the events of users: with and without replay, from held-out starts, and repeated reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import walks
from skein.queries import query, r6

STEPS, READS = 6, 12


def chains(t) -> DataFrame:
    """Users as chains of surfaces: the kind of an event and its value in tens."""
    surface = F.concat_ws(" ", "event_type", F.floor(F.col("value") / 10).cast("string"))
    return t("events").select(F.col("user_id").alias("chain"), F.struct("ts", "event_id").alias("pos"), surface.alias("surface"))


def kind(c) -> F.Column:
    return F.substring_index(c, " ", 1)


def as_many(t) -> DataFrame:
    """As many walks as there are users."""
    return t("events").select(F.col("user_id").alias("walk")).distinct()


def _sql(seed: int, exclude: bool, heldout: bool) -> str:
    """Walks in SQL: one level of the recursion for each step."""
    kernel, seeds = ("where user_id % 2 = 0", "where user_id % 2 = 1") if heldout else ("", "")
    own = "and c.chain <> w.source" if exclude else ""
    draw = f"('0x' || substr(md5(concat('{seed}:', walk, ':', step)), 1, 8))::bigint"
    return f"""e as (select user_id as chain, row_number() over (partition by user_id order by ts, event_id) as pos, concat(event_type, ' ', floor(value / 10)::bigint) as surface, user_id from events),
 f as (select chain, pos, surface, lead(surface) over (partition by chain order by pos) as next from e {kernel}),
 s as (select chain, next, row_number() over (order by chain % 64, chain) - 1 as place, count(*) over () as n from (select chain, min_by(surface, pos) as next from e {seeds} group by chain)),
 c as (select *, string_split(surface, ' ')[1] as kind from f where next is not null),
 w as (
  select walk, 0 as step, next as surface, chain as source, [next] as path, [3] as levels from (select walk, 0 as step, {draw} as d from (select distinct user_id as walk from events)) x join s on s.place = d % s.n
  union all
  select walk, step + 1, case level when 3 then again.next else hit.next end, case level when 3 then again.chain else hit.chain end, path || [case level when 3 then again.next else hit.next end], levels || [level]
  from (select w.walk, w.step, w.path, w.levels, ex, ro, case when len(ex) > 0 then 1 when len(ro) > 0 then 2 else 3 end as level, case when len(ex) > 0 then ex[1 + d % len(ex)] when len(ro) > 0 then ro[1 + d % len(ro)] end as hit, d
        from (select w.*, {draw.replace("':', step", "':', step + 1")} as d,
          (select coalesce(list(struct_pack(chain := c.chain, next := c.next) order by c.chain % 64, c.chain, c.pos), []) from c where c.surface = w.surface {own}) as ex,
          (select coalesce(list(struct_pack(chain := c.chain, next := c.next) order by c.chain % 64, c.chain, c.pos), []) from c where c.kind = string_split(w.surface, ' ')[1] {own}) as ro from w where step < {STEPS - 1}) w) y
  join s again on again.place = d % again.n)"""


def _walked(t, seed: int, exclude: bool, heldout: bool) -> DataFrame:
    c = chains(t)
    k = walks.kernel(c.filter("chain % 2 = 0"), kind, c.filter("chain % 2 = 1")) if heldout else walks.kernel(c, kind)
    return walks.walk(k, as_many(t), STEPS, seed, exclude)


def _path(df: DataFrame) -> DataFrame:
    return df.select("walk", F.array_join("path", " > ").alias("path"), F.array_join(F.transform("levels", lambda x: x.cast("string")), "").alias("levels"))


_PATH_SQL = f"select walk, array_to_string(path, ' > ') as path, array_to_string(levels, '') as levels from w where step = {STEPS - 1}"


@query(f"with recursive {_sql(5, False, False)} {_PATH_SQL}")
def walks_replay(t):
    """Walks over the successors of all users."""
    return _path(_walked(t, 5, False, False))


@query(f"with recursive {_sql(6, True, False)} {_PATH_SQL}")
def walks_without_replay(t):
    """Walks that never take a successor from the user who supplied the last one."""
    return _path(_walked(t, 6, True, False))


@query(f"with recursive {_sql(7, False, True)}, l as (select unnest(levels[2:]) as level from w where step = {STEPS - 1}) select level, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from l group by level")
def walks_heldout(t):
    """Which level of the ladder finds the steps of walks that begin at other users than the kernel's."""
    return walks.ladder(_walked(t, 7, False, True)).withColumn("share", r6("share"))


@query(f"""with recursive {_sql(8, True, False)}, p as (select walk % {READS} as read, path from w where step = {STEPS - 1}), l as (select unnest([1, 2]) as lag), i as (select unnest(range(1, {STEPS})) as i),
 x as (select read, lag, avg(len(list_intersect(string_split(path[i], ' '), string_split(path[i + lag], ' ')))) as overlap from p, l, i where i + lag <= {STEPS} group by read, lag)
 select read, lag, round(overlap, 6) as overlap from x""")
def matched_reads(t):
    """Overlap one and two steps apart in each of several reads of equally many walks."""
    walked = _walked(t, 8, True, False)
    return walks.lag_overlaps(walked, lambda s: F.array_distinct(F.split(s, " ")), 2, F.col("walk") % READS).withColumn("overlap", r6("overlap"))
