"""Registered queries of drift between clouds of documents, with intervals over pairs and power of clustered tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import drift
from skein.operators.settle import settled
from skein.queries import TOK, query, r6

#: a document as a point: its words, as a logarithm, and the share of different ones
POINTS_SQL = f"""words as (select doc_id, source, {TOK.format('text')} as w from documents),
 pts as (select source, case when doc_id // 20 % 2 = 0 then 'live' else 'yoked' end as arm, ln(len(w)) as x, len(list_distinct(w)) / len(w) as y from words where len(w) >= 8),
 m as (select arm, source, count(*) as n, avg(x) as mx, avg(y) as my, var_samp(x) as vx, var_samp(y) as vy, covar_samp(x, y) as c from pts group by all having count(*) >= 3),
 s as (select stddev_samp(mx) as sx, stddev_samp(my) as sy from m where arm = 'live'),
 d as (select a.arm, a.source as a, b.source as b, ((a.mx - b.mx) / sx) ** 2 + ((a.my - b.my) / sy) ** 2 as mean_term,
   greatest(a.vx / sx ** 2 + a.vy / sy ** 2 + b.vx / sx ** 2 + b.vy / sy ** 2 - 2 * sqrt(greatest(a.vx * b.vx / sx ** 4 + 2 * a.c * b.c / (sx * sy) ** 2 + a.vy * b.vy / sy ** 4
    + 2 * sqrt(greatest((a.vx * a.vy - a.c ** 2) * (b.vx * b.vy - b.c ** 2) / (sx * sy) ** 4, 0)), 0)), 0) as spread_term
  from m a join m b on a.arm = b.arm and a.source < b.source, s),
 w as (select *, sqrt(mean_term + spread_term) as w2 from d),
 pairs as (select l.a, l.b, l.w2 as live_w2, l.mean_term as live_mean_term, l.spread_term as live_spread_term, y.w2 as yoked_w2, y.mean_term as yoked_mean_term, y.spread_term as yoked_spread_term,
  l.w2 - y.w2 as delta, l.mean_term - y.mean_term as delta_mean_term, l.spread_term - y.spread_term as delta_spread_term from w l join w y using (a, b) where l.arm = 'live' and y.arm = 'yoked')"""


def document_pairs(t) -> DataFrame:
    words = F.col("w")
    d = t("documents").select("source", F.when(F.floor(F.col("doc_id") / 20) % 2 == 0, "live").otherwise("yoked").alias("arm"), tx.tokens("text").alias("w")).filter(F.size("w") >= 8)
    points = d.select("source", "arm", F.array(F.log(F.size(words)), F.size(F.array_distinct(words)) / F.size(words)).alias("p"))
    # one row for each arm and source, from one reading of the texts
    clouds = settled(drift.moments(points, ["arm", "source"], "p", 2))
    live, yoked = (clouds.filter(F.col("arm") == a) for a in ("live", "yoked"))
    names = settled(t("documents").select("source").distinct())
    # pairs of sources, of which an experiment has a few
    pairs = names.select(F.col("source").alias("a")).join(names.select(F.col("source").alias("b")), F.col("a") < F.col("b"))
    scale = drift.axis_scale(live)
    return drift.arm_delta(*(drift.pair_distances(c, pairs, scale, "source") for c in (live, yoked)))


_COLUMNS = [f"{arm}_{c}" for arm in ("live", "yoked", "delta") for c in ("w2", "mean_term", "spread_term")]
_COLUMNS[6] = "delta"


@query(f"with {POINTS_SQL} select a, b, {', '.join(f'round({c}, 6) as {c}' for c in _COLUMNS)} from pairs")
def drift_pairs(t):
    """Distances of each pair of sources in both arms and their change, by means and spreads."""
    return document_pairs(t).select("a", "b", *(r6(c).alias(c) for c in _COLUMNS))


REPLICATES = 400


@query(f"""with {POINTS_SQL}, names as (select n, row_number() over (order by n) - 1 as place, count(*) over () as al from (select a as n from pairs union select b from pairs)),
 r as (select unnest(range({REPLICATES})) as rep), k as (select rep, ('0x' || substr(md5(concat('7:', rep, ':', place)), 1, 8))::bigint % al as place from names, r),
 times as (select rep, n, count(*) as c from k join names using (place) group by all),
 x as (select s.rep, sum(s.c * u.c * delta) / sum(s.c * u.c) as mean from pairs join times s on s.n = a join times u on u.n = b and u.rep = s.rep group by s.rep)
 select round((select avg(delta) from pairs), 6) as mean, (select count(*) from pairs) as n_pairs, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high, count(*) as replicates from x""")
def dyadic_bootstrap(t):
    """The mean change over all pairs of sources, with an interval over resampled sources."""
    return drift.dyadic_interval(settled(document_pairs(t).select("a", "b", "delta")), "delta", REPLICATES, 7).select(r6("mean").alias("mean"), "n_pairs", r6("low").alias("low"), r6("high").alias("high"), "replicates")


SIZES, DELTAS, TOSSES, TRIALS = [4, 8, 16, 32], [0.0, 0.1, 0.25], 12, 60
_KEY = "concat('3:', arm, ':', size, ':', trial, ':', unit)"
RATES_SQL = f"""rates as (select row_number() over (order by user_id) - 1 as place, avg((event_type = 'click')::int) as rate from events group by user_id),
 g as (select s.size, d.delta, tr.trial, u.unit, a.arm from (select unnest({SIZES}) as size) s, (select unnest({DELTAS}::double[]) as delta) d, (select unnest(range({TRIALS})) as trial) tr, (select unnest(range({max(SIZES)})) as unit) u, (select unnest(['a', 'b']) as arm) a where unit < size),
 h as (select *, ('0x' || substr(md5({_KEY}), 1, 8))::bigint % (select count(*) from rates) as place from g),
 e as (select size, delta, trial, arm, len(list_filter(range(1, {TOSSES + 1}), lambda i: ('0x' || substr(md5(concat({_KEY}, ':', i)), 1, 8))::bigint / 4294967296.0 < case when arm = 'b' then least(1.0, greatest(0.0, rate + delta)) else rate end)) / {TOSSES} as share from h join rates using (place)),
 m as (select size, delta, trial, arm, avg(share) as m, var_samp(share) / size as v from e group by size, delta, trial, arm),
 w as (select size, delta, trial, max(m) filter (arm = 'a') as ma, max(m) filter (arm = 'b') as mb, sum(v) as v from m group by all),
 power as (select size, delta, avg((case when v > 0 then abs(ma - mb) / sqrt(v) else 0 end > 2.0)::int) as power from w group by size, delta)"""


def user_power(t) -> DataFrame:
    """Power over the click rates of users."""
    rates = t("events").groupBy("user_id").agg(F.avg((F.col("event_type") == "click").cast("double")).alias("rate"))
    from skein.operators.sequences import numbered

    rates = numbered(rates, "user_id", name="place").select((F.col("place") - 1).cast("long").alias("place"), "rate")
    return drift.cluster_power(rates, SIZES, DELTAS, TOSSES, TRIALS, 3)


@query(f"with {RATES_SQL} select size::int as size, delta, round(power, 6) as power from power")
def power_curve(t):
    """How often a test of whole users finds a shift of their click rate, by size and shift."""
    return user_power(t).withColumn("power", r6("power"))


@query(f"with {RATES_SQL}, s as (select delta, max(size) filter (power < 0.8) as short from power group by delta) select delta, min(size) filter (short is null or size > short)::int as required from power join s using (delta) group by delta")
def required_users(t):
    """The least number of users in the grid that finds each shift with power 0.8."""
    return drift.required_size(user_power(t))


@query("""with r as (select user_id as member, value as s, (event_type = 'purchase')::int as y from events where event_type in ('purchase', 'click')),
 h as (select member, s, sum(y) as p, sum(1 - y) as n from r group by member, s), names as (select member, row_number() over (order by member) - 1 as place, count(*) over () as al from (select distinct member from h)),
 k as (select rep, ('0x' || substr(md5(concat('11:', rep, ':', place)), 1, 8))::bigint % al as place from names, (select unnest(range(100)) as rep)),
 times as (select rep, member, count(*) as c from k join names using (place) group by all),
 x as (select 0 as whole, rep, s, sum(p * c) as p, sum(n * c) as n from h join times using (member) group by rep, s union all select 1, -1, s, sum(p), sum(n) from h group by s),
 z as (select whole, rep, p, n, coalesce(sum(n) over (partition by rep order by s rows between unbounded preceding and 1 preceding), 0) as before from x),
 a as (select whole, rep, sum(p * (before + n / 2)) / nullif(sum(p) * sum(n), 0) as auc from z group by whole, rep)
 select round(max(auc) filter (whole = 1), 6) as auc, round(quantile_cont(auc, 0.025) filter (whole = 0), 6) as low, round(quantile_cont(auc, 0.975) filter (whole = 0), 6) as high, count(auc) filter (whole = 0) as replicates from a""")
def auc_by_users(t):
    """The AUC of an event's value for telling purchases from clicks, with an interval over resampled users."""
    from skein.operators import measures

    e = t("events").filter(F.col("event_type").isin("purchase", "click")).select("user_id", (F.col("event_type") == "purchase").cast("long").alias("y"), "value")
    return measures.auc_interval(e, "user_id", "y", "value", 100, 11).select(r6("auc").alias("auc"), r6("low").alias("low"), r6("high").alias("high"), "replicates")
