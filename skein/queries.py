"""Registered queries of the library's own operators, each with its DuckDB SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import stats
from skein.functions import text as tx
from skein.functions.grammar import Lexicon, legal, scene_nodes
from skein.operators import logs, measures, overlap, sequences
from skein.plans import chains as generators
from skein.plans import gates
from skein.streaming import limiter, repetition

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


TURN = ["turn", "role", "text"]
AT = ["ts", "event_id"]
#: tokens of a text in SQL
TOK = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z]+'), lambda x: x <> '')"
SETS = f"t as (select *, list_distinct({TOK.format('text')}) as roots from conversations)"
RULES = [("shout", r"[A-Z]{3,}.*!!", 1), ("number", r"\d{6,}", 2), ("table", r"\|", 1), ("secret", r"(?i)(token|secret|password)\s*=", 3), ("address", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", 2)]
EVENTS = ["click", "error", "purchase", "refund", "signup", "view"]
#: severity of an event, and days for which events of that severity are kept
SEVERITY = "case when event_type = 'error' then 2 when event_type = 'signup' then 1 else 0 end"
PAIRS = "p as (select event_type as prior, lead(event_type) over (partition by user_id order by ts, event_id) as following from events)"


def turn_sets(t) -> DataFrame:
    return t("conversations").withColumn("roots", tx.token_set(F.col("text")))


@query(f"""with {SETS}, l as (select unnest([1,2,3,4]) as lag),
 o as (select *, row_number() over (partition by conv_id order by turn, role, text) as i from t)
 select l.lag, round(avg(len(list_intersect(a.roots, b.roots))), 6) as mean_overlap, count(*) as n_pairs
 from l join o a on true join o b on a.conv_id = b.conv_id and b.i = a.i + l.lag group by 1""")
def lag_profile(t):
    """Mean token overlap of turns k apart."""
    return sequences.lag_profile(turn_sets(t), "conv_id", TURN, "roots").withColumn("mean_overlap", r6("mean_overlap"))


@query(f"with {PAIRS}, n as (select prior, following, count(*) as n from p where following is not null group by all) select prior, following, n, round(n / sum(n) over (partition by prior), 6) as share from n")
def transition_matrix(t):
    """Counts and shares of adjacent event types of a user."""
    return sequences.transitions(t("events"), "user_id", AT, "event_type").withColumn("share", r6("share"))


GRID = f"""{PAIRS}, v as (select distinct event_type as e from events), n as (select prior, following, count(*) as n from p where following is not null group by all),
 g as (select a.e as prior, b.e as following, coalesce(n.n, 0) as n from v a cross join v b left join n on n.prior = a.e and n.following = b.e),
 s as (select *, sum(n) over (partition by prior) as row_n, sum(n) over (partition by following) as col_n, sum(n) over () as all_n from g)"""


@query(f"with {GRID}, r as (select *, n / (row_n / count(*) over (partition by prior)) as ratio from s) select min(ratio) >= 0.25 as fair, round(min(ratio), 6) as worst, arg_min(prior || '>' || following, ratio * 1000000 + 0) as cell, count(*) as cells from r")
def transition_fairness(t):
    """The worst observed share of a cell against an even row."""
    g = sequences.transition_grid(t("events"), "user_id", AT, "event_type")
    g = g.withColumn("ratio", F.col("n") / (F.col("row_n") / F.count("*").over(Window.partitionBy("prior"))))
    return g.agg((F.min("ratio") >= 0.25).alias("fair"), r6(F.min("ratio")).alias("worst"), F.min_by(F.concat_ws(">", "prior", "following"), "ratio").alias("cell"), F.count("*").alias("cells"))


@query(f"with {GRID} select prior, cast(row_n as bigint) as row_n, round(0.5 * sum(abs(n / row_n - col_n / all_n)), 6) as distance from s group by all")
def transition_tv_distance(t):
    """Total variation of each row from independence."""
    g = sequences.transition_grid(t("events"), "user_id", AT, "event_type")
    return g.groupBy("prior", "row_n").agg(r6(stats.total_variation(F.col("share"), F.col("independent"))).alias("distance"))


@query("select conv_id, turn, role, text from (select *, dense_rank() over (partition by conv_id order by turn desc) as r from conversations) where r <= 3")
def last_n_turns(t):
    """Rows of the last three distinct turns."""
    return sequences.last_turns(t("conversations"), "conv_id", "turn", 3)


@query("select conv_id, turn, max(text) filter (role = 'user') as user, max(text) filter (role = 'assistant') as assistant from conversations group by all")
def thread_pivot(t):
    """Texts of a turn by role."""
    return sequences.role_pivot(t("conversations"), "conv_id", "turn", "role", "text", ["user", "assistant"])


@query("select conv_id, turn, role, coalesce(array_to_string(list(role) over (partition by conv_id order by turn, role, text rows between 4 preceding and 1 preceding), '>'), '') as context from conversations")
def context_window(t):
    """The roles of the four rows before."""
    c = sequences.context(t("conversations"), "conv_id", TURN, "role", 4)
    return c.select("conv_id", "turn", "role", F.array_join("context", ">").alias("context"))


@query(f"with {SETS} select conv_id, turn, role, coalesce(array_to_string(list_sort(list_intersect(lag(roots, 1) over w, lag(roots, 2) over w)), ' '), '') as held from t window w as (partition by conv_id order by turn, role, text)")
def held_tokens(t):
    """Tokens that the two turns before share."""
    return sequences.held(turn_sets(t), "conv_id", TURN, "roots").select("conv_id", "turn", "role", F.coalesce(F.array_join(F.array_sort("held"), " "), F.lit("")).alias("held"))


@query(f"with {SETS} select conv_id, turn, role, len(list_distinct(list_concat(coalesce(lag(roots, 2) over w, []), coalesce(lag(roots, 4) over w, [])))) as n_own from t window w as (partition by conv_id order by turn, role, text)")
def own_turn_tokens(t):
    """Tokens of the speaker's two own turns before."""
    return sequences.own_items(turn_sets(t), "conv_id", TURN, "roots", 2).select("conv_id", "turn", "role", F.size("own").cast("long").alias("n_own"))


@query("""with n as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as m from events),
 q as (select *, (i >= round_even(m / 4.0, 0))::int + (i >= round_even(2.0 * m / 4, 0))::int + (i >= round_even(3.0 * m / 4, 0))::int as part from n)
 select user_id, part, count(*) as n, round(avg((event_type = 'purchase')::int), 6) as rate from q group by all""")
def quarter_rates(t):
    """A rate in each contiguous quarter, split at half-even edges."""
    q = sequences.parts(t("events"), "user_id", AT, 4)
    return q.groupBy("user_id", "part").agg(F.count("*").alias("n"), r6(F.avg((F.col("event_type") == "purchase").cast("int"))).alias("rate"))


@query("""with p as (select unnest([1,2,3]) as period), n as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as i from events),
 s as (select a.user_id, p.period, a.i from p join n a on true join n b on a.user_id = b.user_id and b.i = a.i - p.period and a.event_type = b.event_type),
 g as (select *, i - row_number() over (partition by user_id, period order by i) as g from s), c as (select user_id, period, g, count(*) as run from g group by all)
 select user_id, period, max(run) as longest from c group by all""")
def repeat_cycles(t):
    """The longest run that repeats with period 1, 2 or 3."""
    return sequences.longest_cycle(t("events"), "user_id", AT, "event_type")


@query("""with n as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as m from events)
 select user_id, m as n, round(abs(avg(value) filter (i > floor(m / 2)) - avg(value) filter (i <= floor(m / 2))), 6) as movement from n group by all""")
def half_movement(t):
    """How far the mean moves from the first half to the second."""
    return sequences.half_movement(t("events"), "user_id", AT, "value").withColumn("movement", r6("movement"))


@query("select user_id, event_id from (select *, sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id) as bad from events) where bad = 0")
def usable_prefix(t):
    """Events before a user's first error."""
    return sequences.take_while(t("events"), "user_id", AT, F.col("event_type") != "error").select("user_id", "event_id")


@query("select user_id, event_id from (select *, lag(value) over (partition by user_id order by ts, event_id) as b from events) where value >= 90 and b < 90")
def threshold_crossings(t):
    """Events at which a value first reaches a target."""
    return sequences.crossings(t("events"), "user_id", AT, "value", 90.0).select("user_id", "event_id")


@query("""with c as (select event_type as a, lead(event_type, 1) over w as b, lead(event_type, 2) over w as c, user_id % 2 as half from events window w as (partition by user_id order by ts, event_id)),
 k as (select distinct a, b, c from c where half = 0 and c is not null), q as (select c.*, k.a is not null as hit from c left join k on c.a = k.a and c.b = k.b and c.c = k.c where half = 1 and c.c is not null)
 select count(*) filter (hit) as hits, count(*) as total, round(avg(hit::int), 6) as rate from q""")
def replay_rate(t):
    """Triples of odd users that even users have too."""
    s = sequences.successors(t("events"), "user_id", AT, "event_type", 2).filter("s2 is not null").select(F.col("event_type").alias("a"), F.col("s1").alias("b"), F.col("s2").alias("c"), (F.col("user_id") % 2).alias("half"))
    known = s.filter("half = 0").select("a", "b", "c").distinct().withColumn("hit", F.lit(1))
    q = s.filter("half = 1").join(known, ["a", "b", "c"], "left")
    return q.agg(F.count("hit").alias("hits"), F.count("*").alias("total"), r6(F.avg(F.coalesce("hit", F.lit(0)))).alias("rate"))


CASES = ", ".join(f"case when regexp_matches(coalesce(text, ''), '{p}') then '{n}' end" for n, p, _ in RULES)
MOST = ", ".join(f"case when regexp_matches(coalesce(text, ''), '{p}') then {s} else 0 end" for _, p, s in RULES)


@query(f"select doc_id, array_to_string(list_filter([{CASES}], lambda x: x is not null), ',') as flags, greatest({MOST}) as severity from documents")
def tripwire_flags(t):
    """Names of the rules that a text trips, and the largest severity."""
    names, severity = tx.flags(F.coalesce("text", F.lit("")), RULES)
    return t("documents").select("doc_id", F.array_join(names, ",").alias("flags"), severity.alias("severity"))


@query(f"with f as (select array_to_string(list_filter([{CASES}], lambda x: x is not null), ',') as flags from documents) select flags, count(*) as n from f where flags <> '' group by all")
def flag_counts(t):
    """Q45, Q46: how often each set of flags occurs."""
    names, _ = tx.flags(F.coalesce("text", F.lit("")), RULES)
    return logs.grouped_counts(t("documents").select(F.array_join(names, ",").alias("flags")), "flags", F.col("flags") != "")


@query("""with m as (select max(ts) as now from events) select count(*) as events, count(distinct user_id) as users, count(distinct event_type) as kinds, count(*) filter (ts > now - interval 1 day) as recent,
 count(*) filter (event_type = 'error') as errors, count(distinct user_id) filter (ts > now - interval 1 day) as recent_users from events, m""")
def log_stats(t):
    """Counters of a log in one pass."""
    e = t("events")
    return logs.counters(e, "ts", "user_id", "event_type", F.lit(e.agg(F.max("ts")).first()[0]))


@query("select event_id, user_id, event_type, value from events where event_type ilike 'p%' order by ts desc, event_id limit 25")
def recent_events(t):
    """The most recent rows of a kind, a top-k report."""
    return logs.recent(t("events"), "ts", 25, F.col("event_type").ilike("p%"), ["event_id"]).select("event_id", "user_id", "event_type", "value")


@query("with m as (select max(ts) as now from events) select event_id from events, m where event_type = 'signup' or ts >= now - case when event_type = 'error' then interval 20 day else interval 10 day end")
def retention_keep(t):
    """M9, Q35-Q37: events kept by the days that their kind is kept for; signups for ever."""
    e = t("events")
    days = F.when(F.col("event_type") == "signup", F.lit(None)).when(F.col("event_type") == "error", 20).otherwise(10)
    return logs.retained(e, "ts", F.lit(e.agg(F.max("ts")).first()[0]), days).select("event_id")


@query("select user_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def latest_wins(t):
    """The latest row of each key."""
    return logs.latest(t("events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", ["event_id"]).select("user_id", "event_type", "value")


@query("select event_id, hits, hits > 3 as refused from (select event_id, count(*) over (partition by user_id order by epoch(ts) range between 86400 preceding and current row) as hits from events)")
def rate_limit_hits(t):
    """M7: hits in the last day; counts refused hits too (see exact_limiter)."""
    return logs.sliding_hits(t("events"), "user_id", "ts", 86400, 3).select("event_id", "hits", "refused")


@query("select user_id, epoch, count(*) as n, round(sum(value), 4) as total from (select *, cast(floor((row_number() over (partition by user_id order by ts, event_id) - 1) / 25) as bigint) as epoch from events) group by all")
def sequence_epochs(t):
    """Tumbling windows of 25 rows of a sequence."""
    return logs.tumbling(t("events"), "user_id", AT, 25).groupBy("user_id", "epoch").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select conv_id, max(turn) + 1 as next_turn from conversations group by all")
def next_turn(t):
    """The number of the next turn."""
    return t("conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_turn"))


@query("with m as (select max(ts) as now from events) select user_id, round(epoch(max(now)) - epoch(max(ts)), 3) as idle from events, m group by all")
def idle_seconds(t):
    """Seconds since a user's last event."""
    e = t("events")
    now = e.agg(F.max(F.col("ts").cast("timestamp").cast("double"))).first()[0]
    return e.groupBy("user_id").agg(F.round(F.lit(now) - F.max(F.col("ts").cast("timestamp").cast("double")), 3).alias("idle"))


@query(f"""with w as (select distinct doc_id, lang, unnest({TOK.format('text')}) as item from documents), n as (select item, lang, count(*) as n from w group by all),
 b as (select item, sum(n) as total, max(n) as top from n group by item having sum(n) >= 5)
 select n.item, min(lang) as modal, round(max(top / total), 6) as purity, cast(max(total) as bigint) as n from n join b on n.item = b.item and n.n = b.top group by n.item""")
def word_purity(t):
    """The language that a word goes with, and how purely."""
    p = overlap.purity(t("documents").select("lang", tx.tokens(F.col("text")).alias("items")), "items", "lang")
    return p.withColumn("purity", r6("purity"))


@query("""with f as (select distinct c.c_mktsegment as segment, n_name as nation from customer c cross join nation), s as (select c_mktsegment as segment, n_name as nation, count(*) as n from customer join nation on c_nationkey = n_nationkey where c_acctbal < 0 group by all),
 g as (select f.segment, coalesce(s.n, 0) as n from f left join s using (segment, nation))
 select segment, min(n) as least, max(n) as most, cast(count(*) filter (n > 0) as bigint) as covered, count(*) as total, round(min(n) / avg(n), 6) as fairness from g group by all""")
def exposure_zero_fill(t):
    """A2-A4: least and greatest exposure of each form, zeros included."""
    n = t("nation").select("n_nationkey", F.col("n_name").alias("nation"))
    c = t("customer")
    forms = c.select(F.col("c_mktsegment").alias("segment")).distinct().crossJoin(n.select("nation"))
    seen = c.filter("c_acctbal < 0").join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_mktsegment").alias("segment"), "nation")
    return overlap.exposure(forms, seen, "segment", "nation").withColumn("fairness", r6("fairness"))


@query(f"""with w as (select item_id, len({TOK.format('text')}) as size, unnest({TOK.format('text')}) as tok from benchmark), n as (select item_id, size, tok, count(*) as n from w group by all)
 select a.item_id as a, b.item_id as b, round(sum(least(a.n, b.n)) / max(greatest(a.size, b.size)), 6) as overlap from n a join n b on a.tok = b.tok and a.item_id < b.item_id group by all""")
def token_overlap_pairs(t):
    """Multiset overlap of pairs of benchmark items that share a token."""
    b = t("benchmark").select("item_id", tx.tokens(F.col("text")).alias("items"))
    return overlap.overlapping_pairs(b, "item_id", "items").withColumn("overlap", r6("overlap"))


@query("select min(doc_id) as doc_id, count(*) as copies from documents group by lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))")
def canonical_dedupe(t):
    """The first document of each canonical form and how many share it."""
    form = F.lower(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")))
    return t("documents").groupBy(F.sha2(form, 256).alias("f")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("f")


@query("""with p as (select distinct unnest(string_split(text, chr(10))) as line from benchmark), c as (select distinct unnest(string_split(text, chr(10))) as line from documents)
 select count(c.line) as leaked, count(*) as total, round(count(c.line) / count(*), 6) as rate from p left join c using (line)""")
def leakage_rate(t):
    """Benchmark lines that documents hold."""
    lines = [t(x).select(F.explode(F.split("text", "\n")).alias("line")) for x in ("benchmark", "documents")]
    return overlap.leakage(*lines, "line").withColumn("rate", r6("rate"))


@query("select doc_id, lang from documents anti join labels using (doc_id)")
def held_out_rows(t):
    """Documents without a label."""
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("select doc_id, ('0x' || substr(sha256('fold:' || doc_id), 1, 8))::bigint / 4294967296.0 < 0.2 as held_out from documents")
def hash_split(t):
    """A deterministic fold by the hash of the key."""
    return t("documents").select("doc_id", (tx.hash_share(F.col("doc_id").cast("string"), "fold:") < 0.2).alias("held_out"))


@query(f"""with {SETS}, c as (select conv_id, turn, role, len(list_intersect(lag(roots) over w, roots)) as carried, len(roots) - len(list_intersect(lag(roots) over w, roots)) as added from t window w as (partition by conv_id order by turn, role, text)) select * from c where carried is not null""")
def carry_profile(t):
    """What a turn carries over from the one before, and what it adds."""
    c = overlap.carried(turn_sets(t), "conv_id", TURN, "roots").filter("carried is not null")
    return c.select("conv_id", "turn", "role", F.size("carried").cast("long").alias("carried"), F.size("added").cast("long").alias("added"))


@query(f"""with {SETS}, c as (select conv_id, turn, len(list_intersect(lag(roots) over w, roots)) > 2 as hit, lag(roots) over w is not null as pair from t window w as (partition by conv_id order by turn, role, text)), d as (select least(turn, 4) as depth, count(*) as n, count(*) filter (hit) as hits from c where pair group by all)
 select depth, n, hits, round((hits / n + 1.9208 / n - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) as low, round((hits / n + 1.9208 / n + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) as high from d""")
def carry_by_depth(t):
    """Carry rate at each depth with its Wilson interval."""
    c = overlap.carried(turn_sets(t), "conv_id", TURN, "roots").filter("carried is not null")
    d = c.groupBy(F.least("turn", F.lit(4).cast("long")).alias("depth")).agg(F.count("*").alias("n"), F.count_if(F.size("carried") > 2).alias("hits"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return d.select("depth", "n", "hits", r6(low).alias("low"), r6(high).alias("high"))


@query(f"""with {SETS}, c as (select conv_id, row_number() over w as i, coalesce(len(list_intersect(lag(roots) over w, roots)) > 2, false)::int as hit from t window w as (partition by conv_id order by turn, role, text)), f as (select * from c where i between 2 and 5), p as (select i, avg(hit) as p from f group by i), g as (select conv_id, max(hit) as any_hit from f group by all having count(*) = 4)
 select count(*) as conversations, round(avg(any_hit), 6) as joint, round((select 1 - coalesce(exp(sum(ln(nullif(1 - p, 0)))), 0) from p), 6) as independent from g""")
def carry_joint(t):
    """How often any of four turns carries, against independence."""
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy(*TURN))
    c = overlap.carried(turn_sets(t).withColumn("i", i), "conv_id", TURN, "roots").filter("i between 2 and 5")
    f = c.select("conv_id", "i", F.coalesce(F.size("carried") > 2, F.lit(False)).cast("int").alias("hit"))
    p = f.groupBy("i").agg(F.avg("hit").alias("p")).agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("independent"))
    g = f.groupBy("conv_id").agg(F.max("hit").alias("any_hit"), F.count("*").alias("n")).filter("n = 4")
    return g.agg(F.count("*").alias("conversations"), r6(F.avg("any_hit")).alias("joint")).crossJoin(p.select(r6("independent").alias("independent")))


@query(f"with {PAIRS} select least(prior, following) || '|' || greatest(prior, following) as pair, count(*) as n from p where following is not null and prior <> following group by all")
def confusion_boundaries(t):
    """Unordered pairs of adjacent kinds that differ."""
    s = sequences.successors(t("events"), "user_id", AT, "event_type").filter("s1 is not null and s1 != event_type")
    return logs.grouped_counts(s.select(F.array_join(F.array_sort(F.array("event_type", "s1")), "|").alias("pair")), "pair")


@query("with x as (select unnest(['click','error','purchase','refund','signup','view']) as event_type), n as (select event_type, count(*) as n from events group by all) select event_type, coalesce(n, 0) as n, round(coalesce(n / sum(n) over (), 0), 6) as share from x left join n using (event_type)")
def direction_coverage(t):
    """Share of every expected kind, zero where it is missing."""
    return gates.shares(t("events"), "event_type", EVENTS).withColumn("share", r6("share"))


@query("with n as (select user_id, event_type, count(*) as n from events group by all) select user_id, count(*) as kinds, round(max(n) / sum(n), 6) as top_share, max(n) / sum(n) <= 0.6 and count(*) >= 3 as varied from n group by all")
def force_variety(t):
    """A10: whether a user's events are varied."""
    n = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    top = F.max("n") / F.sum("n")
    return n.groupBy("user_id").agg(F.count("*").alias("kinds"), r6(top).alias("top_share"), ((top <= 0.6) & (F.count("*") >= 3)).alias("varied"))


@query(f"with w as (select conv_id, unnest({TOK.format('text')}) as tok from conversations) select conv_id, count(distinct tok) as distinct_tokens, count(*) as tokens, round(count(distinct tok) / count(*), 6) as ttr from w group by all")
def type_token_ratio(t):
    """Distinct tokens over tokens of a conversation."""
    w = t("conversations").select("conv_id", F.explode(tx.tokens(F.col("text"))).alias("tok"))
    return w.groupBy("conv_id").agg(F.countDistinct("tok").alias("distinct_tokens"), F.count("*").alias("tokens"), r6(F.countDistinct("tok") / F.count("*")).alias("ttr"))


@query(f"with w as (select distinct item_id, unnest({TOK.format('text')}) as tok from benchmark) select a.tok as a, b.tok as b, count(*) as n from w a join w b on a.item_id = b.item_id and a.tok < b.tok group by all having count(*) >= 2")
def cooccurrence_pairs(t):
    """Tokens that share at least two items."""
    return overlap.cooccurrence(t("benchmark").select("item_id", tx.tokens(F.col("text")).alias("items")), "item_id", "items")


@query(f"with w as (select distinct item_id, unnest({TOK.format('text')}) as item from benchmark) select item, count(*) as n, array_to_string(list(item_id order by item_id), ',') as keys from w group by all")
def inverted_index(t):
    """Items of each token."""
    i = overlap.inverted(t("benchmark").select("item_id", tx.tokens(F.col("text")).alias("items")), "item_id", "items")
    return i.withColumn("keys", F.array_join(F.transform("keys", lambda k: k.cast("string")), ","))


@query("""with d as (select count(*) filter (quality = 1 and toxic = 1) as b, count(*) filter (quality = 0 and toxic = 0) as c from labels)
 select b, c, round(least(1, 2 * (select sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) from (select unnest(range(0, least(b, c) + 1)) as i))), 6) as p from d""")
def mcnemar_labels(t):
    """Exact McNemar test of two outcomes of the same items."""
    labels = t("labels")
    both = labels.agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("b"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("c"))
    return both.withColumn("p", r6(stats.sign_test_p(F.col("b"), F.col("c"))))


WELCH = "(avg(n_chars) filter (toxic = 1) - avg(n_chars) filter (toxic = 0)) / sqrt(var_samp(n_chars) filter (toxic = 1) / count(*) filter (toxic = 1) + var_samp(n_chars) filter (toxic = 0) / count(*) filter (toxic = 0))"


@query(f"select count(*) filter (toxic = 1) as n_a, count(*) filter (toxic = 0) as n_b, round({WELCH}, 5) as t from documents join labels using (doc_id)")
def welch_t(t):
    """Welch's t of the lengths of two groups."""
    d = t("documents").join(t("labels"), "doc_id")
    side = [F.when(F.col("toxic") == x, F.col("n_chars")) for x in (1, 0)]
    m = d.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(side) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    value, _ = stats.welch(*(F.col(c) for c in ("m0", "v0", "n0", "m1", "v1", "n1")))
    return m.select(F.col("n0").alias("n_a"), F.col("n1").alias("n_b"), F.round(value, 5).alias("t"))


@query("""with p as (select n_name as name, 1.0 / (1 + count(*) * count(*)) as p from customer join nation on c_nationkey = n_nationkey group by all), o as (select *, p <= 0.05 / (count(*) over () - row_number() over (order by p, name) + 1) as ok from p)
 select name, min(ok::int) over (order by p, name rows unbounded preceding) = 1 as rejected from o""")
def holm_step_down(t):
    """Holm's procedure over 25 hypotheses."""
    n = t("nation")
    p = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg((1.0 / (1 + F.count("*") * F.count("*"))).alias("p"))
    return measures.holm(p, "p").select("name", "rejected")


DIMS = "v as (select label, unnest(range(0, len(embedding))) as d, unnest(embedding)::double as x from embeddings)"


def dimensions(t) -> DataFrame:
    return t("embeddings").select("label", F.posexplode("embedding").alias("d", "x")).withColumn("x", F.col("x").cast("double")).withColumn("d", F.col("d").cast("long"))


@query(f"with {DIMS}, g as (select d, label, avg(x) as m, var_samp(x) as v, count(*) as n from v group by all), s as (select d, avg(v) as within, greatest(0, var_samp(m) - avg(v) * avg(1.0 / n)) as between_ from g group by d) select d, round(between_, 6) as between, round(within, 6) as within, round(between_ / (between_ + within), 6) as icc from s")
def icc_embeddings(t):
    """Intraclass correlation of each coordinate."""
    return measures.icc(dimensions(t), "label", "x", ["d"]).select("d", r6("between").alias("between"), r6("within").alias("within"), r6("icc").alias("icc"))


@query(f"with {DIMS}, g as (select d, label, avg(x) as m, stddev_samp(x) as s from v group by all) select a.d, a.label as a, b.label as b, round((a.m - b.m) ** 2 + (a.s - b.s) ** 2, 6) as w2 from g a join g b on a.d = b.d and a.label < b.label")
def w2_centroids(t):
    """Squared Gaussian Wasserstein distances of labels."""
    return measures.wasserstein_pairs(measures.group_moments(dimensions(t), "label", "x", ["d"]), "label", ["d"]).withColumn("w2", r6("w2"))


@query(f"with {DIMS}, g as (select d, label, avg(x) as m, stddev_samp(x) as s, count(*) as n from v group by all), r as (select d, label, s / sqrt(n) / stddev_samp(m) over (partition by d) as ratio from g) select d, label, round(ratio, 6) as ratio, ratio <= 0.5 as locatable from r")
def locatability(t):
    """Whether a label's mean can be located on each coordinate."""
    m = measures.group_moments(dimensions(t), "label", "x", ["d"])
    return measures.locatability(m, "label", ["d"]).withColumn("ratio", r6("ratio"))


@query("select lang, list_sort(list(n_chars))[cast(floor(0.9 * (count(*) - 1)) as int) + 1] as p90, list_sort(list(n_chars))[least(cast(floor(0.5 * count(*)) as int), count(*) - 1) + 1] as mid, list_sort(list(n_chars))[cast(round_even(0.25 * (count(*) - 1), 0) as int) + 1] as q1 from documents group by all")
def order_stat_p90(t):
    """Order statistics by three index conventions, from the histogram of each language."""
    places = {"p90": lambda n: F.floor(0.9 * (n - 1)), "mid": lambda n: F.least(F.floor(0.5 * n), n - 1), "q1": lambda n: F.bround(0.25 * (n - 1))}
    return measures.order_statistics(t("documents"), "lang", "n_chars", places)


@query("select lang, count(*) as n, count(distinct doc_id) as n_distinct, cast(sum(cast(('0x' || substr(sha256(cast(doc_id as varchar)), 1, 15)) as bigint)) as varchar) as digest from documents group by all")
def item_digest(t):
    """Order-free digest of the items of each group."""
    return gates.digest(t("documents"), "doc_id", ["lang"])


@query("""select * from (select 'discount' as violation, count(*) filter (not (l_discount between 0 and 0.1)) as n from lineitem union all select 'quantity', count(*) filter (not (l_quantity > 0)) from lineitem union all select 'shipped_flag', count(*) filter (not (l_linestatus in ('O', 'F'))) from lineitem)""")
def constraint_checks(t):
    """Rows that break a constraint."""
    return gates.violations(t("lineitem"), {"discount": F.col("l_discount").between(0, 0.1), "quantity": F.col("l_quantity") > 0, "shipped_flag": F.col("l_linestatus").isin("O", "F")})


@query("select * from (select distinct user_id, 'a' as side from events where event_type = 'purchase' and value > 95 and user_id not in (select user_id from events where event_type = 'error' and value > 95) union all select distinct user_id, 'b' from events where event_type = 'error' and value > 95 and user_id not in (select user_id from events where event_type = 'purchase' and value > 95))")
def unpaired_keys(t):
    """Users with only one of two kinds of high events."""
    e = t("events")
    return overlap.unpaired(e.filter("event_type = 'purchase' and value > 95"), e.filter("event_type = 'error' and value > 95"), "user_id")


@query("with c as (select o_custkey, bool_or(o_orderstatus = 'O') as o, bool_or(o_orderstatus = 'F') as f from orders group by all) select case when o and f then 'both' when o then 'open' when f then 'filled' else 'other' end as regime, count(*) as n from c group by all")
def pair_regimes(t):
    """Customers by the arms in which they appear."""
    c = t("orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("o"), F.bool_or(F.col("o_orderstatus") == "F").alias("f"))
    return logs.grouped_counts(c.select(F.when(F.col("o") & F.col("f"), "both").when(F.col("o"), "open").when(F.col("f"), "filled").otherwise("other").alias("regime")), "regime")


@query("""with s as (select n_chars as s, sum(toxic) as p, sum(1 - toxic) as n from documents join labels using (doc_id) group by all), b as (select *, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from s)
 select round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) as auc, cast(sum(p) as bigint) as positives, cast(sum(n) as bigint) as negatives from b""")
def auc_by_rank(t):
    """AUC of a score by mid-ranks."""
    d = t("documents").join(t("labels"), "doc_id")
    return measures.auc(d, "toxic", "n_chars").withColumn("auc", r6("auc"))


@query("""with g as (select lang, avg(n_chars) filter (toxic = 1) - avg(n_chars) filter (toxic = 0) as d from documents join labels using (doc_id) group by all), m as (select unnest(range(0, 16)) as mask), i as (select d, row_number() over (order by d) - 1 as i, count(*) over () as n, sum(d) over () as s from g where d is not null),
 f as (select mask, max(n) as n, max(s) as s, sum(case when (mask >> i) & 1 = 1 then -d else d end) as t from i, m where mask < power(2, n) group by mask) select cast(max(n) as int) as n, round(max(s) / max(n), 4) as observed, round(avg((abs(t) >= abs(s) - 0.000000000001)::int), 6) as p from f""")
def sign_flip_test(t):
    """Exact sign-flip test over the languages' differences."""
    d = t("documents").join(t("labels"), "doc_id").groupBy("lang").agg((F.avg(F.when(F.col("toxic") == 1, F.col("n_chars"))) - F.avg(F.when(F.col("toxic") == 0, F.col("n_chars")))).alias("d"))
    return measures.sign_flip(d, "d").select("n", F.round("observed", 4).alias("observed"), r6("p").alias("p"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, case when event_type = 'error' then 2 when event_type = 'signup' then 1 else 0 end as severity from events")
def parsed_props(t):
    """Typed fields of a JSON column, and the severity of a row."""
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.expr(SEVERITY).alias("severity"))


@query("select doc_id, case when length(text) > 40 then rtrim(substr(text, 1, 39)) || '…' else text end as clipped from documents")
def clipped_texts(t):
    """Texts of bounded length with a mark."""
    return t("documents").select("doc_id", tx.clip(F.col("text"), 40).alias("clipped"))


@query(f"with {DIMS.replace('select label,', 'select vec_id, label,')}, b as (select d, label, avg(x) as m, abs(avg(x) filter (vec_id % 2 = 0) - avg(x) filter (vec_id % 2 = 1)) as moved from v group by all) select d, round(stddev_samp(m) / avg(moved), 6) as contamination from b group by d")
def half_contamination(t):
    """Spread of label means against how far the halves of a label move."""
    v = t("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    side = [F.avg(F.when(F.col("vec_id") % 2 == k, F.col("x"))) for k in (0, 1)]
    b = v.groupBy(F.col("d").cast("long").alias("d"), "label").agg(F.avg("x").alias("m"), F.abs(side[0] - side[1]).alias("moved"))
    return b.groupBy("d").agg(r6(F.stddev_samp("m") / F.avg("moved")).alias("contamination"))


@query(f"with {DIMS}, g as (select d, label, avg(x) as m from v group by all) select d, round((max(m) filter (label = 0) - avg(m) filter (label <> 0)) / stddev_samp(m) filter (label <> 0), 6) as z from g group by d")
def pool_centrality(t):
    """How far one label's mean lies from those of the others."""
    g = dimensions(t).groupBy("d", "label").agg(F.avg("x").alias("m"))
    pool, rest = F.max(F.when(F.col("label") == 0, F.col("m"))), F.when(F.col("label") != 0, F.col("m"))
    return g.groupBy("d").agg(r6((pool - F.avg(rest)) / F.stddev_samp(rest)).alias("z"))


@query(f"with {DIMS}, l as (select distinct label as dropped from embeddings), g as (select d, label, avg(x) as m, var_samp(x) as v, count(*) as n from v group by all), s as (select d, dropped, avg(v) as within, greatest(0, var_samp(m) - avg(v) * avg(1.0 / n)) as b from g, l where label <> dropped group by all) select d, dropped, round(b / (b + within), 6) as icc from s")
def jackknife_icc(t):
    """Intraclass correlation without each label in turn, from the labels' moments."""
    g = dimensions(t).groupBy("d", "label").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.count("*").alias("n"))
    labels = g.select("label").distinct().withColumnRenamed("label", "dropped")
    s = g.crossJoin(labels).filter("label != dropped").groupBy("d", "dropped").agg(F.avg("v").alias("w"), F.var_samp("m").alias("bm"), F.avg(1 / F.col("n")).alias("inv"))
    b = F.greatest(F.lit(0.0), F.col("bm") - F.col("w") * F.col("inv"))
    return s.select("d", "dropped", r6(b / (b + F.col("w"))).alias("icc"))


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by sha256(cast(event_id as varchar))) - 1 as i from events), c as (select event_type, i // 40 as chunk, sum(cast(value as decimal(18, 6))) as s, avg(value) as m from r group by all having count(*) = 40)
 select event_type, count(*) as chunks, round(cast(sum(s) as double) / count(*) / 40, 4) as mean, round(stddev_samp(m), 4) as sd from c group by all""")
def chunk_means(t):
    """Means of whole chunks of 40 rows in an order that a hash decides; sums are decimals, so their order does not matter."""
    i = F.row_number().over(Window.partitionBy("event_type").orderBy(F.sha2(F.col("event_id").cast("string"), 256))) - 1
    c = t("events").select("event_type", "value", F.floor(i / 40).alias("chunk")).groupBy("event_type", "chunk").agg(F.sum(F.col("value").cast("decimal(18,6)")).alias("s"), F.avg("value").alias("m"), F.count("*").alias("n")).filter("n = 40")
    return c.groupBy("event_type").agg(F.count("*").alias("chunks"), F.round(F.sum("s").cast("double") / F.count("*") / 40, 4).alias("mean"), F.round(F.stddev_samp("m"), 4).alias("sd"))


@query(f"with {PAIRS}, c as (select prior = 'click' as chosen, following = 'purchase' as hit from p where following is not null) select count(*) filter (chosen) as n_pivot, count(*) filter (not chosen) as n_other, round(avg(hit::int) filter (chosen), 6) as rate_pivot, round(avg(hit::int) filter (not chosen), 6) as rate_other from c")
def rate_contrast(t):
    """A rate after one kind of event against the rate after others."""
    c = sequences.successors(t("events"), "user_id", AT, "event_type").filter("s1 is not null").select((F.col("event_type") == "click").alias("pivot"), (F.col("s1") == "purchase").cast("int").alias("hit"))
    return c.agg(F.count_if("pivot").alias("n_pivot"), F.count_if(~F.col("pivot")).alias("n_other"), r6(F.avg(F.when(F.col("pivot"), F.col("hit")))).alias("rate_pivot"), r6(F.avg(F.when(~F.col("pivot"), F.col("hit")))).alias("rate_other"))


@query("""with u as (select user_id, avg(value) filter (event_type = 'purchase') as a, avg(value) filter (event_type = 'click') as b from events group by all), k as (select * from u where a is not null and b is not null)
 select count(*) as n, round((select avg(abs(x.a - y.b)) from k x, k y where x.user_id <> y.user_id) - avg(abs(a - b)), 4) as gain from k""")
def pairing_gain(t):
    """Mean distance of mismatched pairs less that of matched pairs; running sums over the histogram of values, no pairs are made."""
    side = [F.avg(F.when(F.col("event_type") == x, F.col("value"))).alias(n) for x, n in (("purchase", "a"), ("click", "b"))]
    k = t("events").groupBy("user_id").agg(*side).filter("a is not null and b is not null")
    both = k.select(F.col("a").alias("v"), F.lit(1).alias("na"), F.lit(0).alias("nb")).unionAll(k.select(F.col("b").alias("v"), F.lit(0).alias("na"), F.lit(1).alias("nb")))
    before = measures.running_sums(both.withColumn("sa", F.col("v") * F.col("na")).withColumn("sb", F.col("v") * F.col("nb")), "v", ["na", "nb", "sa", "sb"])
    every = before.agg(F.sum(F.col("na") * (F.col("v") * F.col("nb_before") - F.col("sb_before")) + F.col("nb") * (F.col("v") * F.col("na_before") - F.col("sa_before"))).alias("total"))
    own = k.agg(F.count("*").alias("n"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("matched"))
    return own.crossJoin(every).select("n", F.round((F.col("total") - F.col("matched")) / (F.col("n") * (F.col("n") - 1)) - F.col("matched") / F.col("n"), 4).alias("gain"))


@query("""with r as (select conv_id, role, text, row_number() over (partition by conv_id, role order by turn, text) as i from conversations), a as (select * from r where role = 'user'), b as (select * from r where role = 'assistant')
 select coalesce(a.conv_id, b.conv_id) as conv_id, count(*) as places, count(*) filter (a.text is null or b.text is null) as alone, count(*) filter (length(a.text) > length(b.text)) as longer from a full join b on a.conv_id = b.conv_id and a.i = b.i group by all""")
def positional_diff(t):
    """Two sides joined place by place."""
    i = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text"))
    r = t("conversations").select("conv_id", "role", "text", i.alias("i"))
    a, b = (r.filter(F.col("role") == x).select("conv_id", "i", F.col("text").alias(n)) for x, n in (("user", "ta"), ("assistant", "tb")))
    j = a.join(b, ["conv_id", "i"], "full_outer")
    return j.groupBy("conv_id").agg(F.count("*").alias("places"), F.count_if(F.col("ta").isNull() | F.col("tb").isNull()).alias("alone"), F.count_if(F.length("ta") > F.length("tb")).alias("longer"))


@query(f"with b as (select distinct unnest({TOK.format('text')}) as tok from benchmark), d as (select distinct unnest({TOK.format('text')}) as tok from documents) select count(d.tok) as covered, count(*) as vocabulary, round(count(d.tok) / count(*), 6) as coverage from b left join d using (tok)")
def vocabulary_coverage(t):
    """Share of a vocabulary that a corpus uses."""
    words = [t(x).select(F.explode(tx.tokens(F.col("text"))).alias("tok")) for x in ("benchmark", "documents")]
    c = overlap.leakage(*words, "tok")
    return c.select(F.col("leaked").alias("covered"), F.col("total").alias("vocabulary"), r6("rate").alias("coverage"))


@query("""with h as (select n_name as name, c_custkey % 2 as half, avg(c_acctbal) as m from customer join nation on c_nationkey = n_nationkey group by all), r as (select name, row_number() over (partition by half order by m, name) as place from h)
 select name, max(place) - min(place) as range from r group by all""")
def rank_stability(t):
    """How far an item's rank moves between two halves."""
    h = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name"), (F.col("c_custkey") % 2).alias("half")).agg(F.avg("c_acctbal").alias("m"))
    r = h.withColumn("place", F.row_number().over(Window.partitionBy("half").orderBy("m", "name")))
    return r.groupBy("name").agg((F.max("place") - F.min("place")).cast("long").alias("range"))


@query("with r as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as i from conversations) select conv_id, string_agg(role || ': ' || text, chr(10) order by turn, role, text) as block from r where i <= 3 group by all")
def transcript_block(t):
    """The last three rows of a conversation as one text."""
    rows = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    last = t("conversations").groupBy("conv_id").agg(rows.alias("r")).withColumn("r", F.slice("r", F.greatest(F.size("r") - 2, F.lit(1)), 3))
    return last.select("conv_id", F.array_join(F.transform("r", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("block"))


@query("select source, count(*) as texts, cast(sum(n) as bigint) as chars from (select distinct source, text, length(text) as n from documents) group by all")
def distinct_volume(t):
    """Volume of each source with every text counted once."""
    d = t("documents").groupBy("source", F.sha2("text", 256).alias("f")).agg(F.max(F.length("text")).alias("n"))
    return d.groupBy("source").agg(F.count("*").alias("texts"), F.sum("n").alias("chars"))


@query(f"with w as (select distinct item_id, unnest({TOK.format('text')}) as tok from benchmark), l as (select item_id, tok, 1.0 / count(*) over (partition by tok) as literal from w) select item_id, tok, round(literal, 6) as literal, round(literal * literal / sum(literal * literal) over (partition by item_id), 6) as speaker from l")
def listener_speaker(t):
    """A literal listener's weights and the speaker's normalised powers of them."""
    w = t("benchmark").select("item_id", F.explode(tx.token_set(F.col("text"))).alias("tok"))
    lit = w.join(w.groupBy("tok").agg((1 / F.count("*")).alias("l")), "tok")
    power = F.col("l") * F.col("l")
    return lit.select("item_id", "tok", r6("l").alias("literal"), r6(power / F.sum(power).over(Window.partitionBy("item_id"))).alias("speaker"))


@query("with r as (select user_id, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as age from events) select user_id, count(*) filter (pow(0.5, age / 10.0) >= 0.05) as live, round(sum(pow(0.5, age / 10.0)), 6) as weight from r group by all")
def decayed_weights(t):
    """Weights that halve every ten rows of a sequence, and how many are live."""
    age = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) - 1
    r = t("events").select("user_id", F.pow(F.lit(0.5), age / 10).alias("w"))
    return r.groupBy("user_id").agg(F.count_if(F.col("w") >= 0.05).alias("live"), r6(F.sum("w")).alias("weight"))


# What SQL cannot state, or not without state; tests hold these against brute force.

LEXICON = Lexicon({"R": ("mo", "ta", "re", "li", "su"), "O": ("un", "ap"), "L": ("fe", "wo"), "A": ("zi",), "M": ("ma",), "D": ("da",), "Q": ("qu",), "T": ("ti", "te"), "F": ("ka", "ki", "ko")}, closer="sa")


@query()
def permutation_null(t):
    """Token overlap at lag 1 against randomly paired turns."""
    return measures.permutation_null(turn_sets(t), "conv_id", TURN, "roots")


@query()
def cluster_bootstrap(t):
    """Interval of a mean, resampling users."""
    return measures.cluster_bootstrap(t("events"), "user_id", "value")


@query()
def exact_limiter(t):
    """M7: the limiter that does not remember what it refused."""
    e = t("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("at"))
    return limiter.admit(e, 3, 86400.0)


#: rows of a range in which documents are numbered with their words
UTTERANCES = 20_000


def utterances(t) -> DataFrame:
    """Documents as rows of a repetition log: in the bucket of their first word, by doc_id on one clock, with their different words."""
    words = tx.token_set("text")
    first = F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), "[a-z]+", 0)
    # words hold letters alone, so their digest tells sets apart; rows that do without the words stay narrow
    rows = t("documents").select(F.col("doc_id").alias("id"), first.alias("bucket"), words.alias("items")).withColumn("digest", F.md5(F.array_join("items", " ")))
    return sequences.numbered(rows, "id", ["bucket", "digest"], rows=UTTERANCES)


_DECAYED = "m.weight * pow(0.5, ({0} - m.last) / 64.0)"
#: the log as a fold: each step takes the next row of every bucket
LOG_SQL = f"""u as (select doc_id as id, regexp_extract(lower(coalesce(text, '')), '[a-z]+') as bucket, row_number() over (order by doc_id) as seq, list_distinct({TOK.format('text')}) as items from documents),
 o as (select *, row_number() over (partition by bucket order by seq) as i from u),
 f as (
  select null::bigint as id, bucket, 0::bigint as seq, 0::bigint as i, null::double as nearest, null::double as weight, 0.0::double as cost, false as repeated, 0 as hits, []::struct(weight double, last bigint, hits int, items varchar[])[] as log from (select distinct bucket from o)
  union all
  select id, bucket, seq, i, best.d, best.w, case when best is null then 0.0 else greatest(0.0, least(1.0, best.w * (1 - best.d))) end, again is not null, coalesce(again.hits, 0) + 1,
   case when again is not null then list_transform(log, lambda m: case when m.last = again.last then struct_pack(weight := {_DECAYED.format('seq')} + 1, last := seq, hits := m.hits + 1, items := m.items) else m end)
   when len(log) < 8 then log || [struct_pack(weight := 1.0::double, last := seq, hits := 1, items := items)]
   else list_transform(list_sort(list_transform(log || [struct_pack(weight := 1.0::double, last := seq, hits := 1, items := items)], lambda m: struct_pack(w := {_DECAYED.format('seq')}, l := m.last, m := m)))[2:], lambda x: x.m) end
  from (select *, list_filter(live, lambda x: x.d = list_min(list_transform(live, lambda y: y.d)))[1] as best, list_filter(log, lambda m: len(m.items) = len(items) and len(list_intersect(m.items, items)) = len(items))[1] as again
   from (select o.id, o.bucket, o.seq, o.i, o.items, f.log, list_filter(list_transform(f.log, lambda m: struct_pack(w := {_DECAYED.format('(o.seq - 1)')},
     d := case when len(m.items) + len(o.items) = 0 then 0.0::double else 1 - len(list_intersect(m.items, o.items))::double / len(list_distinct(m.items || o.items)) end)), lambda x: x.w >= 0.02) as live
    from f join o on o.bucket = f.bucket and o.i = f.i + 1)))"""


@query(f"with recursive {LOG_SQL} select id, bucket, seq, round(nearest, 6) as nearest, round(weight, 6) as weight, round(cost, 6) as cost, repeated, hits::int as hits, len(log)::int as medoids from f where i > 0")
def repetition_log(t):
    """Novelty of each document against the log of its bucket."""
    return repetition.replay(utterances(t)).withColumns({c: r6(c) for c in ("nearest", "weight", "cost")})


@query(f"""with recursive {LOG_SQL}, n as (select max(seq) as now from u), e as (select bucket, unnest(log) as m from f where (bucket, i) in (select bucket, max(i) from f group by bucket) and len(log) > 0)
 select bucket, count(*) as medoids, count(*) filter ({_DECAYED.format('now')} >= 0.02) as live, sum(m.hits)::bigint as hits, round(sum({_DECAYED.format('now')}), 6) as weight from e, n group by bucket""")
def repetition_medoids(t):
    """The log after the last document: its medoids, those a sweep would keep, and their weight."""
    # without scores the log only asks which sets are equal
    rows = utterances(t).withColumn("items", F.array("digest"))
    now = rows.agg(F.count("*").alias("now"))  # the clock counts the rows
    log = repetition.medoids(rows).crossJoin(F.broadcast(now))  # one row
    w = repetition.decayed_weight(F.col("now"))
    return log.groupBy("bucket").agg(F.count("*").alias("medoids"), F.count_if(w >= 0.02).alias("live"), F.sum("hits").alias("hits"), r6(F.sum(w)).alias("weight"))


@query()
def generated_chains(t):
    """Chains over the observed transition map."""
    grid = sequences.transition_grid(t("events"), "user_id", AT, "event_type").select("prior", "following", "share").collect()
    moves: dict[str, dict[str, float]] = {}
    for r in grid:
        moves.setdefault(r.prior, {})[r.following] = r.share or 0.0
    return generators.chains(t("events").sparkSession, 500, 12, moves, seed=7)


@query()
def balanced_corpus(t):
    """Forms exposed equally often."""
    return generators.balanced(t("events").sparkSession, 1000, list(LEXICON.classes["R"]), seed=3)


def _surfaces(t) -> DataFrame:
    """Surfaces over the demonstration lexicon, made from the numbers of the events."""
    c = LEXICON.classes
    pick = lambda forms, salt: F.element_at(F.array(*map(F.lit, forms)), (F.pmod(F.xxhash64("event_id", F.lit(salt)), F.lit(len(forms))) + 1).cast("int"))
    clause = F.when(F.pmod("event_id", F.lit(3)) > 0, F.concat_ws(" ", pick(c["L"], 1), pick(c["O"], 2), pick(c["R"], 3), F.lit("zizisa")))
    return t("events").select("event_id", F.concat_ws(" ", pick(("qu", "ti", "ta"), 4), clause, pick(c["R"], 5), pick(c["F"], 6)).alias("surface"))


@query()
def parse_legality(t):
    """Legality as a native expression."""
    return _surfaces(t).select("event_id", "surface", legal(F.col("surface"), LEXICON).alias("legal"))


@query()
def scene_node_table(t):
    """The node table of the legal surfaces."""
    return scene_nodes(_surfaces(t), "event_id", "surface", LEXICON)
