"""Registered queries of stores and stateful rules: audit rows, bans, conversations, budgets, baselines, class errors.

Registered beside the queries of ``skein.queries``, each with its DuckDB SQL where SQL can state it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.functions.grammar import residue, scene_distances
from skein.operators import sequences
from skein.plans import verdicts
from skein.queries import AT, LEXICON, PAIRS, SETS, TOK, TURN, _surfaces, query, r6, turn_sets

RUN = ["run_id", "row_id"]
#: events as rows of an audit store: a value under 30 is refused, a value that the run had before collides
AUDIT = """u as (select user_id as run_id, event_id as row_id, cast(round(value) as bigint) as utterance_id, value >= 30 as accepted, 1 + event_id % 3 as ambiguity, ts from events),
 x as (select *, min(row_id) filter (accepted) over (partition by run_id, utterance_id order by row_id rows between unbounded preceding and 1 preceding) as collides_with from u)"""


def _audit(t) -> DataFrame:
    u = t("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("row_id"), F.round("value").cast("long").alias("utterance_id"), (F.col("value") >= 30).alias("accepted"), (1 + F.col("event_id") % 3).alias("ambiguity"), "ts")
    w = Window.partitionBy("run_id", "utterance_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    return u.withColumn("collides_with", F.min(F.when(F.col("accepted"), F.col("row_id"))).over(w))


@query(f"with {AUDIT} select run_id, row_id, utterance_id, collides_with from x where accepted and collides_with is not null")
def collisions(t):
    """Accepted rows that repeat an utterance of their run, with the first row that had it."""
    return _audit(t).filter("accepted and collides_with is not null").select("run_id", "row_id", "utterance_id", "collides_with")


@query(f"""with {AUDIT} select run_id, count(*) filter (accepted) as accepted, count(*) filter (accepted and collides_with is not null) as collided, count(distinct utterance_id) as distinct_utterances, count(*) filter (ambiguity > 1) as ambiguous,
 count(*) filter (not accepted and ambiguity = 3) as refused_ambiguous, count(*) filter (accepted) >= 5 and not (count(*) filter (accepted and collides_with is not null) > count(*) filter (accepted) / 2) as consistent from x group by all""")
def audit_counters(t):
    """Counters of each run of the audit store in one pass."""
    a, c = F.col("accepted"), F.col("collides_with").isNotNull()
    return _audit(t).groupBy("run_id").agg(
        F.count_if(a).alias("accepted"), F.count_if(a & c).alias("collided"), F.count_distinct("utterance_id").alias("distinct_utterances"), F.count_if(F.col("ambiguity") > 1).alias("ambiguous"),
        F.count_if(~a & (F.col("ambiguity") == 3)).alias("refused_ambiguous"), ((F.count_if(a) >= 5) & ~(F.count_if(a & c) > F.count_if(a) / 2)).alias("consistent"),
    )


@query(f"""with {AUDIT}, d as (select run_id, day(ts) as as_of, count(*) as total, count(*) filter (accepted) as passed, case when count(*) filter (accepted) >= 2 then 'MEASURED' else 'PENDING' end as state from x group by all),
 p as (select *, row_number() over (partition by run_id order by as_of desc) as k from d where state = 'MEASURED'), s as (select run_id, state, row_number() over (partition by run_id order by as_of desc) as k from d)
 select s.run_id, s.state as latest_state, p.as_of as published_as_of, p.total, round(p.passed / p.total, 6) as pass_rate from s left join p on p.run_id = s.run_id and p.k = 1 where s.k = 1""")
def publishable_counters(t):
    """Q1, Q5, Q6, Q9-Q11: each run's latest auditor state, and its latest counter that may be published."""
    d = _audit(t).groupBy("run_id", F.dayofmonth("ts").alias("as_of")).agg(F.count("*").alias("total"), F.count_if("accepted").alias("passed"))
    d = d.withColumn("state", F.when(F.col("passed") >= 2, "MEASURED").otherwise("PENDING"))
    measured = F.when(F.col("state") == "MEASURED", F.col("as_of"))
    row = F.struct("as_of", "total", (F.col("passed") / F.col("total")).alias("rate"))
    g = d.groupBy("run_id").agg(F.max_by("state", "as_of").alias("latest_state"), F.max_by(row, measured).alias("p"), F.max(measured).alias("m"))
    p = lambda c: F.when(F.col("m").isNotNull(), F.col("p")[c])
    return g.select("run_id", "latest_state", p("as_of").cast("long").alias("published_as_of"), p("total").alias("total"), r6(p("rate")).alias("pass_rate"))


@query(f"with {AUDIT} select row_id, run_id, utterance_id from x where not accepted order by sha256(cast(row_id as varchar)) limit 5")
def refused_sample(t):
    """Q17: five refused rows in an order that a hash decides, so the sample can be drawn again."""
    return _audit(t).filter("not accepted").orderBy(F.sha2(F.col("row_id").cast("string"), 256)).limit(5).select("row_id", "run_id", "utterance_id")


NOW = "timestamp '2024-02-01'"
BANS = "b as (select user_id as reader, ts as banned_at, event_type = 'refund' as lifted, case when value < 50 then ts + interval 7 day end as until, event_id from events where event_type in ('refund', 'error')), l as (select * from (select *, row_number() over (partition by reader order by banned_at desc, event_id desc) as k from b) where k = 1)"


@query(f"with {BANS}, v as (select reader, case when lifted then 'lifted' when until is null then 'permanent' when until <= {NOW} then 'expired' else 'until' end as state from l), n as (select user_id as reader, count(*) filter (value < 5) as untrusted from events group by all) select reader, state, untrusted, state in ('permanent', 'until') and untrusted = 0 as banned from v join n using (reader)")
def ban_states(t):
    """The latest row of each reader decides; expired and lifted bans do not count, nor those of readers with untrusted rows."""
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    until = F.when(F.col("value") < 50, F.col("ts") + F.expr("interval 7 days"))
    state = F.when(F.col("event_type") == "refund", "lifted").when(until.isNull(), "permanent").when(until <= F.lit("2024-02-01").cast("timestamp"), "expired").otherwise("until")
    last = e.filter("event_type in ('refund', 'error')").groupBy(F.col("user_id").alias("reader")).agg(F.max_by(state, F.struct("ts", "event_id")).alias("state"))
    n = e.groupBy(F.col("user_id").alias("reader")).agg(F.count_if(F.col("value") < 5).alias("untrusted"))
    return last.join(n, "reader").select("reader", "state", "untrusted", (F.col("state").isin("permanent", "until") & (F.col("untrusted") == 0)).alias("banned"))


@query("select c as conv_id, count(conv_id) > 0 as known, max(turn) as last_turn, count(conv_id) as messages, coalesce(max(turn) + 1, 0) as following from (select distinct user_id as c from events) left join conversations on conv_id = c group by all")
def conversation_heads(t):
    """Of the conversations that the events' users ask for, whether they exist, their last turn and the next one; unknown ones begin at 0."""
    asked = t("events").select(F.col("user_id").alias("c")).distinct()
    heads = t("conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("messages"))
    return asked.join(heads, F.col("c") == F.col("conv_id"), "left").select(F.col("c").alias("conv_id"), F.col("messages").isNotNull().alias("known"), "last_turn", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce(F.col("last_turn") + 1, F.lit(0)).alias("following"))


@query("""with e as (select user_id, event_id, value / 10 as cost, row_number() over (partition by user_id order by ts, event_id) as i from events), s as (select *, coalesce(sum(cost) over (partition by user_id order by i rows between unbounded preceding and 1 preceding), 0) as before from e),
 d as (select *, cost <= greatest(0, 30 - before) as fits from s), c as (select *, sum((not fits)::int) over (partition by user_id order by i) as bad, lag(fits) over (partition by user_id order by i) as was from d)
 select user_id, event_id, case when bad = 0 then 'ACCEPT' else 'CLOSE' end as closing, case when fits then 'ACCEPT' else 'REPEAT' end as alive, round(case when bad = 0 then greatest(0, 30 - before - cost) end, 6) as remaining from c""")
def orbit_budget(t):
    """What an arc of a bounded budget accepts. Spending is a running sum, so the state is a window: closed at the first cost that does not fit, or kept alive."""
    w = Window.partitionBy("user_id").orderBy(*AT)
    before = F.coalesce(F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = t("events").withColumn("cost", F.col("value") / 10).withColumn("before", before).withColumn("fits", F.col("cost") <= F.greatest(F.lit(0.0), 30 - F.col("before")))
    bad = F.sum((~F.col("fits")).cast("int")).over(w)
    d = d.withColumn("bad", bad)
    return d.select("user_id", "event_id", F.when(F.col("bad") == 0, "ACCEPT").otherwise("CLOSE").alias("closing"), F.when(F.col("fits"), "ACCEPT").otherwise("REPEAT").alias("alive"), r6(F.when(F.col("bad") == 0, F.greatest(F.lit(0.0), 30 - F.col("before") - F.col("cost")))).alias("remaining"))


@query("""with e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n from events)
 select user_id, n as rewards, round(sum(value * case when i = 1 then pow(0.99, n - 1) else 0.01 * pow(0.99, n - i) end), 4) as baseline from e group by all""")
def reward_baseline(t):
    """The moving average of each referent's rewards, in closed form instead of a fold."""
    w = Window.partitionBy("user_id")
    e = t("events").select("user_id", "value", F.row_number().over(w.orderBy(*AT)).alias("i"), F.count("*").over(w).alias("n"))
    weight = F.when(F.col("i") == 1, F.pow(F.lit(0.99), F.col("n") - 1)).otherwise(0.01 * F.pow(F.lit(0.99), F.col("n") - F.col("i")))
    return e.groupBy("user_id", F.col("n").alias("rewards")).agg(F.round(F.sum(F.col("value") * weight), 4).alias("baseline"))


@query("select conv_id, turn, i from (select conv_id, turn, i, row_number() over (partition by conv_id order by md5(concat('7:', conv_id, '.', i))) as k from (select conv_id, turn, row_number() over (partition by conv_id order by turn, role, text) - 1 as i from conversations)) where k <= 2")
def injection_plan(t):
    """Two seeded rows of every conversation at which to inject."""
    w = Window.partitionBy("conv_id")
    n = t("conversations").select("conv_id", "turn", (F.row_number().over(w.orderBy(*TURN)) - 1).cast("long").alias("i"))
    k = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("7:"), "conv_id", F.lit("."), "i"))))
    return n.withColumn("k", k).filter("k <= 2").drop("k")


@query("with c as (select conv_id, length(coalesce(text, '')) > 20 as valid, row_number() over (partition by conv_id order by turn, role, text) as i from conversations), s as (select *, coalesce(sum(valid::int) over (partition by conv_id order by i rows between unbounded preceding and 1 preceding), 0) + (conv_id % 2) as shown from c) select conv_id, cast(max(shown) as bigint) as most_shown, count(*) filter (valid) as n_valid, max(shown) >= 0.75 * (count(*) filter (valid) + 1) as shared from s group by all")
def store_was_shared(t):
    """Whether a transcript shows that its speakers saw the whole store."""
    w = Window.partitionBy("conv_id").orderBy(*TURN)
    c = t("conversations").withColumn("valid", F.length(F.coalesce("text", F.lit(""))) > 20)
    shown = F.coalesce(F.sum(F.col("valid").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("conv_id") % 2
    g = c.withColumn("shown", shown).groupBy("conv_id").agg(F.max("shown").alias("most_shown"), F.count_if("valid").alias("n_valid"))
    return g.withColumn("shared", F.col("most_shown") >= 0.75 * (F.col("n_valid") + 1))


#: forms of the demonstration lexicon with their classes, and slots that a proposal fills with every seventh form
FORMS = [(c, f) for c, forms in sorted(LEXICON.classes.items()) for f in forms]
SLOTS = "R O L A M D Q T F".split()
PROPOSED = f"lex as (select * from (values {', '.join(f'({i}, {c!r}, {f!r})' for i, (c, f) in enumerate(FORMS))}) v(k, class, form)), p as (select event_id, s.expected, s.j, coalesce(lex.form, 'zz') as form from events, (values {', '.join(f'({j}, {c!r})' for j, c in enumerate(SLOTS))}) s(j, expected) left join lex on lex.k = (event_id * 7 + s.j * 3) % {len(FORMS) + 2})"


def _proposals(t) -> DataFrame:
    names = F.array(*map(F.lit, names_of()))
    slots = t("events").select("event_id", F.posexplode(F.array(*map(F.lit, SLOTS))).alias("j", "expected"))
    return slots.withColumn("form", F.element_at(names, ((F.col("event_id") * 7 + F.col("j") * 3) % len(names_of()) + 1).cast("int")))


def names_of() -> list[str]:
    """Every form, and two that are in no class."""
    return [*(f for _, f in FORMS), "zz", "zz"]


@query(f"with {PROPOSED}, e as (select p.expected, lex.class as actual from p left join lex using (form) where lex.class is distinct from p.expected) select expected, coalesce(actual, '-') as actual, count(*) as n, coalesce(actual, '-') = '-' as invented from e group by all")
def class_errors(t):
    """Every slot of a proposal against the class of its form: invented forms and forms of another class, by confusion."""
    lex = t("events").sparkSession.createDataFrame(FORMS, "actual string, form string")
    e = _proposals(t).join(F.broadcast(lex), "form", "left").filter(~F.col("actual").eqNullSafe(F.col("expected")))
    n = e.groupBy("expected", F.coalesce("actual", F.lit("-")).alias("actual")).agg(F.count("*").alias("n"))
    return n.withColumn("invented", F.col("actual") == "-")


@query(f"with {PROPOSED}, e as (select least(p.expected, lex.class) as a, greatest(p.expected, lex.class) as b from p join lex using (form) where lex.class <> p.expected) select a, b, count(*) as n from e group by all")
def class_boundaries(t):
    """A5: unordered pairs of classes that are taken for each other."""
    lex = t("events").sparkSession.createDataFrame(FORMS, "actual string, form string")
    e = _proposals(t).join(F.broadcast(lex), "form").filter("actual <> expected")
    return e.groupBy(F.least("expected", "actual").alias("a"), F.greatest("expected", "actual").alias("b")).agg(F.count("*").alias("n"))


@query("""with r as (select event_id, case when event_type <> 'view' then [floor(value)::bigint % 5, length(props) % 3, user_id % 2] end as a, case when event_type <> 'view' then [floor(value)::bigint % 4, length(event_type) % 6, 1] end as b from events)
 select event_id, case when a is null then 0 else abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3]) end as distance, round(case when a is null then 0 else least(1.0, (abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3])) / 12.0) end, 6) as normalised from r""")
def residue_distance(t):
    """L1 distance of residues on a lattice of span 4, and its share of the largest; two unknown residues are equal, one unknown or other sizes are refused."""
    known = F.col("event_type") != "view"
    whole = F.floor("value").cast("long")
    a, b = F.array(whole % 5, F.length("props") % 3, F.col("user_id") % 2), F.array(whole % 4, F.length("event_type") % 6, F.lit(1).cast("long"))
    r = t("events").select("event_id", F.when(known, a).alias("a"), F.when(known, b).alias("b"))
    d = residue(F.col("a"), F.col("b"))
    return r.select("event_id", d.alias("distance"), r6(F.least(F.lit(1.0), F.coalesce(d / (4 * F.size("a")), F.lit(0.0)))).alias("normalised"))


@query("with k as (select p_brand || '|' || split_part(p_type, ' ', 1) as sig, count(*) as n, min(p_partkey) as first from part group by all) select sig, n, first from k where n > 1")
def signature_clusters(t):
    """Referents of one signature."""
    k = t("part").groupBy(F.concat_ws("|", "p_brand", F.split_part("p_type", F.lit(" "), F.lit(1))).alias("sig"))
    return k.agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).filter("n > 1")


@query("with d as (select user_id % 2 = 0 as repeated, event_type || ':' || cast(cast(floor(value / 5) as bigint) as varchar) as form from events), r as (select repeated, count(distinct form) / count(*) as ratio, count(*) as n from d group by all) select max(n) filter (repeated) as n_repeated, max(n) filter (not repeated) as n_varied, round(max(ratio) filter (repeated), 6) as repeated_ratio, round(max(ratio) filter (not repeated), 6) as varied_ratio, round(max(ratio) filter (not repeated) - max(ratio) filter (repeated), 6) as gap from r")
def diversity_gap(t):
    """Share of distinct forms among samples of one history and of varied ones."""
    form = F.concat_ws(":", "event_type", F.floor(F.col("value") / 5).cast("long").cast("string"))
    r = t("events").select((F.col("user_id") % 2 == 0).alias("repeated"), form.alias("form")).groupBy("repeated").agg(F.count_distinct("form").alias("k"), F.count("*").alias("n")).withColumn("ratio", F.col("k") / F.col("n"))
    pick = lambda c, m: F.max(F.when(F.col("repeated") == m, F.col(c)))
    return r.agg(pick("n", True).alias("n_repeated"), pick("n", False).alias("n_varied"), r6(pick("ratio", True)).alias("repeated_ratio"), r6(pick("ratio", False)).alias("varied_ratio"), r6(pick("ratio", False) - pick("ratio", True)).alias("gap"))


@query("""with l as (select user_id % 3 as arm, user_id, arg_max(value >= 50, struct_pack(a := ts, b := event_id)) as ok from events group by all), p as (select a.user_id // 3 as item, a.ok as a, b.ok as b from l a join l b on a.arm = 0 and b.arm = 1 and a.user_id // 3 = b.user_id // 3)
 select count(*) as items, count(*) filter (a and not b) as only_a, count(*) filter (b and not a) as only_b, count(*) filter (a = b) as alike from p""")
def latest_compare(t):
    """The latest outcome of every item under two arms, item by item."""
    last = t("events").groupBy("user_id").agg(F.max_by(F.col("value") >= 50, F.struct("ts", "event_id")).alias("ok"))
    item = last.select(F.floor(F.col("user_id") / 3).alias("item"), (F.col("user_id") % 3).alias("arm"), "ok")
    p = item.filter("arm = 0").select("item", F.col("ok").alias("a")).join(item.filter("arm = 1").select("item", F.col("ok").alias("b")), "item")
    return p.agg(F.count("*").alias("items"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"), F.count_if(F.col("a") == F.col("b")).alias("alike"))


@query("""with e as (select user_id, value >= 60 as ok, row_number() over (partition by user_id order by ts, event_id) as i from events), g as (select user_id, bool_or(ok) filter (i = 1) as base, bool_or(ok) filter (i between 2 and 4) as any_k, count(*) filter (i between 2 and 4) as tries, count(*) filter (i between 2 and 4 and ok) as hits from e group by all having count(*) >= 4)
 select base, count(*) as n, count(*) filter (any_k) as rescued, round(avg(any_k::int), 6) as rate, round(sum(hits) / sum(tries), 6) as per_attempt from g group by all""")
def rescue_rates(t):
    """Of items that first missed or hit, how often one of three further attempts carries."""
    e = t("events").select("user_id", (F.col("value") >= 60).alias("ok"), F.row_number().over(Window.partitionBy("user_id").orderBy(*AT)).alias("i"))
    later = F.col("i").between(2, 4)
    g = e.groupBy("user_id").agg(F.count("*").alias("all"), F.bool_or(F.when(F.col("i") == 1, F.col("ok"))).alias("base"), F.bool_or(F.when(later, F.col("ok"))).alias("any_k"), F.count_if(later).alias("tries"), F.count_if(later & F.col("ok")).alias("hits")).filter("all >= 4")
    return g.groupBy("base").agg(F.count("*").alias("n"), F.count_if("any_k").alias("rescued"), r6(F.avg(F.col("any_k").cast("int"))).alias("rate"), r6(F.sum("hits") / F.sum("tries")).alias("per_attempt"))


@query("select user_id, cast(list_aggregate(list_sort(list_distinct(list_filter(list_transform(range(0, 5), lambda i: round_even(n / pow(2, i), 0)::int), lambda x: x >= 1))), 'string_agg', ',') as varchar) as steps from (select user_id, count(*) as n from events group by all)")
def checkpoint_steps(t):
    """Where to read a run of n steps: halved back from the end, half to even, each step once."""
    n = t("events").groupBy("user_id").agg(F.count("*").alias("n"))
    halves = F.array(*(F.bround(F.col("n") / 2**i).cast("int") for i in range(5)))
    return n.select("user_id", F.array_join(F.array_sort(F.array_distinct(F.filter(halves, lambda x: x >= 1))), ",").alias("steps"))


@query(f"""with k as (select user_id, event_type as prior, lead(event_type) over (partition by user_id order by ts, event_id) as following from events), g as (select prior, following, count(*) as n, count(distinct user_id) as sources from k where following is not null group by all)
 select prior, following, n, sources, round(n / sum(n) over (partition by prior), 6) as p, row_number() over (partition by prior order by n desc, following) as place from g""")
def successor_kernel(t):
    """The empirical kernel: successors of a state, how often, from how many chains, and their place."""
    s = sequences.successors(t("events"), "user_id", AT, "event_type").filter("s1 is not null")
    g = s.groupBy(F.col("event_type").alias("prior"), F.col("s1").alias("following")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("sources"))
    w = Window.partitionBy("prior")
    return g.select("prior", "following", "n", "sources", r6(F.col("n") / F.sum("n").over(w)).alias("p"), F.row_number().over(w.orderBy(F.desc("n"), "following")).cast("long").alias("place"))


@query("select conv_id, count(*) as turns, sha256(string_agg(concat('[', turn, ',', length(coalesce(text, '')), ']'), '' order by turn, role, text)) as chain from conversations group by all")
def nested_chains(t):
    """Chains as nested rows, digested in order."""
    row = F.struct("turn", "role", "text")
    c = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    each = F.transform("r", lambda x: F.concat(F.lit("["), x["turn"].cast("string"), F.lit(","), F.length(F.coalesce(x["text"], F.lit(""))).cast("string"), F.lit("]")))
    return c.select("conv_id", F.size("r").cast("long").alias("turns"), F.sha2(F.array_join(each, ""), 256).alias("chain"))


@query(f"with k as (select conv_id, turn, role, {TOK.format('text')} as toks from conversations) select conv_id, turn, role, coalesce(toks[1], '') as first, coalesce(list_filter(toks, lambda x: length(x) > 4)[-1], '') as root from k")
def edge_tokens(t):
    """The first token of a turn, and its last one that can be a root."""
    k = t("conversations").withColumn("toks", tx.tokens(F.col("text")))
    roots = F.filter("toks", lambda x: F.length(x) > 4)
    return k.select("conv_id", "turn", "role", F.coalesce(F.get("toks", F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.when(F.size(roots) > 0, F.element_at(roots, -1)), F.lit("")).alias("root"))


@query(f"""with {PAIRS.replace('select event_type', 'select user_id, event_type')}, x as (select user_id, count(*) as n, count(*) filter (following = 'purchase') as hit, count(distinct following) / count(*) as ratio from p where following is not null group by all)
 select count(*) as k, round(avg(hit / n), 6) as mean, round(stddev_samp(hit / n), 6) as sd, round(stddev_samp(hit / n) / sqrt(count(*)), 6) as se, round(sum(hit) / sum(n), 6) as pooled, count(*) filter (ratio < 0.5) as degenerate, round(min(ratio), 6) as least_ratio, round((0.3 - avg(hit / n)) / (0.3 - 0.1), 6) as closes from x""")
def build_spread(t):
    """Rates of builds: mean, spread, pooled rate, degenerate builds counted and not dropped, and the share of a gap they close."""
    s = sequences.successors(t("events"), "user_id", AT, "event_type").filter("s1 is not null")
    x = s.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("s1") == "purchase").alias("hit"), F.count_distinct("s1").alias("d"))
    rate, ratio = F.col("hit") / F.col("n"), F.col("d") / F.col("n")
    return x.agg(F.count("*").alias("k"), r6(F.avg(rate)).alias("mean"), r6(F.stddev_samp(rate)).alias("sd"), r6(F.stddev_samp(rate) / F.sqrt(F.count("*"))).alias("se"), r6(F.sum("hit") / F.sum("n")).alias("pooled"), F.count_if(ratio < 0.5).alias("degenerate"), r6(F.min(ratio)).alias("least_ratio"), r6((0.3 - F.avg(rate)) / (0.3 - 0.1)).alias("closes"))


@query("""with h as (select n_name as name, c_custkey % 4 as build, avg(c_acctbal) as m from customer join nation on c_nationkey = n_nationkey group by all), r as (select name, build, row_number() over (partition by build order by m, name) as place from h), g as (select name, max(place) - min(place) as moved from r group by all), s as (select name, stddev_samp(m) / abs(avg(m)) as upper from h group by all)
 select name, moved, coalesce(moved <= 2 and upper < 0.5, false) as admitted, case when count(*) filter (moved <= 2 and upper < 0.5) over () = 0 then 'HALT' when count(*) filter (moved <= 2 and upper < 0.5) over () < 3 then 'NARROW' else 'PANEL' end as verdict from g join s using (name)""")
def admitted_panel(t):
    """Observables whose rank holds between builds and whose limit is low, and what their number allows."""
    h = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name"), (F.col("c_custkey") % 4).alias("build")).agg(F.avg("c_acctbal").alias("m"))
    place = F.row_number().over(Window.partitionBy("build").orderBy("m", "name"))
    g = h.withColumn("place", place).groupBy("name").agg((F.max("place") - F.min("place")).cast("long").alias("moved"), (F.stddev_samp("m") / F.abs(F.avg("m"))).alias("upper"))
    g = g.withColumn("admitted", verdicts.admitted(F.col("moved"), F.col("upper")))
    return g.select("name", "moved", "admitted", verdicts.panel(F.count_if("admitted").over(Window.partitionBy())).alias("verdict"))


@query(f"""with t as (select conv_id, row_number() over (partition by conv_id order by turn, role, text) as i, {TOK.format('text')} as toks from conversations), b as (select conv_id, i, len(toks) as n, unnest(toks) as w from t), c as (select conv_id, i, n, w, count(*) as k from b group by all),
 o as (select a.conv_id, a.i as x, y.i as y, sum(least(a.k, y.k)) / greatest(a.n, y.n) as o from c a join c y on a.conv_id = y.conv_id and a.w = y.w and a.i < y.i group by a.conv_id, a.i, y.i, a.n, y.n), m as (select conv_id, count(*) as n from t group by all having count(*) >= 2),
 r as (select conv_id, count(distinct w) / count(*) as ttr from b group by all), s as (select m.conv_id, m.n, coalesce(count(*) filter (o.o > 0.75), 0) / (m.n * (m.n - 1) / 2) as share from m left join o on o.conv_id = m.conv_id group by m.conv_id, m.n)
 select conv_id, n, round(ttr, 6) as ttr, round(share, 6) as near_repetition, coalesce(ttr < 0.5, false) as floor_fired, share > 0.5 as repetition_fired from s left join r using (conv_id)""")
def degeneracy(t):
    """Type-token ratio of a transcript and the share of its pairs of turns that all but repeat each other; one turn is no evidence."""
    w = Window.partitionBy("conv_id").orderBy(*TURN)
    k = t("conversations").select("conv_id", F.row_number().over(w).alias("i"), tx.tokens(F.col("text")).alias("toks"))
    n = k.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n >= 2")
    words = k.select("conv_id", F.explode("toks").alias("w")).groupBy("conv_id").agg((F.count_distinct("w") / F.count("*")).alias("ttr"))
    others = F.array_sort(F.collect_list(F.struct("i", "toks")))
    each = k.groupBy("conv_id").agg(others.alias("r")).join(k, "conv_id").withColumn("b", F.explode(F.slice("r", F.col("i") + 1, F.greatest(F.size("r") - F.col("i"), F.lit(0)))))
    near = each.groupBy("conv_id").agg(F.count_if(tx.multiset_overlap(F.col("toks"), F.col("b.toks")) > 0.75).alias("near"))
    s = n.join(near, "conv_id", "left").join(words, "conv_id", "left").withColumn("share", F.coalesce("near", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2))
    return s.select("conv_id", "n", r6("ttr").alias("ttr"), r6("share").alias("near_repetition"), F.coalesce(F.col("ttr") < 0.5, F.lit(False)).alias("floor_fired"), (F.col("share") > 0.5).alias("repetition_fired"))


@query()
def scene_distance(t):
    """Weighted edit distance of each legal scene to the one after it, and its share of the larger tree."""
    s = _surfaces(t)
    following = F.lead("surface").over(Window.partitionBy(F.floor(F.col("event_id") / 1000)).orderBy("event_id"))
    return scene_distances(s.withColumn("other", following).filter("other is not null"), "event_id", "surface", "other", LEXICON)
