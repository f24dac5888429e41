"""Registered queries of measurements: nulls, fidelity, contrasts, carry, synonyms, drift, panels, listeners.

Each is registered beside the queries of ``skein.queries``, with its DuckDB SQL where SQL can state it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import stats
from skein.functions import text as tx
from skein.operators import carry, inference, sequences
from skein.plans import verdicts
from skein.queries import AT, GRID, PAIRS, SETS, TOK, TURN, query, r6, turn_sets


def r4(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


# Nulls and verdicts over lags.

REPS, LAGS = 20, 4


@query(f"""with {SETS}, o as (select conv_id, roots, row_number() over (partition by conv_id order by turn, role, text) as i, count(*) over (partition by conv_id) as n from t),
 k as (select unnest(range(1, {LAGS + 1})) as lag), r as (select unnest(range(0, {REPS})) as rep),
 real as (select lag, avg(len(list_intersect(a.roots, b.roots))) as overlap, avg(least(len(a.roots), len(b.roots))) as most, count(*) as n_pairs from k join o a on true join o b on a.conv_id = b.conv_id and b.i = a.i + lag group by 1),
 x as (select lag, rep, roots, row_number() over (partition by lag, rep order by md5(concat('a:', rep, ':', lag, ':', conv_id, '.', i))) as place from o, k, r where i + lag <= n),
 y as (select lag, rep, roots, row_number() over (partition by lag, rep order by md5(concat('b:', rep, ':', lag, ':', conv_id, '.', i))) as place from o, k, r),
 m as (select lag, rep, avg(len(list_intersect(x.roots, y.roots))) as m from x join y using (lag, rep, place) group by all), s as (select lag, avg(m) as mu, stddev_samp(m) as sd from m group by all),
 z as (select *, (overlap - mu) / sd as z, case when lag = 1 then 6.0 else 3.0 end as threshold from real join s using (lag)),
 v as (select max(z) filter (lag = 1) as z1, max(z) filter (lag = 2) as z2, max(z) filter (lag > 1) as later from z)
 select lag, n_pairs, round(overlap, 6) as overlap, round(most, 6) as attainable, round(mu, 6) as null_mean, round(sd, 6) as null_sd, round(z, 4) as z, round((most - mu) / sd, 4) as resolving_power, threshold, (most - mu) / sd >= threshold as resolvable,
  case when z1 < 6 then 'not responsive' when later > 3 then 'content persists' else 'content-transient' end as verdict, z1 >= 6 and z2 > 3 as persistent, z1 <= 3 as content_free from z, v""")
def transience(t):
    """Overlap at each lag against turns re-paired at random without replacement, the most it could be, and the verdict."""
    return inference.transience(turn_sets(t), "conv_id", TURN, "roots", LAGS, REPS)


SQUARES = "m as (select prior, following, coalesce(n / nullif(row_n, 0), 0) as p from s), m0 as (select prior, following, (p + (prior = following)::int) / 2 as p from m), " + ", ".join(f"m{i + 1} as (select a.prior, b.following, sum(a.p * b.p) as p from m{i} a join m{i} b on a.following = b.prior group by all)" for i in range(12))


@query(f"""with {GRID}, {SQUARES}, st as (select following as kind, avg(p) as mass from m12 group by all), tv as (select m.prior as kind, 0.5 * sum(abs(m.p - st.mass)) as tv from m join st on st.kind = m.following group by all)
 select kind, round(mass, 6) as stationary, round(tv, 6) as distance, round((select sum(mass * tv) from st join tv using (kind)), 6) as separation from st join tv using (kind)""")
def stationary_map(t):
    """Stationary masses of the transition map, periodic or not, and its separation from independence."""
    return inference.stationary(sequences.transition_grid(t("events"), "user_id", AT, "event_type")).select("kind", r6("mass").alias("stationary"), r6("tv").alias("distance"), r6("separation").alias("separation"))


@query()
def map_fidelity(t):
    """Odd users' transitions against the even users' map and against independence, in bands simulated at their own row sizes."""
    e = t("events")
    grids = [sequences.transition_grid(e.filter(F.col("user_id") % 2 == k), "user_id", AT, "event_type") for k in (0, 1)]
    return inference.fidelity(*grids)


HITS = f"{PAIRS}, c as (select prior = 'click' as chosen, (following = 'purchase')::int as hit from p where following is not null and prior <> 'error'), h as (select sum(hit) filter (chosen) as a, count(*) filter (chosen) as an, sum(hit) filter (not chosen) as b, count(*) filter (not chosen) as bn from c)"
LOGS = "lgamma(an + 1) - lgamma(k + 1) - lgamma(an - k + 1) + lgamma(bn + 1) - lgamma(a + b - k + 1) - lgamma(bn - (a + b - k) + 1) - lgamma(an + bn + 1) + lgamma(a + b + 1) + lgamma(an + bn - a - b + 1)"


@query(f"""with {HITS}, k as (select *, unnest(range(greatest(0, a + b - bn)::bigint, least(an, a + b)::bigint + 1)) as k from h),
 q as (select sum(exp({LOGS})) filter (abs(k / an - (a + b - k) / bn) >= abs(a / an - b / bn) - 1e-12) as p from k)
 select cast(a as bigint) as pivot_hit, an as pivot_n, cast(b as bigint) as other_hit, bn as other_n, round(a / an, 6) as pivot_rate, round(b / bn, 6) as other_rate, round(p, 6) as p from h, q""")
def contrast_p(t):
    """The rate after one kind against the others with the exact p of shuffled labels; the forced kind is left out."""
    s = sequences.successors(t("events"), "user_id", AT, "event_type").filter("s1 is not null and event_type <> 'error'")
    return inference.contrast(s.select((F.col("event_type") == "click").alias("pivot"), (F.col("s1") == "purchase").cast("int").alias("hit")))


@query()
def contrast_mde(t):
    """The smallest difference that the sample of ``contrast_p`` separates with 80 % power, by simulation."""
    return inference.smallest_detectable(contrast_p(t))


# Carry between turns.

STEM_SQL = carry.stem_sql
EXCHANGES = """e as (select conv_id, i, regexp_extract_all(lower(coalesce(prior, '')), '[a-z'']+') as p, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') as r
 from (select *, row_number() over w as i, lag(text) over w as prior, lag(role) over w as prole from conversations window w as (partition by conv_id order by turn, role, text)) where role = 'assistant' and prole = 'user')"""


@query(f"""with {EXCHANGES}, d as (select distinct conv_id, i, side, w from (select conv_id, i, 0 as side, unnest(p) as w from e union all select conv_id, i, 1, unnest(r) from e)),
 w0 as (select distinct w, w as s from d where length(w) > 2 and w not in ({', '.join(f"'{x}'" for x in carry.STOP)})), w1 as (select w, {STEM_SQL('s')} as s from w0), w2 as (select w, {STEM_SQL('s')} as s from w1), w3 as (select w, {STEM_SQL('s')} as s from w2),
 c as (select conv_id, i, count(*) as n from (select conv_id, i, s from d join w3 using (w) group by all having count(distinct side) = 2) group by all), a as (select conv_id, i, count(*) as n from (select conv_id, i, w from d group by all having min(side) = 1) group by all),
 v as (select e.conv_id, e.i, coalesce(c.n, 0) as carried, coalesce(a.n, 0) as added from e left join c using (conv_id, i) left join a using (conv_id, i))
 select conv_id, i, carried, added, case when carried = 0 then 'nothing carried' when added = 0 then 'echo' else 'ok' end as reason,
  sum((carried = 0 or added = 0)::int) over (partition by conv_id order by i) = 0 as kept from v""")
def carry_gate(t):
    """Stems that a reply takes up from the line before, words it adds, and the prefix of exchanges that a gate keeps."""
    return carry.gate(carry.exchanges(t("conversations"), "conv_id", TURN, "user", "assistant"))


BAND = "case when len(roots) = 0 then 'no root' when {0} = 0 then 'nothing carried' when len(roots) - {0} = 0 then 'echo' else 'ok' end"
EXACT, SOFT = "len(list_intersect(prior, roots))", "len(list_filter(roots, lambda x: list_contains(list_transform(prior, lambda y: left(y, 4)), left(x, 4))))"


@query(f"with {SETS}, l as (select conv_id, turn, role, roots, lag(roots) over (partition by conv_id order by turn, role, text) as prior from t) select conv_id, turn, role, {EXACT} as carried, {BAND.format(EXACT)} as band, {SOFT} as carried_soft, {BAND.format(SOFT)} as band_soft from l where prior is not null")
def carry_bands(t):
    """Exact and softened bands of the roots that a turn carries; roots of one beginning are one family, an unknown root is its own."""
    prior = F.lag("roots").over(Window.partitionBy("conv_id").orderBy(*TURN))
    rows = turn_sets(t).withColumn("prior", prior).filter("prior is not null")
    return carry.bands(rows, "prior", "roots", lambda x: F.substring(x, 1, 4)).select("conv_id", "turn", "role", "carried", "band", "carried_soft", "band_soft")


@query(f"""with {SETS}, l as (select conv_id, roots, lag(roots, 1) over w as prior, lag(roots, 2) over w as before from t window w as (partition by conv_id order by turn, role, text)),
 o as (select x.r as root, list_contains(coalesce(before, []), x.r) as marked, list_contains(roots, x.r) as again from l, unnest(prior) as x(r) where prior is not null)
 select count(*) filter (marked) as n_marked, count(*) filter (not marked) as n_unmarked, round(avg(again::int) filter (marked), 6) as p_marked, round(avg(again::int) filter (not marked), 6) as p_unmarked, round(avg(again::int) filter (marked) - avg(again::int) filter (not marked), 6) as difference from o""")
def marked_roots(t):
    """How often a root of the turn before appears again, marked (the two turns before share it) or not."""
    return carry.marked_rates(turn_sets(t), "conv_id", TURN, "roots").select("n_marked", "n_unmarked", r6("p_marked").alias("p_marked"), r6("p_unmarked").alias("p_unmarked"), r6("difference").alias("difference"))


@query(f"""with {SETS}, h as (select conv_id, turn, role, text, list_sort(list_intersect(lag(roots, 1) over w, lag(roots, 2) over w)) as held from t window w as (partition by conv_id order by turn, role, text))
 select conv_id, turn, role, 'let go: ' || case when coalesce(len(held), 0) = 0 then '(none)' else array_to_string(held, ' ') end as marker, length(coalesce(text, '')) + 1 + length('let go: ' || case when coalesce(len(held), 0) = 0 then '(none)' else array_to_string(held, ' ') end) as stimulus_chars from h""")
def marker_lines(t):
    """The annotation line of the held roots, and the stimulus it ends."""
    held = sequences.held(turn_sets(t), "conv_id", TURN, "roots")
    line = F.concat(F.lit("let go: "), F.when(F.coalesce(F.size("held"), F.lit(0)) > 0, F.array_join(F.array_sort("held"), " ")).otherwise("(none)"))
    return held.select("conv_id", "turn", "role", line.alias("marker"), F.length(F.concat_ws("\n", F.coalesce("text", F.lit("")), line)).cast("long").alias("stimulus_chars"))


# Synonyms from distributions: words are brands, roots are types of the parts of an order.

SEEN = """l as (select distinct l_orderkey as o, p_brand as word, p_type as root from lineitem join part on l_partkey = p_partkey), w as (select distinct o, word from l), r as (select distinct o, root from l),
 h as (select word, root, count(*) as c from w join r using (o) group by all), n as (select word, count(*) as seen from w group by all), pu as (select word, max(c) as top from h group by all),
 att as (select h.word, root, c, seen from h join n using (word) join pu using (word) where seen >= 8 and top / seen >= 0.2 and c >= 8 and c / seen >= 0.15 and word in (select word from h join n using (word) where c >= 8 and c / seen >= 0.15 group by word having count(*) >= 2))"""


@query(f"""with {SEEN}, ab as (select a.word, a.root as a, b.root as b, a.c as n_a, b.c as n_b from att a join att b on a.word = b.word and a.root < b.root), tg as (select ab.word, ab.a, ab.b, count(*) as together from ab join w on w.word = ab.word join r x on x.o = w.o and x.root = ab.a join r y on y.o = w.o and y.root = ab.b group by all), d as (select ab.*, coalesce(together, 0) as together from ab left join tg using (word, a, b))
 select word, a, b, n_a, n_b, together, round(together / least(n_a, n_b), 4) as co_rate, together / least(n_a, n_b) >= 0.9 as companions from d""")
def root_alternation(t):
    """Of roots that one word attests, how often the rarer one comes with the other."""
    return carry.alternation(*_word_roots(t))


@query(f"with {SEEN}, adj as (select distinct a.root, b.root as other from att a join att b on a.word = b.word and a.root <> b.root), s as (select root, count(*) + 1 as size from adj group by all) select size, count(*) as roots, (select max(size) from s) as most, round((select avg(size) from s), 3) as mean from s group by all")
def synonym_sets(t):
    """Sizes of the sets of roots that attest to the same words, each root its own synonym."""
    s = carry.synonyms(*_word_roots(t)).select("root", (F.size("others") + 1).cast("long").alias("size"))
    n, w = s.groupBy("size").agg(F.count("*").alias("roots"), F.sum("size").alias("total")), Window.partitionBy()
    return n.select("size", "roots", F.max("size").over(w).alias("most"), F.round(F.sum("total").over(w) / F.sum("roots").over(w), 3).alias("mean"))


@query(f"with {SEEN}, adj as (select distinct a.root from att a join att b on a.word = b.word and a.root <> b.root), c as (select o_custkey as k, o, root from r join orders on o = o_orderkey), p as (select distinct a.k, a.root from c a join c b on a.k = b.k and a.root = b.root and a.o < b.o), q as (select k, max((adj.root is not null)::int) as hit from p left join adj using (root) group by all) select count(*) as pairs, cast(sum(hit) as bigint) as touchable, round(avg(hit), 4) as reach from q")
def synonym_reach(t):
    """Of customers whose orders share a root, how many share one that has a synonym."""
    _, roots, _ = _word_roots(t)
    owners = t("orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("k"))
    shared = roots.join(owners, "o").groupBy("k", "root").agg(F.count("*").alias("n")).filter("n > 1")
    hit = shared.join(carry.synonyms(*_word_roots(t)).select("root", F.lit(1).alias("hit")), "root", "left").groupBy("k").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return hit.agg(F.count("*").alias("pairs"), F.sum("hit").alias("touchable"), r4(F.avg("hit")).alias("reach"))


def _word_roots(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(order, word), (order, root) and the roots that each word attests."""
    line = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o"), F.col("p_brand").alias("word"), F.col("p_type").alias("root"))
    words, roots = line.select("o", "word").distinct(), line.select("o", "root").distinct()
    return words, roots, carry.attested(words, roots, "o", support=8, turns=8, purity=0.2, share=0.15)


# Departure from the first epoch and agreement of two speakers.

ANSWERS = """c as (select event_id % 2 as model, user_id as probe, (day(ts) - 1) // 7 as epoch, hour(ts) // 6 as slot, event_type as answer, count(*) as n from events group by all),
 f as (select m.model, p.probe, e.epoch from (select unnest([0, 1]) as model) m, (select distinct user_id as probe from events) p, (select unnest(range(0, 5)) as epoch) e),
 b as (select model, probe, epoch, answer from (select *, row_number() over (partition by model, probe, epoch order by n desc, answer) as k from (select model, probe, epoch, answer, sum(n) as n from c group by all)) where k = 1),
 a as (select f.*, b.answer from f left join b using (model, probe, epoch))"""


@query(f"""with {ANSWERS}, d as (select x.epoch, avg((x.answer is distinct from o.answer)::int) as departure from a x join a o on o.epoch = 0 and o.model = x.model and o.probe = x.probe group by all),
 g as (select x.epoch, avg((x.answer is not distinct from y.answer)::int) as agreement from a x join a y on x.model = 0 and y.model = 1 and x.probe = y.probe and x.epoch = y.epoch group by all)
 select epoch, round(departure, 6) as departure, round(agreement, 6) as agreement, round(1 - max(agreement) filter (epoch = 0) over (), 6) as noise_floor from d join g using (epoch)""")
def departure_convergence(t):
    """Share of answers that differ from the first epoch, share on which both speakers agree, and the noise floor; no answer is an answer."""
    a = inference.answers(_answers(t), ["model", "probe"], "epoch", 5)
    d = a.withColumn("o", F.first("answer").over(Window.partitionBy("model", "probe").orderBy("epoch"))).groupBy("epoch").agg(F.avg((~F.col("answer").eqNullSafe(F.col("o"))).cast("int")).alias("departure"))
    side = [F.max(F.when(F.col("model") == k, F.col("answer"))) for k in (0, 1)]
    g = a.groupBy("probe", "epoch").agg(side[0].alias("x"), side[1].alias("y")).groupBy("epoch").agg(F.avg(F.col("x").eqNullSafe(F.col("y")).cast("int")).alias("agreement"))
    floor = 1 - F.max(F.when(F.col("epoch") == 0, F.col("agreement"))).over(Window.partitionBy())
    return d.join(g, "epoch").select("epoch", r6("departure").alias("departure"), r6("agreement").alias("agreement"), r6(floor).alias("noise_floor"))


def _answers(t) -> DataFrame:
    e = t("events")
    return e.select((F.col("event_id") % 2).alias("model"), F.col("user_id").alias("probe"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("long").alias("epoch"), F.floor(F.hour("ts") / 6).cast("long").alias("slot"), F.col("event_type").alias("answer"))


@query(f"""with {ANSWERS}, s as (select model, probe, epoch, slot, answer from (select *, row_number() over (partition by model, probe, epoch, slot order by n desc, answer) as k from c) where k = 1),
 x as (select f.*, z.slot, s.answer from f, (select unnest(range(0, 4)) as slot) z left join s on s.model = f.model and s.probe = f.probe and s.epoch = f.epoch and s.slot = z.slot),
 y as (select x.model, x.probe, x.epoch, count(x.answer) as now, count(o.answer) as was, avg((x.answer is distinct from o.answer)::int) as share from x join x o on o.epoch = 0 and o.model = x.model and o.probe = x.probe and o.slot = x.slot group by all)
 select epoch, round(avg(case when (now = 0) <> (was = 0) then 1.0 else share end), 6) as graded from y group by all""")
def graded_departure(t):
    """Mean share of four slots whose answer differs from the first epoch; having an answer against having none differs wholly."""
    a = inference.answers(_answers(t), ["model", "probe"], "epoch", 5, slots=4)
    a = a.withColumn("o", F.first("answer").over(Window.partitionBy("model", "probe", "slot").orderBy("epoch")))
    y = a.groupBy("model", "probe", "epoch").agg(F.count("answer").alias("now"), F.count("o").alias("was"), F.avg((~F.col("answer").eqNullSafe(F.col("o"))).cast("int")).alias("share"))
    return y.groupBy("epoch").agg(r6(F.avg(F.when((F.col("now") == 0) != (F.col("was") == 0), 1.0).otherwise(F.col("share")))).alias("graded"))


# Panels of observables, and how an injected pool lies among speakers.

@query(f"""with k as (select conv_id, role, {TOK.format('text')} as toks, text from conversations), g as (select role, count(*) as n, round(avg(len(toks)), 4) as mean_tokens, round(count(distinct text) / count(*), 6) as distinct_share from k group by all),
 u as (select role, count(*) as total, count(distinct w) as repertoire from (select role, unnest(toks) as w from k) group by all)
 select role, n, case when n >= 8 then mean_tokens end as mean_tokens, case when n >= 8 then distinct_share end as distinct_share, case when n >= 8 then repertoire end as repertoire, case when n >= 8 then round(repertoire / total, 6) end as ttr, round(n / sum(n) over (), 6) as share from g left join u using (role)""")
def observable_panel(t):
    """The panel of each source of turns, null under eight turns."""
    k = t("conversations").withColumn("toks", tx.tokens(F.col("text")))
    g = k.groupBy("role").agg(F.count("*").alias("n"), r4(F.avg(F.size("toks"))).alias("mean_tokens"), r6(F.countDistinct("text") / F.count("*")).alias("distinct_share"))
    w = k.select("role", F.explode("toks").alias("w")).groupBy("role", "w").agg(F.count("*").alias("c")).groupBy("role").agg(F.sum("c").alias("total"), F.count("*").alias("repertoire"))
    enough = lambda c: F.when(F.col("n") >= 8, c)
    j = g.join(w, "role", "left")
    return j.select("role", "n", *(enough(F.col(c)).alias(c) for c in ("mean_tokens", "distinct_share", "repertoire")), enough(r6(F.col("repertoire") / F.col("total"))).alias("ttr"), r6(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


COORDS = "v as (select label, unnest(range(0, len(embedding))) as d, unnest(embedding)::double as x from embeddings), g as (select label, d, avg(x) as m from v group by all), s as (select d, stddev_samp(m) as s, avg(m) as mu from g where label <> 0 group by all)"


def label_means(t) -> DataFrame:
    """(label, d, m): mean of every coordinate of every label."""
    v = t("embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    return v.groupBy("label", F.col("d").cast("long").alias("d")).agg(F.avg(F.col("x").cast("double")).alias("m"))


@query(f"""with {COORDS}, p as (select d, m from g where label = 0), c as (select d, abs(p.m - mu) / s <= 1.5 as ok from p join s using (d)),
 j as (select a.label as a, b.label as b, sum((p.m - a.m) / s * ((b.m - a.m) / s)) as num, sum(((b.m - a.m) / s) ** 2) as den from g a join g b on a.d = b.d and 0 < a.label and a.label < b.label join s on s.d = a.d join p on p.d = a.d group by all),
 o as (select *, num / den as t, not (num / den between 0 and 1) as outside from j)
 select a, b, round(sqrt(den), 4) as d_ab, round(t, 4) as t, outside, case when not (select bool_and(ok) from c) then 'HALT_CENTRALITY' when avg(outside::int) over () > 0.5 then 'HALT_NOT_BETWEEN' else 'PASS' end as verdict from o""")
def injection_gate(t):
    """Where a pool lies on the segment between every two speakers, over all coordinates, and whether it may be injected."""
    return inference.between(label_means(t), 0).select("a", "b", r4("d_ab").alias("d_ab"), r4("t").alias("t"), "outside", "verdict")


@query("""with e as (select user_id, event_type, event_type <> 'error' as ok, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n from events),
 v as (select user_id, event_type, row_number() over (partition by user_id order by i) as j, count(*) over (partition by user_id) as m from e where ok),
 w as (select user_id, count(distinct event_type) filter (j <= 8) / count(*) filter (j <= 8) as first, count(distinct event_type) filter (j > m - 8) / count(*) filter (j > m - 8) as last from v group by all),
 q as (select user_id, count(*) as n, avg(ok::int) as valid, avg(ok::int) filter (i > n - greatest(1, n // 4)) as last_quarter from e group by all)
 select user_id, q.n, round(valid, 6) as valid, round(last_quarter, 6) as last_quarter, round(first, 6) as ttr_first, round(last, 6) as ttr_last, last_quarter < 0.9 as invalid_end, coalesce((first - last) / nullif(first, 0), 0) > 0.25 as declined from q left join w using (user_id)""")
def exchange_decline(t):
    """Validity of the last quarter, and type-token ratios of the first and last eight valid turns."""
    return inference.decline(t("events"), "user_id", AT, "event_type", F.col("event_type") != "error", window=8)


DIFFS = "g as (select lang, avg(n_chars) filter (toxic = 1) - avg(n_chars) filter (toxic = 0) as d from documents join labels using (doc_id) group by all)"


@query(f"""with {DIFFS}, i as (select d, row_number() over (order by d) - 1 as i, count(*) over () as n from g where d is not null), m as (select unnest(range(0, 64)) as mask),
 f as (select mask, max(n) as n, abs(sum(case when (mask >> i) & 1 = 1 then -d else d end) / max(n)) as v from i, m where mask < power(2, n) group by mask), s as (select list_sort(list(v)) as v, max(n) as n from f)
 select cast(n as int) as n, round(v[least(floor(0.95 * len(v))::int, len(v) - 1) + 1], 4) as mde from s""")
def null_band(t):
    """The smallest detectable mean, the 95 % order statistic of all sign assignments."""
    d = t("documents").join(t("labels"), "doc_id").groupBy("lang").agg((F.avg(F.when(F.col("toxic") == 1, F.col("n_chars"))) - F.avg(F.when(F.col("toxic") == 0, F.col("n_chars")))).alias("d"))
    return inference.sign_band(d.filter("d is not null"), "d").select("n", r4("mde").alias("mde"))


GATES = """m as (select lang, avg((n_chars >= 100)::int) as render, avg(quality) as speak, avg(toxic) as nf, coalesce(avg(quality) filter (doc_id % 2 = 0) - avg(quality) filter (doc_id % 2 = 1), 0) as delta, count(*) as n, sum(quality) as good from documents join labels using (doc_id) group by all)"""


@query(f"""with {GATES}, w as (select *, (good / n + 1.9208 / n) / (1 + 3.8416 / n) as mid, 1.96 * sqrt(good / n * (1 - good / n) / n + 0.9604 / n / n) / (1 + 3.8416 / n) as half from m)
 select lang, case when speak < 0.9 then 'FIRES' else 'HOLDS' end as internal, case when least(render, speak) < 0.9 then 'FIRES' else 'HOLDS' end as local, case when delta <= 0.02 then 'FIRES' else 'HOLDS' end as noise, 1 - nf > 0.02 as headroom,
  case when nf > 0.2 then 'FIRES' else 'HOLDS' end as leak, case when delta < 0 then 'CONVERGENCE' when delta > 0 then 'DIVERGENCE' else 'NONE' end as direction,
  case when n < 150 then 'UNDECIDED' when mid - half > 0.5 and good / n >= 0.65 then 'ACCEPTED' when mid + half <= 0.5 then 'REJECTED' else 'UNDECIDED' end as decision,
  case when bool_or(delta > 0.02 and 1 - nf > 0.02) over () then 'RECOVERED' when bool_or(not (1 - nf > 0.02)) over () then 'WITHHELD' else 'BOUNDARY' end as verdict from w""")
def falsifier_gates(t):
    """The gates of each language and the verdict over all of them."""
    d = t("documents").join(t("labels"), "doc_id")
    half = [F.avg(F.when(F.col("doc_id") % 2 == k, F.col("quality"))) for k in (0, 1)]
    m = d.groupBy("lang").agg(F.avg((F.col("n_chars") >= 100).cast("int")).alias("render"), F.avg("quality").alias("speak"), F.avg("toxic").alias("noise"), F.coalesce(half[0] - half[1], F.lit(0.0)).alias("delta"), F.count("*").alias("n"), F.sum("quality").alias("good"))
    low, high = stats.wilson(F.col("good"), F.col("n"))
    open_ = verdicts.headroom(F.col("noise"), F.lit(0.02))
    found = (F.col("delta") > 0.02) & open_
    return m.select(
        "lang",
        verdicts.internalised(F.col("speak"), F.lit(False)).alias("internal"),
        verdicts.both_directions(F.col("render"), F.col("speak")).alias("local"),
        verdicts.is_noise(F.col("delta"), F.lit(0.02)).alias("noise"),
        open_.alias("headroom"),
        verdicts.leaks(F.col("noise")).alias("leak"),
        verdicts.direction(F.col("delta")).alias("direction"),
        verdicts.carry_decision(F.col("good") / F.col("n"), low, high, F.col("n")).alias("decision"),
        verdicts.over_axes(found, open_, Window.partitionBy()).alias("verdict"),
    )


# Predictions within pairs, listeners and ceilings.

PREDICTED = f"{PAIRS.replace('select event_type', 'select user_id, event_type')}, x as (select following as label, prior as guess, user_id % 2 = 0 as train from p where following is not null), y as (select *, case label when 'click' then 'view' when 'view' then 'click' when 'purchase' then 'signup' when 'signup' then 'purchase' end as mate from x)"


@query(f"""with {PREDICTED}, top as (select label from x where train group by label order by count(*) desc, label limit 1), z as (select * from y where not train and mate is not null)
 select least(label, mate) as pair, count(*) filter (guess in (label, mate)) as n, round(avg((guess = label)::int) filter (guess in (label, mate)), 6) as accuracy, round(avg((guess not in (label, mate))::int), 6) as off_pair,
  (select round(avg((label = (select label from top))::int), 6) from x where not train) as majority, round(avg((guess = label)::int - (label = (select label from top))::int), 6) as difference from z group by all""")
def within_pair(t):
    """Accuracy between the two members of each pair, predictions outside the pair, and the modal class of the other half."""
    mates = F.create_map(*(F.lit(x) for x in ("click", "view", "view", "click", "purchase", "signup", "signup", "purchase")))
    s = sequences.successors(t("events"), "user_id", AT, "event_type").filter("s1 is not null")
    rows = s.select(F.col("s1").alias("label"), F.col("event_type").alias("guess"), (F.col("user_id") % 2 == 0).alias("train")).withColumn("mate", F.try_element_at(mates, F.col("label")))
    return inference.within_pairs(rows)


SPEAK = f"""w as (select distinct item_id, unnest({TOK.format('text')}) as tok from benchmark), l as (select item_id, tok, 1.0 / count(*) over (partition by tok) as lit, 1.0 / count(*) over (partition by item_id) as even from w),
 s as (select *, lit * lit / sum(lit * lit) over (partition by item_id) as s1 from l)"""


@query(f"""with {SPEAK}, b as (select *, s1 >= max(s1) over (partition by tok) - 1e-12 as wins, even >= max(even) over (partition by tok) - 1e-12 as wins_even from s), c as (select *, sum(wins::int) over (partition by tok) as k, sum(wins_even::int) over (partition by tok) as k_even from b), n as (select count(distinct item_id) as n from w)
 select round(sum(s1 * wins::int / k) / max(n), 6) as adapted, round(sum(s1 * wins_even::int / k_even) / max(n), 6) as naive, round(sum(s1 * (wins::int / k - wins_even::int / k_even)) / max(n), 6) as gain from c, n""")
def listener_frontier(t):
    """Accuracy of a listener that knows the adapted speaker against one that thinks it even, ties split."""
    return inference.frontier(t("benchmark").select("item_id", F.explode(tx.token_set(F.col("text"))).alias("tok")), "item_id", "tok").select(r6("adapted").alias("adapted"), r6("naive").alias("naive"), r6("gain").alias("gain"))


@query(f"""with {SPEAK}, m as (select item_id % 5 as cluster, tok, max(s1) as best from s group by all), k as (select item_id % 5 as cluster, count(distinct item_id) as mates from w group by all), c as (select cluster, mates, case when mates < 2 then 1.0 else sum(best) / mates end as ceiling from m join k using (cluster) group by cluster, mates)
 select cluster, mates, round(ceiling, 6) as ceiling, round(1.0 / mates, 6) as floor, 100 * (avg(ceiling) over () - avg(1.0 / mates) over ()) > 5 as readable from c""")
def cluster_ceilings(t):
    """Best possible accuracy within clusters of items against guessing, and whether that leaves room."""
    w = t("benchmark").select("item_id", F.explode(tx.token_set(F.col("text"))).alias("tok"))
    return inference.ceilings(inference.speakers(w, "item_id", "tok"), "item_id", "tok", F.col("item_id") % 5, 5.0).select("cluster", "mates", r6("ceiling").alias("ceiling"), r6("floor").alias("floor"), "readable")


@query(f"""with w as (select distinct item_id, unnest({TOK.format('text')}) as tok from benchmark), s as (select tok, count(*) as size from w group by all), h as (select size, count(*) as utterances from s group by all), o as (select list_sort(list(size)) as v, count(*) as n, avg((size >= 2)::int) as f2, avg(size) as mean, median(size) as median, avg(log2(size)) as bits, avg(1.0 / size) as uniform from s)
 select size, utterances, round(f2, 6) as f2, round(mean, 6) as mean, median, v[floor(0.9 * (n - 1))::int + 1] as p90, v[len(v)] as most, round(bits, 6) as bits, round(uniform, 6) as uniform from h, o""")
def ambiguity_spread(t):
    """How many items each word fits: histogram, order statistics, bits, and a uniform listener's accuracy."""
    w = t("benchmark").select("item_id", F.explode(tx.token_set(F.col("text"))).alias("tok"))
    return inference.spread(w.groupBy("tok").agg(F.count("*").alias("size")))
