"""Nulls, fidelity to a map, contrasts, drift, panels, listeners: measurements with their decisions.

Rows are reduced by Spark; what is simulated afterwards depends only on a table of a few kinds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows of a range of the order in which turns are re-paired
CELL = 20_000
#: items of all turns that are sent to every executor; beyond them the turns are shuffled
SENT_ITEMS = 1_000_000


def transience(turns: DataFrame, key: str, order: list[str], items: str, lags: int, reps: int) -> DataFrame:
    """Overlap at each lag, its null by re-pairing without replacement, z, resolving power and the verdicts.

    The turns of a lag meet all turns in a seeded order, rank by rank.  Ranks are taken over narrow rows
    within ranges of the order and moved by the counts of earlier ranges, so no task sorts a whole replicate;
    item sets join the pairs afterwards.  Copies of the turns look as small as the turns to the planner, which would
    send them to the driver for a broadcast, so these joins are marked.
    """
    w = Window.partitionBy(key).orderBy(*order)
    hashed = F.transform(items, lambda x: F.xxhash64(x))
    rows = turns.select(F.col(key).alias("k"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(key)).alias("n"), hashed.alias("x"), *(F.lead(hashed, j).over(w).alias(f"l{j}") for j in range(1, lags + 1)))
    pairs = F.array(*(F.struct(F.lit(j).alias("lag"), F.size(F.array_intersect("x", f"l{j}")).alias("o"), F.least(F.size("x"), F.size(f"l{j}")).alias("m"), F.col(f"l{j}").isNotNull().alias("ok")) for j in range(1, lags + 1)))
    real = rows.select(F.inline(pairs)).filter("ok").groupBy("lag").agg(F.avg("o").alias("overlap"), F.avg("m").alias("most"), F.count("*").alias("n_pairs"))

    sets = rows.select(F.concat("k", F.lit("."), "i").alias("t"), "i", "n", "x")
    all_rows, volume = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("x")), F.lit(0))).first()
    cells = max(1, -(-all_rows // CELL))
    every = sets.select("t", "i", "n", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))

    def placed(df: DataFrame, side: str) -> DataFrame:
        h = df.select("lag", "rep", F.col("t").alias(side), F.md5(F.concat(F.lit(f"{side}:"), "rep", F.lit(":"), "lag", F.lit(":"), "t")).alias("h"))
        h = h.withColumn("cell", F.shiftright(F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * cells, 16)).withColumn("h", F.unhex("h"))
        up = Window.partitionBy("lag", "rep").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        before = h.groupBy("lag", "rep", "cell").count().select("lag", "rep", "cell", F.coalesce(F.sum("count").over(up), F.lit(0)).alias("before"))
        within = h.withColumn("place", F.row_number().over(Window.partitionBy("lag", "rep", "cell").orderBy("h")))
        # one row for each range of ``CELL`` rows
        return within.join(F.broadcast(before), ["lag", "rep", "cell"]).select("lag", "rep", (F.col("place") + F.col("before")).alias("place"), side)

    met = placed(every.filter("i + lag <= n"), "a").join(placed(every, "b").hint("merge"), ["lag", "rep", "place"])
    for side, as_ in (("a", "x"), ("b", "y")):
        own = sets.select(F.col("t").alias(side), F.col("x").alias(as_))
        met = met.join(F.broadcast(own) if volume + all_rows <= SENT_ITEMS else own.hint("merge"), side)
    means = met.groupBy("lag", "rep").agg(F.avg(F.size(F.array_intersect("x", "y"))).alias("m"))
    null = means.groupBy("lag").agg(F.avg("m").alias("mu"), F.stddev_samp("m").alias("sd"))
    z = real.join(null, "lag").withColumn("z", F.try_divide(F.col("overlap") - F.col("mu"), F.col("sd"))).withColumn("power", F.coalesce(F.try_divide(F.col("most") - F.col("mu"), F.col("sd")), F.lit(0.0)))
    z = z.withColumn("threshold", F.when(F.col("lag") == 1, 6.0).otherwise(3.0))
    all_ = Window.partitionBy()
    z1, z2, later = (F.max(F.when(c, F.col("z"))).over(all_) for c in (F.col("lag") == 1, F.col("lag") == 2, F.col("lag") > 1))
    verdict = F.when(F.isnull(z1) | (z1 < 6), "not responsive").when(later > 3, "content persists").otherwise("content-transient")
    return z.select(
        F.col("lag").cast("long").alias("lag"), "n_pairs", F.round("overlap", 6).alias("overlap"), F.round("most", 6).alias("attainable"), F.round("mu", 6).alias("null_mean"), F.round("sd", 6).alias("null_sd"),
        F.round("z", 4).alias("z"), F.round("power", 4).alias("resolving_power"), "threshold", (F.col("power") >= F.col("threshold")).alias("resolvable"), verdict.alias("verdict"), ((z1 >= 6) & (z2 > 3)).alias("persistent"), (z1 <= 3).alias("content_free"),
    )


#: kinds of a transition map that may come to the driver
KINDS = 1_000


def _matrix(grid: DataFrame, value: str) -> tuple[list, np.ndarray]:
    """The kinds of a grid and its values as a matrix; more than ``KINDS`` kinds are refused."""
    cells = grid.select("prior", "following", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")).limit(KINDS * KINDS + 1).collect()
    kinds = sorted({r.prior for r in cells})
    if len(kinds) > KINDS:
        raise ValueError(f"a map of over {KINDS} kinds")
    at = {k: i for i, k in enumerate(kinds)}
    out = np.zeros((len(kinds), len(kinds)))
    for r in cells:
        out[at[r.prior], at[r.following]] = r.v
    return kinds, out


def stationary(grid: DataFrame, exact: float = 1e-12) -> DataFrame:
    """(kind, mass, tv, separation) of a transition grid.

    The masses are those of the lazy map, which stays where it is half of the time and so has the same
    masses but no periods: it is squared until a squaring changes nothing by more than ``exact``.
    """
    kinds, p = _matrix(grid, "share")
    lazy = (p + np.eye(len(kinds))) / 2
    for _ in range(64):
        before, lazy = lazy, lazy @ lazy
        if np.abs(lazy - before).max(initial=0.0) <= exact:
            break
    mass = lazy.mean(0) if kinds else np.zeros(0)
    tv = 0.5 * np.abs(p - mass).sum(1)
    rows = [(k, float(m), float(d), float(mass @ tv)) for k, m, d in zip(kinds, mass, tv)]
    return grid.sparkSession.createDataFrame(rows, f"kind {dict(grid.dtypes)['prior']}, mass double, tv double, separation double")


def fidelity(map_: DataFrame, observed: DataFrame, trials: int = 400, seed: int = 0, percentile: float = 0.95, least: int = 20) -> DataFrame:
    """One row for each prior and one (prior null) for the whole: distances from the map and from independence, their simulated bands, verdict.

    Both inputs are transition grids of the same kinds.  Trials are dealt to Spark; each draws
    multinomial rows of the observed sizes from the map and from the observed marginal.
    """
    spark = observed.sparkSession
    kinds, n = _matrix(observed, "n")
    known, share = _matrix(map_, "share")
    own = {k: i for i, k in enumerate(known)}
    p = np.array([[share[own[a], own[b]] if a in own and b in own else 0.0 for b in kinds] for a in kinds]).reshape(len(kinds), len(kinds))
    sizes, total = n.sum(1).astype(int), n.sum()
    marginal = n.sum(0) / max(total, 1)
    p = np.where(p.sum(1, keepdims=True) > 0, p / np.maximum(p.sum(1, keepdims=True), 1e-300), 1 / max(1, len(kinds)))

    def distances(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        own = counts.sum(0) / max(counts.sum(), 1)
        return 0.5 * np.abs(share - p).sum(1), 0.5 * np.abs(share - own).sum(1)

    def simulate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for trial in frame["id"]:
                rng = np.random.default_rng([seed, int(trial)])
                for source, probs in (("map", p), ("independence", np.tile(marginal, (len(kinds), 1)))):
                    counts = np.array([rng.multinomial(s, q / q.sum()) if s and q.sum() else np.zeros(len(kinds)) for s, q in zip(sizes, probs)]).reshape(len(kinds), len(kinds))
                    d = distances(counts)["map independence".split().index(source)]
                    rows += [(source, k, float(x)) for k, x in zip(kinds, d)] + [(source, None, float((d * sizes).sum() / max(total, 1)))]
            yield pd.DataFrame(rows, columns=["source", "prior", "d"])

    drawn = spark.range(trials).repartition(8).mapInPandas(simulate, "source string, prior string, d double")
    band = drawn.groupBy("prior").agg(*(F.percentile(F.when(F.col("source") == s, F.col("d")), percentile).alias(f"band_{s}") for s in ("map", "independence")))
    dm, di = distances(n)
    rows = [(k, int(s), float(a), float(b)) for k, s, a, b in zip(kinds, sizes, dm, di)] + [(None, int(total), float((dm * sizes).sum() / max(total, 1)), float((di * sizes).sum() / max(total, 1)))]
    seen = spark.createDataFrame(rows, "prior string, n long, d_map double, d_independence double")
    out = seen.join(band.withColumnRenamed("prior", "_p"), F.col("prior").eqNullSafe(F.col("_p")))
    ok = {s: F.col(f"d_{s}") <= F.col(f"band_{s}") for s in ("map", "independence")}
    verdict = F.when(F.col("n") < least, "UNDERPOWERED").when(ok["map"] & ~ok["independence"], "FIDELITY").when(ok["independence"] & ~ok["map"], "CHANCE").when(~ok["map"] & ~ok["independence"], "THIRD THING").otherwise("DEGENERATE TEST")
    return out.select("prior", "n", "d_map", "d_independence", "band_map", "band_independence", verdict.alias("verdict"))


def shuffled_p(a: int, an: int, b: int, bn: int) -> float:
    """The share of all shuffles of a + b hits over two groups of an and bn whose rates differ as much as those of a and b.

    Weights of the counts around the likeliest one are chained products of neighbouring ratios; only
    counts within forty deviations of it, beyond which no weight is left in doubles, are formed.
    """
    hits = a + b
    low, high = max(0, hits - bn), min(an, hits)
    mode = min(high, max(low, (an + 1) * (hits + 1) // (an + bn + 2)))
    reach = 50 + int(40 * math.sqrt(max(1.0, an * bn * hits * (an + bn - hits) / max(1, (an + bn) ** 2 * (an + bn - 1)))))
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    steps = np.log((an - k[:-1]) * (hits - k[:-1])) - np.log((k[:-1] + 1) * (bn - hits + k[:-1] + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(logs - logs.max())
    return float(weights[np.abs(k / an - (hits - k) / bn) >= abs(a / an - b / bn) - 1e-12].sum() / weights.sum())


def contrast(rows: DataFrame) -> DataFrame:
    """Rates of ``hit`` by ``pivot`` and the two-sided p of all shuffles of the labels, which is hypergeometric.

    The row of four counts is all that the sum over shuffles needs.
    """
    c = rows.agg(*(F.sum(F.when(F.col("pivot") == k, F.col("hit"))).alias(f"{n}_hit") for n, k in (("pivot", True), ("other", False))), F.count_if("pivot").alias("pivot_n"), F.count_if(~F.col("pivot")).alias("other_n"))

    def p_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for a, b, an, bn in frame[["pivot_hit", "other_hit", "pivot_n", "other_n"]].itertuples(index=False):
                if not an or not bn:
                    out.append((a, an, b, bn, None, None, None))
                    continue
                out.append((a, an, b, bn, round(a / an, 6), round(b / bn, 6), round(shuffled_p(int(a), int(an), int(b), int(bn)), 6)))
            yield pd.DataFrame(out, columns=["pivot_hit", "pivot_n", "other_hit", "other_n", "pivot_rate", "other_rate", "p"])

    return c.mapInPandas(p_of, "pivot_hit long, pivot_n long, other_hit long, other_n long, pivot_rate double, other_rate double, p double")


def smallest_detectable(sample: DataFrame, trials: int = 4000, power: float = 0.8, seed: int = 3) -> DataFrame:
    """(pivot_n, other_n, base, mde): the first difference on a grid of half per cents that is told apart with ``power``."""
    steps = sample.select("pivot_n", "other_n", F.col("other_rate").alias("base")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(100)))).repartition(8, "step")

    def simulate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for a, b, base, step in frame.itertuples(index=False):
                rng = np.random.default_rng([seed, int(step)])
                x, y = rng.binomial(int(a), min(1.0, base + step / 200), trials), rng.binomial(int(b), base, trials)
                both = (x + y) / (a + b)
                error = np.sqrt(both * (1 - both) * (1 / a + 1 / b))
                found.append(float(((error > 0) & (np.abs(x / a - y / b) > 1.96 * error)).mean()))
            yield frame.assign(power=found)[["pivot_n", "other_n", "base", "step", "power"]]

    drawn = steps.mapInPandas(simulate, "pivot_n long, other_n long, base double, step int, power double")
    return drawn.groupBy("pivot_n", "other_n", "base").agg((F.min(F.when(F.col("power") >= power, F.col("step"))) / 200).alias("mde"))


def answers(rows: DataFrame, by: list[str], epoch: str, epochs: int, slots: int = 0) -> DataFrame:
    """The most frequent answer (ties: the smallest) of each unit and epoch (and slot), every epoch and slot listed, null without an answer.

    ``by`` names the speaker (0 or 1) and the probe.
    """
    keys = [*by, epoch, *(["slot"] if slots else [])]
    n = rows.groupBy(*keys, "answer").agg(F.count("*").alias("n"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "answer"))).filter("k = 1").drop("n", "k")
    units = rows.select(by[-1]).distinct().withColumn(by[0], F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    units = units.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    if slots:
        units = units.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    return units.join(top, keys, "left")


def between(means: DataFrame, pool) -> DataFrame:
    """(a, b, d_ab, t, outside, verdict): projection of the pool on the segment of every two other labels, in units of their spread."""
    others = means.filter(F.col("label") != pool)
    spread = others.groupBy("d").agg(F.stddev_samp("m").alias("s"), F.avg("m").alias("mu"))
    own = means.filter(F.col("label") == pool).select("d", F.col("m").alias("p")).join(spread, "d").withColumn("s", F.coalesce(F.nullif("s", F.lit(0.0)), F.lit(1.0)))
    central = own.agg(F.bool_and(F.abs(F.col("p") - F.col("mu")) / F.col("s") <= 1.5).alias("central"))
    a = others.join(own, "d").select("d", F.col("label").alias("a"), F.col("m").alias("ma"), "p", "s")
    b = others.select("d", F.col("label").alias("b"), F.col("m").alias("mb"))
    step = (F.col("mb") - F.col("ma")) / F.col("s")
    j = a.join(b, "d").filter("a < b").groupBy("a", "b").agg(F.sum((F.col("p") - F.col("ma")) / F.col("s") * step).alias("num"), F.sum(step * step).alias("den"))
    t = F.try_divide("num", "den")
    o = j.select("a", "b", F.sqrt("den").alias("d_ab"), t.alias("t"), (~F.coalesce(t.between(0, 1), F.lit(False))).alias("outside")).crossJoin(F.broadcast(central))
    share = F.avg(F.col("outside").cast("int")).over(Window.partitionBy())
    return o.withColumn("verdict", F.when(~F.col("central"), "HALT_CENTRALITY").when(share > 0.5, "HALT_NOT_BETWEEN").otherwise("PASS"))


def decline(events: DataFrame, key: str, order: list[str], kind: str, valid: Column, window: int = 8) -> DataFrame:
    """Validity overall and in the last quarter; type-token ratios of the first and last ``window`` valid rows."""
    w = Window.partitionBy(key)
    e = events.select(key, F.col(kind).alias("kind"), valid.alias("ok"), F.row_number().over(w.orderBy(*order)).alias("i"), F.count("*").over(w).alias("n"))
    q = e.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("int")).alias("valid"), F.avg(F.when(F.col("i") > F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") / 4)), F.col("ok").cast("int"))).alias("last_quarter"))
    v = e.filter("ok").select(key, "kind", F.row_number().over(w.orderBy("i")).alias("j"), F.count("*").over(w).alias("m"))
    ratio = lambda c: F.try_divide(F.count_distinct(F.when(c, F.col("kind"))), F.count_if(c))
    r = v.groupBy(key).agg(ratio(F.col("j") <= window).alias("first"), ratio(F.col("j") > F.col("m") - window).alias("last"))
    fell = F.coalesce(F.try_divide(F.col("first") - F.col("last"), F.col("first")), F.lit(0.0)) > 0.25
    return q.join(r, key, "left").select(key, "n", *(F.round(c, 6).alias(a) for c, a in (("valid", "valid"), ("last_quarter", "last_quarter"), ("first", "ttr_first"), ("last", "ttr_last"))), (F.col("last_quarter") < 0.9).alias("invalid_end"), fell.alias("declined"))


def sign_band(df: DataFrame, delta: str, quantile: float = 0.95, most: int = 20) -> DataFrame:
    """(n, mde): the order statistic of |mean| over all sign assignments of at most ``most`` differences; more are refused."""
    packed = df.agg(F.array_sort(F.collect_list(delta)).alias("d")).withColumn("n", F.size("d"))
    packed = packed.withColumn("n", F.when(F.col("n") <= most, F.col("n")).otherwise(F.raise_error(F.lit(f"over {most} differences have too many sign assignments"))))
    signs = packed.select("d", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(cast(1 as bigint), n)") - 1)).alias("mask"))
    flipped = F.aggregate(F.transform("d", lambda x, i: F.when(F.expr("mask").bitwiseAND(F.pow(F.lit(2), i).cast("long")) != 0, -x).otherwise(x)), F.lit(0.0), lambda a, x: a + x)
    v = signs.select("n", F.abs(flipped / F.col("n")).alias("v")).groupBy("n").agg(F.sort_array(F.collect_list("v")).alias("v"))
    return v.select("n", F.get("v", F.least(F.floor(quantile * F.size("v")).cast("int"), F.size("v") - 1)).alias("mde"))


def within_pairs(rows: DataFrame) -> DataFrame:
    """Per pair of (label, mate): accuracy among guesses within it, share outside, the modal class of the training rows and the mean paired difference."""
    modal = rows.filter("train").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1).select(F.col("label").alias("top"))
    test = rows.filter("not train").crossJoin(F.broadcast(modal))
    hit, top = (F.col("guess") == F.col("label")).cast("int"), (F.col("label") == F.col("top")).cast("int")
    inside = F.col("guess").isin(F.col("label"), F.col("mate"))
    overall = test.agg(F.round(F.avg(top), 6).alias("majority"))
    pairs = test.filter("mate is not null").groupBy(F.least("label", "mate").alias("pair")).agg(
        F.count_if(inside).alias("n"), F.round(F.avg(F.when(inside, hit)), 6).alias("accuracy"), F.round(F.avg((~inside).cast("int")), 6).alias("off_pair"), F.round(F.avg(hit - top), 6).alias("difference")
    )
    return pairs.crossJoin(F.broadcast(overall))


def speakers(words: DataFrame, ref: str, form: str, alpha: float = 2.0) -> DataFrame:
    """(ref, form, literal, even, adapted): a literal listener's weight, an even speaker and the speaker who raises it to ``alpha``.

    Forms are counted first and joined, so a form of many referents is not one task.
    """
    df = words.groupBy(form).agg(F.count("*").alias("df"))
    lit = words.join(df, form).withColumn("literal", 1 / F.col("df"))
    w = Window.partitionBy(ref)
    return lit.select(ref, form, "literal", (1 / F.count("*").over(w)).alias("even"), (F.pow("literal", F.lit(alpha)) / F.sum(F.pow("literal", F.lit(alpha))).over(w)).alias("adapted"))


def frontier(words: DataFrame, ref: str, form: str, alpha: float = 2.0) -> DataFrame:
    """(adapted, naive, gain): accuracy of the listener's best referent under the speaker's own and under an even policy; ties split."""
    s = speakers(words, ref, form, alpha)
    top = s.groupBy(form).agg(F.max("adapted").alias("ta"), F.max("even").alias("te"))
    b = s.join(top, form).withColumn("wa", (F.col("adapted") >= F.col("ta") - 1e-12).cast("int")).withColumn("we", (F.col("even") >= F.col("te") - 1e-12).cast("int"))
    k = b.groupBy(form).agg(F.sum("wa").alias("ka"), F.sum("we").alias("ke"))
    c = b.join(k, form)
    n = words.agg(F.count_distinct(ref).alias("n"))
    sums = c.agg(F.sum(F.col("adapted") * F.col("wa") / F.col("ka")).alias("a"), F.sum(F.col("adapted") * F.col("we") / F.col("ke")).alias("e")).crossJoin(n)
    return sums.select((F.col("a") / F.col("n")).alias("adapted"), (F.col("e") / F.col("n")).alias("naive"), ((F.col("a") - F.col("e")) / F.col("n")).alias("gain"))


def ceilings(policy: DataFrame, ref: str, form: str, cluster: Column, mde: float) -> DataFrame:
    """(cluster, mates, ceiling, floor, readable): Bayes accuracy within clusters of referents, and whether the mean headroom in points passes ``mde``."""
    p = policy.withColumn("cluster", cluster)
    best = p.groupBy("cluster", form).agg(F.max("adapted").alias("best")).groupBy("cluster").agg(F.sum("best").alias("best"))
    mates = p.groupBy("cluster").agg(F.count_distinct(ref).alias("mates"))
    c = best.join(mates, "cluster").select("cluster", "mates", F.when(F.col("mates") < 2, 1.0).otherwise(F.col("best") / F.col("mates")).alias("ceiling"), (1 / F.col("mates")).alias("floor"))
    w = Window.partitionBy()
    return c.withColumn("readable", 100 * (F.avg("ceiling").over(w) - F.avg("floor").over(w)) > mde)


def spread(sizes: DataFrame) -> DataFrame:
    """Histogram of set sizes with their order statistics, taken from the histogram itself."""
    h = sizes.groupBy("size").agg(F.count("*").alias("utterances"))
    up, all_ = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    h = h.withColumn("upto", F.sum("utterances").over(up)).withColumn("n", F.sum("utterances").over(all_))
    mean = lambda c: F.sum(c * F.col("utterances")).over(all_) / F.col("n")
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("size"))).over(all_)
    return h.select(
        "size", "utterances", F.round(mean((F.col("size") > 1).cast("int")), 6).alias("f2"), F.round(mean(F.col("size")), 6).alias("mean"),
        ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"), at(F.floor(0.9 * (F.col("n") - 1))).alias("p90"), F.max("size").over(all_).alias("most"),
        F.round(mean(F.log2("size")), 6).alias("bits"), F.round(mean(1 / F.col("size")), 6).alias("uniform"),
    )
