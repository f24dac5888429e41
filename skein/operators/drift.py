"""Distances of point clouds by their covariances, how they change between arms, and intervals over pairs that share members.

A cloud is a group of points, one array column.  Means and covariances are grouped sums of
the points and of their outer products: tasks add up their own rows in Arrow, and Spark adds the sums element by
element, so a cloud of any number of points is a few thousand numbers.  The distance of two clouds is the
2-Wasserstein distance of the normal distributions with these moments, split into what the
means and what the spreads account for.

Pairs share members, so an interval over pairs resamples members: a replicate draws as many members
as there are, with replacement, and a pair counts the product of its two members' draws.
Draws are hashes of replicate, place and seed, so lost tasks repeat theirs.

Defined cases: points with a null or of another width than ``width`` are left out; clouds of fewer than
``least`` points have no moments, and pairs with such a cloud no distance; replicates in which no pair counts are left out;
the deltas of no pair have no interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.settle import settled

#: groups whose sums a task holds before it emits them
HELD = 256


def moments(points: DataFrame, by: list[str], point: str, width: int, least: int = 3) -> DataFrame:
    """(.., n, mean, cov): mean and covariance (row by row, divisor n - 1) of each group of points."""
    whole = F.col(point).isNotNull() & (F.size(point) == width) & ~F.exists(F.col(point), lambda x: x.isNull() | F.isnan(x))
    kept = points.filter(whole).select(F.to_json(F.struct(*by)).alias("key"), F.col(point).cast("array<double>").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def emit() -> pa.RecordBatch:
            rows = [(k, n, np.concatenate([s, o.ravel()]).tolist()) for k, (n, s, o) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.float64())))], names=["key", "n", "sums"])

        for b in batches:
            keys = np.array(b.column(0).to_pylist(), object)
            values = np.array(b.column(1).flatten()).reshape(-1, width)
            names, place = np.unique(keys, return_inverse=True)
            for j, k in enumerate(names):
                own = values[place == j]
                n, s, o = held.get(k, (0, 0.0, 0.0))
                held[k] = [n + len(own), s + own.sum(0), o + own.T @ own]
            if len(held) >= HELD:
                yield emit()
        yield emit()

    partial = kept.mapInArrow(run, "key string, n long, sums array<double>")
    sums = partial.select("key", "n", F.posexplode("sums").alias("at", "x")).groupBy("key", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    whole = sums.groupBy("key").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda r: r["x"]).alias("sums")).filter(F.col("n") >= least)
    mean = F.transform(F.slice("sums", 1, width), lambda x: x / F.col("n"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(width * width - 1)), lambda i: (F.get("sums", i + width) - F.col("n") * F.get("mean", F.floor(i / width).cast("int")) * F.get("mean", i % width)) / (F.col("n") - 1))
    names = F.from_json("key", ", ".join(f"{c} {t}" for c, t in points.select(*by).dtypes))
    return whole.withColumn("mean", mean).withColumn("cov", cells).select(*(names[c].alias(c) for c in by), "n", "mean", "cov")


def axis_scale(clouds: DataFrame) -> DataFrame:
    """One row (scale): the standard deviation between the clouds' means on each axis, the unit of distances; frozen by whoever keeps it."""
    axes = clouds.select(F.posexplode("mean").alias("at", "x")).groupBy("at").agg(F.stddev_samp("x").alias("s"))
    return axes.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda r: r["s"]).alias("scale"))


def root(a: np.ndarray) -> np.ndarray:
    """The square root of a positive semidefinite matrix."""
    w, v = np.linalg.eigh(a)
    return (v * np.sqrt(np.clip(w, 0.0, None))) @ v.T


def gaussian_w2(mean_a: np.ndarray, cov_a: np.ndarray, mean_b: np.ndarray, cov_b: np.ndarray) -> tuple[float, float]:
    """(mean term, spread term) of the squared distance of two normal distributions."""
    apart = mean_a - mean_b
    half = root(cov_b)
    spread = np.trace(cov_a) + np.trace(cov_b) - 2 * np.trace(root(half @ cov_a @ half))
    return float(apart @ apart), max(float(spread), 0.0)


def distances(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """(.., mean_term, spread_term, w2) of rows with mean_a, cov_a, mean_b, cov_b and scale."""
    schema = ", ".join(f"{c} {t}" for c, t in pairs.select(*keep).dtypes) + ", mean_term double, spread_term double, w2 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ma, ca, mb, cb, s in zip(*(b.column(c).to_pylist() for c in ("mean_a", "cov_a", "mean_b", "cov_b", "scale"))):
                s = np.array(s)
                unit = np.outer(s, s)
                mean, spread = gaussian_w2(np.array(ma) / s, np.reshape(ca, unit.shape) / unit, np.array(mb) / s, np.reshape(cb, unit.shape) / unit)
                out.append((mean, spread, float(np.sqrt(mean + spread))))
            found = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, pa.float64()) for c in found)], names=[*keep, "mean_term", "spread_term", "w2"])

    return pairs.select(*keep, "mean_a", "cov_a", "mean_b", "cov_b", "scale").mapInArrow(run, schema)


def _cloud(clouds: DataFrame, member: str, side: str) -> DataFrame:
    return clouds.select(F.col(member).alias(side), F.col("mean").alias(f"mean_{side}"), F.col("cov").alias(f"cov_{side}"))


def pair_distances(clouds: DataFrame, pairs: DataFrame, scale: DataFrame, member: str) -> DataFrame:
    """(a, b, mean_term, spread_term, w2) of the pairs (a, b) whose clouds both have moments."""
    met = pairs.join(_cloud(clouds, member, "a"), "a").join(_cloud(clouds, member, "b"), "b")
    return distances(met.crossJoin(F.broadcast(scale)), ["a", "b"])  # the scale is one row


def arm_delta(live: DataFrame, yoked: DataFrame) -> DataFrame:
    """(a, b, live_.., yoked_.., delta, delta_mean_term, delta_spread_term): distances of the live arm less those of the yoked arm."""
    names = ["w2", "mean_term", "spread_term"]
    met = live.select("a", "b", *(F.col(c).alias(f"live_{c}") for c in names)).join(yoked.select("a", "b", *(F.col(c).alias(f"yoked_{c}") for c in names)), ["a", "b"])
    less = lambda c: F.col(f"live_{c}") - F.col(f"yoked_{c}")
    return met.select("*", less("w2").alias("delta"), less("mean_term").alias("delta_mean_term"), less("spread_term").alias("delta_spread_term"))


def drawn(text: Column, among: Column) -> Column:
    """A place under ``among``, from 0, drawn by the first eight hex digits of the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % among


def _draws(members: DataFrame, replicates: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(member, place), numbered by the order of members, and (replicate, place), one row for each draw."""
    from pyspark.sql import Window

    from skein.operators.sequences import numbered as in_ranges

    members = settled(members.select("member"))
    if dict(members.dtypes)["member"] == "string":
        # members are the builds of an experiment, one row each
        numbered = members.select("member", (F.row_number().over(Window.orderBy("member")) - 1).cast("long").alias("place"))
    else:
        numbered = in_ranges(members, "member", name="place").select("member", (F.col("place") - 1).cast("long").alias("place"))
    count = members.count()
    key = F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("place").cast("string"))
    # places are the numbers under the count, whatever the members are; they are dealt before replicates multiply them
    each = members.sparkSession.range(count).select(F.col("id").alias("place"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    return numbered, each.select("replicate", drawn(key, F.lit(max(1, count))).alias("place"))


def draw_lists(members: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(member, drawn): the replicates that draw each of the rows (member), once for each time."""
    numbered, draws = _draws(members, replicates, seed)
    lists = draws.groupBy("place").agg(F.collect_list(F.col("replicate").cast("short")).alias("drawn"))
    return lists.join(numbered, "place").select("member", "drawn")


def draw_members(members: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, member, times): how often each replicate draws each of the rows (member); members are numbered by their order."""
    numbered, draws = _draws(members, replicates, seed)
    return draws.groupBy("replicate", "place").agg(F.count("*").alias("times")).join(numbered.select("place", "member"), "place").select("replicate", "member", "times")


def dyadic_replicates(pairs: DataFrame, value: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, mean): the mean of a value over rows (a, b, value), each counted as often as both members are drawn."""
    members = pairs.select(F.explode(F.array("a", "b")).alias("member")).distinct()
    times = draw_members(members, replicates, seed)
    left, right = (times.select(F.col("member").alias(c), "replicate", F.col("times").alias(f"times_{c}")) for c in "ab")
    met = pairs.select("a", "b", F.col(value).alias("x")).join(left, "a").join(right, ["b", "replicate"])
    w = F.col("times_a") * F.col("times_b")
    return met.groupBy("replicate").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("mean"))


def dyadic_interval(pairs: DataFrame, value: str, replicates: int = 500, seed: int = 1) -> DataFrame:
    """One row (mean, low, high, replicates, n_pairs): the mean over pairs and its 95 % interval over resampled members."""
    found = dyadic_replicates(pairs, value, replicates, seed).agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), F.count("*").alias("replicates"))
    return pairs.agg(F.avg(value).alias("mean"), F.count(value).alias("n_pairs")).crossJoin(found)  # one row each


def unit_draw(text: Column) -> Column:
    """A number from 0 to under 1 by the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def cluster_power(rates: DataFrame, sizes: list[int], deltas: list[float], tosses: int, trials: int, seed: int = 1, critical: float = 2.0) -> DataFrame:
    """(size, delta, power): how often a t test of whole clusters finds a shift.

    ``rates`` are rows (place, rate), places numbered from 0.  A trial draws ``size`` rates for each of two arms,
    the second one shifted by ``delta`` within 0 and 1, tosses each ``tosses`` times, and compares
    the arms' mean shares by Welch's statistic.  Trials are rows, dealt over the cluster.
    """
    spark = rates.sparkSession
    grid = spark.createDataFrame([(s, d) for s in sizes for d in deltas], "size int, delta double")
    rows = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")).select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("unit")).select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("arm"))
    n = rates.agg(F.count("*").alias("of"))
    key = F.concat_ws(":", F.lit(str(seed)), "arm", "size", "trial", "unit")
    placed = rows.crossJoin(F.broadcast(n)).withColumn("place", drawn(key, F.col("of")))  # one row
    rate = F.when(F.col("arm") == "b", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rate") + F.col("delta")))).otherwise(F.col("rate"))
    hits = F.aggregate(F.sequence(F.lit(1), F.lit(tosses)), F.lit(0), lambda k, i: k + F.when(unit_draw(F.concat_ws(":", key, i.cast("string"))) < F.col("p"), 1).otherwise(0))
    shares = placed.join(rates, "place").withColumn("p", rate).select("size", "delta", "trial", "arm", (hits / F.lit(tosses)).alias("share"))
    arms = shares.groupBy("size", "delta", "trial", "arm").agg(F.avg("share").alias("m"), (F.var_samp("share") / F.col("size")).alias("v"))
    both = arms.groupBy("size", "delta", "trial").agg(*(F.max(F.when(F.col("arm") == x, F.col(c))).alias(c + x) for x in "ab" for c in "mv"))
    t = F.when(F.col("va") + F.col("vb") > 0, F.abs(F.col("ma") - F.col("mb")) / F.sqrt(F.col("va") + F.col("vb"))).otherwise(0.0)
    return both.groupBy("size", "delta").agg(F.avg((t > critical).cast("double")).alias("power"))


def required_size(power: DataFrame, wanted: float = 0.8) -> DataFrame:
    """(delta, required): the least size from which on, in the grid, every size reaches the wanted power; null if none does."""
    short = F.max(F.when(F.col("power") < wanted, F.col("size"))).alias("short")
    worst = power.groupBy("delta").agg(short)
    return power.join(worst, "delta").groupBy("delta").agg(F.min(F.when(F.col("short").isNull() | (F.col("size") > F.col("short")), F.col("size"))).alias("required"))
