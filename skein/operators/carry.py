"""What a reply carries over from the line before: stems, roots, families, and synonyms from distributions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.settle import settled

# fixed values: endings in the order in which they are tried, and words that carry nothing
ENDINGS = ("iness", "ness", "ingly", "ing", "edly", "ed", "es", "s", "en")
STOP = (
    "a an the and or but so then than that this those these it its is are was were be been being am i me my we our you your he she "
    "they them his her their of in on at to for from with by as if not no nor do does did done have has had will would can could "
    "should may might must just about into over under again very too much more most some any all own same don now there here when "
    "where how what who whom which while up down out off once got get"
).split()


def strip_ending(word: Column) -> Column:
    """One pass: the first ending that leaves three letters goes, and a doubled consonant before it becomes single."""

    def single(base: Column) -> Column:
        last, before = F.right(base, F.lit(1)), F.substring(base, -2, 1)
        return F.when((F.length(base) > 3) & (last == before) & ~last.isin(*"aeiou"), F.substr(base, F.lit(1), F.length(base) - 1)).otherwise(base)

    out = None
    for ending in ENDINGS:
        fits = word.endswith(ending) & (F.length(word) >= 3 + len(ending))
        base = single(F.substr(word, F.lit(1), F.length(word) - len(ending)))
        out = F.when(fits, base) if out is None else out.when(fits, base)
    return out.otherwise(word)


def stem_sql(word: str) -> str:
    """``strip_ending`` in DuckDB's SQL."""
    cases = []
    for ending in ENDINGS:
        base = f"left({word}, length({word}) - {len(ending)})"
        cases.append(f"when {word} like '%{ending}' and length({word}) >= {3 + len(ending)} then case when length({base}) > 3 and right({base}, 1) = left(right({base}, 2), 1) and right({base}, 1) not in ('a', 'e', 'i', 'o', 'u') then left({base}, length({base}) - 1) else {base} end")
    return f"case {' '.join(cases)} else {word} end"


def stems(words: DataFrame, word: str = "w", passes: int = 3) -> DataFrame:
    """(word, stem) of the distinct words that may carry: endings stack, so they are stripped ``passes`` times."""
    out = words.select(word).distinct().filter((F.length(word) > 2) & ~F.col(word).isin(*STOP)).withColumn("stem", F.col(word))
    for _ in range(passes):
        out = out.withColumn("stem", strip_ending(F.col("stem")))
    return out


def stem_array(words: Column, passes: int = 3) -> Column:
    """The stems of those of an array of words that may carry."""
    out = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP))
    for _ in range(passes):
        out = F.transform(out, strip_ending)
    return out


def exchanges(turns: DataFrame, key: str, order: list[str], asks: str, answers: str, role: str = "role", text: str = "text") -> DataFrame:
    """(key, i, prior, reply): texts of the rows of role ``answers`` that follow one of role ``asks``."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = turns.select(key, F.row_number().over(w).alias("i"), F.lag(text).over(w).alias("prior"), F.lag(role).over(w).alias("_before"), F.col(text).alias("reply"), F.col(role).alias("_own"))
    return rows.filter((F.col("_own") == answers) & (F.col("_before") == asks)).select(key, "i", "prior", "reply")


def gate(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, i, carried, added, reason, kept): shared stems, new words, and whether all exchanges so far carry."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z']+)")))
    # both sides lie in one row, so words need not be exploded, shuffled and joined
    sides = pairs.select(key, "i", words(F.col("prior")).alias("p"), words(F.col("reply")).alias("r"))
    carried = F.size(F.array_intersect(stem_array(F.col("p")), stem_array(F.col("r"))))
    v = sides.select(key, "i", carried.cast("long").alias("carried"), F.size(F.array_except("r", "p")).cast("long").alias("added"))
    v = v.withColumn("reason", F.when(F.col("carried") == 0, "nothing carried").when(F.col("added") == 0, "echo").otherwise("ok"))
    bad = F.sum((F.col("reason") != "ok").cast("int")).over(Window.partitionBy(key).orderBy("i"))
    return v.withColumn("kept", bad == 0)


def bands(rows: DataFrame, prior: str, roots: str, family: Callable[[Column], Column]) -> DataFrame:
    """Adds carried, band, carried_soft and band_soft; in the soft band a root counts as carried if its family was there, and only else as new."""
    exact = F.size(F.array_intersect(prior, roots))
    families = F.transform(prior, family)
    soft = F.size(F.filter(roots, lambda x: F.array_contains(families, family(x))))
    band = lambda n: F.when(F.size(roots) == 0, "no root").when(n == 0, "nothing carried").when(F.size(roots) - n == 0, "echo").otherwise("ok")
    return rows.withColumn("carried", exact.cast("long")).withColumn("band", band(exact)).withColumn("carried_soft", soft.cast("long")).withColumn("band_soft", band(soft))


def marked_rates(turns: DataFrame, key: str, order: list[str], items: str) -> DataFrame:
    """Rates at which roots of the turn before appear again, marked or not; a rate over nothing is null."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = turns.select(F.col(items).alias("now"), F.lag(items, 1).over(w).alias("prior"), F.coalesce(F.lag(items, 2).over(w), F.array().cast("array<string>")).alias("before")).filter("prior is not null")
    o = rows.select(F.explode("prior").alias("root"), "now", "before").select(F.array_contains("before", F.col("root")).alias("marked"), F.array_contains("now", F.col("root")).cast("int").alias("again"))
    rate = {m: F.avg(F.when(F.col("marked") == m, F.col("again"))) for m in (True, False)}
    return o.agg(F.count_if("marked").alias("n_marked"), F.count_if(~F.col("marked")).alias("n_unmarked"), rate[True].alias("p_marked"), rate[False].alias("p_unmarked"), (rate[True] - rate[False]).alias("difference"))


def attested(words: DataFrame, roots: DataFrame, on: str, support: int, turns: int, purity: float, share: float) -> DataFrame:
    """(word, root, c): roots that a word lands on with support and share; words seen too seldom, impure or of one root are left out."""
    # counts of words and roots, used several times
    hits = settled(words.join(roots, on).groupBy("word", "root").agg(F.count("*").alias("c")))
    seen = settled(words.groupBy("word").agg(F.count("*").alias("seen")))
    top = hits.groupBy("word").agg(F.max("c").alias("top"))
    named = seen.join(top, "word").filter((F.col("seen") >= turns) & (F.col("top") / F.col("seen") >= purity)).select("word", "seen")
    held = hits.join(named, "word").filter((F.col("c") >= support) & (F.col("c") / F.col("seen") >= share)).select("word", "root", "c")
    several = held.groupBy("word").agg(F.count("*").alias("k")).filter("k > 1").select("word")
    return held.join(several, "word", "left_semi")


def alternation(words: DataFrame, roots: DataFrame, held: DataFrame, on: str = "o") -> DataFrame:
    """(word, a, b, n_a, n_b, together, co_rate, companions) of every two roots of a word, over the turns that hold the word."""
    present = words.join(roots, on).join(held.select("word", "root"), ["word", "root"], "left_semi")
    of_turn = present.groupBy(on, "word").agg(F.array_sort(F.collect_set("root")).alias("r"))
    couple = F.flatten(F.transform("r", lambda x, i: F.transform(F.slice("r", i + 2, F.size("r")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = of_turn.select("word", F.explode(couple).alias("p")).groupBy("word", "p.a", "p.b").agg(F.count("*").alias("together"))
    a, b = (held.select("word", F.col("root").alias(n), F.col("c").alias(f"n_{n}")) for n in ("a", "b"))
    out = a.join(b, "word").filter("a < b").join(both, ["word", "a", "b"], "left").fillna(0, ["together"])
    rate = F.col("together") / F.least("n_a", "n_b")
    return out.select("word", "a", "b", "n_a", "n_b", "together", F.round(rate, 4).alias("co_rate"), (rate >= 0.9).alias("companions"))


def synonyms(words: DataFrame, roots: DataFrame, held: DataFrame) -> DataFrame:
    """(root, others): roots that attest to a word of the root, itself left out; words and roots are those of ``held``."""
    a, b = held.select("word", "root"), held.select("word", F.col("root").alias("other"))
    return a.join(b, "word").filter("root <> other").groupBy("root").agg(F.collect_set("other").alias("others"))
