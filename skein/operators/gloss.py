"""Scene trees as text: a fold over the node table, one level at a time.

The deepest nodes are said first; what they say meets their parents by an equi-join on scene and
path, level by level up to the top, so no task walks a tree.  ``gloss`` says every part in the
order of the surface; ``prose`` makes sentences, embedded nodes as gerunds.  The words are given as ``Glosses``.

Defined cases: a form without a gloss stands for itself; a scene without nodes says nothing; clauses of one
relator follow their texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Glosses:
    """What forms mean, by class, and how each force closes a sentence."""

    words: dict[str, dict[str, str]]
    codas: dict[str, str]

    def of(self, letter: str, form: Column) -> Column:
        known = self.words.get(letter, {})
        return F.coalesce(F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[form], form) if known else form

    def coda(self, force: Column) -> Column:
        return F.coalesce(F.create_map(*(F.lit(x) for pair in self.codas.items() for x in pair))[force], F.lit("."))


def fold(nodes: DataFrame, say: Callable[[bool], Column], levels: int) -> DataFrame:
    """(id, force, text): the top nodes' text, where ``say`` sees each node's columns and ``clauses`` (relator, text) of its children, and whether it is the top."""
    children = None
    for depth in range(levels, -1, -1):
        own = nodes.filter(F.col("depth") == depth)
        none = F.array().cast("array<struct<relator: string, text: string>>")
        own = own.withColumn("clauses", none) if children is None else own.join(children, ["id", "path"], "left").withColumn("clauses", F.coalesce("clauses", none))
        said = own.select("id", "force", "path", "relator", say(depth == 0).alias("text"))
        above = F.slice("path", 1, F.size("path") - 1).alias("path")
        children = said.filter(F.size("path") > 0).groupBy("id", above).agg(F.array_sort(F.collect_list(F.struct("relator", "text"))).alias("clauses"))
    return said.select("id", "force", "text")


def _times(c: str) -> Column:
    return F.when(F.col(c) > 1, F.concat(F.lit(" x"), F.col(c).cast("string"))).otherwise("")


def gloss(nodes: DataFrame, words: Glosses, levels: int) -> DataFrame:
    """(id, text): every part in the order of the surface, clauses in brackets, and the force's coda."""

    def say(top: bool) -> Column:
        slots = F.array_compact(F.array(*(words.of(k, F.col(c)) for k, c in (("Q", "quant"), ("T", "tense"), ("M", "modal")))))
        orients = F.transform("orient", lambda o: words.of("O", o))
        clauses = F.transform("clauses", lambda c: F.concat(words.of("L", c["relator"]), F.lit(" ["), c["text"], F.lit("]")))
        core = F.concat_ws(", ", words.of("R", F.col("root")), F.concat(words.of("A", F.col("aspect_root")), _times("aspect_reps")), F.concat(words.of("D", F.col("degree")), F.lit("ly")))
        return F.concat_ws(", ", slots, orients, clauses, core)

    return fold(nodes, say, levels).select("id", F.concat("text", words.coda(F.col("force"))).alias("text"))


def gerund(verb: Column) -> Column:
    """The form in -ing of a verb in the third person: glows, glowing; stops, stopping; dies, dying; makes, making."""
    base = (
        F.when(verb.rlike("[^aeiou]ies$") & (F.length(verb) > 4), F.concat(F.regexp_replace(verb, "ies$", ""), F.lit("y")))
        .when(verb.rlike("(s|sh|ch|x|z|o)es$"), F.regexp_replace(verb, "es$", ""))
        .otherwise(F.regexp_replace(verb, "s$", ""))
    )
    return (
        F.when(base.rlike("ie$"), F.concat(F.regexp_replace(base, "ie$", "y"), F.lit("ing")))
        .when(base.rlike("[^eoy]e$"), F.concat(F.regexp_replace(base, "e$", ""), F.lit("ing")))
        .when(base.rlike("^[^aeiou]*[aeiou][^aeiouwxy]$"), F.concat(base, F.right(base, F.lit(1)), F.lit("ing")))
        .otherwise(F.concat(base, F.lit("ing")))
    )


def prose(nodes: DataFrame, words: Glosses, levels: int) -> DataFrame:
    """(id, text): a sentence in which the top node is a verb without a subject and embedded nodes are gerunds, their parts between dashes."""

    def say(top: bool) -> Column:
        verb = words.of("R", F.col("root"))
        core = F.concat(F.lit("it "), verb) if top else F.concat(F.lit("a "), gerund(verb))
        degree = F.concat(words.of("D", F.col("degree")), F.lit("ly"))
        frames = F.array_compact(F.array(words.of("Q", F.col("quant")), words.of("T", F.col("tense")), F.concat(F.lit("as "), words.of("M", F.col("modal")))))
        orients = F.when(F.size("orient") > 0, F.array_join(F.transform("orient", lambda o: words.of("O", o)), " and "))
        clauses = F.transform("clauses", lambda c: F.concat(words.of("L", c["relator"]), F.lit(" "), c["text"]))
        aspect = F.concat(words.of("A", F.col("aspect_root")), _times("aspect_reps"))
        if top:
            return F.concat_ws(", ", frames, orients, clauses, core, degree, aspect)
        more = F.concat_ws(", ", degree, aspect, orients, clauses, frames)
        return F.when(more == "", core).otherwise(F.concat(core, F.lit(" - "), more, F.lit(" -")))

    said = fold(nodes, say, levels)
    text = F.regexp_replace("text", "-, ", "- ")
    return said.select("id", F.concat(F.upper(F.substring(text, 1, 1)), F.expr("substring(regexp_replace(text, '-, ', '- '), 2)"), words.coda(F.col("force"))).alias("text"))


def impressions(nodes: DataFrame) -> DataFrame:
    """(id, impression): the digest of what a scene denotes, decoration aside; equal scenes under that projection share it."""
    return nodes.filter("depth = 0").select("id", F.sha2("denoted", 256).alias("impression"))


def compatible(nodes: DataFrame) -> DataFrame:
    """(id, first, n): the smallest id of the same impression, and how many ids share it."""
    known = impressions(nodes)
    groups = known.groupBy("impression").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return known.join(groups, "impression").select("id", "first", "n")
