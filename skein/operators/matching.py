"""Patterns over scene trees: which scenes fit a pattern set, and which patterns stay possible.

The node table meets the pattern table on the root that a pattern names, an equi-join.  Two
questions are then settled scene by scene over at most a few patterns and nodes, with array
expressions: ``matching`` (every pattern of a referent has a node of its own) and its dual
``consistent`` (every node has a pattern of its own, so the referent may still be meant).

Referents are rows of ``REFERENT``; ``patterns_of`` lays their patterns out one by one, and
``load`` refuses sets that may not run.

Defined cases: a null or empty list in a pattern constrains nothing; a residue that was not transmitted (null)
breaks no constraint; a scene without nodes matches nothing; a referent without patterns is refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.grammar import Lexicon
from skein.plans.gates import Refusal

_NODE = "struct<roots: array<string>, orients: array<string>, aspects: array<string>, relators: array<string>, via: array<string>, at_depth: int, residues: array<string>>"
#: a referent with its signature: patterns that need nodes, patterns that must not occur, and one for the top node
REFERENT = f"id string, family string, status string, seed boolean, contains array<{_NODE}>, forbid array<{_NODE}>, matrix {_NODE}"
#: what a pattern row holds: the referent, a number within it, and any-of lists (null or empty: no constraint)
PATTERN = "ref string, role string, ord int, roots array<string>, orients array<string>, aspects array<string>, relators array<string>, via array<string>, at_depth int"
STATUSES = ("UNREVIEWED", "REVIEWED", "REJECTED")


def patterns_of(referents: DataFrame) -> DataFrame:
    """One row for each pattern of each referent, by role and number."""
    empty = F.array().cast(f"array<{_NODE}>")
    parts = [
        referents.select(F.col("id").alias("ref"), F.lit(role).alias("role"), F.posexplode(F.coalesce(F.col(column), empty)).alias("ord", "p"))
        for role, column in (("contains", "contains"), ("forbid", "forbid"))
    ]
    top = referents.filter(F.col("matrix").isNotNull()).select(F.col("id").alias("ref"), F.lit("matrix").alias("role"), F.lit(0).alias("ord"), F.col("matrix").alias("p"))
    return reduce(DataFrame.unionAll, [*parts, top]).select("ref", "role", "ord", "p.*")


def _refuse(found: DataFrame, what: str) -> None:
    """Raise if the frame has rows; at most five of its ids are named."""
    bad = [str(r[0]) for r in found.select(found.columns[0]).distinct().limit(5).collect()]
    if bad:
        raise Refusal(f"{what}: {', '.join(sorted(bad))}")


def foreign_forms(patterns: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(ref, kind, form) of pattern forms that their class does not hold."""
    kinds = {"roots": "R", "orients": "O", "aspects": "A", "relators": "L", "via": "L"}
    named = F.array(*(F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("forms"), F.array(*map(F.lit, lexicon.classes[k])).alias("known")) for c, k in kinds.items()))
    rows = patterns.select("ref", F.inline(named)).select("ref", "kind", F.explode(F.array_except("forms", "known")).alias("form"))
    return rows.distinct()


def load(referents: DataFrame, lexicon: Lexicon, allow_unreviewed: bool = False, seeds_only: bool = True, residues: bool = False) -> DataFrame:
    """The referents that may run, refusing a set that may not.

    Refused are: a status that is unknown, or other than REVIEWED without ``allow_unreviewed``;
    ids that occur twice and several families, before the seeds are chosen; referents without
    patterns or with more than the lexicon's clauses hold; pattern forms outside their class; ``via`` with another depth than 1.
    With ``residues``, also referents of which no pattern names a residue, and two referents of the same roots that share one.
    """
    status = F.col("status")
    _refuse(referents.filter(status.isNull() | ~status.isin(*STATUSES)), "unknown review status")
    if not allow_unreviewed:
        _refuse(referents.filter(status != "REVIEWED"), "not reviewed")
    _refuse(referents.groupBy("id").count().filter("count > 1 or id is null"), "ids occur twice")
    families = referents.select("family").distinct().limit(2).collect()
    if len(families) > 1:
        raise Refusal("several families in one set")
    size = F.coalesce(F.size("contains"), F.lit(0))
    _refuse(referents.filter((size == 0) | (size > lexicon.clauses + 1)), "patterns do not fit the clauses")
    patterns = patterns_of(referents)
    _refuse(patterns.filter("roots is null or size(roots) = 0"), "a pattern without roots")
    _refuse(patterns.filter("coalesce(size(via), 0) > 0 and at_depth <> 1"), "via stands at depth 1")
    _refuse(foreign_forms(patterns, lexicon), "forms outside their class")
    kept = referents.filter(F.coalesce("seed", F.lit(True))) if seeds_only else referents
    if residues:
        named = patterns_of(kept).filter("role = 'contains'").select("ref", F.explode("residues").alias("residue"))
        _refuse(kept.join(named, kept.id == named.ref, "left_anti"), "no residue named")
        cluster = F.transform("contains", lambda p: F.array_join(F.array_sort(p["roots"]), "|"))
        mates = kept.select("id", F.array_join(cluster, ",").alias("cluster")).join(named, F.col("id") == F.col("ref"))
        _refuse(mates.groupBy("cluster", "residue").count().filter("count > 1"), "mates of one cluster share a residue")
    return kept


def load_all(sets: list[DataFrame], lexicon: Lexicon, **options: bool) -> DataFrame:
    """The union of several sets, loaded as one."""
    return load(reduce(DataFrame.unionByName, sets), lexicon, **options)


def _open(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def fits(roots: Column, orients: Column, aspects: Column, relators: Column, n_root: Column, n_orient: Column, n_aspect: Column, n_relators: Column) -> Column:
    """Whether a node fits a pattern; a null or empty list constrains nothing but the root."""
    return (
        F.array_contains(roots, n_root)
        & (_open(orients) | F.coalesce(F.arrays_overlap(orients, n_orient), F.lit(False)))
        & (_open(aspects) | F.coalesce(F.array_contains(aspects, n_aspect), F.lit(False)))
        & (_open(relators) | F.coalesce(F.arrays_overlap(relators, n_relators), F.lit(False)))
    )


def candidates(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, ref, role, ord, path) of nodes that fit a pattern, from the node table of ``scene_nodes``.

    A node's ``residue`` and a pattern's ``residues`` are compared where both frames have them.
    """
    below = nodes.filter("depth > 0").select("id", F.slice("path", 1, F.size("path") - 1).alias("path"), F.col("relator").alias("_r"))
    edges = below.groupBy("id", "path").agg(F.collect_set("_r").alias("out"))
    n = nodes.join(edges, ["id", "path"], "left").withColumn("out", F.coalesce("out", F.array().cast("array<string>")))
    p = patterns.withColumn("root", F.explode(F.array_distinct("roots")))
    met = n.join(p, "root")
    ok = fits(F.col("roots"), F.col("orients"), F.col("aspects"), F.col("relators"), F.col("root"), F.col("orient"), F.col("aspect_root"), F.col("out"))
    if "residues" in patterns.columns and "residue" in nodes.columns:
        ok = ok & (_open(F.col("residues")) | F.col("residue").isNull() | F.array_contains("residues", F.col("residue")))
    placed = (_open(F.col("via")) | ((F.col("depth") == 1) & F.array_contains("via", F.col("relator")))) & (F.col("at_depth").isNull() | (F.col("at_depth") == F.col("depth")))
    return met.filter(ok & ((F.col("role") != "contains") | placed)).select("id", "ref", "role", "ord", F.array_join("path", ".").alias("path"))


def _allowed() -> list[Column]:
    """Whether an anti-pattern or the pattern of the top node speaks against a scene."""
    return [
        F.max(F.when(F.col("role") == "forbid", 1).otherwise(0)).alias("forbidden"),
        F.max(F.when((F.col("role") == "matrix") & (F.col("path") == ""), 1).otherwise(0)).alias("top"),
    ]


def _assignments(lists: list[str], size: Column) -> Column:
    """Ways to give each of the first ``size`` lists a member that no other has."""

    def extend(partial: Column, k: int) -> Column:
        c = F.col(lists[k])
        more = F.flatten(F.transform(partial, lambda a: F.transform(F.filter(c, lambda x: ~F.array_contains(a, x)), lambda x: F.array_append(a, x))))
        return F.when(size > k, more).otherwise(partial)

    return reduce(extend, range(len(lists)), F.array(F.array().cast("array<string>")))


def _wanted(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("ref").agg(F.count_if(F.col("role") == "contains").alias("k"), F.count_if(F.col("role") == "matrix").alias("m"))


#: no pattern speaks against the scene
_FREE = "forbidden = 0 and (m = 0 or top = 1)"


def matching(nodes: DataFrame, patterns: DataFrame, most: int = 4) -> DataFrame:
    """(id, ref): every ``contains`` pattern has a node of its own, the ``matrix`` pattern fits the top, no ``forbid`` pattern fits."""
    found = candidates(nodes, patterns)
    lists = [f"c{k}" for k in range(most)]
    sets = found.groupBy("id", "ref").agg(*(F.collect_set(F.when((F.col("role") == "contains") & (F.col("ord") == k), F.col("path"))).alias(c) for k, c in enumerate(lists)), *_allowed())
    whole = sets.join(_wanted(patterns).filter(F.col("k") <= most), "ref")
    return whole.filter(_FREE).filter(F.size(_assignments(lists, F.col("k"))) > 0).select("id", "ref")


def consistent(nodes: DataFrame, patterns: DataFrame, most: int = 4) -> DataFrame:
    """(id, ref): every node has a ``contains`` pattern of its own, with the same conditions; scenes of more nodes than patterns have none."""
    number = nodes.groupBy("id").agg(F.array_sort(F.collect_set(F.array_join("path", "."))).alias("paths")).filter(F.size("paths") <= most)
    found = candidates(nodes, patterns).join(number, "id").withColumn("at", F.array_position("paths", F.col("path")) - 1)
    lists = [f"c{k}" for k in range(most)]
    ord_ = F.when(F.col("role") == "contains", F.col("ord").cast("string"))
    sets = found.groupBy("id", "ref").agg(*(F.collect_set(F.when(F.col("at") == k, ord_)).alias(c) for k, c in enumerate(lists)), F.max(F.size("paths")).alias("n"), *_allowed())
    whole = sets.join(_wanted(patterns), "ref").filter("n <= k")
    return whole.filter(_FREE).filter(F.size(_assignments(lists, F.col("n"))) > 0).select("id", "ref")


def ambiguity(matched: DataFrame, scenes: DataFrame, key: str = "id") -> DataFrame:
    """(key, n): how many referents each scene fits, zero included."""
    return scenes.select(key).distinct().join(matched.groupBy(key).agg(F.count("*").alias("n")), key, "left").fillna(0, ["n"])


def colliding(matched: DataFrame, weights: DataFrame) -> DataFrame:
    """(a, b, n): pairs of referents that scenes fit together, a before b, with the weight of these scenes (id, n)."""
    refs = matched.groupBy("id").agg(F.array_sort(F.collect_set("ref")).alias("refs")).filter(F.size("refs") > 1).join(weights, "id")
    pairs = F.flatten(F.transform("refs", lambda a: F.transform(F.filter("refs", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return refs.select(F.inline(pairs), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))


def bare_heads(nodes: DataFrame) -> DataFrame:
    """The node table of the top nodes alone: without clauses, aspects and other decoration, orientations kept."""
    kept = [F.lit(None).cast(t).alias(c) if c in ("aspect_root", "aspect_reps", "degree", "modal", "tense", "quant") else F.col(c) for c, t in nodes.dtypes]
    return nodes.filter("depth = 0").select(*kept)


def without_aspects(nodes: DataFrame) -> DataFrame:
    """The node table with the top nodes' aspects gone."""
    top = F.col("depth") == 0
    return nodes.withColumn("aspect_root", F.when(~top, F.col("aspect_root"))).withColumn("aspect_reps", F.when(~top, F.col("aspect_reps")))
