"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of a-z of the lower-cased text, in order; none for null."""
    return F.filter(F.split(F.coalesce(F.lower(text), F.lit("")), "[^a-z]+"), lambda x: x != "")


def token_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(text)))


def flatten(text: Column) -> Column:
    """White space runs become one space, control characters go, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\p{C}", ""))


def clip(text: Column, most: int, mark: str = "…") -> Column:
    """At most ``most`` characters, the mark included; null stays null."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - len(mark))), F.lit(mark))).otherwise(text)


def flags(text: Column, rules: list[tuple[str, str, int]]) -> tuple[Column, Column]:
    """(names of the rules that match, largest severity) for rules of (name, pattern, severity)."""
    names = F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p, _ in rules)))
    severity = F.greatest(F.lit(0), *(F.when(text.rlike(p), F.lit(s)).otherwise(F.lit(0)) for _, p, s in rules))
    return names, severity


def counts(items: Column) -> Column:
    """Multiset of an array as a map from item to count."""
    distinct = F.array_distinct(items)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda d: F.size(F.filter(items, lambda x: x == d))))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection over the longer length; null if both are empty."""
    shared = F.array_distinct(F.array_intersect(a, b))
    both = F.aggregate(shared, F.lit(0), lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))
    return F.try_divide(both.cast("double"), F.greatest(F.size(a), F.size(b)))


def seconds(span: Column) -> Column:
    """``7d``, ``24h``, ``30m`` or ``15s`` in seconds; null if it is none of these."""
    unit = F.create_map(*(F.lit(x) for pair in {"d": 86400, "h": 3600, "m": 60, "s": 1}.items() for x in pair))
    return F.when(span.rlike(r"^\d+[dhms]$"), F.regexp_extract(span, r"^(\d+)", 1).cast("long") * unit[F.right(span, F.lit(1))])


def hash_share(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the salted key alone."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
