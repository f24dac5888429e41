"""Legal next tokens of a prefix: a finite automaton over token classes, folded by Spark expressions.

The grammar of ``grammar.Lexicon`` nests predications to a bounded depth, so all that a prefix
leaves open is one of a few hundred states: how many clauses each waiting predication has, and
how far the innermost one has come.  ``Automaton`` derives the states and their transitions
from the caps of the lexicon; a surface is then an ``aggregate`` over its tokens that looks
transitions up in an array.  A token is legal only if what it leaves open can still be closed within
the length the lexicon allows: one root for each predication without one, and a force.

No legal surface has more tokens than the lexicon allows, so the fold reads that many and one
more; what comes after an illegal token is never legal.

Defined cases: a null or blank surface has no tokens, is not accepted and may go on with
whatever begins a surface; an unknown token is illegal; an accepted surface may not go on.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grammar import Lexicon

#: the classes in the order of the transition table
CLASSES = "QTMOLRADF"
DEAD = -1


@dataclass(frozen=True)
class Open:
    """What a prefix leaves open.

    ``waiting``: clauses that each outer predication has so far, outermost first; ``stage`` and
    ``count`` of the innermost: stages 0 to 3 stand before Q, T, M and O (with ``count`` orientations),
    4 before a clause (``count`` clauses), 5 behind the root, 6 behind the aspect, 7 behind the degree,
    where the predication is over; 8 behind the force.
    """

    waiting: tuple[int, ...] = ()
    stage: int = 0
    count: int = 0

    @property
    def roots_due(self) -> int:
        return len(self.waiting) + (self.stage < 5)

    def closed(self) -> Open | None:
        """The state once the innermost predication, whose root is there, is over; None if there is no outer one."""
        return Open(self.waiting[:-1], 4, self.waiting[-1] + 1) if self.waiting else None

    def after(self, letter: str, lexicon: Lexicon) -> Open | None:
        """The state behind a token of the class, None if the class cannot stand here."""
        if self.stage < 5:
            place = "QTMOL".find(letter)
            if letter == "R":
                return Open(self.waiting, 5)
            if place < self.stage:
                return None
            if letter == "O":
                have = self.count if self.stage == 3 else 0
                return Open(self.waiting, 3, have + 1) if have < lexicon.orients else None
            if letter == "L":
                have = self.count if self.stage == 4 else 0
                return Open((*self.waiting, have)) if have < lexicon.clauses and len(self.waiting) < lexicon.depth else None
            return Open(self.waiting, place + 1)
        if self.stage == 8:
            return None
        if letter == "A" and self.stage == 5:
            return Open(self.waiting, 6)
        if letter == "D" and self.stage < 7:
            return Open(self.waiting, 7)
        outer = self.closed()
        if outer:
            return outer.after(letter, lexicon)
        return Open((), 8) if letter == "F" else None


@dataclass(frozen=True)
class Automaton:
    """The states of a lexicon, numbered from 0 (nothing read), and where each class leads."""

    lexicon: Lexicon

    @cached_property
    def states(self) -> list[Open]:
        found, number = [Open()], {Open()}
        for state in found:
            for letter in CLASSES:
                after = state.after(letter, self.lexicon)
                if after and after not in number:
                    number.add(after)
                    found.append(after)
        return found

    @cached_property
    def table(self) -> list[int]:
        """State behind each class of each state, class by class; ``DEAD`` where it cannot stand."""
        number = {s: i for i, s in enumerate(self.states)}
        return [number.get(s.after(c, self.lexicon), DEAD) for s in self.states for c in CLASSES]

    @cached_property
    def due(self) -> list[int]:
        """Tokens that each state needs at least before the surface is over: its roots and the force."""
        return [0 if s.stage == 8 else s.roots_due + 1 for s in self.states]

    @cached_property
    def done(self) -> int:
        return self.states.index(Open((), 8))


def _numbers(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(map(str, values)) + ")")


def tokens_of(surface: Column) -> Column:
    return F.filter(F.split(F.coalesce(surface, F.lit("")), r"\s+"), lambda t: t != "")


def walk(tokens: Column, automaton: Automaton) -> Column:
    """struct(state, used, read): where the longest legal prefix of a token array ends, its length in morphemes and in tokens."""
    lexicon = automaton.lexicon
    place = {t: CLASSES.index(c) for t, (c, _) in lexicon.table.items()}
    read = F.create_map(*(F.lit(x) for t, (_, cost) in lexicon.table.items() for x in (t, place[t] * 64 + cost)))
    table, due = _numbers(automaton.table), _numbers(automaton.due)
    steps = F.transform(F.slice(tokens, 1, lexicon.most + 1), lambda t: F.coalesce(read[t], F.lit(DEAD)))

    def step(at: Column, code: Column) -> Column:
        after = F.when(code >= 0, F.get(table, at["state"] * len(CLASSES) + F.floor(code / 64).cast("int"))).otherwise(DEAD)
        used = at["used"] + code % 64
        fits = (after >= 0) & (used + F.get(due, F.greatest(after, F.lit(0))) <= lexicon.most)
        return F.when(at["alive"] & fits, F.struct(after.alias("state"), used.alias("used"), (at["read"] + 1).alias("read"), F.lit(True).alias("alive"))).otherwise(
            F.struct(at["state"].alias("state"), at["used"].alias("used"), at["read"].alias("read"), F.lit(False).alias("alive"))
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("used"), F.lit(0).alias("read"), F.lit(True).alias("alive"))
    return F.aggregate(steps, start, step, lambda at: F.struct(at["state"].alias("state"), at["used"].alias("used"), at["read"].alias("read")))


def legal_next(at: Column, automaton: Automaton) -> Column:
    """Classes that may follow, in the order of ``CLASSES``; the aspect with how often its root may be repeated, as ``A3``."""
    lexicon = automaton.lexicon
    table, due = _numbers(automaton.table), _numbers(automaton.due)

    def room(place: int, cost: int) -> Column:
        after = F.get(table, at["state"] * len(CLASSES) + place)
        return (after >= 0) & (at["used"] + cost + F.get(due, F.greatest(after, F.lit(0))) <= lexicon.most)

    offers = []
    for place, letter in enumerate(CLASSES):
        if letter == "A":
            most = F.greatest(*(F.when(room(place, n + 1), n).otherwise(0) for n in range(1, lexicon.repetitions + 1)), F.lit(0))
            offers.append(F.when(most > 0, F.concat(F.lit("A"), most.cast("string"))))
        else:
            offers.append(F.when(room(place, 1), F.lit(letter)))
    return F.array_compact(F.array(*offers))


def legal_forms(classes: Column, lexicon: Lexicon) -> Column:
    """The surface forms of legal classes as ``legal_next`` gives them, sorted."""
    forms = {c: [f for f in lexicon.classes.get(c, ())] for c in CLASSES if c != "A"}
    forms |= {f"A{n}": [f * k + lexicon.closer for f in lexicon.classes.get("A", ()) for k in range(1, n + 1)] for n in range(1, lexicon.repetitions + 1)}
    known = F.create_map(*(x for c, own in forms.items() for x in (F.lit(c), F.array(*map(F.lit, own)) if own else F.array().cast("array<string>"))))
    return F.array_sort(F.flatten(F.transform(classes, lambda c: known[c])))


def accepted(tokens: Column, automaton: Automaton) -> Column:
    """Whether the walk over all tokens is legal and ends behind the force."""
    at = walk(tokens, automaton)
    return (at["state"] == automaton.done) & (at["read"] == F.size(tokens))


def permits(force: Column, forces: Column, modal: Column, modals: Column) -> Column:
    """Whether allow-lists let a force and a modal pass: a null list lets all pass, an empty one none; where there is no modal its list is not asked."""
    return (forces.isNull() | F.coalesce(F.array_contains(forces, force), F.lit(False))) & (modals.isNull() | modal.isNull() | F.coalesce(F.array_contains(modals, modal), F.lit(False)))
