"""Graph queries: patterns over entities, entity classes and variables, and the vocabulary that gives relations their meaning."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import product

ANY = "associated"


@dataclass(frozen=True)
class Entity:
    id: str
    type: str
    cls: str | None = None


@dataclass(frozen=True)
class Var:
    name: str
    type: str | None = None


@dataclass(frozen=True)
class Pattern:
    """Several entities on a side mean any of them; a side may be one variable instead."""

    subjects: tuple
    relation: str
    objects: tuple

    def variables(self) -> list[Var]:
        return list(dict.fromkeys(e for e in (*self.subjects, *self.objects) if isinstance(e, Var)))

    def flipped(self) -> Pattern:
        return Pattern(self.objects, self.relation, self.subjects)


@dataclass(frozen=True)
class Query:
    """Patterns, sets of entities and terms, all of which must hold; of a set of entities any."""

    patterns: tuple = ()
    entity_sets: tuple = ()
    terms: tuple = ()

    def variables(self) -> list[str]:
        """Names in order of first appearance."""
        return list(dict.fromkeys(v.name for p in self.patterns for v in p.variables()))

    def key(self) -> str:
        """The same for the same query: sides and patterns sorted, types included."""
        side = lambda es: "|".join(sorted(f"?{e.name}({e.type})" if isinstance(e, Var) else f"{e.type}:{e.id}" for e in es))
        parts = sorted(f"{side(p.subjects)} {p.relation} {side(p.objects)}" for p in self.patterns)
        return "; ".join([*parts, *sorted(side(s) for s in self.entity_sets), *sorted(self.terms)])

    def bound(self, chosen: dict[str, Entity]) -> Query:
        """Variables replaced by chosen entities."""
        fill = lambda es: tuple(chosen.get(e.name, e) if isinstance(e, Var) else e for e in es)
        return replace(self, patterns=tuple(Pattern(fill(p.subjects), p.relation, fill(p.objects)) for p in self.patterns))


@dataclass(frozen=True)
class Vocabulary:
    """Relations: expansion to narrower ones, symmetry, allowed subject and object types, weights; and wider types of a type."""

    expansion: dict = field(default_factory=lambda: {"interacts": ["interacts", "metabolises", "inhibits"], "decreases": ["decreases", "inhibits"]})
    symmetric: frozenset = frozenset({ANY, "interacts", "induces", "decreases"})
    typing: dict = field(default_factory=dict)
    type_expansion: dict = field(default_factory=dict)
    weights: dict = field(default_factory=dict)

    def relations(self, relation: str) -> list[str] | None:
        """Relations that a pattern's relation stands for; None for any."""
        return None if relation == ANY else list(self.expansion.get(relation, [relation]))

    def mirrored(self, relation: str) -> bool:
        return relation == ANY or (relation in self.symmetric and relation in self.expansion)

    def types(self, type: str) -> list[str]:
        return [type, *self.type_expansion.get(type, [])]

    def allows(self, side: int, relation: str, e) -> bool:
        allowed = self.typing.get(relation, (None, None))[side]
        return allowed is None or e.type is None or e.type in allowed


def _allowed(p: Pattern, v: Vocabulary) -> Pattern | None:
    s = tuple(e for e in p.subjects if v.allows(0, p.relation, e))
    o = tuple(e for e in p.objects if v.allows(1, p.relation, e))
    return Pattern(s, p.relation, o) if s and o else None


def rewrite(query: Query, vocabulary: Vocabulary, any_of: bool = False) -> Query | None:
    """Duplicate endpoints and patterns go, patterns are typed (flipped if only the other way round is allowed), a symmetric pattern of two
    constants in the wrong order can't match, and patterns with fewer variables come first. None: nothing can match. With any_of an
    impossible pattern is left out instead.
    """
    kept: list[Pattern] = []
    for p in query.patterns:
        p = Pattern(tuple(dict.fromkeys(p.subjects)), p.relation, tuple(dict.fromkeys(p.objects)))
        fits = _allowed(p, vocabulary) or _allowed(p.flipped(), vocabulary)
        if fits and fits.relation != ANY and fits.relation in vocabulary.symmetric and not vocabulary.mirrored(fits.relation):
            (s, *more), (o, *others) = fits.subjects, fits.objects
            if not more and not others and isinstance(s, Entity) and isinstance(o, Entity) and s.id > o.id:
                fits = None
        if fits is None:
            if any_of:
                continue
            return None
        if fits not in kept:
            kept.append(fits)
    if query.patterns and not kept:
        return None
    return replace(query, patterns=tuple(sorted(kept, key=lambda p: len(p.variables()))))


def alternatives(query: Query) -> list[Query]:
    """The query for each choice of single entities on sides that hold several."""
    sides = [[(s, o) for s in p.subjects for o in p.objects] for p in query.patterns]
    return [replace(query, patterns=tuple(Pattern((s,), p.relation, (o,)) for p, (s, o) in zip(query.patterns, choice))) for choice in product(*sides)]
