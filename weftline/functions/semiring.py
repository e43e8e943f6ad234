"""Semirings as pairs of Spark expressions: an aggregate for plus, a column expression for times."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """plus and times on plain values, and the same on columns (plus_agg sums a group's weights). negate makes it a ring."""

    name: str
    type: str
    zero: object
    one: object
    plus: Callable
    times: Callable
    plus_agg: Callable[[Column], Column]
    times_col: Callable[[Column, Column], Column]
    negate: Callable[[Column], Column] | None = None
    idempotent: bool = False

    def zero_col(self) -> Column:
        return F.lit(self.zero).cast(self.type)

    def one_col(self) -> Column:
        return F.lit(self.one).cast(self.type)

    def minus(self, a, b):
        if self.negate is None:
            raise ValueError(f"{self.name} has no negatives")
        return self.plus(a, -b)

    def leq(self, a, b) -> bool:
        """The order of an idempotent semiring: a plus b equals b."""
        if not self.idempotent:
            raise ValueError(f"{self.name} is not idempotent")
        return self.plus(a, b) == b


def _unit(x: float) -> float:
    return min(1.0, max(0.0, x))


COUNTING = Semiring("counting", "bigint", 0, 1, lambda a, b: a + b, lambda a, b: a * b, F.sum, lambda a, b: a * b, lambda c: -c)
TROPICAL = Semiring("tropical", "double", math.inf, 0.0, min, lambda a, b: a + b, F.min, lambda a, b: a + b, idempotent=True)
BOOLEAN = Semiring("boolean", "boolean", False, True, lambda a, b: a or b, lambda a, b: a and b, F.bool_or, lambda a, b: a & b, idempotent=True)
FUZZY = Semiring("fuzzy", "double", 0.0, 1.0, max, min, F.max, lambda a, b: F.least(a, b), idempotent=True)
#: Not a semiring in the strict sense: times does not distribute over plus.
PROBABILISTIC = Semiring("probabilistic", "double", 0.0, 1.0, lambda a, b: _unit(a + b - a * b), lambda a, b: _unit(a * b), lambda c: F.lit(1.0) - F.product(F.lit(1.0) - c), lambda a, b: a * b)
#: Levels 0 public, 1 internal, 2 confidential, 3 secret; secret is zero, so a row weighted secret counts as absent.
ACCESS = Semiring("access", "int", 3, 0, min, max, F.min, lambda a, b: F.greatest(a, b), idempotent=True)
ACCESS_LEVELS = ("public", "internal", "confidential", "secret")
SEMIRINGS = {s.name: s for s in (COUNTING, TROPICAL, BOOLEAN, FUZZY, PROBABILISTIC, ACCESS)}


def fuzzy(x: float) -> float:
    if not 0.0 <= x <= 1.0:
        raise ValueError(f"{x} is outside [0, 1]")
    return x


def broken_laws(ring: Semiring, samples: Iterable) -> list[str]:
    """The semiring laws that some samples violate, by name."""
    samples = list(samples)
    same = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))
    p, t, z, one = ring.plus, ring.times, ring.zero, ring.one
    laws = {
        "plus is commutative": lambda a, b, c: same(p(a, b), p(b, a)),
        "plus is associative": lambda a, b, c: same(p(p(a, b), c), p(a, p(b, c))),
        "zero is neutral": lambda a, b, c: same(p(a, z), a),
        "times is associative": lambda a, b, c: same(t(t(a, b), c), t(a, t(b, c))),
        "one is neutral": lambda a, b, c: same(t(a, one), a) and same(t(one, a), a),
        "zero absorbs": lambda a, b, c: same(t(a, z), z) and same(t(z, a), z),
        "times distributes": lambda a, b, c: same(t(a, p(b, c)), p(t(a, b), t(a, c))),
    }
    return [name for name, law in laws.items() if not all(law(*abc) for abc in product(samples, repeat=3))]


Monomial = tuple[tuple[str, int], ...]


@dataclass(frozen=True)
class Polynomial:
    """Provenance: whole coefficients of monomials over row names."""

    terms: tuple[tuple[Monomial, int], ...] = ()

    @staticmethod
    def of(terms: dict[Monomial, int]) -> Polynomial:
        return Polynomial(tuple(sorted((m, c) for m, c in terms.items() if c)))

    @staticmethod
    def variable(name: str) -> Polynomial:
        return Polynomial(((((name, 1),), 1),))

    @staticmethod
    def constant(n: int) -> Polynomial:
        return Polynomial.of({(): n})

    def __add__(self, other: Polynomial) -> Polynomial:
        out = dict(self.terms)
        for m, c in other.terms:
            out[m] = out.get(m, 0) + c
        return Polynomial.of(out)

    def __mul__(self, other: Polynomial) -> Polynomial:
        out: dict[Monomial, int] = {}
        for m, c in self.terms:
            for n, d in other.terms:
                powers = dict(m)
                for v, e in n:
                    powers[v] = powers.get(v, 0) + e
                key = tuple(sorted(powers.items()))
                out[key] = out.get(key, 0) + c * d
        return Polynomial.of(out)

    def variables(self) -> set[str]:
        return {v for m, _ in self.terms for v, _ in m}

    def evaluate(self, values: dict[str, float], default: float = 0.0) -> float:
        return sum(c * math.prod(values.get(v, default) ** e for v, e in m) for m, c in self.terms)

    def holds(self, active: set[str]) -> bool:
        """Whether some monomial has all of its variables active."""
        return any(all(v in active for v, _ in m) for m, _ in self.terms)

    def witnesses(self) -> set[frozenset[str]]:
        """The variable sets of monomials that hold no other one's."""
        sets = {frozenset(v for v, _ in m) for m, _ in self.terms}
        return {s for s in sets if not any(o < s for o in sets)}

    def derivative(self, name: str) -> Polynomial:
        out: dict[Monomial, int] = {}
        for m, c in self.terms:
            powers = dict(m)
            e = powers.get(name, 0)
            if e:
                powers[name] = e - 1
                key = tuple(sorted((v, k) for v, k in powers.items() if k))
                out[key] = out.get(key, 0) + c * e
        return Polynomial.of(out)

    def __str__(self) -> str:
        def one(m: Monomial, c: int) -> str:
            body = "*".join(v if e == 1 else f"{v}^{e}" for v, e in m)
            return str(c) if not body else body if c == 1 else f"{c}*{body}"

        return " + ".join(one(m, c) for m, c in self.terms) or "0"


# Provenance on columns: a relation in long form has columns mono map<string,int> and coeff bigint for each derivation.


def monomial(name: Column) -> Column:
    return F.create_map(name.cast("string"), F.lit(1))


def monomial_times(a: Column, b: Column) -> Column:
    """The product of two monomials: powers add."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def monomial_text(m: Column) -> Column:
    """One text for equal monomials, as a^2*b."""
    parts = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.when(e["value"] == 1, e["key"]).otherwise(F.concat_ws("^", e["key"], e["value"].cast("string"))))
    return F.array_join(parts, "*")


def monomial_holds(m: Column, active: Column) -> Column:
    return F.forall(F.map_keys(m), lambda v: F.array_contains(active, v))


def monomial_value(m: Column, values: Column) -> Column:
    """Product of values (a map of doubles) to the powers; variables without a value count as 0."""
    return F.aggregate(F.map_entries(m), F.lit(1.0), lambda acc, e: acc * F.pow(F.coalesce(F.element_at(values, e["key"]), F.lit(0.0)), e["value"]))
