"""The rule language as data: terms, literals, rules, programs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Union


@dataclass(frozen=True)
class Sym:
    """A symbol constant such as :red; a string column at execution."""

    name: str

    def __str__(self) -> str:
        return f":{self.name}"


Value = Union[int, float, str, bool, Sym, None]


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    value: Value

    def __str__(self) -> str:
        if isinstance(self.value, bool):
            return "true" if self.value else "false"
        if isinstance(self.value, str):
            escaped = self.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
            return f'"{escaped}"'
        return str(self.value)


@dataclass(frozen=True)
class Wildcard:
    """A bare underscore: matches anything, joins nothing."""

    def __str__(self) -> str:
        return "_"


@dataclass(frozen=True)
class Arith:
    op: str  # + - * / mod, or neg with a right side only
    left: Term
    right: Term

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


Term = Union[Var, Const, Wildcard, Arith]


@dataclass(frozen=True)
class Atom:
    pred: str
    args: tuple[Term, ...]

    def __str__(self) -> str:
        return f"{self.pred}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Positive:
    atom: Atom

    def __str__(self) -> str:
        return str(self.atom)


@dataclass(frozen=True)
class Negated:
    atom: Atom

    def __str__(self) -> str:
        return f"not {self.atom}"


@dataclass(frozen=True)
class Compare:
    op: str  # = != < <= > >=
    left: Term
    right: Term

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Aggregate:
    """result = fn<target>(atom), grouped by the atom's variables that are used elsewhere in the rule."""

    result: Var
    fn: str
    target: Var
    atom: Atom

    def __str__(self) -> str:
        return f"{self.result} = {self.fn}<{self.target}>({self.atom})"


Literal = Union[Positive, Negated, Compare, Aggregate]


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Literal, ...]

    def __str__(self) -> str:
        return f"{self.head} :- {', '.join(map(str, self.body))}."


@dataclass(frozen=True)
class Fact:
    pred: str
    values: tuple[Value, ...]
    weight: int = 1

    def __str__(self) -> str:
        return f"{self.pred}({', '.join(str(Const(v)) for v in self.values)})."


@dataclass(frozen=True)
class Program:
    facts: tuple[Fact, ...] = ()
    rules: tuple[Rule, ...] = ()
    queries: tuple[Atom, ...] = field(default=())

    @property
    def idb(self) -> set[str]:
        return {r.head.pred for r in self.rules}

    def __str__(self) -> str:
        return "\n".join([*map(str, self.facts), *map(str, self.rules), *(f":- {q}." for q in self.queries)])


def variables(x: object) -> Iterator[str]:
    """Names of the variables of a term, atom or literal, in order, with repetitions."""
    if isinstance(x, Var):
        yield x.name
    elif isinstance(x, Arith):
        yield from variables(x.left)
        yield from variables(x.right)
    elif isinstance(x, Atom):
        for a in x.args:
            yield from variables(a)
    elif isinstance(x, (Positive, Negated)):
        yield from variables(x.atom)
    elif isinstance(x, Compare):
        yield from variables(x.left)
        yield from variables(x.right)
    elif isinstance(x, Aggregate):
        yield x.result.name
        yield from variables(x.atom)


def atom_of(x: Literal) -> Atom | None:
    return None if isinstance(x, Compare) else x.atom
