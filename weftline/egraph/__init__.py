"""Equality saturation for scalar expressions: one graph holds all forms that the rules reach, and the cheapest is read off."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Expr:
    """A variable (op "var"), a constant (op "const", any hashable value), or an operator over expressions."""

    op: str
    args: tuple[Expr, ...] = ()
    value: object = None

    def __str__(self) -> str:
        if self.op in ("var", "const"):
            return str(self.value)
        if len(self.args) == 2 and not self.op.isalpha():
            return f"({self.args[0]} {self.op} {self.args[1]})"
        return f"{self.op}({', '.join(map(str, self.args))})"

    def size(self) -> int:
        return 1 + sum(a.size() for a in self.args)

    def names(self) -> set[str]:
        return {str(self.value)} if self.op == "var" else {n for a in self.args for n in a.names()}


def var(name: str) -> Expr:
    return Expr("var", value=name)


def const(value: object) -> Expr:
    return Expr("const", value=value)


_TOKENS = re.compile(r"\s*(?:(\d+)|(\?[A-Za-z_]\w*)|([A-Za-z_]\w*)|(<<|[-+*/%(),]))")


def parse(text: str) -> Expr:
    """Infix text: + - * / % <<, unary minus, calls; ?x is a pattern variable; true and false are constants."""
    toks, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"unexpected character at {at}: {text!r}")
        toks.append(m.group().strip())
        at = m.end()
    toks.append("")
    pos = 0

    def take() -> str:
        nonlocal pos
        pos += 1
        return toks[pos - 1]

    def level(ops: tuple[str, ...], below: Callable[[], Expr]) -> Expr:
        left = below()
        while toks[pos] in ops:
            op = take()
            left = Expr("shl" if op == "<<" else op, (left, below()))
        return left

    def atom() -> Expr:
        t = take()
        if t == "(":
            e = shift()
            if take() != ")":
                raise ValueError("missing )")
            return e
        if t == "-":
            e = atom()
            return const(-e.value) if e.op == "const" and isinstance(e.value, int) else Expr("neg", (e,))
        if t.isdigit():
            return const(int(t))
        if t in ("true", "false"):
            return const(t == "true")
        if not t or not (t[0].isalpha() or t[0] in "?_"):
            raise ValueError(f"expected a value, found {t or 'the end'!r}")
        if toks[pos] == "(":
            take()
            args = [shift()]
            while toks[pos] == ",":
                take()
                args.append(shift())
            if take() != ")":
                raise ValueError("missing )")
            return Expr(t, tuple(args))
        return var(t)

    def shift() -> Expr:
        return level(("<<",), lambda: level(("+", "-"), lambda: level(("*", "/", "%"), atom)))

    out = shift()
    if toks[pos]:
        raise ValueError(f"unexpected {toks[pos]!r}")
    return out


class UnionFind:
    def __init__(self) -> None:
        self.parent: list[int] = []
        self.weight: list[int] = []

    def make(self) -> int:
        self.parent.append(len(self.parent))
        self.weight.append(1)
        return len(self.parent) - 1

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.weight[a] < self.weight[b]:
                a, b = b, a
            self.parent[b] = a
            self.weight[a] += self.weight[b]
        return a


@dataclass(frozen=True)
class Node:
    op: str
    value: object
    args: tuple[int, ...]

    @property
    def key(self) -> tuple:
        return (self.op, type(self.value).__name__, self.value, self.args)


class EGraph:
    """Classes of equal nodes. merge() may leave congruent nodes apart until rebuild()."""

    def __init__(self) -> None:
        self.sets = UnionFind()
        self.table: dict[tuple, int] = {}
        self.classes: dict[int, dict[tuple, Node]] = {}
        self.dirty = False

    def find(self, c: int) -> int:
        return self.sets.find(c)

    def add_node(self, op: str, value: object, args: tuple[int, ...]) -> int:
        node = Node(op, value, tuple(map(self.find, args)))
        if node.key in self.table:
            return self.find(self.table[node.key])
        c = self.sets.make()
        self.table[node.key] = c
        self.classes[c] = {node.key: node}
        return c

    def add(self, e: Expr) -> int:
        return self.add_node(e.op, e.value, tuple(self.add(a) for a in e.args))

    def lookup(self, e: Expr) -> int | None:
        """The class of an expression if it is in the graph already."""
        args = [self.lookup(a) for a in e.args]
        if None in args:
            return None
        found = self.table.get(Node(e.op, e.value, tuple(map(self.find, args))).key)
        return None if found is None else self.find(found)

    def merge(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        keep = self.sets.union(a, b)
        gone = b if keep == a else a
        self.classes[keep].update(self.classes.pop(gone))
        self.dirty = True
        return True

    def rebuild(self) -> None:
        """Nodes over merged classes become one, until no two classes hold the same node."""
        while self.dirty:
            self.dirty = False
            table: dict[tuple, int] = {}
            pending = []
            for c, nodes in self.classes.items():
                fresh: dict[tuple, Node] = {}
                for n in nodes.values():
                    m = Node(n.op, n.value, tuple(map(self.find, n.args)))
                    fresh[m.key] = m
                    if m.key in table and table[m.key] != c:
                        pending.append((table[m.key], c))
                    table.setdefault(m.key, c)
                self.classes[c] = fresh
            self.table = table
            for a, b in pending:
                self.merge(a, b)

    def size(self) -> int:
        return sum(len(n) for n in self.classes.values())

    def matches(self, pattern: Expr) -> Iterator[tuple[int, dict[str, int]]]:
        """(class, classes of the pattern variables) wherever the pattern stands."""
        for c in list(self.classes):
            for env in self._match(pattern, c, {}):
                yield c, env

    def _match(self, p: Expr, c: int, env: dict[str, int]) -> Iterator[dict[str, int]]:
        c = self.find(c)
        if p.op == "var" and str(p.value).startswith("?"):
            have = env.get(p.value)
            if have is None:
                yield {**env, p.value: c}
            elif self.find(have) == c:
                yield env
            return
        for n in list(self.classes[c].values()):
            if n.op == p.op and n.value == p.value and type(n.value) is type(p.value) and len(n.args) == len(p.args):
                found = [env]
                for sub, arg in zip(p.args, n.args, strict=True):
                    found = [more for e in found for more in self._match(sub, arg, e)]
                yield from found

    def instantiate(self, p: Expr, env: dict[str, int]) -> int:
        if p.op == "var" and p.value in env:
            return self.find(env[p.value])
        return self.add_node(p.op, p.value, tuple(self.instantiate(a, env) for a in p.args))


@dataclass(frozen=True)
class Rewrite:
    name: str
    left: Expr
    right: Expr
    condition: Callable[[EGraph, dict[str, int]], bool] | None = None

    @staticmethod
    def of(name: str, left: str, right: str, condition: Callable | None = None) -> Rewrite:
        return Rewrite(name, parse(left), parse(right), condition)


def both_ways(name: str, left: str, right: str) -> list[Rewrite]:
    return [Rewrite.of(name, left, right), Rewrite.of(f"{name}, back", right, left)]


def _rules(*lines: str) -> list[Rewrite]:
    return [Rewrite.of(line.strip(), *map(str.strip, line.split("=>"))) for line in lines]


#: The laws of a ring: order and grouping, neutral and absorbing elements, differences; distribution comes last, as it alone makes terms grow.
ARITHMETIC = _rules("?a + ?b => ?b + ?a", "?a * ?b => ?b * ?a", "(?a + ?b) + ?c => ?a + (?b + ?c)", "(?a * ?b) * ?c => ?a * (?b * ?c)", "?a + 0 => ?a", "?a * 1 => ?a", "?a * 0 => 0", "?a - ?a => 0", "?a - 0 => ?a", "?a * (?b + ?c) => ?a * ?b + ?a * ?c")
BOOLEAN = _rules("not(not(?a)) => ?a", "and(?a, true) => ?a", "and(true, ?a) => ?a", "and(?a, false) => false", "or(?a, false) => ?a", "or(false, ?a) => ?a", "or(?a, true) => true", "and(?a, ?a) => ?a", "or(?a, ?a) => ?a", "not(and(?a, ?b)) => or(not(?a), not(?b))", "not(or(?a, ?b)) => and(not(?a), not(?b))", "not(true) => false", "not(false) => true")
STRENGTH = _rules("?a * 2 => ?a << 1", "?a * 4 => ?a << 2", "?a * 8 => ?a << 3")


@dataclass
class Report:
    iterations: int = 0
    nodes: int = 0
    classes: int = 0
    saturated: bool = False
    truncated: bool = False
    applied: dict[str, int] = field(default_factory=dict)


def saturate(graph: EGraph, rules: list[Rewrite], *, iterations: int = 15, nodes: int = 10_000, matches: int = 200, fold: bool = True) -> Report:
    """Searches all rules, then applies all matches, until nothing changes or a limit is met.

    A rule's matches beyond the limit are left to later rounds, and the report is then marked truncated: only a round
    that looked at every match counts as saturated. fold works out constant arithmetic as it appears.
    """
    out = Report()
    for _ in range(iterations):
        out.iterations += 1
        changed, cut, todo = False, False, []
        for rule in rules:
            found = 0
            for c, env in graph.matches(rule.left):
                if rule.condition is not None and not rule.condition(graph, env):
                    continue
                if (known := _known(graph, rule.right, env)) is not None and graph.find(known) == graph.find(c):
                    continue  # nothing new
                if found == matches:
                    cut = True
                    break
                found += 1
                todo.append((rule, c, env))
        for rule, c, env in todo:
            if graph.merge(c, graph.instantiate(rule.right, env)):
                out.applied[rule.name] = out.applied.get(rule.name, 0) + 1
                changed = True
            if graph.size() > nodes:
                cut = True
                break
        graph.rebuild()
        if fold:
            changed |= _fold(graph)
        out.truncated = cut
        if graph.size() > nodes:
            break
        if not changed and not cut:
            out.saturated = True
            break
    out.nodes, out.classes = graph.size(), len(graph.classes)
    return out


def _known(graph: EGraph, p: Expr, env: dict[str, int]) -> int | None:
    if p.op == "var" and p.value in env:
        return graph.find(env[p.value])
    args = []
    for a in p.args:
        c = _known(graph, a, env)
        if c is None:
            return None
        args.append(c)
    found = graph.table.get(Node(p.op, p.value, tuple(args)).key)
    return None if found is None else graph.find(found)


def _fold(graph: EGraph) -> bool:
    known = {c: n.value for c, nodes in graph.classes.items() for n in nodes.values() if n.op == "const" and isinstance(n.value, int) and not isinstance(n.value, bool)}
    todo = []
    for c, nodes in graph.classes.items():
        if c in known:
            continue
        for n in nodes.values():
            if n.args and all(graph.find(a) in known for a in n.args) and n.op in ("+", "-", "*", "shl", "neg"):
                todo.append((c, calculate(n.op, [known[graph.find(a)] for a in n.args])))
                break
    changed = False
    for c, v in todo:
        changed |= graph.merge(c, graph.add_node("const", v, ()))
    graph.rebuild()
    return changed


def calculate(op: str, args: list) -> object:
    """The value of an operator; whole numbers divide towards zero, and division by zero gives 0."""
    a, b = args[0], args[1] if len(args) > 1 else None
    if op in ("/", "%"):
        if b == 0:
            return 0
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return q if op == "/" else a - q * b
    table: dict[str, Callable[[], object]] = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "shl": lambda: a << b if b >= 0 else a >> -b, "neg": lambda: -a, "and": lambda: bool(a) and bool(b), "or": lambda: bool(a) or bool(b), "not": lambda: not a}
    if op not in table:
        raise ValueError(f"operator {op} has no value")
    return table[op]()


def ast_size(op: str) -> float:
    return 1.0


def latency(op: str) -> float:
    """Rough machine costs."""
    return {"/": 25.0, "%": 25.0, "*": 3.0, "+": 1.0, "-": 1.0}.get(op, 0.1)


def extract(graph: EGraph, root: int, cost: Callable[[str], float] = ast_size) -> tuple[Expr, float]:
    """The cheapest expression of a class; ties go to the first node in a fixed order."""
    best: dict[int, tuple[float, Node]] = {}
    changed = True
    while changed:
        changed = False
        for c, nodes in graph.classes.items():
            for n in sorted(nodes.values(), key=lambda n: (len(n.args), n.op, str(n.value), n.args)):
                args = [graph.find(a) for a in n.args]
                if all(a in best for a in args):
                    total = cost(n.op) + sum(best[a][0] for a in args)
                    if c not in best or total < best[c][0] - 1e-12:
                        best[c] = (total, n)
                        changed = True

    def build(c: int) -> Expr:
        n = best[graph.find(c)][1]
        return Expr(n.op, tuple(build(a) for a in n.args), n.value)

    return build(root), best[graph.find(root)][0]


def simplify(e: Expr, rules: list[Rewrite] = ARITHMETIC, cost: Callable[[str], float] = ast_size, **limits: int) -> Expr:
    g = EGraph()
    root = g.add(e)
    saturate(g, rules, **limits)
    return extract(g, root, cost)[0]


def reduce_strength(e: Expr) -> Expr:
    return simplify(e, ARITHMETIC + STRENGTH, latency)


@dataclass(frozen=True)
class Proof:
    left: Expr
    right: Expr
    meeting: Expr

    def markdown(self) -> str:
        return f"# Proof: `{self.left}` = `{self.right}`\n\n1. `{self.left}` is equal to `{self.meeting}` by the rules.\n2. `{self.right}` is equal to `{self.meeting}` by the rules.\n"


def prove(left: Expr, right: Expr, rules: list[Rewrite] = ARITHMETIC, **limits: int) -> Proof | None:
    """A proof that both sides reach one class, through its cheapest form; None if the search ends without one."""
    g = EGraph()
    a, b = g.add(left), g.add(right)
    saturate(g, rules, **limits)
    return Proof(left, right, extract(g, a)[0]) if g.find(a) == g.find(b) else None


def evaluate(e: Expr, values: dict[str, object]) -> object:
    if e.op == "const":
        return e.value
    return values[str(e.value)] if e.op == "var" else calculate(e.op, [evaluate(a, values) for a in e.args])


def mermaid(graph: EGraph) -> str:
    out = ["graph TD"]
    for c, nodes in sorted(graph.classes.items()):
        out.append(f"  subgraph class{c}")
        out += [f'    n{c}_{i}["{n.op if n.value is None else n.value}"]' for i, n in enumerate(nodes.values())]
        out.append("  end")
        out += [f"  n{c}_{i} --> class{graph.find(a)}" for i, n in enumerate(nodes.values()) for a in n.args]
    return "\n".join(out)
