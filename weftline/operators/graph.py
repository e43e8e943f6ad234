"""Property graphs as two DataFrames: vertices (id, labels, properties) and edges (id, src, dst, label, properties)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import semiring
from weftline.plans.ir import Atom, Const, Positive, Rule, Term, Var
from weftline.session import counted, joined_parts, scratch


class PropertyGraph:
    """Edges must have both ends among the vertices; `check` says so by an anti join."""

    def __init__(self, vertices: DataFrame, edges: DataFrame, *, check: bool = True) -> None:
        self.vertices, self.edges = vertices, edges
        if check:
            ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
            lost = ends.join(vertices.select("id"), "id", "left_anti").limit(1).collect()
            if lost:
                raise ValueError(f"an edge ends at {lost[0]['id']}, which is no vertex")

    def vertex(self, vid) -> DataFrame:
        return self.vertices.where(F.col("id") == vid)

    def with_label(self, label: str) -> DataFrame:
        return self.vertices.where(F.array_contains("labels", label))

    def out(self, vid, label: str | None = None) -> DataFrame:
        found = self.edges.where(F.col("src") == vid)
        return found if label is None else found.where(F.col("label") == label)

    def into(self, vid, label: str | None = None) -> DataFrame:
        found = self.edges.where(F.col("dst") == vid)
        return found if label is None else found.where(F.col("label") == label)

    def counts(self) -> tuple[int, int]:
        return self.vertices.count(), self.edges.count()

    def relation(self) -> DataFrame:
        return self.edges.select("src", "dst", "label")

    def weighted(self, name: str = "weight") -> DataFrame:
        """src, dst, w: the numeric property `name`, 1.0 where it is missing or no number."""
        return self.edges.select("src", "dst", F.coalesce(F.expr(f"try_cast(properties['{name}'] AS DOUBLE)"), F.lit(1.0)).alias("w"))


def shortest_paths(edges: DataFrame, source, *, max_rounds: int = 10_000) -> DataFrame:
    """id, dist from the source along edges (src, dst, w >= 0): rounds of relaxing the vertices that got nearer."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    if edges.where("w < 0").limit(1).count():
        raise ValueError("negative weights have no shortest paths here")
    best_edges = scratch(edges.groupBy("src", "dst").agg(F.min("w").alias("w")), "edges")
    dist = spark.range(1).select(F.lit(source).cast(kind).alias("id"), F.lit(0.0).alias("dist"))
    near = dist
    for _ in range(max_rounds):
        step = near.join(best_edges, near.id == best_edges.src).groupBy(F.col("dst").alias("to")).agg(F.min(F.col("dist") + F.col("w")).alias("d"))
        known = dist.select(F.col("id").alias("k"), F.col("dist").alias("old"))
        near, some = counted(step.join(known, F.col("to") == known.k, "left").where("old IS NULL OR d < old").select(F.col("to").alias("id"), F.col("d").alias("dist")), "nearer")
        if not some:
            return dist
        dist = scratch(dist.union(near).groupBy("id").agg(F.min("dist").alias("dist")), "dist")
    raise RuntimeError(f"distances did not settle in {max_rounds} rounds")


def k_hops(edges: DataFrame, source, k: int) -> DataFrame:
    """id: vertices at most k edges from the source, itself included."""
    kind = dict(edges.dtypes)["src"]
    edges = scratch(edges.select("src", "dst"), "edges") if k > 1 else edges.select("src", "dst")  # every hop reads them
    seen = near = scratch(edges.sparkSession.range(1).select(F.lit(source).cast(kind).alias("id")), "seen")
    parts = [seen]
    for _ in range(k):
        step = near.join(edges, near.id == F.col("src")).select(F.col("dst").alias("id")).distinct()
        near, some = counted(step.join(seen.select(F.col("id").alias("s")), F.col("id") == F.col("s"), "left_anti"), "hop")
        if not some:
            break
        parts.append(near)
        seen = joined_parts(parts)
    return seen


def all_pairs(edges: DataFrame, vertices: DataFrame | None = None, *, weighted: bool = False, max_rounds: int = 64) -> DataFrame:
    """src, dst, dist for all pairs that a path joins, and 0 for each vertex with itself; unreachable pairs have no row.

    Min-plus squaring: paths double in length each round. Hops count 1 each, or w if weighted.
    """
    w = F.col("w").cast("double") if weighted else F.lit(1.0)
    ids = vertices.select(F.col("id").alias("v")) if vertices is not None else edges.select(F.explode(F.array("src", "dst")).alias("v"))
    own = ids.distinct().select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0.0).alias("dist"))
    dist = scratch(own.union(edges.select("src", "dst", w.alias("dist"))).groupBy("src", "dst").agg(F.min("dist").alias("dist")), "pairs")
    for _ in range(max_rounds):
        b = dist.toDF("m", "end", "more")
        longer = dist.join(b, dist.dst == b.m).select("src", F.col("end").alias("dst"), (F.col("dist") + F.col("more")).alias("dist"))
        old = dist.toDF("s", "d", "was")
        new = longer.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
        nearer, some = counted(new.join(old, (new.src == old.s) & (new.dst == old.d), "left").where("was IS NULL OR dist < was").select("src", "dst", "dist"), "nearer")
        if not some:
            return dist
        dist = scratch(dist.union(nearer).groupBy("src", "dst").agg(F.min("dist").alias("dist")), "pairs")
    raise RuntimeError(f"distances did not settle in {max_rounds} rounds")


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """id, label: every vertex takes the most frequent label among its neighbours (edges count both ways, with repetitions), the smallest of ties.

    All vertices move at once; a vertex counts itself once, which keeps two-sided graphs from swapping labels for ever.
    Stops when nothing changes or after `rounds`.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src <> dst")
    links = scratch(both.groupBy("src", "dst").agg(F.count("*").alias("c")), "links")
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    labels = scratch(ids.select("id", F.col("id").alias("label")), "labels")
    for _ in range(rounds):
        votes = links.join(labels, links.dst == labels.id).select(F.col("src").alias("v"), "label", "c").union(labels.select("id", "label", F.lit(1).cast("bigint")))
        tally = votes.groupBy("v", "label").agg(F.sum("c").alias("c"))
        best = tally.groupBy("v").agg(F.min_by("label", F.struct(-F.col("c"), "label")).alias("label"))
        step = labels.withColumnRenamed("label", "was").join(best, F.col("id") == F.col("v")).select("id", "label", (F.col("label") != F.col("was")).alias("moved"))
        done = scratch(step, "labels")
        labels = done.select("id", "label")
        if done.where("moved").isEmpty():
            break
    return labels


def label_propagation_in_turn(edges: DataFrame, sweeps: int = 20, max_rounds: int = 10_000) -> DataFrame:
    """id, label: vertices take the most frequent label among their neighbours one after the other in ascending order of id, each seeing the labels that those before it have just taken; the smallest of ties.

    Edges count both ways, with repetitions, and a loop twice. A sweep's result is the one labelling in which every vertex
    agrees with the new labels of lower neighbours and the old ones of higher; it is reached by rounds in which all
    vertices move at once, as many as the longest chain of vertices that wait for each other. Stops when a sweep changes nothing.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
    links = scratch(both.groupBy("src", "dst").agg(F.count("*").alias("c")), "links")
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    labels = scratch(ids.select("id", F.col("id").alias("old"), F.col("id").alias("new")), "labels")
    for _ in range(sweeps):
        for _ in range(max_rounds):
            near = labels.select(F.col("id").alias("n"), "old", "new")
            votes = links.join(near, links.dst == near.n).select("src", F.when(F.col("dst") < F.col("src"), F.col("new")).otherwise(F.col("old")).alias("label"), "c")
            best = votes.groupBy("src", "label").agg(F.sum("c").alias("c")).groupBy("src").agg(F.min_by("label", F.struct(-F.col("c"), "label")).alias("label"))
            step = labels.join(best, labels.id == best.src).select("id", "old", F.col("label").alias("new"), (F.col("label") != F.col("new")).alias("moved"))
            done = scratch(step, "labels")
            labels = done.select("id", "old", "new")
            if done.where("moved").isEmpty():
                break
        else:
            raise RuntimeError(f"a sweep did not settle in {max_rounds} rounds")
        if labels.where("old <> new").isEmpty():
            break
        labels = scratch(labels.select("id", F.col("new").alias("old"), "new"), "labels")
    return labels.select("id", F.col("new").alias("label"))


def page_rank(edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """id, rank after a number of iterations; parallel edges count, and mass at vertices without out-edges is lost."""
    links = scratch(edges.groupBy("src", "dst").agg(F.count("*").alias("c")), "links")
    degree = links.groupBy("src").agg(F.sum("c").alias("deg"))
    shares = scratch(links.join(degree, "src").select("src", "dst", (F.col("c") / F.col("deg")).alias("share")), "shares")
    ids = scratch(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "ids")
    n = ids.count()
    ranks = ids.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(iterations):
        sent = shares.join(ranks, shares.src == ranks.id).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = ids.join(sent, ids.id == F.col("to"), "left").select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % 4 == 3:
            ranks = scratch(ranks, "ranks")
    return ranks


def cycle_nodes(closure: DataFrame) -> DataFrame:
    """Vertices that reach themselves, of a closure (c0, c1)."""
    return closure.where("c0 = c1").select(F.col("c0").alias("id"))


def path_rule(name: str, vertices: Sequence[tuple[str, str | None]], labels: Sequence[str | None]) -> Rule:
    """A rule for a path pattern: (variable, vertex label) in turn with edge labels; the head holds the two ends.

    Edges are atoms of the edge label's predicate (`edge` where none is given), vertex labels atoms of has_label.
    """
    if len(labels) != len(vertices) - 1 or len(vertices) < 2:
        raise ValueError("a path has one edge fewer than vertices")
    body: list[Positive] = []
    for (v, label), (w, _), e in zip(vertices, vertices[1:], labels, strict=False):
        if label:
            body.append(Positive(Atom("has_label", (Var(v), Const(label)))))
        body.append(Positive(Atom(e or "edge", (Var(v), Var(w)))))
    last, label = vertices[-1]
    if label:
        body.append(Positive(Atom("has_label", (Var(last), Const(label)))))
    ends: tuple[Term, ...] = (Var(vertices[0][0]), Var(last))
    return Rule(Atom(name, ends), tuple(body))


def path_pattern(graph: PropertyGraph, vertices: Sequence[tuple[str, str | None]], labels: Sequence[str | None]) -> DataFrame:
    """src, dst of the pattern's paths, as a set."""
    rule = path_rule("path", vertices, labels)
    out: DataFrame | None = None
    for i, lit in enumerate(x for x in rule.body if x.atom.pred != "has_label"):
        e = graph.edges if lit.atom.pred == "edge" else graph.edges.where(F.col("label") == lit.atom.pred)
        step = e.select(F.col("src").alias(f"v{i}"), F.col("dst").alias(f"v{i + 1}"))
        out = step if out is None else out.join(step, f"v{i}")
    for i, (_, label) in enumerate(vertices):
        if label:
            out = out.join(graph.with_label(label).select(F.col("id").alias(f"v{i}")).distinct(), f"v{i}", "left_semi")
    return out.select(F.col("v0").alias("src"), F.col(f"v{len(vertices) - 1}").alias("dst")).distinct()


def taint(transfers: DataFrame, source, *, max_hops: int = 5) -> DataFrame:
    """account, mono (map of names to powers), coeff: how money from `source` reaches accounts, over transfers (id, src, dst).

    Every derivation of at most max_hops transfers counts once; the polynomial of an account is the sum of its rows.
    """
    kind = dict(transfers.dtypes)["src"]
    start = transfers.sparkSession.range(1).select(F.lit(source).cast(kind).alias("account"), semiring.monomial(F.lit("source_" + str(source))).alias("mono"), F.lit(1).cast("bigint").alias("coeff"))
    step = transfers.select(F.col("id").alias("tx"), "src", "dst")
    if max_hops > 1:  # every hop reads them; they are worked out once
        step = scratch(step, "transfers")
    total, near = start, start
    for _ in range(max_hops):
        moved = near.join(step, near.account == step.src).select(F.col("dst").alias("account"), semiring.monomial_times(F.col("mono"), semiring.monomial(F.col("tx"))).alias("mono"), "coeff")
        near, some = counted(summed(moved), "taint")
        if not some:
            break
        total = total.union(near)
    return summed(total)


def summed(derivations: DataFrame) -> DataFrame:
    """Equal monomials of an account made one, coefficients added."""
    text = semiring.monomial_text(F.col("mono"))
    return derivations.withColumn("__m", text).groupBy("account", "__m").agg(F.first("mono").alias("mono"), F.sum("coeff").alias("coeff")).drop("__m")


def sensitivity(polynomials: DataFrame, name: str, values: dict[str, float]) -> DataFrame:
    """account, d: the partial derivative of each account's polynomial by a variable, at values (1.0 where none is given)."""
    at = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]) if values else F.create_map().cast("map<string,double>")
    power = F.coalesce(F.element_at("mono", name), F.lit(0))
    rest: Column = F.aggregate(F.map_entries("mono"), F.lit(1.0), lambda acc, e: acc * F.pow(F.coalesce(F.element_at(at, e["key"]), F.lit(1.0)), e["value"] - F.when(e["key"] == name, 1).otherwise(0)))
    return polynomials.groupBy("account").agg(F.sum(F.col("coeff") * power * rest).alias("d"))
