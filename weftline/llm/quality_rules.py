"""Quality rules: text statistics in built-in functions and a learned decision list.

The list is grown by sequential covering over labelled statistics: each rule starts empty, takes the threshold condition
with the largest information gain until it covers no good row of the growing set, is pruned from its end against rows
held out from growing, and then its rows are taken away before the next rule is grown. What comes out is an ordered
Spark expression; scoring runs no Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import let, scratch

SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: What conditions may ask about, as expressions over the statistics.
FEATURES: dict[str, str] = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "exclaim_share": "n_exclaim / greatest(n_words, 1)",
    "line_length": "n_words / greatest(n_lines, 1)",
}


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of five words that the text holds twice or more."""
    def of_windows(w: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            at = F.sort_array(F.transform(twice, lambda i: F.get(s, i)["i"]))
            step = lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(acc["to"], p)).cast("long").alias("n"), (p + WINDOW).cast("int").alias("to"))
            return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("to")), step, lambda acc: acc["n"])

        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(ordered, of_sorted))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))
        return F.when(F.size(h) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def statistics(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, the columns in `also` and the counts of its whole text; null texts count as having no words. One row for each row."""
    t = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SEPARATORS, "")) > 0)
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    upper = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))
    return docs.select(
        "doc_id",
        *also,
        counted.alias("w"),
        lined.alias("l"),
        F.length(F.translate(t, SEPARATORS, "")).cast("long").alias("word_chars"),
        _without(t, SYMBOLS).cast("long").alias("n_symbols"),
        upper.cast("long").alias("n_upper"),
        _without(t, "0123456789").cast("long").alias("n_digits"),
        _without(t, "!").cast("long").alias("n_exclaim"),
    ).select("doc_id", *also, "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper", "n_digits", "n_exclaim")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    at: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x > self.at if self.above else x <= self.at

    def holds(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v > self.at if self.above else v <= self.at

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.at:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rejecting conjunctions in order; a row that none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rule_number(self) -> Column:
        """1-based number of the first rule that covers the row, else null."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            held = F.lit(True)
            for c in self.rules[k - 1]:
                held &= c.column()
            out = F.when(held, F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + "\nelse keep"


def _grow(x: np.ndarray, bad: np.ndarray, names: Sequence[str], grid: list[np.ndarray], longest: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < longest and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        best, gain = None, 1e-9
        for f, name in enumerate(names):
            where = np.searchsorted(grid[f], x[inside, f], "left")  # v <= grid[i] exactly if where <= i
            p = np.bincount(where[bad[inside]], minlength=len(grid[f]) + 1).cumsum()
            n = np.bincount(where[~bad[inside]], minlength=len(grid[f]) + 1).cumsum()
            for above in (True, False):
                pp, nn = (p0 - p[:-1], n0 - n[:-1]) if above else (p[:-1], n[:-1])
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(pp > 0, pp * (np.log2(pp / np.maximum(pp + nn, 1)) - math.log2(p0 / (p0 + n0))), -1)
                i = int(score.argmax()) if len(score) else 0
                if len(score) and score[i] > gain:
                    best, gain = Condition(name, above, float(grid[f][i])), float(score[i])
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x, names)
    return rule


def fit(x: np.ndarray, bad: np.ndarray, held_out: np.ndarray, *, names: Sequence[str], longest: int = 4, most: int = 12, precision: float = 0.9, thresholds: int = 64) -> DecisionList:
    """Sequential covering: x has a column for each of names, bad marks the rows to reject, held_out those used for pruning alone."""
    grid = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, thresholds), method="nearest")) if len(x) else np.zeros(0) for f in range(len(names))]
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(x), bool)
    for _ in range(most):
        g, h = left & ~held_out, left & held_out
        if not bad[g].any():
            break
        rule = _grow(x[g], bad[g], names, grid, longest)
        best, worth = None, -math.inf
        for k in range(len(rule), 0, -1):
            inside = np.ones(int(h.sum()), bool)
            for c in rule[:k]:
                inside &= c.holds(x[h], names)
            p, n = int((inside & bad[h]).sum()), int((inside & ~bad[h]).sum())
            if p and p >= precision * (p + n) and p - n > worth:
                best, worth = rule[:k], p - n
        if best is not None:
            rules.append(tuple(best))
        covered = np.ones(len(x), bool)
        for c in best or rule:
            covered &= c.holds(x, names)
        if not (covered & g).any():
            break
        left &= ~covered  # a rule that fails the held-out rows is dropped, and its rows are not tried again
    return DecisionList(tuple(rules))


def learn(stats: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, **how) -> DecisionList:
    """Fits on at most `max_labelled` labelled rows (those with the smallest hash of doc_id), a third held out for pruning.

    Rows that fail the base rules are settled already and take no part. Labels other than 0 and 1 are left out; without labels the list is empty and keeps all.
    """
    names = list(FEATURES)
    labelled = stats.where(~base_failed()).join(labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("__l"), F.col("quality").alias("__q")), F.col("doc_id") == F.col("__l"))
    few = labelled.select(F.xxhash64("doc_id").alias("__h"), "__q", *[F.expr(e).alias(n) for n, e in FEATURES.items()]).orderBy("__h", "__q").limit(max_labelled)
    rows = few.agg(F.sort_array(F.collect_list(F.struct("__h", "__q", *names))).alias("rows")).first()["rows"]  # picked on the executors, sent once
    x = np.array([[float(r[n]) for n in names] for r in rows]).reshape(len(rows), len(names))
    return fit(x, np.array([r["__q"] == 0 for r in rows], bool), np.array([r["__h"] % 3 == 0 for r in rows], bool), names=names, **how)


def judged(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The statistics of every row of `docs` (doc_id, text) with base_failed, rule (number of the first rejecting rule, or null) and kept.

    Null texts have no words and fail the base. Null doc_ids are judged like others and never labelled. Repeated rows are
    judged alike, an empty table gives an empty result, and columns of the same names in `docs` are not looked at.
    """
    stats = scratch(statistics(docs.select("doc_id", "text")), "quality")
    rules = learn(stats, labels, **how)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.rule_number())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def passing(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that pass the base rules and the learned list, with all their columns; see `judged`."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(c).alias(n) for c, n in zip(docs.columns, own, strict=True)]).alias("__row"))
    stats = scratch(statistics(held, "__row"), "quality")
    rules = learn(stats, labels, **how)
    return stats.where(~base_failed() & rules.rule_number().isNull()).select(*[F.col(f"__row.{n}").alias(c) for c, n in zip(docs.columns, own, strict=True)])
