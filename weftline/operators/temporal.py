"""Windows, sessions, interval joins, sequences and temporal logic over rows with a whole-number or timestamp time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(t: Column, size: int) -> Column:
    """[start, end) of the window that holds t; windows are anchored at 0, also before it."""
    start = t - F.pmod(t, F.lit(size))
    return F.struct(start.cast("bigint").alias("start"), (start + size).cast("bigint").alias("end"))


def sliding(t: Column, size: int, slide: int, *, from_zero: bool = False) -> Column:
    """All windows [k*slide, k*slide + size) that hold t, earliest first; from_zero leaves out those that start before 0."""
    last = t - F.pmod(t, F.lit(slide))
    first = last - F.floor((F.lit(size - 1) - F.pmod(t, F.lit(slide))) / slide).cast("bigint") * slide
    starts = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(slide).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    if from_zero:
        starts = F.filter(starts, lambda s: s >= 0)
    return F.transform(starts, lambda s: F.struct(s.alias("start"), (s + size).alias("end")))


def assign(df: DataFrame, time: str, windows) -> DataFrame:
    """Adds start and end for each window that holds a row's time; windows(time column) gives an array of (start, end) structs, so a calendar's windows are as good as regular ones. Rows in no window go."""
    out = df.withColumn("__windows", windows(F.col(time))).withColumn("__window", F.explode("__windows"))
    return out.select(*df.columns, F.col("__window.start").alias("start"), F.col("__window.end").alias("end"))


def contains(window: Column, t: Column) -> Column:
    return (window["start"] <= t) & (t < window["end"])


def _sliced(df: DataFrame, time: str, width: int, *, back: int = 0, ahead: int = 0) -> DataFrame:
    """Rows with their slice of time (`__slice`, its start) and `__own`, and copies (not own) in the next slice of rows that it looks `back` at, in the one before of rows that it looks `ahead` to; neither may exceed the width."""
    t = F.col(time)
    start = t - F.pmod(t, F.lit(width))
    places = [F.array(F.struct(start.alias("s"), F.lit(True).alias("own")))]
    if back:
        places.append(F.when(t + back >= start + width, F.array(F.struct((start + width).alias("s"), F.lit(False).alias("own")))).otherwise(F.array()))
    if ahead:
        places.append(F.when(t - ahead < start, F.array(F.struct((start - width).alias("s"), F.lit(False).alias("own")))).otherwise(F.array()))
    out = df.where(t.isNotNull()).withColumn("__place", F.explode(F.concat(*places)))
    return out.withColumn("__slice", F.col("__place.s")).withColumn("__own", F.col("__place.own")).drop("__place")


def sessions(df: DataFrame, keys: Sequence[str], time: str, gap: int, *, slice_gaps: int = 256) -> DataFrame:
    """key columns, start, end (time of the last event), events: runs of events at most `gap` apart (the gap itself still joins).

    Time is cut into slices of slice_gaps gaps. A window over a key's slice, with the events just before it, finds the
    breaks; a sum over the slices' counts of breaks numbers the sessions through. A busy key spreads over its slices,
    and a session may go through many of them. Null times are left out.
    """
    width = max(1, gap) * slice_gaps
    w = Window.partitionBy(*keys, "__slice").orderBy(time, F.col("__own"))
    t = F.col(time)
    cut = _sliced(df.select(*keys, time), time, width, back=max(1, gap))
    marked = cut.withColumn("__new", (F.col("__own") & F.coalesce(t - F.lag(t).over(w) > gap, F.lit(True))).cast("int"))
    numbered = marked.withColumn("__s", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__own")
    counts = numbered.groupBy(*keys, "__slice").agg(F.max("__s").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__slice").alias("__at"), F.coalesce(before, F.lit(0)).alias("__off"))
    cond = F.col("__slice") == F.col("__at")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = numbered.join(offsets, cond).groupBy(*keys, (F.col("__s") + F.col("__off")).alias("__id"))
    return out.agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("events")).drop("__id")


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, lower: int, upper: int) -> DataFrame:
    """Left columns, then right ones (prefixed r_ where names clash), where keys agree and left - lower <= right <= left + upper.

    Time is cut into slices of the interval's width. A left row meets the two slices that its interval can touch, so the
    join is an equi-join on key and slice: a hot key spreads over its slices, and rows far apart are never compared.
    """
    width = max(1, lower + upper + 1)
    names = {c: f"r_{c}" if c in left.columns else c for c in right.columns}
    lt, rt = F.col(left_time), F.col(names[right_time])
    a = left.withColumn("__slice", F.explode(F.array_distinct(F.array(F.floor((lt - lower) / width), F.floor((lt + upper) / width)))))
    b = right.select(*[F.col(c).alias(n) for c, n in names.items()]).withColumn("__rslice", F.floor(rt / width))
    cond = F.col("__slice") == F.col("__rslice")
    for k in keys:
        cond = cond & (a[k] == b[names[k]])
    out = a.join(b, cond & (rt >= lt - lower) & (rt <= lt + upper))
    return out.drop("__slice", "__rslice", *[names[k] for k in keys if names[k] != k])


def followed_by(df: DataFrame, keys: Sequence[str], time: str, first: Column, second: Column, within: int) -> DataFrame:
    """keys, start, end: for each first event the earliest second event of the key at its time or up to `within` later.

    One sort per key and slice of time, which also has the events up to `within` after it: a window looks ahead for the
    next second event. Several starts may close with one event.
    """
    df = _sliced(df, time, 64 * max(1, within), ahead=within)
    part = Window.partitionBy(*keys, "__slice").orderBy(time)
    w = part.rangeBetween(0, within)
    t = F.col(time)
    own = first & second  # an event is not its own successor
    marked = df.withColumn("__f", F.coalesce(first, F.lit(False))).withColumn("__s", F.coalesce(second, F.lit(False))).withColumn("__both", F.coalesce(own, F.lit(False)))
    later = part.rangeBetween(1, within)
    same = F.sum(F.when(F.col("__s"), 1).otherwise(0)).over(part.rangeBetween(0, 0))
    at_once = same - F.when(F.col("__both"), 1).otherwise(0) > 0
    end = F.when(at_once, t).otherwise(F.min(F.when(F.col("__s"), t)).over(later if within >= 1 else w))
    out = marked.withColumn("__end", end).where("__f AND __own AND __end IS NOT NULL")
    return out.select(*keys, t.alias("start"), F.col("__end").alias("end"))


class Holds:
    """Temporal logic over the events of a key in order of time. Each method gives a boolean column; spans are in time units.

    next: the condition holds at the key's following event. always: at every event from now to now + span.
    eventually: at one of them. Conditions combine with &, | and ~.

    With `within`, spans go up to it and a key is worked on in slices of time: select from prepared(df) and keep the rows
    with `__own`. The following event may be any time away, so `next` needs a key's events in one row and has no such form.
    """

    def __init__(self, keys: Sequence[str], time: str, within: int | None = None) -> None:
        self.time, self.within = time, within
        self.order = Window.partitionBy(*keys, *([] if within is None else ["__slice"])).orderBy(time)

    def prepared(self, df: DataFrame) -> DataFrame:
        """The rows with `__own`, and copies of those that a neighbouring slice looks at. Rows without a time go."""
        if self.within is None:
            return df.withColumn("__own", F.lit(True))
        return _sliced(df, self.time, 64 * max(1, self.within), ahead=self.within)

    def _span(self, span: int) -> int:
        if self.within is not None and span > self.within:
            raise ValueError(f"a span of {span} goes beyond {self.within}")
        return span

    def next(self, cond: Column) -> Column:
        if self.within is not None:
            raise ValueError("next looks beyond a slice of time")
        return F.coalesce(F.lead(cond).over(self.order), F.lit(False))

    def always(self, cond: Column, span: int) -> Column:
        return F.min(F.coalesce(cond, F.lit(False)).cast("int")).over(self.order.rangeBetween(0, self._span(span))) == 1

    def eventually(self, cond: Column, span: int) -> Column:
        return F.max(F.coalesce(cond, F.lit(False)).cast("int")).over(self.order.rangeBetween(0, self._span(span))) == 1


class SegmentTree:
    """Sums over ranges of positions of a small array on the driver, in any semiring; updates and queries in O(log n)."""

    def __init__(self, size: int, ring) -> None:
        self.ring, self.size = ring, 1
        while self.size < size:
            self.size *= 2
        self.nodes = [ring.zero] * (2 * self.size)

    def update(self, i: int, value) -> None:
        i += self.size
        self.nodes[i] = value
        while i > 1:
            i //= 2
            self.nodes[i] = self.ring.plus(self.nodes[2 * i], self.nodes[2 * i + 1])

    def query(self, start: int, end: int):
        """The sum from start to end, both included; an empty or outlying range gives zero."""
        if start > end or start < 0 or end >= self.size:
            return self.ring.zero
        lo, hi, left, right = start + self.size, end + self.size + 1, self.ring.zero, self.ring.zero
        while lo < hi:
            if lo & 1:
                left = self.ring.plus(left, self.nodes[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                right = self.ring.plus(self.nodes[hi], right)
            lo, hi = lo // 2, hi // 2
        return self.ring.plus(left, right)

    def total(self):
        return self.nodes[1]

    def clear(self) -> None:
        self.nodes = [self.ring.zero] * (2 * self.size)


def range_sum(df: DataFrame, position: str, value: str, start: int, end: int, ring) -> DataFrame:
    """The same over a table: one aggregate with the range pushed down to the scan."""
    return df.where(F.col(position).between(start, end)).agg(F.coalesce(ring.plus_agg(F.col(value)).cast(ring.type), ring.zero_col()).alias("total"))


def updated(df: DataFrame, changes: DataFrame, position: str) -> DataFrame:
    """A table of values by position after changes (rows of the same columns): they replace what stands at their positions, or are added."""
    old = df.join(changes.select(F.col(position).alias("__at")).distinct(), F.col(position) == F.col("__at"), "left_anti")
    return old.unionByName(changes.select(*df.columns))


def rolling(df: DataFrame, keys: Sequence[str], position: str, value: str, back: int, ring) -> DataFrame:
    """Adds `rolling`: the sum over a row and the `back` rows before it, by key."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(-back, 0)
    return df.withColumn("rolling", ring.plus_agg(F.col(value)).over(w))
