"""Logical times: vectors ordered place by place, with missing places counting as 0."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Time(tuple):
    """A logical time on the driver; trailing zeros are dropped, so equal times are equal tuples."""

    def __new__(cls, *at: int) -> Time:
        values = list(at[0]) if len(at) == 1 and not isinstance(at[0], int) else list(at)
        while values and values[-1] == 0:
            values.pop()
        return super().__new__(cls, values)

    def _with(self, other: Iterable[int]) -> list[tuple[int, int]]:
        a, b = list(self), list(other)
        n = max(len(a), len(b))
        return list(zip(a + [0] * (n - len(a)), b + [0] * (n - len(b)), strict=True))

    def before_or_at(self, other: Time) -> bool:
        return all(x <= y for x, y in self._with(other))

    def before(self, other: Time) -> bool:
        return self.before_or_at(other) and self != other

    def concurrent(self, other: Time) -> bool:
        return not self.before_or_at(other) and not other.before_or_at(self)

    def join(self, other: Time) -> Time:
        return Time([max(p) for p in self._with(other)])

    def meet(self, other: Time) -> Time:
        return Time([min(p) for p in self._with(other)])

    def advance(self, place: int, by: int = 1) -> Time:
        return self.with_place(place, (self[place] if place < len(self) else 0) + by)

    def with_place(self, place: int, value: int) -> Time:
        out = list(self) + [0] * (place + 1 - len(self))
        out[place] = value
        return Time(out)


class Antichain:
    """Minimal times, none before another."""

    def __init__(self, times: Iterable[Time] = ()) -> None:
        self.times: set[Time] = set()
        for t in times:
            self.insert(t)

    def insert(self, t: Time) -> bool:
        """Takes t in unless a time at or before it is there; times after t go."""
        if any(u.before_or_at(t) for u in self.times):
            return False
        self.times = {u for u in self.times if not t.before_or_at(u)} | {t}
        return True

    def past(self, t: Time) -> bool:
        """Whether nothing at t can come any more: no minimal time is at or before it."""
        return not any(u.before_or_at(t) for u in self.times)

    def meet(self, other: Antichain) -> Antichain:
        return Antichain([*self.times, *other.times])


class FrontierTracker:
    """Counts of open work at times; the frontier is the minimal ones."""

    def __init__(self) -> None:
        self.counts: dict[Time, int] = {}

    def update(self, t: Time, change: int) -> None:
        n = self.counts.get(t, 0) + change
        if n < 0:
            raise ValueError(f"more work ended at {t} than began")
        if n:
            self.counts[t] = n
        else:
            self.counts.pop(t, None)

    def frontier(self) -> Antichain:
        return Antichain(self.counts)


def _pairs(a: Column, b: Column, f) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.zip_with(a, b, lambda x, y: f(F.coalesce(x, zero), F.coalesce(y, zero)))


def trim(t: Column) -> Column:
    """Without trailing zeros, so that equal times are equal arrays."""
    size = F.coalesce(F.array_max(F.transform(t, lambda x, i: F.when(x != 0, i + 1))), F.lit(0))
    return F.slice(t, 1, size)


def join(a: Column, b: Column) -> Column:
    return trim(_pairs(a, b, F.greatest))


def meet(a: Column, b: Column) -> Column:
    return trim(_pairs(a, b, F.least))


def before_or_at(a: Column, b: Column) -> Column:
    return F.forall(_pairs(a, b, lambda x, y: (x <= y)), lambda ok: ok)


def concurrent(a: Column, b: Column) -> Column:
    return ~before_or_at(a, b) & ~before_or_at(b, a)
