"""Folds over dates: walk-forward windows and combinatorial groups with purge and embargo. Lists of dates, on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from itertools import combinations
from math import comb


@dataclass(frozen=True)
class Fold:
    train: tuple[date, ...]
    test: tuple[date, ...]


def walk_forward(dates: Sequence[date], test_size: int, windows: int, step: int | None = None, gap: int = 0, train_size: int | None = None) -> list[Fold]:
    """Windows that end with the last date: each tests ``test_size`` dates after a gap, and trains on what is before."""
    days, step, out = sorted(set(dates)), step or test_size, []
    for k in reversed(range(windows)):
        end = len(days) - k * step
        begin = end - test_size
        train = days[max(0, begin - gap - train_size) if train_size else 0 : max(0, begin - gap)]
        if begin > 0 and train:
            out.append(Fold(tuple(train), tuple(days[begin:end])))
    return out


def groups_of(dates: Sequence[date], n: int) -> list[list[date]]:
    """Consecutive groups whose sizes differ by one at most, the larger first."""
    days = sorted(set(dates))
    size, more = divmod(len(days), n)
    cuts = [k * size + min(k, more) for k in range(n + 1)]
    return [days[a:b] for a, b in zip(cuts, cuts[1:])]


def combinatorial(dates: Sequence[date], n: int, k: int, label_end: dict[date, date] | None = None, embargo_days: int = 0) -> list[Fold]:
    """A fold for each choice of k test groups. Train dates whose label reaches into a test group, or that follow one
    within the embargo, are left out."""
    groups, out = groups_of(dates, n), []
    for chosen in combinations(range(n), k):
        test = [d for g in chosen for d in groups[g]]
        spans = [(groups[g][0], max((label_end or {}).get(d, d) for d in groups[g])) for g in chosen if groups[g]]
        train = []
        for g in range(n):
            for d in groups[g] if g not in chosen else ():
                end = (label_end or {}).get(d, d)
                overlaps = any(d <= b and end >= a for a, b in spans)
                embargoed = any(b < d <= b + timedelta(days=embargo_days) for _, b in spans)
                if not overlaps and not embargoed:
                    train.append(d)
        out.append(Fold(tuple(train), tuple(test)))
    return out


def path_count(n: int, k: int) -> int:
    return comb(n, k) * k // n


def train_window(dates: Sequence[date], mode: str = "full", size: int | None = None, unit: str = "dates") -> list[date]:
    """All dates, the last ``size``, or those of the last ``size`` years."""
    days = sorted(set(dates))
    if mode == "full" or not days or size is None:
        return days
    if unit == "dates":
        return days[-size:]
    last = days[-1]
    floor = last.replace(year=last.year - size, day=min(last.day, 28)) if (last.month, last.day) == (2, 29) else last.replace(year=last.year - size)
    return [d for d in days if d > floor]
