"""What a value is against all that came before it: expanding percentiles, crowding, memory of series, and draws that
depend on earlier ones."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import recipes as R
from loomspark.operators.panel import PANEL, Panel
from loomspark.operators.time_series import _adf_t_of_ends, fracdiff_weights

#: Replicates of a group that one task draws.
SIDE_BY_SIDE = 4
#: Events, of whole groups, that a task takes up at a time; numbers of the replicates that draw side by side; draws of a
#: replicate that are hashed at a time.
ROWS, CELLS, STEPS = 1 << 17, 1 << 21, 1 << 10
#: Windows, in dates, over which crowding is measured.
CROWDING_WINDOWS = (10, 20, 30, 40, 50, 60)


def expanding_percentile(df: DataFrame, value: str, group: Sequence[str], order: str, out: str = "percentile") -> DataFrame:
    """df with the share of the group's known values up to each row, itself included, that are not above its own.

    ``order`` has no ties in a group. NULL for unknown values. Places in the order are halved again and again: at each
    level a block's left half is sorted with its right half, whose rows count those of the left one that are not above
    them. A row is in as many sorts as its group's size has bits, and no row is compared with all before it.
    """
    row = Window.partitionBy(*group).orderBy(order)
    known = df.filter(F.col(value).isNotNull()).withColumn("_p", F.row_number().over(row) - 1).withColumn("_v", F.col(value).cast("double"))
    size = known.withColumn("_last", F.max("_p").over(Window.partitionBy(*group)))
    levels = F.sequence(F.lit(0), F.length(F.bin("_last")) - 1)
    each = size.select(*group, order, "_p", "_v", F.explode(levels).alias("_level"))
    right = F.call_function("shiftright", F.col("_p"), F.col("_level")).bitwiseAND(F.lit(1))
    each = each.withColumn("_right", right).withColumn("_block", F.call_function("shiftright", F.col("_p"), F.col("_level") + 1))
    merged = Window.partitionBy(*group, "_level", "_block").orderBy("_v", "_right").rowsBetween(Window.unboundedPreceding, 0)
    counted = each.withColumn("_below", F.sum(1 - F.col("_right")).over(merged)).filter("_right = 1").groupBy(*group, order).agg(F.sum("_below").alias("_below"))
    found = known.select(*group, order, "_p").join(counted, [*group, order], "left")
    found = found.select(*group, order, ((F.coalesce("_below", F.lit(0)) + 1) / (F.col("_p") + 1)).alias(out))
    return df.join(found, [*group, order], "left")


def crowding(large: DataFrame, small: DataFrame, windows: Sequence[int] = CROWDING_WINDOWS, date: str = "trade_date") -> DataFrame:
    """date, small_crowding, large_crowding from two series of close and amount, on the dates that both have.

    For each window: the difference of the two momenta and the mean ratio of the amounts, each as a percentile among
    those of the dates so far that have a momentum. Crowding is the mean of the three highest percentiles of each of
    the two kinds, and of large ones the same of what they lack to 1; NULL until the longest window is full. Values are
    compared by 12 decimals, so that equal ones are equal however they were summed up.
    """
    both = large.select(date, F.col("close").alias("_cl"), F.col("amount").alias("_al")).join(small.select(date, F.col("close").alias("_cs"), F.col("amount").alias("_as")), date)
    w = Window.orderBy(date)  # a row a date
    both = both.withColumn("_n", F.row_number().over(w)).withColumn("_ratio", R.ratio("_as", "_al"))
    for k in windows:
        change = R.ratio("_cs", F.lag("_cs", k).over(w)) - R.ratio("_cl", F.lag("_cl", k).over(w))
        mean = F.avg("_ratio").over(w.rowsBetween(1 - k, 0))
        both = both.withColumn(f"momentum_{k}", change).withColumn(f"turnover_{k}", F.when(F.col("_n") > k, mean))
    names = [f"{kind}_{k}" for kind in ("momentum", "turnover") for k in windows]
    long = both.select(date, "_n", *(F.round(c, 12).alias(c) for c in names)).unpivot([date, "_n"], names, "series", "value")
    ranked = expanding_percentile(long, "value", ["series"], date).withColumn("kind", F.substring_index("series", "_", 1))
    three = lambda x: F.aggregate(F.slice(F.sort_array(F.collect_list(x), False), 1, 3), F.lit(0.0), lambda a, b: a + b) / 3
    kinds = ranked.filter(F.col("_n") > max(windows)).groupBy(date, "kind").agg(three(F.col("percentile")).alias("small"), three(1 - F.col("percentile")).alias("large"), F.count("percentile").alias("known"))
    kinds = kinds.withColumns({c: F.when(F.col("known") >= 3, F.col(c)) for c in ("small", "large")})
    found = kinds.groupBy(date).agg(F.avg("small").alias("small_crowding"), F.avg("large").alias("large_crowding"))
    return both.select(date).join(found, date, "left")


def fractional_order(
    df: DataFrame,
    column: str,
    d_values: Sequence[float] = tuple(k / 10 for k in range(11)),
    threshold: float = 1e-5,
    critical: float = -2.86,
    lags: int = 1,
    least: int = 50,
    panel: Panel = PANEL,
) -> DataFrame:
    """entity, d, adf_t, correlation, n: the least order of fractional differences that makes each entity's series
    stationary, and how much of the series it keeps.

    All orders of an entity are tried in one group; those with fewer than ``least`` values do not count. Where none
    has an ADF t of ``critical`` or below, the one with the least t; entities without a candidate have no row.
    """
    if not d_values:
        raise ValueError("no orders to try")
    orders = sorted(float(d) for d in d_values)
    kind = df.schema[panel.entity].dataType.simpleString()
    cells = df.select(panel.entity, panel.date, R.clean(column).alias("_x"))
    weights = [fracdiff_weights(d, threshold) for d in orders]

    def tried(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(panel.date)
        x, rows = group["_x"].to_numpy(float), []
        for d, w in zip(orders, weights):
            value = np.full(len(x), np.nan)
            if len(x) >= len(w):
                value[len(w) - 1 :] = np.convolve(x, w[::-1], "valid")
            there = ~np.isnan(x) & ~np.isnan(value)
            a, b = x[there], value[there]
            spread = a.std() * b.std() if len(a) else 0.0
            keeps = float(((a - a.mean()) * (b - b.mean())).mean() / spread) if spread > 0 else None
            t = float("nan")
            if len(b) >= max(8, lags + 5):  # the regression over all of b
                t = next(_adf_t_of_ends(b, len(b), lags, len(b)))[0, 0]
            rows.append((group[panel.entity].iloc[0], d, t, keeps, len(a)))
        return pd.DataFrame(rows, columns=[panel.entity, "d", "adf_t", "correlation", "n"])

    found = cells.groupBy(panel.entity).applyInPandas(tried, f"{panel.entity} {kind}, d double, adf_t double, correlation double, n long")
    found = found.filter(F.col("n") >= least).withColumn("adf_t", F.nanvl("adf_t", F.lit(None).cast("double")))
    stationary = F.coalesce(F.col("adf_t") <= critical, F.lit(False))
    best = F.min_by(F.struct("d", "adf_t", "correlation", "n"), F.struct((~stationary).alias("a"), F.when(~stationary, F.coalesce("adf_t", F.lit(float("inf")))).alias("b"), F.col("d").alias("c")))
    return found.groupBy(panel.entity).agg(best.alias("x")).select(panel.entity, "x.*")


def uniform(*parts) -> float:
    """A number from 0 to below 1, by a hash of the parts."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=7).digest(), "big") / 2**56


def _uniforms(prefix: str, ends: list[bytes]) -> np.ndarray:
    """``uniform`` of parts that begin alike, whose spellings are the prefix and each of the ends."""
    base, digest = hashlib.blake2b(prefix.encode(), digest_size=7), bytearray()
    for end in ends:
        h = base.copy()
        h.update(end)
        digest += h.digest()
    numbers = np.zeros((len(ends), 8), np.uint8)
    numbers[:, 1:] = np.frombuffer(digest, np.uint8).reshape(-1, 7)
    return numbers.view(">u8").ravel().astype(float) / 2**56


class _Events:
    """Events of a group in their order, by the edges of their bars: between two edges all bars are alike."""

    def __init__(self, a: np.ndarray, b: np.ndarray, prefixes: list[str], size: int):
        self.prefixes, self.size, self.length = prefixes, size, b - a
        edges = np.unique(np.concatenate([a, b]))
        self.first, self.last, self.width = np.searchsorted(edges, a), np.searchsorted(edges, b), np.diff(edges).astype(float)
        # by their first bar: those that meet an event are in one range of them, as none is longer than the longest
        self.order = np.argsort(self.first, kind="stable")
        by_first = self.first[self.order]
        self.reach = int((self.last - self.first).max())
        self.low, self.high = np.searchsorted(by_first, self.first - self.reach, side="right"), np.searchsorted(by_first, self.last)
        total = np.concatenate([[0.0], np.cumsum(self.width)])
        self.mean = (total[self.last] - total[self.first]) / self.length

    def cells(self) -> int:
        """Numbers that a replicate takes."""
        return len(self.first) + len(self.width) + 4 * self.reach


def _together(groups: list[_Events]) -> list[list[_Events]]:
    """The groups in sets to be drawn side by side: of like reach and size, and not of more cells than ``CELLS``
    unless a group alone has them."""
    sets: list[list[_Events]] = []
    most = lanes = 0
    for g in sorted(groups, key=lambda g: (g.reach.bit_length(), len(g.first)), reverse=True):
        most, lanes = max(most, g.cells()), lanes + len(g.prefixes)
        if not sets or lanes * most > CELLS or 4 * g.reach < sets[-1][0].reach:
            sets.append([])
            most, lanes = g.cells(), len(g.prefixes)
        sets[-1].append(g)
    return [sorted(s, key=lambda g: -g.size) for s in sets]


def _draws(groups: list[_Events]) -> list[np.ndarray]:
    """The places of the events drawn, an array for each group and prefix. A lane is a replicate of a group, and a step
    one draw of each lane. Shares are kept with their sums over blocks, so that a draw adds up as many numbers as the
    root of the events, and changes the shares of the events that meet it alone. Groups by descending size."""
    owner = np.repeat(np.arange(len(groups)), [len(g.prefixes) for g in groups])
    lanes = len(owner)
    at = np.cumsum([0, *(len(g.first) for g in groups)])[:-1]
    first, last, length, low, high = (np.concatenate([getattr(g, c) for g in groups]) for c in ("first", "last", "length", "low", "high"))
    order = np.concatenate([g.order + e for g, e in zip(groups, at.tolist())])
    events, reach, size, at = (np.array(x)[owner] for x in ([len(g.first) for g in groups], [g.reach for g in groups], [g.size for g in groups], at))
    row = np.arange(lanes)

    block = int(max(events) ** 0.5) + 1
    blocks = -(-int(max(events)) // block)
    mean = np.zeros((lanes, blocks * block))
    far = int(max(reach))
    bars = max(len(g.width) for g in groups)
    stride = far + bars
    width = np.zeros(lanes * stride + 3 * far)  # a lane's bars begin after as many cells as the longest event has
    each = width[: lanes * stride].reshape(lanes, stride)
    for k, g in enumerate(owner.tolist()):
        mean[k, : events[k]] = groups[g].mean
        each[k, far : far + len(groups[g].width)] = groups[g].width
    drawn, each_bar = np.ones(len(width)), width.copy()
    sums, last_block = mean.reshape(lanes, blocks, block).sum(2), (events - 1) // block
    flat, flat_sums, in_blocks, three = mean.ravel(), sums.ravel(), mean.reshape(-1, block), mean.reshape(lanes, blocks, block)
    begin_of_lane, columns, window, touched = row * stride + far, np.arange(far), np.arange(3 * far), np.zeros(lanes * blocks, bool)

    chosen = np.zeros((lanes, int(max(size))), np.int64)
    for step in range(int(max(size))):
        n = int(np.searchsorted(-size, -step))  # lanes that still draw
        if step % STEPS == 0:
            ends = [b"%d)" % k for k in range(step, min(step + STEPS, int(max(size))))]
            share = np.array([_uniforms(p, ends) for g in groups for p in g.prefixes][:n]).T.copy()
        e, some = at[:n], row[:n]
        total = sums[:n].cumsum(1)
        want = share[step % STEPS, :n] * total[:, -1]
        b = np.minimum((total <= want[:, None]).sum(1), last_block[:n])
        want -= np.where(b > 0, total[some, b - 1], 0.0)
        x = (three[some, b].cumsum(1) <= want[:, None]).sum(1)
        x = np.minimum(b * block + np.minimum(x, block - 1), events[:n] - 1)
        chosen[:n, step] = x
        x = x + e

        i = first[x]
        bar = begin_of_lane[:n] + i
        cover = (bar[:, None] + columns)[columns < (last[x] - i)[:, None]]
        drawn[cover] += 1
        each_bar[cover] = width[cover] / drawn[cover]
        near = reach[:n]
        total = np.zeros((n, 3 * far + 1))
        np.cumsum(each_bar[(bar - near)[:, None] + window], axis=1, out=total[:, 1:])

        many = high[x] - low[x]
        lane = np.repeat(some, many)
        met = order[np.arange(len(lane)) + np.repeat(e + low[x] - (np.cumsum(many) - many), many)]
        keep = last[met] > i[lane]
        lane, met = lane[keep], met[keep]
        place = (some * (3 * far + 1) + near - i)[lane]
        total = total.ravel()
        share_of = (total[place + last[met]] - total[place + first[met]]) / length[met]
        cell = lane * (blocks * block) + met - e[lane]
        flat[cell] = share_of
        touched[cell // block] = True
        hit = np.flatnonzero(touched[: n * blocks])
        flat_sums[hit] = in_blocks[hit].sum(1)
        touched[hit] = False
    return [chosen[k, : size[k]] for k in range(lanes)]


def sequential_bootstrap(events: DataFrame, event: str, start: str, end: str, replicates: int, length: int | None = None, seed: int = 0, group: Sequence[str] = ()) -> DataFrame:
    """group, replicate, draw, event: events drawn one after the other, those more likely that add new bars.

    start, end: the first and last bar of each event, whole numbers. A draw's probability is proportional to the mean,
    over the event's bars, of one over one more than the draws so far that cover the bar. length: draws of each
    replicate, by default as many as the group has events. Some replicates of a group are in one task, which takes up
    whole groups and makes the k-th draw of many of them in one step; its bars are kept as the ends of intervals, and
    draws are hashed, so that they are the same whenever they are repeated. A draw changes the shares of the events that
    meet it alone. A task holds ``ROWS`` events at a time, or those of a group that has more.
    """
    keys = [*group, "_part"]
    each = events.select(*group, event, F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_b"))
    each = each.filter("_a <= _b").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // SIDE_BY_SIDE))))
    dealt = each.repartition(*keys).sortWithinPartitions(*keys, F.col(event).asc_nulls_last(), "_a", "_b")
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join([*(f"{g} {types[g]}" for g in group), "replicate int, draw int", f"{event} {types[event]}"])

    def of_groups(table: pa.Table, edges: list[int]):
        names, parts = [table.column(g) for g in group], table.column("_part").to_numpy()
        a, b = table.column("_a").to_numpy(), table.column("_b").to_numpy() + 1
        firsts = pa.array(edges[:-1])
        spelt, groups = zip(*(c.take(firsts).to_pylist() for c in names)) if names else [()] * len(firsts), []
        for key, x, y in zip(spelt, edges, edges[1:]):
            begin = int(parts[x]) * SIDE_BY_SIDE
            own = range(begin, min(begin + SIDE_BY_SIDE, replicates))
            found = _Events(a[x:y], b[x:y], [repr((seed, *map(str, key), k))[:-1] + ", " for k in own], y - x if length is None else length)
            found.begin, found.replicates = x, own
            groups.append(found)
        for some in _together(groups):
            lanes = [(g, k) for g in some for k in g.replicates]
            chosen, sizes = _draws(some), [g.size for g, _ in lanes]
            begins = np.repeat([g.begin for g, _ in lanes], sizes)
            drawn = pa.array(np.concatenate(chosen) + begins)
            replicate, draw = np.repeat([k for _, k in lanes], sizes), np.concatenate([np.arange(n) for n in sizes])
            out = [*(c.take(pa.array(begins)) for c in names), pa.array(replicate, pa.int32()), pa.array(draw, pa.int32()), table.column(event).take(drawn)]
            yield from pa.Table.from_arrays(out, [*group, "replicate", "draw", event]).to_batches(max_chunksize=1 << 16)

    def compute(batches):
        held, rows, most = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:  # all groups but the last, which may go on
                table = pa.Table.from_batches(held)
                edges = _edges(table, keys)
                if len(edges) > 2:
                    yield from of_groups(table, edges[:-1])
                rest = table.slice(edges[-2])
                held, rows, most = rest.to_batches(), rest.num_rows, max(ROWS, 2 * rest.num_rows)
        if rows:
            table = pa.Table.from_batches(held)
            yield from of_groups(table, _edges(table, keys))

    return dealt.mapInArrow(compute, schema)


def _edges(table: pa.Table, keys: Sequence[str]) -> list[int]:
    """Where the runs of equal keys begin, and the end."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
