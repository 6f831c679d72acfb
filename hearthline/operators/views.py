"""Device view history: joins with the registry, rankings, retention, throttling."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock, interval, is_blank, utf16_length
from ..session import ship_by_value

ship_by_value(__name__)

# Dashboard limits.
TOP_DEVICES, HISTORY_DAYS = 5, 30
VIEW_GAP = "1 minute"
MAX_ID = 100

# Length of a throttle slice in gaps.
SLICE_GAPS = 10


def valid_views(views: DataFrame) -> DataFrame:
    """Views whose user and device ids are neither blank nor over-long."""

    def usable(column: str):
        return ~is_blank(F.col(column)) & (utf16_length(F.col(column)) <= MAX_ID)

    return views.filter(usable("user_id") & usable("device_id"))


def active_views(views: DataFrame, devices: DataFrame) -> DataFrame:
    """Views of active devices with the device's name."""
    return views.join(devices.filter("is_active").select("device_id", "name"), "device_id")


def trackable_views(views: DataFrame, devices: DataFrame) -> DataFrame:
    """Views that may be recorded: the device exists, is active and is the viewer's own."""
    own = devices.filter("is_active").select("device_id", "user_id")
    return views.join(own, ["device_id", "user_id"], "left_semi")


def rejected_views(views: DataFrame, devices: DataFrame) -> DataFrame:
    own = devices.filter("is_active").select("device_id", "user_id")
    return views.join(own, ["device_id", "user_id"], "left_anti")


def top_devices(
    views: DataFrame, devices: DataFrame, as_of: str, days: int = HISTORY_DAYS, k: int = TOP_DEVICES
) -> DataFrame:
    """The ``k`` most viewed active devices of every user; ties go to the lower id.

    Views are counted per (user, device) first, so the join and the ranking see
    one row per pair however often it was viewed.
    """
    since = clock(views, "viewed_at", as_of) - interval(f"{days} days")
    counts = (
        views.filter(F.col("viewed_at") >= since)
        .groupBy("user_id", "device_id")
        .agg(F.count(F.lit(1)).alias("views"))
    )
    ranked = W.partitionBy("user_id").orderBy(F.desc("views"), "device_id")
    return (
        active_views(counts, devices)
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("user_id", "rank", "device_id", "name", "views")
    )


def recent_views(views: DataFrame, since: str) -> DataFrame:
    """Per (user, device): is there a view at or after ``since``?"""
    start = clock(views, "viewed_at", since)
    return views.groupBy("user_id", "device_id").agg(
        (F.count_if(F.col("viewed_at") >= start) > 0).alias("recent")
    )


def retain_views(views: DataFrame, as_of: str, days: int) -> DataFrame:
    """Views not older than ``days``; a view exactly that old stays."""
    return views.filter(~_outdated(views, as_of, days))


def outdated_views(views: DataFrame, as_of: str, days: int) -> DataFrame:
    return views.filter(_outdated(views, as_of, days))


def _outdated(views: DataFrame, as_of: str, days: int):
    cutoff = clock(views, "viewed_at", as_of) - interval(f"{days} days")
    return F.coalesce(F.col("viewed_at") < cutoff, F.lit(False))


# --- throttle -------------------------------------------------------------
#
# A view is accepted when it lies more than ``gap`` after the last *accepted*
# view of its (user, device).  The chain of accepted views is sequential, so a
# busy pair is cut into time slices that are worked on independently:
#
# 1. For each slice that a previous one can influence, ``_outcomes`` works out
#    the last accepted view as a step function of the last one accepted before.
# 2. ``_carry`` follows these steps along the slices of a pair, a few rows each.
# 3. ``_accept`` marks the accepted views of each slice from its starting point.
#
# In a slice of SLICE_GAPS gaps a chain takes at most SLICE_GAPS + 1 steps, and
# all slices of an Arrow batch take each step together.


def throttle_views(views: DataFrame, gap: str = VIEW_GAP) -> DataFrame:
    """Views left after dropping those within ``gap`` of an accepted one.

    ``views`` has (id, user_id, device_id, viewed_at, ...); simultaneous views
    are taken in id order.
    """
    amount, unit = gap.split()
    keys = ["user_id", "device_id", "_slice"]
    sliced = views.withColumn(
        "_slice", F.window("viewed_at", f"{int(amount) * SLICE_GAPS} {unit}").start
    )
    gap_us = _microseconds(gap)
    slice_us = gap_us * SLICE_GAPS

    time_type = views.schema["viewed_at"].dataType
    step_schema = T.StructType(
        [
            T.StructField("user_id", T.StringType()),
            T.StructField("device_id", T.StringType()),
            T.StructField("_slice", time_type),
            T.StructField("_until", time_type),
            T.StructField("_last", time_type),
        ]
    )
    # Step rows: a last accepted view up to ``_until`` leads to ``_last``.
    steps = (
        sliced.select(*keys, "viewed_at")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "viewed_at")
        .mapInArrow(_outcomes(gap_us, slice_us), step_schema)
    )
    entries = (
        steps.repartition("user_id", "device_id")
        .sortWithinPartitions(*keys, "_until")
        .mapInArrow(_carry(gap_us, slice_us), T.StructType(step_schema.fields[:3] + step_schema.fields[4:]))
    )
    # A slice's starting point joins its views as one leading row.
    lead = entries.withColumn("_lead", F.lit(0))
    marked = (
        sliced.withColumn("_lead", F.lit(1))
        .unionByName(lead, allowMissingColumns=True)
        .repartition(*keys)
        .sortWithinPartitions(*keys, "_lead", "viewed_at", "id")
    )
    accepted = marked.mapInArrow(_accept(gap_us), marked.schema)
    return accepted.select(*views.columns)


def _microseconds(gap: str) -> int:
    amount, unit = gap.split()
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(amount) * seconds * 1_000_000


def _whole_groups(
    batches: Iterable[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that never split a group of equal ``keys``, with the first row of each group."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        starts = _starts(pa.Table.from_batches([batch]), keys)
        if pending:
            seam = pa.Table.from_batches([pending[-1].slice(pending[-1].num_rows - 1), batch.slice(0, 1)])
            if len(_starts(seam, keys)) == 1:
                starts = starts[1:]
        if len(starts) == 0:
            pending.append(batch)
            continue
        cut = int(starts[-1])
        table = pa.Table.from_batches([*pending, batch.slice(0, cut)])
        if table.num_rows:
            yield table, _starts(table, keys)
        pending = [batch.slice(cut)]
    if pending:
        table = pa.Table.from_batches(pending)
        yield table, _starts(table, keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for key in keys:
        column = table[key].combine_chunks()
        differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), True)
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _micros(table: pa.Table, column: str, default: int = 0) -> np.ndarray:
    as_int = pc.fill_null(pc.cast(table[column], pa.int64()), default)
    return as_int.to_numpy()


_NEVER = np.iinfo(np.int64).min // 4
_PAIR = ["user_id", "device_id"]


class _Chain:
    """Next-acceptable pointers over the sorted times of many groups at once."""

    def __init__(self, times: np.ndarray, starts: np.ndarray, gap: int):
        sizes = np.diff(np.append(starts, len(times)))
        self.group = np.repeat(np.arange(len(starts)), sizes)
        self.ends = starts + sizes
        self.gap = gap
        # Shift each group so that one sorted axis holds all of them, with more
        # than a gap between groups.
        self.origin = times[starts]
        spans = times[self.ends - 1] - self.origin
        self.offset = np.concatenate([[0], np.cumsum(spans + 2 * gap + 2)[:-1]]) if len(starts) else spans
        self.axis = times - self.origin[self.group] + self.offset[self.group]

    def first_after(self, group: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Row of the first view more than a gap after ``last``; the group's end if none."""
        position = np.clip(last + self.gap - self.origin[group], -1, None) + self.offset[group]
        row = np.searchsorted(self.axis, position, side="right")
        return np.minimum(row, self.ends[group])

    def follow(self, row: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yield (which chains moved, their rows) step by step until all have ended."""
        live = np.flatnonzero(row < self.ends[group])
        row = row[live]
        while len(live):
            yield live, row
            row = np.searchsorted(self.axis, self.axis[row] + self.gap, side="right")
            on = row < self.ends[group[live]]
            live, row = live[on], row[on]


def _outcomes(gap: int, slice_len: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, [*_PAIR, "_slice"]):
            times, begin = _micros(table, "viewed_at"), _micros(table, "_slice")[starts]
            chain = _Chain(times, starts, gap)
            # Only a view in the first gap of a slice can be held back from
            # outside, and only one in its last gap can hold others back.
            opens = times[starts] <= begin + gap
            reaches = times[chain.ends - 1] + gap >= begin + slice_len
            kept = np.flatnonzero(opens | reaches)
            if not len(kept):
                continue
            # Entry rows of a slice: each view a gap or less after its begin,
            # and the first one beyond.  A last accepted view up to
            # (previous view - gap - 1) enters at that row.
            fresh = chain.first_after(kept, begin[kept] - 1)
            counts = np.where(opens[kept], fresh - starts[kept] + 1, 1)
            group = np.repeat(kept, counts)
            nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            row = np.where(opens[group], starts[group] + nth, starts[group])
            last = np.full(len(row), _NEVER)
            for live, at in chain.follow(row, group):
                last[live] = times[at]
            until = np.where(
                row < np.repeat(fresh, counts),
                times[np.minimum(row, len(times) - 1)] - gap - 1,
                begin[group] - 1,
            )
            # Neighbouring steps with one outcome are one step.
            final = np.append((group[1:] != group[:-1]) | (last[1:] != last[:-1]), True)
            group, until, last = group[final], until[final], last[final]
            kind = table.schema.field("viewed_at").type
            yield pa.RecordBatch.from_arrays(
                [
                    *[table[k].combine_chunks().take(pa.array(starts[group])) for k in _PAIR],
                    pa.array(begin[group]).cast(kind),
                    pa.array(until).cast(kind),
                    pa.array(last, mask=last == _NEVER).cast(kind),
                ],
                names=[*_PAIR, "_slice", "_until", "_last"],
            )

    return run


def _carry(gap: int, slice_len: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, slice_at, settled = None, _NEVER, None, True
        for batch in batches:
            table = pa.Table.from_batches([batch])
            new_pair = np.zeros(table.num_rows, dtype=bool)
            new_pair[_starts(table, _PAIR)] = True
            slices = _micros(table, "_slice").tolist()
            untils = _micros(table, "_until").tolist()
            lasts = _micros(table, "_last", _NEVER).tolist()
            take, entry = [], []
            for i, (begin, until, outcome) in enumerate(zip(slices, untils, lasts)):
                if new_pair[i]:
                    pair = tuple(table[k][i].as_py() for k in _PAIR)
                    if pair != key:
                        key, last, slice_at = pair, _NEVER, None
                if begin != slice_at:
                    slice_at, settled = begin, False
                    if last + gap >= begin:
                        take.append(i)
                        entry.append(last)
                if not settled and last <= until:
                    settled = True
                    last = last if outcome == _NEVER else outcome
            if take:
                rows = pa.array(take)
                kind = table.schema.field("_last").type
                yield pa.RecordBatch.from_arrays(
                    [
                        *[table[k].combine_chunks().take(rows) for k in [*_PAIR, "_slice"]],
                        pa.array(entry, pa.int64()).cast(kind),
                    ],
                    names=[*_PAIR, "_slice", "_last"],
                )

    return run


def _accept(gap: int):
    keys = [*_PAIR, "_slice"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, carried = None, _NEVER
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            starts = _starts(table, keys)
            is_view = _micros(table, "_lead") == 1
            led = ~is_view[starts]
            last = np.where(led, _micros(table, "_last", _NEVER)[starts], _NEVER)
            # The first group may go on from the batch before.
            if before is not None:
                seam = pa.Table.from_batches([before, batch.slice(0, 1)])
                if len(_starts(seam, keys)) == 1:
                    last[0] = carried
            before, carried = batch.slice(batch.num_rows - 1), int(last[-1])

            views = table.filter(pa.array(is_view))
            # Leading rows are gone now: move the group starts up accordingly.
            starts = starts - np.concatenate([[0], np.cumsum(led)[:-1]])
            filled = starts < views.num_rows
            starts, last = starts[filled], last[filled]
            if not len(starts):
                continue
            times, group = _micros(views, "viewed_at"), np.arange(len(starts))
            chain = _Chain(times, starts, gap)
            keep = np.zeros(views.num_rows, dtype=bool)
            for _, row in chain.follow(chain.first_after(group, last), group):
                keep[row] = True
            kept = np.flatnonzero(keep)
            if filled[-1] and len(kept) and kept[-1] >= starts[-1]:
                carried = int(times[kept[-1]])
            yield from views.filter(pa.array(keep)).to_batches()

    return run
