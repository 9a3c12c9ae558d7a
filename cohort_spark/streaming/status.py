"""Which groups of a stream have all their members: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cohort_spark.core import ContractError, require_columns

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

COMPLETE, INCOMPLETE, LATE = "complete", "incomplete", "late"
# Groups share keyed state by a hash; one call settles all groups of a slot.
SLOTS = 256
_STATE = "groups binary, alarm bigint"
_REPORT = "id string, status string, found bigint, expected bigint, last_ms bigint"
_FOUND = [
    T.StructField("status", T.StringType()),
    T.StructField("found", T.LongType()),
    T.StructField("expected", T.LongType()),
    T.StructField("last_ms", T.LongType()),
]
_GROUPS = pa.schema(
    [("id", pa.string()), ("members", pa.list_(pa.string())), ("found", pa.int64()), ("expected", pa.int64()), ("last", pa.int64()), ("status", pa.string()), ("alarm", pa.int64())]
)
# Keys as text that reads back as the same values.
_AS_TEXT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in a store that timers and typed state need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


@dataclass
class _Group:
    """What is known of one group."""

    members: list[str] | set[str]
    found: int = 0
    expected: int | None = None
    last: int | None = None
    status: str | None = None
    alarm: int | None = None


def _packed(groups: dict[str, _Group]) -> bytes:
    fields = [[getattr(g, name) for g in groups.values()] for name in _GROUPS.names[2:]]
    columns = [list(groups), [list(g.members) for g in groups.values()], *fields]
    batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _GROUPS, strict=True)], schema=_GROUPS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _GROUPS) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _opened(packed: bytes) -> dict[str, _Group]:
    table = pa.ipc.open_stream(bytes(packed)).read_all()
    ids, *fields = [c.to_pylist() for c in table.columns]
    return {i: _Group(*row) for i, *row in zip(ids, *fields, strict=True)}


def _reports(groups: dict[str, _Group]) -> pd.DataFrame:
    rows = [(i, g.status, g.found, g.expected, g.last) for i, g in groups.items()]
    out = pd.DataFrame(rows, columns=["id", *[f.name for f in _FOUND]])
    return out.astype({"expected": "Int64"})


class _GroupStatus(StatefulProcessor):
    """The groups of one slot: members seen so far; one report when all are there, or when none came for ``wait_ms``.

    The slot is read and written as a whole and has one timer, at its earliest alarm.
    """

    def __init__(self, wait_ms: int, keep_ms: int) -> None:
        self.wait_ms, self.keep_ms = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("slot", _STATE)

    def _settle(self, groups: dict[str, _Group], old: int | None) -> None:
        """Store the slot and move its timer."""
        at = min((g.alarm for g in groups.values()), default=None)
        if old is not None and old != at:
            self.handle.deleteTimer(old)
        if at is None:
            self.state.clear()
            return
        if old != at:
            self.handle.registerTimer(at)
        self.state.update((_packed(groups), at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.state.get()
        groups, alarm = (_opened(state[0]), state[1]) if state else ({}, None)
        touched: dict[str, _Group] = {}
        for part in rows:
            for i, member, declared, at in zip(part["id"], part["member"], part["expected"], part["at_ms"], strict=True):
                g = touched.get(i)
                if g is None:
                    g = touched[i] = groups.setdefault(i, _Group(set()))
                    g.members = set(g.members)
                if isinstance(member, str):
                    g.members.add(member)
                if declared is not None and declared == declared and (g.expected is None or declared > g.expected):
                    g.expected = int(declared)
                if g.last is None or at > g.last:
                    g.last = int(at)
        changed = {}
        for i, g in touched.items():
            was = g.status
            if was != COMPLETE:
                g.found = len(g.members)
                if g.expected is not None and g.found >= g.expected and was is None:
                    g.status = COMPLETE
                elif was == INCOMPLETE:
                    g.status = LATE
            if g.status != was:
                changed[i] = g
            # What is complete needs no members any more, only a mark against a second report.
            g.members = [] if g.status == COMPLETE else sorted(g.members)
            g.alarm = g.last + (self.wait_ms if g.status is None else self.keep_ms)
        if changed:
            yield _reports(changed)
        self._settle(groups, alarm)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.state.get()
        if state is None:
            return
        groups = _opened(state[0])
        # Alarms before the watermark have all expired, though the slot has one timer.
        edge = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        expired = {i: g for i, g in groups.items() if g.alarm <= edge}
        silent = {i: g for i, g in expired.items() if g.status is None}
        for i in expired.keys() - silent.keys():
            del groups[i]
        for g in silent.values():
            g.status, g.alarm = INCOMPLETE, g.last + self.wait_ms + self.keep_ms
        if silent:
            yield _reports(silent)
        self._settle(groups, None)

    def close(self) -> None:
        pass


def group_status(
    rows: DataFrame,
    *,
    group: Sequence[str],
    member: str,
    expected: str,
    event_time: str,
    late: str = "1 hour",
    wait: timedelta = timedelta(hours=6),
    keep: timedelta | None = None,
    slots: int = SLOTS,
) -> DataFrame:
    """``group, status, found, expected, last_ms`` of every group of a stream, reported once.

    A group is ``complete`` as soon as it has as many different members as any of its rows declares.
    It is ``incomplete`` when the watermark (the newest event time less ``late``) passes its newest
    row by ``wait``. A row that comes to an incomplete group afterwards reports it once more, as
    ``late``, with all members found by then; rows to a complete group report nothing. Reported groups
    are forgotten ``keep`` (``wait`` unless given) after their newest row or report; rows that come later
    still begin a new group. Rows older than
    the watermark are dropped by the engine and counted in its progress.

    Rows without a member only declare; a group without a declared number is never complete. Rows
    without event time cannot be placed and fail the query. The state of a group is its members until
    it is settled, a mark afterwards. Start the query inside ``state_store``.
    """
    require_columns(rows, [*group, member, expected, event_time])
    clash = {f.name for f in _FOUND} & set(group)
    if clash:
        raise ContractError("the result names a column like a group: " + ", ".join(sorted(clash)))
    keys = [rows.schema[c] for c in group]
    placed = F.col(event_time).cast("timestamp")
    timed = F.when(placed.isNotNull(), placed).otherwise(F.raise_error(F.lit("a row has no event time")).cast("timestamp"))
    slim = rows.select(
        F.to_json(F.struct(*[F.col(c) for c in group]), _AS_TEXT).alias("id"),
        F.pmod(F.xxhash64(*group), F.lit(slots)).cast("int").alias("slot"),
        F.col(member).cast("string").alias("member"),
        F.col(expected).cast("bigint").alias("expected"),
        timed.alias("at"),
    ).withWatermark("at", late)
    millis = lambda d: int(d.total_seconds() * 1000)
    processor = _GroupStatus(millis(wait), millis(keep or wait))
    reports = (
        slim.withColumn("at_ms", F.unix_millis("at"))
        .groupBy("slot")
        .transformWithStateInPandas(processor, _REPORT, "append", "EventTime")
    )
    named = F.from_json("id", T.StructType(keys), _AS_TEXT)
    return reports.select(named.alias("_key"), *[f.name for f in _FOUND]).select("_key.*", *[f.name for f in _FOUND])
