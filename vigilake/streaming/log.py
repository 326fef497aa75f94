"""Streams of events and calls with state of each owner: the last hash of its chain, what it has spent so far.

Events may arrive out of order. They wait in a buffer of their owner, a map by (seq, digest), until the watermark has passed their
time; a timer then releases them, and all of the buffer that comes before them by seq, in the order of the batch chain. So
a stream whose rows are no later than the watermark's delay gives what the batch table gives. Rows that are later are dropped by Spark and
counted in the query's progress. State is one short row and the buffered rows of each owner; it may start from a batch table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.store import GENESIS, event_digest, link

CHAINED = "owner string, seq long, place long, hash string"
GATED = "owner string, seq long, cost long, spent_before long, refused boolean"


class InOrder(StatefulProcessor):
    """Releases the rows of an owner by (seq, digest) once the watermark has passed them; step() says what becomes of each."""

    state = payload = ""
    columns: list[str] = []

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, seq: int, payload: tuple) -> tuple[tuple, tuple]:
        """The state after a row, and what is told of it."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.state)
        self.waiting = handle.getMapState("waiting", "seq long, digest string", f"at long, n long, {self.payload}")  # n: equal rows

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self.last.update(tuple(initialState.iloc[0][c] for c in (p.split()[0] for p in self.state.split(", "))))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            names = [p.split()[0] for p in self.payload.split(", ")]
            values = part[names].astype(object).where(part[names].notna(), None)
            for seq, digest, at, payload in zip(part["seq"], part["digest"], part["at_ms"], values.itertuples(index=False, name=None)):
                spot, at = (int(seq), digest), int(at)
                had = tuple(self.waiting.getValue(spot))[:2] if self.waiting.containsKey(spot) else (at, 0)
                self.waiting.updateValue(spot, (max(had[0], at), had[1] + 1, *(int(x) if isinstance(x, float) else x for x in payload)))
                first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(((tuple(k), tuple(v)) for k, v in self.waiting.iterator()), key=lambda r: r[0])
        upto = max((k for k, v in rows if v[0] <= passed), default=None)
        out, state = [], tuple(self.last.get()) if self.last.exists() else self.start()
        left = None
        for k, v in rows:
            if upto is not None and k <= upto:
                for _ in range(v[1]):
                    state, told = self.step(state, k[0], v[2:])
                    out.append((key[0], k[0], *told))
                self.waiting.removeKey(k)
            else:
                left = v[0] if left is None else min(left, v[0])
        if out:
            self.last.update(state)
        if left is not None:
            self.handle.registerTimer(left)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class Chain(InOrder):
    state, payload, columns = "place long, last string", "action string, entity string, ts string", ["owner", "seq", "place", "hash"]

    def start(self) -> tuple:
        return 0, GENESIS

    def step(self, state: tuple, seq: int, payload: tuple) -> tuple[tuple, tuple]:
        place, last = state[0] + 1, link(state[1], *payload)
        return (place, last), (place, last)


class Budget(InOrder):
    state, payload, columns = "spent long", "cost long", ["owner", "seq", "cost", "spent_before", "refused"]

    def __init__(self, gate: int):
        self.gate = gate

    def start(self) -> tuple:
        return (0,)

    def step(self, state: tuple, seq: int, payload: tuple) -> tuple[tuple, tuple]:
        cost = int(payload[0] or 0)
        return (state[0] + cost,), (cost, state[0], state[0] >= self.gate)


def _ordered(rows: DataFrame, digest, processor: InOrder, schema: str, delay: str, initial: DataFrame | None) -> DataFrame:
    marked = rows.withWatermark("at", delay).withColumns({"digest": digest, "at_ms": F.unix_millis("at")})
    start = initial.groupBy("owner") if initial is not None else None
    return marked.groupBy("owner").transformWithStateInPandas(processor, schema, "Append", "EventTime", start)


def chained(events: DataFrame, delay: str = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """A stream of events (owner, seq, action, entity, ts text, at timestamp): owner, seq, place in the chain, hash. initial: owner, place, last.

    The session's state store must be RocksDB's (use_state_store()).
    """
    return _ordered(events, event_digest("action", "entity", "ts"), Chain(), CHAINED, delay, initial)


def budget(calls: DataFrame, limit: int, share: float = 0.9, delay: str = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """A stream of calls (owner, seq, cost, at timestamp): what the owner had spent before each, and whether it is refused. initial: owner, spent."""
    return _ordered(calls, event_digest("cost"), Budget(int(limit * share)), GATED, delay, initial)


def use_state_store(spark) -> None:
    """Keeps state in RocksDB, which maps and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
