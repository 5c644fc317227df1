"""Competing consumers: one delivery each, acknowledgements, redelivery by logical time.

A group is a state machine for each shard. Its input is an ordered script of appends,
polls and acks; ticks are logical, never wall-clock. In a stream the state lives in
the state store, keyed by shard.
"""

from __future__ import annotations

import bisect
import heapq
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.functions.subjects import filter_pattern
from tidelog.session import ship

SCRIPT = "shard int, tick long, kind string, seq long, subject string, member string"
DELIVERIES = "shard int, tick long, member string, seq long, redelivered boolean"
_STATE = "pending array<long>, seqs array<long>, members array<string>, deadlines array<long>, again array<boolean>, frontier long"


@dataclass
class Group:
    """Records to hand out, and those handed out and not acknowledged.

    Expired deliveries are found by two heaps, of deadlines and of what is due, whose
    stale entries are dropped when they come up: a poll costs the logarithm of what is in
    flight.
    """

    ack_wait: int
    pending: deque[int] = field(default_factory=deque)
    inflight: dict[int, tuple[str, int, bool]] = field(default_factory=dict)  # seq -> member, deadline, redelivered
    frontier: int = 0
    _deadlines: list[tuple[int, int]] = field(default_factory=list)  # (deadline, seq)
    _due: list[int] = field(default_factory=list)
    _order: list[int] = field(default_factory=list)  # in flight, ascending, with those that are gone

    def __post_init__(self):
        self.pending = deque(self.pending)
        self._deadlines = sorted((v[1], s) for s, v in self.inflight.items())
        self._order = sorted(self.inflight)

    def append(self, seq: int) -> None:
        self.pending.append(seq)
        self.frontier = max(self.frontier, seq)

    def _deliver(self, seq: int, member: str, now: int, again: bool) -> tuple[int, bool]:
        if seq not in self.inflight:
            if self._order and seq < self._order[-1]:
                at = bisect.bisect_left(self._order, seq)
                if self._order[at] != seq:
                    self._order.insert(at, seq)
            elif not self._order or self._order[-1] != seq:
                self._order.append(seq)
        self.inflight[seq] = (member, now + self.ack_wait, again)
        heapq.heappush(self._deadlines, (now + self.ack_wait, seq))
        return seq, again

    def poll(self, member: str, now: int) -> tuple[int, bool] | None:
        """An expired delivery, lowest first, before anything fresh."""
        while self._deadlines and self._deadlines[0][0] <= now:
            deadline, seq = heapq.heappop(self._deadlines)
            if seq in self.inflight and self.inflight[seq][1] == deadline:
                heapq.heappush(self._due, seq)
        while self._due:
            seq = heapq.heappop(self._due)
            if seq in self.inflight and self.inflight[seq][1] <= now:
                return self._deliver(seq, member, now, True)
        return self._deliver(self.pending.popleft(), member, now, False) if self.pending else None

    def _lowest(self) -> int | None:
        drop = 0
        while drop < len(self._order) and self._order[drop] not in self.inflight:
            drop += 1
        if drop:
            del self._order[:drop]
        return self._order[0] if self._order else None

    def ack(self, seq: int | None) -> bool:
        """True if it was in flight; None acknowledges the lowest in flight."""
        if seq is None:
            seq = self._lowest()
        return self.inflight.pop(seq, None) is not None

    def nack(self, seq: int | None) -> bool:
        """Says whether it is in flight and changes nothing: the deadline brings the record back."""
        return (self._lowest() if seq is None else seq) in self.inflight

    def backlog(self) -> int:
        return len(self.pending) + len(self.inflight)

    def committed(self) -> int:
        lowest = min((x for x in (self._lowest(), self.pending[0] if self.pending else None) if x is not None), default=None)
        return self.frontier if lowest is None else max(lowest - 1, 0)

    def play(self, rows: Iterator[tuple]) -> list[tuple]:
        """(tick, member, seq, redelivered) of the polls among (tick, kind, seq, member) rows that delivered."""
        out = []
        for tick, kind, seq, member in rows:
            if kind == "append":
                self.append(int(seq))
            elif kind == "ack":
                self.ack(None if seq is None or pd.isna(seq) else int(seq))
            elif kind == "poll" and (got := self.poll(member, int(tick))):
                out.append((int(tick), member, *got))
            elif kind == "nack":
                self.nack(None if seq is None or pd.isna(seq) else int(seq))
        return out


def deliver(script: DataFrame, ack_wait: int, subject_filter: str | None = None) -> DataFrame:
    """Deliveries of a streaming script (see SCRIPT); with a filter only matching subjects are appended, so others stay invisible."""
    ship(script.sparkSession)
    pattern = None if subject_filter is None else filter_pattern(subject_filter)
    if pattern is not None:
        script = script.where((script["kind"] != "append") | script["subject"].rlike(pattern))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        group = Group(ack_wait)
        if state.exists:
            pending, seqs, members, deadlines, again, frontier = state.get
            group = Group(ack_wait, deque(pending), dict(zip(seqs, zip(members, deadlines, again, strict=True), strict=True)), frontier)
        rows = pd.concat(list(frames)).sort_values("tick", kind="stable")
        out = group.play(rows[["tick", "kind", "seq", "member"]].itertuples(index=False, name=None))
        flight = sorted(group.inflight.items())
        state.update((list(group.pending), [s for s, _ in flight], [v[0] for _, v in flight], [v[1] for _, v in flight], [v[2] for _, v in flight], group.frontier))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["shard", "tick", "member", "seq", "redelivered"])

    return script.groupBy("shard").applyInPandasWithState(step, DELIVERIES, _STATE, "append", GroupStateTimeout.NoTimeout)
