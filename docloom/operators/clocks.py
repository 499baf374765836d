"""Logical clocks: ids of (session, time), spans of ids, and clock vectors.

Ids order by time and then by session. The Column forms take columns of sessions and times, so
containment and rebasing stay in the plan; vectors are small and live with one document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The server's session, and the largest session that a server's clock takes.
SERVER, LAST_SERVER_SESSION = 1, 8


def tick(at: list[int], cycles: int) -> list[int]:
    """The id ``cycles`` later."""
    return [at[0], at[1] + cycles]


def interval(at: list[int], offset: int, span: int) -> list[int]:
    """The span of ids [session, time, length] that starts ``offset`` later."""
    return [at[0], at[1] + offset, span]


def equal(a: list[int], b: list[int]) -> bool:
    return a[:2] == b[:2]


def compare(a: list[int], b: list[int]) -> int:
    """1, 0 or -1 by time, then session."""
    x, y = (a[1], a[0]), (b[1], b[0])
    return (x > y) - (x < y)


def contains(outer: list[int], inner: list[int]) -> bool:
    """Whether a span [session, time, length] holds all of another."""
    return outer[0] == inner[0] and outer[1] <= inner[1] and outer[1] + outer[2] >= inner[1] + inner[2]


def contains_id(outer: list[int], at: list[int]) -> bool:
    return contains(outer, [at[0], at[1], 1])


def print_ts(at: list[int]) -> str:
    """``.time`` for the server, else the session's last four digits and the time."""
    if at[0] == SERVER:
        return f".{at[1]}"
    session = str(at[0])
    return f"{'..' + session[-4:] if len(session) > 4 else session}.{at[1]}"


def compare_columns(a_sid: Column, a_time: Column, b_sid: Column, b_time: Column) -> Column:
    a, b = F.struct(a_time.alias("t"), a_sid.alias("s")), F.struct(b_time.alias("t"), b_sid.alias("s"))
    return F.when(a > b, 1).when(a < b, -1).otherwise(0)


def contains_columns(sid: Column, time: Column, span: Column, in_sid: Column, in_time: Column, in_span: Column) -> Column:
    """A range predicate: whether one span holds all of another."""
    return (sid == in_sid) & (time <= in_time) & (time + span >= in_time + in_span)


class ClockError(ValueError):
    """An id that a clock does not take."""


@dataclass
class ClockVector:
    """One session's next time, and the last time seen of each other session."""

    sid: int
    time: int = 1
    peers: dict[int, int] = field(default_factory=dict)

    def tick(self, cycles: int = 1) -> list[int]:
        """The next id; the clock moves behind the ``cycles`` it takes."""
        at = [self.sid, self.time]
        self.time += cycles
        return at

    def observe(self, at: list[int], span: int = 1) -> None:
        end = at[1] + span
        if at[0] != self.sid:
            self.peers[at[0]] = max(self.peers.get(at[0], 0), end - 1)
        self.time = max(self.time, end)

    def fork(self, sid: int) -> ClockVector:
        """A clock of another session that has seen what this one has, its own ids included."""
        own = ClockVector(sid, self.time)
        if sid != self.sid and self.time > 0:
            own.observe([self.sid, self.time - 1])
        for peer, time in self.peers.items():
            own.observe([peer, time])
        return own


@dataclass
class ServerClockVector:
    """The clock of a document that a server orders."""

    time: int = 1
    sid: int = SERVER

    def tick(self, cycles: int = 1) -> list[int]:
        at = [self.sid, self.time]
        self.time += cycles
        return at

    def observe(self, at: list[int], span: int = 1) -> None:
        if at[0] > LAST_SERVER_SESSION:
            raise ClockError("INVALID_SERVER_SESSION")
        if at[1] > self.time:
            raise ClockError("TIME_TRAVEL")
        self.time = max(self.time, at[1] + span)

    def fork(self) -> ServerClockVector:
        return ServerClockVector(self.time)


def server_check(sid: Column, time: Column, clock: Column) -> Column:
    """The server clock's error for an id, or NULL."""
    return F.when(sid > LAST_SERVER_SESSION, "INVALID_SERVER_SESSION").when(time > clock, "TIME_TRAVEL")
