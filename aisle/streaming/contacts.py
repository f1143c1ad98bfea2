"""Contact lock and cooldown as rolling state of a live stream.

Requests to contact a member are decided in the order of their own times, however the
files that bring them fall into micro-batches: a request waits in the member's state until
the watermark has passed it. State is kept per member and ends by event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aisle.operators.marketing import CONTACT_STATES, DEFAULT_COOLDOWN_DAYS, DEFAULT_MAX_TRIGGERS

#: Times are whole microseconds.
DAY = 86_400_000_000
LOCK = DAY
#: Days for which executions count towards the cap of a member and campaign; a stream cannot remember for ever.
MEMORY_DAYS = 90

REQUEST = "at long, campaign_id long, contact boolean, execution boolean, cooldown int, most int"
SENT = "member_id long, campaign_id long, sent long"


def decide(pending: list[tuple], locked_until: int, history: dict[int, list[int]], memory: int) -> tuple[list[tuple], int]:
    """Of requests sorted by time the ones that go out, and the end of the member's lock; ``history`` takes their times in.

    A contact locks the member for 24 hours, its end included. Executions of a campaign count towards its cap, and the
    newest starts its cooldown.
    """
    sent = []
    for at, campaign, contact, execution, cooldown, most in pending:
        if execution:
            # An execution that another system reports: nothing to decide.
            history.setdefault(campaign, []).append(at)
            if contact:
                locked_until = max(locked_until, at + LOCK)
            continue
        known = [t for t in history.get(campaign, []) if t >= at - memory]
        if at <= locked_until or len(known) >= most or (known and max(known) > at - cooldown * DAY):
            continue
        history.setdefault(campaign, []).append(at)
        locked_until = max(locked_until, at + LOCK)
        sent.append((campaign, at))
    return sent, locked_until


class Contacts(StatefulProcessor):
    """State of a member: requests that wait, the end of the lock, times of executions by campaign."""

    def __init__(self, memory_days: int) -> None:
        self.memory = memory_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", REQUEST)
        self.locked = handle.getValueState("locked", "until long")
        self.history = handle.getMapState("history", "campaign_id long", "times array<long>")

    def _wake(self, at: int) -> None:
        """A timer for a time in microseconds; timers count milliseconds."""
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            waiting = list(frame[["at", "campaign_id", "contact", "execution", "cooldown", "most"]].itertuples(index=False, name=None))
            first = min([w[0] for w in waiting] + ([first] if first is not None else []))
            self.pending.appendList(waiting)
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.pending.get()) if self.pending.exists() else []
        due, left = [w for w in waiting if w[0] <= now], [w for w in waiting if w[0] > now]
        stored = {k[0]: list(v[0]) for k, v in self.history.iterator()}
        history = {c: list(times) for c, times in stored.items()}
        sent, until = decide(due, self.locked.get()[0] if self.locked.exists() else -1, history, self.memory)
        # What no later request can depend on goes.
        kept = {c: times for c, every in history.items() if (times := [t for t in every if t >= now - self.memory])}
        if due:
            self.pending.clear()
            if left:
                self.pending.put(left)
        for campaign in stored.keys() - kept.keys():
            self.history.removeKey((campaign,))
        for campaign, times in kept.items():
            if times != stored.get(campaign):
                self.history.updateValue((campaign,), (times,))
        if until >= now:
            self.locked.update((until,))
        else:
            self.locked.clear()
        # The next thing to happen: a request is due, or something has become too old.
        ends = [w[0] for w in left] + [min(t) + self.memory + 1000 for t in kept.values()] + ([until + 1000] if until >= now else [])
        if ends:
            self._wake(max(min(ends), now + 1000))
        if sent:
            yield pd.DataFrame({"member_id": key[0], "campaign_id": [c for c, _ in sent], "sent": [t for _, t in sent]})

    def close(self) -> None:
        pass


def contacts(
    requests: DataFrame, rules: DataFrame, executions: DataFrame | None = None, lateness: str = "10 minutes", memory_days: int = MEMORY_DAYS
) -> DataFrame:
    """Requests (member_id, campaign_id, asked_at) of a live stream that may go out (append mode).

    Rows (member_id, campaign_id, sent_at): nobody is contacted twice within 24 hours, by any campaign; a
    campaign keeps its cooldown and its cap per member (its active rule's, else the defaults).
    ``executions`` (member_id, campaign_id, sent_at, status) is a second stream, of what other systems sent.
    Requests of one moment are taken by campaign, executions first; one that comes later than
    ``lateness`` is dropped, and one is decided when the watermark has passed it. Rows without a
    member, campaign or time are ignored. A query on it needs the RocksDB state store, see ``feeds.run_available``.
    """
    number = lambda c: F.col(c).cast("long").alias(c)
    moment = lambda c: F.col(c).cast("timestamp").alias("event_time")
    asked = requests.select(number("member_id"), number("campaign_id"), moment("asked_at"), F.lit(True).alias("contact"), F.lit(False).alias("execution"))
    asked = asked.withWatermark("event_time", lateness)
    if executions is not None:
        reached = F.col("status").isin(CONTACT_STATES)
        known = executions.select(number("member_id"), number("campaign_id"), moment("sent_at"), F.coalesce(reached, F.lit(False)).alias("contact"), F.lit(True).alias("execution"))
        asked = asked.unionByName(known.withWatermark("event_time", lateness))
    limits = rules.where("is_active").groupBy(number("campaign_id")).agg(
        F.max("cooldown_days").alias("cooldown_days"), F.max("max_triggers_per_member").alias("max_triggers")
    )
    rows = asked.where("member_id IS NOT NULL AND campaign_id IS NOT NULL AND event_time IS NOT NULL").join(limits, "campaign_id", "left")
    rows = rows.select(
        "member_id", "event_time", F.unix_micros("event_time").alias("at"), "campaign_id", "contact", "execution",
        F.coalesce("cooldown_days", F.lit(DEFAULT_COOLDOWN_DAYS)).cast("int").alias("cooldown"),
        F.coalesce("max_triggers", F.lit(DEFAULT_MAX_TRIGGERS)).cast("int").alias("most"),
    )
    sent = rows.groupBy("member_id").transformWithStateInPandas(
        statefulProcessor=Contacts(memory_days), outputStructType=SENT, outputMode="Append", timeMode="EventTime"
    )
    return sent.select("member_id", "campaign_id", F.timestamp_micros("sent").alias("sent_at"))
