"""Streams: observations into the snapshot, price changes, quotas, page dedup."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

CHANGES = "source string, url string, old_price long, new_price long, observed_at long, kind string"
STATE = "keys binary"
#: Groups of keys. One call reads a group's rows and its keys' state, so that what a call costs is shared by its keys.
GROUPS = 4096


def price_changes(observations: DataFrame, late: str = "1 hour", stale_ms: int | None = None, groups: int = GROUPS) -> DataFrame:
    """observations: source, url, price, observed_at. Emits an event for a new key, for each price that differs from
    the last known, and, with stale_ms, for keys not seen for so long in event time. A late row never overwrites a newer one.
    Keys are dealt to `groups` by a hash, which has to stay the same for a stream's checkpoint; a group's state is all its keys'."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # (source, url) to (price, when seen first and last in microseconds, when it is stale in milliseconds)
        known: dict[tuple, tuple] = pickle.loads(state.get[0]) if state.exists else {}
        out, seen = [], set()
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values("__at", kind="stable")
            plain = lambda c: rows[c].astype(object).where(rows[c].notna(), None).tolist()
            for source, url, now, at in zip(plain("source"), plain("url"), plain("price"), plain("__at"), strict=True):
                own = source, url
                now, at = None if now is None else int(now), None if at is None else int(at)
                price, first, last, _ = known.get(own, (None, None, None, None))
                seen.add(own)
                if last is not None and at is not None and at <= last:
                    known[own] = price, at if first is None else min(first, at), last, None
                    continue
                if own not in known:
                    out.append((*own, None, now, at, "new"))
                elif now is not None and price is not None and now != price:
                    out.append((*own, price, now, at, "changed"))
                known[own] = now if now is not None else price, at if first is None else first, last if at is None else at, None
        if stale_ms:
            mark = state.getCurrentWatermarkMs()
            for own in seen:
                price, first, last, _ = known[own]
                known[own] = price, first, last, max((last or 0) // 1000 + stale_ms, mark + 1)
            for own in [k for k, v in known.items() if v[3] < mark]:
                price, _, last, _ = known.pop(own)
                out.append((*own, price, None, last, "stale"))
        if known:
            state.update((pickle.dumps(known),))
            if stale_ms:
                state.setTimeoutTimestamp(max(min(v[3] for v in known.values()), mark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")]).astype({c: "Int64" for c in ("old_price", "new_price", "observed_at")})

    timeout = GroupStateTimeout.EventTimeTimeout if stale_ms else GroupStateTimeout.NoTimeout
    rows = observations.withWatermark("observed_at", late).select(F.pmod(F.xxhash64("source", "url"), F.lit(groups)).alias("group"), "source", "url", F.col("price").cast("long").alias("price"), "observed_at", F.unix_micros("observed_at").alias("__at"))
    return rows.groupBy("group").applyInPandasWithState(step, CHANGES, STATE, "append", timeout).withColumn("observed_at", F.timestamp_micros("observed_at"))


def daily_quota(events: DataFrame, limit: int = 10, late: str = "1 day") -> DataFrame:
    """user_id, ts: requests per user and day."""
    day = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return day.select(F.to_date("window.start").alias("day"), "user_id", "n", (F.col("n") > limit).alias("over_quota"))


def fresh_pages(pages: DataFrame, life: str = "1 hour") -> DataFrame:
    """url, fetched_at: the first copy of a URL within its lifetime."""
    return pages.withWatermark("fetched_at", life).dropDuplicatesWithinWatermark(["url"])


SNAPSHOT = "source string, url string, price long, observed_at timestamp, first_seen timestamp, is_new boolean, price_changed boolean, prev_price long, seen boolean"


def merge_batches(path: str):
    """A foreachBatch function that merges each run into the versioned snapshot at path (`sources.versions`). A batch that is
    repeated after a failure is merged once; what a failed write leaves is never read."""
    from ..operators.snapshot import merge
    from ..sources.versions import Snapshots

    def one(batch: DataFrame, batch_id: int) -> None:
        kept = Snapshots(batch.sparkSession, path)
        rows = batch.groupBy("source", "url").agg(F.max_by(F.struct("price", "observed_at"), "observed_at").alias("r")).select("source", "url", "r.price", "r.observed_at")
        merged = merge(kept.read(SNAPSHOT).select("source", "url", "price", "observed_at", "first_seen"), rows, F.col("observed_at"))
        kept.commit(merged, batch_id)

    return one


def progress(df: DataFrame, name: str = "progress", sources: tuple[str, ...] = ()) -> DataFrame:
    """Rows and priced rows, of all and of each of `sources`, observed while the query runs; a ProgressLog gathers them."""
    own = [(F.count_if(F.col("source") == s).alias(f"rows:{s}"), F.count_if((F.col("source") == s) & F.col("price").isNotNull()).alias(f"priced:{s}")) for s in sources]
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count("price").alias("priced"), *(c for pair in own for c in pair))


class ProgressLog(StreamingQueryListener):
    """What progress() observes, batch by batch: add it by spark.streams.addListener. batches: (query id, batch id, metrics)."""

    def __init__(self, name: str = "progress"):
        self.name, self.batches, self.ended = name, [], set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if (seen := event.progress.observedMetrics.get(self.name)) is not None:
            self.batches.append((str(event.progress.id), event.progress.batchId, seen.asDict()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))

    def totals(self, query: str) -> dict[str, int]:
        """Sums over a query's batches; a batch that was repeated counts once."""
        last = {batch: seen for own, batch, seen in self.batches if own == query}
        return {k: sum(seen[k] for seen in last.values()) for k in next(iter(last.values()), {})}
