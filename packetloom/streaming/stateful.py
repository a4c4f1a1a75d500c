"""Structured Streaming forms of the keyed state machines.

State for a key is a few numbers. Within a micro-batch a key's rows are put in order of
arrival number; a source that hands them over in order across batches (one capture
file after the other) gives the same rows as the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.operators.anchored import Anchor
from packetloom.operators.flows import KEY
from packetloom.operators.reassembly import CLIENT, SERVER


def anchored_windows(events: DataFrame, keys: list[str], order: str, ts: str, width: int, event_time: str = "event_time", lateness: str = "0 seconds") -> DataFrame:
    """Streaming :func:`operators.anchored.anchored_windows`: key, order, win_no, win_start, win_count, elapsed.

    A window that the watermark has passed by ``width`` seconds takes no more events, so its state
    goes: the key's next event opens a window in any case, and ``win_no`` counts from 0
    again. ``event_time`` is the timestamp of the seconds ``ts``.
    """
    kinds = dict(events.dtypes)
    lead = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    names = [*keys, order, "win_no", "win_start", "win_count", "elapsed"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=names)
            return
        anchor = Anchor(width)
        if state.exists:
            anchor.number, anchor.start, anchor.count = state.get
        rows = sorted(row for part in parts for row in zip(part[order], part[ts], strict=True))
        out = []
        for at, now in rows:
            number, start, count, elapsed = anchor.event(int(now))
            out.append((*key, at, number, start, count, elapsed))
        state.update((anchor.number, anchor.start, anchor.count))
        state.setTimeoutTimestamp(max((anchor.start + width + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    schema = f"{lead}, `{order}` {kinds[order]}, win_no long, win_start long, win_count long, elapsed long"
    marked = events.withWatermark(event_time, lateness)
    return marked.groupBy(*keys).applyInPandasWithState(run, schema, "win_no long, win_start long, win_count long", "append", GroupStateTimeout.EventTimeTimeout)


def modbus_pairs(units: DataFrame, within: int = 10, lateness: str = "0 seconds") -> DataFrame:
    """Requests and their responses of a stream of Modbus units, a join of the stream with itself.

    ``units``: the flow key, ``began``, ``event_time``, ``direction``, ``txn``, ``unit`` and ``fc``. A response belongs to
    a request of its flow, transaction and unit that is at most ``within`` seconds older; an
    exception only to one of its own code. A request without one comes out, with nulls, when the
    watermark has passed; until then it is state. Requests under one number are all paired,
    where the batch operator keeps the last.
    """
    keys = [*KEY, "began", "txn", "unit"]
    marked = units.withWatermark("event_time", lateness)
    asked = marked.where((F.col("direction") == CLIENT) & (F.col("fc") < 0x80)).select(*keys, F.col("fc").alias("request_fc"), F.col("event_time").alias("asked"))
    said = marked.where(F.col("direction") == SERVER).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("fc").alias("response_fc"), F.col("event_time").alias("answered"))
    same = (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {within} SECONDS"))
    same = same & ((F.col("response_fc") < 0x80) | (F.col("response_fc") - 0x80 == F.col("request_fc")))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    paired = asked.join(said, same, "leftOuter")
    return paired.select(*keys, "request_fc", "response_fc", "asked", (F.unix_seconds("answered") - F.unix_seconds("asked")).alias("seconds"))


def flow_sessions(packets: DataFrame, keys: list[str], timeout: int = 300, lateness: str = "0 seconds") -> DataFrame:
    """Closed flows of a stream of TCP packets: keys, first_seen, last_seen, packets, close_reason.

    ``packets``: ``keys``, ``order`` (long), ``event_time`` (timestamp), ``fin``, ``rst``. A flow ends
    with a reset, two FINs, or when the watermark passes ``timeout`` seconds behind its last packet.
    """
    kinds = dict(packets.dtypes)
    lead = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    names = [*keys, "first_seen", "last_seen", "packets", "close_reason"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        first, last, n, fins = state.get if state.exists else (None, None, 0, 0)
        if state.hasTimedOut:
            out.append((*key, first, last, n, "Timeout"))
            state.remove()
        else:
            rows = pd.concat(parts).sort_values("order")
            for now, fin, rst in zip(rows["event_time"].astype("int64") // 10**9, rows["fin"], rows["rst"], strict=True):
                now = int(now)
                if n and now - last > timeout:
                    out.append((*key, first, last, n, "Timeout"))
                    n = fins = 0
                first, last = (now if not n else first), now
                n, fins = n + 1, fins + int(fin and not rst)
                if rst or fins >= 2:
                    out.append((*key, first, last, n, "Rst" if rst else "Fin"))
                    n = fins = 0
            if n:
                state.update((first, last, n, fins))
                state.setTimeoutTimestamp(max((last + timeout) * 1000, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=names)

    schema = f"{lead}, first_seen long, last_seen long, packets long, close_reason string"
    marked = packets.withWatermark("event_time", lateness)
    return marked.groupBy(*keys).applyInPandasWithState(run, schema, "first long, last long, n long, fins long", "append", GroupStateTimeout.EventTimeTimeout)


def alerts(windows: DataFrame, threshold: int) -> DataFrame:
    """Rows at which a window's count passes ``threshold``: once for each window, with no more state."""
    return windows.where(F.col("win_count") == threshold + 1)
