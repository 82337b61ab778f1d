"""Live manifests as a keyed stream: snapshots and patch documents update a state per manifest.

The input stream has ``mpd_id, kind, publish_time, original_publish_time, body, ts``: kind ``mpd`` is a whole manifest (JSON)
that replaces the state, kind ``patch`` a JSON patch document's operations.  A patch applies when its original publish time
is that of the state (both as instants, whatever their spelling or offset); one that is early waits (``held``) until its predecessor has come, one that is not newer than the state
is a repeat and is dropped.  A patch that fails leaves the state and its time as they are; only a whole manifest goes on from
there.  What waits is forgotten with the state.  State not touched for ``ttl`` of event time is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.operators.convert import dumps, model, read_json
from sluice.operators.patchdoc import apply_patch
from sluice.schema.xsd import Schema
from sluice.session import ship

OUT = "mpd_id string, publish_time string, json string, applied int, held int, dropped int, error string"
STATE = "publish_time string, json string, held string"


def moment(text: str | None) -> str:
    """An instant in one spelling; a time without zone is UTC, and what is no time stays as it is."""
    try:
        t = datetime.fromisoformat((text or "").strip().upper())
    except ValueError:
        return text or ""
    return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def step(state: tuple[str | None, str | None, str], rows: list[dict], schema: Schema) -> tuple[tuple, tuple[int, int, str | None]]:
    """The next state and (applied, dropped, last error) from new rows in any order."""
    now, text, waiting = state
    doc = read_json(text) if text else None
    held: dict[str, Any] = read_json(waiting) if waiting else {}
    applied = dropped = 0
    error: str | None = None
    for r in sorted(rows, key=lambda r: (r["kind"] != "mpd", moment(r["publish_time"]))):
        at = moment(r["publish_time"])
        try:
            body = read_json(r["body"] or "")
        except ValueError as e:
            error, dropped = str(e), dropped + 1
            continue
        if r["kind"] == "mpd":
            if now is None or at >= now:
                doc, now = body, at
            else:
                dropped += 1
        elif now is not None and at <= now:
            dropped += 1
        else:
            held[moment(r["original_publish_time"])] = [at, body]
    while now is not None and now in held:
        later, ops = held.pop(now)
        doc, _, why = apply_patch(doc, ops, schema)
        if why is not None:
            error, dropped = why, dropped + 1
            break
        applied, now = applied + 1, later
    held = {k: v for k, v in held.items() if now is None or v[0] > now}
    return (now, None if doc is None else dumps(doc), dumps(held)), (applied, dropped, error)


def live_state(stream: DataFrame, schema: Schema | None = None, ttl: str | None = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Updates of the state of each manifest; works on a stream, and on a batch as one update."""
    ship(stream.sparkSession)
    types = schema or model()
    seconds = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else 0

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows: list[dict] = [r for f in frames for r in f.to_dict("records")]
        old = state.get if state.exists else (None, None, "")
        new, (applied, dropped, error) = step(tuple(old), rows, types)
        state.update(new)
        if seconds and state.getCurrentWatermarkMs() > 0:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + seconds)
        yield pd.DataFrame([{"mpd_id": key[0], "publish_time": new[0], "json": new[1], "applied": applied, "held": len(read_json(new[2])), "dropped": dropped, "error": error}])

    keyed = stream.withWatermark("ts", watermark).groupBy("mpd_id")
    return keyed.applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout if ttl else GroupStateTimeout.NoTimeout)
