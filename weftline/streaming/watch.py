"""Watching: a keyed state machine over run results, as a stream or a fold.

Each result (spec, ts, ok, cause, healed, unhealed, drift) moves its spec's
state; an event goes out when the condition differs from the one last told.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "spec string, ts string, ok boolean, cause string, healed array<string>, unhealed array<string>, drift array<string>"
EVENT = "spec string, ts string, event string, condition string, cause string, failures int, cooldown int, since string"


@dataclass
class State:
    condition: str = ""
    cause: str = ""
    since: str = ""
    last_run: str = ""
    failures: int = 0
    cooldown: int = 0
    told: str = ""


def condition_of(ok: bool, cause: str, unhealed: list[str], drift: list[str]) -> str:
    if cause == "ERROR":
        return "ERROR"
    if ok:
        return "drift:" + ",".join(sorted(drift)) if drift else "ok"
    return f"{cause}:{','.join(sorted(unhealed)) or '-'}"


def event_for(ok: bool, cause: str, healed: list[str], unhealed: list[str], drift: list[str], before: str | None) -> str | None:
    if cause == "ERROR":  # the run itself failed: counted, not told
        return None
    if ok:
        if healed:
            return "repaired"
        if drift:
            return "drift"
        return "recovered" if before and before != "ok" and not before.startswith("drift") else None
    if cause == "BLOCKED":
        return "blocked"
    return "unrepaired" if unhealed and not healed else "broken"


def cooldown_for(failures: int, cause: str) -> int:
    """Cycles to rest: 2, 4, 8 when blocked; one to four after the fourth failure in a row."""
    if cause == "BLOCKED":
        return min(8, 2 ** min(failures, 3))
    return min(4, failures - 3) if failures >= 4 else 0


def advance(state: State | None, r: dict) -> tuple[State, dict | None]:
    """The next state, and the event to send, if any. A resting spec only counts down."""
    healed, unhealed, drift = (list(r[k]) if r.get(k) is not None else [] for k in ("healed", "unhealed", "drift"))
    s = state or State()
    if s.cooldown > 0:
        return State(**(asdict(s) | {"cooldown": s.cooldown - 1})), None
    now = condition_of(r["ok"], r["cause"], unhealed, drift)
    event = event_for(r["ok"], r["cause"], healed, unhealed, drift, s.condition or None)
    failures = 0 if r["ok"] else s.failures + 1
    rest = 0 if r["ok"] else cooldown_for(failures, r["cause"])
    # Told once: what was told stays so until another condition is told.
    send = event is not None and now != s.told
    out = State(now, r["cause"], r["ts"] if now != s.condition else s.since, r["ts"], failures, rest, now if send else s.told)
    if not send:
        return out, None
    return out, {"spec": r["spec"], "ts": r["ts"], "event": event, "condition": now, "cause": r["cause"], "failures": failures, "cooldown": rest, "since": out.since}


class Watcher(StatefulProcessor):
    """Value state per spec."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("watch", "doc string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        s = State(**json.loads(self.state.get()[0])) if self.state.exists() else None
        sent = []
        for pdf in rows:
            for r in pdf.sort_values("ts").to_dict("records"):
                s, event = advance(s, r)
                if event:
                    sent.append(event)
        self.state.update((json.dumps(asdict(s)),))
        if sent:
            yield pd.DataFrame(sent)

    def close(self) -> None:
        pass


def watch_stream(results: DataFrame) -> DataFrame:
    """Events of a stream of results; the state survives restarts in the query's checkpoint."""
    return results.groupBy("spec").transformWithStateInPandas(Watcher(), outputStructType=EVENT, outputMode="Append", timeMode="None")


def watch_fold(results: DataFrame) -> DataFrame:
    """The same over a finished table: each spec's results in order of time."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        s, sent = None, []
        for r in pdf.sort_values("ts").to_dict("records"):
            s, event = advance(s, r)
            if event:
                sent.append(event)
        return pd.DataFrame(sent, columns=[c.split()[0] for c in EVENT.split(", ")])

    return results.groupBy("spec").applyInPandas(fold, EVENT)


def cycle_report(entries: DataFrame) -> DataFrame:
    """Counts of a cycle: specs, ok, broken, repaired, resting."""
    return entries.agg(
        F.count("*").alias("specs"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("broken"), F.count_if(F.size("healed") > 0).alias("repaired")
    )


def run_watch(results: DataFrame, on_events, checkpoint: str, period: str | None = None):
    """Starts the stream: every ``period``, or once over what is there. ``on_events`` gets (events, batch id)."""
    writer = watch_stream(results).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(on_events)
    return (writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)).start()
