"""State of keyed streams: traces put together from their components, chains in order, newest status.

Each function is what ``applyInPandasWithState`` calls for a key: with its new rows, or
with none when the key's time has run out.  Times inside state are microseconds since
1970, so no session's time zone matters; lists are kept as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql.streaming.state import GroupState

Stateful = Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]
#: columns of a component that are kept until its trace is whole, and their types
PART = {
    "i": "int", "event_type": "string", "data": "string", "timestamp": "string", "component_type": "string", "trace_level": "string", "batch_id": "string",
    "signature_key_id": "string", "n_components": "int", "at": "long",
}


def _rows(frames: Iterator[pd.DataFrame], columns: list[str], kinds: dict[str, str]) -> list[list]:
    """Rows of all frames, missing values as None, whole numbers as int."""
    out = []
    for frame in frames:
        plain = frame[columns].astype(object)
        plain = plain.where(plain.notna(), None)
        whole = [kinds.get(c) in ("int", "long") for c in columns]
        out += [[int(x) if w and x is not None else x for x, w in zip(r, whole, strict=True)] for r in plain.itertuples(index=False, name=None)]
    return out


def _wake(state: GroupState, ms: int) -> None:
    """The key is called again once the watermark has passed ``ms``."""
    state.setTimeoutTimestamp(max(ms, state.getCurrentWatermarkMs() + 1))


def assemble(columns: list[str], wait_ms: int) -> Stateful:
    """Components of one trace, handed on together; the state is (parts, until).

    A trace ends when as many different components have come as it says it has, or, if
    none comes for ``wait_ms`` of event time, with what there is.  Whoever comes again
    until then is not a new trace.
    """
    number, expected, at = (columns.index(c) for c in ("i", "n_components", "at"))

    def ended(key: tuple, parts: list[list], until: int, state: GroupState) -> pd.DataFrame:
        state.update(("[]", until))
        _wake(state, until)
        out = pd.DataFrame(sorted(parts, key=lambda r: r[number]), columns=columns, dtype=object)
        out.insert(0, "trace_id", key[0])
        return out

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, until = state.get if state.exists else ("[]", None)
        if state.hasTimedOut:
            parts = json.loads(text)
            if until is None and parts:
                yield ended(key, parts, state.getCurrentWatermarkMs() + wait_ms, state)
            else:
                state.remove()
            return
        came = _rows(frames, columns, PART)
        if until is not None:
            _wake(state, until)
            return
        held = {r[number]: r for r in json.loads(text)}
        for r in came:
            held.setdefault(r[number], r)
        parts = list(held.values())
        wanted = [r[expected] for r in parts if r[expected] is not None]
        newest = max(r[at] for r in came + parts) // 1000
        if wanted and len(parts) >= max(wanted):
            yield ended(key, parts, newest + wait_ms, state)
        else:
            state.update((json.dumps(parts), None))
            _wake(state, newest + wait_ms)

    return run


def chain_gaps(idle_ms: int) -> Stateful:
    """Breaks of one agent's audit chain; the state is (last number, waiting rows).

    Rows wait until the watermark has passed them, so one that comes late makes no gap;
    what the watermark has passed is compared in the order of its numbers.  The last
    number is forgotten when the agent has been silent for ``idle_ms`` of event time.
    """
    columns, kinds = ["seq", "trace_id", "at"], {"seq": "long", "at": "long"}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, text = state.get if state.exists else (None, "[]")
        waiting, now = json.loads(text), state.getCurrentWatermarkMs()
        if state.hasTimedOut and not waiting:
            state.remove()
            return
        waiting += [] if state.hasTimedOut else _rows(frames, columns, kinds)
        ready, later = ([r for r in waiting if (r[2] // 1000 < now) == passed] for passed in (True, False))
        out = []
        for seq, trace, _ in sorted(ready):
            if last is not None and seq - last != 1:
                out.append((key[0], trace, last, seq, seq - last))
            last = seq
        state.update((last, json.dumps(later)))
        _wake(state, min(r[2] for r in later) // 1000 + 1 if later else now + idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["agent_id_hash", "trace_id", "prev_seq", "seq", "gap"])

    return run


def newest_status(keep_ms: int) -> Stateful:
    """The newest check of one service, the state; a row is handed on only when a newer one has come.

    State goes when no check has come for ``keep_ms`` of event time.
    """
    columns, kinds = ["at", "event_id", "status", "latency_ms"], {"at": "long", "event_id": "long"}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = max(_rows(frames, columns, kinds), key=lambda r: r[:2])
        known = tuple(state.get) if state.exists else None
        newer = known is None or tuple(best[:2]) > known
        state.update(tuple(best[:2]) if newer else known)
        _wake(state, state.get[0] // 1000 + keep_ms)
        if newer:
            yield pd.DataFrame([(*key, best[2], best[3], best[0], best[1])], columns=["region", "service", "provider", "status", "latency_ms", "at", "event_id"])

    return run
