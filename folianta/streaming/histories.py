"""Histories that undo and redo: a document's revisions and a reader's views, folded event after event.

The same machine runs over a table and over a stream. Over a table, rows are dealt out by key and sorted, and a task folds them as they come by, holding the state of one key only, so a key
of any length needs no more memory than its bounded history. Over a stream, the state of a key lies in Spark's state store and goes on from the checkpoint after a restart.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()


def _fields(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, k) for n, k in kinds.items()]


@dataclass(frozen=True)
class Machine:
    """``step`` takes a state (plain lists and numbers, None at first) and an event and gives the next state and a row of ``shows``; it reads the columns ``takes`` of an event."""

    step: Callable[[dict | None, dict], tuple[dict, dict]]
    takes: tuple[str, ...]
    shows: tuple[T.StructField, ...]


def revisions(max_entries: int = 20, max_bytes: int = 256 * 1024 * 1024) -> Machine:
    """A document's revisions as a line of (id, bytes, digest) with a cursor.

    Events have an action: ``seed`` (a new line), ``record`` or ``adopt`` (a revision after the cursor; what could be redone goes), ``undo``, ``redo``, ``undo_failed``, ``redo_failed`` (take
    the move back), ``saved``, ``unsaved``, ``clear``. A revision made on another base than the cursor's is an error and changes nothing, one with the same bytes changes nothing. At most
    ``max_entries`` revisions can be undone, and old ones go when all, with the one recorded over counted twice, have more than ``max_bytes``. A revision without an id gets the next number.
    Shown are the cursor's revision, whether the action moved or recorded anything, whether undo and redo are possible, whether the cursor is at what was saved, and the error.
    """
    limit, most = max(1, max_entries), max(1, max_bytes)

    def step(state: dict | None, e: dict) -> tuple[dict, dict]:
        s = state or {"line": [], "at": -1, "saved": None, "n": 0}
        line, at, saved, n, error = s["line"], s["at"], s["saved"], s["n"], None
        before, action, here = (at, n), e["action"], line[at] if s["at"] >= 0 else None
        new = None
        if action == "seed" or (action in ("record", "adopt") and here is None):
            n += 1
            line, at = [[e["revision_id"] or f"revision-{n}", e["bytes"] or 0, e["digest"]]], 0
            saved = line[0][0]
        elif action in ("record", "adopt"):
            if e["base_id"] and e["base_id"] != here[0]:
                error = "stale base"
            elif (e["bytes"] or 0, e["digest"]) != (here[1], here[2]):
                n += 1
                new = [e["revision_id"] or f"revision-{n}", e["bytes"] or 0, e["digest"]]
        elif action in ("undo", "redo_failed"):
            at -= at > 0
        elif action in ("redo", "undo_failed"):
            at += at + 1 < len(line)
        elif action == "saved":
            saved = here[0] if here else None
        elif action == "unsaved":
            saved = None
        elif action == "clear":
            line, at, saved = [], -1, None
        if new:
            held, over = line[: at + 1], here[1] + sum(r[1] for r in line)
            held = held[max(0, len(held) - limit) :]
            over -= sum(r[1] for r in line[: at + 1]) - sum(r[1] for r in held)
            while held and over > most:
                over -= held[0][1]
                held = held[1:]
            line, at = [*held, new], len(held)
        now = line[at] if at >= 0 else None
        shown = {"revision": now[0] if now else None, "moved": (at, n) != before, "can_undo": at > 0, "can_redo": at + 1 < len(line), "at_saved": bool(now) and now[0] == saved, "kept": len(line), "error": error}
        return {"line": line, "at": at, "saved": saved, "n": n}, shown

    return Machine(step, ("action", "revision_id", "base_id", "bytes", "digest"), tuple(_fields(revision=_S, moved=_B, can_undo=_B, can_redo=_B, at_saved=_B, kept=_L, error=_S)))


def views(limit: int = 100) -> Machine:
    """A reader's way through pages: ``record`` (the page that a jump leaves), ``previous`` and ``next`` (from the page shown, ``page``, in a document of ``pages``), ``clear``.

    At most ``limit`` pages can be gone back to; a page isn't recorded twice in a row; a new jump clears what is ahead; pages that are gone and the one shown are skipped; without a page nothing moves. Shown is the page to go to.
    """

    def step(state: dict | None, e: dict) -> tuple[dict, dict]:
        back, ahead = (list(state["back"]), list(state["ahead"])) if state else ([], [])
        to, page = None, e["page"]
        if e["action"] == "record" and page is not None and page >= 1:
            back, ahead = (back if back[-1:] == [page] else [*back, page])[-limit:], []
        elif e["action"] in ("previous", "next") and page is not None and e["pages"] is not None:
            source, sink = (back, ahead) if e["action"] == "previous" else (ahead, back)
            while source and to is None:
                found = source.pop()
                to = None if found > e["pages"] or found == page else found
            if to is not None:
                sink.append(page)
        elif e["action"] == "clear":
            back, ahead = [], []
        return {"back": back, "ahead": ahead}, {"to": to, "n_back": len(back), "n_ahead": len(ahead)}

    return Machine(step, ("action", "page", "pages"), tuple(_fields(to=_L, n_back=_L, n_ahead=_L)))


def replay(events: DataFrame, machine: Machine, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """(key, order, what the machine shows) for each row of a table."""
    schema = T.StructType([events.schema[key], events.schema[order], *machine.shows])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, state, begun = None, None, False
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                if not begun or e[key] != owner:
                    owner, state, begun = e[key], None, True
                state, shown = machine.step(state, e)
                out.append(shown)
            shown = [pa.array([o[f.name] for o in out], {_L: pa.int64(), _S: pa.string(), _B: pa.bool_()}[f.dataType]) for f in machine.shows]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(order), *shown], schema.names)

    return events.select(key, order, *machine.takes).repartition(key).sortWithinPartitions(key, order).mapInArrow(fold, schema)


class _Keeper(StatefulProcessor):
    """One machine a key, its state in the state store."""

    def __init__(self, machine: Machine, key: str, order: str) -> None:
        self.machine, self.key, self.order = machine, key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out = []
        for e in events.astype(object).where(events.notna(), None).to_dict("records"):
            state, shown = self.machine.step(state, {k: int(v) if isinstance(v, float) and v.is_integer() else v for k, v in e.items()})
            out.append({self.key: key[0], self.order: e[self.order], **shown})
        self.state.update((json.dumps(state),))
        frame = pd.DataFrame(out, columns=[self.key, self.order, *(f.name for f in self.machine.shows)])
        for f in self.machine.shows:
            frame[f.name] = frame[f.name].astype({_L: "Int64", _S: "object", _B: "bool"}[f.dataType])
        yield frame

    def close(self) -> None:
        pass


def follow(events: DataFrame, machine: Machine, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """The same over a stream: within a batch rows are taken in their order. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    schema = T.StructType([events.schema[key], events.schema[order], *machine.shows])
    return events.select(key, order, *machine.takes).groupBy(key).transformWithStateInPandas(_Keeper(machine, key, order), schema, "Append", "None")
