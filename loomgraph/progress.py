"""Build progress as a small JSON file with a heart-beat, and whether a build is alive."""

from __future__ import annotations

import json
import os
import sys
import threading
import time
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext
from datetime import UTC, datetime
from typing import Protocol, TextIO

STAGES = ("detect", "extract", "graph", "vector", "index", "finalize", "done", "interrupted")
BEAT_SECONDS, ALIVE_SECONDS = 10, 60
FLUSH_EVERY, FLUSH_SECONDS = 20, 1.0


def now() -> str:
    return datetime.now(UTC).isoformat()


class Progress:
    """Written at every stage and beat; removed when done, kept as interrupted on an error."""

    def __init__(self, store, force: bool = False) -> None:
        self.store, self.lock, self.stop = store, threading.Lock(), threading.Event()
        self.pending, self.written = 0, 0.0
        self.state = {"schema_version": "1", "pid": os.getpid(), "stage": "detect", "started_at": now(), "heartbeat_ts": now(), "force": force, "seq": 0, "extract": {"total": 0, "completed": 0, "cached": 0, "skipped": 0}, "vector": {"total_nodes": 0, "indexed_nodes": 0}, "message": ""}
        self._write()
        threading.Thread(target=self._beat, daemon=True).start()

    def _beat(self) -> None:
        while not self.stop.wait(BEAT_SECONDS):
            self._write()

    def _write(self) -> None:
        with self.lock:
            if not self.stop.is_set():
                self.state["heartbeat_ts"] = now()
                self.pending, self.written = 0, time.monotonic()
                self.store.write_text(".build_progress.json", json.dumps(self.state))

    def stage(self, name: str, message: str = "", **counts: dict) -> None:
        if name not in STAGES:
            raise ValueError(f"unknown stage {name}")
        self.state |= {"stage": name, "message": message, "seq": self.state["seq"] + 1}
        for k, v in counts.items():
            self.state[k] |= v
        self._write()

    def update_extract(self, completed: int = 0, cached: int = 0, skipped: int = 0, total: int | None = None, flush: bool = False) -> None:
        """Add to the counts of the extract stage."""
        self._count("extract", {"completed": completed, "cached": cached, "skipped": skipped}, {"total": total}, flush)

    def update_vector(self, indexed: int = 0, total: int | None = None, flush: bool = False) -> None:
        """Add to the counts of the vector stage."""
        self._count("vector", {"indexed_nodes": indexed}, {"total_nodes": total}, flush)

    def _count(self, stage: str, more: dict[str, int], given: dict[str, int | None], flush: bool) -> None:
        with self.lock:
            for k, v in more.items():
                self.state[stage][k] += v
            self.state[stage] |= {k: v for k, v in given.items() if v is not None}
            self.pending += sum(more.values())
        self.flush_if_pending(flush)

    def flush_if_pending(self, force: bool = False) -> bool:
        """Write if FLUSH_EVERY counts have come since the last time, or FLUSH_SECONDS have passed; whether it wrote."""
        if not force and self.pending < FLUSH_EVERY and time.monotonic() - self.written < FLUSH_SECONDS:
            return False
        self.state["seq"] += 1
        self._write()
        return True

    def done(self) -> None:
        with self.lock:
            self.stop.set()
            fs, path = self.store._path(".build_progress.json")
            fs.delete(path, False)

    def interrupted(self) -> None:
        self.stage("interrupted")
        with self.lock:
            self.stop.set()


def read_progress(store) -> dict | None:
    try:
        return json.loads(store.read_text(".build_progress.json") or "null")
    except ValueError:
        return None


def is_fresh(state: dict) -> bool:
    try:
        at = datetime.fromisoformat(state["heartbeat_ts"])
    except (KeyError, ValueError):
        return False
    at = at.replace(tzinfo=UTC) if at.tzinfo is None else at
    return (datetime.now(UTC) - at).total_seconds() < ALIVE_SECONDS


def is_alive(state: dict | None) -> bool:
    return bool(state) and state["stage"] not in ("done", "interrupted") and is_fresh(state)


def check_alive(store, wait: float = 1.0) -> bool:
    """Fresh heart-beat, else whether the sequence moves within `wait` seconds."""
    first = read_progress(store)
    if not first or first["stage"] in ("done", "interrupted"):
        return False
    if is_fresh(first):
        return True
    time.sleep(wait)
    second = read_progress(store)
    return bool(second) and second["seq"] > first["seq"]


class ProgressReporter(Protocol):
    """Told of each step of a question."""

    def stage(self, name: str) -> AbstractContextManager[None]: ...


class NullProgressReporter:
    """Says nothing."""

    def stage(self, name: str) -> AbstractContextManager[None]:
        return nullcontext()


class TerminalProgressReporter:
    """Writes each step and its seconds to a stream; a terminal shows the running step on one line."""

    def __init__(self, out: TextIO | None = None) -> None:
        self.out = out or sys.stderr

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began, live = time.monotonic(), self.out.isatty()
        if live:
            print(f"▶ {name}", end="\r", file=self.out, flush=True)
        try:
            yield
        except BaseException:
            print(f"✗ {name}", file=self.out, flush=True)
            raise
        print(f"✓ {name} {time.monotonic() - began:.1f}s", file=self.out, flush=True)


def check_alive_shown(store, reporter: ProgressReporter, wait: float = 1.0) -> bool:
    """check_alive, with the wait shown."""
    with reporter.stage("looking for a running build"):
        return check_alive(store, wait)


def stage_state(state: dict, stage: str) -> tuple[str, int | None]:
    """(ok, run or pending, percentage) of a stage."""
    here, at = STAGES.index(state["stage"]) if state["stage"] in STAGES[:7] else -1, STAGES.index(stage)
    how = "ok" if at < here else "run" if at == here else "pending"
    if stage == "extract":
        total, got = state["extract"]["total"], state["extract"]["completed"]
    elif stage == "vector":
        total, got = state["vector"]["total_nodes"], state["vector"]["indexed_nodes"]
    else:
        return how, None
    return how, 100 if how == "ok" else got * 100 // total if total else 0
