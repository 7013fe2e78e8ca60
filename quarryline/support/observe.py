"""Resource samples of this process, and lineage events to a transport of the caller's."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Sample:
    at: float
    memory: int | None
    limit: int | None
    cpu_seconds: float | None


def read_sample(root: str = "/sys/fs/cgroup", proc: str = "/proc/self/status") -> Sample:
    """From the control group where there is one, else from the process."""

    def number(name: str) -> int | None:
        p = Path(root, name)
        text = p.read_text().strip() if p.exists() else ""
        return int(text) if text.isdigit() else None

    memory = number("memory.current")
    if memory is None and Path(proc).exists():
        rss = [x for x in Path(proc).read_text().splitlines() if x.startswith("VmRSS")]
        memory = int(rss[0].split()[1]) * 1024 if rss else None
    stat = Path(root, "cpu.stat")
    usage = [x for x in stat.read_text().splitlines() if x.startswith("usage_usec")] if stat.exists() else []
    return Sample(time.time(), memory, number("memory.max"), int(usage[0].split()[1]) / 1e6 if usage else None)


class Sampler:
    """Samples in a daemon thread while a block runs."""

    def __init__(self, every: float = 1.0, read: Callable[[], Sample] = read_sample):
        self.every, self.read, self.samples, self._stop = every, read, [], threading.Event()

    def __enter__(self) -> Sampler:
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def _run(self) -> None:
        while True:
            self.samples.append(self.read())
            if self._stop.wait(self.every):
                return

    def __exit__(self, *_: Any) -> None:
        self._stop.set()
        self._thread.join()

    @property
    def peak(self) -> int | None:
        return max((s.memory for s in self.samples if s.memory is not None), default=None)


class LineageEvents:
    """START, COMPLETE and FAIL events of a run. A transport that fails never fails the run."""

    def __init__(self, send: Callable[[dict[str, Any]], None], namespace: str, producer: str = "quarryline"):
        self.send, self.namespace, self.producer = send, namespace, producer

    def emit(self, kind: str, job: str, run_id: str | None = None, *, inputs: list[str] = (), outputs: list[str] = (), facets: dict[str, Any] | None = None) -> str:
        if kind not in ("START", "COMPLETE", "FAIL"):
            raise ValueError(f"kind must be START, COMPLETE or FAIL, not {kind!r}")
        run_id = run_id or str(uuid.uuid4())
        named = lambda names: [{"namespace": self.namespace, "name": n} for n in names]
        event = {"eventType": kind, "eventTime": datetime.now(timezone.utc).isoformat(), "producer": self.producer, "run": {"runId": run_id, "facets": facets or {}}, "job": {"namespace": self.namespace, "name": job}, "inputs": named(inputs), "outputs": named(outputs)}
        try:
            self.send(event)
        except Exception:  # noqa: BLE001  the run matters more than its event
            pass
        return run_id
