"""Phases of a build of the graph: dependencies, conditions and an order that respects them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush


@dataclass
class Phase:
    """A named step; ``run`` takes the shared context and may return a result. Without ``enabled_when`` it always runs."""

    name: str
    run: Callable[[dict], object]
    needs: tuple[str, ...] = ()
    enabled_when: Callable[[dict], bool] | None = None


@dataclass
class Result:
    name: str
    status: str
    seconds: float = 0.0
    value: object = None
    error: str = ""


@dataclass
class Phases:
    known: dict[str, Phase] = field(default_factory=dict)

    def add(self, phase: Phase) -> "Phases":
        if phase.name in self.known:
            raise ValueError(f"there is a phase {phase.name!r}")
        self.known[phase.name] = phase
        return self

    def run(self, context: dict | None = None) -> list[Result]:
        """Run all in order. A phase that is not enabled, or needs one that failed, is skipped."""
        context, out, failed = context if context is not None else {}, [], set()
        for phase in order(self.known.values()):
            if failed & set(phase.needs):
                failed.add(phase.name)
                out.append(Result(phase.name, "skipped", error="needs a phase that failed"))
            elif phase.enabled_when and not phase.enabled_when(context):
                out.append(Result(phase.name, "disabled"))
            else:
                began = time.time()
                try:
                    out.append(Result(phase.name, "done", value=phase.run(context), seconds=time.time() - began))
                except Exception as e:
                    failed.add(phase.name)
                    out.append(Result(phase.name, "failed", seconds=time.time() - began, error=str(e)))
        return out


def order(phases: Iterable[Phase]) -> list[Phase]:
    """Topological order, by name among phases that are free; ValueError on a cycle or an unknown need."""
    by_name = {p.name: p for p in phases}
    if unknown := {n for p in by_name.values() for n in p.needs} - set(by_name):
        raise ValueError(f"unknown phases: {sorted(unknown)}")
    waits = {n: len(set(p.needs)) for n, p in by_name.items()}
    free, out = [n for n, k in waits.items() if k == 0], []
    heapify(free)
    while free:
        name = heappop(free)
        out.append(by_name[name])
        for n, p in by_name.items():
            if name in p.needs:
                waits[n] -= 1
                if waits[n] == 0:
                    heappush(free, n)
    if len(out) < len(by_name):
        raise ValueError(f"a cycle among {sorted(set(by_name) - {p.name for p in out})}")
    return out


def text_table(rows: list[dict], columns: list[str]) -> str:
    """Rows of a report as an aligned text table."""
    cells = [columns] + [["" if r.get(c) is None else str(r[c]) for c in columns] for r in rows]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])
