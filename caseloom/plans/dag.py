"""Question plans: a small graph of tasks whose nodes are lazy DataFrames.

The rules of completion: a metric question works on the cases that other tasks find, without the
label predicate; a comparison needs two or more parts; a graph has ten nodes at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame

MOST = 10


@dataclass(frozen=True)
class Task:
    id: str
    kind: str
    depends_on: tuple[str, ...] = ()
    conditions: dict = field(default_factory=dict)


def completed(tasks: list[Task]) -> list[Task]:
    """Adds the identification that counts, metrics and comparisons need; drops what a metric must not filter by."""
    out, find = list(tasks), next((t for t in tasks if t.kind == "identify"), None)
    needy = [t for t in tasks if t.kind in ("count", "list", "metric", "compare", "analyse") and not t.depends_on]
    if needy and find is None:
        find = Task("identify", "identify", (), needy[0].conditions)
        out.insert(0, find)
    out = [replace(t, depends_on=(find.id,)) if t in needy else t for t in out]
    metric = any(t.kind == "metric" for t in out)
    out = [replace(t, conditions={k: v for k, v in t.conditions.items() if k != "labels"}) if metric and t.kind in ("metric", "identify") else t for t in out]
    if len(out) > MOST:
        raise ValueError(f"a plan has {MOST} tasks at most")
    if {d for t in out for d in t.depends_on} - {t.id for t in out}:
        raise ValueError("a task depends on an unknown one")
    return out


def run(tasks: list[Task], handlers: dict[str, Callable[[Task, list[DataFrame]], DataFrame]]) -> dict[str, DataFrame]:
    """Builds every node from the nodes it depends on; nothing is computed before an action on a result."""
    by_id = {t.id: t for t in tasks}
    frames: dict[str, DataFrame] = {}
    for name in TopologicalSorter({t.id: set(t.depends_on) for t in tasks}).static_order():
        task = by_id[name]
        frames[name] = handlers[task.kind](task, [frames[d] for d in task.depends_on])
    return frames


def narrowed(scope: DataFrame, parts: list[DataFrame], key: str = "case_id") -> DataFrame:
    """Only what every dependency found: never everything when they found nothing."""
    for p in parts:
        scope = scope.join(p.select(key).distinct(), key, "left_semi")
    return scope
