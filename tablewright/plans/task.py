"""What is to be learned: task, target, metric, split and threshold, checked before any job."""

from __future__ import annotations

from dataclasses import dataclass, field

from tablewright.functions import fixed
from tablewright.operators.folds import default_strategy


@dataclass
class Task:
    task_type: str
    target: str | None
    metric: str
    strategy: str
    success_threshold: float | None
    secondary: tuple[str, ...]
    time_column: str | None = None
    group_column: str | None = None
    alerts: list[str] = field(default_factory=list)


def resolve_task(task_type: str, target: str | None = None, metric: str | None = None,
                 strategy: str | None = None, success_threshold: float | None = None,
                 time_column: str | None = None, group_column: str | None = None) -> Task:
    kind = (task_type or "").strip().lower()
    alerts: list[str] = []
    if kind not in fixed.VALID_METRICS:
        raise ValueError(f"Unknown task_type '{task_type}'; one of {sorted(fixed.VALID_METRICS)}.")
    if kind != "anomaly" and not target:
        raise ValueError(f"task_type '{kind}' needs a target column.")
    if metric and metric.strip().lower() not in fixed.VALID_METRICS[kind]:
        raise ValueError(f"Metric '{metric}' does not fit '{kind}'; one of {fixed.VALID_METRICS[kind]}.")
    if not metric:
        metric = fixed.DEFAULT_METRIC[kind]
        alerts.append(f"No metric given; '{metric}' is used.")
    metric = metric.strip().lower()
    if strategy and strategy not in fixed.SPLIT_STRATEGIES:
        raise ValueError(f"Unknown split strategy '{strategy}'; one of {fixed.SPLIT_STRATEGIES}.")
    if not strategy:
        strategy = default_strategy(kind, time_column, group_column)
        alerts.append(f"No split strategy given; '{strategy}' is used.")
    elif time_column and strategy != "time_split":
        alerts.append("A time column is given, but the split is not by time.")
    elif group_column and strategy != "group_kfold":
        alerts.append("A group column is given, but groups may be torn apart.")
    if success_threshold is None:
        success_threshold = fixed.DEFAULT_SUCCESS.get(metric)
    secondary = tuple(m for m in fixed.SECONDARY_METRICS[kind] if m != metric)
    return Task(kind, target, metric, strategy, success_threshold, secondary, time_column, group_column, alerts)
