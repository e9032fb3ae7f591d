"""Settings in layers, the choices that follow from them, and checks of their values."""

from __future__ import annotations

import copy
import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The defaults.
DEFAULTS: dict[str, Any] = {
    "writer": {"mode": "guided"},
    "routing": {"shardSize": 250, "minFit": 0.6, "newPageConfidence": 0.7},
    "review": {"mode": "agent", "autoAcceptUserStated": True, "escalateCriticality": 0.85, "maxPerSession": 10},
    "thresholds": {"autoAccept": 0.8, "minSupport": 0.7, "minDerivable": 0.5, "framingImportance": 0.6, "minNovelty": 0.6, "minImportance": 1},
    "weights": {"grounded": 0.45, "importance": 0.25, "nonDerivable": 0.2, "authority": 0.1},
    "toc": {"maxTokens": 3000},
    "lint": {"orphanMinAgeDays": 7, "duplicateSimilarity": 0.72},
    "capture": {"cadence": "manual", "onCompact": False, "route": "subject"},
    "hooks": {"autoRetrieve": {"mode": "inject", "limit": 6, "maxTokens": 800, "budgetMs": 2500}},
    "search": {
        "engine": "auto",
        "vector": {
            "enabled": True,
            "model": "performance",
            "chunk": {"pageSections": True, "maxTokens": 1200, "overlap": 160},
            "fusion": {"rrfK": 60, "candidateMultiplier": 3},
            "scan": {"maxDepth": 6},
        },
        "judge": {"rerank": "auto", "sufficiency": True, "minSufficiency": 0.5, "maxCandidates": 8},
    },
}

ENGINES = ("auto", "index", "bm25", "vector", "hybrid", "external")
MODELS = {"performance": 768, "quality": 1024}  # dimensions


def merged(base: Any, patch: Any) -> Any:
    """``base`` with ``patch`` over it, mapping by mapping; a missing or null patch changes nothing."""
    if patch is None:
        return base
    if not isinstance(base, Mapping) or not isinstance(patch, Mapping):
        return patch
    return {**base, **{k: merged(base.get(k), v) for k, v in patch.items()}}


def layered(*layers: Mapping[str, Any] | None) -> dict[str, Any]:
    """The defaults with each layer over the ones before: for all, for a project, for a call."""
    out: Any = copy.deepcopy(DEFAULTS)
    for layer in layers:
        out = merged(out, layer)
    return out


def environment(text: str) -> dict[str, str]:
    """Settings of an environment file: name = value, quotes around values dropped, comments and odd lines left out."""
    out = {}
    for line in text.splitlines():
        name, sign, value = line.strip().partition("=")
        name, value = name.strip(), value.strip()
        if not sign or not name or name.startswith("#"):
            continue
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
        out[name] = value[1:-1] if quoted else value
    return out


def indirect(value: str | None, file: Mapping[str, str]) -> str | None:
    """A value, or if it begins with a dollar sign what the process's environment or the file has by that name."""
    if not value or not value.startswith("$"):
        return value or None
    return os.environ.get(value[1:], file.get(value[1:]))


def model_choice(project: Mapping[str, Any] | None, user: Mapping[str, Any] | None, default: str = "performance") -> tuple[str, str]:
    """(model, where it comes from): the project's, else the user's, else the default."""
    for source, layer in (("project", project), ("user", user)):
        at: Any = layer or {}
        for key in ("search", "vector", "model"):
            at = at.get(key) if isinstance(at, Mapping) else None
        if isinstance(at, str) and at.strip():
            return at.strip(), source
    return default, "default"


def capture_triggers(cadence: Column, on_settle: Column, on_compact: Column) -> Column:
    """When sessions are captured, as a struct: after a task, after a commit, at compaction."""
    mode = F.coalesce(cadence, F.lit("manual"))
    return F.struct(
        ((mode == "task") | ((mode == "manual") & F.coalesce(on_settle, F.lit(False)))).alias("task"),
        (mode == "commit").alias("commit"),
        F.coalesce(on_compact, F.lit(False)).alias("compact"),
    )


def invalid(settings: Mapping[str, Any]) -> list[str]:
    """The names of settings whose values can't be, with the values."""

    def value(path: str) -> Any:
        at: Any = settings
        for key in path.split("."):
            at = at.get(key) if isinstance(at, Mapping) else None
        return at

    def number(path: str, low: float, high: float) -> bool:
        x = value(path)
        return isinstance(x, (int, float)) and not isinstance(x, bool) and low <= x <= high

    ranges = {
        "thresholds.autoAccept": (0, 1), "thresholds.minSupport": (0, 1), "thresholds.minDerivable": (0, 1), "thresholds.minNovelty": (0, 1), "thresholds.minImportance": (0, 3),
        "routing.minFit": (0, 1), "routing.newPageConfidence": (0, 1), "routing.shardSize": (10, 255), "review.escalateCriticality": (0, 1), "lint.duplicateSimilarity": (0, 1),
        "search.judge.minSufficiency": (0, 1), "search.judge.maxCandidates": (1, 50),
    }
    kinds = {"capture.cadence": ("manual", "task", "commit"), "capture.route": ("session", "subject"), "search.judge.rerank": ("auto", "always", "never"), "search.engine": ENGINES, "search.vector.model": tuple(MODELS)}
    out = [path for path, (low, high) in ranges.items() if not number(path, low, high)]
    out += [path for path, known in kinds.items() if value(path) not in known]
    dims = value("search.vector.dimensions")
    if dims is not None and not (isinstance(dims, int) and 1 <= dims <= MODELS.get(value("search.vector.model"), 0)):
        out.append("search.vector.dimensions")
    return [f"{path}={value(path)}" for path in out]


def check_counts(checks: DataFrame) -> DataFrame:
    """One row: how many checks are ok, warn and fail. ``checks``: name, status."""
    return checks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warn", "fail")])
