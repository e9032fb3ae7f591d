"""Search engines behind one shape: a function from queries and a limit to ranked hits, and a fallback between two."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

Engine = Callable[[DataFrame, int], DataFrame]
HITS = "query_id long, path string, rank int, score double"


def command_engine(command: list[str], timeout: float = 20.0) -> Engine:
    """An engine that is another program: it gets the query and the limit as its last arguments and prints a JSON list.

    Each item needs a path (or file) and may have a score. A program that fails raises in its task.
    """

    def ask(query: str, limit: int) -> list[tuple[str, float]]:
        done = subprocess.run([*command, query, str(limit)], capture_output=True, text=True, timeout=timeout, check=True)
        return [(x.get("path") or x["file"], float(x.get("score") or 0.0)) for x in json.loads(done.stdout)][:limit]

    def run(queries: DataFrame, limit: int) -> DataFrame:
        def each(frames):
            for frame in frames:
                rows = [(r.query_id, path, rank, score) for r in frame.itertuples() for rank, (path, score) in enumerate(ask(r.query, limit), 1)]
                yield pd.DataFrame(rows, columns=["query_id", "path", "rank", "score"])

        return queries.select("query_id", "query").mapInPandas(each, HITS)

    return run


def with_fallback(first: Engine, second: Engine) -> Engine:
    """The first engine's hits, or all of the second's if the first one fails on anything."""

    def run(queries: DataFrame, limit: int) -> DataFrame:
        try:
            return first(queries, limit).checkpoint()
        except Exception:  # noqa: BLE001  whatever another program does wrong
            return second(queries, limit)

    return run
