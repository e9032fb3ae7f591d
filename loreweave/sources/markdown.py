"""Markdown pages: scan, front matter, contents tables, and writing them back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions.formats import cell

SKIPPED = ("raw", "toc")
_NUMBER = re.compile(r"-?\d+(\.\d+)?$")
_PAIR = re.compile(r"([A-Za-z0-9_-]+):(?:\s+(.*))?$")
_PLAIN = re.compile(r"[A-Za-z0-9_./@ -]+$")

PAGE = "path string, title string, type string, topic string, summary string, tags array<string>, updated string, sources array<string>, files array<string>, claims array<map<string,string>>, body string, meta string"


def scan(spark: SparkSession, root: str, since: datetime | None = None) -> DataFrame:
    """(path, text): all Markdown files under a folder, but for skipped and hidden folders; paths relative to it.

    With ``since`` only files changed at that time or later are opened.
    """
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    if since is not None:
        files = files.where(F.col("_metadata.file_modification_time") >= F.lit(since))
    base = root.rstrip("/").split("://")[-1] + "/"
    file = F.col("_metadata.file_path")
    path = F.url_decode(F.right(file, F.length(file) - F.instr(file, base) - (len(base) - 1)))
    named = files.select(path.alias("path"), F.col("value").alias("text"))
    return named.where(~F.exists(F.split("path", "/"), lambda s: s.isin(*SKIPPED) | s.startswith(".")))


def scalar(text: str) -> Any:
    text = text.strip()
    if text in ("", "null", "~"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if _NUMBER.match(text):
        return float(text) if "." in text else int(text)
    if len(text) > 1 and text[0] == text[-1] == '"':
        try:
            return json.loads(text)
        except ValueError:
            return text[1:-1]
    return text[1:-1].replace("''", "'") if len(text) > 1 and text[0] == text[-1] == "'" else text


def _split(text: str) -> list[str]:
    """Parts at commas that stand outside quotes."""
    parts, mark, now = [], "", ""
    for c in text:
        if c == "," and not mark:
            parts.append(now)
            now = ""
            continue
        mark = "" if c == mark else c if not mark and c in "\"'" else mark
        now += c
    return [p.strip() for p in [*parts, now] if p.strip()]


def _value(text: str) -> Any:
    text = text.strip()
    return [scalar(x) for x in _split(text[1:-1])] if text.startswith("[") and text.endswith("]") else scalar(text)


def parse(text: str) -> tuple[dict[str, Any], str]:
    """(front matter, body): flat scalars, inline lists, lists of scalars or of flat maps; lines that start with # don't count."""
    text = text.removeprefix("﻿")
    end = text.find("\n---", 3) if text.startswith("---") else -1
    if end < 0:
        return {}, text
    data: dict[str, Any] = {}
    key: str | None = None
    for line in text[3:end].split("\n"):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if line[:1].isspace() or bare.startswith("- "):
            if key is None:
                continue
            items = data[key] if isinstance(data[key], list) else []
            data[key] = items
            item = bare[2:].strip() if bare.startswith("- ") else bare
            pair = _PAIR.match(item)
            if bare.startswith("- "):
                items.append({pair[1]: _value(pair[2] or "")} if pair else scalar(item))
            elif pair and items and isinstance(items[-1], dict):
                items[-1][pair[1]] = _value(pair[2] or "")
        elif pair := _PAIR.match(bare):
            key = pair[1]
            data[key] = _value(pair[2] or "")
    rest = text[end + 4 :]
    return data, rest.partition("\n")[2] if "\n" in rest else ""


def _written(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    text = str(value)
    plain = _PLAIN.match(text) and text == text.strip() and scalar(text) == text
    return text if plain else json.dumps(text, ensure_ascii=False)


def serialize(data: dict[str, Any], body: str) -> str:
    """The inverse of ``parse``."""
    lines = []
    for key, value in data.items():
        if isinstance(value, list) and any(isinstance(x, dict) for x in value):
            lines.append(f"{key}:")
            for item in value:
                for at, (k, v) in enumerate(item.items()):
                    inner = f"[{', '.join(map(_written, v))}]" if isinstance(v, list) else _written(v)
                    lines.append(f"{'  - ' if not at else '    '}{k}: {inner}")
        elif isinstance(value, list):
            lines.append(f"{key}: [{', '.join(map(_written, value))}]")
        else:
            lines.append(f"{key}: {_written(value)}")
    return "\n".join(["---", *lines, "---", body])


def pages(files: DataFrame) -> DataFrame:
    """Files (path, text) as pages; ``meta`` keeps the whole front matter as JSON, claims are maps of strings."""

    def strings(x: Any) -> list[str]:
        return [] if x is None else [str(v) for v in x] if isinstance(x, list) else [str(x)]

    def text(x: Any) -> str | None:
        return None if x is None else x if isinstance(x, str) else json.dumps(x)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                data, body = parse(r.text or "")
                claims = [{k: text(v) for k, v in c.items()} for c in data.get("claims") or [] if isinstance(c, dict)]
                topic = r.path.split("/")[0] if "/" in r.path else "general"
                rows.append((r.path, text(data.get("title")), text(data.get("type")), topic, text(data.get("summary")), strings(data.get("tags")), text(data.get("updated")), strings(data.get("sources")), strings(data.get("files")), claims, body, json.dumps(data)))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in PAGE.split(", ")], dtype=object)

    return files.mapInPandas(run, PAGE)


def claims(pages: DataFrame) -> DataFrame:
    """(path, id, text, status, support, files): the claims of pages, with the page's files where a claim has none."""
    one = pages.select("path", F.col("files").alias("page_files"), F.explode("claims").alias("c"))
    own = F.from_json(F.col("c")["files"], "array<string>")
    return one.select("path", F.col("c")["id"].alias("id"), F.col("c")["text"].alias("text"), F.col("c")["status"].alias("status"), F.expr("try_cast(c['support'] as double)").alias("support"), F.when(F.size(own) > 0, own).otherwise(F.col("page_files")).alias("files"))


_ROW = r"^\|\s*\[([^\]]*)\]\(([^)]+)\)\s*\|\s*([^|]*?)\s*\|\s*([^|]*?)\s*\|\s*([^|]*?)\s*\|\s*([^|]*?)\s*\|\s*$"


def contents(files: DataFrame) -> DataFrame:
    """Rows of contents tables: path, title, type, tags, summary, updated. ``files``: text."""
    line = files.select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(_ROW))
    part = [F.regexp_extract("line", _ROW, k) for k in range(1, 7)]
    tags = F.filter(F.split(part[3], r"\s+"), lambda t: t != "")
    rows = line.select(part[1].alias("path"), part[0].alias("title"), part[2].alias("type"), tags.alias("tags"), part[4].alias("summary"), part[5].alias("updated"))
    return rows.where(~F.col("path").contains("]("))


def contents_line(title: str = "title", path: str = "path") -> Any:
    """The contents table's row of a page, bars escaped."""
    safe = [cell(F.coalesce(F.col(c), F.lit(""))) for c in (title, "type", "summary", "updated")]
    return F.concat(F.lit("| ["), safe[0], F.lit("]("), F.col(path), F.lit(") | "), safe[1], F.lit(" | "), F.array_join("tags", " "), F.lit(" | "), safe[2], F.lit(" | "), safe[3], F.lit(" |"))


def write_contents(toc: DataFrame, folder: str) -> None:
    """A contents file for each topic, as a partitioned text sink."""
    from loreweave.functions.text import topic_of

    rows = toc.select(topic_of(F.col("path")).alias("topic"), contents_line().alias("value"), "path")
    rows.repartition("topic").sortWithinPartitions("topic", "path").select("topic", "value").write.mode("overwrite").partitionBy("topic").text(folder)
