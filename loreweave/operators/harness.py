"""Experiment runs: loadouts, toolsets, upkeep, diffs, spending, briefs, signatures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sessions import wiki_call_kind

#: Names of test files and folders.
TEST_FILE = r"(?i)(^|/)(test|tests|spec|specs|__tests__|e2e)(/|$)|[.\-_](test|spec)\.[cm]?[jt]sx?$|(^|/)test_[^/]+\.py$"


def is_wiki_tool(name: Column, prefixes: tuple[str, ...] = ("wiki_",)) -> Column:
    return wiki_call_kind(name, prefixes).isNotNull()


def toolset_differences(rows: DataFrame, prefixes: tuple[str, ...] = ("wiki_",)) -> DataFrame:
    """``rows`` (off, on: arrays of tool names) with what only one side has, wiki tools aside, and whether both agree."""

    def plain(tools: str) -> Column:
        return F.array_sort(F.array_distinct(F.filter(tools, lambda t: ~F.coalesce(is_wiki_tool(t, prefixes), F.lit(False)))))

    off, on = plain("off"), plain("on")
    told = rows.withColumn("only_off", F.array_except(off, on)).withColumn("only_on", F.array_except(on, off))
    wiki = F.size(F.array_distinct(F.filter("on", lambda t: is_wiki_tool(t, prefixes))))
    return told.withColumn("comparable", (F.size("only_off") == 0) & (F.size("only_on") == 0)).withColumn("shared", F.size(off)).withColumn("wiki_tools", wiki)


def loadout_problem(arm: Column, tools: Column, prefixes: tuple[str, ...] = ("wiki_",)) -> Column:
    """What is wrong with the tools that an arm loaded; null if nothing is.

    Arms whose name begins with ``wiki`` keep the collection and need its tools; the others must have none; the one
    without capture must have none that write.
    """
    own = F.filter(tools, lambda t: is_wiki_tool(t, prefixes))
    writes = F.filter(own, lambda t: wiki_call_kind(t, prefixes) == "write")
    listed = lambda x: F.array_join(x, ", ")
    keeps = arm.startswith("wiki")
    return (
        F.when(~keeps & (F.size(own) > 0), F.concat(F.lit("the "), arm, F.lit(" arm loaded wiki tools ("), listed(own), F.lit(")")))
        .when(keeps & (F.size(own) == 0), F.concat(F.lit("the "), arm, F.lit(" arm loaded no wiki tools")))
        .when((arm == "wiki-nocapture") & (F.size(writes) > 0), F.concat(F.lit("the read-only wiki arm still has wiki write tools ("), listed(writes), F.lit(")")))
    )


def listed_tools(section: Column) -> Column:
    """Tool names from a system prompt's section: lines of a dash, a name and a colon."""
    return F.regexp_extract_all(section, F.lit(r"(?m)^- ([a-zA-Z0-9_]+):"), F.lit(1))


def upkeep(messages: DataFrame, calls: DataFrame, prefixes: tuple[str, ...] = ("wiki_",)) -> DataFrame:
    """(session, messages, cost): assistant messages with a call that writes to the collection, and what they cost.

    A lower bound of its upkeep. ``messages``: session, ord, role, cost; ``calls``: session, ord, name.
    """
    writing = calls.where(wiki_call_kind(F.col("name"), prefixes) == "write").select("session", "ord").distinct()
    own = messages.where("role = 'assistant'").join(writing.withColumn("_w", F.lit(True)), ["session", "ord"], "left")
    return own.groupBy("session").agg(F.count_if("_w").alias("messages"), F.sum(F.when(F.col("_w"), F.coalesce("cost", F.lit(0.0))).otherwise(0.0)).alias("cost"))


def diff_statistics(changes: DataFrame, tooling: tuple[str, ...]) -> DataFrame:
    """(run, files, code_files, tooling_files, insertions, deletions, test_files) of changed files.

    ``changes``: run, path, added, deleted; ``tooling``: prefixes of files that are not code. Counts of binary files are null and add nothing.
    """
    tool = F.lit(False)
    for prefix in tooling:
        tool = tool | F.col("path").startswith(prefix)
    number = [F.sum(F.coalesce(c, F.lit(0))).alias(n) for c, n in (("added", "insertions"), ("deleted", "deletions"))]
    return changes.groupBy("run").agg(F.count(F.lit(1)).alias("files"), F.count_if(~tool).alias("code_files"), F.count_if(tool).alias("tooling_files"), *number, F.count_if(F.col("path").rlike(TEST_FILE)).alias("test_files"))


def model_usage(ledger: DataFrame, base: DataFrame) -> DataFrame:
    """(run, calls, input_tokens, output_tokens, cost) of a run's own lines: those behind the base's number of lines.

    ``ledger``: run, line (from 0), input_tokens, output_tokens, cost, has_usage; ``base``: run, lines.
    """
    own = ledger.join(base, "run", "left").where((F.col("line") >= F.coalesce("lines", F.lit(0))) & F.col("has_usage"))
    return own.groupBy("run").agg(F.count(F.lit(1)).alias("calls"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cost")])


def run_metrics(analysis: DataFrame) -> DataFrame:
    """A run's measures, from the totals of ``sessions.analysis``."""
    names = {"total_tokens": "tokens", "cache_read": "cache_read_tokens"}
    kept = ["episodes", "requests", "cost", "total_tokens", "cache_read", *[f"n_{b}" for b in ("explore", "wiki", "act", "verify", "other")], "wiki_reads", "wiki_writes", "files_read", "read_chars", "searches", "consultation_rate", "rediscovery_rate"]
    return analysis.select(*[F.col(c).alias(names.get(c, c)) for c in kept])


def knowledge_brief(pages: DataFrame, index: str | None = None, most: int = 20_000) -> DataFrame:
    """One row: text, pages, chars, truncated, sha (12 digits): an index, or a line for each page's title and summary.

    ``pages``: path, title, summary. Pages without a title and generated files are left out; lines go by path.
    """
    header = "Project knowledge index (titles and one-line summaries; the pages themselves are not in this checkout):"
    if index is not None:
        body = pages.sparkSession.createDataFrame([(index,)], "body string")
    else:
        kept = pages.where(F.col("title").isNotNull() & ~F.col("path").rlike(r"(^|/)(index|log|toc)\.md$") & ~F.contains("path", F.lit("/toc/")))
        line = F.concat(F.lit("- "), F.concat_ws(" — ", "title", "summary"))
        listed = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
        body = kept.agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("body"))
    rows = F.regexp_count("body", F.lit(r"(?m)^\| \["))
    count = F.when(rows > 0, rows).otherwise(F.regexp_count("body", F.lit(r"(?m)^- ")))
    long = F.length("body") > most
    shown = F.when(long, F.concat(F.substring("body", 1, most), F.lit("\n[... truncated ...]"))).otherwise(F.trim("body"))
    text = F.concat(F.lit(header + "\n\n"), shown)
    return body.select(text.alias("text"), count.alias("pages"), long.alias("truncated")).select("text", "pages", F.length("text").alias("chars"), "truncated", F.substring(F.sha1("text"), 1, 12).alias("sha"))


def folder_signatures(entries: DataFrame) -> DataFrame:
    """(folder, signature): twelve digits of the hash of a folder's lock file and its sorted listings.

    ``entries``: folder, part (0: the lock file, whose text is the name; then listings, in order), name.
    """
    listing = F.array_join(F.array_sort(F.collect_list("name")), "\n")
    parts = entries.groupBy("folder", "part").agg(listing.alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "")
    return parts.groupBy("folder").agg(F.substring(F.sha1(whole), 1, 12).alias("signature"))


def quality_signals(runs: DataFrame, most: int = 400) -> DataFrame:
    """(name, passed, tail) of a task's own checks. ``runs``: name, exit_code, output."""
    return runs.select(F.regexp_replace("name", "(?i)[^a-z0-9_-]", "").alias("name"), (F.col("exit_code") == 0).alias("passed"), F.right("output", F.lit(most)).alias("tail"))


def blind_order(arms: Column, seed: Column) -> Column:
    """``arms`` in an order that follows from ``seed`` alone, by a hashed seed and a congruential shuffle in doubles."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([shuffled(list(a), s) for a, s in zip(lists, seeds, strict=True)])

    return run(arms, seed)


def shuffled(items: list[str], seed_text: str) -> list[str]:
    """See ``blind_order``; numbers above 2^53 round as doubles do, which decides the order."""
    units = seed_text.encode("utf-16-le", "surrogatepass")
    seed = 2166136261
    for k in range(0, len(units), 2):
        mixed = seed ^ int.from_bytes(units[k : k + 2], "little")
        signed = mixed - (1 << 32) if mixed >> 31 else mixed
        seed = int(float(signed) * 16777619.0) % (1 << 32)
    for at in range(len(items) - 1, 0, -1):
        seed = int(float(seed) * 1103515245.0 + 12345.0) % (1 << 32)
        other = seed % (at + 1)
        items[at], items[other] = items[other], items[at]
    return items


def vector_text(vector: Column) -> Column:
    """A vector as base64 of its 32-bit floats, as it goes over a wire."""
    import base64

    import numpy as np

    @F.pandas_udf("string")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())

    return run(vector)


def text_vector(text: Column) -> Column:
    """The inverse of ``vector_text``."""
    import base64

    import numpy as np

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else np.frombuffer(base64.b64decode(t), "<f4"))

    return run(text)
