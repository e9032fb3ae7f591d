"""Tables turned into lines of Markdown: catalogues, structures, episodes and summaries of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.formats import chars, duration, share, table_row, usd, whole


def _ticked(x: Column) -> Column:
    return F.concat(F.lit("`"), x, F.lit("`"))


def catalog_lines(rows: DataFrame, topics: int = 3) -> DataFrame:
    """(name, line) of a catalogue's entries.

    ``rows``: name, root, pages, topics (array of slug, count), chunks, model, updated_at, flags (array).
    """
    told = F.transform(F.slice("topics", 1, topics), lambda t: F.concat_ws(" ", t["slug"], t["count"].cast("string")))
    more = F.when(F.size("topics") > topics, F.concat(F.lit(", +"), (F.size("topics") - topics).cast("string"))).otherwise("")
    named = F.when(F.size("topics") > 0, F.concat(F.lit(" ("), F.array_join(told, ", "), more, F.lit(")"))).otherwise("")
    index = F.when(F.col("chunks").isNotNull(), F.concat(F.col("chunks").cast("string"), F.lit(" chunks · "), F.coalesce("model", F.lit("?")))).otherwise("not indexed")
    at = F.when(F.col("updated_at").isNotNull(), F.concat(F.lit(" · updated "), F.replace(F.substring("updated_at", 1, 16), F.lit("T"), F.lit(" ")))).otherwise("")
    flags = F.when(F.size("flags") > 0, F.concat(F.lit(" — "), F.array_join("flags", ", "))).otherwise("")
    line = F.concat(F.lit("- **"), "name", F.lit("** — "), F.col("pages").cast("string"), F.lit(" pages"), named, F.lit(" · "), index, at, F.lit(" — "), "root", flags)
    return rows.select("name", line.alias("line"))


def module_lines(modules: DataFrame, names: int = 5) -> DataFrame:
    """(module, line): a table's row for each module. ``modules``: see ``lint.modules``."""

    def some(x: str) -> Column:
        return F.when(F.size(x) > 0, F.array_join(F.slice(x, 1, names), ", ")).otherwise("—")

    return modules.select("module", table_row(_ticked(F.col("module")), F.col("n_files").cast("string"), some("imports"), some("imported_by"), F.when(F.col("entry"), "yes").otherwise("")).alias("line"))


def episode_lines(eps: DataFrame) -> DataFrame:
    """(label, line): a table's row for each episode.

    ``eps``: label, started, ms, requests, cost, total_tokens, n_explore, n_wiki, n_act, n_verify, n_files, read_chars, end_reason.
    """
    start = F.when(F.col("started").isNull(), "—").otherwise(F.substring(F.replace(F.col("started").cast("string"), F.lit("T"), F.lit(" ")), 1, 16))
    counts = [F.col(c).cast("string") for c in ("n_explore", "n_wiki", "n_act", "n_verify", "n_files")]
    cells = [F.col("label"), start, duration(F.col("ms")), F.col("requests").cast("string"), usd(F.col("cost")), whole(F.col("total_tokens")), *counts, chars(F.col("read_chars")), F.col("end_reason")]
    return eps.select("label", table_row(*cells).alias("line"))


def summary_lines(rows: DataFrame) -> DataFrame:
    """(name, line): a table's row for each project.

    ``rows``: name, sessions, has_wiki and the columns of ``sessions.summary_row``; shares of a collection that isn't there are dashes.
    """
    own = lambda x: F.when(F.col("has_wiki"), share(F.col(x))).otherwise("—")
    median = F.when(F.col("median_cost").isNull(), "—").otherwise(usd(F.col("median_cost")))
    cells = [F.col("name"), whole(F.col("sessions")), whole(F.col("episodes")), usd(F.col("cost")), median, share(F.col("explore_share")), own("wiki_share"), own("consultation_rate"), own("rediscovery_rate"), whole(F.col("files_read"))]
    return rows.select("name", table_row(*cells).alias("line"))
