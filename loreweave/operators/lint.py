"""Consistency of a page collection: tables of contents, links, orphans, backlog, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import base_name, topic_of

from .containment import held_names


def is_meta(path: Column) -> Column:
    """The collection's own index, log and contents, and everything under toc/."""
    return path.isin("index.md", "log.md", "toc.md") | path.startswith("toc/")


def is_generated(path: Column) -> Column:
    """A generated file in any folder, by its name."""
    return F.element_at(F.split(path, "/"), -1).isin("index.md", "log.md", "toc.md")


def is_generated_root(path: Column) -> Column:
    return path.isin("index.md", "log.md", "toc.md")


def is_skipped_by_sync(path: Column) -> Column:
    """By ending, which also takes in names like changelog.md."""
    return path.endswith("index.md") | path.endswith("log.md")


def toc_entry(pages: DataFrame, today: str) -> DataFrame:
    """Contents rows of pages with their defaults."""
    return pages.select(
        "path",
        F.coalesce(F.nullif("title", F.lit("")), F.col("path")).alias("title"),
        F.coalesce("type", F.lit("concept")).alias("type"),
        F.coalesce("summary", F.lit("(no summary)")).alias("summary"),
        F.coalesce("updated", F.lit(today)).alias("updated"),
    )


def with_contents(docs: DataFrame, toc: DataFrame) -> DataFrame:
    """Documents with their row of the contents: title (else the path), tags, summary; what search takes as title and rest.

    ``docs``: path, text; ``toc``: path, title, tags, summary. Of several rows of a path one counts.
    """
    rows = toc.dropDuplicates(["path"]).select("path", "title", "tags", "summary")
    both = docs.join(rows, "path", "left")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    named = both.withColumn("title", F.coalesce("title", "path")).withColumn("tags", tags).withColumn("summary", F.coalesce("summary", F.lit("")))
    return named.withColumn("rest", F.concat_ws(" ", F.array_join("tags", " "), "summary"))


def page_state(files: DataFrame) -> DataFrame:
    """One row: the number of pages and the newest change of one; generated files don't count. ``files``: path, mtime."""
    return files.where(F.col("path").endswith(".md") & ~is_generated(F.col("path"))).agg(F.count(F.lit(1)).alias("pages"), F.max("mtime").alias("newest"))


def recently_updated(toc: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` rows of the contents that were updated last, the index and log aside; equal dates by path."""
    return toc.where(~F.col("path").isin("index.md", "log.md")).orderBy(F.desc("updated"), "path").limit(n)


def recent_headings(log: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` headings of a log, in its order. ``log``: text; a heading begins with ``## [``."""
    lines = log.select(F.posexplode(F.split("text", r"\r?\n")).alias("at", "heading")).where(F.col("heading").startswith("## ["))
    return lines.orderBy(F.desc("at")).limit(n).orderBy("at")


def log_entry(today: str, op: str, title: str, details: list[str]) -> str:
    """An operation's block in the log: its heading, and a line for each detail."""
    return "\n".join([f"## [{today}] {op} | {title}", *(f"- {x}" for x in details), ""])


def topic_listing(toc: DataFrame, size: int = 100) -> DataFrame:
    """(topic, page, at, path, title): each topic's rows by title, in pages of ``size``."""
    topic = topic_of(F.col("path"))
    order = Window.partitionBy("topic").orderBy("title", "path")
    rows = toc.select(topic.alias("topic"), "path", "title").withColumn("_n", F.row_number().over(order) - 1)
    return rows.select("topic", F.floor(F.col("_n") / size).cast("int").alias("page"), (F.col("_n") % size).cast("int").alias("at"), "path", "title")


def stale_tables(tables: DataFrame, toc: DataFrame) -> DataFrame:
    """Topics' tables whose topic the contents no longer have. ``tables``: name (without ending)."""
    from loreweave.functions.text import topic_slug

    topics = toc.select(topic_slug(topic_of(F.col("path"))).alias("name")).distinct()
    return tables.select("name").distinct().join(topics, "name", "left_anti")


def finding_counts(findings: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(finding, n): how often each was found; ``kinds`` that weren't have 0."""
    found = findings.groupBy("finding").agg(F.count(F.lit(1)).alias("n"))
    if not kinds:
        return found
    named = findings.sparkSession.createDataFrame([(k,) for k in kinds], "finding string")
    return named.join(found, "finding", "left").select("finding", F.coalesce("n", F.lit(0)).alias("n"))


def toc_filter(toc: DataFrame, topic: str | None = None, tag: str | None = None, query: str | None = None) -> DataFrame:
    if topic:
        toc = toc.where(F.col("path").startswith(f"{topic}/"))
    if tag:
        toc = toc.where(F.array_contains("tags", tag))
    if query:
        low = query.lower()
        toc = toc.where(F.contains(F.lower("title"), F.lit(low)) | F.contains(F.lower("summary"), F.lit(low)))
    return toc


def reconcile(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """(path, finding): pages that the contents lack, rows whose page is gone, rows that differ in date or summary."""
    old = toc.select("path", F.col("updated").alias("u"), F.col("summary").alias("s"), F.lit(True).alias("listed"))
    both = pages.select("path", "updated", "summary", F.lit(True).alias("there")).join(old, "path", "full")
    differs = ~(F.col("updated").eqNullSafe(F.col("u")) & F.col("summary").eqNullSafe(F.col("s")))
    finding = F.when(F.col("listed").isNull(), "added").when(F.col("there").isNull(), "missing_file").when(differs, "updated")
    return both.select("path", finding.alias("finding")).where("finding is not null")


def resolved_path(page: Column, link: Column) -> Column:
    """A link's target relative to the root, seen from its page: ``.`` goes, ``..`` takes the folder before it.

    What climbs over the root keeps its ``..`` and so names nothing inside.
    """
    folder = F.regexp_replace(page, "[^/]*$", "")
    whole = F.when(link.startswith("/"), F.regexp_replace(link, "^/+", "")).otherwise(F.concat(folder, link))
    parts = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))
    none = F.array().cast("array<string>")

    def step(kept: Column, x: Column) -> Column:
        climbs = (x == "..") & (F.size(kept) > 0) & (F.coalesce(F.element_at(kept, -1), F.lit("")) != "..")
        return F.when(climbs, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))

    return F.array_join(F.aggregate(parts, none, lambda kept, x: F.when(F.size(kept) == 0, F.array(x)).otherwise(step(kept, x))), "/")


def resolved_links(links: DataFrame) -> DataFrame:
    """(page, target): link targets made relative to the root, see ``resolved_path``. ``links``: page, link."""
    return links.select("page", resolved_path(F.col("page"), F.col("link")).alias("target")).where("target <> ''")


def broken_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Resolved links whose target is no file. ``files``: path."""
    return links.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_anti").select("page", "target").distinct()


def orphans(pages: DataFrame, links: DataFrame, today: str, min_age_days: int = 7) -> DataFrame:
    """Pages that no other page links to; pages updated within the days are let off, pages without a date aren't."""
    inbound = links.where("page <> target").select(F.col("target").alias("path")).distinct()
    young = F.coalesce(F.col("updated") >= F.date_format(F.date_sub(F.lit(today).cast("date"), min_age_days), "yyyy-MM-dd"), F.lit(False))
    return pages.where(~young).join(inbound, "path", "left_anti").select("path")


def link_degrees(links: DataFrame) -> DataFrame:
    """(page, n_out, n_in) over distinct links."""
    edges = links.distinct()
    out = edges.select(F.col("page").alias("page"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = edges.select(F.col("target").alias("page"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("page").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def topic_counts(pages: DataFrame) -> DataFrame:
    """(topic, n), most pages first; equal ones by name."""
    return pages.groupBy(topic_of(F.col("path")).alias("topic")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic")


def entries_hash(toc: DataFrame) -> DataFrame:
    """One row: a fingerprint of one collection's contents, of all rows in order of path (16 hex digits).

    The hash runs over the rows in order, so a collection's contents table (a line a page) is gathered in one row.
    """
    row = F.concat_ws("\u0000", "path", "title", "type", F.array_join("tags", " "), "summary", "updated")
    listed = F.array_sort(F.collect_list(F.struct("path", row.alias("row"))))
    return toc.agg(F.substring(F.sha2(F.array_join(F.transform(listed, lambda x: x["row"]), "\n"), 256), 1, 16).alias("entries_hash"), F.count(F.lit(1)).alias("pages"))


def backlog(raw: DataFrame, pages: DataFrame, text: str = "text") -> DataFrame:
    """Raw files (sessions aside) whose name stands in no page's text. ``raw``: path.

    Names are looked up as substrings, see ``held_names``.
    """
    own = raw.where(~F.col("path").startswith("raw/sessions/")).withColumn("name", base_name(F.col("path")))
    named = held_names(pages.select(text), own.select("name").distinct(), text, keep=[]).select("name").distinct()
    return own.join(named, "name", "left_anti").select("path")


def module_of(path: Column) -> Column:
    """The module of a code file: its first folder, or two of them under a folder of modules."""
    parts = F.split(path, "/")
    deep = F.element_at(parts, 1).isin("src", "packages", "apps", "lib", "modules") & (F.size(parts) > 2)
    return F.when(F.size(parts) == 1, "(root)").when(deep, F.concat_ws("/", F.get(parts, 0), F.get(parts, 1))).otherwise(F.get(parts, 0))


#: Files by which a project is entered.
ENTRIES = ("src/index.ts", "src/main.ts", "src/extension.ts", "src/index.js", "index.js", "main.py", "src/main.rs", "src/main.go")


def is_entry(path: Column) -> Column:
    return path.isin(*ENTRIES) | path.rlike(r"^src/(cli|server|index)\.(ts|js|py)$")


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src_module, dst_module): distinct relative imports between two modules that both exist. ``imports``: path, spec."""
    known = files.select(module_of(F.col("path")).alias("module")).distinct()
    target = resolved_links(imports.where(F.col("spec").startswith(".")).select(F.col("path").alias("page"), F.col("spec").alias("link")))
    edges = target.select(module_of(F.col("page")).alias("src_module"), module_of(F.col("target")).alias("dst_module")).where("src_module <> dst_module").distinct()
    return edges.join(known.withColumnRenamed("module", "src_module"), "src_module", "left_semi").join(known.withColumnRenamed("module", "dst_module"), "dst_module", "left_semi")


def modules(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, n_files, imports, imported_by, entry): what each module holds and touches."""
    own = files.groupBy(module_of(F.col("path")).alias("module")).agg(
        F.count(F.lit(1)).alias("n_files"), F.bool_or(is_entry(F.col("path"))).alias("entry")
    )
    out = edges.groupBy(F.col("src_module").alias("module")).agg(F.sort_array(F.collect_set("dst_module")).alias("imports"))
    into = edges.groupBy(F.col("dst_module").alias("module")).agg(F.sort_array(F.collect_set("src_module")).alias("imported_by"))
    none = F.array().cast("array<string>")
    return own.join(out, "module", "left").join(into, "module", "left").select("module", "n_files", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"), "entry")


def stale_references(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file): declared files that don't exist. ``pages``: path, files."""
    return pages.select("path", F.explode("files").alias("file")).join(files.select(F.col("path").alias("file")).distinct(), "file", "left_anti").select("path", "file")


def integrity(index: DataFrame, raw: DataFrame) -> DataFrame:
    """(path, finding): raw sources that are missing, or whose text has neither hash. ``index``: path, sha; ``raw``: path, text."""
    both = index.join(raw, "path", "left")
    ok = (F.sha2("text", 256) == F.col("sha")) | (F.sha2(F.rtrim("text"), 256) == F.col("sha"))
    return both.select("path", F.when(F.col("text").isNull(), "missing").when(~ok, "drifted").alias("finding")).where("finding is not null")
