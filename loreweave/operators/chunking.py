"""Sections, windows and chunks of pages, and the incremental index over them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import BLANKS, section_slug, strip_inline, trim_blanks, without_marks

from loreweave.session import spread

from .curation import is_active

MOST, OVERLAP, LEAST = 4800, 640, 80


def unique_paths(pages: DataFrame) -> bool:
    """Whether no path has two rows: then ``sections`` and ``chunks`` need not move texts. Only paths are read."""
    return pages.where("path is not null").groupBy("path").count().where("count > 1").isEmpty()


def sections(pages: DataFrame, keep: tuple[str, ...] = (), unique: bool = False) -> DataFrame:
    """(path, section, heading, slug, body): a page cut at its headings; what stands before the first is ``overview``.

    A line of one to six # and white space is a heading, in code fences too; one without a text is named ``overview``.
    Headings lose emphasis and code marks; the lines between them lose those, links' targets and trailing white space.
    Sections without a text go before slugs are numbered: repeated slugs of a page get -2, -3 and so on. ``section``
    counts headings. ``pages``: path, text, and columns to ``keep``. Pages move once, by path, and are cut where they are;
    if paths are ``unique`` (see ``unique_paths``), none moves.
    """
    if unique:
        each = _sectioned(pages, keep).select("path", *keep, F.inline_outer("_parts"))
        return each.where("section is not null").select("path", *keep, "section", "heading", "slug", "body")
    mark = f"#{{1,6}}[{BLANKS.replace(chr(10), '')}]+"
    head = rf"{mark}[^\n\r\u2028\u2029]*(?![^\n])"
    plain = F.concat(F.lit("\n"), F.replace("text", F.lit("\r\n"), F.lit("\n")))  # so that the first part has no heading
    each = pages.repartition("path").select("path", *keep, F.posexplode(F.split(plain, f"\n(?={head})")).alias("at", "part"))
    numbered = each.select("path", *keep, F.col("at").cast("long").alias("section"), F.split("part", "\n").alias("lines"))
    title = F.when(F.col("section") > 0, trim_blanks(without_marks(F.regexp_replace(F.get("lines", F.lit(0)), "^" + mark, ""))))
    own = F.slice("lines", F.when(F.col("section") > 0, 2).otherwise(1), F.size("lines"))
    body = trim_blanks(F.array_join(F.transform(own, strip_inline), "\n"))
    cut = numbered.select("path", *keep, "section", F.coalesce(F.nullif(title, F.lit("")), F.lit("overview")).alias("heading"), body.alias("body"))
    # filtered after the window only, as a filter before it would make each body twice
    full, order = F.col("body") != "", Window.partitionBy("path", "base").orderBy("section")
    nth = F.sum(F.when(full, 1).otherwise(0)).over(order)
    named = cut.withColumn("base", section_slug(F.col("heading"))).withColumn("nth", nth).where(full)
    return named.withColumn("slug", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "nth"))).select("path", *keep, "section", "heading", "slug", "body")


def _sectioned(pages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``pages`` (path, text, ``keep``), each with an array of its sections (section, heading, slug, body), see ``sections``."""
    mark = f"#{{1,6}}[{BLANKS.replace(chr(10), '')}]+"
    head = rf"{mark}[^\n\r\u2028\u2029]*(?![^\n])"

    def part(x: Column, at: Column) -> Column:
        title = F.when(at > 0, trim_blanks(without_marks(F.regexp_replace(F.substring_index(x, "\n", 1), "^" + mark, ""))))
        own = F.slice(F.split(x, "\n"), F.when(at > 0, 2).otherwise(1), F.lit(1 << 30))
        body = trim_blanks(F.array_join(F.transform(own, strip_inline), "\n"))
        return F.struct(at.cast("long").alias("section"), F.coalesce(F.nullif(title, F.lit("")), F.lit("overview")).alias("heading"), body.alias("body"))

    def named(x: Column, at: Column) -> Column:
        nth = F.when(F.col("_again"), F.size(F.filter(F.slice("_bases", F.lit(1), at + 1), lambda b: b == F.get("_bases", at)))).otherwise(1)
        base = F.get("_bases", at)
        return F.struct(x["section"].alias("section"), x["heading"].alias("heading"), F.when(nth == 1, base).otherwise(F.concat_ws("-", base, nth)).alias("slug"), x["body"].alias("body"))

    plain = F.concat(F.lit("\n"), F.replace("text", F.lit("\r\n"), F.lit("\n")))
    cut = spread(pages.select("path", *keep, "text")).select("path", *keep, F.transform(F.split(plain, f"\n(?={head})"), part).alias("_cut"))
    full = cut.select("path", *keep, F.filter("_cut", lambda x: x["body"] != "").alias("_full"))
    based = full.select("path", *keep, "_full", F.transform("_full", lambda x: section_slug(x["heading"])).alias("_bases"))
    told = based.select("*", (F.size(F.array_distinct("_bases")) < F.size("_bases")).alias("_again"))
    return told.select("path", *keep, F.transform("_full", named).alias("_parts"))


def window_ends(text: str, most: int = MOST, overlap: int = OVERLAP) -> list[int]:
    """Starts and ends, in turn, of overlapping windows that aren't blank; one ends at the last blank line of its reach if
    that lies beyond its middle."""
    out, start = [], 0
    while True:
        end = min(start + most, len(text))
        if end < len(text):
            at = text.rfind("\n\n", 0, end + 2)
            end = at if at > start + most * 0.5 else end
        if text[start:end].strip(BLANKS):
            out += [start, end]
        if end >= len(text):
            return out
        start = max(end - overlap, start + 1)


def cut_windows(text: str, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """The windows of a text (see ``window_ends``) without the white space around them; a short text as it is."""
    if len(text) <= most:
        return [text]
    ends = window_ends(text, most, overlap)
    return [text[a:b].strip(BLANKS) for a, b in zip(ends[::2], ends[1::2], strict=True)]


def windows(parts: DataFrame, most: int = MOST, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, slug, heading, n, text): the windows of each section, and columns to ``keep``. Only long ones go to Python."""

    @F.pandas_udf("array<string>")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: cut_windows(b, most, overlap) if isinstance(b, str) else None)

    rows = parts.withColumn("_cut", run(F.when(F.length("body") > most, F.col("body"))))
    each = rows.select("path", "slug", "heading", *keep, F.posexplode(F.coalesce("_cut", F.array("body"))).alias("n", "text"))
    return each.select("path", "slug", "heading", *keep, (F.col("n") + 1).alias("n"), "text")


def _windowed(pages: DataFrame, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(path, title, key, text): the windows of ``pages`` (path, title, text; no path has two rows) as ``chunks`` keys them."""

    @F.pandas_udf("array<array<int>>")  # texts don't come back
    def run(pages_: pd.Series) -> pd.Series:
        return pages_.map(lambda bodies: None if bodies is None else [window_ends(b, most, overlap) if isinstance(b, str) else None for b in bodies])

    def keyed(x: Column, at: Column) -> Column:
        ends = F.get("_cut", at)
        long = F.transform(F.filter(ends, lambda _, n: n % 2 == 0), lambda a, n: trim_blanks(F.substring(x["body"], a + 1, F.get(ends, 2 * n + 1) - a)))
        own = F.transform(F.coalesce(long, F.array(x["body"])), lambda t, n: F.struct(F.concat(F.lit("section:"), x["slug"], F.when(n > 0, F.concat(F.lit("-"), n + 1)).otherwise(F.lit(""))).alias("key"), t.alias("text")))
        return F.filter(own, lambda c: F.length(c["text"]) >= LEAST)

    rows = _sectioned(pages, ("title",)).withColumn("_cut", run(F.transform("_parts", lambda x: F.when(F.length(x["body"]) > most, x["body"]))))
    ordered = rows.select("path", "title", F.array_sort(F.flatten(F.transform("_parts", keyed))).alias("_all"))
    last = F.filter("_all", lambda x, at: F.coalesce(F.get("_all", at + 1)["key"] != x["key"], F.lit(True)))
    return ordered.select("path", "title", F.inline_outer(last)).where("key is not null")


def chunks(pages: DataFrame, claims: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """(path, key, kind, claim_id, status, title, text, hash): a page's active claims and its sections' windows.

    ``claims``: path, id, text, status; one without an id is keyed by a slug of its text, blank ones are left out. Windows
    under 80 characters are left out. The title is the page's, and the hash is of title and text. Where keys of a page
    fall together, the one last in the order of text stays. If paths are ``unique`` (see ``unique_paths``), no text moves.
    """
    none = F.lit(None).cast("string")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.regexp_replace("path", r"\.md$", ""))
    own = pages.where("path is not null").select("path", "text", title.alias("title"))
    fixed = (F.lit("page-section").alias("kind"), none.alias("claim_id"), none.alias("status"), "title", "text")
    if unique:
        out = _windowed(own).select("path", "key", *fixed)
    else:
        cut = windows(sections(own, ("title",)), keep=("title",)).where(F.length("text") >= LEAST)
        key = F.concat(F.lit("section:"), "slug", F.when(F.col("n") > 1, F.concat(F.lit("-"), "n")).otherwise(F.lit("")))
        out = cut.select("path", key.alias("key"), *fixed)
    if claims is not None:
        active = claims.where(is_active(F.col("status"), "index")).withColumn("text", trim_blanks(F.col("text"))).where("text <> ''").join(pages.select("path", title.alias("title")), "path")
        own = F.concat(F.lit("claim:"), F.coalesce("id", section_slug(F.col("text"))))
        told = active.select("path", own.alias("key"), F.lit("claim").alias("kind"), F.nullif("id", F.lit("")).alias("claim_id"), F.nullif("status", F.lit("")).alias("status"), "title", "text")
        # keys of claims begin with another word than those of sections
        out = out.unionByName(_last(told) if unique else told)
    hashed = out.withColumn("hash", F.sha2(F.concat_ws("\n", "title", "text"), 256))
    return hashed if unique else _last(hashed)


def _last(rows: DataFrame) -> DataFrame:
    """Of each key of a path the row that is last in the order of text."""
    last = Window.partitionBy("path", "key").orderBy(F.desc("text"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def anchor(chunk_key: Column, kind: Column, claim_id: Column) -> Column:
    """What a hit in a chunk points to on its page: the claim's id, else the section's slug, else the key."""
    return F.coalesce(claim_id, F.when(kind == "page-section", F.regexp_replace(chunk_key, "^section:", "")), chunk_key)


def index_diff(current: DataFrame, stored: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(path, key, action): embed new or changed chunks, skip equal ones, remove what is gone; ``paths`` limits both sides."""
    if paths is not None:
        current, stored = (x.where(F.col("path").isin(paths)) for x in (current, stored))
    old = stored.select("path", "key", F.col("hash").alias("old"))
    both = current.select("path", "key", "hash").join(old, ["path", "key"], "full")
    action = F.when(F.col("hash").isNull(), "remove").when(F.col("hash") == F.col("old"), "skip").otherwise("embed")
    return both.select("path", "key", action.alias("action"))


def upsert(stored: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("wiki", "path", "key")) -> DataFrame:
    """``stored`` with ``rows`` in place of what has their keys."""
    return stored.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)


def delete(stored: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("wiki", "path", "key")) -> DataFrame:
    return stored.join(gone.select(*keys), list(keys), "left_anti")


def counts(stored: DataFrame) -> DataFrame:
    """(wiki, fingerprint, chunks), by wiki."""
    return stored.groupBy("wiki", "fingerprint").agg(F.count(F.lit(1)).alias("chunks")).orderBy("wiki", "fingerprint")


def index_status(registry: DataFrame, state: DataFrame, fingerprint: str) -> DataFrame:
    """Enabled wikis with their index: chunks, and whether it is stale (made with another fingerprint) or missing."""
    both = registry.where("enabled").join(state, "wiki", "left")
    return both.select("wiki", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.col("fingerprint").isNull().alias("missing"), F.coalesce(F.col("fingerprint") != fingerprint, F.lit(False)).alias("stale"))
