"""Folders, patches, embedded JSON, test logs: small formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_dir(path: Column) -> Column:
    """A folder without a mounted drive's prefix and closing slashes; drive paths in lower case."""
    unmounted = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^//wsl(\\.localhost|\\$)?/[^/]+", "")
    short = F.regexp_replace(unmounted, "(?<=.)/+$", "")
    return F.when(short.rlike("^[A-Za-z]:"), F.lower(short)).otherwise(short)


def same_dir(a: Column, b: Column) -> Column:
    return bare_dir(a) == bare_dir(b)


def project_slug(path: Column) -> Column:
    """The name of a project's folder of sessions: separators as dashes between double dashes."""
    return F.concat(F.lit("--"), F.regexp_replace(F.regexp_replace(path, r"^[/\\]+", ""), r"[/\\:]", "-"), F.lit("--"))


def json_slice(text: Column) -> Column:
    """What stands from the first brace to the last one, code fences aside; null if it doesn't parse."""
    bare = F.regexp_replace(text, r"```[a-z]*", "")
    cut = F.regexp_extract(bare, r"(\{[\s\S]*\})", 1)
    return F.when(F.try_parse_json(F.nullif(cut, F.lit(""))).isNotNull(), cut)


def code_patch(patch: Column, dropped: tuple[str, ...]) -> Column:
    """A unified diff without the files whose path begins with one of ``dropped``."""
    parts = F.filter(F.split(patch, r"(?m)^(?=diff --git )"), lambda p: p != "")
    path = lambda p: F.regexp_extract(p, r"^diff --git a/(\S+)", 1)
    keep = F.filter(parts, lambda p: ~F.coalesce(*[F.when(path(p).startswith(d), True) for d in dropped], F.lit(False)))
    return F.array_join(keep, "")


def failure_kind(log: Column) -> Column:
    """Why a test run failed: assertions, collection or unknown; colours aside."""
    plain = F.regexp_replace(log, "\u001b\\[[0-9;]*m", "")
    return (
        F.when(plain.rlike(r"(?i)AssertionError|expected .* (to|received)|[1-9][0-9]* (failed|failing)"), "assertions")
        .when(plain.rlike(r"(?i)cannot find module|SyntaxError|no tests? (found|ran)|failed to (load|collect)"), "collection")
        .otherwise("unknown")
    )


def fingerprint(model: Column, version: Column, kind: Column, dims: Column) -> Column:
    """The identity of an embedding: id@vVersion:type:dims."""
    return F.format_string("%s@v%s:%s:%s", model, version.cast("string"), kind, dims.cast("string"))


#: How two kinds of embedders want their inputs worded, for queries and for documents.
PROMPTS = {
    "performance": ("task: search result | query: %s", "title: %s | text: %s", "none"),
    "quality": ("Instruct: Given a search query, retrieve relevant passages\nQuery:%s", "%s — %s", None),
}


def query_prompt(preset: str, query: Column) -> Column:
    return F.format_string(PROMPTS[preset][0], query)


def document_prompt(preset: str, title: Column, text: Column) -> Column:
    """A document as its embedder wants it; without a title its stand-in, or the text alone."""
    _, both, missing = PROMPTS[preset]
    named = F.nullif(title, F.lit(""))
    if missing is not None:
        return F.format_string(both, F.coalesce(named, F.lit(missing)), text)
    return F.when(named.isNull(), text).otherwise(F.format_string(both, named, text))


def content_text(blocks: Column, most: int = 200) -> Column:
    """Text blocks of a message joined by line breaks; calls as a marker with name and the first ``most`` characters of
    their arguments. ``blocks``: type, text, name, arguments (JSON)."""
    shown = F.transform(
        blocks,
        lambda b: F.when(b["type"] == "text", b["text"]).when(
            b["type"] == "toolCall", F.concat(F.lit("[tool "), F.concat_ws(" ", b["name"], F.nullif(F.substring(b["arguments"], 1, most), F.lit(""))), F.lit("]"))
        ),
    )
    return F.array_join(F.filter(shown, lambda x: x.isNotNull()), "\n")


def speaker_line(role: Column, text: Column) -> Column:
    """A transcript's paragraph of a user or an assistant; null for others and for empty texts."""
    bare = F.trim(text)
    name = F.when(role == "user", "User").when(role == "assistant", "Assistant")
    return F.when(name.isNotNull() & (bare != ""), F.concat(name, F.lit(": "), bare))


def tail(text: Column, most: int = 24_000) -> Column:
    """The last ``most`` characters."""
    return F.when(F.length(text) > most, F.right(text, F.lit(most))).otherwise(text)


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def clock(ts: Column) -> Column:
    """Hours and minutes, without a mark between them."""
    return F.date_format(ts, "HHmm")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end; null if it ends before it starts."""
    gap = F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
    return F.when(gap >= 0, gap)


# --- for people to read ------------------------------------------------------------------------------------------


def whole(value: Column) -> Column:
    return F.format_number(F.round(value), 0)


def usd(value: Column) -> Column:
    """Dollars: none as $0, under a cent with five digits, else with two."""
    return F.when(value == 0, "$0").when(value < 0.01, F.format_string("$%.5f", value)).otherwise(F.format_string("$%.2f", value))


def share(value: Column) -> Column:
    """A share in per cent with one digit; n/a if there is none."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.1f%%", value * 100))


def chars(value: Column) -> Column:
    return (
        F.when(value < 1000, F.concat(whole(value), F.lit(" chars")))
        .when(value < 1_000_000, F.format_string("%.1fk chars", value / 1000))
        .otherwise(F.format_string("%.2fM chars", value / 1_000_000))
    )


def duration(ms: Column) -> Column:
    """Seconds under a minute, else minutes and seconds; a dash if there is none."""
    rest = F.lpad(F.round((ms % 60_000) / 1000).cast("int").cast("string"), 2, "0")
    long = F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m"), rest, F.lit("s"))
    return F.when(ms.isNull(), "—").when(ms < 60_000, F.concat(F.round(ms / 1000).cast("int").cast("string"), F.lit("s"))).otherwise(long)


def cell(text: Column) -> Column:
    """A table's cell: bars escaped, line breaks as blanks, trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), "\r?\n", " "))


def truncated_text(text: Column, most: int) -> Column:
    """The text, or its first ``most`` characters and a mark."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("\n\n[... truncated ...]")))


def topic_link(slug: Column) -> Column:
    """A link to a topic's own table."""
    path = F.concat(F.lit("toc/"), slug, F.lit(".md"))
    return F.concat(F.lit("["), path, F.lit("]("), path, F.lit(")"))


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
