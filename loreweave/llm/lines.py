"""Operator 3, quality rules: document statistics and cross-document line frequency, in native expressions only.

A document fails the base rules if it has few words or many repeated five-word windows. Beyond them, every line is
normalised (lower case, blanks collapsed) and hashed; the distinct texts of a host that hold the line are counted;
lines over the host's limit are removed, and a document that loses too much of itself is rejected.
Copies of one text count once, so that a document isn't held against itself.

A host's frequent lines are few: if more than a twentieth of its texts hold each, there are at most twenty times as many
as lines in a text. As long as their number stays under a bound, hosts carry theirs to the documents, and a document is
judged where it is read; beyond it the lines of all documents meet the frequent ones in a join. Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, cut_lineage

SYMBOLS = "#*$%&|<>"
SPAN = 5
#: Blanks but the line's end.
INNER_BLANKS = r"[\x20\x09\x0B-\x0D]+"


def split_words(text: Column) -> Column:
    """Words between ASCII blanks; no words for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def collapsed_lines(text: Column) -> Column:
    """The lines of a text with blanks collapsed."""
    return F.split(F.regexp_replace(text, INNER_BLANKS, " "), "\n")


def line_hash(line: Column) -> Column:
    """Of a collapsed line, lower-cased and trimmed; null if it has no word."""
    bare = F.btrim(line, F.lit(" "))
    return F.when(bare != "", F.xxhash64(F.lower(bare)))


def line_chars(line: Column) -> Column:
    """Word characters of a collapsed line."""
    return F.length(F.replace(line, F.lit(" "), F.lit(""))).cast("long")


def gram_hashes(words: str) -> Column:
    """Hashes of the five-word windows by position; null if there are fewer than two. ``words`` names a column."""
    at = [lambda i, k=k: F.get(F.col(words), i + k) for k in range(SPAN)]
    return F.when(
        F.size(words) > SPAN,
        F.transform(F.sequence(F.lit(0), F.size(words) - SPAN), lambda i: F.xxhash64(*[f(i) for f in at])),
    )


def statistics(docs: DataFrame, *more: Column) -> DataFrame:
    """The contract's base figures of ``docs`` rows, with ``more`` columns; one pass, nothing shuffled.

    Null text counts as empty. Other columns of ``docs`` are not carried.
    """
    text = _text()
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, BLANKS) != "")
    one = docs.select(
        F.struct("doc_id", *more).alias("_more"),
        F.length(_without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        split_words(F.col("text")).alias("_words"),
        lines.alias("_lines"),
    )
    two = one.select(
        "_more",
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        gram_hashes("_words").alias("_grams"),
    )
    three = two.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_grams")) < F.size("_grams"),
            F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )

    def twin(x: Column, i: Column) -> Column:
        near = [F.get(F.col("_sorted"), j)["h"] for j in (i - 1, i + 1)]
        return F.coalesce(near[0] == x["h"], F.lit(False)) | F.coalesce(near[1] == x["h"], F.lit(False))

    four = three.withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", twin), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(
            "_starts",
            lambda p, j: F.least(F.lit(SPAN), F.coalesce(F.get(F.col("_starts"), j + 1), p + SPAN) - p).cast("long"),
        ),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return four.select(
        "_more.*",
        # not deterministic, so that a filter on the figures stays above them and doesn't evaluate them over and over
        F.monotonically_increasing_id().alias("_figures"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def line_rows(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row for each line that has a word: hash of the text, host, place, word characters, hash of the normalised line."""
    return (
        docs.select(F.xxhash64(_text()).alias("_text"), _host(host).alias("_host"), F.posexplode(collapsed_lines(_text())).alias("_at", "_line"))
        .select("_text", "_host", "_at", line_chars(F.col("_line")).alias("_chars"), line_hash(F.col("_line")).alias("_hash"))
        .where("_hash is not null")
    )


def frequent_lines(docs: DataFrame, share: float, least: int, host: str = "source") -> DataFrame:
    """(_host, _hash) of lines that over ``least`` and over ``share`` of the host's distinct texts hold."""
    many = line_rows(docs, host).groupBy("_host", "_hash").agg(F.countDistinct("_text").alias("_n")).where(F.col("_n") > least)
    sizes = docs.select(_host(host).alias("_host"), F.xxhash64(_text()).alias("_text")).groupBy("_host").agg(F.countDistinct("_text").alias("_docs"))
    return many.join(sizes, "_host").where(F.col("_n") > F.lit(share) * F.col("_docs")).select("_host", "_hash")


def _carried(docs: DataFrame, frequent: DataFrame, host: str) -> DataFrame:
    """``docs``, each row as a struct _row, with its frequent lines (place and word characters); hosts carry theirs to it."""
    by_host = frequent.groupBy("_host").agg(F.collect_list("_hash").alias("_frequent"))
    rows = docs.select(F.struct(*_all(docs)).alias("_row"), _host(host).alias("_host")).join(F.broadcast(by_host), "_host", "left")
    hit = lambda x: F.array_contains("_frequent", line_hash(x))
    listed = F.transform(collapsed_lines(F.coalesce(F.col("_row.text"), F.lit(""))), lambda x, i: F.when(hit(x), F.struct(i.alias("at"), line_chars(x).alias("chars"))))
    return rows.select("_row", F.when(F.col("_frequent").isNotNull(), F.filter(listed, lambda x: x.isNotNull())).alias("_gone"))


def _joined(docs: DataFrame, frequent: DataFrame, host: str) -> DataFrame:
    """The same by a join of all lines with the frequent ones, whatever their number."""
    line = F.struct(F.col("_at").alias("at"), F.col("_chars").alias("chars"))
    gone = line_rows(docs, host).join(frequent, ["_host", "_hash"]).groupBy("_text", "_host").agg(F.sort_array(F.collect_set(line)).alias("_gone"))  # copies in one host have the same places
    rows = docs.select(F.struct(*_all(docs)).alias("_row"), F.xxhash64(_text()).alias("_text"), _host(host).alias("_host"))
    return rows.join(gone.hint("shuffle_hash"), ["_text", "_host"], "left").select("_row", "_gone")


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def judged(docs: DataFrame, share: float = 0.05, least: int = 5, keep: float = 0.25, host: str = "source", most: int = 100_000, each: int = 1_000) -> DataFrame:
    """Every row of ``docs`` as a struct _row, with its base figures, the places of its lines that go and the verdict.

    Hosts carry their frequent lines if there are at most ``most`` in all and ``each`` in a host; else lines are joined.
    """
    frequent = cut_lineage(frequent_lines(docs, share, least, host))
    sizes = frequent.groupBy("_host").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.max("count"), F.lit(0)).alias("widest")).head()
    marked = (_carried if sizes["n"] <= most and sizes["widest"] <= each else _joined)(docs, frequent, host)
    gone = F.coalesce(F.col("_gone"), F.array().cast("array<struct<at:int,chars:bigint>>"))
    lost = F.aggregate(gone, F.lit(0).cast("long"), lambda total, x: total + x["chars"])
    rows = marked.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), "_row", gone.alias("_gone"), lost.alias("removed_chars"))
    base = statistics(rows, F.col("_row"), F.col("_gone"), F.col("removed_chars"))
    failed = (F.col("_figures") >= 0) & ((F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words")))
    return base.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("word_chars") - F.col("removed_chars") >= F.lit(keep) * F.col("word_chars")))


def judge(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, base figures, ``removed_chars`` (word characters in frequent lines), ``base_failed`` and ``kept``.

    ``kept`` is false if the base rules fail or less than ``keep`` of the word characters remain. Null texts are empty.
    A null host is a host of its own; repeated rows are judged alike, copies under several hosts by each row's own; ties
    need no rule, as nothing is chosen; an empty table gives no rows; other columns are ignored. See ``judged``.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col(limits.get("host", "source")))
    return judged(own, **limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_chars", "base_failed", "kept")


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The kept rows of ``docs``, all columns, without the lines that are over their host's limit; n_chars follows.

    Null and empty texts have no words and go. Columns of any name are kept; see ``judge`` for the rest.
    """
    rows = judged(docs, **limits).where("kept")
    text, fewer = F.col("_row.text"), F.size("_gone") > 0
    # bound once for all lines
    both = F.array(F.struct(F.split(text, "\n").alias("lines"), F.transform("_gone", lambda x: x["at"]).alias("gone")))
    left = F.get(F.transform(both, lambda s: F.array_join(F.filter(s["lines"], lambda x, i: ~F.array_contains(s["gone"], i)), "\n")), 0)
    new = {"text": F.when(fewer, left).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(fewer, F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return rows.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
