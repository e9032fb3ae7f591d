"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller may write and read again as the next
stage's docs. All but the last return the columns of ``documents``, and any others that the table has, whatever their
names. An empty table gives no rows in every stage; a text of any length is treated as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm import fmindex, lines, pieces, semicrf, simhash
from loreweave.llm.common import cut_lineage, fresh, map_text, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are over their host's limit.

    Null, empty and very short texts fail the base rules and go. A null host is a host of its own. Rows that repeat are
    judged alike and all stay or go; copies count once in a line's frequency.
    """
    return lines.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Null doc_ids come after all others, ties go to the least hash of the text, and of rows that repeat in both one
    stays. Null, empty and blank texts are near copies of each other.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that benchmark windows cover; a document of which no word is left goes.

    Null, empty and wordless texts stay as they are; rows that repeat are cut alike; overlapping spans are cut once.
    """
    words, spans, items = fresh(docs, "words", "spans", "items")
    found = fmindex.annotate(docs, table(spark, sf_dir, "benchmark"), (words, spans, items))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]))
    some = found.where((hit == 0) | (hit < F.col(words))).drop(words, items)

    def change(columns: dict[str, list]) -> list[str | None]:
        return [fmindex.without_spans(t, [(s["start"], s["end"]) for s in own]) for t, own in zip(columns["text"], columns[spans], strict=True)]

    return map_text(some, change, drop=(spans,))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked by its kind.

    Every row stays; null and empty texts stay as they are; rows that repeat are masked alike; where spans overlap the
    first one, by start and then kind, gives the mask.
    """
    return semicrf.mask(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number, hash, round trip and parity.

    Null and empty texts have no tokens; rows that repeat are encoded alike; other columns than doc_id and text go.
    """
    return pieces.encode(docs, tokens=True)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", mask_personal_data),
    ("SentencePiece encoding and decoding", tokenize),
]

#: SQL can express neither the near-duplicate components nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the checkpoint folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
