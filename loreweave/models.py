"""Boundaries to external models, with deterministic stand-ins: embedders and judges are columns to the operators."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dims: int

    def fingerprint(self) -> str: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed word hashes in a fixed number of cells, scaled to length 1."""

    def __init__(self, dims: int = 64, version: int = 1) -> None:
        self.dims, self.version = dims, version

    def fingerprint(self) -> str:
        return f"hashing@v{self.version}:f32:{self.dims}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[row, h % self.dims] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


def embed(rows: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """``rows`` with an embedding column, batch by batch."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed(texts.fillna("").tolist())))

    return rows.withColumn("embedding", run(F.col(text)))


class StaticJudge:
    """Judgements from fixed expressions; stands in for a remote model."""

    def __init__(self, answers: Mapping[str, Column | float]) -> None:
        self.answers = answers

    def judge(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in self.answers.items()})


class BatchJudge:
    """A judge that answers batches of texts: a function from texts to a mapping of column names to numbers."""

    def __init__(self, ask: Callable[[list[str]], Mapping[str, list[float]]], fields: tuple[str, ...], text: str = "text") -> None:
        self.ask, self.fields, self.text = ask, fields, text

    def judge(self, rows: DataFrame) -> DataFrame:
        ask, fields = self.ask, self.fields

        @F.pandas_udf(", ".join(f"{f} double" for f in fields))
        def run(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(dict(ask(texts.fillna("").tolist())))[list(fields)].astype(float)

        judged = rows.withColumn("_verdict", run(F.col(self.text)))
        return judged.select(*rows.columns, *[F.col(f"_verdict.{f}").alias(f) for f in fields])


class Unavailable(Exception):
    """An answer that a model's service refused; ``status`` 0 if it gave none, ``wait`` the seconds that it asks for."""

    def __init__(self, status: int = 0, wait: float | None = None) -> None:
        super().__init__(f"status {status}")
        self.status, self.wait = status, wait


def patiently(ask: Callable[[], Any], retries: int = 3, first: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Any:
    """An answer, asked for again while the service is overloaded, broken or not there: 429, 5xx and no status.

    The pauses double, or are as long as the service asks for. Other refusals, and the last one, are raised.
    """
    for attempt in range(retries + 1):
        try:
            return ask()
        except Unavailable as x:
            if attempt == retries or not (x.status in (0, 429) or x.status >= 500):
                raise
            sleep(x.wait if x.wait and x.wait > 0 else first * 2**attempt)
    raise AssertionError


def at_most(limit: int, ask: Callable[[Any], Any], items: Sequence[Any]) -> list[Any]:
    """Answers to all items in their order, ``limit`` at a time: how a task asks a service about its batch."""
    with ThreadPoolExecutor(max(1, min(limit, len(items) or 1))) as pool:
        return list(pool.map(ask, items))


# --- what judges are asked ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Question:
    """``kind``: chance (0 to 1), choice (one of ``options``) or level (0 to the last of ``options``)."""

    kind: str
    text: str
    options: tuple[str, ...] = ()


#: The answers that the rules know.
KINDS = ("architecture", "invariant", "decision", "gotcha", "procedure", "pattern", "fact")
TIERS = ("verified_in_repo", "source_document", "user_stated", "inference", "speculation")
RELATIONS = ("consistent", "extends", "contradicts", "supersedes", "unrelated")
PAGE_TYPES = ("architecture/module", "architecture/flow", "architecture/layer", "invariant", "decision", "gotcha", "concept", "source_summary")
IMPACTS = ("no_impact", "needs_recheck", "supersede", "contradict")


def claim_questions(candidates: int, topics: Sequence[str]) -> dict[str, Question]:
    """What a judge is asked about a claim: ten questions, two of them only beside existing claims, one only beside topics."""
    out = {
        "grounded": Question("chance", "Does the passage say this, or follow it directly?"),
        "derivable": Question("chance", "Could a developer read this off the code within a minute?"),
        "durable": Question("chance", "Will this still hold and help in a month?"),
        "sensitive": Question("chance", "Does this hold secrets or personal data that must not be kept?"),
        "kind": Question("choice", "What kind of knowledge is it?", KINDS),
        "importance": Question("level", "How much rests on it?", ("ephemeral", "contextual", "durable", "canonical")),
        "criticality": Question("level", "What would acting on it cost if it were wrong?", ("low", "moderate", "high", "critical")),
        "verifiable": Question("choice", "What is its strongest support?", TIERS),
    }
    if candidates:
        out["already_known"] = Question("chance", "Do the existing claims hold this already?")
        out["relation"] = Question("choice", "How does it stand to the existing claims?", RELATIONS)
    out["page_type"] = Question("choice", "What type of page should hold it?", PAGE_TYPES)
    if topics:
        out["topic"] = Question("choice", "Which topic should hold it?", (*topics[:100], "new_topic"))
    return out


def verdict(answers: Mapping[str, Any], kind: str, suggested: Callable[[str], str] = str) -> dict[str, Any]:
    """Answers to ``claim_questions`` as the columns that the rules read; missing ones count as 0, or stay empty.

    ``kind``: the claim's own, where the judge names none; ``suggested``: the topic for a kind where no topic fits.
    """
    number = lambda key: float(answers.get(key) or 0.0)
    told = str(answers.get("kind") or kind)
    topic = answers.get("topic")
    return {
        **{k: number(k) for k in ("grounded", "derivable", "durable", "sensitive", "already_known", "importance", "criticality")},
        "importance_norm": number("importance") / 3,
        "criticality_norm": number("criticality") / 3,
        "kind": told,
        "trust_tier": answers.get("verifiable"),
        "relation": answers.get("relation"),
        "page_type": answers.get("page_type"),
        "topic": suggested(told) if topic == "new_topic" else topic,
        "topic_is_new": topic == "new_topic",
    }


def impact_questions() -> dict[str, Question]:
    return {"impact": Question("choice", "What does this change of code do to the claim?", IMPACTS), "still_true": Question("chance", "Is the claim still true of the code?")}


def pair_questions(finding: str) -> dict[str, Question]:
    """About two claims that may contradict each other, or say the same."""
    if finding == "contradiction":
        return {"relation": Question("choice", "How do the two stand to each other?", ("consistent", "contradicts", "supersedes_a", "supersedes_b", "independent"))}
    return {"merge": Question("chance", "Do the two say the same, so that one of them is enough?")}


def retrieval_questions(candidates: int) -> dict[str, Question]:
    """About a query's best hits: whether all of them answer it, and how much each helps."""
    return {"sufficient": Question("chance", "Do the excerpts together answer the query?")} | {f"c{k}": Question("chance", "Does this excerpt help to answer the query?") for k in range(1, candidates + 1)}


# --- what writers and extractors give back -----------------------------------------------------------------------

EXTRACTION = "title string, summary string, topics array<string>, entities array<string>, claims array<struct<text:string,kind:string,quote:string,files:array<string>,confidence:double>>"
INSIGHTS = "insights array<struct<text:string,kind:string,evidence:array<struct<kind:string,ref:string,quote:string>>,confidence:double>>"


def extraction_input(text: Column, title: Column | None = None, most: int = 40_000) -> Column:
    """A source as an extractor gets it: cut at ``most`` characters, in its mark, behind its title."""
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n\n[... source truncated for extraction ...]"))).otherwise(text)
    body = F.concat(F.lit("<document>\n"), cut, F.lit("\n</document>"))
    if title is None:
        return body
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("Document title: "), title, F.lit("\n\n"), body)).otherwise(body)


def extracted_claims(answers: DataFrame, most: int = 40, files: int = 10) -> DataFrame:
    """(source, at, text, kind, quote, files, confidence) from an extractor's answers: the first ``most`` claims with a text.

    ``answers``: source, answer (text that holds a JSON object), text (the source's). A quotation that isn't in the
    source is dropped; a claim without a kind is a fact. Answers that don't parse give nothing.
    """
    from loreweave.functions.formats import json_slice
    from loreweave.operators.evidence import quote_holds

    parsed = answers.select("source", F.col("text").alias("_text"), F.from_json(json_slice(F.col("answer")), EXTRACTION).alias("e"))
    full = F.filter("e.claims", lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) != "")
    one = parsed.select("source", "_text", F.posexplode(F.slice(full, 1, most)).alias("at", "c"))
    quote = F.nullif(F.trim("c.quote"), F.lit(""))
    return one.select(
        "source", "at", F.trim("c.text").alias("text"), F.coalesce("c.kind", F.lit("fact")).alias("kind"), F.when(quote_holds(quote, F.col("_text")), quote).alias("quote"),
        F.slice(F.coalesce("c.files", F.array().cast("array<string>")), 1, files).alias("files"), F.col("c.confidence").alias("confidence"),
    )


def extracted_insights(answers: DataFrame, most: int = 8) -> DataFrame:
    """(source, at, text, kind, evidence, confidence) from a session's answers: the first ``most`` insights with a text.

    ``answers``: source, answer. Evidence without a kind or a reference is left out.
    """
    from loreweave.functions.formats import json_slice

    parsed = answers.select("source", F.from_json(json_slice(F.col("answer")), INSIGHTS).alias("e"))
    full = F.filter("e.insights", lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) != "")
    one = parsed.select("source", F.posexplode(F.slice(full, 1, most)).alias("at", "c"))
    none = F.array().cast("array<struct<kind:string,ref:string,quote:string>>")
    evidence = F.filter(F.coalesce("c.evidence", none), lambda x: x["kind"].isNotNull() & x["ref"].isNotNull())
    return one.select("source", "at", F.trim("c.text").alias("text"), F.coalesce("c.kind", F.lit("fact")).alias("kind"), evidence.alias("evidence"), F.col("c.confidence").alias("confidence"))


WRITTEN = "title string, summary string, tags array<string>, body string"


def written_pages(answers: DataFrame, today: str) -> DataFrame:
    """(key, title, summary, tags, type, topic, updated, sources, body, missing) of pages that a writer has worded.

    ``answers``: key, answer (text that holds a JSON object), page_type, topic, title (a stand-in), sources, evidence (what
    the page may rest on). ``missing``: literals of the body that the evidence lacks, which flag the page. Answers
    without a body give nothing.
    """
    from loreweave.functions.formats import json_slice
    from loreweave.functions.text import literals, missing_literals

    w = answers.withColumn("_w", F.from_json(json_slice(F.col("answer")), WRITTEN)).where(F.trim(F.coalesce("_w.body", F.lit(""))) != "")
    none = F.array().cast("array<string>")
    return w.select(
        "key", F.coalesce(F.nullif(F.trim("_w.title"), F.lit("")), F.col("title")).alias("title"), F.coalesce("_w.summary", F.lit("")).alias("summary"), F.coalesce("_w.tags", none).alias("tags"),
        F.col("page_type").alias("type"), "topic", F.lit(today).alias("updated"), "sources", F.trim("_w.body").alias("body"), missing_literals(literals(F.col("_w.body")), F.col("evidence")).alias("missing"),
    )
