"""Registered queries: questions to a collection through the vectors of its chunks, alone and beside BM25."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave import api
from loreweave.models import embed
from loreweave.operators.chunking import chunks, unique_paths
from loreweave.session import cut

from .base import query
from .knowledge import _CHUNKS
from .retrieval import _BM25_SQL, _RRF_SQL, _asked


class Letters:
    """An embedder that SQL can be held against: how often a text has each letter."""

    dims = 26

    def fingerprint(self) -> str:
        return "letters"

    def embed(self, texts: list[str]) -> np.ndarray:
        counts = [np.bincount(np.frombuffer(t.lower().encode(), np.uint8), minlength=123)[97:123] for t in texts]
        return np.array(counts, np.float32).reshape(len(texts), 26)


_LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length({0}) - length(replace(lower({0}), c, '')))::double)"
_NEAR = f"""ev as (select path, key, {_LETTERS.format("text")} as v from k), qv as (select item_id as query_id, {_LETTERS.format("text")} as v from benchmark),
nv as (select query_id, path, key, round(list_cosine_similarity(q.v, e.v), 6) as score from qv q, ev e where list_dot_product(q.v, q.v) > 0 and list_dot_product(e.v, e.v) > 0),
near as (select query_id, path, key, replace(key, 'section:', '') as anchor, score, row_number() over (partition by query_id order by score desc, path, key) as rank from nv qualify rank <= 15)"""


def _store(read) -> DataFrame:
    """The chunks of the headed pages as a search takes them from a store: without their texts."""
    pages = read("headed_pages")
    return cut(embed(chunks(pages, unique=unique_paths(pages)), Letters()).select("path", "key", "kind", "claim_id", "status", "embedding"))


@query("asked_semantic", f"with recursive {_CHUNKS}, {_NEAR} select query_id, path, key, anchor, rank::int as rank, score from near where rank <= 5")
def asked_semantic(read):
    return api.wiki_ask(read("headed_pages"), _asked(read), 5, "semantic", _store(read), embedder=Letters())


@query(
    "asked_hybrid",
    f"""with recursive {_CHUNKS}, {_NEAR}, headed as (select path, title, '' as rest, text from headed_pages), {_BM25_SQL.replace("wiki_pages", "headed").strip()[5:].replace("select query_id, path, rank::int as rank, score from (select *, row_number()", ", lex as (select query_id, path, rank::int as rank from (select *, row_number()").replace("where rank <= 5", "where rank <= 15)").replace("words as", "bmwords as").replace("from words", "from bmwords")},
    {_RRF_SQL.strip()[5:].replace("lexical_hits", "lex").replace("vector_hits", "near").replace("where rank <= 10", "where rank <= 5")}""",
)
def asked_hybrid(read):
    pages = read("headed_pages").withColumn("rest", F.lit(""))
    return api.wiki_ask(pages, _asked(read), 5, "hybrid", _store(read), embedder=Letters())
