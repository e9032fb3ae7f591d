import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Small documents with copies, near copies, shared passages, odd and long texts, nulls and repeated rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(1, 6))).strip() or "x" for _ in range(150)]

    def words(k: int) -> str:
        return " ".join(r.choice(vocabulary) for _ in range(k))

    passage = words(70)
    rows: list[tuple] = []
    for i in range(n):
        text = words(r.randint(0, 140)).replace(" x ", " x\n")
        kind = i % 6
        if kind == 1 and rows:
            text = r.choice(rows)[1] or ""
        elif kind == 2:
            text = words(r.randint(0, 20)) + " " + passage + " " + words(r.randint(0, 20))
        elif kind == 3 and rows:
            old = (r.choice(rows)[1] or "").split(" ")
            old[r.randrange(len(old))] = "zzz"
            text = " ".join(old)
        rows.append((i, text, ["en", "fr", None][i % 3], f"s{i % 4}", len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, "   \n\t", "en", "s0", 5), (None, passage, "en", "s1", 9), (None, None, "fr", None, None)]
    rows += [rows[2], rows[2], (n + 3, words(9000), "en", "s2", 1), (n + 4, "a " * 3000, "en", "s2", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def clashing(df):
    """The same rows with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["_text", "_words", "_host", "fp", "shard", "blob", "spans", "items", "n_words", "kept", "size", "rule", "chance", "ids", "base", "score", "_cell", "route", "_row", "_gone", "_more", "_figures", "_hash", "_at", "_frequent", "_lw_words", "_lw_spans", "_lw_items", "_lw_text", "_lw_id", "_lw_kept", "removed_chars", "spot", "base.dot"]
    return df.withColumns({n: F.lit("clash") for n in names})


def rows(df, *columns):
    return sorted([tuple(r[c] for c in (columns or df.columns)) for r in df.collect()], key=repr)
