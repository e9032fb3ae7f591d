"""What backs a claim: quotations, user statements, ledger entries, changed files, retrieved pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.formats import truncated_text
from loreweave.functions.redact import redact
from loreweave.functions.text import bare_page, base_name, clean_path, file_matches, fold_quotes, normalize, same_file, same_page, token_set
from loreweave.session import cut

from .containment import STRINGS, held_names
from .similarity import best_match

LEAST = 12


def quote_holds(quote: Column, source: Column) -> Column:
    """A quotation of twelve characters or more that stands in its source, quotes and white space folded."""
    return F.coalesce((F.length(F.trim(quote)) >= LEAST) & F.contains(fold_quotes(source), fold_quotes(quote)), F.lit(False))


def user_said(claims: DataFrame, turns: DataFrame) -> DataFrame:
    """(id, stated): whether a claim's evidence stands in the joined user turns of its session.

    ``claims``: id, session, evidence; ``turns``: session, ord, role, text.
    """
    said = turns.where("role = 'user'").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    joined = said.select("session", normalize(F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("said"))
    needle = normalize(F.col("evidence"))
    stated = F.coalesce((F.length(needle) >= LEAST) & F.contains("said", needle), F.lit(False))
    return claims.join(joined, "session", "left").select("id", stated.alias("stated"))


def insight_evidence(items: DataFrame, files: DataFrame, commits: DataFrame, excerpt: int = 3500, commit: int = 2000) -> DataFrame:
    """(id, evidence): what stands behind each insight, item by item in order, with secrets redacted.

    ``items``: id, at, kind (file, commit, user, source or other), ref, quote, terms (of the insight), said (whether the
    user said it); ``files``: path, text; ``commits``: ref, text. A file gives the lines around the terms.
    """
    met = items.join(files.select(F.col("path").alias("ref"), F.col("text").alias("_file")), "ref", "left").join(commits.select("ref", F.col("text").alias("_commit")), "ref", "left")
    quoted = F.when(F.coalesce("quote", F.lit("")) != "", F.concat(F.lit('\nquote: "'), "quote", F.lit('"'))).otherwise("")
    part = (
        F.when((F.col("kind") == "file") & F.col("_file").isNull(), F.concat(F.lit("file: "), "ref", F.lit(" (not found)")))
        .when(F.col("kind") == "file", F.concat(F.lit("file: "), "ref", F.lit("\n"), F.substring(excerpt_around(F.col("_file"), F.col("terms")), 1, excerpt)))
        .when(F.col("kind") == "commit", F.concat(F.lit("commit: "), "ref", F.lit("\n"), truncated_text(F.coalesce(F.nullif("_commit", F.lit("")), F.lit("(commit not found)")), commit)))
        .when(F.col("kind") == "user", F.concat(F.when(F.coalesce("said", F.lit(False)), "user statement").otherwise("agent-stated (unverified)"), F.lit(': "'), F.coalesce("quote", "ref"), F.lit('"')))
        .otherwise(F.concat("kind", F.lit(": "), "ref", quoted))
    )
    listed = F.array_sort(F.collect_list(F.struct("at", part.alias("part"))))
    joined = met.groupBy("id").agg(F.array_join(F.transform(listed, lambda x: x["part"]), "\n\n").alias("text"))
    return joined.select("id", redact(F.coalesce(F.nullif("text", F.lit("")), F.lit("(no evidence attached)"))).alias("evidence"))


def contaminated(calls: DataFrame, forbidden: DataFrame, block: int = STRINGS) -> DataFrame:
    """(session, reasons): sessions whose calls name a forbidden root or whose results hold a canary.

    ``calls``: session, args, result; ``forbidden``: kind (root or canary), value. Roots are looked for in the arguments and
    canaries in the results, all at once, in blocks of ``block`` characters, see ``held_names``.
    """
    sides = (("root", "args"), ("canary", "result"))
    parts = [held_names(calls.select("session", F.col(column).alias("text")), forbidden.where(F.col("kind") == kind).select(F.col("value").alias("name")), block=block, keep=["session"]).select("session", F.concat(F.lit(f"{kind}:"), "name").alias("reason")) for kind, column in sides]
    return parts[0].unionByName(parts[1]).groupBy("session").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def affected_claims(claims: DataFrame, changed: DataFrame, most: int = 40) -> DataFrame:
    """The first ``most`` claims, by id, with a file pattern that a changed file matches.

    ``claims``: id, files; ``changed``: path. Every pattern meets the changed paths and their folders on an equal key:
    itself, or with a star the folder before it; those with a star are then matched in full.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = changed.select("path", F.explode(folders).alias("key"))
    one = claims.select("id", F.explode("files").alias("raw")).withColumn("pattern", F.regexp_replace(F.regexp_replace("raw", r"^\./", ""), "/+$", ""))
    star = F.contains("pattern", F.lit("*"))
    plain = one.where(~star & (F.col("pattern") != "")).join(above, F.col("pattern") == F.col("key"), "left_semi").select("id")
    keyed = one.where(star).withColumn("key", F.regexp_replace(F.split_part("pattern", F.lit("*"), F.lit(1)), "/?[^/]*$", ""))
    met = keyed.join(above, "key").where(file_matches(F.col("path"), F.col("raw"))).select("id")
    return plain.unionByName(met).distinct().orderBy("id").limit(most)


def _heads(text: Column, most: int) -> Column:
    """Every start of a text, up to ``most`` characters."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(text), F.lit(most)))), lambda n: F.substring(text, F.lit(1), n))


def unbacked_claims(claims: DataFrame, ledger: DataFrame, threshold: float = 0.5, prefix: int = 100, mentions: DataFrame | None = None) -> DataFrame:
    """Claims that no accepted ledger subject backs and that no ledger entry has reviewed.

    A subject backs a claim if it and the first ``prefix`` characters of the claim begin alike (normalised; one is the
    start of the other), or by token overlap. An entry of ``mentions`` (text) reviews a claim if it names the claim's
    page and, where the claim has an id, that id or the claim's first 60 characters.
    ``claims``: id, text and, with ``mentions``, page and claim_id; ``ledger``: subject. Starts meet as starts of equal
    length, at most ``prefix`` rows a subject; what is left then looks for its best subject by words, see
    ``similarity.best_match``: neither needs all pairs.
    """
    whole = normalize(F.col("text"))
    c = claims.select("id", F.substring(whole, 1, prefix).alias("head"), token_set(F.col("text")).alias("ct"))
    s = ledger.select(normalize(F.col("subject")).alias("subject"), token_set(F.col("subject")).alias("tokens")).distinct()
    # the claim's head starts the subject, or the subject (short enough) starts the head; an empty one starts all
    longer = s.select(F.explode(_heads(F.col("subject"), prefix)).alias("head")).distinct()
    starts = c.join(longer.hint("merge"), "head", "left_semi").select("id")
    short = s.where((F.length("subject") <= prefix) & (F.col("subject") != "")).select(F.col("subject").alias("start")).distinct()
    started = c.select("id", F.explode(_heads(F.col("head"), prefix)).alias("start")).join(short.hint("merge"), "start", "left_semi").select("id")
    empty = c.join(s.where("subject = ''").select(F.lit(True)).limit(1), how="left_semi").select("id")
    backed = starts.unionByName(started).unionByName(empty)
    if mentions is not None:
        said = mentions.select(normalize(F.col("text")).alias("said")).distinct()
        named = held_names(said, claims.select(normalize(F.col("page")).alias("name")).distinct(), "said")
        own = claims.select("id", F.col("claim_id"), normalize(F.col("page")).alias("name"), F.substring(whole, 1, 60).alias("first"))
        exact = F.coalesce(F.col("claim_id") == "", F.lit(True)) | F.contains("said", F.col("claim_id")) | F.contains("said", F.col("first"))
        backed = backed.unionByName(own.join(named.hint("merge"), "name").where(exact).select("id"))
    left = cut(c.join(backed.distinct(), "id", "left_anti").select("id", "ct"))
    near = best_match(left.select(F.col("id").alias("query_id"), F.col("ct").alias("tokens")), cut(s.select("tokens").distinct().withColumn("id", F.monotonically_increasing_id())), threshold)
    return left.join(near.select(F.col("query_id").alias("id")), "id", "left_anti").select("id")


def undocumented(modules: DataFrame, pages: DataFrame) -> DataFrame:
    """Modules that no architecture page documents: by base name in its title, summary or path, or by a declared file.

    Architecture pages are those of type ``architecture`` or ``architecture/...``; the root module is left out. Names
    are looked up as substrings, see ``held_names``. ``modules``: module; ``pages``: path, type, title, summary, files.
    """
    about = pages.where((F.col("type") == "architecture") | F.col("type").startswith("architecture/"))
    text = about.select(F.lower(F.concat_ws(" ", "title", "summary", "path")).alias("text")).distinct()
    parts = F.split("file", "/")
    under = about.select(F.explode("files").alias("file")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("module")).distinct()
    named = modules.where("module not in ('.', '(root)')").withColumn("name", F.lower(base_name(F.col("module"))))
    known = held_names(text, named.select("name").distinct(), "text", keep=[]).select("name").distinct()
    return named.join(known, "name", "left_anti").join(under, "module", "left_anti").select("module")


def rediscovered(retrievals: DataFrame, links: DataFrame, reads: DataFrame) -> DataFrame:
    """(episode, rediscovered): whether an episode read a file that a page it had retrieved declares.

    ``retrievals``: episode, page; ``links``: path, files; ``reads``: episode, file. Pages meet on their bare name, files
    on their base name; the exact comparison follows. Of several pages that fit, the first by path counts.
    """

    def last(x: str) -> Column:
        return base_name(bare_page(F.col(x)))

    def file(x: str) -> Column:
        return base_name(F.lower(clean_path(F.col(x))))

    pages = retrievals.withColumn("_k", last("page")).join(links.withColumn("_k", last("path")), "_k").where(same_page(F.col("page"), F.col("path")))
    first = Window.partitionBy("episode", "page").orderBy("path")
    declared = pages.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("episode", F.explode("files").alias("declared")).withColumn("_b", file("declared"))
    met = declared.join(reads.withColumn("_b", file("file")), ["episode", "_b"]).where(same_file(F.col("file"), F.col("declared"))).select("episode").distinct()
    return retrievals.select("episode").distinct().join(met.withColumn("hit", F.lit(True)), "episode", "left").select("episode", F.coalesce("hit", F.lit(False)).alias("rediscovered"))


def excerpt_around(text: Column, terms: Column, best: int = 10, around: int = 4, longest: int = 60) -> Column:
    """Of a text over ``longest`` lines, the best lines by terms with their neighbours, numbered; gaps are marked.

    ``terms``: lower-case terms; the first twelve of more than three characters count.
    """
    used = F.slice(F.filter(terms, lambda t: F.length(t) > 3), 1, 12)
    hits = lambda x, s: F.size(F.filter(s["used"], lambda t: F.contains(F.lower(x), t)))
    # step by step, so that each array is made once and not again for every line
    state = F.array(F.struct(text.alias("text"), F.split(text, "\n").alias("lines"), used.alias("used")))
    scored = F.transform(state, lambda s: F.struct(s["text"].alias("text"), s["lines"].alias("lines"), F.transform(s["lines"], lambda x, i: F.struct((-hits(x, s)).alias("s"), i.alias("i"))).alias("scored")))
    near = lambda x, s: F.sequence(F.greatest(F.lit(0), x["i"] - around), F.least(F.size(s["lines"]) - 1, x["i"] + around))
    top = lambda s: F.slice(F.array_sort(F.filter(s["scored"], lambda x: x["s"] < 0)), 1, best)
    wanted = F.transform(scored, lambda s: F.struct(s["text"].alias("text"), s["lines"].alias("lines"), F.array_sort(F.array_distinct(F.flatten(F.transform(top(s), lambda x: near(x, s))))).alias("wanted")))

    def shown(s: Column) -> Column:
        def line(i: Column, at: Column) -> Column:
            gap = F.when((at > 0) & (F.get(s["wanted"], at - 1) < i - 1), F.lit("…\n")).otherwise(F.lit(""))
            return F.concat(gap, (i + 1).cast("string"), F.lit(": "), F.get(s["lines"], i))

        return F.when(F.size(s["lines"]) <= longest, s["text"]).otherwise(F.array_join(F.transform(s["wanted"], line), "\n"))

    return F.get(F.transform(wanted, shown), 0)


def task_candidates(files: DataFrame, most_files: int = 15, most_lines: int = 400) -> DataFrame:
    """Commits that make good tasks: few files and lines; 2 for tests among them, 1 for six files at most. Newest first.

    ``files``: commit, day, path, added, deleted.
    """
    one = files.groupBy("commit", "day").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("added") + F.col("deleted")).alias("lines"), F.bool_or(F.col("path").rlike(r"(?i)(^|/)tests?/|[._-]test\.")).alias("has_tests"))
    fit = one.where((F.col("files") <= most_files) & (F.col("lines") <= most_lines))
    score = F.when(F.col("has_tests"), 2).otherwise(0) + F.when(F.col("files") <= 6, 1).otherwise(0)
    return fit.withColumn("score", score).orderBy(F.desc("day"), F.desc("score"), "commit")
