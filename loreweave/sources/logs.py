"""Line-based JSON logs: ledgers, metrics, reviews, session logs and transcripts. Lines that don't parse are left out or counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "ledger": "ts string, actor string, op string, subject string, action string, reason string, outcome string, evidence array<string>, verdict struct<grounded:double,derivable:double,importanceNorm:double,kind:string,trustTier:string>, usage struct<input_tokens:bigint,output_tokens:bigint,cost:double>",
    "metrics": "ts string, op string, query string, pages array<string>, detail string",
    "reviews": "id string, ts string, kind string, status string, claimText string, page string, claimId string, criticality double, reason string, resolution string, note string, resolvedAt string",
    "sessionlog": "ts string, text string, kind string, source string, action string, reason string, grounded double, derivable double, importance double",
    "transcript": "type string, id string, parentId string, timestamp string, cwd string, message struct<role:string,stopReason:string,model:string,toolCallId:string,isError:boolean,content:array<struct<type:string,text:string,id:string,name:string>>,usage:struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,totalTokens:bigint,cost:struct<total:double>>>",
}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The lines of a log that parse, in the log's schema."""
    lines = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", SCHEMAS[kind]).alias("r")).select("r.*")


def stream(spark: SparkSession, path: str, kind: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMAS[kind]).option("maxFilesPerTrigger", files_per_trigger).json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(session, ord, header, warning, entry): the lines of session files; a bad line carries a warning.

    ``ord`` is the line's number in its file, so a file is read as a whole (sessions are small, folders are not).
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("session"), "value")
    lines = files.select("session", F.posexplode(F.split("value", "\n")).alias("ord", "line")).where(F.trim("line") != "")
    entry = F.from_json("line", SCHEMAS["transcript"], {"mode": "PERMISSIVE"})
    whole = F.try_parse_json("line")
    parsed = lines.select("session", "ord", "line", entry.alias("entry"), whole.isNull().alias("bad"))
    warning = F.when(F.col("bad"), F.concat(F.lit("line "), (F.col("ord") + 1).cast("string"), F.lit(": unparseable JSON, skipped")))
    return parsed.select("session", "ord", (F.col("entry.type") == "session").alias("header"), warning.alias("warning"), F.when(~F.col("bad"), F.col("entry")).alias("entry"))


def messages(lines: DataFrame) -> DataFrame:
    """Session messages in the shape that ``episodes`` takes, with usage (missing numbers 0) and the joined text."""
    e = F.col("entry")
    m = e["message"]
    use = {k: F.coalesce(m["usage"][k], F.lit(0)) for k in ("input", "output", "cacheRead", "cacheWrite")}
    total = F.when(F.coalesce(m["usage"]["totalTokens"], F.lit(0)) > 0, m["usage"]["totalTokens"]).otherwise(sum(use.values()))
    text = F.array_join(F.transform(F.filter(m["content"], lambda c: c["type"] == "text"), lambda c: c["text"]), "\n")
    rows = lines.where("warning is null and not coalesce(header, false)")
    return rows.select(
        "session", "ord", e["id"].alias("id"), e["parentId"].alias("parent_id"), m["role"].alias("role"), m["stopReason"].alias("stop_reason"), e["timestamp"].alias("ts"), text.alias("text"), total.alias("total_tokens"),
        F.coalesce(m["usage"]["cost"]["total"], F.lit(0.0)).alias("cost"),
    )


def headers(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(session, root, cwd, ts): the first line of every session file, where it is a header with a folder.

    ``root`` names the place that the files come from (the folder itself, if it isn't given).
    """
    first = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("session"), F.split_part("value", F.lit("\n"), F.lit(1)).alias("line"))
    entry = first.where(F.try_parse_json("line").isNotNull()).select("session", F.from_json("line", SCHEMAS["transcript"]).alias("e"))
    return entry.where("e.type = 'session' and e.cwd is not null").select("session", F.lit(root or path).alias("root"), F.col("e.cwd").alias("cwd"), F.col("e.timestamp").alias("ts"))


def retrievals(spark: SparkSession, path: str) -> DataFrame:
    """(ts, query, pages) of the asks that a metrics log holds with a time."""
    return retrieval_events(read(spark, path, "metrics"))


def retrieval_events(metrics: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return metrics.where("op = 'ask' and ts is not null").select("ts", "query", F.coalesce("pages", none).alias("pages"))


def user_runs(runs: DataFrame) -> DataFrame:
    """Runs that a user started with a prompt. ``runs``: message_type, prompt and any others."""
    return runs.where((F.coalesce("message_type", F.lit("user")) == "user") & F.col("prompt").isNotNull())
