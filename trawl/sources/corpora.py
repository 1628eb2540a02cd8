"""Adapters: the given tables as files(db, path, is_dir, size, mtime, content), each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1_700_000_000
EXTENSIONS = ("rs", "md", "txt", "json", "html", "zip")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(df: DataFrame, db: str, path: Column, size: Column, mtime: Column, content: Column) -> DataFrame:
    return df.select(F.lit(db).alias("db"), path.alias("path"), F.lit(False).alias("is_dir"), size.cast("bigint").alias("size"), mtime.cast("bigint").alias("mtime"), content.cast("string").alias("content"))


def docs(spark: SparkSession, sf_dir: str, db: str = "docs") -> DataFrame:
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.when(F.col("doc_id") % 4 == 0, "Note").otherwise("doc"), F.lit("_"), F.col("doc_id").cast("string"))
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/corpus/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), name, F.lit("."), ext)
    return _files(d, db, path, F.octet_length("text"), EPOCH + F.col("doc_id") * 3600, F.col("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per address: of pages that share one, the smallest page_id, and the html of the smallest that has any."""
    html = F.min_by("html", F.when(F.col("html").isNotNull(), F.col("page_id")))
    p = read(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), html.alias("html"))
    return _files(p, "pages", F.regexp_replace("url", "^https?://", "/web/"), F.octet_length("html"), EPOCH + F.col("page_id") * 60, F.col("html"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    path = F.concat(F.lit("/chat/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("_"), "role", F.lit(".md"))
    return _files(c, "chat", path, F.octet_length("text"), F.lit(EPOCH), F.col("text"))


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return _files(b, "bench", F.concat(F.lit("/bench/item_"), F.col("item_id").cast("string"), F.lit(".txt")), F.octet_length("text"), F.lit(EPOCH), F.col("text"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filename-only database: no contents."""
    p = read(spark, sf_dir, "part")
    path = F.concat(F.lit("/parts/"), "p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("."), F.lower("p_type"))
    return _files(p, "parts", path, F.col("p_size"), F.lit(EPOCH), F.lit(None))


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).unionByName(pages(spark, sf_dir)).unionByName(chat(spark, sf_dir)).unionByName(bench(spark, sf_dir)).unionByName(parts(spark, sf_dir))


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two databases that share all paths; the second one's files are a minute younger."""
    b = docs(spark, sf_dir, "docs_b")
    return docs(spark, sf_dir, "docs_a").unionByName(b.withColumn("mtime", F.col("mtime") + 60))


def doc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path) of every document."""
    return docs(spark, sf_dir).select(F.regexp_extract("path", r"_(\d+)\.", 1).cast("bigint").alias("doc_id"), "path")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change log over docs: a user's number is the document's; errors delete, views have no content."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").cast("bigint").alias("doc_id"), "event_type", "props")
    content = F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.concat("event_type", F.lit(" "), F.coalesce("props", F.lit(""))))
    out = e.join(doc_paths(spark, sf_dir), "doc_id").withColumn("content", content)
    delete = F.col("event_type") == "error"
    return out.select(
        F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").alias("at"), F.col("event_id").cast("bigint").alias("seq"), F.when(delete, "delete").otherwise("upsert").alias("op"), "path",
        F.lit(False).alias("is_dir"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("size"), F.lit(EPOCH).cast("bigint").alias("mtime"), "content",
    )


_DOC_PATH = "'/corpus/' || coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' || CASE WHEN doc_id % 4 = 0 THEN 'Note' ELSE 'doc' END || '_' || doc_id || '.' || (['rs', 'md', 'txt', 'json', 'html', 'zip'])[doc_id % 6 + 1]"
SQL = {
    "docs": f"docs AS (SELECT 'docs' AS db, {_DOC_PATH} AS path, false AS is_dir, CAST(strlen(text) AS BIGINT) AS size, 1700000000 + doc_id * 3600 AS mtime, text AS content, doc_id FROM documents)",
    "pages": "web AS (SELECT 'pages' AS db, regexp_replace(url, '^https?://', '/web/') AS path, false AS is_dir, CAST(strlen(html) AS BIGINT) AS size, 1700000000 + page_id * 60 AS mtime, html AS content FROM (SELECT url, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM pages GROUP BY url))",
    "chat": "chat AS (SELECT 'chat' AS db, '/chat/' || conv_id || '/' || turn || '_' || role || '.md' AS path, false AS is_dir, CAST(strlen(text) AS BIGINT) AS size, CAST(1700000000 AS BIGINT) AS mtime, text AS content FROM conversations)",
    "bench": "bench AS (SELECT 'bench' AS db, '/bench/item_' || item_id || '.txt' AS path, false AS is_dir, CAST(strlen(text) AS BIGINT) AS size, CAST(1700000000 AS BIGINT) AS mtime, text AS content FROM benchmark)",
    "parts": "parts AS (SELECT 'parts' AS db, '/parts/' || p_brand || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.' || lower(p_type) AS path, false AS is_dir, CAST(p_size AS BIGINT) AS size, CAST(1700000000 AS BIGINT) AS mtime, CAST(NULL AS VARCHAR) AS content FROM part)",
    "overlapping": f"both_dbs AS (SELECT 'docs_a' AS db, {_DOC_PATH} AS path, false AS is_dir, CAST(strlen(text) AS BIGINT) AS size, 1700000000 + doc_id * 3600 AS mtime, text AS content FROM documents UNION ALL SELECT 'docs_b', {_DOC_PATH}, false, CAST(strlen(text) AS BIGINT), 1700000060 + doc_id * 3600, text FROM documents)",
    "changes": "log AS (SELECT e.ts, e.event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, d.path, CASE WHEN event_type = 'view' THEN NULL ELSE event_type || ' ' || coalesce(props, '') END AS content FROM events e JOIN docs d ON d.doc_id = e.user_id)",
}
