"""Markdown documents as sections, one episode each, and packs of episodes and memories as JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions.text import slugify
from recollect.operators.common import SUBJECT, join_on

HEADING = r"^(#{1,3})\s+(.+?)\s*$"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def chunk_documents(docs: DataFrame, base_url: str = "") -> DataFrame:
    """Sections of documents (doc_path, text): heading, breadcrumb, url, body and content_hash.

    A heading of level 1 to 3 outside code fences opens a section; its path is the last heading of
    each higher level that is still open. Sections without a body go, as does text before the
    first heading; a document without headings is one section.
    """
    lines = docs.select("doc_path", F.posexplode(F.split("text", LINE_ENDS)).alias("pos", "line"))
    order = Window.partitionBy("doc_path").orderBy("pos")
    fence = F.trim("line").startswith("```")
    inside = F.sum(fence.cast("int")).over(order) % 2
    level = F.length(F.regexp_extract("line", HEADING, 1))
    rows = lines.withColumn("_heading", ~fence & (inside == 0) & (level > 0)).withColumn("_level", F.when(F.col("_heading"), level))
    title = F.when(F.col("_heading"), F.regexp_extract("line", HEADING, 2))
    rows = rows.withColumn("_title", title).withColumn("section", F.sum(F.col("_heading").cast("int")).over(order))
    for n in (1, 2):
        # The last heading of level n, or null if a higher one has come since.
        opens = F.when(F.col("_level") == n, F.struct(F.col("_title").alias("t")))
        closes = F.when(F.col("_level") < n, F.struct(F.lit(None).cast("string").alias("t")))
        rows = rows.withColumn(f"_h{n}", F.last(F.coalesce(opens, closes), ignorenulls=True).over(order)["t"])
    has = F.max("section").over(Window.partitionBy("doc_path")) > 0
    rows = rows.withColumn("_has", has).where("section > 0 OR NOT _has")
    body = F.sort_array(F.collect_list(F.when(~F.col("_heading"), F.struct("pos", "line"))))
    out = rows.groupBy("doc_path", "section").agg(
        F.max("_title").alias("heading"), F.max("_level").alias("level"), F.min_by("_h1", "pos").alias("h1"), F.min_by("_h2", "pos").alias("h2"), body.alias("_lines")
    )
    text = F.regexp_replace(F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    parents = F.array(F.when(F.col("level") > 1, F.col("h1")), F.when(F.col("level") > 2, F.col("h2")), F.col("heading"))
    path = F.array_compact(parents)
    out = out.withColumn("text", text).where(F.col("text") != "").withColumn("breadcrumb", F.array_join(path, " › "))
    url = F.concat(F.lit(base_url), "doc_path", F.when(F.col("heading").isNotNull(), F.concat(F.lit("#"), slugify(F.col("heading")))).otherwise(""))
    return out.select("doc_path", "section", "heading", "breadcrumb", url.alias("url"), "text", F.sha2("text", 256).alias("content_hash"))


def section_episodes(sections: DataFrame, subject_id: str, as_of: str) -> DataFrame:
    """An episode for every section, its id the hash of place and content, so that a rerun adds nothing."""
    payload = F.to_json(F.struct(F.col("heading").alias("title"), "breadcrumb", "doc_path", "url", "text"))
    return sections.select(
        F.sha2(F.concat_ws("|", "doc_path", "breadcrumb", "content_hash"), 256).alias("episode_id"), F.lit(None).cast("string").alias("tenant_id"),
        F.lit(subject_id).alias("subject_id"), F.lit("docs").alias("source"), F.lit("doc_section").alias("type"), payload.alias("payload"),
        F.to_json(F.struct("content_hash")).alias("provenance"), F.lit(as_of).cast("timestamp").alias("created_at"),
    )


PACK_EPISODE = "id string, source string, type string, created_at string, payload string, metadata string, provenance string"
PACK_MEMORY = "kind string, content string, summary string, confidence double, valid_from string, source_episode_ids array<string>, metadata string"


def pack_rows(episodes: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pack lines: an episode's id is its content hash (else its own id); memories cite those, dangling ids go."""
    key = F.coalesce(F.get_json_object("provenance", "$.content_hash"), F.col("episode_id"))
    e = episodes.select(key.alias("id"), "source", "type", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"), "payload", "provenance")
    ids = episodes.select(*SUBJECT, "episode_id", key.alias("_key"))
    parts = memories.select(*SUBJECT, "memory_id", F.posexplode("source_episode_ids").alias("pos", "episode_id"))
    parts = join_on(parts, ids, (*SUBJECT, "episode_id"), "inner")
    lists = parts.groupBy("memory_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_key"))), lambda x: x["_key"]).alias("_ids"))
    m = memories.join(lists, "memory_id", "left").select(
        "kind", "content", "summary", "confidence", F.date_format("valid_from", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("valid_from"),
        F.coalesce("_ids", F.array().cast("array<string>")).alias("source_episode_ids"), "metadata",
    )
    return e, m


def write_pack_jsonl(episodes: DataFrame, memories: DataFrame, folder: str) -> None:
    e, m = pack_rows(episodes, memories)
    e.write.mode("overwrite").json(f"{folder}/episodes.jsonl")
    m.write.mode("overwrite").json(f"{folder}/memories.jsonl")


def read_pack_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file or folder; blank lines are skipped, a missing file is empty."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
