"""Register tables, landed envelopes, idempotent writes and sealed payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENVELOPE_COLUMNS = [
    *((c, "string") for c in ("tenant_id", "source", "source_id", "actor", "thread_ref")),
    ("permission_scope", "array<string>"),
    ("raw_content", "string"),
    ("received_at", "timestamp"),
    *((c, "string") for c in ("source_permalink", "actor_display_name", "connection_id")),
    ("likely_bulk_mail", "boolean"),
    ("known_actors", "array<struct<name: string, source_actor_id: string>>"),
]
ENVELOPE = ", ".join(f"{c} {kind}" for c, kind in ENVELOPE_COLUMNS)
#: Columns of the register's tables.
SCHEMAS = {
    "tenants": "id string, name string, slug string, plan string, created_at timestamp, learning_paused boolean, core_knowledge_only boolean",
    "memberships": "id string, tenant_id string, user_id string, role string, created_at timestamp, updated_at timestamp",
    "actors": "id string, tenant_id string, auth_user_id string, display_name string, email string, slack_user_id string, notion_user_id string, kind string, created_at timestamp, atlassian_account_id string, discord_user_id string, github_user_id string, monday_user_id string, clickup_user_id string",
    "source_connections": "id string, tenant_id string, source string, external_workspace_id string, ingestion_mode string, status string, cursor_state string, last_synced_at timestamp, created_at timestamp",
    "raw_events": "id string, tenant_id string, connection_id string, source string, source_id string, thread_ref string, actor_id string, permission_scope array<string>, raw_content binary, metadata string, received_at timestamp, expires_at timestamp, triage_result string, triage_at timestamp, pipeline_status string",
    "decisions": "id string, tenant_id string, record_type string, decision_statement string, rationale string, alternatives_considered array<string>, status string, superseded_by string, scope string, scope_actor_id string, confidence decimal(4,3), permission_scope array<string>, origin_raw_event_id string, created_at timestamp, updated_at timestamp",
    "decision_actors": "tenant_id string, decision_id string, actor_id string, role string",
    "decision_sources": "id string, tenant_id string, decision_id string, raw_event_id string, permalink string, created_at timestamp",
    "decision_embeddings": "decision_id string, tenant_id string, embedding array<float>, embedding_model string, embedded_at timestamp",
    "decision_conflicts": "id string, tenant_id string, decision_id string, related_decision_id string, relationship string, reason string, confidence double, created_at timestamp",
    "radar_corrections": "id string, tenant_id string, decision_id string, action string, original_statement string, corrected_statement string, original_status string, note string, corrected_by_actor_id string, corrected_at timestamp",
    "feedback_events": "id string, tenant_id string, query string, synthesized_answer string, signal string, comment string, created_at timestamp",
    "weekly_digests": "id string, tenant_id string, user_id string, scope string, week_of date, period_start date, period_end date, summary string, items string, metadata string, created_at timestamp",
    "capture_source_rules": "tenant_id string, source string, item_id string, item_name string, included boolean, updated_at timestamp",
    "search_history": "tenant_id string, user_id string, query string, result_count int, searched_at timestamp",
    "user_search_preferences": "user_id string, save_history boolean",
    "mcp_tool_calls": "tenant_id string, requesting_client string, tool_name string, request_params string, result_decision_ids array<string>, latency_ms int, called_at timestamp",
    "chat_messages": "id string, session_id string, role string, content string, created_at timestamp",
    "daily_usage": "usage_date date, input_tokens bigint, output_tokens bigint, cache_write_tokens bigint, cache_read_tokens bigint, request_count int",
}


def read_register(spark: SparkSession, path: str, tables: list[str] | None = None, views: bool = False) -> dict[str, DataFrame]:
    """The register's tables with their fixed schemas, as temporary views too if asked for."""
    out = {name: spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}") for name in tables or SCHEMAS}
    if views:
        for name, df in out.items():
            df.createOrReplaceTempView(name)
    return out


def split_envelopes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Envelopes with their required fields, and the others with a reason."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reason = F.coalesce(F.when(F.col("_corrupt").isNotNull(), "malformed"), *[F.when(blank(c), f"{c} is missing") for c in ("tenant_id", "source", "source_id")])
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason", "_corrupt"), marked.where("reason IS NOT NULL")


def read_envelopes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed JSON envelopes, and those that lack a required field or do not parse."""
    rows = spark.read.schema(f"{ENVELOPE}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return split_envelopes(rows)


def stream_envelopes(spark: SparkSession, path: str, files_per_batch: int = 20) -> DataFrame:
    """S3: the same as a stream, in arrival order, so many files in a batch."""
    return spark.readStream.schema(f"{ENVELOPE}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_batch).json(path)


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is absent, one for each key; append these."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys and new.schema[c].dataType.typeName() not in ("map", "array", "struct", "variant")] or keys))).where("_n = 1").drop("_n")
    return first.join(target.select(*keys), keys, "left_anti").select(*new.columns)


def upsert(target: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str] | None = None, stamp: Column | None = None) -> DataFrame:
    """The target with new rows by key; a column's rule is replace (default), keep (old if new is null) or add.

    ``new`` has one row for each key.  ``stamp`` fills updated_at of the rows that are written.
    """
    rules = rules or {}
    rest = [c for c in target.columns if c not in keys]
    got = new.select(*keys, F.struct(*[F.col(c) if c in new.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in rest]).alias("_new"))
    old = target.select(*keys, F.struct(*rest).alias("_old"))
    met = old.join(got, keys, "full_outer")
    hit = F.col("_new").isNotNull()
    out = []
    for c in rest:
        before, after = F.col("_old")[c], F.col("_new")[c]
        rule = rules.get(c, "replace" if c in new.columns else "keep")
        value = F.coalesce(after, before) if rule == "keep" else F.coalesce(before, F.lit(0)) + F.coalesce(after, F.lit(0)) if rule == "add" else after
        value = F.when(hit, value).otherwise(before)
        if c == "updated_at" and stamp is not None:
            value = F.when(hit, stamp).otherwise(before)
        out.append(value.cast(target.schema[c].dataType).alias(c))
    return met.select(*keys, *out)


def insert_select(target: DataFrame, source: DataFrame, mapping: dict[str, str], keys: list[str]) -> DataFrame:
    """Rows of another schema under new names, those with a known key left out."""
    return insert_ignore(target, source.select(*[F.col(old).alias(new) for new, old in mapping.items()]), keys)


def sources_view(connections: DataFrame, name: str = "sources") -> DataFrame:
    """Connections under the names of an earlier schema, as a view."""
    view = connections.select("id", "tenant_id", F.col("source").alias("type"), F.col("external_workspace_id").alias("workspace_id"), "status", F.col("cursor_state").alias("cursor"), F.col("last_synced_at").alias("synced_at"), "created_at")
    view.createOrReplaceTempView(name)
    return view


#: The first bytes of a sealed payload.
MAGIC = b"SEAL01"


def seal(payload: Column, secret: str) -> Column:
    """Magic, 12-byte nonce, ciphertext and tag, under the SHA-256 of the secret."""
    return F.concat(F.lit(MAGIC), F.aes_encrypt(payload, F.unhex(F.sha2(F.lit(secret).cast("binary"), 256)), F.lit("GCM")))


def open_sealed(sealed: Column, secret: str) -> Column:
    """The payload; null if it is not sealed with this secret, itself if it was never sealed."""
    plain = F.try_aes_decrypt(F.substring(sealed, len(MAGIC) + 1, 2**31 - 1), F.unhex(F.sha2(F.lit(secret).cast("binary"), 256)), F.lit("GCM"))
    return F.when(F.substring(sealed, 1, len(MAGIC)) == F.lit(MAGIC), plain).otherwise(sealed)


def find_in_raw(raw_events: DataFrame, secret: str, query: str, n: int = 300, preview: int = 400) -> DataFrame:
    """The newest mails whose subject holds the text, with a cleaned preview."""
    from ..functions.text import clean_display_text, payload_text

    rows = raw_events.where(F.col("source") == "gmail").orderBy(F.desc("received_at"), "id").limit(n).withColumn("_raw", open_sealed(F.col("raw_content"), secret).cast("string"))
    hit = rows.where(F.contains(F.lower(F.get_json_object("_raw", "$.subject")), F.lit(query.lower()))).withColumn("_text", payload_text("_raw", "source"))
    return clean_display_text(hit, "_text", "preview").withColumn("preview", F.left("preview", F.lit(preview))).drop("_raw", "_text")
