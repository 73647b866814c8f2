"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitpack import pack_and_read
from .bpe import encode_documents
from .common import read_table
from .conversations import repair_report
from .decontaminate import find_contamination
from .licenses import duckdb_sql as licenses_sql
from .licenses import scan_licenses
from .neardup import near_duplicates
from .ordermh import edited_likeness
from .periodic import find_runs
from .quality import fit_quality, label_fold, score_quality
from .sharding import shard_rows
from .suffix import repeated_bytes
from .tokencounts import count_tokens
from .toxicity import fit_toxicity, score_toxicity


def op1_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into 16 shards of nearly equal bytes, equal texts together."""
    out = shard_rows(read_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_order_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edits, and how like they are."""
    return edited_likeness(read_table(spark, sf_dir, "documents"))


def op3_super_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their three-word shingles."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"), words=3, similarity="17/20")
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op4_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document words inside occurrences of ten-word windows of the benchmark items."""
    out = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP4_SQL = r"""
WITH items AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM docs) d JOIN sizes s ON i + s.n - 1 <= len(w)),
met AS (SELECT g.doc_id, g.i, g.n, w.item_id FROM grams g JOIN windows w ON g.n = w.n AND g.g = w.g),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS place FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM met GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""


def op5_factorisation_machine_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt outside the held-out third of the labels."""
    docs = read_table(spark, sf_dir, "documents")
    machine = fit_quality(docs, read_table(spark, sf_dir, "labels"), "quality", folds=3, held=1)
    out = score_quality(docs, machine)
    return out.select("doc_id", F.coalesce(label_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_subsequence_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt outside the held-out fifth of the labels."""
    docs = read_table(spark, sf_dir, "documents")
    machine = fit_toxicity(docs, read_table(spark, sf_dir, "labels"), "toxic", folds=5, held=0)
    out = score_toxicity(docs, machine)
    return out.select("doc_id", F.coalesce(label_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_duckdb_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts encoded with the byte-level ranks and decoded again."""
    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_license_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known license sentences and the licenses they make, for every document."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op9_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as bit-packed ids in files, read back."""
    return pack_and_read(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op10_suffix_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of all texts without the 100-byte strings that came before."""
    return repeated_bytes(read_table(spark, sf_dir, "documents"), threshold=100)


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """The rows with the damage that op11 repairs, by crc32 of ``conv_id:turn``; dropped ones are marked in ``gone``."""
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", *(F.coalesce(c, space).alias(c) for c in ("role", "text")))
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), space) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    rows = rows.withColumn("kind", F.crc32(F.encode(key, "utf-8")) % 20)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def op11_ida_star_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after the damage: faults, cheapest edits and the digest of the repaired rows."""
    return repair_report(damaged_conversations(read_table(spark, sf_dir, "conversations")), gone="gone")


def op12_distinct_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all texts, summed from the counts of distinct pre-tokens."""
    out = count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """The documents with the repeats that op13 finds: of each tenth one by crc32(doc_id) words from one on repeat."""
    docs = docs.select("doc_id", "text", F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")).alias("h"))
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))
    docs = docs.withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.when(F.size("w") > 0, F.size("w")))
    docs = docs.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", F.expr("1 + cast((n - a) div (3 + g % 8) as int)"))
    tail = F.expr("array_join(concat(slice(w, 1, a), transform(sequence(0, n - a - 1), k -> w[a + k % p])), ' ')")
    return docs.select("doc_id", F.when(F.col("n").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def op13_synchronising_set_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in all documents, a tenth of them with planted repeats."""
    found = find_runs(repeated_tails(read_table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS start, -r.period AS period)))")
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if re.match(r"op\d+_", name)}


def oracle_sql() -> dict[str, str]:
    return {"op4_suffix_automaton_decontamination": OP4_SQL, "op8_license_sentence_rules": licenses_sql()}
