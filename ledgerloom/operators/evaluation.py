"""Retrieval quality: recall, rank, citation, permission and latency metrics, run comparisons.

A result row has query_id, segment, mode, first_expected_rank, cited and expected arrays, status,
and so on; metrics over an empty pool are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_at(k: int, rank: str = "first_expected_rank", answerable: Column | None = None) -> Column:
    """The share of (answerable) queries whose first expected hit is within ``k``."""
    hit = F.coalesce(F.col(rank) <= k, F.lit(False)).cast("double")
    return F.avg(hit if answerable is None else F.when(answerable, hit))


def mrr(rank: str = "first_expected_rank", answerable: Column | None = None) -> Column:
    """The mean of 1 / rank, 0 where nothing was found."""
    part = F.coalesce(1.0 / F.col(rank), F.lit(0.0))
    return F.avg(part if answerable is None else F.when(answerable, part))


def citation_precision(cited: str = "cited", expected: str = "expected") -> Column:
    """Correct share of what was cited, over queries that cite something."""
    return F.avg(F.when(F.size(cited) > 0, F.size(F.array_intersect(cited, expected)) / F.size(cited)))


def citation_recall(cited: str = "cited", expected: str = "expected") -> Column:
    """Cited share of what was expected, over queries that expect something."""
    return F.avg(F.when(F.size(expected) > 0, F.size(F.array_intersect(cited, expected)) / F.size(expected)))


def multi_accuracy(passed: str = "status", recall: str = "decision_level_recall") -> list[Column]:
    """Strict passes and mean recall of queries with several expected rows."""
    return [F.avg((F.col(passed) == "PASS").cast("double")).alias("multi_strict"), F.avg(F.coalesce(recall, F.lit(0.0))).alias("multi_recall")]


def permission_accuracy(excluded: str = "excluded", passed: str = "status") -> Column:
    """E5: passes among queries with an exclusion list."""
    return F.avg(F.when(F.size(excluded) > 0, (F.col(passed) == "PASS").cast("double")))


def no_answer_accuracy(answerable: str = "expected_answerable", excluded: str = "excluded", passed: str = "status") -> Column:
    """E5: passes among unanswerable queries without an exclusion list."""
    return F.avg(F.when(~F.col(answerable) & (F.size(excluded) == 0), (F.col(passed) == "PASS").cast("double")))


def latency_stats(results: DataFrame, latency: str, dims: list[str]) -> DataFrame:
    """Mean, median, and the 95th percentile at index round-half-even(0.95 (n - 1)).

    Values are counted first, so a group is ranked by its distinct values, not by its rows.
    """
    value = F.col(latency)
    counts = results.where(value.isNotNull()).groupBy(*dims, value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*dims).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_upto": upto, "_n": F.sum("_c").over(Window.partitionBy(*dims))})
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col("_v")))
    middle = (at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2
    p95 = at(F.bround(F.lit(0.95) * (F.col("_n") - 1)).cast("long"))
    return ranked.groupBy(*dims).agg((F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean_latency"), middle.alias("median_latency"), p95.alias("p95_latency"))


def metrics_by_segment(results: DataFrame, metrics: list[Column], mode: str = "mode", segment: str = "segment") -> DataFrame:
    """Metrics over each mode and over each of its segments (segment null: all)."""
    return results.groupingSets([[mode], [mode, segment]], mode, segment).agg(*metrics)


def stage_latency(results: DataFrame, stages: str = "stage_latency_ms") -> DataFrame:
    """Mean latency of each pipeline stage."""
    return results.select(F.explode(stages).alias("stage", "ms")).groupBy("stage").agg(F.avg("ms").alias("mean_ms"), F.count(F.lit(1)).alias("n"))


def failed_open(results: DataFrame, flags: list[str]) -> DataFrame:
    """How many results went on without a step that failed, for each step's flag."""
    counts = results.agg(*(F.count_if(F.coalesce(f, F.lit(False))).alias(f) for f in flags), F.count(F.lit(1)).alias("_all"))
    cells = F.array(*(F.struct(F.lit(f).alias("step"), F.col(f).alias("failed_open"), F.col("_all").alias("n")) for f in flags))
    return counts.select(F.inline(cells))


def score_queries(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """PASS or FAIL of each question, and the rank of the first expected citation.

    A cited excluded row always fails; several expected rows must all be cited, of one or an
    alternative any; an unanswerable question must cite nothing.
    """
    none = F.array().cast("array<string>")
    rows = questions.join(answers.select("query_id", "cited"), "query_id", "left").withColumn("cited", F.coalesce("cited", none))
    leak = F.size(F.array_intersect("cited", "excluded_decision_ids")) > 0
    hits = F.size(F.array_intersect("cited", "expected_decision_ids"))
    good = F.when(leak, False).when(~F.col("expected_answerable"), F.when(F.size("excluded_decision_ids") > 0, True).otherwise(F.size("cited") == 0)).when(F.col("is_multi"), hits == F.size("expected_decision_ids")).otherwise(hits > 0)
    first = F.array_min(F.filter(F.transform("expected_decision_ids", lambda e: F.array_position("cited", e)), lambda p: p > 0))
    return rows.withColumns({"status": F.when(good, "PASS").otherwise("FAIL"), "leaked": leak, "first_expected_rank": first, "decision_level_recall": F.when(F.size("expected_decision_ids") > 0, hits / F.size("expected_decision_ids"))})


def security_findings(results: DataFrame) -> DataFrame:
    """Rows that break a rule: (query_id, finding)."""
    checks = {
        "reranked beyond authorized": F.size(F.array_except("reranked_ids", "authorized_ids")) > 0,
        "cited beyond authorized": F.size(F.array_except("cited", "authorized_ids")) > 0,
        "excluded row cited": F.size(F.array_intersect("cited", "excluded")) > 0,
        "refusal with citations": F.col("is_refusal") & (F.size("cited") > 0),
    }
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda f: f.isNotNull())
    return results.select("query_id", F.explode(found).alias("finding"))


def merge_retries(results: DataFrame, retries: DataFrame, key: str = "query_id", status: str = "status") -> DataFrame:
    """Rows in error replaced by the retry of the same id."""
    rest = [c for c in results.columns if c != key]
    again = retries.select(key, F.struct(*rest).alias("_r"))
    met = results.join(again, key, "left")
    take = (F.col(status) == "ERROR") & F.col("_r").isNotNull()
    return met.select(key, *[F.when(take, F.col("_r")[c]).otherwise(F.col(c)).alias(c) for c in rest])


def compare_runs(baseline: DataFrame, run: DataFrame, key: str = "query_id", status: str = "status") -> DataFrame:
    """Each query improved, regressed, unchanged or new against a baseline."""
    met = run.select(key, F.col(status).alias("now")).join(baseline.select(key, F.col(status).alias("before")), key, "left")
    change = F.when(F.col("before").isNull(), "new").when((F.col("before") != "PASS") & (F.col("now") == "PASS"), "improved").when((F.col("before") == "PASS") & (F.col("now") != "PASS"), "regressed").otherwise("unchanged")
    return met.withColumn("change", change)


def cross_mode_table(runs: DataFrame, value: str, modes: list[str], key: str = "query_id", mode: str = "mode") -> DataFrame:
    """One row for each query with a column for each mode."""
    return runs.groupBy(key).pivot(mode, modes).agg(F.first(value))


def reference_check(questions: DataFrame, corpus: DataFrame, item: str = "source_message_id") -> DataFrame:
    """Questions that refer to missing rows, contradict themselves, or expect nothing though answerable."""
    refs = questions.select("query_id", F.explode(F.array_union("expected_decision_ids", "excluded_decision_ids")).alias("ref"))
    missing = refs.join(corpus.select(F.col(item).alias("ref")).distinct(), "ref", "left_anti").select("query_id", F.concat(F.lit("missing "), "ref").alias("violation"))
    both = questions.where(F.size(F.array_intersect("expected_decision_ids", "excluded_decision_ids")) > 0).select("query_id", F.lit("expected and excluded").alias("violation"))
    odd = questions.where(F.col("expected_answerable") != (F.size("expected_decision_ids") > 0)).select("query_id", F.lit("answerable does not match").alias("violation"))
    return missing.unionByName(both).unionByName(odd)
