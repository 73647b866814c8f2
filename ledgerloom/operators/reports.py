"""Counts, coverage and volume reports over the register and its logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD_TYPES = ["decision", "action_item", "blocker"]
# Prices in dollars for a million tokens.
PRICES = {"input_tokens": 1.0, "output_tokens": 5.0, "cache_write_tokens": 1.25, "cache_read_tokens": 0.1}


def record_type_counts(decisions: DataFrame) -> DataFrame:
    """A1: counts of the three record types, zeros kept, others left out."""
    kinds = decisions.sparkSession.createDataFrame([(k,) for k in RECORD_TYPES], "record_type string")
    counts = decisions.groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(kinds).join(counts, "record_type", "left").fillna(0, ["n"])


def volume_by_day(rows: DataFrame, ts: str = "received_at") -> DataFrame:
    """A2: rows for each day with the oldest and newest time."""
    return rows.groupBy(F.date_trunc("day", ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("oldest"), F.max(ts).alias("newest"))


def queue_visibility(messages: DataFrame, as_of: Column, visible_at: str = "vt") -> DataFrame:
    """A3: messages visible now, locked, and all."""
    return messages.agg(F.count_if(F.col(visible_at) <= as_of).alias("visible"), F.count_if(F.col(visible_at) > as_of).alias("locked"), F.count(F.lit(1)).alias("total"))


def unique_vs_total(rows: DataFrame, keys: list[str], order: list[Column] | None = None, n: int | None = 1000, approximate: bool = False) -> DataFrame:
    """A4: distinct keys against all rows, over the latest ``n`` or (None) over everything."""
    some = rows if n is None else rows.orderBy(*order).limit(n)
    distinct = F.approx_count_distinct(F.struct(*keys)) if approximate else F.count_distinct(F.struct(*keys))
    return some.agg(distinct.alias("unique_keys"), F.count(F.lit(1)).alias("total"))


def sample_by_source(rows: DataFrame, source: Column, bulk: Column, body: Column, order: list[Column] | None = None, n: int | None = 1000) -> DataFrame:
    """A5: for each source the rows, bulk share (3 places) and mean body length."""
    some = rows if n is None else rows.orderBy(*order).limit(n)
    return some.groupBy(F.coalesce(source, F.lit("unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(bulk, F.lit(False)).cast("int")), 3).alias("bulk_share"), F.round(F.sum(F.length(body)) / F.count(F.lit(1)), 3).alias("mean_chars")
    )


def recent_status_counts(raw_events: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """Results of the last two hours by arrival and of the last day by triage, and new decisions."""
    rows = raw_events.where(F.col("received_at") >= as_of - F.expr("INTERVAL 2 HOURS")).groupBy(F.lit("received_2h").alias("report"), F.col("triage_result").alias("label"))
    arrived = rows.agg(F.count(F.lit(1)).alias("n"), F.min("received_at").alias("oldest"), F.max("received_at").alias("newest"))
    sorted_ = raw_events.where(F.col("triage_at") >= as_of - F.expr("INTERVAL 24 HOURS")).groupBy(F.lit("triaged_24h").alias("report"), F.col("triage_result").alias("label"))
    triaged = sorted_.agg(F.count(F.lit(1)).alias("n"), F.min("triage_at").alias("oldest"), F.max("triage_at").alias("newest"))
    made = decisions.where(F.col("created_at") >= as_of - F.expr("INTERVAL 2 HOURS")).agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
    return arrived.unionByName(triaged).unionByName(made.select(F.lit("decisions_2h").alias("report"), F.lit(None).cast("string").alias("label"), "n", "oldest", "newest"))


def source_link_coverage(decisions: DataFrame, links: DataFrame, key: str = "id", link_key: str = "decision_id", distinct: bool = True) -> DataFrame:
    """Decisions, those with a link and those without; without ``distinct`` a decision counts once for each link."""
    right = links.select(F.col(link_key).alias(key), F.lit(True).alias("_linked"))
    met = decisions.join(right.distinct() if distinct else right, key, "left")
    return met.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_linked").isNotNull()).alias("with_link"), F.count_if(F.col("_linked").isNull()).alias("without_link"))


def source_coverage(decisions: DataFrame, raw_events: DataFrame, links: DataFrame, source: str) -> DataFrame:
    """For each day the decisions of a source, those with a link and those without; day null: all days.

    A decision counts once, however many links it has; ids are those of its tenant.
    """
    own = ["id", "tenant_id"]
    origin = raw_events.where(F.col("source") == source).select(F.col("id").alias("origin_raw_event_id"), "tenant_id")
    linked = links.select(F.col("decision_id").alias("id"), "tenant_id").distinct().withColumn("_linked", F.lit(True))
    met = decisions.join(origin, ["origin_raw_event_id", "tenant_id"], "left_semi").join(linked, own, "left").withColumn("day", F.to_date("created_at"))
    return met.groupingSets([["day"], []], "day").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_linked").isNotNull()).alias("with_link"), F.count_if(F.col("_linked").isNull()).alias("without_link"))


def live_sources(decisions: DataFrame, raw_events: DataFrame) -> DataFrame:
    """The sources behind live decisions."""
    live = decisions.where("superseded_by IS NULL").select(F.col("origin_raw_event_id").alias("id"), "tenant_id")
    return raw_events.join(live, ["id", "tenant_id"], "left_semi").where("source IS NOT NULL").select("source").distinct()


def chat_volume(messages: DataFrame, ts: str, session: str, role: str, as_of: Column | None = None, days: int = 14) -> DataFrame:
    """User messages and distinct sessions for each day; the window is held to 1..90 days."""
    days = min(max(days, 1), 90)
    rows = messages if as_of is None else messages.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    return rows.groupBy(F.to_date(ts).alias("day")).agg(F.count_if(F.col(role) == "user").alias("user_messages"), F.count_distinct(session).alias("sessions"))


def chat_totals(messages: DataFrame, session: str, role: str) -> DataFrame:
    """User messages and distinct sessions of all time."""
    return messages.agg(F.count_if(F.col(role) == "user").alias("user_messages"), F.count_distinct(session).alias("sessions"))


def daily_sketches(rows: DataFrame, day: Column, by: list[str], counted: list[str], bits: int = 14) -> DataFrame:
    """For each day (and ``by``) the rows and a sketch of distinct values of ``counted``.

    Written once a day these stand in for the rows: any window is a merge of its days, however many
    rows they had.  The relative error is about 1.04 / 2 ** (bits / 2): under 1 % for 14 bits.
    """
    return rows.groupBy(day.alias("day"), *by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.to_json(F.array(*(F.col(c).cast("string") for c in counted))), bits).alias("sketch"))


def sketch_estimate(sketch: Column) -> Column:
    """The estimate of a sketch from its registers alone.

    A sketch that was filled row by row estimates from the order of its rows, a merged one from its registers, so the two
    differ for the same values; merged with itself a sketch keeps its registers and estimates as any merge does.
    """
    return F.hll_sketch_estimate(F.hll_union(sketch, sketch))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Rows and estimated distinct values over the days of ``sketches``; the same as one sketch of all rows."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def usage_cost(usage: DataFrame, prices: dict[str, float] = PRICES) -> DataFrame:
    """A10: the cost of token counters, 4 places."""
    cost = sum((F.col(c) * F.lit(p) / F.lit(1e6) for c, p in prices.items()), F.lit(0.0))
    return usage.withColumn("cost", F.round(cost, 4))


def accumulate_usage(calls: DataFrame, day: Column, counters: list[str]) -> DataFrame:
    """Counters summed and calls counted for each day."""
    return calls.groupBy(day.alias("usage_date")).agg(*[F.sum(c).alias(c) for c in counters], F.count(F.lit(1)).alias("request_count"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def corpus_distribution(corpus: DataFrame, dims: list[str], tags: str | None = None, scope: str | None = None, statement: str | None = None) -> DataFrame:
    """Counts by each dimension, by the prefix of each tag and by each combination of permissions, in one pass; distinct statements.

    An empty combination is ``none``; a combination keeps the order that it is written in.
    """
    one = lambda dim, value: F.struct(F.lit(dim).alias("dim"), value.alias("value"))
    cells = F.array(*[one(d, F.col(d).cast("string")) for d in dims], *([one("permissions", F.coalesce(F.nullif(F.array_join(scope, ","), F.lit("")), F.lit("none")))] if scope else []))
    if tags:
        cells = F.concat(cells, F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: one("tag", F.split_part(t, F.lit(":"), F.lit(1)))))
    out = corpus.select(F.explode(cells).alias("x")).groupBy("x.dim", "x.value").agg(F.count(F.lit(1)).alias("n"))
    if statement:
        out = out.unionByName(corpus.agg(F.count_distinct(statement).alias("n")).select(F.lit("distinct_statements").alias("dim"), F.lit(None).cast("string").alias("value"), "n"))
    return out


def exact_duplicates(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """Each repeat of a text with the first holder of it.

    Texts are grouped by a hash of theirs, aggregated before the shuffle, so copies of one text
    that hold a third of the rows do not meet in one task.
    """
    mark = F.sha2(F.col(text), 256)
    hashed = corpus.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), mark.alias("mark"))
    first = hashed.groupBy("mark").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return hashed.join(first, "mark").where("id != first_id").select("id", "first_id")


def table_counts(tables: dict[str, DataFrame], before: dict[str, int] | None = None) -> DataFrame:
    """Rows of each table, and the change against earlier counts."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        row = row.withColumn("delta", F.col("n") - F.lit((before or {}).get(name)).cast("long"))
        out = row if out is None else out.unionByName(row)
    return out


def outcome_counts(outcomes: DataFrame, errors: str | None = None) -> DataFrame:
    """Messages of each outcome, with up to five of the errors."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if errors:
        aggs.append(F.slice(F.array_sort(F.collect_set(errors)), 1, 5).alias("first_errors"))
    return outcomes.groupBy("outcome").agg(*aggs)


def feedback_summary(feedback: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Up and down signals side by side."""
    counts = feedback.groupBy(*(keys or ["tenant_id", "query"])).pivot("signal", ["up", "down"]).agg(F.count(F.lit(1)))
    return counts.fillna(0, ["up", "down"])


def pulse_sections(decisions: DataFrame, n: int = 3, section: str = "record_type", order: list[Column] | None = None, label: str = "decision_statement", start=None, end=None, created: str = "created_at") -> DataFrame:
    """For each section its size, its top rows and how many more there are; of a period if ``start`` and ``end`` (days) are given."""
    if start is not None:
        decisions = decisions.where((F.col(created) >= F.lit(start).cast("timestamp")) & (F.col(created) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))
    order = order or [F.desc("confidence"), F.desc("created_at"), F.asc("id")]
    ranked = decisions.withColumn("rank", F.row_number().over(Window.partitionBy(section).orderBy(*order))).where(F.col("rank") <= n)
    counts = decisions.groupBy(section).agg(F.count(F.lit(1)).alias("total"))
    more = F.when(F.col("total") > n, F.concat((F.col("total") - n).cast("string"), F.lit(" more"))).otherwise("")
    return ranked.select(section, "rank", F.col(label).alias("label")).join(counts, section).withColumn("more", more)
