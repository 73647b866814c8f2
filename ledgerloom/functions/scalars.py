"""Dates, similarity and small predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Shapes of identifiers.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
CHANNEL = r"^C[A-Z0-9]{8,}$"
CHAT_USER = r"^U[A-Z0-9]{6,}$"
CHANNEL_THREAD = r"^[CDG][A-Z0-9]{6,}$"


def monday(day: Column | str) -> Column:
    """The Monday of a date's week."""
    return F.to_date(F.date_trunc("week", col(day)))


def digest_week(now: Column | str, hour: int = 9) -> Column:
    """The week a digest covers: before Monday ``hour`` o'clock it is still the week before."""
    return monday(col(now) - F.expr(f"INTERVAL {hour} HOURS"))


def week_bounds(week_of: Column | str) -> tuple[Column, Column]:
    """First day and the last day (seven days on) of a digest's period."""
    return col(week_of), F.date_add(col(week_of), 7)


def iso_week(day: Column | str) -> Column:
    return F.weekofyear(col(day))


def quarter_label(day: Column | str) -> Column:
    return F.concat(F.lit("Q"), F.quarter(col(day)).cast("string"), F.lit(" "), F.year(col(day)).cast("string"))


def time_ago(ts: Column | str, as_of: Column) -> Column:
    """"just now", hours or days, rounded down."""
    hours = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(col(ts))) / 3600)
    return F.when(hours < 1, "just now").when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))


def sync_label(synced: Column | str, status: Column | str, as_of: Column) -> Column:
    """When a connection was synced, to the minute; times to come are now; others that are not active or never synced say so."""
    minutes = F.greatest(F.lit(0), F.floor((F.unix_micros(as_of) - F.unix_micros(col(synced))) / 60_000_000))
    near = F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).otherwise(time_ago(synced, as_of))
    return F.when(F.coalesce(col(status) == "active", F.lit(False)) & col(synced).isNotNull(), F.concat(F.lit("Synced "), near)).otherwise("Not yet synced")


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str, norm_a: Column, norm_b: Column) -> Column:
    """Cosine of two vectors whose norms are columns already; 0 if a norm is 0."""
    both = norm_a * norm_b
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def recency_weight(created: Column | str, as_of: Column, half_life_days: float = 14.0, boost: float = 1.0) -> Column:
    """1 + boost * 0.5^(age / half-life); a null date weighs 1, a future one as today."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(col(created))) / F.lit(86_400_000_000.0))
    return F.when(col(created).isNull(), F.lit(1.0)).otherwise(1 + boost * F.pow(F.lit(0.5), age / half_life_days))


def percent(confidence: Column | str) -> Column:
    """A share as a whole percentage, half up."""
    return F.concat(F.floor(col(confidence).cast("double") * 100 + 0.5).cast("string"), F.lit("%"))


def deterministic_uuid(*parts: Column) -> Column:
    """A UUID-shaped key of the parts, the same on every run."""
    h = F.sha2(F.concat_ws("\u0001", *parts), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def workspace_slug(name: Column | str, id_: Column | str) -> Column:
    """Lower-case words joined by dashes, and the first eight hex digits of the id."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.split_part(col(name), F.lit("@"), F.lit(1))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit("workspace")), F.lit("-"), F.substring(F.replace(col(id_), F.lit("-")), 1, 8))


def overlap(a: Column | str, b: Column | str) -> Column:
    """Members of both."""
    return F.array_intersect(col(a), col(b))


def difference(a: Column | str, b: Column | str) -> Column:
    """Members of the first only (U4)."""
    return F.array_except(col(a), col(b))


def json_merge(a: Column | str, b: Column | str) -> Column:
    """Two JSON objects of plain fields merged; the second wins."""
    maps = [F.coalesce(F.from_json(col(c), "map<string, string>"), F.create_map().cast("map<string, string>")) for c in (a, b)]
    return F.to_json(F.map_concat(F.map_filter(maps[0], lambda k, _: ~F.array_contains(F.map_keys(maps[1]), k)), maps[1]))


def json_without(a: Column | str, key: str) -> Column:
    """A JSON object of plain fields without one key."""
    return F.to_json(F.map_filter(F.from_json(col(a), "map<string, string>"), lambda k, _: k != key))
