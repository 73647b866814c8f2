"""Reads, joins, corrections and digests of the register that ``model`` makes of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import fulltext, fusion, governance, ingest, register, reports, similarity, threads
from ..sources import tables as stored
from .base import query, table
from .model import REGISTER, register_tables, text
from .search_queries import RANKED, SIZE, WORDS, bm25_sql, ranked, word_index

LIVE = "EXISTS (SELECT 1 FROM decisions d WHERE d.id = x.decision_id)"
ACTORS = """
people AS (SELECT a.decision_id, string_agg(a.actor_id || ':' || a.role || ':' || coalesce(n.name, '?'), '|' ORDER BY a.actor_id, a.role) AS people
  FROM decision_actors a LEFT JOIN names n ON n.id = a.actor_id AND n.tenant_id = a.tenant_id GROUP BY 1),
links AS (SELECT s.decision_id, string_agg(s.permalink, '|' ORDER BY s.permalink) AS links, array_to_string(list_sort(list(DISTINCT r.source) FILTER (WHERE r.source IS NOT NULL)), '|') AS platforms
  FROM decision_sources s LEFT JOIN raw_events r ON r.id = s.raw_event_id AND r.tenant_id = s.tenant_id GROUP BY 1)
"""


def flat_people(c="actors"):
    return F.array_join(F.transform(c, lambda a: F.concat_ws(":", a["id"], a["role"], F.coalesce(a["name"], F.lit("?")))), "|")


@query(REGISTER + f", {ACTORS} SELECT d.id, coalesce(p.people, '') AS people, coalesce(l.links, '') AS links, coalesce(l.platforms, '') AS platforms FROM decisions d LEFT JOIN people p ON p.decision_id = d.id LEFT JOIN links l ON l.decision_id = d.id")
def hydrate_decisions(spark, d):
    """Decisions with their people, links and platforms."""
    t = register_tables(spark, d)
    out = register.hydrate(t["decisions"], t["actors"], t["decision_actors"], t["decision_sources"], t["raw_events"])
    return out.select("id", flat_people().alias("people"), F.array_join("source_links", "|").alias("links"), F.array_join("source_platforms", "|").alias("platforms"))


@query(REGISTER + """
, l AS (SELECT d.id, r.source, d.created_at FROM decisions d LEFT JOIN raw_events r ON r.id = d.origin_raw_event_id AND r.tenant_id = d.tenant_id WHERE d.superseded_by IS NULL AND d.record_type = 'blocker' AND r.source = 'jira')
SELECT id, source, (SELECT count(*) FROM l) AS total FROM l ORDER BY created_at DESC, id LIMIT 200 OFFSET 30""")
def list_decisions(spark, d):
    """A page of the listing, with the origins' source; the limit is held to 200."""
    t = register_tables(spark, d)
    return register.list_decisions(t["decisions"], t["raw_events"], 1000, 30, "blocker", "jira").select("id", "source", "total")


@query(REGISTER + """
SELECT id, confidence FROM decisions d WHERE status = 'decided' AND confidence >= 0.1 AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-25'
  AND EXISTS (SELECT 1 FROM decision_actors a WHERE a.decision_id = d.id AND a.actor_id = 'a12')""")
def filter_decisions(spark, d):
    """All optional filters at once, an actor's decisions among them."""
    t = register_tables(spark, d)
    return register.filter_decisions(t["decisions"], t["decision_actors"], "decided", 0.1, "a12", "2024-01-05", "2024-01-25").select("id", "confidence")


@query(REGISTER + """
SELECT d.id, (SELECT arg_min(n.name, a.actor_id) FROM decision_actors a JOIN names n ON n.id = a.actor_id AND n.tenant_id = a.tenant_id WHERE a.decision_id = d.id AND a.role = 'decided_by' AND n.name IS NOT NULL) AS owner FROM decisions d""")
def decision_owner(spark, d):
    """The name of the first deciding actor."""
    t = register_tables(spark, d)
    named = t["actors"].where(register.actor_name().isNotNull())
    return register.owner(t["decisions"], t["decision_actors"], named).select("id", "owner")


@query(REGISTER + """
SELECT d.id FROM decisions d JOIN raw_events r ON r.id = d.origin_raw_event_id AND r.tenant_id = d.tenant_id WHERE r.source = 'gmail' AND NOT EXISTS (SELECT 1 FROM decision_sources s WHERE s.decision_id = d.id)""")
def missing_links(spark, d):
    """Decisions from mails that have no link row."""
    t = register_tables(spark, d)
    return register.missing_links(t["decisions"], t["raw_events"], t["decision_sources"], "gmail").select("id")


SEEN = "(len({0}) = 0 OR list_has_any({0}, ['jira', 'gmail']) OR len(list_filter({0}, lambda s: NOT regexp_matches(s, '^C[A-Z0-9]{{8,}}$'))) = 0)"


@query(REGISTER + f"""
, p AS (SELECT x.id, a.id AS one, b.id AS two, x.created_at, a.permission_scope AS sa, b.permission_scope AS sb FROM (SELECT * FROM decision_conflicts ORDER BY created_at DESC, id LIMIT 20) x
  JOIN decisions a ON a.id = x.decision_id AND a.tenant_id = x.tenant_id JOIN decisions b ON b.id = x.related_decision_id AND b.tenant_id = x.tenant_id),
v AS (SELECT * FROM p WHERE {SEEN.format("sa")} AND {SEEN.format("sb")})
SELECT id, one, two, (SELECT count(*) FROM v) AS total FROM v ORDER BY created_at DESC, id LIMIT 4""")
def attention(spark, d):
    """The newest conflicts of which the caller may see both sides."""
    t = register_tables(spark, d)
    out = register.attention(t["decision_conflicts"], t["decisions"], ["jira", "gmail"])
    return out.select("id", F.col("decision_id").alias("one"), F.col("related_decision_id").alias("two"), "total")


@query(REGISTER + """
, c AS (SELECT id FROM source_connections WHERE status = 'paused'), r AS (SELECT id FROM raw_events WHERE connection_id IN (SELECT id FROM c)), g AS (SELECT id FROM decisions WHERE origin_raw_event_id IN (SELECT id FROM r))
SELECT 'source_connections' AS name, count(*) FILTER (WHERE hit) AS doomed, count(*) FILTER (WHERE NOT hit) AS kept FROM (SELECT id IN (SELECT id FROM c) AS hit FROM source_connections)
UNION ALL SELECT 'raw_events', count(*) FILTER (WHERE hit), count(*) FILTER (WHERE NOT hit) FROM (SELECT id IN (SELECT id FROM r) AS hit FROM raw_events)
UNION ALL SELECT 'decisions', count(*) FILTER (WHERE hit), count(*) FILTER (WHERE NOT hit) FROM (SELECT id IN (SELECT id FROM g) AS hit FROM decisions)
UNION ALL SELECT 'decision_actors', count(*) FILTER (WHERE hit), count(*) FILTER (WHERE NOT hit) FROM (SELECT decision_id IN (SELECT id FROM g) AS hit FROM decision_actors)
UNION ALL SELECT 'decision_sources', count(*) FILTER (WHERE hit), count(*) FILTER (WHERE NOT hit) FROM (SELECT decision_id IN (SELECT id FROM g) OR raw_event_id IN (SELECT id FROM r) AS hit FROM decision_sources)
UNION ALL SELECT 'decision_conflicts', count(*) FILTER (WHERE hit), count(*) FILTER (WHERE NOT hit) FROM (SELECT decision_id IN (SELECT id FROM g) OR related_decision_id IN (SELECT id FROM g) AS hit FROM decision_conflicts)
UNION ALL SELECT 'actors', 0, count(*) FROM actors""")
def cascade_delete(spark, d):
    """Paused connections go, and with them their messages, decisions and all that hangs on these."""
    t = register_tables(spark, d)
    kept, gone = governance.cascade_delete(t, "source_connections", "id", t["source_connections"].where("status = 'paused'").select("id"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rows = [count(kept[name], "kept").crossJoin(count(gone[name], "doomed") if name in gone else spark.range(1).select(F.lit(0).cast("long").alias("doomed"))).select(F.lit(name).alias("name"), "doomed", "kept") for name in t]  # one row each
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(REGISTER + ", m AS (SELECT tenant_id FROM names WHERE id IN ('a1', 'a7')) SELECT id, tenant_id FROM decisions WHERE tenant_id IN (SELECT tenant_id FROM m) AND tenant_id = 't1'")
def tenant_reads(spark, d):
    """A member's rows, of one tenant, and none of another."""
    t = register_tables(spark, d)
    members = t["actors"].where("id IN ('a1', 'a7')").select("tenant_id", F.lit("u").alias("user_id"))
    own = register.tenant_members_only(t["decisions"].select("id", "tenant_id"), members, "u")
    return register.assert_tenant(register.tenant_scope(own, "t1"), "t1").select("id", "tenant_id")


@query(REGISTER + "SELECT d.id, list_sum(list_transform(v.embedding::DOUBLE[], lambda x: x * x)) > 0 AS has_vector FROM decisions d JOIN embeddings v ON v.vec_id = d.event_id")
def embedded_decisions(spark, d):
    """Decisions that have a vector."""
    t = register_tables(spark, d)
    v = table(spark, d, "embeddings").select(text("d", F.col("vec_id")).alias("decision_id"), "embedding")
    v = v.join(t["decisions"].select(F.col("id").alias("decision_id"), "tenant_id"), "decision_id")
    return register.embedded_decisions(v, t["decisions"]).select("id", (scalars.norm("embedding") > 0).alias("has_vector"))


@query(REGISTER + "SELECT DISTINCT r.source FROM raw_events r JOIN decisions d ON d.origin_raw_event_id = r.id AND d.tenant_id = r.tenant_id WHERE d.superseded_by IS NULL")
def live_sources(spark, d):
    """Sources behind live decisions."""
    t = register_tables(spark, d)
    return reports.live_sources(t["decisions"], t["raw_events"])


@query(REGISTER + """
, named AS (SELECT id, tenant_id, coalesce(nullif(trim(display_name), ''), email, slack_user_id) AS name FROM actors)
SELECT a.decision_id, string_agg(n.name, '|' ORDER BY n.name) AS participants FROM decision_actors a JOIN named n ON n.id = a.actor_id AND n.tenant_id = a.tenant_id GROUP BY 1""")
def participants(spark, d):
    """The names behind each decision."""
    t = register_tables(spark, d)
    return ingest.participants(t["decision_actors"], t["actors"]).select("decision_id", F.array_join("participants", "|").alias("participants"))


@query(REGISTER + """
, w AS (SELECT tenant_id, list_sort(list(DISTINCT external_workspace_id)) AS all_, list_sort(list(DISTINCT external_workspace_id) FILTER (WHERE source = 'gmail')) AS mail FROM source_connections WHERE status = 'active' GROUP BY 1)
SELECT a.id AS user_id, array_to_string(list_concat(CASE WHEN email IS NULL THEN [] ELSE [email] END, coalesce(all_, [])), '|') AS scopes, array_to_string(list_concat(CASE WHEN email IS NULL THEN [] ELSE [email] END, coalesce(mail, [])), '|') AS mail_scopes FROM actors a LEFT JOIN w ON w.tenant_id = a.tenant_id""")
def caller_scopes(spark, d):
    """What each person may see, in full and by mail connections only."""
    t = register_tables(spark, d)
    users = t["actors"].select("tenant_id", F.col("id").alias("user_id"), "email")
    flat = lambda mail, name: register.caller_scopes(users, t["source_connections"], mail).select("user_id", F.array_join("scopes", "|").alias(name))
    return flat(False, "scopes").join(flat(True, "mail_scopes"), "user_id")


@query(REGISTER + """
SELECT 'c' || s_suppkey AS item_id, s_suppkey % 3 <> 1 AS included FROM supplier""")
def capture_rules(spark, d):
    """Items without a rule are included; a third has a rule that leaves them out, another one that takes them in."""
    t = register_tables(spark, d)
    items = t["source_connections"].select("tenant_id", "source", F.col("id").alias("item_id"))
    k = F.substring("item_id", 2, 99).cast("long") % 3
    rules = items.where(k > 0).withColumn("included", k == 2)
    return register.effective_capture_rules(items, rules).select("item_id", "included")


@query(r"""
WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'gmail' WHEN 'signup' THEN 'notion' ELSE 'slack' END AS source,
  CASE WHEN event_id % 3 = 0 THEN 'C0' || lpad(event_id::VARCHAR, 8, '0') ELSE 'T' || event_id END AS thread_ref,
  CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'https://mail.google.com/mail/u/0/#all/x' WHEN event_type = 'click' THEN 'https://kept/' || event_id WHEN event_type = 'signup' THEN NULL
    WHEN event_id % 2 = 0 THEN 'https://app/x?channel=C1&message_ts=17.' || event_id ELSE 'https://w/archives/C77/p' || lpad(event_id::VARCHAR, 10, '1') || '123456' END AS permalink FROM events)
SELECT event_id, CASE WHEN source = 'slack' AND event_id % 3 = 0 THEN 's-' || event_id ELSE thread_ref END AS thread_ref,
  CASE WHEN source = 'gmail' AND event_id % 2 = 0 THEN 'https://mail.google.com/mail/u/?authuser=me@x.org#all/s-' || event_id WHEN source = 'notion' THEN 'https://www.notion.so/s' || event_id ELSE permalink END AS fixed_permalink,
  CASE WHEN source <> 'slack' THEN NULL WHEN event_id % 2 = 0 THEN 'C1' ELSE 'C77' END AS link_channel,
  CASE WHEN source <> 'slack' THEN NULL WHEN event_id % 2 = 0 THEN '17.' || event_id ELSE lpad(event_id::VARCHAR, 10, '1') || '.123456' END AS link_ts FROM r""")
def repaired_links(spark, d):
    """Threads that are channels take the message's id; links are rebuilt or read."""
    n, kind = F.col("event_id"), F.col("event_type")
    source = F.when(kind == "click", "gmail").when(kind == "signup", "notion").otherwise("slack")
    link = F.when((kind == "click") & (n % 2 == 0), F.lit("https://mail.google.com/mail/u/0/#all/x")).when(kind == "click", text("https://kept/", n)).when(kind == "signup", F.lit(None)).when(n % 2 == 0, text("https://app/x?channel=C1&message_ts=17.", n)).otherwise(text("https://w/archives/C77/p", F.lpad(n.cast("string"), 10, "1"), "123456"))
    rows = table(spark, d, "events").select("event_id", source.alias("source"), text("s-", n).alias("source_id"), F.when(n % 3 == 0, text("C0", F.lpad(n.cast("string"), 8, "0"))).otherwise(text("T", n)).alias("thread_ref"), link.alias("permalink"), F.lit("me@x.org").alias("external_workspace_id"))
    return register.build_permalinks(register.repair_thread_ref(rows)).select("event_id", "thread_ref", "fixed_permalink", "link_channel", "link_ts")


@query(r"SELECT c_custkey, coalesce(nullif(regexp_replace(regexp_replace(lower(split_part(c_name || ' & Co!@x', '@', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'workspace') || '-' || left(replace(lpad(c_custkey::VARCHAR, 9, 'a-'), '-', ''), 8) AS slug FROM customer")
def workspace_slugs(spark, d):
    """Slugs of names and ids."""
    name, id_ = F.concat("c_name", F.lit(" & Co!@x")), F.lpad(F.col("c_custkey").cast("string"), 9, "a-")
    return table(spark, d, "customer").select("c_custkey", scalars.workspace_slug(name, id_).alias("slug"))


@query(REGISTER + """
, k AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'edited' ELSE 'rejected' END AS action FROM decisions WHERE event_id % 10 < 3),
r AS (SELECT d.id, d.decision_statement, CASE WHEN k.action = 'confirmed' THEN 'decided' WHEN k.action IS NOT NULL THEN 'superseded' ELSE d.status END AS status, k.action = 'edited' AS pointed, false AS fresh FROM decisions d LEFT JOIN k ON k.id = d.id
  UNION ALL SELECT NULL, 'better ' || id, 'decided', false, true FROM k WHERE action = 'edited')
SELECT coalesce(id, '-') AS id, decision_statement, status, coalesce(pointed, false) AS pointed, (SELECT count(*) FROM k) AS logged FROM r""")
def corrections(spark, d):
    """Confirmations, edits and rejections applied; the log has every one of them."""
    t = register_tables(spark, d)
    rows = t["decisions"].withColumns({"superseded_by": F.lit(None).cast("string"), "updated_at": F.col("created_at")})
    n = F.col("event_id")
    made = rows.where("event_id % 10 < 3").select(text("k", n).alias("id"), F.col("id").alias("decision_id"), "tenant_id", F.when(n % 5 == 0, "confirmed").when(n % 5 == 1, "edited").otherwise("rejected").alias("action"), text("better ", F.col("id")).alias("corrected_statement"), F.col("created_at").alias("corrected_at"))
    out, log = register.expand_corrections(rows, made)
    fresh = F.col("decision_statement").startswith("better ")
    return out.select(F.when(fresh, "-").otherwise(F.col("id")).alias("id"), "decision_statement", "status", F.col("superseded_by").isNotNull().alias("pointed")).crossJoin(log.agg(F.count(F.lit(1)).alias("logged")))  # one row


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS corrected_at FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC")
def corrections_history(spark, d):
    """One decision's corrections, newest first."""
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("decision_id"), F.col("ts").alias("corrected_at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"))
    return register.corrections_history(rows, 7).select("event_id", F.date_format("corrected_at", "yyyy-MM-dd HH:mm:ss").alias("corrected_at"))


@query(REGISTER + """
SELECT 'all' AS part, id FROM (SELECT id FROM decisions ORDER BY created_at DESC, id LIMIT 2000)
UNION ALL SELECT 'latest', id FROM (SELECT id FROM decisions ORDER BY confidence DESC, id LIMIT 25)
UNION ALL SELECT 'top', id FROM (SELECT id FROM decisions ORDER BY confidence DESC, id LIMIT 50)""")
def capped_lists(spark, d):
    """The listing up to its cap, the latest rows, the best ones."""
    rows = register_tables(spark, d)["decisions"]
    order = [F.desc("confidence"), F.asc("id")]
    parts = {"all": register.list_all(rows), "latest": register.latest_n(rows, order, 25), "top": similarity.top_k(rows, order, 50)}
    named = [df.select(F.lit(name).alias("part"), "id") for name, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("""
WITH t AS (SELECT doc_id, string_split(lang || ',' || source || ',x', ',') AS a, ['en', source, 'src1'] AS b FROM documents)
SELECT doc_id, array_to_string(list_sort(list_intersect(a, b)), '|') AS both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '|') AS first_only,
  'k=' || (doc_id % 3) || ',l=' || a[1] || ',m=1' AS merged, '{"l":"' || a[1] || '"}' AS without FROM t""")
def collections(spark, d):
    """Overlap, difference, merged and reduced objects."""
    a, b = F.array("lang", "source", F.lit("x")), F.array(F.lit("en"), F.col("source"), F.lit("src1"))
    old, new = F.to_json(F.struct(F.lit("9").alias("k"), F.col("lang").alias("l"))), F.to_json(F.struct((F.col("doc_id") % 3).cast("string").alias("k"), F.lit("1").alias("m")))
    merged = F.from_json(scalars.json_merge(old, new), "map<string, string>")
    flat = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(scalars.overlap(a, b)), "|").alias("both"), F.array_join(F.array_sort(scalars.difference(a, b)), "|").alias("first_only"), flat.alias("merged"), scalars.json_without(old, "k").alias("without"))


@query(REGISTER + f"""
, {ACTORS}, sides AS (SELECT decision_id AS id, related_decision_id AS other FROM decision_conflicts UNION ALL SELECT related_decision_id, decision_id FROM decision_conflicts),
k AS (SELECT id, string_agg(other, '|' ORDER BY other) AS conflicts FROM sides GROUP BY 1),
linked AS (SELECT DISTINCT tenant_id, decision_id, id FROM (SELECT tenant_id, id AS decision_id, origin_raw_event_id AS id FROM decisions WHERE origin_raw_event_id IS NOT NULL UNION ALL SELECT tenant_id, decision_id, raw_event_id FROM decision_sources)),
own AS (SELECT l.*, r.thread_ref, r.received_at FROM linked l JOIN raw_events r ON r.id = l.id AND r.tenant_id = l.tenant_id),
spans AS (SELECT tenant_id, decision_id, thread_ref, min(received_at) - INTERVAL 6 HOUR AS f, max(received_at) + INTERVAL 6 HOUR AS t FROM own GROUP BY ALL),
near AS (SELECT DISTINCT decision_id, id FROM (SELECT s.decision_id, r.id FROM spans s JOIN raw_events r ON r.tenant_id = s.tenant_id AND r.thread_ref = s.thread_ref AND r.received_at BETWEEN s.f AND s.t UNION ALL SELECT decision_id, id FROM own)),
th AS (SELECT decision_id, count(*) AS n_thread FROM near GROUP BY 1)
SELECT d.id, coalesce(p.people, '') AS people, coalesce(l.links, '') AS links, coalesce(k.conflicts, '') AS conflicts, least(coalesce(th.n_thread, 0), 40) AS n_thread, strftime(r.received_at, '%Y-%m-%d %H:%M:%S') AS received
FROM decisions d LEFT JOIN people p ON p.decision_id = d.id LEFT JOIN links l ON l.decision_id = d.id LEFT JOIN k ON k.id = d.id LEFT JOIN th ON th.decision_id = d.id LEFT JOIN raw_events r ON r.id = d.origin_raw_event_id AND r.tenant_id = d.tenant_id WHERE d.record_type = 'blocker'""")
def decision_detail(spark, d):
    """Decisions with people, links, conflicts, arrival and thread."""
    t = register_tables(spark, d)
    out = threads.decision_detail(t["decisions"].where("record_type = 'blocker'"), t)
    conflicts = F.array_join(F.array_sort(F.transform("conflicts", lambda x: x["other_id"])), "|")
    return out.select("id", flat_people().alias("people"), F.array_join("source_links", "|").alias("links"), F.coalesce(conflicts, F.lit("")).alias("conflicts"), F.coalesce(F.size("thread"), F.lit(0)).cast("long").alias("n_thread"), F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received"))


@query(REGISTER + """
, l AS (SELECT DISTINCT tenant_id, decision_id, id FROM (SELECT tenant_id, id AS decision_id, origin_raw_event_id AS id FROM decisions WHERE origin_raw_event_id IS NOT NULL UNION ALL SELECT tenant_id, decision_id, raw_event_id FROM decision_sources))
SELECT d.id, coalesce((SELECT string_agg(r.id || ':' || r.source, '|' ORDER BY r.received_at, r.id) FROM l JOIN raw_events r ON r.id = l.id AND r.tenant_id = l.tenant_id WHERE l.decision_id = d.id), '') AS sources FROM decisions d WHERE d.tenant_id = 't3'""")
def decision_context(spark, d):
    """One tenant's decisions with their sources, oldest first."""
    t = register_tables(spark, d)
    out = threads.decision_context(t["decisions"], "t3", t)
    return out.select("id", F.coalesce(F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["raw_event_id"], s["source"])), "|"), F.lit("")).alias("sources"))


@query(REGISTER + """
, s AS (SELECT decision_id, event_id, turn, is_source, n FROM (SELECT d.id AS decision_id, d.event_id AS own, e.event_id, d.event_id = e.event_id AS is_source, row_number() OVER (PARTITION BY d.id ORDER BY e.ts, 'r' || e.event_id) AS turn, least(40, count(*) OVER (PARTITION BY d.id)) AS n, e.ts
  FROM decisions d JOIN ev e ON e.user_id = d.user_id AND e.ts BETWEEN d.created_at - INTERVAL 5 MINUTE - INTERVAL 20 DAY AND d.created_at - INTERVAL 5 MINUTE + INTERVAL 20 DAY WHERE d.event_id % 50 = 1 AND d.event_id % 7 <> 0) WHERE turn <= 40),
p AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY is_source DESC, (event_id * 7919) % 1000 DESC, turn) AS pick FROM s)
SELECT decision_id, event_id, row_number() OVER (PARTITION BY decision_id ORDER BY turn) AS turn FROM p WHERE n <= 12 OR is_source OR pick <= 20""")
def thread_relevance(spark, d):
    """Long threads cut to their source messages and the most similar ones."""
    t = register_tables(spark, d)
    some = t["decisions"].where("event_id % 50 = 1 AND event_id % 7 <> 0")
    none = t["decision_sources"].where(F.lit(False))
    thread = threads.thread_context(some, t["raw_events"], none, "20 days")
    number = F.substring("id", 2, 99).cast("long")
    likeness = thread.select("decision_id", "id", (number * 7919 % 1000).cast("double").alias("similarity"))
    return threads.thread_relevance(thread, likeness).select("decision_id", number.alias("event_id"), "turn")


@query(REGISTER + """
, people AS (SELECT tenant_id, discord_user_id AS m, coalesce(nullif(trim(display_name), ''), email) AS name FROM actors
  UNION ALL SELECT 't' || ((c_custkey + 1) % 10), '1' || lpad(c_custkey::VARCHAR, 16, '0'), 'B ' || c_name FROM customer),
e AS (SELECT event_id, 't' || (user_id % 10) AS tenant_id, '1' || lpad(user_id::VARCHAR, 16, '0') AS m, '1' || lpad((user_id - 1)::VARCHAR, 16, '0') AS k FROM events)
SELECT event_id, 'ask ' || coalesce('@' || a.name, '<@' || e.m || '>') || ' or ' || coalesce('@' || b.name, '<@!' || e.k || '>') || ' or <@99999999999999999>' AS text
FROM e LEFT JOIN people a ON a.tenant_id = e.tenant_id AND a.m = e.m LEFT JOIN people b ON b.tenant_id = e.tenant_id AND b.m = e.k""")
def mention_names(spark, d):
    """Mentions of known people by the name that the message's tenant knows; two tenants know each id, by different names."""
    actors = register_tables(spark, d)["actors"]
    k, number = F.col("c_custkey"), lambda c: F.lpad(c.cast("string"), 16, "0")
    other = table(spark, d, "customer").select(text("t", (k + 1) % 10).alias("tenant_id"), text("1", number(k)).alias("discord_user_id"), text("B ", F.col("c_name")).alias("display_name"), F.lit(None).cast("string").alias("email"))
    people = actors.select(*other.columns).unionByName(other)
    u = F.col("user_id")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), text("t", u % 10).alias("tenant_id"), text("ask <@1", number(u), "> or <@!1", number(u - 1), "> or <@99999999999999999>").alias("text"))
    return threads.mention_names(rows, people).select(F.col("id").alias("event_id"), "text")


# Retrieval ------------------------------------------------------------------------------------------


@query(RANKED + """
, one AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM l WHERE list = 'a' GROUP BY 1, 2)
SELECT 'semantic_only' AS mode, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM one QUALIFY position <= 30
UNION ALL SELECT 'hybrid_rrf', query_id, doc_id, position FROM o WHERE position <= 30""")
def retrieve_modes(spark, d):
    """One list alone, and both fused."""
    lists = ranked(spark, d)
    first, second = (lists.where(F.col("list") == k) for k in "ab")
    parts = [fusion.retrieve(first, second, mode, 30, "doc_id").select(F.lit(mode).alias("mode"), "query_id", "doc_id", "position") for mode in ("semantic_only", "hybrid_rrf")]
    return parts[0].unionByName(parts[1])


@query(RANKED + """
, c AS (SELECT o.query_id, o.doc_id, o.position, d.source, d.text FROM o JOIN documents d ON d.doc_id = o.doc_id WHERE o.position <= 20),
v AS (SELECT * FROM c WHERE source IN ('src1', 'src2', 'src3') OR source = 'src' || length(query_id)),
r AS (SELECT * FROM v),
g AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS place FROM r)
SELECT q.query_id, (SELECT count(*) FROM c WHERE c.query_id = q.query_id) AS retrieved, (SELECT count(*) FROM v WHERE v.query_id = q.query_id) AS authorized, (SELECT count(*) FROM g WHERE g.query_id = q.query_id AND g.place <= 7) AS final,
  coalesce((SELECT string_agg(doc_id, '|' ORDER BY g.place) FROM g WHERE g.query_id = q.query_id AND g.place <= 7), '') AS ids FROM (SELECT DISTINCT lang AS query_id FROM documents) q""")
def search_batch(spark, d):
    """A question for each language in one plan: fusion, permissions, rerank, cut, context and counts."""
    docs = table(spark, d, "documents")
    questions = docs.select(F.col("lang").alias("query_id")).distinct().withColumns({"scopes": F.array(F.lit("src1"), F.lit("src2"), F.lit("src3"), text("src", F.length("query_id"))), "entities": F.array(F.lit("edble"))})
    decisions = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("decision_statement"), F.lit(None).cast("string").alias("rationale"), F.array().cast("array<string>").alias("alternatives_considered"), F.lit(0.5).alias("confidence"), F.array("source").alias("permission_scope"))
    out = fusion.search_batch(questions, ranked(spark, d).withColumnRenamed("doc_id", "decision_id"), decisions, 5)
    return out.select("query_id", "retrieved", "authorized", "final", F.coalesce(F.array_join(F.transform("decision_ids", lambda x: x.cast("string")), "|"), F.lit("")).alias("ids"))


@query(rf"""{WORDS},
n AS (SELECT count(*) AS n, avg(dl) AS mean FROM b),
q AS (SELECT doc_id AS query_id, unnest(list_distinct(list_filter([w[1], w[9]], lambda x: x IS NOT NULL))) AS term FROM b WHERE doc_id % 20 = 0 UNION ALL SELECT doc_id, 'nosuchword' FROM b WHERE doc_id % 100 = 0),
wanted AS (SELECT query_id, count(*) AS wanted FROM q GROUP BY 1),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(w) AS term FROM b) WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n.n - f.df + 0.5) / (f.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / n.mean))) AS score, count(*) AS m FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s JOIN wanted USING (query_id) WHERE m = wanted QUALIFY rank <= 40""")
def search_many(spark, d):
    """All words of a question, for a question of each twentieth document, against a written index."""
    docs = table(spark, d, "documents").where("doc_id % 20 = 0").withColumn("w", fulltext.tokens(F.col("text")))
    words = F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(8)), F.when(F.col("doc_id") % 100 == 0, "NoSuchWord"))
    return fulltext.search_many(docs.select(F.col("doc_id").alias("query_id"), words.alias("query")), word_index(spark, d), 40, web=False).withColumn("score", F.round("score", 6))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'q ' || source ELSE lang || ' OR ' || source END AS question FROM documents")
def or_queries(spark, d):
    """Keywords joined by OR, or the question itself."""
    words = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source"))
    return table(spark, d, "documents").select("doc_id", fulltext.or_query(words, text("q ", F.col("source"))).alias("question"))


@query("""
WITH e AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
k AS (SELECT a AS id, b AS other_id, s FROM e WHERE s >= 0.3 UNION ALL SELECT b, a, s FROM e WHERE s >= 0.3), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other_id) AS rank FROM k),
j AS (SELECT id, other_id, s, CASE WHEN (id + other_id) % 2 = 0 THEN 'duplicates' ELSE 'contradicts' END AS kind, ((id * 31 + other_id * 17) % 100) / 100.0 AS confidence FROM r WHERE rank <= 3),
dup AS (SELECT least(id, other_id) AS older, greatest(id, other_id) AS newer, s FROM j WHERE kind = 'duplicates' AND confidence >= 0.6),
best AS (SELECT older, arg_max(newer, (s, -newer)) AS newer FROM dup GROUP BY 1)
SELECT 'row' AS part, v.vec_id AS id, b.newer AS other FROM embeddings v LEFT JOIN best b ON b.older = v.vec_id
UNION ALL SELECT 'edge', id, other_id FROM j WHERE kind = 'contradicts' AND confidence >= 0.6""")
def detect_conflicts(spark, d):
    """Labelled candidates applied: duplicates superseded, contradictions as edges."""
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    found = similarity.conflict_candidates(v, 0.3, 3, SIZE, ["label"])
    kind = F.when((F.col("id") + F.col("other_id")) % 2 == 0, "duplicates").otherwise("contradicts")
    labels = found.select("id", "other_id", kind.alias("relationship"), F.lit("r").alias("reason"), ((F.col("id") * 31 + F.col("other_id") * 17) % 100 / 100.0).alias("confidence"))
    rows = v.select("id", F.timestamp_seconds("id").alias("created_at"), F.lit(None).cast("long").alias("superseded_by"))
    out, edges = similarity.detect_conflicts(rows, found, labels)
    return out.select(F.lit("row").alias("part"), "id", F.col("superseded_by").alias("other")).unionByName(edges.select(F.lit("edge").alias("part"), F.col("decision_id").alias("id"), F.col("related_decision_id").alias("other")))


@query(REGISTER + """
, readers AS (SELECT DISTINCT tenant_id, NULL AS user_id, 'team' AS scope, []::VARCHAR[] AS scopes FROM decisions UNION ALL SELECT tenant_id, id, 'personal', CASE WHEN email IS NULL THEN [] ELSE [email, 'jira'] END FROM actors WHERE length(id) = 3),
m AS (SELECT tenant_id, NULL AS asker, id AS decision_id, row_number() OVER (PARTITION BY tenant_id ORDER BY confidence DESC, id) AS rank FROM decisions
  UNION ALL SELECT tenant_id, 'a' || user_id, id, row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY created_at, id) FROM decisions WHERE user_id % 3 = 0),
p AS (SELECT r.*, EXISTS (SELECT 1 FROM m WHERE m.tenant_id = r.tenant_id AND m.asker = r.user_id) AS personalized FROM readers r)
SELECT p.tenant_id, p.user_id, p.personalized, coalesce(string_agg(m.rank || ':' || m.decision_id, '|' ORDER BY m.rank, m.decision_id) FILTER (WHERE d.id IS NOT NULL), '') AS items, '2024-01-15' AS week_of
FROM p LEFT JOIN m ON m.tenant_id = p.tenant_id AND m.rank <= 5 AND CASE WHEN p.personalized THEN m.asker = p.user_id ELSE m.asker IS NULL END
LEFT JOIN decisions d ON d.id = m.decision_id AND (len(d.permission_scope) = 0 OR list_has_any(d.permission_scope, p.scopes) OR d.permission_scope = ['C0AAAAAAAA1']) GROUP BY 1, 2, 3""")
def weekly_digest(spark, d):
    """A digest for each team and each member, by what they may see."""
    from pyspark.sql import Window

    t = register_tables(spark, d)
    rows = t["decisions"]
    n = lambda *by: F.row_number().over(Window.partitionBy(*by[0]).orderBy(*by[1]))
    team = rows.select("tenant_id", F.lit(None).cast("string").alias("user_id"), n(["tenant_id"], [F.desc("confidence"), "id"]).alias("rank"), F.col("id").alias("decision_id"))
    own = rows.where("user_id % 3 = 0").select("tenant_id", text("a", F.col("user_id")).alias("user_id"), n(["tenant_id", "user_id"], ["created_at", "id"]).alias("rank"), F.col("id").alias("decision_id"))
    people = t["actors"].where(F.length("id") == 3)
    members = people.select("tenant_id", F.col("id").alias("user_id"))
    scopes = people.select("tenant_id", F.col("id").alias("user_id"), F.when(F.col("email").isNull(), F.array().cast("array<string>")).otherwise(F.array("email", F.lit("jira"))).alias("scopes"))
    tenants = rows.select(F.col("tenant_id").alias("id")).distinct()
    out = governance.weekly_digest(team.unionByName(own), tenants, members, rows, scopes, F.lit("2024-01-20 12:00:00").cast("timestamp"), 5)
    return out.select("tenant_id", "user_id", "personalized", F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["rank"], i["decision_id"])), "|").alias("items"), F.date_format("week_of", "yyyy-MM-dd").alias("week_of"))


@query("""
SELECT 't' || (o_custkey % 50) AS tenant_id, 'u' || o_custkey AS user_id, '2024-01-15' AS week_of, CASE WHEN o_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS summary FROM (SELECT DISTINCT o_custkey FROM orders)
UNION ALL SELECT 't' || (o_custkey % 50), 'u' || o_custkey, '2024-01-08', 'old' FROM (SELECT DISTINCT o_custkey FROM orders)""")
def digest_store(spark, d):
    """The current week's digests replaced, past ones kept."""
    keys = table(spark, d, "orders").select("o_custkey").distinct()
    base = keys.select(text("t", F.col("o_custkey") % 50).alias("tenant_id"), text("u", F.col("o_custkey")).alias("user_id"), "o_custkey")
    at = lambda week, word: base.select("tenant_id", "user_id", F.to_date(F.lit(week)).alias("week_of"), F.lit(word).alias("summary"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), "o_custkey")
    stored_ = at("2024-01-15", "old").unionByName(at("2024-01-08", "old")).drop("o_custkey")
    new = at("2024-01-15", "new").unionByName(at("2024-01-08", "new")).where("o_custkey % 2 = 0").drop("o_custkey")
    out = governance.digest_store(stored_, new, F.lit("2024-01-17 08:00:00").cast("timestamp"))
    return out.select("tenant_id", "user_id", F.date_format("week_of", "yyyy-MM-dd").alias("week_of"), "summary")


@query(REGISTER + """
, c AS (SELECT tenant_id, source AS tool_name, event_id, (event_id % 900) AS ms, CASE WHEN event_id % 4 = 0 THEN []::VARCHAR[] ELSE ['d' || user_id, 'd' || (event_id % 20)] END AS ids FROM ev)
SELECT tenant_id, tool_name, count(*) AS calls, round(avg(ms), 6) AS mean_latency_ms, (SELECT count(DISTINCT x) FROM (SELECT unnest(ids) AS x FROM c k WHERE k.tenant_id = c.tenant_id AND k.tool_name = c.tool_name)) AS decisions FROM c GROUP BY 1, 2""")
def tool_usage(spark, d):
    """Logged calls by tenant and tool, and the decisions they returned."""
    t = register_tables(spark, d)
    n = F.substring("id", 2, 99).cast("long")
    ids = F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("d"), F.substring("thread_ref", 2, 99)), text("d", n % 20)))
    calls = t["raw_events"].select("tenant_id", F.col("source").alias("tool_name"), (n % 900).alias("latency_ms"), ids.alias("result_decision_ids"))
    return fusion.tool_usage(calls).withColumn("mean_latency_ms", F.round("mean_latency_ms", 6))


# Writes ---------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT -s_suppkey - 1, s_name FROM supplier")
def insert_ignore(spark, d):
    """Rows of known keys and second copies ignored, the rest appended."""
    target = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    again = target.where("id % 2 = 0").withColumn("name", F.lit("never"))
    fresh = table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("key"), F.col("s_name").alias("label"))
    twice = fresh.unionByName(fresh).unionByName(again.toDF("key", "label"))
    return target.unionByName(stored.insert_select(target, twice, {"id": "key", "name": "label"}, ["id"]))


@query(REGISTER + "SELECT id, tenant_id, source AS type, external_workspace_id AS workspace_id, status FROM source_connections")
def sources_view(spark, d):
    """Connections under the names of an earlier schema, read through the view."""
    rows = register_tables(spark, d)["source_connections"].withColumn("cursor_state", F.lit(None).cast("string"))
    stored.sources_view(rows, "sources_of_register")
    return spark.sql("SELECT id, tenant_id, type, workspace_id, status FROM sources_of_register")


@query(REGISTER + """
, h AS (SELECT tenant_id, 'u' || user_id AS user_id, props AS query, ts FROM ev WHERE event_type = 'view' UNION ALL SELECT tenant_id, 'u' || user_id, 'asked ' || event_id, ts FROM ev WHERE event_type = 'click' AND user_id % 3 <> 0 AND event_id % 5 <> 0)
SELECT user_id, query, (SELECT count(*) FROM h WHERE user_id = 'u7') AS total FROM (SELECT * FROM h WHERE user_id = 'u7' ORDER BY ts DESC, query LIMIT 50)""")
def search_history(spark, d):
    """Searches recorded for those who keep a history, and one user's list."""
    t = register_tables(spark, d)
    raw = t["raw_events"].select("tenant_id", F.concat(F.lit("u"), F.substring("thread_ref", 2, 99)).alias("user_id"), F.col("raw_content").alias("query"), F.lit(1).alias("result_count"), F.col("received_at").alias("searched_at"), "source", F.substring("id", 2, 99).cast("long").alias("n"))
    old = raw.where("source = 'slack'").drop("source", "n")
    new = raw.where("source = 'gmail'").withColumn("query", F.when(F.col("n") % 5 == 0, "  ").otherwise(text("asked ", F.col("n")))).drop("source", "n")
    prefs = raw.select("user_id").distinct().withColumn("save_history", F.substring("user_id", 2, 99).cast("long") % 3 != 0).where("NOT save_history OR user_id = 'u7'")
    return governance.search_history_list(governance.search_history_record(old, new, prefs), "u7").select("user_id", "query", "total")


@query("SELECT event_id, props AS opened, 'SEAL01' AS head, true AS closed FROM events")
def sealed_payloads(spark, d):
    """Payloads sealed and opened again; another secret opens nothing."""
    rows = table(spark, d, "events").select("event_id", stored.seal(F.col("props").cast("binary"), "secret").alias("s"))
    return rows.select("event_id", stored.open_sealed(F.col("s"), "secret").cast("string").alias("opened"), F.substring("s", 1, 6).cast("string").alias("head"), stored.open_sealed(F.col("s"), "other").isNull().alias("closed"))


@query(r"""
SELECT id, preview FROM (SELECT event_id AS id, 'plan ' || event_id AS subject, 'Subject: plan ' || event_id || E'\nwe should meet about item ' || event_id AS preview FROM events ORDER BY ts DESC, event_id LIMIT 300) WHERE contains(subject, '7')""")
def find_in_raw(spark, d):
    """The newest sealed mails whose subject holds a text, with a preview."""
    n = F.col("event_id")
    body = F.to_json(F.struct(text("plan ", n).alias("subject"), text("we should meet about item ", n).alias("body")))
    rows = table(spark, d, "events").select(n.alias("id"), F.lit("gmail").alias("source"), stored.seal(body.cast("binary"), "secret").alias("raw_content"), F.col("ts").alias("received_at"))
    return stored.find_in_raw(rows, "secret", "7").select("id", "preview")
