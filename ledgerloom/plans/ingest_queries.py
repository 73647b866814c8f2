"""Connectors, envelopes, ingest steps and streams on the driver's tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import governance, ingest
from ..session import shared_folder
from ..sources import connectors, store
from ..sources import tables as stored
from ..streaming import jobs
from .base import query, table
from .model import REGISTER, register_tables, text

def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def flat(envelopes, *more):
    """An envelope's usual columns as plain values."""
    return envelopes.select("tenant_id", "source", "source_id", "actor", "thread_ref", F.array_join("permission_scope", "|").alias("scope"), "raw_content", stamp("received_at").alias("received"), *more)


def shared(spark, tag):
    return f"{shared_folder(spark)}/{tag}-{uuid4().hex}"


@query(r"""
SELECT 't1' AS tenant_id, 'gmail' AS source, 'm' || event_id AS source_id, CASE WHEN event_id % 2 = 0 THEN 'ann' || event_id || '@x.org' ELSE 'bob@y.org' END AS actor, 'th' || user_id AS thread_ref, 'box@x.org' AS scope,
  CASE WHEN event_id % 3 = 0 THEN 'body of ' || event_id WHEN event_id % 3 = 1 THEN '<b>html ' || event_id || '</b>' ELSE 'snip ' || event_id END AS body, 'Subject ' || event_id AS subject, strftime(ts, '%Y-%m-%d %H:%M:%S') AS received,
  CASE WHEN event_id % 2 = 0 THEN 'Ann A' END AS name, event_id % 5 = 0 AS bulk FROM events""")
def gmail_envelopes(spark, d):
    """Mails with plain, HTML-only and empty bodies."""
    n = F.col("event_id")
    sender = F.when(n % 2 == 0, text('"Ann A" <Ann', n, "@x.org>")).otherwise(F.lit("Bob@y.org"))
    head = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    headers = F.array(head("From", sender), head("subject", text("Subject ", n)), F.when(n % 5 == 0, head("List-Unsubscribe", F.lit("<x>"))).otherwise(head("X-None", F.lit(""))))
    data = lambda c: F.regexp_replace(F.translate(F.base64(c.cast("binary")), "+/", "-_"), "[\r\n]", "")
    part = lambda kind, c: F.struct(F.lit(kind).alias("mimeType"), F.struct(data(c).alias("data")).alias("body"))
    html = F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(part("text/html", text("<b>html ", n, "</b>"))).alias("parts"))
    both = F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(part("text/html", F.lit("<i>x</i>")), part("text/plain", text("body of ", n))).alias("parts"))
    payload = F.when(n % 3 == 0, F.to_json(both)).when(n % 3 == 1, F.to_json(html)).otherwise(F.lit('{"mimeType":"text/plain","body":{}}'))
    rows = table(spark, d, "events").select(F.lit("t1").alias("tenant_id"), F.lit("c1").alias("connection_id"), F.lit("box@x.org").alias("mailbox"), text("m", n).alias("id"), text("th", F.col("user_id")).alias("threadId"), text("snip ", n).alias("snippet"), F.unix_millis("ts").cast("string").alias("internalDate"), payload.alias("payload"), headers.alias("headers"))
    out = connectors.normalize_gmail(rows)
    return flat(out, F.get_json_object("raw_content", "$.body").alias("body"), F.get_json_object("raw_content", "$.subject").alias("subject"), F.col("actor_display_name").alias("name"), F.col("likely_bulk_mail").alias("bulk")).drop("raw_content")


SLACK = """
, m AS (SELECT event_id, 'C' || (user_id % 7) AS channel, event_id || '.5' AS t, 'w' || (user_id % 25) AS team, user_id, event_type, CASE WHEN event_id % 4 = 0 THEN 'im' ELSE 'channel' END AS kind FROM events),
ok AS (SELECT * FROM m WHERE event_type <> 'error' AND kind <> 'im'), conn AS (SELECT * FROM source_connections WHERE source = 'slack' AND status = 'active')
"""


def slack_events(spark, d):
    n = F.col("event_id")
    return table(spark, d, "events").select(text("w", F.col("user_id") % 25).alias("team_id"), text("C", F.col("user_id") % 7).alias("channel"), text(n, ".5").alias("ts"), F.lit(None).cast("string").alias("thread_ts"), text("U", F.col("user_id")).alias("user"), text("said ", n).alias("text"), F.lit("message").alias("type"), F.when(F.col("event_type") == "error", "bot_message").alias("subtype"), F.when(n % 4 == 0, "im").otherwise("channel").alias("channel_type"))


@query(REGISTER + SLACK + """SELECT c.tenant_id, 'slack' AS source, o.channel || ':' || o.t AS source_id, 'U' || user_id AS actor, o.t AS thread_ref, o.channel AS scope, 'said ' || event_id AS said, c.id AS connection FROM ok o JOIN conn c ON c.external_workspace_id = o.team""")
def slack_envelopes(spark, d):
    """Accepted chat messages, once for each active connection of their team."""
    out = connectors.normalize_slack(slack_events(spark, d), register_tables(spark, d)["source_connections"], scope=F.array_join("permission_scope", "|"), said=F.get_json_object("raw_content", "$.text"))
    return out.select("tenant_id", "source", "source_id", "actor", "thread_ref", "scope", "said", F.col("connection_id").alias("connection"))


@query(REGISTER + SLACK + """
, ch AS (SELECT team, channel, row_number() OVER (PARTITION BY team ORDER BY channel) AS n FROM (SELECT DISTINCT team, channel FROM m WHERE channel <> 'C3')),
r AS (SELECT o.*, row_number() OVER (PARTITION BY o.team, o.channel ORDER BY o.event_id DESC) AS k FROM ok o JOIN ch USING (team, channel) WHERE ch.n <= 2)
SELECT c.tenant_id, r.channel || ':' || r.t AS source_id, c.id AS connection FROM r JOIN conn c ON c.external_workspace_id = r.team WHERE k <= 20""")
def slack_backfill(spark, d):
    """The newest messages of at most two member channels of each team."""
    rows = slack_events(spark, d)
    channels = rows.select("team_id", "channel").distinct().withColumn("is_member", F.col("channel") != "C3")
    out = connectors.backfill_slack(rows, channels, register_tables(spark, d)["source_connections"], 20, 2)
    return out.select("tenant_id", "source_id", F.col("connection_id").alias("connection"))


@query(REGISTER + """
SELECT c.tenant_id, 'n' || event_id AS source_id, 'Name: page ' || event_id AS text, c.id AS connection, 'https://n/' || event_id AS link FROM ev e JOIN source_connections c ON c.external_workspace_id = 'w' || (user_id % 25) AND c.source = 'notion' AND c.status = 'active' WHERE e.ts > c.last_synced_at""")
def notion_envelopes(spark, d):
    """Pages edited after their connection's cursor, and their properties as text."""
    n = F.col("event_id")
    properties = F.concat(F.lit('{"Name":{"title":[{"plain_text":"page '), n.cast("string"), F.lit('"}]}}'))
    pages = table(spark, d, "events").select(text("w", F.col("user_id") % 25).alias("workspace_id"), text("n", n).alias("id"), text("https://n/", n).alias("url"), text("p", F.col("user_id")).alias("last_edited_by"), F.col("ts").alias("last_edited_time"), properties.alias("properties"))
    out = connectors.normalize_notion(pages, register_tables(spark, d)["source_connections"], text=tx.payload_text("raw_content", "source"))
    return out.select("tenant_id", "source_id", "text", F.col("connection_id").alias("connection"), F.col("source_permalink").alias("link"))


@query(r"""
SELECT 'jira' AS source, 'K-' || event_id AS source_id, 'Sum ' || event_id || E'\n\ndesc ' || event_id || CASE WHEN event_id % 2 = 0 THEN E'\n\nBo: first' || E'\n\nUnknown: second' ELSE '' END AS text,
  CASE WHEN event_id % 2 = 0 THEN 'r' || user_id || '=Rita|b1=Bo' ELSE 'r' || user_id || '=Rita' END AS known FROM events""")
def jira_envelopes(spark, d):
    """Issues with their comments as text, and the people they name."""
    n = F.col("event_id")
    tree = lambda c: F.concat(F.lit('{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"'), c, F.lit('"}]}]}'))
    comment = lambda i, who, b: F.struct(F.lit(i).alias("author_id"), F.lit(who).alias("author_name"), tree(F.lit(b)).alias("body"))
    kind = "array<struct<author_id:string,author_name:string,body:string>>"
    comments = F.when(n % 2 == 0, F.array(comment("b1", "Bo", "first"), comment("b2", None, "second")).cast(kind)).otherwise(F.array().cast(kind))
    rows = table(spark, d, "events").select(F.lit("t").alias("tenant_id"), F.lit("c").alias("connection_id"), text("K-", n).alias("key"), F.lit("u").alias("url"), F.lit("K").alias("project"), text("Sum ", n).alias("summary"), tree(text("desc ", n)).alias("description"), F.col("ts").alias("updated"), text("r", F.col("user_id")).alias("reporter_id"), F.lit("Rita").alias("reporter_name"), comments.alias("comments"))
    out = connectors.normalize_jira(rows)
    known = F.array_join(F.transform("known_actors", lambda a: F.concat_ws("=", a["source_actor_id"], a["name"])), "|")
    return out.select("source", "source_id", F.get_json_object("raw_content", "$.text").alias("text"), known.alias("known"))


@query(r"""SELECT 'p' || page_id AS source_id, 'Title ' || page_id || E'\n\n' || 'some plain words of page ' || page_id AS text FROM pages""")
def confluence_envelopes(spark, d):
    """Wiki pages as cleaned text."""
    html = F.concat(F.lit("<html><body><p>some plain words of page "), F.col("page_id").cast("string"), F.lit("</p></body></html>"))
    rows = table(spark, d, "pages").select(F.lit("t").alias("tenant_id"), F.lit("c").alias("connection_id"), text("p", F.col("page_id")).alias("id"), F.lit("sp").alias("space"), text("Title ", F.col("page_id")).alias("title"), F.col("url"), F.lit("me").alias("author"), F.lit("2024-01-01").cast("timestamp").alias("updated"), html.alias("html"))
    return connectors.normalize_confluence(rows).select("source_id", F.get_json_object("raw_content", "$.text").alias("text"))


@query("SELECT 'd' || event_id AS source_id, 'a' || user_id AS actor, 'ch' || (user_id % 9) AS thread_ref, CASE WHEN event_id % 2 = 0 THEN 'Global' ELSE 'user' || user_id END AS name, props AS said FROM events WHERE event_type <> 'error' AND event_id % 6 <> 0")
def discord_envelopes(spark, d):
    """Messages of people; bots and blank ones go."""
    n = F.col("event_id")
    rows = table(spark, d, "events").select(F.lit("t").alias("tenant_id"), F.lit("c").alias("connection_id"), text("d", n).alias("id"), text("ch", F.col("user_id") % 9).alias("channel_id"), F.when(n % 6 == 0, "  ").otherwise(F.col("props")).alias("content"), F.col("ts").alias("timestamp"), text("a", F.col("user_id")).alias("author_id"), text("user", F.col("user_id")).alias("username"), F.when(n % 2 == 0, "Global").alias("global_name"), F.when(F.col("event_type") == "error", True).alias("bot"))
    return connectors.normalize_discord(rows).select("source_id", "actor", "thread_ref", F.col("actor_display_name").alias("name"), F.get_json_object("raw_content", "$.text").alias("said"))


@query("""
SELECT 'o/r:' || CASE WHEN event_type = 'view' THEN 'pr-' ELSE 'issue-' END || event_id AS source_id, CASE WHEN event_type = 'view' THEN 'Pull request' ELSE 'Issue' END || ' #' || user_id || ': T' AS subject, 'o/r#' || user_id AS thread_ref FROM events WHERE event_id % 2 = 0 AND event_id % 6 <> 0
UNION ALL SELECT 'o/r:comment-' || event_id, 'Comment on #' || CASE WHEN event_id % 3 = 0 THEN '?' ELSE user_id::VARCHAR END, 'o/r#' || CASE WHEN event_id % 3 = 0 THEN '?' ELSE user_id::VARCHAR END FROM events WHERE event_id % 2 = 1""")
def github_envelopes(spark, d):
    """Issues, pull requests and comments; blank bodies go."""
    n = F.col("event_id")
    e = table(spark, d, "events").withColumns({"tenant_id": F.lit("t"), "connection_id": F.lit("c"), "repo": F.lit("o/r"), "user": F.lit("me"), "created_at": F.col("ts"), "url": F.lit("u")})
    issues = e.where("event_id % 2 = 0").select("tenant_id", "connection_id", "repo", n.alias("id"), F.col("user_id").alias("number"), F.lit("T").alias("title"), F.when(n % 6 != 0, F.col("props")).alias("body"), "user", (F.col("event_type") == "view").alias("is_pull"), "created_at", "url")
    comments = e.where("event_id % 2 = 1").select("tenant_id", "connection_id", "repo", n.alias("id"), F.col("props").alias("body"), "user", "created_at", "url", F.when(n % 3 == 0, F.lit("none")).otherwise(text("https://h/issues/", F.col("user_id"))).alias("issue_url"))
    return connectors.normalize_github(issues, comments).select("source_id", F.get_json_object("raw_content", "$.subject").alias("subject"), "thread_ref")


@query(REGISTER + r"""
, conn AS (SELECT * FROM source_connections WHERE source = 'jira' AND status = 'active'),
e AS (SELECT v.*, c.tenant_id AS tenant, c.id AS cid, c.last_synced_at FROM events v JOIN conn c ON c.external_workspace_id = 'w' || (v.user_id % 25))
SELECT tenant, 'item:i' || event_id || ':' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS source_id, 'Item ' || event_id || E'\nOwner: me' AS text FROM e WHERE ts > last_synced_at
UNION ALL SELECT tenant, 'update:u' || event_id, 'upd ' || event_id FROM e WHERE ts + INTERVAL 1 DAY > last_synced_at""")
def monday_envelopes(spark, d):
    """boards' items and updates after the cursor."""
    n = F.col("event_id")
    values = F.array(F.struct(F.lit("Owner").alias("title"), F.lit("me").alias("text")), F.struct(F.lit("Empty").alias("title"), F.lit(" ").alias("text")))
    updates = F.array(F.struct(text("u", n).alias("id"), text("upd ", n).alias("body"), F.lit("x").alias("creator"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("created_at")))
    item = F.struct(text("i", n).alias("id"), text("Item ", n).alias("name"), values.alias("column_values"), F.lit("me").alias("creator"), F.col("ts").alias("updated_at"), updates.alias("updates"))
    boards = table(spark, d, "events").select(text("w", F.col("user_id") % 25).alias("account_id"), text("b", F.col("user_id")).alias("id"), F.array(item).alias("items"))
    cn = register_tables(spark, d)["source_connections"].withColumn("source", F.when(F.col("source") == "jira", "monday").otherwise(F.col("source")))
    # Cursors are met by whole times, keys show seconds.
    key = F.regexp_replace("source_id", r"(:\d\d)\.\d+$", "$1")
    out = connectors.normalize_monday(boards, cn, text=F.get_json_object("raw_content", "$.text"), key=key)
    return out.select(F.col("tenant_id").alias("tenant"), F.col("key").alias("source_id"), "text")


@query(r"""
WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms, CASE WHEN user_id % 3 = 0 THEN NULL ELSE epoch_ms(TIMESTAMP '2024-01-15') END AS synced FROM events)
SELECT 'task:k' || event_id || ':' || ms AS source_id, 'T' || event_id || CASE WHEN event_id % 2 = 0 THEN E'\nmore' ELSE '' END || E'\nStatus: open' AS text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS received FROM e WHERE synced IS NULL OR ms > synced
UNION ALL SELECT 'comment:m' || event_id, 'said ' || event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') FROM e WHERE synced IS NULL OR ms > synced""")
def clickup_envelopes(spark, d):
    """Tasks and comments after their cursors."""
    n = F.col("event_id")
    at = F.unix_millis("ts")
    e = table(spark, d, "events").withColumns({"tenant_id": F.lit("t"), "connection_id": F.lit("c"), "list_id": F.lit("l"), "task_id": text("k", n), "synced": F.when(F.col("user_id") % 3 != 0, F.unix_millis(F.lit("2024-01-15").cast("timestamp")))})
    tasks = e.select("tenant_id", "connection_id", "list_id", "task_id", "synced", text("T", n).alias("name"), F.when(n % 2 == 0, "more").otherwise(" ").alias("description"), F.lit("open").alias("status"), F.lit("").alias("priority"), F.lit("me").alias("creator"), at.cast("string").alias("date_updated"))
    comments = e.select("tenant_id", "connection_id", "list_id", "task_id", "synced", text("m", n).alias("comment_id"), text("said ", n).alias("comment_text"), F.lit("me").alias("user"), at.cast("string").alias("date"))
    return connectors.normalize_clickup(tasks, comments).select("source_id", F.get_json_object("raw_content", "$.text").alias("text"), stamp("received_at").alias("received"))


@query("""
SELECT 'v' || event_id || ':' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS source_id, 'org' || user_id || '@x.org' AS actor, CASE WHEN event_id % 2 = 0 THEN 'ann@x.org=Anna' ELSE 'ann@x.org=Ann' END AS known, 'S' || event_id AS subject FROM events""")
def calendar_envelopes(spark, d):
    """Calendar events; of a person listed twice the later name counts."""
    n = F.col("event_id")
    guest = lambda name, m: F.struct(F.lit(name).cast("string").alias("name"), F.lit(m).cast("string").alias("email"))
    guests = F.when(n % 2 == 0, F.array(guest("Ann", "ANN@x.org"), guest(None, None), guest("Anna", "ann@X.org"))).otherwise(F.array(guest("Ann", "ann@x.org"), guest("no", None), guest("Ann", "ann@x.org")))
    rows = table(spark, d, "events").select(F.lit("t").alias("tenant_id"), F.lit("c").alias("connection_id"), F.lit("box").alias("mailbox"), text("v", n).alias("id"), stamp("ts").alias("lastModified"), text("S", n).alias("subject"), F.col("props").alias("body"), text("ORG", F.col("user_id"), "@x.org").alias("organizer"), F.lit("O").alias("organizer_name"), guests.alias("attendees"), F.lit("u").alias("url"))
    out = connectors.normalize_calendar(rows)
    return out.select("source_id", "actor", F.array_join(F.transform("known_actors", lambda a: F.concat_ws("=", a["source_actor_id"], a["name"])), "|").alias("known"), F.get_json_object("raw_content", "$.subject").alias("subject"))


@query(REGISTER + """
, s AS (SELECT connection_id, max(received_at) AS t FROM raw_events GROUP BY 1), k AS (SELECT connection_id, string_agg(source || '=' || strftime(t, '%Y-%m-%d'), '|' ORDER BY source) AS m FROM (SELECT connection_id, source, max(received_at) AS t FROM raw_events GROUP BY 1, 2) GROUP BY 1)
SELECT c.id, strftime(greatest(c.last_synced_at, coalesce(s.t, c.last_synced_at)), '%Y-%m-%d %H:%M:%S') AS synced, coalesce(k.m, '') AS cursors FROM source_connections c LEFT JOIN s ON s.connection_id = c.id LEFT JOIN k ON k.connection_id = c.id""")
def advance_cursors(spark, d):
    """Connections moved to the newest time seen, and cursors for each source in a map."""
    t = register_tables(spark, d)
    cn = t["source_connections"].withColumn("cursor_state", F.lit(None).cast("string"))
    plain = connectors.advance_cursors(t["raw_events"], cn).select("id", stamp("last_synced_at").alias("synced"))
    maps = connectors.advance_cursors(t["raw_events"], cn, F.col("source"))
    pairs = F.array_sort(F.map_entries(F.from_json("cursor_state", "map<string, string>")))
    return plain.join(maps.select("id", F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.left(e["value"], F.lit(10)))), "|").alias("cursors")), "id")


# Envelopes and ingest -------------------------------------------------------------------------------


@query("""
SELECT 'good' AS part, '' AS reason, count(*) AS n FROM events WHERE event_id % 10 > 1
UNION ALL SELECT 'bad', CASE WHEN event_id % 10 = 0 THEN 'malformed' ELSE 'source_id is missing' END, count(*) FROM events WHERE event_id % 10 <= 1 GROUP BY 2
UNION ALL SELECT 'register', '', count(*) FROM orders""")
def landed_envelopes(spark, d):
    """Envelopes landed as JSON lines, whole, incomplete and broken; and a register table read with its schema."""
    n = F.col("event_id")
    line = F.to_json(F.struct(F.lit("t").alias("tenant_id"), F.lit("slack").alias("source"), F.when(n % 10 == 1, " ").otherwise(n.cast("string")).alias("source_id"), F.col("props").alias("raw_content")))
    path = shared(spark, "landed")
    table(spark, d, "events").select(F.when(n % 10 == 0, F.lit('{"tenant_id": ')).otherwise(line).alias("value")).write.text(path)
    good, bad = stored.read_envelopes(spark, path)
    home = shared(spark, "register")
    table(spark, d, "orders").select(text("d", F.col("o_orderkey")).alias("id"), F.lit("t").alias("tenant_id"), F.lit("decision").alias("record_type")).write.parquet(f"{home}/decisions")
    known = stored.read_register(spark, home, ["decisions"], views=True)["decisions"].where("status IS NULL AND tenant_id = 't'")
    count = lambda df, part: df.groupBy(F.lit(part).alias("part"), "reason").agg(F.count(F.lit(1)).alias("n"))
    return count(good.withColumn("reason", F.lit("")), "good").unionByName(count(bad, "bad")).unionByName(count(known.withColumn("reason", F.lit("")), "register"))


@query("""
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'blank statement' WHEN event_id % 6 = 1 THEN 'unknown record type' WHEN event_id % 6 = 2 THEN 'confidence out of range' WHEN event_id % 6 = 3 THEN 'several deciders' ELSE '' END AS reasons,
  CASE WHEN event_id % 6 = 4 THEN 'a|b' ELSE '' END AS alternatives, CASE event_type WHEN 'view' THEN 'kept' WHEN 'click' THEN 'discarded' WHEN 'error' THEN 'uncertain' END AS triage FROM events""")
def validated_outputs(spark, d):
    """Model outputs checked and cleaned, and the model's words as results."""
    n = F.col("event_id")
    k = n % 6
    who = lambda role: F.struct(F.lit("a").alias("source_actor_id"), F.lit(role).alias("role"))
    word = F.when(F.col("event_type") == "view", "KEEP").when(F.col("event_type") == "click", "DISCARD").when(F.col("event_type") == "error", "UNCERTAIN").otherwise("other")
    rows = table(spark, d, "events").select("event_id", word.alias("decision"), F.when(k == 0, "  ").otherwise(" s ").alias("decision_statement"), F.lit("").alias("rationale"), F.when(k == 1, "odd").otherwise("decision").alias("record_type"), F.lit("decided").alias("status"), F.when(k == 2, 1.5).otherwise(0.5).alias("confidence"), F.when(k == 3, F.array(who("decided_by"), who("decided_by"))).otherwise(F.array(who("decided_by"))).alias("actors"), F.when(k == 4, F.array(F.lit(" a "), F.lit("b"), F.lit("a"), F.lit(" "))).otherwise(F.array().cast("array<string>")).alias("alternatives_considered"))
    good, bad = ingest.validate_extractions(rows)
    pick = lambda df, reasons: df.select("event_id", reasons.alias("reasons"), F.array_join("alternatives_considered", "|").alias("alternatives"), ingest.map_triage().alias("triage"))
    return pick(good, F.lit("")).unionByName(pick(bad, F.array_join("reasons", "|")))


@query("""SELECT 't' || (event_id % 2) AS tenant_id, 's' || (event_id // 2) AS source_id, CASE WHEN event_id % 3 = 0 THEN 'id-' || event_id ELSE 'ANN' END || '|' || 'someone' AS people FROM events""")
def known_actors(spark, d):
    """Names told by a message's known people, in two tenants that share the message's id."""
    n = F.col("event_id")
    e = table(spark, d, "events").withColumns({"tenant_id": text("t", n % 2), "source": F.lit("slack"), "source_id": text("s", F.floor(n / 2))})
    one = F.struct(F.when(n % 3 == 0, "Ann").otherwise("Bob").alias("name"), text("id-", n).alias("source_actor_id"))
    envelopes = e.select(*ingest.KEYS, F.array(one).alias("known_actors"))
    who = lambda name: F.struct(F.lit(name).alias("source_actor_id"), F.lit("mentioned").alias("role"))
    outputs = e.select(*ingest.KEYS, F.array(who("ANN"), who("someone")).alias("actors"))
    return ingest.match_known_actors(outputs, envelopes).select("tenant_id", "source_id", F.array_join(F.transform("actors", lambda a: a["source_actor_id"]), "|").alias("people"))


@query(REGISTER + """
, refs AS (SELECT event_id, 't' || (user_id % 10) AS tenant_id, CASE WHEN event_id % 2 = 0 THEN 'U' || lpad(user_id::VARCHAR, 8, '0') ELSE 'new' || (user_id % 30) END AS raw_id FROM events),
u AS (SELECT sha256('t' || (user_id % 10) || chr(1) || 'slack_user_id' || chr(1) || CASE WHEN event_id % 2 = 0 THEN 'U' || lpad(user_id::VARCHAR, 8, '0') ELSE 'new' || (user_id % 30) END) AS h, event_id FROM events)
SELECT r.event_id, coalesce(a.id, left(u.h, 8) || '-' || substr(u.h, 9, 4) || '-' || substr(u.h, 13, 4) || '-' || substr(u.h, 17, 4) || '-' || substr(u.h, 21, 12)) AS actor_id,
  (SELECT count(DISTINCT (x.tenant_id, x.raw_id)) FROM refs x WHERE NOT EXISTS (SELECT 1 FROM actors k WHERE k.tenant_id = x.tenant_id AND k.slack_user_id = x.raw_id)) AS added
FROM refs r JOIN u USING (event_id) LEFT JOIN actors a ON a.tenant_id = r.tenant_id AND a.slack_user_id = r.raw_id""")
def find_or_create_actors(spark, d):
    """References as actors, and those that have to be added."""
    n = F.col("event_id")
    refs = table(spark, d, "events").select("event_id", text("t", F.col("user_id") % 10).alias("tenant_id"), F.lit("slack").alias("source"), F.when(n % 2 == 0, text("U", F.lpad(F.col("user_id").cast("string"), 8, "0"))).otherwise(text("new", F.col("user_id") % 30)).alias("raw_id"), F.lit("n").alias("name"))
    found, added = ingest.find_or_create_actors(refs, register_tables(spark, d)["actors"])
    return found.select("event_id", "actor_id").crossJoin(added.agg(F.count(F.lit(1)).alias("added")))  # one row


@query(REGISTER + """
SELECT e.event_id, (SELECT arg_min(c.id, (c.created_at, c.id)) FROM source_connections c WHERE c.status = 'active' AND c.tenant_id = e.tenant_id AND c.source = e.source) AS connection,
  EXISTS (SELECT 1 FROM source_connections c WHERE c.status = 'active' AND c.id = 'c' || (e.user_id % 40) AND c.tenant_id = e.tenant_id) AS named FROM ev e""")
def resolve_connections(spark, d):
    """The named active connection, else the oldest of tenant and source, else none."""
    t = register_tables(spark, d)
    rows = t["raw_events"].select("id", "tenant_id", "source", "connection_id")
    unnamed = rows.withColumn("connection_id", F.lit(None).cast("string"))
    good, bad = ingest.resolve_connection(unnamed, t["source_connections"])
    by_age = good.select("id", F.col("connection_id").alias("connection")).unionByName(bad.select("id", F.col("connection_id").alias("connection")))
    mark = ingest.connection_of(rows, t["source_connections"], "link").select("id", (F.col("link").eqNullSafe(F.col("connection_id"))).alias("named"))
    return by_age.join(mark, "id").select(F.substring("id", 2, 99).cast("long").alias("event_id"), "connection", "named")


@query("""
SELECT 'ok' AS part, count(*) AS n FROM events WHERE event_id % 9 <> 0 AND ts >= TIMESTAMP '2024-02-14' - INTERVAL 30 DAY UNION ALL SELECT 'rejected', count(*) FROM events WHERE event_id % 9 = 0
UNION ALL SELECT 'late', count(*) FROM events WHERE event_id % 9 <> 0 AND ts < TIMESTAMP '2024-02-14' - INTERVAL 30 DAY
UNION ALL SELECT 'retried', count(*) FROM events WHERE event_id % 9 <> 0 AND event_id % 4 <> 0 UNION ALL SELECT 'embed', count(*) FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0""")
def queue_steps(spark, d):
    """Bad and late messages aside, pending ones taken up again, and what is left to embed."""
    n = F.col("event_id")
    e = table(spark, d, "events").select(F.lit("t").alias("tenant_id"), F.lit("slack").alias("source"), F.when(n % 9 == 0, "").otherwise(n.cast("string")).alias("source_id"), F.col("ts").alias("received_at"), "event_id")
    good, bad, old = jobs.late_and_bad(e, F.lit("2024-02-14").cast("timestamp"))
    ledger = e.select(*ingest.KEYS, F.when(n % 4 == 0, "done").otherwise("pending").alias("pipeline_status"))
    again = ingest.retry_pending(good.unionByName(old), ledger)
    rows = e.select(n.cast("string").alias("id"), "tenant_id", "event_id")
    waiting = jobs.embedding_queue(rows.unionByName(rows), rows.where("event_id % 2 = 0"), rows.where("event_id % 3 = 0").select(F.col("id").alias("decision_id"), "tenant_id"))
    parts = {"ok": good, "rejected": bad, "late": old, "retried": again, "embed": waiting}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("""
WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'KEEP' WHEN 'click' THEN 'DISCARD' WHEN 'error' THEN 'UNCERTAIN' ELSE 'keep' END AS decision, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value / 400 END AS confidence,
  ['EXPLICIT_DECISION', 'SOCIAL_CHATTER', 'AWAITING_APPROVAL', 'NO_SUCH_CODE', NULL][event_id % 5 + 1] AS code FROM events),
r AS (SELECT *, decision = 'keep' AS a, confidence IS NULL OR confidence NOT BETWEEN 0 AND 1 AS b, code IS NULL OR code = 'NO_SUCH_CODE' AS c FROM t)
SELECT event_id, CASE WHEN a OR b OR c THEN NULL WHEN decision = 'KEEP' THEN 'kept' WHEN decision = 'DISCARD' THEN 'discarded' ELSE 'uncertain' END AS result,
  concat_ws('|', CASE WHEN a THEN 'unknown decision' END, CASE WHEN b THEN 'confidence out of range' END, CASE WHEN c THEN 'unknown reason code' END) AS reasons FROM r""")
def triage_results(spark, d):
    """P20: the model's words, confidences and reason codes as stored results, and why others are rejected."""
    e, n = F.col("event_type"), F.col("event_id")
    word = F.when(e == "view", "KEEP").when(e == "click", "DISCARD").when(e == "error", "UNCERTAIN").otherwise("keep")
    code = F.when(n % 5 == 0, "EXPLICIT_DECISION").when(n % 5 == 1, "SOCIAL_CHATTER").when(n % 5 == 2, "AWAITING_APPROVAL").when(n % 5 == 3, "NO_SUCH_CODE")
    good, bad = ingest.validate_triage(table(spark, d, "events").select("event_id", word.alias("decision"), F.when(n % 9 != 0, F.col("value") / 400).alias("confidence"), code.alias("reason_code")))
    return good.select("event_id", F.col("triage_result").alias("result"), F.lit("").alias("reasons")).unionByName(bad.select("event_id", F.lit(None).cast("string").alias("result"), F.array_join("reasons", "|").alias("reasons")))


@query("""
WITH new AS (SELECT o_orderkey, o_totalprice + 1 AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'new' END AS note FROM orders WHERE o_custkey % 20 = 0),
old AS (SELECT o_orderkey, o_totalprice AS price, 'old' AS note, 1 AS seen FROM orders WHERE o_orderkey % 2 = 0),
kept AS (SELECT o_orderkey, coalesce(n.price, o.price) AS price, coalesce(n.note, o.note) AS note, coalesce(o.seen, 0) + CASE WHEN n.o_orderkey IS NULL THEN 0 ELSE 1 END AS seen FROM old o FULL JOIN new n USING (o_orderkey))
SELECT 'row' AS part, o_orderkey::VARCHAR AS key, round(price, 2) AS price, note, seen::BIGINT AS seen FROM kept
UNION ALL SELECT 'event', event_id::VARCHAR, NULL, event_type, NULL FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND (event_id % 2 = 0 OR event_id % 3 = 0)
UNION ALL SELECT 'added', NULL, NULL, NULL, (SELECT count(*) FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0)
UNION ALL SELECT 'days', NULL, NULL, NULL, (SELECT count(DISTINCT ts::DATE) FROM events WHERE ts < TIMESTAMP '2024-01-10' AND (event_id % 2 = 0 OR event_id % 3 = 0))""")
def keyed_store(spark, d):
    """A keyed table upserted twice by the same batch, a table by day with insert-ignore and a purge."""
    home, n = shared(spark, "store"), F.col("event_id")
    orders = table(spark, d, "orders")
    store.create_store(orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit("old").alias("note"), F.lit(1).alias("seen")), f"{home}/orders", ["o_orderkey"])
    new = orders.where("o_custkey % 20 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("price"), F.when(F.col("o_orderkey") % 3 == 0, "new").alias("note"), F.lit(1).alias("seen"))
    for _ in range(2):
        store.upsert_store(new, f"{home}/orders", "batch 1", {"note": "keep", "seen": "add"})
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    store.create_store(events.where("event_id % 2 = 0"), f"{home}/events", ["event_id"], 4, F.col("ts"))
    added = store.insert_store(events.where("event_id % 3 = 0"), f"{home}/events", "batch 2", F.col("ts")).count()
    days = len(store.drop_days(spark, f"{home}/events", "2024-01-10"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = store.read_store(spark, f"{home}/orders").select(F.lit("row").alias("part"), F.col("o_orderkey").cast("string").alias("key"), F.round("price", 2).alias("price"), "note", F.col("seen").cast("long").alias("seen"))
    left = store.read_store(spark, f"{home}/events").select(F.lit("event").alias("part"), n.cast("string").alias("key"), none("double").alias("price"), F.col("event_type").alias("note"), none("long").alias("seen"))
    counts = spark.createDataFrame([("added", None, None, None, added), ("days", None, None, None, days)], rows.schema)
    return rows.unionByName(left).unionByName(counts)


@query("""
WITH u AS (SELECT c_custkey AS k, 'u' || c_custkey AS user_id, 'User.' || c_custkey || '@X.org' AS email FROM customer),
allowed AS (SELECT lower(email) AS m FROM u WHERE k % 2 = 0)
SELECT count(*) AS tenants, count(DISTINCT slug) AS slugs, count(DISTINCT user_id) AS users, (SELECT count(*) FROM u WHERE lower(email) IN (SELECT m FROM allowed)) AS owners, 0::BIGINT AS again
FROM (SELECT k, user_id, lower('user-' || k) || k AS slug FROM u WHERE lower(email) IN (SELECT m FROM allowed))""")
def provisioned_tenants(spark, d):
    """Tenants and owners for allowed users who have none; a second run adds nothing."""
    users = table(spark, d, "customer").select(text("u", F.col("c_custkey")).alias("id"), text("User.", F.col("c_custkey"), "@X.org").alias("email"), F.lit(0).alias("created_at"), "c_custkey")
    none = spark.createDataFrame([], "id string")
    tenants, members = governance.provision_tenants(users, none, users.where("c_custkey % 2 = 0").select(F.upper("email").alias("email")))
    again, _ = governance.provision_tenants(users, tenants, users.where("c_custkey % 2 = 0"))
    counts = tenants.agg(F.count(F.lit(1)).alias("tenants"), F.count_distinct("slug").alias("slugs"))
    owners = members.where("role = 'owner'").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("owners"))
    return counts.crossJoin(owners).crossJoin(again.agg(F.count(F.lit(1)).alias("again")))  # one row each


@query("""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, us AS start, 1 AS used, i FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, CASE WHEN e.us >= w.start + 86400000000 THEN e.us ELSE w.start END, CASE WHEN e.us >= w.start + 86400000000 THEN 1 WHEN w.used < 3 THEN w.used + 1 ELSE w.used END, e.i FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1),
l AS (SELECT user_id, arg_max(start, i) AS start, arg_max(used, i) AS used FROM w GROUP BY 1)
SELECT user_id AS key, CASE WHEN epoch_us(TIMESTAMP '2024-01-30 12:00:00') >= start + 86400000000 THEN 0 ELSE used END::BIGINT AS used, 3 AS "limit", 3 - CASE WHEN epoch_us(TIMESTAMP '2024-01-30 12:00:00') >= start + 86400000000 THEN 0 ELSE used END::BIGINT AS remaining FROM l""")
def usage_remaining(spark, d):
    """What is left of each user's latest window."""
    limits = jobs.fixed_window_limits(table(spark, d, "events"), 3, 86_400, "user_id", "ts", "event_id")
    return jobs.usage_remaining(limits, 3, 86_400, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("key", "used", "limit", "remaining")


@query("""
WITH e AS (SELECT *, 't' || (user_id % 5) AS tenant FROM events)
SELECT outcome, count(*) AS n, sum(redacted)::BIGINT AS redacted FROM (SELECT CASE WHEN tenant = 't1' THEN 'learning_paused' WHEN tenant = 't2' THEN 'abandoned_no_active_connection' WHEN event_type = 'view' THEN 'pending' WHEN event_type = 'error' THEN 'discarded' ELSE 'persisted' END AS outcome, (event_id % 4 = 0)::INT AS redacted FROM e)
GROUP BY 1 UNION ALL SELECT 'retried_next_day', count(*), 0 FROM e WHERE tenant NOT IN ('t1', 't2') AND event_type = 'view' AND event_id % 2 = 0
UNION ALL SELECT 'still_pending', count(*), 0 FROM e WHERE tenant NOT IN ('t1', 't2') AND event_type = 'view' AND event_id % 2 = 1""")
def ingest_stream(spark, d):
    """Messages landed, streamed, redacted and routed; those the model has not judged wait for the next run."""
    n = F.col("event_id")
    e = table(spark, d, "events").withColumn("tenant_id", text("t", F.col("user_id") % 5))
    body = F.concat(F.lit('{"id":123456789012,"text":"note '), F.when(n % 4 == 0, F.lit("4111 1111 1111 1111")).otherwise(F.col("event_type")), F.lit(' of it"}'))
    lines = e.select(F.to_json(F.struct("tenant_id", F.lit("slack").alias("source"), text("s", n).alias("source_id"), body.alias("raw_content"))).alias("value"))
    home = shared(spark, "ingest")
    lines.write.text(f"{home}/in")
    tenants = e.select(F.col("tenant_id").alias("id")).distinct().select("id", (F.col("id") == "t1").alias("learning_paused"), F.lit(False).alias("core_knowledge_only"))
    connections = tenants.select(F.concat(F.lit("c-"), "id").alias("id"), F.col("id").alias("tenant_id"), F.lit("slack").alias("source"), F.when(F.col("id") == "t2", "paused").otherwise("active").alias("status"), F.lit("2024-01-01").alias("created_at"))
    outputs = e.select("tenant_id", F.lit("slack").alias("source"), text("s", n).alias("source_id"), F.when(F.col("event_type") == "error", "DISCARD").otherwise("KEEP").alias("decision"), F.lit(0.9).alias("confidence"), F.lit("decision").alias("record_type"), "event_type", "event_id")
    register = {"source_connections": connections, "tenants": tenants}
    run = lambda judged: jobs.ingest_stream(spark, f"{home}/in", f"{home}/out", register, judged, f"{home}/state", 10_000).awaitTermination()
    run(outputs.where("event_type <> 'view'"))
    jobs.wake(spark, f"{home}/in")
    run(outputs.where("event_id % 2 = 0"))
    out = spark.read.parquet(f"{home}/out/outcomes")
    first = out.where("batch = 0 AND get_json_object(raw_content, '$.id') = '123456789012'").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.contains("raw_content", F.lit("[REDACTED-CARD]")).cast("long")).alias("redacted"))
    later = lambda name, outcome: out.where(f"batch = 1 AND source_id <> 'late' AND outcome = '{outcome}'").agg(F.lit(name).alias("outcome"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("redacted"))
    return first.unionByName(later("retried_next_day", "persisted")).unionByName(later("still_pending", "pending"))
