import base64
import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import reports
from ledgerloom.plans import ingest_queries
from ledgerloom.sources import connectors as c
from ledgerloom.sources import store
from ledgerloom.sources.tables import SCHEMAS, read_envelopes, read_register
from ledgerloom.streaming import jobs

T0 = datetime(2026, 1, 1, 12)


@pytest.fixture(scope="module")
def connections(spark):
    rows = [("c1", "t1", "slack", "W1", "active", None), ("c2", "t2", "slack", "W1", "active", None), ("c3", "t3", "slack", "W1", "paused", None), ("n1", "t1", "notion", "N1", "active", T0), ("m1", "t1", "monday", "M1", "active", T0)]
    return spark.createDataFrame(rows, "id string, tenant_id string, source string, external_workspace_id string, status string, last_synced_at timestamp")


def test_gmail(spark):
    enc = lambda s: base64.urlsafe_b64encode(s.encode()).decode()
    tree = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/html", "body": {"data": enc("<p>x</p>")}}, {"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": enc("plain ünï")}}]}]}
    rows = [("m1", json.dumps(tree), [("from", '"Ann Lee" <Ann@X.org>'), ("SUBJECT", "Hi"), ("List-Unsubscribe", "y")]), ("m2", "{}", [("From", "bob@x.org")])]
    df = spark.createDataFrame([("t", "c", "me@x.org", i, "th", "snip", "1767268800000", p, h) for i, p, h in rows], "tenant_id string, connection_id string, mailbox string, id string, threadId string, snippet string, internalDate string, payload string, headers array<struct<name:string,value:string>>")
    got = {r["source_id"]: r for r in c.normalize_gmail(df).collect()}
    one = got["m1"]
    assert (one["actor"], one["actor_display_name"], one["likely_bulk_mail"], one["permission_scope"]) == ("ann@x.org", "Ann Lee", True, ["me@x.org"])
    assert json.loads(one["raw_content"])["body"] == "plain ünï" and one["received_at"] == T0
    assert got["m2"]["actor"] == "bob@x.org" and json.loads(got["m2"]["raw_content"])["body"] == "snip"


def test_chat_sources(spark, connections):
    schema = "team_id string, channel string, ts string, thread_ts string, user string, text string, type string, subtype string, channel_type string"
    events = spark.createDataFrame([("W1", "C1", "1767268800.5", None, "U1", "hi", "message", None, "channel"), ("W1", "D1", "1767268801", None, "U1", "dm", "message", None, "im"), ("W1", "C1", "1767268802", None, "U1", "join", "message", "joined", "channel")], schema)
    got = c.normalize_slack(events, connections).collect()
    assert sorted(r["tenant_id"] for r in got) == ["t1", "t2"] and got[0]["thread_ref"] == "1767268800.5" and got[0]["permission_scope"] == ["C1"]
    history = spark.createDataFrame([("W1", f"C{k}", str(1767268800 + i), None, "U", "x", "message", None, None) for k in range(3) for i in range(25)], schema)
    channels = spark.createDataFrame([("W1", "C0", True), ("W1", "C1", False), ("W1", "C2", True)], "team_id string, channel string, is_member boolean")
    assert c.backfill_slack(history, channels, connections).count() == 2 * 2 * 20
    said = spark.createDataFrame([("t", "c", "1", "ch", "hello", T0, "u", "user", "Global", False), ("t", "c", "2", "ch", " ", T0, "u", "user", None, False), ("t", "c", "3", "ch", "beep", T0, "b", "bot", None, True)], "tenant_id string, connection_id string, id string, channel_id string, content string, timestamp timestamp, author_id string, username string, global_name string, bot boolean")
    assert [(r["source_id"], r["actor_display_name"]) for r in c.normalize_discord(said).collect()] == [("1", "Global")]


def test_document_sources(spark, connections):
    pages = spark.createDataFrame([("N1", "p1", "u", "e", T0 + timedelta(hours=1), "{}"), ("N1", "p2", "u", "e", T0, "{}")], "workspace_id string, id string, url string, last_edited_by string, last_edited_time timestamp, properties string")
    assert [r["source_id"] for r in c.normalize_notion(pages, connections).collect()] == ["p1"]
    tree = json.dumps({"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "Hello "}, {"type": "text", "text": "there"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "Bye"}]}]})
    issues = spark.createDataFrame([("t", "c", "K-1", "u", "K", "Sum", tree, T0, "r1", "Rae", [("a1", "Old", tree), ("a1", "New", tree)])], "tenant_id string, connection_id string, key string, url string, project string, summary string, description string, updated timestamp, reporter_id string, reporter_name string, comments array<struct<author_id:string,author_name:string,body:string>>")
    one = c.normalize_jira(issues).first()
    assert json.loads(one["raw_content"])["text"] == "Sum\n\nHello there\nBye\n\nOld: Hello there\nBye\n\nNew: Hello there\nBye"
    assert [(a["name"], a["source_actor_id"]) for a in one["known_actors"]] == [("Rae", "r1"), ("New", "a1")]
    wiki = spark.createDataFrame([("t", "c", "1", "S", "Title", "u", "a", T0, "<p>Some words that read well</p><p>b</p>")], "tenant_id string, connection_id string, id string, space string, title string, url string, author string, updated timestamp, html string")
    assert json.loads(c.normalize_confluence(wiki).first()["raw_content"])["text"] == "Title\n\nSome words that read well b"
    repo = "tenant_id string, connection_id string, repo string, id long, body string, user string, created_at timestamp, url string"
    first = spark.createDataFrame([("t", "c", "o/r", 1, "text", "u", T0, "l", 7, "T", True), ("t", "c", "o/r", 2, " ", "u", T0, "l", 8, "T", False)], f"{repo}, number int, title string, is_pull boolean")
    later = spark.createDataFrame([("t", "c", "o/r", 3, "c1", "u", T0, "l", "http://x/issues/7"), ("t", "c", "o/r", 4, "c2", "u", T0, "l", "odd")], f"{repo}, issue_url string")
    got = {r["source_id"]: (r["thread_ref"], json.loads(r["raw_content"])["subject"]) for r in c.normalize_github(first, later).collect()}
    assert got == {"o/r:pr-1": ("o/r#7", "Pull request #7: T"), "o/r:comment-3": ("o/r#7", "Comment on #7"), "o/r:comment-4": ("o/r#?", "Comment on #?")}


def test_task_sources(spark, connections):
    items = [("i1", "Item", T0 + timedelta(hours=1), "w", [("Status", "Open"), ("Empty", " ")], [("u1", "said", T0 + timedelta(hours=2), "w"), ("u2", "old", T0, "w")]), ("i2", "Old", T0, "w", [], [])]
    boards = spark.createDataFrame([("M1", "b1", items)], "account_id string, id string, items array<struct<id:string,name:string,updated_at:timestamp,creator:string,column_values:array<struct<title:string,text:string>>,updates:array<struct<id:string,body:string,created_at:timestamp,creator:string>>>>")
    texts = sorted(json.loads(r["raw_content"])["text"] for r in c.normalize_monday(boards, connections).collect())
    assert texts == ["Item\nStatus: Open", "said"]
    tasks = spark.createDataFrame([("t", "c", "l", "k1", "Name", " ", "open", None, "w", "1767268800000", "5")], "tenant_id string, connection_id string, list_id string, task_id string, name string, description string, status string, priority string, creator string, date_updated string, synced string")
    notes = spark.createDataFrame([("t", "c", "l", "k1", "n1", "note", "w", "1767268800001", None)], "tenant_id string, connection_id string, list_id string, task_id string, comment_id string, comment_text string, user string, date string, synced string")
    got = {r["source_id"]: json.loads(r["raw_content"])["text"] for r in c.normalize_clickup(tasks, notes).collect()}
    assert got == {"comment:n1": "note", "task:k1:1767268800000": "Name\nStatus: open"}
    meet = spark.createDataFrame([("t", "c", "m", "e1", "2026-01-01T12:00:00Z", "S", "B", "Org@X", "Org", [("A", "A@x"), (None, "b@x"), ("A2", "a@x")], "u")], "tenant_id string, connection_id string, mailbox string, id string, lastModified string, subject string, body string, organizer string, organizer_name string, attendees array<struct<name:string,email:string>>, url string")
    one = c.normalize_calendar(meet).first()
    assert one["source_id"] == "e1:2026-01-01T12:00:00Z" and [(a["name"], a["source_actor_id"]) for a in one["known_actors"]] == [("A2", "a@x"), ("b@x", "b@x")]


def test_cursors_only_move_forward(spark, connections):
    env = spark.createDataFrame([("n1", "x", T0 - timedelta(days=1)), ("c1", "x", T0), ("c1", "y", T0 + timedelta(hours=1))], "connection_id string, thread_ref string, received_at timestamp")
    got = {r["id"]: r["last_synced_at"] for r in c.advance_cursors(env, connections).collect()}
    assert got["n1"] == T0 and got["c1"] == T0 + timedelta(hours=1) and got["c2"] is None
    state = connections.withColumn("cursor_state", F.lit('{"x":"2030-01-01 00:00:00"}'))
    maps = {r["id"]: json.loads(r["cursor_state"]) for r in c.advance_cursors(env, state, F.col("thread_ref")).collect()}
    assert maps["c1"] == {"x": "2030-01-01 00:00:00", "y": "2026-01-01 13:00:00"}


def landed(i, tenant="t1", key=None, text="a real message", at="2026-01-01T12:00:00Z"):
    return json.dumps({"tenant_id": tenant, "source": "slack", "source_id": key or f"k{i}", "raw_content": json.dumps({"text": text}), "received_at": at, "permission_scope": []})


def test_envelopes_and_ingest_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join([landed(1), landed(2, key="k1"), landed(3, text="ok"), "{broken", landed(4, key=" ")]) + "\n")
    good, bad = read_envelopes(spark, str(folder))
    assert good.count() == 3 and sorted(r["reason"] for r in bad.collect()) == ["malformed", "source_id is missing"]
    conn = spark.createDataFrame([("c1", "t1", "slack", "active", T0)], "id string, tenant_id string, source string, status string, created_at timestamp")
    tenants = spark.createDataFrame([("t1", False, False)], "id string, learning_paused boolean, core_knowledge_only boolean")
    shape = "tenant_id string, source string, source_id string, decision string, confidence double, record_type string"
    judged = [("t1", "slack", "k1", "KEEP", 0.9, "decision"), ("t1", "slack", "k5", "KEEP", 0.9, "decision"), ("t2", "slack", "k9", "KEEP", 0.9, "decision")]
    outputs = spark.createDataFrame(judged, shape)
    out = str(tmp_path / "out")
    run = lambda outputs=outputs: jobs.ingest_stream(spark, str(folder), out, {"source_connections": conn, "tenants": tenants}, outputs, str(tmp_path / "state")).awaitTermination()
    run()
    (folder / "b.json").write_text("\n".join([landed(5), landed(6, key="k1", text="card 4111111111111111")]) + "\n")
    run()
    run()
    rows = spark.read.parquet(f"{out}/outcomes")
    assert sorted((r["source_id"], r["outcome"]) for r in rows.collect()) == [("k1", "duplicate_on_insert"), ("k1", "duplicate_skipped"), ("k1", "persisted"), ("k3", "prefiltered_trivial_ack"), ("k5", "persisted")]
    assert "REDACTED-CARD" in rows.where("outcome = 'duplicate_skipped'").first()["raw_content"]
    assert spark.read.parquet(f"{out}/rejected").count() == 2
    # A message that no model has judged (not even by another tenant's output) waits, and is taken up once it has been.
    (folder / "c.json").write_text(landed(9, text="number 123456789012") + "\n")
    run()
    (folder / "d.json").write_text(landed(10, key="k1") + "\n")
    run()
    (folder / "e.json").write_text(landed(11, key="k1") + "\n")
    run(spark.createDataFrame([*judged, ("t1", "slack", "k9", "KEEP", 0.9, "decision")], shape))
    (folder / "f.json").write_text(landed(12, key="k1") + "\n")
    run()
    waited = spark.read.parquet(f"{out}/outcomes").where("source_id = 'k9'").orderBy("batch").collect()
    assert [r["outcome"] for r in waited] == ["pending", "pending", "persisted"] and "[REDACTED-NUMBER]" in waited[0]["raw_content"]
    # What waits is taken up without new messages; a key that was stored over 30 days ago counts as new.
    (folder / "g.json").write_text(landed(13, key="k13") + "\n")
    run()
    judged.append(("t1", "slack", "k13", "KEEP", 0.9, "decision"))
    jobs.wake(spark, str(folder))
    run(spark.createDataFrame(judged, shape))
    (folder / "h.json").write_text(landed(14, key="k5") + "\n")
    later = jobs.ingest_stream(spark, str(folder), out, {"source_connections": conn, "tenants": tenants}, spark.createDataFrame(judged, shape), str(tmp_path / "state"), today=date.today() + timedelta(days=31))
    later.awaitTermination()
    end = spark.read.parquet(f"{out}/outcomes").where("source_id IN ('k13', 'k5')").orderBy("source_id", "batch").collect()
    assert [(r["source_id"], r["outcome"]) for r in end] == [("k13", "pending"), ("k13", "persisted"), ("k5", "persisted"), ("k5", "persisted")]


def test_redaction_keeps_json_whole(spark):
    from ledgerloom.functions import text as tx

    raw = [
        '{"id":123456789012,"text":"call 123456789012 \\n4111111111111111","list":["078-05-1120",7,null],"123456789012":"key"}',
        "plain 123456789012",
        '{"broken": "4111111111111111',
        "",
        None,
        '["<@123456789012345678> 4111 1111 1111 1111"]',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [r["out"] for r in df.select("i", tx.redact_json("raw").alias("out")).orderBy("i").collect()]
    assert json.loads(got[0]) == {"id": 123456789012, "text": "call [REDACTED-NUMBER] \n[REDACTED-CARD]", "list": ["[REDACTED-SSN]", 7, None], "123456789012": "key"}
    assert got[1:] == ["plain [REDACTED-NUMBER]", '{"broken": "[REDACTED-CARD]', "", None, '["<@123456789012345678> [REDACTED-CARD]"]']


@pytest.mark.parametrize("strict", [False, True])
def test_limits_in_batch_and_stream(spark, tmp_path, strict):
    at = [0, 10, 20, 30, 60, 61, 120, 125]
    rows = [(k, i * 10 + j, T0 + timedelta(seconds=s)) for i, k in enumerate("ab") for j, s in enumerate(at)]
    df = spark.createDataFrame(rows, "k string, id long, ts timestamp")

    def brute():
        out = []
        for key in "ab":
            start, used = None, 0
            for k, i, t in rows:
                if k == key:
                    if start is None or (t - start).total_seconds() > 60 or (not strict and (t - start).total_seconds() >= 60):
                        start, used = t, 0
                    ok = used < 2
                    used += ok
                    out.append((i, ok))
        return sorted(out)

    limits = jobs.fixed_window_limits(df, 2, 60, "k", "ts", "id", strict)
    assert sorted((r["event_id"], r["allowed"]) for r in limits.collect()) == brute()
    left = jobs.usage_remaining(limits, 2, 60, F.lit(T0 + timedelta(seconds=130)))
    assert {r["remaining"] for r in left.collect()} <= {0, 1, 2} and left.count() == 2


def test_batch_equals_stream(spark, tmp_path):
    rows = [(i % 5, f"e{i % 3}", T0 + timedelta(hours=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, kind string, ts timestamp")
    path = str(tmp_path / "in")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    out = jobs.tumbling_counts(stream, "ts", "1 day", ["kind"], "1 hour")
    q = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    closed = T0 + timedelta(hours=58)
    want = {(r["window_start"], r["kind"]): r["n"] for r in jobs.tumbling_counts(df, "ts", "1 day", ["kind"]).collect() if r["window_start"] + timedelta(days=1) <= closed}
    assert {(r["window_start"], r["kind"]): r["n"] for r in spark.read.parquet(str(tmp_path / "o")).collect()} == want
    once = jobs.stream_dedup(spark.readStream.schema(df.schema).parquet(path), ["k", "kind"], "ts", "30 days")
    once.writeStream.format("parquet").option("path", str(tmp_path / "d")).option("checkpointLocation", str(tmp_path / "dc")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == df.select("k", "kind").distinct().count()


def test_late_budget_and_queue(spark):
    env = spark.createDataFrame([("t", "s", "1", T0), ("t", "s", "2", T0 - timedelta(days=40)), ("t", " ", "3", T0)], "tenant_id string, source string, source_id string, received_at timestamp")
    good, bad, late = jobs.late_and_bad(env, F.lit(T0))
    assert [x.count() for x in (good, bad, late)] == [1, 1, 1]
    calls = spark.createDataFrame([(i, T0 + timedelta(minutes=i), 2.0) for i in range(4)] + [(9, T0 + timedelta(days=1), 9.0)], "id int, ts timestamp, cost double")
    assert {r["id"]: r["allowed"] for r in jobs.daily_budget(calls, F.col("cost"), "ts", "id").collect()} == {0: True, 1: True, 2: True, 3: False, 9: True}
    new = spark.createDataFrame([("a", "t"), ("a", "t"), ("b", "t"), ("x", "t")], "id string, tenant_id string")
    known = spark.createDataFrame([("a", "t"), ("b", "t")], "id string, tenant_id string")
    have = spark.createDataFrame([("b", "t")], "decision_id string, tenant_id string")
    assert [r["id"] for r in jobs.embedding_queue(new, known, have).collect()] == ["a"]


def test_register_files_and_reports(spark, tmp_path):
    spark.createDataFrame([("t1", "Acme", "acme", "team", T0, False, True)], SCHEMAS["tenants"]).write.parquet(str(tmp_path / "tenants"))
    tables = read_register(spark, str(tmp_path), ["tenants"], views=True)
    assert tables["tenants"].first()["name"] == "Acme" and spark.sql("SELECT count(*) FROM tenants").first()[0] == 1
    d = spark.createDataFrame([("decision", 1), ("decision", 2), ("odd", 3)], "record_type string, id int")
    assert {r["record_type"]: r["n"] for r in reports.record_type_counts(d).collect()} == {"decision": 2, "action_item": 0, "blocker": 0}
    links = spark.createDataFrame([(1,), (1,)], "decision_id int")
    assert tuple(reports.source_link_coverage(d, links).first()) == (3, 1, 2)
    assert tuple(reports.source_link_coverage(d, links, distinct=False).first()) == (4, 2, 2)
    counts = reports.outcome_counts(spark.createDataFrame([("a", "e1"), ("a", None), ("b", "e2")], "outcome string, err string"), "err")
    assert {r["outcome"]: (r["n"], r["first_errors"]) for r in counts.collect()} == {"a": (2, ["e1"]), "b": (1, ["e2"])}


def test_store_rewrites_only_its_buckets(spark, tmp_path):
    """Ten keys touch at most ten partitions; a repeated batch, null keys and the empty batch change nothing more."""
    path = str(tmp_path / "store")
    rows = spark.range(2000).selectExpr("IF(id = 7, NULL, id) AS id", "id * 2 AS v", "1 AS seen")
    store.create_store(rows, path, ["id"], 64)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "rows").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([*((i * 100, 5, 1) for i in range(9)), (None, 6, 1), (5000, 1, 1)], "id long, v long, seen int")
    for _ in range(2):
        assert store.upsert_store(new, path, "b1", {"seen": "add"}) <= 11
    after = files()
    gone = {p.parent.name for p in before if p not in after}
    assert 0 < len(gone) <= 11 and {p.parent.name for p in after if p not in before} <= gone | {p.parent.name for p in after if p.parent.name not in {q.parent.name for q in before}}
    got = {r["id"]: (r["v"], r["seen"]) for r in store.read_store(spark, path).collect()}
    assert len(got) == 2001 and got[None] == (6, 2) and got[100] == (5, 2) and got[5000] == (1, 1) and got[1] == (2, 1)
    assert store.upsert_store(new.where("false"), path, "b2") == 0
    assert store.insert_store(new, path, "b3").count() == 0


def test_store_by_day(spark, tmp_path):
    """New keys are added once, days go as folders, and no row is read for it."""
    path = str(tmp_path / "log")
    rows = spark.range(100).selectExpr("id", "date_add(DATE'2024-01-01', cast(id % 10 as int)) AS at")
    store.create_store(rows, path, ["id"], 4, F.col("at"))
    more = spark.range(90, 120).selectExpr("id", "DATE'2024-02-01' AS at")
    assert store.insert_store(more, path, "b", F.col("at")).count() == 20
    assert store.insert_store(more, path, "b", F.col("at")).count() == 20  # a repeated attempt finds its own rows
    assert store.read_store(spark, path).count() == 120
    for p in (tmp_path / "log" / "rows" / "_day=2024-01-01").rglob("*.parquet"):
        p.write_bytes(b"cannot be read")
    assert store.drop_days(spark, path, "2024-01-04") == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert store.read_store(spark, path).count() == 90 and store.drop_days(spark, path, "2024-01-04") == []
    with pytest.raises(ValueError):
        store.upsert_store(more, path, "c")


def test_messages_are_worked_out_once_and_dealt_evenly(spark):
    """One workspace holds every page and has many connections: text is made before the join, in no more tasks' rows than pages."""
    pages = spark.range(40).select(F.lit("w").alias("workspace_id"), F.concat(F.lit("n"), "id").alias("id"), F.lit("u").alias("url"), F.lit("p").alias("last_edited_by"), F.to_timestamp(F.lit("2024-02-01")).alias("last_edited_time"), F.lit('{"Name":{"title":[{"plain_text":"page"}]}}').alias("properties"))
    connections = spark.range(30).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("t").alias("tenant_id"), F.lit("notion").alias("source"), F.lit("w").alias("external_workspace_id"), F.lit("active").alias("status"), F.when(F.col("id") % 3 == 0, F.to_timestamp(F.lit("2024-03-01"))).alias("last_synced_at"))
    out = c.normalize_notion(pages, connections, text=F.length("raw_content"))
    assert out.count() == 40 * 20 and out.select("source_id", "connection_id").distinct().count() == 800
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" in plan[plan.index("Join"):]


PAGES = "workspace_id string, id string, url string, last_edited_by string, last_edited_time timestamp, properties string"


def test_connections_meet_messages_in_arrays(spark, monkeypatch):
    """Connections of one workspace in many arrays of several days, some without a cursor: each pair after its cursor, once; the plan takes arrays apart."""
    monkeypatch.setattr(c, "ARRAY", 4, raising=False)
    at = lambda hours: T0 + timedelta(hours=hours)
    cursors = {f"c{i}": None if i % 10 == 0 else at(7 * i % 96) for i in range(40)}
    place = lambda i: f"w{i % 3}"
    connections = spark.createDataFrame([(f"c{i}", f"t{i % 2}", "notion", None if i == 39 else place(i), "paused" if i == 38 else "active", cursors[f"c{i}"]) for i in range(40)], "id string, tenant_id string, source string, external_workspace_id string, status string, last_synced_at timestamp")
    edited = {f"p{j}": None if j == 20 else at(5 * j - 12) for j in range(25)}
    pages = spark.createDataFrame([(None if j == 24 else place(j), f"p{j}", "u", "e", edited[f"p{j}"], "{}") for j in range(25)], PAGES)
    out = c.normalize_notion(pages, connections)
    later = lambda j, i: cursors[f"c{i}"] is None or (edited[f"p{j}"] is not None and edited[f"p{j}"] > cursors[f"c{i}"])
    wanted = sorted((f"p{j}", f"c{i}", f"t{i % 2}") for j in range(24) for i in range(38) if place(i) == place(j) and later(j, i))
    assert sorted((r["source_id"], r["connection_id"], r["tenant_id"]) for r in out.collect()) == wanted
    assert "Generate inline" in out._jdf.queryExecution().executedPlan().toString()


def test_no_text_of_pages_that_no_connection_takes(spark):
    """Pages of a workspace without connections, and those before every cursor of theirs, go before their texts are made."""
    connections = spark.createDataFrame([("c1", "t", "notion", "w1", "active", T0), ("c2", "t", "notion", "w1", "active", T0 + timedelta(hours=5)), ("c3", "t", "notion", "w2", "paused", None)], "id string, tenant_id string, source string, external_workspace_id string, status string, last_synced_at timestamp")
    pages = spark.createDataFrame([("w1", "good", "u", "e", T0 + timedelta(hours=1), "{}"), ("w1", "bad", "u", "e", T0, "{}"), ("w2", "bad", "u", "e", T0, "{}"), ("w3", "bad", "u", "e", T0, "{}")], PAGES)
    text = F.when(F.col("source_id") == "bad", F.raise_error(F.lit("text made")).cast("string")).otherwise(F.col("raw_content"))
    assert [(r["source_id"], r["connection_id"], r["text"]) for r in c.normalize_notion(pages, connections, text=text).collect()] == [("good", "c1", '{"properties":{}}')]


def test_monday_items_of_the_cursor_s_second(spark, tmp_path):
    """An item updated half a second after its connection's cursor comes, and its key shows seconds."""
    moment = "TIMESTAMP'2024-01-11 00:00:00.5'"
    spark.sql(f"SELECT 0L AS event_id, {moment} AS ts, 3L AS user_id, 'view' AS event_type, 1.0D AS value, '{{}}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    spark.sql("SELECT 6L AS s_suppkey, 3 AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))  # active, cursor 2024-01-11
    spark.sql("SELECT 1L AS c_custkey, 'n' AS c_name").write.parquet(str(tmp_path / "customer.parquet"))
    got = sorted(tuple(r) for r in ingest_queries.monday_envelopes(spark, str(tmp_path)).collect())
    assert got == [("t6", "item:i0:2024-01-11 00:00:00", "Item 0\nOwner: me"), ("t6", "update:u0", "upd 0")]


def test_merged_sketches_estimate_as_one(spark):
    """Beyond the size where a sketch is a list of values: daily sketches merged, and one sketch filled row by row."""
    rows = spark.range(40_000).coalesce(1).selectExpr("id % 20000 AS user_id", "cast(id % 7 AS int) AS day", "'a' AS kind")
    daily = reports.daily_sketches(rows, F.col("day"), ["kind"], ["user_id"])
    whole = reports.daily_sketches(rows, F.lit(0), ["kind"], ["user_id"]).select(reports.sketch_estimate(F.col("sketch")).alias("n")).first()["n"]
    assert reports.merged_sketches(daily, ["kind"]).first()["distinct"] == whole and abs(whole - 20_000) <= 600
