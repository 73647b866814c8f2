from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import governance, ingest, register, threads
from ledgerloom.sources.tables import ENVELOPE, SCHEMAS, insert_ignore, insert_select, open_sealed, seal, upsert

T0 = datetime(2026, 1, 1, 12)


def rows(spark, table, *dicts):
    names = [c.strip().split()[0] for c in SCHEMAS[table].replace("decimal(4,3)", "decimal").split(", ")]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], SCHEMAS[table].replace("decimal(4,3)", "double"))


@pytest.fixture(scope="module")
def tables(spark):
    base = dict(tenant_id="t1", record_type="decision", status="decided", permission_scope=[], alternatives_considered=[], confidence=0.9)
    return {
        "decisions": rows(
            spark, "decisions",
            dict(base, id="d1", decision_statement="Use Spark", origin_raw_event_id="r1", created_at=T0),
            dict(base, id="d2", decision_statement="Use Flink", origin_raw_event_id="r2", created_at=T0 + timedelta(hours=1), superseded_by="d1"),
            dict(base, id="d3", decision_statement="Other", tenant_id="t2", origin_raw_event_id="r9", created_at=T0, confidence=0.5),
            dict(base, id="d4", decision_statement="No origin", rationale="spark too", created_at=T0 + timedelta(hours=2)),
        ),
        "actors": rows(spark, "actors", dict(id="a1", tenant_id="t1", display_name="Ann"), dict(id="a2", tenant_id="t1", slack_user_id="U1234567", email="b@x.org"), dict(id="a3", tenant_id="t1", slack_user_id="U1234567")),
        "decision_actors": rows(spark, "decision_actors", dict(tenant_id="t1", decision_id="d1", actor_id="a2", role="decided_by"), dict(tenant_id="t1", decision_id="d1", actor_id="a1", role="decided_by"), dict(tenant_id="t1", decision_id="d2", actor_id="a3", role="mentioned")),
        "decision_sources": rows(spark, "decision_sources", dict(id="s1", tenant_id="t1", decision_id="d1", raw_event_id="r3", permalink="p")),
        "raw_events": rows(
            spark, "raw_events",
            dict(id="r1", tenant_id="t1", source="slack", source_id="m1", thread_ref="th", received_at=T0, connection_id="c1"),
            dict(id="r2", tenant_id="t1", source="gmail", source_id="m2", thread_ref="C12345678", received_at=T0),
            dict(id="r3", tenant_id="t1", source="slack", source_id="m3", thread_ref="th", received_at=T0 + timedelta(hours=3)),
            dict(id="r4", tenant_id="t1", source="slack", source_id="m4", thread_ref="th", received_at=T0 + timedelta(hours=8)),
            dict(id="r5", tenant_id="t1", source="slack", source_id="m5", thread_ref="th", received_at=T0 + timedelta(hours=10)),
            dict(id="r6", tenant_id="t1", source="slack", source_id="m6", thread_ref="D12345678", received_at=T0),
        ),
        "decision_conflicts": rows(spark, "decision_conflicts", dict(id="k1", tenant_id="t1", decision_id="d1", related_decision_id="d2", relationship="contradicts", confidence=0.7, created_at=T0)),
    }


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_tenant_isolation(tables):
    d = tables["decisions"]
    assert ids(register.tenant_scope(d, "t1")) == ["d1", "d2", "d4"]
    assert ids(register.tenant_scope(d, None)) == []
    assert register.assert_tenant(register.tenant_scope(d, "t1"), "t1").count() == 3
    with pytest.raises(Exception, match="another tenant"):
        register.assert_tenant(d, "t1").collect()


def test_lists_and_filters(tables):
    d, raw = tables["decisions"], tables["raw_events"]
    got = register.list_decisions(register.tenant_scope(d, "t1"), raw, limit=500).collect()
    assert [r["id"] for r in got] == ["d4", "d1"] and got[0]["total"] == 2 and got[1]["source"] == "slack"
    assert ids(register.list_decisions(d, raw, include_superseded=True)) == ["d1", "d2", "d3", "d4"]
    assert ids(register.filter_decisions(d, tables["decision_actors"], min_confidence=0.6, actor_id="a1")) == ["d1"]
    assert ids(register.filter_decisions(d, since=T0 + timedelta(hours=1), until=T0 + timedelta(hours=2))) == ["d2", "d4"]
    assert ids(register.substring_search(d, "SPARK")) == ["d1", "d4"]


def test_hydrate_owner_and_links(tables):
    args = (tables["actors"], tables["decision_actors"], tables["decision_sources"], tables["raw_events"])
    got = {r["id"]: r for r in register.hydrate(tables["decisions"], *args).collect()}
    assert [(a["id"], a["name"]) for a in got["d1"]["actors"]] == [("a1", "Ann"), ("a2", "b@x.org")]
    assert got["d2"]["actors"][0]["name"] is None  # a bare system id is no name
    assert got["d4"]["actors"] == [] and got["d4"]["source_links"] == [] and got["d1"]["source_platforms"] == ["slack"]
    owners = {r["id"]: r["owner"] for r in register.owner(tables["decisions"], tables["decision_actors"], tables["actors"]).collect()}
    assert owners == {"d1": "Ann", "d2": None, "d3": None, "d4": None}
    assert ids(register.missing_links(tables["decisions"], tables["raw_events"], tables["decision_sources"], "gmail")) == ["d2"]


SCOPES = [
    (["team:engineering"], ["team:engineering"], True),
    (["team:sales"], ["team:engineering"], False),
    (["a", "b"], ["b", "c"], True),
    ([], ["team:engineering"], False),
    ([], [], True),
    ([], ["C0BGH34EB0R"], True),
    ([], ["8d6f2f8e-1111-4222-8333-0123456789ab"], True),
    ([], ["C_HR_CONFIDENTIAL"], False),
    ([], ["x@y.org"], False),
    ([], ["C0BGH34EB0R", "label"], False),
]


def test_permissions(spark):
    df = spark.createDataFrame([(i, c, s) for i, (c, s, _) in enumerate(SCOPES)], "i int, caller array<string>, permission_scope array<string>")
    seen = {r["i"] for r in register.permission_filter(df, F.col("caller")).collect()}
    assert seen == {i for i, (_, _, ok) in enumerate(SCOPES) if ok}
    strict = {r["i"] for r in register.permission_filter(df, F.col("caller"), strict=True).collect()}
    assert strict == {0, 2, 4}


def test_conflicts_attention_detail(spark, tables):
    sides = register.conflicts_of(tables["decision_conflicts"], tables["decisions"]).collect()
    assert {(r["id"], r["other_id"], r["other_statement"]) for r in sides} == {("d1", "d2", "Use Flink"), ("d2", "d1", "Use Spark")}
    shown = register.attention(tables["decision_conflicts"], tables["decisions"], []).collect()
    assert len(shown) == 1 and shown[0]["total"] == 1
    one = spark.createDataFrame([("d1",)], "id string")
    detail = threads.decision_detail(one, tables).first()
    assert [t["event_id"] for t in detail["thread"]] == ["r1", "r3", "r4"] and detail["conflicts"][0]["other_id"] == "d2"
    assert threads.decision_context(one, "t2", tables).count() == 0


def test_thread_rules(spark, tables):
    turns = threads.thread_context(tables["decisions"], tables["raw_events"], tables["decision_sources"])
    got = {(r["decision_id"], r["id"]): r["turn"] for r in turns.collect()}
    assert got[("d1", "r1")] == 1 and ("d1", "r5") not in got and got[("d2", "r2")] == 1
    long = spark.createDataFrame([("d", "t", f"e{i:02d}", T0 + timedelta(minutes=i), i == 14) for i in range(15)], "decision_id string, tenant_id string, id string, received_at timestamp, is_source boolean")
    sims = spark.createDataFrame([("d", f"e{i:02d}", float(i == 3)) for i in range(15)], "decision_id string, id string, similarity double")
    assert ids(threads.thread_relevance(long, sims, 12, 2)) == ["e03", "e14"]
    assert threads.thread_relevance(long, sims, 15, 2).count() == 15
    fixed = {r["id"]: r["thread_ref"] for r in register.repair_thread_ref(tables["raw_events"]).collect()}
    assert fixed["r6"] == "m6" and fixed["r2"] == "C12345678" and fixed["r1"] == "th"


def test_hot_thread_in_buckets(spark):
    """One thread with most events: each decision's earliest, as a plain reading of the rules has them."""
    events = [(f"e{i:04d}", "t", "hot" if i % 5 else None, T0 + timedelta(minutes=7 * i)) for i in range(1500)]
    raw = spark.createDataFrame(events, "id string, tenant_id string, thread_ref string, received_at timestamp")
    decisions = spark.createDataFrame([(f"d{i}", "t", f"e{i * 37 % 1500:04d}") for i in range(60)], "id string, tenant_id string, origin_raw_event_id string")
    links = spark.createDataFrame([("t", "d1", "e0400"), ("t", "d1", "e0401"), ("t", "d2", "e1400")], "tenant_id string, decision_id string, raw_event_id string")
    got = {}
    for r in threads.thread_context(decisions, raw, links, "2 hours", 12).collect():
        got.setdefault(r["decision_id"], []).append((r["turn"], r["id"], r["is_source"]))
    at = {e[0]: e[3] for e in events}
    for i in range(60):
        own = {f"e{i * 37 % 1500:04d}", *{1: ("e0400", "e0401"), 2: ("e1400",)}.get(i, ())}
        threaded = [at[e] for e in own if int(e[1:]) % 5]
        near = {e for e, _, th, t in events if th and threaded and min(threaded) - timedelta(hours=2) <= t <= max(threaded) + timedelta(hours=2)}
        want = sorted(own | near, key=lambda e: (at[e], e))[:12]
        assert sorted(got[f"d{i}"]) == [(n + 1, e, e in own) for n, e in enumerate(want)]
    text = threads.thread_context(decisions, raw, links)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "_bucket" in text


def test_mentions_and_runs(spark, tables):
    one = dict(discord_user_id="123456789012345678")
    people = rows(spark, "actors", dict(id="a", tenant_id="t", display_name="Ann", **one), dict(id="b", tenant_id="u", display_name="  ", email="a@u.org", **one), dict(id="c", tenant_id="v", display_name=None, **one))
    messages = spark.createDataFrame([(t, "m", "hi <@!123456789012345678> and <@999999999999999999>") for t in "tuvw"], "tenant_id string, id string, text string")
    got = {r["tenant_id"]: r["text"].split(" and")[0] for r in threads.mention_names(messages, people).collect()}
    assert got == {"t": "hi @Ann", "u": "hi @a@u.org", "v": "hi <@!123456789012345678>", "w": "hi <@!123456789012345678>"}
    m = spark.createDataFrame([("t", "a", 1), ("t", "a", 2), ("t", "b", 3), ("t", "a", 4), ("t", None, 5), ("t", None, 6)], "th string, who string, n int")
    runs = threads.group_consecutive(m, "th", "who", [F.col("n")], "n").orderBy("run_no").collect()
    assert [(r["who"], r["n_messages"]) for r in runs] == [("a", 2), ("b", 1), ("a", 1), (None, 2)]


def test_context_text(spark):
    df = spark.createDataFrame([("q", 1, "Ship it", None, [], 0.935), ("q", 2, "Wait", "risk", ["a", "b"], 1.0)], "query_id string, rank int, decision_statement string, rationale string, alternatives_considered array<string>, confidence double")
    got = register.build_context(df).first()
    line = "-" * 50
    first = f"{line}\nDecision 1\nStatement: Ship it\nRationale: Not provided\nAlternatives: None\nConfidence: 94%\n{line}"
    second = f"{line}\nDecision 2\nStatement: Wait\nRationale: risk\nAlternatives: a, b\nConfidence: 100%\n{line}"
    assert got["context"] == first + "\n\n" + second and got["tokens"] == len(got["context"]) // 4


def test_supersede_and_corrections(spark, tables):
    d = tables["decisions"]
    new = d.where("id = 'd4'").withColumn("id", F.lit("d5")).withColumn("old_id", F.lit("d4")).unionByName(d.where("id = 'd4'").withColumn("id", F.lit("d6")).withColumn("old_id", F.lit("zz")))
    out, rejected = register.supersede(d, new)
    got = {r["id"]: (r["status"], r["superseded_by"]) for r in out.collect()}
    assert got["d4"] == ("superseded", "d5") and got["d5"] == ("decided", None) and "d6" not in got and ids(rejected) == ["d6"]
    fixes = rows(spark, "radar_corrections", dict(id="x1", tenant_id="t1", decision_id="d1", action="edited", corrected_statement="Use Spark 4", corrected_at=T0), dict(id="x2", tenant_id="t1", decision_id="d4", action="rejected", corrected_at=T0), dict(id="x3", tenant_id="t1", decision_id="none", action="confirmed", corrected_at=T0))
    out, log = register.expand_corrections(d, fixes)
    status = {r["decision_statement"]: r["status"] for r in out.collect()}
    assert status["Use Spark"] == "superseded" and status["Use Spark 4"] == "decided" and status["No origin"] == "superseded"
    assert {r["original_statement"] for r in log.collect()} == {"Use Spark", "No origin"}


def test_writes(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, n int, s string")
    new = spark.createDataFrame([("a", 5, None), ("c", 7, "z"), ("c", 8, "y")], "k string, n int, s string")
    assert ids(insert_ignore(target, new, ["k"]), "k") == ["c"]
    one = spark.createDataFrame([("a", 5, None), ("c", 7, "z")], "k string, n int, s string")
    got = {r["k"]: (r["n"], r["s"]) for r in upsert(target, one, ["k"], {"n": "add", "s": "keep"}).collect()}
    assert got == {"a": (6, "x"), "b": (2, None), "c": (7, "z")}
    again = upsert(target, one, ["k"]).collect()
    assert {r["k"]: r["n"] for r in again} == {"a": 5, "b": 2, "c": 7}
    old = spark.createDataFrame([("b", "q"), ("d", "r")], "key string, val string")
    assert ids(insert_select(target.select("k", "s"), old, {"k": "key", "s": "val"}, ["k"]), "k") == ["d"]


def test_sealing(spark):
    df = spark.createDataFrame([(bytearray(b"hello"),)], "raw binary").withColumn("sealed", seal(F.col("raw"), "secret"))
    row = df.select(F.length("sealed").alias("n"), open_sealed(F.col("sealed"), "secret").alias("open"), open_sealed(F.col("sealed"), "wrong").alias("wrong"), open_sealed(F.col("raw"), "secret").alias("plain")).first()
    assert row["n"] == 6 + 12 + 5 + 16 and bytes(row["open"]) == b"hello" and row["wrong"] is None and bytes(row["plain"]) == b"hello"


def _stored(spark, connections, tenants, outputs, turned=False):
    """Which of five copies that came at the same time is stored."""
    copies = [("t1", "slack", "1", None, None, [], '{"text":"hello world %d"}' % i, T0, None, None, None, None, []) for i in range(5)]
    envelopes = spark.createDataFrame(copies[::-1] if turned else copies, ENVELOPE).repartition(3 if turned else 1)
    routed = ingest.outcome_router(envelopes, no_ledger(spark), connections, tenants, outputs)
    return [r["raw_content"] for r in routed.where("outcome = 'persisted'").collect()]


def no_ledger(spark):
    return spark.createDataFrame([], "tenant_id string, source string, source_id string, pipeline_status string")


def test_outcomes(spark):
    env = [("t1", "slack", "1", "hello world", None), ("t1", "slack", "1", "hello again", None), ("t1", "slack", "2", "ok", None), ("t1", "gmail", "3", "sale", True), ("t2", "slack", "4", "x y z", None), ("t3", "slack", "5", "x y z", None), ("t1", "slack", "6", "x", None), ("t1", "slack", "7", "maybe we do", None), ("t1", "slack", "8", "done before", None), ("t1", "slack", "9", "todo item", None)]
    envelopes = spark.createDataFrame([(t, s, i, None, None, [], '{"text":"%s"}' % x, T0 + timedelta(seconds=k), None, None, None, b, []) for k, (t, s, i, x, b) in enumerate(env)], ENVELOPE)
    ledger = spark.createDataFrame([("t1", "slack", "8", "done"), ("t1", "slack", "7", "pending")], "tenant_id string, source string, source_id string, pipeline_status string")
    connections = rows(spark, "source_connections", dict(id="c1", tenant_id="t1", source="slack", status="active"), dict(id="c2", tenant_id="t1", source="gmail", status="active"), dict(id="c3", tenant_id="t3", source="slack", status="active"))
    tenants = rows(spark, "tenants", dict(id="t1", core_knowledge_only=True), dict(id="t2"), dict(id="t3", learning_paused=True))
    judged = [("1", "KEEP", 0.9, "decision"), ("6", "DISCARD", 0.9, None), ("7", "UNCERTAIN", 0.69, None), ("9", "KEEP", 0.9, "action_item")]
    shape = "tenant_id string, source string, source_id string, decision string, confidence double, record_type string"
    outputs = spark.createDataFrame([("t1", "slack", *r) for r in judged] + [("t9", "slack", "1", "DISCARD", 0.9, None)], shape)
    got = sorted((r["source_id"], r["outcome"]) for r in ingest.outcome_router(envelopes, ledger, connections, tenants, outputs).collect())
    assert got == [("1", "duplicate_on_insert"), ("1", "persisted"), ("2", "prefiltered_trivial_ack"), ("3", "prefiltered_bulk_mail"), ("4", "abandoned_no_active_connection"), ("5", "learning_paused"), ("6", "discarded"), ("7", "uncertain_held_out"), ("8", "duplicate_skipped"), ("9", "core_knowledge_only_filtered")]
    assert ids(ingest.retry_pending(envelopes, ledger), "source_id").count("8") == 0
    # Messages without a time, and two tenants with the same message, each with its own output.
    both = spark.createDataFrame([(t, "slack", "1", None, None, [], '{"text":"hello world"}', None, None, None, None, None, []) for t in ("t1", "t3")], ENVELOPE)
    words = spark.createDataFrame([("t1", "slack", "1", "KEEP", 0.9, "decision"), ("t3", "slack", "1", "DISCARD", 0.9, None)], shape)
    open_ = tenants.withColumn("learning_paused", F.lit(False))
    one = _stored(spark, connections, open_, words)
    assert len(one) == 1 and one == _stored(spark, connections, open_, words, turned=True)
    assert sorted((r["tenant_id"], r["outcome"]) for r in ingest.outcome_router(both, ledger, connections, open_, words).collect()) == [("t1", "persisted"), ("t3", "discarded")]


def test_validation_and_actors(spark):
    out = spark.createDataFrame(
        [("1", " Do it ", "decision", "decided", 0.5, [" a ", "a", ""], [("x", "decided_by")]), ("2", " ", "decision", "decided", 0.5, None, None), ("3", "ok", "odd", "decided", 1.5, None, [("x", "decided_by"), ("y", "decided_by")])],
        "source_key string, decision_statement string, record_type string, status string, confidence double, alternatives_considered array<string>, actors array<struct<source_actor_id:string,role:string>>",
    ).withColumn("rationale", F.lit(""))
    good, bad = ingest.validate_extractions(out)
    row = good.first()
    assert row["decision_statement"] == "Do it" and row["alternatives_considered"] == ["a"] and row["rationale"] is None
    assert {r["source_key"]: len(r["reasons"]) for r in bad.collect()} == {"2": 1, "3": 3}
    actors = rows(spark, "actors", dict(id="a1", tenant_id="t", email="x@y.org"))
    refs = spark.createDataFrame([("t", "gmail", "x@y.org", "X"), ("t", "outlook_calendar", "x@y.org", "X"), ("t", "slack", "U9", "Zed")], "tenant_id string, source string, raw_id string, name string")
    resolved, added = ingest.find_or_create_actors(refs, actors)
    assert [r["actor_id"] for r in resolved.where("raw_id = 'x@y.org'").collect()] == ["a1", "a1"]
    new = added.collect()
    assert len(new) == 1 and new[0]["slack_user_id"] == "U9" and new[0]["display_name"] == "Zed"
    again, none = ingest.find_or_create_actors(refs, actors.unionByName(added, allowMissingColumns=True))
    assert none.count() == 0
    envelopes = spark.createDataFrame([("t", "slack", "1", [("Xavier", "id-x")]), ("t2", "slack", "1", [("Xavier", "id-y")])], "tenant_id string, source string, source_id string, known_actors array<struct<name:string,source_actor_id:string>>")
    named = spark.createDataFrame([("t", "slack", "1", [("xavier", "mentioned"), ("other", "mentioned")])], "tenant_id string, source string, source_id string, actors array<struct<source_actor_id:string,role:string>>")
    assert [a["source_actor_id"] for a in ingest.match_known_actors(named, envelopes).first()["actors"]] == ["id-x", "other"]


def test_governance(spark, tables):
    bad = tables["decisions"].where("id = 'd1'").withColumn("status", F.lit("odd")).withColumn("confidence", F.lit(2.0))
    assert {r["violation"] for r in governance.check_constraints(bad, "decisions").collect()} == {"status is not allowed", "confidence is out of range"}
    conns = rows(spark, "source_connections", dict(id="c1", tenant_id="t1"))
    all_ = {**tables, "source_connections": conns}
    survivors, doomed = governance.cascade_delete(all_, "source_connections", "id", spark.createDataFrame([("c1",)], "id string"))
    assert ids(doomed["decisions"]) == ["d1"] and ids(survivors["decisions"]) == ["d2", "d3", "d4"]
    assert survivors["decision_conflicts"].count() == 0 and survivors["decision_sources"].count() == 0 and ids(survivors["raw_events"])[0] == "r2"
    members = rows(spark, "memberships", dict(tenant_id="a", user_id="u", role="owner"), dict(tenant_id="b", user_id="u", role="owner"), dict(tenant_id="b", user_id="v", role="member"))
    assert {r["tenant_id"]: r["verdict"] for r in governance.tenant_delete_check(members, "u").collect()} == {"a": "droppable", "b": "blocked"}
    raw = spark.createDataFrame([("x", T0), ("y", T0 + timedelta(days=40)), ("z", None)], "id string, expires_at timestamp")
    kept, gone = governance.purge_expired(raw, F.lit(T0 + timedelta(days=1)))
    assert ids(kept) == ["y", "z"] and gone.first()["purged"] == 1
    history = spark.createDataFrame([("t", "u", "q1", 3, T0)], SCHEMAS["search_history"])
    searches = spark.createDataFrame([("t", "u", "q2", 1, T0), ("t", "w", "q3", 1, T0), ("t", "u", "  ", 0, T0)], SCHEMAS["search_history"])
    prefs = spark.createDataFrame([("w", False)], SCHEMAS["user_search_preferences"])
    assert ids(governance.search_history_record(history, searches, prefs), "query") == ["q1", "q2"]
    assert governance.search_history_list(history, "u").first()["total"] == 1
    users = spark.createDataFrame([("u1", "Ann@x.org", T0), ("u2", "bob@x.org", T0)], "id string, email string, created_at timestamp")
    allow = spark.createDataFrame([("ann@x.org",)], "email string")
    made, owners = governance.provision_tenants(users, rows(spark, "tenants"), allow)
    assert made.count() == 1 and owners.first()["role"] == "owner"
    again, _ = governance.provision_tenants(users, made, allow)
    assert again.count() == 0


def test_digests(spark):
    tenants = rows(spark, "tenants", dict(id="t"))
    members = rows(spark, "memberships", dict(tenant_id="t", user_id="u", role="owner"), dict(tenant_id="t", user_id="v", role="member"))
    decisions = spark.createDataFrame([("d1", "open", "decision", []), ("d2", "secret", "decision", ["u@x"])], "id string, decision_statement string, record_type string, permission_scope array<string>")
    matches = spark.createDataFrame([("t", None, 1, "d1"), ("t", None, 2, "d2"), ("t", "u", 1, "d2")], "tenant_id string, user_id string, rank int, decision_id string")
    scopes = spark.createDataFrame([("t", "u", ["u@x"])], "tenant_id string, user_id string, scopes array<string>")
    as_of = F.lit("2026-07-20 09:00:00").cast("timestamp")
    got = {r["user_id"]: r for r in governance.weekly_digest(matches, tenants, members, decisions, scopes, as_of).collect()}
    assert [i["decision_id"] for i in got[None]["items"]] == ["d1"] and not got[None]["personalized"]
    assert [i["decision_id"] for i in got["u"]["items"]] == ["d2"] and got["u"]["personalized"]
    assert [i["decision_id"] for i in got["v"]["items"]] == ["d1"] and str(got["v"]["week_of"]) == "2026-07-20"
    stored = spark.createDataFrame([("o", "t", None, "2026-07-20", "old"), ("p", "t", None, "2026-07-13", "past")], "id string, tenant_id string, user_id string, week_of string, summary string").withColumn("week_of", F.to_date("week_of")).withColumn("created_at", F.lit(T0))
    new = stored.withColumn("summary", F.lit("new"))
    out = {str(r["week_of"]): r["summary"] for r in governance.digest_store(stored, new, as_of).collect()}
    assert out == {"2026-07-20": "new", "2026-07-13": "past"}
