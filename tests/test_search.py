import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluation, fulltext, fusion, similarity


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(n, size=8, seed=1, labels=2):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=size)], i % labels, i) for i in range(n)]


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / n) if n else 0.0


@pytest.mark.parametrize("tile", [7, 2048])
def test_pairs_equal_brute_force(spark, tile):
    rows = vectors(60) + [(60, [0.0] * 8, 0, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, at long")
    got = {(r["a"], r["b"]) for r in similarity.similar_pairs(df, 0.4, 8, ["label"], tile=tile).collect()}
    v = {i: np.array(e, np.float32).astype(float) for i, e, _, _ in rows}
    want = {(a, b) for a in v for b in v if a < b and a % 2 == b % 2 and cosine(v[a], v[b]) >= 0.4}
    assert got == want
    text = plan(similarity.similar_pairs(df, 0.4, 8, ["label"], tile=tile))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_topk_and_lsh(spark):
    rows = vectors(50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, at long")
    q = df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in similarity.vector_topk(q, df, 3, 8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    v = {i: np.array(e, np.float32).astype(float) for i, e, _, _ in rows}
    for i in got:
        best = sorted(v, key=lambda k: (-cosine(v[i], v[k]), k))[:3]
        assert [k for _, k in sorted(got[i])] == best
    with pytest.raises(ValueError):
        similarity.vector_topk(q, df, 51, 8)
    near = spark.createDataFrame([(0, [1.0] * 8, 0), (1, [1.0] * 7 + [1.1], 0), (2, [-1.0] * 8, 0)], "vec_id long, embedding array<float>, label int")
    assert [(r["a"], r["b"]) for r in similarity.lsh_pairs(near, 0.9, 8, ["label"]).collect()] == [(0, 1)]
    with pytest.raises(Exception, match="vector without"):
        similarity.check_dimension(df, 9).collect()


def test_cells_equal_brute_force(spark, monkeypatch):
    """Many cells, string ids, equal vectors, a zero vector; new rows alone; what is sent falls with the floor."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    made = [centres[i % 12] + rng.normal(size=16) * (0.05 if i % 2 else 0.6) for i in range(300)]
    made += [made[5], made[5], np.zeros(16)]
    rows = [(f"v{i:03}", "t" if i % 10 else "u", [float(x) for x in v]) for i, v in enumerate(made)]
    df = spark.createDataFrame(rows, "id string, tenant_id string, embedding array<float>")
    v = np.array([r[2] for r in rows], np.float32).astype(float)
    unit = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) > 0, np.linalg.norm(v, axis=1, keepdims=True), 1)
    sims = unit @ unit.T
    sent = {}
    for floor in (0.35, 0.9, 0.97):
        got = {(r["a"], r["b"]) for r in similarity.similar_pairs(df, floor, 16, ["tenant_id"], "id", tile=20).collect()}
        want = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][1] == rows[j][1] and sims[i, j] >= floor}
        assert got == want
        plain = df.select(F.col("id").alias("i"), F.col("embedding").cast("array<double>").alias("v"), F.col("tenant_id").alias("block"))
        sent[floor] = similarity._cells(plain, floor, 16, 20).count()
    assert sent[0.97] < sent[0.9] < sent[0.35] and sent[0.97] < 3 * len(rows)
    new = spark.createDataFrame([("v005",), ("v077",), ("v302",)], "id string")
    some = {(r["id"], r["other_id"], r["rank"]) for r in similarity.conflict_candidates(df, 0.9, 3, 16, new_ids=new).collect()}
    every = {(r["id"], r["other_id"], r["rank"]) for r in similarity.conflict_candidates(df, 0.9, 3, 16).where("id IN ('v005', 'v077', 'v302')").collect()}
    assert some == every and len(some) == 6


def test_whole_lists_are_ranked_without_one_window(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["q", "q", "q", "r", None]), "a", rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "query_id string, list string, size int, id int")
    order = [F.desc("size"), F.asc("id")]
    ranked = fusion.rank_positions(df, order)
    want = {}
    for q, _, size, i in sorted(rows, key=lambda r: (str(r[0]), -r[2], r[3])):
        want.setdefault(q, []).append(i)
    got = {(r["query_id"], r["rank"]): r["id"] for r in ranked.collect()}
    assert got == {(q, n + 1): i for q, ids in want.items() for n, i in enumerate(ids)}
    assert {(r["query_id"], r["rank"]): r["id"] for r in fusion.rank_positions(df, order, most=7).collect()} == {k: i for k, i in got.items() if k[1] <= 7}
    windows = [x for x in plan(ranked).splitlines() if "Window" in x]
    assert windows and all("_range" in x for x in windows)  # over the counts of ranges, not over rows


def test_superseding(spark):
    d = spark.createDataFrame([(1, None), (2, None), (3, 1), (4, None)], "id long, superseded_by long")
    pairs = spark.createDataFrame([(1, 2, 0.97), (1, 4, 0.99), (3, 4, 0.98), (2, 4, 0.96)], "older long, newer long, similarity double")
    got = {r["id"]: r["superseded_by"] for r in similarity.mark_superseded(d, pairs).collect()}
    assert got == {1: 4, 2: 4, 3: 1, 4: None}
    left = similarity.purge_supersede_leaves(similarity.mark_superseded(d, pairs))
    assert sorted(r["id"] for r in left.collect()) == [1, 4]
    text = plan(left)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_conflicts_are_detected(spark):
    d = spark.createDataFrame([(1, None, 1), (2, None, 2), (3, None, 2)], "id long, superseded_by long, created_at int")
    cand = spark.createDataFrame([(2, 1, 0.9), (2, 3, 0.8), (3, 1, 0.8)], "id long, other_id long, similarity double")
    labels = spark.createDataFrame([(2, 1, "contradicts", "why", 0.6), (3, 1, "contradicts", "no", 0.59), (2, 3, "duplicates", "same", 0.9)], "id long, other_id long, relationship string, reason string, confidence double")
    out, edges = similarity.detect_conflicts(d, cand, labels)
    assert {r["id"]: r["superseded_by"] for r in out.collect()} == {1: None, 2: None, 3: 2}
    assert [(r["decision_id"], r["related_decision_id"]) for r in edges.collect()] == [(2, 1)]


DOCS = [(1, "The quick brown fox"), (2, "Quick foxes and brown dogs"), (3, "the lazy dog sleeps"), (4, None), (5, "brown quick")]


def found(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_full_text(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert found(fulltext.search_plain(df, "quick BROWN", 9)) == [1, 2, 5]
    assert found(fulltext.search_plain(df, "  ", 9)) == []
    assert found(fulltext.search_web(df, '"quick brown"', 9)) == [1]
    assert found(fulltext.search_web(df, "brown -dogs", 9)) == [1, 5]
    assert found(fulltext.search_web(df, "lazy OR foxes", 9)) == [2, 3]
    assert found(fulltext.search_web(df, "-quick", 9)) == []
    index = fulltext.text_index(df, stemming=True, stop_words=True)
    terms = {r["term"] for r in index.postings.collect()}
    assert "dog" in terms and "dogs" not in terms and "the" not in terms and index.sizes.first()["n"] == 5
    asked = spark.createDataFrame([(1, '"the dog"'), (2, "foxes jumped OR sleeping"), (3, "the"), (4, None)], "query_id long, query string")
    got = {(r["query_id"], r["doc_id"]) for r in fulltext.search_many(asked, index, 9).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}
    one = df.select(F.array(F.lit("a"), F.lit("b")).alias("k"), F.array().cast("array<string>").alias("e")).limit(1)
    assert tuple(one.select(fulltext.or_query(F.col("k"), F.lit("q")), fulltext.or_query(F.col("e"), F.lit("q"))).first()) == ("a OR b", "q")


def test_fusion(spark):
    ranked = spark.createDataFrame([("q", "a", 1, "x"), ("q", "a", 2, "y"), ("q", "b", 1, "y"), ("q", "b", 2, "z"), ("q", "b", 3, "y")], "query_id string, list string, rank int, decision_id string")
    got = [(r["decision_id"], round(r["score"], 6)) for r in fusion.rrf(ranked).orderBy("position").collect()]
    assert got == [("y", round(1 / 62 + 1 / 61, 6)), ("x", round(1 / 61, 6)), ("z", round(1 / 62, 6))]
    assert [r["decision_id"] for r in fusion.rrf(ranked, top_k=1).collect()] == ["y"]
    semantic, keyword = (ranked.where(F.col("list") == x).drop("list") for x in "ab")
    assert {r["decision_id"] for r in fusion.retrieve(semantic, keyword, "semantic_only", 9).collect()} == {"x", "y"}
    assert fusion.effective_k(5) == (7, 20) and fusion.effective_k(5, True) == (10, 20) and fusion.effective_k(80) == (50, 100)


def test_rerank_and_citations(spark):
    cand = spark.createDataFrame([("q", "a", 1, "apples"), ("q", "b", 2, "Pears"), ("r", "c", 1, "x"), ("r", "d", 2, "y")], "query_id string, decision_id string, rank int, text string")
    scores = spark.createDataFrame([("q", "a", 0.4), ("q", "b", 0.1)], "query_id string, decision_id string, score double")
    entities = spark.createDataFrame([("q", ["PEAR"]), ("r", ["y"])], "query_id string, entities array<string>")
    got = {(r["query_id"], r["position"]): r["decision_id"] for r in fusion.entity_boost_rerank(cand, scores, entities, 5).collect()}
    assert got == {("q", 1): "b", ("q", 2): "a", ("r", 1): "c", ("r", 2): "d"}
    answers = spark.createDataFrame([("q", [1, 7, 1])], "query_id string, citations array<int>")
    matches = cand.withColumn("position", F.col("rank"))
    assert [r["decision_id"] for r in fusion.resolve_citations(answers, matches).collect()] == ["a"]


def test_batch_search(spark):
    decisions = spark.createDataFrame([(f"d{i}", "t", f"statement {i}", None, [], 0.5, [] if i % 2 else ["x"]) for i in range(30)], "id string, tenant_id string, decision_statement string, rationale string, alternatives_considered array<string>, confidence double, permission_scope array<string>")
    ranked = spark.createDataFrame([("q", "a", i + 1, f"d{i}") for i in range(30)], "query_id string, list string, rank int, decision_id string")
    questions = spark.createDataFrame([("q", [], []), ("none", [], [])], "query_id string, scopes array<string>, entities array<string>")
    got = {r["query_id"]: r for r in fusion.search_batch(questions, ranked, decisions).collect()}
    assert (got["q"]["retrieved"], got["q"]["authorized"], got["q"]["final"]) == (20, 10, 7)
    assert got["q"]["decision_ids"] == [f"d{i}" for i in range(1, 15, 2)] and got["none"]["final"] == 0
    assert got["q"]["context"].startswith("-" * 50 + "\nDecision 1\nStatement: statement 1")


def test_only_candidates_are_scored(spark):
    """A function of scores gets the permitted candidates, not every pair of question and decision."""
    decisions = spark.createDataFrame([(f"d{i:02}", f"statement {i}", None, [], 0.5, [] if i % 2 else ["x"]) for i in range(60)], "id string, decision_statement string, rationale string, alternatives_considered array<string>, confidence double, permission_scope array<string>")
    ranked = spark.createDataFrame([("q", "a", i + 1, f"d{i:02}") for i in range(60)], "query_id string, list string, rank int, decision_id string")
    questions = spark.createDataFrame([("q", [], ["Statement 3"])], "query_id string, scopes array<string>, entities array<string>")
    asked = []

    def scores(pairs):
        asked.extend(r["decision_id"] for r in pairs.collect())
        return pairs.withColumn("score", F.substring("decision_id", 2, 2).cast("double") / 1000)

    got = fusion.search_batch(questions, ranked, decisions, scores=scores).first()
    assert sorted(asked) == [f"d{i:02}" for i in range(1, 20, 2)]
    assert got["decision_ids"] == ["d03", *(f"d{i:02}" for i in range(19, 7, -2))]


def test_metrics(spark):
    rng = random.Random(1)
    rows = [(i, "m" if i % 2 else "n", "s", rng.randrange(1, 9) if i % 3 else None, "PASS" if i % 4 else "FAIL", float(rng.randrange(1000))) for i in range(101)]
    df = spark.createDataFrame(rows, "query_id int, mode string, segment string, first_expected_rank int, status string, ms double")
    got = {(r["mode"], r["segment"]): r for r in evaluation.metrics_by_segment(df, [evaluation.recall_at(3).alias("r3"), evaluation.mrr().alias("mrr")]).collect()}
    own = [r for r in rows if r[1] == "m"]
    assert got["m", None]["r3"] == pytest.approx(np.mean([bool(r[3] and r[3] <= 3) for r in own]))
    assert got["m", "s"]["mrr"] == pytest.approx(np.mean([1 / r[3] if r[3] else 0 for r in own]))
    lat = {r["mode"]: r for r in evaluation.latency_stats(df, "ms", ["mode"]).collect()}
    ms = sorted(r[5] for r in own)
    assert lat["m"]["p95_latency"] == ms[round(0.95 * (len(ms) - 1))] and lat["m"]["median_latency"] == np.median(ms)


def test_scoring_rules(spark):
    q = spark.createDataFrame(
        [("1", ["a", "b"], [], True, True), ("2", ["a", "b"], [], True, False), ("3", [], [], False, False), ("4", [], ["z"], False, False), ("5", ["a"], ["z"], True, False), ("6", ["a"], [], True, False)],
        "query_id string, expected_decision_ids array<string>, excluded_decision_ids array<string>, expected_answerable boolean, is_multi boolean",
    )
    a = spark.createDataFrame([("1", ["x", "b", "a"]), ("2", ["x", "b"]), ("3", ["x"]), ("4", ["x"]), ("5", ["a", "z"])], "query_id string, cited array<string>")
    got = {r["query_id"]: (r["status"], r["first_expected_rank"]) for r in evaluation.score_queries(q, a).collect()}
    assert got == {"1": ("PASS", 2), "2": ("PASS", 2), "3": ("FAIL", None), "4": ("PASS", None), "5": ("FAIL", 1), "6": ("FAIL", None)}
    runs = spark.createDataFrame([("1", "ERROR", 0), ("2", "PASS", 1)], "query_id string, status string, n int")
    retry = spark.createDataFrame([("1", "PASS", 5), ("2", "FAIL", 9)], "query_id string, status string, n int")
    assert {r["query_id"]: r["n"] for r in evaluation.merge_retries(runs, retry).collect()} == {"1": 5, "2": 1}
    corpus = spark.createDataFrame([("a",), ("b",)], "source_message_id string")
    bad = {(r["query_id"], r["violation"]) for r in evaluation.reference_check(q, corpus).collect()}
    assert bad == {("4", "missing z"), ("5", "missing z")}
    sec = spark.createDataFrame([("1", ["a"], ["a", "b"], ["c"], [], True), ("2", ["a"], ["a"], ["a"], [], False)], "query_id string, reranked_ids array<string>, authorized_ids array<string>, cited array<string>, excluded array<string>, is_refusal boolean")
    assert {r["finding"] for r in evaluation.security_findings(sec).collect()} == {"cited beyond authorized", "refusal with citations"}


@pytest.mark.parametrize("tile", [3, 2048])
@pytest.mark.parametrize("block", [None, "label"])
def test_topk_in_tiles(spark, monkeypatch, tile, block):
    """Ties by id, zero vectors, blocks, fewer vectors than k; in one tile and in many."""
    monkeypatch.setattr(similarity, "TILE", tile)
    rows = vectors(40) + [(40 + i, e, label, at) for i, e, label, at in vectors(15)] + [(90, [0.0] * 8, 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, at long")
    q = df.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in similarity.vector_topk(q, df, 6, 8, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    v = {i: np.array(e, np.float32).astype(float) for i, e, _, _ in rows}
    label = {i: x for i, _, x, _ in rows}
    for i in v:
        if i % 7 == 0:
            near = sorted((-round(cosine(v[i], v[j]), 9), j) for j in v if block is None or label[i] == label[j])[:6]
            assert [j for _, j in sorted(got[i])] == [j for _, j in near], i
    assert similarity.vector_topk(q.where("false"), df, 6, 8).count() == 0 and similarity.vector_topk(q, df.where("false"), 6, 8).count() == 0


SINGLE = {}
COLOURS = ["red", "green", "blue", "old", "new", "très", "größe", "東京"]


@pytest.mark.parametrize("many_blocks", [False, True])
def test_many_questions_equal_single_ones(spark, monkeypatch, tmp_path, many_blocks):
    """Words, alternatives, phrases and banned words; in one block, and in many with few scored first."""
    if many_blocks:
        monkeypatch.setattr(fulltext, "BLOCK", 3)
        monkeypatch.setattr(fulltext, "FIRST_BLOCKS", 1)
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(COLOURS, k=rng.randrange(0, 14)))) for i in range(120)] + [(199, None)], "doc_id long, text string")
    asked = ["red new", "old", "blue! GREEN", "absent", "", "red absent", "-red", "red -new", '"red new" OR "blue old green"', 'TRÈS -"größe red" OR 東京', "red OR -blue", '"red red"', " ".join(f"absent{i} OR" for i in range(70)) + " blue"]
    index = fulltext.write_index(docs, f"{tmp_path}/index") if many_blocks else fulltext.text_index(docs)
    questions = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    for web, single in ((True, fulltext.search_web), (False, fulltext.search_plain)):
        rows = fulltext.search_many(questions, index, 9, web=web).collect()
        for i, query in enumerate(asked if web else asked[:6]):
            if (web, i) not in SINGLE:
                SINGLE[web, i] = [(r["doc_id"], round(r["score"], 5), r["rank"]) for r in single(docs, query, 9).orderBy("rank").collect()]
            assert sorted(((r["doc_id"], round(r["score"], 5), r["rank"]) for r in rows if r["query_id"] == i), key=lambda x: x[2]) == SINGLE[web, i], query
    if many_blocks:
        assert index.peaks.select("block").distinct().count() > 20
        scoped = fulltext.write_index(docs.withColumn("t", F.lit("a")), f"{tmp_path}/scoped", scope="t")
        text = plan(fulltext.search_many(questions.withColumn("t", F.lit("a")), scoped, 9, scope="t"))
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_frequent_words_do_not_score_every_document(spark, monkeypatch, tmp_path):
    """Every block holds the word; the peaks leave out most of them, and the best five are still exact."""
    monkeypatch.setattr(fulltext, "BLOCK", 10)
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat(repeat('the ', cast(id % 40 as int)), 'the ', repeat('x ', cast(id % 199 as int))) AS text")
    index = fulltext.write_index(docs, f"{tmp_path}/index")
    out = fulltext.search_many(spark.createDataFrame([(1, "the")], "query_id long, query string"), index, 5).orderBy("rank").collect()
    one = fulltext.search_plain(docs, "the", 5).orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"]) for r in out] == [(r["doc_id"], r["rank"]) for r in one]
    peaks = index.peaks.where("term = 'the'")
    reach = peaks.where(F.col("peak") * float(np.log(1 + 0.5 / 2000.5)) >= out[-1]["score"] - fulltext.SLACK)
    assert peaks.count() > 150 and reach.count() < peaks.count() / 2


def shuffled(node) -> int:
    """Rows that the shuffles of an executed plan wrote."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    children = node.children()
    return own + sum(shuffled(children.apply(i)) for i in range(children.size()))


def test_matches_are_not_shuffled(spark, monkeypatch, tmp_path):
    """Every question matches every document, all scores tie: only words, questions and the best of each task go anywhere."""
    monkeypatch.setattr(fulltext, "BLOCK", 3)
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('the red house w', id % 2, ' x') AS text")
    asked = spark.range(80).selectExpr("id AS query_id", """if(id % 2 = 0, 'the red', '"red house" OR the') AS query""")
    out = fulltext.search_many(asked, fulltext.write_index(docs, f"{tmp_path}/index"), 5)
    rows = out.collect()
    assert len(rows) == 400 and {r["doc_id"] for r in rows} == {0, 1, 2, 3, 4}
    assert shuffled(out._jdf.queryExecution().executedPlan()) < 5_000


def test_repeated_ids_are_one_document(spark):
    docs = spark.createDataFrame([(1, "red house"), (1, "blue car"), (2, "red"), (3, "blue red")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red blue"), (2, '"house blue" OR "car red"'), (3, '"blue car"')], "query_id long, query string")
    got = sorted((r["query_id"], r["doc_id"]) for r in fulltext.search_many(asked, fulltext.text_index(docs), 9).collect())
    assert got == [(1, 1), (1, 3), (3, 1)]


def test_scopes_are_searched_apart(spark):
    """A tenant's question finds that tenant's decisions only, and its words are as rare as they are there."""
    docs = spark.createDataFrame([(1, "a", "red house"), (2, "b", "red car"), (3, "b", "blue car"), (4, None, "red")], "doc_id long, tenant_id string, text string")
    index = fulltext.text_index(docs, scope="tenant_id")
    asked = spark.createDataFrame([(1, "a", "red"), (2, "b", "red OR blue"), (3, "c", "red")], "query_id long, tenant_id string, query string")
    got = sorted((r["query_id"], r["doc_id"]) for r in fulltext.search_many(asked, index, 9, scope="tenant_id").collect())
    assert got == [(1, 1), (2, 2), (2, 3)]


def test_questions_to_answers(spark, tmp_path):
    """String ids, three modes, tenants, questions without a vector or without words."""
    rng = np.random.default_rng(4)
    rows = [(f"d{i:02}", f"t{i % 2}", f"{'red' if i % 3 else 'blue'} plan {i}", None, [], 0.5, ["x"] if i % 5 == 0 else [], float(i)) for i in range(60)]
    decisions = spark.createDataFrame(rows, "id string, tenant_id string, decision_statement string, rationale string, alternatives_considered array<string>, confidence double, permission_scope array<string>, at double")
    unit = {r[0]: rng.normal(size=8) for r in rows}
    vectors = spark.createDataFrame([(r[0], r[1], [float(x) for x in unit[r[0]]]) for r in rows], "id string, tenant_id string, embedding array<float>")
    index = fulltext.write_index(decisions, f"{tmp_path}/index", "id", "decision_statement", scope="tenant_id")
    asked = [("q1", "t0", "red", [float(x) for x in unit["d04"]], [], []), ("q2", "t1", None, [float(x) for x in unit["d05"]], ["x"], []), ("q3", "t1", "blue plan", None, [], []), ("q4", "t9", "blue", None, [], [])]
    questions = spark.createDataFrame(asked, "query_id string, tenant_id string, query string, embedding array<float>, scopes array<string>, entities array<string>")
    for mode in ("semantic_only", "keyword_only", "hybrid_rrf"):
        got = {r["query_id"]: r for r in fusion.search_questions(questions, decisions, vectors, index, 8, mode).collect()}
        near = {q: sorted((r[0] for r in rows if r[1] == t), key=lambda i: (-round(cosine(np.array(e, np.float32), unit[i].astype(np.float32)), 9), i))[:20] for q, t, _, e, _, _ in asked if e}
        if mode == "semantic_only":
            allowed = [i for i in near["q1"] if int(i[1:]) % 5][:7]
            assert got["q1"]["decision_ids"] == allowed and got["q1"]["retrieved"] == 20 and got["q3"]["final"] == 0
            assert got["q2"]["decision_ids"] == near["q2"][:7]
        if mode == "keyword_only":
            assert got["q3"]["final"] == 7 and all(int(i[1:]) % 3 == 0 and int(i[1:]) % 2 == 1 for i in got["q3"]["decision_ids"]) and got["q2"]["final"] == 0
        assert got["q4"]["final"] == 0 and got["q4"]["retrieved"] == 0
    with pytest.raises(ValueError):
        fusion.ranked_lists(questions, vectors, index, 8, "other")


def test_modes_are_answered_together(spark, tmp_path, monkeypatch):
    """All modes at once answer as each alone does, with and without scores, and search each list once."""
    rng = np.random.default_rng(5)
    rows = [(i, f"t{i % 2}", f"{'red' if i % 3 else 'blue'} plan {i}", None, [], 0.5, ["x"] if i % 5 == 0 else []) for i in range(60)]
    decisions = spark.createDataFrame(rows, "id long, tenant_id string, decision_statement string, rationale string, alternatives_considered array<string>, confidence double, permission_scope array<string>")
    unit = [(r[0], r[1], [float(x) for x in rng.normal(size=8)]) for r in rows]
    vectors = spark.createDataFrame(unit, "id long, tenant_id string, embedding array<float>")
    index = fulltext.write_index(decisions, f"{tmp_path}/index", "id", "decision_statement", scope="tenant_id")
    questions = spark.createDataFrame([(1, "t0", "red", unit[4][2], [], ["4"]), (2, "t1", None, unit[5][2], ["x"], []), (3, "t1", "blue plan", None, [], ["9"])], "query_id long, tenant_id string, query string, embedding array<float>, scopes array<string>, entities array<string>")
    scores = lambda pairs: pairs.where("query_id <> 2").withColumn("score", F.col("decision_id") % 7 / 7.0)
    columns = ["query_id", "retrieved", "authorized", "final", "decision_ids", "context", "tokens"]
    alone = sorted((mode, *r) for mode in ("semantic_only", "keyword_only", "hybrid_rrf") for r in fusion.search_questions(questions, decisions, vectors, index, 8, mode, 5, scores).select(columns).collect())
    calls = []
    for name in ("search_many", "vector_topk"):
        own = getattr(fusion, name)
        monkeypatch.setattr(fusion, name, lambda *a, own=own, name=name, **k: calls.append(name) or own(*a, **k))
    assert sorted(tuple(r) for r in fusion.search_modes(questions, decisions, vectors, index, 8, None, 5, scores).select("mode", *columns).collect()) == alone
    assert sorted(calls) == ["search_many", "vector_topk"]


def test_only_documents_that_reach_are_matched(monkeypatch):
    """Tiles with thousands of hits: the best are those of all hits, and clauses see few documents."""
    rng = np.random.default_rng(6)
    docs = [[f"w{min(int(x), 30)}" for x in rng.geometric(0.12, rng.integers(3, 40))] for _ in range(6000)]
    question = fulltext._parse('w0 OR w1 OR "w2 w3" -w4 OR "w5 w1"', True, False, False)
    df = {t: sum(t in d for d in docs) for t in {w for d in docs for w in d}}
    mean = sum(map(len, docs)) / len(docs)
    row = {"query_id": 1, "words": [{"no": n, "term": t, "scored": s, "df": df.get(t, 0)} for n, t, s in question[0]], "phrases": [dict(zip(("no", "at", "term"), p)) for p in question[1]], "clauses": [dict(zip(("words", "need", "ban"), p)) for p in question[2]], "n": len(docs), "mean": mean}
    seen, hits = [], fulltext._Question._hits
    monkeypatch.setattr(fulltext._Question, "_hits", lambda self, tile, *among: seen.append(len(among[0]) if among and among[0] is not None else len(tile.ids)) or hits(self, tile, *among))
    asked = fulltext._Question(row, 10)
    for start in range(0, 6000, 2000):
        part = docs[start : start + 2000]
        batch = pa.record_batch([pa.array(range(start, start + 2000)), pa.array([len(d) for d in part]), pa.array(part)], ["doc_id", "n_terms", "w"])
        asked.ask(fulltext._Tile([batch], mean))
    follows = lambda d, a, b: any(x == a and y == b for x, y in zip(d, d[1:]))
    rarity = {t: float(np.log(1 + (6000 - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))) for t in ("w0", "w1", "w2", "w3", "w5")}
    score = lambda d: sum(rarity[t] * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in rarity if t in d)
    good = [i for i, d in enumerate(docs) if "w0" in d or "w1" in d or (follows(d, "w2", "w3") and "w4" not in d) or follows(d, "w5", "w1")]
    assert len(good) > 2000 and asked.best[1].tolist() == sorted(good, key=lambda i: (-round(score(docs[i]), 6), i))[:10]
    assert sum(seen) < 600
