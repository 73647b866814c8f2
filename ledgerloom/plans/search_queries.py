"""Vectors, full text, fusion and duplicates on the driver's tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import fulltext, fusion, register, similarity
from ..session import shared_folder, written
from .base import query, table
from .report_queries import AS_OF

SIZE = 64
#: All pairs of one label at the floor or above.
PAIRS = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id)
"""


def pairs(spark, d, floor):
    return similarity.similar_pairs(table(spark, d, "embeddings"), floor, SIZE, ["label"])


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS s FROM v q, v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 10""")
def vector_topk(spark, d):
    v = similarity.check_dimension(table(spark, d, "embeddings"), SIZE)
    out = similarity.vector_topk(v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), v, 10, SIZE)
    return out.withColumn("similarity", F.round("similarity", 6))


@query(PAIRS + "SELECT a AS older, b AS newer, round(s, 6) AS similarity FROM p WHERE s >= 0.3")
def near_duplicates(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return similarity.near_duplicate_pairs(v, 0.3, SIZE, ["label"], "id", "id").withColumn("similarity", F.round("similarity", 6))


@query(PAIRS + """, k AS (SELECT * FROM p WHERE s >= 0.35)
SELECT a AS id, b AS other_id, round(s, 6) AS confidence, v.label AS other_statement FROM k JOIN v ON v.vec_id = b
UNION ALL SELECT b, a, round(s, 6), v.label FROM k JOIN v ON v.vec_id = a""")
def conflict_sides(spark, d):
    found = pairs(spark, d, 0.35).select(F.col("a").alias("decision_id"), F.col("b").alias("related_decision_id"), F.lit("t").alias("tenant_id"), F.lit("contradicts").alias("relationship"), F.lit("").alias("reason"), F.round("similarity", 6).alias("confidence"))
    decisions = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("t").alias("tenant_id"), F.col("label").alias("decision_statement"))
    return register.conflicts_of(found, decisions).select("id", "other_id", "confidence", "other_statement")


@query(PAIRS + """, sides AS (SELECT a AS id, b AS other_id, s FROM p WHERE s >= 0.3 UNION ALL SELECT b, a, s FROM p WHERE s >= 0.3),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other_id) AS rank FROM sides)
SELECT id, other_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 3""")
def conflict_candidates(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return similarity.conflict_candidates(v, 0.3, 3, SIZE, ["label"]).withColumn("similarity", F.round("similarity", 6))


MARKED = PAIRS + """, m AS (SELECT v.vec_id AS id, (SELECT b FROM p WHERE p.a = v.vec_id AND s >= 0.3 ORDER BY s DESC, b LIMIT 1) AS superseded_by FROM v)
"""


def marked(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(None).cast("long").alias("superseded_by"))
    found = pairs(spark, d, 0.3).select(F.col("a").alias("older"), F.col("b").alias("newer"), "similarity")
    return similarity.mark_superseded(v, found)


@query(MARKED + "SELECT * FROM m")
def mark_superseded(spark, d):
    return marked(spark, d)


@query(MARKED + "SELECT * FROM m WHERE superseded_by IS NULL OR id IN (SELECT superseded_by FROM m WHERE superseded_by IS NOT NULL)")
def supersede_leaves(spark, d):
    return similarity.purge_supersede_leaves(marked(spark, d))


@query(PAIRS + "SELECT a AS older, b AS newer, round(s, 4) AS similarity, (SELECT count(*) FROM p WHERE s >= 0.3) AS total FROM p WHERE s >= 0.3 ORDER BY s DESC, a, b LIMIT 30")
def near_dup_report(spark, d):
    return similarity.near_dup_pair_report(pairs(spark, d, 0.3).select(F.col("a").alias("older"), F.col("b").alias("newer"), "similarity"))


WORDS = r"""
WITH t AS (SELECT doc_id, lang, source, text, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT *, len(w) AS dl, ' ' || array_to_string(w, ' ') || ' ' AS body FROM t)"""


def bm25_sql(terms: list[str], where: str) -> str:
    words = ", ".join(f"'{t}'" for t in terms)
    return f"""{WORDS},
n AS (SELECT count(*) AS n, avg(dl) AS mean FROM b),
p AS (SELECT doc_id, dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM b, (SELECT unnest([{words}]) AS term)),
f AS (SELECT term, count(*) AS df FROM p WHERE tf > 0 GROUP BY 1),
s AS (SELECT p.doc_id, sum(ln(1 + (n.n - f.df + 0.5) / (f.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / n.mean))) AS score
  FROM p JOIN f ON f.term = p.term, n WHERE tf > 0 AND p.doc_id IN (SELECT doc_id FROM b WHERE {where}) GROUP BY 1),
r AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
SELECT doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 50"""


@query(bm25_sql(["that", "with", "edble"], "contains(body, ' that ') AND contains(body, ' with ') AND contains(body, ' edble ')"))
def search_plain(spark, d):
    return fulltext.search_plain(table(spark, d, "documents"), "That with edble!", 50).withColumn("score", F.round("score", 6))


@query(bm25_sql(["edble", "of", "the", "worthless"], "(contains(body, ' edble ') AND contains(body, ' of the ') AND NOT contains(body, ' idiot ')) OR contains(body, ' worthless ')"))
def search_web(spark, d):
    return fulltext.search_web(table(spark, d, "documents"), 'edble "of the" -idiot OR worthless', 50).withColumn("score", F.round("score", 6))


def word_index(spark, d, **options):
    """An index of all documents in the shared folder."""
    return fulltext.write_index(table(spark, d, "documents"), f"{shared_folder(spark)}/index-{uuid4().hex}", **options)


def questions(spark, d):
    """A question for each twentieth vector, made of words of its document: two alternatives, a phrase, a banned word; its language is the tenant."""
    v = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    docs = table(spark, d, "documents").withColumn("w", fulltext.tokens(F.col("text")))
    word = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    asked = F.concat(F.lit('"'), word(1), F.lit('" OR "'), word(3), F.lit(" "), word(4), F.lit('" -'), word(6))
    docs = docs.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("tenant_id"), asked.alias("query"), F.array(word(1)).alias("entities"), F.array(F.lit("src1"), F.lit("src2"), F.lit("src3"), F.lit("src7")).alias("scopes"))
    return v.join(docs, "query_id")


#: The same questions, and their documents by score; {scope} is the language or nothing.
def asked_sql(scoped: bool, k: int) -> str:
    same = "b.lang = q.lang" if scoped else "TRUE"
    size = "lang, count(*) AS n, avg(dl) AS mean FROM b GROUP BY 1" if scoped else "count(*) AS n, avg(dl) AS mean FROM b"
    return f"""{WORDS},
q AS (SELECT v.vec_id AS query_id, v.embedding, t.lang, coalesce(t.w[2], '') AS a, trim(coalesce(t.w[4], '') || ' ' || coalesce(t.w[5], '')) AS p, coalesce(t.w[7], '') AS c FROM embeddings v JOIN t ON t.doc_id = v.vec_id WHERE v.vec_id % 20 = 0),
n AS (SELECT {size}),
terms AS (SELECT DISTINCT query_id, lang, term FROM (SELECT query_id, lang, a AS term FROM q UNION ALL SELECT query_id, lang, unnest(string_split(p, ' ')) FROM q) WHERE term <> ''),
own AS (SELECT DISTINCT {"lang, " if scoped else ""}term FROM terms),
tf AS (SELECT b.doc_id, b.lang, b.dl, u.term, count(*) AS tf FROM b, unnest(b.w) AS u(term) WHERE u.term IN (SELECT term FROM own) GROUP BY ALL),
df AS (SELECT {"lang, " if scoped else ""}term, count(*) AS df FROM tf GROUP BY ALL),
hit AS (SELECT q.query_id, b.doc_id FROM q JOIN b ON {same} WHERE (q.a <> '' AND contains(b.body, ' ' || q.a || ' ')) OR (q.p <> '' AND contains(b.body, ' ' || q.p || ' ') AND (q.c = '' OR NOT contains(b.body, ' ' || q.c || ' ')))),
s AS (SELECT h.query_id, h.doc_id, sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / n.mean))) AS score
  FROM hit h JOIN terms t ON t.query_id = h.query_id JOIN tf ON tf.doc_id = h.doc_id AND tf.term = t.term JOIN df ON df.term = t.term {"AND df.lang = tf.lang JOIN n ON n.lang = tf.lang" if scoped else "CROSS JOIN n"} GROUP BY 1, 2),
found AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s QUALIFY rank <= {k})
"""


@query(asked_sql(False, 40) + "SELECT * FROM found")
def search_questions_web(spark, d):
    """R2, R4 for a table of questions: alternatives, phrases and banned words against a written index, in one plan."""
    return fulltext.search_many(questions(spark, d), word_index(spark, d), 40).withColumn("score", F.round("score", 6))


@query(asked_sql(True, 20) + """
, sem AS (SELECT q.query_id, v.vec_id AS doc_id, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) DESC, v.vec_id) AS rank
  FROM q JOIN b ON b.lang = q.lang JOIN embeddings v ON v.vec_id = b.doc_id QUALIFY rank <= 20),
modes AS (SELECT unnest(['semantic_only', 'keyword_only', 'hybrid_rrf']) AS mode),
l AS (SELECT mode, query_id, 'a_semantic' AS list, doc_id, rank FROM sem, modes WHERE mode <> 'keyword_only' UNION ALL SELECT mode, query_id, 'b_keyword', doc_id, rank FROM found, modes WHERE mode <> 'semantic_only'),
f AS (SELECT mode, query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list, rank)) AS first FROM l GROUP BY ALL),
o AS (SELECT mode, query_id, doc_id, row_number() OVER (PARTITION BY mode, query_id ORDER BY round(score, 12) DESC, first, doc_id) AS position FROM f QUALIFY position <= 20),
v AS (SELECT o.*, b.text, q.a, CASE WHEN o.query_id % 40 = 0 THEN ((doc_id * 31 + o.query_id) % 100) / 100.0 + CASE WHEN q.a <> '' AND contains(lower(b.text), q.a) THEN 0.5 ELSE 0 END END AS final_score
  FROM o JOIN b USING (doc_id) JOIN q ON q.query_id = o.query_id WHERE b.source IN ('src1', 'src2', 'src3', 'src7')),
r AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY final_score DESC NULLS LAST, position, doc_id) AS place FROM v QUALIFY place <= 7),
x AS (SELECT mode, query_id, count(*) AS final, string_agg(doc_id::VARCHAR, '|' ORDER BY place) AS ids, string_agg(repeat('-', 50) || E'\\nDecision ' || place || E'\\nStatement: ' || text || E'\\nRationale: Not provided\\nAlternatives: None\\nConfidence: 50%\\n' || repeat('-', 50), E'\\n\\n' ORDER BY place) AS context FROM r GROUP BY ALL)
SELECT m.mode, q.query_id, (SELECT count(*) FROM o WHERE o.mode = m.mode AND o.query_id = q.query_id) AS retrieved, (SELECT count(*) FROM v WHERE v.mode = m.mode AND v.query_id = q.query_id) AS authorized,
  coalesce(x.final, 0) AS final, coalesce(x.ids, '') AS ids, md5(coalesce(x.context, '')) AS context_md5, coalesce(floor(length(x.context) / 4)::BIGINT, 0) AS tokens
FROM q CROSS JOIN modes m LEFT JOIN x ON x.mode = m.mode AND x.query_id = q.query_id""")
def search_questions(spark, d):
    """From questions to answers in each mode: R1 and R4, fusion, permissions, rerank, cut, context text and counts."""
    docs = table(spark, d, "documents")
    asked, index = written(questions(spark, d), "questions"), word_index(spark, d, scope="lang")
    vectors = table(spark, d, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("tenant_id")), "vec_id").withColumnRenamed("vec_id", "id")
    decisions = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("decision_statement"), F.lit(None).cast("string").alias("rationale"), F.array().cast("array<string>").alias("alternatives_considered"), F.lit(0.5).alias("confidence"), F.array("source").alias("permission_scope"))
    score = ((F.col("decision_id") * 31 + F.col("query_id")) % 100 / 100.0).alias("score")
    scores = lambda pairs: pairs.where("query_id % 40 = 0").select("query_id", "decision_id", score)
    out = fusion.search_modes(asked, decisions, vectors, index, SIZE, top_k=5, scores=scores)
    ids = F.array_join(F.transform("decision_ids", lambda x: x.cast("string")), "|")
    return out.select("mode", "query_id", "retrieved", "authorized", "final", F.coalesce(ids, F.lit("")).alias("ids"), F.md5(F.coalesce("context", F.lit(""))).alias("context_md5"), "tokens")


#: Two rankings of each language's documents: by size, and by how often e occurs.
RANKED = """
WITH l AS (SELECT lang AS query_id, 'a' AS list, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents
  UNION ALL SELECT lang, 'b', doc_id, row_number() OVER (PARTITION BY lang ORDER BY length(text) - length(replace(text, 'e', '')) DESC, doc_id) FROM documents),
f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list, rank)) AS first FROM l GROUP BY 1, 2),
o AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, doc_id) AS position FROM f)
"""


def ranked(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("query_id"), "doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit("e")))).alias("e"))
    parts = [fusion.rank_positions(docs.withColumn("list", F.lit(name)), [F.desc(c), F.asc("doc_id")]) for name, c in (("a", "n_chars"), ("b", "e"))]
    return parts[0].unionByName(parts[1]).select("query_id", "list", "doc_id", "rank")


@query(RANKED + "SELECT query_id, doc_id, round(score, 9) AS score, position FROM o")
def rrf(spark, d):
    return fusion.rrf(ranked(spark, d), item="doc_id").withColumn("score", F.round("score", 9))


@query(RANKED + f"""
, c AS (SELECT doc_id, TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * (doc_id % 45) AS created_at FROM documents),
w AS (SELECT o.query_id, o.doc_id, o.position, o.score * (1 + pow(0.5, (doc_id % 45) / 14.0)) AS score FROM o)
SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, position, doc_id) AS position FROM w""")
def rrf_recent(spark, d):
    at = F.lit(AS_OF).cast("timestamp")
    created = table(spark, d, "documents").select("doc_id", (at - F.make_interval(days=(F.col("doc_id") % 45).cast("int"))).alias("created_at"))
    return fusion.rrf_recent(ranked(spark, d), created, at, item="doc_id").withColumn("score", F.round("score", 9))


@query(RANKED + """
, s AS (SELECT o.query_id, o.doc_id, o.position AS rank, (d.n_chars % 100) / 100.0 + CASE WHEN contains(lower(d.text), 'edble') THEN 0.5 ELSE 0 END AS final_score
  FROM o JOIN documents d ON d.doc_id = o.doc_id WHERE o.position <= 40),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank, doc_id) AS position FROM s)
SELECT query_id, doc_id, round(final_score, 6) AS final_score, position FROM r WHERE position <= 20""")
def entity_rerank(spark, d):
    """The 40 best of each language reranked to 20."""
    top = fusion.rrf(ranked(spark, d), top_k=40, item="doc_id").select("query_id", "doc_id", F.col("position").alias("rank"))
    docs = table(spark, d, "documents")
    candidates = top.join(docs.select("doc_id", "text"), "doc_id")
    scores = docs.select(F.col("lang").alias("query_id"), "doc_id", (F.col("n_chars") % 100 / 100.0).alias("score"))
    entities = docs.select(F.col("lang").alias("query_id")).distinct().withColumn("entities", F.array(F.lit("edble")))
    out = fusion.entity_boost_rerank(candidates, scores, entities, 20, "doc_id")
    return out.select("query_id", "doc_id", F.round("final_score", 6).alias("final_score"), "position")


@query(RANKED + """
, c AS (SELECT o.query_id, o.doc_id, o.position, d.source FROM o JOIN documents d ON d.doc_id = o.doc_id WHERE o.position <= 20),
v AS (SELECT * FROM c WHERE source IN ('src1', 'src2', 'src3', 'src4', 'src5'))
SELECT query_id, doc_id, position AS rank, row_number() OVER (PARTITION BY query_id ORDER BY position) AS position FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= 7""")
def overfetch(spark, d):
    """L3: the 20 candidates of each language, permissions, then the answer."""
    top = fusion.rrf(ranked(spark, d), item="doc_id").select("query_id", "doc_id", F.col("position").alias("rank"))
    rows = top.join(table(spark, d, "documents").select("doc_id", F.array("source").alias("permission_scope")), "doc_id")
    return fusion.overfetch(rows, ["src1", "src2", "src3", "src4", "src5"], 5).select("query_id", "doc_id", "rank", "position")


@query(RANKED + """
SELECT query_id, doc_id, position FROM o WHERE (position IN (1, 3, 5) AND query_id <> 'fr') OR (position IN (1, 2) AND query_id = 'fr')""")
def citations(spark, d):
    """Cited positions of each language resolved; numbers out of range go."""
    matches = fusion.rrf(ranked(spark, d), item="doc_id")
    langs = table(spark, d, "documents").select(F.col("lang").alias("query_id")).distinct()
    answers = langs.withColumn("citations", F.when(F.col("query_id") == "fr", F.array(F.lit(1), F.lit(2), F.lit(-4))).otherwise(F.array(F.lit(1), F.lit(3), F.lit(5), F.lit(3), F.lit(99_999_999))))
    return fusion.resolve_citations(answers, matches, "doc_id").select("query_id", "doc_id", "position")


@query("""
SELECT doc_id, first_source FROM (SELECT doc_id, source AS first_source, row_number() OVER (PARTITION BY lang, n_chars ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def first_per_key(spark, d):
    """The first document of each language and length."""
    return fusion.first_per_key(table(spark, d, "documents"), ["lang", "n_chars"], "doc_id").select("doc_id", F.col("source").alias("first_source"))


