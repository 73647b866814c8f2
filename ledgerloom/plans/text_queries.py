"""Text cleaning, redaction and formatting on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ingest, register
from .base import query, table


def sql_text(s: str) -> str:
    """A string as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def replaced(expr: str, steps: list[tuple[str, str]]) -> str:
    """Nested replacements in the other engine's dialect."""
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, {sql_text(pattern)}, {sql_text(to)}, 'g')"
    return expr


def clean_sql(expr: str) -> str:
    """The HTML steps without the constructs that the other engine's patterns lack."""
    scripts = [(rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ") for tag in ("script", "style")]
    steps = [*scripts, *tx.BLOCKS[1:], *tx.ENTITIES, *tx.LINES]
    body = replaced(expr, steps)
    return f"regexp_replace(regexp_replace({body}, '^[\\s\\x{{00A0}}\\x{{FEFF}}]+', ''), '[\\s\\x{{00A0}}\\x{{FEFF}}]+$', '')"


@query(f"SELECT page_id, {clean_sql('html')} AS clean_text FROM pages")
def clean_pages(spark, d):
    """All pages as plain text."""
    return table(spark, d, "pages").select("page_id", tx.html_to_text("html").alias("clean_text"))


@query(f"""
SELECT page_id AS id, regexp_matches(html, {sql_text(tx.HTML_SHAPE)}) OR len(regexp_extract_all(html, {sql_text(tx.HTML_TAG)})) >= 3 AS html FROM pages
UNION ALL SELECT -doc_id - 1, regexp_matches(text, {sql_text(tx.HTML_SHAPE)}) OR len(regexp_extract_all(text, {sql_text(tx.HTML_TAG)})) >= 3 FROM documents""")
def looks_like_html(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), tx.looks_like_html("html").alias("html"))
    return pages.unionByName(table(spark, d, "documents").select((-F.col("doc_id") - 1).alias("id"), tx.looks_like_html("text").alias("html")))


def repaired_sql(c: str) -> str:
    """Latin-1 characters reread as UTF-8 where that is valid, else the text."""
    raw = f"unhex(array_to_string(list_transform(string_split({c}, ''), lambda x: printf('%02x', unicode(x))), ''))"
    return f"CASE WHEN {c} = '' OR NOT regexp_matches({c}, '^[\\t\\n\\r\\x{{20}}-\\x{{FF}}]*$') THEN {c} ELSE coalesce(TRY(decode({raw})), {c}) END"


def trimmed_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[\\s\\x{{00A0}}\\x{{FEFF}}]+', ''), '[\\s\\x{{00A0}}\\x{{FEFF}}]+$', '')"


_ARTIFACT = r"'^\d{1,3}\s+((?:• )?[A-Z])', '\1'"
#: Neighbours that share a character between them are found by the second pass.
_EMPHASIS = [(r"(^|[^*])\*([^\s*][^*\n]*?)\*([^*]|$)", r"\1\2\3")] * 2


@query(f"""
WITH t AS (SELECT page_id AS id, html AS body FROM pages UNION ALL SELECT -doc_id - 1, text FROM documents),
c0 AS (SELECT id, unnest([{repaired_sql("coalesce(body, '')")}]) AS c0 FROM t),
c1 AS (SELECT *, regexp_matches(c0, {sql_text(tx.HTML_SHAPE)}) OR len(regexp_extract_all(c0, {sql_text(tx.HTML_TAG)})) >= 3 AS html FROM c0),
c2 AS (SELECT *, unnest([CASE WHEN html THEN {clean_sql("c0")} ELSE c0 END]) AS c1 FROM c1),
c3 AS (SELECT *, unnest([{trimmed_sql(replaced("c1", tx.CSS_STEPS))}]) AS c2 FROM c2),
c4 AS (SELECT *, regexp_replace(c2, {_ARTIFACT}) AS c3 FROM c3),
c5 AS (SELECT *, unnest([{trimmed_sql(replaced("c3", [(tx.QUOTE_MARK, ""), *_EMPHASIS]))}]) AS c4 FROM c4)
SELECT id, CASE WHEN c4 = '' OR ((html OR c2 <> c1 OR c3 <> c2) AND len(list_filter(string_split_regex(c4, '\\s+'), lambda w: length(w) >= 2 AND regexp_matches(w, {sql_text(tx.READABLE_WORD)}))) < 4) THEN '{tx.PLACEHOLDER}' ELSE c4 END AS clean_text FROM c5""")
def display_text(spark, d):
    """The whole cleaning job on pages and documents."""
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("body")).unionByName(table(spark, d, "documents").select((-F.col("doc_id") - 1).alias("id"), F.col("text").alias("body")))
    return tx.clean_display_text(rows, "body").select("id", "clean_text")


@query(f"""
SELECT doc_id, text AS repaired, {trimmed_sql(replaced("'12 ' || text || ' .a { color: red } x: y; '", tx.CSS_STEPS))} AS styled, regexp_replace('12  T' || source, {_ARTIFACT}) AS headed,
  {replaced("'> ' || source || E'\n >> *' || lang || '* and **' || lang || '**'", [(tx.QUOTE_MARK, ""), *_EMPHASIS])} AS plain FROM documents""")
def text_repairs(spark, d):
    """Texts read in the wrong encoding repaired; style remnants, leading numbers, quote and emphasis marks dropped."""
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    quoted = F.concat(F.lit("> "), F.col("source"), F.lit("\n >> *"), F.col("lang"), F.lit("* and **"), F.col("lang"), F.lit("**"))
    styled = F.concat(F.lit("12 "), F.col("text"), F.lit(" .a { color: red } x: y; "))
    return table(spark, d, "documents").select("doc_id", tx.repair_mojibake(wrong).alias("repaired"), tx.strip_css(styled).alias("styled"), tx.strip_artifact(F.concat(F.lit("12  T"), F.col("source"))).alias("headed"), tx.strip_plain_marks(quoted).alias("plain"))


@query(r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat, lang, source FROM documents)
SELECT doc_id, CASE WHEN length(flat) > 80 THEN rtrim(left(flat, 80)) || '…' ELSE flat END AS excerpt, E'Source: ' || lang || E'\nActor: unknown\nThread: ' || source || E'\nScope: ["' || lang || E'"]\nContent: body' AS described FROM t""")
def event_descriptions(spark, d):
    """Excerpts of texts, and events as a model reads them."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("source"), F.lit(None).cast("string").alias("actor"), F.col("source").alias("thread_ref"), F.array("lang").alias("permission_scope"), F.lit("body").alias("raw_content"))
    return rows.select("doc_id", tx.excerpt("text", 80).alias("excerpt"), tx.model_input(rows).alias("described"))


_DIGITS = "regexp_replace(m, '[ -]', '', 'g')"
_CARD = r"'\b(?:\d[ -]?){13,19}\b'"
_LUHN = f"""len({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN substring({_DIGITS}, len({_DIGITS}) - i + 1, 1)::INT
       WHEN substring({_DIGITS}, len({_DIGITS}) - i + 1, 1)::INT > 4 THEN 2 * substring({_DIGITS}, len({_DIGITS}) - i + 1, 1)::INT - 9
       ELSE 2 * substring({_DIGITS}, len({_DIGITS}) - i + 1, 1)::INT END)) % 10 = 0"""


@query(rf"""
WITH c AS (SELECT doc_id, string_split_regex(text, {_CARD}) AS parts, list_transform(regexp_extract_all(text, {_CARD}), lambda m: CASE WHEN {_LUHN} THEN '[REDACTED-CARD]' ELSE m END) AS cards FROM documents),
t AS (SELECT doc_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda j: parts[j] || coalesce(cards[j], '')), '') AS body FROM c)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(body, '\b[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}\b', '[REDACTED-IBAN]', 'g'), '\b\d{{3}}-\d{{2}}-\d{{4}}\b', '[REDACTED-SSN]', 'g'), '\b\d{{9,}}\b', '[REDACTED-NUMBER]', 'g') AS redacted FROM t""")
def redact_documents(spark, d):
    """Financial numbers in documents."""
    return table(spark, d, "documents").select("doc_id", tx.redact_financial("text").alias("redacted"))


@query(rf"""
WITH w AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' 4111 1111 1111 1111' ELSE text END AS text, lang, source FROM documents),
c AS (SELECT doc_id, lang, source, string_split_regex(text, {_CARD}) AS parts, list_transform(regexp_extract_all(text, {_CARD}), lambda m: CASE WHEN {_LUHN} THEN '[REDACTED-CARD]' ELSE m END) AS cards FROM w),
t AS (SELECT doc_id, lang, source, array_to_string(list_transform(range(1, len(parts) + 1), lambda j: parts[j] || coalesce(cards[j], '')), '') AS body FROM c),
r AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(body, '\b[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}\b', '[REDACTED-IBAN]', 'g'), '\b\d{{3}}-\d{{2}}-\d{{4}}\b', '[REDACTED-SSN]', 'g'), '\b\d{{9,}}\b', '[REDACTED-NUMBER]', 'g') AS body_ FROM t)
SELECT doc_id, md5(body_) AS statement, CASE WHEN doc_id % 2 = 0 THEN lang || ' [REDACTED-SSN]' END AS rationale, source || '|[REDACTED-NUMBER]' AS alternatives FROM r""")
def redacted_extractions(spark, d):
    """Statement, rationale and alternatives of extracted decisions."""
    n = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        "doc_id",
        F.when(n % 3 == 0, F.concat("text", F.lit(" 4111 1111 1111 1111"))).otherwise(F.col("text")).alias("decision_statement"),
        F.when(n % 2 == 0, F.concat("lang", F.lit(" 078-05-1120"))).alias("rationale"),
        F.array(F.col("source"), F.lit("123456789012")).alias("alternatives_considered"),
    )
    out = ingest.redact_extractions(rows)
    return out.select("doc_id", F.md5("decision_statement").alias("statement"), "rationale", F.array_join("alternatives_considered", "|").alias("alternatives"))


@query("SELECT doc_id, '{\"n\":123456789012,\"k\":\"[REDACTED-CARD]' || lang || '\",\"in\":[\"<@123456789012345678> [REDACTED-NUMBER]\",5]}' AS raw, '[REDACTED-SSN]|ok|[REDACTED-IBAN]' AS deep FROM documents")
def redact_nested(spark, d):
    """Strings inside JSON texts, arrays, structs and maps; numbers, keys and mentions stay."""
    raw = F.concat(F.lit('{"n":123456789012,"k":"4111-1111-1111-1111 '), F.col("lang"), F.lit('","in":["<@123456789012345678> 123456789",5]}'))
    deep = F.struct(F.array(F.lit("078-05-1120"), F.lit("ok")).alias("a"), F.create_map(F.lit("k"), F.lit("DE89 3704 0044 0532 0130")).alias("m"))
    out = tx.redact_deep(table(spark, d, "documents").select("doc_id", tx.redact_json(raw).alias("raw"), deep.alias("deep")), ["deep"])
    return out.select("doc_id", "raw", F.array_join(F.concat("deep.a", F.map_values("deep.m")), "|").alias("deep"))


@query(f"""
SELECT conv_id, turn, trim(text) <> '' AND (trim(regexp_replace(lower(trim(text)), '[!.?]+$', '')) IN ({", ".join(map(sql_text, tx.ACKS))}) OR regexp_matches(trim(text), {sql_text(tx.PICTOGRAPHS)})) AS trivial FROM conversations""")
def trivial_prefilter(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.is_trivial_ack("text").alias("trivial"))


@query(f"""
WITH c AS (SELECT doc_id, text, least({", ".join(f"CASE WHEN regexp_matches(text, {sql_text(p)}) THEN length(string_split_regex(text, {sql_text(p)})[1]) END" for p in tx.QUOTE_STARTS)}) AS cut FROM documents)
SELECT doc_id, CASE WHEN cut IS NULL OR trim(regexp_replace(left(text, cut), '\\s+', '', 'g')) = '' THEN length(text) ELSE length(regexp_replace(trim(left(text, cut)), '\\s+$', '')) END::BIGINT AS n_left FROM c""")
def trim_quotes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(tx.trim_quoted_reply("text")).cast("long").alias("n_left"))


@query("""
SELECT d.doc_id, repeat('-', 50) || E'\\nDecision ' || (d.doc_id + 1) || E'\\nStatement: ' || d.text || E'\\nRationale: ' || coalesce('quality ' || l.quality, 'Not provided')
  || E'\\nAlternatives: ' || CASE WHEN d.lang = 'en' THEN 'None' ELSE d.lang || ', ' || d.source END || E'\\nConfidence: ' || floor(coalesce(l.quality, 0) * 0.945 * 100 + 0.5)::BIGINT || '%' || E'\\n' || repeat('-', 50) AS block,
  floor(length(d.text) / 4)::BIGINT AS tokens FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def context_blocks(spark, d):
    """Each document as a decision's text block, and its estimated tokens."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = rows.withColumns({
        "decision_statement": F.col("text"),
        "rationale": F.concat(F.lit("quality "), F.col("quality").cast("string")),
        "alternatives_considered": F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array("lang", "source")),
        "confidence": F.coalesce("quality", F.lit(0)) * 0.945,
    })
    return rows.select("doc_id", register.context_block(F.col("doc_id") + 1).alias("block"), tx.token_estimate("text").alias("tokens"))


@query("SELECT doc_id, 'Decision: ' || text || CASE WHEN lang = 'fr' THEN '' ELSE E'\\nRationale: ' || source END || CASE WHEN lang = 'en' THEN E'\\nAlternatives considered: ' || lang || ', ' || source ELSE '' END AS body FROM documents")
def searchable_text(spark, d):
    rationale = F.when(F.col("lang") != "fr", F.col("source"))
    options = F.when(F.col("lang") == "en", F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", tx.searchable_text(F.col("text"), rationale, options).alias("body"))


@query("SELECT event_id, 'k=' || json_extract_string(props, '$.k') AS body FROM events")
def payload_fields(spark, d):
    """The text of JSON payloads, here under a usual field name."""
    payload = F.concat(F.lit('{"id":1,"body":"k='), F.get_json_object("props", "$.k"), F.lit('"}'))
    return table(spark, d, "events").select("event_id", tx.payload_text(payload, F.lit("slack")).alias("body"))
