import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.functions import text as tx


def apply(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f("v").alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_redaction(spark):
    cases = {
        "card 4111 1111 1111 1111.": "card [REDACTED-CARD].",
        "account 123456789012": "account [REDACTED-NUMBER]",
        "ssn 123-45-6789 ok": "ssn [REDACTED-SSN] ok",
        "iban DE89 3704 0044 0532 0130 00 end": "iban [REDACTED-IBAN] 00 end",
        "plain text stays": "plain text stays",
        "hi <@123456789012345678> there": "hi <@123456789012345678> there",
        "nick <@!123456789012345678> role <@&987654321098765432> room <#123456789012345678>": "nick <@!123456789012345678> role <@&987654321098765432> room <#123456789012345678>",
        "run 1234567890 beside <@123456789012345678>": "run [REDACTED-NUMBER] beside <@123456789012345678>",
        "4111111111111112 is no card": "[REDACTED-NUMBER] is no card",
        "routing 021000021 and account 123456789": "routing [REDACTED-NUMBER] and account [REDACTED-NUMBER]",
    }
    assert apply(spark, tx.redact_financial, cases) == list(cases.values())
    assert apply(spark, lambda c: tx.redact_financial(tx.redact_financial(c)), cases) == list(cases.values())


def test_redaction_reaches_nested_strings(spark):
    df = spark.sql("SELECT named_struct('a', array('4111111111111111'), 'b', map('k', '123-45-6789'), 'n', 5) AS x")
    x = tx.redact_deep(df, ["x"]).first()["x"]
    assert x["a"] == ["[REDACTED-CARD]"] and x["b"] == {"k": "[REDACTED-SSN]"} and x["n"] == 5


def test_html_to_text(spark):
    html = "<html><head><style>p{}</style></head><body><h1>Title</h1><p>One &amp; two</p><ul><li>a</li><li>b</li></ul><script>x()</script></body></html>"
    assert apply(spark, tx.html_to_text, [html]) == ["§§Title\n\nOne & two\n• a\n• b"]
    assert apply(spark, tx.looks_like_html, [html, "a < b", "<b>x</b> <i>y</i>", None]) == [True, False, True, False]


def test_clean_display_text(spark):
    rows = [(0, "short *note* kept"), (1, "<p></p><div></div><p></p>"), (2, None), (3, "> quoted line\nand more of **this** text"), (4, "CafÃ© and plain words here")]
    df = tx.clean_display_text(spark.createDataFrame(rows, "i int, t string"), "t")
    got = [r["clean_text"] for r in df.orderBy("i").collect()]
    assert got == ["short note kept", tx.PLACEHOLDER, tx.PLACEHOLDER, "quoted line\nand more of **this** text", "Café and plain words here"]


def test_trivial_and_quotes(spark):
    assert apply(spark, tx.is_trivial_ack, ["ok", "Thanks!", "👍🎉", "ok then we ship", "", "LGTM..", None]) == [True, True, True, False, False, True, False]
    body = "Agreed.\nOn Mon, Jan 1, Ann wrote:\n> old"
    assert apply(spark, tx.trim_quoted_reply, [body, "no quote here", "> a\n> b\n> c"]) == ["Agreed.", "no quote here", "> a\n> b\n> c"]


def test_payload_text(spark):
    mail = '{"subject":"Hi","body":"There"}'
    page = '{"properties":{"Name":{"title":[{"plain_text":"Plan"}]},"State":{"select":{"name":"Open"}}}}'
    df = spark.createDataFrame([(mail, "gmail"), (page, "notion"), ('{"content":"c"}', "slack"), ('{"x":1}', "slack")], "p string, s string")
    got = [r[0] for r in df.select(tx.payload_text("p", "s")).collect()]
    assert got[0] == "Subject: Hi\nThere" and got[2] == "c" and got[3] == '{"x":1}'
    assert set(got[1].split("\n")) == {"Name: Plan", "State: Open"}


def test_dates(spark):
    df = spark.createDataFrame([("2026-07-20 08:59:00",), ("2026-07-20 09:00:00",), ("2026-07-19 12:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert [str(r[0]) for r in df.select(scalars.digest_week("t")).collect()] == ["2026-07-13", "2026-07-20", "2026-07-13"]
    as_of = F.lit("2026-07-20 12:00:00").cast("timestamp")
    assert [r[0] for r in df.select(scalars.time_ago("t", as_of)).collect()] == ["3h ago", "3h ago", "1d ago"]
    weights = [r[0] for r in spark.createDataFrame([(0,), (14,), (-3,), (None,)], "d int").select(scalars.recency_weight(as_of - F.make_interval(days="d"), as_of)).collect()]
    assert weights == pytest.approx([2.0, 1.5, 2.0, 1.0])


def test_json_and_names(spark):
    row = spark.sql("SELECT '{\"a\":\"1\",\"b\":\"2\"}' AS x, '{\"b\":\"3\"}' AS y, 'Ann.Lee@x.org' AS mail, 'ABCDEF01-2345-6789-0000-000000000000' AS id")
    got = row.select(scalars.json_merge("x", "y"), scalars.json_without("x", "a"), scalars.workspace_slug("mail", F.lower("id"))).first()
    assert got[0] in ('{"a":"1","b":"3"}',) and got[1] == '{"b":"2"}' and got[2] == "ann-lee-abcdef01"


def test_blocks_hold_whole_texts(spark, tmp_path):
    from ledgerloom.plans import registry

    text = "We decided to keep every word of a long statement, " * 40 + "to its end."
    spark.createDataFrame([(1, text, "de", "wiki")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    block = registry.queries()["context_blocks"](spark, str(tmp_path)).first()["block"]
    assert f"\nStatement: {text}\nRationale: quality 1\n" in block
    body = registry.queries()["searchable_text"](spark, str(tmp_path)).first()["body"]
    assert body == f"Decision: {text}\nRationale: wiki"


def test_html_line_ends_come_from_tags(spark):
    cases = {
        "a\nb<br/>c</p>\n\n<p>d": "a b c d",
        "<h2>T</h2>\n<h3>U</h3>x": "§§T\n\n§§U\n\nx",
        "x<ul>\n<li>a\n<li>b</ul>y": "x\n• a\n• b y",
        "<h1>&nbsp;</h1>": "§§",
        "1 &lt; 2 &amp;&amp; &quot;q&quot; &#39;s&#39;": "1 < 2 && \"q\" 's'",
        "a<SCRIPT type=x>\nvar b;</script>c": "a c",
        "<p>one</p><h1>two</h1><li>three": "one\n\n§§two\n• three",
        "": "",
    }
    assert apply(spark, tx.html_to_text, list(cases)) == list(cases.values())


def test_pictographs_at_the_borders_of_their_ranges(spark):
    yes = ["\u00a9", "\u2702", "\u2764\ufe0f", "\U0001f44d", "\U0001f468\u200d\U0001f469", "\U0001faf8 \u2b50"]
    no = ["\u2776", "\u27bf x", "\u2701", "\u2606", "1", "#", "\u27c0", "a\u2764"]
    assert apply(spark, tx.is_trivial_ack, yes + no) == [True] * len(yes) + [False] * len(no)


def test_mentions_keep_their_digits(spark):
    rows = ["<@123456789012345678> pay 4111 1111 1111 1111 or <#987654321098765432>", "⟦Mabc⟧ 123456789", "<@123456789012345678>", "nothing 12345678"]
    assert apply(spark, tx.redact_financial, rows) == ["<@123456789012345678> pay [REDACTED-CARD]or <#987654321098765432>", "⟦Mabc⟧ [REDACTED-NUMBER]", "<@123456789012345678>", "nothing 12345678"]


def test_steps_are_searched_only_where_they_can_match(spark):
    """A long run of word characters without a brace, which the style rule would try from every place, and texts at the edge of each test."""
    rows = ["a" * 200_000, "x { y } one two three four", "a: b; one two three four", "one  two\tthree four", "\u00a0\ufeff edge of this text \x0b\f", "one two\n\n\n\nthree four", "> quoted *stars*", "12 Title of this one here", "", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    start = time.monotonic()
    got = {r["i"]: r["clean_text"] for r in tx.clean_display_text(df, "t").collect()}
    assert time.monotonic() - start < 20
    assert got[0] == rows[0] and got[1] == got[2] == "one two three four" and got[3] == "one two\tthree four"
    assert (got[4], got[5], got[6], got[7]) == ("edge of this text", "one two\n\nthree four", "quoted stars", "Title of this one here") and got[8] == got[9] == tx.PLACEHOLDER
