"""Trees with cycles, redirect chains, merges, agreement, vectors, text functions and the job stream on small fixtures."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from silexa.functions import passages as P
from silexa.functions import text as X
from silexa.operators import changes as D
from silexa.operators import claims as C
from silexa.operators import documents as A
from silexa.operators import quotes, tree, vector
from silexa.sources import feeds
from silexa.streaming import backlog


def test_closure_skips_archived_topics_and_ends_on_cycles(spark):
    topics = spark.createDataFrame([("a", None, "active"), ("b", "a", "active"), ("c", "b", "active"), ("d", "a", "archived"), ("e", "d", "active"), ("x", "y", "active"), ("y", "x", "active")], "topic_id string, parent_id string, status string")
    found = {(r[0], r[1]): r[2] for r in tree.closure(topics).collect()}
    assert {k: v for k, v in found.items() if k[0] == "a"} == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2}
    assert found[("d", "e")] == 1 and {k[1] for k in found if k[0] == "x"} == {"x", "y"}


def test_closure_has_no_depth_limit_and_starts_at_given_roots(spark):
    chain = spark.range(40).select(F.col("id").cast("string").alias("topic_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"), F.lit("active").alias("status"))
    found = tree.closure(chain, chain.filter("topic_id IN ('0', '35')")).collect()
    assert {(r["root_id"], r["depth"]) for r in found} == {("0", d) for d in range(40)} | {("35", d) for d in range(5)}


def test_moves_that_close_a_loop(spark):
    topics = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None), ("x", "y"), ("y", "x"), ("z", "x")], "topic_id string, parent_id string")
    cases = {("a", "a"): True, ("a", "b"): True, ("a", "c"): True, ("c", "a"): False, ("b", "d"): False, ("d", "c"): False, ("a", None): False, ("a", "none"): False, ("a", "x"): True, ("a", "z"): True}
    moves = spark.createDataFrame(list(cases), "topic_id string, new_parent_id string")
    assert {(r[0], r[1]): r[2] for r in tree.makes_cycle(topics, moves).collect()} == cases


def test_redirects_end_at_active_claims_or_nowhere(spark):
    claims = spark.createDataFrame([(1, None, "active"), (2, 1, "merged"), (3, 2, "merged"), (4, 5, "merged"), (5, 4, "merged"), (6, 99, "merged"), (7, None, "merged")], "claim_id long, merged_into long, status string")
    found = {r["claim_id"]: r["target_id"] for r in tree.resolve_redirects(claims).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: None, 5: None, 6: None, 7: None}


def test_merged_members_count_as_human_and_stay_once(spark):
    members = spark.createDataFrame([(1, "i1", "seed"), (2, "i1", "auto"), (2, "i2", "seed"), (6, "i3", "seed")], "claim_id long, insight_id string, matched_by string")
    redirects = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (6, None, 1)], "claim_id long, target_id long, hops int")
    found = sorted((r["claim_id"], r["insight_id"], r["matched_by"]) for r in C.merge_claims(members, redirects).collect())
    assert found == [(1, "i1", "seed"), (1, "i2", "human")]


def test_kappa(spark):
    def value(rows):
        return C.kappa(spark.createDataFrame(rows, "a string, b string")).first()["kappa"]

    assert value([("x", "x"), ("y", "y")]) == 1 and value([("x", "x")] * 3) == 1
    assert value([("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")]) == 0
    assert value([("x", "y"), ("y", "x")]) == -1


def test_scores_of_unrated_and_undated_claims(spark):
    claims = spark.createDataFrame([(1, None, None, None), (2, 3, "High", "RCT")], "claim_id long, importance int, actionability string, evidence string")
    members = spark.createDataFrame([(2, 1), (2, 2), (2, 2)], "claim_id long, source_id long")
    sources = spark.createDataFrame([(1, None), (2, "2001-01-01 00:00:00")], "source_id long, date string").withColumn("date", F.to_timestamp("date"))
    found = {r["claim_id"]: r["score"] for r in C.scored(claims, members, sources, "2001-01-01").collect()}
    assert found == {1: 33.0, 2: 30 + 15 + 12 + 4 + 8.0}


def test_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<float>")
    assert [(r["vec_id"], r["similarity"]) for r in vector.match(vectors, queries, 0.5, 8).collect()] == [(2, 0.6)]


def test_queries_come_in_blocks(spark, monkeypatch):
    vectors = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).cast("array<float>").alias("embedding"))
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    one = sorted(map(tuple, vector.match(vectors, queries, 0.5, 3).collect()))
    monkeypatch.setattr(vector, "BLOCK_BYTES", 7 * 3 * 8)
    assert sorted(map(tuple, vector.match(vectors, queries, 0.5, 3).collect())) == one and len(one) > 60


def test_books_and_feeds_in_files(spark, tmp_path):
    from silexa.sources import files

    files.register(spark)
    chapters = spark.createDataFrame([(1, 0, "<h1>Preface</h1>"), (1, 1, "<p>One &amp; all</p>"), (2, 0, ""), (3, 0, None)], "book long, pos int, html string")
    read = lambda kind, path, **how: sorted((r["path"].rsplit("/", 1)[1], *r[1:]) for r in spark.read.format(kind).options(**how).load(path).collect())
    assert read("silexa_book", files.write_files(files.as_books(chapters), "books")) == [("1.epub", 0, "<h1>Preface</h1>", None), ("1.epub", 1, "<p>One &amp; all</p>", None), ("2.epub", 0, "", None), ("3.epub", 0, "", None)]
    when, long = "2024-02-29 23:59:59", " <p>x\r\n&amp;]]></p> " * 30_000
    items = spark.createDataFrame([(f, p, f'http://a.org/?p={p}&q="{f}"', f"<T> & {p}", when, long) for f in range(2) for p in range(3)] + [(1, 9, None, "t", when, ""), (1, 8, "http://a.org", "", when, "")], "feed long, pos int, link string, title string, published string, description string")
    folder = files.write_files(files.as_feeds(items.withColumn("published", F.col("published").cast("timestamp")), F.col("feed") == 0), "feeds")
    assert read("silexa_feed", folder) == [(f"{f}.xml", p, f'http://a.org/?p={p}&q="{f}"', f"<T> & {p}", None, "2024-02-29", long, None) for f in range(2) for p in range(3)]
    assert len(read("silexa_feed", folder + "/0.xml")) == 3


def test_damaged_and_foreign_feeds(spark, tmp_path):
    from silexa.sources import files

    files.register(spark)
    (tmp_path / "a.xml").write_text('<feed xmlns:yt="y"><entry><yt:videoId>v1</yt:videoId><title><![CDATA[One & two]]></title><published>2024-05-06T07:08:09Z</published></entry><entry><title>no id</title></entry><entry><title>cut')
    (tmp_path / "b.xml").write_text("<rss><channel><title>Site</title><item><title> Two </title><link>\nhttp://x.org/2\n</link><pubDate>Wed, 01 Jan 2025 00:30:00 +0200</pubDate></item><item><title>Three</title><link>http://x.org/3</link><pubDate>some day</pubDate></item></channel></rss>")
    (tmp_path / "_c.xml").write_text("hidden")
    (tmp_path / "empty").mkdir()
    rows = spark.read.format("silexa_feed").load(f"file://{tmp_path}").orderBy("path", "pos").collect()
    assert [(r["pos"], r["link"], r["title"], r["video_id"], r["published"], r["error"] is None) for r in rows] == [
        (0, None, "One & two", "v1", "2024-05-06", True), (1, None, None, None, None, False), (0, "http://x.org/2", "Two", None, "2024-12-31", True), (1, "http://x.org/3", "Three", None, None, True),
    ]
    with pytest.raises(Exception, match="no element found|unclosed"):
        spark.read.format("silexa_feed").option("mode", "FAILFAST").load(f"file://{tmp_path}").collect()
    assert spark.read.format("silexa_feed").load(f"file://{tmp_path}/empty").count() == 0
    (tmp_path / "empty" / "x.epub").write_bytes(b"no book")
    assert [(r["pos"], r["html"], r["error"] is None) for r in spark.read.format("silexa_book").load(f"file://{tmp_path}/empty").collect()] == [(0, None, False)]


def test_chunks():
    assert P.chunks("") == [] and P.chunks("short text") == ["short text"]
    words = " ".join(f"word{i}" for i in range(400))
    parts = P.chunks(words, 200, 40)
    assert all(len(p) <= 200 for p in parts) and len(parts) > 10
    assert all(any(a.endswith(b[:k]) for k in range(20, 60)) for a, b in zip(parts, parts[1:], strict=False))
    paragraphs = "\n\n".join(f"paragraph {i} " + "x" * 40 for i in range(12))
    packed = P.chunks(paragraphs, 200, 20)
    assert len(packed) > 2 and all(f"paragraph {i} " in "".join(packed) for i in range(12)) and max(map(len, packed)) <= 222
    assert P.chunks("a" * 500 + "\n\n" + "tail", 200, 20)[-1] == "tail"


def test_chunks_are_those_of_a_plain_version():
    """Against one that walks the text: passages end behind the last stop of their last 300 characters, unless that is within the first 51 of these."""
    import random

    def walked(text, size, overlap):
        out, start = [], 0
        while start < len(text):
            end = min(start + size, len(text))
            low = max(start, end - P.SEARCH)
            stops = [k for k in range(low, end) if text[k] in " .!?\n"]
            if end < len(text) and stops and stops[-1] - low > P.LEAST_CUT:
                end = stops[-1] + 1
            out += [text[start:end].strip()] * bool(text[start:end].strip())
            start = len(text) if end == len(text) else max(end - overlap, start) if end - overlap > start else end
        return out

    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab .") * rng.choice([1, 1, 4]) for _ in range(rng.randint(0, 700)))
        size, overlap = rng.choice([60, 130, 400]), rng.choice([1, 20, 50])
        assert P.cut(text, size, overlap) == walked(text, size, overlap)


@pytest.mark.parametrize(
    ("content", "quote", "want"),
    [
        ("The quick brown fox", "quick brown", ("quick brown", 4, 15)), ("abc", None, None), ("abc", "  ", None), ("abc", "xyz", None), ("it\u2019s \u201cfine\u201d", "it's \"fine\"", ("it's \"fine\"", 0, 11)),
        ("a  b\n c", "a b c", ("a b c", 0, 7)), ("one two three four five", "one two ... four five", ("one two ... four five", 0, 23)), ("one two three", "one two ... nine", None),
        ("x the long beginning of a sentence that goes on and on y", "the long beginning of a sentence that goes on but not so", ("the long beginning of a sentence that goes on", 2, 47)),
    ],
)
def test_quotes_are_found_where_they_stand(content, quote, want):
    assert P.resolve(content, quote) == want


def test_marked_stretches_go_where_their_anchors_are_clear():
    text = "welcome to the show " + "real content here " * 15 + "this is brought to you by nobody and that was it " + "more content " * 5
    cut = P.without_marked(text, [("this is brought to you", "and that was it"), ("short", "x"), ("real content here", ""), ("not in the text at all", "")])
    assert "brought" not in cut and "more content" in cut and cut.count("real content") == 15 and "  " not in cut
    assert P.without_marked("tiny welcome to the show", [("welcome to the show", "")]) == "tiny welcome to the show"
    assert P.without_marked(text, [("this is brought to you", "welcome to the show")]) == text


def test_marked_stretches_go_without_python(spark):
    """Against the plain form, one text at a time: several stretches, some over each other, with blanks of all kinds; no worker of Python's holds a text."""
    import random

    from test_catalog import SF

    from silexa import catalog

    rng = random.Random(5)
    words = ["opening of the show", "and that was the end", "brought to you by é名前 people", "a b", " \t ", "\n", "\u3000", "\x1c", "\xa0 ", "plain words of no meaning", "🙂 more of it"]
    pick = lambda n: "".join(rng.choice(words) + rng.choice(["", " ", f"{rng.random()}"]) for _ in range(n))
    rows = [(0, None, [["a start anchor", "an end anchor"]]), (1, "", []), (2, "  " + "x" * 300 + "  ", []), (3, "an opening anchor" + " y " * 90, [["an opening anchor", ""], ["an opening anchor", "nowhere to be seen"]])]
    for i in range(4, 300):
        text = pick(rng.randint(1, 40))
        cuts = [(lambda a: text[a : a + rng.randint(1, 40)])(rng.randrange(len(text))) for _ in range(8)]
        rows.append((i, text, [[rng.choice([*cuts, *words]), rng.choice([*cuts, *words, ""])] for _ in range(rng.randint(0, 4))]))
    df = spark.createDataFrame(rows, "id int, text string, marks array<array<string>>")
    got = {r["id"]: r["out"] for r in df.select("id", X.without_marked(F.col("text"), F.col("marks")).alias("out")).collect()}
    want = {i: None if text is None else P.without_marked(text, [tuple(m) for m in marks]) for i, text, marks in rows}
    assert got == want and sum(want[i] != text for i, text, _ in rows) > 50
    plan = catalog.QUERIES["str_06_hygiene"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_are_python_strings_a_part_at_a_time(monkeypatch):
    import pyarrow as pa

    held, texts = [], ["é" * 10, None, "", "x" * 500, *["y" * 20] * 30]
    monkeypatch.setattr(P, "HELD_BYTES", 100)
    real = pa.array
    monkeypatch.setattr(P.pa, "array", lambda rows, kind: held.append(len(rows)) or real(rows, kind))
    got = P._by_parts(lambda t, n: [t or "", n], P.pa.list_(pa.string()), real(texts), real([str(i) for i in range(len(texts))]))
    assert got.to_pylist() == [[t or "", str(i)] for i, t in enumerate(texts)] and max(held) <= 5 and sum(held) == len(texts)
    assert P._by_parts(len, pa.int32(), real([], pa.string())).to_pylist() == []


def test_timings_of_passages():
    captions = [(f"caption number {i} says something of its own", i * 1000, i * 1000 + 900) for i in range(20)]
    joined = " ".join(c[0] for c in captions)
    parts = [joined[:200], joined[150:420], "of another text altogether, which is not here"]
    assert P.timings(parts, captions) == [(0, 4900), (3000, 9900), None] and P.timings(["a"], []) == [None]


def test_exact_quotes_of_any_length(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the cat sat on the mat and then it slept"), (2, "a cat"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "at sat on the mat and then it sl"), (2, "a cat"), (3, "dog"), (4, None), (5, "cat sat on the mat and then he slept")], "item_id long, text string")
    want = [(1, 1), (2, 2)]
    assert sorted(map(tuple, quotes.exact(docs, items).collect())) == want
    monkeypatch.setattr(quotes, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, quotes.exact(docs, items).collect())) == want


def test_upserts_and_archived_topics(spark):
    table = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string")
    rows = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b"), (None, "m")], "k long, v string")
    assert sorted(map(str, D.upsert_ignore(table, rows, ["k"]).collect())) == sorted(["Row(k=1, v='a')", "Row(k=None, v='n')", "Row(k=2, v='b')"])
    assert {r["k"]: r["v"] for r in D.upsert_overwrite(table, rows, ["k"], ["v"]).collect()} == {1: "z", 2: "c", None: "m"}
    topics = spark.createDataFrame([("a", None, "active"), ("b", "a", "active"), ("c", "b", "active"), ("d", "c", "active")], "topic_id string, parent_id string, status string")
    found = {r["topic_id"]: (r["parent_id"], r["status"]) for r in D.archived(topics, topics.filter("topic_id IN ('b', 'c')")).collect()}
    assert found["d"] == ("a", "active") and found["b"][1] == found["c"][1] == "archived"


def test_empty_blocks_and_leaked_ids_are_not_rendered(spark):
    sentence = "array<struct<text string, kind string, claim_ids array<long>>>"
    rows = [(1, 0, "T", 0, "prose", [("One. [0a1b2c3d-0000-4000-8000-000000000000]", "sourced", [1]), ("Two.", "synthesis", [1])], None, [], [], []), (1, 0, "T", 1, "prose", [], None, [], [], []), (1, 0, "T", 2, "callout", [("Mind.", "sourced", [])], "caution", [], [], []), (1, 1, "U", 0, "table", [], None, ["a|b"], [["x\ny"]], [])]
    blocks = spark.createDataFrame(rows, f"article_id long, section int, title string, pos long, kind string, sentences {sentence}, tone string, headers array<string>, cells array<array<string>>, claim_ids array<long>")
    text = A.articles(blocks).first()["markdown"]
    assert text == "## T\n\nOne. Two.\n\n> **Caution:** Mind.\n\n## U\n\n| a\\|b |\n| --- |\n| x y |"
    assert {(r["section"], r["pos"], r["sentence"]) for r in A.issues(blocks).collect()} == {(0, 0, 1), (0, 2, 0), (1, 0, None)}
    assert {r["issue"] for r in A.issues(blocks).collect()} == {"sourced without claims", "synthesis of fewer than two claims", "table without claims"}


@pytest.mark.parametrize(
    ("function", "given", "want"),
    [
        (lambda c: X.speaker(c, "Jane Roe"), "Dr. jane roe, MD", "Jane Roe"), (lambda c: X.speaker(c, "Jane Roe"), "Host", None), (lambda c: X.speaker(c, "Jane Roe"), " Bob ", "Bob"), (lambda c: X.speaker(c, "Jane Roe"), "x" * 81, None),
        (X.guests, "Title | Ann Lee, M.D. & Bob Ray", ["Ann Lee", "Bob Ray"]), (X.guests, "Title", []), (X.guests, "Title |", []), (X.guests, "T | a b | Cy and Di E F G H", []), (X.decoded, "&#x1F600; &#65;&amp;lt;", "\U0001f600 A&lt;"),
        (X.json_part, "x ```json\n{\"a\": 1}\n``` y", "{\"a\": 1}"), (X.json_part, "none", "none"), (X.numbers, "1,234,567 and 2,34", ["1234567", "2", "34"]), (X.iso_date, "3/4/21", "2021-03-04"), (X.iso_date, "soon", None), (X.episode_number, "#396 – talk", 396),
        (X.table_cell, "a|b\n\nc", "a\\|b c"), (X.csv_cell, None, '""'), (X.grade_title, "CaseSeries", "Case Series"),
        (X.slug, "  Sleep & Heart-Rate!  ", "sleep-heart-rate"), (X.slug, "Ünï", "n"), (X.slug, "---", ""), (X.normal_title, "A  Title: Two", "a title two"), (X.words, "a b\tc", 3), (X.words, "", 1), (X.words, None, 0),
        (X.numbers, "1,200 mg of 3.5 in 2024", ["1200", "3.5", "2024"]), (X.sentences, "One. Two! three", ["One.", " Two!", " three"]), (X.is_low_value, "no conflict was declared by anyone here", True), (X.is_low_value, "short", True),
        (X.is_low_value, "sleep improves glucose control in most adults", False), (X.video_id, "https://youtu.be/abcdefghijk?t=3", "abcdefghijk"), (X.video_id, "abcdefghijk", "abcdefghijk"), (X.video_id, "https://x.org", None),
        (X.clock, "61000", "1:01"), (X.clock, "3661000", "1:01:01"), (X.html_text, "<p>a<script>var x='</p>';</script> b</p>\n c", "a b c"),
    ],
)
def test_text_functions(spark, function, given, want):
    c = F.lit(given).cast("string")
    row = spark.range(1).select(function(c.cast("long") if function is X.clock else c).alias("x")).first()
    assert row["x"] == want


def test_jobs_are_handled_once_and_urgent_kinds_are_marked(spark, tmp_path):
    jobs, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("jobs", "out", "checkpoint"))
    schema = "job_id long, kind string, payload string, created_at long"
    spark.createDataFrame([(1, "tag", "a", 1), (2, "tag", "a", 2), (3, "consolidate", "b", 3)], schema).coalesce(1).write.mode("append").parquet(jobs)
    backlog.drain(spark, jobs, out, checkpoint, schema)
    spark.createDataFrame([(4, "tag", "c", 4), (5, "tag", "a", 5)], schema).coalesce(1).write.mode("append").parquet(jobs)
    for _ in range(2):
        backlog.drain(spark, jobs, out, checkpoint, schema)
    assert sorted((r["job_id"], r["urgent"]) for r in spark.read.parquet(out).collect()) == [(1, False), (3, True), (4, False)]


def test_places_and_running_sums_agree_with_one_window(spark):
    from pyspark.sql import Window

    from silexa.operators.ranks import placed, running

    rows = spark.createDataFrame([(i, (i * 7919) % 101, None if i % 9 == 0 else i % 5) for i in range(3000)], "id long, _part long, v long").repartition(6)
    order = [F.col("_part").desc(), F.col("id")]
    got = placed(running(rows, order, {"before": F.col("v")}), order, "place")
    w = Window.orderBy(*order)
    want = rows.withColumn("before", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("place", F.row_number().over(w))
    assert sorted(map(tuple, got.select("id", "_part", "before", "place").collect())) == sorted(map(tuple, want.select("id", "_part", "before", "place").collect()))
    assert placed(rows.limit(0), order, "place").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_articles_share_files_and_keep_their_text(spark, tmp_path):
    rows = [(1, "## A\n\nx -->\n"), (2, ""), (3, None), (4, "<!-- article 1 -->\nfake\fpage"), (5, "ends\n\n")]
    A.write_markdown(spark.createDataFrame(rows, "article_id long, markdown string"), str(tmp_path / "md"))
    found = {r["article_id"]: r["markdown"] for r in A.read_markdown(spark, str(tmp_path / "md")).collect()}
    assert found == {"1": rows[0][1], "2": "", "3": "", "4": "<!-- article 1 -->\nfake\npage", "5": "ends\n\n"}
    assert len(list((tmp_path / "md").glob("part-*"))) < len(rows)
    A.write_markdown(spark.createDataFrame([], "article_id long, markdown string"), str(tmp_path / "none"))
    assert A.read_markdown(spark, str(tmp_path / "none")).isEmpty()


def test_copies_of_queries_are_not_sent_through_the_driver(spark):
    """They are as many as queries times blocks of vectors, which no planner sees before it has sent them."""
    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("embedding"))
    found = vector.match(rows, rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 0.5, 4)
    assert found.count() == 1200
    assert found.collect() and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_query_may_have_a_least_similarity_of_its_own(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0], 0.9), (3, [0.0, 1.0], 0.0)], "query_id long, query array<double>, least double")
    assert {(r["query_id"], r["vec_id"]) for r in vector.pairs_above(rows, asked, 0.05).collect()} == {(0, 1), (3, 1), (3, 2)}


def test_a_fresh_run_writes_a_bounded_number_of_folders(spark, tmp_path, monkeypatch):
    from test_catalog import SF

    from silexa import catalog
    from silexa.plans import changes

    if not Path(SF).exists():
        pytest.skip("no test tables")
    monkeypatch.setattr(changes, "SOURCE_BUCKETS", 3)
    monkeypatch.setattr(changes, "shared_folder", lambda _: str(tmp_path))
    got = catalog.QUERIES["dml_05_fresh_run"](spark, SF)
    assert {r["run"] for r in got.filter("source_id = 3").collect()} == {2} and got.filter("source_id <> 3 AND run <> 1").isEmpty()
    assert len(list(tmp_path.glob("insights/*/bucket=*"))) == 3


def test_vectors_of_a_table_are_matched_in_blocks_and_looked_up(spark):
    """No row of SQL looks at all vectors: the plan has no product of the tables, and each query finds itself first."""
    from silexa import catalog
    from silexa.functions import sql

    found = catalog.QUERIES["udf_01_match_vectors"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert all(r["vec_id"] == r["query_id"] for r in found.filter("nth = 1").collect())
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<float>")
    sql.register_tables(spark, vectors=one)
    assert [tuple(r) for r in spark.sql("SELECT * FROM match_vectors(array(1F, 0F), 0.2D, 5) ORDER BY nth").collect()] == [(1, 1.0, 1), (2, 0.707107, 2)]


@pytest.mark.parametrize("name", ["win_04_markers", "fil_11_visible_topics", "math_01_score", "lim_01_page", "sort_01_ranked", "udf_02_topic_claims_lateral"])
def test_large_tables_get_more_tasks_and_the_same_rows(spark, monkeypatch, name):
    from silexa import catalog, session

    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(session, "ROWS_A_TASK", 300)
    found = catalog.QUERIES[name](spark, sf)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, found.collect())) == want
