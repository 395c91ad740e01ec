"""SQL functions, pinned folders, outputs of other programs, and a table kept up with a stream."""

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.functions import geometry, sql, text
from graphloom.operators import chunks
from graphloom.oracle import SQL
from graphloom.plans import store, strategies
from graphloom.sources import files
from graphloom.sources.markup import html_text
from graphloom.streaming import ingest

TEXTS = ["The Token audience, and the token's header. " * 20, "", None, "one", "ä ö  ü\n\nline two. " * 40, "a#b/ http://x/y/#z //"]


def test_sql_functions_equal_the_library(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(TEXTS)], "id string, text string")
    rows.createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT id, gl_tokens(text) a, gl_token_set(text) b, gl_overlap(text, 'token header') c, gl_estimate_tokens(text) d, gl_canonical_uri(text) e, gl_stable_id('p', array(id, text)) f FROM sql_texts")
    t = F.col("text")
    want = rows.select("id", text.tokens(t).alias("a"), text.token_set(t).alias("b"), text.overlap_terms(text.token_set(t), text.token_set(F.lit("token header"))).alias("c"), text.estimate_tokens(t).alias("d"), text.canonical_uri(t).alias("e"), text.stable_id("p", F.col("id"), t).alias("f"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.sql("SELECT gl_dot(array(1D, 2D), array(3D, 4D)) x").first()["x"] == spark.range(1).select(geometry.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("x")).first()["x"] == 11


@pytest.mark.parametrize("most", [360, 90])
def test_chunks_in_sql_equal_the_operator(spark, most):
    sql.register(spark)
    docs = spark.createDataFrame([(f"d{i}", "t", "s", "d", t) for i, t in enumerate(TEXTS)], "id string, title string, source string, domain string, text string")
    docs.createOrReplaceTempView("sql_documents")
    got = spark.sql(f"SELECT d.id, c.ordinal, c.start, c.end, c.text FROM sql_documents d, LATERAL gl_chunks(d.id, d.text, {most}) c")
    want = chunks.chunk(docs, most).select("document_id", "ordinal", "start", "end", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_pinned_folder(spark, tmp_path):
    folder = tmp_path / "pins" / "deep"
    folder.mkdir(parents=True)

    def put(name, body, head):
        if body is not None:
            (folder / f"{name}.body").write_text(body)
        if head is not None:
            (folder / f"{name}.headers.json").write_text(head if isinstance(head, str) else json.dumps(head))

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    page = "<html><body><p>Pinned page.</p></body></html>"
    put("a", page, {"url": "https://x.org/a", "content_type": "text/html", "etag": "e1", "sha256": sha(page)})
    put("b", "plain text", {"url": "https://x.org/b", "content_type": "text/plain"})
    put("c", "changed", {"url": "https://x.org/c", "sha256": sha("as it was")})
    put("d", "no headers", None)
    put("e", None, {"url": "https://x.org/e"})
    put("f", "broken", "{not json")
    snapshots, drift = files.pinned_folder(spark, str(tmp_path / "pins"))
    assert {(r["url"], r["etag"]) for r in snapshots.collect()} == {("https://x.org/a", "e1"), ("https://x.org/b", None)}
    told = {r["path"].rsplit("/", 1)[1]: r["warnings"] for r in drift.collect()}
    assert told == {"c": ["body differs from the pin"], "d": ["no headers"], "e": ["no body"], "f": ["headers cannot be read"]}
    docs = {r["source"]: r["text"] for r in files.snapshot_documents(snapshots).collect()}
    assert docs == {"https://x.org/a": "Pinned page.", "https://x.org/b": "plain text"}
    # a verified manifest becomes a corpus
    manifest = spark.createDataFrame([("m1", "https://x.org/a", sha(page), None), ("m2", "https://x.org/b", sha("other"), None), ("m3", "https://x.org/z", None, None)], "id string, url string, expected_raw_sha256 string, expected_normalized_sha256 string")
    kept, found = files.materialised(manifest, snapshots, str(tmp_path / "corpus"))
    assert [r["source"] for r in kept.collect()] == ["https://x.org/a"]
    assert {r["id"]: r["warnings"] for r in found.collect()} == {"m1": [], "m2": ["raw bytes differ from the pin"], "m3": ["no snapshot"]}
    files.pin(snapshots, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).where(F.col("sha256") == sha(page)).count() == 1
    with pytest.raises(FileNotFoundError, match="no such source"):
        files.workspace(spark, str(tmp_path / "nothing"))


def test_outputs_of_other_programs(spark):
    questions = spark.createDataFrame([(f"q{i}", f"question {i}") for i in range(8)], "query_id string, query string")
    good = {"answer": "It is so.", "evidence": [{"uri": "u1", "start": 0, "end": 3, "text": "one"}, {"uri": "u1", "text": "two"}, {"uri": "u2"}], "warnings": ["slow"]}
    told = ["  " + json.dumps(good) + "\n", "plain words", "[1, 2]", '{"answer": "cut', "", "ignored", json.dumps({"evidence": []})]
    outputs = spark.createDataFrame([(f"q{i}", "graphrag_external", t, 3 if i == 5 else 0, 7.5) for i, t in enumerate(told)], "query_id string, strategy string, stdout string, exit_code int, latency_ms double")
    got = {r["query_id"]: r for r in strategies.external(questions, outputs).collect()}
    assert len(got) == 8 and all(r["external"] for r in got.values())
    assert (got["q0"]["answer"], got["q0"]["evidence_text"], got["q0"]["returned_sources"], got["q0"]["warnings"]) == ("It is so.", "one two", ["u1"], ["slow"])
    assert [got[q]["answer"] for q in ("q1", "q2", "q3", "q6")] == ["plain words", "[1, 2]", '{"answer": "cut', json.dumps({"evidence": []})]
    assert {q: r["warnings"] for q, r in got.items() if r["skipped"]} == {"q4": ["the program said nothing"], "q5": ["the program ended with 3"], "q7": ["external strategy is not available"]}
    assert got["q0"]["latency_ms"] == 7.5 and got["q7"]["latency_ms"] == 0
    plain = strategies.external(questions, outputs.select("query_id", "strategy", "stdout"))
    assert plain.where("skipped").count() == 2


def test_merge_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "id string, text string, at int")
    state = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("id", "text", "at").collect())
    for _ in range(2):
        store.merge(rows(("a", "x", 1), ("b", "y", 2), ("a", "z", 3)), path, "id", "at", 4)
        assert state() == [("a", "z", 3), ("b", "y", 2)]
    store.merge(rows(("a", "late", 2), ("c", "new", 1), ("b", "edited", 5)), path, "id", "at", 4)
    assert state() == [("a", "z", 3), ("b", "edited", 5), ("c", "new", 1)]
    store.merge(rows(), path, "id", "at", 4)
    assert len(state()) == 3


def test_stream_keeps_one_edition_of_each_document(spark, tmp_path):
    shape = "id string, text string, edited_at timestamp"
    at = lambda minute: f"2024-01-01 10:{minute:02d}:00"
    batches = [
        [("a", "first", at(0)), ("b", "only", at(1)), ("a", "first", at(0))],
        [("a", "second", at(5)), ("b", "only", at(1))],  # b comes again
        [("a", "first", at(0)), ("c", "new", at(9)), ("a", "between", at(3))],  # late editions
    ]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(a, b, c) for a, b, c in rows], "id string, text string, t string").select("id", "text", F.to_timestamp("t").alias("edited_at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        q = ingest.keep_up(stream, str(tmp_path / "out"), str(tmp_path / "ck"), buckets=3)
        q.awaitTermination(120)
        assert q.exception() is None
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["id"], r["text"]) for r in kept.collect()) == [("a", "second"), ("b", "only"), ("c", "new")]
    # a batch that runs again without its checkpoint changes nothing
    q = ingest.keep_up(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "other"), buckets=3)
    q.awaitTermination(120)
    assert sorted((r["id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "second"), ("b", "only"), ("c", "new")]


def test_documents_that_hold_a_passage(spark):
    from graphloom.queries import holding

    texts = ["we say alpha-one beta gamma here", "prefixalpha-one beta gammasuffix", "alpha-one beta, gamma", "beta gamma", None, "a b", "ALPHA-ONE BETA GAMMA", "alpha-one beta gamma alpha-one beta gamma"]
    passages = ["alpha-one beta gamma", "beta gamma", "a b", "gamma", "not there at all", " one beta", "say alpha-one beta gamma here"]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = holding(docs, spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string"))
    assert sorted((r["item_id"], r["doc_id"]) for r in got.collect()) == sorted((j, i) for j, p in enumerate(passages) for i, t in enumerate(texts) if t and p in t)


def test_page_text_sql(spark):
    """The text of pages against its SQL: references, elements that go with their content, unclosed parts, odd space."""
    pages = [
        "<html><head><style>b{}</style><title>A &amp; B</title></head><body><p>x &lt;b&gt; &copy;&nbsp;</p><p>&#8364; 5&#44; &eacute;</p></body></html>",
        "<p>one<!-- <b>no</b> --> two<script>if (a < b) { '</p>' }</script>three</p><noscript>gone</noscript >",
        "<div>open<script>never closed", "<!-- never closed <p>x</p>", "a < b and 3 > 2 <3", "<P\nCLASS='x'>Up</P>\u2003\u00a0<br/>\ttail\u3000",
        "", None, "&unknown; &amp;lt; plain", "<scripty>kept</scripty><styles>too</styles>",
    ]
    rows = [(i, h) for i, h in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in html_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = {i: (n, digest) for i, n, digest in con.execute(SQL["page_html_text"]).fetchall()}
    assert {i: (len(t), hashlib.md5(t.encode()).hexdigest()) for i, t in got.items()} == want


def test_page_references_sql(spark, tmp_path):
    """The query against its SQL where references are cut off, unknown, hexadecimal or long."""
    pages = ["<title>Auf&amp</title><p>R&D; AT&T &ampx; &copy 1</p>", "<p>the&amp;&amp</p>x&lt", "&#x27;a&#X27; &#39;b&#39 &#0000000000065; &#" + "9" * 5000 + "x", "&AMP; &notit; &hellip;&bull; &NewLine; &apos;", "&#128;&#160;c &amp;amp; &&amp;;"]
    rows = list(enumerate(pages))
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    got = queries.page_html_text(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(SQL["page_html_text"]).fetchall())
