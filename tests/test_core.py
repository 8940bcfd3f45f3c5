"""Text forms, routing, identity, filters, search, queue, readers, versioned tables and streams."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.operators import filters, generations, identity, pages, queue, retrieval
from folioforge.sources import readers
from folioforge.sources.store import PublicationError, VersionedTable


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("r")).collect()]


def test_addresses(spark):
    got = column(spark, ["HTTP://Example.COM:80/a/#x", "https://e.org:443", "https://e.org:8443/p?q=1#f", "http://[::1]:80/x/", "ftp://e.org/", "https://u:p@e.org/", "https:///x", "nonsense", None, " https://e.org/a// "], X.normalize_url)
    assert got == ["http://example.com/a", "https://e.org/", "https://e.org:8443/p?q=1", "http://[::1]/x", None, None, None, None, None, "https://e.org/a"]


def test_names(spark):
    assert column(spark, ["Déjà Vu!", "  ", "a__b"], X.slugify) == ["d_j_vu", "source", "a_b"]
    assert column(spark, ["/x/y z?.pdf", "", None, "..."], X.safe_filename) == ["y_z_.pdf", "upload", "upload", "upload"]
    assert column(spark, ["4", "Chapter_2", "a b/c"], X.chapter_filename) == ["chapter_04.md", "Chapter_2.md", "chapter_a_b_c.md"]
    assert column(spark, ["ok_1", "-bad", "a" * 201, "a\n"], X.valid_source_id) == [True, False, False, False]
    assert column(spark, [["a, b", " ", "c"], None], X.normalize_tags, "array<string>") == [["a", "b", "c"], []]
    assert column(spark, ["a,,b ", None], X.tags_of_text) == [["a", "b"], []]


def test_page_forms(spark):
    got = column(spark, ["a\r\n\r\n\r\n\r\nb", "", "<!-- page: 7 -->\nx"], lambda c: X.page_markdown(c, F.lit(7)))
    assert got == ["<!-- page: 7 -->\n\n## Page 7\n\na\n\nb\n", "<!-- page: 7 -->\n\n## Page 7\n", "<!-- page: 7 -->\nx\n"]
    assert column(spark, ["<b>A</b>  *b*_c_"], X.clean_heading) == ["A bc"]
    assert column(spark, ["Connection reset by peer", "vector dimension mismatch", None], X.retryable) == [True, False, False]


def quality(spark, texts):
    return pages.with_quality(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text").orderBy("i").collect()


def test_quality_flags(spark):
    rows = quality(spark, ["This is a real sentence. " * 20, "", "@@@ ### $$$ " * 30, None, "�" * 300])
    assert [r.is_true_text for r in rows] == [True, False, False, False, False]
    assert rows[1].flags == ["too_few_chars", "low_alpha_ratio", "no_lines"]
    assert "low_alpha_ratio" in rows[2].flags and "replacement_chars" in rows[4].flags


@pytest.mark.parametrize(("mode", "want"), [("auto", ["text", "ocr", "text", "ocr"]), ("never", ["text"] * 4), ("always", ["ocr"] * 4), ("glm", ["text", "ocr", "ocr", "ocr"])])
def test_routes(spark, mode, want):
    good = "Plain words in a sentence. " * 20
    rows = [(0, "s", good, False, True), (1, "s", "", True, True), (2, "s", "few words", False, False), (3, "s", "@@@ ###", True, True)]
    df = pages.with_quality(spark.createDataFrame(rows, "i int, source string, text string, has_images boolean, has_visual boolean"), "text")
    assert [r.route for r in pages.route_pages(df, "source", mode).orderBy("i").collect()] == want


def test_summary_counts_latest_attempt(spark):
    t = datetime(2025, 1, 1)
    rows = [("s", 1, "failed", None, None, t), ("s", 1, "ocr", "p1", "m1", t + timedelta(1)), ("s", 2, "ocr", "p2", "m1", t), ("s", 3, "skipped", None, None, t), ("z", 1, "skipped", None, None, t)]
    df = spark.createDataFrame(rows, "source_id string, page_number int, extraction_method string, ocr_provider string, ocr_model string, extracted_at timestamp")
    got = {r.source_id: (r.pages_total, r.pages_ocr, r.ocr_provider, r.ocr_model, r.all_skipped) for r in pages.extraction_summary(df).collect()}
    assert got == {"s": (3, 2, "mixed", "m1", False), "z": (1, 0, None, None, True)}


def test_identity_precedence(spark):
    rows = [("a", " Site ", "x ", "https://E.org/", None), ("b", "s", "", None, "HTTPS://e.org:443/p/"), ("c", None, None, None, None), ("d", None, "id", None, None), ("e", "s", None, "", "bad url")]
    df = spark.createDataFrame(rows, "i string, origin string, external_id string, canonical_url string, url string")
    key = identity.identity_key(*(F.col(c) for c in ("origin", "external_id", "canonical_url", "url")), F.lit("h"))
    assert [r[0] for r in df.orderBy("i").select(key).collect()] == ["external:site:x", "url:https://e.org/p", "sha256:h", None, None]


def test_duplicate_policy(spark):
    t = datetime(2025, 1, 1)
    rows = [("r1", t, "reject", "k"), ("r2", t, "reject", "k"), ("r3", t, "create", "k"), ("r4", t, "reject", None), ("r5", t, "reject", "other")]
    df = spark.createDataFrame(rows, "request_id string, received_at timestamp, duplicate_policy string, identity_key string")
    got = {r.request_id: (r.decision, r.existing_id) for r in identity.duplicate_decisions(df).collect()}
    assert got == {"r1": ("accepted", None), "r2": ("rejected", "r1"), "r3": ("accepted", "r1"), "r4": ("invalid", None), "r5": ("accepted", None)}


def test_filters(spark):
    rows = [("a", "en", ["x", "y"], 1, 3), ("b", "en", None, None, None), ("c", "", ["x"], 5, 9)]
    df = spark.createDataFrame(rows, "chunk_id string, language string, tags array<string>, page_start int, page_end int")
    ids = lambda f: [r[0] for r in filters.apply_filters(df, f).orderBy("chunk_id").collect()]
    assert ids(filters.Filters()) == ["a", "b", "c"]
    assert ids(filters.Filters(equal={"language": ""})) == ["c"]
    assert ids(filters.Filters(tags=["x", "y"])) == ["a"]
    assert ids(filters.Filters(page_start=3)) == ["a", "c"] and ids(filters.Filters(page_start=3, page_end=4)) == ["a"]
    with pytest.raises(ValueError):
        filters.Filters(equal={"text": "x"})


def test_filters_reach_the_scan(spark, data):
    df = spark.read.parquet(f"{data}/chunks.parquet")
    plan = filters.apply_filters(df, filters.Filters(equal={"language": "en"}, page_start=2)).select("chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(language,en)" in plan and "GreaterThanOrEqual(page_end,2)" in plan and "embedding" not in plan


def test_search(spark):
    rows = [("a", "the router and the router", [1.0, 0.0]), ("b", "a firewall", [0.0, 1.0]), ("c", None, None), ("d", "nothing here", [0.6, 0.8]), ("e", "router", [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "m", 2, "en") for r in rows], "chunk_id string, text string, embedding array<float>, embedding_model string, embedding_dimension int, language string")
    assert {r.chunk_id for r in retrieval.top(retrieval.bm25(df, "router"), "lexical", 5).collect()} == {"a", "e"}
    assert [r.chunk_id for r in retrieval.top(retrieval.cosine_to(df, [1.0, 0.0], "m"), "cosine", 5).orderBy("rank").collect()] == ["a", "d", "b"]
    best = retrieval.hybrid_search(df, "router", [1.0, 0.0], "m", top_k=2).orderBy("rank").collect()
    assert best[0].chunk_id == "a" and len(best) == 2
    assert retrieval.hybrid_search(df, "absent", [1.0, 0.0], "other").count() == 0
    with pytest.raises(ValueError):
        retrieval.require_model(df, "other")
    assert retrieval.require_model(df, "m") is df
    assert retrieval.context_pack(df.where("false").selectExpr("1 as rank", "chunk_id", "text", "'t' as title", "'c' as chapter", "'s' as section", "1 as page_start", "2 as page_end"), "q").collect()[0][1] == 0


def test_generations(spark):
    schema = "chunk_id string, source_id string, text string, created_at string"
    old = spark.createDataFrame([("a", "s", "1", "t"), ("b", "s", "2", "t"), ("c", "s", None, "t")], schema)
    new = spark.createDataFrame([("b", "s", "2", "u"), ("c", "s", "3", "u"), ("d", "s", "4", "u")], schema)
    assert {(r.chunk_id, r.change) for r in generations.difference(old, new).collect()} == {("a", "removed"), ("b", "same"), ("c", "changed"), ("d", "added")}
    assert [r[0] for r in generations.stale_ids(old, new).collect()] == ["a"]
    assert generations.upsert(old, new).count() == 4 and generations.delete_ids(old, new).count() == 1
    assert generations.replace_source(old, "s", new).count() == 3


JOB = "job_id string, status string, phase string, source_id string, identity_key string, attempts int, worker_id string, claim_token string, error string, upload_path string, created_at timestamp, updated_at timestamp, started_at timestamp, finished_at timestamp, next_attempt_at timestamp"


def jobs(spark, *rows):
    t = datetime(2025, 1, 1)
    base = {"status": "queued", "phase": "queued", "source_id": None, "identity_key": None, "attempts": 0, "worker_id": None, "claim_token": None, "error": None, "upload_path": None, "created_at": t, "updated_at": t, "started_at": None, "finished_at": None, "next_attempt_at": None}
    names = [x.split()[0] for x in JOB.split(", ")]
    return spark.createDataFrame([tuple(({"job_id": None} | base | r)[n] for n in names) for r in rows], JOB)


def now():
    return F.lit(datetime(2025, 1, 1, 12, tzinfo=timezone.utc))


def test_queue(spark):
    later = datetime(2025, 1, 2)
    df = jobs(spark, {"job_id": "b"}, {"job_id": "a"}, {"job_id": "w", "next_attempt_at": later, "created_at": datetime(2024, 1, 1)}, {"job_id": "f", "status": "failed", "error": "Connection refused"}, {"job_id": "x", "status": "odd"}, {"job_id": None})
    good = queue.latest_jobs(df)
    assert queue.quarantined_jobs(df).count() == 2 and good.count() == 4
    assert [r.job_id for r in queue.ready_jobs(good, now(), 5).collect()] == ["a", "b"]
    claimed = {r.job_id: (r.status, r.attempts) for r in queue.claim(good, now(), "w1").collect()}
    assert claimed["a"] == ("running", 1) and claimed["b"] == ("queued", 0)
    again = queue.claim(good, now(), "w1").where("job_id = 'a'")
    assert queue.persist_claimed(again, again).collect()[0].applied and not queue.persist_claimed(good, again).collect()[0].applied
    assert queue.recover_interrupted(again).collect()[0].status == "queued"
    assert queue.after_failure(good, now()).collect()[0].next_status == "queued"


def test_blocking_admission_and_uploads(spark):
    df = jobs(spark, {"job_id": "1", "source_id": "s1", "identity_key": "k"}, {"job_id": "2", "source_id": "s2", "identity_key": "k"}, {"job_id": "3", "source_id": "s3", "identity_key": "k", "status": "succeeded", "upload_path": "u3"}, {"job_id": "4", "source_id": "s4", "identity_key": "z", "status": "failed", "upload_path": "u4", "finished_at": datetime(2024, 1, 1)})
    sources = spark.createDataFrame([("s3",)], "source_id string")
    assert {r.job_id: r.blocked_by for r in queue.blocking_jobs(df, sources).collect()} == {"1": "2", "2": "1", "3": "1"}
    assert {r.job_id: r.reason for r in queue.expired_uploads(df, now()).collect()} == {"3": "succeeded", "4": "failed"}
    up = spark.createDataFrame([(str(i), datetime(2025, 1, 1 + i // 2), 100) for i in range(6)], "job_id string, created_at timestamp, bytes bigint")
    from folioforge.plans.config import Queue

    decided = lambda *a, **k: [r.decision for r in queue.admit(*a, **k).orderBy("job_id").collect()]
    assert decided(up, settings=Queue(storage_bytes=350)) == ["admitted"] * 3 + ["storage_full"] * 3
    assert decided(up, 18, settings=Queue()) == ["admitted"] * 2 + ["queue_full"] * 4
    assert decided(up, 0, 250, Queue(storage_bytes=350), step=1) == ["admitted"] + ["storage_full"] * 5
    # what is refused takes no room: a large upload, then one that does not fit any more, then a small one that does
    mixed = spark.createDataFrame([("1", datetime(2025, 1, 1), 400), ("2", datetime(2025, 1, 2), 80), ("3", datetime(2025, 1, 3), 60), ("4", None, 30), ("5", datetime(2025, 1, 5), None)], "job_id string, created_at timestamp, bytes bigint")
    for step in (1, 2, 1000):
        assert decided(mixed, settings=Queue(upload_bytes=100, storage_bytes=120), step=step) == ["storage_full", "admitted", "storage_full", "admitted", "admitted"]
    assert decided(mixed, settings=Queue(upload_bytes=100, storage_bytes=1000)) == ["too_large", "admitted", "admitted", "admitted", "admitted"]
    assert queue.admit(up.where("false")).count() == 0


def test_admission_equals_slow_reading(spark):
    import random

    from folioforge.plans.config import Queue

    rng = random.Random(4)
    rows = [(f"{i:03d}", datetime(2025, 1, 1, rng.randrange(24)), rng.choice([5, 20, 60, 150, None])) for i in range(120)]
    s = Queue(max_active=22, storage_bytes=900, upload_bytes=100)
    want, active, used = {}, 3, 40
    for i, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        n = n or 0
        want[i] = "queue_full" if active >= 22 else "storage_full" if used + min(n, 100) > 900 else "too_large" if n > 100 else "admitted"
        if want[i] == "admitted":
            active, used = active + 1, used + n
    df = spark.createDataFrame(rows, "job_id string, created_at timestamp, bytes bigint")
    assert {r.job_id: r.decision for r in queue.admit(df, 3, 40, s, step=7).collect()} == want


def test_retry_and_cleanup(spark):
    from folioforge.plans.config import Queue

    t = datetime(2025, 1, 1)
    df = jobs(spark, *[{"job_id": str(i), "source_id": f"s{i}", "status": "failed", "phase": "extracting", "upload_path": f"u{i}", "error": "x", "created_at": t + timedelta(i)} for i in range(4)], {"job_id": "5", "status": "failed", "phase": "indexing", "upload_path": None}, {"job_id": "6", "status": "running"}, {"job_id": "7", "status": "failed", "identity_key": "k", "source_id": "s7", "upload_path": "u7"}, {"job_id": "8", "identity_key": "k", "source_id": "s8"})
    df = df.withColumn("duplicate_policy", F.lit("reject"))
    there = spark.createDataFrame([("u0",), ("u2",), ("u3",), ("u7",), (None,)], "upload_path string")
    asked = df.select("job_id").unionByName(spark.createDataFrame([("nine",), (None,)], "job_id string"))
    outcomes = queue.retry(df, asked, there, Queue(max_active=5))
    got = {r.job_id: r.outcome for r in outcomes.collect()}
    assert got == {"0": "queued", "1": "upload_gone", "2": "queued", "3": "queue_full", "5": "queued", "6": "not_failed", "7": "identity_held", "8": "not_failed", "nine": "unknown"}
    after = {r.job_id: (r.status, r.error) for r in queue.retried(df, outcomes).collect()}
    assert after["0"] == ("queued", None) and after["1"] == ("failed", "x") and len(after) == 8
    assert {(r.job_id, r.action) for r in queue.terminal_cleanup(df).collect()} == {("7", "release_identity")}
    assert queue.retry(df, asked.where("false"), there).count() == 0


def test_empty_tables(spark):
    none = jobs(spark).where("false")
    assert queue.queue_health(none).collect()[0].state == "ok" and queue.worker_health(none, now()).count() == 0
    assert queue.blocking_jobs(none, spark.createDataFrame([], "source_id string")).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("﻿---\ntitle: T\ntags: [x, 'y, z']\nextra: 1\n---\nBody\n")
    (tmp_path / "b.md").write_text("no front")
    (tmp_path / "c.md").write_text("---\ntitle: never closed")
    (tmp_path / "d.md").write_text("---\ntags: 123\n---\nx")
    (tmp_path / "e.md").write_text("---\n- a\n---\nx")
    (tmp_path / "f.md").write_text("---\n---\nonly body")
    texts = readers.read_texts(spark, str(tmp_path)).withColumn("id", F.regexp_extract("path", r"(\w)\.md", 1))
    got = {r.id: r for r in readers.parse_front_matter(texts, "id", "text").collect()}
    assert got["a"].front.title == "T" and got["a"].front.tags == ["x", "y", "z"] and got["a"].body == "Body\n"
    assert got["b"].front is None and got["b"].body == "no front" and got["b"].front_error is None
    assert got["c"].front_error and "tags" in got["d"].front_error and "mapping" in got["e"].front_error
    assert got["f"].body == "only body" and got["f"].front_error is None
    merged = {r.id: r for r in readers.resolve_metadata(readers.parse_front_matter(texts, "id", "text"), {"title": F.when(F.col("id") == "b", "")}).collect()}
    assert merged["a"].title == "T" and merged["b"].title == "" and merged["b"].source_type == "other" and not merged["b"].has_title
    assert readers.read_binary(spark, str(tmp_path), 20).where("kind = 'markdown'").count() >= 1


def test_json_lines(spark, tmp_path):
    (tmp_path / "jobs.jsonl").write_text(json.dumps({"job_id": "b", "created_at": "2025-01-02T00:00:00Z"}) + "\n{\n\n" + json.dumps({"job_id": "a", "created_at": "2025-01-01T00:00:00Z"}) + "\n")
    good, bad = readers.read_jobs(spark, str(tmp_path / "jobs.jsonl"))
    assert [r.job_id for r in good.collect()] == ["a", "b"] and bad.count() == 1
    (tmp_path / "art.jsonl").write_text(json.dumps({"request_id": "1", "body": " "}) + "\n" + json.dumps({"request_id": "2", "body": "x", "tags": ["t"]}) + "\n")
    assert [r.request_id for r in readers.read_articles(spark, str(tmp_path / "art.jsonl")).collect()] == ["2"]


def test_answers(spark):
    assert column(spark, ['{"choices":[{"message":{"content":[{"text":"a"},{"text":"b"}]}}]}', '{"choices":[{"message":{"content":"  "}}]}', "x"], readers.ocr_response_markdown) == ["a\nb", None, None]
    assert column(spark, ['{"data":[{"index":1,"embedding":[2]},{"index":0,"embedding":[1]}]}'], readers.embedding_response) == [[[1.0], [2.0]]]
    seen = "array<struct<text:string,x:double,y:double>>"
    assert column(spark, [[("b", 0.5, 0.9), ("a", 0.1, 0.905), (" ", 0.0, 0.7), ("c", 0.0, 0.2)]], readers.ordered_ocr_lines, seen) == ["a\nb\nc"]
    assert column(spark, ["x.PDF", "y.md", "z.exe"], readers.input_kind) == ["pdf", "markdown", None]
    assert column(spark, [[3.0, 4.0], [0.0, 0.0]], retrieval.normalize, "array<float>") == [[0.6, 0.8], [0.0, 0.0]]


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/chunks")
    one = spark.createDataFrame([("a", 1)], "chunk_id string, n int")
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.publish(one, expected=1) == 1
    two = one.unionByName(spark.createDataFrame([("b", 2)], "chunk_id string, n int"))
    assert t.publish(two) == 2 and t.read().count() == 2 and t.read(1).count() == 1
    for bad in (lambda: t.publish(two, expected=5), lambda: t.publish(two.unionByName(one)), lambda: t.publish(two, check=lambda d: "no")):
        with pytest.raises(PublicationError):
            bad()
    assert t.current() == 2 and t.versions() == [1, 2]
    one.write.parquet(f"file://{tmp_path}/chunks/v=9")
    assert t.recover() == [9] and t.drop_before(1) == [1] and t.read().count() == 2


def test_article_stream(spark, tmp_path):
    from folioforge.streaming import feed

    t = datetime(2025, 1, 1)
    schema = "request_id string, received_at timestamp, origin string, external_id string, canonical_url string, url string, body string"
    first = spark.createDataFrame([("1", t, "s", "x", None, None, "b"), ("2", t, "s", "x", None, None, "b"), ("3", t, None, None, None, None, "c")], schema)
    first.write.parquet(f"{tmp_path}/in/1")
    stream = feed.article_stream(spark, f"{tmp_path}/in/*", first.schema)
    table = VersionedTable(spark, f"file://{tmp_path}/out")
    feed.publish_stream(feed.unique_articles(stream), table, "identity_key", f"{tmp_path}/cp").awaitTermination()
    assert table.read().count() == 2
    first.limit(1).withColumn("request_id", F.lit("4")).write.parquet(f"{tmp_path}/in/2")
    feed.publish_stream(feed.unique_articles(feed.article_stream(spark, f"{tmp_path}/in/*", first.schema)), table, "identity_key", f"{tmp_path}/cp").awaitTermination()
    assert table.read().count() == 2


def test_windowed_stream(spark, data, tmp_path):
    from folioforge.streaming import feed

    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(f"{tmp_path}/e")
    stream = feed.activity(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"))
    q = stream.writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(events) from activity").collect()[0][0] == events.count()


def test_plugins(spark, tmp_path):
    from folioforge.sources import plugins

    df = spark.createDataFrame([("a", "red lamp"), ("b", "red lamp"), ("c", "other words here"), ("d", None)], "id string, text string")
    v = dict(zip("abcd", plugins.hashed_vectors(["red lamp", "Lamp RED", "other words here", ""], 8)))
    assert v["a"] == v["b"] and abs(sum(x * x for x in v["c"]) - 1) < 1e-9 and v["d"] == [0.0] * 8
    got = plugins.embed_with(df, "id", "text", lambda texts: [[float(len(t)), 1.0] for t in texts], batch=2)
    assert {r.id: (list(r.embedding), r.embedding_dimension) for r in got.collect()} == {"a": ([8.0, 1.0], 2), "b": ([8.0, 1.0], 2), "c": ([16.0, 1.0], 2)}
    with pytest.raises(Exception, match="vectors"):
        plugins.embed_with(df, "id", "text", lambda texts: []).collect()
    scans = spark.createDataFrame([("s", 1, b"ok", False), ("s", 2, b"", False), ("s", 3, None, True)], "source_id string, page_number int, content binary, blank boolean")
    provider = lambda content, n: (content.decode(), "m1")
    read = {r.page_number: r for r in plugins.read_scans(scans, provider, "p", continue_on_error=True).collect()}
    assert (read[1].extraction_method, read[1].ocr_model) == ("ocr", "m1") and read[2].quality_flags == ["ocr_failed"] and read[3].extraction_method == "skipped"
    assert "[OCR failed:" in read[2].markdown and read[3].markdown.startswith("<!-- page: 3 -->")
    with pytest.raises(Exception, match="no text"):
        plugins.read_scans(scans, provider, "p").collect()
    assert plugins.choose_provider("auto", {"x": provider}, "x") is provider
    with pytest.raises(KeyError):
        plugins.choose_provider("y", {"x": provider}, "x")
    for n in ("b.png", "a.png"):
        (tmp_path / n).write_bytes(n.encode())
    files = readers.read_binary(spark, str(tmp_path), 100)
    assert [(r.path[-5:], r.page_number) for r in plugins.numbered_images(files).orderBy("page_number").collect()] == [("a.png", 1), ("b.png", 2)]
    import hashlib

    assert plugins.folder_hash(files).collect()[0].content_sha256 == hashlib.sha256(b"a.png\0a.png\0b.png\0b.png\0").hexdigest()


def test_requests_and_conflicts(spark):
    retrieval.check_request("q", 1, 0.0)
    for bad in (("",), ("q", 0), ("q", 101), ("q", 5, 1.5)):
        with pytest.raises(ValueError):
            retrieval.check_request(*bad)
    t = datetime(2025, 1, 1)
    seen = spark.createDataFrame([("a", t, "p"), ("b", t, "p")], "source_id string, updated_at timestamp, original_path string")
    now_ = spark.createDataFrame([("a", t, "p"), ("b", t, "q")], seen.schema)
    assert [r.source_id for r in identity.backfill_conflicts(seen, now_).collect()] == ["b"]
    index = spark.createDataFrame([("c1", "s"), ("c2", "t"), ("c3", None)], "chunk_id string, source_id string")
    left, gone = generations.delete_source(index, "s")
    assert left.count() == 2 and gone.collect()[0].deleted == 1


def test_every_event_has_its_answer(spark, data):
    from folioforge import catalog

    got = sorted(tuple(r) for r in catalog.queries()["service_answers"](spark, data).collect())
    events = spark.read.parquet(f"{data}/events.parquet").select("event_id", "event_type").collect()
    assert got == sorted((r.event_id, r.event_type, 0.0 if r.event_id % 7 == 0 else 1.0, 0.8) for r in events)


@pytest.mark.parametrize("method", ["relative", "rrf"])
def test_whole_lists_are_fused(spark, method):
    from folioforge.plans.config import Retrieval

    rows = [(f"c{i:02d}", "router " * (1 + i % 7) + "x " * (i % 5), [1.0, 0.05 * i], "m", 2) for i in range(30)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, embedding array<float>, embedding_model string, embedding_dimension int")
    found = retrieval.hybrid_search(df, "router", [1.0, 0.0], "m", top_k=12, method=method).orderBy("rank").collect()
    scored = {r.chunk_id: r for r in retrieval.bm25(df, "router").join(retrieval.cosine_to(df, [1.0, 0.0], "m"), "chunk_id").collect()}
    place = {c: {r.chunk_id: k + 1 for k, r in enumerate(sorted(scored.values(), key=lambda r: (-r[c], r.chunk_id)))} for c in ("lexical", "cosine")}

    def part(c, r):
        low, high = min(x[c] for x in scored.values()), max(x[c] for x in scored.values())
        return (r[c] - low) / (high - low) if method == "relative" else 1 / (60 + place[c][r.chunk_id])

    want = sorted(((round(0.65 * part("cosine", r) + 0.35 * part("lexical", r), 9), r.chunk_id) for r in scored.values()), key=lambda x: (-x[0], x[1]))[:12]
    assert [(r.score, r.chunk_id) for r in found] == want


def test_ranks_over_ranges(spark):
    df = spark.range(1000).select(F.format_string("c%04d", "id").alias("chunk_id"), (F.col("id") % 7).cast("double").alias("lexical"))
    want = sorted(((-(i % 7), f"c{i:04d}") for i in range(1000)))
    assert {(r.chunk_id, r["rank"]) for r in retrieval.ranked(df, "lexical").collect()} == {(c, k + 1) for k, (_, c) in enumerate(want)}
    assert retrieval.ranked(df.where("false"), "lexical").count() == 0


def test_search_from_question_to_hits(spark):
    from folioforge.sources import plugins

    t = datetime(2025, 1, 1)
    rows = [("a", t, "routers pass packets", "en", "m"), ("a", t + timedelta(1), "nothing of it any more", "en", "m"), ("b", t, "routers and firewalls pass packets", "en", "m"), ("c", t, "routers pass packets", "sv", "m"), ("d", t, "packets", "en", "other"), (None, t, "routers", "en", "m"), ("e", t, None, "en", None)]
    df = spark.createDataFrame(rows, "chunk_id string, created_at timestamp, text string, language string, embedding_model string").withColumns({"embedding": plugins.embed_column(F.coalesce("text", F.lit("")), plugins.hashed_vectors), "embedding_dimension": F.lit(64)})
    f = filters.Filters(equal={"language": "en"})
    ask = lambda **k: retrieval.search(df, "how do routers pass packets", plugins.hashed_vectors, "m", f, instruction=plugins.INSTRUCTION, **k)
    with pytest.raises(ValueError, match="mismatch"):
        ask(top_k=3)
    hits = ask(top_k=3, allow_mismatch=True).orderBy("rank").collect()
    assert hits[0].chunk_id == "b" and "c" not in [h.chunk_id for h in hits] and hits[0].text.startswith("routers and")
    with pytest.raises(ValueError):
        ask(top_k=0)
    assert retrieval.search(df.where("false"), "x", plugins.hashed_vectors, "m").count() == 0
    assert retrieval.show_chunk(df, "a").collect()[0].text.startswith("nothing")
    with pytest.raises(LookupError):
        retrieval.show_chunk(df, "zz")


def test_latest_row_decides(spark, data):
    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([("a", t, "en"), ("a", t + timedelta(1), "sv"), ("b", t, "sv"), ("b", t + timedelta(1), "en"), ("c", None, "en"), (None, t, "en")], "chunk_id string, created_at timestamp, language string")
    assert {r.chunk_id for r in retrieval.live_matching(df, F.col("language") == "en").collect()} == {"b", "c"}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # the plan names its pushed filters in full
    plan = retrieval.live_matching(spark.read.parquet(f"{data}/chunks.parquet"), filters.predicate(filters.Filters(equal={"language": "en"}, page_start=2)))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(language,en)" in plan and "GreaterThanOrEqual(page_end,2)" in plan
    assert "text:string" not in plan and "tags:array" not in plan


def test_blank_pages_count_nothing(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, " \n"), (4, "two words")], "n int, text string")
    got = {r.n: (r.char_count, r.word_count) for r in pages.normalized_pages(df, "n", "text").collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[4][0] > 9
    with pytest.raises(Exception, match="was blank"):
        pages.require_content(pages.extraction_summary(spark.createDataFrame([("s", 1, "skipped", None, None, datetime(2025, 1, 1))], "source_id string, page_number int, extraction_method string, ocr_provider string, ocr_model string, extracted_at timestamp"))).collect()


def test_retryable_by_code_and_kind(spark):
    rows = [("x", 503, None), ("x", 429, None), ("x", 404, None), (None, None, "ReadTimeout"), ("weaviategrpcunavailableerror", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "m string, s int, k string")
    assert [r[0] for r in df.select(X.retryable(F.col("m"), F.col("s"), F.col("k"))).collect()] == [True, True, False, True, True, False]


def test_crash_leaves_the_published_version(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    one = spark.createDataFrame([("a", 1)], "chunk_id string, n int")
    plain = VersionedTable._create
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_create", lambda self, name, text: plain(self, name, text) if not name.startswith("log/") else (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            t.publish(one)
    assert t.current() is None and t.versions() == [1]
    assert t.recover() == [1] and t.versions() == []  # the journal knows the first version was never published
    assert t.publish(one) == 1
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_create", lambda self, name, text: plain(self, name, text) if not name.startswith("log/") else (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            t.publish(one)
    assert t.read().count() == 1 and t.recover() == [2] and t.current() == 1
    with monkeypatch.context() as m:  # killed after the log entry: published, the journal is settled later
        m.setattr(VersionedTable, "_delete", lambda self, name: None)
        t.publish(one.withColumn("n", F.lit(2)))
    (tmp_path / "t" / "LOCK").unlink()
    assert t.recover() == [] and t.current() == 2 and t.read().collect()[0].n == 2
    (tmp_path / "t" / "log" / "3").write_text("")  # a torn entry
    assert t.current() == 2 and t.publish(one) == 4


def test_nothing_is_deleted_without_a_log(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    one = spark.createDataFrame([("a", 1)], "chunk_id string, n int")
    t.publish(one)
    t.publish(one)
    for f in (tmp_path / "t" / "log").iterdir():
        f.unlink()
    with pytest.raises(PublicationError):
        t.recover()
    assert t.versions() == [1, 2]


def test_writers_exclude_each_other(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    one = spark.createDataFrame([("a", 1)], "chunk_id string, n int")
    seen = t.publish(one)
    t.publish(one)
    with pytest.raises(PublicationError, match="current"):
        t.publish(one, base=seen)
    with t.lock("me"), pytest.raises(PublicationError, match="held by me"):
        t.publish(one)
    assert t.publish(one, base=2) == 3
    assert t.append(one.withColumn("chunk_id", F.lit("b"))) == 4 and t.read().count() == 2
    assert t.restore(1) == 5 and t.read().count() == 1 and t.drop_before(2) == [1, 2, 3] and t.read(4).count() == 2
    both = t.publish_parts({"chunks": one, "sources": one.select(F.lit("s").alias("source_id"))}, {"chunks": "chunk_id"})
    assert t.read(both, "sources").collect()[0].source_id == "s" and t.read(part="chunks").count() == 1
    with pytest.raises(PublicationError):
        t.publish_parts({"chunks": one, "sources": one}, expected={"sources": 7})
    assert t.current() == both


def test_backfill_is_installed_whole_or_not(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([("s1", "k1"), ("s2", "k2")], "source_id string, identity_key string")
    first = t.publish(rows, "source_id")
    with pytest.raises(PublicationError, match="belong to 2"):
        identity.install_backfill(t, rows.withColumn("identity_key", F.lit("k")), first)
    assert identity.install_backfill(t, rows, first) == first + 1
    with pytest.raises(PublicationError):
        identity.install_backfill(t, rows, first)
    listed = identity.identity_collisions(rows.withColumn("identity_key", F.lit("k"))).collect()
    assert [(r.n_sources, r.source_ids) for r in listed] == [(2, ["s1", "s2"])]
