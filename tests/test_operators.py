"""Known answers and odd cases of the reference's operators."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinderlake.config import ChunkingConfig
from cinderlake.functions import text, vectors
from cinderlake.operators import auth, blocks, calendar, embedding, index, packing, progress, relational, retrieval, tickets
from cinderlake.sources import repository, tables

CONFIG = ChunkingConfig()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normalise_and_distance(spark):
    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert value(spark, vectors.normalize(v(3, 4))) == [0.6, 0.8]
    assert value(spark, vectors.normalize(v(0, 0))) == [0.0, 0.0]
    assert value(spark, vectors.cosine_distance(v(1, 0), v(1, 0))) == 0.0
    assert value(spark, vectors.cosine_distance(v(0, 0), v(1, 0))) == 1.0


def test_top_k_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.0]) for k in (5, 3, 9, 1, 7)], "id long, embedding array<float>")
    assert [r["id"] for r in retrieval.top_k(rows, [1.0, 0.0], "id").collect()] == [1, 3, 5, 7]


@pytest.mark.parametrize(("current", "block", "takes"), [(100, 150, True), (200, 400, True), (300, 100, False), (250, 101, False), (0, 750, True), (249, 502, False)])
def test_absorb(spark, current, block, takes):
    assert value(spark, CONFIG.can_absorb(F.lit(current), F.lit(block))) is takes


def test_stitch(spark):
    assert value(spark, CONFIG.can_stitch(F.lit(300), F.lit(50))) is True
    assert value(spark, CONFIG.can_stitch(F.lit(500), F.lit(300))) is False


def test_hash_ignores_line_numbers_only(spark):
    h = lambda t: value(spark, text.content_hash(F.lit("a.py"), F.lit(t)))
    one = "File: a\nLines: 1-2\ncode"
    assert h(one) == h(one.replace("1-2", "7-8")) == h(one.replace("\n", "\r\n")) == h(one + "\n")
    assert h(one) != h(one.replace("code", "other")) and h("Lines: \nx") != h("x") and len(h(one)) == 16


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029", max_size=30))
def test_lines(spark, t):
    assert value(spark, text.split_lines(F.lit(t))) == t.splitlines()


def test_masks_and_paths(spark):
    mails = {"ab@x": "a*@x", "a@x": "a*@x", "testuser@example.com": "te******@example.com", "none": "none", "@x": "@x"}
    for mail, masked in mails.items():
        assert value(spark, text.mask_email(F.lit(mail))) == masked
    kept = {"app/models.py": True, "frontend/index.tsx": True, "src/main/Game.java": True, "src/checkout/a.py": False, "latest_news.py": False, "contest/x.py": False, "A.PY": False, "tests/a.py": False, "/lib/types.d.ts": False, "README.md": False}
    for path, keep in kept.items():
        assert value(spark, text.is_source_path(F.lit(path))) is keep and repository.wanted(path) is keep
    assert [value(spark, text.file_extension(F.lit(p))) for p in ("a/b.py", ".py", "a/.py", "a.b/c", "x.min.js")] == [".py", "", "", "", ".js"]


def test_zoned_time(spark):
    at = F.lit("2026-01-05 23:30:00").cast("timestamp")
    assert value(spark, text.zoned_time(at, "Asia/Kolkata")) == "Tuesday, 2026-01-06 05:00:00 +0530"
    assert value(spark, text.zoned_time(at, "America/New_York")) == "Monday, 2026-01-05 18:30:00 -0500"


# --- chunks -----------------------------------------------------------------------------------

BLOCK = "filepath string, symbol_type string, start_line int, end_line int, code string, pos int"


def words(n, mark="w"):
    return " ".join(f"{mark}{k}" for k in range(n))


def packed(spark, rows):
    return [tuple(r) for r in packing.pack_chunks(spark.createDataFrame(rows, BLOCK)).orderBy("filepath", "chunk_no").select("symbol_type", "start_line", "end_line", "token_count").collect()]


def test_one_small_class_stands_for_its_file(spark):
    rows = [("a.py", "Class", 1, 9, "class A:\n" + words(50), 0), ("a.py", "Function", 2, 5, words(20), 1), ("a.py", "Function", 20, 25, words(30), 2)]
    out = packing.pack_chunks(spark.createDataFrame(rows, BLOCK)).collect()
    assert [(r["symbol_type"], r["token_count"]) for r in out] == [("Class", 52)] and "Class: " not in out[0]["text"]


def test_methods_of_a_large_class_name_it(spark):
    rows = [("a.java", "Class", 1, 99, "@X\npublic class Deck {\n" + words(800), 0), ("a.java", "Function", 2, 5, words(20), 1)]
    out = packing.pack_chunks(spark.createDataFrame(rows, BLOCK)).collect()
    assert len(out) == 1 and out[0]["text"].startswith("File: a.java\nClass: public class Deck {\nType: Function\nLines: 2-5\n" + "-" * 40 + "\nw0 ")


def test_leftover_is_stitched_onto_a_part(spark):
    rows = [("a.py", "Function", 1, 9, words(800), 0), ("a.py", "Function", 10, 12, words(40), 1)]
    assert packed(spark, rows) == [("Function (Part 1)", 1, 9, 512), ("Function (Part 2)", 1, 12, 352 + 40)]


def test_packs_by_hand(spark):
    rows = [("a.py", "Function", k, k, words(n), k) for k, n in enumerate([200, 100, 100, 400, 30], 1)]
    assert [r["pack"] for r in packing.assign_packs(spark.createDataFrame(rows, BLOCK).withColumn("n_tokens", text.word_count(F.col("code")))).orderBy("place").collect()] == [0, 0, 1, 1, 2]
    assert packed(spark, rows) == [("Function (Group)", 1, 2, 300), ("Function (Group)", 3, 5, 530)]


def test_outermost_class_encloses(spark):
    rows = [("a.py", "Class", 1, 50, "class Outer:", 0), ("a.py", "Class", 5, 20, "class Inner:", 1), ("a.py", "Function", 6, 8, "def f", 2), ("b.py", "Function", 6, 8, "def f", 0)]
    got = {(r["filepath"], r["pos"]): r["enclosing"] for r in blocks.enclosing_classes(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {("a.py", 0): "class Outer:", ("a.py", 1): "class Outer:", ("a.py", 2): "class Outer:", ("b.py", 0): ""}


def test_blocks_of_several_languages(spark):
    files = [
        ("a.py", "class A:\n    def f(self):\n        return 1\n\nasync def g():\n    pass\n"),
        ("b.js", "class B {\n  go(x) {\n    return x;\n  }\n}\nfunction h() {\n  return 1;\n}\nconst k = (x) => {\n  return x;\n};\n"),
        ("C.java", "public class C {\n  public int f(int x) {\n    return x;\n  }\n}\n"),
        ("broken.py", "class D:\n    def f(:\n        pass\n\n    x = 1\n\ndef last(\n"),
        ("quiet.ts", "// class No {\nclass T {\n  /* } */ go() {\n    const s = \"}\" + '{' + `}\n}`;\n  }\n}\n"),
        ("open.js", "function o() {\n  if (x) {\n    return 1;\n"),
        ("none.txt", "class X:"),
        ("empty.ts", ""),
        ("null.py", None),
    ]
    got = {(r["filepath"], r["symbol_type"], r["name"], r["start_line"], r["end_line"]) for r in blocks.extract_blocks(spark.createDataFrame(files, "filepath string, code string")).collect()}
    assert got == {("a.py", "Class", "A", 1, 3), ("a.py", "Function", "f", 2, 3), ("a.py", "Function", "g", 5, 6), ("b.js", "Class", "B", 1, 5), ("b.js", "Function", "go", 2, 4), ("b.js", "Function", "h", 6, 8), ("b.js", "Function", "k", 9, 11), ("C.java", "Class", "C", 1, 5), ("C.java", "Function", "f", 2, 4)} | {("broken.py", "Class", "D", 1, 5), ("broken.py", "Function", "f", 2, 3), ("broken.py", "Function", "last", 7, 7), ("quiet.ts", "Class", "T", 2, 7), ("quiet.ts", "Function", "go", 3, 6), ("open.js", "Function", "o", 1, 3)}


# --- index ------------------------------------------------------------------------------------

STORED, INCOMING = "project_id long, id long, chunk_id string, start_line int, end_line int, text string", "project_id long, pos long, chunk_id string, start_line int, end_line int"


def test_partial_diff_with_duplicates_in_two_projects(spark):
    stored = spark.createDataFrame([(1, 1, "a", 1, 5, "old"), (1, 2, "a", 1, 6, "old"), (1, 3, "gone", 1, 2, "x"), (1, 4, "gone", 1, 2, "x"), (2, 5, "gone", 1, 2, "x"), (2, 6, "a", 7, 8, "x")], STORED)
    now = spark.createDataFrame([(1, 0, "a", 1, 6), (1, 1, "a", 3, 8), (1, 2, "a", 3, 8), (1, 3, "b", 1, 1), (1, 4, "b", 1, 1)], INCOMING)
    found = index.diff(stored, now)
    assert {r["project_id"]: tuple(r)[1:] for r in found.stats().select("project_id", "cached", "new", "deleted", "updated_lines", "active").collect()} == {1: (3, 2, 2, 1, 2), 2: (0, 0, 0, 0, 0)}
    assert sorted(r["id"] for r in found.pruned.collect()) == [3, 4]
    assert sorted(map(tuple, found.stored.collect())) == [(1, 1, "a", 1, 5, "old"), (1, 2, "a", 3, 8, "old"), (2, 5, "gone", 1, 2, "x"), (2, 6, "a", 7, 8, "x")]
    nothing = index.diff(stored, now.limit(0))
    assert nothing.pruned.count() == 0 and nothing.stored.count() == 6


# --- tasks, codes, progress -------------------------------------------------------------------


def test_calendar_text(spark):
    item = "array<struct<title:string,completed:boolean>>"
    rows = [(1, "T, x", "bug", "P", "d", [("a", True), (None, None)]), (2, "U", None, None, "", None)]
    out = calendar.events(spark.createDataFrame(rows, f"id long, title string, ticket_type string, project_name string, description string, subtasks {item}").withColumns({"due_date": F.lit("2026-01-01").cast("timestamp"), "created_at": F.lit("2025-12-01 10:00:00").cast("timestamp")}), F.lit(9), F.lit("2025-12-31").cast("timestamp"))
    got = {r["uid"]: r for r in out.collect()}
    first, second = got["task-1-9@taskapp.local"], got["task-2-9@taskapp.local"]
    assert first["summary"] == "[BUG] T, x" and first["description"] == "Project: P\nDescription: d\nSubtasks:\n  [x] a\n  [ ] " and first["categories"] == "BUG,TASK"
    assert second["summary"] == "U" and second["description"] == "" and second["categories"] == "TASK"
    users = spark.createDataFrame([(9, "Ann; Bo\\" + "é" * 60), (10, "none")], "user_id int, username string")
    feeds = {r["user_id"]: r["value"] for r in calendar.feeds(users, out).collect()}
    assert feeds[10].startswith("BEGIN:VCALENDAR\r\n") and feeds[10].endswith("PT1H\r\nEND:VCALENDAR\r\n")
    lines = feeds[9].split("\r\n")
    assert all(len(x.encode()) <= 75 for x in lines) and feeds[9].count("BEGIN:VEVENT") == 2
    whole = feeds[9].replace("\r\n ", "").split("\r\n")
    assert f"X-WR-CALNAME:Ann\\; Bo\\\\{'é' * 60}'s Tasks" in whole
    assert {"SUMMARY:[BUG] T\\, x", "DTSTAMP:20251231T000000Z", "CREATED:20251201T100000Z", "DTEND:20260101T010000Z", "DESCRIPTION:Project: P\\nDescription: d\\nSubtasks:\\n  [x] a\\n  [ ] "} <= set(whole)


def test_feeds_are_written_by_user(spark, tmp_path):
    feed = spark.createDataFrame([(9, "BEGIN:VCALENDAR\r\nEND:VCALENDAR\r\n"), (10, "x")], "user_id int, value string")
    calendar.write_feeds(feed, f"{tmp_path}/feeds")
    read = spark.read.text(f"{tmp_path}/feeds", wholetext=True).collect()
    assert {r["user_id"]: r["value"].rstrip("\n") for r in read} == {9: "BEGIN:VCALENDAR\r\nEND:VCALENDAR\r", 10: "x"}


def test_embeddings_are_those_of_the_embedder(spark):
    import numpy as np

    texts = ["a b", "", None, "b a c"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").repartition(2)
    got = {r["k"]: r["embedding"] for r in embedding.embed(rows, batch=1).collect()}
    for k, t in enumerate(texts):
        want = embedding.hashing_embedder([t or ""])[0]
        assert np.allclose(got[k], want / (np.linalg.norm(want) or 1), atol=1e-6)


def test_tickets(spark):
    rows = [(1, '{"title":"t"}'), (2, '{"title":"t","ticket_type":"epic"}'), (3, '{"ticket_type":"bug"}'), (4, "no json"), (5, None), (6, '{"title":"t","due_date":"2026-08-18T17:00:00+03:00","subtasks":[{"title":"s"}]}'), (7, '{"title":"t","due_date":"soon"}')]
    got = {r["k"]: r for r in tickets.parse(spark.createDataFrame(rows, "k int, json string")).collect()}
    assert [got[k]["valid"] for k in range(1, 8)] == [True, False, False, False, False, True, False]
    assert got[1]["ticket_type"] == "feature" and got[1]["description"] == "" and got[1]["subtasks"] == [] and got[6]["subtasks"][0]["completed"] is False


def test_cascade_and_search_and_defaults(spark):
    parents, children = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(10, 1), (20, 2), (30, None)], "id int, parent int")
    assert sorted(r["id"] for r in relational.delete_cascade(parents.filter("id = 1"), (children, "parent", "id"))[0].collect()) == [20, 30]
    nested = relational.nest_children(parents, children.filter("parent = 1"), "id", "parent", F.col("id"), "kids")
    assert {r["id"]: r["kids"] for r in nested.collect()} == {1: [10], 2: []}
    assert value(spark, text.falsy_coalesce(F.lit(""), F.lit(None).cast("string"), F.lit("x"))) == "x"


def test_code_checks(spark):
    rows = [(1, "000123", 0, False, 5), (2, "000123", 4, False, 5), (3, "000123", 5, False, 5), (4, "000123", 0, True, 5), (5, "000123", 0, False, -5)]
    made = spark.createDataFrame(rows, "id int, otp_code string, attempts int, is_used boolean, minutes int").withColumn("expires_at", F.current_timestamp() + F.make_dt_interval(mins="minutes"))
    wrong, right = (made.select("id", *(c.alias(n) for n, c in auth.verify(F.lit(code), F.current_timestamp()).items())).orderBy("id").collect() for code in ("9", " 000123\n"))
    assert [r["message"] for r in wrong] == ["Incorrect code. 4 attempts remaining.", auth.TOO_MANY, auth.TOO_MANY, auth.USED, auth.EXPIRED]
    assert [r["attempts_after"] for r in wrong] == [1, 5, 5, 0, 0]
    assert [(r["success"], r["is_used_after"]) for r in right] == [(True, True), (True, True), (False, False), (False, True), (False, False)]


def test_log_tail_of_a_long_log(spark):
    lines = spark.range(0, 500).select((F.col("id") % 2).alias("k"), F.col("id").alias("n"))
    assert sorted(r["n"] for r in progress.log_tail(lines.filter("k = 0"), "k", "n").collect()) == list(range(400, 500, 2))


def test_one_row_or_an_error(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert relational.get_one(rows, F.col("k") == 1)["v"] == "a"
    for k in (2, 3):
        with pytest.raises(relational.NotFound):
            relational.get_one(rows, F.col("k") == k)
    assert relational.first_row(rows.filter("k = 9"), "k").count() == 0
    assert [tuple(r) for r in relational.listing(rows, ("v",), "A b", ("v",)).collect()] == [] and relational.listing(rows, ("v",), facets={"k": None}).count() == 0


def test_retrieval_in_a_project(spark):
    vector = lambda t: embedding.embed_query(t)
    rows = [(1, "a", "a.py", 1, 2, "Function", "red green", vector("red green")), (1, "b", "b.py", 0, 0, "Class", "blue", vector("blue")), (2, "c", "c.py", 1, 2, "Function", "red green", vector("red green"))]
    chunks = spark.createDataFrame(rows, "project_id int, chunk_key string, filepath string, start_line int, end_line int, symbol_type string, text string, embedding array<double>")
    found = retrieval.retrieve(chunks, 1, "red green", embedding.hashing_embedder).orderBy("distance").collect()
    assert [(r["filepath"], r["distance"]) for r in found] == [("a.py", 0.0), ("b.py", 1.0)]
    assert retrieval.retrieve_text(chunks, 1, "red green", embedding.hashing_embedder, k=1) == "--- Code Snippet from a.py (Lines 1-2) ---\nred green\n"

    def never(texts):
        raise AssertionError("a query without chunks is not embedded")

    assert retrieval.retrieve_text(chunks, 3, "red", never) == "" and retrieval.retrieve(chunks, 3, "red", never).count() == 0
    one = embedding.embed(chunks.select("text"), batch=1).collect()
    assert [len(r["embedding"]) for r in one] == [768] * 3


def test_search_in_blocks_is_the_search_in_one(spark):
    rows = spark.createDataFrame([(k, [float(k % 3), float(k % 5), 1.0 if k % 7 else 0.0]) for k in range(60)] + [(60, [0.0, 0.0, 0.0])], "id long, embedding array<float>").repartition(5)
    queries = rows.filter("id % 10 = 0").withColumnRenamed("id", "q")
    one, many = (sorted(map(tuple, retrieval.search_many(rows, queries, "id", "q", k=3, block=b).collect())) for b in (100, 2))
    assert one == many and len(one) == 21
    for q in (0, 10, 60):
        vector = rows.filter(F.col("id") == q).first()["embedding"]
        want = [r["id"] for r in retrieval.top_k(rows, vector, "id", 3).orderBy("distance", "id").collect()]
        assert [i for at, _, i, _ in one if at == q] == want
    assert retrieval.search_many(rows, queries.limit(0), "id", "q").count() == 0


def test_packs_with_another_tokenizer(spark):
    letters = text.Tokenizer(lambda c: F.split(c, ""), F.length, lambda t: F.array_join(t, ""))
    rows = [("a.py", "Function", k, k, "x" * n, k) for k, n in enumerate([200, 100, 100, 800], 1)]
    got = packing.pack_chunks(spark.createDataFrame(rows, BLOCK), tokenizer=letters).orderBy("chunk_no").collect()
    assert [(r["symbol_type"], r["token_count"]) for r in got] == [("Function (Group)", 302), ("Function", 100), ("Function (Part 1)", 512), ("Function (Part 2)", 352)]
    assert got[3]["text"].endswith("\n" + "x" * 352)


def _stream_rows(n, start, at):
    return [(1, at + k, start + k, k % 100, "parsing", f"step {start + k}", f"log {start + k}", "m" if k == 0 else "", k % 3) for k in range(n)]


def _streamed(spark, tmp_path, batches, ttl_ms=None, pause=0.0):
    import time

    from cinderlake.streaming.progress import live_progress

    fields = "project_id long, micros long, seq long, progress int, stage string, current_step string, new_log string, model string, chunk_count int"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, states = f"{tmp_path}/in", []
    made = lambda rows: spark.createDataFrame(rows, fields).withColumn("event_time", F.timestamp_micros("micros")).drop("micros")
    stream = spark.readStream.schema(made([]).schema).parquet(source + "/*")
    query = None
    for k, rows in enumerate(batches):
        made(rows).coalesce(1).write.parquet(f"{source}/{k}")
        query = query or live_progress(stream, ttl_ms).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").foreachBatch(lambda batch, n: states.extend(batch.collect())).start()
        if ttl_ms is None:
            query.processAllAvailable()
        else:  # waits for its expiries, so that nothing is ever all that is available
            before, end = len(states), time.time() + 60
            while len(states) == before and time.time() < end:
                time.sleep(0.2)
            time.sleep(pause)
    query.stop()
    return states


def test_late_updates_replace_only_older_ones(spark, tmp_path):
    last = _streamed(spark, tmp_path, [_stream_rows(120, 1000, 5_000_000), _stream_rows(120, 0, 1_000_000)])[-1]
    assert last["current_step"] == "step 1119" and last["model"] == "m" and last["chunk_count"] == 2
    assert last["logs"] == [f"log {k}" for k in range(1070, 1120)]


def test_a_state_expires(spark, tmp_path):
    states = _streamed(spark, tmp_path, [_stream_rows(3, 0, 1_000), _stream_rows(2, 10, 9_000_000)], ttl_ms=1_000, pause=2.5)
    assert [s["logs"] for s in states if s["logs"]] == [["log 0", "log 1", "log 2"], ["log 10", "log 11"]]


def test_a_run_folder_is_made_once(spark):
    from cinderlake.session import run_dir, shared_path

    assert run_dir(spark) == run_dir(spark) and shared_path(spark, "x").startswith(run_dir(spark)) and spark.sparkContext.applicationId in run_dir(spark)


def test_jdbc_options(spark, monkeypatch):
    asked = {}

    class Reader:
        def format(self, kind):
            asked["format"] = kind
            return self

        def options(self, **options):
            asked.update(options)
            return self

        def load(self):
            return asked

    class Session:
        read = Reader()

    assert tables.jdbc_table(Session(), "jdbc:x", "t", "id", 0, 9, 3) == {"format": "jdbc", "url": "jdbc:x", "dbtable": "t", "partitionColumn": "id", "lowerBound": 0, "upperBound": 9, "numPartitions": 3}


# --- repository source ------------------------------------------------------------------------


class _Answers(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        tree = [{"path": p, "type": t} for p, t in (("src", "tree"), ("src/a.py", "blob"), ("tests/b.py", "blob"), ("src/old.js", "blob"), ("src/gone.ts", "blob"))]
        found = {"/repos/o/n/git/trees/main?recursive=1": json.dumps({"tree": tree}), "/o/n/main/src/a.py": "x = 1\n", "/o/n/master/src/old.js": "let y;\n"}.get(self.path)
        self.send_response(200 if found else 404)
        self.end_headers()
        self.wfile.write((found or "").encode())

    def log_message(self, *args):
        pass


def test_repository_source(spark):
    server = HTTPServer(("127.0.0.1", 0), _Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(repository.RepositorySource)
    read = lambda repo: spark.read.format("repository").option("repo", repo).option("api", base).option("raw", base).load()
    assert [tuple(r) for r in read("o/n").orderBy("pos").collect()] == [("o/n", 0, "src/a.py", "x = 1\n"), ("o/n", 1, "src/old.js", "let y;\n"), ("o/n", 2, "src/gone.ts", "")]
    assert read("o/missing").count() == 0
    server.shutdown()
