"""Index, search, engine, models, streams and bundles against brute force and small cases."""

import json
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import storage
from corvane.api import Service
from corvane.engine import Engine, Settings
from corvane.functions import chat, paths
from corvane.operators import answering, bundle, indexes, models, ordered, postings, records, retrieval as R, serving
from corvane.plans import registry
from corvane.sources import pages
from corvane.streaming import events as S, longpoll


def home(tmp_path, name="home"):
    return f"file://{tmp_path}/{name}"


def test_lexical_index_equals_fts5(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = ["common", "belt", "lamp", "paper", "scan", "print", "motor", "cable"]
    texts = [" ".join(["common"] * int(rng.integers(0, 3)) + rng.choice(words[1:], rng.integers(1, 12)).tolist()) for _ in range(60)] + ["", None, "!!!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    index = postings.LexicalIndex(spark, home(tmp_path)).write(docs)
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(k + 1, t) for k, t in enumerate(texts) if t and "!" not in t])
    asked = [(1, "common belt"), (2, "lamp motor cable lamp"), (3, "nothing"), (4, ""), (5, None), (6, " ".join(["belt"] * 20 + ["lamp"]))]
    got = {}
    for r in index.search(spark.createDataFrame(asked, "query_id long, query string"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["score"]))
    for k, terms in ((1, "common OR belt"), (2, "lamp OR motor OR cable"), (6, "belt")):
        want = {row - 1: -s for row, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (terms,))}
        top = sorted(want, key=lambda d: (-round(want[d], 6), d))[:10]
        assert [c for _, c, _ in sorted(got[k])] == top
        assert all(abs(want[c] - s) < 1e-5 for _, c, s in got[k])
    assert set(got) == {1, 2, 6}
    empty = postings.LexicalIndex(spark, home(tmp_path, "none")).write(docs.where("chunk_id > 100"))
    assert empty.search(spark.createDataFrame(asked, "query_id long, query string")).count() == 0
    index.upsert(spark.createDataFrame([(0, "unique words"), (1, "")], "chunk_id long, content string"))
    again = index.search(spark.createDataFrame([(1, "unique")], "query_id long, query string")).collect()
    assert [r["chunk_id"] for r in again] == [0] and index.table("documents").where("chunk_id = 1").count() == 1


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vectors_against_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(300, None), (301, [1.0]), (302, [1.0, None, 0.0, 0.0])]
    q = rng.integers(-2, 3, (7, 4)).astype(float)
    asked = spark.createDataFrame([(j, v.tolist(), j) for j, v in enumerate(q)] + [(9, None, 5)], "query_id long, query_embedding array<double>, k long")
    got = {}
    for r in R.vector_topk(spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(5), asked, metric=metric).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for j, v in enumerate(q):
        norm = np.linalg.norm(x, axis=1) * np.linalg.norm(v)
        score = ((x - v) ** 2).sum(1).round(6) if metric == "l2" else -np.divide(x @ v, norm, out=np.zeros(300), where=norm > 0).round(6)
        assert got.get(j, []) == sorted(range(300), key=lambda k: (score[k], k))[:j]


def test_fusion_golden(spark):
    leg = lambda rows: spark.createDataFrame(rows, "query_id long, chunk_id string, rank long, payload string")
    out = R.fuse(leg([(1, "both", 2, "v"), (1, "vector", 1, "v")]), leg([(1, "both", 1, "l"), (1, "lexical", 2, "l"), (2, "b", 1, "l"), (2, "a", 1, "l")])).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["payload"]) for r in out] == [(1, "both", "l"), (1, "vector", "v"), (1, "lexical", "l"), (2, "a", "l"), (2, "b", "l")]
    assert abs(out[0]["score"] - (0.6 / 62 + 0.4 / 61)) < 1e-9 and out[1]["lexical_rank"] is None
    tie = R.fuse(leg([(1, "z", 1, "v")]), leg([(1, "a", 1, "l")]), alpha=0.5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in tie] == ["z", "a"]  # equal scores: the vector leg first


@pytest.mark.parametrize(("exact", "strict", "want"), [(1, True, ["e0", "x", "u"]), (2, True, ["e0", "e1", "x"]), (2, False, ["e0", "e1", "x", "u"])])
def test_policy_golden(spark, exact, strict, want):
    rows = [(1, "u", "unknown", "m", "manual", 1), (1, "x", "other", "m", "legal", 2), (1, "o", "other", "m", "manual", 3)] + [(1, f"e{k}", "m", "m", "manual", 4 + k) for k in range(exact)]
    own = spark.createDataFrame(rows, "query_id long, chunk_id string, facet string, wanted string, category string, rank int")
    assert [r["chunk_id"] for r in R.facet_policy(own, strict).orderBy("position").collect()] == want
    free = own.withColumn("wanted", F.lit(None).cast("string"))
    assert [r["chunk_id"] for r in R.facet_policy(free, strict).orderBy("position").collect()][:2] == ["u", "x"]


def test_neighbours_golden(spark):
    rows = [("s", 0, "text", "a b"), ("s", 1, "table", "| t |"), ("s", 2, "text", "c"), ("s", 3, "text", "d"), ("t", 4, "text", "e"), ("s", 9, "text", "z"), ("s", None, "text", "n")]
    own = spark.createDataFrame(rows, "source string, seq long, chunk_type string, content string")
    got = {(r["source"], r["seq"]): (r["content"], r["context_expanded"]) for r in R.neighbours(own, own).collect()}
    assert got == {("s", 0): ("a b", False), ("s", 1): ("| t |", False), ("s", 2): ("c\nd", True), ("s", 3): ("c\nd", True), ("t", 4): ("e", False), ("s", 9): ("z", False), ("s", None): ("n", False)}
    cut = R.neighbours(own, own.withColumn("content", F.lit("word " * 9)), 1, 20).where("seq = 3").first()
    assert cut["content"] == "word word word word…"


def test_running_values_against_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(k if (k := int(rng.integers(0, 9))) else None, n, int(v) if (v := rng.integers(0, 5)) else None) for n in range(900)] + [(77, 1000 + n, n % 3 or None) for n in range(900)]
    frame = spark.createDataFrame(rows, "key long, ord long, v long").repartition(7)
    keyed = {}
    for key, n, v in sorted(rows, key=lambda r: r[1]):
        keyed.setdefault(key, []).append((n, v))
    want = {}
    for key, own in keyed.items():
        total, last, before = 0, None, None
        for n, v in own:
            total, last = total + (v or 0), v if v is not None else last
            want[n] = (total, last, None if before is None else (before[0],))
            before = (v,)
    a = {r["ord"]: r["x"] for r in ordered.running_sum(frame, F.coalesce("v", F.lit(0)), "key", "ord", "x").collect()}
    b = {r["ord"]: r["x"] for r in ordered.last_known(frame, F.col("v"), "key", "ord", "x").collect()}
    c = {r["ord"]: None if r["x"] is None else tuple(r["x"]) for r in ordered.with_previous(frame, F.col("v"), "key", "ord", "x").collect()}
    assert {n: (a[n], b[n], c[n]) for n in want} == want
    pages_ = spark.createDataFrame([("f", 1, None, "w", 0.7), ("f", 2, "A", "w", 0.9), ("f", 3, None, "B", 0.9), ("f", 4, "B", "x", 0.1), ("g", 1, None, "w", 0.5)], "f string, p long, strong string, weak string, sure double")
    got = records.sticky(pages_, "strong", "weak", "sure", "f", "p").orderBy("f", "p").collect()
    assert [r["facet"] for r in got] == ["w", "A", "A", "B", "unknown"]


TEXTS = {
    "guide.txt": "Сканер бумаги включается зелёной кнопкой на передней панели устройства.\n\nЗатем проверьте питание и кабель, прежде чем продолжать работу со сканером.",
    "other.md": "The printer prints paper sheets quickly and quietly, page after page, all day long.",
}


@pytest.fixture
def library(tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, text in TEXTS.items():
        (docs / name).write_text(text)
    old = tmp_path / "old"
    old.mkdir()
    records_ = [{"chunk_id": f"c{k}", "content": f"passage: imported text number {k} about belts and motors of the machine", "metadata": {"source": "old.pdf", "page": k}} for k in (1, 2, 2)]
    (old / "chunks_a.jsonl").write_text("\n".join(["junk " + json.dumps(records_[0]), json.dumps(records_[1]) + json.dumps(records_[2]), "nothing"]))
    return tmp_path


def test_engine_end_to_end(spark, library, tmp_path):
    engine = Engine(spark, home(tmp_path), Settings(embedding="hashing"))
    plan = lambda: {(r["key"].rsplit("/", 1)[-1], r["action"]) for r in engine.ingest_all(str(library / "docs"), str(library / "old")).collect()}
    assert not engine.ready()["ready"]
    assert plan() == {("guide.txt", "read"), ("other.md", "read"), ("chunks_a.jsonl", "read")}
    assert engine.ready() == {"ready": True, "lexical": True, "vectors": True, "store": True}
    store = engine.table("store")
    assert {r["source"] for r in store.collect()} == {"guide.txt", "other.md", "old.pdf"} and store.where("content LIKE 'passage:%'").count() == 0
    assert plan() == {("guide.txt", "keep"), ("other.md", "keep"), ("chunks_a.jsonl", "keep")}
    (library / "docs" / "new.txt").write_text("A completely new document about folding machines and their rollers.")
    assert ("new.txt", "read") in plan() and engine.table("store").where("source = 'new.txt'").count() == 1
    (library / "docs" / "other.md").unlink()
    assert plan() == {("guide.txt", "read"), ("other.md", "drop"), ("new.txt", "read"), ("chunks_a.jsonl", "read")}
    assert engine.table("store").where("source = 'other.md'").count() == 0

    asked = spark.createDataFrame([(1, "u", "Как включается сканер бумаги?"), (2, "u", ""), (3, "u", "zzz qqq")], "query_id long, user_id string, query string")
    found = engine.search(asked.where("query_id = 1"), 2).orderBy("rank").collect()
    assert found[0]["source"] == "guide.txt" and {r["position"] for r in found} == {1, 2}
    kept = spark.createDataFrame([(found[0]["chunk_id"], 0)], "chunk_id string, reviewed int")
    assert found[0]["chunk_id"] not in {r["chunk_id"] for r in engine.search(asked.where("query_id = 1"), 2, quarantine=kept).collect()}
    answers = engine.answer(asked, 2, answering.Models(embed=models.provider("embedding", "hashing"))).collect()
    by = {r["query_id"]: r for r in answers}
    assert by[2]["answer"] == "Пустой запрос." and by[2]["status"] == "review"
    assert "[Документ: guide.txt, стр. 1]" in by[1]["answer"] and by[1]["status"] == "approved" and by[1]["sources"][0]["document"] == "guide.txt"
    cache = answering.to_cache(spark.createDataFrame([tuple(by[1])], "query_id long, user_id string, query string, search_query string, facet string, answer string, status string, sources array<struct<document: string, page: bigint, heading: string, chunk_type: string, score: double>>, from_cache boolean, query_embedding array<double>"), F.current_timestamp())
    cache = cache.withColumn("query_hash", serving.query_key(F.col("query"))).withColumn("hit_count", F.lit(0))
    hit = engine.answer(asked.where("query_id = 1"), 2, answering.Models(embed=models.provider("embedding", "hashing")), cache=cache).first()
    assert hit["from_cache"] and hit["answer"] == by[1]["answer"]
    assert engine.verify().first()["status"] == "ok"
    assert engine.export(str(tmp_path / "out")).count() == engine.table("store").count()

    for to in (home(tmp_path, "bundle"), f"{tmp_path}/b.zip"):
        assert engine.pack(to) > 3
        copy = Engine(spark, home(tmp_path, "copy"), Settings(embedding="hashing", query_prefix="other"))
        assert copy.unpack(to) == ["query_prefix"]
        assert copy.table("store").count() == engine.table("store").count() and copy.lexical.exists()
        with pytest.raises(FileExistsError):
            copy.unpack(to)
        storage.delete(spark, copy.home)
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("output/../../x", "x")
    with pytest.raises(ValueError, match="unsafe"):
        Engine(spark, home(tmp_path, "bad")).unpack(f"{tmp_path}/bad.zip")
    assert bundle.unsafe(["a/b", "../a", "/a", "c:/x", "a\\..\\b"]) == ["../a", "/a", "c:/x", "a\\..\\b"]

    service = Service(engine, code="code", secret="s")
    assert service.handle("GET", "/health")[0] == 200 and json.loads(service.handle("GET", "/ready")[2])["status"] == "ready"
    status, headers, body = service.handle("POST", "/query", json.dumps({"query": "сканер бумаги", "top_k": 2}))
    assert status == 200 and "X-Process-Time" in headers and json.loads(body)["sources"]
    assert service.handle("POST", "/query", json.dumps({"query": "x", "top_k": 11}))[0] == 422 and service.handle("POST", "/query", "{")[0] == 422
    assert service.handle("POST", "/callback", '{"type": "confirmation", "secret": "s"}')[2] == '"code"' and service.handle("POST", "/callback", "junk")[2] == '"ok"'
    assert service.handle("GET", "/nowhere")[0] == 404


def test_rebuild_report(spark, library, tmp_path):
    engine = Engine(spark, home(tmp_path))
    row = engine.rebuild(str(library / "old"), dry=True).first()
    assert (row["records_in"], row["fixed_prefix"], row["kept"], row["deduplicated"], row["objects_split"], row["objects_repaired"], row["unrecoverable"]) == (3, 3, 2, 1, 2, 1, 1)
    assert not engine.ready()["store"]
    engine.rebuild(str(library / "old"))
    assert engine.table("store").count() == 2 and engine.ready()["ready"]


def test_models(spark):
    a, b = models.hashing_embedder()(["passage: Сканер бумаги", "сканер бумаги"])
    assert a == b and abs(np.linalg.norm(a) - 1) < 1e-9
    with pytest.raises(ValueError, match="hashing"):
        models.provider("embedding", "none")
    rows = spark.createDataFrame([("q", "answer one", "ctx", "answer one"), ("q", "two", "ctx", None)], "question string, answer string, context string, reference string")
    judge = models.canned(json.dumps({"только сведения": "Оценка 8", "на вопрос": "11, нет, 5", "доля": "плохо", "Эталон": "10"}))
    got = models.judged(rows, judge).orderBy("answer").collect()
    assert [(r["faithfulness"], r["answer_relevancy"], r["context_precision"], r["context_recall"], r["token_f1"], r["has_reference"]) for r in got] == [(0.8, 0.5, 0.0, 1.0, 1.0, True), (0.8, 0.5, 0.0, 0.0, 0.0, False)]
    verdicts = models.factual(rows, models.canned(json.dumps({"answer one": 'So: {"is_factual": false, "issues": []}', "two": "broken"}))).orderBy("answer").collect()
    assert [r["factual"] for r in verdicts] == [False, True]
    figures = spark.createDataFrame([("1", "Изображение 3", "a"), ("2", "общий вид", "a"), ("3", "Подробная подпись к рисунку, которая длиннее сорока знаков", "a"), ("4", "", "b"), ("5", "см.", "a")], "chunk_id string, content string, image_path string")
    seen = models.captioned(figures, spark.createDataFrame([("a", bytearray(b"x"))], "image_path string, data binary"), lambda: lambda pictures: ["описание"] * len(pictures), 2).orderBy("chunk_id").collect()
    assert [(r["content"], r["vision_caption"]) for r in seen][:2] == [("описание", True), ("общий вид. описание", True)] and not any(r["vision_caption"] for r in seen[2:])
    history = spark.createDataFrame([("u", 1, "user", "про сканер"), ("u", 2, "assistant", "ответ"), ("v", 1, "user", "x")], "user_id string, nth int, role string, content string")
    asked = spark.createDataFrame([(1, "u", "а какая у него мощность?"), (2, "u", "мощность сканера"), (3, "v", "а он?")], "query_id long, user_id string, query string")
    new = models.rewritten(asked, history, models.canned(json.dumps({"про сканер": "какая мощность у сканера"}))).orderBy("query_id").collect()
    assert [r["search_query"] for r in new] == ["какая мощность у сканера", "мощность сканера", "а он?"]


def test_reminder_and_rejection(spark):
    found = spark.createDataFrame([(1, "сканер не работает совсем", "g.pdf", 3, "", "text", 0.5, 1, 1)], "query_id long, content string, source string, page long, heading string, chunk_type string, score double, rank long, position long")
    asked = spark.createDataFrame([(1, "u", "сканер не работает")], "query_id long, user_id string, query string")
    judge = models.canned(json.dumps({"generated_answer": '{"is_factual": false}'}))
    row = answering.answered(asked, lambda q: found, answering.Models(generate=models.canned(json.dumps({"retrieved_context": "Длинный ответ, который не подтверждается ничем в документах вовсе."})), judge=judge), "Сообщите председателю комиссии на горячую линию по регламенту.").first()
    assert row["status"] == "rejected" and row["answer"].startswith(chat.BLOCKED) and row["answer"].endswith("регламенту.")
    nothing = answering.answered(asked, lambda q: found.where("false"), answering.Models(), "R").first()
    assert nothing["status"] == "review" and nothing["answer"] == chat.NOTHING_FOUND + "\n\nR"


class Server:
    """A long-poll server that fails in every way once."""

    script = [{"failed": 1, "ts": "3"}, ConnectionError(), {"failed": 2}, {"ts": "4", "updates": [{"n": 1}]}, {"failed": 3}, ValueError(), {"ts": "8", "updates": [{"n": 2}, {"n": 3}]}]

    def __init__(self):
        self.calls, self.renewed, self.replies = [], 0, iter(self.script)

    def server(self):
        self.renewed += 1
        return {"server": "s", "key": f"k{self.renewed}", "ts": 1}

    def check(self, server, key, ts):
        self.calls.append((key, ts))
        reply = next(self.replies, {"ts": ts, "updates": []})
        if isinstance(reply, Exception):
            raise reply
        return reply


def test_long_poll_protocol():
    server, waits = Server(), []
    poll = longpoll.LongPoll(server, pause=waits.append)
    got = [poll.poll() for _ in range(8)]
    assert [len(x) for x in got] == [0, 0, 0, 1, 0, 0, 2, 0]
    assert server.calls == [("k1", "1"), ("k1", "3"), ("k1", "3"), ("k2", "3"), ("k2", "4"), ("k3", "1"), ("k4", "1"), ("k4", "8")]
    assert waits == [1, 1] and poll.ts == "8"


def test_long_poll_source(spark, tmp_path):
    class Quiet:
        def server(self):
            return {"server": "s", "key": "k", "ts": "0"}

        def check(self, server, key, ts):
            return {"ts": "2", "updates": [{"n": 1}, {"n": 2}]} if ts == "0" else {"ts": ts, "updates": []}

    spark.dataSource.register(longpoll.source(Quiet, "quiet"))
    seen = []
    stream = spark.readStream.format("quiet").load()
    query = S.dispatched(stream, lambda batch, n: seen.extend(r["value"] for r in batch.collect()))
    try:
        for _ in range(60):
            if len(seen) >= 2:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert [json.loads(x)["n"] for x in seen] == [1, 2] and query.exception() is None


def test_conversation_memory(spark, tmp_path):
    rows = [("u", float(k), k, "clear" if k == 4 else "read" if k == 5 else "add", "user", f"m{k}") for k in range(12)] + [(None, 0.0, 100, "add", "user", "x")]
    path = str(tmp_path / "m")
    spark.createDataFrame(rows, "key string, t double, event_id long, op string, role string, content string").write.parquet(path)
    own = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    got = {r["event_id"]: [h["content"] for h in r["history"]] for r in S.drained(S.conversations(own, 3)).collect()}
    assert got[3] == ["m1", "m2", "m3"] and got[4] == got[5] == [] and got[11] == ["m9", "m10", "m11"] and got[100] == ["x"]


def test_streams_of_files_and_folders(spark, tmp_path):
    path, data = tmp_path / "conversations.parquet", "/root/testdata/sf0.001"
    spark.read.parquet(f"{data}/conversations.parquet").repartition(3).write.parquet(str(path))
    ask = registry.queries()["stream_memory"]
    of_file, of_folder = (sorted(map(tuple, ask(spark, d).collect())) for d in (data, str(tmp_path)))
    assert len(of_file) == 87 and of_folder == of_file
    events = tmp_path / "events.parquet"
    spark.createDataFrame([(1, "2024-01-01 00:00:00", "x")], "event_id long, ts string, day string").write.partitionBy("day").parquet(str(events))
    assert [(r["event_id"], r["day"]) for r in S.drained(S.stream_of(spark, str(events))).collect()] == [(1, "x")]


def test_sending(spark):
    rows = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "retry"), ("b", 1, "bad"), ("b", 2, "boom")], "key string, part int, content string")

    def connect():
        tried = set()

        def send(row):
            if row["content"] == "boom":
                raise OSError
            if row["content"] == "retry" and row["part"] not in tried:
                tried.add(row["part"])
                return 6
            return 5 if row["content"] == "bad" else None

        return send

    got = {(r["key"], r["part"]): (r["ok"], r["tries"]) for r in serving.sent(rows, connect, lambda s: None).collect()}
    assert got == {("a", 1): (True, 1), ("a", 2): (True, 2), ("b", 1): (False, 1), ("b", 2): (False, 2)}


def test_page_reader(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"1 Heading\nSome text of the first page, long enough to be kept.\x0c2 Next heading here\nx = 2 + 3")), ("bad.pdf", bytearray(b""))], "name string, content binary")

    def reader():
        def opened(content):
            if not content:
                raise ValueError
            return [{"text": t, "width": 10.0, "height": 10.0} for t in content.decode().split("\x0c")]

        return opened

    got = pages.elements(pages.read_pages(files, reader)).orderBy("ord").collect()
    assert [(r["page"], r["element_type"], r["heading"]) for r in got] == [(1, "heading", "1 Heading"), (1, "text", "1 Heading")]
    assert {r["source"] for r in got} == {"a.pdf"}


def test_keyboards():
    made = json.loads(chat.keyboard([*chat.model_rows([("m1", "One"), ("m2", "Two")], "Any"), chat.back_row("Back")]))
    assert [[b["action"]["label"] for b in row] for row in made["buttons"]] == [["One", "Two"], ["Any"], ["Back"]] and made["inline"] is False
    assert json.loads(made["buttons"][0][0]["action"]["payload"]) == {"cmd": "set_model", "model": "m1"}
    inline = json.loads(chat.keyboard(chat.menu_rows([("A", {"cmd": "help"}), ("B", {"cmd": "nav", "to": "faq"})]), inline=True))
    assert "one_time" not in inline and [r[0]["color"] for r in inline["buttons"]] == ["primary", "secondary"]
    assert json.loads(json.loads(chat.keyboard(chat.faq_rows([("id", "Q")])))["buttons"][0][0]["action"]["payload"]) == {"cmd": "faq", "id": "id"}


def test_relative_paths(spark):
    rows = spark.createDataFrame([("/home/out/figures/a.png",), ("figures/b.png",), (None,)], "p string")
    assert [r[0] for r in rows.select(paths.relative(F.col("p"), "/home/out/")).collect()] == ["figures/a.png", "figures/b.png", ""]
    ids = [r[0] for r in spark.range(50).select(indexes.X.random_id()).collect()]
    assert len(set(ids)) == 50 and all(len(i) == 12 for i in ids)
