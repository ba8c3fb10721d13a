"""Operators that SQL cannot express, against brute force and small cases."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corvane.functions import elements as E, repair, rules, tables as T, text as X
from corvane.operators import chunking, indexes, records, serving
from corvane.plans import registry

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).collect()[0]["x"]


def admits(times, limit, window):
    kept, out = [], []
    for t in times:
        ok = sum(t - x <= window for x in kept) < limit
        out.append(ok)
        kept += [t] if ok else []
    return out


def test_limiters_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").collect()
    by_user = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
        by_user[r["user_id"]].append(r)
    wanted = {r["event_id"]: ok for own in by_user.values() for r, ok in zip(own, admits([r["us"] / 1e6 for r in own], 3, 86400))}
    assert not all(wanted.values())
    for name in ("rate_limit_user", "stream_rate_limit"):
        assert {r["event_id"]: r["admitted"] for r in registry.queries()[name](spark, DATA).collect()} == wanted
    order = sorted(rows, key=lambda r: (r["us"], r["event_id"]))
    passed = dict(zip((r["event_id"] for r in order), admits([r["us"] / 1e6 for r in order], 20, 86400)))
    keyed = {}
    for own in by_user.values():
        own = [r for r in own if passed[r["event_id"]]]
        keyed |= dict(zip((r["event_id"] for r in own), admits([r["us"] / 1e6 for r in own], 2, 86400)))
    want = {e: "overall" if not ok else "admitted" if keyed[e] else "key" for e, ok in passed.items()}
    assert {r["event_id"]: r["verdict"] for r in registry.queries()["rate_limit_two_level"](spark, DATA).collect()} == want


def test_limiter_takes_null_keys(spark):
    events = spark.createDataFrame([(None, 0.0, 1), (None, 1.0, 2), ("a", 1.0, 3)], "key string, t double, event_id long")
    assert {r["event_id"]: r["admitted"] for r in records.admitted(events, 1, 60).collect()} == {1: True, 2: False, 3: True}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!\n", max_size=4000), st.integers(20, 200))
def test_chunks_keep_every_letter_in_order(text, size):
    base = chunking.split_text(text, size, 0)
    plain = "".join(c for c in text if c.isalpha())
    got = "".join(c for c in "".join(base) if c.isalpha())
    it = iter(plain)
    assert all(c in it for c in got)  # a subsequence: noise and tiny chunks may go
    assert all(chunking.estimate(c) >= chunking.LEAST for c in base)


def test_chunk_bounds():
    assert chunking.split_text(None) == chunking.split_text("") == chunking.split_text("x" * 49) == []
    text = "\n\n".join(f"Paragraph number {k} with some words in it." * 8 for k in range(12))
    parts = chunking.split_text(text)
    assert len(parts) > 1 and parts[1].startswith(chunking.tail(parts[0], chunking.OVERLAP))
    assert max(map(len, chunking.split_text("y" * 5000, overlap=0))) <= chunking.longest_for(chunking.SIZE)
    assert [len(c) for c in chunking.split_text("y" * 3000, 100, 0)] == [250] * 12
    assert chunking.packed([30, 30, 300], 30) == [(0, 2), (2, 3)]
    assert chunking.split_text("12 34 56\n" * 20) == []  # noise


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=20), st.integers(1, 200))
def test_packing_is_greedy(lengths, budget):
    want, first, joined = [], 0, 0
    for k, n in enumerate(lengths):
        if k > first and chunking.tokens_of(joined + 2 + n) > budget:
            want.append((first, k))
            first, joined = k, n
        else:
            joined = joined + 2 + n if k > first else n
    assert chunking.packed(lengths, budget) == want + [(first, len(lengths))] * bool(lengths)


def test_noise_twins(spark):
    texts = ["", "  ", "12.", "x = 5", "ab", "a1 = 2", "изме-", "слово-", "--- 123456789012345678901", "50%x", "∑", "α", "два слова", "a" * 40, "1 + 2"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.is_noise(F.col("t")).alias("a"), X.is_noise(F.col("t"), 0).alias("b")).collect()
    assert [(r["t"], r["a"], r["b"]) for r in rows] == [(t, X.noisy(t), X.noisy(t, 0)) for t in texts]
    assert not X.noisy("x = 5") and X.noisy("2 + 2 = 4") and X.noisy("изме-")


def test_garbage_lines(spark):
    lines = ["ю отл л еге оте кн рь а д ёво л нж а е", "| ю отл л еге оте кн рь а д ёво |", "Обычная строка текста здесь и дальше.", "a b c d e f g h i j k l m", "12 34 56 78 90 11 12", None, "", "bc df gh jk lm np qr st"]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in lines], "t string").select(X.is_garbage_line(F.col("t")).alias("x")).collect()]

    def brute(line):
        t = (line or "").strip(" ")
        n = [c for c in t if c.isalpha()]
        words = [w for w in t.split() if any(map(str.isalpha, w))]
        if t.startswith("|") or len(n) < 12 or len(words) < 6:
            return False
        short, average = sum(len(w) <= 2 for w in words) / len(words), sum(map(len, words)) / len(words)
        vowels = sum(c in "аеёиоуыэюяaeiouy" for c in t.lower()) / len(n)
        return (short >= 0.55 and average <= 3.2) or (average <= 2.6 and vowels < 0.30)

    assert got == [brute(x) for x in lines] and sum(got) >= 2


def brute_pieces(table, longest):
    if len(table) <= longest:
        return [table]
    head, rows = table.split("\n")[:2], table.split("\n")[2:]
    out, now = [], []
    for r in rows:
        if now and len("\n".join(head + now + [r])) > longest:
            out.append("\n".join(head + now))
            now = []
        now.append(r)
    return [*out, "\n".join(head + now)]


def test_table_pieces(spark):
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {k} | {'x' * (k * 7 % 90)} |" for k in range(60))
    for longest in (60, 100, 400, 100_000):
        assert one(spark, T.pieces(F.col("t"), longest), t=table) == brute_pieces(table, longest)
    parts = chunking.split_tables(spark.createDataFrame([("t", "| a | b |\n" + "| 1 | 2 |\n" * 700)], "table_id string, content string")).orderBy("table_part").collect()
    assert len(parts) == parts[0]["table_parts"] > 1 and all(p["content"].startswith("| a | b |\n| --- | --- |\n") for p in parts)


@pytest.mark.parametrize(
    ("text", "formula"),
    [("F = m * 9.8", True), ("сумма \\frac{a}{b} равна", True), ("220±11 В", False), ("заряд 95% батареи", False), ("№ 19/204-6 от комиссии", False), ("12 января 2024", False), ("Рисунок 3 = 4", False), ("обычный текст без чисел", False), ("", False), (None, False), ("x" * 300 + " a = 5", True)],
)
def test_formulas(spark, text, formula):
    assert one(spark, E.is_formula(F.col("t")), t=text) is formula


def test_formula_spans(spark):
    text = "a $$x+y$$ b $z^2$ c\nsum q = 5 here\n| t = 5 |"
    assert [(f["content"], f["formula_type"]) for f in one(spark, E.formulas(F.col("t")), t=text)] == [("x+y", "latex_block"), ("z^2", "latex_inline"), ("sum q = 5 here", "suspected_formula")]


def test_repair(spark):
    assert one(spark, repair.fix_homoglyphs(F.col("t")), t="кoрпуc Code cКода") == "корпус Code сКода"
    assert one(spark, repair.replaced(F.col("t")), t="1l2 и 3O4, N° 5 TOTO") == "112 и 304, N° 5 того"
    assert repair.segment("нажатькнопкупитания", {"нажать": 1.0, "кнопку": 1.0, "питания": 1.0}) == ["нажать", "кнопку", "питания"]
    assert repair.segment("нажатькнопку", {"нажать": 1.0}) is None
    noisy = "Обычная строка текста здесь.\nю отл л еге оте кн рь а д ёво л нж а е"
    assert one(spark, repair.deep_clean(F.col("t")), t=noisy) == "Обычная строка текста здесь."
    assert one(spark, repair.normalized(F.col("t")), t="passage: query: сло-\nво <b>и</b>\n\n\n\nещё «тут»") == "слово и\n\nещё тут"
    assert one(spark, repair.normalized(F.col("t")), t=None) == ""


def test_captions_and_small_talk(spark):
    weak = [one(spark, E.is_weak_caption(F.col("t")), t=t) for t in ("", None, "Изображение 5 на странице из руководства по эксплуатации", "общий вид", "Расположение разъёмов питания на задней стенке корпуса")]
    assert weak == [True, True, True, True, False]
    assert one(spark, rules.small_talk(F.col("t")), t=None) is None


def test_messages(spark):
    text = ("abc. " * 30 + "\n\n") * 5
    parts = serving.split_message(text, 200)
    assert all(len(p) <= 200 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())
    assert serving.split_message(None) == serving.split_message("  ") == [""]
    assert max(map(len, serving.split_message("z" * 450, 200))) == 200
    rows = registry.queries()["message_parts"](spark, DATA).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: x["content"]), "").alias("joined")).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    assert rows.where(F.regexp_replace("joined", r"\s", "") != F.regexp_replace("text", r"\s", "")).count() == 0


def test_import_rules(spark):
    own = spark.createDataFrame([("a", "x", "s", 1), ("a", "y", "s", 2), ("b", "x", "s", 3), ("c", None, None, 4), ("d", None, None, 5)], "chunk_id string, content string, source string, n long")
    kept = indexes.first_of_group(own.withColumn("page", F.lit(0)).withColumn("chunk_type", F.lit("text")), F.col("n")).orderBy("n").collect()
    assert [r["n"] for r in kept] == [1, 2, 4] and kept[0]["chunk_id"] == "a" and kept[1]["chunk_id"].startswith("a_")
    assert indexes.incompatible({"model": "m ", "query_prefix": "q"}, {"model": "m", "query_prefix": ""}) == ["query_prefix"]
    lines = spark.createDataFrame([('{"id":"1","text":"t","metadata":{"page":"3"}}',), ('{"id":"2"}',), ('{"content":"c"}',), ("broken",), (None,)], "value string")
    got = indexes.coerced(lines).orderBy("chunk_id").collect()
    assert [(r["chunk_id"][:4], r["content"], r["page"]) for r in got] == [("1", "t", 3), ("rec_", "c", 0)] and got[1]["chunk_id"] == "rec_" + hashlib.sha256(b"c").hexdigest()[:16]


def test_cache_entries_serve_their_facet(spark):
    cache = spark.createDataFrame([("h1", [1.0, 0.0], "a", 0), ("h2", [0.9, 0.1], "b", 0)], "query_hash string, embedding array<double>, facet string, hit_count int").withColumn("created_at", F.current_timestamp())
    asked = spark.createDataFrame([(1, [1.0, 0.05], "b"), (2, [0.0, 1.0], "a"), (3, [1.0, 0.0], "c")], "query_id long, query_embedding array<double>, facet string")
    hits = serving.cache_lookup(asked, cache)
    assert [(r["query_id"], r["query_hash"]) for r in hits.collect()] == [(1, "h2")]
    assert {r["query_hash"]: r["hit_count"] for r in serving.cache_with_hits(cache, hits).collect()} == {"h1": 0, "h2": 1}
