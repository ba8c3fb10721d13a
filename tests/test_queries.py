"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from corvane.operators import records
from corvane.plans import registry
from corvane.sources.jsonl import repair_lines

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted(tuple(str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df())


def matches_sql(spark, folder, name, table, rows, schema):
    """A query against its SQL over a table of odd rows."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = sorted(map(repr, map(tuple, registry.queries()[name](spark, str(folder)).collect())))
    assert got == sorted(map(repr, con.sql(registry.oracle_sql()[name]).fetchall()))


def test_mentions_at_line_ends(spark, tmp_path):
    texts = ["Twenty-nine characters it has.\n", "one\n", " one \n ", "\tone\t", "\n one", "one\r\n", "one \u2028", "\u00a0one\u00a0", "", " ", "\n", None]
    rows = [(conv, turn, "user", t) for conv in (1, 2) for k, t in enumerate(texts) for turn in range(3 * k, 3 * k + 3)]
    matches_sql(spark, tmp_path, "mention_strip", "conversations", rows, "conv_id long, turn long, role string, text string")


#: Texts whose replacements touch, or that end at separators other than a line end.
DAMAGED = ("No No No No", "x No\nNo No. No.5", "N° 5, N°5 No²", "toto toto toto", "²toto", "БЮЛЛЕТЕНЬ]БЮЛЛЕТЕНЬ] бюллетенb", "установяичный Установяич", "1l2l3O4 сенсорнь!й сенсорнь|й", "one \u2028", "one\n\u2028", "", "\n", None)


def test_touching_replacements_in_deep_clean(spark, tmp_path):
    matches_sql(spark, tmp_path, "deep_clean", "documents", list(enumerate(DAMAGED)), "doc_id long, text string")


def test_touching_replacements_in_normalize_ocr(spark, tmp_path):
    matches_sql(spark, tmp_path, "normalize_ocr", "pages", list(enumerate(DAMAGED)), "page_id long, html string")


def test_rate_limit_counts_only_admitted(spark):
    events = spark.createDataFrame([("a", float(t), k) for k, t in enumerate((0, 1, 2, 60, 61, 62))], "key string, t double, event_id long")
    got = {r["event_id"]: r["admitted"] for r in records.admitted(events, 2, 60).collect()}
    # the event exactly 60 s old still counts; the denied ones do not
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}


def test_jsonl_damage():
    lines = ['{"a": 1}', 'junk {"a": 2}', '{"a": 3}{"a": 4}', '{"a":', '5}', '"a": 6}', "nothing"]
    got = [(n, s) for n, s, _ in repair_lines(lines)]
    assert got == [(1, "ok"), (2, "repaired"), (3, "split"), (3, "split"), (4, "recovered"), (6, "repaired"), (7, "unrecoverable")]
