"""Files as elements: discovery, fingerprints, text, CSV and DOCX readers, artifact names.

A file is the unit: it is read by one task through ``binaryFile``, its elements
carry an ordinal (``elem_ix``), and no file is brought to the driver.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EXTENSIONS = ("pdf", "docx", "csv", "txt", "md")
#: Characters of a text block, least of one, of a DOCX buffer, rows of a CSV table, share of rows with several columns.
BLOCK, LEAST, BUFFER, ROWS, SHARE, HEAD_ROWS = 12_000, 50, 8_000, 80, 0.35, 300
ELEMENT = "source string, elem_ix long, element_type string, page long, heading string, content string, num_rows long, num_cols long"
Element = tuple[str, int, str, str, int | None, int | None]  # type, page, heading, content, rows, columns
_NUMBERED = re.compile(r"\d+(?:\.\d+)*\s+.+|[А-ЯЁ][А-ЯЁ\s]{2,}")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def discover(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files below a folder with their fingerprint: path, name, kind, size, modified, sha256, content. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = F.lower(F.substring_index("path", ".", -1))
    own = files.select("path", F.substring_index("path", "/", -1).alias("name"), kind.alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")
    return own.where(F.col("kind").isin(*extensions))


def artifact_kind(name: Column, exports: bool = False) -> Column:
    """chunks, docstore or bm25 by the file name, else unknown; ``exports`` tells new exports of chunks (chunks_new) from chunks."""
    kinds = (*(("chunks_new", "chunks_export_new"),) * exports, ("chunks", "chunks"), ("docstore", "docstore"), ("bm25", "bm25"))
    return F.coalesce(*(F.when(name.rlike(rf"(?i)^{start}.*\.(txt|jsonl)$"), F.lit(k)) for k, start in kinds), F.lit("unknown"))


def artifact_priority(kind: Column, rebuild: bool) -> Column:
    """Order in which artifact files are read: a rebuild begins with the document store, an import with the chunks; 0 for others."""
    order = ("docstore", "chunks", "chunks_new", "bm25") if rebuild else ("chunks", "docstore", "bm25")
    return F.array_position(F.array(*map(F.lit, order)), kind).cast("int")


def is_artifact(text: Column) -> Column:
    """Whether the first non-blank of the first five lines is a JSON object with chunk_id, content and metadata, or with embedding and content."""
    line = F.trim(F.get(F.filter(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 5), lambda x: F.trim(x) != ""), 0))
    keys = F.json_object_keys(F.when(F.try_parse_json(line).isNotNull() & line.startswith("{"), line))
    has = lambda k: F.array_contains(keys, k)
    return F.coalesce(has("content") & ((has("chunk_id") & has("metadata")) | has("embedding")), F.lit(False))


def decoded(content: bytes) -> str:
    for encoding in ("utf-8-sig", "cp1251"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def text_elements(content: bytes) -> list[Element]:
    """Blocks of paragraphs, 12,000 characters at most unless one paragraph is longer; the page is the block's number, short blocks drop out but keep theirs."""
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", decoded(content).replace("\r\n", "\n")) if p.strip()]
    blocks: list[list[str]] = []
    size = BLOCK + 1
    for p in paragraphs:
        if size + len(p) > BLOCK:
            blocks.append([])
            size = 0
        blocks[-1].append(p)
        size += len(p)
    joined = ["\n\n".join(b) for b in blocks]
    return [("text", page, "", b, None, None) for page, b in enumerate(joined, 1) if len(b) >= LEAST]


def markdown(rows: list[list[str]]) -> tuple[str, int, int]:
    """Markdown of rows, the first as header; short rows are padded."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    width = max(map(len, rows), default=0)
    if not width:
        return "", 0, 0
    full = [[*rows[0], *(f"Кол.{k + 1}" for k in range(len(rows[0]), width))], ["---"] * width, *([*r, *[""] * (width - len(r))] for r in rows[1:])]
    return "\n".join(f"| {' | '.join(r)} |" for r in full), len(rows), width


def csv_elements(content: bytes) -> list[Element]:
    """Tables of 80 rows each, if enough of the first rows have several columns; else the file is text."""
    text = decoded(content)
    try:
        delimiter = csv.Sniffer().sniff(text[:8192], delimiters=",;\t|").delimiter
    except csv.Error:
        delimiter = ","
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), delimiter=delimiter)]
    widths = [len(r) for r in rows[:HEAD_ROWS] if r]
    if not widths or sum(w > 1 for w in widths) / len(widths) < SHARE:
        return text_elements(content)
    tables = [(page, *markdown(rows[k : k + ROWS])) for page, k in enumerate(range(0, len(rows), ROWS), 1)]
    return [("table", page, "", table, n, width) for page, table, n, width in tables if table]


def docx_elements(content: bytes) -> list[Element]:
    """Headings, text and tables of a document in their order; text is flushed at 8,000 characters, at headings and at tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    out: list[Element] = []
    held: list[str] = []
    page, heading = 1, ""

    def flush() -> None:
        nonlocal page
        if held:
            out.append(("text", page, heading, "\n\n".join(held), None, None))
            held.clear()
            page += 1

    def words(node: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_WORD}t")).strip()

    for node in body if body is not None else ():
        if node.tag == f"{_WORD}tbl":
            flush()
            table, n, width = markdown([[words(c) for c in r.iter(f"{_WORD}tc")] for r in node.iter(f"{_WORD}tr")])
            out += [("table", page, heading, table, n, width)] if table else []
            continue
        text = words(node)
        if node.tag != f"{_WORD}p" or not text:
            continue
        style = node.find(f"{_WORD}pPr/{_WORD}pStyle")
        styled = style is not None and (style.get(f"{_WORD}val") or "").lower().startswith(("heading", "заголовок", "title"))
        if len(text) <= 180 and (styled or _NUMBERED.fullmatch(text)):
            flush()
            heading = text
            out.append(("heading", page, heading, text, None, None))
            continue
        held.append(text)
        if sum(map(len, held)) >= BUFFER:
            flush()
    flush()
    return out


#: Readers by kind; a PDF or image reader is passed in by whoever has one.
READERS: dict[str, Callable[[bytes], list[Element]]] = {"txt": text_elements, "md": text_elements, "csv": csv_elements, "docx": docx_elements}


def elements(files: DataFrame, readers: dict[str, Callable[[bytes], list[Element]]] | None = None) -> DataFrame:
    """Elements of discovered files in order. Kinds without a reader, and artifacts, have none; a damaged DOCX is one element of type error."""
    every = {**READERS, **(readers or {})}
    head = F.decode(F.substring("content", 1, 65_536), "ISO-8859-1")
    own = files.where(F.col("kind").isin(*every) & ~(F.col("kind").isin("txt", "md", "csv") & (is_artifact(head) | (artifact_kind(F.col("name")) != "unknown"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, kind, content in zip(batch["name"], batch["kind"], batch["content"]):
                try:
                    found = every[kind](bytes(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    found = [("error", 0, "", str(e), None, None)]
                rows = [(name, k, t, page, heading, text, n, width) for k, (t, page, heading, text, n, width) in enumerate(found)]
                frame = pd.DataFrame(rows, columns=["source", "elem_ix", "element_type", "page", "heading", "content", "num_rows", "num_cols"])
                yield frame.astype({"num_rows": "Int64", "num_cols": "Int64"})

    return own.select("name", "kind", "content").mapInPandas(run, ELEMENT)


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON array under one naming."""
    raw = spark.read.option("multiLine", True).json(path)
    first = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in raw.columns), F.lit(None).cast("string"))
    return raw.select(first("id", "question_id").alias("question_id"), first("question").alias("question"), first("answer").alias("answer"), first("context", "context_text").alias("context"), first("reference", "reference_answer").alias("reference"), first("category").alias("category"))


def recent_logs(spark: SparkSession, path: str, most: int) -> DataFrame:
    """The last entries of a query log, newest first; the limit is the feature."""
    return spark.read.json(path).orderBy(F.desc("timestamp")).limit(most)
