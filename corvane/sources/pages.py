"""Pages of documents that a reader has opened: elements from their text, tables and pictures.

The reader is passed in: it makes pages(source, page, text, width, height,
images array<struct<data, width, height, path>>, tables array<struct<rows>>) of a
file's bytes. Everything behind it is a plan over the pages. A page without text
whose picture fills it is read by the recogniser, which is passed in too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import elements as E, repair, tables as T

#: Least characters of a page's text and of a recognised text, least sides of a picture, share of a page that a scan fills, headings of a page.
LEAST_TEXT, LEAST_RECOGNISED, LEAST_SIDE, SCAN_SHARE, HEADINGS = 50, 30, 80, 0.8, 3
PAGE = "source string, page long, text string, width double, height double, images array<struct<data: binary, width: long, height: long, path: string>>, tables array<struct<rows: array<array<string>>>>"
Reader = Callable[[bytes], list[dict]]


def read_pages(files: DataFrame, reader: Callable[[], Reader]) -> DataFrame:
    """Pages of files(name, content); ``reader`` makes the function that opens a file, once a task. A file that it cannot open has no pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = reader()
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                try:
                    found = opened(bytes(content))
                except Exception:  # a reader may fail in any way on a damaged file
                    found = []
                rows = [{"source": name, "page": n, "text": None, "width": 0.0, "height": 0.0, "images": [], "tables": [], **p} for n, p in enumerate(found, 1)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGE.split(", ") if c.split()[0] in ("source", "page", "text", "width", "height", "images", "tables")])

    return files.select("name", "content").mapInPandas(run, PAGE)


def is_scan(text: Column, images: Column, width: Column, height: Column) -> Column:
    """Too little text, and either no picture or one that fills the page."""
    area = F.greatest(F.lit(1.0), width * height)
    fills = F.exists(images, lambda i: i["width"] * i["height"] / area > SCAN_SHARE)
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) < LEAST_TEXT) & ((F.size(F.coalesce(images, F.array())) == 0) | F.coalesce(fills, F.lit(False)))


def is_large(width: Column, height: Column) -> Column:
    return (width >= LEAST_SIDE) & (height >= LEAST_SIDE)


def _element(kind: str, content: Column, **more: Column) -> Column:
    fields = {"image_path": F.lit(None).cast("string"), "formula_type": F.lit(None).cast("string"), "num_rows": F.lit(None).cast("long"), "num_cols": F.lit(None).cast("long"), "ocr": F.lit(False), **more}
    return F.struct(F.lit(kind).alias("element_type"), content.alias("content"), *(v.alias(k) for k, v in fields.items()))


def _table(rows: Column) -> Column:
    """Markdown of a table's rows, null if it has fewer than two rows or filled cells."""
    filled = F.aggregate(rows, F.lit(0), lambda n, r: n + F.size(F.filter(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")))
    plain = F.transform(rows, lambda r: F.transform(r, lambda c: repair.normalized(c)))
    return F.when((F.size(rows) >= 2) & (filled >= 2), T.from_rows(plain))


def elements(pages: DataFrame, recognise: Callable[[Column], Column] | None = None, costs: dict[str, float] | None = None) -> DataFrame:
    """Elements of pages, in order: source, page, ord, element_type, content, heading, and what a type adds.

    A scan is what the recogniser reads in its largest picture, if that is long
    enough; else a page has its first headings, tables, formulas, large pictures
    (all with the page's first caption) and its text. The heading of a page is
    its first, else that of a page before.
    """
    own = pages.withColumn("plain", F.trim(F.coalesce("text", F.lit("")))).withColumn("images", F.coalesce("images", F.expr("cast(array() as array<struct<data: binary, width: bigint, height: bigint, path: string>>)"))).withColumn("tables", F.coalesce("tables", F.expr("cast(array() as array<struct<rows: array<array<string>>>>)")))
    own = own.withColumn("scan", is_scan(F.col("plain"), F.col("images"), F.col("width"), F.col("height"))).withColumn("headings", F.when(~F.col("scan"), E.headings(F.col("plain"))))
    largest = F.get(F.sort_array(F.transform("images", lambda i: F.struct((i["width"] * i["height"]).alias("area"), i["data"].alias("data"))), asc=False), 0)["data"]
    own = own.withColumn("read", recognise(F.when(F.col("scan"), largest)) if recognise else F.lit(None).cast("string"))
    # columns of their own, so that each is worked out once
    own = own.withColumn("read", repair.normalized(F.col("read"))).withColumn("clean", repair.deep_clean(F.when(~F.col("scan"), F.col("plain")), costs))
    caption = E.figure_caption(F.col("plain"))
    scanned = F.when(F.length("read") >= LEAST_RECOGNISED, F.array(_element("text", repair.deep_clean(F.col("read"), costs), ocr=F.lit(True))))
    titles = F.transform(F.slice("headings", 1, HEADINGS), lambda h: _element("heading", h))
    grids = F.transform(F.filter(F.transform("tables", lambda t: F.struct(_table(t["rows"]).alias("t"), F.size(t["rows"]).cast("long").alias("n"), F.array_max(F.transform(t["rows"], lambda r: F.size(r))).cast("long").alias("w"))), lambda t: F.coalesce(t["t"], F.lit("")) != ""), lambda t: _element("table", t["t"], num_rows=t["n"], num_cols=t["w"]))
    maths = F.transform(E.formulas(F.col("plain")), lambda f: _element("formula", f["content"], formula_type=f["formula_type"]))
    numbered = F.transform("images", lambda i, n: F.struct(i.alias("i"), n.alias("n")))
    pictures = F.transform(F.filter(numbered, lambda x: is_large(x["i"]["width"], x["i"]["height"])), lambda x: _element("figure", F.when(caption != "", caption).otherwise(F.concat(F.lit("Изображение "), (x["n"] + 1).cast("string"))), image_path=x["i"]["path"]))
    body = F.when(F.length("clean") >= LEAST_TEXT, F.array(_element("text", F.col("clean")))).otherwise(F.array().cast("array<struct<element_type: string, content: string, image_path: string, formula_type: string, num_rows: bigint, num_cols: bigint, ocr: boolean>>"))
    found = F.when(F.col("scan"), scanned).otherwise(F.concat(titles, grids, maths, pictures, body))
    headed = own.withColumn("own_heading", F.get("headings", 0)).select("source", "page", "own_heading", F.posexplode(found).alias("n", "e"))
    # the heading of an earlier page: one row a page is enough to carry it
    from corvane.operators import ordered

    carried = ordered.last_known(own.select("source", "page", F.get("headings", 0).alias("h")), F.col("h"), "source", "page", "heading").select("source", "page", F.coalesce("heading", F.lit("")).alias("heading"))
    out = headed.join(carried, ["source", "page"]).select("source", "page", (F.col("page") * 100_000 + F.col("n")).alias("ord"), "e.*", F.col("heading").alias("page_heading"))
    return out.withColumn("heading", F.when(F.col("element_type") == "heading", F.col("content")).otherwise(F.col("page_heading"))).drop("page_heading")
