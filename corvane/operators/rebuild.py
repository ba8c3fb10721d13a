"""Repair of stored records: by the rules of a rebuild and by those of an import, with the counters of both.

Records come as JSON lines (value) with the file they are from and its kind.
Each is a plan of column expressions; what was done to a record is kept in flag
columns, so that every counter is a sum over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvane.functions import elements as E, repair, rules as L, tables as T, text as X

#: Types of chunks, kinds whose declared type must be one of them, source of a record that names none.
TYPES, LOOSE_KINDS, NO_SOURCE = ("text", "table", "formula", "figure"), ("chunks", "chunks_new", "bm25"), "источник_не_определён"
#: Order in which kinds are read.
REBUILD_ORDER, IMPORT_ORDER = ("docstore", "chunks", "chunks_new", "bm25"), ("chunks", "chunks_new", "docstore", "bm25")
RECORD = "record_id, content, full_content, chunk_type, source, page, heading, model".split(", ")


def _field(*paths: str) -> Column:
    return F.coalesce(*(F.nullif(F.get_json_object("value", p), F.lit("")) for p in paths), F.lit(""))


def _opened(records: DataFrame) -> DataFrame:
    """Fields of the records(value, file, kind)."""
    own = records.withColumns({
        "raw": F.coalesce(F.get_json_object("value", "$.content"), F.lit("")), "declared": F.lower(F.coalesce(F.nullif(_field("$.chunk_type", "$.metadata.chunk_type"), F.lit("")), F.lit("text"))),
        "source": F.trim(_field("$.metadata.source")), "page": F.coalesce(_field("$.metadata.page").try_cast("long"), F.lit(0)).cast("long"), "heading": F.trim(_field("$.metadata.heading")),
        "raw_model": F.coalesce(F.nullif(_field("$.metadata.model"), F.lit("")), F.lit("unknown")), "formula_type": _field("$.metadata.formula_type"), "image_path": _field("$.metadata.image_path"),
        "original_id": _field("$.metadata.original_chunk_id", "$.chunk_id", "$.metadata.chunk_id")})
    return own.withColumn("clean", repair.normalized(X.strip_service_prefix(F.col("raw"))))


def _shown(own: DataFrame, *material: Column) -> DataFrame:
    """Summary in content and the whole in full_content, by type, and the new id."""
    kind, clean = F.col("chunk_type"), F.col("clean")
    content = F.when(kind == "table", T.summary(clean)).when(kind == "formula", E.formula_summary(clean, F.col("formula_type"))).otherwise(clean)
    made = own.withColumn("content", content).withColumn("full_content", F.when(kind != "text", clean))
    return made.withColumn("record_id", F.concat(kind, F.lit("_"), X.short_hash(F.concat_ws("|", *(m.cast("string") for m in material)))))


def repaired(records: DataFrame, strong: L.Rules, weak: L.Rules) -> DataFrame:
    """Records by the rules of a rebuild, all of them, with ``dropped`` (noise, empty_table or null) and what was done to each.

    Flags: fixed_prefix, page_zero, no_citation, reclassified, downgraded, fixed_model.
    """
    own = _opened(records)
    kind = F.when(F.col("kind").isin(*LOOSE_KINDS) & ~F.col("declared").isin(*TYPES), "text").otherwise(F.col("declared"))
    nowhere = (F.col("kind") == "chunks_new") & (F.col("source") == "") & (F.col("page") == 0)
    own = own.withColumns({"declared": kind, "no_citation": nowhere, "page_zero": F.col("page") == 0, "fixed_prefix": F.col("raw").rlike(r"(?i)^\s*(passage:|query:)")}).withColumn("source", F.when(nowhere, F.lit(NO_SOURCE)).otherwise(F.col("source")))
    own = own.withColumn("typed", E.element_type(F.col("declared"), F.col("clean"), F.col("formula_type")))
    cells = T.all_cells(F.col("clean"))
    n = F.when(F.col("typed") == "table", F.size(cells))
    poor = (F.col("typed") == "table") & ~((F.size(cells) >= 2) & (F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(c)) >= T.LEAST_CHARS))
    noise = (F.col("clean") == "") | X.is_noise(F.col("clean"), 2)
    own = own.withColumns({"dropped": F.when(noise, "noise").when(poor & (n == 0), "empty_table"), "downgraded": poor & (n > 0), "reclassified": (F.col("declared") == "formula") & (F.col("typed") != "formula")})
    own = own.withColumn("chunk_type", F.when(F.col("downgraded"), "text").otherwise(F.col("typed"))).withColumn("model", L.resolve(F.col("raw_model"), F.col("clean"), F.col("source"), strong, weak))
    own = own.withColumn("fixed_model", F.col("model") != F.col("raw_model"))
    return _shown(own, F.col("source"), F.col("page"), F.col("chunk_type"), F.substring("clean", 1, 1000)).drop("raw", "clean", "declared", "typed", "raw_model", "original_id")


def imported(records: DataFrame, strong: L.Rules, weak: L.Rules, lexical: bool = False) -> DataFrame:
    """Records by the rules of an import, all of them, with ``dropped`` (noise, lexical or null), ``reclassified`` (how often) and ``lemmatized_only``.

    Chunk files hold text only; lexical files, whose texts are lemmas, are left out unless ``lexical``.
    """
    own = _opened(records).withColumn("clean", repair.normalized(F.col("raw")))
    loose = F.col("kind").isin("chunks", "chunks_new", "bm25")
    own = own.withColumn("declared", F.when(loose, "text").otherwise(F.col("declared"))).withColumn("lemmatized_only", F.col("kind") == "bm25")
    own = own.withColumn("typed", E.element_type(F.col("declared"), F.col("clean"), F.col("formula_type")))
    poor = (F.col("typed") == "table") & ~T.is_useful(F.col("clean"))
    noise = (F.col("clean") == "") | X.is_noise(F.col("clean"), 2)
    found = L.detect(F.col("clean"), strong, weak)
    own = own.withColumns({
        "dropped": F.when(noise, "noise").when(F.col("lemmatized_only") & F.lit(not lexical), "lexical"), "reclassified": (F.col("typed") != F.col("declared")).cast("int") + poor.cast("int"),
        "chunk_type": F.when(poor, "text").otherwise(F.col("typed")), "source": F.coalesce(F.nullif("source", F.lit("")), "file"),
        "model": F.when(F.col("raw_model") != "unknown", F.col("raw_model")).when(found["confidence"] > 0.3, found["name"]).otherwise("unknown")})
    return _shown(own, F.col("source"), F.col("page"), F.col("chunk_type"), F.col("original_id"), F.col("image_path"), F.substring("clean", 1, 1000)).drop("raw", "clean", "declared", "typed", "raw_model")


def _quality() -> Column:
    """Length and richness of a record."""
    return X.quality(F.col("content"), F.col("page"), F.col("model"), F.col("heading")) + F.when(F.coalesce("full_content", F.lit("")) != "", 200).otherwise(0)


def deduplicated(repaired_rows: DataFrame, place: Column) -> DataFrame:
    """The best record of each text (first 2000 lower-case characters and type): the richest, the first by ``place`` on a tie. ``copies`` counts them; dropped records are left out."""
    key = X.short_hash(F.concat(F.substring(F.lower(F.coalesce(F.nullif("full_content", F.lit("")), "content")), 1, 2000), F.lit("|"), F.col("chunk_type")))
    own = repaired_rows.where("dropped IS NULL").withColumns({"dedup_key": key, "quality": _quality(), "place": place})
    best = own.groupBy("dedup_key").agg(F.min_by(F.struct(*[c for c in own.columns if c != "dedup_key"]), F.struct((-F.col("quality")).alias("q"), "place")).alias("r"), F.count("*").alias("copies"))
    return best.select("dedup_key", "r.*", "copies")


def place_of(order: tuple[str, ...] = REBUILD_ORDER) -> Column:
    """Reading order of records(kind, file_no, line_no): by kind, file, line."""
    return F.struct(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("kind")), F.lit(0)), F.lit(len(order) + 1)).cast("long").alias("by_kind"), F.col("file_no").cast("long").alias("file_no"), F.col("line_no").cast("long").alias("line_no"))


def selected(records: DataFrame, export: bool = False, lexical: bool = False) -> DataFrame:
    """Records of the kinds that a rebuild reads: exports and lexical files only if told so."""
    kinds = ["docstore", "chunks", *["chunks_new"] * export, *["bm25"] * lexical]
    return records.where(F.col("kind").isin(kinds))


def report(rows: DataFrame, kept: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """One row with the counters of a rebuild: of its records, of what is kept (by type and model), and of the statuses of lines(status) if given."""
    clear, stays_in = F.coalesce(F.col("dropped") != "noise", F.lit(True)), F.col("dropped").isNull()
    counts = rows.agg(
        F.count("*").alias("records_in"), F.count_if(F.col("dropped") == "noise").alias("skipped_noise"), F.count_if(F.col("dropped") == "empty_table").alias("skipped_empty_table"), F.count_if("fixed_prefix").alias("fixed_prefix"),
        F.count_if(F.col("reclassified") & clear).alias("reclassified_formula"), F.count_if(F.col("page_zero") & clear).alias("page_zero"), F.count_if(F.col("downgraded") & stays_in).alias("downgraded_table"), F.count_if(F.col("fixed_model") & stays_in).alias("fixed_model"))
    stays = kept.agg(F.count("*").alias("kept"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("deduplicated"))
    out = counts.crossJoin(stays)  # rows of one
    for name, frame, column in (("by_type", kept, "chunk_type"), ("by_model", kept, "model"), ("files", rows, "file")):
        pairs = frame.groupBy(column).count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "count")))).alias(name))
        out = out.crossJoin(pairs)
    if lines is not None:
        out = out.crossJoin(line_counts(lines))
    return out


def line_counts(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters of a line repair over rows(status[, backfilled]): objects ok, repaired, split, recovered, lines lost, keys put in."""
    put = F.count_if("backfilled") if "backfilled" in lines.columns else F.lit(0).cast("long")
    names = (("ok", "objects_ok"), ("repaired", "objects_repaired"), ("split", "objects_split"), ("recovered", "objects_recovered"), ("unrecoverable", "unrecoverable"))
    return lines.groupBy(*(by or [])).agg(F.count("*").alias("jsonl_lines"), *(F.count_if(F.col("status") == s).alias(n) for s, n in names), put.alias("keys_backfilled"))


def first_of_import(rows: DataFrame, place: Column) -> DataFrame:
    """The first record by ``place`` of each (source, page, type, first 2000 characters); equal ids after the first get a suffix. Dropped records are left out."""
    from corvane.operators import indexes

    own = rows.where("dropped IS NULL").withColumn("place", place).withColumn("chunk_id", F.col("record_id"))
    text = F.coalesce(F.nullif("full_content", F.lit("")), "content")
    kept = indexes.first_of_group(own.withColumn("shown", F.col("content")).withColumn("content", text), F.col("place"))
    return kept.withColumn("content", F.col("shown")).drop("shown")


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(order.desc()))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
