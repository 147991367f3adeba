"""Readers and writers for persona documents, answer tables and snapshots.

Parquet is the working format (partitioned by ``experiment`` and ``model``,
so filters on them prune directories). The JSON layouts of the reference are
read and written for compatibility: a persona document
``{"rows": [{"row": {...}}]}``, a results document
``{model: {topic: {persona_id: response}}}`` and an incremental snapshot
``{"metadata": {...}, "performance_metrics": {...}, "results": {...}}``.
A JSON document is not splittable, so each file is one task; answer tables
are therefore written as one document per (model, topic) line.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

PERSONA_ROW = T.StructType([T.StructField(n, t, True) for n, t in [
    ("uuid", T.StringType()), ("professional_persona", T.StringType()), ("sports_persona", T.StringType()),
    ("arts_persona", T.StringType()), ("travel_persona", T.StringType()),
    ("culinary_persona", T.StringType()), ("persona", T.StringType()),
    ("cultural_background", T.StringType()), ("skills_and_expertise", T.StringType()),
    ("skills_and_expertise_list", T.ArrayType(T.StringType())), ("hobbies_and_interests", T.StringType()),
    ("hobbies_and_interests_list", T.ArrayType(T.StringType())),
    ("career_goals_and_ambitions", T.StringType()), ("sex", T.StringType()), ("age", T.IntegerType()),
    ("marital_status", T.StringType()), ("education_level", T.StringType()),
    ("bachelors_field", T.StringType()), ("occupation", T.StringType()), ("city", T.StringType()),
    ("state", T.StringType()), ("zipcode", T.StringType()), ("country", T.StringType())]])
PERSONA_DOC = T.StructType([T.StructField("rows", T.ArrayType(
    T.StructType([T.StructField("row", PERSONA_ROW, True)])), True)])
RESULTS_MAP = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))
SNAPSHOT = T.StructType([
    T.StructField("metadata", T.StructType([T.StructField(n, t) for n, t in [
        ("timestamp", T.StringType()), ("batch_number", T.IntegerType()), ("total_batches", T.IntegerType()),
        ("stage", T.StringType()), ("incremental_counter", T.IntegerType()),
        ("progress_percentage", T.DoubleType()), ("current_concurrency", T.IntegerType()),
        ("current_batch_size", T.IntegerType()), ("retry_queue_size", T.IntegerType())]])),
    T.StructField("performance_metrics", T.StructType([T.StructField(n, t) for n, t in [
        ("requests_per_second", T.DoubleType()), ("success_rate", T.DoubleType()),
        ("empty_response_rate", T.DoubleType()), ("total_requests", T.IntegerType()),
        ("successful_requests", T.IntegerType()), ("retry_count", T.IntegerType()),
        ("max_retries_reached", T.IntegerType())]])),
    T.StructField("results", RESULTS_MAP)])
ANSWER_SCHEMA = T.StructType([T.StructField("model", T.StringType()), T.StructField("topic", T.StringType()),
                              T.StructField("persona_id", T.StringType()),
                              T.StructField("response", T.StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p)) and len(fs.globStatus(p)) > 0


# ---------------------------------------------------------------------------
# personas (S1, S2, S3)


def _entries(spark: SparkSession, path: str | list[str], multi_line: bool) -> DataFrame:
    """(file, block, row_idx, row): ``block`` is where the part of the file that a task reads begins."""
    doc = spark.read.schema(PERSONA_DOC).option("multiLine", multi_line).json(path)
    doc = doc.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "rows")
    return doc.select("file", "block", F.posexplode("rows").alias("row_idx", "entry")).select(
        "file", "block", F.col("row_idx").cast("long"), F.col("entry.row").alias("row"))


def read_persona_entries(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Entries of persona documents: (file, row_idx, row); a missing path gives no rows.

    ``multi_line``: one (pretty-printed) document per file; otherwise one
    document per line.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([
            T.StructField("file", T.StringType()), T.StructField("row_idx", T.LongType()),
            T.StructField("row", PERSONA_ROW)]))
    return _entries(spark, path, multi_line).drop("block")


def read_personas(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Persona rows of the documents at ``path`` (flattened)."""
    e = read_persona_entries(spark, path, multi_line)
    return e.where(F.col("row").isNotNull()).select("file", "row_idx", "row.*")


def write_page_index(spark: SparkSession, path: str, index_path: str, multi_line: bool = True) -> None:
    """Rows per persona document file and the entries before it, in the order of the file names.

    One row per file; the window runs over that table.
    """
    n = read_persona_entries(spark, path, multi_line).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    n.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).write.mode("overwrite").parquet(index_path)


def persona_page(spark: SparkSession, path: str, offset: int = 0, length: int = 100, index_path: str | None = None,
                 multi_line: bool = True) -> DataFrame:
    """(pos, file, row_idx, row) of ``length`` entries from ``offset`` in the order of file names and rows.

    The index tells which files hold the page; only these are opened. Without ``index_path`` one is made first. A
    missing path gives no rows; files that hold several documents (one per line) are ordered by line.
    """
    none = read_persona_entries(spark, path, multi_line).limit(0).select(F.lit(0).cast("long").alias("pos"), "file", "row_idx", "row")
    if not _exists(spark, path) or length <= 0:
        return none
    if index_path is None:
        index_path = scratch_path(spark, "page-index")
        write_page_index(spark, path, index_path, multi_line)
    hit = spark.read.parquet(index_path).where((F.col("first") < offset + length) & (F.col("first") + F.col("n") > offset))
    hit = {r.file: r.first for r in hit.orderBy("first").collect()}  # at most one file per entry of the page
    if not hit:
        return none
    e = _entries(spark, list(hit), multi_line)
    first = F.create_map(*[F.lit(x) for kv in hit.items() for x in kv])
    # a task reads its part of a file in order
    of_file = Window.partitionBy("file").orderBy("block", "_seq")
    e = e.withColumn("_seq", F.monotonically_increasing_id()).withColumn(
        "pos", F.row_number().over(of_file) - 1 + first[F.col("file")])
    return e.where((F.col("pos") >= offset) & (F.col("pos") < offset + length)).select(
        F.col("pos").cast("long").alias("pos"), "file", "row_idx", "row")


def read_single_persona(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The control persona: the path must exist and hold exactly one persona row."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    p = read_personas(spark, path, multi_line)
    n = p.limit(2).count()
    if n != 1:
        raise ValueError(f"expected one persona in {path}, found {n if n < 2 else 'several'}")
    return p


def write_ordered_documents(personas: DataFrame, path: str, order: str, rows_per_doc: int = 100, n_files: int = 8) -> None:
    """Persona documents of ``rows_per_doc`` consecutive values of the integer column ``order`` each.

    Documents, their rows and the names of the files ascend with ``order``, so pages follow it.
    """
    cols = list(personas.columns)
    d = personas.withColumn("_doc", F.expr(f"bigint({order}) div {rows_per_doc}"))
    row = F.struct(F.col(order).cast("long").alias("_o"), F.struct(F.struct(*cols).alias("row")).alias("r"))
    body = d.groupBy("_doc").agg(F.sort_array(F.collect_list(row)).alias("e"))
    body = body.repartitionByRange(n_files, "_doc").sortWithinPartitions("_doc")
    body.select(F.to_json(F.struct(F.col("e.r").alias("rows"))).alias("value")).write.mode("overwrite").text(path)


def write_persona_documents(personas: DataFrame, path: str, rows_per_doc: int = 100) -> None:
    """Persona documents {"rows": [{"row": {...}}]} of about ``rows_per_doc`` rows each.

    Rows go to documents by a hash of the persona id, so every document is
    bounded and no window or single task sees the whole table.
    """
    n = personas.count()
    docs = max(1, -(-n // rows_per_doc))
    cols = [c for c in personas.columns]
    d = personas.withColumn("_doc", F.pmod(F.xxhash64(F.col(cols[0]).cast("string")), F.lit(docs)))
    body = d.groupBy("_doc").agg(F.collect_list(F.struct(F.struct(*cols).alias("row"))).alias("rows"))
    body.select(F.to_json(F.struct("rows")).alias("value")).write.mode("overwrite").text(path)


def write_personas(personas: DataFrame, path: str, experiment: str, tag: str, run_ts: str) -> None:
    """Persona rows as JSON lines under experiment/tag/run_ts partitions."""
    (personas.withColumn("experiment", F.lit(experiment)).withColumn("tag", F.lit(tag))
             .withColumn("run_ts", F.lit(run_ts))
             .write.mode("append").partitionBy("experiment", "tag", "run_ts").json(path))


# ---------------------------------------------------------------------------
# answer tables


def write_answers_parquet(answers: DataFrame, path: str, experiment: str = "main") -> None:
    """Answers as Parquet, partitioned by experiment and model.

    Rows are dealt by (model, topic, 16 buckets of the persona id): a model with
    a third of all answers is written by many tasks, in as many files.
    """
    (answers.withColumn("experiment", F.lit(experiment))
            .repartition("experiment", "model", "topic", F.pmod(F.xxhash64("persona_id"), F.lit(16)))
            .write.mode("append").partitionBy("experiment", "model").parquet(path))


def read_answers_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def answer_groups(answers: DataFrame, max_per_doc: int = 10_000) -> DataFrame:
    """The answers of each results document: (model, topic, entries ARRAY<STRUCT<persona_id, response>>).

    A (model, topic) group larger than ``max_per_doc`` answers is split over
    several documents by a hash of the persona id (the reader unions them), so
    no document, and no task, holds a whole large group.
    """
    sizes = answers.groupBy("model", "topic").agg(F.count(F.lit(1)).alias("_n"))
    nb = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(max_per_doc))).cast("long")
    b = answers.join(sizes, ["model", "topic"]).withColumn(
        "_doc", F.pmod(F.xxhash64("persona_id"), nb))
    inner = b.groupBy("model", "topic", "_doc").agg(F.collect_list(F.struct("persona_id", "response")).alias("entries"))
    return inner.select("model", "topic", "entries")


def nested_documents(answers: DataFrame, max_per_doc: int = 10_000) -> DataFrame:
    """Results documents {model: {topic: {persona_id: response}}}, one per line, of answers or of their ``answer_groups``."""
    groups = answers if "entries" in answers.columns else answer_groups(answers, max_per_doc)
    m = F.map_from_entries("entries")
    return groups.select(F.to_json(F.create_map(F.col("model"), F.create_map(F.col("topic"), m))).alias("value"))


def write_results_json(answers: DataFrame, path: str) -> None:
    """Results documents, one per line, readable by ``read_results_json`` (``answers``: rows, or their ``answer_groups``)."""
    nested_documents(answers).write.mode("overwrite").text(path)


def _answer_maps(doc: DataFrame, map_col: str) -> DataFrame:
    m = doc.select(F.explode(map_col).alias("model", "topics"))
    return m.select("model", F.explode("topics").alias("topic", "answers"))


def _flatten(doc: DataFrame, map_col: str) -> DataFrame:
    return _answer_maps(doc, map_col).select("model", "topic", F.explode("answers").alias("persona_id", "response"))


def read_results_json(spark: SparkSession, path: str, whole_files: bool = False, maps: bool = False) -> DataFrame:
    """Rows (model, topic, persona_id, response) of results documents.

    With ``maps``, one row (model, topic, answers MAP<persona_id, response>) per
    document and topic instead.

    Accepts a bare results map or a document with a top-level ``results`` key
    (snapshot layout). Documents are one per line, or one per file with
    ``whole_files`` (pretty-printed files).
    """
    raw = spark.read.text(path, wholetext=whole_files)
    is_doc = F.coalesce(F.array_contains(F.json_object_keys("value"), F.lit("results")), F.lit(False))
    doc = raw.select(F.when(is_doc, F.from_json("value", SNAPSHOT)["results"])
                     .otherwise(F.from_json("value", RESULTS_MAP)).alias("results"))
    return (_answer_maps if maps else _flatten)(doc, "results")  # null documents explode to nothing


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata + metrics, one row per document; results rows) of snapshot files."""
    raw = spark.read.text(path, wholetext=True)
    doc = raw.select(F.from_json("value", SNAPSHOT).alias("d"), F.col("_metadata.file_path").alias("file"))
    meta = doc.select("file", "d.metadata.*", "d.performance_metrics.*")
    return meta, _flatten(doc.select(F.col("d.results").alias("results")), "results")


def snapshot_documents(attempts: DataFrame, stage: str, batch_number: int, total_batches: int,
                       counter: int, progress: float | None = None) -> DataFrame:
    """Snapshot documents (metadata, metrics, results) per (model, topic) of the latest answers.

    ``progress``: percentage done; by default that after batch ``batch_number`` (from 0).
    """
    if progress is None:
        progress = 100.0 * (batch_number + 1) / max(total_batches, 1)
    from ..operators.coverage import last_answer_wins

    last = last_answer_wins(attempts)
    ok = F.coalesce(F.col("success"), F.lit(False))
    metrics = attempts.agg(F.count(F.lit(1)).cast("int").alias("total_requests"),
                           F.count_if(ok).cast("int").alias("successful_requests"))
    docs = nested_documents(last.select("model", "topic", "persona_id", "response"))
    meta = F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                    F.lit(batch_number).alias("batch_number"), F.lit(total_batches).alias("total_batches"),
                    F.lit(stage).alias("stage"), F.lit(counter).alias("incremental_counter"),
                    F.lit(progress).alias("progress_percentage"))
    tot = metrics.select("total_requests").scalar()
    okc = metrics.select("successful_requests").scalar()
    perf = F.struct(F.when(tot > 0, okc / tot).alias("success_rate"), tot.alias("total_requests"),
                    okc.alias("successful_requests"))
    return docs.select(F.concat(F.lit('{"metadata":'), F.to_json(meta), F.lit(',"performance_metrics":'),
                                F.to_json(perf), F.lit(',"results":'), F.col("value"), F.lit("}"))
                       .alias("value"))


def write_similarity_bundle(moments: DataFrame, vectors: DataFrame, path: str,
                            experiment: str = "main") -> None:
    """Group moments and the vectors behind them, partitioned by experiment and model."""
    (moments.withColumn("experiment", F.lit(experiment)).write.mode("overwrite")
            .partitionBy("experiment", "model").parquet(os.path.join(path, "moments")))
    (vectors.withColumn("experiment", F.lit(experiment)).write.mode("overwrite")
            .partitionBy("experiment", "model").parquet(os.path.join(path, "embeddings")))


def read_similarity_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.parquet(os.path.join(path, "moments")),
            spark.read.parquet(os.path.join(path, "embeddings")))


# ---------------------------------------------------------------------------
# cached file listings


def list_files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """(path, name, modified) of the entries (files or written datasets) matching
    ``pattern`` in ``directory``, newest first. Only file-system metadata is read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(directory.rstrip("/") + "/" + pattern)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    st = fs.globStatus(p) or []
    import datetime as _dt

    rows = [(str(x.getPath().toString()), str(x.getPath().getName()),
             _dt.datetime.fromtimestamp(x.getModificationTime() / 1000.0, tz=_dt.timezone.utc)
             .replace(tzinfo=None)) for x in st]
    df = spark.createDataFrame(rows, "path string, name string, modified timestamp")
    return df.orderBy(F.desc("modified"), F.desc("path"))


def latest_file(spark: SparkSession, directory: str, pattern: str = "*") -> str | None:
    """Path of the newest matching file, or None."""
    r = list_files(spark, directory, pattern).limit(1).collect()
    return r[0]["path"] if r else None


def latest_results_file(spark: SparkSession, directory: str, prefer: str | None = None) -> str | None:
    """Newest file by tier: results_*.json, then *_final_*.json, then incremental_results_*.json.

    With ``prefer`` (e.g. 'cleaned'), a name containing it wins first.
    """
    f = list_files(spark, directory, "*.json")
    name = F.col("name")
    tier = (F.when(name.startswith("results_"), 1)
             .when(name.contains("_final_"), 2)
             .when(name.startswith("incremental_results_"), 3))
    ranked = f.withColumn("tier", tier).where(F.col("tier").isNotNull())
    if prefer:
        ranked = ranked.withColumn("tier", F.when(name.contains(prefer), 0).otherwise(F.col("tier")))
    r = ranked.orderBy("tier", F.desc("modified"), F.desc("path")).limit(1).collect()
    return r[0]["path"] if r else None
