"""The catalog's tables, derived from the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocabulary as V
from ..operators import dictionary


#: Extensions of the stand-in archive: all known ones, one that no extractor has, and none.
ARCHIVE_EXTENSIONS = [*(e for es in V.EXTRACTORS.values() for e in es), "xyz", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores by a key: a compact file is read by few tasks, too few for what Python makes of its rows."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document; a tenth each is pending and failed."""
    d = table(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 10 == 0, "pending").when(F.col("doc_id") % 10 == 1, "failed").otherwise("indexed")
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    return d.select(
        F.col("doc_id").alias("file_id"), F.concat(F.lit("["), "source", F.lit("] "), F.col("doc_id").cast("string")).alias("path"), F.concat("source", F.lit("_v"), (F.col("doc_id") % 7).cast("string"), F.lit("."), "lang").alias("filename"),
        F.col("lang").alias("extension"), F.col("n_chars").alias("size_bytes"), status.alias("status"), stamp.alias("indexed_at"), F.col("source").alias("machine"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense set: per order its suppliers as persons, part brands as organisations and part types as projects."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("entity_type"), F.col(c).alias("value")) for k, c in (("PERSON", "s_name"), ("ORG", "p_brand"), ("PROJECT", "p_type"))])).alias("e")
    out = j.select(F.col("l_orderkey").alias("file_id"), "l_linenumber", kinds).select("file_id", "l_linenumber", "e.entity_type", "e.value")
    return out.withColumn("normalized", F.lower("value")).withColumn("key", S.canonical_key(F.col("entity_type"), F.col("normalized"))).withColumn("context", F.lit(None).cast("string")).withColumn("id", F.concat_ws("_", F.col("file_id").cast("string"), F.col("l_linenumber").cast("string"), "entity_type"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderdate").cast("timestamp").alias("indexed_at"))


def numbered(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("entity_type"), i.cast("int").alias("position"), v.alias("value")))


def text_entities(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(V.ENTITY_RULES)) -> DataFrame:
    """Entities found in documents by the fixed expressions: file_id, entity_type, position (from 0), value."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    found = [numbered(k, F.slice(F.regexp_extract_all("text", F.lit(p), F.lit(0)), 1, n)) for k, (p, n) in V.ENTITY_RULES.items() if k in kinds]
    return d.select("file_id", F.explode(F.concat(*found)).alias("e")).select("file_id", "e.*")


def tech_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technology terms in documents: file_id, value as written, normalized, position, confidence; index counts those of a document."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    hits = dictionary.found(d, "text", [(t, "TECH") for t in V.TECH_TERMS])
    return hits.select("file_id", "index", "value", F.lower("value").alias("normalized"), F.col("start").alias("position"), F.col("label").alias("entity_type"), F.lit(0.9).alias("confidence"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 7 == 0, "failed").when(F.col("event_id") % 7 == 1, "pending").when(F.col("event_id") % 7 == 2, "running").otherwise("completed")
    created = F.col("ts").cast("timestamp")
    done = F.when(status.isin("failed", "completed"), created + F.expr("make_dt_interval(0, 0, 0, 1) * (event_id % 90)"))
    return e.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("job_type"), status.alias("status"), (F.col("event_id") % 5 + 1).alias("priority"), created.alias("created_at"), F.when(status != "pending", created).alias("started_at"), done.alias("completed_at"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").alias("sequence"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))


def machine_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of machines: the words of ten letters or more of a document, its source being the machine."""
    d = table(spark, sf_dir, "documents").select("source", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("entity"))
    return d.filter(F.length("entity") >= 10).select(F.col("source").alias("machine"), "entity")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of some extension for each document, unknown ones and upper-case ones among them."""
    kinds = F.array(*[F.lit(e) for e in ARCHIVE_EXTENSIONS])
    ext = F.get(kinds, (F.col("doc_id") % len(ARCHIVE_EXTENSIONS)).cast("int"))
    ext = F.when(F.col("doc_id") % 3 == 0, F.upper(ext)).otherwise(ext)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat("lang", F.lit("/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), ext.alias("extension"), F.col("source").alias("machine"), F.col("text").alias("content"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tags of an image for each part; some have no camera, no place, no words."""
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    some = lambda n, c: F.when(k % n != 0, c)
    return p.select(
        k.alias("file_id"), some(5, F.concat(F.lit(" "), "p_brand", F.lit(" "))).alias("make"), some(7, F.col("p_name")).alias("model"), some(4, size * 50).alias("iso"), (size / F.lit(10.0)).alias("f_number"),
        F.when(k % 3 == 0, size / F.lit(8.0)).otherwise(1 / size.cast("double")).alias("exposure"), some(6, size.cast("double")).alias("focal"),
        some(4, F.array((k % 90).cast("double"), (k % 60).cast("double"), (size % 60).cast("double"))).alias("latitude"), F.when(k % 2 == 0, "S").otherwise("N").alias("latitude_ref"),
        some(4, F.array((k % 180).cast("double"), (size % 60).cast("double"), (k % 60).cast("double"))).alias("longitude"), F.when(k % 3 == 0, "W").otherwise("E").alias("longitude_ref"),
        F.col("p_retailprice").alias("altitude"), (k % 2).cast("int").alias("altitude_ref"), F.concat(F.lit("2023:0"), (k % 9 + 1).cast("string"), F.lit(":1"), (k % 10).cast("string"), F.lit(" 10:20:30")).alias("taken"),
        F.when(k % 3 == 1, "").otherwise(some(2, F.col("p_name"))).alias("ocr_text"), some(3, F.col("p_type")).alias("ai_description"), F.col("p_type").alias("town"), F.col("p_brand").alias("country"),
    )


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tags of an audio file for each customer."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    some = lambda n, v: F.when(k % n != 0, v)
    return c.select(
        k.alias("file_id"), F.concat(F.lit("s"), k.cast("string"), F.lit(".mp3")).alias("name"), some(2, F.col("c_name")).alias("title"), some(3, F.col("c_mktsegment")).alias("artist"), some(6, F.lit("")).alias("album"),
        F.when(k % 5 == 0, "unknown").otherwise(F.concat((1950 + k % 70).cast("string"), F.lit("-05-01"))).alias("year"), F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit("/12"))).otherwise((k % 20).cast("string")).alias("track"),
        (k * 37 % 9000).alias("seconds"), F.when(k % 3 == 0, "completed").otherwise("pending").alias("transcription_status"),
    )


def export_text(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """An export file for each conversation in one of two forms: path, value (JSON)."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    if form == "list":
        said = F.struct(
            F.concat(F.lit("m"), turn).alias("uuid"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("text"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.lit("2024-03-01T10:00:00Z").alias("created_at"),
            F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("none").alias("text")), F.struct(F.lit("text").alias("type"), turn.alias("text"))).alias("content"),
        )
        g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("m")))), lambda x: x["m"]).alias("chat_messages"))
        one = F.struct(F.concat(F.lit("u"), conv).alias("uuid"), F.concat(F.lit("talk "), conv).alias("name"), F.lit("2024-03-01T10:00:00Z").alias("created_at"), "chat_messages")
    else:
        said = F.struct(F.struct(F.struct(F.col("role").alias("role")).alias("author"), F.struct(F.array(F.col("text"), F.lit(""), turn).alias("parts")).alias("content"), (F.lit(1.7e9) - F.col("turn")).alias("create_time")).alias("message"))
        g = c.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("n"), F.lpad(turn, 6, "0")).alias("k"), said.alias("v"))))).alias("mapping"))
        one = F.struct(F.concat(F.lit("c"), conv).alias("id"), F.concat(F.lit("talk "), conv).alias("title"), "mapping")
    return g.select(conv.alias("path"), F.to_json(F.array(one)).alias("value"))


def mixed_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of both forms, of a form without a parser, of no form, and broken ones, by conv_id."""
    lists, maps = export_text(spark, sf_dir, "list"), export_text(spark, sf_dir, "map").withColumnRenamed("value", "other")
    n = F.col("path").cast("long") % 5
    value = F.when(n == 0, F.col("value")).when(n == 1, F.col("other")).when(n == 2, F.lit('{"chats": []}')).when(n == 3, F.concat(F.lit("not "), "value")).otherwise(F.lit('{"other": 1}'))
    return lists.join(maps, "path").select("path", value.alias("value"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excavation records: a file for each document, one chunk for each line, its e-mail addresses and dates as entities."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("int").alias("index"), x.alias("content"), S.word_count(x).alias("word_count")))
    found = lambda kind: F.transform(F.slice(F.regexp_extract_all("text", F.lit(V.ENTITY_RULES[kind][0]), F.lit(0)), 1, V.ENTITY_RULES[kind][1]), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    k = F.col("doc_id").cast("string")
    return d.select(F.col("source").alias("machine"), k.alias("file_id"), F.concat(F.lit("/home/"), "lang", F.lit("/"), k, F.lit(".TXT")).alias("file_path"), F.concat(k, F.lit(".TXT")).alias("file_name"), lines.alias("chunks"), F.concat(found("EMAIL"), found("DATE")).alias("entities"))
