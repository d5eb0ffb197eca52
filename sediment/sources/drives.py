"""Files of drives and folders, text and DOCX from their bytes, and excavations: what a portable run leaves behind, as JSON."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocabulary as V

KNOWN = sorted({e for es in V.EXTRACTORS.values() for e in es})
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RECORD = "file_id string, file_path string, file_name string, chunks array<struct<index:int,content:string,word_count:int>>, entities array<struct<type:string,value:string>>"


def extension_of(name: Column) -> Column:
    """The lower-case extension without its dot; empty without one."""
    return F.lower(F.regexp_extract(name, r"[^./]\.([^./]*)$", 1))


def extractor_of(extension: Column) -> Column:
    return S.literal_map({e: x for x, es in V.EXTRACTORS.items() for e in es})[F.lower(extension)]


def no_extractor(extension: Column) -> Column:
    """What is wrong with a file of no known extension; null for the others."""
    return F.when(extractor_of(extension).isNull(), F.concat(F.lit("No extractor for extension: "), F.when(extension != "", ".").otherwise(""), extension))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), name, extension, size_bytes and modified_at of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.substring_index("path", f"{base}/", -1)
    out = files.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    out = out.withColumn("name", F.substring_index("path", "/", -1))
    return out.withColumn("extension", extension_of(F.col("name")))


def tables_whole(files: DataFrame) -> DataFrame:
    """A listing in which a Parquet table that is a folder of parts is one file: the folder, with the size of all parts and the last time of any."""
    folder = F.regexp_extract("path", r"^((?:.*?/)?[^/]+\.(?i:parquet))/", 1)
    out = files.groupBy(F.when(folder != "", folder).otherwise(F.col("path")).alias("path")).agg(F.sum("size_bytes").alias("size_bytes"), F.max("modified_at").alias("modified_at"))
    out = out.withColumn("name", F.substring_index("path", "/", -1))
    return out.withColumn("extension", extension_of(F.col("name")))


def walk(files: DataFrame, extensions: list[str] = KNOWN) -> DataFrame:
    """Of a listing the files of known extensions outside hidden and skipped folders."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    skipped = F.exists(folders, lambda f: f.startswith(".") | f.isin(V.SKIPPED_FOLDERS))
    return files.filter(~skipped & F.col("extension").isin(extensions))


def discover(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files (path, name, extension) under enabled sources (root, enabled, recursive, file_types), with the root, once for each that has them.

    No file types mean all; a source that is not recursive has its own files only. Excluded paths and names stay out.
    """
    own = F.when(F.col("root") == "", F.lit("")).otherwise(F.concat("root", F.lit("/")))
    rest = F.substring(F.col("path"), F.length(own) + 1, F.length("path"))
    kinds = F.coalesce("file_types", F.array().cast("array<string>"))
    fits = (F.size(kinds) == 0) | F.array_contains(kinds, F.col("extension"))
    rows = files.join(F.broadcast(sources.filter("enabled")), F.col("path").startswith(own) & fits & (F.col("recursive") | ~rest.contains("/")))
    return rows.filter(S.included(F.concat(F.lit("/"), "path"), F.col("name")))


def export_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("extension").isin("json", "html"))


def text_of(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are none."""
    return F.when(F.is_valid_utf8(content), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def lines_of(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def docx_text(data: bytes) -> tuple[str, int, int, str | None]:
    """Text, paragraphs, tables and error of a DOCX file: paragraphs that are not blank, then the rows of its tables."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        signs = {f"{W}tab": "\t", f"{W}br": "\n"}
        said = lambda x: "".join((t.text or "") if t.tag == f"{W}t" else signs.get(t.tag, "") for t in x.iter())
        parts = [t for t in (said(p) for p in body.findall(f"{W}p")) if t.strip()]
        tables = body.findall(f"{W}tbl")
        rows = [" | ".join("\n".join(said(p) for p in c.findall(f"{W}p")) for c in r.findall(f"{W}tc")) for t in tables for r in t.findall(f"{W}tr")]
        return "\n\n".join(parts) + ("\n\n[Tables]\n" + "\n".join(rows) if rows else ""), len(parts), len(tables), None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
        return "", 0, 0, str(e) or type(e).__name__


def docx_of(paragraphs: list[str], tables: list[list[list[str]]]) -> bytes:
    """A DOCX file of paragraphs and tables."""
    body = ElementTree.Element(f"{W}body")

    def paragraph(at, text: str) -> None:
        ElementTree.SubElement(ElementTree.SubElement(ElementTree.SubElement(at, f"{W}p"), f"{W}r"), f"{W}t").text = text

    for text in paragraphs:
        paragraph(body, text)
    for table in tables:
        at = ElementTree.SubElement(body, f"{W}tbl")
        for row in table:
            line = ElementTree.SubElement(at, f"{W}tr")
            for cell in row:
                paragraph(ElementTree.SubElement(line, f"{W}tc"), cell)
    document = ElementTree.Element(f"{W}document")
    document.append(body)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", ElementTree.tostring(document, encoding="utf-8", xml_declaration=True))
    return out.getvalue()


def docx(files: DataFrame, content: str = "content") -> DataFrame:
    """Files (file_id and bytes) with text, paragraph_count, table_count and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file_id, data in zip(b.column(0), b.column(1)):
                text, parts, tables, error = docx_text(data.as_py() or b"")
                yield pa.RecordBatch.from_arrays([pa.array([file_id.as_py()], b.column(0).type), pa.array([text]), pa.array([parts], pa.int32()), pa.array([tables], pa.int32()), pa.array([error], pa.string())], ["file_id", "text", "paragraph_count", "table_count", "error"])

    kind = dict(files.dtypes)["file_id"]
    return files.select("file_id", content).mapInArrow(run, f"file_id {kind}, text string, paragraph_count int, table_count int, error string")


def write_excavations(records: DataFrame, folder: str, summary: DataFrame) -> None:
    """A folder for each machine: its records (see RECORD, and machine) as lines of JSON under chunks, and metadata (machine_id and counts).

    Files hold as many records as a task has: a file for each record would drown a large store's name space.
    """
    records.write.partitionBy("machine").mode("append").json(f"{folder}/chunks")
    summary.withColumn("machine", F.col("machine_id")).write.partitionBy("machine").mode("append").json(f"{folder}/metadata")


def read_excavations(spark: SparkSession, folder: str) -> DataFrame:
    """machine and the fields of RECORD of all excavations in a folder; lines that are no JSON are left out.

    Besides the layout of write_excavations it reads <folder>/<machine>/chunks/*.json, one object a file.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder).withColumn("_path", F.input_file_name())
    place = F.regexp_extract("_path", r"/chunks/machine=([^/]+)/[^/]*$|/([^/]+)/(?:chunks|entities)/[^/]*$", 0)
    machine = F.coalesce(F.nullif(F.regexp_extract(place, r"machine=([^/]+)/", 1), F.lit("")), F.nullif(F.regexp_extract(place, r"^/([^/]+)/(?:chunks|entities)/", 1), F.lit("")))
    rows = text.withColumn("machine", machine).filter("machine is not null").select("machine", F.from_json("value", RECORD).alias("r"))
    return rows.filter("r.file_id is not null").select("machine", "r.*")


def find_excavations(spark: SparkSession, folder: str) -> DataFrame:
    """machine, path of the folders below one that have metadata: <folder>/<machine>/metadata/excavation.json, or those of write_excavations."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for pattern, part in (("*/metadata/excavation.json", -3), ("metadata/machine=*/*.json", -2)):
        for x in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")) or []:
            steps = x.getPath().toString().split("/")
            found.append((steps[part].removeprefix("machine="), "/".join(steps[: part + 1])))
    return spark.createDataFrame(sorted(set(found)), "machine string, path string")


def not_synced(excavations: DataFrame, log: DataFrame) -> DataFrame:
    """Excavations (machine, ...) that no line of the log (excavation_id, status) calls completed."""
    done = log.filter("status = 'completed'").select(F.col("excavation_id").alias("machine")).distinct()
    return excavations.join(done, "machine", "left_anti")


def synced_rows(records: DataFrame, tagged: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, chunks and entities of excavation records; tagged puts the machine into ids and paths, as a merge of machines does."""
    file_id = F.concat_ws("_", "machine", "file_id") if tagged else F.col("file_id")
    path = F.concat(F.lit("["), "machine", F.lit("] "), "file_path") if tagged else F.col("file_path")
    base = records.select("machine", file_id.alias("file_id"), path.alias("path"), F.col("file_name").alias("filename"), extension_of(F.col("file_path")).alias("extension"), "chunks", "entities")
    files = base.select(F.col("file_id").alias("id"), "path", "filename", "extension", F.lit("synced").alias("status"), "machine").dropDuplicates(["id"])
    chunks = base.select("machine", "file_id", F.explode("chunks").alias("c")).select(S.generate_id("chunk", F.concat_ws("_", "file_id", F.col("c.index").cast("string"))).alias("id"), "machine", "file_id", F.col("c.index").alias("chunk_index"), "c.content", F.lit("paragraph").alias("chunk_type"))
    entities = base.select("machine", "file_id", F.posexplode("entities").alias("i", "e")).select(S.generate_id("ent", F.concat_ws("_", "file_id", F.col("i").cast("string"))).alias("id"), "machine", "file_id", "i", F.coalesce("e.type", F.lit("UNKNOWN")).alias("entity_type"), "e.value", F.lower("e.value").alias("normalized"), F.lit(0.8).alias("confidence"))
    return files, chunks, entities
