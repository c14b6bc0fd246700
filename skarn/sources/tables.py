"""Sources and sinks: page bundles, JSON lines, traces, versioned tables, checksum inventories, SQL passthrough."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = "paper_id string, page int, text string"
CHUNK = (
    "chunk_id string, evidence_id string, document_id string, source_paper_id string, page int, section_title string, section_path array<string>, chunk_type string, "
    "text string, char_start int, char_end int, is_figure_chunk boolean, is_table_chunk boolean, label string, caption string"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A1/A2: JSON arrays of pages, white space squeezed, pages counted from 1."""
    raw = spark.read.schema(PAGE).option("multiLine", True).json(path)
    return raw.withColumn("text", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A2: chunk bundles with one fixed nullable schema; malformed files fail the read."""
    return spark.read.schema(CHUNK).option("multiLine", True).option("mode", "FAILFAST").json(path)


def union_papers(anchor: DataFrame, others: list[DataFrame], anchor_id: str) -> DataFrame:
    """A3: the anchor's chunks and those of further papers; a missing source is the anchor."""
    out = anchor.withColumn("source_paper_id", F.coalesce("source_paper_id", F.lit(anchor_id)))
    for o in others:
        out = out.unionByName(o, allowMissingColumns=True)
    return out


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_json_lines(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """JSON lines of uncompressed files, read in splits; a blank line, a missing last line feed, bytes that are no UTF-8
    and repeated keys raise ValueError, a line that is no JSON of the schema fails the query that reads it.

    Lines are cut at line feeds alone, so the bytes of a file's lines, one more for each line, are the file's size exactly
    when it ends in a line feed: no task reads a file as a whole.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    files = lines.groupBy("file").agg(
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"), F.count_if(F.col("value").rlike(r"^\s*$")).alias("blank"), F.count_if(~F.is_valid_utf8("value")).alias("broken")
    )
    found = files.select(F.when(F.col("bytes") != F.col("size"), "has no final line feed").when(F.col("blank") > 0, "has a blank line").when(F.col("broken") > 0, "is no UTF-8").alias("what"), "file")
    bad = found.filter("what IS NOT NULL").orderBy("file").first()
    if bad:
        raise ValueError(f"{bad.file} {bad.what}")
    rows = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    if rows.groupBy(*key).count().filter("count > 1").limit(1).count():
        raise ValueError("repeated keys")
    return rows


def read_atom(spark: SparkSession, rows: DataFrame, column: str = "xml") -> DataFrame:
    """(id, title, summary, authors, published) of Atom feeds held as text."""
    entry = F.from_xml(column, "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>>>")
    e = rows.select(F.explode(entry["entry"]).alias("e"))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return e.select("e.id", squeeze("e.title").alias("title"), squeeze("e.summary").alias("summary"), F.transform("e.author", lambda a: a["name"]).alias("authors"), "e.published")


def write_generation(df: DataFrame, path: str, partition: str) -> None:
    """B1: replace the rows of the papers in df and leave the others, by dynamic partition overwrite."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def section_rows(chunks: DataFrame) -> DataFrame:
    """B2: the first chunk of each (paper, section title)."""
    order = Window.partitionBy("paper_id", "section_title").orderBy("ord")
    return chunks.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def sql(spark: SparkSession, statement: str, args: dict | list | None = None, **tables: DataFrame) -> DataFrame:
    """A parameterised SELECT over the given tables; values are bound, never pasted."""
    return spark.sql(statement, args=args or {}, **tables)


def document_tree(chunks: DataFrame) -> DataFrame:
    """One row a document with its chunks in order; the caller keeps documents of bounded size."""
    node = F.struct("ord", "section_title", "text")
    return chunks.groupBy("paper_id").agg(F.sort_array(F.collect_list(node)).alias("chunks"))


TRACE_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_traces(df: DataFrame, path: str) -> None:
    """Answer traces as JSON lines; times keep their microseconds."""
    df.write.mode("append").option("timestampFormat", TRACE_TIME + "XXX").option("timestampNTZFormat", TRACE_TIME).json(path)


def list_traces(spark: SparkSession, path: str, schema: str, limit: int) -> DataFrame:
    """The latest `limit` traces at path by ts, then trace_id."""
    return spark.read.schema(schema).option("timestampFormat", TRACE_TIME + "[XXX]").option("timestampNTZFormat", TRACE_TIME).json(path).orderBy(F.col("ts").desc(), F.col("trace_id").desc()).limit(limit)


#: Tables and their columns; the first partitions the files of papers' tables. Keys and indexes have no counterpart.
LAYOUT = {
    "papers": {"paper_id": "string", "title": "string", "summary": "string", "authors": "array<string>", "published": "string"},
    "sections": {"paper_id": "string", "section_title": "string", "ord": "int", "page": "int"},
    "chunks": {"paper_id": "string", "ord": "int", "section_title": "string", "text": "string"},
    "figures": {"paper_id": "string", "figure_id": "string", "page": "int", "caption": "string", "image_file": "string"},
}


def layout_ddl(name: str) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in LAYOUT[name].items())


def create_tables(spark: SparkSession, database: str) -> None:
    """The tables of LAYOUT in a database of the catalog, partitioned by paper; existing ones are left alone."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name in LAYOUT:
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({layout_ddl(name)}) USING parquet PARTITIONED BY (paper_id)")


def _plain(kind: T.DataType):
    """A function from Arrow's Python value of a type to what json.dumps takes: structs and maps as dicts, dates as text."""
    if isinstance(kind, T.StructType):
        parts = [(f.name, _plain(f.dataType)) for f in kind.fields]
        return lambda v: None if v is None else {name: plain(v[name]) for name, plain in parts}
    if isinstance(kind, T.ArrayType):
        of = _plain(kind.elementType)
        return lambda v: None if v is None else [of(x) for x in v]
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise ValueError(f"keys of JSON objects are strings, not {kind.keyType.simpleString()}")
        of = _plain(kind.valueType)
        return lambda v: None if v is None else {k: of(x) for k, x in (v.items() if isinstance(v, dict) else v)}
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return lambda v: None if v is None else v.isoformat()
    if isinstance(kind, T.DecimalType):
        return lambda v: None if v is None else str(v)
    if isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.DoubleType, T.NullType)):
        return lambda v: v
    raise ValueError(f"{kind.simpleString()} has no canonical JSON")


def _without_nulls(value, deep: bool):
    if isinstance(value, dict):
        return {k: _without_nulls(v, deep) if deep else v for k, v in value.items() if v is not None}
    return [_without_nulls(v, deep) for v in value] if deep and isinstance(value, list) else value


def canonical_json(df: DataFrame, indent: int | None = None, drop_nulls: str = "none", name: str = "json", keep: list[str] | None = None) -> DataFrame:
    """(*keep, json): each row as the bytes that Python's json.dumps gives with keys sorted at every depth and characters
    as they are: compact, or with `indent` spaces and a final line feed, as whole files are written.

    Any schema of structs, arrays, maps with string keys, texts, numbers and booleans goes; dates and timestamps are ISO
    texts, decimals their digits; float and binary columns are refused, as they have no exact form. Numbers that JSON has
    no form for (NaN, infinities) fail the query. drop_nulls: none, top (of the row alone) or all depths; nulls in arrays
    stay. json is made of the columns that are not in keep.
    """
    keep = keep or []
    mine = [c for c in df.columns if c not in keep]
    plain = _plain(T.StructType([df.schema[c] for c in mine]))

    def text(row):
        value = plain(row)
        if drop_nulls != "none":
            value = _without_nulls(value, drop_nulls == "all")
        how = {"separators": (",", ":")} if indent is None else {"indent": indent}
        return json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False, **how) + ("" if indent is None else "\n")

    def run(batches):
        for batch in batches:
            values = [text(dict(zip(mine, row))) for row in zip(*(batch.column(i).to_pylist() for i in range(len(mine))))] if mine else [text({})] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(len(mine) + i) for i in range(len(keep))), pa.array(values, pa.string())], [*keep, name])

    out = T.StructType([*[df.schema[c] for c in keep], T.StructField(name, T.StringType())])
    return df.select(*mine, *keep).mapInArrow(run, out)


def publish(df: DataFrame, root: str, version: str, checks: list) -> str:
    """Write a version folder, validate what was written, and return its path. A version that fails is deleted.

    Readers follow the pointer that move_pointer() sets after this returns, so they never see half a version, and the
    version before stays current when this one fails.
    """
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    written = df.sparkSession.read.parquet(path)
    faults = [name for name, check in checks if not check(written)]
    if faults:
        _files(df.sparkSession, path, lambda fs, at: fs.delete(at, True))
        raise ValueError(f"version {version} fails: {', '.join(faults)}")
    return path


def _files(spark: SparkSession, path: str, use):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return use(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


def move_pointer(spark: SparkSession, root: str, version: str) -> None:
    """Make a published version the current one: a pointer file of a higher number, renamed into place."""
    root = root.rstrip("/")
    if not _files(spark, f"{root}/version={version}/_SUCCESS", lambda fs, at: fs.exists(at)):
        raise ValueError(f"version {version} is not published")
    n = len(_pointers(spark, root))
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_pointer-{n:09d}@{version}")
    hidden = f"{root}/_moving-{n:09d}"
    _files(spark, hidden, lambda fs, at: fs.create(at, True).close())
    if not _files(spark, hidden, lambda fs, at: fs.rename(at, new)):
        raise ValueError("the pointer was moved at the same time")


def _pointers(spark: SparkSession, root: str) -> list[str]:
    found = _files(spark, f"{root.rstrip('/')}/_pointer-*", lambda fs, at: fs.globStatus(at))
    return sorted(f.getPath().getName() for f in found or [])


def current_version(spark: SparkSession, root: str) -> str:
    """The path of the version that the pointer names."""
    found = _pointers(spark, root)
    if not found:
        raise ValueError("no version is published")
    return f"{root.rstrip('/')}/version={found[-1].partition('@')[2]}"


def load_if_complete(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame | None:
    """The table at path when its counts by paper equal the manifest (paper_id, n), else None."""
    rows = spark.read.parquet(path)
    got = rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    want = manifest.select("paper_id", F.col("n").cast("long").alias("n"))
    return None if got.exceptAll(want).limit(1).count() or want.exceptAll(got).limit(1).count() else rows


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV files with a header."""
    df.write.option("header", True).csv(path)


def latex_report(title: str, sections: dict[str, list[str]]) -> str:
    """A small report as a LaTeX document: paragraphs a section, special characters escaped."""
    safe = lambda v: "".join("\\" + c if c in "&%$#_{}" else c for c in v)
    body = "\n".join(f"\\section{{{safe(name)}}}\n" + "\n\n".join(map(safe, lines)) for name, lines in sections.items())
    return f"\\documentclass{{article}}\n\\title{{{safe(title)}}}\n\\begin{{document}}\n\\maketitle\n{body}\n\\end{{document}}\n"


def latex_table(rows: Iterator, columns: list[str]) -> str:
    """A small result as a LaTeX tabular; special characters are escaped."""
    safe = lambda v: "" if v is None else "".join("\\" + c if c in "&%$#_{}" else c for c in str(v))
    body = " \\\\\n".join(" & ".join(safe(r[c]) for c in columns) for r in rows)
    return f"\\begin{{tabular}}{{{'l' * len(columns)}}}\n{' & '.join(map(safe, columns))} \\\\ \\hline\n{body} \\\\\n\\end{{tabular}}\n"


def markdown_report(rows: Iterator, columns: list[str], title: str) -> str:
    """A small result as a Markdown report."""
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(str(r[c]).replace("|", "\\|") for c in columns) + " |" for r in rows]) + "\n"
