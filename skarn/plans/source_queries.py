"""Registered queries for sources and sinks: tables written to the shared folder, read back and compared, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.session import shared_folder, table
from skarn.sources import tables as S

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _bundles(rows, path: str, by: str) -> None:
    """rows as JSON arrays, one file for each value of `by`."""
    others = F.struct(*[c for c in rows.columns if c != "__by"])
    arrays = rows.withColumn("__by", F.col(by)).groupBy("__by").agg(F.to_json(F.sort_array(F.collect_list(others))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)


_SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("source_pages", f"SELECT source AS paper_id, CAST(doc_id AS INT) AS page, md5({_SQUEEZED}) AS text_md5 FROM documents")
def source_pages(spark, sf_dir):
    """A1/A2: page bundles of every source."""
    path = shared_folder(spark, "pages")
    _bundles(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("page"), F.col("source").alias("paper_id"), "text"), path, "paper_id")
    return S.read_pages(spark, path).select("paper_id", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "source_chunks",
    """SELECT coalesce(CASE WHEN doc_id % 3 <> 0 THEN source END, 'anchor') AS source_paper_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) FILTER (doc_id % 5 = 0) AS n_tables FROM documents GROUP BY 1
    UNION ALL SELECT 'other', count(*), CAST(sum(length(text)) AS BIGINT), 0 FROM benchmark""",
)
def source_chunks(spark, sf_dir):
    """A2/A3: chunk bundles of an anchor, read with their fixed schema, and the chunks of a further paper."""
    d, path = table(spark, sf_dir, "documents"), shared_folder(spark, "chunks")
    rows = d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source_paper_id"), "text", (F.col("doc_id") % 5 == 0).alias("is_table_chunk"), F.lit(1).alias("page"))
    _bundles(rows.withColumn("lot", F.col("page") + F.crc32(F.col("chunk_id").cast("binary")) % 7), path, "lot")
    other = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), F.lit("other").alias("source_paper_id"), "text", F.lit(False).alias("is_table_chunk"))
    both = S.union_papers(S.read_chunks(spark, path), [other], "anchor")
    return both.groupBy("source_paper_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), F.count_if("is_table_chunk").alias("n_tables"))


@query("file_checksums", "SELECT sha256(n_name || chr(10)) AS sha256, CAST(length(n_name) + 1 AS BIGINT) AS length FROM nation")
def file_checksums(spark, sf_dir):
    """The checksum inventory of one file a nation."""
    path = shared_folder(spark, "files")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return S.read_binary(spark, path, "*.txt").select("sha256", "length")


@query(
    "json_line_rows",
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders",
)
def json_line_rows(spark, sf_dir):
    """Rows written as JSON lines and read by the strict reader."""
    path = shared_folder(spark, "lines")
    S.write_traces(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), path)
    return S.read_json_lines(spark, path, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string", ["o_orderkey"])


@query("trace_listing", "SELECT event_id AS trace_id, ts, event_type AS status FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def trace_listing(spark, sf_dir):
    """The latest hundred traces."""
    path = shared_folder(spark, "traces")
    S.write_traces(table(spark, sf_dir, "events").select(F.col("event_id").alias("trace_id"), "ts", F.col("event_type").alias("status")), path)
    return S.list_traces(spark, path, "trace_id long, ts timestamp, status string", 100)


@query("atom_entries", "SELECT 'http://papers/' || p_partkey AS id, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS title, 'a,b' AS authors FROM part")
def atom_entries(spark, sf_dir):
    """Feeds with two entries each."""
    part = table(spark, sf_dir, "part")
    entry = F.concat(F.lit("<entry><id>http://papers/"), F.col("p_partkey").cast("string"), F.lit("</id><title> "), F.replace("p_name", F.lit(" "), F.lit(" \n ")), F.lit(" </title><author><name>a</name></author><author><name>b</name></author></entry>"))
    feeds = part.groupBy(F.floor(F.col("p_partkey") / 2).alias("k")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("xml"))
    return S.read_atom(spark, feeds).select("id", "title", F.array_join("authors", ",").alias("authors"))


@query(
    "replaced_generations",
    "SELECT n_regionkey AS paper_id, count(*) AS n, CAST(sum(CASE WHEN n_regionkey % 2 = 0 THEN n_nationkey * 10 ELSE n_nationkey END) AS BIGINT) AS total FROM nation GROUP BY 1",
)
def replaced_generations(spark, sf_dir):
    """B1: papers written again replace their rows and leave the others."""
    path, n = shared_folder(spark, "generation"), table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_regionkey").alias("paper_id"), F.col("n_nationkey").alias("k"))
    S.write_generation(rows, path, "paper_id")
    S.write_generation(rows.filter("paper_id % 2 = 0").withColumn("k", F.col("k") * 10), path, "paper_id")
    return spark.read.parquet(path).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.sum("k").cast("long").alias("total"))


@query("first_sections", "SELECT paper_id, section_title, min(ord) AS ord FROM (SELECT conv_id AS paper_id, role AS section_title, turn AS ord FROM conversations) GROUP BY 1, 2")
def first_sections(spark, sf_dir):
    """B2: the first chunk of each section."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("role").alias("section_title"), F.col("turn").alias("ord"), "text")
    return S.section_rows(rows).select("paper_id", "section_title", "ord")


@query("bound_sql", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name > 'A''; DROP' AND n_nationkey < 20")
def bound_sql(spark, sf_dir):
    """A statement with bound values over given tables."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return S.sql(spark, "SELECT n_name, r_name FROM {n} JOIN {r} ON n_regionkey = r_regionkey WHERE r_name > :least AND n_nationkey < :most", {"least": "A'; DROP", "most": 20}, n=n, r=r)


@query(
    "document_trees",
    "SELECT conv_id AS paper_id, count(*) AS n, md5(string_agg(turn || ':' || role || ':' || text, '|' ORDER BY turn)) AS tree FROM conversations GROUP BY 1",
)
def document_trees(spark, sf_dir):
    """Every conversation as a document with its turns as chunks, after a round trip through the catalog's layout."""
    path = shared_folder(spark, "layout")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("paper_id"), F.col("turn").cast("int").alias("ord"), F.col("role").alias("section_title"), "text")
    S.write_generation(rows.select(*S.LAYOUT["chunks"]), path, "paper_id")
    back = spark.read.schema(S.layout_ddl("chunks")).parquet(path)
    parts = F.transform("chunks", lambda c: F.concat_ws(":", c["ord"].cast("string"), c["section_title"], c["text"]))
    return S.document_tree(back).select(F.col("paper_id").cast("long").alias("paper_id"), F.size("chunks").cast("long").alias("n"), F.md5(F.array_join(parts, "|").cast("binary")).alias("tree"))


@query(
    "canonical_rows",
    """SELECT '{"account":{"balance":' || CAST(c_acctbal AS VARCHAR) || ',"negative":' || (c_acctbal < 0) || '},"id":' || c_custkey || ',"name":"' || c_name || '","nation":' || CASE WHEN c_nationkey % 4 = 0 THEN 'null' ELSE CAST(c_nationkey AS VARCHAR) END
    || ',"tags":["' || lower(c_mktsegment) || '",null,"é \\"quoted\\""],"weights":{"a":0.5,"b":' || (c_custkey % 3) || '.0}}' AS json FROM customer""",
)
def canonical_rows(spark, sf_dir):
    """Nested rows with keys sorted at every depth, nulls and escapes as Python writes them."""
    c = table(spark, sf_dir, "customer")
    account = F.struct((F.col("c_acctbal") < 0).alias("negative"), F.col("c_acctbal").alias("balance"))
    weights = F.create_map(F.lit("b"), (F.col("c_custkey") % 3).cast("double"), F.lit("a"), F.lit(0.5))
    tags = F.array(F.lower("c_mktsegment"), F.lit(None).cast("string"), F.lit('é "quoted"'))
    return S.canonical_json(c.select(weights.alias("weights"), F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey")).alias("nation"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), tags.alias("tags"), account.alias("account")))


@query("published_version", "SELECT o_orderstatus AS paper_id, count(*) AS n FROM orders GROUP BY 1")
def published_version(spark, sf_dir):
    """A second version that fails its check leaves the first one current; it is complete by its manifest."""
    root = shared_folder(spark, "versions")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("paper_id"), "o_orderkey")
    S.publish(rows, root, "1", [("rows", lambda d: not d.isEmpty())])
    S.move_pointer(spark, root, "1")
    try:
        S.publish(rows.limit(0), root, "2", [("rows", lambda d: not d.isEmpty())])
        S.move_pointer(spark, root, "2")
    except ValueError:
        pass  # what this query shows: the pointer has not moved
    manifest = rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    found = S.load_if_complete(spark, S.current_version(spark, root), manifest)
    return found.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))


@query("summary_csv", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def summary_csv(spark, sf_dir):
    """A summary table as CSV with a header, read back."""
    path = shared_folder(spark, "summary")
    S.write_csv(table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("o_orderpriority string, n long").option("header", True).csv(path)
