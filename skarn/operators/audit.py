"""Audit of a release folder: declared constraints over its files, JSON documents and row tables; violations as rows.

    configs/release_config.json   release_id, run_id, schema_version, study_status, dataset {sha256, evidence_class,
                                  claim_status}, systems, models, seeds, metrics [{name, denominator}], protocol_sha256
    configs/protocol.json         the frozen protocol, unless the evidence class is toy
    expected/, raw/, scored/      JSON lines of rows: KEY, and but for expected release_id, run_id, schema_version, status,
                                  condition_sha256; raw rows also have their identity
    aggregates/summary.json       release_id, run_id, schema_version, n_expected, status_counts, metric_names, groups
    tables/                       summary.csv, summary.tex, provenance.json {schema_version, aggregate_sha256}
    manifest.json                 the config's parts as they were, lifecycle_status, n_expected, status_counts, artifacts
    checksums.sha256              the SHA-256 and name of every other file

Files are read and hashed once; rows are compared by equi-joins and grouped counts; documents are single rows whose rules are a
table of SQL conditions over variants.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.session import written

KEY = ["system", "model", "seed", "case_id"]
ROW = "system string, model string, seed long, case_id string, release_id string, run_id string, schema_version string, status string, condition_sha256 string"
DOCUMENTS = {"config": "configs/release_config.json", "summary": "aggregates/summary.json", "provenance": "tables/provenance.json", "manifest": "manifest.json", "sums": "checksums.sha256"}
TABLES = {"csv": "tables/summary.csv", "tex": "tables/summary.tex"}
ROWS = ["expected", "raw", "scored"]
TEMPLATES = ['"artifact_type":"template"', '"study_status":"NOT_STARTED"']


def _at(document: str, path: str, kind: str = "string") -> str:
    return f"try_variant_get({document}, '$.{path}', '{kind}')"


def _same(path: str, other: str | None = None) -> str:
    """A part of the manifest that is not what the config has."""
    return f"NOT (to_json({_at('manifest', path, 'variant')}) <=> to_json({_at('config', other or path, 'variant')}))"


_TOY = f"{_at('config', 'dataset.evidence_class')} = 'toy'"
#: (code, condition of a violation) over the documents of a release, n_raw statuses as `counted` and hashes by file name.
RULES = [
    ("documents disagree on the release", "size(array_distinct(array({}))) > 1".format(", ".join(f"concat_ws('/', coalesce({_at(d, 'release_id')}, ''), coalesce({_at(d, 'run_id')}, ''))" for d in ("config", "summary", "manifest")))),
    ("documents disagree on the schema version", "size(array_distinct(array({}))) > 1".format(", ".join(f"coalesce({_at(d, 'schema_version')}, '')" for d in ("config", "summary", "manifest", "provenance")))),
    ("config is not READY", f"NOT ({_at('config', 'study_status')} <=> 'READY')"),
    ("protocol is missing", f"NOT ({_TOY}) AND hashes['configs/protocol.json'] IS NULL"),
    ("protocol differs from its hash", f"NOT ({_TOY}) AND hashes['configs/protocol.json'] <> coalesce({_at('config', 'protocol_sha256')}, '')"),
    ("lifecycle is incomplete", f"NOT coalesce({_at('manifest', 'lifecycle_status')} IN ('AGGREGATED', 'VALIDATED'), FALSE)"),
    ("manifest classification differs", f"{_same('evidence_class', 'dataset.evidence_class')} OR {_same('claim_status', 'dataset.claim_status')}"),
    ("empirical release is not current", f"NOT ({_at('manifest', 'evidence_class')} <=> 'toy') AND NOT ({_at('manifest', 'claim_status')} <=> 'current')"),
    ("toy release is classified as one", f"{_at('manifest', 'evidence_class')} <=> 'toy' AND NOT ({_at('manifest', 'claim_status')} <=> 'non_release')"),
    *[(f"manifest {name} differ", _same(name)) for name in ("dataset", "systems", "models", "seeds", "experiment")],
    ("number of expected rows differs", f"NOT ({_at('manifest', 'n_expected', 'bigint')} <=> n_expected AND {_at('summary', 'n_expected', 'bigint')} <=> n_expected)"),
    ("manifest status counts differ", f"NOT (array_sort(map_entries({_at('manifest', 'status_counts', 'map<string,bigint>')})) <=> array_sort(map_entries(counted)))"),
    ("aggregate status counts differ", f"NOT (array_sort(map_entries({_at('summary', 'status_counts', 'map<string,bigint>')})) <=> array_sort(map_entries(counted)))"),
    ("metric names differ", f"NOT ({_at('summary', 'metric_names', 'array<string>')} <=> transform({_at('config', 'metrics', 'array<variant>')}, m -> try_variant_get(m, '$.name', 'string')))"),
    ("group without expected rows", f"exists({_at('summary', 'groups', 'array<variant>')}, g -> coalesce(try_variant_get(g, '$.n_expected', 'bigint'), 0) <= 0)"),
    (
        "metric dropped a case denominator",
        f"exists({_at('summary', 'groups', 'array<variant>')}, g -> exists(filter({_at('config', 'metrics', 'array<variant>')}, m -> try_variant_get(m, '$.denominator', 'string') = 'all_expected'), "
        "m -> NOT (try_variant_get(g, '$.metric_case_denominators', 'map<string,bigint>')[try_variant_get(m, '$.name', 'string')] <=> try_variant_get(g, '$.n_cases', 'bigint'))))",
    ),
    ("provenance has a stale aggregate hash", f"NOT ({_at('provenance', 'aggregate_sha256')} <=> hashes['aggregates/summary.json'])"),
    *[(f"{name} lacks the aggregate hash", f"NOT contains({d}, hashes['aggregates/summary.json'])") for d, name in TABLES.items()],
]


def inventory(spark: SparkSession, root: str, forbidden: list[str], private: list[str]) -> DataFrame:
    """(name, sha256, text, found): every file below root, the text of documents and tables, and what its text must not hold."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(root.rstrip("/").rsplit("/", 1)[-1])
    name = F.regexp_extract("path", f"^.*?/{base}/(.*)$", 1)
    text = F.col("content").cast("string")
    bare = F.replace(text, F.lit(" "), F.lit(""))
    readable = F.col("name").rlike(r"\.(json|jsonl|csv|tex|md)$")
    bad = [F.when(bare.contains(t), "template") for t in TEMPLATES] + [F.when(text.contains(t), F.lit(f"forbidden: {t}")) for t in forbidden] + [F.when(text.rlike(p), "private") for p in private]
    kept = F.col("name").isin(*DOCUMENTS.values(), *TABLES.values())
    rows = files.withColumn("name", name).filter(~F.col("name").rlike(r"(^|/)__pycache__/|\.pyc$"))
    found = F.when(readable, F.array_distinct(F.array_compact(F.array(*bad)))).otherwise(F.array().cast("array<string>"))
    return written(rows.select("name", F.sha2("content", 256).alias("sha256"), F.when(kept, text).alias("text"), found.alias("found")), "release-files")


@F.pandas_udf(T.StringType())
def condition_digest(identity: pd.Series) -> pd.Series:
    """The SHA-256 of JSON objects in canonical form, keys without a value left out; numbers keep the form that they have."""

    def one(text):
        value = {k: v for k, v in json.loads(text).items() if v is not None}
        return hashlib.sha256((json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n").encode()).hexdigest()

    return identity.map(one, na_action="ignore")


def _counted(df: DataFrame, code: str, subject=None) -> DataFrame:
    return df.select(F.lit(code).alias("code"), (F.lit("") if subject is None else subject).alias("subject"))


def audit_release(spark: SparkSession, root: str, forbidden: list[str] | None = None, private: list[str] | None = None) -> DataFrame:
    """(code, subject) of every violation in the release folder at root; none when the release is whole.

    forbidden: texts, and private: patterns, that no text file may hold. When a file or folder is missing, only that is said.
    """
    files = inventory(spark, root, forbidden or [], private or [])
    needed = [*DOCUMENTS.values(), *TABLES.values()]
    there = {r.name for r in files.filter(F.col("name").isin(*needed)).select("name").collect()} | {r.d for r in files.select(F.split("name", "/")[0].alias("d")).distinct().filter(F.col("d").isin(*ROWS)).collect()}
    missing = [(f"missing: {n}", n) for n in [*needed, *ROWS] if n not in there]
    if missing:
        return spark.createDataFrame([("release is incomplete", n) for _, n in missing], "code string, subject string")

    rows = {n: spark.read.schema(ROW).option("mode", "FAILFAST").json(f"{root}/{n}") for n in ROWS}
    texts = files.agg(*[F.max(F.when(F.col("name") == n, F.col("text"))).alias(d) for d, n in (DOCUMENTS | TABLES).items()], F.map_from_entries(F.collect_list(F.when(~F.col("name").rlike(f"^({'|'.join(ROWS)})/"), F.struct("name", "sha256")))).alias("hashes"))
    counts = rows["raw"].groupBy("status").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("counted"))  # a row a status
    n = rows["expected"].select(*KEY).distinct().agg(F.count(F.lit(1)).alias("n_expected"))
    docs = texts.withColumns({d: F.try_parse_json(d) for d in DOCUMENTS if d != "sums"}).join(F.broadcast(counts)).join(F.broadcast(n))  # single rows
    docs = written(docs.withColumns({d: F.to_json(d) for d in DOCUMENTS if d != "sums"}), "release-documents").withColumns({d: F.try_parse_json(d) for d in DOCUMENTS if d != "sums"})
    unread = [F.when(F.col(d).isNull(), F.lit(f"no JSON: {DOCUMENTS[d]}")) for d in DOCUMENTS if d != "sums"]
    broken = F.array_compact(F.array(*unread, *[F.when(F.expr(c), F.lit(code)) for code, c in RULES]))
    out = docs.select(F.explode(broken).alias("code"), F.lit("").alias("subject"))

    declared = docs.select(F.explode(F.split("sums", "\n")).alias("line")).filter("trim(line) <> ''").select(F.regexp_extract("line", r"^(\w+)\s+\*?(.*)$", 2).alias("name"), F.regexp_extract("line", r"^(\w+)", 1).alias("want"))
    listed = files.filter("name <> 'checksums.sha256'").select("name", "sha256").join(declared, "name", "full")
    inventory_code = F.when(F.col("sha256").isNull(), "listed file is missing").when(F.col("want").isNull(), "file is not in the inventory").when(F.col("want") != F.col("sha256"), "checksum mismatch")
    out = out.unionByName(listed.select(inventory_code.alias("code"), F.col("name").alias("subject")).filter("code IS NOT NULL"))
    artifacts = docs.select(F.explode(F.expr(_at("manifest", "artifacts", "array<variant>"))).alias("a")).select(F.expr("try_variant_get(a, '$.path', 'string')").alias("name"), F.expr("try_variant_get(a, '$.sha256', 'string')").alias("want"))
    due = files.filter(F.col("name").isin("aggregates/summary.json", *TABLES.values()) | F.col("name").rlike("^(raw|scored)/")).select("name", "sha256").join(artifacts, "name", "left")
    out = out.unionByName(_counted(due.filter("NOT (want <=> sha256)"), "artifact hash missing or stale", F.col("name")))
    out = out.unionByName(files.select(F.explode("found").alias("code"), F.col("name").alias("subject")))

    key = F.concat_ws("/", *KEY)
    for name in ("raw", "scored"):
        own, all_keys = rows[name], rows["expected"].select(*KEY).distinct()
        config = docs.select(*[F.expr(_at("config", c)).alias(f"__{c}") for c in ("release_id", "run_id", "schema_version")])
        out = out.unionByName(_counted(own.groupBy(*KEY).count().filter("count > 1"), f"{name} key is repeated", key))
        out = out.unionByName(_counted(all_keys.join(own, KEY, "left_anti"), f"{name} key is missing", key))
        out = out.unionByName(_counted(own.join(all_keys, KEY, "left_anti").select(*KEY).distinct(), f"{name} key is not expected", key))
        other = own.join(F.broadcast(config)).filter("NOT (release_id <=> __release_id AND run_id <=> __run_id)")
        out = out.unionByName(_counted(other, f"{name} row is of another release", key))
        out = out.unionByName(_counted(own.join(F.broadcast(config)).filter("NOT (schema_version <=> __schema_version)"), f"{name} row has another schema version", key))
    both = rows["raw"].select(*KEY, "status", "condition_sha256").join(rows["scored"].select(*KEY, F.col("status").alias("__s"), F.col("condition_sha256").alias("__c")), KEY)
    out = out.unionByName(_counted(both.filter("NOT (status <=> __s)"), "raw and scored status differ", key))
    out = out.unionByName(_counted(both.filter("NOT (condition_sha256 <=> __c)"), "raw and scored condition differ", key))
    lines = spark.read.text(f"{root}/raw").select(F.get_json_object("value", "$.identity").alias("identity"), F.get_json_object("value", "$.condition_sha256").alias("want"), *[F.get_json_object("value", f"$.{c}").alias(c) for c in KEY])
    out = out.unionByName(_counted(lines.filter("identity IS NOT NULL").filter(~condition_digest("identity").eqNullSafe(F.col("want"))), "row identity differs from its condition hash", key))
    return out
