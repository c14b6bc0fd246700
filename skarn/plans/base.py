"""Inputs that several registered queries share, in Spark and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.text import STOP_WORDS
from skarn.session import dealt, table

#: Question templates; {n} and {m} become numbers of the part table, so every part asks one question.
TEMPLATES = [
    "Compare Table {n} and Table {m} on accuracy",
    "What does Figure {n} show on pages {n}, {m}?",
    "How does dropout {n} compare to dropout {m} in terms of latency?",
    "What percentage gain of BLEU is reported in the plot on page {n}?",
    "Which optimizer was used with learning rate {n}?",
    "Explain the architecture and the attention map in fig. {n}.{m}",
    "Why does the method outperform the baseline versus input context {n}?",
    "Does the algorithm converge after {n} steps?",
    "What limitation or future work is discussed in section {n}?",
    "Summary of the main contribution across sections {n}",
    "How many epochs, and what dataset size is shown in the diagram?",
    "Difference between encoder {n} and decoder {m}.",
    "Overall findings from start to finish",
    "What is the ratio in row {n} of table {m}?",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_id, question), one question a row of part."""
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    template = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (F.col("p_partkey") % len(TEMPLATES) + 1).cast("int"))
    filled = F.replace(F.replace(template, F.lit("{n}"), F.col("p_size").cast("string")), F.lit("{m}"), (F.col("p_size") + 1).cast("string"))
    return part.select(F.col("p_partkey").alias("q_id"), filled.alias("question"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


QUESTIONS_SQL = (
    f"(SELECT p_partkey AS q_id, replace(replace({sql_list(TEMPLATES)}[p_partkey % {len(TEMPLATES)} + 1], '{{n}}', CAST(p_size AS VARCHAR)), "
    "'{m}', CAST(p_size + 1 AS VARCHAR)) AS question FROM part)"
)


def good_sql(w: str) -> str:
    return f"(NOT list_contains({sql_list(STOP_WORDS)}, {w}) AND length({w}) > 2)"


def tokens_sql(text: str) -> str:
    """The main tokenizer as a DuckDB expression."""
    parts = r"string_split(regexp_replace(raw, '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' ')"
    return (
        f"flatten(list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z][A-Za-z0-9_-]+'), lambda raw: list_concat("
        f"list_filter([lower(raw)], lambda w: {good_sql('w')}), list_filter(list_transform({parts}, lambda p: lower(p)), lambda p: p <> lower(raw) AND {good_sql('p')}))))"
    )


def plain_tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z][a-z0-9_-]+'), lambda w: {good_sql('w')})"


def sentences_sql(text: str) -> str:
    """Pieces between white space that follows . ! or ?, without a lookbehind."""
    return rf"string_split(regexp_replace({text}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
