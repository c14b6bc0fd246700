"""Many phrases in many texts: an anchor of each phrase meets the words of the texts by an equi-join, then the text decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.session import written

#: Words of a long phrase's anchor, and letters of a short one's.
WORDS, LETTERS = 4, 3


def _hashes(words: Column, n: int) -> Column:
    """Hashes of all runs of n words, each once."""
    if n == 1:
        return F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(n)), " ")))
    return F.when(F.size(words) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def _grams(token: Column, n: int) -> Column:
    return F.when(F.length(token) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) - n + 1), lambda i: F.substring(token, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def phrase_hits(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str, each_row: bool = True) -> DataFrame:
    """(key, phrase) for each text that holds the phrase as a substring, once a row of texts, or once a key if
    not each_row. Null, empty and all-blank phrases are left out; null texts hold nothing.

    A phrase's words but its first and last are whole words of any text that holds it. A run of WORDS of them, or else the
    longest, is the phrase's anchor and meets the texts' runs of words by hash. A phrase of one or two words has no whole
    word: its longer one meets the distinct words of all texts that share its first LETTERS letters anywhere and contain it,
    and these lead to the texts. A phrase without a blank is in a text if it is in one of its words, so it is settled there;
    whoever else meets is a candidate, and is settled by the text itself. Nothing passes the driver.
    """
    kind = texts.schema[key].dataType.simpleString()
    pieces = F.split("phrase", r"\s+")
    wanted = phrases.select(F.col(phrase).alias("phrase")).filter(F.trim(F.regexp_replace("phrase", r"\s+", " ")) != "").distinct().withColumn("p", pieces)
    wanted = wanted.withColumn("whole", F.expr("slice(p, 2, greatest(size(p) - 2, 0))"))
    longest = lambda a: F.element_at(F.array_sort(F.transform(a, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    known = written(
        wanted.select(
            "phrase",
            F.when(F.size("whole") >= WORDS, WORDS).when(F.size("whole") > 0, 1).otherwise(0).alias("words"),
            F.when(F.size("whole") >= WORDS, F.xxhash64(F.array_join(F.slice("whole", 1, WORDS), " "))).when(F.size("whole") > 0, F.xxhash64(longest(F.col("whole")))).alias("anchor"),
            F.when(F.size("whole") == 0, longest(F.col("p"))).alias("piece"),
            (F.size("p") == 1).alias("alone"),
        ),
        "phrases",
    )
    shapes = {(r.words, r.n) for r in known.select("words", F.least(F.length("piece"), F.lit(LETTERS)).alias("n")).distinct().collect()}  # a few at most
    rows = texts.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    words = rows.select("__key", F.filter(F.split("__text", r"\s+"), lambda w: w != "").alias("w"))
    empty = texts.sparkSession.createDataFrame([], f"__key {kind}, phrase string")
    found, alone = empty, empty
    for n in sorted({w for w, _ in shapes if w}):
        each = words.select("__key", F.explode(_hashes(F.col("w"), n)).alias("anchor"))
        found = found.unionByName(each.join(known.filter(F.col("words") == n).select("anchor", "phrase"), "anchor").select("__key", "phrase"))
    letters = sorted(n for w, n in shapes if w == 0)
    if letters:
        # a row of texts is told from others of its key by its number, within one pass
        each = words.withColumn("__row", F.monotonically_increasing_id() if each_row else F.lit(0)).select("__row", "__key", F.explode(F.array_distinct("w")).alias("token"))
        vocabulary = written(each.select("token").distinct(), "vocabulary")
        short = known.filter("words = 0").select("phrase", "piece", "alone", F.substring("piece", 1, LETTERS).alias("gram"))
        for n in letters:
            met = vocabulary.select("token", F.explode(_grams(F.col("token"), n)).alias("gram")).join(short.filter(F.length("gram") == n), "gram").filter(F.col("token").contains(F.col("piece")))
            met = written(met.select("token", "phrase", "alone"), "met-tokens")
            found = found.unionByName(each.join(met.filter("NOT alone"), "token").select("__key", "phrase"))
            alone = alone.unionByName(each.join(met.filter("alone"), "token").select("__row", "__key", "phrase").distinct().select("__key", "phrase"))
    candidates = written(found.distinct(), "phrase-candidates").withColumnRenamed("__key", "__k")
    held = rows.join(candidates, F.col("__key").eqNullSafe(F.col("__k"))).filter(F.col("__text").contains(F.col("phrase")))
    held = held.select("__key", "phrase") if each_row else held.select("__key", "phrase").distinct()
    both = held.unionByName(alone) if each_row else held.unionByName(alone).distinct()  # several lengths of letters
    return both.select(F.col("__key").alias(key), F.col("phrase").alias(phrase))


def gold_chunks(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cases (case_id, facts array<string>, locus), chunks (chunk_id, page, text): (case_id, chunk_id, place).

    A chunk is gold when at least half of the case's facts, rounded up, occur in it as substrings, letter case and runs of
    white space aside. Chunks on the page of the locus come first, then by chunk_id. Cases without facts have none.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    each = cases.select("case_id", "locus", F.greatest(F.lit(1), F.floor((F.size("facts") + 1) / 2)).alias("need"), F.explode(F.transform("facts", plain)).alias("fact"))
    hits = phrase_hits(chunks.select("chunk_id", plain(F.col("text")).alias("text")), "chunk_id", "text", each, "fact")
    met = each.join(hits, "fact").groupBy("case_id", "locus", "need", "chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= need")
    paged = met.join(chunks.select("chunk_id", "page"), "chunk_id")
    place = F.array_sort(F.collect_list(F.struct((~F.col("page").eqNullSafe(F.col("locus"))).alias("off"), "chunk_id")))
    ranked = paged.groupBy("case_id").agg(place.alias("g"))  # the gold chunks of one case
    return ranked.select("case_id", F.posexplode("g").alias("place", "x")).select("case_id", F.col("x.chunk_id").alias("chunk_id"), (F.col("place") + 1).cast("long").alias("place"))
