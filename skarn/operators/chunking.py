"""Pages to chunks, figures, references, layout blocks and dialogue context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.text import all_matches, chunk_type, paragraph_preview, section_path, section_title, text_of
from skarn.operators.ranks import ascending, in_order
from skarn.session import written

# Caption, reference and dialogue patterns.
CAPTION = r"(?i)(?:^|\n)\s*((?:figure|fig\.?|table)\s*\d+(?:\.\d+)?[.:]?[^\n]*)"
REFERENT = (
    r"(?i)\b(it|its|they|them|their|this|that|these|those)\b|\bthe\s+(model|method|approach|architecture|authors?)\b"
    r"(?!\s+(of|in|for|from|described|proposed|named))\b"
)
ELLIPTIC = ["what about", "how about", "does that", "is that", "why?", "and with", "what of"]
HEADING = r"^(?:\d+(?:\.\d+)*|[A-Z][a-z]+)\s+[A-Z]"
ABSTRACT = r"(?i)\babstract\b\s*(.+?)(?:\b1\s+introduction\b|\bintroduction\b|\bkeywords\b|$)"
TITLE = r"(?i)^(.+?)(?:\[author|author|april|abstract)"
NO_ABSTRACT = "Custom PDF uploaded for local study."
NUMBERED = r"(?m)^\s*\[?(\d{1,3})\]?[.\s]+([A-Z].{8,})"
AUTHOR_YEAR = r"(?m)([A-Z][a-z]+(?:,\s+[A-Z]\.?)+.*?\(\d{4}\)[.,]\s+)([A-Z][^.]{10,}\.)"
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
NO_ANSWER = ["does not provide", "does not specify", "not specified", "does not mention", "passage does not", "no specific", "not explicitly", "cannot be determined"]
META_QUESTION = r"(?i:\bisbn\b|title of the (?:paper|book))|\bby [A-Z][a-z]+ (?:et al|and )"
MATH = r"(?i)=|\\frac|\\sqrt|\\sum|softmax|gradient|\bloss\b|objective|probability|complexity|O\(|\blog\b|\bexp\b|theta|sigma|lambda|\^|_\{|\bformula\b|\bequation\b"
GENERIC = ["what does the figure show", "what does the table show", "what does the figure/table show", "what is shown in the figure", "what is shown in the table"]
QUESTION_LEAD = r"(?i)^(what|how|why|when|where|is|are|does|do|can|could|would)\s+(is|are|does|do)?\s*"


def cut_pages(pages: DataFrame, target: int = 1400, overlap: int = 120) -> DataFrame:
    """pages (page, text, ...) -> word windows, the text of each in place of its page's, with window, its place from 1 in the
    page, and character offsets there. Titles are read once a page and words are joined once a window.

    A window stops the page once it reaches its end, so there is no short trailing window. Empty pages give none.
    """
    step = max(target - overlap, 1)
    words = F.filter(F.split(text_of("text"), r"\s+"), lambda w: w != "")
    title, path = section_title(F.col("text"), F.col("page")), F.array_join(section_path(F.col("text"), F.col("page")), " > ")
    p = pages.withColumns({"__w": words, "section_title": title, "section_prefix": path}).withColumn("__n", F.size("__w"))
    starts = F.filter(F.sequence(F.lit(0), F.col("__n") - 1, F.lit(step)), lambda s: (s == 0) | (s - step + target < F.col("__n")))
    joined = lambda s, n: F.array_join(F.slice("__w", s + 1, F.lit(n)), " ")
    cut = F.transform(starts, lambda s: F.struct(joined(s, target).alias("text"), F.length(joined(s, step)).alias("own")))
    p = p.withColumn("__cut", F.when(F.col("__n") > 0, cut)).drop("__w", "__n", "text")
    each = p.withColumn("__own", F.transform("__cut", lambda x: x["own"])).select("*", F.posexplode("__cut").alias("__i", "__x"))
    before = F.aggregate(F.slice("__own", F.lit(1), F.col("__i")), F.col("__i") - 1, lambda a, x: a + x)  # a blank between the pieces
    each = each.withColumns({"window": F.col("__i") + 1, "text": F.col("__x.text"), "char_start": F.when(F.col("__i") > 0, before).otherwise(0)})
    return each.withColumns({
        "char_end": F.col("char_start") + F.length("text"),
        "chunk_type": chunk_type(F.col("text"), F.col("section_title"), F.col("page")),
        "paragraph_text": paragraph_preview("text"),
        "retrieval_text": F.concat_ws(". ", "section_prefix", "text"),
    }).drop("__cut", "__own", "__i", "__x")


def page_windows(pages: DataFrame, target: int = 1400, overlap: int = 120) -> DataFrame:
    """A10: pages (paper_id, page, text) -> cut_pages() with a running chunk id a paper."""
    order = Window.partitionBy("paper_id").orderBy("page", "window")
    each = cut_pages(pages, target, overlap).withColumn("chunk_no", F.row_number().over(order))
    return each.withColumn("chunk_id", F.format_string("chunk_%03d", "chunk_no")).drop("window")


def figure_chunks(figures: DataFrame) -> DataFrame:
    """Figures (figure_id, label, caption, body_text, figure_type, ...) as chunks."""
    caption, body = F.trim(text_of("caption")), F.trim(text_of("body_text"))
    base = F.when(caption != "", F.concat_ws(": ", "label", caption)).otherwise(F.col("label"))
    kind = F.coalesce("figure_type", F.lit("figure"))
    text = F.trim(F.when(body != "", F.concat_ws("\n", base, body)).otherwise(base))
    title = F.when(kind == "figure", "Figure").otherwise("Table")
    return figures.select(
        "*",
        F.concat(F.lit("fig_"), F.col("figure_id").cast("string")).alias("chunk_id"),
        text.alias("text"),
        F.concat_ws(" > ", title, text).alias("retrieval_text"),
        title.alias("section_title"),
        kind.alias("chunk_type"),
        F.lit(True).alias("is_figure_chunk"),
        (kind == "table").alias("is_table_chunk"),
        F.length(text).alias("char_end"),
    )


def fixed_chunks(pages: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """(paper_id, chunk_no, text, page): character windows over a paper's joined pages; page of the midpoint.

    One row a paper holds its own text only; the page is found by a range lookup in the paper's page ends.
    """
    joined = pages.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("page", text_of("text").alias("t")))).alias("p"))
    full = joined.select("paper_id", "p", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("full"))
    ends = F.aggregate("p", F.array().cast("array<struct<end:int,page:int>>"), lambda acc, x: F.concat(acc, F.array(F.struct((F.coalesce(F.try_element_at(acc, F.lit(-1))["end"] + 1, F.lit(0)) + F.length(x["t"])).alias("end"), x["page"].cast("int").alias("page")))))
    step, n = size - overlap, F.length("full")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < n))
    each = full.withColumn("ends", F.when(F.size("p") > 0, ends)).filter(n > 0).select("paper_id", "full", "ends", F.posexplode(starts).alias("i", "s"))
    middle = F.floor((F.col("s") + F.least(F.col("s") + size, n)) / 2)
    page = F.coalesce(F.get(F.filter("ends", lambda e: middle < e["end"]), F.lit(0))["page"], F.try_element_at("ends", F.lit(-1))["page"])
    return each.select("paper_id", (F.col("i") + 1).alias("chunk_no"), F.substring(F.col("full"), F.col("s") + 1, F.lit(size)).alias("text"), page.alias("page"))


def figure_captions(pages: DataFrame, most: int = 80) -> DataFrame:
    """A4: (paper_id, page, figure_no, kind, number, caption) of caption lines, `most` a paper in page order."""
    each = pages.select("paper_id", "page", F.posexplode(all_matches(text_of("text"), CAPTION, 1)).alias("p", "caption"))
    kind = F.when(F.lower("caption").startswith("table"), "table").otherwise("figure")
    order = Window.partitionBy("paper_id").orderBy("page", "p")
    numbered = each.withColumn("figure_no", F.row_number().over(order)).filter(F.col("figure_no") <= most)
    return numbered.select("paper_id", "page", "figure_no", kind.alias("kind"), F.regexp_extract("caption", r"\d+(?:\.\d+)?", 0).alias("number"), F.trim("caption").alias("caption"))


def merge_figures(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """Chunks (source, chunk_id, image_file, figure_id, caption) enriched from figures by image file, else by figure
    id; figures that meet no chunk are appended. Identity columns are never overwritten."""
    f = figures.select("source", F.col("chunk_id").alias("f_chunk"), F.col("image_file").alias("f_image"), F.col("figure_id").alias("f_id"), F.col("caption").alias("f_caption"))
    by_image = chunks.join(f, (chunks["source"] == f["source"]) & (chunks["image_file"] == f["f_image"]), "left").drop(f["source"])
    g = f.select(F.col("source").alias("g_source"), F.col("f_chunk").alias("g_chunk"), F.col("f_id").alias("g_id"), F.col("f_caption").alias("g_caption"))
    both = by_image.join(g, F.col("f_chunk").isNull() & (F.col("source") == F.col("g_source")) & (F.col("figure_id") == F.col("g_id")), "left")
    met = F.coalesce("f_chunk", "g_chunk")
    caption = F.coalesce(F.nullif(F.coalesce("f_caption", "g_caption"), F.lit("")), F.col("caption"))
    merged = both.withColumn("__met", met).withColumn("caption", caption)
    used = merged.filter("__met IS NOT NULL").select("source", F.col("__met").alias("chunk_id")).distinct()
    rest = figures.join(used, ["source", "chunk_id"], "left_anti")
    columns = ["source", "chunk_id", "image_file", "figure_id", "caption"]
    return merged.select(columns).unionByName(rest.select(columns))


def layout_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (paper_id, block_no, text) of ten characters or more with the running section, a table flag and
    links to the neighbours. A heading is one line below 80 characters that starts with a number or a word and a capital."""
    t = F.trim(text_of("text"))
    heading = t.rlike(HEADING) & ~t.contains("\n") & (F.length(t) < 80)
    some = blocks.filter(F.length(t) >= 10).withColumn("__h", F.when(heading, t))
    w = Window.partitionBy("paper_id").orderBy("block_no")
    is_table = t.contains("|") | t.contains("\t") | F.substring(t, 1, 15).contains("Table ")
    return some.select(
        "paper_id",
        "block_no",
        "text",
        F.coalesce(F.last("__h", ignorenulls=True).over(w), F.lit("Body")).alias("section"),
        is_table.alias("is_table"),
        F.lag("block_no").over(w).alias("previous"),
        F.lead("block_no").over(w).alias("next"),
    )


def inferred_metadata(pages: DataFrame) -> DataFrame:
    """(paper_id, title, abstract) from the first page with its white space folded.

    The title runs to an author mark, "April" or "Abstract" and has 12 to 220 characters, else it is the paper's id. The
    abstract runs to the introduction or the keywords, 1800 characters at most; NO_ABSTRACT without one.
    """
    first = pages.groupBy("paper_id").agg(F.min_by("text", "page").alias("t"))
    folded = first.select("paper_id", F.trim(F.regexp_replace(text_of("t"), r"\s+", " ")).alias("t"))
    title = F.trim(F.regexp_extract("t", TITLE, 1))
    abstract = F.substring(F.trim(F.regexp_extract("t", ABSTRACT, 1)), 1, 1800)
    return folded.select(
        "paper_id",
        F.when(F.length(title).between(12, 220), title).otherwise(F.col("paper_id").cast("string")).alias("title"),
        F.when(abstract == "", NO_ABSTRACT).otherwise(abstract).alias("abstract"),
    )


def bibliography(pages: DataFrame, last: int = 6) -> DataFrame:
    """(paper_id, number, reference) from the text of a paper's last pages, joined by blanks; 120 characters each.

    Numbered entries count by their number, the first of each. With fewer than five of them, author-year entries follow:
    the i-th takes the number i plus the entries so far, unless that is taken.
    """
    ranked = pages.select("paper_id", "page", text_of("text").alias("t")).withColumn("r", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("page").desc())))
    tail = ranked.filter(F.col("r") <= last).groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("page", "t"))).alias("p"))  # `last` pages at most
    rows = tail.select("paper_id", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("t"))
    pairs = lambda pattern, g: F.regexp_extract_all("t", F.lit(pattern), F.lit(g))
    entry = lambda n, x: F.struct(n.cast("int").alias("number"), F.substring(x, 1, 120).alias("reference"))
    known = "array<struct<number:int,reference:string>>"
    has = lambda a, n: F.exists(a, lambda e: e["number"] == n.cast("int"))
    numbered = F.aggregate(
        F.zip_with(pairs(NUMBERED, 1), pairs(NUMBERED, 2), lambda n, x: entry(n, x)), F.array().cast(known), lambda a, e: F.when(has(a, e["number"]), a).otherwise(F.concat(a, F.array(e)))
    )
    named = F.transform(pairs(AUTHOR_YEAR, 2), lambda x, i: entry(i + 1, x))
    found = rows.select("paper_id", numbered.alias("e"), named.alias("more"))
    place = lambda a, e: F.size(a) + e["number"]
    both = F.aggregate("more", F.col("e"), lambda a, e: F.when(has(a, place(a, e)), a).otherwise(F.concat(a, F.array(entry(place(a, e), e["reference"])))))
    return found.select("paper_id", F.explode(F.when(F.size("e") < 5, both).otherwise(F.col("e"))).alias("e")).select("paper_id", "e.number", "e.reference")


def grounded(facts: Column, passage: Column) -> Column:
    """At least half of the facts, rounded up, occur on word boundaries in the passage; false without facts."""
    quote = lambda f: F.concat(F.lit(r"(?i)(?<!\w)\Q"), F.replace(F.trim(f), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    hits = F.size(F.filter(facts, lambda f: (F.trim(f) != "") & F.regexp_like(passage, quote(f))))
    return (F.size(facts) > 0) & (hits >= F.greatest(F.lit(1), F.floor((F.size(facts) + 1) / 2)))


def valid_cases(cases: DataFrame) -> DataFrame:
    """Cases (case_id, kind, question, answer, facts array<string>, passage) that may be asked, one a question.

    A question has 12 characters and ends in "?", an answer 8; answers that decline, questions about the book itself, math
    cases without math and generic figure questions go. The first four facts must be grounded in the passage.
    """

    def plain(c):
        for mark, letters in LIGATURES.items():
            c = F.replace(c, F.lit(mark), F.lit(letters))
        return F.trim(c)

    q, a = plain(text_of("question")), plain(text_of("answer"))
    facts = F.slice(F.filter(F.transform(F.coalesce("facts", F.array().cast("array<string>")), plain), lambda f: f != ""), 1, 4)
    rows = cases.withColumns({"question": q, "answer": a, "facts": facts})
    bare = F.trim(F.rtrim(F.lower("question"), F.lit("?")))
    declines = F.lit(False)
    for words in NO_ANSWER:
        declines = declines | F.lower("answer").contains(words)
    good = (F.length("question") >= 12) & F.col("question").endswith("?") & (F.length("answer") >= 8) & ~declines & ~F.col("question").rlike(META_QUESTION)
    good = good & ((F.col("kind") != "math") | F.concat_ws(" ", "question", "answer").rlike(MATH)) & ((F.col("kind") != "figure") | ~bare.isin(GENERIC))
    kept = rows.filter(good & grounded(F.col("facts"), text_of("passage")))
    return kept.withColumn("__r", F.row_number().over(Window.partitionBy("question").orderBy("case_id"))).filter("__r = 1").drop("__r")


def even_spread(papers: DataFrame, key: str, most: int = 25) -> DataFrame:
    """Every step-th paper in key order, step = max(1, n // most), the first `most`; places come from in_order()."""
    keys = written(papers.select(key).distinct(), "papers")
    step = max(1, keys.count() // most)
    placed = in_order(keys, ascending(key))
    return placed.filter((F.col("__place") % step == 0) & (F.col("__place") < step * most)).select(key)


def resolved_queries(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text): user turns with the context that a referent or ellipsis needs.

    The context is the last user turn of the six before, else the last turn with text, without its question lead, eight
    words at most.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    t = F.trim(text_of("text"))
    said = F.nullif(t, F.lit(""))
    context = F.coalesce(F.last(F.when(F.lower("role") == "user", said), ignorenulls=True).over(w), F.last(said, ignorenulls=True).over(w))
    rows = turns.withColumns({"__t": t, "__c": context}).filter(F.lower("role") == "user")
    has = F.col("__t").rlike(REFERENT)
    low = F.lower("__t")
    elliptic = F.lit(False)
    for lead in ELLIPTIC:
        elliptic = elliptic | low.startswith(lead)
    bare = F.trim(F.regexp_replace(F.regexp_replace("__c", QUESTION_LEAD, ""), r"^[? .!]+|[? .!]+$", ""))
    plain = F.when(bare != "", bare).otherwise(F.trim(F.regexp_replace("__c", r"^[? .!]+|[? .!]+$", "")))
    eight = F.array_join(F.slice(F.filter(F.split(plain, r"\s+"), lambda x: x != ""), 1, 8), " ")
    short = F.when(F.size(F.filter(F.split(plain, r"\s+"), lambda x: x != "")) > 8, eight).otherwise(plain)
    resolved = F.when((elliptic | has) & F.col("__c").isNotNull() & (short != ""), F.concat(F.col("__t"), F.lit(" (context: "), short, F.lit(")"))).otherwise(F.col("__t"))
    return rows.select("conv_id", "turn", resolved.alias("resolved"))
