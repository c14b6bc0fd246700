"""Text scalar functions: Column -> Column, inside code generation or array functions, no Python on executors.

Null text counts as empty throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, cue words and patterns that decide results.
STOP_WORDS = "a an and are as at be by for from how in is it main of on or paper propose proposed that the this to what with".split()
SEARCH_STOP = "a all an and about are as at be by for from in is it no of on or paper papers the this to with you".split()
NLI_STOP = (
    "a an and are as at be been by for from had has have he her his how i in is it its me my of on or our s she that the their them they "
    "this to us was we were what which who will with would you your"
).split()
SECTION_TYPES = [
    ("abstract", r"\babstract\b"),
    ("introduction", r"\b(?:\d+\.?\s*)?introduction\b"),
    ("method", r"\b(?:method|methodology|approach|model|architecture|framework)\b"),
    ("experiment", r"\b(?:experiment|experimental setup|evaluation|dataset|benchmark)\b"),
    ("result", r"\b(?:result|results|analysis|findings)\b"),
    ("limitation", r"\b(?:limitation|limitations|discussion|future work|conclusion)\b"),
]
RESULT_WORDS = ["outperform", "achieve", "accuracy", "bleu", "score", "significant"]
SECTION_HINTS = [
    (["abstract", "introduction"], "abstract|summary|motivation|problem|contribution"),
    (["method", "body"], "method|methodology|architecture|algorithm|component|workflow"),
    (["experiment"], "experiment|setup|dataset|benchmark|baseline|metric"),
    (["result", "experiment"], "result|finding|outperform|score|accuracy|bleu|observation|evaluation"),
    (["limitation"], "limitation|weakness|future|assumption|caveat"),
]
COMPARATIVE = (
    r"\b(outperform|outperforms|crossover|tradeoff|trade-off|threshold|input context|context length|context window|scaling|how much better|"
    r"degrade|degradation|longer context|short context|small context|surpass|exceeds|compared to|comparison between|versus baseline)\b"
)
METRIC_CUES = (
    r"\b(bleu|rouge|meteor|cider|ter|wer|cer|perplexity|f1|f1-score|exact match|accuracy|top-1|top-5|auc|roc|map|iou|psnr|ssim|fid|is|"
    r"flops|gflops|tflops|latency|throughput|runtime|inference time|training time|parameters?|param count|params|memory footprint|vram|gpu hours|speedup|"
    r"learning rate|warmup|warmup steps|weight decay|dropout|attention dropout|d_model|d_ff|d_k|d_v|hidden size|embedding dimension|dimension of|"
    r"number of heads|head count|layer count|number of layers|batch size|sequence length|outperform|highest score|lowest loss|best performing|ablation|scaling|breakdown|"
    r"performance on|results on|benchmark results|leaderboard|comparison against|versus|"
    r"wmt|glue|superglue|squad|imagenet|cifar|coco|mmlu|gsm8k|human-eval|ptb|penn treebank)\b"
)
VISUAL_CUES = (
    r"\b(architecture|pipeline|workflow|attention distribution|attention weight|attention map|loss curve|convergence|training curve|learning curve|"
    r"tradeoff|scatter|distribution|encoder-decoder structure|module breakdown|overview of the model)\b"
)
VISUAL_TERMS = "figure|fig|table|plot|chart|graph|diagram|shown|depicted|illustrat|visuali|image|schematic|architecture diagram|attention map|heatmap"
DISCLAIMERS = [
    r"\b(?:is|are|was|were)\s+not\s+(?:used|mentioned|discussed|defined|found|present|described|provided|specified)\b",
    r"\bthe\s+term\s+[\"']?[^\"']+[\"']?\s+is\s+not\s+(?:used|mentioned|found)\b",
    r"\bdoes\s+not\s+(?:mention|contain|discuss|provide|describe|state|specify)\b",
    r"\bno\s+mention\s+of\b",
    r"\bnot\s+explicitly\s+(?:stated|mentioned|covered|discussed)\b",
    r"\bcannot\s+be\s+determined\s+from\b",
    r"\bit\s+is\s+assumed\s+you\s+are\s+referring\s+to\b",
    r"\bassumed\s+to\s+refer\s+to\b",
    r"\bneither\s+[\w\s]+\s+nor\s+[\w\s]+\s+is\s+mentioned\b",
    r"\bout\s+of\s+scope\b",
    r"\bdoes\s+not\s+provide\s+sufficient\s+evidence\b",
]
BOILERPLATE = ["arxiv:", "preprint", "copyright", "author name redacted", "equal contribution", "all rights reserved", "under review as"]
LIGATURES = [("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("—", "-"), ("–", "-"), ("“", '"'), ("”", '"'), ("’", "'"), ("‘", "'")]
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NUMBERED_HEADING = r"^\s*(\d+(?:\.\d+)*)\.?\s+([A-Z][A-Za-z0-9\s\-–,:(/)]+)\s*$"
NAMED_HEADING = (
    r"(?i)^\s*(Abstract|Introduction|Background|Related Work|Methodology|Methods|Approach|Architecture|Framework|Experiments?|Experimental Setup|Evaluation|"
    r"Results?|Analysis|Discussion|Limitations?|Conclusions?|Future Work|Broader Impacts?|References|Appendix)\s*$"
)
SECTION_WORD = (
    r"(?i)(?:^|\s)(?:\d+(?:\.\d+)?\s+)?(Abstract|Introduction|Background|Related Work|Method|Methodology|Approach|Model|Architecture|Framework|Experiments?|"
    r"Experimental Setup|Evaluation|Results?|Analysis|Discussion|Limitations?|Conclusion|Future Work)\b"
)
STRUCTURAL_NUMBER = r"(?i)\b(?:figure|table|section|page|eq|equation|model|step|ref|row|column)\s+\d+\b"
NUMBER = r"\b\d+(?:\.\d+)?%?\b"
REFUSALS = (
    r"(?i)does not contain|not provided|cannot (be )?determin|is not (explicitly )?(state|mention|includ|list|available|present)|"
    r"no (specific|corresponding|explicit|numerical|such|clear)"
)


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def has_any(text: Column, words: list[str]) -> Column:
    """Whether the text holds any of the words as substrings."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def tokenize(text: Column | str) -> Column:
    """Technical tokens in lower case, stop words and short ones dropped, camelCase parts appended."""
    good = lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 2)
    camel, none = "[a-z0-9][A-Z]", F.array().cast("array<string>")

    def one(raw):
        low = F.lower(raw)
        parts = F.filter(F.transform(F.split(raw, r"(?<=[a-z0-9])(?=[A-Z])"), F.lower), lambda p: (p != low) & good(p))
        return F.concat(F.when(good(low), F.array(low)).otherwise(none), F.when(raw.rlike(camel), parts).otherwise(none))

    words = all_matches(text_of(text), "[A-Za-z][A-Za-z0-9_-]+")
    plain = F.filter(F.transform(words, F.lower), good)  # most texts have no camelCase
    return F.when(text_of(text).rlike(camel), F.flatten(F.transform(words, one))).otherwise(plain)


def tokenize_plain(text: Column | str) -> Column:
    """As tokenize on the lower-cased text, so without camelCase parts."""
    words = all_matches(F.lower(text_of(text)), "[a-z][a-z0-9_-]+")
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 2))


def tokenize_nli(text: Column | str) -> Column:
    """The entailment tokenizer."""
    return F.filter(all_matches(F.lower(text_of(text)), "[a-z][a-z0-9-]*"), lambda w: ~w.isin(*NLI_STOP) & (F.length(w) > 1))


def token_set_slashes(text: Column | str) -> Column:
    """C4: distinct tokens after slashes and hyphens have become blanks."""
    return F.array_distinct(tokenize(F.lower(F.translate(text_of(text), "/-", "  "))))


def search_tokens(text: Column | str) -> Column:
    """Search tokens of two letters or more without stop words; a final s goes from words of more than three."""
    words = F.filter(all_matches(F.lower(text_of(text)), "[a-z0-9]+"), lambda w: ~w.isin(*SEARCH_STOP) & (F.length(w) > 1))
    return F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 3), F.substring(w, 1, F.length(w) - 1)).otherwise(w))


def alphanumeric(text: Column | str) -> Column:
    """C6."""
    return F.trim(F.regexp_replace(F.lower(text_of(text)), "[^a-z0-9]+", " "))


def squad_normalized(text: Column | str) -> Column:
    """Lower case, ASCII punctuation and articles out, white space squeezed."""
    bare = F.translate(F.lower(text_of(text)), ASCII_PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def repaired(text: Column | str) -> Column:
    """C8 without NFKC: ligatures and quotes spelt out, words joined again over a hyphen and white space."""
    out = text_of(text)
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"(\w+)-\s+(\w+)", "$1$2")


def sentences(text: Column | str) -> Column:
    """Pieces between white space that follows . ! or ?"""
    return F.split(text_of(text), r"(?<=[.!?])\s+")


def key_sentences(text: Column | str) -> Column:
    """Sentences of more than 30 characters without boilerplate phrases."""
    parts = F.transform(sentences(F.replace(repaired(text), F.lit("\n"), F.lit(" "))), lambda x: F.trim(x))
    return F.filter(parts, lambda s: (F.length(s) > 30) & ~has_any(F.lower(s), BOILERPLATE))


def _n_words(s: Column) -> Column:
    return F.size(all_matches(s, r"\S+"))


def long_sentences(text: Column | str, least: int = 4) -> Column:
    """Sentences of `least` words; the whole text when there is none."""
    whole = F.trim(text_of(text))
    good = F.filter(F.transform(sentences(whole), lambda x: F.trim(x)), lambda s: _n_words(s) >= least)
    return F.when(F.size(good) > 0, good).otherwise(F.array(whole))


def atoms(text: Column | str) -> Column:
    """Sentences cut at an 'and' that opens a new statement; three words at least, else the whole text."""
    parts = F.flatten(F.transform(long_sentences(text), lambda s: F.split(s, r"\s+and\s+(?=[A-Z]|the\b|it\b|they\b|this\b)")))
    good = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda p: _n_words(p) >= 3)
    return F.when(F.size(good) > 0, good).otherwise(F.array(F.trim(text_of(text))))


def candidate_sentences(text: Column | str) -> Column:
    """Sentences of more than 55 characters, cut to 500."""
    return F.transform(F.filter(F.transform(sentences(text), lambda x: F.trim(x)), lambda s: F.length(s) > 55), lambda s: F.substring(s, 1, 500))


def short_quote(text: Column, query_tokens: Column, most: int = 220) -> Column:
    """The first sentence that shares a token with the query, else the text's start."""
    hit = F.filter(sentences(text), lambda s: F.arrays_overlap(tokenize(s), query_tokens))
    return F.trim(F.substring(F.coalesce(F.get(hit, F.lit(0)), text_of(text)), 1, most))


def paragraph_preview(text: Column | str, most: int = 900) -> Column:
    """The first five sentences of the squeezed text."""
    clean = F.trim(F.regexp_replace(text_of(text), r"\s+", " "))
    return F.substring(F.trim(F.array_join(F.slice(sentences(clean), 1, 5), " ")), 1, most)


def figure_refs(text: Column | str) -> Column:
    """C17: distinct 'figure n' and 'table n' references, sorted."""
    found = all_matches(text_of(text), r"(?i)\b(?:figure|fig\.?|table)\s*\.?\s*\d+(?:\.\d+)?\b")
    number = lambda s: F.regexp_extract(s, r"\d+(?:\.\d+)?$", 0)
    named = F.transform(found, lambda s: F.concat(F.when(F.lower(s).startswith("table"), "table ").otherwise("figure "), number(s)))
    return F.array_sort(F.array_distinct(named))


def page_hints(text: Column | str) -> Column:
    """Page numbers named after 'page' or 'pages', distinct, in order, six at most."""
    runs = all_matches(F.lower(text_of(text)), r"\bpages?\s+([0-9,\sand]+)", 1)
    return F.slice(F.array_distinct(F.flatten(F.transform(runs, lambda r: all_matches(r, r"\d+")))), 1, 6)


def section_hints(text: Column | str) -> Column:
    """Sections that the words of a question point to, sorted."""
    low = F.lower(text_of(text))
    none = F.array().cast("array<string>")
    parts = [F.when(low.rlike(words) | (low.rlike(COMPARATIVE) if "result" in names else F.lit(False)), _array(names)).otherwise(none) for names, words in SECTION_HINTS]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def visual_intent(text: Column | str) -> Column:
    """C20."""
    low = F.lower(text_of(text))
    return low.rlike(VISUAL_TERMS) | low.rlike(VISUAL_CUES)


def tabular_intent(text: Column | str) -> Column:
    low = F.lower(text_of(text))
    return low.rlike(METRIC_CUES) | low.contains("table") | low.contains("tabular")


def headings(text: Column | str) -> Column:
    """array<struct<title, level>> of numbered and named headings, in order."""

    def one(line):
        number, title = F.regexp_extract(line, NUMBERED_HEADING, 1), F.trim(F.regexp_extract(line, NUMBERED_HEADING, 2))
        level = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1
        name = F.initcap(F.regexp_extract(line, NAMED_HEADING, 1))
        return (
            F.when((F.length(line) == 0) | (F.length(line) > 80), F.lit(None))
            .when(number != "", F.struct(F.concat_ws(" ", number, F.initcap(title)).alias("title"), level.alias("level")))
            .when(name != "", F.struct(name.alias("title"), F.lit(1).alias("level")))
        )

    return F.filter(F.transform(F.split(text_of(text), "\r?\n|\r"), lambda x: one(F.trim(x))), lambda h: h.isNotNull())


def section_title(text: Column | str, page: Column) -> Column:
    """The last heading of a page, else the last section word, else Abstract or Body."""
    t = text_of(text)
    found, word = headings(t), all_matches(t, SECTION_WORD, 1)
    start = F.when(page == 1, "Abstract").otherwise("Body")
    last = F.when(F.size(found) > 0, F.element_at(found, -1)["title"]).when(F.size(word) > 0, F.initcap(F.element_at(word, -1))).otherwise(start)
    return F.when((page == 1) & F.lower(t).contains("abstract"), "Abstract").otherwise(last)


def section_path(text: Column | str, page: Column) -> Column:
    """[section] or [section, subsection] after the page's last headings."""
    t = text_of(text)
    zero = F.struct(F.lit(None).cast("string").alias("main"), F.lit(None).cast("string").alias("sub"))

    def step(acc, h):
        top = F.when(h["title"].contains("."), F.concat(F.lit("Section "), F.split(h["title"], r"\.")[0])).otherwise("Section")
        return F.when(h["level"] == 1, F.struct(h["title"].alias("main"), F.lit(None).cast("string").alias("sub"))).otherwise(
            F.struct(F.coalesce(acc["main"], top).alias("main"), h["title"].alias("sub"))
        )

    path = F.aggregate(headings(t), zero, step, lambda a: F.array_compact(F.array(a["main"], F.when(a["sub"] != a["main"], a["sub"]))))
    plain = F.array(section_title(t, page))
    return F.when((page == 1) & F.lower(t).contains("abstract"), F.array(F.lit("Abstract"))).when(F.size(path) > 0, path).otherwise(plain)


def chunk_type(text: Column | str, title: Column, page: Column) -> Column:
    """The first section pattern that fits the title and 900 characters."""
    both = F.lower(F.concat_ws(" ", title, F.substring(text_of(text), 1, 900)))
    out = F.when((page == 1) & both.contains("abstract"), "abstract")
    for name, pattern in SECTION_TYPES:
        out = out.when(both.rlike(pattern), name)
    return out.when(has_any(both, RESULT_WORDS), "result").otherwise("body")


def label_normalized(text: Column | str) -> Column:
    """C25."""
    return F.regexp_replace(F.trim(F.lower(text_of(text))), r"\s+", " ")


def paper_id_sanitized(text: Column | str) -> Column:
    """Safe identifier characters; dots, underscores and hyphens go from the ends; "paper" when nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(text_of(text), "[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(clean == "", "paper").otherwise(clean)


def is_refusal(text: Column | str) -> Column:
    """A sentence that makes no claim about the sources."""
    return text_of(text).rlike(REFUSALS)


def substantive_sentences(text: Column | str) -> Column:
    """Sentences of more than 40 characters that are no refusals."""
    parts = F.transform(sentences(F.replace(text_of(text), F.lit("\n"), F.lit(" "))), lambda x: F.trim(x))
    return F.filter(parts, lambda s: (F.length(s) > 40) & ~s.rlike(REFUSALS))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, also where body uses it often."""
    return F.transform(F.array(value), body)[0]


def number_text(text: Column | str) -> Column:
    """The first number of a table cell as it is written there, without notes, errors, commas and marks; "" without one."""
    t = F.regexp_replace(text_of(text), r"[\$\\^\*†‡§]", "")
    t = F.regexp_replace(t, r"\[.*?\]|\(.*?\)", "")
    t = F.split(F.split(t, "±")[0], r"\+/-")[0]
    t = F.translate(t, ",%", "")
    return F.regexp_extract(t, r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", 0)


def number_cleaned(text: Column | str) -> Column:
    """The first number of a table cell as DOUBLE; null without one."""
    return number_text(text).try_cast("double")


def four_digits(value: Column) -> Column:
    """A double with four significant digits, ties to even, without trailing zeros: fixed from 0.0001 below 10000, else with
    an exponent."""
    def rounded(x):
        place = F.split(F.format_string("%.3e", x), "e")[1].cast("int")

        def at(e):
            near = x
            for k in range(-4, 20):
                near = F.when(e == k, F.coalesce(F.bround(x.try_cast("decimal(38,12)"), 3 - k).cast("double"), x)).otherwise(near)
            return F.split(F.format_string("%.3e", near), "e")

        return let(place, at)

    def written(parts):
        digits, exponent = parts[0], parts[1].cast("int")
        bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        fixed = F.lit(None).cast("string")
        for e in range(-4, 4):
            fixed = F.when(exponent == e, (digits.cast("decimal(5,3)") * F.lit(f"1e{e}").cast("decimal(10,4)")).cast(f"decimal(20,{max(0, 3 - e)})").cast("string")).otherwise(fixed)
        return let(fixed, lambda x: F.when(x.isNull(), F.concat(bare(digits), F.lit("e"), parts[1])).when(x.contains("."), bare(x)).otherwise(x))

    return F.when(value == 0, "0").otherwise(let(let(value, rounded), written))


def number_set(text: Column | str) -> Column:
    """Distinct numbers, sorted, without those that number a figure, table, page and the like."""
    bare = F.regexp_replace(text_of(text), STRUCTURAL_NUMBER, "")
    return F.array_sort(F.array_distinct(all_matches(bare, NUMBER)))


def is_disclaimer(text: Column | str) -> Column:
    """C33."""
    return F.lower(text_of(text)).rlike("|".join(f"(?:{p})" for p in DISCLAIMERS))


def answer_words(text: Column | str) -> Column:
    """Words, Unicode letters and digits."""
    return F.size(all_matches(text_of(text), r"(?U)\w+"))
