"""Claims against evidence: parsing, support scoring, resolution, reports and repair."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import NUMBER, STRUCTURAL_NUMBER, all_matches, is_disclaimer, let, tokenize
from skarn.session import written

# Word lists and patterns that decide labels.
CITATION = r"\[\s*(?:E_?[A-Za-z0-9_]+|\d+)(?:\s*(?:,|;|/|&|and)\s*(?:E_?[A-Za-z0-9_]+|\d+))*\s*\]"
REFERENCE = r"E_[A-Za-z0-9_]+|E\d+|\d+"
NEGATIONS = "not no never neither nor fails fail failed doesnt doesn't isnt isn't wont won't without cannot can't deteriorates degrades".split()
SUPPORT_STOP = (
    "a an the and or but if because as what which this that these those then just so than such both through about for is of while during to from in out on off "
    "again further once here there all any each few more most other some only own same too very can will should now it its we they their are was were been being "
    "have has had having do does did doing would could"
).split()
CLAUSE = r"\s*;\s*|,?\s+(?:and|but|while|whereas|although|however)\s+"
ABSTENTION = "The paper does not provide sufficient evidence to answer this question."
ABBREVIATIONS = ("e.g.", "i.e.", "et al.", "fig.", "eq.", "dr.", "mr.", "mrs.", "vs.")
VERB = r"\b(is|are|was|were|does|do|can|has|have)\b"
SUPPORTED, PARTIAL = 0.50, 0.25


def _without_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)" + CITATION, ""))


def _facts(bare: Column, counted: Column, *more: Column) -> Column:
    """What support needs of a text without citations: its tokens, words, stems and the numbers of `counted`."""
    words = F.array_distinct(all_matches(F.lower(bare), r"(?U)\b[a-z']+\b"))
    neg, stop = (F.array(*[F.lit(w) for w in ws]) for ws in (NEGATIONS, SUPPORT_STOP))
    stems = lambda x: F.array_distinct(F.transform(F.filter(x, lambda w: F.length(w) >= 4), lambda w: F.substring(w, 1, 4)))

    def of(w, content, kept):
        tokens, numbers = F.array_distinct(tokenize(bare)), F.array_distinct(all_matches(counted, NUMBER))
        return F.struct(tokens.alias("tokens"), content.alias("content"), F.arrays_overlap(w, neg).alias("negated"), kept.alias("kept"), stems(kept).alias("stems"), numbers.alias("numbers"), *more)

    return let(words, lambda w: let(F.array_except(w, neg), lambda content: let(F.array_except(content, stop), lambda kept: of(w, content, kept))))


def claim_facts(claim: Column) -> Column:
    return let(_without_citations(claim), lambda c: _facts(c, F.regexp_replace(c, STRUCTURAL_NUMBER, "")))


def evidence_facts(evidence: Column) -> Column:
    blank = (F.trim(F.coalesce(evidence, F.lit(""))) == "").alias("blank")
    return let(_without_citations(evidence), lambda e: _facts(e, e, blank))


def judged(c: Column, e: Column) -> Column:
    """struct<label, confidence> of claim_facts() against evidence_facts(); rules in order."""
    share = lambda name: F.size(F.array_intersect(c[name], e[name])) / F.greatest(F.size(c[name]), F.lit(1))
    label = lambda name, value: F.struct(F.lit(name).alias("label"), value.alias("confidence"))
    polar = c["negated"] != e["negated"]
    strange = F.size(F.array_except(c["numbers"], e["numbers"])) > 0
    stem = F.when(F.size(c["stems"]) > 0, share("stems")).otherwise(0.0)

    def by_overlap(overlap):
        best = F.greatest(overlap, F.when(F.size(c["kept"]) > 0, share("kept")).otherwise(overlap), stem)
        by_best = lambda x: F.when(x >= SUPPORTED, label("SUPPORTED", x)).when(x >= PARTIAL, label("PARTIAL", x)).otherwise(label("UNSUPPORTED", x))
        return F.when(strange & (overlap >= 0.35), label("CONTRADICTED", F.lit(0.95))).otherwise(let(best, by_best))

    return (
        F.when(e["blank"], label("UNSUPPORTED", F.lit(0.0)))
        .when(F.size(c["tokens"]) == 0, label("SUPPORTED", F.lit(1.0)))
        .when(polar & (F.when(F.size(c["content"]) > 0, share("content")).otherwise(0.0) >= 0.45), label("CONTRADICTED", F.lit(0.95)))
        .otherwise(let(share("tokens"), by_overlap))
    )


def support(claim: Column, evidence: Column) -> Column:
    """struct<label, confidence> of a claim against its joined evidence text; each text is read once."""
    return let(claim_facts(claim), lambda c: let(evidence_facts(evidence), lambda e: judged(c, e)))


def sentence_ranges(line: str) -> list[tuple[int, int]]:
    """C11: half-open ranges of sentences; decimals and abbreviations do not end one."""
    out, start, low = [], 0, line.lower()
    for m in re.finditer(r"[.!?](?=\s|$)", line):
        end = m.end()
        if m[0] == "." and low[max(0, end - 9) : end].endswith(ABBREVIATIONS):
            continue
        out.append((start, end))
        start = end
    return out + [(start, len(line))] if start < len(line) else out


def claims_of(answer: str | None) -> list[dict]:
    """Claims with code-point offsets; fences, headings, table rows and bare bold lines are no claims."""
    cite, ref, found, fence, at = re.compile(CITATION, re.I), re.compile(REFERENCE, re.I), [], False, 0
    for line in (answer or "").split("\n"):
        base, at, bare = at, at + len(line) + 1, line.strip()
        if bare.startswith("```"):
            fence = not fence
            continue
        if fence or not bare or re.match(r"\s{0,3}#{1,6}\s", line) or (bare[0] == bare[-1] == "|"):
            continue
        if bare.startswith("**") and bare.endswith("**") and bare[-1] not in ".!?":
            continue
        for a, b in sentence_ranges(line):
            text = line[a:b].strip()
            if text in ("", "-", "*"):
                continue
            start = base + a + line[a:b].index(text)
            plain = re.sub(r"^\s*(?:[-*+]\s+|\d+[.)]\s+)", "", cite.sub("", text)).strip()
            refs = [r.upper() for m in cite.finditer(text) for r in ref.findall(m[0])]
            marks = [{"start": start + m.start(), "end": start + m.end()} for m in cite.finditer(text)]
            found.append({"claim_id": f"C{len(found) + 1}", "text": text, "start": start, "end": start + len(text), "normalized": plain, "references": refs, "markers": marks})
    return found


CLAIM = "claim_id string, text string, start int, `end` int, normalized string, references array<string>, markers array<struct<start:int,`end`:int>>"
_RANGE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_CLAIM_TYPES = {"claim_id": pa.string(), "text": pa.string(), "start": pa.int32(), "end": pa.int32(), "normalized": pa.string(), "references": pa.list_(pa.string()), "markers": pa.list_(_RANGE)}

#: Answers whose claims a Python worker holds at once.
ANSWERS = 256


def parse_claims(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row a claim of each answer: (*keys, claim_id, text, start, end, normalized, references, markers, claim_type).

    The parser is a character automaton, so it runs as one Arrow-batched function over the answers; a worker holds the
    claims of ANSWERS answers, however many rows a batch has.
    """
    slice_of = ANSWERS

    def parse(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, slice_of):
                part = batch.slice(first, slice_of)
                each = [claims_of(a) for a in part.column(part.num_columns - 1).to_pylist()]
                at = pa.array([i for i, found in enumerate(each) for _ in found], pa.int64())
                flat = [c for found in each for c in found]
                columns = [pa.array([c[name] for c in flat], kind) for name, kind in _CLAIM_TYPES.items()]
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in part.columns[:-1]], *columns], [*part.schema.names[:-1], *_CLAIM_TYPES])

    taken = rows.select(*keys, F.col(text).alias("__answer"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in taken.schema.fields[:-1])
    return taken.mapInArrow(parse, kinds + CLAIM).withColumn("claim_type", F.when(is_disclaimer("normalized"), "disclaimer").otherwise("factual"))


#: Where evidence comes from. Only the first two can support a claim by their text.
TEXT, TABLE, PIXELS, OBSERVED, IMPUTED = "SOURCE_TEXT", "SOURCE_TABLE", "SOURCE_PIXELS", "MODEL_VISUAL_OBSERVATION", "APPLICATION_IMPUTED"
ORIGINS = [TEXT, TABLE, PIXELS, OBSERVED, IMPUTED]


def evidence_origin(rows: DataFrame) -> Column:
    """The origin of evidence rows: as stated in `origin` when that is one of ORIGINS, else by what is known of the row."""
    column = lambda c, kind="boolean": F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    kind = F.lower(F.coalesce(F.nullif(column("chunk_type", "string"), F.lit("")), column("figure_type", "string"), F.lit("")))
    yes = lambda c: F.coalesce(column(c), F.lit(False))
    stated = column("origin", "string")
    return (
        F.when(stated.isin(*ORIGINS), stated)
        .when((kind == "table") | yes("is_table"), TABLE)
        .when(yes("observed_by_model") | yes("is_page") | column("vision_input_kind", "string").isNotNull(), PIXELS)
        .when(yes("imputed"), IMPUTED)
        .otherwise(TEXT)
    )


def prepared(evidence: DataFrame, scope: str) -> DataFrame:
    """evidence (scope, ref, ord, text[, evidence_id, source_evidence_id, chunk_id, and fields of evidence_origin()]) as
    (scope, ord, ref, ref_id, text, origin, names), in ord, each (id, text) of a scope once.

    ref becomes the row's id: evidence_id, source_evidence_id, chunk_id or ref itself. ref_id is the number of ref ("E_3",
    "E3" and "3" are 3) unless an earlier row has it; such rows, and those without a number, get one more than the largest
    before them. text is empty where the origin can't support a claim. names: what a marker may call the row, upper case.
    Evidence that is prepared already is returned as it is.
    """
    if {"ref_id", "names"} <= set(evidence.columns):
        return evidence
    named = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in evidence.columns else F.lit(None).cast("string")
    number = F.regexp_extract(F.coalesce("ref", F.lit("")), r"^(?i:E_?)?(\d{1,9})$", 1)
    ids = [named(c) for c in ("evidence_id", "source_evidence_id", "chunk_id")]
    rows = evidence.select(
        scope,
        F.col("ord").cast("long").alias("ord"),
        F.coalesce(*ids, named("ref"), F.concat(F.lit("E_"), F.col("ord").cast("string"))).alias("ref"),
        F.when(number != "", number.cast("int")).alias("want"),
        evidence_origin(evidence).alias("origin"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.array_compact(F.array(*[F.upper(x) for x in [*ids, named("ref")]])).alias("names"),
    )
    rows = rows.withColumn("text", F.when(F.col("origin").isin(TEXT, TABLE), F.col("text")).otherwise(""))
    once = rows.groupBy(scope, "ref", "text").agg(F.min(F.struct("ord", "want", "origin", "names")).alias("x")).select(scope, F.struct("x.ord", "ref", "x.want", "text", "x.origin", "x.names").alias("r"))
    listed = once.groupBy(scope).agg(F.sort_array(F.collect_list("r")).alias("rows"))  # the evidence of one scope
    start = F.struct(F.lit(0).alias("top"), F.array().cast("array<int>").alias("ids"))

    def number_of(acc, r):
        own = F.when(r["want"].isNotNull() & ~F.array_contains(acc["ids"], r["want"]), r["want"]).otherwise(acc["top"] + 1)
        return F.struct(F.greatest(acc["top"], own).alias("top"), F.array_append(acc["ids"], own).alias("ids"))

    numbers = F.aggregate("rows", start, number_of, lambda acc: acc["ids"])
    each = listed.withColumn("ids", numbers).select(scope, F.explode(F.arrays_zip("rows", "ids")).alias("z"))
    out = each.select(scope, "z.rows.*", F.col("z.ids").alias("ref_id"))
    names = F.filter(F.array_append("names", F.concat(F.lit("E"), F.col("ref_id").cast("string"))), lambda n: ~n.rlike(r"^\d+$"))
    return out.select(scope, "ord", "ref", "ref_id", "text", "origin", F.array_append(F.array_distinct(names), F.col("ref_id").cast("string")).alias("names"))


def resolve(claims: DataFrame, evidence: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """evidence that a claim's markers name: (*keys, claim_id, refs, evidence, origins, numbers), in order of the markers.

    scope is the one of keys that says whose evidence an answer may cite. Of rows with one name the last by ord is meant.
    evidence is the text of those rows that have any; origins and numbers are those of all.
    """
    rows = prepared(evidence, scope).select(scope, "ord", "ref", "ref_id", "text", "origin", F.explode("names").alias("alias"))
    last = rows.groupBy(scope, "alias").agg(F.max(F.struct("ord", "ref", "ref_id", "text", "origin")).alias("x")).select(scope, "alias", "x.*")
    cited = claims.select(*keys, "claim_id", F.posexplode("references").alias("p", "alias")).groupBy(*keys, "claim_id", "alias").agg(F.min("p").alias("p"))
    hit = cited.join(last, [scope, "alias"]).groupBy(*keys, "claim_id", "ord", "ref", "ref_id", "text", "origin").agg(F.min("p").alias("p"))
    ordered = hit.groupBy(*keys, "claim_id").agg(F.sort_array(F.collect_list(F.struct("p", "ref", "text", "origin", "ref_id"))).alias("e"))  # one claim's own citations
    of = lambda name: F.transform("e", lambda x: x[name])
    said = F.array_join(F.filter(of("text"), lambda t: t != ""), " ")
    return ordered.select(*keys, "claim_id", of("ref").alias("refs"), said.alias("evidence"), of("origin").alias("origins"), of("ref_id").alias("numbers"))


def labelled(claims: DataFrame, evidence: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """claims with refs, evidence, origins, numbers, label and confidence; what is no factual claim needs no evidence.

    A factual claim whose evidence is pixels, without any text or table, is UNVERIFIED_VISUAL with confidence 0: only a
    reader of the pixels can judge it, and what a model has seen in them is no support.
    """
    found = claims.join(resolve(claims, evidence, keys, scope), [*keys, "claim_id"], "left")
    none = {"evidence": F.lit(""), "refs": F.array().cast("array<string>"), "origins": F.array().cast("array<string>"), "numbers": F.array().cast("array<int>")}
    found = found.withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    free = F.struct(F.lit("SUPPORTED").alias("label"), F.lit(1.0).alias("confidence"))
    unseen = F.struct(F.lit("UNVERIFIED_VISUAL").alias("label"), F.lit(0.0).alias("confidence"))
    pixels_only = F.array_contains("origins", PIXELS) & ~F.arrays_overlap("origins", F.array(F.lit(TEXT), F.lit(TABLE)))
    status = F.when(F.col("claim_type") != "factual", free).when(pixels_only, unseen).otherwise(support(F.col("text"), F.col("evidence")))
    return found.withColumn("s", status).select("*", "s.*").drop("s")


def verification_report(answers: DataFrame, claims: DataFrame, keys: list[str], gold: DataFrame | None = None) -> DataFrame:
    """F5/F10 of every answer, those without claims too, from labelled() claims.

    The counts of labels and abstains (factual claims, none SUPPORTED nor UNVERIFIED_VISUAL) go by factual claims;
    precision, recall, F1 and the rates by all. The unsupported rate is of PARTIAL, UNSUPPORTED and CONTRADICTED claims,
    visual claims that nobody has judged have their own. Recall is the share of gold (*keys, ref) that is cited; without
    gold 1 when anything is supported, else 0. Without claims they are 1, 1, 1, 0 and 0.
    """
    fact = F.col("claim_type") == "factual"
    of = lambda name: F.count_if(fact & (F.col("label") == name))
    n = claims.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(fact).alias("factual_claims"),
        *[of(x).alias(f"{x.lower()}_count") for x in ("SUPPORTED", "PARTIAL", "UNSUPPORTED", "CONTRADICTED", "UNVERIFIED_VISUAL")],
        F.count_if(F.col("label") == "SUPPORTED").alias("supported_claims"),
        F.count_if(F.col("label") == "UNVERIFIED_VISUAL").alias("visual_claims"),
    )
    counts = [c for c in n.columns if c not in keys]
    r = answers.select(*keys).join(n, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    recall = F.when(F.col("supported_claims") > 0, 1.0).otherwise(0.0)
    if gold is not None:
        cited = claims.select(*keys, F.explode("refs").alias("ref")).distinct().withColumn("hit", F.lit(1))
        met = gold.select(*keys, "ref").distinct().join(cited, [*keys, "ref"], "left").groupBy(*keys).agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
        r = r.join(met, keys, "left")
        recall = F.coalesce("share", recall)
    none = F.col("total_claims") == 0
    share = lambda c: F.coalesce(F.try_divide(c, F.col("total_claims")), F.lit(0.0))
    r = r.withColumns({"citation_precision": F.when(none, 1.0).otherwise(share(F.col("supported_claims"))), "citation_recall": F.when(none, 1.0).otherwise(recall)})
    both = F.col("citation_precision") + F.col("citation_recall")
    return r.select(
        *keys,
        *[c for c in counts if c != "visual_claims"],
        "citation_precision",
        "citation_recall",
        F.when(both > 0, 2 * F.col("citation_precision") * F.col("citation_recall") / both).otherwise(0.0).alias("citation_f1"),
        share(F.col("total_claims") - F.col("supported_claims") - F.col("visual_claims")).alias("unsupported_claim_rate"),
        share(F.col("visual_claims")).alias("unverified_visual_claim_rate"),
        (F.col("partial_count") + F.col("unsupported_count") + F.col("contradicted_count") + F.col("unverified_visual_count") == 0).alias("overall_supported"),
        ((F.col("factual_claims") > 0) & (F.col("supported_count") + F.col("unverified_visual_count") == 0)).alias("abstains"),
    )


def with_marker(text: Column, number: Column) -> Column:
    """text with one marker [number]: in place of its first citation, the others go; without one before its final mark."""
    marker = F.concat(F.lit("["), number.cast("string"), F.lit("]"))
    parts = F.split(text, "(?i)" + CITATION)
    ends = text.rlike("[.!?]$")
    body = F.rtrim(F.when(ends, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text))
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "")
    return F.when(F.size(parts) > 1, F.concat(parts[0], marker, rest)).otherwise(F.concat(body, F.lit(" "), marker, F.when(ends, F.right(text, F.lit(1))).otherwise("")))


#: Claims of one conversation that meet its evidence in a task.
CLAIMS = 512


def remap(claims: DataFrame, evidence: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """for UNSUPPORTED claims the evidence they don't cite that supports them best, if any does at least in part, the
    first of equals: (*keys, claim_id, new_ref, new_number, label, confidence, remapped)."""
    due = claims.filter("label = 'UNSUPPORTED' AND claim_type = 'factual'").select(*keys, "claim_id", F.col("text").alias("claim"), "numbers")
    due = written(due, "unsupported-claims")
    slots = due.groupBy(scope).agg(F.ceil(F.count(F.lit(1)) / CLAIMS).cast("int").alias("__slots"))  # a long conversation's claims meet its evidence in many tasks
    asked = due.join(slots, scope).withColumn("__slot", F.pmod(F.xxhash64(*[k for k in keys if k != scope], "claim_id"), F.col("__slots")).cast("int")).withColumn("__c", claim_facts(F.col("claim"))).drop("__slots")
    pool = prepared(evidence, scope).filter("text <> ''").select(scope, "ord", "ref", "ref_id", evidence_facts(F.col("text")).alias("__e"))
    pool = pool.join(slots, scope).withColumn("__slot", F.explode(F.sequence(F.lit(0), F.col("__slots") - 1))).drop("__slots")
    pairs = asked.join(pool, [scope, "__slot"]).filter(~F.array_contains("numbers", F.col("ref_id"))).withColumn("s", judged(F.col("__c"), F.col("__e")))
    best = F.max_by(F.struct("ref", "ref_id", "s", "claim"), F.struct(F.col("s.confidence"), -F.col("ord"), -F.col("ref_id"))).alias("x")
    one = pairs.filter("s.label IN ('SUPPORTED', 'PARTIAL')").groupBy(*keys, "claim_id").agg(best)
    return one.select(*keys, "claim_id", F.col("x.ref").alias("new_ref"), F.col("x.ref_id").alias("new_number"), "x.s.label", "x.s.confidence", with_marker(F.col("x.claim"), F.col("x.ref_id")).alias("remapped"))


def narrow(claims: DataFrame, keys: list[str]) -> DataFrame:
    """the longest clause of a PARTIAL claim, with its markers and final mark, that its evidence supports at least in
    part: (*keys, claim_id, piece). Clauses end at ; and but while whereas although however; the whole claim is none."""
    due = claims.filter("label = 'PARTIAL' AND claim_type = 'factual' AND size(refs) > 0")
    bare = F.regexp_replace("text", "(?i)" + CITATION, "")
    marks = F.array_join(F.regexp_extract_all("text", F.lit("(?i)(" + CITATION + ")"), F.lit(1)), "")
    rows = due.select(*keys, "claim_id", "evidence", bare.alias("bare"), marks.alias("marks"))
    rows = rows.withColumn("final", F.regexp_extract("bare", "[.!?]$", 0)).withColumn("body", F.substring("bare", F.lit(1), F.length("bare") - F.length("final")))
    pieces = F.transform(F.split("body", CLAUSE), lambda x: F.regexp_replace(x, "[ ,;]+$", ""))
    pieces = F.filter(pieces, lambda x: (F.trim(x) != "") & (F.trim(x) != F.trim("body")))
    marked = lambda x: F.when(F.col("marks") == "", x).otherwise(F.concat(F.rtrim(x), F.lit(" "), F.col("marks")))
    each = rows.select(*keys, "claim_id", "evidence", F.posexplode(F.transform(pieces, lambda x: F.when(F.col("final") == "", marked(x)).otherwise(F.concat(F.rtrim(marked(x)), F.col("final"))))).alias("p", "piece"))
    kept = each.withColumn("s", support(F.col("piece"), F.col("evidence"))).filter("s.label IN ('SUPPORTED', 'PARTIAL')")
    return kept.groupBy(*keys, "claim_id").agg(F.max_by("piece", F.struct(F.length("piece"), -F.col("p"))).alias("piece"))


class Repair:
    """answers (*keys, answer, mode) repaired against evidence (scope, ref, ord, text, ...) and verified again.

    Mode NONE changes nothing. CITATION_REMAP_ONLY gives UNSUPPORTED claims the evidence of remap(). SELECTIVE does so too
    and deletes those without; it deletes CONTRADICTED claims, narrows PARTIAL ones, which stay when they can't be
    narrowed, and takes the markers from what makes no claim. Claims that rest on pixels alone are left as they are. An
    answer that had factual claims and keeps none that is SUPPORTED, PARTIAL or UNVERIFIED_VISUAL becomes ABSTENTION, one
    edit, if abstain is set.

    Modes whose text is the same are parsed and judged once: first and second have a row a claim of each distinct text,
    under the least of its modes, with all of them in `modes`. The second pass is of the modes that may change a text.

    outcomes(), edits() and citations() are tables of its answers, its edit records and its final citations.
    """

    def __init__(self, answers: DataFrame, evidence: DataFrame, keys: list[str], scope: str, abstain: bool = True):
        self.keys, self.scope = [*keys, "mode"], scope
        self.evidence = written(prepared(evidence, scope), "evidence")
        self.first = written(self.judged_once(answers.select(*self.keys, "answer")).drop("normalized"), "first-pass")
        self.edited = written(self._edited(), "edit-records")
        self.rows = written(self._finished(answers, abstain), "repaired")

    def judged_once(self, answers: DataFrame) -> DataFrame:
        """labelled() claims of each distinct text of an answer, with its modes."""
        texts = answers.groupBy(*self.keys[:-1], "answer").agg(F.min("mode").alias("mode"), F.sort_array(F.collect_set("mode")).alias("modes"))
        return labelled(parse_claims(texts, [*self.keys, "modes"], "answer"), self.evidence, self.keys, self.scope)

    def of_all_modes(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("mode", F.explode("modes")).drop("modes")

    def _edited(self) -> DataFrame:
        """A row for each edit of a claim or of a marker, before an answer is given up."""
        names = [*self.keys, "claim_id"]
        due = self.first.withColumn("modes", F.array_remove("modes", "NONE")).filter("size(modes) > 0")
        moved = remap(due, self.evidence, self.keys, self.scope).select(*names, "remapped", "new_ref", "new_number")
        cut = narrow(due.filter(F.array_contains("modes", "SELECTIVE")), self.keys)
        rows = self.of_all_modes(due.drop("evidence").join(moved, names, "left").join(cut, names, "left"))
        fact, all_of_it, label = F.col("claim_type") == "factual", F.col("mode") == "SELECTIVE", F.col("label")
        one = lambda action, start, end, old, new, second, refs: F.struct(action.alias("action"), start.alias("start"), end.alias("end"), old.alias("original_text"), new.alias("replacement_text"), second.alias("second_pass_status"), refs.alias("resolved_refs"))
        none = F.array().cast("array<string>")
        whole = lambda action, new, second, refs: F.array(one(F.lit(action), F.col("start"), F.col("end"), F.col("text"), new, F.lit(second).cast("string"), refs))
        gone = whole("CLAIM_DELETION", F.lit(""), None, none)
        change = (
            F.when((label == "PARTIAL") & all_of_it & F.col("piece").isNotNull(), whole("CLAIM_NARROWING", F.col("piece"), "SUPPORTED", F.col("refs")))
            .when((label == "UNSUPPORTED") & F.col("remapped").isNotNull() & (F.col("remapped") != F.col("text")), whole("CITATION_REMAP", F.col("remapped"), "SUPPORTED", F.array("new_ref")))
            .when(label.isin("UNSUPPORTED", "CONTRADICTED") & all_of_it, gone)
        )
        blank = lambda m: F.substring("text", m["start"] - F.col("start"), F.lit(1)).rlike(r"^\s$") & (m["start"] > F.col("start"))

        def bare(m):
            start = m["start"] - F.when(blank(m), 1).otherwise(0)
            return one(F.lit("CITATION_REMAP"), start, m["end"], F.substring("text", start - F.col("start") + 1, m["end"] - start), F.lit(""), F.lit("SUPPORTED"), none)

        edits = F.when(~fact & all_of_it, F.transform("markers", bare)).when(fact, change)
        each = rows.select(*names, label.alias("initial_status"), F.col("refs").alias("original_refs"), (label == "UNSUPPORTED").alias("remap_attempted"), F.col("new_number"), F.explode(edits).alias("e"))
        return each.select(*names, "e.*", "initial_status", "original_refs", "remap_attempted", F.when(F.col("e.action") == "CITATION_REMAP", F.col("new_number")).alias("new_number"))

    def _finished(self, answers: DataFrame, abstain: bool) -> DataFrame:
        by_answer = self.edited.groupBy(*self.keys).agg(F.collect_list(F.struct("start", "end", F.col("replacement_text").alias("new"))).alias("edits"))  # one answer's claims
        done = answers.select(*self.keys, "answer").join(by_answer, self.keys, "left").withColumn("edits", F.coalesce("edits", F.array().cast("array<struct<start:int,end:int,new:string>>")))
        text = apply_edits(F.col("answer"), F.col("edits"))
        tidy = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*[-*+]\s*$\n?", ""), r"\n{3,}", "\n\n")
        tidy = F.regexp_replace(tidy, r"^\s+|\s+$", "")
        done = done.withColumn("final", F.when(text == F.col("answer"), F.col("answer")).otherwise(tidy))
        done = written(done, "edited-answers")
        again = self.judged_once(done.filter("mode <> 'NONE'").select(*self.keys, F.col("final").alias("answer")))
        self.second = written(again.select(*self.keys, "modes", "claim_id", "claim_type", "label", "confidence", "references"), "second-pass")
        fact = F.col("claim_type") == "factual"
        had = self.of_all_modes(self.first.groupBy(*self.keys, "modes").agg(F.count_if(fact).alias("had"), F.min_by("label", F.col("start")).alias("status")))
        has = self.second.groupBy(*self.keys, "modes").agg(F.count_if(fact & F.col("label").isin("SUPPORTED", "PARTIAL")).alias("has"), F.count_if(fact & (F.col("label") == "UNVERIFIED_VISUAL")).alias("unseen"))
        has = self.of_all_modes(has)
        rows = done.join(had, self.keys, "left").join(has, self.keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("had", "has", "unseen")})
        gives_up = (F.col("mode") != "NONE") & (F.col("had") > 0) & (F.col("has") + F.col("unseen") == 0) & F.lit(abstain)
        return rows.select(*self.keys, "answer", F.when(gives_up, ABSTENTION).otherwise(F.col("final")).alias("final_answer"), F.size("edits").alias("n"), gives_up.alias("abstained"), ((F.col("mode") != "NONE") & (F.col("has") > 0)).alias("reverified"), "status")

    def outcomes(self) -> DataFrame:
        """(*keys, mode, final_answer, n_edits, abstained, reverified)."""
        return self.rows.select(*self.keys, "final_answer", F.when(F.col("abstained"), 1).otherwise(F.col("n")).cast("long").alias("n_edits"), "abstained", "reverified")

    def edits(self) -> DataFrame:
        """(*keys, mode, claim_id, action, start, end, original_text, replacement_text, initial_status, second_pass_status,
        original_refs, resolved_refs, remap_attempted); an answer that is given up has one record, ABSTAIN, over all of it."""
        columns = [*self.keys, "claim_id", "action", "start", "end", "original_text", "replacement_text", "initial_status", "second_pass_status", "original_refs", "resolved_refs", "remap_attempted"]
        up = self.rows.filter("abstained")
        tried = self.edited.groupBy(*self.keys).agg(F.bool_or("remap_attempted").alias("remap_attempted"))
        none = F.array().cast("array<string>")
        given = up.join(tried, self.keys, "left").withColumns({
            "claim_id": F.lit("ABSTAIN"), "action": F.lit("ABSTAIN"), "start": F.lit(0), "end": F.length("answer"), "original_text": F.col("answer"), "replacement_text": F.col("final_answer"),
            "initial_status": F.coalesce("status", F.lit("UNSUPPORTED")), "second_pass_status": F.lit(None).cast("string"), "original_refs": none, "resolved_refs": none, "remap_attempted": F.coalesce("remap_attempted", F.lit(False)),
        })
        return self.edited.join(up.select(*self.keys), self.keys, "left_anti").select(*columns).unionByName(given.select(*columns))

    def citations(self) -> DataFrame:
        """(*keys, mode, ref_id, ref, verification, confidence, repair_origin) of the evidence that a final answer cites
        by number: SUPPORTED when all claims that cite it are, UNVERIFIED_VISUAL when all are that, else UNSUPPORTED; the
        least confidence; REMAPPED where a repair of this answer led to it. Mode NONE has none, its citations stay as given."""
        # ABSTENTION cites nothing; other final answers are those of the second pass
        claims = self.of_all_modes(self.second).join(self.rows.filter("abstained").select(*self.keys), self.keys, "left_anti")
        cited = claims.select(*self.keys, "label", "confidence", F.explode(F.array_distinct("references")).alias("r")).filter(F.col("r").rlike(r"^\d{1,9}$")).withColumn("ref_id", F.col("r").cast("int"))
        known = prepared(self.evidence, self.scope).select(self.scope, "ref_id", "ref")
        all_of = lambda x: F.bool_and(F.col("label") == x)
        found = cited.join(known, [self.scope, "ref_id"]).groupBy(*self.keys, "ref_id", "ref").agg(F.when(all_of("SUPPORTED"), "SUPPORTED").when(all_of("UNVERIFIED_VISUAL"), "UNVERIFIED_VISUAL").otherwise("UNSUPPORTED").alias("verification"), F.min("confidence").alias("confidence"))
        moved = self.edited.filter("new_number IS NOT NULL").select(*self.keys, F.col("new_number").alias("ref_id"), F.lit("REMAPPED").alias("repair_origin")).distinct()
        return found.join(moved, [*self.keys, "ref_id"], "left")


def repair(answers: DataFrame, evidence: DataFrame, keys: list[str], scope: str, abstain: bool = True) -> DataFrame:
    """(*keys, mode, final_answer, n_edits, abstained, reverified) of Repair."""
    return Repair(answers, evidence, keys, scope, abstain).outcomes()


def apply_edits(text: Column, edits: Column) -> Column:
    """F8: edits array<struct<start, end, new>> applied from right to left, so offsets stay those of the original."""
    last_first = F.reverse(F.sort_array(edits))
    return F.aggregate(last_first, text, lambda t, e: F.concat(F.substring(t, 1, e["start"]), e["new"], F.substring(t, e["end"] + 1, F.length(t))))


def corrupted(text: str) -> str:
    """Numbers times three plus seven, else the first verb negated."""
    if re.search(r"\d+(?:\.\d+)?", text):
        return re.sub(r"\d+(?:\.\d+)?", lambda m: f"{float(m[0]) * 3 + 7:g}", text)
    return re.sub(VERB, r"\1 not", text, count=1) if re.search(VERB, text) else "It is not true that " + text


def normalize_citations(text: str | None, known: list[str] | None) -> str:
    """[E1, E4] as [1][2] by first use; unknown ids and page markers go, the first five stay."""
    order: dict[str, int] = {}
    names = {k.upper() for k in known or []}

    def one(m):
        kept = []
        for r in re.findall(REFERENCE, m[0], re.I):
            r = r.upper()
            if r in names and (r in order or len(order) < 5):
                kept.append(order.setdefault(r, len(order) + 1))
        return "".join(f"[{k}]" for k in dict.fromkeys(kept))

    bare = re.sub(r"\[\s*p\.?\s*\d+\s*\]", "", text or "", flags=re.I)
    return re.sub(r"\s+([.,;])", r"\1", re.sub(CITATION, one, bare, flags=re.I)).strip()
