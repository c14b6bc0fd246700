"""Text functions against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from skarn.functions import geometry as G
from skarn.functions import text as T

TEXTS = [None, "", "   ", "The BatchNorm2d of resNet-50 is a state_of_the-art method. See Table 2 and Fig. 3.1 on pages 4, 5 and 6!", "naïve café — CamelCaseWord aB\n1 Introduction\n2.1 Data Sets\nResults", "A" * 5000]


def run(spark, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def tokens(text):
    out = []
    good = lambda w: w not in T.STOP_WORDS and len(w) > 2
    for raw in re.findall(r"[A-Za-z][A-Za-z0-9_-]+", text or ""):
        low = raw.lower()
        out += [low] if good(low) else []
        out += [p.lower() for p in re.split(r"(?<=[a-z0-9])(?=[A-Z])", raw) if p.lower() != low and good(p.lower())]
    return out


def test_tokenize(spark):
    assert run(spark, T.tokenize("text")) == [tokens(t) for t in TEXTS]


def test_references_and_hints(spark):
    assert run(spark, T.figure_refs("text"))[3] == ["figure 3.1", "table 2"]
    assert run(spark, T.page_hints("text"))[3] == ["4", "5", "6"]
    assert run(spark, T.figure_refs("text"))[:3] == [[], [], []]


def test_headings_and_paths(spark):
    got = run(spark, T.headings("text"))[4]
    assert [(h.title, h.level) for h in got] == [("1 Introduction", 1), ("2.1 Data Sets", 2), ("Results", 1)]
    assert run(spark, T.section_path("text", F.lit(2)))[4] == ["Results"]
    assert run(spark, T.section_title("text", F.lit(1)))[0] == "Abstract"


def test_sentences_keep_all_text(spark):
    for t, s in zip(TEXTS, run(spark, T.sentences("text"))):
        assert "".join(s) == re.sub(r"(?<=[.!?])\s+", "", t or "")


@pytest.mark.parametrize("cell,value", [("84.7%", 84.7), ("28.4 ± 0.2", 28.4), ("28.4 +/- 0.2", 28.4), ("1,234.56 [3]", 1234.56), ("88.4*", 88.4), ("3.3e3 (x)", 3300.0), ("n/a", None), (None, None), ("-.5", -0.5)])
def test_numbers(spark, cell, value):
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(T.number_cleaned("c")).first()[0] == value


def test_number_set_leaves_structure_out(spark):
    df = spark.createDataFrame([("Table 3 shows 4.5% and 12 in step 7",)], "c string")
    assert df.select(T.number_set("c")).first()[0] == ["12", "4.5"]  # a word border can't follow a percent sign


def test_transforms_invert(spark):
    m = F.array(*[F.lit(float(x)) for x in (2, 1, 0, 3, 5, 7)])
    p = G.transform(m, F.lit(1.5), F.lit(-2.0))
    row = spark.range(1).select(p.alias("p")).select(G.transform(G.inverse(m), F.col("p.x"), F.col("p.y")).alias("q")).first().q
    assert (round(row.x, 9), round(row.y, 9)) == (1.5, -2.0)
    with pytest.raises(Exception, match="singular"):
        spark.range(1).select(G.inverse(F.array(*[F.lit(0.0)] * 6))).collect()


def test_regions(spark):
    df = spark.createDataFrame([("see [100, 200, 300, 400] and [0.1,0.1,0.2,0.3] not [1,1,1,1]",)], "c string")
    got = df.select(G.proposed_regions(F.col("c"))).first()[0]
    assert [tuple(b) for b in got] == [(0.1, 0.2, 0.3, 0.4), (0.1, 0.1, 0.2, 0.3)]
