"""The strict reader of JSON lines: split files, every rejection, odd line ends."""

import pytest

from skarn.sources.tables import read_json_lines

SCHEMA = "k int, s string"


def write(tmp_path, raw, name="x.jsonl"):
    (tmp_path / name).write_bytes(raw)
    return f"file://{tmp_path}/{name}"


def test_a_large_file_is_read_in_several_tasks(spark, tmp_path):
    text = "".join('{"k":%d,"s":"%s"}\n' % (i, "é" * (i % 90)) for i in range(3000))
    path, was = write(tmp_path, text.encode()), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = read_json_lines(spark, path, SCHEMA, ["k"])
        assert rows.rdd.getNumPartitions() > 5
        assert sorted((r.k, len(r.s)) for r in rows.collect()) == [(i, i % 90) for i in range(3000)]
        with pytest.raises(ValueError, match="final line feed"):
            read_json_lines(spark, write(tmp_path, text.encode()[:-1], "cut.jsonl"), SCHEMA, ["k"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize(
    "raw,what",
    [(b'{"k":1}\n{"k":2}', "final line feed"), (b'{"k":1}\n\n{"k":2}\n', "blank"), (b'{"k":1}\n \t\n', "blank"), (b'\n', "blank"), (b'{"k":1,"s":"\xff"}\n', "UTF-8"), (b'{"k":1}\n{"k":1}\n', "repeated")],
)
def test_rejections(spark, tmp_path, raw, what):
    write(tmp_path, b'{"k":7}\n', "fine.jsonl")
    write(tmp_path, raw, "bad.jsonl")
    with pytest.raises(ValueError, match=what):
        read_json_lines(spark, f"file://{tmp_path}", SCHEMA, ["k"])


@pytest.mark.parametrize("raw", [b'{"k":1}\n{"k":\n', b'{"k":1}\nnonsense\n', b'{"k":"one"}\n'])
def test_lines_that_are_no_such_json_fail(spark, tmp_path, raw):
    with pytest.raises(Exception, match="MALFORMED|PARSE|CANNOT_PARSE|FAILFAST"):
        read_json_lines(spark, write(tmp_path, raw), SCHEMA, ["k"]).collect()


def test_empty_files_and_carriage_returns(spark, tmp_path):
    assert read_json_lines(spark, write(tmp_path, b""), SCHEMA, ["k"]).count() == 0
    got = read_json_lines(spark, write(tmp_path, b'{"k":1,"s":"a"}\r\n{"s":"b","k":2}\r\n'), SCHEMA, ["k"]).collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "b")]
