import pytest
from pyspark.sql import functions as F

from keysift.operators.examples import (
    append_examples,
    class_deficit,
    label_examples,
    label_union,
    top_up,
)
from keysift.session import scratch_path
from keysift.sources import files
from tests.samples import FLAGGED, HARMLESS


def write_file(path, content):
    path.write_bytes(content.encode("utf-8"))
    return str(path)


def pairs(df):
    return sorted((r.text, r.is_credential) for r in df.collect())


def test_append_and_load(spark, texts):
    base = scratch_path(spark, "examples")
    append_examples(label_examples(texts(list(FLAGGED)), True, "test"), f"{base}/yes")
    append_examples(label_examples(texts(["ação}{|"]), True, "test"), f"{base}/yes")
    append_examples(label_examples(texts(HARMLESS), False), f"{base}/no")
    loaded = files.load_examples(spark, f"{base}/yes", f"{base}/no")
    expected = [(t, True) for t in [*FLAGGED, "ação}{|"]] + [(t, False) for t in HARMLESS]
    assert pairs(loaded) == sorted(expected)
    assert {r.source for r in loaded.collect()} == {"test", "manual"}


def test_appended_text_is_not_escaped(spark, texts):
    path = scratch_path(spark, "utf8")
    append_examples(label_examples(texts(["ação 😀"]), True), path)
    line = spark.read.text(path).first().value
    assert line == '{"text":"ação 😀","is_credential":true,"source":"manual"}'


def test_missing_file_is_an_empty_class(spark, tmp_path):
    yes = write_file(tmp_path / "yes.jsonl", '{"text": "a", "is_credential": true, "source": "s"}\n')
    loaded = files.load_examples(spark, yes, str(tmp_path / "none.jsonl"))
    assert pairs(loaded) == [("a", True)]
    none = str(tmp_path / "none")
    assert files.read_line_examples(spark, none, True).count() == 0
    assert files.split_rejects(files.read_csv(spark, none))[0].count() == 0
    assert files.read_testset(spark, none) is None and files.read_split(spark, none) is None


def test_label_from_origin(spark, tmp_path):
    no = write_file(tmp_path / "no.jsonl", '{"text": "a", "is_credential": true}\n{"text": "b"}\n')
    none = str(tmp_path / "none")
    assert pairs(files.load_examples(spark, none, no)) == [("a", True), ("b", False)]
    assert pairs(files.load_examples(spark, none, no, "origin")) == [("a", False), ("b", False)]


def test_jsonl_repair(spark, tmp_path):
    content = "\n".join(
        [
            '{"text": "whole}{text|"}',
            "",
            " \t  ",
            '　{"text": "padded"} ',
            '{"text": "one"}{"text": "two|2"}{"text": "three"}',
            '{"text": "good"}{"text": ',
            '{"text": "trailing"} junk',
            '{"text": "first"},{"text": "second"}',
            '{"text": "closes"}],[{"text": "opens"}',
            "{'text': 'quotes'}",
            "[1, 2]",
            "5",
            '{"other": "no text"}',
            '{"text": "crlf"}\r',
            '{"text": "cr"}\r{"text": "after cr"}',
        ]
    )
    parsed = files.parse_jsonl(files.read_lines(spark, write_file(tmp_path / "x.jsonl", content)))
    good = ["whole}{text|", "padded", "one", "two|2", "three", "good", "crlf", "cr", "after cr"]
    assert sorted(r.text for r in files.examples_of(parsed).collect()) == sorted(good)
    rejected = {r.piece for r in files.rejects_of(parsed).collect()}
    assert rejected == {
        '{"text":',
        '{"text": "trailing"} junk',
        '{"text": "first"},{"text": "second"}',
        '{"text": "closes"}],[{"text": "opens"}',
        "{'text': 'quotes'}",
        "[1, 2]",
        "5",
        '{"other": "no text"}',
    }


CSV = 'text,label\n" a ""quoted"", text ",1\n"two\nlines",0\nplain,-2\nshort\n\n,0\nbad,yes\nspaced, 3 ,extra\n'


def test_csv(spark, tmp_path):
    path = write_file(tmp_path / "x.csv", CSV)
    good, bad = files.split_rejects(files.read_csv(spark, path))
    assert pairs(good) == sorted(
        [('a "quoted", text', True), ("two\nlines", False), ("plain", True), ("", False), ("spaced", True)]
    )
    assert {r.source for r in good.collect()} == {"csv_import"}
    assert [(r.text, r.bad_label) for r in bad.collect()] == [("bad", "yes")]
    empty = write_file(tmp_path / "empty.csv", 'text,label\nx,\n"a,b"\ny, ,more\nz,1\n')
    good, bad = files.split_rejects(files.read_csv(spark, empty))
    assert pairs(good) == [("z", True)]
    assert sorted((r.text, r.bad_label) for r in bad.collect()) == [("x", ""), ("y", "")]
    with pytest.raises(Exception, match="label is not an integer"):
        files.read_csv(spark, empty, on_bad="fail").collect()
    with pytest.raises(Exception, match="label is not an integer: yes"):
        files.read_csv(spark, path, on_bad="fail").collect()


def test_csv_columns_by_position(spark, tmp_path):
    path = write_file(tmp_path / "x.csv", "0,x,first\n1,y,second\n2,z\n")
    good, _ = files.split_rejects(files.read_csv(spark, path, False, text_col=2, label_col=0))
    assert pairs(good) == [("first", False), ("second", True)]


def test_lines(spark, tmp_path):
    path = write_file(tmp_path / "list.txt", "\n  one \r\ntwo\rthree\n  \n\x1ffour\x1f\n")
    rows = files.read_line_examples(spark, path, True).collect()
    assert sorted(r.text for r in rows) == ["four", "one", "three", "two"]
    assert {(r.is_credential, r.source) for r in rows} == {(True, "file:list.txt")}


def test_testset(spark, tmp_path):
    path = write_file(tmp_path / "t.json", '{\n "texts": ["a", "b"],\n "labels": [1, 0]\n}')
    rows = files.read_testset(spark, path).collect()
    assert [(r.pos, r.text, r.label) for r in rows] == [(0, "a", 1), (1, "b", 0)]
    path = write_file(tmp_path / "u.json", '{"texts": ["a", "b", "c"], "labels": [1, 0]}')
    with pytest.raises(Exception, match="unequal number"):
        files.read_testset(spark, path).collect()


def test_union_and_deficit(spark, texts):
    yes, no = label_examples(texts(["a", "a", "b"]), True), label_examples(texts(["c"]), False)
    both = label_union(yes, no)
    assert sorted((r.text, r.label) for r in both.collect()) == [("a", 1), ("a", 1), ("b", 1), ("c", 0)]
    rows = class_deficit(yes.unionByName(no), 3).collect()
    assert {(r.is_credential, r.n, r.deficit) for r in rows} == {(True, 3, 0), (False, 1, 2)}
    empty = class_deficit(yes.limit(0), 5).collect()
    assert {(r.is_credential, r.n, r.deficit) for r in empty} == {(True, 0, 5), (False, 0, 5)}


def test_top_up(texts):
    start = label_examples(texts([f"v{i}" for i in range(12)]), True)
    topped = top_up(start, 10)
    counts = {r.is_credential: r["count"] for r in topped.groupBy("is_credential").count().collect()}
    assert counts == {True: 12, False: 10}
    assert topped.where(F.col("source") == "synthetic").count() == 10
