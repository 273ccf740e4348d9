"""Large files with quoted separators: many tasks for one file, rows as one task reads them."""

import csv
import io
import json
import random

import pytest

from checks import queries
from keysift.sources import files, pieces


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few bytes, so that records cross one or many of them."""
    settings = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in settings}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def random_csv(seed, end="\n"):
    chosen = random.Random(seed)
    lines = []
    for _ in range(25):
        text = "".join(chosen.choices(["a", "é", ",", '"', "\n", "bc ", '""', "x" * 30], k=chosen.randrange(12)))
        if chosen.random() < 0.3:
            text = text.replace('"', "").replace(",", "").replace("\n", "") + 'in"ner'
            lines.append(f"{text},{chosen.randrange(-1, 3)}")  # a quote inside a field without quotes
        elif chosen.random() < 0.2:
            lines.append("")
        elif chosen.random() < 0.1:
            lines.append('"only, one"')
        else:
            quoted = '"' + text.replace('"', '""').replace("\n", end) + '"'
            lines.append(f"{quoted},{chosen.choice(['0', '1', '-2', 'x', ''])},more" + ",more" * chosen.randrange(2))
    return end.join(lines) + chosen.choice(["", end])


def ordered(found):
    return sorted(map(tuple, found), key=lambda r: tuple((x is not None, x) for x in r))


def rows(df):
    return ordered(df.collect())


@pytest.mark.parametrize("seed, size, end", [(1, 60, "\n"), (2, 200, "\n"), (3, 100, "\r\n")])
@pytest.mark.parametrize("has_header", [True, False])
def test_csv_as_one_task_reads_it(spark, tmp_path, small_blocks, seed, size, end, has_header):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_bytes(random_csv(seed * 10 + k, end).encode())
    whole = rows(files.read_csv(spark, str(tmp_path), has_header, whole_files=True))
    small_blocks(size)
    assert rows(files.read_csv(spark, str(tmp_path), has_header)) == whole


@pytest.mark.parametrize("seed", range(20))
def test_csv_records_as_python_reads_them(seed):
    """The end of each line, from outside and inside quotes, told without the lines before."""
    text = random_csv(seed)
    inside, held, found = False, [], []
    for line in text.split("\n"):
        held.append(line)
        inside = pieces.csv_ends_inside(line, inside)
        if not inside:
            found.append("\n".join(held))
            held = []
    expected = [row for row in csv.reader(io.StringIO(text, newline="")) if row]
    assert [next(csv.reader(io.StringIO(r, newline=""))) for r in found if r] == expected


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    path = tmp_path / "x.csv"
    body = "".join(f'"text {i}\nsecond line, ""quoted""",{i % 2}\n' for i in range(2000))
    path.write_text("text,label\n" + body)
    small_blocks(4000)
    lines = pieces.read_pieces(spark, str(path), "\n")
    assert lines.rdd.getNumPartitions() > 10
    found = files.read_csv_records(spark, str(path), has_header=True)
    assert found.select("block").distinct().count() > 10
    texts = files.read_csv(spark, str(path)).select("text", "is_credential").collect()
    assert sorted(map(tuple, texts)) == sorted((f'text {i}\nsecond line, "quoted"', i % 2 == 1) for i in range(2000))


def test_csv_of_odd_files(spark, tmp_path, small_blocks):
    small_blocks(32)
    for content, expected in [
        ("", []),
        ("\n\n\n", []),
        ("﻿a,1\n", [("a", True)]),
        ('\n\n"h\n",h\na,1\n', [("h", None), ("a", True)]),
        ('a,1\n"never closed, 0\nb,0', [("a", True), ("never closed, 0\nb,0", None)]),
        ('"' + "long\n" * 50 + '",1', [(("long\n" * 50).strip(), True)]),
    ]:
        path = tmp_path / "odd.csv"
        path.write_text(content)
        found = files.read_csv(spark, str(path), has_header=False)
        assert rows(found.select("text", "is_credential")) == ordered(expected), content
    (tmp_path / "bytes.csv").write_bytes(b"\xff\xfe,1\n")
    assert [r.is_credential for r in files.read_csv(spark, str(tmp_path / "bytes.csv"), False).collect()] == [True]
    assert files.read_csv_records(spark, str(tmp_path / "none")) is None


def random_testset(seed, n, **layout):
    chosen = random.Random(seed)
    texts = ["".join(chosen.choices(["a", "é", ",", '"', "\n", "\\", "]", "}", "[{", "x" * 20, " "], k=chosen.randrange(9))) for _ in range(n)]
    labels = [chosen.randrange(2) for _ in texts]
    sets = {"name": 'a "name", with commas', "texts": texts, "labels": labels, "version": 3, "tags": ["x,", "y"]}
    keys = list(sets)
    chosen.shuffle(keys)
    return texts, labels, json.dumps({k: sets[k] for k in keys}, **layout)


@pytest.mark.parametrize(
    "seed, size, layout",
    [(1, 60, {}), (2, 200, {"indent": 2}), (3, 100, {"ensure_ascii": False, "separators": (",", ":")})],
)
def test_one_object_is_read_by_many_tasks(spark, tmp_path, small_blocks, seed, size, layout):
    texts, labels, content = random_testset(seed, 40, **layout)
    path = tmp_path / "test.json"
    path.write_text(content)
    small_blocks(size)
    assert pieces.read_pieces(spark, str(path), ",").rdd.getNumPartitions() > 5
    found = rows(files.read_testset(spark, str(path)))
    assert found == [(i, t, y) for i, (t, y) in enumerate(zip(texts, labels))]
    assert found == sorted(map(tuple, files.read_testset(spark, str(path), whole_files=True).collect()))


def test_objects_of_a_folder(spark, tmp_path, small_blocks):
    expected = []
    for k in range(3):
        texts, labels, content = random_testset(k, k * 5)
        (tmp_path / f"{k}.json").write_text(content + "\n" * k)
        expected += [(i, t, y) for i, (t, y) in enumerate(zip(texts, labels))]
    small_blocks(100)
    assert sorted(map(tuple, files.read_testset(spark, str(tmp_path)).collect())) == sorted(expected)


def test_bad_objects(spark, tmp_path, small_blocks):
    small_blocks(10)
    path = tmp_path / "bad.json"
    for content, message in [
        ('{"texts": ["a", "b"], "labels": [1]}', "unequal number"),
        ('{"texts": ["a"], "labels": [1, 0]}', "unequal number"),
        ('{"texts": ["a"]}', "unequal number"),
        ('{"texts": ["a"], "labels": [1], "more": [[1, 2], [3]]}', "whole_files"),
    ]:
        path.write_text(content)
        with pytest.raises(Exception, match=message):
            files.read_testset(spark, str(path)).collect()
    path.write_text('{"texts": [], "labels": []}')
    assert files.read_testset(spark, str(path)).collect() == []
    path.write_text('{"labels": [null, 1], "texts": [null, "b"]}')
    assert sorted(map(tuple, files.read_testset(spark, str(path)).collect())) == [(0, None, None), (1, "b", 1)]
    assert files.read_testset(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("seed, size", [(4, 60), (5, 500)])
def test_one_object_in_files_that_follow_each_other(spark, tmp_path, small_blocks, seed, size):
    texts, labels, content = random_testset(seed, 40, indent=2)
    lines = content.splitlines(keepends=True)
    cuts = sorted(random.Random(seed).sample(range(1, len(lines)), 6))
    for k, (a, b) in enumerate(zip([0, 0, *cuts], [0, *cuts, len(lines)])):
        (tmp_path / f"part-{k:05d}.txt").write_text("".join(lines[a:b]))  # the first is empty
    small_blocks(size)
    found = rows(files.read_testset(spark, str(tmp_path), in_parts=True))
    assert found == [(i, t, y) for i, (t, y) in enumerate(zip(texts, labels))]
    assert files.read_testset(spark, str(tmp_path / "none"), in_parts=True) is None
    with pytest.raises(ValueError, match="in parts"):
        files.read_testset(spark, str(tmp_path), whole_files=True, in_parts=True)


def test_files_that_follow_each_other_are_not_cut_inside_quotes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"texts": ["a, b')
    (tmp_path / "b.json").write_text(', c"], "labels": [1]}')
    with pytest.raises(ValueError, match="ends inside quotes"):
        files.read_testset(spark, str(tmp_path), in_parts=True)


def test_one_object_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    texts = [f'{k}, "word" {"digit" if k % 3 else k}\n' for k in range(300)]
    texts = [t if k % 2 else t.lstrip("0123456789") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    written = []
    path = queries.scratch_path

    def scratch_path(session, name):
        written.append(path(session, name))
        return written[-1]

    monkeypatch.setattr(queries, "scratch_path", scratch_path)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        found = rows(queries.QUERIES["ingest_testset_object"](spark, str(tmp_path)))
    finally:
        spark.conf.set(key, before)
    expected = [(i, t, int(any(c.isdigit() for c in t))) for i, t in enumerate(texts, 1)]
    assert found == [(0, None, None), *expected]
    parts = spark.read.text(written[0]).select("_metadata.file_path").distinct().count()
    assert parts > 2
