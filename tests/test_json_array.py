"""One top-level JSON array, split at record borders."""
import json
import os
import random

import pytest

from replenish.sources.files import read_json
from replenish.sources.json_array import array_records, read_json_array

TEXTS = ['plain', '}', '{"', '\\', '\\"}', ',{', '],[', 'é}\n{', '', '"}, {"', '\\\\"', 'x' * 300]


def _records(n):
    r = random.Random(5)
    return [{"id": i, "text": r.choice(TEXTS) + r.choice(TEXTS), "deep": {"a": {"b": r.choice(TEXTS)}, "list": [{"c": i}, {"c": r.choice([None, 1])}]}}
            for i in range(n)]


def _write(folder, text, name="a.json"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


@pytest.mark.parametrize("indent", [None, 2])
def test_equals_sparks_reader_over_several_tasks(spark, tmpdir_path, indent):
    path = _write(tmpdir_path, json.dumps(_records(400), indent=indent))
    small = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 4
        got = read_json_array(spark, path)
        want = spark.read.option("multiLine", True).json(path)
        assert got.schema == want.schema
        assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)
        order = [json.loads(r.text.lstrip("[, \n") + "}")["id"] for r in array_records(spark, path).where("closed").orderBy("record").collect()]
        assert order == list(range(400))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_folder_of_arrays(spark, tmpdir_path):
    for k in range(3):
        _write(tmpdir_path, "\n[ %s ]\n" % ", \n".join(json.dumps({"ID": 10 * k + i, "s": "}"}) for i in range(k + 1)), f"{k}.json")
    assert sorted(r.id for r in read_json(spark, tmpdir_path).collect()) == [0, 10, 11, 20, 21, 22]


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a"', '[{"a": 1}', '[{"a": 1}, 2]', '[1, {"a": 1}]', '[{"a": 1} {"a": 2}]', '[{"a": 1}] x', '[[{"a": 1}]]', "[]", '["{}"]'])
def test_what_is_no_array_of_records_raises(spark, tmpdir_path, text):
    with pytest.raises(ValueError):
        read_json(spark, _write(tmpdir_path, text))
