"""JSON arrays cut between tasks equal the whole read."""

import json
import random

import pytest

from calltrail.sources import arrays, logs


def _event(r, i):
    odd = ['a}b', '{"x": [1, "}"]}', "[[{", 'q"uo}te', "back\\", "line\nbreak}", "\\\"}", "é☃}", ""]
    return {"type": "ENTER", "tag": r.choice(odd), "className": "C", "methodName": r.choice(odd), "threadName": "main",
            "threadId": 1, "ts": i, "deviceManufacturer": "m", "deviceModel": "d", "appVersion": "1",
            "params": {"k}": r.choice(odd), "[": r.choice(odd)}}


@pytest.fixture()
def folder(tmp_path):
    r = random.Random(4)
    texts = {
        "line": json.dumps([_event(r, i) for i in range(400)]),
        "lines": json.dumps([_event(r, i) for i in range(300)], indent=1, ensure_ascii=False) + "\n",
        "one": json.dumps([_event(r, 0)]), "empty": " [ ]\n", "blank_between": '[ {"ts": 1} , {"ts": 2} ]',
        "nulls": json.dumps([None, _event(r, 1), 3, "}"]), "cut": json.dumps([_event(r, 1), _event(r, 2)])[:-30],
        "bad": '[{"a": tru}, {"ts": 1}]', "glued": '[{"ts": 1}{"ts": 2}]', "after": '[{"ts": 1}] x'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    return tmp_path


def test_arrays_cut_between_tasks_equal_the_whole_read(spark, folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    paths = sorted(str(p) for p in folder.glob("*.json"))
    want = logs.array_candidates(logs._whole(spark, paths)).orderBy("source", "seq").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert arrays._pieces(spark, [str(folder / "line.json")]).rdd.getNumPartitions() > 5
        got = logs._of_arrays(spark, paths).orderBy("source", "seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.asDict(True) for r in got] == [r.asDict(True) for r in want]
    assert len(got) >= 703
