import json
import random

import pytest

from sheaf.operators import nested as S


def brute(texts):
    def arr(v):
        if isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return []
        if isinstance(v, dict):
            v = [v]
        return [(i, x) for i, x in enumerate(v) if isinstance(x, dict)] if isinstance(v, list) else []

    out = set()
    for i, t in texts:
        try:
            o = json.loads(t or "")
        except ValueError:
            continue
        if not isinstance(o, dict):
            continue
        for p in S.PATHS:
            name = ".".join(x for x in p if x != "*")
            if len(p) == 1:
                out |= {(i, name, -1, j) for j, _ in arr(o.get(p[0]))}
            elif len(p) == 2:
                c = o.get(p[0])
                c = json.loads(c) if isinstance(c, str) and c.startswith("{") else c
                out |= {(i, name, -1, j) for j, _ in arr(c.get(p[1]))} if isinstance(c, dict) else set()
            else:
                out |= {(i, name, k, j) for k, y in arr(o.get(p[0])) for j, _ in arr(y.get(p[2]))}
    return out


def random_envelope(r):
    def value(depth=0):
        return r.choice([None, 3, -1.5e3, True, "", "见附件", 'a"b\\', "[1]", "{", "，：", [], {}, {"k": [1, {"seals": []}]}] + ([[value(depth + 1), value(depth + 1)]] if depth < 2 else []))

    def array():
        items = [r.choice([value(), {"label": value(), "seals": value(), "identifiers": [{"label": "x"}, 1, {}], "candidates": {"a": 1}}, {"identifiers": json.dumps([{"a": '"]'}])}]) for _ in range(r.randrange(4))]
        return r.choice([items, items, items, json.dumps(items), {"label": 1}, None, value()])

    o = {p[0]: array() for p in S.PATHS if r.random() < 0.7}
    o["completeness"] = r.choice([None, {"issues": array(), "status": "x"}, []])
    o["decoy"] = {"amounts": [{"a": 1}]}
    return json.dumps(o, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))


def test_random_envelopes_equal_brute_force(spark):
    r = random.Random(7)
    texts = [(i, random_envelope(r)) for i in range(400)] + [(1000, None), (1001, ""), (1002, "[1]"), (1003, '{"amounts": [{"a": 1}'), (1004, '{"amounts": [{"a": NaN}]}'), (1005, '{"amounts": [{"a": "\\\\"}, {"b": "\\""}]}')]
    df = spark.createDataFrame(texts + texts[:50], "doc_id bigint, details_json string").withColumnRenamed("doc_id", "doc_id").repartition(3)
    got = [tuple(x) for x in S.flatten_json(df, "doc_id", "details_json", values=False, chunk_bytes=3000).distinct().collect()]
    want = brute([t for t in texts if t[0] != 1004])
    assert len(got) == len(set(got)) and set(got) == want


def test_values_and_flat_tables(spark):
    text = json.dumps({"person_identities": [{"name": "张三", "identifiers": [{"label": "电话", "value": "1\n2"}]}, 3, {"name": "李四"}]})
    df = spark.createDataFrame([(7, text, "clash")], "doc_id bigint, details_json string, pos string")
    rows = S.flatten_json(df, "doc_id", "details_json")
    assert [tuple(r) for r in S.flat_table(rows, "doc_id", "person_identities").orderBy("pos").collect()] == [(7, -1, 0, "张三", None), (7, -1, 2, "李四", None)]
    assert [tuple(r) for r in S.flat_table(rows, "doc_id", "person_identities.identifiers").collect()] == [(7, 0, 0, "电话", "1\n2")]


def test_last_of_repeated_keys_and_long_text(spark):
    text = '{"amounts": [], "amounts": [{"a": 1}], "seals": [' + ",".join('{"t": "%s"}' % ("长" * 500) for _ in range(3000)) + "]}"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, details_json string")
    counts = {r.array_name: r["count"] for r in S.flatten_json(df, "doc_id", "details_json", values=False).groupBy("array_name").count().collect()}
    assert counts == {"amounts": 1, "seals": 3000}


@pytest.mark.parametrize("ddl", ["doc_id bigint, details_json string"])
def test_empty_table(spark, ddl):
    assert S.flatten_json(spark.createDataFrame([], ddl), "doc_id", "details_json").count() == 0
