"""Valid JSON stays what it is; JSON cut off anywhere, commented, fenced or misspelt comes out as JSON."""

import json
import random
import string

import pytest

from sparkloom.functions.json_text import tolerant, tolerant_json


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 5)
    if kind == 5:
        return {"".join(rng.choice(string.ascii_letters + ' "\\é') for _ in range(rng.randrange(4))): value(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind == 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 0, -12, 3.5, 1e30, "", "a,b", 'q"{}[]:', "back\\slash", "line\nbreak", "//no comment", "```", "日本"])


def test_valid_json_stays():
    rng = random.Random(1)
    for _ in range(3000):
        v = {"k": value(rng)}
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        assert json.loads(tolerant(text)) == v
        assert json.loads(tolerant(f"Here it is:\n```json\n{text}\n```\nand {{more}}")) == v


def test_a_text_cut_anywhere_is_json_and_keeps_what_was_whole():
    rng = random.Random(2)
    for _ in range(1500):
        v = {"first": value(rng), "second": value(rng), "third": 1}
        text = json.dumps(v)
        cut = rng.randrange(1, len(text) + 1)
        got = json.loads(tolerant(text[:cut]))
        for key, nxt in (("first", '"second"'), ("second", '"third"')):
            if cut > text.rindex(nxt):
                assert got[key] == v[key]


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 1, /* c } */ "b": [1, 2,], // x ]\n}', {"a": 1, "b": [1, 2]}),
        ('{"a": "\\alpha \\u00e9 \\x", "b": "\\\\frac"}', {"a": "\\alpha é \\x", "b": "\\frac"}),
        ("{a: True, b: None, c: x-y}", {"a": True, "b": None, "c": "x-y"}),
        ('{"a": 1 "b": 2}', {"a": 1, "b": 2}),
        ('{"a": [1, {"b": 2]', {"a": [1, {"b": 2}]}),
        ('{"a": , "b": }', {"a": None, "b": None}),
        ('{"a": tr', {"a": True}),
        ('{"a": 1.', {"a": 1}),
        ('{"a": -', {"a": None}),
        ('{"a": "x\\', {"a": "x\\"}),
        ('{"a": "line\nbreak\t"}', {"a": "line\nbreak\t"}),
        ('{"a": 1, "b', {"a": 1}),
        ('{"a": 1]} tail', {"a": 1}),
        ("[1, 2", [1, 2]),
        ("see [1] {\"a\": 2}", {"a": 2}),
        ("{}", {}),
        ("{", {}),
    ],
)
def test_repairs(text, want):
    assert json.loads(tolerant(text)) == want


def test_nothing_to_read(spark):
    assert tolerant(None) is None and tolerant("") is None and tolerant("plain") is None
    df = spark.createDataFrame([(1, '{"a": {"b": 7}'), (2, None), (3, "none"), (4, '[{"a": 1}]')], "id long, text string")
    got = {r["id"]: r["b"] for r in df.select("id", tolerant_json(df["text"]).alias("v")).selectExpr("id", "try_variant_get(v, '$.a.b', 'long') as b").collect()}
    assert got == {1: 7, 2: None, 3: None, 4: None}
