"""Result documents with example arrays, fields that must be there, and lookups that must find their key."""

import json

import pytest

from seqlab.operators import metrics as M
from seqlab.operators import ngram as N
from seqlab.sources import corpus_io as IO


def verdicts(spark):
    rows = [("m", "r", i, "p", f"x{i}", i % 3 == 0, None if i % 2 else i % 5 == 0) for i in range(40)] + [("n", "r", 99, "p", "only", False, None)]
    return spark.createDataFrame(rows, "model string, rule string, id long, prompt string, extracted string, is_valid boolean, is_lenient_valid boolean").repartition(5)


@pytest.mark.parametrize("k", [1, 5, 100])
def test_example_arrays_are_the_first_of_each_class(spark, k):
    v = verdicts(spark)
    want = {}
    for r in sorted(v.collect(), key=lambda r: r.id):
        c = "valid" if r.is_valid else "lenient_only" if r.is_lenient_valid else "invalid"
        some = want.setdefault(r.model, {}).setdefault(c, [])
        if len(some) < k:
            some.append((len(some) + 1, r.id, r.prompt, r.extracted))
    got = {r.model: {c: [tuple(x) for x in e] for c, e in r.examples.items()} for r in M.example_arrays(v, ["model"], k).collect()}
    assert got == want
    assert M.example_arrays(v.limit(0), ["model"]).count() == 0


def test_documents_without_a_required_field_raise(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "text": "x"}\n\n{"id": 2, "text": ""}\n')
    schema = "id long, text string"
    assert IO.scan_jsonl(spark, str(tmp_path), schema, ("text",)).count() == 2
    assert {r.text for r in IO.scan_jsonl(spark, str(tmp_path), schema, ("text",)).collect()} == {"x", ""}
    (tmp_path / "b.jsonl").write_text(json.dumps({"id": 3}) + "\n")
    assert IO.scan_jsonl(spark, str(tmp_path), schema).count() == 3
    with pytest.raises(Exception, match="missing field: text"):
        IO.scan_jsonl(spark, str(tmp_path), schema, ("text",)).collect()


def test_a_lookup_without_its_key_raises(spark):
    keys = spark.createDataFrame([("a", 1), ("b", 2)], "variant string, ord int")
    values = spark.createDataFrame([("a", 0.5), ("c", 0.1)], "variant string, rate double")
    with pytest.raises(Exception, match="no entry: b"):
        IO.looked_up(keys, values, ["variant"]).collect()
    more = values.union(spark.createDataFrame([("b", None)], "variant string, rate double"))
    assert sorted(map(tuple, IO.looked_up(keys, more, ["variant"]).collect())) == [("a", 1, 0.5), ("b", 2, None)]


def test_preference_over_each_of_several(spark):
    rows = [("each", "t1", "good", 0.4), ("each", "t1", "bad", 0.3), ("each", "t1", "bad", 0.35), ("each", "t2", "good", 0.4), ("each", "t2", "bad", 0.4),
            ("group", "t3", "good", 0.4), ("group", "t3", "bad", 0.3), ("group", "t3", "bad", 0.35), ("each", "t4", "good", 0.1)]
    df = spark.createDataFrame([("r", t, k, s, p, None) for k, t, s, p in rows], "rule string, test string, kind string, side string, prob double, threshold double")
    assert {r.test: r.correct for r in N.decision_results(df, ["rule"]).collect()} == {"t1": True, "t2": False, "t3": False, "t4": True}
