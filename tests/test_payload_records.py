"""The walk to a payload's record list against a plain one over parsed JSON."""

import json
import random

import __spark_entry__ as entry
from small_data import SMALL

from barloom.sources.payloads import RECORD_KEYS, explode_payload_records


def plain(body, depth=0):
    """Records of the first list with an object, depth first."""
    if isinstance(body, list):
        found = [e for e in body if isinstance(e, dict)]
        return found or None
    if isinstance(body, dict) and depth < 4:
        for k in RECORD_KEYS:
            if k in body:
                found = plain(body[k], depth + 1)
                if found:
                    return found
    return None


def grown(rng, depth=0):
    kind = rng.random()
    if depth > 5 or kind < .15:
        return rng.choice([None, 7, 1.5, "x", " {", True, [], {}])
    if kind < .45:
        return [rng.choice([{"a": rng.randint(0, 9)}, {"b": [1, {"c": None}], "a": "é\n"}, 3, None, [], "{"])
                for _ in range(rng.randint(0, 3))]
    return {k: grown(rng, depth + 1) for k in rng.sample([*RECORD_KEYS, "other"], rng.randint(1, 3))}


def test_records_match_a_plain_walk(spark):
    rng = random.Random(5)
    bodies = [json.dumps(grown(rng), ensure_ascii=rng.random() < .5, indent=rng.choice([None, 1])) for _ in range(400)]
    bodies += [None, "", " ", "{", "nan", '{"data": [{"a": 1}', '{"x": 1, "x": 2, "data": [{}]}', "  [ {} ] ",
               '[{"a": 12345678901234567890.125}]', json.dumps({"data": [{"a": "y" * 200_000}]})]
    records, failed = explode_payload_records(spark.createDataFrame(list(enumerate(bodies)), "id long, payload_body string"))
    got = {}
    for r in records.orderBy("id", "ordinal").collect():
        assert r.ordinal == len(got.setdefault(r.id, []))
        got[r.id].append(json.loads(r.record))
    want = {}
    for i, body in enumerate(bodies):
        twice = []
        try:
            parsed = json.loads(body or "", object_pairs_hook=lambda p: twice.append(len(dict(p)) < len(p)) or dict(p))
        except ValueError:
            continue
        found = None if any(twice) else plain(parsed)
        if found:
            want[i] = found
    assert got == want and len(want) > 100
    assert sorted(r.raw_payload_id for r in failed.collect()) == sorted(set(range(len(bodies))) - set(want))
    assert {r.issue for r in failed.collect()} == {"no record list"}


def test_no_payloads(spark):
    records, failed = explode_payload_records(spark.createDataFrame([], "id long, payload_body string"))
    assert records.count() == failed.count() == 0


def test_records_and_failures_come_from_one_pass(spark):
    df = entry.queries()["explode_payload_records"](spark, SMALL)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
