"""JSON texts of any depth against plain Python, stored payloads, answers of models, and a ledger with replays and deletions."""

import datetime
import json
import random
import re

from pyspark.sql import functions as F

from folioflow.functions.json_tree import BLOCK, json_leaves, without_keys
from folioflow.operators.storage import entry_path, items_of, json_of_answer, names_of, safe_stem, stored_payload
from folioflow.sources.store import append, current, delete, trash

HIDDEN = ("raw", "raw_text")


def _value(rng, depth):
    k = rng.random()
    if depth < 5 and k < 0.35:
        return {rng.choice(["a", "raw", "Raw_Text", "b c", 'q"', "é", "n\n"]): _value(rng, depth + 1) for _ in range(rng.randrange(4))}
    if depth < 5 and k < 0.6:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, 3, -2.5, "", "x,y", '{"a":1}', "\\", "]", "tab\t", "\U0001f600"])


def _clean(v):
    if isinstance(v, dict):
        return {k: _clean(x) for k, x in v.items() if k.lower() not in HIDDEN}
    return [_clean(x) for x in v] if isinstance(v, list) else v


def _walk(v, path=""):
    if isinstance(v, dict) and v:
        for k, x in v.items():
            yield from _walk(x, f"{path}.{k}" if path else k)
    elif isinstance(v, list) and v:
        for i, x in enumerate(v):
            yield from _walk(x, f"{path}[{i}]")
    else:
        kind = "object" if isinstance(v, dict) else "list" if isinstance(v, list) else "null" if v is None else "text" if isinstance(v, str) else "other"
        yield path, kind, None if kind in ("object", "list", "null") else v if isinstance(v, str) else json.dumps(v)


def test_trees_of_any_depth(spark):
    rng = random.Random(7)
    values = [{"r": [_value(rng, 0) for _ in range(rng.choice([1, 3, BLOCK]))]} for _ in range(60)]
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2), indent=1 if i % 3 == 0 else None)) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", without_keys(F.col("t"), HIDDEN, any_case=True).alias("left"), json_leaves(F.col("t")).alias("leaves")).collect()
    assert len(got) == len(values)
    for r in got:
        assert json.loads(r.left) == _clean(values[r.i])
        assert [tuple(x) for x in r.leaves] == list(_walk(values[r.i]))


def test_texts_that_are_no_json(spark):
    odd = ['{"a":1} x', '{"a":1}{"b":2}', '{"a":1,}', '{"a":1,"a":2}', "", " ", None, "nul", "{'a':1}", "[1] ,2", "NaN"]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(without_keys(F.col("t"), HIDDEN), json_leaves(F.col("t"))).collect()
    assert {tuple(r) for r in got} == {(None, None)}
    got = spark.createDataFrame([(t,) for t in ("7", '"x"', "[]", '{"r\\u0061w":1,"Raw":2}')], "t string").select(without_keys(F.col("t"), HIDDEN)).collect()
    assert [r[0] for r in got] == ["7", '"x"', "[]", '{"Raw":2}']


def test_stored_payloads_hold_no_raw_text(spark):
    payload = {"patient": "synthetic", "raw_text": "sensitive", "l": [[{"OCR_Text": {"x": "sensitive"}}], {"raw": 1, "k": 2}], "_meta": {"old": 1}, "warnings": ["w"], "sub": {"_meta": 3}}
    failed = {k: payload[k] for k in ("raw_text", "warnings", "patient")}
    cases = [
        (json.dumps(payload), "ok", None, {"patient": "synthetic", "l": [[{}], {"k": 2}], "warnings": ["w"], "sub": {"_meta": 3}}), (json.dumps(failed), "error", 'no "x"}', {"warnings": ["w"], "error": 'no "x"}'}),
        (json.dumps(failed | {"error": None}), "error", "late", {"warnings": ["w"], "error": None}), ("[1]", "ok", None, {}), (None, "error", "m", {"error": "m"}), ("{broken", "error", "", {}), ("{}", None, "unused", {}),
    ]
    rows = spark.createDataFrame([(i, p, s, m) for i, (p, s, m, _) in enumerate(cases)], "i int, p string, s string, m string")
    got = rows.select("i", stored_payload(F.col("p"), F.col("s"), F.col("m"), F.struct(F.col("s").alias("status"))).alias("t")).collect()
    for r in got:
        assert json.loads(r.t) == cases[r.i][3] | {"_meta": {"status": cases[r.i][1]}}
        assert "sensitive" not in r.t
    kept = rows.where("i = 0").select(stored_payload(F.col("p"), F.col("s"), F.col("m"), F.struct("s"), keep_text=True)).first()[0]
    assert json.loads(kept)["raw_text"] == "sensitive" and "old" not in kept


def test_json_of_answers(spark):
    cases = [
        (None, "empty", None), (" \n", "empty", None), ("none", "no object", None), ("} {", "no object", None), ('x {"a": 1} y', "as is", {"a": 1}), ('{x}\n```json\n{"a": [1, 2]}\n```\n{y}', "as is", {"a": [1, 2]}),
        ("```\n{\"a\": 1, , \n}\n```", "repaired", {"a": 1}), ('{"a": [1,], "b": {"c": 2,},}', "repaired", {"a": [1], "b": {"c": 2}}), ('{"a": ", }"}', "as is", {"a": ", }"}), ('{"a": 1} and {"b": 2}', "broken", None), ('{"a": }', "broken", None),
        ("﻿{}", "as is", {}),
    ]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", json_of_answer(F.col("t")).alias("f")).select("i", "f.*").collect()
    for r in got:
        assert (r.state, None if r.text is None else json.loads(r.text)) == cases[r.i][1:]
        if r.state == "repaired":  # the same as taking single commas away until nothing changes
            text, before = re.search(r"(?s)\{.*\}", cases[r.i][0])[0], None
            while before != text:
                before, text = text, re.sub(r",(\s*[}\]])", r"\1", text)
            assert r.text == text
    one = spark.createDataFrame([('{"l": [{"a": 1}, 2, null, "t", {}], "n": ["a ", "\\t", null], "o": {}}',), (None,)], "t string")
    got = [tuple(r) for r in one.select(*[f(F.col("t"), p) for f in (items_of, names_of) for p in ("$.l", "$.n", "$.o", "$.x")]).collect()]
    assert got[0][0] == ['{"a":1}', "{}"] and got[0][1:4] == ([], [], []) and got[0][5] == ["a"] and got[0][6:] == ([], []) and got[1] == ([],) * 8


def test_paths_of_entries(spark):
    names = {"a/b/scan 1.tar.gz": "scan_1_tar", "é (2).pdf": "é_2", "..": "document", "x" * 90 + ".png": "x" * 80, None: "document", "no suffix": "no_suffix"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", safe_stem(F.col("n"))).collect()
    assert {r[0]: r[1] for r in got} == names
    at = spark.range(1).select(entry_path(F.lit("receipt"), F.lit(datetime.datetime(2024, 2, 3, 4, 5, 6)), F.lit("a.pdf"))).first()[0]
    assert at == "receipt/20240203T040506Z_a.json"


def test_ledger_with_replays_and_deletions(spark, tmp_path):
    day, folder = datetime.datetime(2024, 1, 1), str(tmp_path / "ledger")
    assert current(spark, folder).count() == 0 and trash(spark, folder).count() == 0
    old = spark.createDataFrame([(1, "a", "f", day, "a/1", "{}"), (2, "a", "f", day, "a/2", "{}")], "id long, kind string, source_filename string, saved_at timestamp, relative_path string, payload_json string")
    new = old.selectExpr("id + 2 id", "kind", "source_filename", "saved_at", "concat('a/', id + 2) relative_path", "payload_json", "'error' status", "'m' error_message", "null detected_kind", "'image/png' source_mime", "9L source_size")
    append(old, folder, 0)
    for _ in range(2):
        append(new.withColumn("detected_kind", F.lit(None).cast("string")), folder, 1)
    rows = {r.id: (r.status, r.source_size) for r in current(spark, folder).collect()}
    assert rows == {1: ("ok", None), 2: ("ok", None), 3: ("error", 9), 4: ("error", 9)} and current(spark, folder).count() == 4
    for batch, ids in ((0, [2, 77]), (1, [2, 3]), (1, [2, 3])):
        delete(spark.createDataFrame([(i, day + datetime.timedelta(days=batch)) for i in ids], "id long, trashed_at timestamp"), folder, batch)
    append(new.withColumn("detected_kind", F.lit(None).cast("string")), folder, 1)
    assert sorted(r.id for r in current(spark, folder).collect()) == [1, 4]
    assert sorted((r.id, r.original_relative_path, r.trashed_at) for r in trash(spark, folder).collect()) == [(2, "a/2", day), (3, "a/3", day + datetime.timedelta(days=1))]
