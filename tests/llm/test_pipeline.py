"""The pipeline's stages on a small table with nulls, repeats, clashing columns and a very long text, and on an empty one."""

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def prose(i, n=70):
    return " ".join(f"word{i}x{k * k % 997}" for k in range(n))


@pytest.fixture(scope="module")
def stages(spark):
    rows = [(i, prose(i), "en", "a" if i % 2 else None, 1, "x") for i in range(20)]
    rows += [(100, prose(3), "en", "a", 1, "x"), (3, prose(3), "en", "a", 1, "x"), (101, prose(4) + " more", "en", "a", 1, "x"), (None, prose(50), None, None, None, "x")]
    rows += [(102, None, "en", "a", 1, "x"), (103, "", "en", "a", 1, "x"), (104, "too short", "en", "a", 1, "x"), (105, " ".join(f"u{k}" for k in range(30_000)), "en", "b", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row_key string")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(spark.createDataFrame(stage(spark, out[-1], DATA).collect() or [], out[-1].schema if stage is not corpus_pipeline.packing else "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
    return out


def test_stages(stages):
    docs, clean, good, single, mixed, packed = stages
    assert all(x.columns == docs.columns for x in (clean, good, single, mixed))
    ids = [sorted((-1 if r.doc_id is None else r.doc_id) for r in x.select("doc_id").collect()) for x in stages]
    assert {102, 103, 104}.isdisjoint(ids[2]) and {-1, 105, *range(20)} <= set(ids[2])
    assert ids[3] == [-1, *range(20), 105]
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in ids[4]) <= 2
    assert set(ids[5]) == set(ids[4])
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == whole[r.doc_id] and r._row_key == "x" for r in mixed.collect())


def test_empty_table(spark, stages):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, stages[0].limit(0), DATA).collect() == []
