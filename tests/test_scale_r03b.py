"""Steps that were changed for time: the same rows, made by batches."""

from pyspark.sql import functions as F

from bytespan.operators import features as fe
from bytespan.functions.bytes import text_view


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_token_tags_are_made_by_batch(spark, monkeypatch):
    monkeypatch.setattr(fe, "TAG_BYTES", 16)
    texts = ["ab, c", "", None, "é!! x", "..", " \n\t", "a", "Zz9" * 11]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string").select("doc_id", text_view("t").alias("v"))
    got = fe.with_token_tags(df, "v", "tt")
    assert "MapInArrow" in _plan(got) and "lambda" not in _plan(got)
    plain = fe.with_token_tags(df, "v", "tt", "[A-Za-z0-9]|[\u0080-ÿ]")     # another form of the same pattern: byte by byte
    assert got.columns == plain.columns and "lambda" in _plan(plain)
    assert [tuple(r) for r in got.sort("doc_id").collect()] == [tuple(r) for r in plain.sort("doc_id").collect()]


def test_gold_spans_leave_the_batch_alone(spark):
    from bytespan.plans.synthetic import gold_spans
    from bytespan.operators.words import words
    texts = ["Ab a@9  x9\nÉa", "", None, "Z", "é@ 7 b"] + [f"W{i} v {i}" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = gold_spans(df)
    assert "rlike" not in _plan(got).lower() and "AS word" not in _plan(got)
    w = F.col("word")
    kind = F.when(w.contains("@"), "contact").when(w.rlike("[0-9]"), "number").when(w.rlike("^[A-Z]"), "name")
    want = words(df).filter("len > 0").select("doc_id", F.col("i").alias("ord"), "start", "len", kind.alias("type")).filter("type is not null")
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
