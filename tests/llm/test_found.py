import pytest

import __spark_entry__ as e


def test_p1_found_is_registered_over_all_chunks(spark, tmp_path):
    rows = [(1, 'a = 1\r\nPASSWORD = "k9#Lm2!qRx"\r\n'), (1, 'a = 1\r\nPASSWORD = "k9#Lm2!qRx"\r\n'), (2, None), (3, "plain"), (4, 'TOKEN = "v8Rt-22Kq-z01"')]
    spark.createDataFrame([(*r, 1) for r in rows], "id long, text string, line_start int").write.parquet(str(tmp_path / "chunks.parquet"))
    out = e.queries()["p1_found"](spark, str(tmp_path))
    assert out.dtypes == [("chunk_id", "bigint"), ("line_no", "bigint")]
    assert sorted(map(tuple, out.collect())) == [(1, 2), (4, 1)]


def test_p4_found_counts_words(spark, tmp_path):
    rows = [(1, "w " * 385), (1, "w " * 385), (2, " \t" + "w\r\n" * 384), (3, "w\f" * 385), (4, "w\u00a0" * 500), (5, None), (6, ""), (7, "w\x0b" * 500)]
    spark.createDataFrame([(*r, 1) for r in rows], "id long, text string, line_start int").write.parquet(str(tmp_path / "chunks.parquet"))
    out = e.queries()["p4_found"](spark, str(tmp_path))
    assert out.dtypes == [("chunk_id", "bigint")]
    assert sorted(r.chunk_id for r in out.collect()) == [1, 3]


def test_p4_found_agrees_with_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW chunks AS SELECT * FROM read_parquet('{d}/chunks.parquet')")
    want = sorted(r[0] for r in db.execute(e.oracle_sql()["p4_found"]).fetchall())
    assert want and sorted(r.chunk_id for r in e.queries()["p4_found"](spark, d).collect()) == want


def test_redacted_texts(spark):
    from seekspark.llm import secrets

    df = spark.createDataFrame([(1, 'a\r\nPASSWORD = "k9#Lm2!qRx"\r\nb', "old"), (2, None, "old"), (3, "", "old"), (4, "plain", "old")], "id long, text string, redacted string")
    assert [r.redacted for r in secrets.redact(df).orderBy("id").collect()] == ['a\r\nPASSWORD = "[REDACTED:assigned]"\r\nb', None, "", "plain"]
    assert secrets.find(df.limit(0)).count() == 0
