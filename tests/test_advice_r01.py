import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry


def _sql_rows(name, root):
    con = duckdb.connect()
    for t in ("dataset_base", "golden"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_prompt_has_the_whole_text(spark, tmp_path):
    texts = ["x" * 900 + "a", "x" * 900 + "b", "é" * 16000 + "tail", "", None]
    rows = [(f"DOC{i}", "c", "i", "2024", "t", x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id string, company string, industry string, year string, title string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "dataset_base.parquet")
    df.select("doc_id").coalesce(1).write.parquet(str(tmp_path / "golden.parquet.d"))
    next((tmp_path / "golden.parquet.d").glob("*.parquet")).rename(tmp_path / "golden.parquet")
    got = sorted(tuple(r) for r in entry.queries()["q_prompt_full"](spark, str(tmp_path)).collect())
    bare = got[3][2]
    assert [n - bare for _, _, n in got] == [901, 901, 16000, 0, 0] and got[0][1] != got[1][1]
    assert got == _sql_rows("q_prompt_full", tmp_path)


def test_list_order_has_every_document(spark, tmp_path):
    docs = spark.range(120).select(F.format_string("DOC%03d", "id").alias("doc_id"), F.lit("t").alias("title"))
    for name, df in (("dataset_base", docs), ("golden", docs.select("doc_id", F.lit(" Test").alias("split")))):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.d"))
        next((tmp_path / f"{name}.d").glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    queries = entry.queries()
    got = [tuple(r) for r in queries["q_list_order_all"](spark, str(tmp_path)).collect()]
    assert got == [(f"DOC{i:03d}", i + 1) for i in range(120)] == _sql_rows("q_list_order_all", tmp_path)
    assert [tuple(r) for r in queries["q_list_order"](spark, str(tmp_path)).collect()] == got[:50] == _sql_rows("q_list_order", tmp_path)
