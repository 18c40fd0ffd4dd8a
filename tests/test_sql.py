from veilframe.functions import sql


def test_registered_functions(spark):
    assert sql.register(spark) == ["pii_scan", "pii_types"]
    spark.createDataFrame([(0, "mail joe@acme.io, ssn: 536-90-4399"), (1, None), (2, "")], "doc_id long, text string").createOrReplaceTempView("sql_docs")
    got = {r["doc_id"]: r for r in spark.sql("SELECT doc_id, pii_types(text) AS types, pii_scan(text) AS spans FROM sql_docs").collect()}
    assert got[0]["types"] == ["EMAIL", "NATIONAL_ID"] and [s["text"] for s in got[0]["spans"]] == ["joe@acme.io", "536-90-4399"]
    assert got[1]["types"] == got[2]["types"] == [] and got[1]["spans"] == []
