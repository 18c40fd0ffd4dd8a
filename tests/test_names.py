import random
import re

import duckdb
import pytest

from veilframe import queries
from veilframe.operators import recognize
from veilframe.plans.protect import protect
from veilframe.streaming.restore import Restorer, restore, restored_stream


def test_windows_cover_the_text_and_own_each_place_once():
    rng = random.Random(3)
    for n in (0, 1, 399, 400, 401, 2500):
        for spaces in (0.0, 0.02, 0.3):
            text = "".join(" " if rng.random() < spaces else "x" for _ in range(n))
            found = list(recognize.windows(text))
            assert all(b - a <= 400 for a, b, _, _ in found)
            assert found[0][0] == found[0][2] == 0 and found[-1][1] == found[-1][3] == n
            for (_, b, _, high), (a, _, low, _) in zip(found, found[1:]):
                assert b - a == 96 and high == low
    with pytest.raises(ValueError):
        list(recognize.windows("x", 100, 50))


def test_labels_become_spans():
    text = "Ada Byron met  Acme in Paris."
    rows = [("Ada", "B-PER", 0.9), ("▁By", "I-PER", 0.8), ("##ron", "I-PER", 0.95), ("met", "O", 1.0), ("[UNK]", "B-ORG", 0.4), ("Acme", "I-ORG", 0.7), ("in", "O", 1.0), ("Paris", "I-LOC", 0.6), (".", "O", 1.0)]
    assert recognize.names(text, rows) == [(0, 9, "PERSON", 0.8), (15, 19, "ORG", 0.4), (23, 28, "LOCATION", 0.6)]
    assert recognize.names(text, [("Nowhere", "B-PER", 0.9), ("Ada", "B-MISC", 0.9)]) == []
    assert recognize.names("Ada Ada", [("Ada", "B-PER", 0.9), ("Ada", "B-PER", 0.8)]) == [(0, 3, "PERSON", 0.9), (4, 7, "PERSON", 0.8)]


def test_whole_text_equals_one_window():
    text = " ".join(random.Random(5).choices(["Ada", "Grace", "met", "a", "of", "Turing,"], k=3000))
    names = lambda t: recognize.names(t, queries.capitalised(t))
    assert recognize.recognized(text, names) == names(text)


def test_names_query_equals_sql_and_protect_masks_names(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, name, n FROM ({queries.SQL['recognized_names']})").fetchall()
    assert sorted(map(tuple, queries.recognized_names(spark, sf).select("doc_id", "name", "n").collect())) == sorted(want)
    df = spark.createDataFrame([(1, "so Ada wrote to a@b.example"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: r for r in protect(df, recognizer=(lambda: queries.capitalised, "toy")).collect()}
    assert "Ada" not in got[1]["masked_text"] and got[1]["entities"][0]["detector_id"] == "ner:toy"
    assert got[2]["entities"] == got[3]["entities"] == []


def test_restoration_reads_words_whole_and_the_longest_over_borders():
    r = {"Cat": "Ann", "Cat Stone": "Ann Smith", "AbCd": "x", "AbCdEf": "y", "[P_1]": "z"}
    cases = {"Catalog and Cat.": "Catalog and Ann.", "Cat Stone, Cat": "Ann Smith, Ann", "AbCdEf AbCd": "y x", "a[P_1]b": "azb", "Cat Stones": "Ann Stones"}
    for text, want in cases.items():
        assert restore(text, r, fuzzy=False) == want
        for fuzzy in (False, True):
            for cut in range(len(text) + 1):
                s = Restorer(r, fuzzy=fuzzy)
                assert s.push(text[:cut]) + s.push(text[cut:]) + s.finish() == restore(text, r, fuzzy)
            s = Restorer(r, fuzzy=fuzzy)
            assert "".join(map(s.push, text)) + s.finish() == restore(text, r, fuzzy)
    with pytest.raises(ValueError):
        s.push("more")


def test_restoration_of_changed_words():
    r = {"Northwind": "Acme Corp", "Nils": "Ole", "NILS": "Ada", "Ross": "Boss"}
    assert restore("northwind's plan, (Northwinds) NORTHWIND!", r) == "Acme Corp's plan, (Acme Corps) Acme Corp!"
    assert restore("nils Nils", r) == "nils Ole"  # two values fit the first
    assert restore("Rosss", r) == "Boss"
    assert restore("northwind", r, fuzzy=False) == "northwind"
    assert re.sub(r"\s", "", restore(" \n", r)) == ""


def test_stream_gives_held_tails_at_the_end_and_after_idle_time(spark, tmp_path):
    schema = "conv_id long, seq long, chunk string, last boolean"
    rows = [(1, 0, "to [P_", False), (1, 1, "1] and", True), (2, 0, "from [P", False)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in")
    chunks = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    stream = restored_stream(chunks, {"1": {"[P_1]": "Ada"}, "2": {"[P_1]": "Bo"}}, idle_ms=500)
    query = stream.writeStream.format("memory").queryName("restored").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        for _ in range(60):
            got = {}
            for r in spark.table("restored").orderBy("conv_id", "seq").collect():
                got[r["conv_id"]] = got.get(r["conv_id"], "") + r["text"]
            if got.get(2) == "from [P":
                break
            query.awaitTermination(0.5)
    finally:
        query.stop()
    assert got == {1: "to Ada and", 2: "from [P"}
