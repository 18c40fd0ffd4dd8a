import dataclasses
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from veilframe.functions import checks
from veilframe.functions.text import normalize
from veilframe.operators import decide, spans
from veilframe.operators.catalog import CATALOG, detectors
from veilframe.operators.detect import scan
from veilframe.operators.masking import masked, restored, with_tokens
from veilframe.plans.protect import protect
from veilframe.streaming.restore import Restorer, restore

VALID = {
    "iban": "GB82 WEST 1234 5698 7654 32", "crypto-btc": "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "national-id-es-dni": "12345678Z", "national-id-br-cpf": "529.982.247-25",
    "vin": "1M8GDM9AXKP042788", "national-id-gb-nhs": "943 476 5919", "national-id-pl-pesel": "44051401359", "national-id-tr-tckn": "10000000146", "national-id-cn-ric": "11010519491231002X",
    "national-id-fi-hetu": "131052-308T", "national-id-in-aadhaar": "2341 2341 2346", "national-id-au-tfn": "123 456 782", "national-id-sg-nric": "S1234567D", "national-id-ie-pps": "1234567T",
}


@pytest.mark.parametrize("name", VALID)
def test_detectors_confirm_valid_and_reject_changed_digits(name):
    d, value = CATALOG[name], VALID[name]
    hit = lambda t: any(d.validate(m) for m in re.finditer(d.pattern, t, d.flags))
    assert hit(f"x {value} y")
    last = max(i for i, c in enumerate(value) if c.isdigit())
    assert not hit(f"x {value[:last]}{(int(value[last]) + 1) % 10}{value[last + 1:]} y")


def test_checks_native(spark):
    df = spark.createDataFrame([("4111111111111111", "021000021", "GB82WEST12345698765432", "236", "1234567893")], "a string, b string, c string, d string, e string")
    r = df.select(checks.luhn_valid(F.col("a")), checks.aba_valid(F.col("b")), checks.iban_mod97_valid(F.col("c")), checks.verhoeff_valid(F.col("d")), checks.npi_valid(F.col("e"))).first()
    assert list(r) == [True] * 5


def test_normalize_maps_offsets():
    out, at = normalize("a​bﬁ１")
    assert out == "abfi1" and at[3] == 3 and at[-1] == 5


def test_protect_masks_restores_and_leaks_nothing(spark):
    texts = ["mail joe@acme.io or joe@acme.io, card 4012 8888 8888 1881 and 5500005555555559", "", None, "nothing here", "😀 joe@acme.io x@y.io"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = protect(df, profile="balanced").withColumn("back", restored(F.col("masked_text"), F.col("tokens"))).orderBy("doc_id").collect()
    assert [r["back"] for r in out] == [t or "" for t in texts]
    assert out[0]["masked_text"].startswith("mail [EMAIL_1] or [EMAIL_1]") and out[4]["masked_text"] == "😀 [EMAIL_1] [EMAIL_2]"
    assert all(not r["leaked"] for r in out) and out[3]["exposure_band"] == "none"


def test_resolution_leaves_no_hole_and_no_overlap(spark):
    rows = [(1, [(0, 10, "EMAIL", 0.9, "a", True, "", None), (5, 14, "PHONE", 0.8, "b", True, "", None), (2, 4, "VIN", 0.8, "c", True, "", None), (20, 22, "VIN", 0.8, "c", True, "", None)])]
    df = spark.createDataFrame(rows, "doc_id long, c array<struct<start: int, end: int, type: string, raw_conf: double, detector_id: string, sensitive: boolean, text: string, canonical: string>>")
    kept = df.select("doc_id", F.explode(spans.resolved(F.col("c"))).alias("s")).select("doc_id", "s.*")
    before = df.select("doc_id", F.explode("c").alias("s")).select("doc_id", "s.*")
    assert [(r["start"], r["end"]) for r in kept.orderBy("start").collect()] == [(0, 14), (20, 22)]
    assert spans.coverage_holes(before, kept).count() == 0


SPAN = "array<struct<start: int, end: int, type: string, raw_conf: double, detector_id: string, sensitive: boolean, text: string, canonical: string>>"


def test_resolution_is_disjoint_and_restores(spark):
    rng = random.Random(5)
    text = "ABCDEFGHIJKLMNOPQRSTUVWXYZ é😀 [VIN_3] 0123456789"
    kinds = ["EMAIL", "PHONE", "VIN", "NATIONAL_ID", "GENERIC_SECRET"]
    rows = [(0, text, [(0, 6, "EMAIL", 0.9, "a", True, text[0:6], None), (8, 14, "PHONE", 0.8, "b", True, text[8:14], None), (5, 10, "VIN", 0.8, "c", True, text[5:10], "x")])]
    for i in range(1, 300):
        found = []
        for _ in range(rng.randint(0, 8)):
            a = rng.randrange(len(text) - 1)
            b = rng.randint(a + 1, min(len(text), a + 12))
            found.append((a, b, rng.choice(kinds), rng.choice([0.3, 0.6, 0.85]), rng.choice("ab"), rng.random() < 0.8, text[a:b], text[a:b].lower() if rng.random() < 0.3 else None))
        rows.append((i, text, found))
    df = spark.createDataFrame(rows, f"doc_id long, text string, c {SPAN}").withColumn("w", spans.resolved(F.col("c"), F.col("text")))
    df = df.withColumn("t", with_tokens(F.col("w"), F.col("text"))).withColumn("m", masked(F.col("text"), F.col("t")))
    out = df.select("*", restored(F.col("m"), F.col("t")).alias("back"), spans.overlapping(F.col("w")).alias("clash"), spans.segments(F.col("text"), F.col("w")).alias("parts")).collect()
    for r in out:
        assert not r["clash"] and all(x["text"] == text[x["start"] : x["end"]] for x in r["w"])
        assert all(any(x["start"] <= c["start"] and c["end"] <= x["end"] for x in r["w"]) for c in r["c"] if c["sensitive"])
        assert r["back"] == text and "".join(p["text"] for p in r["parts"]) == text and not any(t["token"] in text for t in r["t"])
    assert [(x["start"], x["end"]) for x in out[0]["w"]] == [(0, 14)] and any(spans_overlap(r["c"]) for r in out)


def spans_overlap(found):
    return any(a["start"] < b["end"] and b["start"] < a["end"] for i, a in enumerate(found) for b in found[:i])


def test_protect_restores_joined_values(spark):
    values = ["12 rue de Paris zip E11.9", "943 476 5919/joe@acme.io, ", "[EMAIL_1] and joe@acme.io", "https://u:secret1@acme.io/x joe@acme.io", "ssn: 536-90-4399/4111111111111111", "می‌خواهم joe@acme.io ½"]
    rng = random.Random(1)
    texts = values + [rng.choice(["", " ", "/", ","]).join(rng.choice(values) for _ in range(3)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"candidates": F.lit(1), "tokens": F.lit("x")})
    for mode in ("token", "surrogate"):
        out = protect(df, profile="strict", mode=mode).withColumn("back", restored(F.col("masked_text"), F.col("tokens"))).collect()
        assert len(out) == len(texts) and all(r["back"] == r["text"] and r["candidates"] == 1 for r in out)


def test_protect_lists_and_curves(spark):
    df = spark.createDataFrame([(0, "mail A@acme.io or b@acme.io")], "doc_id long, text string")
    types = lambda **k: [e["text"] for e in protect(df, **k).first()["entities"]]
    assert types() == ["A@acme.io", "b@acme.io"] and types(allow=[" a@ACME.io "]) == ["b@acme.io"]
    assert types(profile="minimal") == [] and types(profile="minimal", deny=["B@acme.io  "]) == ["b@acme.io"]
    assert types(curves={"EMAIL": [(0.5, 0.9), (1.1, 0.4)]}) == [] and types(curves={"*": [(1.1, 0.9)]}) == ["A@acme.io", "b@acme.io"]


def verdict(name, text):
    d = CATALOG[name]
    return next((v for m in re.finditer(d.pattern, text, d.flags) if (v := d.validate(m))), None)


@pytest.mark.parametrize(("name", "text", "sensitive"), [("credit-card", "4222222222222", False), ("credit-card", "5200828282828210", False), ("credit-card", "6759649826438453", True), ("iban", "GB82WEST12345698765432", False), ("iban", "GB33BUKB20201555555555", True), ("url-with-credentials", "https://user:pw@example.com/demo", False), ("url-with-credentials", "https://user:pw@acme.io/demo", True), ("health-data", "5.1 µg/L", True), ("health-data", "Glucose 182 mg/dL [70-99]", True), ("phone", "(415) 555-2671", True), ("national-id-us-ssn", "078-05-1120", False)])
def test_published_values(name, text, sensitive):
    assert verdict(name, f"x {text} y").sensitive is sensitive


@pytest.mark.parametrize(("name", "text"), [("phone", "+1 555 0100 100"), ("iban", "GB33BUKB2020155555555A"), ("credit-card", "4111111111111112")])
def test_invalid_values(name, text):
    assert verdict(name, f"x {text} y") is None


def test_normalize_keeps_joiners():
    assert normalize("می‌خواهم")[0] == "می‌خواهم" and normalize("x‌y")[0] == "xy"
    assert normalize("👩‍💻 a‍b")[0] == "👩‍💻 ab" and normalize("«a» –")[0] == "«a» -"


def test_hints_hide_no_match():
    rng = random.Random(2)
    values = ["4111111111111111", "joe@acme.io", "GB33BUKB20201555555555", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abcDEF", "DEUTDEFF", "10 Downing Street", "00:1A:2b:3c:4d:5e", "Ag: 1234", "x" * 30, "word", "Bağdat Caddesi"]
    active = [(re.compile(d.pattern, d.flags), d) for d in detectors()]
    blind = [(p, dataclasses.replace(d, hint="")) for p, d in active]
    key = lambda c: (c["start"], c["end"], c["detector_id"])
    for _ in range(200):
        text = "".join(rng.choice(values) + rng.choice([" ", "\n", "\n\n", "\n"]) for _ in range(8))
        assert sorted(map(key, scan(text, active))) == sorted(map(key, scan(text, blind)))


def test_percentiles_gates_and_contributors(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", 7.0), ("b", None)], "k string, v double")
    assert [tuple(r) for r in decide.percentiles(df, ["k"], "v").orderBy("k").collect()] == [("a", 50.0, 95.0, 99.0), ("b", 7.0, 7.0, 7.0)]
    metrics = spark.createDataFrame([("EMAIL", 0.99, 1.0), ("PHONE", 0.5, 1.0)], "type string, precision double, recall double")
    assert {r["type"]: r["passed"] for r in decide.gates(metrics, {"EMAIL": (0.9, 0.9), "PHONE": (0.9, 0.9), "IBAN": (0.5, 0.5)}, "type").collect()} == {"EMAIL": True, "PHONE": False, "IBAN": False}
    found = spark.createDataFrame([(1, "EMAIL", 0.9), (1, "PHONE", 0.9), (1, "API_KEY", 0.9)], "doc_id long, type string, raw_conf double")
    assert [r["type"] for r in decide.top_contributors(found, most=2).orderBy("place").collect()] == ["API_KEY", "EMAIL"]


def test_calibration_pools_violators(spark):
    df = spark.createDataFrame([(0.05, 1), (0.15, 0), (0.95, 1)], "s double, ok int")
    assert [round(p, 2) for _, p, _ in decide.fit_calibration(df, "s", "ok")] == [0.5, 1.0]


def test_restorer_holds_back_split_tokens():
    vault = {"[EMAIL_1]": "joe@acme.io", "[EMAIL_10]": "x@y.io"}
    text = "a [EMAIL_1] b [EMAIL_10] [EMA c"
    for k in range(1, 7):
        r = Restorer(vault)
        assert "".join(r.push(text[i : i + k]) for i in range(0, len(text), k)) + r.finish() == restore(text, vault)


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def against_sql(spark, tmp_path, name, **tables):
    """The rows of a query and those of its SQL, over tables given as DataFrames."""
    import duckdb

    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()]
    return sorted(got, key=repr), sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall(), key=repr)


def test_scan_card_equals_its_sql_on_odd_numbers(spark, tmp_path):
    rng = random.Random(4)
    prefixes = "2200 2221 2720 2721 3095 30 34 35 36 4 401178 50 51 57 6 60 62 65 81 9792 1".split()

    def number():
        s = rng.choice(prefixes)
        s += "".join(rng.choice("0123456789") for _ in range(rng.randint(11, 18) - len(s)))
        s = next(s + c for c in "0123456789" if checks.luhn(s + c))
        return rng.choice(["", " ", "-", "–"]).join(s[i : i + 4] for i in range(0, len(s), 4))

    odd = ["", "é", "日", "x", "_", ".", ".5", "-", "-7", "​", " ", "１", "١", "\n", "\r\n"]
    texts = [rng.choice(odd) + number() + rng.choice(odd) + " " + number() for _ in range(1500)] + ["6" * 40, "", None, "4222222222222", "4222222222222 4222222222222"]
    df = spark.createDataFrame([(i // 2 if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got, want = against_sql(spark, tmp_path, "scan_card", documents=df)
    assert len(want) > 500 and got == want


def test_span_islands_equals_its_sql_on_null_dates(spark, tmp_path):
    # an order's dates differ, as the SQL leaves open which of two equal spans comes first, and so which one is fresh
    rng = random.Random(6)
    dates = ["1991-12-30", *(f"1995-0{m}-{d}" for m in (1, 2, 3) for d in (10, 20, 28))]
    rows = [(k, d) for k in (None, *range(60)) for d in rng.sample(dates, rng.randint(0, 8)) + [None] * rng.randint(0, 4)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_shipdate string").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    got, want = against_sql(spark, tmp_path, "span_islands", lineitem=df)
    assert len([r for r in want if r[1] is None]) > 20 and got == want


def test_islands_of_equal_spans(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 9, 12), (1, 9, 12), (1, 11, 20), (2, None, None), (2, None, None), (2, 9, 12)], "k int, start int, end int")
    got = sorted(map(tuple, spans.islands(df, ["k"]).collect()), key=repr)
    assert got == sorted([(1, 0, 5, 1), (1, 9, 20, 3), (2, None, None, 1), (2, None, None, 1), (2, 9, 12, 1)], key=repr)
