import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions.keccak import keccak256
from veilframe.operators import detect
from veilframe.operators.catalog import CATALOG, detectors
from veilframe.operators.context import LEXICON, Triggers, format_of, near_any, scored, structure_index, with_slots
from veilframe.plans.protect import protect

VALID = {
    "eu-vat": ["ATU13585627", "DE136695976", "FR40303265045", "IT00743110157", "NL004495445B01", "PL8567346215", "BE0428759497", "DK13585628", "LU15027442", "PT501964843", "SE556188840401", "FI20774740", "EL094259216", "CZ25123891", "HU12892312", "LV40003521600", "MT11679112", "RO18547290", "HR33392005961", "CY10259033P"],
    "national-id-it-codice-fiscale": ["RSSMRA85T10A562S"], "national-id-hk-hkid": ["A123456(3)"], "national-id-tw": ["A123456789"], "national-id-mx-curp": ["BOXW310820HNERXN09"], "national-id-nz-ird": ["49-098-576"],
    "national-id-es-cif": ["A58818501"], "national-id-cz-rodne-cislo": ["710319/2745"], "crypto-eth": ["0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"], "street-address": ["10 Downing Street", "12 rue de la Paix", "Hauptstraße 5"],
    "crypto-xmr": ["44AFFq5kSiGBoZ4NMDwYtN18obc8AemS33DBLWs3H7otXft3XjrpDtQGv7SqSsaBYBb98uNbr2VBBEt7f2wfn3RVGQBEP3A"], "postal-code": ["SW1A 1AA", "75008"], "ca-transit-number": ["12345-003"], "drivers-license": ["MORGA657054SM9IJ", "A1234567"],
}


def hit(name, text):
    d = CATALOG[name]
    return any(d.validate(m) for m in re.finditer(d.pattern, text, d.flags))


@pytest.mark.parametrize("name", VALID)
def test_more_detectors(name):
    assert all(hit(name, f"x {v} y") for v in VALID[name])


@pytest.mark.parametrize("text", ["x DE136695977 y", "x RSSMRA85T10A562T y", "x 0x5AAeb6053F3E94C9b9A09f33669435E7Ef1BeAed y", "x A123457(3) y"])
def test_more_detectors_reject(text):
    assert not any(hit(n, text) for n in ("eu-vat", "national-id-it-codice-fiscale", "crypto-eth", "national-id-hk-hkid"))


def test_keccak_known_answers():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"


@pytest.mark.parametrize(
    ("text", "key", "value"),
    [
        ('{"a": 1, "ssn":"123"}', "ssn", "123"), ("export API_KEY=abc", "API_KEY", "abc"), ("Name: Joe Doe", "Name", "Joe Doe"), ("curl -H 'X-Token: abc'", "X-Token", "abc"), ("run --api-token=abc", "api-token", "abc"),
        ('c.setApiKey("abc")', "ApiKey", "abc"), ("| a | iban |\n|---|---|\n| x | GB1 |", "iban", "GB1"), ('a,b\n"x,y",z', "b", "z"), ("key: |\n  body", "key", "body"), ("machine h login me password abc", "password", "abc"), ("@@ -1 +1 @@\n+KEY=abc", "KEY", "abc"), ("电话：123", "电话", "123"),
    ],
)
def test_structure_index(text, key, value):
    assert any(s.key == key and text[s.start : s.end] == value for s in structure_index(text))


def judged(text):
    triggers = Triggers(LEXICON)
    active = [(re.compile(d.pattern, d.flags), d) for d in detectors()]
    return {c["type"]: c for c in scored(text, detect.scan(text, active, near_any(text, triggers)), triggers)}


def test_context_scoring():
    assert judged("ssn: 536-90-4399")["NATIONAL_ID"]["raw_conf"] == 1.0
    assert judged("order no 536-90-4399")["NATIONAL_ID"]["raw_conf"] == pytest.approx(0.4)
    assert judged("for example 536-90-4399")["NATIONAL_ID"]["raw_conf"] == pytest.approx(0.35)
    assert judged("see q8Zr1Xv9Lm2Kt7Wb4Np6Sd3F now")["GENERIC_SECRET"]["metadata"]["suppressed"] == "unexplained-secret"
    assert judged("API_TOKEN=q8Zr1Xv9Lm2Kt7Wb4Np6Sd3F")["GENERIC_SECRET"]["raw_conf"] > 0.6
    assert judged("zip 10115")["POSTAL_CODE"]["raw_conf"] > 0.6 > 0.31 > judged("about 10115 sheep")["POSTAL_CODE"]["raw_conf"]
    assert judged("run 10115/4 zip")["POSTAL_CODE"]["metadata"]["suppressed"] == "fragment-boundary"


def test_format():
    assert [format_of(t) for t in ("", "a b", "| a |\n| b |", '{"a": 1}', "a: 1\nb: 2", "2024-01-01T10:00:00 x", "From: a\nTo: b\nhello", "int a;\nint b;")] == ["unknown", "prose", "markdown-table", "json", "yaml", "log", "email", "code"]


def test_slots_and_protect_with_context(spark):
    df = spark.createDataFrame([(0, "token: q8Zr1Xv9Lm2Kt7Wb4Np6Sd3F"), (1, None), (2, "see q8Zr1Xv9Lm2Kt7Wb4Np6Sd3F")], "doc_id long, text string")
    assert [len(r["slots"]) for r in with_slots(df).orderBy("doc_id").collect()] == [1, 0, 0]
    out = protect(df).orderBy("doc_id").select("masked_text", F.size("leaked").alias("n")).collect()
    assert [r["masked_text"] for r in out] == ["token: [GENERIC_SECRET_1]", "", "see q8Zr1Xv9Lm2Kt7Wb4Np6Sd3F"] and not any(r["n"] for r in out)
