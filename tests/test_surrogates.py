import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.operators.catalog import CATALOG
from veilframe.operators.masking import restored
from veilframe.operators.surrogates import surrogate
from veilframe.plans.protect import protect

VALUES = {
    "iban": "GB33BUKB20201555555555", "credit-card": "5500005555555559", "national-id-es-dni": "12345678Z", "national-id-br-cpf": "529.982.247-25", "vin": "1M8GDM9AXKP042788", "national-id-pl-pesel": "44051401359", "eu-vat": "DE136695976",
    "national-id-it-codice-fiscale": "RSSMRA85T10A562S", "crypto-btc": "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "crypto-eth": "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", "email": "joe@acme.io", "ip-v4": "8.8.4.4", "ip-v6": "2a00:1450::1", "swift-bic": "DEUTDEFF500",
}


@pytest.mark.parametrize("name", VALUES)
def test_surrogates_pass_their_detector(name):
    d, text = CATALOG[name], VALUES[name]
    made = surrogate(d.entity_type, name, text, random.Random(1))
    assert made and made != text and made == surrogate(d.entity_type, name, text, random.Random(1))
    assert any(m.span() == (0, len(made)) and d.validate(m) for m in re.finditer(d.pattern, made, d.flags))


def test_protect_with_surrogates_restores(spark):
    texts = ["mail joe@acme.io or joe@acme.io, card 5500005555555559, iban GB82 WEST 1234 5698 7654 32", "", None, "eth 0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed é 😀 DE136695976"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = protect(df, profile="strict", mode="surrogate").withColumn("back", restored(F.col("masked_text"), F.col("tokens"))).orderBy("doc_id").collect()
    assert [r["back"] for r in out] == [t or "" for t in texts]
    assert "joe@" not in out[0]["masked_text"] and len({t["token"] for t in out[0]["tokens"] if t["type"] == "EMAIL"}) == 1 and not any(r["leaked"] for r in out)
