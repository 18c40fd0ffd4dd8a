"""Functions for SQL: spans and masked texts of the catalogue, Arrow-batched."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from veilframe.operators.catalog import detectors
from veilframe.operators.context import LEXICON, Triggers, near_any, scored
from veilframe.operators.detect import scan

SPAN = "array<struct<type: string, start: int, end: int, text: string, conf: double, sensitive: boolean, detector_id: string>>"


def register(spark: SparkSession, prefix: str = "pii_", region: str | None = None, lexicon: dict | None = LEXICON) -> list[str]:
    """Registers <prefix>scan(text), the spans in order of start, and <prefix>types(text), their distinct types.

    A null text has no spans. Returns the names.
    """
    chosen = detectors(region)

    def spans_of(texts: pd.Series) -> list[list[dict]]:
        active, triggers = [(re.compile(d.pattern, d.flags), d) for d in chosen], Triggers(lexicon or {})
        out = []
        for t in texts:
            found = scored(t, scan(t, active, near_any(t, triggers)), triggers, False) if t else []
            kept = [c for c in found if c["raw_conf"] > 0]
            out.append([{"type": c["type"], "start": c["start"], "end": c["end"], "text": c["text"], "conf": c["raw_conf"], "sensitive": c["sensitive"], "detector_id": c["detector_id"]} for c in sorted(kept, key=lambda c: (c["start"], -c["end"], c["detector_id"]))])
        return out

    @pandas_udf(SPAN)
    def scan_text(texts: pd.Series) -> pd.Series:
        return pd.Series(spans_of(texts))

    @pandas_udf("array<string>")
    def types_of(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({s["type"] for s in spans if s["sensitive"]}) for spans in spans_of(texts)])

    spark.udf.register(f"{prefix}scan", scan_text)
    spark.udf.register(f"{prefix}types", types_of)
    return [f"{prefix}scan", f"{prefix}types"]
