"""The whole pass over a table: candidates, resolution, decision, masking, exposure; one scan and no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.context import LEXICON
from veilframe.operators.decide import band, calibrated, decision, points
from veilframe.operators.detect import candidate_spans
from veilframe.operators.masking import leaks, masked, with_tokens
from veilframe.operators.recognize import Classifier, recognized_spans
from veilframe.operators.spans import resolved
from veilframe.operators.surrogates import with_surrogates
from veilframe.operators.taxonomy import PROFILES

#: What a pass adds; columns of these names in the input are replaced.
ADDED = ("entities", "tokens", "masked_text", "exposure_score", "exposure_band", "leaked")


def protect(df: DataFrame, text: str = "text", profile: str | dict[str, float] = "balanced", region: str | None = None, allow: list[str] = (), deny: list[str] = (), lexicon: dict | None = LEXICON, mode: str = "token", seed: int = 0, curves: dict[str, list[tuple[float, float]]] | None = None, recognizer: tuple[Callable[[], Classifier], str] | None = None) -> DataFrame:
    """df with entities, masked_text, tokens, leaked, exposure_score and exposure_band; mode is token or surrogate.

    curves are calibration bins by type (see decide.calibrate); entities are judged by the calibrated confidence.
    recognizer is (loader, id) of a token classifier whose names are candidates too. A null text is read as empty.
    """
    limits = PROFILES[profile] if isinstance(profile, str) else profile
    whole = F.coalesce(F.col(text), F.lit(""))

    def reported(c: Column) -> Column:
        return decision(c["type"], c["text"], c["raw_conf"], limits, allow, deny).isin("deny-list", "report")

    def judged(found: Column) -> Column:
        sensitive = F.filter(found, lambda c: c["sensitive"] & (c["raw_conf"] > 0))
        return F.transform(sensitive, lambda c: c.withField("raw_conf", calibrated(c["type"], c["raw_conf"], curves))) if curves else sensitive

    found = candidate_spans(F.col(text), region=region, lexicon=lexicon)
    found = F.concat(found, recognized_spans(F.col(text), *recognizer)) if recognizer else found
    out = df.drop(*[c for c in ADDED if c != text]).withColumn("entities", found)
    out = out.withColumn("entities", F.filter(resolved(judged(F.col("entities")), whole), reported))
    out = with_surrogates(out, text, seed=seed) if mode == "surrogate" else out.withColumn("tokens", with_tokens(F.col("entities"), whole))
    out = out.withColumn("masked_text", masked(whole, F.col("tokens")))
    total = F.aggregate(F.transform("entities", lambda e: points(e["type"], e["raw_conf"])), F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("exposure_score", F.round(100 * (1 - F.exp(-total / 100)), 4))
    return out.withColumns({"exposure_band": band(F.col("exposure_score")), "leaked": leaks(F.col("masked_text"), F.col("tokens"))})
