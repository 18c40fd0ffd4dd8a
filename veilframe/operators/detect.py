"""Candidate spans: every active detector over every text in one Arrow kernel, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import normalize
from veilframe.operators import catalog_more  # noqa: F401  registers more detectors
from veilframe.operators.catalog import LOW, DetectorSpec, detectors
from veilframe.operators.context import Triggers, near_any, scored

SCHEMA = "text string, type string, start int, end int, raw_conf double, detector_id string, sensitive boolean, canonical string, validator string, metadata map<string,string>"
FIELDS = [x.split(" ", 1)[0] for x in SCHEMA.split(", ")]
KIND = f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in SCHEMA.split(', '))}>>"


def lines_near(text: str, hint: str) -> list[tuple[int, int]]:
    """The stretches of text that a detector must read: lines that match hint, with the lines before and after them."""
    search, out, at = hints(hint).search, [], 0
    while m := search(text, at):
        first = text.rfind("\n", 0, m.start())
        first = text.rfind("\n", 0, first) + 1 if first > 0 else 0
        line_end = text.find("\n", m.end())
        end = len(text) if line_end < 0 else e if (e := text.find("\n", line_end + 1)) >= 0 else len(text)
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
        if line_end < 0:
            break
        at = line_end + 1
    return out


HINTS: dict[str, re.Pattern] = {}


def hints(pattern: str) -> re.Pattern:
    if pattern not in HINTS:
        HINTS[pattern] = re.compile(pattern)
    return HINTS[pattern]


def matches(folded: str, active: Iterable[tuple[re.Pattern, DetectorSpec]]) -> Iterator[tuple[DetectorSpec, re.Match]]:
    """Matches of each detector, in order; a detector with a hint reads only the lines near one."""
    near: dict[str, list[tuple[int, int]]] = {}
    for pattern, spec in active:
        if not spec.hint:
            yield from ((spec, m) for m in pattern.finditer(folded))
            continue
        places = near.get(spec.hint)
        if places is None:
            places = near[spec.hint] = lines_near(folded, spec.hint)
        for a, b in places:
            yield from ((spec, m) for m in pattern.finditer(folded, a, b))


def scan(text: str, active: Iterable[tuple[re.Pattern, DetectorSpec]], near: Callable[[int, int], bool] | None = None, fold: bool = True) -> list[dict]:
    """Candidates of one text; offsets are code points of the original text. A failing validator fails the job.

    Detectors that need context are capped to LOW unless near(start, end) finds some. Without fold, detectors read the
    text as written.
    """
    folded, at = normalize(text) if fold else (text, None)
    out = []
    for spec, m in matches(folded, active):
        if m.end() == m.start() or (v := spec.validate(m)) is None:
            continue
        a, b = v.span or m.span()
        conf = min(1.0, max(0.0, spec.confidence if v.confidence is None else v.confidence))
        a, b = (a, b) if at is None else (at[a], at[b])
        out.append({"text": text[a:b], "type": spec.entity_type, "start": a, "end": b, "raw_conf": min(conf, LOW) if spec.requires_context and not (near and near(a, b)) else conf, "detector_id": spec.id, "sensitive": v.sensitive, "canonical": v.canonical, "validator": v.validator, "metadata": v.metadata})
    return out


def candidate_spans(text: Column, region: str | None = None, types: set[str] | None = None, specs: list[DetectorSpec] | None = None, lexicon: dict | None = None, fold: bool = True) -> Column:
    """The candidates of a text column, an array of structs; only the texts go to Python. A null text has none.

    With a lexicon, raw_conf is the confidence after the evidence around each candidate, and 0 for a suppressed one.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    chosen = specs if specs is not None else detectors(region, types)
    arrow = to_arrow_type(_parse_datatype_string(KIND))

    @F.arrow_udf(KIND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        active = [(re.compile(d.pattern, d.flags), d) for d in chosen]
        triggers = Triggers(lexicon) if lexicon else None

        def of(t: str) -> list[dict]:
            return scored(t, scan(t, active, near_any(t, triggers), fold), triggers) if triggers else scan(t, active, fold=fold)

        for texts in batches:
            rows = [[c | {"metadata": list(c["metadata"].items())} for c in of(t)] if t else [] for t in texts.to_pylist()]
            yield pa.array(rows, type=arrow)

    return found(text)


def with_candidates(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """df with candidates, nested on the row so that later steps need no shuffle; replaces a column of that name."""
    return df.withColumn("candidates", candidate_spans(F.col(text), **options))


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per candidate."""
    nested = with_candidates(df.select(key, text), text, **options)
    return nested.select(key, F.explode("candidates").alias("c")).select(key, "c.*")
