"""Names by an injected token classifier: overlapping windows, pieces back to offsets, labels to spans, in one Arrow kernel.

A classifier maps a window's text to (piece, label, score) rows in reading order. Labels are B-X and I-X, or O. A window
owns the spans whose middle lies in its core, so each span is given once.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.text import normalize
from veilframe.operators.detect import KIND

Prediction = tuple[str, str, float]
Classifier = Callable[[str], Iterable[Prediction]]
# Types of label names, sizes of windows, how far ahead a piece is looked for, remembered windows, unknown pieces.
TYPE_OF = {"PER": "PERSON", "PERSON": "PERSON", "ORG": "ORG", "LOC": "LOCATION", "LOCATION": "LOCATION", "GPE": "LOCATION"}
WINDOW, OVERLAP, LOOKBACK, AHEAD, REMEMBERED = 400, 96, 80, 24, 256
UNKNOWN = ("[UNK]", "<unk>")


def windows(text: str, most: int = WINDOW, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, core start, core end) of windows of at most `most` characters that end after a space, if one is near."""
    if most <= 2 * overlap:
        raise ValueError(f"windows of {most} characters cannot overlap by {overlap}")
    a = 0
    while a + most < len(text):
        low, b = max(a + most - LOOKBACK, a + overlap), a + most
        spaces = [m.end() for m in re.finditer(r"\s", text[low:b])]
        b = low + spaces[-1] if spaces else b
        yield a, b, a + overlap // 2 if a else 0, b - overlap // 2
        a = b - overlap
    yield a, len(text), a + overlap // 2 if a else 0, len(text)


def located(text: str, pieces: Iterable[str]) -> Iterator[tuple[int, int] | None]:
    """Where each piece stands, read from left to right; None for a piece that isn't near."""
    at = 0
    for piece in pieces:
        plain = piece.removeprefix("##").removeprefix("▁")
        begin = at + re.compile(r"\s*").match(text, at).end() - at
        found = text.find(plain, begin, begin + AHEAD + len(plain)) if plain and piece not in UNKNOWN else -1
        if found < 0:
            yield None
        else:
            at = found + len(plain)
            yield found, at


@dataclass
class Run:
    """Tokens of one name: where they stand, and their scores."""

    kind: str
    places: list[tuple[int, int]] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)


def names(text: str, predictions: Iterable[Prediction]) -> list[tuple[int, int, str, float]]:
    """(start, end, type, least score of its tokens) of names; I-X after another type begins one, unknown pieces are bridged."""
    rows = list(predictions)
    runs: list[Run | None] = []
    for (_, label, score), place in zip(rows, located(text, (r[0] for r in rows))):
        mark, _, name = label.rpartition("-")
        kind = TYPE_OF.get(name.upper()) if mark in ("B", "I") else None
        last = runs[-1] if runs else None
        if kind is None:
            runs.append(None)
            continue
        if last is None or last.kind != kind or mark == "B":
            runs.append(last := Run(kind))
        last.scores.append(score)
        if place:
            last.places.append(place)
    out = []
    for r in runs:
        if r and r.places:
            a, b = r.places[0][0], r.places[-1][1]
            whole = text[a:b]
            a, b = a + len(whole) - len(whole.lstrip()), b - len(whole) + len(whole.rstrip())
            if a < b:
                out.append((a, b, r.kind, min(r.scores)))
    return out


def recognized(text: str, classify: Callable[[str], list[tuple[int, int, str, float]]], most: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int, str, float]]:
    """The names of a whole text, by start; classify gives the names of a window in its own offsets."""
    out = []
    for a, b, low, high in windows(text, most, overlap):
        out += [(a + x, a + y, kind, score) for x, y, kind, score in classify(text[a:b]) if 2 * low <= 2 * a + x + y < 2 * high]
    return sorted(out)


def recognized_spans(text: Column, model: Callable[[], Classifier], model_id: str, most: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Names of a text column as an array like that of candidate_spans, so that both are concatenated without a shuffle.

    model() loads the classifier once in each worker. The windows last seen are remembered. A null or empty text has none.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(KIND))

    @F.arrow_udf(KIND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = model()
        remembered = functools.lru_cache(REMEMBERED)(lambda window: names(window, classifier(window)))

        def of(t: str) -> Iterator[dict]:
            folded, at = normalize(t)
            for x, y, kind, score in recognized(folded, remembered, most, overlap):
                a, b = (x, y) if at is None else (at[x], at[y])
                yield {"text": t[a:b], "type": kind, "start": a, "end": b, "raw_conf": score, "detector_id": f"ner:{model_id}", "sensitive": True, "canonical": " ".join(folded[x:y].split()), "validator": None, "metadata": [("model", model_id)]}

        for texts in batches:
            yield pa.array([list(of(t)) if t else [] for t in texts.to_pylist()], type=arrow)

    return found(text)
