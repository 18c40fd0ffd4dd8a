"""Span algebra: overlap joins, islands, coverage holes, and the resolution of overlapping candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.taxonomy import SPECIFICITY


def overlaps(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of spans of one document that overlap: an equi join on the document with the interval condition on top."""
    x, y = a.alias("x"), b.alias("y")
    return x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end")))


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of overlapping spans: keys, start, end, n. A span with a null start or end overlaps none and is a run."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(F.col("start") < before, 0).otherwise(1))
    numbered = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("__island")


def coverage_holes(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans of before that no span of after covers; resolution must leave none."""
    x, y = before.alias("x"), after.alias("y")
    covered = (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("y.start") <= F.col("x.start")) & (F.col("x.end") <= F.col("y.end"))
    return x.join(y, covered, "left_anti")


def resolved(candidates: Column, text: Column | None = None) -> Column:
    """The disjoint winners of an array of candidates, in document order; an expression, so no shuffle.

    Order: sensitive first, wider, more specific, surer, earlier, detector id. A candidate that overlaps no winner is one.
    A sensitive one that sticks out of the winners that it overlaps makes one winner of them all, the first by order, over
    the union of their spans; it touches no other winner, so winners stay disjoint. Any other overlapping one is dropped.
    With text, the text of a widened winner is read anew from it; its canonical form is none.
    """
    rank = F.create_map(*[x for t, r in SPECIFICITY.items() for x in (F.lit(t), F.lit(r))])
    ordered = F.sort_array(F.transform(candidates, lambda c: F.struct((~c["sensitive"]).alias("a"), (c["start"] - c["end"]).alias("b"), F.coalesce(F.try_element_at(rank, c["type"]), F.lit(8)).alias("s"), (-c["raw_conf"]).alias("d"), c["start"].alias("e"), c["detector_id"].alias("f"), c["end"].alias("end"), c["type"].alias("type"), c["text"].alias("text"), c["canonical"].alias("canonical"), c["sensitive"].alias("sensitive"))))
    slim = F.transform(ordered, lambda c, i: F.struct(i.alias("nth"), c["e"].alias("start"), c["end"].alias("end"), c["type"].alias("type"), (-c["d"]).alias("raw_conf"), c["f"].alias("detector_id"), c["sensitive"].alias("sensitive"), c["text"].alias("text"), c["canonical"].alias("canonical"), F.lit(False).alias("wider")))
    meet = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])

    def keep(kept: Column, c: Column) -> Column:
        def joined(hits: Column) -> Column:
            first = F.array_min(hits)
            low, high = F.least(F.array_min(F.transform(hits, lambda k: k["start"])), c["start"]), F.greatest(F.array_max(F.transform(hits, lambda k: k["end"])), c["end"])
            union = first.withField("start", low).withField("end", high).withField("wider", F.lit(True))
            sticks_out = F.forall(hits, lambda k: (c["start"] < k["start"]) | (k["end"] < c["end"]))
            return F.when(F.size(hits) == 0, F.concat(kept, F.array(c))).when(c["sensitive"] & sticks_out, F.concat(F.filter(kept, lambda k: ~meet(k, c)), F.array(union))).otherwise(kept)

        return F.get(F.transform(F.array(F.filter(kept, lambda k: meet(k, c))), joined), F.lit(0))

    winners = F.aggregate(slim, F.slice(slim, 1, 0), keep)
    reread = (lambda k: F.when(k["wider"], F.substring(text, k["start"] + 1, k["end"] - k["start"])).otherwise(k["text"])) if text is not None else (lambda k: F.when(~k["wider"], k["text"]))
    return F.sort_array(F.transform(winners, lambda k: F.struct(k["start"].alias("start"), k["end"].alias("end"), k["type"].alias("type"), k["raw_conf"].alias("raw_conf"), k["detector_id"].alias("detector_id"), k["sensitive"].alias("sensitive"), reread(k).alias("text"), F.when(~k["wider"], k["canonical"]).alias("canonical"))))


def segments(text: Column, spans: Column) -> Column:
    """text and entity pieces that alternate and join to text; spans are disjoint and in order."""
    piece = lambda kind, a, b: F.struct(kind.alias("type"), a.alias("start"), b.alias("end"), F.substring(text, a + 1, b - a).alias("text"))
    none, zero = F.lit(None).cast("string"), F.lit(0)
    before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], zero)
    parts = F.flatten(F.transform(spans, lambda s, i: F.array(piece(none, before(i), s["start"]), piece(s["type"], s["start"], s["end"]))))
    last = piece(none, F.coalesce(F.get(spans, F.size(spans) - 1)["end"], zero), F.length(text))
    return F.filter(F.concat(parts, F.array(last)), lambda x: x["start"] < x["end"])


def overlapping(spans: Column) -> Column:
    """Whether any span of an array begins before an earlier one ends."""
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.exists(F.transform(by_start, lambda s, i: F.coalesce(s["start"] < F.get(by_start, i - 1)["end"], F.lit(False))), lambda x: x)
