"""URL filters: list rules, and the ratio of two character language models where no rule fits.

Smoothed variable-order Markov models (Witten-Bell interpolation of all orders up to ORDER) are counted over all URLs
that an allow rule or a block rule decides. A URL without a rule gets the difference of the two log-likelihoods per
character; the threshold is calibrated on a quarter of the decided URLs that the models do not count.

All counts are kept. A character's difference depends on its window of ORDER + 1 characters alone, so the differences of
the distinct windows are made by joins with the count table, order by order. Those of the MOST_WINDOWS most frequent
windows go to the tasks; all others are joined with the URLs that hold them.

Defined cases: a null url, or one without "://", has empty host and path and no rule; an empty string scores 0; very long
urls are read whole; of rules of one length that fit, the first by name decides; of thresholds that part the calibration
urls equally well, the one nearest 0 is taken; with no
decided URLs of one verdict the models are empty, every difference is 0 and the threshold 0 allows; repeated rows count
as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import map_text, materialize

ORDER = 4
#: The differences of so many windows go to the tasks; URLs with other windows are joined with theirs.
MOST_WINDOWS = 150_000
#: Differences are summed as whole numbers of 2**-40 bits, so that sums do not depend on order.
UNIT = 2.0**40
#: Calibration bins of the per-character difference, between -RANGE and RANGE.
BINS, RANGE = 400, 4.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START = "\x02"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(df: DataFrame, rules: list[tuple[str, str]], keys: list[str], url: str = "url") -> DataFrame:
    """keys, host, path, rule and its verdict; rules: (verdict, host/path) pairs, a bounded list; the longest that fits wins."""
    host, path = host_and_path(F.col(url))
    out = df.select(*keys, host.alias("host"), path.alias("path"))
    rule = verdict = None
    for v, name in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
        h, slash, p = name.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(slash + p)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return out.withColumns({"rule": none if rule is None else rule, "ruled": none if verdict is None else verdict})


def count_grams(texts: list[str], order: int = ORDER) -> Counter:
    """Counts of (context, character) as context + character, for all orders."""
    found: Counter = Counter()
    for t in texts:
        padded = START * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                found[padded[i - k : i + 1]] += 1
    return found


def grams(df: DataFrame, order: int = ORDER) -> DataFrame:
    """(label, gram, n) over all rows of df (label, name): counted in each batch, then summed by one shuffle."""

    def run(batches):
        for b in batches:
            labels, names = b.column(0).to_pylist(), b.column(1).to_pylist()
            for label in sorted(set(labels)):
                c = count_grams([n for n, x in zip(names, labels) if x == label], order)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["label", "gram", "n"])

    return df.mapInArrow(run, "label string, gram string, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Witten-Bell: p(c|ctx) = (n(ctx c) + d(ctx) p(c|shorter ctx)) / (n(ctx) + d(ctx)), down to uniform over 256."""

    def __init__(self, counts: dict[str, int], order: int = ORDER):
        self.order, self.n = order, counts
        self.total, self.kinds = Counter(), Counter()
        for g, k in counts.items():
            self.total[g[:-1]] += k
            self.kinds[g[:-1]] += 1

    def log2(self, text: str) -> float:
        padded, out, o = START * self.order + text, 0.0, self.order
        for i in range(o, len(padded)):
            p = 1 / 256
            for k in range(o + 1):
                ctx = padded[i - k : i]
                t = self.total.get(ctx)
                if t is None:
                    break
                d = self.kinds[ctx]
                p = (self.n.get(padded[i - k : i + 1], 0) + d * p) / (t + d)
            out += math.log2(p)
        return out


def difference(allow: CharModel, block: CharModel, text: str) -> float:
    """Accepted minus rejected log-likelihood, in bits per character."""
    return (allow.log2(text) - block.log2(text)) / len(text) if text else 0.0


def windows(names: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, c): the windows of order + 1 characters of all names."""

    def run(batches):
        for b in batches:
            c: Counter = Counter()
            for t in b.column(0).to_pylist():
                padded = START * order + t
                c.update(padded[i : i + order + 1] for i in range(len(t)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["gram", "c"])

    return names.mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def window_differences(counts: DataFrame, found: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, c, units) of all windows found: log2 p(allow) - log2 p(block) of the last character, as CharModel has it."""
    labels = ("allow", "block")
    wanted = [found.select("gram")]
    for _ in range(order):
        wanted.insert(0, wanted[0].select(F.expr("substring(gram, 2)").alias("gram")).distinct())
    lower = None
    for k, need in enumerate(wanted):
        n = counts.where(F.length("gram") == k + 1).groupBy("gram").agg(*[F.sum(F.when(F.col("label") == x, F.col("n"))).alias(f"n_{x}") for x in labels])
        ctx = n.groupBy(F.substring("gram", 1, k).alias("ctx")).agg(*[f(f"n_{x}").alias(f"{name}_{x}") for x in labels for f, name in ((F.sum, "t"), (F.count, "d"))])
        out = need.join(n, "gram", "left").withColumn("ctx", F.substring("gram", 1, k)).join(ctx, "ctx", "left")
        if lower is not None:
            out = out.withColumn("shorter", F.expr("substring(gram, 2)")).join(lower, "shorter")
        p = []
        for x in labels:
            below = F.lit(1 / 256) if lower is None else F.col(f"p_{x}")
            t, d = F.col(f"t_{x}"), F.col(f"d_{x}")
            p.append(F.when(t.isNull(), below).otherwise((F.coalesce(f"n_{x}", F.lit(0)) + d * below) / (t + d)).alias(f"p_{x}"))
        out = out.select("gram", *p)
        lower = out.withColumnRenamed("gram", "shorter")
    units = F.round((F.log2("p_allow") - F.log2("p_block")) * UNIT).cast("long")
    return found.join(out.select("gram", units.alias("units")), "gram")


def frequent_windows(table: DataFrame, most: int = MOST_WINDOWS) -> dict[str, int]:
    """The units of at most `most` frequent windows; a histogram of counts tells the least count, so tasks send no more."""
    by_step = table.groupBy(F.floor(F.log2("c") * 16).alias("step")).count().collect()  # at most about 1000 rows
    left, least = most, 0
    for r in sorted(by_step, key=lambda r: -r["step"]):
        left -= r["count"]
        if left < 0:
            least = r["step"] + 1
            break
    got = table.where(F.floor(F.log2("c") * 16) >= least).select("gram", "units").toArrow()
    return dict(zip(got["gram"].to_pylist(), got["units"].to_pylist()))


def scored(df: DataFrame, keys: list[str], table: DataFrame, order: int = ORDER) -> DataFrame:
    """keys and difference, one row per row of df; table has every window of df."""
    known = frequent_windows(table)
    shared = df.sparkSession.sparkContext.broadcast(known)

    def factory():
        held, part, row = shared.value, TaskContext.get().partitionId(), count()

        def kernel(names):
            out = {"uid": [part << 40 | next(row) for _ in names], "units": [], "length": list(map(len, names)), "rest": []}
            for t in names:
                padded, total, rest = START * order + t, 0, []
                for i in range(len(t)):
                    w = padded[i : i + order + 1]
                    x = held.get(w)
                    if x is None:
                        rest.append(w)
                    else:
                        total += x
                out["units"].append(total)
                out["rest"].append(rest)
            return out

        return kernel

    out = map_text(df.withColumn("__name", F.concat("host", "path")), factory, "uid long, units long, length int, rest array<string>", keys, "__name")
    units = F.col("units")
    if table.count() > len(known):
        out = materialize(out, "url-rows")
        rest = out.select("uid", F.explode("rest").alias("gram")).join(table.select("gram", F.col("units").alias("more")), "gram")
        out = out.drop("rest").join(rest.groupBy("uid").agg(F.sum("more").alias("more")), "uid", "left")
        units = units + F.coalesce("more", F.lit(0))
    return out.select(*keys, F.when(F.col("length") > 0, units / UNIT / F.col("length")).otherwise(0.0).alias("difference"))


def url_filter(df: DataFrame, rules: list[tuple[str, str]], keys: list[str] | None = None, url: str = "url") -> DataFrame:
    """keys, host, path, rule, verdict and difference, one row per row of df."""
    keys = keys or ["page_id"]
    rows = ruled(df, rules, keys, url)
    decided = rows.where(F.col("ruled").isNotNull()).select(F.col("ruled").alias("label"), F.concat("host", "path").alias("name"))
    fold = F.pmod(F.xxhash64("name"), F.lit(4))
    counts = materialize(grams(decided.where(fold != 0).select("label", "name")), "url-grams")
    kept = [*keys, "host", "path", "rule", "ruled"]
    if counts.select("label").distinct().count() < 2:
        out = rows.select(*kept, F.lit(0.0).alias("difference"))
    else:
        table = materialize(window_differences(counts, windows(rows.select(F.concat("host", "path")))), "url-windows")
        out = scored(rows, kept, table)
    judged = out.withColumn("name", F.concat("host", "path")).where(F.col("ruled").isNotNull() & (fold == 0))
    threshold = calibrate(judged.select(F.col("ruled").alias("label"), "difference"))
    verdict = F.coalesce("ruled", F.when(F.col("difference") >= threshold, "allow").otherwise("block"))
    return out.select(*keys, "host", "path", "rule", verdict.alias("verdict"), "difference")


def calibrate(df: DataFrame) -> float:
    """The bin edge with the best balanced accuracy over the calibration URLs; ties go to the edge nearest 0."""
    bin_of = F.least(F.greatest(F.floor((F.col("difference") + RANGE) / (2 * RANGE) * BINS), F.lit(0)), F.lit(BINS - 1))
    got = df.groupBy("label", bin_of.alias("bin")).count().collect()  # at most 2 * BINS rows
    n = {label: [0] * BINS for label in ("allow", "block")}
    for r in got:
        n[r["label"]][r["bin"]] = r["count"]
    total = {k: sum(v) for k, v in n.items()}
    if not all(total.values()):
        return 0.0
    edge = lambda b: -RANGE + 2 * RANGE * b / BINS
    return edge(max(range(BINS + 1), key=lambda b: (round(sum(n["allow"][b:]) / total["allow"] + sum(n["block"][:b]) / total["block"], 9), -abs(edge(b)))))
