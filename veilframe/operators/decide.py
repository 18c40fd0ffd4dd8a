"""Calibration, decisions under a profile, exposure, and their fits and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.text import normalized_key
from veilframe.operators.taxonomy import CATEGORY_OF, FACTOR, PROFILES, WEIGHT


def lookup(kind: Column, values: dict, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), kind), F.lit(default))


def calibrate(score: Column, bins: list[tuple[float, float]]) -> Column:
    """The precision of the first bin (upper edge, precision) above score, else of the last; no bins: the score."""
    if not bins:
        return score
    table = F.array(*[F.struct(F.lit(float(to)).alias("to"), F.lit(float(p)).alias("p")) for to, p in bins])
    return F.coalesce(F.get(F.filter(table, lambda b: score < b["to"]), F.lit(0))["p"], F.lit(float(bins[-1][1])))


def calibrated(kind: Column, score: Column, curves: dict[str, list[tuple[float, float]]] | None) -> Column:
    """The score calibrated by the curve of its type, or by that of "*"; unchanged where there is none."""
    out = calibrate(score, (curves or {}).get("*", []))
    for name, bins in sorted((curves or {}).items()):
        out = out if name == "*" else F.when(kind == name, calibrate(score, bins)).otherwise(out)
    return out


def decision(kind: Column, value: Column, conf: Column, limits: dict[str, float], allow: list[str] = (), deny: list[str] = ()) -> Column:
    """deny-list, allow-list, out-of-profile, below-threshold or report, in this precedence; lists ignore case and spacing."""
    threshold, key = lookup(kind, limits, 2.0), normalized_key(value)
    listed = lambda xs: key.isin([" ".join(x.split()).lower() for x in xs])
    return F.when(listed(deny), "deny-list").when(listed(allow), "allow-list").when(threshold > 1, "out-of-profile").when(conf < threshold, "below-threshold").otherwise("report")


def decide(df: DataFrame, profile: str | dict[str, float], allow: list[str] = (), deny: list[str] = (), conf: str = "raw_conf") -> DataFrame:
    """df with decision."""
    limits = PROFILES[profile] if isinstance(profile, str) else profile
    return df.withColumn("decision", decision(F.col("type"), F.col("text"), F.col(conf), limits, allow, deny))


def points(kind: Column, conf: Column) -> Column:
    c = F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0))
    weight = {t: WEIGHT[CATEGORY_OF[t]] * FACTOR.get(t, 1.0) for t in CATEGORY_OF}
    return F.when(conf < 0.05, 0.0).otherwise(c * lookup(kind, weight, 0.0))


def band(score: Column) -> Column:
    return F.when(score <= 0, "none").when(score < 20, "low").when(score < 45, "moderate").when(score < 70, "high").otherwise("severe")


def exposure(spans: DataFrame, key: str = "doc_id", conf: str = "raw_conf") -> DataFrame:
    """key, raw_points, score 0 to 100, band and the number of entities; one partial and one final sum per document."""
    out = spans.groupBy(key).agg(F.round(F.sum(points(F.col("type"), F.col(conf))), 6).alias("raw_points"), F.count(F.lit(1)).alias("entities"))
    return out.withColumn("score", F.round(100 * (1 - F.exp(-F.col("raw_points") / 100)), 4)).withColumn("band", band(F.col("score")))


def by_category(spans: DataFrame, key: str = "doc_id", conf: str = "raw_conf") -> DataFrame:
    out = spans.groupBy(key, lookup(F.col("type"), CATEGORY_OF, "other").alias("category")).agg(F.count(F.lit(1)).alias("entities"), F.sum(points(F.col("type"), F.col(conf))).alias("points"))
    total = F.sum("points").over(Window.partitionBy(key))
    return out.withColumn("share", F.when(total > 0, F.round(F.col("points") / total, 6)).otherwise(0.0))


def confusion(truth: DataFrame, found: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Counts, precision, recall and F1 by a column; exact matches on keys. No predictions: precision 1, no truth: recall 1."""
    t, p = truth.select(*keys, by).distinct().withColumn("t", F.lit(1)), found.select(*keys, by).distinct().withColumn("p", F.lit(1))
    both = t.join(p, [*keys, by], "full").groupBy(by).agg(F.count("t").alias("gt"), F.count("p").alias("predictions"), F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"))
    precision = F.when(F.col("predictions") == 0, 1.0).otherwise(F.col("tp") / F.col("predictions"))
    recall = F.when(F.col("gt") == 0, 1.0).otherwise(F.col("tp") / F.col("gt"))
    out = both.withColumns({"precision": precision, "recall": recall})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def fit_calibration(rows: DataFrame, score: str, correct: str, bins: int = 10) -> list[tuple[float, float, int]]:
    """(upper edge, precision, samples): equal bins, then pool-adjacent-violators; at most `bins` rows reach the driver."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    got = rows.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("int")).alias("k")).orderBy("b").collect()
    pools: list[list] = []
    for r in got:
        pools.append([(r["b"] + 1) / bins, r["k"], r["n"]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] > pools[-1][1] * pools[-2][2]:
            to, k, n = pools.pop()
            pools[-1] = [to, pools[-1][1] + k, pools[-1][2] + n]
    return [(to, k / n, n) for to, k, n in pools]


def calibration_error(rows: DataFrame, score: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    b = rows.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("predicted"), F.avg(F.col(correct).cast("double")).alias("observed"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / F.sum("n"), 6).alias("ece"))


def top_contributors(spans: DataFrame, key: str = "doc_id", conf: str = "raw_conf", most: int = 5) -> DataFrame:
    """key, type, points and place of the types that add most to a document's exposure; ties go by name."""
    by_type = spans.groupBy(key, "type").agg(F.round(F.sum(points(F.col("type"), F.col(conf))), 6).alias("points"))
    order = Window.partitionBy(key).orderBy(F.desc("points"), "type")
    return by_type.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def percentiles(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles of a value: the ceil(share * n)-th smallest."""
    order = Window.partitionBy(*by).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).select(*by, value, F.row_number().over(order).alias("__r"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("__n"))
    pick = lambda p: F.max(F.when(F.col("__r") == F.ceil(F.lit(p) * F.col("__n")), F.col(value)))
    return ranked.groupBy(*by).agg(*[pick(p).alias(f"p{round(100 * p)}") for p in shares])


def gates(metrics: DataFrame, floors: dict[str, tuple[float, float]], by: str) -> DataFrame:
    """by, precision, recall and passed for each type with floors (precision, recall); a type without metrics fails."""
    rows = [(k, float(p), float(r)) for k, (p, r) in sorted(floors.items())]
    wanted = metrics.sparkSession.createDataFrame(rows, f"{by} string, min_precision double, min_recall double")
    found = wanted.join(metrics.select(F.col(by).cast("string").alias(by), "precision", "recall"), by, "left")
    return found.withColumn("passed", F.coalesce((F.col("precision") >= F.col("min_precision")) & (F.col("recall") >= F.col("min_recall")), F.lit(False)))
