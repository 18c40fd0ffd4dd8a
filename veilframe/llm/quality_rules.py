"""Quality rules by distribution divergence, in DataFrame functions only.

A document's character-class histogram and its common-word histogram are compared, by Jensen-Shannon distance, to
references of its language. The references are medians over all documents of the corpus that the common-word lists
assign to that language, so they are statistics of the whole input. Texts under a guard length are not judged by
divergence, as their histograms are too coarse.

Defined cases: a null or empty text has no words and fails the base rule (under ten words); repeated rows are judged
row by row; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import materialize

# Frequent words of four languages.
COMMON = {
    "en": "the of and to in is that for it with as was on be by at from this are or an".split(),
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "fr": "de la le et les des en un une du que est pour qui dans sur par plus pas au".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
LANGS = [*COMMON, "und"]
VOCABULARY = list(dict.fromkeys(w for words in COMMON.values() for w in words))
BINS = len(VOCABULARY) + 1

SPACE = r"[ \t-\x0D]+"
CLASSES = {"digit": r"[0-9]+", "upper": r"\p{Lu}+", "punct": r"[.,;:!?'\"()\-]+", "space": SPACE, "symbol": r"[^\p{L}\p{M}0-9.,;:!?'\"()\- \t-\x0D]+"}

#: Texts under so many words are not judged by divergence.
GUARD_WORDS = 20
MAX_CLASS_DISTANCE = 0.18
MAX_WORD_DISTANCE = 0.45


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: lambda variables are bound, columns may be inlined many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def hits_of(common: Column, words: list[str]) -> Column:
    bins = [VOCABULARY.index(x) + 1 for x in words]
    return total(F.transform(F.filter(common, lambda e: e["bin"].isin(bins)), lambda e: e["n"]))


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows found twice or more: windows by hash, sorted, neighbours compared, spans united."""

    def covered(hashes: Column) -> Column:
        def spans(ordered: Column) -> Column:
            twin = lambda e, k: F.coalesce(F.get(ordered, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == e["h"], F.lit(False))
            at = F.sort_array(F.transform(F.filter(ordered, twin), lambda e: e["i"]))
            return let(at, lambda p: total(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5))).cast("long"))))

        pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, spans)).otherwise(F.lit(0).cast("long"))

    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)])
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 5), window)
    return F.when(F.size(words) >= 6, let(hashes, covered)).otherwise(F.lit(0).cast("long"))


def features(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per document: its keys (as __keys, so that no name clashes), base counts, class and common-word counts."""
    t = F.coalesce(F.col(text), F.lit(""))
    gone = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("long")

    def of_words(words: Column) -> Column:
        bins = F.sort_array(F.filter(F.transform(words, lambda w: F.find_in_set(F.lower(w), F.lit(",".join(VOCABULARY)))), lambda i: i > 0))

        def runs(found: Column) -> Column:
            def counted(kinds: Column) -> Column:
                starts = F.transform(kinds, lambda v: F.array_position(found, v))
                return let(starts, lambda s: F.transform(kinds, lambda v, k: F.struct(v.alias("bin"), (F.coalesce(F.get(s, k + 1), F.size(found) + 1) - F.get(s, k)).cast("long").alias("n"))))

            return let(F.array_distinct(found), counted)

        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeated_words(words).alias("n_repeat_words"), let(bins, runs).alias("common"))

    lines = let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t-\x0D]")), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))
    words = F.filter(F.split(t, SPACE, -1), lambda w: w != "")
    out = df.select(F.struct(*keys).alias("__keys"), let(words, of_words).alias("w"), gone(r"[#*$%&|<>]").alias("n_symbols"), lines.alias("n_dup_lines"), F.length(t).cast("long").alias("n_chars"), *[gone(p).alias(f"c_{k}") for k, p in CLASSES.items()])
    rest = F.col("n_chars") - sum(F.col(f"c_{k}") for k in CLASSES)
    hits = F.array(*[hits_of(F.col("w.common"), ws) for ws in COMMON.values()])
    lang = F.when(F.array_max(hits) > 0, F.array_position(hits, F.array_max(hits)) - 1).otherwise(len(COMMON)).cast("int")
    return out.select("__keys", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "w.common", F.array(rest, *[F.col(f"c_{k}") for k in CLASSES]).alias("classes"), lang.alias("lang_bin"))


def references(rows: DataFrame, guard_words: int = GUARD_WORDS) -> tuple[list[list[float]], list[list[float]]]:
    """Class and common-word distributions of each language: bin by bin the exact median share over all its documents
    that pass the base rule and the length guard, scaled to a sum of 1. A median ignores the junk of a corpus.

    Shares are rounded to thousandths, so each aggregation buffer holds at most 1001 values. The last language,
    "und", is that of all others together. At most len(LANGS) rows reach the driver.
    """
    n_classes, judged = len(CLASSES) + 1, (F.col("n_words") >= guard_words) & ~failed() & (F.col("lang_bin") < len(COMMON))
    chars = F.greatest(total(F.col("classes")), F.lit(1))
    named = [F.round(F.col("classes")[i] / chars, 3).alias(f"c{i}") for i in range(n_classes)]
    common = F.map_from_entries("common")
    named += [F.round(F.coalesce(F.try_element_at(common, F.lit(b)), F.lit(0)) / F.col("n_words"), 3).alias(f"b{b}") for b in range(1, BINS)]
    shares = rows.where(judged).select("lang_bin", *named)
    names = [x for x in shares.columns if x != "lang_bin"]
    got = {r["lang_bin"]: r for r in shares.rollup("lang_bin").agg(*[F.percentile(x, F.lit(0.5)).alias(x) for x in names]).collect()}

    def scaled(values: list[float]) -> list[float]:
        n = sum(values)
        return [x / n for x in values] if n else [1 / len(values)] * len(values)

    classes, words = [], []
    for k in range(len(LANGS)):
        r = got.get(k) or got.get(None)
        classes.append(scaled([(r and r[f"c{i}"]) or 0.0 for i in range(n_classes)]))
        bins = [(r and r[f"b{b}"]) or 0.0 for b in range(1, BINS)]
        words.append([1 - sum(bins), *bins])
    return classes, words


def failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def half(p: Column, q: Column) -> Column:
    """A bin's share of the Jensen-Shannon divergence, in bits."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return (part(p) + part(q)) / 2


def quality_rules(df: DataFrame, keys: list[str] | None = None, text: str = "text", guard_words: int = GUARD_WORDS, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """keys, the base counts, base_failed, class_distance, word_distance and kept, one row per row of df."""
    keys = keys or ["doc_id"]
    rows = materialize(features(df, keys, text), "quality-features")
    classes, words = references(rows, guard_words)
    table_of = lambda v: F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in v])
    n_classes = len(CLASSES) + 1

    def class_distance(q: Column) -> Column:
        n = F.greatest(total(F.col("classes")), F.lit(1)).cast("double")
        return F.sqrt(F.greatest(F.lit(0.0), sum((half(F.col("classes")[i] / n, q[i]) for i in range(n_classes)), F.lit(0.0))))

    def word_distance(q: Column) -> Column:
        n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
        common = total(F.transform("common", lambda e: e["n"]))
        shared = F.aggregate("common", F.lit(0.0), lambda a, e: a + half(e["n"] / n, F.get(q, e["bin"])))
        met = F.aggregate("common", F.lit(0.0), lambda a, e: a + F.get(q, e["bin"]))
        other = half((F.col("n_words") - common) / n, q[0])
        return F.sqrt(F.greatest(F.lit(0.0), shared + other + F.greatest(F.lit(0.0), 1 - q[0] - met) / 2))

    judged = rows.withColumns({"class_distance": let(F.get(table_of(classes), F.col("lang_bin")), class_distance), "word_distance": let(F.get(table_of(words), F.col("lang_bin")), word_distance)})
    near = (F.col("n_words") < guard_words) | ((F.col("class_distance") <= max_class) & (F.col("word_distance") <= max_word))
    return judged.select("__keys.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed().alias("base_failed"), "class_distance", "word_distance", (~failed() & near).alias("kept"))


def duckdb_sql() -> str:
    """The same rows as the query's, for DuckDB."""
    vocabulary = ", ".join(f"'{w}'" for w in VOCABULARY)
    gone = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g'))"
    hits = ", ".join(f"list_sum(list_transform([{', '.join(str(VOCABULARY.index(x) + 1) for x in ws)}], lambda b: bins[b]))" for ws in COMMON.values())
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / (p + q)) ELSE 0 END"
    distance = f"sqrt(greatest(0, sum(({part('p')} + {part('q')}) / 2)))"
    bad = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
    own = lambda medians: f"SELECT k, coalesce((SELECT q FROM {medians} WHERE lang_bin = k), (SELECT q FROM {medians} WHERE lang_bin IS NULL)) AS q FROM range({len(LANGS)}) AS g(k)"
    median = lambda values, n: f"SELECT lang_bin, list(q ORDER BY bin) AS q FROM (SELECT lang_bin, bin, quantile_cont(round(share, 3), 0.5) AS q FROM (SELECT lang_bin, unnest(range(1, len({values}) + 1)) AS bin, unnest({values}) / {n} AS share FROM j) GROUP BY GROUPING SETS ((lang_bin, bin), (bin))) GROUP BY lang_bin"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS h FROM t),
y AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM x) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM y, range(5) AS g(k) GROUP BY doc_id),
f AS (SELECT doc_id, t, w, list_transform(w, lambda x: coalesce(list_position([{vocabulary}], lower(x)), 0)) AS found, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\x0D]')) AS ls FROM t),
c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {gone('[#*$%&|<>]')} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  list_transform(range(1, {BINS}), lambda b: len(list_filter(found, lambda x: x = b))) AS bins, length(t) AS n_chars, [{', '.join(gone(p) for p in CLASSES.values())}] AS named FROM f),
b AS (SELECT c.*, coalesce(r.n, 0) AS n_repeat_words, list_prepend(n_chars - list_sum(named), named) AS classes, [{hits}] AS hits FROM c LEFT JOIN r USING (doc_id)),
a AS (SELECT *, CASE WHEN list_max(hits) > 0 THEN list_position(hits, list_max(hits)) - 1 ELSE {len(COMMON)} END AS lang_bin FROM b),
j AS (SELECT * FROM a WHERE n_words >= {GUARD_WORDS} AND NOT ({bad}) AND lang_bin < {len(COMMON)}),
mc AS ({median('classes', 'greatest(list_sum(classes), 1)')}),
mw AS ({median('bins', 'n_words')}),
rc AS (SELECT k, list_transform(q, lambda x: x / list_sum(q)) AS q FROM ({own('mc')})),
rw AS (SELECT k, list_prepend(1 - list_sum(q), q) AS q FROM ({own('mw')})),
dc AS (SELECT doc_id, {distance} AS d FROM (SELECT doc_id, unnest(list_transform(classes, lambda x: x / greatest(list_sum(classes), 1))) AS p, unnest(q) AS q FROM a JOIN rc ON k = lang_bin) GROUP BY doc_id),
dw AS (SELECT doc_id, {distance} AS d FROM (SELECT doc_id, unnest(list_transform(list_prepend(n_words - list_sum(bins), bins), lambda x: x / greatest(n_words, 1))) AS p, unnest(q) AS q FROM a JOIN rw ON k = lang_bin) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, ({bad}) AS base_failed, NOT ({bad}) AND (n_words < {GUARD_WORDS} OR (dc.d <= {MAX_CLASS_DISTANCE} AND dw.d <= {MAX_WORD_DISTANCE})) AS kept
FROM a JOIN dc USING (doc_id) JOIN dw USING (doc_id)
"""
