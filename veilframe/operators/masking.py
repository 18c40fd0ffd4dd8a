"""Masking with typed tokens, the vault that takes it back, restoration, and the egress guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_tokens(spans: Column, text: Column | None = None) -> Column:
    """The spans, in order, with token [TYPE_n]: n counts a type's distinct values by first occurrence.

    With text, numbers go on from the largest that a bracketed token in the text already has, so none is in it.
    """
    value = lambda s: F.coalesce(s["canonical"], s["text"])
    apart = F.lit("\u0000")
    offset = F.lit(0)
    if text is not None:
        taken = F.transform(F.regexp_extract_all(text, F.lit(r"\[[A-Z][A-Z_]*_([0-9]{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))
        offset = F.coalesce(F.array_max(taken), F.lit(0))

    def numbered(known: Column) -> Column:
        kinds, from_n = known["keys"], known["offset"]

        def token(s: Column) -> Column:
            own = F.filter(kinds, lambda k: F.startswith(k, F.concat(s["type"], apart)))
            return F.concat(F.lit("["), s["type"], F.lit("_"), (from_n + F.array_position(own, F.concat(s["type"], apart, value(s)))).cast("string"), F.lit("]"))

        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), value(s).alias("value"), s["text"].alias("original"), token(s).alias("token")))

    keys = F.array_distinct(F.transform(spans, lambda s: F.concat(s["type"], apart, value(s))))
    return F.get(F.transform(F.array(F.struct(keys.alias("keys"), offset.alias("offset"))), numbered), F.lit(0))


def masked(text: Column, tokens: Column) -> Column:
    """text with each span replaced by its token: the text between spans and the tokens, joined once."""
    before = lambda i: F.coalesce(F.get(tokens, i - 1)["end"], F.lit(0))
    parts = F.transform(tokens, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), s["token"]))
    rest = F.coalesce(F.get(tokens, F.size(tokens) - 1)["end"], F.lit(0))
    return F.concat(F.array_join(parts, ""), F.substring(text, rest + 1, F.length(text)))


def vault(df: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """key, type, original, replacement: one row per distinct token of a document."""
    return df.select(key, F.explode(tokens).alias("t")).groupBy(key, "t.type", "t.token").agg(F.min_by("t.original", "t.start").alias("original")).withColumnRenamed("token", "replacement")


def restored(text: Column, tokens: Column) -> Column:
    """text with every token replaced by its original; closing brackets keep tokens from being parts of others.

    Tokens that masking made are in no original, so replacing one brings up no other.
    """
    return F.aggregate(F.array_distinct(F.transform(tokens, lambda t: F.struct(t["token"].alias("token"), t["original"].alias("original")))), text, lambda a, t: F.replace(a, t["token"], t["original"]))


def leaks(payload: Column, tokens: Column, exempt: Column | None = None) -> Column:
    """The tokens whose original value is still in payload, as it is or without separators (6 characters or more)."""
    plain = lambda x: F.lower(F.regexp_replace(x, r"[ \t./\-]", ""))
    found = F.filter(tokens, lambda t: F.contains(F.lower(payload), F.lower(t["original"])) | ((F.length(plain(t["original"])) >= 6) & F.contains(plain(payload), plain(t["original"]))))
    return F.array_distinct(F.transform(found, lambda t: t["token"])) if exempt is None else F.array_except(F.transform(found, lambda t: t["token"]), exempt)
