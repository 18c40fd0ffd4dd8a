"""Text expressions: folds that keep the length, format profile, script counts, entropy."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that fold one to one.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
SINGLES = "\u2018\u2019\u201a\u201b\u2032\u2035"
DOUBLES = "\u201c\u201d\u201e\u201f\u2033\u2036"
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Thai", "Han", "Hiragana", "Katakana", "Hangul")
FOLDED = SPACES + DASHES + SINGLES + DOUBLES
TARGETS = " " * len(SPACES) + "-" * len(DASHES) + "'" * len(SINGLES) + '"' * len(DOUBLES)
#: Every decimal digit beyond ASCII, by the rule of the Unicode database.
DIGITS = {chr(c): str(unicodedata.digit(chr(c))) for c in range(128, 0x20000) if unicodedata.category(chr(c)) == "Nd"}


def fold_whitespace_punctuation(text: Column) -> Column:
    return F.translate(text, FOLDED, TARGETS)


def fold_digits(text: Column) -> Column:
    return F.translate(text, "".join(DIGITS), "".join(DIGITS.values()))


def normalized_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def fold_for_match(text: str) -> str:
    """Lower case without marks, for kernels."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c)[0] != "M"))


FOLD_TABLE = str.maketrans(FOLDED + "".join(DIGITS), TARGETS + "".join(DIGITS.values()))
#: Scripts whose words use joiners, and signs that joiners make one emoji of.
JOINING, EMOJI = "\u0600-\u08ff\u0900-\u0dff\ufb50-\ufdff\ufe70-\ufefc", "\u2190-\u2bff\ufe0f\U0001f000-\U0001faff"
DROPPED = f"[\u00ad\u200b\u200e\u200f\u202a-\u202e\u2060-\u2064\ufeff]|(?<![{JOINING}])\u200c|\u200c(?![{JOINING}])|(?<![{JOINING}{EMOJI}])\u200d|\u200d(?![{JOINING}{EMOJI}])"
DROPPED_RE = re.compile(DROPPED)
#: What normalization may change: invisibles, and characters beyond ASCII or with marks, each with its marks.
CHANGING = re.compile(f"(?P<gone>{DROPPED})|[^\x00-\x7f\u0300-\u036f][\u0300-\u036f]*|[\x00-\x7f]?[\u0300-\u036f]+")


@functools.lru_cache(maxsize=1 << 16)
def folded_cluster(cluster: str) -> str:
    return unicodedata.normalize("NFKC", cluster).translate(FOLD_TABLE)


def normalize(text: str) -> tuple[str, list[int] | None]:
    """Invisibles out, NFKC by cluster, spaces, punctuation and digits folded; and the original start of each character.

    Joiners stay in scripts that use them and in emoji. None as the map is the identity, for a text that changes no length.
    """
    if text.isascii():
        return text, None
    if unicodedata.is_normalized("NFKC", text) and not DROPPED_RE.search(text):
        return text.translate(FOLD_TABLE), None
    out, at, last = [], [], 0
    for m in CHANGING.finditer(text):
        a, b = m.span()
        if last < a:
            out.append(text[last:a])
            at += range(last, a)
        if m["gone"] is None:
            c = folded_cluster(m[0])
            out.append(c)
            at += range(a, b) if len(c) == b - a else [a] * len(c)
        last = b
    out.append(text[last:])
    at += range(last, len(text))
    return "".join(out), None if len(at) == len(text) and at == list(range(len(text))) else [*at, len(text)]


def script_counts(text: Column) -> Column:
    """Letters of a text by script, as a struct of counts."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return F.struct(*[count(rf"\p{{Is{name}}}").alias(name.lower()) for name in SCRIPTS])


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    return -F.aggregate(F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n), F.lit(0.0), lambda a, p: a + p * F.log2(p))


def line_features(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    share = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("long")
    return F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        share(r"^ *\|.*\| *$").alias("n_table"),
        share(r'^ *"[^"]+" *:').alias("n_json"),
        share(r"^ *[A-Za-z_][A-Za-z0-9_-]*: ").alias("n_yaml"),
        share(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:").alias("n_log"),
        share(r"^(From|To|Subject|Date|Cc): ").alias("n_email"),
    )


def format_profile(f: Column) -> Column:
    """The format of a document from its line_features."""
    n = F.greatest(f["n_lines"], F.lit(1))
    return (
        F.when(f["n_lines"] == 0, "unknown")
        .when(2 * f["n_table"] >= n, "markdown-table")
        .when(100 * f["n_json"] >= 34 * n, "json")
        .when(2 * f["n_log"] >= n, "log")
        .when(f["n_email"] >= 2, "email")
        .when(2 * f["n_yaml"] >= n, "yaml")
        .otherwise("prose")
    )
