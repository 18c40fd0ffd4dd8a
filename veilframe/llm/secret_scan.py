"""Secret scans: fixed token formats, and password guess-cost dynamic programming on credential-context values.

A value that stands after a credential word is split, at minimum cost, into dictionary words (also leet-spelled),
dates, repeats, keyboard walks and brute-force spans. With l segments the cost is l! * product + 10000^(l-1) guesses.
A value that takes MIN_LOG10_GUESSES or more is a secret. The dictionary is a short list of password words and, after
them, the lower-case words of a public vocabulary in its order, which is by frequency; its path is a parameter. Repeats
and walks are beginnings and ends of maximal ones. Only closed placeholders (${NAME}, {{name}}, <name>, [NAME]) and the
exact mask of redact() are left out; a value that merely begins with a bracket or $ is judged like any other.

Defined cases: a null or empty text has no spans; very long texts and values are judged whole: a way that has passed the
limit is left, as no further segment makes it cheaper, and each step reads a segment's length only; repeated rows are
judged row by row; spans of different kinds may overlap, of equal starts the kind listed first comes first; an empty table
gives an empty result; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import map_text

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_BYTES = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
#: Words that open a credential context, beyond those of the base rule.
CONTEXT_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "passphrase", "passcode", "pwd", "credential", "bearer", "private_key", "access_key", "auth_key")
CONTEXT = re.compile(r"""(?:password|passwd|secret|token|api_?key|passphrase|passcode|pwd|credentials?|bearer|private_key|access_key|auth_key)["']?(?:\x20*(?::=|=>|->|[:=])\x20*|\x20+(?:is\x20+)?(?=[^\s"'<>,;]*[0-9]))["']?([^\s"'<>,;]{8,})""", re.A | re.I)
#: A whole value that names a variable, as templates and redact() leave it; punctuation of the sentence may follow.
PLACEHOLDER = re.compile(r"""(?:\$\{[A-Za-z_][\w.-]*\}|\{\{[A-Za-z_][\w.-]*\}\}|<[A-Za-z_][A-Za-z_.-]*[0-9]{0,3}>|\[[A-Za-z_][A-Za-z_.-]*[0-9]{0,3}\])[.:!?)]*""", re.A)
MIN_LOG10_GUESSES = 8.0

# Frequent passwords and password words, most frequent first.
WORDS = (
    "password 123456 qwerty admin welcome letmein login master monkey dragon hello secret shadow sunshine princess football baseball "
    "superman batman access flower iloveyou trustno test user guest root default changeme pass love money summer winter spring autumn "
    "monday friday january february march april june july august september october november december computer internet server database "
    "company office house happy star tiger lion eagle horse correct battery staple magic killer soccer hockey freedom cheese coffee orange "
    "apple banana purple silver golden black white green blue thunder angel lucky pepper ginger cookie jordan michael jennifer thomas robert"
).split()
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SHORTEST_WORD, LONGEST_WORD = 3, 24
LEET = str.maketrans("4@8301!5$7", "aabeoiisst")
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEIGHBOURS = {frozenset(p) for row in KEYBOARD for p in zip(row, row[1:])} | {frozenset(p) for a, b in zip(KEYBOARD, KEYBOARD[1:]) for k in (0, 1) for p in zip(a[k:], b)}
DATE = re.compile(r"(?:19|20)\d\d|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d|(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])")


@functools.lru_cache(maxsize=4)
def dictionary(vocabulary: str = VOCABULARY) -> dict[str, int]:
    """Ranks of words: WORDS, then the pieces of the vocabulary that are whole words of letters."""
    with open(vocabulary, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    whole = (p[1:].lower() for p in sorted(pieces, key=pieces.get) if p[0] == "Ġ" and p[1:].isascii() and p[1:].isalpha())
    found = dict.fromkeys([*WORDS, *(w for w in whole if SHORTEST_WORD <= len(w) <= LONGEST_WORD)])
    return {w: i + 1 for i, w in enumerate(found)}


@functools.lru_cache(maxsize=4)
def beginnings(vocabulary: str = VOCABULARY) -> set[str]:
    return {w[:SHORTEST_WORD] for w in dictionary(vocabulary)}


class Runs:
    """The maximal runs of a value, found when first asked for; follows(a, b): b goes on after a."""

    def __init__(self, value: str, follows):
        self.value, self.follows, self.at = value, follows, (0, 0)

    def around(self, i: int) -> tuple[int, int]:
        a, b = self.at
        if not a <= i < b:
            value, follows = self.value, self.follows
            a, b = i, i + 1
            while a and follows(value[a - 1], value[a]):
                a -= 1
            while b < len(value) and follows(value[b - 1], value[b]):
                b += 1
            self.at = a, b
        return a, b


class Segments:
    """The cheap segments of a value, looked up by their start."""

    def __init__(self, value: str, vocabulary: str):
        self.value, self.rank, self.begins = value, dictionary(vocabulary), beginnings(vocabulary)
        self.low = value.lower() if len(value.lower()) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        self.plain = self.low.translate(LEET)
        self.runs = Runs(value, lambda a, b: a == b)
        self.walks = Runs(self.low, lambda a, b: frozenset((a, b)) in NEIGHBOURS)

    def starting(self, i: int) -> list[tuple[int, float]]:
        """(end, log10 guesses) of the words, dates, repeats and walks that start at i."""
        value, low, plain, rank, n = self.value, self.low, self.plain, self.rank, len(self.value)
        out, short = [], i + SHORTEST_WORD
        for j in range(short, min(n, i + LONGEST_WORD) + 1) if low[i:short] in self.begins or plain[i:short] in self.begins else ():
            if (r := rank.get(low[i:j])) or (r := 2 * rank.get(plain[i:j], 0)):
                out.append((j, math.log10(r * (1 if value[i:j] == low[i:j] else 2))))
        if value[i].isdigit():
            out += [(j, math.log10(365 * 120 if j - i > 4 else 120)) for j in range(i + 4, min(n, i + 10) + 1) if DATE.fullmatch(value, i, j)]
        for runs, least, kinds in ((self.runs, 3, 95), (self.walks, 4, 360)):
            a, b = runs.around(i)
            out += [(j, math.log10(kinds * (j - i))) for j in (range(i + least, b + 1) if i == a else (b,)) if j - i >= least]
        return out


def cardinality(value: str) -> int:
    return 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 33 * any(not c.isalnum() for c in value)


def combined(product: float, count: int) -> float:
    """log10 of count! * 10**product + 10000**(count - 1); one segment costs itself."""
    if count == 1:
        return product
    a, b = product + math.lgamma(count + 1) / math.log(10), 4.0 * (count - 1)
    return max(a, b) + math.log10(1 + 10 ** (min(a, b) - max(a, b)))


def log10_guesses(value: str, vocabulary: str = VOCABULARY, least: float = math.inf) -> float:
    """log10 of the least number of guesses over all segmentations of the whole value; `least` where that takes as many or more.

    A way whose product alone reaches the best cost so far is left: every further segment takes one guess or more. With l
    segments the cost is above 10000^(l-1), so no more segments are tried once that reaches the best.
    """
    n, per = len(value), math.log10(max(10, cardinality(value)))
    if not n:
        return 0.0
    segments = Segments(value, vocabulary)
    # before[k]: least log10 product of count segments that cover value[:k]
    before, best, count = {0: 0.0}, least, 0
    while before and 4.0 * count < best:
        count += 1
        now: dict[int, float] = {}
        for i, cost in before.items():
            for j, g in segments.starting(i):
                if cost + g < min(best, now.get(j, math.inf)):
                    now[j] = cost + g
        # a brute-force span may begin anywhere and goes on from character to character
        run, last = math.inf, max(before)
        for k in range(min(before), n):
            run = min(run, before.get(k, math.inf)) + per
            if run < best and run < now.get(k + 1, math.inf):
                now[k + 1] = run
            elif run >= best and k >= last:
                break
        if n in now:
            best = min(best, combined(now.pop(n), count))
        before = {k: c for k, c in now.items() if c < best}
    return best


def is_hard(value: str, least: float = MIN_LOG10_GUESSES, vocabulary: str = VOCABULARY) -> bool:
    """Whether the whole value takes at least 10**least guesses."""
    return log10_guesses(value, vocabulary, least) >= least


def scan(text: str, least: float = MIN_LOG10_GUESSES, mask: str = "[SECRET]", vocabulary: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of all spans of a text, sorted; a guess value that is mask is none."""
    found, low = [], text.lower()
    hinted = any(w in low for w in CONTEXT_WORDS)
    if hinted:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode("utf-8", "replace").translate(HEX_BYTES):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    if hinted:
        base = list(found)
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            left_alone = PLACEHOLDER.fullmatch(text, a, b) or mask and text.startswith(mask, a) and not text[a + len(mask) : b].strip(".:!?)")
            if not left_alone and not any(s <= a and b <= e for s, _, e in base) and is_hard(text[a:b], least, vocabulary):
                found.append((a, 3, b))
    return sorted(found)


def secret_scan(df: DataFrame, keys: list[str] | None = None, text: str = "text", least: float = MIN_LOG10_GUESSES, vocabulary: str = VOCABULARY) -> DataFrame:
    """keys and found, an array of (kind, start, end), one row per row of df; map-only."""

    def factory():
        return lambda texts: {"found": [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t, least, vocabulary=vocabulary)] for t in texts]}

    return map_text(df, factory, "found array<struct<kind: string, start: int, end: int>>", keys or ["doc_id"], text)


def redact(df: DataFrame, text: str = "text", mask: str = "[SECRET]", least: float = MIN_LOG10_GUESSES, vocabulary: str = VOCABULARY) -> DataFrame:
    """df with every secret of its text column replaced by mask; a null text stays null; other columns unchanged."""

    def masked(value: str) -> str:
        out, at = [], 0
        for s, _, e in scan(value, least, mask, vocabulary):
            if s >= at:
                out += [value[at:s], mask]
            at = max(at, e)
        return "".join([*out, value[at:]])

    def factory():
        return lambda texts: {"__masked": [masked(t) for t in texts]}

    others = [c for c in df.columns if c != text]
    # the null flag travels as a key, as kernels see a null text as ""
    flagged = df.withColumn("__null", F.col(text).isNull())
    out = map_text(flagged, factory, "__masked string", [*others, "__null"], text)
    return out.select(*[F.when(F.col("__null"), F.lit(None)).otherwise(F.col("__masked")).alias(c) if c == text else F.col(c) for c in df.columns])


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from secret_scan's spans."""
    line = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = line(F.filter("found", lambda x: x["kind"] != "guess"))
    return df.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


def sha(found: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found if k < 3).encode()).hexdigest()
