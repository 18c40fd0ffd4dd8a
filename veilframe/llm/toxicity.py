"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer reads a clause's words and writes symbols: insult (with the word's weight), threat, target, negation,
report, quote or word. Four more transducers are composed behind it, each with explicit states and arcs:

* threat: within REACH symbols after a threat, a target is written as threatened;
* target: an insult in a clause that has a target, before or after it, is written as aimed; the transducer guesses that a
  target will come, and only guesses that come true end in a final state;
* negation: within REACH symbols after a negation, an insult or a threatened target is written as negated;
* reported speech: after a report, or between quotes, what is insulting is written as reported.

The composed machine's arcs carry the word's weight times the weight of the output; a clause's score is its best path. A
document's score comes from its matched clauses, not from isolated words: the weights by output along the best paths, the
heaviest clause and the number of matched ones go through a logistic output layer, which learns the outputs' weights.

The arcs of the lexicon are learnt: insults are words and word stems that toxic training documents have far more often
than others; threats those that stand shortly before a target in toxic documents; negations and reports those that
stand before insults in clean documents rather than in toxic ones; targets those whose clauses make an insult toxic. Each
adds to a short list of seed words. Learning uses labelled rows chosen by hash, at most MOST_LABELLED documents, and never
held-out rows; an arc needs a share of the toxic (or of the insulting) documents, which bounds the arcs at any size.

Defined cases: a null or empty text scores as one without matches; very long texts are read whole; repeated rows are
scored row by row; of equal best paths, the outputs first by name are taken; without labels (or with one class only) the
seed arcs and weights serve; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import map_text, materialize
from veilframe.llm.learning import labelled_sample, logistic
from veilframe.llm.transducers import Transducer, compose

#: Labelled documents that learning uses at most.
MOST_LABELLED = 8000
#: An arc needs so many documents, such a share of them and such log-odds; rarer words go by their stems.
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_ODDS = 3, 0.012, 3.0
THRESHOLD = 0.3

# Seed words of the lexicon.
INSULTS = "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns imbecile dumb bastard garbage vermin idioten dumm dummkopf trottel abschaum versager widerlich wertlos idiota idiotas estúpido estúpida basura escoria payaso patético asqueroso imbécil imbécile idiote stupide ordure minable crétin abruti pathétique dégoûtant".split()
THREATS = "kill hurt destroy beat attack töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your you're they them he she this these people du dich dein ihr sie tu te toi vous ils tú ti usted ellos".split()
NEGATIONS = "not never no isn't aren't wasn't don't without nicht kein keine nie pas jamais sans nunca sin".split()
REPORTERS = "said says wrote called quoted claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
REACH = 3

TOKEN = re.compile(r"""[^\W\d_]+(?:'[^\W\d_]+)?|["“”«»„]""")
CLAUSE = re.compile(r"[.!?;\n]+")
STEMS = (4, 5, 6)
SYMBOLS = ("word", "insult", "threat", "target", "negation", "report", "quote")
OUTPUTS = ("insult", "aimed", "threatened", "negated", "reported")
FEATURES = len(OUTPUTS) + 2
#: What a best path gains by an output; the output layer's own weights are learnt.
GAIN = {"insult": 1.0, "aimed": 1.5, "threatened": 1.0, "negated": 0.1, "reported": 0.2}


def copying(state, symbols, following) -> list[tuple]:
    return [(state, x, x, following) for x in symbols]


def machine() -> Transducer:
    """The composition of the four transducers behind the lexicon."""
    near = range(REACH + 1)
    # threat, negation: the state is the number of symbols that the last one still reaches
    threat = [a for k in near for a in copying(k, [x for x in SYMBOLS if x not in ("threat", "target")], max(0, k - 1))]
    threat += [(k, "threat", "threat", REACH) for k in near]
    threat += [(k, "target", "threatened" if k else "target", max(0, k - 1)) for k in near]
    middle = (*SYMBOLS, "threatened")
    rest = [x for x in middle if x not in ("insult", "target", "threatened")]
    # target: 0 none so far and none to come, 1 one is to come, 2 one was
    target = [a for k in (0, 1, 2) for a in copying(k, rest, k)]
    target += [(0, "insult", "insult", 0), (1, "insult", "aimed", 1), (2, "insult", "aimed", 2)]
    target += [(k, x, x, 2) for k in (1, 2) for x in ("target", "threatened")]
    middle = (*middle, "aimed")
    harsh = ("insult", "aimed", "threatened")
    negation = [a for k in near for a in copying(k, [x for x in middle if x not in (*harsh, "negation")], max(0, k - 1))]
    negation += [(k, "negation", "negation", REACH) for k in near]
    negation += [(k, x, "negated" if k else x, max(0, k - 1)) for k in near for x in harsh]
    middle = (*middle, "negated")
    # reported speech: open, within quotes, after a report
    soft = [x for x in middle if x not in (*harsh, "report", "quote")]
    reported = [a for s in ("open", "quoted", "said") for a in copying(s, soft, s)]
    reported += [("open", x, x, "open") for x in harsh] + [(s, x, "reported", s) for s in ("quoted", "said") for x in harsh]
    reported += [("open", "quote", "quote", "quoted"), ("quoted", "quote", "quote", "open"), ("said", "quote", "quote", "said")]
    reported += [("open", "report", "report", "said"), ("quoted", "report", "report", "quoted"), ("said", "report", "report", "said")]
    parts = [(threat, [0], near), (target, [0, 1], [0, 2]), (negation, [0], near), (reported, ["open"], ["open", "quoted", "said"])]
    whole = None
    for arcs, starts, finals in parts:
        part = Transducer(starts, finals, arcs)
        whole = part if whole is None else compose(whole, part, SYMBOLS)
    return whole


def stems(word: str) -> list[str]:
    """Arcs that a word may take: the whole word, and its beginnings as word*."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class Lexicon:
    """The words' arcs: insults by weight, and the words of the other symbols."""

    def __init__(self, insults: dict[str, float] | None = None, roles: dict[str, str] | None = None):
        self.insults = dict.fromkeys(INSULTS, 3.0) | (insults or {})
        seeds = {w: "threat" for w in THREATS} | {w: "target" for w in TARGETS} | {w: "negation" for w in NEGATIONS} | {w: "report" for w in REPORTERS}
        self.roles = (roles or {}) | seeds | dict.fromkeys("\"“”«»„", "quote")


class Grammar:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.machine = lexicon, machine()
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """The heaviest insult arc that a word takes, 0 if none."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[word] = max((self.lexicon.insults.get(s, 0.0) for s in stems(word)), default=0.0)
        return got

    def read(self, words: list[str]) -> tuple[list[str], list[float]]:
        """The lexicon's symbols and weights of a clause's words; what is no insult weighs 1."""
        weights = list(map(self.weight, words))
        return ["insult" if x else self.lexicon.roles.get(w, "word") for w, x in zip(words, weights)], [x or 1.0 for x in weights]

    def clause(self, words: list[str]) -> tuple[float, dict[str, float]]:
        """The best path's score, and its weights by output."""
        symbols, weights = self.read(words)
        score, path = self.machine.best(symbols, weights, lambda o: GAIN.get(o, 0.0))
        found = dict.fromkeys(OUTPUTS, 0.0)
        for o, w in zip(path, weights):
            if o in found:
                found[o] += w
        return score, found

    def clauses(self, text: str):
        """The words of each clause that can have a match: it holds an insult, or a threat and a target."""
        low = text.lower()
        kinds = set(TOKEN.findall(low))
        harsh = {w for w in kinds if self.weight(w) or self.lexicon.roles.get(w) == "threat"}
        for part in CLAUSE.split(low) if harsh else ():
            words = TOKEN.findall(part)
            if not harsh.isdisjoint(words):
                yield words

    def features(self, text: str) -> list[float]:
        """Damped weights by output, the heaviest clause and the number of matched clauses against the text's length."""
        total, heaviest, matched = dict.fromkeys(OUTPUTS, 0.0), 0.0, 0
        for words in self.clauses(text):
            score, found = self.clause(words)
            if score > 0:
                matched += 1
                heaviest = max(heaviest, score)
                total = {o: total[o] + found[o] for o in OUTPUTS}
        return [*(math.log1p(total[o]) for o in OUTPUTS), heaviest, matched / math.sqrt(1 + text.count(" "))]


SEED_WEIGHTS = np.array([1.0, 0.3, 1.0, -0.3, -0.2, 0.8, 0.5, -3.5])


def counted(sample: DataFrame, arcs_of) -> DataFrame:
    """(arc, clean, toxic): documents of the sample (text, label) that have an arc; arcs_of makes a text's arcs."""

    def run(batches):
        of = arcs_of()
        for b in batches:
            counts: dict[str, list[int]] = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s in of(t):
                    counts.setdefault(s, [0, 0])[y > 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["arc", "clean", "toxic"])

    return sample.select("text", "label").mapInArrow(run, "arc string, clean long, toxic long").groupBy("arc").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_odds(clean: int, toxic: int) -> Column:
    """Smoothed log-odds of an arc among `toxic` against `clean` documents."""
    return F.log((F.col("toxic") + 0.05) / (toxic + 1)) - F.log((F.col("clean") + 0.05) / (clean + 1))


def learn_insults(sample: DataFrame, clean: int, toxic: int) -> dict[str, float]:
    """Words and stems by log-odds; a share of the toxic documents bounds their number."""
    rows = counted(sample, lambda: lambda t: {s for w in set(TOKEN.findall(t.lower())) for s in stems(w)})
    least = max(LEAST_DOCUMENTS, math.ceil(LEAST_SHARE * toxic))
    got = rows.where(F.col("toxic") >= least).withColumn("odds", log_odds(clean, toxic)).where(F.col("odds") >= LEAST_ODDS).collect()
    return {r["arc"]: min(6.0, r["odds"]) for r in got}


def learn_roles(sample: DataFrame, insults: dict[str, float], clean: int, toxic: int) -> dict[str, str]:
    """Words of threats, negations, reports and targets, by where they stand to insults and targets in clauses."""

    def places():
        grammar = Grammar(Lexicon(insults))
        roles = grammar.lexicon.roles

        def of(text: str) -> set[str]:
            found = set()
            low = text.lower()
            for part in CLAUSE.split(low):
                words = TOKEN.findall(part)
                hits = [i for i, w in enumerate(words) if grammar.weight(w)]
                for i in hits:
                    found.add("hit")
                    found |= {f"near {w}" for w in words[max(0, i - REACH) : i]} | {f"far {w}" for w in words[: max(0, i - REACH)]} | {f"with {w}" for w in words}
                for i, w in enumerate(words):
                    if roles.get(w) == "target":
                        found |= {f"threat {x}" for x in words[max(0, i - REACH) : i]}
            return {x for x in found if x == "hit" or (w := x.split(" ", 1)[1]) not in roles and not grammar.weight(w)}

        return of

    rows = counted(sample, places)
    hit = rows.where("arc = 'hit'").first()
    hit_clean, hit_toxic = (hit["clean"], hit["toxic"]) if hit else (0, 0)
    kind, all_of = F.substring_index("arc", " ", 1), F.col("clean") + F.col("toxic")
    among_hits = log_odds(hit_clean, hit_toxic)
    least_hits = max(LEAST_DOCUMENTS, math.ceil(LEAST_SHARE * (hit_clean + hit_toxic)))
    least_toxic = max(LEAST_DOCUMENTS, math.ceil(LEAST_SHARE * toxic))
    role = (
        F.when((kind == "near") & (all_of >= least_hits) & (among_hits <= -LEAST_ODDS), "negation")
        .when((kind == "far") & (all_of >= least_hits) & (among_hits <= -LEAST_ODDS), "report")
        .when((kind == "with") & (all_of >= least_hits) & (among_hits >= LEAST_ODDS), "target")
        .when((kind == "threat") & (F.col("toxic") >= least_toxic) & (log_odds(clean, toxic) >= LEAST_ODDS), "threat")
    )
    got = rows.where("arc <> 'hit'").select(F.expr("substring(arc, instr(arc, ' ') + 1)").alias("word"), role.alias("role")).where("role is not null").groupBy("word").agg(F.min("role").alias("role")).collect()
    return {r["word"]: r["role"] for r in got}


def learn_lexicon(sample: DataFrame) -> Lexicon:
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon()
    insults = learn_insults(sample, n[0], n[1])
    return Lexicon(insults, learn_roles(sample, insults, n[0], n[1]))


def signatures(text: str) -> list[int]:
    """Three min-hashes over a text's 3-word windows."""
    words = text.split()
    found = {zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))}
    return [min((x * m + 0x9E3779B9) & 0xFFFFFFFF for x in found) for m in (1, 0x85EBCA6B, 0xC2B2AE35)]


def one_of_each_family(sample: DataFrame, key: str = "doc_id") -> DataFrame:
    """The bounded sample without copies: of documents that share a signature, the one with the smallest key.

    Else a family of near copies of one toxic document would make arcs of all its words.
    """
    rows = map_text(sample.select(key, "text", "label").withColumn("__of", F.col("text")), lambda: lambda texts: {"s": [signatures(t) for t in texts]}, "s array<long>", [key, "text", "label"], "__of")
    for k in range(3):
        rows = rows.groupBy(F.get("s", F.lit(k)).alias("__sig")).agg(F.min(F.struct(key, "label", "text", "s")).alias("__r")).select("__r.*")
    return rows


def featured(df: DataFrame, lexicon: Lexicon, keys: list[str], text: str = "text") -> DataFrame:
    def factory():
        grammar = Grammar(lexicon)
        return lambda texts: {"__x": [grammar.features(t) for t in texts]}

    return map_text(df, factory, "__x array<double>", keys, text)


def train(docs: DataFrame, labels: DataFrame, training: Column, label: str = "toxic", most: int = MOST_LABELLED) -> tuple[Lexicon, np.ndarray]:
    sample = labelled_sample(docs, labels, label, training, most)
    lexicon = learn_lexicon(materialize(one_of_each_family(sample), "toxic-sample"))  # bounded, as its source is
    rows = featured(sample, lexicon, ["label"]).collect()  # at most about MOST_LABELLED rows of a few numbers
    y = np.array([r["label"] for r in rows], dtype=float)
    if len(set(y)) < 2:
        return lexicon, SEED_WEIGHTS
    return lexicon, logistic(np.array([r["__x"] for r in rows]), y)


def toxicity(df: DataFrame, model: tuple[Lexicon, np.ndarray], keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """keys and score, one row per row of df; map-only."""
    lexicon, weights = model
    keys = keys or ["doc_id"]
    return featured(df, lexicon, keys, text).select(*keys, score(F.col("__x"), weights).alias("score"))


def score(x: Column, weights: np.ndarray) -> Column:
    z = F.lit(float(weights[-1])) + sum((F.get(x, F.lit(i)) * float(w) for i, w in enumerate(weights[:-1])), F.lit(0.0))
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
