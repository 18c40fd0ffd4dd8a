"""A log-bilinear language model, trained in numpy by noise-contrastive estimation, with whole-corpus counts below it.

The network's vocabulary is the most frequent words, VOCABULARY at most, and a symbol for each shape of rarer words. A
context vector is the sum of the position-weighted vectors of the two symbols before. Symbols are dealt by frequency to
GROUPS groups, so that a token's probability is
    P(group | context) * P(symbol | group, context) [* P(word | shape) for a rarer word],
where the first two are log-bilinear: products of the context vector with the groups' or the symbols' vectors plus
biases, normalised over all groups, or all symbols of the group. A batch of contexts is one matrix product for the groups
and one for each group's symbols. Under a shape, a word has its smoothed share (c + 1) / (N_shape + V_shape + 1) of counts
over all training documents.

Training takes every token of all training documents once. ROUNDS rounds share the documents out by a hash of their texts; in
a round, each task trains a copy of the network on all tokens of the round's documents that it reads, and the tasks'
parameters are averaged, weighted by their examples. Both levels are trained by noise-contrastive estimation: a batch
shares NOISE_GROUPS draws of groups, and each token is told from NOISE_WORDS draws of its group's symbols.

The counts of the KNOWN_WORDS most frequent words go to the tasks (a bound by number and word length); all other words of
a document are joined with the count table.

Defined cases: a null or empty text is its end token alone; very long texts are read whole; repeated rows are scored row
by row; words of equal counts are ranked by their bytes; a null id counts as training; with no training rows all
probabilities are uniform over the symbols; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import KERNEL_BYTES, cut, materialize
from veilframe.llm.learning import averaged_round, packed_up, unpacked

VOCABULARY, SHAPES, GROUPS = 16_384, 16, 128
WIDTH, NOISE_GROUPS, NOISE_WORDS, BATCH, RATE, SEED = 24, 64, 3, 2048, 0.3, 11
ROUNDS, BLOCK = 2, 32
KNOWN_WORDS, KNOWN_BYTES = 250_000, 48
#: Distinct words that a counting task holds before it hands them on; tokens that are scored at a time, and that meet all groups at a time.
HELD_WORDS, SCORED, GROUP_BATCH = 400_000, 1 << 15, 1 << 10
END = b"\n"  # the end token; no word has white space


def tokens(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "replace").lower().split(), END]


def shape(word: bytes) -> int:
    """The symbol of a rare word: length, a last character that isn't a letter or digit, characters beyond ASCII."""
    n = len(word)
    return (0 if n <= 4 else 1 if n <= 7 else 2 if n <= 11 else 3) * 4 + 2 * (word[-1] < 128 and not word[-1:].isalnum()) + (not word.isascii())


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) of all tokens of docs: counted in each task, then summed by one shuffle."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()
            return out

        for whole in batches:
            for b in cut(whole, "__text"):
                for t in b.column(0).to_pylist():
                    held.update(tokens(t))
                    if len(held) > HELD_WORDS:
                        yield flush()
        yield flush()

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame) -> dict[bytes, int]:
    """The counts of at most KNOWN_WORDS frequent words of at most KNOWN_BYTES bytes, most frequent first.

    A histogram of the logarithms of counts gives the least count, so that no task sends more than its share of them.
    """
    short = counts.where(F.length("word") <= KNOWN_BYTES).withColumn("step", F.floor(F.log2("c") * 16))
    left, least = KNOWN_WORDS, 0
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):  # at most about 1000 rows
        left -= r["count"]
        if left < 0:
            least = r["step"] + 1
            break
    got = short.where(F.col("step") >= least).select("word", "c").toArrow()
    return dict(sorted(zip(got["word"].to_pylist(), got["c"].to_pylist()), key=lambda x: (-x[1], x[0])))


def shape_totals(counts: DataFrame, listed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each shape of rarer words; SHAPES rows reach the driver."""
    own = set(listed)

    def run(batches):
        n, v = [0] * SHAPES, [0] * SHAPES
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w not in own:
                    k = shape(w)
                    n[k] += c
                    v[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(SHAPES), pa.int32()), pa.array(n, pa.int64()), pa.array(v, pa.int64())], names=["k", "n", "v"])

    got = counts.mapInArrow(run, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in got:
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    return n, v


class Reader:
    """Words to numbers: known words by rank, and the symbols of all known words and of shapes, which are ordered by mass."""

    def __init__(self, known: dict[bytes, int], symbol_of_rank: np.ndarray, symbol_of_shape: np.ndarray):
        self.rank = {w: i for i, w in enumerate(known)}
        self.symbol_of_rank, self.symbol_of_shape = np.append(symbol_of_rank, -1), symbol_of_shape  # rank -1 reads the last

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """A known word's rank, -1 for others."""
        return np.fromiter(map(self.rank.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def symbols(self, words: list[bytes], ranks: np.ndarray) -> np.ndarray:
        out = self.symbol_of_rank[ranks]
        rare = np.flatnonzero(out < 0)
        out[rare] = self.symbol_of_shape[[shape(words[i]) for i in rare.tolist()]]
        return out


def contexts(s: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before each token; start before the first."""
    one = np.concatenate([[start], s[:-1]])
    return one, np.concatenate([[start], one[:-1]])


def by_number(index: np.ndarray) -> np.ndarray:
    """The order of symbols' numbers; 16 bits hold them all, and are sorted by radix."""
    return np.argsort(index.astype(np.uint16), kind="stable")


def summed_rows(index: np.ndarray, rows: np.ndarray, of: np.ndarray | None = None, factor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of index, and the sums by them of rows, or of rows[of] times factor."""
    order = by_number(index)
    ordered = index[order]
    firsts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    taken = rows.take(order if of is None else of[order], axis=0)
    if factor is not None:
        taken *= factor[order, None]
    # most numbers occur once; only the others' rows are added up
    times = np.diff(firsts, append=len(index))
    sums, many = taken.take(firsts, axis=0), np.flatnonzero(times > 1)
    if len(many):
        some = times[many]
        starts = np.cumsum(some) - some
        sums[many] = np.add.reduceat(taken.take(np.arange(some.sum()) + np.repeat(firsts[many] - starts, some), axis=0), starts, axis=0)
    return ordered[firsts], sums


def alias_table(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walker's table: a place of the n drawn evenly is kept with chance keep, else exchanged for other; both give share."""
    n = len(share)
    left, keep, other = share / share.sum() * n, np.ones(n), np.arange(n)
    small, large = [i for i in range(n) if left[i] < 1], [i for i in range(n) if left[i] >= 1]
    while small and large:
        a, b = small.pop(), large.pop()
        keep[a], other[a] = left[a], b
        left[b] -= 1 - left[a]
        (small if left[b] < 1 else large).append(b)
    return keep, other


class LogBilinear:
    """Context vectors r, position weights c1 and c2, vectors of groups (g) and of symbols (q), each with its bias last.

    mass: the symbols' tokens, plus one each, in falling order; the symbols of a group follow each other.
    """

    NAMES = ("r", "c1", "c2", "g", "q")

    def __init__(self, mass: np.ndarray, seed: int = SEED):
        v = len(mass)
        share = mass / mass.sum()
        root = np.cumsum(np.sqrt(share)) / np.sqrt(share).sum()
        _, self.group = np.unique(np.minimum((root - 1e-12) * GROUPS, GROUPS - 1).astype(int), return_inverse=True)
        groups = int(self.group[-1]) + 1
        self.edges = np.searchsorted(self.group, np.arange(groups + 1))
        self.group_share = np.add.reduceat(share, self.edges[:-1])
        tables = [alias_table(share[a:b]) for a, b in zip(self.edges, self.edges[1:])]
        self.keep, self.other = np.concatenate([k for k, _ in tables]), np.concatenate([o + a for (_, o), a in zip(tables, self.edges)])
        self.log_in_group = np.log(share / self.group_share[self.group]).astype(np.float32)
        self.log_group = np.log(self.group_share).astype(np.float32)
        self.shapes = [(v + 1, WIDTH), (WIDTH,), (WIDTH,), (groups, WIDTH + 1), (v, WIDTH + 1)]
        rng = np.random.default_rng(seed)
        draw = lambda n: rng.normal(0, 0.1, (n, WIDTH))
        self.p = dict(zip(self.NAMES, [draw(v + 1), np.ones(WIDTH), np.full(WIDTH, 0.5), np.c_[draw(groups), self.log_group], np.c_[draw(v), self.log_in_group]]))
        self.load(self.vector())

    def vector(self) -> np.ndarray:
        return packed_up([self.p[n] for n in self.NAMES])

    def load(self, vector: np.ndarray) -> None:
        self.p = dict(zip(self.NAMES, unpacked(vector, self.shapes)))
        self.square = {n: np.full_like(x, 1e-3) for n, x in self.p.items()}

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The vectors of contexts, and a last 1 for the bias."""
        out = np.ones((len(one), WIDTH + 1), dtype=np.float32)
        np.add(one, two, out=out[:, :WIDTH])
        return out

    def step(self, one: np.ndarray, two: np.ndarray, w: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """A batch of noise-contrastive estimation on both levels, by gradients scaled by their past squares."""
        p, n, k = self.p, len(w), NOISE_GROUPS
        sig = lambda s: 1 / (1 + np.exp(-s))
        r_one, r_two = p["r"].take(one, axis=0), p["r"].take(two, axis=0)
        h, group, every = self.hidden(r_one * p["c1"], r_two * p["c2"]), self.group[w], np.arange(n)
        # groups: one set of draws for the batch, and each token's own; d has a row for each token and a column for each drawn group
        scale, shift = np.float32(n**-0.5), math.log(k) + self.log_group
        times = np.bincount(rng.choice(len(self.log_group), k, p=self.group_share), minlength=len(self.log_group)).astype(np.float32)
        drawn = np.flatnonzero(times)
        g, own = p["g"].take(drawn, axis=0), p["g"].take(group, axis=0)
        d = sig(h @ g.T - shift[drawn]) * (times[drawn] * scale)
        d_own = (sig(np.einsum("nd,nd->n", h, own) - shift[group]) - 1) * scale
        dh = d @ g + own * d_own[:, None]
        of_group = np.zeros_like(p["g"])
        of_group[drawn] = d.T @ h
        at, x = summed_rows(group, h, every, d_own)
        of_group[at] += x
        grad = {"g": (np.arange(len(self.log_group)), of_group)}
        # symbols of the token's group: draws for each token
        first = self.edges[group]
        place = rng.random((n, NOISE_WORDS)) * (self.edges[group + 1] - first)[:, None]
        drawn = place.astype(np.int64)
        place -= drawn
        drawn += first[:, None]
        words = np.concatenate([w[:, None], np.where(place < self.keep.take(drawn), drawn, self.other.take(drawn))], 1)
        vectors = p["q"].take(words, axis=0)
        s = np.einsum("nd,nkd->nk", h, vectors) - math.log(NOISE_WORDS) - self.log_in_group.take(words)
        d = sig(s).astype(np.float32)
        d[:, 0] -= 1
        d *= scale
        dh = (dh + np.einsum("nk,nkd->nd", d, vectors))[:, :WIDTH]
        grad["q"] = summed_rows(words.ravel(), h, np.repeat(every, words.shape[1]), d.ravel())
        whole = np.arange(WIDTH)
        grad["c1"], grad["c2"] = (whole, (dh * r_one).sum(0)), (whole, (dh * r_two).sum(0))
        grad["r"] = summed_rows(np.concatenate([one, two]), np.concatenate([dh * p["c1"], dh * p["c2"]]))
        for name, (at, x) in grad.items():
            square = self.square[name].take(at, axis=0) + x * x
            self.square[name][at] = square
            x /= np.sqrt(square, out=square)
            p[name][at] -= np.float32(rate) * x

    def log10(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(symbol | contexts), normalised by batched matrix products."""
        p, out, ends = self.p, np.empty(len(w)), self.edges.tolist()
        g_t, q_t = np.ascontiguousarray(p["g"].T), np.ascontiguousarray(p["q"].T)
        r_one, r_two = p["r"] * p["c1"], p["r"] * p["c2"]
        for a in range(0, len(w), SCORED):
            # in order of groups, so that a group's tokens are one slice
            order = a + by_number(w[a : a + SCORED])
            symbol = w[order]
            h, group, every = self.hidden(r_one.take(one[order], axis=0), r_two.take(two[order], axis=0)), self.group[symbol], np.arange(len(order))
            got = np.empty(len(order))
            for b in range(0, len(order), GROUP_BATCH):
                sl = slice(b, b + GROUP_BATCH)
                scores = h[sl] @ g_t
                got[sl] = scores[every[: len(scores)], group[sl]] - log_sum(scores)
            edges = np.searchsorted(group, range(len(self.log_group) + 1)).tolist()
            for k, (b, c) in enumerate(zip(edges, edges[1:])):
                first, last = ends[k], ends[k + 1]
                if c > b and last - first > 1:
                    scores = h[b:c] @ q_t[:, first:last]
                    got[b:c] += scores[every[: c - b], symbol[b:c] - first] - log_sum(scores)
            out[order] = got
        return out / math.log(10)


def log_sum(scores: np.ndarray) -> np.ndarray:
    """log of the sums of exponentials of rows; noise-contrastive scores are near log-probabilities, so few need scaling."""
    with np.errstate(over="ignore", invalid="ignore"):
        total = np.exp(scores) @ np.ones(scores.shape[1], dtype=scores.dtype)
    if np.isfinite(total).all() and total.all():
        return np.log(total)
    most = scores.max(1)
    return most + np.log(np.exp(scores - most[:, None]).sum(1))


def train(model: LogBilinear, training: DataFrame, reader: tuple, rounds: int = ROUNDS) -> None:
    """Rounds over the rows of training (__text), which take each token once; see the module's docstring."""
    shared = training.sparkSession.sparkContext.broadcast(reader)
    net_of = {k: x for k, x in vars(model).items() if k not in ("p", "square")}
    for turn in range(rounds):
        mine = F.pmod(F.crc32(F.col("__text").cast("binary")), F.lit(rounds)) == turn

        def fit(vector: np.ndarray, batches, turn=turn) -> tuple[np.ndarray, int]:
            read, net = Reader(*shared.value), LogBilinear.__new__(LogBilinear)
            vars(net).update(net_of)
            net.load(vector)
            start, taken = len(net.group), 0
            rng = np.random.default_rng([SEED, turn, TaskContext.get().partitionId()])
            held: list[np.ndarray] = []

            def learn() -> None:
                x = np.concatenate(held)
                x = x[rng.permutation(len(x))]
                for a in range(0, len(x), BATCH):
                    with np.errstate(over="ignore"):  # a score far below zero is a chance of 0
                        net.step(x[a : a + BATCH, 0], x[a : a + BATCH, 1], x[a : a + BATCH, 2], rng, RATE / (1 + turn))
                held.clear()

            for whole in batches:
                for b in cut(whole, "__text"):
                    x = examples(b.column(0).to_pylist(), read, start, 1.0, turn)
                    held.append(x)
                    taken += len(x)
                    if sum(map(len, held)) >= 64 * BATCH:
                        learn()
            if sum(map(len, held)):
                learn()
            return net.vector(), taken

        model.load(averaged_round(training.where(mine), model.vector(), fit))
    shared.unpersist()


def examples(texts: list[str], read: Reader, start: int, share: float, turn: int) -> np.ndarray:
    """(one before, two before, symbol) rows of the texts, or of random blocks of them; a block's first tokens see those before it."""
    flat: list[bytes] = []
    heads, inner = [], []
    for t in texts:
        words = tokens(t)
        if share >= 1:
            heads.append(len(flat))
            flat += words
            continue
        for a in random_blocks(t, len(words), share, turn):
            (inner if a else heads).append(len(flat))
            flat += words[max(0, a - 2) : a + BLOCK]
    if not flat:
        return np.empty((0, 3), dtype=np.int64)
    s = read.symbols(flat, read.ranks(flat))
    one, two = contexts(s, start)
    head, other, keep = np.array(heads, dtype=np.int64), np.array(inner, dtype=np.int64), np.ones(len(s), dtype=bool)
    one[head] = two[head] = start
    two[np.minimum(head + 1, len(s) - 1)] = start
    keep[other] = keep[other + 1] = False  # they are context only
    return np.stack([one, two, s], 1)[keep]


def random_blocks(text: str, n: int, share: float, turn: int) -> list[int]:
    """Where blocks of BLOCK tokens begin: every block of a text of n tokens is taken with chance `share`, from the text alone."""
    seed = zlib.crc32(text.encode("utf-8", "replace")) + 0x9E3779B9 * turn
    drawn = (np.arange(1, -(-n // BLOCK) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.flatnonzero((drawn >> np.uint64(40)) < int(share * (1 << 24))) * BLOCK).tolist()


def lm_scores(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("__key"), held.alias("__held"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    training = docs.where(~F.col("__held"))
    counts = materialize(count_words(training, "__text"), "lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    # at most KNOWN_WORDS words of at most KNOWN_BYTES bytes reach the driver and the tasks
    known = frequent_words(counts)
    listed = list(known)[: VOCABULARY - SHAPES]
    shape_n, shape_v = shape_totals(counts, listed)
    mass = np.concatenate([[known[w] for w in listed], shape_n]) + 1.0
    order = np.argsort(-mass, kind="stable")
    place = np.empty(len(mass), dtype=np.int64)
    place[order] = np.arange(len(mass))
    model = LogBilinear(mass[order])
    of_shape = place[len(listed) :]
    rarer = [shape(w) for w in list(known)[len(listed) :]]
    reader = (known, np.concatenate([place[: len(listed)], of_shape[rarer]]) if rarer else place[: len(listed)], of_shape)
    if n:
        train(model, training.select("__text"), reader)
    log_shape = np.zeros(len(mass))
    log_shape[of_shape] = np.log10(shape_n + shape_v + 1.0)
    is_shape = np.zeros(len(mass), dtype=bool)
    is_shape[of_shape] = True
    shared = spark.sparkContext.broadcast((reader, model, log_shape, is_shape))
    base_n = math.log10(n + v + 1)

    def run(batches):
        reader, net, log_shape, is_shape = shared.value
        read = Reader(*reader)
        log_count = np.log10(np.array(list(reader[0].values()), dtype=float) + 1)
        start, part, row = len(net.group), TaskContext.get().partitionId(), 0
        names = ["uid", "__key", "__held", "n_tokens", "n_known", "base", "score", "words", "times"]
        for whole in batches:
            for b in cut(whole, "__text", KERNEL_BYTES // 2):
                sizes, ranks, symbols, ones, twos, rest = [], [], [], [], [], []
                for t in b.column(2).to_pylist():
                    words = tokens(t)
                    r = read.ranks(words)
                    s = read.symbols(words, r)
                    one, two = contexts(s, start)
                    sizes.append(len(words))
                    rest.append(Counter([words[i] for i in np.flatnonzero(r < 0).tolist()]))
                    for held_parts, x in zip((ranks, symbols, ones, twos), (r, s, one, two)):
                        held_parts.append(x)
                if not sizes:
                    continue
                r, s, one, two = (np.concatenate(x) for x in (ranks, symbols, ones, twos))
                firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                is_known = r >= 0
                logs = np.where(is_known, log_count[np.clip(r, 0, None)], 0.0) if len(log_count) else np.zeros(len(r))
                sums = lambda x: np.add.reduceat(x, firsts)  # noqa: B023, E731
                score = sums(net.log10(one, two, s) - log_shape[s] + np.where(is_shape[s], logs, 0.0))
                arrays = [
                    pa.array([part << 40 | row + i for i in range(len(sizes))], pa.int64()), b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(sums(is_known.astype(np.int64)), pa.int64()),
                    pa.array(sums(logs) - base_n * np.array(sizes), pa.float64()), pa.array(score, pa.float64()), pa.array([list(c) for c in rest], pa.list_(pa.binary())), pa.array([list(c.values()) for c in rest], pa.list_(pa.int32())),
                ]
                row += len(sizes)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema["__key"].dataType.simpleString()
    rows = materialize(docs.select("__key", "__held", "__text").mapInArrow(run, f"uid long, __key {kind}, __held boolean, n_tokens long, n_known long, base double, score double, words array<binary>, times array<int>"), "lm-rows")
    # an unknown word counts 0 and adds log10(1) = 0, so the join is an inner one
    rest = rows.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", "x.words", "x.times").join(counts, F.col("words") == F.col("word"))
    sums = rest.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("more_known"))
    out = rows.drop("words", "times").join(sums, "uid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(F.col("__key").alias(key), F.col("__held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
