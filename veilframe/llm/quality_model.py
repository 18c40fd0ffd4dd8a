"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good documents, at most MOST_POSITIVE by hash; the unlabelled web text is every document of
the table. A small network is trained in numpy to minimise the non-negative unbiased risk
    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]),
where a negative bracket is not fitted but stepped back from. Labels of bad documents are never used.

Training takes rounds over all documents' features, which are made once and written. In a round each task trains a copy
of the network on its documents against the positives, and the tasks' parameters are averaged, weighted by their rows.
The class prior is estimated from positives and unlabelled text alone: after ROUNDS rounds with a prior of one half, scores
of all documents and of the positives are counted in bins; the prior is the least ratio of the unlabelled to the positive
share above a score, over the scores that keep LEAST_COVERED of the positives, as above any score there are at least
prior * (share of positives) unlabelled documents. Then the rounds go on with this prior. The sigmoid of the margin is the
score; under the risk with the logistic loss it estimates the chance of a good document.

Defined cases: a null or empty text has all-zero counts and is scored like any other; very long texts are read whole;
repeated rows are scored row by row; of scores with equal ratios, the lowest is taken; without positives every score is 0.5;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import string
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import map_text, materialize
from veilframe.llm.learning import averaged_round, labelled_sample, packed_up, unpacked

#: Labelled good documents that learning uses at most.
MOST_POSITIVE = 6000
THRESHOLD = 0.3
HIDDEN, ROUNDS, BATCH, RATE, SEED = 12, 4, 256, 0.02, 7
#: Steps that a task takes at least in a round, by passing over its rows again.
LEAST_STEPS = 60
#: Bins of scores, and the share of positives above a score that the prior's ratio needs.
BINS, LEAST_COVERED = 200, 0.5

SYMBOLS = b"#*$%&|<>"
KEEP = {
    "upper": string.ascii_uppercase.encode(),
    "lower": string.ascii_lowercase.encode(),
    "digit": string.digits.encode(),
    "space": b" \t\n\r\x0b\x0c",
    "punct": b".,;:'\"()-",
    "loud": b"!?",
    "symbol": SYMBOLS + b"@^~_=+[]{}\\/`",
}
# a byte's class, for one histogram pass over a text
CLASS_OF = np.full(256, len(KEEP), dtype=np.intp)
for _k, _chars in enumerate(KEEP.values()):
    CLASS_OF[list(_chars)] = _k
SENTENCE = re.compile(r"[.!?]+\s")
FEATURES = len(KEEP) + 1 + 11


def features(text: str) -> list[float]:
    data = text.encode("utf-8", "replace")
    raw = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) if data else np.zeros(256)
    shares = np.bincount(CLASS_OF, weights=raw, minlength=len(KEEP) + 1) / max(1, len(data))
    words = data.split()
    n, kinds = len(words), len(set(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = list(zip(words, words[1:]))
    top = Counter(words).most_common(1)[0][1] if words else 0
    bad = int(raw[list(SYMBOLS)].sum())
    rest = [
        np.log1p(n) / 10,
        kinds / max(1, n),
        kinds / max(1.0, n**0.8),
        len(set(pairs)) / max(1, len(pairs)),
        sum(a == b for a, b in pairs) / max(1, len(pairs)),
        top / max(1, n),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(data) / max(1, len(lines))) / 10,
        len(data) / max(1, n) / 10,
        bad / max(1, n),
        len(SENTENCE.findall(text)) / max(1, n) * 10,
    ]
    return [float(v) for v in (*shares, *rest)]


def featured(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return map_text(df, lambda: lambda texts: {"__x": [features(t) for t in texts]}, "__x array<double>", keys, text)


class Network:
    """One hidden layer of tanh; parameters are plain arrays."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.shapes = [p.shape for p in self.p]

    def vector(self) -> np.ndarray:
        return packed_up(self.p)

    def load(self, vector: np.ndarray) -> None:
        self.p = [p.astype(float) for p in unpacked(vector, self.shapes)]

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return z, np.tanh(z @ self.p[0] + self.p[1])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[1] @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def gradient(self, x: np.ndarray, d_margin: np.ndarray) -> list[np.ndarray]:
        z, h = self.hidden(x)
        back = d_margin[:, None] * self.p[2] * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ d_margin, np.array([d_margin.sum()])]


def risk_gradient(net: Network, p: np.ndarray, u: np.ndarray, prior: float) -> list[np.ndarray]:
    """The gradient of the non-negative risk on a batch of positives and unlabelled rows, with the logistic loss."""
    sig = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    mp, mu = net.margin(p), net.margin(u)
    # loss(+) = log(1 + e^-m), loss(-) = log(1 + e^m)
    negative = np.logaddexp(0, mu).mean() - prior * np.logaddexp(0, mp).mean()
    gp_minus, gu_minus = -prior * sig(mp) / len(p), sig(mu) / len(u)
    if negative >= 0:
        parts = [(p, -prior * sig(-mp) / len(p) + gp_minus), (u, gu_minus)]
    else:
        parts = [(p, -gp_minus), (u, -gu_minus)]
    return [sum(g) for g in zip(*(net.gradient(x, d) for x, d in parts))]


def fit_rows(net: Network, positive: np.ndarray, unlabelled: np.ndarray, prior: float, rng: np.random.Generator, rate: float) -> None:
    """Adam steps over unlabelled rows in random order, each batch against drawn positives."""
    m, v, t = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p], 0
    while t < LEAST_STEPS:
        order = rng.permutation(len(unlabelled))
        for i in range(0, len(order), BATCH):
            u = unlabelled[order[i : i + BATCH]]
            p = positive[rng.integers(0, len(positive), min(BATCH, len(positive)))]
            t += 1
            for k, g in enumerate(risk_gradient(net, p, u, prior)):
                g = g + 1e-4 * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def rows_of(batch) -> np.ndarray:
    return batch.column(0).values.to_numpy(zero_copy_only=False).reshape(-1, FEATURES) if batch.num_rows else np.empty((0, FEATURES))


def round_over(net: Network, web: DataFrame, positive: np.ndarray, prior: float, turn: int) -> None:
    """One round over all rows of web (features); net gets the averaged parameters."""
    mean, scale = net.mean, net.scale

    def fit(vector, batches):
        from pyspark import TaskContext

        own, taken = Network(mean, scale), 0
        own.load(vector)
        rng = np.random.default_rng([SEED, turn, TaskContext.get().partitionId()])
        for b in batches:
            x = rows_of(b)
            if len(x):
                fit_rows(own, positive, x, prior, rng, RATE / (1 + turn))
                taken += len(x)
        return own.vector(), taken

    net.load(averaged_round(web, net.vector(), fit))


def estimated_prior(net: Network, web: DataFrame, positive: np.ndarray) -> float:
    """The least ratio of unlabelled to positive shares above a score; at most BINS rows reach the driver."""
    import pyarrow as pa

    def binned(batches):
        for b in batches:
            n = np.bincount(bins_of(net, rows_of(b)), minlength=BINS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(n)], names=["bin", "n"])

    u = np.zeros(BINS)
    for r in web.mapInArrow(binned, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        u[r["bin"]] = r["n"]
    p = np.bincount(bins_of(net, positive), minlength=BINS).astype(float)
    above = lambda n: np.cumsum(n[::-1])[::-1] / max(1.0, n.sum())
    u, p = above(u), above(p)
    ratios = u[p >= LEAST_COVERED] / p[p >= LEAST_COVERED]
    return float(np.clip(ratios.min() if len(ratios) else 0.5, 0.01, 0.99))


def bins_of(net: Network, x: np.ndarray) -> np.ndarray:
    return np.minimum((net.score(x) * BINS).astype(int), BINS - 1)


def train(docs: DataFrame, labels: DataFrame, training: Column, label: str = "quality", most: int = MOST_POSITIVE, key: str = "doc_id") -> Network | float:
    """A fitted network, or a constant score where there are no positives."""
    good = labels.where(F.col(label) == 1)
    rows = featured(labelled_sample(docs, good, label, training, most, key), []).collect()  # at most about MOST_POSITIVE rows
    positive = np.array([r["__x"] for r in rows]).reshape(-1, FEATURES)
    if not len(positive):
        return 0.5
    web = materialize(featured(docs, []), "pu-features")
    sums = web.select(*[F.get("__x", F.lit(i)).alias(f"x{i}") for i in range(FEATURES)]).agg(*[f(f"x{i}") for i in range(FEATURES) for f in (F.avg, F.stddev_pop)]).first()
    net = Network(np.array(sums[0::2], dtype=float), np.array(sums[1::2], dtype=float) + 1e-3)
    prior = 0.5
    for turn in range(2 * ROUNDS):
        if turn == ROUNDS:
            prior = estimated_prior(net, web, positive)
        round_over(net, web, positive, prior, turn % ROUNDS)
    net.prior = prior
    return net


def quality_scores(df: DataFrame, model: Network | float, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """keys and score, one row per row of df; map-only."""

    def factory():
        def kernel(texts):
            if isinstance(model, float):
                return {"score": [model] * len(texts)}
            x = np.array([features(t) for t in texts]).reshape(-1, FEATURES)
            return {"score": model.score(x)}

        return kernel

    return map_text(df, factory, "score double", keys or ["doc_id"], text)
