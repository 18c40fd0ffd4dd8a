"""Exact top-k search: BM25 over an inverted index with block-max WAND, per shard, merged by global statistics.

A shard is a chunk of the documents that a task reads. Its index has, for each query term, the postings in id order with
their scores and the largest score and last document of each block. Document counts, mean length and document frequencies
are those of the whole table, counted in a pass before, so that scores of different shards compare and the merge of the
shards' top k is the exact top k. Scores are rounded to DIGITS before they are ranked; ties go to the smaller id.

WAND skips little when a query has hundreds of terms, as most documents hold some of them. Queries of more than MOST_WAND
distinct words therefore sum the scores of all postings of their terms by document; no document is passed over.

Terms are the distinct words of a text, split at white space, A-Z lowered. Queries are taken in blocks of QUERY_BLOCK, so
what goes to the tasks is bounded. Defined cases: a query without words, or without a word of the table, has no rows;
null ids and null texts of documents are left out or read as empty; repeated rows are repeated results; an empty table
gives an empty result; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import KERNEL_BYTES, cut, materialize

K1, B, DIGITS, POSTING_BLOCK, QUERY_BLOCK = 1.2, 0.75, 6, 64, 1000
SLACK = 10.0**-DIGITS
#: Queries of more distinct words are summed over all postings instead of walked by WAND; both give the exact top k.
MOST_WAND = 64


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def statistics(docs: DataFrame, terms: set[bytes]) -> tuple[int, float, dict[bytes, int]]:
    """Documents, mean words and document frequencies of terms; at most one row per term and task is shuffled."""

    def run(batches):
        n = total = 0
        df: Counter = Counter()
        for b in batches:
            for t in b.column(1).to_pylist():
                w = words(t)
                n, total = n + 1, total + len(w)
                df.update(terms.intersection(w))
        keys = list(df)
        yield pa.RecordBatch.from_arrays([pa.array([None, *keys], pa.binary()), pa.array([n, *df.values()], pa.int64()), pa.array([total, *[0] * len(keys)], pa.int64())], names=["term", "n", "total"])

    rows = docs.mapInArrow(run, "term binary, n long, total long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    head = next((r for r in rows if r["term"] is None), None)
    n, total = (head["n"], head["total"]) if head else (0, 0)
    return n, total / n if n else 0.0, {bytes(r["term"]): r["n"] for r in rows if r["term"] is not None}


class Postings:
    """A term's documents in order, their scores, and the last document and largest score of each block."""

    __slots__ = ("docs", "scores", "last", "block_max", "most", "at", "order")

    def __init__(self, docs: np.ndarray, scores: np.ndarray):
        self.docs, self.scores = docs.tolist(), scores.tolist()
        starts = range(0, len(docs), POSTING_BLOCK)
        self.last = [self.docs[min(s + POSTING_BLOCK, len(docs)) - 1] for s in starts]
        self.block_max = [float(scores[s : s + POSTING_BLOCK].max()) for s in starts]
        self.most = max(self.block_max)


class Cursor:
    __slots__ = ("p", "at", "doc", "order")

    def __init__(self, p: Postings, order: int):
        self.p, self.at, self.doc, self.order = p, 0, p.docs[0], order

    def seek(self, doc: int) -> None:
        self.at = bisect_left(self.p.docs, doc, self.at)
        self.doc = self.p.docs[self.at] if self.at < len(self.p.docs) else END

    def block(self, doc: int) -> int:
        return bisect_left(self.p.last, doc, self.at // POSTING_BLOCK)


END = 1 << 60


def top_k(lists: list[Postings], k: int) -> list[tuple[float, int]]:
    """The k best (score, document) of a shard, by block-max WAND."""
    cursors = [Cursor(p, i) for i, p in enumerate(lists)]
    heap: list[tuple[float, int]] = []  # (score, -doc)
    theta = -math.inf
    while True:
        cursors = [c for c in cursors if c.doc < END]
        cursors.sort(key=lambda c: c.doc)
        bound, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            bound += c.p.most
            if bound > theta - SLACK:
                pivot = i
                break
        if pivot < 0:
            break
        doc = cursors[pivot].doc
        while pivot + 1 < len(cursors) and cursors[pivot + 1].doc == doc:
            pivot += 1
        blocks = [(c, c.block(doc)) for c in cursors[: pivot + 1]]
        if sum(c.p.block_max[b] for c, b in blocks if b < len(c.p.last)) <= theta - SLACK:
            # no document up to the nearest block end can enter
            ends = [c.p.last[b] + 1 for c, b in blocks if b < len(c.p.last)]
            following = min([*ends, cursors[pivot + 1].doc if pivot + 1 < len(cursors) else END])
            for c, _ in blocks:
                c.seek(max(following, doc + 1) if following <= doc else following)
            continue
        if cursors[0].doc == doc:
            hits = sorted((c.order, c.p.scores[c.at]) for c in cursors[: pivot + 1])
            score = round(math.fsum(s for _, s in hits), DIGITS)
            if len(heap) < k:
                heapq.heappush(heap, (score, -doc))
            elif score > heap[0][0]:
                heapq.heapreplace(heap, (score, -doc))
            if len(heap) == k:
                theta = heap[0][0]
            for c in cursors[: pivot + 1]:
                c.seek(doc + 1)
        else:
            for c in cursors[: pivot + 1]:
                if c.doc < doc:
                    c.seek(doc)
    return sorted(((s, -d) for s, d in heap), key=lambda x: (-x[0], x[1]))


def top_k_of_sums(lists: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[float, int]]:
    """The k best (score, document) of a shard from (documents, scores) of each term, summed by document in term order."""
    sums = np.bincount(np.concatenate([d for d, _ in lists]), np.concatenate([s for _, s in lists]))
    least = np.partition(sums, -k)[-k] - 2 * SLACK if len(sums) > k else 0.0
    best = [(round(float(sums[d]), DIGITS), d) for d in np.flatnonzero((sums >= least) & (sums > 0)).tolist()]
    return sorted(best, key=lambda x: (-x[0], x[1]))[:k]


def shard_index(ids: list, texts: list[str], idf: dict[bytes, float], mean: float) -> tuple[list, dict[bytes, tuple[np.ndarray, np.ndarray]]]:
    """The shard's ids in order and, for each term in idf, its documents in order with their scores."""
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    number = {t: i for i, t in enumerate(idf)}
    terms, times = array("q"), array("q")
    lengths, kinds = np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
    for d, i in enumerate(order):
        w = words(texts[i])
        c = Counter([number[x] for x in w if x in number])
        lengths[d], kinds[d] = len(w), len(c)
        terms.extend(c)
        times.extend(c.values())
    t, d, tf = np.frombuffer(terms, dtype=np.int64), np.repeat(np.arange(len(ids)), kinds), np.frombuffer(times, dtype=np.int64).astype(float)
    by = np.argsort(t, kind="stable")
    t, d, tf = t[by], d[by], tf[by]
    scores = np.array(list(idf.values()))[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[d] / mean)) if len(t) else tf
    edges = np.searchsorted(t, np.arange(len(idf) + 1)).tolist()
    return [ids[i] for i in order], {w: (d[a:b], scores[a:b]) for w, a, b in zip(idf, edges, edges[1:]) if b > a}


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query; queries come in blocks of QUERY_BLOCK rows."""
    held = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind, query_kind = held.schema["__key"].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    out = None
    wanted = queries.where(F.col(query_key).isNotNull()).select(query_key, query_text).orderBy(query_key)
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    block: list = []
    for r in [*wanted.toLocalIterator(), None]:
        if r is not None:
            block.append((r[0], sorted(set(words(r[1])))))
        if block and (r is None or len(block) == QUERY_BLOCK) or r is None and out is None:
            part = search_block(held, block, k, kind, query_kind)
            if r is not None or out is not None:
                # of several blocks, each is written, so that one plan holds the terms of one block only
                part = materialize(ranked(part).drop("rank"), "bm25-block")
            out, block = part if out is None else out.unionByName(part), []
    return ranked(out)


def search_block(held: DataFrame, block: list, k: int, kind: str, query_kind: str) -> DataFrame:
    terms = {t for _, ts in block for t in ts}
    n, mean, df = statistics(held, terms)
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}

    def run(batches):
        for whole in batches:
            for b in cut(whole, "__text", 2 * KERNEL_BYTES):
                ids, index = shard_index(b.column(0).to_pylist(), b.column(1).to_pylist(), idf, mean)
                rows, walked = [], {}
                for q, ts in block:
                    if not (held_terms := [t for t in ts if t in index]):
                        continue
                    if len(ts) > MOST_WAND:
                        found = top_k_of_sums([index[t] for t in held_terms], k)
                    else:
                        for t in held_terms:
                            if t not in walked:
                                walked[t] = Postings(*index[t])
                        found = top_k([walked[t] for t in held_terms], k)
                    rows += [(q, ids[d], s) for s, d in found]
                cols = list(zip(*rows)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_pydict({"query_id": cols[0], "doc_id": cols[1], "score": cols[2]}, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"query_id {query_kind}, doc_id {kind}, score double"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return held.mapInArrow(run, schema)


SQL = """
WITH q AS (SELECT DISTINCT item_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+')) AS term FROM benchmark WHERE item_id % 20 = 0),
d AS (SELECT doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+')) AS term FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term <> '' GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS dl FROM t GROUP BY ALL),
g AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM l) / (SELECT count(*) FROM documents) AS mean),
f AS (SELECT term, count(*) AS df FROM t GROUP BY ALL),
s AS (SELECT q.item_id AS query_id, t.doc_id, round(sum(ln(1 + (g.n - f.df + 0.5) / (f.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.dl / g.mean))), 6) AS score
FROM q JOIN t USING (term) JOIN f USING (term) JOIN l ON l.doc_id = t.doc_id CROSS JOIN g WHERE q.term <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""
