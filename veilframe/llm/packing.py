"""Packing by shortest-pack-first over the length histogram.

Documents are tokenised and cut into pieces of at most a sequence's length. Only the histogram of piece lengths (one row
per length) reaches the driver. Lengths are placed longest first, each into the packs with the most free room; what is
kept are packing patterns and their counts. The patterns go back to the pieces by rank: the r-th piece of a length takes
the r-th place that the patterns have for that length.

Ranks are counted within (length, salt) groups and shifted by the groups' running sums, so that a very common length is
no single task's work. Defined cases: a null or empty text is the one end id; repeated rows are packed row by row; an
empty table gives an empty result; other columns are ignored. Long texts are tokenised whole.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, LongType

from veilframe.llm.common import cut, materialize

SEQUENCE = 1024
END_ID = 0
#: Pieces in a (length, salt) group, about; ranks are counted in one task for a group.
GROUP_ROWS = 4000
FIELDS = ("start", "length", "ids_crc32", "doc_tokens")


class ByteBpe:
    """Ids exactly as tokenizers gives them; tiktoken, which has the same merges as ranks, takes the common texts.

    Its pattern and the library's split alike on Latin text; all else (other scripts, unusual spaces, the special
    token's string, very long words) goes through the tokenizers library itself.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import base64
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        plain = text.isascii() or max(text) < "ƀ" and "\x85" not in text and "\xa0" not in text
        if plain and "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f") and (len(text) < 4000 or max(map(len, text.split()), default=0) < 2000):
            return self.fast.encode_to_numpy(text)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each document's ids with the end id, cut at multiples of sequence."""
    kept = df.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches):
        bpe = ByteBpe(vocabulary)
        for whole in batches:
            for b in cut(whole, "__text"):
                at, rows = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    ids = np.append(bpe.encode(t), END_ID).astype("<u4")
                    for s in range(0, len(ids), sequence):
                        part = ids[s : s + sequence]
                        at.append(i)
                        rows.append((s, len(part), zlib.crc32(part.tobytes()), len(ids)))
                cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), (), ()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], names=["__key", *FIELDS])

    schema = StructType([kept.schema["__key"], *[StructField(f, LongType()) for f in FIELDS]])
    return kept.mapInArrow(run, schema).withColumnRenamed("__key", key)


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(count, [(length, times), ...]) patterns for histogram[length] = number of pieces.

    Open patterns are kept by free room. A length goes into the pattern with the most room; if only some of its packs
    take a piece, it is split in two. New packs are opened once nothing has room.
    """
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    heap: list[int] = []  # negated rooms that may be open

    def put(r: int, count: int, runs: list[tuple[int, int]]) -> None:
        if count:
            room[r].append((count, runs))
            heapq.heappush(heap, -r)

    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left = histogram[length]
        while left:
            while heap and not room[-heap[0]]:
                heapq.heappop(heap)
            most = -heap[0] if heap else 0
            if most >= length:
                count, runs = room[most].pop()
                take = min(count, left)
                put(most, count - take, runs)
                following = next((r for r in range(most, 0, -1) if room[r]), 0)
                times = max(1, min((most - following) // length, most // length, left // take))
                put(most - times * length, take, [*runs, (length, times)])
                left -= take * times
            else:
                full, rest = divmod(left, sequence // length)
                put(sequence - sequence // length * length, full, [(length, sequence // length)])
                put(sequence - rest * length, bool(rest), [(length, rest)])
                left = 0
    return [x for r in sorted(room) for x in room[r]]


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank) of runs of places, their first sequence and their offset."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, runs in patterns:
        offset = 0
        for n, times in runs:
            for _ in range(times):
                out.append(((n << 40) | rank[n], sequence, offset))
                rank[n] += count
                offset += n
        sequence += count
    out.sort()
    return tuple(np.array(c, dtype=np.int64) for c in (zip(*out) if out else ((), (), ())))


def packed(df: DataFrame, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """pieces() with sequence_id and offset; the pieces are written once to the shared folder and read from there."""
    rows = materialize(pieces(df, key, text, sequence), "packing-pieces")
    counted = rows.groupBy("length").count().collect()  # at most one row per length
    patterns = shortest_pack_first({r["length"]: r["count"] for r in counted}, sequence)
    keys, base, offsets = places(patterns)
    salts = max(64, sum(r["count"] for r in counted) // GROUP_ROWS)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = groups.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    within = Window.partitionBy("length", "__salt").orderBy(key, "start", "ids_crc32")
    ranked = salted.withColumn("__rank", F.row_number().over(within)).join(shifts, ["length", "__salt"])

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        wanted = (length.to_numpy(np.int64) << 40) | rank.to_numpy(np.int64)
        at = np.searchsorted(keys, wanted, side="right") - 1
        return pd.DataFrame({"sequence_id": base[at] + (wanted - keys[at]), "offset": offsets[at]})

    out = ranked.withColumn("__place", place("length", F.col("__rank") - 1 + F.col("__shift")))
    return out.select(key, *FIELDS, "__place.sequence_id", "__place.offset")
