"""Encoding and decoding with a merge-type piece model, exactly, by backtracking.

Per word: an Aho-Corasick automaton over the pieces gives the longest piece at each position. The longest piece is tried
first, then its ever shorter prefixes; a piece may follow another only if merging their concatenation anew gives these
two pieces back; positions from which no way leads on are marked failed in a bitfield and never tried again. Characters
without a piece become byte pieces and part a word. Runs of spaces, whose pieces share one rank, are merged directly.

Defined cases: a null or empty text is the begin and end ids alone; very long texts and words are encoded whole;
repeated rows are encoded row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame

from veilframe.llm.common import map_text

SPACE = "▁"
#: Words and pairs kept by a task; the store is emptied when full.
STORE = 600_000
RUNS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        normal = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.id = {p: i for p, i, _ in normal}
        self.score = {p: s for p, _, s in normal}
        self.piece = {i: p for p, i, _ in normal}
        self.characters = {p for p in self.id if len(p) == 1}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces of this model reach over words")
        # a piece that merging never makes can't be part of an encoding
        made = [p for p in self.id if self.merge(p) == [self.id[p]]]
        self.automaton = ahocorasick.Automaton()
        for p in made:
            self.automaton.add_word(p, (len(p), self.id[p]))
        self.automaton.make_automaton()
        made_set = set(made)
        self.shorter = {self.id[p]: next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in made_set), None) for p in made}
        self.words: dict[str, bytes] = {"": b""}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, text: str) -> list[int]:
        """Merging by the definition: the best-scored adjacent pair first, the leftmost of equals. Known characters only."""
        symbols: list[str | None] = list(text)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (s := self.score.get(pair := symbols[a] + symbols[b])) is not None:
                heapq.heappush(queue, (-s, a, b, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, pair = heapq.heappop(queue)
            if symbols[a] is None or symbols[b] is None or right[a] != b or symbols[a] + symbols[b] != pair:
                continue
            symbols[a], symbols[b] = pair, None
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self.id[s] for s in symbols if s is not None]

    def fits(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= STORE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.piece[a] + self.piece[b]) == [a, b]
        return known

    def backtrack(self, text: str) -> list[int]:
        """The encoding of a text of known characters."""
        longest: list[tuple[int, int]] = [(0, 0)] * len(text)
        for end, (n, i) in self.automaton.iter(text):
            if n > longest[at := end - n + 1][0]:
                longest[at] = (n, i)
        n, failed, out, at = len(text), bytearray(len(text) + 1), [], 0
        piece, shorter, fits = self.piece, self.shorter, self.fits
        token = longest[0][1]
        while at < n:
            end = at + len(piece[token])
            if not failed[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at][1] if at < n else 0
                continue
            less = shorter[token]
            while less is None:
                failed[at] = 1
                token = out.pop()
                at -= len(piece[token])
                # this piece ends where nothing leads on, so go on with its prefixes
                less = shorter[token]
            token = less
        return out

    def encode_word(self, word: str) -> list[int]:
        if word.startswith(SPACE * 2):
            encode = self.merge
        else:
            encode = self.backtrack
        if all(c in self.characters for c in word):
            return encode(word)
        out, start = [], 0
        for i, c in enumerate(word):
            if c not in self.characters:
                if start < i:
                    out += encode(word[start:i])
                out += [self.byte[b] for b in c.encode("utf-8")]
                start = i + 1
        return out + (encode(word[start:]) if start < len(word) else [])

    def encode(self, text: str) -> np.ndarray:
        """All ids with begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return np.array([self.begin, self.end], dtype="<u4")
        if "  " in text or SPACE in text or "\x01" in text or text[0] == " ":
            words = RUNS.findall(SPACE + text.replace(" ", SPACE))
        else:
            words = (SPACE + text.replace("\n", "\x01\n\x01").replace(" ", f"\x01{SPACE}")).split("\x01")
        store, parts = self.words, []
        for w in words:
            got = store.get(w)
            if got is None:
                got = np.array(self.encode_word(w), dtype="<u4").tobytes()
                if len(w) <= 64:
                    if len(store) >= STORE:
                        store.clear()
                        store[""] = b""
                    store[w] = got
            parts.append(got)
        edge = lambda i: i.to_bytes(4, "little")
        return np.frombuffer(b"".join([edge(self.begin), *parts, edge(self.end)]), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def encoded(df: DataFrame, path: str, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """keys, ids (binary, little-endian unsigned 32-bit) and decoded, one row per row of df; map-only."""

    def factory():
        model = PieceModel(path)

        def kernel(texts):
            ids = [model.encode(t) for t in texts]
            return {"ids": [i.tobytes() for i in ids], "decoded": [model.decode(i) for i in ids]}

        return kernel

    return map_text(df, factory, "ids binary, decoded string", keys or ["doc_id"], text)


def digests(df: DataFrame, path: str, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """keys, n_tokens, ids_sha256 and decoded_sha256, made in the kernel so that ids and texts needn't leave it."""

    def factory():
        model = PieceModel(path)

        def kernel(texts):
            ids = [model.encode(t) for t in texts]
            return {
                "n_tokens": [len(i) for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(model.decode(i).encode()).hexdigest() for i in ids],
            }

        return kernel

    return map_text(df, factory, "n_tokens long, ids_sha256 string, decoded_sha256 string", keys or ["doc_id"], text)
