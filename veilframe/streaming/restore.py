"""Restoration of masked reply streams: per conversation, what may be the beginning of a replacement is held back.

A replacement that begins or ends with a word character is not read inside a longer word; the longest one wins, over
chunk borders too. Words that only differ by case, possessive or plural from one replacement are restored if no other
fits (fuzzy).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Endings that a reply may add to a replacement.
ENDINGS = ("'s", "’s", "'", "’", "es", "s")


def edged(replacement: str) -> str:
    """A pattern of the replacement that isn't part of a longer word."""
    before = r"(?<!\w)" if re.match(r"\w", replacement) else ""
    after = r"(?!\w)" if re.match(r"\w", replacement[-1]) else ""
    return before + re.escape(replacement) + after


class Restorer:
    """push() gives what is certain so far; finish() the rest. held and before carry on an earlier restorer."""

    def __init__(self, replacements: dict[str, str], held: str = "", before: str = "", fuzzy: bool = True):
        self.replacements = {k: v for k, v in replacements.items() if k}
        self.held, self.before, self.fuzzy, self.done, self.restored = held, before, fuzzy, False, 0
        ordered = sorted(self.replacements, key=len, reverse=True)
        self.longest = len(ordered[0]) if ordered else 0
        self.exact = re.compile("|".join(map(edged, ordered)) or r"(?!)")
        self.loose: dict[str, set[str]] = {}
        for k, v in self.replacements.items():
            self.loose.setdefault(k.lower(), set()).add(v)

    def push(self, chunk: str) -> str:
        if self.done:
            raise ValueError("push after finish")
        text = self.held + chunk
        end = self.certain(text) if self.replacements else len(text)
        return self.settle(text, end)

    def finish(self) -> str:
        self.done = True
        return self.settle(self.held, len(self.held))

    def certain(self, text: str) -> int:
        """How much of text no later chunk can change."""
        end = len(text)
        for a in range(max(0, end - self.longest), end):
            if any(k.startswith(text[a:]) for k in self.replacements):
                end = a
                break
        if self.fuzzy or re.match(r"\w", text[-1:]):
            end = min(end, len(text) - len(re.search(r"\S*\Z", text)[0]))
        whole = self.before + text
        for m in self.exact.finditer(whole, len(self.before)):
            if m.start() < len(self.before) + end < m.end():
                return m.start() - len(self.before)
        return end

    def settle(self, text: str, end: int) -> str:
        """text up to end restored; the rest is held."""
        whole, at, out = self.before + text, len(self.before), []
        stop = at + end
        for m in self.exact.finditer(whole, at):  # read with what follows stop, as edges depend on it
            if m.end() > stop:
                break
            out += [self.near(whole[at : m.start()]), self.replacements[m[0]]]
            self.restored += 1
            at = m.end()
        out.append(self.near(whole[at:stop]))
        self.before, self.held = whole[max(0, stop - 1) : stop], text[end:]
        return "".join(out)

    def near(self, text: str) -> str:
        return re.sub(r"\S+", lambda m: self.word(m[0]), text) if self.fuzzy and self.loose else text

    def word(self, word: str) -> str:
        """The word restored, if its forms without an ending lead to one value alone."""
        marks = [unicodedata.category(c)[0] == "P" for c in word]
        if all(marks):
            return word
        a, b = marks.index(False), len(word) - marks[::-1].index(False)
        core, ends = word[a:b], {}
        for ending in ("", *ENDINGS):
            if core.lower().endswith(ending):
                for value in self.loose.get(core[: len(core) - len(ending)].lower(), ()):
                    ends.setdefault(value, core[len(core) - len(ending) :])
        if len(ends) != 1:
            return word
        self.restored += 1
        ((value, ending),) = ends.items()
        return word[:a] + value + ("" if value.lower().endswith(ending.lower()) else ending) + word[b:]


def restore(text: str, replacements: dict[str, str], fuzzy: bool = True) -> str:
    r = Restorer(replacements, fuzzy=fuzzy)
    return r.push(text) + r.finish()


def restored_stream(chunks: DataFrame, replacements: dict[str, dict[str, str]], idle_ms: int | None = None) -> DataFrame:
    """(conv_id, seq, text) from chunks (conv_id, seq, chunk, last); state is the held-back tail of a conversation.

    A conversation's state goes with its last chunk, or, with idle_ms, after so long without a chunk; then its tail is
    given with the number of its newest chunk.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, before, seq = state.get if state.exists else ("", "", -1)
        r, ended = Restorer(replacements.get(str(key[0]), {}), held, before), False
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], seq, r.finish())], columns=["conv_id", "seq", "text"])
            return
        for f in frames:
            rows = []
            for c in f.sort_values("seq").itertuples():
                seq, ended = c.seq, bool(c.last)
                rows.append((key[0], seq, r.push(c.chunk) + (r.finish() if ended else "")))
                if ended:
                    r = Restorer(replacements.get(str(key[0]), {}))
            yield pd.DataFrame(rows, columns=["conv_id", "seq", "text"])
        if ended:
            state.remove()
            return
        state.update((r.held, r.before, int(seq)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, seq long, text string", "held string, before string, seq long", "append", timeout)
