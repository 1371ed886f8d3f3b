"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The words of every document run through the automaton once; after each word the state tells the longest suffix of the text
read so far that occurs in some item. Where that match is long enough to cover a window (``WINDOW`` consecutive item words, or
a shorter item as a whole), the window's words are hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_at_space, fresh, shared, sliced

WINDOW = 10
#: Item words per automaton; a larger benchmark takes one pass of the documents for each such part.
AUTOMATON_WORDS = 200_000
_FOLD = bytes((b | 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and characters beyond ASCII."""
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """All factors of all items. Per state: transitions, suffix link, length of its longest factor.

    ``at_window[s]`` names the ancestor of ``s`` (or ``s``) that holds factors of WINDOW words, -1 if matches there are shorter;
    ``items[s]`` the items in which such an ancestor's factors occur; ``short[s]`` the short items that are suffixes of its factors,
    as (length, item, state).
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window_length = window
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        short: list[tuple[int, int, list[int]]] = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if 0 < len(ids) < window:
                short.append((len(ids), number.get(name, -1), ids))
            last = 0
            for w in ids:
                last = self._extend(last, w, ends)
                if name is not None:
                    ends[last].add(number[name])
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for s in reversed(order):
            ends[self.link[s]] |= ends[s]
        own: dict[int, list] = {}
        for n, name, ids in short:
            s = 0
            for w in ids:
                s = self.next[s][w]
            own.setdefault(s, []).append((n, name))
        self.at_window, self.short = [-1] * len(self.link), [()] * len(self.link)
        for s in order:
            up = self.link[s]
            self.at_window[s] = self.at_window[up] if self.at_window[up] >= 0 else s if self.length[s] >= window else -1
            self.short[s] = self.short[up] + tuple(sorted(own.get(s, ())))
        self.items = {s: frozenset(ends[s]) for s in order if self.at_window[s] == s}
        self.least = min([window, *(n for n, _, _ in short)])

    def _state(self, length: int, link: int, moves: dict, ends: list) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        ends.append(set())
        return len(self.link) - 1

    def _extend(self, last: int, w: int, ends: list) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, w, ends)
        new = self._state(self.length[last] + 1, 0, {}, ends)
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][w]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, to, w, ends)
        return new

    def _split(self, at: int, to: int, w: int, ends: list) -> int:
        copy = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]), ends)
        self.link[to] = copy
        while at >= 0 and self.next[at].get(w) == to:
            self.next[at][w] = copy
            at = self.link[at]
        return copy

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int], list[bytes]]:
        """Number of words, maximal hit runs [from, to) in word numbers, items hit."""
        known, moves, links, lengths = self.vocabulary.get, self.next, self.link, self.length
        runs: list[list[int]] = []
        hit: set[int] = set()
        count, state, match = 0, 0, 0
        for piece in cut_at_space(text):
            words = words_of(piece)
            ids = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
            # words outside the vocabulary end every match: only stretches of known words that can hold a window are walked
            outside = np.flatnonzero(ids < 0)
            edges = np.concatenate(([-1], outside, [len(ids)]))
            gaps = np.diff(edges) - 1
            worth = gaps >= self.least
            worth[0] |= match > 0 and gaps[0] > 0
            worth[-1] |= gaps[-1] > 0
            for left, n in zip((edges[:-1][worth] + 1).tolist(), gaps[worth].tolist()):
                if left:
                    state = match = 0
                for i, w in enumerate(ids[left:left + n].tolist(), count + left + 1):
                    while state and w not in moves[state]:
                        state = links[state]
                        match = lengths[state]
                    to = moves[state].get(w)
                    if to is None:
                        continue
                    state, match = to, match + 1
                    reach = 0
                    if match >= self.window_length:
                        reach = self.window_length
                        hit |= self.items[self.at_window[state]]
                    for size, name in self.short[state]:
                        if size <= match:
                            hit.add(name)
                            reach = max(reach, size)
                    if reach:
                        begin = i - reach
                        while runs and runs[-1][1] >= begin:
                            begin = min(begin, runs.pop()[0])
                        runs.append([begin, i])
            if len(outside) and outside[-1] == len(ids) - 1:
                state = match = 0
            count += len(words)
        return count, runs, hit


def _automata(benchmark: DataFrame, window: int) -> list[SuffixAutomaton]:
    """One automaton per AUTOMATON_WORDS item words (items dealt by hash), each collected and built by itself."""
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (6 * AUTOMATON_WORDS)))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    built = []
    for part in range(parts):
        rows = dealt.filter(F.col("part") == part).collect()
        built.append(SuffixAutomaton([(r["item_id"], words_of(r["text"].encode())) for r in rows], window))
    return built


_HITS = "struct<n_words: long, runs: array<struct<begin: long, end: long>>, items: array<string>>"
_RUN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_HITS_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("items", pa.list_(pa.string()))])


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(map(tuple, runs)):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(r) for r in out]


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, out: str = "hits") -> DataFrame:
    """``docs`` with struct column ``out``: n_words, maximal hit runs [begin, end) in word numbers, ids of the items hit.

    Columns used: text of ``docs``; item_id and text of ``benchmark``. A null text has no words. Items without words match
    nothing, repeated items count once, an item without id hits words but has no id to report. The automaton of the benchmark
    is broadcast (at most AUTOMATON_WORDS item words each; more automata take more passes over the same rows).
    """
    return _matched(docs, _automata(benchmark, window), out)


def _matched(docs: DataFrame, automata: list[SuffixAutomaton], out: str) -> DataFrame:
    rows = docs
    for turn, automaton in enumerate(automata):
        scan = F.arrow_udf(sliced(_scanner(shared(docs.sparkSession, automaton))), _HITS)
        rows = rows.withColumn(out, scan(F.col("text").cast("string"), F.col(out) if turn else F.lit(None).cast(_HITS)))
    return rows


def _found(machine: SuffixAutomaton, text: str | None, before: dict | None):
    """(words, hit runs, item names) of one text, on top of what earlier automata found."""
    n, runs, hit = machine.scan(text.encode()) if text is not None else (0, [], ())
    names = [machine.names[i] for i in hit if i >= 0]
    if before is not None and before["runs"]:
        runs, names = merged([*runs, *((r["begin"], r["end"]) for r in before["runs"])]), names + before["items"]
    return n, runs, sorted(set(names))


def _scanner(automaton):
    def scan(texts, before):
        found = [_found(automaton(), t, old) for t, old in zip(texts, before)]
        return pa.array([{"n_words": n, "runs": [{"begin": a, "end": b} for a, b in runs], "items": names} for n, runs, names in found], _HITS_ARROW)

    return scan


_CLEAN = "struct<n_words: long, n_hit: long, text: string>"


def _cleaner(automaton):
    """Words, hit words and, where there are any, the text without them."""
    def clean(texts, before):
        out = []
        for t, old in zip(texts, before):
            n, runs, _ = _found(automaton(), t, old)
            out.append({"n_words": n, "n_hit": sum(b - a for a, b in runs), "text": without_runs(t.encode(), runs).decode() if runs else None})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("text", pa.string())]))

    return clean


def n_hit(hits: str = "hits"):
    return F.aggregate(F.col(hits)["runs"], F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["begin"])


def without_runs(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each run."""
    kept, at, number, offset = [], 0, 0, 0
    runs = list(runs)
    for piece in cut_at_space(text):
        folded = piece.translate(_FOLD)
        place = 0
        for w in folded.split():
            place = folded.index(w, place)
            if runs and number == runs[0][0]:
                kept.append(text[at:offset + place])
            place += len(w)
            number += 1
            if runs and number == runs[0][1]:
                at = offset + place
                runs.pop(0)
        offset += len(piece)
    return b"".join([*kept, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without benchmark spans: hit words are cut out of the text, rows with more than ``max_coverage`` of their words hit go.

    A span is any run of at least ``window`` words (or a whole shorter item) that a benchmark item holds. Rows without hits are
    returned unchanged; ``n_chars``, where present, follows a changed text.
    """
    hits, out = fresh(docs, "_hits"), fresh(docs, "_clean")
    *first, last = _automata(benchmark, window)
    rows = _matched(docs, first, hits)
    clean = F.arrow_udf(sliced(_cleaner(shared(docs.sparkSession, last))), _CLEAN)
    found = rows.withColumn(out, clean(F.col("text").cast("string"), F.col(hits) if first else F.lit(None).cast(_HITS)))
    kept = found.filter(F.col(out)["n_hit"] <= max_coverage * F.col(out)["n_words"])
    changed = F.col(out)["n_hit"] > 0
    kept = kept.withColumn("text", F.when(changed, F.col(out)["text"]).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.drop(hits, out)
