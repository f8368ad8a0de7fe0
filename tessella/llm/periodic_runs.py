"""Operator 11, periodic runs by a grammar.

A run is a stretch of consecutive words with a smallest period q (words q apart are identical) that no neighbouring word extends
keeping the period; those of at least `least` words and `times` periods count.

The word ids of some documents at once are compressed by Re-Pair: the most frequent pairs of neighbours become nonterminals, round
by round, until no pair occurs twice within them; what is left of a document is folded into a balanced tree, so that
everything is a binary node. A run that lies in the text lies whole in the expansion of one lowest node, whose boundary it
crosses. So each node is asked once, at its first place, for the runs that cross its boundary, however often it is derived, and
what it has is translated to all its places. Higher nodes give longer parts of the same run; of each period the intervals that
no other one holds are the maximal runs.

A run of four periods that crosses a boundary has two of them on one of its sides. Short periods are tried there word by word.
For long ones the rarest of the eight words beside the boundary must occur again a period away, and only its few places are
compared, all exactly. The grammar is made anew for every PART: it decides how often a repeated passage is looked at and nothing
else. Memory is some 150 bytes a word of what shares a grammar, which is PART bytes of text or a single longer document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, only, table
from .shingles import mix

#: Words and periods that a run has at least.
LEAST, TIMES = 6, 4
#: Words beside a boundary of which the rarest is looked up; shorter periods are tried one by one.
BESIDE = 8
#: Comparisons that are held at once, and bytes of text that share a grammar.
CHUNK, PART = 1 << 18, 1 << 20


class Grammar:
    """Re-Pair over the words of several documents; doc: the document of each word, ascending.

    rules: of each nonterminal its left and right length; places: where nonterminal number k is derived, in all documents.
    rest: starts of the symbols that are left, with their documents."""

    def __init__(self, word: np.ndarray, doc: np.ndarray):
        self.left, self.right, self.of, self.places = [], [], [], []
        n, total = len(word), int(word.max()) + 1 if len(word) else 1
        first_rule, lengths = total, np.ones(total, np.int64)
        # Symbols stay where their first word stands; the last place is behind the end.
        symbol, doc = np.append(word, -1).astype(np.int64), np.append(doc, -1).astype(np.int32)
        after, before, stands = np.arange(1, n + 2), np.arange(-1, n), np.ones(n + 1, bool)
        after[n:], stands[n] = n, False
        live, marked = np.arange(n), np.zeros(n + 1, bool)
        while True:
            i = live[doc[live] == doc[after[live]]]
            twice = symbol[i] == symbol[after[i]]
            odd = np.zeros(len(i), bool)
            if twice.any():  # of x x x only every other pair
                goes_on = np.concatenate([[False], twice[1:] & twice[:-1] & (after[i[:-1]] == i[1:])])
                begins = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(i))))
                odd = twice & ((np.arange(len(i)) - begins) % 2 == 1)
            pair = i[~odd]
            pair = pair[self._often(symbol[pair], symbol[after[pair]])]
            kind, inverse, count = np.unique(symbol[pair] * total + symbol[after[pair]], return_inverse=True, return_counts=True) if len(pair) else (pair, pair, pair)
            if not len(count) or count.max() < 2:
                break
            weight = (count << 40) | (mix(kind.astype(np.uint64)) & np.uint64((1 << 40) - 1)).astype(np.int64)
            chosen = count[inverse] >= max(2, (int(count.max()) + 1) // 2)
            taken, number = self._greedy(pair[chosen], after, weight[inverse[chosen]], inverse[chosen])
            enough = np.bincount(number, minlength=len(kind))[number] >= 2
            taken, number = taken[enough], number[enough]
            used, number = np.unique(number, return_inverse=True)
            a, b = lengths[kind[used] // total], lengths[kind[used] % total]
            self.left.append(a)
            self.right.append(b)
            self.of.append(number + total - first_rule)
            self.places.append(taken)
            lengths = np.concatenate([lengths, a + b])
            symbol[taken] = number + total
            total += len(used)
            gone = after[taken]
            stands[gone] = False
            after[taken] = after[gone]
            before[after[gone]] = taken
            marked[:] = False
            for some in (pair[count[inverse] >= 2], i[odd], taken, before[taken]):
                marked[some] = True  # before the first one is the last place, whose pair is none
            live = np.flatnonzero(marked & stands)
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.left, self.right, self.of, self.places = map(joined, (self.left, self.right, self.of, self.places))
        by = np.argsort(self.of, kind="stable")
        self.places = self.places[by]
        self.start = np.searchsorted(self.of[by], np.arange(len(self.left) + 1))
        self.rest = np.flatnonzero(stands[:n])
        self.rest_doc = doc[self.rest]

    @staticmethod
    def _often(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs may occur twice: counts by a hash of the pair are never too small."""
        mixed = left * 0x9E3779B1 + right * 0x85EBCA77
        slot = (mixed ^ (mixed >> 23)) & ((1 << max(10, len(left).bit_length() + 1)) - 1)
        return np.bincount(slot)[slot] > 1 if len(left) else np.zeros(0, bool)

    @staticmethod
    def _greedy(at: np.ndarray, after: np.ndarray, weight: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs at ascending places those that no heavier overlapping one forbids, heaviest first."""
        out = []
        while len(at):
            close = after[at[:-1]] == at[1:]
            wins = np.ones(len(at), bool)
            wins[1:] &= ~close | (weight[1:] > weight[:-1])
            wins[:-1] &= ~close | (weight[:-1] >= weight[1:])
            out.append(np.stack([at[wins], number[wins]]))
            gone = wins.copy()
            gone[1:] |= close & wins[:-1]
            gone[:-1] |= close & wins[1:]
            at, weight, number = at[~gone], weight[~gone], number[~gone]
        both = np.concatenate(out, axis=1)
        return tuple(both[:, np.argsort(both[0], kind="stable")])

    def nodes(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """lo, boundary and hi of all binary nodes: the nonterminals at their first place, then the trees over what is left.
        ends: the end of each document."""
        first = self.places[self.start[:-1]]
        lo, mid, hi = [first], [first + self.left], [first + self.left + self.right]
        n = len(self.rest)
        own = np.searchsorted(self.rest_doc, self.rest_doc, side="left")
        nth, many = np.arange(n) - own, np.searchsorted(self.rest_doc, self.rest_doc, side="right") - own
        stop = np.append(self.rest, 0)
        half = 1
        while n and half < many.max():
            j = np.flatnonzero((nth % (2 * half) == 0) & (nth + half < many))
            last = j + 2 * half
            lo.append(self.rest[j])
            mid.append(self.rest[j + half])
            hi.append(np.where(nth[j] + 2 * half < many[j], stop[np.minimum(last, n)], ends[self.rest_doc[j]]))
            half *= 2
        return np.concatenate(lo), np.concatenate(mid), np.concatenate(hi)


def _agreeing(word: np.ndarray, x: np.ndarray, period: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many of x, x + step, x + 2 step, ... at most `most`, hold the same word as a period later."""
    done, open_, width = np.zeros(len(x), np.int64), np.flatnonzero(most > 0), 8
    while len(open_):
        still = []
        for some in np.array_split(open_, -(-len(open_) * width // CHUNK)):
            k = done[some][:, None] + np.arange(width)
            inside = k < most[some][:, None]
            i = np.where(inside, x[some][:, None] + step * k, 0)
            same = inside & (word[i] == word[np.minimum(i + period[some][:, None], len(word) - 1)])
            n = np.where(same.all(axis=1), width, same.argmin(axis=1))
            done[some] += n
            still.append(some[n == width])
        open_ = np.concatenate(still)
        open_ = open_[done[open_] < most[open_]]
        width = min(2 * width, 4096)
    return done


def _places(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kind: a number for each word of each document; keys: kind and place of all words, sorted; rare: the place of the rarest of
    the BESIDE words from each place on."""
    n = len(word)
    order = np.argsort(doc.astype(np.int64) * (int(word.max()) + 1) + word, kind="stable")
    new = np.concatenate([[True], (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
    kind = np.empty(n, np.int64)
    kind[order] = np.cumsum(new) - 1
    count = np.bincount(kind)[kind]
    rare, reach = np.arange(n), 1
    while reach < BESIDE:
        other = rare[np.minimum(np.arange(n) + reach, n - 1)]
        rare = np.where(count[other] < count[rare], other, rare)
        reach *= 2
    return kind, kind[order] * n + order, order, rare


def crossing(word: np.ndarray, doc: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """node, start, end, period of the runs within lo to hi that cross mid, of each node, by their smallest periods."""
    node = np.flatnonzero((hi - lo) >= least)
    found = []

    def keep(i: np.ndarray, period: np.ndarray, x: np.ndarray) -> None:
        after = _agreeing(word, x, period, hi[i] - period - x, 1)
        before = _agreeing(word, x - 1, period, x - lo[i], -1)
        start, end = x - before, x + after + period
        fine = (start < mid[i]) & (end > mid[i]) & (end - start >= np.maximum(least, times * period))
        found.append(np.stack([i, start, end, period])[:, fine])

    for p in range(1, BESIDE + 1):
        wide = node[hi[node] - lo[node] >= max(least, times * p)]
        right, left = wide[mid[wide] + 2 * p <= hi[wide]], wide[mid[wide] - 2 * p >= lo[wide]]
        for k in range(p):
            right = right[word[mid[right] + k] == word[mid[right] + k + p]]
            left = left[word[mid[left] - 1 - k] == word[mid[left] - 1 - k - p]]
        keep(right, np.full(len(right), p), mid[right])
        keep(left, np.full(len(left), p), mid[left] - p)
    wide = node[hi[node] - lo[node] >= times * (BESIDE + 1)]
    if len(wide):
        kind, keys, order, rare = _places(word, doc)
        n = len(word)
        for side in (1, -1):
            room = (hi[wide] - mid[wide] if side == 1 else mid[wide] - lo[wide]) // 2
            some, most = wide[room > BESIDE], np.minimum(room, (hi[wide] - lo[wide]) // times)[room > BESIDE]
            anchor = rare[mid[some]] if side == 1 else rare[mid[some] - BESIDE]
            near, far = anchor + side * (BESIDE + 1), anchor + side * most
            a, b = (np.searchsorted(keys, kind[anchor] * n + np.clip(v, 0, n - 1), side=s) for v, s in ((np.minimum(near, far), "left"), (np.maximum(near, far), "right")))
            many = np.maximum(b - a, 0)
            for part in np.split(np.arange(len(some)), np.searchsorted(np.cumsum(many), np.arange(CHUNK, many.sum(), CHUNK))):
                of = np.repeat(part, many[part])
                nth = np.arange(len(of)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
                period = side * (order[a[of] + nth] - anchor[of])
                i = some[of]
                fine = (period > BESIDE) & (period <= most[of])
                i, period = i[fine], period[fine]
                x = mid[i] if side == 1 else mid[i] - period
                from_ = x if side == 1 else x - BESIDE
                for k in range(BESIDE):
                    same = word[from_ + k] == word[from_ + k + period]
                    i, period, x, from_ = i[same], period[same], x[same], from_[same]
                keep(i, period, x)
    i, start, end, period = np.unique(np.concatenate(found, axis=1), axis=1)
    # A multiple of a smaller period of the same stretch goes.
    smallest, held = np.ones(len(i), bool), defaultdict(list)
    for k in np.lexsort((period, i)):
        mine = held[int(i[k])]
        smallest[k] = not any(s <= start[k] and end[k] <= e for s, e in mine)
        mine.append((start[k], end[k]))
    return i[smallest], start[smallest], end[smallest], period[smallest]


def runs_of(word: np.ndarray, doc: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, period of all runs of documents that stand one after the other, by start, then period."""
    if len(word) < least:
        return (np.zeros(0, np.int64),) * 3
    grammar = Grammar(word, doc)
    lo, mid, hi = grammar.nodes(ends)
    node, start, end, period = crossing(word, doc, lo, mid, hi, least, times)
    rules = len(grammar.left)
    inner = node < rules
    many = np.where(inner, np.diff(grammar.start, append=0)[np.minimum(node, rules)] if rules else 0, 1)
    of = np.repeat(np.arange(len(node)), many)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    moved = np.zeros(len(of), np.int64)
    at = inner[of]
    moved[at] = grammar.places[grammar.start[node[of[at]]] + nth[at]] - lo[node[of[at]]]
    start, end, period = start[of] + moved, end[of] + moved, period[of]
    by = np.lexsort((-end, start, period))
    start, end, period = start[by], end[by], period[by]
    if len(start):
        reach = np.maximum.accumulate(end + period * (len(word) + 1))
        own = np.concatenate([[True], (end + period * (len(word) + 1))[1:] > reach[:-1]])
        start, end, period = start[own], end[own], period[own]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about PART bytes of text, or of one longer text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PART, side="right")))
        yield batch.slice(at, to - at)
        at = to


RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, *, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, runs (start, length, period in words; by start, then period), collapsed (the text's
    words, joined by one space, without those that a run holds after its first period).

    Words are split at ASCII white space. A null or empty text has no words and no runs, and its collapsed text is empty. Every
    row is judged by itself, so repeated rows, ids and null ids come out as they are."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in lean(batches, returned=1 << 25) for part in parts(whole)):
            numbers: defaultdict = defaultdict()
            numbers.default_factory = numbers.__len__
            words = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in words], np.int64)
            ends = np.cumsum(sizes)
            word = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int32, int(sizes.sum()))
            start, end, period = runs_of(word, np.repeat(np.arange(len(words), dtype=np.int32), sizes), ends, least, times)
            of = np.searchsorted(ends, start, side="right")
            change = np.zeros(len(word) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, end, -1)
            gone = np.cumsum(change)[:-1] > 0
            cut = np.searchsorted(of, np.arange(len(words) + 1))
            collapsed = []
            for k, own in enumerate(words):
                if cut[k] < cut[k + 1]:
                    own = [x for x, g in zip(own, gone[ends[k] - sizes[k] : ends[k]].tolist(), strict=True) if not g]
                collapsed.append(b" ".join(own).decode())
            items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - (ends - sizes)[of] if len(of) else start, end - start, period)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), items)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), runs, pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(bounded_batches(docs), "doc_id", "text").mapInArrow(searched, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): the text of one in ten documents, by the checksum h of its id, from word a = g mod n on repeats
    p = 1 + floor((n - a) / (3 + g mod 8)) words, where g is h / 10. The others' texts stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(F.col("h") / 10).cast("long")
    words = F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    n = F.size("words")
    cut = only(docs, "doc_id", "text").withColumn("h", h).withColumn("words", words)
    placed = cut.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    times: Column = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), n - F.col("a"))
    repeated = F.concat_ws(" ", F.concat(F.slice("words", F.lit(1), F.col("a")), tail))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    # Exact comparison of length / period: by the whole part, then by the rest over the period as a fraction of longs.
    larger = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | ((x["length"] * y["period"] == y["length"] * x["period"]) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
    best = F.when(F.size("runs") > 0, F.aggregate("runs", F.col("runs")[0], lambda b, x: F.when(larger(x, b), x).otherwise(b)))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    made = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    fields = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return made.select("doc_id", "n_runs", *fields, F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
