"""Operator 6, suffix-array dedup: deleting every byte of a string of 200 bytes that starts anywhere else too.

Suffixes are sorted where equal strings can be: every window of 200 bytes picks a gram of 64 in it, from its own bytes alone,
so equal windows pick equal grams. Windows of a text with one pick are a segment; segments are dealt by their gram. Spark
counts the grams first: what picks a gram that stands at one place only has no copy and is never moved. Segments with equal
bytes are brought together as one with its number. In each gram's bucket the suffix array of its different segments is made by
linear grouping (see lyndon), and windows that begin neighbouring suffixes with a common prefix of 200 bytes, or belong to a
segment that occurs again, are repeated. A bucket with one kind of segment has nothing to sort. A bucket of very many kinds - a
passage in many surroundings - is not brought into one task: its windows are counted by their hashes instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .anchors import picks, prefix_sums, substring_hashes
from .common import bounded_batches, lean, only, spread_join, stored, table
from .lyndon import suffix_arrays

#: Length of a repeated string and of its gram; kinds of segments that a bucket may have to be sorted; letters of a call.
WINDOW, GRAM, KINDS, LETTERS = 200, 64, 64, 800_000
#: Window starts of a text that are handled at once.
SPAN = 1 << 18


def _segments(text: bytes, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Grams' hashes, segments' hashes, and first and last window start of each segment, for parts of a text."""
    for begin in range(0, len(text) - window + 1, SPAN):
        raw = np.frombuffer(text, dtype=np.uint8)[begin : begin + SPAN + window - 1]
        sums = prefix_sums(raw)
        _, hashes, first, last = picks(sums, len(raw), window, gram)
        yield hashes.view(np.int64), substring_hashes(sums, first, last + window, 1).view(np.int64), first + begin, last + begin


def _packed(rows: DataFrame) -> DataFrame:
    """row, doc_id and the text's bytes, compressed, for a shuffle."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in lean(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([None if x is None else tool.compress(x.encode()) for x in batch.column(2).to_pylist()], pa.binary())], names=["row", "doc_id", "packed"])

    return rows.select("row", "doc_id", "text").mapInArrow(packed, f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, packed binary")


_UNPACK = zstandard.ZstdDecompressor()  # one for all texts of a worker


def _unpacked(x: bytes | None) -> bytes:
    return _UNPACK.decompress(x) if x else b""


def repeated_starts(bucket: list[list[tuple[bytes, int]]], window: int) -> list[list[np.ndarray]]:
    """bucket: for each gram its different segments and how often each occurs -> for each segment a mask of its windows that
    are repeated."""
    letters, bounds, at = [], [0], 0
    places = []
    for kinds in bucket:
        for text, _ in kinds:
            places.append(at)
            letters.append(np.frombuffer(text, dtype=np.uint8).astype(np.int64) + 2)
            letters.append(np.ones(1, dtype=np.int64))
            at += len(text) + 1
        letters[-1] = np.zeros(1, dtype=np.int64)
        bounds.append(at)
    flat, ends = np.concatenate(letters), np.array(bounds)
    order = suffix_arrays(flat, ends)
    sums = prefix_sums(np.where(flat > 1, flat - 2, 0).astype(np.uint8))
    string = np.searchsorted(ends, np.arange(at), side="right") - 1
    whole = np.zeros(at, dtype=bool)  # does a window start here that lies in its segment?
    sizes = [len(text) for kinds in bucket for text, _ in kinds]
    for p, n in zip(places, sizes, strict=True):
        whole[p : p + n - window + 1] = True
    order = order[whole[order]]
    hashes = substring_hashes(sums, order, order + window)
    same = (hashes[1:] == hashes[:-1]) & (string[order[1:]] == string[order[:-1]])  # neighbours with a common prefix of a window
    twice = np.zeros(at, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    out, k = [], 0
    for kinds in bucket:
        masks = []
        for text, n in kinds:
            mask = twice[places[k] : places[k] + len(text) - window + 1]
            masks.append(np.ones(len(mask), dtype=bool) if n > 1 else mask)
            k += 1
        out.append(masks)
    return out


def _spans(mask: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[False], mask, [False]]).view(np.int8))
    return [{"a": int(a), "b": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def merged(lengths: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of texts one after the other, lengths of them each, in any order and overlapping -> first and last + 1 of the maximal
    runs, and where each text's runs begin."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    if not len(of):
        return start, end, np.zeros(len(lengths) + 1, dtype=np.int64)
    order = np.lexsort((start, of))
    base = of * (int(end.max()) + 1)  # so that no text's runs reach the next text
    low, upto = start[order] + base, np.maximum.accumulate(end[order] + base)
    begin = np.flatnonzero(np.concatenate([[True], low[1:] > upto[:-1]]))
    last = np.append(begin[1:], len(of)) - 1
    return low[begin] - base[begin], upto[last] - base[last], np.searchsorted(of[begin], np.arange(len(lengths) + 1))


_PARTS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_PARTS_SQL = "array<struct<a: int, b: int>>"


def repeated_spans(rows: DataFrame, *, window: int = WINDOW, gram: int = GRAM, kinds: int = KINDS) -> DataFrame:
    """rows(row, doc_id, text) -> row, start, end (end exclusive, in bytes): strings that are repeated, in no order and overlapping."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Columns h, seg, row, first, last of some texts at a time."""
        out: list[tuple] = []
        for batch in lean(batches):
            for row, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if x and len(x) * 4 >= window:
                    for h, seg, first, last in _segments(x.encode(), window, gram):
                        out.append((h, seg, np.full(len(h), row), first.astype(np.int32), last.astype(np.int32)))
                if len(out) >= 64:
                    yield [np.concatenate(c) for c in zip(*out, strict=True)]
                    out = []
        if out:
            yield [np.concatenate(c) for c in zip(*out, strict=True)]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in gathered(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:2]], names=["h", "seg"])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in gathered(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "seg", "row", "first", "last"])

    counted = rows.select("row", "text").mapInArrow(grams, "h long, seg long").groupBy("h").agg(F.count("*").alias("n"), F.min("seg").alias("lo"), F.max("seg").alias("hi"))
    again = stored(counted.filter("n > 1").select("h", "n", (F.col("lo") != F.col("hi")).alias("many")))
    met = rows.select("row", "text").mapInArrow(occurrences, "h long, seg long, row long, first int, last int")
    placed = stored(spread_join(met, again, ["h"], "n").drop("n"))
    alone = placed.filter("not many").select("row", F.col("first").alias("start"), (F.col("last") + window).alias("end"))

    # The different segments of each bucket, fetched from one text each.
    different = stored(placed.filter("many").groupBy("h", "seg").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last")).alias("of")))
    size = different.groupBy("h").agg(F.count("*").alias("size"))
    wanted = different.join(size.hint("shuffle_merge"), "h").select("h", "seg", "n", "size", "of.*")
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("h", "seg", "n", "size", "first", "last")).alias("wanted"))  # of one text

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for x, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = _unpacked(x)
                columns = [[w[c] for w in wants] for c in ("h", "seg", "n", "size")]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([text[w["first"] : w["last"] + window] for w in wants], pa.binary())], names=["h", "seg", "n", "size", "bytes"])

    pieces = stored(_packed(rows).join(by_row.hint("shuffle_merge"), "row").select("packed", "wanted").mapInArrow(fetched, "h long, seg long, n long, size long, bytes binary"))

    def sorted_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple[int, int]] = []
        bucket: list[list[tuple[bytes, int]]] = []
        now, letters = None, 0

        def judged() -> pa.RecordBatch:
            # Strings of like length are worked on together.
            masks = [None] * len(bucket)
            by = sorted(range(len(bucket)), key=lambda k: sum(len(t) for t, _ in bucket[k]))
            at = 0
            while at < len(by):
                some, total = [], 0
                while at < len(by) and (not some or total < LETTERS):
                    some.append(by[at])
                    total += sum(len(t) + 1 for t, _ in bucket[by[at]])
                    at += 1
                for k, m in zip(some, repeated_starts([bucket[k] for k in some], window), strict=True):
                    masks[k] = m
            parts = [_spans(m) for ms in masks for m in ms]
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in names], pa.int64()), pa.array([s for _, s in names], pa.int64()), pa.array(parts, _PARTS)], names=["h", "seg", "parts"])

        for batch in lean(batches):
            for h, seg, n, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if h != now:
                    if letters > 4 * LETTERS:
                        yield judged()
                        names, bucket, letters = [], [], 0
                    bucket.append([])
                    now = h
                bucket[-1].append((text, n))
                names.append((h, seg))
                letters += len(text) + 1
        if bucket:
            yield judged()

    few = pieces.filter(F.col("size") <= kinds).select("h", "seg", "n", "bytes").repartition("h").sortWithinPartitions("h")
    parts = few.mapInArrow(sorted_, f"h long, seg long, parts {_PARTS_SQL}")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for h, seg, n, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                sums, at = prefix_sums(np.frombuffer(text, dtype=np.uint8)), np.arange(len(text) - window + 1)
                one, two = substring_hashes(sums, at, at + window), substring_hashes(sums, at, at + window // 2, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x)) for x in (h, seg, n)] + [pa.array(at.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["h", "seg", "n", "at", "one", "two"])

    every = pieces.filter(F.col("size") > kinds).select("h", "seg", "n", "bytes").mapInArrow(windows, "h long, seg long, n long, at int, one long, two long")
    # Counted beside its rows: a window is moved once, and nothing is joined.
    times = every.withColumn("times", F.sum("n").over(W.partitionBy("one", "two")))
    rest = times.filter("times > 1").select("h", "seg", F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b")).alias("part"))
    judged = parts.unionByName(rest.groupBy("h", "seg").agg(F.collect_list("part").alias("parts")))  # of one segment

    told = stored(judged.filter(F.size("parts") > 0).join(different.select("h", "seg", "n").hint("shuffle_merge"), ["h", "seg"]))
    found = spread_join(placed.filter("many"), told, ["h", "seg"], "n")
    spans = found.select("row", "first", F.explode("parts").alias("p")).select("row", (F.col("first") + F.col("p.a")).alias("start"), (F.col("first") + F.col("p.b") + window - 1).alias("end"))
    return alone.unionByName(spans)


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, kinds: int = KINDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (binary, the bytes that stay), kept_sha256.

    Every byte of a string of window bytes that also starts anywhere else, in this or another text, is removed; strings are
    judged on the input and may overlap; none crosses texts. Null and empty texts, and those shorter than window, lose
    nothing. Repeated rows are copies of each other and lose all their bytes if they have window bytes. docs must give its rows
    in the same partitions whenever it is read, as a table does."""
    rows = only(bounded_batches(docs), "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    found = repeated_spans(rows, window=window, gram=gram, kinds=kinds)
    by_row = found.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # of one text
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            out = []
            spans = batch.column(2)
            start, end = (c.to_numpy().astype(np.int64) for c in spans.flatten().flatten())
            low, upto, at = merged(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(), start, end)
            low, upto, at = low.tolist(), upto.tolist(), at.tolist()
            for x, i, j in zip(batch.column(1).to_pylist(), at, at[1:], strict=False):
                text, runs = _unpacked(x), list(zip(low[i:j], upto[i:j], strict=True))
                edges = [0, *(e for r in runs for e in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest()))
            n, removed, spans, kept, digests = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (n, removed, spans)), pa.array(kept, pa.binary()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return _packed(rows).join(by_row.hint("shuffle_merge"), "row", "left").select("doc_id", "packed", "spans").mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
