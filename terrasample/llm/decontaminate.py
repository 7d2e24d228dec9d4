"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A benchmark item's windows of ``window`` consecutive words are the patterns (an
item with fewer words is one pattern of its own length).  Patterns of one
length m make a table.  A block is two neighbouring words (one, if m = 1).  The
*shift table* says, for each block that occurs in a pattern, how far the search
may move on when it sees that block at the end of the current position; any
other block allows the longest move, m - 1 words.  Where the move is zero, the
*buckets*, keyed by the hash of the last block and, as Wu and Manber's prefix
table does, of the first one, give the patterns that begin and end so.  Their
words' hashes are compared, and a direct comparison of the bytes confirms an
occurrence.

The search runs in lockstep: a document is cut into lanes of some hundred words
that overlap by m - 1, and all lanes of a batch move at once in NumPy.  The
documents are only read, never shuffled.  The pattern tables go to the executors
once; they hold some 50 bytes a benchmark word.  A benchmark beyond
``part_chars`` is searched for part after part, and what was found is put
together by row, so the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.llm import _text
from terrasample.llm._session import TEXT_ROWS, cut, lean, shared_folder, ship

_MUL = np.uint64(0x9E3779B97F4A7C15)
LANE = 512
#: Candidates that are compared at once, and bytes in one comparison.
CANDIDATES, COMPARED = 500_000, 4_000_000


def _blocks(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block that ends at each word (index 0 is the first whole block)."""
    if size == 1:
        return h
    with np.errstate(over="ignore"):
        return _text.mix(h[:-1] * _MUL + h[1:])


def _ends_key(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One hash of the first and the last block of a pattern."""
    with np.errstate(over="ignore"):
        return _text.mix(first * _MUL ^ last)


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each stretch of n."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


@dataclass
class Words:
    """The words of some texts in order: hashes, and their bytes, lower-cased, with one blank between them."""

    hash: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> Words:
        size = ends - starts
        end = np.cumsum(size + 1) - 1
        data = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
        data[_ragged(end - size, size)] = _LOWER[raw[_ragged(starts, size)]]
        return cls(hashes, data, end - size, end)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] = _LOWER[0x61:0x7B]


@dataclass
class Table:
    """Wu-Manber tables for the patterns of one length."""

    length: int
    block: int
    key: np.ndarray  # sorted block hashes
    shift: np.ndarray  # the least move for each
    bucket: np.ndarray  # hash of the first and last block of each pattern, sorted
    first: np.ndarray  # a pattern's first word in the benchmark's words, in the order of bucket
    pattern: np.ndarray  # its number, in that order


@dataclass
class Patterns:
    """All patterns of a part of the benchmark: their tables, words and owners (the items that have a pattern)."""

    tables: list[Table] = field(default_factory=list)
    words: Words | None = None
    items: list[str] = field(default_factory=list)
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # items of pattern p: owner[edge[p]:edge[p + 1]]
    edge: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    @classmethod
    def of(cls, items: list[str], texts: pa.Array, window: int) -> Patterns:
        raw, off = _text.raw(texts)
        starts, ends, count = _text.spans(raw, off, _text.NOT_ALNUM)
        w = Words.of(raw, starts, ends, _text.word_hashes(raw, starts, ends))
        names = sorted(set(items))
        number_of = {x: k for k, x in enumerate(names)}
        own = np.array([number_of[x] for x in items], np.int64)
        length = np.minimum(window, count)
        n = np.where(count > 0, count - length + 1, 0)
        first = _ragged(np.cumsum(count) - count, n)
        item, m = np.repeat(own, n), np.repeat(length, n)
        whole, seen = w.data.tobytes(), {}
        last = w.end[first + m - 1] if len(first) else first
        number = np.array([seen.setdefault(whole[a:b], len(seen)) for a, b in zip(w.start[first].tolist(), last.tolist(), strict=True)], np.int64)
        pair = np.unique(np.stack((number, item), 1), axis=0) if len(number) else np.zeros((0, 2), np.int64)
        _, one = np.unique(number, return_index=True)  # a place of each pattern
        tables = [_table(w.hash, first[at], number[at], k) for k in np.unique(m[one]).tolist() for at in [one[m[one] == k]]]
        return cls(tables, w, names, pair[:, 1], np.searchsorted(pair[:, 0], np.arange(len(one) + 1)))


def _table(h: np.ndarray, first: np.ndarray, number: np.ndarray, m: int) -> Table:
    b = min(2, m)
    blocks = _blocks(h, b)
    cols = blocks[first[:, None] + np.arange(m - b + 1)[None, :]]
    move = np.broadcast_to(np.arange(m - b, -1, -1), cols.shape).reshape(-1)
    order = np.lexsort((move, cols.reshape(-1)))
    key, at = np.unique(cols.reshape(-1)[order], return_index=True)
    bucket = _ends_key(cols[:, 0], cols[:, -1])
    by = np.argsort(bucket, kind="stable")
    return Table(m, b, key, move[order][at], bucket[by], first[by], number[by])


def _find(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(key, x), len(key) - 1)
    return at, key[at] == x


def _same_bytes(a: Words, a_first: np.ndarray, b: Words, b_first: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words from a_first on are those from b_first on, byte by byte."""
    a0, b0 = a.start[a_first], b.start[b_first]
    n = a.end[a_first + m - 1] - a0
    same = n == b.end[b_first + m - 1] - b0
    at = np.flatnonzero(same)
    upto = np.append(0, np.cumsum(n[at]))
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + COMPARED, "right")) - 1)
        own = at[low:high]
        equal = a.data[_ragged(a0[own], n[own])] == b.data[_ragged(b0[own], n[own])]
        same[own] = np.logical_and.reduceat(equal, upto[low:high] - upto[low])
        low = high
    return same


def search(patterns: Patterns, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, one past the last, pattern) of every occurrence; ``count`` words belong to each row in turn."""
    h = _text.word_hashes(raw, starts, ends)
    row_end = np.cumsum(count)
    found: list[tuple[np.ndarray, ...]] = []
    words: Words | None = None
    for t in patterns.tables:
        m, b = t.length, t.block
        longest = m - b + 1
        # a lane answers for the occurrences that end in [at, stop)
        long_enough = np.flatnonzero(count >= m)
        if not len(long_enough):
            continue
        blocks = _blocks(h, b)
        lanes = -(-(count[long_enough] - m + 1) // LANE)
        row = np.repeat(long_enough, lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = row_end[row] - count[row] + m - 1 + nth * LANE
        stop = np.minimum(at + LANE, row_end[row])
        while len(at):
            k, known = _find(t.key, blocks[at - b + 1])
            move = np.where(known, t.shift[k], longest)
            if len(hit := at[move == 0]):
                bucket = _ends_key(blocks[hit - m + 1], blocks[hit - b + 1])
                low, high = np.searchsorted(t.bucket, bucket, "left"), np.searchsorted(t.bucket, bucket, "right")
                some = high > low
                hit, low, n = hit[some], low[some], (high - low)[some]
                upto = np.cumsum(n)
                i = 0
                while i < len(hit):  # so many candidates at once that their number is bounded
                    j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CANDIDATES, "right")))
                    first, cand = np.repeat(hit[i:j], n[i:j]) - m + 1, _ragged(low[i:j], n[i:j])
                    i = j
                    for w in range(m):
                        same = h[first + w] == patterns.words.hash[t.first[cand] + w]
                        first, cand = first[same], cand[same]
                    if len(first):
                        words = words or Words.of(raw, starts, ends, h)
                        same = _same_bytes(words, first, patterns.words, t.first[cand], m)
                        found.append((first[same], first[same] + m, t.pattern[cand[same]]))
            at = at + np.maximum(move, 1)
            left = at < stop
            at, stop = at[left], stop[left]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def occurrences(patterns: Patterns, column: pa.Array) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, list[str]]]:
    """Of a text column: how many words each row has, and of rows with hits the maximal hit stretches and the items."""
    raw, off = _text.raw(column)
    starts, ends, count = _text.spans(raw, off, _text.NOT_ALNUM)
    start, end, number = search(patterns, raw, starts, ends, count)
    row_end = np.cumsum(count)
    base = row_end - count
    row = np.searchsorted(row_end, start, "right")
    hits: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, list[str]] = {}
    if len(start):
        mark = np.zeros(len(starts) + 1, np.int64)
        np.add.at(mark, start, 1)
        np.add.at(mark, end, -1)
        covered = np.cumsum(mark[:-1]) > 0
        pair = np.unique(np.stack((row, number), 1), axis=0)
        edge = np.flatnonzero(np.append(True, pair[1:, 0] != pair[:-1, 0]))
        for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(pair)], strict=True):
            r = int(pair[i, 0])
            own = np.flatnonzero(np.diff(np.concatenate(([0], covered[base[r] : row_end[r]].astype(np.int8), [0]))))
            hits[r] = [tuple(x) for x in own.reshape(-1, 2).tolist()]
            p = np.unique(np.concatenate([patterns.owner[patterns.edge[k] : patterns.edge[k + 1]] for k in pair[i:j, 1].tolist()]))
            items[r] = [patterns.items[k] for k in p.tolist()]  # in order, as the names are
    return count, hits, items


_EXTRA = {
    "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "items": "array<string>",
    "hits": "array<struct<start:bigint,end:bigint>>", "contaminated": "boolean"
}
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _stretches(hits: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in hits]


def _results(count: np.ndarray, hits: dict[int, list[tuple[int, int]]], items: dict[int, list[str]], share: float) -> list[pa.Array]:
    """The columns of _EXTRA for some rows."""
    n = len(count)
    n_hit = np.zeros(n, np.int64)
    for r, own in hits.items():
        n_hit[r] = sum(b - a for a, b in own)
    names = [items.get(r, []) for r in range(n)]
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
    contaminated = (n_hit > 0) & (1_000_000 * n_hit >= round(share * 1_000_000) * count)
    return [
        pa.array(count, pa.int64()), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array(digest, pa.string()), pa.array(names, pa.list_(pa.string())),
        pa.array([_stretches(hits.get(r, [])) for r in range(n)], _HITS), pa.array(contaminated),
    ]


def _merged(hits: list[dict[str, int]]) -> list[tuple[int, int]]:
    """Stretches of several parts as maximal ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    share: float = 0.05,
    keep_columns: bool = False,
    part_chars: int = 4_000_000,
) -> DataFrame:
    """Every document with the benchmark windows that occur in it.

    Returns one row for each row of ``docs``: its id (or, with
    ``keep_columns``, all its columns), n_words, n_hit (words inside any
    occurrence), n_items and items_sha256 (of the sorted, comma-joined ids of
    the items that occur), items (those ids), hits (first word, end and number of
    words of each maximal hit stretch) and contaminated: n_hit > 0 and
    n_hit >= share * n_words.

    Null or empty text: no words, not contaminated.  Items without id, text or
    words are passed over; rows of one item id are one item.  Repeated rows and
    ids of ``docs`` give a row each.  An empty benchmark leaves all documents
    clean.  Columns of ``docs`` named as result columns are replaced by these.

    About ``part_chars`` characters of the benchmark (one item's text at least)
    are on the driver and in a task at a time.  With more than one part the
    documents are written once to the shared folder and read once for each part.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    use = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")
    )
    parts = max(1, -(-(use.agg(F.sum(F.length("t"))).first()[0] or 0) // part_chars))
    kept = [c for c in docs.columns if c not in _EXTRA] if keep_columns else [id_col]
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"{c} {t}" for c, t in _EXTRA.items())])
    source = docs.select(*dict.fromkeys([*(f"`{c}`" for c in kept), f"`{text_col}`"]))

    def part(k: int):
        own = use if parts == 1 else use.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k)
        table = own.toArrow()  # about part_chars characters
        return spark.sparkContext.broadcast(Patterns.of(table.column("i").to_pylist(), table.column("t").combine_chunks(), window))

    if parts == 1:
        shared = part(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i, j in _text.slices(whole.column(text_col)):
                    batch = whole.slice(i, j - i)
                    found = _results(*occurrences(shared.value, batch.column(text_col)), share)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], names=[*kept, *_EXTRA])

        return source.mapInArrow(lean(run), schema)

    folder = shared_folder(spark)
    rows = cut(source.withColumn("__row", F.monotonically_increasing_id()), folder, "documents")  # written, so the numbers hold

    def one(k: int) -> DataFrame:
        shared = part(k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i, j in _text.slices(whole.column(1)):
                    _, hits, names = occurrences(shared.value, whole.column(1).slice(i, j - i))
                    own = sorted(hits)
                    yield pa.RecordBatch.from_arrays(
                        [
                            whole.column(0).slice(i, j - i).take(pa.array(own, pa.int64())),
                            pa.array([_stretches(hits[r]) for r in own], _HITS),
                            pa.array([names[r] for r in own], pa.list_(pa.string()))
                        ],
                        names=["__row", "__hits", "__items"]
                    )

        found = cut(
            rows.select("__row", text_col).mapInArrow(
                lean(run), "__row bigint, __hits array<struct<start:bigint,end:bigint>>, __items array<string>"
            ),
            folder, f"part-{k}", TEXT_ROWS
        )
        shared.unpersist()
        return found

    every = reduce(DataFrame.unionByName, [one(k) for k in range(parts)])
    put = every.groupBy("__row").agg(
        F.flatten(F.collect_list("__hits")).alias("__hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items")
    )  # a row's group has a row for each part

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in _text.slices(whole.column(text_col)):
                batch = whole.slice(i, j - i)
                raw, off = _text.raw(batch.column(text_col))
                count = _text.spans(raw, off, _text.NOT_ALNUM)[2]
                hits = {r: _merged(x) for r, x in enumerate(batch.column("__hits").to_pylist()) if x}
                names = {r: x for r, x in enumerate(batch.column("__items").to_pylist()) if x}
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *_results(count, hits, names, share)], names=[*kept, *_EXTRA])

    return rows.join(put, "__row", "left").drop("__row").mapInArrow(lean(finish), schema)
