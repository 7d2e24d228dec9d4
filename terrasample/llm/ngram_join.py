"""N-gram Jaccard join with a prefix tree, and the classes of similar documents it finds.

Each text becomes its set of word shingles (64-bit hashes) in one global order:
rare first, by a level of the document frequency, then by hash.  Frequencies are
counted over all documents; a shingle that is nowhere frequent has level 0.

1. ``sets``: one pass over the texts gives each document's set size and a 128-bit
   signature; documents with one signature have equal sets and are one class,
   represented by its smallest id.
2. ``postings``: a second pass keeps each set's prefix, the rarest
   n - ceil(t n) + 1 shingles; two sets that link share one of them.  The
   prefixes are dealt out by shingle in packed form; shingles of one class
   only are dropped.
3. *Stars*: within each shingle's classes all are paired with one of them (the
   pivot), a linear number of pairs; twice, with other pivots.  Their links
   merge most of the large groups of near copies at once.
4. *Rest*: classes under one shingle that are still in different components are
   paired where the smaller set has it in its short prefix (the rarest
   n - ceil(2 t / (1 + t) n) + 1 shingles), but for pairs of which even all of the
   remaining shingles (the length left from the first common one on) could not
   lift the overlap to the threshold, and for pairs whose parity bitmaps prove
   that too many differ.
5. Comparison: the sets of the pairs' classes are read once more; each pivot's
   partners are stored as a prefix tree (frequent shingles first, so near copies
   share long paths) and the pivot's set walks it: a shared path's overlap is
   counted once, and a subtree is left as soon as the remaining lengths cannot
   reach the threshold.  The comparison is exact.

Steps 3-5 lose no link between classes of different components, so the
components equal those of the full join.  Hot keys: equal sets are reduced per
task before anything is dealt out; pivots come from an aggregation with map-side
combine; partners of a pivot are split into chunks; the classes under a hot shingle
are paired by size and in blocks, each a task's share.  Nothing is gathered on the driver but
bounded tables (``max_frequent`` shingles, a Bloom filter of MAX_BLOOM bits at
most); both change the work, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasample.llm import _text
from terrasample.llm._graph import components
from terrasample.llm._session import TEXT_ROWS, cut, discard, lean, shared_folder, ship

_LOW = np.uint64(6)
_TOP = np.uint64(58)
#: Bits of a shingle's hash that a posting keeps beside its shard's number; equal ones of different shingles only make candidates.
_TOKEN_BITS = 40
#: Postings that a task holds before it deals them out, and that it holds of a shard before it passes all of them on.
DEALT, HELD = 400_000, 2_000_000
#: Partners of a pivot that are compared in one group, and classes of a shingle in one block of pairs.
CHUNK, BLOCK = 64, 512
#: Bits of the largest Bloom filter (32 MB).
MAX_BLOOM = 1 << 28


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _planes(a: np.ndarray, keep: int | None = None) -> bytes:
    """The bytes of an integer array by significance (the lowest ``keep`` ones), so that the shuffle's codec packs the zeros."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize)[:, :keep].T).tobytes()


def _unplanes(data: bytes, kind: type, keep: int | None = None) -> np.ndarray:
    width = np.dtype(kind).itemsize
    some = np.frombuffer(data, np.uint8).reshape(keep or width, -1)
    out = np.zeros((some.shape[1], width), np.uint8)
    out[:, : len(some)] = some.T
    return out.reshape(-1).view(kind)


def ordered(sets: list[np.ndarray], frequent: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The sets as sorted keys: 6 bits of frequency level, then 58 of the hash."""
    token, level = frequent
    if not sets:
        return []
    flat = np.concatenate(sets)
    key = flat >> _LOW
    if len(token):
        at = np.minimum(np.searchsorted(token, flat), len(token) - 1)
        hot = token[at] == flat
        key[hot] |= level[at[hot]].astype(np.uint64) << _TOP
    return [np.sort(k) for k in np.split(key, np.cumsum([len(s) for s in sets])[:-1])]


def prefix_size(n: int, t: float) -> int:
    return n - math.ceil(t * n - 1e-9) + 1 if n else 0


def parity_bitmap(s: np.ndarray) -> bytes:
    """How many shingles fall on each of 2 ** k >= 2 n places, modulo 2."""
    places = 1 << max(8, min(17, (2 * len(s) - 1).bit_length() if len(s) else 0))
    return np.packbits(np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1).tobytes()


def folded(bitmap: bytes) -> np.ndarray:
    """A bitmap folded to 256 places, as four integers."""
    x = np.frombuffer(bitmap, np.uint8)
    while len(x) > 32:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.view(np.int64)


def least_difference(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one set only: the places where the parities differ.

    A longer bitmap is folded onto the shorter one's places first.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class SetTree:
    """Sorted sets as a prefix tree, laid out in lexical order with the length each shares with the one before."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.shared = [0] * len(sets)
        for k in range(1, len(sets)):
            a, b = self.sets[k - 1], self.sets[k]
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            self.shared[k] = int(differ.argmax()) if differ.any() else n

    def linked(self, probe: np.ndarray, t: float, step: int = 64) -> list[int]:
        """Numbers of the sets whose Jaccard similarity with ``probe`` is ``t`` or more (exact, by counts)."""
        found = []
        path = np.zeros(1, np.int64)  # overlap of the current path's first i shingles
        n_probe, num = len(probe), round(t * 10_000)
        sorted_probe = np.sort(probe)
        for k, s in enumerate(self.sets):
            n = len(s)
            depth = min(self.shared[k], len(path) - 1)  # what the walk has counted of the shared path
            path = path[: depth + 1]
            need = -(-num * (n + n_probe) // (10_000 + num))  # 10000 * o >= num * (n + m - o)
            parts = [path]
            overlap = int(path[-1])
            while depth < n and overlap + min(n - depth, n_probe - overlap) >= need:
                piece = s[depth : depth + step]
                at = np.minimum(np.searchsorted(sorted_probe, piece), n_probe - 1)
                hits = np.cumsum(sorted_probe[at] == piece) + overlap
                parts.append(hits)
                overlap, depth = int(hits[-1]), depth + len(piece)
            path = np.concatenate(parts)
            if depth == n and overlap >= need:
                found.append(self.order[k])
        return found


def _bloom_positions(ids: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = _text.mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return np.stack([(h >> np.uint64(21 * k)) & np.uint64(bits - 1) for k in range(3)], 1)


class _Join:
    """The steps of one run; ``rows`` has id (long) and t.  Null ids take part in nothing but ``sets``."""

    def __init__(self, rows: DataFrame, width: int, t: float, max_frequent: int, folder: str | None = None):
        self.rows, self.docs = rows, rows.where("id is not null")
        self.width, self.t, self.max_frequent = width, t, max_frequent
        self.spark = rows.sparkSession
        self.folder = folder or shared_folder(self.spark)
        self.partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ship(self.spark)

    def sets(self) -> None:
        """Sizes and signatures of all documents, and counts of the shingles that repeat within a batch."""
        width, local = self.width, 3
        names = ["id", "n", "s1", "s2", "bits", "w", "token", "count"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            seen: set[bytes] = set()  # signatures in this task: copies count once

            def counts() -> pa.RecordBatch:
                token, n = np.unique(np.concatenate(held), return_counts=True)
                token, n = token[n >= local], n[n >= local]
                none = pa.nulls(len(token), pa.int64())
                held.clear()
                return pa.RecordBatch.from_arrays(
                    [
                        none, none, none, none, pa.nulls(len(token), pa.binary()),
                        pa.nulls(len(token), pa.list_(pa.int64())), _signed(token), pa.array(n)
                    ],
                    names=names
                )

            for batch in batches:
                for i, j in _text.slices(batch.column(1)):
                    sets = _text.shingle_sets(batch.column(1).slice(i, j - i), width)
                    with np.errstate(over="ignore"):
                        s1 = np.array([_text.mix(s.copy()).sum(dtype=np.uint64) for s in sets], np.uint64)
                        s2 = np.array([np.bitwise_xor.reduce(_text.mix(s * np.uint64(0x9E3779B97F4A7C15))) if len(s) else 0 for s in sets], np.uint64)
                    n = np.array([len(s) for s in sets], np.int64)
                    for k, s in enumerate(sets):
                        mark = s1[k].tobytes() + s2[k].tobytes()
                        if mark not in seen:
                            seen.add(mark)
                            held.append(s)
                    bitmaps = [parity_bitmap(s) for s in sets]
                    bits, small = pa.array(bitmaps, pa.binary()), pa.array([folded(b) for b in bitmaps], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(i, j - i), pa.array(n), _signed(s1), _signed(s2), bits, small,
                            pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())
                        ],
                        names=names
                    )
                    if sum(map(len, held)) > 1_000_000:
                        yield counts()
            if held:
                yield counts()

        both = cut(
            self.rows.mapInArrow(lean(run), "id bigint, n bigint, s1 bigint, s2 bigint, bits binary, w array<bigint>, token bigint, count bigint"),
            self.folder, "sets", TEXT_ROWS
        )
        self.stats = both.where("n is not null").select("id", "n", "s1", "s2")
        self.bits = both.where("n > 0 and id is not null").select("id", "n", "bits")
        self.small = both.where("n > 0 and id is not null").select("id", *(F.col("w")[k].alias(f"w{k}") for k in range(4)))
        self.classes = self.stats.where("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"))
        counted = both.where("token is not null").groupBy("token").agg(F.sum("count").alias("df")).where("df >= 8")
        counted = cut(counted.withColumn("level", F.floor(F.log2("df")).cast("int")), self.folder, "frequent")
        per_level = {r["level"]: r["count"] for r in counted.groupBy("level").count().collect()}
        keep, total = 99, 0
        for level in sorted(per_level, reverse=True):  # the most frequent ones, a bounded table
            total += per_level[level]
            if total > self.max_frequent:
                break
            keep = level
        table = counted.where(F.col("level") >= keep).select("token", "level").toArrow()
        token = table.column("token").to_numpy().view(np.uint64)
        order = np.argsort(token)
        self.frequent = self.spark.sparkContext.broadcast((token[order], table.column("level").to_numpy()[order]))

    def postings(self) -> None:
        """token, rep, n, pos: the prefix shingles that two classes or more share."""
        width, t, shards, frequent = self.width, self.t, self.partitions * 2, self.frequent
        low = np.uint64((1 << _TOKEN_BITS) - 1)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[tuple[int, bytes], int] = {}
            ids: list[int] = []
            marks: list[int] = []
            sizes: list[int] = []
            prefixes: list[np.ndarray] = []
            held = 0

            def flush() -> pa.RecordBatch:
                """A row for each shard: its classes (id, mark, size), and its shingles with their class and place."""
                nonlocal held
                size = np.array([len(p) for p in prefixes])
                token = _text.mix(np.concatenate(prefixes))
                doc = np.repeat(np.arange(len(prefixes), dtype=np.uint32), size)
                pos = (np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint32)
                shard = ((token >> np.uint64(_TOKEN_BITS)) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[order], np.arange(shards + 1))
                own_ids, own_marks, own_sizes = np.array(ids, np.int64), np.array(marks, np.int64), np.array(sizes, np.uint32)
                rows: list[tuple] = []
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    own = order[edges[k] : edges[k + 1]]
                    some, at = np.unique(doc[own], return_inverse=True)  # in order, so differences are small
                    rows.append(
                        (
                            k, _planes(np.diff(own_ids[some], prepend=0)), _planes(own_marks[some]),
                            _planes(own_sizes[some]), _planes(token[own] & low, 5),
                            _planes(np.diff(at.astype(np.uint32), prepend=np.uint32(0))), _planes(pos[own])
                        )
                    )
                ids.clear(), marks.clear(), sizes.clear(), prefixes.clear()
                held = 0
                shard_of, *parts = zip(*rows, strict=True) if rows else ((),) * 7
                return pa.RecordBatch.from_arrays(
                    [pa.array(shard_of, pa.int32()), *(pa.array(x, pa.binary()) for x in parts)],
                    names=["shard", *packed]
                )

            for batch in batches:
                for i, j in _text.slices(batch.column(1)):
                    sets = _text.shingle_sets(batch.column(1).slice(i, j - i), width)
                    own = batch.column(0).slice(i, j - i).to_pylist()
                    keys = ordered(sets, frequent.value)
                    for d, s, k in zip(own, sets, keys, strict=True):
                        if not len(s):
                            continue
                        with np.errstate(over="ignore"):
                            mark = int(_text.mix(s.copy()).sum(dtype=np.uint64).view(np.int64))
                        if (len(s), mark) in seen and seen[len(s), mark] <= d:
                            continue  # an equal set of a smaller id in this task stands for it
                        seen[len(s), mark] = d
                        ids.append(d), marks.append(mark), sizes.append(len(s))
                        prefixes.append(k[: prefix_size(len(s), t)])
                        held += len(prefixes[-1])
                    if held > DEALT:
                        yield flush()
            if prefixes:
                yield flush()

        def shared(number: int, rows: list[tuple], whole: bool) -> Iterator[pa.RecordBatch]:
            """The postings of some of a shard's rows; of all of them (``whole``) only shingles that more than one set has."""
            parts = []
            for docs_in, marks_in, sizes_in, tokens, doc, places in rows:
                at = np.cumsum(_unplanes(doc, np.uint32), dtype=np.int64)
                rep, mark, n = np.cumsum(_unplanes(docs_in, np.int64)), _unplanes(marks_in, np.int64), _unplanes(sizes_in, np.uint32)
                parts.append((_unplanes(tokens, np.uint64, 5), rep[at], n[at], _unplanes(places, np.uint32), mark[at]))
            token, rep, n, pos, mark = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()

            def groups() -> np.ndarray:
                edge = np.flatnonzero(np.append(True, token[1:] != token[:-1]))[: len(token)]
                size = np.diff(np.append(edge, len(token)))
                return np.repeat(size > 1, size)

            order = np.argsort(token, kind="stable")
            token = token[order]
            if whole:
                many = groups()
                token, order = token[many], order[many]
            rep, n, pos, mark = rep[order], n[order], pos[order], mark[order]
            # equal sets from different tasks: the smallest id stands for them
            order = np.lexsort((rep, n, mark, token))
            token, rep, n, pos, mark = token[order], rep[order], n[order], pos[order], mark[order]
            keep = np.append(True, (token[1:] != token[:-1]) | (mark[1:] != mark[:-1]) | (n[1:] != n[:-1]))[: len(token)]
            token, rep, n, pos = token[keep], rep[keep], n[keep], pos[keep]
            keep = np.flatnonzero(groups()) if whole else np.arange(len(token))
            for i in range(0, len(keep), 50_000):
                own = keep[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(token[own] | np.uint64(number) << np.uint64(_TOKEN_BITS)), pa.array(rep[own]),
                        pa.array(n[own].astype(np.int32)), pa.array(pos[own].astype(np.int32))
                    ],
                    names=["token", "rep", "n", "pos"]
                )

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Shard after shard; one with too many postings to hold is passed on in parts, with the shingles of one set."""
            shard, rows, held, whole = None, [], 0, True
            for b in batches:
                for k in range(len(b)):
                    number = b.column(0)[k].as_py()
                    if number != shard:
                        if rows:
                            yield from shared(shard, rows, whole)
                        shard, rows, held, whole = number, [], 0, True
                    rows.append(tuple(b.column(c)[k].as_py() for c in range(1, 7)))
                    held += len(rows[-1][-1]) // 4
                    if held > HELD:
                        whole = False
                        yield from shared(shard, rows, whole)
                        rows, held = [], 0
            if rows:
                yield from shared(shard, rows, whole)

        packed = ["docs", "marks", "sizes", "tokens", "doc", "pos"]
        dealt = self.docs.mapInArrow(lean(deal), "shard int, " + ", ".join(f"{c} binary" for c in packed))
        dealt = dealt.repartitionById(self.partitions, F.pmod("shard", F.lit(self.partitions))).sortWithinPartitions("shard")
        self.post = cut(dealt.mapInArrow(lean(gather), "token bigint, rep bigint, n int, pos int"), self.folder, "postings", TEXT_ROWS)

    def _fits(self, a: str, b: str) -> str:
        return f"least({a}, {b}) >= {self.t!r} * greatest({a}, {b}) - 1e-6"

    def stars(self) -> DataFrame:
        """(a, b): each class with its shingles' pivots, where many share the shingle or the two share half of the shorter prefix.

        The pivot is the smallest set: with the fewest shingles of its own it
        links with all that differ little from what they share.
        """
        pivot = self.post.groupBy("token").agg(F.count("*").alias("many"), F.min(F.struct("n", "rep")).alias("p")).select(
            "token", F.col("p.rep").alias("a"), F.col("p.n").alias("na"), "many"
        )
        half = F.ceil((1 - self.t) * F.least("n", "na") / 2)
        pairs = self.post.join(pivot, "token").where("rep <> a").where(self._fits("n", "na")).groupBy("a", F.col("rep").alias("b")).agg(
            F.count("*").alias("c"), F.first("n").alias("n"), F.first("na").alias("na"), F.max("many").alias("many")
        )
        return pairs.where((F.col("c") >= half) | (F.col("many") >= 8)).select("a", "b")

    def _mixed(self, component: DataFrame) -> DataFrame:
        """The postings with their classes' components, of shingles that several components share and one class has in its short prefix; ``hot``: many have."""
        p = self.post.join(component, F.col("rep") == F.col("node"), "left").select(
            "token", "rep", "n", "pos", F.coalesce("component", "rep").alias("comp"),
            F.expr(f"pos <= n - ceil({2 * self.t / (1 + self.t)!r} * n - 1e-6)").alias("short")
        )
        mixed = p.groupBy("token").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count_if("short").alias("shorts")
        ).where("lo <> hi and shorts > 0").select("token", (F.col("shorts") > BLOCK).alias("hot"))
        return p.join(mixed, "token")

    def more_stars(self, component: DataFrame) -> DataFrame:
        """(a, b) of different components: with each shingle's pivot drawn by a hash, so that a large group's members meet many pivots."""
        p = self._mixed(component)
        drawn = F.xxhash64("token", "rep")
        pivot = p.groupBy("token").agg(
            F.count("*").alias("many"), F.min_by(F.struct("rep", "n", "comp"), drawn).alias("p")
        ).where("many >= 8").select(
            "token", F.col("p.rep").alias("a"), F.col("p.n").alias("na"), F.col("p.comp").alias("ca")
        )
        return p.join(pivot, "token").where("comp <> ca").where(self._fits("n", "na")).select("a", F.col("rep").alias("b")).distinct()

    def rest(self, component: DataFrame) -> DataFrame:
        """(a, b): classes of different components that share prefix shingles and could still reach the threshold; a is the smaller set.

        Of two sets that link the smaller one's *short* prefix has a shingle of the
        larger one's prefix, so only postings of short prefixes meet the others: sets
        that share a frequent passage and too little else have none of it there.
        All common shingles of two sets lie at or after their first common one, so the
        rest from there on bounds the overlap, and by that the partner's size.  Under
        a hot shingle sets meet by classes of size (16 to a doubling): the larger set
        goes to those of the sizes that its place allows, the smaller one to its own,
        in blocks where it is crowded.  Sets share whole passages: where the shingle
        before is the same in both prefixes, this one isn't the first, and the pair
        isn't made again.  Parities of 256 places drop pairs that differ too much
        within the join.
        """
        share = self.t / (1 + self.t)  # a link's overlap >= share * (na + nb)
        own = Window.partitionBy("rep").orderBy("pos", "token")  # a set's prefix
        p = self._mixed(component).withColumn("prev", F.lag("token").over(own))
        p = cut(p.join(self.small, F.col("rep") == F.col("id")).drop("id"), self.folder, "mixed")
        of = lambda size: f"cast(floor(16 * log2({size}) + 1e-9) as int)"
        cell = lambda c: p.withColumn("cell", F.expr(c))
        small = cell(f"if(hot, {of('n')}, 0)").where("short")
        # the least and the largest size of a smaller set that a set of n can link with from this place on
        least, most = f"greatest(ceil({self.t!r} * n - 1e-6), 1)", f"least(n, floor((n - pos) / {share!r} - n + 1e-6))"
        large = cell(f"explode(if(hot, if({most} >= {least}, sequence({of(least)}, {of(most)}), array()), array(0)))")
        crowds = small.where("hot").groupBy("token", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        small, large = (x.join(crowds, ["token", "cell"], "left") for x in (small, large))
        large = large.where("not hot or blocks is not null")  # nobody to meet
        # each block of the smaller sets meets all larger ones, block by block
        blocks = F.coalesce("blocks", F.lit(1))
        left, right = (
            rows.select(
                "token", "cell", block.alias("block"), F.col("rep").alias(x), F.col("n").alias(f"n{x}"),
                F.col("pos").alias(f"p{x}"), F.col("comp").alias(f"c{x}"), F.col("prev").alias(f"prev_{x}"),
                *(F.col(f"w{k}").alias(f"w{k}{x}") for k in range(4))
            ) for rows, x, block in (
                (small, "a", F.pmod(F.xxhash64("rep"), blocks).cast("int")),
                (large, "b", F.explode(F.sequence(F.lit(0), blocks - 1)))
            )
        )
        differ = F.expr(
            " + ".join(f"bit_count(w{k}a ^ w{k}b)" for k in range(4)) + f" <= na + nb - 2 * ceil({share!r} * (na + nb) - 1e-6)"
        )
        reach = F.expr(f"least(na - pa, nb - pb) >= {share!r} * (na + nb) - 1e-6")
        smaller = F.expr("(na < nb or na = nb and a < b) and ca <> cb")
        same = (left[k] == right[k] for k in ("token", "cell", "block"))
        on = [*same, smaller, F.expr(self._fits("na", "nb")), reach, F.expr("not coalesce(prev_a = prev_b, false)"), differ]
        return left.join(right, on).select("a", "b").distinct()

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Without the pairs whose bitmaps prove too great a difference (no link is lost)."""
        t = self.t

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column("n").to_numpy() + batch.column("m").to_numpy()
                most = n - 2 * np.ceil(t / (1 + t) * n - 1e-6)
                keep = np.array(
                    [least_difference(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
                ) <= most
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

        first = self.bits.select(F.col("id").alias("a"), "n", F.col("bits").alias("x"))
        second = self.bits.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
        return pairs.join(first, "a").join(second, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(lean(run), "a bigint, b bigint")

    def bloom(self, ids: DataFrame) -> np.ndarray:
        """A Bloom filter of a table of ids, put together from each partition's own: 16 bits an id, up to MAX_BLOOM."""
        bits = min(MAX_BLOOM, 1 << max(16, (16 * ids.count() - 1).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.unique(_bloom_positions(b.column(0).to_numpy(), bits))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
                yield pa.RecordBatch.from_arrays([_signed(word), _signed(value)], names=["word", "value"])

        rows = ids.mapInArrow(run, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
        out = np.zeros(bits // 64, np.uint64)
        out[rows.column("word").to_numpy()] = rows.column("value").to_numpy().view(np.uint64)
        return out

    def compare(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that link, by their whole sets."""
        width, t, frequent = self.width, self.t, self.frequent
        pairs = cut(self.plausible(pairs).distinct(), self.folder, f"pairs-{name}", TEXT_ROWS)
        need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        bloom = self.spark.sparkContext.broadcast(self.bloom(need))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = _bloom_positions(batch.column(0).to_numpy(), 64 * len(bloom.value))
                hit = ((bloom.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)
                batch = pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(hit)) for k in (0, 1)], names=["id", "t"])
                for i, j in _text.slices(batch.column(1)):
                    sets = ordered(_text.shingle_sets(batch.column(1).slice(i, j - i), width), frequent.value)
                    # frequent shingles first, so that near copies share long paths of the tree
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i), pa.array([(~s[::-1]).tobytes() for s in sets], pa.binary())],
                        names=["id", "s"]
                    )

        sets = cut(self.docs.mapInArrow(lean(read), "id bigint, s binary").join(need, "id", "left_semi"), self.folder, f"compare-{name}", TEXT_ROWS)
        bloom.unpersist()
        chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        salted = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("salt"))
        partners = salted.join(sets, F.col("b") == F.col("id")).select("a", "salt", F.lit(1).alias("kind"), "b", "s")
        pivots = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("id")).select(
            "a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "s"
        )
        both = pivots.unionByName(partners).repartition(self.partitions, "a", "salt").sortWithinPartitions("a", "salt", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probes: list[np.ndarray] = []
            group: tuple[int, int] | None = None
            ids: list[int] = []
            sets_in: list[np.ndarray] = []
            held = 0

            def flush() -> pa.RecordBatch:
                nonlocal held
                found = sorted({ids[k] for tree in [SetTree(sets_in)] for p in probes for k in tree.linked(p, t)}) if sets_in and probes else []
                ids.clear(), sets_in.clear()
                held = 0
                return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

            for batch in batches:
                for a, salt, kind, b, s in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                    batch.column(3).to_pylist(), batch.column(4), strict=True
                ):
                    if (a, salt) != group:
                        if sets_in:
                            yield flush()
                        group, probes = (a, salt), []
                    values = np.frombuffer(s.as_py(), np.uint64)
                    if kind == 0:
                        probes.append(values)
                        continue
                    ids.append(b), sets_in.append(values)
                    held += len(values)
                    if held > 500_000:
                        yield flush()
            if sets_in:
                yield flush()

        found = cut(both.mapInArrow(lean(run), "a bigint, b bigint"), self.folder, f"links-{name}", TEXT_ROWS)
        discard(self.spark, self.folder, f"pairs-{name}", f"compare-{name}")
        return found

    def run(self) -> DataFrame:
        """(rep, component) of every class that has a link, by the smallest id."""
        self.sets()
        self.postings()
        star = self.compare(self.stars(), "star")
        first = components(star, self.folder, "star-components")
        as_edges = lambda c: c.select(F.col("node").alias("a"), F.col("component").alias("b"))
        more = self.compare(self.more_stars(first), "more")
        second = components(as_edges(first).unionByName(more), self.folder, "more-components")
        rest = self.compare(self.rest(second), "rest")
        discard(self.spark, self.folder, "postings", "mixed")
        return components(as_edges(second).unionByName(rest), self.folder, "components")


def linked_pairs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.75,
    max_frequent: int = 1 << 19, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The whole join: (a, b) of every two classes that link, a < b by their representatives; and (doc_id, class_id) of every document with words.

    Documents with equal sets are one class, represented by the smallest id, and
    link with each other and with all of a linked class; a copy's pairs aren't
    written out.  No pair of different classes is left out because both are in one
    component already: this costs what the number of such pairs costs, which
    :func:`similar_documents` is spared.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    join = _Join(own, width, threshold, max_frequent, folder)
    join.sets()
    join.postings()
    alone = join.docs.sparkSession.createDataFrame([], "node bigint, component bigint")  # every class by itself
    links = join.compare(join.rest(alone), "all").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    s, c = join.stats.where("id is not null and n > 0"), join.classes.select(
        F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.col("n").alias("m"), "rep"
    )
    member = s.join(
        c, (s["s1"] == c["k1"]) & (s["s2"] == c["k2"]) & (s["n"] == c["m"])
    ).select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"))
    return links, member


def similar_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.75,
    max_frequent: int = 1 << 19, folder: str | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; :func:`linked_pairs` gives the links themselves.

    Words are split at blanks after A-Z are lower-cased.  A text of fewer words
    than ``width`` has its whole sequence as its one shingle.  Texts without
    words (and null) have an empty set and are linked with nothing.  A null id
    keeps its row, links nothing and has a null component.  Rows that share an
    id but not the text each get the component of their own text.  Extra columns
    aren't read; an empty table gives an empty table.  A very long text is one
    row's arrays in one task.  The result reads tables below ``folder`` (a new
    shared folder), which may be discarded once the result is written.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    join = _Join(own, width, threshold, max_frequent, folder)
    linked = join.run()
    reps = join.classes.join(linked, F.col("rep") == F.col("node"), "left").select(
        "s1", "s2", F.col("n").alias("m"), F.coalesce("component", "rep").alias("c")
    )
    s = join.stats
    return s.join(reps, (s["s1"] == reps["s1"]) & (s["s2"] == reps["s2"]) & (s["n"] == reps["m"]), "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id")
    )
