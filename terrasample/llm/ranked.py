"""Ranked lexical search by two trees: the best documents of every query, exactly.

A pass over the texts counts the queries' terms in every document and writes them as
short lists; N, L and the document frequencies are sums over that table.  The search
itself runs on blocks of documents within a task.  A document's coordinate for a term
is what the term adds to its score, an item's is 1 for its terms.  Both sides have a
hierarchy whose nodes hold the coordinate maxima of all below them, so the sum over an
item node's terms of a document node's maxima is at least every score between the two.
Node pairs are descended from the roots; a pair whose bound stays below the weakest
k-th score of its items is dropped with all it holds, and never one that could tie.

The k-th scores begin with those of a bounded sample of documents (they only make the
search start well: a lower bound of the final k-th score drops nothing of the result)
and rise with every block.  A task passes on at most k documents an item, and a
window over the items' numbers puts the tasks' lists together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasample.llm import _text
from terrasample.llm._session import TEXT_ROWS, cut, discard, lean, shared_folder, ship

#: Children of a tree's node.
FAN = 8
#: Items and distinct terms of one item tree; entries of a block's matrix (documents times terms).
TREE_ITEMS, TREE_TERMS, BLOCK = 256, 4096, 1 << 21
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Terms:
    """The distinct terms of some queries, found in texts by hash and confirmed by their bytes."""

    def __init__(self, words: list[bytes]):
        self.words = sorted(words)
        size = np.array([len(w) for w in self.words], np.int64)
        data = np.frombuffer(b"".join(self.words), np.uint8)
        end = np.cumsum(size)
        for seed in range(16):
            byte = _text._BYTE.copy() if not seed else np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
            byte[0x41:0x5B] = byte[0x61:0x7B]
            h = _text.word_hashes(data, end - size, end, byte)
            if len(np.unique(h)) == len(h):
                break
        else:
            raise RuntimeError("terms of equal hashes under every seed")
        order = np.argsort(h)
        self.byte, self.hashes, self.number = byte, h[order], order
        self.data, self.first, self.size = data, end - size, size

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and number of each occurrence of a term in a column of texts, and how many words each row has."""
        data, off = _text.raw(column)
        starts, ends, count = _text.spans(data, off, _text.NOT_ALNUM)
        row = np.repeat(np.arange(len(count), dtype=np.int64), count)
        if not len(starts) or not len(self.hashes):
            return row[:0], row[:0], count
        h = _text.word_hashes(data, starts, ends, self.byte)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[place] == h)
        number = self.number[place[at]]
        same = ends[at] - starts[at] == self.size[number]
        at, number = at[same], number[same]
        if len(at):
            size = self.size[number]
            begin = np.cumsum(size) - size
            step = np.arange(int(size.sum())) - np.repeat(begin, size)
            differ = LOWER[data[np.repeat(starts[at], size) + step]] != self.data[np.repeat(self.first[number], size) + step]
            same = ~np.logical_or.reduceat(differ, begin)
            at, number = at[same], number[same]
        return row[at], number, count


def words_of(text: str | None) -> set[bytes]:
    """The distinct terms of one text."""
    data, off = _text.raw(pa.array([text], pa.string()))
    starts, ends, _ = _text.spans(data, off, _text.NOT_ALNUM)
    low = LOWER[data].tobytes()
    return {low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}


@dataclass
class Node:
    """Items ``first`` to ``end`` of a tree and the terms that any of them has (its coordinate maxima are 1 there)."""

    first: int
    end: int
    terms: np.ndarray
    children: list[Node]


@dataclass
class Tree:
    """A hierarchy of items; ``items`` are their numbers in the tree's order, ``terms`` the terms that it numbers anew."""

    items: np.ndarray
    terms: np.ndarray
    root: Node


def _node(sets: list[np.ndarray], first: int, end: int) -> Node:
    if end - first == 1:
        return Node(first, end, sets[first], [])
    step = -(-(end - first) // FAN)
    children = [_node(sets, i, min(i + step, end)) for i in range(first, end, step)]
    return Node(first, end, np.unique(np.concatenate([c.terms for c in children])), children)


def item_trees(sets: list[np.ndarray], weight: np.ndarray) -> list[Tree]:
    """Trees over items (their terms' numbers), items that share their weightiest terms beside each other."""
    some = [k for k, s in enumerate(sets) if len(s)]
    some.sort(key=lambda k: tuple(sets[k][np.lexsort((sets[k], -weight[sets[k]]))[:4]].tolist()))
    groups: list[list[int]] = []
    terms: set[int] = set()
    for k in some:
        more = terms | set(sets[k].tolist())
        if not groups or len(groups[-1]) == TREE_ITEMS or len(more) > TREE_TERMS:
            groups.append([])
            more = set(sets[k].tolist())
        groups[-1].append(k)
        terms = more
    out = []
    for own in groups:
        used = np.unique(np.concatenate([sets[k] for k in own]))
        out.append(Tree(np.array(own), used, _node([np.searchsorted(used, sets[k]) for k in own], 0, len(own))))
    return out


class Best:
    """The k best documents of some items so far, and the scores below which nothing matters."""

    def __init__(self, items: int, k: int, floor: np.ndarray):
        self.k, self.weakest = k, np.maximum(floor, 1)  # a score of 0 isn't ranked
        self.score = [np.zeros(0, np.int64)] * items
        self.id = [np.zeros(0, np.int64)] * items

    def add(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        some = score >= self.weakest[item]
        if not some.any():
            return
        score, ids = np.concatenate((self.score[item], score[some])), np.concatenate((self.id[item], ids[some]))
        order = np.lexsort((ids, -score))[: self.k]
        self.score[item], self.id[item] = score[order], ids[order]
        if len(order) == self.k:
            self.weakest[item] = max(self.weakest[item], int(score[order[-1]]))


def _levels(doc: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int, terms: int) -> list[np.ndarray]:
    """Coordinates of documents (term x document) and the maxima of each FAN of them, up to one root."""
    base = np.zeros((terms, -(-docs // FAN) * FAN), np.int64)
    base[term, doc] = value
    levels = [base]
    while levels[-1].shape[1] > 1:
        last = levels[-1]
        pad = -last.shape[1] % FAN
        if pad:
            last = np.concatenate((last, np.zeros((terms, pad), np.int64)), 1)
        levels.append(last.reshape(terms, -1, FAN).max(2))
    return levels


def search_block(tree: Tree, best: Best, doc: np.ndarray, term: np.ndarray, value: np.ndarray, ids: np.ndarray) -> int:
    """Descend a tree of items and one over a block's documents together; returns how many scores were computed.

    ``doc``, ``term`` (of the tree's terms) and ``value`` are the coordinates; ``ids`` the documents'.
    """
    docs = len(ids)
    # documents of the same largest coordinate stand together, so that the nodes' maxima are close to theirs
    top = np.zeros(docs, np.int64)
    strongest = np.lexsort((term, value))
    top[doc[strongest]] = term[strongest]
    order = np.argsort(top, kind="stable")
    place = np.empty(docs, np.int64)
    place[order] = np.arange(docs)
    levels, ids = _levels(place[doc], term, value, docs, len(tree.terms)), ids[order]
    scored = 0

    def below(nodes: np.ndarray, level: int) -> np.ndarray:
        found = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return found[found < (docs if level == 1 else levels[level - 1].shape[1])]

    # an explicit stack: a function that called itself would keep each block's matrices until a garbage collection
    pairs = [(tree.root, len(levels) - 1, np.zeros(1, np.int64))] if docs and len(doc) else []
    while pairs:
        node, level, nodes = pairs.pop()
        bound = levels[level][np.ix_(node.terms, nodes)].sum(0)
        keep = bound >= best.weakest[tree.items[node.first : node.end]].min()
        nodes, bound = nodes[keep], bound[keep]
        if not len(nodes):
            continue
        if node.children:
            down = max(level - 1, 1)  # items first: single documents are only scored against single items
            inner = nodes if down == level else below(nodes, level)
            pairs += [(child, down, inner) for child in node.children]
        elif level > 1:
            pairs.append((node, level - 1, below(nodes, level)))
        else:  # the nodes of the highest bounds first, until those left can't reach the k-th score
            item = int(tree.items[node.first])
            nodes, bound = nodes[order := np.argsort(-bound, kind="stable")], bound[order]
            for i in range(0, len(nodes), 16):
                now = nodes[i : i + 16][bound[i : i + 16] >= best.weakest[item]]
                if not len(now):
                    break
                own = below(now, 1)
                scored += len(own)
                best.add(item, levels[0][np.ix_(node.terms, own)].sum(0), ids[own])
    return scored


#: Stands for a null id within a task: after all others.
_NULL = np.iinfo(np.int64).max


def _search(batches: Iterator[pa.RecordBatch], sets: list[np.ndarray], weight: np.ndarray, floor: np.ndarray, k: int, docs: int, terms: int) -> Iterator[pa.RecordBatch]:
    """The k best of a task's documents for each item: item, score, doc."""
    best = Best(len(sets), k, floor)
    trees = item_trees(sets, weight)
    for batch in batches:
        count = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        off = np.append(0, np.cumsum(count))
        flat, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
        n = batch.column("n").to_numpy()
        ids = batch.column("doc").fill_null(_NULL).to_numpy()
        m = np.repeat(100 - 90 + 90 * n * docs // max(1, terms), count)
        value = weight[flat] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        for tree in trees:
            step = max(FAN * FAN, BLOCK // max(1, len(tree.terms)))
            mine = np.full(len(weight), -1, np.int64)
            mine[tree.terms] = np.arange(len(tree.terms))
            for i in range(0, len(ids), step):
                j = min(i + step, len(ids))
                some = np.flatnonzero(mine[flat[off[i] : off[j]]] >= 0) + off[i]
                row = np.repeat(np.arange(j - i), count[i:j])[some - off[i]]
                search_block(tree, best, row, mine[flat[some]], value[some], ids[i:j])
    for item, (score, ids) in enumerate(zip(best.score, best.id, strict=True)):
        if len(score):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(score), item, np.int32)), pa.array(score), pa.array(ids, mask=ids == _NULL)], names=["item", "score", "doc"]
            )


def _postings(docs: DataFrame, terms, id_col: str, text_col: str, folder: str, name: str) -> DataFrame:
    """doc, n (its terms with repeats), terms and tfs (of the queries' terms) of every row, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(terms.value.words)
        for batch in batches:
            for i, j in _text.slices(batch.column(1)):
                row, number, n = terms.value.find(batch.column(1).slice(i, j - i))
                key, tf = np.unique(row * size + number, return_counts=True)
                off = pa.array(np.searchsorted(key, np.arange(j - i + 1) * size).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(off, pa.array((key % max(1, size)).astype(np.int32))),
                        pa.ListArray.from_arrays(off, pa.array(tf.astype(np.int32)))
                    ],
                    names=["doc", "n", "terms", "tfs"]
                )

    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("t"))
    return cut(source.mapInArrow(lean(run), "doc bigint, n bigint, terms array<int>, tfs array<int>"), folder, name, TEXT_ROWS)


def _part(docs: DataFrame, ids: pa.Array, texts: list[str], k: int, id_col: str, text_col: str, sample_rows: int, folder: str, name: str) -> DataFrame:
    """Each item's candidates: item (its number), score, doc; at most k of a task."""
    spark = docs.sparkSession
    own = [words_of(t) for t in texts]
    terms = Terms(sorted(set().union(*own)))
    number = {w: i for i, w in enumerate(terms.words)}
    sets = [np.array(sorted(number[w] for w in s), np.int64) for s in own]
    table = _postings(docs, spark.sparkContext.broadcast(terms), id_col, text_col, folder, f"postings-{name}")
    rows, some, total = table.agg(F.count("*"), F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(len(terms.words), np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most a row a term of this part
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * some + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    whole = spark.sparkContext.broadcast((sets, weight))
    schema = "item int, score bigint, doc bigint"

    def searched(of: DataFrame, floor: np.ndarray) -> DataFrame:
        start = spark.sparkContext.broadcast(floor)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _search(batches, *whole.value, start.value, k, some, total or 0)

        return of.mapInArrow(lean(run), schema)

    share = min(1 / 8, sample_rows / max(1, rows))
    sample = table.where(F.pmod(F.xxhash64("doc", "n"), F.lit(1 << 30)) < int(share * (1 << 30)))
    nth = Window.partitionBy("item").orderBy(F.desc("score"))
    floor = np.zeros(len(sets), np.int64)
    for r in cut(searched(sample, floor), folder, f"sample-{name}", TEXT_ROWS).withColumn("r", F.row_number().over(nth)).where(F.col("r") == k).collect():  # a row an item
        floor[r["item"]] = r["score"]
    found = cut(searched(table, floor), folder, f"found-{name}", TEXT_ROWS)
    discard(spark, folder, f"postings-{name}", f"sample-{name}")
    return found


def rank(
    docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", sample_rows: int = 20_000, part_chars: int = 4_000_000
) -> DataFrame:
    """Each item's ``k`` documents of the highest score above 0: item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII letters and digits and of characters from U+0080, A-Z lower-cased.  A term's
    weight is floor(1000 * ln((2N + 2) / (2df + 1))), its part of a score that weight times
    (10^9 tf) div (1000 tf + 8m) with m = 10 + (90 n N) div L, all but the logarithm in 64-bit integers.

    Equal scores rank by ascending id, null ids last.  Documents without text or terms count nowhere;
    repeated rows and ids are documents each.  Items without text or terms, or that share none
    with a document, give no rows; items of one id (or none) are ranked each by itself.  An empty
    table on either side gives no rows.  Extra columns aren't read.

    Items are taken in parts of about ``part_chars`` characters (one item's text at least), the only thing
    of theirs that is on the driver or in a task at a time; each part reads the documents once.
    ``sample_rows`` bounds the documents whose scores give the search its first lower bounds.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = shared_folder(spark)
    kind = dict(items.dtypes)[item_id]
    use = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    parts = max(1, -(-(use.agg(F.sum(F.length("t"))).first()[0] or 0) // part_chars))
    ranked = []
    for p in range(parts):
        table = (use if parts == 1 else use.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == p)).toArrow()  # about part_chars characters
        if not table.num_rows:
            continue
        ids = table.column("i").combine_chunks()
        found = _part(docs, ids, table.column("t").to_pylist(), k, id_col, text_col, sample_rows, folder, str(p))
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), "i": ids}))
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked.append(top.join(names, "item").select(F.col("i").cast(kind).alias(item_id), "rank", F.col("doc").alias(id_col), "score"))
    if not ranked:
        return spark.createDataFrame([], f"`{item_id}` {kind}, rank int, `{id_col}` bigint, score bigint")
    out = ranked[0]
    for more in ranked[1:]:
        out = out.unionByName(more)
    return out
