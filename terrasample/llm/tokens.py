"""Token ids of whole texts, written as wavelet-matrix shards and read back.

Documents are dealt out by ranges of their id, encoded in order, and each task
writes shards of about ``shard_tokens`` ids; a document is never split.  The
shards are rows of a Parquet table in the shared folder, one file format each
(:mod:`terrasample.llm.wavelet`), so the writer's commit protocol covers lost
executors.  Reading decodes shards in parallel; only sums per range and shard
are combined to find each document's first token.

Encoding: the byte-level tokenizer splits a text into pieces and encodes each
piece by itself.  The split is done in NumPy for a whole batch, and the
tokenizers library encodes each distinct piece once per worker, as long as the
table of pieces that it keeps has room.  Other tokenizers, and texts that hold
one of a tokenizer's special tokens, go to the library as they are.

Memory: a worker holds one shard's ids, the temporaries of ``SLICE`` bytes of
text (or of one text, if it is longer) and at most ``PIECES`` pieces; what a
task held is given back at its end.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasample.llm import _text
from terrasample.llm._session import TEXT_ROWS, cut, lean, shared_folder, ship
from terrasample.llm.wavelet import WaveletMatrix

_LETTER, _NUMBER, _OTHER, _SPACE, _UNKNOWN = range(5)
_K = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are encoded at once, and pieces that a worker keeps (some 40 bytes each).
SLICE, PIECES = 400_000, 400_000


class Encoder:
    """Encodes columns of texts with a tokenizer file; keeps the pieces it has seen (at most ``most``)."""

    def __init__(self, path: str, most: int = PIECES):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        pre = json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}
        spec = json.loads(self.tokenizer.to_str())
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor") and spec["model"]["type"] == "BPE"
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.kind = np.full(0x110000, _UNKNOWN, np.uint8)
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if self.by_piece and len(newline) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.key, self.slot, self.uses = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def make_room(self) -> None:
        """Keep the pieces that more than one slice had; all go where these are most of them."""
        often = self.uses[self.slot] > 1
        if 2 * often.sum() > self.most or not often.any():
            return self.clear()
        slot = self.slot[often]
        size = self.first[slot + 1] - self.first[slot]
        end = np.cumsum(size)
        self.pool = self.pool[np.repeat(self.first[slot] - end + size, size) + np.arange(int(end[-1]))]
        self.key, self.slot, self.uses, self.first = self.key[often], np.arange(len(slot)), np.ones(len(slot), np.int64), np.append(0, end)

    def encode_pieces(self, pieces: list[str], blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has.

        Pieces that don't end in white space are encoded some hundred at a time,
        apart by line feeds: these split off by themselves, and their id tells
        where a piece ends.
        """
        own = np.flatnonzero(~blank) if self.newline is not None else np.zeros(0, np.int64)
        count, found = np.zeros(len(pieces), np.int64), {}
        joined = ["".join(pieces[k] + "\n" for k in own[i : i + 500].tolist()) for i in range(0, len(own), 500)]
        parts = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        at = np.flatnonzero(ids == self.newline) if len(own) else own
        if len(at) == len(own):
            count[own] = np.diff(at, prepend=-1) - 1
            found["many"] = np.delete(ids, at)
        else:
            own = own[:0]
        rest = np.setdiff1d(np.arange(len(pieces)), own)
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[k] for k in rest.tolist()], add_special_tokens=False)]
        count[rest] = [len(x) for x in lists]
        out = np.zeros(int(count.sum()), np.uint32)
        is_own = np.zeros(len(pieces), bool)
        is_own[own] = True
        from_own = np.repeat(is_own, count)
        out[from_own] = found.get("many", out[:0])
        out[~from_own] = np.fromiter((i for x in lists for i in x), np.uint32)
        return out, count

    def _kinds(self, code: np.ndarray) -> np.ndarray:
        """The class of each character; the library's own splitter tells that of a character seen for the first time."""
        kind = self.kind[code]
        if (kind == _UNKNOWN).any():
            split = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s))
            for c in np.unique(code[kind == _UNKNOWN]).tolist():
                ch = chr(c)
                self.kind[c] = _LETTER if split("a" + ch) == 1 else _NUMBER if split("1" + ch) == 1 else _OTHER if split("!" + ch) == 1 else _SPACE
            kind = self.kind[code]
        return kind

    def pieces(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the pieces begin; ``first`` are the texts' first characters.

        Runs of letters, numbers or other marks take one space before them;
        's 't 're 've 'm 'll 'd are pieces where no space precedes; white space
        before a run leaves its last character to it or by itself.
        """
        n, kind = len(code), self._kinds(code)
        text_start = np.zeros(n + 1, bool)
        text_start[first[first < n]] = True
        start = text_start[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(start & (kind != _SPACE))
        led = run[(run > 0) & ~text_start[run] & (kind[run - 1] == _SPACE)]
        start[led - 1] = True
        start[led[code[led - 1] == 0x20]] = False
        mark = run[(code[run] == 0x27) & start[run]]
        if len(mark):
            at = lambda k: np.where(mark + k < n, code[np.minimum(mark + k, n - 1)], 0) * ~np.logical_or.reduce(
                [text_start[np.minimum(mark + j, n)] for j in range(1, k + 1)]
            )
            a, b = at(1), at(2)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            start[mark[one | two] + 1] = False
            after = np.concatenate((mark[one] + 2, mark[two] + 3))
            start[after[after < n]] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        texts = [t or "" for t in texts]
        plain = [self.by_piece and not any(s in t for s in self.special) for t in texts]
        if not all(plain):
            found = self.tokenizer.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False)
            direct = iter([np.array(e.ids, np.uint32) for e in found])
            ids, count = self.encode(
                [t for t, p in zip(texts, plain, strict=True) if p]
            ) if any(plain) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            split = iter(np.split(ids, np.cumsum(count)[:-1]) if len(count) else [])
            parts = [next(split) if p else next(direct) for p in plain]
            return np.concatenate(parts) if parts else ids, np.array([len(p) for p in parts], np.int64)
        whole = "".join(texts)
        length = np.array([len(t) for t in texts], np.int64)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(code):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        begin = np.cumsum(length) - length
        start = self.pieces(code, begin)
        size = np.diff(np.append(start, len(code)))
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(size.max()), _text._STEP, np.uint64))
            value = _K * (code.astype(np.uint64) + np.uint64(1))
            value ^= value >> np.uint64(29)
            value *= power[np.arange(len(code)) - np.repeat(start, size)]
            h = _text.mix(np.add.reduceat(value, start) + size.astype(np.uint64))
        seen, at, inverse = np.unique(h, return_index=True, return_inverse=True)

        def known_at() -> tuple[np.ndarray, np.ndarray]:
            place = np.searchsorted(self.key, seen)
            return place, self.key[np.minimum(place, len(self.key) - 1)] == seen if len(self.key) else np.zeros(len(seen), bool)

        place, known = known_at()
        if len(self.key) and len(self.key) + (~known).sum() > self.most:
            self.make_room()
            place, known = known_at()
        if not known.all():
            new = np.flatnonzero(~known)
            begin_of, size_of = start[at[new]], size[at[new]]
            blank = self.kind[code[begin_of + size_of - 1]] == _SPACE
            ids, count = self.encode_pieces([whole[a : a + n] for a, n in zip(begin_of.tolist(), size_of.tolist(), strict=True)], blank)
            slot = np.arange(len(new)) + len(self.first) - 1
            self.first = np.append(self.first, self.first[-1] + np.cumsum(count))
            self.pool, self.uses = np.append(self.pool, ids), np.append(self.uses, np.zeros(len(new), np.int64))
            self.slot = np.insert(self.slot, place[new], slot)
            self.key = np.insert(self.key, place[new], seen[new])
        slot = self.slot[np.searchsorted(self.key, seen)]
        self.uses[slot] += 1
        slot = slot[inverse]
        n_ids = self.first[slot + 1] - self.first[slot]
        total = np.cumsum(n_ids)
        out = self.pool[np.repeat(self.first[slot] - total + n_ids, n_ids) + np.arange(int(total[-1]))]
        edge = np.searchsorted(start, np.append(begin, len(code)))
        upto = np.append(0, total)[edge]
        return out, np.diff(upto)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shards(
    docs: DataFrame, path: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text",
    end_id: int | None = 0, shard_tokens: int = 1 << 21
) -> DataFrame:
    """Write ``docs`` as shards below ``folder`` and return their table: part, shard, n_tokens, n_docs, payload."""
    ship(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")
    ).repartitionByRange(n, "id").sortWithinPartitions("id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, enc = TaskContext.get().partitionId(), 0, encoder(path)
        ids: list[np.ndarray] = []
        docs_in: list[int | None] = []
        counts: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs_in, counts, held, shard
            payload = WaveletMatrix.build(np.concatenate(ids), docs_in, np.append(0, np.cumsum(counts))).to_bytes()
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([held], pa.int64()),
                    pa.array([len(docs_in)], pa.int64()), pa.array([payload], pa.binary())
                ],
                names=["part", "shard", "n_tokens", "n_docs", "payload"]
            )
            ids, docs_in, counts, held, shard = [], [], [], 0, shard + 1
            return row

        for batch in batches:
            for i, j in _text.slices(batch.column(1), SLICE):
                got, count = enc.encode(batch.column(1).slice(i, j - i).to_pylist())
                if end_id is not None:
                    got = np.insert(got, np.cumsum(count), end_id)
                    count = count + 1
                ids.append(got.astype(np.uint32))
                docs_in += batch.column(0).slice(i, j - i).to_pylist()
                counts += count.tolist()
                held += len(got)
                if held >= shard_tokens:
                    yield flush()
        if docs_in:
            yield flush()

    return cut(ordered.mapInArrow(lean(run), "part int, shard int, n_tokens bigint, n_docs bigint, payload binary"), folder, "shards", TEXT_ROWS)


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the shards."""
    ship(shards.sparkSession)
    by_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per range
    part_base = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    in_part = Window.partitionBy("part").orderBy("shard")
    base = shards.select(
        "part", "shard", (F.sum("n_tokens").over(in_part) - F.col("n_tokens")).alias("b")
    ).join(part_base, "part").select("part", "shard", (F.col("b") + F.col("part_base")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                shard = WaveletMatrix.from_bytes(batch.column("payload")[k].as_py())
                ids = shard.decode().astype("<u4")
                edge = shard.starts.tolist()
                crc = [zlib.crc32(memoryview(ids[a:b])) for a, b in zip(edge, edge[1:], strict=False)]
                m = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, batch.column("part")[k].as_py(), np.int32)),
                        pa.array(np.full(m, batch.column("shard")[k].as_py(), np.int32)),
                        pa.array(shard.docs, pa.int64()), pa.array(edge[:-1], pa.int64()),
                        pa.array(np.diff(edge), pa.int64()), pa.array(crc, pa.int64())
                    ],
                    names=["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"]
                )

    rows = shards.select("part", "shard", "payload").mapInArrow(
        run, "part int, shard int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return rows.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_table(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0,
    shard_tokens: int = 1 << 21
) -> DataFrame:
    """Encode, write, read back; one row for each row of ``docs``.

    Null text: encoded as empty, so only the end id.  Ids that occur more than
    once are ordered by their text; null ids come first.  Extra columns aren't
    read.  An empty table gives no shards and no rows.
    """
    folder = shared_folder(docs.sparkSession)
    return read_shards(write_shards(docs, path, folder, id_col=id_col, text_col=text_col, end_id=end_id, shard_tokens=shard_tokens))
