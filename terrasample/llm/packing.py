"""Hierarchical packing of documents into sequences of several lengths.

Every task encodes its documents and packs them in buffers of some million token ids.
A document's full windows of the longest tier are sequences by themselves; what is left of
it goes to the shortest tier that holds it.  From the longest tier down, each such rest opens
a sequence of its tier and the gap is filled from what remains: the longest rest that fits,
again and again, and at last the head of the shortest rest that doesn't (its tail goes back
to its own tier).  So sequences are full.  What can't fill one waits for the task's next
buffer, and the last rests of a task are cut at powers of two, so nothing is padded.

Sequences are rows of a written table with their ids and pieces.  A step group is a set of sequences
of one tier with ``step_tokens`` ids; within a task and tier sequences are dealt to groups by
their attention cost (the sum of the pieces' squared lengths), dear ones first, back and forth, so
that groups cost about the same.  Only the counts of sequences by task and tier are combined.

Encoding: a text is split at blanks, which no token of a tokenizer that drops white
space crosses; the distinct words of some million bytes are split into pieces together, and each
distinct piece is encoded once per worker, as long as the table of pieces has room.  Other
tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasample.llm import _text
from terrasample.llm._session import TEXT_ROWS, cut, lean, shared_folder, ship

#: Bytes of text encoded at once; pieces that a worker keeps, and their greatest length in characters.
SLICE, PIECES, LONGEST = 4_000_000, 400_000, 100
#: Plain characters: visible ASCII, Latin letters and marks up to U+024F but the soft hyphen and the dotted capital I, dashes and quotes.
PLAIN = "[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f\u2010-\u2027]+"
#: Characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the others from U+0100 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SYMBOLS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
#: Rows (three numbers for a task and tier) up to which the places of the tasks' sequences are broadcast.
BROADCAST_ROWS = 200_000
#: Normalizers that join nothing across white space.
_DROPS_BLANKS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace"}


class WordEncoder:
    """Encodes columns of texts, word by word where the tokenizer file allows it.

    Words of plain characters (ASCII, Latin letters and marks: none of them changes under NFC,
    lower-cases to several or joins its neighbours) are split by the file's own pattern and their pieces
    given to its BPE model; all others go through the library as they are.  Where a column leaves more
    than ``most`` pieces, or 16 characters for each of these, the less used are forgotten.
    """

    def __init__(self, path: str, most: int = PIECES):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        norms = [n["type"] for n in (norm.get("normalizers", [norm]) if norm else [])]
        splits = pre.get("pretokenizers") or [pre]
        pattern = splits[0].get("pattern", {}).get("Regex", "")
        self.by_word = bool(
            splits[0].get("type") == "Split" and splits[0].get("behavior") == "Removed" and splits[0].get("invert") and not spec.get("post_processor")
            and set(norms) <= _DROPS_BLANKS and pattern and not any(self._matches_blank(pattern, c) for c in " \t\n\v\f\r")
        )
        to_bytes = splits[1:] and splits[1].get("type") == "ByteLevel" and not splits[1].get("use_regex") and not splits[1].get("add_prefix_space")
        self.plain = None
        if self.by_word and to_bytes and len(splits) == 2 and set(norms) <= {"NFC", "Replace", "Lowercase"} and spec["model"]["type"] == "BPE":
            self.plain, self.pattern = f"^{PLAIN}$", regex.compile(f"(?:{pattern})|\n")
            self.special = [t["content"] for t in spec.get("added_tokens", ())]
            self.lower = str.lower if "Lowercase" in norms else str
        self.clear()

    @staticmethod
    def _matches_blank(pattern: str, blank: str) -> bool:
        import regex

        return any(blank in m for m in regex.findall(pattern, f"a{blank}b1{blank}2,{blank};{blank}{blank}"))

    def clear(self) -> None:
        """Forget all pieces but the line feed between words, which has the first slot and no ids."""
        self.slot: dict[str, int] = {"\n": 0}
        self.pool, self.first = np.zeros(0, np.uint32), np.zeros(2, np.int64)
        self.uses, self.chars = np.zeros(1, np.int64), 0

    def _make_room(self) -> None:
        """Keep the pieces that most columns had, half of them or of ``most``; a column counts half from now on."""
        names = list(self.slot)
        order = 1 + np.argsort(-self.uses[1:], kind="stable")[: min(len(names), self.most) // 2]
        often = [k for k in order.tolist() if len(names[k]) <= LONGEST]
        kept = np.array([0, *sorted(often)])
        size = np.diff(self.first)[kept]
        self.pool = _joined(self.pool, self.first[kept], size)
        self.first, self.uses = np.append(0, np.cumsum(size)), self.uses[kept] // 2
        self.slot = {names[k]: n for n, k in enumerate(kept.tolist())}
        self.chars = sum(map(len, self.slot))

    def _whole(self, texts: list[str]) -> list[array]:
        return [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> list[int]:
        symbols = piece if piece.isascii() else piece.encode().decode("latin-1").translate(SYMBOLS)
        return [t.id for t in self.model.tokenize(symbols)]

    def _add(self, pieces: list[str]) -> None:
        """Encode distinct pieces that the table doesn't have; a blank leads the words that the library takes as they are."""
        whole = iter(self._whole([p[1:] for p in pieces if p.startswith(" ")]))
        ids, end = array("I"), []
        for p in pieces:
            ids.extend(next(whole) if p.startswith(" ") else self._piece(p))
            end.append(len(ids))
        self.slot.update(zip(pieces, range(len(self.slot), len(self.slot) + len(pieces)), strict=True))
        self.first, self.uses = np.append(self.first, self.first[-1] + np.array(end)), np.append(self.uses, np.zeros(len(end), np.int64))
        self.pool = np.append(self.pool, np.frombuffer(ids, np.uint32))
        self.chars += sum(map(len, pieces))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of distinct words, and where those of each word begin and how many they are."""
        plain = np.zeros(len(words), bool)
        if self.plain is not None:
            plain = pc.match_substring_regex(words, self.plain).to_numpy(zero_copy_only=False).copy()
            for s in self.special:
                plain &= ~pc.match_substring(words, s).to_numpy(zero_copy_only=False)
        own, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        pieces = []
        if len(own):  # all split at once, apart by line feeds, which the pattern matches by themselves
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(own)], words.take(pa.array(own))), "\n")[0].as_py()
            pieces = [*self.pattern.findall(self.lower(text)), "\n"]
        pieces += [x for w in words.take(pa.array(rest)).to_pylist() for x in (" " + w, "\n")]
        slot = np.fromiter(map(self.slot.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(new := np.flatnonzero(slot < 0)):
            names = [pieces[k] for k in new.tolist()]
            self._add(list(dict.fromkeys(names)))
            slot[new] = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))
        self.uses[slot] += 1
        size = self.first[slot + 1] - self.first[slot]
        ids, edge = _joined(self.pool, self.first[slot], size), np.append(0, np.cumsum(size)[slot == 0])
        first, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        order = np.concatenate((own, rest))
        first[order], n[order] = edge[:-1], np.diff(edge)
        if len(self.slot) > self.most or self.chars > 16 * self.most:
            self._make_room()
        return ids, first, n

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has; null is empty."""
        column = pc.fill_null(column, "")
        if not self.by_word:
            ids = self._whole(column.to_pylist())
            return np.frombuffer(b"".join(ids), np.uint32), np.array([len(x) for x in ids], np.int64)
        lists = pc.ascii_split_whitespace(column)
        words = lists.flatten().dictionary_encode()
        pool, first, n = self._words(words.dictionary)
        at = words.indices.to_numpy()
        size = n[at]
        edge = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        return _joined(pool, first[at], size), np.diff(np.append(0, np.cumsum(size))[edge])


def _joined(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ``pool``, one after the other."""
    end = np.cumsum(size)
    return pool[np.repeat(first - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


#: A piece: document (its place in the buffer), first id within the document, length.
Piece = tuple[int, int, int]


class Rests:
    """Pieces by their length; finds the longest that fits and the shortest that doesn't."""

    def __init__(self, longest: int):
        self.of: list[list[Piece]] = [[] for _ in range(longest + 1)]
        self.lengths = 0  # bit n: there is a piece of length n

    def add(self, piece: Piece) -> None:
        self.of[piece[2]].append(piece)
        self.lengths |= 1 << piece[2]

    def take(self, length: int) -> Piece:
        piece = self.of[length].pop()
        if not self.of[length]:
            self.lengths &= ~(1 << length)
        return piece

    def longest(self, most: int) -> int:
        """The greatest length of at most ``most``, 0 if there is none."""
        return max(0, (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def shortest_over(self, least: int) -> int:
        """The smallest length over ``least``, 0 if there is none."""
        over = self.lengths >> (least + 1)
        return (over & -over).bit_length() + least if over else 0


def pack(pieces: list[Piece], tiers: list[int], *, last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Sequences (tier, pieces) of some documents' rests, each shorter than the longest tier, and what filled none.

    ``tiers`` rise and are powers of two.  With ``last`` the remains are cut at
    powers of two, so each sequence is full and nothing remains.
    """
    rests, out = Rests(tiers[-1]), []
    for p in pieces:
        rests.add(p)
    below = 0
    for tier, shorter in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
        while (length := rests.longest(tier)) > shorter:
            own, gap = [rests.take(length)], tier - length
            while gap and (length := rests.longest(gap)):
                own.append(rests.take(length))
                gap -= length
            if gap and (length := rests.shortest_over(gap)):
                doc, start, _ = rests.take(length)
                own.append((doc, start, gap))
                rests.add((doc, start + gap, length - gap))
                gap = 0
            if gap:  # nothing is left to fill it with
                below = tier - gap
                break
            out.append((tier, own))
        if below:
            break
    if not below:
        return out, []
    if not last:
        return out, own
    while own:  # below the tier: cut at powers of two
        size = 1 << (sum(p[2] for p in own).bit_length() - 1)
        part, need = [], size
        while need:
            doc, start, length = own.pop(0)
            part.append((doc, start, min(length, need)))
            if length > need:
                own.insert(0, (doc, start + need, length - need))
            need -= part[-1][2]
        out.append((size, part))
    return out, []


def dealt(cost: list[int], per_group: int) -> list[int]:
    """Places of a tier's sequences: groups of ``per_group`` in a row cost about the same."""
    groups = max(1, -(-len(cost) // per_group))
    order = sorted(range(len(cost)), key=lambda k: -cost[k])
    lanes: list[list[int]] = [[] for _ in range(groups)]
    for r, k in enumerate(order):
        turn, lane = divmod(r, groups)
        lanes[lane if turn % 2 == 0 else groups - 1 - lane].append(k)
    place = [0] * len(cost)
    for p, k in enumerate(k for lane in lanes for k in lane):
        place[k] = p
    return place


_PIECE = pa.struct(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64()), ("doc_tokens", pa.int64())]
)
_SCHEMA = (
    "part int, tier int, place bigint, cost bigint, ids binary, "
    "pieces array<struct<doc_id:bigint,start:bigint,length:bigint,offset:bigint,doc_tokens:bigint>>"
)


def write_sequences(
    docs: DataFrame, path: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
    tiers: tuple[int, ...] = (64, 128, 256, 512, 1024, 2048), step_tokens: int = 1 << 17, buffer_tokens: int = 1 << 22
) -> DataFrame:
    """Encode and pack ``docs`` and write the sequences below ``folder``; returns their table.

    sequence_id, tier (its length), step_group (sequences of one tier with ``step_tokens`` ids
    together, but for the tier's last group), cost, ids (little-endian unsigned 32-bit
    integers) and pieces (doc_id, start in the document, length, offset in the sequence, doc_tokens).

    Null text is encoded as empty, so each row has its end id at least; null and repeated ids are rows
    each; a text longer than a buffer makes one by itself.  An empty table gives no sequences.
    """
    if any(t & (t - 1) or t <= 0 for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be rising powers of two")
    spark = docs.sparkSession
    ship(spark)
    top, ladder = tiers[-1], list(tiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path)
        ids: list[np.ndarray] = []  # of each document in the buffer
        names: list[int | None] = []
        sizes: list[int] = []  # all ids of the document
        begun: list[int] = []  # ids of the document before those in the buffer
        held, placed = 0, dict.fromkeys(ladder, 0)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, names, sizes, begun, held
            whole, rests = [], []
            for d, own in enumerate(ids):
                full = len(own) // top * top
                whole += [(top, [(d, s, top)]) for s in range(0, full, top)]
                if full < len(own):
                    rests.append((d, full, len(own) - full))
            made, left = pack(rests, ladder, last=last)
            made = whole + made
            by_tier: dict[int, list[int]] = {}
            for k, (tier, _) in enumerate(made):
                by_tier.setdefault(tier, []).append(k)
            cost = [sum(p[2] * p[2] for p in own) for _, own in made]
            for tier, own in by_tier.items():
                place = dealt([cost[k] for k in own], max(1, step_tokens // tier))
                base = placed.get(tier, 0)
                placed[tier] = base + len(own)
                for i in range(0, len(own), 2048):
                    some = own[i : i + 2048]
                    pieces, payload = [], []
                    for k in some:
                        offset, row = 0, []
                        for d, s, n in made[k][1]:
                            row.append({"doc_id": names[d], "start": begun[d] + s, "length": n, "offset": offset, "doc_tokens": sizes[d]})
                            offset += n
                        pieces.append(row)
                        payload.append(np.concatenate([ids[d][s : s + n] for d, s, n in made[k][1]]).astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part] * len(some), pa.int32()), pa.array([tier] * len(some), pa.int32()),
                            pa.array([base + p for p in place[i : i + 2048]], pa.int64()), pa.array([cost[k] for k in some], pa.int64()),
                            pa.array(payload, pa.binary()), pa.array(pieces, pa.list_(_PIECE))
                        ],
                        names=["part", "tier", "place", "cost", "ids", "pieces"]
                    )
            # the rests that wait are documents of the next buffer, begun where they were cut
            kept = [(ids[d][s : s + n].copy(), names[d], sizes[d], begun[d] + s) for d, s, n in left]
            ids, names, sizes, begun = ([x[c] for x in kept] for c in range(4))
            held = sum(len(x) for x in ids)

        for batch in batches:
            for i, j in _text.slices(batch.column(1), SLICE):
                got, count = enc.encode(batch.column(1).slice(i, j - i))
                got, count = np.insert(got, np.cumsum(count), end_id).astype(np.uint32), count + 1
                edge = np.append(0, np.cumsum(count))
                ids += [got[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                names += batch.column(0).slice(i, j - i).to_pylist()
                sizes += count.tolist()
                begun += [0] * len(count)
                held += len(got)
                if held >= buffer_tokens:
                    yield from flush(False)
        yield from flush(True)

    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("t"))
    made = cut(source.mapInArrow(lean(run), _SCHEMA), folder, "packed", TEXT_ROWS)
    counts = made.groupBy("part", "tier").agg(F.count("*").alias("n"))  # a row a task and tier
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("part", "tier", earlier.alias("base"))
    rank = F.col("base") + F.col("place")
    per_group = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))
    small = counts.count() <= BROADCAST_ROWS  # else both sides are shuffled
    return made.join(F.broadcast(base) if small else base, ["part", "tier"]).select(
        (F.col("place") * F.lit(1 << 6) + F.log2("tier").cast("int") + F.col("part").cast("bigint") * F.lit(1 << 38)).alias("sequence_id"),
        "tier", F.floor(rank / per_group).alias("step_group"), "cost", "ids", "pieces"
    )


def pieces_of(sequences: DataFrame) -> DataFrame:
    """A row for each piece of the sequences, with the CRC-32 of its ids."""
    p = sequences.select("sequence_id", "tier", "step_group", "ids", F.explode("pieces").alias("p"))
    crc = F.crc32(F.expr("substring(ids, cast(4 * p.offset + 1 as int), cast(4 * p.length as int))"))
    return p.select("p.doc_id", "p.start", "p.length", crc.alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset", "tier", "step_group")


def packed_pieces(docs: DataFrame, path: str, *, end_id: int = 1, **options) -> DataFrame:
    """Pack ``docs`` (see :func:`write_sequences`, which ``options`` go to) and return the pieces."""
    return pieces_of(write_sequences(docs, path, shared_folder(docs.sparkSession), end_id=end_id, **options))
