"""Packing, ranked search and whitening against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrasample.llm import packing, queries, ranked, whitening

WORDS = queries.tokenizer_path("word_bpe_49k.json")
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in TERM.findall((text or "").encode())]


def plain_ranking(docs, items, k=10):
    """Every score of every pair, by the formula."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_all = len(counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counts:
            m = 10 + 90 * c.total() * n_docs // n_all
            score = 0
            for w in set(terms_of(text)):
                if c[w]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def ranked_rows(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return [tuple(r) for r in ranked.rank(d, i, **options).collect()]


@pytest.mark.parametrize("parts", [4_000_000, 900])
def test_ranking_equals_plain_scores(spark, parts):
    random.seed(5)
    words = [f"w{k}" for k in range(120)] + ["É", "ß", "Zz", "zz", "日本"]
    text = lambda n: " ".join(random.choice(words[: random.choice((10, 60, 125))]) for _ in range(n))
    docs = [(k, text(random.choice((0, 1, 5, 40, 300)))) for k in range(700)]
    docs += [(1000 + k, docs[7][1]) for k in range(40)] + [(7, docs[7][1]), (None, docs[9][1]), (2000, None), (2001, "..."), (2002, "Zz " * 30_000)]
    items = [(k, text(random.choice((1, 6, 30)))) for k in range(60)] + [(900, None), (901, ""), (902, "-!-"), (903, "unknown"), (904, docs[7][1])]
    assert sorted(ranked_rows(spark, docs, items, part_chars=parts)) == sorted(plain_ranking(docs, items))


def test_ranking_of_odd_tables(spark):
    assert ranked_rows(spark, [], [(1, "a")]) == [] and ranked_rows(spark, [(1, "a")], []) == []
    assert ranked_rows(spark, [(1, None), (2, "")], [(1, "a")]) == []
    docs = spark.createDataFrame([(1, "x y", "a", 5), (2, "x", "b", 6)], "doc_id bigint, text string, item_id string, score int")
    items = spark.createDataFrame([("q", "y", 1), ("q", "Y y", 2), (None, "y", 3)], "item_id string, text string, rank int")
    rows = [tuple(r) for r in ranked.rank(docs, items).collect()]
    assert sorted(rows, key=str) == sorted([("q", 1, 1, rows[0][3])] * 2 + [(None, 1, 1, rows[0][3])], key=str)


def test_terms_are_confirmed_by_their_bytes():
    terms = ranked.Terms([b"ab", b"abc"])
    terms.hashes = np.sort(terms.hashes)  # a text's word whose hash meets that of another term
    terms.number = terms.number[::-1].copy()
    assert len(terms.find(pa.array(["ab abc AB"]))[0]) == 0


def test_search_prunes_and_keeps_the_best():
    rng = np.random.default_rng(3)
    doc, term = np.nonzero(rng.random((4000, 200)) < 0.05)
    value = rng.integers(1, 1000, len(doc)) ** 2
    sets = [np.sort(rng.choice(200, 8, replace=False)) for _ in range(50)]
    trees = ranked.item_trees(sets, np.ones(200, np.int64))
    assert sorted(k for t in trees for k in t.items.tolist()) == list(range(50))
    best, scored = ranked.Best(50, 3, np.zeros(50, np.int64)), 0
    for tree in trees:
        mine = np.full(200, -1)
        mine[tree.terms] = np.arange(len(tree.terms))
        some = mine[term] >= 0
        scored += ranked.search_block(tree, best, doc[some], mine[term[some]], value[some], np.arange(4000))
    dense = np.zeros((4000, 200), np.int64)
    dense[doc, term] = value
    for k, s in enumerate(sets):
        total = dense[:, s].sum(1)
        order = np.lexsort((np.arange(4000), -total))[:3]
        assert best.score[k].tolist() == total[order].tolist() and best.id[k].tolist() == order.tolist()
    assert scored < 50 * 4000 / 2


def check_pieces(rows, ids, top=2048):
    """Each id in exactly one piece, sequences gapless and full; returns the sequences' lengths."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d]) and r["length"] > 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][r["start"] : at], "<u4").tobytes())
        assert at == len(ids[d])
    lengths = []
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= top and at == own[0]["tier"]
        lengths.append(at)
    return lengths


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").toPandas()
    rows = queries.op11_tiered_packing(spark, data).collect()
    lengths = check_pieces(rows, dict(zip(docs.doc_id, library_ids(docs.text), strict=True)))
    assert all(n & (n - 1) == 0 for n in lengths)  # no padding
    assert {64, 2048} >= {max(lengths)} and sum(n < 64 for n in lengths) < 12
    assert len({r["tier"] for r in rows}) >= 3


def test_packing_of_odd_tables(spark):
    texts = [None, "", "a", "a", "it's 12 o'clock’s <|endoftext|>x<|startoftext|> É é  b\x1cc\x85d", "x" * 5000, "word " * 60_000, " \n\t ", "日本 語　b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("start", F.lit("s")).withColumn("part", F.lit(1))
    rows = packing.packed_pieces(docs, WORDS, buffer_tokens=3000, step_tokens=4096).collect()
    check_pieces(rows, dict(enumerate(library_ids(texts))))
    assert packing.packed_pieces(docs.where("false"), WORDS).collect() == []
    same = packing.packed_pieces(spark.createDataFrame([(None, "a"), (None, "a"), (5, "b"), (5, "b")], "doc_id bigint, text string"), WORDS)
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in same.where("start = 0").collect()) == {(None, 2): 2, (5, 2): 2}
    with pytest.raises(ValueError, match="powers of two"):
        packing.packed_pieces(docs, WORDS, tiers=(100, 2048))


def test_words_are_encoded_as_whole_texts():
    random.seed(1)
    letters = "aAzé'’1 \n\t\r\x0b\x1c  ,.-<|>日ßſḰİ"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(2000)]
    for most in (400_000, 50):
        enc = packing.WordEncoder(WORDS, most)
        assert enc.by_word
        ids, count = enc.encode(pa.array(texts))
        assert [x.tolist() + [1] for x in np.split(ids, np.cumsum(count)[:-1])] == library_ids(texts)
    assert not packing.WordEncoder(queries.tokenizer_path()).by_word


def test_common_pieces_are_encoded_once():
    random.seed(4)
    enc, calls = packing.WordEncoder(WORDS, 200), []
    model = enc.model

    class Counted:
        def tokenize(self, text):
            calls.append(text)
            return model.tokenize(text)

    enc.model = Counted()
    for k in range(1, 21):  # a new word each time, with a piece that all columns have, among pieces that only one has
        rare = ["".join(random.choice("bcdfg") for _ in range(9)) for _ in range(60)]
        texts = [f"Alpha{'!' * k} {' '.join(rare)}", None, "", "日本\x1c", "x" * 5000 * (k % 2)]
        ids, count = enc.encode(pa.array(texts))
        assert [x.tolist() + [1] for x in np.split(ids, np.cumsum(count)[:-1])] == library_ids(texts)
    assert calls.count("alpha") == 1 and len(set(calls)) > 1200


def test_rests_fill_their_sequences():
    random.seed(2)
    pieces = [(d, 0, random.randint(1, 255)) for d in range(500)]
    made, left = packing.pack(pieces, [16, 64, 256], last=False)
    assert sum(p[2] for p in left) < 256 and all(tier == sum(p[2] for p in own) for tier, own in made)
    own = sorted(p for _, s in made for p in s) + left
    for d, _, n in pieces:
        assert sum(p[2] for p in own if p[0] == d) == n
    # a sequence is opened by a rest of its tier, so a short document isn't put where a long one is missing
    assert all(max(p[2] for p in s) > tier // 4 for tier, s in made if tier > 16)
    made, left = packing.pack([(0, 5, 100), (1, 0, 3)], [256], last=True)
    assert not left and [(t, s) for t, s in made] == [(64, [(0, 5, 64)]), (32, [(0, 69, 32)]), (4, [(0, 101, 4)]), (2, [(1, 0, 2)]), (1, [(1, 2, 1)])]


def test_step_groups_cost_the_same():
    random.seed(3)
    cost = [random.randint(1, 1000) ** 2 for _ in range(400)]
    place = packing.dealt(cost, 40)
    assert sorted(place) == list(range(400))
    groups = np.bincount(np.array(place) // 40, weights=cost)
    assert groups.max() / groups.min() < 1.05


def plain_whitening(vectors, components=4):
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], np.int64)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), np.int64)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return n, deviation, (x - s / n) @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


def whitened_rows(spark, rows, kind="array<float>"):
    out = whitening.whiten(spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}")).collect()
    return {(r["vec_id"], r["component"]): r for r in out}, len(out)


def test_whitening_equals_the_plain_way(spark):
    rng = np.random.default_rng(7)
    v = (rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]).astype(np.float32)
    rows = [(k, r.tolist()) for k, r in enumerate(v)] + [(400, v[3].tolist()), (401, v[3].tolist())]
    odd = [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, []), (505, [1e30] * 6)]
    got, size = whitened_rows(spark, rows + odd)
    n, deviation, whitened, explained = plain_whitening([r for _, r in rows])
    assert size == 4 * len(rows) and n == 300
    for k, (i, _) in enumerate(rows):
        for c in range(4):
            r = got[i, c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[k]) and r["identity_error"] < 1e-9
            assert abs(abs(r["whitened"]) - abs(whitened[k, c])) < 1e-9 and abs(r["explained"] - explained[c]) < 1e-12
    signs = {np.sign(got[i, 1]["whitened"]) * np.sign(whitened[k, 0]) for k, (i, _) in enumerate(rows)}
    assert len(signs) == 1


def test_scatter_is_exact_for_any_size_of_numbers():
    rng = np.random.default_rng(1)
    for low, high, n in ((-3, 3, 1), (-300, 300, 1000), (0, 1, 65), (-(1 << 39), 1 << 39, 130)):
        x = rng.integers(low, high, (n, 5))
        big = x.astype(object)
        got = whitening.scatter(x)
        assert got[0] == n and (got[1] == big.sum(0)).all() and (got[2] == big.T @ big).all()


def test_whitening_of_odd_tables(spark):
    assert whitened_rows(spark, []) == ({}, 0)
    assert whitened_rows(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])[1] == 0  # one distinct vector: nothing varies
    got, size = whitened_rows(spark, [(1, [1.0, 2.0]), (None, [2.0, 4.0]), (3, [3.0, 6.0]), (4, [5.0]), (5, [6.0]), (5, [8.0])], "array<double>")
    assert size == 3 + 3 and got[None, 1]["n"] == 3 and got[4, 1]["n"] == 3 and abs(got[3, 1]["explained"] - 1) < 1e-12
    big = [(k, [float(k * 10**8), float((k * k) % 7) * 10**8]) for k in range(9)]
    got, _ = whitened_rows(spark, big, "array<double>")
    want = plain_whitening([v for _, v in big])[1]
    assert [got[k, 1]["deviation"] for k in range(9)] == [d if d < 1 << 63 else None for d in want]
    clash = spark.createDataFrame([(1, [1.0, 2.0], 3), (2, [0.0, 1.0], 4)], "vec_id bigint, embedding array<double>, n int")
    assert {r["n"] for r in whitening.whiten(clash).collect()} == {2}
