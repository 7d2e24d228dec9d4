"""Decontamination, n-gram join, classifiers, mixture and pseudonyms against plain versions."""

import datetime
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrasample.llm import _features, _text, decontaminate, mix, ngram_join, pseudonyms, quality, toxicity

DOC = "doc_id long, text string"
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(b: bytes) -> bytes:
    return b.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def random_texts(n, seed, vocabulary=12, longest=60):
    r = random.Random(seed)
    words = ["é" * (1 + k % 2) + f"w{k}" for k in range(vocabulary)]
    return ["  ".join(r.choice([w, w.upper(), w + ","]) for w in (r.choice(words) for _ in range(r.randrange(longest)))) for _ in range(n)]


def test_word_spans_stop_at_row_ends():
    h, count = _text.words(pa.array(["ab cd", None, "", "cd", "\tab\n"]), _text.BLANK)
    assert count.tolist() == [2, 0, 0, 1, 1]
    assert h[1] == h[2] and h[0] == h[3] and h[0] != h[1]


def plain_contamination(text, items, window):
    w = WORDS.findall(lower((text or "").encode()))
    hit, found = [False] * len(w), set()
    for item, t in items:
        v = WORDS.findall(lower((t or "").encode()))
        m = min(window, len(v))
        grams = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if v else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in grams:
                found.add(str(item))
                hit[i : i + m] = [True] * m
    return len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)


@pytest.mark.parametrize("window", [3, 13])
def test_decontaminate_equals_plain_search(spark, window):
    texts = random_texts(60, 1) + [None, "", "w1 " * 3000]
    items = [(k, t) for k, t in enumerate(random_texts(12, 2, longest=20))] + [(90, None), (91, ""), (92, "w1")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], DOC + ", n_hit string")
    out = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), window=window)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out.collect()}
    assert got == {k: plain_contamination(t, items, window) for k, t in enumerate(texts)}


def test_decontaminate_long_texts_cross_lanes(spark):
    r = random.Random(3)
    words = [f"a{r.randrange(10**6)}" for _ in range(5000)]
    item = " ".join(words[500:530])
    docs = spark.createDataFrame([(1, " ".join(words))], DOC)
    row = decontaminate.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert (row["n_hit"], row["items"], [tuple(h) for h in row["hits"]]) == (30, ["7"], [(500, 530)])


def test_decontaminate_in_parts_equals_one_search(spark):
    texts = random_texts(40, 5) + [None, ""]
    items = [(f"i{k}", t) for k, t in enumerate(random_texts(15, 6, longest=20))] + [("i3", "w1 w2")]
    docs = spark.createDataFrame([(k % 30 or None, t, "x") for k, t in enumerate(texts)], DOC + ", n_hit string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    key = lambda r: tuple(str(x) for x in r)
    whole, parts = (
        sorted(
            (tuple(r) for r in decontaminate.decontaminate(docs, bench, window=3, part_chars=n, keep_columns=True).collect()),
            key=key
        ) for n in (10**6, 120)
    )
    assert whole == parts and len(whole) == len(texts)


def test_many_items_with_one_window_and_one_suffix(spark):
    """20,000 items share a window, and as many windows end in the same two words."""
    common = " ".join(f"c{k}" for k in range(13))
    items = [(f"{k:05d}", common) for k in range(20_000)] + [(f"s{k}", " ".join(f"x{k}y{j}" for j in range(11)) + " of the") for k in range(20_000)]
    texts = [common + " tail", "of the " * 4000, " ".join(f"x7y{j}" for j in range(11)) + " of the"]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = decontaminate.decontaminate(spark.createDataFrame(list(enumerate(texts)), DOC), bench).orderBy("doc_id").collect()
    assert [r["n_items"] for r in rows] == [20_000, 0, 1] and rows[2]["items"] == ["s7"] and rows[0]["items"][:2] == ["00000", "00001"]


def test_occurrences_are_confirmed_by_bytes(monkeypatch):
    """Were all hashes equal, only equal words would count."""
    monkeypatch.setattr(_text, "word_hashes", lambda data, starts, ends, byte=None: np.zeros(len(starts), np.uint64))
    p = decontaminate.Patterns.of(["1"], pa.array(["aa Bb cc"]), 13)
    count, hits, items = decontaminate.occurrences(p, pa.array(["aa bb cc", "aa bb cd", "x AA, bb; cC x", "ab bb cc"]))
    assert count.tolist() == [3, 3, 5, 3] and hits == {0: [(0, 3)], 2: [(1, 4)]} and items == {0: ["1"], 2: ["1"]}


def test_decontaminate_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOC), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, items).first()["contaminated"] is False
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


def shingles(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower((text or "").encode()))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain_components(sets, t=75):
    low = {i: i for i in sets}
    find = lambda x: x if low[x] == x else find(low[x])
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            o = len(sets[i] & sets[j])
            if o and 100 * o >= t * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def similar_texts():
    r, texts = random.Random(4), []
    for _ in range(25):
        base = [f"t{r.randrange(400)}" for _ in range(r.randrange(3, 90))]
        for _ in range(r.randrange(1, 7)):
            copy = list(base)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(9)}"
            texts.append(" ".join(copy))
    passage = " ".join(f"p{k}" for k in range(30))
    return texts + [passage + f" own{k} tail{k} end{k} last{k}" for k in range(15)] + ["a b", "A  b", "", None, "!", "same same same same same same"]


@pytest.mark.parametrize("bounds", [{}, {"HELD": 50, "DEALT": 100, "BLOCK": 3, "CHUNK": 2}])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, bounds):
    """Also with bounds so small that shards are passed on in parts and shingles are paired block by block."""
    for name, value in bounds.items():
        monkeypatch.setattr(ngram_join, name, value)
    texts = similar_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.similar_documents(docs).collect()}
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    assert got == {k: (len(sets[k]), c) for k, c in plain_components(sets).items()}


def test_linked_pairs_are_all_pairs(spark):
    texts = similar_texts()
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    low = {}
    for k, s in sets.items():
        low.setdefault(frozenset(s), k)
    links, member = ngram_join.linked_pairs(spark.createDataFrame(list(enumerate(texts)), DOC))
    assert {r["doc_id"]: r["class_id"] for r in member.collect()} == {k: low[frozenset(s)] for k, s in sets.items() if s}
    reps = sorted(k for s, k in low.items() if s)
    want = {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in links.collect()} == want and len(want) > 20


@pytest.mark.parametrize("join", ["components", "links"])
def test_texts_around_the_threshold_of_one_passage(spark, monkeypatch, join):
    """A passage in all texts, with ends of every length: some link, some just don't; the shingle is hot, its sets meet by size."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    r = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(70))
    texts = [passage[: r.choice([400, len(passage)])] + "".join(f" {r.choice('ab')}{r.randrange(4000)}" for _ in range(r.randrange(6, 30))) for _ in range(160)]
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    if join == "components":
        got = {x["doc_id"]: x["component_id"] for x in ngram_join.similar_documents(docs).collect()}
        want = plain_components(sets)
        assert got == want and 1 < len(set(want.values())) < len(texts)
        return
    links, _ = ngram_join.linked_pairs(docs)
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {(x["a"], x["b"]) for x in links.collect()} == want and 1000 < len(want) < len(texts) * (len(texts) - 1) // 2


def test_ngram_join_odd_tables(spark):
    long = spark.createDataFrame(
        [(1, " ".join(f"w{k}" for k in range(200_000)), "x"), (2, " ".join(f"w{k}" for k in range(190_000)), "y")],
        DOC + ", component_id string"
    )
    assert [
        (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(long).orderBy("doc_id").collect()
    ] == [(199_996, 1), (189_996, 1)]
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, None)], DOC)
    got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.similar_documents(docs).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, 3), (3, 2, 3), (5, 0, 5)], key=str)
    assert ngram_join.similar_documents(docs.limit(0)).count() == 0


def test_bitmaps_never_overstate():
    r = np.random.default_rng(5)
    for _ in range(50):
        a, b = (r.integers(0, 5000, r.integers(1, 900)).astype(np.uint64) for _ in range(2))
        a, b = (np.unique(_text.mix(x.copy())) for x in (a, b))
        differ = len(np.setxor1d(a, b))
        assert ngram_join.least_difference(ngram_join.parity_bitmap(a), ngram_join.parity_bitmap(b)) <= differ


def test_set_tree_counts_exactly():
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(120)]
    for probe in sets[:30]:
        found = sorted(ngram_join.SetTree(sets).linked(probe, 0.5, step=7))
        assert found == [k for k, s in enumerate(sets) if 2 * len(np.intersect1d(s, probe)) >= len(np.union1d(s, probe))]


def test_quality_scores_held_out_rows(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score(docs, quality.train(docs, labels))
    rows = out.join(labels, "doc_id").where("held_out").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.97
    assert {r["doc_id"]: r["held_out"] for r in out.limit(50).collect()} == {
        r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in out.limit(50).collect()
    }


def test_nonnegative_risk_recovers_positives():
    r = np.random.default_rng(7)
    n = len(_features.DENSE)
    p = r.normal(0, 1, (1500, n)).astype(np.float32)
    neg = r.normal(0, 1, (700, n)).astype(np.float32)
    neg[:, 3] += 4
    u = np.concatenate((r.normal(0, 1, (1300, n)).astype(np.float32), neg))
    m = quality.fit_pu(p, u)
    assert abs(m.prior - 0.65) < 0.1
    assert m.score(p).mean() > 0.6 and m.score(neg).mean() < 0.2


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 6.0), (None, "text " * 50, 7.0)], DOC + ", score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()] == [0.5] * 3
    assert toxicity.score(docs, toxicity.train(docs, labels)).where("toxic").count() == 0
    assert quality.score(docs.limit(0), None).count() == 0


def test_quality_on_spark_equals_the_fit_on_arrays(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.train(docs, labels)
    use = docs.where(~quality.held_out("doc_id")).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(2))).toPandas()
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    x, p, half = _features.dense(pa.array(use["text"])), use["doc_id"].isin(good).to_numpy(), use["half"].to_numpy()
    of = lambda part: half == part if part is not None else half >= 0
    want = quality.fit(
        lambda m, w, part: quality.sums(x[of(part)], p[of(part)], m, w), lambda m, w, part: (
            quality._binned(x[of(part) & p], m, w), quality._binned(x[of(part)], m, w)
        ),
        x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-6,
    )
    assert np.allclose(got.weight, want.weight, atol=1e-4) and abs(got.prior - want.prior) < 1e-6


def test_risk_is_least_at_the_fit():
    """No step from the fitted weights lowers the risk, written out by its definition."""
    r = np.random.default_rng(11)
    n = len(_features.DENSE)
    p, u = r.normal(0.5, 1, (300, n)), np.concatenate((r.normal(0.5, 1, (300, n)), r.normal(-0.5, 1, (700, n))))
    m = quality.fit_pu(p, u, prior=0.3)

    def risk(w):
        fp, fu = m.expand(p) @ w, m.expand(u) @ w
        loss = lambda f: np.logaddexp(0, -f).mean()
        return 0.3 * loss(fp) + max(0, loss(-fu) - 0.3 * loss(-fp)) + 20.0 / len(p) * (w @ w) / 2

    assert all(risk(m.weight + d) >= risk(m.weight) - 1e-9 for d in r.normal(0, 0.05, (200, len(m.weight))))


def test_ordinal_fit_recovers_a_threshold_model():
    """Grades drawn from a known cumulative-link model give its weights and thresholds back, and the loss is least there."""
    r = np.random.default_rng(5)
    n, w, t = 40_000, np.array([2.0, -1.0, 0.5, 0.0]), np.array([0.5, 2.0])
    x = r.random((n, 4)) < 0.5
    grade = (r.logistic(size=n) + x @ w)[:, None] >= t
    row, feature = np.nonzero(x)
    got_w, got_t = toxicity.fit_ordinal(row, feature, grade.sum(1), 4, 2, l2=0.0)
    assert np.abs(got_w - w).max() < 0.12 and np.abs(got_t - t).max() < 0.12 and got_t[0] <= got_t[1]

    def loss(w, t):
        f = (x @ w)[:, None] - t
        return np.where(grade, np.logaddexp(0, -f), np.logaddexp(0, f)).sum(1).mean()

    best = loss(got_w, got_t)
    assert all(loss(got_w + d[:4], got_t + d[4:]) >= best - 1e-6 for d in r.normal(0, 0.05, (100, 6)))


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(k, "vile words here" if k % 3 == 0 else "other words here", "x") for k in range(300)], DOC + ", grade string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    model = toxicity.train(docs.unionByName(docs.limit(10)), labels)
    odd = spark.createDataFrame([(1, "vile words " * 50_000, "x"), (1, None, "y"), (1, None, "y"), (None, "", "z")], DOC + ", grade string")
    rows = toxicity.score(odd, model, keep_columns=True)
    assert [f.dataType.typeName() for f in rows.schema if f.name == "grade"] == ["integer"] and rows.where("toxic").count() == 1 and rows.count() == 4
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.train(docs.limit(0), labels) is None


def test_toxicity_finds_marked_documents(spark):
    r = random.Random(8)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        w = [r.choice(plain) for _ in range(40)]
        bad = k % 6 == 0
        for _ in range(r.randrange(1, 6) if bad else 0):
            w[r.randrange(40)] = r.choice(["vile", "nasty", "awful" + r.choice("abcdef")])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    docs, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {x["doc_id"]: x for x in toxicity.score(docs, toxicity.train(docs, lab)).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([out[k]["toxic"] == (k % 6 == 0) for k in held]) > 0.97
    assert all(0 <= x["p_severe"] <= x["p_mild"] <= 1 and abs(x["expected_severity"] - x["p_mild"] - x["p_severe"]) < 1e-9 for x in out.values())


def test_mixture_follows_rates(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "b").alias("source"), F.lit(9).alias("copy")
    )
    out = mix.poisson_mix(docs, {"a": 0.5, "b": 0.1, "none": 0.1}, size=1.0)
    n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["a"] - 2000) < 150 and abs(n["b"] - 400) < 80
    one = out.where("doc_id = 8").collect()
    assert all(r["copies"] == len(one) and sorted(x["copy"] for x in one) == list(range(len(one))) for r in one)
    again = mix.poisson_mix(docs.repartition(7), {"a": 0.5, "b": 0.1, "none": 0.1})
    assert {tuple(r) for r in again.select("doc_id", "copy").collect()} == {tuple(r) for r in out.select("doc_id", "copy").collect()}


def test_poisson_quantiles():
    cdf = mix.poisson_cdf(2.5)
    assert abs(cdf[0] - math.exp(-2.5)) < 1e-12 and cdf == sorted(cdf) and cdf[-1] > 1 - 1e-12
    assert mix.poisson_cdf(0) == [1.0]
    with pytest.raises(ValueError):
        mix.rates({"a": 1}, {"a": 1.5})


def test_large_rates_are_sums_of_draws(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, "rare").otherwise("rest").alias("source"))
    out = mix.poisson_mix(docs, {"rare": 0.99}, size=100.0, shuffle=False).groupBy("doc_id", "source").agg(
        F.count("*").alias("n"), F.max("copies").alias("c")
    ).where("source = 'rare'").collect()
    assert len(out) == 2 and all(r["n"] == r["c"] and abs(r["n"] - 19_800) < 700 for r in out)

    def draw(seed, doc, k, rate):
        u = int(hashlib.md5(":".join([seed, str(doc), *([str(k)] if k else [])]).encode()).hexdigest()[:13], 16) / 2**52
        return sum(u >= p for p in mix.poisson_cdf(rate))

    n = mix.draws(19_800.0)
    assert {r["doc_id"]: r["n"] for r in out} == {d: sum(draw("mix", d, k, 19_800.0 / n) for k in range(n)) for d in (0, 1)}


def test_mixture_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, None), (1, "a")], "doc_id long, source string")
    assert mix.poisson_mix(docs, {"a": 1.0}, describe=False).columns == ["doc_id", "source"]
    assert mix.poisson_mix(docs.limit(0), {"a": 1.0}).count() == 0


def luhn(d):
    s = [int(c) for c in d][::-1]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def plain_digest(text, n):
    """As many bytes as ``n`` characters need: the digest, then those of it and a block's number."""
    first = hashlib.sha512(text.encode()).hexdigest()
    return b"".join(bytes.fromhex(first) if b == 0 else hashlib.sha512(f"{first}:{b}".encode()).digest() for b in range(-(-n // 64)))


def plain_feistel(text, kind, key):
    half = len(text) // 2
    a, b = text[:half], text[half:]
    for i in range(pseudonyms.ROUNDS):
        d = plain_digest(f"{key}:{kind}:{i}:{b}", len(a))
        new = ""
        for j, c in enumerate(a):
            first, n = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26)
            new += chr(first + (ord(c) - first + d[j]) % n)
        a, b = b, new
    return a + b


def test_pseudonyms_equal_plain_feistel(spark):
    docs = spark.createDataFrame([(1, "tel +1 (017) 555-7713, card 4417744280351547."), (2, "x 4417744280351547 y")], DOC)
    one, two = (r["text"] for r in pseudonyms.pseudonymize(docs, "k").orderBy("doc_id").collect())
    phone = plain_feistel("10175557713", "phone", "k")
    body = plain_feistel("441774428035154", "card", "k")
    card = next(body + c for c in "0123456789" if luhn(body + c))
    assert one == f"tel +{phone[0]} ({phone[1:4]}) {phone[4:7]}-{phone[7:]}, card {card}."
    assert two == f"x {card} y"


def test_pseudonyms_keep_formats(spark):
    text = "ip 97.51.17.173 on 2021-03-30 or 30.03.2021, not 2021-02-30 nor 4417744280351548; a.b-1@mail.example.com DE89370400440532013000 123-45-6789 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "plain text")], DOC)
    out = {r["doc_id"]: (r["text"], r["n_values"]) for r in pseudonyms.pseudonymize(docs, "k").collect()}
    assert out[2] == (None, 0) and out[3] == ("", 0) and out[4] == ("plain text", 0)
    new = out[1][0]
    assert "2021-02-30" in new and "4417744280351548" in new and out[1][1] == 7
    assert not any(v in new for v in ("97.51.17.173", "2021-03-30", "30.03.2021", "a.b-1@", "DE89370400440532013000", "123-45-6789", "24be64"))
    m = re.fullmatch(
        r"ip (\d+)\.(\d+)\.(\d+)\.(\d+) on (\d{4})-(\d\d)-(\d\d) or (\d\d)\.(\d\d)\.(\d{4}), not 2021-02-30 nor 4417744280351548; ([a-z])\.([a-z])-(\d)@mail\.example\.com (DE\d{20}) \d{3}-\d\d-\d{4} [0-9a-f]{40}",
        new
    )
    assert m and all(int(x) < 256 for x in m.groups()[:4])
    assert m.groups()[4:7] == (m[10], m[9], m[8])  # one day in two layouts
    assert int("".join(str(int(c, 36)) for c in m[14][4:] + m[14][:4])) % 97 == 1


def plain_pair(l, r, a, b, kind, key):
    for i in range(pseudonyms.ROUNDS):
        n = int(hashlib.sha512(f"{key}:{kind}:{i}:{r}".encode()).hexdigest()[:13], 16)
        l, r, a, b = r, (l + n) % a, b, a
    return l, r


def refill(layout, chars):
    it = iter(chars)
    return "".join(next(it) if re.match("[0-9A-Za-z]", c) else c for c in layout)


def plain_secret(text, key):
    digits, half = "0123456789abcdef", len(text) // 2
    a, b = text[:half], text[half:]
    for i in range(pseudonyms.ROUNDS):
        d = plain_digest(f"{key}:secret:{i}:{b}", len(a))
        a, b = b, "".join(digits[(digits.index(c) + d[j]) % 16] for j, c in enumerate(a))
    return a + b


def plain_pseudonym(kind, v, key):
    """Every kind of value, written out."""
    if kind == "ip":
        o = [int(x) for x in v.split(".")]
        l, r = plain_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip", key)
        return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
    if kind == "ssn":
        area, group, serial = (int(x) for x in v.split("-"))
        l, r = plain_pair(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn", key)
        return f"{l + (2 if l >= 665 else 1):03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"
    if kind in ("iso_date", "day_date"):
        form = "%Y{0}%m{0}%d" if kind == "iso_date" else "%d{0}%m{0}%Y"
        sep = re.search("[^0-9]", v)[0]
        days = (datetime.datetime.strptime(v, form.format(sep)).date() - datetime.date(1900, 1, 1)).days
        l, r = plain_pair(days % 17, days // 17, 17, 4297, "date", key)
        return (datetime.date(1900, 1, 1) + datetime.timedelta(r * 17 + l)).strftime(form.format(sep))
    if kind == "iban":
        plain = v.replace(" ", "")
        body = plain_feistel(plain[4:], "iban", key)
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        return refill(v, f"{plain[:2]}{check:02d}{body}")
    if kind == "email":
        local, _, host = v.rpartition("@")
        return refill(local, plain_feistel(re.sub("[^0-9A-Za-z]", "", local), "email", key)) + "@" + host
    if kind == "secret":
        return plain_secret(v, key)
    if kind == "card":
        body = plain_feistel(re.sub("[^0-9]", "", v)[:-1], "card", key)
        return refill(v, next(body + c for c in "0123456789" if luhn(body + c)))
    return refill(v, plain_feistel(re.sub("[^0-9]", "", v), "phone", key))


def test_every_kind_of_pseudonym_equals_its_plain_version(spark):
    r = random.Random(4)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n - 1)) + "7"
    values = [("ip", f"{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}") for _ in range(20)]
    values += [("ssn", f"{a:03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}") for a in (1, 2, 665, 667, 898, 899)]
    values += [("iso_date", d) for d in ("1900-01-01", "2099/12/31", "2024.02.29")] + [("day_date", d) for d in ("01.01.1900", "31-12-2099")]
    values += [
        ("iban", "DE89370400440532013000"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("card", "4417 7442 8035 1547"),
        ("card", "378282246310005"), ("phone", "+1 (017) 555-7713")
    ]
    values += [("secret", hexa(n)) for n in (32, 40, 128, 1000)] + [
        ("email", e) for e in ("a.b-1@mail.example.com", "x" * 300 + "@" + "sub." * 40 + "example.org")
    ]
    docs = spark.createDataFrame([(k, f"see {v}, ok") for k, (_, v) in enumerate(values)], DOC)
    got = [x["text"] for x in pseudonyms.pseudonymize(docs, "k").orderBy("doc_id").collect()]
    assert got == [f"see {plain_pseudonym(kind, v, 'k')}, ok" for kind, v in values]


def test_social_security_numbers_stay_in_their_format(spark):
    pattern = re.compile(pseudonyms.PATTERNS["ssn"])
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(
            "-", F.lpad((F.col("id") % 600 + 1).cast("string"), 3, "0"),
            F.lpad((F.col("id") % 99 + 1).cast("string"), 2, "0"), F.lpad((F.col("id") + 1).cast("string"), 4, "0")
        ).alias("text")
    )
    got = [r["text"] for r in pseudonyms.pseudonymize(docs, "k").collect()]
    assert len(set(got)) == 5000 and all(pattern.fullmatch(x) for x in got)


def test_bank_numbers_without_right_check_digits_stay(spark):
    docs = spark.createDataFrame([(1, "DE02000000000001000003"), (2, "DE99000000000001000003"), (3, "DE02000000000001000003"), (4, None)], DOC + "")
    got = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymize(docs, "k").collect()}
    assert got[2] == "DE99000000000001000003" and got[1] == got[3] != "DE02000000000001000003" and got[4] is None


def test_pseudonyms_of_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, "1.2.3.4 " * 20_000, "x"), (1, "1.2.3.4", "y"), (1, "1.2.3.4", "y"), (None, "", None)],
        DOC + ", n_values string"
    )
    rows = pseudonyms.pseudonymize(docs, "k").collect()
    assert sorted(r["n_values"] for r in rows) == [0, 1, 1, 20_000] and docs.columns == pseudonyms.pseudonymize(docs, "k").columns
    assert pseudonyms.pseudonymize(docs.limit(0), "k").count() == 0


def test_very_long_values_take_time_in_proportion(spark):
    """A hexadecimal run of a megabyte, and an address of 100,000 parts."""
    long, parts = "0123456789abcdef" * 62_500, "a1." * 100_000 + "b@example.org"
    docs = spark.createDataFrame([(1, f"x {long} y"), (2, parts)], DOC)
    began = time.time()
    new, address = (r["text"] for r in pseudonyms.pseudonymize(docs, "k").orderBy("doc_id").collect())
    assert time.time() - began < 120
    assert new == f"x {plain_secret(long, 'k')} y" and address == plain_pseudonym("email", parts, "k")


def test_pseudonyms_are_a_permutation(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("1.2."), F.floor(F.col("id") / 200).cast("string"), F.lit("."), (F.col("id") % 200).cast("string")).alias("text")
    )
    assert pseudonyms.pseudonymize(docs, "k").select("text").distinct().count() == 3000
