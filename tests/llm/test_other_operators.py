"""Extraction, embeddings, URL rules, token shards, components and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasample.llm import _graph, _session, embeddings, html, ngram_join, queries, tokens, urls
from terrasample.llm.wavelet import WaveletMatrix


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (
            "<article><h1>A title</h1><p>One, two.<p>Three  &amp; <b>four</b>.<br>Five</article><footer>f, g.</footer>",
            "A title\nOne, two.\nThree & four. Five"
        ),
        (
            "<nav><ul><li><a>x</a></ul></nav><div class='content'><p>Long text, with marks. More of it.</p><p>Short.</p></div><div class='comments'><p>I liked it, really.</p></div>",
            "Long text, with marks. More of it.\nShort."
        ),
        (
            "<body><script>var t='</p>';</script><div class=\"cookie-notice\">We use cookies, ok.</div><main><p>Text, here.</p><form><p>Name, please.</p></form></main>",
            "Text, here."
        ),
        ("<article><p>Cut off he", "Cut off he"), (
            "<article><p>Cut in a tag <a hre", "Cut in a tag"
        ), (
            "<p>a &lt; b &#233; &eacute", "a < b é é"
        ), ("plain text", "plain text"), ("", ""), (None, ""), ("<nav>menu</nav>", ""), ("<!-- only", ""),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


LONG = "Words of the longest part, with marks, and more of them. " * 12


@pytest.mark.parametrize(
    "part",
    [
        "<ul><li>{0}</li><li>{0}</li></ul>", "<ol><li>{0}<li>{0}</ol>",
        "<table><tbody><tr><td>{0}</td></tr><tr><td>{0}</td></tr></tbody></table>",
        "<blockquote><p>{0}</p><p>{0}</p></blockquote>", "<section><p>{0}</p><p>{0}</p></section>",
        "<div><p>{0}</p><p>{0}</p></div>", "<pre>{0}</pre>"
    ]
)
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div class='content'>{}</div>", "{}"])
def test_main_text_holds_the_whole_article(part, around):
    page = "<body><nav><ul><li><a>Home</a></ul></nav>" + around.format(
        "<h1>The title of it</h1><p>An introduction, of some words, that stands before the part.</p>" + part.format(LONG) + "<p>And a last paragraph, after the part, of some words.</p>"
    ) + "<footer>Foot, of it.</footer></body>"
    lines = html.main_text(page).split("\n")
    assert lines[:2] == ["The title of it", "An introduction, of some words, that stands before the part."]
    assert lines[-1] == "And a last paragraph, after the part, of some words." and set(lines[2:-1]) == {LONG.strip()}


def test_main_text_holds_two_sections_but_no_list_of_links():
    page = f"<body><ul><li><a href=x>Home</a><li><a href=y>News</a></ul><section><h2>One</h2><p>{LONG}</p><p>{LONG}</p></section><section><h2>Two</h2><p>{LONG}</p></section></body>"
    assert html.main_text(page).split("\n") == ["One", LONG.strip(), LONG.strip(), "Two", LONG.strip()]


@pytest.mark.parametrize("wrap", ['class="wrap has-sidebar"', 'id="no-header"', 'class="social"', 'role="form"'])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text_in_a_wrapper_with_a_noise_word(wrap, tag):
    aside = "<div class='sidebar'><p>Beside it, of some words.</p></div><div class='comments'><article class='comment'><p>I liked it, really, and much more.</p></article></div>"
    page = f"<body><div class='cookie'>We use cookies, ok.</div><div {wrap}><div class='page'><{tag}><h1>The title</h1><p>{LONG}</p><p>Short, one.</p></{tag}></div>{aside}</div></body>"
    assert html.main_text(page) == f"The title\n{LONG.strip()}\nShort, one."


def test_main_text_is_not_emptied_by_words_but_comments_stay_out():
    assert html.main_text("<body><div class='legal'><p>One, two.</p></div></body>") == "One, two."
    assert html.main_text(
        "<body><div class='legal'><p>One, two.</p></div><div class='notice'><p>Six, ten.</p></div></body>"
    ) == "One, two.\nSix, ten."
    said = f"<div id='comments'><p>{LONG}</p></div>"
    for part in ("<article><p>{}</p></article>", "<div><p>{}</p></div>"):
        assert html.main_text("<body>" + part.format(LONG[:-1]) + said + "</body>") == LONG.strip()


def plain_ratios(page, sigma):
    """Path ratios by loops over the nodes' whole tag paths."""
    def path(i):
        tags, e = [], page.element[i]
        while e:
            tags, e = [page.tag[e], *tags], page.parent[e]
        return tuple(tags)

    clean = [" ".join(x.split()) for x in page.text]
    paths = [path(i) for i in range(len(clean))]
    mean = {
        p: [
            sum(f(clean[i]) for i in own) / len(own) for f in (len, lambda x: len(html._MARK.findall(x)))
        ] for p in set(paths) if (own := [i for i, q in enumerate(paths) if q == p and clean[i]])
    }
    seen = [i for i, x in enumerate(clean) if x]
    fused = {}
    for k, i in enumerate(seen):
        near = [
            (np.exp(-0.5 * ((k - j) / sigma) ** 2), paths[seen[j]]) for j in range(max(0, k - int(3 * sigma)), min(len(seen), k + int(3 * sigma) + 1))
        ]
        a, b = (sum(w * mean[p][n] for w, p in near) / sum(w for w, _ in near) for n in (0, 1))
        fused.setdefault(paths[i], []).append(a * (1 + b))
    return [sum(fused[p]) / len(fused[p]) if p in fused else 0.0 for p in paths]


def test_ratios_equal_plain_ones(data):
    import pyarrow.parquet as pq

    for text in pq.read_table(f"{data}/pages.parquet").column("html").to_pylist()[:40] + ["<div>a <b>b, c.</b> d</div><div>e</div>", "x", "<p> <p>a"]:
        page = html.Page(text)
        assert np.allclose(html.fused_ratios(page, 1.0), plain_ratios(page, 1.0))


def test_ids_and_words_take_nothing_out_of_an_article():
    page = f"<body><article><h1>T</h1><h2 id='search'>Search</h2><p>{LONG}</p><h2 id='share-widget' class='alert'>Share widget</h2><p class='notice-board'>{LONG}</p><p id='comment'>{LONG}</p></article></body>"
    assert html.main_text(page).split("\n") == ["T", "Search", LONG.strip(), "Share widget", LONG.strip(), LONG.strip()]


@pytest.mark.parametrize("around", ["<article>{}</article>", "<div class='post'>{}</div>", "<div>{}</div>"])
def test_reader_comments_go_however_long_they_are(around):
    said = "".join(f"<div class='comment'><p>{LONG}</p></div>" for _ in range(40))
    for comments in (f"<section class='comments'>{said}</section>", f"<div id='disqus'>{said}</div>", said):
        page = "<body>" + around.format("<p>A short post, of a few words.</p>") + comments + "</body>"
        assert html.main_text(page) == "A short post, of a few words."


def test_ratios_select_the_text_without_any_words(data, monkeypatch):
    """Without the words of classes the paths' ratios find the article; with one ratio for all they don't."""
    import pyarrow.parquet as pq

    pages = [h for h in pq.read_table(f"{data}/pages.parquet").column("html").to_pylist() if h]
    right = [html.main_text(h) for h in pages]
    monkeypatch.setattr(html, "_named", lambda page, weight: np.zeros(len(page.text), bool))
    assert sum(a == html.main_text(h) for a, h in zip(right, pages, strict=True)) > 0.9 * len(pages)
    monkeypatch.setattr(html, "fused_ratios", lambda page, sigma: np.ones(len(page.text)))
    assert sum(a == html.main_text(h) for a, h in zip(right, pages, strict=True)) < 0.1 * len(pages)


def test_unmarked_list_of_links_is_left_out():
    links = "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(40))
    article = "<div><h1>The title</h1><p>One sentence of it, long enough to be one. And another.</p><p>A second paragraph, with words of its own; it says more.</p></div>"
    text = "The title\nOne sentence of it, long enough to be one. And another.\nA second paragraph, with words of its own; it says more."
    for page in (f"{article}<div><ul>{links}</ul></div>", f"<div>{links}</div>{article}", f"<div><div>{links}</div>{article}</div>"):
        assert html.main_text(page) == text


def test_captions_and_labels_stay_and_controls_go():
    page = f"<article><header><h1>Title</h1><p>By someone</p></header><p>{LONG}</p><figure><img><figcaption>A caption.</figcaption></figure><fieldset><label>A label</label></fieldset><textarea>typed</textarea><dialog>Accept?</dialog><form><label>Name</label></form></article>"
    assert html.main_text(page).split("\n") == ["Title", LONG.strip(), "A caption.", "A label"]


def test_deep_nesting_takes_linear_time():
    import time

    began = time.process_time()
    for page in ("<div>x" * 50_000, "<b>x" * 50_000 + "<p>y" * 50_000, "<i>x" * 50_000 + "</b>" * 50_000, "<ul><li>" * 50_000 + "z"):
        assert html.main_text(page)
    assert time.process_time() - began < 30


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, 7), (1, "u", "<p>" + "a, b. " * 30000, 8), (None, None, "", 9)],
        "page_id long, url string, html string, n_chars int"
    )
    assert sorted(r["n_chars"] for r in html.extract(pages).collect()) == [0, 0, 30000 * 6 - 1]
    assert html.extract(pages.limit(0)).count() == 0


def plain_links(x, t):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= t
    np.fill_diagonal(s, False)
    low = list(range(len(x)))
    for _ in low:
        low = [min([low[i], *(low[j] for j in np.flatnonzero(s[i]))]) for i in range(len(low))]
    return s.sum(1).tolist(), low


@pytest.mark.parametrize(("cell", "block"), [(4096, 1 << 20), (40, 16 * 64)])
def test_embeddings_equal_all_pairs(spark, cell, block):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 8))
    x = np.concatenate(
        (
            x, x[:30] + r.normal(size=(30, 8)) * 0.1, x[:10] + r.normal(size=(10, 8)) * 0.05, x[:5],
            np.repeat(x[:1], 40, 0) + r.normal(size=(40, 8)) * 0.02
        )
    ).astype(np.float32)
    rows = [(k, [float(c) for c in v], k) for k, v in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, [1.0, None] * 4, 0), (1004, [1.0], 0), (1005, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int")
    got = {
        v["vec_id"]: (v["n_links"], v["component_id"], v["kept"]) for v in embeddings.near_duplicates(df, cell_rows=cell, block_bytes=block).collect()
    }
    n, low = plain_links(x.astype(float), 0.95)
    assert got == {k: (n[k], low[k], low[k] == k) for k in range(len(x))} | {k: (0, k, True) for k, _, _ in odd}


@pytest.mark.parametrize(("cell", "block"), [(4096, 1 << 20), (16, 8 * 40)])
def test_embeddings_of_several_lengths(spark, cell, block):
    r = np.random.default_rng(3)
    sets = []
    for at, (n, d) in enumerate(((60, 8), (50, 5), (3, 1))):
        x = r.normal(size=(n, d))
        x[n // 2 : n // 2 + n // 4] = x[: n // 4] + r.normal(size=(n // 4, d)) * 0.05
        sets.append((1000 * at, np.concatenate((x, x[:4])).astype(np.float32)))
    df = spark.createDataFrame(
        [(base + k, [float(c) for c in v]) for base, x in sets for k, v in enumerate(x)],
        "vec_id long, embedding array<float>"
    )
    got = {
        v["vec_id"]: (v["n_links"], v["component_id"], v["kept"]) for v in embeddings.near_duplicates(df, cell_rows=cell, block_bytes=block).collect()
    }
    want = {}
    for base, x in sets:
        n, low = plain_links(x.astype(float), 0.95)
        want |= {base + k: (n[k], base + low[k], low[k] == k) for k in range(len(x))}
    assert got == want and sum(n for k, (n, *_) in got.items() if k >= 1000) > 0


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("dim", [3, 20, 96])
def test_bounds_drop_no_link(dim):
    r = np.random.default_rng(dim)
    x = r.normal(size=(400, dim)) * np.linspace(3, 0.2, dim)
    x[200:] = x[:200] + r.normal(size=(200, dim)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bound = embeddings.bounds_of(x, embeddings.principal_axes(x[::3]))
    exact = x @ x.T
    assert (bound.astype(float) @ bound.T.astype(float) >= exact - embeddings.MARGIN).all()
    assert (embeddings.links_of(x, x, 0.95, bound, bound) == (exact >= 0.95)).all()


def test_dense_groups_stay_connected():
    link = np.ones((300, 400), bool)
    link[:, 200:] = False
    link[200:, :] = False
    link[200:, 200:] = True
    a, b = embeddings.spanning_edges(link, np.arange(300), np.arange(1000, 1400))
    assert len(set(a.tolist())) == 2 and len(a) == 700 and set(b.tolist()) == {*range(300), *range(1000, 1400)}


@pytest.mark.parametrize("per_group", [1_000_000, 20])
def test_components_of_a_chain_and_a_star(spark, per_group):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 400)] + [(7, 7), (None, 3)]
    found = _graph.components(spark.createDataFrame(edges, "a long, b long"), _session.shared_folder(spark), "t", per_group=per_group).collect()
    got = {r["node"]: r["component"] for r in found}
    assert len(found) == len(got) == 60 + 300
    assert got == {k: 1 for k in range(1, 61)} | {k: 100 for k in range(100, 400)}


def test_url_rules(spark):
    rules = [
        urls.Rule("net/", "block", True), urls.Rule("example.net/en/", "allow", True),
        urls.Rule("||ads.example^", "block"), urls.Rule("/good/", "allow"), urls.Rule("*spam*", "block"),
        urls.Rule("|http://exact|", "block")
    ]
    rows = [
        "http://a.example.net/en/x", "http://example.net/EN/x", "http://notexample.net?q=/en/",
        "https://ads.example/x", "https://ads.example/good/x", "https://badads.example/x", "http://x.org/myspammer",
        "http://exact", "http://exact/", None, "no scheme", "HTTP://A.NET/", "http://x.net", "a://b://c.net/"
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, rules).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/EN/x", "net/", "block")
    assert got[2] == ("notexample.net", "", None, "allow")
    assert [got[k][3] for k in range(3, 10)] == ["block", "allow", "allow", "block", "block", "allow", "allow"]
    assert got[9][:3] == got[10][:3] == ("", "", None)
    assert got[11][2] == "net/" and got[12][2] is None and got[13][:2] == ("b:", "//c.net/")
    assert urls.judge(df.limit(0), []).count() == 0
    # the same by a table of rules, with repeated rows and columns of clashing names
    twice = df.unionByName(df).withColumn("host", F.lit("mine")).withColumn("extra", F.lit(1))
    plan, table = (
        sorted(
            (
                tuple(str(x) for x in r) for r in urls.judge(twice, rules, in_plan=n).select(
                    "page_id", "host", "path", "rule", "pattern", "verdict", "extra"
                ).collect()
            )
        ) for n in (100, 0)
    )
    assert plan == table and len(plan) == 2 * len(rows)
    assert urls.judge(df.limit(0), rules, in_plan=0).count() == 0 and urls.judge(
        spark.createDataFrame([(1, "http://x.net/" + "a/" * 50_000)], "page_id long, url string"), rules
    ).first()["rule"] == "net/"


def test_many_rules_come_by_a_table(spark):
    rules = [urls.Rule(f"site{k}.org/", "block", True) for k in range(6000)]
    df = spark.createDataFrame([(k, f"http://www.site{k}.org/x") for k in range(0, 9000, 500)], "page_id long, url string")
    assert {r["page_id"] for r in urls.judge(df, rules).where("verdict = 'block'").collect()} == set(range(0, 6000, 500))


def test_rules_are_stored_under_their_rarest_token(spark):
    df = spark.createDataFrame([(1, "http://common.com/a"), (2, "http://common.com/rare")], "page_id long, url string")
    assert urls.rarest_tokens(df, [urls.Rule("||common^rare^", "block"), urls.Rule("*x*", "block")], "url") == {"rare": [0], "": [1]}


def test_wavelet_matrix():
    r = np.random.default_rng(2)
    ids = r.integers(0, 300, 5000).astype(np.uint32) ** 2
    w = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, [5, None], np.array([0, 10, 5000])).to_bytes())
    assert (w.decode() == ids).all() and w.docs == [5, None] and w.starts.tolist() == [0, 10, 5000]
    at = r.integers(0, 5000, 200)
    assert (w.access(at) == ids[at]).all()
    for t in (int(ids[0]), int(ids[99]), 7):
        places = np.flatnonzero(ids == t)
        assert w.count(t) == len(places) and [w.select(t, k) for k in range(len(places))] == places.tolist()
        assert w.rank(t, 2500) == (places < 2500).sum()
    with pytest.raises(IndexError):
        w.select(7, 0)
    for few in ([], [4], [4, 4]):
        assert WaveletMatrix.from_bytes(WaveletMatrix.build(np.array(few, np.uint32), [], np.array([0])).to_bytes()).decode().tolist() == few


def plain_tokens(path, rows):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(path), 0, {}
    for d, text in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out


def test_token_table_equals_the_library(spark):
    r = random.Random(3)
    odd = ["", None, "a's b'sx 're've don't I'M", "  lead tail  ", " \n\n x\ty", "<|endoftext|> x", "é’s 12³ 中文字 😀'm", "x" * 3000]
    rows = list(enumerate(odd + ["".join(r.choice("ab'sretlmdv  \n1.é€") for _ in range(r.randrange(60))) for _ in range(300)]))
    got = {
        x["doc_id"]: (x["start"], x["n_tokens"], x["ids_crc32"]) for x in tokens.token_table(
            spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path(), shard_tokens=500
        ).collect()
    }
    assert got == plain_tokens(queries.tokenizer_path(), rows)
    assert tokens.token_table(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer_path()).count() == 0


def test_queries_return_a_row_per_input_row(spark, data):
    for name, source in (
        ("op2_tag_path_ratios", "pages"), ("op3_kmeans_cosine", "embeddings"), ("op5_pu_quality", "documents"),
        ("op7_url_rules", "pages"), ("op9_wavelet_shards", "documents")
    ):
        assert queries.queries()[name](spark, data).count() == spark.read.parquet(f"{data}/{source}.parquet").count()


def test_pipeline_equals_its_plain_version(spark, data):
    import corpus_pipeline as cp
    from terrasample.llm import mix, quality

    from test_text_operators import plain_components, plain_contamination, shingles

    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = {
        r["doc_id"] for r in quality.score(docs, quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))).where("predicted = 1").collect()
    }
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in good}
    component = plain_components({k: shingles(r["text"]) for k, r in rows.items()})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = {k: r for k, r in rows.items() if component[k] == k and not plain_contamination(r["text"], items, 13)[4]}
    left = spark.createDataFrame(list(rows.values()), docs.schema)
    chosen = [(r["doc_id"], r["text"]) for r in mix.poisson_mix(left, queries.WEIGHTS, size=queries.MIX_SIZE, seed="mix-1").collect()]
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in cp.run(spark, data).collect())
    plain = {d: plain_tokens(queries.tokenizer_path(), [(d, t)])[d] for d, t in set(chosen)}
    assert got == sorted((d, *plain[d][1:]) for d, _ in chosen)
    assert [n for n, _ in cp.STAGES] and ngram_join.prefix_size(100, 0.75) == 26


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score string, n_hit int, rate double, copies int, position string"


def odd_documents(spark):
    long = " ".join(f"word{k % 997}x{k}" for k in range(60_000))
    rows = [
        (1, "one two three four five six", "en", "src0"), (1, "one two three four five six", "en", "src0"),
        (1, "other words of the same id, all of them new", "en", "src1"),
        (2, "one two three four five six", None, None), (3, None, "en", "src2"), (3, "", "en", "src2"),
        (None, None, None, None), (None, "one two three four five six", "en", "src0"), (5, long, "en", "src1"),
        (6, long + " end", "en", "src1")
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), f"s{k}", k, float(k), k, f"p{k}") for k, r in enumerate(rows)], CLASHING)


def test_pipeline_stages_of_odd_tables(spark, data):
    """Nulls, repeated rows and ids, long texts and clashing names: whole rows stay or go, their own columns unchanged."""
    import corpus_pipeline as cp

    docs = odd_documents(spark)
    given = {tuple(r) for r in docs.collect()}
    kept = {}
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept[name] = out.collect()
        assert {tuple(r) for r in kept[name]} <= given
        assert stage(spark, docs.limit(0), data).count() == 0
    one = kept["n-gram Jaccard join"]
    assert sorted(r["text"][:9] for r in one if r["doc_id"] is not None and r["text"]) == ["one two t", "other wor", "word0x0 w"]
    assert sum(r["doc_id"] is None for r in one) == 2 and sum(not r["text"] for r in one if r["doc_id"] == 3) == 2
    assert len(kept["benchmark decontamination"]) == docs.count()
    tokens_out = cp.STAGES[4][1](spark, docs, data).collect()
    assert len(tokens_out) == docs.count() and sum(r["doc_id"] is None for r in tokens_out) == 2
    assert cp.STAGES[4][1](spark, docs.limit(0), data).count() == 0


def test_pipeline_without_labels_keeps_all(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_documents(spark)
    assert cp.keep_quality(spark, docs, str(tmp_path)).count() == docs.count()


@pytest.mark.parametrize("most", [50, 3000, 10**6])
def test_encoder_equals_the_library(most):
    """Odd pieces in every order, also where the table of pieces is often full."""
    import random

    from tokenizers import Tokenizer

    plain, r = Tokenizer.from_file(queries.tokenizer_path()), random.Random(3)
    parts = [
        "a", "B", "z", "é", "ß", "1", "٣", "!", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "中", "😀",
        "…", "don't", "I'VE", "\x00", "_", " x", " word"
    ]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(3000)] + [None, "", "\n", "\n\n", "a\n", "\n a"]
    encoder = tokens.Encoder(queries.tokenizer_path(), most=most)
    for i in range(0, len(texts), 97):
        ids, count = encoder.encode(texts[i : i + 97])
        upto = 0
        for text, n in zip(texts[i : i + 97], count.tolist(), strict=True):
            assert ids[upto : upto + n].tolist() == plain.encode(text or "", add_special_tokens=False).ids
            upto += n


def test_token_table_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = tokens.token_table(docs, queries.tokenizer_path()).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    sizes = [len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows]
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(d, n) for (d, _), n in zip(rows, sizes, strict=True)]
