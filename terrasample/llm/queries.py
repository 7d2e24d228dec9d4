"""The registered queries of this subpackage: thin calls with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasample.llm import decontaminate as contamination
from terrasample.llm import embeddings, html, mix, ngram_join, packing, pseudonyms, quality, ranked, tokens, toxicity, urls, whitening

#: Target shares of the mixture; sources without one share the rest by their rows.
WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.08, "src3": 0.02}
MIX_SIZE = 1.0
#: Key of the pseudonyms; a deployment passes its own.
KEY = "terrasample-demo-key"
#: Site rules of the contract, then patterns of unwanted hosts.
RULES = [
    urls.Rule("net/", "block", True), urls.Rule("example.net/en/", "allow", True), urls.Rule("example.com/de/", "block", True), urls.Rule("org/fr/", "allow", True),
    *(
        urls.Rule(f"||{x}^", "block") for x in ("casino-win", "cheap-pills", "free-bets", "ads-track")
    ), *(urls.Rule(x, "block") for x in ("/ads/", "^porn^", "^casino^", "^warez^")),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix.poisson_mix(docs, WEIGHTS, size=MIX_SIZE, seed="mix-1")


def op2_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_kmeans_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(table(spark, sf_dir, "documents"), KEY).select("doc_id", "text", "n_values")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer file, the same on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed_pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (
            op1_poisson_mix, op2_tag_path_ratios, op3_kmeans_cosine, op4_ordinal_toxicity, op5_pu_quality,
            op6_feistel_pseudonyms, op7_url_rules, op8_ngram_jaccard, op9_wavelet_shards, op10_wu_manber,
            op11_tiered_packing, op12_dual_tree_search, op13_bit_sliced_whitening
        )
    }


def _url_sql() -> str:
    site = [("net", "/"), ("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/")]
    action = {r.text: r.action for r in RULES if r.site}
    fits = [(f"(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')", h + p) for h, p in sorted(site, key=lambda x: -len(x[0] + x[1]))]
    blocked = r"^[^:/?#]*://(?:[^/?#]*\.)?(?:casino-win|cheap-pills|free-bets|ads-track)(?:[^a-z0-9_.%-]|$)|/ads/|(?:[^a-z0-9_.%-])(?:porn|casino|warez)(?:[^a-z0-9_.%-]|$)"
    lower = f"translate(coalesce(url, ''), '{urls._UPPER}', '{urls._LOWER}')"
    return f"""
with parts as (
  select page_id, {lower} as low,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{urls._UPPER}', '{urls._LOWER}') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
judged as (
  select *, case {" ".join(f"when {c} then '{r}'" for c, r in fits)} end as rule from parts)
select page_id, host, path, rule,
       case {" ".join(f"when rule = '{t}' then '{a}'" for t, a in action.items())}
            when regexp_matches(low, '{blocked}') then 'block' else 'allow' end as verdict
from judged"""


def _mix_sql() -> str:
    named = ", ".join(f"('{s}', {w}::double)" for s, w in WEIGHTS.items())
    left = 1 - sum(WEIGHTS.values())
    u = lambda seed, *p: f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(p)})), 1, 13))::bigint / {float(1 << 52)!r})"
    doc = "coalesce(doc_id::varchar, 'null')"
    return f"""
with weights(s, w) as (values {named}),
d as (select documents.*, weights.s, weights.w from documents left join weights on source = s),
n as (select s, max(w) as w, count(*) as n from d group by s),
r as (select s, case when s is null then {left!r} / n else w / n end * (select sum(n) from n) * {MIX_SIZE!r}::double as rate from n),
c as (select d.*, rate, {u("mix-1", doc)} as u from d join r on d.s is not distinct from r.s),
k as (select rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by rate order by k) as p
      from (select distinct rate from r where rate > 0), range(0, 200) t(k)),
copies as (select c.doc_id, c.text, c.lang, c.source, c.n_chars, c.rate, c.u, (select count(*) from k where k.rate = c.rate and c.u >= k.p) as copies from c)
select doc_id, text, lang, source, n_chars, rate, copies, copy, {u("mix-1-order", doc, "copy::varchar")} as position
from copies, unnest(range(0, copies)) t(copy)"""


def _search_sql() -> str:
    terms = rf"regexp_extract_all(translate(text, '{urls._UPPER}', '{urls._LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
with words as (
  select row_number() over () as r, doc_id,
         {terms} as t
  from documents where text is not null),
stats as (select count(*) as n_docs, sum(len(t))::bigint as n_all from words where len(t) > 0),
tf as (select r, doc_id, len(t) as n, term, count(*) as tf from (select r, doc_id, t, unnest(t) as term from words) group by all),
df as (select term, count(*) as df from tf group by term),
asked as (
  select distinct i, item_id, term from (
    select row_number() over () as i, item_id,
           unnest({terms}) as term
    from benchmark where text is not null)),
scored as (
  select i, item_id, r, doc_id,
         sum(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint
             * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_all))))::bigint as score
  from asked join tf using (term) join df using (term), stats group by i, item_id, r, doc_id),
best as (select *, row_number() over (partition by i order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from best where rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_poisson_mix": _mix_sql(), "op7_url_rules": _url_sql(), "op12_dual_tree_search": _search_sql()}
