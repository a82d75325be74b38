"""The queries of the ten operators and of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setphrase.llm import embed_dedup, exact_dedup, html_main, langid, mixing, packing, simhash, toxicity, url_rules, wavelet
from setphrase.llm.common import crc32_of_id, shared_folder, table

SQL: dict[str, str] = {}


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


SQL["op2_exact_dedup"] = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(body) as text_sha256
from t window w as (partition by body)
"""


def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "wavelet")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, end_id=1)
    found = wavelet.read_shards(spark, path)
    return found.select(F.col("doc").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), size=2048, end_id=0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), folds=3, held_out=1)
    held_out = F.pmod(crc32_of_id("doc_id"), F.lit(3)) == 1
    return toxicity.score(docs, model, threshold=0.7).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, tau=3)


#: The contract's rules; the longest that fits wins.
HOST_RULES = (
    url_rules.HostRule("com", "/en/", "block"),
    url_rules.HostRule("example.com", "/en/7", "allow"),
    url_rules.HostRule("net", "/de/", "allow"),
    url_rules.HostRule("example.net", "/de/8", "block"),
    url_rules.HostRule("org", "/es/", "block"),
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), HOST_RULES)


_FITS = " union all ".join(f"select '{r.host}' as h, '{r.path}' as p, '{r.verdict}' as v" for r in HOST_RULES)
_PATTERNS = " or ".join(f"regexp_matches(host || lower(path), '{r.pattern}')" for r in url_rules.DEFAULT_PATTERNS)
SQL["op7_url_filter"] = rf"""
with cut as (select page_id, case when contains(url, '://') then regexp_replace(substr(url, strpos(url, '://') + 3), '[?#][\s\S]*$', '') else '' end as rest from pages),
split as (
  select page_id, translate(regexp_replace(rest, '/[\s\S]*$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    case when contains(rest, '/') then substr(rest, strpos(rest, '/')) else '' end as path
  from cut),
rules as ({_FITS}),
fits as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
  from split join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(v, case when {_PATTERNS} then 'block' else 'allow' end) as verdict
from split left join fits using (page_id)
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc32_of_id("doc_id"), F.lit(4)) == 2
    model = langid.train(docs, ~held_out)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "lang", "topic", F.col("tokens").alias("n_tokens"), F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def _raking_sql(rounds: int, exponent: float) -> str:
    """IPF with its rounds written out: each fits one marginal of the one before."""
    t = r"coalesce(text, '')"
    letters, other = rf"length(regexp_replace({t}, '[^\p{{L}}]+', '', 'g'))", rf"length(regexp_replace({t}, '[\p{{L}}\x20\x09-\x0D]+', '', 'g'))"
    parts = [
        rf"""docs as materialized (select doc_id, coalesce(source, '{mixing.UNKNOWN.strip(chr(0))}?') as source, coalesce(lang, '{mixing.UNKNOWN.strip(chr(0))}?') as lang,
  case when {letters} = 0 then 'none' when {letters} < 3 * {other} then 'symbols' when length({t}) < 1000 then 'short' when length({t}) < 10000 then 'medium' else 'long' end as topic,
  len(regexp_extract_all({t}, '[^\x20\x09-\x0D]+')) as n_tokens from documents)""",
        "c0 as materialized (select source, lang, topic, sum(n_tokens)::double as tokens, sum(n_tokens)::double as w from docs group by all having sum(n_tokens) > 0)",
    ]
    for d in mixing.DIMS:
        parts.append(f"t_{d} as materialized (select {d}, pow(sum(tokens), {exponent}) / sum(pow(sum(tokens), {exponent})) over () * (select sum(tokens) from c0) as want from c0 group by {d})")
    k = 0
    for _ in range(rounds):
        for d in mixing.DIMS:
            parts.append(f"c{k + 1} as materialized (select c.source, c.lang, c.topic, tokens, w * want / sum(w) over (partition by c.{d}) as w from c{k} c join t_{d} using ({d}))")
            k += 1
    parts.append(f"f as materialized (select source, lang, topic, w / tokens as factor, max(w / tokens) over () as top from c{k})")
    draw = "('0x' || substr(md5('mix:' || doc_id), 1, 13))::bigint / 4503599627370496.0"
    null = lambda c: f"nullif({c}, '{mixing.UNKNOWN.strip(chr(0))}?') as {c}"
    return f"with {', '.join(parts)} select doc_id, {null('source')}, {null('lang')}, topic, n_tokens, round(coalesce(factor, 1), 6) as weight, round(coalesce(factor / top, 1), 6) as probability, {draw} < coalesce(factor / top, 1) as sampled from docs left join f using (source, lang, topic)"


SQL["op10_source_mixing"] = _raking_sql(mixing.ROUNDS, 0.9)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
