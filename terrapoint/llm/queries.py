"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapoint.llm import ann, decontaminate, near_dup, packing, quality, shards, site_tree, substring_dedup, toxicity, url_reputation
from terrapoint.llm.common import fold, scratch, table

WINDOW = 1024
#: The url rules of the contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _judged(scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return _judged(quality.score(docs, model), fold("doc_id", 5) == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return _judged(toxicity.score(docs, model), fold("doc_id", 4) == 2)


def op2_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, scratch(spark, "shards"))
    arrivals = [docs.where(fold("doc_id", 6) == i) for i in range(5)] + [docs.where(F.coalesce(fold("doc_id", 6), F.lit(5)) == 5)]
    rows = shards.compacted(store, arrivals)
    return rows.select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("text_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


#: What pages and documents have in common: an article's letters and digits, without its heading and markup.
_ARTICLE, _HEADING, _MARKUP, _ODD = "(?is)<article[^>]*>(.*?)</article>", "(?is)<h1[^>]*>.*?</h1>", "(?s)<[^>]*>|&#?[A-Za-z0-9]+;", "[^\\p{L}\\p{N}]"


def page_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id and good (1 or 0) of the pages whose article is the text of a labelled document. Labels name documents,
    and pages have numbers of their own, so the two are joined by their letters."""
    plain = lambda c: F.md5(F.regexp_replace(F.lower(c), _ODD, "").cast("binary"))
    article = F.regexp_replace(F.regexp_replace(F.regexp_extract("html", _ARTICLE, 1), _HEADING, ""), _MARKUP, "")
    good = ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")
    known = labels.select("doc_id", good.alias("good")).where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    texts = docs.where("text is not null").select("doc_id", plain(F.col("text")).alias("key"))
    by_text = texts.join(known, "doc_id").groupBy("key").agg(F.min("good").alias("good"))
    return pages.where("html is not null").select("page_id", plain(article).alias("key")).join(by_text, "key").select("page_id", "good")


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = page_outcomes(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return url_reputation.judge(pages, outcomes, URL_RULES)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.spans(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), WINDOW, with_ids=False)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_compaction": op2_compaction,
    "op5_toxicity": op5_toxicity,
    "op3_url_reputation": op3_url_reputation,
    "op4_substring_dedup": op4_substring_dedup,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_packing": op7_packing,
    "op8_main_text": op8_main_text,
    "op9_nearest": op9_nearest,
    "op10_decontamination": op10_decontamination,
}

def _strength_sql(table_name: str) -> str:
    """Moments of a beta-binomial over the groups of a table (good, n), as in url_reputation.strength."""
    return f"""(SELECT CASE WHEN coalesce(sum(n), 0) = 0 OR count(*) < 2 OR any_value(m) * (1 - any_value(m)) <= 0 THEN 1000.0
 ELSE (SELECT CASE WHEN rho > 0 THEN least(1000.0, greatest(1.0, (1 - rho) / rho)) ELSE 1000.0 END FROM (SELECT CASE WHEN f > 0 THEN (sp - (k - 1)) / f ELSE 0.0 END AS rho
 FROM (SELECT sum(n * power(good / n - m, 2)) / (any_value(m) * (1 - any_value(m))) AS sp, count(*) AS k, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS f FROM {table_name}, mean WHERE n > 0))) END FROM {table_name}, mean WHERE n > 0)"""


def _rules_sql() -> tuple[str, str]:
    rule = verdict = ""
    for kind, text in sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN "
        rule, verdict = rule + fits + f"'{text}' ", verdict + fits + f"'{kind}' "
    return f"CASE {rule}END", f"CASE {verdict}END"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TWO = ", ".join(f"'{s}'" for s in url_reputation.TWO_LABEL_SUFFIXES)
_SQL3 = f"""WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
 urls AS (SELECT page_id, translate(h, '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM split),
 known AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND NOT (quality IS NULL AND coalesce(toxic, 0) = 0) GROUP BY doc_id),
 texts AS (SELECT md5(regexp_replace(lower(text), '{_ODD}', '', 'g')) AS key, min(good) AS good FROM documents JOIN known USING (doc_id) WHERE text IS NOT NULL GROUP BY 1),
 articles AS (SELECT page_id, md5(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(html, '{_ARTICLE}', 1), '{_HEADING}', '', 'g'), '{_MARKUP}', '', 'g')), '{_ODD}', '', 'g')) AS key FROM pages WHERE html IS NOT NULL),
 good AS (SELECT page_id, good FROM articles JOIN texts USING (key)),
 hosts0 AS (SELECT u.host, CAST(coalesce(sum(g.good), 0) AS DOUBLE) AS good, CAST(count(g.good) AS DOUBLE) AS n FROM urls u LEFT JOIN good g USING (page_id) GROUP BY u.host),
 mean AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(good) + 1) / (sum(n) + 2) ELSE 0.5 END AS m FROM hosts0),
 named AS (SELECT *, string_split(regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '\\.$', ''), '.') AS l, regexp_replace(host, ':[0-9]*$', '') AS name FROM hosts0),
 labelled AS (SELECT *, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three, regexp_matches(name, '^[0-9]+(\\.[0-9]+){{3}}$') AS ip FROM named),
 hosts AS (SELECT host, good, n, CASE WHEN ip THEN name WHEN two IN ({_TWO}) THEN three ELSE two END AS domain, CASE WHEN ip THEN '' WHEN two IN ({_TWO}) THEN two ELSE l[-1] END AS suffix FROM labelled),
 domains AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM hosts GROUP BY ALL),
 suffixes AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM domains GROUP BY ALL),
 k AS (SELECT {_strength_sql("suffixes")} AS ks, {_strength_sql("domains")} AS kd, {_strength_sql("hosts")} AS kh),
 s AS (SELECT suffix, (good + ks * m) / (n + ks) AS prior FROM suffixes, k, mean),
 d AS (SELECT domain, suffix, (good + kd * prior) / (n + kd) AS prior FROM domains JOIN s USING (suffix), k),
 h AS (SELECT host, good + kh * prior AS a, n - good + kh * (1 - prior) AS b FROM hosts JOIN d USING (domain, suffix), k),
 r AS (SELECT host, a / (a + b) AS posterior, least(1.0, a / (a + b) + 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))) AS bound FROM h)
 SELECT page_id, host, path, {_rules_sql()[0]} AS rule, coalesce({_rules_sql()[1]}, CASE WHEN bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(posterior, 6) AS posterior, round(bound, 6) AS bound FROM urls JOIN r USING (host)"""

ORACLES: dict[str, str] = {
    "op2_compaction": "SELECT doc_id, lang, source, n_chars, length(text) AS text_chars, md5(text) AS text_md5 FROM documents",
    "op3_url_reputation": _SQL3,
}
