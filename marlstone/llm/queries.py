"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licences, mixing, phrases, quality, secrets, sharding, simhash, tokens, urls
from .shared import scratch

#: The tokenizer's vocabulary of ranks, of the box; not a part of this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: op6: no table holds a block list, so that of the query is three sixteenths of all urls, by the first digit of their MD5.
LISTED = "3"

ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return tokens.corpus_totals(_table(spark, sf_dir, "documents"), vocabulary, scratch(spark, "token-rollup"), copies=True)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", "doc_id"))
    return licences.scan(docs, "doc_id", "path").withColumnRenamed("key", "doc_id")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    keys = pages.select(F.concat(*urls.host_and_path(F.col("url"))).alias("key"))
    return urls.judge(pages, keys.filter((F.col("key") != "") & (F.substring(F.md5("key"), 1, 1) < LISTED)).distinct())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.removed(_table(spark, sf_dir, "documents")).drop("kept_text")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_license_scans": op5_license_scans,
    "op6_url_filters": op6_url_filters,
    "op7_simhash": op7_simhash,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_secret_scans": op9_secret_scans,
    "op10_decontamination": op10_decontamination,
}

_SPACE = r"[\x20\x09-\x0D]+"

#: Buckets of the quantile sketch: exact below 64, then 32 for each power of two.
ORACLE_SQL["op2_quality_rules"] = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM t, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY r),
m AS (SELECT t.r, doc_id, lang, source, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, (len(t) - len(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS up
  FROM t LEFT JOIN cov ON t.r = cov.r),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats,
    1000 * up // greatest(word_chars, 1) AS shouting, 10 * word_chars // greatest(n_words, 1) AS word_length FROM m),
v AS (SELECT lang, source, unnest(['symbols', 'repeats', 'shouting', 'word_length']) AS metric, unnest([symbols, repeats, shouting, word_length]) AS x FROM f),
b AS (SELECT lang, source, metric, 32 * greatest(len(bin(x)) - 6, 0) + (x >> greatest(len(bin(x)) - 6, 0)) AS b FROM v),
grp AS (SELECT 'own' AS lvl, lang, source, metric, b, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 'lang', lang, NULL, metric, b, count(*) FROM b GROUP BY ALL UNION ALL SELECT 'all', NULL, NULL, metric, b, count(*) FROM b GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, metric ORDER BY b) AS c, sum(n) OVER (PARTITION BY lvl, lang, source, metric) AS total FROM grp),
qb AS (SELECT lvl, lang, source, metric, min(total) AS total, min(CASE WHEN c * 100 >= total * 25 THEN b END) AS b25, min(CASE WHEN c * 100 >= total * 75 THEN b END) AS b75 FROM cum GROUP BY ALL),
q AS (SELECT lvl, lang, source, metric, total, (b25 - 32 * greatest(b25 // 32 - 1, 0)) << greatest(b25 // 32 - 1, 0)::INTEGER AS q25, (b75 - 32 * greatest(b75 // 32 - 1, 0)) << greatest(b75 // 32 - 1, 0)::INTEGER AS q75 FROM qb),
tongue AS (SELECT l.lang, l.metric, (l.total * l.q25 + {quality.PRIOR} * a.q25) // (l.total + {quality.PRIOR}) AS q25, (l.total * l.q75 + {quality.PRIOR} * a.q75) // (l.total + {quality.PRIOR}) AS q75 FROM q l JOIN q a ON l.lvl = 'lang' AND a.lvl = 'all' AND a.metric = l.metric),
pick AS (SELECT o.lang, o.source, o.metric, (o.total * o.q25 + {quality.PRIOR} * t.q25) // (o.total + {quality.PRIOR}) AS q25, (o.total * o.q75 + {quality.PRIOR} * t.q75) // (o.total + {quality.PRIOR}) AS q75
  FROM q o JOIN tongue t ON t.metric = o.metric AND t.lang IS NOT DISTINCT FROM o.lang WHERE o.lvl = 'own'),
fence AS (SELECT lang, source, max(CASE WHEN metric = 'symbols' THEN q75 + 4 * greatest(q75 - q25, 10) END) AS f1, max(CASE WHEN metric = 'repeats' THEN q75 + 4 * greatest(q75 - q25, 75) END) AS f2,
  max(CASE WHEN metric = 'shouting' THEN q75 + 4 * greatest(q75 - q25, 40) END) AS f3, max(CASE WHEN metric = 'word_length' THEN q75 + 4 * greatest(q75 - q25, 6) END) AS f4 FROM pick GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND symbols <= f1 AND repeats <= f2 AND shouting <= f3 AND word_length <= f4 AS kept, symbols, repeats, shouting, word_length
FROM f JOIN fence ON f.lang IS NOT DISTINCT FROM fence.lang AND f.source IS NOT DISTINCT FROM fence.source"""

ORACLE_SQL["op6_url_filters"] = rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, len(raw) + 1), '^[^?#]*') AS path FROM h),
x AS (SELECT *, '.' || host AS dotted, host || path <> '' AND substr(md5(host || path), 1, 1) < '{LISTED}' AS listed FROM p),
y AS (SELECT *, CASE WHEN dotted LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN dotted LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN dotted LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/' WHEN dotted LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/' WHEN dotted LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM x)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM y"""

ORACLE_SQL["op10_decontamination"] = rf"""
WITH i AS (SELECT row_number() OVER () AS ir, item_id, list_filter(regexp_split_to_array(lower(text), '{_SPACE}'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT ir, item_id, w, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT ir, item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM iw, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS p)),
size AS (SELECT ir, count(*) AS n FROM ig GROUP BY ir),
d AS (SELECT row_number() OVER () AS dr, doc_id, list_filter(regexp_split_to_array(lower(text), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT DISTINCT dr, doc_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM d, (SELECT DISTINCT k FROM iw), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS p)),
hit AS (SELECT dr, doc_id, ig.ir, item_id, count(*)::BIGINT AS n_shared FROM dg JOIN ig USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n::BIGINT AS n_item, n_shared / n AS containment FROM hit JOIN size USING (ir) WHERE 5 * n_shared >= 4 * n"""

_TEMPLATES = ", ".join("({}, '{}', {})".format(i, name, [w.replace("'", "''") for w in licences.plain_tokens(text)]) for i, (name, text) in enumerate(licences.TEMPLATES))


def _words_of(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(lower({x}), '{_SPACE}'), lambda w: regexp_replace(regexp_replace(w, '^[\p{{P}}\p{{S}}]+', ''), '[\p{{P}}\p{{S}}]+$', '')), lambda w: w <> '')"


ORACLE_SQL["op5_license_scans"] = rf"""
WITH f AS (SELECT row_number() OVER () AS r, doc_id, concat_ws('/', source, lang, doc_id) AS path, coalesce(text, '') AS t FROM documents),
tp AS (SELECT * FROM (VALUES {_TEMPLATES}) v(i, name, ws)),
tw AS (SELECT i, w, count(*) AS n, min(o) AS o FROM (SELECT i, unnest(ws) AS w, unnest(range(len(ws))) AS o FROM tp) GROUP BY ALL),
total AS (SELECT count(*) AS n FROM f),
tk AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM (SELECT r, {_words_of('t')} AS ws FROM f)),
df AS (SELECT w, count(DISTINCT r) AS d FROM tk WHERE w IN (SELECT w FROM tw) GROUP BY w),
idf AS (SELECT w, 1 + ln((1 + total.n) / (1 + coalesce(d, 0))::DOUBLE) AS x FROM (SELECT DISTINCT w FROM tw) LEFT JOIN df USING (w), total),
unit AS (SELECT i, w, o, n * x / sqrt(sum((n * x) ** 2) OVER (PARTITION BY i)) AS u FROM tw JOIN idf USING (w)),
lead AS (SELECT i, w, o FROM (SELECT *, 1 - coalesce(sum(u * u) OVER (PARTITION BY i ORDER BY round(u, 9) DESC, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM unit) WHERE sqrt(greatest(rest, 0)) >= {licences.THRESHOLD} - 1e-6),
win AS (SELECT DISTINCT r, i, greatest(p - o, 0) AS s FROM tk JOIN lead USING (w)),
ww AS (SELECT win.r, win.i, win.s, w, count(*) AS n FROM win JOIN tp USING (i) JOIN tk ON tk.r = win.r AND tk.p >= s AND tk.p < s + len(ws) GROUP BY ALL),
score AS (SELECT r, i, s, round(sum(n * coalesce(x, 1 + ln(1 + (SELECT n FROM total))) * coalesce(u, 0)) / sqrt(sum((n * coalesce(x, 1 + ln(1 + (SELECT n FROM total)))) ** 2)), 9) AS score
  FROM ww LEFT JOIN idf USING (w) LEFT JOIN unit USING (i, w) GROUP BY r, i, s),
good AS (SELECT r, s, score, name, len(ws) AS l FROM score JOIN tp USING (i) WHERE score >= {licences.THRESHOLD}),
own AS (SELECT r, first(name ORDER BY score DESC, name) AS own, max(score) AS score FROM good GROUP BY r),
spent AS (SELECT good.r, count(DISTINCT p) AS spent FROM good JOIN tk ON tk.r = good.r AND tk.p >= s AND tk.p < s + l GROUP BY good.r),
size AS (SELECT r, count(*) AS words FROM tk GROUP BY r),
g AS (SELECT f.r, doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS folder, own, score, own IS NOT NULL AND (regexp_matches(string_split(path, '/')[-1], '{licences.LICENCE_FILE}') OR words - spent <= {licences.MOST_OTHER_WORDS}) AS speaks
  FROM f LEFT JOIN own ON f.r = own.r LEFT JOIN spent ON f.r = spent.r LEFT JOIN size ON f.r = size.r),
dirs AS (SELECT folder AS dir, own AS lic FROM (SELECT folder, own, count(*) AS n FROM g WHERE speaks GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, own) = 1),
near AS (SELECT folder, arg_max(dir, length(dir)) AS from_dir, arg_max(lic, length(dir)) AS lic FROM (SELECT DISTINCT folder FROM g WHERE own IS NULL) JOIN dirs ON dir = '' OR folder = dir OR starts_with(folder, dir || '/') GROUP BY folder)
SELECT doc_id, path, coalesce(own, lic) AS licence, score, CASE WHEN own IS NOT NULL THEN 'own' WHEN lic IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis, CASE WHEN own IS NULL THEN from_dir END AS from_dir
FROM g LEFT JOIN near ON g.own IS NULL AND g.folder = near.folder"""
