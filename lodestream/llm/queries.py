"""The registered query of each operator, with production parameters, and its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import audit, decontam, exact, htmltext, katz, mixing, neardup, nndescent, quality, suffixdedup, urlfilter, variants, warc
from lodestream.llm.common import Stored, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES)


OP2_SQL = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n
  FROM pages),
m AS (
  SELECT u.*, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC, rverdict DESC) AS k
  FROM u LEFT JOIN rules ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))




def mix_domain() -> Column:
    """The domain of a row's source."""
    return F.when(F.col("source") == "src0", "web").when(F.length("source") == 4, "books").when(F.col("source").isNotNull(), "code")


MIX = {"domain_weights": {"web": 5, "books": 3, "code": 2}, "lang_weights": {"en": 6, "de": 2, "fr": 1, "es": 1}, "source_weights": {"src3": 4, "src12": 4}, "fraction": 0.8, "max_epochs": 2, "seed": 17}


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Stored(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.token_count("text").alias("n")), "mix-tokens").df
    got = mixing.mix(d, mix_domain(), **MIX, tokens=F.col("n"))
    return got.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


_SHARE_SQL = """
{name}_a AS (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(w) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM {src}),
{name}_b AS (SELECT *, level * w >= cap AS fits FROM {name}_a),
{name}_c AS (SELECT *, first_value(CASE WHEN NOT fits THEN level END IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cut FROM {name}_b),
{name} AS (SELECT *, CASE WHEN fits THEN cap ELSE CAST(floor(cut * w) AS BIGINT) END AS got FROM {name}_c)"""

_W = [("CASE mix_domain WHEN 'web' THEN 5.0 WHEN 'books' THEN 3.0 WHEN 'code' THEN 2.0 ELSE 1.0 END"), ("CASE mix_lang WHEN 'en' THEN 6.0 WHEN 'de' THEN 2.0 ELSE 1.0 END"), ("CASE WHEN mix_source IN ('src3', 'src12') THEN 4.0 ELSE 1.0 END")]


def mix_sql(docs: str, fraction: float, keep: str, max_epochs: int = 2, seed: int = 17) -> str:
    """DuckDB SQL of mixing.mix() with the weights of MIX over the relation `docs`."""
    return f"""
WITH d AS (
  SELECT *, coalesce(CASE WHEN source = 'src0' THEN 'web' WHEN length(source) = 4 THEN 'books' WHEN source IS NOT NULL THEN 'code' END, 'unknown') AS mix_domain,
         coalesce(lang, 'unknown') AS mix_lang, coalesce(source, 'unknown') AS mix_source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS mix_tokens
  FROM {docs}),
leaf AS (SELECT mix_domain, mix_lang, mix_source, CAST(sum(mix_tokens) AS BIGINT) AS tokens, CAST(sum(mix_tokens) AS BIGINT) * {max_epochs} AS cap FROM d GROUP BY ALL),
total AS (SELECT CAST(floor(sum(tokens) * CAST({fraction} AS DOUBLE)) AS BIGINT) AS budget FROM leaf),
s1 AS (SELECT 0 AS root, mix_domain, CAST(sum(cap) AS BIGINT) AS cap, CAST({_W[0]} AS DOUBLE) AS w, (SELECT budget FROM total) AS budget FROM leaf GROUP BY mix_domain),{_SHARE_SQL.format(name="t1", src="s1", by="root", order="cap / w, mix_domain")},
s2 AS (SELECT mix_domain, mix_lang, CAST(sum(leaf.cap) AS BIGINT) AS cap, CAST({_W[1]} AS DOUBLE) AS w, any_value(got) AS budget FROM leaf JOIN t1 USING (mix_domain) GROUP BY mix_domain, mix_lang),{_SHARE_SQL.format(name="t2", src="s2", by="mix_domain", order="cap / w, mix_lang")},
s3 AS (SELECT leaf.mix_domain, leaf.mix_lang, mix_source, tokens, leaf.cap, CAST({_W[2]} AS DOUBLE) AS w, got AS budget FROM leaf JOIN t2 USING (mix_domain, mix_lang)),{_SHARE_SQL.format(name="t3", src="s3", by="mix_domain, mix_lang", order="cap / w, mix_source")},
plan AS (SELECT mix_domain, mix_lang, mix_source, CASE WHEN tokens > 0 THEN CAST(floor(got / tokens) AS BIGINT) ELSE 0 END AS epochs, got, tokens FROM t3),
rows AS (SELECT d.*, epochs, got - epochs * tokens AS rest, md5('{seed}|' || CAST(epochs + 1 AS VARCHAR) || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM d JOIN plan USING (mix_domain, mix_lang, mix_source) WHERE mix_tokens > 0),
run AS (SELECT *, sum(mix_tokens) OVER (PARTITION BY mix_domain, mix_lang, mix_source ORDER BY h, doc_id, mix_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM rows),
drawn AS (SELECT *, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS mix_copies FROM run)
SELECT {keep} FROM drawn WHERE mix_copies > 0
"""


OP8_SQL = mix_sql("documents", MIX["fraction"], "doc_id, mix_domain AS domain, lang, source, mix_tokens AS n_tokens, mix_copies AS copies")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.resolve_revisits(warc.captures(read(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    page = lambda c: F.floor(F.col(c) / 2).cast("long")
    return got.select(page("record_id").alias("page_id"), "canonical", "state", page("response_id").alias("response_page_id"), text.alias("headers"))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, '"' || substr(md5(html), 1, 16) || '"' AS etag, coalesce(length(html), 0) AS n, coalesce(url, '') AS u FROM pages),
q AS (
  SELECT page_id, etag, n,
    regexp_replace(regexp_replace(translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', ''), ':(80|443)$', '') ||
    regexp_replace(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '') AS base,
    list_sort(list_filter(string_split(regexp_extract(u, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)='))) AS kept
  FROM p),
c AS (SELECT page_id, etag, n, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM q),
j AS (SELECT r.page_id, r.canonical, r.etag, r.page_id + 500 AS ts, f.page_id AS response_page_id, f.etag AS f_etag, f.n AS f_n
  FROM c r ASOF LEFT JOIN (SELECT * FROM c WHERE canonical <> '') f ON r.canonical = f.canonical AND r.page_id + 500 > f.page_id)
SELECT page_id, canonical, s AS state, response_page_id,
  CASE WHEN s IN ('resolved', 'unverified') THEN 'cache-control=max-age=60;content-length=' || f_n || ';content-type=text/html;date=' || ts END AS headers
FROM (SELECT *, CASE WHEN response_page_id IS NULL THEN 'missing' WHEN etag IS NULL OR f_etag IS NULL THEN 'unverified' WHEN etag = f_etag THEN 'resolved' ELSE 'mismatch' END AS s FROM j)
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality_crf, op2_url_rules, op5_decontaminate, op8_mix_sources, op9_warc_revisits)}
ORACLES: dict[str, str] = {"op2_url_rules": OP2_SQL, "op8_mix_sources": OP8_SQL, "op9_warc_revisits": OP9_SQL}


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), k=2, percent=80)


QUERIES["op3_hyperminhash"] = op3_hyperminhash


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(read(spark, sf_dir, "documents"))


QUERIES["op10_katz"] = op10_katz


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_bytes(read(spark, sf_dir, "documents"))


QUERIES["op7_suffix_dedup"] = op7_suffix_dedup


def op4_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES |= {"op4_html_crf": op4_html_crf, "op6_nn_descent": op6_nn_descent}


#: Every pair of texts that share a shingle, and all that can be reached over links.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""

#: Texts as hexadecimal bytes; a byte goes if one of the 50 strings that cover it also starts in an earlier document.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 100 <= length(h) THEN substr(h, 2 * i + 1, 100) END AS s FROM b),
f AS (SELECT doc_id, i, byte, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS starts FROM g),
c AS (SELECT doc_id, i, byte, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM c),
t AS (SELECT doc_id, count(CASE WHEN gone THEN 1 END) AS n_removed, count(CASE WHEN first THEN 1 END) AS n_spans, coalesce(string_agg(CASE WHEN NOT gone THEN byte END, '' ORDER BY i), '') AS kept FROM k GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""

ORACLES |= {"op3_hyperminhash": OP3_SQL, "op7_suffix_dedup": OP7_SQL}


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(read(spark, sf_dir, "documents"))


QUERIES |= {"op12_filter_audit": op12_filter_audit, "op13_exact_dedup": op13_exact_dedup}

#: Every row's five flags, every order's steps beside them, and the counts.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)),
n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, ascii(substr(filter_order, step, 1)) - 64 AS own, list_transform(string_split(left(filter_order, step - 1), ''), lambda x: ascii(x) - 64) AS gone FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)),
j AS (SELECT n.*, s.filter_order, s.step, s.own, fails[s.own] AS hit, step > 1 AND len(list_filter(gone, lambda g: fails[g])) > 0 AS late, len(list_filter(fails, lambda x: x)) = 1 AS single FROM n, steps s),
c AS (
  SELECT part, filter_order, step, own, CAST(sum(CASE WHEN NOT hit AND NOT late THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN hit AND NOT late THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN hit AND late THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN hit AND single THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN hit AND NOT late THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN hit AND NOT late THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM j GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""

ORACLES |= {"op12_filter_audit": OP12_SQL, "op13_exact_dedup": OP13_SQL}


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(read(spark, sf_dir, "documents"))


QUERIES["op11_spelling_variants"] = op11_spelling_variants

#: CRC-32 by its table; words that become alike by deleting one letter of either or of both at one place; forms followed to their end.
OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS c FROM r WHERE length(w) >= 7 GROUP BY ALL),
b AS (SELECT w, c, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END)) AS bytes FROM g),
h AS (SELECT w, c, xor(list_reduce(bytes, lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM b, crc),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h),
n AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM n)),
p AS (
  SELECT a.word, b.word AS other, b.n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, n.word, n.n FROM x JOIN n ON x.less = n.word
  UNION SELECT n.word, x.word, x.n FROM x JOIN n ON x.less = n.word),
q AS (SELECT word, count(*) AS n_near, max(n) AS best_n FROM p GROUP BY word),
o AS (SELECT p.word, min(other) AS best FROM p JOIN q ON p.word = q.word AND p.n = q.best_n GROUP BY p.word),
f AS (SELECT n.word, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n.n THEN best END AS form, CASE WHEN best_n >= 10 * n.n THEN best_n END AS form_n FROM n LEFT JOIN q USING (word) LEFT JOIN o USING (word)),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL),
e AS (SELECT c.word, c.at AS root FROM c JOIN f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e ON e.word = f.word
"""

ORACLES["op11_spelling_variants"] = OP11_SQL
