"""The queries of this package, one for each operator, over the whole intended tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import documents
from .exact_dedup import exact_groups
from .licenses import license_digest
from .lm_scoring import cross_entropy_difference
from .mixing import mix
from .packing import pack
from .ranked import ranked
from .repeats import repeats_digest
from .secrets import secret_digest
from .simhash import near_groups
from .topk import top_products
from .toxicity import toxicity_scores
from .whitening import whiten


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(documents(spark, sf_dir))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(documents(spark, sf_dir))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality > 0")
    rows = cross_entropy_difference(documents(spark, sf_dir), good)
    # sums of logarithms differ in their last digits from one order to another
    return rows.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_simhash, op4_secrets, op5_packing, op6_licenses, op7_nearest, op8_repeats, op9_lm_scoring, op10_exact_dedup, op11_whitening, op12_ranked, op13_topk)}


#: White space runs become one space, as in exact_dedup.normalised.
_OP10 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


#: The exact answer, by brute force. The search is approximate, but on tables of a few hundred vectors it looks into nearly all
#: and finds the same; on larger ones its recall is measured instead.
_OP7 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
n AS (SELECT len(e) AS d FROM g GROUP BY 1 ORDER BY count(*) DESC, d LIMIT 1), u AS (SELECT * FROM g WHERE len(e) = (SELECT d FROM n)),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM u q JOIN u c ON c.r <> q.r WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 10
"""

#: Each string of 200 bytes, by the hexadecimal text of its document; hexadecimal digits come in pairs.
_OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, h, unnest(range(greatest(length(h) // 2 - 199, 0))) AS i FROM d),
k AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM s),
c AS (SELECT r, i FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)),
e AS (SELECT r, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM e),
p AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, g),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM p),
o AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM q JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN o USING (r)
"""

#: Both models word by word; c counts, own the document's part of them, k whether the word is in the vocabulary.
_LOSS = """-ln(CASE WHEN vk AND v{m} - {inside} * vown > 0 THEN 0.6 * least(CASE WHEN xk THEN (coalesce(p{m}, 0) - {inside} * coalesce(pown, 0)) / (v{m} - {inside} * vown) ELSE 0 END, 1.0) + 0.4 * {one} ELSE {one} END)"""
_ONE = """(CASE WHEN xk THEN x{m} - {inside} * xown ELSE tokens_{m} - known_{m} - {inside} * strange END + 0.5) / (tokens_{m} - {inside} * size + 0.5 * (vocabulary + 1))"""


def _loss(m: str, inside: str) -> str:
    return _LOSS.format(m=m, inside=inside, one="(" + _ONE.format(m=m, inside=inside) + ")")


_OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS w,
  coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality > 0 AND doc_id IS NOT NULL), false) AS hit FROM documents),
t AS (SELECT r, hit::INT AS hit, unnest(range(len(w))) AS i, unnest(w) AS x FROM d),
p AS (SELECT *, lag(x) OVER (PARTITION BY r ORDER BY i) AS v FROM t),
one AS (SELECT x, count(*) AS b, sum(hit) AS g, count(*) >= 2 AS k FROM t GROUP BY x),
two AS (SELECT v, x, count(*) AS b, sum(hit) AS g FROM p WHERE v IS NOT NULL GROUP BY v, x),
own1 AS (SELECT r, x, count(*) AS n FROM t GROUP BY r, x),
own2 AS (SELECT r, v, x, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY r, v, x),
stats AS (SELECT sum(b) AS tokens_b, sum(g) AS tokens_g, count(*) FILTER (WHERE k) AS vocabulary, coalesce(sum(b) FILTER (WHERE k), 0) AS known_b, coalesce(sum(g) FILTER (WHERE k), 0) AS known_g FROM one),
odd AS (SELECT r, count(*) AS size, count(*) FILTER (WHERE NOT k) AS strange FROM t JOIN one USING (x) GROUP BY r),
f AS (SELECT p.r, p.hit, size, strange, tokens_b, tokens_g, vocabulary, known_b, known_g, a.b AS xb, a.g AS xg, a.k AS xk, oa.n AS xown, c.b AS vb, c.g AS vg, coalesce(c.k, false) AS vk, oc.n AS vown, two.b AS pb, two.g AS pg, o2.n AS pown
  FROM p JOIN odd ON odd.r = p.r CROSS JOIN stats JOIN one a ON a.x = p.x JOIN own1 oa ON oa.r = p.r AND oa.x = p.x LEFT JOIN one c ON c.x = p.v LEFT JOIN own1 oc ON oc.r = p.r AND oc.x = p.v
  LEFT JOIN two ON two.v = p.v AND two.x = p.x LEFT JOIN own2 o2 ON o2.r = p.r AND o2.v = p.v AND o2.x = p.x),
l AS (SELECT r, sum({_loss('g', 'hit')}) / any_value(size) AS tl, sum({_loss('b', '1')}) / any_value(size) AS bl FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(tl, 0), 6) AS target_loss, round(coalesce(bl, 0), 6) AS background_loss, round(coalesce(tl - bl, 0), 6) AS score FROM d LEFT JOIN l USING (r)
"""


#: Vectors of one length; a null id is the last of its ties.
_OP13 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.r <> q.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 5
"""


#: Terms of a text, A-Z lower-cased.
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS t FROM benchmark),
s AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
asked AS (SELECT q, item_id, unnest(t) AS x FROM i),
p AS (SELECT r, x, count(*) AS tf FROM (SELECT r, unnest(t) AS x FROM d) WHERE x IN (SELECT x FROM asked) GROUP BY r, x),
w AS (SELECT x, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p CROSS JOIN s GROUP BY x, n),
e AS (SELECT r, x, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(t)::BIGINT * n) // l))) AS v FROM p JOIN w USING (x) JOIN d USING (r) CROSS JOIN s),
f AS (SELECT q, item_id, doc_id, r, sum(v)::BIGINT AS score FROM asked JOIN e USING (x) JOIN d USING (r) GROUP BY q, item_id, doc_id, r HAVING sum(v) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM f)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 50
"""


def oracle_sql() -> dict:
    return {"op7_nearest": _OP7, "op8_repeats": _OP8, "op9_lm_scoring": _OP9, "op10_exact_dedup": _OP10, "op12_ranked": _OP12, "op13_topk": _OP13}
