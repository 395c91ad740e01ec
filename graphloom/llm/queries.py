"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, codes, embeddings, html, media, mixing, ngrams, quality, secrets, tokenfiles, toxicity, winnowing
from .common import table

#: Where the public vocabulary files are unless a caller names another.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    live = F.size(F.filter("spans", lambda s: s["live"] & ~s["copied"])).cast("long")
    copied = F.size(F.filter("spans", lambda s: s["copied"])).cast("long")
    widest = lambda of: F.coalesce(F.array_max(F.transform("spans", lambda s: s[of])), F.lit(0)).cast("long")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), live.alias("n_live"), copied.alias("n_copied"), widest("owners").alias("most_owners"), widest("repositories").alias("most_repositories"))


def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), vocabulary_path(), finish=bpe.DIGESTS)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.probe(media.mux(table(spark, sf_dir, "documents")))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.join(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.stored(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.report(*clusters.clustered(table(spark, sf_dir, "embeddings"))).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(*codes.compressed(table(spark, sf_dir, "embeddings")))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = winnowing.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_bpe_encoding": op2_bpe_encoding,
    "op3_media_columns": op3_media_columns,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_html_extraction": op5_html_extraction,
    "op6_token_files": op6_token_files,
    "op7_toxicity": op7_toxicity,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_quality": op9_quality,
    "op10_mixing_sources": op10_mixing_sources,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_vector_codes": op12_vector_codes,
    "op13_decontamination": op13_decontamination,
}


def _clustering_sql(k: int = clusters.CENTROIDS, rounds: int = clusters.ROUNDS) -> str:
    """Lloyd's rounds written out, one set of tables for each."""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, x, d.c AS c, d.d AS d FROM (SELECT v.vec_id, v.x, min({{'d': {apart}, 'c': c.c}}) AS d FROM v, c{r} c GROUP BY v.vec_id, v.x))""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT c, i, sum(x[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY c, i),
c{r + 1} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{r} GROUP BY c UNION ALL SELECT c, x FROM c{r} WHERE c NOT IN (SELECT c FROM m{r}))""")
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {k}),
{", ".join(steps)},
t AS (SELECT c, sum(d)::BIGINT AS ci FROM a{rounds} GROUP BY c)
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, ci AS cluster_inertia, (SELECT sum(ci)::BIGINT FROM t) AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN t USING (c) JOIN c{rounds} f USING (c)"""


def _codes_sql(entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS) -> str:
    apart = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, p, x, d.c AS c, d.d AS d FROM (SELECT v.vec_id, v.p, v.x, min({{'d': {apart}, 'c': c.c}}) AS d FROM v JOIN c{r} c USING (p) GROUP BY v.vec_id, v.p, v.x))""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT p, c, i, sum(x[i])::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT p, c, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY p, c, i),
c{r + 1} AS (SELECT p, c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{r} GROUP BY p, c UNION ALL SELECT p, c, x FROM c{r} WHERE (p, c) NOT IN (SELECT (p, c) FROM m{r}))""")
    return f"""
WITH w AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor(4096 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
v AS (SELECT vec_id, p, x[p * (len(x) // 8) + 1 : (p + 1) * (len(x) // 8)] AS x FROM w, range(8) AS t(p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM w QUALIFY c < {entries}),
c0 AS (SELECT p, c, x FROM v JOIN f USING (vec_id)),
{", ".join(steps)},
e AS (SELECT vec_id, string_agg(printf('%02x', c), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, c)) FROM c{rounds}) AS codebooks_sha256 FROM w JOIN e USING (vec_id)"""

def _secrets_sql() -> str:
    """Matches get marks of the private-use area around them, which tell where they start."""
    assign = secrets.ASSIGN.pattern.replace("'", "''")
    least = (*secrets.LEAST.values(), 20)
    patterns = (assign, secrets.ACCESS.pattern, secrets.HEX.pattern, secrets.OWNED.pattern)
    cuts = " UNION ALL ".join(rf"SELECT r, {k} AS k, '{kind}' AS kind, {least[k]} AS least, string_split(regexp_replace(t, '{patterns[k]}', chr(57344) || '\0' || chr(57345), 'g'), chr(57344)) AS parts FROM d" for k, kind in enumerate(secrets.KINDS))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS o, concat_ws('/', source, lang) AS p FROM documents),
cuts AS ({cuts}),
each AS (SELECT r, k, kind, least, split_part(parts[i], chr(57345), 1) AS m, list_sum(list_transform(parts[1 : i - 1], lambda x: length(x)))::BIGINT - (i - 2) AS s
  FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM cuts WHERE len(parts) > 1)),
f AS (SELECT r, k, kind, s, s + length(m) AS e, v FROM (SELECT *, CASE k WHEN 0 THEN regexp_extract(m, '{assign}', 2) ELSE m END AS v FROM each) WHERE length(v) >= least),
g AS (SELECT * FROM f WHERE k < 3 UNION ALL SELECT * FROM f WHERE k = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
  AND NOT EXISTS (SELECT 1 FROM f b WHERE b.k < 3 AND b.r = f.r AND b.s < f.e AND f.s < b.e)),
bits AS (SELECT v, -sum(n / length(v) * log2(n / length(v))) AS h FROM (SELECT v, c, count(*) AS n FROM (SELECT v, unnest(string_split(v, '')) AS c FROM (SELECT DISTINCT v FROM g)) GROUP BY v, c) GROUP BY v),
often AS (SELECT v, count(DISTINCT o)::BIGINT AS owners, count(DISTINCT p)::BIGINT AS repositories FROM g JOIN d USING (r) GROUP BY v),
j AS (SELECT r, k, kind, s, e, h >= {secrets.LIVE_BITS} AND regexp_matches(v, '[0-9]') AS live, owners >= {secrets.COPIED_OWNERS} AS copied, owners, repositories FROM g JOIN bits USING (v) JOIN often USING (v)),
a AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
    count(*) FILTER (live AND NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied, max(owners) AS most_owners, max(repositories) AS most_repositories
  FROM j WHERE k < 3 OR (live AND NOT copied) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN a USING (r)"""


SQL = {
    "op1_secret_scans": _secrets_sql(),
    "op4_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, md5(array_to_string(w, ' ')) AS u FROM d),
u AS (SELECT u, first(w) AS w, min(doc_id) AS low FROM x GROUP BY u),
g AS (SELECT DISTINCT u, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT u, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM u)),
n AS (SELECT u, count(*) AS n FROM g GROUP BY u),
o AS (SELECT a.u AS a, b.u AS b, count(*) AS o FROM g a JOIN g b USING (g) WHERE a.u <> b.u GROUP BY a.u, b.u),
l AS (SELECT a, b FROM o JOIN n ON n.u = a JOIN n k ON k.u = b WHERE 100 * o >= 75 * (n.n + k.n - o)),
c AS (SELECT u, u AS t FROM n UNION SELECT c.u, l.b FROM c JOIN l ON c.t = l.a),
m AS (SELECT c.u, min(u.low) AS component_id FROM c JOIN u ON c.t = u.u GROUP BY c.u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM x LEFT JOIN n USING (u) LEFT JOIN m USING (u)""",
    "op8_embedding_near_dedup": r"""
WITH RECURSIVE x AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT e, min(vec_id) AS low, count(*) AS k, min(r) AS u FROM x WHERE len(e) > 0 AND len(list_filter(e, lambda c: c IS NOT NULL AND isfinite(c))) = len(e) AND len(list_filter(e, lambda c: c <> 0)) > 0 GROUP BY e),
l AS (SELECT a.u AS a, b.u AS b, b.k FROM u a JOIN u b ON len(a.e) = len(b.e) AND a.u <> b.u WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT u, u AS t FROM u UNION SELECT c.u, l.b FROM c JOIN l ON c.t = l.a),
m AS (SELECT c.u, min(v.low) AS component_id FROM c JOIN u v ON c.t = v.u GROUP BY c.u),
n AS (SELECT u, k - 1 + coalesce(o, 0) AS n FROM u LEFT JOIN (SELECT a AS u, sum(k) AS o FROM l GROUP BY a) USING (u))
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(vec_id = component_id, true) AS kept
FROM x LEFT JOIN u ON x.e = u.e LEFT JOIN m USING (u) LEFT JOIN n USING (u)""",
    "op10_mixing_sources": """
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS k
  FROM documents),
s0 AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
s1 AS (SELECT *, (CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS w FROM s0),
s2 AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS all_w,
         coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
         coalesce(sum(w) OVER (ORDER BY source_size * 3 / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM s1),
s3 AS (SELECT *, (total - capped)::DOUBLE / (all_w - used)::DOUBLE AS level FROM s2),
s4 AS (SELECT *, min(CASE WHEN source_size * 3 > level * w THEN used END) OVER () AS first_open FROM s3),
s5 AS (SELECT *, max(CASE WHEN used = first_open THEN level END) OVER () AS cut FROM s4),
s AS (SELECT skey, source_size, CASE WHEN cut IS NULL OR used < first_open THEN (source_size * 3)::DOUBLE ELSE cut * w END AS target FROM s5),
p AS (SELECT d.*, s.source_size, s.target, round(s.target)::BIGINT AS budget,
        coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN s USING (skey)),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM p)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, budget - passes * source_size - ahead)))::BIGINT AS taken FROM q""",
    "op11_centroid_clustering": _clustering_sql(),
    "op12_vector_codes": _codes_sql(),
    "op13_decontamination": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
k AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM k),
h AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
m AS (SELECT r, i, n, t FROM h WHERE t IN (SELECT t FROM k)),
c AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
l AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m JOIN k USING (t)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r)""",
}
