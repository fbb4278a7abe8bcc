"""One query per training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import bpe, centroids, embedding_dedup, id_shards, jaccard_join, kd_sharding, langid, lattice_lm, lexical, mixing, suffix_dedup, syncmers, warc
from corpuscope.llm.common import held_out, table
from corpuscope.session import run_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"))


@_query
def op9_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    unseen = held_out("doc_id", 3)
    model = langid.fit(docs, train=~unseen)
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", unseen.alias("held_out"), "lang_pred", "score")


@_query
def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op5_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    sha256(concat('mix:', CAST(doc_id AS VARCHAR))) AS key
  FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
    source_size * 2.0::DOUBLE AS cap FROM sums),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) /
    (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT level, cap / weight AS ratio, rank FROM levels WHERE level * weight < cap ORDER BY 2, 3 LIMIT 1),
targets AS (
  SELECT l.source, l.source_size, CASE WHEN c.level IS NULL OR l.cap / l.weight < c.ratio
    OR (l.cap / l.weight = c.ratio AND l.rank < c.rank) THEN l.cap ELSE least(l.cap, c.level * l.weight) END AS target
  FROM levels l LEFT JOIN cut c ON true),
placed AS (
  SELECT s.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size +
    greatest(0, least(size, budget % source_size - start)) END AS BIGINT) AS taken
FROM placed"""


@_query
def op3_kd_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = kd_sharding.shards(table(spark, sf, "documents"), n_leaves=24)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


@_query
def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = run_dir(spark, "warc")
    warc.write_archives(warc.with_revisits(table(spark, sf, "pages")), folder)
    return warc.page_records(warc.read_archives(spark, folder))


ORACLES["op1_warc"] = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM sized)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM firsts"""


@_query
def op10_lattice_lm(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    unseen = held_out("doc_id", 5)
    model = lattice_lm.fit(docs, train=~unseen)
    scored = lattice_lm.score(docs, model)
    return scored.select(
        "doc_id", unseen.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@_query
def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf, "documents"))


@_query
def op7_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf, "embeddings"))


ORACLES["op7_embedding_dedup"] = """
WITH RECURSIVE units AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM units a JOIN units b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.y, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(l.y, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least l ON e.vec_id = l.x LEFT JOIN counts c ON e.vec_id = c.x"""


@_query
def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"))


@_query
def op8_syncmers(spark: SparkSession, sf: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf, "documents"))


@_query
def op13_id_shards(spark: SparkSession, sf: str) -> DataFrame:
    docs, folder = table(spark, sf, "documents"), run_dir(spark, "id-shards")
    id_shards.write_shards(docs, folder)
    id_shards.build_index(spark, folder)
    found = id_shards.fetch(spark, folder, docs)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster(table(spark, sf, "embeddings"))


def _centroid_sql(rounds: int) -> str:
    far = "list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))"
    steps = [
        """kept AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS (
  SELECT row_number() OVER (ORDER BY sha256(concat('1:', CAST(vec_id AS VARCHAR))), v) - 1 AS k, v FROM kept QUALIFY k < 16)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT p.vec_id, p.row, p.v, c.k, CAST({far} AS BIGINT) AS far FROM kept p, c{r} c
  QUALIFY row_number() OVER (PARTITION BY p.row ORDER BY far, c.k) = 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS (
  SELECT k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY k, i)""")
            steps.append(f"""c{r + 1} AS (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY k
  UNION ALL SELECT k, v FROM c{r} WHERE k NOT IN (SELECT k FROM a{r}))""")
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.far AS distance,
  CAST(sum(a.far) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.far) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"""


ORACLES["op12_centroids"] = _centroid_sql(centroids.ROUNDS)


@_query
def op11_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


ORACLES["op11_lexical"] = r"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
docs AS (SELECT doc_id, row, terms, len(terms) AS n FROM cut WHERE len(terms) > 0),
stats AS (SELECT count(*) AS N_all, CAST(sum(n) AS BIGINT) AS L FROM docs),
postings AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(N_all) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM postings, stats GROUP BY term),
asked AS (
  SELECT item_id, item, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS item FROM benchmark)),
times AS (SELECT item_id, item, term, count(*) AS k FROM asked GROUP BY item_id, item, term),
scored AS (
  SELECT t.item_id, t.item, d.doc_id, d.row, CAST(sum(t.k * w.w * (
    (1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + ((25 * d.n * s.N_all) // s.L))))) AS BIGINT) AS score
  FROM times t JOIN postings p ON t.term = p.term JOIN weights w ON t.term = w.term JOIN docs d ON d.row = p.row, stats s
  GROUP BY t.item_id, t.item, d.doc_id, d.row)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20"""
