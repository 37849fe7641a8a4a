"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, context_mixing, doubling, language_id, line_crf, merkle, minhash, mixing, packing, sharding, suffix_dedup, tiling, weak_rules

#: Where the vocabulary of op 12 lies on every machine.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


ORACLES["op4_mixing"] = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':17') AS key
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT source, source_size, source_size * 2 AS cap,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sizes
), summed AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
         (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open
  FROM weighed
), level AS (
  SELECT budget AS b, capped AS c, open AS o FROM summed
  WHERE (budget - capped) * weight < cap::DOUBLE * open
  ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, weight * (b - c) / o), cap::DOUBLE) AS target
  FROM summed LEFT JOIN level ON true
), placed AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS quota,
         coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN quota // source_size * size
                  + greatest(0, least(size, quota - quota // source_size * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM placed
"""


@query
def op8_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judged(table(spark, sf_dir, "documents"))


@query
def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.score_documents(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict_documents(docs, language_id.train(docs))


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(table(spark, sf_dir, "documents"))


@query
def op5_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_documents(table(spark, sf_dir, "documents"))


@query
def op9_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.repeated_words(table(spark, sf_dir, "documents"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


#: CRC-32 of a string of ASCII characters.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda s: ascii(s)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: i::BIGINT)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"

ORACLES["op11_merkle"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_LEAF.format("text")} AS leaf,
         CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 3 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), low AS (
  SELECT lang, 0 AS lev, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT lang, lev + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(node, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lang, lev, pos // 8
), subroots AS (
  SELECT lang, node AS subroot, lev AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS lev, pos, n, subroot AS node FROM subroots
  UNION ALL
  SELECT lev + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(node, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lev, pos // 8
), low_runs AS (
  SELECT lang, lev, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM low WHERE n > 1 GROUP BY ALL
), high_runs AS (
  SELECT lev, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM high WHERE n > 1 GROUP BY ALL
), steps AS (
  SELECT p.lang, p.pos, r.lev AS step, array_to_string(r.nodes[:p.pos // (8 ** r.lev)::BIGINT % 8], '') AS l, array_to_string(r.nodes[p.pos // (8 ** r.lev)::BIGINT % 8 + 2:], '') AS r
  FROM placed p JOIN low_runs r ON p.lang IS NOT DISTINCT FROM r.lang AND r.run = p.pos // (8 ** (r.lev + 1))::BIGINT
  UNION ALL
  SELECT p.lang, p.pos, s.height + r.lev, array_to_string(r.nodes[:s.pos // (8 ** r.lev)::BIGINT % 8], ''), array_to_string(r.nodes[s.pos // (8 ** r.lev)::BIGINT % 8 + 2:], '')
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN high_runs r ON r.run = s.pos // (8 ** (r.lev + 1))::BIGINT
), fold AS (
  SELECT lang, pos, 0 AS step, coalesce(other, leaf) AS node FROM placed
  UNION ALL
  SELECT f.lang, f.pos, f.step + 1, sha256(s.l || f.node || s.r) FROM fold f JOIN steps s ON f.lang IS NOT DISTINCT FROM s.lang AND f.pos = s.pos AND f.step = s.step
), ended AS (
  SELECT lang, pos, arg_max(node, step) AS folded_root FROM fold GROUP BY lang, pos
), proofs AS (
  SELECT lang, pos, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM steps GROUP BY lang, pos
)
SELECT p.doc_id, p.leaf, s.subroot, h.node AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = h.node AS verified, p.lang
FROM placed p
JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
JOIN high h ON h.n = 1
JOIN ended e ON p.lang IS NOT DISTINCT FROM e.lang AND p.pos = e.pos
LEFT JOIN proofs q ON p.lang IS NOT DISTINCT FROM q.lang AND p.pos = q.pos
"""


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts)
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), sized AS (
  SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS m FROM pieces
), placed AS (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized
), f AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.a * t.n // (l.f::HUGEINT * r.f)) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:c.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), starts AS (
  SELECT lang, m, f, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS i FROM f WHERE m > 2
), inner_ AS (
  SELECT lang, m, f, w, i, unnest(range(i + 1, m + 1)) AS j FROM starts
), within AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(f) AS f FROM inner_ WHERE j - i + 1 < m GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM lowest s LEFT JOIN within w ON w.lang = s.lang AND w.phrase = s.phrase WHERE w.f IS NULL OR 100 * w.f < 100 * s.a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
