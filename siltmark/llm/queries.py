"""The registered queries of this package, with their SQL oracles for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm import langid, linededup, merkle, mixing, neardup, packing, pii, quality, substr, suffixtree, tokenstore, topk
from siltmark.plans.session import new_path


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.identify(docs, langid.fit(docs, ~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenstore.write_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return tokenstore.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return sequences.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(_table(spark, sf_dir, "documents", "doc_id", "lang", "text"))
    return found.drop("lang")


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.without_boilerplate(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return cleaned.select("doc_id", "text", F.col("_sm_lines").alias("n_lines"), F.col("_sm_removed").alias("n_removed"))


OP6 = """
WITH l AS (
  SELECT doc_id, source, i, lines[i] AS line, trim(lines[i], E' \\t\\r') AS bare
  FROM (SELECT doc_id, source, string_split(text, E'\\n') AS lines FROM documents), LATERAL unnest(range(1, len(lines) + 1)) u(i)
), b AS (
  SELECT bare FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce(source, chr(1) || 'null')) >= 5
), k AS (
  SELECT l.doc_id, string_agg(l.line, E'\\n' ORDER BY i) FILTER (b.bare IS NULL) AS kept, count(*)::BIGINT AS n, count(b.bare)::BIGINT AS r
  FROM l LEFT JOIN b ON l.bare = b.bare GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN k.r > 0 THEN coalesce(k.kept, '') ELSE d.text END AS text, coalesce(k.n, 0)::BIGINT AS n_lines, coalesce(k.r, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


OP7 = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


OP8 = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM d GROUP BY source
), c AS (
  SELECT *, [5.0, 2.0, 1.0][(rnk % 3) + 1]::DOUBLE AS w, source_size::DOUBLE * 3 AS cap FROM s
), r(i, source, rnk, source_size, w, cap, capped, level) AS (
  SELECT 0, source, rnk, source_size, w, cap, false, 0::DOUBLE FROM c
  UNION ALL
  SELECT i + 1, source, rnk, source_size, w, cap, capped OR cap < x * w, x FROM (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / sum(w) FILTER (NOT capped) OVER () AS x FROM r WHERE i < 40
  )
), t AS (
  SELECT source, rnk, source_size, CASE WHEN capped THEN cap ELSE level * w END AS target FROM r WHERE i = 40
), p AS (
  SELECT d.doc_id, d.size, d.k, t.rnk, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT p.*, (copy * source_size + served)::DOUBLE / target AS fin FROM p, (VALUES (0), (1), (2)) x(copy) WHERE size > 0 AND target > 0
), g AS (
  SELECT doc_id, rnk, k, size, sum(size) OVER (ORDER BY fin, rnk, k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sent FROM f
), h AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM g WHERE sent <= (SELECT sum(size) FROM d) GROUP BY doc_id
)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(h.taken, 0)::BIGINT AS taken FROM p LEFT JOIN h USING (doc_id)
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find_pii(_table(spark, sf_dir, "documents", "doc_id", "text")))


def op10_substr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.shared_passages(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_pst(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    scored = suffixtree.score_texts(_table(spark, sf_dir, "documents", "doc_id", "text"), train)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", *_LEAF_COLUMNS)
    shorter = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.when(shorter != F.col("text"), merkle.leaf(*map(F.col, _LEAF_COLUMNS[:-1]), shorter))
    rows = merkle.manifest(docs, _LEAF_COLUMNS, also={"tampered": tampered})
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(text: str) -> str:
    values = [*_LEAF_COLUMNS[:-1], text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


#: CRC-32 (polynomial EDB88320) of a decimal doc_id bit by bit, before its final inversion, which makes even ones odd.
_SQL_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"
OP12 = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf, CASE WHEN {_SQL_CRC} & 1 = 1 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS tampered FROM documents
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l
), t(lvl, source, i, h) AS (
  SELECT 0, source, i, leaf FROM p
  UNION ALL
  SELECT lvl + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM t) WHERE n > 1 GROUP BY lvl, source, i // 3
), s AS (
  SELECT source, max(lvl) AS top, arg_max(h, lvl) AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM t GROUP BY source
), u(lvl, i, h) AS (
  SELECT 0, i, subroot FROM s
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY lvl, i // 3
), nodes AS (
  SELECT source, lvl, i, h, false AS upper FROM t UNION ALL SELECT NULL, lvl, i, h, true FROM u
), steps AS (
  SELECT p.doc_id, p.i AS leaf_i, s.source, k, k >= s.top AS upper, CASE WHEN k < s.top THEN k ELSE k - s.top END AS lvl, CASE WHEN k < s.top THEN p.i // (3 ** k)::BIGINT ELSE s.i // (3 ** (k - s.top))::BIGINT END AS node
  FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source, LATERAL unnest(range(0, s.top + (SELECT max(lvl) FROM u))) x(k)
), runs AS (
  SELECT e.source, e.leaf_i, e.k, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < e.node), '') AS before, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > e.node), '') AS after
  FROM steps e JOIN nodes n ON n.upper = e.upper AND n.lvl = e.lvl AND n.i // 3 = e.node // 3 AND (e.upper OR n.source IS NOT DISTINCT FROM e.source) GROUP BY ALL
), proofs AS (
  SELECT source, leaf_i, sha256(string_agg(before || after, '' ORDER BY k)) AS proof FROM runs GROUP BY ALL
), f(source, leaf_i, k, h) AS (
  SELECT source, i, 0, tampered FROM p
  UNION ALL
  SELECT f.source, f.leaf_i, f.k + 1, sha256(r.before || f.h || r.after) FROM f JOIN runs r ON r.source IS NOT DISTINCT FROM f.source AND r.leaf_i = f.leaf_i AND r.k = f.k
), g AS (
  SELECT source, leaf_i, arg_max(h, k) AS folded FROM f GROUP BY ALL
), root AS (SELECT arg_max(h, lvl) AS root FROM u)
SELECT p.doc_id, p.leaf, s.subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source JOIN g ON g.source IS NOT DISTINCT FROM p.source AND g.leaf_i = p.i
LEFT JOIN proofs ON proofs.source IS NOT DISTINCT FROM p.source AND proofs.leaf_i = p.i, root
"""


QUERIES = {"op12_merkle": op12_merkle, "op11_pst": op11_pst, "op10_substr": op10_substr, "op3_tokenstore": op3_tokenstore, "op9_pii": op9_pii, "op6_linededup": op6_linededup, "op5_quality": op5_quality, "op1_langid": op1_langid, "op2_simhash": op2_simhash, "op4_packing": op4_packing, "op7_topk": op7_topk, "op8_mixing": op8_mixing}
ORACLES = {"op6_linededup": OP6, "op7_topk": OP7, "op8_mixing": OP8, "op12_merkle": OP12}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
