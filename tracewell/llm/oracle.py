"""SQL (DuckDB) of operators 11 to 13, by other ways than theirs: plain ranking, one row for each node, recursion."""

_CRC_TABLE = "SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))"


def _crc(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, with the table ``t``."""
    at = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex({text}), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce({at}, lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)]), 4294967295), 4294967295)"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({_lower(f"coalesce({text}, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""


def _leaf(text: str) -> str:
    parts = (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256(concat({', '.join(parts)}))"


MERKLE = f"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
 l AS (SELECT lang, doc_id, {_leaf("text")} AS leaf, CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(_lower("text"))} END AS changed FROM documents, tab),
 l0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
 a(lang, level, pos, n, digest) AS (SELECT lang, 0, pos, n, leaf FROM l0 UNION ALL SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM a WHERE n > 1 GROUP BY lang, level, n, pos // 8),
 s AS (SELECT lang, digest AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
 b(level, pos, n, digest) AS (SELECT 0, pos, n, subroot FROM s UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY level, n, pos // 8),
 r AS (SELECT digest AS root FROM b WHERE n = 1),
 pa AS (SELECT DISTINCT a.lang, a.level, a.pos, coalesce((SELECT string_agg(x.digest, '' ORDER BY x.pos) FROM a x WHERE x.lang IS NOT DISTINCT FROM a.lang AND x.level = a.level AND x.pos // 8 = a.pos // 8 AND x.pos < a.pos), '') AS lefts,
   coalesce((SELECT string_agg(x.digest, '' ORDER BY x.pos) FROM a x WHERE x.lang IS NOT DISTINCT FROM a.lang AND x.level = a.level AND x.pos // 8 = a.pos // 8 AND x.pos > a.pos), '') AS rights FROM a WHERE a.n > 1),
 pb AS (SELECT b.level, b.pos, coalesce((SELECT string_agg(x.digest, '' ORDER BY x.pos) FROM b x WHERE x.level = b.level AND x.pos // 8 = b.pos // 8 AND x.pos < b.pos), '') AS lefts,
   coalesce((SELECT string_agg(x.digest, '' ORDER BY x.pos) FROM b x WHERE x.level = b.level AND x.pos // 8 = b.pos // 8 AND x.pos > b.pos), '') AS rights FROM b WHERE b.n > 1),
 up AS (SELECT lang, pos, 0 AS level, pos AS at, 0 AS tree, changed, leaf, coalesce(changed, leaf) AS digest, '' AS proof, 0 AS done FROM l0 UNION ALL
   SELECT up.lang, up.pos, CASE WHEN pa.level IS NULL AND up.tree = 0 THEN 0 ELSE up.level + 1 END, CASE WHEN pa.level IS NOT NULL THEN up.at // 8 WHEN up.tree = 0 THEN s.pos ELSE up.at // 8 END, CASE WHEN pa.level IS NULL THEN 1 ELSE 0 END, up.changed, up.leaf,
     CASE WHEN pa.level IS NOT NULL THEN sha256(pa.lefts || up.digest || pa.rights) WHEN up.tree = 0 OR pb.level IS NULL THEN up.digest ELSE sha256(pb.lefts || up.digest || pb.rights) END,
     CASE WHEN pa.level IS NOT NULL THEN up.proof || pa.lefts || pa.rights WHEN up.tree = 0 OR pb.level IS NULL THEN up.proof ELSE up.proof || pb.lefts || pb.rights END, CASE WHEN up.tree = 1 AND pb.level IS NULL THEN 1 ELSE 0 END
   FROM up JOIN s ON s.lang IS NOT DISTINCT FROM up.lang LEFT JOIN pa ON up.tree = 0 AND pa.lang IS NOT DISTINCT FROM up.lang AND pa.level = up.level AND pa.pos = up.at LEFT JOIN pb ON up.tree = 1 AND pb.level = up.level AND pb.pos = up.at WHERE up.done = 0)
SELECT l0.doc_id, l0.leaf, s.subroot, r.root, sha256(up.proof) AS proof_sha256, up.digest AS folded_root, up.digest = r.root AS verified,
 CAST(CASE WHEN l0.changed IS NULL THEN 0 ELSE 1 + s.height + (SELECT max(level) FROM b) END AS INTEGER) AS copied
FROM up JOIN l0 ON l0.lang IS NOT DISTINCT FROM up.lang AND l0.pos = up.pos JOIN s ON s.lang IS NOT DISTINCT FROM up.lang, r WHERE up.done = 1"""

RESAMPLING = f"""
WITH tab AS ({_CRC_TABLE}),
 d AS (SELECT doc_id, row_number() OVER () AS k, {_words("text")} AS ws FROM documents),
 b AS (SELECT {_words("text")} AS ws FROM benchmark),
 df AS (SELECT k, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM d),
 bf AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM b),
 h AS (SELECT f, {_crc("f")} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), tab),
 s AS (SELECT bucket, count(*) AS s FROM df JOIN h USING (f) GROUP BY bucket),
 t AS (SELECT bucket, count(*) AS t FROM bf JOIN h USING (f) GROUP BY bucket),
 al AS (SELECT (SELECT count(*) FROM df) AS all_s, (SELECT count(*) FROM bf) AS all_t),
 g AS (SELECT bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (all_s + 10000) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (all_t + 10000)))) AS gain FROM range(10000) x(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), al),
 w AS (SELECT k, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY k),
 c AS (SELECT d.doc_id, len(ws) >= 20 AS may, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (k)),
 o AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY may) AS n FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 25 * n // 100 THEN place END AS rank FROM o"""
