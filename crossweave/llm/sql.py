"""SQL for DuckDB of the queries that it can express."""

from __future__ import annotations

# The rules of secret_scan.RULES with case spelled out where it is ignored: (kind, pattern, group, least).
SECRETS = (
    (
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("pem", "-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", 0, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
)


def _matches(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
        SELECT n, {number} AS rank, '{kind}' AS kind, found[i] AS piece, part[i] AS part,
               list_sum(list_transform(gaps[1:i], lambda g: length(g)))
               + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0) AS start
        FROM (SELECT n, regexp_extract_all(t, '{quoted}') AS found,
                     regexp_extract_all(t, '{quoted}', {group}) AS part,
                     string_split_regex(t, '{quoted}') AS gaps
              FROM texts WHERE regexp_matches(t, '{quoted}')), range(1, len(found) + 1) AS r(i)
        WHERE length(part[i]) >= {least}"""


OP10 = f"""
    WITH texts AS (
      SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
    spans AS ({" UNION ALL ".join(_matches(i, *rule) for i, rule in enumerate(SECRETS))}),
    told AS (
      SELECT n, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
             count(*) FILTER (rank = 2) AS n_hex,
             string_agg(kind || ':' || start || ':' || (start + length(piece)), ',' ORDER BY start, rank)
               FILTER (rank < 3) AS base,
             string_agg(kind || ':' || start || ':' || (start + length(piece)), ',' ORDER BY start, rank)
               AS spans
      FROM spans GROUP BY n)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
           coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans
    FROM texts LEFT JOIN told USING (n)"""

OP4 = """
    WITH v AS (
      SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id, max(CAST(list_dot_product(a.q, b.q) AS BIGINT)) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
        WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id, b.vec_id))
    WHERE rank <= 5"""

# Components by lowering each document's label to its neighbours' least.
OP3 = r"""
    WITH RECURSIVE words AS (
      SELECT row_number() OVER () AS n, doc_id,
             list_filter(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
      FROM documents),
    shingles AS MATERIALIZED (
      SELECT DISTINCT n, CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END AS s
      FROM words, range(1, greatest(len(w) - 3, 1) + 1) AS r(i) WHERE len(w) > 0),
    sizes AS MATERIALIZED (SELECT n, count(*) AS k FROM shingles GROUP BY n),
    links AS MATERIALIZED (
      SELECT a, b FROM (
        SELECT x.n AS a, y.n AS b, count(*) AS common
        FROM shingles x JOIN shingles y ON x.s = y.s AND x.n <> y.n GROUP BY x.n, y.n)
      JOIN sizes p ON p.n = a JOIN sizes q ON q.n = b
      WHERE 100 * common >= 85 * (p.k + q.k - common)),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT w.doc_id, coalesce(any_value(k), 0) AS n_shingles,
           coalesce(least(w.doc_id, min(o.doc_id)), w.doc_id) AS component_id
    FROM words w LEFT JOIN sizes USING (n) LEFT JOIN reach r ON r.a = w.n LEFT JOIN words o ON o.n = r.b
    GROUP BY w.n, w.doc_id"""

OP13 = """
    WITH v AS (
      SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    rows AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, label, q) AS n, * FROM v),
    scored AS MATERIALIZED (
      SELECT a.n AS a, b.n AS b, a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
             CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
      WHERE a.vec_id % 100 = 0),
    positive AS (
      SELECT * FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id,
           CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id, s.b) AS INTEGER) AS rank,
           s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM positive p JOIN scored s ON p.a = s.a AND NOT s.same
     AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
    QUALIFY rank <= 10"""

SQL: dict[str, str] = {
    "op3_ngram_join": OP3,
    "op4_topk_search": OP4,
    "op10_secret_scan": OP10,
    "op13_hard_negatives": OP13,
}
