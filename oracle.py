"""The registered queries as plain SQL over the same Parquet tables."""

from __future__ import annotations

import re

# Building blocks by name; a query names those it reads and gets their own needs too.
BLOCKS = {
    "v": """
        SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, n_regionkey AS r
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "g_pages": """
        SELECT DISTINCT p * 1024 + r AS sid, p AS id,
               'part_' || (CASE WHEN p % 10 = 1 THEN p - 1 ELSE p END)
               || (CASE WHEN p % 7 = 3 THEN '_r' || r ELSE '' END) AS title,
               'r' || r AS lang
        FROM v""",
    "g_links": """
        SELECT a.p * 1024 + a.r AS src, b.p * 1024 + b.r AS dst, 'r' || a.r AS lang
        FROM v a JOIN v b ON a.o = b.o AND a.n = b.n - 1
        UNION ALL
        SELECT p * 1024 + r, (p + CAST(1000000000 AS BIGINT)) * 1024 + r, 'r' || r FROM v WHERE o % 11 = 0 AND n = 1""",
    "brands": """
        SELECT DISTINCT p, r, 1000000000000 + CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS c
        FROM v JOIN part ON p = p_partkey""",
    "g_categories": """
        SELECT DISTINCT c * 1024 + r AS sid, c AS id,
               'brand_' || (c - 1000000000000) AS title, 'r' || r AS lang
        FROM brands""",
    "g_categorylinks": """
        SELECT p * 1024 + r AS src, c * 1024 + r AS dst, 'r' || r AS lang FROM brands""",
    "g_dump": """
        SELECT a.sid, b.lang AS tolang, a.title, a.lang
        FROM g_pages a JOIN (SELECT DISTINCT title, lang FROM g_pages) b
          ON a.title = b.title AND a.lang <> b.lang
        UNION ALL SELECT sid, other, 'lost_' || title, lang FROM g_others WHERE id % 19 = 2
        UNION ALL SELECT sid + CAST(1000000000 AS BIGINT) * 1024, lang, title, lang FROM g_others WHERE id % 23 = 4
        UNION ALL SELECT sid, lang, title, other FROM g_others WHERE id % 29 = 6
        UNION ALL SELECT sid, other, 'Talk:' || title, lang FROM g_others WHERE id % 31 = 8
        UNION ALL SELECT sid, 'r9', title, lang FROM g_others WHERE id % 37 = 1""",
    "g_others": """
        SELECT *, CASE WHEN lang = 'r0' THEN 'r1' ELSE 'r0' END AS other FROM g_pages""",
    "resolved": """
        SELECT d.sid AS src, p.sid AS dst, d.lang AS srclang, p.lang AS dstlang
        FROM g_dump d JOIN g_pages p ON d.title = p.title AND d.tolang = p.lang""",
    "consistent": """
        SELECT src, dst, srclang, dstlang FROM resolved JOIN g_pages ON src = sid AND srclang = lang""",
    "crossrows": """
        SELECT src AS v, srclang AS v_lang, dstlang AS lang, dst AS member FROM consistent
        UNION SELECT src, srclang, srclang, src FROM consistent
        UNION SELECT dst, dstlang, dstlang, dst FROM consistent
        UNION SELECT dst, dstlang, srclang, src FROM consistent""",
    "crosscount": """
        SELECT v, v_lang, lang, min(member) AS member, count(*) AS k
        FROM crossrows GROUP BY v, v_lang, lang""",
    "fixed": "SELECT v, v_lang, lang, member FROM crosscount WHERE k = 1",
    "uni": """
        SELECT * FROM g_pages WHERE sid IN (SELECT v FROM crosscount)""",
    "edges": """
        SELECT src, dst, count(*) AS n FROM g_links
        WHERE src IN (SELECT sid FROM uni) AND dst IN (SELECT sid FROM uni)
        GROUP BY src, dst""",
    "net1": "SELECT src AS ego, dst AS member, 1 AS step FROM edges",
    "net2": """
        SELECT ego, member, min(step) AS step FROM (
          SELECT * FROM net1
          UNION ALL SELECT ego, dst, 2 FROM net1 JOIN edges ON member = src)
        GROUP BY ego, member""",
    "net3": """
        SELECT ego, member, min(step) AS step FROM (
          SELECT * FROM net2
          UNION ALL SELECT ego, dst, 3 FROM net2 JOIN edges ON member = src)
        GROUP BY ego, member""",
    "translated": """
        SELECT DISTINCT ego, f.lang, f.member FROM net2 JOIN fixed f ON net2.member = f.v""",
    "queries": """
        SELECT title, min(sid) AS q FROM uni WHERE lang = 'r0' GROUP BY title""",
    "scope": "SELECT DISTINCT q, f.member AS ego FROM queries JOIN fixed f ON q = f.v",
    "linking": "SELECT DISTINCT src AS ego FROM edges",
    "cand_title": """
        SELECT DISTINCT q, src, dst FROM (
          SELECT s.q, f.member AS src, t.member AS dst
          FROM scope s JOIN fixed f ON s.ego = f.v AND f.lang <> f.v_lang
          JOIN translated t ON t.ego = s.ego AND t.lang = f.lang) c
        WHERE (q, src) IN (SELECT (q, ego) FROM scope)
          AND src IN (SELECT ego FROM linking)
          AND (src, dst) NOT IN (SELECT (src, dst) FROM edges)""",
    "cand_all": """
        SELECT DISTINCT 0 AS q, src, dst FROM (
          SELECT f.member AS src, t.member AS dst
          FROM fixed f JOIN translated t ON t.ego = f.v AND t.lang = f.lang
          WHERE f.lang <> f.v_lang) c
        WHERE src IN (SELECT ego FROM linking)
          AND (src, dst) NOT IN (SELECT (src, dst) FROM edges)""",
    "voices": """
        SELECT DISTINCT f.v AS ego, f.member AS hearer
        FROM fixed f JOIN translated t ON t.ego = f.v AND t.lang = f.lang
        WHERE f.lang <> f.v_lang AND f.member IN (SELECT ego FROM linking)""",
    # Induced links of each neighbourhood, their weights, and the increments by round.
    "inner_links": """
        SELECT a.ego, e.src, e.dst, e.n
        FROM net2 a JOIN edges e ON a.member = e.src
        JOIN net2 b ON b.ego = a.ego AND b.member = e.dst""",
    "shares": """
        SELECT i.ego, i.src, i.dst, i.n / d.deg AS share
        FROM inner_links i JOIN (
          SELECT ego, src, sum(n) AS deg FROM inner_links GROUP BY ego, src) d
          ON i.ego = d.ego AND i.src = d.src""",
    "increments": """
        SELECT ego, member AS v, 0 AS round, CAST(0.15 AS DOUBLE) AS delta FROM net2
        UNION ALL
        SELECT s.ego, s.dst, any_value(i.round) + 1, 0.85 * sum(i.delta * s.share)
        FROM increments i JOIN shares s ON i.ego = s.ego AND i.v = s.src
        WHERE i.delta > 0.01 GROUP BY s.ego, s.dst""",
    "ranks": """
        SELECT ego, v AS member, rank * count(*) OVER (PARTITION BY ego)
               / sum(rank) OVER (PARTITION BY ego) AS score
        FROM (SELECT ego, v, sum(delta) AS rank FROM increments GROUP BY ego, v)""",
    "both_links": """
        SELECT ego, src AS a, dst AS b, n FROM inner_links
        UNION ALL SELECT ego, dst, src, n FROM inner_links""",
    "unit_weights": "SELECT ego, member, CAST(1 AS DOUBLE) AS w FROM net2",
    "rpr_weights": "SELECT ego, member, 1 / score AS w FROM ranks",
}
HUB_ROUNDS = 10
for _round in range(HUB_ROUNDS):
    _before = f"hub{_round}"
    if _round == 0:
        BLOCKS["hub0"] = "SELECT ego, member, CAST(1 AS DOUBLE) AS h FROM net2"
    BLOCKS[f"hub{_round + 1}"] = f"""
        SELECT m.ego, m.member, coalesce(s.h, 1) AS h FROM net2 m LEFT JOIN (
          SELECT l.ego, l.a AS member, sum(l.n * x.h) AS h
          FROM both_links l JOIN {_before} x ON x.ego = l.ego AND x.member = l.b
          GROUP BY l.ego, l.a) s ON s.ego = m.ego AND s.member = m.member"""

# Hubs and authorities: each sum is scaled to length 1 within its neighbourhood.
for _round in range(HUB_ROUNDS):
    _hubs = f"khub{_round}"
    if _round == 0:
        BLOCKS["khub0"] = "SELECT ego, member, CAST(1 AS DOUBLE) AS s FROM net2"
    for _name, _known, _of, _to in (("kauth", _hubs, "src", "dst"), ("khub", f"kauth{_round + 1}", "dst", "src")):
        BLOCKS[f"{_name}{_round + 1}"] = f"""
            SELECT ego, member, s / sqrt(sum(s * s) OVER (PARTITION BY ego)) AS s FROM (
              SELECT l.ego, l.{_to} AS member, sum(l.n * x.s) AS s
              FROM inner_links l JOIN {_known} x ON x.ego = l.ego AND x.member = l.{_of}
              GROUP BY l.ego, l.{_to})"""

# Language links as a loaded dump has them: source keys by the line's language, no titles of namespaces.
DUMPED = {
    "resolved": """
        SELECT d.sid // 1024 * 1024 + CAST(substr(d.lang, 2) AS BIGINT) AS src, p.sid AS dst,
               d.lang AS srclang, p.lang AS dstlang
        FROM g_dump d JOIN g_pages p ON d.title = p.title AND d.tolang = p.lang
        WHERE NOT contains(d.title, ':')"""
}


def _similarity(pairs: str, weights: str) -> dict[str, str]:
    """Blocks for the similarity of the distinct (src, dst) of ``pairs``."""
    return {
        "norms": f"SELECT ego, sum(w * w) AS s FROM {weights} GROUP BY ego",
        "dots": f"""
            SELECT p.src, p.dst, sum(a.w * b.w) AS dot
            FROM (SELECT DISTINCT src, dst FROM {pairs}) p
            JOIN {weights} a ON a.ego = p.src
            JOIN {weights} b ON b.ego = p.dst AND b.member = a.member
            GROUP BY p.src, p.dst""",
        "scores": f"""
            SELECT p.src, p.dst, coalesce(d.dot, 0) / (x.s + y.s - coalesce(d.dot, 0)) AS score
            FROM (SELECT DISTINCT src, dst FROM {pairs}) p
            JOIN norms x ON x.ego = p.src JOIN norms y ON y.ego = p.dst
            LEFT JOIN dots d ON d.src = p.src AND d.dst = p.dst""",
    }


def _ranking(candidates: str, weights: str) -> dict[str, str]:
    return {
        "alive": f"""
            SELECT DISTINCT c.q, v.hearer AS ego
            FROM (SELECT DISTINCT q, dst FROM {candidates}) c JOIN voices v ON v.ego = c.dst""",
        "rankable": f"SELECT * FROM {candidates} WHERE (q, dst) IN (SELECT (q, ego) FROM alive)",
        **_similarity("rankable", weights),
        "ranked": f"""
            SELECT r.q, r.src, r.dst, s.score
            FROM rankable r JOIN scores s ON r.src = s.src AND r.dst = s.dst
            UNION ALL
            SELECT q, src, dst, 0 FROM {candidates}
            WHERE (q, src) NOT IN (SELECT (q, src) FROM rankable)""",
        "placed": """
            SELECT r.q, r.src, u.title, r.dst, u.lang,
                   CASE WHEN round(r.score, 4) < 1 THEN round(r.score, 4) END AS jaccard
            FROM ranked r JOIN uni u ON u.sid = r.src""",
        "numbered": """
            SELECT *, row_number() OVER (
                PARTITION BY q, lang ORDER BY jaccard DESC NULLS LAST, src, dst) AS rnk
            FROM placed""",
        "means": "SELECT q, src, avg(jaccard) AS mu FROM placed GROUP BY q, src",
    }


def _relating(weights: str) -> dict[str, str]:
    return {
        "asked": """
            SELECT DISTINCT a.title AS title_a, b.title AS title_b
            FROM edges JOIN uni a ON src = a.sid AND a.lang = 'r0'
            JOIN uni b ON dst = b.sid AND b.lang = 'r0'""",
        "sides": """
            SELECT DISTINCT w.title AS query, u.sid AS ego, u.title, u.lang
            FROM scope s JOIN voices v ON v.ego = s.ego
            JOIN scope t ON t.q = s.q AND t.ego = v.hearer
            JOIN queries w ON w.q = s.q JOIN uni u ON u.sid = t.ego""",
        "matched": """
            SELECT title_a || ' ' || title_b AS pair_id, x.ego AS src, x.title AS srctitle,
                   y.ego AS dst, y.title AS dsttitle, x.lang
            FROM asked JOIN sides x ON x.query = title_a
            JOIN sides y ON y.query = title_b AND y.lang = x.lang""",
        **_similarity("matched", weights),
    }


def _average(score: str) -> str:
    """The mean of four-digit decimals, itself rounded to eight digits, by whole numbers."""
    total, count = f"sum(CAST(round({score} * 10000) AS BIGINT))", f"count({score})"
    mean = f"(({total} * 20000 + {count}) // nullif(2 * {count}, 0)) / 100000000"
    return f"CAST({mean} AS FLOAT)::DOUBLE"


def _with(body: str, extra: dict[str, str] | None = None) -> str:
    blocks = {**BLOCKS, **(extra or {})}
    order: list[str] = []

    def need(text: str, inside: str = "") -> None:
        for name in blocks:
            if name != inside and name not in order and re.search(rf"\b(FROM|JOIN) {name}\b", text):
                need(blocks[name], name)
                order.append(name)

    need(body)
    heads = [
        f"{name} AS ({blocks[name]})" if name == "increments" else f"{name} AS MATERIALIZED ({blocks[name]})"
        for name in order
    ]
    recursive = "RECURSIVE " if "increments" in order else ""
    return (f"WITH {recursive}" + ",\n".join(heads) + "\n" if heads else "") + body


# The line formats.
FOUR = r"(\d+)\s+(.*?)\s+(.*?)\s+(.*?)\s?$"
IDS = r"(\d+)\s+(\d+)\s?$"
ID_ID = r"(\d+)\s+(.*?)\s+(\d+)\s+(.*?)\s?$"


def _parsed(lines: str, pattern: str, columns: str, where: str = "true") -> str:
    """Select ``columns`` over the lines, where ``gN`` stands for a group of the pattern."""
    text, where = (
        re.sub(r"\bg(\d)\b", lambda m: f"regexp_extract(line, '{pattern}', {m.group(1)})", part)
        for part in (columns, where)
    )
    return f"SELECT {text} FROM ({lines}) WHERE regexp_matches(line, '{pattern}') AND {where}"


def _sid(group: str, lang: str) -> str:
    return f"CAST({group} AS BIGINT) * 1024 + CAST(substr({lang}, 2) AS BIGINT)"


def _page_lines(table: str) -> str:
    return f"""
        SELECT id || (CASE id % 3 WHEN 0 THEN chr(9) WHEN 1 THEN '   ' ELSE ' ' END)
               || title || '  false false' AS line, lang FROM {table}
        UNION ALL SELECT id || ' ' || title, lang FROM {table} WHERE id % 13 = 5
        UNION ALL SELECT 'no page  here false', lang FROM {table} WHERE id % 13 = 5"""


LINK_LINES = """
    SELECT (src // 1024) || (CASE WHEN src % 2 = 0 THEN chr(9) ELSE '   ' END) || (dst // 1024) AS line,
           lang FROM g_links
    UNION ALL SELECT (src // 1024) || ' -> ' || (dst // 1024), lang FROM g_links WHERE src // 1024 % 13 = 5
    UNION ALL SELECT CAST(src // 1024 AS VARCHAR), lang FROM g_links WHERE src // 1024 % 13 = 5"""
CATEGORY_LINK_LINES = """
    SELECT (src // 1024) || ' page' || chr(9) || (dst // 1024) || '  category' AS line, lang
    FROM g_categorylinks
    UNION ALL SELECT (src // 1024) || ' page' || chr(9) || 'category', lang
    FROM g_categorylinks WHERE src // 1024 % 13 = 5"""
LANGUAGE_LINK_LINES = """
    SELECT (sid // 1024) || chr(9) || tolang || '  ' || title || ' ' || chr(9) || lang AS line
    FROM g_dump
    UNION ALL SELECT (sid // 1024) || chr(9) || tolang || '  ' || title || ' ' || chr(9) || 'r9'
    FROM g_dump WHERE sid // 1024 % 13 = 5
    UNION ALL SELECT (sid // 1024) || chr(9) || tolang FROM g_dump WHERE sid // 1024 % 13 = 5"""
PAGE_COLUMNS = f"{_sid('g1', 'lang')} AS sid, CAST(g1 AS BIGINT) AS id, g2 AS title, lang"
RANKED = 'SELECT q AS query_id, src AS "from", dst AS "to", CAST(score AS FLOAT)::DOUBLE AS score FROM ranked'


def oracle_sql() -> dict[str, str]:
    counts = " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS rows FROM {table}"
        for name, table in {
            "pages": "g_pages",
            "category_pages": "g_categories",
            "links": "g_links",
            "category_links": "g_categorylinks",
            "dump": "g_dump",
            "language_links": "resolved",
        }.items()
    )
    resolved = 'SELECT src AS "from", dst AS "to", srclang AS "fromLang", dstlang AS "toLang" FROM resolved'
    found = 'SELECT q AS query_id, src AS "from", dst AS "to" FROM'
    conflicts = "SELECT v, lang FROM crosscount WHERE k > 1"
    related = """
        SELECT pair_id, m.src AS "from", srctitle AS "fromTitle", m.dst AS "to",
               dsttitle AS "toTitle", lang, CAST(score AS FLOAT)::DOUBLE AS jaccard
        FROM matched m JOIN scores s ON s.src = m.src AND s.dst = m.dst
        ORDER BY pair_id, lang, "from", "to" """
    reports = {}
    for end, weights in (("", "unit_weights"), ("_rpr", "rpr_weights")):
        reports |= {
            f"rank_top_k{end}": _with("""
                SELECT q AS query_id, src AS "from", n.title AS from_title, dst AS "to",
                       b.title AS to_title, CAST(jaccard AS FLOAT)::DOUBLE AS jaccard, n.lang,
                       rnk AS rank
                FROM numbered n JOIN uni b ON b.sid = dst WHERE rnk <= 10""",
                _ranking("cand_title", weights)),
            f"rank_stats{end}": _with(f"""
                SELECT n.q AS query_id, n.src AS "from", title AS from_title, lang,
                       CAST(max(jaccard) AS FLOAT)::DOUBLE AS max_jaccard,
                       CAST(min(jaccard) AS FLOAT)::DOUBLE AS min_jaccard,
                       {_average("jaccard")} AS avg_jaccard,
                       CAST(stddev_samp(jaccard) AS FLOAT)::DOUBLE AS stddev_jaccard,
                       CAST(CASE WHEN max(jaccard) > min(jaccard)
                                 THEN avg((jaccard - mu) ** 3) / avg((jaccard - mu) ** 2) ** 1.5 END
                            AS FLOAT)::DOUBLE AS skewness_jaccard,
                       {_average("CASE WHEN rnk <= 10 THEN jaccard END")} AS avg_top_10,
                       {_average("CASE WHEN rnk > 10 THEN jaccard END")} AS avg_non_top_10
                FROM numbered n JOIN means m ON n.q = m.q AND n.src = m.src
                GROUP BY n.q, n.src, title, lang""", _ranking("cand_title", weights)),
        }
    return reports | {
        "load_corpus": _with(counts),
        "scan_pages": _with("""
            SELECT * FROM (
              SELECT *, 'normalpage' AS kind FROM g_pages
              UNION ALL SELECT *, 'categorypage' FROM g_categories)
            WHERE lang IN ('r1', 'r2', 'r3')"""),
        "scan_links": _with("""
            SELECT src AS "from", dst AS "to", lang AS "fromLang", lang AS "toLang", 'interlink' AS kind
            FROM g_links WHERE lang IN ('r1', 'r2', 'r3')"""),
        "scan_language_links": _with(
            f"{resolved} WHERE srclang IN ('r1', 'r2', 'r3') AND dstlang IN ('r1', 'r2', 'r3')"
        ),
        "parse_pages": _with(_parsed(_page_lines("g_pages"), FOUR, PAGE_COLUMNS)),
        "parse_category_pages": _with(_parsed(_page_lines("g_categories"), FOUR, PAGE_COLUMNS)),
        "parse_pagelinks": _with(_parsed(
            LINK_LINES, IDS,
            f"""{_sid('g1', 'lang')} AS "from", {_sid('g2', 'lang')} AS "to",
                lang AS "fromLang", lang AS "toLang" """)),
        "parse_categorylinks": _with(_parsed(
            CATEGORY_LINK_LINES, ID_ID,
            f"""{_sid('g1', 'lang')} AS "from", {_sid('g3', 'lang')} AS "to",
                lang AS "fromLang", lang AS "toLang" """)),
        "parse_langlinks": _with(_parsed(
            LANGUAGE_LINK_LINES, FOUR,
            f"""{_sid('g1', 'g4')} AS sid, g2 AS "toLang", g3 AS title, g4 AS lang""",
            "g4 IN ('r0', 'r1', 'r2', 'r3', 'r4') AND NOT contains(g3, ':')")),
        "parse_raw_langlinks": _with(_parsed(
            LANGUAGE_LINK_LINES, FOUR,
            'CAST(g1 AS BIGINT) AS sid, g2 AS "toLang", g3 AS title, g4 AS lang')),
        "jvm_keys": _with("""
            SELECT id, lang, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS jvm_key
            FROM (SELECT id, lang, list_reduce(
                    list_transform(string_split(id || '-' || lang, ''), lambda c: ascii(c)::BIGINT),
                    lambda a, x: (a * 31 + x) & 4294967295) AS h
                  FROM g_pages)"""),
        "resolve_language_links": _with(resolved),
        "cross_net": _with("SELECT v, lang, member FROM crossrows"),
        "cross_net_repaired": _with("SELECT v, lang, member FROM fixed"),
        "anomalous_pages": _with("SELECT DISTINCT v AS sid FROM crosscount WHERE k > 1"),
        "anomalies": _with(f"""
            SELECT v AS "from", lang, member AS "to" FROM crossrows
            WHERE (v, lang) IN ({conflicts.replace('v, lang', '(v, lang)', 1)})"""),
        "anomaly_report": _with(f"""
            SELECT c.v AS "from", a.title AS from_title, a.lang AS from_lang,
                   b.lang AS to_lang, c.member AS "to", b.title AS to_title
            FROM crossrows c JOIN uni a ON a.sid = c.v JOIN uni b ON b.sid = c.member
            WHERE (c.v, c.lang) IN ({conflicts.replace('v, lang', '(v, lang)', 1)})
            ORDER BY from_lang, "from", to_lang, "to" """),
        "universe": _with("SELECT * FROM uni"),
        "universe_view": _with("""
            SELECT sid, any_value(title) AS title, any_value(u.lang) AS lang,
                   coalesce(string_agg(f.lang, ',' ORDER BY f.lang), '') AS languages,
                   coalesce(string_agg(CAST(f.member AS VARCHAR), ',' ORDER BY f.member), '') AS members
            FROM uni u LEFT JOIN fixed f ON u.sid = f.v GROUP BY sid"""),
        "valid_links": _with("""
            SELECT src AS "from", dst AS "to", lang AS "fromLang", lang AS "toLang" FROM g_links
            WHERE src IN (SELECT sid FROM uni) AND dst IN (SELECT sid FROM uni)"""),
        "edge_weights": _with('SELECT src AS "from", dst AS "to", n FROM edges'),
        "ego_net_1": _with("SELECT * FROM net1"),
        "ego_net_2": _with("SELECT * FROM net2"),
        "ego_net_3": _with("SELECT * FROM net3"),
        "translated_net": _with("SELECT * FROM translated"),
        "candidates_everywhere": _with(f"{found} cand_all"),
        "candidates_by_title": _with(f"{found} cand_title"),
        "recommendation_report": _with("""
            SELECT q AS query_id, src AS "from", a.title AS from_title,
                   dst AS "to", b.title AS to_title, a.lang
            FROM cand_title JOIN uni a ON a.sid = src JOIN uni b ON b.sid = dst
            ORDER BY query_id, a.lang, "from", "to" """),
        "pagerank_ego": _with("SELECT ego, member, CAST(score AS FLOAT)::DOUBLE AS score FROM ranks"),
        "reciprocal_vectors": _with("SELECT ego, member, CAST(w AS FLOAT)::DOUBLE AS weight FROM rpr_weights"),
        "hits_unit": _with("SELECT ego, member, w AS weight FROM unit_weights"),
        "hits_kleinberg": _with(f"""
            SELECT m.ego, m.member, CAST(coalesce(h.s, 0) AS FLOAT)::DOUBLE AS hub,
                   CAST(coalesce(a.s, 0) AS FLOAT)::DOUBLE AS authority
            FROM net2 m LEFT JOIN khub{HUB_ROUNDS} h ON h.ego = m.ego AND h.member = m.member
            LEFT JOIN kauth{HUB_ROUNDS} a ON a.ego = m.ego AND a.member = m.member""", {
            "hubs": f"SELECT 1 FROM khub{HUB_ROUNDS}", "auths": f"SELECT 1 FROM kauth{HUB_ROUNDS}"}),
        "plugin_measure": _with("""
            SELECT ego, dst AS member, CAST(sum(n) / sum(sum(n)) OVER (PARTITION BY ego) AS FLOAT)::DOUBLE AS weight
            FROM inner_links GROUP BY ego, dst"""),
        "plugin_lines": _with("""
            SELECT sid, title, id % 2 = 0 AS flagged, lang FROM g_pages
            WHERE id % 17 <> 3 AND title <> 'part_10'"""),
        "map_functions": _with("""
            SELECT c.v AS sid, count(*) FILTER (k = 1) AS single, count(*) FILTER (k > 1) AS several,
                   max(k) > 1 AS anomalous,
                   max(member) FILTER (k = 1 AND c.lang = CASE WHEN v_lang = 'r0' THEN 'r1' ELSE 'r0' END) AS counterpart,
                   0 AS unknown, true AS has_itself,
                   bool_or(member = c.v + 1 OR most = c.v + 1) AS has_next, 1 AS merged,
                   0.5 * sum(CASE WHEN k > 1 THEN 2 ELSE 1 END) AS halves
            FROM crosscount c JOIN (SELECT v, lang, max(member) AS most FROM crossrows GROUP BY v, lang) g
              ON g.v = c.v AND g.lang = c.lang
            GROUP BY c.v, v_lang"""),
        "candidates_half_absent": _with(f"{found} cand_title"),
        "report_text": _with("""
            SELECT q AS query_id, src AS "from", a.title AS from_title, dst AS "to",
                   CASE dst % 7 WHEN 0 THEN b.title || chr(9) || 'tab'
                                WHEN 1 THEN '"' || b.title || chr(92) || 't' || chr(92) || 'N' || chr(10)
                                WHEN 2 THEN '' WHEN 3 THEN NULL ELSE b.title END AS to_title, a.lang
            FROM cand_title JOIN uni a ON a.sid = src JOIN uni b ON b.sid = dst"""),
        "store_runs": _with(f"{found} cand_title"),
        "store_pending": _with("""
            SELECT q AS query_id, src AS "from", dst AS "to", q // 1024 % 3 <> 0 AS second FROM cand_title"""),
        "page_status": _with("""
            SELECT u.sid, any_value(id) AS id, any_value(title) AS title, any_value(u.lang) AS lang,
                   CASE WHEN coalesce(bool_or(q // 1024 % 3 < 2), false) THEN 2 ELSE 0 END AS step,
                   coalesce(bool_or(q // 1024 % 3 = 1), false) AS ranked
            FROM uni u LEFT JOIN cand_title ON src = u.sid GROUP BY u.sid"""),
        "stored_universe": _with("SELECT * FROM uni", DUMPED),
        "stored_anomalies": _with(f"""
            SELECT v AS "from", lang, member AS "to" FROM crossrows
            WHERE (v, lang) IN ({conflicts.replace('v, lang', '(v, lang)', 1)})""", DUMPED),
        "cross_link_job": _with(f"""
            SELECT 'universe' AS name, sid, lang, NULL AS "to" FROM uni
            UNION ALL
            SELECT 'anomalies', v, lang, member FROM crossrows
            WHERE (v, lang) IN ({conflicts.replace('v, lang', '(v, lang)', 1)})"""),
        "hits_hub": _with(f"SELECT ego, member, h AS score FROM hub{HUB_ROUNDS}"),
        "rank_everywhere_hits": _with(RANKED, _ranking("cand_all", "unit_weights")),
        "rank_everywhere_rpr": _with(RANKED, _ranking("cand_all", "rpr_weights")),
        "rank_by_title_hits": _with(RANKED, _ranking("cand_title", "unit_weights")),
        "rank_by_title_rpr": _with(RANKED, _ranking("cand_title", "rpr_weights")),
        "relatedness_hits": _with(related, _relating("unit_weights")),
        "relatedness_rpr": _with(related, _relating("rpr_weights")),
        "relatedness_repeated": _with(related, _relating("rpr_weights")),
        "dump_links": _with("""
            SELECT src AS "from", dst AS "to", lang AS "fromLang", lang AS "toLang"
            FROM g_links WHERE lang IN ('r1', 'r2', 'r3')"""),
        "dump_language_links": _with("""
            SELECT d.sid // 1024 * 1024 + CAST(substr(d.lang, 2) AS BIGINT) AS "from", p.sid AS "to",
                   d.lang AS "fromLang", p.lang AS "toLang"
            FROM g_dump d JOIN g_pages p ON d.title = p.title AND d.tolang = p.lang"""),
        "dump_unresolved": _with("""
            SELECT sid // 1024 * 1024 + CAST(substr(lang, 2) AS BIGINT) AS sid, tolang AS "toLang",
                   title, lang
            FROM g_dump WHERE lang IN ('r1', 'r2', 'r3') AND NOT contains(title, ':')"""),
    }
