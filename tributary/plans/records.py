"""Relational operators on records: first-seen dates, predicates on sources and versions, lineage, list checks, and scalar formats."""

from __future__ import annotations

from tributary.plans.dialect import Query

#: An identifier in one of the three spellings that articles have: yymm.number, archive/yymmnumber, and a bare number without a date.
NAMED = """SELECT aid, CASE aid % 3 WHEN 0 THEN concat('2401.', lpad(CAST(aid AS STRING), 5, '0')) WHEN 1 THEN concat('hep-th/9912', lpad(CAST(aid % 1000 AS STRING), 3, '0'))
    ELSE CAST(aid AS STRING) END AS name FROM article"""
#: Sources of a category that is no longer in use, and the one that holds its articles now.
RETIRED = "CASE source WHEN 'src0' THEN 'src1' WHEN 'src7' THEN 'src2' ELSE source END"

QUERIES = {
    "first_seen": Query(
        "SELECT r.aid, coalesce(min(CASE WHEN a.kind IN ('view', 'click') THEN a.t END), min(a.t), @NOW) AS seen FROM article r LEFT JOIN act a ON a.aid = r.aid GROUP BY r.aid"
    ),
    "source_sets": Query(
        """SELECT id, CASE WHEN kind IN ('view', 'click') THEN 1 ELSE 0 END AS from_main, CASE WHEN kind = 'signup' THEN 1 ELSE 0 END AS from_mail,
        CASE WHEN kind IN ('view', 'click', 'signup') THEN 1 ELSE 0 END AS from_mix FROM act"""
    ),
    "article_months": Query(
        """SELECT n.aid, CASE WHEN yymm = '' THEN coalesce(CAST(year(d.day) * 100 + month(d.day) AS BIGINT), 0)
        ELSE CAST(yymm AS BIGINT) + CASE WHEN CAST(yymm AS BIGINT) >= 9100 THEN 190000 ELSE 200000 END END AS month FROM n LEFT JOIN d ON n.aid = d.aid""",
        f"""n AS (SELECT aid, @RE1(name, '^(?:[a-z-]+/)?([0-9]{{2}}[01][0-9])(?:[.][0-9]+|[0-9]{{3}})$') AS yymm FROM ({NAMED}) x),
        d AS (SELECT aid, CAST(min(t) AS DATE) AS day FROM act GROUP BY aid)""",
    ),
    "version_filter": Query("SELECT id, aid FROM (SELECT id, aid, CASE WHEN id % 4 = 0 THEN NULL ELSE id % 4 END AS version FROM act) x WHERE version IN (0, 1) OR version IS NULL"),
    "not_stored": Query("SELECT r.aid FROM article r WHERE r.body IS NULL OR NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.aid)"),
    "missing_similarities": Query("SELECT r.aid, CASE WHEN n.aid IS NULL THEN 1 ELSE 0 END AS missing FROM article r JOIN (SELECT DISTINCT aid FROM act) a ON a.aid = r.aid LEFT JOIN norm n ON n.aid = r.aid"),
    "lineage": Query(
        "SELECT x.conv_id, x.turn, y.turn AS from_turn, length(y.text) AS from_chars FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn - 1"
    ),
    # shares against counts taken from the tokens themselves: postings that lose or double a token show
    "theta_check": Query(
        "SELECT s.cat, count(*) AS n, sum(CASE WHEN abs(theta * (tokens + 0.01 * size) - 0.01 - c) > 0.000001 THEN 1 ELSE 0 END) AS wrong, round(sum(theta), 6) AS total FROM s JOIN t ON s.cat = t.cat GROUP BY s.cat",
        """c AS (SELECT r.cat, p.term, CAST(sum(tf) AS DOUBLE) AS c FROM posting p JOIN article r ON p.aid = r.aid GROUP BY r.cat, p.term),
        s AS (SELECT cat, term, c, (0.01 + c) / @EXACT(0.01 + c, PARTITION BY cat) AS theta FROM c),
        t AS (SELECT r.cat, count(*) AS tokens, count(DISTINCT term) AS size FROM token k JOIN article r ON k.aid = r.aid WHERE length(term) > 2 AND NOT term < 'a' GROUP BY r.cat)""",
    ),
    "list_ages": Query("SELECT uid, aid, day, CAST(row_number() OVER (PARTITION BY uid, aid ORDER BY day) - 1 AS INT) AS age FROM (SELECT DISTINCT uid, aid, CAST(t AS DATE) AS day FROM act) x"),
    "truncated_lists": Query(
        "SELECT uid, aid, CAST(rn AS INT) AS rn, CASE WHEN most > 20 THEN 1 ELSE 0 END AS may_go_on FROM (SELECT uid, aid, rn, max(rn) OVER (PARTITION BY uid) AS most FROM ranked_page WHERE rn <= 21) x WHERE rn <= 20"
    ),
    "unique_lists": Query("SELECT sid, CASE WHEN count(aid) = count(DISTINCT aid) THEN 1 ELSE 0 END AS is_unique FROM act GROUP BY sid"),
    "idf_by_fields": Query(
        "SELECT term, round(1 + ln((SELECT n FROM n_docs) * 2 / CAST(1 + total AS DOUBLE)), 8) AS idf FROM (SELECT term, count(*) AS total FROM f GROUP BY term) x",
        """f AS (SELECT DISTINCT aid, 'body' AS field, term FROM token WHERE term <> '' UNION ALL SELECT DISTINCT aid, 'category' AS field, term FROM (SELECT aid, @TERMS(cat) AS term FROM article) y)""",
    ),
    "running_softmax": Query(
        """SELECT uid, aid, round(exp(x - top) / (exp(-top) + sum(exp(x - top)) OVER (PARTITION BY uid)), 9) AS p
        FROM (SELECT uid, aid, x, greatest(0, max(x) OVER (PARTITION BY uid)) AS top FROM (SELECT uid, aid, score / 1000.0 AS x FROM page_score) y) w"""
    ),
    "grid_cells": Query(
        "SELECT aid, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(a * (a + 1) / 2 + b AS BIGINT) AS cell FROM (SELECT aid, @RINT(n / 4.0) AS a, @RINT(n / 8.0) AS b FROM (SELECT aid, count(*) AS n FROM act GROUP BY aid) y) x"
    ),
    "category_alias": Query(f"SELECT DISTINCT source, {RETIRED} AS now FROM documents"),
    "category_levels": Query(
        "SELECT r.aid, r.cat, c.active, c.major FROM article r JOIN c ON r.cat = c.cat",
        f"c AS (SELECT DISTINCT concat(lang, '.', source) AS cat, concat(lang, '.', {RETIRED}) AS active, lang AS major FROM documents)",
    ),
    "short_names": Query("SELECT p_partkey, CASE WHEN @RE1(p_name, '^([^ ]+ [^ ]+) [^ ]') <> '' THEN concat(@RE1(p_name, '^([^ ]+ [^ ]+) [^ ]'), ' et al.') ELSE p_name END AS short FROM part"),
    "rewritten_links": Query("""SELECT page_id, @REALL(html, '(href|action|src)="/', '@BACK1="https://mirror.example.org/') AS html FROM pages"""),
    "clock_text": Query(
        """SELECT id, concat(CAST(s div 3600 AS STRING), ':', lpad(CAST(s % 3600 div 60 AS STRING), 2, '0'), ':', lpad(CAST(s % 60 AS STRING), 2, '0')) AS clock,
        CASE WHEN s < 3600 THEN 'less than an hour ago' WHEN s < 86400 THEN concat(CAST(s div 3600 AS STRING), ' hours ago') ELSE concat(CAST(s div 86400 AS STRING), ' days ago') END AS ago
        FROM (SELECT id, @EPOCH(@NOW) - @EPOCH(t) AS s FROM act) x WHERE s >= 0"""
    ),
    "printable_kinds": Query("SELECT DISTINCT kind, concat(upper(substr(kind, 1, 1)), replace(substr(kind, 2), '_', ' ')) AS label FROM act"),
}
