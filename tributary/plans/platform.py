"""More relational operators of the platform: identifiers, links, predicates on terms and categories, feedback, candidates, schedules, exports."""

from __future__ import annotations

from tributary.plans.dialect import Query

#: Words that never count as terms.
STOP = "('the', 'and', 'for', 'that', 'with', 'are', 'was', 'this', 'from', 'der', 'die', 'und', 'les', 'des', 'que', 'los')"

QUERIES = {
    # identifiers, links, categories
    "flexible_ids": Query(
        """SELECT id, name, CASE WHEN @RE1(name, '^([0-9]+)$') <> '' THEN 'docno' WHEN name LIKE 'UU:%:%' THEN 'upload' ELSE 'aid' END AS kind,
        CASE WHEN name LIKE 'UU:%:%' THEN @RE1(name, '^UU:([^:]*):') END AS owner FROM (SELECT id,
        CASE id % 3 WHEN 0 THEN CAST(id AS STRING) WHEN 1 THEN concat('UU:', CAST(uid AS STRING), ':f', CAST(id AS STRING), '.pdf') ELSE concat('cs/', CAST(id AS STRING)) END AS name FROM act) x"""
    ),
    "html_safe_ids": Query("SELECT aid, lower(hex(concat(cat, '/', CAST(aid AS STRING)))) AS safe FROM article"),
    "url_actions": Query("SELECT page_id, @RE1(url, '/(abs|format|pdf|ps|html|src|blog|wiki|news)/') AS kind, @RE1(url, '/([^/?#]+)/?$') AS target FROM pages"),
    "category_overlap": Query(
        "SELECT a.sid AS sid, b.aid FROM (SELECT DISTINCT a.sid, r.major FROM act a JOIN article r ON a.aid = r.aid) a JOIN (SELECT DISTINCT a.sid, a.aid, r.major FROM act a JOIN article r ON a.aid = r.aid) b ON a.sid = b.sid AND a.major = b.major GROUP BY a.sid, b.aid"
    ),
    "categories_unchanged": Query(
        "SELECT e.uid, CASE WHEN e.cats = l.cats THEN 1 ELSE 0 END AS same FROM early e JOIN late l ON e.uid = l.uid",
        """early AS (SELECT uid, @LISTAGG(cat) AS cats FROM act a JOIN article r ON a.aid = r.aid WHERE t < TIMESTAMP '2024-01-16 00:00:00' GROUP BY uid),
        late AS (SELECT uid, @LISTAGG(cat) AS cats FROM act a JOIN article r ON a.aid = r.aid WHERE t >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY uid)""",
    ),
    "primary_sources": Query("SELECT source, major, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, major) AS rn FROM (SELECT cat AS source, major, count(*) AS n FROM article GROUP BY cat, major) y) x WHERE rn = 1"),
    # terms
    "kept_terms": Query(f"SELECT term, df FROM df, n_docs WHERE length(term) > 2 AND NOT term < 'a' AND term NOT IN {STOP} AND df BETWEEN 5 AND n / 2"),
    "query_terms": Query(
        f"SELECT conv_id, count(DISTINCT w) AS n_terms, CAST(sum(CASE WHEN w IN {STOP} THEN 1 ELSE 0 END) AS BIGINT) AS n_stop FROM (SELECT conv_id, @TERMS(text) AS w FROM conversations WHERE role = 'user') x WHERE w <> '' GROUP BY conv_id"
    ),
    "total_df": Query("SELECT term, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM (SELECT term, field, count(*) AS n FROM f GROUP BY term, field) x GROUP BY term HAVING sum(n) >= 10",
        """f AS (SELECT DISTINCT aid, 'body' AS field, term FROM token WHERE term <> '' UNION ALL SELECT DISTINCT aid, 'category' AS field, term FROM (SELECT aid, @TERMS(cat) AS term FROM article) y)"""),
    "field_boosts": Query("SELECT aid, round(CASE WHEN n > 0 THEN 3.0 * (n + m) / n ELSE 0 END, 6) AS head_boost FROM (SELECT aid, length(cat) AS n, n_chars AS m FROM article) x"),
    "sqrt_norms": Query("SELECT p.aid, round(sqrt(sum(tf * idf)), 6) AS norm FROM posting p JOIN idf i ON p.term = i.term WHERE df >= 10 GROUP BY p.aid"),
    "term_dump": Query("SELECT aid, term, concat('\"body\",\"', p.term, '\",', CAST(tf AS STRING), ',', CAST(df AS STRING)) AS line FROM (SELECT p.aid, p.term, p.tf, d.df FROM posting p JOIN df d ON p.term = d.term) p"),
    "category_topics": Query(
        "SELECT cat, term, n FROM (SELECT cat, term, n, row_number() OVER (PARTITION BY cat ORDER BY n DESC, term) AS rn FROM (SELECT r.cat, p.term, CAST(sum(tf) AS BIGINT) AS n FROM posting p JOIN article r ON p.aid = r.aid GROUP BY r.cat, p.term) y) x WHERE rn <= 20"
    ),
    "smoothed_centroids": Query(
        "SELECT cat, term, round(0.9 * c + 0.1 / (SELECT n FROM size), 9) AS p FROM c",
        """l1 AS (SELECT aid, CAST(sum(tf) AS DOUBLE) AS n FROM posting GROUP BY aid), size AS (SELECT count(*) AS n FROM df), cats AS (SELECT cat, count(*) AS n FROM article GROUP BY cat),
        c AS (SELECT r.cat, p.term, sum(p.tf / l1.n) / max(cats.n) AS c FROM posting p JOIN l1 ON p.aid = l1.aid JOIN article r ON p.aid = r.aid JOIN cats ON cats.cat = r.cat GROUP BY r.cat, p.term)""",
    ),
    "cluster_df": Query("SELECT cat, term, count(*) AS df FROM posting p JOIN article r ON p.aid = r.aid GROUP BY cat, term HAVING count(*) >= 10"),
    # feedback and sessions
    "reorder_displacement": Query(
        "SELECT sid, round(sum(CASE WHEN n > 1 THEN (pos0 - pos1) / CAST(n - 1 AS DOUBLE) ELSE 0 END), 6) AS displaced FROM p WHERE op >= 100 GROUP BY sid",
        """p AS (SELECT sid, op, row_number() OVER (PARTITION BY sid ORDER BY id) AS pos0, row_number() OVER (PARTITION BY sid ORDER BY op DESC, id) AS pos1, count(*) OVER (PARTITION BY sid) AS n FROM act)""",
    ),
    "first_promoted": Query(
        "SELECT uid, min(CASE WHEN a <> b THEN rn END) AS place FROM (SELECT n.uid, n.rn, n.aid AS a, o.aid AS b FROM n JOIN o ON n.uid = o.uid AND n.rn = o.rn) x GROUP BY uid",
        """n AS (SELECT uid, aid, rn FROM ranked_page WHERE rn <= 20), o AS (SELECT uid, aid, row_number() OVER (PARTITION BY uid ORDER BY last_id DESC, aid) AS rn FROM page_score WHERE score > 0)""",
    ),
    "folder_recent_first": Query("SELECT uid, aid, CAST(row_number() OVER (PARTITION BY uid ORDER BY id DESC) AS INT) AS place FROM (SELECT uid, aid, max(id) AS id, @LAST(kind, id) AS k FROM act WHERE kind IN ('purchase', 'error') GROUP BY uid, aid) x WHERE k <> 'error'"),
    "list_length_rule": Query("SELECT sid, CAST(CASE WHEN n <= 2 THEN 3 ELSE least(2 + n, 20) END AS BIGINT) AS wanted FROM (SELECT sid, count(DISTINCT aid) AS n FROM act WHERE w > 0 GROUP BY sid) x"),
    "unique_in_order": Query("SELECT sid, aid, CAST(row_number() OVER (PARTITION BY sid ORDER BY first_id) AS INT) AS place FROM (SELECT sid, aid, min(id) AS first_id FROM act GROUP BY sid, aid) x"),
    "session_exclusions": Query("SELECT DISTINCT sid, aid FROM (SELECT sid, aid FROM act WHERE w > 0 UNION ALL SELECT s.sid, a.aid FROM (SELECT DISTINCT sid, uid FROM act) s JOIN act a ON s.uid = a.uid AND a.op < 0) x"),
    "trivial_list": Query("SELECT sid, aid, CAST(row_number() OVER (PARTITION BY sid ORDER BY last_id DESC) AS INT) AS rn FROM (SELECT sid, aid, max(id) AS last_id FROM act WHERE w > 0 GROUP BY sid, aid) x"),
    "overload_rejects": Query(
        "SELECT id, uid, CASE WHEN in_minute >= 120 OR in_ten >= 300 THEN 1 ELSE 0 END AS rejected FROM (SELECT id, uid, count(*) OVER (PARTITION BY uid ORDER BY s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS in_minute, count(*) OVER (PARTITION BY uid ORDER BY s RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS in_ten FROM (SELECT id, uid, @EPOCH(t) AS s FROM act) y) x"
    ),
    # every user, and whether neither a mail nor a look falls into the last seven days
    "email_due": Query(
        """SELECT uid, sent, seen, CASE WHEN (sent IS NULL OR sent < @NOW - INTERVAL '7' DAY) AND (seen IS NULL OR seen < @NOW - INTERVAL '7' DAY) THEN 1 ELSE 0 END AS due FROM (
        SELECT uid, max(CASE WHEN kind = 'signup' THEN t END) AS sent, max(CASE WHEN kind IN ('view', 'click') THEN t END) AS seen FROM act GROUP BY uid) x"""
    ),
    "since_rule": Query(
        "SELECT uid, CAST(greatest(1, least(90, coalesce(ago, 90))) AS BIGINT) AS days FROM (SELECT uid, @DAYS(@NOW, max(CASE WHEN kind = 'view' THEN t END)) AS ago FROM act GROUP BY uid) x"
    ),
    "eval_days": Query(
        "SELECT uid, day, CASE WHEN rn <= 2 THEN 'LEARN' WHEN @COIN(concat(CAST(uid AS STRING), '/', CAST(day AS STRING))) % 3 = 0 THEN 'EVAL' ELSE 'LEARN' END AS kind FROM (SELECT uid, day, row_number() OVER (PARTITION BY uid ORDER BY day) AS rn FROM (SELECT DISTINCT uid, CAST(t AS DATE) AS day FROM act) y) x"
    ),
    "needs_update": Query(
        "SELECT uid FROM (SELECT uid, max(id) AS last_id, max(CASE WHEN t < @NOW - INTERVAL '1' DAY THEN id END) AS mark FROM act GROUP BY uid) x WHERE mark IS NULL OR last_id > mark"
    ),
    # candidates and stochastic models
    "subject_candidates": Query(
        "SELECT cat, aid, CAST(rn AS INT) AS rn FROM (SELECT cat, aid, row_number() OVER (PARTITION BY cat ORDER BY last_t DESC, aid) AS rn FROM (SELECT r.cat, r.aid, max(a.t) AS last_t FROM article r JOIN act a ON r.aid = a.aid WHERE a.t >= @NOW - INTERVAL '7' DAY GROUP BY r.cat, r.aid) y) x WHERE rn <= 200"
    ),
    # the sum of products of weights over pairs of actions of a session in a year, but of the reader's own sessions
    "coaccess_sessions": Query(
        "SELECT a1.aid AS a0, a2.aid AS a1, CAST(sum(a1.w * a2.w) AS BIGINT) AS score FROM s a1 JOIN s a2 ON a1.sid = a2.sid AND a1.aid <> a2.aid GROUP BY a1.aid, a2.aid",
        "s AS (SELECT sid, aid, w FROM act WHERE w > 0 AND aid IS NOT NULL AND t > @NOW - INTERVAL '365' DAY AND uid <> 1)",
    ),
    "explore_exploit": Query(
        "SELECT aid, cat, round(p, 8) AS exploit, CAST(row_number() OVER (PARTITION BY cat ORDER BY round(p, 8) DESC, aid) AS INT) AS place FROM v",
        """n AS (SELECT aid, CAST(sum(CASE WHEN op >= 100 THEN 1 ELSE 0 END) AS DOUBLE) AS up, CAST(sum(CASE WHEN op < 0 THEN 1 ELSE 0 END) AS DOUBLE) AS down FROM act GROUP BY aid),
        v AS (SELECT r.aid, r.cat, (0.5 + coalesce(up, 0)) / (1.0 + coalesce(up, 0) + coalesce(down, 0)) AS p FROM article r LEFT JOIN n ON r.aid = n.aid)""",
    ),
    "bracketed_table": Query(
        "SELECT id, round(lo + (hi - lo) * (x - floor(x / 10) * 10) / 10, 6) AS y FROM (SELECT id, x, ln(1 + floor(x / 10)) AS lo, ln(2 + floor(x / 10)) AS hi FROM (SELECT id, CAST(least(greatest(id % 1000, 0), 990) AS DOUBLE) AS x FROM act) z) w"
    ),
    "split_centroids": Query(
        "SELECT part, label, CAST(pos AS INT) AS pos, round(avg(v), 6) AS c FROM (SELECT CASE WHEN @COIN(CAST(vec_id AS STRING)) % 2 = 0 THEN 'train' ELSE 'test' END AS part, label, pos, v FROM (SELECT vec_id, label, @VECTOR(embedding) FROM embeddings) y) x GROUP BY part, label, pos"
    ),
    "task_durations": Query(
        "SELECT kind, round(avg(d), 4) AS seconds FROM (SELECT kind, @EPOCH(lead(t) OVER (PARTITION BY uid ORDER BY t, id)) - @EPOCH(t) AS d FROM act) x WHERE d IS NOT NULL GROUP BY kind"
    ),
    "new_documents": Query("SELECT r.aid FROM article r LEFT JOIN (SELECT DISTINCT aid FROM act) a ON r.aid = a.aid WHERE a.aid IS NULL"),
    "metadata_csv": Query(
        "SELECT aid, concat(CAST(aid AS STRING), ',\"', cat, '\",', CAST(n_chars AS STRING), ',\"', @REALL(replace(coalesce(body, ''), '\"', ''''), '[ \\t\\r\\n]+', ' '), '\"') AS line FROM article"
    ),
    "upload_profiles": Query("SELECT uid, term, round(sum(x), 6) AS w FROM (SELECT DISTINCT uid, aid FROM act WHERE kind = 'purchase') u JOIN vec v ON u.aid = v.aid GROUP BY uid, term"),
    "likeliest_class": Query(
        "SELECT aid, major FROM (SELECT aid, major, row_number() OVER (PARTITION BY aid ORDER BY round(s, 6) DESC, major) AS rn FROM s) x WHERE rn = 1",
        """l1 AS (SELECT aid, CAST(sum(tf) AS DOUBLE) AS n FROM posting GROUP BY aid), size AS (SELECT count(*) AS n FROM df), majors AS (SELECT major, count(*) AS n FROM article GROUP BY major),
        c AS (SELECT r.major, p.term, sum(p.tf / l1.n) / max(m.n) AS c FROM posting p JOIN l1 ON p.aid = l1.aid JOIN article r ON p.aid = r.aid JOIN majors m ON m.major = r.major GROUP BY r.major, p.term),
        s AS (SELECT p.aid, c.major, sum(tf * (ln(0.9 * c + 0.1 / size.n) - ln(0.1 / size.n))) AS s FROM posting p JOIN c ON p.term = c.term CROSS JOIN size GROUP BY p.aid, c.major)""",
    ),
}
