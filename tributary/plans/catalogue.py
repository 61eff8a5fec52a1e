"""The engine's relational operators, one named query each."""

from __future__ import annotations

from tributary.plans.dialect import Query

R = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

QUERIES = {
    # counts, groups, latest states
    "actions_per_user": Query("SELECT uid, count(*) AS n, count(DISTINCT sid) AS sessions, count(DISTINCT aid) AS articles, min(id) AS first_id, max(id) AS last_id FROM act GROUP BY uid"),
    "sessions_with_several": Query("SELECT sid, count(*) AS n FROM act GROUP BY sid HAVING count(*) > 1"),
    "users_per_article": Query("SELECT aid, count(DISTINCT uid) AS users FROM act GROUP BY aid"),
    "latest_action": Query("SELECT uid, aid, id, kind FROM (SELECT *, row_number() OVER (PARTITION BY uid, aid ORDER BY t DESC, id DESC) AS rn FROM act) x WHERE rn = 1"),
    "strongest_action": Query("SELECT uid, aid, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY uid, aid ORDER BY abs(op) DESC, t DESC, id DESC) AS rn FROM act) x WHERE rn = 1"),
    "page_score": Query("SELECT uid, aid, CAST(score AS BIGINT) AS score FROM page_score WHERE score <> 0"),
    "feedback_class": Query(
        """SELECT uid, aid, CASE WHEN last_judged < 0 THEN 'DEMOTED' WHEN last_judged >= 100 THEN 'PROMOTED' WHEN n_views > 0 THEN 'VIEWED' END AS verdict
        FROM (SELECT uid, aid, @LAST(CASE WHEN op < 0 OR op >= 100 THEN op END, CASE WHEN op < 0 OR op >= 100 THEN id END) AS last_judged,
              sum(CASE WHEN kind IN ('view', 'click') THEN 1 ELSE 0 END) AS n_views FROM act GROUP BY uid, aid) x"""
    ),
    "folder_state": Query("SELECT uid, aid FROM (SELECT uid, aid, @LAST(kind, id) AS k FROM act WHERE kind IN ('purchase', 'error') GROUP BY uid, aid) x WHERE k <> 'error'"),
    "alpha_beta": Query(
        """SELECT uid, cat, CAST(1 + sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS BIGINT) AS alpha, CAST(19 + sum(CASE WHEN op < 0 THEN 1 ELSE 0 END) AS BIGINT) AS beta
        FROM act a JOIN article r ON a.aid = r.aid GROUP BY uid, cat"""
    ),
    "votes": Query("SELECT aid, CAST(sum(CASE WHEN op >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS up, CAST(sum(CASE WHEN op < 0 THEN 1 ELSE 0 END) AS BIGINT) AS down FROM act GROUP BY aid"),
    "cluster_volume": Query("SELECT cat, count(*) AS n, CAST(round(count(*) / 13.0) AS BIGINT) AS weekly, round(count(*) / 90.0, 6) AS daily FROM article GROUP BY cat"),
    "category_sizes": Query("SELECT cat, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 8) AS share FROM article GROUP BY cat"),
    "multiplicity_histogram": Query("SELECT least(n, 99) AS n_actions, count(*) AS n_articles FROM (SELECT aid, count(*) AS n FROM act GROUP BY aid) x GROUP BY least(n, 99)"),
    "table_scalars": Query("SELECT max(id) AS max_id, min(id) AS min_id, count(*) AS n FROM act"),
    "activity_thresholds": Query(
        "SELECT p.uid, p.aid FROM pairs p JOIN users u ON p.uid = u.uid JOIN papers a ON p.aid = a.aid",
        """pairs AS (SELECT DISTINCT uid, aid FROM act WHERE kind IN ('view', 'click')), users AS (SELECT uid FROM pairs GROUP BY uid HAVING count(*) >= 5),
        papers AS (SELECT p.aid FROM pairs p JOIN users u ON p.uid = u.uid GROUP BY p.aid HAVING count(*) >= 3)""",
    ),
    "list_quality": Query(
        "SELECT sid, round(sum(v / (1.0 + misses)), 6) AS quality FROM m GROUP BY sid",
        f"""v AS (SELECT sid, id, CASE WHEN op >= 100 THEN 1 WHEN op < 0 THEN -1 WHEN kind = 'click' THEN 1 ELSE 0 END AS v FROM act),
        m AS (SELECT sid, v, coalesce(sum(CASE WHEN v < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY id {R}), 0) AS misses FROM v)""",
    ),
    "accuracy_by_category": Query(
        "SELECT major, count(*) AS n, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS agreed FROM article a JOIN labels l ON a.aid = l.doc_id GROUP BY major"
    ),
    "confusion": Query("SELECT quality, toxic, major, count(*) AS n FROM labels l JOIN article a ON a.aid = l.doc_id GROUP BY quality, toxic, major"),
    # joins and sets
    "left_join_default": Query("SELECT r.aid, coalesce(n, 0) AS n FROM article r LEFT JOIN (SELECT aid, count(*) AS n FROM act GROUP BY aid) x ON r.aid = x.aid"),
    "coaccess_sum_of_max": Query(
        "SELECT a.aid AS a0, b.aid AS a1, CAST(sum(a.w * b.w) AS BIGINT) AS score FROM s a JOIN s b ON a.sid = b.sid AND a.aid <> b.aid GROUP BY a.aid, b.aid",
        "s AS (SELECT sid, aid, max(w) AS w FROM act WHERE w > 0 AND t > @NOW - INTERVAL '365' DAY GROUP BY sid, aid)",
    ),
    "coaccess_local": Query(
        "SELECT a.aid AS a0, b.aid, CAST(sum(a.w * b.w) AS BIGINT) AS score FROM s a JOIN s b ON a.sid = b.sid AND a.aid <> b.aid GROUP BY a.aid, b.aid",
        "s AS (SELECT sid, aid, max(w) AS w FROM act WHERE w > 0 AND aid IS NOT NULL AND t > @NOW - INTERVAL '365' DAY GROUP BY sid, aid)",
    ),
    # all other articles by the article's own score plus the general one
    "coaccess_combined": Query(
        """SELECT a0, aid, score, CAST(row_number() OVER (PARTITION BY a0 ORDER BY score DESC, aid) AS INT) AS rn FROM (
            SELECT c.a0, c.aid, CAST(sum(c.score) AS BIGINT) + max(g.score) AS score FROM c JOIN g ON c.aid = g.aid GROUP BY c.a0, c.aid) y""",
        """s AS (SELECT sid, aid, max(w) AS w FROM act WHERE w > 0 AND aid IS NOT NULL AND t > @NOW - INTERVAL '365' DAY GROUP BY sid, aid),
        g AS (SELECT aid, CAST(sum(w) AS BIGINT) AS score FROM s GROUP BY aid),
        c AS (SELECT a.aid AS a0, b.aid, sum(a.w * b.w) AS score FROM s a JOIN s b ON a.sid = b.sid AND a.aid <> b.aid GROUP BY a.aid, b.aid
            UNION ALL SELECT g.aid AS a0, t.aid, 0 AS score FROM g JOIN g t ON g.aid <> t.aid)""",
    ),
    "exclusions": Query("SELECT aid FROM article r WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.aid = r.aid AND a.op < 0)"),
    "unseen_articles": Query("SELECT aid FROM article EXCEPT SELECT aid FROM act"),
    "accepted_actions": Query("SELECT id, uid, aid FROM act a WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.aid AND l.quality = 1)"),
    "as_of_latest_window": Query("SELECT id, max(CASE WHEN kind = 'purchase' THEN id END) OVER (PARTITION BY uid ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_id FROM act"),
    "union_newer": Query(
        "SELECT uid, aid, max(id) AS id FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x GROUP BY uid, aid",
        "a AS (SELECT uid, aid, max(id) AS id FROM act GROUP BY uid, aid), b AS (SELECT uid - 1 AS uid, aid, id FROM a WHERE uid - 1 IN (SELECT uid FROM a))",
    ),
    "front_then_rest": Query(
        "SELECT x.uid, x.aid, min(p) AS p FROM (SELECT uid, aid, 0 AS p FROM f UNION ALL SELECT uid, aid, 1 AS p FROM s) x WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.uid = x.uid AND n.aid = x.aid) GROUP BY x.uid, x.aid",
        """f AS (SELECT DISTINCT uid, aid FROM act WHERE kind = 'purchase' AND aid IS NOT NULL), s AS (SELECT DISTINCT uid, aid FROM act WHERE kind = 'view' AND aid IS NOT NULL),
        n AS (SELECT DISTINCT uid, aid FROM act WHERE op < 0 AND aid IS NOT NULL)""",
    ),
    "session_categories": Query("SELECT sid, @LISTAGG(cat) AS cats FROM act a JOIN article r ON a.aid = r.aid GROUP BY sid"),
    "new_categories": Query(
        "SELECT uid, cat FROM late EXCEPT SELECT uid, cat FROM early",
        "early AS (SELECT uid, cat FROM act a JOIN article r ON a.aid = r.aid WHERE t < TIMESTAMP '2024-01-20 00:00:00'), late AS (SELECT uid, cat FROM act a JOIN article r ON a.aid = r.aid WHERE t >= TIMESTAMP '2024-01-20 00:00:00')",
    ),
    "both_kinds": Query("SELECT aid FROM act WHERE kind = 'view' INTERSECT SELECT aid FROM act WHERE kind = 'error'"),
    # windows
    "rank_in_cluster": Query("SELECT aid, cat, CAST(row_number() OVER (PARTITION BY cat ORDER BY n_chars DESC, aid) AS INT) AS rn FROM article"),
    "discounts": Query("SELECT uid, aid, round(1 / (1 + ln(rn)), 8) AS gamma FROM ranked_page WHERE rn <= 20"),
    "pairs_perturbed": Query(
        "SELECT uid, aid, rn, CASE WHEN paired = 2 AND swap = 1 THEN CASE WHEN pos_in_pair = 0 THEN rn + 1 ELSE rn - 1 END ELSE rn END AS new_rn FROM p",
        """t AS (SELECT uid, aid, rn, @COIN(concat('top', CAST(uid AS STRING))) % 2 AS orphan FROM ranked_page WHERE rn <= 20),
        g AS (SELECT *, CAST(floor((rn - 1 + orphan) / 2.0) AS BIGINT) AS pr, (rn - 1 + orphan) % 2 AS pos_in_pair FROM t),
        p AS (SELECT *, count(*) OVER (PARTITION BY uid, pr) AS paired, @COIN(concat('swap', CAST(uid AS STRING), '/', CAST(pr AS STRING))) % 2 AS swap FROM g)""",
    ),
    "tie_permutation": Query("SELECT uid, aid, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, @COIN(concat(CAST(uid AS STRING), '/', CAST(aid AS STRING))), aid) AS INT) AS rn FROM page_score WHERE score > 0"),
    "sliding_rate": Query(
        """SELECT id, count(*) OVER (PARTITION BY uid ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_hour FROM (SELECT id, uid, @EPOCH(t) AS s FROM act) x"""
    ),
    "session_by_gap": Query(
        "SELECT uid, session, count(*) AS n, min(id) AS first_id FROM s GROUP BY uid, session",
        """g AS (SELECT uid, id, t, CASE WHEN @EPOCH(t) - @EPOCH(lag(t) OVER (PARTITION BY uid ORDER BY t, id)) <= 1800 THEN 0 ELSE 1 END AS fresh FROM act),
        s AS (SELECT uid, id, sum(fresh) OVER (PARTITION BY uid ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS session FROM g)""",
    ),
    "session_history": Query(
        """SELECT sid, aid, CASE WHEN hidden = 1 THEN 'prohibited' ELSE 'viewed' END AS state, CAST(row_number() OVER (PARTITION BY sid, hidden ORDER BY last_id DESC) AS INT) AS place
        FROM (SELECT sid, aid, max(CASE WHEN op < 0 THEN 1 ELSE 0 END) AS hidden, max(id) AS last_id FROM act GROUP BY sid, aid) x"""
    ),
    "min_activity": Query("SELECT sid FROM act WHERE w > 0 GROUP BY sid HAVING count(DISTINCT aid) >= 2"),
    "fractional_sample": Query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY uid ORDER BY id) AS rn FROM act) x WHERE floor(rn * 0.25) > floor((rn - 1) * 0.25)"),
    "hash_split": Query("SELECT CASE WHEN @COIN(CAST(aid AS STRING)) % 2 = 0 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM article GROUP BY 1"),
    "page_window": Query("SELECT uid, aid, rn FROM (SELECT uid, aid, row_number() OVER (PARTITION BY uid ORDER BY score DESC, aid) AS rn FROM page_score) x WHERE rn BETWEEN 6 AND 15"),
    # articles by their ranks (100 at most) in all lists, ascending, compared place by place; of two where one goes on the longer is better. A rank that
    # occurs more often comes first at its place, so each rank with the complement of its number says the same in a text that lists do not lengthen
    "rank_vector_merge": Query(
        "SELECT aid, n_lists, best, total, age FROM v ORDER BY ranks, n_lists DESC, aid LIMIT 20",
        """a AS (SELECT aid, rn, score, CAST(row_number() OVER (PARTITION BY uid ORDER BY last_id DESC, aid) - 1 AS INT) AS age FROM ranked_page WHERE rn <= 100),
        c AS (SELECT aid, rn, count(*) AS n, CAST(sum(score) AS BIGINT) AS total, min(age) AS age FROM a GROUP BY aid, rn),
        v AS (SELECT aid, CAST(sum(n) AS BIGINT) AS n_lists, min(rn) AS best, CAST(sum(total) AS BIGINT) AS total, min(age) AS age,
            concat(@LISTAGG(concat(lpad(CAST(rn AS STRING), 3, '0'), lpad(CAST(999999999999 - n AS STRING), 12, '0'))), '~') AS ranks FROM c GROUP BY aid)""",
    ),
    "provenance_ranks": Query(
        "SELECT coalesce(a.uid, b.uid) AS uid, coalesce(a.aid, b.aid) AS aid, coalesce(a.rn, 0) AS arank, coalesce(b.rn, 0) AS brank FROM a FULL OUTER JOIN b ON a.uid = b.uid AND a.aid = b.aid",
        "a AS (SELECT uid, aid, rn FROM ranked_page), b AS (SELECT uid - 1 AS uid, aid, rn FROM ranked_page WHERE uid - 1 IN (SELECT uid FROM ranked_page))",
    ),
    # an article's date is that of the first action on it; those without one count as ten years old
    "category_then_date": Query(
        """SELECT r.aid, round((CASE WHEN major = 'en' THEN 1 ELSE 0 END) + (CASE WHEN cat = 'en.src1' THEN 1 ELSE 0 END) - CAST(least(coalesce(age, 3650), 3650) AS DOUBLE) / 7300, 8) AS score
        FROM article r LEFT JOIN (SELECT aid, @DAYS(@NOW, min(t)) AS age FROM act GROUP BY aid) d ON r.aid = d.aid"""
    ),
    # text
    "document_frequency": Query("SELECT term, df FROM df WHERE df >= 10"),
    "inverse_document_frequency": Query("SELECT term, round(idf, 8) AS idf FROM idf WHERE df >= 10"),
    "document_norms": Query("SELECT aid, round(norm, 6) AS norm FROM norm"),
    "norm_report": Query("SELECT count(*) AS n, round(min(norm), 6) AS least, round(max(norm), 6) AS most, round(avg(norm), 6) AS mean FROM norm"),
    "top_terms": Query("SELECT aid, term, round(s, 6) AS s FROM (SELECT p.aid, p.term, tf * idf AS s, row_number() OVER (PARTITION BY p.aid ORDER BY tf * idf DESC, p.term) AS rn FROM posting p JOIN idf i ON p.term = i.term WHERE df >= 10) x WHERE rn <= 5"),
    "df_band": Query("SELECT count(*) AS n FROM df, n_docs WHERE df BETWEEN 5 AND n / 2"),
    "useful_terms": Query("SELECT term, df FROM df WHERE length(term) > 2 AND NOT term < 'a' AND term NOT IN ('the', 'and', 'der', 'die', 'les', 'des', 'que', 'los')"),
    "term_search": Query("SELECT aid, tf FROM posting WHERE term = 'thing' ORDER BY tf DESC, aid LIMIT 50"),
    "prefix_search": Query("SELECT aid, CAST(sum(tf) AS BIGINT) AS tf FROM posting WHERE term LIKE 'thin%' GROUP BY aid"),
    "conjunctive_search": Query("SELECT a.aid FROM posting a JOIN posting b ON a.aid = b.aid WHERE a.term = 'the' AND b.term = 'and'"),
    "disjunctive_search": Query("SELECT aid, count(*) AS matched, CAST(sum(tf) AS BIGINT) AS tf FROM posting WHERE term IN ('thing', 'other', 'station') GROUP BY aid"),
    "phrase_search": Query("SELECT aid FROM article WHERE @BARE(body) LIKE '% of the %'"),
    "category_search": Query("SELECT aid FROM article WHERE cat LIKE 'en.src1%'"),
    "date_range": Query("SELECT id FROM act WHERE t >= TIMESTAMP '2024-01-10 00:00:00' AND t < TIMESTAMP '2024-01-17 00:00:00'"),
    "profile_from_history": Query("SELECT uid, term, round(w1, 6) AS w1, round(sqrt(w1), 6) AS w2 FROM profile"),
    "profile_linear_score": Query(
        "SELECT uid, aid, s FROM (SELECT uid, v.aid, round(sum(w1 * x * sqrt(idf)), 5) AS s FROM profile f JOIN vec v ON f.term = v.term JOIN idf i ON v.term = i.term GROUP BY uid, v.aid) x WHERE s > 0"
    ),
    "profile_log_score": Query("SELECT uid, aid, s FROM (SELECT uid, p.aid, round(sum(ln(1 + tf) * w1 * idf), 5) AS s FROM profile f JOIN posting p ON f.term = p.term JOIN idf i ON p.term = i.term GROUP BY uid, p.aid) x WHERE s > 0"),
    "flagship": Query(
        "SELECT uid, aid, round(s, 5) AS s, CAST(rn AS INT) AS rn FROM (SELECT uid, aid, s, row_number() OVER (PARTITION BY uid ORDER BY round(s, 5) DESC, aid) AS rn FROM c) x WHERE rn <= 10",
        """c AS (SELECT f.uid, v.aid, sum(w1 * x * sqrt(idf)) AS s FROM profile f JOIN vec v ON f.term = v.term JOIN idf i ON v.term = i.term
        JOIN article r ON v.aid = r.aid WHERE major = 'en' AND NOT EXISTS (SELECT 1 FROM act a WHERE a.uid = f.uid AND a.aid = v.aid AND a.op < 0) GROUP BY f.uid, v.aid)""",
    ),
    # vectors and clusters
    "vector_norms": Query("SELECT vec_id, round(sqrt(sum(v * v)), 5) AS l2, round(sum(abs(v)), 5) AS l1 FROM (SELECT vec_id, @VECTOR(embedding) FROM embeddings) x GROUP BY vec_id"),
    "centroids": Query("SELECT label, CAST(pos AS INT) AS pos, round(avg(v), 6) AS c FROM (SELECT label, @VECTOR(embedding) FROM embeddings) x GROUP BY label, pos"),
    "nearest_centroid": Query(
        "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS rn FROM (SELECT e.vec_id, c.label, round(sum((e.v - c.c) * (e.v - c.c)), 9) AS d FROM e JOIN c ON e.pos = c.pos GROUP BY e.vec_id, c.label) y) z WHERE rn = 1",
        "e AS (SELECT vec_id, label, @VECTOR(embedding) FROM embeddings), c AS (SELECT label, pos, avg(v) AS c FROM e GROUP BY label, pos)",
    ),
    "cluster_report": Query(
        "SELECT label, n, round(sqrt(ss / n), 6) AS radius FROM (SELECT e.label, count(DISTINCT vec_id) AS n, sum((v - c) * (v - c)) AS ss FROM e JOIN c ON e.label = c.label AND e.pos = c.pos GROUP BY e.label) x",
        "e AS (SELECT vec_id, label, @VECTOR(embedding) FROM embeddings), c AS (SELECT label, pos, avg(v) AS c FROM e GROUP BY label, pos)",
    ),
    "cluster_count_rule": Query("SELECT cat, CAST(greatest(1, floor(sqrt(count(*) / 200.0))) AS BIGINT) AS k FROM article GROUP BY cat"),
    "user_item_matrix": Query("SELECT DISTINCT uid, aid FROM act WHERE kind IN ('view', 'click')"),
    "global_cluster_ids": Query("SELECT label, CAST(dense_rank() OVER (ORDER BY label) AS INT) AS gid, count(*) AS n FROM embeddings GROUP BY label"),
    "beta_mean": Query("SELECT aid, round((1.0 + sum(CASE WHEN op >= 100 THEN 1 ELSE 0 END)) / (2.0 + sum(CASE WHEN op >= 100 OR op < 0 THEN 1 ELSE 0 END)), 8) AS mean FROM act GROUP BY aid"),
    "beta_from_moments": Query(
        "SELECT aid, round(CASE WHEN n < 0 THEN 0.5 ELSE greatest(m * n, 0.5) END, 6) AS alpha, round(CASE WHEN n < 0 THEN 0.5 ELSE greatest((1 - m) * n, 0.5) END, 6) AS beta FROM (SELECT aid, m, -1 + m * (1 - m) * 100 AS n FROM (SELECT aid, avg(CASE WHEN w > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS m FROM act GROUP BY aid) x) y"
    ),
    "gamma_by_volume": Query("SELECT cat, round(1 - 1 / (12.0 * m + 1), 8) AS gamma FROM (SELECT cat, CAST(round(count(*) / 13.0) AS BIGINT) AS m FROM article GROUP BY cat) x"),
    # ingest and formats
    "canonical_ids": Query("SELECT aid, @REALL(concat(cat, '/', CAST(aid AS STRING), 'v2'), 'v[0-9]+$', '') AS canonical FROM article"),
    "category_base": Query("SELECT DISTINCT cat, @RE1(cat, '^([^.]+)') AS base FROM article"),
    "json_property": Query("SELECT id, aid FROM act WHERE aid IS NOT NULL"),
    "page_links": Query("SELECT page_id, length(html) - length(replace(html, '<a href', '<ahref')) AS n_links FROM pages"),
    "url_host": Query("SELECT page_id, @RE1(url, '^[a-z]+://([^/?#:]+)') AS host FROM pages"),
    "abstract_csv": Query("SELECT aid, concat('\"', @REALL(replace(body, '\"', ''''), '[ \\t\\n]+', ' '), '\"') AS line FROM article"),
    "upsert_newest": Query("SELECT aid, id, kind FROM (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY id DESC) AS rn FROM act) x WHERE rn = 1"),
    "session_transcripts": Query("SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS answers FROM conversations GROUP BY conv_id"),
    # console
    "console_pricing": Query(
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2003-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"
    ),
    "console_join": Query("SELECT n_name, round(sum(o_totalprice), 1) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name"),
    "console_comma_join": Query("SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_acctbal > 5000"),
    "console_correlated": Query("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)"),
    "console_having": Query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 10"),
    "console_case_in_null": Query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'middle' ELSE 'large' END AS size FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_name IS NOT NULL"),
    "console_rollup": Query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) + grouping(o_orderpriority) AS lvl FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "console_max_rows": Query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"),
    "console_full_join": Query("SELECT c_custkey, o_orderkey FROM customer FULL OUTER JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey"),
    "console_set_update": Query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer"),
}
