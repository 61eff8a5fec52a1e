"""Queries written once as SQL, with the few functions that Spark and DuckDB spell differently filled in for each."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tributary.sources.scratch import kept, sized

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The reference time of all horizons; never the clock.
NOW = "TIMESTAMP '2024-01-31 00:00:00'"

#: name: (Spark, DuckDB); $1, $2 are the arguments.
FUNCTIONS = {
    "JSONK": ("CAST(get_json_object($1, '$.k') AS BIGINT)", "CAST(json_extract_string($1, '$.k') AS BIGINT)"),
    "COIN": ("CAST(conv(substr(md5($1), 1, 8), 16, 10) AS BIGINT)", "CAST(concat('0x', substr(md5($1), 1, 8)) AS BIGINT)"),
    "DAYS": ("datediff($1, $2)", "date_diff('day', CAST($2 AS DATE), CAST($1 AS DATE))"),
    "EPOCH": ("unix_timestamp($1)", "CAST(floor(epoch($1)) AS BIGINT)"),
    "TERMS": (r"explode(split(lower($1), r'[^\p{L}\p{Nd}]+'))", r"unnest(regexp_split_to_array(lower($1), '[^\p{L}\p{Nd}]+'))"),
    "BARE": (r"concat(' ', regexp_replace(lower($1), r'[^\p{L}\p{Nd}]+', ' '), ' ')", r"concat(' ', regexp_replace(lower($1), '[^\p{L}\p{Nd}]+', ' ', 'g'), ' ')"),
    "LAST": ("max_by($1, $2)", "arg_max($1, $2)"),
    "VECTOR": ("posexplode(transform($1, x -> CAST(x AS DOUBLE))) AS (pos, v)", "unnest(generate_series(0, len($1) - 1)) AS pos, unnest(CAST($1 AS DOUBLE[])) AS v"),
    "LISTAGG": ("array_join(array_sort(collect_set($1)), ' ')", "array_to_string(list_sort(list_distinct(list($1))), ' ')"),
    "DAY": ("CAST($1 AS DATE)", "CAST($1 AS DATE)"),
    # the sum of $1, numbers of two decimals, over the window $2: Spark's adds them exactly, in whatever order they come
    "EXACT": ("CAST(sum(CAST($1 AS DECIMAL(28, 2))) OVER ($2) AS DOUBLE)", "sum($1) OVER ($2)"),
    "RINT": ("rint($1)", "round_even($1, 0)"),
    "RE1": ("regexp_extract($1, $2, 1)", "regexp_extract($1, $2, 1)"),
    "REALL": ("regexp_replace($1, $2, $3)", "regexp_replace($1, $2, $3, 'g')"),
}

#: Relations of the domain over the given tables.
VIEWS = {
    "article": "SELECT doc_id AS aid, lang AS major, concat(lang, '.', source) AS cat, text AS body, n_chars FROM documents",
    "act": """SELECT event_id AS id, user_id AS uid, ts AS t, @JSONK(props) AS aid, event_type AS kind,
        CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 30 WHEN 'purchase' THEN 1000 WHEN 'signup' THEN 200 ELSE -50 END AS op,
        CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 5 ELSE 0 END AS w,
        concat(CAST(user_id AS STRING), '/', CAST(CAST(ts AS DATE) AS STRING)) AS sid FROM events""",
    "token": "SELECT doc_id AS aid, @TERMS(text) AS term FROM documents",
    "posting": "SELECT aid, term, count(*) AS tf FROM token WHERE length(term) > 2 AND NOT term < 'a' GROUP BY aid, term",
    "df": "SELECT term, count(*) AS df FROM posting GROUP BY term",
    "n_docs": "SELECT count(*) AS n FROM documents",
    "idf": "SELECT term, df, 1 + ln((SELECT n FROM n_docs) / CAST(1 + df AS DOUBLE)) AS idf FROM df",
    "norm": "SELECT p.aid, sqrt(sum(tf * tf * idf)) AS norm FROM posting p JOIN idf i ON p.term = i.term WHERE df >= 10 GROUP BY p.aid",
    "vec": "SELECT p.aid, p.term, tf * sqrt(idf) / norm AS x FROM posting p JOIN idf i ON p.term = i.term JOIN norm n ON p.aid = n.aid WHERE df >= 10 AND norm > 0",
    "page_score": """SELECT uid, aid, CASE WHEN @LAST(CASE WHEN kind IN ('purchase', 'error') THEN kind END, CASE WHEN kind IN ('purchase', 'error') THEN id END) = 'purchase' THEN 1000 ELSE 0 END
        + coalesce(@LAST(CASE WHEN kind IN ('signup', 'error') THEN op END, CASE WHEN kind IN ('signup', 'error') THEN id END), 0)
        + coalesce(max(CASE WHEN kind IN ('view', 'click') THEN op END), 0) AS score, max(id) AS last_id FROM act GROUP BY uid, aid""",
    "ranked_page": "SELECT uid, aid, score, last_id, row_number() OVER (PARTITION BY uid ORDER BY score DESC, last_id DESC, aid) AS rn FROM page_score WHERE score > 0",
    "profile": """SELECT uid, v.term, sum(x / (1 + ln(rn))) AS w1 FROM ranked_page r JOIN vec v ON r.aid = v.aid GROUP BY uid, v.term""",
}

#: What Spark reads in place of some views. Texts go to the partition of their document before they are split, so that counting its terms moves no terms;
#: the often terms, few enough to be broadcast for long, are joined in place of all where rarer ones are left out; norms come from a window, so vectors move once.
OFTEN = "JOIN idf i ON p.term = i.term WHERE df >= 10"
SPARK_VIEWS = {
    "token": "SELECT doc_id AS aid, @TERMS(text) AS term FROM (SELECT /*+ REPARTITION(doc_id) */ doc_id, text FROM documents)",
    "often": "SELECT term, df, idf FROM idf WHERE df >= 10",
    "vec": f"""SELECT aid, term, tf * sqrt(idf) / norm AS x FROM (SELECT p.aid, p.term, tf, idf, sqrt(sum(tf * tf * idf) OVER (PARTITION BY p.aid)) AS norm
        FROM posting p {OFTEN}) WHERE norm > 0""",
}


@dataclass(frozen=True)
class Query:
    """ctes (possibly empty) and the final SELECT."""

    select: str
    ctes: str = ""


def _filled(sql: str, which: int) -> str:
    """sql with each @NAME(...) replaced; arguments may nest."""
    while m := re.search(r"@([A-Z0-9]+)\(", sql):
        depth, i, args, start = 1, m.end(), [], m.end()
        while depth:
            c = sql[i]
            quoted = sql[start:i].count("'") % 2
            if not quoted:
                depth += (c == "(") - (c == ")")
                if c == "," and depth == 1 or not depth:
                    args.append(sql[start:i].strip())
                    start = i + 1
            i += 1
        body = FUNCTIONS[m[1]][which]
        for k, a in enumerate(args, 1):
            body = re.sub(rf"\${k}(?!\w)", lambda _, a=a: a, body)
        sql = sql[: m.start()] + body + sql[i:]
    return sql


def _needed(text: str, known: dict[str, str]) -> list[str]:
    """The names of known that text uses, each after those that it uses itself."""
    out: list[str] = []
    for name in known:
        if re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
            for x in [*_needed(known[name], {k: v for k, v in known.items() if k != name}), name]:
                if x not in out:
                    out.append(x)
    return out


def _named(sf_dir: str | None, given: dict[str, str] | None = None) -> dict[str, str]:
    if not sf_dir:
        return VIEWS
    return VIEWS | SPARK_VIEWS | {t: f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`" for t in TABLES} | (given or {})


def text(query: Query, sf_dir: str | None = None, given: dict[str, str] | None = None) -> str:
    """The SQL for DuckDB, or with sf_dir that for Spark, which reads its tables from there, and those in given, texts by name, in place of views."""
    named = _named(sf_dir, given)
    used = lambda sql: sql.replace(OFTEN, OFTEN.replace("JOIN idf", "JOIN often")) if sf_dir else sql
    named, ctes, select = {n: used(v) for n, v in named.items()}, used(query.ctes), used(query.select)
    parts = [f"{n} AS ({named[n]})" for n in _needed(f"{ctes} {select}", named)]
    if ctes:
        parts.append(ctes)
    sql = f"WITH {', '.join(parts)} {select}" if parts else select
    sql = sql.replace("@NOW", NOW)
    if not sf_dir:
        sql = re.sub(r"\bdiv\b", "//", sql)
    return _filled(sql, 0 if sf_dir else 1).replace("@BACK1", "$1" if sf_dir else "\\1").replace("AS STRING", "AS STRING" if sf_dir else "AS VARCHAR")


def viewed(df: DataFrame) -> str:
    """A text that reads df, for `given`."""
    name = f"given_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return f"SELECT * FROM {name}"


def counted(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """posting, df, idf and often as stored tables, for `given`: the texts are split once, and small tables of terms are broadcast."""
    given = {"posting": viewed(kept(spark.sql(text(Query("SELECT aid, term, tf FROM posting"), sf_dir)), "postings"))}
    idf = kept(spark.sql(text(Query("SELECT term, df, idf FROM idf"), sf_dir, given)), "terms")
    often = kept(idf.filter("df >= 10"), "often")
    return given | {"df": viewed(sized(idf, "term", "df")), "idf": viewed(sized(idf, "term", "df", "idf")), "often": viewed(sized(often, "term", "df", "idf"))}


def run(query: Query, spark: SparkSession, sf_dir: str, given: dict[str, str] | None = None) -> DataFrame:
    """The query's rows. Postings that it needs several times are stored first, unless they are given."""
    named = _named(sf_dir, given)
    body = f"{query.ctes} {query.select}"
    texts = [body, *(named[n] for n in _needed(body, named))]
    if "posting" not in (given or {}) and sum(len(re.findall(r"\b(?:FROM|JOIN|,)\s+posting\b", x)) for x in texts) > 1:
        given = counted(spark, sf_dir) | (given or {})
    return spark.sql(text(query, sf_dir, given))
