"""DuckDB SQL for the correctness cross-check.

Each query in ``reposcope.plans.catalog`` has an independent SQL form here
that runs on the raw test tables (views ``events``, ``orders``, ``part``
…). The SQL follows the reference's own formulation where one exists (two
CTEs joined for growth, plain recursion for ranges, cross products for the
small oracle-only scans), so it checks the Spark plans rather than
repeating them. DuckDB 2.0 lambdas are written ``lambda x: …``.
"""

from __future__ import annotations

import re

from reposcope.plans import params as P

# Model views over the test tables, mirroring reposcope.sources.fixtures.
FIXTURE_SQL: dict[str, str] = {
    "f_stats": """
        SELECT CAST(user_id AS BIGINT) AS repository_id, ts AS event_time,
               CAST(ts AS DATE) AS event_date,
               CAST(floor(value * 100) AS BIGINT) AS stargazers_count,
               CAST(event_id % 7 AS BIGINT) AS watchers_count,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS forks_count,
               CAST(length(event_type) AS BIGINT) AS open_issues_count,
               ts - to_hours(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS pushed_at,
               value AS score
        FROM events""",
    "f_stats_long": """
        SELECT CAST(o_custkey AS BIGINT) AS repository_id, o_orderdate AS event_time,
               CAST(o_orderkey AS BIGINT) AS tie, CAST(o_orderdate AS DATE) AS event_date,
               CAST(floor(o_totalprice) AS BIGINT) AS stargazers_count,
               CAST(o_orderkey % 3 AS BIGINT) AS watchers_count,
               CAST(o_orderkey % 100 AS BIGINT) AS forks_count,
               CAST(length(o_orderpriority) AS BIGINT) AS open_issues_count,
               o_orderdate AS pushed_at, o_totalprice AS score
        FROM orders""",
    "f_stats_coarse": """
        SELECT CAST(o_custkey AS BIGINT) AS repository_id, o_orderdate AS event_time,
               CAST(o_orderkey AS BIGINT) AS tie, CAST(o_orderdate AS DATE) AS event_date,
               CAST(floor(o_totalprice) AS BIGINT) % 3 AS stargazers_count,
               CAST(0 AS BIGINT) AS watchers_count,
               CAST(o_orderkey % 2 AS BIGINT) AS forks_count,
               CAST(0 AS BIGINT) AS open_issues_count,
               o_orderdate AS pushed_at, o_totalprice AS score
        FROM orders""",
    "f_repos": """
        SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name,
               p_brand || '/' || p_name || '-' || CAST(p_partkey AS VARCHAR) AS full_name,
               CAST(p_partkey % 27 AS BIGINT) AS owner_id,
               p_type || ' ' || p_name AS description,
               'https://github.com/' || p_brand || '/' || p_name || '-' || CAST(p_partkey AS VARCHAR) AS html_url,
               'main' AS default_branch,
               CASE WHEN p_partkey % 6 < 5 THEN CAST(p_partkey % 6 AS VARCHAR) END AS license_key,
               TIMESTAMP '2020-01-01 00:00:00' AS created_at,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(p_partkey % 60 AS INTEGER)) AS last_crawled_at
        FROM part""",
    "f_owners": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS login, 'Organization' AS type
        FROM nation""",
    "f_licenses": """
        SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name AS name, lower(r_name) AS spdx_id
        FROM region""",
    "f_topics": """
        SELECT DISTINCT repository_id, topic FROM (
            SELECT CAST(p_partkey AS BIGINT) AS repository_id,
                   unnest(list_concat([p_type], string_split(p_name, ' '))) AS topic
            FROM part) WHERE topic <> ''""",
    "f_tags": """
        SELECT DISTINCT repository_id, tag FROM (
            SELECT CAST(p_partkey AS BIGINT) AS repository_id,
                   unnest(['v' || CAST(p_size AS VARCHAR), p_brand]) AS tag
            FROM part)""",
    "f_langs": """
        SELECT CAST(l_partkey AS BIGINT) AS repository_id, l_returnflag || l_linestatus AS language,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size
        FROM lineitem GROUP BY 1, 2""",
    "f_views": """
        SELECT 'u' || CAST(user_id AS VARCHAR) AS session_id,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS repository_id,
               ts AS viewed_at
        FROM events WHERE event_type IN ('view', 'click')""",
    "f_posted": """
        SELECT CAST(p_partkey AS BIGINT) AS repository_id,
               TIMESTAMP '2023-12-01 00:00:00' AS posted_at
        FROM part WHERE p_partkey % 3 = 0""",
    "f_range": """
        SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(floor(o_totalprice) AS BIGINT) AS v
        FROM orders""",
    # Enriched repositories (inner owner, left licence, aggregated children).
    "f_enriched": """
        SELECT r.id, r.name, r.full_name, r.description, r.html_url, r.default_branch,
               r.created_at, r.last_crawled_at, o.login AS owner_login, li.name AS license_name,
               COALESCE(tg.tags, []) AS tags, COALESCE(tp.topics, []) AS topics,
               COALESCE(lg.langs, []) AS langs, COALESCE(lg.lang_names, []) AS lang_names,
               COALESCE(pl.language, 'Unknown') AS language
        FROM f_repos r
        JOIN f_owners o ON r.owner_id = o.id
        LEFT JOIN f_licenses li ON r.license_key = li.key
        LEFT JOIN (SELECT repository_id, list(tag ORDER BY tag) AS tags FROM f_tags GROUP BY 1) tg
               ON r.id = tg.repository_id
        LEFT JOIN (SELECT repository_id, list(topic ORDER BY topic) AS topics FROM f_topics GROUP BY 1) tp
               ON r.id = tp.repository_id
        LEFT JOIN (SELECT repository_id, list(language || ':' || CAST(size AS VARCHAR) ORDER BY language) AS langs,
                          list(language ORDER BY language) AS lang_names
                   FROM f_langs GROUP BY 1) lg
               ON r.id = lg.repository_id
        LEFT JOIN (SELECT repository_id, language FROM (
                       SELECT *, row_number() OVER (PARTITION BY repository_id
                                                    ORDER BY size DESC, language DESC) AS rn
                       FROM f_langs) WHERE rn = 1) pl
               ON r.id = pl.repository_id""",
}

# Exact cosine top-k over all vectors (self excluded), written as a plain
# dimension-wise join + sum, independent of the blocked numpy plan.
FIXTURE_SQL["f_unit"] = """
        SELECT id, i, x / n AS x FROM (
            SELECT id, i, x, sqrt(sum(x * x) OVER (PARTITION BY id)) AS n FROM (
                SELECT CAST(vec_id AS BIGINT) AS id, CAST(unnest(embedding) AS DOUBLE) AS x,
                       unnest(range(len(embedding))) AS i
                FROM embeddings)) WHERE n > 0"""
FIXTURE_SQL["f_topk"] = f"""
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY cosine DESC, candidate_id) AS rank
            FROM (SELECT a.id AS source_id, b.id AS candidate_id, sum(a.x * b.x) AS cosine
                  FROM f_unit a JOIN f_unit b ON a.i = b.i AND a.id <> b.id GROUP BY 1, 2))
        WHERE rank <= {P.SIMILARITY_K}"""
FIXTURE_SQL["f_hybrid"] = """
        SELECT source_id, candidate_id, cosine, topic_score, language_score,
               0.6 * cosine + 0.3 * topic_score + 0.1 * language_score AS score,
               row_number() OVER (PARTITION BY source_id ORDER BY crank) AS rank
        FROM (SELECT t.source_id, t.candidate_id, t.cosine, t.rank AS crank,
                     CASE WHEN len(list_distinct(list_concat(s.topics, c.topics))) = 0 THEN 0.0
                          ELSE len(list_intersect(s.topics, c.topics))
                               / len(list_distinct(list_concat(s.topics, c.topics))) END AS topic_score,
                     CASE WHEN len(list_distinct(list_concat(s.lang_names, c.lang_names))) = 0 THEN 0.0
                          ELSE len(list_intersect(s.lang_names, c.lang_names))
                               / len(list_distinct(list_concat(s.lang_names, c.lang_names))) END AS language_score
              FROM f_topk t JOIN f_enriched s ON s.id = t.source_id
                            JOIN f_enriched c ON c.id = t.candidate_id)"""

# Which fixture views each view needs (in dependency order).
_DEPS = {
    "f_topk": ["f_unit"],
    "f_hybrid": ["f_topk", "f_enriched"],
    "f_enriched": ["f_repos", "f_owners", "f_licenses", "f_tags", "f_topics", "f_langs"],
}


def sql(body: str, *views: str) -> str:
    """Prefix ``body`` with the CTEs of ``views`` (dependencies first)."""
    order: list[str] = []

    def add(v: str) -> None:
        for d in _DEPS.get(v, []):
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    if not order:
        return body
    ctes = ",\n".join(f"{v} AS ({FIXTURE_SQL[v]})" for v in order)
    body = body.strip()
    m = re.match(r"(?is)^with\s+recursive\s+", body)
    if m:
        return f"WITH RECURSIVE {ctes},\n{body[m.end():]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _ts(value) -> str:
    return f"TIMESTAMP '{value}'"


def _growth(view: str, cutoff: str, order: str) -> str:
    """Reference-shaped growth: latest and past CTEs joined, LIMIT 200."""
    return f"""
    WITH ranked AS (
        SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY {order}) AS rn_all
        FROM {view}),
    latest AS (
        SELECT repository_id, stargazers_count AS latest_stars, forks_count AS latest_forks
        FROM ranked WHERE rn_all = 1),
    past_ranked AS (
        SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY {order}) AS rn_past
        FROM {view} WHERE event_time <= {_ts(cutoff)}),
    past AS (
        SELECT repository_id, stargazers_count AS past_stars, forks_count AS past_forks
        FROM past_ranked WHERE rn_past = 1),
    g AS (
        SELECT l.repository_id, latest_stars - past_stars AS star_growth,
               latest_forks - past_forks AS fork_growth,
               (latest_stars - past_stars) + (latest_forks - past_forks) AS growth
        FROM latest l JOIN past p ON l.repository_id = p.repository_id
        WHERE l.latest_stars > p.past_stars OR l.latest_forks > p.past_forks)
    SELECT repository_id, star_growth, fork_growth, growth,
           row_number() OVER (ORDER BY growth DESC, repository_id) AS rank
    FROM g ORDER BY growth DESC, repository_id LIMIT {P.TRENDING_LIMIT}"""


def _pick(view: str, order: str, desc: bool) -> str:
    d = "DESC" if desc else "ASC"
    return f"""
    SELECT repository_id, event_time, stargazers_count, watchers_count, forks_count,
           open_issues_count, pushed_at, round(score, 6) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY {order} {d}) AS rn
          FROM {view}) WHERE rn = 1"""


def changed_sql() -> str:
    return sql("""
        SELECT repository_id, event_time, tie, stargazers_count, watchers_count, forks_count,
               open_issues_count
        FROM (SELECT *,
                     lag(stargazers_count) OVER w AS p_s, lag(watchers_count) OVER w AS p_w,
                     lag(forks_count) OVER w AS p_f, lag(open_issues_count) OVER w AS p_i,
                     row_number() OVER w AS rn
              FROM f_stats_coarse WINDOW w AS (PARTITION BY repository_id ORDER BY event_time, tie))
        WHERE rn = 1 OR stargazers_count IS DISTINCT FROM p_s OR watchers_count IS DISTINCT FROM p_w
           OR forks_count IS DISTINCT FROM p_f OR open_issues_count IS DISTINCT FROM p_i""",
                                 "f_stats_coarse")


def oracle_sql() -> dict[str, str]:
    from reposcope.plans.oracle_more import more
    q: dict[str, str] = {}
    q.update(more())
    ev_cut = P.EVENTS_CUTOFF
    q["trending_growth"] = sql(_growth("f_stats", ev_cut, "event_time DESC"), "f_stats")
    q["trending_growth_30d"] = sql(_growth("f_stats_long", P.ORDERS_CUTOFF, "event_time DESC, tie DESC"),
                                   "f_stats_long")
    q["trending_rollup"], q["trending_rollup_30d"] = q["trending_growth"], q["trending_growth_30d"]
    q["latest_counters"] = sql("""
        SELECT repository_id, arg_max(stargazers_count, event_time) AS latest_stars,
               arg_max(forks_count, event_time) AS latest_forks
        FROM f_stats GROUP BY repository_id""", "f_stats")
    q["past_counters"] = sql(f"""
        SELECT repository_id, arg_max(stargazers_count, event_time) AS past_stars,
               arg_max(forks_count, event_time) AS past_forks
        FROM f_stats WHERE event_time <= {_ts(ev_cut)} GROUP BY repository_id""", "f_stats")
    q["latest_stat"] = sql(_pick("f_stats", "event_time", True), "f_stats")
    q["first_stat"] = sql(_pick("f_stats", "event_time", False), "f_stats")
    q["last_update"] = sql("""
        SELECT repository_id, max(event_time) AS event_time FROM f_stats GROUP BY repository_id""",
                           "f_stats")
    q["stats_history"] = sql("""
        SELECT repository_id, event_time, stargazers_count, watchers_count, forks_count,
               open_issues_count, pushed_at, round(score, 6) AS score,
               row_number() OVER (PARTITION BY repository_id ORDER BY event_time DESC) AS rn
        FROM f_stats""", "f_stats")
    q["recently_pushed"] = sql(f"""
        SELECT DISTINCT repository_id FROM f_stats
        WHERE (repository_id, event_time) IN (
            SELECT repository_id, max(event_time) FROM f_stats GROUP BY repository_id)
          AND pushed_at > {_ts(P.EVENTS_SINCE)}""", "f_stats")
    q["snapshots_by_month"] = sql("""
        SELECT strftime(event_time, '%Y%m') AS event_month, count(*) AS n_snapshots,
               CAST(sum(stargazers_count) AS BIGINT) AS sum_stars
        FROM f_stats_long GROUP BY 1""", "f_stats_long")
    q["snapshots_changed"] = changed_sql()
    q["dedupe_global"] = sql("""
        SELECT repository_id, event_time, tie, stargazers_count, watchers_count, forks_count,
               open_issues_count
        FROM (SELECT *, row_number() OVER (
                  PARTITION BY repository_id, stargazers_count, watchers_count, forks_count,
                               open_issues_count
                  ORDER BY event_time, tie) AS rn
              FROM f_stats_coarse) WHERE rn = 1""", "f_stats_coarse")
    q["state_hash"] = sql("""
        SELECT repository_id, event_time, tie,
               count(*) OVER (PARTITION BY repository_id, stargazers_count, watchers_count, forks_count,
                                           open_issues_count) AS n_same
        FROM f_stats_coarse""", "f_stats_coarse")
    q["snapshot_sink"] = sql(f"""
        SELECT strftime(event_time, '%Y%m') AS event_month, repository_id, event_time, tie, stargazers_count,
               watchers_count, forks_count, open_issues_count
        FROM f_stats_long WHERE strftime(event_time, '%Y%m') >= '{P.SINK_MONTH}'""", "f_stats_long")
    q["snapshot_rewrite"] = q["dedupe_global"]
    q["dedupe_check"] = sql("""
        SELECT (SELECT count(*) FROM f_stats_coarse) AS n_before,
               (SELECT count(*) FROM (SELECT DISTINCT repository_id, stargazers_count, watchers_count,
                                             forks_count, open_issues_count FROM f_stats_coarse)) AS n_after
        """, "f_stats_coarse")
    return q
