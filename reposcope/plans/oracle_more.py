"""Oracle SQL for the enrichment, facet, feed, similarity, text, range,
ingest and upsert queries (see ``reposcope.plans.oracle``)."""

from __future__ import annotations

from reposcope.plans import params as P
from reposcope.plans.oracle import _growth, _ts, sql


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


FACET_WHERE = (f"id IN (SELECT repository_id FROM f_langs WHERE language IN {_in(P.FACET_LANGUAGES)}) "
               f"AND id IN (SELECT repository_id FROM f_tags WHERE tag IN {_in(P.FACET_TAGS)}) "
               f"AND id IN (SELECT repository_id FROM f_topics WHERE topic IN {_in(P.FACET_TOPICS)})")

ENRICHED_FLAT = """id, name, full_name, owner_login, license_name,
    array_to_string(tags, ',') AS tags, array_to_string(topics, ',') AS topics,
    array_to_string(langs, ',') AS languages"""

TREND_EV = _growth("f_stats", P.EVENTS_CUTOFF, "event_time DESC")
TREND_OR = _growth("f_stats_long", P.ORDERS_CUTOFF, "event_time DESC, tie DESC")


def more() -> dict[str, str]:
    q: dict[str, str] = {}
    q["repository_enriched"] = sql(f"""
        SELECT {ENRICHED_FLAT}, created_at, last_crawled_at FROM f_enriched""", "f_enriched")
    q["repository_detail"] = sql("""
        WITH want AS (SELECT DISTINCT repository_id AS id FROM f_views),
        st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id
                                                           ORDER BY event_time DESC) AS rn
                              FROM f_stats) WHERE rn = 1)
        SELECT """ + ENRICHED_FLAT + """, e.language,
               st.stargazers_count, st.forks_count, st.watchers_count, st.open_issues_count,
               st.pushed_at, st.event_time AS stat_time
        FROM f_enriched e JOIN want w USING (id)
        LEFT JOIN st ON st.repository_id = e.id""", "f_enriched", "f_views", "f_stats")
    q["repositories_by_ids"] = sql(f"""
        WITH tr AS ({TREND_EV})
        SELECT tr.rank, {ENRICHED_FLAT} FROM tr JOIN f_enriched e ON e.id = tr.repository_id""",
                                   "f_enriched", "f_stats")
    q["repository_ids_page"] = sql(f"""
        SELECT id FROM f_repos ORDER BY id LIMIT {P.ID_PAGE_LIMIT} OFFSET {P.ID_PAGE_OFFSET}""",
                                   "f_repos")
    for name, cols, order in (("repository_ids_deep_page", "id", "id"),
                              ("recent_list_deep_page", "id, last_crawled_at", "last_crawled_at DESC, id")):
        q[name] = sql(f"""
            SELECT {cols}, rank FROM (SELECT {cols}, row_number() OVER (ORDER BY {order}) AS rank, count(*) OVER () AS n FROM f_repos)
            WHERE rank > n * 9 // 10 AND rank <= n * 9 // 10 + {P.ID_PAGE_LIMIT}""", "f_repos")
    q["crawled_since"] = sql(f"""
        SELECT id FROM f_repos WHERE last_crawled_at >= {_ts(P.CRAWLED_SINCE)}""", "f_repos")
    q["facet_filter"] = sql(f"""
        WITH tr AS ({TREND_OR})
        SELECT repository_id, rank FROM tr
        WHERE repository_id IN (SELECT repository_id FROM f_langs WHERE language IN {_in(P.FACET_LANGUAGES)})
          AND repository_id IN (SELECT repository_id FROM f_tags WHERE tag IN {_in(P.FACET_TAGS)})
          AND repository_id IN (SELECT repository_id FROM f_topics WHERE topic IN {_in(P.FACET_TOPICS)})""",
                            "f_stats_long", "f_langs", "f_tags", "f_topics")
    q["recent_crawled_list"] = sql(f"""
        WITH base AS (SELECT id AS repository_id, last_crawled_at FROM f_repos WHERE {FACET_WHERE}),
        sess AS (SELECT DISTINCT session_id FROM f_views),
        seen AS (SELECT DISTINCT session_id, repository_id FROM f_views),
        c AS (SELECT s.session_id, b.repository_id, b.last_crawled_at FROM sess s CROSS JOIN base b
              WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.session_id = s.session_id
                                AND x.repository_id = b.repository_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id
                                           ORDER BY last_crawled_at DESC, repository_id) AS position FROM c)
        SELECT session_id, position, repository_id, last_crawled_at FROM r
        WHERE position <= {P.RECENT_LIST_LIMIT}""", "f_repos", "f_langs", "f_tags", "f_topics", "f_views")
    q["facet_filter_indexed"] = q["facet_filter"]
    q["recent_crawled_stored"] = q["recent_crawled_list"]
    q["duration_texts"] = sql("""
        WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS BIGINT) AS n, CAST(p_partkey % 60 AS BIGINT) AS m FROM part)
        SELECT id, CASE id % 5 WHEN 0 THEN n || ' months' WHEN 1 THEN '-' || n || ' years' WHEN 2 THEN n || 'h' || m || 'm'
                               WHEN 3 THEN ' -' || m || '.5s' || n || 'ms ' ELSE n || ' h' END AS text,
               CASE id % 5 WHEN 0 THEN n * 30 * 86400000000 WHEN 1 THEN -n * 365 * 86400000000 WHEN 2 THEN (n * 60 + m) * 60000000
                           WHEN 3 THEN -(m * 1000000 + 500000 + n * 1000) END AS micros FROM t""")
    q["parse_facets"] = sql("""
        WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS id,
                          CASE WHEN p_partkey % 5 = 0 THEN ''
                               WHEN p_partkey % 7 = 0 THEN replace(p_name, ' ', ',') || ',' || p_type || ','
                               ELSE replace(p_name, ' ', ',') || ',' || p_type END AS request FROM part),
        p AS (SELECT id, request, CASE WHEN request = '' THEN CAST([] AS VARCHAR[])
                                       ELSE list_sort(string_split(request, ',')) END AS parsed FROM t)
        SELECT id, array_to_string(parsed, '|') AS parsed, CAST(len(parsed) AS BIGINT) AS n FROM p""")
    q["feed_rows"] = sql(f"""
        WITH tr AS ({TREND_EV}),
        st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id
                                                           ORDER BY event_time DESC) AS rn
                              FROM f_stats) WHERE rn = 1)
        SELECT tr.rank, e.id, e.name, e.full_name, COALESCE(e.description, '') AS description,
               COALESCE(st.stargazers_count, 0) AS stargazers_count,
               COALESCE(st.forks_count, 0) AS forks_count,
               COALESCE(st.watchers_count, 0) AS watchers_count,
               COALESCE(st.open_issues_count, 0) AS open_issues_count,
               COALESCE(regexp_replace(strftime(st.pushed_at, '%Y-%m-%dT%H:%M:%S.%fZ'), '\\.?0+Z$', 'Z'), '')
                   AS pushed_at,
               e.html_url || '/stargazers' AS stargazers_url, e.html_url || '/forks' AS forks_url,
               array_to_string(e.topics[1:5], ',') AS topics, e.language, e.license_name,
               concat_ws(' | ', e.license_name, strftime(st.pushed_at, '%Y-%m-%d')) AS footer
        FROM tr JOIN f_enriched e ON e.id = tr.repository_id
        LEFT JOIN st ON st.repository_id = e.id""", "f_enriched", "f_stats")
    q["feed_rows_first"] = q["feed_rows"].replace("ORDER BY event_time DESC) AS rn\n                              FROM f_stats) WHERE rn = 1)",
                                                  "ORDER BY event_time) AS rn\n                              FROM f_stats) WHERE rn = 1)")
    q["primary_language"] = sql("""
        SELECT r.id, COALESCE(pl.language, 'Unknown') AS language FROM f_repos r
        LEFT JOIN (SELECT repository_id, language FROM (
                     SELECT *, row_number() OVER (PARTITION BY repository_id
                                                  ORDER BY size DESC, language DESC) AS rn
                     FROM f_langs) WHERE rn = 1) pl ON pl.repository_id = r.id""", "f_repos", "f_langs")
    q["language_share"] = sql("""
        SELECT repository_id, language, size,
               round(size / sum(size) OVER (PARTITION BY repository_id) * 100, 6) AS share
        FROM f_langs QUALIFY sum(size) OVER (PARTITION BY repository_id) > 0""", "f_langs")
    q["language_color"] = sql("""
        SELECT repository_id,
               CASE language WHEN 'AF' THEN 'Go' WHEN 'NO' THEN 'C#' WHEN 'RF' THEN 'TypeScript' ELSE language END AS language,
               CASE language WHEN 'AF' THEN '#00ADD8' WHEN 'NO' THEN '#178600' WHEN 'RF' THEN '#3178c6'
                             ELSE '#808080' END AS color
        FROM f_langs""", "f_langs")
    q["readme_candidates"] = sql(f"""
        SELECT id AS repository_id,
               CASE WHEN id % 4 <> 0 THEN '{P.README_BASE}/' || full_name || '/' || default_branch || '/README.md'
                    WHEN id % 3 = 0 THEN '{P.README_BASE}/' || full_name || '/' || default_branch || '/README.txt'
               END AS readme_url
        FROM f_repos""", "f_repos")
    q["session_views"] = sql("SELECT session_id, repository_id, viewed_at FROM f_views", "f_views")
    q["session_history"] = sql(f"""
        SELECT * FROM (SELECT session_id, repository_id, viewed_at,
                              row_number() OVER (PARTITION BY session_id
                                                 ORDER BY viewed_at DESC, repository_id DESC) AS rn
                       FROM f_views) WHERE rn <= {P.HISTORY_LIMIT}""", "f_views")
    q["session_seen"] = sql("SELECT DISTINCT session_id, repository_id FROM f_views", "f_views")
    q["session_seen_stored"] = q["session_seen"]
    q["feed_trending"] = sql(f"""
        WITH tr AS ({TREND_OR}),
        sess AS (SELECT DISTINCT session_id FROM f_views),
        seen AS (SELECT DISTINCT session_id, repository_id FROM f_views),
        c AS (SELECT s.session_id, tr.repository_id, tr.rank AS trank, tr.growth FROM sess s CROSS JOIN tr
              WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.session_id = s.session_id
                                AND x.repository_id = tr.repository_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY trank) AS rank FROM c)
        SELECT session_id, rank, repository_id, growth FROM r
        WHERE rank > 0 AND rank <= {P.PAGE_SIZE}""", "f_stats_long", "f_views")
    q.update(similarity())
    q.update(publishing())
    q.update(upserts())
    q.update(ingest())
    q.update(streaming())
    return q


def similarity() -> dict[str, str]:
    q: dict[str, str] = {}
    recent = f"""SELECT DISTINCT repository_id FROM f_stats
        WHERE (repository_id, event_time) IN (
            SELECT repository_id, max(event_time) FROM f_stats GROUP BY repository_id)
          AND pushed_at > {_ts(P.EVENTS_SINCE)}"""
    q["similar_topk"] = sql("""
        SELECT source_id, candidate_id, round(cosine, 6) AS cosine, rank FROM f_topk""", "f_topk")
    q["similar_topk_lsh"] = sql("""
        SELECT count(DISTINCT source_id) AS n_sources, CAST(0 AS BIGINT) AS short_lists, true AS recall_reached,
               true AS cosines_true FROM f_topk""", "f_topk")
    hy_out = """source_id, candidate_id, round(cosine, 6) AS cosine, round(topic_score, 6) AS topic_score,
               round(language_score, 6) AS language_score, round(score, 6) AS score, rank"""
    q["similarity_hybrid"] = sql(f"""
        SELECT {hy_out} FROM f_hybrid WHERE source_id IN ({recent})""", "f_hybrid", "f_stats")
    q["jaccard_pairs"] = sql("""
        SELECT t.source_id, t.candidate_id,
               round(CASE WHEN len(list_distinct(list_concat(COALESCE(s.topics, []), COALESCE(c.topics, [])))) = 0 THEN 0.0
                    ELSE len(list_intersect(COALESCE(s.topics, []), COALESCE(c.topics, [])))
                         / len(list_distinct(list_concat(COALESCE(s.topics, []), COALESCE(c.topics, [])))) END, 6)
                    AS topic_jaccard,
               round(CASE WHEN len(list_distinct(list_concat(COALESCE(s.lang_names, []), COALESCE(c.lang_names, [])))) = 0 THEN 0.0
                    ELSE len(list_intersect(COALESCE(s.lang_names, []), COALESCE(c.lang_names, [])))
                         / len(list_distinct(list_concat(COALESCE(s.lang_names, []), COALESCE(c.lang_names, [])))) END, 6)
                    AS language_jaccard
        FROM f_topk t LEFT JOIN f_enriched s ON s.id = t.source_id
                      LEFT JOIN f_enriched c ON c.id = t.candidate_id""", "f_topk", "f_enriched")
    q["similarity_json"] = sql("""
        SELECT source_id, candidate_id, round(score, 6) AS score, rank FROM f_hybrid""", "f_hybrid")
    q["upsert_similarity"] = sql(f"""
        WITH n AS (SELECT source_id AS id, count(*) AS n_items FROM f_hybrid GROUP BY source_id),
        cur AS (SELECT DISTINCT source_id AS id FROM f_hybrid WHERE source_id IN ({recent}))
        SELECT n.id, n.n_items, (cur.id IS NULL OR n.id % 3 = 0) AS updated
        FROM n LEFT JOIN cur ON cur.id = n.id""", "f_hybrid", "f_stats")
    q["embed_requests"] = sql(f"""
        WITH recent AS (SELECT DISTINCT repository_id FROM f_stats_long
            WHERE (repository_id, event_time) IN (
                SELECT repository_id, max(event_time) FROM f_stats_long GROUP BY repository_id)
              AND pushed_at > {_ts(P.ORDERS_SINCE)}),
        rc AS (SELECT id AS repository_id,
               CASE WHEN id % 4 <> 0 THEN '{P.README_BASE}/' || full_name || '/' || default_branch || '/README.md'
                    WHEN id % 3 = 0 THEN '{P.README_BASE}/' || full_name || '/' || default_branch || '/README.txt'
               END AS readme_url FROM f_repos)
        SELECT r.repository_id, printf('readmes/%d.md', r.repository_id) AS object_key,
               COALESCE(rc.readme_url, '') AS download_url
        FROM recent r LEFT JOIN rc ON rc.repository_id = r.repository_id
        WHERE r.repository_id NOT IN (SELECT CAST(vec_id AS BIGINT) FROM embeddings)""",
                                "f_stats_long", "f_repos")
    personal = f"""
        hist AS (SELECT * FROM (SELECT session_id, repository_id,
                     row_number() OVER (PARTITION BY session_id ORDER BY viewed_at DESC, repository_id DESC) AS rn
                 FROM f_views) WHERE rn <= {P.HISTORY_LIMIT}),
        cand AS (SELECT h.session_id, s.candidate_id AS repository_id, sum(s.score) AS score
                 FROM hist h JOIN f_hybrid s ON s.source_id = h.repository_id GROUP BY 1, 2),
        seen AS (SELECT DISTINCT session_id, repository_id FROM f_views),
        f AS (SELECT * FROM cand c WHERE NOT EXISTS (
                 SELECT 1 FROM seen x WHERE x.session_id = c.session_id AND x.repository_id = c.repository_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, repository_id) AS rank
              FROM f)"""
    q["feed_personalized"] = sql(f"""
        WITH {personal}
        SELECT session_id, rank, repository_id, round(score, 6) AS score FROM r
        WHERE rank <= {P.PAGE_SIZE}""", "f_hybrid", "f_views")
    q["feed_page"] = sql(f"""
        WITH {personal},
        tr AS ({TREND_OR}),
        cold AS (SELECT 'new' || CAST(n_nationkey AS VARCHAR) AS session_id FROM nation)
        SELECT session_id, rank, repository_id, round(score, 6) AS score, 'personalized' AS source FROM r
        WHERE rank > {P.PAGE_SIZE} AND rank <= {2 * P.PAGE_SIZE}
        UNION ALL
        SELECT session_id, rank, repository_id, CAST(growth AS DOUBLE), 'trending' FROM cold CROSS JOIN tr
        WHERE rank > {P.PAGE_SIZE} AND rank <= {2 * P.PAGE_SIZE}""", "f_hybrid", "f_views", "f_stats_long")
    wanted = f"""repository_id IN (SELECT repository_id FROM f_langs WHERE language IN {_in(P.FACET_LANGUAGES)})
          AND repository_id IN (SELECT repository_id FROM f_topics WHERE topic IN {_in(P.FEED_FACET_TOPICS)})"""
    q["feed_personalized_facets"] = sql(f"""
        WITH {personal.replace("FROM cand c WHERE", f"FROM cand c WHERE {wanted} AND")}
        SELECT session_id, rank, repository_id, round(score, 6) AS score FROM r
        WHERE rank <= {P.PAGE_SIZE}""", "f_hybrid", "f_views", "f_langs", "f_topics")
    q["feed_trending_facets"] = sql(f"""
        WITH tr AS ({TREND_OR}),
        kept AS (SELECT * FROM tr WHERE {wanted}),
        sess AS (SELECT DISTINCT session_id FROM f_views
                 UNION ALL SELECT 'new' || CAST(n_nationkey AS VARCHAR) FROM nation),
        r AS (SELECT s.session_id, k.repository_id, k.growth,
                     row_number() OVER (PARTITION BY s.session_id ORDER BY k.rank) AS rank
              FROM sess s CROSS JOIN kept k
              WHERE NOT EXISTS (SELECT 1 FROM f_views v WHERE v.session_id = s.session_id
                                                          AND v.repository_id = k.repository_id)),
        st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY event_time DESC) AS rn
                              FROM f_stats) WHERE rn = 1)
        SELECT r.session_id, r.rank, r.repository_id, r.growth, e.full_name,
               COALESCE(st.stargazers_count, 0) AS stargazers_count, e.language,
               array_to_string(e.topics[1:5], ',') AS topics
        FROM r JOIN f_enriched e ON e.id = r.repository_id LEFT JOIN st ON st.repository_id = r.repository_id
        WHERE r.rank <= {P.PAGE_SIZE}""", "f_stats_long", "f_stats", "f_views", "f_enriched", "f_langs", "f_topics")
    return q


RE2_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _leaves() -> str:
    return f"""
        WITH RECURSIVE r(lo, hi) AS (
            SELECT CAST({P.RANGE_LO} AS BIGINT), CAST({P.RANGE_HI} AS BIGINT)
            UNION ALL
            SELECT c.lo, c.hi FROM r,
                LATERAL (SELECT (SELECT count(*) FROM f_range WHERE v BETWEEN r.lo AND r.hi) AS n) q,
                LATERAL (VALUES (r.lo, r.lo + (r.hi - r.lo) // 2), (r.lo + (r.hi - r.lo) // 2 + 1, r.hi)) c(lo, hi)
            WHERE q.n > {P.RANGE_CAP} AND r.lo < r.hi),
        counted AS (SELECT lo, hi, (SELECT count(*) FROM f_range WHERE v BETWEEN r.lo AND r.hi) AS n FROM r)
        SELECT lo, hi, n FROM counted WHERE (n <= {P.RANGE_CAP} OR lo = hi) AND n > 0"""


def publishing() -> dict[str, str]:
    q: dict[str, str] = {}
    nxt = f"""
        WITH tr AS ({TREND_EV})
        SELECT repository_id, rank FROM tr
        WHERE repository_id NOT IN (SELECT repository_id FROM f_posted)
          AND repository_id IN (SELECT id FROM f_enriched)
        ORDER BY rank LIMIT 1"""
    q["next_to_post"] = sql(nxt, "f_stats", "f_posted", "f_enriched")
    q["mark_posted"] = sql(f"""
        WITH nxt AS ({nxt.replace("WITH tr AS", "SELECT * FROM (WITH tr AS")}))
        SELECT repository_id, posted_at FROM f_posted
        UNION ALL
        SELECT repository_id, TIMESTAMP '2024-01-31 00:00:00' AS posted_at FROM nxt""",
                           "f_stats", "f_posted", "f_enriched")
    nl = "chr(10)"
    q["post_text"] = sql(f"""
        WITH b AS (SELECT id, full_name, COALESCE(description, '') AS summary,
                          list_transform(lang_names, lambda x: '#' || replace(x, ' ', '')) AS lt,
                          list_transform(list_filter(topics, lambda t: strlen(t) <= 15),
                                         lambda t: '#' || replace(t, '-', '')) AS tt
                   FROM f_enriched),
        c AS (SELECT *, '🚀 Trending on GitHub: ' || full_name || {nl} || {nl} AS head,
                     {nl} || {nl} || '🔗 {P.BASE_URL}/repository/' || CAST(id AS VARCHAR) || {nl} || {nl}
                     || array_to_string(list_concat(lt, tt[1:greatest(0, 4 - len(lt))]), ' ') AS tail
              FROM b),
        d AS (SELECT *, {P.POST_LIMIT_BYTES} - strlen(head) - strlen(tail) AS remaining FROM c)
        SELECT id AS repository_id,
               head || CASE WHEN strlen(summary) > remaining
                            THEN left(summary, list_max(list_filter(range(0, greatest(0, remaining - 3) + 1),
                                      lambda k: strlen(left(summary, k)) <= greatest(0, remaining - 3)))) || '...'
                            ELSE summary END || tail AS text
        FROM d""", "f_enriched")
    q["post_text_documents"] = q["post_text"].replace(
        "COALESCE(description, '') AS summary", "x.text AS summary").replace(
        "FROM f_enriched),\n        c AS", "FROM f_enriched JOIN documents x ON x.doc_id = id),\n        c AS")
    q["posting_job"] = q["post_text"].replace("SELECT id AS repository_id,", f"""
        , nxt AS (SELECT repository_id, rank FROM ({TREND_EV}) tr
                  WHERE repository_id NOT IN (SELECT repository_id FROM f_posted)
                    AND repository_id IN (SELECT id FROM f_enriched) ORDER BY rank LIMIT 3),
        marked AS (SELECT repository_id, posted_at FROM f_posted
                   UNION ALL SELECT repository_id, TIMESTAMP '2024-01-31 00:00:00' FROM nxt)
        SELECT marked.repository_id, marked.posted_at, CAST(nxt.rank AS DOUBLE) AS rank,
               CASE WHEN nxt.rank IS NULL THEN '' ELSE""", 1).replace(
        "ELSE summary END || tail AS text\n        FROM d", "ELSE summary END || tail END AS text\n        FROM marked LEFT JOIN nxt USING (repository_id) LEFT JOIN d ON d.id = marked.repository_id")
    q["posting_job"] = sql(q["posting_job"], "f_posted", "f_stats")
    q["publish_messages"] = sql(f"""
        SELECT DISTINCT repository_id, printf('readmes/%d.md', repository_id) AS object_key FROM f_stats
        WHERE (repository_id, event_time) IN (SELECT repository_id, max(event_time) FROM f_stats GROUP BY repository_id)
          AND pushed_at > {_ts(P.EVENTS_SINCE)}""", "f_stats")
    sp = RE2_SPACE
    q["html_snippet"] = f"""
        SELECT page_id, substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                   regexp_replace(html, '(?s)<style[^>]*>.*</style>', '', 'g'),
                   '(?s)<script[^>]*>.*</script>', '', 'g'),
                   '<[^>]+>', ' ', 'g'),
                   '{sp}{{2,}}', ' ', 'g'),
                   '^{sp}+|{sp}+$', '', 'g'), 1, {P.SNIPPET_CHARS}) AS snippet
        FROM pages"""
    q["page_meta"] = sql(f"""
        SELECT id AS repository_id, full_name || ' - reposcope' AS title,
               COALESCE(description, '') AS description,
               '{P.BASE_URL}/api/og?id=' || CAST(id AS VARCHAR) AS og_image
        FROM f_repos""", "f_repos")
    # The share-page meta block.
    meta_block = (
        "\n<title>%s</title>\n"
        "<meta name=\"description\" content=\"%s\">\n"
        "<meta property=\"og:title\" content=\"%s\">\n"
        "<meta property=\"og:description\" content=\"%s\">\n"
        "<meta property=\"og:image\" content=\"%s\">\n"
        "<meta property=\"twitter:card\" content=\"summary_large_image\">\n"
        "<meta property=\"twitter:title\" content=\"%s\">\n"
        "<meta property=\"twitter:description\" content=\"%s\">\n"
        "<meta property=\"twitter:image\" content=\"%s\">\n")
    title_re = r"<title>[^\n\r\x{2028}\x{2029}]*?</title>"
    og = f"'{P.BASE_URL}/api/og?id=' || CAST(id AS VARCHAR)"
    q["page_render"] = sql(f"""
        WITH m AS (
            SELECT id AS page_id,
                   printf('{meta_block}', full_name || ' - reposcope', COALESCE(description, ''), full_name,
                          COALESCE(description, ''), {og}, full_name, COALESCE(description, ''), {og}) AS meta
            FROM f_repos),
        x AS (SELECT p.page_id, p.html, m.meta, regexp_extract(p.html, '{title_re}', 0) AS found
              FROM pages p JOIN m ON m.page_id = p.page_id),
        y AS (SELECT page_id, CASE WHEN found = '' THEN html
                                   ELSE substring(html, 1, instr(html, found) - 1) || meta
                                        || substring(html, instr(html, found) + length(found)) END AS out
              FROM x)
        SELECT page_id, CAST(length(out) AS BIGINT) AS n_chars, sha256(out) AS html_sha256 FROM y""", "f_repos")
    # What marks a crawler's user agent.
    agents = ("googlebot,yahoo! slurp,bingbot,yandex,baiduspider,facebookexternalhit,twitterbot,rogerbot,linkedinbot,"
              "embedly,quora link preview,showyoubot,outbrain,pinterest/0.,pinterestbot,slackbot,vkshare,w3c_validator,"
              "redditbot,applebot,whatsapp,flipboard,tumblr,bitlybot,skypeuripreview,nuzzel,discordbot,"
              "google page speed,qwantify").split(",")
    cond = " OR ".join(f"contains(lower(ua), '{b}')" for b in agents)
    q["bot_flag"] = f"""
        SELECT doc_id, ({cond}) AS is_bot FROM (
            SELECT doc_id, COALESCE(text, '') || CASE doc_id % 6
                       WHEN 0 THEN ' Mozilla/5.0 (compatible; Googlebot/2.1)' WHEN 1 THEN ' W3C_Validator/1.3'
                       WHEN 2 THEN ' WhatsApp/2.2' WHEN 3 THEN ' Google Page Speed Insights'
                       WHEN 4 THEN ' google bot' ELSE '' END AS ua
            FROM documents)"""
    # Hashed bag-of-words vectors: one 384-d vector per text, unit norm when
    # the text has a letter or digit token, else all zeros.
    q["embed_texts"] = r"""
        SELECT CAST(doc_id AS BIGINT) AS repository_id, CAST(384 AS BIGINT) AS n_dims,
               CASE WHEN regexp_matches(COALESCE(text, ''), '[\p{L}\p{N}]') THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS norm
        FROM documents"""
    q["readme_text"] = """
        SELECT CAST(doc_id AS BIGINT) AS repository_id, printf('readmes/%d.md', doc_id) AS object_key,
               CAST(length(text) AS BIGINT) AS n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes,
               sha256(text) AS body_sha256
        FROM documents"""
    q["adaptive_ranges"] = sql(_leaves(), "f_range")
    q["range_pages"] = sql(f"""
        WITH lv AS ({_leaves().replace("WITH RECURSIVE", "SELECT * FROM (WITH RECURSIVE")})),
        x AS (SELECT lv.lo, lv.hi, f.id, f.v FROM f_range f JOIN lv ON f.v BETWEEN lv.lo AND lv.hi)
        SELECT lo, hi, CAST((row_number() OVER (PARTITION BY lo, hi ORDER BY v, id) - 1) // {P.RANGE_PAGE} + 1
                            AS BIGINT) AS page, id
        FROM x""", "f_range")
    return q


def upserts() -> dict[str, str]:
    q: dict[str, str] = {}
    q["upsert_owners"] = """
        WITH cur AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS login, 'Organization' AS type FROM nation),
        msg AS (SELECT CAST(p_partkey % 30 AS BIGINT) AS id,
                       'owner' || CAST(p_partkey % 30 AS VARCHAR) || '-' || CAST(p_partkey AS VARCHAR) AS login,
                       'User' AS type, p_partkey AS seq FROM part),
        first_msg AS (SELECT id, login, type FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM msg) WHERE rn = 1)
        SELECT * FROM cur
        UNION ALL SELECT * FROM first_msg WHERE id NOT IN (SELECT id FROM cur)"""
    q["upsert_licenses"] = """
        WITH RECURSIVE
        cur AS (SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name AS name, lower(r_name) AS spdx_id,
                       CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS node_id FROM region),
        raw AS (SELECT CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_partkey % 7 AS VARCHAR) END AS key,
                       CASE WHEN p_partkey % 50 = 0 THEN 'LIC-' || CAST(p_partkey % 7 AS VARCHAR) || '-B'
                            ELSE 'LIC-' || CAST(p_partkey % 7 AS VARCHAR) END AS name,
                       CAST(NULL AS VARCHAR) AS url, 'n' || CAST(p_partkey AS VARCHAR) AS node_id,
                       p_partkey AS seq FROM part),
        msg AS (SELECT key, name, lower(name) AS spdx_id, url, node_id,
                       row_number() OVER (PARTITION BY key ORDER BY seq) AS rn
                FROM raw WHERE key IS NOT NULL),
        keys AS (SELECT key FROM cur UNION SELECT key FROM msg),
        st(key, rn, present, name, spdx_id, url, node_id) AS (
            SELECT k.key, 0, c.key IS NOT NULL, c.name, c.spdx_id, c.url, c.node_id
            FROM keys k LEFT JOIN cur c ON c.key = k.key
            UNION ALL
            SELECT m.key, m.rn, true,
                   m.name, m.spdx_id, m.url,
                   CASE WHEN NOT st.present OR st.name IS DISTINCT FROM m.name
                             OR st.spdx_id IS DISTINCT FROM m.spdx_id OR st.url IS DISTINCT FROM m.url
                        THEN m.node_id ELSE st.node_id END
            FROM st JOIN msg m ON m.key = st.key AND m.rn = st.rn + 1)
        SELECT key, name, spdx_id, url, node_id FROM st
        WHERE present AND (key, rn) IN (SELECT key, max(rn) FROM st GROUP BY key)"""
    q["upsert_repositories"] = sql("""
        WITH RECURSIVE
        cur AS (SELECT id, name, description, CAST(NULL AS VARCHAR) AS homepage, license_key,
                       false AS is_archived, false AS is_disabled, last_crawled_at, created_at FROM f_repos),
        msg AS (SELECT CAST(o_custkey + 1000 AS BIGINT) AS id, 'n' || CAST(o_orderkey AS VARCHAR) AS name,
                       'd' || CAST(o_orderkey % 3 AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS homepage,
                       CASE WHEN o_orderkey % 5 <> 0 THEN '1' END AS license_key,
                       o_orderstatus = 'F' AS is_archived, false AS is_disabled,
                       o_orderdate AS last_crawled_at, o_orderdate AS created_at,
                       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
                FROM orders),
        keys AS (SELECT id FROM cur UNION SELECT id FROM msg),
        st(id, rn, present, name, description, homepage, license_key, is_archived, is_disabled,
           last_crawled_at, created_at) AS (
            SELECT k.id, 0, c.id IS NOT NULL, c.name, c.description, c.homepage, c.license_key,
                   c.is_archived, c.is_disabled, c.last_crawled_at, c.created_at
            FROM keys k LEFT JOIN cur c ON c.id = k.id
            UNION ALL
            SELECT m.id, m.rn, true,
                   CASE WHEN u.upd THEN m.name ELSE st.name END,
                   CASE WHEN u.upd THEN m.description ELSE st.description END,
                   CASE WHEN u.upd THEN m.homepage ELSE st.homepage END,
                   CASE WHEN u.upd THEN m.license_key ELSE st.license_key END,
                   CASE WHEN u.upd THEN m.is_archived ELSE st.is_archived END,
                   CASE WHEN u.upd THEN m.is_disabled ELSE st.is_disabled END,
                   CASE WHEN u.upd THEN m.last_crawled_at ELSE st.last_crawled_at END,
                   CASE WHEN st.present THEN st.created_at ELSE m.created_at END
            FROM st JOIN msg m ON m.id = st.id AND m.rn = st.rn + 1,
                 LATERAL (SELECT COALESCE(NOT st.present
                      OR st.description IS DISTINCT FROM m.description
                      OR st.homepage IS DISTINCT FROM m.homepage
                      OR st.license_key IS DISTINCT FROM m.license_key
                      OR st.is_archived IS DISTINCT FROM m.is_archived
                      OR st.is_disabled IS DISTINCT FROM m.is_disabled
                      OR st.last_crawled_at < m.last_crawled_at, false) AS upd) u)
        SELECT id, name, description, license_key, is_archived, last_crawled_at, created_at FROM st
        WHERE present AND (id, rn) IN (SELECT id, max(rn) FROM st GROUP BY id)""", "f_repos")
    q["upsert_bridges"] = sql("""
        WITH cur AS (
            SELECT repository_id, 'tag' AS kind, tag AS name, CAST(NULL AS BIGINT) AS size FROM f_tags
            UNION ALL SELECT repository_id, 'topic', topic, CAST(NULL AS BIGINT) FROM f_topics
            UNION ALL SELECT repository_id, 'lang', language, size FROM f_langs),
        msg AS (
            SELECT CAST(o_custkey AS BIGINT) AS repository_id, 'tag' AS kind, o_orderstatus AS name,
                   CAST(NULL AS BIGINT) AS size, o_orderkey AS seq FROM orders
            UNION ALL
            SELECT CAST(o_custkey AS BIGINT), 'lang', o_orderpriority, CAST(floor(o_totalprice) AS BIGINT),
                   o_orderkey FROM orders),
        allrows AS (SELECT *, 0 AS src, CAST(NULL AS BIGINT) AS seq FROM cur
                    UNION ALL SELECT repository_id, kind, name, size, 1, seq FROM msg)
        SELECT repository_id, kind, name, CAST(size AS DOUBLE) AS size FROM (
            SELECT *, row_number() OVER (PARTITION BY repository_id, kind, name
                                         ORDER BY src DESC, seq DESC NULLS LAST) AS rn FROM allrows)
        WHERE rn = 1""", "f_tags", "f_topics", "f_langs")
    q["upsert_vectors"] = """
        WITH allv AS (
            SELECT CAST(vec_id AS BIGINT) AS repository_id, embedding, 0 AS src FROM embeddings
            UNION ALL
            SELECT CAST(vec_id AS BIGINT), list_transform(embedding, lambda x: -x), 1 FROM embeddings WHERE label = 0
            UNION ALL
            SELECT CAST(vec_id + 100000 AS BIGINT), embedding, 1 FROM embeddings WHERE label = 1),
        pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY src DESC) AS rn
                                FROM allv) WHERE rn = 1)
        SELECT repository_id, CAST(len(embedding) AS BIGINT) AS n_dims,
               round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 4) AS by_place,
               round(CAST(embedding[1] AS DOUBLE), 6) AS e_first,
               round(CAST(embedding[-1] AS DOUBLE), 6) AS e_last
        FROM pick"""
    q["needs_crawl"] = sql("""
        SELECT s.repository_id, s.event_time, s.pushed_at, r.last_crawled_at,
               COALESCE(s.pushed_at >= r.last_crawled_at, true) AS needs_crawl
        FROM f_stats s LEFT JOIN f_repos r ON r.id = s.repository_id""", "f_stats", "f_repos")
    q["refresh_candidates"] = sql(f"""
        WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id
                                                                   ORDER BY event_time DESC) AS rn
                                       FROM f_stats) WHERE rn = 1)
        SELECT DISTINCT repository_id FROM f_stats
        WHERE (repository_id, event_time) IN (SELECT repository_id, max(event_time) FROM f_stats GROUP BY 1)
          AND pushed_at > {_ts(P.EVENTS_SINCE)}
        UNION
        SELECT l.repository_id FROM latest l LEFT JOIN f_repos r ON r.id = l.repository_id
        WHERE COALESCE(l.pushed_at >= r.last_crawled_at, true)""", "f_stats", "f_repos")
    return q


def ingest() -> dict[str, str]:
    q: dict[str, str] = {}
    q["ingest_search_pages"] = """
        SELECT CAST(p_partkey AS BIGINT) AS id,
               p_brand || '/' || p_name || '-' || CAST(p_partkey AS VARCHAR) AS full_name,
               CAST(p_partkey % 27 AS BIGINT) AS owner_id, 'owner' || CAST(p_partkey % 27 AS VARCHAR) AS owner_login,
               CASE WHEN p_partkey % 10 <> 0 THEN p_type || ' ' || p_name END AS description,
               CASE WHEN p_partkey % 6 < 5 THEN CAST(p_partkey % 6 AS VARCHAR) END AS license_key,
               CASE WHEN p_partkey % 6 < 5 THEN 'L' || CAST(p_partkey % 6 AS VARCHAR) END AS license_name,
               CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS language,
               CAST(p_size * 10 AS BIGINT) AS stargazers_count, CAST(p_size AS BIGINT) AS forks_count,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(p_partkey % 100 AS INTEGER)) AS pushed_at,
               array_to_string(list_concat([p_type], string_split(p_name, ' ')), ',') AS topics,
               count(*) OVER (PARTITION BY p_partkey // 100) AS total_count
        FROM part"""
    q["ingest_tags"] = sql("""
        SELECT repository_id, string_agg(tag, ',' ORDER BY tag) AS tags, count(*) AS n_tags
        FROM f_tags GROUP BY repository_id""", "f_tags")
    q["ingest_languages"] = sql("SELECT repository_id, language, size FROM f_langs", "f_langs")
    q["crawl_results"] = sql(f"""
        WITH d AS (SELECT id, full_name, default_branch,
                          TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(id % 100 AS INTEGER)) AS pushed_at
                   FROM f_repos),
        gate AS (SELECT d.* FROM d LEFT JOIN f_repos r ON r.id = d.id
                 WHERE COALESCE(d.pushed_at >= r.last_crawled_at, true)),
        tg AS (SELECT repository_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM f_tags GROUP BY 1),
        lg AS (SELECT repository_id, string_agg(language || ':' || CAST(size AS VARCHAR), ',' ORDER BY language)
                      AS languages FROM f_langs WHERE repository_id % 11 <> 0 GROUP BY 1),
        rc AS (SELECT id AS repository_id,
                   CASE WHEN id % 4 <> 0 THEN '{P.README_BASE}/' || full_name || '/' || default_branch || '/README.md'
                        WHEN id % 3 = 0 THEN '{P.README_BASE}/' || full_name || '/' || default_branch || '/README.txt'
                   END AS readme_url FROM f_repos)
        SELECT g.id AS repository_id, g.full_name, rc.readme_url, tg.tags, COALESCE(lg.languages, '') AS languages,
               TIMESTAMP '2024-02-02 00:00:00' AS crawled_at
        FROM gate g JOIN tg ON tg.repository_id = g.id LEFT JOIN lg ON lg.repository_id = g.id
        LEFT JOIN rc ON rc.repository_id = g.id""", "f_repos", "f_tags", "f_langs")
    q["ingest_readme_url"] = sql(f"""
        SELECT repository_id, readme_url AS download_url FROM (
            SELECT id AS repository_id,
                   CASE WHEN id % 4 <> 0 THEN '{P.README_BASE}/' || full_name || '/' || default_branch || '/README.md'
                        WHEN id % 3 = 0 THEN '{P.README_BASE}/' || full_name || '/' || default_branch || '/README.txt'
                   END AS readme_url FROM f_repos) WHERE readme_url IS NOT NULL""", "f_repos")
    return q


def streaming() -> dict[str, str]:
    from reposcope.plans.oracle import changed_sql
    q: dict[str, str] = {}
    q["stream_views"] = sql("SELECT session_id, repository_id, viewed_at FROM f_views", "f_views")
    q["stream_ingest"] = ingest()["ingest_search_pages"].replace(
        ",\n               count(*) OVER (PARTITION BY p_partkey // 100) AS total_count", "")
    q["stream_readmes"] = sql("""
        SELECT r.id AS repository_id, printf('readmes/%d.md', r.id) AS object_key,
               CAST(length(d.text) AS BIGINT) AS n_chars, sha256(d.text) AS body_sha256,
               'https://raw.githubusercontent.com/' || r.full_name || '/main/README.md' AS download_url
        FROM f_repos r JOIN documents d ON d.doc_id = r.id
        WHERE r.id % 4 <> 0 AND d.doc_id % 13 <> 0""", "f_repos")
    q["stream_dimensions"] = sql("""
        SELECT 'repositories' AS tbl, CAST(id AS VARCHAR) AS id, name, CASE WHEN id % 10 <> 0 THEN description END AS detail,
               license_key AS extra, CAST(NULL AS BIGINT) AS size,
               CASE WHEN id % 10 = 0 OR last_crawled_at < TIMESTAMP '2024-02-02 00:00:00'
                    THEN TIMESTAMP '2024-02-02 00:00:00' ELSE last_crawled_at END AS last_crawled_at, created_at
        FROM f_repos
        UNION ALL
        SELECT 'owners', CAST(n_nationkey AS VARCHAR), n_name, 'Organization', 'https://github.com/' || n_name, NULL, NULL, NULL FROM nation
        UNION ALL
        SELECT DISTINCT 'owners', CAST(p_partkey % 27 AS VARCHAR), 'owner' || CAST(p_partkey % 27 AS VARCHAR), CAST(NULL AS VARCHAR),
               CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP)
        FROM part WHERE p_partkey % 27 NOT IN (SELECT n_nationkey FROM nation)
        UNION ALL
        SELECT 'licenses', CAST(r_regionkey AS VARCHAR), 'L' || CAST(r_regionkey AS VARCHAR), NULL, NULL, NULL, NULL, NULL FROM region
        UNION ALL
        SELECT 'bridges', CAST(repository_id AS VARCHAR), tag, 'tag', NULL, NULL, NULL, NULL FROM f_tags
        UNION ALL
        SELECT 'bridges', CAST(repository_id AS VARCHAR), topic, 'topic', NULL, NULL, NULL, NULL FROM f_topics
        UNION ALL
        SELECT 'bridges', CAST(repository_id AS VARCHAR), language, 'lang', NULL, size, NULL, NULL FROM f_langs""",
                               "f_repos", "f_tags", "f_topics", "f_langs")
    q["stream_crawl_gate"] = sql("""
        SELECT s.repository_id, s.pushed_at, s.event_time AS discovered_at, r.last_crawled_at
        FROM f_stats s LEFT JOIN f_repos r ON r.id = s.repository_id
        WHERE COALESCE(s.pushed_at >= r.last_crawled_at, true)""", "f_stats", "f_repos")
    q["stream_write"] = changed_sql()
    q["stream_embed"] = """
        SELECT CAST(doc_id AS BIGINT) AS repository_id, CAST(384 AS BIGINT) AS n_dims FROM documents
        UNION ALL
        SELECT CAST(vec_id AS BIGINT), CAST(len(embedding) AS BIGINT) FROM embeddings
        WHERE vec_id NOT IN (SELECT doc_id FROM documents)"""
    return q

