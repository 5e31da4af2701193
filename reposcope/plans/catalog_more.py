"""Registered queries beyond the snapshot family."""

from __future__ import annotations

from pyspark.sql import functions as F

from reposcope.functions import languages as L
from reposcope.functions.ordinal import global_rank
from reposcope.functions.time import duration_micros
from reposcope.operators import enrich as EN
from reposcope.operators import facet_index as FI
from reposcope.operators import facets as FA
from reposcope.operators import feed as FD
from reposcope.operators import neighbour_index as NI
from reposcope.operators import paging as PG
from reposcope.operators import rollup as RU
from reposcope.operators import seen_set as SE
from reposcope.operators import snapshots as S
from reposcope.plans import params as P
from reposcope.plans.catalog import ORDERS_ORDER, register
from reposcope.sources import fixtures as FX
from reposcope.session import materialized, scratch_path
from reposcope.sources import ingest as IN
from reposcope.sources import sinks as SK


def enriched(spark, sf, ids=None):
    return EN.enrich(FX.repos(spark, sf), FX.owners(spark, sf), FX.licenses(spark, sf),
                     FX.tags(spark, sf), FX.topics(spark, sf), FX.langs(spark, sf), ids=ids)


def trending_events(spark, sf):
    return S.trending_growth(FX.stats(spark, sf), P.EVENTS_AS_OF, P.EVENTS_DAYS, P.TRENDING_LIMIT)


def trending_orders(spark, sf):
    return S.trending_growth(FX.stats_long(spark, sf), P.ORDERS_AS_OF, P.ORDERS_DAYS,
                             P.TRENDING_LIMIT, order_cols=ORDERS_ORDER)


def facets_kw(spark, sf):
    return dict(langs=FX.langs(spark, sf), tags=FX.tags(spark, sf), topics=FX.topics(spark, sf),
                languages=P.FACET_LANGUAGES, tag_names=P.FACET_TAGS, topic_names=P.FACET_TOPICS)


def sessions(spark, sf):
    return FX.views(spark, sf).select("session_id").distinct()


FLAT = ["id", "name", "full_name", "owner_login", "license_name", "tags", "topics", "languages"]


@register("repository_enriched")
def q_repository_enriched(spark, sf):
    return EN.flat(enriched(spark, sf))


@register("repository_detail")
def q_repository_detail(spark, sf):
    ids = FX.views(spark, sf).select(F.col("repository_id").alias("id"))
    e = enriched(spark, sf, ids=ids)
    d = FD.repository_detail(e, FX.stats(spark, sf), ids)
    return d.select(*[c for c in FLAT if c not in ("tags", "topics", "languages")],
                    F.concat_ws(",", "tags").alias("tags"), F.concat_ws(",", "topics").alias("topics"),
                    EN.languages_text(F.col("language_list")).alias("languages"), "language",
                    "stargazers_count", "forks_count", "watchers_count", "open_issues_count",
                    "pushed_at", "stat_time")


@register("repositories_by_ids")
def q_repositories_by_ids(spark, sf):
    tr = trending_events(spark, sf)
    e = EN.flat(enriched(spark, sf, ids=tr.select(F.col("repository_id").alias("id"))))
    return EN.repositories_by_ids(e, tr).select("rank", *FLAT)


@register("repository_ids_page")
def q_repository_ids_page(spark, sf):
    return EN.repository_ids_page(FX.repos(spark, sf), P.ID_PAGE_LIMIT, P.ID_PAGE_OFFSET)


def _deep_page(df, order, spark):
    """The page that begins at nine tenths of a stored list."""
    path = scratch_path(spark, "ranked-list")
    PG.write_ranked(df, order, path, rows_per_range=P.RANGE_ROWS)
    return PG.page(spark, path, PG.ranked_rows(spark, path) * 9 // 10, P.ID_PAGE_LIMIT, df.schema)


@register("repository_ids_deep_page")
def q_repository_ids_deep_page(spark, sf):
    return _deep_page(FX.repos(spark, sf).select("id"), [F.asc("id")], spark)


@register("recent_list_deep_page")
def q_recent_list_deep_page(spark, sf):
    return _deep_page(FX.repos(spark, sf).select("id", "last_crawled_at"), [F.desc("last_crawled_at"), F.asc("id")], spark)


@register("crawled_since")
def q_crawled_since(spark, sf):
    return EN.crawled_since(FX.repos(spark, sf), P.CRAWLED_SINCE)


@register("facet_filter")
def q_facet_filter(spark, sf):
    tr = trending_orders(spark, sf).select("repository_id", "rank")
    return FA.facet_filter(tr, **facets_kw(spark, sf))


@register("recent_crawled_list")
def q_recent_crawled_list(spark, sf):
    v = FX.views(spark, sf)
    return FA.recent_crawled_list(FX.repos(spark, sf), seen=v, sessions=v, limit=P.RECENT_LIST_LIMIT,
                                  **facets_kw(spark, sf))


def _facet_index(spark, sf):
    """The facet index folded together from two batches of bridge rows."""
    table = FI.index_table(spark, scratch_path(spark, "facet-index"), buckets=8)
    kw = facets_kw(spark, sf)
    for part in range(2):
        FI.add_to_index(table, part, *[kw[b].where(F.pmod(F.xxhash64(*kw[b].columns), F.lit(2)) == part) for b in ("langs", "tags", "topics")])
    return table


def _seen_table(spark, sf):
    """The seen sets folded together from two batches of views."""
    table = SE.seen_table(spark, scratch_path(spark, "seen"), buckets=8)
    views = FX.views(spark, sf)
    for part in range(2):
        SE.update_seen(table, part, views.where(F.pmod(F.xxhash64(*views.columns), F.lit(2)) == part))
    return table


FACET_REQUEST = dict(languages=P.FACET_LANGUAGES, tag_names=P.FACET_TAGS, topic_names=P.FACET_TOPICS)


@register("facet_filter_indexed")
def q_facet_filter_indexed(spark, sf):
    tr = trending_orders(spark, sf).select("repository_id", "rank")
    return FI.facet_filter_indexed(tr, _facet_index(spark, sf), **FACET_REQUEST)


@register("session_seen_stored")
def q_session_seen_stored(spark, sf):
    return SE.seen_rows(_seen_table(spark, sf).read())


@register("recent_crawled_stored")
def q_recent_crawled_stored(spark, sf):
    """``recent_crawled_list`` from the stored facet index and the stored seen sets."""
    crawled = FX.repos(spark, sf).select(F.col("id").alias("repository_id"), "last_crawled_at")
    f = FI.facet_filter_indexed(crawled, _facet_index(spark, sf), **FACET_REQUEST)
    ranked = global_rank(f, [F.desc("last_crawled_at"), F.asc("repository_id")])
    return SE.top_unseen_stored(ranked, _seen_table(spark, sf).read(), sessions(spark, sf), 0, P.RECENT_LIST_LIMIT).select(
        "session_id", "position", "repository_id", "last_crawled_at")


@register("parse_facets")
def q_parse_facets(spark, sf):
    r = FX.facet_requests(spark, sf)
    parsed = FA.parse_facets(F.col("request"))
    return r.select("id", F.concat_ws("|", parsed).alias("parsed"), F.size(parsed).cast("bigint").alias("n"))


@register("feed_rows")
def q_feed_rows(spark, sf):
    return _feed_rows(spark, sf, "latest")


def _feed_rows(spark, sf, stat):
    tr = materialized(trending_events(spark, sf), "ranked")  # 200 rows that four branches read
    e = enriched(spark, sf, ids=tr.select(F.col("repository_id").alias("id")))
    return FD.feed_rows(tr, e, FX.stats(spark, sf), stat=stat)


@register("feed_rows_first")
def q_feed_rows_first(spark, sf):
    """Card rows with the oldest snapshot, as the list endpoint shows them."""
    return _feed_rows(spark, sf, "first")


@register("primary_language")
def q_primary_language(spark, sf):
    pl = L.primary_language(FX.langs(spark, sf)).withColumnRenamed("repository_id", "id")
    return (FX.repos(spark, sf).select("id").join(pl, "id", "left")
            .select("id", F.coalesce("language", F.lit("Unknown")).alias("language")))


@register("language_share")
def q_language_share(spark, sf):
    return L.language_share(FX.langs(spark, sf)).withColumn("share", F.round("share", 6))


@register("language_color")
def q_language_color(spark, sf):
    return L.language_color(FX.coloured_langs(spark, sf))


@register("readme_candidates")
def q_readme_candidates(spark, sf):
    return IN.readme_candidates(FX.repos(spark, sf), FX.readme_probes(spark, sf), P.README_BASE)


@register("session_views")
def q_session_views(spark, sf):
    return FD.session_views(FX.views(spark, sf))


@register("session_history")
def q_session_history(spark, sf):
    return FD.session_history(FX.views(spark, sf), P.HISTORY_LIMIT)


@register("session_seen")
def q_session_seen(spark, sf):
    return FD.session_seen(FX.views(spark, sf))


@register("feed_trending")
def q_feed_trending(spark, sf):
    return FD.feed_trending(trending_orders(spark, sf), FX.views(spark, sf), sessions(spark, sf),
                            page=0, page_size=P.PAGE_SIZE)


# -- similarity ---------------------------------------------------------------------------

from reposcope.operators import similarity as SI  # noqa: E402


def metadata(spark, sf):
    """What the re-scoring needs of a record, once for both sides: topics and
    languages of the repositories whose owner is known."""
    r = FX.repos(spark, sf).select("id", "owner_id")
    r = r.join(FX.owners(spark, sf).select(F.col("id").alias("owner_id")), "owner_id", "left_semi")
    return materialized(SI.narrow_metadata(r, FX.topics(spark, sf), FX.langs(spark, sf)), "similarity-metadata")


def topk_all(spark, sf):
    return SI.similar_topk(FX.vectors(spark, sf), P.SIMILARITY_K)


def hybrid_all(spark, sf):
    return SI.similarity_hybrid(topk_all(spark, sf), metadata(spark, sf))


def recent_events(spark, sf):
    return S.recently_pushed(FX.stats(spark, sf), P.EVENTS_SINCE)


def hy_out():
    return ["source_id", "candidate_id", F.round("cosine", 6).alias("cosine"),
            F.round("topic_score", 6).alias("topic_score"),
            F.round("language_score", 6).alias("language_score"), F.round("score", 6).alias("score"), "rank"]


@register("similar_topk")
def q_similar_topk(spark, sf):
    return topk_all(spark, sf).select("source_id", "candidate_id", F.round("cosine", 6).alias("cosine"), "rank")


@register("similar_topk_lsh")
def q_similar_topk_lsh(spark, sf):
    """The approximate form against the exact one: true cosines, recall of at
    least 0.9, and how many sources get a short list."""
    exact = topk_all(spark, sf).select("source_id", "candidate_id", F.col("cosine").alias("true_cosine"))
    near = SI.similar_topk(FX.vectors(spark, sf), P.SIMILARITY_K, method="lsh", lsh_bits=3, lsh_tables=12)
    both = exact.join(near.select("source_id", "candidate_id", "cosine"), ["source_id", "candidate_id"], "full")
    per = both.groupBy("source_id").agg(
        F.count("cosine").alias("found"), F.count(F.when(F.col("cosine").isNotNull(), F.col("true_cosine"))).alias("hits"), F.count("true_cosine").alias("wanted"),
        F.coalesce(F.max(F.abs(F.col("cosine") - F.col("true_cosine"))), F.lit(0.0)).alias("off"))
    return per.agg(F.count(F.lit(1)).alias("n_sources"), F.count(F.when(F.col("found") < F.col("wanted"), 1)).alias("short_lists"),
                   (F.sum("hits") >= 0.9 * F.sum("wanted")).alias("recall_reached"), (F.max("off") < 1e-6).alias("cosines_true"))


@register("similar_topk_indexed")
def q_similar_topk_indexed(spark, sf):
    """The stored index against the exact lists: recall and work of every source."""
    vectors = FX.vectors(spark, sf)
    index = NI.build_index(vectors, NI.fit_index(vectors, P.SIMILARITY_K))
    return NI.search_report(index, vectors, vectors, topk_all(spark, sf), P.SIMILARITY_K)


@register("similarity_hybrid")
def q_similarity_hybrid(spark, sf):
    """The periodic job: sources = recently pushed repositories."""
    lists, _requests = SI.similarity_job(FX.vectors(spark, sf), metadata(spark, sf), FX.stats(spark, sf),
                                         P.EVENTS_SINCE, P.SIMILARITY_K)
    return lists.select(*hy_out())


@register("jaccard_pairs")
def q_jaccard_pairs(spark, sf):
    j = SI.jaccard_pairs(topk_all(spark, sf), enriched(spark, sf))
    return j.select("source_id", "candidate_id", F.round("topic_jaccard", 6).alias("topic_jaccard"),
                    F.round("language_jaccard", 6).alias("language_jaccard"))


@register("similarity_json")
def q_similarity_json(spark, sf):
    """Stored lists, written and read back (scores are rounded by this check only)."""
    back = SI.similarity_from_json(SI.similarity_json(hybrid_all(spark, sf)))
    return back.select("source_id", "candidate_id", F.round("score", 6).alias("score"), "rank")


@register("upsert_similarity")
def q_upsert_similarity(spark, sf):
    """Stored lists of some sources, a third of them shorter than the new ones."""
    js = materialized(SI.similarity_json(hybrid_all(spark, sf)), "similarity-lists")
    cur = js.join(recent_events(spark, sf).select(F.col("repository_id").alias("id")), "id", "left_semi")
    cur = cur.withColumn("data", F.when(F.col("id") % 3 == 0, F.lit("[]")).otherwise(F.col("data")))
    out = SI.upsert_similarity(cur, js)
    return out.select("id", "updated", F.size(F.from_json("data", SI.ZLIST)).cast("bigint").alias("n_items"))


@register("embed_requests")
def q_embed_requests(spark, sf):
    recent = S.recently_pushed(FX.stats_long(spark, sf), P.ORDERS_SINCE, order_cols=ORDERS_ORDER)
    rc = IN.readme_candidates(FX.repos(spark, sf), FX.readme_probes(spark, sf), P.README_BASE)
    return SI.embed_requests(recent, FX.vectors(spark, sf), rc.withColumnRenamed("repository_id", "id"))


def history_lists(spark, sf):
    """Similarity lists for the repositories in the sessions' histories only:
    a source's list does not depend on the other sources."""
    views = FX.views(spark, sf)
    srcs = FD.session_history(views, P.HISTORY_LIMIT).select("repository_id").distinct()
    topk = SI.similar_topk(FX.vectors(spark, sf), P.SIMILARITY_K, sources=srcs)
    return SI.similarity_hybrid(topk, metadata(spark, sf))


@register("feed_personalized")
def q_feed_personalized(spark, sf):
    f = FD.feed_personalized(FX.views(spark, sf), history_lists(spark, sf), page=0, page_size=P.PAGE_SIZE,
                             history_limit=P.HISTORY_LIMIT)
    return f.withColumn("score", F.round("score", 6))


@register("feed_page")
def q_feed_page(spark, sf):
    """Second page of the combined feed: all sessions with a history
    (personalised) and sessions without one (trending)."""
    f = FD.feed(trending_orders(spark, sf), FX.views(spark, sf), history_lists(spark, sf),
                FX.feed_sessions(spark, sf), page=1, page_size=P.PAGE_SIZE, history_limit=P.HISTORY_LIMIT)
    return f.withColumn("score", F.round("score", 6))


def feed_facets(spark, sf):
    return facets_kw(spark, sf) | {"tag_names": (), "topic_names": P.FEED_FACET_TOPICS}


@register("feed_trending_facets")
def q_feed_trending_facets(spark, sf):
    """Cold feed end to end: growth list, facets, unseen, page, records, latest stat."""
    f = FD.feed_trending(trending_orders(spark, sf), FX.views(spark, sf), FX.feed_sessions(spark, sf),
                         page=0, page_size=P.PAGE_SIZE, **feed_facets(spark, sf))
    f = materialized(f, "feed-page")
    cards = FD.feed_rows(f.select("repository_id", F.lit(0).cast("bigint").alias("rank")).distinct(), enriched(spark, sf), FX.stats(spark, sf))
    return f.join(cards.select(F.col("id").alias("repository_id"), "full_name", "stargazers_count", "language", "topics"), "repository_id")


@register("feed_personalized_facets")
def q_feed_personalized_facets(spark, sf):
    f = FD.feed_personalized(FX.views(spark, sf), history_lists(spark, sf), page=0, page_size=P.PAGE_SIZE,
                             history_limit=P.HISTORY_LIMIT, **feed_facets(spark, sf))
    return f.withColumn("score", F.round("score", 6))


# -- publishing, text, README, embeddings, ranges ---------------------------------------

from reposcope.operators import embed as EM  # noqa: E402
from reposcope.operators import publish as PB  # noqa: E402
from reposcope.operators import ranges as RG  # noqa: E402


def next_post(spark, sf):
    e = enriched(spark, sf)
    return PB.next_to_post(trending_events(spark, sf), e, FX.posted(spark, sf), n=1)


@register("next_to_post")
def q_next_to_post(spark, sf):
    return next_post(spark, sf)


@register("post_text")
def q_post_text(spark, sf):
    return PB.post_text(enriched(spark, sf), P.BASE_URL, P.POST_LIMIT_BYTES)


@register("post_text_documents")
def q_post_text_documents(spark, sf):
    """Post texts whose summaries are whole documents, in several scripts and longer than a post."""
    docs = FX.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description"))
    e = enriched(spark, sf).drop("description").join(docs, "id")
    return PB.post_text(e, P.BASE_URL, P.POST_LIMIT_BYTES)


@register("posting_job")
def q_posting_job(spark, sf):
    """One posting run: what is posted, with its text, and the markers after it."""
    from reposcope.plans.jobs import posting_job
    posts, marked = posting_job(trending_events(spark, sf), enriched(spark, sf), FX.posted(spark, sf),
                                P.EVENTS_AS_OF, P.BASE_URL, n=3, limit_bytes=P.POST_LIMIT_BYTES)
    return (marked.join(posts, "repository_id", "left")
            .select("repository_id", "posted_at", F.col("rank").cast("double").alias("rank"), F.coalesce("text", F.lit("")).alias("text")))


@register("publish_messages")
def q_publish_messages(spark, sf):
    """Crawl requests published as JSON messages and consumed again."""
    path = scratch_path(spark, "messages")
    recent = S.recently_pushed(FX.stats(spark, sf), P.EVENTS_SINCE)
    out = recent.select("repository_id", IN.object_key(F.col("repository_id")).alias("object_key"))
    SK.publish_messages(out, "text", path=path)
    m = F.from_json("value", "struct<repository_id:bigint,object_key:string>")
    return spark.read.text(path).select(m.alias("m")).select("m.*")


@register("mark_posted")
def q_mark_posted(spark, sf):
    return PB.mark_posted(FX.posted(spark, sf), next_post(spark, sf), P.EVENTS_AS_OF)


@register("html_snippet")
def q_html_snippet(spark, sf):
    pages = FX.table(spark, sf, "pages")
    return pages.select("page_id", PB.html_snippet(F.col("html"), P.SNIPPET_CHARS).alias("snippet"))


@register("page_meta")
def q_page_meta(spark, sf):
    return PB.page_meta(FX.repos(spark, sf), "reposcope", P.BASE_URL).drop("meta_html")


@register("page_render")
def q_page_render(spark, sf):
    """Share pages served to crawlers: each landed page (page_id = repository
    id) with its title element replaced by the repository's meta block.

    Neither side is broadcast: files say little about the size of pages or
    of meta blocks. The blocks are made of joined rows."""
    pages = FX.table(spark, sf, "pages").select(F.col("page_id").alias("id"), "html")
    pages = PB.page_meta(pages.join(FX.repos(spark, sf).hint("merge"), "id"), "reposcope", P.BASE_URL, keep=("html",))
    html = PB.inject_meta(F.col("html"), F.col("meta_html"))
    return pages.select(F.col("repository_id").alias("page_id"), F.length(html).cast("bigint").alias("n_chars"),
                        F.sha2(html, 256).alias("html_sha256"))


@register("bot_flag")
def q_bot_flag(spark, sf):
    return FX.user_agents(spark, sf).select("doc_id", PB.bot_flag(F.col("user_agent")).alias("is_bot"))


@register("duration_texts")
def q_duration_texts(spark, sf):
    return FX.duration_texts(spark, sf).withColumn("micros", duration_micros(F.col("text")))


@register("readme_text")
def q_readme_text(spark, sf):
    store = FX.readme_store(spark, sf)
    return store.select(IN.key_to_id(F.col("object_key")).alias("repository_id"), "object_key",
                        F.length("body").cast("bigint").alias("n_chars"),
                        F.octet_length("body").cast("bigint").alias("n_bytes"),
                        F.sha2("body", 256).alias("body_sha256"))


@register("embed_texts")
def q_embed_texts(spark, sf):
    docs = FX.table(spark, sf, "documents").withColumnRenamed("doc_id", "repository_id")
    v = EM.embed_texts(docs, "text", "repository_id", dim=384)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("repository_id", F.size("embedding").cast("bigint").alias("n_dims"),
                    F.round(norm, 6).alias("norm"))


def leaf_values(spark, sf):
    return RG.value_leaves(FX.range_input(spark, sf), "v", P.RANGE_LO, P.RANGE_HI, P.RANGE_CAP)


@register("adaptive_ranges")
def q_adaptive_ranges(spark, sf):
    return RG.adaptive_ranges(FX.range_input(spark, sf), values=leaf_values(spark, sf))


@register("range_pages")
def q_range_pages(spark, sf):
    return RG.range_pages(FX.range_input(spark, sf), leaf_values(spark, sf), "v", "id", P.RANGE_PAGE)


# -- upserts ------------------------------------------------------------------------------

from reposcope.operators import upsert as UP  # noqa: E402


@register("upsert_owners")
def q_upsert_owners(spark, sf):
    return UP.upsert_owners(FX.owners(spark, sf), FX.owner_messages(spark, sf)).select("id", "login", "type")


@register("upsert_licenses")
def q_upsert_licenses(spark, sf):
    return UP.upsert_licenses(FX.licenses(spark, sf), FX.license_messages(spark, sf))


@register("upsert_repositories")
def q_upsert_repositories(spark, sf):
    nxt = UP.upsert_repositories(FX.repos(spark, sf), FX.repo_messages(spark, sf))
    return nxt.select("id", "name", "description", "license_key", "is_archived", "last_crawled_at", "created_at")


@register("upsert_bridges")
def q_upsert_bridges(spark, sf):
    """Sizes exist for languages only; reported as double so a missing size
    is NaN in both engines' frames."""
    b = UP.upsert_bridges(FX.bridge_rows(spark, sf), FX.bridge_messages(spark, sf))
    return b.withColumn("size", F.col("size").cast("double"))


@register("upsert_vectors")
def q_upsert_vectors(spark, sf):
    v = UP.upsert_vectors(FX.vectors(spark, sf), FX.vector_messages(spark, sf))
    # Every element takes part: a sum of the elements by place.
    whole = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("repository_id", F.size("embedding").cast("bigint").alias("n_dims"), F.round(whole, 4).alias("by_place"),
                    F.round(F.element_at("embedding", 1).cast("double"), 6).alias("e_first"),
                    F.round(F.element_at("embedding", -1).cast("double"), 6).alias("e_last"))


@register("needs_crawl")
def q_needs_crawl(spark, sf):
    disc = FX.stats(spark, sf).select("repository_id", "event_time", "pushed_at")
    return IN.needs_crawl(disc, FX.repos(spark, sf))


@register("refresh_candidates")
def q_refresh_candidates(spark, sf):
    """Re-crawl candidates: recently pushed ∪ latest discovery needing a crawl."""
    from reposcope.plans.jobs import refresh_candidates
    return refresh_candidates(FX.stats(spark, sf), FX.repos(spark, sf), P.EVENTS_SINCE)


# -- ingest of landed JSON ---------------------------------------------------------------

@register("ingest_search_pages")
def q_ingest_search_pages(spark, sf):
    r = IN.ingest_search_pages(FX.search_pages(spark, sf))
    return r.select("id", "full_name", "owner_id", "owner_login", "description", "license_key",
                    "license_name", "language", "stargazers_count", "forks_count", "pushed_at",
                    F.concat_ws(",", "topics").alias("topics"), "total_count")


@register("ingest_tags")
def q_ingest_tags(spark, sf):
    t = IN.ingest_tags(FX.landed_tags(spark, sf))
    return t.select("repository_id", F.concat_ws(",", "tags").alias("tags"),
                    F.size("tags").cast("bigint").alias("n_tags"))


@register("ingest_languages")
def q_ingest_languages(spark, sf):
    return IN.ingest_languages(FX.landed_languages(spark, sf))


@register("ingest_readme_url")
def q_ingest_readme_url(spark, sf):
    return IN.ingest_readme_url(FX.landed_readme_locators(spark, sf, P.README_BASE))


# -- streaming jobs (file sources, availableNow) ---------------------------------------------

from reposcope.streaming import jobs as ST  # noqa: E402


def _land(df, path: str) -> str:
    df.select("value").write.mode("overwrite").text(path)
    return path


def _run(q) -> None:
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@register("stream_views")
def q_stream_views(spark, sf):
    root = scratch_path(spark, "stream-views")
    src = _land(FX.view_messages(spark, sf), f"{root}/src")
    _run(ST.stream_views(spark, src, f"{root}/sink", f"{root}/ckpt"))
    return spark.read.parquet(f"{root}/sink")


@register("stream_ingest")
def q_stream_ingest(spark, sf):
    root = scratch_path(spark, "stream-ingest")
    src = _land(FX.crawl_result_messages(spark, sf), f"{root}/src")
    _run(ST.stream_ingest(spark, src, f"{root}/out", f"{root}/ckpt"))
    r = spark.read.parquet(f"{root}/out/repositories")
    return r.select("id", "full_name", "owner_id", "owner_login", "description", "license_key",
                    "license_name", "language", "stargazers_count", "forks_count", "pushed_at",
                    F.concat_ws(",", "topics").alias("topics"))


@register("stream_readmes")
def q_stream_readmes(spark, sf):
    """README bodies that the ingest stores, and the embedding requests for them."""
    root = scratch_path(spark, "stream-readmes")
    src = _land(FX.crawl_result_messages(spark, sf), f"{root}/src")
    _run(ST.stream_ingest(spark, src, f"{root}/out", f"{root}/ckpt", bodies=lambda: FX.readme_bodies(spark, sf)))
    asked = spark.read.parquet(f"{root}/out/embed_requests").select("repository_id", "download_url")
    stored = spark.read.parquet(f"{root}/out/readmes")
    return (stored.join(asked, "repository_id", "full")
            .select("repository_id", "object_key", F.length("body").cast("bigint").alias("n_chars"), F.sha2("body", 256).alias("body_sha256"),
                    "download_url"))


@register("stream_crawl_gate")
def q_stream_crawl_gate(spark, sf):
    root = scratch_path(spark, "stream-gate")
    src = _land(FX.discovery_messages(spark, sf), f"{root}/src")
    _run(ST.stream_crawl_gate(spark, src, FX.repos(spark, sf), f"{root}/sink", f"{root}/ckpt"))
    return spark.read.parquet(f"{root}/sink").select("repository_id", "pushed_at", "discovered_at",
                                                      "last_crawled_at")


@register("stream_write")
def q_stream_write(spark, sf):
    """Snapshots appended by the write path, one micro-batch per landed file
    (one file per year, in time order): change detection across batches."""
    root = scratch_path(spark, "stream-write")
    msgs = FX.snapshot_messages(spark, sf)
    years = [r["year"] for r in msgs.select("year").distinct().orderBy("year").collect()]
    for y in years:  # one small driver loop over landed files, not over data
        msgs.where(F.col("year") == y).select("value").coalesce(1).write.mode("append").text(f"{root}/src")
    _run(ST.stream_snapshots_versioned(spark, f"{root}/src", f"{root}/sink", f"{root}/state",
                                       f"{root}/ckpt", max_files=1, buckets=8))
    return spark.read.parquet(f"{root}/sink").select(
        "repository_id", "event_time", "tie", "stargazers_count", "watchers_count", "forks_count",
        "open_issues_count")


@register("stream_dimensions")
def q_stream_dimensions(spark, sf):
    """All four dimension tables after crawl results in four micro-batches."""
    root = scratch_path(spark, "stream-dimensions")
    msgs = materialized(FX.crawl_result_messages(spark, sf), "crawl-results")
    for part in range(4):
        msgs.where(F.abs(F.hash("value")) % 4 == part).repartition(2).write.mode("append").text(f"{root}/src")
    initial = {"repositories": FX.repos(spark, sf), "owners": FX.owners(spark, sf), "licenses": FX.licenses(spark, sf),
               "bridges": FX.bridge_rows(spark, sf)}
    _run(ST.stream_dimensions(spark, f"{root}/src", initial, f"{root}/state", f"{root}/ckpt", max_files=2, buckets=8))
    t = {name: ST.latest_version(spark, f"{root}/state/{name}") for name in initial}
    none = F.lit(None)

    def rows(name, key, label, detail, extra, size=none, crawled=none, created=none):
        return t[name].select(F.lit(name).alias("tbl"), F.col(key).cast("string").alias("id"), F.col(label).alias("name"), F.col(detail).alias("detail"),
                              (extra if extra is none else F.col(extra)).cast("string").alias("extra"), size.cast("bigint").alias("size"),
                              crawled.cast("timestamp_ntz").alias("last_crawled_at"), created.cast("timestamp_ntz").alias("created_at"))

    return (rows("repositories", "id", "name", "description", "license_key", crawled=F.col("last_crawled_at"), created=F.col("created_at"))
            .unionByName(rows("owners", "id", "login", "type", "html_url")).unionByName(rows("licenses", "key", "name", "spdx_id", "node_id"))
            .unionByName(rows("bridges", "repository_id", "name", "kind", none, size=F.col("size"))))


def _rolled_up(spark, stats, order, split):
    """A rollup folded together from three batches, none of them in order of time."""
    table = RU.rollup_table(spark, scratch_path(spark, "rollup"), buckets=8)
    for part in range(3):
        RU.update_rollup(table, part, stats.where(F.pmod(F.xxhash64(*split), F.lit(3)) == part), order)
    return table.read()


@register("trending_rollup")
def q_trending_rollup(spark, sf):
    r = _rolled_up(spark, FX.stats(spark, sf), ("event_time",), ["repository_id", "event_time"])
    return RU.trending_from_rollup(r, P.EVENTS_AS_OF, P.EVENTS_DAYS, P.TRENDING_LIMIT)


@register("trending_rollup_30d")
def q_trending_rollup_30d(spark, sf):
    r = _rolled_up(spark, FX.stats_long(spark, sf), ORDERS_ORDER, ["tie"])
    return RU.trending_from_rollup(r, P.ORDERS_AS_OF, P.ORDERS_DAYS, P.TRENDING_LIMIT, ORDERS_ORDER)


@register("stream_embed")
def q_stream_embed(spark, sf):
    root = scratch_path(spark, "stream-embed")
    src = _land(FX.embed_request_messages(spark, sf), f"{root}/src")
    _run(ST.stream_embed(spark, src, FX.readme_store(spark, sf), FX.vectors(spark, sf),
                         f"{root}/vectors", f"{root}/ckpt", buckets=8))
    v = ST.latest_version(spark, f"{root}/vectors")
    return v.select("repository_id", F.size("embedding").cast("bigint").alias("n_dims"))


@register("crawl_results")
def q_crawl_results(spark, sf):
    """Discovery → crawl gate → envelope with landed tags, languages and
    README URL."""
    gated = IN.needs_crawl(FX.discoveries(spark, sf), FX.repos(spark, sf)).where("needs_crawl")
    res = IN.crawl_results(
        gated, IN.ingest_tags(IN.latest_landed(FX.landed_tag_bodies(spark, sf))),
        IN.ingest_language_maps(IN.latest_landed(FX.landed_language_bodies(spark, sf))),
        IN.readme_candidates(FX.repos(spark, sf), FX.readme_probes(spark, sf), P.README_BASE),
        "2024-02-02 00:00:00")
    langs = F.array_join(F.transform(F.array_sort(F.map_entries("languages")),
                                     lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return res.select("repository_id", "full_name", "readme_url", F.array_join("tags", ",").alias("tags"),
                      langs.alias("languages"), F.col("crawled_at").cast("timestamp_ntz").alias("crawled_at"))
