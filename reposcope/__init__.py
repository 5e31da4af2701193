"""reposcope: repository-catalogue analytics as Spark DataFrame operators.

Every operator is a lazy ``DataFrame → DataFrame`` function; reference
times are parameters. The common entry points are re-exported here.
"""

from reposcope.functions.languages import language_color, language_share, primary_language
from reposcope.functions.ordinal import global_rank, rank_within
from reposcope.functions.sets import jaccard
from reposcope.functions.time import parse_duration
from reposcope.operators.embed import embed_texts
from reposcope.operators.enrich import crawled_since, enrich, repositories_by_ids, repository_ids_page
from reposcope.operators.facet_index import (add_to_index, facet_filter_indexed, facet_postings, index_table, matching_words,
                                             remove_from_index)
from reposcope.operators.facets import facet_filter, parse_facets, recent_crawled_list, top_unseen
from reposcope.operators.feed import (feed, feed_personalized, feed_rows, feed_trending, repository_detail,
                                      session_history, session_seen, session_views)
from reposcope.operators.paging import page, ranked_rows, write_ranked
from reposcope.operators.publish import (bot_flag, html_snippet, mark_posted, next_to_post, page_meta,
                                         post_text)
from reposcope.operators.ranges import adaptive_ranges, range_pages, value_leaves
from reposcope.operators.seen_set import seen_rows, seen_table, seen_words, top_unseen_stored, update_seen
from reposcope.operators.similarity import (embed_requests, jaccard_pairs, similar_topk, similarity_from_json,
                                            similarity_hybrid, similarity_job, similarity_json,
                                            upsert_similarity)
from reposcope.operators.snapshots import (dedupe_check, dedupe_global, first_stat, last_update,
                                           latest_counters, latest_stat, past_counters, recently_pushed,
                                           snapshots_by_month, snapshots_changed, state_hash, stats_history,
                                           trending_growth)
from reposcope.operators.upsert import (upsert_bridges, upsert_licenses, upsert_owners, upsert_repositories,
                                        upsert_vectors)
from reposcope.plans.jobs import posting_job, refresh_candidates
from reposcope.session import checkpoint_root, get_session
from reposcope.sources.ingest import (crawl_results, ingest_languages, ingest_readme_url, ingest_search_pages,
                                      ingest_tags, needs_crawl, readme_candidates)

__all__ = [name for name in dir() if not name.startswith("_")]
