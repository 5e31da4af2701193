"""Publishing: next repository to post, post text, posted markers, page
snippets and meta text, bot detection for a request log.

All text work is JVM-side string / regex / array expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions.time import col_type, ts_lit

# Lower-case user-agent fragments that mark a crawler.
BOT_AGENTS = (
    "googlebot", "yahoo! slurp", "bingbot", "yandex", "baiduspider", "facebookexternalhit",
    "twitterbot", "rogerbot", "linkedinbot", "embedly", "quora link preview", "showyoubot",
    "outbrain", "pinterest/0.", "pinterestbot", "slackbot", "vkshare", "w3c_validator",
    "redditbot", "applebot", "whatsapp", "flipboard", "tumblr", "bitlybot", "skypeuripreview",
    "nuzzel", "discordbot", "google page speed", "qwantify",
)

# The post template pieces.
POST_HEAD = "🚀 Trending on GitHub: "
POST_LINK = "🔗 "
MAX_HASHTAGS = 4
MAX_TOPIC_BYTES = 15

# The share-page meta block; the slots are title,
# description, full name, description, image URL, full name, description,
# image URL.
META_TEMPLATE = (
    "\n<title>%s</title>\n"
    "<meta name=\"description\" content=\"%s\">\n"
    "<meta property=\"og:title\" content=\"%s\">\n"
    "<meta property=\"og:description\" content=\"%s\">\n"
    "<meta property=\"og:image\" content=\"%s\">\n"
    "<meta property=\"twitter:card\" content=\"summary_large_image\">\n"
    "<meta property=\"twitter:title\" content=\"%s\">\n"
    "<meta property=\"twitter:description\" content=\"%s\">\n"
    "<meta property=\"twitter:image\" content=\"%s\">\n"
)
# The page's first title element on one line (``.`` stops at line ends).
TITLE_PATTERN = r"<title>[^\n\r\u2028\u2029]*?</title>"

# Whitespace as the browser's regex ``\s`` sees it (ASCII + Unicode spaces).
JS_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def bot_flag(user_agent: Column, patterns: Sequence[str] = BOT_AGENTS) -> Column:
    """True when the lower-cased text contains any pattern."""
    lowered = F.lower(F.coalesce(user_agent, F.lit("")))
    return F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.instr(lowered, p) > 0)


def html_snippet(html: Column, n: int = 400) -> Column:
    """Readable start of an HTML page: drop style and script blocks (greedy,
    dot matches newline), tags → space, runs of two or more spaces → one,
    trim, first ``n`` characters."""
    s = F.regexp_replace(html, r"(?s)<style[^>]*>.*</style>", "")
    s = F.regexp_replace(s, r"(?s)<script[^>]*>.*</script>", "")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    s = F.regexp_replace(s, JS_SPACE + "{2,}", " ")
    s = F.regexp_replace(s, "^" + JS_SPACE + "+|" + JS_SPACE + "+$", "")
    return F.substring(s, 1, n)


def page_meta(repos: DataFrame, site_name: str, base_url: str, keep: Sequence[str] = ()) -> DataFrame:
    """Share-page meta text per repository; ``keep`` names columns that pass through.
    → repository_id, title, description, og_image, meta_html"""
    out = repos.select(
        F.col("id").alias("repository_id"), F.col("full_name"),
        F.concat("full_name", F.lit(f" - {site_name}")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.concat(F.lit(base_url.rstrip("/") + "/api/og?id="), F.col("id").cast("string")).alias("og_image"),
        *keep,
    )
    d, img, name = F.col("description"), F.col("og_image"), F.col("full_name")
    meta = F.format_string(META_TEMPLATE, F.col("title"), d, name, d, img, name, d, img)
    return out.withColumn("meta_html", meta).drop("full_name")


def inject_meta(html: Column, meta: Column) -> Column:
    """Replace the page's first one-line ``<title>…</title>`` with ``meta``
    (pages without one are returned unchanged)."""
    found = F.regexp_extract(html, TITLE_PATTERN, 0)
    at = F.instr(html, found)
    spliced = F.concat(F.substring(html, F.lit(1), at - 1), meta,
                       F.substring(html, at + F.length(found), F.length(html)))
    return F.when(found == "", html).otherwise(spliced)


def _utf8_prefix(text: Column, max_bytes: Column) -> Column:
    """Longest prefix of ``text`` with at most ``max_bytes`` UTF-8 bytes,
    cut on a character boundary: a character has at most four bytes, so one
    of the last four cuts is one."""
    raw = text.cast("binary")
    cuts = [F.substring(raw, F.lit(1), F.greatest(F.lit(0), max_bytes - j)).cast("string") for j in range(4)]
    return F.coalesce(*[F.when(F.is_valid_utf8(c), c) for c in cuts])


def post_text(enriched: DataFrame, base_url: str, limit: int = 270) -> DataFrame:
    """Post text per repository: head with the full name, summary, link,
    hashtags. Hashtags: every language (spaces removed, sorted by name),
    then topics of at most 15 bytes (dashes removed) while fewer than 4
    tags exist. The summary is cut so the whole text fits ``limit`` bytes,
    ending in ``...``. → repository_id, text"""
    langs = F.array_sort(F.map_keys("languages"))
    lang_tags = F.transform(langs, lambda x: F.concat(F.lit("#"), F.replace(x, F.lit(" "), F.lit(""))))
    short = F.filter("topics", lambda t: F.octet_length(t) <= MAX_TOPIC_BYTES)
    room = F.greatest(F.lit(0), F.lit(MAX_HASHTAGS) - F.size(lang_tags))
    topic_tags = F.slice(F.transform(short, lambda t: F.concat(F.lit("#"), F.replace(t, F.lit("-"), F.lit("")))),
                         1, room)
    hashtags = F.array_join(F.concat(lang_tags, topic_tags), " ")
    link = F.concat(F.lit(base_url.rstrip("/") + "/repository/"), F.col("id").cast("string"))
    head = F.concat(F.lit(POST_HEAD), F.col("full_name"), F.lit("\n\n"))
    tail = F.concat(F.lit("\n\n" + POST_LINK), link, F.lit("\n\n"), hashtags)
    summary = F.coalesce("description", F.lit(""))
    remaining = F.lit(limit) - F.octet_length(head) - F.octet_length(tail)
    cut = F.concat(_utf8_prefix(summary, F.greatest(F.lit(0), remaining - 3)), F.lit("..."))
    body = F.when(F.octet_length(summary) > remaining, cut).otherwise(summary)
    return enriched.select(F.col("id").alias("repository_id"), F.concat(head, body, tail).alias("text"))


def next_to_post(trending: DataFrame, enriched: DataFrame, posted: DataFrame, n: int = 1) -> DataFrame:
    """First ``n`` trending repositories (by rank) not yet posted and with a
    record. → repository_id, rank"""
    return (trending.select("repository_id", "rank")
            .join(posted.select("repository_id"), "repository_id", "left_anti")
            .join(enriched.select(F.col("id").alias("repository_id")), "repository_id", "left_semi")
            .orderBy("rank").limit(n))


def mark_posted(posted: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """Insert-if-absent: existing markers keep their time, new ids get
    ``as_of``. → repository_id, posted_at"""
    fresh = (new.select("repository_id").distinct()
             .join(posted.select("repository_id"), "repository_id", "left_anti")
             .withColumn("posted_at", ts_lit(as_of, col_type(posted, "posted_at"))))
    return posted.select("repository_id", "posted_at").unionByName(fresh)
