from pyspark.sql import functions as F

from conftest import ts
from reposcope.functions.languages import primary_language, primary_of_map
from reposcope.functions.sets import jaccard
from reposcope.functions.time import parse_duration
from reposcope.operators import facets as FA
from reposcope.operators import publish as PB
from reposcope.sources import ingest as IN


def test_jaccard(spark):
    df = spark.createDataFrame([([], []), (["a", "a", "b"], ["a", "c"]), (None, ["x"])],
                               "a array<string>, b array<string>")
    got = [r.j for r in df.select(jaccard(F.col("a"), F.col("b")).alias("j")).collect()]
    assert got == [0.0, 1 / 3, 0.0]


def test_primary_language(spark):
    langs = spark.createDataFrame([(1, "Go", 10), (1, "C", 10), (1, "Rust", 3)],
                                  "repository_id long, language string, size long")
    assert primary_language(langs).first().language == "Go"  # tie → greatest name
    m = spark.createDataFrame([({},), ({"Go": 1, "Zig": 1},)], "m map<string,bigint>")
    assert [r.p for r in m.select(primary_of_map(F.col("m")).alias("p")).collect()] == ["Unknown", "Zig"]


def test_crawl_gate(spark):
    disc = spark.createDataFrame([(1, ts("2024-01-01")), (2, ts("2024-01-05")), (3, ts("2024-01-05"))],
                                 "repository_id long, pushed_at timestamp_ntz")
    repos = spark.createDataFrame([(1, ts("2024-01-02")), (2, ts("2024-01-05"))], "id long, last_crawled_at timestamp_ntz")
    got = {r.repository_id: r.needs_crawl for r in IN.needs_crawl(disc, repos).collect()}
    assert got == {1: False, 2: True, 3: True}  # older skip, equal crawl, unknown crawl


def test_facets(spark):
    ranked = spark.createDataFrame([(3, 1), (1, 2), (3, 3), (2, 4)], "repository_id long, rank long")
    langs = spark.createDataFrame([(1, "Go", 1), (2, "go", 1), (3, "Rust", 1)],
                                  "repository_id long, language string, size long")
    tags = spark.createDataFrame([(1, "cli"), (3, "web")], "repository_id long, tag string")
    topics = spark.createDataFrame([(1, "x")], "repository_id long, topic string")
    out = FA.facet_filter(ranked, langs, tags, topics, languages=["Go", "Rust"], tag_names=["web", "cli"])
    assert [(r.repository_id, r.rank) for r in out.orderBy("rank").collect()] == [(3, 1), (1, 2), (3, 3)]
    assert FA.facet_filter(ranked, langs, tags, topics).count() == 4  # all empty → unchanged
    assert FA.facet_filter(ranked, langs, tags, topics, languages=["GO"]).count() == 0  # case-sensitive
    req = spark.createDataFrame([("",), ("go,python",), ("b,a,",), (None,)], "s string")
    got = [r.p for r in req.select(FA.parse_facets(F.col("s")).alias("p")).collect()]
    assert got == [[], ["go", "python"], ["", "a", "b"], []]


def test_post_text_rules(spark):
    long_desc = "x" * 400
    df = spark.createDataFrame([
        (1, "o/five", long_desc, {"A B": 1, "C": 1, "D": 1, "E": 1, "F": 1}, ["t1"]),
        (2, "o/two", "short", {"Go": 1}, ["sixteen-bytes-xx", "web-app", "a", "b", "c"]),
        (3, "o/utf", "é" * 300, {}, []),
    ], "id long, full_name string, description string, languages map<string,bigint>, topics array<string>")
    out = {r.repository_id: r.text for r in PB.post_text(df, "https://example.org").collect()}
    tags1 = out[1].rsplit("\n\n", 1)[1].split(" ")
    assert tags1 == ["#AB", "#C", "#D", "#E", "#F"]  # 5 languages, no topic
    assert len(out[1].encode()) <= 270 and "..." in out[1]
    tags2 = out[2].rsplit("\n\n", 1)[1].split(" ")
    assert tags2 == ["#Go", "#webapp", "#a", "#b"]  # 16-byte topic skipped, 4 tags max
    assert len(out[3].encode()) <= 270 and "�" not in out[3]  # cut on a character


def test_html_snippet_and_bot_flag(spark):
    html = "<style>a{}</style>x<style>b</style><script>s</script>\n<p>Hello</p>   <b>World</b>\n"
    df = spark.createDataFrame([(html, "Mozilla Googlebot/2.1"), ("<i>a</i>b", "curl")], "h string, ua string")
    got = df.select(PB.html_snippet(F.col("h"), 400).alias("s"), PB.bot_flag(F.col("ua")).alias("b")).collect()
    assert got[0].s == "Hello World" and got[0].b is True  # greedy block drop, spaces collapsed
    assert got[1].s == "a b" and got[1].b is False


def test_duration_column_equals_the_function(spark):
    from datetime import timedelta

    from reposcope.functions.time import duration_micros

    texts = ["24 months", "-2 years", "1h30m", " 720h ", "-1.5h", "+2m3s", "15ms", "7us", "7µs", "2600ns", "0s",
             "", "h", "3 days", "1h 30m", "5", "1 month", "h1", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.select("text", duration_micros(df["text"]).alias("micros")).collect():
        try:
            expected = round(parse_duration(row["text"]) / timedelta(microseconds=1))
        except (ValueError, AttributeError):
            expected = None
        assert row["micros"] == expected, row


def test_parse_duration():
    assert parse_duration("24 months").days == 720
    assert parse_duration("2 years").days == 730
    assert parse_duration("1h30m").total_seconds() == 5400


def test_bad_message_line_and_wrapped_strings(spark):
    pages = spark.createDataFrame([
        ('{"total_count":2,"items":[{"id":1,"full_name":"a/b","description":{"String":"d","Valid":true}},'
         '{"id":2,"full_name":"c/d","description":{"String":"","Valid":false},"license":null}]}',),
        ("https://github.com/not/json",),
    ], "body string")
    out = {r.id: r.description for r in IN.ingest_search_pages(pages).collect()}
    assert out == {1: "d", 2: None}


def test_enrich_tolerates_duplicate_bridge_keys(spark):
    from reposcope.operators.enrich import enrich
    repos = spark.createDataFrame([(1, 7, None)], "id long, owner_id long, license_key string")
    owners = spark.createDataFrame([(7, "o", None, None, "User")],
                                   "id long, login string, avatar_url string, html_url string, type string")
    lic = spark.createDataFrame([], "key string, name string, spdx_id string, url string")
    tags = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "repository_id long, tag string")
    topics = spark.createDataFrame([], "repository_id long, topic string")
    langs = spark.createDataFrame([(1, "Go", 5), (1, "Go", 9), (1, "C", 1)],
                                  "repository_id long, language string, size long")
    r = enrich(repos, owners, lic, tags, topics, langs).first()
    assert r.tags == ["a", "b"] and r.topics == []
    assert r.languages == {"C": 1, "Go": 9} and r.language == "Go"


def test_crawl_envelope(spark):
    """Discovery messages through gate and envelope: a second landed body per
    repository, and one without languages."""
    from reposcope.streaming.jobs import DISCOVERY_T
    msgs = [('{"repository":{"id":%d,"full_name":"%s","default_branch":"trunk","pushed_at":"2030-01-02T03:04:05Z"},'
             '"discovered_at":"2030-02-01T00:00:01Z"}' % x,) for x in ((41, "ada/loom"), (42, "bo/empty"), (43, "cy/unfetched"))]
    m = spark.createDataFrame(msgs, "value string").select(F.from_json("value", DISCOVERY_T).alias("m"))
    disc = m.select(F.col("m.repository.id").alias("repository_id"),
                    F.col("m.repository.full_name").alias("full_name"),
                    F.col("m.repository.default_branch").alias("default_branch"),
                    IN.parse_time(F.col("m.repository.pushed_at")).alias("pushed_at"),
                    IN.parse_time(F.col("m.discovered_at")).alias("discovered_at"))
    stored = spark.createDataFrame([(41, ts("2029-12-31"))], "id long, last_crawled_at timestamp_ntz")
    gated = IN.needs_crawl(disc, stored).where("needs_crawl")
    landed = "repository_id long, seq int, body string"
    tags = spark.createDataFrame([(41, 1, '[{"name":"old"}]'), (41, 2, '[{"name":"b2"},{"name":"a1"}]'), (42, 1, "[]")], landed)
    langs = spark.createDataFrame([(41, 2, '{"Zig":7,"HTML":5}'), (41, 1, '{"Zig":1}'), (42, 1, "{}")], landed)
    probes = spark.createDataFrame([(41, "README.md", True)], "repository_id long, name string, found boolean")
    repo_rows = disc.select(F.col("repository_id").alias("id"), "full_name", "default_branch")
    urls = IN.readme_candidates(repo_rows, probes, "https://raw.example.org")
    got = {r.repository_id: r for r in IN.crawl_results(
        gated, IN.ingest_tags(IN.latest_landed(tags)), IN.ingest_language_maps(IN.latest_landed(langs)), urls,
        "2030-02-01 00:05:00").collect()}
    assert set(got) == {41, 42}  # 43 has no landed bodies yet
    assert got[41].readme_url == "https://raw.example.org/ada/loom/trunk/README.md" and got[42].readme_url is None
    assert got[41].tags == ["b2", "a1"] and got[42].tags == []
    assert got[41].languages == {"Zig": 7, "HTML": 5} and got[42].languages == {}
    assert got[41].discovered_at == ts("2030-02-01 00:00:01") and got[41].crawled_at is not None


def test_post_text_cuts_on_characters(spark):
    rows = [(k, "o/r" + "x" * k, unit * 300, {}, []) for k in range(4) for unit in ("漢", "é", "🚀", "a\ufffd")]
    df = spark.createDataFrame(rows, "id long, full_name string, description string, languages map<string,bigint>, topics array<string>")
    for r, (_, _, text, _, _) in zip(PB.post_text(df, "https://example.org").collect(), rows):
        summary = r.text.split("\n\n")[1]
        assert 267 <= len(r.text.encode()) <= 270 and summary.endswith("...") and text.startswith(summary[:-3])


def test_posting_job(spark):
    from reposcope.plans.jobs import posting_job
    trending = spark.createDataFrame([(5, 1), (6, 2), (7, 3)], "repository_id long, rank long")
    enriched = spark.createDataFrame([(6, "o/six", "d6", {"Go": 1}, ["cli"]), (7, "o/seven", None, {}, [])],
                                     "id long, full_name string, description string, "
                                     "languages map<string,bigint>, topics array<string>")
    posted = spark.createDataFrame([(5, ts("2024-01-01"))], "repository_id long, posted_at timestamp_ntz")
    posts, nxt = posting_job(trending, enriched, posted, ts("2024-02-01"), "https://example.org")
    p = posts.collect()
    assert [(r.repository_id, r.rank) for r in p] == [(6, 2)]  # 5 posted already, 6 is next
    assert p[0].text.startswith("🚀 Trending on GitHub: o/six\n\nd6\n\n🔗 https://example.org/repository/6")
    assert p[0].text.endswith("#Go #cli")
    assert sorted((r.repository_id, r.posted_at) for r in nxt.collect()) == [(5, ts("2024-01-01")), (6, ts("2024-02-01"))]


def test_inject_meta(spark):
    pages = spark.createDataFrame([
        ("<head><title>a</title><title>b</title></head>",),
        ("<title>x\ny</title><title>one line</title>",),
        ("<p>no title</p>",),
    ], "html string")
    got = [r.o for r in pages.select(PB.inject_meta(F.col("html"), F.lit("[M]")).alias("o")).collect()]
    assert got == ["<head>[M]<title>b</title></head>", "<title>x\ny</title>[M]", "<p>no title</p>"]
    repos = spark.createDataFrame([(3, "o/r", None)], "id long, full_name string, description string")
    meta = PB.page_meta(repos, "site", "https://example.org").first()
    assert meta.title == "o/r - site" and meta.og_image == "https://example.org/api/og?id=3"
    assert meta.meta_html.startswith("\n<title>o/r - site</title>\n<meta name=\"description\" content=\"\">")
