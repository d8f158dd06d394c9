"""Enrichment in its odd cases."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidewire.operators import enrich, reading

NOW = datetime(2026, 7, 1, tzinfo=timezone.utc)


def test_frontmatter(spark):
    rows = [("a", "---\nid: x\n# note\nname: A: b\ndefault: true\nid: y\n---\nBody  \nmore\n"), ("none", "id: x"), ("open", "---\nid: x\n"), ("null", None)]
    got = enrich.frontmatter(spark.createDataFrame(rows, "name string, body string")).collect()
    assert [(r.name, r.meta, r.body) for r in got] == [("a", {"name": "A: b", "default": "true", "id": "y"}, "Body  \nmore")]


def test_old_and_undated_reviews_go(spark):
    cache = spark.createDataFrame([("k1", NOW - timedelta(days=20)), ("k2", NOW - timedelta(days=22)), ("k3", None)], "key string, scored_at timestamp")
    assert [r.key for r in enrich.kept_reviews(cache, NOW).collect()] == ["k1"]


def test_changed_titles_lose_their_review(spark):
    items = spark.createDataFrame([("s", "new title")], "story_id string, title string")
    cache = items.select(enrich.review_key(F.col("story_id"), F.lit("p"), F.lit("v")).alias("key"), enrich.title_mark(F.lit("old title")).alias("title_mark"), F.lit("r").alias("review"), F.lit("9").alias("score"))
    assert enrich.reviewed(items, [("p", "v")], cache).first().review is None


def test_wiki_updates_without_any(spark):
    none = spark.createDataFrame([], "date string, title string, url string")
    blocked = spark.createDataFrame([("source", "WaytoAGI")], "kind string, value string")
    rows, counts = enrich.wiki_updates(none, blocked)
    assert rows.collect() == [] and tuple(counts.first()) == (None, 0, 0)
    some = spark.createDataFrame([("2026-06-30", "t", "https://w.example/"), (None, "u", None)], none.schema)
    assert enrich.wiki_updates(some, blocked)[1].first().count_7d == 0
    assert tuple(enrich.wiki_updates(some, blocked.limit(0))[1].first()) == ("2026-06-30", 1, 2)


def test_stories_are_found_by_their_members(spark):
    stories = spark.createDataFrame([("a", "Title one"), ("b", "Other"), ("c", None)], "story_id string, title string")
    members = spark.createDataFrame([("a", "aihot", "X：Ann (@ann)", "AI HOT", "hello"), ("b", "zeli", "s", "Zeli", "World porn, a virtual girlfriend"), ("c", "zeli", None, None, "plain")], "story_id string, site_id string, source string, site_name string, title string")
    ids = lambda df: sorted(r.story_id for r in df.collect())
    assert ids(reading.matching_stories(stories, members, query=" HELLO ")) == ["a"] and ids(reading.matching_stories(stories, members, query="title")) == ["a"]
    assert ids(reading.matching_stories(stories, members, author="@ann")) == ["a"] and ids(reading.matching_stories(stories, members, site="zeli")) == ["b", "c"]
    assert ids(reading.matching_stories(stories, members)) == ["a", "b", "c"] and ids(reading.safe_stories(stories, members)) == ["a", "c"]
    assert reading.leading_stories(stories.withColumn("score", F.lit(0.5)), NOW - timedelta(hours=49), NOW).count() == 0


def test_contexts_and_fallback_scores(spark):
    df = spark.createDataFrame([("s", "T", 61.5, [("a",), (None,), ("",)], "old", "x")], "story_id string, title string, importance_score double, sources array<struct<source:string>>, persona_review string, body string")
    assert enrich.item_context(df).first().context == '{"story_id":"s","title":"T","importance_score":61.5,"sources":[{"source":"a"}]}'
    got = enrich.fallback_scores(df, NOW).first()
    assert (got.persona_id, got.persona_score, got.persona_meta.mode) == ("pragmatic", 62, "rules_fallback") and "persona_review" not in enrich.fallback_scores(df, NOW).columns
    texts = spark.createDataFrame([(None, "t", True), (" t ", "t", True), ("said", "t", False), ("", None, True)], "s string, t string, want boolean")
    assert all(r.x == r.want for r in texts.select(enrich.summary_missing(F.col("s"), F.col("t")).alias("x"), "want").collect())
