import random
from datetime import datetime, timedelta, timezone
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tidewire.operators import archive, dedup, govern, overlap
from tidewire.sources import landing
from tidewire.streaming.landing import new_items, upserting

NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
ARCHIVE = "id string, site_id string, site_name string, source string, title string, url string, published_at timestamp, first_seen_at timestamp, last_seen_at timestamp"


def test_upsert_keeps_first_published_time(spark):
    early, late = NOW - timedelta(hours=9), NOW - timedelta(hours=1)
    old = spark.createDataFrame(
        [("a", "zeli", "n", "s", "t", "u", early, early, early), ("b", "zeli", "n", "s", "t", "u", None, early, early), ("c", "opmlrss", "n", "s", "t", "u", early, early, early), ("d", "zeli", "n", "s", "t", "u", early, early, early)], ARCHIVE
    )
    rows = [(i, site, "n", "s", f"t{k}", "u", late, k) for k, (i, site) in enumerate([("a", "zeli"), ("b", "zeli"), ("c", "opmlrss"), ("e", "zeli"), ("e", "zeli"), (None, "zeli")])]
    batch = spark.createDataFrame(rows, "id string, site_id string, site_name string, source string, title string, url string, published_at timestamp, pos long")
    got = {r.id: r for r in archive.upserted(old, batch, NOW).withColumn("p", F.unix_micros("published_at")).withColumn("f", F.unix_micros("first_seen_at")).withColumn("l", F.unix_micros("last_seen_at")).collect()}
    at = lambda t: int(t.timestamp() * 1e6)
    assert {k: r.p for k, r in got.items()} == {"a": at(early), "b": at(late), "c": at(late), "d": at(early), "e": at(late)}
    assert got["a"].f == at(early) and got["a"].l == at(NOW) and got["d"].l == at(early) and got["e"].title == "t4" and got["e"].f == at(NOW)
    assert archive.upserted(old.limit(0), batch.limit(0), NOW).count() == 0
    assert {r.id for r in archive.retained(old, early + timedelta(days=30)).collect()} == set()


def item(spark, rows):
    made = spark.createDataFrame(rows, "id string, site_id string, title string, event_time timestamp, ai_score double, source_tier_rank int")
    return made.withColumn("url", F.concat(F.lit("https://x.example/"), "id")).withColumn("source", F.lit("s"))


def brute(rows):
    """Ids that stay, by a plain loop over each site."""
    stop = {"a", "an", "and", "the", "of", "to", "in", "on", "new", "for"}
    gone = set()
    for site in {r[1] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[1] == site), key=lambda r: (r[3], r[0])):
            words = {w for w in r[2].lower().split() if w not in stop and len(w) > 1}
            if len(words) < 4 or len(r[2]) < 18:
                kept.append((r, words))
                continue
            for k in range(len(kept) - 1, max(-1, len(kept) - 61), -1):
                o, other = kept[k]
                if (r[3] - o[3]).total_seconds() > 6 * 3600 or len(words & other) / len(words | other) < 0.5:
                    continue
                q = SequenceMatcher(None, r[2].lower(), o[2].lower()).ratio()
                if round(max(q, 0.6 * q + 0.4 * len(words & other) / len(words | other)), 4) >= 0.9:
                    if (-r[5], r[4], -r[3].timestamp()) > (-o[5], o[4], -o[3].timestamp()):
                        gone.add(o[0])
                        kept[k] = (r, words)
                    else:
                        gone.add(r[0])
                    break
            else:
                kept.append((r, words))
    return {r[0] for r in rows} - gone


WORDS = ["river", "stone", "market", "cloudy", "senate", "passes", "billing", "reform", "after", "debate", "winter", "storm"]


def test_near_duplicates_as_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.sample(WORDS, 6)) for _ in range(12)]
    rows = []
    for k in range(400):
        title = rng.choice(base).split()
        if rng.random() < 0.5:
            title[rng.randrange(6)] += rng.choice(["s", "ed", ""])
        rows.append((f"i{k:03d}", rng.choice(["p", "q"]), " ".join(title), NOW + timedelta(minutes=rng.randrange(0, 6000)), rng.choice([0.5, 0.7]), rng.choice([1, 2])))
    got = {r.id for r in dedup.without_near_duplicates(item(spark, rows)).collect()}
    assert got == brute(rows) and len(got) < 400
    # Slices of a few rows whose guesses fail, one after the other, end alike.
    for size, warm in ((20, 0), (7, 3), (60, 20)):
        assert {r.id for r in dedup.without_near_duplicates(item(spark, rows), slice_rows=size, warm=warm).collect()} == got
    assert dedup.without_near_duplicates(item(spark, [("n", None, None, None, None, None)])).count() == 1


def test_near_duplicates_of_a_busy_site_spread_over_tasks(spark):
    n = F.col("id")
    rows = spark.range(30_000).select(n.cast("string").alias("id"), F.lit("p").alias("site_id"), F.regexp_replace(F.sha1(F.floor(n / 3).cast("string")), "(.{8})", "$1 ").alias("title"), (F.lit(NOW) + F.make_dt_interval(secs=n * 2)).alias("event_time"), F.lit(0.5).alias("ai_score"), F.lit(1).alias("source_tier_rank"))
    sliced = dedup._sliced(rows.select(F.col("site_id").alias("site"), F.unix_micros("event_time").alias("at")), 1000)
    assert sliced.groupBy("slice").count().agg(F.max("count"), F.count("*")).first()[:] <= (1030, 31)
    assert dedup.without_near_duplicates(rows, slice_rows=1000).count() == 10_000


def test_distinct_items_prefers_tier_then_time(spark):
    rows = [("a", "zeli", "Same title", NOW, 0.5, 5), ("b", "official_ai", "Same title ", NOW - timedelta(days=1), 0.5, 0), ("c", "zeli", "Same title", NOW, 0.5, 5), ("d", "zeli", "Other", None, None, None)]
    items = item(spark, rows).withColumn("url", F.when(F.col("id") == "c", "https://y.example/").otherwise("https://x.example/?utm_a=1"))
    assert {r.id for r in dedup.distinct_items(items).collect()} == {"b", "c", "d"}
    assert dedup.distinct_items(items.limit(0)).count() == 0


def test_overlap_stages(spark):
    rows = [("c1", "x", "One", "https://a.example/1?utm_a=2"), ("c2", "x", "Second Title", "https://q.example/"), ("c3", "x", "alpha beta gamma delta epsilon zeta eta theta iota", "https://r.example/"), ("c4", "x", "Only mine", "https://z.example/"), ("c5", "x", None, None)]
    base = [("b1", "y", "Uno", "https://a.example/1"), ("b2", "y", "second title", "https://w.example/"), ("b3", "y", "alpha beta gamma delta epsilon zeta eta theta", "https://v.example/"), ("b4", "x", "Only mine", "https://z.example/"), ("b5", "y", None, None)]
    make = lambda r: spark.createDataFrame(r, "id string, site_id string, title string, url string")
    got = {r.id: (r.match, r.best_id) for r in overlap.classified(make(rows), make(base)).collect()}
    assert got == {"c1": ("url_exact", "b1"), "c2": ("title_exact", "b2"), "c3": ("title_similarity", "b3")}


def test_gate_and_leaks(spark):
    rows = [(str(k), "t", "https://x.example/", NOW) for k in range(25)] + [("", "t", "ftp://x", None)]
    items = spark.createDataFrame(rows, "id string, title string, url string, event_time timestamp")
    sites = spark.createDataFrame([(str(k), k > 1) for k in range(5)], "site_id string, ok boolean")
    got = {r.rule: r.ok for r in govern.gate(items, sites, items.limit(4), NOW + timedelta(hours=1)).collect()}
    assert got == {"fresh": True, "adapters": True, "success": False, "brief": False, "latest": True, "shape": False}
    empty = {r.rule: r.ok for r in govern.gate(items.limit(0), sites.limit(0), items.limit(0), NOW).collect()}
    assert not empty["fresh"] and empty["shape"]
    texts = spark.createDataFrame([("1", "mail x@y.example"), ("2", "fine"), ("3", None)], "id string, text string")
    assert [r.id for r in govern.leaks(texts, ["text"]).collect()] == ["1"]
    view = govern.published_view(texts.withColumn("url", F.lit("https://u:p@h.example/?sig=1#f")), ["text"], ["url"]).orderBy("id").first()
    assert (view.text, view.url) == ("mail [redacted-email]", "https://h.example/")


def test_feeds(spark, tmp_path):
    (tmp_path / "rss.xml").write_text("<rss><channel><item><title> A  b </title><link>https://x.example/1</link><pubDate>Wed, 01 May 2024 10:00:00 +0000</pubDate></item><item><title> A  b </title><link>https://x.example/1</link></item><item><title>c</title><link>https://x.example/2</link><pubDate>never</pubDate></item></channel></rss>")
    got = {r.title: r.at for r in landing.feed_items(spark, str(tmp_path / "rss.xml"), "zeli", "Zeli").withColumn("at", F.unix_micros("published_at")).collect()}
    assert set(got) == {"A b", "c"} and got["c"] is None
    (tmp_path / "atom.xml").write_text('<feed><entry><title>d</title><link href="https://x.example/3"/><updated>2024-05-01T10:00:00Z</updated></entry></feed>')
    row = landing.feed_items(spark, str(tmp_path / "atom.xml"), "zeli", "Zeli", row_tag="entry").withColumn("at", F.unix_micros("published_at")).first()
    assert (row.url, row.at) == ("https://x.example/3", int((NOW - timedelta(hours=2)).timestamp() * 1e6))
    (tmp_path / "subs.opml").write_text('<opml><body><outline text="g"><outline text="T" title="" xmlUrl="https://f.example/a" htmlUrl="https://f.example"/><outline xmlUrl="https://f.example/a"/></outline></body></opml>')
    assert [tuple(r) for r in landing.subscriptions(spark, str(tmp_path / "subs.opml")).collect()] == [("T", "https://f.example/a", "https://f.example")]
    (tmp_path / "api.json").write_text('{"items": [{"t": "x", "u": "https://x.example/9", "s": 1714557600}]}')
    fields = {"source": "'api'", "title": "row.t", "url": "row.u", "published_at": "timestamp_seconds(row.s)"}
    both = landing.union_of([landing.json_items(spark, str(tmp_path / "api.json"), fields, "zeli", "Zeli", explode="items"), landing.feed_items(spark, str(tmp_path / "rss.xml"), "zeli", "Zeli")])
    assert both.count() == 3
    assert landing.archive_at(spark, str(tmp_path / "none"), ARCHIVE).count() == 0


def test_stream_of_items(spark, tmp_path):
    rows = [("zeli", "z", "s", "t", "https://x.example/1?utm_a=1", NOW), ("zeli", "z", "s", "T ", "https://x.example/1", NOW), ("zeli", "z", "s", "", "https://x.example/2", NOW)]
    spark.createDataFrame(rows, "site_id string, site_name string, source string, title string, url string, published_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("site_id string, site_name string, source string, title string, url string, published_at timestamp").parquet(str(tmp_path / "in"))
    seen = []
    times = []

    def upsert(batch, at):
        times.extend(r.t for r in batch.select(at.alias("t")).collect())
        seen.extend((r.id, r.pos) for r in batch.collect())

    upserting(new_items(stream), upsert, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(120)
    assert len(seen) == 1 and seen[0][1].id == seen[0][0] and len(times) == 1


def test_block_list_of_any_size(spark):
    items = spark.createDataFrame([("1", "https://a.example/?utm_x=1", "s"), ("2", "https://b.example/", "s"), ("3", "https://c.example/", "t"), ("4", None, None)], "id string, url string, source string")
    blocked = spark.createDataFrame([("id", "2"), ("url", "https://A.example"), ("source", "t"), ("source", None), ("other", "4")], "kind string, value string")
    assert [r.id for r in archive.without_blocked(items, blocked).collect()] == ["4"]
    assert archive.without_blocked(items, blocked.limit(0)).count() == 4
