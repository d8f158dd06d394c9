from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidewire.functions import text, times, urls
from tidewire.functions.scores import with_creator_ranking, with_relevance, with_tier

NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)


def one(spark, value, *functions, kind="string"):
    row = spark.createDataFrame([(value,)], f"x {kind}").select(*(f(F.col("x")).alias(str(k)) for k, f in enumerate(functions))).first()
    return list(row) if len(functions) > 1 else row[0]


def test_urls(spark):
    url = " HTTPS://User@News.Example:8080/A/b/?utm_Source=x&q=a+b%2A&fbclid=1&empty=&ID=7#top "
    assert one(spark, url, urls.normalized, urls.host_of, urls.canonical, urls.public) == [
        "https://user@news.example:8080/A/b/?q=a+b%2A&empty=&ID=7",
        "user@news.example:8080",
        "https://user@news.example:8080/A/b/?ID=7",
        "https://news.example:8080/A/b/?utm_Source=x&q=a+b%2A&fbclid=1&empty=&ID=7",
    ]
    assert one(spark, "https://a.example/x/?utm_a=1", urls.normalized) == "https://a.example/x"
    assert one(spark, " no scheme/ ", urls.normalized, urls.public) == ["no scheme/", ""]
    assert one(spark, "https://a.example/?token=abc&k=%zz&flag", urls.public) == "https://a.example/?k=%25zz&flag="
    assert one(spark, None, urls.normalized, urls.host_of) == [None, ""]
    assert one(spark, "", urls.normalized, urls.canonical, urls.public) == ["", "", ""]


def test_texts(spark):
    assert one(spark, "\t　New  OpenAI GPT-5 模型发布 the https://x.example/y a\n", text.title_tokens) == ["openai", "gpt", "模型发布"]
    assert one(spark, "OpenAI and Gemini 2.5 meet GPT 5", text.vendors, text.models) == [["google", "openai"], ["gemini-2.5", "gpt-5"]]
    assert one(spark, "mail a.b@c.example or sk-abcdefghijklmnop and sk-hynix-memory-chips", text.redacted) == "mail [redacted-email] or [redacted-secret] and sk-hynix-memory-chips"
    assert one(spark, "a　 \n b", text.squeezed) == "a b"
    assert one(spark, "x" * 300, lambda c: text.cut(c, 96)) == "x" * 95 + "…"
    assert one(spark, "Hello big world", text.mostly_english, text.has_cjk) == [True, False]
    assert one(spark, None, text.title_tokens, text.redacted, text.mostly_english) == [None, None, None]
    assert one(spark, " ", lambda c: text.first_non_empty(c, F.lit(None), F.lit(" b "))) == "b"
    assert one(spark, "Alpha / 阿尔法", lambda c: text.story_title(c, F.lit("yes"))) == "alpha"


def test_times(spark):
    assert one(spark, "1700000000", times.unix_time) == one(spark, "1700000000000", times.unix_time)
    assert one(spark, "x", times.unix_time) is None
    micros = lambda f: lambda c: F.unix_micros(f(c))
    now = int(NOW.timestamp() * 1e6)
    assert one(spark, "8分钟前", micros(lambda c: times.relative_time_zh(c, NOW))) == now - 480_000_000
    assert one(spark, "soon", micros(lambda c: times.relative_time_zh(c, NOW))) is None
    fixed = lambda chinese: micros(lambda c: times.corrected_future(c, NOW, chinese))
    assert one(spark, NOW + timedelta(hours=1), fixed(False), kind="timestamp") == now + 3_600_000_000
    assert one(spark, NOW + timedelta(hours=8), fixed(True), kind="timestamp") == now
    assert one(spark, NOW + timedelta(hours=30), fixed(True), kind="timestamp") == now
    assert one(spark, None, fixed(True), kind="timestamp") is None
    assert one(spark, NOW - timedelta(hours=48), lambda c: times.freshness(c, NOW), kind="timestamp") == 0.5


def scored(spark, *rows):
    made = spark.createDataFrame(list(rows), "site_id string, source string, title string, url string").withColumn("site_name", F.lit("s"))
    return {r.title: r for r in with_tier(with_relevance(made)).collect()}


def test_relevance(spark):
    got = scored(
        spark,
        ("newsnow", "x", "Precursor ships a new gateway", "https://a.example/"),
        ("newsnow", "x", "Cursor ships a new editor", "https://a.example/"),
        ("newsnow", "x", "World news today", "https://a.example/llmgptllm"),
        ("newsnow", "x", "World news host", "https://openai.com/llm"),
        ("newsnow", "x", "A travel agent writes", "https://a.example/"),
        ("newsnow", "x", "An agent for the developer cloud", "https://a.example/"),
        ("aibase", "x", "Anything at all", "https://a.example/"),
        ("newsnow", "x", "nsfw nudes uncensored pictures by AI", "https://a.example/"),
        ("newsnow", "x", "nsfw filters in AI policy", "https://a.example/"),
        ("curated_media", "MarkTechPost Research", "Gardening for all", "https://a.example/"),
        ("curated_media", "TechCrunch AI", "Gardening for everyone", "https://a.example/"),
        ("aihot", "Mistral AI：News（网页）", "Official note", "https://a.example/"),
        (None, None, "", None),
    )
    flags = {k: r.ai_is_related for k, r in got.items()}
    assert flags["Precursor ships a new gateway"] is False and flags["Cursor ships a new editor"] is True
    assert flags["World news today"] is False and flags["World news host"] is True
    assert flags["A travel agent writes"] is False and flags["An agent for the developer cloud"] is True
    assert got["Anything at all"].ai_score == 1.0 and got["Anything at all"].ai_signals == ["aibase"]
    assert got["nsfw nudes uncensored pictures by AI"].ai_label == "unsafe_content" and flags["nsfw filters in AI policy"] is True
    assert got["Gardening for all"].ai_score == 0.22 and got["Gardening for everyone"].ai_score == 0.76
    assert got["Official note"].source_tier == "official" and got["Official note"].source_tier_rank == 0
    assert got[""].ai_is_related is False and got[""].source_tier_rank == 9


def test_creator_ranking(spark):
    rows = [("a", "tikhub_douyin", NOW - timedelta(days=3), (10**6, 0, 0, 0)), ("b", "tikhub_douyin", NOW, (9, 0, 0, 0)), ("c", "tikhub_xiaohongshu", None, (-5, None, None, None))]
    made = spark.createDataFrame(rows, "id string, site_id string, published_at timestamp, creator_metrics struct<likes:bigint,comments:bigint,collects:bigint,shares:bigint>").withColumn("first_seen_at", F.lit(None).cast("timestamp"))
    got = {r.id: r for r in with_creator_ranking(made, NOW).collect()}
    assert got["a"].creator_hot_score == 85.0 and got["b"].creator_hot_score == 32.0 and got["b"].creator_freshness_bonus == 15.0
    assert got["c"].creator_engagement_total == 0.0 and got["c"].creator_hot_score == 0.0
