"""Labels of items and what readers' texts say in short."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidewire.functions import reading as r
from tidewire.sources.landing import reader_context

NOW = datetime(2026, 1, 1, 1, tzinfo=timezone.utc)


def test_reader_context_takes_title_and_prose(spark):
    body = "A first line of real prose, long enough."
    cases = [
        (f"Title: A page\nURL Source: https://a.b/c\nMarkdown Content:\n* [Best of the day](https://a.b/day)\n\n{body}\r\n## A heading that is long enough to be read", f"Title: A page\n{body}\n## A heading that is long enough to be read"),
        ("* [Only](https://a.b) | [links](https://a.b)\n![image of a very large thing](x)\n" + "\n" * 40 + body + "\nTITLE: late one", "TITLE: late one"),
        ("\n".join(f"{k}. {body}" for k in range(5)), "\n".join(f"{k}. {body}" for k in range(3))),
        ("\n" * 39 + body, body), ("\n" * 40 + body, ""), ("x" * 20, "x" * 20), ("- " + "x" * 19, ""), (" 　", ""), ("", ""), (None, ""),
    ]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, text string").select("k", reader_context(F.col("text")).alias("c")).collect()
    assert [x.c for x in sorted(got)] == [want for _, want in cases]


def test_tags_and_impacts(spark):
    rows = [(0, ["models", "devtools", "hn", "community"], "aihot", True), (1, ["products"], None, False), (2, ["community", "hn"], "official_ai", False), (3, ["creator"], "x", False)]
    df = spark.createDataFrame(rows, "k int, s array<string>, site string, many boolean")
    got = df.select("k", r.tags(F.col("s"), F.col("site"), F.col("many")).alias("hot"), r.tags(F.col("s"), F.col("site"), F.col("many"), "devtools").alias("tools"), r.impacts(F.col("s")).alias("impacts")).orderBy("k").collect()
    assert [x.hot for x in got] == [["多源验证", "AI HOT", "模型发布"], [], ["官方", "社区热议", "社区"], ["自媒体"]]
    assert [x.tools for x in got] == [["开发者", "多源验证", "AI HOT"], ["开发者"], ["开发者", "官方", "社区热议"], ["开发者", "自媒体"]]
    assert [x.impacts for x in got] == [["开发者", "模型团队", "社区"], ["产品"], ["社区"], ["AI 观察者"]]


def test_days_are_local(spark):
    # 01:00 UTC of 1 January is 09:00 in Shanghai; 17:00 of the day before is that day there.
    rows = [(0, datetime(2025, 12, 31, 17)), (1, datetime(2025, 12, 31, 15)), (2, None)]
    df = spark.createDataFrame(rows, "k int, at timestamp_ntz").select("k", F.col("at").cast("timestamp").alias("at"))
    got = df.select("k", r.day_label(F.col("at"), NOW).alias("day"), r.weekday(F.col("at")).alias("weekday")).orderBy("k").collect()
    assert [(x.day, x.weekday) for x in got] == [("1月1日", "星期四"), ("2025年12月31日", "星期三"), ("时间未知", "")]
