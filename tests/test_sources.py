"""Wiki blocks, embedded data and markup against plain loops and in their odd cases."""

import json
import random
import re
from datetime import date, datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire.operators import sanitize
from tidewire.plans import pages as plans
from tidewire.sources import embedded as E
from tidewire.sources import markup as M
from tidewire.sources import payloads as P
from tidewire.sources import social as S
from tidewire.sources import wiki as W

NOW = datetime(2026, 1, 2, 20, tzinfo=timezone.utc)


def block(kind, parent, text, mention=None):
    pieces = {str(k): text[a : a + 3] for k, a in enumerate(range(0, len(text), 3))}
    pool = {"0": ["author", "x"], "1": ["inline-component", json.dumps({"type": "mention_doc", "data": {"title": mention[0], "raw_url": mention[1]}})]} if mention else {}
    return {"data": {"type": kind, "parent_id": parent, "text": {"initialAttributedTexts": {"text": dict(reversed(pieces.items()))}, "apool": {"numToAttrib": pool}}}}


def plain_updates(blocks, now, page_url):
    today = (now + timedelta(hours=8)).date()
    text = lambda b: "".join(v for _, v in sorted(b["text"]["initialAttributedTexts"]["text"].items(), key=lambda x: int(x[0]))).strip()
    data = {k: b["data"] for k, b in blocks.items()}
    log = {b["parent_id"] for b in data.values() if b["type"][:-1] == "heading" and re.search("近 ?7 ?日更新日志", text(b)) and b["parent_id"]}
    years = {k: int(m[1]) for k, b in data.items() if b["type"] == "heading2" and (m := re.search(r"(20\d\d)\s*年\s*(\d{1,2})\s*月", text(b)))}

    def made(y, m, d):
        try:
            return date(y, m, d)
        except ValueError:
            return None

    days = {}
    for k, b in data.items():
        m = re.search(r"(\d{1,2})\s*月\s*(\d{1,2})\s*日", text(b)) if b["type"] == "heading3" else None
        if not m or log and b["parent_id"] not in log:
            continue
        month, day = int(m[1]), int(m[2])
        this = made(today.year, month, day)
        year = (today.year - (this > today + timedelta(days=2))) if this else years.get(b["parent_id"], today.year)
        if (d := made(year, month, day)) is not None:
            days[k] = d
    out, seen = [], set()
    for k, b in data.items():
        if b["type"] not in ("bullet", "text", "todo", "ordered"):
            continue
        up, hops = b["parent_id"], 0
        while up and hops < 20 and up not in days:
            up, hops = data[up]["parent_id"] if up in data else None, hops + 1
        if not up or hops >= 20 or up not in days:
            continue
        pool = b["text"]["apool"]["numToAttrib"].get("1")
        found = json.loads(pool[1])["data"] if pool else {}
        clean = lambda t: re.sub(r"\s+", " ", t.replace("《 》", "").replace("《》", "")).strip()
        said = clean(text(b))
        title, url = (clean(found["title"]), found["raw_url"]) if found.get("title") and found.get("raw_url") else (said, page_url)
        if title and (days[up].isoformat(), title) not in seen:
            seen.add((days[up].isoformat(), title))
            out.append((days[up].isoformat(), title, said or title, url))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_wiki_updates_match_a_plain_loop(spark, seed):
    """Deep chains, circles, missing parents, days that turn the year, leap days, with and without a recent log."""
    draw = random.Random(seed)
    pages = []
    for page in range(6):
        blocks = {"root": block("page", "", "")}
        if page % 2:
            blocks["log"] = block("heading1", "root", draw.choice(["近7日更新日志", "近 7 日更新日志：", "别的"]))
        for k in range(8):
            blocks[f"m{k}"] = block("heading2", "root", draw.choice(["2024年2月", "2025 年 12 月", "no month"]))
        for k in range(12):
            blocks[f"d{k}"] = block("heading3", draw.choice(["root", "m1", "m2", "m3", None]), draw.choice(["1月2日", "12 月 31 日", "2月29日", "1月8日", "13月1日", "other", "1月5日"]))
        names = [f"d{k}" for k in range(12)]
        for k in range(60):
            mention = (draw.choice(["A title", "另一篇", ""]), draw.choice(["https://w.example/a", ""])) if draw.random() < 0.4 else None
            parent = names[-1] if 10 < k < 34 else draw.choice([*names, "gone", "", None])
            blocks[f"b{k}"] = block(draw.choice(["bullet", "text", "todo", "ordered", "code"]), parent, draw.choice(["《 》 said  more", "plain line", "《》", "", "line %d" % k]), mention)
            names.append(f"b{k}")
        blocks["x"], blocks["y"] = block("text", "y", "circle"), block("text", "x", "circle")
        pages.append((page, f"https://w.example/{page}", blocks))
    frame = spark.createDataFrame([(p, u, json.dumps(b, ensure_ascii=False)) for p, u, b in pages] + [(90, "u", None), (91, "u", "{"), (92, "u", "{}"), (93, "u", "[]")], "page int, url string, body string")
    got = W.updates(frame, NOW).collect()
    assert sorted(tuple(r) for r in got) == sorted((p, *x) for p, u, b in pages for x in plain_updates(b, NOW, u))
    assert len(got) > 20


def test_embedded_values(spark):
    data = {"a": [1, {"s": 'br]ack"et\\'}], "posts": {"x": "y)"}}
    wiki = f"<script>var x=1;{E.CLIENT_VARS}{json.dumps(data)})}});</script>"
    chunks = json.dumps('x:{"list":[{"t":"é","d":"$D2026-01-01","n":"$undefined"},[]],"z":1}')[1:-1]
    a, b = chunks[:20], chunks[20:]
    page = f'<script>self.__next_f.push([1,"{a}"])</script><p>between</p><script>self.__next_f.push([1,"{b}"])</script>'
    rows = [(1, wiki), (2, page), (3, E.CLIENT_VARS + "{"), (4, None), (5, ""), (6, E.CLIENT_VARS + '{"open')]
    got = {r.k: r for r in spark.createDataFrame(rows, "k int, html string").select("k", E.client_vars(F.col("html")).alias("wiki"), E.keyed_value(E.streamed(F.col("html")), '"list"').alias("list"), E.keyed_value(E.streamed(F.col("html")), '"none"').alias("none")).collect()}
    assert json.loads(got[1].wiki) == data and all(got[k].wiki is None for k in range(2, 7))
    assert json.loads(got[2].list) == [{"t": "é", "d": "2026-01-01", "n": "null"}, []] or json.loads(got[2].list)[0]["d"] == "2026-01-01"
    assert all(r.none is None for r in got.values())
    assert E.balanced("[" * 200_000 + "]" * 200_000, 0) == 400_000 and E.balanced('{"}"}', 0) == 5 and E.balanced("(]", 0) is None
    script = spark.createDataFrame([('a={v2ex:vL,"36kr":{name:"x",color:"red"},zhihu:{column:1,title:"a}b"}};rest:1',), ("none",), (None,), ("{v2ex:vL,",)], "js string").select(E.listed_sources(F.col("js")).alias("s")).collect()
    assert [r.s for r in script] == [["v2ex", "36kr", "zhihu"], *[E.DEFAULT_SOURCES] * 3]
    root = 'x{\\"id\\":\\"1\\",\\"type\\":\\"mention_doc\\",\\"data\\":{\\"title\\":\\"历史更新\\",\\"raw_url\\":\\"https:\\/\\/w.example\\/h\\"}}y'
    assert [r.u for r in spark.createDataFrame([(root,), ("",)], "h string").select(W.history_url(F.col("h"), "other").alias("u")).collect()] == ["https://w.example/h", "other"]


def test_items_of_embedded_lists(spark):
    page = "const feeds = [ { name: 'A', url: 'https://a.example/rss' },\n{name:'B',url:'https://b.example/rss'} ] ;"
    feeds = E.listed_feeds(spark.createDataFrame([(1, page), (2, None)], "page int, body string"))
    entries = spark.createDataFrame([("https://b.example/rss", 0, " T1 ", "https://b.example/1", "2026-01-01T00:00:00Z"), ("https://a.example/rss", 1, "T2", "https://a.example/2", None), ("https://a.example/rss", 0, "", "https://a.example/3", None), ("https://c.example/rss", 0, "T4", "u", None)], "feed_url string, at int, title string, link string, published string")
    got = E.listed_feed_items(feeds, entries, NOW).collect()
    assert [(r.source, r.title, r.url) for r in got] == [("A", "T2", "https://a.example/2"), ("B", "T1", "https://b.example/1")]
    assert E.listed_feed_items(feeds, entries, NOW, most=1).count() == 1
    bodies = [(1, '{"data":{"pageCount":2,"dataList":[{"id":7,"title":"Issue 7","createdTimestamp":1767225600000,"articleCount":3},{"id":"","title":"x"}]}}'), (2, '{"data":{"dataList":[{"id":"7","title":"again"},{"id":"8","title":"Issue 8"}]}}'), (3, "{"), (4, None)]
    got = {r.url: (r.title, r.articles, r.published_at and r.published_at.year) for r in E.newsletters(spark.createDataFrame(bodies, "pos int, body string")).collect()}
    assert got == {"https://www.bestblogs.dev/en/newsletter#7": ("Issue 7", 3, 2026), "https://www.bestblogs.dev/en/newsletter#8": ("Issue 8", None, None)}
    blocks = '[{"id":"hn","title":"HN","updatedTime":1767225600000,"items":[{"title":"a","url":"u1"},{"title":"","url":"u"},{"title":"b","url":"u2","extra":{"date":"2026-01-01T00:00:00Z"}}]},{"id":"gh","items":[{"title":"c","url":"u3"}]}]'
    got = E.source_items(spark.createDataFrame([(1, blocks), (2, '{"data":' + blocks + "}"), (3, "x")], "pos int, body string"), NOW).collect()
    assert sorted({(r.source, r.title, r.published_at.replace(tzinfo=timezone.utc) == NOW) for r in got}) == [("HN (hn)", "a", False), ("HN (hn)", "b", False), ("gh", "c", True)] and len(got) == 6


PUBLISHERS = """<div class="publisher-block x" data-publisher="own"><div class=publisher-text><span class="primary">Site</span> <b class="secondary">Top</div>
<div class="publisher-link"><a class="article-link" href=" https://a.example/1 ">One <b>two</a></b></a><div class="aside"><span class="text" title="3分钟前">x</span></div></div>
<div class="publisher-link"><a class="article-link">no link</a></div></div>
<div class="publisher-block" data-publisher="bare"><div class="publisher-link"><p>unclosed<p><a class="article-link big" href="/2">Three &amp; four</a></div></div>"""


def test_markup_gives_items(spark):
    frame = lambda *pages: spark.createDataFrame(list(enumerate(pages)), "page int, html string")
    got = sorted((r.source, r.title, r.url, r.published_at and str(r.published_at)[:16]) for r in M.publisher_items(frame(PUBLISHERS, None, "", "<"), NOW).collect())
    assert got == [("Site · Top", "One two", "https://a.example/1", "2026-01-02 19:57"), ("bare", "Three & four", "/2", None)]
    news = "<a href='/news/1' ><div><h3>A <i>head</i></h3><div class='text-gray-400 text-sm'><span>2小时前</span></div></div></a><a href='/news/2'>none</a><a href='/other'><h3>x</h3></a><a href='/news/3'><h3> </h3></a>"
    got = [(r.title, r.url, str(r.published_at)[:16]) for r in M.headline_items(frame(news), NOW).collect()]
    assert got == [("A head", "https://www.aibase.com/news/1", "2026-01-02 18:00")]
    letters = "<a href='/en/newsletter/1'>Issue number one <time datetime='2026-01-01'>x</time></a><a href='https://h.example/newsletter'>short</a><a href='/en/newsletter/1'>Issue number one again</a>"
    got = [(r.title, r.url, str(r.published_at)[:10]) for r in M.newsletter_links(frame(letters), NOW).collect()]
    assert got == [("Issue number one x", "https://www.bestblogs.dev/en/newsletter/1", "2026-01-01")]
    bundle = M.script_bundle(frame("<script src='/x.js'></script><script>var a='<script src=/assets/index-0.js>'</script><script src='/assets/index-1.js'>"), "https://n.example").collect()
    assert [r.url for r in bundle] == ["https://n.example/assets/index-1.js"]


def test_elements_of_odd_markup(spark):
    html = "<ul><li>a<li>b</ul></div><br/><p>x<p>y</b>z<style>q{}</style><script>'</p>'</script><!-- c --><a href=1 href=2>t &lt;u</a><![bad"
    rows = M.elements(spark.createDataFrame([(1, html), (2, None), (3, "plain"), (4, "<i>" * 3000 + "deep")], "page int, html string"))
    got = {r.pos: (r.tag, r.depth, r.last, r.text) for r in rows.where("page = 1").collect()}
    assert got[1] == ("ul", 1, 3, "a b") and got[2] == ("li", 2, 3, "a b") and got[3] == ("li", 3, 3, "b") and got[4] == ("br", 1, 4, "")
    assert got[5][0] == "p" and got[5][3].startswith("x y z t <u") and got[9][0] == "a" and got[9][1] == 3
    assert rows.where("page = 1 and tag = 'a'").first().attributes == {"href": "1"}
    assert rows.where("page = 4").agg(F.max("depth")).first()[0] == 3000 and rows.where("page in (2, 3)").count() == 0
    assert {r.tag for r in M.elements(spark.createDataFrame([(1, html)], "page int, html string"), ["a", "li"]).collect()} == {"a", "li"}


def test_notes_and_shapes(spark):
    body = json.dumps({"data": {"items": [
        {"id": "5f5e10000000000000000001", "note_card": {"display_title": " A  note ", "user": {"nick_name": "n"}, "interact_info": {"liked_count": "1,200"}, "share_count": 3}, "xsec_token": "t"},
        {"noteId": "b", "title": "bare", "user_info": {"name": "u"}, "time": 1767225600, "url": "https://x.example/b", "note_card": "no object"},
        {"id": "b", "title": "again"}, {"id": "", "title": "none"}, {"id": "c", "note": {"time": "2099-01-01T00:00:00Z", "desc": "later"}, "time": "2025-12-31T00:00:00Z", "like_count": 7},
    ], "business_data": [{"aweme_info": {}}]}})
    deep = '{"id":"d","title":"deep","x":' * 200 + "1" + "}" * 200
    frame = spark.createDataFrame([(1, body), (2, "{"), (3, None), (4, "[" * 100_000), (5, deep), (6, '{"a":' * 10_000 + "1" + "}" * 10_000), (7, '"text"')], "pos int, body string")
    got = {r.post_id: r for r in P.notes(frame, NOW).collect()}
    assert sorted(got) == ["5f5e10000000000000000001", "b", "c", "d"]
    a, b, c = got["5f5e10000000000000000001"], got["b"], got["c"]
    assert (a.title, a.source, a.url, tuple(a.creator_metrics)) == ("A note", "n", "https://www.xiaohongshu.com/explore/5f5e10000000000000000001?xsec_token=t", (1200, 0, 0, 3)) and a.published_at.timestamp() == 0x5F5E1000
    assert (b.title, b.source, b.url, b.published_at.year) == ("bare", "u", "https://x.example/b", 2026)
    assert (c.title, str(c.published_at)[:10], c.creator_metrics.likes) == ("later", "2025-12-31", 7)
    shapes = {r.pos: r for r in P.payload_shapes(frame).collect()}
    assert shapes[1][1:7] == (14, "dict", ["business_data", "items"], 5, 1, 1) and shapes[1].note_card_count == 1
    assert shapes[1].sample_keys == [["id", "note_card", "xsec_token"], ["display_title", "interact_info", "share_count", "user"], ["noteId", "note_card", "time", "title", "url", "user_info"]]
    assert [shapes[k].dict_count for k in (2, 3, 4, 5, 7)] == [0, 0, 0, 200, 0] and shapes[2].data_type is None and shapes[2].data_items_count is None
    assert P.videos(frame, NOW).count() == 0 and sanitize.issues(frame.select(F.col("pos").alias("name"), "body")).count() >= 0
    bare = spark.createDataFrame([(1, '{"list":[{"aweme_id":"1","desc":"bare one"},{"aweme_info":{"aweme_id":"2","desc":"wrapped"}}]}')], "pos int, body string")
    assert {(r.post_id, r.title) for r in P.videos(bare, NOW).collect()} == {("1", "bare one"), ("2", "wrapped")}
    keys = spark.createDataFrame([("s", " 1 ", "u", "t"), ("s", None, "https://X.example/?utm_a=1", " t ")], "s string, p string, u string, t string").select(P.post_key(F.col("s"), F.col("p"), F.col("u"), F.col("t")).alias("k")).collect()
    assert [r.k for r in keys] == ["s:1", "s:https://x.example:t"]


def test_posts_of_searches_and_lists(spark):
    post = lambda id_, name="A", **more: {"id_str": id_, "full_text": f"said {id_}", "user": {"screen_name": name}, **more}
    one = {"tweets": [post("1", tweet_created_at="2026-01-01T00:00:00.000000Z", favorite_count=3), post("2", type="reply"), post("3", "@own"), {"id": 4, "text": " b ", "user": {"screen_name": "bot", "default_profile_image": True}}, post("", "A"), {"id_str": "5", "user": None}, None]}
    two = {"tweets": [post("1"), post("6", type="Quote"), {"id_str": "7", "text": "no user"}], "next_cursor": "x"}
    frame = spark.createDataFrame([(1, json.dumps(one)), (2, json.dumps(two)), (3, "{"), (4, None), (5, "[]")], "pos int, body string")
    got = {r.post_id: (r.source, r.title, r.url, r.published_at.replace(tzinfo=timezone.utc) == NOW, r.counts.favorite_count) for r in S.searched_posts(frame, NOW).collect()}
    assert got["1"] == ("@A", "said 1", "https://x.com/A/status/1", False, 3) and got["7"] == ("@i/web", "no user", "https://x.com/i/web/status/7", True, None)
    assert sorted(got) == ["1", "2", "3", "4", "6", "7"] and [r.post_id for r in S.searched_posts(frame, NOW, most=2).collect()] == ["1", "2"]
    judged = S.judged_list(frame, NOW, ["@OWN", " "])
    assert sorted(r.post_id for r in S.listed_posts(judged).collect()) == ["1", "6"] and [r.post_id for r in S.listed_posts(judged, 1).collect()] == ["1"]
    assert {r.skipped: r.n for r in S.skipped_counts(judged).collect()} == {"retweet_or_reply": 1, "excluded_author": 1, "bot_like": 1, "empty": 3, "duplicate": 1}


def test_mail_digest_tells_no_address(spark):
    mails = {"messages": [{"message_id": "m", "from": "N <n@News.example.com>", "subject": " a  b ", "preview": "x@y.co", "created_at": "t", "attachments": ["f"]}, {"from": "broken"}, {"message_id": "o", "from": "p@other.org"}, None]}
    frame = spark.createDataFrame([(1, json.dumps(mails)), (2, None), (3, "{")], "pos int, body string")
    got = S.mail_digest(frame).orderBy("at").collect()
    assert [(r.sender_domain, r.source, r.subject, r.preview, r.received_at, r.attachments) for r in got] == [("news.example.com", "AgentMail · news.example.com", "a b", "[redacted-email]", "t", 1), (None, "AgentMail", "", "", None, 0), ("other.org", "AgentMail · other.org", "", "", None, 0)]
    assert [r.sender_domain for r in S.mail_digest(frame, ["example.com"]).collect()] == ["news.example.com"] and got[1].id == "agentmail:unknown"
    asked = spark.createDataFrame([("a", "A"), ("b", "B")], "site_id string, site_name string")
    assert sorted(map(tuple, S.platform_counts(spark.createDataFrame([("a",), ("a",), ("c",)], "site_id string"), asked).collect())) == [("a", "A", 2), ("b", "B", 0)]


def test_references_cut_in_titles_match_sql(spark, tmp_path):
    page = '<html><body><div><h1>{}</h1><nav><ul><li><a href="/?a=1&amp;copy=2&lt=3">{}</a></li></ul></nav></div></body></html>'
    said = ["a&amp;&amp", "b&quot", "c&lt", "d&am", "e&", "f&amp;lt;g", "&copy; h&#39;s &gt", "&quot;i&quot;"]
    spark.createDataFrame([(n, page.format(x, x)) for n, x in enumerate(said)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.tag): (r.n, r.told) for r in plans.page_links(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = {(i, tag): (n, told) for i, tag, n, told in con.execute(f"select page_id, tag, n, told from ({plans.PAGE_LINKS_SQL})").fetchall()}
    assert got == want and got[0, "h1"] == (1, "a&&amp")
