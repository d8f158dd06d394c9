"""Stories by leader clustering, and the brief chosen among them."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mergeable, models, story_title, title_tokens, vendors
from ..functions.urls import canonical
from .dedup import compatible, similarity
from .graph import components, written
from .tiles import tiled
from .titles import WORD_BITS, Title, ceiling, may_reach, near_enough, pairs_within, sets_within, word_bits

HOURS, LEAST = 6.0, 0.86
#: Similarities are rounded to four digits, so this one counts as LEAST.
ROUNDED = LEAST - 0.00005 - 1e-9
#: Of matching blocks at least, however many words two titles share: 0.6 of it and all of the other 0.4 make LEAST.
FLOOR = (ROUNDED - 0.4) / 0.6


def may_be_alike(a: Title, b: Title, tokens_a: set, tokens_b: set) -> bool:
    """False only if the similarity of two titles is below LEAST; far cheaper than the similarity."""
    if not tokens_a or not tokens_b or not may_reach(a, b, FLOOR):
        return False
    shared = len(tokens_a & tokens_b) / len(tokens_a | tokens_b)
    return ceiling(a, b) >= min(ROUNDED, (ROUNDED - 0.4 * shared) / 0.6) - 1e-9


class _Block:
    """The stories of one block so far, in the order in which they began."""

    def __init__(self) -> None:
        self.leaders: list = []
        self.recent: list = []
        self.by_url: dict[str, list] = {}

    def place(self, row) -> tuple[object, str, float]:
        """The leader that a row joins, why and how alike; itself if it begins a story."""
        found = self._by_url(row) or self._by_title(row)
        if found is None:
            found = (row, "new", 0.0)
            self.recent.append(row)
        if row.url:
            held = self.by_url.setdefault(row.url, [])
            if all(x is not found[0] for x in held):
                held.append(found[0])
        return found

    def _by_url(self, row):
        for leader in self.by_url.get(row.url, ()) if row.url else ():
            other_note = row.site and leader.site == row.site and row.title != leader.title
            if not other_note or similarity(row.title, leader.title, row.tokens, leader.tokens) >= LEAST:
                return leader, "canonical_url", 1.0
        return None

    def _by_title(self, row):
        if not row.mergeable:
            return None
        if row.at == row.at:  # a time is known
            self.recent = [x for x in self.recent if not row.at - x.at > HOURS * 3.6e9]
        for leader in self.recent:
            if not may_be_alike(row.form, leader.form, row.tokens, leader.tokens):
                continue
            if not (compatible(row.vendors, leader.vendors) and compatible(row.models, leader.models)):
                continue
            alike = similarity(row.title, leader.title, row.tokens, leader.tokens)
            if alike >= LEAST:
                return leader, "title_similarity", alike
        return None


def _alike_titles(titles: DataFrame) -> DataFrame:
    """(hub, other) of titles (hub, slice, title, tokens) that are as alike as a story asks for.

    Titles of one slice of six hours or of neighbouring ones are compared, and
    those without a time with all: blocks of one slice hold its titles, those
    of the slice after go past them, and a block of its own holds those
    without a time. Bounds drop no pair that is alike enough.
    """
    never = F.lit(-(1 << 62))
    own = F.coalesce("slice", never)

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["marks"] = [Title(t).marks() for t in frame["title"]]
            frame["words"] = [word_bits(t).to_bytes(WORD_BITS // 8, "little") for t in frame["tokens"]]
            yield frame

    titles = written(titles.select("hub", "slice", "title", "tokens").mapInPandas(mark, "hub long, slice long, title string, tokens array<string>, marks binary, words binary"))
    sent = ["hub", "title", "tokens", "marks", "words"]
    held = titles.select(own.alias("block"), *sent, F.lit(True).alias("own"))
    places = F.array_distinct(F.when(F.col("slice").isNull(), F.array(never)).otherwise(F.array(F.col("slice"), F.col("slice") - 1, never)))
    past = titles.select(F.explode(places).alias("block"), *sent, own.alias("o")).select("block", *sent, (F.col("block") == F.col("o")).alias("own"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        # Matching blocks depend on which title comes first: of another block than its own a title is the later one.
        for mine, either in ((left[left["own"]], True), (left[~left["own"]], False)):
            a, b = ([Title(t, m) for t, m in zip(f["title"], f["marks"])] for f in (mine, right))
            x, y = ([set(t) for t in f["tokens"]] for f in (mine, right))
            hubs, others = mine["hub"].tolist(), right["hub"].tolist()
            once = lambda pairs: ((i, j) for i, j in pairs if not either or hubs[i] > others[j])
            met = set(near_enough(a, b, once(pairs_within(a, b, ROUNDED, either)), ROUNDED))
            # Matching blocks may fall short only where nearly all words are shared.
            met |= {(i, j) for i, j in once(sets_within(x, y, ROUNDED, tuple([int.from_bytes(w, "little") for w in f["words"]] for f in (mine, right)))) if may_be_alike(a[i], b[j], x[i], y[j]) or either and may_be_alike(b[j], a[i], y[j], x[i])}
            for i, j in sorted(met):
                if similarity(a[i].text, b[j].text, x[i], y[j]) >= LEAST or either and similarity(b[j].text, a[i].text, y[j], x[i]) >= LEAST:
                    out.append((hubs[i], others[j]))
        return pd.DataFrame(out, columns=["hub", "other"], dtype="int64")

    return tiled(past, held, compare, "hub long, other long")


def _blocks(firsts: DataFrame) -> DataFrame:
    """firsts with a block: rows that may meet in one story, by URL or by alike titles within the hours, are in one.

    Equal titles of one slice of time are one node, so copies of a title cost
    nothing. Rows hang on their URL and on their title as on hubs, never on
    each other.
    """
    sliced = firsts.withColumn("slice", F.floor(F.col("at") / (HOURS * 3.6e9)))
    titled = sliced.where(F.size("tokens") > 0)
    titles = written(titled.groupBy("title", "slice").agg(F.first("tokens").alias("tokens"), F.min("node").alias("hub")))
    of_title = titled.join(titles.select(F.col("title").alias("t"), F.col("slice").alias("s"), "hub"), (F.col("title") == F.col("t")) & F.col("slice").eqNullSafe(F.col("s")))
    of_url = firsts.where("url <> ''").join(firsts.where("url <> ''").groupBy("url").agg(F.min("node").alias("hub")), "url")
    links = [df.select(F.col(a).alias("a"), F.col(b).alias("b")) for df, a, b in ((_alike_titles(titles), "hub", "other"), (of_title, "node", "hub"), (of_url, "node", "hub"))]
    blocks = components(links[0].union(links[1]).union(links[2])).withColumnRenamed("component", "block")
    return firsts.join(blocks, "node", "left").withColumn("block", F.coalesce("block", "node"))


def clustered(items: DataFrame) -> DataFrame:
    """(id, story_id, merged_into, reason, similarity) for each item (id, site_id, title, url, event_time).

    In the order of time (unknown first, then by id) an item joins a story
    that has its canonical URL, unless the story's first item is of the same
    site under a clearly different title; else the first story begun at most
    six hours before (or whenever, if either time is unknown) by an item with a
    similar title and no other vendors or models; else it begins a story.
    merged_into is the id of the story's first item, its own for that one
    (reason "new").

    Items alike in URL, site and title follow their first one, so only first
    ones are compared. These are cut into blocks that can't meet, and each
    block streams through a task in order, with only the stories' first items
    held. Titles are compared in tiles behind bounds that lose no pair.
    """
    url = canonical(F.coalesce("url", F.lit("")))
    title = story_title(F.coalesce("title", F.lit("")))
    rows = items.where("id is not null").select(F.col("id").cast("string").alias("id"), F.coalesce("site_id", F.lit("")).alias("site"), url.alias("url"), title.alias("title"), F.unix_micros("event_time").alias("at"))
    # Without a URL nothing is alike but the item itself.
    rows = written(rows.withColumn("own", F.when(F.col("url") == "", F.col("id")).otherwise("")))
    alike = ["url", "own", "site", "title"]
    firsts = rows.groupBy(*alike).agg(F.min(F.struct(F.coalesce("at", F.lit(-(1 << 62))), "id", "at")).alias("f")).select(*alike, "f.id", "f.at")
    firsts = firsts.withColumns({"mergeable": mergeable(F.col("title")), "tokens": title_tokens(F.col("title")), "node": F.monotonically_increasing_id()})
    firsts = _blocks(written(firsts))
    told = firsts.select("block", "id", "site", "url", "title", F.col("at").cast("double").alias("at"), "mergeable", "tokens", vendors(F.col("title")).alias("vendors"), models(F.col("title")).alias("models"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, block = None, None
        for frame in frames:
            for column in ("tokens", "vendors", "models"):
                frame[column] = frame[column].map(set)
            frame["form"] = frame["title"].map(Title)
            out = []
            for row in frame.itertuples():
                if row.block != key:
                    key, block = row.block, _Block()
                leader, reason, alike_ = block.place(row)
                out.append((row.id, leader.url, leader.title, leader.id, reason, alike_))
            yield pd.DataFrame(out, columns=["id", "leader_url", "leader_title", "merged_into", "reason", "similarity"])

    dealt = told.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("at"), "id")
    placed = dealt.mapInPandas(run, "id string, leader_url string, leader_title string, merged_into string, reason string, similarity double")
    named = placed.withColumn("story_id", story_id(F.col("leader_url"), F.col("leader_title"), F.col("merged_into"))).select("id", "story_id", "merged_into", "reason", "similarity")
    first = firsts.select(*alike, "id").join(named, "id").withColumnRenamed("id", "first_id")
    own = F.col("id") == F.col("first_id")
    return rows.join(first, alike).select(
        "id", "story_id", "merged_into", F.when(own, F.col("reason")).otherwise("canonical_url").alias("reason"), F.when(own, F.col("similarity")).otherwise(1.0).alias("similarity")
    )


def story_id(url: Column, title: Column, id_: Column) -> Column:
    basis = F.when((url != "") & (title != ""), F.concat_ws("\x1f", url, title)).otherwise(F.coalesce(F.nullif(url, F.lit("")), F.nullif(title, F.lit("")), id_))
    return F.concat(F.lit("story_"), F.left(F.sha1(basis), F.lit(12)))


def merge_log(placed: DataFrame) -> DataFrame:
    """(story_id, item_id, reason, similarity) of every item that joined a story."""
    return placed.where("reason <> 'new'").select("story_id", F.col("id").alias("item_id"), "reason", F.round("similarity", 4).alias("similarity"))


def _open_to(told: DataFrame, taken: list) -> DataFrame:
    """told without the taken stories and the rewrites of their titles; only titles that share two fifths of a taken one's words go to Python."""
    if not taken:
        return told
    told = told.where(~F.col("story_id").isin([x.story_id for x in taken]))
    shares = F.lit(False)
    for x in taken:
        own = F.array(*map(F.lit, x.tokens)) if x.tokens else F.array().cast("array<string>")
        shares = shares | (F.size(F.array_intersect("tokens", own)) >= F.lit(0.4) * F.size(F.array_union("tokens", own)))
    doubtful = F.col("mergeable") & shares

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[not any(_repeats(row, x) for x in taken) for row in frame.itertuples()]]

    return told.where(~doubtful).union(told.where(doubtful).mapInPandas(check, told.schema))


def _heads(told: DataFrame, per_source: dict[str, int], most: int, penalty: float) -> DataFrame:
    """The `most` best stories of each of the `most` sources whose best one counts most, as far as they count now.

    Ranks are cut in each task before the shuffle, so a hot source sends `most` rows a task.
    """
    worth = F.col("score")
    for source, n in per_source.items():
        worth = F.when(F.col("source") == source, F.col("score") - F.lit(penalty * n)).otherwise(worth)
    order = [F.desc("score"), "t", "story_id"]
    ranked = told.withColumn("worth", worth).withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("r") <= most)
    first = ranked.where("r = 1").orderBy(F.desc("worth"), *order).limit(most).select("source")
    return ranked.join(F.broadcast(first), "source")


def diverse(stories: DataFrame, most: int = 20, penalty: float = 0.03) -> DataFrame:
    """(story_id, place): the best stories (story_id, title, source, score), one at a time.

    A story's score counts less by `penalty` for each story already taken from
    its source; one whose title nearly repeats a taken one's is passed over.
    A round brings the heads of the sources that can win to the driver, at most
    `most` rows of `most` sources, and takes what they settle; rewrites of
    taken titles are dropped where the stories are before the next round. Each
    round takes one story at least, so there are `most` rounds at most, and one
    or two where few titles repeat.
    """
    title = story_title(F.coalesce("title", F.lit("")))
    told = stories.select("story_id", F.coalesce("title", F.lit("")).alias("t"), title.alias("title"), F.coalesce("source", F.lit("")).alias("source"), F.col("score").cast("double").alias("score"))
    told = written(told.select("*", title_tokens(F.col("title")).alias("tokens"), mergeable(F.col("title")).alias("mergeable"), vendors(F.col("title")).alias("vendors"), models(F.col("title")).alias("models")))
    taken, per_source = [], {}
    while len(taken) < most:
        wanted = most - len(taken)
        heads: dict[str, list] = {}
        for x in sorted(_heads(_open_to(told, taken), per_source, wanted, penalty).collect(), key=lambda x: x.r):
            heads.setdefault(x.source, []).append(x)
        if not heads:
            break
        place = lambda x: (-(x.score - penalty * per_source.get(x.source, 0)), -x.score, x.t, x.story_id)
        # Sources that were not brought may hold what comes after this.
        last = max(place(own[0]) for own in heads.values()) if len(heads) == wanted else None
        left, began, short = {k: list(v) for k, v in heads.items()}, len(taken), False
        while len(taken) < most and not short and any(left.values()):
            best = min((own[0] for own in left.values() if own), key=place)
            if last is not None and place(best) > last and len(taken) > began:
                break
            left[best.source].pop(0)
            if not any(_repeats(best, x) for x in taken):
                taken.append(best)
                per_source[best.source] = per_source.get(best.source, 0) + 1
            short = not left[best.source] and len(heads[best.source]) == wanted
    return stories.sparkSession.createDataFrame([(x.story_id, n + 1) for n, x in enumerate(taken)], "story_id string, place int")


def _repeats(a, b) -> bool:
    x, y = set(a.tokens), set(b.tokens)
    if not a.mergeable or not x or not y or len(x & y) < 0.4 * len(x | y):
        return False
    alike = similarity(a.title, b.title, x, y) >= LEAST
    return alike and compatible(set(a.vendors), set(b.vendors)) and compatible(set(a.models), set(b.models))
