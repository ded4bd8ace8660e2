"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest.

DataFrame operations only; the model is one array that a scalar subquery hands to every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS, SMALLEST, LARGEST = 4096, 3, 5

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# Labelled URLs the filter is trained on: to block, to allow.
BLOCKED = """
http://cheap-meds.example.com/en/1 https://www.pills-online.example.org/shop/2.html http://casino-royal.example.net/en/bonus?ref=x https://m.bets-today.example.com/de/9
https://link-farm.example.org/fr/10#top http://spam-mail.example.com/en/33 http://ad-track.example.net/click?id=3 https://www.ads-server.example.com/track/8 http://free-spins.example.org/en/5
https://win-cash.example.com/es/71 http://cheap-watches.example.net/en/12/ https://casino-bonus.example.org/en/88 http://pills-shop.example.com/fr/4.html https://free-casino.example.com/en/2
http://www.sports-bets.example.net/en/19 https://bets-win.example.org/de/3 http://spam-links.example.com/en/90 https://blog.cheap-loans.example.com/en/6 http://payday-loans.example.org/en/44
https://ads-click.example.com/en/7 http://track-ads.example.net/fr/15 https://content-farm.example.com/en/16 http://seo-farm.example.org/en/17?page=2 http://www.replica-bags.example.com/en/18
https://poker-win.example.net/en/20 http://slots-free.example.com/en/21 https://viagra-cheap.example.org/en/22 http://adult-cams.example.com/en/23 http://porn-free.example.net/en/24
https://win-prizes.example.com/en/25#top http://lottery-win.example.org/en/26 https://m.pills-cheap.example.com/en/27 http://click-bait.example.net/en/28 https://free-bets-now.example.com/en/29
""".split()
ALLOWED = """
https://library.example.org/en/1 http://www.university.example.com/de/2.html https://blog.garden.example.net/en/3?page=2 http://m.recipes.example.com/fr/4 https://history.example.org/en/5#top
http://museum.example.com/es/6/ https://www.weather.example.org/en/7 http://daily-news.example.com/en/8?utm_source=feed https://blog.travel.example.com/en/9 http://theory.example.net/en/10
https://m.letters.example.org/en/11 http://music.example.com/en/12.html https://thorn.example.com/en/13 http://ration.example.org/en/14 https://www.northern.example.net/fr/15
http://heather.example.com/de/16 https://blog.station.example.org/en/17 http://m.garland.example.com/en/18 https://entire.example.net/en/19?page=2&ref=x http://shadow.example.com/es/20
https://www.thinker.example.org/en/21 http://leather.example.com/en/22#top https://nation.example.net/en/23 http://blog.oneness.example.com/en/24 https://ether.example.org/fr/25
http://www.thesis.example.com/en/26/ https://m.reading.example.net/en/27 http://anthem.example.org/en/28 https://blog.forest.example.com/en/29 http://another.example.com/en/30.html
https://school.example.org/en/31 http://www.village.example.com/en/32 https://science.example.net/de/33 http://blog.kitchen.example.org/en/34 https://river.example.com/en/35
http://mathematics.example.com/en/36 https://www.thread.example.net/en/37 http://handle.example.org/en/38 https://m.tender.example.com/en/39 http://blog.listen.example.net/en/40
""".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for a null or an URL without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls.  A rule fits its host and subdomains where the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _placed(text: Column, n: int, mark: str, dimensions: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i + 1, F.lit(n))), F.lit(dimensions)).cast("int")


def grams(host: Column, path: Column, dimensions: int = DIMENSIONS) -> Column:
    """Distinct places (from 0) of the character n-grams of host and path, marked by which of both they come from."""
    parts = []
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(path, F.lit("$")))):
        for n in range(SMALLEST, LARGEST + 1):
            last = F.length(text) - n
            starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, _placed(text, n, mark, dimensions)))
    return F.array_distinct(F.concat(*parts))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 to block, 0 to allow."""
    rows = ", ".join(f"('{u}', {y}D)" for y, urls in ((1, BLOCKED), (0, ALLOWED)) for u in urls)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, rounds: int = 200, rate: float = 2.0, ridge: float = 0.002, most_rows: int = 2_000) -> DataFrame:
    """One row ``weights``: an array with a weight for each place and the bias last.

    Gradient descent over the whole label table, at most ``most_rows`` rows
    of it, chosen by a hash, folded in one expression: each round finds all rows' errors and
    then each place's step from the rows that have the place.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter("label IN (0, 1)").select("url", "label").orderBy(F.xxhash64("url", "label"), "url", "label").limit(most_rows)
    rows = rows.select(F.struct(F.col("label"), F.array_append(grams(host, path, dimensions), F.lit(dimensions)).alias("places")).alias("x"))
    data = rows.agg(F.array_sort(F.collect_list("x")).alias("data")).select("data", F.size("data").alias("n"))
    # For each place the rows that have it.
    pairs = data.select(F.posexplode("data").alias("row", "x")).select("row", F.explode("x.places").alias("place"))
    having = pairs.groupBy("place").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    having = having.agg(F.map_from_entries(F.collect_list(F.struct("place", "rows"))).alias("having"))
    filled = data.join(F.broadcast(having)).select("data", "n", F.transform(F.sequence(F.lit(0), F.lit(dimensions)), lambda k: F.coalesce(F.col("having")[k], F.array().cast("array<int>"))).alias("having"))

    def one(x, w):
        total = F.aggregate(x["places"], F.lit(0.0), lambda a, k: a + F.get(w, k))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total)) - x["label"]

    def step(w, _):
        errors = F.array(F.transform(F.col("data"), lambda x: one(x, w)))
        moved = F.transform(errors, lambda e: F.zip_with(
            w, F.col("having"), lambda v, rows: v - F.lit(rate) * (F.aggregate(rows, F.lit(0.0), lambda a, i: a + F.get(e, i)) / F.col("n") + F.lit(ridge) * v)))
        return F.get(moved, F.lit(0))

    start = F.array_repeat(F.lit(0.0), dimensions + 1)
    return filled.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("weights"))


def filter_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, key: str = "page_id", url: str = "url", limit: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages``.

    The longest fitting rule decides; without one the model does (block where
    the score is at least ``limit``).  A null or malformed URL has an empty
    host and path, fits no rule and is scored like any other; repeated rows
    are judged each; an empty table gives no rows; other columns are not
    looked at.  ``rules`` is a short list, tried longest first.
    """
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("_url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    model = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), says.alias("_says"), model.scalar().alias("_w"))
    total = F.aggregate(grams(F.col("host"), F.col("path")), F.get("_w", F.lit(DIMENSIONS)), lambda a, k: a + F.get("_w", k))
    rows = rows.select("page_id", "host", "path", "rule", "_says", (F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).alias("score"))
    verdict = F.coalesce("_says", F.when(F.col("score") >= limit, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
