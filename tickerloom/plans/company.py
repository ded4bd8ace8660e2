"""Company profile and risk enrichment.

Only a written design exists for this part; where it leaves a threshold or a
matching rule open, the one used here is our definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.text import capital_wan
from tickerloom.operators.merge import newest_wins
from tickerloom.operators.newest import newest_row
from tickerloom.operators.ordered import percent_ranks
from tickerloom.session import pin

KEY = ["ts_code", "market"]

# The risk rules (type, action, look-back in days, score factor).
RISK_RULES = [("dishonest", "EXCLUDE", 365, None), ("execution", "SCORE_MULTIPLY", None, 0.5), ("abnormal", "EXCLUDE", 180, None)]
LEGAL_FORMS = ["集团股份有限公司", "股份有限公司", "有限公司"]
# Of names of companies: characters up to which their edits are spelled out, edits that are, and edits looked for before all companies are compared.
SHORT, SPELLED, ROUNDS = 16, 2, (0, 1, 2, 4)
BLOCK = 2048  # names, and companies, of one comparison
OPEN = "\0"  # stands for any character
STATE_WORDS, INSTITUTION_WORDS = "国资|国有|财政", "社保|基金|保险|信托"


def upsert_profiles(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """One profile per instrument, the newest version wins."""
    return newest_wins(stored, arriving, KEY, ["synced_on"])


def current_profiles(feed: DataFrame) -> DataFrame:
    return newest_row(feed, KEY, ["synced_on"])


def matching_rules(events: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Events with each rule of their type; a rule without look-back has no date limit."""
    hits = events.join(rules, "risk_type")
    recent = F.col("lookback_days").isNull() | (F.col("event_date") >= F.date_sub(as_of, F.col("lookback_days")))
    return hits.filter(recent)


def exclude_risky(rows: DataFrame, events: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Rows of instruments no excluding rule applies to."""
    out = matching_rules(events, rules.filter("action = 'EXCLUDE'"), as_of).select(*KEY).distinct()
    return rows.join(out, KEY, "left_anti")


def score_multipliers(events: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Product of the factors of the rules that apply to an instrument, each rule once."""
    hits = matching_rules(events, rules.filter("action = 'SCORE_MULTIPLY'"), as_of)
    once = hits.groupBy(*KEY, "risk_type").agg(F.max("factor").alias("factor"))
    return once.groupBy(*KEY).agg(F.product("factor").alias("multiplier"))


def risk_adjusted(entries: DataFrame, multipliers: DataFrame, market: str = "a") -> DataFrame:
    """Final scores times the multiplier of their instrument; entries are all of one market."""
    by_code = multipliers.filter(F.col("market") == market).groupBy("ts_code").agg(F.min("multiplier").alias("multiplier"))
    joined = entries.join(by_code, "ts_code", "left")
    return joined.withColumn("adjusted_score", F.col("final_composite_score") * F.coalesce("multiplier", F.lit(1.0))).drop("multiplier")


def code_mismatches(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("code_mismatch", ~F.col("stock_number").eqNullSafe(F.col("ts_code")))


def _form(name: str) -> Column:
    """The legal form that a name ends in, or nothing."""
    return F.regexp_extract(name, "(" + "|".join(LEGAL_FORMS) + ")$", 1)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to all cores: few bytes, of which much work comes, would else be left to one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def _met(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged.

    Spark takes exploded rows for as small as what they were made of, and would send
    all of them to the driver for a broadcast.
    """
    return df.hint("merge")


def _rest(place) -> Column:
    return F.substring("name", place + 1, F.greatest(F.length("name"), F.lit(1)))


def _parts(pairs: DataFrame, e: int) -> DataFrame:
    """(name, kind, part, cost, left): ways to cut a name into the part held against companies without their form and a rest held against the form.

    ``cost`` is the distance of rest and form, ``left`` what remains for the part of ``least`` + ``e`` edits.
    """
    cut = _spread(pairs, "name").withColumn("p", F.explode(F.sequence(F.lit(0), F.length("name")))).filter("form <> '' OR p = length(name)")
    cut = cut.withColumn("cost", F.levenshtein(_rest(F.col("p")), "form")).withColumn("left", F.col("least") + e - F.col("cost"))
    return cut.filter("left >= 0").select("name", "kind", F.substring("name", F.lit(1), F.col("p")).alias("part"), "cost", "left")


def _spellings(text: Column, most: int) -> Column:
    """Every (key, any, gone) that is ``text`` with up to ``most`` characters open (``any`` of them) or left out (``gone``)."""

    def edited(s: Column, p: Column) -> Column:
        before, after = F.substring(s["key"], F.lit(1), p - 1), F.substring(s["key"], p + 1, F.length(s["key"]))
        opened = F.struct(F.concat(before, F.lit(OPEN), after).alias("key"), (s["any"] + 1).alias("any"), s["gone"].alias("gone"), (p + 1).alias("at"))
        return F.array(opened, F.struct(F.concat(before, after).alias("key"), s["any"].alias("any"), (s["gone"] + 1).alias("gone"), p.alias("at")))

    def further(s: Column) -> Column:
        # Places go up, so that a pair of edits comes once.
        places = F.when(s["at"] <= F.length(s["key"]), F.sequence(s["at"], F.length(s["key"]))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(places, lambda p: edited(s, p)))

    last = out = F.array(F.struct(text.alias("key"), F.lit(0).alias("any"), F.lit(0).alias("gone"), F.lit(1).alias("at")))
    for _ in range(most):
        last = F.flatten(F.transform(last, further))
        out = F.concat(out, last)
    return out


def _by_spelling(parts: DataFrame, listed: DataFrame, e: int) -> DataFrame:
    """(name, near): the nearest company within ``left`` edits of a part, where there is one.

    Two texts are within d edits if and only if they become equal by opening
    the same number of characters in both and leaving some out of either, d in
    all.  So one company per spelling is enough, and the rows grow with names
    and companies only, whatever they have in common.
    """
    spelt = _spread(listed, "full_name").select("kind", "full_name", F.explode(_spellings(F.col("base"), e)).alias("s"))
    best = spelt.groupBy("kind", "s.key", "s.any").agg(F.min(F.struct("s.gone", "full_name")).alias("best"))
    ways = _spellings(F.col("part"), 0)
    for d in range(1, e + 1):
        ways = F.when(F.col("left") >= d, _spellings(F.col("part"), d)).otherwise(ways)
    asked = parts.withColumn("s", F.explode(ways)).select("name", "kind", "s.key", "s.any", (F.col("cost") + F.col("s.any") + F.col("s.gone")).alias("cost"))
    met = asked.join(_met(best), ["kind", "key", "any"])
    return met.groupBy("name").agg(F.min(F.struct((F.col("cost") + F.col("best.gone")).alias("distance"), "best.full_name")).alias("near"))


def _segments(listed: DataFrame, d: int) -> DataFrame:
    """(key, full_name): every company without its form cut into ``d + 1`` even segments, each with its kind, its number and the length of all; it is longer than ``d``."""
    size, parts = F.length("base"), d + 1
    short = F.floor(size / parts)
    # The last ``size mod parts`` segments have one character more.
    longer = size % parts
    first = F.col("i") * short + F.greatest(F.lit(0), F.col("i") - (parts - longer))
    width = short + (F.col("i") >= parts - longer).cast("int")
    cut = listed.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(d))))
    return cut.select(F.concat_ws("|", "kind", size, "i", F.substring("base", first.cast("int") + 1, width.cast("int"))).alias("key"), "full_name")


def _lookups(parts: DataFrame, sizes: DataFrame, d: int) -> DataFrame:
    """(name, kind, key): the segments that a company within ``d`` edits has in common with a part, where it can have them."""
    asked = parts.select("name", "kind", "part", F.length("part").alias("m"))
    spans = asked.withColumn("size", F.explode(F.sequence(F.greatest(F.lit(d + 1), F.col("m") - d), F.greatest(F.lit(d + 1), F.col("m") + d))))
    spans = spans.join(sizes, ["kind", "size"], "left_semi")
    size, parts = F.col("size"), d + 1
    short, longer = F.floor(size / parts), size % parts
    placed = spans.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(d))))
    first = (F.col("i") * short + F.greatest(F.lit(0), F.col("i") - (parts - longer))).cast("int")
    width = (short + (F.col("i") >= parts - longer).cast("int")).cast("int")
    # d edits move a segment by d places at most.
    placed = placed.withColumns({"first": first, "width": width}).withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("first") - d), F.greatest(F.lit(0), F.col("first") + d))))
    inside = placed.filter(F.col("at") + F.col("width") <= F.col("m"))
    return inside.select("name", "kind", F.concat_ws("|", "kind", "size", "i", F.substring("part", F.col("at") + 1, F.col("width"))).alias("key")).distinct()


def _nearer(pairs: DataFrame) -> DataFrame:
    near = F.min(F.struct(F.levenshtein("name", "full_name").alias("distance"), "full_name"))
    return pairs.groupBy("name").agg(near.alias("near"))


def _in_blocks(pairs: DataFrame, listed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(name, near): the best of all companies of a pair's kind, where it beats what the name has; no task holds more than a block of either."""
    blocks = lambda df, name: df.groupBy("kind").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    both = blocks(pairs, "_names").join(blocks(listed, "_companies"), "kind")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = pairs.join(F.broadcast(both), "kind").select("kind", "name", "near", deal("name", "_names").alias("_a"), each("_companies").alias("_b"))
    right = listed.join(F.broadcast(both), "kind").select("kind", "full_name", deal("full_name", "_companies").alias("_b"), each("_names").alias("_a"))
    # The distance is worked out only as far as it can be the best.
    meeting = ["kind", "_a", "_b"]
    met = _spread(left, *meeting).join(_met(_spread(right, *meeting)), meeting).withColumn("distance", F.expr("levenshtein(name, full_name, near.distance)"))
    better = met.filter((F.col("distance") >= 0) & (F.struct("distance", "full_name") < F.col("near")))
    return better.groupBy("name").agg(F.min(F.struct("distance", "full_name")).alias("near"))


def _by_segments(pairs: DataFrame, listed: DataFrame, e: int, share: int = 16) -> tuple[DataFrame, DataFrame]:
    """(name, near): the nearest company that shares a segment; and the pairs that share so many that all companies are to be compared instead."""
    parts = _parts(pairs, e)
    keys = pin(_lookups(parts, listed.select("kind", F.length("base").alias("size")).distinct(), e))
    segments = _segments(listed, e)
    met = keys.join(_met(segments.groupBy("key").agg(F.count("*").alias("n"))), "key").groupBy("name", "kind").agg(F.sum("n").alias("n"))
    all_ = listed.groupBy("kind").agg(F.count("*").alias("all"))
    crowded = pin(met.join(F.broadcast(all_), "kind").filter(F.col("n") * share >= F.col("all")).select("name", "kind"))
    found = keys.join(_met(crowded), ["name", "kind"], "left_anti").join(_met(segments), "key").select("name", "full_name").distinct()
    return _nearer(found), pairs.join(_met(crowded), ["name", "kind"], "left_semi")


def nearest_names(names: DataFrame, listed: DataFrame) -> DataFrame:
    """(name, near): for each name the company at the smallest edit distance, the first in order among equals.

    A distance is the least sum, over all cuts of the name in two, of the first
    part's distance to the company without its legal form and the rest's to
    that form.  The forms are few, so the second term is known beforehand, and
    its minimum bounds the distance to all companies of a form.  The edits
    allowed beyond that are raised round by round; a name is through with a
    form as soon as its best company is within them.  Companies of up to
    ``SHORT`` characters are found by their spellings, longer ones by segments:
    one within d edits keeps one of its d + 1 segments, at most d places away.
    What stays open is compared with all companies of the form, in blocks.
    """
    base = F.substring("full_name", F.lit(1), F.length("full_name") - F.length("form"))
    listed = listed.select("full_name").distinct().withColumn("form", _form("full_name")).withColumn("base", base)
    # What holds the sign of an open character cannot be spelled with it.
    way = F.when(F.contains("base", F.lit(OPEN)), "?").when(F.length("base") > SHORT, "+").otherwise("")
    listed = pin(listed.withColumn("kind", F.concat("form", way)))
    # Kinds are at most three times the forms, and there is one company for each length, so both are bounded.
    kinds = [F.struct(F.lit(k.kind).alias("kind"), F.lit(k.form).alias("form")) for k in listed.select("kind", "form").distinct().orderBy("kind").collect()]
    firsts = [F.lit(r["full_name"]) for r in listed.groupBy(F.length("full_name")).agg(F.min("full_name").alias("full_name")).collect()]
    if not firsts:
        return names.select("name", F.lit(None).cast("struct<distance:int,full_name:string>").alias("near")).distinct()
    start = F.array_min(F.array(*[F.struct(F.levenshtein("name", c).alias("distance"), c.alias("full_name")) for c in firsts]))
    best = pin(names.select("name").distinct().withColumn("near", start))
    least = F.when(F.col("form") == "", 0).otherwise(F.array_min(F.transform(F.sequence(F.lit(0), F.length("name")), lambda p: F.levenshtein(_rest(p), "form"))))
    pairs = _spread(best, "name").select("name", "near", F.explode(F.array(*kinds)).alias("k")).select("name", "near", "k.*").withColumn("least", least)
    open_ = pin(pairs.filter("near.distance >= least").drop("near"))
    is_short, is_long = F.col("kind") == F.col("form"), F.endswith("kind", F.lit("+"))
    for e in ROUNDS:
        short, long_ = open_.filter(is_short), open_.filter(is_long)
        through = open_.filter(~is_short & ~is_long)
        if e <= SPELLED:
            found = _by_spelling(_parts(short, e), listed.filter(is_short), e)
        else:
            found, through = best.limit(0), through.union(short)
        if not long_.isEmpty():
            some, crowded = _by_segments(long_, listed.filter(is_long), e)
            found, through = found.union(some), through.union(crowded)
        if e == ROUNDS[-1]:
            through = open_
        found = found.union(_in_blocks(through.join(_met(best), "name"), listed))
        more = found.groupBy("name").agg(F.min("near").alias("more"))
        best = pin(best.join(_met(more), "name", "left").select("name", F.least("near", "more").alias("near")))
        rest = open_.join(_met(through.select("name", "kind")), ["name", "kind"], "left_anti").join(_met(best), "name")
        open_ = pin(rest.filter(F.col("near.distance") > F.col("least") + e).drop("near"))
        if open_.isEmpty():
            break
    return best


def match_names(names: DataFrame, companies: DataFrame) -> DataFrame:
    """Full company name for each short name: the shortest one that starts with it, else the nearest by edit distance.

    A short name that is a prefix of a full name has an edit distance equal to
    the surplus length, so the best candidate per prefix is known before the
    join: prefixes are reduced to one candidate each and matched by equality.
    Other names get the nearest of all companies (``nearest_names``), null only
    if there is none at all.  ``exact`` marks names equal to the full name
    without its legal form.
    """
    listed = companies.select("full_name").filter("full_name IS NOT NULL").distinct()
    prefixes = listed.select("full_name", F.explode(F.sequence(F.lit(1), F.greatest(F.length("full_name"), F.lit(1)))).alias("n")).select(
        F.substring("full_name", F.lit(1), F.col("n")).alias("name"), F.struct(F.length("full_name").alias("size"), "full_name").alias("candidate")
    )
    best = prefixes.groupBy("name").agg(F.min("candidate").alias("best"))
    wanted = pin(names.select("name").filter("name IS NOT NULL").distinct().join(_met(best), "name", "left").select("name", F.col("best.full_name").alias("by_prefix")))
    nearest = nearest_names(wanted.filter("by_prefix IS NULL"), listed)
    found = wanted.join(_met(nearest), "name", "left").select("name", F.coalesce("by_prefix", "near.full_name").alias("full_name"))
    bare = F.regexp_replace("full_name", "(" + "|".join(LEGAL_FORMS) + ")$", "")
    return names.join(_met(found), "name", "left").select(
        *names.columns, "full_name", F.levenshtein("name", "full_name").cast("bigint").alias("distance"), F.coalesce(bare == F.col("name"), F.lit(False)).alias("exact"),
    )


def match_rate(matched: DataFrame) -> DataFrame:
    """How many names were matched for certain, that is by a full name that starts with them."""
    sure = F.count_if(F.coalesce(F.startswith("full_name", "name"), F.lit(False)))
    return matched.agg(F.count("*").alias("names"), sure.alias("matched"), F.round(sure * 100.0 / F.count("*"), 1).alias("match_pct"))


def controllers(holders: DataFrame, controlling_pct: float = 50.0) -> DataFrame:
    """Largest holder per instrument and sync date; controlling from ``controlling_pct`` on."""
    largest = F.max(F.struct("stock_percent", "shareholder_name"))
    rows = holders.groupBy(*KEY, "synced_on").agg(largest.alias("top"))
    share = F.col("top.stock_percent")
    return rows.select(*KEY, "synced_on", F.col("top.shareholder_name").alias("holder"), share.alias("stock_percent"), (share >= controlling_pct).alias("is_controlling"))


def controller_changes(controlling: DataFrame) -> DataFrame:
    """Sync dates on which the largest holder changed; one row per instrument and date goes in."""
    before = F.lag("holder").over(Window.partitionBy(*KEY).orderBy("synced_on"))
    moved = controlling.withColumn("previous_holder", before)
    return moved.filter(F.col("previous_holder").isNotNull() & (F.col("holder") != F.col("previous_holder"))).select(*KEY, "synced_on", "previous_holder", "holder")


def unmapped(instruments: DataFrame, profiles: DataFrame) -> DataFrame:
    """Instruments without a company key yet."""
    return instruments.join(profiles.filter(F.col("key_no").isNotNull()), KEY, "left_anti")


def risk_alerts(events: DataFrame) -> DataFrame:
    """Risk events in the shape of news alerts."""
    return events.select("id", "title", F.col("title").alias("description"), F.lit("company_risk").alias("source_name"), F.lit(None).cast("string").alias("article_url"), F.col("seen_at_utc").alias("published_at_utc"))


def with_capital_number(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("registered_capital_num", capital_wan("registered_capital"))


def scope_match(members: DataFrame, scopes: DataFrame) -> DataFrame:
    """Share of an instrument's concepts that its business scope mentions."""
    named = members.filter(F.col("concept_name") != "")
    found = F.contains(F.col("business_scope"), F.col("concept_name"))
    return named.join(scopes, KEY).groupBy(*KEY).agg(
        F.count("*").alias("concepts"), F.count_if(found).alias("confirmed"), F.round(F.avg(found.cast("double")), 6).alias("match_ratio")
    )


def patent_ranks(instruments: DataFrame, patents: DataFrame) -> DataFrame:
    """Patent count per instrument as a percent rank over all of them."""
    counts = patents.groupBy(*KEY).agg(F.count("*").alias("patents"))
    rows = instruments.select(*KEY).join(counts, KEY, "left").withColumn("patents", F.coalesce("patents", F.lit(0).cast("bigint")))
    return percent_ranks(rows, {"patents": "patent_rank"})


def holder_flags(holders: DataFrame) -> DataFrame:
    """Whether an instrument has a state or an institutional holder, by words in the name."""
    name = F.col("shareholder_name")
    return holders.groupBy(*KEY).agg(
        F.bool_or(F.rlike(name, F.lit(STATE_WORDS))).alias("has_state_holder"), F.bool_or(F.rlike(name, F.lit(INSTITUTION_WORDS))).alias("has_institution")
    )
