"""Chat log: sessions, messages, instrument context, response reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.scalar import iso_time, still_valid, title_or_default
from tickerloom.functions.text import stock_code, stock_name
from tickerloom.operators.merge import delete_keys, upsert
from tickerloom.operators.newest import last_rows, newest_first, page
from tickerloom.operators.ordered import carry_forward
from tickerloom.plans.market import code_of_name, price_context

MESSAGE_ORDER = ["created_at_utc", "id"]
NEW_TITLE = "新对话"


def sessions_page(sessions: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    rows = page(sessions, newest_first("updated_at_utc", "id"), limit, offset)
    return rows.select("id", title_or_default("title", "id").alias("title"), "is_active",
                       iso_time("created_at_utc").alias("created_at"), iso_time("updated_at_utc").alias("updated_at"))


def message_view(messages: DataFrame) -> DataFrame:
    return messages.select("session_id", "id", "role", "content", "intent", "cost_usd", "elapsed_ms", iso_time("created_at_utc").alias("created_at"))


def messages_page(messages: DataFrame, session: int, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = messages.filter(F.col("session_id") == session)
    return message_view(page(rows, [F.col(c) for c in MESSAGE_ORDER], limit, offset))


def history_for_reply(messages: DataFrame, keep: int = 20) -> DataFrame:
    """Per session, the last ``keep`` messages before the newest one, without blank ones."""
    recent = last_rows(messages, ["session_id"], MESSAGE_ORDER, keep + 1, "_back")
    rows = recent.filter((F.col("_back") >= 2) & (F.coalesce(F.col("content"), F.lit("")) != ""))
    return rows.select("session_id", "id", "role", "content", (F.col("_back") - 1).alias("messages_back"))


def carried_codes(messages: DataFrame, *extra: Column) -> DataFrame:
    """Last code mentioned in the session up to each message, whatever the session's length.

    The code, and whatever ``extra`` asks for, is taken out of the text first, so the text itself never moves.
    """
    mentioned = messages.select("session_id", "created_at_utc", "id", stock_code("content").alias("own_code"), *extra)
    return carry_forward(mentioned, ["session_id"], MESSAGE_ORDER, "own_code", "carried_code", cheap=True)


def resolved_messages(messages: DataFrame, instruments: DataFrame) -> DataFrame:
    """User messages with their instrument: own code, else exact name in market a, else the carried code."""
    user = F.col("role") == "user"
    asked = carried_codes(messages, user.alias("by_user"), F.when(user, stock_name("content")).alias("name")).filter("by_user")
    rows = asked.join(code_of_name(instruments).withColumnRenamed("ts_code", "named_code"), "name", "left")
    source = (
        F.when(F.col("own_code").isNotNull(), "own").when(F.col("named_code").isNotNull(), "name")
        .when(F.col("carried_code").isNotNull(), "carried")
    )
    return rows.select("id", "session_id", F.coalesce("own_code", "named_code", "carried_code").alias("ts_code"), source.alias("code_source"))


def enriched_messages(messages: DataFrame, instruments: DataFrame, prices: DataFrame) -> DataFrame:
    """Resolved messages with the name and price context of their market-a instrument, null where there is none."""
    context = price_context(prices.filter(F.col("market") == "a")).drop("market")
    names = instruments.filter(F.col("market") == "a").select("ts_code", "name", "industry")
    return resolved_messages(messages, instruments).join(names.join(context, "ts_code", "left"), "ts_code", "left")


def touch_sessions(sessions: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Known sessions get a new time; a request without a usable id (null) becomes a new session.

    ``requests`` holds ``id`` (what was asked for, possibly null) and ``new_id``
    (the number a new session would get).
    """
    known = requests.join(sessions.select("id"), "id", "left_semi").select("id").distinct()
    touched = upsert(sessions, known.withColumn("updated_at_utc", now), ["id"], {"updated_at_utc": "c.updated_at_utc"}, {})
    unknown = requests.join(sessions.select("id"), "id", "left_anti")
    created = unknown.select(F.col("new_id").alias("id"), F.lit(NEW_TITLE).alias("title"), F.lit(True).alias("is_active"),
                             now.alias("created_at_utc"), now.alias("updated_at_utc"))
    return touched.unionByName(created)


def delete_sessions(sessions: DataFrame, messages: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the doomed sessions (``doomed``: column ``id``)."""
    owned = doomed.select(F.col("id").alias("session_id"))
    return delete_keys(sessions, doomed, ["id"]), delete_keys(messages, owned, ["session_id"])


def write_cache(cache: DataFrame, writes: DataFrame) -> DataFrame:
    """Newest response per key; the time to live stays as first written."""
    order = F.struct("created_at_utc", "request_id")
    newest = writes.groupBy("cache_key").agg(
        F.max_by("response_json", order).alias("response_json"), F.min_by("ttl_seconds", order).alias("ttl_seconds"), F.max("created_at_utc").alias("created_at_utc"))
    return upsert(cache, newest, ["cache_key"],
                  {c: f"c.{c}" for c in cache.columns if c not in ("cache_key", "ttl_seconds")}, {})


def reusable_responses(requests: DataFrame, writes: DataFrame) -> DataFrame:
    """Requests with the response that was stored when they were asked, if it was still valid.

    The stored response is that of the newest write up to then; the time to
    live is that of the key's first write.  Writes and requests of a key are
    scanned together in time, cut into even chunks, so a key may be asked for
    any number of times.
    """
    order = F.struct("created_at_utc", "request_id")
    first = writes.groupBy("cache_key").agg(F.min_by("ttl_seconds", order).alias("ttl_seconds"))
    # The write is carried by its number; its text joins at the end.
    held = F.struct(F.col("request_id").alias("write"), "created_at_utc")
    kind = writes.select(held.alias("held")).schema["held"].dataType.simpleString()
    timeline = writes.select("cache_key", F.col("created_at_utc").alias("at"), F.lit(0).alias("step"), "request_id", held.alias("held")).unionByName(
        requests.select("cache_key", F.col("asked_at").alias("at"), F.lit(1).alias("step"), "request_id", F.lit(None).cast(kind).alias("held")))
    seen = carry_forward(timeline, ["cache_key"], ["at", "step", "request_id"], "held", "stored", cheap=True).filter("step = 1 AND stored IS NOT NULL")
    rows = seen.join(first, "cache_key").filter(still_valid("stored.created_at_utc", "ttl_seconds", "at"))
    texts = writes.select("cache_key", F.col("request_id").alias("_write"), "response_json")
    return rows.select("request_id", "cache_key", F.col("stored.write").alias("_write")).join(texts, ["cache_key", "_write"]).drop("_write")
