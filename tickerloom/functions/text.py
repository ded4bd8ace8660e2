"""Text rules: codes, names, intents, searches, capital amounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.functions.scalar import col

# Stock code and name patterns, and the ordered keyword lists of the intent rules.
CODE_PATTERN = r"([0368]\d{5})"
WORD = r"[一-鿿\p{L}\p{N}_]{2,8}"
VERBS, NOUNS = ["分析", "查看", "看看", "研究", "查"], ["分析", "怎么样", "如何", "走势", "行情"]
NAME_AFTER_VERB = r"(?:分析|查看|看看|研究|查)[\s\p{Z}]*[：:\s\p{Z}]*(" + WORD + ")"
NAME_BEFORE_NOUN = "(" + WORD + r")[\s\p{Z}]*(?:分析|怎么样|如何|走势|行情)"
BARE_CODE = r"^\d{6}$"
PICK_WORDS = ["评分", "选股", "推荐", "打分", "技术面", "综合评分"]
ANALYSE_WORD = "分析"
NEWS_WORDS = ["新闻", "资讯", "快讯", "最新"]
SCREEN_WORDS = ["筛选", "题材", "概念", "板块"]
HELP_WORDS = ["帮助", "help"]

# Characters kept of a bot reply, of a log line, of an error message.
REPLY_CHARS, LOG_CHARS, ERROR_CHARS = 1800, 500, 200


def _any_word(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def trimmed(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def intent(text: str | Column) -> Column:
    """First matching rule on the first line: pick, info_query, screen, help, else chat."""
    line = F.substring(F.split_part(trimmed(text), F.lit("\n"), F.lit(1)), 1, 100)
    return (
        F.when(_any_word(line, PICK_WORDS), "pick")
        .when(F.rlike(trimmed(line), F.lit(BARE_CODE)) | F.contains(line, F.lit(ANALYSE_WORD)), "pick")
        .when(_any_word(line, NEWS_WORDS), "info_query")
        .when(_any_word(line, SCREEN_WORDS), "screen")
        .when(_any_word(line, HELP_WORDS), "help")
        .otherwise("chat")
    )


def stock_code(text: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(text), CODE_PATTERN, 1), F.lit(""))


def stock_name(text: str | Column) -> Column:
    """Name candidate: the first pattern that matches decides, all-digit names do not count."""
    def found(pattern, words):
        # A plain substring test rules out most texts far faster than the pattern does.
        return F.when(_any_word(col(text), words), F.nullif(F.regexp_extract(col(text), pattern, 1), F.lit("")))

    name = F.coalesce(found(NAME_AFTER_VERB, VERBS), found(NAME_BEFORE_NOUN, NOUNS))
    return F.when(~F.rlike(name, F.lit(r"^\p{N}+$")), name)


def like_search(c: str | Column, q: str) -> Column:
    """``LIKE '%q%'`` ignoring case; ``%`` and ``_`` inside ``q`` stay wildcards, a backslash is plain."""
    escaped = q.replace("\\", "\\\\")
    return col(c).ilike(f"%{escaped}%")


def literal_search(c: str | Column, q: str) -> Column:
    """Plain substring ignoring case; null does not match."""
    return F.coalesce(F.contains(F.lower(col(c)), F.lower(F.trim(F.lit(q)))), F.lit(False))


def without_mention(text: str | Column) -> Column:
    """Drop a leading @mention; if nothing is left, keep the trimmed original."""
    rest = trimmed(F.regexp_replace(col(text), r"^@\S+\s*", ""))
    return F.coalesce(F.nullif(rest, F.lit("")), trimmed(text))


def clipped(text: str | Column, n: int) -> Column:
    return F.substring(col(text), 1, n)


def cache_key(model: str | Column, system: str | Column, user: str | Column) -> Column:
    return F.sha2(F.concat_ws(":", col(model), col(system), col(user)), 256)


def chart_url(path: str | Column, root: str) -> Column:
    """Path below ``root``/charts as a relative URL; anything else is null."""
    folder = f"{root.rstrip('/')}/charts/"
    return F.when(
        F.startswith(col(path), F.lit(folder)),
        F.concat(F.lit("/charts/"), F.substring(col(path), len(folder) + 1, 1 << 30)),
    )


def date_in_file_name(name: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(name), r"execution_(.*)\.json$", 1), F.lit(""))


def capital_wan(text: str | Column) -> Column:
    """Registered capital text as a number in units of ten thousand (definition ours)."""
    amount = F.nullif(F.regexp_extract(F.regexp_replace(col(text), ",", ""), r"(\d+(?:\.\d+)?)", 1), F.lit(""))
    unit = F.when(F.contains(col(text), F.lit("亿")), 1e4).when(F.contains(col(text), F.lit("万")), 1.0).otherwise(1e-4)
    return amount.cast("double") * unit


def bearish_signal(signal: str | Column) -> Column:
    return F.contains(col(signal), F.lit("空头")) | F.contains(col(signal), F.lit("死叉"))
