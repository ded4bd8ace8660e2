"""Quality rules judged per text and, shrunk towards the mean of all hosts, per host."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.bytetext import Texts, Words, chunks, counts, hash_runs, sums, windows
from tickerloom.session import pin

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# A text breaks the rule where its condition holds; "short" and "repeats" are the base rules.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "3 * n_dup_lines > n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}


def _repeated(keys: np.ndarray, owner: np.ndarray, every: bool) -> np.ndarray:
    """Flags keys that occur twice or more under one owner: every such row, or all but the first."""
    order = np.lexsort((keys, owner))  # stable, so equal ones stay in text order
    k, o = keys[order], owner[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    if every:
        same[:-1] |= same[1:]
    out = np.zeros(len(k), bool)
    out[order] = same
    return out


def text_counts(texts: Texts) -> dict[str, np.ndarray]:
    """The five counts of each text; see ``COUNTS``."""
    data, at = texts.data, texts.at
    words = Words(texts)
    covered = np.zeros(len(words) + 3, bool)
    keys, owner, index = windows(words, 3)
    again = index[_repeated(keys, owner, every=True)]
    for k in range(3):
        covered[again + k] = True
    bounds = np.append(words.first, len(words))
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[words.start] += 1
    in_word[words.end] -= 1
    inside = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool) if len(data) else np.zeros(0, bool)
    # A line starts at a text's start and after each line feed.
    starts = np.unique(np.concatenate((at[:-1][at[1:] > at[:-1]], np.flatnonzero(data == 10) + 1)))
    starts = starts[starts < len(data)]
    breaks = data == 10
    line_of = np.searchsorted(at, starts, side="right") - 1
    filled = counts(words.start, np.append(starts, len(data))) > 0
    lines = hash_runs(data, starts, breaks)[filled] if len(starts) else np.zeros(0, np.uint64)
    twice = _repeated(lines, line_of[filled], every=False)
    return {
        "n_words": words.per_text.astype(np.int64),
        "word_chars": sums(inside & ((data & 0xC0) != 0x80), at),
        "n_symbols": sums(SYMBOLS[data], at),
        "n_dup_lines": np.bincount(line_of[filled][twice], minlength=texts.n).astype(np.int64),
        "n_repeat_words": sums(covered[: len(words)], bounds),
    }


def count_texts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the five counts of every whole text; a null text counts as empty.

    Words are runs of characters other than space and tab to carriage return.
    ``n_dup_lines`` counts lines that hold a word and equal an earlier line;
    ``n_repeat_words`` counts words inside 3-word runs that the text has twice.
    """
    source = docs.select(*keep, F.col(text).cast("string").alias("_body"))
    schema = source.select(*keep, *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "_body"):
                found = text_counts(Texts(part.column("_body")))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(found[c]) for c in COUNTS], names=[*keep, *COUNTS]
                )

    return source.mapInArrow(run, schema)


def host_verdicts(counted: DataFrame, host: str = "host", limit: float = 0.5) -> DataFrame:
    """Per host: texts, shrunk failure rate of each rule, and ``host_kept``.

    Each rule has a beta prior fitted by the moments of a beta-binomial over
    all hosts, weighted by texts: the spread of their rates less what chance
    alone makes of it, so small hosts count as little as they tell.  Where
    hosts are too few or too small to tell a spread, the prior weighs one text,
    and where they differ no more than by chance, 1000.  A host goes where the
    shrunk rate of any rule is above ``limit``.  Null is a host like any
    other.  Only one row per host moves.
    """
    flags = [F.sum(F.expr(f"CAST({c} AS BIGINT)")).alias(f"_f_{r}") for r, c in RULES.items()]
    hosts = pin(counted.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("n_texts"), *flags))
    texts = F.col("n_texts").cast("double")
    moments = [F.sum(texts).alias("_texts"), F.sum(texts * texts).alias("_squares"), F.count("*").cast("double").alias("_hosts")]
    for r in RULES:
        failed = F.col(f"_f_{r}").cast("double")
        moments += [F.sum(failed).alias(f"_b_{r}"), F.sum(failed * failed / texts).alias(f"_r_{r}")]
    # The prior is one row whatever the input.
    prior = hosts.agg(*moments).select(F.struct("*").alias("p"))
    joined = hosts.withColumn("_p", prior.scalar())
    out = ["_host", "n_texts"]
    for r in RULES:
        total, hosts_, b = F.col("_p._texts"), F.col("_p._hosts"), F.col(f"_p._b_{r}")
        m = b / total
        chance = m * (1 - m)
        room = total - F.col("_p._squares") / total - (hosts_ - 1)
        # How alike texts of one host are beyond chance; the prior's strength in texts follows from it.
        alike = (F.col(f"_p._r_{r}") - b * b / total - chance * (hosts_ - 1)) / (chance * room)
        strength = F.when(chance * room > 0, F.when(alike > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), 1 / alike - 1))).otherwise(F.lit(1000.0))).otherwise(F.lit(1.0))
        out.append(((F.col(f"_f_{r}") + strength * m) / (F.col("n_texts") + strength)).alias(f"rate_{r}"))
    rates = joined.select(*out)
    bad = F.lit(False)
    for r in RULES:
        bad = bad | (F.col(f"rate_{r}") > limit)
    return rates.withColumn("host_kept", ~bad)


def judge(docs: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", limit: float = 0.5) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every text.

    ``kept`` is false where the text breaks a base rule or its host's shrunk
    failure rate of any rule is above ``limit``.  Null or empty texts have no
    words and so fail the base rule; repeated rows are judged each; an empty
    table gives no rows; other columns of ``docs`` are not looked at.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.col(host).cast("string").alias("_src"), F.col(text).alias("text"))
    counted = pin(count_texts(source, ["doc_id", "_src"]))
    hosts = host_verdicts(counted, "_src", limit)
    failed = F.expr(f"({RULES['short']}) OR ({RULES['repeats']})")
    return (
        counted.join(hosts.select("_host", "host_kept"), F.col("_src").eqNullSafe(F.col("_host")), "left")
        .select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & F.coalesce("host_kept", F.lit(True))).alias("kept"))
    )
