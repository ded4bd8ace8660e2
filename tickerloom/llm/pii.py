"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments of a few tokens around digits, at
signs and the like; dynamic programming over segments of bounded length
chooses boundaries and types together.  It is trained here, on snippets made
by a seeded generator, by gradient ascent on their conditional likelihood.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.bytetext import Texts, chunks, sums

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "iban")
ALL = KINDS + ADDED

# ---------------------------------------------------------------- fixed patterns
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, which the look-behind says to keep long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Check digit of a card number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (2 * d - 9 if d > 4 else 2 * d) if k % 2 else d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Matches from left to right; each at sign takes the local characters before it that no earlier match has."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        left = text[done:at]
        start = done + len(left.rstrip(LOCAL))
        right = DOMAIN.match(text, at + 1) if start < at else None
        # What lies before this sign cannot be part of a later match's local part, which holds no sign.
        done = right.end() if right else at + 1
        if right:
            out.append((start, done))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found = {k: [] for k in KINDS}
    found["email"] = emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(map(_octet, m.group().split("."))):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                found["phone"].append(m.span())
    return found


# ---------------------------------------------------------------- the field
# A run of such characters is one key: it is a candidate whole, whatever its length, and no part of it is one.
RUN = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_+/-]*={0,2}")
RUN_MARKS = "+/-=_"
LEAST_RUN = 20
# Tokens: runs of digits, runs of letters, single other characters; long runs are cut so that every token is short.
TOKEN = re.compile(r"[0-9]{1,64}|[^\W\d_]{1,64}|\s|.", re.S)
LONGEST = 128
# No shape holds another character, another space than a single blank, or, unless it is spelt out with [at], both a blank and a letter other than A to Z.
FOREIGN = re.compile(r"[^\w.%+\-()\[\]@ ]")
SPELT = re.compile(r"[\[(]at[\])]", re.I | re.A)
MORE = re.compile(r" ?[\[(]dot[\])] ?[A-Za-z0-9-]", re.I)
CAPITALS = re.compile(r"[A-Z]+\Z")
# What a span needs: a digit or an at sign, one of these spelt out, or a word before it that names a secret.
NAMED = r"token|secret|passwor[dt]|api[_ -]?key|key|bearer"
SPELT_OUT = r"[\[(](?:at|dot)[\])]"
TRIGGER = re.compile(rf"[0-9@]|{SPELT_OUT}|{NAMED}", re.I | re.A)
RARE = re.compile(rf"{SPELT_OUT}|{NAMED}".encode(), re.I)
NAMES = re.compile(rf"(?:{NAMED})(?=(\W{{0,6}}))", re.I | re.A)
KEYWORD = re.compile(rf"({NAMED})\W{{0,6}}$", re.I)
CALLED = re.compile(r"(tel|phone|call|mobile|fax|telefon|teléfono|téléphone)\W{0,6}$", re.I)
HEX = re.compile(r"[0-9a-fA-F]+\Z")
SHAPES = (
    ("mail", re.compile(r"[\w.%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\Z")),
    ("mail_words", re.compile(r"[\w.%+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+(( ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]+)+\Z", re.I)),
    ("quad", re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}\Z")),
    ("plus", re.compile(r"\+[0-9][0-9 ().-]{7,18}[0-9]\Z")),
    ("brackets", re.compile(r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\Z")),
    ("dashes", re.compile(r"[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}\Z")),
    ("fours", re.compile(r"[0-9]{4}([ -]?[0-9]{4}){3}\Z")),
    ("country", re.compile(r"[A-Z]{2}[0-9]{2}( ?[0-9A-Z]{4}){3,7}( ?[0-9A-Z]{1,3})?\Z")),
    ("mixed", re.compile(r"(?=[A-Za-z0-9_]*[0-9])(?=[A-Za-z0-9_]*[A-Za-z])[A-Za-z0-9_]{20,}\Z")),
    ("letters", re.compile(r"[A-Za-z_]{20,}\Z")),
    ("run", re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_][A-Za-z0-9_+/-]{18,}[A-Za-z0-9_+/=-]={0,1}\Z")),
)
COUNTRY = [name for name, _ in SHAPES].index("country")
N_FEATURES = len(SHAPES) + 16


def _iban(span: str) -> bool:
    span = span.replace(" ", "")
    return 15 <= len(span) <= 34 and span.isascii() and span.isalnum() and int("".join(str(int(c, 36)) for c in span[4:] + span[:4])) % 97 == 1


def segment_features(text: str, a: int, b: int) -> list[int]:
    """Features of the whole span ``text[a:b]`` and its surroundings."""
    span = text[a:b]
    on = [k for k, (_, shape) in enumerate(SHAPES) if shape.match(span)]
    n = len(SHAPES)
    digits = sum("0" <= c <= "9" for c in span)
    before, after = text[a - 1 : a], text[b : b + 1]
    flags = (
        True,
        9 <= digits <= 15,
        13 <= digits <= 19 and luhn("".join(c for c in span if "0" <= c <= "9")),
        digits < 7 and "@" not in span,
        len(span) >= 32 and HEX.match(span) is not None,
        COUNTRY in on and _iban(span),
        2 in on and all(map(_octet, span.split("."))),
        before.isalnum(),
        after.isalnum(),
        before in ("+", ".", "-", "_", "@") and before != "",
        after in ("-", "_", "@") and after != "",
        KEYWORD.search(text[max(0, a - 24) : a]) is not None,
        CALLED.search(text[max(0, a - 24) : a]) is not None,
        (after == "." and text[b + 1 : b + 2].isalnum()) or MORE.match(text, b) is not None,
        before == "." and text[max(0, a - 2) : a - 1].isalnum(),
        6 in on and not luhn("".join(c for c in span if "0" <= c <= "9")),
    )
    return on + [n + k for k, f in enumerate(flags) if f]


def segments(text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, list[int]]]]:
    """What ``candidates`` says of each token end, as a list."""
    return list(candidates(text, tokens))


def candidates(text: str, tokens: list[tuple[int, int]]) -> Iterator[list[tuple[int, list[int]]]]:
    """For each token end j, (first token, features) of the spans that could be personal data.

    Such a span has a digit, an at sign or a spelt-out one, or follows a word
    that names a secret; it has at most ``LONGEST`` characters,
    however many tokens they are, and begins and ends with neither space nor
    sentence mark.  A run of ``LEAST_RUN`` or more letters, digits and marks of
    keys is a candidate at any length; no span begins or ends inside one.
    """
    edge = [text[a:b] not in ".,;:!?|\"'" and not text[a].isspace() for a, b in tokens]
    low, high = (tokens[0][0], tokens[-1][1]) if tokens else (0, 0)
    named = {a for m in NAMES.finditer(text, low, high) for a in range(m.end(), m.end(1) + 1)}
    ats = {m.start() + 1 for m in SPELT.finditer(text, low, high)}
    hot = [text[a] in "0123456789@" or a in named or a in ats for a, _ in tokens]
    foreign = [FOREIGN.match(text, a) is not None for a, _ in tokens]
    blank = [text[a] == " " for a, _ in tokens]
    small = [text[a].isalpha() and CAPITALS.match(text[a:b]) is None for a, b in tokens]
    spelt = bool(ats)
    first_at = {a: i for i, (a, _) in enumerate(tokens)}
    runs = [m.span() for m in RUN.finditer(text, low, high) if m.end() - m.start() >= LEAST_RUN]
    run_begins = [a for a, _ in runs]

    for j in range(len(tokens)):
        here, seen, blanks, smalls, i, alone = [], False, False, False, j, False
        k = bisect_right(run_begins, tokens[j][0]) - 1
        if k >= 0 and tokens[j][0] < runs[k][1]:
            start, end = runs[k]
            if tokens[j][1] != end or start not in first_at:
                yield here
                continue
            i = first_at[start]
            alone = any(foreign[i : j + 1])
            if start in named or any(hot[i : j + 1]):
                on = segment_features(text, start, end)
                if on[0] < len(SHAPES):
                    here.append((i, on))
            seen, smalls = any(hot[i : j + 1]), any(small[i : j + 1])
            i -= 1
        while i >= 0 and edge[j] and not alone:
            if tokens[j][1] - tokens[i][0] > LONGEST or foreign[i] or (blank[i] and blank[i + 1]):
                break
            blanks, smalls = blanks or blank[i], smalls or small[i]
            if blanks and smalls and not spelt:
                break
            seen |= hot[i]
            # Nor does a span begin inside a run.
            b = bisect_right(run_begins, tokens[i][0]) - 1
            if seen and edge[i] and (b < 0 or tokens[i][0] == run_begins[b] or tokens[i][0] >= runs[b][1]):
                on = segment_features(text, tokens[i][0], tokens[j][1])
                # A span with none of the shapes is never better than outside text.
                if on[0] < len(SHAPES):
                    here.append((i, on))
            i -= 1
        yield here


def decode(lattice, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Best segmentation: (first token, last token, type) of its spans.  Outside tokens score 0.

    ``lattice`` is read once from front to back.
    """
    best, back = [0.0], [None]
    for j, here in enumerate(lattice):
        score, step = best[j], None
        for i, on in here:
            by_type = weights[:, on].sum(1)
            k = int(by_type.argmax())
            if best[i] + by_type[k] > score:
                score, step = best[i] + by_type[k], (i, j, k)
        best.append(score)
        back.append(step)
    out, j = [], len(best) - 1
    while j > 0:
        step = back[j]
        if step:
            out.append(step)
            j = step[0]
        else:
            j -= 1
    return out[::-1]


def _posteriors(lattice: list[tuple[int, int, int]], n: int, weight: list[float]) -> list[float]:
    """Probability of each segment (first token, last token, row) of ``n`` tokens, by forward and backward sums.

    ``weight``: exponential of each row's score summed over the types; outside tokens weigh 1.
    """
    forward, backward = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    starting: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, row in lattice:
        ending[j].append((i, weight[row]))
        starting[i].append((j, weight[row]))
    for j in range(n):
        forward[j + 1] = forward[j] + sum(forward[i] * w for i, w in ending[j])
    for i in range(n - 1, -1, -1):
        backward[i] = backward[i + 1] + sum(backward[j + 1] * w for j, w in starting[i])
    return [forward[i] * weight[row] * backward[j + 1] / forward[n] for i, j, row in lattice]


def _made(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A snippet and its spans (start, end, type)."""
    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word():
        return "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8)))

    def card():
        body = digits(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def iban():
        body = digits(18)
        check = 98 - int(body + "1314" + "00") % 97
        return f"DE{check:02d}{body}"

    def key(n):
        return "".join(rng.choice("abcdefghijABCDEFGHIJ0123456789") for _ in range(n))

    def letters(least, most):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randint(least, most)))

    def quad(top):
        return ".".join(str(rng.randint(0, top)) for _ in range(4))

    number = card()
    kind, text = rng.choice([
        (0, f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com"), (0, f"{word()}@{word()}.org"), (0, f"{word()} [at] {word()}{digits(2)} [dot] com"),
        (0, f"{word()}.{word()} [at] {word()} [dot] com"), (0, f"{word()}(at){word()}.org"), (0, f"{word()} (at) {word()} (dot) {word()} (dot) net"),
        (1, quad(255)), (1, quad(255)), (1, quad(20)), (2, number), (2, " ".join(number[k : k + 4] for k in range(0, 16, 4))),
        (3, f"+{rng.randint(1, 99)} ({digits(3)}) 555-{digits(4)}"), (3, f"+{digits(11)}"), (3, f"({digits(3)}) {digits(3)}-{digits(4)}"), (3, f"{digits(3)}-{digits(3)}-{digits(4)}"),
        (4, "".join(rng.choice("0123456789abcdef") for _ in range(40))), (4, "".join(rng.choice("0123456789abcdefghijABCDEFGHIJ") for _ in range(32))), (4, letters(24, 48)), (5, iban()),
        (4, f"sk-{key(rng.randint(6, 12))}-{key(rng.randint(10, 24))}"), (4, f"{key(rng.randint(20, 30))}/{key(9)}+{key(8)}{rng.choice(['', '=', '=='])}"), (4, key(rng.choice([64, 150, 200]))),
        (-1, f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}."), (-1, f"in {rng.randint(1500, 2100)},"), (-1, f"{digits(rng.randint(1, 6))} {word()}"),
        (-1, f"{digits(3)},{digits(3)}.{digits(2)}"), (-1, f"{quad(99)}.{digits(2)}"), (-1, digits(rng.choice([8, 16, 20, 24]))), (-1, f"{digits(4)}-{digits(2)}-{digits(2)}"),
        (-1, f"@{word()}{digits(2)}"), (-1, f"{word()}{digits(3)}"), (-1, f"build {''.join(rng.choice('0123456789abcdef') for _ in range(8))}"),
        (-1, f"{word()} [at] {word()}"), (-1, "".join(rng.choice("aeinorst") for _ in range(rng.randint(20, 30)))), (-1, f"key {word()}"),
        (-1, "-".join([word(), digits(2), *(word() for _ in range(4)), digits(4)])), (-1, "/".join([word(), word() + digits(1), word(), word() + "-" + word(), word()])),
        (-1, f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}-{digits(2)}-{digits(2)}"),
    ])
    if kind == -1 and re.fullmatch(r"[0-9]{13,19}", text) and luhn(text):
        kind = 2
    lead = f"{word()} {word()} "
    if kind == 4:
        lead += rng.choice(['token = "', "api_key: ", "secret=", "key "])
    elif kind == 3 and text[0] != "+":
        lead += rng.choice(["tel: ", "phone ", "call "])
    tail = rng.choice([" ", ". ", ", ", "\n", "*** ", "!! ", '" '])
    return f"{lead}{text}{tail}{word()}", [] if kind < 0 else [(len(lead), len(lead) + len(text), kind)]


@lru_cache(maxsize=1)
def trained(examples: int = 800, rounds: int = 120, rate: float = 0.5, ridge: float = 0.001, seed: int = 7) -> np.ndarray:
    """Weights of every type and feature; the same on every machine."""
    rng = random.Random(seed)
    rows, gold, lattices = [], [], []
    for _ in range(examples):
        text, spans = _made(rng)
        tokens = [m.span() for m in TOKEN.finditer(text)]
        lattice = []
        for j, here in enumerate(segments(text, tokens)):
            for i, on in here:
                lattice.append((i, j, len(rows)))
                rows.append(on)
                gold.append(next((kind for a, b, kind in spans if (tokens[i][0], tokens[j][1]) == (a, b)), -1))
        lattices.append((lattice, len(tokens)))
    x = np.zeros((len(rows), N_FEATURES))
    for r, on in enumerate(rows):
        x[r, on] = 1
    truth = (np.array(gold)[:, None] == np.arange(len(ALL))).astype(float)
    weights, squares = np.zeros((len(ALL), N_FEATURES)), np.full((len(ALL), N_FEATURES), 1e-8)
    for _ in range(rounds):
        by_type = np.exp(np.clip(x @ weights.T, -50, 50))
        total = by_type.sum(1)
        found, weight = np.zeros(len(rows)), total.tolist()
        for lattice, n in lattices:
            for (_, _, row), p in zip(lattice, _posteriors(lattice, n, weight), strict=True):
                found[row] = p
        gradient = (truth - by_type * (found / total)[:, None]).T @ x - ridge * examples * weights
        squares += gradient**2
        weights += rate * gradient / np.sqrt(squares)
    return weights


def windows(text: str, reach: int = 40) -> list[tuple[int, int]]:
    """Stretches around digits, at signs and words that point to a span, apart from each other.

    A stretch goes on while the next trigger is within ``reach``, however long
    it gets, and on both sides to a blank or as far as a span can.
    """
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.start() - reach <= out[-1][1]:
            out[-1][1] = max(out[-1][1], min(len(text), m.end() + reach))
        else:
            out.append([max(0, m.start() - reach), min(len(text), m.end() + reach)])
    apart: list[tuple[int, int]] = []
    for a, b in out:
        low, high = max(0, a - LONGEST), min(len(text), b + LONGEST)
        while a > low and not text[a - 1].isspace():
            a -= 1
        while b < high and not text[b].isspace():
            b += 1
        # A key goes on as long as it does.
        while a > 0 and text[a - 1 : a + 1].isascii() and (text[a - 1].isalnum() or text[a - 1] in RUN_MARKS):
            a -= 1
        while b < len(text) and text[b].isascii() and (text[b].isalnum() or text[b] in RUN_MARKS):
            b += 1
        if apart and a <= apart[-1][1]:
            apart[-1] = (apart[-1][0], b)
        else:
            apart.append((a, b))
    return apart


def added_spans(text: str, base: dict[str, list[tuple[int, int]]], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """The field's spans; of kinds that have fixed patterns only those that touch no base span."""
    taken = sorted(s for spans in base.values() for s in spans)
    begins = [x for x, _ in taken]
    ends = list(accumulate((y for _, y in taken), max))
    out = []
    for a, b in windows(text):
        # Places are those of the whole text, so that features see what is around the stretch.
        tokens = [m.span() for m in TOKEN.finditer(text, a, b)]
        for i, j, k in decode(candidates(text, tokens), weights):
            s, e = tokens[i][0], tokens[j][1]
            # Of the base spans that begin before its end none ends after its start.
            before = bisect_left(begins, e)
            if ALL[k] in ADDED or not before or ends[before - 1] <= s:
                out.append((ALL[k], s, e))
    return out


def find(text: str, weights: np.ndarray) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and all spans by kind as listed and then by start."""
    base = base_spans(text)
    every = [(k, a, b) for k in KINDS for a, b in base[k]] + added_spans(text, base, weights)
    return base, sorted(every, key=lambda s: (ALL.index(s[0]), s[1], s[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _suspects(texts: Texts) -> np.ndarray:
    """Texts with anything that ``TRIGGER`` matches; no span is without."""
    hot = ((texts.data >= 48) & (texts.data <= 57)) | (texts.data == 64)
    hot[[m.start() for m in RARE.finditer(np.ascontiguousarray(texts.data))]] = True
    return np.flatnonzero(sums(hot, texts.at))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs``.

    Null texts count as empty; a text of any length is looked at whole;
    repeated rows are judged each; an empty table gives no rows; other
    columns are not looked at.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    weights, nothing = trained(), hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                n = part.num_rows
                counts, prints, spans = np.zeros((4, n), np.int64), [nothing] * n, [""] * n
                for i in _suspects(Texts(part.column("text"))).tolist():
                    base, every = find(part.column("text")[i].as_py(), weights)
                    counts[:, i] = [len(base[k]) for k in KINDS]
                    prints[i] = hashlib.sha256(_joined((k, a, b) for k in KINDS for a, b in base[k]).encode()).hexdigest()
                    spans[i] = _joined(every)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, counts), pa.array(prints), pa.array(spans)], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, weights: np.ndarray) -> str:
    """The text with each span, overlapping ones together, replaced by its kind in angle brackets."""
    spans = sorted((a, b, k) for k, a, b in find(text, weights)[1])
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text`` replaced; all other columns and a null text stay."""
    weights, schema = trained(), docs.schema
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                found = _suspects(Texts(part.column(text))).tolist()
                if found:
                    values = part.column(text).to_pylist()
                    for i in found:
                        values[i] = masked(values[i], weights)
                    part = part.set_column(at, text, pa.array(values, part.schema.field(text).type))
                yield part

    return docs.mapInArrow(run, schema)
