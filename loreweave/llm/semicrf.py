"""Operator 10, personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns (email, ip, card, phone) are the base and always stay. In the text between their spans a semi-Markov
field segments tokens into ordinary ones and entities of bounded length: features of the whole span (shape, digit
groups, separators, checksum, neighbouring words) score each candidate segment, and a dynamic programme over segments
chooses boundaries and types together. An entity needs a digit or an at sign, so tokens farther from one than the
longest entity are ordinary for certain and are not looked at; that changes no result.

The field is trained here by conditional likelihood (forward-backward over segments) on generated sentences.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, small_batches, tidy

KINDS = ("email", "ip", "card", "phone")
LONGEST = 14  # tokens of an entity

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_ANCHOR = re.compile(r"[0-9@]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        d = int(c) * (1 + at % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, looked for from each at sign: the local part is all it can be, back to the last match."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end(), "email"
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """The contract's spans, by start and then kind as listed."""
    out = list(emails(text))
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the field -------------------------------------------------------------------------------------------------


def _shape(text: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 5), text)
    return re.sub(r"[^\W\d_]+", "a", s)


def _features(text: str, tokens: list[tuple[int, int]], i: int, j: int, kind: str) -> list[str]:
    """Names of the features of tokens i..j-1 as an entity of a kind."""
    span = text[tokens[i][0] : tokens[j - 1][1]]
    digits = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    before = text[tokens[i - 1][0] : tokens[i - 1][1]].lower() if i else "^"
    after = text[tokens[j][0] : tokens[j][1]].lower() if j < len(tokens) else "$"
    glued_left = i > 0 and tokens[i - 1][1] == tokens[i][0]
    glued_right = j < len(tokens) and tokens[j - 1][1] == tokens[j][0]
    out = [
        "bias",
        f"shape={_shape(span)}" if len(span) < 40 else "shape=long",
        f"marks={''.join(sorted({c for c in span if not c.isalnum()}))}",
        f"digits={min(len(digits), 20)}",
        f"groups={'-'.join(str(len(g)) for g in groups[:6])}",
        f"letters={any(c.isalpha() for c in span)}",
        f"glued={glued_left}{glued_right}",
        f"before={before if len(before) < 12 and not before.isdigit() else '#'}",
        f"after={'9' if after[:1].isdigit() else 'a' if after[:1].isalpha() else after[:1]}",
        f"ends={_shape(span[0])}{_shape(span[-1])}",
    ]
    if "@" in span:
        tail = span.rpartition("@")[2].strip()
        out.append(f"domain={'.' in tail}{bool(re.fullmatch(r'[A-Za-z0-9. -]+', tail))}")
    if len(digits) >= 12:
        out.append(f"luhn={luhn(digits)}")
    if len(groups) == 4 and not any(c.isalpha() for c in span):
        out.append(f"octets={all(int(g[:9]) <= 255 for g in groups)}")
    return [f"{kind}|{x}" for x in out]


def _candidates(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """Segments that may be an entity, and of which kinds."""
    n = len(tokens)
    digits = [sum("0" <= c <= "9" for c in text[a:b]) for a, b in tokens]
    words = [text[a:b] for a, b in tokens]
    for i in range(n):
        if not (words[i][0].isalnum() or words[i] in "+("):
            continue
        count, has_at, dots, letters = 0, False, 0, False
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            w = words[j - 1]
            if j > i + 1 and tokens[j - 1][0] - tokens[j - 2][1] > 1:
                break  # no entity reaches over a wide gap or a blank line
            count += digits[j - 1]
            has_at |= w == "@"
            dots += w in "-._"
            letters |= any(c.isalpha() for c in w)
            if not (w[-1].isalnum() or w == ")") or not (count or has_at):
                continue
            kinds = []
            if has_at:
                kinds.append("email")
            elif not letters:
                if 4 <= count <= 12 and dots >= 3:
                    kinds.append("ip")
                if 12 <= count <= 19:
                    kinds.append("card")
                if 7 <= count <= 15:
                    kinds.append("phone")
            if kinds:
                yield i, j, tuple(kinds)


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


class Field:
    """Weights by feature name, and by pair of neighbouring types (0 is an ordinary token)."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.moves = [[0.0] * (len(KINDS) + 1) for _ in range(len(KINDS) + 1)]

    def segments(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, list[str]]]:
        return [(i, j, KINDS.index(k) + 1, _features(text, tokens, i, j, k)) for i, j, kinds in _candidates(text, tokens) for k in kinds]

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities."""
        segments = self.segments(text, tokens)
        if not segments:
            return []
        by_end: dict[int, list[tuple[int, int, float]]] = {}
        for i, j, kind, features in segments:
            by_end.setdefault(j, []).append((i, kind, self.score(features)))
        n, types = len(tokens), range(len(KINDS) + 1)
        top = [[-math.inf] * len(types) for _ in range(n + 1)]
        back: list[list[tuple[int, int] | None]] = [[None] * len(types) for _ in range(n + 1)]
        top[0][0] = 0.0
        for j in range(1, n + 1):
            for i, kind, s in [(j - 1, 0, 0.0), *by_end.get(j, ())]:
                for prior in types:
                    value = top[i][prior] + self.moves[prior][kind] + s
                    if value > top[j][kind]:
                        top[j][kind], back[j][kind] = value, (i, prior)
        kind, j, out = max(types, key=lambda y: top[n][y]), n, []
        while j:
            i, prior = back[j][kind]
            if kind:
                out.append((i, j, kind))
            j, kind = i, prior
        return out[::-1]

    def learn(self, text: str, tokens: list[tuple[int, int]], segments: list[tuple[int, int, int, list[str]]], gold: set[tuple[int, int, int]], rate: float) -> None:
        """A gradient step on the log likelihood of the gold segmentation."""
        n, types = len(tokens), range(len(KINDS) + 1)
        scored = [(i, j, y, self.score(f)) for i, j, y, f in segments] + [(j, j + 1, 0, 0.0) for j in range(n)]
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for at, (i, j, _, _) in enumerate(scored):
            ending[j].append(at)
            starting[i].append(at)
        low = -math.inf
        fore = [[low] * len(types) for _ in range(n + 1)]
        aft = [[low] * len(types) for _ in range(n + 1)]
        fore[0][0], aft[n] = 0.0, [0.0] * len(types)
        for j in range(1, n + 1):
            sums: list[list[float]] = [[] for _ in types]
            for at in ending[j]:
                i, _, y, s = scored[at]
                sums[y] += [fore[i][p] + self.moves[p][y] + s for p in types if fore[i][p] > low]
            fore[j] = [_log_sum(x) if x else low for x in sums]
        for i in range(n - 1, -1, -1):
            for p in types:
                values = [self.moves[p][scored[at][2]] + scored[at][3] + aft[scored[at][1]][scored[at][2]] for at in starting[i]]
                aft[i][p] = _log_sum([v for v in values if v > low] or [low])
        whole = _log_sum(fore[n])
        steps = [[0.0] * len(types) for _ in types]
        for at, (i, j, y, s) in enumerate(scored):
            chance = 0.0
            for p in types:
                if fore[i][p] > low and aft[j][y] > low:
                    c = math.exp(fore[i][p] + self.moves[p][y] + s + aft[j][y] - whole)
                    steps[p][y] -= c
                    chance += c
            if y:
                delta = rate * (((i, j, y) in gold) - chance)
                for f in segments[at][3]:
                    self.weights[f] = self.weights.get(f, 0.0) + delta
        prior, at = 0, 0
        ends = {i: (j, y) for i, j, y in gold}
        while at < n:
            at, y = ends.get(at, (at + 1, 0))
            steps[prior][y] += 1.0
            prior = y
        for p in types:
            for y in types:
                self.moves[p][y] += rate * steps[p][y]


# --- training sentences ----------------------------------------------------------------------------------------


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _word(r: random.Random) -> str:
    return "".join(r.choice("aeioubcdfghlmnprstv") for _ in range(r.randint(2, 9)))


def _entity(r: random.Random, kind: str) -> str:
    if kind == "email":
        user, host = _word(r) + r.choice(["", f".{_word(r)}", f".{_number(r, 2)}"]), f"{_word(r)}.{r.choice(['com', 'org', 'net'])}"
        return r.choice([f"{user}@{host}", f"{user} @ {host}", f"{user}@mail.{host}", f"{user} @{host}"])
    if kind == "ip":
        parts = [str(r.randint(1, 255)) for _ in range(4)]
        return r.choice([".", "-"]).join(parts)
    if kind == "card":
        body = r.choice("3456") + _number(r, 14)
        digits = next(body + d for d in "0123456789" if luhn(body + d))
        return r.choice(["", " ", "-", "."]).join(digits[k : k + 4] for k in range(0, 16, 4))
    a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
    return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"1-{a}-{b}-{c}"])


def _plain(r: random.Random) -> str:
    """Digits and marks that are no personal data."""
    y, m, d = str(r.randint(1900, 2030)), f"{r.randint(1, 12):02}", f"{r.randint(1, 28):02}"
    return r.choice(
        [f"{y}-{m}-{d}", f"{d}.{m}.{y}", y, _number(r, r.randint(1, 9)), f"{_number(r, 3)},{_number(r, 3)},{_number(r, 3)}", f"${_number(r, 4)}.{_number(r, 2)}", f"v{_number(r, 1)}.{_number(r, 2)}.{_number(r, 1)}", f"{m}:{d}:{_number(r, 2)}", f"{_word(r)}={_number(r, 2)}{_word(r)}{_number(r, 9)}", f"{_number(r, 2)} {_number(r, 3)} {_number(r, 4)}", f"{_number(r, 4)} {_number(r, 4)} {_number(r, 5)}", f"@{_word(r)}", f"{_word(r)} @ {_word(r)}", f"http://{_word(r)}.example/{_number(r, 8)}", _number(r, r.randint(10, 19)), f"{y}-{y}", f"{_number(r, 1)}.{_number(r, 1)}.{_number(r, 1)}.{_number(r, 1)}.{_number(r, 2)}", f"{_number(r, 6)}-{_number(r, 6)}"]
    )


def sentences(count: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Generated texts with their entities."""
    r, out = random.Random(seed), []
    for _ in range(count):
        text, gold = "", []
        for _ in range(r.randint(2, 3)):
            text += " ".join(_word(r) for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                entity = _entity(r, kind)
                gold.append((len(text), len(text) + len(entity), kind))
                text += entity
            else:
                text += _plain(r)
            text += r.choice([" ", ". ", ", ", " "])
        out.append((text.strip(), gold))
    return out


@lru_cache(maxsize=2)
def trained(count: int = 360, rounds: int = 6, seed: int = 7) -> Field:
    """The field fitted to generated sentences; the same arguments give the same weights."""
    field, work = Field(), []
    for text, spans in sentences(count, seed):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        begin, end = {a: i for i, (a, _) in enumerate(tokens)}, {b: j + 1 for j, (_, b) in enumerate(tokens)}
        segments = field.segments(text, tokens)
        possible = {s[:3] for s in segments}
        gold = {(begin[a], end[b], KINDS.index(k) + 1) for a, b, k in spans if a in begin and b in end}
        if gold <= possible:
            work.append((text, tokens, segments, gold))
    for turn in range(rounds):
        for text, tokens, segments, gold in work:
            field.learn(text, tokens, segments, gold, 0.3 / (1 + turn))
    return field


# --- over documents --------------------------------------------------------------------------------------------


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """The field's entities in the text between base spans.

    Tokens farther than ``LONGEST`` from any that holds a digit or an at sign are ordinary, so each island of tokens
    around such ones is segmented by itself.
    """
    out: list[Span] = []
    gaps, at = [], 0
    for a, b, _ in base:
        if a > at:
            gaps.append((at, a))
        at = max(at, b)
    gaps.append((at, len(text)))
    for low, high in gaps:
        if not _ANCHOR.search(text, low, high):
            continue
        tokens = [m.span() for m in _TOKEN.finditer(text, low, high)]
        anchors = [k for k, (x, y) in enumerate(tokens) if _ANCHOR.search(text, x, y)]
        islands: list[list[int]] = []
        for k in anchors:
            if islands and k - LONGEST <= islands[-1][1]:
                islands[-1][1] = k + LONGEST + 1
            else:
                islands.append([max(0, k - LONGEST), k + LONGEST + 1])
        for first, last in islands:
            some = tokens[first:last]
            out += [(some[i][0], some[j - 1][1], KINDS[kind - 1]) for i, j, kind in field.best(text, some)]
    return out


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and the spans of every whole text: ``base`` and ``added``, arrays of (start, end, kind) in code points.

    Ends are exclusive. A null text is empty and has none; a text of any length is searched whole; repeated rows get equal spans; an empty table gives no rows;
    other columns are ignored. Added spans never overlap base ones. The field's weights (some thousand numbers) go to
    the tasks by value.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(field or trained())

    def structs(spans: list[Span]) -> list[dict]:
        return [{"start": a, "end": b, "kind": k} for a, b, k in spans]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            base, added = [], []
            for text in frame["text"]:
                text = text if isinstance(text, str) else ""
                own = base_spans(text)
                base.append(structs(own))
                added.append(structs(added_spans(text, own, held.value)))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "base": base, "added": added})

    spans = "array<struct<start:int,end:int,kind:string>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(tidy(run), f"doc_id long, base {spans}, added {spans}")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, done = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with the personal data of its texts masked; all rows and columns stay, null texts stay null."""
    held = docs.sparkSession.sparkContext.broadcast(field or trained())

    def change(columns: dict[str, list]) -> list[str | None]:
        out = []
        for text in columns["text"]:
            base = base_spans(text) if text else []
            spans = base + added_spans(text, base, held.value) if text else []
            out.append(masked(text, spans) if spans else text)
        return out

    return map_text(docs, change)


def _joined(spans):
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts and hash of the base spans, and all spans; n_added counts the field's."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
