"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns are scanned in linear time and always kept. The field looks at islands of text
around digits and at-signs: candidate segments of bounded length get whole-span features (checksum,
groups, separators, what stands beside them), and a dynamic program over segments picks boundaries and
types together. Elsewhere no segment is possible, so the islands' optima are the text's optimum. Its
spans that touch no base span are added: numbers without a plus sign after a cue, addresses with
"[at]" and "[dot]", and the like.

The weights are learnt by likelihood from a seeded, synthetic set of sentences that this module
makes; no table is used for that.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches

#: Fixed order of the kinds.
KINDS = ("email", "ip", "card", "phone")
#: A segment's most tokens.
LONGEST = 24
SENTENCES, EPOCHS, RATE, RIDGE = 320, 14, 0.25, 1e-4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_DIGITS = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches: the characters before an at-sign, as far back as the last match, and a domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def addresses(text: str):
    """Chains of numbers joined by dots, four at a time from the left."""
    for chain in _CHAIN.finditer(text):
        runs = [m.span() for m in _DIGITS.finditer(text, chain.start(), chain.end())]
        for k in range(0, len(runs) - 3, 4):
            four = runs[k : k + 4]
            if all(_octet(text[a:b]) for a, b in four):
                yield four[0][0], four[3][1]


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; positions are code points."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text) is None:
        return out
    out += [(a, 1, b) for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() >= 12 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


# --- the field

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_SPACE = re.compile(r"\s")
_TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?at\s?[\])}>]", re.I)
_CUES = {
    0: re.compile(r"(mail|contact|write|reach|address)\W*$", re.I),
    1: re.compile(r"(ip|host|server|address|ping)\W*$", re.I),
    2: re.compile(r"(card|visa|mastercard|amex|credit|pay)\W*(no|nr|number)?\W*$", re.I),
    3: re.compile(r"(tel|phone|call|mobile|fax|cell|whatsapp|ring|dial)\W*(me|us|at|on|no|number)?\W*$", re.I),
}
_AT, _DOT = r"\s?(?:@|[\[({<]\s?at\s?[\])}>])\s?", r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?)"
#: What a segment must look like to be a candidate of a kind at all.
_LOOSE = {
    0: re.compile(rf"[A-Za-z0-9][A-Za-z0-9_%+-]*(?:{_DOT}[A-Za-z0-9_%+-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I),
    1: re.compile(r"[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]{1,3}){3}"),
    2: re.compile(r"[0-9]{4}(?:[ ./_-]?[0-9]{2,7}){2,5}"),
    3: re.compile(r"(?:\+|00)?[ ]?\(?[0-9]{2,4}\)?(?:[ ./-]?\(?[0-9]{2,5}\)?){1,5}"),
}
#: Runs of digits that a segment of a kind can have at most, by the patterns above.
_RUNS = {1: 4, 2: 6, 3: 6}
_EXACT = {0: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), 1: re.compile(r"[0-9]+(\.[0-9]+){3}"), 2: _CARD, 3: _PHONE}


def islands(text: str, reach: int = 96) -> list[tuple[int, int]]:
    """Stretches that hold every possible segment: what lies within ``reach`` of a trigger, widened to white space."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        end = out[-1][1] if out else 0
        if m.end() + reach <= end:
            continue
        a = max(end, m.start() - reach)
        while a > end and not text[a - 1].isspace():
            a -= 1
        found = _SPACE.search(text, min(len(text), m.end() + reach))
        b = found.start() if found else len(text)
        if out and a <= end:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@functools.lru_cache(maxsize=1)
def feature_names() -> dict[str, int]:
    own = ("bias", "exact", "luhn", "octets", "length", "cue", "plus", "groups", "one separator", "mixed separators", "no separator", "left joined", "right joined", "written out", "known end", "date", "stop inside")
    names = [f"{k}:{f}" for k in KINDS for f in own] + [f"{a}>{b}" for a in KINDS for b in KINDS]
    return {n: i for i, n in enumerate(names)}


@functools.lru_cache(maxsize=1 << 14)
def inner_features(span: str, kind: int) -> tuple[int, ...] | None:
    """Features of a segment by itself; None if it cannot be of the kind."""
    if not _LOOSE[kind].fullmatch(span):
        return None
    names, k = feature_names(), KINDS[kind]
    digits = "".join(c for c in span if "0" <= c <= "9")
    out = ["bias"]
    if _EXACT[kind].fullmatch(span):
        out.append("exact")
    if kind == 2:
        out += ["luhn"] if luhn(digits) else []
        out += ["length"] if 13 <= len(digits) <= 19 else []
    if kind == 1:
        out += ["octets"] if all(_octet(d) for d in _DIGITS.findall(span)) else []
    if kind == 3:
        out += ["length"] if 9 <= len(digits) <= 15 else []
        out += ["plus"] if span[0] == "+" or span.startswith("00") else []
        out += ["groups"] if 3 <= len(_DIGITS.findall(span)) <= 5 else []
        out += ["date"] if re.fullmatch(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)?[0-9]{2}", span) else []
    if kind == 0:
        out += ["written out"] if "@" not in span else []
        out += ["known end"] if re.search(r"(com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$", span, re.I) else []
    if kind in (2, 3):
        apart = {c for c in span if c in " ./_-"}
        out.append(("no separator", "one separator")[len(apart)] if len(apart) < 2 else "mixed separators")
    return tuple(names[f"{k}:{f}"] for f in out)


def start_features(text: str, a: int, kind: int) -> tuple[int, ...]:
    """Features of what stands before a segment that starts at ``a``; the same for all its ends."""
    names, before, out = feature_names(), text[a - 1 : a], []
    if before and (before.isalnum() or before in "+.-_/=#$€£"):
        out.append("left joined")
    if _CUES[kind].search(text[max(0, a - 24) : a]):
        out.append("cue")
    return tuple(names[f"{KINDS[kind]}:{f}"] for f in out)


def span_features(text: str, a: int, b: int, kind: int, start: tuple[int, ...] | None = None) -> list[int] | None:
    """Features of text[a:b] as one entity of a kind; None if it cannot be one. ``start`` are those of its start, if known."""
    # only short segments are remembered, so the store is bounded in bytes too
    own = (inner_features if b - a <= 64 else inner_features.__wrapped__)(text[a:b], kind)
    if own is None:
        return None
    after = text[b : b + 1]
    joined = after and (after.isalnum() or after in "-_/%=" or (after in ".,:" and text[b + 1 : b + 2].isdigit()))
    right = [feature_names()[f"{KINDS[kind]}:right joined"]] if joined else []
    return [*own, *(start_features(text, a, kind) if start is None else start), *right]


def starts(text: str, start: int, stop: int):
    """For each token in turn: how many it is, and the possible segments from it as (from, to, kind, features, first character, last).

    Only the tokens that a segment can reach are held.
    """
    ahead: deque = deque()
    more = (m.span() for m in _TOKEN.finditer(text, start, stop))
    i = 0
    while True:
        while len(ahead) < LONGEST:
            span = next(more, None)
            if span is None:
                break
            ahead.append(span)
        if not ahead:
            return
        a = ahead[0][0]
        digit, word = text[a].isdigit(), text[a].isalpha()
        kinds = [1, 2, 3] if digit else [3] if text[a] in "+(" else []
        kinds = [k for k in kinds if _LOOSE[k].match(text, a, stop)]
        if digit or word:
            near = text[a : ahead[-1][1]].lower()
            if ("@" in near or " at" in near or "at]" in near or "at)" in near) and _LOOSE[0].match(text, a, stop):
                kinds = [0, *kinds]
        out = []
        for kind in kinds:
            runs, before = 0, start_features(text, a, kind)
            for j, (_, b) in enumerate(ahead, i + 1):
                if kind and "0" <= text[b - 1] <= "9":
                    runs += 1
                    if runs > _RUNS[kind]:
                        break
                if kind and not (text[b - 1].isdigit() or text[b - 1] == ")"):
                    if text[b - 1].isalpha():
                        break
                    continue
                if kind == 0 and not text[b - 1].isalnum():
                    continue
                got = span_features(text, a, b, kind, before)
                if got is not None:
                    out.append((i, j, kind, got, a, b))
        yield i, out
        ahead.popleft()
        i += 1


def candidates(text: str, start: int, stop: int) -> tuple[int, list[tuple[int, int, int, list[int], int, int]]]:
    """Number of tokens, and every possible segment, by its end; for training on short texts."""
    n, out = 0, []
    for i, own in starts(text, start, stop):
        n = i + 1
        out += own
    return n, out


class Field:
    """Segment weights; ``decode`` gives the best segmentation, ``gradient`` the likelihood's slope."""

    def __init__(self, weights: list[float] | None = None):
        self.weights = weights or [0.0] * len(feature_names())
        base = feature_names()[f"{KINDS[0]}>{KINDS[0]}"]
        self.pair = lambda a, b: base + len(KINDS) * a + b

    def decode(self, segments) -> list[tuple[int, int, int]]:
        """Chosen (first character, kind, last character); ``segments`` come token by token, as from ``starts``.

        Only the states that a segment can still reach are held: the best total by type of the last
        segment (or none), and the chain of segments chosen on the way. Chains share their beginnings,
        so memory grows with what is found, not with the text.
        """
        w, outside = self.weights, len(KINDS)
        nothing = [-math.inf] * (outside + 1)
        ahead: dict[int, tuple[list, list]] = {}
        best, chain = [*nothing[:-1], 0.0], [None] * (outside + 1)
        for i, own in segments:
            for s in own:
                value = sum(w[f] for f in s[3])
                totals, chains = ahead.setdefault(s[1], ([*nothing], [None] * (outside + 1)))
                for y in range(outside + 1):
                    if best[y] > -math.inf:
                        total = best[y] + value + (w[self.pair(y, s[2])] if y < outside else 0.0)
                        if total > totals[s[2]]:
                            totals[s[2]], chains[s[2]] = total, (chain[y], s[4], s[2], s[5])
            top = max(range(outside + 1), key=best.__getitem__)
            after, links = ahead.pop(i + 1, ([*nothing], [None] * (outside + 1)))
            after[outside], links[outside] = best[top], chain[top]
            best, chain = after, links
        out, link = [], chain[max(range(outside + 1), key=lambda k: (best[k], k))]
        while link:
            link, a, kind, b = link
            out.append((a, kind, b))
        return out[::-1]

    def gradient(self, n: int, segments: list, gold: set) -> dict[int, float]:
        """Observed less expected features, by forward and backward sums over segmentations."""
        w, outside = self.weights, len(KINDS)
        ends: dict[int, list] = {}
        for s in segments:
            ends.setdefault(s[1], []).append((s, sum(w[f] for f in s[3])))

        def add(values):
            top = max(values, default=-math.inf)
            return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))

        fore = [[-math.inf] * (outside + 1) for _ in range(n + 1)]
        fore[0][outside] = 0.0
        for j in range(1, n + 1):
            fore[j][outside] = add(fore[j - 1])
            for kind in range(outside):
                fore[j][kind] = add([fore[s[0]][y] + v + (w[self.pair(y, kind)] if y < outside else 0.0) for s, v in ends.get(j, ()) if s[2] == kind for y in range(outside + 1) if fore[s[0]][y] > -math.inf])
        rear = [[-math.inf] * (outside + 1) for _ in range(n + 1)]
        rear[n] = [0.0] * (outside + 1)
        starts: dict[int, list] = {}
        for own in ends.values():
            for s, v in own:
                starts.setdefault(s[0], []).append((s, v))
        for i in range(n - 1, -1, -1):
            for y in range(outside + 1):
                rear[i][y] = add([rear[i + 1][outside], *[v + (w[self.pair(y, s[2])] if y < outside else 0.0) + rear[s[1]][s[2]] for s, v in starts.get(i, ())]])
        whole = rear[0][outside]
        out: dict[int, float] = {}
        for own in ends.values():
            for s, v in own:
                for y in range(outside + 1):
                    if fore[s[0]][y] == -math.inf:
                        continue
                    p = math.exp(fore[s[0]][y] + v + (w[self.pair(y, s[2])] if y < outside else 0.0) + rear[s[1]][s[2]] - whole)
                    for f in (*s[3], *([self.pair(y, s[2])] if y < outside else ())):
                        out[f] = out.get(f, 0.0) - p
                if (s[4], s[2], s[5]) in gold:
                    for f in s[3]:
                        out[f] = out.get(f, 0.0) + 1.0
        return out


def sentences(count: int = SENTENCES, seed: int = 11):
    """Synthetic training text: (text, spans) with personal data in usual and unusual forms, and numbers that are none."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))

    def card(valid: bool = True) -> str:
        body = rng.choice("3456") + number(14)
        check = next(d for d in "0123456789" if luhn(body + d) == valid)
        digits = body + check
        apart = rng.choice(["", " ", "-", ".", "/"])
        return apart.join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        groups = [number(3), number(3), number(4)]
        form = rng.randint(0, 4)
        if form == 0:
            return f"+{rng.randint(1, 99)} {' '.join(groups)}"
        if form == 1:
            return f"+{rng.randint(1, 99)} ({groups[0]}) {groups[1]}-{groups[2]}"
        if form == 2:
            return f"00{rng.randint(1, 99)} {' '.join(groups)}"
        return ("-" if form == 3 else " ").join(groups)

    def email() -> str:
        at, dot = rng.choice([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" [at] ", ".")])
        return f"{word()}{rng.choice(['', '.' + word(), number(2)])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'io'])}"

    def address() -> str:
        return rng.choice([".", ".", "[.]", " . "]).join(str(rng.randint(1, 255)) for _ in range(4))

    noise = [lambda: f"20{number(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: number(rng.randint(1, 6)), lambda: f"${number(3)}.{number(2)}", lambda: card(False), lambda: f"{number(2)}:{number(2)}", lambda: number(11), lambda: " ".join(str(rng.randint(1, 40)) for _ in range(rng.randint(4, 9))), lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"{number(4)}-{number(4)}", lambda: f"{rng.randint(300, 999)}.{number(3)}.{number(3)}.{number(3)}", lambda: number(16), lambda: f"0x{number(8)}", lambda: f"{word()}@{word()}"]
    cues = {0: ["mail", "contact", "write to", "reach"], 1: ["host", "server", "ip"], 2: ["card", "visa", "credit card number"], 3: ["tel", "call", "phone:", "mobile", "fax"]}
    made = {0: email, 1: address, 2: card, 3: phone}
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 4))), []
        for _ in range(rng.randint(1, 3)):
            text += " " if text else ""
            if rng.random() < 0.55:
                kind = rng.randint(0, 3)
                value = made[kind]()
                plain = kind == 3 and value[0] not in "+0"
                if plain or rng.random() < 0.4:
                    text += rng.choice(cues[kind]) + " "
                spans.append((len(text), kind, len(text) + len(value)))
                text += value
            else:
                text += rng.choice(noise)()
            text += rng.choice(["", ".", ","]) + " " + " ".join(word() for _ in range(rng.randint(1, 4)))
        yield text, spans


def train(count: int = SENTENCES, epochs: int = EPOCHS, rate: float = RATE, ridge: float = RIDGE) -> list[float]:
    """Weights after ``epochs`` of stochastic gradient ascent on the log-likelihood; the same in every run."""
    field = Field()
    data = [(*candidates(text, 0, len(text)), set(spans)) for text, spans in sentences(count)]
    for epoch in range(epochs):
        step = rate / (1 + epoch / 4)
        for n, segments, gold in data:
            for f, g in field.gradient(n, segments, gold).items():
                field.weights[f] += step * (g - ridge * field.weights[f])
    return [round(x, 6) for x in field.weights]


def added_spans(field: Field, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The field's spans that touch no base span."""
    out, at = [], 0
    reach, end = [], 0  # the furthest end of the base spans up to each
    for _, _, e in base:
        end = max(end, e)
        reach.append(end)
    for start, stop in islands(text):
        for a, kind, b in field.decode(starts(text, start, stop)):
            while at < len(base) and base[at][0] < b:
                at += 1
            if at == 0 or reach[at - 1] <= a:
                out.append((a, kind, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def spans_of(field: Field, text: str) -> tuple[list, list]:
    """Base spans, and base and added ones."""
    base = base_spans(text)
    if _TRIGGER.search(text) is None:
        return base, base
    return base, sorted(base + added_spans(field, text, base))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs`` (doc_id, text).

    The counts are of base spans. A null text counts as empty; rows that repeat come out as often; a
    null doc_id stays null; further columns are ignored; an empty table gives an empty result. A very
    long text is decoded as it is read and costs little beyond itself and what is found in it.
    """
    arrow_batches(docs.sparkSession)
    weights = train()

    def run(batches):
        field = Field(list(weights))
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = spans_of(field, text)
                count = [0] * len(KINDS)
                for _, kind, _ in base:
                    count[kind] += 1
                rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows)) if rows else [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    text = F.coalesce(F.col("text"), F.lit(""))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).mapInArrow(run, schema)


def mask(field: Field, text: str) -> str:
    """The text with every span, overlapping ones together, replaced by its kind in angle brackets."""
    _, spans = spans_of(field, text)
    out, end = [], 0
    for a, kind, b in spans:
        if a >= end:
            out += [text[end:a], f"<{KINDS[kind].upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_chars`` counted anew; null texts stay null."""
    arrow_batches(docs.sparkSession)
    weights = train()

    def run(batches):
        field = Field(list(weights))
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else mask(field, t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
