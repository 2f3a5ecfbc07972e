"""Personal data: exact patterns, and a linear-chain CRF that finds what the patterns miss.

The patterns (email, ip, card, phone) are those of the query's contract; their spans always stay.  The CRF
tags words, by shape features, with B- and I- labels of the same four kinds: telephone numbers without a
country code, spelled-out addresses ("ann [at] example [dot] org"), card numbers of other lengths, addresses
with spaces.  It is trained from a small labelled table (``training_table``, or any table of words and
labels).  Viterbi decodes only windows around words that hold a digit or an at-sign, or spell one out: every
other word is outside by the lattice's construction.  A decoded span must still pass its kind's check (number
of digits, Luhn, parts of an address) and must not touch a pattern's span.

Offsets are code points, end exclusive.  Null and empty texts have no spans.  Each row is handled by itself,
so ties, repeated rows, further columns and empty tables make no difference.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blocks, need, on_workers
from .crf import Chain, by_size, padded

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
BITS = 14
#: Words decoded on either side of a trigger.
REACH = 4

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits can't be entered half way: what follows it decides alike for all its suffixes.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIGGER = re.compile(r"[0-9]|@|[\[({<](?:at|AT)[\])}>]|(?<![A-Za-z])(?:dot|DOT)(?![A-Za-z])")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each at-sign back over the local part, no further than the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The contract's matches of each kind, failing ones dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(emails(text))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= len(m[0]) and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def shape(word: str) -> str:
    out = []
    for c in word:
        kind = "9" if "0" <= c <= "9" else "x" if c.islower() else "X" if c.isupper() else "x" if c.isalpha() else c
        out.append(kind)
    return "".join(out)


def _hash(name: str) -> int:
    return int.from_bytes(sha256(name.encode("utf-8", "replace")).digest()[:4], "little") >> (32 - BITS)


@lru_cache(maxsize=50_000)
def word_features(word: str) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
    """Hashed features of a word for itself, for the word after it and for the word before it."""
    core = word.strip(".,;:!?\"'")
    exact, short = shape(core), re.sub(r"(.)\1+", r"\1", shape(core))
    digits = sum(c.isdigit() for c in core)
    lower = core.lower()
    # a plain word's own letters say nothing unless it is a marker
    name = lower if lower in MARKERS else ""
    own = (f"s:{exact}", f"c:{short}", f"d:{min(digits, 20)}", f"w:{name}", f"l:{min(len(core), 20)}", f"@:{'@' in core}{'.' in core.strip('.')}{'-' in core}{core[:1] if not core[:1].isalnum() else ''}")
    near = (f"c:{short}", f"w:{name}", f"d:{min(digits, 20)}")
    return tuple(_hash("0" + x) for x in own), tuple(_hash("-" + x) for x in near), tuple(_hash("+" + x) for x in near)


#: Words that stand next to personal data, fixed values.
MARKERS = frozenset("at dot (at) [at] [dot] (dot) tel phone call fax mobile email mail e-mail card visa mastercard ip server host com org net example".split())

_NONE = (_hash("-none"),) * 3, (_hash("+none"),) * 3


def window_features(words: list[str]) -> list[tuple[int, ...]]:
    parts = [word_features(w) for w in words]
    out = []
    for k, (own, _, _) in enumerate(parts):
        before = parts[k - 1][1] if k else _NONE[0]
        after = parts[k + 1][2] if k + 1 < len(parts) else _NONE[1]
        out.append(own + before + after)
    return out


def training_table(seed: int = 5, rows: int = 600) -> list[tuple[list[str], list[str]]]:
    """A small labelled table, (words, labels) a row, filled from patterns by a seeded generator."""
    r = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda: "".join(r.choice(list("abcdefghilmnoprstuv"), r.integers(2, 9)))
    pick = lambda *x: x[r.integers(len(x))]

    def card(n: int) -> str:
        body = pick("4", "5", "37", "6") + digits(n)
        body = body[: n - 1]
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def grouped(text: str, sizes: tuple[int, ...], sep: str) -> str:
        out, at = [], 0
        for s in sizes:
            out.append(text[at : at + s])
            at += s
        return sep.join(out)

    def pii() -> tuple[str, str]:
        kind = pick("phone", "phone", "email", "email", "card", "ip")
        if kind == "phone":
            a, b, c = str(r.integers(200, 999)), digits(3), digits(4)
            return kind, pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"+1 ({a}) {b}-{c}", f"0{a} {b} {c}{digits(1)}", f"{a}.{b}.{c}", f"+{r.integers(20, 60)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"+{digits(1)}{a}{b}{c}")
        if kind == "email":
            n, d, t = pick(word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}.{digits(2)}"), pick(word(), "example", f"mail{digits(1)}.example"), pick("com", "org", "net", "de")
            return kind, pick(f"{n}@{d}.{t}", f"{n} [at] {d} [dot] {t}", f"{n} (at) {d} (dot) {t}", f"{n} at {d} dot {t}", f"{n} [at] {d}.{t}", f"{n} @ {d}.{t}", f"{n}[at]{d}.{t}")
        if kind == "card":
            return kind, pick(card(16), grouped(card(16), (4, 4, 4, 4), pick(" ", "-")), grouped(card(15), (4, 6, 5), pick(" ", "-")), card(15), card(14), grouped(card(14), (4, 6, 4), " "), card(13))
        parts = [str(x) for x in r.integers(1, 255, 4)]
        return kind, pick(".".join(parts), ".".join(parts), ".".join(parts) + f":{r.integers(80, 9999)}", "[.]".join(parts))

    def other() -> str:
        y, m, d = r.integers(1900, 2030), r.integers(1, 13), r.integers(1, 29)
        return str(pick(f"{y}", f"{y}-{m:02}-{d:02}", f"{m}/{d}/{y}", f"{d}.{m}.{y}", f"{r.integers(1, 24)}:{r.integers(10, 59)}", f"{digits(1)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(5)}", f"${digits(3)}.{digits(2)}", f"{digits(2)}%", f"{digits(8)}", f"{r.integers(1, 999)},{digits(3)}",
            f"{r.integers(10, 99)}x{r.integers(10, 99)}", '"' + "".join(r.choice(list("0123456789abcdef"), 40)) + '"', "".join(r.choice(list("0123456789abcdef"), 32)), f"AKIA{word().upper()}{digits(8)}", f"{digits(3)}-{digits(2)}", f"No. {digits(6)}", f"1. {word()}", "dot", f"chapter {digits(2)}", f"{digits(12)}", f"{digits(20)}", f"id {digits(10)}", f"{digits(3)} {digits(3)}", "[at]", f"in {word()} dot {word()}", f"@{word()}"))

    table = []
    for k in range(rows):
        words, labels = [], []

        def put(text: str, kind: str | None) -> None:
            for i, w in enumerate(text.split()):
                words.append(w)
                labels.append("O" if kind is None else f"{'I' if i else 'B'}-{kind}")

        for _ in range(int(r.integers(0, 5))):
            put(word(), None)
        if k % 2:
            kind, text = pii()
            if r.random() < 0.25:
                put({"phone": pick("tel", "call", "phone:"), "email": pick("email", "mail:"), "card": pick("card", "visa"), "ip": pick("ip", "host")}[kind], None)
            put(text + pick("", "", ".", ","), kind)
        else:
            put(other() + pick("", "", ".", ","), None)
        for _ in range(int(r.integers(0, 5))):
            put(word(), None)
        if not words:
            put(word(), None)
        table.append((words, labels))
    return table


def learn(table: list[tuple[list[str], list[str]]] | None = None, seed: int = 0) -> Chain:
    """The tagger, from a labelled table."""
    table = training_table() if table is None else table
    sizes = np.array([len(w) for w, _ in table])
    flat = np.array([f for w, _ in table for f in window_features(w)])
    gold = np.array([LABELS.index(x) for _, own in table for x in own])
    index, live = padded(sizes)
    chain = Chain(1 << BITS, len(LABELS))
    # an I- label only goes on with its own kind
    chain.fit(flat[index], gold[index] * live, live, epochs=30, rate=0.4, decay=2e-3, size=128, seed=seed)
    for k, kind in enumerate(LABELS):
        if kind[0] == "I":
            own = {k, LABELS.index(f"B-{kind[2:]}")}
            chain.step[[j for j in range(len(LABELS)) if j not in own], k] = -1e3
            chain.begin[k] = -1e3
    return chain


def valid(kind: str, text: str) -> bool:
    """Whether a decoded span can be what its label says."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and not re.search(r"[^0-9 -]", text) and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15 and not re.search(r"[^0-9 ().+/-]", text)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) in (4, 5) and not re.search(r"[^0-9.:\[\] ]", text) and all(len(x) <= 3 and int(x) <= 255 for x in parts[:4])
    return spelled_address(text)


_SPELLED_AT = re.compile(r"@|[\[({<]at[\])}>]|(?<=\s)at(?=\s)", re.I)
_SPELLED_DOT = re.compile(r"\.|[\[({<]dot[\])}>]|(?<=\s)dot(?=\s)", re.I)
_LOCAL_PART, _LABEL = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]+")


def spelled_address(text: str) -> bool:
    """A local part, one at-sign or its spelling, and labels with a dot or its spelling between them.

    The text is cut at separators first, so the time is linear in its length.  "at" between spaces counts only
    if a dot is spelled out too.
    """
    parts = _SPELLED_AT.split(text)
    if len(parts) != 2:
        return False
    labels = [x.strip() for x in _SPELLED_DOT.split(parts[1])]
    if len(labels) < 2 or not _LOCAL_PART.fullmatch(parts[0].strip()) or not all(_LABEL.fullmatch(x) for x in labels):
        return False
    return "@" in text or bool(re.search(r"[\[({<]at|\bdot\b", text, re.I))


class Taken:
    """The patterns' spans of a text by start, with the furthest end up to each: whether a span meets one takes a bisection."""

    def __init__(self, base: dict[str, list[tuple[int, int]]]):
        spans = sorted(s for own in base.values() for s in own)
        self.starts = [s for s, _ in spans]
        self.ends = list(accumulate((e for _, e in spans), max))

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


class Tagger:
    def __init__(self, chain: Chain):
        self.chain = chain

    def windows(self, text: str) -> Iterator[list[tuple[int, int]]]:
        """Word spans around triggers; windows that touch are one."""
        last = -1
        own: list[tuple[int, int]] = []
        for m in _TRIGGER.finditer(text):
            if m.start() < last:
                continue
            spans = around(text, m.start())
            if own and spans[0][0] <= own[-1][1] + 1:
                own += [s for s in spans if s[0] > own[-1][0]]
            else:
                if own:
                    yield own
                own = spans
            last = next(e for s, e in spans if s <= m.start() < e)
        if own:
            yield own

    def spans(self, texts: list[str], base: list[dict[str, list[tuple[int, int]]]]) -> list[list[tuple[str, int, int]]]:
        """Spans that the patterns have not, of each text."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        chains, flat, taken = [], [], {}
        for k, text in enumerate(texts):
            for own in self.windows(text):
                chains.append((k, own))
                flat += window_features([text[s:e] for s, e in own])
        if not chains:
            return out
        sizes = np.array([len(own) for _, own in chains])
        emit = self.chain.emissions(np.array(flat))
        starts = np.cumsum(sizes) - sizes
        for rows in by_size(sizes):
            _, live = padded(sizes[rows])
            index = np.where(live, starts[rows][:, None] + np.arange(live.shape[1]), starts[rows][:, None])
            best = self.chain.viterbi(emit[index], live)
            for row, labels in zip(rows.tolist(), best):
                if labels.any():
                    k, own = chains[row]
                    if k not in taken:
                        taken[k] = Taken(base[k])
                    out[k] += self.decoded(texts[k], own, labels[: len(own)].tolist(), taken[k])
        return [sorted(x, key=lambda s: s[1]) for x in out]

    @staticmethod
    def decoded(text: str, own: list[tuple[int, int]], labels: list[int], taken: Taken) -> list[tuple[str, int, int]]:
        out, k = [], 0
        while k < len(own):
            if not labels[k]:
                k += 1
                continue
            kind, first = LABELS[labels[k]][2:], k
            k += 1
            while k < len(own) and labels[k] and LABELS[labels[k]] == f"I-{kind}":
                k += 1
            start, end = own[first][0], own[k - 1][1]
            while end > start and text[end - 1] in ".,;:!?\"'":
                end -= 1
            while start < end and text[start] in "\"'":
                start += 1
            if valid(kind, text[start:end]) and not taken.meets(start, end):
                out.append((kind, start, end))
        return out


_SPACE = frozenset(" \t\n\r\x0b\x0c")


def around(text: str, at: int) -> list[tuple[int, int]]:
    """Spans of the word at ``at`` and of ``REACH`` words on either side."""
    n = len(text)
    start = end = at
    while start and text[start - 1] not in _SPACE:
        start -= 1
    while end < n and text[end] not in _SPACE:
        end += 1
    left, i = [], start
    while len(left) < REACH:
        while i and text[i - 1] in _SPACE:
            i -= 1
        if not i:
            break
        e = i
        while i and text[i - 1] not in _SPACE:
            i -= 1
        left.append((i, e))
    right, i = [], end
    while len(right) < REACH and (m := _WORD.search(text, i)):
        right.append(m.span())
        i = m.end()
    return [*reversed(left), (start, end), *right]


SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_spans", pa.int64())])
COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def found(texts: list[str | None], tagger: Tagger) -> tuple[list[dict], list[list[tuple[str, int, int]]]]:
    whole = [t or "" for t in texts]
    base = [base_spans(t) for t in whole]
    return base, tagger.spans(whole, base)


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def span_batches(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    tagger = Tagger(chain)
    for b in batches:
        for lo, hi in blocks(b.column(1)):
            part = b.slice(lo, hi - lo)
            base, added = found(part.column(1).to_pylist(), tagger)
            every = [{k: sorted([*x[k], *((s, e) for kind, s, e in more if kind == k)]) for k in KINDS} for x, more in zip(base, added)]
            counts = [np.array([len(x[k]) for x in base], np.int64) for k in KINDS]
            yield batch(SCHEMA, part.column(0), *counts, [sha256(joined(x).encode()).hexdigest() for x in base], [joined(x) for x in every], np.array([len(x) for x in added], np.int64), np.array([sum(map(len, x.values())) for x in every], np.int64))


def find_pii(documents: DataFrame, chain: Chain | None = None) -> DataFrame:
    """Counts of the patterns' spans, their digest, all spans (kind:start:end) and their number of every whole text; no shuffle."""
    rows = need(documents, doc_id="long", text="string")
    return rows.mapInArrow(on_workers(__name__, "span_batches", learn() if chain is None else chain), COLUMNS)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact_batches(batches: Iterator[pa.RecordBatch], chain: Chain, column: int) -> Iterator[pa.RecordBatch]:
    tagger = Tagger(chain)
    for b in batches:
        for lo, hi in blocks(b.column(column)):
            part = b.slice(lo, hi - lo)
            texts = part.column(column).to_pylist()
            base, added = found(texts, tagger)
            new = [redact(t, [*((k, s, e) for k in KINDS for s, e in x[k]), *more]) for t, x, more in zip(texts, base, added)]
            yield part.set_column(column, b.schema.field(column).name, pa.array(new, pa.string()))


def redact_documents(documents: DataFrame, chain: Chain | None = None) -> DataFrame:
    """``documents`` with each span of its text replaced by its kind, as ``<EMAIL>``; all rows and columns stay."""
    chain = learn() if chain is None else chain
    return documents.mapInArrow(on_workers(__name__, "redact_batches", chain, documents.columns.index("text")), documents.schema)
