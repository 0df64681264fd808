"""Personal data: patterns, and a character BiLSTM-CRF that adds what the patterns miss.

The patterns give email, ip, card and phone spans that always stand. The tagger (:mod:`tagger`) is trained in numpy on
labelled spans: those of the patterns in windows of a bounded sample of documents, and groups of spans that people also write, set
into windows of the same texts: national numbers, cards and phone numbers beside other numbers (which a pattern takes together
and drops), addresses of version 6, and numbers that are nothing personal. It reads every whole text in overlapping windows; what
its runs hold of the shape of their kind, and touches no pattern span, is added.

The sample is ``SAMPLE`` documents by a hash of their ids; of each, windows around all its pattern spans and one from anywhere,
and of all these ``WINDOWS`` by a hash of their text. Nothing else is bounded.

Defined results: null and empty texts have no spans; rows are independent, so that ties, repeats, extra columns of any name and empty
tables need no care (an empty table trains on the written spans alone); a very long text is only more windows.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, texts_of, to_batch
from .tagger import KINDS, Tagger, symbols, tag

#: Documents, and windows of them, that the tagger is trained on, at most.
SAMPLE, WINDOWS, WINDOW = 1500, 3000, 160

# The patterns. Starts are found first, so that a text is passed once.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(map(int, reversed(digits))):
        total += d if place % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Pattern spans of a text by kind, in the order of KINDS."""
    number = _HAS_NUMBER.search(text)
    return [emails(text), ips(text) if number else [], cards(text) if number else [], phones(text) if "+" in text else []]


_HAS_NUMBER = re.compile("[0-9]")


# ---- training ----------------------------------------------------------------------------------------------------


def with_check_digit(digits: str) -> str:
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def written(draw: np.random.Generator) -> tuple[str, int]:
    """A span of personal data as people also write it, and its kind."""
    n = lambda k: "".join(str(d) for d in draw.integers(0, 10, k))
    word = lambda: "".join(chr(97 + c) for c in draw.integers(0, 26, draw.integers(2, 9)))
    pick = lambda some: some[draw.integers(0, len(some))]
    kind = int(draw.choice(4, p=[0.15, 0.15, 0.35, 0.35])) + 1
    if kind == 1:
        local = pick([word(), f"{word()}.{word()}", f"{word()}{n(2)}", n(3), f"{word().title()}_{word()}"])
        return f"{local}@{word()}{n(1) if draw.random() < 0.4 else ''}.{pick(['com', 'org', 'example.com', 'net', 'de'])}", 1
    if kind == 2:
        if draw.random() < 0.6:
            return ".".join(str(x) for x in draw.integers(0, 256, 4)), 2
        groups = [f"{x:x}" for x in draw.integers(0, 1 << 16, 8)]
        return pick([":".join(groups), f"{groups[0]}:{groups[1]}::{groups[2]}", f"fe80::{groups[0]}:{groups[1]}:{groups[2]}:{groups[3]}"]), 2
    if kind == 3:
        digits, gap = with_check_digit(str(draw.integers(2, 7)) + n(14)), pick(["", "", " ", "-"])
        return gap.join(digits[k : k + 4] for k in range(0, 16, 4)), 3
    a, b, c = str(draw.integers(2, 10)) + n(2), str(draw.integers(2, 10)) + n(2), n(4)
    lead = pick(["", "", f"+{draw.integers(1, 100)} ", "+1 ", "+1-", "1-"])
    return lead + pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}){b} {c}", f"({a}) {b} {c}"]), 4


def harmless(draw: np.random.Generator) -> str:
    """Numbers that are nothing personal."""
    n = lambda k: "".join(str(d) for d in draw.integers(0, 10, k))
    low, year = draw.integers(1, 29, 4), draw.integers(1900, 2040)
    forms = [n(draw.integers(1, 9)), n(draw.integers(20, 33)), f"{low[0]}.{low[1]}", f"{year}-{low[0] % 12 + 1:02}-{low[1]:02}", f"{low[0]:02}/{low[1]:02}/{year}", f"v{low[0]}.{low[1]}.{low[2]}", f"{low[0] % 24:02}:{n(2)}:{n(2)}", f"{n(1)},{n(3)},{n(3)}.{n(2)}"]
    forms += [", ".join(n(2) for _ in range(low[0] % 6 + 2)), " ".join(n(3) for _ in range(low[1] % 6 + 2)), f"{low[0]}.{low[1]}.{low[2]}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"({n(3)})", f"{n(3)}-{n(2)}", f"{year}-{year + low[0]}", f"{n(2)}:{n(2)}", f"@{chr(97 + low[0] % 26)}{chr(97 + low[1] % 26)}", f"{n(3)}.{n(3)}"]
    return forms[draw.integers(0, len(forms))]


def group(draw: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """Some written spans and harmless numbers side by side, and the spans."""
    text, spans = "", []
    for k in range(int(draw.choice([1, 2, 3], p=[0.5, 0.35, 0.15]))):
        text += [" ", " ", ", "][draw.integers(0, 3)] if k else ""
        if draw.random() < 0.65:
            new, kind = written(draw)
            spans.append((len(text), len(text) + len(new), kind))
        else:
            new = harmless(draw)
        text += new
    return text + ["", "", "", ".", ","][draw.integers(0, 5)], spans


def sequences(windows: list[str], seed: int = 3, least: int = 2400) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labelled symbol sequences: each window with its pattern spans, and windows with groups of written spans set in."""
    draw, texts = np.random.default_rng(seed), []
    plain = windows or ["the word of a text and more of it, so that there is some. "]
    for k in range(max(len(plain), least)):
        text = plain[k % len(plain)]
        spans = [(a, b, kind) for kind, own in enumerate(base_spans(text), 1) for a, b in own]
        if k < len(plain):
            texts.append((text, spans))
        blank = [m.end() for m in re.finditer(r"\s", text) if not any(a < m.end() < b for a, b, _ in spans)] or [0]
        at = blank[draw.integers(0, len(blank))]
        new, own = group(draw)
        moved = [(a + (len(new) + 1) * (a >= at), b + (len(new) + 1) * (a >= at), c) for a, b, c in spans]
        texts.append((text[:at] + new + " " + text[at:], moved + [(at + a, at + b, kind) for a, b, kind in own]))
    out = []
    for text, spans in texts:
        kinds, first, _ = symbols([text])
        labels = np.zeros(len(kinds), np.uint8)
        for a, b, kind in spans:
            own = np.flatnonzero((first >= a) & (first < b))
            labels[own] = 2 * kind
            labels[own[:1]] = 2 * kind - 1
        out.append((kinds, labels))
    return out


def train(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> Tagger:
    ids = materialize(docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "pii-sample")
    schema = pa.schema([("window", pa.string())])

    def work(batches):
        for part in chunks(batches, column=0):
            out = []
            for text in texts_of(part.column(0)).to_pylist():
                spans = [s for own in base_spans(text) for s in own]
                anywhere = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(text) - WINDOW)
                out += [text[max(0, a - WINDOW // 2) : a + WINDOW // 2] for a, _ in spans] + [text[anywhere : anywhere + WINDOW]]
            yield to_batch(schema, out)

    some = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(work, "window string")  # SAMPLE ids at most
    rows = some.where("window <> ''").distinct().orderBy(F.xxhash64("window"), "window").limit(windows).collect()
    model = Tagger()
    model.fit(sequences([r["window"] for r in rows]))
    return model


# ---- the operator ------------------------------------------------------------------------------------------------


# Shapes in which cards and phone numbers are written.
_CARD_SHAPE = re.compile(r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![\w-])")
_PHONE_SHAPE = re.compile(r"(?<![\w.+-])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])")
_WORD_SHAPE = re.compile(r"[^\s,;()<>\[\]\"']+")


def acceptable(text: str, start: int, end: int, kind: int) -> list[tuple[int, int]]:
    """What can be of its kind inside a run; the run is widened to whole words first, and a word that goes on is none."""
    while start and text[start - 1] not in " \t\n\r":
        start -= 1
    while end < len(text) and text[end] not in " \t\n\r":
        end += 1
    shape = (_WORD_SHAPE, _WORD_SHAPE, _CARD_SHAPE, _PHONE_SHAPE)[kind - 1]
    out = []
    for m in shape.finditer(text, start, end):
        a, b = m.span()
        while shape is _WORD_SHAPE and b > a and text[b - 1] in ".:!?":
            b -= 1
        inner = text[a:b]
        if kind == 1:
            good = 0 < inner.find("@") < len(inner) - 3 and "." in inner.rpartition("@")[2]
        elif kind == 2:
            good = is_address(inner)
        elif kind == 3:
            good = luhn(_digits(inner))
        else:
            good = 9 <= len(_digits(inner)) <= 15
        if good:
            out.append((a, b))
    return out


def is_address(word: str) -> bool:
    if word.count(":") < 3 and word.count(".") != 3 or len(word) > 39:
        return False
    try:
        ipaddress.ip_address(word)
    except ValueError:
        return False
    return True


def find_spans(model: Tagger, texts: list[str]) -> list[tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]]:
    """(pattern spans, added spans) by kind, of each text. Added ones touch neither a pattern's nor each other."""
    found = [(base_spans(t), [[] for _ in KINDS]) for t in texts]
    for k, start, end, kind in tag(model, texts):
        base, added = found[k]
        for a, b in acceptable(texts[k], start, end, kind):
            if not any(x < b and a < y for own in (*base, *added) for x, y in own):
                added[kind - 1].append((a, b))
    return found


def listed(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans) for a, b in own)


FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """doc_id, pattern counts by kind, digest of pattern spans, all spans, number of added ones."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, **options))

    def work(batches):
        model = held.value
        for part in chunks(batches, max_bytes=2 << 20):
            rows = []
            for base, added in find_spans(model, texts_of(part.column(1)).to_pylist()):
                both = [sorted(a + b) for a, b in zip(base, added)]
                rows.append([*map(len, base), hashlib.sha256(listed(base).encode()).hexdigest(), listed(both), sum(map(len, added))])
            yield to_batch(FOUND, part.column(0), *map(list, zip(*rows)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """The text with <KIND> in place of each span; spans that overlap give one, named after the first."""
    flat = sorted((a, -b, kind) for kind, own in zip(KINDS, spans) for a, b in own)
    out, at = [], 0
    for a, b, kind in flat:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, **options) -> DataFrame:
    """The documents with personal data masked; n_chars, where there is one, follows the text."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, **options))

    @F.arrow_udf("string")
    def mask(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        for column in columns:
            out = []
            for part in chunks([pa.record_batch([column], names=["text"])], column=0, max_bytes=2 << 20):
                texts = part.column(0).to_pylist()
                for text, (base, added) in zip(texts, find_spans(model, [t or "" for t in texts])):
                    out.append(None if text is None else masked(text, [sorted(a + b) for a, b in zip(base, added)]))
            yield pa.array(out, pa.string())

    out = docs.withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

