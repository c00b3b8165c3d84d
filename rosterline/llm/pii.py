"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds whole spans the patterns miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import columns_as, release_memory

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the base spans (fixed values), with possessive repeats and a left edge where these change no match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ outwards: the local part is the whole run before it that is still free."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1) if at > free else None
        if domain:
            run = at
            while run > free and (text[run - 1] in "._%+-" or text[run - 1].isascii() and text[run - 1].isalnum()):
                run -= 1
            if run < at:
                out.append((run, domain.end()))
                free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each kind that pass its check; failing ones are dropped."""
    found: dict[str, list[Span]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# The field. A region is a stretch of text around a hint; its candidate segments are whole spans of at most
# ENTITY tokens; everything between entities scores 0.

ENTITY = 24
FIELD_KINDS = (*KINDS, "secret")  # the patterns know no secrets; the field does
HINT = re.compile(r"@|[\[(]at[\])]|[0-9](?:[ .()/-]{0,2}[0-9]){6,}|[=:][ \t]{0,3}[\"'`]?[A-Za-z_+/.~-]*+[0-9][A-Za-z0-9_+/.~=-]*+", re.I)
ASSIGNED = re.compile(r"[=:][ \t]{0,3}([\"'`]?)([A-Za-z0-9][A-Za-z0-9_+/.~=-]{6,}+)")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
AT = re.compile(r"@|\s?[\[(]at[\])]\s?", re.I)
DOT = re.compile(r"\.|\s?[\[(]dot[\])]\s?", re.I)
NUMERIC = re.compile(r"[+(]?[0-9](?:[0-9 ().-]*[0-9])?")
DATE = re.compile(r"(?:19|20)[0-9]{2}([-./ ])[01]?[0-9]\1[0-3]?[0-9](?![0-9])")  # no candidate for a telephone number
NAMED = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+\[\]() @-]*[A-Za-z0-9])?")
FEATURES = (
    "bias", "check", "clean_left", "clean_right", "number_left", "number_right", "even_groups", "plain", "spaces", "starts_plus",
    "brackets", "spelled", "top_level", "cue", "length", "quoted", "mixed", "long", "cued_mixed",
)
CUES = {  # words that tend to announce a kind
    "email": ("mail", "contact", "write", "schreib", "correo"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "credit"), "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "secret": ("token", "secret", "passw", "pwd", "key", "credential", "auth", "bearer"),
}


QUOTES = "\"'`"


def _mixed(span: str) -> bool:
    """Letters and digits that take turns, as random characters do and words with a number behind them don't."""
    return len(re.findall("[0-9]+(?=[A-Za-z])|[A-Za-z]+(?=[0-9])", span)) >= 4


@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    kind: int
    features: tuple[float, ...]


def regions(text: str) -> Iterator[Span]:
    """Stretches with a hint, 40 characters wider on both sides; overlapping ones are one."""
    begin, end = None, 0
    for m in HINT.finditer(text):
        if begin is None or m.start() - 40 > end:
            if begin is not None:
                yield begin, min(end, len(text))
            begin = max(0, m.start() - 40)
        end = m.end() + 40
    if begin is not None:
        yield begin, min(end, len(text))


def _features(text: str, start: int, end: int, kind: str, check: bool) -> tuple[float, ...]:
    span, left, right = text[start:end], text[max(0, start - 2) : start], text[end : end + 2]
    groups = re.findall("[0-9]+", span) if kind != "secret" else []
    solid = lambda c: c.isalnum() or c in "_@%"
    before = text[max(0, start - 24) : start].lower()
    cued, mixed = any(c in before for c in CUES[kind]), _mixed(span)
    return (
        1.0, float(check), float(not left or not (solid(left[-1]) or left[-1] in "+.-")), float(not right or not (solid(right[0]) or right[0] == "-" or right[0] == "." and right[1:].isalnum())),
        float(bool(left) and (left[-1].isdigit() or len(left) > 1 and left[-1] in " -." and left[0].isdigit())),
        float(bool(right) and (right[0].isdigit() or len(right) > 1 and right[0] in " -." and right[1].isdigit())),
        float(len(groups) > 1 and len({len(g) for g in groups[:-1]}) == 1), float(len(groups) == 1), float(" " in span), float(span[0] == "+"),
        float("(" in span and span.count("(") == span.count(")")), float("@" not in span), float(kind != "secret" and bool(re.search(r"[.\s\])][A-Za-z]{2,6}$", span))),
        float(cued), min(len(span), 60) / 60,
        float(bool(left) and left[-1] in QUOTES and right[:1] == left[-1]), float(mixed), float(len(span) >= 16), float(mixed and cued),
    )


def secrets(text: str, region: Span) -> list[Segment]:
    """Candidates for secrets: values that something is set to, whole or up to a mark at their end, with a digit."""
    out = []
    for m in ASSIGNED.finditer(text, *region):
        start, end = m.span(2)
        for stop in sorted({end, start + len(m[2].rstrip(".=~/-"))}):
            if stop - start >= 7 and any(c.isdigit() for c in text[start:stop]) and not re.fullmatch(r"[0-9./:+-]+", text[start:stop]):
                out.append(Segment(start, stop, 4, _features(text, start, stop, "secret", True)))
    return out


def taught_secrets(text: str) -> list[Span]:
    """Values the field learns secrets from: set after a cue, 8 characters or more, letters and digits mixed."""
    found = []
    for m in ASSIGNED.finditer(text):
        before = text[max(0, m.start() - 24) : m.start()].lower()
        span = m[2].rstrip(".=~/-")
        if len(span) >= 8 and _mixed(span) and any(c in before for c in CUES["secret"]):
            found.append((m.start(2), m.start(2) + len(span)))
    return found


def _variants(text: str) -> Iterator[tuple[str, set[tuple[int, int, int]]]]:
    """Copies of a text's spans in forms that the patterns miss: text and its (start, end, kind).

    Spelled e-mail addresses ("name (at) host (dot) org"); telephone numbers without +, brackets or country; a number right
    before a card's; secrets without quotes and short ones.
    """
    base = base_spans(text)

    def copy(span: Span, cue: str, form: str, kind: int, more: str = "") -> tuple[str, set[tuple[int, int, int]]]:
        before = text[max(0, span[0] - 60) : span[0]] + cue
        return before + form + more + text[span[1] : span[1] + 60], {(len(before), len(before) + len(form), kind)}

    for span in base["email"][:2]:
        local, domain = text[slice(*span)].split("@")
        for cue in ("", "contact ") if len(local) <= 64 else ():
            yield copy(span, cue, f"{local} (at) {domain.replace('.', ' (dot) ')}", 0)
    for span in base["phone"][:2]:
        whole = text[span[0] + 1 : span[1]]
        bare = re.sub("[()]", "", whole)
        for cue, form in (("Tel.: ", whole), ("phone ", bare), ("call ", bare.split(" ", 1)[-1].strip())):
            if len(_digits(form)) >= 8:
                yield copy(span, cue, form, 3)
        for start, end in base["card"][:1]:
            both, gold = copy(span, "", text[slice(*span)], 3, " " + text[start:end])
            at = max(gold)[1] + 1
            yield both, gold | {(at, at + end - start, 2)}
    for start, end in taught_secrets(text)[:2]:
        before, after = text[max(0, start - 60) : start], text[end : end + 60]
        bare = re.sub(r"[=:]\s*[\"'`]?\Z", ": ", before)
        yield bare + text[start:end] + re.sub(r"\A[\"'`]", " ", after), {(len(bare), len(bare) + end - start, 4)}
        if _mixed(short := text[start : min(end, start + 12)]):
            yield f"password = '{short}' {after[1:]}", {(12, 12 + len(short), 4)}


def segments(text: str, region: Span) -> list[Segment]:
    """Candidates of a region, by end: numeric spans at token edges with a fitting digit count, and named spans with an at sign."""
    lo, hi = region
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, lo, hi)]
    out = []
    for i, (start, _) in enumerate(tokens):
        first = text[start]
        numeric = "0" <= first <= "9" or first in "+("
        named = first.isalnum()
        if not numeric and not named:
            continue
        for j in range(i, min(i + ENTITY, len(tokens))):
            end = tokens[j][1]
            last = text[end - 1]
            if not (last.isascii() and last.isalnum()):
                if not (last in " ().-+[]@_%"):
                    break
                continue
            span = text[start:end]
            if numeric and "0" <= last <= "9":
                if not NUMERIC.fullmatch(span):
                    numeric = False
                else:
                    digits = _digits(span)
                    parts = span.split(".")
                    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
                        out.append(Segment(start, end, 1, _features(text, start, end, "ip", True)))
                    if 16 <= len(digits) <= 19 and not re.search("[+().]", span) and luhn(digits):
                        out.append(Segment(start, end, 2, _features(text, start, end, "card", True)))
                    if 8 <= len(digits) <= 15 and not DATE.match(span):
                        out.append(Segment(start, end, 3, _features(text, start, end, "phone", first == "+")))
            if named and len(AT.findall(span)) == 1:
                local, domain = AT.split(span)
                if " " in local or local == "" or len(local) > 64:
                    break
                if DOT.search(domain):
                    parts = DOT.split(domain)
                    sound = all(re.fullmatch("[A-Za-z0-9-]+", p) for p in parts) and bool(re.fullmatch(r"[A-Za-z0-9._%+-]+", local))
                    out.append(Segment(start, end, 0, _features(text, start, end, "email", sound)))
            if not numeric and not (named and NAMED.fullmatch(span)):
                break
    out += secrets(text, region)
    return sorted(out, key=lambda s: (s.end, s.start, s.kind))


def decode(segs: list[Segment], scores: np.ndarray) -> list[int]:
    """The best set of disjoint candidates: dynamic programming over segment ends, boundaries and kinds together."""
    best: list[tuple[float, int]] = [(0.0, -1)]
    ends = [-1]
    from bisect import bisect_right

    for k, s in enumerate(segs):
        before = bisect_right(ends, s.start) - 1
        value = best[before][0] + scores[k]
        if value > best[-1][0]:
            best.append((value, k))
        else:
            best.append((best[-1][0], -1))
        ends.append(s.end)
    chosen, at = [], len(segs)
    while at > 0:
        k = best[at][1]
        if k < 0:
            at -= 1
        else:
            chosen.append(k)
            at = bisect_right(ends, segs[k].start) - 1
    return chosen[::-1]


def marginals(segs: list[Segment], scores: np.ndarray) -> np.ndarray:
    """Probability of each candidate under the field (forward and backward sums over all segmentations)."""
    from bisect import bisect_left, bisect_right

    n = len(segs)
    ends = [-1] + [s.end for s in segs]
    forward = np.zeros(n + 1)
    inner = np.empty(n)
    for k, s in enumerate(segs):
        inner[k] = forward[bisect_right(ends, s.start, 0, k + 1) - 1] + scores[k]
        forward[k + 1] = np.logaddexp(forward[k], inner[k])
    order = sorted(range(n), key=lambda k: segs[k].start)
    begins = [segs[k].start for k in order]
    backward = np.zeros(n + 1)
    for at in range(n - 1, -1, -1):
        k = order[at]
        backward[at] = np.logaddexp(backward[at + 1], backward[bisect_left(begins, segs[k].end)] + scores[k])
    after = np.array([backward[bisect_left(begins, s.end)] for s in segs])
    return np.exp(inner + after - forward[n])


#: Ordinary values, for the field to learn what is no personal data.
ORDINARY = (
    "width=1920px height: 1080px", "ratio = 0.52871e-4 of", "href=index2024.html", "version: 1.20.3-beta2 of", "key: chapter12 of",
    "commit: 4f8a1c2e9b7d06a35c1e", "?id=9c41e7b20f8d&page=12", "sha1 = '0b7e4c19d2a85f63e1c7'", "file: scan_2023_07_b12.pdf", "at: 10h45m30s", "of 2019-08-27 09:15:00 and", "1998-12-31 to 1999-06-15",
)


def train(texts: list[str], rounds: int = 60, rate: float = 0.1, decay: float = 0.05) -> np.ndarray:
    """Weights by kind and feature: gradient ascent on the likelihood of the texts' base spans and taught secrets, in numpy.

    Copies of spans in forms that the patterns miss are added, so that the field learns whole-span cues.
    """
    items = []

    def learn(text: str, gold_at: set[tuple[int, int, int]], needs_gold: bool) -> None:
        for region in regions(text):
            segs = segments(text, region)
            gold = np.array([float((s.start, s.end, s.kind) in gold_at) for s in segs])
            if segs and (gold.any() or not needs_gold):
                items.append((segs, np.array([s.features for s in segs]), np.array([s.kind for s in segs]), gold))

    for text in ORDINARY if texts else ():
        learn(text, set(), False)
    for text in texts:
        base = base_spans(text)
        known = {(s, e, k) for k, kind in enumerate(KINDS) for s, e in base[kind]}
        learn(text, known | {(s, e, 4) for s, e in taught_secrets(text)}, False)
        for copy, gold in _variants(text):
            learn(copy, gold, True)
    weights = np.zeros((len(FIELD_KINDS), len(FEATURES)))
    weights[:, 0] = -4.0  # without evidence a span is none
    size = np.full_like(weights, 1e-9)  # mean square of late slopes: rare features take as large steps as frequent ones
    for _ in range(rounds if items else 0):
        slope = np.zeros_like(weights)
        for segs, features, kinds, gold in items:
            gap = gold - marginals(segs, (features * weights[kinds]).sum(axis=1))
            np.add.at(slope, kinds, gap[:, None] * features)
        size = 0.8 * size + 0.2 * slope**2
        weights += rate * (slope / np.sqrt(size + 1e-4) - decay * weights)
    return weights


def added_spans(text: str, base: dict[str, list[Span]], weights: np.ndarray, margin: float) -> list[tuple[str, int, int]]:
    """Spans that the field decodes with at least ``margin`` and that touch no base span."""
    taken = sorted(s for spans in base.values() for s in spans)
    free = lambda s, e: all(e <= a or b <= s for a, b in taken)
    out = []
    for region in regions(text):
        if not any(free(*m.span()) for m in HINT.finditer(text, *region)):
            continue  # every hint lies in a base span
        segs = segments(text, region)
        if segs:
            scores = (np.array([s.features for s in segs]) * weights[[s.kind for s in segs]]).sum(axis=1)
            out += [(FIELD_KINDS[segs[k].kind], segs[k].start, segs[k].end) for k in decode(segs, scores)
                    if scores[k] >= margin and free(segs[k].start, segs[k].end)]
    return out


def fit(docs: DataFrame, sample: int = 400, doc_id: str = "doc_id", text: str = "text", longest: int = 20_000) -> np.ndarray:
    """Weights from a bounded sample: of the texts of at most ``longest`` characters that hold a hint, the ``sample`` rows of
    smallest id hash. An empty sample gives a field that adds nothing."""
    rows = columns_as(docs, doc_id=doc_id, text=text).where(F.col("text").rlike("@|[0-9]{3}") & (F.length("text") <= longest))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    # Hashes alone are ordered; texts are fetched once it is known which.
    cut = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if cut is None:
        return train([])
    return train([r.text for r in rows.where(F.col("h") <= cut).dropDuplicates(["h"]).select("h", "text").orderBy("h").collect()])


def find(docs: DataFrame, weights: np.ndarray, text: str = "text", margin: float = 2.0) -> DataFrame:
    """Input rows plus ``pii``: an array of (kind, start, end, base), code points, end exclusive.

    Kinds in their fixed order, then by start; ``base`` is true for pattern spans. Whole texts are searched; a null or empty
    text has none; other columns ride along untouched. Repeated rows each get their own result.
    """
    plain = weights.tolist()

    @F.pandas_udf("array<struct<kind string, start int, end int, base boolean>>")
    def run(texts):
        import pandas as pd

        held, out = np.array(plain), []
        for t in texts:
            rows = []
            if t:
                base = base_spans(t)
                rows = [(KINDS.index(k), s, e, True) for k in KINDS for s, e in base[k]]
                rows += [(FIELD_KINDS.index(k), s, e, False) for k, s, e in added_spans(t, base, held, margin)]
            out.append([{"kind": FIELD_KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in sorted(rows)])
        release_memory()
        return pd.Series(out)

    own = [c for c in docs.columns if c != "pii"]
    return docs.select(*own, run(docs[text]).alias("pii"))


def digest_columns(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``: counts and digest of the base spans, and all spans of
    the patterns' kinds. Besides, ``secrets`` (likewise), ``n_added`` (spans of the field) and ``n_spans`` (of any kind)."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("pii", lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind))
    counts = [of(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col(doc_id), *counts, F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform(F.filter("pii", lambda s: s["kind"] != "secret"), line), ",").alias("spans"),
                        F.array_join(F.transform(F.filter("pii", lambda s: s["kind"] == "secret"), line), ",").alias("secrets"),
                        F.size(F.filter("pii", lambda s: ~s["base"])).cast("long").alias("n_added"), F.size("pii").cast("long").alias("n_spans"))


def masked(docs: DataFrame, weights: np.ndarray, text: str = "text", margin: float = 2.0) -> DataFrame:
    """The documents with every span replaced by ``[kind]``; overlapping spans are one replacement, named by the first."""

    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd

        held, out = np.array(plain), []
        for t in texts:
            if t:
                base = base_spans(t)
                spans = sorted([(s, e, k) for k in KINDS for s, e in base[k]] + [(s, e, k) for k, s, e in added_spans(t, base, held, margin)])
                parts, at = [], 0
                for s, e, k in spans:
                    if s >= at:
                        parts += [t[at:s], f"[{k}]"]
                    at = max(at, e)
                t = "".join([*parts, t[at:]])
            out.append(t)
        release_memory()
        return pd.Series(out, dtype=object)

    plain = weights.tolist()
    return docs.withColumn(text, run(docs[text]))
