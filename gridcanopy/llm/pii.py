"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, materialize

KINDS = ("email", "ip", "card", "phone")
# The patterns that define base spans.  Possessive and anchored forms of the same
# languages, so that no text takes quadratic time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Candidates beyond the base: obfuscated addresses, numbers without a plus sign, international prefixes.
HIDDEN_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]+(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]+)+", re.I)
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:00[0-9]{1,3}[\x20-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
INNER_PHONE = re.compile(r"\+[0-9]{1,3}[\x20-]?\(?[0-9]{2,4}\)?[\x20-][0-9]{3,4}[\x20-][0-9]{4}(?![0-9])")
# Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl ru cn jp br in eu us ca au ch se no".split())
COUNTRY_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "30", "2")
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write|reach|correo|courriel|@", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login|adresse", re.I),
    "card": re.compile(r"card|visa|credit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|anruf|appel", re.I),
}
AGAINST = re.compile(r"version|\bv\.?$|isbn|order|invoice|serial|sha|hash|build|section", re.I)
REACH = 40
LABELERS = 6


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches by kind and start, leftmost and non-overlapping within a kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        # the local part is the longest run before the sign that the last match left
        begin = at
        while begin > end and (text[begin - 1] in "._%+-" or text[begin - 1].isascii() and text[begin - 1].isalnum()):
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not re.search("[0-9]", text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def further_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates beside the base spans: none overlaps a base span of its kind."""
    out = []
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        out += [("email", m.start(), m.end()) for m in HIDDEN_EMAIL.finditer(text)]
    if re.search("[0-9]", text):
        for m in CARD.finditer(text):  # a run that fails as a whole may join several numbers
            d = _digits(m.group())
            if len(d) > 19 or len(d) >= 13 and not luhn(d):
                groups = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer("[0-9]+", m.group())]
                k = 0
                while k < len(groups):
                    n, step = 0, 0
                    for j in range(k, len(groups)):
                        n += groups[j][1] - groups[j][0]
                        if n > 19:
                            break
                        if n >= 13 and luhn(_digits(text[groups[k][0] : groups[j][1]])):
                            out.append(("card", groups[k][0], groups[j][1]))
                            step = j - k + 1
                            break
                    k += max(1, step)
        for m in PHONE.finditer(text):
            if len(_digits(m.group())) > 15 and (inner := INNER_PHONE.match(text, m.start())):
                out.append(("phone", inner.start(), inner.end()))
        out += [("phone", m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
    taken = {k: Spans() for k in KINDS}
    for kind, a, z in base:
        taken[kind].add(a, z)
    kept = []
    for kind, a, z in sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2])):
        if taken[kind].add(a, z):
            kept.append((kind, a, z))
    return kept


def votes(kind: str, text: str, start: int, end: int, is_base: bool) -> str:
    """One letter a labeler: y(es), n(o) or - (abstains)."""
    s, before = text[start:end], text[max(0, start - REACH) : start]
    d = _digits(s)
    after = text[end : end + 1]
    if kind == "email":
        valid = "y" if ".." not in s and not s.startswith(".") else "n"
        known = "y" if s.rsplit(".", 1)[-1].lower() in TOP_DOMAINS else "-"
    elif kind == "ip":
        valid = "y" if not s.startswith("0") else "n"
        known = "y" if s.startswith(("10.", "192.168.", "127.")) else "-"
    elif kind == "card":
        valid = "y" if luhn(d) else "n"
        known = "y" if d.startswith(ISSUERS) else "-"
    else:
        valid = "y" if 10 <= len(d) <= 15 else "n"
        known = "y" if s.startswith("+") and d.startswith(COUNTRY_CODES) else "-"
    return "".join(
        (
            "y" if is_base else "-",
            valid,
            known,
            "y" if CONTEXT[kind].search(before) else "-",
            "n" if AGAINST.search(before) else "-",
            "n" if (before[-1:].isalnum() and kind != "email") or after.isalnum() else "y",
        )
    )


def shape(kind: str, text: str, start: int, end: int) -> str:
    """Length class, kinds of separators and share of digits, for the classifier alone."""
    s = text[start:end]
    seps = "".join(c for c in " -.(+@[" if c in s)
    return f"{min(end - start, 40) // 4}:{seps}:{4 * len(_digits(s)) // max(1, len(s))}"


def expectation_maximisation(patterns: list[tuple[str, int]], rounds: int = 50) -> tuple[dict[str, float], list[dict]]:
    """Posterior of each vote pattern, and each labeler's vote distribution by class, from counts.

    Labelers are independent given the class; one pseudo-count a vote and class, on top of the start:
    a pattern counts as right with the share of yes among its votes.
    """
    n = np.array([c for _, c in patterns], float)
    share = np.array([(1 + p.count("y")) / (2 + p.count("y") + 2 * p.count("n")) for p, _ in patterns])
    post = np.clip(share, 0.02, 0.98)
    reliab: list[dict] = []
    for _ in range(rounds):
        prior = ((post * n).sum() + 1) / (n.sum() + 2)
        reliab = []
        log_odds = np.full(len(patterns), math.log(prior / (1 - prior)))
        for k in range(LABELERS):
            table = {}
            for v in "yn-":
                is_v = np.array([p[k] == v for p, _ in patterns])
                yes = ((post * n)[is_v].sum() + 1) / ((post * n).sum() + 3)
                no = (((1 - post) * n)[is_v].sum() + 1) / (((1 - post) * n).sum() + 3)
                # a vote for a class is never evidence against it
                if v == "y":
                    no = min(no, yes)
                elif v == "n":
                    yes = min(yes, no)
                table[v] = (yes, no)
                log_odds[is_v] += math.log(yes / no)
            reliab.append(table)
        new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return {p: float(x) for (p, _), x in zip(patterns, post)}, reliab


def _names(pattern: str) -> list[str]:
    vote, form = pattern.split("|", 1)
    size, seps, share = form.split(":")
    return [f"{k}{v}" for k, v in enumerate(vote)] + [f"size{size}", f"share{share}"] + [f"has{c}" for c in seps]


def classifier(patterns: list[tuple[str, int]], soft: dict[str, float], steps: int = 300, l2: float = 1.0) -> dict[str, float]:
    """Logistic regression on votes and shape, fitted to the posteriors; the score of each pattern."""
    names = sorted({f for p, _ in patterns for f in _names(p)})
    col = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(patterns), len(names) + 1))
    x[:, -1] = 1
    for r, (p, _) in enumerate(patterns):
        for f in _names(p):
            x[r, col[f]] = 1
    n = np.array([c for _, c in patterns], float)
    y = np.array([soft[p.split("|", 1)[0]] for p, _ in patterns])
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton steps with a penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + l2 * w
        h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {p: float(s) for (p, _), s in zip(patterns, score)}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans array<struct<kind, start, end, base, pattern>>)``: whole texts, one row per row."""
    idt = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                both = [(s, True) for s in base] + [(s, False) for s in further_spans(text, base)]
                rows.append(
                    [
                        {"kind": k, "start": a, "end": z, "base": is_base, "pattern": f"{votes(k, text, a, z, is_base)}|{shape(k, text, a, z)}"}
                        for (k, a, z), is_base in both
                    ]
                )
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(item))], names=["id", "spans"])

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {idt}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean,pattern:string>>")


def learn(found: DataFrame) -> dict[str, dict[str, float]]:
    """Per kind the score of each pattern.  Only counts of patterns, of which there are few, are collected."""
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.pattern").count().collect()
    out = {}
    for kind in KINDS:
        rows = sorted((r["pattern"], r["count"]) for r in counts if r["kind"] == kind)
        if not rows:
            continue
        by_votes: dict[str, int] = {}
        for p, c in rows:
            v = p.split("|", 1)[0]
            by_votes[v] = by_votes.get(v, 0) + c
        soft, _ = expectation_maximisation(sorted(by_votes.items()))
        out[kind] = classifier(rows, soft)
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` for each row.

    Counts and digest are of the base spans, which always stay; ``spans`` also holds the candidates
    that the classifier scores at ``least`` or more.  A null text is empty and has no spans.  Each row, one
    that repeats another too, is judged by its own text, and no other column is read; of overlapping spans of
    a kind a base one stays, then the leftmost, then the shortest.
    """
    found = materialize(candidates(docs, id_col, text_col))
    held = docs.sparkSession.sparkContext.broadcast(learn(found))
    idt = docs.schema[id_col].dataType.simpleString()

    def joined(spans: list[dict]) -> str:
        order = sorted(spans, key=lambda s: (KINDS.index(s["kind"]), s["start"]))
        return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for spans in b.column(1).to_pylist():
                base = [s for s in spans if s["base"]]
                added = [s for s in spans if not s["base"] and held.value[s["kind"]][s["pattern"]] >= least]
                n = [sum(s["kind"] == k for s in base) for k in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    schema = f"id {idt}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return found.mapInArrow(run, schema)
