"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Candidates are the base spans (exact rules), base patterns that fail their kind's test, and look-alikes: masked,
spaced and undotted mail addresses, masked and IPv6 addresses, short and dotted card numbers, phone numbers without
a plus. Five labelers vote for, against or abstain, each from a source of its own: the strict rule, the shape, a
gazetteer (host endings, address blocks, card issuers, calling codes), the words around, the characters at the
borders. Expectation-maximisation on the counts of vote patterns estimates the labelers' reliabilities per kind; its
posteriors then train a naive-Bayes span classifier, summed over all candidates in Spark. The classifier sees hashed
features of the span and its neighbours, no votes. Base spans always stay; look-alikes are added where the classifier
is sure; what failed its kind's test trains the models and is never added. A candidate that touches a base span, or an earlier candidate of its kind, is not looked at.

Edge cases: a null or empty text has no spans; repeated rows get equal results; an empty table gives an
empty table; positions are code points, end exclusive; an input column ``found`` is replaced.
"""

from __future__ import annotations

import ipaddress
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.plans.stage import stage

KINDS = ("email", "ip", "card", "phone")
LABELERS = 5
FEATURES = 512
"""Hash buckets of span features per kind; bounds the classifier."""
PRIOR = ((4.0, 2.0, 1.0), (1.0, 2.0, 4.0))
"""Prior counts of votes against, none and for: on what is no personal data, and on what is."""

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_L, _H = r"A-Za-z0-9._%+-", r"[A-Za-z0-9-]{1,63}+"
_MASKED_EMAIL = re.compile(rf"(?<![{_L}])[{_L}]{{1,64}}+\x20?(?:\(at\)|\[at\])\x20?{_H}(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?{_H})+")
_SPOKEN_EMAIL = re.compile(rf"(?<![{_L}])[{_L}]{{1,64}}+\x20at\x20{_H}(?:\x20dot\x20{_H})+")
_SPACED_EMAIL = re.compile(rf"(?<![{_L}])[{_L}]{{1,64}}+\x20@\x20{_H}(?:\.{_H})+")
_BARE_EMAIL = re.compile(rf"(?<![{_L}])[{_L}]{{1,64}}+@{_H}(?!\.?[A-Za-z0-9@-])")
_HEX = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{3,39}+(?![0-9A-Za-z:])")
_MASKED_IP = re.compile(r"(?<![0-9.\]])[0-9]{1,3}+(?:\x20?(?:\[\.\]|\(\.\)|\[dot\])\x20?[0-9]{1,3}+){3}(?![0-9])")
_DOTTED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.-])")
_FAR_PHONE = re.compile(r"(?<![0-9+.-])00[1-9](?:[\x20().-]{0,2}[0-9]){6,13}(?![0-9])")
_TRUNK_PHONE = re.compile(r"(?<![0-9/])0[0-9]{2,4}/[0-9]{5,8}(?![0-9/])")
_HAS_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_AT = re.compile(r"\x20?(?:@|\(at\)|\[at\]|(?<=\x20)at(?=\x20))\x20?")
_DOT = re.compile(r"\x20?(?:\.|\(dot\)|\[dot\]|(?<=\x20)dot(?=\x20))\x20?")

# Words that stand near personal data, and near what only looks like it.
CUES = {
    "email": ("mail", "email", "contact", "correo", "courriel", "write", "reach", "address", "inbox", "reply", "kontakt"),
    "ip": ("ip", "address", "host", "server", "adresse", "client", "login", "ping", "peer", "gateway", "dns", "from"),
    "card": ("card", "visa", "mastercard", "amex", "carte", "karte", "tarjeta", "credit", "debit", "payment", "pay", "paid"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "telefono", "fono", "dial", "ring", "cell", "anruf", "hotline"),
}
AGAINST = {
    "email": ("function", "class", "variable", "import", "decorator", "handle", "user", "revision", "meet", "price"),
    "ip": ("version", "release", "section", "chapter", "build", "clause", "paragraph", "firmware", "namespace", "method", "time"),
    "card": ("order", "isbn", "tracking", "invoice", "serial", "part", "barcode", "parcel", "account", "ticket", "dated"),
    "phone": ("order", "isbn", "invoice", "serial", "part", "item", "ticket", "ratio", "score", "catalogue", "page", "line"),
}
# Endings of host names, reserved endings, calling codes of one, two and (first two digits) three digits.
HOST_ENDINGS = frozenset(
    "com org net edu gov mil int io info biz name pro app dev ai co me tv cloud online site eu "
    "ar at au be bg br ca ch cl cn cz de dk ee es fi fr gr hk hr hu ie il in ir is it jp kr lt lu lv mx my nl no nz pe ph pl pt ro rs ru "
    "sa se sg si sk th tr tw ua uk us ve vn za".split()
)
RESERVED_ENDINGS = frozenset(("example", "invalid", "test", "localhost", "local", "internal"))
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
LONG_CODES = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 80 85 87 88 96 97 99".split())
# Card issuers as first digits (from, to) and the lengths they use.
ISSUERS = (
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 19)),
    ("644", "649", (16, 19)), ("65", "65", (16, 19)), ("3528", "3589", (16, 17, 18, 19)), ("62", "62", (16, 17, 18, 19)), ("36", "36", (14,)), ("300", "305", (14,)),
)
_UNICAST = tuple(ipaddress.ip_network(x) for x in ("2000::/3", "fc00::/7", "fe80::/10"))


def luhn(digits: str) -> bool:
    """Whether a digit string passes the check-digit rule."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, ``@`` and dotted host, in linear time: hosts first, then back."""
    free = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            free = m.end()
            yield start, free


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def matches(text: str) -> list[tuple[int, int, int, int]]:
    """``(kind, start, end, standing)``: standing 1 for base spans, -1 for base patterns that fail the
    kind's test, 0 for look-alikes that touch no other span."""
    out = []
    if "@" in text:
        out += [(0, s, e, 1) for s, e in _emails(text)]
    if _HAS_DIGIT.search(text):
        if "." in text:
            out += [(1, *m.span(), 1 if all(map(_small, m[0].split("."))) else -1) for m in _IP.finditer(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = _digits(m[0])
                if 13 <= len(d) <= 19:
                    out.append((2, *m.span(), (1 if len(d) >= 16 else 0) if luhn(d) else -1))
        if "+" in text:
            out += [(3, *m.span(), 1 if 8 <= len(_digits(m[0])) <= 15 else -1) for m in _PHONE.finditer(text)]
    base = [x for x in out if x[3] == 1]
    weak = [x for x in out if x[3] < 1] + _lookalikes(text)
    if not weak:
        return base
    taken = sorted((s, e) for _, s, e, _ in base)
    starts = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))
    behind = [0] * len(KINDS)
    for kind, start, end, standing in sorted(weak, key=lambda x: (x[1], -x[2], x[0])):
        before = bisect_left(starts, end)
        if start >= behind[kind] and (before == 0 or reach[before - 1] <= start):
            behind[kind] = end
            base.append((kind, start, end, standing))
    return base


def _lookalikes(text: str) -> list[tuple[int, int, int, int]]:
    """What may be personal data but matches no base pattern, with standing 0."""
    found = []

    def add(kind: int, pattern: re.Pattern) -> None:
        found.extend((kind, *m.span(), 0) for m in pattern.finditer(text))

    if "(at)" in text or "[at]" in text:
        add(0, _MASKED_EMAIL)
    if " dot " in text:
        add(0, _SPOKEN_EMAIL)
    if "@" in text:
        add(0, _BARE_EMAIL)
        if " @ " in text:
            add(0, _SPACED_EMAIL)
    if ":" in text:
        found += [(1, *m.span(), 0) for m in _HEX.finditer(text) if m[0].count(":") > 1 and _v6(m[0]) is not None]
    if _HAS_DIGIT.search(text):
        if "[.]" in text or "(.)" in text or "[dot]" in text:
            add(1, _MASKED_IP)
        found += [(2, *m.span(), 0) for m in _DOTTED_CARD.finditer(text) if luhn(_digits(m[0]))]
        for pattern in (_LOCAL_PHONE, _FAR_PHONE, _TRUNK_PHONE):
            add(3, pattern)
    return found


def _v6(s: str) -> ipaddress.IPv6Address | None:
    try:
        return ipaddress.IPv6Address(s)
    except ValueError:
        return None


def _side(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else c


def _email_votes(span: str) -> tuple[int, int]:
    labels = [x for x in _DOT.split(_AT.split(span)[-1]) if x]
    ending = labels[-1].lower()
    shape = 1 if len(labels) > 1 and ending.isalpha() and 2 <= len(ending) <= 24 else -1
    return shape, 1 if len(labels) > 1 and ending in HOST_ENDINGS else -1 if ending in RESERVED_ENDINGS else 0


def _ip_votes(span: str) -> tuple[int, int]:
    if ":" in span:
        address = _v6(span)
        groups = [g for g in span.split(":") if g]
        known = address is not None and any(address in block for block in _UNICAST)
        return 1 if len(groups) > 2 and _HAS_DIGIT.search(span) else -1, 1 if known else -1
    parts = re.findall("[0-9]+", span)
    shape = 1 if all(len(p) == 1 or len(p) <= 3 and p[0] != "0" for p in parts) else -1
    a, b = (int(p[-4:]) for p in parts[:2])
    if a == 0 or a > 223 or not all(map(_small, parts)):
        return shape, -1
    private = a in (10, 127) or (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b <= 31 or a == 100 and 64 <= b <= 127
    return shape, 1 if private else 0


def _card_votes(span: str, digits: str) -> tuple[int, int]:
    groups = [len(g) for g in re.split("[^0-9]", span)]
    even = all(g == 4 for g in groups[:-1]) and groups[-1] <= 4
    shape = 1 if len(groups) == 1 or even or groups == [4, 6, 5] or groups == [4, 6, 4] else -1
    return shape, 1 if any(low <= digits[: len(low)] <= high and len(digits) in sizes for low, high, sizes in ISSUERS) else -1


def _phone_votes(span: str, digits: str) -> tuple[int, int]:
    shape = 1 if len({c for c in span if c in ".-/"}) < 2 and span.count("(") == span.count(")") and 8 <= len(digits) <= 15 else -1
    if span[0] == "+" or digits.startswith("00"):
        code = digits[2:] if span[0] != "+" else digits
        return shape, 1 if code[:1] in CODES or code[:2] in CODES or code[:2] in LONG_CODES else -1
    if "/" in span:
        return shape, 0
    return shape, 1 if digits[0] > "1" and digits[3] > "1" else -1


def votes(text: str, kind: int, start: int, end: int, standing: int) -> tuple[list[int], list[str]]:
    """The labelers' votes (-1, 0 or 1) on one span, and its features for the classifier, which hold no vote."""
    name, span = KINDS[kind], text[start:end]
    digits = _digits(span)
    left, right = text[start - 1 : start], text[end : end + 1]
    before = _WORD.findall(text[max(0, start - 48) : start].lower())[:-4:-1]
    after = _WORD.findall(text[end : end + 24].lower())[:1]
    if name == "email":
        shape, listed = _email_votes(span)
    elif name == "ip":
        shape, listed = _ip_votes(span)
    else:
        shape, listed = (_card_votes if name == "card" else _phone_votes)(span, digits)
    context = next((1 if w in CUES[name] else -1 for w in before if w in CUES[name] or w in AGAINST[name]), 0)
    apart = -1 if (left.isalnum() or right.isalnum()) else 1
    form = re.sub("9+", "9", re.sub("[^\\W\\d_]+", "a", re.sub("[0-9]", "9", span[:80])))[:24]
    features = [
        f"length {min(len(span), 40) // 3}", f"digits {min(len(digits), 20)}", f"form {form}", f"left {_side(left)}", f"right {_side(right)}",
        f"lead {digits[:2]}", f"end {span[-3:].lower()}", *[f"before {w}" for w in before[:2]], *[f"after {w}" for w in after],
    ]
    return [standing, shape, listed, context, apart], features


_SPAN = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
        T.StructField("base", T.BooleanType()),
        T.StructField("failed", T.BooleanType()),
        T.StructField("pattern", T.IntegerType()),
        T.StructField("features", T.ArrayType(T.IntegerType())),
    ]
)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__candidates``: every span worth a vote."""

    @F.pandas_udf(T.ArrayType(_SPAN))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = []
            for t in texts:
                row = []
                for kind, s, e, standing in matches(t):
                    v, f = votes(t, kind, s, e, standing)
                    pattern = sum((x + 1) * 3**i for i, x in enumerate(v))
                    hashed = sorted({zlib.crc32(x.encode()) % FEATURES for x in f})
                    row.append({"kind": kind, "start": s, "stop": e, "base": standing == 1, "failed": standing == -1, "pattern": pattern, "features": hashed})
                found.append(row)
            yield pd.Series(found, dtype=object)

    return docs.withColumn("__candidates", find(F.coalesce(F.col(text), F.lit(""))))


def reliabilities(patterns: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """EM over vote-pattern counts of one kind: the posterior of each pattern.

    The starting point trusts the votes. Prior counts say that a labeler is more often right than wrong, which keeps
    the two classes in their places and every probability inside (0, 1).
    """
    if not patterns:
        return {}
    keys, n = np.array(sorted(patterns)), np.array([patterns[k] for k in sorted(patterns)], dtype=float)
    v = keys[:, None] // 3 ** np.arange(LABELERS) % 3
    p = 1 / (1 + np.exp(-1.5 * (v - 1).sum(axis=1)))
    for _ in range(rounds):
        like = np.zeros((2, len(keys)))
        for c, w in enumerate((n * (1 - p), n * p)):
            like[c] = np.log((w.sum() + 1) / (n.sum() + 2))
            for j in range(LABELERS):
                seen = np.bincount(v[:, j], weights=w, minlength=3) + PRIOR[c]
                like[c] += np.log(seen / seen.sum())[v[:, j]]
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return dict(zip(keys.tolist(), p.tolist()))


def find_personal_data(docs: DataFrame, text: str = "text", sure: float = 0.95) -> DataFrame:
    """``docs`` (without ``text``) with ``found``: array of ``(kind, start, stop, base)``, by kind and start.

    The candidates are written once in the shared folder. What reaches the driver is the counts of vote
    patterns (at most 4 x 3^5) and of features (at most 4 x ``FEATURES``).
    """
    spans = stage(candidates(docs, text).drop(text), "pii")
    each = spans.select(F.explode("__candidates").alias("c")).select("c.*")
    patterns: dict[int, dict[int, int]] = {}
    for r in each.groupBy("kind", "pattern").count().collect():
        patterns.setdefault(r["kind"], {})[r["pattern"]] = r["count"]
    posterior = {k * 1000 + pat: p for k, found in patterns.items() for pat, p in reliabilities(found).items()}
    score: dict[int, float] = {}
    bias = {k: 0.0 for k in range(len(KINDS))}
    if posterior:
        lookup = F.create_map(*[F.lit(x) for item in sorted(posterior.items()) for x in item])
        labelled = each.withColumn("p", lookup[F.col("kind") * 1000 + F.col("pattern")])
        sums = [F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")]
        total = {r["kind"]: (r["yes"], r["no"]) for r in labelled.groupBy("kind").agg(*sums).collect()}
        bias |= {k: float(np.log((yes + 1) / (no + 1))) for k, (yes, no) in total.items()}
        for r in labelled.withColumn("f", F.explode("features")).groupBy("kind", "f").agg(*sums).collect():
            yes, no = total[r["kind"]]
            odds = np.log((r["yes"] + 1) / (yes + 2)) - np.log((r["no"] + 1) / (no + 2))
            score[r["kind"] * FEATURES + r["f"]] = float(odds)
    weight = F.create_map(*[F.lit(x) for k, v in sorted(score.items()) for x in (k, v)]) if score else F.create_map(F.lit(-99), F.lit(0.0))
    start = F.create_map(*[F.lit(x) for k, v in bias.items() for x in (k, v)])
    threshold = float(np.log(sure / (1 - sure)))

    def keep(c):
        odds = F.aggregate(
            c["features"], start[c["kind"]], lambda total, f: total + F.coalesce(weight[c["kind"] * FEATURES + f], F.lit(0.0))
        )
        return c["base"] | (~c["failed"] & (odds >= threshold))

    slim = F.transform(
        F.filter("__candidates", keep),
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), c["base"].alias("base")),
    )
    return spans.withColumn("found", F.array_sort(slim)).drop("__candidates")


def span_list(found, base_only: bool = False):
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    rows = F.filter(found, lambda c: c["base"]) if base_only else found
    return F.array_join(
        F.transform(rows, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["stop"].cast("string"))), ","
    )
