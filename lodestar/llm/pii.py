"""Personal data by weak supervision, in DataFrame functions only.

Five kinds: email, ip, card, phone and secret. Base spans, of the first four kinds, are fixed by patterns and checks and
always stay. Further candidates are what the base patterns find but their checks reject, addresses written with (at),
local phone numbers, and long unbroken strings such as keys and tokens. On every candidate five labelers vote 1, -1 or
0: its form (pattern), its check (arithmetic and lengths), gazetteers of top-level domains, card issuers, calling codes
and key formats, its look (how it is grouped), and the words before it. Expectation-maximisation over the counts of vote
patterns, a table of bounded size, estimates how reliable each labeler is for each kind, and a logistic classifier
trained on the posteriors alone decides on the candidates that are not base spans.

Patterns are rewritten from the contract's so that no input makes them backtrack or recurse without bound; the matches
are the same. Offsets come from running sums in blocks, so that many matches in one text cost little more each. Offsets
are code points, ends exclusive. Defined results: null text is empty; rows that repeat a doc_id are scanned one by one; a null
doc_id is carried; very long texts are scanned whole, as one value of a column; no
candidates at all leave the classifier at its prior. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import stash

KINDS = ("email", "ip", "card", "phone", "secret")

#: Gazetteers.
TLDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "nl", "uk", "eu", "us", "ch", "at", "be", "pl", "br", "ca", "au", "in", "jp", "cn", "ru", "biz", "example", "test")
CONTEXT = {
    "email": r"(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)",
    "ip": r"(?:\bip\b|host|server|address|addr|login|client|network|from)",
    "card": r"(?:card|visa|master|amex|credit|debit|pay|karte|tarjeta|carte)",
    "phone": r"(?:phone|tel|call|mobile|fax|cell|whatsapp|telefon|llame)",
    "secret": r"(?:token|secret|passw(?:or)?d|passwd|api.?key|apikey|access.?key|private.?key|bearer|authorization|credential|clave|schl[uü]ssel)",
}
AGAINST = {
    "email": r"(?:git|ssh|package|version)\W*$",
    "ip": r"(?:version|release|section|chapter|\bv)\W*$",
    "card": r"(?:isbn|order|invoice|serial|tracking|number of|ticket)\W*$",
    "phone": r"(?:isbn|order|invoice|serial|version|page|pages)\W*$",
    "secret": r"(?:sha-?[0-9]*|md5|commit|checksum|digest|hash|etag|uuid|revision|integrity|fingerprint)\W*$",
}

_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole chains of digits, one space or hyphen at most between two, of 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
MORE = {
    # neither the tail of an address with @ nor the head of one
    "email": rf"(?<![{_LOCAL}@])[{_LOCAL}]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]++)++(?![{_LOCAL}]*+@)",
    # what a base pattern would take is taken whole, and left out afterwards
    "phone": r"\+[0-9][ ().0-9-]+[0-9]|(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
    # letters and digits, unbroken
    "secret": r"(?<![A-Za-z0-9+/_=.@-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9.@])",
}
#: What a text must hold for a pattern to be tried.
GATE = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
GATE_MORE = {
    "email": lambda t: t.rlike(r"[\[(]at[\])]"),
    "phone": lambda t: t.rlike(r"[0-9][ .-][0-9]{3}"),
    "secret": lambda t: t.rlike(r"[A-Za-z0-9+/_-]{20}"),
}
VOTES = ("form", "check", "list", "look", "words")
_DIGITS = r"[^0-9]"


_BLOCK = 256


def _running(steps: Column) -> Column:
    """The sum of all earlier numbers at each place of an array, by sums of blocks and sums within them."""

    def sums(numbers: Column, start: Column) -> Column:
        zero = F.struct(start.alias("t"), F.array().cast("array<int>").alias("o"))
        add = lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["o"], F.array(s["t"])).alias("o"))
        return F.aggregate(numbers, zero, add, lambda s: s["o"])

    last = F.floor((F.greatest(F.size(steps), F.lit(1)) - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(steps, k * _BLOCK + 1, _BLOCK))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, sums(totals, F.lit(0)), sums))


def _located(df: DataFrame, name: str, pattern: str, gate: Column) -> DataFrame:
    """Adds ``name``: array of (m, start, end, before), the matches of a pattern with code-point offsets."""
    empty = F.array().cast("array<string>")
    df = df.withColumn("__m", F.when(gate, F.regexp_extract_all("__t", F.lit(pattern), F.lit(0))).otherwise(empty))
    df = df.withColumn("__s", F.when(F.size("__m") > 0, F.slice(F.split("__t", pattern, -1), 1, F.size("__m"))).otherwise(empty))
    df = df.withColumn("__n", F.zip_with("__s", "__m", lambda s, m: F.length(s) + F.length(m))).withColumn("__p", _running(F.col("__n")))
    pairs = F.zip_with("__s", "__m", lambda s, m: F.struct(s.alias("s"), m.alias("m")))

    def place(x: Column, before: Column) -> Column:
        start = before + F.length(x["s"])
        return F.struct(x["m"].alias("m"), start.alias("start"), (start + F.length(x["m"])).alias("end"), F.lower(F.substring(x["s"], -30, 30)).alias("before"))

    return df.withColumn(name, F.zip_with(pairs, "__p", place)).drop("__m", "__s", "__n", "__p")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, _DIGITS, "")


def valid(kind: str, m: Column) -> Column:
    """The check of a base span."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)))
    n = F.length(_digits(m))
    return ((n >= 13) & (n <= 19) & F.call_function("luhn_check", _digits(m))) if kind == "card" else ((n >= 9) & (n <= 15))


def _votes(kind: str, m: Column, before: Column, form: bool) -> dict[str, Column]:
    yes = lambda c: F.when(c, 1).otherwise(-1)
    d, look = _digits(m), F.lit(0)
    if kind == "email":
        check, known = yes(F.length(m) <= 254), yes(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(*TLDS))
        look = yes(m.rlike(r"^[A-Za-z0-9]") & ~m.rlike(r"\.\."))
    elif kind == "ip":
        check, known = yes(~m.rlike(r"(?:^|\.)0[0-9]")), F.when(m.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."), 1).otherwise(0)
        look = F.when(m.rlike(r"[0-9]{4}"), -1).otherwise(0)
    elif kind == "card":
        check, known = yes(F.call_function("luhn_check", d)), yes(d.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"))
        look = yes(m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$") & ~m.rlike(r"^([0-9])\1+$"))
    elif kind == "phone":
        n = F.length(d)
        check, known = yes((n >= 9) & (n <= 15)), F.when(m.rlike(r"^(?:\+(?:1|33|34|44|49|39|31|41|43|7|81|86|91)|\(?0[1-9])"), 1).otherwise(0)
        look = F.when(m.rlike(r"^\("), 1).when(m.rlike(r"\.") & m.rlike(r"[ -]"), -1).otherwise(0)
    else:
        letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
        check, known = yes((F.length(d) >= 4) & (letters >= 4)), F.when(m.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk[-_]|pk_|eyJ|glpat-|AIza)"), 1).otherwise(0)
        look = F.when(m.rlike("/.*/") | m.rlike("-.*-.*-.*-") | m.rlike(r"^(.)\1+$"), -1).when(before.rlike(r"[=:]\s*[\"']?$"), 1).otherwise(0)
    words = F.when(before.rlike(AGAINST[kind]), -1).when(before.rlike(CONTEXT[kind]), 1).otherwise(0)
    return {"form": F.lit(1 if form else 0), "check": check, "list": known, "look": look, "words": words}


def _candidate(kind: str, form: bool):
    def make(x: Column) -> Column:
        v = _votes(kind, x["m"], x["before"], form)
        base = valid(kind, x["m"]) if form else F.lit(False)
        size = F.least(F.lit(3), F.floor(F.length(x["m"]) / 8)).cast("int")
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), base.alias("base"), *(v[n].cast("int").alias(n) for n in VOTES), size.alias("size"))

    return make


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, c)``: of each document, the candidates of all kinds as one array."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    t, parts = F.col("__t"), []
    for kind in BASE:
        df = _located(df, f"__{kind}", BASE[kind], GATE[kind](t))
        parts.append(F.transform(f"__{kind}", _candidate(kind, True)))
    for kind in MORE:
        df = _located(df, f"__more_{kind}", MORE[kind], GATE_MORE[kind](t))
        parts.append(F.transform(F.filter(f"__more_{kind}", lambda x: ~x["m"].startswith("+")), _candidate(kind, False)))
    return df.select("doc_id", F.concat(*parts).alias("c"))


def estimate(rows: list, rounds: int = 60) -> tuple[dict, dict]:
    """Labeler reliabilities and classifier weights from the counts of vote patterns.

    ``rows``: (kind, a vote for each of VOTES, size, n). Expectation-maximisation of a two-class model with independent
    labelers, then logistic regression on the posteriors by gradient steps. All sums run over the patterns.
    """
    reliable, weights = {}, {}
    for k, kind in enumerate(KINDS):
        own = sorted((tuple(r[1:-2]), r[-2], r[-1]) for r in rows if r[0] == k)
        total = sum(n for _, _, n in own)
        rates = {c: [{v: 1 / 3 + (0.3 if v * c > 0 else -0.2 if v * c < 0 else -0.1) for v in (-1, 0, 1)} for _ in VOTES] for c in (1, -1)}
        prior = 0.5
        post = [0.5] * len(own)
        for _ in range(rounds if total else 0):
            for i, (votes, _, _) in enumerate(own):
                p = math.log(prior) + sum(math.log(rates[1][j][v]) for j, v in enumerate(votes))
                q = math.log(1 - prior) + sum(math.log(rates[-1][j][v]) for j, v in enumerate(votes))
                post[i] = 1 / (1 + math.exp(min(700, q - p)))
            mass = {1: sum(p * n for p, (_, _, n) in zip(post, own, strict=True))}
            mass[-1] = total - mass[1]
            prior = min(0.99, max(0.01, (mass[1] + 1) / (total + 2)))
            for c in (1, -1):
                for j in range(len(VOTES)):
                    for v in (-1, 0, 1):
                        got = sum((p if c > 0 else 1 - p) * n for p, (votes, _, n) in zip(post, own, strict=True) if votes[j] == v)
                        # pseudo-counts keep a labeler's votes on the side of the class it votes for
                        rates[c][j][v] = (got + (6 if v * c > 0 else 1 if v * c < 0 else 3)) / (mass[c] + 10)
        reliable[kind] = {name: rates[1][j][1] / (rates[1][j][1] + rates[-1][j][1]) for j, name in enumerate(VOTES)}
        w = [0.0] * (len(VOTES) + 2)
        x = [[*votes, size / 3.0, 1.0] for votes, size, _ in own]
        for _ in range(400 if total else 0):
            grad = [0.0] * len(w)
            for f, p, (_, _, n) in zip(x, post, own, strict=True):
                e = (1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, f, strict=True)))))) - p) * n / total
                grad = [g + e * b for g, b in zip(grad, f, strict=True)]
            w = [a - 0.8 * (g + 0.001 * a) for a, g in zip(w, grad, strict=True)]
        weights[kind] = w
    return reliable, weights


def _accepts(weights: dict, threshold: float):
    odds = math.log(threshold / (1 - threshold))

    def test(c: Column) -> Column:
        ok = c["base"]
        for k, kind in enumerate(KINDS):
            w = weights[kind]
            z = F.lit(w[-1]) + F.lit(w[-2] / 3.0) * c["size"]
            for a, name in zip(w, VOTES, strict=False):
                z = z + F.lit(a) * c[name]
            ok = ok | ((c["kind"] == k) & (z >= F.lit(odds)))
        return ok

    return test


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, base, spans)``: arrays of (kind, start, end), kind an index of KINDS."""
    found = stash(candidates(docs), "pii")
    counts = found.select(F.explode("c").alias("c")).groupBy("c.kind", *(f"c.{v}" for v in VOTES), "c.size").agg(F.count("*").alias("n"))
    rows = [tuple(r) for r in counts.collect()]  # at most kinds x 3^5 votes x 4 sizes
    _, weights = estimate(rows)
    accept = _accepts(weights, threshold)
    bare = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("c", lambda c: c["base"]), bare))
    spans = F.array_sort(F.transform(F.filter("c", accept), bare))
    return found.select("doc_id", base.alias("base"), spans.alias("spans"))


def span_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans)``.

    The first four counts and the hash are of base spans; ``n_spans`` counts all spans.
    """
    out = find_pii(docs)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    secret = F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index("secret"))).cast("long")
    counts = (n(KINDS.index(kind)).alias(f"n_{kind}") for kind in BASE)
    return out.select("doc_id", *counts, F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), secret.alias("n_secret"), F.size("spans").cast("long").alias("n_spans"))
