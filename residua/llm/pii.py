"""Personal data by weak supervision: labelers vote, EM rates them, a classifier decides.

DataFrame functions only; the driver sees counts per vote pattern, of which there are at
most a few thousand however many documents there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column

KINDS = ("email", "ip", "card", "phone")

# A guard in front of each pattern lets a match begin only at the start of its run of
# characters or right after the match before, which finds the same matches as trying every
# place, in time linear in the text. Possessive quantifiers keep Java from recursing.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?"
    r"[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+.])(?:\([0-9]{2,4}\) ?|0[0-9]{1,4}[ ./-])[0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9.])",
}
#: What a text must hold for a kind's patterns to be worth a scan.
NEEDS = {
    "email": r"@|[(\[{]at[)\]}]",
    "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]",
    "card": r"[0-9][\x20._/-]?[0-9]",
    "phone": r"\+[0-9]|[0-9][ )./-]{1,2}[0-9]",
}

# Gazetteers.
TOP_DOMAINS = "com org net edu gov info io co de fr es it uk us eu nl ch at be example"
DIAL_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 61 81 82 86 90 91"
ISSUERS = "4 34 37 51 52 53 54 55 6011 65 35 22 23 24 25 26 27 36 38"
CUES = {
    "email": "mail email e-mail contact write send reply correo courriel kontakt schreiben address",
    "ip": "ip host server address addr from client login node router adresse",
    "card": "card visa mastercard amex credit payment pay karte carte tarjeta",
    "phone": "tel phone call mobile fax telefon teléfono téléphone cell ring whatsapp sms",
}
AGAINST = "version isbn issn section chapter page figure table total sum id serial sku order ticket build"


@dataclass(frozen=True)
class Feature:
    """A vote, or a trait the classifier sees beside the votes: a value of 0 up to ``values``."""

    name: str
    values: int


VOTES = ("form", "gazetteer", "context", "edges")
FEATURES = tuple(Feature(v, 3) for v in VOTES) + (Feature("length", 4),)


def _running(values: Column, first: Column) -> Column:
    """Sums of the values before each one, from ``first`` on. Each step copies the sums so far."""
    begin = F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(values, begin, lambda acc, x: F.struct(
        (acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _starts(lengths: Column) -> Column:
    """Sums of the values before each one. They are summed in as many parts as each has
    values, so n values cost about n * sqrt(n) copies, not n * n."""
    step = F.ceil(F.sqrt(F.size(lengths))).cast("int")
    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int")), lambda k: F.slice(lengths, k * step + 1, step))
    sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
    both = F.arrays_zip(parts.alias("p"), _running(sums, F.lit(0)).alias("at"))
    return F.flatten(F.transform(both, lambda z: _running(z["p"], z["at"])))


def _found(gaps: Column, hits: Column) -> Column:
    """Matches with code point offsets and what stands around each, in one array.

    The text between matches comes from split() with the same pattern, so offsets are sums
    of lengths; nothing is searched twice from the start."""
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
    spans = F.transform(
        F.arrays_zip(
            F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"),
            F.slice(gaps, F.lit(2), F.size(hits)).alias("after"), _starts(lengths).alias("at"),
        ),
        lambda x: F.struct(
            (x["at"] + F.length(x["gap"])).alias("start"),
            (x["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("value"),
            F.right(x["gap"], F.lit(40)).alias("before"), F.left(x["after"], F.lit(8)).alias("after"),
        ),
    )
    return F.when(F.size(hits) > 0, spans).otherwise(F.expr(
        "cast(array() as array<struct<start:int,end:int,value:string,before:string,after:string>>)"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return acc + d

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.ltrim(part, F.lit("0"))
            return (F.length(bare) <= 3) & (F.coalesce(F.expr("0") + F.when(
                F.length(bare).between(1, 3), bare.cast("int")), F.lit(0)) <= 255)

        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _is_valid(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["value"])


def _one_of(words: str) -> str:
    return "|".join(w.replace("-", r"\-") for w in words.split())


def _votes(kind: str, x: Column) -> dict[str, Column]:
    """Each labeler says 2 (personal data), 0 (not), or 1 (abstains)."""
    value, digits = x["value"], _digits(x["value"])
    known = {
        "email": value.rlike(rf"(?i)(?:\.|dot[)\]}}] ?)(?:{_one_of(TOP_DOMAINS)})$"),
        "ip": ~value.rlike(r"^(?:0|127|255|22[4-9]|23[0-9])\."),
        "card": digits.rlike(rf"^(?:{_one_of(ISSUERS)})"),
        "phone": digits.rlike(rf"^(?:00)?(?:0[1-9]|{_one_of(DIAL_CODES)})"),
    }[kind]
    form = {
        "email": value.rlike(r"^[A-Za-z0-9].*[A-Za-z]$"),
        "ip": value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|:"),
        "card": digits.rlike("^[0-9]{13,19}$") & F.when(F.length(digits) < 20, _luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(9, 15),
    }[kind]
    cue = x["before"].rlike(rf"(?i)\b(?:{_one_of(CUES[kind])})\b[^\n]{{0,24}}$")
    not_cue = x["before"].rlike(rf"(?i)\b(?:{_one_of(AGAINST)})\b[^\n]{{0,8}}$")
    glued = x["before"].rlike(r"[\p{L}\p{N}_]$") | x["after"].rlike(r"^[\p{L}\p{N}_]")
    vote = lambda yes, no: F.when(no, 0).when(yes, 2).otherwise(1)
    return {
        "form": vote(form, ~form), "gazetteer": vote(known, ~known),
        "context": vote(cue, not_cue), "edges": vote(~glued, glued),
    }


def _traits(kind: str, x: Column) -> dict[str, Column]:
    n = F.length(x["value"])
    return {**_votes(kind, x), "length": F.when(n < 10, 0).when(n < 16, 1).when(n < 32, 2).otherwise(3)}


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and, per kind, the spans of the base patterns and the loose candidates."""
    text = F.coalesce(column(text_col), F.lit(""))
    out = docs.select(column(id_col).alias("doc_id"), text.alias("text"))
    none = F.expr("cast(array() as array<string>)")
    pieces, columns = [], []
    for kind in KINDS:
        worth = F.col("text").rlike(NEEDS[kind])
        for name, pattern in ((kind, BASE[kind]), (f"{kind}_maybe", LOOSE[kind])):
            pieces.append(F.when(worth, F.split("text", pattern, -1)).otherwise(none).alias(f"{name}_gaps"))
            pieces.append(F.when(worth, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none).alias(f"{name}_hits"))
            found = _found(F.col(f"{name}_gaps"), F.col(f"{name}_hits"))
            columns.append((F.filter(found, _is_valid(kind)) if name == kind else found).alias(name))
    return out.select("doc_id", *pieces).select("doc_id", *columns)


def _candidates(spans: DataFrame) -> DataFrame:
    """All base spans and loose candidates as traits; loose ones that touch a base span go."""
    def traits(kind: str, base: bool) -> Callable[[Column], Column]:
        return lambda x: F.struct(
            F.lit(kind).alias("kind"), F.lit(base).alias("base"),
            x["start"].alias("start"), x["end"].alias("end"),
            *(c.cast("int").alias(n) for n, c in _traits(kind, x).items()),
        )

    def apart(kind: str) -> Callable[[Column], Column]:
        return lambda x: ~F.exists(kind, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    per_kind = []
    for kind in KINDS:
        per_kind.append(F.transform(kind, traits(kind, True)))
        per_kind.append(F.transform(F.filter(f"{kind}_maybe", apart(kind)), traits(kind, False)))
    return spans.select("doc_id", F.concat(*per_kind).alias("found"))


def rate_labelers(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """EM over vote patterns and their counts: the probability of personal data per pattern.

    Each labeler has, for either class, its own rates of the three votes; the start trusts
    every vote a little. Smoothing by one count keeps unseen votes possible.
    """
    post = {p: min(max(0.5 + 0.15 * sum(v - 1 for v in p), 0.05), 0.95) for p in patterns}
    for _ in range(rounds):
        mass = [1.0, 1.0]
        rates = [[[1.0, 1.0, 1.0] for _ in VOTES] for _ in (0, 1)]
        for p, n in patterns.items():
            for c, q in ((1, post[p]), (0, 1 - post[p])):
                mass[c] += n * q
                for j, v in enumerate(p):
                    rates[c][j][v] += n * q
        new = {}
        for p in patterns:
            logs = [
                math.log(mass[c]) + sum(math.log(r[v] / sum(r)) for r, v in zip(rates[c], p))
                for c in (0, 1)
            ]
            new[p] = 1 / (1 + math.exp(min(700.0, max(-700.0, logs[0] - logs[1]))))
        moved = max((abs(new[p] - post[p]) for p in patterns), default=0.0)
        post = new
        if moved < 1e-9:
            break
    return post


def train_classifier(
    rows: list[tuple[tuple[int, ...], int, float]], steps: int = 300, l2: float = 1e-3
) -> dict[tuple[str, int], float]:
    """Logistic weights per feature value, from traits with their counts and soft labels."""
    weights = {("bias", 0): 0.0} | {(f.name, v): 0.0 for f in FEATURES for v in range(f.values)}
    keys = [[("bias", 0), *((f.name, v) for f, v in zip(FEATURES, t))] for t, _, _ in rows]
    total = sum(n for _, n, _ in rows) or 1
    for _ in range(steps):
        slope = {k: l2 * w for k, w in weights.items()}
        for ks, (_, n, y) in zip(keys, rows):
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, sum(weights[k] for k in ks)))))
            for k in ks:
                slope[k] += n / total * (p - y)
        for k in weights:
            weights[k] -= 2.0 * slope[k]
    return weights


def find_personal_data(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = 0.5,
) -> DataFrame:
    """Spans of personal data in each whole text: the base patterns' and the classifier's.

    One pass over the texts writes the candidates, which are few; the rest reads these.
    Candidates are the base patterns' matches and those of looser patterns (obfuscated
    addresses, national phone numbers, cards with other separators, long network addresses).
    Four labelers vote on each: its form, a gazetteer (top domains, dial codes, issuers), the
    words before it (up to 40 characters back to the match before it), and its edges (which
    look at most 8 characters behind it). EM over the counts of vote patterns in all documents
    rates them; the posteriors train a logistic span classifier on votes and length, which
    decides over the loose candidates. Base spans stay whatever it says. Every document is
    handled within its own row: nothing is shuffled but the pattern counts.

    Null text is empty. Repeated rows give repeated results. A null identifier is returned
    as it is. An empty table gives no rows. Other columns are not read.

    Returns doc_id, spans: array of (start, ord, end, kind, base) by start, then kind.
    """
    found = Scratch(spark, "personal-data").keep(_candidates(_spans(docs, id_col, text_col)), "candidates")
    traits = [f.name for f in FEATURES]
    counts = (
        found.select(F.explode("found").alias("x")).select("x.kind", *(f"x.{t}" for t in traits))
        .groupBy("kind", *traits).agg(F.count(F.lit(1)).alias("n")).collect()
    )
    score = F.lit(False)
    weights: dict[str, dict] = {}
    for kind in KINDS:
        mine = [(tuple(r[t] for t in traits), r["n"]) for r in counts if r["kind"] == kind]
        patterns: dict[tuple[int, ...], int] = {}
        for t, n in mine:
            patterns[t[: len(VOTES)]] = patterns.get(t[: len(VOTES)], 0) + n
        post = rate_labelers(patterns)
        weights[kind] = train_classifier([(t, n, post[t[: len(VOTES)]]) for t, n in mine])

    def accepted(x: Column) -> Column:
        by_kind = score
        for kind in KINDS:
            w = weights[kind]
            z = F.lit(float(w["bias", 0]))
            for f in FEATURES:
                z = z + F.element_at(F.array(*(F.lit(float(w[f.name, v])) for v in range(f.values))),
                                     x[f.name] + 1)
            by_kind = F.when(x["kind"] == kind, z > math.log(threshold / (1 - threshold))).otherwise(by_kind)
        return x["base"] | by_kind

    order = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*(F.lit(i) for i in range(len(KINDS)))))
    spans = F.transform(F.filter("found", accepted), lambda x: F.struct(
        x["start"].alias("start"), F.element_at(order, x["kind"]).alias("ord"), x["end"].alias("end"),
        x["kind"].alias("kind"), x["base"].alias("base"),
    ))
    return found.select("doc_id", F.sort_array(spans).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
