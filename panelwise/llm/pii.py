"""Personal data by weak supervision, with DataFrame functions only.

Base spans come from four patterns and their checks. Other candidates come from broad patterns;
labelers that look at their shape, at gazetteers and at the words before them vote yes, no or
nothing. Votes are counted by pattern (a fixed number of patterns, whatever the input), expectation
maximisation estimates how far each labeler is to be trusted and how likely each pattern is a real
span, and a logistic span classifier is trained on those estimates. Accepted candidates that do not
overlap a base span are added to it.

Positions are code points: a text's parts between the matches of a pattern and the matches
themselves give the start of each match as a running sum of lengths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import written

KINDS = ("email", "ip", "card", "phone", "secret", "number", "name")
BASE_KINDS = KINDS[:4]

# The four base patterns. Possessive quantifiers and look-behinds only save steps: none changes a
# match (a run that fails from its first character fails from the others too).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

CANDIDATES = "|".join((
    r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]{0,64}[0-9])[A-Za-z0-9_+/-]{20,}+",
    r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{2,64}\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{2,10}",
    r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra|Sr)\b\.?\x20\p{Lu}\p{L}{1,30}",
    r"(?<![0-9])[0-9][0-9()\x20./-]{5,40}[0-9]",
))
#: Code points before a candidate that labelers see.
CONTEXT = 40

#: Gazetteers and cues, lower case.
OWNERS = ("token", "key", "apikey", "secret", "password", "passwd", "bearer", "account", "konto", "compte", "cuenta", "iban", "ssn", "passport", "phone", "tel", "telefon", "mobile", "fax", "call", "card", "visa", "mail", "email", "contact")
OTHERS = ("page", "chapter", "version", "figure", "section", "year", "isbn", "issn", "doi", "volume", "table", "line", "commit", "seite", "kapitel", "chapitre")
GIVEN = ("anna", "maria", "john", "james", "mary", "peter", "paul", "laura", "marie", "jean", "hans", "jose", "carlos", "sofia", "david", "sarah", "michael", "thomas", "julia", "emma")

LABELERS = ("shape", "gazetteer", "cue", "mixture", "digits", "filler")


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def placed(text: Column, pattern: str, matches: Column) -> Column:
    """``array<struct<start, end, value, before>>`` of the matches of a pattern in a text."""
    parts = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), _empty("array<struct<start:int,end:int,value:string,before:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["part"])
        end = begin + F.length(x["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"), F.right(x["part"], F.lit(CONTEXT)).alias("before"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    both = F.zip_with(F.slice(parts, F.lit(1), F.size(matches)), matches, lambda p, v: F.struct(p.alias("part"), v.alias("value")))
    return F.when(F.size(matches) > 0, F.aggregate(both, start, step)["out"]).otherwise(_empty("array<struct<start:int,end:int,value:string,before:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            n = F.regexp_replace(part, "^0+", "")
            return (F.length(n) <= 3) & (F.coalesce(n.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _good(kind: str, spans: Column) -> Column:
    good = F.filter(spans, lambda s: valid(kind, s["value"]))
    return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "y").when(no, "n").otherwise("o")


def votes(value: Column, before: Column, kind: Column) -> Column:
    """One letter for each of LABELERS: y, n or o for no vote."""
    digits = F.length(_digits(value))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    last = F.lower(F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*$", 1))
    given = F.lower(F.regexp_extract(value, r"(\p{L}+)$", 1))
    shape = _vote(value.rlike(r"^(?:[0-9a-f]{32,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})$") | value.rlike(r"[(\[]at[)\]]"),
                  value.rlike(r"^(?:[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}|[0-9]+[./][0-9]+|[0-9]{1,3}(?:[ .][0-9]{3})+)$"))
    gazetteer = _vote(last.isin(*OWNERS) | ((kind == "name") & given.isin(*GIVEN)), last.isin(*OTHERS))
    cue = _vote(before.rlike(r"[:=][\x20]*[\"'(]?$"), before.rlike(r"[$€£#§/][\x20]*$"))
    mixture = _vote((digits >= 4) & (letters >= 4), (digits == 0) & (kind != "name"))
    size = _vote((kind == "number") & digits.between(7, 15), (kind == "number") & ~digits.between(7, 19))
    filler = _vote(kind == "name", value.rlike(r"^(.)\1+$") | value.rlike("^[A-Za-z]+$") & (kind != "name"))
    return F.concat(shape, gazetteer, cue, mixture, size, filler)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, base, more``: base spans by kind and start, and candidate spans with their votes."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = _empty("array<string>")
    digit = F.col("text").rlike("[0-9]")
    may = {"email": F.contains("text", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("text", F.lit("+"))}
    text = text.withColumns({f"f_{k}": F.when(may[k], found(F.col("text"), p)).otherwise(none) for k, p in BASE.items()}
                            | {"f_more": found(F.col("text"), CANDIDATES)})
    spans = []
    for kind, pattern in BASE.items():
        spans.append(_good(kind, placed(F.col("text"), pattern, F.col(f"f_{kind}"))))
    text = text.withColumns({"base": F.concat(*spans), "_more": placed(F.col("text"), CANDIDATES, F.col("f_more"))})
    free = F.filter("_more", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))

    def described(c: Column) -> Column:
        value = c["value"]
        kind = F.when(value.rlike(r"[(\[]at[)\]]"), "email").when(value.rlike(r"^(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra|Sr)\b"), "name").when(value.rlike("^[0-9() ./-]+$"), "number").otherwise("secret")
        return F.struct(kind.alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.concat(kind, F.lit(":"), votes(value, c["before"], kind)).alias("pattern"))

    return text.select("doc_id", "base", F.transform(free, described).alias("more"))


def estimate(counts: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Expectation maximisation over vote patterns: how likely each is a real span.

    Labelers vote independently given the class; their tables start at mild trust and are smoothed.
    """
    prior = 0.5
    tables = [{True: {"y": 0.6, "o": 0.3, "n": 0.1}, False: {"y": 0.1, "o": 0.4, "n": 0.5}} for _ in LABELERS]
    posterior: dict[str, float] = {}
    for _ in range(rounds):
        for p in counts:
            odds = [prior, 1 - prior]
            for t, v in zip(tables, p.split(":")[1], strict=True):
                odds = [odds[0] * t[True][v], odds[1] * t[False][v]]
            posterior[p] = odds[0] / sum(odds)
        total = sum(counts.values())
        mass = sum(n * posterior[p] for p, n in counts.items())
        prior = min(max((mass + 1) / (total + 2), 0.05), 0.95)
        for k, t in enumerate(tables):
            for real in (True, False):
                seen = {v: 2.0 * (0.6 if v == ("y" if real else "n") else 0.2) for v in "yon"}
                for p, n in counts.items():
                    seen[p.split(":")[1][k]] += n * (posterior[p] if real else 1 - posterior[p])
                t[real] = {v: x / sum(seen.values()) for v, x in seen.items()}
    return posterior


def _features(pattern: str) -> list[str]:
    kind, said = pattern.split(":")
    return ["one", f"kind {kind}"] + [f"{name} {v}" for name, v in zip(LABELERS, said, strict=True) if v != "o"]


def train(counts: dict[str, int], posterior: dict[str, float], steps: int = 400) -> dict[str, float]:
    """Weights of the logistic span classifier: gradient steps on the patterns, weighted by the
    logarithm of their counts so that frequent patterns do not drown the others."""
    weights: dict[str, float] = {}
    rows = [(_features(p), posterior[p], math.log1p(n)) for p, n in counts.items()]
    total = sum(r[2] for r in rows) or 1.0
    for _ in range(steps):
        slope: dict[str, float] = {}
        for names, y, n in rows:
            z = sum(weights.get(x, 0.0) for x in names)
            error = n * (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) / total
            for x in names:
                slope[x] = slope.get(x, 0.0) + error
        for x, g in slope.items():
            weights[x] = weights.get(x, 0.0) * 0.999 + 2.0 * g
    return weights


def accepted(pattern: Column, weights: dict[str, float]) -> Column:
    """The classifier as a Column: the summed weights of a candidate's features are above 0."""
    kind, said = F.split_part(pattern, F.lit(":"), F.lit(1)), F.split_part(pattern, F.lit(":"), F.lit(2))
    z = F.lit(weights.get("one", 0.0))
    for k in KINDS:
        if f"kind {k}" in weights:
            z = z + F.when(kind == k, weights[f"kind {k}"]).otherwise(0.0)
    for i, name in enumerate(LABELERS):
        vote = F.substr(said, F.lit(i + 1), F.lit(1))
        z = z + F.when(vote == "y", weights.get(f"{name} y", 0.0)).when(vote == "n", weights.get(f"{name} n", 0.0)).otherwise(0.0)
    return z > 0


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, base, spans``, arrays of
    ``struct<kind, start, end>`` in the order of KINDS, then start.

    Null text is empty. Base spans are always in ``spans``; added ones never overlap them. Without
    candidates nothing is added. Other columns are ignored; an empty table gives no rows. Reruns on
    the same rows agree: votes are counted, so neither partitions nor order matter.
    """
    table = written(candidates(docs), "spans")
    seen = table.select(F.explode("more.pattern").alias("p")).groupBy("p").count().orderBy("p").collect()
    counts = {r["p"]: r["count"] for r in seen}
    weights = train(counts, estimate(counts)) if counts else {}
    added = F.transform(F.filter("more", lambda c: accepted(c["pattern"], weights)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    both = F.concat("base", added)
    by_kind = [F.array_sort(of_kind(both, k)) for k in KINDS]
    return table.select("doc_id", "base", F.concat(*by_kind).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
