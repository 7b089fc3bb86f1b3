"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans come from regular expressions: four base kinds, whose valid matches always stay, and wider
kinds (e-mail addresses spelled out, local phone numbers, national numbers, bank accounts, secrets, persons, addresses).
Five labelers vote on each candidate: the strict form, a gazetteer of endings, prefixes, countries, names and streets,
key words before it, words before it that
speak against it, and the characters around it. The votes of the whole corpus are counted by pattern; expectation
maximisation over the patterns estimates how reliable each labeler is without any labels, and a logistic span
classifier is trained on the resulting probabilities. It decides which wider candidates become spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

LOCAL = r"[A-Za-z0-9._%+-]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Possessive forms of the base patterns: the same leftmost matches, in time linear in the text.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Frequent given names, country codes of bank accounts.
GIVEN_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Maria Peter Paul Daniel Mark George Kevin Laura Emma "
    "Hans Klaus Jürgen Wolfgang Ursula Petra Sabine Pierre Jean Marie Claude Sophie Camille José Juan Carlos Luis Carmen Pilar Lucía Ahmed Mohammed Fatima Wei Yuki Ivan Olga"
).split()
IBAN_COUNTRIES = "AD AE AL AT BA BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR UA".split()
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora|Señor"
WIDE = {
    "email_spelled": r"(?i)\b[a-z0-9][a-z0-9._-]{1,40}(?:\x20?[\[(]at[\])]\x20?)[a-z0-9][a-z0-9-]{0,40}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[a-z0-9-]{2,40})+",
    "phone_local": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "secret": r"(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?[a-z0-9+/_.~-]{8,}+[\"']?",
    "person": rf"\b(?:(?:{TITLES})\.?\x20(?:[A-Z]\p{{Ll}}{{1,20}}\x20)?|(?:{'|'.join(GIVEN_NAMES)})\x20)[A-Z]\p{{Ll}}{{1,20}}\b",
    "address": r"\b[0-9]{1,5}\x20(?:[A-Z][a-z]{1,20}\x20){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square)\b",
}
#: What a text must contain to be searched at all: a cheap test before the pattern, which implies it. One character, or a pattern.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "email_spelled": r"(?i)[\[(]at[\])]", "phone_local": r"[.-][0-9]{4}", "national_id": "-", "iban": r"[A-Z]{2}[0-9]{2}", "secret": r"(?i)key|secret|token|passw|pwd", "person": r"[A-Z]\p{Ll}+\.? [A-Z]\p{Ll}", "address": r"[0-9] [A-Z]"}
KINDS = [*BASE, *WIDE]
KEYWORDS = r"(?i)(?:name|iban|account|bank|lives|street|signed|author|config|auth|e-?mail|mail|contact|phone|tel|telephone|call|fax|mobile|card|visa|credit|ssn|social security|id number|address|ip)\W{0,3}(?:\w{1,6}\W{1,3})?$"
AGAINST = r"(?i)(?:version|order|invoice|ref|isbn|build|part|serial|revision|rfc|section)\W{0,3}(?:no\W{0,2})?$"
ENDINGS = r"(?i)[. )\]](?:com|org|net|edu|gov|io|info|de|fr|es|uk)$"
SPANS_PER_PART = 128
LABELERS = ("form", "gazetteer", "keyword", "against", "edges")
EM_ROUNDS, FIT_ROUNDS, RATE = 25, 200, 0.5


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn test."""
    back = F.reverse(digits)

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(account: Column) -> Column:
    """The account number, its first four characters moved to its end and letters as 10 to 35, modulo 97."""
    turned = F.split(F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4)), "")

    def add(rest, c):
        d = F.when(c == "", F.lit(0)).when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(c == "", rest).otherwise((rest * F.when(d > 9, 100).otherwise(10) + d) % 97)

    return F.aggregate(turned, F.lit(0), add)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "iban":
        return _mod97(F.replace(match, F.lit(" "), F.lit(""))) == 1
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _found(text: Column, kind: str, pattern: str) -> Column:
    """start, stop and match of all leftmost non-overlapping matches, in code points, before any test.

    The pattern's matches and the gaps between them alternate, so running lengths give the positions.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,stop:int,match:string>>")

    def step(acc, i):  # spans gather in parts, so that a text of very many matches is not copied once per match
        start = acc["at"] + F.length(F.element_at(gaps, i))
        match = F.element_at(matches, i)
        stop = start + F.length(match)
        span = F.array(F.struct(start.alias("start"), stop.alias("stop"), match.alias("match")))
        full = F.size(acc["part"]) >= SPANS_PER_PART
        return F.struct(
            stop.alias("at"), F.when(full, span).otherwise(F.concat(acc["part"], span)).alias("part"),
            F.when(full, F.concat(acc["parts"], F.array(acc["part"]))).otherwise(acc["parts"]).alias("parts"),
        )

    first = F.struct(F.lit(0).alias("at"), none.alias("part"), F.array().cast("array<array<struct<start:int,stop:int,match:string>>>").alias("parts"))
    walk = F.aggregate(F.sequence(F.lit(1), F.size(matches)), first, step, lambda acc: F.concat(F.flatten(acc["parts"]), acc["part"]))
    need = NEEDS.get(kind, "")
    possible = text.rlike(need) if len(need) > 1 else text.contains(need)
    return F.when(possible & (F.size(matches) > 0), walk).otherwise(none)


def _votes(kind: str, s: Column, text: Column) -> Column:
    """One vote per labeler: 1 for, -1 against, 0 none."""
    match = s["match"]
    before = F.substring(text, F.greatest(s["start"] - 29, F.lit(1)), F.least(s["start"], F.lit(30)))
    last, after = F.substring(before, -1, 1), F.substring(text, s["stop"] + 1, F.lit(1))
    if kind in ("email", "email_spelled"):
        gazetteer = F.when(match.rlike(ENDINGS), 1).otherwise(-1)
    elif kind == "card":
        gazetteer = F.when(match.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), 1).otherwise(0)
    elif kind == "ip":
        gazetteer = F.when(match.rlike(r"^(?:0|127|255)\."), -1).otherwise(0)
    elif kind == "national_id":
        gazetteer = F.when(match.rlike(r"^(?:000|666|9)"), -1).otherwise(1)
    elif kind == "iban":
        gazetteer = F.when(F.substring(match, 1, 2).isin(IBAN_COUNTRIES), 1).otherwise(-1)
    elif kind == "secret":
        gazetteer = F.when(match.rlike(r"(?i)example|changeme|placeholder|xxxx"), -1).otherwise(1)
    elif kind == "person":
        gazetteer = F.when(match.rlike(rf"(?:^|[. ])(?:{'|'.join(GIVEN_NAMES)}) "), 1).otherwise(0)
    elif kind == "address":
        gazetteer = F.lit(1)
    else:
        gazetteer = F.when(_digits(match).rlike(r"^1?[2-9]"), 1).otherwise(-1)
    strict = {"iban": F.lit(1), "secret": F.when(match.rlike("[0-9]") & match.rlike(r"[:=] {0,3}[\"']?[^\"']{16,}"), 1).otherwise(0), "person": F.when(match.rlike(rf"^(?:{TITLES})\b"), 1).otherwise(0), "address": F.lit(1)}
    form = F.lit(1) if kind in BASE else strict[kind] if kind in strict else F.when(match.rlike(r"^(?:\([0-9]{3}\)|[0-9]{3}-[0-9]{3}-|[^()\[\] ]+ ?[\[(])"), 1).otherwise(0)
    return F.array(
        form.cast("int"),
        gazetteer.cast("int"),
        before.rlike(KEYWORDS).cast("int"),
        F.when(before.rlike(AGAINST), -1).otherwise(0),
        F.when(last.rlike(r"[\w=/#@]") | after.rlike(r"[\w=/@]"), -1).otherwise(1),
    )


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `base` and `wide`: arrays of kind, start, stop and votes, by kind as listed, then start."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = {**BASE, **WIDE}
    out = docs
    for kind, pattern in kinds.items():
        out = out.withColumn(f"_{kind}", _found(whole, kind, pattern))

    def shaped(kind: str) -> Column:
        good = F.filter(f"_{kind}", lambda s: _valid(kind, s["match"]))
        return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), _votes(kind, s, whole).alias("votes")))

    out = out.withColumn("base", F.concat(*map(shaped, BASE))).withColumn("wide", F.concat(*map(shaped, WIDE)))
    apart = F.filter("wide", lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    return out.withColumn("wide", apart).drop(*[f"_{k}" for k in kinds])


def _em(patterns: Column) -> Column:
    """pi, a and b after EM: the share of true spans and each labeler's chance to vote for true and false ones."""
    n = len(LABELERS)
    total = F.aggregate(patterns, F.lit(0.0), lambda s, t: s + t["n"])
    first = F.struct(F.lit(0.5).alias("pi"), F.array_repeat(F.lit(0.8), n).alias("a"), F.array_repeat(F.lit(0.2), n).alias("b"), F.transform(patterns, lambda t: F.lit(0.5)).alias("r"))

    def round_(p, _):
        def posterior(t):
            z = F.aggregate(
                F.sequence(F.lit(1), F.lit(n)), F.log(p["pi"] / (1 - p["pi"])),
                lambda s, j: s + F.when(F.element_at(t["votes"], j) == 1, F.log(F.element_at(p["a"], j) / F.element_at(p["b"], j)))
                .when(F.element_at(t["votes"], j) == -1, F.log((1 - F.element_at(p["a"], j)) / (1 - F.element_at(p["b"], j)))).otherwise(0.0),
            )
            return 1 / (1 + F.exp(-z))

        r = F.transform(patterns, posterior)
        pairs = F.arrays_zip(patterns.alias("t"), r.alias("r"))

        def chance(true):
            def of(j):
                share = lambda x: x["r"] if true else 1 - x["r"]
                votes = F.filter(pairs, lambda x: F.element_at(x["t"]["votes"], j) != 0)
                up = F.aggregate(votes, F.lit(0.0), lambda s, x: s + F.when(F.element_at(x["t"]["votes"], j) == 1, share(x) * x["t"]["n"]).otherwise(0.0))
                return (up + 0.8 if true else up + 0.2) / (F.aggregate(votes, F.lit(0.0), lambda s, x: s + share(x) * x["t"]["n"]) + 1)

            return F.transform(F.sequence(F.lit(1), F.lit(n)), of)

        pi = (F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["r"] * x["t"]["n"]) + 0.5) / (total + 1)
        return F.struct(pi.alias("pi"), chance(True).alias("a"), chance(False).alias("b"), r.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), first, round_)


def _inputs(kind: Column, votes: Column) -> Column:
    """The classifier's inputs: 1, the kind, and votes for and against."""
    return F.concat(
        F.array(F.lit(1.0)), F.transform(F.array(*map(F.lit, KINDS)), lambda k: (k == kind).cast("double")),
        F.transform(votes, lambda v: (v == 1).cast("double")), F.transform(votes, lambda v: (v == -1).cast("double")),
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def train(found: DataFrame) -> list[float] | None:
    """Weights of the span classifier from the votes of all candidates; None without candidates.

    The votes are counted by pattern first, so the training works on at most kinds x 3^labelers rows.
    """
    spans = found.select(F.explode(F.concat("base", "wide")).alias("s")).select("s.kind", "s.votes")
    counted = spans.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    patterns = counted.agg(F.sort_array(F.collect_list(F.struct("kind", "votes", "n"))).alias("patterns")).where(F.size("patterns") > 0)
    aged = patterns.withColumn("em", _em(F.col("patterns")))
    rows = F.transform(F.arrays_zip(F.col("patterns").alias("t"), F.col("em.r").alias("r")), lambda x: F.struct(_inputs(x["t"]["kind"], x["t"]["votes"]).alias("x"), x["r"].alias("y"), F.log1p(x["t"]["n"]).alias("n")))
    width = 1 + len(KINDS) + 2 * len(LABELERS)

    def descend(w, _):
        errors = F.transform("rows", lambda r: F.struct(r["x"].alias("x"), (r["n"] * (1 / (1 + F.exp(-_dot(w, r["x"]))) - r["y"]) / F.col("total")).alias("e")))
        gradient = F.aggregate(errors, F.array_repeat(F.lit(0.0), width), lambda g, r: F.zip_with(g, r["x"], lambda a, b: a + b * r["e"]))
        return F.zip_with(w, gradient, lambda a, g: a - RATE * (g + 0.001 * a))

    ready = aged.withColumn("rows", rows).withColumn("total", F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["n"]))
    fitted = ready.select(F.aggregate(F.sequence(F.lit(1), F.lit(FIT_ROUNDS)), F.array_repeat(F.lit(0.0), width), descend).alias("w")).collect()
    return list(fitted[0]["w"]) if fitted else None


def personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` with `base` and `spans`: arrays of kind, start and stop in code points, stop exclusive.

    `spans` holds all of `base` and the wider candidates that the classifier accepts. Null and empty texts have
    none; repeated rows have equal spans; an empty table gives an empty result. Other columns are not read.
    """
    found = materialize(candidates(docs.select(*keep, F.col(text).alias("_text")), "_text").select(*keep, "base", "wide"), "pii")
    weights = train(found)
    w = F.array(*map(F.lit, weights or [0.0]))
    accepted = F.filter("wide", lambda s: _dot(w, _inputs(s["kind"], s["votes"])) > 0) if weights else F.col("wide")
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return found.select(*keep, plain(F.col("base")).alias("base"), plain(F.concat(F.col("base"), accepted)).alias("spans"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op5(spark, sf_dir: str) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, all spans and their number of every document."""
    found = personal_data(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op5_personal_data": op5}
SQL: dict[str, str] = {}
