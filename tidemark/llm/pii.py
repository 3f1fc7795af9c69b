"""Personal data by pattern, checksum and context, in DataFrame functions only.

Every kind is a pattern that proposes spans, a validator that confirms them
(Luhn for cards, mod-97 for account numbers, digit counts, octet ranges) and a
score that words nearby raise.  ``split`` and ``regexp_extract_all`` with one
pattern give the pieces between and the matches themselves, so running sums of
their lengths are the spans' code-point positions, and the ends of the pieces
around a match are its context: a text is walked once, however many matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, let, text_of

#: Fixed patterns.  The look-behind and the possessive quantifiers keep the leftmost non-overlapping matches of the plain forms while no run of characters is scanned twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])"

#: Context words, lower case, that raise the score of a proposal, and those that lower it.
CONTEXT = {
    "email": r"\b(e-?mail|mail|contact|write|courriel|correo)\b",
    "ip": r"\b(ip|address|host|server|client|login)\b",
    "card": r"\b(card|credit|visa|mastercard|amex|payment|karte|carte|tarjeta)\b",
    "phone": r"\b(phone|tel|telephone|mobile|cell|call|fax|telefon|téléphone|teléfono)\b",
    "iban": r"\b(iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"\b(ssn|social security|tax id)\b",
    "local_phone": r"\b(phone|tel|telephone|mobile|cell|call|fax|telefon|téléphone|teléfono)\b",
}
AGAINST = r"\b(order|invoice|tracking|reference|serial|part|version|isbn|example)\b"
#: Score before context, and what context adds or takes; an added kind counts from NEEDED on.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3, "local_phone": 0.2}
CONTEXT_GAIN, CONTEXT_LOSS, NEEDED, NEAR = 0.4, 0.3, 0.5, 40
#: In the order in which spans of one start are listed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone")


def _scan(n: Column, zero: dict[str, Column], item: str, step) -> Column:
    """The array of what step gives for 0, ..., n - 1, n > 0: step(state, i) is (the next state, an item).

    Items are gathered in runs of 256, so that no long array is copied for every one.
    """
    def one(acc, i):
        state, x = step(acc, i)
        return F.struct(*[state[k].alias(k) for k in zero], F.concat(acc["out"], F.array(x)).alias("out"))

    def run(acc, k):
        start = F.struct(*[acc[z].alias(z) for z in zero], F.array().cast(f"array<{item}>").alias("out"))
        own = F.aggregate(F.sequence(k * 256, F.least(k * 256 + 255, n - 1)), start, one)
        return let(own, lambda x: F.struct(*[x[z].alias(z) for z in zero], F.concat(acc["out"], F.array(x["out"])).alias("out")))

    start = F.struct(*[v.alias(k) for k, v in zero.items()], F.array().cast(f"array<array<{item}>>").alias("out"))
    return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / 256).cast("int")), start, run, lambda acc: acc["out"]))


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<s,e,m,near>> of the leftmost non-overlapping matches; the matches must have a width.

    near is the NEAR characters before a match, a line feed, and as many after
    it, up to the next match.
    """
    item = "struct<s:int,e:int,m:string,near:string>"

    def step(pair):
        def one(acc, i):
            part, m = pair["parts"][i], pair["found"][i]
            s = acc["at"] + F.length(part)
            e = s + F.length(m)
            before = F.right(F.concat(acc["tail"], F.right(part, F.lit(NEAR))), F.lit(NEAR))
            near = F.concat(before, F.lit("\n"), F.left(pair["parts"][i + 1], F.lit(NEAR)))
            state = {"at": e, "tail": F.right(F.concat(before, F.right(m, F.lit(NEAR))), F.lit(NEAR))}
            return state, F.struct(s.alias("s"), e.alias("e"), m.alias("m"), near.alias("near"))

        return one

    pair = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    placed = let(pair, lambda p: _scan(F.size(p["found"]), {"at": F.lit(0), "tail": F.lit("")}, item, step(p)))
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(f"array<{item}>"))


def _clear(base: Column, more: Column) -> Column:
    """The spans of more that overlap none of base, by one sweep from each side."""
    item = "struct<s:int,added:int,e:int,k:int,kind:string,score:double,met:boolean>"

    def marked(spans, added):
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(added).alias("added"), x["e"].alias("e"), x["k"].alias("k"), x["kind"].alias("kind"), x["score"].alias("score"), F.lit(False).alias("met")))

    def swept(spans, start, meets, other):
        def step(acc, i):
            x = spans[i]
            met = x["met"] | ((x["added"] == 1) & meets(acc["edge"], x))
            state = {"edge": F.when(x["added"] == 0, other(acc["edge"], x)).otherwise(acc["edge"])}
            return state, F.struct(*[x[c].alias(c) for c in ("s", "added", "e", "k", "kind", "score")], met.alias("met"))

        return _scan(F.size(spans), {"edge": F.lit(start)}, item, step)

    def forward(spans):
        return swept(spans, 0, lambda at, x: at > x["s"], lambda at, x: F.greatest(at, x["e"]))

    def backward(spans):
        return swept(spans, 2**31 - 1, lambda at, x: at < x["e"], lambda at, x: F.least(at, x["s"]))

    every = F.array_sort(F.concat(marked(base, 0), marked(more, 1)))
    left = let(every, lambda x: let(F.reverse(forward(x)), backward))
    kept = F.filter(left, lambda x: (x["added"] == 1) & ~x["met"])
    return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind"), x["score"].alias("score")))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn test."""

    def step(acc, i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def mod97(account: Column) -> Column:
    """True if an account number, its first four characters moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(acc, c):
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + (code - 48)) % 97).otherwise((acc * 100 + (code - 55)) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*[0-9]{1,3}$") & (F.regexp_extract(p, "^0*([0-9]{1,3})$", 1).try_cast("int") <= 255))


def _counted(low: int, high: int):
    return lambda m: F.length(digits_of(m)).between(low, high)


#: kind: (pattern, cheap test that a text can have a match, validator)
KINDS = {
    "email": (EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), _octets),
    "card": (CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), lambda m: F.when(_counted(14, 19)(m), luhn(digits_of(m))).otherwise(False)),
    "phone": (PHONE, lambda t: F.contains(t, F.lit("+")), _counted(10, 15)),
    "iban": (IBAN, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), lambda m: F.when(F.length(F.regexp_replace(m, " ", "")).between(15, 34), mod97(m)).otherwise(False)),
    "ssn": (SSN, lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"), lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$")),
    "local_phone": (LOCAL_PHONE, lambda t: t.rlike(r"[0-9][\x20.-][0-9]{3,4}"), _counted(9, 12)),
}


def _kind(text: Column, kind: str) -> Column:
    """array<struct<s,k,e,kind,score>> of the confirmed spans of one kind."""
    pattern, can, valid = KINDS[kind]
    empty = F.array().cast("array<struct<s:int,e:int,m:string,near:string>>")
    found = F.when(can(text), F.filter(spans_of(text, pattern), lambda x: valid(x["m"]))).otherwise(empty)
    rank = (BASE + ADDED).index(kind)

    def scored(x):
        near = F.lower(x["near"])
        gain = F.when(near.rlike(CONTEXT[kind]), F.lit(CONTEXT_GAIN)).when(near.rlike(AGAINST), F.lit(-CONTEXT_LOSS)).otherwise(F.lit(0.0))
        score = F.round(F.least(F.lit(PRIOR[kind]) + gain, F.lit(1.0)), 2)
        return F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), score.alias("score"))

    return F.transform(found, scored)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame, text: str = "text", base_only: bool = False) -> DataFrame:
    """docs with the columns pii_base and pii: arrays of struct<s,k,e,kind,score> sorted by start, then kind.

    pii_base holds what the base patterns and validators give, whatever its
    score; pii adds confirmed spans of the other kinds whose score, the kind's
    PRIOR raised or lowered by words nearby, reaches NEEDED and that do not
    overlap a base span.  Null texts are empty and have empty arrays.  Columns
    of docs with these two names are replaced; all others are kept.
    """
    kept = [c for c in docs.columns if c.lower() not in ("pii_base", "pii")]
    body, more = free_names([*docs.columns, "pii_base", "pii"], "body", "more")
    out = docs.select(*[F.col(f"`{c}`") for c in kept], text_of(docs, text).alias(body))
    out = out.withColumn("pii_base", F.array_sort(F.concat(*[_kind(F.col(body), k) for k in BASE])))
    if base_only:
        return out.withColumn("pii", F.col("pii_base")).drop(body)
    out = out.withColumn(more, F.filter(F.concat(*[_kind(F.col(body), k) for k in ADDED]), lambda x: x["score"] >= NEEDED))
    both = F.array_sort(F.concat("pii_base", _clear(F.col("pii_base"), F.col(more))))
    return out.withColumn("pii", F.when(F.size(more) == 0, F.col("pii_base")).otherwise(both)).drop(body, more)


def digest_columns(found: DataFrame, base: str = "pii_base", spans: str = "pii") -> DataFrame:
    """doc_id, a count for each base kind, the base spans' SHA-256, all spans as a string, and their scores likewise."""
    def count(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    scores = F.array_join(F.transform(spans, lambda x: F.format_number(x["score"], 2)), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(F.col(base)), 256).alias("base_sha256"), _joined(F.col(spans)).alias("spans"), scores.alias("scores"), F.size(spans).cast("long").alias("n_spans"))
