"""Personal data in whole texts: patterns propose spans, checksums confirm them, context words adjust the score.
DataFrame functions only.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of a fixed pattern that pass a fixed test, and
always stay. The method adds kinds: account numbers (IBAN, mod-97), social security numbers and telephone numbers
without a country code, which need a context word nearby to reach ACCEPT. A pattern runs only over texts that hold
a character it needs. Patterns start only where a run starts or the previous match ended, and repeat possessively, so the
time is linear in the text, also for one word of a million characters. Positions come from the lengths of the pieces between
matches, added up in a window per text, so a text full of matches costs no more per match.

Cases: null text counts as empty and has no spans; rows that repeat are reported each on their own; positions are code
points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_CHARS = 48
ACCEPT = 0.5

# fixed values: the base patterns in linear form (same matches), and the order of kinds
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9A-Za-z.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
LOCAL_PHONE = r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
ADDED = ("iban", "ssn", "local_phone")

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_IP_VALID = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
#: Score of a match before context, and words that raise or lower it.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3}
NEAR = {
    "email": "mail|contact|kontakt|correo|courriel", "ip": "ip|host|server|address|adresse", "card": "card|visa|credit|karte|carte|tarjeta|payment",
    "phone": "tel|phone|call|mobile|fax|fon|movil", "iban": "iban|account|konto|compte|cuenta|bank", "ssn": "ssn|social|security",
    "local_phone": "tel|phone|call|mobile|fax|fon|movil"}
AGAINST = "example|sample|version|isbn|order|serial"
NEAR_GAIN, AGAINST_LOSS = 0.3, 0.2


def _digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m):
    """The IBAN remainder: first four characters last, letters as 10 to 35."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(F.ascii(c) >= 65, (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _valid(kind, m):
    card, digits = _digits(m), F.length(_digits(m))
    plain = F.length(F.replace(m, F.lit(" "), F.lit("")))
    return (F.when(kind == "ip", m.rlike(_IP_VALID))
            .when(kind == "card", digits.between(13, 19) & F.call_function("luhn_check", card))
            .when(kind == "phone", digits.between(9, 15))
            .when(kind == "iban", plain.between(15, 34) & (_mod97(m) == 1))
            .otherwise(F.lit(True)))


def _matches(text, kind: str, pattern: str, needs):
    """Matches with the length of the text before each (since the one before it) and the text's CONTEXT_CHARS on both sides,
    whatever stands there. A match has two characters at least, so CONTEXT_CHARS // 2 neighbours cover them."""
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("g"))
    near, most = F.lit(CONTEXT_CHARS), CONTEXT_CHARS // 2
    # bound to a variable, the pieces are made once per text and not once per match
    pieces = F.transform(F.array(zipped), lambda z: F.struct(
        z.alias("z"), F.transform(z, lambda x: F.right(F.concat(x["g"], F.coalesce(x["m"], F.lit(""))), near)).alias("tails"),
        F.transform(z, lambda x: F.left(F.concat(x["g"], F.coalesce(x["m"], F.lit(""))), near)).alias("heads")))

    def match(s, x, i):
        first = F.greatest(i - most, F.lit(0))
        left = F.concat(F.array_join(F.slice(s["tails"], first + 1, i - first), ""), F.right(x["g"], near))
        right = F.array_join(F.slice(s["heads"], i + 2, F.lit(most + 1)), "")
        return F.struct(F.lit(kind).alias("kind"), x["m"].alias("found"), F.length(x["g"]).alias("gap"), F.right(left, near).alias("left"), F.left(right, near).alias("right"))

    whole = F.flatten(F.transform(pieces, lambda s: F.transform(F.slice(s["z"], F.lit(1), F.size(s["z"]) - 1), lambda x, i: match(s, x, i))))
    empty = F.expr("cast(array() as array<struct<kind:string,found:string,gap:int,left:string,right:string>>)")
    return F.when(needs, whole).otherwise(empty)


def _scored(docs: DataFrame) -> DataFrame:
    """row_, doc_id, kind, start, end, score, base for every accepted span; rows without any have a null kind."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("row_", F.monotonically_increasing_id())
    t = F.col("text")
    digit = t.rlike("[0-9]")
    kinds = F.concat(
        _matches(t, "email", EMAIL, F.contains(t, F.lit("@"))), _matches(t, "ip", IP, digit), _matches(t, "card", CARD, digit),
        _matches(t, "phone", PHONE, F.contains(t, F.lit("+")) & digit), _matches(t, "iban", IBAN, digit), _matches(t, "ssn", SSN, digit),
        _matches(t, "local_phone", LOCAL_PHONE, digit))
    found = rows.select("row_", "doc_id", F.posexplode_outer(kinds).alias("at", "s")).select("row_", "doc_id", "at", "s.*").repartition("row_")
    before = Window.partitionBy("row_", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("found")
    placed = found.withColumn("end", F.sum(F.col("gap") + size).over(before)).withColumn("start", F.col("end") - size)
    near = F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in NEAR.items()])
    around = F.lower(F.concat_ws(" ", "left", "right"))
    base = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in SCORES.items()])
    score = (base + F.when(F.regexp_like(around, F.concat(F.lit("(?<![a-z])(?:"), near, F.lit(")"))), NEAR_GAIN).otherwise(0.0)
             - F.when(around.rlike(rf"(?<![a-z])(?:{AGAINST})"), AGAINST_LOSS).otherwise(0.0))
    is_base = F.col("kind").isin(*BASE)
    scored = placed.withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).withColumn("base", is_base)
    keep = _valid(F.col("kind"), F.col("found")) & (is_base | (F.col("score") >= ACCEPT))
    return scored.select("row_", "doc_id", "start", "end", "score", "base", F.when(keep, F.col("kind")).alias("kind"))


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, score, base: one row per span of docs (doc_id, text)."""
    return _scored(docs).where("kind is not null").select("doc_id", "kind", "start", "end", "score", "base")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: base counts, the digest of the base spans, all spans as kind:start:end."""
    order = F.array_position(F.array(*[F.lit(k) for k in BASE + ADDED]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct(order.alias("o"), "start", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("s"), "base"))
    spans = F.array_sort(F.collect_list(span))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE]
    rows = _scored(docs).groupBy("row_", "doc_id").agg(*counts, spans.alias("all_"))
    names = lambda a: F.array_join(F.transform(a, lambda x: x["s"]), ",")
    return rows.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(names(F.filter("all_", lambda x: x["base"])), 256).alias("base_sha256"), names(F.col("all_")).alias("spans"))
