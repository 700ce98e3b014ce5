"""Personal data in whole texts, by DataFrame functions alone.

Regular expressions propose spans; validators confirm them (octets, Luhn, mod-97, digit counts);
words in the forty characters before raise or lower a proposal's score. The base kinds (email, ip,
card, phone) are kept whenever they are valid, whatever their score. The further kinds (iban,
ssn, national: a phone number without ``+``) are kept from a score of 0.5 and only where they
touch no base span.

Patterns are the base ones rewritten so that the JVM's matcher needs neither recursion nor
backtracking over long runs: possessive repeats where nothing follows that could need a shorter
one, and starts only where a run begins (or the last match ended), as a match that could start
inside a run would have started at its beginning.

Positions: matches are bracketed with U+0001 and the text is cut there, so each match starts
after the pieces before it. A U+0001 in the text counts as U+0002, which no pattern holds either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import documents_of

MARK, STAND_IN = "\u0001", "\u0002"
BASE = ("email", "ip", "card", "phone")
#: Kind -> pattern.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?=[0-9](?:[ -]?[0-9]){13})[0-9](?:[ -]?[0-9])*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "national": r"(?<![A-Za-z0-9.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9-])",
}
#: Kind -> score before the context speaks.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "national": 0.4}
#: Kind -> words nearby that speak for it.
FOR = {
    "email": "mail|contact|write|courriel|correo|kontakt",
    "ip": "ip|address|server|host|login|adresse",
    "card": "card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|appel|llam",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax",
    "national": "phone|tel|call|mobile|fax|contact|telefon|appel|llam",
}
#: Words nearby that speak against any kind.
AGAINST = "version|isbn|issn|order|invoice|serial|part|sku|doi|build"
CONTEXT = 40
STEP = 0.3
#: Pieces whose positions are summed at a time; even, so that a chunk starts with a piece outside matches.
CHUNK = 64
#: Country -> characters of its account numbers.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def proposals(docs: DataFrame) -> DataFrame:
    """One column of spans for each kind beside ``docs``: leftmost non-overlapping matches of its pattern in ``t``, in order.

    Pieces and matches alternate. Positions are running lengths: of whole chunks of pieces first,
    then within each chunk, so that a text of very many matches costs little more than its length.
    Each step is a projection of its own, so that none is computed again for every chunk.
    """
    names = [c for c in docs.columns if c not in PATTERNS]
    length = lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, p: n + F.length(p))
    cut = docs.select(*names, *(F.split(F.regexp_replace("t", PATTERNS[k], f"{MARK}$0{MARK}"), MARK).alias(k) for k in PATTERNS))
    few = {k: F.size(k) <= CHUNK for k in PATTERNS}

    def chunked(k: str) -> Column:
        starts = F.sequence(F.lit(1), F.size(k), F.lit(CHUNK))
        return F.when(few[k], F.array(F.col(k))).otherwise(F.transform(starts, lambda at: F.slice(k, at, CHUNK)))

    chunks = cut.select(*names, *(chunked(k).alias(k) for k in PATTERNS))
    running = lambda k: F.aggregate(F.transform(k, length), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    begun = chunks.select(*names, *PATTERNS, *(F.when(F.size(k) == 1, F.array(F.lit(0))).otherwise(running(k)).alias(f"{k}_at") for k in PATTERNS))
    spans = lambda k, rank: F.flatten(F.filter(F.zip_with(k, f"{k}_at", lambda chunk, at: inside(chunk, at, k, rank)), lambda x: x.isNotNull()))
    return begun.select(*names, *(spans(k, rank).alias(k) for rank, k in enumerate(PATTERNS)))


def inside(parts: Column, begin: Column, kind: str, rank: int) -> Column:
    """The spans of every second part, the first of which starts at ``begin``."""
    start = F.struct(begin.alias("at"), F.lit(False).alias("inside"), F.array().cast(SPAN).alias("found"))

    def step(a: Column, part: Column) -> Column:
        end = a["at"] + F.length(part)
        span = F.struct(a["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), part.alias("value"))
        return F.struct(end.alias("at"), (~a["inside"]).alias("inside"), F.when(a["inside"], F.concat(a["found"], F.array(span))).otherwise(a["found"]).alias("found"))

    return F.aggregate(parts, start, step, lambda a: a["found"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """Whether the account number's check digits hold: its number, first four characters last, is 1 modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    each = F.filter(F.split(turned, ""), lambda c: c != "")
    code = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(each, F.lit(0), lambda a, c: (a * F.when(F.ascii(c) >= 65, 100).otherwise(10) + code(c)) % 97) == 1


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":  # leading zeros do not count
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255)
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & mod97(value)
    return F.lit(True)


def shortened(span: Column) -> Column:
    """An account number's span without words after it: as many characters as its country's numbers have."""
    size = F.lit(None).cast("int")
    for n in sorted(set(IBAN_LENGTHS.values())):
        size = F.when(F.substring(span["value"], 1, 2).isin([c for c, k in IBAN_LENGTHS.items() if k == n]), F.lit(n)).otherwise(size)
    own = F.coalesce(F.call_function("regexp_extract", span["value"], F.concat(F.lit("^(?:[A-Z0-9] ?){"), (size - 1).cast("string"), F.lit("}[A-Z0-9](?![A-Z0-9])")), F.lit(0)), span["value"])
    return F.struct(span["start"].alias("start"), span["rank"].alias("rank"), span["kind"].alias("kind"), (span["start"] + F.length(own)).alias("end"), own.alias("value"))


def context_score(text: Column, kind: Column, start: Column) -> Column:
    """Prior of the kind, more with a word for it nearby and less with a word against; 0 to 1."""
    first = F.greatest(start - CONTEXT, F.lit(0))
    near = F.lower(F.substring(text, first + 1, start - first))
    prior = F.lit(0.0)
    backed = F.lit(False)
    for k in PATTERNS:
        prior = F.when(kind == k, F.lit(PRIOR[k])).otherwise(prior)
        backed = backed | ((kind == k) & near.rlike(FOR[k]))
    moved = prior + F.when(backed, STEP).otherwise(0.0) - F.when(near.rlike(AGAINST), STEP).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """(doc_id, base, more): arrays of spans by start, then kind as listed; ``more`` adds the further kinds with scores.

    Start and end are code points of the whole text, end exclusive. Null texts count as empty and
    give empty arrays; rows and ids may repeat; other columns are not read.
    """
    docs = proposals(documents_of(df, id_col, text_col).select("doc_id", F.translate(F.coalesce("text", F.lit("")), MARK, STAND_IN).alias("t")))

    def confirmed(kind: str) -> Column:
        spans = F.col(kind)
        return F.filter(F.transform(spans, shortened) if kind == "iban" else spans, lambda s: valid(kind, s["value"]))

    found = docs.select("doc_id", "t", *(confirmed(k).alias(k) for k in PATTERNS))
    based = found.select("doc_id", "t", *PATTERNS, F.array_sort(F.concat(*BASE)).alias("base"))
    further = F.filter(F.concat(*(k for k in PATTERNS if k not in BASE)), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & (context_score(F.col("t"), s["kind"], s["start"]) >= min_score))
    return based.select("doc_id", "base", F.transform(F.array_sort(F.concat("base", further)), lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"], s["value"], context_score(F.col("t"), s["kind"], s["start"]).alias("score"))).alias("more"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("more")).alias("spans"))
