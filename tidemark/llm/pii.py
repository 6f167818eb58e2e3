"""Personal data in texts: patterns propose, checksums confirm, context scores.

DataFrame functions alone. A pattern's matches and the gaps between them give the
positions of all matches in one pass over the text each; positions are running sums of
lengths, in code points, end exclusive. Checks then drop what isn't valid: parts of an
address up to 255, Luhn for cards, the number of digits for phones, mod 97 for IBANs.
A span's score starts at its kind's, and words in the 40 code points before it and the 40
after it raise or lower it. The base kinds email, ip, card and phone stay whatever their
score; the further kinds need 0.5: iban, ssn, ``key`` (access keys and private keys of
known forms) and ``secret``, a value that a telling name is given. A secret's check, for
want of a sum, is that its characters are of two sorts and varied enough.

The patterns are those of the kinds, written so that the engine never tries a start again
inside a run of characters that has failed already: long texts take linear time.

Nulls and odd input: a null text is empty and has no spans. Spans of different kinds may
overlap. Input columns stay; ``spans`` is set, also where the input has such a column.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind -> (pattern, a quick test that a text with a match must pass). Tests
#: are a regular expression, or strings of which the text has one at least.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",)),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    "key": (
        r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})(?![A-Za-z0-9_-])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
        ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "xox", "sk-", "eyJ", "PRIVATE KEY"),
    ),
    "secret": (
        r"(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?)(?<![A-Za-z0-9+/_.~-])[A-Za-z0-9+/_.~-]{8,}={0,2}",
        r"[=:][ \t]{0,3}[\"']?[A-Za-z0-9+/_.~-]{8}",
    ),
}
BASE = ("email", "ip", "card", "phone")
#: The score of a valid span, what a context word adds, and those words.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "key": 0.9, "secret": 0.7}
WORDS = {
    "email": (0.1, "mail|contact|write"),
    "ip": (0.2, "address|host|server|client"),
    "card": (0.2, "card|visa|payment|credit"),
    "phone": (0.2, "phone|call|mobile|fax|telefon|tel"),
    "iban": (0.1, "iban|account|bank|konto|compte|cuenta"),
    "ssn": (0.4, "ssn|social security"),
    "key": (0.1, "key|aws|secret|token|credential"),
    "secret": (0.2, "password|secret|login|auth|credential|bearer"),
}
LESS = (-0.3, "version|isbn|serial|example")
CONTEXT, LEAST = 40, 0.5
_CHUNK = 256

#: Fixed value: the parts of an address, 0 to 255, with any zeros before them.
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _add(a: Column, b: Column) -> Column:
    return a + b


def running(values: Column) -> Column:
    """Sums of the values before each one; arrays grow within chunks, so time stays near linear."""
    n = F.size(values)
    chunks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    part = lambda k: F.slice(values, k * _CHUNK + 1, F.lit(_CHUNK))
    follow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    bases = F.aggregate(F.transform(chunks, lambda k: F.aggregate(part(k), F.lit(0), _add)), F.array(F.lit(0)), follow)
    return F.flatten(F.transform(chunks, lambda k: F.slice(F.aggregate(part(k), F.array(F.get(bases, k)), follow), F.lit(1), F.size(part(k)))))


def luhn(digits: Column) -> Column:
    """Whether digits 0-9 pass Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), _add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks has remainder 1 modulo 97."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.pmod(acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97))
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(m, F.lit(" "), F.lit("")))
    if kind == "secret":
        sorts = sum(m.rlike(c).cast("int") for c in ("[0-9]", "[a-z]", "[A-Z]", "[+/_.~-]"))
        return (sorts >= 2) & (F.size(F.array_distinct(F.split(m, ""))) >= 6)
    return F.lit(True)


def score(kind: str, near: Column) -> Column:
    """From the text on both sides of a span."""
    near = F.lower(near)
    more, words = WORDS[kind]
    less, bad = LESS
    total = F.lit(SCORES[kind]) + F.when(near.rlike(words), more).otherwise(0.0) + F.when(near.rlike(bad), less).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 2)


def _span(kind: str, rank: int):
    """From a match and its number, the span, its score and whether it is valid."""
    gaps, sums = F.col(f"__g_{kind}"), F.col(f"__r_{kind}")

    found = F.col(f"__m_{kind}")

    def around(i: Column) -> Column:
        """CONTEXT code points on each side; a gap that is shorter goes on with the next match and gap."""
        text = lambda values, k: F.coalesce(F.get(values, k), F.lit(""))
        near, far = F.lit(CONTEXT), lambda values, k: F.right(text(values, k), F.lit(CONTEXT))
        before = F.right(F.concat(far(gaps, i - 1), far(found, i - 1), far(gaps, i)), near)
        first = lambda values, k: F.left(text(values, k), F.lit(CONTEXT))
        after = F.left(F.concat(first(gaps, i + 1), first(found, i + 1), first(gaps, i + 2)), near)
        return F.concat(before, F.lit("\n"), after)

    def span(m: Column, i: Column) -> Column:
        start = F.get(sums, i) + F.char_length(F.get(gaps, i))
        own = {"start": start, "rank": F.lit(rank), "end": start + F.char_length(m), "kind": F.lit(kind), "score": score(kind, around(i)), "found": m, "valid": valid(kind, m)}
        return F.struct(*[c.alias(name) for name, c in own.items()])

    return span


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Add ``spans``: structs (start, rank, end, kind, score, found), in order of start and kind."""
    none = F.array().cast("array<string>")
    frame = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    parts = {}
    for kind, (pattern, quick) in PATTERNS.items():
        test = F.col("__text").rlike(quick) if isinstance(quick, str) else reduce(or_, [F.contains("__text", F.lit(x)) for x in quick])
        parts[f"__m_{kind}"] = F.when(test, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))).otherwise(none)
    frame = frame.withColumns(parts)
    frame = frame.withColumns({f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.split("__text", p, -1)).otherwise(none) for k, (p, _) in PATTERNS.items()})
    steps = {f"__s_{k}": F.zip_with(F.slice(f"__g_{k}", F.lit(1), F.size(f"__m_{k}")), f"__m_{k}", lambda g, m: F.char_length(g) + F.char_length(m)) for k in PATTERNS}
    frame = frame.withColumns(steps)
    frame = frame.withColumns({f"__r_{k}": running(F.col(f"__s_{k}")) for k in PATTERNS})
    found = []
    for rank, kind in enumerate(PATTERNS):
        spans = F.filter(F.transform(f"__m_{kind}", _span(kind, rank)), lambda s: s["valid"])
        found.append(spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= LEAST))
    frame = frame.withColumn("__spans", F.array_sort(F.concat(*found)))
    kept = F.transform("__spans", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "score", "found")]))
    drop = ["__text", "__spans", *(f"__{x}_{k}" for x in "mgsr" for k in PATTERNS)]
    return frame.withColumn("spans", kept).drop(*drop)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
