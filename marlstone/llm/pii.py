"""Personal data: exact base formats, and further spans chosen by boosted trees. DataFrame operations only.

A pattern's matches and the gaps between them (``regexp_extract_all`` and ``split`` walk the text alike) give every
match its position in code points. Patterns are written so that Java's matcher neither recurses over a repeated group
nor starts anew at each character of a run; they find what the plain forms in BASE_FORMS find.

Generators of high recall propose more spans, which may overlap. For each kind, trees boosted on a bounded sample score
them by format and context. There are no labels for spans, so the sample is written anew: its base spans in forms that
people give them to escape plain patterns (``name (at) host (dot) org``, numbers without a plus, dots in brackets), and at the
end of each text some made-up spans in such forms beside made-up decoys (dates, prices, versions, digests, identifiers). What is
written is known, and what else is proposed around it is negative, so that what is found doesn't hang on how many spans a
corpus has. Secrets are values that are assigned to a word for a credential, or that have the form of an access key; digests
that stand after ``commit`` or ``sha256``, or alone, are none. Each kind's threshold is calibrated on the proposals of
held-out documents. A chosen span that meets no base span is added; of chosen ones that overlap, the one with the highest score.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import persisted, whole_text
from marlstone.llm.quality import _sigmoid

#: Documents that the trees are fitted on, about: half of any kind, and a tenth for each kind that a cheap test tells.
SAMPLE_DOCS = 4000
#: Documents that are tested for that, about.
POOL_DOCS = 40_000
#: Proposals that are taken from them, at most.
SAMPLE_PROPOSALS = 40_000
#: Made-up spans, and as many decoys, at the end of each text of the sample.
PLANTED = 3
TREES = 40
BINS = 16
RATE = 0.3
PRECISION = 0.98
KINDS = ("email", "ip", "card", "phone", "secret")
#: The plain forms, for reference and tests.
BASE_FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches without group repetition. A card's pattern also passes over runs of under 14 digits.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?![A-Za-z0-9-])(?!\.[A-Za-z0-9-])",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=(?:[ -]?[0-9]){13})[0-9 -]*?(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text may have a match at all.
NEEDS = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]",
    "secret": r"[A-Za-z0-9_+/-]{20}|[A-Za-z_][0-9]|[0-9][A-Za-z_]|[0-9]{12}", "number": r"[0-9]", "mail": r"(?i)[@\uFF20]|\bat\b", "address": r"[0-9]\s?(?:[.,]|dot|[\[({]\s?(?:dot|\.))", "digits": r"[0-9](?:[ ._/:-]{0,3}[0-9]){12}",
}
_AT, _DOT = r"(?:\s?(?:[@\uFF20]|[\[({<]\s?(?:at|@)\s?[\])}>])\s?|\sat\s)", r"(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)"
#: Kind and pattern of the generators. Mail addresses have up to five labels; the others have no bound but their form.
GENERATORS = {
    "secret": ("secret", r"(?<![A-Za-z0-9_+/-])(?:(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+|[A-Za-z_+/-]{20,}+)={0,2}"),
    "number": ("phone", r"(?<![0-9A-Za-z])[0-9(][0-9() ./-]{6,}[0-9](?![0-9A-Za-z])"),
    "mail": ("email", rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++){{0,3}}{_DOT}[A-Za-z]{{2,}}+"),
    "address": ("ip", r"(?<![0-9.])[0-9]{1,3}(?:(?:\s?(?:[.,]|[\[({]\s?(?:dot|\.)\s?[\])}])\s?|\sdot\s)[0-9]{1,3}){3}(?![0-9])"),
    "digits": ("card", r"(?<![0-9A-Za-z])[0-9](?:[ ._/:-]{0,3}[0-9]){12,18}(?![0-9A-Za-z])"),
}
#: Cheap tests by which the sample is drawn, a kind each, and one that all texts pass.
SAMPLED = (
    r"[A-Za-z0-9]@[A-Za-z0-9-]+\.|[(\[](?:at|dot)[)\]]", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", NEEDS["card"], r"\+[0-9][ ().0-9-]{8}|(?i:tel|phone|call|fax|mobile)[a-z]*[.:]?\s*[0-9(]",
    r"(?i:token|key|secret|passw|auth|bearer)[A-Za-z_]*\s*[=:]\s*[\"']?[A-Za-z0-9_+/-]{12}", "",
)
#: Frequent last labels of host names.
TOP_LEVEL = "com org net edu gov int info biz io co uk de fr es it nl eu ch at be se no dk fi pl pt cz us ca au nz jp cn in br ru".split()
#: Words before a credential, and before a digest that is none.
CREDENTIAL, DIGEST = "token|key|secret|passw|auth|bearer|credential", "commit|sha[-_]?[0-9]|md5|crc|checksum|digest|hash|revision|etag|blob|tree|parent|object"
_NO_SPANS = "CAST(array() AS array<struct<start:int,stop:int,hit:string,before:string,after:string>>)"


def _found(text: str, need: str, pattern: str) -> Column:
    """start, stop, hit, before and after (context) of each match, leftmost and not overlapping."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    taken = F.filter(zipped, lambda z: z["hit"].isNotNull())
    step = lambda acc, z: F.struct((acc["pos"] + F.length(z["gap"]) + F.length(z["hit"])).alias("pos"), F.concat(acc["out"], F.array(_span(acc, z))).alias("out"))

    def _span(acc: Column, z: Column) -> Column:
        start = acc["pos"] + F.length(z["gap"])
        return F.struct(start.alias("start"), (start + F.length(z["hit"])).alias("stop"), z["hit"].alias("hit"), F.right(z["gap"], F.lit(24)).alias("before"), F.lit("").alias("after"))

    zero = F.struct(F.lit(0).alias("pos"), F.expr(_NO_SPANS).alias("out"))
    return F.when(F.col(text).rlike(need), F.aggregate(taken, zero, step, lambda acc: acc["out"])).otherwise(F.expr(_NO_SPANS))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(value(i) > 9, value(i) - 9).otherwise(value(i)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    return _luhn_sum(digits) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = _digits(hit)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__text`` gets ``__base``: start, rank of the kind, stop, sorted."""
    found = docs.withColumns({f"__{k}": _found("__text", NEEDS[k], p) for k, p in BASE.items()})

    def valid_spans(rank: int, kind: str) -> Column:
        valid = F.filter(f"__{kind}", lambda x: _valid(kind, x["hit"]))
        return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop")))

    spans = [valid_spans(i, k) for i, k in enumerate(KINDS[:4])]
    return found.withColumn("__base", F.array_sort(F.concat(*spans))).drop(*(f"__{k}" for k in BASE))


def _cue(rank: int, hit: Column, before: Column, k: Column) -> Column:
    """Whether a span that nobody has written says itself that it is one: an assigned value after a word for credentials, which
    counts as a positive; an address with (at) or (dot), or digits after a word for telephones, which are left out of the sample."""
    if KINDS[rank] == "email":
        return hit.rlike(r"[(\[](?:at|dot)[)\]]")
    if KINDS[rank] == "phone":
        return k.between(7, 15) & before.rlike(r"(?i)\b(?:tel|phone|call|fax|mobile)[a-z]*[.:]?\s*$")
    mixed = hit.rlike("[A-Za-z]") & hit.rlike("[0-9]") & (F.size(F.array_distinct(F.split(hit, ""))) >= 10) & before.rlike(rf"(?i)(?:{CREDENTIAL})")
    return (hit.rlike("^[0-9a-fA-F]{32,}$") & ~before.rlike(rf"(?i)(?:{DIGEST})") | mixed) & before.rlike(r"[=:]\s*[\"']?$")


def _longest(hit: Column, other: str) -> Column:
    """Length of the longest run without ``other``."""
    return F.array_max(F.transform(F.split(hit, other), F.length))


def _proposal(x: Column, rank: int) -> Column:
    """A proposal with its features as numbers, of format and context."""
    hit, before = x["hit"], x["before"]
    digits = _digits(hit)
    n, k = F.length(hit), F.length(digits)
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    words = [before.rlike(p) for p in (r"[=:]\s*[\"']?$", rf"(?i)(?:{CREDENTIAL})", rf"(?i)(?:{DIGEST})", r"(?i)(?:tel|phone|call|fax|mobile|card|mail|contact)", r"\+$", r"[A-Za-z]\s?$", r"[0-9][^A-Za-z]{0,2}$")]
    parts = F.filter(F.split(hit, "[^0-9]+"), lambda p: p != "")
    return F.struct(
        x["start"].alias("start"), x["stop"].alias("stop"), F.lit(rank).alias("rank"), _cue(rank, hit, before, k).alias("cue"),
        F.array(*[number(c) for c in (
            n, k, k / n, F.size(F.array_distinct(F.split(hit, ""))), F.length(F.regexp_replace(hit, "[A-Za-z0-9]", "")), F.length(F.regexp_replace(hit, "[^A-Z]", "")) / n, F.length(F.regexp_replace(hit, "[^aeiouAEIOU]", "")) / n,
            hit.rlike("^[0-9a-fA-F]+$"), F.when(k.between(13, 19), luhn(digits)), F.size(parts), F.array_max(F.transform(parts, lambda p: F.length(p))), F.array_min(F.transform(parts, lambda p: F.length(p))),
            _longest(hit, "[^A-Za-z]"), F.size(F.split(hit, r"[^A-Za-z0-9]+")), F.length(F.regexp_extract(hit, "[A-Za-z]*$", 0)), hit.rlike(r"[\[({<]"), hit.rlike(r"\s"), hit.rlike(r"(?i)\bat\b"), hit.rlike(r"(?i)\bdot\b"), hit.rlike("^[0-9]"),
            F.lower(F.regexp_extract(hit, "[A-Za-z]*$", 0)).isin(*TOP_LEVEL), hit.rlike("^[A-Z0-9]+$"), hit.rlike("^[0-9]+$"), *[F.length(F.get(parts, F.lit(i))) for i in range(4)], *words,
        )]).alias("x"),
    )


def _with_proposals(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__text`` and ``__base`` gets ``__proposals``: those that meet no base span."""
    found = docs.withColumns({f"__g_{g}": _found("__text", NEEDS[g], p) for g, (_, p) in GENERATORS.items()})

    def proposals_of(name: str, rank: int) -> Column:
        free = F.filter(f"__g_{name}", lambda x: ~F.exists("__base", lambda b: (b["start"] < x["stop"]) & (b["stop"] > x["start"])))
        return F.transform(free, lambda x: _proposal(x, rank))

    proposals = [proposals_of(g, KINDS.index(kind)) for g, (kind, _) in GENERATORS.items()]
    return found.withColumn("__proposals", F.concat(*proposals)).drop(*(f"__g_{g}" for g in GENERATORS))


def _rendered(rank: Column, hit: Column, v: Column) -> Column:
    """A span in a form that misses the base patterns, chosen by ``v``. Digits, labels, prefixes and alphabets vary too, so that
    what the corpus's own addresses have in common isn't taken for the form."""
    one_of = lambda *forms: F.get(F.array(*forms), v % len(forms))
    half = F.shiftright(v, 8) % 2 == 0
    name, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    name = F.when(half, F.coalesce(F.nullif(F.regexp_replace(name, "[^A-Za-z]+", ""), F.lit("")), F.lit("info"))).otherwise(name)
    host = F.when(F.shiftright(v, 9) % 2 == 0, F.regexp_replace(F.substring_index(host, ".", -2), "^[0-9.]+", "")).otherwise(host)
    dotted = lambda text, by: F.regexp_replace(text, r"\.", by)
    email = one_of(*[F.concat(name, F.lit(at), dotted(host, dot)) for at, dot in ((" (at) ", " (dot) "), ("[at]", "."), (" at ", " dot "), (" @ ", "."), ("{at}", "{dot}"), (" [at] ", " [dot] "))])
    ip = one_of(*[dotted(hit, by) for by in ("[.]", " . ", "(dot)", ",", " [dot] ", " dot ")])
    card = one_of(*[F.regexp_replace(_digits(hit), "([0-9]{4})(?=[0-9])", f"$1{by}") for by in (".", "/", "_", "--", " / ", "  ")])
    bare, national = F.substring(hit, F.lit(2), F.length(hit)), F.regexp_replace(hit, r"^\+[0-9]{1,3}[ .-]?", "")
    apart = lambda by: F.regexp_replace(F.regexp_replace(national, "^[^0-9]+", ""), "[^0-9]+", by)
    phone = one_of(bare, F.concat(F.lit("00"), bare), national, apart("."), apart("-"), apart(" "), F.concat(F.lit("0"), apart("")), F.concat(F.lit("0"), F.substring(apart(""), F.lit(1), F.lit(2)), F.lit(" "), F.substring(apart(""), F.lit(3), F.lit(7))))
    mixed = F.translate(F.base64(F.unhex(F.sha2(hit, 256))), "/+=", "_-")
    made = F.substring(mixed, F.lit(1), F.greatest(F.length(hit) - 4, F.lit(16)))
    secret = F.when(half, hit).when(F.shiftright(v, 10) % 3 == 0, F.substring(F.upper(F.translate(mixed, "_-", "")), F.lit(1), F.lit(20))).otherwise(made)
    return F.when(rank == 0, email).when(rank == 1, ip).when(rank == 2, card).when(rank == 3, phone).otherwise(secret)


class _Made:
    """Parts of made-up text, all from a hash of a document's key and a number."""

    def __init__(self, key: Column, n: int):
        self.h = F.pmod(F.xxhash64(key, F.lit(n)), F.lit(1 << 40))
        self.hex = F.sha2(F.concat(key.cast("string"), F.lit(f"/{n}")), 256)
        self.mixed = F.translate(F.base64(F.unhex(self.hex)), "/+=", "_-")

    def number(self, shift: int, size: int, low: int = 0) -> Column:
        return F.shiftright(self.h, shift) % size + low

    def letters(self, start: int, size: int | Column) -> Column:
        return F.substring(F.translate(self.hex, "0123456789", "ghijklmnop"), F.lit(start), F.lit(size) if isinstance(size, int) else size)

    def digits(self, start: int, size: int) -> Column:
        """Digits, the first not 0."""
        all_digits = F.translate(self.hex, "abcdef", "123456")
        return F.concat((F.substring(all_digits, start, 1).cast("int") % 9 + 1).cast("string"), F.substring(all_digits, start + 1, size - 1))

    def one_of(self, shift: int, *forms: Column | str) -> Column:
        return F.get(F.array(*[F.lit(f) if isinstance(f, str) else f for f in forms]), (F.shiftright(self.h, shift) % len(forms)).cast("int"))


def _joined_by(by: Column, *parts: Column) -> Column:
    return F.concat(parts[0], *[x for p in parts[1:] for x in (by, p)])


def _piece(hit: Column, rank: int, before: Column | str = "") -> Column:
    return F.struct((F.lit(before) if isinstance(before, str) else before).alias("before"), hit.alias("hit"), F.lit(rank).alias("rank"))


def _decoy(key: Column, n: int) -> Column:
    """A number or name that is no personal data, in a common form, with what stands before it."""
    m = _Made(key, n)
    part = m.number
    # "%03d" and the like: every form is common in prose, logs or code
    forms = [
        F.format_string("%d-%02d-%02d %02d:%02d", part(3, 60, 1970), part(9, 12, 1), part(14, 28, 1), part(20, 24), part(26, 60)), F.format_string("978-%d-%04d-%04d-%d", part(3, 10), part(7, 10000), part(21, 10000), part(36, 10)),
        F.format_string("version %d.%d.%d.%d", part(3, 20), part(8, 40), part(14, 100), part(20, 3000, 256)), F.format_string("%d %03d %03d", part(3, 900, 1), part(10, 1000), part(20, 1000)), F.format_string("%d.%05d, %d.%05d", part(3, 90), part(10, 99999), part(20, 180), part(28, 4000)),
        F.format_string("%d", part(3, 90_000_000, 1_000_000)), F.concat_ws("-", *[F.substring(m.hex, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.format_string("met at %d. Then on", part(3, 12, 1)),
        m.letters(1, part(3, 20, 12).cast("int")), F.format_string("value_of_%s_part_%d", m.letters(1, 6), part(3, 100)), F.format_string("%d, %d, %d, %d", part(3, 90), part(10, 250), part(18, 90), part(25, 99)), F.format_string("%d %03d %03d %03d %03d", part(3, 90, 1), part(10, 1000), part(20, 1000), part(24, 1000), part(28, 1000)),
        F.format_string("%d.%03d.%03d", part(3, 900, 1), part(10, 1000), part(20, 1000)), F.format_string("%s.%s.%s.%s", m.digits(1, 4), m.digits(5, 4), m.digits(9, 4), F.concat(m.digits(13, 3), ((11 - _luhn_sum(F.concat(m.digits(1, 4), m.digits(5, 4), m.digits(9, 4), m.digits(13, 3), F.lit("0"))) % 10) % 10).cast("string"))),
        F.concat(m.letters(1, 5), F.lit(" at "), m.letters(7, 6), F.lit(" dot "), m.letters(15, part(20, 5, 2).cast("int")), F.lit(" ")), F.concat(F.lit("0x"), F.substring(m.hex, 1, 16)), F.format_string("%d.%03d.%03d,%02d EUR", part(3, 90, 1), part(10, 1000), part(20, 1000), part(28, 100)),
        F.format_string("%d.%03d,%02d; %d,%d,%d,%d", part(3, 90, 1), part(10, 1000), part(20, 100), part(3, 90), part(10, 99), part(20, 99), part(28, 99)), F.format_string("no. %s", m.digits(1, 18)), F.format_string("%d-%02d-%02d %02d:%02d:%02d", part(3, 60, 1970), part(9, 12, 1), part(14, 28, 1), part(20, 24), part(26, 60), part(31, 60)), F.format_string("%s-%s-%s", m.digits(1, 4), m.digits(5, 5), m.digits(10, 4)),
    ]
    named = m.one_of(33, "commit ", "sha256 ", "md5: ", "checksum=", "revision ", "sha1:", "digest: ", "etag \"", "")
    size = F.get(F.array(*map(F.lit, (40, 64, 32, 40, 16))), (part(3, 5)).cast("int"))
    digest = _piece(F.substring(m.hex, F.lit(1), size), -1, named)
    other = _piece(F.get(F.array(*forms), part(0, len(forms)).cast("int")), -1)
    return F.when(part(36, 3) == 0, digest).otherwise(other)


def _planted(key: Column, n: int) -> Column:
    """A made-up span of any kind in a form that misses the base patterns, with what stands before it."""
    m = _Made(key, n)
    part = m.number
    at, dot = m.one_of(3, " (at) ", "[at]", " at ", " AT ", " (AT) ", "\uFF20", "(at)", " @ ", " {at} "), m.one_of(7, " (dot) ", "[dot]", " dot ", " DOT ", " (DOT) ", ".", "(dot)", ".", "{dot}")
    name = F.concat(m.letters(1, part(11, 8, 3).cast("int")), m.one_of(15, "", ".", "_"), m.letters(12, 4))
    email = F.concat(name, at, m.letters(20, part(18, 8, 4).cast("int")), dot, m.one_of(22, "com", "org", "net", "de", "info", "co.uk"))
    email = F.when(part(26, 4) == 0, F.upper(email)).otherwise(email)
    ip = _joined_by(m.one_of(3, "[.]", " . ", "(dot)", " [dot] ", " dot ", "[dot]", "(.)"), part(7, 223, 1).cast("string"), part(14, 256).cast("string"), part(21, 256).cast("string"), part(28, 254, 1).cast("string"))
    fifteen = m.digits(1, 15)
    sixteen = F.concat(fifteen, ((10 - _luhn_sum(F.concat(fifteen, F.lit("0"))) % 10) % 10).cast("string"))
    card = _joined_by(m.one_of(3, ".", "/", "_", "--", " / ", "  ", ":"), *[F.substring(sixteen, a, 4) for a in (1, 5, 9, 13)])
    phone = m.one_of(
        3, F.format_string("%s-%s-%s", m.digits(1, 3), m.digits(4, 3), m.digits(7, 4)), F.format_string("(%s) %s-%s", m.digits(1, 3), m.digits(4, 3), m.digits(7, 4)), F.format_string("%s.%s.%s", m.digits(1, 3), m.digits(4, 3), m.digits(7, 4)),
        F.format_string("0%s %s", m.digits(1, 2), m.digits(4, 7)), F.format_string("0049 %s %s", m.digits(1, 3), m.digits(4, 7)), F.format_string("00%s-%s-%s", m.digits(1, 2), m.digits(4, 3), m.digits(7, 7)), F.format_string("0%s/%s", m.digits(1, 3), m.digits(4, 6)),
        F.format_string("0%s", m.digits(1, 10)), F.format_string("%s %s %s", m.digits(1, 3), m.digits(4, 3), m.digits(7, 4)),
    )
    called = m.one_of(13, "", "", "call ", "tel. ", "phone: ", "Tel ", "fax ", "mobile: ")
    value = m.one_of(3, F.substring(m.hex, 1, 40), F.substring(m.hex, 1, 32), m.hex, F.substring(m.mixed, 1, 24), F.substring(m.mixed, 1, 40), F.substring(m.mixed, 1, 16), m.digits(1, 18), F.upper(F.substring(F.translate(m.mixed, "_-", ""), 1, 20)))
    assigned = F.concat(m.one_of(7, "token", "api_key", "secret", "password", "auth_token", "access_key", "SECRET_KEY", "passwd", "bearer", "apikey"), m.one_of(12, "=", " = ", ": ", "=\"", " = \"", "='", ":"))
    access = F.concat(F.lit("AKIA"), F.substring(F.upper(F.translate(m.mixed, "_-", "")), 1, 16))
    secret = F.when(part(18, 8) == 0, _piece(access, 4, m.one_of(22, "", "id ", "aws "))).otherwise(_piece(value, 4, assigned))
    return F.get(F.array(_piece(email, 0), _piece(ip, 1), _piece(card, 2), _piece(phone, 3, called), secret, secret), part(36, 6).cast("int"))


def _rewritten(docs: DataFrame) -> DataFrame:
    """``__key``, ``__text`` with base spans and announced secrets in other forms and made-up spans and decoys at the end, ``__truth``: start, rank and stop of those."""
    text, kind = F.col("__text"), "array<struct<start:int,rank:int,stop:int>>"
    secret = KINDS.index("secret")
    announced = F.filter("__secrets", lambda x: _cue(secret, x["hit"], x["before"], F.lit(0)))
    spans = F.array_sort(F.concat("__base", F.transform(announced, lambda x: F.struct(x["start"].alias("start"), F.lit(secret).alias("rank"), x["stop"].alias("stop")))))
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"), F.expr(f"cast(array() as {kind})").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0)))
        hit = F.substring(text, s["start"] + 1, s["stop"] - s["start"])
        form = _rendered(s["rank"], hit, F.pmod(F.xxhash64(F.col("__key"), s["start"], F.lit(1)), F.lit(1 << 20)).cast("int"))
        at = F.length(acc["out"]) + F.length(gap)
        span = F.struct(at.cast("int").alias("start"), s["rank"].alias("rank"), (at + F.length(form)).cast("int").alias("stop"))
        return F.when(s["start"] < acc["pos"], acc).otherwise(F.struct(s["stop"].alias("pos"), F.concat(acc["out"], gap, form).alias("out"), F.concat(acc["spans"], F.array(span)).alias("spans")))

    marked = docs.withColumn("__secrets", _found("__text", NEEDS["secret"], GENERATORS["secret"][1])).withColumn("__marks", spans)
    done = marked.withColumn("__done", F.aggregate("__marks", zero, step))
    rest = F.substring(text, F.col("__done.pos") + 1, F.length(text))
    pieces = F.array(*[f(F.col("__key"), 10 * i + j) for i in range(PLANTED) for j, f in enumerate((_planted, _decoy))])
    begun = done.select("__key", F.concat("__done.out", rest).alias("__text"), F.col("__done.spans").alias("__truth"), pieces.alias("__pieces"))
    start = F.struct(F.col("__text").alias("out"), F.col("__truth").alias("spans"))

    def put(acc: Column, p: Column) -> Column:
        at = F.length(acc["out"]) + F.length(p["before"]) + 2
        span = F.struct(at.cast("int").alias("start"), p["rank"].alias("rank"), (at + F.length(p["hit"])).cast("int").alias("stop"))
        return F.struct(F.concat(acc["out"], F.lit("; "), p["before"], p["hit"]).alias("out"), F.when(p["rank"] >= 0, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    put_in = begun.withColumn("__put", F.aggregate("__pieces", start, put))
    return put_in.select("__key", F.concat("__put.out", F.lit(" ;")).alias("__text"), F.col("__put.spans").alias("__truth"))


class Trees:
    """For each kind (by rank) boosted trees of two levels over the proposals' features, their bias and a threshold."""

    def __init__(self, bias: dict[int, float], trees: dict[int, list[tuple]], thresholds: dict[int, float]):
        self.bias, self.trees, self.thresholds = bias, trees, thresholds

    def logit(self, rank: int, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias[rank])
        for (f, cut), low, high in self.trees[rank]:
            for own, (g, c, a, b) in ((x[:, f] <= cut, low), (x[:, f] > cut, high)):
                out += np.where(own, np.where(x[:, g] <= c, a, b), 0.0)
        return out

    def column(self, rank: int, x: Column) -> Column:
        """The same sum as an expression over the feature array; the trees are a literal array, which is folded along."""
        names = ("f", "cut", "g", "c", "a", "b", "k", "d", "p", "q")
        rows = [dict(zip(names, (f, cut, *low, *high))) for (f, cut), low, high in self.trees[rank]]
        ddl = "array<struct<f:int,cut:double,g:int,c:double,a:double,b:double,k:int,d:double,p:double,q:double>>"
        side = lambda t, g, c, a, b: F.when(F.get(x, t[g]) <= t[c], t[a]).otherwise(t[b])
        step = lambda acc, t: acc + F.when(F.get(x, t["f"]) <= t["cut"], side(t, "g", "c", "a", "b")).otherwise(side(t, "k", "d", "p", "q"))
        return F.aggregate(F.from_json(F.lit(json.dumps(rows)), ddl), F.lit(float(self.bias[rank])), step)


def _stump(bins: np.ndarray, g: np.ndarray, h: np.ndarray, n_bins: int, ridge: float = 1.0) -> tuple[int, int, float, float]:
    """The best cut: feature, last bin on the left, steps of both sides."""
    n, features = bins.shape
    cell = (bins + np.arange(features) * n_bins).ravel()
    left_g = np.bincount(cell, np.repeat(g, features), features * n_bins).reshape(features, n_bins).cumsum(1)
    left_h = np.bincount(cell, np.repeat(h, features), features * n_bins).reshape(features, n_bins).cumsum(1)
    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
    won = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge)
    f, b = np.unravel_index(won.argmax(), won.shape)
    return int(f), int(b), float(left_g[f, b] / (left_h[f, b] + ridge)), float((all_g - left_g)[f, b] / ((all_h - left_h)[f, b] + ridge))


def _boosted(x: np.ndarray, y: np.ndarray, trees: int) -> tuple[float, list[tuple]]:
    share = (y.sum() + 1) / (len(y) + 2)
    bias, grown = float(np.log(share / (1 - share))), []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    edge = lambda f, b: float(cuts[f][b]) if b < len(cuts[f]) else np.inf
    z = np.full(len(y), bias)
    for _ in range(trees):
        p = _sigmoid(z)
        g, h = y - p, p * (1 - p)
        f, b, _, _ = _stump(bins, g, h, BINS)
        sides = []
        for own in (bins[:, f] <= b, bins[:, f] > b):
            k, c, low, high = _stump(bins[own], g[own], h[own], BINS) if own.any() else (0, 0, 0.0, 0.0)
            sides.append((k, min(edge(k, c), 1e300), RATE * low, RATE * high))
            z[own] += np.where(bins[own][:, k] <= c, RATE * low, RATE * high)
        grown.append(((f, min(edge(f, b), 1e300)), *sides))
    return bias, grown


def fit(x: np.ndarray, y: np.ndarray, kind: np.ndarray, held: np.ndarray, *, trees: int = TREES) -> Trees:
    """Boost each kind on the proposals that aren't ``held``; on the held ones, take the lowest threshold that keeps PRECISION, half-way to the next score.

    A kind without positives and negatives to learn from, or without held-out positives, gets no threshold, so nothing of
    it is added.
    """
    model = Trees({}, {}, {})
    for k in np.unique(kind).tolist():
        own, kept = (kind == k) & ~held, (kind == k) & held
        if not y[own].any() or not y[kept].any():
            continue
        model.bias[k], model.trees[k] = _boosted(x[own], y[own], trees)
        scores = model.logit(k, x[kept])
        order = np.argsort(-scores, kind="stable")
        s, right = scores[order], np.cumsum(y[kept][order])
        ends = np.append(s[1:] < s[:-1], True)
        good = np.flatnonzero(ends & (right / np.arange(1, len(s) + 1) >= PRECISION) & (right > 0))
        if len(good):
            model.thresholds[k] = float((s[good[-1]] + s[good[-1] + 1]) / 2 if good[-1] + 1 < len(s) else s[good[-1]])
    return model


def _sample(docs: DataFrame, id_col: str, text_col: str, sample_docs: int) -> DataFrame:
    """``__key``, ``__text`` of about ``sample_docs`` documents, by hash of their ids: for each test of SAMPLED its share.

    About POOL_DOCS documents are tested, once; which are taken follows from the counts, so no rows are sorted or gathered to choose.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__key"), whole_text(text_col).alias("__text"))
    h, space = F.pmod(F.xxhash64("__key"), F.lit(1 << 40)), 1 << 40
    pool = rows.where(h < int(space * min(1.0, POOL_DOCS / max(rows.count(), 1))))
    tested = persisted(pool.select("__key", F.pmod(F.xxhash64("__key", F.lit("taken")), F.lit(1 << 30)).alias("h"), *[F.col("__text").rlike(p).alias(f"t{i}") for i, p in enumerate(SAMPLED)]))
    counts = tested.agg(*[F.count_if(f"t{i}") for i in range(len(SAMPLED))]).first()
    wanted = [sample_docs // 10] * (len(SAMPLED) - 1) + [sample_docs // 2]
    taken = reduce(lambda a, b: a | b, [F.col(f"t{i}") & (F.col("h") < int((1 << 30) * min(1.0, w / max(n, 1)))) for i, (w, n) in enumerate(zip(wanted, counts))])
    chosen = tested.where(taken).select(F.col("__key").alias("__chosen")).distinct()
    met = rows.join(F.broadcast(chosen), F.col("__key") == F.col("__chosen"))
    return persisted(met.groupBy("__key", F.md5("__text")).agg(F.first("__text").alias("__text")).select("__key", "__text").limit(2 * sample_docs))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_proposals: int = SAMPLE_PROPOSALS) -> Trees:
    """Fit on the proposals of about ``sample_docs`` documents, at most ``sample_proposals`` of them.

    The sample is written before anything is proposed, so that generators run on it alone. A third of its documents are held out.
    """
    sample = _sample(docs, id_col, text_col, sample_docs)
    rows = _with_proposals(_with_base(_rewritten(_with_base(sample))))
    shared = lambda t, p: F.least(t["stop"], p["stop"]) - F.greatest(t["start"], p["start"])
    same = lambda t, p: (t["rank"] == p["rank"]) & (shared(t, p) >= 0.8 * F.greatest(t["stop"] - t["start"], p["stop"] - p["start"]))
    secret = KINDS.index("secret")
    known = F.transform("__proposals", lambda p: F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["x"].alias("x"), p["cue"].alias("cue"), F.exists("__truth", lambda t: same(t, p)).alias("written")))
    told = F.transform(F.filter(known, lambda p: p["written"] | ~p["cue"] | (p["rank"] == secret)), lambda p: F.struct(p["start"], p["rank"], p["x"], (p["written"] | p["cue"] & (p["rank"] == secret)).alias("y")))
    flat = rows.select("__key", F.explode(told).alias("p")).select("__key", "p.*", (F.pmod(F.xxhash64("__key", F.lit("held")), F.lit(3)) == 2).alias("held"))
    found = flat.orderBy(F.xxhash64("__key", "start", "rank"), "__key", "start", "rank").limit(sample_proposals).drop("__key", "start").collect()
    x = np.array([r["x"] for r in found], dtype=float)
    return fit(x.reshape(len(found), -1 if len(found) else 1), np.array([r["y"] for r in found], dtype=float), np.array([r["rank"] for r in found], dtype=int), np.array([r["held"] for r in found], dtype=bool))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None, with_text: bool = False) -> DataFrame:
    """Spans of personal data in each text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; with
    ``with_text`` also redacted, the text with every span as its kind in brackets.

    The counts and base_sha256 are of the base spans. ``spans`` are these and the added ones as kind:start:end (code
    points, end exclusive), by start, then kind, comma-joined. ``model`` chooses the added ones; without it one is fitted.

    A null text counts as empty and has no spans. Rows are judged one by one, so repeated rows come out as often; an empty
    table gives an empty result. Other columns are not read.
    """
    model = model or train(docs, id_col=id_col, text_col=text_col)
    rows = _with_base(docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("__text")))
    ranked = [(k, t) for k, t in sorted(model.thresholds.items())]
    if ranked:
        rows = _with_proposals(rows)
        own = lambda p: F.coalesce(*[F.when(p["rank"] == k, model.column(k, p["x"])) for k, _ in ranked])
        scored = F.transform("__proposals", lambda p: F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["stop"].alias("stop"), own(p).alias("score")))
        enough = lambda p: F.coalesce(*[F.when(p["rank"] == k, p["score"] >= t) for k, t in ranked], F.lit(False))
        rows = rows.withColumn("__chosen", F.filter(scored, enough)).drop("__proposals")
        beats = lambda q, p: (q["start"] < p["stop"]) & (q["stop"] > p["start"]) & ((q["score"] > p["score"]) | (q["score"] == p["score"]) & (F.struct(q["start"], q["rank"], q["stop"]) < F.struct(p["start"], p["rank"], p["stop"])))
        added = F.transform(F.filter("__chosen", lambda p: ~F.exists("__chosen", lambda q: beats(q, p))), lambda p: F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["stop"].alias("stop")))
        rows = rows.withColumn("__all", F.array_sort(F.concat("__base", added))).drop("__chosen")
    else:
        rows = rows.withColumn("__all", F.col("__base"))

    def count_of(rank: int, kind: str) -> Column:
        return F.size(F.filter("__base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")

    counts = [count_of(i, k) for i, k in enumerate(KINDS[:4])]
    out = [F.col("doc_id"), *counts, F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"), _joined(F.col("__all")).alias("spans")]
    if with_text:
        names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
        step = lambda acc, s: F.when(s["stop"] <= acc["pos"], acc).otherwise(F.struct(s["stop"].alias("pos"), F.concat(acc["out"], F.substring(F.col("__text"), acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0))), F.get(names, s["rank"])).alias("out")))
        out.append(F.aggregate("__all", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("__text"), acc["pos"] + 1, F.length("__text")))).alias("redacted"))
    return rows.select(*out)
