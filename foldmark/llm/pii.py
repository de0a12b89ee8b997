"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

All of it is built-in functions on one row at a time: no shuffle, no Python. Spans are counted in code points, the end
exclusive. Each pattern goes over a text once, and the time is linear in the text and its spans. The patterns are written with possessive repeats and a look-behind, which keeps matches as they
are but makes the time linear and the stack flat on very long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmark.llm._shared import free
from foldmark.llm._spans import bind, fold, matches

#: Countries by the length of their IBANs, also those that use IBANs without being registered; BF has had two lengths.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BF BI CF CG CM DJ FR GA GQ GR IT KM MC MG SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_COUNTRY = "|".join(f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
_COUNTRIES = "|".join(c for codes in IBAN_LENGTHS.values() for c in codes.split())
#: As long as the country's IBANs are, so that a word or number after it stays out; of other countries, runs without spaces.
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_BY_COUNTRY}|(?!{_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}+)(?![A-Za-z0-9])"
#: kind: (pattern, a cheap test of whether the text can match at all). The order is that of the kinds in results.
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11,}+", None),  # a run of fewer digits would be dropped
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "iban": (IBAN, None),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
}
BASE = ("email", "ip", "card", "phone")
#: Words that, within NEAR code points before a span, speak for its kind; each list is a regular expression.
CONTEXT_WORDS = {
    "email": "e-?mail|mail|contact|write to|kontakt|correo|courriel",
    "ip": "ip|address|host|server|client|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte|payment",
    "phone": "phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone",
    "iban": "iban|account|bank|konto|cuenta|compte|transfer",
    "ssn": "ssn|social security|tax id",
}
#: Whole words only. Which letters end a word is said here, as \b differs between versions of Java.
CONTEXT = {kind: rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])" for kind, words in CONTEXT_WORDS.items()}
NEAR = 40
#: What a span scores by its pattern and checksum alone; words nearby add CONTEXT_GAIN.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.85, "phone": 0.75, "iban": 0.95, "ssn": 0.4}
CONTEXT_GAIN = 0.3
#: Kinds beyond BASE count from this score on.
THRESHOLD = 0.6

SPAN = "struct<kind:string,start:long,end:long,text:string,score:double>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn check."""
    one = F.reverse(digits)
    value = lambda i: F.substr(one, i, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, twice(value(i))).otherwise(value(i)))
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1 when its first four characters go last and letters count from 10."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(s, r"\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        n = F.length(_digits(s))
        return F.when(n.between(12, 19), luhn(_digits(s))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "iban":
        bare = F.regexp_replace(s, " ", "")
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    if kind == "ssn":
        return ~s.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """All spans of one kind that pass its checks, as an array of (kind, start, end, text, score)."""
    pattern, need = PATTERNS[kind]

    def scored(x: Column) -> Column:
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(x["before"].rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), score.alias("score"))

    out = F.transform(matches(text, pattern, lambda x, _: _valid(kind, x), NEAR), scored)
    if kind not in BASE:
        out = F.filter(out, lambda x: x["score"] >= THRESHOLD)
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(F.contains(text, F.lit(need)), out).otherwise(none) if need else out


def span_columns(docs: DataFrame, out_prefix: str = "pii_") -> dict[str, str]:
    """The names of the columns that find_spans() adds, by kind: out_prefix and the kind, with underscores where that is taken."""
    return dict(zip(PATTERNS, free(docs, tuple(out_prefix + k for k in PATTERNS))))


def find_spans(docs: DataFrame, text_col: str = "text", out_prefix: str = "pii_") -> DataFrame:
    """docs with an array column pii_<kind> for each kind (see span_columns()). Null texts are empty; all other columns pass
    through. Per kind spans are leftmost and don't overlap; spans of two kinds may. A base span is kept whatever it
    scores; iban needs its checksum, and ssn, which has none, needs words nearby."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({name: spans_of(text, kind) for kind, name in span_columns(docs, out_prefix).items()})


def digests(docs: DataFrame) -> DataFrame:
    """The counts and digests of each document's spans: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = find_spans(docs.select("doc_id", "text"))
    rank = {k: i for i, k in enumerate(PATTERNS)}

    def joined(kinds) -> Column:
        ranked = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(rank[k]).alias("rank"), x["end"].alias("end"), F.lit(k).alias("kind"))
        each = [F.transform(F.col("pii_" + k), ranked(k)) for k in kinds]
        return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.size("pii_" + k).cast("long").alias("n_" + k) for k in BASE]
    more = [F.size("pii_" + k).cast("long").alias("n_" + k) for k in PATTERNS if k not in BASE]
    return rows.select("doc_id", *counts, F.sha2(joined(BASE).cast("binary"), 256).alias("base_sha256"), joined(PATTERNS).alias("spans"), *more)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each found span's text replaced by <KIND>; of overlapping spans the leftmost, then the longest, goes."""
    names, found = docs.columns, span_columns(docs, "__pii_")
    rows = find_spans(docs, text_col, "__pii_")
    spans = F.array_sort(F.flatten(F.array(*[F.transform(F.col(name), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("last"), x["kind"].alias("kind"))) for name in found.values()])))
    blocks = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    done = bind(F.struct(spans.alias("spans"), blocks.alias("blocks")), _replaced)
    return rows.withColumn(text_col, F.when(F.col(text_col).isNull(), F.col(text_col)).otherwise(done)).select(*[F.col(f"`{c}`") for c in names])


#: Code points of the pieces out of which redacted() puts a text together again.
PIECE = 1024


def _replaced(x: Column) -> Column:
    """The text of x.blocks, pieces of PIECE code points, with x.spans (start, last, kind), in order, replaced."""
    blocks, n = x["blocks"], F.size(x["spans"])
    total = F.when(F.size(blocks) > 0, (F.size(blocks) - 1) * PIECE + F.length(F.element_at(blocks, -1))).otherwise(F.lit(0)).cast("long")

    def cut(a: Column, b: Column) -> Column:
        def part(k: Column) -> Column:
            first = F.greatest(a - k * PIECE, F.lit(0).cast("long"))
            return F.substr(F.get(blocks, k), (first + 1).cast("int"), (F.least(b - k * PIECE, F.lit(PIECE).cast("long")) - first).cast("int"))

        block = lambda v: F.call_function("div", v, F.lit(PIECE).cast("long")).cast("int")
        return F.when(a < b, F.transform(F.sequence(block(a), block(F.greatest(b - 1, a))), part)).otherwise(F.array().cast("array<string>"))

    def step(at: Column, i: Column) -> tuple[Column, Column]:
        span = F.get(x["spans"], i)
        put = F.concat(cut(at, span["start"]), F.array(F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">"))))
        rest = F.when(i < n, F.when(span["start"] >= at, put).otherwise(F.array().cast("array<string>"))).otherwise(cut(at, total))
        return F.when((i < n) & (span["start"] >= at), -span["last"]).otherwise(at), rest

    return F.array_join(fold(n + 1, F.lit(0).cast("long"), step, "string"), "")  # the last step puts out what is left


#: A pattern of each kind for DuckDB, whose expressions know no look-around, and the form of text t that it is for: what a boundary
#: must not touch are word characters there, all else is none. Lengths stay, so places do, too.
_SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "t"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "t"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "t"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "t"),
    "iban": (rf"\b(?:{_BY_COUNTRY}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}})\b", "translate(t, '_', '-')"),
    "ssn": (r"\b[0-9]{3}_[0-9]{2}_[0-9]{4}\b", "translate(regexp_replace(t, '[^0-9-]', ' ', 'g'), '-', '_')"),
}
_SQL_MATCHES = " UNION ALL ".join(
    f"SELECT r, '{kind}' AS kind, {rank} AS rank, string_split(regexp_replace({form}, '{pattern}', chr(64976) || '\\0' || chr(64976), 'g'), chr(64976)) AS p FROM d"
    for rank, (kind, (pattern, form)) in enumerate(_SQL_KINDS.items())
)
_SQL_LENGTH = "CASE " + " ".join(f"WHEN list_contains({codes.split()!r}, s[1:2]) THEN {n}" for n, codes in IBAN_LENGTHS.items()) + " END"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, replace(coalesce(text, ''), chr(64976), chr(64977)) AS t FROM documents),
p AS ({_SQL_MATCHES}),
u AS (SELECT r, kind, rank, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM p WHERE len(p) > 1),
w AS (SELECT *, sum(length(s)) OVER (PARTITION BY r, kind ORDER BY i)::BIGINT AS b FROM u),
m AS (SELECT r, kind, rank, s, b - length(s) AS a, b, regexp_replace(s, '[^0-9]', '', 'g') AS g, replace(s, ' ', '') AS n FROM w WHERE i % 2 = 0),
x AS (SELECT m.* FROM m JOIN d USING (r) WHERE CASE kind
  WHEN 'ip' THEN len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS BIGINT), 0) > 255)) = 0
  WHEN 'card' THEN length(g) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(g)), lambda i: CASE WHEN i % 2 = 0 THEN reverse(g)[i + 1]::INT ELSE 2 * reverse(g)[i + 1]::INT - CASE WHEN reverse(g)[i + 1]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN 'phone' THEN length(g) BETWEEN 9 AND 15
  WHEN 'iban' THEN coalesce(length(n) = {_SQL_LENGTH}, s = n AND length(n) BETWEEN 15 AND 34)
    AND list_reduce(list_prepend(0, list_transform(string_split(n[5:] || n[1:4], ''), lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)), lambda a, c: (a * CASE WHEN c < 10 THEN 10 ELSE 100 END + c) % 97) = 1
  WHEN 'ssn' THEN NOT regexp_matches(s, '^(000|666|9)|_00_|_0000$') AND regexp_matches(substring(t, greatest(a - {NEAR}, 0) + 1, least(a, {NEAR})), '(?i)(^|[^\p{{L}}\p{{N}}_])({CONTEXT_WORDS["ssn"]})($|[^\p{{L}}\p{{N}}_])')
  ELSE true END)
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in PATTERNS)},
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN x USING (r) GROUP BY r, doc_id
"""
