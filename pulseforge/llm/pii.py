r"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is a built-in column expression. `regexp_extract_all` gives the matches of a kind and `split` by
the same pattern gives the text between them, so the running sum of both lengths is each match's offset. The sums run
over blocks of about the root of the number of matches, first of the blocks and then within each: a fold that appends to an
array copies it, and so copies n times the root of n elements in all. Characters near a span are looked up in pieces of the text,
cut in two steps, since finding a place in a string reads it from its start.

The base kinds are email, ip, card and phone. Added kinds are iban (in one piece or in groups of four, confirmed by the
mod-97 rule), ssn and secret (a long hexadecimal string); the last two have no checksum, so they need a context word.
Context is CONTEXT_CHARS characters on either side. Patterns are written with possessive quantifiers where nothing
can be given back, which keeps matching linear and free of recursion on very long runs; `\G` lets a match
start in the middle of a run only where the previous match ended, as a plain leftmost search would.

Defined results
- Null text counts as empty: no spans, and base_sha256 is that of the empty string.
- Repeated rows and null ids are each returned; an empty table gives an empty result. Offsets are code points, end exclusive.
- Very long texts are read whole; the time for a text of n characters and matches grows with n times the root of n.
- Only the id and text columns are read, so other columns may have any name.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pattern of each kind, in the order in which spans are listed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"[A-Fa-f0-9]{32,64}",
}
BASE = ("email", "ip", "card", "phone")
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-", "secret": None}
#: Score of a confirmed span, and the words near it that add CONTEXT_GAIN.
SCORES = {"email": 0.7, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.9, "ssn": 0.2, "secret": 0.3}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|tax id",
    "secret": "token|secret|key|password|auth",
}
CONTEXT_GAIN, CONTEXT_CHARS, LEAST_SCORE = 0.3, 40, 0.45
#: Characters of a text's pieces, and of the stretches they are cut from; matches up to which one fold is enough.
PIECE, STRETCH, FEW = 1 << 11, 1 << 18, 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def digit(i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + digit(i))
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(False)


def _mod97(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _octets(m: Column) -> Column:
    def fits(p: Column) -> Column:
        q = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(F.length(q) <= 3, F.substring(q, 1, 3).cast("int") <= 255).otherwise(False)

    return F.forall(F.split(m, r"\."), fits)


def _pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters, cut from stretches of STRETCH: an array, empty for an empty text."""
    cut = lambda t, n: F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / n).cast("int")), lambda k: F.substring(t, k * n + 1, F.lit(n)))
    stretched = F.flatten(F.transform(cut(text, STRETCH), lambda t: cut(t, PIECE)))
    return F.when(F.length(text) > STRETCH, stretched).when(F.length(text) > PIECE, cut(text, PIECE)).otherwise(F.array(text))


def _part(pieces: Column, start: Column, n: Column | int) -> Column:
    """n characters, PIECE at most, from start, or as many as there are."""
    k = F.floor(start / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
    return F.substring(two, start % PIECE + 1, F.lit(n) if isinstance(n, int) else n)


def _alone(text: Column, s: Column, e: Column) -> Column:
    before = F.when(s > 0, _part(text, s - 1, 1)).otherwise("")
    return ~F.concat(before, F.lit(" "), _part(text, e, 1)).rlike("[A-Za-z0-9]")


def _confirmed(kind: str, text: Column, x: Column) -> Column:
    """text: in pieces."""
    m = x["m"]
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return F.when(_alone(text, x["s"], x["e"]), _mod97(m)).otherwise(False)
    if kind in ("ssn", "secret"):
        return _alone(text, x["s"], x["e"])
    return F.lit(True)


def _gaps(between: Column, matches: Column) -> Column:
    """array<struct<g, n, m>>: each match with its length and that of the text before it; null if there are none."""
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m")))
    return F.when(F.size(matches) > 0, pairs)


def _spans(pairs: Column) -> Column:
    """array<struct<s, e, m>> of all matches of the kind. pairs, what _gaps made, is a column, as a lambda would make it anew each time."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + x["n"]
        return F.struct(e.alias("at"), F.concat(acc["o"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("o"))

    def fold(some: Column, start: Column) -> Column:
        return F.aggregate(some, F.struct(start.alias("at"), none.alias("o")), step, lambda acc: acc["o"])

    wide = F.ceil(F.sqrt(F.size(pairs))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / wide).cast("int")), lambda k: F.slice(pairs, k * wide + 1, wide))
    total = lambda some: F.aggregate(some, F.lit(0), lambda n, x: n + x["g"] + x["n"])
    begin = lambda acc, some: F.struct((acc["at"] + total(some)).alias("at"), F.concat(acc["o"], F.array(acc["at"])).alias("o"))
    starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("o")), begin, lambda acc: acc["o"])
    found = F.flatten(F.zip_with(blocks, starts, fold))
    return F.when(F.size(pairs) > FEW, found).when(pairs.isNotNull(), fold(pairs, F.lit(0))).otherwise(none)


def _score(kind: str, text: Column, s: Column, e: Column) -> Column:
    first = F.greatest(s - CONTEXT_CHARS, F.lit(0))
    around = F.concat(_part(text, first, s - first), F.lit("\n"), _part(text, e, CONTEXT_CHARS))
    near = F.lower(around).rlike(CONTEXT[kind])
    return F.least(F.lit(SCORES[kind]) + F.when(near, CONTEXT_GAIN).otherwise(0.0), F.lit(1.0))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, found: array<struct<kind, s, e, m, score>> by kind as in PATTERNS, then start; and the text, if asked for."""
    carried = ["doc_id", "text"] if with_text else ["doc_id"]
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    nothing = F.array().cast("array<string>")

    def matches(kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0)
        return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(nothing) if NEEDS[kind] else found

    out = out.select("*", *[matches(k).alias(f"m_{k}") for k in PATTERNS])
    out = out.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split(text, PATTERNS[k], -1)).alias(f"p_{k}") for k in PATTERNS])
    out = out.select("doc_id", "text", *[_gaps(F.col(f"p_{k}"), F.col(f"m_{k}")).alias(f"g_{k}") for k in PATTERNS])
    out = out.select("doc_id", "text", _pieces(text).alias("pieces"), *[_spans(F.col(f"g_{k}")).alias(f"s_{k}") for k in PATTERNS])
    pieces = F.col("pieces")

    def kept(kind: str) -> Column:
        good = F.filter(F.col(f"s_{kind}"), lambda x: _confirmed(kind, pieces, x))
        scored = F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), _score(kind, pieces, x["s"], x["e"]).alias("score")))
        return scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= LEAST_SCORE)

    out = out.select(*carried, *[kept(k).alias(f"k_{k}") for k in PATTERNS])
    return out.select(*carried, F.concat(*[F.col(f"k_{k}") for k in PATTERNS]).alias("found"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """As the columns say; scores are in hundredths, in the spans' order."""
    found = F.col("found")
    of_kind = lambda k: F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long")
    place = lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])
    base = F.filter(found, lambda x: x["kind"].isin(*BASE))
    return find_pii(docs).select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, place), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(found, place), ",").alias("spans"),
        F.size(found).cast("long").alias("n_spans"),
        F.array_join(F.transform(found, lambda x: F.round(x["score"] * 100).cast("int")), ",").alias("scores"),
    )


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with every found span replaced by its kind in angle brackets; of overlapping spans the first wins."""
    by_place = lambda a, b: F.coalesce(F.nullif(a["s"] - b["s"], F.lit(0)), b["e"] - a["e"])
    found = find_pii(docs, id_col, text_col, with_text=True).withColumn("found", F.array_sort("found", by_place))
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        new = F.struct(x["e"].alias("at"), F.concat(acc["o"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("<"), x["kind"], F.lit(">")).alias("o"))
        return F.when(x["s"] >= acc["at"], new).otherwise(acc)

    end = lambda acc: F.concat(acc["o"], F.substring(text, acc["at"] + 1, F.length(text)))
    return found.select("doc_id", F.aggregate("found", F.struct(F.lit(0).alias("at"), F.lit("").alias("o")), step, end).alias("text"))
