"""Operator 2: personal data by weak supervision, in DataFrame functions only.

Regular expressions find the base kinds (e-mail, ip, card, phone) and further candidates (secrets, written-out e-mail
addresses, other numbers). Four labelers vote on each candidate (+1, 0 or -1): its regular expression's strict form, a
gazetteer (cue words, given names, places and organisations before it, or words that speak against it), the signs around
it, and the spread of its characters. Expectation-maximisation over the counts of vote patterns (81 at most) estimates how
reliable each labeler is, as one SQL expression over one row; the posteriors then train the span classifier, a naive Bayes
over the candidate's own features, with one small aggregation. Base spans always stand; the classifier adds spans to them.

Long texts stay cheap: they are cut once into pieces of equal length, in which what stands around a span is looked up, and
overlaps are found by running largest ends over sorted spans, block by block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, written

KINDS = ("email", "ip", "card", "phone")
MORE = ("secret", "handle", "number")
# Equal to the plain patterns, but linear: a match starts where a run starts (or at the last match's end), and repeats
# don't give back what they took.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_=-])"
_HANDLE = rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_NUMBER = r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
_EXTRA = f"{_SECRET}|{_HANDLE}|{_NUMBER}"
# The gazetteer, in the four languages of the tables.
_CUES = "token|key|secret|password|passwd|pwd|api|auth|bearer|credential|login|user|username|account|mail|e-mail|email|contact|call|phone|tel|fax|mobile|cell|whatsapp|card|visa|mastercard|amex|credit|debit|iban|ssn|passport|ip|host|server|address|name|passwort|kennwort|schlüssel|benutzer|konto|karte|kreditkarte|telefon|handy|rufnummer|anruf|adresse|kontakt|motdepasse|clé|compte|carte|téléphone|portable|courriel|adresse|contraseña|clave|cuenta|tarjeta|teléfono|móvil|correo|dirección|contacto"
_NAMES = "james|john|robert|michael|william|david|richard|thomas|mary|patricia|jennifer|linda|elizabeth|susan|sarah|karen|anna|peter|hans|klaus|jürgen|wolfgang|ursula|monika|sabine|petra|jean|pierre|michel|marie|nathalie|isabelle|françois|juan|josé|carlos|antonio|carmen|maría|ana|lucía|mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|señor|señora"
_PLACES = "london|paris|berlin|madrid|vienna|zurich|munich|hamburg|lyon|marseille|barcelona|sevilla|new york|boston|chicago|toronto|sydney|dublin|street|road|avenue|straße|platz|rue|calle|plaza"
_ORGANISATIONS = "inc|ltd|llc|corp|company|gmbh|ag|kg|sarl|sa|sl|bank|university|hospital|office|support|team|sales|service"
_AGAINST = "version|release|v|isbn|issn|doi|license|licence|chapter|section|page|pages|year|copyright|commit|sha|md5|checksum|figure|table|article|volume|kapitel|seite|abschnitt|chapitre|capítulo|página|année|año|jahr"
_BEFORE = {
    1: rf"(?iu)\b(?:{_CUES})\b[^\p{{L}}\p{{N}}]*$",
    2: rf"(?iu)\b(?:{_NAMES}|{_PLACES}|{_ORGANISATIONS})\b[^\p{{L}}\p{{N}}]*$",
    -1: rf"(?iu)\b(?:{_AGAINST})\b[^\p{{L}}\p{{N}}]*$",
}
_PIECE = 4096
_LABELERS = 4
_FEATURES = ("kind", "length", "digits", "left", "right", "upper", "different", "before")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(values: Column, zero: Column, op, inclusive: bool = True, block: int = 256) -> Column:
    """``op`` of all elements up to each one (or before it): in blocks, so that long arrays aren't copied once an element."""
    add = lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))

    def scan(own: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(own) / F.lit(float(block))).cast("int") - 1)
        part = lambda b: F.slice(own, b * block + 1, block)
        starts = F.aggregate(F.transform(numbers, lambda b: F.aggregate(part(b), zero, lambda acc, x: op(acc, x))), F.array(zero), add)
        inner = lambda s: F.flatten(F.transform(numbers, lambda b: F.slice(F.aggregate(part(b), F.array(F.element_at(s, b + 1)), add), 2 if inclusive else 1, F.size(part(b)))))
        return F.when(F.size(own) > 0, _let(starts, inner)).otherwise(F.array().cast("array<long>"))

    return _let(values, scan)


def _pieces(text: Column) -> Column:
    """The text in pieces of ``_PIECE`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """What stands from ``start`` to ``end`` in a text given as pieces, at a cost of its length and two pieces."""
    n, a, b = F.lit(_PIECE), F.floor(start / _PIECE).cast("int"), F.floor(end / _PIECE).cast("int")
    cut = lambda i, at, size: F.coalesce(F.get(pieces, i).substr(at.cast("int"), size.cast("int")), F.lit(""))
    one = cut(a, start % n + 1, end - start)
    more = F.concat(cut(a, start % n + 1, n), F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), cut(b, F.lit(1), end % n))
    return F.when(a == b, one).otherwise(more)


def _with_found(df: DataFrame, name: str, text: str, pattern: str, maybe: Column) -> DataFrame:
    """Adds the matches of a pattern: array of (start, end, m), in code points, end exclusive; ``maybe`` must hold for any match."""
    m, g, at = f"{name}_m", f"{name}_g", f"{name}_a"
    found = F.when(maybe, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(m, found).withColumn(g, F.when(F.size(m) > 0, F.split(text, pattern, -1)))
    # the start of match i: all gaps up to it and all matches before it
    df = df.withColumn(at, F.when(F.size(m) > 0, _scan(F.transform(F.col(g), lambda x, i: F.length(x).cast("long") + F.coalesce(F.length(F.get(F.col(m), i)), F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x, False)))
    spans = F.transform(F.col(m), lambda x, i: F.struct((F.get(F.col(at), i) + F.length(F.get(F.col(g), i))).alias("start"), (F.get(F.col(at), i) + F.length(F.get(F.col(g), i)) + F.length(x)).alias("end"), x.alias("m")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,m:string>>")
    return df.withColumn(name, F.coalesce(spans, empty)).drop(m, g, at)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    def weigh(acc: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weigh) % 10 == 0


def _small(part: Column) -> Column:
    p = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False)


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _small),
    "card": lambda m: luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _with(x: Column, names: tuple[str, ...], **more: Column) -> Column:
    return F.struct(*(x[n].alias(n) for n in names), *(c.alias(n) for n, c in more.items()))


def _candidates(spans: Column, pieces: Column, is_base: bool) -> Column:
    """The spans (kind, start, end, m, strict) with their votes and features; each step works on what the one before worked out."""
    names = ("kind", "start", "end", "m", "strict")
    around = F.transform(spans, lambda x: _with(x, names, before=_between(pieces, F.greatest(x["start"] - 24, F.lit(0).cast("long")), x["start"]), after=_between(pieces, x["end"], x["end"] + 1)))

    def measures(x: Column) -> Column:
        word = F.when(x["before"].rlike(_BEFORE[1]), 1).when(x["before"].rlike(_BEFORE[2]), 2).when(x["before"].rlike(_BEFORE[-1]), 3).otherwise(0)
        different = F.size(F.array_distinct(F.split(F.lower(x["m"]), "")))
        return _with(x, (*names, "after"), left=F.right(x["before"], F.lit(1)), word=word, size=F.length(x["m"]), digits=F.length(_digits(x["m"])), upper=F.length(F.regexp_replace(x["m"], "[^A-Z]", "")), different=different)

    def judged(x: Column) -> Column:
        kind, strict, left, after, word = (x[k] for k in ("kind", "strict", "left", "after", "word"))
        vote = lambda c: F.when(c, 1).otherwise(-1)
        gazetteer = F.when(word == 0, 0).when(word == 3, -1).otherwise(1)
        context = F.when(left.rlike("[\"'=:<(\\[{]") | after.rlike("[\"'>)\\]}]"), 1).when(left.rlike(r"[\p{L}_]") | after.rlike(r"[\p{L}_]"), -1).otherwise(0)
        # digits without the checksum or the length of their kind have the wrong make-up too
        spread = F.when(~strict & (kind == len(KINDS) + 2), -1).when(x["m"].rlike(r"^(.)\1*+$") | (x["digits"] == 0), -1).when(x["different"] >= 8, 1).otherwise(0)
        side = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[\"'=:]"), 2).when(c.rlike(r"[\p{L}\p{N}]"), 3).otherwise(4)
        quarter = lambda n: F.floor(n * 4 / x["size"]).cast("int")
        features = [kind, F.least(F.lit(7), F.floor(F.log2(x["size"]))).cast("int"), quarter(x["digits"]), side(left), side(after), quarter(x["upper"]), F.least(F.lit(4), F.floor(x["different"] / 5)).cast("int"), word]
        return _with(x, ("kind", "start", "end"), base=F.lit(is_base), v=F.array(vote(strict), gazetteer, context, spread), f=F.array(*features))

    return F.transform(F.transform(around, measures), judged)


_FAR = (1 << 62) - 1


def _free(base: Column, more: Column) -> Column:
    """Those of ``more`` that no span of ``base`` overlaps: both sorted as one, with the largest end before and the least start after."""
    mark = lambda spans, c: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(c).alias("c"), x["end"].alias("end"), x["kind"].alias("kind"), x["m"].alias("m"), x["strict"].alias("strict")))
    both = F.array_sort(F.concat(mark(base, 0), mark(more, 1)))
    far = F.lit(_FAR).cast("long")

    def pick(own: Column) -> Column:
        ends = _scan(F.transform(own, lambda x: F.when(x["c"] == 0, x["end"]).otherwise(F.lit(-1).cast("long"))), F.lit(-1).cast("long"), F.greatest)
        starts = F.reverse(_scan(F.transform(F.reverse(own), lambda x: F.when(x["c"] == 0, x["start"]).otherwise(far)), far, F.least))
        return _let(ends, lambda e: _let(starts, lambda s: F.filter(own, lambda x, i: (x["c"] == 1) & (F.get(e, i) <= x["start"]) & (F.get(s, i) >= x["end"]))))

    return F.when((F.size(base) > 0) & (F.size(more) > 0), _let(both, pick)).otherwise(mark(more, 1))


def annotate(df: DataFrame, text_col: str, prefix: str = "__pii_") -> DataFrame:
    """Adds ``{prefix}base`` (array of kind number, start, end) and ``{prefix}cand`` (all candidates with votes and features)."""
    text = f"{prefix}text"
    df = df.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    digit = F.col(text).rlike("[0-9]")
    maybe = {"email": F.col(text).contains("@"), "ip": F.col(text).contains(".") & digit, "card": digit, "phone": F.col(text).contains("+") & digit}
    names = {k: prefix + k for k in (*KINDS, "extra")}
    for kind in KINDS:
        df = _with_found(df, names[kind], text, PATTERNS[kind], maybe[kind])
    df = _with_found(df, names["extra"], text, _EXTRA, digit | F.col(text).contains("at") | F.col(text).contains("AT"))
    first_more = len(KINDS)

    def listed(i: int, k: str) -> Column:
        return F.transform(F.col(names[k]), lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), _VALID[k](x["m"]).alias("strict")))

    extra_kind = lambda m: F.when(m.rlike(f"^(?:{_HANDLE})$"), first_more + 1).when(m.rlike(f"^(?:{_NUMBER})$"), first_more + 2).otherwise(first_more)
    strict_extra = lambda m: m.rlike("^[0-9a-f]{32,}$|^[0-9A-F]{32,}$|^[A-Za-z0-9+/_-]*[0-9][A-Za-z0-9+/_-]*={0,2}$") | m.rlike(f"^(?:{_HANDLE}|{_NUMBER})$")
    whole, good, more, pieces = (F.col(prefix + k) for k in ("all", "good", "more", "pieces"))
    df = df.withColumn(f"{prefix}all", F.concat(*(listed(i, k) for i, k in enumerate(KINDS)))).drop(*(names[k] for k in KINDS))
    df = df.withColumn(f"{prefix}good", F.filter(whole, lambda x: x["strict"]))
    near = F.transform(F.filter(whole, lambda x: ~x["strict"] & (x["kind"] >= 2)), lambda x: F.struct(F.lit(first_more + 2).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), x["strict"].alias("strict")))
    extra = F.transform(F.col(names["extra"]), lambda x: F.struct(extra_kind(x["m"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), strict_extra(x["m"]).alias("strict")))
    df = df.withColumn(f"{prefix}more", F.concat(near, extra)).withColumn(f"{prefix}more", _free(good, more))
    df = df.withColumn(f"{prefix}pieces", F.when(F.size(good) + F.size(more) > 0, _pieces(F.col(text))))
    cand = F.concat(_candidates(good, pieces, True), _candidates(more, pieces, False))
    base = F.array_sort(F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return df.withColumn(f"{prefix}cand", cand).withColumn(f"{prefix}base", base).drop(names["extra"], text, *(prefix + k for k in ("all", "good", "more", "pieces")))


def reliability(patterns: Column, rounds: int = 40, right: float = 7.0, wrong: float = 3.0, low: float = 0.55, high: float = 0.99) -> Column:
    """(prior, accuracy): expectation-maximisation over ``patterns``, an array of (v, n).

    A labeler abstains (0) whatever the class; where it votes, it is right with its accuracy, which starts at 0.75, has
    ``right`` and ``wrong`` votes in advance and stays between ``low`` and ``high``, so that the classes can't swap.
    """
    state = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.lit(0.75)] * _LABELERS).alias("accuracy"))

    def step(s: Column, _: Column) -> Column:
        seen = F.transform(patterns, lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), posterior(s, p["v"]).alias("r")))

        def update(z: Column) -> Column:
            total = lambda value: F.aggregate(z, F.lit(0.0), lambda a, p: a + value(p))

            def accuracy(j: int) -> Column:
                good = total(lambda p: p["n"] * F.when(p["v"][j] > 0, p["r"]).when(p["v"][j] < 0, 1 - p["r"]).otherwise(0.0))
                cast = total(lambda p: F.when(p["v"][j] != 0, p["n"]).otherwise(0.0))
                return F.least(F.lit(high), F.greatest(F.lit(low), (good + right) / (cast + right + wrong)))

            return F.struct(((total(lambda p: p["n"] * p["r"]) + 1) / (total(lambda p: p["n"]) + 2)).alias("prior"), F.array(*map(accuracy, range(_LABELERS))).alias("accuracy"))

        return _let(seen, update)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, step)


def posterior(state: Column, v: Column) -> Column:
    """P(personal | votes) under a state of ``reliability``."""
    yes, no = state["prior"], 1 - state["prior"]
    for j in range(_LABELERS):
        a = state["accuracy"][j]
        yes = yes * F.when(v[j] > 0, a).when(v[j] < 0, 1 - a).otherwise(1.0)
        no = no * F.when(v[j] > 0, 1 - a).when(v[j] < 0, a).otherwise(1.0)
    return yes / (yes + no)


@dataclass
class SpanModel:
    """Log odds of the classifier by feature and value, and the labelers' estimated reliabilities."""

    bias: float
    odds: list[dict[int, float]]
    prior: float
    accuracy: list[float]

    def probability(self, f: Column) -> Column:
        z = F.lit(self.bias)
        for i, table in enumerate(self.odds):
            own = F.lit(0.0)
            for value, odds in table.items():
                own = F.when(f[i] == value, odds).otherwise(own)
            z = z + own
        return 1 / (1 + F.exp(-z))


def fit(rows: DataFrame, cand: str = "__pii_cand") -> SpanModel:
    """Estimate reliabilities over the candidates' votes, then train the classifier on the posteriors.

    What reaches the driver is one row of 5 numbers and at most 8 values of each of 8 features.
    """
    each = rows.select(F.explode(cand).alias("c")).groupBy(F.col("c.v").alias("v"), F.col("c.f").alias("f")).agg(F.count("*").cast("double").alias("n"))
    each = checkpoint(each)
    patterns = each.groupBy("v").agg(F.sum("n").alias("n")).agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("p"))
    got = patterns.select(reliability(F.col("p")).alias("s")).first().s
    state = F.struct(F.lit(got.prior).alias("prior"), F.array(*map(F.lit, got.accuracy)).alias("accuracy"))
    soft = each.withColumn("r", posterior(state, F.col("v")))
    long = soft.select("n", "r", F.posexplode("f").alias("i", "x")).groupBy("i", "x").agg(F.sum(F.col("n") * F.col("r")).alias("yes"), F.sum(F.col("n") * (1 - F.col("r"))).alias("no")).orderBy("i", "x").collect()
    odds: list[dict[int, float]] = [{} for _ in _FEATURES]
    sums = [sum(r[k] for r in long if r.i == 0) for k in ("yes", "no")]
    for r in long:
        width = sum(q.i == r.i for q in long)
        odds[r.i][r.x] = math.log((r.yes + 1) / (sums[0] + width)) - math.log((r.no + 1) / (sums[1] + width))
    return SpanModel(math.log((sums[0] + 1) / (sums[1] + 1)), odds, got.prior, list(got.accuracy))


def spans(base: Column, cand: Column, model: SpanModel, threshold: float = 0.5) -> Column:
    """Ascending (start, kind number, end): base spans and what the classifier adds."""
    more = F.filter(cand, lambda c: ~c["base"] & (model.probability(c["f"]) >= threshold))
    return F.array_sort(F.concat(base, F.transform(more, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))))


def _text_of(spans_: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, *MORE)))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of each row.

    Null and empty texts have no spans and the hash of the empty string. Null ids stay; repeated rows get repeated
    results; other columns are not read. Texts are searched whole. Without any candidate the classifier adds nothing.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpoint(annotate(picked, "text").select("doc_id", "__pii_base", "__pii_cand"))
    model = fit(rows)
    base, cand = F.col("__pii_base"), F.col("__pii_cand")
    of_kind = lambda i: F.filter(base, lambda b: b["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_text_of(base), 256).alias("base_sha256"), _text_of(spans(base, cand, model)).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The documents with each span (overlapping ones as one) replaced by its first kind in brackets; texts are searched once.

    ``length_col``, if given, is set to the new length. Null texts stay null.
    """
    rows = written(annotate(docs, text_col))
    model = fit(rows)
    s, text, far = F.col("__pii_spans"), F.col(text_col), F.col("__pii_reach")
    found = rows.withColumn("__pii_spans", spans(F.col("__pii_base"), F.col("__pii_cand"), model))
    found = found.withColumn("__pii_reach", F.when(F.size(s) > 0, _scan(F.transform(s, lambda x: x["end"]), F.lit(0).cast("long"), F.greatest)))
    # a span that starts before an earlier one ends joins it
    heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(far, i - 1)))
    found = found.withColumn("__pii_head", F.when(F.size(s) > 0, heads)).withColumn("__pii_pieces", F.when(F.size(s) > 0, _pieces(text)))
    h, pieces, names = F.col("__pii_head"), F.col("__pii_pieces"), F.array(*map(F.lit, (*KINDS, *MORE)))

    def replaced(i: Column, k: Column) -> Column:
        following = F.get(h, k + 1)
        ends, begins = F.get(far, F.coalesce(following, F.size(s)) - 1), F.coalesce(F.get(s, following)["start"], F.length(text).cast("long"))
        return F.concat(F.lit("["), F.upper(F.get(names, F.get(s, i)["kind"])), F.lit("]"), _between(pieces, ends, begins))

    first = _between(pieces, F.lit(0).cast("long"), F.get(s, F.lit(0))["start"])
    new = F.when(F.size(h) > 0, F.concat(first, F.array_join(F.transform(h, replaced), ""))).otherwise(text)
    out = found.withColumn(text_col, new)
    if length_col:
        out = out.withColumn(length_col, F.length(text_col).cast("long"))
    return out.select(docs.columns)
