"""Personal data: weak labelers, EM over their votes, and a span classifier.

Everything on the texts is built from SQL functions.  Four kinds of candidate
spans are found by pattern: email, ip, card and phone, in the contract's base
form and in looser ones (written-out addresses, national phone numbers, digit
chains that fail a check).  Four labelers vote on each candidate:

* regex: the base form with its check (Luhn, octets, digit counts);
* gazetteer: known endings, address ranges, issuer or country codes;
* context: a telling word shortly before the span;
* edges: no letter or digit touches the span.

Only counts of vote patterns by kind reach the driver (at most 64 rows).
Expectation-maximisation turns them into labeler reliabilities and a posterior
for each pattern; a logistic classifier on the votes is trained on those
posteriors and judges every candidate.  Base spans stay in any case.

Edge cases: a null text counts as empty; rows repeat as often as in the input;
additional columns are ignored; an empty table gives an empty result; a very
long text is read whole, and running sums keep its places near linear.  Spans
of one start are in the order of the kinds; a posterior of just ``ACCEPT`` is
accepted; a looser candidate that touches a base span of its kind gives way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunecorpus.llm.common import cut, let, running_sums

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "edges")
ACCEPT = 0.9
CONTEXT_CHARS = 32

# Patterns as fixed values.  Each starts where no earlier start is possible (or where
# the last match ended) and takes runs whole, so a text is read in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL_SPELT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PHONE_NATIONAL = r"(?<![0-9+.)-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"

# Gazetteers as fixed values.
ENDINGS = "com org net edu gov int info biz io co de fr es uk eu it nl ch at be pt us ca dz ma tn example test".split()
WORDS = {
    "email": "mail|e-mail|contact|write|@",
    "ip": r"\bip\b|host|server|address|client|ping",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|whatsapp|sms|number",
}


MATCH = "array<struct<start:int,stop:int,found:string,before:string,after:string>>"


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """All matches with their places in code points and what surrounds them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(MATCH)

    def placed(m: Column, pieces: Column) -> Column:
        lengths = F.transform(F.sequence(F.lit(1), F.size(m)), lambda i: F.length(F.element_at(pieces, i)) + F.length(F.element_at(m, i)))
        return let(
            running_sums(lengths),
            lambda s: F.transform(
                F.sequence(F.lit(1), F.size(m)),
                lambda i: F.struct(
                    (F.element_at(s, i) + F.length(F.element_at(pieces, i))).cast("int").alias("start"),
                    (F.element_at(s, i) + F.length(F.element_at(pieces, i)) + F.length(F.element_at(m, i))).cast("int").alias("stop"),
                    F.element_at(m, i).alias("found"),
                    F.right(F.element_at(pieces, i), F.lit(CONTEXT_CHARS)).alias("before"),
                    F.left(F.element_at(pieces, i + 1), F.lit(1)).alias("after"),
                ),
            ),
        )

    def split_up(m: Column) -> Column:
        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda p: placed(m, p))).otherwise(none)

    return F.when(guard, let(found, split_up)).otherwise(none)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    n = F.length(d)

    def worth(i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def octets_fit(s: Column) -> Column:
    return F.forall(F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))


def _checked(kind: str, s: Column) -> Column:
    n = F.length(digits(s))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets_fit(s)
    if kind == "card":
        return (n >= 16) & (n <= 19) & luhn(digits(s))
    return (n >= 8) & (n <= 15)


def _known(kind: str, s: Column) -> Column:
    d = digits(s)
    if kind == "email":
        return F.regexp_extract(F.lower(s), "([a-z0-9-]+)$", 1).isin(*ENDINGS)
    if kind == "ip":
        first = F.regexp_extract(s, "^0*([0-9]{1,3})[.]", 1)
        return (first != "") & first.cast("int").between(1, 223)
    if kind == "card":
        return d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)")
    return d.rlike("^(?:1|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6|7|8|9)[1-9]")


def _votes(kind: str, spans: Column, base: bool) -> Column:
    """Candidates of one pattern with their labelers' votes; chains of few digits are no candidates."""
    if kind == "card":
        spans = F.filter(spans, lambda m: F.length(digits(m["found"])).between(13, 19))

    def vote(m: Column) -> Column:
        alone = ~F.right(m["before"], F.lit(1)).rlike(r"[\p{L}\p{N}]") & ~m["after"].rlike(r"[\p{L}\p{N}]")
        checked = _checked(kind, m["found"]) if base else F.lit(False)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"),
            checked.cast("int").alias("regex"), _known(kind, m["found"]).cast("int").alias("gazetteer"),
            F.lower(m["before"]).rlike(WORDS[kind]).cast("int").alias("context"), alone.cast("int").alias("edges"),
        )

    return F.transform(spans, vote)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every candidate with its votes; candidates over a base span of the kind are left out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    at, digit, plus, spelt = F.instr(text, "@") > 0, text.rlike("[0-9]"), F.instr(text, "+") > 0, text.rlike(r"[\[(]at[\])]")
    found = docs.select(
        "doc_id",
        _votes("email", matches(text, EMAIL, at), True).alias("email"), _votes("email", matches(text, EMAIL_SPELT, spelt), False).alias("email2"),
        _votes("ip", matches(text, IP, digit), True).alias("ip"), _votes("card", matches(text, CARD, digit), True).alias("card"),
        _votes("phone", matches(text, PHONE, plus), True).alias("phone"), _votes("phone", matches(text, PHONE_NATIONAL, digit), False).alias("phone2"),
    )

    def apart(more: str, base: str) -> Column:
        return F.filter(more, lambda m: ~F.exists(base, lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))

    return found.select("doc_id", F.concat("email", apart("email2", "email"), "ip", "card", "phone", apart("phone2", "phone")).alias("spans"))


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[tuple[float, float]], list[float]]:
    """Share of true spans, (P(vote | true), P(vote | false)) by labeler, posterior by pattern."""
    share = 0.5
    rates = [(0.9, 0.1), (0.8, 0.3), (0.5, 0.2), (0.9, 0.5)][: len(patterns[0][0])]
    prior = rates
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for votes, _ in patterns:
            yes, no = math.log(share), math.log(1 - share)
            for v, (t, f) in zip(votes, rates, strict=True):
                yes += math.log(t if v else 1 - t)
                no += math.log(f if v else 1 - f)
            post.append(1 / (1 + math.exp(max(-40.0, min(40.0, no - yes)))))
        true = sum(n * p for (_, n), p in zip(patterns, post, strict=True))
        false = sum(n for _, n in patterns) - true
        share = (true + 5) / (true + false + 10)
        # a prior worth ten votes holds each labeler where the counts say little
        rates = [((sum(n * p * v[i] for (v, n), p in zip(patterns, post, strict=True)) + 10 * prior[i][0]) / (true + 10), (sum(n * (1 - p) * v[i] for (v, n), p in zip(patterns, post, strict=True)) + 10 * prior[i][1]) / (false + 10)) for i in range(len(rates))]
    return share, rates, post


def train_classifier(patterns: list[tuple[tuple[int, ...], int]], post: list[float], rounds: int = 400) -> list[float]:
    """Logistic weights (constant last) on the votes, for soft labels; gradient steps on pattern counts."""
    w = [0.0] * (len(patterns[0][0]) + 1)
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        grad = [1e-3 * x for x in w]
        for (votes, n), p in zip(patterns, post, strict=True):
            x = (*votes, 1)
            q = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for i, xi in enumerate(x):
                grad[i] += n * (q - p) * xi / total
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of structs (kind, start, stop), ordered by kind as listed and start."""
    found = cut(candidates(docs))
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.kind", *[f"s.{x}" for x in LABELERS]).count().collect()
    chance: dict[int, list[float]] = {}
    for kind in range(len(KINDS)):
        patterns = [(tuple(r[x] for x in LABELERS), r["count"]) for r in counts if r["kind"] == kind]
        if patterns:
            chance[kind] = train_classifier(patterns, expectation_maximisation(patterns)[2])

    def accepted(s: Column) -> Column:
        out = s["regex"] == 1
        for kind, w in chance.items():
            logit = sum((F.lit(x) * s[name] for x, name in zip(w, LABELERS, strict=False)), F.lit(w[-1]))
            out = out | ((s["kind"] == kind) & (logit >= math.log(ACCEPT / (1 - ACCEPT))))
        return out

    def plain(spans: Column) -> Column:
        return F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))))

    return found.select("doc_id", plain(F.filter("spans", lambda s: s["regex"] == 1)).alias("base"), plain(F.filter("spans", accepted)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`find_personal_data`."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: str) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    return found.select("doc_id", *[count(i) for i in range(len(KINDS))], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
