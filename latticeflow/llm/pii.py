"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) are exact matches.  Beyond them, wider patterns propose spans of further
kinds (iban, ssn, secret).  Three labelers vote on each proposal, each by evidence of its own: a format check
by the characters, a gazetteer by lists, the context by what stands to the left.  Proposals are counted by kind,
votes and features, a table whose size is bounded by the number of combinations; expectation-maximisation over
it, for each kind apart, estimates the kind's prior, the labelers' reliabilities and each cell's posterior,
which trains a naive Bayes classifier over the features of spans of that kind.  Its weights, a few dozen numbers, go
into the expression that classifies every proposal; those it takes are added unless they overlap base spans.

Patterns take time in proportion to the text: a run of characters is only searched from its beginning or from
the end of the match before, where the pattern can't match from within if it doesn't from there.

Offsets are code points, ends exclusive.  Defined cases: null and empty texts have no spans; texts of any
length are searched whole; with no proposals at all nothing is added; repeated rows give repeated results;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
KINDS = (*BASE, *ADDED)
#: Countries that issue IBANs.
IBAN_COUNTRIES = ["AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]
#: Possessive forms of the patterns: what they match is the same, and long runs don't recurse or go back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": rf"(?<![A-Za-z0-9_/+-])(?!(?:{'|'.join(IBAN_COUNTRIES)})[0-9]{{2}}[A-Z0-9]{{11,30}}+(?![A-Za-z0-9_/+-]))[A-Za-z0-9_/+-]{{20,}}+(?![A-Za-z0-9_/+@.-])",
}
#: What every text with a match for secret holds.
SECRET_RUN = r"[A-Za-z0-9_/+-]{20}"
#: How well-known kinds of secrets begin.
SECRET_PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|sk-|pk-|xox[abp]-|eyJ)"
#: Personal numbers that were printed as samples, and three-digit areas that were never given out.
SAMPLE_NUMBERS = ["078-05-1120", "219-09-9999", "111-11-1111", "222-22-2222", "333-33-3333", "123-12-3123"]
UNUSED_AREAS = [(734, 749), (773, 899)]
#: Words to the left that name a secret, a personal number or account, or another thing's number.
SECRET_NAMES = r"(?i)(?:token|secret|key|password|passwd|pwd|auth|bearer|credential)s?[\x22'\x20:=]*$"
PERSONAL_CUES = r"(?i)(?:iban|account|konto|cuenta|compte|ssn|social|security|number|no|nr)[.:#\x20]*$"
OTHER_CUES = r"(?i)(?:order|invoice|part|item|sku|serial|ticket|ref|reference|version|isbn|batch|lot|phone|fax|tel)[.:#\x20]*$"
#: Characters to the left that are a proposal's context; it ends where the match before of the same kind does.
LEFT = 32
ROUNDS = 30
#: Characters of the blocks from which a redacted text is put together.
BLOCK = 4096


def _digits(s: Column) -> Column:
    return F.translate(s, " -+().", "")


def _luhn(s: Column) -> Column:
    d = F.reverse(_digits(s))

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _small_parts(s: Column) -> Column:
    part = lambda p: F.regexp_replace(p, r"^0+(?=.)", "")
    return F.forall(F.split(s, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))


#: What a base match must pass.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda s: F.lit(True),
    "ip": _small_parts,
    "card": lambda s: F.when(F.length(_digits(s)).between(14, 19), _luhn(s)).otherwise(False),
    "phone": lambda s: F.length(_digits(s)).between(10, 15),
}


def _needs(text: Column, kind: str) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "secret":
        return F.col("has_run")
    return F.col("has_digit")


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(values: Column, join: Callable[[Column, Column], Column] = lambda x, y: x + y) -> Column:
    """Running sums (or another ``join``) of an array by doubling steps, so that time follows the length and its logarithm."""
    steps = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    add = lambda sums, k: F.transform(sums, lambda x, i: F.when(i >= k, join(x, F.get(sums, i - k))).otherwise(x))
    return F.aggregate(F.transform(F.sequence(F.lit(0), steps), lambda k: F.pow(F.lit(2), k).cast("int")), values, add)


def _matches(text: Column, kind: str) -> Column:
    """All leftmost non-overlapping matches as structs (start, no, end, kind, surface, left), in order.

    Splitting at the pattern gives the stretches between the matches, so ends are running sums of lengths.
    """
    pattern = F.lit(PATTERNS[kind])
    empty = F.array().cast("array<struct<start:int,no:int,end:int,kind:string,surface:string,left:string>>")

    def located(found: Column) -> Column:
        def spans(gaps: Column) -> Column:
            def span(end: Column, i: Column) -> Column:
                match = F.get(found, i)
                return F.struct((end - F.length(match)).alias("start"), F.lit(KINDS.index(kind)).alias("no"), end.alias("end"), F.lit(kind).alias("kind"), match.alias("surface"), F.right(F.get(gaps, i), F.lit(LEFT)).alias("left"))

            return _bound(_running(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))), lambda ends: F.transform(ends, span))

        return F.when(F.size(found) > 0, _bound(F.split(text, PATTERNS[kind], -1), spans)).otherwise(empty)

    return F.when(_needs(text, kind), _bound(F.regexp_extract_all(text, pattern, F.lit(0)), located)).otherwise(empty)


def _marked(docs: DataFrame, text: str) -> DataFrame:
    """With the text and what the patterns need of it: ip, card, iban and ssn a digit, secret a long run."""
    t = F.col("pii_text")
    return docs.withColumn("pii_text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumns({"has_digit": t.rlike("[0-9]"), "has_run": t.rlike(SECRET_RUN)})


def _proposes() -> Column:
    """Holds for every text with a proposal."""
    return F.col("has_digit") | F.col("has_run")


def _votes(c: Column) -> list[Column]:
    """Votes 1, 0 or -1 of the format check, the gazetteer and the context on a proposal."""
    s, left, kind = c["surface"], c["left"], c["kind"]
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    number = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    rest = F.aggregate(
        F.split(number, ""),
        F.lit(0),
        lambda r, x: F.when(x == "", r).when(x.rlike("^[0-9]$"), (r * 10 + x.cast("int")) % 97).otherwise((r * 100 + F.ascii(x) - 55) % 97),
    )
    hexes = s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & F.length(s).isin(32, 40, 64)
    broken = s.rlike("^(?:000|666|9)|-00-|-0000$")
    area = F.substring(s, 1, 3).cast("int")
    unused = F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in UNUSED_AREAS]), lambda x: area.between(x["a"], x["b"]))
    form = (
        F.when(kind == "iban", vote(rest == 1, rest != 1))
        .when(kind == "ssn", vote(~broken, broken))
        .otherwise(vote(hexes | (s.rlike("[0-9]") & s.rlike("[A-Z]") & s.rlike("[a-z]")), s.rlike("^(?:[A-Za-z/-]+|[0-9/-]+|[-_/+]+)$") & ~s.rlike("^[a-z]{2}-[a-z]+$")))
    )
    listed = (
        F.when(kind == "iban", vote(F.substring(s, 1, 2).isin(IBAN_COUNTRIES), ~F.substring(s, 1, 2).isin(IBAN_COUNTRIES)))
        .when(kind == "ssn", vote(~(s.isin(SAMPLE_NUMBERS) | unused), s.isin(SAMPLE_NUMBERS) | unused))
        .otherwise(vote(s.rlike(SECRET_PREFIXES), s.rlike("(?i)^[a-z]+$")))
    )
    context = F.when(kind == "secret", vote(left.rlike(r"[=:]\x20?[\x22']?$") | left.rlike(SECRET_NAMES), left.rlike(r"[\x20\n]$") | (left == ""))).otherwise(vote(left.rlike(PERSONAL_CUES), left.rlike(OTHER_CUES)))
    return [form.cast("int"), listed.cast("int"), context.cast("int")]


def _features(c: Column) -> list[Column]:
    """Small whole numbers: length class, digit share, letter case, what stands to the left, and what format and lists say."""
    s = c["surface"]
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    case = F.when(~s.rlike("[A-Za-z]"), 0).when(~s.rlike("[A-Z]"), 1).when(~s.rlike("[a-z]"), 2).otherwise(3)
    before = F.when(c["left"].rlike(r"[\x22']$"), 1).when(c["left"].rlike(r"[=:]\x20?$"), 2).when(c["left"].rlike(r"[\x20\n]$"), 3).otherwise(0)
    return [x.cast("int") for x in (F.least(F.length(s) / 8, F.lit(8)), F.least(4 * digits / F.length(s), F.lit(4)), case, before, *(v + 1 for v in _votes(c)[:2]))]


def _proposals(text: Column) -> Column:
    told = lambda c: F.struct(*[c[x].alias(x) for x in ("start", "no", "end", "kind")], F.array(*_votes(c)).alias("votes"), F.array(*_features(c)).alias("features"))
    return F.transform(F.concat(*[_matches(text, k) for k in ADDED]), told)


def reliabilities(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row (no, prior, accuracy array, cells array) per kind by expectation-maximisation over (no, votes, features, n).

    A labeler that votes is right with its accuracy, which is the kind's own; abstaining says nothing.
    Accuracies start at 0.8 and are smoothed, the prior starts at a half.  The number of cells is bounded by the
    combinations of votes and feature values.
    """
    labelers = 3
    gathered = cells.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("votes", "features", "n"))).alias("cells"))
    one = lambda p: F.aggregate(p, F.lit(1.0).cast("double"), lambda a, x: a * x)

    def posterior(state: Column, votes: Column) -> Column:
        yes = state["prior"] * one(F.zip_with(votes, state["accuracy"], lambda v, a: F.when(v == 1, a).when(v == -1, 1 - a).otherwise(1.0)))
        no = (1 - state["prior"]) * one(F.zip_with(votes, state["accuracy"], lambda v, a: F.when(v == 1, 1 - a).when(v == -1, a).otherwise(1.0)))
        return yes / (yes + no)

    state = gathered.select("no", "cells", F.lit(0.5).alias("prior"), F.array(*[F.lit(0.8)] * labelers).alias("accuracy"))

    def round_(state: Column, _: Column) -> Column:
        q = F.transform("cells", lambda c: F.struct(c["votes"].alias("votes"), c["n"].cast("double").alias("n"), posterior(state, c["votes"]).alias("q")))

        def updated(q: Column) -> Column:
            add = lambda f: F.aggregate(q, F.lit(0.0).cast("double"), lambda a, c: a + f(c))
            agreed = lambda i: add(lambda c: c["n"] * F.when(c["votes"][i] == 1, c["q"]).when(c["votes"][i] == -1, 1 - c["q"]).otherwise(0.0))
            spoken = lambda i: add(lambda c: c["n"] * F.abs(c["votes"][i]))
            accuracy = F.array(*[F.least(F.lit(0.99), F.greatest(F.lit(0.5), (agreed(i) + 4.0) / (spoken(i) + 5.0))) for i in range(labelers)])
            return F.struct(((add(lambda c: c["n"] * c["q"]) + 1.0) / (add(lambda c: c["n"]) + 2.0)).alias("prior"), accuracy.alias("accuracy"))

        return _bound(q, updated)

    start = F.struct(F.col("prior").alias("prior"), F.col("accuracy").alias("accuracy"))
    fitted = state.select("no", "cells", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, round_).alias("state"))
    return fitted.select("no", "state.*", F.transform("cells", lambda c: F.struct(c["votes"].alias("votes"), c["features"].alias("features"), c["n"].alias("n"), posterior(F.col("state"), c["votes"]).alias("q"))).alias("cells"))


def train(docs: DataFrame, text: str = "text") -> dict[tuple[int, int, int], float]:
    """Weights of the span classifier by (kind's number, feature, value); feature -1 is the kind's bias.  A few dozen rows are collected."""
    rows = _marked(docs.select(text), text).where(_proposes())
    cells = rows.select(F.explode(_proposals(F.col("pii_text"))).alias("c")).groupBy("c.no", "c.votes", "c.features").agg(F.count(F.lit(1)).alias("n"))
    told = reliabilities(cells).select("no", F.explode("cells").alias("c"))
    valued = F.concat(F.array(F.struct(F.lit(-1).alias("feature"), F.lit(0).alias("value"))), F.transform("c.features", lambda v, i: F.struct(i.alias("feature"), v.alias("value"))))
    spread = told.select("no", (F.col("c.n") * F.col("c.q")).alias("yes"), (F.col("c.n") * (1 - F.col("c.q"))).alias("no_"), F.explode(valued).alias("f"))
    sums = spread.groupBy("no", "f.feature", "f.value").agg(F.sum("yes").alias("yes"), F.sum("no_").alias("no_"))
    found = {(r.no, r.feature, r.value): (r.yes, r.no_) for r in sums.collect()}
    weights = {}
    for (no, feature, value), (a, b) in found.items():
        yes, not_ = found[no, -1, 0]
        weights[no, feature, value] = math.log((yes + 1) / (not_ + 1)) if feature < 0 else math.log((a + 1) / (yes + 8)) - math.log((b + 1) / (not_ + 8))
    return weights


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", weights: dict[tuple[int, int, int], float] | None = None) -> DataFrame:
    """The ``keep`` columns, ``base`` and ``spans``: arrays of structs (start, no, end, kind) by start, then kind."""
    weights = train(docs, text) if weights is None else weights
    rows = _marked(docs, text)
    t = F.col("pii_text")
    plain = lambda c: F.struct(*[c[x].alias(x) for x in ("start", "no", "end", "kind")])
    passing = lambda k: F.filter(_matches(t, k), lambda c: CHECKS[k](c["surface"]))
    base = F.array_sort(F.concat(*[F.transform(passing(k), plain) for k in BASE]))
    rows = rows.withColumn("base", base)
    if not weights:
        return rows.select(*keep, "base", F.col("base").alias("spans"))
    number = lambda no, i, v: (no * 100 + i) * 100 + v
    table = F.create_map(*[F.lit(x) for (no, f, v), w in sorted(weights.items()) for x in (number(no, f, v), w)])
    weight = lambda no, i, v: F.coalesce(F.element_at(table, number(no, i, v)), F.lit(0.0))
    score = lambda c: F.aggregate(F.transform(c["features"], lambda v, i: weight(c["no"], i, v)), weight(c["no"], -1, F.lit(0)), lambda a, x: a + x)
    taken = F.filter(_proposals(t), lambda c: score(c) > 0)
    added = F.when(_proposes(), _bound(F.transform(taken, plain), lambda found: F.when(F.size(found) > 0, _clear(F.col("base"), found)).otherwise(found))).otherwise(F.slice("base", 1, 0))
    return rows.select(*keep, "base", added.alias("added")).select(*keep, "base", F.when(F.size("added") > 0, F.array_sort(F.concat("base", "added"))).otherwise(F.col("base")).alias("spans"))


def _clear(base: Column, found: Column) -> Column:
    """The spans of ``found`` that overlap none of ``base``.

    In the order of their starts, a span must not begin before the furthest end of the base spans before it, nor
    end after the start of the next one.
    """
    own = lambda spans, n: F.transform(spans, lambda c: F.struct(c["start"].alias("start"), F.lit(n).alias("own"), c["no"].alias("no"), c["end"].alias("end"), c["kind"].alias("kind")))
    of_base = lambda spans, what: F.transform(spans, lambda c: F.when(c["own"] == 0, c[what]))

    def told(spans: Column, ends: Column, starts: Column) -> Column:
        last = F.size(spans) - 1
        free = lambda c, i: (F.coalesce(F.get(ends, i), F.lit(0)) <= c["start"]) & (F.coalesce(F.get(starts, last - i), c["end"]) >= c["end"])
        seen = F.transform(spans, lambda c, i: F.struct(c.alias("c"), (free(c, i) & (c["own"] == 1)).alias("free")))
        return F.transform(F.filter(seen, lambda x: x["free"]), lambda x: F.struct(*[x["c"][k].alias(k) for k in ("start", "no", "end", "kind")]))

    return _bound(
        F.array_sort(F.concat(own(base, 0), own(found, 1))),
        lambda spans: _bound(_running(of_base(spans, "end"), F.greatest), lambda ends: _bound(_running(F.reverse(of_base(spans, "start")), F.least), lambda starts: told(spans, ends, starts))),
    )


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by the first one's kind in brackets.

    A stretch begins with the first span and with each that none before it reaches.  The text is cut into blocks of
    ``BLOCK`` characters once, so that what stays between stretches is found without counting from the beginning.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))

    def cut_out(blocks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.floor((b - 1) / BLOCK).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(near, a - first * BLOCK + 1, b - a)).otherwise("")

    def replaced(spans: Column, ends: Column, blocks: Column) -> Column:
        reached = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        begun = F.filter(F.transform(spans, lambda c, i: F.struct(reached(i).alias("reached"), c["start"].alias("start"), F.upper(c["kind"]).alias("kind"))), lambda x: x["start"] >= x["reached"])
        pieces = F.transform(begun, lambda x: F.concat(cut_out(blocks, x["reached"], x["start"]), F.lit("["), x["kind"], F.lit("]")))
        return F.concat(F.array_join(pieces, ""), cut_out(blocks, F.element_at(ends, -1), F.length(t)))

    whole = lambda spans: _bound(
        _running(F.transform(spans, lambda c: c["end"]), F.greatest),
        lambda ends: _bound(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: replaced(spans, ends, blocks)),
    )
    return _bound(spans, lambda spans: F.when(F.size(spans) == 0, text).otherwise(whole(spans)))
