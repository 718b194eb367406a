"""Personal data by weak supervision, in DataFrame functions only.

*Base* spans come from four regular expressions with checks (email, ip, card, phone) and always stay.  *Candidates* of other
kinds (secret: a long token with digits; number: a run of digits like a phone, account or identity number; person: a title
and a name) are tried by labelers that vote yes, no or abstain:

- shape (regex): the value has the form that such data usually have, or one that they never have;
- gazetteer: a word of the kind's list stands shortly before (yes), or one of its counter-list (no);
- context: what directly surrounds the value (an assignment or a quote; other numbers in a row; a new sentence or a list);
- variety: how many different characters the value has.

The votes of *all* candidates are counted by pattern; expectation-maximisation (Dawid-Skene, two classes, per kind) over those
counts estimates each labeler's reliability without labels and gives each pattern a probability.  These probabilities train
the final span classifier, a logistic regression on features of the span that are no votes: length, share of digits, class
of the character before and of the one after, separators, letter case.  Candidates that it scores 0.5 or more, and that no base
span overlaps, are added.  What is gathered is one row for each pattern of votes and features: four votes of three values
and six features of six values at most, whatever the corpus; its counts cover all candidates.

Offsets are code points: running sums over the pieces between matches, gathered in blocks so that a text with many matches
does not copy its list for each.  Candidates meet base spans by one ordered pass over both, and a text is written anew from chunks of
1,024 characters, so time grows with text and matches, not with their product.  What surrounds a candidate is its own gap to the candidates beside it, with one character of
the one before.

Nulls: a null text is empty.  Very long texts are worked on whole.  Ties: spans that start together stand in the order of the
kinds.  Empty table: no rows, and no model.  Repeated rows are worked on each.  Other columns stay, whatever their names; the
result column ``pii`` replaces one of that name.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shared import free

# Fixed values.  The first four are the base expressions; lookbehinds only say where a leftmost match can begin.
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
SECRET = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+"
NUMBER = "(?<![0-9A-Za-z+])\\(?[0-9](?:[\\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])"
PERSON = "\\b(?:Mr|Mrs|Ms|Dr|Prof)\\.? \\p{Lu}\\p{Ll}+(?: \\p{Lu}\\p{Ll}+)?"
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret", "number", "person"]
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
GAZETTEER = {
    "secret": ["token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access key", "private key"],
    "number": ["phone", "tel", "mobile", "call", "fax", "ssn", "social security", "passport", "account", "iban", "card"],
    "person": ["dear", "contact", "signed", "regards", "sincerely", "patient", "attn"],
}
AGAINST = {
    "secret": ["file", "path", "url", "page", "href", "src", "version", "commit"],
    "number": ["page", "isbn", "issn", "version", "figure", "chapter", "total", "price", "score"],
    "person": ["street", "avenue", "hotel", "saint", "film", "novel"],
}
_AROUND, _AFTER, _BLOCK, _CHUNK = 40, 12, 64, 1024
VOTES = ["shape", "gazetteer", "context", "variety"]
FEATURES = ["length", "digits", "before", "after", "marks", "case"]


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _found(text: Column, pattern: str, guard: Column) -> Column:
    """array<struct<start, end, value, before, after>> of the leftmost non-overlapping matches, if the guard holds; before
    and after are the gaps' ends beside the match."""
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    parts = F.struct(values.alias("v"), gaps.alias("g"))

    def placed(x: Column) -> Column:
        v, g = x["v"], x["g"]
        one = lambda i: F.struct(F.length(F.get(g, i)).alias("gap"), F.length(F.get(v, i)).alias("size"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.transform(F.sequence(b * _BLOCK, F.least((b + 1) * _BLOCK, F.size(v)) - 1), one))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, y: F.struct((a["at"] + y["gap"] + y["size"]).alias("at"), F.concat(a["out"], F.array(a["at"] + y["gap"])).alias("out"))
        outer = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        block = lambda a, y: _let(F.aggregate(y, F.struct(a["at"].alias("at"), start["out"].alias("out")), step), lambda z: F.struct(z["at"].alias("at"), F.concat(a["out"], F.array(z["out"])).alias("out")))
        starts = F.aggregate(blocks, outer, block, lambda a: F.flatten(a["out"]))
        last = lambda i: F.when(i > 0, F.concat(F.right(F.get(v, i - 1), F.lit(1)), F.right(F.get(g, i), F.lit(_AROUND)))).otherwise(F.right(F.get(g, i), F.lit(_AROUND)))
        return F.transform(starts, lambda s, i: F.struct(s.alias("start"), (s + F.length(F.get(v, i))).alias("end"), F.get(v, i).alias("value"), last(i).alias("before"), F.left(F.get(g, i + 1), F.lit(_AFTER)).alias("after")))

    empty = F.array().cast(kind)
    return F.when(guard, _let(parts, lambda x: F.when(F.size(x["v"]) == 0, empty).otherwise(placed(x)))).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.ascii(F.substring(digits, -i, 1)) - 48  # i-th from the right
        double = 2 * d
        return F.when(i % 2 == 1, d).otherwise(F.when(double > 9, double - 9).otherwise(double))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _base_spans(text: Column) -> dict[str, Column]:
    number = text.rlike("[0-9]")
    card = lambda x: F.length(_digits(x["value"])).between(14, 19) & _luhn(_digits(x["value"]))
    return {
        "email": _found(text, EMAIL, text.contains("@")),
        "ip": F.filter(_found(text, IP, text.rlike("[0-9]\\.[0-9]")), lambda x: x["value"].rlike(f"^(?:{_BYTE}\\.){{3}}{_BYTE}$")),
        "card": F.filter(_found(text, CARD, number), card),
        "phone": F.filter(_found(text, PHONE, text.contains("+") & number), lambda x: F.length(_digits(x["value"])).between(10, 15)),
    }


def _candidates(text: Column) -> Column:
    """array of candidates: kind, start, end, value, before and after (what surrounds the value)."""
    number = text.rlike("[0-9]")
    guards = {"secret": number, "number": number, "person": text.rlike("(?:Mr|Ms|Dr|Prof)")}
    patterns = {"secret": SECRET, "number": NUMBER, "person": PERSON}

    named = lambda kind, spans: F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), *[x[c].alias(c) for c in ("start", "end", "value", "before", "after")]))
    return F.concat(*[named(k, _found(text, patterns[k], guards[k])) for k in patterns])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def _listed(x: Column, lists: dict[str, list[str]]) -> Column:
    """Whether a word of the kind's list stands before the value."""
    hit = F.lit(False)
    for kind, names in lists.items():
        hit = F.when(x["kind"] == kind, F.lower(x["before"]).rlike(f"\\b(?:{'|'.join(names)})\\b")).otherwise(hit)
    return hit


def _sign(c: Column) -> Column:
    return F.when(c == "", "none").when(c.rlike("\\s"), "space").when(c.rlike("[\\p{L}\\p{N}]"), "letter").when(c.rlike("[/.@_-]"), "path").otherwise("mark")


def _judged(x: Column) -> Column:
    """The candidate's votes and features."""
    value, kind = x["value"], x["kind"]
    length, n = F.length(value), F.length(_digits(value))
    variety = F.size(F.array_distinct(F.split(value, "")))
    secret, number = kind == "secret", kind == "number"
    key, word = value.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{20,})$"), value.rlike("^[0-9]+$|^(?:[A-Za-z]+[-_/])+|^/|//")
    grouped, dated = value.rlike("^(?:\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"), value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}|^(?:[0-9]+\\.){2,}[0-9]+$")
    full, month = value.rlike("\\p{Lu}\\p{Ll}+ \\p{Lu}\\p{Ll}+$"), value.rlike(" (?:January|February|March|April|May|June|July|August|September|October|November|December|Monday|Sunday)")
    assigned, in_row = x["before"].rlike("[=:][ ]?[\"']?$"), x["before"].rlike("[0-9][ ,;|]+$") | x["after"].rlike("^[ ,;|]+[0-9]")
    opens, verb = x["before"].rlike("(?:^|[\\n,:;(]) *$") | x["after"].rlike("^ *[,;)\\n]"), x["after"].rlike("^ (?:of|and Sons|Street|Road)")
    votes = [
        F.when(secret, _vote(key, word)).when(number, _vote(grouped, dated)).otherwise(_vote(full, month)).alias("shape"),
        _vote(_listed(x, GAZETTEER), _listed(x, AGAINST)).alias("gazetteer"),
        F.when(secret, _vote(assigned, ~assigned)).when(number, _vote(assigned, in_row)).otherwise(_vote(opens, verb)).alias("context"),
        F.when(secret, _vote(variety >= 10, variety < 6)).when(number, _vote(variety >= 7, variety < 4)).otherwise(_vote(variety >= 8, variety < 6)).alias("variety"),
    ]
    lower, upper = value.rlike("\\p{Ll}"), value.rlike("\\p{Lu}")
    features = [
        F.when(length < 12, "12").when(length < 20, "20").when(length < 32, "32").when(length < 48, "48").otherwise("more").alias("length"),
        F.when(n == 0, "none").when(n * 2 < length, "few").when(n < length, "most").otherwise("all").alias("digits"),
        _sign(F.right(x["before"], F.lit(1))).alias("before"),
        _sign(F.left(x["after"], F.lit(1))).alias("after"),
        F.when(value.rlike("[()]"), "round").when(value.rlike("[-/.]"), "marks").when(value.rlike(" "), "spaces").otherwise("plain").alias("marks"),
        F.when(lower & upper, "both").when(lower, "lower").when(upper, "upper").otherwise("none").alias("case"),
    ]
    return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), *votes, *features)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


class Model:
    """Reliabilities of the labelers by kind, and the classifier's weights."""

    def __init__(self, reliability: dict, weights: dict[str, dict[str, float]]):
        self.reliability, self.weights = reliability, weights

    def score(self, x: Column) -> Column:
        """The probability of a judged candidate."""
        total = F.lit(None).cast("double")
        for kind, w in self.weights.items():
            one = F.lit(w["bias"])
            for f in FEATURES:
                part = F.lit(0.0)
                for name, value in w.items():
                    if name.startswith(f"{f}="):
                        part = F.when(x[f] == name[len(f) + 1 :], value).otherwise(part)
                one = one + part
            total = F.when(x["kind"] == kind, one).otherwise(total)
        return F.coalesce(1 / (1 + F.exp(-total)), F.lit(0.0))


def _expectation(rows: list[tuple[tuple[int, ...], float]], rounds: int = 100) -> tuple[list[float], list[list[dict[int, float]]], float]:
    """Two-class Dawid-Skene over (votes, count): each row's probability, the labelers' vote shares by class, the prior."""
    p = [(sum(v == 1 for v in votes) + 0.5) / (sum(v >= 0 for v in votes) + 1) for votes, _ in rows]
    share: list[list[dict[int, float]]] = []
    prior = 0.5
    for _ in range(rounds):
        total = sum(n for _, n in rows)
        prior = min(0.99, max(0.01, sum(q * n for q, (_, n) in zip(p, rows, strict=True)) / total))
        share = []
        for i in range(len(VOTES)):
            by = [{v: 0.5 for v in (-1, 0, 1)} for _ in range(2)]
            for q, (votes, n) in zip(p, rows, strict=True):
                by[1][votes[i]] += q * n
                by[0][votes[i]] += (1 - q) * n
            share.append([{v: x / sum(one.values()) for v, x in one.items()} for one in by])
        new = []
        for votes, _ in rows:
            logs = [math.log(1 - prior), math.log(prior)]
            for i, v in enumerate(votes):
                logs = [logs[c] + math.log(share[i][c][v]) for c in range(2)]
            new.append(1 / (1 + math.exp(min(700, logs[0] - logs[1]))))
        done = max(abs(a - b) for a, b in zip(p, new, strict=True)) < 1e-6
        p = new
        if done:
            break
    return p, share, prior


def _logistic(rows: list[tuple[list[str], float, float]], rounds: int = 300, ridge: float = 1e-3) -> dict[str, float]:
    """Weights of one-hot features from (features, probability, count), by gradient steps."""
    w: dict[str, float] = defaultdict(float)
    total = sum(n for *_, n in rows)
    for _ in range(rounds):
        step: dict[str, float] = defaultdict(float)
        for names, target, n in rows:
            z = sum(w[f] for f in names)
            error = (target - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * n / total
            for f in names:
                step[f] += error
        for f, s in step.items():
            w[f] += 2.0 * (s - ridge * w[f])
    return dict(w)


def fit(docs: DataFrame) -> Model:
    """Reliabilities and classifier from all candidates of docs(text)."""
    judged = F.transform(_candidates(F.col("t")), _judged)
    rows = docs.select(_text().alias("t")).select(F.explode(judged).alias("x"))
    counted = rows.groupBy(*[F.col(f"x.{c}").alias(c) for c in ["kind", *VOTES, *FEATURES]]).count().collect()  # one row a pattern
    by_kind: dict[str, list] = defaultdict(list)
    for r in sorted(counted, key=str):
        by_kind[r["kind"]].append(r)
    reliability, weights = {}, {}
    for kind, found in by_kind.items():
        p, share, prior = _expectation([(tuple(r[v] for v in VOTES), float(r["count"])) for r in found])
        reliability[kind] = {"prior": prior, **{name: {"if_true": s[1], "if_false": s[0]} for name, s in zip(VOTES, share, strict=True)}}
        weights[kind] = {"bias": 0.0} | _logistic([(["bias", *[f"{f}={r[f]}" for f in FEATURES]], q, float(r["count"])) for q, r in zip(p, found, strict=True)])
    return Model(reliability, weights)


def find(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with ``pii``: array<struct<start, rank, end, kind, base>> by start, then kind as listed."""
    t, known = free(docs, "t"), free(docs, "base")
    base = _base_spans(F.col(t))
    struct = lambda x, kind, is_base: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(is_base).alias("base"))
    rows = docs.withColumn(t, _text())
    rows = rows.withColumn(known, F.concat(*[_tagged(s, k, struct) for k, s in base.items()]))
    if model.weights:
        rank = lambda x: F.coalesce(*[F.when(x["kind"] == k, F.lit(KINDS.index(k))) for k in KINDS[4:]], F.lit(len(KINDS)))
        good = F.filter(F.transform(_candidates(F.col(t)), _judged), lambda x: model.score(x) >= threshold)
        unmet = _clear_of(good, known)
        more = F.transform(unmet, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit(False).alias("base")))
        found = F.array_sort(F.concat(known, more))
    else:
        found = F.array_sort(known)
    return rows.withColumn("pii", found).drop(t, known)


def _reached(items: Column, reach) -> Column:
    """The greatest reach(item) of the items before each (0 before the first), worked out in blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int")), lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))
    none = F.array().cast("array<int>")
    step = lambda a, x: F.struct(F.greatest(a["at"], reach(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    inner = lambda a, y: F.aggregate(y, F.struct(a["at"].alias("at"), none.alias("out")), step)
    block = lambda a, y: _let(inner(a, y), lambda z: F.struct(z["at"].alias("at"), F.concat(a["out"], F.array(z["out"])).alias("out")))
    outer = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return F.when(F.size(items) == 0, none).otherwise(F.aggregate(blocks, outer, block, lambda a: F.flatten(a["out"])))


def _clear_of(candidates: Column, known: Column) -> Column:
    """The candidates that no known span overlaps.  Both stand in one order, candidates by their ends and known spans by their
    starts: a candidate is met if a known span before it reaches beyond its start."""
    plain = lambda x: [x[c].alias(c) for c in ("start", "end", "kind")]
    event = lambda at, is_known, x: F.struct(at.alias("at"), F.lit(is_known).alias("known"), *plain(x))
    both = F.array_sort(F.concat(F.transform(candidates, lambda x: event(x["end"], False, x)), F.transform(known, lambda x: event(x["start"], True, x))))
    reach = lambda e: _reached(e, lambda x: F.when(x["known"], x["end"]).otherwise(0))
    marked = lambda e: F.zip_with(e, reach(e), lambda x, r: F.struct(*plain(x), (~x["known"] & (r <= x["start"])).alias("clear")))
    unmet = _let(both, lambda e: F.transform(F.filter(marked(e), lambda x: x["clear"]), lambda x: F.struct(*plain(x))))
    return F.when((F.size(known) == 0) | (F.size(candidates) == 0), F.transform(candidates, lambda x: F.struct(*plain(x)))).otherwise(unmet)


def _tagged(spans: Column, kind: str, struct) -> Column:
    return F.transform(spans, lambda x: struct(x, kind, True))


def told(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _between(chunks: Column, low: Column, high: Column) -> Column:
    """The code points low .. high - 1 of a text given in chunks."""
    size = F.lit(_CHUNK)
    first, last = F.floor(low / size).cast("int"), F.floor(high / size).cast("int")
    head, tail = F.coalesce(F.get(chunks, first), F.lit("")), F.coalesce(F.get(chunks, last), F.lit(""))
    within = F.substring(head, low % size + 1, high - low)
    inner = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(high <= low, "").when(first == last, within).otherwise(F.concat(F.substring(head, low % size + 1, size), inner, F.substring(tail, F.lit(1), high % size)))


def _replaced(x: Column) -> Column:
    """The text with its spans replaced: what lies before each span that begins a run, the run's kind, and the rest."""
    spans, chunks = x["s"], x["chunks"]
    runs = F.filter(F.zip_with(spans, _reached(spans, lambda y: y["end"]), lambda y, r: F.struct(y["start"].alias("start"), y["kind"].alias("kind"), r.alias("from"))), lambda y: y["start"] >= y["from"])
    parts = F.transform(runs, lambda y: F.concat(_between(chunks, y["from"], y["start"]), F.lit("["), F.upper(y["kind"]), F.lit("]")))
    return F.concat(F.array_join(parts, ""), _between(chunks, F.array_max(F.transform(spans, lambda y: y["end"])), F.length(x["t"])))


def redact(docs: DataFrame, model: Model, **options) -> DataFrame:
    """docs, all columns, with every span of the text replaced by its kind in square brackets; spans that overlap
    become one, named by the first."""
    clash = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rows = find(docs.withColumnsRenamed(clash), model, **options)
    text = _text()
    clean = _let(F.struct(text.alias("t"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), 0).alias("chunks"), F.col("pii").alias("s")), _replaced)
    rows = rows.withColumn("_clean", F.when(F.size("pii") == 0, F.col("text")).otherwise(clean))
    return rows.select(*[F.col("_clean").alias("text") if c == "text" else F.col(clash[c]).alias(c) for c in docs.columns])
