"""Personal data by weak supervision, in DataFrame expressions only.

Base findings are fixed patterns with a check each (address parts, Luhn digit,
number of digits); they always stay. Looser patterns name further candidates,
on which three kinds of labelers vote for or against or abstain:

* regex: the strict shape of the kind, or a shape that speaks against it;
* gazetteer: name, calling-code, country and domain lists;
* context: cue words shortly before the candidate.

Candidates are counted by kind and votes in Spark; the number of such patterns
is fixed, so the driver sees a short table. On it expectation-maximisation
estimates how reliable each labeler is and how likely each pattern is personal
data, and a logistic span classifier is trained on those likelihoods. Its
coefficients go back into an expression that adds the candidates it accepts
and that don't overlap a base finding.

Patterns are written so that the regular expression engine neither backtracks
over a run of characters again from each of its places nor recurses: a match
may begin only where a run begins or where the match before ended, and
repetitions are possessive. This finds the same leftmost matches as the plain
patterns. Positions are code points: a text is split at the matches, and the
lengths of pieces and matches add up. All steps work on runs of spans, so the
time grows with the text and its spans, and not with their square.

Edge cases: null and empty texts have no spans; overlapping findings of
different kinds all stay, at equal starts in the order of kinds; a text of any
length is searched whole; repeated rows get equal results; an empty table gives
an empty result and the model of the prior reliabilities; clashing result
columns are replaced and other columns kept; without candidates the prior
reliabilities decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("local_phone", "national_id", "iban", "hidden_email", "person")
_BYTE = "(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
#: Fixed base patterns, in the linear form described above.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Texts without a match of these can't have a finding.
GUARDS = {"email": "@", "ip": None, "card": None, "phone": "+"}
_CANDIDATES = {
    "local_phone": r"(?<![0-9+.(-])(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])",
    "hidden_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]++)++",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra)\.? [A-Z][a-z]++(?: [A-Z][a-z]++)?",
}
#: A text without a match of the pattern, or without any of the words, has no candidate of the kind; cheap to test.
_QUICK = {
    "local_phone": r"[0-9]{3}[ .-][0-9]{4}",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
    "hidden_email": r"[\[(] ?at ?[\])]",
    "person": ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sra"),
}
#: regex labeler: shapes for and against
_FOR = {
    "local_phone": r"^(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?$|^[A-Z]{2}[0-9]{13,30}$",
    "hidden_email": r"^[A-Za-z0-9._%+-]+ ?[\[(] ?at",
    "person": r"^[A-Za-z]+\.? [A-Z][a-z]+ [A-Z][a-z]+$",
}
_AGAINST = {
    "local_phone": r"([0-9])\1{5,}",
    "national_id": r"^(?:000|666|9)|-00-|-0000$|^123-45-6789$",
    "iban": r"^[A-Z]{2}0{2}|^[A-Z0-9 ]*[A-Z]{5}",
    "hidden_email": r"[\[(] ?at ?[\])] ?(?:the|a|an|least|most)$",
    "person": r" (?:The|This|That|And|But|For)$",
}
#: gazetteers
_LISTS = {
    "local_phone": r"^\(?(?:201|202|212|213|305|310|312|404|408|415|503|512|602|617|702|713|718|773|818|917|555|800|888)",
    "national_id": r"^(?:[0-5][0-9]{2}|6[0-57-9][0-9]|66[0-57-9]|7[0-6][0-9]|77[0-2])",
    "iban": r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|RO|SE|SK)",
    "hidden_email": r"(?:com|org|net|edu|gov|io|de|fr|es|uk)$",
    "person": r" (?:John|Mary|James|Anna|Maria|Peter|Paul|Thomas|Michael|Robert|David|Laura|Carlos|Juan|Pierre|Marie|Hans|Klaus|Sabine|Claire|Smith|Jones|Müller|Schmidt|Garcia|Martin|Bernard|Lopez)",
}
#: context cues in the 32 characters before a candidate
_NEAR = {
    "local_phone": r"phone|tel|call|fax|mobile|cell|contact|whatsapp",
    "national_id": r"ssn|social security|national id|tax id|personal number",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "hidden_email": r"mail|contact|write|reach",
    "person": r"dear|regards|signed|patient|name|contact|sehr geehrte",
}
_AWAY = r"version|isbn|invoice|order|serial|part|model|page|room|figure|table"
_BEFORE = 32
LABELERS = ("regex", "gazetteer", "context")
#: Prior reliability of each labeler (share of right votes) and its weight in candidates.
PRIOR = {"regex": 0.8, "gazetteer": 0.75, "context": 0.9}
PRIOR_WEIGHT = 40.0
ROUNDS = 40
#: Likelihood from which the classifier accepts a span.
ACCEPT = 0.9


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


#: Sums, bounds and copies go over runs of so many spans (a power of two), which keeps them linear in the spans.
_RUN_BITS = 7
_RUN = 1 << _RUN_BITS


def _runs(rows: Column) -> Column:
    """An array in runs."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(rows) - 1, F.lit(0)), _RUN_BITS)), lambda b: F.slice(rows, b * _RUN + 1, _RUN))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _before_runs(sizes: Column) -> Column:
    """The sum of all sizes before each run."""
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    sums = F.transform(_runs(sizes), _total)
    return F.aggregate(sums, state, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def _spans(text: Column, pattern: str, quick: Column, before: bool = False) -> Column:
    """(start, end, match) of all matches, with ``before`` also the text just before each; ``quick`` false: none.

    The text is cut at its matches. A match starts where the pieces before it
    end: the sum before its run, and that of the few pieces in the run.
    """
    kind = "array<struct<start:int,end:int,match:string" + (",before:string>>" if before else ">>")
    cut = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    pieces = lambda c: F.struct(c["match"].alias("match"), c["gap"].alias("gap"), F.transform(c["match"], lambda m, i: F.length(c["gap"][i]) + F.length(m)).alias("size"))

    def placed(p: Column, sums: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            run = F.shiftright(i, _RUN_BITS)
            start = sums[run] + _total(F.slice(p["size"], run * _RUN + 1, i - run * _RUN)) + F.length(p["gap"][i])
            fields = [start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match")]
            if before:
                # a piece has five characters or more, so seven of them hold all that counts
                first = F.greatest(i - 6, F.lit(0))
                pairs = F.zip_with(F.slice(p["gap"], first + 1, i - first), F.slice(p["match"], first + 1, i - first), lambda g, x: F.concat(F.substring(g, -_BEFORE, _BEFORE), x))
                fields.append(F.substring(F.concat(F.array_join(pairs, ""), p["gap"][i]), -_BEFORE, _BEFORE).alias("before"))
            return F.struct(*fields)

        return F.transform(p["match"], one)

    found = _let(cut, lambda c: _let(pieces(c), lambda p: _let(_before_runs(p["size"]), lambda sums: placed(p, sums))))
    return F.when(quick, found).otherwise(F.expr(f"cast(array() as {kind})"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    n = F.length(digits)
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2))
    return F.aggregate(F.transform(places, lambda d: F.when(d > 9, d - 9).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    digits = _digits(match)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))


def base_spans(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """``docs`` with ``out``: (start, kind number, end) of the base findings, by start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    steps, names = docs, []
    for k, kind in enumerate(KINDS):
        quick = F.contains(body, F.lit(GUARDS[kind])) if GUARDS[kind] else body.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]" if kind == "ip" else "[0-9](?:[ -]?[0-9]){13}")
        names.append(f"__{kind}")
        steps = steps.withColumn(names[-1], _spans(body, PATTERNS[kind], quick))

    def kept(k: int, kind: str) -> Column:
        good = F.filter(F.col(names[k]), lambda s: _passes(kind, s["match"]))
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))

    each = [kept(k, kind) for k, kind in enumerate(KINDS)]
    return steps.withColumn(out, F.array_sort(F.concat(*each))).drop(*names)


def _vote(kind: Column, match: Column, pro: dict[str, str], contra: dict[str, str] | str) -> Column:
    """1, -1 or 0 by kind."""
    out = None
    for k, name in enumerate(EXTRA_KINDS):
        against = contra if isinstance(contra, str) else contra.get(name)
        vote = F.when(match.rlike(against), -1) if against else F
        vote = vote.when(match.rlike(pro[name]), 1).otherwise(0)
        out = F.when(kind == k, vote) if out is None else out.when(kind == k, vote)
    return out.otherwise(0)


def candidates(docs: DataFrame, text: str = "text", base: str = "base", out: str = "cand") -> DataFrame:
    """``docs`` with ``out``: (start, kind number, end, votes) of candidates that overlap no base finding."""
    body = F.coalesce(F.col(text), F.lit(""))
    steps, names = docs, []
    for kind in EXTRA_KINDS:
        quick = _QUICK[kind]
        test = body.rlike(quick) if isinstance(quick, str) else F.greatest(*(F.contains(body, F.lit(w)) for w in quick))
        names.append(f"__{kind}")
        steps = steps.withColumn(names[-1], _spans(body, _CANDIDATES[kind], test, before=True))

    # base findings in runs with their bounds, so that a candidate meets those of few runs
    bounds = lambda r: F.struct(F.get(r, F.lit(0))["start"].alias("low"), F.array_max(F.transform(r, lambda b: b["end"])).alias("high"), r.alias("rows"))
    steps = steps.withColumn("__held", F.transform(_runs(F.col(base)), bounds))

    def apart(k: int) -> Column:
        over = lambda s, low, high: (low < s["end"]) & (s["start"] < high)
        hits = lambda s, runs: F.exists(runs, lambda r: over(s, r["low"], r["high"]) & F.exists(r["rows"], lambda b: over(s, b["start"], b["end"])))
        free = F.filter(F.col(names[k]), lambda s: ~F.coalesce(hits(s, F.col("__held")), F.lit(False)))
        return F.transform(free, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["match"].alias("match"), F.lower(s["before"]).alias("before")))

    def labelled(s: Column) -> Column:
        votes = (_vote(s["kind"], s["match"], _FOR, _AGAINST), _vote(s["kind"], s["match"], _LISTS, {}), _vote(s["kind"], s["before"], _NEAR, _AWAY))
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), *(v.cast("int").alias(n) for v, n in zip(votes, LABELERS, strict=True)))

    named = F.concat(*(apart(k) for k in range(len(EXTRA_KINDS))))
    return steps.withColumn("__named", named).withColumn(out, F.transform(F.col("__named"), labelled)).drop(*names, "__named", "__held")


@dataclass(frozen=True)
class SpanModel:
    """Labelers' reliabilities, and the classifier's weights: a constant, one for each vote, one for each kind."""

    reliability: dict[str, float]
    bias: float
    votes: tuple[float, ...]
    kinds: tuple[float, ...]

    def likelihood(self, kind: Column, votes: list[Column]) -> Column:
        z = F.lit(self.bias)
        for w, v in zip(self.votes, votes, strict=True):
            z = z + F.lit(w) * v
        for k, w in enumerate(self.kinds):
            z = z + F.when(kind == k, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_counts(patterns: list[tuple[int, tuple[int, ...], int]]) -> SpanModel:
    """Expectation-maximisation and classifier on (kind, votes, count)."""
    rel = [PRIOR[n] for n in LABELERS]
    share = 0.5
    post = [0.5] * len(patterns)
    for _ in range(ROUNDS):
        for i, (_, votes, _) in enumerate(patterns):
            z = math.log(share / (1 - share)) + sum(v * math.log(r / (1 - r)) for v, r in zip(votes, rel, strict=True))
            post[i] = _sigmoid(z)
        total = sum(n for _, _, n in patterns)
        share = min(0.95, max(0.05, (sum(p * n for p, (_, _, n) in zip(post, patterns, strict=True)) + 10) / (total + 20)))
        for k, name in enumerate(LABELERS):
            right = sum((p if v[k] > 0 else 1 - p) * n for p, (_, v, n) in zip(post, patterns, strict=True) if v[k])
            cast = sum(n for _, v, n in patterns if v[k])
            rel[k] = min(0.98, max(0.55, (right + PRIOR[name] * PRIOR_WEIGHT) / (cast + PRIOR_WEIGHT)))
    start = [math.log(r / (1 - r)) for r in rel]
    weights, bias, kinds = list(start), 0.0, [0.0] * len(EXTRA_KINDS)
    total = sum(n for _, _, n in patterns)
    for _ in range(300 if total else 0):
        gw, gb, gk = [0.0] * len(weights), 0.0, [0.0] * len(kinds)
        for p, (kind, votes, n) in zip(post, patterns, strict=True):
            error = (p - _sigmoid(bias + sum(w * v for w, v in zip(weights, votes, strict=True)) + kinds[kind])) * n / total
            gb += error
            gk[kind] += error
            gw = [g + error * v for g, v in zip(gw, votes, strict=True)]
        bias += gb
        weights = [w + g - 0.02 * (w - s) for w, g, s in zip(weights, gw, start, strict=True)]
        kinds = [w + g - 0.05 * w for w, g in zip(kinds, gk, strict=True)]
    return SpanModel(dict(zip(LABELERS, rel, strict=True)), bias, tuple(weights), tuple(kinds))


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """Learn from the candidates of all ``docs``; what reaches the driver is a count for each kind and votes."""
    found = candidates(base_spans(docs.select(text), text), text).select(F.explode("cand").alias("c")).select("c.kind", *(f"c.{n}" for n in LABELERS))
    rows = found.groupBy("kind", *LABELERS).count().collect()
    return fit_counts(sorted((r["kind"], tuple(r[n] for n in LABELERS), r["count"]) for r in rows))


def find(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` (start, kind, end) and ``spans`` (start, kind name, end), base and accepted ones, by start and kind."""
    both = candidates(base_spans(docs, text), text)
    accepted = F.filter(F.col("cand"), lambda s: model.likelihood(s["kind"], [s[n] for n in LABELERS]) >= ACCEPT)
    extra = F.transform(accepted, lambda s: F.struct(s["start"].alias("start"), (s["kind"] + len(KINDS)).alias("kind"), s["end"].alias("end")))
    names = F.array(*(F.lit(n) for n in (*KINDS, *EXTRA_KINDS)))
    spans = F.transform(F.array_sort(F.concat(F.col("base"), extra)), lambda s: F.struct(s["start"].alias("start"), names[s["kind"]].alias("kind"), s["end"].alias("end")))
    return both.withColumn("spans", spans).drop("cand")


def redact(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans go by the first one's kind."""
    found = find(docs, model, text)

    def masked_run(acc: Column, run: Column) -> Column:
        """A run of spans on the part of the text from where the last one ended."""
        reach = F.greatest(F.array_max(F.transform(run, lambda s: s["end"])), acc["at"])
        part = F.struct(F.substring(F.col(text), acc["at"] + 1, reach - acc["at"]).alias("text"), acc["at"].alias("from"))

        def inner(p: Column) -> Column:
            def step(a: Column, s: Column) -> Column:
                gap = F.substring(p["text"], a["at"] - p["from"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
                mark = F.when(s["start"] >= a["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], gap, mark).alias("out"))

            return F.aggregate(run, F.struct(p["from"].alias("at"), F.lit("").alias("out")), step)

        return _let(_let(part, inner), lambda done: F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out")))

    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text))))
    masked = F.when(F.size("spans") > 0, _let(F.col("spans"), lambda spans: F.aggregate(_runs(spans), state, masked_run, rest))).otherwise(F.col(text))
    return found.withColumn(text, masked).select(*docs.columns)
