"""Operator 10: personal data by fixed formats and by boosted trees over proposed spans.

DataFrame functions and Spark ML only.  A pattern's matches come from
``regexp_extract_all`` and the text between them from ``split`` with the same
pattern, which gives each match its place in code points.  The base kinds drop
matches that fail their check.

Beyond them, wide generators propose spans, which may overlap: number-like
strings, addresses with an at sign in any spelling, dotted numbers, account
numbers.  A proposal that overlaps a match which failed its check is dropped: the
check has decided it (but not an account number, whose letters it has not seen).
The others that overlap no base span are the open ones.
An open proposal is added if a cue that names its kind stands right before it
("IBAN: ", "call me at ").

Boosted trees add those of the same formats without a cue.  They see the format
alone, never the cue.  Their positives are the base spans written in spellings that
no base format takes (an address with "[at]", a phone number without its +, a card
number with other separators), in the text where they stand, and the open
proposals with a cue; their negatives are open proposals without one.  They are
fitted on a hashed sample of at most about ``fit_rows`` of each.

The score cutoff is set on open proposals that the trees have not seen, by their
cues: taking personal data to be named by a cue as often outside the base formats
as inside them, the precision of the proposals above a cutoff is their share with
a cue over that of the base spans.  The cutoff is the lowest of ``CUTOFFS`` at
which the lower bound of the one over the upper bound of the other reaches
``precision``, all bounds corrected for the number of cutoffs tried; the search
ends before a step whose own proposals fall short of it beyond doubt.  Where there
are fewer than ``least`` examples of a class, or no cutoff is good enough, as in a
corpus without cues, the trees add nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltide.llm.common import Stage, let

_LOCAL = "A-Za-z0-9._%+-"
#: kind -> (pattern, cheap test that a text can match).  Possessive and anchored to the start of a
#: run (or the end of the last match), which matches the same and takes linear time and no stack.
BASE = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]++\."),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15,}+", r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
GENERATORS = {
    "number": (r"[0-9](?:[\x20().\-/]{0,2}+[0-9]){6,}+", r"[0-9](?:[\x20().\-/]{0,2}+[0-9]){6}"),
    "address": (r"(?<![^\s@,;:<>()\[\]\"'])[^\s@,;:<>()\[\]\"']++\x20?(?:@|[(\[]at[)\]])\x20?[^\s@,;:<>()\[\]\"']++", r"@|[(\[]at[)\]]"),
    "dotted": (r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3,}+", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "account": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{4}|\x20?[0-9]{1,3}|[A-Z0-9]{1,3})(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
}
CUES = r"(?i)(?:mail|contact|call|phone|tel|fax|mobile|card|visa|account|iban|host|addr|server|client|\bip\b|\bid\b|ssn)"
_AFTER = r"(?:[\x20.:=#-]{1,3}(?:me|us|is|at|to|no|nr|number|address))*[\x20.:=#(-]{1,4}$"
#: kind -> cue that names it, at the end of the text before a proposal.  Dotted numbers have none: the base check decides them.
NAMED = {
    "number": rf"(?i)\b(?:phone|telephone|tel|call|fax|mobile|cell|ssn|social security|passport|account|acct){_AFTER}",
    "address": rf"(?i)\b(?:e-?mail|mail|contact|write|reach){_AFTER}",
    "account": rf"(?i)\b(?:iban|account|acct|bank){_AFTER}",
}
SPAN = "array<struct<s:int,e:int>>"
FIT_ROWS, PRECISION, LEAST = 20_000, 0.95, 20


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    def add(total: Column, i: Column, d: Column) -> Column:
        digit = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return let(_digits(x), lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda t, i: add(t, i, d)) % 10 == 0)


def _small_parts(x: Column) -> Column:
    bare = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.lit(True),
    "ip": _small_parts,
    "card": lambda x: F.length(_digits(x)).between(16, 19) & _luhn(x),
    "phone": lambda x: F.length(_digits(x)).between(8, 15),
}


def _walk(text: Column, pattern: str, test: str, ddl: str, make: Callable, keep: Callable | None = None) -> Column:
    """Array of ``make(match, start, end, before, after)`` over the matches that ``keep``; one pass over them."""
    none = F.array().cast(ddl)

    def step(state: Column, i: Column, found: Column, gaps: Column) -> Column:
        start, match = state["at"] + F.length(F.get(gaps, i)), F.get(found, i)
        end = start + F.length(match)
        item = F.array(make(match, start, end, F.get(gaps, i), F.get(gaps, i + 1))).cast(ddl)
        grown = F.concat(state["items"], item)
        return F.struct(end.alias("at"), (F.when(keep(match), grown).otherwise(state["items"]) if keep else grown).alias("items"))

    def over(found: Column, gaps: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), none.alias("items")),
                           lambda s, i: step(s, i, found, gaps), lambda s: s["items"])

    walked = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                 lambda found: let(F.split(text, pattern, -1), lambda gaps: F.when(F.size(found) > 0, over(found, gaps)).otherwise(none)))
    return F.when(text.rlike(test), walked).otherwise(none)


#: Features of a proposal: what its text looks like, and what stands around it.
FEATURES = ("length", "digits", "letters", "groups", "dots", "dashes", "blanks", "at", "plus", "brackets", "first_group", "last_group",
            "cue", "gap_before", "gap_after", "letter_before", "letter_after", "kind")
#: Those that do not tell whether a cue stands before the proposal.
FORMAT = [k for k, name in enumerate(FEATURES) if name not in ("plus", "cue", "gap_before", "gap_after", "letter_before", "letter_after")]
#: kind -> generator that would propose it in other spellings, and these, as (pattern, replacement).
SPELLINGS = {
    "email": ("address", [("@", " [at] "), ("@", "(at)")]),
    "phone": ("number", [(r"^\+", ""), (r"^\+[0-9]{1,2}[\x20().-]*", "0"), (r"[+()]", "")]),
    "card": ("number", [(r"[\x20-]", "."), (r"[\x20-]", "/"), (r"([0-9]{4})(?=[0-9])", "$1.")]),
}
MATCH = "array<struct<s:int,e:int,ok:boolean,other:array<array<double>>>>"
CANDIDATE = "array<struct<s:int,e:int,kind:string,cued:boolean,f:array<double>>>"


def _near(before: Column) -> Column:
    return F.substring(before, F.greatest(F.length(before) - 39, F.lit(1)), F.lit(40))


def _features(m: Column, before: Column, after: Column, kind: int) -> Column:
    def count(pattern: str) -> Column:
        return F.regexp_count(m, F.lit(pattern))

    near = _near(before)
    parts = F.split(m, "[^A-Za-z0-9]+")
    last_sign, next_sign = F.right(near, F.lit(1)), F.left(after, F.lit(1))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    values = [F.length(m), count("[0-9]"), count("[A-Za-z]"), F.size(parts), count(r"\."), count("-"), count(r"\x20"), count("@"),
              flag(last_sign.isin("+", "(")), count(r"[()\[\]]"), F.length(F.get(parts, F.lit(0))), F.length(F.element_at(parts, -1)),
              flag(near.rlike(CUES)), F.least(F.length(before), F.lit(100)), F.least(F.length(after), F.lit(100)),
              flag(last_sign.rlike(r"\p{L}")), flag(next_sign.rlike(r"\p{L}")), F.lit(kind)]
    return F.array(*[v.cast("double") for v in values])


def base_matches(text: Column) -> dict[str, Column]:
    """Each base kind's matches by start: place in code points, whether the check passes, features in other spellings."""
    def item(k: str, m: Column, s: Column, e: Column, before: Column, after: Column) -> Column:
        generator, ways = SPELLINGS.get(k, ("number", []))
        number = list(GENERATORS).index(generator)
        other = F.array(*[_features(F.regexp_replace(m, a, b), before, after, number) for a, b in ways])
        return F.struct(s.alias("s"), e.alias("e"), CHECKS[k](m).alias("ok"), other.cast("array<array<double>>").alias("other"))

    return {k: _walk(text, pattern, test, MATCH, lambda *x, k=k: item(k, *x)) for k, (pattern, test) in BASE.items()}


def proposals(text: Column) -> Column:
    """All generators' spans with their features, and whether a cue names them."""
    def named(before: Column, kind: str) -> Column:
        return F.coalesce(_near(before).rlike(NAMED[kind]), F.lit(False)) if kind in NAMED else F.lit(False)

    found = [_walk(text, pattern, test, CANDIDATE,
                   lambda m, s, e, before, after, k=k, n=n: F.struct(
                       s.alias("s"), e.alias("e"), F.lit(k).alias("kind"), named(before, k).alias("cued"), _features(m, before, after, n).alias("f")))
             for n, (k, (pattern, test)) in enumerate(GENERATORS.items())]
    return F.concat(*found)


#: Score cutoffs that may be chosen.
CUTOFFS = tuple(k / 40 for k in range(39, 0, -1))


def _bound(good: float, n: float, side: int, tests: int = 1) -> float:
    """Lower (-1) or upper (1) Wilson bound of a share, at 95% one-sided over ``tests`` of them."""
    from statistics import NormalDist

    share, z = good / n, NormalDist().inv_cdf(1 - 0.05 / tests)
    return (share + z * z / (2 * n) + side * z * ((share * (1 - share) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)


def _train(sample: DataFrame, check: DataFrame, precision: float, base_rate: float, least: int, trees: int, depth: int, seed: int):
    """(model, cutoff) or None; ``sample`` (f, label) is learned from, ``check`` (f, cued) are open proposals not in it."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(counts.get(label, 0) for label in (0.0, 1.0)) < least:
        return None
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label").fit(sample.withColumn("features", array_to_vector("f")))
    p = vector_to_array("probability")[1]
    scored = model.transform(check.withColumn("features", array_to_vector("f"))).select("cued", p.alias("p"))
    totals = scored.agg(*[F.count_if(F.col("p") >= c).alias(f"n{k}") for k, c in enumerate(CUTOFFS)],
                        *[F.count_if((F.col("p") >= c) & F.col("cued")).alias(f"c{k}") for k, c in enumerate(CUTOFFS)]).first()
    best, n, cued, wanted = None, 0, 0, precision * base_rate
    for k, c in enumerate(CUTOFFS):
        more, more_cued = totals[f"n{k}"] - n, totals[f"c{k}"] - cued
        if more and _bound(more_cued, more, 1, len(CUTOFFS)) < wanted:
            break  # what this cutoff would add is not good enough, however good the rest
        n, cued = totals[f"n{k}"], totals[f"c{k}"]
        if n >= least and _bound(cued, n, -1, len(CUTOFFS)) >= wanted:
            best = c
    return None if best is None else (model, best)


def _listed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"], F.lit(":"), x["e"]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS,
             precision: float = PRECISION, least: int = LEAST, trees: int = 8, depth: int = 4, seed: int = 1) -> DataFrame:
    """Per row: ``id_col``, n_email, n_ip, n_card, n_phone, base_sha256, spans, and ``found``, the spans as an array.

    Null and empty texts have no spans.  Rows are independent but for the training sample;
    repeated rows give repeated results, ids may be null or repeat, other columns are
    ignored.  An empty table gives no rows.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    stage = Stage(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col), F.lit(""))
    table = docs.select(F.col(id_col).alias("_id"), *[c.alias(f"m_{k}") for k, c in base_matches(text).items()], proposals(text).alias("proposed"))
    table = stage.put(table.withColumn("_row", F.monotonically_increasing_id()), "found")
    for k in BASE:
        passed = F.filter(f"m_{k}", lambda x: x["ok"])
        table = table.withColumn(f"b_{k}", F.transform(passed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    base = F.concat(*[F.col(f"b_{k}") for k in BASE])
    refused = F.concat(*[F.filter(f"m_{k}", lambda x: ~x["ok"]) for k in BASE])
    meets = lambda spans: F.exists(spans, lambda b: (b["s"] < F.col("c.e")) & (F.col("c.s") < b["e"]))
    each = table.where(F.size("proposed") > 0).select("_row", base.alias("base"), refused.alias("refused"), F.explode("proposed").alias("c")).select(
        "_row", "c.s", "c.e", "c.kind", "c.cued", "c.f", meets("base").alias("known"), (meets("refused") & (F.col("c.kind") != "account")).alias("refused"))
    place = ("_row", "kind", "s", "e")
    spot = F.pmod(F.xxhash64(*place, F.lit(seed)), F.lit(1 << 30))
    form = F.array(*[F.get("f", F.lit(k)) for k in FORMAT])
    outside = stage.put(each.where("not known and not refused").withColumn("spot", spot).withColumn("f", form), "open")
    other = F.flatten(F.concat(*[F.transform(F.filter(f"m_{k}", lambda x: x["ok"]), lambda x: x["other"]) for k in SPELLINGS]))
    respelled = table.where(F.size(base) > 0).select("_row", F.posexplode(other).alias("k", "f")).withColumn("f", form)
    totals = outside.agg(F.count_if(F.col("cued")).alias("cued"), F.count_if(~F.col("cued")).alias("rest")).first()
    share = lambda n: int(min(1.0, fit_rows / max(1, n)) * (1 << 30))
    learn = outside.where("spot % 4 <> 0").withColumn("spot", F.shiftright("spot", 2) * 4)
    positive = learn.where("cued").where(F.col("spot") < share(totals["cued"])).select("f").union(
        respelled.where(F.pmod(F.xxhash64("_row", "k", F.lit(seed)), F.lit(1 << 30)) < share(respelled.count())).select("f"))
    negative = learn.where("not cued").where(F.col("spot") < share(totals["rest"])).select("f")
    sample = stage.put(positive.withColumn("label", F.lit(1.0)).union(negative.withColumn("label", F.lit(0.0))), "sample")
    named = each.where(F.col("known") & F.col("kind").isin(*NAMED)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cued")).alias("cued")).first()
    base_rate = _bound(named["cued"], named["n"], 1, len(CUTOFFS)) if named["n"] else 1.0
    fresh = [outside.where("cued").select(*place)]
    trained = _train(sample, outside.where("spot % 4 = 0").select("f", "cued"), precision, base_rate, least, trees, depth, seed)
    if trained is not None:
        model, cutoff = trained
        scored = model.transform(outside.withColumn("features", array_to_vector("f")))
        fresh.append(scored.where(vector_to_array("probability")[1] >= cutoff).select(*place))
    every = functools.reduce(DataFrame.unionByName, fresh)
    added = every.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("kind", "s", "e"))).alias("more"))
    table = table.join(stage.put(added, "added"), "_row", "left")
    stage.drop("open", "sample")
    listed = F.concat(*[_listed(F.col(f"b_{k}"), k) for k in BASE])
    more = F.coalesce("more", F.array().cast("array<struct<kind:string,s:int,e:int>>"))
    extra = F.transform(more, lambda x: F.concat(x["kind"], F.lit(":"), x["s"], F.lit(":"), x["e"]))
    found = F.array_sort(F.concat(base, F.transform(more, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))))
    return table.select(
        F.col("_id").alias(id_col), *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(listed, ","), 256).alias("base_sha256"), F.array_join(F.concat(listed, extra), ",").alias("spans"),
        found.alias("found"))


def redact(text: Column, found: Column, mark: str = "<PII>") -> Column:
    """``text`` with the sorted spans ``found`` replaced; overlapping spans become one mark."""
    def step(state: Column, x: Column) -> Column:
        fresh = x["s"] >= state["at"]
        piece = F.when(fresh, F.concat(F.substring(text, state["at"] + 1, x["s"] - state["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], x["e"]).alias("at"), F.concat(state["out"], piece).alias("out"))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
