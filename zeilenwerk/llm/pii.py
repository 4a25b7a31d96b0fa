"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Four base kinds are found by their patterns: email, ip, card (Luhn) and phone, leftmost and without overlap within a
kind. They and keys (runs of KEY_CHARS and more letters and digits, mixed) are the seeds. A pattern is the context of an
identifier-like token: the word before and the word after it, or the two words before it, in lower case, whatever the
token's shape and length; a mark beside the token, as a quote, is no word. Patterns and instances (the
tokens' values) form a graph. It is scored in rounds until no pattern changes: a pattern's score is the mean squared
score of its occurrences' instances (with one fictitious miss), an instance's the score of its best pattern; a value
that is a seed anywhere keeps 1. Scores are whole hundredths, rounded down, and only grow, so the rounds end, always
with the same scores. Patterns that reach
ACCEPT with at least SUPPORT occurrences of seeds or of instances of that score extract the tokens in their context that
no base pattern knows, as spans of the kind `context`; a key alone, in no such context, is none.

Texts of any length are read by possessive patterns, which match as the greedy ones do but neither back up nor
recurse. Null and empty texts have no spans. Null ids and repeated rows keep their own rows. Offsets are code points,
ends exclusive. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A start is only tried where a run of the first class begins, or where the last match ended: if
#: a match fails from there, it fails from inside the run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that can be an identifier: runs of six characters and more that hold a digit or @, without the marks at their
#: ends.
TOKEN = r"(?<![A-Za-z0-9@._:/+-])(?=[A-Za-z0-9._:/+-]*[0-9@])[A-Za-z0-9+][A-Za-z0-9@._:/+-]{4,}[A-Za-z0-9]"
#: A key has so many characters, and so many digits and letters among them.
KEY_CHARS, KEY_EACH = 24, 6
#: Hundredths that a pattern's score has to reach, and occurrences that have to back it.
ACCEPT, SUPPORT = 60, 3
SPAN = "struct<kind:int,start:int,end:int,value:string>"
#: Matches of a text that are gathered at a time.
RUN = 256


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.element_at(
            F.when((n - i) % 2 == 0, F.array(*map(F.lit, range(10)))).otherwise(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))),
            F.substring(digits, i, F.lit(1)).cast("int") + 1,
        ),
    )
    return total % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    d = _digits(m)
    if kind == "card":
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))
    return F.length(d).between(9, 15)


def running(pairs: Column, made: str, step) -> Column:
    """What step(at, x) -> (next at, array of `made`) gives over an array, in order. Results are gathered in runs of
    RUN, so that a long text isn't copied once for each of its matches."""
    n = F.size(pairs)
    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda i: F.slice(pairs, i * RUN + 1, F.lit(RUN)))

    def inner(acc, x):
        at, out = step(acc["at"], x)
        return F.struct(at.alias("at"), F.when(F.size(out) > 0, F.concat(acc["out"], out)).otherwise(acc["out"]).alias("out"))

    def outer(acc, run):
        done = F.aggregate(run, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{made}>").alias("out")), inner)
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))[0]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{made}>>").alias("out"))
    return F.when(n > 0, F.aggregate(runs, start, outer, lambda acc: F.flatten(acc["out"]))).otherwise(F.array().cast(f"array<{made}>"))


def base(text: Column, kind: str) -> Column:
    """The spans of one kind. What lies between the matches tells where they are."""
    found, between = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)
    pairs = F.arrays_zip(found.alias("m"), F.transform(F.slice(between, F.lit(1), F.size(found)), F.length).alias("gap"))

    def step(at, x):
        lo = at + x["gap"]
        hi = lo + F.length(x["m"])
        span = F.array(F.struct(F.lit(KINDS.index(kind)).alias("kind"), lo.alias("start"), hi.alias("end"), x["m"].alias("value")))
        return hi, F.filter(span, lambda s: _passes(kind, s["value"]))

    return F.when(text.rlike(PATTERNS[kind]), running(pairs, SPAN, step)).otherwise(F.array().cast(f"array<{SPAN}>"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, (*KINDS, "context")))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def tokens(text: Column) -> Column:
    """An array of (value, gap before it, the words before it, the word after it), one for each identifier-like token.

    A text is cut at its tokens; the words at the ends of the parts between them are the contexts."""
    found, between = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(text, TOKEN, -1)
    # the last words are the first ones from behind, which no long part has to be searched for
    tail = lambda x: F.lower(F.reverse(F.regexp_extract(F.reverse(x), r"^[^ \t\r\n]?[ \t]*([^ \t\r\n]++(?:[ \t]++[^ \t\r\n]++)?)", 1)))
    head = lambda x: F.lower(F.regexp_extract(x, r"^[^ \t\r\n]?[ \t]+([^ \t\r\n]++)", 1))
    near = F.transform(between, lambda x: F.struct(F.length(x).alias("gap"), tail(x).alias("tail"), head(x).alias("head")))
    zipped = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(near, F.lit(1), F.size(found)).alias("before"), F.slice(near, F.lit(2), F.size(found)).alias("after")),
        lambda x: F.struct(x["m"].alias("value"), x["before"]["gap"].alias("gap"), x["before"]["tail"].alias("tail"), x["after"]["head"].alias("head")),
    )
    return F.when(text.rlike("[0-9@]"), zipped).otherwise(F.array().cast("array<struct<value:string,gap:int,tail:string,head:string>>"))


def candidates(found: DataFrame) -> DataFrame:
    """found (__row, __base, __tokens) -> __row, value, start, end, pattern, known (in a base span), seed."""

    def step(at, x):
        lo = at + x["gap"]
        hi = lo + F.length(x["value"])
        return hi, F.array(F.struct(x["value"].alias("value"), lo.alias("start"), hi.alias("end"), x["tail"].alias("tail"), x["head"].alias("head")))

    steps = running(F.col("__tokens"), "struct<value:string,start:int,end:int,tail:string,head:string>", step)
    each = found.where(F.size("__tokens") > 0).select("__row", "__base", F.inline(steps))
    known = F.exists("__base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    count = lambda of: F.length(F.regexp_replace("value", of, ""))
    key = F.col("value").rlike(f"^[A-Za-z0-9+/_-]{{{KEY_CHARS},}}$") & (count("[^0-9]") >= KEY_EACH) & (count("[^A-Za-z]") >= KEY_EACH)
    each = each.select("__row", "value", "start", "end", known.alias("known"), (known | key).alias("seed"), "tail", "head")
    last = F.element_at(F.split("tail", r"[ \t]+"), -1)
    patterns = F.filter(
        F.array(
            F.when((F.col("tail") != "") & (F.col("head") != ""), F.concat_ws(" ", last, F.lit("<>"), "head")),
            F.when(F.col("tail").contains(" "), F.concat_ws(" ", "tail", F.lit("<>"))),
        ),
        lambda p: p.isNotNull(),
    )
    return each.select("__row", "value", "start", "end", "known", "seed", F.explode(patterns).alias("pattern"))


def scored(edges: DataFrame) -> DataFrame:
    """edges (pattern, value, n, seeds) -> pattern, score (hundredths), support. Values that are seeds somewhere count the
    same in every round, so the rounds read the other values' edges only. Groups are summed before they are shuffled, and
    all sums are whole numbers."""
    known = edges.groupBy("value").agg((F.max("seeds") > 0).alias("sure"))
    weighed = written(edges.join(known, "value").select("pattern", "value", "n", "sure"), "weighed")
    score = lambda more: F.expr(f"cast((held * 10000 + {more}) div ((uses + 1) * 100) as int)")
    totals = weighed.groupBy("pattern").agg(F.sum("n").alias("uses"), F.sum(F.when(F.col("sure"), F.col("n")).otherwise(0)).alias("held"))
    patterns = written(totals.select("*", score("0").alias("score"), F.col("held").alias("support")), "patterns")
    unsure = weighed.where(~F.col("sure"))
    while True:
        best = unsure.join(patterns.where("score > 0").select("pattern", "score"), "pattern").groupBy("value").agg(F.max("score").cast("long").alias("instance"))
        sums = unsure.join(best, "value").groupBy("pattern").agg(
            F.sum(F.col("n") * F.col("instance") * F.col("instance")).alias("more"),
            F.sum(F.when(F.col("instance") >= ACCEPT, F.col("n")).otherwise(0)).alias("backed"),
        )
        after = patterns.withColumnsRenamed({"score": "__score", "support": "__support"}).join(sums, "pattern", "left")
        after = after.select("pattern", "uses", "held", score("coalesce(more, 0)").alias("score"), (F.col("held") + F.coalesce("backed", F.lit(0))).alias("support"), "__score", "__support")
        after = written(after, "patterns")
        if after.where("score != __score or support != __support").isEmpty():
            return after.select("pattern", "score", "support")
        patterns = after.drop("__score", "__support")


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, base and spans (arrays of kind, start, end, value; kinds by their place in KINDS, then `context`)."""
    own = {f"__keep{i}": F.col(c) for i, c in enumerate(keep)}
    rows = docs.select(*[c.alias(n) for n, c in own.items()], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    base_spans = F.concat(*[base(F.col("__text"), k) for k in KINDS])
    # one pass over the texts: rows get their numbers where they are written
    found = written(rows.select(*own, base_spans.alias("__base"), tokens(F.col("__text")).alias("__tokens"), F.monotonically_increasing_id().alias("__row")), "base")
    uses = written(candidates(found), "contexts")
    edges = uses.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("seed").cast("int")).alias("seeds"))
    good = scored(written(edges, "edges")).where((F.col("score") >= ACCEPT) & (F.col("support") >= SUPPORT))
    new = uses.where(~F.col("known")).join(good.select("pattern"), "pattern", "left_semi")
    new = new.groupBy("__row").agg(F.collect_set(F.struct(F.lit(len(KINDS)).alias("kind"), "start", "end", "value")).alias("__new"))
    out = found.join(new, "__row", "left")
    return out.select(*[F.col(n).alias(c) for n, c in zip(own, keep, strict=True)], F.col("__base").alias("base"), F.concat("__base", F.coalesce("__new", F.array().cast(f"array<{SPAN}>"))).alias("spans"))


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    found = find(docs, text)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in capitals and brackets; of overlapping spans the first, then the
    longest. Equal texts have equal spans, so these are joined to the texts by their hash, and no row needs a number."""
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns({"__k0": F.xxhash64(body), "__k1": F.xxhash64(F.lit(1), body)})
    found = find(keyed, text, ("__k0", "__k1")).where(F.size("spans") > 0)
    found = written(found.groupBy("__k0", "__k1").agg(F.first("spans").alias("__spans")), "spans")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "context")])
    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    # a span with the place where what is kept before it begins; overlapped ones give nothing
    def step(at, x):
        part = F.concat(F.substring(F.col(text), at + 1, x["start"] - at), F.element_at(names, x["kind"] + 1))
        skip = x["start"] < at
        return F.when(skip, at).otherwise(-x["end"]), F.when(skip, F.array().cast("array<string>")).otherwise(F.array(part))

    parts = running(ordered, "string", step)
    tail = F.aggregate(ordered, F.lit(0), lambda at, x: F.greatest(at, -x["end"]))
    clean = F.concat(F.array_join(parts, ""), F.substring(F.col(text), tail + 1, F.length(text)))
    # what grows with the documents is never broadcast
    out = keyed.join(found.hint("merge"), ["__k0", "__k1"], "left").withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(clean))
    return out.select(*docs.columns)
