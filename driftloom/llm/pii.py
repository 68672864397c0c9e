"""Personal data: fixed patterns, then bootstrapped contextual extraction.

Base spans come from four patterns; they and long hexadecimal keys are the
seeds.  They induce lexical patterns: the word before or after an instance, the
two words before, or a label such as ``mail:`` in front.  Patterns and
instances (seeds, identifier-like tokens, groups of digits with blanks) form a
graph.  A pattern is as good for a kind as the share of its instances that are
trusted to be of that kind; those trusted to be of another don't count, and
those that look like it, but aren't trusted, count less; an
instance is trusted as its best pattern on either side is, and counts for its
patterns once it is beyond the trust limit.  After some rounds such instances
add spans wherever they stand in such a context.  SQL functions only; nothing but counts of distinct pattern-instance
pairs enters the rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, columns_apart, cut, lookup

#: Kinds with base patterns, and all that the method adds spans of.
KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
#: Rounds of scoring, trust from which an instance counts, code points of context that patterns are taken from.
ROUNDS, TRUST, CONTEXT = 3, 0.8, 64
#: What an instance of a kind that is not trusted counts against a pattern for that kind.
DOUBT = 0.25
#: Rows up to which a table is broadcast.
SMALL = 100_000
SPANS = "array<struct<start:int,end:int>>"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A run of non-blanks with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Two to eight runs of digits and number signs with single blanks between, up to a blank or the end.
GROUPS = (
    r"(?<![^\x20\x09-\x0D])(?:[A-Za-z_]{1,32}[=:])?[^\x20\x09-\x0D0-9A-Za-z+@(]*+\+?\(?[0-9][0-9().-]*+(?:\x20\(?[0-9][0-9().-]*+){1,7}"
    r"(?=[^\x20\x09-\x0D0-9A-Za-z@]*+(?![^\x20\x09-\x0D]))"
)


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]", ""))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _found(text: Column, pattern: str) -> Column:
    """(text, start, end, before, after) of each match, in code points.

    Starts are running sums of the lengths between; sums of blocks of them,
    about as many as each has members, keep a text with many matches cheap.
    """
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def measured(s):
        lengths = F.transform(s["hits"], lambda h, i: F.length(h) + F.length(F.get(s["parts"], i)))
        step = F.ceil(F.sqrt(F.size(s["hits"]))).cast("int")
        return F.struct(s["parts"].alias("parts"), s["hits"].alias("hits"), lengths.alias("lengths"), step.alias("step"))

    def summed(s):
        sums = F.transform(F.sequence(F.lit(0), s["step"] - 1), lambda j: add(F.slice(s["lengths"], j * s["step"] + 1, s["step"])))
        return F.struct(s["parts"].alias("parts"), s["hits"].alias("hits"), s["lengths"].alias("lengths"), s["step"].alias("step"), sums.alias("sums"))

    def placed(s):
        def one(h, i):
            block = F.floor(i / s["step"]).cast("int")
            before, after = F.get(s["parts"], i), F.get(s["parts"], i + 1)
            ahead = F.concat(F.coalesce(F.get(s["hits"], i - 1), F.lit("")), before)
            behind = F.concat(after, F.coalesce(F.get(s["hits"], i + 1), F.lit("")))
            start = add(F.slice(s["sums"], F.lit(1), block)) + add(F.slice(s["lengths"], block * s["step"] + 1, i - block * s["step"])) + F.length(before)
            return F.struct(
                h.alias("text"), start.alias("start"), (start + F.length(h)).alias("end"),
                F.substr(ahead, F.greatest(F.length(ahead) - CONTEXT + 1, F.lit(1))).alias("before"),
                F.substr(behind, F.lit(1), F.lit(CONTEXT)).alias("after"),
            )

        return F.transform(s["hits"], one)

    none = F.array().cast("array<struct<text:string,start:int,end:int,before:string,after:string>>")
    own = F.struct(parts.alias("parts"), hits.alias("hits"))
    return _let(own, lambda s: F.when(F.size(s["hits"]) > 0, _let(measured(s), lambda m: _let(summed(m), placed))).otherwise(none))


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total, i):
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = 2 * d
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def _spans(found: Column, ok) -> Column:
    return F.transform(F.filter(found, ok), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind; ``text`` is not null.

    The patterns are those of the contract, in forms that never backtrack over
    a long text: before cards, blanks and hyphens that touch another, and
    before emails, dots that touch another, become an underscore, so that one
    character class can stand for the repeated group.
    """
    single = F.regexp_replace(text, r"[\x20-](?=[\x20-])|(?<=[\x20-])[\x20-]", "_")
    dotted = F.regexp_replace(text, r"\.(?=\.)|(?<=\.)\.", "_")
    email = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*[A-Za-z0-9-]"
    ip = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    card = r"[0-9][0-9\x20-]{14,}[0-9]"
    phone = r"\+[0-9][\x20().0-9-]+[0-9]"
    yes = lambda m: F.lit(True)
    octets = lambda m: m["text"].rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    digits = lambda m: F.regexp_replace(m["text"], "[^0-9]", "")
    payable = lambda m: F.length(digits(m)).between(16, 19) & luhn(digits(m))
    dialled = lambda m: F.length(digits(m)).between(8, 15)
    none = F.array().cast(SPANS)
    return {
        "email": F.when(F.contains(text, F.lit("@")), _spans(_found(dotted, email), yes)).otherwise(none),
        "ip": F.when(text.rlike(ip), _spans(_found(text, ip), octets)).otherwise(none),
        "card": F.when(text.rlike(r"(?:[0-9][\x20-]?){16}"), _spans(_found(single, card), payable)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), _spans(_found(text, phone), dialled)).otherwise(none),
    }


def _candidates(text: Column, base: dict[str, Column]) -> Column:
    """Base spans, identifier-like tokens and groups of digits with single blanks: value, start, end, kind, seed, patterns.

    A number of a card's length is like one only if it passes its check digit.
    Tokens and groups that touch a base span are no instances beside it, nor
    are the pieces without a kind of a group that has one.
    """
    lead = lambda t: F.regexp_extract(t, r"^(?:[A-Za-z_]{1,32}[=:])?(?:(?!\([0-9]{1,5}\))[^0-9A-Za-z+@])*+", 0)
    value = lambda t: F.regexp_replace(F.substr(t, F.length(lead(t)) + 1), r"(?<![^0-9A-Za-z])[^0-9A-Za-z]++$", "")
    word = lambda c, p: F.lower(F.regexp_extract(c, p, 1))
    tag = lambda t, w: F.when(w != "", F.concat(F.lit(t), w))

    blank, solid = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"

    def instance(value, start, end, kind, seed, before, after, label):
        """``before`` ends, and ``after`` begins, where the blank-free run around the value does."""
        left, right = word(before, rf"({solid}++){blank}*+$"), word(after, rf"^{blank}*+({solid}++)")
        two = F.regexp_replace(word(before, rf"({solid}++{blank}++{solid}++){blank}*+$"), rf"{blank}+", " ")

        return F.struct(
            F.lower(value).alias("value"), start.alias("start"), end.alias("end"), kind.alias("kind"), seed.alias("seed"),
            F.array_compact(F.array(tag("<", left), tag(">", right), tag("<<", two), tag("=", label))).alias("patterns"),
        )

    def seeds(kind):
        def one(s):
            def told(c):
                before = F.regexp_replace(c["before"], rf"(?<!{solid}){solid}++$", "")
                after = F.regexp_replace(c["after"], rf"^{solid}++", "")
                label = word(c["before"], rf"(?<!{solid})([A-Za-z_]{{1,32}}[=:]){solid}*+$")
                return instance(c["value"], s["start"], s["end"], F.lit(kind), F.lit(True), before, after, label)

            around = F.struct(
                F.substr(text, s["start"] + 1, s["end"] - s["start"]).alias("value"),
                F.substr(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))).alias("before"),
                F.substr(text, s["end"] + 1, F.lit(CONTEXT)).alias("after"),
            )
            return _let(around, told)

        return F.transform(base[kind], one)

    def one(m):
        start = m["start"] + F.length(lead(m["text"]))
        return F.struct(value(m["text"]).alias("value"), start.alias("start"), (start + F.length(value(m["text"]))).alias("end"), m.alias("m"))

    def judged(c):
        v, n = c["value"], _count(c["value"], "0-9")
        key = v.rlike(r"^(?=[^0-9]*+[0-9])(?=[^a-f]*+[a-f])[0-9a-f]{32,}$")
        like = (
            F.when(v.rlike(r"^[^@]+@[^@]+$"), F.lit("email"))
            .when(v.rlike(r"^[0-9]+(?:\.[0-9]+){3}$|^(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}$"), F.lit("ip"))
            .when(n.between(13, 19) & v.rlike(r"^[0-9\x20./-]+$") & luhn(F.regexp_replace(v, "[^0-9]", "")), F.lit("card"))
            .when(n.between(7, 12) & v.rlike(r"^\+?[0-9()\x20.-]+$"), F.lit("phone"))
            .when(v.rlike(r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[0-9A-Za-z_+/=.-]{12,}$"), F.lit("secret"))
            .otherwise(F.lit("none"))
        )
        return instance(v, c["start"], c["end"], like, key, c["m"]["before"], c["m"]["after"], word(c["m"]["text"], r"^([A-Za-z_]{1,32}[=:])"))

    def unseen(pattern):
        over = lambda c: F.exists(F.concat(*[base[k] for k in KINDS]), lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"]))
        found = F.filter(F.transform(_found(text, pattern), one), lambda c: (c["value"] != "") & ~over(c))
        return F.transform(found, judged)

    def both(c):
        loose = lambda t: (t["kind"] != "none") | ~F.exists(c["groups"], lambda g: (g["start"] < t["end"]) & (g["end"] > t["start"]))
        return F.concat(*map(seeds, KINDS), c["groups"], F.filter(c["tokens"], loose))

    groups = F.filter(unseen(GROUPS), lambda g: g["kind"] != "none")
    return F.when(text.rlike("[0-9@]"), _let(F.struct(groups.alias("groups"), unseen(TOKEN).alias("tokens")), both))


def trusted(candidates: DataFrame, rounds: int = ROUNDS, trust: float = TRUST) -> DataFrame:
    """value, kind of the instances that are no seeds and are trusted.

    ``candidates`` has value, kind, seed and patterns.  A pattern's score for a
    kind is the number of its trusted instances of that kind over that, a
    quarter of its other instances of that kind, all its instances that are
    not trusted to be of another kind, and one more.  An instance's trust is 1 - (1 - l) (1 - r) of its best pattern before (or a
    label) and after it; it counts for patterns from ``trust`` on.
    """
    edges = candidates.select(F.explode("patterns").alias("pattern"), "value", "kind", "seed")
    edges = cut(edges.groupBy("pattern", "value", "kind").agg(F.max("seed").alias("seed")), "edges")
    open_edges = cut(edges.where("not seed and kind <> 'none'"), "open")
    total = open_edges.count()
    belief = None
    for _ in range(rounds):
        own = edges.withColumn("trust", F.col("seed").cast("double"))
        if belief is not None:
            more = open_edges.join(belief.where(F.col("trust") >= trust), ["value", "kind"]).select("pattern", "kind", "trust")
            own = own.select("pattern", "kind", "trust", F.lit(1).alias("n")).unionByName(more.withColumn("n", F.lit(0)))
        else:
            own = own.select("pattern", "kind", "trust", F.lit(1).alias("n"))
        sums = [F.sum(F.when(F.col("kind") == k, F.col("trust")).otherwise(0.0)).alias(k) for k in ALL]
        waits = open_edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("waits"))
        counts = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in ALL]
        scores = cut(own.groupBy("pattern").agg(F.sum("n").alias("n"), *sums, *counts).join(waits, "pattern"), "scores")
        told = lookup(open_edges, scores, "pattern", "waits", total)
        of_kind = lambda name: F.coalesce(*[F.when(F.col("kind") == k, F.col(name.format(k))) for k in ALL])
        sure = of_kind("{}")
        doubted = of_kind("n_{}") - sure
        score = sure / (sure + doubted * DOUBT + (F.col("n") - sum(F.col(k) for k in ALL) - doubted) + 1)
        side = lambda yes: F.coalesce(F.max(F.when(yes, F.col("score"))), F.lit(0.0))
        after = F.startswith("pattern", F.lit(">"))
        belief = told.select("pattern", "value", "kind", score.alias("score")).groupBy("value", "kind")
        belief = cut(belief.agg((1 - (1 - side(after)) * (1 - side(~after))).alias("trust")), "belief")
    return belief.where(F.col("trust") >= trust).select("value", "kind")


def find(docs: DataFrame, rounds: int = ROUNDS, trust: float = TRUST) -> DataFrame:
    """doc_id, mark, base and extra spans of every row (doc_id, text).

    ``mark`` is a hash of the text, to tell rows with one doc_id apart; base is
    a struct with the spans of each kind, extra an array of (kind, start, end):
    trusted instances and the keys that were seeds.  Patterns look at the
    ``CONTEXT`` code points on either side of an instance, a longer word there
    counts by what lies in them.  Null and empty texts have no spans; very long
    ones are read whole.  Repeated rows are rows of their own and found alike.
    No rows give none.  Other columns are not looked at, whatever their names.
    Candidates for discovery are runs of non-blanks and groups of two to eight
    runs of digits, behind a label of at most 32 letters: longer groups and
    labels are not discovered.  Base spans have no such bounds.
    """
    text = F.coalesce("text", F.lit(""))
    own = columns_apart(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"))
    base = base_spans(F.col("text"))
    own = own.select("doc_id", "text", "mark", F.struct(*[base[k].alias(k) for k in KINDS]).alias("base"))
    own = own.select("doc_id", "mark", "base", _candidates(F.col("text"), {k: F.col("base")[k] for k in KINDS}).alias("candidates"))
    own = cut(own, "base")
    each = own.where("candidates is not null").select("doc_id", "mark", F.inline("candidates"))
    good = trusted(each, rounds, trust)
    extra = each.where("not seed and kind <> 'none'").join(F.broadcast(good) if bounded(good, SMALL) else good, ["value", "kind"])
    extra = extra.select("doc_id", "mark", "kind", "start", "end").unionByName(each.where("seed and kind = 'secret'").select("doc_id", "mark", "kind", "start", "end"))
    extra = extra.select("doc_id", "mark", F.struct("kind", "start", "end").alias("x")).distinct()
    extra = cut(extra.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list("x")).alias("extra")), "extra")
    same = F.col("o.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("o.mark") == F.col("e.mark"))
    both = own.alias("o").join(extra.alias("e"), same, "left")
    return both.select("o.doc_id", "o.mark", "o.base", F.coalesce("e.extra", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("extra"))


def all_spans(base: Column, extra: Column) -> Column:
    """(kind, start, end) by kind as listed, then start; what base has is not added again."""
    def of(kind: str) -> Column:
        more = F.filter(extra, lambda s: s["kind"] == kind)
        if kind not in KINDS:
            return F.array_sort(more)
        tagged = F.transform(base[kind], lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.array_sort(F.array_union(tagged, more))

    return F.concat(*map(of, ALL))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rounds: int = ROUNDS, trust: float = TRUST) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets.

    Overlapping spans become one, named by the first.  Rows without spans,
    null texts among them, stay as they are.
    """
    spans = F.sort_array(F.transform(all_spans(F.col("base"), F.col("extra")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = find(docs, rounds, trust).select("doc_id", "mark", spans.alias("spans")).where("size(spans) > 0").dropDuplicates(["doc_id", "mark"])
    kind = "struct<at:int,out:string>"

    def step(a, s):
        fresh = s["start"] >= a["at"]
        out = F.when(fresh, F.concat(a["out"], F.substr(F.col("d.text"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    end = lambda a: F.concat(a["out"], F.substr(F.col("d.text"), a["at"] + 1))
    clean = F.aggregate("f.spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(kind), step, end)
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("f.mark"))
    both = docs.alias("d").join(found.alias("f"), same, "left")
    text = F.when(F.col("f.spans").isNotNull(), clean).otherwise(F.col("d.text"))
    return both.select(*[text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
