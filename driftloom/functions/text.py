"""Text expressions: Column to Column, built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Lexicon

#: What a blank test must not count as text: Unicode blanks and the separators that Java's \\s leaves out.
NOT_BLANK = r"[^\p{Z}\s\x1c-\x1f\x85]"
TOKEN = "[a-zA-ZÀ-ɏ-]+"


def measurable(text: Column) -> Column:
    """Whether a text has anything but blanks; false for null."""
    return F.coalesce(text.rlike(NOT_BLANK), F.lit(False))


def words(text: Column) -> Column:
    """Runs of non-blanks in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\S+)"), F.lit(1))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def squeezed(text: Column) -> Column:
    """White space folded to single spaces, none at the ends."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"[\s\p{Z}\x1c-\x1f\x85]+", " ")), " +", " ")


def truncated(text: Column) -> Column:
    """Whether a text seems cut off: its last character, blanks aside, ends no sentence."""
    return ~text.rlike(r"[.!?\")%][\s\p{Z}]*\z")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), 0)


def phrase_hits(text: Column, phrases: tuple[str, ...]) -> Column:
    """Struct of the text without the phrases, each taken out in turn, and how often they stood there."""

    def step(found: Column, phrase: Column) -> Column:
        parts = F.length(found["text"]) - F.length(F.replace(found["text"], phrase, F.lit("")))
        return F.struct(F.replace(found["text"], phrase, F.lit(" ")).alias("text"), (found["hits"] + (parts / F.length(phrase)).cast("int")).alias("hits"))

    start = F.struct(text.alias("text"), F.lit(0).alias("hits"))
    return F.aggregate(F.array(*map(F.lit, phrases)), start, step) if phrases else start


def _within(tokens: Column, lexicon: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*lexicon))) if lexicon else F.lit(0)


def certainty(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Struct of score, hedge_hits, certainty_hits, conclusive.

    Phrases go first, conclusive, hedging, then certain ones, as substrings of
    the lower-case text; the words of what is left are looked up.  The score
    is five times the surplus of certain over hedging hits for each word, in
    [-1, 1].
    """

    def scored(concluded: Column, hedged: Column, sure: Column, tokens: Column) -> Column:
        found = F.struct((hedged["hits"] + _within(tokens, lexicon.hedge_words)).alias("hedge"), (sure["hits"] + _within(tokens, lexicon.certainty_words)).alias("certain"))

        def finished(f: Column) -> Column:
            raw = (f["certain"] - f["hedge"]) / F.greatest(F.size(tokens), F.lit(1)) * F.lit(5.0)
            score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
            conclusive = (concluded["hits"] > 0) | (_within(tokens, lexicon.conclusive_words) > 0)
            return F.struct(score.alias("score"), f["hedge"].alias("hedge_hits"), f["certain"].alias("certainty_hits"), conclusive.alias("conclusive"))

        return let(found, finished)

    return let(
        phrase_hits(F.lower(text), lexicon.conclusive_phrases),
        lambda a: let(
            phrase_hits(a["text"], lexicon.hedge_phrases),
            lambda b: let(phrase_hits(b["text"], lexicon.certainty_phrases), lambda c: let(F.regexp_extract_all(c["text"], F.lit(TOKEN), F.lit(0)), lambda k: scored(a, b, c, k))),
        ),
    )


def sentences(text: Column) -> Column:
    """Parts of a text that end in . ! or ? before white space."""
    parts = F.split(F.regexp_replace(text, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", ""), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def facts(text: Column, max_facts: int, min_chars: int) -> Column:
    """The sentences of an anchor; one shorter than ``min_chars`` joins the one before.

    A fact is a run of sentences from one that is long enough (or the first) to
    the next, so each is put together once.
    """

    def runs(parts: Column) -> Column:
        begins = F.filter(F.transform(parts, lambda p, i: F.when((i == 0) | (F.length(p) >= min_chars), i)), lambda i: i.isNotNull())

        def fact(b: Column) -> Column:
            upto = lambda i: F.coalesce(F.get(b, i + 1), F.size(parts))
            return F.transform(F.slice(b, 1, max_facts), lambda at, i: F.concat_ws(" ", F.slice(parts, at + 1, upto(i) - at)))

        return let(begins, fact)

    return let(sentences(text), runs)


def listed_facts(texts: Column, max_facts: int) -> Column:
    """A list of facts as it is, without blank ones."""
    return F.slice(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != ""), 1, max_facts)


def contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether the lower-case text has any of the markers."""
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(F.lower(text), F.lit(m))
    return found


def batch_number(run_id: Column) -> Column:
    """The number behind the first hyphen of a run's name."""
    return F.regexp_extract(run_id, r"-(\d+)", 1).cast("int")


def reason_signal(reason: Column) -> Column:
    """The signal that a flag's reason speaks of."""
    return F.when(reason.startswith("omission"), "omission").when(reason.startswith("entailment"), "entailment").when(reason.startswith("aggregate"), "aggregate").otherwise("drift")
