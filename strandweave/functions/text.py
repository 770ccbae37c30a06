"""Column expressions over text, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that the lexical index leaves out.
STOP_WORDS = """
a an the and or but nor so yet if then than as of in on at to from by for with
without into onto upon over under between through about above below after before
is are was were be been am do does did have has had having not no it its this
that these those there here which who whom whose what when where why how i we you
he she they them us our your his her their my me him can could may might must shall
should will would also too very more most such each any all both either
""".split()

#: Words that name no concept, unless a caller gives other ones.
CONCEPT_STOP_WORDS = """
a an the this that these those it its is are was were be been being am do does did
of in on at to from by for with without into onto upon over under between
and or but nor so yet as if then than which who whom whose what when where why how
not no only just also too very more most much many few less least own same other
i we you he she they them us our your his her their my me him there here thus
can could may might must shall should will would have has had having
one two three first second new way thing things make made makes making see seen
such about above below after before again further once each any all both either
say said says according e.g i.e cf ed eds vol pp p chapter section page note notes
text passage author work however therefore moreover indeed rather merely simply
some now because even still since like cannot whether another always never every kind
already precisely case fact find know mean means course order terms press university
die der later together through possible everything view beyond remains ourselves
himself themselves people basis different lecture lectures york cambridge well longer
taken instead concerning away great today translation oxford london
""".split()

#: Phrases of front and back matter.
SIGNALS = (
    "no part of this book", "all rights reserved", "library of congress", "cataloging-in-publication",
    "manufactured in the united states", "printed in the united states", "university press", "isbn", "p. cm",
    "intentionally omitted", "this book is a publication", "permission in writing from the publisher",
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.size(words(text))


_W = r"[\p{L}\p{N}_]"
#: A word of two characters or more between edge underscores, unless it is a number.
LEXICAL = rf"(?<!{_W})_*(?![0-9]+_*(?!{_W}))([\p{{L}}\p{{N}}]{_W}*[\p{{L}}\p{{N}}])_*(?!{_W})"


#: The same, single characters and numbers included: nothing is read twice.
LEXICAL_WORD = r"[\p{L}\p{N}]++(?:_++[\p{L}\p{N}]++)*+"


def lexical_words(text: Column) -> Column:
    """The words that `lexical_tokens` chooses from."""
    return F.regexp_extract_all(F.lower(text), F.lit(LEXICAL_WORD), F.lit(0))


def lexical_tokens(text: Column) -> Column:
    """Lower-cased word tokens without underscores at the edges, stop words, single characters and numbers."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(LEXICAL), F.lit(1))
    return F.filter(raw, lambda w: ~w.isin(*STOP_WORDS))


def concept_tokens(text: Column, stop_words: Sequence[str] = tuple(CONCEPT_STOP_WORDS)) -> Column:
    raw = F.regexp_extract_all(F.lower(text), F.lit(r"([a-zà-ÿ][a-zà-ÿ'\-]{2,})"), F.lit(1))
    return F.filter(raw, lambda w: ~F.contains(w, F.lit("'")) & ~w.isin(*stop_words))


def bag(text: Column) -> Column:
    """Distinct plain words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{3,})"), F.lit(1)))


def prose_ratio(text: Column) -> Column:
    """Share of words with two letters or more and no digit; 0 for none."""
    w = words(text)
    prose = F.filter(w, lambda x: (F.length(F.regexp_replace(x, r"[^\p{L}]", "")) >= 2) & ~x.rlike(r"[0-9]"))
    return F.when(F.size(w) > 0, F.size(prose) / F.size(w)).otherwise(F.lit(0.0))


def is_boilerplate(text: Column) -> Column:
    low = F.lower(text)
    hits = sum((F.contains(low, F.lit(s)).cast("int") for s in SIGNALS), F.lit(0))
    prose = prose_ratio(text)
    left_out = F.contains(low, F.lit("intentionally omitted")) & (F.length(text) < 600)
    return left_out | (hits >= 2) | ((hits >= 1) & (prose < 0.65)) | (prose < 0.5)


def boilerplate(text: str) -> bool:
    """`is_boilerplate` of a Python string."""
    low, parts = text.lower(), text.split()
    hits = sum(s in low for s in SIGNALS)
    prose = sum(sum(c.isalpha() for c in w) >= 2 and not any(c in "0123456789" for c in w) for w in parts) / len(parts) if parts else 0.0
    return ("intentionally omitted" in low and len(text) < 600) or hits >= 2 or (hits >= 1 and prose < 0.65) or prose < 0.5


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit("…"))).otherwise(text)


def plain_text(markdown: Column) -> Column:
    """Markdown without code fences, link targets, heading and emphasis marks."""
    out = F.regexp_replace(markdown, r"(?s)```.*?```", " ")
    out = F.regexp_replace(out, r"`([^`]*)`", "$1")
    out = F.regexp_replace(out, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^#{1,6}\s+", "")
    return F.trim(F.regexp_replace(out, r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by a pipe."""
    return F.substring(F.sha1(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 16)


def balanced(text: Column) -> Column:
    """The parts of a text between a bracket or brace and its match, outermost only, in order; those inside quoted strings don't count."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("first"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.array().cast("array<struct<first:int,last:int>>").alias("found"))

    def step(s: Column, c: Column) -> Column:
        at, inside = s["at"] + 1, s["depth"] > 0
        opens, closes = ~s["quoted"] & c.isin("{", "["), ~s["quoted"] & inside & c.isin("}", "]")
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        whole = closes & (depth == 0)
        return F.struct(
            at.alias("at"), depth.alias("depth"), F.when(opens & ~inside, at).otherwise(s["first"]).alias("first"),
            # Quotes count inside brackets only: prose may hold any number of them.
            F.when(inside & (c == '"') & ~s["escaped"], ~s["quoted"]).otherwise(s["quoted"] & (depth > 0)).alias("quoted"),
            (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
            F.when(whole, F.array_append(s["found"], F.struct(s["first"].alias("first"), at.alias("last")))).otherwise(s["found"]).alias("found"),
        )

    places = F.aggregate(F.split(text, ""), start, step, lambda s: s["found"])
    return F.transform(places, lambda p: F.substr(text, p["first"], p["last"] - p["first"] + 1))


def lenient_json(text: Column) -> Column:
    """A reply's JSON value as VARIANT, null if it has none.

    The whole text, less a fence around it, is tried first; then what stands from its first brace to its last one, or, where
    it has no braces, from its first bracket to its last one; then each fenced block, and each part between matching brackets.
    """
    bare = F.trim(text, F.lit(" \t\r\n"))
    unfenced = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(F.regexp_replace(bare, r"^`+|`+$", ""), r"(?i)^json", "")).otherwise(bare)
    outer = lambda a, b: F.regexp_extract(text, rf"(?s)(\{a}.*\{b})", 1)
    first = lambda parts: F.get(F.filter(F.transform(parts, F.try_parse_json), lambda v: v.isNotNull()), F.lit(0))
    fences = F.regexp_extract_all(text, F.lit(r"(?s)```(?:[a-zA-Z]*)\s*(.*?)```"), F.lit(1))
    real = lambda x: F.when(F.length(F.trim(x)) > 0, x)
    return F.coalesce(F.try_parse_json(real(unfenced)), F.try_parse_json(real(outer("{", "}"))), F.when(~text.rlike(r"(?s)\{.*\}"), F.try_parse_json(real(outer("[", "]")))), first(F.filter(fences, lambda x: F.length(F.trim(x)) > 0)), first(balanced(text)))
