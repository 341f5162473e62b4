"""Text functions as column expressions.

Java's regular-expression classes differ from Python's for white space, words and digits; the patterns here are the
spellings that agree.  Only normal forms need an Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: white space, word characters and the extraction patterns that results must agree on
SPACE = r"(?U)[\s\x1c-\x1f]+"
WORD = r"(?U)[^\s\x1c-\x1f]+"
NON_WORD = r"[^\p{L}\p{N}_]+"
NUMBER = r"(?<![\p{L}\p{N}_])[+-]?(?:\p{Nd}[\p{Nd} ,.'’]*\p{Nd}|\p{Nd})(?:[.,]\p{Nd}+)?(?![\p{L}\p{N}_])"
PLACEHOLDER = r"(?:\{\{[^{}]+\}\}|\{[^{}]+\}|%\([^)]+\)[a-zA-Z]|%[sdif]|\$\{[^{}]+\}|<%[^%]+%>)"
MARKUP = r"</?[A-Za-z][\p{L}\p{N}_:.-]*(?:\s[^<>]*?)?/?>"
TAG_NAME = r"</?([A-Za-z][\p{L}\p{N}_:.-]*)(?:\s[^<>]*?)?/?>"
PUNCTUATION = r"\p{P}"
SCRIPT_CLASSES = {"Latn": "IsLatin", "Cyrl": "IsCyrillic", "Grek": "IsGreek", "Arab": "IsArabic", "Hebr": "IsHebrew", "Deva": "IsDevanagari"}


def let(values: list[Column], body: Callable[..., Column]) -> Column:
    """body of the values, each evaluated once: a lambda's own variables are, whatever stands around it is not."""
    bound = F.struct(*(v.alias(f"v{k}") for k, v in enumerate(values)))
    return F.element_at(F.transform(F.array(bound), lambda s: body(*(s[f"v{k}"] for k in range(len(values))))), 1)


def collapse(x: Column) -> Column:
    """White-space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


@F.pandas_udf(StringType())
def _normal_form(x: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else unicodedata.normalize(f, v) for v, f in zip(x, form, strict=True)])


#: A character that NFC may change or join to others lies outside these ranges (Latin letters, general punctuation);
#: texts within them are in that form already.
UNSETTLED = r"[^\x{0}-\x{2FF}\x{2002}-\x{20CF}]"


def normalize_text(x: Column, form: str = "NFC") -> Column:
    """A Unicode normal form, with white space collapsed and trimmed; only texts that NFC may change go to Python."""
    if form != "NFC":
        return collapse(_normal_form(x, F.lit(form)))
    doubtful = F.when(x.rlike(UNSETTLED), x)
    return collapse(F.coalesce(_normal_form(doubtful, F.lit(form)), x))


def _ranges(characters: list[str], gap: int) -> str:
    """A character class of ranges that hold the characters; those within `gap` of each other share one."""
    out: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if out and c - out[-1][1] <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


#: Lower-case characters that full case folding changes further; characters with case lie below U+20000.
FOLDED = {c: f for c in map(chr, range(0x20000)) if (f := c.casefold()) != c == c.lower()}
FOLDED_ALIKE = {c: f for c, f in FOLDED.items() if len(f) == 1}
FOLDED_LONGER = {c: f for c, f in FOLDED.items() if len(f) > 1}
#: Ranges that hold all of them but the sharp s, which is common and folded on its own.
RARELY_FOLDED = _ranges([c for c in FOLDED if c != "ß"], 100)


def casefold(x: Column) -> Column:
    """Full case folding: lower case, sharp s, and in texts that hold any, the other characters that folding changes."""

    def rest(low: Column) -> Column:
        alike = F.translate(low, "".join(FOLDED_ALIKE), "".join(FOLDED_ALIKE.values()))
        longer = F.create_map(*(F.lit(v) for item in FOLDED_LONGER.items() for v in item))
        letters = F.transform(F.split(alike, ""), lambda c: F.coalesce(F.try_element_at(longer, c), c))
        return F.when(low.rlike(RARELY_FOLDED), F.array_join(letters, "")).otherwise(low)

    return let([F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))], rest)


def signature(x: Column) -> Column:
    """What near-duplicates share: folded letters, digits and underscores; the folded text where none is left."""
    return let([casefold(x)], lambda folded: F.coalesce(F.nullif(F.regexp_replace(folded, NON_WORD, ""), F.lit("")), folded))


def word_count(x: Column) -> Column:
    """Words of a text, parted by white space; no text is built."""
    return F.regexp_count(x, F.lit(WORD))


def length_ratio(a: Column, b: Column) -> Column:
    return F.greatest(F.length(a), F.length(b)) / F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))


def markup_balanced(x: Column) -> Column:
    """Whether tags nest: each closing tag fits the last open one, none stays open, and no angle bracket is stray."""
    tags = F.arrays_zip(F.regexp_extract_all(x, F.lit(TAG_NAME), F.lit(0)).alias("raw"), F.regexp_extract_all(x, F.lit(TAG_NAME), F.lit(1)).alias("name"))
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("stack"))

    def step(acc: Column, tag: Column) -> Column:
        top = F.try_element_at(acc["stack"], F.lit(-1))
        closing = F.startswith(tag["raw"], F.lit("</"))
        fits = acc["ok"] & F.coalesce(top == tag["name"], F.lit(False))
        popped = F.slice(acc["stack"], F.lit(1), F.greatest(F.lit(0), F.size(acc["stack"]) - 1))
        return (
            F.when(closing, F.struct(fits.alias("ok"), popped.alias("stack")))
            .when(F.endswith(tag["raw"], F.lit("/>")), acc)
            .otherwise(F.struct(acc["ok"].alias("ok"), F.array_append(acc["stack"], tag["name"]).alias("stack")))
        )

    nested = F.aggregate(tags, start, step, lambda acc: acc["ok"] & (F.size(acc["stack"]) == 0))
    stray = F.regexp_replace(x, TAG_NAME, "").rlike("[<>]")
    return F.when(~x.rlike("[<>]"), F.lit(True)).otherwise(nested & ~stray)


#: A letter of a script other than Latin; all of them lie beyond the first range, which is told without a look at scripts.
NOT_LATIN = rf"[\x{{370}}-\x{{10FFFF}}&&\p{{L}}&&[{''.join(rf'\p{{{c}}}' for c in SCRIPT_CLASSES.values() if c != 'IsLatin')}]]"


def dominant_script(x: Column) -> Column:
    """The commonest script among letters, by Unicode script; of equals the one met first; null without any.

    Texts without letters of other scripts are told by two searches; in the rest, only scripts that are met are counted."""
    letter = {name: rf"[\p{{L}}&&\p{{{cls}}}]" for name, cls in SCRIPT_CLASSES.items()}

    def commonest(text: Column, *firsts: Column) -> Column:
        scripts = []
        for (name, pattern), first in zip(letter.items(), firsts, strict=True):
            n = F.when(first > 0, F.regexp_count(text, F.lit(pattern))).otherwise(0)
            scripts.append(F.struct(n.alias("n"), (-first).alias("first"), F.lit(name).alias("script")))
        return let([F.array_max(F.array(*scripts))], lambda best: F.when(best["n"] > 0, best["script"]))

    several = let([x, *(F.regexp_instr(x, F.lit(pattern)) for pattern in letter.values())], commonest)
    return F.when(x.rlike(NOT_LATIN), several).when(x.rlike(letter["Latn"]), F.lit("Latn"))


def bucket(key: Column, seed: int) -> Column:
    """A number in [0, 1) for "seed:key": the first 16 hex digits of its SHA-256 over 2**64."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def split_name(value: Column, train: float = 0.9, validation: float = 0.05) -> Column:
    return F.when(value < train, "train").when(value < train + validation, "validation").otherwise("test")


def extract(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def multiset_recall(expected: Column, actual: Column) -> Column:
    """Share of expected items that actual has, repeats counted; 1 where nothing is expected."""
    count = lambda items, v: F.size(F.filter(items, lambda y: y == v))

    def recall(e: Column, a: Column) -> Column:
        kept = F.aggregate(F.array_distinct(e), F.lit(0), lambda acc, v: acc + F.least(count(e, v), count(a, v)))
        return F.when(F.size(e) == 0, F.lit(1.0)).otherwise(kept / F.size(e))

    return let([expected, actual], recall)


def preservation(source: Column, candidate: Column, pattern: str) -> Column:
    return multiset_recall(extract(source, pattern), extract(candidate, pattern))


def exact_match(a: Column, b: Column) -> Column:
    strip = lambda x: F.regexp_replace(x, rf"^{SPACE}|{SPACE}$", "")
    return strip(a) == strip(b)


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(50.0)))


def contains_folded(text: Column, term: Column) -> Column:
    return F.contains(casefold(text), casefold(term))


def is_identifier(x: Column) -> Column:
    return x.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z")


def semver(x: Column) -> Column:
    """struct(major, minor, patch) of the version at the end of an id; null where there is none."""
    part = lambda k: F.regexp_extract(x, r"v(\d+)\.(\d+)\.(\d+)$", k)
    whole = F.struct(*(F.nullif(part(k), F.lit("")).cast("int").alias(n) for k, n in ((1, "major"), (2, "minor"), (3, "patch"))))
    return F.when(x.rlike(r"v\d+\.\d+\.\d+$"), whole)


def direction(source: Column, target: Column) -> Column:
    return F.concat_ws("-to-", source, target)


def direction_languages(x: Column) -> Column:
    return F.split(x, "-to-", 2)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
