"""Text expressions: cleaning, one-line descriptions, templates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# The English stop words.  Punctuation is stripped before words are
# compared, so the spellings with an apostrophe never match; they are kept for
# callers who pass their own tokens.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until
while of at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when where why
how all any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren aren't
couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma
mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren
weren't won won't wouldn wouldn't
""".split()

# Words the word tokenizer cuts in two, as (first part, second part).
FUSED_WORDS = [
    ("can", "not"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("wan", "na"),
]

# Typographic quotes, which are words of their own to the tokenizer.
QUOTES = "«“‘„»”’"

# The characters that separate words.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Regular noun plurals as (ending, replacement), tried in this order.
PLURAL_RULES = [
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
    ("ses", "s"),
    ("xes", "x"),
    ("zes", "z"),
    ("ves", "f"),
    ("s", ""),
]


def lowered(text: Column) -> Column:
    return F.lower(text)


def strip_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def spaced(text: Column) -> Column:
    """The text with single words set apart by plain blanks.

    Quotes and fused words are rare, so both are looked for with plain substring
    searches; the regular expression only runs on texts that hold a fused word.
    """
    for quote in QUOTES:
        text = F.replace(text, F.lit(quote), F.lit(f" {quote} "))
    cut = "|".join(rf"{first}(?={second}\b)" for first, second in FUSED_WORDS)

    def split_fused(t: Column) -> Column:
        any_fused = reduce(or_, [F.contains(t, F.lit(first + second)) for first, second in FUSED_WORDS])
        return F.when(any_fused, F.regexp_replace(t, rf"\b(?:{cut})", "$0 ")).otherwise(t)

    return once(text, split_fused)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Words of a text whose punctuation is already gone."""
    return _split_words(F.translate(text, BLANKS, " " * len(BLANKS)), [])


def _split_words(text: Column, stop_words: list[str]) -> Column:
    return F.filter(F.split(spaced(text), " "), lambda w: ~w.isin("", *stop_words))


def drop_stop_words(tokens: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*stop_words)) if stop_words else tokens


def clean_words(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower-case words without punctuation and stop words.

    Punctuation and blanks go in one pass, empty words and stop words in another.
    """
    plain = F.translate(lowered(text), BLANKS + PUNCTUATION, " " * len(BLANKS))
    return _split_words(plain, stop_words)


def clean_text(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    return F.array_join(clean_words(text, stop_words), " ")


def singular_candidates(word: Column) -> Column:
    """Every word the plural rules can make of ``word``, in rule order."""
    made = [
        F.when(
            word.endswith(ending) & (F.length(word) > len(ending) + 1),
            F.concat(word.substr(F.lit(1), F.length(word) - len(ending)), F.lit(put)),
        )
        for ending, put in PLURAL_RULES
    ]
    return F.array_compact(F.array(*made))


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(", "))


def markdown_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("  \n"))


def preview(text: Column, width: int = 50) -> Column:
    return F.concat(F.substring(text, 1, width), F.lit("..."))


def filled(template: Column, slots: dict[str, Column], mark: str = "[]") -> Column:
    """``template`` with every ``[slot]`` replaced; slots it lacks are ignored."""
    out = template
    for name, value in slots.items():
        out = F.replace(out, F.lit(f"{mark[0]}{name}{mark[1]}"), value.cast("string"))
    return out
