"""Text columns: cleaning and base forms of words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, clean_text, clean_words, singular_candidates
from ..session import materialize

MAP_SLOTS = 8192
MAPPED_FORMS = 100_000  # lemmas looked up in place, and all their characters
MAPPED_CHARS = 4_000_000

# A lemma table (form, lemma), or what makes one of the (form) table of all cleaned words.
Lemmas = DataFrame | Callable[[DataFrame], DataFrame]


def preprocess_text(
    df: DataFrame, column: str, out: str = "clean_text", stop_words: list[str] = STOP_WORDS, lemmas: Lemmas | None = None
) -> DataFrame:
    """Add the cleaned text; a null text stays null.

    Without ``lemmas`` this is narrow.  With them texts are cleaned once and stored, and
    each word is replaced by its lemma.
    """
    if lemmas is None:
        return df.withColumn(out, clean_text(F.col(column), stop_words))
    return base_words(df.withColumn(out, clean_words(F.col(column), stop_words)), out, lemmas).withColumn(out, F.array_join(out, " "))


def vocabulary(df: DataFrame, column: str, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(form): every different word of the cleaned texts."""
    return df.select(F.explode(clean_words(F.col(column), stop_words)).alias("form")).distinct()


def plural_lemmas(forms: DataFrame) -> DataFrame:
    """(form, lemma): plurals whose singular, made by rule, is itself a known word.

    The known words stand in for a dictionary: a form is only rewritten to a word that
    exists, the first fitting rule wins.
    """
    made = forms.select("form", F.posexplode(singular_candidates(F.col("form"))).alias("rule", "lemma"))
    known = forms.select(F.col("form").alias("lemma"))
    return (
        made.join(known, "lemma", "left_semi")
        .groupBy("form")
        .agg(F.min_by("lemma", "rule").alias("lemma"))
        .filter(F.col("form") != F.col("lemma"))
    )


def base_words(df: DataFrame, words: str, lemmas: Lemmas) -> DataFrame:
    """``df`` with each word of an array column replaced by its lemma where one is known.

    Texts are stored once.  Their different words, counted before they meet, find the
    lemmas that change something.  As many of those as fit the map, the most
    frequent first, are looked up in place: no text is shuffled for them, and a form that half
    of all rows hold is no hot key.  Only texts with a rarer form are joined to the rest.
    Of several lemmas of a form the first in order counts; null forms and lemmas are
    ignored.
    """
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "words")
    forms = rows.select(F.explode(F.array_distinct(words)).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    forms = materialize(forms, "forms")
    table = lemmas(forms.select("form")) if callable(lemmas) else lemmas
    table = table.filter("form is not null and lemma is not null").groupBy("form").agg(F.min("lemma").alias("lemma"))
    changed = materialize(table.filter("form <> lemma").join(forms, "form"), "lemmas")
    known, rest = lemma_map(changed)
    # A column of its own: a subquery may not stand in a function over an array.
    rows = rows.withColumn("_lemmas", known)
    based = F.transform(words, lambda w: looked_up(w, F.col("_lemmas")))
    found = rows.withColumn(words, based) if rest is None else _joined_lemmas(rows, words, based, rest)
    return found.drop("_row", "_lemmas")


def lemma_map(changed: DataFrame, most: int = MAPPED_FORMS, chars: int = MAPPED_CHARS) -> tuple[Column, DataFrame | None]:
    """The most frequent of (form, lemma, n) as an array of small maps, by the hash of the form, and the others.

    The array is a scalar subquery of at most ``most`` entries and ``chars`` characters,
    both checked; a lookup searches one map of a few entries.
    """
    size = F.length("form") + F.length("lemma")
    if changed.count() <= most and (changed.agg(F.sum(size)).first()[0] or 0) <= chars:
        chosen, rest = changed, None
    else:
        short = changed.filter(size <= chars // most)
        chosen = materialize(short.orderBy(F.col("n").desc(), "form").limit(most), "frequent-lemmas")
        rest = changed.join(chosen.select("form"), "form", "left_anti")
    entries = F.map_from_entries(F.collect_list(F.struct("form", "lemma")))
    maps = chosen.groupBy(slot_of(F.col("form")).alias("slot")).agg(entries.alias("entries"))
    placed = maps.agg(F.map_from_entries(F.collect_list(F.struct("slot", "entries"))).alias("by_slot"))
    every = F.transform(F.sequence(F.lit(0), F.lit(MAP_SLOTS - 1)), lambda s: F.col("by_slot")[s])
    return placed.select(every.alias("maps")).scalar(), rest


def slot_of(form: Column) -> Column:
    return F.pmod(F.xxhash64(form), F.lit(MAP_SLOTS)).cast("int")


def looked_up(word: Column, maps: Column) -> Column:
    """The lemma of a word, or the word itself."""
    return F.coalesce(F.get(maps, slot_of(word))[word], word)


def _joined_lemmas(rows: DataFrame, words: str, based: Column, rest: DataFrame) -> DataFrame:
    """The rarer forms by a join of the different words of each text; the text gets back a small map."""
    forms = rows.select("_row", F.explode(F.array_distinct(words)).alias("form"))
    maps = forms.join(rest.select("form", "lemma"), "form").groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("form", "lemma"))).alias("_rare")
    )
    both = F.transform(F.arrays_zip(F.col(words).alias("word"), based.alias("lemma")), lambda x: F.coalesce(F.col("_rare")[x["word"]], x["lemma"]))
    return rows.join(maps, "_row", "left").withColumn(words, F.when(F.col("_rare").isNull(), based).otherwise(both)).drop("_rare")


def lemmatize(df: DataFrame, key: str, column: str, lemmas: Lemmas, out: str = "lemma_text") -> DataFrame:
    """(key, out): each blank-separated word replaced by its lemma where one is known."""
    split = df.select(key, F.split(column, " ").alias(out))
    return base_words(split, out, lemmas).withColumn(out, F.array_join(out, " "))
