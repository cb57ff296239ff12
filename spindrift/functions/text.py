"""Text recipes: combined item text, user context, tokens."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of at least two letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# The default stop words, which are Spark's English list as tokens: words of two letters or more, then what
# is left of its contractions. Pass another list to replace it.
STOP_WORDS = tuple(
    """me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing an the and but if or because as until while of
    at by for with about against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very can will just don should now cannot could ought would ll
    re ve isn aren wasn weren haven hasn hadn doesn didn won wouldn shan shouldn mustn couldn let""".split()
)


def combined_text(*parts: str) -> Column:
    """Space-joined text with nulls as blanks."""
    return F.concat_ws(" ", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def labelled(label: str, value: Column) -> Column:
    """``Label: value``, or null when the value is null or blank so that joins skip it."""
    return F.when(F.length(value) > 0, F.concat(F.lit(label + ": "), value))


def labelled_item_text(
    title: Column, description: Column, genres: Column, category: Column, cast: Column, director: Column
) -> Column:
    """Labelled item text for embedding; empty parts are skipped, the cast is cut to five names."""
    return F.concat_ws(
        " ",
        labelled("Title", title),
        labelled("Description", description),
        labelled("Genres", F.array_join(genres, ", ")),
        labelled("Category", category),
        labelled("Cast", F.array_join(F.slice(cast, 1, 5), ", ")),
        labelled("Director", director),
    )


def last_of(values: Column, n: int) -> Column:
    """The last ``n`` elements, or all of a shorter array."""
    return F.when(F.size(values) > n, F.slice(values, -n, n)).otherwise(values)


def user_context_text(
    preferences: Column,
    history: Column,
    age: Column,
    preferred_time: Column,
    mood: Column,
    device: Column,
    session_type: Column,
) -> Column:
    """One line of text describing a user and the current context; empty parts are skipped."""
    return F.concat_ws(
        " ",
        labelled("Preferred genres", F.array_join(preferences, ", ")),
        labelled("Recently watched", F.array_join(last_of(history, 5), ", ")),
        labelled("Age group", age),
        labelled("Watches content during", preferred_time),
        labelled("Current mood", mood),
        labelled("Viewing on", device),
        labelled("Session type", session_type),
    )


def tokens(text: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Lower-cased tokens of the whole text without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    stop = list(stop_words)
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def with_bigrams(words: Column) -> Column:
    """The words followed by each adjacent pair joined with a blank."""
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def slug(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit(" "), F.lit("-")))
