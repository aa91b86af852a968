"""Expressions over explanation texts: numbers, sentences, framing, readability.

The patterns use explicit character classes only, so that they mean the same in every
regular expression engine and in texts of any language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
SENTENCE_END = r"[.!?]+[ \t\r\n]+"
PERCENTAGE = r"[0-9] ?%"

# Words that frame a sentence.
FORWARD_WORDS = [
    "will", "would", "shall", "likely", "expect", "expects", "expected", "forecast",
    "forecasts", "predict", "predicts", "predicted", "anticipate", "anticipates",
    "anticipated", "project", "projects", "projected", "going to", "about to", "should",
]
HISTORICAL_WORDS = [
    "historical", "historically", "history", "past", "previous", "previously", "actual",
    "actually", "happened", "was", "were", "rose", "fell", "gained", "dropped", "earlier",
]
CONFIDENCE_WORDS = ["confidence", "confident", "probability", "certain", "certainty"]


def words_pattern(words: list[str]) -> str:
    """Any of the words, not inside a longer one ("unlikely" is not "likely")."""
    return "(^|[^a-z])(" + "|".join(words) + ")([^a-z]|$)"


FORWARD = words_pattern(FORWARD_WORDS)
HISTORICAL = words_pattern(HISTORICAL_WORDS)
CONFIDENCE = words_pattern(CONFIDENCE_WORDS)


def number_tokens(text: Column) -> Column:
    """Numbers as written; a hyphen after a digit (an ISO date) is not a sign."""
    unhyphenated = F.regexp_replace(text, r"([0-9])-", "$1 ")
    return F.regexp_extract_all(unhyphenated, F.lit(NUMBER), F.lit(0))


def extract_numbers(text: Column) -> Column:
    return F.transform(number_tokens(text), lambda t: t.cast("double"))


def _decimals(token: Column) -> Column:
    point = F.instr(token, ".")
    return F.when(point > 0, F.length(token) - point).otherwise(0)


def _close(token: Column, candidate: Column) -> Column:
    """Equal once the candidate is rounded to as many decimals as the token shows."""
    return F.abs(token.cast("double") - candidate) <= 0.5 * F.pow(F.lit(10.0), -_decimals(token)) + 1e-9


def _restates(token: Column, given: Column) -> Column:
    """The number itself, as a percentage, or as the rest to 100 %."""
    as_percent = given * 100
    return (
        _close(token, given)
        | _close(token, as_percent)
        | _close(token, 100 - given)
        | _close(token, 100 - as_percent)
    )


def unmatched_numbers(text: Column, prompt: Column) -> Column:
    """Numbers of the text that restate no number of the prompt."""

    def invented(both: Column) -> Column:
        return F.filter(both["told"], lambda t: ~F.exists(both["given"], lambda g: _restates(t, g)))

    # Bound to a lambda variable, the prompt's numbers are extracted once per row and not per number.
    both = F.array(F.struct(number_tokens(text).alias("told"), extract_numbers(prompt).alias("given")))
    return F.transform(F.get(F.transform(both, invented), F.lit(0)), lambda t: t.cast("double"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda s: F.trim(s) != "")


def _flagged(text: Column, test: Callable[[Column], Column]) -> Column:
    def unsupported(sentence: Column) -> Column:
        lowered = F.lower(sentence)
        return lowered.rlike(FORWARD) & ~lowered.rlike(HISTORICAL) & test(sentence)

    return F.filter(sentences(text), unsupported)


def forecast_leaks(text: Column) -> Column:
    """Sentences that promise a percentage, other than the model's own confidence."""
    return _flagged(text, lambda s: s.rlike(PERCENTAGE) & ~F.lower(s).rlike(CONFIDENCE))


def historical_confusions(text: Column, outcomes: Column) -> Column:
    """Sentences that present a realised outcome as if it lay ahead.

    ``outcomes`` is an array of realised returns; signs are ignored, as texts say "fell 3%".
    """

    def restated(token: Column) -> Column:
        plain = F.replace(token, F.lit("-"), F.lit(""))
        return F.exists(
            outcomes, lambda o: o.isNotNull() & (_close(plain, F.abs(o)) | _close(plain, F.abs(o) * 100))
        )

    return _flagged(text, lambda s: F.exists(number_tokens(s), restated))


VOWELS = "aeiouy"
CONSONANTS = "bcdfghjklmnpqrstvwxz"


def spelled_words(text: Column) -> Column:
    """The text's words in lower-case letters, each between two blanks of its own."""
    letters = F.regexp_replace(F.lower(text), r"[^a-z \t\r\n]+", "")
    return F.concat(F.lit(" "), F.regexp_replace(letters, r"[ \t\r\n]+", "  "), F.lit(" "))


def word_count(spelled: Column) -> Column:
    return F.regexp_count(spelled, F.lit("[a-z]+"))


def syllable_count(spelled: Column) -> Column:
    """Vowel groups without a silent final e, and at least one per word."""
    groups = F.regexp_count(spelled, F.lit(f"[{VOWELS}]+"))
    silent = F.regexp_count(spelled, F.lit(f"[{VOWELS}][{CONSONANTS}][a-z]*e "))
    short_silent = F.regexp_count(spelled, F.lit(f" [{CONSONANTS}]+ "))
    return groups - silent + short_silent


def readability(text: Column) -> dict[str, Column]:
    """Flesch reading ease and Flesch-Kincaid grade; NULL for a text without words."""
    spelled = spelled_words(text)
    words = word_count(spelled)
    per_sentence = F.try_divide(words, F.size(sentences(text)))
    per_word = F.try_divide(syllable_count(spelled), words)
    return {
        "flesch_reading_ease": 206.835 - 1.015 * per_sentence - 84.6 * per_word,
        "flesch_kincaid_grade": 0.39 * per_sentence + 11.8 * per_word - 15.59,
    }
