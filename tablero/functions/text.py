"""Column helpers for words, labels and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablero.schema import RATING_WORDS

DAY_FORMAT = "dd/MM/yyyy"
CLOCK_FORMAT = "dd/MM/yyyy hh:mm a"


def rating_word(code: Column) -> Column:
    """Word of a rating, null outside the scale."""
    word = F.lit(None).cast("string")
    for value, text in RATING_WORDS.items():
        word = F.when(code == value, text).otherwise(word)
    return word


def rating_code(word: Column) -> Column:
    """Rating of a word, null for any other text."""
    code = F.lit(None).cast("int")
    for value, text in RATING_WORDS.items():
        code = F.when(word == text, value).otherwise(code)
    return code


def percent_text(ratio: Column) -> Column:
    """Ratio as a percentage with two decimals, halves to the even digit; null stays null."""
    hundredths = F.rint(ratio / 0.0001)
    return F.when(ratio.isNotNull(), F.format_string("%.2f%%", hundredths / 100))


def activity_label(activity: Column, moment: Column) -> Column:
    """``activity dd/mm/yyyy``; a missing part shows as NA, as in the printed lists."""
    day = F.date_format(moment, DAY_FORMAT)
    return F.concat_ws(" ", F.coalesce(activity, F.lit("NA")), F.coalesce(day, F.lit("NA")))


def challenge_name(first_day: Column, days: int) -> Column:
    """The name a challenge gets from its first day."""
    return F.concat(
        F.lit("Reto del "), F.date_format(first_day, DAY_FORMAT),
        F.lit(" al "), F.date_format(F.date_add(first_day, days - 1), DAY_FORMAT))


def blank_to_null(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Empty texts and numeric zeros of form rows become null, except in the columns to keep."""

    def clean(field: T.StructField) -> Column:
        c = F.col(field.name)
        if field.name in keep:
            return c
        if isinstance(field.dataType, T.StringType):
            return F.nullif(c, F.lit("")).alias(field.name)
        if isinstance(field.dataType, T.NumericType):
            return F.nullif(c, F.lit(0).cast(field.dataType)).alias(field.name)
        return c

    return df.select(*[clean(f) for f in df.schema])


def sentence_case(df: DataFrame) -> DataFrame:
    """Column names as headings: first letter upper, the rest lower."""
    return df.withColumnsRenamed({c: c[:1].upper() + c[1:].lower() for c in df.columns})
