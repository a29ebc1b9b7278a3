"""Column functions on words, keys, targets and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT64_MAX = "18446744073709551615"


def not_blank(word: Column) -> Column:
    """Whether a word holds anything but ASCII white space."""
    return word.rlike(r"[^ \t\n\x0B\f\r]")


def feature_name(word: Column) -> Column:
    """The part before the last colon; the whole word if it has none."""
    return F.when(F.instr(word, ":") > 0, F.regexp_extract(word, "(?s)^(.*):[^:]*$", 1)).otherwise(word)


def feature_value(word: Column) -> Column:
    """The part after the last colon; ``1`` if there is none."""
    return F.when(F.instr(word, ":") > 0, F.regexp_extract(word, "(?s):([^:]*)$", 1)).otherwise(F.lit("1"))


def canonical_key(name: Column) -> Column:
    """One spelling for all spellings of an unsigned 64-bit integer; other names are themselves."""
    digits = F.regexp_extract(name, r"^\+?0*([0-9]+)$", 1)
    fits = (F.char_length(digits) < 20) | (F.char_length(digits) == 20) & (digits <= UINT64_MAX)
    return F.when(name.rlike(r"^\+?[0-9]+$") & fits, digits).otherwise(name)


def number(value: Column, permissive: bool = True) -> Column:
    """A dense value: empty is 0; unreadable is null, or an error if not permissive."""
    cleaned = F.when(F.trim(value) == "", "0").otherwise(value)
    return cleaned.try_cast("double") if permissive else cleaned.cast("double")


def positive(target: Column) -> Column:
    """1 for targets above zero, else 0."""
    return F.when(target > 0, 1).otherwise(0)


def signed_label(target: Column) -> Column:
    """-1 or 1, as online linear learners take it."""
    return F.when(target > 0, 1).otherwise(-1)


def log_scale(x: Column, offset: float = 1.0) -> Column:
    """ln(offset + x); missing and zero stay 0."""
    return F.when(x.isNull() | (x == 0), 0.0).otherwise(F.log(x + offset))


def svm_pair(index: int, x: Column) -> Column:
    """``index:value``; null (nothing) for zero and missing."""
    return F.when(x != 0, F.concat_ws(":", F.lit(str(index)), x.cast("string")))


def estimation_half(words: Column, rate: int) -> Column:
    """Whether a line (an array of all its words, target included) is for estimation: about one in 2**rate.

    The choice depends on the content alone, so equal lines fall on one side.
    """
    if not 1 <= rate <= 32:
        raise ValueError("rate must be from 1 to 32")
    digits = F.substring(F.md5(F.array_join(words, "\x1f").cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long").bitwiseAND((1 << rate) - 1) == 0


def information_term(n: Column, count: Column, negatives: Column, p_negative: Column) -> Column:
    """(count / n) times the divergence of an interval's classes from the global ones; 0 ln 0 counts as 0."""
    def part(k: Column, share: Column) -> Column:
        return F.when(k > 0, k / n * F.log(k / count / share)).otherwise(0.0)

    return F.when(count > 0, part(negatives, p_negative) + part(count - negatives, 1 - p_negative)).otherwise(0.0)
