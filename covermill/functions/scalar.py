"""Column functions: text, hashing, number and cell helpers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space (Unicode's included) and characters of no width.
BLANK = r"[\s\p{Z}\p{Cf}\x1c-\x1f\x85]"


def compared(value: Column) -> Column:
    """A value's compared form: lower case, without white space and zero-width characters."""
    # most values are printable ASCII without blanks, which a plain range shows much faster than Unicode's classes do
    return F.lower(F.when(value.rlike("[^!-~]"), F.regexp_replace(value, BLANK + "+", "")).otherwise(value))


def as_float(value: Column, default: float = float("nan")) -> Column:
    """A number, or ``default`` where the value is null or no number."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def as_int(value: Column, default: int = 0) -> Column:
    """A whole number by way of a double, cut towards zero; ``default`` where that fails or is no finite number."""
    number = value.try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number.try_cast("bigint")), F.lit(default).cast("bigint"))


def safe_name(text: Column, longest: int = 120) -> Column:
    """A file name of at most ``longest`` characters: others than these become ``_``; a longer name is cut and ends in
    ten digits of the sha1 of the cleaned name."""
    clean = F.regexp_replace(text, r"[^A-Za-z0-9_.=+:-]+", "_")
    return F.when(F.length(clean) > longest, F.concat(F.substring(clean, 1, longest - 11), F.lit("_"), F.substring(F.sha1(clean), 1, 10))).otherwise(clean)


def rcut_of(key: Column, default: float = 3.0) -> Column:
    """The cutoff of a token or type: the first ``r<number>`` at its start or after a colon."""
    found = F.regexp_extract(key, r"(?:^|:)r(\d+(?:\.\d+)?)", 1)
    return F.coalesce(F.when(found != "", found.cast("double")), F.lit(default))


def center_of(key: Column) -> Column:
    """The center symbol of a type, the first ``:<symbol>:cn`` in any case of letters; ``?`` if it has none."""
    found = F.regexp_extract(key, r"(?i):([a-z][a-z]?):cn", 1)
    return F.when(found != "", found).when(key.isNotNull(), "?")


def piece_tokens(text: Column) -> Column:
    """The set of letter runs, numbers and single other characters, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z]+|\d+\.\d+|\d+|[^\sA-Za-z0-9])"), F.lit(1))))


def type_tokens(text: Column) -> Column:
    """The words and numbers of a type's name in their order, then the trigrams of the name without white space."""
    # fixed values: the pattern decides which tokens there are
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z]+|cn\d+|r\d+(?:\.\d+)?|sim\d+|\d+|[A-Za-z0-9_.:-]+)"), F.lit(1))
    return F.concat(words, trigrams(F.regexp_replace(text, r"\s+", "")))


def trigrams(text: Column) -> Column:
    """Successive triples of characters; none for shorter texts."""
    last = F.length(text) - 2
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def hashed_slot(token: Column, dim: int = 128) -> tuple[Column, Column]:
    """Signed feature hashing by sha1 for a ``dim`` that is a power of two up to 4096: the slot and the sign."""
    low = F.conv(F.right(F.sha1(token), F.lit(4)), 16, 10).cast("int")
    sign = F.when(F.shiftright(low, 8).bitwiseAND(1) == 1, 1.0)
    return low.bitwiseAND(dim - 1), sign.otherwise(-1.0)


def det3(cell: Column) -> Column:
    """Determinant of a cell of nine numbers, row by row."""
    a = [cell[i] for i in range(9)]
    return a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])


def cell_ok(cell: Column, rcut: float, least_volume: float = 1e-6) -> Column:
    """Whether a cell has a volume and no vector shorter than the cutoff; false for a missing or broken cell."""
    long = [F.sqrt(sum((cell[3 * k + i] * cell[3 * k + i] for i in range(3)), F.lit(0.0))) >= rcut for k in range(3)]
    return F.coalesce((F.size(cell) == 9) & (F.abs(det3(cell)) >= least_volume) & long[0] & long[1] & long[2], F.lit(False))


def angle_degrees(cosine: Column) -> Column:
    """The angle of a cosine that rounding may have put outside of -1 to 1."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def inner_energy(free_energy: Column, temperature: Column, entropy: Column) -> Column:
    """``F + T * S / 1000``: kJ from kJ and J per kelvin."""
    return free_energy + temperature * entropy / 1000
