"""Keys and coercions: one helper for each dialect, never merged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: texts that count as true in each dialect
TRUE_WORDS = {
    "cleaning": ("1", "true", "yes", "y"),
    "odds": ("1", "true", "yes", "y"),
    "players": ("1", "true", "yes", "y", "sub", "substitute"),
    "update": ("1", "true", "yes", "y", "on"),
}
# fixed values: texts that count as false where any other text is true
FALSE_WORDS = ("", "0", "false", "no", "n", "none")


def text(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def truthy(c: Column, dialect: str) -> Column:
    """features: any text but FALSE_WORDS and zero numbers; odds: also any nonzero number; else TRUE_WORDS only."""
    t, number = text(c), c.cast("string").try_cast("double")
    if dialect == "features":
        return F.coalesce(F.when(number.isNotNull(), number != 0).otherwise(~t.isin(*FALSE_WORDS)), F.lit(False))
    words = F.coalesce(t.isin(*TRUE_WORDS[dialect]), F.lit(False))
    return words | F.coalesce(number != 0, F.lit(False)) if dialect == "odds" else words


def number(c: Column, default: float | None = None) -> Column:
    """Null, blank and bad text give the default."""
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double"), F.lit(default).cast("double"))


def team_key(c: Column, inner_spaces: bool = True) -> Column:
    k = text(c)
    return k if inner_spaces else F.replace(k, F.lit(" "), F.lit(""))


def pair_key(a: Column, b: Column, inner_spaces: bool = True) -> Column:
    """The same for both orientations."""
    return F.concat_ws("__", F.array_sort(F.array(team_key(a, inner_spaces), team_key(b, inner_spaces))))


def map_key(c: Column) -> Column:
    return F.replace(text(c), F.lit("de_"), F.lit(""))


def split_list(c: Column) -> Column:
    """Pipe, semicolon and comma lists; blanks dropped."""
    return F.filter(F.transform(F.split(c, "[|;,]"), lambda x: map_key(x)), lambda x: x != "")


def american_to_decimal(a: Column) -> Column:
    return F.when(a > 0, 1 + a / 100.0).when(a < 0, 1 + 100.0 / F.abs(a))
