"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from radiokpi.schemas import ALL_IDENTITY_FIELDS, CELL_FAMILIES, IDENTITY_FIELDS, ITBBU_PLATFORM

# Every character of Unicode that is white space, and the four separators Python strips as well.
_SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_space(value) -> Column:
    """Remove every kind of leading and trailing whitespace (``trim`` removes blanks only)."""
    return F.trim(_col(value), F.lit(_SPACES))


def blank_to_null(value) -> Column:
    return F.nullif(strip_space(value), F.lit(""))


def counter_number(value) -> Column:
    """Counter text as DOUBLE; NULL where blank or not a number.

    The pattern keeps out forms such as ``1d`` that a Spark cast would accept.
    An underscore between two digits groups them and is left out.
    """
    text = F.regexp_replace(strip_space(value), r"(?<=[0-9])_(?=[0-9])", "")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def stamp(value) -> Column:
    """Twelve or fourteen digits (minute or second) to a zone-less timestamp, NULL where they are no time.

    Cast as written, so the session time zone plays no part.
    """
    digits = _col(value)

    def part(start: int, length: int = 2):
        return F.substring(digits, start, length)

    parts = F.concat(part(1, 4), F.lit("-"), part(5), F.lit("-"), part(7), F.lit(" "), part(9), F.lit(":"), part(11), F.lit(":"),
                     F.rpad(part(13), 2, "0"))
    return F.when(digits.rlike(r"^\d{12}(\d\d)?$"), parts.try_cast("timestamp_ntz"))


def _key_parts(family: Column, fields) -> Column:
    parts = [F.lit("family="), family]
    for field in fields:
        parts += [F.lit(f"|{field}="), F.coalesce(F.col(field), F.lit(""))]
    return F.concat(*parts)


def logical_entity_key(family="dataset_family") -> Column:
    """Key of the network entity a fact row belongs to, e.g. ``family=…|sbnid=…|enbid=…|cellid=…``."""
    family = _col(family)
    key = F
    for name, fields in IDENTITY_FIELDS.items():
        key = key.when(family == name, _key_parts(F.lit(name), fields))
    return key.otherwise(_key_parts(F.coalesce(family, F.lit("UNKNOWN")), ALL_IDENTITY_FIELDS))


def entity_level(family="dataset_family") -> Column:
    family = _col(family)
    return (
        F.when(family.isin(*CELL_FAMILIES), "cell").when(family == ITBBU_PLATFORM, "meid").otherwise("raw")
    )


def safe_ratio(numerator, denominator, scale=1.0) -> Column:
    """``numerator / denominator * scale``, NULL when either is NULL or the divisor is zero."""
    numerator, denominator = _col(numerator), _col(denominator)
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.when(denominator != 0, numerator / denominator * scale)


def percent_ratio(numerator, denominator) -> Column:
    numerator, denominator = _col(numerator), _col(denominator)
    return F.when(denominator != 0, F.lit(100.0) * numerator / denominator)


def percent_of(part, whole: int) -> Column:
    """Share of ``whole`` in percent as a decimal with two places, NULL for a zero ``whole``."""
    if whole == 0:
        return F.lit(None).cast("decimal(20,2)")
    share = _col(part).cast("decimal(20,0)") / F.lit(whole).cast("decimal(20,0)")
    return F.round(share * 100, 2).cast("decimal(20,2)")
