"""Checks of matched values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.arrays import let, over, quoted

# Fixed values of the identity-number standard: weights, check characters and province-level prefixes.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"
ID_PROVINCES = (
    "11", "12", "13", "14", "15", "21", "22", "23", "31", "32", "33", "34", "35", "36", "37", "41", "42", "43", "44", "45", "46",
    "50", "51", "52", "53", "54", "61", "62", "63", "64", "65", "71", "81", "82", "91",
)

# Length and least mean bigram cost, in bits, at which a string counts as random; linear in between.
THRESHOLDS = (
    (9, 5.424), (10, 5.3667), (11, 5.3423), (12, 5.282), (13, 5.2565), (16, 5.1799), (20, 5.0612), (24, 4.9833), (32, 4.8907),
    (40, 4.8327), (48, 4.7662), (56, 4.7277), (64, 4.7052), (80, 4.6549), (96, 4.6248), (112, 4.5948), (128, 4.566),
)


# The checks are SQL text over a name, so that rules can use them within longer expressions; below they are columns.


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def luhn_card_sql(v: str) -> str:
    return let(_digits(v), "dg_", "length(dg_) BETWEEN 13 AND 19 AND NOT rlike(dg_, '^(.)\\\\1*$') AND luhn_check(dg_)")


def international_phone_sql(v: str) -> str:
    return f"(length({_digits(v)}) BETWEEN 8 AND 15 AND substr({v}, 2, 1) <> '0')"


def identity_number_sql(v: str, as_of: str) -> str:
    weights, places = ", ".join(map(str, ID_WEIGHTS)), ", ".join(quoted(p) for p in ID_PROVINCES)
    total = f"aggregate(sequence(1, 17), 0, (sum_, nth_) -> sum_ + cast(substr({v}, nth_, 1) AS int) * array({weights})[nth_ - 1])"
    return (
        f"(rlike({v}, '^[0-9]{{17}}[0-9Xx]$') AND substr({v}, 1, 2) IN ({places}) AND substr({v}, 3, 4) <> '0000' AND substr({v}, 15, 3) <> '000' "
        f"AND try_to_date(substr({v}, 7, 8), 'yyyyMMdd') IS NOT NULL AND substr({v}, 7, 8) BETWEEN '18000101' AND '{as_of}' AND upper(substr({v}, 18, 1)) = substr('{ID_CHECKS}', {total} % 11 + 1, 1))"
    )


def random_threshold_sql(n: str) -> str:
    steps = " ".join(f"WHEN {n} <= {b} THEN {x!r}D + {y - x!r}D * ({n} - {a}) / {float(b - a)!r}D" for (a, x), (b, y) in zip(THRESHOLDS, THRESHOLDS[1:]))
    return f"CASE WHEN {n} <= 8 THEN double('Infinity') {steps} ELSE {THRESHOLDS[-1][1]!r}D END"


def char_entropy_sql(v: str) -> str:
    share = f"((length({v}) - length(replace({v}, ch_, ''))) / length({v}))"
    return f"aggregate(sort_array(array_distinct(split({v}, ''))), 0.0D, (sum_, ch_) -> sum_ - CASE WHEN ch_ = '' THEN 0.0D ELSE {share} * log2({share}) END)"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_card(value: Column) -> Column:
    """13 to 19 digits, not all the same, that pass the mod 10 check."""
    return over(value, "v_", luhn_card_sql("v_"))


def international_phone(value: Column) -> Column:
    """8 to 15 digits behind the plus, the first not 0."""
    return over(value, "v_", international_phone_sql("v_"))


def identity_number(value: Column, as_of: str) -> Column:
    """18 characters with a valid prefix, birth date up to as_of (yyyyMMdd), sequence and check character."""
    return F.coalesce(over(value, "v_", identity_number_sql("v_", as_of)), F.lit(False))


def random_threshold(length: Column) -> Column:
    """The mean bigram cost that a string of this length must exceed; infinite up to 8."""
    return over(length, "n_", random_threshold_sql("n_"))


def char_entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    return over(value, "v_", char_entropy_sql("v_"))


def exact_integer_sql(x: str) -> str:
    part = lambda k: f"regexp_extract({x}, '^\\\\+?([0-9]+)(?:\\\\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?$', {k})"
    power = f"CASE WHEN {part(3)} = '' THEN 0 WHEN rlike({part(3)}, '^[+-]?0*[0-9]{{1,3}}$') THEN try_cast({part(3)} AS int) END"
    taken = "CASE WHEN sh_ >= 0 THEN bo_ ELSE left(bo_, greatest(length(bo_) + sh_, 0)) END"
    full = f"CASE WHEN sh_ > 0 THEN CASE WHEN ltrim('0', bo_) = '' THEN '' WHEN sh_ <= 40 THEN concat(bo_, repeat('0', least(sh_, 40))) END ELSE {taken} END"
    rest = "CASE WHEN sh_ < 0 THEN right(bo_, least(-sh_, length(bo_))) ELSE '' END"
    value = let(f"ltrim('0', {full})", "va_", f"CASE WHEN wh_ <> '' AND NOT rlike({rest}, '[1-9]') AND length(va_) BETWEEN 11 AND 19 THEN va_ END")
    shifted = let("po_ - length(fr_)", "sh_", let("concat(wh_, fr_)", "bo_", value))
    return let(part(1), "wh_", let(f"regexp_replace({part(2)}, '0+$', '')", "fr_", let(power, "po_", f"CASE WHEN po_ IS NOT NULL THEN {shifted} END")))


def exact_integer(lexeme: Column) -> Column:
    """The digits of a positive number's exact integer value, leading zeros dropped, if there are 11 to 19; else null.

    Works on the lexeme: no float, and an exponent is bounded before anything is padded.
    """
    return over(lexeme, "x_", exact_integer_sql("x_"))
