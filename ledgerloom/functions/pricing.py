"""Price comparisons, savings and guardrails as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiples that a pack price may be of an each price.
PACK_MULTIPLES = (2, 4, 5, 6, 8, 10, 12, 15, 20, 24, 25, 30, 48, 50, 100, 120, 144, 250, 500)
#: Units that a number of eaches may follow, and the eaches in units without a number.
PACK_UNITS = ("BX", "BOX", "CS", "CASE", "PK", "PACK", "PKG", "DZ", "CT", "CARTON")
PACK_FACTORS = {
    "EA": 1, "EACH": 1, "PC": 1, "PIECE": 1, "UNIT": 1, "UN": 1, "DZ": 12, "DOZEN": 12, "PR": 2, "PAIR": 2, "BX": 10, "BOX": 10, "CS": 50, "CASE": 50, "PK": 5, "PACK": 5, "PKG": 5,
    "KIT": 1, "SET": 1, "TRAY": 1, "VIAL": 1, "BTL": 1, "BOTTLE": 1, "AMP": 1, "AMPOULE": 1, "SYR": 1, "SYRINGE": 1, "ROLL": 1, "BAG": 1,
}
PACK_PATTERN = rf"({'|'.join(PACK_UNITS)})[/\s_-]*(\d+)"


def variance(unit: Column, quantity: Column, contract: Column, contract_each: Column, factor: Column, same_unit: Column) -> Column:
    """(unit price - contract price in the line's unit) x quantity; 0 without a contract price."""
    basis = F.when(same_unit, contract).otherwise(F.coalesce(contract_each * factor, F.lit(0.0)))
    return F.when(F.coalesce(contract > 0, F.lit(False)), (unit - basis) * quantity).otherwise(0.0)


def overpayment(var: Column) -> Column:
    return F.greatest(var, F.lit(0.0))


def savings(on_contract: Column, var: Column, spend: Column, share: float = 0.15) -> Column:
    """What a contract saves: its overpayment, or a share of the spend of lines without contract; 0 where that is unknown."""
    return F.when(on_contract, overpayment(var)).when(~on_contract, spend * share).otherwise(0.0)


def compliant(on_contract: Column, var: Column, spend: Column, tolerance: float = 0.005) -> Column:
    return F.coalesce(on_contract & (F.abs(var) <= spend * tolerance), F.lit(False))


def comparison_flag(paid: Column, mapped: Column, percent: float) -> Column:
    """Strictly above percent of the mapped price; not comparable if a price is missing or the mapped one is 0."""
    usable = paid.isNotNull() & mapped.isNotNull() & (mapped != 0)
    return F.when(~usable, "NOT_COMPARABLE").when((paid - mapped) / mapped * 100 > percent, f"ABOVE_{percent:g}_PERCENT").otherwise("WITHIN")


def _number(unit: Column) -> Column:
    """The number after a pack unit anywhere in the text, null without one or if it is 0."""
    n = F.regexp_extract(F.upper(unit), PACK_PATTERN, 2).try_cast("double")
    return F.when(n > 0, n)


def pack_factor(unit: Column) -> Column:
    """The number in units such as BX/10, PK 20 or BOX-12, else that of a known unit, else 1."""
    known = F.create_map(*(F.lit(x) for k, v in PACK_FACTORS.items() for x in (k, float(v))))
    return F.coalesce(_number(unit), F.try_element_at(known, F.upper(F.trim(unit))), F.lit(1.0))


def pack_label(unit: Column) -> Column:
    """The first two letters of a pack unit and its number, else the unit; EA for none."""
    n, kind = _number(unit), F.regexp_extract(F.upper(unit), PACK_PATTERN, 1)
    plain = F.coalesce(F.nullif(F.upper(F.trim(unit)), F.lit("")), F.lit("EA"))
    return F.when(n > 0, F.concat(F.substring(kind, 1, 2), F.lit("/"), n.cast("long").cast("string"))).otherwise(plain)


def pack_mismatch(paid: Column, contract: Column, tolerance: float = 0.08) -> Column:
    """The first multiple that the ratio of both prices is within tolerance of; null without one."""
    ratio = paid / F.nullif(contract, F.lit(0.0))
    near = F.filter(F.array(*(F.lit(float(m)) for m in PACK_MULTIPLES)), lambda m: F.abs(ratio - m) / m <= tolerance)
    return F.try_element_at(near, F.lit(1))


def spike(price: Column, usual: Column) -> Column:
    ratio = price / F.nullif(usual, F.lit(0.0))
    return (
        F.when(ratio.between(8.5, 11.5), "10X_TYPO").when(ratio.between(85.0, 115.0), "100X_TYPO")
        .when(ratio >= 3.0, "HIGH").when(ratio <= 0.1, "LOW").otherwise("NORMAL")
    )


def sanity(paid: Column, contract: Column) -> Column:
    ratio = paid / F.nullif(contract, F.lit(0.0))
    return F.when(ratio.isNull(), "OFF_CONTRACT").when(ratio > 2.5, "SEVERE_OVERCHARGE").when(ratio < 0.2, "DEEP_DISCOUNT").otherwise("WITHIN_BAND")
