"""Column helpers that clean, cast and classify raw fields. All are built-in expressions that stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that stand for a missing value.
SENTINELS = ("", "NULL", "null", "N/A", "NA", "none", "NONE")
#: Spellings of units of measure and their standard unit.
UNITS = {"EA": "EA", "EACH": "EA", "EACHES": "EA", "CA": "CA", "CASE": "CA", "CS": "CA", "BX": "BX", "BOX": "BX"}
#: Ordered keyword classes of item descriptions, and the class of what has none.
KEYWORD_CLASSES = (
    ("Orthopedic / Implants", ("IMPLANT", "SCREW", "PLATE", "SPINE", "BONE")),
    ("Cardiology", ("STENT", "PACEMAKER", "BALLOON", "CATH")),
    ("PPE / Apparel", ("GLOVE", "MASK", "GOWN", "PPE")),
    ("Surgical Supplies", ("SUTURE", "STAPLE", "BLADE")),
    ("Wound Care", ("DRESSING", "GAUZE", "WOUND")),
    ("IV & Injection", ("SYRINGE", "NEEDLE", "IV")),
)
UNCLASSIFIED = "General Medical (Unclassified)"
#: Legal forms at the end of a vendor's name.
LEGAL_FORMS = ("INC", "INCORPORATED", "LLC", r"L\.L\.C\.", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", r"SC\s+INC")

#: Groups of procedures and the group that they are part of, and the group of what has none.
PROCEDURE_GROUPS = {
    "Amputation": "Amputation Surgery",
    "Cardiac Device": "Cardiac Device Surgery",
    "Cardiac Device Implant": "Cardiac Device Surgery",
    "Cardiac Device Implantation": "Cardiac Device Surgery",
    "Cardiac Device Procedure": "Cardiac Device Surgery",
    "Cardiac Intervention": "Cardiovascular Intervention",
    "Cardiac Procedure": "Cardiovascular Intervention",
    "Cardiac Surgery": "Cardiovascular Surgery",
    "Cardiovascular Support Procedure": "Cardiovascular Support",
    "Cardiovascular Procedure": "Cardiovascular Intervention",
    "Cardiothoracic Surgery": "Cardiovascular Surgery",
    "Cardiovascular Device": "Cardiac Device Surgery",
    "Emergency Abdominal Surgery": "Abdominal Surgery",
    "Gynecologic Oncology": "Gynecologic Oncology Surgery",
    "Gynecologic Procedure": "Gynecologic Surgery",
    "Obstetric and Gynecologic Surgery": "Obstetric & Gynecologic Surgery",
    "Head and Neck Oncology": "Head and Neck Surgery",
    "Head and Neck Procedure": "Head and Neck Surgery",
    "Maxillofacial Trauma": "Maxillofacial Trauma Surgery",
    "Maxillofacial Fracture Fixation": "Maxillofacial Trauma Surgery",
    "Neurologic Surgery": "Neurosurgery",
    "Orthopedic Trauma": "Orthopedic Trauma Surgery",
    "Orthopedic Fracture Care": "Orthopedic Fracture Repair",
    "Orthopedic Fracture Fixation": "Orthopedic Fracture Repair",
    "Orthopedic Fracture Surgery": "Orthopedic Fracture Repair",
    "Orthopedic Hardware Surgery": "Orthopedic Hardware Removal",
    "Orthopedic Joint Replacement": "Orthopedic Implant",
    "Orthopedic Infection Surgery": "Orthopedic Surgery",
    "Orthopedic Tendon Repair": "Orthopedic Soft Tissue Surgery",
    "Orthopedic Wound Surgery": "Orthopedic Soft Tissue Surgery",
    "Otolaryngology Procedure": "ENT Surgery",
    "Otolaryngology Surgery": "ENT Surgery",
    "ENT Procedure": "ENT Surgery",
    "Plastic and Reconstructive Surgery": "Plastic & Reconstructive Surgery",
    "Reconstructive Plastic Surgery": "Plastic & Reconstructive Surgery",
    "Reconstructive Surgery": "Plastic & Reconstructive Surgery",
    "Spine Surgery": "Spinal Surgery",
    "Spinal Fusion": "Spinal Surgery",
    "Thoracic Procedure": "Thoracic Surgery",
    "Thoracic Trauma Surgery": "Thoracic Surgery",
    "Vascular Access": "Vascular Access Surgery",
    "Vascular Procedure": "Vascular Surgery",
    "Wound Surgery": "Wound Debridement",
    "Wound and Soft Tissue Surgery": "Wound Debridement",
    "Unclassified Surgical Procedure": "Unclassified Procedure",
    "Uncompleted Procedure": "Aborted Procedure",
    "Organ Transplant": "Organ Transplantation",
    "Transplant Surgery": "Organ Transplantation",
    "Biopsy and Excision": "Biopsy",
    "Diagnostic Biopsy": "Biopsy",
    "Diagnostic Laparoscopy": "Diagnostic Procedure",
    "Diagnostic Examination": "Diagnostic Procedure",
    "Surgical Examination": "Diagnostic Procedure",
    "Upper GI Endoscopy": "Gastrointestinal Endoscopy",
    "Lower GI Endoscopy": "Gastrointestinal Endoscopy",
    "Advanced GI Endoscopy": "Gastrointestinal Endoscopy",
    "Gastrointestinal Procedure": "Gastrointestinal Surgery",
    "Gastric Surgery": "Gastrointestinal Surgery",
    "Foregut Surgery": "Gastrointestinal Surgery",
    "Hepatobiliary Procedure": "Hepatobiliary Surgery",
    "Biliary Surgery": "Hepatobiliary Surgery",
    "Biliary Endoscopy": "Endoscopic Biliary Procedure",
}
UNGROUPED = "General Clinical Procedure"


def clean_string(c: Column) -> Column:
    """Sentinels become null; ends are trimmed and white space is collapsed."""
    return F.when(~F.trim(c).isin(*SENTINELS), F.regexp_replace(F.trim(c), r"\s+", " "))


def clean_upper(c: Column) -> Column:
    return F.upper(clean_string(c))


def safe_double(c: Column) -> Column:
    return c.try_cast("double")


def safe_int(c: Column) -> Column:
    """Rounds half away from zero, as text like '12.7' is read."""
    x = c.try_cast("double")
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("int")


def parse_number(c: Column) -> Column:
    """Thousands separators are dropped."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def parse_date(c: Column) -> Column:
    """ISO dates by their first ten characters, else month/day/year."""
    return F.coalesce(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("MM/dd/yyyy"))).cast("date")


def date_status(c: Column) -> Column:
    return F.when(c.isNull() | (F.trim(c) == ""), "MISSING").when(parse_date(c).isNull(), "INVALID").otherwise("VALID")


def standard_unit(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    key = F.upper(F.trim(c))
    return F.coalesce(F.try_element_at(known, key), F.nullif(key, F.lit("")), F.lit("EA"))


def vendor_key(c: Column) -> Column:
    """Upper case, white space collapsed; a blank stays blank."""
    return F.regexp_replace(F.trim(F.upper(F.coalesce(c, F.lit("")))), r"\s+", " ")


def item_key(c: Column) -> Column:
    """Trimmed; leading zeros stay."""
    return F.trim(F.coalesce(c, F.lit("")))


def keyword_class(description: Column, fallback: Column, seed: Column | None = None) -> Column:
    """The seed's class, else the first class with a keyword in the description, else the fallback, else UNCLASSIFIED."""
    text = F.upper(F.coalesce(description, F.lit("")))
    out = F.coalesce(F.nullif(F.trim(fallback), F.lit("")), F.lit(UNCLASSIFIED))
    for name, words in reversed(KEYWORD_CLASSES):
        out = F.when(reduce(lambda a, b: a | b, (text.contains(w) for w in words)), name).otherwise(out)
    return out if seed is None else F.coalesce(seed, out)


def quality_score(has_id: Column, has_maker: Column, has_class: Column) -> Column:
    """100, less 20, 20 and 10 for what is missing."""
    return (100 - F.when(has_id, 0).otherwise(20) - F.when(has_maker, 0).otherwise(20) - F.when(has_class, 0).otherwise(10)).cast("int")


def first_token(c: Column) -> Column:
    """The first of a list separated by commas or bars."""
    return F.trim(F.split(c, "[,|]").getItem(0))


def primary_drg(c: Column) -> Column:
    """The first MS code, else the first APR code, else the first code."""
    codes = F.transform(F.split(c, "[,|]"), lambda x: F.trim(x))
    pick = lambda prefix: F.try_element_at(F.filter(codes, lambda x: x.startswith(prefix)), F.lit(1))
    return F.coalesce(pick("MS"), pick("APR"), codes.getItem(0))


def procedure_name(c: Column) -> Column:
    """Upper case without commas; a trailing approach comes first."""
    text = F.regexp_replace(F.upper(F.trim(c)), ",", "")
    for word in ("LAPAROSCOPIC", "ROBOTIC"):
        text = F.when(text.endswith(f" {word}"), F.concat(F.lit(f"{word} "), F.expr("''"), F.regexp_replace(text, f" {word}$", ""))).otherwise(text)
    return text


def procedure_group(c: Column) -> Column:
    """The group that a procedure's group is part of, else itself; a blank one has no group."""
    known = F.create_map(*(F.lit(x) for pair in PROCEDURE_GROUPS.items() for x in pair))
    g = F.trim(c)
    return F.when(F.coalesce(g, F.lit("")) == "", UNGROUPED).otherwise(F.coalesce(F.try_element_at(known, g), g))


def category_code(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d{6,8})", 1), F.lit(""))


def category_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^\d{6,8}\s*-?\s*", ""))


def row_hash(*cols: Column) -> Column:
    return F.md5(F.concat_ws("||", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)))


def cents(c: Column) -> Column:
    """Rounded to two places by one rule that engines share: half a cent, less what sums in another order differ by, goes up."""
    return F.floor(c * 100 + 0.501) / 100.0


def pad_code(c: Column, width: int) -> Column:
    return F.when(c.rlike(r"^\d+$") & (F.length(c) < width), F.lpad(c, width, "0")).otherwise(c)


def strip_suffix(c: Column) -> Column:
    """A vendor's name without its legal form, white space collapsed."""
    bare = F.regexp_replace(F.upper(F.trim(c)), rf"[,.]?\s+({'|'.join(LEGAL_FORMS)})$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
