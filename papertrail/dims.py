"""Dimensions of the engine: document types, photo categories, checklist templates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class DocType(NamedTuple):
    name: str
    label: str
    category: str
    expires: bool = False
    owned: bool = True


# Names, labels and flags of the document types, in their order, which also breaks ties.
DOC_TYPES = [
    DocType("AADHAAR", "Aadhaar card", "identity"),
    DocType("PAN", "PAN card", "identity"),
    DocType("DRIVING_LICENCE", "Driving licence", "identity", True),
    DocType("VEHICLE_RC", "Vehicle registration certificate", "property", True),
    DocType("PASSPORT", "Passport", "identity", True),
    DocType("VOTER_ID", "Voter ID card", "identity"),
    DocType("HEALTH_ID_ABHA", "ABHA health ID card", "health"),
    DocType("HEALTH_INSURANCE", "Health insurance policy", "health", True),
    DocType("VEHICLE_INSURANCE", "Vehicle insurance policy", "property", True),
    DocType("LIFE_INSURANCE", "Life insurance policy", "other", True),
    DocType("SALARY_SLIP", "Salary slip", "income"),
    DocType("BANK_STATEMENT", "Bank statement", "income"),
    DocType("EMPLOYMENT_LETTER", "Employment letter", "income"),
    DocType("ITR_FORM16", "Income tax return or Form 16", "income"),
    DocType("RENT_AGREEMENT", "Rent agreement", "property", True),
    DocType("PROPERTY_PAPER", "Property document", "property"),
    DocType("LOAN_SANCTION_EMI", "Loan sanction letter or EMI schedule", "income"),
    DocType("MEDICAL_REPORT", "Medical report", "health"),
    DocType("HOSPITAL_BILL", "Hospital bill", "health"),
    DocType("PRESCRIPTION", "Prescription", "health"),
    DocType("UTILITY_BILL", "Utility bill", "property", True),
    DocType("RECEIPT_INVOICE", "Receipt or invoice", "other", False, False),
    DocType("PAYMENT_SCREENSHOT", "Payment screenshot", "other", False, False),
    DocType("WARRANTY", "Warranty card", "other", True, False),
    DocType("TICKET", "Ticket", "other", False, False),
    DocType("RESUME", "Resume or CV", "other"),
    DocType("OTHER_DOCUMENT", "Other document", "other", False, False),
]
NAMES = [t.name for t in DOC_TYPES]
BY_NAME = {t.name: t for t in DOC_TYPES}
OTHER = "OTHER_DOCUMENT"
BILLS = ["RECEIPT_INVOICE", "PAYMENT_SCREENSHOT", "UTILITY_BILL", "HOSPITAL_BILL"]
MONTHLY = ["SALARY_SLIP", "BANK_STATEMENT", "UTILITY_BILL"]
DOB_LINE_TYPES = ["AADHAAR", "HEALTH_ID_ABHA", "VOTER_ID"]
PHOTO_CATEGORIES = ["screenshot", "selfie", "people", "food", "places", "bills", "documents", "other"]
CONFIDENT = 0.8


class Item(NamedTuple):
    doc_type: str
    count: int = 1
    optional: bool = False
    rule: str | None = None
    months: int = 0


# What each task needs.
TEMPLATES: dict[str, list[Item]] = {
    "home_loan": [Item("AADHAAR"), Item("PAN"), Item("BANK_STATEMENT", 1, False, "within_months", 6), Item("SALARY_SLIP", 3, False, "distinct_months", 3), Item("EMPLOYMENT_LETTER")],
    "health_insurance_claim": [Item("HEALTH_INSURANCE", 1, False, "not_expired"), Item("AADHAAR"), Item("HOSPITAL_BILL"), Item("MEDICAL_REPORT", 1, False, "most_recent", 6), Item("PRESCRIPTION", 1, True), Item("PAN", 1, True), Item("HEALTH_ID_ABHA", 1, True)],
    "vehicle_insurance_renewal": [Item("VEHICLE_INSURANCE"), Item("VEHICLE_RC"), Item("DRIVING_LICENCE"), Item("PAN", 1, True)],
    "passport": [Item("AADHAAR"), Item("PAN", 1, True), Item("UTILITY_BILL", 1, True, "within_months", 3), Item("PASSPORT", 1, True)],
    "health_insurance_renewal": [Item("HEALTH_INSURANCE"), Item("AADHAAR"), Item("PAN", 1, True), Item("MEDICAL_REPORT", 1, True, "most_recent", 12)],
    "driving_licence_renewal": [Item("DRIVING_LICENCE"), Item("AADHAAR"), Item("MEDICAL_REPORT", 1, True, "most_recent", 6)],
    "life_insurance_renewal": [Item("LIFE_INSURANCE"), Item("PAN", 1, True)],
    "renewal_generic": [Item("AADHAAR"), Item("PAN", 1, True)],
}
RENEWALS = {
    "HEALTH_INSURANCE": "health_insurance_renewal",
    "VEHICLE_INSURANCE": "vehicle_insurance_renewal",
    "DRIVING_LICENCE": "driving_licence_renewal",
    "LIFE_INSURANCE": "life_insurance_renewal",
    "PASSPORT": "passport",
}
DEFAULT_RENEWAL = "renewal_generic"


def doc_types(spark: SparkSession) -> DataFrame:
    rows = [(i, t.name, t.label, t.category, t.expires, t.owned, t.name in BILLS, t.name in MONTHLY) for i, t in enumerate(DOC_TYPES)]
    return spark.createDataFrame(rows, "ordinal int, doc_type string, label string, category string, expires boolean, owned boolean, bill boolean, monthly boolean")


def templates(spark: SparkSession, given: dict[str, list[Item]] | None = None) -> DataFrame:
    rows = [(name, k, *item) for name, items in (given or TEMPLATES).items() for k, item in enumerate(items)]
    return spark.createDataFrame(rows, "template string, position int, doc_type string, n int, optional boolean, rule string, months int")


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A small dictionary as an expression: no join."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def parse_type(raw: Column) -> Column:
    """A document type's name, whatever its case, or null."""
    up = F.upper(F.trim(raw))
    return F.when(up.isin(NAMES), up)


def category_of(doc_type: Column) -> Column:
    return lookup(doc_type, {t.name: t.category for t in DOC_TYPES}, "other")


def label_of(doc_type: Column) -> Column:
    return lookup(doc_type, {t.name: t.label for t in DOC_TYPES})


def renewal_template(doc_type: Column) -> Column:
    return lookup(doc_type, RENEWALS, DEFAULT_RENEWAL)
