"""A small onboarding world with known results, and a builder for variations of it."""

import datetime as dt
from decimal import Decimal

from casewright.schema import TABLES

AS_OF = dt.datetime(2026, 3, 1, 9, 30)

# Keys, statuses and percentages of the worked example.
FORM_OF_COMPANY = {1: 1, 2: 2, 3: 4, 4: 5, 5: 6, 6: 7, 7: 8, 8: 9, 9: 10, 10: 11, 11: 12, 12: 13}
COUNTRY_OF_FORM = {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3, 8: 4, 9: 4, 10: 5, 11: 5, 12: 6, 13: 6}
STATUSES = (
    "Approved Open InReview Approved Open Rejected InReview Open Approved Open InReview Open".split()
)
RULES = [  # legal form, type, for owners
    (1, 1, False),
    (1, 2, False),
    (1, 5, True),
    (2, 1, False),
    (2, 5, True),
    (3, 1, False),
    (3, 3, False),
    (3, 5, True),
    (4, 1, False),
    (4, 2, False),
    (4, 5, True),
]
DOCUMENTS = [  # case, owner, type, status
    (1, None, 1, "Verified"),
    (1, None, 2, "Verified"),
    (1, 1, 5, "Verified"),
    (3, None, 1, "Pending"),
    (3, None, 2, "Pending"),
    (4, None, 1, "Verified"),
    (4, 3, 5, "Verified"),
    (7, None, 1, "Pending"),
    (9, None, 1, "Verified"),
    (9, 7, 5, "Verified"),
]
HOLDINGS = [  # company, owner, percentage, direct
    (1, 1, 30, True),
    (2, 2, 20, True),
    (3, 3, 35, True),
    (3, 2, 65, True),
    (4, 3, 15, False),
    (5, 4, 23, True),
    (6, 4, 40, False),
    (7, 5, 20, True),
    (8, 6, 28, True),
    (8, 5, 72, True),
    (9, 7, 24, True),
    (10, 7, 52, False),
    (11, 8, 30, True),
    (12, 8, 49, False),
    (12, 9, 60, True),
]
CHECKED_CASES = (1, 1, 4, 6, 9)


def rows_of_sample() -> dict[str, list[dict]]:
    regions = ["DACH"] * 3 + ["BENELUX"] * 3
    opened = dt.date(2025, 1, 10)
    return {
        "country": [
            dict(country_id=i, country_code=f"C{i}", country_name=f"Country {i}", region_name=r)
            for i, r in enumerate(regions, 1)
        ],
        "legal_form": [
            dict(legal_form_id=f, country_id=c, legal_form_code=f"F{f}", legal_form_name=f"Form {f}")
            for f, c in COUNTRY_OF_FORM.items()
        ],
        "company": [
            dict(
                company_id=c,
                legal_form_id=f,
                company_name=f"Company {c}",
                registration_number=f"REG-{c}",
                employee_count=10 * c,
                annual_revenue=Decimal(1000 * c),
                registration_date=opened,
            )
            for c, f in FORM_OF_COMPANY.items()
        ],
        "company_address": [
            dict(
                company_address_id=2 * c - 1 + k,
                company_id=c,
                country_id=COUNTRY_OF_FORM[f],
                address_type=("Registered", "Physical")[k],
                is_primary=k == 0,
            )
            for c, f in FORM_OF_COMPANY.items()
            for k in (0, 1)
        ],
        "ubo": [
            dict(ubo_id=i, first_name=f"First{i}", last_name=f"Last{i}", nationality="DE", passport_no=f"P-{i}")
            for i in range(1, 11)
        ],
        "ownership": [
            dict(
                ownership_id=i,
                company_id=c,
                ubo_id=u,
                ownership_percentage=Decimal(p),
                is_ownership_direct=d,
                valid_from=opened,
            )
            for i, (c, u, p, d) in enumerate(HOLDINGS, 1)
        ],
        "document_type": [
            dict(document_type_id=i, document_type_name=f"Type {i}", document_scope="Company" if i < 5 else "UBO")
            for i in range(1, 8)
        ],
        "required_documents": [
            dict(
                required_document_id=i,
                legal_form_id=f,
                document_type_id=t,
                requirement_level="Enhanced" if (f, t) == (3, 3) else "Standard",
                applies_to_ubo=u,
                is_mandatory=True,
            )
            for i, (f, t, u) in enumerate(RULES, 1)
        ],
        "onboarding_case": [
            dict(case_id=i, company_id=i, case_open_date=opened, case_status=s)
            for i, s in enumerate(STATUSES, 1)
        ],
        "submitted_documents": [
            dict(
                submitted_document_id=i,
                case_id=c,
                ubo_id=u,
                document_type_id=t,
                submission_date=opened,
                document_status=s,
                verification_date=opened if s == "Verified" else None,
            )
            for i, (c, u, t, s) in enumerate(DOCUMENTS, 1)
        ],
        "external_source": [
            dict(external_source_id=i, source_name=f"Source {i}", source_country="DE", source_type="Registry")
            for i in range(1, 7)
        ],
        "external_verification_check": [
            dict(
                external_check_id=i,
                case_id=c,
                external_source_id=2,
                check_date=opened,
                check_status="Passed",
                result_summary="ok",
            )
            for i, c in enumerate(CHECKED_CASES, 1)
        ],
    }


def frame(spark, name: str, rows: list[dict]):
    """Rows of one table with their declared types; missing columns are NULL."""
    table = TABLES[name]
    full = [tuple(r.get(c.name) for c in table.columns) for r in rows]
    return spark.createDataFrame(full, table.struct)


def world(spark, **replaced: list[dict]) -> dict:
    """The sample tables, some of them replaced by other rows."""
    rows = rows_of_sample() | replaced
    return {name: frame(spark, name, rows[name]) for name in TABLES}


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


__all__ = ["AS_OF", "as_set", "frame", "rows_of_sample", "world"]
