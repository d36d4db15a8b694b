"""The twelve onboarding tables, declared once.

Readers, default filling and every integrity job are generated from this
specification, so a rule is written down in exactly one place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The closed vocabularies and the defaults of the data model.
ADDRESS_TYPES = ("Registered", "Physical")
DOCUMENT_SCOPES = ("Company", "UBO")
CASE_STATUSES = ("Open", "InReview", "Approved", "Rejected", "Closed")
DOCUMENT_STATUSES = ("Pending", "Verified", "Rejected")
CHECK_STATUSES = ("Pending", "Passed", "Failed", "Manual")

#: Marks a DATE default that is the day of the load.
TODAY = object()
#: Marks a column without a default: when omitted it is NULL.
NO_DEFAULT = object()


@dataclass(frozen=True)
class Col:
    """One column; ``length`` is the character limit of a text column."""

    name: str
    type: T.DataType
    required: bool = True
    length: int | None = None
    default: object = NO_DEFAULT


@dataclass(frozen=True)
class Check:
    """A row rule. ``allowed`` is a vocabulary, else ``low``/``high`` bounds."""

    column: str
    allowed: tuple[str, ...] | None = None
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Table:
    """A table; its first column is the primary key."""

    name: str
    columns: tuple[Col, ...]
    unique: tuple[str, ...] = ()
    #: column -> parent table (whose key it refers to)
    foreign: dict[str, str] = field(default_factory=dict)
    checks: tuple[Check, ...] = ()

    @property
    def key(self) -> str:
        return self.columns[0].name

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, True) for c in self.columns])

    def column(self, name: str) -> Col:
        return next(c for c in self.columns if c.name == name)


def _key(name: str) -> Col:
    return Col(name, T.LongType())


def _ref(name: str, required: bool = True) -> Col:
    return Col(name, T.LongType(), required)


def _text(name: str, length: int | None, required: bool = True, default: object = NO_DEFAULT) -> Col:
    return Col(name, T.StringType(), required, length, default)


def _date(name: str, required: bool = False, default: object = NO_DEFAULT) -> Col:
    return Col(name, T.DateType(), required, None, default)


def _flag(name: str, default: bool) -> Col:
    return Col(name, T.BooleanType(), True, None, default)


# Declared parents first; reading it backwards is the order for deletes.
TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table(
            "country",
            (
                _key("country_id"),
                _text("country_code", 2),
                _text("country_name", 100),
                _text("region_name", 100, required=False),
            ),
            unique=("country_code",),
        ),
        Table(
            "legal_form",
            (
                _key("legal_form_id"),
                _ref("country_id"),
                _text("legal_form_code", 20),
                _text("legal_form_name", 100),
            ),
            foreign={"country_id": "country"},
        ),
        Table(
            "company",
            (
                _key("company_id"),
                _ref("legal_form_id"),
                _text("company_name", 200),
                _text("registration_number", 50, required=False),
                _date("foundation_date"),
                _text("industry_code", 20, required=False),
                Col("employee_count", T.IntegerType(), False, None, 0),
                Col("annual_revenue", T.DecimalType(18, 2), False, None, 0),
                _date("registration_date", required=True, default=TODAY),
            ),
            foreign={"legal_form_id": "legal_form"},
            checks=(Check("employee_count", low=0), Check("annual_revenue", low=0)),
        ),
        Table(
            "company_address",
            (
                _key("company_address_id"),
                _ref("company_id"),
                _ref("country_id"),
                _text("address_type", 20, default="Registered"),
                _text("street_address", 255, required=False),
                _text("postal_code", 20, required=False),
                _text("city", 100, required=False),
                _flag("is_primary", False),
            ),
            foreign={"company_id": "company", "country_id": "country"},
            checks=(Check("address_type", allowed=ADDRESS_TYPES),),
        ),
        Table(
            "ubo",
            (
                _key("ubo_id"),
                _text("first_name", 100),
                _text("last_name", 100),
                _date("date_of_birth"),
                _text("nationality", 2, required=False),
                _text("passport_no", 50, required=False),
            ),
            unique=("passport_no",),
        ),
        Table(
            "ownership",
            (
                _key("ownership_id"),
                _ref("company_id"),
                _ref("ubo_id"),
                Col("ownership_percentage", T.DecimalType(5, 2), True, None, 0),
                _flag("is_ownership_direct", True),
                _date("valid_from"),
                _date("valid_to"),
            ),
            foreign={"company_id": "company", "ubo_id": "ubo"},
            checks=(Check("ownership_percentage", low=0, high=100),),
        ),
        Table(
            "document_type",
            (
                _key("document_type_id"),
                _text("document_type_name", 100),
                _text("document_scope", 20, default="Company"),
            ),
            checks=(Check("document_scope", allowed=DOCUMENT_SCOPES),),
        ),
        Table(
            "required_documents",
            (
                _key("required_document_id"),
                _ref("legal_form_id"),
                _ref("document_type_id"),
                _text("requirement_level", 50, required=False, default="Standard"),
                _flag("applies_to_ubo", False),
                _flag("is_mandatory", True),
            ),
            foreign={"legal_form_id": "legal_form", "document_type_id": "document_type"},
        ),
        Table(
            "onboarding_case",
            (
                _key("case_id"),
                _ref("company_id"),
                _date("case_open_date", required=True, default=TODAY),
                _text("case_status", 50, default="Open"),
            ),
            foreign={"company_id": "company"},
            checks=(Check("case_status", allowed=CASE_STATUSES),),
        ),
        Table(
            "submitted_documents",
            (
                _key("submitted_document_id"),
                _ref("case_id"),
                _ref("ubo_id", required=False),
                _ref("document_type_id"),
                _date("submission_date", required=True, default=TODAY),
                _text("document_status", 50, default="Pending"),
                _date("verification_date"),
            ),
            foreign={
                "case_id": "onboarding_case",
                "ubo_id": "ubo",
                "document_type_id": "document_type",
            },
            checks=(Check("document_status", allowed=DOCUMENT_STATUSES),),
        ),
        Table(
            "external_source",
            (
                _key("external_source_id"),
                _text("source_name", 100),
                _text("source_country", 2, required=False),
                _text("source_type", 50, required=False),
            ),
        ),
        Table(
            "external_verification_check",
            (
                _key("external_check_id"),
                _ref("case_id"),
                _ref("external_source_id"),
                _date("check_date", required=True, default=TODAY),
                _text("check_status", 50, default="Pending"),
                _text("result_summary", None, required=False),
            ),
            foreign={"case_id": "onboarding_case", "external_source_id": "external_source"},
            checks=(Check("check_status", allowed=CHECK_STATUSES),),
        ),
    )
}
