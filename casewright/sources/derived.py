"""The onboarding tables derived from the trade tables of the test data.

Customers act as companies, suppliers as beneficial owners, orders as cases,
order lines as documents and holdings, events as requests and checks, chat
turns as an unchecked address feed. Each derivation reads its tables whole;
`plans/oracle.py` states the same rules in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the test data: market segments, the number of document types, and the first personal one.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
TYPES = 7
FIRST_UBO_TYPE = 5
READ_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _map(col: Column, pairs: dict[str, str], otherwise: str | None = None) -> Column:
    out = None
    for key, value in pairs.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(F.lit(otherwise))


def _text(col: Column) -> Column:
    return col.cast("string")


class Derived(Mapping[str, DataFrame]):
    """The twelve tables plus the request feeds, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}

    NAMES = (
        "country",
        "legal_form",
        "company",
        "company_address",
        "ubo",
        "ownership",
        "document_type",
        "required_documents",
        "onboarding_case",
        "submitted_documents",
        "external_source",
        "external_verification_check",
        "submit_requests",
        "status_requests",
        "workflow_requests",
        "timed_requests",
    )

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        if name not in self._built:
            self._built[name] = getattr(self, name)()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(READ_SCHEMAS[name]).parquet(f"{self.dir}/{name}.parquet")

    def country(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").cast("bigint").alias("country_id"),
            F.lpad(_text(F.col("n_nationkey")), 2, "0").alias("country_code"),
            F.col("n_name").alias("country_name"),
            F.col("r_name").alias("region_name"),
        )

    def legal_form(self) -> DataFrame:
        nation = self.raw("nation").select(
            "n_nationkey", "n_name", F.posexplode(F.array(*map(F.lit, SEGMENTS))).alias("seg", "segment")
        )
        return nation.select(
            (F.col("n_nationkey").cast("bigint") * 5 + F.col("seg")).alias("legal_form_id"),
            F.col("n_nationkey").cast("bigint").alias("country_id"),
            F.col("segment").alias("legal_form_code"),
            F.concat("n_name", F.lit(" "), "segment").alias("legal_form_name"),
        )

    def company(self) -> DataFrame:
        segment = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")) - 1
        return self.raw("customer").select(
            F.col("c_custkey").alias("company_id"),
            (F.col("c_nationkey").cast("bigint") * 5 + segment).alias("legal_form_id"),
            F.col("c_name").alias("company_name"),
            F.concat(F.lit("HR-"), _text(F.col("c_custkey"))).alias("registration_number"),
            F.lit(None).cast("date").alias("foundation_date"),
            F.col("c_mktsegment").alias("industry_code"),
            F.floor(F.col("c_acctbal") / 10).cast("int").alias("employee_count"),
            F.col("c_acctbal").cast("decimal(18,2)").alias("annual_revenue"),
            F.to_date(F.lit("1995-01-01")).alias("registration_date"),
        )

    def company_address(self) -> DataFrame:
        return self.raw("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("company_address_id"),
            F.col("conv_id").alias("company_id"),
            F.col("turn").alias("country_id"),
            _map(F.col("role"), {"user": "Registered", "assistant": "physical"}, "system").alias("address_type"),
            F.col("text").alias("street_address"),
            F.lit(None).cast("string").alias("postal_code"),
            F.lit(None).cast("string").alias("city"),
            (F.col("turn") == 0).alias("is_primary"),
        )

    def ubo(self) -> DataFrame:
        passport = F.concat(
            F.when(F.col("s_nationkey") < 12, "P-").otherwise("p-"),
            _text(F.floor(F.col("s_acctbal") / 100).cast("bigint")),
        )
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("ubo_id"),
            F.lit("Supplier").alias("first_name"),
            F.substring_index("s_name", "#", -1).alias("last_name"),
            F.lit(None).cast("date").alias("date_of_birth"),
            F.lpad(_text(F.col("s_nationkey")), 2, "0").alias("nationality"),
            F.when(F.col("s_acctbal") >= 0, passport).alias("passport_no"),
        )

    def ownership(self) -> DataFrame:
        """Every order line is a holding; customers without orders have no owners."""
        line = self.raw("lineitem").select(
            "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag", "l_shipdate"
        )
        order = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return line.join(order, line.l_orderkey == order.o_orderkey).select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ownership_id"),
            F.col("o_custkey").alias("company_id"),
            F.col("l_suppkey").alias("ubo_id"),
            (F.col("l_quantity") * 2).cast("decimal(5,2)").alias("ownership_percentage"),
            (F.col("l_linestatus") == "O").alias("is_ownership_direct"),
            F.to_date("o_orderdate").alias("valid_from"),
            F.when(F.col("l_returnflag") == "R", F.to_date("l_shipdate")).alias("valid_to"),
        )

    def document_type(self) -> DataFrame:
        """Parts fall into types by their key; a type is called after the first name among them."""
        kind = F.col("p_partkey") % TYPES + 1
        names = self.raw("part").groupBy(kind.alias("document_type_id")).agg(F.min("p_name").alias("name"))
        return names.select(
            "document_type_id",
            F.col("name").alias("document_type_name"),
            F.when(F.col("document_type_id") >= FIRST_UBO_TYPE, "UBO").otherwise("Company").alias("document_scope"),
        )

    def required_documents(self) -> DataFrame:
        """Every legal form has rules, except those whose segment is MACHINERY."""
        types = F.explode(F.sequence(F.lit(1), F.lit(TYPES))).alias("type")
        rules = (
            self.legal_form()
            .filter(F.col("legal_form_code") != "MACHINERY")
            .select("legal_form_id", types)
        )
        kind = F.col("type").cast("bigint")
        return rules.select(
            (F.col("legal_form_id") * 10 + kind).alias("required_document_id"),
            "legal_form_id",
            kind.alias("document_type_id"),
            F.when(kind == 3, "Enhanced").otherwise("Standard").alias("requirement_level"),
            (kind >= FIRST_UBO_TYPE).alias("applies_to_ubo"),
            ((F.col("legal_form_id") + kind) % 3 != 0).alias("is_mandatory"),
        )

    def onboarding_case(self) -> DataFrame:
        decided = _map(
            F.col("o_orderpriority"),
            {"1-URGENT": "Approved", "2-HIGH": "Approved", "3-MEDIUM": "Rejected"},
            "Closed",
        )
        status = (
            F.when(F.col("o_orderstatus") == "O", "Open")
            .when(F.col("o_orderstatus") == "P", "InReview")
            .otherwise(decided)
        )
        return self.raw("orders").select(
            F.col("o_orderkey").alias("case_id"),
            F.col("o_custkey").alias("company_id"),
            F.to_date("o_orderdate").alias("case_open_date"),
            status.alias("case_status"),
        )

    def submitted_documents(self) -> DataFrame:
        """Order lines repeat (order, line), so some document ids repeat as well."""
        kind = F.col("l_partkey") % TYPES + 1
        status = _map(F.col("l_returnflag"), {"N": "Pending", "A": "Verified"}, "Rejected")
        return self.raw("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("submitted_document_id"),
            F.col("l_orderkey").alias("case_id"),
            F.when((kind >= FIRST_UBO_TYPE) & (F.col("l_linenumber") != 7), F.col("l_suppkey")).alias("ubo_id"),
            kind.alias("document_type_id"),
            F.to_date("l_shipdate").alias("submission_date"),
            status.alias("document_status"),
            F.when(F.col("l_returnflag") != "N", F.to_date("l_shipdate")).alias("verification_date"),
        )

    def external_source(self) -> DataFrame:
        """Each region is a source, in the country of its first nation; checks also name sources past the last."""
        nation, region = self.raw("nation"), self.raw("region")
        first = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
        return region.join(first, region["r_regionkey"] == first["n_regionkey"], "left").select(
            (F.col("r_regionkey").cast("bigint") + 1).alias("external_source_id"),
            F.col("r_name").alias("source_name"),
            F.lpad(_text(F.col("first")), 2, "0").alias("source_country"),
            F.when(F.col("r_regionkey") == 0, "Internal").otherwise("Registry").alias("source_type"),
        )

    def external_verification_check(self) -> DataFrame:
        """Checks arrive for every second case id and run past the last case."""
        status = _map(
            F.col("event_type"),
            {"purchase": "Passed", "error": "Failed", "signup": "Manual", "view": "Pending"},
        )
        return self.raw("events").select(
            F.col("event_id").alias("external_check_id"),
            (F.col("event_id") * 2).alias("case_id"),
            (F.floor(_prop() / 16) + 1).alias("external_source_id"),
            F.to_date("ts").alias("check_date"),
            status.alias("check_status"),
            F.col("props").alias("result_summary"),
        )

    def submit_requests(self) -> DataFrame:
        case = F.when(_prop() == 1, F.lit(-1)).when(_prop() > 1, _event_case())
        return self.raw("events").select(
            F.col("event_id").alias("request_id"),
            case.cast("bigint").alias("case_id"),
            F.when(_prop() != 2, F.floor("value") % 9).cast("bigint").alias("document_type_id"),
            F.when(F.col("event_type").isin("click", "error"), F.floor("value")).cast("bigint").alias("ubo_id"),
        )

    def status_requests(self) -> DataFrame:
        target = _map(
            F.col("event_type"),
            {
                "signup": "InReview",
                "purchase": "approved ",
                "error": "REJECTED",
                "view": "Closed",
                "click": "Open",
            },
        )
        return self.raw("events").select(
            F.col("event_id").alias("request_id"),
            F.when(_prop() == 1, F.lit(-1)).otherwise(_event_case()).cast("bigint").alias("case_id"),
            F.when(_prop() > 0, target).alias("new_status"),
        )

    def workflow_requests(self) -> DataFrame:
        """Every event submits a document, and right after that asks for a status."""
        submit = self["submit_requests"].select(
            (F.col("request_id") * 2).alias("request_id"),
            F.lit("submit").alias("kind"),
            "case_id",
            "document_type_id",
            "ubo_id",
        )
        status = self["status_requests"].select(
            (F.col("request_id") * 2 + 1).alias("request_id"),
            F.lit("status").alias("kind"),
            "case_id",
            "new_status",
        )
        return submit.unionByName(status, allowMissingColumns=True)

    def timed_requests(self) -> DataFrame:
        """Requests arrive at the time of their event, a status request a millisecond later.

        They were made as many hours before as the event's value says.
        """
        event = F.floor(F.col("request_id") / 2)
        clock = self.raw("events").select(
            F.col("event_id").alias("_event"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("_arrived"),
            (F.floor(F.col("value") * 100) * 36_000).alias("_ago"),
        )
        arrived = F.col("_arrived") + F.col("request_id") % 2
        requests = self["workflow_requests"]
        return requests.join(clock, event == F.col("_event")).select(
            *requests.columns,
            F.timestamp_millis(arrived - F.col("_ago")).alias("requested_at"),
            F.timestamp_millis(arrived).alias("received_at"),
        )


def _prop() -> Column:
    """The number inside the small JSON text of an event, 0 to 99."""
    return F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")


def _event_case() -> Column:
    return F.col("user_id") * 4 + F.col("event_id") % 4
