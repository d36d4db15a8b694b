"""Who has access: principals with their login and role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import collated, text_in

# Principal types listed, names left out, and the mark for "none".
LISTED_TYPES = ("S", "U", "R")
SYSTEM_NAMES = (
    "dbo",
    "guest",
    "INFORMATION_SCHEMA",
    "sys",
    "db_owner",
    "db_accessadmin",
    "db_securityadmin",
    "db_ddladmin",
    "db_backupoperator",
    "db_datareader",
    "db_datawriter",
    "db_denydatareader",
    "db_denydatawriter",
    "public",
)
NONE = "-"


def access_roster(principals: DataFrame, logins: DataFrame, role_members: DataFrame) -> DataFrame:
    """Columns: principal, type_desc, login, member_of_role; sorted by type and name.

    principals(name, type, type_desc, sid, principal_id), logins(sid, name),
    role_members(member_principal_id, role_principal_id).
    """
    member = principals.select(
        F.col("principal_id").alias("member_principal_id"), F.col("name").alias("member_name")
    )
    role = principals.select(
        F.col("principal_id").alias("role_principal_id"), F.col("name").alias("role_name")
    )
    roles = (
        role_members.join(member, "member_principal_id")
        .join(role, "role_principal_id")
        .select(collated(F.col("member_name")).alias("_member"), "role_name")
    )
    login = logins.select("sid", F.col("name").alias("login_name"))
    listed = principals.filter(
        text_in(F.col("type"), LISTED_TYPES) & ~text_in(F.col("name"), SYSTEM_NAMES)
    )
    return (
        listed.join(login, "sid", "left")
        .join(roles, collated(F.col("name")) == F.col("_member"), "left")
        .select(
            F.col("name").alias("principal"),
            "type_desc",
            F.coalesce("login_name", F.lit(NONE)).alias("login"),
            F.coalesce("role_name", F.lit(NONE)).alias("member_of_role"),
        )
        .orderBy(collated(F.col("type_desc")), collated(F.col("principal")))
    )
