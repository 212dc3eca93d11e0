"""Explicit schemas of stored tables and of records on their way in."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "decimal(10,2)": T.DecimalType(10, 2),
}


def struct(fields: str) -> T.StructType:
    """A schema from "name type, name type"; unlike fromDDL it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in fields.split(", "))])


#: What every parser yields; `ord` carries the order of ingestion, which DataFrames have not.
SCRAPED = struct(
    "name string, description string, capacity_mw double, developer string, location string, country string, status string, "
    "source_url string, source_name string, announced_date date, contact_name string, contact_email string, contact_phone string, ord long"
)
PROJECTS = struct(
    "id int, name string, description string, capacity_mw decimal(10,2), developer string, epc string, location string, "
    "country string, status string, source_url string, source_name string, contact_name string, contact_email string, "
    "contact_phone string, announced_date date, created_at timestamp, updated_at timestamp, scan_id int"
)
SCANS = struct("id int, status string, started_at timestamp, completed_at timestamp, sources_scanned int, projects_found int, new_projects int, error_message string")
SCAN_PROJECTS = struct("id int, scan_id int, project_id int, project_name string, is_new boolean, created_at timestamp")
CONTACTS = struct("id int, first_name string, middle_name string, last_name string, organization_name string, organization_title string, email1 string, email2 string, created_at timestamp")
REFERRALS = struct(
    "id int, epbc_number string, project_name string, proponent string, industry_type string, project_status string, "
    "decision_status string, state string, location string, technology_type string, size_mw double, referral_date string, "
    "approval_date string, source_url string, raw_description string, is_renewable boolean, is_solar boolean, is_approved boolean, "
    "relevance_status string, scraped_at timestamp_ntz, updated_at timestamp_ntz"
)
EMBEDDED_PROJECTS = T.ArrayType(
    struct(
        "id string, energy_id int, type string, project_name string, country string, capacity string, description string, developer string, "
        "owner string, location string, state string, status string, contact_name string, contact_phone string, contact_email string, updated_at string"
    )
)
#: Records of an encoded snapshot; a capacity may be a number or a text.
SNAPSHOT_PROJECTS = T.ArrayType(struct("name string, category string, type string, subtype string, status string, capacity string, capacityRaw string, location string, state string, owner string"))
PORTAL_REFERRAL = struct(
    "referralNumber string, epbcNumber string, projectTitle string, title string, projectName string, proposer string, proponent string, "
    "projectStatus string, referralStatus string, decisionStatus string, primaryJurisdiction string, state string, location string, "
    "industryType string, description string, referralDate string, approvalDate string, decisionDate string, url string"
)
PORTAL_PAGE = T.StructType([T.StructField(k, T.ArrayType(PORTAL_REFERRAL)) for k in ("content", "results", "items", "referrals")])
