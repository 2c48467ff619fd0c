"""The nine extracted fields, in the order that reports follow."""

from __future__ import annotations

FIELDS = (
    "borrowers",
    "loan_amount",
    "recording_date",
    "recording_location",
    "lender_name",
    "lender_nmls_id",
    "broker_name",
    "loan_originator_name",
    "loan_originator_nmls_id",
)
REQUIRED = ("borrowers", "loan_amount", "lender_name")
OPTIONAL = "broker_name"
