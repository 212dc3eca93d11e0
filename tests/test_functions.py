"""Golden cases of the column functions."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from sunledger.functions import text as X
from sunledger.sources import parsers

S = F.lit


def cases():
    NULL = F.lit(None).cast("string")

    def kind(name):
        return X.technology(S(name), NULL)

    return [
    (X.capacity(S("a 1.2GW hub")), 1200.0), (X.capacity(S("1,200 MW")), 200.0), (X.capacity(S("400 MWh battery")), 400.0),
    (X.capacity(S("no figure")), None), (X.capacity(NULL), None), (X.capacity(S("200 MW")), 200.0),
    (X.megawatts(S("1,200 MW")), 1200.0), (X.megawatts(S("1.2 GW")), None), (X.megawatts(S("")), None),
    (X.location(S("Victoria and NSW")), "NSW"), (X.location(S("USA grid")), "SA"), (X.location(NULL), None), (X.location(S("near Otago"), "NZ"), "Otago"),
    (X.status(S("resource consent lodged")), "under_development"), (X.status(S("x")), "announced"),
    (X.is_early_stage(S("proposed; now generating")), False), (X.is_early_stage(S("seismic")), True),
    (X.is_wind(S("Tailwind Hub")), True), (X.is_wind(S("Windy Hill Solar Farm")), False), (X.is_wind(S("Hill"), S("a turbine")), True),
    (X.has_solar_component(S("PV plant")), True), (X.has_solar_component(S("PVC plant")), False), (X.has_solar_component(S("ésolar farm")), True),
    (X.is_noisy_name(S("Faq")), True), (X.is_noisy_name(S("Our solar farm")), True), (X.is_noisy_name(S("Sunny Plains")), False),
    (X.is_noisy_name(S("Sunny Plains"), True), True), (X.is_noisy_name(NULL), True),
    (kind("X Solar Farm and battery")["technology_type"], "Solar + BESS"), (kind("Big wind project")["technology_type"], "Renewable (unclassified)"),
    (kind("Big wind project")["relevance_status"], "needs_review"), (kind("Grain storage")["technology_type"], "BESS"), (kind("Grain storage")["is_renewable"], False),
    (X.is_approved(S("Not Approved"), NULL), True), (X.is_approved(S("Not Approved"), NULL, strict=True), False), (X.is_approved(S("Withdrawn"), NULL), False),
    (X.serial_date(S(45366)), datetime.date(2024, 3, 15)), (X.referral_date(S("45366")), datetime.date(2024, 3, 15)),
    (X.referral_date(S("15/03/2024")), None), (X.referral_date(S("05/03/2024")), datetime.date(2024, 5, 3)), (X.long_date(S("2026-June-12")), datetime.date(2026, 6, 12)),
    (X.email_related(S("a@contactenergy.example"), S("Contact Energy")), True), (X.email_related(S("a@yec.example"), S("Yindjibarndi Energy Corporation")), True),
    (X.email_related(S("a@x.example"), NULL), False), (X.valid_project_contact(S("info@acme.example"), S("Acme")), False),
    (X.valid_project_contact(S("jo@acme.example"), S("Acme")), True), (X.valid_project_contact(S("jo@notgov.au"), S("Notgov")), False),
    (X.csv_field(S('a,"b"')), '"a,""b"""'), (X.csv_field(S("a\rb")), "a\rb"), (X.csv_field(NULL), ""),
    (X.contact_key(S("Acme Solar Pty Ltd")), "acme"), (X.company_key(S("Acme Group Pty Ltd")), "acme"),
    (X.title_score(S("Head of Projects")), 9), (X.title_score(S("Deputy CEO")), 1), (X.person_name(S("Solar Farm by Jane Doe")), "Jane Doe"),
    (X.developer(S("built by Alpha Energy; x")), "Alpha Energy"), (X.url_component(S("a b!(c)")), "a%20b!(c)"),
    (X.host(S("https://www.a.example/x")), "a.example"), (X.developer_domain(S("https://afr.com/x")), None), (X.is_rate_limited(S("HTTP 429")), True),
    (X.json_array(S("```json\n[1, [2]]\n```")), "[1, [2]]"), (parsers.only_statistics(S("solar, 900 MW installed nationwide")), True),
    (parsers.only_statistics(S("solar, 900 MW installed nationwide. " + "x" * 100 + " Farm 5 MW")), False),
    ]


def test_golden(spark):
    some = cases()
    got = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(some))).first()
    wrong = [(i, str(c), got[i], expected) for i, (c, expected) in enumerate(some) if got[i] != expected]
    assert not wrong
