"""Operators against plain simulations and small golden tables."""

from __future__ import annotations

import base64
import datetime
import json
import random

from pyspark.sql import functions as F

from sunledger.operators import contacts, dedup, directory, enrichment, referrals, runs, sinks
from sunledger.sources import parsers

DAY = datetime.date(2024, 1, 1)


def simulate(rows, stored, lo, hi):
    known = {u: ("stored", d) for u, d in stored.items()}
    out = []
    for url, ord_, ok, date in rows:
        state = known.get(url) if url else None
        if not ok:
            if url:
                known[url] = ("barred", state[1] if state else None)
            out.append((ord_, False))
            continue
        eff = stored.get(url, date) if url else date
        if not lo <= eff <= hi:
            out.append((ord_, False))
            continue
        out.append((ord_, True, state[0] if state else "new"))
        if url and not state:
            known[url] = ("created", None)
    return out


def test_scan_dedup_matches_one_after_another(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", "d", "", None]), i, rng.random() < 0.8, DAY + datetime.timedelta(rng.randrange(10))) for i in range(300)]
    stored = {"b": DAY + datetime.timedelta(3), "d": DAY + datetime.timedelta(30)}
    lo, hi = DAY + datetime.timedelta(2), DAY + datetime.timedelta(7)
    df = spark.createDataFrame(rows, "source_url string, ord long, gate_ok boolean, announced_date date").repartition(7)
    st = spark.createDataFrame([(u, i, d) for i, (u, d) in enumerate(stored.items())], "source_url string, stored_id long, stored_date date")
    got = {r["ord"]: r for r in dedup.scan_dedup(df, st, F.lit(lo), F.lit(hi)).collect()}
    for x in simulate(rows, stored, lo, hi):
        assert got[x[0]]["passes"] == x[1]
        if x[1]:
            assert got[x[0]]["project_ref"] == x[2], x


def test_scan_dedup_empty(spark):
    none = spark.createDataFrame([], "source_url string, ord long, gate_ok boolean, announced_date date")
    assert dedup.scan_dedup(none, None).count() == 0
    assert dedup.scan_counters(dedup.scan_dedup(none, None)).first().asDict() == {"projects_found": 0, "new_projects": 0}


def test_directory_counts_commute(spark):
    rows = [(i, "Solar" if i % 3 else "Windy wind", float(i % 9), "AU" if i % 2 else "NZ", "announced", DAY, 1, None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, name string, capacity_mw double, country string, status string, announced_date date, scan_id int, contact_email string")
    df = df.withColumns({"developer": F.lit(None).cast("string"), "location": F.lit("x%y"), "epc": F.lit("\\q")})
    query = directory.DirectoryQuery(search="%")
    assert directory.directory_list(df, query).count() == directory.directory_stats(df, query, DAY).first()["total"]
    assert directory.directory_list(df, directory.DirectoryQuery(search="\\q")).count() == directory.directory_list(df, directory.DirectoryQuery()).count()
    assert directory.directory_list(df, directory.DirectoryQuery(has_contact="false")).count() == 0
    assert directory.directory_stats(df.limit(0), query, DAY).first()["total"] == 0


def test_upsert_twice_is_once(spark):
    stored = spark.createDataFrame([("1", "old", "manual")], "k string, status string, relevance string")
    came = spark.createDataFrame([("1", "new", "auto", 1), ("2", "a", "auto", 2), ("2", "b", "late", 3)], "k string, status string, relevance string, ord int")
    once = referrals.upsert(stored, came, "k", ("status",), ["ord"])
    assert {tuple(r) for r in once.collect()} == {("1", "new", "manual", "updated"), ("2", "b", "auto", "inserted")}
    twice = referrals.upsert(once.drop("action"), came, "k", ("status",), ["ord"])
    assert {tuple(r)[:3] for r in twice.collect()} == {tuple(r)[:3] for r in once.collect()}


def test_contact_scores(spark):
    devs = spark.createDataFrame([("Acme Solar Pty Ltd",), ("Alpha Beta",), ("Alpha Beta Delta",), ("Power",), (None,)], "developer string")
    orgs = spark.createDataFrame(
        [(1, "ACME Group", "Jo", None, "a@x"), (2, "Beta Gamma", "", "", "b@x"), (3, "Beta Alpha Gamma", None, None, "c@x"), (4, "ACME", "No", "One", "d@x"), (5, "Alpha", "x", "y", None)],
        "ord int, organization_name string, first_name string, last_name string, email1 string",
    )
    got = {r["developer"]: (r["contact_name"], r["contact_email"], r["score"]) for r in contacts.match_contacts(devs, orgs).collect()}
    assert got["Acme Solar Pty Ltd"] == ("Jo", "a@x", 100.0)
    assert got["Alpha Beta Delta"] == ("Beta Alpha Gamma", "c@x", 40.0)
    assert set(got) == {"Acme Solar Pty Ltd", "Alpha Beta Delta", "Alpha Beta"}  # 2 of 3 words: 40


def test_enrichment_groups(spark):
    rows = [(7, None, None, "https://afr.com/a", None), (8, " Acme ", None, "https://www.acme.example/x", ""), (9, "acme", "a@b.example", None, "Jo")]
    df = spark.createDataFrame(rows, "id int, developer string, contact_email string, source_url string, contact_name string")
    got = {r["group_key"]: r for r in enrichment.enrichment_summary(df).collect()}
    assert set(got) == {"id:7", "acme"}
    members = sorted((r["group_key"], r["pos"], r["id"]) for r in enrichment.enrichment_members(df).collect())
    assert members == [("acme", 1, 8), ("acme", 2, 9), ("id:7", 1, 7)] and got["acme"]["domain"] == "acme.example" and got["acme"]["existing_name"] == "Jo"


def test_enrichment_summary_gathers_no_groups(spark):
    rows = [(i, f"dev{i % 3}" if i % 5 else "", f"a@h{i}.example" if i > 20 else None, None, f"n{i}" if i > 30 else "") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, developer string, contact_email string, source_url string, contact_name string").repartition(5)
    got = enrichment.enrichment_summary(df)
    want, groups = set(), {}
    for i, developer, email, _, name in rows:
        groups.setdefault(developer or f"id:{i}", []).append((i, email, name))
    for key, some in groups.items():
        want.add((key, len(some), some[0][0], next((e.split("@")[1] for _, e, _ in some if e), None), next((n for _, _, n in some if n), None)))
    assert {tuple(r) for r in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_scan_projects_fallback(spark):
    projects = spark.createDataFrame([(1, 5.0, 1), (2, 0.0, 1), (3, 9.0, 2)], "id int, capacity_mw double, scan_id int")
    relations = spark.createDataFrame([(1, 1, 1, True), (2, 1, 1, False), (3, 1, 2, True)], "id int, scan_id int, project_id int, is_new boolean")
    assert [tuple(r) for r in runs.scan_projects(relations, projects, 1).collect()] == [(1, 5.0, 1, False)]
    assert [tuple(r) for r in runs.scan_projects(relations, projects, 2).collect()] == [(3, 9.0, 2, True)]


def test_sinks(spark):
    stored = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "id int, x string, y string")
    changes = spark.createDataFrame([(2, None, "z")], "id int, x string, y string")
    assert {tuple(r) for r in sinks.update_by_key(stored, changes, "id", ("x", "y")).collect()} == {(1, "a", "b"), (2, "c", "z")}
    assert [r["id"] for r in sinks.delete_by_key(stored, changes, "id").collect()] == [1]


def test_blank_cells_move_left(spark):
    page = spark.createDataFrame([("s", "u", 1, "| Project | Capacity |\n|---|---|\n| Acme |  | 50 MW solar |\n")], "source string, url string, ord long, content string")
    row = parsers.markdown_tables(page).first()
    assert (row["name"], row["capacity_mw"]) == ("Acme", 50.0)


BAD_ROWS = [("Alpha Plains", "50 MW", "proposed"), ("Alpha Solar Farm", "50 MW", "commissioned"), ("Beta Solar Farm", "tba", "x"), ("PV 1", "9 MW", "solar"), ("Our solar farm", "9 MW", "x"), ("Gamma Solarium", "9 MW", "x")]


def test_listed_rows_pass_the_gates(spark):
    """Of tables, bullets and captured lists only rows through every gate and the window are projects."""
    good, today = ("Delta Solar Farm", "50 MW", "2024-01-05"), F.lit(DAY)
    rows = [*BAD_ROWS, good]
    table = "| Site | Size | Note |\n|---|---|---|\n" + "".join(f"| {' | '.join(r)} |\n" for r in rows)
    pages = spark.createDataFrame([("s", "u", 1, table + "\n" + "".join(f"* {' – '.join(r)}\n" for r in rows))], "source string, url string, ord long, content string")
    docs = spark.createDataFrame([(1, "u", {"l": [dict(zip(("name", "size", "note"), r, strict=True)) for r in rows]})], "ord long, url string, lists map<string,array<map<string,string>>>")
    found = parsers.table_projects(pages, today)
    for df in (found, parsers.bullet_projects(pages, today), parsers.captured_projects(docs, today)):
        assert [(r["name"], r["capacity_mw"], str(r["announced_date"])) for r in df.collect()] == [("Delta Solar Farm", 50.0, "2024-01-05")]
    assert parsers.bullet_projects(pages, today, captured=found).count() == 0
    late = F.lit(DAY + datetime.timedelta(9))
    assert parsers.table_projects(pages, today, late).count() == parsers.bullet_projects(pages, today, late).count() == parsers.captured_projects(docs, today, late).count() == 0


def test_embedded_and_snapshot_projects(spark):
    """Only early records inside the window; of a snapshot only energy, four statuses, 5 MW, solar, the first of a name."""
    record = {"energy_id": 1, "project_name": "A", "type": "In Development", "status": "", "country": "NZ", "capacity": "50", "updated_at": "2024-01-05 01:00:00"}
    records = [record, record | {"type": "Operating"}, record | {"project_name": "B", "type": "x", "status": "Planning", "updated_at": "2023-01-01 00:00:00"}]
    pages = spark.createDataFrame([("s", "u", 1, f"<script>var project = {json.dumps(records)};\nvar x</script>")], "source string, url string, ord long, content string")
    assert [(r["name"], r["country"], r["status"]) for r in parsers.embedded_projects(pages).collect()] == [("A", "NZ", "under_development"), ("B", "NZ", "announced")]
    assert [r["name"] for r in parsers.embedded_projects(pages, F.lit(DAY), F.lit(DAY)).collect()] == ["A"]
    good = {"name": " Alpha Solar ", "category": "Energy", "type": "Solar", "subtype": "BESS", "status": "Proposed", "capacity": 50, "location": "Dubbo", "state": "NSW"}
    bad = ({"category": "Water"}, {"status": "Operating"}, {"capacity": 4}, {"capacity": None}, {"type": "Hydro", "subtype": "", "name": "Dam"}, {"name": "Solar Wind"}, {"name": ""})
    items = [*(good | x for x in bad), good, good | {"name": "ALPHA SOLAR"}, good | {"name": "Beta PV", "status": "Committed (FID)", "capacity": "7.5"}]
    coded = base64.b64encode(bytes(c ^ b"k3y"[i % 3] for i, c in enumerate(json.dumps(items).encode()))).decode()
    pages = spark.createDataFrame([("s", "u", 1, coded)], "source string, url string, ord long, content string")
    got = [(r["name"], r["capacity_mw"], r["status"], r["source_url"], r["description"]) for r in parsers.snapshot_projects(pages, b"k3y", F.lit(DAY)).orderBy("pos").collect()]
    assert got == [("Alpha Solar", 50.0, "announced", "u#alpha%20solar", "Solar — BESS · Proposed · Dubbo, NSW · 50 MW"), ("Beta PV", 7.5, "under_development", "u#beta%20pv", "Solar — BESS · Committed (FID) · Dubbo, NSW · 7.5 MW")]
    assert parsers.snapshot_projects(pages, b"k3y", F.lit(DAY), F.lit(DAY + datetime.timedelta(1))).count() == 0


def test_page_limit(spark):
    pages = spark.createDataFrame([("p", i, n) for i, n in enumerate((200, 200, 13, 200))], "source string, page int, items int")
    assert sorted(r["page"] for r in parsers.page_limit(pages, 200).collect()) == [0, 1, 2]


def test_portal(spark):
    from sunledger import schemas

    page = '{"results": [{"referralNumber": "2024/1", "epbcNumber": "x", "title": "A Solar Farm 1,200 MW", "industryType": "Energy"}, {"referralNumber": "", "epbcNumber": "2", "title": "B"}]}'
    pages = spark.createDataFrame([(1, page)], "ord long, raw string").withColumn("page", F.from_json("raw", schemas.PORTAL_PAGE))
    rows = referrals.normalise(referrals.portal_records(pages), "https://r.example/").collect()
    assert len(rows) == 1 and rows[0]["size_mw"] == 1200.0 and rows[0]["source_url"] == "https://r.example/2024-1" and rows[0]["is_solar"]


def test_orders_of_lists(spark):
    rows = [("b", "2024-02-01"), ("c", None), ("a", "2024-01-01"), ("d", "2024-01-01")]
    df = spark.createDataFrame(rows, "epbc_number string, referral_date string").withColumns({c: F.lit("x") for c in ("project_name", "proponent", "state")})
    assert [r["epbc_number"] for r in referrals.referral_list(df, referrals.ReferralQuery()).collect()] == ["a", "d", "b", "c"]
    scans = spark.createDataFrame([(1, 10), (2, 30), (3, 20), (4, 30)], "id int, started_at int")
    assert [r["id"] for r in runs.newest_first(scans).collect()] == [4, 2, 3, 1]
    found = spark.createDataFrame([(1, False), (2, True), (3, False), (4, True)], "ord int, is_new boolean")
    assert [r["ord"] for r in runs.new_first(found, "ord").collect()] == [2, 4, 1, 3]


def test_year_bands():
    assert referrals.year_bands(2018, 2020) == ["2018", "2019", "2020"] and referrals.year_bands(2021, 2020) == ["all years"]


def test_contact_file(spark, tmp_path):
    path = tmp_path / "contacts.csv"
    path.write_text('First Name,Organization Name,E-mail 1 - Value,E-mail 2 - Value\nJo,"Acme, ""Sun""",jo@x.example,\nNo,None,,\n,"Two\nlines",,b@x.example\n')
    rows = contacts.contact_rows(contacts.read_contacts(spark, str(path))).collect()
    assert [(r["first_name"], r["organization_name"], r["email1"], r["email2"]) for r in rows] == [("Jo", 'Acme, "Sun"', "jo@x.example", None), (None, "Two\nlines", None, "b@x.example")]


def test_changes_of_one_key_count_once(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, status string, name string")
    changes = spark.createDataFrame([(1, "p", 1), (1, "q", 2), (9, "z", 3)], "id int, status string, at int")
    assert sorted(map(tuple, sinks.update_by_key(stored, changes, "id", ("status",), "at").collect())) == [(1, "q", "x"), (2, "b", "y")]


def test_one_project_for_each_url(spark):
    rows = [("2", "u", "B"), ("1", "u", "A"), ("3", None, "C"), ("4", None, "D"), ("5", "known", "E")]
    df = spark.createDataFrame(rows, "epbc_number string, source_url string, project_name string").withColumns({
        "raw_description": F.lit("r"), "size_mw": F.lit(None).cast("double"), "proponent": F.lit("p"), "location": F.lit(None).cast("string"), "state": F.lit("NSW"),
        "is_approved": F.lit(True), "referral_date": F.lit("soon"),
    })
    known = spark.createDataFrame([("known",), (None,)], "source_url string")
    out = referrals.to_projects(df, known, DAY).collect()
    assert sorted(r["name"] for r in out) == ["A", "C", "D"] and all(r["announced_date"] == DAY and r["capacity_mw"] == 0 for r in out)


def test_scan_joins_have_no_key_of_missing_urls(spark):
    rows = spark.createDataFrame([(None, 1, True, DAY), ("", 2, True, DAY), ("a", 3, True, DAY)], "source_url string, ord long, gate_ok boolean, announced_date date")
    stored = spark.createDataFrame([("a", 7, DAY)], "source_url string, stored_id long, stored_date date")
    got = {r["ord"]: r["project_ref"] for r in dedup.scan_dedup(rows, stored).collect()}
    assert got == {1: "new", 2: "new", 3: "stored"}
