import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from personweave.functions import contact, dates, ids, lines, profile, text


def value(spark, cell, make, kind="string"):
    return spark.createDataFrame([(cell,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("cell", "expected"),
    [("a|b; c", ["a", "b; c"]), (" a ;b,c", ["a", "b,c"]), ("a, b ,,", ["a", "b"]), ("one", ["one"]), ("", []), (None, []), (" | ", [])],
)
def test_split_multi(spark, cell, expected):
    assert value(spark, cell, text.split_multi) == expected


def test_text(spark):
    assert value(spark, "  a\t b \n", text.collapse_ws) == "a b"
    assert value(spark, "  ", text.blank_to_null) is None
    assert value(spark, "node.js and SQL2go", text.title_letters) == "node.js and SQL2go".title()
    assert value(spark, "  mARY  ann ", text.title_words) == "Mary Ann"
    assert value(spark, ["A", "a ", "", "B", "b"], text.dedupe_ci, "array<string>") == ["A", "B"]
    assert value(spark, "One. Two!  Three? end", text.sentences) == ["One.", "Two!", "Three?", "end"]
    assert value(spark, "Summary: x\n y\nOther: z", lambda c: text.labelled_block(c, "summary")) == "x y"
    assert value(spark, "aGVs\nbG8=", text.decode_base64) == "hello"
    assert value(spark, "!!", text.decode_base64) is None


@pytest.mark.parametrize(
    ("raw", "normalized", "valid"),
    [("(212) 555-0187", "+12125550187", True), ("1-212-555-0187", "+12125550187", True), ("+44 20 7946 0958", "+442079460958", True), ("+1 112 555 0187", None, False), ("123", None, False), ("junk", None, False), (None, None, False), ("212-555-0187 ext 12", "+12125550187", True)],
)
def test_phones(spark, raw, normalized, valid):
    got = value(spark, raw, contact.phone_parts)
    assert (got["normalized"], got["is_valid"]) == (normalized, valid)


def test_contacts(spark):
    assert value(spark, " A@B.Co ", contact.is_email) and not value(spark, "a@b", contact.is_email) and not value(spark, None, contact.is_email)
    assert value(spark, "a@b.c.org", contact.email_domain) == "b.c.org"
    assert value(spark, "Cell ", lambda c: contact.label_type(c, contact.PHONE_TYPES)) == "mobile"
    assert value(spark, "https://GitHub.com/x/", contact.platform) == "github"
    assert value(spark, "http://boxx.com", contact.platform) == "twitter"  # a substring test
    assert value(spark, "https://github.com/Dev/repo?a=1", contact.username) == "Dev"
    assert value(spark, "@dev", contact.username) == "dev"
    assert value(spark, "x A@b.co, a@B.co z@y.io", contact.find_emails) == ["a@b.co", "z@y.io"]
    assert value(spark, "2019-2022 call 212-555-0187 or +49 30 901820", contact.find_phones) == ["212-555-0187", "+49 30 901820"]
    assert value(spark, "at https://a.b/c. and github.com/x, GITHUB.com/x", contact.find_urls) == ["https://a.b/c", "github.com/x"]


@pytest.mark.parametrize(
    ("cell", "expected"),
    [("2020-03-05", date(2020, 3, 5)), ("Mar 2020", date(2020, 3, 1)), ("march 2020", date(2020, 3, 1)), ("2020", date(2020, 1, 1)), ("03/2020", date(2020, 3, 1)), ("Sept. 5, 2020", date(2020, 9, 5)), ("May", date(1900, 5, 1)), ("soon", None), (None, None), ("", None)],
)
def test_dates(spark, cell, expected):
    assert value(spark, cell, dates.parse_date) == expected


def test_ranges(spark):
    span = value(spark, "Jan 2020 – Present", lambda c: dates.split_range(dates.find_range(c)))
    assert (span["start_date"], span["end_date"], span["is_current"]) == (date(2020, 1, 1), None, True)
    to = "March 2018 to May 2019"
    assert value(spark, to, lambda c: dates.split_range(dates.find_range(c)))["start_date"] is None
    assert value(spark, to, lambda c: dates.split_range(dates.find_range(c), True))["end_date"] == date(2019, 5, 1)
    assert value(spark, "no dates", dates.find_range) is None


def test_ids(spark):
    assert value(spark, "a@b.co", ids.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a@b.co"))


def test_profiles(spark):
    assert value(spark, "node_JS-tool", profile.skill_name) == "Node Js Tool" and value(spark, " ReactJS", profile.skill_name) == "React"
    assert value(spark, "Acme, Inc.", profile.company) == "Acme"
    assert value(spark, "usa ", profile.country_code) == "US" and value(spark, "de", profile.country_code) == "DE"
    assert value(spark, "Systems ", profile.degree_level) == "master"  # a substring test
    assert value(spark, "High School", profile.degree_level) == "unknown" and value(spark, "High School", profile.text_degree_level) == "high_school"
    parts = value(spark, "Austin, TX, US", profile.parse_location)
    assert (parts["city"], parts["state"], parts["state_code"], parts["country_code"]) == ("Austin", None, "TX", "US")


def test_levels_and_empty_places(spark):
    assert value(spark, "Expert", profile.proficiency_weight) == 1.0 and value(spark, None, profile.proficiency_weight) == 0.0
    assert value(spark, None, profile.location_is_empty, "struct<raw:string,city:string,state:string,state_code:string,country:string,country_code:string,postal_code:string>")


def test_lines(spark):
    assert value(spark, "=== Work  Experience: ===", lines.normalize_line) == "work experience"
    assert value(spark, "TOOLS", lines.heading_section) == "skills" and value(spark, "my tools", lines.heading_section) is None
    assert value(spark, "JANE DOE\nx", lines.name_line) == "Jane Doe"
    assert value(spark, "Senior Engineer Jane\njane@x.co\n12 Main Street 90210\nMary Ann Lee", lines.name_line) == "Mary Ann Lee"
    assert value(spark, "a b\none two three four five six seven eight\nmore\n\nnext", lines.header_summary) == "one two three four five six seven eight"
    assert value(spark, "Languages: Go; Rust\n- 2020 | x | C\n", lines.skill_names) == ["Go", "Rust"]
    got = value(spark, "GPA: 3.9 / 5.0", lines.gpa)
    assert (got["gpa"], got["gpa_scale"]) == (3.9, 5.0)
    assert value(spark, "Relevant Coursework: A, B", lines.courses) == ["A", "B"]
