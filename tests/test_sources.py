import pytest
from pyspark.sql import functions as F

from personweave.sources import base, csv, json_paths, notes, repo_api, sectioned


def test_csv_file(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('UID,First Name,surname,E-Mail,Mobile,Skills,Company,Title,website,record_type,projectName,stack,ongoing,certificateName,issuer\n"u1",Ann,Lee,"a@x.co, bad",212-555-0187,"js|go",Acme,,https://linkedin.com/in/ann/,,,,,,\nu1,,,b@x.co,,,,,,project,Tool,a; b,yes,,\nu1,,,,,,,,,certification,,,,Cert,Org\nu1,,,,,,,,,certification,,,,Cert,Org\n,Bob,,,,,,,,,,,,,\n', encoding="utf-8")
    df = csv.read(spark, str(path))
    by = {r["entity_key"]: r for r in csv.grouped(df).collect()}
    ann = by["u1"]
    assert (ann["first_name"], ann["last_name"]) == ("Ann", "Lee")
    assert [(e["address"], e["is_primary"]) for e in ann["emails"]] == [("a@x.co", True), ("b@x.co", True)]
    assert [w["raw"] for w in ann["warnings"]] == ["bad"]
    assert [s["name"] for s in ann["skills"]] == ["js", "go"] and ann["experience"][0]["title"] == "Unknown"
    assert ann["projects"][0]["technologies"] == ["a", "b"] and ann["projects"][0]["is_current"]
    assert ann["metadata"]["certifications"] == '[{"name":"Cert","issuer":"Org"}]' and ann["profiles"][0]["platform"] == "linkedin"
    assert len(by) == 2 and [r["first_name"] for k, r in by.items() if k.startswith("row_")] == ["Bob"]
    compat = csv.grouped(df, compat_grouping=True).where("entity_key = 'u1'").first()
    assert not compat["skills"] and not compat["experience"] and not compat["profiles"]


def test_csv_rows_and_mapping(spark):
    df = spark.createDataFrame([("x", " y ", "Ann")], ["Employer", "company", "N"])
    row = csv.rows(df, {"n": "first_name"}).first()
    assert row["experience"][0]["company"] == "y" and row["first_name"] == "Ann" and row["source_id"].startswith("csv:")
    assert csv.rows(df).first()["source_id"] == row["source_id"]
    with pytest.raises(ValueError):
        csv.mapping({"n": "nothing"})
    assert sum(map(len, csv.ALIASES.values())) == 96 and len(csv.ALIASES) == 19


def test_gpa_above_its_scale(spark):
    df = spark.createDataFrame([("u", "education", "Uni", "9.1", "4")], ["uid", "record_type", "institutionName", "cgpa", "gradingScale"])
    row = csv.grouped(df).first()
    assert row["education"] == [] and len(row["warnings"]) == 1


def test_json(spark):
    payload = '{"id":7,"name":"Ann Lee","emails":["a@x.co","b@x.co"],"phones":[{"value":"212-555-0187","type":"mobile"},null],"tags":["go"," js ",""],"links":["https://github.com/ann"],"headline":"Lead","location":"Austin, TX"}'
    df = spark.createDataFrame([(payload,), ("not json",), (None,)], "p string")
    rows = json_paths.read(df, F.col("p"), json_paths.LISTING_VENDOR, "board").collect()
    ann = rows[0]
    assert ann["source_id"] == "board:7" and ann["full_name"] == "Ann Lee"
    assert [e["address"] for e in ann["emails"]] == ["a@x.co"]
    assert [(p["raw"], p["type"]) for p in ann["phones"]] == [("212-555-0187", "unknown")]
    assert [s["name"] for s in ann["skills"]] == ["go", "js"] and ann["profiles"][0]["platform"] == "github"
    assert ann["experience"][0]["company"] == "Unknown" and ann["location"]["raw"] == "Austin, TX"
    assert all(r["source_id"] == "board:unknown" and r["emails"] == [] for r in rows[1:])
    flat = spark.createDataFrame([('{"id":"1","first_name":"A","skills":"x, y","email":"bad"}',)], "p string")
    row = json_paths.read(flat, F.col("p"), json_paths.FLAT).first()
    assert [s["name"] for s in row["skills"]] == ["x", "y"] and [w["raw"] for w in row["warnings"]] == ["bad"]


def test_paths(spark):
    v = F.try_parse_json(F.lit('{"a":{"0":[1,{"b":null}]},"l":["x"]}'))
    at = lambda p: spark.range(1).select(json_paths.value_at(v, p)).first()[0]
    assert (at("a.0.0"), at("a.0.1.b"), at("a.0.9"), at("l.0"), at("nope.x")) == ("1", None, None, "x", None)


def test_repositories(spark):
    profiles = spark.createDataFrame([("ann", '{"login":"ann","name":" Ann ","html_url":"https://github.com/ann/","bio":null}')], ["username", "payload"])
    evidence = spark.createDataFrame([("ann", 1, "Go", "languages"), ("ann", 2, "go", "topics"), ("ann", 3, " ", "x")], ["username", "ord", "name", "context"])
    row = repo_api.read(profiles, evidence).first()
    assert row["full_name"] == "Ann" and row["profiles"][0]["url"] == "https://github.com/ann"
    assert [(s["name"], s["source_context"], s["is_inferred"], s["github_occurrence_count"]) for s in row["skills"]] == [("Go", "languages", True, 2)]
    assert row["source_id"] == "https://github.com/ann"
    assert spark.range(1).select(F.array(*[repo_api.technology_name(F.lit(n)) for n in ("@angular", "my_lib", "NODE", " ")])).first()[0] == ["Angular", "My lib", "Node.js", ""]
    assert spark.range(1).select(repo_api.readme_names(F.lit("uses REACT and redis"))).first()[0] == ["React", "Redis"]
    assert spark.range(1).select(repo_api.manifest_names(F.lit("package.json"), F.lit("broken"))).first()[0] == ["Node.js"]


def test_notes(spark):
    df = spark.createDataFrame([("Noted leadership. Good C# work.",), ("  ",), (None,)], "text string")
    rows = notes.read(df).collect()
    assert rows[0]["metadata"]["soft_skills"] == '["Leadership"]' and "work" in rows[0]["metadata"]["keywords"]
    assert len(rows) == 1 and rows[0]["summary"] == "Noted leadership." and [s["name"] for s in rows[0]["skills"]] == ["Leadership"]


def test_notes_make_each_list_once(spark):
    t = F.col("text")
    df = spark.createDataFrame([("Strong leadership, Ab ab AB. " + " ".join(f"w{i} W{i}" for i in range(300)),), ("Keywords: b; B ,a|b\nObservations: x;X; - y",), (None,)], "text string")
    rows = df.select(notes.keywords(t).alias("k"), notes.observations(t).alias("o"), notes.soft_skills(t).alias("s")).collect()
    assert rows[0]["k"] == ["Ab", *[f"w{i}" for i in range(19)]] and rows[0]["o"] == [] and rows[0]["s"] == ["Leadership"]
    assert rows[1]["k"] == ["b", "a"] and rows[1]["o"] == ["x", "y"] and rows[2]["k"] is None and rows[2]["o"] is None and rows[2]["s"] == []
    for made, call, times in ((notes.keywords(t), "regexp_extract_all(", 1), (notes.keywords(t), "split(", 1), (notes.observations(t), "split(", 2)):
        assert df.select(made.alias("x"))._jdf.queryExecution().analyzed().toString().count(call) == times


TEXT = """Jane Roe
jane@x.co

SKILLS
Languages
Go, Rust
EXPERIENCE
Lead at Acme
2019 to 2020
- Grew 3x
PROJECTS
Projects
Fast Cache — Redis, Go
- Built it
  in Rust.
EDUCATION
State University
B.S. in Physics
GPA: 4.9 / 4.0

Other College
MBA
2001 - 2003
SKILLS
SQL"""


def test_sectioned(spark):
    found = sectioned.sections(TEXT)
    assert found["skills"] == "Languages\nGo, Rust\nSQL" and found["header"] == "Jane Roe\njane@x.co\n"
    assert found["projects"].startswith("Projects\n")  # inside projects, no new heading
    rows = sectioned.read(spark.createDataFrame([(TEXT,), ("",), (None,)], "text string")).collect()
    jane = rows[0]
    assert (jane["full_name"], jane["first_name"], jane["last_name"]) == ("Jane Roe", "Jane", "Roe")
    assert [s["name"] for s in jane["skills"]] == ["Languages", "Go", "Rust", "SQL"]
    role = jane["experience"][0]
    assert (role["title"], role["company"], role["start_date"], role["achievements"]) == ("Lead", "Acme", None, ["Grew 3x"])
    assert [(p["title"], p["technologies"]) for p in jane["projects"]][-1] == ("Fast Cache — Redis, Go", ["Redis", "Go"])
    assert [(e["institution"], e["degree_level"]) for e in jane["education"]] == [("Other College", "master")]  # a GPA above its scale drops the other
    assert all(r["warnings"][0]["field"] == "text" for r in rows[1:])
    fixed = sectioned.read(spark.createDataFrame([(TEXT,)], "text string"), split_to=True).first()
    assert fixed["experience"][0]["start_date"].year == 2019


def test_blocks():
    assert sectioned.role(["Analyst | Beta | 2019 - Present", "did"]) == {"title": "Analyst", "company": "Beta", "dates": "2019 - Present", "lines": ["did"]}
    assert sectioned.role(["no dates"]) is None
    assert sectioned.role(["Chief, Acme", "2019 - 2020"])["company"] == "Acme"
    assert sectioned.role(["Lead, Acme 2019 - 2020"]) == {"title": "Lead", "company": "Acme", "dates": "2019 - 2020", "lines": []}
    assert sectioned.role(["2019 - 2020"])["title"] == "Unknown"
    assert sectioned.techs("Tech: node js, FastAPI") == ["Node.js", "FastAPI"]
    assert sectioned.project_line("github | live", True) == "links" and sectioned.project_line("and so on it goes", True) == "more"


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"Jane Roe")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    (tmp_path / "c.txt").write_bytes(b"x")
    rows = sectioned.read_files(spark, str(tmp_path), lambda b: b.decode()).collect()
    assert sorted(str(r["text"]) for r in rows) == ["Jane Roe", "None"]


def test_coercion():
    from personweave.sources.coerce import coercer

    schema = {
        "type": "object",
        "required": ["name", "flag", "n", "x", "list", "inner", "maybe", "other"],
        "properties": {
            "name": {"type": "string"}, "flag": {"type": "boolean"}, "n": {"type": "integer"}, "x": {"type": "number"}, "list": {"type": "array", "items": {"$ref": "#/$defs/part"}},
            "inner": {"type": "object"}, "maybe": {"type": ["string", "null"]}, "profiles": {"type": "array"}, "tree": {"$ref": "#/$defs/tree"}, "any": {"anyOf": [{"type": "integer"}, {"type": "null"}]},
        },
        "$defs": {"part": {"type": "object", "properties": {"raw": {"type": "string"}}}, "tree": {"type": "object", "properties": {"next": {"$ref": "#/$defs/tree"}, "v": {"type": "integer"}}}},
    }
    apply = coercer(schema)
    assert apply({}) == {"name": "N/A", "flag": False, "n": 0, "x": 0, "list": [], "inner": None or {}, "maybe": None, "other": "N/A"}
    assert apply({"name": ["a", 1], "flag": "Yes", "n": "7.9", "x": "bad", "list": "one", "maybe": 5, "inner": "t", "other": 1, "more": [1]}) == {
        "name": "a\n1", "flag": True, "n": 7, "x": 0, "list": [{"raw": "one"}], "maybe": "5", "inner": {"raw": "t"}, "other": 1, "more": [1]
    }
    assert apply({"name": {"raw": "r"}, "flag": 1, "n": float("inf"), "profiles": [{"platform": "github", "url": "u"}, {"platform": "odd", "url": "u"}, {"platform": "github"}, 5]})["profiles"] == [{"platform": "github", "url": "u"}]
    assert apply({"tree": {"next": {"next": {"v": "3"}}}, "any": None})["tree"] == {"next": {"next": {"v": 3}}}
    assert apply({"any": None})["any"] is None and apply({"any": "4"})["any"] == 4
    assert coercer({"type": "string"})(None) == "N/A" and coercer({"type": "array"})(None) == [] and coercer({})({"a": 1}) == {"a": 1}
    with pytest.raises(ValueError, match="circular"):
        coercer({"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}})


def test_coerced_column(spark):
    from personweave.sources.coerce import coerce_json

    df = spark.createDataFrame([(1, '{"n":"2"}'), (2, "bad"), (3, None), (4, "")], "`a.b` long, text string").withColumn("__json", F.lit("x"))
    schema = {"type": "object", "properties": {"n": {"type": "integer"}}}
    assert [r["text"] for r in coerce_json(df, "text", schema).collect()] == ['{"n":2}', None, None, None]
    out = coerce_json(df, "text", schema, fallback='{"n":"9"}', output="made")
    assert out.columns == [*df.columns, "made"] and [r["made"] for r in out.collect()] == ['{"n":2}', '{"n":9}', '{"n":9}', '{"n":9}']
    assert coerce_json(df.limit(0), "text", schema).count() == 0


def test_model_with_fallback(spark, tmp_path):
    from personweave.sources import model

    def complete(text):
        import os

        if "late" in text:
            mark = str(tmp_path / "tried")
            if not os.path.exists(mark):
                open(mark, "w").close()
                raise model.Temporary("busy")
        if "down" in text:
            raise model.Temporary("always busy")
        if "broken" in text:
            return "no json"
        return '```json\n{"full_name": "Ann Lee", "emails": [{"address": "a@x.co", "is_primary": "yes"}], "skills": "go", "profiles": [{"platform": "nowhere", "url": "u"}], "location": "Berlin", "experience": [{"company": "Acme", "title": null, "start_date": "2020-01-01"}]}\n```'

    rows = [("ok",), ("late",), ("down\n\nSkills\nPython",), ("broken",), ("  ",), (None,)]
    landed = model.land(spark.createDataFrame(rows, "text string").coalesce(1), complete, str(tmp_path / "landed"), wait=0.0)
    found = {r["raw_text"]: r for r in model.read(landed).collect()}
    assert len(found) == 6
    for text in ("ok", "late"):
        r = found[text]
        assert r["full_name"] == "Ann Lee" and r["emails"][0]["is_primary"] is True and r["profiles"] == [] and r["warnings"] == []
        assert r["location"]["raw"] == "Berlin" and str(r["experience"][0]["start_date"]) == "2020-01-01" and r["experience"][0]["title"] is None
    assert "always busy" in found["down\n\nSkills\nPython"]["warnings"][0]["message"] and [s["name"] for s in found["down\n\nSkills\nPython"]["skills"]] == ["Python"]
    assert "JSONDecodeError" in found["broken"]["warnings"][0]["message"]
    assert [w["message"] for w in found["  "]["warnings"]] == [w["message"] for w in found[None]["warnings"]] == ["No text"]
    assert model.read(landed).schema == sectioned.read(spark.createDataFrame(rows, "text string")).schema


def test_documents_that_cannot_be_read_say_so(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"Jane Roe")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    files = sectioned.read_files(spark, str(tmp_path), lambda b: b.decode())
    by = {r["path"].rsplit("/", 1)[1]: r for r in files.collect()}
    assert by["a.pdf"]["text"] == "Jane Roe" and by["a.pdf"]["warnings"] == []
    assert by["b.pdf"]["text"] is None and "UnicodeDecodeError" in by["b.pdf"]["warnings"][0]["message"]
    read = {r["raw_text"]: [w["message"] for w in r["warnings"]] for r in sectioned.read(files).collect()}
    assert len(read[None]) == 2 and "UnicodeDecodeError" in read[None][0] and read[None][1] == "No text"


def test_registry(spark):
    registry = base.builtin()
    df = spark.createDataFrame([("Ann Lee\nSkills\n- sql",)], "text string")
    assert registry.read("resume", df).first()["full_name"] == "Ann Lee"
    with pytest.raises(base.SourceError, match="resume: no column text"):
        registry.read("resume", df.withColumnRenamed("text", "TEXT"))
    with pytest.raises(base.SourceError, match="unknown source"):
        registry.read("fax", df)
    with pytest.raises(ValueError):
        registry.add(base.Source("csv", "csv", csv.rows))
    with pytest.raises(ValueError):
        base.Source("fax", "fax", csv.rows)
    with pytest.raises(base.SourceError, match="records have the columns"):
        base.Source("plain", "csv", lambda rows: rows).read(df)


def test_text_helpers(spark):
    df = spark.createDataFrame([(1, 'a,"b ""c"", d"'), (2, ","), (3, None), (4, ""), (5, "x"), (6, "e,f,g")], "`a.b` int, line string")
    rows = csv.parse_lines(df, "line", ["a b", "name"]).collect()
    assert [tuple(r) for r in rows] == [(1, "a", 'b "c", d'), (5, "x", ""), (6, "e", "f")]
    assert csv.parse_lines(df.limit(0), "line", ["a b", "name"]).columns == ["a.b", "a b", "name"]
    texts = spark.createDataFrame([('{"a": 1}',), (" ",), (None,), ("{",)], "t string")
    shown = [r[0] for r in texts.select(F.to_json(json_paths.parse_text(F.col("t"), "[]"))).collect()]
    assert shown == ['{"a":1}', "[]", "[]", "[]"]
