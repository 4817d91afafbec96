import pytest
from pyspark.sql import functions as F

from personweave.operators import lineage, merge, normalize, resolve, score
from personweave.plans.pipeline import fuse, generate_output
from personweave.schemas import EDUCATION, EMAILS, LOCATION, PHONES, PROFILES, ROLES, SKILLS, extracted, record

AS_OF = "2024-07-01"


def one(spark, ord_, source, sid, **columns):
    return extracted(spark.createDataFrame([("e",)], "k string"), entity_key=F.col("k"), src_ord=F.lit(ord_), source_type=F.lit(source), source_id=F.lit(sid), **columns)


def skill(name, inferred=False, count=1):
    return F.array(record(SKILLS, name=F.lit(name), is_inferred=F.lit(inferred), github_occurrence_count=F.lit(count)))


def email(address):
    return F.array(record(EMAILS, address=F.lit(address), is_primary=F.lit(True)))


@pytest.fixture(scope="module")
def fused(spark):
    a = one(spark, 0, "csv", "c1", full_name=F.lit("ann  b LEE"), emails=email("A@x.co"), skills=skill("python"), location=record(LOCATION, raw=F.lit("Austin, TX, US")), summary=F.lit("old"), experience=F.array(record(ROLES, company=F.lit("Acme Inc."), title=F.lit("Lead"), raw_start=F.lit("Jan 2020"), raw_end=F.lit("Present"))))
    b = one(spark, 1, "github", "g1", first_name=F.lit("Anna"), skills=skill("Python", True, 3), profiles=F.array(record(PROFILES, platform=F.lit("github"), url=F.lit("https://github.com/ann/"))), summary=F.lit("newer"))
    c = one(spark, 2, "resume", "r1", full_name=F.lit("Ann Lee"), emails=email("a@X.co"), phones=F.array(record(PHONES, raw=F.lit("123"), is_valid=F.lit(False))), summary=F.lit("newest"), education=F.array(record(EDUCATION, institution=F.lit("Uni"), degree=F.lit("BS in x"))))
    return fuse([a, b, c], AS_OF).cache()


def test_scores_by_hand(fused):
    r = fused.first()
    python = r["skills"][0]
    assert (python["item"]["name"], python["item"]["github_occurrence_count"]) == ("Python", 3)
    # best vote 0.90 x 0.95, a second source, both kinds attest, repeated evidence
    assert python["confidence"] == pytest.approx(min(1, 0.855 + 0.04 + 0.10 + 0.05))
    assert r["emails"][0]["confidence"] == pytest.approx(0.855 + 0.04) and r["emails"][0]["item"]["address"] == "a@x.co"
    assert r["phones"][0]["confidence"] == pytest.approx(round(0.80 * 0.70 * 0.65, 4))
    assert r["field_confidences"]["phones"] == r["phones"][0]["confidence"] and 0 < r["overall_confidence"] < 1


def test_vote_anchors():
    f = score.Formula()
    assert f.vote("resume", "nlp_heuristic") == 0.56
    assert f.vote("github", "api_response", is_skill=True) == 0.931
    assert round(f.vote("github", "api_response", is_skill=True) + f.repeated_skill, 3) == 0.981
    assert f.vote("other", "other") == 0.25


def test_conflicts(fused):
    r = fused.first()
    assert r["first_name"]["value"] == "Ann"  # both have a structured source; this one was seen again later
    assert [c["value"] for c in r["first_name"]["conflicts"]] == ["Anna"]
    assert r["first_name"]["confidence"] == pytest.approx(0.855 + 0.04 - 0.08)
    assert r["summary"]["value"] == "newer" and len(r["summary"]["conflicts"]) == 2
    assert r["middle_name"]["value"] == "B" and r["middle_name"]["conflicts"] == []
    assert r["merged_from"] == ["c1", "g1", "r1"] and r["display_name"] == "Ann Lee" and r["primary_email"] == "a@x.co" and r["primary_phone"] == "123"


def test_normalised_items(fused):
    r = fused.first()
    role = r["experience"][0]["item"]
    assert (role["company"], role["is_current"], role["duration_months"], str(role["start_date"])) == ("Acme", True, 54, "2020-01-01")
    assert r["education"][0]["item"]["degree_level"] == "bachelor" and r["location_display"] == "Austin, TX, US"


def test_provenance_counts(fused):
    flat = fused.select(merge.flat_provenance(fused, tuple(f for f in merge.FAMILIES)).alias("m")).first()["m"]
    assert {k: len(v) for k, v in flat.items()} == {"emails": 2, "phones": 1, "skills": 2, "experience": 1, "education": 1, "profiles": 1}


def test_every_item_has_provenance_and_bounds(fused):
    r = fused.first()
    for family in merge.FAMILIES:
        for item in r[family]:
            assert item["provenance"] and 0 <= item["confidence"] <= 1


def test_normalisation_is_idempotent(spark):
    rows = one(spark, 0, "csv", "c", full_name=F.lit("ann LEE"), emails=email("A@x.co"), phones=F.array(record(PHONES, raw=F.lit("212 555 0187"), is_valid=F.lit(False))), skills=skill("node_js"), location=record(LOCATION, raw=F.lit("Austin, Texas, United")))
    once = normalize.normalize(rows, AS_OF, with_logs=False)
    assert normalize.normalize(once, AS_OF, with_logs=False).collect() == once.collect()
    only = normalize.normalize(rows, AS_OF, only=("skills",)).first()
    assert only["skills"][0]["name"] == "Node Js" and only["full_name"] == "ann LEE"


def test_logs(spark):
    rows = one(spark, 0, "csv", "c", emails=F.array(record(EMAILS, address=F.lit("bad"))), phones=F.array(record(PHONES, raw=F.lit("123"), is_valid=F.lit(False))))
    out = normalize.normalize(rows, AS_OF)
    failed = out.select(F.transform(normalize.failed(F.col("normalization_logs")), lambda x: x["field"]).alias("f")).first()["f"]
    assert failed == ["phones[0]", "emails[0]"] and out.first()["emails"] == []


def test_source_order_does_not_change_the_keys(spark):
    def keys(order):
        parts = [one(spark, o, "csv", f"s{k}", skills=skill(n)) for k, (o, n) in enumerate(zip(order, ("js", "JavaScript", "go"), strict=True))]
        return sorted(r["item_key"] for r in merge.merge_list(normalize.normalize(parts[0].union(parts[1]).union(parts[2]), AS_OF, with_logs=False), "skills").collect())

    assert keys([0, 1, 2]) == keys([2, 1, 0]) == ["go", "javascript"]


def test_staged_and_combined_forms_agree(spark, tmp_path):
    rows = [one(spark, k, "csv", f"s{k}", skills=skill(n), emails=email("a@x.co"), summary=F.lit(f"t{k}")) for k, n in enumerate(("js", "JavaScript", "go"))]
    plain = fuse(rows, AS_OF).collect()
    assert fuse(rows, AS_OF, staged=str(tmp_path / "records")).collect() == plain
    assert fuse(rows, AS_OF, co_partition=False).collect() == plain


def test_one_exchange_for_the_input(spark):
    rows = normalize.normalize(one(spark, 0, "csv", "c", skills=skill("go")), AS_OF, with_logs=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        own = merge.spread(rows)
        listed = merge._listed(merge.merge_list(own, "skills"), "skills")
        plan = listed._jdf.queryExecution().executedPlan().toString()
        full = merge.merge(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in full and "Arrow" not in full
    # one exchange a scanned input: all others reuse it
    assert full.count("Exchange hashpartitioning") - full.count("ReusedExchange") <= 10


def test_fusion_reads_each_source_once(spark):
    from personweave.plans.queries_fusion import QUERIES_OF_FUSION

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = {n: q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for n, q in QUERIES_OF_FUSION.items()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for name, plan in plans.items():
        # customer, nation, region, orders and events, each once; one exchange by entity, one each for the group-bys of orders and events
        assert plan.count("FileScan") == 5, name
        assert plan.count("Exchange hashpartitioning(entity_key") == 1 and plan.count("Exchange hashpartitioning") <= 3, name
        assert not any(n in plan for n in ("InArrow", "InPandas", "EvalPython", "SortMergeJoin")), name


def test_merge_agrees_with_its_families(spark):
    """The one-pass form against the forms for one family alone, with blank, null and repeated values."""
    rows = [
        one(spark, k, "csv" if k % 2 else "github", f"s{k % 3}", first_name=F.lit(n), summary=F.lit(s), skills=skill(n or "x", bool(k % 2), k), emails=F.array(F.lit(None).cast(EMAILS[6:-1]), record(EMAILS, address=F.lit(f"{n}@x.co")), record(EMAILS, address=F.lit(""))), projects=F.array(record(ROLES, company=F.lit("P"), title=F.lit(n))), location=record(LOCATION, city=F.lit(s)))
        for k, (n, s) in enumerate((("Ann", "a"), ("ann ", " "), (None, ""), ("BOB", "A"), ("Ann", None), ("Ann", "a")))
    ]
    records = rows[0]
    for r in rows[1:]:
        records = records.union(r)
    records = records.union(records.limit(0)).unionByName(records.where("src_ord = 1"))
    merged = merge.merge(records).first()
    alone = merge.merge(records, co_partition=False).first()
    assert merged == alone
    for family in merge.FAMILIES:
        listed = [(r["item_key"], r["item"], r["provenance"]) for r in merge.merge_list(records, family).sort("item_key").collect()]
        assert [(x["item_key"], x["item"], x["provenance"]) for x in merged[family]] == listed
    places = [(r["item_key"], r["value"], r["provenance"]) for r in merge.merge_locations(records).sort("item_key").collect()]
    assert [(x["item_key"], x["value"], x["provenance"]) for x in merged["location"]] == places
    for field in merge.SCALARS:
        values = [(r["item_key"], r["provenance"]) for r in merge.merge_scalars(records).where(F.col("field") == field).sort("item_key").collect()]
        assert [(x["item_key"], x["provenance"]) for x in merged[field]] == values
    ids = merge.candidate_ids(records).first()
    assert (merged["candidate_id"], merged["merged_from"]) == (ids["candidate_id"], ids["merged_from"])
    some = merge.merge(records, fields=("first_name", "skills")).first()
    assert some["first_name"] == merged["first_name"] and some["skills"] == merged["skills"] and "emails" not in some


def test_lineage(spark):
    row = spark.range(1).select(lineage.record("f", F.lit("v"), "csv", F.lit("s"), confidence=3.0).alias("r"), lineage.record("f", F.lit(None).cast("string"), "csv", F.lit("s")).alias("n")).first()
    assert row["r"]["confidence"] == 1.0 and row["r"]["raw_value"] == "v" and row["n"] is None


def test_roles_in_order(spark):
    lower = [("Zeta", "t"), ("ACME", "Lead"), ("acme", "lead"), ("Acme", "clerk"), ("beta", "t")]
    tied = F.array(*[F.struct(record(ROLES, company=F.lit(c), title=F.lit(t)).alias("item")) for c, t in lower])
    found = spark.range(1).select(F.transform(resolve.order_roles(tied), lambda x: x["item"]["company"]).alias("o")).first()["o"]
    assert found == ["Zeta", "beta", "ACME", "acme", "Acme"]
    items = [(None, "2020", "a"), (None, None, "b"), ("2021-01-01", None, "c")]
    made = F.array(*[F.struct(record(ROLES, company=F.lit(n), title=F.lit("t"), raw_start=F.lit(r), start_date=F.lit(s).cast("date")).alias("item")) for s, r, n in items])
    out = spark.range(1).select(F.transform(resolve.order_roles(made), lambda x: x["item"]["company"]).alias("o")).first()["o"]
    assert out == ["a", "b", "c"]


def test_output(fused):
    config = {"fields": [{"path": "name", "from": "display_name", "required": True}, {"path": "score", "from": "confidence"}]}
    out = generate_output(fused, config, {"type": "object", "required": ["email"]}).first()
    assert out["output"].startswith('{"name":"Ann Lee","score":0.') and [e["validator"] for e in out["schema_errors"]] == ["required"]
