import base64
import json

import pytest
from pyspark.sql import functions as F

from personweave.sources import repo_api, repo_client

API = "https://api.example.com"


def body(x):
    return json.dumps(x)


def packed(text):
    return body({"encoding": "base64", "content": base64.b64encode(text.encode()).decode()})


def answer(url, headers, seconds):
    pages = {
        "/users/ann": body({"login": "ann", "name": "Ann Lee", "html_url": "https://github.com/ann"}),
        "/users/ann/repos?sort=updated&per_page=100": body([{"full_name": f"ann/r{i}", "name": f"r{i}", "stargazers_count": i % 3, "updated_at": f"2024-01-0{i}"} for i in range(1, 6)]),
        "/repos/ann/r5/languages": body({"Go": 10, "Python": 5}),
        "/repos/ann/r5/topics": body({"names": ["my-lib", "go"]}),
        "/repos/ann/r5/readme": packed("We use REACT"),
        "/repos/ann/r5/actions/workflows": body({"workflows": [{"name": "CI"}, {}]}),
        "/repos/ann/r5/git/trees/main?recursive=1": body({"tree": [{"type": "blob", "path": "a/package.json"}, {"type": "tree", "path": "a"}, {"type": "blob", "path": "b.txt"}]}),
        "/repos/ann/r5/contents/a/package.json": packed('{"dependencies":{"vue":"1"}}'),
    }
    path = url.removeprefix(API)
    assert seconds == 10 and headers["Authorization"] == "Bearer t"
    if path == "/repos/ann/r2/languages":
        return 500, ""
    return (200, pages[path]) if path in pages else (404, "")


def test_land_and_read(spark):
    users = spark.createDataFrame([("https://github.com/ann/x",), ("@ann",), (" ",)], "h string")
    landed = repo_client.land(users, "h", API, "t", 2, answer).cache()
    assert [r["full_name"] for r in landed.where("kind = 'topics'").orderBy("rank").collect()] == ["ann/r5", "ann/r2"]
    assert [r["error"] for r in landed.where("error IS NOT NULL").collect()] == ["/repos/ann/r2/languages: HTTP 500"]
    profiles = landed.where("kind = 'profile'").select("username", "payload")
    row = repo_api.read(profiles, repo_api.evidence(landed)).first()
    assert row["full_name"] == "Ann Lee"
    assert [(s["name"], s["github_occurrence_count"]) for s in row["skills"]] == [("Go", 2), ("Python", 1), ("My lib", 1), ("CI", 1), ("React", 1), ("Node.js", 1), ("Vue", 1)]
    assert row["skills"][-1]["source_context"] == "ann/r5:package.json"


def test_a_refused_profile_is_fatal(spark):
    client = repo_client.Client(API, get=lambda *a: (403, ""))
    with pytest.raises(repo_client.SourceError):
        list(repo_client.payloads_of(client, "ann", 10))
    users = spark.createDataFrame([("nobody",)], "h string")
    with pytest.raises(Exception, match="HTTP 404"):
        repo_client.land(users, "h", API, "t", 10, answer).collect()


def test_no_evidence(spark):
    empty = spark.createDataFrame([("u", 1, "a/b", "languages", None, "broken", None)], repo_client.LANDED)
    assert repo_api.evidence(empty).where(F.col("name").isNotNull()).count() == 0
