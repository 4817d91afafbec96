"""A live client of a repository host: it lands API payloads as rows, which repo_api then reads.

The calls run on the executors, one user after another in a task: the profile, the list of
repositories, five calls for each of the k best, and one for each manifest file. A missing or refused
profile fails the job; anything else that fails is a row with an error.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contact import username
from ..session import importable
from .base import SourceError
from .repo_api import FILE_IMPLIES

#: (url, headers, seconds) -> (status, body)
Get = Callable[[str, dict[str, str], float], tuple[int, str]]
TIMEOUT = 10.0
MANIFESTS = frozenset(FILE_IMPLIES) | {"requirements.txt"}
LANDED = "username string, rank int, full_name string, kind string, path string, payload string, error string"


def http_get(url: str, headers: dict[str, str], seconds: float) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=seconds) as answer:  # noqa: S310
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, ""


class Client:
    def __init__(self, api_url: str, token: str | None = None, get: Get = http_get):
        self.api_url, self.get_url = api_url.rstrip("/"), get
        self.headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def get(self, path: str, params: dict[str, str] | None = None, optional: bool = False) -> str | None:
        """The body; None for an optional resource that is missing. SourceError for any other failure."""
        query = f"?{urllib.parse.urlencode(params)}" if params else ""
        status, body = self.get_url(f"{self.api_url}{path}{query}", self.headers, TIMEOUT)
        if optional and status == 404:
            return None
        if status in (401, 403):
            raise SourceError(f"{path}: refused, or over the rate limit")
        if status >= 400:
            raise SourceError(f"{path}: HTTP {status}")
        return body


def payloads_of(client: Client, user: str, k: int) -> Iterator[tuple]:
    """Rows of LANDED for one user."""
    yield user, None, None, "profile", None, client.get(f"/users/{user}"), None
    try:
        listed = json.loads(client.get(f"/users/{user}/repos", {"sort": "updated", "per_page": str(max(100, k))}) or "[]")
    except (SourceError, ValueError, OSError) as error:
        yield user, None, None, "repos", None, None, str(error)
        return
    best = sorted(listed, key=lambda r: (r.get("stargazers_count", 0), r.get("updated_at", "")), reverse=True)[:k]
    for rank, repo in enumerate(best, 1):
        name = repo["full_name"]
        at = f"/repos/{name}"
        for kind, path, params in (
            ("languages", f"{at}/languages", None),
            ("topics", f"{at}/topics", None),
            ("readme", f"{at}/readme", None),
            ("workflows", f"{at}/actions/workflows", None),
            ("tree", f"{at}/git/trees/{repo.get('default_branch') or 'main'}", {"recursive": "1"}),
        ):
            try:
                body = client.get(path, params, optional=True)
                yield user, rank, name, kind, None, body, None
                found = json.loads(body or "{}").get("tree", []) if kind == "tree" else []
            except (SourceError, ValueError, OSError) as error:
                yield user, rank, name, kind, None, None, str(error)
                continue
            for file in (x["path"] for x in found if x.get("type") == "blob" and x.get("path", "").rsplit("/", 1)[-1] in MANIFESTS):
                try:
                    yield user, rank, name, "file", file, client.get(f"{at}/contents/{file}", optional=True), None
                except (SourceError, OSError) as error:
                    yield user, rank, name, "file", file, None, str(error)


def land(users: DataFrame, handle: str, api_url: str, token: str | None = None, k: int = 10, get: Get = http_get) -> DataFrame:
    """Payload rows (LANDED) of the users that a column of handles or links names; blank ones are left out."""
    importable(users.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Client(api_url, token, get)
        types = [pa.string(), pa.int32(), *[pa.string()] * 5]
        names = [c.split()[0] for c in LANDED.split(", ")]
        for batch in batches:
            for user in batch.column(0).to_pylist():
                rows = list(payloads_of(client, user, k))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    named = users.select(username(F.col(handle)).alias("username")).where("username IS NOT NULL").distinct()
    return named.mapInArrow(run, LANDED)
