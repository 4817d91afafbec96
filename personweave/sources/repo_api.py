"""Repository-host sources: landed API payloads as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contact
from ..functions.text import blank_to_null, decode_base64, trim_ws
from ..schemas import LOCATION, PROFILES, SKILLS, extracted, record

PROFILE = "login string, name string, bio string, location string, html_url string, company string, blog string, followers bigint, following bigint, public_repos bigint"
#: Technologies looked for in a readme, and those that a file's name implies.
README_KNOWN = ("React", "TypeScript", "JavaScript", "Python", "Django", "FastAPI", "Flask", "Docker", "Kubernetes", "AWS", "PostgreSQL", "Redis", "Tailwind CSS", "Vite")
SPELLINGS = {"reactjs": "React", "nodejs": "Node.js", "node": "Node.js", "tailwindcss": "Tailwind CSS"}
#: Kinds of payload rows, in the order in which their names count.
KINDS = ("languages", "topics", "workflows", "readme", "file")
FILE_IMPLIES = {
    "package.json": ("Node.js",),
    "Dockerfile": ("Docker",),
    "docker-compose.yml": ("Docker Compose",),
    "pom.xml": ("Java", "Maven"),
    "Cargo.toml": ("Rust",),
    "go.mod": ("Go",),
    "tailwind.config.js": ("Tailwind CSS",),
    "vite.config.ts": ("Vite", "TypeScript"),
}


def profile_fields(payload: Column) -> dict[str, Column]:
    """Fields of an extracted record from a profile payload (JSON text)."""
    p = F.from_json(payload, PROFILE)
    clean = lambda n: blank_to_null(p[n])
    link = record(PROFILES, platform=F.lit("github"), url=contact.clean_url(clean("html_url")), username=clean("login"))
    return {
        "full_name": F.coalesce(clean("name"), clean("login")),
        "summary": clean("bio"),
        "location": F.when(clean("location").isNotNull(), record(LOCATION, raw=clean("location"))),
        "metadata": F.create_map(F.lit("github_profile"), F.to_json(F.struct(*[p[n].alias(n) for n in ("login", "company", "blog", "followers", "following", "public_repos")]))),
        "profiles": F.when(clean("html_url").isNotNull(), F.array(link)).otherwise(F.array().cast(PROFILES)),
    }


def top_repositories(repos: DataFrame, k: int = 10, user: str = "username", stars: str = "stargazers_count", updated: str = "updated_at", tie: str = "full_name") -> DataFrame:
    """The k repositories of each user with most stars, then the newest; ties by name."""
    order = Window.partitionBy(user).orderBy(F.col(stars).desc_nulls_last(), F.col(updated).desc_nulls_last(), F.col(tie))
    return repos.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_payloads(repos: DataFrame, payloads: dict[str, DataFrame], key: str = "full_name") -> DataFrame:
    """The repositories with each payload's array, empty where the payload is missing. payloads: name -> (key, name)."""
    out = repos
    for name, df in payloads.items():
        out = out.join(df.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.array().cast(dict(df.dtypes)[name])))
    return out


def readme_names(text: Column) -> Column:
    """Known technologies that a readme mentions."""
    return F.filter(F.array(*[F.lit(n) for n in README_KNOWN]), lambda n: F.coalesce(F.contains(F.lower(text), F.lower(n)), F.lit(False)))


def manifest_names(filename: Column, content: Column) -> Column:
    """Technologies that a manifest names: those its name implies, then its dependencies."""
    table = F.create_map(*[x for name, found in FILE_IMPLIES.items() for x in (F.lit(name), F.array(*[F.lit(f) for f in found]))])
    implied = F.coalesce(F.try_element_at(table, filename), F.array().cast("array<string>"))
    package = F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>")
    none = F.array().cast("array<string>")
    deps = F.concat(F.coalesce(F.map_keys(package["dependencies"]), none), F.coalesce(F.map_keys(package["devDependencies"]), none))
    lines = F.filter(F.transform(F.split(content, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    required = F.transform(lines, lambda x: F.regexp_extract(x, r"^([^<>=!~\[]*)", 1))
    artifacts = F.regexp_extract_all(content, F.lit("<artifactId>([^<]+)</artifactId>"), F.lit(1))
    own = F.when(filename == "package.json", deps).when(filename == "requirements.txt", required).when(filename == "pom.xml", artifacts).otherwise(none)
    return F.concat(implied, F.coalesce(own, none))


def technology_name(c: Column) -> Column:
    """A technology as it is shown: without @ at either end, _ and - as spaces, a known spelling or a capital first."""
    clean = F.regexp_replace(F.btrim(trim_ws(c), F.lit("@")), "[_-]", " ")
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair]), F.lower(clean))
    return F.coalesce(known, F.concat(F.upper(F.left(clean, F.lit(1))), F.substr(clean, F.lit(2))))


def evidence(payloads: DataFrame, user: str = "username") -> DataFrame:
    """Rows (user, ord, name, context) from payload rows (user, rank, full_name, kind, path, payload).

    Kinds: languages, topics, workflows, readme, file. The order is that of the repositories, then of the
    kinds, then of the names. Payloads that cannot be read give no names.
    """
    p, kind = F.col("payload"), F.col("kind")
    content = F.from_json(p, "encoding string, content string")
    text = F.when(content["encoding"] == "base64", decode_base64(content["content"]))
    filename = F.element_at(F.split("path", "/"), -1)
    names = (
        F.when(kind == "languages", F.map_keys(F.from_json(p, "map<string,bigint>")))
        .when(kind == "topics", F.from_json(p, "names array<string>")["names"])
        .when(kind == "workflows", F.transform(F.from_json(p, "workflows array<struct<name:string>>")["workflows"], lambda w: w["name"]))
        .when(kind == "readme", readme_names(text))
        .when(kind == "file", manifest_names(filename, text))
    )
    context = F.when(kind == "languages", "github languages").otherwise(F.concat("full_name", F.when(kind == "file", F.concat(F.lit(":"), filename)).when(kind == "readme", F.lit(" README")).otherwise(F.concat(F.lit(" "), kind))))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    rows = payloads.select(user, "rank", order.alias("k"), F.coalesce("path", F.lit("")).alias("path"), context.alias("context"), F.posexplode_outer(names).alias("pos", "name"))
    return rows.where("name IS NOT NULL").select(user, F.struct("rank", "k", "path", "pos").alias("ord"), "name", "context")


def infer_technologies(evidence: DataFrame, user: str = "username") -> DataFrame:
    """(user, name, source_context, github_occurrence_count) from rows (user, ord, name, context): the first spelling and context of each name, and how often it occurs."""
    rows = evidence.withColumn("name", technology_name(F.col("name"))).where("name <> ''")
    out = rows.groupBy(user, F.lower("name").alias("k")).agg(F.min_by("name", "ord").alias("name"), F.min_by("context", "ord").alias("source_context"), F.count(F.lit(1)).alias("github_occurrence_count"), F.min("ord").alias("ord"))
    return out.drop("k")


def read(profiles: DataFrame, evidence: DataFrame, payload: str = "payload", user: str = "username", entity_key: Column | None = None, src_ord: Column | None = None) -> DataFrame:
    """One extracted record for each profile, with its inferred technologies as skills."""
    skill = record(SKILLS, name=F.col("name"), source_context=F.col("source_context"), is_inferred=F.lit(True), github_occurrence_count=F.col("github_occurrence_count"))
    skills = infer_technologies(evidence, user).groupBy(user).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", skill.alias("s")))), lambda x: x["s"]).alias("__skills"))
    df = profiles.join(skills, user, "left")
    key = F.col(user) if entity_key is None else entity_key
    return extracted(df, entity_key=key, src_ord=F.lit(0) if src_ord is None else src_ord, source_type=F.lit("github"), source_id=F.concat(F.lit("https://github.com/"), F.col(user)), skills=F.coalesce("__skills", F.array().cast(SKILLS)), **profile_fields(F.col(payload)))
