"""Rule packs as JSON files: <folder>/version=<n>/regex/*.json and <folder>/version=<n>/profiles/*.json.

A library is {"id", "patterns": [{"id", "regex"}]}, a profile {"id", "attack_type", "target_fields", "matchers": [{"type":
"regex", "library"}], "enabled"}. Files count in the order of their names, matchers in the order of their profile. Packs
are read as a table of one row for each pattern that is to be tried; the profiles that detection compiles come from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.operators.rules import Profile, validate

_LIBRARY = "id string, patterns array<struct<id string, regex string>>"
_PROFILE = "id string, attack_type string, target_fields array<string>, matchers array<struct<type string, library string>>, enabled boolean"
#: Rows of a version at most: rules are compiled into the plan of a query.
MOST = 20_000


def _files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0).alias("file"), F.from_json("value", schema).alias("j"), F.expr("coalesce(schema_of_variant(try_parse_json(value)), '') like 'OBJECT%'").alias("ok"))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that lie in a folder, oldest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(n[8:]) for n in names if n.startswith("version=") and n[8:].isdigit())


def rule_table(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """profile_no, profile, attack_type, enabled, fields, matcher_no, type, library, pattern_no, pattern_id, regex: a version's
    rules (the newest by default), as they stand in its files. A profile whose matchers name no library keeps one row."""
    found = versions(spark, folder)
    if not found:
        raise ValueError(f"no rule packs in {folder}")
    base = f"{folder}/version={found[-1] if version is None else version}"
    libraries, profiles = _files(spark, f"{base}/regex", _LIBRARY), _files(spark, f"{base}/profiles", _PROFILE)
    for rows in (libraries, profiles):
        if bad := [r[0] for r in rows.where("not ok or j is null").select("file").limit(MOST).collect()]:
            raise ValueError(f"not a JSON object of a pack: {sorted(bad)}")
    lib = libraries.select(F.col("file").alias("library_file"), F.col("j.id").alias("library"), F.posexplode_outer("j.patterns").alias("pattern_no", "p")).select("library_file", "library", "pattern_no", F.col("p.id").alias("pattern_id"), F.col("p.regex").alias("regex"))
    prof = profiles.select("file", F.col("j.id").alias("profile"), F.col("j.attack_type").alias("attack_type"), F.coalesce("j.enabled", F.lit(True)).alias("enabled"), F.col("j.target_fields").alias("fields"), F.posexplode_outer("j.matchers").alias("matcher_no", "m"))
    return prof.select("file", "profile", "attack_type", "enabled", "fields", "matcher_no", F.col("m.type").alias("type"), F.col("m.library").alias("library")).join(lib, "library", "full")


def load(spark: SparkSession, folder: str, version: int | None = None) -> tuple[list[Profile], dict[str, list[tuple[str, str]]]]:
    """Profiles and libraries of a version, checked; what `detect` takes. A profile with several matchers searches the
    patterns of their libraries one after another."""
    rows = rule_table(spark, folder, version).orderBy("file", "matcher_no", "library_file", "pattern_no").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rules")
    libraries: dict[str, list[tuple[str, str]]] = {}
    files: dict[str, set[str]] = {}
    for r in rows:
        if r.library_file is not None:
            if not r.library or r.pattern_no is None or not r.pattern_id or r.regex is None:
                raise ValueError(f"{r.library_file}: a library needs an id and patterns with id and regex")
            files.setdefault(r.library, set()).add(r.library_file)
            if (r.pattern_id, r.regex) not in libraries.setdefault(r.library, []) or r.file is None:
                libraries[r.library].append((r.pattern_id, r.regex))
    if several := [x for x, f in files.items() if len(f) > 1]:
        raise ValueError(f"libraries in several files: {several}")
    profiles: dict[str, dict] = {}
    for r in rows:
        if r.file is None:
            continue
        if not r.profile or not r.attack_type or not r.fields or any(f is None for f in r.fields):
            raise ValueError(f"{r.file}: a profile needs id, attack_type and target_fields")
        if r.matcher_no is None or r.type != "regex":
            raise ValueError(f"{r.file}: matchers must be of type regex")
        own = profiles.setdefault(r.file, {"id": r.profile, "attack_type": r.attack_type, "fields": tuple(r.fields), "enabled": r.enabled, "libraries": []})
        if r.library not in own["libraries"]:
            own["libraries"].append(r.library)
    if not profiles or not libraries:
        raise ValueError(f"no rule packs in {folder}")
    out = []
    for p in profiles.values():
        if unknown := set(p["libraries"]) - set(libraries):
            raise ValueError(f"unknown libraries: {sorted(map(str, unknown))}")
        name = "+".join(p.pop("libraries"))
        if name not in libraries:
            libraries[name] = [x for part in name.split("+") for x in libraries[part]]
        out.append(Profile(p["id"], p["attack_type"], name, p["fields"], p["enabled"]))
    validate(out, libraries)
    return out, libraries
