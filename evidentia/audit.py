"""python -m evidentia.audit MANIFEST [--root FOLDER] [--schema FILE] [--skip-hashes]: checks a package's manifest; exit status 1 if a check fails."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from .operators import audits as au
from .session import local_session
from .sources import files as fs

TASK = "task_id string, video_id string, split string, query string, target_segments array<struct<start_ms: long, end_ms: long>>, evidence struct<shot_ids: array<string>>"


def audit(spark, manifest: dict, root: str, hashes: bool = True, schema: dict | None = None):
    """The checks of a manifest; schema: its JSON schema. The tasks' own schema is read if the manifest names one. A path that leaves the package is a finding."""
    artifacts, unsafe = [], []
    for a in (a for v in manifest["videos"] for a in v["artifacts"]):
        try:
            fs.safe_path(root, a["path"])
            artifacts.append((a["path"], int(a["bytes"]), a["sha256"]))
        except ValueError:
            unsafe.append((a["path"],))
    expected = spark.createDataFrame(artifacts, "path string, bytes long, sha256 string")
    there = fs.listing(spark, root)
    found = there.withColumn("sha256", F.lit(None).cast("string"))
    if hashes and artifacts:
        base = os.path.realpath(root).rstrip("/") + "/"
        sums = fs.hashes(spark, os.path.realpath(root), [base + p for p, *_ in artifacts])
        found = there.join(sums.select(F.expr(f"substring(path, locate('{base}', path) + {len(base)})").alias("path"), "sha256"), "path", "left")
    at = fs.safe_path(root, manifest["tasks"]["path"])
    tasks = fs.read_jsonl(spark, at, TASK).withColumn("shot_ids", F.col("evidence.shot_ids"))
    videos = spark.createDataFrame([(v["video_id"], int(v["duration_ms"])) for v in manifest["videos"]], "video_id string, duration_ms long")
    schemas = {}
    if schema is not None:
        schemas["manifest_json_schema"] = au.json_errors(spark.createDataFrame([("manifest", json.dumps(manifest))], "key string, text string"), "key", "text", schema)
    if named := manifest["tasks"].get("schema"):
        with open(fs.safe_path(root, named), encoding="utf-8") as f:
            of_tasks = json.load(f)
        lines = spark.read.text(at).where(F.trim("value") != "").select(F.coalesce(F.get_json_object("value", "$.task_id"), F.lit("?")).alias("key"), "value")
        schemas["task_json_schema"] = au.json_errors(lines, "key", "value", of_tasks)
    outside = spark.createDataFrame(unsafe, "path string") if unsafe else None
    return au.manifest_checks(expected, found, tasks, videos, int(manifest["capacity"]["hard_limit_bytes"]), int(manifest["tasks"]["count"]), hashes, schemas, outside)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("manifest")
    p.add_argument("--root", default=".")
    p.add_argument("--schema", help="JSON schema of the manifest")
    p.add_argument("--skip-hashes", action="store_true")
    args = p.parse_args(argv)
    with open(args.manifest, encoding="utf-8") as f:
        manifest = json.load(f)
    schema = None
    if args.schema:
        with open(args.schema, encoding="utf-8") as f:
            schema = json.load(f)
    checks = audit(local_session(4), manifest, args.root, not args.skip_hashes, schema).collect()
    print(json.dumps({"passed": all(c.passed for c in checks), "checks": [c.asDict() for c in checks]}, indent=1))
    return int(not all(c.passed for c in checks))


if __name__ == "__main__":
    sys.exit(main())
