"""Integrity checks of media artefacts, tasks and manifests. Each check is a row (name, passed, details)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Splits that must not share a video; smoke tasks may be anywhere.
PRODUCTION_SPLITS = ("train", "val", "test")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def check(name: str, passed: Column, details: Column) -> list[Column]:
    return [F.lit(name).alias("name"), F.coalesce(passed, F.lit(True)).alias("passed"), F.coalesce(details.cast("string"), F.lit("")).alias("details")]


def union(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


#: Unlinked utterances that a check names unless told otherwise; of more it gives the number.
LISTED = 100

#: One record of the other side in a sum that counts those of one side by one.
OTHER = 1 << 32


def media_checks(shots: DataFrame, utterances: DataFrame, units: DataFrame, keyframes: DataFrame, videos: DataFrame, listed: int | None = LISTED, versions: Sequence[str] = ()) -> DataFrame:
    """(video_id, name, passed, details): seven checks of each video's records, all videos at once. listed: unlinked utterances that are named; None is all.

    shots: video_id, pos, shot_id, start_s, end_s, keyframe_path; utterances: video_id, utterance_id, start_ms, end_ms; units: video_id, pos, shot_id,
    start_ms, end_ms, keyframe_path, utterance_refs; keyframes: video_id, path (those that exist); videos: video_id, duration_ms, a row a video.

    versions: names of at most 62 versions that every video has, each of which is checked and returned by itself (video_id, version, name, ...). Every record but
    those of videos then has a column held, whose bit k says that version k has it: a record that versions share is shuffled once.

    Every record becomes a few rows (video, space, key), and what the checks ask is whether counts of a key agree, those of one side by one and those of the
    other by OTHER in one sum for each version, so that hash aggregates of whole numbers do and nothing is sorted. No window holds a video; a timeline is whole if at each
    point as many shots begin as end, the video's own begin and end being counted against them. Shots and units of a place are dealt out once and counted by
    their whole records, then by place. Only references are joined with their utterances.
    """
    every = range(max(1, len(versions)))
    held = lambda df: df if versions else df.withColumn("held", F.lit(1).cast("long"))
    shots, utterances, units, keyframes = map(held, (shots, utterances, units, keyframes))
    bit = lambda c, k: F.call_function("shiftright", F.col(c), F.lit(k)).bitwiseAND(1)
    sums = lambda c: [F.sum(bit("held", k) * c).alias(f"c{k}") for k in every]
    by_version = lambda df, *keys: df.select(*keys, F.posexplode(F.array(*[f"c{k}" for k in every])).alias("version", "c"))
    row = lambda space, key, w: F.struct(F.lit(space).alias("space"), key.cast("string").alias("key"), (w if isinstance(w, Column) else F.lit(w)).cast("long").alias("w"))
    tagged = lambda df, *rows: df.select("video_id", "held", F.explode(F.array(*rows)).alias("t")).select("video_id", "held", "t.*")
    n, m = F.col("c").bitwiseAND(F.lit(OTHER - 1)), F.call_function("shiftright", F.col("c"), F.lit(32))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))

    ms = shots.select("video_id", "pos", "shot_id", F.rint(F.col("start_s") * 1000).cast("long").alias("start_ms"), F.rint(F.col("end_s") * 1000).cast("long").alias("end_ms"), "keyframe_path", "held")
    backwards = F.when(F.col("end_ms") < F.col("start_ms"), 1).otherwise(0)
    keys = union([
        tagged(ms, row("point", F.col("start_ms"), 1), row("point", F.col("end_ms"), -1), row("back", F.lit(""), backwards), row("id", F.concat(F.lit("s:"), "shot_id"), 1), row("frame", F.col("keyframe_path"), 1)),
        tagged(videos.withColumn("held", F.lit((1 << len(every)) - 1).cast("long")), row("point", F.lit(0), -1), row("point", F.col("duration_ms"), 1)),
        tagged(utterances, row("id", F.concat(F.lit("u:"), "utterance_id"), 1)),
        tagged(keyframes, row("frame", F.col("path"), OTHER)),
    ]).groupBy("video_id", "space", "key").agg(*sums(F.col("w")))
    of = lambda space, c: total(F.when(F.col("space") == space, c))
    counted = by_version(keys, "video_id", "space", "key").groupBy("video_id", "version").agg(
        (of("point", (F.col("c") != 0).cast("long")) + of("back", F.col("c"))).alias("point"), of("id", (n > 1).cast("long")).alias("id"), of("id", n).alias("ids"), of("id", F.when(F.col("key").startswith("s:"), n)).alias("shots"),
        of("frame", F.when(m > 0, n)).alias("there"), of("frame", m).alias("found"),
    )

    # A place is right if it has one whole record, once as a shot and once as a unit; it counts 1 then, and more if it is wrong.
    record = ["video_id", "pos", "shot_id", "start_ms", "end_ms", "keyframe_path"]
    both = ms.select(*record, "held", F.lit(1).cast("long").alias("w")).unionByName(units.select(*record, "held", F.lit(OTHER).cast("long").alias("w")))
    whole = both.repartition("video_id", "pos").groupBy(*record).agg(*sums(F.col("w")))
    places = whole.groupBy("video_id", "pos").agg(*[F.sum(F.when(F.col(f"c{k}") == OTHER + 1, 1).when(F.col(f"c{k}") > 0, 2).otherwise(0)).alias(f"c{k}") for k in every])
    placed = by_version(places, "video_id").groupBy("video_id", "version").agg(total((F.col("c") > 0).cast("long")).alias("places"), total((F.col("c") > 1).cast("long")).alias("pos"))

    # Of all utterances the last end is held against the duration.
    sound = F.coalesce((F.col("start_ms") >= 0) & (F.col("start_ms") < F.col("end_ms")), F.lit(False))
    spans = utterances.groupBy("video_id").agg(*[F.struct(F.sum(bit("held", k)).alias("utterances"), F.sum(F.when(sound, 0).otherwise(bit("held", k))).alias("range"), F.max(F.when(bit("held", k) == 1, F.col("end_ms"))).alias("last")).alias(f"c{k}") for k in every])
    spans = by_version(spans, "video_id").select("video_id", "version", "c.*")

    refs = units.select("video_id", "held", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), F.explode("utterance_refs").alias("r")).select("video_id", "held", "a", "b", "r.*")
    links = by_version(union([tagged(utterances, row("", F.col("utterance_id"), 1)), tagged(refs, row("", F.col("utterance_id"), OTHER))]).groupBy("video_id", "key").agg(*sums(F.col("w"))), "video_id", "key")
    dangling = (n == 0) | F.col("key").isNull()
    linked = links.groupBy("video_id", "version").agg(total(F.when(m == 0, n)).alias("missing"), total(F.when(dangling, m).otherwise(n * m)).alias("refs"), total(F.when(dangling, m)).alias("inexact"))
    met = refs.join(utterances.select("video_id", "utterance_id", F.col("start_ms").alias("c"), F.col("end_ms").alias("d"), F.col("held").alias("of")), ["video_id", "utterance_id"])
    lo, hi = F.greatest("a", "c"), F.least("b", "d")
    fits = F.col("c").isNotNull() & (lo < hi) & (F.col("overlap_start_ms") == lo) & (F.col("overlap_end_ms") == hi) & (F.col("overlap_ms") == hi - lo)
    off = met.where(~F.coalesce(fits, F.lit(False))).select("video_id", F.col("held").bitwiseAND(F.col("of")).alias("held")).groupBy("video_id").agg(*sums(1))
    off = by_version(off, "video_id").withColumnRenamed("c", "inexact")

    figures = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [counted, placed, spans, linked, off])
    summed = figures.groupBy("video_id", "version").agg(F.max("last").alias("last"), *[total(c).alias(c) for c in figures.columns if c not in ("video_id", "version", "last")])
    loose, times = links.where((m == 0) & (n > 0)).select("video_id", "version", "key", n.alias("n")), F.col("n")
    if listed is not None:
        loose, times = loose.withColumn("r", F.row_number().over(Window.partitionBy("video_id", "version").orderBy("key"))).where(F.col("r") <= listed), F.least("n", F.lit(listed))
    named = loose.groupBy("video_id", "version").agg(F.array_join(F.array_sort(F.flatten(F.collect_list(F.array_repeat("key", times.cast("int"))))), ",").alias("names"))
    all_ = summed.join(named, ["video_id", "version"], "left").join(videos.groupBy("video_id").agg(F.min("duration_ms").alias("duration_ms")), "video_id", "left")
    zero = lambda c: F.col(c) == 0
    inside = zero("range") & ((F.col("utterances") == 0) | F.coalesce(F.col("last") <= F.col("duration_ms"), F.lit(False)))
    more = F.coalesce("names", F.lit(""))
    if listed is not None:
        more = F.concat(more, F.when(F.col("missing") > listed, F.format_string(" of %d", "missing")).otherwise(""))
    results = [
        ("shot_timeline_contiguous", zero("point") & (F.col("shots") > 0), F.col("shots")), ("record_ids_unique", zero("id"), F.col("ids")),
        ("one_keyframe_per_shot", (F.col("there") == F.col("shots")) & (F.col("found") == F.col("shots")), F.col("there")), ("utterances_within_timeline", inside, F.col("utterances")),
        ("evidence_units_match_shots", zero("pos"), F.col("places")), ("utterance_references_exact", zero("inexact"), F.col("refs")), ("all_utterances_linked", zero("missing"), more),
    ]
    checks = F.array(*[F.struct(F.lit(k).alias("name"), ok.alias("passed"), d.cast("string").alias("details")) for k, ok, d in results])
    version = [F.element_at(F.array(*map(F.lit, versions)), F.col("version") + 1).alias("version")] if versions else []
    return all_.where(F.col("video_id").isNotNull()).select("video_id", *version, F.explode(checks).alias("c")).select("video_id", *["version"] * bool(versions), "c.*")


def container_checks(probed: DataFrame, duration_ms: int) -> DataFrame:
    """Length within 100 ms, one video and one audio stream, matching hashes. probed: duration_ms, video_streams, audio_streams, sha256, expected_sha256."""
    return union([
        probed.select(*check("media_duration_matches", F.abs(F.col("duration_ms") - duration_ms) <= 100, F.col("duration_ms"))),
        probed.select(*check("media_stream_layout", (F.col("video_streams") == 1) & (F.col("audio_streams") == 1), F.concat_ws("/", "video_streams", "audio_streams"))),
        probed.select(*check("media_hashes_match", F.col("sha256") == F.col("expected_sha256"), F.col("sha256"))),
    ])


def split_leaks(tasks: DataFrame) -> DataFrame:
    """Videos in more than one production split, with the splits."""
    each = tasks.where(F.col("split").isin(*PRODUCTION_SPLITS)).groupBy("video_id").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return each.where(F.size("splits") > 1)


def task_errors(tasks: DataFrame, videos: DataFrame) -> DataFrame:
    """(task_id, error): one row for each rule that a task breaks; a task of an unknown video is not looked at further.

    tasks: task_id, video_id, split, query, target_segments array<struct<start_ms, end_ms>>, shot_ids array; videos: video_id, duration_ms.
    """
    known = tasks.join(videos.withColumn("there", F.lit(True)), "video_id", "left")
    on = F.col("there").isNotNull()
    bad = lambda s: s["start_ms"].isNull() | s["end_ms"].isNull() | ~((s["start_ms"] >= 0) & (s["start_ms"] < s["end_ms"]) & (s["end_ms"] <= F.col("duration_ms")))
    rules = [
        (~on, "unknown video_id"), (on & ~F.coalesce(F.col("split").isin("smoke", *PRODUCTION_SPLITS), F.lit(False)), "invalid split"), (on & (F.trim(F.coalesce("query", F.lit(""))) == ""), "empty query"),
        (on & F.coalesce(F.exists("target_segments", bad), F.lit(False)), "invalid target"), (on & (F.coalesce(F.size("shot_ids"), F.lit(0)) <= 0), "no grounded shot evidence"),
    ]
    broken = known.select("task_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in rules]), lambda x: x.isNotNull())).alias("error"))
    return broken.unionByName(duplicates(tasks, "task_id").select("task_id", F.lit("duplicate task_id").alias("error")))


def task_checks(tasks: DataFrame, videos: DataFrame) -> DataFrame:
    leaks = split_leaks(tasks).agg(F.count("*").alias("n"))
    errors = task_errors(tasks, videos).agg(F.count("*").alias("e")).join(leaks)
    return union([errors.select(*check("task_schema_and_ranges", (F.col("e") == 0) & (F.col("n") == 0), F.col("e"))), leaks.select(*check("video_level_split_isolation", F.col("n") == 0, F.col("n")))])


def artifact_errors(expected: DataFrame, files: DataFrame, hashes: bool = True) -> DataFrame:
    """(path, error) of artefacts (path, bytes, sha256) that are missing or differ in size or hash from files of the same columns."""
    j = expected.join(files.select("path", F.col("bytes").alias("b"), F.col("sha256").alias("h")), "path", "left")
    rules = [(F.col("b").isNull(), "missing"), (F.col("b") != F.col("bytes"), "size mismatch")] + [(F.upper("h") != F.upper("sha256"), "sha256 mismatch")] * hashes
    return j.select("path", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in rules]), lambda x: x.isNotNull())).alias("error"))


def schema_errors(df: DataFrame, key: str, required: list[str], enums: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, error): required fields that are null and fields outside their values, as column predicates."""
    rules = [(F.col(c).isNull(), f"'{c}' is a required property") for c in required] + [(F.col(c).isNotNull() & ~F.col(c).isin(*v), f"{c} is not one of its values") for c, v in enums.items()]
    return df.select(key, F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in rules]), lambda x: x.isNotNull())).alias("error"))


#: How a variant's type begins, for each type of a JSON schema.
JSON_TYPES = {"string": "STRING", "number": "(BIGINT|DOUBLE|DECIMAL|FLOAT)", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT", "null": "VOID"}


def json_errors(df: DataFrame, key: str, text: str, schema: dict) -> DataFrame:
    """(key, error): a row for each rule of a JSON schema that a text breaks; a text that is no JSON breaks one.

    Known rules: type (one or a list), const and enum (of texts, numbers, booleans and null), minLength, pattern, minimum, maximum, required, properties,
    minItems, items (nested as deep as the schema is). As JSON Schema has it, a number without a fraction is an integer however it is written, and 1 is not true. The schema becomes one
    expression over a parsed variant, so rows are checked in the plan.
    """
    rows = df.select(key, F.try_parse_json(text).alias("__v"))
    broken = F.when(F.col("__v").isNull(), F.array(F.lit("not JSON"))).otherwise(_broken(F.col("__v"), schema, "$"))
    return rows.select(key, F.explode(F.array_compact(broken)).alias("error"))


def _broken(v: Column, schema: dict, at: str) -> Column:
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    said = lambda bad, message: F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{at}: {message}"))

    def is_(name):
        if name == "integer":
            return is_("number") & F.coalesce(number == F.floor(number), F.lit(False))
        return F.coalesce(kind.rlike(f"^{JSON_TYPES[name]}"), F.lit(False))

    def equals(value):
        """Of the value's own type, so that neither 1 nor "true" is true."""
        if value is None:
            return is_("null")
        if isinstance(value, bool):
            return is_("boolean") & F.coalesce(F.try_variant_get(v, "$", "boolean") == value, F.lit(False))
        if isinstance(value, (int, float)):
            return is_("number") & F.coalesce(number == float(value), F.lit(False))
        return is_("string") & F.coalesce(text == value, F.lit(False))

    found = []
    if "type" in schema:
        types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        found.append(said(~reduce(lambda a, t: a | is_(t), types, F.lit(False)), f"is not of type {' or '.join(types)}"))
    if "const" in schema:
        found.append(said(~equals(schema["const"]), f"is not {json.dumps(schema['const']) if not isinstance(schema['const'], str) else schema['const']}"))
    if "enum" in schema:
        found.append(said(~reduce(lambda a, x: a | equals(x), schema["enum"], F.lit(False)), "is not one of its values"))
    if "minLength" in schema:
        found.append(said(is_("string") & (F.length(text) < schema["minLength"]), "is too short"))
    if "pattern" in schema:
        found.append(said(is_("string") & ~text.rlike(schema["pattern"]), "does not match its pattern"))
    if "minimum" in schema:
        found.append(said(is_("number") & (number < schema["minimum"]), f"is less than {schema['minimum']}"))
    if "maximum" in schema:
        found.append(said(is_("number") & (number > schema["maximum"]), f"is greater than {schema['maximum']}"))
    member = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    found += [said(is_("object") & member(name).isNull(), f"{name} is a required property") for name in schema.get("required", [])]
    nested = [F.when(is_("object") & member(name).isNotNull(), _broken(member(name), part, f"{at}.{name}")) for name, part in schema.get("properties", {}).items()]
    items = F.try_variant_get(v, "$", "array<variant>")
    if "minItems" in schema:
        found.append(said(is_("array") & (F.size(items) < schema["minItems"]), "has too few items"))
    if "items" in schema:
        nested.append(F.when(is_("array"), F.flatten(F.transform(items, lambda x: _broken(x, schema["items"], f"{at}[]")))))
    none = F.array().cast("array<string>")
    return F.concat(F.array(*found).cast("array<string>") if found else none, *[F.coalesce(n, none) for n in nested])


def manifest_checks(expected: DataFrame, files: DataFrame, tasks: DataFrame, videos: DataFrame, capacity: int, count: int, hashes: bool = True, schemas: dict[str, DataFrame] | None = None, unsafe: DataFrame | None = None) -> DataFrame:
    """Capacity, artefacts, hashes, tasks and their number; for each of schemas (name of the check: errors, as json_errors gives them) a check of it.

    unsafe: paths that leave the package, which are findings of the check of paths.
    """
    used = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"))
    errors = artifact_errors(expected, files, hashes)
    if unsafe is not None:
        errors = errors.unionByName(unsafe.select("path", F.lit("leaves the package").alias("error")))
    found = errors.agg(F.sum((F.col("error") != "sha256 mismatch").cast("int")).alias("p"), F.sum((F.col("error") == "sha256 mismatch").cast("int")).alias("h"))
    n = tasks.agg(F.count("*").alias("n"))
    return union([
        *[e.agg(F.count("*").alias("n")).select(*check(name, F.col("n") == 0, F.col("n"))) for name, e in (schemas or {}).items()],
        used.select(*check("offline_package_capacity", F.col("b") <= capacity, F.col("b"))),
        found.select(*check("artifact_paths_and_sizes", F.coalesce("p", F.lit(0)) == 0, F.col("p"))), found.select(*check("artifact_hashes", F.coalesce("h", F.lit(0)) == 0, F.col("h"))),
        task_checks(tasks, videos), n.select(*check("task_count", F.col("n") == count, F.col("n"))),
    ])


def orphans(rows: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Rows whose file is not listed."""
    return rows.join(listing, key, "left_anti")


def numbered(df: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*on).orderBy(*order)) - 1)
