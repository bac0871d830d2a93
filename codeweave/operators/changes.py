"""Change operators: merges, diffs, incremental scans, sessions, learned corrections, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """target with the columns of updates set where the key exists, and its other rows inserted."""
    new = updates.select(key, F.struct(*(c for c in updates.columns if c != key)).alias("_new"))
    out = target.join(new, key, "full_outer")
    columns = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in updates.columns and c != key else F.col(c) for c in target.columns]
    return out.select(columns)


def semantic_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, name, kind, change, old_file) between two versions of (file, name, kind, hash).

    SIGNATURE_CHANGED where both hashes are there and differ; what only the new one has is MOVED if the old one has its name and kind
    in another file (the smallest is told), else ADDED; what only the old one has is REMOVED unless its name and kind moved.
    """
    key = ["file", "name", "kind"]
    both = old.select(*key, F.col("hash").alias("before")).join(new.select(*key, F.col("hash").alias("after")), key, "full_outer")
    elsewhere = old.select("name", "kind", F.col("file").alias("other")).distinct()
    added = both.where("before is null")
    source = added.join(elsewhere, ["name", "kind"]).where("other <> file").groupBy(*key).agg(F.min("other").alias("old_file"))
    added = added.join(source, key, "left").select(*key, F.when(F.col("old_file").isNotNull(), "MOVED").otherwise("ADDED").alias("change"), "old_file")
    changed = both.where("before <> after and before <> '' and after <> ''").select(*key, F.lit("SIGNATURE_CHANGED").alias("change"), F.lit(None).cast("string").alias("old_file"))
    moved = added.where("change = 'MOVED'").select("name", "kind").distinct()
    removed = both.where("after is null").join(moved, ["name", "kind"], "left_anti").select(*key, F.lit("REMOVED").alias("change"), F.lit(None).cast("string").alias("old_file"))
    return added.unionByName(changed).unionByName(removed)


def changed_files(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """Rows of scanned(path, content_hash, ...) that stored(path, content_hash) doesn't hold as they are."""
    return scanned.join(stored.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def latest_sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Per user_id, the events of the newest cluster: walking back from the newest until a gap is larger: (user_id, events, first_ts, last_ts)."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    gap = F.expr("timestampdiff(MICROSECOND, ts, newer)")
    marked = events.select("user_id", "event_id", "ts", F.lag("ts").over(newest).alias("newer"))
    marked = marked.withColumn("cut", F.when(gap > gap_seconds * 1_000_000, 1).otherwise(0))
    group = marked.withColumn("group", F.sum("cut").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return group.where("group = 0").groupBy("user_id").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def learned_confidence(seen: DataFrame) -> DataFrame:
    """(file, name, target, confidence): 0.5 and 0.1 more for each repetition, at most 1; seen(file, name, target) a row an observation."""
    return seen.groupBy("file", "name", "target").agg(F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * (F.count("*") - 1)).alias("confidence"))


def hunks(diff: DataFrame) -> DataFrame:
    """(commit, file, start_line, end_line) on the new side of unified diffs diff(commit, text); a pure deletion counts as its line."""
    rows = diff.select("commit", F.posexplode(F.split("text", "\n")).alias("pos", "row"))
    order = Window.partitionBy("commit").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    file = F.last(F.when(F.col("row").startswith("+++ b/"), F.substring("row", 7, 1_000_000)), True).over(order)
    heads = rows.withColumn("file", file).where(F.col("row").rlike(r"^@@ -\S+ \+\d+"))
    start = F.regexp_extract("row", r"\+(\d+)", 1).cast("long")
    count = F.coalesce(F.nullif(F.regexp_extract("row", r"\+\d+,(\d+)", 1), F.lit("")).cast("long"), F.lit(1))
    return heads.select("commit", "file", start.alias("start_line"), (start + F.greatest(count, F.lit(1)) - 1).alias("end_line"))


# Signals of a commit subject: (pattern, type, weight).
SIGNALS = (
    ("fix|bug|patch", "BugFix", 3), ("refactor|rename|move|clean", "Refactor", 3), ("add|new|feature|implement", "Feature", 3),
    ("migrat|upgrade|convert|sqlite", "Migration", 5), ("config|setting|version bump", "Config", 3), ("test", "Test", 3), ("doc|readme", "Docs", 3),
)
TYPES = ("BugFix", "Refactor", "Feature", "Migration", "Config", "Test", "Docs")


def change_type(subjects: DataFrame) -> DataFrame:
    """(change, type, score): the type with the highest sum of signals over subjects(change, subject), Mixed without any."""
    sums = [F.sum(sum((F.when(F.lower("subject").rlike(p), w).otherwise(0) for p, t, w in SIGNALS if t == name), F.lit(0))).cast("long").alias(name) for name in TYPES]
    scored = subjects.groupBy("change").agg(*sums)
    best = F.greatest(*(F.col(t) for t in TYPES))
    kind = F.when(best == 0, "Mixed")
    for t in TYPES:
        kind = kind.when(F.col(t) == best, t)
    return scored.select("change", kind.alias("type"), best.alias("score"))


# Signals of a change's files (pattern, type, weight, least share of the files; 0: any) and of its symbols (change, type, weight, share above).
FILE_SIGNALS = (("test|spec", "Test", 5, 0.7), (r"\.(json|xml|yaml|yml|csproj|sln|cfg|pkg)$", "Config", 5, 0.7), (r"\.(md|txt|rst)$", "Docs", 5, 0.7), ("schema|migration|sql", "Migration", 3, 0))
DIFF_SIGNALS = (("MOVED", "Refactor", 3, 0.3), ("ADDED", "Feature", 3, 0.5), ("REMOVED", "Refactor", 2, 0.3))


def change_context(subjects: DataFrame, files: DataFrame, diff: DataFrame) -> DataFrame:
    """(change, type, scope, files, symbols): what a change is about, by subjects(change, subject), files(change, file), diff(change, kind_of_change).

    The type has the highest sum of signals of subjects (each kind of signal once), files and symbols; the first of equals, Mixed without any. The
    scope is Standalone up to two top folders.
    """
    told = {n: [(p, w) for p, t, w in SIGNALS if t == n] for n in TYPES}
    said = subjects.groupBy("change").agg(*(sum((F.max(F.when(F.lower("subject").rlike(p), w).otherwise(0)) for p, w in told[n]), F.lit(0)).alias(f"s_{n}") for n in TYPES))
    rows = files.select("change", "file").distinct()
    hits = rows.groupBy("change").agg(F.count("*").alias("files"), F.count_distinct(F.split_part("file", F.lit("/"), F.lit(1))).alias("folders"), *(F.count(F.when(F.col("file").rlike(p), 1)).alias(f"f_{k}") for k, (p, _, _, _) in enumerate(FILE_SIGNALS)))
    kinds = diff.groupBy("change").agg(F.count("*").alias("symbols"), *(F.count(F.when(F.col("kind_of_change") == c, 1)).alias(f"d_{k}") for k, (c, _, _, _) in enumerate(DIFF_SIGNALS)))
    both = hits.join(said, "change", "left").join(kinds, "change", "left").na.fill(0)
    score = {n: F.col(f"s_{n}") for n in TYPES}
    for k, (_, n, w, share) in enumerate(FILE_SIGNALS):
        score[n] = score[n] + F.when(F.col(f"f_{k}") > F.col("files") * share, w).otherwise(0)
    for k, (_, n, w, share) in enumerate(DIFF_SIGNALS):
        score[n] = score[n] + F.when(F.col(f"d_{k}") > F.greatest(F.col("symbols"), F.lit(1)) * share, w).otherwise(0)
    best = F.greatest(*score.values())
    kind = F.when(best == 0, "Mixed")
    for n in TYPES:
        kind = kind.when(score[n] == best, n)
    return both.select("change", kind.alias("type"), F.when(F.col("folders") <= 2, "Standalone").otherwise("CrossModule").alias("scope"), "files", "symbols")


def compare_quality(now: DataFrame, baseline: DataFrame, higher_is_worse: list[str]) -> DataFrame:
    """(metric, baseline, value, change, regression) for metrics (metric, value): percent change cut to whole numbers, over 2 % worse fails."""
    both = now.join(baseline.withColumnRenamed("value", "baseline"), "metric")
    percent = (F.col("value") - F.col("baseline")) * 100.0 / F.col("baseline")
    whole = F.when(percent < 0, F.ceil(percent)).otherwise(F.floor(percent)).cast("long")
    text = F.when(F.col("baseline") == 0, F.when(F.col("value") == 0, "same").otherwise(F.concat(F.lit("+"), F.col("value").cast("string")))).when(whole == 0, "same").otherwise(F.concat(F.when(whole > 0, "+").otherwise(""), whole.cast("string"), F.lit("%")))
    worse = F.when(F.col("baseline") == 0, F.lit(False)).otherwise(F.when(F.col("metric").isin(higher_is_worse), percent > 2.0).otherwise(percent < -2.0))
    return both.select("metric", "baseline", "value", text.alias("change"), worse.alias("regression"))


def outliers(named: DataFrame, least: int = 5) -> DataFrame:
    """(name, id, value, median): rows of named(name, id, value) more than 2 off their name's upper median, for names with ``least`` rows."""
    # The exact upper median from counts of distinct values, so that no name's values are gathered.
    value = named.groupBy("name", "value").agg(F.count("*").alias("n"))
    total = value.groupBy("name").agg(F.sum("n").alias("rows")).where(F.col("rows") >= least)
    until = F.sum("n").over(Window.partitionBy("name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    middle = value.withColumn("until", until).join(total, "name").where("until > floor(rows / 2)").groupBy("name").agg(F.min("value").alias("median"))
    return named.join(middle, "name").where(F.abs(F.col("value") - F.col("median")) > 2).select("name", "id", "value", "median")


def severity(score: Column) -> Column:
    """Label of a numeric severity score."""
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW")
