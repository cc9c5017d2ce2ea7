"""Outlines as tables (node_id, parent_id, level, ordinal, title, listed): ids, counts, diffs, references, media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivane.functions.text import clock_micros
from scrivane.operators.titles import cross_references  # noqa: F401

LEVELS = ("course", "part", "chapter", "module", "lesson")


def synthetic_id(parent: Column, level: Column, ordinal: Column) -> Column:
    """parent/level-NN: two digits at least, so the ids sort depth-first up to 99 siblings."""
    return F.concat_ws("/", parent, F.concat(level, F.lit("-"), F.format_string("%02d", ordinal)))


def ordinals(nodes: DataFrame, parent: str, order: str) -> DataFrame:
    return nodes.withColumn("ordinal", F.row_number().over(Window.partitionBy(parent).orderBy(order)))


def renumbered(levels: list[DataFrame]) -> DataFrame:
    """Ids from sibling ordinals, level by level. Each level has (key, parent_key, title, listed); the first has null parents."""
    out = None
    above = None
    for depth, level in enumerate(levels):
        rows = ordinals(level, "parent_key", "key")
        name = F.lit(LEVELS[depth])
        if above is None:
            rows = rows.withColumn("parent_id", F.lit(None).cast("string")).withColumn("node_id", synthetic_id(F.lit(None).cast("string"), name, F.col("ordinal")))
        else:
            rows = rows.join(above, "parent_key").withColumn("node_id", synthetic_id(F.col("parent_id"), name, F.col("ordinal")))
        rows = rows.select("node_id", "parent_id", name.alias("level"), "ordinal", "key", "title", "listed")
        above = rows.select(F.col("key").alias("parent_key"), F.col("node_id").alias("parent_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def count_failures(nodes: DataFrame) -> DataFrame:
    """Nodes whose stated number of children is not the real one; null states nothing."""
    real = nodes.groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"))
    both = nodes.where("listed is not null").join(real, "node_id", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    return both.where("listed <> children").select("node_id", "listed", "children")


def outline_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    from scrivane.operators.quality import snapshot_diff

    names = {"missing": "vanished", "unexpected": "appeared", "changed": "changed"}
    d = snapshot_diff(first, second, "node_id", "title")
    return d.replace(names, subset=["state"])


def outline_digest(nodes: DataFrame) -> DataFrame:
    """One digest of all rows, whatever their order: sums of the parts of the rows' digests, so no task ever holds them together."""
    digest = F.sha2(F.to_json(F.struct("node_id", "level", "title")), 256)
    parts = [F.sum(F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    sums = nodes.agg(F.count(F.lit(1)).alias("n"), *parts)
    return sums.select(F.sha2(F.concat_ws("/", "n", *[F.coalesce(f"s{i}", F.lit(0)).cast("string") for i in range(4)]), 256).alias("digest"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node_id, trail): titles from the root down, by the prefixes of the id."""
    parts = F.split("node_id", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    steps = nodes.select("node_id", F.posexplode(prefixes).alias("depth", "at"))
    named = steps.join(nodes.select(F.col("node_id").alias("at"), "title"), "at")
    return named.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "title"))), lambda s: s.title).alias("trail"))


def resumed(nodes: DataFrame, done: DataFrame, digest: str, recorded: str) -> DataFrame:
    if digest != recorded:
        raise ValueError("the outline has changed since the run that is resumed")
    return nodes.join(done, "node_id", "left_anti")


def unaccounted(nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    return nodes.where("level = 'module'").join(outcomes, "node_id", "left_anti")


def index(nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Modules by status; those without an outcome were not reached."""
    m = nodes.where("level = 'module'").join(outcomes, "node_id", "left")
    return m.select("node_id", "title", F.coalesce("status", F.lit("not-reached")).alias("status"))


def captured_directories(nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(node_id, directory) of the modules that were captured: a slug for each level below the root, by title and ordinal.

    Only the captured modules are taken apart, and each meets its own ancestors by their ids.
    """
    from scrivane.operators.records import ordinal_slug

    captured = nodes.where("level = 'module'").join(outcomes.where("status = 'captured'").select("node_id").distinct(), "node_id", "left_semi")
    parts = F.split("node_id", "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    steps = captured.where(F.size(parts) > 1).select("node_id", F.posexplode(prefixes).alias("depth", "at"))
    slugs = nodes.select(F.col("node_id").alias("at"), ordinal_slug(F.col("title"), F.col("ordinal")).alias("slug"))
    named = steps.join(slugs, "at").groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("depth", "slug"))).alias("s"))
    return named.select("node_id", F.array_join(F.transform("s", lambda x: x.slug), "/").alias("directory"))


def refused(nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(entry, node_id, title, status): below each entry, and as itself, every module that was not captured."""
    left = index(nodes, outcomes).where("status <> 'captured'")
    parts = F.split("node_id", "/")
    entries = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return left.select(F.explode(entries).alias("entry"), "node_id", "title", "status")


def measured_total(videos: DataFrame, key: str) -> DataFrame:
    """A total only where every video has a duration, of rows (key, duration)."""
    return videos.groupBy(key).agg(F.when(F.count("duration") == F.count(F.lit(1)), F.sum("duration")).alias("total"))


def reconcile(expected: DataFrame, seen: DataFrame, key: str = "title") -> DataFrame:
    e, s = expected.select(key).distinct(), seen.select(key).distinct()
    return e.join(s, key, "left_anti").withColumn("state", F.lit("missing")).unionByName(s.join(e, key, "left_anti").withColumn("state", F.lit("extra")))


#: Candidates of a title that are gathered in one array, about; those that references meet at once, and the references that meet them together, at most.
CANDIDATES, SLICE, MET = 4096, 256, 64


def cross_reference_candidates(references: DataFrame, titles: DataFrame) -> DataFrame:
    """Every node that a reference may mean, a row each: (source, title, candidate), of cross_references(texts, titles).

    A reference that is resolved means its target. The nodes of the other titles stand in
    arrays of about CANDIDATES, dealt by hash, whose slices are broadcast; the references are
    dealt over all cores before they meet them, as few small references may become very many
    rows. MET references of a title meet a slice together: the nodes of a slice of 256 repeat
    on bounds of bytes however many bits a node takes, so the files of such rows are small.
    """
    clean = titles.select(F.trim("title").alias("title"), F.col("node_id").alias("candidate")).where("title <> ''").distinct()
    shared = clean.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    part = F.pmod(F.xxhash64("candidate"), F.ceil(F.col("n") / CANDIDATES))
    arrays = clean.join(shared, "title").groupBy("title", part.alias("part")).agg(F.collect_list(F.struct("candidate")).alias("s"))  # nulls stay
    slices = arrays.select("title", F.explode(F.transform(F.sequence(F.lit(0), F.size("s") - 1, F.lit(SLICE)), lambda i: F.slice("s.candidate", i + 1, SLICE))).alias("nodes"))
    tasks = 4 * references.sparkSession.sparkContext.defaultParallelism
    dealt = references.select("source", "title", "target").repartition(tasks, "source", "title").sortWithinPartitions("title", "source")  # sorted, so that a task that runs again numbers its rows alike
    numbered = dealt.withColumn("block", F.floor(F.monotonically_increasing_id() / MET)).repartition(tasks, "title", "block")
    blocks = numbered.groupBy("title", "block", "target").agg(F.collect_list(F.struct("source")).alias("s"))
    met = blocks.join(F.broadcast(slices), "title", "left").select("title", F.explode("s.source").alias("source"), F.coalesce("nodes", F.array("target")).alias("nodes"))
    return met.select("source", "title", F.explode("nodes").alias("candidate"))


def media_store(files: DataFrame) -> DataFrame:
    """Content-addressed: (sha256, bytes, refs, nodes, shared) of rows (node_id, path, content digest and size).

    Counts come by partial aggregation, and `first` is the least path; every
    referrer is a row of media_references, so no group is gathered.
    """
    return files.groupBy("sha256").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("refs"), F.count_distinct("node_id").alias("nodes"), F.min("path").alias("first")).withColumn("shared", F.col("nodes") > 1)


def media_references(files: DataFrame) -> DataFrame:
    """The referrers of the store's entries, a row each: (sha256, node_id, path)."""
    return files.select("sha256", "node_id", "path")


def gaps(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Seconds since the one before, per key."""
    w = Window.partitionBy(key).orderBy(ts)
    seconds = clock_micros(F.col(ts)) / 1e6
    return events.withColumn("gap", seconds - F.lag(seconds).over(w))


def render(nodes: DataFrame) -> DataFrame:
    """Markdown lines of an outline in depth-first order, by root."""
    depth = F.size(F.split("node_id", "/")) - 1
    line = F.concat(F.repeat(F.lit("  "), depth), F.lit("- "), F.col("title"))
    root = F.get(F.split("node_id", "/"), 0)
    return nodes.groupBy(root.alias("root")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", line.alias("line")))), lambda s: s.line), "\n").alias("markdown"))
