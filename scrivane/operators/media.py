"""Walkthroughs, captions and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivane.functions.text import citation_time, clean_narration, finite, resolve_corrections, vtt_time

PLAYBOOK = "id string, title string, duration double, steps array<struct<id:string,kind:string,title:string,description:string,duration:string,audioNote:struct<markdown:string>,subtitles:array<struct<text:string,start:double,end:double>>>>"
CUES = "array<struct<text:string,start:double,end:double>>"
READ_BUDGET = 2_000_000


def parse_playbook(payload: Column, expected: Column) -> Column:
    """The record of a JSON text, null if it is not the expected one."""
    p = F.from_json(payload, PLAYBOOK)
    return F.when(p["id"] == expected, p)


def playbook_id(url: Column, service: str = "guides.example") -> Column:
    """The id in the path of the service's own hosts, else its `id` parameter."""
    from scrivane.functions.url import host, path, same_service

    in_path = F.regexp_extract(path(url), r"/(?:playbooks|embed|share)/([A-Za-z0-9_-]{16,64})(?:/|$)", 1)
    asked = F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]{16,64})(?:&|#|$)", 1)
    found = F.when(in_path != "", in_path).when(asked != "", asked)
    return F.when(same_service(host(url), F.lit(service)), found)


def embeds(pages: DataFrame, id: str = "page_id", html: str = "html", service: str = "guides.example") -> DataFrame:
    """First place of each embedded walkthrough: (id, playbook, pos)."""
    urls = F.regexp_extract_all(F.col(html), F.lit(r'\s(?:src|data-src|href|data-url|data-embed|data|content)="([^"]*)"'), F.lit(1))
    found = pages.select(id, F.posexplode(urls).alias("pos", "u")).withColumn("playbook", playbook_id(F.col("u"), service)).where("playbook is not null")
    return found.groupBy(id, "playbook").agg(F.min("pos").alias("pos"))


def step_rows(playbooks: DataFrame, key: str = "playbook", record: str = "p") -> DataFrame:
    """One row per step with its start: the sum of the durations before it; durations that are no finite number are 0."""
    rows = playbooks.select(F.col(key), F.posexplode(F.col(f"{record}.steps")).alias("n", "step")).withColumn("duration", F.greatest(finite(F.col("step.duration")), F.lit(0.0)))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("duration").over(w), F.lit(0.0)))


def _narration() -> Column:
    return resolve_corrections(clean_narration(F.coalesce("step.audioNote.markdown", F.lit(""))))


def _cues() -> Column:
    """A step's own cues on the step's clock, else one over its length where it is narrated."""
    stand_in = F.array(F.struct(_narration().alias("text"), F.lit(0.0).alias("start"), F.col("duration").alias("end")))
    return F.when(F.coalesce(F.size("step.subtitles"), F.lit(0)) > 0, F.col("step.subtitles")).when(_narration() != "", stand_in)


def _timed(cue: Column, offset: Column) -> Column:
    """struct<text, start, end> on the whole's clock; no cue ends before it starts."""
    start = offset + F.coalesce(cue["start"], F.lit(0.0))
    return F.struct(resolve_corrections(cue["text"]).alias("text"), start.alias("start"), F.greatest(start, offset + F.coalesce(cue["end"], F.lit(0.0))).alias("end"))


def step_cues(steps: DataFrame, key: str = "playbook") -> DataFrame:
    """Cues on the whole's clock; a step with narration and no cue has one over its length."""
    rows = steps.select(key, "n", F.col("start").alias("offset"), F.posexplode(_cues()).alias("c", "cue"))
    return rows.select(key, "n", "c", _timed(F.col("cue"), F.col("offset")).alias("t")).select(key, "n", "c", "t.*")


def steps_payload(steps: DataFrame, key: str = "playbook", header: dict[str, Column] | None = None) -> DataFrame:
    """(key, payload): the JSON of a walkthrough, its header and a record for each row of step_rows, with the step's cues.

    header: fields by name, functions of the group's rows (such as F.first of a column); the length of all steps is one of them.
    """
    seconds = lambda c: F.round(c, 3)
    cue = lambda c: F.struct(c["text"].alias("text"), seconds(c["start"]).alias("start_seconds"), seconds(c["end"]).alias("end_seconds"), citation_time(c["start"]).alias("timestamp"))
    cues = F.transform(F.coalesce(_cues(), F.array().cast(CUES)), lambda c: _timed(c, F.col("start")))
    text = F.trim(F.array_join(F.transform(cues, lambda c: c["text"]), " "))
    title = F.trim(F.coalesce("step.title", F.lit("")))
    record = F.struct(
        (F.col("n") + 1).alias("number"), F.col("step.id").alias("id"), F.col("step.kind").alias("kind"), title.alias("title"), instruction(F.col("step.description"), _narration(), text, title).alias("instruction"),
        _narration().alias("narration"), ((_narration() == "") & (F.size(cues) == 0)).alias("silent"), seconds(F.col("start")).alias("start_seconds"), seconds(F.col("start") + F.col("duration")).alias("end_seconds"),
        seconds(F.col("duration")).alias("duration_seconds"), citation_time(F.col("start")).alias("timestamp"), F.transform(cues, cue).alias("transcript"))
    rows = steps.withColumn("_record", record)
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "_record"))).alias("s"), seconds(F.sum("duration")).alias("duration_seconds"), *[c.alias(f"_h_{k}") for k, c in (header or {}).items()])
    fields = [F.col(f"_h_{k}").alias(k) for k in header or {}]
    return whole.select(key, F.to_json(F.struct(*fields, "duration_seconds", F.transform("s", lambda x: x["_record"]).alias("steps"))).alias("payload"))


def instruction(description: Column, narration: Column, cues: Column, title: Column) -> Column:
    """The first that says something."""
    said = [F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c)) for c in (description, narration, cues, title)]
    return F.coalesce(*said, F.lit(""))


def vtt(cues: DataFrame, key: str) -> DataFrame:
    """(key, vtt): cues (start, end, text) numbered in order."""
    cue = lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), vtt_time(c.start), F.lit(" --> "), vtt_time(c.end), F.lit("\n"), c.text)
    return cues.groupBy(key).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "text"))), cue), "\n\n"), F.lit("\n")).alias("vtt"))


def track_role(readable: Column, cues: Column, kind: Column) -> Column:
    return F.when(~readable, "unreadable").when(cues == 0, "empty").when(kind == "subtitles", "translation").otherwise(kind)


def is_transcript(readable: Column, cues: Column, kind: Column) -> Column:
    return readable & (cues > 0) & (kind == "captions")


def transcript_of(tracks: DataFrame, key: str) -> DataFrame:
    """The first track that is a transcript, per medium."""
    good = tracks.where(is_transcript(F.col("readable"), F.col("cues"), F.col("kind")))
    return good.groupBy(key).agg(F.min_by(F.struct("pos", "lang", "label"), "pos").alias("track"))


def untranscribed_note(tracks: Column) -> Column:
    """Why a medium has no transcript, from its tracks array<struct<readable, kind>>."""
    return F.when(F.coalesce(F.size(tracks), F.lit(0)) <= 0, "no track").when(~F.exists(tracks, lambda t: t.readable), "no track could be read").otherwise("only translations")


def bounded_cues(cues: DataFrame, key: str, order: str, budget: int = READ_BUDGET) -> DataFrame:
    """Cues while less than the budget has been read before them, and whether the track was cut."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = cues.withColumn("before", before).withColumn("all_", F.count(F.lit(1)).over(Window.partitionBy(key)))
    kept = kept.where(F.col("before") < budget)
    return kept.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy(key)) < F.col("all_")).drop("before", "all_")


def media_title(raw: Column) -> Column:
    """struct<title, reason>: the part before a reading's marker; texts of several lines are refused."""
    head = F.trim(F.get(F.split(raw, r" \| "), 0))
    return F.when(F.contains(raw, F.lit("\n")), F.struct(F.lit("").alias("title"), F.lit("several lines").alias("reason"))).otherwise(F.struct(head.alias("title"), F.lit("").alias("reason")))


def tally(videos: DataFrame) -> DataFrame:
    """Counts that add up: read, failed, without a transcript, and all."""
    return videos.agg(F.count_if("transcript").alias("transcribed"), F.count_if(~F.col("transcript") & F.col("readable")).alias("gaps"), F.count_if(~F.col("readable")).alias("failed"), F.count(F.lit(1)).alias("videos"))
