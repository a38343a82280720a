"""The note store as plans over tables: every mutation returns the new table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import author_slug, parse_time, sync_id, type_of_topic
from ..model import RELATION_TYPES, invalid
from ..storage import materialize

KEY = ["topic_key", "scope", "project"]


def live(notes: DataFrame) -> DataFrame:
    return notes.filter("deleted_at is null")


def with_defaults(incoming: DataFrame) -> DataFrame:
    """Saves with scope, title and type filled in: project, the topic, the topic's type."""
    return incoming.withColumns(
        {
            "scope": F.coalesce(F.nullif("scope", F.lit("")), F.lit("project")),
            "title": F.coalesce(F.nullif("title", F.lit("")), F.col("topic_key")),
            "type": F.coalesce(F.nullif("type", F.lit("")), type_of_topic(F.col("topic_key"))),
        }
    )


def _given(new: str, old: str) -> Column:
    return F.coalesce(F.nullif(new, F.lit("")), F.col(old))


def upsert(notes: DataFrame, incoming: DataFrame) -> DataFrame:
    """notes after saving one incoming row a key: (topic_key, scope, project, title, content, type, source,
    author, saved_at). A new key becomes revision 1; equal content only moves updated_at; other content
    raises the revision and replaces title and content, and type, source and author where given. Rows with
    an empty topic or an unknown type are rejected: invalid_saves lists them."""
    good = with_defaults(valid_saves(incoming))
    n = good.select(*KEY, *(F.col(c).alias(f"n_{c}") for c in ("title", "content", "type", "source", "author", "saved_at")))
    old, dead = live(notes), notes.filter("deleted_at is not null")
    j = old.withColumn("had", F.lit(True)).join(n, KEY, "full_outer")
    fresh, touched = F.col("had").isNull(), F.col("n_saved_at").isNotNull()
    changed = touched & ~fresh & ~F.col("content").eqNullSafe(F.col("n_content"))
    new_id = F.concat(F.lit("note-"), F.substring(F.sha2(F.concat_ws("\0", *KEY), 256), 1, 16))
    values = {
        "id": F.coalesce("id", new_id),
        "title": F.when(fresh | changed, F.col("n_title")).otherwise(F.col("title")),
        "content": F.when(fresh | changed, F.col("n_content")).otherwise(F.col("content")),
        "type": F.when(fresh, F.col("n_type")).when(changed, _given("n_type", "type")).otherwise(F.col("type")),
        "source": F.when(fresh, F.col("n_source")).when(changed, _given("n_source", "source")).otherwise(F.col("source")),
        "author": F.when(fresh, F.col("n_author")).when(changed, _given("n_author", "author")).otherwise(F.col("author")),
        "revision": F.when(fresh, 1).when(changed, F.col("revision") + 1).otherwise(F.col("revision")),
        "created_at": F.coalesce("created_at", "n_saved_at"),
        "updated_at": F.coalesce("n_saved_at", "updated_at"),
        "sync_id": F.coalesce("sync_id", sync_id(F.col("scope"), F.col("topic_key"))),
        "imported": F.coalesce("imported", F.lit(False)),
    }
    kept = [c for c in notes.columns]
    out = j.select(*((values[c] if c in values else F.col(c)).alias(c) for c in kept))
    return out.unionByName(dead)


def valid_saves(incoming: DataFrame) -> DataFrame:
    return incoming.join(invalid_saves(incoming), incoming.columns, "left_anti")


def invalid_saves(incoming: DataFrame) -> DataFrame:
    """Saves with an empty topic or a type that there is not."""
    from ..model import NOTE_TYPES

    return incoming.filter("coalesce(topic_key, '') = ''").unionByName(invalid(incoming.filter("coalesce(topic_key, '') <> ''"), "type", NOTE_TYPES))


def fold_saves(saves: DataFrame, order: str = "ord") -> DataFrame:
    """One row a key of a batch that saves keys repeatedly: as if saved one by one into an empty store.
    (topic_key, scope, project, title, content, type, source, author, revision, saved_at). A save of the same content
    as the one before only moves saved_at; saves of one place in the order go by title and content."""
    cols = ["type", "source", "author"]
    w = Window.partitionBy(*KEY).orderBy(order, "title", "content")
    n = F.row_number().over(w)
    ranked = with_defaults(saves).withColumns({"_n": n, "_kept": (n == 1) | ~F.col("content").eqNullSafe(F.lag("content").over(w))})
    # Of saves that count: the last one's title and content, and of the other fields the last that was given.
    at = F.when(F.col("_kept"), F.col("_n"))
    given = {c: F.max_by(c, F.when(F.col("_kept") & ((F.col("_n") == 1) | (F.coalesce(c, F.lit("")) != "")), F.col("_n"))).alias(c) for c in cols}
    return ranked.groupBy(*KEY).agg(*(F.max_by(c, at).alias(c) for c in ("title", "content")), *given.values(), F.count_if("_kept").cast("int").alias("revision"), F.max_by("saved_at", "_n").alias("saved_at"))


def append_keyless(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """notes and new rows without a key, each with an id of its own. The new rows are written with their ids, so that
    they are the same whenever they are read."""
    own = F.expr("uuid()")
    new = materialize(rows.withColumn("id", F.coalesce("id", own) if "id" in rows.columns else own), "keyless")
    return notes.unionByName(new, allowMissingColumns=True)


def import_legacy(notes: DataFrame, metadata: DataFrame, legacy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, metadata) after the notes of the older store (see sources.chunks.read_legacy) have been taken over, which
    is done once: metadata (key, value) says whether it has been. They have no key, revision 1 and an id of their own
    where they had none."""
    if not metadata.filter("key = 'migrated_from_json' and coalesce(value, '') <> ''").isEmpty():
        return notes, metadata
    at = F.col("created_at").cast(notes.schema["created_at"].dataType)
    random = lambda: F.concat(F.lit("obs-"), F.substring(F.sha2(F.expr("uuid()"), 256), 1, 16))
    fields = {"id": F.when(F.col("id") != "", F.col("id")), "title": F.col("topic"), "content": F.col("content"), "source": F.col("source"), "created_at": at, "updated_at": at, "scope": F.lit("project"), "revision": F.lit(1), "sync_id": random(), "imported": F.lit(False)}
    blank = {c: F.lit("") for c in ("topic_key", "project", "type", "author")}
    new = legacy.select(*((fields | blank)[c].cast(notes.schema[c].dataType).alias(c) for c in notes.columns if c in fields | blank))
    done = metadata.filter("key <> 'migrated_from_json'").unionByName(metadata.sparkSession.createDataFrame([("migrated_from_json", "true")], "key string, value string"))
    return append_keyless(notes, new), done


def delete(notes: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """notes with the live ones of the keys marked deleted; asking again changes nothing."""
    hit = notes.join(keys.select(*KEY).distinct().withColumn("hit", F.lit(True)), KEY, "left")
    gone = F.when(F.col("hit") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))
    return hit.withColumn("deleted_at", gone).select(notes.columns)


def collisions(notes: DataFrame, moves: DataFrame, target: str) -> DataFrame:
    """Moves whose target key a live note holds already. moves: KEY and the new value of `target`."""
    to = [F.col("m.new").alias(target) if c == target else F.col(f"m.{c}").alias(c) for c in KEY]
    wanted = moves.select(*KEY, F.col(f"new_{target}").alias("new")).alias("m")
    found = wanted.filter(F.col("m.new") != F.col(f"m.{target}")).select(F.struct("m.*").alias("move"), *to)
    return found.join(live(notes).select(*KEY), KEY, "left_semi").select("move.*").withColumnRenamed("new", f"new_{target}")


def rescope(notes: DataFrame, moves: DataFrame, at: Column) -> DataFrame:
    """notes with scopes changed by moves (KEY, new_scope): a new sync id, the revision kept. Moves that
    collide, and those to the same scope, change nothing."""
    return _move(notes, moves, "scope", at, 0)


def retopic(notes: DataFrame, moves: DataFrame, at: Column) -> DataFrame:
    """notes with topics changed by moves (KEY, new_topic_key): a new sync id and a higher revision."""
    return _move(notes, moves, "topic_key", at, 1)


def _move(notes: DataFrame, moves: DataFrame, what: str, at: Column, bump: int) -> DataFrame:
    new = f"new_{what}"
    good = moves.select(*KEY, new).join(collisions(notes, moves, what).select(*KEY), KEY, "left_anti").filter(F.col(new) != F.col(what))
    j = live(notes).join(good, KEY, "left")
    hit = F.col(new).isNotNull()
    moved = j.withColumns({"revision": F.col("revision") + F.when(hit, bump).otherwise(0), "updated_at": F.when(hit, at).otherwise(F.col("updated_at")), what: F.coalesce(new, what), "was": hit})
    moved = moved.withColumn("sync_id", F.when(F.col("was"), sync_id(F.col("scope"), F.col("topic_key"))).otherwise(F.col("sync_id")))
    return moved.select(notes.columns).unionByName(notes.filter("deleted_at is not null"))


def export_records(notes: DataFrame, author: str) -> DataFrame:
    """Live, shared notes of an author or of nobody, stamped with the author, by sync id."""
    own = live(notes).filter((F.col("scope") != "personal") & (F.coalesce("author", F.lit("")).isin("", author)))
    return own.withColumn("author", F.lit(author)).select("sync_id", "topic_key", "scope", "project", "title", "content", "type", "source", "author", "revision", "created_at", "updated_at").orderBy("sync_id")


def chunk_digest(records: DataFrame) -> DataFrame:
    """One row (digest): equal for equal records in any order; a chunk is written only if it differs. Sums of hashes,
    so that no task holds all records."""
    whole = F.to_json(F.struct(*sorted(records.columns)))
    part = [F.coalesce(F.sum(F.xxhash64(F.sha2(whole, 256), F.lit(k)).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(4)]
    return records.agg(F.sha2(F.concat_ws(" ", F.count("*").cast("string"), *part), 256).alias("digest"))


def _chunk_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, a line each, as the lines of one JSON document."""
    before = '{"observations":['
    for b in batches:
        values = b.column("value").to_pylist()
        if values:
            yield pa.RecordBatch.from_arrays([pa.array([before + values[0], *("," + v for v in values[1:])])], ["value"])
            before = ","
    yield pa.RecordBatch.from_arrays([pa.array(["]}" if before == "," else before + "]}"])], ["value"])


#: Bytes of records, as JSON, that a file of a chunk has about.
CHUNK_BYTES = 32 << 20


def write_chunk(records: DataFrame, folder: str, author: str, part_bytes: int = CHUNK_BYTES) -> bool:
    """Write an author's chunk as gzip JSON documents unless the folder has an equal one. True: written.

    A chunk of up to part_bytes is one file, chunk-<author>.jsonl.gz. A larger one is the power of two of files that
    makes them so small, the others chunk-<author>.<n>.jsonl.gz, each a whole document: no task has more than a file. A
    record's file goes by its sync id, so one that stays is in a file at all times while files are replaced one by one.
    """
    from ..sources.chunks import read_chunk

    spark = records.sparkSession
    slug = records.sparkSession.range(1).select(author_slug(F.lit(author)).alias("s")).first()["s"]
    texts = records.select(*(F.col(c).cast("int" if c == "revision" else "string").alias(c) for c in records.columns))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # No slug has a dot, so these are files of this author alone.
    own = re.compile(rf"chunk-{slug}(\.\d+)?\.jsonl\.gz")
    there = [x.getPath() for x in (fs.listStatus(root) if fs.exists(root) else []) if own.fullmatch(x.getPath().getName())]
    if there and chunk_digest(read_chunk(spark, *map(str, there)).select(texts.columns)).first() == chunk_digest(texts).first():
        return False
    lines = texts.select("sync_id", F.to_json(F.struct(*texts.columns)).alias("value"))
    size = lines.agg(F.sum(F.octet_length("value").cast("long"))).first()[0] or 0
    parts = 1 << max(0, -(-size // part_bytes) - 1).bit_length()
    # Records without an id, which say nothing of where they were, are spread by their text.
    key = F.xxhash64(F.coalesce(F.nullif("sync_id", F.lit("")), "value"))
    dealt = lines.repartitionById(parts, F.pmod(key, F.lit(parts)).cast("int")).sortWithinPartitions("sync_id", "value").select("value")
    temporary = hadoop.Path(f"{folder}/.{slug}.tmp")
    dealt.mapInArrow(_chunk_lines, "value string").write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", 0).text(str(temporary))
    made = sorted((x.getPath() for x in fs.listStatus(temporary) if x.getPath().getName().startswith("part-")), key=lambda x: x.getName())
    # One step that puts a new file in the old one's place: whoever reads meanwhile has one or the other. The last
    # comes first: records that leave a file when there are more files are in their new one by then.
    kind = hadoop.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    put = []
    for part in reversed(made):
        n = int(part.getName().split("-")[1])
        target = hadoop.Path(root, f"chunk-{slug}.{n}.jsonl.gz" if n else f"chunk-{slug}.jsonl.gz")
        hadoop.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, fs.makeQualified(target), options)
        put.append(target.getName())
    for old in there:
        if old.getName() not in put:
            fs.delete(old, False)
    fs.delete(temporary, True)
    return True


def import_records(notes: DataFrame, records: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """notes after merging records by sync id, and (action, n): an absent id is inserted, a higher revision
    overwrites, others are skipped, as are records without id. Of repeated ids the highest revision counts
    and the others count as skipped, save for those that each raised it in turn."""
    w = Window.partitionBy("sync_id").orderBy(F.desc("revision"), "topic_key", "content")
    named = records.filter("coalesce(sync_id, '') <> ''").withColumn("_n", F.row_number().over(w))
    best = named.filter("_n = 1").drop("_n")
    had = notes.select("sync_id", F.col("revision").alias("old"), F.col("id").alias("old_id")).filter("coalesce(sync_id, '') <> ''")
    judged = best.join(had, "sync_id", "left").withColumn("action", F.when(F.col("old").isNull(), "inserted").when(F.col("revision") > F.col("old"), "updated").otherwise("skipped"))
    take = judged.filter("action <> 'skipped'").select(
        F.coalesce("old_id", F.concat(F.lit("imp-"), "sync_id")).alias("id"),
        *("topic_key", "scope", "project", "title", "content", "type", "source", "author", "sync_id", "revision"),
        parse_time(F.col("created_at").cast("string"), now).alias("created_at"),
        parse_time(F.col("updated_at").cast("string"), now).alias("updated_at"),
        F.lit(True).alias("imported"),
    )
    kept = notes.join(take.select("sync_id"), "sync_id", "left_anti")
    after = kept.unionByName(take.withColumns({c: F.col(c).cast(notes.schema[c].dataType) for c in ("created_at", "updated_at")}), allowMissingColumns=True).select(notes.columns)
    rest = records.filter("coalesce(sync_id, '') = ''").select(F.lit("skipped").alias("action")).unionAll(named.filter("_n > 1").select(F.lit("skipped").alias("action")))
    return after, judged.select("action").unionAll(rest).groupBy("action").agg(F.count("*").alias("n"))


def diff_records(current: DataFrame, old: DataFrame) -> DataFrame:
    """(sync_id, change): new where the other side has none, edited where revisions differ."""
    j = current.select("sync_id", "revision").join(old.select("sync_id", F.col("revision").alias("old")), "sync_id", "left")
    return j.select("sync_id", F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("revision"), "edited").alias("change")).filter("change is not null")


def removed_records(current: DataFrame, old: DataFrame) -> DataFrame:
    return old.join(current.select("sync_id"), "sync_id", "left_anti")


def backfill(notes: DataFrame) -> DataFrame:
    """Empty sync ids of keyed notes and empty types from their topics."""
    keyed = F.col("topic_key") != ""
    ids = F.when((F.coalesce("sync_id", F.lit("")) == "") & keyed, sync_id(F.col("scope"), F.col("topic_key"))).otherwise(F.col("sync_id"))
    return notes.withColumns({"sync_id": ids, "type": F.when(F.coalesce("type", F.lit("")) == "", type_of_topic(F.col("topic_key"))).otherwise(F.col("type"))})


#: Our own patterns of secrets: keys of cloud services, private key blocks, assignments of tokens and passwords.
SECRET = r"AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i)\b(?:api[_-]?key|secret|token|passw(?:or)?d)\b\s*[:=]\s*[\"']?[A-Za-z0-9_/+-]{8,}"


def secret_records(records: DataFrame, column: str = "content") -> DataFrame:
    """records with excluded: whether the text looks like one that bears a secret."""
    return records.withColumn("excluded", F.coalesce(F.col(column).rlike(SECRET), F.lit(False)))


def recent(notes: DataFrame, n: int) -> DataFrame:
    """The n live notes updated last, the oldest of them first."""
    return live(notes).orderBy(F.desc("updated_at"), F.desc("id")).limit(n).orderBy("updated_at", "id")


def by_id(notes: DataFrame, ids: DataFrame) -> DataFrame:
    return live(notes).join(ids.select("id").distinct(), "id", "left_semi").orderBy("topic_key", "id")


def relate(relations: DataFrame, new: DataFrame) -> DataFrame:
    """relations and the new ones of known types whose (from, to, type) is not there yet."""
    good = new.filter(F.col("relation_type").isin(*RELATION_TYPES)).dropDuplicates(["from_id", "to_id", "relation_type"])
    return relations.unionByName(good.join(relations, ["from_id", "to_id", "relation_type"], "left_anti").select(relations.columns))


def unrelate(relations: DataFrame, sources: DataFrame, relation_type: str) -> tuple[DataFrame, DataFrame]:
    """relations without those of a type from the sources (id), and one row (n) of how many went."""
    gone = relations.filter(F.col("relation_type") == relation_type).join(sources.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi")
    return relations.join(gone.select("from_id", "to_id", "relation_type"), ["from_id", "to_id", "relation_type"], "left_anti").select(relations.columns), gone.agg(F.count("*").alias("n"))


def conflicts(relations: DataFrame, notes: DataFrame, relation_type: str = "conflicts_with") -> DataFrame:
    """(from_id, from_topic, to_id, to_topic) of a relation type; topics of live notes, else ''."""
    names = live(notes).select("id", F.coalesce(F.nullif("topic_key", F.lit("")), "title").alias("t"))
    a, b = names.select(F.col("id").alias("from_id"), F.col("t").alias("a")), names.select(F.col("id").alias("to_id"), F.col("t").alias("b"))
    j = relations.filter(F.col("relation_type") == relation_type).join(a, "from_id", "left").join(b, "to_id", "left")
    return j.select("from_id", F.coalesce("a", F.lit("")).alias("from_topic"), "to_id", F.coalesce("b", F.lit("")).alias("to_topic"))


def stale_links(relations: DataFrame, notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_id, stale): links of notes to what is neither a note nor a node; none while there are no nodes."""
    built = nodes.select(F.lit(1).alias("one")).limit(1)
    lost = relations.join(live(notes).select(F.col("id").alias("to_id")), "to_id", "left_anti").join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    return lost.join(built).groupBy("from_id").agg(F.count("*").alias("stale"))


def related_knowledge(relations: DataFrame, notes: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, topic_key, revision, auto_only): live notes linked to a target, and whether by automatic links alone."""
    linked = relations.join(targets.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi").groupBy("from_id").agg(F.bool_and(F.col("relation_type") == "documents_auto").alias("auto_only"))
    return live(notes).join(linked, F.col("id") == F.col("from_id")).select("id", F.coalesce(F.nullif("topic_key", F.lit("")), "title").alias("topic_key"), "revision", "auto_only")


def pending_foreign(notes: DataFrame, approvals: DataFrame, me: str) -> DataFrame:
    """Live skill notes of other authors whose revision is not the approved one. approvals: (topic_key, approved)."""
    foreign = live(notes).filter((F.col("type") == "skill") & F.col("imported") & (F.coalesce("author", F.lit("")) != me))
    return foreign.join(approvals, "topic_key", "left").filter("approved is null or approved <> revision").drop("approved")


def compose_summary(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, summary) of session spans (id, started_at, until): the ten newest live notes created in them."""
    inside = spans.join(live(notes).select(F.col("id").alias("nid"), F.coalesce(F.nullif("topic_key", F.lit("")), F.nullif("title", F.lit(""))).alias("label"), "created_at"), F.col("created_at").between(F.col("started_at"), F.col("until")))
    w = Window.partitionBy("id").orderBy(F.desc("created_at"), F.desc("nid"))
    top = inside.withColumn("n", F.row_number().over(w)).filter("n <= 10 and label is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "label"))).alias("x"))
    text = F.concat(F.size("x").cast("string"), F.lit(" observation(s): "), F.array_join(F.transform("x", lambda s: s["label"]), "; "))
    return spans.select("id").join(top, "id", "left").select("id", F.coalesce(text, F.lit("(no observations recorded)")).alias("summary"))


def end_sessions(sessions: DataFrame, notes: DataFrame, projects: DataFrame, at: Column, summary: str = "") -> DataFrame:
    """sessions with the open ones of the projects ended, by a given summary or a composed one."""
    ending = sessions.filter("ended_at is null").join(projects.select("project").distinct(), "project", "left_semi")
    composed = compose_summary(notes, ending.select("id", "started_at", at.alias("until"))).withColumnRenamed("summary", "composed")
    j = sessions.join(composed, "id", "left")
    hit = F.col("composed").isNotNull()
    text = F.lit(summary) if summary else F.col("composed")
    return j.withColumns({"ended_at": F.when(hit, at).otherwise(F.col("ended_at")), "summary": F.when(hit, text).otherwise(F.col("summary"))}).select(sessions.columns)


def start_sessions(sessions: DataFrame, notes: DataFrame, projects: DataFrame, at: Column) -> DataFrame:
    """sessions with the projects' open ones ended first, and a new open one for each project."""
    new = projects.select("project").distinct().select(F.concat(F.lit("session-"), F.substring(F.sha2(F.concat_ws("\0", "project", at.cast("string")), 256), 1, 12)).alias("id"), "project", at.alias("started_at"), F.lit(None).cast(sessions.schema["ended_at"].dataType).alias("ended_at"), F.lit("").alias("summary"))
    return end_sessions(sessions, notes, projects, at).unionByName(new)


def last_summary(sessions: DataFrame) -> DataFrame:
    """(project, summary) of the session that ended last."""
    return sessions.filter("ended_at is not null").groupBy("project").agg(F.max_by("summary", F.struct("ended_at", "id")).alias("summary"))


def session_list(sessions: DataFrame, project: str, n: int = 10) -> DataFrame:
    return sessions.filter(F.col("project") == project).orderBy(F.desc("started_at"), F.desc("id")).limit(n if n > 0 else 10)


def fingerprint(members: DataFrame, by: str) -> DataFrame:
    """(by, source_hash): order-free hash of the members' topic@revision."""
    key = F.concat("topic_key", F.lit("@"), F.col("revision").cast("string"))
    return members.groupBy(by).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "\n"), 256), 1, 16).alias("source_hash"))


def cluster_status(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """(label, status) of records (label, stored_hash) against clusters (label, source_hash): orphan without
    a cluster, none without a hash, current if equal, else stale."""
    j = records.join(clusters, "label", "left")
    return j.select("label", F.when(F.col("source_hash").isNull(), "orphan").when(F.coalesce("stored_hash", F.lit("")) == "", "none").when(F.col("stored_hash") == F.col("source_hash"), "current").otherwise("stale").alias("status"))


