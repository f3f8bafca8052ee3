"""Snapshots, clones, exports, imports, packs and purges of subjects.

New ids are hashes of the job, the target and the old id, so a job that Spark runs again
gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions.text import json_merge, stable_id, stamp
from recollect.operators.asof import count_before, sum_before
from recollect.operators.common import SUBJECT, few, join_on
from recollect.operators.sla import SESSION
from recollect.sources.scratch import materialize

FORMAT = "recollect-export-1"
#: What each scope carries.
SCOPES = {"episodes": ("episodes",), "memories": ("memories",), "all": ("episodes", "memories")}
SUBJECT_PATTERN = r"^[A-Za-z0-9_.\-:]{1,128}$"


def valid_subject_id(subject: Column) -> Column:
    return F.coalesce(subject.rlike(SUBJECT_PATTERN), F.lit(False))


def suggest_target(subject: Column, seed: str, reserved: str = "demo_web_") -> Column:
    """A free name for an import: the reserved prefix goes, other marks become -, 8 hex digits follow."""
    rest = F.substring(subject, len(reserved) + 1, 1 << 20)
    bare = F.when(subject.startswith(reserved), F.concat(F.lit("imported-"), rest)).otherwise(subject)
    clean = F.substring(F.regexp_replace(bare, r"[^A-Za-z0-9_.\-:]", "-"), 1, 119)
    return F.concat(clean, F.lit("-"), F.substring(stable_id(seed, subject), 1, 8))


def upsert_resolutions(current: DataFrame, updates: DataFrame) -> DataFrame:
    """One state per (tenant, subject, session): the last one, with the first one's id and creation time.

    resolved_at stays only where the state is resolved.
    """
    names = [c for c in current.columns if c not in (*SESSION, "resolution_id", "created_at")]
    both = current.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    order = F.struct("updated_at", "_new", "resolution_id")
    first = F.min_by(F.struct("resolution_id", "created_at"), order).alias("_first")
    last = F.max_by(F.struct(*names), order).alias("_last")
    out = both.groupBy(*SESSION).agg(first, last).select(*SESSION, "_first.*", "_last.*")
    return out.withColumn("resolved_at", F.when(F.col("status") == "resolved", F.col("resolved_at"))).select(current.columns)


def remap_provenance(memories: DataFrame, ids: DataFrame, keep_unmapped: bool = True) -> DataFrame:
    """source_episode_ids with each id replaced by its new one, in order.

    ids: (subject_id, episode_id, new_id). Ids without a new one are kept or dropped. Subjects here are
    the targets of a copy or an import, which are new: no two tenants share one.
    """
    parts = memories.select("subject_id", "memory_id", F.posexplode("source_episode_ids").alias("pos", "episode_id"))
    found = parts.join(ids, ["subject_id", "episode_id"], "left")
    new = F.coalesce("new_id", "episode_id") if keep_unmapped else F.col("new_id")
    lists = found.select("memory_id", "pos", new.alias("id")).where("id IS NOT NULL").groupBy("memory_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("_sources")
    )
    out = memories.join(lists, "memory_id", "left")
    return out.withColumn("source_episode_ids", F.coalesce("_sources", F.array().cast("array<string>"))).drop("_sources")


def subject_keys(df: DataFrame) -> tuple[str, ...]:
    """What names a subject in a list: tenant and id, or the id alone where the list has no tenants."""
    return SUBJECT if "tenant_id" in df.columns else ("subject_id",)


def of_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    keys = subject_keys(targets)
    return join_on(rows, targets.select(*keys, "target_id"), keys, "inner")


def copy_subjects(
    episodes: DataFrame, memories: DataFrame, targets: DataFrame, job: str, keep_unmapped: bool = True, keep_tenant: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Copies of the subjects in targets (tenant_id, subject_id, target_id): (episodes, memories) under new ids.

    Targets without a tenant_id column take the subject's rows of all tenants. The old ids stay in `_from` columns for stamps.
    """
    def taken(df: DataFrame, name: str) -> DataFrame:
        rows = of_targets(df, targets)
        rows = rows if keep_tenant else rows.withColumn("tenant_id", F.lit(None).cast("string"))
        return rows.withColumn("_new", stable_id(job, F.col("target_id"), F.col(name)))

    e, m = taken(episodes, "episode_id"), taken(memories, "memory_id")
    # Two targets may take the same subject, so the target is part of what is remapped.
    ids = e.select(F.col("target_id").alias("subject_id"), "episode_id", F.col("_new").alias("new_id"))
    m = m.withColumns({"_from_subject": F.col("subject_id"), "_from": F.col("memory_id"), "subject_id": F.col("target_id"), "memory_id": F.col("_new")})
    m = remap_provenance(m.drop("_new", "target_id"), ids, keep_unmapped)
    e = e.withColumns({"_from_subject": F.col("subject_id"), "_from": F.col("episode_id"), "subject_id": F.col("target_id"), "episode_id": F.col("_new")})
    return e.drop("_new", "target_id"), m


def create_snapshot(
    episodes: DataFrame, memories: DataFrame, resolutions: DataFrame, requests: DataFrame, catalog: DataFrame, as_of: str
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(episodes, memories, resolutions, catalog rows) of snapshots of requests (tenant_id, subject_id, name).

    A snapshot is a subject `_snapshot/<id>`; its version is one more than the name's last one.
    """
    last = catalog.groupBy("name").agg(F.max("version").alias("_v"))
    rows = requests.join(last, "name", "left")
    keys = subject_keys(requests)
    place = F.row_number().over(Window.partitionBy("name").orderBy(*[F.col(k) for k in reversed(keys)]))
    rows = rows.withColumn("version", F.coalesce("_v", F.lit(0)) + place)
    rows = rows.withColumn("snapshot_id", stable_id("snapshot", F.col("name"), F.col("version").cast("string"), F.col("subject_id")))
    rows = rows.withColumn("target_id", F.concat(F.lit("_snapshot/"), "snapshot_id"))
    e, m = copy_subjects(episodes, memories, rows, "snapshot", keep_tenant=False)
    r = of_targets(resolutions, rows)
    r = r.withColumn("resolution_id", stable_id("snapshot", F.col("target_id"), F.col("resolution_id"))).withColumn("subject_id", F.col("target_id"))
    count = lambda df, name: df.groupBy(F.col("subject_id").alias("target_id")).agg(F.count("*").alias(name))
    new = rows.join(count(e, "episode_count"), "target_id", "left").join(count(m, "memory_count"), "target_id", "left")
    new = new.fillna(0, ["episode_count", "memory_count"]).select(
        "snapshot_id", "name", "version", F.col("subject_id").alias("source_subject_id"), "episode_count", "memory_count",
        F.lit(as_of).cast("timestamp").alias("created_at"),
    )
    plain = lambda df: df.drop("_from", "_from_subject")
    return plain(e), plain(m), r.drop("target_id"), new


def latest_snapshot(catalog: DataFrame) -> DataFrame:
    """The row of the highest version of each name."""
    last = catalog.groupBy("name").agg(F.max_by(F.struct("*"), "version").alias("_s"))
    return last.select("_s.*")


def restore_snapshot(
    episodes: DataFrame, memories: DataFrame, requests: DataFrame, as_of: str
) -> tuple[DataFrame, DataFrame]:
    """(episodes, memories) of snapshots (snapshot_id, target_id) restored to live subjects.

    All times are moved by the same step, so that the newest episode is at as_of.
    """
    named = requests.withColumn("subject_id", F.concat(F.lit("_snapshot/"), "snapshot_id"))
    e, m = copy_subjects(episodes, memories, named, "restore")
    newest = e.groupBy("subject_id").agg(F.max("created_at").alias("_max"))
    shift = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("_max")
    newest = newest.withColumn("_shift", shift).drop("_max")
    snap = F.substring_index("_from_subject", "/", -1)

    def moved(df: DataFrame, *times: str) -> DataFrame:
        rows = df.join(newest, "subject_id", "left").fillna(0, ["_shift"])
        for t in times:
            rows = rows.withColumn(t, F.timestamp_micros(F.unix_micros(t) + F.col("_shift")))
        stamped = json_merge(F.col("metadata"), F.to_json(F.struct(snap.alias("restored_from_snapshot"))))
        return rows.withColumn("metadata", stamped).drop("_shift", "_from", "_from_subject")

    return moved(e, "created_at"), moved(m, "created_at", "valid_from", "valid_to")


def populated_targets(targets: DataFrame, episodes: DataFrame, memories: DataFrame) -> DataFrame:
    """targets (subject_id, target_id) with `populated`: whether the target holds rows already."""
    held = episodes.select("subject_id").union(memories.select("subject_id")).distinct()
    held = held.select(F.col("subject_id").alias("target_id"), F.lit(True).alias("populated"))
    return targets.join(held, "target_id", "left").fillna(False, ["populated"])


def apply_strategy(targets: DataFrame, episodes: DataFrame, memories: DataFrame, strategy: str, seed: str) -> DataFrame:
    """Targets after the conflict strategy: `merge` keeps all, `cancel` drops populated ones, `create_copy` renames them."""
    rows = populated_targets(targets, episodes, memories)
    if strategy == "cancel":
        return rows.where(~F.col("populated")).drop("populated")
    if strategy == "create_copy":
        free = F.concat("target_id", F.lit("-"), F.substring(stable_id(seed, F.col("target_id")), 1, 8))
        rows = rows.withColumn("target_id", F.when(F.col("populated"), free).otherwise(F.col("target_id")))
    elif strategy != "merge":
        raise ValueError(f"unknown strategy {strategy}")
    return rows.drop("populated")


def clone_subjects(
    episodes: DataFrame, memories: DataFrame, targets: DataFrame, as_of: str, by: str = "batch", scope: str = "all"
) -> tuple[DataFrame, DataFrame]:
    """(episodes, memories) copied to empty targets, with where they came from in provenance and metadata."""
    free = populated_targets(targets, episodes, memories).where(~F.col("populated"))
    parts = SCOPES[scope]
    e, m = copy_subjects(
        episodes if "episodes" in parts else episodes.limit(0), memories if "memories" in parts else memories.limit(0), free, "clone", keep_unmapped=False
    )

    def stamps(name: str) -> Column:
        return F.to_json(F.struct(
            F.col("_from_subject").alias("cloned_from_subject_id"), F.lit(as_of).alias("cloned_at"), F.lit(by).alias("cloned_by"), F.col("_from").alias(name)
        ))

    e = e.withColumn("provenance", json_merge(F.col("provenance"), stamps("original_episode_id")))
    m = m.withColumn("metadata", json_merge(F.col("metadata"), stamps("original_memory_id")))
    return e.drop("_from", "_from_subject"), m.drop("_from", "_from_subject")


def _text(df: DataFrame, names: list[str]) -> list[Column]:
    times = {n for n, t in df.dtypes if t == "timestamp"}
    return [(stamp(F.col(n)) if n in times else F.col(n)).alias(n) for n in names if n in df.columns]


EXPORTED_EPISODE = ["episode_id", "source", "type", "payload", "metadata", "provenance", "created_at"]
EXPORTED_MEMORY = ["memory_id", "kind", "content", "summary", "confidence", "valid_from", "valid_to", "source_episode_ids", "metadata", "status", "created_at"]


def _json_rows(episodes: DataFrame, memories: DataFrame, scope: str) -> DataFrame:
    e = episodes.select(*SUBJECT, F.lit("episode").alias("item"), "created_at", F.col("episode_id").alias("id"), F.to_json(F.struct(*_text(episodes, EXPORTED_EPISODE))).alias("row"))
    m = memories.select(*SUBJECT, F.lit("memory").alias("item"), "created_at", F.col("memory_id").alias("id"), F.to_json(F.struct(*_text(memories, EXPORTED_MEMORY))).alias("row"))
    return e.union(m) if scope == "all" else (e if scope == "episodes" else m)


def export_rows(episodes: DataFrame, memories: DataFrame, scope: str = "all") -> DataFrame:
    """One row of JSON per exported episode and memory, with its place: the form for subjects of any size.

    Places are counted in range partitions, so a subject of any size is spread.
    """
    rows = _json_rows(episodes, memories, scope)
    placed = count_before(rows, [*SUBJECT, "item"], [F.col("created_at"), F.col("id")], F.lit(True), "export-rows")
    return placed.withColumn("position", (F.col("found") + 1).cast("int")).drop("created_at", "found")


def export_subjects(
    episodes: DataFrame, memories: DataFrame, as_of: str, scope: str = "all", most_rows: int = 100_000, most_bytes: int = 1 << 26
) -> DataFrame:
    """Documents of each tenant's subjects: format, the subject's counts, rows in order and a checksum over them.

    A subject of more than `most_rows` rows, or about `most_bytes` of them, goes into numbered
    parts (`part` of `parts`), a row each, so `too_large` is never true. A document of several
    parts holds its number, which the checksum so covers. Most subjects are one part, and their rows are grouped at once. Of the
    large ones, where a row falls is summed up in range partitions from the rows' sizes alone, and the rows' JSON then goes
    straight to its part: no task holds more of a subject than a part.
    """
    json = _json_rows(episodes, memories, scope)
    # A row weighs its bytes, and enough that no part holds more than most_rows.
    weight = F.greatest(F.octet_length("row").cast("long"), F.lit(-(-most_bytes // most_rows)).cast("long"))
    totals = json.groupBy(*SUBJECT).agg(F.sum(weight).alias("_w"))
    large = few(materialize(totals.where(F.col("_w") > most_bytes).select(*SUBJECT), "export-large"))
    cut = join_on(json, large, SUBJECT, "left_semi")
    light = cut.select(*SUBJECT, "item", "created_at", "id", weight.alias("weight"))
    light = sum_before(light, list(SUBJECT), [F.col("item"), F.col("created_at"), F.col("id")], F.col("weight"), "export-sizes")
    light = materialize(light.withColumn("_cut", F.expr(f"found div {most_bytes}L")).select(*SUBJECT, "item", "id", "_cut"), "export-cuts")
    cuts = light.groupBy(*SUBJECT, "_cut").agg(F.count_if(F.col("item") == "episode").alias("_e"), F.count_if(F.col("item") == "memory").alias("_m"))
    cuts = cuts.withColumn("part", F.row_number().over(Window.partitionBy(*SUBJECT).orderBy("_cut")))  # a row a part
    placed = join_on(light, cuts.select(*SUBJECT, "_cut", "part"), (*SUBJECT, "_cut"), "inner").drop("_cut")
    rows = join_on(cut, placed, (*SUBJECT, "item", "id"), "inner").unionByName(join_on(json, large, SUBJECT, "left_anti").withColumn("part", F.lit(1)))
    docs = rows.groupBy(*SUBJECT, "part").agg(
        F.sort_array(F.collect_list(F.struct("item", "created_at", "id", "row"))).alias("_items"),
        F.count_if(F.col("item") == "episode").alias("_e"), F.count_if(F.col("item") == "memory").alias("_m"),
    )
    items = lambda kind: F.transform(F.filter("_items", lambda x: x["item"] == kind), lambda x: x["row"])
    rest = F.concat(F.lit('"episodes":['), F.array_join(items("episode"), ","), F.lit('],"memories":['), F.array_join(items("memory"), ","), F.lit("]}"))
    sizes = cuts.groupBy(*SUBJECT).agg(F.sum("_e").alias("episode_count"), F.sum("_m").alias("memory_count"), F.max("part").alias("parts"))
    docs = join_on(docs.select(*SUBJECT, "part", "_e", "_m", rest.alias("_rest")), few(materialize(sizes, "export-counts")), SUBJECT)
    docs = docs.withColumns({"episode_count": F.coalesce("episode_count", "_e"), "memory_count": F.coalesce("memory_count", "_m"), "parts": F.coalesce("parts", F.lit(1))})
    docs = docs.withColumn("document", F.concat(_part_head(), "_rest"))
    return docs.select(
        *SUBJECT, F.lit(FORMAT).alias("format_version"), F.lit(as_of).alias("exported_at"), "episode_count", "memory_count", F.lit(False).alias("too_large"),
        "document", F.sha2("document", 256).alias("checksum"), "part", "parts",
    )


def _part_head() -> Column:
    """How a document opens: with its number where there are several."""
    number = F.concat(F.lit('{"part":'), F.col("part").cast("string"), F.lit(',"parts":'), F.col("parts").cast("string"), F.lit(","))
    return F.when(F.col("parts") > 1, number).otherwise("{")


def verify_export(docs: DataFrame) -> DataFrame:
    """Documents with `problem`: null, `format`, `checksum`, or `parts` where another part of the subject is missing, repeated or bad."""
    if "part" not in docs.columns:
        docs = docs.withColumns({"part": F.lit(1), "parts": F.lit(1)})
    bad = F.coalesce(F.sha2("document", 256) != F.col("checksum"), F.lit(True))
    named = F.coalesce(F.col("document").startswith(_part_head()), F.lit(False))
    known = F.coalesce(F.col("format_version") == FORMAT, F.lit(False))
    docs = docs.withColumn("problem", F.when(~known, "format").when(bad | ~named, "checksum"))
    keys = subject_keys(docs)
    good = docs.where("problem IS NULL").groupBy(*keys).agg(
        F.count("*").alias("_n"), F.count_distinct("part").alias("_d"), F.min("parts").alias("_lo"), F.max("parts").alias("_hi")
    )
    torn = good.where("NOT coalesce(_hi = 1 OR (_n = _hi AND _d = _hi AND _lo = _hi), false)").select(*keys, F.lit(True).alias("_torn"))
    docs = join_on(docs, few(materialize(torn, "export-torn")), keys)  # seldom any, and the documents stay where they are
    return docs.withColumn("problem", F.when(F.col("problem").isNull() & F.col("_torn"), "parts").otherwise(F.col("problem"))).drop("_torn")


def import_payload(
    docs: DataFrame, targets: DataFrame, as_of: str, tenant_id: str | None = None, job: str = "import"
) -> tuple[DataFrame, DataFrame]:
    """(episodes, memories) of valid documents and of subjects all of whose parts are valid, for targets (tenant_id, subject_id, target_id).

    Targets without a tenant_id column take all tenants' documents of the subject. Ids are made anew, provenance follows them (ids that are not in the document go), missing
    fields get defaults, and the original subject and id are kept in provenance and metadata.
    """
    episode = "struct<episode_id:string,source:string,type:string,payload:string,metadata:string,provenance:string,created_at:string>"
    memory = (
        "struct<memory_id:string,kind:string,content:string,summary:string,confidence:double,valid_from:string,valid_to:string,"
        "source_episode_ids:array<string>,metadata:string,status:string,created_at:string>"
    )
    good = verify_export(docs).where("problem IS NULL")
    good = of_targets(good, targets)
    parsed = good.select("subject_id", "target_id", F.from_json("document", f"struct<episodes:array<{episode}>,memories:array<{memory}>>").alias("d"))
    now = F.lit(as_of).cast("timestamp")
    time = lambda n: F.try_to_timestamp(F.col(n))
    tenant = F.lit(tenant_id).cast("string")
    origin = lambda n: F.to_json(F.struct(F.col("subject_id").alias("imported_from_subject_id"), F.col(n).alias(f"original_{n}"), F.lit(as_of).alias("imported_at")))
    e = parsed.select("subject_id", "target_id", F.inline("d.episodes"))
    episodes = e.select(
        stable_id(job, F.col("target_id"), F.col("episode_id")).alias("episode_id"), tenant.alias("tenant_id"), F.col("target_id").alias("subject_id"),
        F.coalesce("source", F.lit("import")).alias("source"), F.coalesce("type", F.lit("message")).alias("type"), F.coalesce("payload", F.lit("{}")).alias("payload"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"), json_merge(F.col("provenance"), origin("episode_id")).alias("provenance"),
        F.coalesce(time("created_at"), now).alias("created_at"),
    )
    ids = e.select(F.col("target_id").alias("subject_id"), "episode_id", stable_id(job, F.col("target_id"), F.col("episode_id")).alias("new_id"))
    m = parsed.select("subject_id", "target_id", F.inline("d.memories"))
    memories = m.select(
        stable_id(job, F.col("target_id"), F.col("memory_id")).alias("memory_id"), tenant.alias("tenant_id"), F.col("target_id").alias("subject_id"),
        F.coalesce("kind", F.lit("fact")).alias("kind"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce(time("valid_from"), now).alias("valid_from"), time("valid_to").alias("valid_to"),
        F.coalesce("source_episode_ids", F.array().cast("array<string>")).alias("source_episode_ids"), json_merge(F.col("metadata"), origin("memory_id")).alias("metadata"),
        F.coalesce("status", F.lit("active")).alias("status"), F.coalesce(time("created_at"), now).alias("created_at"),
    )
    return episodes, remap_provenance(memories, ids, keep_unmapped=False)


def id_conflicts(incoming: DataFrame, existing: DataFrame, name: str) -> DataFrame:
    return incoming.join(existing.select(name), name, "left_semi")


def pack_owned(pack: str, column: str = "metadata", legacy: str | None = None) -> Column:
    """Whether a row came from the pack: its id in the JSON column, or its older name."""
    own = F.coalesce(F.get_json_object(column, "$.starter_pack_id") == pack, F.lit(False))
    return own | F.coalesce(F.get_json_object(column, "$.pack") == (legacy or pack), F.lit(False))


def pack_state(rows: DataFrame, pack: str, column: str = "metadata") -> DataFrame:
    """Per tenant and subject: all rows, the pack's and the operators' own, and the pack version of the newest of the pack's."""
    owned = pack_owned(pack, column)
    version = F.when(owned, F.get_json_object(column, "$.starter_pack_version"))
    return rows.groupBy(*SUBJECT).agg(
        F.count("*").alias("total"), F.count_if(owned).alias("owned"), F.count_if(~owned).alias("operator_rows"),
        F.max_by(version, F.when(owned, F.col("created_at"))).alias("version"),
    )


def reseed_pack(rows: DataFrame, fresh: DataFrame, pack: str, column: str = "metadata") -> DataFrame:
    """Rows with the pack's own ones replaced by fresh ones; operators' rows stay. Only subjects in `fresh` change (of its tenants, if it has them)."""
    keys = subject_keys(fresh)
    subjects = fresh.select(*keys).distinct().withColumn("_seed", F.lit(True))
    kept = join_on(rows, subjects, keys).where(F.col("_seed").isNull() | ~pack_owned(pack, column)).drop("_seed")
    return kept.unionByName(fresh, allowMissingColumns=True)


def delete_subjects(rows: DataFrame, subjects: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """Rows without the subjects' ones: of the tenants in `subjects`, if it has them, or of one tenant where given."""
    keys = subject_keys(subjects)
    gone = subjects.select(*keys).distinct()
    if tenant_id is None:
        return join_on(rows, gone, keys, "left_anti")
    out = join_on(rows, gone.withColumn("_gone", F.lit(True)), keys)
    return out.where(F.col("_gone").isNull() | ~F.col("tenant_id").eqNullSafe(F.lit(tenant_id))).drop("_gone")


def purge_subjects(matched: DataFrame, expected: int, *tables: DataFrame) -> list[DataFrame]:
    """Tables without the matched subjects, if there are as many as expected."""
    found = matched.select(*subject_keys(matched)).distinct()
    n = found.count()
    if n != expected:
        raise ValueError(f"{n} subjects match, {expected} were expected")
    return [delete_subjects(t, found) for t in tables]


def purge_log(
    log: DataFrame, terminal: tuple[str, ...], as_of: str, status: str | None = None, tenant_id: str | None = None, older_than_hours: int | None = None
) -> DataFrame:
    """The log without its ended rows that match; at least one filter is needed, and open rows always stay."""
    if status is None and tenant_id is None and older_than_hours is None:
        raise ValueError("a filter is required")
    gone = F.col("status").isin(*terminal)
    gone = gone if status is None else gone & (F.col("status") == status)
    gone = gone if tenant_id is None else gone & (F.col("tenant_id") == tenant_id)
    if older_than_hours is not None:
        gone = gone & (F.col("created_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(older_than_hours)))
    return log.where(~F.coalesce(gone, F.lit(False)))


JOB_ENDS, OUTBOX_ENDS = ("completed", "failed"), ("delivered", "dead_letter")
RETENTION_HOURS = 168


def purge_jobs(jobs: DataFrame, as_of: str, **filters) -> DataFrame:
    return purge_log(jobs, JOB_ENDS, as_of, **filters)


def purge_outbox(outbox: DataFrame, as_of: str, **filters) -> DataFrame:
    return purge_log(outbox, OUTBOX_ENDS, as_of, **filters)


def retire_old_jobs(jobs: DataFrame, as_of: str) -> DataFrame:
    return purge_jobs(jobs, as_of, older_than_hours=RETENTION_HOURS)

