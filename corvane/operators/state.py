"""Keyed state as tables: upserts, versions, first-wins merges, each one aggregation by key, combined map-side; and state machines over event logs."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], created: str | None = None) -> DataFrame:
    """Rows of both by key, new ones first; `created` keeps its least value over both. Of several new rows of a key the least by its values counts."""
    others = [c for c in old.columns if c not in keys and c != created]
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    kept = [F.min(created).alias(created)] if created else []
    return both.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct("_age", *others)).alias("_row"), *kept).select(*keys, *([created] if created else []), "_row.*")


def filled(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows by key; a null of the new row keeps the old value."""
    fresh = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return old.join(fresh, key, "full").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns])


def versioned(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with version: 1, 2, ... by key in order."""
    return rows.withColumn("version", F.row_number().over(W.partitionBy(key).orderBy(*order)))


def first_wins(ranked: DataFrame, keys: list[str], rank: str, *values: str) -> DataFrame:
    """Of the rows of a key the one of least rank."""
    return ranked.groupBy(*keys).agg(F.min_by(F.struct(*values), F.col(rank)).alias("_row")).select(*keys, "_row.*")


def latest(events: DataFrame, keys: list[str], order: list[str], *values: str) -> DataFrame:
    """An event log -> the values of each key's last event: state that is derived, never rewritten."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


#: From a state by an event to a state. An event that leads where its subject is already is a repeat: it changes nothing. All others are refused.
DELETION = {
    ("", "begin"): "pending", ("failed", "begin"): "pending", ("pending", "step"): "in_progress", ("pending", "step_failed"): "failed", ("in_progress", "step_failed"): "failed",
    ("pending", "finalize"): "completed", ("in_progress", "finalize"): "completed", ("pending", "abort"): "failed", ("in_progress", "abort"): "failed", ("completed", "purge"): "purged",
}
REVIEW = {("", "request"): "pending", **{(s, d): e for s in ("pending", "approved", "rejected") for d, e in (("approve", "approved"), ("reject", "rejected")) if s != e}}
#: Events that leave a subject where it is and still count: a further step of a deletion that is under way.
ONGOING = {("in_progress", "step")}


def folded(events: DataFrame, key: str, order: list[str], event: str, transitions: dict[tuple[str, str], str], ongoing: frozenset | set = frozenset(ONGOING)) -> DataFrame:
    """events -> key, *order, event, before, after, verdict (accepted, repeated or refused), run: the state machine of each key over its events in a total order.

    run counts how often a key has left the first state or failed. Events are dealt by key and sorted; a task reads them as a stream and holds one
    state, however many events a key has. A null event is refused."""
    reached = {(after, name) for (_, name), after in transitions.items()}
    cols = [key, *order, event]
    rows = events.select(*cols).repartition(key).sortWithinPartitions(key, *order, event)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", before string, after string, verdict string, run int"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, run = object(), "", 0
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for own, name in zip(batch.column(0).to_pylist(), batch.column(len(cols) - 1).to_pylist(), strict=True):
                if own != last:
                    last, now, run = own, "", 0
                before, after = now, transitions.get((now, name))
                if after is None:
                    verdict = "accepted" if (now, name) in ongoing else "repeated" if (now, name) in reached else "refused"
                else:
                    verdict, now, run = "accepted", after, run + (now in ("", "failed"))
                for column, value in zip(out, (before, now, verdict, run), strict=True):
                    column.append(value)
            types = (pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], names=[*cols, "before", "after", "verdict", "run"])

    return rows.mapInArrow(fold, schema)


def present(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """folded rows -> key, state, accepted, repeated, refused: where each key stands and what became of its events."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("accepted", "repeated", "refused")]
    return log.groupBy(key).agg(F.max_by("after", F.struct(*order)).alias("state"), *counts)


def steps_done(log: DataFrame, events: DataFrame, key: str, order: list[str], step: str) -> DataFrame:
    """folded rows, the events with the step that each is about -> (key, run, step, times): the steps of a key's last run that were accepted, each once."""
    last = log.groupBy(key).agg(F.max("run").alias("run"))
    own = log.where("verdict = 'accepted'").join(last, [key, "run"], "left_semi").join(events.select(key, *order, step), [key, *order])
    return own.where(F.col(step).isNotNull()).groupBy(key, "run", step).agg(F.count("*").alias("times"))


def patched(patches: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """patches -> a row a key: each column's last value that isn't null, the patch of an order that gives none keeps what was there."""
    place = F.struct(*order)
    return patches.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns], F.count("*").alias("patches"))


def upserted_claims(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """old (claim_id, version, status), new (claim_id, status, span_ids, entity_ids) -> (claims, edges (src, rel_type, dst)).

    A claim that was there gets the next version and an edge to the one it supersedes; arrays of ids become edges."""
    joined = new.join(old.select("claim_id", F.col("version").alias("before")), "claim_id", "left")
    written = joined.select("claim_id", (F.coalesce("before", F.lit(0)) + 1).alias("version"), "status")
    claims = old.join(new, "claim_id", "left_anti").select("claim_id", "version", "status").unionByName(written)
    versioned = joined.where("before is not null").select(F.concat_ws(":", "claim_id", (F.col("before") + 1).cast("string")).alias("src"), F.lit("SUPERSEDES").alias("rel_type"), F.concat_ws(":", "claim_id", F.col("before").cast("string")).alias("dst"))
    fan = lambda ids, rel: new.select(F.col("claim_id").cast("string").alias("src"), F.lit(rel).alias("rel_type"), F.explode(ids).alias("dst"))
    return claims, versioned.unionByName(fan("span_ids", "DESCRIBED_IN")).unionByName(fan("entity_ids", "VALIDATED_BY")).distinct()


#: Types of relations that have an edge of their own; others are RELATED_TO with their type beside it. Fixed values.
RELATION_TYPES = ["USES_MATERIAL", "OPERATES_AT_CONDITION", "PRODUCES_OUTPUT", "USES_EQUIPMENT", "VALIDATED_BY", "APPLIED_IN_GEOGRAPHY", "EXPERT_IN"]


def relations(raw: DataFrame, targets: DataFrame) -> DataFrame:
    """raw (src, type, dst), targets (id) -> edges (src, rel_type, semantic_type, dst) to targets that exist, each once."""
    kind = F.upper(F.coalesce("type", F.lit("")))
    known = raw.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")
    return known.select("src", F.when(kind.isin(*RELATION_TYPES), kind).otherwise("RELATED_TO").alias("rel_type"), F.when(~kind.isin(*RELATION_TYPES), F.col("type")).alias("semantic_type"), "dst").distinct()


def activated(versions: DataFrame, key: str, target) -> DataFrame:
    """versions (key, status) with the target active and the one that was active inactive; without the target nothing changes."""
    there = versions.where(F.col(key) == target).limit(1).select(F.lit(True).alias("_there"))
    joined = versions.crossJoin(F.broadcast(there.agg((F.count("*") > 0).alias("_there"))))  # one row
    status = F.when(F.col("_there") & (F.col(key) == target), "active").when(F.col("_there") & (F.col("status") == "active"), "inactive").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("_there")


def replaced_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Rows by parent: those of parents that new has are replaced whole."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def cascade(documents: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes documents (document_id in gone): (ids (id, kind) that go, edges that stay).

    Their spans go, and claims that no other span describes; and what hangs on such claims alone."""
    spans = edges.where("rel_type = 'PART_OF'").join(gone.select(F.col("document_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    described = edges.where("rel_type = 'DESCRIBED_IN'")
    touched = described.join(spans.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    kept = described.join(spans.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id"))
    claims = touched.join(kept, "id", "left_anti")
    hanging = edges.where("rel_type in ('QUANTIFIED_BY', 'DEGRADED_TO')")
    on_gone = hanging.join(claims.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    others = hanging.join(claims.select(F.col("id").alias("src")), "src", "left_anti").select(F.col("dst").alias("id"))
    parts = {"document": gone.select(F.col("document_id").alias("id")), "span": spans, "claim": claims, "node": on_gone.join(others, "id", "left_anti")}
    ids = None
    for kind, df in parts.items():
        own = df.select("id", F.lit(kind).alias("kind")).distinct()
        ids = own if ids is None else ids.unionByName(own)
    stay = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select(*edges.columns)
    return ids, stay


def lifecycle(events: DataFrame, run: str, at: str, state: str) -> DataFrame:
    """events of runs -> run, state (the last), started, ended, latency in milliseconds; open runs have no end."""
    done = F.col(state).isin("completed", "failed")
    out = events.groupBy(run).agg(F.max_by(state, F.struct(at, state)).alias("state"), F.min(F.when(F.col(state) == "processing", F.col(at))).alias("started"), F.max(F.when(done, F.col(at))).alias("ended"))
    return out.withColumn("latency_ms", F.timestamp_diff("MILLISECOND", F.col("started").cast("timestamp"), F.col("ended").cast("timestamp")))


def missing_from(cache: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted and not in the cache, each once."""
    return wanted.select(key).distinct().join(cache, key, "left_anti")
