"""The search index as a table of payloads: built from spans, filtered, searched by channels, fused, and checked against access again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.functions import access, entities, extract, ids, quantities
from corvane.functions.text import token_share, tokens
from corvane.operators import snapshots
from corvane.operators.dictionaries import contained
from corvane.operators.storage import written

#: Kinds of artifacts that a span's claims and entities come from, and the types that a span may have: fixed values.
CLAIM_KINDS = ["claim", "measurement", "recommendation", "conclusion"]
ENTITY_KINDS = ["entity", "material", "substance", "process", "equipment", "property", "geography", "expert"]
SPAN_TYPES = ["text", "table", "figure", "caption"]
NONE = "array<string>"


def row_text(caption: Column, headers: Column, row: Column) -> Column:
    """`caption. header: cell; header: cell`; a cell without a header has col_ and its place."""
    cells = F.transform(row, lambda v, i: F.concat(F.coalesce(F.get(headers, i), F.concat(F.lit("col_"), (i + 1).cast("string"))), F.lit(": "), v))
    return F.concat(F.when(F.coalesce(caption, F.lit("")) != "", F.concat(caption, F.lit(". "))).otherwise(""), F.array_join(cells, "; "))


def table_rows(tables: DataFrame) -> DataFrame:
    """tables (id, document_id, page, caption, headers, rows) -> a span for each row, its place as the offset."""
    rows = tables.select("id", "document_id", "page", "caption", "headers", F.posexplode("rows").alias("i", "row"))
    text = row_text(F.col("caption"), F.col("headers"), F.col("row"))
    out = rows.select("document_id", "page", F.col("i").alias("start_offset"), text.alias("text"), F.concat_ws(":", "id", F.lit("row"), F.col("i").cast("string")).alias("table_block_id"), F.lit("table").alias("source_type"))
    return out.withColumn("end_offset", F.col("start_offset") + F.length("text"))


def span_links(artifacts: DataFrame) -> DataFrame:
    """artifacts (id, kind, source_span_ids) -> (span_id, claim_ids, entity_ids): distinct and sorted."""
    each = artifacts.where("id is not null").select("id", "kind", F.explode("source_span_ids").alias("span_id")).distinct()
    gathered = lambda kinds: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("id"))))
    return each.groupBy("span_id").agg(gathered(CLAIM_KINDS).alias("claim_ids"), gathered(ENTITY_KINDS).alias("entity_ids"))


def payloads(spans: DataFrame, documents: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """spans (document_id, page, start_offset, end_offset, text, table_block_id, source_type), documents (document_id, title, source_type,
    access_level, allowed_roles, year, dictionary_version_id), links (span_id, claim_ids, entity_ids) -> the index's rows."""
    span_id = ids.span_id(F.col("document_id"), F.col("page"), F.col("start_offset"), F.col("end_offset"), F.col("table_block_id"))
    rows = spans.withColumn("source_span_id", span_id).join(documents.withColumnRenamed("source_type", "document_source_type"), "document_id")
    if links is not None:
        rows = rows.join(links.withColumnRenamed("span_id", "source_span_id"), "source_span_id", "left")
    none = F.array().cast(NONE)
    given = lambda c: F.coalesce(F.col(c), none) if links is not None else none
    numbers, place = extract.numbers(F.col("text")), entities.place_bucket(F.col("text"))
    block = F.coalesce("table_block_id", F.lit(""))
    year = F.coalesce(F.col("year"), F.get(extract.periods(F.col("text")), F.lit(0))["end_year"])
    return rows.select(
        F.when(F.col("source_type") == "table", "table_row").otherwise("source_span").alias("item_type"),
        "text",
        F.array_sort(tokens(F.col("text"))).alias("lexical_tokens"),
        "document_id",
        F.col("title").alias("document_title"),
        "source_span_id",
        ids.point_id(F.col("source_span_id")).alias("point_id"),
        "page",
        "start_offset",
        "end_offset",
        F.col("start_offset").alias("highlight_start"),
        F.col("end_offset").alias("highlight_end"),
        block.alias("table_block_id"),
        F.when(F.contains(block, F.lit(":row:")), block).otherwise("").alias("table_row_id"),
        "source_type",
        "document_source_type",
        "access_level",
        "allowed_roles",
        numbers.alias("numeric_values"),
        F.array_min(numbers).alias("numeric_min"),
        F.array_max(numbers).alias("numeric_max"),
        quantities.units(F.col("text")).alias("units"),
        place["bucket"].alias("geo_bucket"),
        F.lower(place["country"]).alias("geo_country"),
        given("claim_ids").alias("claim_ids"),
        given("entity_ids").alias("graph_entity_ids"),
        year.alias("published_year"),
        F.coalesce("dictionary_version_id", F.lit("")).alias("dictionary_version_id"),
    )


def span_of(payload: DataFrame) -> DataFrame:
    """Payloads as spans: page 1, offset 0, the text's end and type `text` where they are missing or unknown."""
    text = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("source_type").isin(*SPAN_TYPES), F.col("source_type")).otherwise("text")
    end = F.coalesce(F.nullif("end_offset", F.lit(0)), F.length(text))
    return payload.select("document_id", F.coalesce(F.nullif("page", F.lit(0)), F.lit(1)).alias("page"), F.coalesce("start_offset", F.lit(0)).alias("start_offset"), end.alias("end_offset"), text.alias("text"), F.nullif("table_block_id", F.lit("")).alias("table_block_id"), kind.alias("source_type"))


def levels_of(roles: list[str]) -> list[str]:
    """The access levels that roles may ask for; `access.may_see` decides on each row."""
    if "admin" in roles:
        return ["public", "internal", "restricted"]
    return ["public", "internal"] if set(roles) & set(access.INTERNAL_ROLES) else ["public"]


def asked_for(roles: list[str], source_types: list[str] | None = None, version: str | None = None, low: float | None = None, high: float | None = None, units: list[str] | None = None, places: list[str] | None = None, years: tuple[int, int] | None = None, tables_only: bool = False) -> Column:
    """A condition on payloads, access first; what is None asks for nothing. All of it reaches the scan."""
    holds = F.col("access_level").isin(*levels_of(roles)) & access.may_see(F.col("access_level"), F.col("allowed_roles"), roles)
    if source_types:
        holds &= F.col("document_source_type").isin(*source_types)
    if version:
        holds &= F.col("dictionary_version_id") == version
    if low is not None:
        holds &= F.col("numeric_max") >= low
    if high is not None:
        holds &= F.col("numeric_min") <= high
    if units:
        holds &= F.arrays_overlap("units", F.array(*[F.lit(u) for u in units]))
    if places:
        lowered = [p.lower() for p in places]
        holds &= F.col("geo_bucket").isin(*lowered) | F.col("geo_country").isin(*lowered)
    if years:
        holds &= F.col("published_year").between(*years)
    if tables_only:
        holds &= F.col("item_type") == "table_row"
    return holds


def any_match(question: list[str], text: Column, payload_units: Column, bucket: Column, country: Column, ask: Column) -> Column:
    """The loose match: a common token, a place or digits that are asked for, a unit, or a place of the payload."""
    from corvane.functions.verify import constraints_match

    word = token_share(text, question) > 0
    unit = F.exists(ask["numeric"], lambda a: F.array_contains(payload_units, F.lower(a["unit"])))
    place = F.exists(ask["places"], lambda p: F.lower(p).isin(F.lower(bucket), F.lower(country)))
    return word | constraints_match(text, ask) | F.coalesce(unit, F.lit(False)) | F.coalesce(place, F.lit(False))


def token_index(spans: DataFrame, key: str, text: str, path: str) -> None:
    """Writes (token, key) sorted by token: a question's tokens then read only the row groups that hold them, not all texts."""
    each = spans.select(F.explode(tokens(F.col(text))).alias("token"), key)
    each.repartitionByRange("token", key).sortWithinPartitions("token", key).write.mode("overwrite").parquet(path)


def index_after(index: DataFrame, changed: DataFrame, key: str, text: str) -> DataFrame:
    """The index (token, key) after spans have come, changed or gone (a null text): postings of these keys are replaced, the others stay."""
    own = changed.where(F.col(text).isNotNull()).select(F.explode(tokens(F.col(text))).alias("token"), key)
    return index.join(changed.select(key), key, "left_anti").select("token", key).unionByName(own)


def token_counts(index: DataFrame, key: str, question: list[str]) -> DataFrame:
    """(key, n): how many of the question's tokens each key has. Only the row groups that may hold them are read, and no text."""
    return index.where(F.col("token").isin(*question)).groupBy(key).agg(F.count("*").alias("n"))


def lexical_from_index(index: DataFrame, key: str, question: list[str], k: int) -> DataFrame:
    """index (token, key) -> the k keys with the highest share of the question's tokens."""
    own = token_counts(index, key, question)
    return own.select(key, F.round(F.col("n") / float(len(question)), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def fused(channels: dict[str, DataFrame], key: str, k: int, constant: int = 60) -> DataFrame:
    """channels by name (key, score, and claim_ids, entity_ids where it has them) -> key, rrf, channels, claim_ids, entity_ids.

    Reciprocal-rank fusion: the sum over channels of 1 / (constant + rank). Ids are merged in order of channel, each once. Channels are
    cut already, so that windows and lists hold as many rows as there are channels and places."""
    rows = None
    for order, (name, df) in enumerate(channels.items()):
        given = lambda c: F.col(c) if c in df.columns else F.array().cast(NONE)  # noqa: B023, E731
        own = df.select(F.lit(order).alias("order"), F.lit(name).alias("channel"), key, "score", given("claim_ids").alias("claim_ids"), given("entity_ids").alias("entity_ids"))
        rows = own if rows is None else rows.unionByName(own)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("channel").orderBy(F.desc("score"), F.asc(key))))
    lists = F.array_sort(F.collect_list(F.struct("order", "claim_ids", "entity_ids")))
    merged = ranked.groupBy(key).agg(F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), 9).alias("rrf"), F.count("*").alias("channels"), lists.alias("lists"))
    ids_of = lambda c: F.array_distinct(F.flatten(F.transform("lists", lambda x: x[c])))
    out = merged.select(key, "rrf", "channels", ids_of("claim_ids").alias("claim_ids"), ids_of("entity_ids").alias("entity_ids"))
    return out.orderBy(F.desc("rrf"), F.asc(key)).limit(k)


def visible_again(items: DataFrame, index: DataFrame, key: str, roles: list[str]) -> DataFrame:
    """Fused items whose span the index has and these roles may see: one join instead of a lookup for each item."""
    return items.join(index.where(asked_for(roles)).select(key).distinct(), key, "left_semi")


def with_graph_evidence(items: DataFrame, graph: DataFrame, key: str, floor: float = 0.55) -> DataFrame:
    """items (key, score), graph (key, confidence, claim_id) -> the items, and graph evidence on other spans, each once, at the floor at least."""
    own = graph.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct("confidence", "claim_id"), "claim_id").alias("g"))
    new = own.join(items.select(key), key, "left_anti")
    score = F.greatest(F.coalesce(F.col("g.confidence").cast("double"), F.lit(0.0)), F.lit(floor))
    added = new.select(key, score.alias("score"), F.lit("exact").alias("method"), F.array_compact(F.array("g.claim_id")).alias("claim_ids"))
    return items.select(key, "score", F.lit("semantic").alias("method"), F.array().cast(NONE).alias("claim_ids")).unionByName(added)


def replaced(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index after an upsert of points: rows of the same span are replaced."""
    return index.join(new.select("source_span_id"), "source_span_id", "left_anti").unionByName(new)


def without_documents(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the points of the documents in gone (document_id)."""
    return index.join(gone.select("document_id"), "document_id", "left_anti")


def status(index: DataFrame) -> DataFrame:
    """One row: points, documents and points by type."""
    return index.agg(F.count("*").alias("points"), F.countDistinct("document_id").alias("documents"), F.count_if(F.col("item_type") == "table_row").alias("table_rows"))


def bootstrapped(spark: SparkSession, folder: str, schema: StructType | str) -> bool:
    """Makes an empty index in folder where there is none, and says whether it did. One that is there stays, whatever it holds."""
    if "index" in snapshots.opened(spark, folder):
        return False
    snapshots.committed({"index": spark.createDataFrame([], schema)}, folder)
    return True


def index_status(spark: SparkSession, folder: str) -> DataFrame:
    """One row: state (missing or green), points, documents, table_rows."""
    index = snapshots.opened(spark, folder).get("index")
    if index is None:
        return spark.createDataFrame([("missing", 0, 0, 0)], "state string, points long, documents long, table_rows long")
    return status(index).select(F.lit("green").alias("state"), "points", "documents", "table_rows")


def reset(spark: SparkSession, folder: str) -> bool:
    """Empties the index, or makes one where there is none; says whether there was one. Readers of the snapshot before are not disturbed."""
    index = snapshots.opened(spark, folder).get("index")
    if index is None:
        return not bootstrapped(spark, folder, "source_span_id string, document_id string, item_type string")
    snapshots.committed({"index": spark.createDataFrame([], index.schema)}, folder)
    return True


def upserted_points(index_folder: str, new: DataFrame) -> int:
    """Commits the index with new points in the place of those of the same span; the columns are those of the index."""
    index = snapshots.opened(new.sparkSession, index_folder)["index"]
    return snapshots.committed({"index": replaced(index, new.select(*index.columns))}, index_folder)


def canonical(artifacts: DataFrame, dictionary: DataFrame, value: str = "value") -> DataFrame:
    """artifacts with canonical: the dictionary's name (alias, canonical) for the value without case, else the value itself."""
    names = dictionary.select(F.lower("alias").alias("_alias"), "canonical").dropDuplicates(["_alias"])
    joined = artifacts.join(names, F.lower(value) == F.col("_alias"), "left")
    return joined.drop("_alias").withColumn("canonical", F.coalesce("canonical", value))


def enriched(questions: DataFrame, dictionary: DataFrame, key: str, text: str) -> DataFrame:
    """questions -> (key, canonical): dictionary names whose alias a question contains. Aliases are found by automata, in dictionaries of any size."""
    names = dictionary.select(F.lower("alias").alias("name"), "canonical")
    return contained(questions, key, text, names, "name").join(names, "name").select(key, "canonical").distinct()


def interest_words() -> Column:
    words = F.array_distinct(F.transform(F.concat(F.array("label"), F.coalesce("source_terms", F.array().cast(NONE))), F.lower))
    return F.filter(words, lambda w: w != "")


def interest_score(hits: Column, more: Column) -> Column:
    """By the terms that an artifact contains, those of them in its metadata, its status, confidence and reason codes."""
    boost = F.least(F.lit(0.25), 0.08 * more)
    penalty = F.when(F.col("status") == "confirmed", 1.0).otherwise(0.55) * F.greatest(F.lit(0.5), 1.0 - 0.12 * F.size(F.coalesce("reason_codes", F.array().cast(NONE))))
    return F.round(F.least(F.lit(1.0), F.col("weight") * (0.45 + 0.12 * hits + boost) * F.greatest("confidence", F.lit(0.1)) * penalty), 6)


def matched_interests(interests: DataFrame, artifacts: DataFrame, threshold: float = 0.0, most: int = 100_000) -> DataFrame:
    """interests (user_id, label, weight, source_terms), artifacts (id, kind, value, status, confidence, reason_codes, metadata: text) -> user_id, label, id, score.

    Terms are found by automata, whatever the number of interests, and hits are counted for each artifact and interest; ids of artifacts are unique.
    A stream of artifacts, which can't be counted by groups, is joined with the table of interests: that is counted, broadcast, and refused beyond `most`."""
    metadata = F.lower(F.coalesce("metadata", F.lit("{}")))
    text = F.lower(F.concat_ws(" ", "kind", "value", metadata))
    if not artifacts.isStreaming:
        numbered = interests.select(F.monotonically_increasing_id().alias("_interest"), "user_id", "label", "weight", interest_words().alias("_words"))
        own = written(numbered.select("_interest", "user_id", "label", "weight", F.explode("_words").alias("name")), "interests")
        terms = own.select("name").distinct()
        found = contained(artifacts.select("id", text.alias("_text")), "id", "_text", terms, "name")
        inside = contained(artifacts.select("id", metadata.alias("_text")), "id", "_text", terms, "name").withColumn("_inside", F.lit(1))
        counted = found.join(inside, ["id", "name"], "left").join(own, "name").groupBy("id", "_interest", "user_id", "label", "weight").agg(F.count("*").alias("_hits"), F.count("_inside").alias("_more"))
        rows = counted.join(artifacts.select("id", "status", "confidence", "reason_codes"), "id")
        return rows.select("user_id", "label", "id", interest_score(F.col("_hits"), F.col("_more")).alias("score")).where(F.col("score") >= threshold)
    if (n := interests.count()) > most:
        raise ValueError(f"{n} interests are more than {most}")
    own = F.broadcast(interests.select("user_id", "label", "weight", interest_words().alias("words")))
    joined = artifacts.withColumn("_text", text).withColumn("_metadata", metadata).join(own, F.exists("words", lambda w: F.contains(F.col("_text"), w)))
    hits = F.size(F.filter("words", lambda w: F.contains(F.col("_text"), w)))
    more = F.size(F.filter("words", lambda w: F.contains(F.col("_metadata"), w)))
    return joined.select("user_id", "label", "id", interest_score(hits, more).alias("score")).where(F.col("score") >= threshold)


def page_after(rows: DataFrame, at: str, key: str, after: tuple | None, limit: int, newest_first: bool = True) -> DataFrame:
    """The rows that follow a cursor (at, key), with more: whether the page is not the last. One row over the limit is read to know it."""
    place = F.struct(at, key)
    if after is not None:
        mark = F.struct(F.lit(after[0]).alias(at), F.lit(after[1]).alias(key))
        rows = rows.where(place < mark if newest_first else place > mark)
    order = [F.desc(at), F.desc(key)] if newest_first else [F.asc(at), F.asc(key)]
    page = rows.orderBy(*order).limit(limit + 1)
    rank = F.row_number().over(W.orderBy(*order))
    return page.withColumn("_rank", rank).withColumn("more", F.count("*").over(W.partitionBy()) > limit).where(F.col("_rank") <= limit).drop("_rank")
