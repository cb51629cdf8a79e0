"""Queries of extraction, state, evaluation, ranking and windows over the test tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import extract, text
from corvane.operators import evaluation, state
from corvane.plans.queries import claims, query, read


@query("""SELECT doc_id, CAST(len(v) AS BIGINT) AS n, list_max(v) AS largest FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[-+]?[0-9]+(?:[,.][0-9]+)?'),
 lambda x: TRY_CAST(replace(replace(x, ',', '.'), '+', '') AS DOUBLE)) AS v FROM documents)""")
def x04_numbers(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select("doc_id", extract.numbers(F.col("text")).alias("v"))
    return found.select("doc_id", F.size("v").cast("long").alias("n"), F.array_max("v").alias("largest"))


@query("""SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(substr(t, 1, 177)) || '...' END AS snippet
 FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM documents)""")
def x32_snippets(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("SELECT page_id, regexp_replace(split_part(url, '/', -1), '[^A-Za-z0-9._-]+', '_', 'g') AS file FROM pages")
def x37_filenames(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", extract.safe_filename(F.col("url")).alias("file"))


@query("SELECT doc_id, unnest(range(len(c))) AS no, unnest(c) AS chunk FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s).{1,48}') AS c FROM documents)")
def x39_chunks(spark, sf_dir):
    cut = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(extract.chunks(F.col("text"))).alias("no", "chunk"))
    return cut.withColumn("no", F.col("no").cast("long"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderdate AS created FROM orders")
def m01_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created"), "o_custkey")
    new = old.where("o_custkey % 10 = 0").withColumn("status", F.lit("X")).withColumn("created", F.expr("created + interval 1 day").cast(old.schema["created"].dataType))
    return state.upserted(old.drop("o_custkey"), new.drop("o_custkey"), ["o_orderkey"], "created").select("o_orderkey", "status", "created")


@query("SELECT d.doc_id, coalesce(l.toxic, d.n_chars % 2) AS flag FROM documents d LEFT JOIN labels l USING (doc_id)")
def m08_keep_nulls(spark, sf_dir):
    old = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).alias("flag"))
    return state.filled(old, read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("flag")), "doc_id", ["flag"])


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events")
def w06_versions(spark, sf_dir):
    return state.versioned(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "version")


@query("""SELECT doc_id, min(source) AS origin FROM (SELECT doc_id, 'a-label' AS source FROM labels UNION ALL SELECT doc_id, 'b-document' FROM documents) GROUP BY 1""")
def u07_first_wins(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.lit("a-label").alias("origin"), F.lit(0).alias("rank"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lit("b-document").alias("origin"), F.lit(1).alias("rank"))
    return state.first_wins(labels.unionByName(docs), ["doc_id"], "rank", "origin")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def m13_notify_once(spark, sf_dir):
    return state.first_wins(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "event_id")


@query("""WITH i AS (SELECT l_partkey AS part, l_suppkey AS s, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS e, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a
 FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2)
 SELECT part, round(sum(e * a) / nullif(sum(e), 0), 6) AS coverage, round(sum(e * a) / nullif(sum(a), 0), 6) AS precision, round(2 * sum(e * a) / (sum(e) + sum(a)), 6) AS f1 FROM i GROUP BY 1""")
def e01_e06_set_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("s"), "l_returnflag")
    return evaluation.set_metrics(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), "part", "s")


@query("""SELECT status, a AS before, b AS after, b - a AS delta FROM (SELECT o_orderstatus AS status, count(*) AS a FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)
 FULL JOIN (SELECT o_orderstatus AS status, count(*) AS b FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1) USING (status)""")
def a19_report_diff(spark, sf_dir):
    counts = lambda y: read(spark, sf_dir, "orders").where(F.year("o_orderdate") == y).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return evaluation.differences(counts(1996), counts(1997), "status", "n")


@query("""SELECT * FROM (SELECT 'DQ2' AS rule, 'error' AS severity, count(*) FILTER (coalesce(l_returnflag, '') = '') AS n FROM lineitem
 UNION ALL SELECT 'DQ3', 'warning', count(*) FILTER (NOT coalesce(l_quantity BETWEEN 1 AND 45, false)) FROM lineitem
 UNION ALL SELECT 'DQ5', 'error', count(*) FILTER (NOT coalesce(1 - l_discount BETWEEN 0 AND 0.95, false)) FROM lineitem) WHERE n > 0""")
def dq_rules(spark, sf_dir):
    return evaluation.violations(claims(spark, sf_dir), {"DQ2": ("unit <> ''", "error"), "DQ3": ("value between 1 and 45", "warning"), "DQ5": ("confidence between 0 and 0.95", "error")})


@query("""SELECT name, label FROM (SELECT s_name AS name, 'Supplier' AS label FROM supplier UNION ALL SELECT c_name, 'Customer' FROM customer UNION ALL SELECT p_name, 'Part' FROM part)
 GROUP BY 1, 2 ORDER BY name DESC, label LIMIT 50""")
def u01_union_labels(spark, sf_dir):
    parts = [read(spark, sf_dir, t).select(F.col(c).alias("name"), F.lit(t.capitalize()).alias("label")) for t, c in (("supplier", "s_name"), ("customer", "c_name"), ("part", "p_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct().orderBy(F.desc_nulls_last("name"), "label").limit(50)


@query("""SELECT concat_ws('-', l_orderkey, l_linenumber) AS claim, round(least(1.0, (1 - CAST(l_discount AS DOUBLE)) * (CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.6 END)
 + 0.05 * (CASE WHEN year(l_shipdate) >= 1997 THEN 1 ELSE 0 END)), 6) AS score FROM lineitem ORDER BY score DESC, claim LIMIT 50""")
def t04_claim_ranking(spark, sf_dir):
    weight, recent = F.when(F.col("status") == "F", 1.0).otherwise(0.6), F.when(F.year("l_shipdate") >= 1997, 1).otherwise(0)
    score = F.round(F.least(F.lit(1.0), F.col("confidence").cast("double") * weight + 0.05 * recent), 6)
    return claims(spark, sf_dir).select("claim", score.alias("score")).orderBy(F.desc("score"), "claim").limit(50)


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10 OFFSET 20")
def t07_offset_page(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    page = rows.select("o_orderkey").orderBy("o_orderkey").offset(20).limit(10)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


@query("SELECT event_id, user_id, before FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type")
def w07_changed(spark, sf_dir):
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, sf_dir, "events").withColumn("before", before).where("before <> event_type").select("event_id", "user_id", "before")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 8")
def w08_capped(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return read(spark, sf_dir, "events").select("user_id", "event_id", rank.alias("rank")).where("rank <= 8").drop("rank")


@query("SELECT conv_id, lower(role) AS role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2")
def w04_first_seen(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id", F.lower("role").alias("role")).agg(F.min("turn").alias("first_turn"))


@query("SELECT lang, count(*) FILTER (source IS NULL) AS unsourced, count(*) FILTER (n_chars < 1000) AS short, count(*) FILTER (n_chars >= 1000) AS long FROM documents GROUP BY 1")
def a07_coverage(spark, sf_dir):
    counted = {"unsourced": F.col("source").isNull(), "short": F.col("n_chars") < 1000, "long": F.col("n_chars") >= 1000}
    return read(spark, sf_dir, "documents").groupBy("lang").agg(*[F.count_if(c).alias(name) for name, c in counted.items()])


@query("""SELECT l_partkey AS entity, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'needs_unit_check' WHEN max(l_quantity) - min(l_quantity) > 5 THEN 'conflicting_values' ELSE 'consistent' END AS verdict
 FROM lineitem GROUP BY 1""")
def a14_conflict_groups(spark, sf_dir):
    units = F.when(F.min("unit") < F.max("unit"), "needs_unit_check").when(F.max("value") - F.min("value") > 5, "conflicting_values").otherwise("consistent")
    return claims(spark, sf_dir).groupBy("entity").agg(units.alias("verdict"))


@query("SELECT event_type, round(least(0.95, avg(greatest(value / 100.0, 0.1))), 6) AS confidence FROM events GROUP BY 1")
def a23_confidence(spark, sf_dir):
    score = F.when(F.col("value").isNull(), F.lit(0.1)).otherwise(F.greatest(F.col("value") / 100.0, F.lit(0.1)))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.least(F.lit(0.95), F.avg(score)), 6).alias("confidence"))


@query("SELECT o_orderkey, count(l_linenumber) AS artifacts, max(l_shipdate) AS latest FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j26_artifacts(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("n"), F.max("l_shipdate").alias("latest"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(items, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0).cast("long")).alias("artifacts"), "latest")
