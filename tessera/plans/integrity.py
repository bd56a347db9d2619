"""Integrity queries: reconciliation, versions, generations, chains, leases, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import integrity
from tessera.plans.registry import query
from tessera.sources.tables import table


@query("""WITH a AS (SELECT source AS kb, doc_id FROM documents WHERE doc_id % 7 <> 0), p AS (SELECT source AS kb, doc_id FROM documents WHERE doc_id % 11 <> 0)
SELECT kb, doc_id, 'missing' AS state FROM (SELECT * FROM a EXCEPT SELECT * FROM p) UNION ALL SELECT kb, doc_id, 'orphan' FROM (SELECT * FROM p EXCEPT SELECT * FROM a)""")
def reconcile_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("source").alias("kb"), "doc_id")
    return integrity.reconcile(docs.filter("doc_id % 7 <> 0"), docs.filter("doc_id % 11 <> 0"), ["kb", "doc_id"])


@query("""SELECT DISTINCT o_custkey AS doc, o_orderpriority AS generation FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders j WHERE j.o_custkey = orders.o_custkey AND j.o_orderpriority = orders.o_orderpriority AND j.o_orderstatus IN ('O', 'P') AND j.o_orderkey % 3 = 0)""")
def repair_jobs(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("generation"), "o_orderstatus", "o_orderkey")
    jobs = orders.filter("o_orderkey % 3 = 0").withColumn("status", F.when(F.col("o_orderstatus").isin("O", "P"), "QUEUED").otherwise("DONE"))
    return integrity.new_jobs(orders.filter("o_orderstatus = 'F'"), jobs, ["doc", "generation"])


@query("""WITH l AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS v, sha256(line) AS hash FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT pair, hash, 'removed' AS change FROM l WHERE v = 0 AND NOT EXISTS (SELECT 1 FROM l n WHERE n.v = 1 AND n.pair = l.pair AND n.hash = l.hash) UNION ALL
SELECT pair, hash, 'added' FROM l WHERE v = 1 AND NOT EXISTS (SELECT 1 FROM l n WHERE n.v = 0 AND n.pair = l.pair AND n.hash = l.hash)""")
def chunk_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Each even document as the old version of the odd one after it, line by line."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    hashed = lines.select(F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2).alias("v"), F.sha2(F.col("line").cast("binary"), 256).alias("hash"))
    return integrity.version_diff(hashed.filter("v = 0"), hashed.filter("v = 1"), "pair", "hash")


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 9 <> 0), f AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 6 <> 0)
SELECT doc_id, CASE WHEN f.hash IS NULL THEN 'file_not_found' WHEN s.hash IS NULL THEN 'no_existing_hash' WHEN s.hash = f.hash THEN 'content_unchanged' ELSE 'content_changed' END AS reason FROM s FULL JOIN f USING (doc_id)""")
def change_detection(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    stored = docs.filter("doc_id % 9 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 != 0, sha(F.col("text"))).alias("hash"))
    found = docs.filter("doc_id % 6 <> 0").select("doc_id", sha(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return integrity.changes(stored, found, "doc_id")


@query("""WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS generation, CASE l_linestatus WHEN 'O' THEN 'ACTIVE' ELSE 'PENDING' END AS status FROM lineitem), p AS (SELECT l_orderkey AS doc, max(l_linenumber) AS g FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1)
SELECT CASE WHEN g IS NULL THEN status WHEN generation = g THEN 'ACTIVE' WHEN status = 'ACTIVE' THEN 'SUPERSEDED' ELSE status END AS status, generation, count(*) AS n FROM r LEFT JOIN p USING (doc) GROUP BY 1, 2""")
def generation_activation(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("generation"), F.when(F.col("l_linestatus") == "O", "ACTIVE").otherwise("PENDING").alias("status"))
    pointers = lines.filter("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("doc")).agg(F.max("l_linenumber").alias("generation"))
    return integrity.activate(rows, pointers, "doc").groupBy("status", "generation").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
c AS (SELECT user_id, event_id, i, sha256('genesis|' || event_id || '|' || event_type) AS entry_hash FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, sha256(c.entry_hash || '|' || e.event_id || '|' || e.event_type) FROM e JOIN c ON e.user_id = c.user_id AND e.i = c.i + 1)
SELECT user_id, event_id, entry_hash FROM c""")
def hash_chain(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return integrity.chained(entries, "user_id", "event_id", "event_type").select("user_id", "event_id", "entry_hash")


@query("SELECT user_id, event_id FROM events WHERE event_id % 50 = 7 AND event_type <> 'view'")
def hash_chain_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that were changed after the chain was written: every fiftieth is given the type view, which breaks its own hash unless it had that type."""
    entries = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    chain = integrity.chained(entries, "user_id", "event_id", "event_type")
    changed = chain.withColumn("event_type", F.when(F.col("event_id") % 50 == 7, "view").otherwise(F.col("event_type")))
    return integrity.broken_links(changed, "user_id", "event_id", "event_type").select("user_id", "event_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 OR o_custkey % 8 >= 6 THEN 'DEAD' ELSE 'RETRY' END AS status, CASE WHEN NOT (o_orderkey % 10 = 0 OR o_custkey % 8 >= 6) THEN least(30, CAST(pow(2, least(greatest(o_custkey % 8, 1), 5)) AS INTEGER)) ELSE 0 END AS wait FROM orders""")
def backoff_transition(spark: SparkSession, sf: str) -> DataFrame:
    status, wait = integrity.after_failure((F.col("o_custkey") % 8).cast("int"), F.lit(6), F.col("o_orderkey") % 10 == 0)
    return table(spark, sf, "orders").select("o_orderkey", status.alias("status"), F.coalesce(wait, F.lit(0)).alias("wait"))


@query("""WITH a AS (SELECT event_id, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) // 1000000 AS age, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id * 100000 END AS sla FROM events WHERE event_type = 'view')
SELECT event_id FROM a WHERE age > 900 AND age >= greatest(coalesce(sla, 300000) * 2 / 1000, 900)""")
def watchdog_timeouts(spark: SparkSession, sf: str) -> DataFrame:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    tasks = table(spark, sf, "events").filter("event_type = 'view'").withColumn("age", F.floor((micros(F.lit("2024-01-31")) - micros(F.col("ts"))) / 1_000_000))
    return tasks.filter(integrity.timed_out(F.col("age"), F.when(F.col("user_id") % 3 != 0, F.col("user_id") * 100_000))).select("event_id")


@query("""SELECT event_type, count(*) AS n FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') <= CASE event_type WHEN 'view' THEN 7 WHEN 'click' THEN 14 ELSE 100000 END GROUP BY 1""")
def retention_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    kept = integrity.retained(table(spark, sf, "events"), "ts", "event_type", F.lit("2024-01-31"), {"view": 7, "click": 14})
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT item_id AS case_id, (item_id * 37 + j) % (SELECT CAST(floor(1.3 * count(*)) AS BIGINT) FROM documents) AS doc_id FROM benchmark, (SELECT unnest(generate_series(0, 2)) AS j))
SELECT case_id, doc_id FROM c WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def corpus_binding_check(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    size = docs.agg(F.floor(F.count("*") * 1.3).cast("long").alias("n"))  # so that about a quarter of the bindings lead nowhere
    wanted = table(spark, sf, "benchmark").selectExpr("item_id as case_id", "explode(sequence(0, 2)) as j").join(F.broadcast(size), F.lit(True)).selectExpr("case_id", "(case_id * 37 + j) % n as doc_id")
    return wanted.join(docs, "doc_id", "left_anti").select("case_id", "doc_id")


@query("""WITH s AS (SELECT DISTINCT user_id, event_type AS kb FROM events WHERE value < 20) SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND s.kb = e.event_type)""")
def leak_detection(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    scope = events.filter("value < 20").select("user_id", "event_type").distinct()
    return events.join(scope, ["user_id", "event_type"], "left_anti").select("event_id")


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, upper(c_name), c_acctbal FROM customer WHERE c_custkey % 5 = 0""")
def upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    existing = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return integrity.upserted(existing, existing.filter("c_custkey % 5 = 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 40""")
def job_claim(spark: SparkSession, sf: str) -> DataFrame:
    due = table(spark, sf, "orders").filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp_ntz")))
    return due.orderBy("o_orderdate", "o_orderkey").limit(40).select("o_orderkey")


@query("""SELECT DISTINCT sha256('t|' || source || '|' || lang || '|' || sha256(text)) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)""")
def idempotent_enqueue(spark: SparkSession, sf: str) -> DataFrame:
    """Job keys that no job has yet."""
    docs = table(spark, sf, "documents").withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    done = docs.filter("doc_id % 10 = 0").select("h").distinct()
    return docs.join(done, "h", "left_anti").select(F.sha2(F.concat_ws("|", F.lit("t"), "source", "lang", "h").cast("binary"), 256).alias("key")).distinct()
