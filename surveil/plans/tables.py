"""Sources, sinks, keyed tables and streams. What is written goes to the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import clinical as X
from ..operators._helpers import cut, held, shared_folder
from ..sources import files as I
from ..sources import tables as K
from ..streaming import retry as Q
from ..streaming import streams as S
from .registry import Tables, query

C = F.col


def scratch(t: Tables) -> str:
    """A new folder under the one that spark.checkpoint.dir names."""
    return f"{shared_folder(t.spark)}/surveil-{uuid.uuid4()}"


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _round_trip(t: Tables, kind: str):
    path = f"{scratch(t)}/customer.{kind}"
    d = t.customer.select("c_custkey", "c_name", "c_nationkey")
    I.write(d, path, {"jsonl": "json"}.get(kind, kind))
    return I.read_any(t.spark, path, d.schema)


@query("src_csv", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def src_csv(t: Tables):
    return _round_trip(t, "csv")


@query("src_json", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def src_json(t: Tables):
    return _round_trip(t, "json")


@query("src_orc", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def src_orc(t: Tables):
    return _round_trip(t, "orc")


@query("src_csv_multiline", "SELECT doc_id, md5(text) AS digest FROM documents")
def src_csv_multiline(t: Tables):
    """Texts with line ends and quotes survive a CSV file."""
    path = f"{scratch(t)}/documents.csv"
    t.documents.select("doc_id", "text").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return I.read_any(t.spark, path, "doc_id long, text string", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).select("doc_id", F.md5("text").alias("digest"))


@query("src_parquet", "SELECT event_id, value FROM events WHERE value > 50")
def src_parquet(t: Tables):
    return I.read_any(t.spark, f"{t.directory}/events.parquet").filter("value > 50").select("event_id", "value")


@query("src_jsonl_log", "SELECT event_id FROM events WHERE event_type = 'error'")
def src_jsonl_log(t: Tables):
    path = f"{scratch(t)}/log.jsonl"
    t.events.select("event_id", C("event_type").alias("status")).write.json(path)
    return I.read_any(t.spark, path, "event_id long, status string").filter("status = 'error'").select("event_id")


@query("src_alias", "SELECT event_id AS id, event_type AS stream, value AS visit_count FROM events")
def src_alias(t: Tables):
    raw = t.events.select(C("event_id").alias(" ID "), C("event_type").alias("Kind"), C("value").alias("Visits"))
    return I.rename(raw, {"id": ["record_id"], "stream": ["kind", "source"], "visit_count": ["visits", "count"]})


@query("audit_cols", "SELECT event_id, DATE '2024-02-01' AS ingested_on, true AS from_file FROM events")
def audit_cols(t: Tables):
    d = I.with_audit(t.events, "2024-02-01 00:00:00")
    return d.select("event_id", "ingested_on", C("source_file").contains("events.parquet").alias("from_file"))


@query("snk_part", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders WHERE year(o_orderdate) = 1996")
def snk_part(t: Tables):
    path = f"{scratch(t)}/orders"
    I.write(t.orders.select("o_orderkey", F.year("o_orderdate").alias("y")), path, by=["y"])
    return t.spark.read.parquet(path).filter("y = 1996")  # one folder is read


@query("snk_part_evolving", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS priority FROM orders")
def snk_part_evolving(t: Tables):
    """Two appends, the second with a column that the first did not have."""
    path = f"{scratch(t)}/orders"
    d = t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"), C("o_orderpriority").alias("priority"))
    I.append_evolving(d.filter("o_orderkey % 2 = 0").drop("priority"), path, ["y"])
    I.append_evolving(d.filter("o_orderkey % 2 = 1"), path, ["y"])
    return I.read_evolving(t.spark, path).select("o_orderkey", "y", "priority")


@query("snk_linelist", "SELECT n_name AS state, CASE WHEN s_acctbal < 0 THEN 'overdue' ELSE 'current' END AS report, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def snk_linelist(t: Tables):
    path = f"{scratch(t)}/linelists"
    d = t.supplier.join(F.broadcast(t.nation), C("s_nationkey") == C("n_nationkey")).select("s_suppkey", C("n_name").alias("state"), F.when(C("s_acctbal") < 0, "overdue").otherwise("current").alias("report"))
    I.write(d, path, "csv", by=["state", "report"])
    return t.spark.read.option("header", True).csv(path).groupBy("state", "report").agg(F.count("*").alias("n"))


@query("snk_csv_results", "SELECT 'by_status' AS report, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'by_priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def snk_csv_results(t: Tables):
    """Reports written as CSV, one folder each with a header and one file, and read back."""
    path = f"{scratch(t)}/results"
    for name, c in (("by_status", "o_orderstatus"), ("by_priority", "o_orderpriority")):
        I.write(t.orders.groupBy(C(c).alias("value")).agg(F.count("*").alias("n")).coalesce(1), f"{path}/{name}.csv", "csv")  # a few rows
    out = [I.read_any(t.spark, f"{path}/{name}.csv", "value string, n long").select(F.lit(name).alias("report"), "value", "n") for name in ("by_status", "by_priority")]
    return out[0].unionByName(out[1])


_DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def _database(t: Tables) -> str:
    """An embedded database with the customers, packed into a file of the shared folder that every executor opens read-only."""
    return I.derby_file(t.customer.selectExpr("c_custkey AS K", "c_nationkey AS N", "c_acctbal AS V"), "CUSTOMERS", scratch(t))


@query("src_jdbc", "SELECT c_nationkey AS nation, count(*) AS n_rows, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def src_jdbc(t: Tables):
    """A sub-query of a database; its filter runs there."""
    d = I.read_jdbc(t.spark, _database(t), "(SELECT N, V FROM CUSTOMERS WHERE V > 0) q", **_DERBY)
    return d.groupBy(C("N").alias("nation")).agg(F.count("*").alias("n_rows"), F.round(F.sum("V"), 2).alias("total"))


@query("src_jdbc_part", "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_nationkey < 10")
def src_jdbc_part(t: Tables):
    """A table read in four ranges of its key."""
    low, top = t.customer.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    d = I.read_jdbc(t.spark, _database(t), "CUSTOMERS", "K", (low or 0, top or 0), 4, **_DERBY)
    return d.filter("N < 10").select(C("K").alias("k"), C("V").alias("v"))


@query("snk_tier_export", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 AND c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) GROUP BY 1")
def snk_tier_export(t: Tables):
    rich = t.customer.filter("c_acctbal > 5000")
    top = rich.groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy(C("n").desc(), "c_nationkey").limit(5).select("c_nationkey")
    path = f"{scratch(t)}/tiers"
    I.write(rich.join(F.broadcast(top), "c_nationkey", "left_semi").select("c_custkey", "c_nationkey"), path, by=["c_nationkey"])
    return t.spark.read.parquet(path).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("event_log", "SELECT sha256(CAST(event_id AS VARCHAR) || '_salt') AS hashed_id, 'ERROR' AS severity, 'value above 90' AS message FROM events WHERE value > 90")
def event_log(t: Tables):
    """Rows of a check are appended to the log; the log is what is read."""
    path = f"{scratch(t)}/log"
    for low, high in ((90, 95), (95, None)):
        found = t.events.filter((C("value") > low) & (C("value") <= high if high else F.lit(True)))
        I.write(found.select(X.salted_hash(C("event_id")).alias("hashed_id"), F.lit("ERROR").alias("severity"), F.lit("value above 90").alias("message")), path, mode="append")
    return t.spark.read.parquet(path)


_UP = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer"


@query("merge_upsert", _UP)
def merge_upsert(t: Tables):
    old = t.customer.filter("c_custkey % 9 <> 0").select("c_custkey", "c_acctbal")
    return K.upsert(old, t.customer.filter("c_custkey % 3 = 0").select("c_custkey", (C("c_acctbal") + 1).alias("c_acctbal")), ["c_custkey"])


@query("delete_keys", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def delete_keys(t: Tables):
    return K.delete_keys(t.customer.select("c_custkey", "c_name"), t.orders.filter("o_orderstatus = 'P'").select(C("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("incr_highwater", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20')")
def incr_highwater(t: Tables):
    done = t.events.filter(C("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return K.beyond(t.events, done, "ts").select("event_id")


@query("incr_merge_model", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def incr_merge_model(t: Tables):
    """A daily total kept up by upserting the users that new rows touch."""
    at = F.lit("2024-01-20").cast("timestamp_ntz")
    done = t.events.filter(C("ts") < at)
    total = lambda d: d.groupBy("user_id").agg(F.count("*").alias("n"))
    touched = K.beyond(t.events, done, "ts").select("user_id").distinct()
    return K.upsert(total(done), total(t.events.join(touched, "user_id", "left_semi")), ["user_id"])


@query("batch_checkpoint", "SELECT o_orderkey, o_custkey FROM orders")
def batch_checkpoint(t: Tables):
    path = f"{scratch(t)}/batches"
    d = t.orders.select("o_orderkey", "o_custkey")
    K.load_in_batches(t.spark, d, "o_orderkey", path, 4)
    return K.load_in_batches(t.spark, d, "o_orderkey", path, 4).select("o_orderkey", "o_custkey")  # resumes: nothing is left to do


@query("batch_log", "SELECT CAST(b AS INTEGER) AS batch, status, CASE WHEN status = 'done' THEN true ELSE false END AS has_rows, count(*) AS attempts FROM (VALUES (0, 'done'), (1, 'done'), (2, 'failed'), (2, 'done'), (3, 'done')) v(b, status), (SELECT count(*) AS n FROM orders) WHERE n > 0 GROUP BY 1, 2, 3")
def batch_log(t: Tables):
    """A load whose third batch fails at first: the others go on, and a second call takes it up."""
    path = f"{scratch(t)}/batches"
    d = t.orders.select("o_orderkey", "o_custkey")
    K.load_in_batches(t.spark, d, "o_orderkey", path, 4, lambda part, b: part.filter(F.raise_error(F.lit("no")).cast("boolean")) if b == 2 else part)
    K.load_in_batches(t.spark, d, "o_orderkey", path, 4)
    return K.batch_log(t.spark, path).groupBy("batch", "status", C("n_rows").isNotNull().alias("has_rows")).agg(F.count("*").alias("attempts"))


@query("cache_hot", "SELECT 'status' AS kind, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def cache_hot(t: Tables):
    """A table that several reports read is held in memory, or on disk where memory is short, until they are written."""
    one = lambda hot, kind, c: hot.groupBy(C(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    with held(t.orders.select("o_orderstatus", "o_orderpriority")) as hot:
        return cut(one(hot, "status", "o_orderstatus").unionByName(one(hot, "priority", "o_orderpriority")))


@query("split_valid", "SELECT event_id, CASE WHEN value < 5 AND event_type = 'error' THEN 'low,kind' WHEN value < 5 THEN 'low' ELSE 'kind' END AS reason FROM events WHERE value < 5 OR event_type = 'error'")
def split_valid(t: Tables):
    _, bad = K.split_valid(t.events.select("event_id", "value", "event_type"), {"low": C("value") >= 5, "kind": C("event_type") != "error"})
    return bad.select("event_id", "reason")


@query("scd2", "SELECT c_custkey, c_acctbal, TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN c_custkey % 10 = 0 OR c_custkey % 7 = 0 THEN TIMESTAMP '2024-02-01' END AS valid_to FROM customer UNION ALL SELECT c_custkey, c_acctbal + 5, TIMESTAMP '2024-02-01', NULL FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 7 <> 0")
def scd2(t: Tables):
    base = t.customer.select("c_custkey", "c_acctbal")
    first = base.select("*", F.lit("2024-01-01").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    later = base.filter("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(C("c_custkey") % 10 == 0, C("c_acctbal") + 5).otherwise(C("c_acctbal")))
    return K.history(first, later, ["c_custkey"], "2024-02-01 00:00:00")


@query("is_current_rule", "SELECT o_orderkey, o_orderkey % 3 = 0 OR CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AS is_current FROM orders")
def is_current_rule(t: Tables):
    end = F.when(C("o_orderkey") % 3 != 0, C("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", (end.isNull() | (end >= F.lit("1998-01-01").cast("date"))).alias("is_current"))


@query("compaction", "SELECT count(*) AS n, min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders")
def compaction(t: Tables):
    path = f"{scratch(t)}/compacted"
    I.compact(t.orders, path, ["o_custkey"], 4)
    return t.spark.read.parquet(path).agg(F.count("*").alias("n"), F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi"))


_V = "SELECT {n} AS step, count(*) AS n, round(sum({x}), 2) AS total FROM customer WHERE {w}"


@query("version_log", " UNION ALL ".join(_V.format(n=n, x=x, w=w) for n, x, w in (("'first'", "c_acctbal", "true"), ("'by number'", "c_acctbal * 2", "true"), ("'at noon'", "c_acctbal", "true"), ("'at night'", "c_acctbal * 2", "true"), ("'rolled back'", "c_acctbal", "true"), ("'after'", "c_acctbal", "c_custkey % 2 = 0"), ("'vacuumed'", "c_acctbal", "c_custkey % 2 = 0"))))
def version_log(t: Tables):
    """A table read by number, as of a time, after a roll back, after a later commit, and after old versions are removed."""
    path = f"{scratch(t)}/versioned"
    d = t.customer.select("c_custkey", "c_acctbal")
    seen = []

    def note(step, df):
        seen.append(df.agg(F.lit(step).alias("step"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")).first())

    K.commit(d, path, "2024-01-01 08:00:00")
    note("first", K.as_of(t.spark, path))
    K.commit(d.withColumn("c_acctbal", C("c_acctbal") * 2), path, "2024-01-01 18:00:00")
    note("by number", K.as_of(t.spark, path, version=2))
    note("at noon", K.as_of(t.spark, path, time="2024-01-01 12:00:00"))
    K.roll_back(t.spark, path, 1, "2024-01-02 08:00:00")
    note("at night", K.as_of(t.spark, path, time="2024-01-01 23:00:00"))
    note("rolled back", K.as_of(t.spark, path))
    K.commit(K.as_of(t.spark, path).filter("c_custkey % 2 = 0"), path, "2024-01-03 08:00:00")
    note("after", K.as_of(t.spark, path))
    K.vacuum(t.spark, path)
    note("vacuumed", K.as_of(t.spark, path))
    return t.spark.createDataFrame(seen, "step string, n long, total double")


@query("version_read", "SELECT c_custkey, c_acctbal FROM customer")
def version_read(t: Tables):
    path = f"{scratch(t)}/versions"
    d = t.customer.select("c_custkey", "c_acctbal")
    K.save_version(d, path, 1)
    K.save_version(d.withColumn("c_acctbal", C("c_acctbal") * 2), path, 2)
    return K.read_version(t.spark, path, 1)


@query("feature_table", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def feature_table(t: Tables):
    return K.feature_table(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")), ["o_custkey"])


@query("table_volume", "SELECT 'bronze' AS layer, count(*) AS n, count(DISTINCT l_orderkey) AS members FROM lineitem UNION ALL SELECT 'silver', count(*), count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'gold', count(*), count(DISTINCT c_custkey) FROM customer")
def table_volume(t: Tables):
    one = lambda name, df, key: df.agg(F.lit(name).alias("layer"), F.count("*").alias("n"), F.countDistinct(key).alias("members"))
    return one("bronze", t.lineitem, "l_orderkey").unionByName(one("silver", t.orders, "o_orderkey")).unionByName(one("gold", t.customer, "c_custkey"))


# ---------------------------------------------------------------- streams


def _event_files(t: Tables) -> str:
    """The events as several files, as a landing folder has them."""
    path = f"{scratch(t)}/landing"
    t.events.withColumn("ts", C("ts").cast("timestamp")).repartition(4, "event_id").write.parquet(path)
    return path


_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@query("str_file_available_now", "SELECT event_id, user_id, value FROM events")
def str_file_available_now(t: Tables):
    src, out = _event_files(t), scratch(t)
    d = S.files(t.spark, src, _SCHEMA, per_batch=2).select("event_id", "user_id", "value")
    S.run_once(d, f"{out}/data", f"{out}/checkpoint")
    S.run_once(d, f"{out}/data", f"{out}/checkpoint")  # adds nothing
    return t.spark.read.parquet(f"{out}/data")


@query("str_json_events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def str_json_events(t: Tables):
    src, out = _event_files(t), scratch(t)
    d = S.from_json_events(S.files(t.spark, src, _SCHEMA).select("event_id", C("props").alias("value")).select(F.to_json(F.struct("event_id", "value")).alias("value")), "event_id long, value string")
    S.run_once(d.select("event_id", F.from_json("value", "k int")["k"].alias("k")), f"{out}/data", f"{out}/checkpoint")
    return t.spark.read.parquet(f"{out}/data")


@query("str_json_30s", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(value) AS with_value FROM events GROUP BY 1")
def str_json_30s(t: Tables):
    """JSON files through the timed trigger of 30 seconds, written by date; stopped when all that is there is written."""
    src, out = f"{scratch(t)}/json", scratch(t)
    t.events.select("event_id", C("ts").cast("timestamp").alias("ts"), "value").write.json(src)
    d = S.files(t.spark, src, "event_id long, ts timestamp, value double", "json").withColumn("day", F.to_date("ts"))
    q = S.every(d, f"{out}/data", f"{out}/checkpoint", 30, ["day"])
    q.processAllAvailable()
    q.stop()
    return t.spark.read.parquet(f"{out}/data").groupBy("day").agg(F.count("*").alias("n"), F.count("value").alias("with_value"))


@query("str_silver_fhir", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type <> 'error' GROUP BY 1")
def str_silver_fhir(t: Tables):
    src, out = _event_files(t), scratch(t)

    def silver(batch, _):
        batch.filter("event_type <> 'error'").select("user_id", "value").write.mode("append").parquet(f"{out}/silver")

    S.batches(S.files(t.spark, src, _SCHEMA, per_batch=2), silver, f"{out}/checkpoint")
    return t.spark.read.parquet(f"{out}/silver").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("str_retry_round", "SELECT event_id AS sample_id, CASE WHEN user_id % 3 = 0 THEN 'success' WHEN user_id % 7 = 6 THEN 'dead' ELSE 'waiting' END AS state FROM events WHERE event_type = 'error'")
def str_retry_round(t: Tables):
    """One round: every third user's sample succeeds; of the others those with five retries behind them are dead."""
    e = t.events.filter("event_type = 'error'")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    queue = e.filter("user_id % 2 = 0").select(C("event_id").alias("sample_id"), C("user_id").alias("payload"), F.when(C("user_id") % 7 == 6, 5).otherwise(0).alias("retry_count"), C("ts").cast("timestamp").alias("process_after"))
    new = e.filter("user_id % 2 = 1").select(C("event_id").alias("sample_id"), C("user_id").alias("payload"), F.when(C("user_id") % 7 == 6, 5).otherwise(0).alias("retry_count"))
    left, done, dead = S.retry_round(queue, new, C("payload") % 3 == 0, now)
    state = lambda d, s: d.select("sample_id", F.lit(s).alias("state"))
    return state(left, "waiting").unionByName(state(done, "success")).unionByName(state(dead, "dead"))


@query("str_alerts", "SELECT event_id, 'high' AS alert FROM events WHERE value > 95 AND event_id % 5 <> 0 UNION ALL SELECT event_id, 'error' FROM events WHERE event_type = 'error' AND event_id % 5 <> 0")
def str_alerts(t: Tables):
    """Alerts of a stream, less those acknowledged."""
    src, out = _event_files(t), scratch(t)
    S.run_once(S.alerts(S.files(t.spark, src, _SCHEMA), {"high": C("value") > 95, "error": C("event_type") == "error"}, ["event_id"]), f"{out}/data", f"{out}/checkpoint")
    seen = t.events.filter("event_id % 5 = 0").select("event_id")
    return t.spark.read.parquet(f"{out}/data").join(seen, "event_id", "left_anti")


@query("str_freshness", "SELECT event_type, date_diff('minute', max(ts), TIMESTAMP '2024-01-31') > 15 AS stale FROM events GROUP BY 1")
def str_freshness(t: Tables):
    age = (F.unix_timestamp(F.lit("2024-01-31").cast("timestamp")) - F.unix_timestamp(F.max("ts").cast("timestamp"))) / 60
    src, out = _event_files(t), scratch(t)
    return S.newest_result(S.files(t.spark, src, _SCHEMA, per_batch=2).groupBy("event_type").agg((age > 15).alias("stale")), f"{out}/data", f"{out}/checkpoint")


def _landings(t: Tables, *parts) -> tuple[str, list]:
    """A landing folder, and for each part what puts it there."""
    path = f"{scratch(t)}/landing"
    return path, [lambda d=d: d.withColumn("ts", C("ts").cast("timestamp")).coalesce(2).write.mode("append").parquet(path) for d in parts]


def _runs(t: Tables, build, *parts):
    """The rows that a stream over the parts has written; it is stopped after each part and started again from its checkpoint."""
    path, land = _landings(t, *parts)
    out = scratch(t)
    for put in land:
        put()
        with Q.keyed_state(t.spark):
            S.run_once(build(S.files(t.spark, path, _SCHEMA)), f"{out}/data", f"{out}/checkpoint")
    return t.spark.read.parquet(f"{out}/data")


def _early_late(t: Tables):
    at = F.lit("2024-01-20").cast("timestamp_ntz")
    return t.events.filter(C("ts") < at), t.events.filter(C("ts") >= at)


_RETRY_SQL = """WITH e AS (SELECT event_id, user_id % 8 AS fails, epoch_ms(ts) AS ms FROM events WHERE event_type = 'error'), w AS (SELECT max(ms) AS mark FROM e),
 n AS (SELECT e.*, (SELECT count(*) FROM range(1, 6) r(k) WHERE ms + (pow(2, k) - 2 + pow(2, k)) * 60000 <= mark) AS due FROM e, w)
 SELECT event_id AS sample_id, CASE WHEN due < least(fails, 5) THEN 'waiting' WHEN fails <= 5 THEN 'success' ELSE 'dead' END AS state,
 CAST(CASE WHEN due < least(fails, 5) THEN due + 1 WHEN fails <= 5 THEN fails ELSE 6 END AS INTEGER) AS retry_count FROM n"""


@query("str_retry", _RETRY_SQL)
def str_retry(t: Tables):
    """Samples of errors that fail user_id % 8 times: they wait 2, 4, 8, 16 and 32 minutes of event time, then succeed or are dead; restarted once on the way."""
    wrong = [d.filter("event_type = 'error'") for d in _early_late(t)]
    steps = _runs(t, lambda d: Q.retries(d.withWatermark("ts", "0 seconds"), lambda payload, n: n >= int(payload) % 8, "event_id", "user_id", "ts"), *wrong)
    return Q.last_steps(steps).select(C("key").alias("sample_id"), "state", "retry_count")


_MARK = "(SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)"


@query("str_sliding", f"SELECT start, event_type, n FROM (SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL 12 HOURS]) AS start FROM events) GROUP BY 1, 2), {_MARK} WHERE start + INTERVAL 1 DAY <= mark")
def str_sliding(t: Tables):
    """Days that begin every twelve hours, each written once, when the watermark has passed it. Rows sent again ten days late are not counted."""
    early, later = _early_late(t)
    old = t.events.filter(C("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    return _runs(t, lambda d: S.tumbling(d, "ts", ["event_type"], "1 day", "1 day", "12 hours").select("start", "event_type", "n"), early, later.unionByName(old))


@query("str_sessions_live", f"SELECT user_id, start, n FROM (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS closed, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s), {_MARK} WHERE closed <= mark")
def str_sessions_live(t: Tables):
    """Sessions of a stream, each written once, when six quiet hours have passed the watermark; late rows are not counted."""
    early, later = _early_late(t)
    old = t.events.filter(C("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    return _runs(t, lambda d: S.sessions(d, "ts", ["user_id"], "6 hours", "1 day").select("user_id", "start", "n"), early, later.unionByName(old))


@query("str_once", "SELECT event_id, user_id FROM events")
def str_once(t: Tables):
    """Rows that come again within a day of event time, or later than that, are written once."""
    early, later = _early_late(t)
    again = t.events.filter("event_id % 7 = 0")
    return _runs(t, lambda d: S.once_each(d, ["event_id"], "ts", "1 day").select("event_id", "user_id"), early.unionByName(early.filter("event_id % 5 = 0")), later.unionByName(again.join(early.select("event_id"), "event_id", "left_semi")))


_RULES_SQL = """WITH b AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 0 WHEN ts < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END AS batch, event_id % 10 = 0 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AS bad FROM events),
 r AS (SELECT batch, 'value' AS rule, 'ERROR' AS severity, 0.0 AS mostly, bad OR value < 0 AS broken FROM b UNION ALL SELECT batch, 'kind', 'WARNING', 0.5, event_type = 'error' FROM b UNION ALL SELECT batch, 'customer', 'ERROR', 0.0, bad OR user_id NOT IN (SELECT c_custkey - 1 FROM customer) FROM b)
 SELECT batch, rule, count(*) AS n_rows, count(*) FILTER (broken) AS n_broken, CASE WHEN count(*) FILTER (broken) <= mostly * count(*) THEN 'PASS' ELSE 'FAIL' END AS status, severity FROM r GROUP BY batch, rule, severity, mostly"""


@query("str_quality_rules", _RULES_SQL)
def str_quality_rules(t: Tables):
    """Three batches, the second with rows that break a rule in SQL and point to no customer; a verdict for each batch and rule."""
    cuts = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10", "2024-01-20")]
    bad = (C("event_id") % 10 == 0) & (C("ts") >= cuts[0]) & (C("ts") < cuts[1])
    e = t.events.withColumn("value", F.when(bad, -1.0).otherwise(C("value"))).withColumn("user_id", F.when(bad, -5).otherwise(C("user_id")))
    path, land = _landings(t, e.filter(C("ts") < cuts[0]), e.filter((C("ts") >= cuts[0]) & (C("ts") < cuts[1])), e.filter(C("ts") >= cuts[1]))
    out = scratch(t)
    known = t.customer.select((C("c_custkey") - 1).alias("id"))
    rules = [S.RowRule("value", "value >= 0"), S.RowRule("kind", "event_type <> 'error'", 0.5, "WARNING"), S.KnownKey("customer", "user_id", known, "id")]
    for put in land:
        put()
        S.checked(S.files(t.spark, path, _SCHEMA), rules, out, f"{out}/checkpoint")
    return t.spark.read.parquet(f"{out}/verdicts").select(C("batch").cast("long").alias("batch"), "rule", "n_rows", "n_broken", "status", "severity")


@query("str_windowed", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str_windowed(t: Tables):
    src, out = _event_files(t), scratch(t)
    d = S.tumbling(S.files(t.spark, src, _SCHEMA, per_batch=2), "ts", ["event_type"], "1 day").select("start", "event_type", "n")
    return S.newest_result(d, f"{out}/data", f"{out}/checkpoint")


@query("str_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def str_sessions(t: Tables):
    d = t.events.withColumn("ts", C("ts").cast("timestamp"))
    return S.sessions(d, "ts", ["user_id"], "6 hours").select("user_id", "start", "n")
