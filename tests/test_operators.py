"""Edge cases and properties of the operators."""

import datetime as dt
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from surveil.functions import clinical as X
from surveil.functions import text as TX
from surveil.operators import _helpers
from surveil.operators import checks as K
from surveil.operators import joins as J
from surveil.operators import statistics as S
from surveil.operators import windows as O
from surveil.sources import files as I
from surveil.sources import tables as B
from surveil.streaming import streams as R

C = F.col


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_expressions_with_nulls(spark):
    n, s = F.lit(None).cast("double"), F.lit(None).cast("string")
    r = one(spark, X.pcr_result([n, n], [40, 40]), X.s_gene_failure(F.lit(20.0), F.lit(20.0), n), X.gender(s), X.ethnicity(F.lit("Not Hispanic")), X.variant(F.lit("BA.2")), X.variant(F.lit("x"), F.lit("given")), X.completeness(n, F.lit(1)), X.zip5(F.lit("1234")), X.parse_number(F.lit("pos")))
    assert tuple(r) == ("Not Detected", True, "U", "Not Hispanic", "Omicron", "given", 0.5, None, None)


def test_weeks(spark):
    for day, week, year, end in (("2023-12-31", 1, 2024, "2024-01-06"), ("2022-01-01", 52, 2021, "2022-01-01"), ("2020-12-31", 53, 2020, "2021-01-02")):
        d = F.lit(day).cast("date")
        assert tuple(one(spark, X.mmwr_week(d), X.mmwr_year(d), X.epi_week(d).cast("string"))) == (week, year, end)


def test_redaction_of_texts_with_letters_beyond_ascii(spark, tmp_path):
    """Words end, white space and letter case are as in the SQL; then stored digests agree."""
    import duckdb

    from surveil.plans import registry

    texts = ["zu 12 Abc St\u00e4dte", "\u00e9123-45-6789\u00e9", "\u00c9Anna Lee was", "12\x0bAbc Street", "12 Abc \u017ftreet", "\u00e4a@b.com\u00e4", "Dr. Who\u00fc", "1/2/2024\u00df", "x@y.co 5551234567\u0660", "12 Abc St.", "12 Abc St.\u00e4", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for q, columns in (("redact_pii", "doc_id, redacted, kinds"), ("redact_stats", "kind, n, pct"), ("deidentify_text", "doc_id, n, digest")):
        got = sorted(map(tuple, registry.QUERIES[q](spark, str(tmp_path)).selectExpr(*columns.split(", ")).collect()))
        assert got == sorted(con.execute(f"SELECT {columns} FROM ({registry.SQL[q]})").fetchall()), q


def test_redaction(spark):
    cases = {
        "SSN 123-45-6789": ("SSN [SSN_REDACTED]", "SSN"), "call 555-123-4567": ("call [PHONE_REDACTED]", "phone"), "call (555) 123-4567": ("call [PHONE_REDACTED]", "phone"), "a@b.org": ("[EMAIL_REDACTED]", "email"),
        "on 01/15/2023": ("on [DATE_REDACTED]", "date"), "on january 15, 2023": ("on [DATE_REDACTED]", "date"), "on Jan 15, 2024 at noon": ("on [DATE_REDACTED] at noon", "date"),
        "saw Dr. Jones": ("saw Dr. [NAME_REDACTED]", "name"), "John Smith had": ("[NAME_REDACTED] had", "name"), "According to John Doe, he": ("according to [NAME_REDACTED], he", "name"), "met John Smith": ("met John Smith", ""),
        "at 123 Main Street in": ("at [ADDRESS_REDACTED] in", "address"), "at 12 oak ave.": ("at [ADDRESS_REDACTED].", "address"),
        "Chronic Depression and Acute Anxiety": ("Chronic Depression and Acute Anxiety", ""), "clean text": ("clean text", ""), "": ("", ""), "he is 45 years old": ("he is 45 years old", ""),
        "Mr. Bell, 123-45-6789, a@b.org": ("Mr. [NAME_REDACTED], [SSN_REDACTED], [EMAIL_REDACTED]", "SSN,email,name"),
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    for r in TX.redact(df, "t").select("t", "redacted", F.array_join("kinds", ",").alias("k")).collect():
        assert (r.redacted, r.k) == (cases[r.t] if r.t is not None else ("", "")), r
    old = TX.redact(spark.createDataFrame([("45 years old",)], "t string"), "t", ages=True).first()
    assert (old.redacted, old.kinds) == ("[AGE_REDACTED] years old", ["age"])
    flags = TX.keyword_flags(F.lit("body of work"))
    assert not one(spark, flags["overdose"])[0] and one(spark, TX.keyword_flags(F.lit("an OD, fentanyl"))["overdose"])[0]


def test_asof_ties_and_missing(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 3)], "k int, t int")
    b = spark.createDataFrame([(1, 5, "same"), (1, 2, "old"), (3, 0, "other")], "k int, t int, v string")
    got = {(r.k, r.t): r.v for r in J.asof_join(a, b, ["k"], "t", "t", ["v"]).collect()}
    assert got == {(1, 5): "same", (1, 1): None, (2, 3): None}


def test_within_finds_each_pair_once(spark):
    a = spark.createDataFrame([(0, k) for k in range(0, 40, 3)], "k int, x int")
    b = spark.createDataFrame([(0, k) for k in range(-10, 50, 2)], "k int, y int")
    got = sorted((r.x, r.y) for r in J.within(a, b, ["k"], "x", "y", 7).collect())
    assert got == sorted((x, y) for x in range(0, 40, 3) for y in range(-10, 50, 2) if abs(x - y) <= 7)


def test_split_join_is_a_join(spark):
    a = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(60)] + [(None, 99)], "k int, v int")
    b = spark.createDataFrame([(k, f"r{k}") for k in range(30)] + [(1, "again")], "k int, w string")
    want = sorted(map(tuple, a.join(b, "k").collect()))
    assert sorted(map(tuple, J.split_join(a, b, "k", 0.3, 4).collect())) == want
    assert sorted(map(tuple, J.salted_join(a, b, "k", 5).collect())) == want


def test_days_covered_with_overlaps(spark):
    d = lambda m, x: dt.date(2024, m, x)
    spans = spark.createDataFrame([(1, d(1, 1), d(1, 10)), (1, d(1, 5), d(1, 7)), (1, d(1, 9), d(1, 12)), (1, d(2, 1), d(2, 1)), (2, dt.date(2023, 1, 1), d(1, 2)), (3, d(5, 1), d(4, 1))], "k int, s date, e date")
    assert {r.k: r.days for r in O.days_covered(spans, "k", "s", "e", "2024-01-01", "2024-01-31").collect()} == {1: 12, 2: 2}


def test_anchored_groups(spark):
    days = [dt.date(2024, 1, x) for x in (1, 5, 8, 9, 16, 17)]
    got = [r.anchor.day for r in O.anchored_groups(spark.createDataFrame([(1, x) for x in days], "k int, d date"), ["k"], "d", 7).orderBy("d").collect()]
    assert got == [1, 1, 1, 9, 9, 17]


def test_checks_on_empty_and_bad_rows(spark):
    df = spark.createDataFrame([(1, None), (1, 5)], "id int, v int")
    checks = [K.rows("rows"), K.unique("unique", C("id")), K.not_null("v", C("v"), 0.5), K.failing("low", C("v") < 3)]
    assert [r.status for r in K.run(df, checks).collect()] == ["PASS", "FAIL", "PASS", "PASS"]
    assert [r.status for r in K.run(df.limit(0), checks).collect()] == ["FAIL", "PASS", "FAIL", "FAIL"]
    assert K.scorecard(K.run(df, checks)).first().score == 75.0


def test_psi_and_ks_of_equal_samples(spark):
    df = spark.createDataFrame([(s, float(k % 17)) for s in (0, 1) for k in range(200)], "s int, v double").withColumn("g", F.lit("a"))
    assert abs(S.psi(df, "g", C("s"), C("v")).first().psi) < 1e-12
    assert S.ks(df, "g", C("s"), "v").first().ks == 0


def test_p_values():
    assert abs(S.t_p_value(2.0, 10) - 0.07338803477074052) < 1e-10
    assert abs(S.f_p_value(4.0, 2, 12) - 0.046656) < 1e-5


def test_p_values_of_known_cases():
    assert abs(S.chi2_p_value(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(S.chi2_p_value(7.814727903251179, 3) - 0.05) < 1e-9
    assert abs(S.chi2_p_value(9.487729036781154, 4) - 0.05) < 1e-9
    assert S.chi2_p_value(0.0, 1) == S.chi2_p_value(0.0, 4) == 1
    assert abs(S.t_interval(10) - 2.2281388519649385) < 1e-8


def test_totals_below_with_one_key_for_all(spark):
    rows = [(None if k % 5 == 0 else 0, k, k * k) for k in range(400)] + [(7, 3, 1)]
    df = spark.createDataFrame(rows, "g int, o int, v long")
    got = {(r.g, r.o): r.below_v for r in O.totals_below(df, ["g"], "o", ["v"]).collect()}
    assert got == {(g, o): sum(v for h, p, v in rows if h == g and p < o) for g, o, _ in rows}
    assert sorted(r.below_v for r in O.totals_below(df.filter("g = 0"), [], "o", ["v"]).collect()) == sorted(v for (g, _), v in got.items() if g == 0)
    assert O.totals_below(df.filter("false"), [], "o", ["v"]).count() == 0


def test_reports_of_models(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.8), (0, 0, 0.7), (0, 1, 0.9), (1, 1, 0.95), (0, 0, 0.1)]
    df = spark.createDataFrame(rows, "y int, z int, s double")
    r = S.class_report(df, C("y"), C("z")).first()
    assert (round(r.accuracy, 6), round(r.precision, 6), round(r.recall, 6), round(r.f1, 6)) == (0.666667, 0.666667, 0.666667, 0.666667)
    assert abs(S.average_precision(df, C("y"), C("s")).first()[0] - (1 + 2 / 3 + 3 / 4) / 3) < 1e-12
    pairs = [(a, b) for y, _, a in rows if y for z, _, b in rows if not z]
    assert abs(S.auc(df, C("y"), C("s")).first().auc - sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)) < 1e-12


def test_pages(spark):
    html = "<p>A &amp; B</p><script>no()</script><!-- no --><table><tr><th>x</th></tr><tr></tr><tr><td> 1 </td><td><b>2</b></td></tr></table><a class='k' href=\"/u\"><i>go</i> on</a><table></table>"
    r = one(spark, *(f(F.lit(html)).alias(n) for n, f in (("text", TX.strip_tags), ("links", TX.links), ("tables", TX.tables))), TX.strip_tags(F.lit(None).cast("string")).alias("none"), TX.nfc(F.lit("e\u0301")).alias("nfc"))
    assert r.text == "A & Bx 1 2go on" and [tuple(x) for x in r.links] == [("/u", "go on")] and r.none is None
    assert r.tables == [[["x"], ["1", "2"]], []] and r.nfc == "\u00e9"


def test_database_file_that_other_processes_read(spark, tmp_path):
    """A database in the driver's memory is empty for another JVM; one in a file is not."""
    d = spark.range(1000).selectExpr("id AS K", "IF(id % 7 = 0, NULL, CAST(id AS double) / 3) AS V").repartition(3)
    url = I.derby_file(d, "T", f"file:{tmp_path}")
    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").getOrCreate()
d = s.read.format("jdbc").options(url={url!r}, dbtable="T", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", partitionColumn="K", lowerBound=0, upperBound=1000, numPartitions=4).load()
print("ROWS", d.count(), d.where("V IS NULL").count(), d.selectExpr("sum(V)").first()[0], d.rdd.getNumPartitions())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=tmp_path).stdout
    assert out.split("ROWS ")[-1].split() == ["1000", "143", str(d.selectExpr("sum(V)").first()[0]), "4"]


def test_jdbc_in_ranges(spark):
    url = "jdbc:derby:memory:surveil;create=true"
    spark.range(100).selectExpr("id AS K", "id * 2 AS V").write.jdbc(url, "T", mode="overwrite", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    df = I.read_jdbc(spark, url, "T", "K", (0, 100), 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert df.rdd.getNumPartitions() == 4 and df.agg(F.sum("V")).first()[0] == 9900
    assert I.read_jdbc(spark, url, "(SELECT K FROM T WHERE K < 7) q", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").count() == 7


def test_density_clusters(spark):
    pts = [(k, 30 + 0.1 * (k % 5), -90 + 0.1 * (k // 5)) for k in range(20)] + [(100 + k, 40.0 + 0.05 * k, -80.0) for k in range(5)] + [(200, 10.0, 10.0)]
    got = {r.id: r.cluster for r in S.density_clusters(spark.createDataFrame(pts, "id long, la double, lo double"), "id", "la", "lo", 20.0, 3).collect()}
    assert got == {k: 0 for k in range(20)} | {100 + k: 100 for k in range(5)}


def test_upsert_and_history(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    s = spark.createDataFrame([(2, "x"), (4, "y")], "k int, v string")
    once = B.upsert(t, s, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, B.upsert(once, s, ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "c"), (4, "y")]
    empty = t.limit(0).selectExpr("*", "cast(null as timestamp) valid_from", "cast(null as timestamp) valid_to")
    h = B.history(B.history(B.history(empty, t, ["k"], "2024-01-01"), s, ["k"], "2024-02-01"), s, ["k"], "2024-03-01")
    rows = sorted((r.k, r.v, r.valid_from.month, r.valid_to and r.valid_to.month) for r in h.collect())
    assert rows == [(1, "a", 1, 2), (2, "b", 1, 2), (2, "x", 2, None), (3, "c", 1, 2), (4, "y", 2, None)]
    assert B.beyond(t, t.limit(0), "k").count() == 3


def test_batches_resume(spark, tmp_path):
    d = spark.range(100)
    path = f"{tmp_path}/b"
    assert B.load_in_batches(spark, d, "id", path, 3).count() == 100
    assert B.load_in_batches(spark, d.limit(0), "id", path, 3).count() == 100  # all batches are done
    ok, bad = B.split_valid(d, {"even": C("id") % 2 == 0, "null": F.when(C("id") < 10, True)})
    assert ok.count() == 5 and bad.filter("reason = 'even,null'").count() == 45


def test_failed_batch_is_kept_and_taken_up(spark, tmp_path):
    path = f"{tmp_path}/b"

    def work(part, b):
        return part.filter(F.raise_error(F.lit("broken")).cast("boolean")) if b == 1 else part

    d = spark.range(100)
    some = B.load_in_batches(spark, d, "id", path, 3, work)
    n = some.count()
    assert 0 < n < 100 and not some.filter("batch = 1").count()
    assert B.load_in_batches(spark, d.limit(0), "id", path, 3).count() == 100  # from what was kept
    log = sorted((r.batch, r.status, r.n_rows) for r in B.batch_log(spark, path).select("batch", "status", F.coalesce("n_rows", F.lit(-1)).alias("n_rows")).collect())
    assert [x[:2] for x in log] == [(0, "done"), (1, "done"), (1, "failed"), (2, "done")] and sum(max(x[2], 0) for x in log) == 100
    assert "broken" in B.batch_log(spark, path).filter("status = 'failed'").first().error


def test_upsert_rejects_repeated_keys(spark):
    target = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int")
    with pytest.raises(Exception, match="repeats a key"):
        B.upsert(target, spark.createDataFrame([(1, 3), (1, 4)], "k int, v int"), ["k"]).collect()
    assert B.upsert(target, target.filter("false"), ["k"]).count() == 2


def test_readers(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "quoted"\nline, é'), (2, None)], "id int, t string")
    I.write(d, f"{tmp_path}/x.json", "json")
    assert sorted(map(tuple, I.read_any(spark, f"{tmp_path}/x.json", d.schema).collect())) == sorted(map(tuple, d.collect()))
    assert I.rename(spark.createDataFrame([(1, 2)], "A int, ` Count ` int"), {"visits": ["count"], "a": ["b"]}).columns == ["a", "visits"]


def test_retry_rounds(spark):
    at = lambda h: F.lit(f"2024-01-01 {h:02d}:00:00").cast("timestamp")
    _helpers.cut(spark.range(1))
    queue = spark.createDataFrame([], "sample_id int, payload int, retry_count int, process_after timestamp")
    new = spark.createDataFrame([(1, 0), (2, 1)], "sample_id int, payload int")
    gone = []
    for h in range(1, 8):
        queue, done, dead = R.retry_round(queue, new if h == 1 else new.limit(0), C("payload") == 1, at(h), most=3)
        queue = queue.checkpoint()
        gone += [("done", r.sample_id, h) for r in done.collect()] + [("dead", r.sample_id, h) for r in dead.collect()]
    assert gone == [("done", 2, 1), ("dead", 1, 4)] and queue.count() == 0


def test_stream_windows_equal_batch(spark, tmp_path):
    d = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m), h % 2) for h in range(6) for m in (0, 20, 40)], "ts timestamp, k int")
    d.repartition(3).write.parquet(f"{tmp_path}/in")
    s = R.tumbling(R.files(spark, f"{tmp_path}/in", d.schema), "ts", ["k"], "1 hour")
    q = s.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, R.tumbling(d, "ts", ["k"], "1 hour").collect()))
    assert sorted(map(tuple, spark.sql("select * from tumbled").collect())) == want and len(want) == 6
