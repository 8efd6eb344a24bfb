"""Text: redaction, keyword factors, guards, pages, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ranking as R
from .registry import Tables, query

C = F.col


def _sql_list(words: list[str], low: str) -> str:
    return " OR ".join(f"contains({low}, '{w}')" for w in words)


def _redacted() -> str:
    """The steps of X.redact, without ages, as common table expressions r0, r1, ..."""
    out, k = "r0 AS (SELECT doc_id, coalesce(text, '') AS x, [] AS kinds FROM documents)", 0
    for kind, patterns in X.STEPS[:-1]:
        new = "x"
        for p, mark in patterns:
            option = "gi" if p.startswith("(?i)") else "g"
            new = f"regexp_replace({new}, '{p.removeprefix('(?i)')}', '{mark.replace('$', chr(92))}', '{option}')"
        hit = "contains(y, '[NAME_REDACTED]')" if kind == "name" else "y <> x"
        out += f", r{k + 1} AS (SELECT doc_id, y AS x, CASE WHEN {hit} THEN list_append(kinds, '{kind}') ELSE kinds END AS kinds FROM (SELECT doc_id, x, kinds, {new} AS y FROM r{k}))"
        k += 1
    return f"WITH {out}, r AS (SELECT * FROM r{k})"


@query("redact_pii", _redacted() + " SELECT doc_id, x AS redacted, array_to_string(kinds, ',') AS kinds FROM r")
def redact_pii(t: Tables):
    return X.redact(t.documents, "text").select("doc_id", "redacted", F.array_join("kinds", ",").alias("kinds"))


_KINDS = [k for k, _ in X.STEPS]


@query("redact_stats", _redacted() + f""" SELECT kind, count(r.doc_id) AS n, round(100.0 * count(r.doc_id) / (SELECT count(*) FROM documents), 2) AS pct
 FROM (SELECT unnest({_KINDS}) AS kind) k LEFT JOIN r ON list_contains(r.kinds, k.kind) GROUP BY kind""")
def redact_stats(t: Tables):
    """How many texts hold each kind; kinds that none holds have 0."""
    per_kind = [F.count_if(F.array_contains("kinds", k)).alias(k) for k in _KINDS]
    one = X.redact(t.documents.select("text"), "text").agg(F.count("*").alias("total"), *per_kind)
    long = one.select("total", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in _KINDS))).alias("x"))
    return long.select("x.kind", "x.n", F.round(100.0 * C("x.n") / C("total"), 2).alias("pct"))


@query("deidentify_text", rf"""SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{X.PHONES[0]}', '[PHONE]', 'g'), '{X.SSN}', '[SSN]', 'g'), '{X.EMAIL}', '[EMAIL]', 'g'), '{X.IP}', '[IP]', 'g'), '{X.URL}', '[URL]', 'g') AS x FROM documents)""")
def deidentify_text(t: Tables):
    return t.documents.select("doc_id", X.deidentify(C("text")).alias("x")).select("doc_id", F.length("x").alias("n"), F.md5("x").alias("digest"))


@query("deidentify_record", "SELECT 'P_' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8) AS pseudonym, CASE WHEN 2001 - (1900 + c_custkey % 95) > 89 THEN 1911 ELSE 1900 + c_custkey % 95 END AS birth_year, c_mktsegment FROM customer")
def deidentify_record(t: Tables):
    year = 1900 + C("c_custkey") % 95
    return t.customer.select(F.concat(F.lit("P_"), F.left(F.sha2(C("c_custkey").cast("string"), 256), F.lit(8))).alias("pseudonym"), F.when(2001 - year > 89, 1911).otherwise(year).alias("birth_year"), "c_mktsegment")


@query("phi_class", "SELECT c_custkey, CASE WHEN c_name IS NOT NULL AND c_acctbal > 0 THEN 'RESTRICTED' WHEN c_nationkey < 5 THEN 'LIMITED' ELSE 'UNRESTRICTED' END AS class FROM customer")
def phi_class(t: Tables):
    return t.customer.select("c_custkey", F.when(C("c_name").isNotNull() & (C("c_acctbal") > 0), "RESTRICTED").when(C("c_nationkey") < 5, "LIMITED").otherwise("UNRESTRICTED").alias("class"))


@query("audit_digest", "SELECT o_custkey, substr(sha256(string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY CAST(o_orderkey AS VARCHAR))), 1, 16) AS digest FROM orders GROUP BY 1")
def audit_digest(t: Tables):
    ids = F.array_sort(F.collect_list(C("o_orderkey").cast("string")))  # one member's orders
    return t.orders.groupBy("o_custkey").agg(F.left(F.sha2(F.array_join(ids, "|"), 256), F.lit(16)).alias("digest"))


_FLAGS = ", ".join(f"({_sql_list(w, 'low')}) AS {n}" for n, w in X.KEYWORDS.items())
_SUM = " + ".join(f"CAST({n} AS INTEGER)" for n in [*X.KEYWORDS, "overdose"])


@query("keyword_risk", f"SELECT *, round(({_SUM}) / 8.0, 6) AS risk FROM (SELECT doc_id, {_FLAGS}, contains(low, 'overdose') OR regexp_matches(low, '(^|[^a-z0-9])od([^a-z0-9]|$)') AS overdose FROM (SELECT doc_id, lower(text) AS low FROM documents))")
def keyword_risk(t: Tables):
    flags = X.keyword_flags(C("text"))
    d = t.documents.withColumns(flags)
    return d.select("doc_id", *flags, F.round(sum((C(c).cast("int") for c in flags), F.lit(0)) / 8.0, 6).alias("risk"))


_FAMILIES = [*X.KEYWORDS, "overdose"]


@query("agg_narrative_factors", f"""SELECT lang, doc_id % 4 + 2020 AS year, count(*) AS n, round(avg(({_SUM}) / 8.0), 7) AS mean_risk, {', '.join(f'count_if({c}) AS {c}' for c in _FAMILIES)}
 FROM (SELECT doc_id, lang, {_FLAGS}, contains(low, 'overdose') OR regexp_matches(low, '(^|[^a-z0-9])od([^a-z0-9]|$)') AS overdose FROM (SELECT doc_id, lang, lower(text) AS low FROM documents)) GROUP BY 1, 2""")
def agg_narrative_factors(t: Tables):
    """Of each language and year: texts, how many hold each factor, and the mean risk."""
    flags = X.keyword_flags(C("text"))
    risk = sum((C(c).cast("int") for c in flags), F.lit(0)) / 8.0
    d = t.documents.withColumns(flags)
    return d.groupBy("lang", (C("doc_id") % 4 + 2020).alias("year")).agg(F.count("*").alias("n"), F.round(F.avg(risk), 7).alias("mean_risk"), *(F.count_if(c).alias(c) for c in flags))


@query("narrative_concat", "SELECT conv_id, turn, concat_ws(' | ', nullif(role, 'system'), text) AS narrative FROM conversations")
def narrative_concat(t: Tables):
    return t.conversations.select("conv_id", "turn", F.concat_ws(" | ", F.nullif("role", F.lit("system")), "text").alias("narrative"))


@query("prompt_guard", rf"""SELECT conv_id, turn, CAST(regexp_matches(text, '{X.SSN}') AS INTEGER) + CAST(regexp_matches(text, '{X.PHONES[0]}') AS INTEGER) + CAST(regexp_matches(text, '{X.EMAIL}') AS INTEGER) + {" + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in X.ADVERSARIAL)} + CAST(length(text) > 50000 AS INTEGER) AS violations FROM conversations WHERE role = 'user'""")
def prompt_guard(t: Tables):
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", F.size(X.prompt_violations(C("text"))).alias("violations"))


_MARKS = " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in X.UNCERTAIN)


@query("output_guard", rf"SELECT conv_id, turn, {_MARKS} AS markers, CAST(len(regexp_extract_all(text, '[0-9]+')) AS INTEGER) AS numbers, round(greatest(1.0 - 0.1 * ({_MARKS}), 0.0), 4) AS confidence, 1.0 - 0.1 * ({_MARKS}) >= 0.8 AS passed FROM conversations WHERE role = 'assistant'")
def output_guard(t: Tables):
    n, confidence = X.output_confidence(C("text"))
    return t.conversations.filter("role = 'assistant'").select("conv_id", "turn", n.alias("markers"), F.regexp_count("text", F.lit("[0-9]+")).alias("numbers"), F.round(confidence, 4).alias("confidence"), (1.0 - 0.1 * n >= 0.8).alias("passed"))


@query("med_guard", "SELECT o_custkey, count(*) - count(DISTINCT l_partkey) > 0 AS duplicate_therapy, max(CASE WHEN p_size > 45 THEN 1 ELSE 0 END) = 1 AS high_risk, max(CASE WHEN p_partkey % 97 = o_custkey % 97 THEN 1 ELSE 0 END) = 1 AS allergy FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def med_guard(t: Tables):
    j = t.orders.join(t.lineitem, C("l_orderkey") == C("o_orderkey")).join(t.part, C("p_partkey") == C("l_partkey"))
    return j.groupBy("o_custkey").agg((F.count("*") - F.countDistinct("l_partkey") > 0).alias("duplicate_therapy"), F.bool_or(C("p_size") > 45).alias("high_risk"), F.bool_or(C("p_partkey") % 97 == C("o_custkey") % 97).alias("allergy"))


@query("med_guard_allergies", """WITH a AS (SELECT c_custkey, [CASE WHEN c_custkey % 3 = 0 THEN 'COLD' ELSE 'none known' END, CASE WHEN c_custkey % 4 = 1 THEN 'bolt' END] AS allergies FROM customer),
 j AS (SELECT DISTINCT o_custkey, p_name, x FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN (SELECT c_custkey, unnest(allergies) AS x FROM a) ON c_custkey = o_custkey WHERE contains(lower(p_name), lower(x)))
 SELECT o_custkey, p_name, 'CONTRAINDICATION: allergic to ' || string_agg(x, ', ' ORDER BY x) AS message FROM j GROUP BY 1, 2""")
def med_guard_allergies(t: Tables):
    """Each customer's list of allergies against the names of what was ordered, in letters of either case; null entries match nothing."""
    listed = t.customer.select(C("c_custkey").alias("o_custkey"), F.array(F.when(C("c_custkey") % 3 == 0, "COLD").otherwise("none known"), F.when(C("c_custkey") % 4 == 1, "bolt")).alias("allergies"))
    given = t.orders.join(t.lineitem, C("l_orderkey") == C("o_orderkey")).join(t.part, C("p_partkey") == C("l_partkey")).select("o_custkey", "p_name").distinct()
    hits = F.array_sort(F.filter("allergies", lambda a: F.coalesce(F.contains(F.lower("p_name"), F.lower(a)), F.lit(False))))
    return given.join(listed, "o_custkey").withColumn("hits", hits).filter(F.size("hits") > 0).select("o_custkey", "p_name", F.concat(F.lit("CONTRAINDICATION: allergic to "), F.array_join("hits", ", ")).alias("message"))


@query("score_guard", "SELECT doc_id, concat_ws(',', CASE WHEN n_chars NOT BETWEEN 50 AND 20000 THEN 'out_of_range' END, CASE WHEN lang = 'en' AND n_chars < 100 THEN 'unjustified' END, CASE WHEN source = 'src0' AND lang <> 'en' THEN 'category_mismatch' END) AS violations FROM documents")
def score_guard(t: Tables):
    v = F.array_compact(F.array(F.when(~C("n_chars").between(50, 20000), "out_of_range"), F.when((C("lang") == "en") & (C("n_chars") < 100), "unjustified"), F.when((C("source") == "src0") & (C("lang") != "en"), "category_mismatch")))
    return t.documents.select("doc_id", F.array_join(v, ",").alias("violations"))


@query("guard_rollup", rf"SELECT conv_id, bool_and(NOT (regexp_matches(text, '{X.SSN}') OR regexp_matches(text, '{X.PHONES[0]}') OR regexp_matches(text, '{X.EMAIL}') OR {' OR '.join(f'''contains(lower(text), '{w}')''' for w in X.ADVERSARIAL)})) AS passed, count(*) AS turns FROM conversations GROUP BY 1")
def guard_rollup(t: Tables):
    bad = F.exists(X.prompt_violations(C("text")), lambda v: v["severity"].isin("ERROR", "CRITICAL"))
    return t.conversations.groupBy("conv_id").agg(F.bool_and(~bad).alias("passed"), F.count("*").alias("turns"))


@query("page_extract", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a [^>]*href=')) AS INTEGER) AS links, CAST(len(regexp_extract_all(html, '<tr')) AS INTEGER) AS table_rows FROM pages")
def page_extract(t: Tables):
    return t.pages.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit(r"<a [^>]*href=")).alias("links"), F.regexp_count("html", F.lit("<tr")).alias("table_rows"))


def _stripped(c: str) -> str:
    out = f"regexp_replace(regexp_replace({c}, '{X.UNSEEN}', '', 'g'), '<[^>]*>', '', 'g')"
    for name, char in X.ENTITIES.items():
        out = f"replace({out}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace({out}, '[ \t\n\r\f\x0B]+', ' ', 'g'))"


@query("page_text", f"SELECT page_id, length(s) AS n_chars, md5(s) AS digest FROM (SELECT page_id, {_stripped('html')} AS s FROM pages)")
def page_text(t: Tables):
    s = t.pages.select("page_id", X.strip_tags(C("html")).alias("s"))
    return s.select("page_id", F.length("s").cast("long").alias("n_chars"), F.md5("s").alias("digest"))


@query("page_links", rf"""SELECT page_id, n, regexp_extract(a, '(?i)href="([^"]*)"', 1) AS href, {_stripped('a')} AS label FROM (SELECT page_id, unnest(l) AS a, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS n FROM (SELECT page_id, regexp_extract_all(html, '(?i)(<a [^>]*href="[^"]*"[^>]*>[\s\S]*?</a>)', 1) AS l FROM pages))""")
def page_links(t: Tables):
    return t.pages.select("page_id", F.posexplode(X.links(C("html"))).alias("n", "x")).select("page_id", "n", "x.*")


@query("page_tables", r"""SELECT page_id, n, CAST(len(regexp_extract_all(x, '(?i)<tr[ >]')) AS INTEGER) AS n_rows FROM (SELECT page_id, unnest(l) AS x, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS n FROM (SELECT page_id, regexp_extract_all(html, '(?i)<table(?:\s[^>]*)?>([\s\S]*?)</table>', 1) AS l FROM pages)) WHERE regexp_matches(x, '(?i)<t[dh][ >]')""")
def page_tables(t: Tables):
    """Tables of pages with their rows; the SQL counts rows by their opening tags, which is the same for rows with cells."""
    return t.pages.select("page_id", F.posexplode(X.tables(C("html"))).alias("n", "x")).filter(F.size("x") > 0).select("page_id", "n", F.size("x").alias("n_rows"))


@query("page_tables_read", "SELECT n_regionkey AS page_id, CAST(0 AS INTEGER) AS n, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS line, concat_ws('|', n_nationkey, n_name) AS cells FROM nation UNION ALL SELECT DISTINCT n_regionkey, CAST(0 AS INTEGER), CAST(0 AS INTEGER), 'key|nation' FROM nation")
def page_tables_read(t: Tables):
    """Pages with a table of each region's nations, an empty table and a list; the tables' rows come back as cells."""
    n = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    body = F.concat_ws("\n", F.transform("ns", lambda x: F.concat(F.lit("<tr class='r'><td>"), x["n_nationkey"].cast("string"), F.lit("</td><TD> <b>"), x["n_name"], F.lit("</b></TD></tr>"))))
    html = F.concat(F.lit("<p>nations</p><table border=1><tr><th>key</th><th>nation</th></tr>"), body, F.lit("</table><table></table><ul><li>x</li></ul>"))
    pages = n.select(C("n_regionkey").alias("page_id"), F.posexplode(X.tables(html)).alias("n", "x"))
    return pages.select("page_id", "n", F.posexplode("x").alias("line", "c")).select("page_id", "n", "line", F.array_join("c", "|").alias("cells"))


@query("table_cells", r"SELECT DISTINCT trim(c) AS cell FROM (SELECT unnest(regexp_extract_all(html, '<(?:td|li|h[1-6])[^>]*>([^<]+)<', 1)) AS c FROM pages) WHERE regexp_matches(trim(c), '^[A-Z][a-z]+')")
def table_cells(t: Tables):
    cell = F.explode(F.regexp_extract_all("html", F.lit(r"<(?:td|li|h[1-6])[^>]*>([^<]+)<"), 1))
    return t.pages.select(cell.alias("c")).select(F.trim("c").alias("cell")).filter(C("cell").rlike("^[A-Z][a-z]+")).distinct()


@query("text_normalise", r"SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS digest FROM documents")
def text_normalise(t: Tables):
    return t.documents.select("doc_id", F.md5(X.squeeze(X.nfc(C("text")))).alias("digest"))


# ---------------------------------------------------------------- retrieval

_TOK = "string_split_regex(lower(text), '[^a-z]+')"
_BM25 = f"""WITH d AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2), len AS (SELECT doc_id, sum(tf) AS n FROM d GROUP BY 1),
 q AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest({_TOK}) AS w FROM benchmark) WHERE w <> ''), df AS (SELECT w, count(*) AS df FROM d GROUP BY 1), st AS (SELECT count(*) AS nd, avg(n) AS av FROM len),
 s AS (SELECT q.item_id, d.doc_id, sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / av))) AS score FROM q JOIN d ON q.w = d.w JOIN df ON df.w = d.w JOIN len ON len.doc_id = d.doc_id, st GROUP BY 1, 2)"""


@query("rank_bm25", _BM25 + " SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM s) WHERE r <= 5")
def rank_bm25(t: Tables):
    s = R.bm25(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")
    return R.top(s.withColumn("score", F.round("score", 6)), "item_id", "doc_id", 5).select("item_id", "doc_id", "score")


_COS = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))"


@query("rank_dense", f"""SELECT query, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM
 (SELECT q.vec_id AS query, e.vec_id, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE e.label IS NOT NULL AND q.vec_id % 50 = 0)) WHERE r <= 10""")
def rank_dense(t: Tables):
    """Queries are all vectors whose id is divisible by 50."""
    found = R.nearest(t.embeddings.filter("label is not null"), "vec_id", "embedding", t.embeddings.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return found.select("query", C("id").alias("vec_id"), "score")


@query("rank_hybrid", _BM25 + f""", sp AS (SELECT item_id AS query, doc_id AS id, score / max(score) OVER (PARTITION BY item_id) AS sparse FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s) WHERE r <= 20),
 de AS (SELECT query, id, dense FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dense DESC, id) AS r FROM (SELECT q.vec_id AS query, e.vec_id AS id, round({_COS}, 9) AS dense FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark))) WHERE r <= 20),
 f AS (SELECT query, id, round(0.6 * coalesce(dense, 0) + 0.4 * coalesce(sparse, 0), 5) AS score FROM sp FULL JOIN de USING (query, id))
 SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM f WHERE score >= 0.1) WHERE r <= 10""")
def rank_hybrid(t: Tables):
    """Queries are all items, each with the vector of its id."""
    sparse = R.bm25(t.documents, "doc_id", "text", t.benchmark, "item_id", "text").select(C("item_id").alias("query"), C("doc_id").alias("id"), F.round("score", 9).alias("score"), C("score").alias("raw"))
    sparse = R.top(sparse, "query", "id", 20)
    best = sparse.groupBy("query").agg(F.max("raw").alias("m"))
    sparse = sparse.join(best, "query").select("query", "id", (C("raw") / C("m")).alias("sparse"))
    asked = t.embeddings.join(t.benchmark.select(C("item_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    dense = R.nearest(t.embeddings, "vec_id", "embedding", asked, "vec_id", "embedding", 20, digits=9).withColumnRenamed("score", "dense")
    score = F.round(0.6 * F.coalesce("dense", F.lit(0.0)) + 0.4 * F.coalesce("sparse", F.lit(0.0)), 5)
    return R.top(sparse.join(dense, ["query", "id"], "full").select("query", "id", score.alias("score")).filter("score >= 0.1"), "query", "id", 10)
