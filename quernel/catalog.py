"""Registered queries, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import geo, text
from .operators import index, mutate, vocab
from .plans import engine
from .schema import FieldSpec, IndexSpec
from .session import load, shared_folder, spread
from .sources import files
from .streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# --- applications over the tables -------------------------------------------------

DOCS = IndexSpec.of(1, "doc_id", [FieldSpec("doc_id", "long"), FieldSpec("text", "text", analyzer="word"), FieldSpec("lang", "string"), FieldSpec("source", "string", indexed=False), FieldSpec("n_chars", "long")])
ORDERS = IndexSpec.of(2, "o_orderkey", [FieldSpec("o_orderkey", "long"), FieldSpec("o_custkey", "long"), FieldSpec("o_orderstatus", "string"), FieldSpec("o_totalprice", "double"), FieldSpec("o_orderpriority", "string", indexed=False)])
PARTS = IndexSpec.of(3, "p_partkey", [FieldSpec("p_partkey", "long"), FieldSpec("p_name", "text", analyzer="word"), FieldSpec("p_brand", "string"), FieldSpec("p_type", "string", analyzer="letters"), FieldSpec("p_size", "int"), FieldSpec("p_retailprice", "double"), FieldSpec("tags", "string", indexed=False)])
PLACES = IndexSpec.of(4, "c_custkey", [FieldSpec("c_custkey", "long"), FieldSpec("c_name", "string"), FieldSpec("c_mktsegment", "string"), FieldSpec("place", "geo_point")])
HOSTS = IndexSpec.of(5, "event_id", [FieldSpec("event_id", "long"), FieldSpec("ip", "ip")])


_stores: dict[tuple[str, str], index.Store] = {}


def store_of(spark, d) -> index.Store:
    """The index of `documents`, written once for an application and a folder of tables."""
    app = spark.sparkContext.applicationId
    if (app, d) not in _stores:
        path = f"{shared_folder(spark)}/quernel-{app}/index-{hashlib.sha256(d.encode()).hexdigest()[:12]}"
        _stores[app, d] = index.write_store(spread(load(spark, d, "documents")), DOCS, path)
    return _stores[app, d]


def docs(spark, d):
    return engine.Index(DOCS, load(spark, d, "documents"), store_of(spark, d))


def scanned_docs(spark, d):
    """The same documents without a written index: texts are analysed in the scan."""
    return engine.Index(DOCS, spread(load(spark, d, "documents")))


def orders(spark, d):
    return engine.Index(ORDERS, load(spark, d, "orders"))


def parts(spark, d):
    tags = F.concat_ws("|", "p_brand", F.col("p_size").cast("string"))
    return engine.Index(PARTS, load(spark, d, "part").withColumn("tags", tags))


def places(spark, d):
    lat = F.col("c_custkey") * 7919 % 18000 / F.lit(100.0) - 90
    lng = F.col("c_custkey") * 104729 % 36000 / F.lit(100.0) - 180
    return engine.Index(PLACES, load(spark, d, "customer").withColumn("place", F.struct(lat.alias("lat"), lng.alias("lng"))))


PLACES_CTE = "g AS (SELECT *, (c_custkey * 7919 % 18000)::DOUBLE / 100.0::DOUBLE - 90 AS lat, (c_custkey * 104729 % 36000)::DOUBLE / 100.0::DOUBLE - 180 AS lng FROM customer)"
TOKENS_CTE = r"tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)"
TF_CTE = TOKENS_CTE + ", tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"
SCORE = "ln(greatest(10000 - df + 0.5::DOUBLE, 0.5) / (df + 0.5::DOUBLE)) * (2.2::DOUBLE * tf / (1.65::DOUBLE + tf))"


def found(result: engine.Result, digits: int | None = 6) -> DataFrame:
    rows = result.rows
    return rows if digits is None else rows.withColumn("score", F.round("score", digits))


def dsl(name: str, app, request: dict, sql: str, digits: int | None = 6) -> None:
    """A query that is one request of the JSON language."""
    add(name, sql)(lambda spark, d: found(engine.search(app(spark, d), request), digits))


def matches(name: str, app, query: dict, where: str, table: str, key: str, extra: str = "") -> None:
    """A query that returns all ids that a clause matches."""
    request = {"query": query, "sort_type": 3, "return_all": True}
    add(name, f"{extra}SELECT CAST({key} AS VARCHAR) AS doc_id, 1.0::DOUBLE AS score FROM {table} WHERE {where}")(lambda spark, d: engine.search(app(spark, d), request).rows)


def has(word: str) -> str:
    return rf"list_contains(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), '{word}')"


# --- text ---------------------------------------------------------------------------

TOP = f"WITH {TF_CTE} SELECT CAST(doc_id AS VARCHAR) AS doc_id, round(sum({SCORE}), 6) AS score FROM tf JOIN df USING (term) WHERE term IN (%s) GROUP BY doc_id ORDER BY sum({SCORE}) DESC, CAST(doc_id AS VARCHAR) DESC LIMIT 10"
dsl("match_single", docs, {"query": {"match": {"text": "with"}}}, TOP % "'with'")
dsl("match_or_tokens", docs, {"query": {"match": {"text": "With, that und les"}}}, TOP % "'with', 'that', 'und', 'les'")
dsl("match_scan", scanned_docs, {"query": {"match": {"text": "With, that und les"}}}, TOP % "'with', 'that', 'und', 'les'")
dsl("match_real_count", lambda spark, d: docs(spark, d).counted(), {"query": {"match": {"text": "with license"}}}, (TOP % "'with', 'license'").replace("10000", "(SELECT count(*) FROM documents)"))
dsl("match_no_score", docs, {"query": {"match": {"text": "license"}}, "sort_type": 3, "return_all": True}, f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, 1.0::DOUBLE AS score FROM documents WHERE {has('license')}")
dsl("project_fields", docs, {"query": {"match": {"text": "license"}}, "fields": "lang, source, missing", "page_size": 20}, f"WITH {TF_CTE} SELECT CAST(doc_id AS VARCHAR) AS doc_id, round({SCORE}, 6) AS score, lang, source FROM tf JOIN df USING (term) JOIN documents USING (doc_id) WHERE term = 'license' ORDER BY {SCORE} DESC, CAST(doc_id AS VARCHAR) DESC LIMIT 20")
dsl("bool_text_and_range", docs, {"query": {"bool": {"must": [{"match": {"text": "the"}}, {"range": {"n_chars": {"gte": 500, "lt": 1500}}}], "must_not": {"match": {"text": "license"}}}}, "page_size": 50}, f"WITH {TF_CTE} SELECT CAST(doc_id AS VARCHAR) AS doc_id, round({SCORE}, 6) AS score FROM tf JOIN df USING (term) JOIN documents USING (doc_id) WHERE term = 'the' AND n_chars >= 500 AND n_chars < 1500 AND NOT {has('license')} ORDER BY {SCORE} DESC, CAST(doc_id AS VARCHAR) DESC LIMIT 50")
matches("bool_scan", scanned_docs, {"bool": {"should": [{"match": {"text": "license"}}, {"match": {"text": "with"}}], "must": [{"match": {"text": "the"}}], "must_not": [{"term": {"lang": "de"}}]}}, f"({has('license')} OR {has('with')}) AND {has('the')} AND lang <> 'de'", "documents", "doc_id")
matches("bool_must", docs, {"bool": {"must": [{"match": {"text": "the"}}, {"match": {"text": "was"}}, {"term": {"lang": "en"}}]}}, f"{has('the')} AND {has('was')} AND lang = 'en'", "documents", "doc_id")
matches("bool_should", docs, {"bool": {"should": [{"match": {"text": "license"}}, {"match": {"text": "und"}}]}}, f"{has('license')} OR {has('und')}", "documents", "doc_id")
matches("bool_must_not", docs, {"bool": {"must_not": [{"match": {"text": "the"}}, {"match": {"text": "de"}}]}}, f"NOT {has('the')} AND NOT {has('de')}", "documents", "doc_id")
matches("bool_mixed", docs, {"bool": {"should": [{"match": {"text": "license"}}, {"match": {"text": "with"}}], "must": [{"match": {"text": "the"}}], "must_not": [{"term": {"lang": "de"}}]}}, f"({has('license')} OR {has('with')}) AND {has('the')} AND lang <> 'de'", "documents", "doc_id")
matches("match_letters_prefix", parts, {"match": {"p_type": "Pro-mo"}}, "regexp_replace(lower(p_type), '[^a-z]', '', 'g') LIKE 'promo%'", "part", "p_partkey")


@add("hit_count", f"SELECT count(*) AS n FROM documents WHERE {has('the')}")
def hit_count(spark, d):
    return engine.search(docs(spark, d), {"query": {"match": {"text": "the"}}}).matched.agg(F.count("*").alias("n"))


@add("highlight_words", f"WITH {TOKENS_CTE} SELECT DISTINCT term AS word FROM tok WHERE term IN ('with', 'that', 'und', 'les', 'license') ORDER BY term LIMIT 10")
def highlight_words(spark, d):
    return engine.search(docs(spark, d), {"query": {"match": {"text": "with that und les license nosuchword"}}}).highlight


@add("postings_build", f"WITH {TOKENS_CTE} SELECT CAST(doc_id AS VARCHAR) AS doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term")
def postings_build(spark, d):
    return index.postings(spread(load(spark, d, "documents")), "doc_id", "text").select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


@add("postings_positions", r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM t) SELECT CAST(doc_id AS VARCHAR) AS doc_id, term, CAST(list_sort(list(pos))[1] AS INT) AS first_at, CAST(list_sort(list(pos))[1:26][-1] AS INT) AS last_at FROM p GROUP BY doc_id, term")
def postings_positions(spark, d):
    made = index.postings(spread(load(spark, d, "documents")), "doc_id", "text", positions=26)
    return made.select("doc_id", "term", F.col("positions")[0].alias("first_at"), F.element_at("positions", -1).alias("last_at"))


@add("term_stats", f"WITH {TF_CTE} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM tf GROUP BY term")
def term_stats(spark, d):
    return index.term_stats(index.postings(spread(load(spark, d, "documents")), "doc_id", "text")).drop("field")


@add("stored_stats", f"WITH {TF_CTE} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM tf WHERE term IN ('with', 'license', 'nosuchword') GROUP BY term")
def stored_stats(spark, d):
    store = store_of(spark, d)
    return store.lookup(store.stats, [("text", t) for t in ("with", "license", "nosuchword")]).select("term", "df", "total_tf")


PLACED = r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), q AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM t) "


@add("phrase_adjacent", PLACED + "SELECT DISTINCT CAST(a.doc_id AS VARCHAR) AS doc_id FROM q a JOIN q b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 2 WHERE a.term = 'of' AND b.term = 'the'")
def phrase_adjacent(spark, d):
    store = store_of(spark, d)
    return index.phrase(store.lookup(store.postings, [("text", "of"), ("text", "the")]), "of", "the")


BEST = f"WITH {TF_CTE}, q AS (%s), s AS (SELECT query_id, doc_id, round(sum({SCORE}), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) GROUP BY 1, 2) SELECT query_id, CAST(doc_id AS VARCHAR) AS doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR) DESC) AS rank FROM s) WHERE rank <= 10"


@add("batch_queries", BEST % "SELECT * FROM (VALUES (1, 'with'), (1, 'that'), (2, 'und'), (3, 'license'), (3, 'les')) AS q(query_id, term)")
def batch_queries(spark, d):
    asked = [(1, "with"), (1, "that"), (2, "und"), (3, "license"), (3, "les")]
    queries = spark.createDataFrame(asked, "query_id int, term string")
    return engine.batch_lookup(store_of(spark, d), queries, "text").select("query_id", "doc_id", "score", "rank")


@add("batch_scan", BEST % "SELECT * FROM (VALUES (1, 'with'), (1, 'that'), (2, 'und'), (3, 'license'), (3, 'les')) AS q(query_id, term)")
def batch_scan(spark, d):
    asked = [(1, "with"), (1, "that"), (2, "und"), (3, "license"), (3, "les")]
    queries = spark.createDataFrame(asked, "query_id int, term string")
    made = index.postings(spread(load(spark, d, "documents")), "doc_id", "text", only=sorted({t for _, t in asked}))
    return engine.batch_search(made, queries).select("query_id", "doc_id", "score", "rank")


#: A thousand queries of two words each, from the words of the middle frequencies.
THOUSAND = "SELECT CAST(i % 1000 AS INT) AS query_id, term FROM (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS i FROM df WHERE df < 200) WHERE i < 2000"


@add("batch_thousand", BEST % THOUSAND)
def batch_thousand(spark, d):
    store = store_of(spark, d)
    some = store.stats.where("field = 'text' and df < 200").orderBy(F.desc("df"), "term").limit(2000)
    numbered = some.select("term", (F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).alias("i"))
    return engine.batch_lookup(store, numbered.select((F.col("i") % 1000).cast("int").alias("query_id"), "term"), "text").select("query_id", "doc_id", "score", "rank")


@add("ngrams_all", "WITH s AS (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part), t AS (SELECT *, unnest(range(1, least(3, length(p_name) - i + 1) + 1)) AS n FROM s) SELECT substr(p_name, i::INT, n::INT) AS gram, count(*) AS n FROM t GROUP BY 1")
def ngrams_all(spark, d):
    return load(spark, d, "part").select(F.explode(text.ngram_terms(F.col("p_name"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@add("data_types", "SELECT CASE WHEN regexp_matches(s, '[A-Za-z]') THEN 'english' WHEN regexp_matches(s, '^\\s*[0-9]+\\s*$') THEN 'number' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT p_name AS s FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part) GROUP BY 1")
def data_types(spark, d):
    p = load(spark, d, "part")
    return p.select(F.col("p_name").alias("s")).union(p.select(F.col("p_size").cast("string"))).select(text.data_type(F.col("s")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# --- terms, ranges, post-filters -------------------------------------------------------

matches("term_keyword", orders, {"term": {"o_orderstatus": "F"}}, "o_orderstatus = 'F'", "orders", "o_orderkey")
matches("term_numeric", orders, {"term": {"o_custkey": 37}}, "o_custkey = 37", "orders", "o_orderkey")
matches("term_text", docs, {"term": {"text": "license"}}, has("license"), "documents", "doc_id")
matches("post_filter_or", orders, {"bool": {"should": [{"term": {"o_orderpriority": "1-URGENT"}}, {"term": {"o_orderpriority": "5-LOW"}}]}}, "o_orderpriority IN ('1-URGENT', '5-LOW')", "orders", "o_orderkey")
matches("post_filter_and", orders, {"bool": {"must": [{"term": {"o_orderpriority": "1-URGENT|2-HIGH"}}, {"term": {"o_orderstatus": "O"}}]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O'", "orders", "o_orderkey")
matches("post_filter_not", orders, {"bool": {"must": [{"range": {"o_totalprice": {"lt": 50000}}}], "must_not": [{"term": {"o_orderpriority": "1-URGENT"}}]}}, "o_totalprice < 50000 AND o_orderpriority <> '1-URGENT'", "orders", "o_orderkey")
matches("post_filter_pipe_set", parts, {"term": {"tags": "Brand#11|7"}}, "list_has_any(string_split(p_brand || '|' || p_size, '|'), ['Brand#11', '7'])", "part", "p_partkey")
matches("union_index_equivalence", orders, {"bool": {"must": [{"term": {"o_orderstatus": "P"}}, {"range": {"o_custkey": {"gte": 1, "lte": 500}}}]}}, "o_orderstatus = 'P' AND o_custkey BETWEEN 1 AND 500", "orders", "o_orderkey")
for _name, _body, _where in (
    ("gele", {"gte": 1000, "lte": 2000}, ">= 1000 AND o_totalprice <= 2000"), ("gelt", {"gte": 1000, "lt": 20000}, ">= 1000 AND o_totalprice < 20000"),
    ("gtle", {"gt": 5000.5, "lte": 20000}, "> 5000.5 AND o_totalprice <= 20000"), ("gtlt", {"gt": 5000, "lt": 9000}, "> 5000 AND o_totalprice < 9000"),
    ("lt", {"lt": 3000}, "< 3000"), ("gt", {"gt": 480000}, "> 480000"), ("le", {"lte": 3000}, "<= 3000"), ("ge", {"gte": 480000}, ">= 480000"),
):
    matches(f"range_{_name}", orders, {"range": {"o_totalprice": _body}}, f"o_totalprice {_where}", "orders", "o_orderkey")


@add("term_in_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (1, 5, 37, 99)")
def term_in_list(spark, d):
    return load(spark, d, "orders").where(F.col("o_custkey").isin(1, 5, 37, 99)).select("o_orderkey", "o_orderstatus")


@add("ip_to_long", "SELECT event_id, (event_id % 223 + 1) * 16777216 + (event_id * 7 % 256) * 65536 + (event_id * 13 % 256) * 256 + event_id % 256 AS ip FROM events")
def ip_to_long(spark, d):
    e = F.col("event_id")
    quad = F.concat_ws(".", (e % 223 + 1).cast("string"), (e * 7 % 256).cast("string"), (e * 13 % 256).cast("string"), (e % 256).cast("string"))
    return load(spark, d, "events").select("event_id", text.ip_to_long(quad).alias("ip"))


@add("ip_match", "SELECT CAST(event_id AS VARCHAR) AS doc_id, 1.0::DOUBLE AS score FROM events WHERE event_id % 50 = 7")
def ip_match(spark, d):
    rows = load(spark, d, "events").select("event_id", F.concat(F.lit("10.0.0."), (F.col("event_id") % 50).cast("string")).alias("ip"))
    return engine.search(engine.Index(HOSTS, rows), {"query": {"match": {"ip": "10.0.0.7"}}, "sort_type": 3, "return_all": True}).rows


@add("json_field_get", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_get(spark, d):
    return load(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# --- order, paging -----------------------------------------------------------------------

PICK = "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_totalprice AS score FROM orders WHERE o_orderstatus = 'F'"
BASE = {"query": {"term": {"o_orderstatus": "F"}}}
dsl("sort_field_asc", orders, BASE | {"sort_type": 4, "sort_field": "o_totalprice"}, PICK + " ORDER BY 2, 1 LIMIT 10", None)
dsl("sort_field_desc", orders, BASE | {"sort": [{"o_totalprice": {"order": "desc"}}], "fields": "o_custkey"}, PICK.replace("AS score", "AS score, o_custkey") + " ORDER BY 2 DESC, 1 DESC LIMIT 10", None)
dsl("sort_none", orders, BASE | {"sort_type": 3}, PICK.replace("o_totalprice AS score", "1.0::DOUBLE AS score") + " ORDER BY 1 DESC LIMIT 10", None)
dsl("sort_string", parts, {"query": {"range": {"p_size": {"lte": 10}}}, "sort_type": 4, "sort_field": "p_brand", "page_size": 25}, "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_brand AS score FROM part WHERE p_size <= 10 ORDER BY 2, 1 LIMIT 25", None)
dsl("page_offset", orders, BASE | {"sort_type": 5, "sort_field": "o_totalprice", "page_index": 3, "page_size": 7}, PICK + " ORDER BY 2 DESC, 1 DESC LIMIT 7 OFFSET 14", None)
dsl("page_after_asc", orders, BASE | {"sort_type": 4, "sort_field": "o_custkey", "last_score": 40, "last_id": "5"}, PICK.replace("o_totalprice", "o_custkey") + " AND (o_custkey, CAST(o_orderkey AS VARCHAR)) > (40, '5') ORDER BY 2, 1 LIMIT 10", None)
dsl("page_after_desc", orders, BASE | {"sort_type": 5, "sort_field": "o_custkey", "last_score": 40, "last_id": "5"}, PICK.replace("o_totalprice", "o_custkey") + " AND (o_custkey, CAST(o_orderkey AS VARCHAR)) < (40, '5') ORDER BY 2 DESC, 1 DESC LIMIT 10", None)
dsl("terminal_range", orders, {"query": {"bool": {"must": [{"range": {"o_totalprice": {"gte": 1000, "lte": 200000}}}, {"term": {"o_orderpriority": "3-MEDIUM"}}]}}, "sort_type": 5, "sort_field": "o_totalprice"}, "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_totalprice AS score FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority = '3-MEDIUM' ORDER BY 2 DESC, 1 DESC LIMIT 10", None)
dsl("return_all", orders, {"query": {"range": {"o_totalprice": {"gt": 490000}}}, "return_all": True, "sort_type": 4, "sort_field": "o_totalprice"}, "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_totalprice AS score FROM orders WHERE o_totalprice > 490000", None)


@add("shard_merge", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20 OFFSET 20")
def shard_merge(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", "o_totalprice").repartition(8, "o_orderkey")
    return rows.dropDuplicates(["o_orderkey"]).orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).offset(20).limit(20)


@add("shard_search", TOP.replace("LIMIT 10", "LIMIT 7 OFFSET 7") % "'with', 'license'")
def shard_search(spark, d):
    """The index of the documents as it is, and three shards of it by key, merge to the same page; frequencies are those of the whole."""
    whole = docs(spark, d)
    shards = []
    for k in range(3):
        mine = engine.shard_of(F.col("doc_id"), 3) == k
        store = index.Store(whole.store.postings.where(mine), whole.store.stats, whole.store.n_docs, whole.store.buckets)
        shards.append(engine.Index(DOCS, whole.docs.where(mine), store))
    return found(engine.search_shards([*shards, shards[0]], {"query": {"match": {"text": "with license"}}, "page_index": 2, "page_size": 7}))


@add("shard_sorted", PICK + " ORDER BY 2 DESC, 1 DESC LIMIT 7 OFFSET 14")
def shard_sorted(spark, d):
    at = orders(spark, d)
    shards = [engine.Index(ORDERS, at.docs.where(engine.shard_of(F.col("o_orderkey"), 4) == k)) for k in range(4)]
    return engine.search_shards(shards, BASE | {"sort_type": 5, "sort_field": "o_totalprice", "page_index": 3, "page_size": 7}).rows


# --- places --------------------------------------------------------------------------------

KM = "round(sqrt(pow((lng - 20.0) * (3.1415 / 180.0)::DOUBLE * 6378.137 * cos((lat + 40.0) / 2.0 * (3.1415 / 180.0)::DOUBLE), 2) + pow((lat - 40.0) * (3.1415 / 180.0)::DOUBLE * 6378.137, 2)), 3)".replace("3.1415 / 180.0", "3.1415::DOUBLE / 180.0::DOUBLE")
NEAR = f"WITH {PLACES_CTE} SELECT CAST(c_custkey AS VARCHAR) AS doc_id, {KM} AS score FROM g"
dsl("geo_distance_default", places, {"query": {"geo_distance": {"place": "40.0,20.0", "distance": "1500"}}, "return_all": True}, f"{NEAR} WHERE {KM} + 1e-6 <= 1500", 3)
dsl("geo_distance_limit", places, {"query": {"geo_distance": {"place": [40.0, 20.0], "distance": "2000"}}, "page_size": 15}, f"{NEAR} WHERE {KM} + 1e-6 <= 2000 ORDER BY 2, 1 LIMIT 15", 3)
dsl("geo_distance_unlimited", places, {"query": {"geo_distance": {"place": {"latitude": 40.0, "longitude": 20.0}, "distance": "0"}}, "sort_type": 6}, f"{NEAR} ORDER BY 2, 1 LIMIT 10", 3)
dsl("geo_and_term", places, {"query": {"bool": {"must": [{"geo_distance": {"place": "40,20", "distance": "5000"}}, {"term": {"c_mktsegment": "BUILDING"}}]}}, "return_all": True}, f"{NEAR} WHERE {KM} + 1e-6 <= 5000 AND c_mktsegment = 'BUILDING'", 3)
SHAPE = "POLYGON((-10 -20, 50 -25, 60 40, 20 10, -15 45, -10 -20))"
CELLS = "least(floor((lat + 90) / 180 * 32768), 32767)::INT", "least(floor((lng + 180) / 360 * 32768), 32767)::INT"
BOX = "least(floor((-25.0 + 90) / 180 * 32768), 32767) AND least(floor((45.0 + 90) / 180 * 32768), 32767)", "least(floor((-15.0 + 180) / 360 * 32768), 32767) AND least(floor((60.0 + 180) / 360 * 32768), 32767)"
matches("geo_polygon_cells", places, {"geo_polygon": {"place": {"points": SHAPE}}}, f"{CELLS[0]} BETWEEN {BOX[0]} AND {CELLS[1]} BETWEEN {BOX[1]}", "g", "c_custkey", f"WITH {PLACES_CTE} ")
EDGES = "e(x1, y1, x2, y2) AS (VALUES (-10.0::DOUBLE, -20.0::DOUBLE, 50.0::DOUBLE, -25.0::DOUBLE), (50, -25, 60, 40), (60, 40, 20, 10), (20, 10, -15, 45), (-15, 45, -10, -20))"
INSIDE = "(SELECT count(*) FROM e WHERE (y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1"
matches("geo_point_in_polygon", places, {"geo_polygon": {"place": {"points": SHAPE, "exact": True}}}, INSIDE, "g", "c_custkey", f"WITH {PLACES_CTE}, {EDGES} ")


@add("geo_to_polygon", f"WITH {PLACES_CTE}, {EDGES}, t AS (SELECT c_custkey, lat, lng, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0.0, least(1.0, ((lng - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS k FROM g, e) SELECT c_custkey, round(min(sqrt(pow(lng - x1 - k * dx, 2) + pow(lat - y1 - k * dy, 2))), 6) AS degrees FROM t GROUP BY c_custkey")
def geo_to_polygon(spark, d):
    at = F.col("place.lat"), F.col("place.lng")
    return places(spark, d).docs.select("c_custkey", F.round(geo.to_polygon(*at, geo.parse_polygon(SHAPE)), 6).alias("degrees"))


@add("geo_destination", f"WITH {PLACES_CTE}, r AS (SELECT c_custkey, radians(lat) AS p, radians(lng) AS q, radians((c_custkey % 360)::DOUBLE) AS b, 250000.0::DOUBLE / 6378137.0::DOUBLE AS d FROM g), s AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(b)) AS t FROM r) SELECT c_custkey, round(degrees(t), 6) AS lat, round(degrees(q + atan2(sin(b) * sin(d) * cos(p), cos(d) - sin(p) * sin(t))), 6) AS lng FROM s")
def geo_destination(spark, d):
    to = geo.destination(F.col("place.lat"), F.col("place.lng"), (F.col("c_custkey") % 360).cast("double"), F.lit(250000.0))
    return places(spark, d).docs.select("c_custkey", to.alias("to")).select("c_custkey", F.round("to.lat", 6).alias("lat"), F.round("to.lng", 6).alias("lng"))


#: A square around each supplier's place, of a size of its own, as WKT.
SQUARES = "k AS (SELECT s_suppkey, (s_suppkey * 3571 % 16000)::DOUBLE / 100 - 80 AS y, (s_suppkey * 7129 % 34000)::DOUBLE / 100 - 170 AS x, (s_suppkey % 7 + 1)::DOUBLE AS h FROM supplier)"


@add("geo_places_in_shapes", f"WITH {PLACES_CTE}, {SQUARES} SELECT c_custkey, s_suppkey FROM g JOIN k ON lat >= y - h AND lat < y + h AND lng >= x - h AND lng < x + h")
def geo_places_in_shapes(spark, d):
    n = F.col("s_suppkey")
    y, x, h = n * 3571 % 16000 / F.lit(100.0) - 80, n * 7129 % 34000 / F.lit(100.0) - 170, (n % 7 + 1).cast("double")
    corners = F.concat_ws(", ", *[F.concat_ws(" ", (x + i * h).cast("string"), (y + j * h).cast("string")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    shapes = spread(load(spark, d, "supplier")).select("s_suppkey", geo.shape_column(F.concat(F.lit("POLYGON(("), corners, F.lit("))"))).alias("shape"))
    at = places(spark, d).docs.select("c_custkey", F.col("place.lat").alias("lat"), F.col("place.lng").alias("lng"))
    return geo.places_in_shapes(at, shapes, "lat", "lng", "shape").select("c_custkey", "s_suppkey")


@add("geo_sort", f"WITH {PLACES_CTE} SELECT c_custkey, {KM} AS km FROM g ORDER BY 2, 1 LIMIT 25")
def geo_sort(spark, d):
    p = places(spark, d).docs
    return p.select("c_custkey", geo.planar_km(F.col("place.lat"), F.col("place.lng"), 40.0, 20.0).alias("km")).orderBy("km", "c_custkey").limit(25)


@add("geo_cell", f"WITH {PLACES_CTE} SELECT c_custkey, {CELLS[0]} AS lat_cell, {CELLS[1]} AS lng_cell FROM g")
def geo_cell(spark, d):
    lat, lng = F.col("place.lat"), F.col("place.lng")
    return places(spark, d).docs.select("c_custkey", geo.cell_lat(lat).alias("lat_cell"), geo.cell_lng(lng).alias("lng_cell"))


@add("geo_hash", f"WITH {PLACES_CTE}, c AS (SELECT c_custkey, {CELLS[0]} AS a, {CELLS[1]} AS b FROM g) SELECT c_custkey, array_to_string(list_transform(range(6), lambda k: substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + list_sum(list_transform(range(5), lambda j: ((CASE WHEN (5 * k + j) % 2 = 0 THEN b ELSE a END >> (14 - (5 * k + j) // 2)::INT) & 1) << (4 - j)::INT))::INT, 1)), '') AS hash FROM c")
def geo_hash(spark, d):
    return places(spark, d).docs.select("c_custkey", geo.geohash(F.col("place.lat"), F.col("place.lng")).alias("hash"))


@add("geo_neighbours", f"WITH {PLACES_CTE}, c AS (SELECT c_custkey, {CELLS[0]} AS a, {CELLS[1]} AS b FROM g) SELECT c_custkey, (a + i)::INT AS lat_cell, ((b + j + 32768) % 32768)::INT AS lng_cell FROM c, range(-1, 2) AS x(i), range(-1, 2) AS y(j) WHERE a + i BETWEEN 0 AND 32767")
def geo_neighbours(spark, d):
    lat, lng = F.col("place.lat"), F.col("place.lng")
    return places(spark, d).docs.select("c_custkey", F.explode(geo.neighbours(geo.cell_lat(lat), geo.cell_lng(lng))).alias("n")).select("c_custkey", "n.*")


@add("geo_haversine", f"WITH {PLACES_CTE} SELECT c_custkey, round(2 * 6378137.0::DOUBLE * asin(sqrt(pow(sin(radians(lat - 40.0) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * pow(sin(radians(lng - 20.0) / 2), 2))), 2) AS metres FROM g")
def geo_haversine(spark, d):
    return places(spark, d).docs.select("c_custkey", F.round(geo.haversine_m(F.col("place.lat"), F.col("place.lng"), 40.0, 20.0), 2).alias("metres"))


# --- versions, key-value reads and writes ------------------------------------------------------

@add("dedupe_latest_version", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def dedupe_latest_version(spark, d):
    return mutate.latest(load(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@add("upsert_delete_replay", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def upsert_delete_replay(spark, d):
    return mutate.replay(load(spark, d, "events"), "user_id", "event_type", "ts", "event_id", deletes=("error",)).select("user_id", "event_id", "value")


@add("visible_versions", "SELECT user_id AS doc_id, event_id FROM events QUALIFY ts = max(ts) OVER (PARTITION BY user_id)")
def visible_versions(spark, d):
    rows = load(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("version"), "event_id")
    return mutate.visible(rows, rows.groupBy("doc_id").agg(F.max("version").alias("version"))).select("doc_id", "event_id")


@add("compact_deletes", "SELECT event_id FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_type = 'error')")
def compact_deletes(spark, d):
    rows = load(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("version"), "event_id")
    return mutate.compact(rows, rows.where("version = 'error'")).select("event_id")


@add("clip_newest_per_term", "SELECT event_id, event_type FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE n <= 10 OR r <= 8")
def clip_newest_per_term(spark, d):
    return index.clip_newest(load(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 10).select("event_id", "event_type")


@add("pinned_valid", "SELECT event_id AS doc_id, CAST(value AS INT) AS weight FROM events WHERE event_type = 'click' AND ts <= TIMESTAMP '2024-01-10' AND ts + INTERVAL 24 HOUR >= TIMESTAMP '2024-01-10'")
def pinned_valid(spark, d):
    pins = load(spark, d, "events").select(F.col("event_type").alias("word"), F.col("event_id").alias("doc_id"), F.rint("value").cast("int").alias("weight"), F.col("ts").alias("start_time"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("end_time"))
    return mutate.valid_pins(pins, "click", F.lit("2024-01-10").cast("timestamp")).select("doc_id", "weight")


@add("kv_point_get", "SELECT p_name, p_size FROM part WHERE p_partkey = 42")
def kv_point_get(spark, d):
    return mutate.get(load(spark, d, "part"), "p_partkey", [42], ["p_name", "p_size"])


@add("kv_multi_get", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (1, 7, 42, 99, 1000000) AND p_size > 3")
def kv_multi_get(spark, d):
    return mutate.get(load(spark, d, "part"), "p_partkey", [1, 7, 42, 99, 1000000], ["p_partkey", "p_name"], F.col("p_size") > 3)


@add("kv_same_text", "SELECT p_partkey FROM part WHERE lower(p_brand) = lower('BRAND#11')")
def kv_same_text(spark, d):
    return load(spark, d, "part").where(mutate.same_text(F.col("p_brand"), "BRAND#11")).select("p_partkey")


@add("kv_range_order_limit", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_partkey BETWEEN 100 AND 900 AND p_size >= 10 ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 20 OFFSET 10")
def kv_range_order_limit(spark, d):
    where = F.col("p_partkey").between(100, 900) & (F.col("p_size") >= 10)
    return mutate.scan(load(spark, d, "part"), where, [F.desc("p_size"), F.asc("p_retailprice"), F.asc("p_partkey")], ["p_partkey", "p_size", "p_retailprice"], 10, 20)


@add("kv_count", "SELECT count(*) AS n FROM part WHERE p_partkey BETWEEN 100 AND 900 AND p_size >= 10")
def kv_count(spark, d):
    return load(spark, d, "part").where(F.col("p_partkey").between(100, 900) & (F.col("p_size") >= 10)).agg(F.count("*").alias("n"))


@add("kv_update_add", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN p_size + 5 ELSE p_size END AS p_size FROM part")
def kv_update_add(spark, d):
    return mutate.update(load(spark, d, "part"), F.col("p_brand") == "Brand#11", {"p_size": ("add", 5)}).select("p_partkey", "p_size")


@add("kv_bit_or", "SELECT p_partkey, CASE WHEN p_size < 20 THEN (p_size | 64) ELSE p_size END AS p_size FROM part")
def kv_bit_or(spark, d):
    return mutate.update(load(spark, d, "part"), F.col("p_size") < 20, {"p_size": ("or", 64)}).select("p_partkey", "p_size")


@add("kv_set_bits", "SELECT p_partkey, CASE WHEN p_size < 20 THEN ((p_size | 8) & ~1) ELSE p_size END AS p_size FROM part")
def kv_set_bits(spark, d):
    rows = mutate.update(load(spark, d, "part"), F.col("p_size") < 20, {"p_size": ("set_bit", 3)}).withColumn("old", F.col("p_size"))
    return mutate.update(rows, F.col("old") < 32, {"p_size": ("clear_bit", 0)}).join(load(spark, d, "part").select("p_partkey", F.col("p_size").alias("was")), "p_partkey").select("p_partkey", F.when(F.col("was") < 20, F.col("p_size")).otherwise(F.col("was")).alias("p_size"))


@add("kv_insert", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT 1000001, 'new'")
def kv_insert(spark, d):
    table = load(spark, d, "supplier").select("s_suppkey", "s_name")
    new = spark.createDataFrame([(1, "taken"), (1000001, "new")], table.schema)
    return mutate.insert(table, new, ["s_suppkey"])[0]


@add("kv_delete_where", "SELECT s_suppkey, s_acctbal FROM supplier WHERE NOT s_acctbal < 0")
def kv_delete_where(spark, d):
    return mutate.delete(load(spark, d, "supplier"), F.col("s_acctbal") < 0).select("s_suppkey", "s_acctbal")


@add("kv_replace", "SELECT s_suppkey, CASE WHEN s_suppkey <= 20 THEN 'renamed' ELSE s_name END AS s_name FROM supplier")
def kv_replace(spark, d):
    table = load(spark, d, "supplier").select("s_suppkey", "s_name")
    return mutate.replace(table, table.where("s_suppkey <= 20").withColumn("s_name", F.lit("renamed")), ["s_suppkey"])


@add("kv_expire", "SELECT event_id FROM events WHERE ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-20'")
def kv_expire(spark, d):
    rows = load(spark, d, "events").withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 10 DAYS"))
    return mutate.expire(rows, F.lit("2024-01-20").cast("timestamp")).select("event_id")


# --- words ---------------------------------------------------------------------------------------

VOCAB = "v AS (SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY 1)"


def words_of(spark, d):
    return vocab.vocabulary(spread(load(spark, d, "documents")), F.col("text"))


@add("suggest_prefix", f"WITH {VOCAB} SELECT word, freq FROM v WHERE starts_with(word, 'th') ORDER BY freq DESC, word LIMIT 5")
def suggest_prefix(spark, d):
    return vocab.suggest_prefix(words_of(spark, d), "th")


@add("correct_edit1", f"WITH {VOCAB} SELECT word, freq FROM v WHERE damerau_levenshtein(word, 'hte') <= 1 ORDER BY word = 'hte' DESC, freq DESC, word LIMIT 1")
def correct_edit1(spark, d):
    return vocab.correct(words_of(spark, d), "hte")


@add("hot_words", "SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type AS word, 1 AS n FROM events UNION ALL SELECT 'click', 500) GROUP BY word ORDER BY n DESC, word LIMIT 3")
def hot_words(spark, d):
    rows = load(spark, d, "events").select(F.lit(1).alias("app"), F.col("event_type").alias("word"), F.lit(1).cast("long").alias("n"))
    return vocab.hot_words(rows.union(spark.createDataFrame([(1, "click", 500)], "app int, word string, n long")))


@add("related_words", "WITH g AS (SELECT p_brand AS group_id, unnest(string_split(p_name, ' ')) AS word FROM part) SELECT DISTINCT word FROM g WHERE group_id IN (SELECT group_id FROM g WHERE word = (SELECT min(word) FROM g)) AND word <> (SELECT min(word) FROM g) ORDER BY word LIMIT 3")
def related_words(spark, d):
    groups = load(spark, d, "part").select(F.col("p_brand").alias("group_id"), F.explode(F.split("p_name", " ")).alias("word"))
    return vocab.group_words(groups, groups.agg(F.min("word")).first()[0], 3)


@add("synonym_expand", TOP % "'license', 'with'")
def synonym_expand(spark, d):
    at = docs(spark, d)
    at.synonyms = {"license": ("with",)}
    return found(engine.search(at, {"query": {"match": {"text": "license"}}, "synonyms": True}))


@add("sensitive_guard", TOP % "'license'")
def sensitive_guard(spark, d):
    at = docs(spark, d)
    at.sensitive = frozenset({"with"})
    return found(engine.search(at, {"query": {"match": {"text": "license with"}}}))


# --- events as a stream's batch twins ----------------------------------------------------------------

@add("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return jobs.tumbling(load(spark, d, "events"), "1 hour", "event_type").select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@add("events_sliding", "SELECT b - INTERVAL (15 * k) MINUTE AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS b, event_type FROM events) AS e, range(4) AS r(k) GROUP BY 1, 2")
def events_sliding(spark, d):
    return jobs.sliding(load(spark, d, "events"), "1 hour", "15 minutes", "event_type").select(F.col("window.start").alias("start"), "event_type", "n")


@add("events_session", "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s")
def events_session(spark, d):
    return jobs.sessions(load(spark, d, "events"), "30 minutes", "user_id").select("user_id", F.col("session_window.start").alias("start"), "n")


KEPT = IndexSpec.of(7, "user_id", [FieldSpec("user_id", "long"), FieldSpec("event_type", "string")])


def kept_events(spark, d) -> jobs.Maintained:
    """Events as a log of users, an error as a delete, merged in three batches out of order; written once."""
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/quernel-{app}/kept-{hashlib.sha256(d.encode()).hexdigest()[:12]}"
    kept = jobs.Maintained(spark, path, "user_id", seq="event_id", buckets=8, spec=KEPT)
    if kept.manifest()[0] < 2:
        cmd = F.when(F.col("event_type") == "error", "delete").otherwise("add")
        log = load(spark, d, "events").select("user_id", "event_id", "event_type", cmd.alias("cmd"))
        for number, part in enumerate((1, 0, 2)):
            kept.merge(log.where(F.col("event_id") % 3 == part), number)
    return kept


NEWEST = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'"


@add("maintained_rows", NEWEST)
def maintained_rows(spark, d):
    return kept_events(spark, d).current().select("user_id", "event_id", "event_type")


@add("maintained_postings", f"SELECT CAST(user_id AS VARCHAR) AS doc_id, event_type AS term, event_id AS version FROM ({NEWEST})")
def maintained_postings(spark, d):
    return kept_events(spark, d).postings().select("doc_id", "term", "version")


@add("maintained_search", f"SELECT CAST(user_id AS VARCHAR) AS doc_id, 1.0::DOUBLE AS score FROM ({NEWEST}) WHERE event_type IN ('click', 'purchase')")
def maintained_search(spark, d):
    kept = kept_events(spark, d)
    query = {"bool": {"should": [{"term": {"event_type": "click"}}, {"match": {"event_type": "purchase"}}]}}
    return engine.search(engine.Index(KEPT, kept.current(), kept.store()), {"query": query, "sort_type": 3, "return_all": True}).rows


def streamed(spark, d, plan, mode: str) -> DataFrame:
    """What a stream over the events gives once all is read: a table of its own in memory."""
    stream = spark.readStream.schema(load(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    name = f"streamed_{uuid.uuid4().hex[:8]}"
    plan(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@add("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return streamed(spark, d, lambda s: jobs.tumbling(s, "1 day", "event_type", late="60 days"), "complete").select(F.col("window.start").alias("start"), "event_type", "n")


@add("stream_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def stream_counts(spark, d):
    return streamed(spark, d, jobs.running_counts, "complete")


@add("stream_deletes", "SELECT DISTINCT user_id AS doc_id, event_type AS version FROM events")
def stream_deletes(spark, d):
    queue = lambda s: s.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("version"), "ts")
    return streamed(spark, d, lambda s: jobs.coalesced_deletes(queue(s), "365 days"), "append").select("doc_id", "version")


@add("set_operations", "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_operations(spark, d):
    o = load(spark, d, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("F").intersect(of("O")).subtract(of("P"))


@add("page_rank_window", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS seq FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def page_rank_window(spark, d):
    page = load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")
    return page.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("seq"))


# --- segmenters ------------------------------------------------------------------------------------------

#: Names of parts without blanks in letters that are no ASCII, and their frequent pieces as a dictionary.
LATIN, OTHER = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ"
RUNS_CTE = f"t AS (SELECT p_partkey, translate(replace(lower(p_name), ' ', ''), '{LATIN}', '{OTHER}') AS s FROM part), pc AS (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM t), pk AS (SELECT substr(s, i::INT, k::INT) AS word FROM pc, range(2, 6) AS r(k) WHERE i + k - 1 <= length(s)), d AS (SELECT word, count(*) AS freq FROM pk GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM t) / 20)"


def runs(spark, d) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", "p_name", F.translate(F.replace(F.lower("p_name"), F.lit(" "), F.lit("")), LATIN, OTHER).alias("s"))


def pieces(spark, d) -> text.Dictionary:
    rows = runs(spark, d)
    found = rows.select(F.explode(text.ngram_terms(F.col("s"), 5)).alias("word")).where(F.char_length("word") > 1).groupBy("word").agg(F.count("*").alias("freq"))
    return text.Dictionary.trained_on(found.where(F.col("freq") >= rows.count() / 20), rows.select(F.transform(F.split("p_name", " "), lambda w: F.translate(F.lower(w), LATIN, OTHER)).alias("words")))


def segmented(mode: str, sql: str | None = None, **options) -> None:
    @add(f"segment_{mode}", sql)
    def query(spark, d):
        return runs(spark, d).select("p_partkey", F.array_join(pieces(spark, d).column(F.col("s"), mode), "|").alias("words"))


STEPS = "k AS (SELECT p_partkey, s, i, coalesce(max(n) FILTER (word IS NOT NULL), 1) AS n FROM (SELECT t.p_partkey, t.s, x.i, y.n, d.word FROM t, range(1, 400) AS x(i), range(2, 9) AS y(n) LEFT JOIN d ON d.word = %s AND %s WHERE x.i <= length(t.s)) GROUP BY ALL)"
segmented("forward", f"WITH RECURSIVE {RUNS_CTE}, {STEPS % ('substr(t.s, x.i::INT, y.n::INT)', 'x.i + y.n - 1 <= length(t.s)')}, f(p_partkey, i, words) AS (SELECT p_partkey, 1::BIGINT, []::VARCHAR[] FROM t UNION ALL SELECT f.p_partkey, f.i + k.n, list_append(f.words, substr(k.s, f.i::INT, k.n::INT)) FROM f JOIN k ON k.p_partkey = f.p_partkey AND k.i = f.i) SELECT f.p_partkey, array_to_string(words, '|') AS words FROM f JOIN t ON t.p_partkey = f.p_partkey WHERE f.i = length(t.s) + 1")
segmented("backward", f"WITH RECURSIVE {RUNS_CTE}, {STEPS % ('substr(t.s, (x.i - y.n + 1)::INT, y.n::INT)', 'x.i >= y.n')}, f(p_partkey, i, words) AS (SELECT p_partkey, length(s)::BIGINT, []::VARCHAR[] FROM t UNION ALL SELECT f.p_partkey, f.i - k.n, list_prepend(substr(k.s, (f.i - k.n + 1)::INT, k.n::INT), f.words) FROM f JOIN k ON k.p_partkey = f.p_partkey AND k.i = f.i) SELECT p_partkey, array_to_string(words, '|') AS words FROM f WHERE i = 0")
LIKELIEST = f"""WITH RECURSIVE {RUNS_CTE}, m AS (SELECT map(list(word), list(freq)) AS m FROM d),
f(p_partkey, s, i, best, ks) AS (
  SELECT p_partkey, s, length(s)::BIGINT, [0.0::DOUBLE], []::BIGINT[] FROM t
  UNION ALL
  SELECT p_partkey, s, i - 1, list_prepend(-c.a, best), list_prepend(c.k, ks) FROM (
    SELECT p_partkey, s, i, best, ks, list_sort(list_transform(CASE WHEN len(o) = 0 THEN [1::BIGINT] ELSE o END, lambda k: {{'a': -(ln(greatest(coalesce(m[substr(s, i::INT, k::INT)], 1), 1)::DOUBLE) - ln(8000000.0::DOUBLE) + best[k]), 'k': k}}))[1] AS c
    FROM (SELECT f.*, m.m, list_filter(range(1, 6), lambda k: i + k - 1 <= length(s) AND map_contains(m.m, substr(s, i::INT, k::INT))) AS o FROM f, m WHERE i > 0))),
w(p_partkey, s, ks, i, words) AS (
  SELECT p_partkey, s, ks, 1::BIGINT, []::VARCHAR[] FROM f WHERE i = 0
  UNION ALL
  SELECT p_partkey, s, ks, i + ks[i], list_append(words, substr(s, i::INT, ks[i]::INT)) FROM w WHERE i <= length(s))
SELECT p_partkey, array_to_string(words, '|') AS words FROM w WHERE i > length(s)"""
segmented("likeliest", LIKELIEST)
segmented("arbitrated")


@add("segment_discovered")
def segment_discovered(spark, d):
    """New words among what is left in single characters; the text cut at its blanks beforehand as a request would be."""
    made = pieces(spark, d)
    made.words = {w: n for w, n in made.words.items() if len(w) < 4}
    text.register_segmenter("pieces_discovered", made, "forward", discover=True)
    return runs(spark, d).select("p_partkey", F.array_join(text.analyze("pieces_discovered", F.col("s")), "|").alias("words"))


@add("segment_expanded", f"WITH {RUNS_CTE}, w AS (SELECT p_partkey, unnest(string_split(translate(lower(p_name), '{LATIN}', '{OTHER}'), ' ')) AS w FROM part), g AS (SELECT p_partkey, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM w, range(2, 4) AS r(n) WHERE length(w) > n) SELECT term, count(*) AS n FROM (SELECT w AS term FROM w UNION ALL SELECT substr(w, i::INT, n::INT) FROM g WHERE substr(w, i::INT, n::INT) IN (SELECT word FROM d)) GROUP BY term")
def segment_expanded(spark, d):
    words = runs(spark, d).select(F.explode(F.split(F.translate(F.lower("p_name"), LATIN, OTHER), " ")).alias("w"))
    made = pieces(spark, d)
    text.register_analyzer("pieces_expanded", lambda w: made.expand([w]))
    return words.select(F.explode(text.analyze("pieces_expanded", F.col("w"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@add("training_counts", "WITH w AS (SELECT string_split(p_name, ' ') AS w FROM part), e AS (SELECT list_concat(['<BEG>'], w, ['<END>']) AS e FROM w), c AS (SELECT array_to_string(w, '') AS c, array_to_string(list_transform(w, lambda x: CASE WHEN length(x) = 1 THEN 'S' ELSE 'B' || repeat('M', length(x) - 2) || 'E' END), '') AS t FROM w), f AS (SELECT 'pair' AS kind, unnest(e[:-2]) AS a, unnest(e[2:]) AS b FROM e UNION ALL SELECT 'start', t[1], '' FROM c UNION ALL SELECT 'emit', unnest(string_split(t, '')), unnest(string_split(c, '')) FROM c UNION ALL SELECT 'move', unnest(string_split(t, '')[:-2]), unnest(string_split(t, '')[2:]) FROM c) SELECT kind, a, b, count(*) AS n FROM f GROUP BY ALL")
def training_counts(spark, d):
    return text.training_counts(load(spark, d, "part").select(F.split("p_name", " ").alias("words")))


@add("stems")
def stems(spark, d):
    return words_of(spark, d).select("word", text.stemmed(F.col("word")).alias("stem"))


@add("valid_terms", f"WITH {TOKENS_CTE}, s AS (SELECT term FROM tok WHERE regexp_matches(term, '^[^a-z]') GROUP BY term) SELECT term FROM s WHERE term NOT IN ('2024', 'éa') AND (regexp_matches(term, '^[0-9]*[1-9]') OR length(term) = 4)")
def valid_terms(spark, d):
    """Terms that start with no Latin letter, so that the check is without stems: the dictionary has those of four characters."""
    terms = index.postings(spread(load(spark, d, "documents")), "doc_id", "text").select("term").distinct().where(F.col("term").rlike("^[^a-z]"))
    stop = spark.createDataFrame([("2024",), ("éa",)], "word string")
    return text.valid_terms(terms, stop, terms.where(F.char_length("term") == 4).withColumnRenamed("term", "word"))


# --- readings of characters: numbers as names in hanzi ------------------------------------------------------

DIGITS = "零一二三四五六七八九"
READINGS = {"零": ["ling"], "一": ["yi"], "二": ["er"], "三": ["san"], "四": ["si"], "五": ["wu"], "六": ["liu", "lu"], "七": ["qi"], "八": ["ba"], "九": ["jiu"], "肆": ["si"], "伍": ["wu"], "妻": ["qi"]}
NAMED = IndexSpec.of(6, "c_custkey", [FieldSpec("c_custkey", "long"), FieldSpec("name", "string", analyzer="pinyin"), FieldSpec("anywhere", "string", analyzer="pinyin", anywhere=True)])


def named(spark, d):
    name = F.translate(F.col("c_custkey").cast("string"), "0123456789", DIGITS)
    return engine.Index(NAMED, load(spark, d, "customer").select("c_custkey", name.alias("name"), name.alias("anywhere")), pinyin=vocab.Pinyin(READINGS))


STARTS = "starts_with(CAST(c_custkey AS VARCHAR), '%s')"
matches("phonetic_syllables", named, {"match": {"name": "yier"}}, STARTS % "12", "customer", "c_custkey")
matches("phonetic_initials", named, {"match": {"name": "yl"}}, f"({STARTS % '10'} OR {STARTS % '16'})", "customer", "c_custkey")
matches("phonetic_mixed", named, {"match": {"name": "一lu"}}, STARTS % "16", "customer", "c_custkey")
matches("phonetic_anywhere", named, {"bool": {"must": [{"match": {"anywhere": "sanqi"}}], "must_not": [{"match": {"name": "二"}}]}}, "contains(CAST(c_custkey AS VARCHAR), '37') AND NOT starts_with(CAST(c_custkey AS VARCHAR), '2')", "customer", "c_custkey")

#: Sizes of parts as words, by how many parts have them.
SIZES_CTE = f"v AS (SELECT translate(CAST(p_size AS VARCHAR), '0123456789', '{DIGITS}') AS word, CAST(p_size AS VARCHAR) AS digits, count(*) AS freq FROM part GROUP BY ALL)"


def size_words(spark, d):
    word = F.translate(F.col("p_size").cast("string"), "0123456789", DIGITS)
    p = vocab.Pinyin(READINGS)
    return p, p.table(load(spark, d, "part").groupBy(word.alias("word")).agg(F.count("*").alias("freq")))


@add("suggest_units", f"WITH {SIZES_CTE} SELECT word, freq FROM v WHERE starts_with(digits, '3') ORDER BY freq DESC, word LIMIT 5")
def suggest_units(spark, d):
    p, words = size_words(spark, d)
    return p.suggest(words, "san")


@add("suggest_fallback", f"WITH {VOCAB} SELECT word, freq FROM v WHERE starts_with(word, 'wit') ORDER BY freq DESC, word LIMIT 5")
def suggest_fallback(spark, d):
    p = vocab.Pinyin(READINGS)
    return p.suggest(p.table(words_of(spark, d)), "wit")


@add("correct_reading", f"WITH {SIZES_CTE} SELECT word, freq FROM v WHERE digits = '24'")
def correct_reading(spark, d):
    p, words = size_words(spark, d)
    return p.correct(words, "二肆").select("word", "freq")


@add("correct_character", f"WITH {SIZES_CTE} SELECT word, freq FROM v WHERE (length(digits) = 2 AND digits[1] = '4') OR (length(digits) = 1 AND digits = '4') ORDER BY freq DESC, word LIMIT 1")
def correct_character(spark, d):
    """A character that is nobody's reading: a word of one edit, the most frequent."""
    p, words = size_words(spark, d)
    return p.correct(words, "四龘").select("word", "freq")


@add("phonetic_units", f"WITH r(ch, py) AS (VALUES {', '.join(f'({c!r}, {x!r})' for c, v in READINGS.items() for x in v)}), w AS (SELECT DISTINCT translate(CAST(p_size AS VARCHAR), '0123456789', '{DIGITS}') AS word FROM part), u AS (SELECT word, unnest(range(length(word))) AS pos FROM w) SELECT word, CAST(pos AS INT) AS place, ch, py FROM u JOIN r ON ch = substr(word, (pos + 1)::INT, 1)")
def phonetic_units(spark, d):
    _, words = size_words(spark, d)
    one = words.select("word", F.posexplode("units").alias("place", "u"))
    return one.select("word", "place", F.col("u.ch").alias("ch"), F.explode("u.py").alias("py"))


# --- requests, pins, logs, settings ------------------------------------------------------------------------------

@add("ingest_articles", f"WITH t AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), regexp_extract_all(lower(source), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM documents) SELECT term, count(*) AS n FROM t GROUP BY term")
def ingest_articles(spark, d):
    """Documents as JSON batches of ten, their text as content and their source as title, read, checked and indexed."""
    one = F.struct(F.lit("add").alias("cmd"), F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), F.col("text").alias("content")).alias("fields"))
    batches = load(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("b")).agg(F.collect_list(one).alias("table_content"))
    raw = batches.select(F.to_json(F.struct(F.lit(1).alias("appid"), F.size("table_content").alias("fields_count"), "table_content")).alias("value"))
    made = files.article_postings(files.articles(raw))
    return made.groupBy("term").agg(F.sum("tf").alias("n"))


@add("ingest_refused", "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderkey % 3 = 0 AS ok FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT NULL, false FROM orders WHERE o_orderkey % 5 = 0")
def ingest_refused(spark, d):
    """Batches whose count is wrong, or that have no article, are refused."""
    n = F.col("o_orderkey")
    one = F.struct(F.lit("update").alias("cmd"), F.struct(n.cast("string").alias("doc_id")).alias("fields"))
    content = F.when(n % 5 == 0, F.array().cast("array<struct<cmd:string,fields:struct<doc_id:string>>>")).otherwise(F.array(one))
    raw = load(spark, d, "orders").select(F.to_json(F.struct(F.lit(1).alias("appid"), F.when(n % 3 == 0, F.size(content)).otherwise(2).alias("fields_count"), content.alias("table_content"))).alias("value"))
    return files.articles(raw).select("doc_id", "ok")


PINS_CTE = "p AS (SELECT event_type AS word, CAST(event_id AS VARCHAR) AS doc_id, 1 AS weight, ts AS start_time, ts + INTERVAL 24 HOUR AS end_time FROM events), s AS (SELECT s_suppkey, unnest(['click', 'own']) AS word, CAST(s_suppkey AS VARCHAR) AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE CAST(s_nationkey AS INT) END AS weight, to_timestamp(1704067200 + s_suppkey * 3600) AT TIME ZONE 'UTC' AS start_time FROM supplier)"


@add("pins_added", f"WITH {PINS_CTE} SELECT word, doc_id, weight, start_time, end_time FROM p WHERE (word, doc_id) NOT IN (SELECT word, doc_id FROM s) UNION ALL SELECT word, doc_id, weight, start_time, start_time + INTERVAL 24 HOUR FROM s")
def pins_added(spark, d):
    return mutate.add_pins(*_pin_tables(spark, d, "top_add"))


@add("pins_dropped", f"WITH {PINS_CTE} SELECT word, doc_id, weight, start_time, end_time FROM p WHERE doc_id NOT IN (SELECT doc_id FROM s)")
def pins_dropped(spark, d):
    pins, sent = _pin_tables(spark, d, "top_delete")
    return mutate.drop_pins(pins, sent.select("doc_id"))


def _pin_tables(spark, d, cmd: str) -> tuple[DataFrame, DataFrame]:
    """Events as pins, and a request for each supplier."""
    pins = load(spark, d, "events").select(F.col("event_type").alias("word"), F.col("event_id").cast("string").alias("doc_id"), F.lit(1).alias("weight"), F.col("ts").cast("timestamp").alias("start_time"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).cast("timestamp").alias("end_time"))
    n = F.col("s_suppkey")
    fields = F.struct(n.cast("string").alias("id"), F.lit("click||own").alias("sp_words"), F.when(n % 2 == 1, F.col("s_nationkey")).alias("weight"), (n * 3600 + 1704067200).alias("top_start_time"))
    raw = load(spark, d, "supplier").select(F.to_json(F.struct(F.lit(1).alias("appid"), F.struct(F.lit(cmd).alias("cmd"), fields.alias("fields")).alias("table_content"))).alias("value"))
    return pins, files.pin_requests(raw).drop("cmd")


@add("click_lines", "SELECT '1|' || event_type || '|' || event_id % 10 || '|u' || event_id || '|' || CASE WHEN user_id % 3 = 0 THEN '0' ELSE CAST(user_id AS VARCHAR) END || '|' || strftime(to_timestamp(event_id * 977) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || '|' AS line FROM events")
def click_lines(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    rows = load(spark, d, "events").select(F.lit(1).alias("app"), F.col("event_type").alias("word"), (e % 10).alias("rank"), F.concat(F.lit("u"), e.cast("string")).alias("url"), F.when(u % 3 == 0, "").otherwise(u.cast("string")).alias("user"), (e * 977).alias("seconds"))
    return vocab.click_line(rows)


@add("update_hot", "SELECT 1 AS app, event_type AS word, count(*) + CASE event_type WHEN 'click' THEN 500 ELSE 0 END AS n FROM events GROUP BY event_type UNION ALL SELECT 2, 'click', 7")
def update_hot(spark, d):
    counts = load(spark, d, "events").groupBy(F.lit(1).alias("app"), F.col("event_type").alias("word")).agg(F.count("*").alias("n"))
    return vocab.update_hot(counts, spark.createDataFrame([(1, "click", 500), (1, "click", 900), (2, "click", 7)], "app int, word string, n long"))


@add("update_settings", "SELECT * FROM (VALUES (1, 'cache', '1'), (1, 'english', '0'), (2, 'cache', '1')) AS s(app, name, value)")
def update_settings(spark, d):
    rows = spark.createDataFrame([(1, "cache", "0"), (1, "english", "0")], "app int, name string, value string")
    return vocab.update_settings(rows, spark.createDataFrame([(1, "cache", "1"), (2, "cache", "1")], rows.schema))


@add("update_groups", "WITH g AS (SELECT DISTINCT p_size AS group_id, p_brand AS word FROM part) SELECT group_id::BIGINT AS group_id, word FROM g UNION SELECT (SELECT min(group_id) FROM g WHERE word = (SELECT min(word) FROM g))::BIGINT, 'new' UNION SELECT (SELECT max(group_id) FROM g)::BIGINT + 2, 'alone'")
def update_groups(spark, d):
    groups = load(spark, d, "part").select(F.col("p_size").cast("long").alias("group_id"), F.col("p_brand").alias("word")).distinct()
    first = groups.agg(F.min("word").alias("word")).select(F.lit(1).cast("long").alias("group_id"), "word")
    new = first.union(spark.createDataFrame([(1, "new"), (2, "alone")], "group_id long, word string"))
    return vocab.merge_groups(groups, new)


@add("time_text", "SELECT event_id, strftime(to_timestamp(event_id * 86413) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at FROM events")
def time_text(spark, d):
    return load(spark, d, "events").select("event_id", text.time_text(F.col("event_id") * 86413).alias("at"))


@add("request_counts", "SELECT 1 AS app, event_type AS kind, CASE WHEN value < 5 THEN 5 WHEN value < 10 THEN 10 WHEN value < 50 THEN 50 WHEN value < 100 THEN 100 WHEN value < 500 THEN 500 WHEN value < 1000 THEN 1000 END AS bucket, count(*) AS n, count(*) FILTER (user_id % 4 = 1) AS failed FROM events GROUP BY ALL")
def request_counts(spark, d):
    log = load(spark, d, "events").select(F.lit(1).alias("app"), F.col("event_type").alias("kind"), F.col("value").alias("millis"), (F.col("user_id") % 4 == 1).cast("int").alias("code"))
    return files.request_counts(log)


@add("kv_add_column", "SELECT s_suppkey, s_name, 7 AS grade FROM supplier UNION ALL SELECT 1000001, 'new', 9")
def kv_add_column(spark, d):
    table = mutate.add_column(load(spark, d, "supplier").select("s_suppkey", "s_name"), "grade", "int", 7)
    return mutate.insert(table, spark.createDataFrame([(1000001, "new", 9)], table.schema), ["s_suppkey"])[0]


@add("events_joined", "SELECT a.event_id, b.event_id AS r_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def events_joined(spark, d):
    e = load(spark, d, "events")
    return jobs.joined(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "6 HOURS").select("event_id", "r_event_id")


@add("deletes_coalesced", "SELECT DISTINCT user_id AS doc_id, event_type AS version FROM events")
def deletes_coalesced(spark, d):
    return jobs.coalesced_deletes(load(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("version"), "ts")).select("doc_id", "version")


@add("counts_running", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def counts_running(spark, d):
    return jobs.running_counts(load(spark, d, "events"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a relevance search over whole documents."""
    return QUERIES["match_or_tokens"](spark, sf_dir)
