"""Registered queries of the search engine over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import stem
from siftwell.functions import text as X
from siftwell.operators import flatten
from siftwell.operators.collection import Collection
from siftwell.operators.ranked import ranked
from siftwell.plans import lang
from siftwell.sources import store
from siftwell.sources.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "ngram_bm25"
FUZZY = "the retition"
PART_NUMBERS = ["p_size", "p_retailprice"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__.rstrip("_")] = f
        if sql is not None:
            ORACLE_SQL[f.__name__.rstrip("_")] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection.from_table(table(spark, sf_dir, "documents"), "doc_id", ["text"])


def parts(spark: SparkSession, sf_dir: str, fields: list[str] | None = None) -> Collection:
    return Collection.from_table(table(spark, sf_dir, "part"), "p_partkey", fields)


def events(spark: SparkSession, sf_dir: str) -> Collection:
    """value and the nested object of props, as a document each."""
    e = table(spark, sf_dir, "events").withColumn("props", F.from_json("props", "map<string,double>"))
    return Collection.from_table(e, "event_id", ["value", "props"])


TERMS = r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents"
PART_TERMS = r"""SELECT doc_id, path, unnest(regexp_extract_all(lower(v), '[a-z0-9]+')) AS term FROM (
    SELECT p_partkey AS doc_id, 'p_name' AS path, p_name AS v FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part)"""
PART_TEXT = ["p_name", "p_brand", "p_type"]


# --- points, words, fields


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 42")
def get_by_id(spark, d):
    return table(spark, d, "documents").where(F.col("doc_id") == 42).select("doc_id", "lang", "source")


@query(f"SELECT DISTINCT doc_id FROM ({TERMS}) WHERE term IN ('was', 'die', 'rend')")
def words_or(spark, d):
    return documents(spark, d).words(["was", "DIE", "rend"])


@query(f"SELECT doc_id FROM ({TERMS}) WHERE term IN ('the', 'was', 'with') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def words_and(spark, d):
    return documents(spark, d).and_words(["the", "Was", "with"])


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({TERMS}) WHERE term IN ('the', 'de'))")
def words_not(spark, d):
    return documents(spark, d).not_words(["the", "de"])


@query(f"SELECT term, doc_id, count(*) AS tf FROM ({TERMS}) GROUP BY ALL")
def postings(spark, d):
    return documents(spark, d).postings.select("term", "doc_id", "tf")


@query(f"SELECT doc_id, count(*) AS tf FROM ({TERMS}) WHERE term = 'the' GROUP BY doc_id")
def get_postings(spark, d):
    return documents(spark, d).get_postings("the").select("doc_id", "tf")


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM ({TERMS}) GROUP BY term")
def doc_freq(spark, d):
    return documents(spark, d).vocab


@query(f"SELECT doc_id, count(*) AS dl FROM ({TERMS}) GROUP BY doc_id")
def doc_lengths(spark, d):
    return documents(spark, d).doc_stats


@query(f"""SELECT (SELECT count(*) FROM documents) AS n_docs, count(DISTINCT term) AS n_terms, count(*) AS n_tokens, count(DISTINCT (term, doc_id)) AS n_postings,
    round(count(*) / count(DISTINCT doc_id), 6) AS avgdl FROM ({TERMS})""")
def corpus_stats(spark, d):
    return documents(spark, d).stats().select("n_docs", "n_terms", "n_tokens", "n_postings", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT DISTINCT doc_id FROM ({PART_TERMS}) WHERE term = 'small' AND path = 'p_name'")
def term_in_field(spark, d):
    return parts(spark, d, PART_TEXT).term_in_field("small", "p_name")


@query(f"SELECT DISTINCT doc_id FROM ({PART_TERMS}) WHERE term = 'small' AND list_contains(string_split(path, '.'), 'p_type')")
def term_in_segment(spark, d):
    return parts(spark, d, PART_TEXT).term_in_segment("small", "p_type")


@query(f"SELECT doc_id, string_agg(DISTINCT path, ',' ORDER BY path) AS field_paths FROM ({PART_TERMS}) WHERE term = 'small' GROUP BY doc_id")
def term_fields(spark, d):
    return parts(spark, d, PART_TEXT).term_with_fields("small").select("doc_id", F.array_join("field_paths", ",").alias("field_paths"))


# --- flattening and scalar functions


@query("""SELECT event_id AS doc_id, 'props.' || k AS path, 'number' AS kind, v AS text, 1 AS depth FROM (
        SELECT event_id, unnest(json_keys(props)) AS k, json_extract_string(props, '$.k') AS v FROM events)
    UNION ALL SELECT event_id, 'event_type', 'text', lower(event_type), 0 FROM events""")
def flatten_events(spark, d):
    e = table(spark, d, "events").withColumn("props", F.from_json("props", "map<string,double>"))
    return Collection.from_table(e, "event_id", ["event_type", "props"]).fields.select("doc_id", "path", "kind", "text", "depth")


@query("SELECT event_id AS doc_id, 'k' AS path, 'number' AS kind, json_extract_string(props, '$.k') AS text FROM events")
def flatten_json(spark, d):
    return Collection.from_json(table(spark, d, "events"), "event_id", "props").fields.select("doc_id", "path", "kind", "text")


@query("""SELECT conv_id AS doc_id, 'turns.' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) || '.text' AS path,
    regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') AS text FROM conversations""")
def flatten_arrays(spark, d):
    c = table(spark, d, "conversations")
    docs = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["text"].alias("text"))).alias("turns"))
    return Collection.from_table(docs, "conv_id").fields.select("doc_id", "path", "text")


@query("SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS date, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS vkey FROM orders")
def date_keys(spark, d):
    f = Collection.from_table(table(spark, d, "orders"), "o_orderkey", ["o_orderdate"]).fields
    return f.select("doc_id", "date", "vkey")


@query("SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b, 'x' || o_orderkey AS c FROM orders")
def date_normalize(spark, d):
    o = table(spark, d, "orders")
    n = lambda c: X.normalize_date(c)
    return o.select(F.col("o_orderkey").alias("doc_id"), n(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("a"), n(F.date_format("o_orderdate", " yyyy/MM/dd ")).alias("b"), n(F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).alias("c"))


@query("SELECT event_id AS doc_id, trunc(value * 1000)::BIGINT AS vkey FROM events")
def value_keys(spark, d):
    return events(spark, d).fields.where("path = 'value'").select("doc_id", "vkey")


@query("SELECT c_custkey AS doc_id, trunc(c_acctbal * 1000)::BIGINT AS vkey, lower(trim(c_mktsegment)) AS text FROM customer")
def normalize(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("doc_id"), X.value_key(F.col("c_acctbal")).alias("vkey"), X.normalize_text(F.col("c_mktsegment")).alias("text"))


@query("SELECT p_partkey AS doc_id, p_size::VARCHAR AS size, CASE WHEN p_retailprice = trunc(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS price FROM part")
def number_text(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("doc_id"), X.number_text(F.col("p_size")).alias("size"), X.number_text(F.col("p_retailprice")).alias("price"))


VOCAB = f"SELECT DISTINCT term FROM ({TERMS})"
LOOKED_FOR = ["the", "retition", "widget"]


@query(f"SELECT DISTINCT term, substr(term, i, n) AS gram FROM ({VOCAB}) v, unnest([2, 3, 4, 5]) AS a(n), unnest(range(1, length(term) + 1)) AS b(i) WHERE i + n - 1 <= length(term)")
def ngrams(spark, d):
    return documents(spark, d).grams.select("term", "gram")


@query(f"SELECT a, term AS b, levenshtein(a, term) AS dist FROM ({VOCAB}), unnest({LOOKED_FOR}) AS q(a)")
def edit_distance(spark, d):
    v = documents(spark, d).vocab.select(F.explode(F.lit(LOOKED_FOR)).alias("a"), F.col("term").alias("b"))
    return v.select("a", "b", X.edit_distance(F.col("a"), F.col("b")).alias("dist"))


@query(f"SELECT DISTINCT term FROM ({TERMS}) WHERE contains(term, 'tion')")
def gram_terms(spark, d):
    return documents(spark, d).gram_terms("tion")


@query(f"SELECT DISTINCT term FROM ({TERMS}) WHERE contains(term, 'in')")
def prefix_terms(spark, d):
    return documents(spark, d).prefix_terms("in")


#: Stems of the words of part names by the published rules.
_STEMS = {w: w for w in "anvil blue bolt cold gear gizmo hot new old plate red ring rod small widget".split()} | {"large": "larg"}


@query(f"SELECT DISTINCT term, stem FROM ({PART_TERMS}) JOIN (VALUES {', '.join(map(str, _STEMS.items()))}) AS s(word, stem) ON term = word WHERE path = 'p_name'")
def stemming(spark, d):
    v = parts(spark, d, ["p_name"]).vocab
    return v.select("term", stem.stem_word("term").alias("stem"))


# --- numbers


@query("SELECT p_partkey AS doc_id, 'p_size' AS path FROM part WHERE p_size BETWEEN 10 AND 20")
def range_exact(spark, d):
    return parts(spark, d, PART_NUMBERS).range("p_size", 10, 20).select("doc_id", "path")


@query("SELECT event_id AS doc_id, 'props.k' AS path FROM events WHERE json_extract(props, '$.k')::BIGINT BETWEEN 30 AND 35")
def range_nested(spark, d):
    return events(spark, d).range("props.k", 30, 35).select("doc_id", "path")


def _events_where(cond: str) -> str:
    return f"SELECT event_id AS doc_id, 'value' AS path FROM (SELECT event_id, trunc(value * 1000)::BIGINT AS v FROM events) WHERE {cond}"


@query(_events_where("v >= 101000"))
def gt(spark, d):
    return events(spark, d).gt("value", 100).select("doc_id", "path")


@query(_events_where("v >= 100000"))
def gte(spark, d):
    return events(spark, d).gte("value", 100).select("doc_id", "path")


@query(_events_where("v <= 9000"))
def lt(spark, d):
    return events(spark, d).lt("value", 10).select("doc_id", "path")


@query(_events_where("v <= 10000"))
def lte(spark, d):
    return events(spark, d).lte("value", 10).select("doc_id", "path")


@query("SELECT event_id AS doc_id, 'props.k' AS path FROM events WHERE json_extract(props, '$.k')::BIGINT BETWEEN 10 AND 12")
def between(spark, d):
    return events(spark, d).between("k", 10, 12).select("doc_id", "path")


@query("SELECT p_partkey AS doc_id, 'p_size' AS path FROM part WHERE p_size BETWEEN 10 AND 20 AND p_size NOT IN (12, 15)")
def between_exclude(spark, d):
    return parts(spark, d, PART_NUMBERS).between("p_size", 10, 20, exclude=[12, 15]).select("doc_id", "path")


@query("SELECT o_orderkey AS doc_id, 'o_orderdate' AS path FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-02-01' AND DATE '1996-05-15'")
def date_between(spark, d):
    return Collection.from_table(table(spark, d, "orders"), "o_orderkey", ["o_orderdate"]).date_between("o_orderdate", "1996-02-01", "1996-05-15").select("doc_id", "path")


@query("SELECT row_id AS doc_id, 'l_quantity' AS path FROM (SELECT l_orderkey::VARCHAR || ':' || l_linenumber AS row_id, trunc(l_quantity * 1000)::BIGINT AS v FROM lineitem) WHERE v >= 46000")
def gt_lineitem(spark, d):
    line = table(spark, d, "lineitem").withColumn("row_id", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return Collection.from_table(line, "row_id", ["l_quantity"]).gt("l_quantity", 45).select("doc_id", "path")


# --- ranking


def _bm25(weights: str) -> str:
    """CTEs after ``weights`` (term, w): BM25 with k1 = 1.2, b = 0.75."""
    return f"""
        t AS MATERIALIZED ({TERMS}), dl AS (SELECT doc_id, count(*)::DOUBLE AS dl FROM t GROUP BY doc_id), c AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
        w AS ({weights}),
        tf AS (SELECT t.term, t.doc_id, count(*)::DOUBLE AS tf FROM t WHERE term IN (SELECT term FROM w) GROUP BY ALL), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term)
        SELECT doc_id, round(sum(w * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM tf JOIN df USING (term) JOIN w USING (term) JOIN dl USING (doc_id), c GROUP BY doc_id"""


def _fuzzy(over: float) -> str:
    grams = "SELECT substr(q, i, n) AS g FROM unnest(['the', 'retition']) AS a(q), unnest([2, 3, 4, 5]) AS b(n), unnest(range(1, 20)) AS c(i) WHERE i + n - 1 <= length(q)"
    return f"""SELECT term, 0.6 * (hits / {over}) + 0.4 * (1.0 - levenshtein('{FUZZY}', term) / length(term)::DOUBLE) AS w, hits
        FROM (SELECT term, count(*)::BIGINT AS hits FROM (SELECT DISTINCT term FROM ({TERMS})) v, ({grams}) g WHERE contains(v.term, g.g) GROUP BY term) ORDER BY w DESC, term DESC LIMIT 10"""


@query("WITH " + _bm25("SELECT unnest(['the', 'rend', 'was']) AS term, 1.0 AS w"))
def bm25(spark, d):
    return documents(spark, d).bm25(["the", "Rend", "was"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT term, hits, round(w, 6) AS w FROM ({_fuzzy(2.0)})")
def gram_candidates(spark, d):
    return documents(spark, d).candidates(FUZZY).select("term", "hits", F.round("w", 6).alias("w"))


@query("WITH " + _bm25(_fuzzy(2.0)))
def ngram_bm25(spark, d):
    return documents(spark, d).ngram_bm25(FUZZY).select("doc_id", F.round("score", 6).alias("score"))


@query("WITH " + _bm25(_fuzzy(4.0)))
def ngram_bm25_old(spark, d):
    return documents(spark, d).ngram_bm25_old(FUZZY).select("doc_id", F.round("score", 6).alias("score"))


# --- sorting: rows compare without their order, so that each carries its rank


@query("SELECT p_partkey AS doc_id, row_number() OVER (ORDER BY p_size DESC NULLS FIRST, p_retailprice ASC NULLS LAST, p_partkey) AS rank FROM part")
def sort_multi(spark, d):
    c = parts(spark, d, PART_NUMBERS)
    keys, order = c.sort_columns([("size", False), ("retailprice", True)])
    return ranked(c.base.select("doc_id", *keys), [*order, F.col("doc_id").asc()]).select("doc_id", "rank")


@query("SELECT event_id AS doc_id, row_number() OVER (ORDER BY least(value, json_extract(props, '$.value')::DOUBLE) ASC NULLS LAST, event_id) AS rank FROM events")
def sort_leaf(spark, d):
    c = events(spark, d).sort_by_leaf([("value", True)])
    return ranked(c, [F.col("key_0").asc_nulls_last(), F.col("doc_id").asc()]).select("doc_id", "rank")


@query("SELECT p_partkey AS doc_id, row_number() OVER (ORDER BY greatest(p_size, trunc(p_retailprice)::BIGINT) DESC, p_partkey) AS rank FROM part")
def sort_substring(spark, d):
    c = parts(spark, d, PART_NUMBERS).sort_by_substring("p_", ascending=False)
    return ranked(c, [F.col("key_0").desc(), F.col("doc_id").asc()]).select("doc_id", "rank")


@query("SELECT event_id AS doc_id, row_number() OVER (ORDER BY json_extract(props, '$.k')::BIGINT, event_id) AS rank FROM events")
def sort_path(spark, d):
    c = events(spark, d).sort_by_path("props.k")
    return ranked(c, [F.col("key_0").asc(), F.col("doc_id").asc()]).select("doc_id", "rank")


# --- query language

_RED = "list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'red')"
_RING = "list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'ring')"


@query(f"SELECT p_partkey AS doc_id FROM part WHERE {_RED} AND p_size >= 26")
def lang_and(spark, d):
    return parts(spark, d).query("p_name = red AND p_size > 25")


@query(f"SELECT p_partkey AS doc_id FROM part WHERE {_RED} UNION ALL SELECT p_partkey FROM part WHERE p_size <= 10")
def lang_or_bag(spark, d):
    return parts(spark, d).query("p_name = red OR p_size <= 10")


@query(f"SELECT p_partkey AS doc_id FROM part WHERE NOT {_RED} AND p_size <= 4")
def lang_not(spark, d):
    return parts(spark, d).query("NOT p_name = red AND p_size < 5")


@query(f"SELECT (SELECT count(*) FROM part WHERE {_RED}) + (SELECT count(*) FROM part WHERE {_RING}) AS count")
def lang_count(spark, d):
    return lang.count(parts(spark, d), "COUNT (p_name = red OR p_name = ring)")


@query(f"""SELECT doc_id, row_number() OVER (ORDER BY p_size DESC NULLS FIRST, p_retailprice, doc_id) AS rank FROM (
    SELECT p_partkey AS doc_id, p_size, p_retailprice FROM part WHERE {_RED} UNION ALL SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 46)""")
def lang_sort(spark, d):
    c = parts(spark, d)
    e = lang.parse("p_name = red OR p_size > 45 SORT BY ((p_size DESC), (p_retailprice ASC))")
    keys, order = c.sort_columns(e.fields)
    hits = lang.run(c, e.inner).join(c.base.select("doc_id", *keys), "doc_id")
    return ranked(hits, [*order, F.col("doc_id").asc()]).select("doc_id", "rank")


# --- commit log: events as commits on users


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("commit_id"), F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("op"), F.col("user_id").alias("doc_id"), F.col("props").alias("data"))


def _live(cond: str = "true") -> str:
    return f"""SELECT user_id AS doc_id, event_id AS commit_id, props AS data FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE {cond}) WHERE r = 1 AND event_type <> 'error'"""


@query(_live())
def live_docs(spark, d):
    return store.live(commits(spark, d)).select("doc_id", "commit_id", "data")


@query(_live("event_id <= 700"))
def rollback(spark, d):
    return store.live(commits(spark, d), up_to=700).select("doc_id", "commit_id", "data")


@query(_live())
def snapshot_replay(spark, d):
    c = commits(spark, d)
    return store.replay(store.live(c, up_to=500), c, 500).select("doc_id", "commit_id", "data")


@query("SELECT p_partkey AS doc_id, p_size % 4 = 0 AS valid FROM part")
def validate(spark, d):
    """Documents with an empty name at the root, in an object and in an array's object, and ones without."""
    name = F.to_json(F.struct(F.col("p_name").alias("v")))
    bad = [F.concat(F.lit('{"":'), name, F.lit("}")), F.concat(F.lit('{"a":{"":'), name, F.lit("}}")), F.concat(F.lit('{"a":[1,{"b":{"":'), name, F.lit("}}]}"))]
    size = F.col("p_size") % 4
    data = F.when(size == 0, F.concat(F.lit('{"a":[{"b":'), name, F.lit('}],"c":""}'))).when(size == 1, bad[0]).when(size == 2, bad[1]).otherwise(bad[2])
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), flatten.valid_json(data).alias("valid"))


# --- the engine: parts are added, some become new versions, some go


def _engine(spark: SparkSession, sf_dir: str) -> tuple[store.Engine, int]:
    """An engine in the shared folder, and its last commit before versions and deletions."""
    e = store.Engine(spark, f"{shared_dir(spark)}/siftwell-engine-{uuid.uuid4().hex[:12]}", snapshot_every=10**15)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    mark = e.add_table(p, "p_partkey")
    e.snapshot()
    e.add_table(p.where("p_size < 10").withColumn("p_name", F.concat(F.lit("second "), "p_name")), "p_partkey", max_depth=0)
    e.delete("1", "2", "no such part")
    return store.Engine(spark, e.path), mark  # opened again


_PARTS = "SELECT p_partkey::VARCHAR AS doc_id, {} AS name FROM part"


@query(_PARTS.format("CASE WHEN p_size < 10 THEN 'second ' || p_name ELSE p_name END") + " WHERE p_partkey NOT IN (1, 2)")
def engine_live(spark, d):
    e, _ = _engine(spark, d)
    return e.live().select("doc_id", F.get_json_object("data", "$.p_name").alias("name"))


@query(_PARTS.format("p_name"))
def engine_as_of(spark, d):
    e, mark = _engine(spark, d)
    return e.as_of(mark).select("doc_id", F.get_json_object("data", "$.p_name").alias("name"))


@query("SELECT p_partkey::VARCHAR AS doc_id FROM part WHERE p_size < 10 AND p_partkey NOT IN (1, 2)")
def engine_search(spark, d):
    e, _ = _engine(spark, d)
    return e.collection().words(["second"])


@query("SELECT p_partkey::VARCHAR AS doc_id, p_name AS name, NULL::INT AS max_depth FROM part")
def engine_rollback(spark, d):
    e, mark = _engine(spark, d)
    e.rollback_to(mark)
    return e.live().select("doc_id", F.get_json_object("data", "$.p_name").alias("name"), "max_depth")
