"""Queries over the test tables, one or more for each operator, with the SQL that must give the same rows.

The tables stand in for the domain's: part for targets, lineitem for activities, conversations for to-many children,
events' JSON for nested structures, documents and benchmark for a corpus and questions, embeddings for an index.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.functions import chem
from karst.functions.text import fixed_windows, recursive_chunks, tokens
from karst.operators.fetch import Roles, drop_missing, get_molecules_activity, get_molecules_activity_with_filters, keep_first
from karst.operators.queryset import QuerySet
from karst.operators.search import alike_of, nearest_of, similar_of
from karst.plans.catalog import SCHEMAS, Catalog, Entity, domain_catalog
from karst.plans.compiler import compile_plan
from karst.plans.planner import parse_plan, validate
from karst.sources.envelope import records, result_key
from karst.sources.notebook import notebook_cells

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "documents": ("doc_id",), "pages": ("page_id",), "embeddings": ("vec_id",), "benchmark": ("item_id",), "labels": ("doc_id",),
}
#: lineitem as activities of parts: an IC50 is a returned item, a structure is a supplier.
ROLES = Roles(
    target="part", target_id="p_partkey", target_name="p_name", activity="lineitem", activity_target="l_partkey", key="l_suppkey", needed=("l_suppkey", "l_extendedprice"),
    columns=("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice"), kind={"l_returnflag": "R"},
)


def catalog(spark: SparkSession, d: str) -> Catalog:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{d}/{name}.parquet")

    entities = [Entity(n, lambda s, n=n: read(n), k, f"{n}s") for n, k in KEYS.items()]
    nested = lambda s: read("events").select("event_id", "user_id", "event_type", F.from_json("props", "k int").alias("props"))
    talks = lambda s: read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    labelled = lambda s: read("documents").select("doc_id", "lang", "source").join(read("labels"), "doc_id", "left")
    return Catalog(spark, [*entities, Entity("event", nested, ("event_id",), "events", {"kind": "event_type"}), Entity("talk", talks, ("conv_id",), "talks"), Entity("labelled", labelled, ("doc_id",), "labelled")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _lookup(name: str, entity: str, fields: list[str], sql: str, **filters) -> None:
    query(name, sql)(lambda spark, d: QuerySet(catalog(spark, d), entity).filter(**filters).only(fields).df)


_PART = "SELECT p_partkey, p_name FROM part WHERE "
for _name, _filters, _where in [
    ("exact", {"p_name": "red widget"}, "p_name = 'red widget'"),
    ("iexact", {"p_name__iexact": "RED Widget"}, "lower(p_name) = 'red widget'"),
    ("contains", {"p_name__contains": "d w"}, "contains(p_name, 'd w')"),
    ("icontains", {"p_name__icontains": "WIDGET"}, "contains(lower(p_name), 'widget')"),
    ("startswith", {"p_name__startswith": "red"}, "starts_with(p_name, 'red')"),
    ("istartswith", {"p_name__istartswith": "RED"}, "starts_with(lower(p_name), 'red')"),
    ("endswith", {"p_name__endswith": "widget"}, "ends_with(p_name, 'widget')"),
    ("iendswith", {"p_name__iendswith": "GET"}, "ends_with(lower(p_name), 'get')"),
    ("regex", {"p_name__regex": "^(red|blue) .*t$"}, "regexp_matches(p_name, '^(red|blue) .*t$')"),
    ("iregex", {"p_name__iregex": "^RED .*T$"}, "regexp_matches(p_name, '^RED .*T$', 'i')"),
]:
    _lookup(f"lookup_{_name}", "part", ["p_partkey", "p_name"], _PART + _where, **_filters)
_SIZE = "SELECT p_partkey, p_size FROM part WHERE "
for _name, _filters, _where in [
    ("in", {"p_size__in": [1, 7, 30]}, "p_size IN (1, 7, 30)"),
    ("in_empty", {"p_size__in": []}, "false"),
    ("gt", {"p_size__gt": 40}, "p_size > 40"),
    ("gte", {"p_size__gte": 40}, "p_size >= 40"),
    ("lt", {"p_size__lt": 5}, "p_size < 5"),
    ("lte", {"p_size__lte": 5}, "p_size <= 5"),
    ("range", {"p_size__range": (10, 12)}, "p_size BETWEEN 10 AND 12"),
]:
    _lookup(f"lookup_{_name}", "part", ["p_partkey", "p_size"], _SIZE + _where, **_filters)
_LABELLED = "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS "
_lookup("lookup_isnull_true", "labelled", ["doc_id"], _LABELLED + "NULL", quality__isnull=True)
_lookup("lookup_isnull_false", "labelled", ["doc_id"], _LABELLED + "NOT NULL", quality__isnull=False)
_LINES = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 3"
_lookup("filter_and_single_call", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], _LINES, l_returnflag="R", l_quantity__lte=3)
_lookup("filter_nested_struct", "event", ["event_id", "event_type"], "SELECT event_id, event_type FROM events WHERE CAST(props->>'$.k' AS INT) >= 90", props__k__gte=90)
_lookup("filter_alias", "event", ["event_id"], "SELECT event_id FROM events WHERE event_type = 'click'", kind="click")
_lookup("filter_to_many", "talk", ["conv_id"], "SELECT DISTINCT conv_id FROM conversations WHERE lower(role) = 'system'", turns__role__iexact="SYSTEM")
_lookup("filter_to_many_same_element", "talk", ["conv_id"], "SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND turn >= 3", turns__role="user", turns__turn__gte=3)
_lookup("only_fields", "customer", ["c_custkey", "c_name"], "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0", c_acctbal__lt=0)


@query("filter_and_chained", _LINES)
def _(spark, d):
    return QuerySet(catalog(spark, d), "lineitem").filter(l_returnflag="R").filter(l_quantity__lte=3).only(["l_orderkey", "l_linenumber", "l_quantity"]).df


@query("filter_to_many_chained", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'system') > 0 AND max(turn) >= 3")
def _(spark, d):
    return QuerySet(catalog(spark, d), "talk").filter(turns__role="system").filter(turns__turn__gte=3).only("conv_id").df


@query("only_single", "SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    return QuerySet(catalog(spark, d), "customer").filter(c_mktsegment="BUILDING").only("c_name").df


@query("only_nested_collapses", "SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events")
def _(spark, d):
    return QuerySet(catalog(spark, d), "event").only(["event_id", "props__k"]).df.select("event_id", "props.*")


@query("nth_match", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget') ORDER BY p_partkey LIMIT 1 OFFSET 3")
def _(spark, d):
    return QuerySet(catalog(spark, d), "part").filter(p_name__icontains="widget").only(["p_partkey", "p_name"]).page(1, 3)


@query("first_match", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget') ORDER BY p_partkey LIMIT 1")
def _(spark, d):
    return QuerySet(catalog(spark, d), "part").filter(p_name__icontains="widget").only(["p_partkey", "p_name"]).page(1)


@query("head_five", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5")
def _(spark, d):
    return QuerySet(catalog(spark, d), "part").only(["p_partkey", "p_name"]).head()


@query("order_by_nested_top", "SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events ORDER BY k NULLS LAST, event_id LIMIT 20")
def _(spark, d):
    return QuerySet(catalog(spark, d), "event").order_by("props__k").only(["event_id", "props"]).page(20).select("event_id", "props.k")


@query("order_by_descending_top", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10")
def _(spark, d):
    return QuerySet(catalog(spark, d), "customer").order_by("-c_acctbal").only(["c_custkey", "c_acctbal"]).page(10)


@query("semi_join_in_list", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def _(spark, d):
    c = catalog(spark, d)
    nations = QuerySet(c, "nation").filter(n_regionkey=2).values("n_nationkey")
    return QuerySet(c, "customer").filter(c_nationkey__in=nations).only(["c_custkey", "c_name"]).df


_FIRST_PART = "(SELECT min(p_partkey) FROM part WHERE contains(lower(p_name), 'widget'))"


@query("lookup_then_filter", f"SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_partkey = {_FIRST_PART}")
def _(spark, d):
    c = catalog(spark, d)
    part = QuerySet(c, "part").filter(p_name__icontains="widget").first()
    return QuerySet(c, "lineitem").filter(l_partkey=part["p_partkey"] if part else None).only(["l_orderkey", "l_linenumber", "l_suppkey"]).df


@query("count_matches", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    return QuerySet(catalog(spark, d), "lineitem").filter(l_returnflag="R").df.agg(F.count("*").alias("n"))


@query("is_empty_flag", "SELECT count(*) = 0 AS is_empty FROM lineitem WHERE l_returnflag = 'no such flag'")
def _(spark, d):
    empty = QuerySet(catalog(spark, d), "lineitem").filter(l_returnflag="no such flag").is_empty()
    return spark.createDataFrame([(empty,)], "is_empty boolean")


@query("drop_missing", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def _(spark, d):
    return drop_missing(QuerySet(catalog(spark, d), "labelled").df, ["quality", "toxic"]).select("doc_id", "quality", "toxic")


@query("dedup_keep_first", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def _(spark, d):
    return keep_first(QuerySet(catalog(spark, d), "documents").only(["doc_id", "text", "lang"]).df, ["text"], ["doc_id"]).select("doc_id", "lang")


_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_FETCH = "FROM lineitem WHERE l_partkey = {part} AND {kind} AND l_suppkey IS NOT NULL AND l_extendedprice IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY {order}) = 1"


@query("activity_fetch", "SELECT l_orderkey, l_suppkey, l_returnflag, l_linestatus, l_extendedprice " + _FETCH.format(part=_FIRST_PART, kind="l_returnflag = 'R'", order=_ORDER))
def _(spark, d):
    return get_molecules_activity(catalog(spark, d), "widget", roles=ROLES).df


@query("activity_fetch_filters", f"SELECT {_ORDER.replace(', l_shipdate', '')} " + _FETCH.format(part=_FIRST_PART, kind="l_linestatus = 'O' AND l_quantity >= 5", order=_ORDER))
def _(spark, d):
    found = get_molecules_activity_with_filters(catalog(spark, d), {"target_pref_name": "widget", "l_linestatus": "O", "l_quantity__gte": 5}, roles=ROLES)
    return found.df.drop("l_shipdate")


@query("activity_target_only", "SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(p_name), 'widget')")
def _(spark, d):
    return get_molecules_activity_with_filters(catalog(spark, d), {"target_pref_name": "Widget"}, target_only=True, roles=ROLES).df.select("p_partkey", "p_name", "p_size")


@query("activity_errors", "SELECT * FROM (VALUES (1, 'No targets found for zzz'), (2, 'Missing required filter key: ''target_pref_name'''), (3, 'No activity data found for ''widget'' with given filters')) t(i, error)")
def _(spark, d):
    c = catalog(spark, d)
    found = [
        get_molecules_activity(c, "zzz", roles=ROLES),
        get_molecules_activity_with_filters(c, {"target_pref_name": ""}, roles=ROLES),
        get_molecules_activity_with_filters(c, {"target_pref_name": "widget", "l_returnflag": "none"}, roles=ROLES),
    ]
    return spark.createDataFrame([(i, r.error) for i, r in enumerate(found, 1)], "i int, error string")


@query("plan_execute", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(spark, d):
    plan = '{"resource": "orders", "o_orderstatus": "F", "o_totalprice__gte": 100000, "order_by": "-o_totalprice", "only": ["o_orderkey", "o_totalprice"], "limit": 50}'
    return compile_plan(catalog(spark, d), parse_plan(plan))


@query("plan_parse_errors", "SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, false), (6, false)) t(i, usable)")
def _(spark, d):
    c = catalog(spark, d)
    texts = [' {"resource": "part", "p_size__gte": 3}\n', "not json", "[1]", "null", '{"resource": "nowhere"}', '{"resource": "part", "p_size__near": 3}']
    return spark.createDataFrame([(i, "error" not in validate(c, parse_plan(t))) for i, t in enumerate(texts, 1)], "i int, usable boolean")


_ENVELOPES = ['{"activities": [{"id": 1}, {"id": 2}]}', '{"page_meta": {}, "molecules": [{"id": 3}]}', '{"others": [{"id": 4}]}', '{"activities": [], "molecules": [{"id": 5}]}']


@query("envelope_detect", "SELECT * FROM (VALUES (0, 'activities'), (1, 'molecules'), (2, NULL), (3, 'activities')) t(i, result_key)")
def _(spark, d):
    return spark.createDataFrame(list(enumerate(_ENVELOPES)), "i int, json string").select("i", result_key(F.col("json")).alias("result_key"))


@query("envelope_records", "SELECT * FROM (VALUES ('activities', 1), ('activities', 2), ('molecules', 3)) t(result_key, id)")
def _(spark, d):
    return records(spark.createDataFrame([(x,) for x in _ENVELOPES], "json string"), "json", "id int")


@query("envelope_catalog_keys", "SELECT * FROM (VALUES ('tissues', 1), ('drug_indications', 2), ('activities', 3)) t(result_key, id)")
def _(spark, d):
    texts = ['{"page_meta": {}, "tissues": [{"id": 1}]}', '{"drug_indications": [{"id": 2}]}', '{"tissues": [{"id": 9}], "activities": [{"id": 3}]}', '{"others": []}']
    return records(spark.createDataFrame([(x,) for x in texts], "json string"), "json", "id int", domain_catalog(spark, d).result_keys())


_PARENTS = ['[{"molecule": "a", "n": 1}, {"molecule": "b"}]', "[]", "no list", None]


@query("json_first_element", "SELECT * FROM (VALUES (0, 'a'), (1, NULL), (2, NULL), (3, NULL)) t(i, molecule)")
def _(spark, d):
    rows = spark.createDataFrame(list(enumerate(_PARENTS)), "i int, json string")
    return rows.select("i", chem.first_of_json(F.col("json"), "struct<molecule: string>")["molecule"].alias("molecule"))


@query("catalog_list", "SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in sorted([*KEYS, "event", "talk", "labelled"])) + ") t(name)")
def _(spark, d):
    return spark.createDataFrame([(n,) for n in catalog(spark, d).names()], "name string")


@query("domain_catalog_list", "SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in sorted(SCHEMAS)) + ") t(name)")
def _(spark, d):
    return spark.createDataFrame([(n,) for n in sorted(SCHEMAS)], "name string")


@query("full_scan", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return QuerySet(catalog(spark, d), "region").df.select("r_regionkey", "r_name")


@query("field_values", "SELECT s_suppkey FROM supplier WHERE s_nationkey = 3")
def _(spark, d):
    return QuerySet(catalog(spark, d), "supplier").filter(s_nationkey=3).values("s_suppkey")


@query("union_documents", "SELECT 'documents' AS origin, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'pages', page_id, length(html) FROM pages")
def _(spark, d):
    c = catalog(spark, d)
    of = lambda name, key, text: QuerySet(c, name).df.select(F.lit(name).alias("origin"), F.col(key).alias("id"), F.char_length(text).cast("long").alias("n"))
    return of("documents", "doc_id", "text").unionByName(of("pages", "page_id", "html"))


_WINDOWS = "SELECT doc_id, i::INT AS chunk_ix, substring(text, (i * 800 + 1)::INT, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 200) / 800.0)::INT))) AS i FROM documents)"


@query("chunk_fixed_window", _WINDOWS)
def _(spark, d):
    return fixed_windows(QuerySet(catalog(spark, d), "documents").df.select("doc_id", "text")).select("doc_id", "chunk_ix", "chunk")


@query("chunk_recursive")
def _(spark, d):
    return recursive_chunks(QuerySet(catalog(spark, d), "documents").df.select("doc_id", "text")).select("doc_id", "chunk_ix", "chunk")


@query("chunk_recursive_bounds", "SELECT doc_id, true AS short_enough, true AS in_text, true AS all_words FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r\\f\\v]')")
def _(spark, d):
    """What must hold of recursive chunks whatever the text: none is too long, each is a stretch of the text, and no
    word of a document is lost. A word longer than a chunk may be cut."""
    docs = QuerySet(catalog(spark, d), "documents").df.select("doc_id", "text")
    chunks = recursive_chunks(docs)
    of = chunks.groupBy("doc_id").agg(F.max(F.char_length("chunk")).alias("most"), F.min(F.contains("text", "chunk").cast("int")).alias("inside"), F.array_distinct(F.flatten(F.collect_list(F.split("chunk", r"\s+")))).alias("have"), F.first("text").alias("text"))
    words = F.filter(F.split("text", r"\s+"), lambda w: (w != "") & (F.char_length(w) < 1000))
    return of.select("doc_id", (F.col("most") <= 1000).alias("short_enough"), (F.col("inside") == 1).alias("in_text"), (F.size(F.array_except(words, "have")) == 0).alias("all_words"))


#: The questions of a search are all rows whose id is divisible by this.
EACH = 100


@query(
    "vector_topk_l2",
    "SELECT q.vec_id AS query_id, e.vec_id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 9) AS distance "
    f"FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % {EACH} = 0) q QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, e.vec_id) <= 5",
)
def _(spark, d):
    vectors = QuerySet(catalog(spark, d), "embeddings").df
    return nearest_of(vectors, vectors.where(f"vec_id % {EACH} = 0")).withColumn("distance", F.round("distance", 9))


_TERMS = """
WITH t AS (SELECT {key} AS id, unnest(regexp_split_to_array(lower({text}), '[^a-z0-9]+')) AS w FROM {table}),
f AS (SELECT id, w, count(*) AS n FROM t WHERE w <> '' GROUP BY id, w),
q AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM benchmark WHERE item_id % {each} = 0) WHERE w <> '' GROUP BY item_id, w),
o AS (SELECT item_id, sum(n * n) AS own FROM q GROUP BY item_id), s AS (SELECT id, sum(n * n)::BIGINT AS sq FROM f GROUP BY id),
x AS (SELECT item_id, id, sum(f.n * q.n)::BIGINT AS dot FROM f JOIN q ON f.w = q.w GROUP BY item_id, id),
top AS (SELECT item_id, id, dot / sqrt(sq * own) AS score FROM x JOIN s USING (id) JOIN o USING (item_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY dot / sqrt(sq * own) DESC, id) <= 5)
"""


def _asked(c: Catalog) -> DataFrame:
    return QuerySet(c, "benchmark").df.where(f"item_id % {EACH} = 0")


@query("text_topk_cosine", _TERMS.format(key="doc_id", text="text", table="documents", each=EACH) + "SELECT item_id, id AS doc_id, round(score, 9) AS score FROM top")
def _(spark, d):
    c = catalog(spark, d)
    found = alike_of(QuerySet(c, "documents").df, _asked(c))
    return found.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 9).alias("score"))


@query(
    "retrieve_context",
    f"WITH c AS ({_WINDOWS}), k AS (SELECT *, struct_pack(d := doc_id, c := chunk_ix) AS key FROM c), " + _TERMS.format(key="key", text="chunk", table="k", each=EACH).strip().removeprefix("WITH ")
    + " SELECT item_id, string_agg(chunk, chr(10) || chr(10) ORDER BY score DESC, id) AS content FROM top JOIN k ON k.key = top.id GROUP BY item_id",
)
def _(spark, d):
    c = catalog(spark, d)
    chunks = fixed_windows(QuerySet(c, "documents").df.select("doc_id", "text")).select("doc_id", "chunk_ix", "chunk")
    questions = _asked(c).withColumnRenamed("text", "chunk")
    found = alike_of(chunks, questions, text="chunk", keys=("doc_id", "chunk_ix")).join(chunks, ["doc_id", "chunk_ix"])
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "chunk_ix", "chunk")))  # five chunks
    return found.groupBy(F.col("query_id").alias("item_id")).agg(F.array_join(F.transform(ranked, lambda x: x["chunk"]), "\n\n").alias("content"))


_SETS = "SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS s FROM documents"
_ALIKE = "SELECT q.{key} AS query_id, d.{key} FROM d, (SELECT {key}, s FROM d WHERE {key} % {each} = 0) q WHERE len(list_intersect(d.s, q.s)) > 0 AND 100 * len(list_intersect(d.s, q.s)) >= {percent} * (len(d.s) + len(q.s) - len(list_intersect(d.s, q.s)))"


def _similar(spark, d, percent):
    sets = QuerySet(catalog(spark, d), "documents").df.select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("items"))
    return similar_of(sets, sets.where(f"doc_id % {EACH} = 0"), percent).select("query_id", "doc_id")


@query("set_similarity_threshold", f"WITH d AS ({_SETS}) " + _ALIKE.format(key="doc_id", each=EACH, percent=20))
def _(spark, d):
    return _similar(spark, d, 20)


@query("set_similarity_by_id", f"WITH d AS ({_SETS}) " + _ALIKE.format(key="doc_id", each=EACH, percent=70))
def _(spark, d):
    return _similar(spark, d, 70)


_BITS = "SELECT vec_id, list_filter(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN i END), lambda x: x IS NOT NULL) AS s FROM embeddings"


@query("similarity_fingerprints", f"WITH d AS ({_BITS}) " + _ALIKE.format(key="vec_id", each=EACH, percent=50))
def _(spark, d):
    """Signs of a vector's components as a fingerprint's bits."""
    bits = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i + 1)), lambda x: x.isNotNull())
    prints = QuerySet(catalog(spark, d), "embeddings").df.select("vec_id", bits.alias("items"))
    return similar_of(prints, prints.where(f"vec_id % {EACH} = 0"), 50, key="vec_id").select("query_id", "vec_id")


# Structures that the documentation uses as examples.
_SMILES = ["O=C(Oc1ccccc1C(=O)O)C", "[Na]OC(=O)Cc1ccc(C[NH3+])cc1.c1nnn[n-]1.O", r"CO[C@@H](CCC#C\C=C/CCCC(C)CCCCC=C)C(=O)[O-]"]


@query("smiles_heavy_atoms", "SELECT * FROM (VALUES (0, 13), (1, 19), (2, 23)) t(i, n)")
def _(spark, d):
    return spark.createDataFrame(list(enumerate(_SMILES)), "i int, smiles string").select("i", chem.heavy_atoms(F.col("smiles")).alias("n"))


@query("smiles_largest_fragment", "SELECT * FROM (VALUES (0, 'O=C(Oc1ccccc1C(=O)O)C'), (1, '[Na]OC(=O)Cc1ccc(C[NH3+])cc1')) t(i, parent)")
def _(spark, d):
    return spark.createDataFrame(list(enumerate(_SMILES[:2])), "i int, smiles string").select("i", chem.largest_fragment(F.col("smiles")).alias("parent"))


@query("context_ordered_join", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def _(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    return turns.groupBy("conv_id").agg(chem.concat_ordered("turn", "text", "\n\n").alias("content"))


_NOTEBOOK = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# Title\n", "text  "]}, {"cell_type": "code", "source": ["\n", " "]}, {"cell_type": "raw", "source": ["x"]}, {"cell_type": "code", "source": ["print(1)"]}]})


@query("notebook_cells", "SELECT * FROM (VALUES (0, '# Title' || chr(10) || 'text', 'markdown'), (3, 'print(1)', 'code')) t(cell_index, page_content, cell_type)")
def _(spark, d):
    files = spark.createDataFrame([("/a/b.ipynb", "b.ipynb", _NOTEBOOK)], "path string, file string, text string")
    return notebook_cells(files).select("cell_index", "page_content", F.col("metadata")["cell_type"].alias("cell_type"))
