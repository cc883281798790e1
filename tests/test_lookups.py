"""Truth tables of the lookups over awkward values, and what reaches the scan."""

import pytest
from pyspark.sql import functions as F

from karst.operators.queryset import Client, QuerySet
from karst.plans.catalog import Catalog, Entity, domain_catalog, schema_of
from karst.plans.compiler import PlanError, compile_plan, split_key

TEXTS = [None, "", "a%b", "a_b", "aXb", "a\\b", "Élan", "élan", "plain", "PLAIN text"]


@pytest.fixture(scope="module")
def words(spark):
    df = spark.createDataFrame([(i, t, float("nan") if i == 3 else float(i), i % 2 == 0) for i, t in enumerate(TEXTS)], "id int, t string, x double, flag boolean")
    return Catalog(spark, [Entity("word", lambda s: df, ("id",), "words", {"text": "t"})])


def ids(catalog, **filters):
    return sorted(r.id for r in QuerySet(catalog, "word").filter(**filters).df.collect())


@pytest.mark.parametrize(
    "filters, wanted",
    [
        ({"t": "a_b"}, [3]), ({"t": ""}, [1]), ({"t": None}, [0]), ({"t__exact": "plain"}, [8]), ({"text": "plain"}, [8]), ({"t__iexact": "PlAiN"}, [8]),
        ({"t__icontains": "A_B"}, [3]), ({"t__icontains": "%"}, [2]), ({"t__contains": "\\"}, [5]), ({"t__iexact": "ÉLAN"}, [6, 7]), ({"t__istartswith": "plain"}, [8, 9]), ({"t__startswith": "PL"}, [9]),
        ({"t__endswith": "b"}, [2, 3, 4, 5]), ({"t__iendswith": "TEXT"}, [9]), ({"t__in": []}, []), ({"t__in": ("plain", None)}, [8]), ({"t__isnull": True}, [0]), ({"t__isnull": "false"}, list(range(1, 10))),
        ({"t__regex": "^a.b$"}, [2, 3, 4, 5]), ({"t__iregex": "^PLAIN$"}, [8]), ({"id__range": (3, 5)}, [3, 4, 5]), ({"id__gt": 8}, [9]), ({"id__gte": "8"}, [8, 9]), ({"id__lt": 1}, [0]), ({"id__lte": 1}, [0, 1]),
        ({"flag": True}, [0, 2, 4, 6, 8]), ({"flag": "false"}, [1, 3, 5, 7, 9]), ({"t__icontains": ""}, list(range(1, 10))),
    ],
)
def test_truth(words, filters, wanted):
    assert ids(words, **filters) == wanted


@pytest.mark.parametrize("filters", [{"nope": 1}, {"t__near": 1}, {"id": "x"}, {"id__gt": None}, {"id__in": 3}, {"id__in": "12"}, {"id__range": [1]}, {"t__isnull": "maybe"}, {"t__connectivity": "C"}])
def test_refused(words, filters):
    with pytest.raises(PlanError):
        QuerySet(words, "word").filter(**filters)


def test_one_call_or_two(words):
    a = ids(words, t__istartswith="a", id__gte=3)
    b = sorted(r.id for r in QuerySet(words, "word").filter(t__istartswith="a").filter(id__gte=3).df.collect())
    assert a == b == [3, 4, 5]


def test_rows_in_order(words):
    q = QuerySet(words, "word").order_by("-t")
    assert q.nth(0).id == 7 and q.nth(-1).id == 0 and q.nth(99) is None and q.nth(-99) is None
    assert QuerySet(words, "word")[2].id == 2 and len(QuerySet(words, "word")) == 10
    assert [r.id for r in QuerySet(words, "word").only("id").page(2, 3).collect()] == [3, 4]
    assert QuerySet(words, "word").get(4).t == "aXb" and QuerySet(words, "word").filter(id=77).is_empty()
    with pytest.raises(IndexError):
        QuerySet(words, "word")[10]


def test_to_many(spark):
    rows = [(1, [("viagra", 1), ("x", 2)]), (2, [("Viagra", 2)]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "id int, names array<struct<name: string, rank: int>>")
    c = Catalog(spark, [Entity("m", lambda s: df, ("id",))])
    got = lambda q: sorted(r.id for r in q.df.collect())
    assert got(QuerySet(c, "m").filter(names__name__iexact="VIAGRA")) == [1, 2]
    assert got(QuerySet(c, "m").filter(names__name="viagra", names__rank=2)) == []
    assert got(QuerySet(c, "m").filter(names__name="viagra").filter(names__rank=2)) == [1]
    assert got(QuerySet(c, "m").filter(names__isnull=True)) == [4]


def test_key_grammar():
    schema = schema_of("molecule")
    assert split_key("molecule_properties__mw_freebase__lte", schema, {}) == (["molecule_properties", "mw_freebase"], "lte")
    assert split_key("molecule_synonyms__molecule_synonym", schema, {}) == (["molecule_synonyms", "molecule_synonym"], "exact")
    assert split_key("chembl_id__in", schema, {"chembl_id": "molecule_chembl_id"}) == (["molecule_chembl_id"], "in")


def test_domain_catalog(spark, tmp_path):
    rows = [("CHEMBL25", "ASPIRIN", 4, None, ("K", "O=C(Oc1ccccc1C(=O)O)C"), (180.2, 0, 1.3), [("Acetylsalicylic acid",)])]
    spark.createDataFrame(rows, schema_of("molecule")).write.parquet(f"{tmp_path}/molecule.parquet")
    molecule = Client(domain_catalog(spark, str(tmp_path))).molecule
    found = molecule.filter(molecule_properties__mw_freebase__lte=300, pref_name__iendswith="rin").only(["chembl_id", "molecule_properties__alogp", "molecule_properties"])
    assert found.df.columns == ["molecule_chembl_id", "molecule_properties"] and found.count() == 1
    assert molecule.filter(biotherapeutic__isnull=False).is_empty()
    assert "molecule" in dir(Client(domain_catalog(spark, str(tmp_path))))


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_what_reaches_the_scan(spark, tables):
    from karst.operators.retrieval import top_k_l2
    from karst.registry import QUERIES, catalog

    c = catalog(spark, tables)
    assert "EqualTo(l_partkey,3)" in plan_of(QuerySet(c, "lineitem").filter(l_partkey=3).df)
    assert "StringStartsWith(p_name,red)" in plan_of(QuerySet(c, "part").filter(p_name__startswith="red").df)
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan_of(QuerySet(c, "part").filter(p_name__icontains="x").only(["p_partkey", "p_name"]).df)
    assert "LeftSemi" in plan_of(QUERIES["semi_join_in_list"](spark, tables))
    assert "TakeOrderedAndProject" in plan_of(top_k_l2(QuerySet(c, "embeddings").df, [0.0] * 64))
    assert "WindowGroupLimit" in plan_of(QUERIES["vector_topk_l2"](spark, tables))
    assert "CartesianProduct" not in plan_of(QUERIES["text_topk_cosine"](spark, tables))


def test_plans(spark, tables):
    from karst.registry import catalog

    c = catalog(spark, tables)
    plan = {"resource": "part", "p_size__lte": "10", "order_by": "-p_size", "limit": 3}
    kept = dict(plan)
    assert compile_plan(c, plan).count() == 3 and plan == kept
    for bad in ([1], None, {"error": "x"}, {"resource": "nope"}, {"p_size": 1}, {"resource": "part", "limit": "many"}):
        with pytest.raises(PlanError):
            compile_plan(c, bad)
    assert compile_plan(c, {"resource": "region"}).count() == 5
    assert F is not None
