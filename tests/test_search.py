"""Searches with many questions, similarity and connectivity with a toolkit, images, envelopes of all entities."""

import pytest
from pyspark.sql import functions as F

from karst.operators.queryset import Client
from karst.operators.retrieval import HashedTerms, RetrievalSystem
from karst.operators.search import alike_of, nearest_of, similar_of
from karst.plans.catalog import Catalog, Entity
from karst.plans.compiler import PlanError, compile_plan
from karst.plans.planner import validate
from karst.sources.images import image, image_or_error


class Toolkit:
    """Stands in for chemistry: bits are letters, connectivity is the text without marks."""

    def fingerprint(self, smiles):
        return sorted({ord(c) for c in smiles})

    def connectivity_key(self, smiles):
        return smiles.replace("@", "").replace("/", "")


@pytest.fixture(scope="module")
def domain(spark):
    similar = spark.createDataFrame([("M1", "one", [1, 2, 3, 4]), ("M2", "two", [1, 2, 3]), ("M3", "three", [9]), ("M4", None, [67, 79]), ("M5", "five", None), ("M6", "six", [])], "molecule_chembl_id string, pref_name string, fingerprint array<int>")
    molecule = spark.createDataFrame([("M1", ("K", "C@H")), ("M2", ("K", "CH")), ("M3", (None, None)), ("M4", ("L", "CN"))], "molecule_chembl_id string, molecule_structures struct<standard_inchi_key: string, canonical_smiles: string>")
    images = spark.createDataFrame([("M1", "svg", bytearray(b"<svg/>")), ("M1", "png", bytearray(b"x"))], "molecule_chembl_id string, format string, content binary")
    alias = {"chembl_id": "molecule_chembl_id"}
    entities = [Entity("similarity", lambda s: similar, ("molecule_chembl_id",), "similarities", alias, "fingerprint"), Entity("molecule", lambda s: molecule, ("molecule_chembl_id",), "molecules", alias), Entity("image", lambda s: images, ("molecule_chembl_id", "format"), "images", alias)]
    return Catalog(spark, entities, Toolkit())


def test_similarity_resource(domain):
    found = Client(domain).similarity
    got = [(r.molecule_chembl_id, r.similarity) for r in found.filter(chembl_id="M1", similarity=70).df.collect()]
    assert got == [("M1", 100.0), ("M2", 75.0)]
    assert [r.molecule_chembl_id for r in found.filter(smiles="CO", similarity=70).df.collect()] == ["M4"]
    assert [r.molecule_chembl_id for r in found.filter(chembl_id="M1", similarity=70, pref_name="two").df.collect()] == ["M2"]
    for none in ("M5", "M6", "no such"):
        assert found.filter(chembl_id=none, similarity=1).count() == 0
    with pytest.raises(PlanError):
        found.filter(similarity=70)
    with pytest.raises(PlanError):
        Client(Catalog(domain.spark, list(domain.values()))).similarity.filter(smiles="CO", similarity=70)
    plan = {"resource": "similarity", "chembl_id": "M1", "similarity": 70}
    assert validate(domain, plan) == plan and compile_plan(domain, plan).count() == 2


def test_connectivity(domain):
    rows = Client(domain).molecule.filter(molecule_structures__canonical_smiles__connectivity="C/H").df.collect()
    assert [r.molecule_chembl_id for r in rows] == ["M1", "M2"]
    with pytest.raises(PlanError):
        Client(Catalog(domain.spark, list(domain.values()))).molecule.filter(molecule_structures__canonical_smiles__connectivity="CH")


def test_images(domain):
    assert image(domain, "M1") == b"<svg/>" and image(domain, "M1", "png") == b"x" and image(domain, "M9") is None
    assert image_or_error(domain, "M9").error == "No svg image of M9" and image_or_error(domain, "M1").df.count() == 1


def test_bad_patterns_are_plan_errors(domain):
    with pytest.raises(PlanError):
        Client(domain).image.filter(format__regex="(")


def test_nearest_of(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(40)] + [(100, None), (101, [1.0]), (102, [None, 1.0]), (None, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    import karst.operators.search as search

    asked = df.where("vec_id % 10 = 0 or vec_id in (101, 102)")
    whole = nearest_of(df.where("vec_id is not null"), asked, 3).collect()
    old, search.BLOCK = search.BLOCK, 2
    search.blocks.__defaults__ = (2,)
    try:
        assert sorted(nearest_of(df.where("vec_id is not null"), asked, 3).collect()) == sorted(whole)
    finally:
        search.BLOCK = old
        search.blocks.__defaults__ = (old,)
    good = [(i, v) for i, v in rows if i is not None and v and None not in v]
    for q in (0, 10, 20, 30, 101):
        v = dict(good)[q]
        wanted = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in good if len(w) == len(v))[:3]
        assert sorted((r.distance, r.vec_id) for r in whole if r.query_id == q) == wanted
    assert nearest_of(df, asked.where("false")).count() == 0


def test_alike_and_similar_of(spark):
    rows = [(1, "a b c"), (2, "a b c"), (3, "A  a"), (4, ""), (5, None), (6, "x y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = spark.createDataFrame([(0, "a b"), (100, "zzz"), (200, None)], "item_id int, text string")
    got = alike_of(df, asked, 2).orderBy("query_id", F.desc("score"), "doc_id").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(0, 1), (0, 2)] and got[0].score == pytest.approx(2 / 6**0.5)
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "b"]), (3, ["a", "c"]), (4, []), (5, None)], "doc_id bigint, items array<string>")
    got = {(r.query_id, r.doc_id, r.similarity) for r in similar_of(sets, sets, 33).collect()}
    assert got == {(a, b, 1.0 if {a, b} <= {1, 2} or a == b else 1 / 3) for a in (1, 2, 3) for b in (1, 2, 3)}


def test_ties_of_copies_are_settled(spark):
    """Equal chunks of different documents come in the order of their documents."""
    docs = spark.createDataFrame([(i, "the same words here") for i in range(9, 0, -1)], "doc_id bigint, page_content string").repartition(4)
    system = RetrievalSystem()
    system.process_documents(docs)
    assert [r.doc_id for r in system.query("same words", 3).results.collect()] == [1, 2, 3]
    both = spark.createDataFrame([("b a a",), ("",)], "t string").select(HashedTerms(8).embed(F.col("t")).alias("e")).collect()
    assert both[0].e == pytest.approx(HashedTerms(8).embed_query("a b A")) and both[1].e == [0.0] * 8
