import pytest

from karst.cli import answer
from karst.operators.fetch import Result, get_molecules_activity, get_molecules_activity_with_filters, keep_first
from karst.operators.retrieval import HashedTerms, RetrievalSystem, set_similarity
from karst.plans.catalog import Catalog, Entity, schema_of
from karst.plans.planner import ModelPlanner, RulePlanner, parse_plan, prompt, validate


@pytest.fixture(scope="module")
def domain(spark):
    targets = spark.createDataFrame([("T2", "hERG two", ["x"], "human", "p"), ("T1", "HERG", None, "human", "p")], schema_of("target"))
    rows = [("T1", "M1", "CCO", "IC50", "nM", None, "B", None), ("T1", "M2", "CCO", "IC50", "nM", 5.0, "B", 7.0), ("T1", "M3", "CCO", "IC50", "nM", 6.0, "B", 7.0), ("T1", "M4", None, "IC50", "nM", 6.0, "B", 7.0), ("T1", "M5", "CCN", "Ki", "nM", float("nan"), "F", 1.0), ("T1", "M6", "CCN", "Ki", "nM", 2.0, "F", 1.0)]
    activities = spark.createDataFrame(rows, schema_of("activity"))
    return Catalog(spark, [Entity("target", lambda s: targets, ("target_chembl_id",), "targets"), Entity("activity", lambda s: activities, ("molecule_chembl_id",), "activities")])


def test_incomplete_rows_go_before_copies(domain):
    found = get_molecules_activity(domain, "herg")
    assert found.error is None and [r.molecule_chembl_id for r in found.df.collect()] == ["M2"]
    assert found.df.columns == ["molecule_chembl_id", "canonical_smiles", "standard_type", "standard_units", "standard_value"]


def test_selection_and_errors(domain):
    assert get_molecules_activity(domain, "nothing") == Result(error="No targets found for nothing")
    assert get_molecules_activity(domain, "herg", 2).error == "Invalid selection index 2. Only 2 targets found."
    assert get_molecules_activity(domain, "herg", -3).error == "Invalid selection index -3. Only 2 targets found."
    assert get_molecules_activity(domain, "herg", -1).error == "No IC50 data found for herg"
    asked = {"target_pref_name": "herg", "standard_type": "Ki", "target_chembl_id": "T9"}
    found = get_molecules_activity_with_filters(domain, asked)
    assert [r.molecule_chembl_id for r in found.df.collect()] == ["M6"] and asked["target_chembl_id"] == "T9" and len(asked) == 3
    assert get_molecules_activity_with_filters(domain, {"target_pref_name": "herg"}, target_only=True).df.count() == 2
    assert get_molecules_activity_with_filters(domain, {}).error == "Missing required filter key: 'target_pref_name'"
    assert get_molecules_activity_with_filters(domain, {"target_pref_name": "herg", "nope": 1}).error.startswith("Exception occurred while querying ChEMBL:")


def test_keep_first_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "a", 2), (2, "b", 9), (None, "c", 1), (None, "c", 0)], "k int, t string, o int")
    once = keep_first(df, ["k"], ["o"])
    assert sorted((r.k or 0, r.o) for r in once.collect()) == [(0, 0), (1, 2), (2, 9)]
    assert keep_first(once, ["k"], ["o"]).count() == 3


def test_parsing():
    assert parse_plan(' {"a": 1}\n') == {"a": 1}
    for text in ("x", "[1]", "null", "3", None):
        assert "error" in parse_plan(text)
    assert "activity" in prompt("q", "docs") and "docs" in prompt("q", "docs") and "docs" not in prompt("q")


def test_planners(domain):
    rules = RulePlanner(domain)
    assert rules.plan('targets named "hERG"') == {"resource": "target", "pref_name__icontains": "hERG"}
    assert rules.plan("first 3 activities with standard_value below 5.5 and standard_type = Ki") == {"resource": "activity", "standard_value__lt": 5.5, "standard_type": "Ki", "limit": 3}
    plan, result = answer(domain, rules, 'targets named "two"')
    assert result.df.count() == 1 and plan["resource"] == "target"
    told = []
    plan, result = answer(domain, ModelPlanner(lambda p: told.append(p) or "oops"), "anything")
    assert result.df is None and result.error.startswith("Failed to parse JSON") and "anything" in told[0]
    assert "error" in validate(domain, {"resource": "target", "nope": 1}) and "error" in validate(domain, {"resource": "zzz"})


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "targets are filtered by name and organism"), (2, "molecules have weights and structures"), (3, None)], "doc_id int, page_content string")
    system = RetrievalSystem(chunk_size=100, chunk_overlap=10)
    with pytest.raises(ValueError):
        system.query("x")
    with pytest.raises(ValueError):
        system.process_documents(docs.where("doc_id = 3"))
    system.process_documents(docs)
    found = system.query("weights of molecules", 1)
    assert found.content == "molecules have weights and structures" and found.results.count() == 1
    own = [r.e for r in docs.where("doc_id = 1").select(HashedTerms().embed(docs.page_content).alias("e")).collect()][0]
    assert own == pytest.approx(HashedTerms().embed_query("targets are filtered by name and organism"))


def test_set_similarity(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "c", "d"]), (3, ["z"]), (4, [])], "id int, items array<string>")
    assert sorted(r.id for r in set_similarity(df, ["a", "b", "c"], 75).collect()) == [1, 2]
    assert set_similarity(df.where("id = 4"), []).count() == 0
