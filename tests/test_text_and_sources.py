import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.functions import chem
from karst.functions.text import fixed_windows, recursive_pieces, with_run_lengths
from karst.sources.notebook import load_documents, notebook_cells, read_files
from karst.sources.rest import RestDataSource, execute_query


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(2, 40), st.data())
def test_recursive_pieces(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    pieces = recursive_pieces(text, size, overlap) if text else []
    assert all(p and p == p.strip() and len(p) <= size for p in pieces)
    assert set("".join(pieces)) - set(" \n") == set(text) - set(" \n")
    if overlap == 0:
        assert "".join("".join(pieces).split()) == "".join(text.split())


def test_fixed_windows(spark):
    df = spark.createDataFrame([(0, ""), (1, "x" * 200), (2, "ab" * 900)], "i int, text string")
    got = fixed_windows(df).groupBy("i").agg(F.count("*").alias("n"), F.max(F.length("chunk")).alias("m")).orderBy("i").collect()
    assert [(r.n, r.m) for r in got] == [(1, 0), (1, 200), (2, 1000)]


def test_run_lengths(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "w array<string>")
    assert [r.n for r in with_run_lengths(df, "w", "n").select("n").collect()] == [[1, 2], []]


def test_notebooks(spark, tmp_path):
    cells = [{"cell_type": "markdown", "source": "one text"}, {"cell_type": "code", "source": ["a\n", "b\n"]}]
    (tmp_path / "x.ipynb").write_text(json.dumps({"cells": cells}))
    (tmp_path / "y.txt").write_text("no notebook")
    found = notebook_cells(read_files(spark, str(tmp_path))).orderBy("cell_index").collect()
    assert [(r.page_content, r.metadata["cell_type"]) for r in found] == [("one text", "markdown"), ("a\nb", "code")]
    assert load_documents(spark, str(tmp_path)).count() == 1


class Service(BaseHTTPRequestHandler):
    asked: list[dict] = []
    rows = [{"target_chembl_id": f"T{i}", "standard_value": float(i)} for i in range(25)]

    def do_GET(self):
        parts = urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(parts.query).items()}
        Service.asked.append(q)
        if parts.path != "/activity.json":
            self.send_error(404)
            return
        at, n = int(q["offset"]), int(q["limit"])
        body = json.dumps({"page_meta": {"total_count": len(self.rows)}, "activities": self.rows[at : at + n]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


SCHEMA = T.StructType([T.StructField("target_chembl_id", T.StringType()), T.StructField("standard_value", T.DoubleType())])


def test_rest_source_follows_pages(spark, service):
    plan = {"standard_type": "IC50"}
    found = execute_query(spark, service, plan, SCHEMA, page_size=10)
    assert found.error is None and found.df.count() == 25 and plan == {"standard_type": "IC50"}
    assert all(q["standard_type"] == "IC50" for q in Service.asked)
    assert execute_query(spark, service, {"resource": "nowhere"}, SCHEMA).error
    assert execute_query(spark, service, {"error": "no plan"}, SCHEMA).error == "no plan"


def test_rest_source_sends_filters(spark, service):
    spark.dataSource.register(RestDataSource)
    df = spark.read.format("karst_rest").schema(SCHEMA).options(url=f"{service}/activity.json", pushdown="true", page_size="30").load()
    Service.asked.clear()
    assert df.where("standard_value >= 20").count() == 5
    assert any(q.get("standard_value__gte") == "20.0" for q in Service.asked)


def test_chemistry(spark):
    with pytest.raises(chem.ToolkitMissing):
        chem.apply(None, "smiles2ctab", F.col("s"))

    class Toolkit:
        def smiles2ctab(self, s):
            return f"ctab of {s}"

        def mcs(self, sdf):
            return sdf[:2]

    df = spark.createDataFrame([("g", 2, "CC"), ("g", 1, "NN"), ("g", 3, None)], "g string, o int, s string")
    assert [r.c for r in df.orderBy("o").select(chem.apply(Toolkit(), "smiles2ctab", F.col("s")).alias("c")).collect()] == ["ctab of NN", "ctab of CC", None]
    assert [r.mcs for r in chem.mcs(Toolkit(), df, "g", "s", "o").collect()] == ["NN"]
    bits = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], [])], "a array<int>, b array<int>")
    assert [r.t for r in bits.select(chem.tanimoto(F.col("a"), F.col("b")).alias("t")).collect()] == [0.5, None]
