"""Question in, rows out: retrieve documentation, plan, check the plan, run it, show count and first rows."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from karst.operators.fetch import Result
from karst.operators.retrieval import RetrievalSystem
from karst.plans.catalog import Catalog, domain_catalog
from karst.plans.compiler import PlanError, compile_plan
from karst.plans.planner import Planner, RulePlanner, validate
from karst.sources.notebook import load_documents


def answer(catalog: Catalog, planner: Planner, question: str, retrieval: RetrievalSystem | None = None) -> tuple[dict, Result]:
    """The plan and its result; a plan with an error isn't run."""
    context = retrieval.query(question).content if retrieval else ""
    plan = validate(catalog, planner.plan(question, context))
    if "error" in plan:
        return plan, Result(error=plan["error"])
    try:
        return plan, Result(compile_plan(catalog, plan))
    except PlanError as e:
        return plan, Result(error=str(e))


def show(result: Result) -> None:
    if result.error is not None:
        print("Error:", result.error)
    else:
        print(result.df.count())
        result.df.show(5, truncate=False)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="karst", description=__doc__)
    parser.add_argument("tables", help="folder of parquet tables, one an entity")
    parser.add_argument("question")
    parser.add_argument("--documents", help="folder of notebooks that describe the catalogue")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.appName("karst").getOrCreate()
    catalog = domain_catalog(spark, asked.tables)
    retrieval = None
    if asked.documents:
        retrieval = RetrievalSystem()
        retrieval.process_documents(load_documents(spark, asked.documents))
    plan, result = answer(catalog, RulePlanner(catalog), asked.question, retrieval)
    print("Plan:", plan)
    show(result)


if __name__ == "__main__":
    main()
