"""From a question to a plan: an interface for models, a rule-based default, a strict parser."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any, Protocol

from karst.plans.catalog import Catalog
from karst.plans.compiler import CONTROLS, DEFAULT_RESOURCE, PlanError, condition


class Planner(Protocol):
    def plan(self, question: str, context: str) -> Any: ...


def prompt(question: str, context: str = "") -> str:
    """What a language model is asked."""
    told = f"Documentation that may help:\n{context}\n\n" if context else ""
    return (
        f"{told}Turn the question below into filter parameters of the catalogue. Answer with one JSON object and nothing else: "
        f'a key "resource" (such as "activity" or "molecule") and keys of the form field__lookup.\n\nQuestion: "{question}"'
    )


def parse_plan(text: str) -> dict[str, Any]:
    """The object that a text is, or an error value."""
    try:
        found = json.loads(text.strip())
    except (json.JSONDecodeError, AttributeError) as e:
        return {"error": f"Failed to parse JSON: {e}"}
    return found if isinstance(found, dict) else {"error": f"Plan is not an object: {type(found).__name__}"}


def validate(catalog: Catalog, plan: Any) -> dict[str, Any]:
    """The plan itself, or an error value: an object without error, a known resource, known fields and lookups."""
    if not isinstance(plan, Mapping):
        return {"error": f"Plan is not an object: {type(plan).__name__}"}
    if "error" in plan:
        return {"error": str(plan["error"])}
    resource = plan.get("resource", DEFAULT_RESOURCE)
    if resource not in catalog:
        return {"error": f"Unknown resource: {resource}"}
    entity = catalog[resource]
    try:
        filters = {k: v for k, v in plan.items() if k not in CONTROLS}
        if entity.fingerprint and "similarity" in filters:  # what it asks about isn't a field
            filters = {k: v for k, v in filters.items() if k not in ("similarity", "smiles", *entity.aliases, entity.key[0])}
        condition(entity.read(catalog.spark), filters, entity.aliases, catalog.toolkit)
    except PlanError as e:
        return {"error": str(e)}
    return dict(plan)


class ModelPlanner:
    """Wraps a function from prompt to answer."""

    def __init__(self, ask):
        self.ask = ask

    def plan(self, question: str, context: str = "") -> dict[str, Any]:
        return parse_plan(self.ask(prompt(question, context)))


class RulePlanner:
    """Understands a few plain forms: a resource word, quoted or named values, comparisons with numbers, a limit."""

    _NAMED = re.compile(r"(?:named|called|name is)\s+(?:\"([^\"]+)\"|'([^']+)'|([\w-]+))", re.I)
    _COMPARED = re.compile(r"(\w+)\s+(?:is\s+)?(>=|<=|>|<|=|at least|at most|above|below|over|under|equals?)\s+(-?\d+(?:\.\d+)?|\"[^\"]+\"|[\w-]+)", re.I)
    _LIMIT = re.compile(r"\b(?:first|top)\s+(\d+)", re.I)
    _WORDS = {">=": "gte", "at least": "gte", "<=": "lte", "at most": "lte", ">": "gt", "above": "gt", "over": "gt", "<": "lt", "below": "lt", "under": "lt"}

    def __init__(self, catalog: Catalog, name_field: str = "pref_name"):
        self.catalog, self.name_field = catalog, name_field

    def plan(self, question: str, context: str = "") -> dict[str, Any]:
        low = question.lower()
        forms = {form: n for n in self.catalog.names() for form in (n, self.catalog[n].plural, n.replace("_", " "))}
        hit = [(low.find(f), -len(f), n) for f, n in forms.items() if f and re.search(rf"\b{re.escape(f)}\b", low)]
        plan: dict[str, Any] = {"resource": min(hit)[2] if hit else DEFAULT_RESOURCE}
        if plan["resource"] not in self.catalog:
            return {"error": f"Unknown resource: {plan['resource']}"}
        columns = self.catalog[plan["resource"]].read(self.catalog.spark).columns
        named = self._NAMED.search(question)
        if named and self.name_field in columns:
            plan[f"{self.name_field}__icontains"] = next(g for g in named.groups() if g)
        for name, how, value in self._COMPARED.findall(question):
            if name in columns:
                lookup = self._WORDS.get(how.lower(), "exact")
                value = value.strip('"')
                number = re.fullmatch(r"-?\d+(\.\d+)?", value)
                plan[name if lookup == "exact" else f"{name}__{lookup}"] = (float(value) if "." in value else int(value)) if number else value
        if limit := self._LIMIT.search(question):
            plan["limit"] = int(limit[1])
        return plan
