"""Entities: where their rows are, what they are called, in which order "first" is meant."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from karst.functions.chem import ChemToolkit
from karst.sources.envelope import RESULT_KEYS


@dataclass(frozen=True)
class Entity:
    """An entity of a catalog. key orders its rows totally where possible; plural is its name in an envelope."""

    name: str
    read: Callable[[SparkSession], DataFrame]
    key: tuple[str, ...]
    plural: str = ""
    aliases: Mapping[str, str] = field(default_factory=dict)
    #: Column of fingerprint bits, if rows are asked for by similarity.
    fingerprint: str = ""


class Catalog(dict[str, Entity]):
    """name -> Entity"""

    def __init__(self, spark: SparkSession, entities: list[Entity], toolkit: ChemToolkit | None = None):
        super().__init__({e.name: e for e in entities})
        self.spark, self.toolkit = spark, toolkit

    def result_keys(self) -> tuple[str, ...]:
        """Keys under which responses hold rows: the fixed ones first, then the plurals of all other entities."""
        return tuple(dict.fromkeys([*RESULT_KEYS, *(self[n].plural for n in self.names() if self[n].plural)]))

    def names(self) -> list[str]:
        """Public names in order; those that begin with an underscore aren't listed."""
        return sorted(n for n in self if not n.startswith("_"))


# Fields of the domain's entities, in Spark's DDL.
SCHEMAS = {
    "target": "target_chembl_id STRING, pref_name STRING, target_synonym ARRAY<STRING>, organism STRING, target_type STRING",
    "activity": "target_chembl_id STRING, molecule_chembl_id STRING, canonical_smiles STRING, standard_type STRING, standard_units STRING, standard_value DOUBLE, assay_type STRING, pchembl_value DOUBLE",
    "molecule": "molecule_chembl_id STRING, pref_name STRING, max_phase INT, biotherapeutic STRUCT<description: STRING>, molecule_structures STRUCT<standard_inchi_key: STRING, canonical_smiles: STRING>, molecule_properties STRUCT<mw_freebase: DOUBLE, num_ro5_violations: INT, alogp: DOUBLE>, molecule_synonyms ARRAY<STRUCT<molecule_synonym: STRING>>",
    "drug_indication": "molecule_chembl_id STRING, efo_term STRING",
    "drug": "first_approval INT, usan_stem STRING",
    "assay": "assay_chembl_id STRING, description STRING, assay_type STRING",
    "tissue": "pref_name STRING, bto_id STRING, caloha_id STRING, uberon_id STRING",
    "cell_line": "cellosaurus_id STRING",
    "document": "pubmed_id LONG, year INT, doc_type STRING",
    "source": "src_id INT, src_description STRING",
    "image": "molecule_chembl_id STRING, format STRING, content BINARY",
    "similarity": "molecule_chembl_id STRING, pref_name STRING, fingerprint ARRAY<INT>",
}
PLURALS = {"activity": "activities", "molecule": "molecules", "target": "targets", "assay": "assays", "compound": "compounds"}
ALIASES = {"molecule": {"chembl_id": "molecule_chembl_id"}, "similarity": {"chembl_id": "molecule_chembl_id"}, "image": {"chembl_id": "molecule_chembl_id"}}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def domain_catalog(spark: SparkSession, folder: str, toolkit: ChemToolkit | None = None) -> Catalog:
    """The domain's entities over parquet tables of the same names in a folder, read with the schemas above."""

    def entity(name: str) -> Entity:
        schema = schema_of(name)
        key = tuple(f.name for f in schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.BinaryType)))
        return Entity(name, lambda s: s.read.schema(schema).parquet(f"{folder}/{name}.parquet"), key, PLURALS.get(name, f"{name}s"), ALIASES.get(name, {}), "fingerprint" if "fingerprint" in schema.names else "")

    return Catalog(spark, [entity(n) for n in SCHEMAS], toolkit)
