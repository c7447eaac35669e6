"""Declared fields of an application, from dicts, JSON or tab-separated text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {
    1: ("int", T.IntegerType()), 2: ("string", T.StringType()), 3: ("text", T.StringType()), 4: ("ip", T.StringType()),
    5: ("geo_point", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])),
    9: ("double", T.DoubleType()), 10: ("long", T.LongType()), 11: ("union", T.StringType()),
    14: ("geo_shape", T.ArrayType(T.StructType([T.StructField("lng", T.DoubleType()), T.StructField("lat", T.DoubleType())]))),
}
BY_NAME = {name: (k, t) for k, (name, t) in KINDS.items()}
ANALYZERS = {0: "keyword", 1: "word", 2: "ngram", 3: "pinyin", 4: "letters", 5: "keyword"}


class SpecError(ValueError):
    """A field or an application that is not declared as it must be."""


@dataclass(frozen=True)
class FieldSpec:
    name: str
    kind: str
    indexed: bool = True
    stored: bool = True
    analyzer: str = "keyword"
    anywhere: bool = False
    members: tuple[str, ...] = ()

    @property
    def type(self) -> T.DataType:
        return BY_NAME[self.kind][1]


@dataclass(frozen=True)
class IndexSpec:
    app: int
    key: str
    fields: dict[str, FieldSpec] = field(default_factory=dict)

    @classmethod
    def of(cls, app: int, key: str, fields: Iterable[FieldSpec]) -> IndexSpec:
        made = {}
        for f in fields:
            if f.kind not in BY_NAME:
                raise SpecError(f"{f.name}: no kind {f.kind}")
            if f.kind in ("string", "text") and f.indexed and f.analyzer not in ("keyword", "word", "pinyin", "letters", "ngram"):
                raise SpecError(f"{f.name}: no analyzer {f.analyzer}")
            made[f.name] = f
        return cls(app, key, made)

    def __getitem__(self, name: str) -> FieldSpec:
        try:
            return self.fields[name]
        except KeyError:
            raise SpecError(f"application {self.app} has no field {name}") from None

    def struct(self) -> T.StructType:
        """The documents' type; what is stored keeps its declaration as metadata."""
        return T.StructType([T.StructField(f.name, f.type, metadata={"indexed": f.indexed, "stored": f.stored, "analyzer": f.analyzer}) for f in self.fields.values() if f.kind != "union"])

    def with_field(self, f: FieldSpec) -> IndexSpec:
        """Adds a column while in use; old rows read it as null."""
        return replace(self, fields=self.fields | {f.name: f})


TSV = "row long, app int, name string, is_key int, kind int, indexed int, stored int, segment int, field_id int, created string, feature int, members string"


def read_tsv(spark: SparkSession, path: str) -> dict[int, IndexSpec]:
    return specs(spark.read.csv(path, sep="\t", schema=TSV))


def read_json(spark: SparkSession, path: str, array: str) -> dict[int, IndexSpec]:
    """A JSON document whose `array` holds one object for each field."""
    rows = spark.read.json(path, multiLine=True).select(F.explode(array).alias("f")).select("f.*")
    wanted = T.StructType.fromDDL(TSV)
    return specs(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]))


def specs(rows: DataFrame) -> dict[int, IndexSpec]:
    """One spec for each application of a table of field definitions (a few rows each)."""
    found: dict[int, list] = {}
    for r in rows.where("app is not null and name is not null").orderBy("app", "field_id", "row").collect():
        found.setdefault(r["app"], []).append(r)
    out = {}
    for app, fields in found.items():
        names = {r["field_id"]: r["name"] for r in fields}
        key = next((r["name"] for r in fields if r["is_key"]), "doc_id")
        made = [
            FieldSpec(r["name"], KINDS[r["kind"]][0], bool(r["indexed"]), bool(r["stored"]), ANALYZERS.get(r["segment"] or 0, "?"), r["feature"] == 1, tuple(names[int(m)] for m in (r["members"] or "").split(",") if m.strip().isdigit() and int(m) in names))
            for r in fields
            if r["kind"] in KINDS
        ]
        out[app] = IndexSpec.of(app, key, made)
    return out
