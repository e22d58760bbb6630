"""Models: objects of classes, with attributes, references and containment, queried step by step.

The metamodel is small metadata: classes with their supers and features. ``objects`` has ``id,
eclass`` and a column per attribute; ``links`` has ``src, dst, ref, pos``, and containment is the
reference ``CONTAINER`` from the child to its parent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from .graph import VALUE, VERTEX, Graph, Traversal

CONTAINER = "eContainer"
IN, OUT, BOTH = "in", "out", "both"


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str  # "attribute" or "reference"
    many: bool = False
    ordered: bool = False
    containment: bool = False


@dataclass(frozen=True)
class EClass:
    name: str
    package: str = ""
    supers: tuple[str, ...] = ()
    features: tuple[Feature, ...] = ()

    @property
    def qualified(self) -> str:
        return f"{self.package}::{self.name}" if self.package else self.name


@dataclass
class Metamodel:
    """Classes by qualified name; simple names work where they are unique."""

    classes: dict[str, EClass] = field(default_factory=dict)
    uris: dict[str, str] = field(default_factory=dict)

    def register(self, *classes: EClass, uri: str | None = None) -> None:
        for c in classes:
            self.classes[c.qualified] = c
            if uri is not None:
                self.uris[uri] = c.package

    def update(self, *classes: EClass, uri: str | None = None) -> None:
        """Replace the classes of packages that are registered: classes not given any more go."""
        packages = {c.package for c in classes}
        missing = packages - set(self.packages())
        if missing:
            raise KeyError(f"not registered: {sorted(missing)}")
        for p in packages:
            kept = {u: q for u, q in self.uris.items() if q == p}
            self.delete_package(p)
            self.uris |= kept
        self.register(*classes, uri=uri)

    def delete_package(self, package: str) -> None:
        self.classes = {k: c for k, c in self.classes.items() if c.package != package}
        self.uris = {u: p for u, p in self.uris.items() if p != package}

    def packages(self) -> list[str]:
        return sorted({c.package for c in self.classes.values()})

    def package_by_uri(self, uri: str) -> str | None:
        return self.uris.get(uri)

    def get(self, name: str) -> EClass:
        if name in self.classes:
            return self.classes[name]
        found = [c for c in self.classes.values() if c.name == name]
        if len(found) != 1:
            raise KeyError(f"{'no' if not found else 'more than one'} class is named {name!r}")
        return found[0]

    def with_subclasses(self, name: str) -> list[str]:
        """The class and all below it, as simple names."""
        base, out = self.get(name), []
        now = [base]
        while now:
            out += [c.name for c in now if c.name not in out]
            now = [c for c in self.classes.values() if any(self.get(s).name in {x.name for x in now} for s in c.supers)]
            now = [c for c in now if c.name not in out]
        return out

    def features(self, name: str) -> dict[str, Feature]:
        """Own and inherited features by name."""
        c, out = self.get(name), {}
        for s in c.supers:
            out |= self.features(s)
        return out | {f.name: f for f in c.features}

    def classes_with(self, feature: str) -> list[str]:
        return [c.name for c in self.classes.values() if feature in self.features(c.qualified)]


class Model:
    def __init__(self, metamodel: Metamodel, objects: DataFrame, links: DataFrame):
        self.metamodel, self.objects, self.links = metamodel, objects, links
        edges = links.select(
            F.concat_ws("|", "src", "ref", "dst", F.coalesce("pos", F.lit(-1)).cast("string")).alias("id"), F.col("ref").alias("label"),
            "src", "dst", "pos",
        )
        self.graph = Graph(objects.withColumn("label", F.col("eclass")), edges)

    def find(self) -> Starter:
        return Starter(self)


class Starter:
    def __init__(self, model: Model):
        self.model = model

    def from_all(self) -> Objects:
        return Objects(self.model, self.model.graph.V())

    def from_instances_of(self, name: str) -> Objects:
        """Instances of exactly that class."""
        rows = self.model.graph.vertices.filter(F.col("eclass") == self.model.metamodel.get(name).name)
        return Objects(self.model, self.model.graph.of(VERTEX, rows))

    def from_objects_with(self, attribute: str, value) -> Objects:
        return Objects(self.model, self.model.graph.of(VERTEX, self.model.graph.vertices.filter(F.col(attribute) == F.lit(value))))

    def from_objects(self, *ids: str) -> Objects:
        return Objects(self.model, self.model.graph.V(*ids))

    def from_rows(self, ids: DataFrame) -> Objects:
        return self._rows(ids)

    def _rows(self, rows: DataFrame) -> Objects:
        return Objects(self.model, Traversal(self.model.graph, VERTEX, rows.select(F.col("id").alias("it"))))


@dataclass(frozen=True)
class Objects:
    """A query whose current elements are objects or values."""

    model: Model
    t: Traversal

    def _new(self, t: Traversal) -> Objects:
        return Objects(self.model, t)

    # filters
    def has(self, feature: str, value) -> Objects:
        """Objects whose attribute has the value, or whose reference points to the object ``value``.

        Objects whose class has no such feature are left out.
        """
        kinds = {f.kind for c in self.model.metamodel.classes_with(feature) if (f := self.model.metamodel.features(c)[feature])}
        if not kinds:
            return self._new(self.t._with(self.t.state.limit(0)))
        if "reference" in kinds:
            return self._new(self.t.where(lambda x: x.out(feature).has_id(value)))
        return self._new(self.t.has(feature, value))

    def is_instance_of(self, name: str, allow_subclasses: bool = True) -> Objects:
        mm = self.model.metamodel
        names = mm.with_subclasses(name) if allow_subclasses else [mm.get(name).name]
        return self._new(self.t.has_label(*names))

    def not_null(self) -> Objects:
        return self._new(self.t._with(self.t.state.filter(F.col("it").isNotNull())))

    def filter(self, condition: Callable[[Column], Column], attribute: str | None = None) -> Objects:
        return self._new(self.t.filter(condition, attribute))

    def _sub(self, sub):
        return lambda t: sub(self._new(t)).t

    def and_(self, *subs) -> Objects:
        return self._new(self.t.and_(*[self._sub(s) for s in subs]))

    def or_(self, *subs) -> Objects:
        return self._new(self.t.or_(*[self._sub(s) for s in subs]))

    def not_(self, sub) -> Objects:
        return self._new(self.t.not_(self._sub(sub)))

    def where(self, sub) -> Objects:
        return self._new(self.t.where(self._sub(sub)))

    def except_(self, other: Objects) -> Objects:
        return self._new(self.t.except_(other.t))

    def except_named(self, name: str) -> Objects:
        return self._new(self.t.except_named(name))

    def named(self, name: str) -> Objects:
        return self._new(self.t.as_(name))

    def back(self, name: str) -> Objects:
        return self._new(self.t.select(name))

    def union(self, *subs) -> Objects:
        return self._new(self.t.union(*[self._sub(s) for s in subs]))

    # navigation
    def e_get(self, feature: str) -> Objects:
        """The attribute's values, one by one, or the objects that the reference points to."""
        mm = self.model.metamodel
        kinds = {mm.features(c)[feature].kind for c in mm.classes_with(feature)}
        if not kinds:
            raise KeyError(f"no class has the feature {feature!r}")
        return self._new(self.t.out(feature) if "reference" in kinds else self.t.values(feature))

    def e_get_ordered(self, reference: str) -> DataFrame:
        """``it, pos, target`` in order of place; an unset reference gives a null target."""
        links = self.model.links.filter(F.col("ref") == reference).select(F.col("src").alias("it"), "pos", F.col("dst").alias("target"))
        return self.t.rows.select("it").join(links, "it", "left").orderBy("it", "pos")

    def e_get_inverse(self, reference: str) -> Objects:
        return self._new(self.t.in_(reference))

    def e_container(self) -> Objects:
        return self._new(self.t.out(CONTAINER))

    def e_contents(self) -> Objects:
        return self._new(self.t.in_(CONTAINER))

    def e_all_contents(self) -> Objects:
        return self._new(self.t.closure(lambda x: x.in_(CONTAINER)))

    def all_referencing(self) -> Objects:
        """All objects with any link to the current ones."""
        return self._new(self.t.in_())

    def closure(self, reference: str, direction: str = OUT) -> Objects:
        step = {OUT: lambda x: x.out(reference), IN: lambda x: x.in_(reference), BOTH: lambda x: x.both(reference)}[direction]
        return self._new(self.t.closure(step).dedup())

    # values
    def map(self, f: Callable[[Column], Column]) -> Objects:
        return self._new(self.t.map(f))

    def flat_map(self, f: Callable[[Column], Column]) -> Objects:
        return self._new(self.t.flat_map(f))

    def as_number(self, kind: str) -> Objects:
        """Numbers as another kind; what is no number goes."""
        numeric = self.t.rows.schema["it"].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")
        if not numeric:
            return self._new(self.t._with(self.t.rows.limit(0).withColumn("it", F.lit(None).cast("int" if kind == "integer" else kind if kind != "byte" else "tinyint")), VALUE))
        rows = self.t.rows.filter(F.col("it").isNotNull()).withColumn("it", numbers.as_number(F.col("it"), kind))
        return self._new(self.t._with(rows, VALUE))

    def as_boolean(self) -> Objects:
        return self._typed("boolean")

    def as_character(self) -> Objects:
        got = self._typed("string")
        return got._new(got.t._with(got.t.rows.filter(F.length("it") == 1)))

    def _typed(self, name: str) -> Objects:
        rows = self.t.rows
        ok = rows.schema["it"].dataType.typeName() == name
        return self._new(self.t._with(rows.filter(F.col("it").isNotNull()) if ok else rows.limit(0), VALUE))

    def as_e_object(self) -> Objects:
        """Values that are ids of objects, as those objects; others go."""
        ids = self.model.objects.select(F.col("id").alias("it"))
        return self._new(self.t._with(self.t.rows.join(ids, "it", "left_semi"), VERTEX))

    def round(self) -> Objects:
        return self.map(numbers.round_half_up)

    def floor(self) -> Objects:
        return self.map(lambda c: F.floor(c).cast("long"))

    def ceil(self) -> Objects:
        return self.map(lambda c: F.ceil(c).cast("long"))

    # order, ends
    def order_by(self, attribute: str, descending: bool = False) -> DataFrame:
        """Objects by an attribute: missing values first ascending, last descending."""
        return self.t.order_by((attribute, descending, not descending))

    def limit(self, n: int) -> Objects:
        return self._new(self.t.limit(n))

    def distinct(self) -> Objects:
        return self._new(self.t.dedup())

    def count(self) -> DataFrame:
        return self.t.count()

    def sum_as_double(self) -> DataFrame:
        return self.t.rows.agg(F.sum(F.col("it").cast("double")).alias("result"))

    def sum_as_long(self) -> DataFrame:
        return self.t.rows.agg(numbers.sum_as_long(F.col("it")).alias("result"))

    def average(self) -> DataFrame:
        return self.t.rows.agg(numbers.mean_over_all(F.col("it")).alias("result"))

    def min_as_double(self) -> DataFrame:
        return self.t.rows.agg(F.min(F.col("it").cast("double")).alias("result"))

    def max_as_double(self) -> DataFrame:
        return self.t.rows.agg(F.max(F.col("it").cast("double")).alias("result"))

    def min_as_long(self) -> DataFrame:
        return self.t.rows.agg(F.min(numbers.as_number(F.col("it"), "long")).alias("result"))

    def max_as_long(self) -> DataFrame:
        return self.t.rows.agg(F.max(numbers.as_number(F.col("it"), "long")).alias("result"))

    def to_df(self, name: str = "id") -> DataFrame:
        return self.t.rows.select(F.col("it").alias(name))

    def to_set(self, name: str = "id") -> DataFrame:
        return self.to_df(name).distinct()


def evolve(
    old: Model, metamodel: Metamodel, classify: Callable[[], Column], attributes: Callable[[DataFrame], DataFrame] = lambda d: d,
    references: Callable[[DataFrame], DataFrame] = lambda d: d,
) -> Model:
    """A model of a new metamodel in three phases: class, attributes, references.

    ``classify`` gives each object's new class, or null to drop it; links of dropped objects go.
    """
    objects = old.objects.withColumn("eclass", classify()).filter(F.col("eclass").isNotNull())
    known = [c.name for c in metamodel.classes.values()]
    bad = F.raise_error(F.concat(F.lit("no such class: "), F.col("eclass"))).cast("string")
    objects = objects.withColumn("eclass", F.when(F.col("eclass").isin(known), F.col("eclass")).otherwise(bad))
    objects = attributes(objects)
    ids = objects.select("id")
    links = references(old.links)
    for end in ("src", "dst"):
        links = links.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return Model(metamodel, objects, links.select("src", "dst", "ref", "pos"))


def delete_cascade(model: Model, ids: DataFrame) -> Model:
    """Objects go with all they contain, and every link that touches them."""
    start = model.find().from_rows(ids)
    gone = ids.select("id").unionByName(start.e_all_contents().to_df()).distinct()
    links = model.links
    for end in ("src", "dst"):
        links = links.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return Model(model.metamodel, model.objects.join(gone, "id", "left_anti"), links.select("src", "dst", "ref", "pos"))


def attach(model: Model, objects: DataFrame, links: DataFrame) -> Model:
    """Objects come, or replace those of their id, and links come beside those that are there.

    A class that is not registered, and a link with an end that is not there, are errors when the
    result is read.
    """
    known = [c.name for c in model.metamodel.classes.values()]
    bad = F.raise_error(F.concat(F.lit("no such class: "), F.col("eclass"))).cast("string")
    new = objects.withColumn("eclass", F.when(F.col("eclass").isin(known), F.col("eclass")).otherwise(bad))
    kept = model.objects.join(objects.select("id"), "id", "left_anti")
    all_objects = kept.unionByName(new, allowMissingColumns=True).select(*model.objects.columns)
    ids = all_objects.select("id")
    for end in ("src", "dst"):
        links = links.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
    wrong = F.raise_error(F.concat(F.lit("a link's end is missing: "), F.col("src"), F.lit(" "), F.col("dst"))).cast("string")
    there = F.col("__src").isNotNull() & F.col("__dst").isNotNull()
    links = links.withColumn("ref", F.when(there, F.col("ref")).otherwise(wrong)).select("src", "dst", "ref", "pos")
    return Model(model.metamodel, all_objects, model.links.select("src", "dst", "ref", "pos").unionByName(links).distinct())
