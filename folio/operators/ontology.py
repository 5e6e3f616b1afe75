"""Reports on an ontology held as triples (s, p, o, lang): labels, class tree, schemes, property tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

# Name spaces and their short forms, the first that fits counts.
PREFIXES = [
    ("skos:", "http://www.w3.org/2004/02/skos/core#"),
    ("prov:", "http://www.w3.org/ns/prov#"),
    ("eli:", "http://data.europa.eu/eli/ontology#"),
    ("xsd:", "http://www.w3.org/2001/XMLSchema#"),
]
RDF, RDFS, OWL, SKOS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2004/02/skos/core#"
COMMENT_LENGTH = 160
PRIVATE = "private"


def shortened(iri: Column, own: tuple[str, str] | None = None) -> Column:
    """The iri with its name space in short; own is (prefix, name space) of the ontology itself."""
    return F.coalesce(*(F.when(F.startswith(iri, F.lit(space)), F.concat(F.lit(prefix), F.substr(iri, F.lit(len(space) + 1)))) for prefix, space in ([own] if own else []) + PREFIXES), iri)


def _chosen(triples: DataFrame, properties: list[str], name: str) -> DataFrame:
    """(s, name): of the literals the English one, else the French one, else the least of the others."""
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    return triples.where(F.col("p").isin(properties)).groupBy("s").agg(F.min_by("o", F.struct(rank, "o")).alias(name))


def labels(triples: DataFrame) -> DataFrame:
    return _chosen(triples, [f"{RDFS}label", f"{SKOS}prefLabel"], "label")


def comments(triples: DataFrame) -> DataFrame:
    """(s, comment) in English or French, on one line and without bars."""
    known = triples.where(F.col("lang").isin("en", "fr"))
    return _chosen(known, [f"{RDFS}comment"], "c").select("s", F.translate("c", "\n|", " /").alias("comment"))


def annotations(triples: DataFrame, own: tuple[str, str], annotation: str, name: str) -> DataFrame:
    """(s, name): the value of an annotation of the own name space; the least, where there are more."""
    return triples.where(F.col("p") == f"{own[1]}{annotation}").groupBy("s").agg(F.min("o").alias(name))


def classes(triples: DataFrame, space: str) -> DataFrame:
    return triples.where((F.col("p") == f"{RDF}type") & (F.col("o") == f"{OWL}Class") & F.startswith("s", F.lit(space))).select("s").distinct()


def class_tree(triples: DataFrame, space: str, own: tuple[str, str], most: int = 50) -> DataFrame:
    """(place, depth, name, label, node_label, private, outside): the classes of a name space below their parents, in order of place.

    A class with several parents is met below each; one whose parents all lie outside is a root. node_label is the label
    of its instances in the property graph (null without one), private says that they are in the private store alone,
    outside names its parents that are no classes of the name space.
    """
    known = classes(triples, space)
    parents = triples.where(F.col("p") == f"{RDFS}subClassOf").select("s", F.col("o").alias("above")).join(known, "s", "left_semi")
    edges = parents.join(known.select(F.col("s").alias("above")), "above", "left_semi").distinct()
    name = shortened(F.col("s"), own)
    level = known.join(edges, "s", "left_anti").select("s", F.lit(0).alias("depth"), F.array(name).alias("place"))
    found = level
    for depth in range(1, most + 1):
        up = level.select(F.col("s").alias("above"), "place")
        level = edges.join(up, "above").select("s", F.lit(depth).alias("depth"), F.array_append("place", name).alias("place"))
        level = cut(level)
        if level.isEmpty():
            break
        found = found.union(level)
    else:
        raise ValueError("the classes are deeper than the levels allowed, or have a loop")
    outside = parents.join(known.select(F.col("s").alias("above")), "above", "left_anti").groupBy("s").agg(F.array_join(F.array_sort(F.collect_set(shortened(F.col("above"), own))), ", ").alias("outside"))
    named = found.join(labels(triples), "s", "left").join(annotations(triples, own, "lpgLabel", "node_label"), "s", "left").join(annotations(triples, own, "storage", "storage"), "s", "left").join(outside, "s", "left")
    empty = F.lit("")
    return named.select(F.array_join("place", " > ").alias("place"), "depth", name.alias("name"), F.coalesce("label", empty).alias("label"), "node_label", F.coalesce(F.col("storage") == PRIVATE, F.lit(False)).alias("private"), F.coalesce("outside", empty).alias("outside"))


def schemes(triples: DataFrame, own: tuple[str, str], kinds: list[str]) -> DataFrame:
    """(scheme, concept, notation, label, note, rank): concepts of the schemes of some kinds, by notation and name; the note is the first of scope note, definition and example. A scheme without concepts is one row with a null concept."""
    of = triples.where((F.col("p") == f"{RDF}type") & F.col("o").isin(kinds)).select(F.col("s").alias("scheme")).distinct()
    members = of.join(triples.where(F.col("p") == f"{SKOS}inScheme").select("s", F.col("o").alias("scheme")).distinct(), "scheme", "left")
    one = lambda p, name: triples.where(F.col("p") == p).groupBy("s").agg(F.min("o").alias(name))
    full = members.join(labels(triples), "s", "left").join(one(f"{SKOS}notation", "notation"), "s", "left")
    notes = [f"{SKOS}scopeNote", f"{SKOS}definition", f"{SKOS}example"]
    for i, p in enumerate(notes):
        full = full.join(one(p, f"note{i}"), "s", "left")
    note = F.coalesce(*(f"note{i}" for i in range(len(notes))), F.lit(""))
    out = full.select(shortened(F.col("scheme"), own).alias("scheme"), shortened(F.col("s"), own).alias("concept"), F.coalesce("notation", F.lit("")).alias("notation"), F.coalesce("label", F.lit("")).alias("label"), note.alias("note"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("scheme").orderBy("notation", "concept")))


def property_table(triples: DataFrame, own: tuple[str, str], kind: str) -> DataFrame:
    """(name, domains, ranges, relationship, comment) of the properties of a kind (ObjectProperty, DatatypeProperty) of the own name space."""
    found = triples.where((F.col("p") == f"{RDF}type") & (F.col("o") == f"{OWL}{kind}") & F.startswith("s", F.lit(own[1]))).select("s").distinct()

    def ends(p: str, name: str) -> DataFrame:
        return triples.where(F.col("p") == p).groupBy("s").agg(F.array_join(F.array_sort(F.collect_set(shortened(F.col("o"), own))), ", ").alias(name))

    full = found.join(ends(f"{RDFS}domain", "domains"), "s", "left").join(ends(f"{RDFS}range", "ranges"), "s", "left").join(comments(triples), "s", "left").join(annotations(triples, own, "lpgRelationship", "relationship"), "s", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return full.select(shortened(F.col("s"), own).alias("name"), text("domains"), text("ranges"), text("relationship"), F.left(F.coalesce("comment", F.lit("")), F.lit(COMMENT_LENGTH)).alias("comment"))


def external_relationships(triples: DataFrame, own: tuple[str, str]) -> DataFrame:
    """(property, relationship) of properties outside of the own name space that a relationship of the property graph is named for."""
    found = triples.where((F.col("p") == f"{own[1]}lpgRelationship") & ~F.startswith("s", F.lit(own[1])))
    return found.select(shortened(F.col("s"), own).alias("property"), F.col("o").alias("relationship")).distinct()


def vertices(triples: DataFrame, own: tuple[str, str]) -> DataFrame:
    """(id, label, storage) of the property graph: the instances of classes that have a node label; storage is null where the class names none. An instance of two such classes has two rows."""
    kinds = annotations(triples, own, "lpgLabel", "label").join(annotations(triples, own, "storage", "storage"), "s", "left")
    return triples.where(F.col("p") == f"{RDF}type").select(F.col("s").alias("id"), F.col("o").alias("s")).join(kinds, "s").select("id", "label", "storage").distinct()


def edges(triples: DataFrame, own: tuple[str, str]) -> DataFrame:
    """(start, relationship, end) of the property graph: triples of properties with a relationship, between vertices."""
    kinds = annotations(triples, own, "lpgRelationship", "relationship").withColumnRenamed("s", "p")
    ids = vertices(triples, own).select("id").distinct()
    between = triples.join(kinds, "p").select(F.col("s").alias("start"), "relationship", F.col("o").alias("end")).distinct()
    return between.join(ids.withColumnRenamed("id", "start"), "start", "left_semi").join(ids.withColumnRenamed("id", "end"), "end", "left_semi").select("start", "relationship", "end")


def vertex_properties(triples: DataFrame, own: tuple[str, str]) -> DataFrame:
    """(id, name, value): values of properties that have a name in the property graph, of its vertices."""
    kinds = annotations(triples, own, "lpgProperty", "name").withColumnRenamed("s", "p")
    ids = vertices(triples, own).select(F.col("id").alias("s")).distinct()
    return triples.join(kinds, "p").join(ids, "s", "left_semi").select(F.col("s").alias("id"), "name", F.col("o").alias("value")).distinct()
