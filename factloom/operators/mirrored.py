"""Properties and the types that mirror them, and mappers that carry them one way only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.shared import written
from factloom.operators.search import holding

#: How types that carry data and types that map them are named, and both directions.
CARRIER_ENDS, CARRIER_BEGIN = ("Dto", "Snapshot"), "Snapshot"
MAPPER_ENDS = ("Mapper", "Converter", "Serializer", "Translator", "Adapter")
DIRECTIONS = ("To", "From")


def _ends(name: Column, ends: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (name.endswith(e) for e in ends))


def siblings(starts: DataFrame, types: DataFrame, properties: DataFrame) -> DataFrame:
    """Properties of other types that mirror a given one (domain, property, carrier, mirror).

    ``starts``: type, property; ``types``: type, name, is_record;
    ``properties``: type, property, json_name.  A mirror is of a record or of
    a type named like a carrier of data, and has the same name, or the same
    name in JSON where both have one.
    """
    name = F.col("name")
    carriers = types.filter(F.col("is_record") | _ends(name, CARRIER_ENDS) | name.startswith(CARRIER_BEGIN)).select("type")
    theirs = properties.join(carriers, "type", "left_semi").select(F.col("type").alias("carrier"), F.col("property").alias("mirror"), F.col("json_name").alias("json"))
    own = properties.join(starts.select("type", "property").distinct(), ["type", "property"], "left_semi").select(F.col("type").alias("domain"), "property", "json_name")
    same = own.join(theirs, F.col("property") == F.col("mirror"))
    written_alike = own.join(theirs, F.col("json_name") == F.col("json"))
    return same.unionByName(written_alike).filter("domain <> carrier").select("domain", "property", "carrier", "mirror").distinct()


def one_sided(starts: DataFrame, types: DataFrame, properties: DataFrame, methods: DataFrame) -> DataFrame:
    """Mirrored properties that a mapper doesn't carry both ways (domain, property, carrier, mirror, present, missing).

    ``methods``: type, ord, name, signature, body, where ``ord`` orders the
    methods of a type.  A mapper is a type named like one, of which some
    signature holds the names of both types; the first of its methods, over all
    mappers of the two in order, whose name begins with a direction speaks for
    it, and carries the property if its text holds either name.  Without a
    mapper nothing is reported.  Names are found in signatures by q-grams, so
    methods and types are never paired.
    """
    pairs = written(siblings(starts, types, properties), "mirrored-pairs")
    names = types.select("type", "name").distinct()
    both = pairs.select("domain", "carrier").distinct()
    both = both.join(names.toDF("domain", "domain_name"), "domain").join(names.toDF("carrier", "carrier_name"), "carrier")
    mapper_types = types.filter(_ends(F.col("name"), MAPPER_ENDS)).select("type")
    own = written(methods.join(mapper_types, "type", "left_semi").select("type", "ord", "name", "signature", "body"), "mirrored-methods")
    terms = both.select(F.col("domain_name").alias("term")).union(both.select("carrier_name"))
    held = written(holding(own.select(F.struct("type", "ord").alias("id"), F.col("signature").alias("text")), terms), "mirrored-names")
    first, second = held.select(F.col("id").alias("m1"), F.col("term").alias("domain_name")), held.select(F.col("id").alias("m2"), F.col("term").alias("carrier_name"))
    maps = both.join(first, "domain_name").join(second, "carrier_name").filter("m1 = m2").select("domain", "carrier", F.col("m1.type").alias("type")).distinct()
    maps = written(maps, "mirrored-mappers")
    way = F.coalesce(*(F.when(F.col("name").startswith(d), d) for d in DIRECTIONS))
    speaks = maps.join(own.withColumn("way", way).filter("way is not null"), "type").groupBy("domain", "carrier", "way").agg(F.min(F.struct("type", "ord", "body")).alias("m"))
    carried = pairs.join(speaks, ["domain", "carrier"]).filter(F.col("m.body").contains(F.col("property")) | F.col("m.body").contains(F.col("mirror")))
    ways = carried.groupBy("domain", "property", "carrier", "mirror").agg(F.collect_set("way").alias("ways"))
    mapped = pairs.join(maps.select("domain", "carrier").distinct(), ["domain", "carrier"], "left_semi")
    out = mapped.join(ways, ["domain", "property", "carrier", "mirror"], "left")
    has = [F.coalesce(F.array_contains("ways", d), F.lit(False)) for d in DIRECTIONS]
    listed = [F.concat_ws(",", *(F.when(h if yes else ~h, d) for h, d in zip(has, DIRECTIONS))) for yes in (True, False)]
    return out.select("domain", "property", "carrier", "mirror", listed[0].alias("present"), listed[1].alias("missing")).filter("missing <> ''")
