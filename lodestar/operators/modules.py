"""Module claims: requirements, exposed packages, providers and packages in several modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.duplicates import first_by
from lodestar.operators.hierarchy import supertype_walk
from lodestar.operators.linkage import PUBLIC, STATIC
from lodestar.operators.services import CONSTRUCTOR, instantiability_faults, legal_name
from lodestar.session import durable


def module_name() -> Column:
    return F.coalesce(F.col("descriptor.module_name"), F.when(legal_name(F.col("automatic_name")), F.col("automatic_name")))


def missing_requirements(claims: DataFrame, platform_modules: DataFrame) -> DataFrame:
    """(position, display, module, required): required names that no claim and no platform module has; ``java.base`` and static ones are exempt."""
    known = claims.select(module_name().alias("required")).where("required is not null").union(platform_modules.select("module")).distinct()
    asked = claims.where("descriptor is not null").select("position", "display", F.col("descriptor.module_name").alias("module"), F.explode("descriptor.required").alias("required"))
    return asked.where(F.col("required") != "java.base").distinct().join(known, "required", "left_anti")


def empty_exposed(claims: DataFrame, packages: DataFrame) -> DataFrame:
    """(position, display, module, package): exported or opened packages without a class in the same artifact. ``packages(position, package)``."""
    exposed = claims.where("descriptor is not null").select("position", "display", F.col("descriptor.module_name").alias("module"), F.explode("descriptor.exposed").alias("package"))
    return exposed.distinct().join(packages.select("position", "package").distinct(), ["position", "package"], "left_anti")


def missing_services(claims: DataFrame, declared: DataFrame) -> DataFrame:
    """(position, display, module, service): services that a module uses and nothing declares."""
    used = claims.where("descriptor is not null").select("position", "display", F.col("descriptor.module_name").alias("module"), F.explode("descriptor.uses").alias("service"))
    return used.distinct().join(declared.select(F.col("name").alias("service")).distinct(), "service", "left_anti")


def module_splits(claims: DataFrame, packages: DataFrame) -> DataFrame:
    """(package, modules, position): packages with classes in more than one artifact that can be a module."""
    able = claims.where("descriptor is not null or automatic_name is not null").select("position")
    held = packages.select("position", "package").where("package is not null").distinct().join(able, "position", "left_semi")
    return held.groupBy("package").agg(F.count("*").alias("modules"), F.min("position").alias("position")).where("modules > 1")


def illegal_automatic_names(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("automatic_name").isNotNull() & ~legal_name(F.col("automatic_name")))


def provider_faults(claims: DataFrame, types: DataFrame, own: DataFrame) -> DataFrame:
    """(position, display, module, service, provider, faults): providers of a module that cannot serve.

    ``own(position, internal_name, access, members)`` are the classes of each artifact, access null where a class could
    not be read. A provider outside its module has that fault alone, an unreadable one has none. Else it must not
    provably lack a service that is declared, be no interface, not abstract and public, and have a public constructor
    without arguments or a public static ``provider()`` whose result does not provably lack the service.
    """
    p = claims.where("descriptor is not null").select("position", "display", F.col("descriptor.module_name").alias("module"), F.explode("descriptor.provides").alias("p"))
    p = p.select("position", "display", "module", F.col("p.service").alias("service"), F.explode("p.providers").alias("provider")).distinct()
    mine = first_by(own.select("position", F.col("internal_name").alias("provider"), "access", "members"), ["position", "provider"], [F.col("access").isNull()])
    j = durable(p.join(mine.withColumn("__own", F.lit(True)), ["position", "provider"], "left"))
    makes = F.filter("members", lambda m: (m["name"] == "provider") & m["descriptor"].rlike(r"^\(\)L[^;]+;$") & (m["access"].bitwiseAND(PUBLIC | STATIC) == (PUBLIC | STATIC)))
    made = j.select("position", "provider", "service", F.explode(makes).alias("m")).select("position", "provider", "service", F.regexp_extract("m.descriptor", r"^\(\)L([^;]+);$", 1).alias("made"))
    walk = durable(supertype_walk(types, p.select(F.col("provider").alias("name")).union(made.select("made")))).select("start", "names", "resolved")
    lacks = F.coalesce(F.col("resolved") & ~F.array_contains("names", F.col("service")), F.lit(False))
    factory = made.join(walk, F.col("made") == F.col("start"), "left").groupBy("position", "provider", "service").agg(F.bool_or(~lacks).alias("__factory"))
    known = types.select(F.col("name").alias("service"), F.lit(True).alias("__service"))
    j = j.join(walk, F.col("provider") == F.col("start"), "left").join(known, "service", "left").join(factory, ["position", "provider", "service"], "left")
    none = F.array().cast("array<string>")
    entry = lambda x: (x != CONSTRUCTOR) | ~F.coalesce(F.col("__factory"), F.lit(False))
    inside = F.concat(F.when(lacks & F.col("__service").isNotNull(), F.array(F.lit("another type"))).otherwise(none), F.filter(instantiability_faults(F.col("access"), F.col("members")), entry))
    faults = F.when(F.col("__own").isNull(), F.array(F.lit("outside the module"))).when(F.col("access").isNotNull(), inside).otherwise(none)
    return j.withColumn("faults", faults).where(F.size("faults") > 0).select("position", "display", "module", "service", "provider", "faults")
