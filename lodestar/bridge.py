"""Fact relations from the star-schema tables, so that every relational operator can be run and checked without archives.

The mapping is synthetic: suppliers play artifacts, parts play classes, documents play provider files. What is tested this
way is the operators' relational behaviour; archives and class files have tests of their own. Some classes are left
undeclared on purpose, since the tables' own keys have no orphans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, display, origin, wildcard_source): a supplier each."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("int").alias("position"), F.col("s_name").alias("display"), F.when(F.col("s_suppkey") % 10 == 0, "APPLICATION").otherwise("CLASSPATH").alias("origin"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("w"), (F.col("s_suppkey") % 2).cast("string"))).alias("wildcard_source"))


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations without their entry: distinct (supplier, part) of all lines; parts of size above 45 stay undeclared."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).where("p_size <= 45")
    grouped = j.groupBy("l_suppkey", "l_partkey", "p_size", "p_brand").agg(F.max("l_linenumber").alias("line"), F.min(F.concat("l_returnflag", "l_linestatus")).alias("kind"))
    grouped = grouped.withColumn("kind", F.when(F.col("l_partkey") % 4 == 0, F.col("p_brand")).otherwise(F.col("kind")))
    package = F.when(F.col("p_size") == 1, F.lit(None)).otherwise(F.concat(F.lit("p/"), F.regexp_replace("p_brand", "#", "")))
    name = F.concat_ws("/", package, F.concat(F.lit("C"), F.col("l_partkey").cast("string")))
    return grouped.select(
        F.col("l_suppkey").cast("int").alias("position"), F.col("l_partkey").cast("int").alias("ordinal"), name.alias("internal_name"), package.alias("package"), F.sha2("kind", 256).alias("digest"),
        (F.lit(52) + F.col("line")).cast("int").alias("major"), F.when(F.col("l_partkey") % 17 == 0, 65535).otherwise(0).cast("int").alias("minor"), F.col("l_partkey").alias("part"),
    )


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared(spark, sf_dir).join(entries(spark, sf_dir), "position")


def order_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, major): orders as artifacts, their lines as classes."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("int").alias("position"), (F.lit(52) + F.col("l_linenumber")).cast("int").alias("major"))


def roots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as application entries, their urgent orders as classes, those in debt as faults of the scan."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("position"), F.col("c_name").alias("display"), F.lit("APPLICATION").alias("origin"), "c_acctbal")
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("int").alias("position"))
    return c.drop("c_acctbal"), o, c.where("c_acctbal < 0")


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, super, interfaces, access, members, from_platform, nest_host, nest_members): a part each.

    The superclass of part n is n / 3, of which some are undeclared; interfaces are n / 2 and n / 5 + 1 for every fourth.
    Members are derived from the part's attributes.
    """
    n = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("C"), c.cast("bigint").cast("string"))
    p = table(spark, sf_dir, "part").where("p_size <= 45")
    member = lambda nm, d, a: F.struct(nm.alias("name"), F.lit(d).alias("descriptor"), a.cast("int").alias("access"))
    flags = F.when(n % 5 == 0, 2).when(n % 5 == 1, 4).when(n % 5 == 2, 0).otherwise(1) + F.when(n % 2 == 0, 8).otherwise(0)
    members = F.array(member(F.concat(F.lit("m"), (n % 7).cast("string")), "()V", flags), member(F.concat(F.lit("f"), (n % 4).cast("string")), "I", flags))
    return p.select(
        name(n).alias("name"), F.when(n >= 3, name(F.floor(n / 3))).alias("super"), F.when(n % 4 == 0, F.array(name(F.floor(n / 2)), name(F.floor(n / 5) + 1))).otherwise(F.array().cast("array<string>")).alias("interfaces"),
        (F.when(n % 6 == 0, 0).otherwise(1) + F.when(n % 11 == 0, 512).otherwise(0)).cast("int").alias("access"), members.alias("members"), (n % 13 == 0).alias("from_platform"),
        F.when(n % 9 == 0, name(n + 1)).alias("nest_host"), F.when(n % 9 == 1, F.array(name(n - 1))).otherwise(F.array().cast("array<string>")).alias("nest_members"),
    )


def wanted_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("name"))


def owner_and_caller() -> tuple[Column, Column]:
    """(owner, caller) of an order line: a part, and one of 97 that follows from it."""
    return F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("owner"), F.concat(F.lit("C"), (F.col("l_partkey") % 97 + 1).cast("string")).alias("caller")


def member_refs(spark: SparkSession, sf_dir: str, by_owner: bool = False, named: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(ref, caller, caller_super, caller_host, kind, owner, name, descriptor): an order line each; ``by_owner`` deals them while they are narrow. ``named`` gives the types other names."""
    owner, caller = owner_and_caller()
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", named(owner).alias("owner"))
    li = (li.repartition("owner") if by_owner else li).distinct()
    kinds = F.array(*[F.lit(k) for k in ("INVOKE_VIRTUAL", "INVOKE_STATIC", "INVOKE_INTERFACE", "GET_STATIC", "GET_FIELD", "METHOD_HANDLE")])
    kind = F.element_at(kinds, (F.col("l_orderkey") % 6 + 1).cast("int"))
    above = F.concat(F.lit("C"), F.floor((F.col("l_partkey") % 97 + 1) / 3).cast("string"))
    method = ~kind.isin("GET_STATIC", "GET_FIELD")
    r = li.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("ref"), named(caller).alias("caller"), named(above).alias("caller_super"), named(caller).alias("caller_host"), kind.alias("kind"),
        "owner", F.when(method, F.concat(F.lit("m"), (F.col("l_orderkey") % 3).cast("string"))).otherwise(F.concat(F.lit("f"), (F.col("l_orderkey") % 3).cast("string"))).alias("name"), F.when(method, "()V").otherwise("I").alias("descriptor"),
    )
    return r


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): consecutive returned parts of one order."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    a, b = li.select("l_orderkey", F.col("l_linenumber").alias("__a"), F.col("l_partkey").alias("src")), li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("__a"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "__a"]).select("src", "dst").distinct()


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = entries(spark, sf_dir)
    return s.select("position", "display", (F.when(F.col("position") % 4 == 0, "").otherwise("g")).alias("group"), F.concat(F.lit("a"), (F.col("position") % 40).cast("string")).alias("artifact"), F.concat(F.lit("1."), (F.col("position") % 3).cast("string")).alias("version"))


def sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(display, package): suppliers in debt seal the packages of their classes."""
    debt = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("int").alias("position"))
    return classes(spark, sf_dir).join(debt, "position", "left_semi").where("package is not null").select("display", "package").distinct()


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, base_name, version, entry_name) from order lines."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber").distinct()
    v = F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_linenumber") + 7).cast("int")
    return li.select(F.col("l_suppkey").cast("int").alias("position"), F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("base_name"), v.alias("version"), F.concat(F.lit("v"), v.cast("string"), F.lit("/C"), F.col("l_partkey").cast("string")).alias("entry_name"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, severity, artifact, class_entry, subject, summary, position, ordinal, value) from events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("JP100"), (F.col("event_id") % 7 + 1).cast("string")).alias("code"), F.element_at(F.array(F.lit("INFO"), F.lit("WARNING"), F.lit("ERROR")), (F.col("user_id") % 3 + 1).cast("int")).alias("severity"),
        F.concat(F.lit("lib"), (F.col("user_id") % 20).cast("string"), F.lit(".jar")).alias("artifact"), F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("E"), (F.col("user_id") % 50).cast("string"))).alias("class_entry"),
        F.col("event_type").alias("subject"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("summary"), (F.col("event_id") % 100).cast("int").alias("position"), F.col("event_id").alias("ordinal"), "value",
    )
