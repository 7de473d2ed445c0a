"""Platform classes: a symbol table in text, a JDK's ct.sym, or a JDK's jmods."""

from __future__ import annotations

import gzip
import hashlib
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import schema
from lodestar.session import as_arrow, mapped
from lodestar.sources.classfile import ACC_PROTECTED, ACC_PUBLIC, MalformedClass, parse
from lodestar.sources.classpath import RefusedRun

MAGIC = "#lodestar-platform-symbols"
FORMAT = "1"


def shape_of(data: bytes, api_only: bool = False) -> dict:
    """A platform class by its shape alone: members by name and descriptor, nest members sorted, 16-bit flags."""
    f = parse(data, references=False)
    members = sorted((n, d, a & 0xFFFF) for n, d, a in f.members if not api_only or a & (ACC_PUBLIC | ACC_PROTECTED))
    return {"internal_name": f.internal_name, "access": f.access & 0xFFFF, "super": f.super, "interfaces": f.interfaces, "nest_host": f.nest_host, "nest_members": sorted(f.nest_members), "members": [{"name": n, "descriptor": d, "access": a} for n, d, a in members]}


def encode_line(module: str, s: dict) -> str:
    """One class in the text table: seven fields, then name, descriptor and hexadecimal flags of each member."""
    head = [s["internal_name"], module, f"{s['access']:x}", s["super"] or "", ",".join(s["interfaces"]), s["nest_host"] or "", ",".join(s["nest_members"])]
    return "\t".join(head + [x for m in s["members"] for x in (m["name"], m["descriptor"], f"{m['access']:x}")])


def write_table(path: str, release: int, runtime: str, rows: list[tuple[str, dict]]) -> None:
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("\t".join([MAGIC, FORMAT, str(release), str(len(rows)), runtime]) + "\n")
        f.writelines(encode_line(m, s) + "\n" for m, s in sorted(rows, key=lambda r: r[1]["internal_name"]))


def write_table_parts(shapes: DataFrame, folder: str, release: int, runtime: str) -> None:
    """The same table as a folder of compressed parts that tasks write, from ``schema.PLATFORM_CLASS`` rows; ``read_table`` reads either."""
    number = lambda c: F.lower(F.hex(c))
    plain = lambda c: F.coalesce(c, F.lit(""))
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",")
    s = F.col("shape")
    members = F.transform(s["members"], lambda m: F.concat_ws("\t", m["name"], m["descriptor"], number(m["access"])))
    head = F.concat_ws("\t", s["internal_name"], plain(F.col("module")), number(s["access"]), plain(s["super"]), listed(s["interfaces"]), plain(s["nest_host"]), listed(s["nest_members"]))
    lines = shapes.select(F.when(F.size(members) > 0, F.concat(head, F.lit("\t"), F.array_join(members, "\t"))).otherwise(head).alias("value"))
    first = shapes.agg(F.count("*").alias("n")).select(F.concat_ws("\t", F.lit(MAGIC), F.lit(FORMAT), F.lit(str(release)), F.col("n").cast("string"), F.lit(runtime)).alias("value"))
    first.union(lines.repartitionByRange("value").sortWithinPartitions("value")).write.mode("overwrite").option("compression", "gzip").text(folder)


def table_of(folder_or_table: str, release: int) -> str:
    """The table of a release: ``N.gz`` of a folder of tables, else the table that is named."""
    return os.path.join(folder_or_table, f"{release}.gz") if os.path.isdir(folder_or_table) else folder_or_table


def make_table(spark: SparkSession, folder: str, release: int, home: str) -> str:
    """Write a JDK's symbols of a release as ``N.gz`` of a folder; a platform's classes are few, so the driver writes them."""
    rows = [(r["module"], r["shape"].asDict(True)) for r in platform_classes(spark, release, home).collect()]
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{release}.gz")
    write_table(path, release, os.path.basename(os.path.normpath(home)), rows)
    return path


def read_table(spark: SparkSession, path: str, release: int) -> DataFrame:
    """``schema.PLATFORM_CLASS`` rows of a text table; its header must name the release and the number of classes."""
    lines = spark.read.text(path)
    header = lines.where(F.col("value").startswith(MAGIC)).limit(2).collect()
    fields = header[0]["value"].split("\t") if len(header) == 1 else []
    if len(fields) != 5 or fields[1] != FORMAT or not fields[2].isdigit() or not fields[3].isdigit() or int(fields[2]) != release or not fields[4].strip():
        raise RefusedRun(f"{path} holds no platform symbols for release {release}")
    p = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith(MAGIC)).select(p.alias("p"))
    bad = rows.where((F.size("p") < 7) | ((F.size("p") - 7) % 3 != 0))
    if rows.count() != int(fields[3]) or not bad.isEmpty():
        raise RefusedRun(f"{path} does not hold the {fields[3]} classes that it announces")
    some = lambda i: F.nullif(F.col("p")[i], F.lit(""))
    listed = lambda i: F.when(F.col("p")[i] == "", F.array().cast("array<string>")).otherwise(F.split(F.col("p")[i], ","))
    number = lambda c: F.conv(c, 16, 10).cast("int")
    starts = F.when(F.size("p") > 7, F.sequence(F.lit(7), F.size("p") - 1, F.lit(3))).otherwise(F.array().cast("array<int>"))
    members = F.transform(starts, lambda i: F.struct(F.get("p", i).alias("name"), F.get("p", i + 1).alias("descriptor"), number(F.get("p", i + 2)).alias("access")))
    shape = F.struct(F.col("p")[0].alias("internal_name"), number(F.col("p")[2]).alias("access"), some(3).alias("super"), listed(4).alias("interfaces"), some(5).alias("nest_host"), listed(6).alias("nest_members"), members.alias("members"))
    return rows.select(F.col("p")[0].alias("internal_name"), F.col("p")[1].alias("module"), shape.alias("shape"))


def release_code(release: int) -> str:
    if not 8 <= release <= 35:
        raise RefusedRun(f"ct.sym has no code for release {release}")
    return str(release) if release < 10 else chr(ord("A") + release - 10)


def ct_sym_entries(path: str, release: int) -> list[str]:
    """Signature entries of one release: folders named by the releases that share them, then module, then class."""
    code = release_code(release)
    with zipfile.ZipFile(path) as z:
        names = [n for n in z.namelist() if n.endswith(".sig") and not n.endswith("/module-info.sig") and n.count("/") >= 2]
    found = sorted(n for n in names if code in n.partition("/")[0])
    if not found:
        raise RefusedRun(f"{path} has no signatures for release {release}; it covers {sorted({c for n in names for c in n.partition('/')[0]})}")
    return found


def _zip_shapes(spark: SparkSession, parts: list[tuple[str, str, str]], api_only: bool) -> DataFrame:
    """Shapes of (archive, entry, module) rows; archives are opened in the tasks."""
    wanted = pa.schema(as_arrow(schema.PLATFORM_CLASS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, opened = [], {}
            for archive, entry, module in zip(*(batch.column(c).to_pylist() for c in ("archive", "entry", "module"))):
                if archive not in opened:
                    opened[archive] = zipfile.ZipFile(archive)
                try:
                    s = shape_of(opened[archive].read(entry), api_only)
                except MalformedClass:
                    continue
                if not api_only or s["access"] & ACC_PUBLIC:
                    out.append({"internal_name": s["internal_name"], "module": module, "shape": s})
            yield pa.RecordBatch.from_pylist(out, wanted)

    rows = spark.createDataFrame(parts, "archive string, entry string, module string")
    return mapped(rows.repartition(max(1, min(64, len(parts) // 500 + 1))), run, schema.PLATFORM_CLASS)


def read_ct_sym(spark: SparkSession, path: str, release: int) -> DataFrame:
    return _zip_shapes(spark, [(path, n, n.split("/")[1]) for n in ct_sym_entries(path, release)], False)


def read_jmods(spark: SparkSession, home: str) -> DataFrame:
    """Public classes of exported packages, with public and protected members, of a JDK's own release."""
    parts = []
    for name in sorted(os.listdir(os.path.join(home, "jmods"))):
        if name.endswith(".jmod"):
            path = os.path.join(home, "jmods", name)
            with zipfile.ZipFile(path) as z:
                exposed = set((parse(z.read("classes/module-info.class"), False).module or {}).get("exposed", ()))
                parts += [(path, n, name[: -len(".jmod")]) for n in z.namelist() if n.startswith("classes/") and n.endswith(".class") and os.path.dirname(n[len("classes/") :]) in exposed]
    return _zip_shapes(spark, parts, True)


def platform_classes(spark: SparkSession, release: int, home: str | None = None, table: str | None = None) -> DataFrame:
    """Platform classes of a release: a text table or a folder of them, else a JDK home's ct.sym, else its jmods where they are of that release."""
    if table:
        path = table_of(table, release)
        if not os.path.exists(path):
            raise RefusedRun(f"{table} has no table of release {release}")
        return read_table(spark, path, release)
    if not home:
        raise RefusedRun(f"no platform symbols for release {release}: name a table, a folder of tables that the symbols command has made, or a JDK home")
    sym = os.path.join(home, "lib", "ct.sym")
    if not os.path.exists(sym):
        raise RefusedRun(f"{home} has no lib/ct.sym")
    try:
        out = read_ct_sym(spark, sym, release)
    except RefusedRun:
        own = open(os.path.join(home, "release"), encoding="utf-8").read() if os.path.exists(os.path.join(home, "release")) else ""
        if f'JAVA_VERSION="{release}.' not in own and f'JAVA_VERSION="{release}"' not in own or not os.path.isdir(os.path.join(home, "jmods")):
            raise
        out = read_jmods(spark, home)
    return out


def profile_identity(release: int, home: str | None = None, table: str | None = None) -> str:
    """What a baseline notes of the platform: ``jdk:N:`` or ``table:N:`` and eight hex digits of the SHA-256 of ct.sym or of the table."""
    if not home and not table:
        return f"bundled:{release}"
    with open(table_of(table, release) if table else os.path.join(home, "lib", "ct.sym"), "rb") as f:
        return f"{'table' if table else 'jdk'}:{release}:{hashlib.file_digest(f, 'sha256').hexdigest()[:8]}"
