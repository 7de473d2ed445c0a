"""Schemas of the fact relations and of findings."""

from __future__ import annotations

from pyspark.sql import types as T

MEMBER = "struct<name:string,descriptor:string,access:int>"
SHAPE = f"struct<internal_name:string,access:int,super:string,interfaces:array<string>,nest_host:string,nest_members:array<string>,members:array<{MEMBER}>>"
TYPE_REF = "struct<target:string,method:string,line:int>"
MEMBER_REF = "struct<kind:string,owner:string,name:string,descriptor:string,method:string,line:int>"
MODULE = "struct<module_name:string,required:array<string>,compile_only:array<string>,exposed:array<string>,uses:array<string>,provides:array<struct<service:string,providers:array<string>>>>"

CLASSPATH_ENTRY = "position int, display string, path string, kind string, origin string, wildcard_source string, nested struct<outer_display:string,path:string>, layout struct<classes:string,libraries:string>"
CLASS_DECL = f"position int, ordinal int, entry_name string, internal_name string, package string, major int, minor int, digest string, source_file string, shape {SHAPE}"
PLATFORM_CLASS = f"internal_name string, module string, shape {SHAPE}"

#: One row for each selected class of an artifact (row = 'class'), and one for the artifact itself (row = 'artifact').
SCANNED = (
    f"position int, row string, ordinal int, entry_name string, internal_name string, major int, minor int, digest string, source_file string, shape {SHAPE}, "
    f"type_refs array<{TYPE_REF}>, member_refs array<{MEMBER_REF}>, module {MODULE}, status string, "
    "manifest map<string,string>, sealed array<string>, coordinate struct<group:string,artifact:string,version:string>, "
    "names array<string>, notes array<struct<code:string,kind:string,detail:string>>, services array<struct<service:string,text:string>>, refusal string, expanded long"
)

SCANNED_COLUMNS = (
    "position", "row", "ordinal", "entry_name", "internal_name", "major", "minor", "digest", "source_file", "shape", "type_refs", "member_refs", "module", "status",
    "manifest", "sealed", "coordinate", "names", "notes", "services", "refusal", "expanded",
)

LOCATION = "struct<artifact:string,class_entry:string,source_file:string,line:int>"
FINDING = f"code string, severity string, predicted_error string, location {LOCATION}, subject string, summary string, explanation string, evidence array<string>, remediation array<string>"
FINDING_COLUMNS = ("code", "severity", "predicted_error", "location", "subject", "summary", "explanation", "evidence", "remediation")

SEVERITIES = ("INFO", "WARNING", "ERROR")
SCOPES = ("APPLICATION", "ALL", "REACHABLE")
ORIGINS = ("APPLICATION", "CLASSPATH")
ENTRY_KINDS = ("ARCHIVE", "DIRECTORY", "NESTED_CLASSES", "NESTED_ARCHIVE", "HOST_ARCHIVE")
#: Errors that a finding may predict; None stands for no error.
PREDICTED_ERRORS = (
    "NoClassDefFoundError", "NoSuchFieldError", "NoSuchMethodError", "IncompatibleClassChangeError", "IllegalAccessError",
    "AbstractMethodError", "UnsupportedClassVersionError", "ServiceConfigurationError",
)


def struct(ddl: str) -> T.StructType:
    """The parsed form of one of the strings above."""
    return T._parse_datatype_string(ddl)
