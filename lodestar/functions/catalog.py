"""The diagnostic codes: title, severity, predicted error, what it means and what to do."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Code:
    title: str
    severity: str | None  # None: by origin and scope
    predicted: str | None
    explanation: str
    remediation: str


def _c(title: str, severity: str | None, predicted: str | None, explanation: str, remediation: str) -> Code:
    return Code(title, severity, predicted, explanation, remediation)


_SERVICE = "ServiceConfigurationError"
CODES: dict[str, Code] = {
    "JP1001": _c("Missing class", None, "NoClassDefFoundError", "Code names a class that neither the platform nor any classpath entry declares.", "Add the artifact that declares the class, or align the versions of caller and library."),
    "JP1002": _c("Missing field", None, "NoSuchFieldError", "The owner resolves, but no class or interface above it declares the field with this type.", "Use the library version that the caller was compiled against, or recompile the caller."),
    "JP1003": _c("Missing method", None, "NoSuchMethodError", "The owner resolves, but nothing it inherits from declares the method with this descriptor.", "Use the library version that the caller was compiled against, or recompile the caller."),
    "JP1004": _c("Static and instance disagree", None, "IncompatibleClassChangeError", "The member changed between static and instance since the caller was compiled.", "Recompile the caller against the library that runs."),
    "JP1005": _c("Class and interface disagree", None, "IncompatibleClassChangeError", "The owner changed between class and interface since the caller was compiled.", "Recompile the caller against the library that runs."),
    "JP1006": _c("Inaccessible class", None, "IllegalAccessError", "The class exists but is not visible from the calling class.", "Use public API, or the library version in which the class was public."),
    "JP1007": _c("Inaccessible member", None, "IllegalAccessError", "The member exists but is not visible from the calling class.", "Use public API, or the library version in which the member was accessible."),
    "JP2001": _c("Identical duplicate class", "INFO", None, "Several entries declare the class with the same bytes.", "Keep one of the artifacts."),
    "JP2002": _c("Differing duplicate class", "WARNING", None, "Several entries declare the class with different bytes; the first on the classpath runs.", "Keep one of the artifacts, or order the classpath on purpose."),
    "JP2003": _c("Split package", "INFO", None, "Classes of one package come from several artifacts.", "Keep a package in one artifact."),
    "JP2004": _c("Several versions of one artifact", "WARNING", None, "The classpath holds one artifact in different versions.", "Choose one version."),
    "JP2006": _c("Unpredictable duplicate class", "ERROR", None, "Differing declarations come from one wildcard, whose order a JVM does not promise.", "List the entries one by one, or remove the duplicate."),
    "JP2007": _c("Missing manifest Class-Path entry", "INFO", None, "A manifest names a classpath entry that does not exist.", "Add the file, or correct the manifest."),
    "JP2008": _c("Sealed package violated", "ERROR", None, "An artifact seals a package that others contribute classes to.", "Remove the other classes, or the seal."),
    "JP3001": _c("Class file newer than the target", "ERROR", "UnsupportedClassVersionError", "The class was compiled for a later Java release than the target.", "Run a later release, or compile for the target."),
    "JP3002": _c("Preview class file", "ERROR", "UnsupportedClassVersionError", "The class uses preview features, which need exactly its release with previews enabled.", "Enable previews on the matching release, or compile without them."),
    "JP3003": _c("Multi-release layout without effect", "WARNING", None, "Versioned entries are not announced by the manifest, or stand under a directory that is no release.", "Set Multi-Release: true, or rename the directory to a release of 9 or later."),
    "JP3004": _c("Corrupt class file", "ERROR", None, "The entry is named as a class but cannot be read as one.", "Build the artifact again."),
    "JP3005": _c("Mixed bytecode levels", "INFO", None, "Classes of one artifact were compiled for different releases.", "Nothing, if it is on purpose."),
    "JP3006": _c("Nested archive layout", "ERROR", None, "The application archive holds libraries in a way that its loader does not read.", "Store libraries uncompressed, one level deep, and list only those that exist."),
    "JP3007": _c("Application without classes", "INFO", None, "An application entry declares no class.", "Check the path."),
    "JP4001": _c("Missing service provider", "ERROR", _SERVICE, "A provider file names a class that is declared nowhere.", "Add the provider, or remove the line."),
    "JP4002": _c("Provider of another type", "ERROR", _SERVICE, "The provider does not extend or implement the service.", "Correct the line or the class."),
    "JP4003": _c("Malformed provider file", "ERROR", _SERVICE, "A line or the file's name is no binary class name.", "Correct the name."),
    "JP4004": _c("Repeated provider", "INFO", None, "A provider file names a provider more than once.", "Remove the repeats."),
    "JP4005": _c("Provider cannot be created", "ERROR", _SERVICE, "The provider is no public concrete class with a public constructor without arguments.", "Make it one."),
    "JP5001": _c("Missing required module", "WARNING", None, "A module requires another that is nowhere to be found.", "Add the module."),
    "JP5002": _c("Exposed package is empty", "WARNING", None, "A module exports or opens a package without classes.", "Remove the clause, or add the package."),
    "JP5003": _c("Module provider cannot be used", "ERROR", _SERVICE, "A provider that a module declares is outside it, of another type, or cannot be created.", "Correct the provides clause or the class."),
    "JP5004": _c("Missing used service", "WARNING", None, "A module uses a service that is declared nowhere.", "Add the artifact that declares it."),
    "JP5005": _c("Package in several modules", "WARNING", None, "Modules that hold the same package cannot be resolved together.", "Keep a package in one module."),
    "JP5006": _c("Illegal automatic module name", "WARNING", None, "The manifest's automatic module name is no legal name.", "Correct the manifest."),
}


def explain(code: str | None = None) -> str:
    """Documentation of one code, or the list of all; unknown codes raise."""
    if code is None:
        return "\n".join(f"{c}  {d.title}" for c, d in sorted(CODES.items()))
    if code not in CODES:
        raise KeyError(code)
    d = CODES[code]
    return "\n".join([f"{code} {d.title}", "", f"Severity: {d.severity or 'ERROR for application code, else WARNING'}", f"Predicted error: {d.predicted or 'none'}", "", d.explanation, "", d.remediation])
