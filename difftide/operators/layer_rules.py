"""Layering rules AR1-AR7. A source text is one class; its imports stay inside its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difftide.functions.text import LINE_ENDS, not_blank
from difftide.operators.rules import hit, no_hits

# Patterns, layers and message texts of the rules.
CONTROLLER = r"@(Controller|RestController)\b"
INJECTED_FIELD = r"@Autowired\s+(private\s+)?\w*Repository\s+\w+"
INJECTED_PARAMETER = r"@Autowired\s+\w+\s*\([^)]*\w*Repository\s+\w+"
REPOSITORY_CALL = r"Repository\.\w+[^\S\n]*\("
PACKAGE_LINE = r"(?m)^package\s+([a-zA-Z0-9_.]+);\s*$"
IMPORT_LINE = r"(?m)^import\s+([a-zA-Z0-9_.]+);\s*$"
LAYERS = ["controller", "service", "repository", "model", "config", "tool", "agent", "orchestration"]
BASE_SEGMENTS = 3
INJECTION_TEXT = (
    "Layer violation detected: Controller class should not directly depend on Repository. "
    "Use a Service layer between Controller and Repository."
)
CALL_TEXT = (
    "Layer violation detected: Controller directly calls Repository methods. "
    "Business logic should be encapsulated in a Service layer."
)


def package_of(text: Column) -> Column:
    """Declared package; empty when there is none (AR6)."""
    return F.regexp_extract(text, PACKAGE_LINE, 1)


def imported_packages(text: Column) -> Column:
    """Distinct packages of the imports, by name (AR6). A name without a dot has no package."""
    names = F.regexp_extract_all(text, F.lit(IMPORT_LINE), F.lit(1))
    packages = F.transform(names, lambda n: F.nullif(F.regexp_extract(n, r"\A(.+)\.[^.]*\z", 1), F.lit("")))
    return F.array_sort(F.array_distinct(F.array_compact(packages)))


def package_layer(package: Column) -> Column:
    """First segment that names a layer; null when none does (AR7)."""
    return F.get(F.filter(F.split(package, r"\."), lambda s: s.isin(LAYERS)), F.lit(0))


def package_base(package: Column) -> Column:
    """First three segments, or the whole name when it has fewer."""
    return F.substring_index(package, ".", BASE_SEGMENTS)


def _is_controller(text: Column) -> Column:
    return text.rlike(CONTROLLER)


def _injects(text: Column) -> Column:
    return _is_controller(text) & (text.rlike(INJECTED_FIELD) | text.rlike(INJECTED_PARAMETER))


def _calls(text: Column) -> Column:
    call = text.rlike(rf"(?:\A|\n)[^{LINE_ENDS}]*{REPOSITORY_CALL}[^{LINE_ENDS}]*(?:\n|\z)")
    return _is_controller(text) & call & ~_injects(text)


def layer_injection(text: Column) -> Column:
    """AR1: a controller that injects a repository."""
    made = F.array(hit(F.lit(0), "LAYER_VIOLATION", INJECTION_TEXT))
    return F.when(text.contains("Controller") & _injects(text), made).otherwise(no_hits())


def layer_call(text: Column) -> Column:
    """AR2: a controller that calls a repository, unless AR1 fired."""
    made = F.array(hit(F.lit(0), "LAYER_VIOLATION", CALL_TEXT))
    return F.when(text.contains("Controller") & _calls(text), made).otherwise(no_hits())


def _quoted(before: str, package: Column, middle: str, other: Column, after: str) -> Column:
    return F.concat(F.lit(before), package, F.lit(middle), other, F.lit(after))


def layer_import(text: Column) -> Column:
    """AR3: a controller package importing a repository package, unless AR1 or AR2 fired.

    At most one hit; the first import by name is reported.
    """
    package = package_of(text)
    first = F.get(F.filter(imported_packages(text), lambda p: p.contains(".repository.")), F.lit(0))
    made = hit(
        F.lit(0), "LAYER_VIOLATION",
        _quoted(
            "Controller package '", package, "' imports from repository package '", first,
            "'. Controllers should only depend on Service layer.",
        ),
    )
    fires = text.contains("package") & package.contains(".controller") & first.isNotNull() & ~_injects(text) & ~_calls(text)
    return F.when(fires, F.array(made)).otherwise(no_hits())


def repo_controller(text: Column) -> Column:
    """AR4: a repository package importing controller packages, one hit per package."""
    package = package_of(text)
    upward = F.filter(imported_packages(text), lambda p: package_layer(p) == "controller")
    hits = F.transform(
        upward,
        lambda p: hit(
            F.lit(0), "CYCLIC_DEPENDENCY",
            _quoted(
                "Repository package '", package, "' imports from controller package '", p,
                "'. Repositories should not depend on controller layer.",
            ),
        ),
    )
    fires = text.contains("package") & package.contains(".repository") & ~package.contains(".controller")
    return F.when(fires, hits).otherwise(no_hits())


def same_layer(text: Column) -> Column:
    """AR5: an import from another package of the same base and layer."""
    package = package_of(text)
    coupled = F.filter(
        imported_packages(text),
        lambda p: (p != package) & (package_base(p) == package_base(package))
        & (package_layer(p) == package_layer(package)),
    )
    hits = F.transform(
        coupled,
        lambda p: hit(
            F.lit(0), "SAME_LAYER_COUPLING",
            _quoted(
                "Same-layer coupling detected between packages '", package, "' and '", p,
                "'. Cross-dependency within same layer may indicate tight coupling.",
            ),
        ),
    )
    return F.when(text.contains("package") & (package != ""), hits).otherwise(no_hits())


# In the order in which hits of one text are reported.
LAYER_RULES = {
    "rule_layer_injection": layer_injection,
    "rule_layer_call": layer_call,
    "rule_same_layer": same_layer,
    "rule_layer_import": layer_import,
    "rule_repo_controller": repo_controller,
}


def package_edges(files: DataFrame) -> DataFrame:
    """One row per (source, package, imported package) (AR6)."""
    name = "diff_content" if "diff_content" in files.columns else "content"
    text = F.col(name)
    return (
        files.where(not_blank(text))
        .select(
            "task_id", "file_path", package_of(text).alias("package"),
            F.explode(imported_packages(text)).alias("imported"),
        )
        .where(F.col("package") != "")
    )


def package_layers(files: DataFrame) -> DataFrame:
    """Sources per declared package, with its layer (AR7)."""
    name = "diff_content" if "diff_content" in files.columns else "content"
    package = package_of(F.col(name))
    return (
        files.select(package.alias("package"))
        .where(F.col("package") != "")
        .groupBy("package")
        .agg(F.count("*").alias("sources"))
        .withColumn("layer", package_layer(F.col("package")))
    )
