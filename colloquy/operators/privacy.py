"""Privacy audit over text, path, object and reference tables.

A finding is a rule name and an opaque digest of its target; no matched text and no
path ever leaves the job.  All rules run in one narrow pass over the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.keys import path_digest
from colloquy.functions.rules import EXPORT_DIRECTORY, PRIVATE_DIRECTORY, content_rules, path_rules

# Sizes that the audit reports, and directory names.
MAX_FILE_BYTES = 5 * 1024 * 1024
BUILD_DIRECTORIES = ("dist", "build", "out", ".next", ".output")
DEPENDENCY_DIRECTORIES = ("node_modules", ".pnpm-store", ".yarn", ".npm")
GENERATED_DIRECTORIES = ("dist", "target")
ENTRY_KINDS = {
    "symlink": "FILESYSTEM_SYMLINK", "hardlink": "FILESYSTEM_HARD_LINK",
    "other": "FILESYSTEM_NON_REGULAR_FILE", "unreadable": "FILE_READ_ERROR",
}
OBJECT_MODES = {"120000": "GIT_SYMLINK", "160000": "GIT_SUBMODULE"}


def findings(rows: DataFrame, rules: Column, digest: Column) -> DataFrame:
    """Distinct ``(rule_id, digest)``; duplicates combine before the shuffle."""
    return rows.select(F.explode(rules).alias("rule_id"), digest.alias("digest")).distinct()


def scan_text(rows: DataFrame, text: str, target: Column) -> DataFrame:
    return findings(rows, content_rules(F.col(text)), path_digest(target))


def scan_paths(rows: DataFrame) -> DataFrame:
    """``(path, context, is_directory)`` rows against the path rules."""
    rules = path_rules(F.col("path"), F.col("context"), F.col("is_directory"))
    return findings(rows, rules, path_digest(F.col("path")))


def kind_rules(kind: Column, names: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(kind == k, F.lit(rule)) for k, rule in names.items()]))


def scan_entries(rows: DataFrame) -> DataFrame:
    """``(path, kind)`` rows: entries that are not plain files are findings themselves."""
    return findings(rows, kind_rules(F.col("kind"), ENTRY_KINDS), path_digest(F.col("path")))


def size_rule(column: str, limit: int, rule: str) -> Column:
    return F.array_compact(F.array(F.when(F.col(column) > limit, F.lit(rule))))


def scan_files(rows: DataFrame, limit: int = MAX_FILE_BYTES, domain: str = "repository-path-v1",
               refused: str = "FILE_TOO_LARGE") -> DataFrame:
    """``(path, length, text)`` rows; a file beyond the limit is a finding of its own, and is scanned as well."""
    rules = F.concat(size_rule("length", limit, refused), content_rules(F.col("text")))
    return findings(rows, rules, path_digest(F.col("path"), domain))


def scan_contents_once(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """``(path, oid, mode)`` entries over ``(oid, size, text)`` contents.

    A content that many paths share is scanned once and its rules fan out.  Links and
    sub-modules are findings of their own and are not scanned.
    """
    plain = entries.where(~F.col("mode").isin(*OBJECT_MODES)).select("oid", "path")
    wanted = plain.select("oid").distinct()
    rules = F.concat(size_rule("size", MAX_FILE_BYTES, "FILE_TOO_LARGE"), content_rules(F.col("text")))
    # Only the rules travel on, so a content shared by a third of all paths costs its
    # few rule names per path, and a clean content nothing at all.
    hit = (
        contents.dropDuplicates(["oid"])
        .join(wanted, "oid", "left_semi")
        .select("oid", F.explode(rules).alias("rule_id"))
    )
    by_content = plain.join(hit, "oid").select("rule_id", path_digest(F.col("path")).alias("digest"))
    as_dirs = entries.select(
        "path", F.lit("source").alias("context"), (F.col("mode") == "160000").alias("is_directory")
    )
    by_mode = findings(entries, kind_rules(F.col("mode"), OBJECT_MODES), path_digest(F.col("path")))
    return by_content.unionByName(scan_paths(as_dirs)).unionByName(by_mode).distinct()


def scan_objects(objects: DataFrame) -> DataFrame:
    """``(oid, type, size, text)`` rows; a tree row carries one entry name as its text.

    ``is_directory`` tells whether a tree entry is a directory.  Findings name the
    object id, which is opaque already.
    """
    text = F.col("text")
    tree = F.concat(path_rules(text, F.lit("source"), F.col("is_directory")), content_rules(text))
    rules = F.concat(
        size_rule("size", MAX_FILE_BYTES, "GIT_OBJECT_TOO_LARGE"),
        F.when(F.col("type") == "tree", tree).otherwise(content_rules(text)),
    )
    return findings(objects, rules, F.col("oid"))


def scan_refs(refs: DataFrame) -> DataFrame:
    """``(oid, text, is_name)``: reference names also pass the path rules, subjects do not."""
    text = F.col("text")
    names = path_rules(text, F.lit("source"), F.lit(False))
    rules = F.when(F.col("is_name"), F.concat(content_rules(text), names)).otherwise(content_rules(text))
    return findings(refs, rules, F.col("oid"))


def restrict_to(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows whose path is in the selected set."""
    return rows.join(selected.select("path"), "path", "left_semi")


def worktree_scope(rows: DataFrame, generated: tuple[str, ...] = GENERATED_DIRECTORIES) -> DataFrame:
    """Leave out dependency and generated directories and what lies below prohibited ones.

    The tests read the path only, so a file source prunes content for the rest.
    """
    path = F.col("path")
    segments = F.split(path, "/", -1)
    # The directory entry itself is reported; only what is inside it is skipped.
    above = F.slice(segments, 1, F.size(segments) - 1)
    below_named = F.exists(above, lambda s: s.isin(*DEPENDENCY_DIRECTORIES))
    below_generated = reduce(lambda a, b: a | b, [path.startswith(d + "/") for d in generated])
    prohibited = F.exists(above, lambda s: s.rlike(EXPORT_DIRECTORY) | s.rlike(PRIVATE_DIRECTORY))
    hidden = path.startswith(".git/") | (path == ".git")
    return rows.where(~(below_named | below_generated | prohibited | hidden)).withColumn("context", F.lit("source"))


def build_scope(rows: DataFrame) -> DataFrame:
    """What lies in the build directories, with the build rules on."""
    inside = reduce(lambda a, b: a | b, [F.col("path").startswith(d + "/") for d in BUILD_DIRECTORIES])
    return rows.where(inside).withColumn("context", F.lit("build"))


def union_scopes(*scopes: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, scopes).distinct()


def report(found: DataFrame) -> DataFrame:
    """Findings in report order."""
    return found.orderBy("rule_id", "digest")


def verdict(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("n_findings")).select(
        F.when(F.col("n_findings") == 0, "PASS").otherwise("FAIL").alias("verdict"), "n_findings"
    )


def package_totals(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files and bytes of a package, and the files beyond the size that the caller allows, if any."""
    ok = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    return files.agg(
        F.count_if(ok).alias("files"),
        F.coalesce(F.sum(F.when(ok, F.col("length"))), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(~ok).alias("refused"),
    )
