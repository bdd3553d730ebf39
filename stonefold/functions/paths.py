"""Path and name functions, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_MAX, BASE_NAME_MAX = 255, 240
#: What names of interrupted swaps contain.
RESERVED = ".swap~"

#: Class and pattern, in order of priority.
REASON_CLASSES = (
    ("harness", r"SCRATCH_DEV|SCRATCH_MNT|not built|dbench|command not found"),
    ("inherent_fuse", r"block disk|block size"),
    ("by_fstype", r"by test filesystem type|by this filesystem type|does not define maximum ACL"),
    ("missing_feature", r"xfs_io|chattr|renameat2|O_TMPFILE|creation time|not supported"),
)

#: What a log line says when a case did not do its work.
SKIP_SIGNATURES = (
    (r"command not found", "a command was missing"),
    (r"No such file or directory.*(/src/|/ltp/)|(/src/|/ltp/)\S*.*No such file or directory", "a suite helper binary was missing"),
    (r"unary operator expected|bad substitution", "a shell comparison was malformed, so its assertion did not run"),
    (r"_notrun\b|\bnotrun\b", "the case refused to run"),
    (r"Test not run|\bSkipped\b|\bskipped\b", "the case skipped work"),
    (r"\bFAIL\b|\bfail:\s", "the log reports a failure"),
    (r"(?i)\bnot supported\b|\bunsupported\b", "the case reports the feature unsupported"),
    (r"\bERROR\b", "the log reports an error"),
)

#: Suffix and kind of a build artifact, after the folders that decide first.
SUFFIX_KINDS = ((".rlib", "rlib"), (".rmeta", "rmeta"), (".o", "o"), (".d", "dep-info"), (".dylib", "dylib"), (".so", "dylib"))


def first_match(text: Column, classes: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    """The first class whose pattern is found in the text."""
    out = F.lit(otherwise)
    for name, pattern in reversed(classes):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def reason_class(text: Column) -> Column:
    return first_match(text, REASON_CLASSES, "unclassified")


def skip_signatures(text: Column) -> Column:
    """All reasons whose pattern is in a log, in order."""
    return F.filter(F.array(*[F.when(text.rlike(p), why) for p, why in SKIP_SIGNATURES]), lambda x: x.isNotNull())


def corpus_category(path: Column) -> Column:
    """The first `target` or `node_modules` component decides; `.git` only where neither is; else `source`."""
    parts = F.split(path, "/")
    place = lambda tag: F.nullif(F.array_position(parts, tag), F.lit(0))
    target, modules = place("target"), place("node_modules")
    return F.when(target.isNotNull() & (modules.isNull() | (target < modules)), "target").when(modules.isNotNull(), "node_modules").when(F.array_contains(parts, ".git"), ".git").otherwise("source")


def trial_category(path: Column) -> Column:
    """`.git` before `node_modules` before `target`; else `other`."""
    parts = F.split(path, "/")
    out = F.lit("other")
    for tag in ("target", "node_modules", ".git"):
        out = F.when(F.array_contains(parts, tag), tag).otherwise(out)
    return out


def artifact_kind(path: Column) -> Column:
    """Kind of a build artifact by its folders, then its suffix; the first match wins."""
    parts = F.split(path, "/")
    name, build = F.element_at(parts, -1), F.array_position(parts, "build")
    out = F.when(name.startswith(".") | (name == "CACHEDIR.TAG"), "misc").otherwise("binary-or-other")
    for suffix, kind in reversed(SUFFIX_KINDS):
        out = F.when(name.endswith(suffix), kind).otherwise(out)
    out = F.when((build > 0) & (build <= 3), F.when(F.array_contains(parts, "out"), "build-out").otherwise("build-script")).otherwise(out)
    for folder in (".fingerprint", "incremental"):
        out = F.when(F.array_contains(parts, folder), folder.strip(".")).otherwise(out)
    return F.when(path.contains(".dSYM"), "dSYM").otherwise(out)


def snapshot_name_fault(name: Column) -> Column:
    """The first rule that a snapshot name breaks; null if none."""
    return (
        F.when(name == "", "empty")
        .when(F.octet_length(name) > NAME_MAX, "too long")
        .when(name.startswith("."), "leading dot")
        .when(name.contains(RESERVED), "reserved")
        .when(name.contains("/"), "slash")
        .when(name.rlike(r"[\x00-\x1F\x7F-\x{9F}]"), "control")
    )


def base_name_fault(name: Column) -> Column:
    return F.coalesce(snapshot_name_fault(name), F.when(F.octet_length(name) > BASE_NAME_MAX, "base too long"))


def entry_name_fault(name: Column) -> Column:
    """The first rule that a directory entry's name breaks, in the order empty or dots, length, forbidden bytes."""
    return F.when(name.isin("", ".", ".."), "bad name").when(F.octet_length(name) > NAME_MAX, "too long").when(name.contains("/") | name.contains("\0"), "bad name")


def base_name(repo: Column) -> Column:
    """The last component that is not empty, `repo` if there is none, and `-base`."""
    parts = F.filter(F.split(repo, "/"), lambda p: p != "")
    return F.concat(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("repo")), F.lit("-base"))


def name_key(name: Column) -> Column:
    """Names collide if their keys are equal: lower-cased, hashed past the longest name. Right for names in composed form."""
    folded = F.lower(name)
    return F.when(F.octet_length(folded) <= NAME_MAX, folded).otherwise(F.concat(F.lit("#"), F.sha2(folded, 256)))


def name_key_any(name: Column) -> Column:
    """`name_key` of names in any Unicode form (compose, lower, compose), by Arrow batches."""

    @F.pandas_udf("string")
    def folded(names: pd.Series) -> pd.Series:
        nfc = lambda s: unicodedata.normalize("NFC", s)
        return names.map(lambda s: None if s is None else nfc(nfc(s).lower()))

    return name_key(folded(name))


def short_id(text: Column) -> Column:
    """First three bytes of the SHA-256, in hex."""
    return F.substring(F.sha2(text, 256), 1, 6)
