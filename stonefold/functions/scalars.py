"""Identity, bit and text functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INODE_BITS = 40
SNAPSHOT_MAX = 1 << 24


def block_id(data: Column) -> Column:
    """SHA-256 of the raw bytes, in hex."""
    return F.sha2(data.cast("binary"), 256)


def node_id(data: Column, domain: str = "tree node\0") -> Column:
    """A hash that no block shares: the bytes under a domain prefix."""
    return F.sha2(F.concat(F.lit(domain).cast("binary"), data.cast("binary")), 256)


def pack_inode(snapshot: Column, inode: Column) -> Column:
    """snapshot << 40 | inode; null where either is out of range. The upper half of snapshot ids gives negative longs, which unpack alike."""
    fits = (snapshot > 0) & (snapshot < SNAPSHOT_MAX) & (inode >= 0) & (inode < (1 << INODE_BITS))
    return F.when(fits, F.shiftleft(snapshot.cast("long"), INODE_BITS).bitwiseOR(inode.cast("long")))


def unpack_inode(packed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, INODE_BITS), packed.bitwiseAND(F.lit((1 << INODE_BITS) - 1))


def make_device(major: Column, minor: Column) -> Column:
    return F.shiftleft(major.cast("long"), 32).bitwiseOR(minor.cast("long"))


def device_parts(device: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(device, 32), device.bitwiseAND(F.lit((1 << 32) - 1))


def is_special(kind: Column) -> Column:
    return kind.isin("fifo", "socket", "char", "block")


def is_device(kind: Column) -> Column:
    return kind.isin("char", "block")


def needs_root(kind: Column, device: Column) -> Column:
    """Making a device node needs privilege; a character node of device 0 (a whiteout) does not."""
    return is_device(kind) & ~((kind == "char") & (device == 0))


def errno(error: Column) -> Column:
    """Error name to number; null for unknown names."""
    from stonefold.operators.namespace import ERRNO

    return F.element_at(F.create_map(*[F.lit(x) for pair in ERRNO.items() for x in pair]), error)


#: How assertions name what they tried, and names made up for a run.
TRIED = r"tried '([^']*)'"
GENERATED = r"pjdfstest_[0-9a-f]{6,}"
NAME_TOKEN = r"pjdfstest_[0-9a-f]{6,}|\$\{(?:n[0-9x]*|name)\}|\$n[0-9]+"


def operation_key(detail: Column) -> Column:
    """The operation that an assertion's text names, generated names numbered by place; null where it names none."""
    tried = F.regexp_extract(detail, TRIED, 1)
    parts = F.split(F.trim(tried), NAME_TOKEN)
    numbered = F.aggregate(F.slice(parts, 2, 1 << 20), F.struct(parts[0].alias("s"), F.lit(1).alias("i")), lambda a, p: F.struct(F.concat(a.s, F.lit("<gen"), a.i.cast("string"), F.lit(">"), p).alias("s"), (a.i + 1).alias("i")), lambda a: a.s)
    return F.when(detail.rlike(TRIED), numbered)


def normalised_text(detail: Column) -> Column:
    """Text for a comparison by position, without what changes from run to run."""
    return F.trim(F.regexp_replace(detail, GENERATED, "<name>"))


def outcome_text(detail: Column) -> Column:
    """What comes after `got `; `(empty)` where only an expectation is there, else `(textless)`."""
    return F.when(detail.rlike("got .+$"), F.trim(F.regexp_extract(detail, "got (.+)$", 1))).when(detail.contains("expected"), "(empty)").otherwise("(textless)")


def first_call(detail: Column) -> Column:
    """The system call that an operation starts with, after flags and modes."""
    tokens = F.filter(F.split(F.trim(F.regexp_extract(detail, TRIED, 1)), r"\s+"), lambda t: t != "")
    start = F.aggregate(tokens, F.struct(F.lit("").alias("t"), F.lit(False).alias("done")), lambda a, t: F.when(~a.done & ~t.rlike(r"^(-.*|0?[0-7]{3,4})$"), F.struct(t.alias("t"), F.lit(True).alias("done"))).otherwise(a), lambda a: F.when(a.done, a.t).otherwise("(no syscall)"))
    return F.when(detail.rlike(TRIED), start).otherwise("(textless)")
