"""Matrix Market coordinate files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..checkpoints import new_path
from ..functions import complexes as C
from ..matrix import Matrix
from ..operators.blocks import settled
from ..sizes import parts

FIELDS = ("real", "complex", "integer", "pattern", "double")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


@dataclass(frozen=True)
class Header:
    m: int
    n: int
    nnz: int
    field: str
    symmetry: str


def read_header(spark: SparkSession, path: str) -> Header:
    """Kind and size: the banner and the first line that is no comment."""
    banner = spark.read.text(path).where(F.col("value").startswith("%%")).first()
    if banner is None:
        raise ValueError(f"{path} has no Matrix Market banner")
    words = banner["value"].lower().split()
    if words[:3] != ["%%matrixmarket", "matrix", "coordinate"] or words[3] not in FIELDS or words[4] not in SYMMETRIES:
        raise ValueError(f"{path}: {' '.join(words)} is not supported")
    size = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).first()
    m, n, nnz = map(int, size["value"].split())
    return Header(m, n, nnz, words[3], words[4])


def read(spark: SparkSession, path: str, check: bool = True) -> Matrix:
    """A matrix from a file, read in parallel; the mirrored half of a symmetric file is added, repeated entries stay.

    The size line is told from entries by its place: the file's first line that
    is no comment. ``check`` counts the entries against it.
    """
    head = read_header(spark, path)
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    w = F.split(F.trim("value"), r"\s+")
    real = {"pattern": F.lit(1.0), "complex": None}.get(head.field, F.element_at(w, 3).cast("double"))
    value = C.of(F.element_at(w, 3).cast("double"), F.element_at(w, 4).cast("double")) if head.field == "complex" else real
    width = {"pattern": 2, "complex": 4}.get(head.field, 3)
    size_line = F.concat_ws(" ", w) == f"{head.m} {head.n} {head.nnz}"
    if width == 3 or head.field == "pattern":
        # the size line has three whole numbers; where an entry could read the same, the first such line is it
        first = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where(~F.col("value").startswith("%") & (F.trim("value") != "")).agg(F.min("at").alias("at")).first()["at"]
        lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where(~F.col("value").startswith("%") & (F.trim("value") != "") & (F.col("at") != first)).select("value")
    else:
        lines = lines.where(~size_line)
    entries = lines.select((F.element_at(w, 1).cast("long") - 1).alias("row"), (F.element_at(w, 2).cast("long") - 1).alias("col"), value.alias("val"))
    if check and (found := entries.count()) != head.nnz:
        raise ValueError(f"{path} says {head.nnz} entries and has {found}")
    if head.symmetry != "general":
        v = F.col("val")
        turned = {"symmetric": v, "skew-symmetric": C.neg(v) if head.field == "complex" else -v, "hermitian": C.conj(v) if head.field == "complex" else v}[head.symmetry]
        entries = entries.unionByName(entries.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), turned.alias("val")))
    return Matrix(entries, head.m, head.n)


def write(a: Matrix, path: str, comment: str = "", symmetry: str = "general") -> None:
    """One file in a folder at ``path``, in the order of rows and columns; of a symmetric matrix the lower triangle only.

    Ranges of places are sorted and written by a task each; the driver then
    strings their files together, a buffer at a time.
    """
    if symmetry not in SYMMETRIES:
        raise ValueError(f"no symmetry {symmetry!r}")
    own = settled(a).df
    if symmetry != "general":
        own = own.where("row > col" if symmetry == "skew-symmetric" else "row >= col")
    field = "complex" if a.is_complex else "real"
    values = [F.col("val.re").cast("string"), F.col("val.im").cast("string")] if a.is_complex else [F.col("val").cast("double").cast("string")]
    line = F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), *values)
    head = [f"%%MatrixMarket matrix coordinate {field} {symmetry}", *(f"% {x}" for x in comment.splitlines()), f"{a.m} {a.n} {own.count()}"]
    body = own.select("row", "col", line.alias("value")).repartitionByRange(parts(own) or 1, "row", "col").sortWithinPartitions("row", "col").select("value")
    jvm = a.spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(a.spark._jsc.hadoopConfiguration())
    if fs.exists(to):
        raise FileExistsError(path)
    pieces = jvm.org.apache.hadoop.fs.Path(new_path(a.spark, "lines"))
    body.write.text(pieces.toString())
    try:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(to, "part-00000.txt"))
        try:
            out.write("".join(x + "\n" for x in head).encode())
            source = pieces.getFileSystem(a.spark._jsc.hadoopConfiguration())
            files = [f.getPath() for f in source.listStatus(pieces) if f.getPath().getName().startswith("part-")]
            for f in sorted(files, key=lambda f: int(f.getName().split("-")[1])):
                piece = source.open(f)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, 1 << 20, False)
                finally:
                    piece.close()
        finally:
            out.close()
    finally:
        pieces.getFileSystem(a.spark._jsc.hadoopConfiguration()).delete(pieces, True)
