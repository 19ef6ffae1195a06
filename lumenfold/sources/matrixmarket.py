"""MatrixMarket files as a Spark data source: ``spark.read.format("matrixmarket")``."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMATS, FIELDS, SYMMETRIES = ("coordinate", "array"), ("real", "integer", "double", "complex", "pattern"), ("general", "symmetric", "skew-symmetric", "hermitian")


@dataclass
class Banner:
    format: str
    field: str
    symmetry: str


def banner(line: str) -> Banner:
    """The first line's words, in any case; field and symmetry default to real and general."""
    words = line.strip().lower().split()
    if len(words) < 3 or words[0] != "%%matrixmarket" or words[1] != "matrix":
        raise ValueError(f"not a MatrixMarket matrix: {line.strip()[:80]!r}")
    out = Banner(words[2], words[3] if len(words) > 3 else "real", words[4] if len(words) > 4 else "general")
    for value, allowed in ((out.format, FORMATS), (out.field, FIELDS), (out.symmetry, SYMMETRIES)):
        if value not in allowed:
            raise ValueError(f"unknown word in the banner: {value!r}")
    if out.format == "array" and out.field == "pattern":
        raise ValueError("an array has no pattern field")
    return out


def _data(lines: Iterator[str]) -> Iterator[list[str]]:
    for line in lines:
        words = line.split()
        if words and not words[0].startswith("%"):
            yield words


def _value(kind: Banner, words: list[str]) -> tuple[float, float]:
    if kind.field == "pattern":
        return 1.0, 0.0
    if len(words) < (2 if kind.field == "complex" else 1):
        raise ValueError("a value is missing")
    return float(words[0]), float(words[1]) if kind.field == "complex" else 0.0


def _mirror(kind: Banner) -> tuple[int, int] | None:
    """Signs of the parts of a mirrored value."""
    return {"symmetric": (1, 1), "skew-symmetric": (-1, -1), "hermitian": (1, -1)}.get(kind.symmetry)


def coordinates(kind: Banner, m: int, n: int, data: Iterator[list[str]], as_complex: bool) -> Iterator[tuple[int, int, float, float]]:
    """0-based entries of coordinate lines, mirrored as the symmetry says."""
    if kind.field == "complex" and not as_complex:
        raise ValueError("a complex matrix does not fit real values")
    sign = _mirror(kind)
    for words in data:
        if len(words) < 2:
            raise ValueError("the file ends early")
        i, j = int(words[0]) - 1, int(words[1]) - 1
        if not (0 <= i < m and 0 <= j < n):
            raise ValueError(f"entry ({i + 1}, {j + 1}) lies outside the matrix")
        re, im = _value(kind, words[2:])
        yield i, j, re, im
        if sign and i != j:
            yield j, i, sign[0] * re, sign[1] * im


def entries(lines: Iterator[str], as_complex: bool) -> Iterator[tuple[int, int, float, float]]:
    """0-based entries of a whole file, mirrored as the symmetry says."""
    kind = banner(next(lines, ""))
    if kind.field == "complex" and not as_complex:
        raise ValueError("a complex matrix does not fit real values")
    data = _data(lines)
    size = [int(x) for x in next(data, [])]
    if len(size) != (3 if kind.format == "coordinate" else 2) or min(size) < 0:
        raise ValueError("the size line is missing or malformed")
    m, n = size[:2]
    if kind.symmetry != "general" and m != n:
        raise ValueError("a symmetric matrix is square")
    if kind.format == "coordinate":
        # A missing line is an empty one, which is refused.
        yield from coordinates(kind, m, n, (next(data, []) for _ in range(size[2])), as_complex)
        return
    sign = _mirror(kind)
    for j in range(n):
        for i in range(0 if sign is None else j + (kind.symmetry == "skew-symmetric"), m):
            words = next(data, None)
            if words is None:
                raise ValueError("the file ends early")
            re, im = _value(kind, words)
            if re or im:
                yield i, j, re, im
                if sign and i != j:
                    yield j, i, sign[0] * re, sign[1] * im


#: Bytes of a file that one task reads.
RANGE = 64 << 20


def _files(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    """The file system of a path, and its files with their sizes: one, or those of a folder by name (a text that Spark wrote in parts)."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        system, at = fs.LocalFileSystem(), "/" + rest.lstrip("/") if rest else path
    else:
        system, at = fs.FileSystem.from_uri(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"no such file: {path}")
    if info.type == fs.FileType.File:
        return system, [(at, info.size)]
    inside = sorted(system.get_file_info(fs.FileSelector(at)), key=lambda x: x.base_name)
    return system, [(x.path, x.size) for x in inside if x.type == fs.FileType.File and x.base_name[0] not in "._"]


def _lines(system: fs.FileSystem, file: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, str]]:
    """Lines that begin in [start, stop), each with the place after it. A range begins after the line that it cuts."""
    with system.open_input_file(file) as raw:
        raw.seek(max(0, start - 1))
        text, at = io.BufferedReader(raw, 1 << 20), max(0, start - 1)
        if start:
            at += len(text.readline())
        while (stop is None or at < stop) and (line := text.readline()):
            at += len(line)
            yield at, line.decode("utf-8", "replace")


class _Part(InputPartition):
    def __init__(self, pieces: list[tuple[str, int, int | None]], shape: tuple[int, int] | None = None):
        self.pieces, self.shape = pieces, shape


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.range = options.get("path", ""), int(options.get("range", RANGE))
        self.as_complex = options.get("complex", "false").lower() == "true"
        if not self.path:
            raise ValueError("no path given")

    def _head(self):
        """The banner, the size line, and where the entries begin (file number, place)."""
        system, files = _files(self.path)
        kind = None
        for number, (file, _) in enumerate(files):
            for at, line in _lines(system, file):
                if kind is None:
                    kind = banner(line)
                elif (words := line.split()) and not words[0].startswith("%"):
                    return system, files, kind, [int(x) for x in words], number, at
        raise ValueError("the size line is missing or malformed")

    def partitions(self) -> list[_Part]:
        _, files, kind, size, first, at = self._head()
        rest = [(file, at if k == 0 else 0, length) for k, (file, length) in enumerate(files[first:])]
        if kind.format == "array" or sum(length - start for _, start, length in rest) <= self.range:
            return [_Part([(file, 0, None) for file, _ in files])]
        # A large coordinate file: ranges, each of whole lines.
        return [_Part([(file, a, min(length, a + self.range))], tuple(size[:2])) for file, start, length in rest for a in range(start, length, self.range)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        system, _ = _files(self.path)
        lines = (line for piece in partition.pieces for _, line in _lines(system, *piece))
        if partition.shape is None:
            found = entries(lines, self.as_complex)
        else:
            found = coordinates(self._head()[2], *partition.shape, _data(lines), self.as_complex)
        for i, j, re, im in found:
            yield (i, j, re, im) if self.as_complex else (i, j, re)


class MatrixMarketSource(DataSource):
    """``row, col, val`` (option ``complex``: re, im) of a file or of a folder of its parts.

    Coordinate files beyond ``range`` bytes are read by as many tasks as they have ranges; an array is read by one, as a value's place
    depends on all before it.
    """

    @classmethod
    def name(cls) -> str:
        return "matrixmarket"

    def schema(self) -> str:
        return "row long, col long, re double, im double" if self.options.get("complex", "false").lower() == "true" else "row long, col long, val double"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_matrix(spark: SparkSession, path: str, as_complex: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """Entries of a file, mirrored as its symmetry says. A file of several ranges is first counted, as none of their tasks can tell that it ends early."""
    spark.dataSource.register(MatrixMarketSource)
    options = {"path": path, "complex": str(as_complex).lower(), "range": str(range_bytes)}
    reader = _Reader(options)
    if len(reader.partitions()) > 1:
        said = reader._head()[3]
        have = spark.read.text(path).where(~F.trim("value").startswith("%") & (F.trim("value") != "")).count() - 1
        if len(said) != 3 or have < said[2]:
            raise ValueError("the file ends early")
    return spark.read.format("matrixmarket").options(**options).load()


def write_text(lines: DataFrame, head: list[str], path: str) -> str:
    """``lines`` (one column, in the order of its partitions) as text in parts, after a file with the lines of ``head``."""
    lines.write.mode("overwrite").text(path)
    spark = lines.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/head")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray("".join(x + "\n" for x in head).encode()))
    out.close()
    return path


def write_matrix(a: DataFrame, rows: int, cols: int, path: str, field: str = "real", symmetry: str = "general") -> str:
    """``row, col, val`` (or re, im) as a coordinate text in parts, written by all tasks; of a symmetric matrix, give the lower triangle only."""
    if field not in FIELDS or symmetry not in SYMMETRIES:
        raise ValueError("unknown field or symmetry")
    value = {"complex": ["re", "im"], "pattern": []}.get(field, ["val"])
    places = [(F.col(c) + 1).cast("string") for c in ("row", "col")]
    return write_text(a.select(F.concat_ws(" ", *places, *[F.col(c).cast("string") for c in value])), [f"%%MatrixMarket matrix coordinate {field} {symmetry}", f"{rows} {cols} {a.count()}"], path)


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """Right-hand sides: ``idx, rhs_id, val``."""
    return read_matrix(spark, path).select(F.col("row").alias("idx"), F.col("col").cast("int").alias("rhs_id"), "val")


def parse_lines(lines: DataFrame) -> DataFrame:
    """General real coordinate text held in a column ``value`` with ``line`` numbers: entries by expressions alone."""
    data = lines.where(~F.trim("value").startswith("%") & (F.trim("value") != "")).select("line", F.split(F.trim("value"), r"\s+").alias("w"))
    size = data.agg(F.min("line").alias("first"))
    return data.join(F.broadcast(size), data["line"] > size["first"]).select((F.element_at("w", 1).cast("long") - 1).alias("row"), (F.element_at("w", 2).cast("long") - 1).alias("col"), F.element_at("w", 3).cast("double").alias("val"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """White-space rows with # comments: group, name, tier, n, nnz, symmetry, definite, and the rest of the line."""
    w = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+", 8).alias("w"))
    names = [("grp", "string"), ("name", "string"), ("tier", "string"), ("n", "long"), ("nnz", "long"), ("psym", "double"), ("spd", "boolean"), ("kind", "string")]
    return w.select(*[F.try_element_at("w", F.lit(i + 1)).cast(t).alias(c) for i, (c, t) in enumerate(names)])


BASELINE = "matrix string, solver string, n long, nnz long, nnz_l long, nnz_u long, supernodes long, resid double, time_ms double"


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    w = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("w"))
    return w.select(*[F.element_at("w", i + 1).cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate(BASELINE.split(", "))])


def merge_baseline(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones with the same matrix and solver; the others stay."""
    key = ["matrix", "solver"]
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    return joined.select(*[F.when(F.col("n.matrix").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns])


def write_baseline(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns]).alias("value")).write.mode("overwrite").text(path)
