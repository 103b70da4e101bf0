"""Splat files: a data source for binary PLY with splits by rows, and a writer.

`spark.read.format("splat_ply").load(path)` after `register_source(spark)` gives the file's own columns; `load_ply`
gives a splat table, `save_ply` writes one.
"""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.expressions import dc_to_rgb, rgb_to_dc
from ..model import POSITION, ROTATION, SCALE, conform

#: The type names of the format and the columns a splat file must have.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
REQUIRED = ["x", "y", "z", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
SPARK = {"i1": "byte", "u1": "short", "i2": "short", "u2": "int", "i4": "int", "u4": "long", "f4": "float", "f8": "double"}


def parse_header(lines: list[str]) -> tuple[str, int, list[tuple[str, str]], int]:
    """(format, vertices, their (name, numpy type), size of the elements before them) of a header's lines; the size is
    in lines for ASCII files, else in bytes.

    Only elements of fixed width can stand before the vertices of a binary file; vertices must not hold lists.
    """
    if not lines or lines[0] != "ply":
        raise ValueError("not a PLY file")
    form, element, elements = "", None, []
    for line in lines[1:]:
        word = line.split()
        if not word or word[0] in ("comment", "obj_info"):
            continue
        if word[0] == "format":
            form = word[1]
        elif word[0] == "element":
            element = (word[1], int(word[2]), [])
            elements.append(element)
        elif word[0] == "property":
            if element is None:
                raise ValueError("a property stands before any element")
            element[2].append((word[-1], None if word[1] == "list" else TYPES.get(word[1], "")))
    skip = 0
    for name, count, fields in elements:
        if any(t == "" for _, t in fields):
            raise ValueError(f"unknown type in element {name}")
        if name == "vertex":
            if any(t is None for _, t in fields):
                raise ValueError("vertices with list properties are not supported")
            return form, count, fields, skip
        if form == "ascii":
            skip += count
            continue
        if any(t is None for _, t in fields):
            raise ValueError(f"element {name} with lists stands before the vertices")
        skip += count * np.dtype([(n, t) for n, t in fields]).itemsize
    raise ValueError("no vertices in the file")


def read_header(path: str) -> tuple[str, int, list[tuple[str, str]], int]:
    """(format, vertices, fields, place of the first vertex) of a file; of an ASCII file, that of its first element."""
    lines, at = [], 0
    with open(path, "rb") as f:
        while True:
            line = f.readline(4096)
            if not line:
                raise ValueError("the header does not end")
            text = line.decode("ascii", "replace").strip()
            if text == "end_header":
                at = f.tell()
                break
            lines.append(text)
            if lines[0] != "ply":
                raise ValueError("not a PLY file")
    form, count, fields, skip = parse_header(lines)
    return form, count, fields, at if form == "ascii" else at + skip


def lines_before(path: str) -> int:
    """Lines of the elements that stand before the vertices of an ASCII file."""
    lines = []
    with open(path, "rb") as f:
        while (text := f.readline(4096).decode("ascii", "replace").strip()) != "end_header":
            lines.append(text)
    return parse_header(lines)[3]


def ascii_rows(f, fields: list[tuple[str, str]], count: int, chunk: int = 65_536):
    """(first, table) of chunks of the vertex lines that `f` gives next, each line read once."""
    for lo in range(0, count, chunk):
        lines = [f.readline().split() for _ in range(min(chunk, count - lo))]
        if not lines[-1]:
            raise ValueError(f"the file ends before vertex {lo + len(lines)}")
        yield lo, np.array([tuple(x) for x in lines], dtype=[(n, t) for n, t in fields])


class Rows(InputPartition):
    """Rows lo to hi of the vertices."""

    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class PlyReader(DataSourceReader):
    """Reads ranges of fixed-width records; ASCII files are read by one task."""

    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rowsperpartition", 1_000_000))
        self.form, self.count, self.fields, self.start = read_header(self.path)
        if self.form not in ("binary_little_endian", "binary_big_endian", "ascii"):
            raise ValueError(f"unknown format {self.form!r}")
        self.skip = lines_before(self.path) if self.form == "ascii" else 0

    def partitions(self):
        step = self.count if self.form == "ascii" else self.rows
        return [Rows(k, min(self.count, k + step)) for k in range(0, self.count, max(step, 1))] or [Rows(0, 0)]

    def _tables(self, partition):
        """(first row, table) of chunks of the partition."""
        with open(self.path, "rb") as f:
            f.seek(self.start)
            if self.form == "ascii":
                for _ in range(self.skip):
                    f.readline()
                yield from ascii_rows(f, self.fields, self.count)
                return
            kind = np.dtype([(n, (">" if self.form == "binary_big_endian" else "<") + t) for n, t in self.fields])
            f.seek(self.start + partition.lo * kind.itemsize)
            for lo in range(partition.lo, partition.hi, 65_536):
                hi = min(partition.hi, lo + 65_536)
                content = f.read((hi - lo) * kind.itemsize)
                if len(content) != (hi - lo) * kind.itemsize:
                    raise ValueError(f"{self.path} ends before vertex {hi}")
                yield lo, np.frombuffer(content, kind)

    def read(self, partition):
        for lo, table in self._tables(partition):
            arrow = [pa.array(np.arange(lo, lo + len(table), dtype=np.int64))]
            for n, t in self.fields:
                wide = {"u1": "i2", "u2": "i4", "u4": "i8"}.get(t, t)
                arrow.append(pa.array(np.ascontiguousarray(table[n]).astype(wide)))
            yield pa.RecordBatch.from_arrays(arrow, ["gid", *(n for n, _ in self.fields)])


@dataclass
class Part(WriterCommitMessage):
    """A written part: its number, rows and file."""

    number: int
    rows: int
    file: str


class PlyWriter(DataSourceArrowWriter):
    """Writes the rows of each task, in their order, to a part of its own beside the file; the driver then joins the
    parts byte by byte behind the header. The folder must be one that executors and driver share."""

    def __init__(self, options, schema):
        self.path, self.names = options["path"], schema.names

    def write(self, batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(f"{self.path}.parts", exist_ok=True)
        file, rows = f"{self.path}.parts/{context.partitionId():06d}-{context.taskAttemptId()}", 0
        kind = np.dtype([(n, "<f4") for n in self.names])
        with open(file, "wb") as f:
            for b in batches:
                table = np.empty(b.num_rows, kind)
                for i, n in enumerate(self.names):
                    table[n] = b.column(i).to_numpy(zero_copy_only=False)
                f.write(table.tobytes())
                rows += b.num_rows
        return Part(context.partitionId(), rows, file)

    def commit(self, messages):
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        with open(f"{self.path}.parts/whole", "wb") as out:
            out.write(("ply\nformat binary_little_endian 1.0\n" + f"element vertex {sum(p.rows for p in parts)}\n" + "".join(f"property float {n}\n" for n in self.names) + "end_header\n").encode())
            for p in parts:
                with open(p.file, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 22)
        os.replace(f"{self.path}.parts/whole", self.path)
        shutil.rmtree(f"{self.path}.parts", ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(f"{self.path}.parts", ignore_errors=True)


class SplatPly(DataSource):
    """The format splat_ply: vertices of a PLY file with their number as gid."""

    @classmethod
    def name(cls):
        return "splat_ply"

    def schema(self):
        _, _, fields, _ = read_header(self.options["path"])
        return "gid long, " + ", ".join(f"`{n}` {SPARK[t]}" for n, t in fields)

    def reader(self, schema):
        return PlyReader(self.options)

    def writer(self, schema, overwrite):
        return PlyWriter(self.options, schema)


def register_source(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(SplatPly)


def load_points(spark: SparkSession, path: str) -> DataFrame:
    """gid, x, y, z of any PLY file."""
    register_source(spark)
    return spark.read.format("splat_ply").load(path).select("gid", *[F.col(c).cast("double") for c in POSITION])


def load_ply(spark: SparkSession, path: str, splat_id: str = "") -> DataFrame:
    """A splat table of a file: logarithmic scales, opacity as it is stored, colours as RGB or coefficients.

    Without first coefficients rows are mid-grey. Further coefficients are stored channel by channel. A path that only
    Spark can open (another store) is read as one whole file; one that executors can open is split by rows.
    """
    if "://" in path and not path.startswith("file://"):
        return load_plys(spark, path).withColumn("splat_id", F.lit(splat_id))
    path = path.removeprefix("file://")
    register_source(spark)
    raw = spark.read.format("splat_ply").load(path)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    first = [F.col(f"f_dc_{i}").cast("double") if f"f_dc_{i}" in raw.columns else F.lit(0.0) for i in range(3)]
    rest = sorted((c for c in raw.columns if c.startswith("f_rest_")), key=lambda c: int(c[7:]))
    if len(rest) % 3:
        raise ValueError(f"{len(rest)} further coefficients are no multiple of 3")
    if rest:
        n = len(rest) // 3
        colors = F.array(F.array(*first), *[F.array(*[F.col(rest[c * n + k]).cast("double") for c in range(3)]) for k in range(n)])
    else:
        colors = F.array(F.array(*[dc_to_rgb(c) for c in first]))
    named = {"splat_id": F.lit(splat_id), "colors": colors, "is_rgb": F.lit(not rest), "log_scales": F.lit(True)}
    named |= {c: F.col(f"scale_{i}") for i, c in enumerate(SCALE)} | {c: F.col(f"rot_{i}") for i, c in enumerate(ROTATION)}
    return conform(raw, **named)


def save_ply(df: DataFrame, path: str) -> int:
    """Writes a splat table in gid order as binary little-endian floats; gives the number of rows.

    Tasks write their rows beside the file, in a folder that they share with the driver, which joins them. Linear scales are written as logarithms (of 1e-12 at least),
    RGB as first coefficients, missing colours as mid-grey.
    """
    facts = df.agg(F.count("*"), F.max(F.size("colors")), F.bool_and(F.coalesce("is_rgb", F.lit(True)))).first()
    k = max(int(facts[1] or 1), 1)
    rgb = F.coalesce(F.col("is_rgb"), F.lit(True))
    value = lambda i, c: F.coalesce(F.get(F.get("colors", F.lit(i)), F.lit(c)), F.lit(0.5 if i == 0 else 0.0))
    first = [F.when(rgb, rgb_to_dc(value(0, c))).otherwise(value(0, c)).alias(f"f_dc_{c}") for c in range(3)]
    rest = [F.when(rgb, F.lit(0.0)).otherwise(value(1 + j % (k - 1), j // (k - 1))).alias(f"f_rest_{j}") for j in range(3 * (k - 1))]
    log = [F.when(F.col("log_scales"), F.col(c)).otherwise(F.log(F.greatest(F.col(c), F.lit(1e-12)))).alias(f"scale_{i}") for i, c in enumerate(SCALE)]
    rows = df.orderBy("gid").select(*POSITION, *first, *rest, "opacity", *log, *[F.col(c).alias(f"rot_{i}") for i, c in enumerate(ROTATION)])
    rows = rows.select(*[F.col(c).cast("float") for c in rows.columns])
    register_source(df.sparkSession)
    rows.write.format("splat_ply").mode("overwrite").save(path)
    return int(facts[0])


def parse_splats(content: bytes) -> dict[str, np.ndarray]:
    """Canonical columns of one whole splat file (binary or ASCII) as arrays."""
    end = content.index(b"end_header")
    end = content.index(b"\n", end) + 1
    form, count, fields, skip = parse_header([x.strip() for x in content[:end].decode("ascii", "replace").splitlines() if x.strip() != "end_header"])
    if form == "ascii":
        table = np.array([tuple(x.split()) for x in content[end:].split(b"\n", skip + count)[skip : skip + count]], dtype=fields)
    else:
        order = ">" if form == "binary_big_endian" else "<"
        kind = np.dtype([(n, order + t) for n, t in fields])
        table = np.frombuffer(content, kind, count, end + skip)
    names = [n for n, _ in fields]
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"the file lacks {', '.join(missing)}")
    out = {c: table[c].astype(float) for c in (*POSITION, "opacity")}
    out |= {c: table[f"scale_{i}"].astype(float) for i, c in enumerate(SCALE)} | {c: table[f"rot_{i}"].astype(float) for i, c in enumerate(ROTATION)}
    first = np.stack([table[f"f_dc_{i}"].astype(float) if f"f_dc_{i}" in names else np.zeros(count) for i in range(3)], 1)[:, None]
    rest = sorted((n for n in names if n.startswith("f_rest_")), key=lambda n: int(n[7:]))
    if len(rest) % 3:
        raise ValueError(f"{len(rest)} further coefficients are no multiple of 3")
    if rest:
        more = np.stack([table[n].astype(float) for n in rest], 1).reshape(count, 3, -1).transpose(0, 2, 1)
        out["colors"] = np.concatenate((first, more), 1)
    else:
        out["colors"] = first * 0.28209479177387814 + 0.5
    return out


def load_plys(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One splat table of many files (globs, any store that Spark reads): splat_id is the file's path, gid its row.

    A file is read by one task, so this suits many scans of up to 2 GB each; `load_ply` splits a single large one.
    """
    from ..model import SCHEMA

    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def work(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = parse_splats(content)
                n = len(t["x"])
                for lo in range(0, n, 65_536):
                    own = {k: v[lo : lo + 65_536] for k, v in t.items()}
                    m = len(own["x"])
                    made = {"splat_id": pa.array([path] * m), "gid": pa.array(np.arange(lo, lo + m))}
                    made |= {c: pa.array(own[c]) for c in (*POSITION, *ROTATION, *SCALE, "opacity")}
                    k = own["colors"].shape[1]
                    triples = pa.ListArray.from_arrays(np.arange(0, 3 * m * k + 1, 3, dtype=np.int32), pa.array(own["colors"].ravel()))
                    made["colors"] = pa.ListArray.from_arrays(np.arange(0, m * k + 1, k, dtype=np.int32), triples)
                    made |= {"is_rgb": pa.array([k == 1] * m), "log_scales": pa.array([True] * m)}
                    yield pa.RecordBatch.from_arrays([made[c] for c in SCHEMA.names], SCHEMA.names)

    return files.mapInArrow(work, SCHEMA)
