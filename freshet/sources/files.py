"""Readers and sinks: delimited text in several encodings and dialects, JSON, GeoJSON, summaries, resumable units."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
# Spark reads no windows-1252, so such files are read byte for byte as ISO-8859-1 and the 27 differing characters replaced.
_JAVA = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}
_CP1252 = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

#: Rows up to which a part of a summary document is taken.
SUMMARY_ROWS = 10_000


def _head(spark: SparkSession, path: str, size: int = 65_536) -> bytes:
    """First bytes of the first file of a path, whatever file system it lies on."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    first = sorted((s.getPath().toString() for s in fs.globStatus(p)), key=str)[0]
    status = fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(first))
    if status.isDirectory():
        first = sorted(s.getPath().toString() for s in fs.listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", ".")))[0]
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(first))
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def separator_of(head: bytes, encoding: str = "utf-8", separators: tuple[str, ...] = (",", ";", "\t", "|")) -> str:
    """The separator most frequent in the first line."""
    line = head.split(b"\n", 1)[0].decode(encoding, "replace")
    return max(separators, key=lambda s: (line.count(s), -separators.index(s)))


def encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of a path by the first encoding that reads them whole: utf-8, cp1252 (without its five undefined bytes), latin-1.

    Every line of every file is judged where it lies, in one aggregate per file; the text source keeps the bytes as they are.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    fine = F.is_valid_utf8("value")
    undefined = ~fine & F.hex(F.col("value").cast("binary")).rlike("^(?:..)*(?:81|8D|8F|90|9D)")
    rows = lines.groupBy("file").agg(F.min(fine).alias("fine"), F.max(undefined).alias("undefined")).collect()  # a row per file
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault("utf-8" if r.fine else "latin-1" if r.undefined else "cp1252", []).append(r.file)
    return out


def read_text_table(spark: SparkSession, path: str, encoding: str | None = None, separator: str | None = None) -> DataFrame:
    """A delimited table with every column as text. Encoding and separator are found where not given: the encoding of each
    file by reading all of it, the separator in the first line.

    Records with the wrong number of fields are padded or cut; ``records.load_records`` sets them apart with the reason.
    """
    separator = separator or separator_of(_head(spark, path))
    groups = {encoding: [path]} if encoding else encodings(spark, path) or {"utf-8": [path]}
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_read_as(spark, files, e, separator) for e, files in groups.items()])


def _read_as(spark: SparkSession, files: list[str], encoding: str, separator: str) -> DataFrame:
    df = spark.read.options(header=True, inferSchema=False, sep=separator, encoding=_JAVA.get(encoding, encoding), enforceSchema=False).csv(files)
    names = [c.replace("\ufeff", "").strip() for c in df.columns]
    if encoding != "cp1252":
        return df.toDF(*names)
    old, new = "".join(_CP1252), "".join(_CP1252.values())
    return df.select(*[F.translate(F.col(f"`{c}`"), old, new).alias(n.translate(str.maketrans(_CP1252))) for c, n in zip(df.columns, names)])


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names without reading the table."""
    head = _head(spark, path)
    line = head.split(b"\n", 1)[0]
    encoding = next(e for e in ENCODINGS if _reads(line, e))
    return [c.strip().strip('"') for c in line.decode(encoding).strip().split(separator_of(head, encoding))]


def _reads(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


def read_parquet_union(spark: SparkSession, *paths: str) -> DataFrame:
    """One scan over several folders; a column that a file lacks is null."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def read_geojson(spark: SparkSession, path: str, property_name: str | None = None, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """``name, ring, rings``: the outer ring of each polygon (array of struct x, y), and all its rings, holes included, without the named features."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.explode("features").alias("f"))
    name = F.try_element_at(F.col("f.properties"), F.lit(property_name or "name"))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    polygons = F.when(F.col("f.geometry.type") == "MultiPolygon", many).when(F.col("f.geometry.type") == "Polygon", F.array(one))
    parts = f.select(name.alias("name"), F.explode(polygons).alias("p"))
    if leave_out:
        parts = parts.filter(F.col("name").isNull() | ~F.col("name").isin(*leave_out))
    rings = F.transform("p", lambda ring: F.transform(ring, lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))))
    return parts.select("name", rings[0].alias("ring"), rings.alias("rings"))


def row_count_from_footers(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet path by aggregate push-down into the footers."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown")}
    try:
        spark.conf.set("spark.sql.sources.useV1SourceList", "csv,json,orc,text")
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        return spark.read.parquet(path).count()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_records_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def summary_document(parts: dict[str, DataFrame]) -> DataFrame:
    """``part, document``: a JSON text per part; each part is a small summary, one of more than 10,000 rows is refused."""
    for name, df in parts.items():
        if df.limit(SUMMARY_ROWS + 1).count() > SUMMARY_ROWS:
            raise ValueError(f"summary part {name} has more than {SUMMARY_ROWS} rows; write it with write_records_json")
    rows = [df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("document")).select(F.lit(name).alias("part"), "document") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def sample_rows(df: DataFrame, order: list[str], n: int = 2000) -> DataFrame:
    """The first rows in a total order."""
    return df.orderBy(*order).limit(n)


def find_data(spark: SparkSession, name: str, *folders: str) -> str | None:
    """The first folder, on whatever file system, that holds the file."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for f in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{f}/{name}")
        if p.getFileSystem(conf).exists(p):
            return f"{f}/{name}"
    return None


def run_unit(spark: SparkSession, path: str, make: Callable[[], DataFrame | None], failed: bool = False) -> str:
    """Resumable unit of work: ``skipped`` where the folder holds a finished write, else writes it.

    A write counts as finished when Spark's _SUCCESS marker stands. ``empty`` leaves a finished empty folder, unless the
    pull failed: then nothing stays and the unit runs again (``failed``). The rows are counted while they are written, so
    the pull runs once.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = p.getFileSystem(conf)
    if fs.exists(p):
        return "skipped"
    df = make()
    if df is None:
        return "failed"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    if seen.get["n"]:
        return "written"
    if failed:
        fs.delete(p.getParent(), True)
        return "failed"
    return "empty"


def run_phases(phases: dict[str, Callable[[], object]], wanted: tuple[str, ...] | None = None) -> list[tuple[str, str, str]]:
    """(name, outcome, message) of each phase, run one after another: an error in one is recorded and the others still run.

    ``wanted`` picks phases by name; the others are ``left out``.
    """
    out = []
    for name, run in phases.items():
        if wanted is not None and name not in wanted:
            out.append((name, "left out", ""))
            continue
        try:
            out.append((name, "done", str(run() or "")))
        except Exception as e:  # noqa: BLE001
            out.append((name, "failed", f"{type(e).__name__}: {e}"[:500]))
    return out
