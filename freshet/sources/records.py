"""Delimited records parsed by structural indexing, rejects set apart with their reason.

A batch of records is laid out as one byte buffer. Numpy masks mark quotes; the parity of the quotes before each byte
tells whether it stands inside a quoted field; delimiters outside count fields and give field borders. No record is
scanned in Python, and only the two checked fields are cut out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.session import join_dictionary, reliable_checkpoint

QUOTE, NEWLINE, RETURN = 34, 10, 13
NUMBER = re.compile(rb"[ \t]*(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ \t]*)?\Z")
# Control characters of both ranges, and the replacement character, in UTF-8.
BAD_TEXT = re.compile(rb"[\x00-\x1f\x7f]|\xc2[\x80-\x9f]|\xef\xbf\xbd")


class Structure:
    """Quote parity, field counts and field borders of a batch of records."""

    def __init__(self, records: list[bytes], delimiters: np.ndarray):
        sizes = np.fromiter(map(len, records), np.int64, len(records))
        self.start = np.cumsum(sizes + 1) - sizes - 1
        self.end = self.start + sizes
        self.data = b"\n".join(records) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        record = np.repeat(np.arange(len(records)), sizes + 1)
        quote = buf == QUOTE
        quote[self.end] = False
        before = np.cumsum(quote) - quote
        before -= before[self.start][record]
        odd = before % 2 == 1
        cut = (buf == delimiters[record]) & ~odd
        cut[self.end] = False
        first = np.zeros(len(buf), bool)
        first[self.start] = True
        q = np.flatnonzero(quote)
        prior, after = np.maximum(q - 1, 0), np.minimum(q + 1, len(buf) - 1)
        at_end = np.zeros(len(buf), bool)
        at_end[self.end] = True
        opens = ~odd[q] & ~(first[q] | (cut[prior] & ~first[q]) | (quote[prior] & ~first[q]))
        closes = odd[q] & ~(at_end[after] | (buf[after] == delimiters[record[q]]) | quote[after])
        self.bad_quote = np.zeros(len(records), bool)
        self.bad_quote[record[q[opens | closes]]] = True
        self.bad_quote |= np.bincount(record[q], minlength=len(records)) % 2 == 1
        self.cuts = np.flatnonzero(cut)
        per = np.bincount(record[self.cuts], minlength=len(records))
        self.fields = per + 1
        self.first_cut = np.cumsum(per) - per

    def field(self, i: int, k: int) -> bytes:
        """Field k of record i, unquoted."""
        c = self.first_cut[i]
        a = self.start[i] if k == 0 else self.cuts[c + k - 1] + 1
        b = self.end[i] if k == self.fields[i] - 1 else self.cuts[c + k]
        text = self.data[a:b]
        return text[1:-1].replace(b'""', b'"') if text[:1] == b'"' else text


class Layout:
    def __init__(self, delimiter: str, header: str, n_fields: int):
        if len(delimiter.encode()) != 1:
            raise ValueError("a delimiter is one ASCII character")
        self.mark, self.names, self.n = ord(delimiter), [x.strip() for x in header.split(delimiter)], int(n_fields)
        self.name_at = self.names.index("characteristic_source") if "characteristic_source" in self.names else None
        self.value_at = self.names.index("value_mg_L") if "value_mg_L" in self.names else None


STRUCTURAL = (None, "no_record", "no_layout", "quoting", "column_count")


def judge(records: list[bytes | None], layouts: list[Layout | None]) -> tuple[list[str | None], Structure]:
    """First reason against each record (null: it loads) and the structure to cut fields from."""
    marks = np.fromiter((x.mark if x else 0 for x in layouts), np.uint8, len(layouts))
    s = Structure([r or b"" for r in records], marks)
    n = np.fromiter((x.n if x else -1 for x in layouts), np.int64, len(layouts))
    # All structural reasons at once; only records that pass them have their two fields cut out and read.
    kind = np.select([[r is None for r in records], [x is None for x in layouts], s.bad_quote, s.fields != n], [1, 2, 3, 4], 0) if len(records) else np.zeros(0, int)
    reasons: list[str | None] = [STRUCTURAL[k] for k in kind.tolist()]
    for i in np.flatnonzero(kind == 0).tolist():
        x = layouts[i]
        name = s.field(i, x.name_at) if x.name_at is not None else b"-"
        value = s.field(i, x.value_at) if x.value_at is not None else b""
        if not (name.decode("utf-8", "replace").strip() and not BAD_TEXT.search(name) and NUMBER.match(value)):
            reasons[i] = "invalid_value"
    return reasons, s


def file_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, n_lines, raw``: the records of delimited files, of any size, with the number of their first line.

    Line ends inside quotes do not end a record. Files are read in blocks by all tasks: the quotes of each line are counted,
    running sums within a block and the sums of the blocks before give the parity at each line, and only the lines of
    records that hold line ends are brought together. An unclosed quote shifts the parity behind it; ``load_records``
    judges such stretches line by line.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("text"))
    lines = lines.withColumn("at", F.monotonically_increasing_id())  # rises within a block
    lines = lines.withColumn("quotes", F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit(""))))
    inside = Window.partitionBy("file", "block").orderBy("at")
    lines = reliable_checkpoint(lines.withColumns({"upto": F.sum("quotes").over(inside), "k": F.row_number().over(inside)}))
    sums = lines.groupBy("file", "block").agg(F.sum("quotes").alias("q"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block")
    sums = sums.select("file", "block", (F.sum("q").over(before) - F.col("q")).alias("q0"), (F.sum("n").over(before) - F.col("n")).alias("n0"))
    lines = join_dictionary(lines, sums, ["file", "block"]).withColumns({"line_no": F.col("n0") + F.col("k"), "odd_after": (F.col("q0") + F.col("upto")) % 2 == 1, "odd_before": (F.col("q0") + F.col("upto") - F.col("quotes")) % 2 == 1})
    whole = lines.filter(~F.col("odd_before") & ~F.col("odd_after")).select("file", "line_no", F.lit(1).alias("n_lines"), F.col("text").alias("raw"))
    # A line that opens a record of several lines is numbered; the lines up to the one that closes it bear its number.
    part = lines.filter(F.col("odd_before") | F.col("odd_after"))
    opens = F.when(~F.col("odd_before"), F.col("line_no"))
    first = Window.partitionBy("file", "block").orderBy("line_no")
    part = reliable_checkpoint(part.withColumn("opened", F.last(opens, ignorenulls=True).over(first)))
    carried = part.groupBy("file", "block").agg(F.max("opened").alias("o"))
    carried = carried.select("file", "block", F.last("o", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("left_open"))
    part = join_dictionary(part, carried, ["file", "block"]).withColumn("opened", F.coalesce("opened", "left_open"))
    joined = part.groupBy("file", F.col("opened").alias("line_no")).agg(F.count("*").cast("int").alias("n_lines"), F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("l"), "text"))).alias("t"))
    joined = joined.select("file", "line_no", "n_lines", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("raw"))
    return whole.unionByName(joined)


def load_records(spark: SparkSession, path: str, layouts: DataFrame, layout: str, header: bool = True) -> DataFrame:
    """``file, line_no, reason, fields, raw``: every record of the files once, as loaded fields or with the reason against it.

    Reasons as in ``parse_records``; blank lines are no records, nor is the first line of a file where it is a ``header``. A
    record of several lines with broken structure is judged again line by line, so an unclosed quote costs its own line
    and not those after it.
    """
    rows = file_records(spark, path)
    if header:
        rows = rows.filter(F.col("line_no") > 1)
    judge_all = lambda df: parse_records(df.filter(F.trim("raw") != "").withColumn("layout", F.lit(layout)), layouts, "line_no", carry=("file", "n_lines", "raw"))
    whole = reliable_checkpoint(judge_all(rows))
    broken = (F.col("n_lines") > 1) & F.coalesce(F.col("reason").isin("quoting", "column_count"), F.lit(False))
    again = whole.filter(broken).select("file", F.posexplode(F.split("raw", "\n")).alias("k", "raw"), "line_no").select("file", (F.col("line_no") + F.col("k")).alias("line_no"), F.lit(1).alias("n_lines"), "raw")
    return whole.filter(~broken).unionByName(judge_all(again)).select("file", "line_no", "reason", "fields", "raw")


def _layouts(layouts: DataFrame) -> dict[str, Layout]:
    """Layouts are a small hand-kept table; more than 100,000 are taken for another table given by mistake."""
    rows = layouts.select("layout", "delimiter", "header", "n_fields").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 layouts")
    return {r["layout"]: Layout(r["delimiter"], r["header"], r["n_fields"]) for r in rows}


def parse_records(df: DataFrame, layouts: DataFrame, key: str = "line_id", layout_col: str = "layout", raw_col: str = "raw", only: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, layout, reason, fields`` and the columns of ``carry``: every record once; ``fields`` (map name to text) where it loads, ``reason`` where not.

    Reasons, the first that applies: no_record (null raw), no_layout (null or unknown layout), quoting, column_count,
    invalid_value. ``only`` ("rejects" or "valid") leaves the others out early. Empty text is a record of one empty
    field. No shuffle: records are judged where they lie. Other columns, whatever their names, are ignored.
    """
    known = _layouts(layouts)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(1).to_pylist()
            raw = b.column(2).cast(pa.binary()).to_pylist()
            kinds = [known.get(n) for n in names]
            reasons, s = judge(raw, kinds)
            pick = [i for i, r in enumerate(reasons) if only is None or (r is not None) == (only == "rejects")]
            fields = [None if reasons[i] else [(n, s.field(i, k).decode("utf-8", "replace")) for k, n in enumerate(kinds[i].names)] for i in pick]
            out = [b.column(0).take(pa.array(pick, pa.int64())), pa.array([names[i] for i in pick], pa.string()), pa.array([reasons[i] for i in pick], pa.string())]
            extra = [b.column(3 + k).take(pa.array(pick, pa.int64())) for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(fields, pa.map_(pa.string(), pa.string())), *extra], ["key", "layout", "reason", "fields", *(f"c{k}" for k in range(len(carry)))])

    also = [F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]
    kinds = "".join(f", c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    out = df.select(F.col(key).alias("key"), F.col(layout_col).cast("string").alias("layout"), F.col(raw_col).cast("string").alias("raw"), *also)
    out = out.mapInArrow(run, f"key {key_type}, layout string, reason string, fields map<string,string>{kinds}")
    return out.withColumnsRenamed({"key": key, **{f"c{k}": c for k, c in enumerate(carry)}})


# Types of the columns that are not text.
TYPED = {"value_mg_L": "double", "value_source": "double", "detection_limit": "double", "latitude": "double", "longitude": "double"}
COLUMNS = (
    "source", "station_id", "latitude", "longitude", "site_type", "datetime", "characteristic_source", "fraction",
    "value_source", "unit_source", "value_mg_L", "detection_limit", "below_flag", "remark",
)


def typed_rows(parsed: DataFrame, key: str = "line_id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The loading records as typed columns over all layouts; a column that a layout lacks, and an empty number, is null."""
    cell = lambda c: F.try_element_at(F.col("fields"), F.lit(c))
    return parsed.filter(F.col("reason").isNull()).select(key, "layout", *[(F.trim(cell(c)).try_cast(TYPED[c]) if c in TYPED else cell(c)).alias(c) for c in columns])


def found(df: DataFrame, layouts: DataFrame) -> DataFrame:
    """Records that cannot be loaded, with the first reason."""
    return parse_records(df, layouts, only="rejects").select("line_id", "reason")
