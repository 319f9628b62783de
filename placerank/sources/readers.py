"""Readers (IO1–IO8, IO11): CSV variants, JSON envelopes, keyed JSON, directories.

Everything returns a lazy DataFrame; schemas can be given to skip inference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import resolve_columns

# Encodings tried in this order (IO2).
ENCODINGS = ["utf-8-sig", "cp949", "euc-kr", "utf-8"]
# Java's names of the same encodings.
_PYTHON_NAMES = {"x-windows-949": "cp949", "ms949": "cp949", "utf-8": "utf-8-sig"}


def read_table(spark: SparkSession, path, schema: T.StructType | str | None = None, **opts) -> DataFrame:
    """IO1: CSV with header; types from ``schema`` or inferred. A UTF-8 BOM is dropped."""
    r = spark.read.option("header", True).option("multiLine", opts.pop("multiLine", False))
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    for k, v in opts.items():
        r = r.option(k, v)
    return r.csv(path)


def _decoded_records(encodings: list[str], required: list[str], rows: bool):
    """Files as records of the first encoding that decodes all of a file and gives the required
    header; a file that none fits is one record without encoding. Without ``rows`` headers only."""
    import csv
    import io

    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("encoding", pa.string()), ("header", pa.list_(pa.string())), ("fields", pa.list_(pa.string()))])
    at_once = 10_000

    def records(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                for encoding in encodings:
                    try:
                        text = io.StringIO(str(content.as_buffer(), encoding), newline="")
                    except UnicodeDecodeError:
                        continue
                    reader = csv.reader(text)
                    header = next(reader, [])
                    if all(r in header for r in required):
                        break
                else:
                    yield pa.RecordBatch.from_pydict({"path": [path], "encoding": [None], "header": [None], "fields": [None]}, schema=schema)
                    continue
                held = [] if rows else [None]
                for record in reader if rows else ():
                    if record:
                        held.append([x if x != "" else None for x in record])
                    if len(held) == at_once:
                        yield pa.RecordBatch.from_pydict({"path": [path] * at_once, "encoding": [encoding] * at_once,
                                                          "header": [header] * at_once, "fields": held}, schema=schema)
                        held = []
                yield pa.RecordBatch.from_pydict({"path": [path] * len(held), "encoding": [encoding] * len(held),
                                                  "header": [header] * len(held), "fields": held}, schema=schema)
    return records


def _records(spark: SparkSession, path, encodings, required, rows: bool) -> DataFrame:
    names = list(dict.fromkeys(_PYTHON_NAMES.get(e.lower(), e) for e in encodings or ENCODINGS))
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(_decoded_records(names, required or [], rows), "path string, encoding string, header array<string>, fields array<string>")


def file_encodings(spark: SparkSession, path, encodings: list[str] | None = None, required: list[str] | None = None) -> DataFrame:
    """IO2: (path, encoding, header) of every file; the encoding is null where none fits."""
    return _records(spark, path, encodings, required, False).select("path", "encoding", "header")


def read_csv_encoded(spark: SparkSession, path, encodings: list[str] | None = None,
                     schema=None, required: list[str] | None = None) -> DataFrame:
    """IO2: CSV files with a header, each in its own encoding.

    Of every file the whole content is decoded strictly with ``encodings`` in order, and the
    first that fits, and gives the ``required`` columns, is taken: a legacy text under an ASCII
    header and a UTF-8 file may lie in one folder. A file that none fits fails the query with
    its name. Columns are matched by name over all files. Types come from ``schema`` (values
    that do not fit are null) or from all values: whole numbers, numbers, else text. A file is
    read by one task, as its encoding is known only at its end; no setting of the session is
    changed.
    """
    heads = file_encodings(spark, path, encodings, required).groupBy("header").agg(F.min("path").alias("path")).orderBy("path").collect()
    if not heads or all(h["header"] is None for h in heads):
        raise ValueError(f"no encoding in {encodings or ENCODINGS} fits {path}")
    names = list(dict.fromkeys(c for h in heads for c in h["header"] or []))
    told = _records(spark, path, encodings, required, True)
    bad = F.raise_error(F.concat(F.lit("no encoding fits "), F.col("path"))).cast("array<string>")
    told = told.select(F.when(F.col("encoding").isNull(), bad).otherwise(F.col("header")).alias("_h"), F.col("fields").alias("_f"))
    values = [F.get("_f", (F.array_position("_h", F.lit(c)) - 1).cast("int")).alias(c) for c in names]
    found = told.select(*[F.when(F.array_contains("_h", F.lit(c)), v).alias(c) for c, v in zip(names, values)])
    if schema is not None:
        fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
        return found.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name)
                              for f in fields])
    fits = found.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull()).alias(f"{i}{t}")
                       for i, c in enumerate(names) for t in ("bigint", "double")]).first()
    kinds = ["bigint" if not fits[f"{i}bigint"] else "double" if not fits[f"{i}double"] else "string" for i in range(len(names))]
    return found.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in zip(names, kinds)])


def read_positional(spark: SparkSession, path, names: list[str], skip_until: str | None = None,
                    skip_rows: int = 0) -> DataFrame:
    """IO3: CSV with a title preamble; columns named by position (all strings).

    Of each file, the rows up to the first whose first field equals ``skip_until`` (that row
    included) are dropped, or the first ``skip_rows`` rows when no marker is given. A file with
    rows but without the marker fails the query. Quoted fields may hold line breaks.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.option("header", False).option("multiLine", True).schema(schema).csv(path)
    if skip_until is None and not skip_rows:
        return raw
    # a multi-line file is read in one task, so its rows are numbered without gaps
    raw = raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.monotonically_increasing_id())
    if skip_until is not None:
        start = F.min(F.when(F.col(names[0]) == skip_until, F.col("_row"))) + 1
    else:
        start = F.min("_row") + skip_rows
    starts = raw.groupBy("_file").agg(start.alias("_start"))
    absent = F.raise_error(F.concat(F.lit("no marker row in "), F.col("_file"))).cast("long")
    return raw.join(starts, "_file").filter(F.col("_row") >= F.coalesce("_start", absent)).select(*names)


def _flatten(schema: T.StructType, prefix: str = "", level: int = 1, max_level: int = 2):
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType) and level < max_level + 1 and level <= max_level:
            out += _flatten(f.dataType, name + ".", level + 1, max_level)
        else:
            out.append(name)
    return out


def flatten(df: DataFrame, max_level: int = 2) -> DataFrame:
    """Nested structs → dotted columns, at most ``max_level`` levels (``json_normalize``)."""
    cols = _flatten(df.schema, max_level=max_level)
    return df.select(*[F.col("`" + c.replace(".", "`.`") + "`").alias(c) for c in cols])


def read_json_records(spark: SparkSession, path, max_level: int = 2) -> DataFrame:
    """IO4: a JSON list of records, or an object whose first list field holds them."""
    raw = spark.read.option("multiLine", True).json(path)
    if "_corrupt_record" in raw.columns and len(raw.columns) == 1:
        raise ValueError(f"not a JSON document: {path}")
    arrays = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.ArrayType)
              and isinstance(f.dataType.elementType, T.StructType)]
    if arrays and len(raw.columns) >= 1 and not _is_record_list(raw):
        recs = raw.select(F.inline(F.col(arrays[0])))
    else:
        recs = raw
    return flatten(recs, max_level)


def _is_record_list(raw: DataFrame) -> bool:
    # A top-level JSON array is read as one row per element; an envelope as one row
    # whose array field holds the records. Decide on the schema only.
    return not any(isinstance(f.dataType, T.ArrayType) for f in raw.schema.fields)


def read_keyed_json(spark: SparkSession, path, value_schema: T.DataType | str, key_name: str = "key") -> DataFrame:
    """IO5: a JSON object keyed by entity name → one row per key (value fields flattened).

    ``value_schema`` is a DataType or a DDL string (quote non-ASCII field names with
    backticks)."""
    if isinstance(value_schema, str):
        vt = T._parse_datatype_string(value_schema)
    else:
        vt = value_schema
    txt = spark.read.option("wholetext", True).text(path)
    m = txt.select(F.explode(F.from_json(F.col("value"), T.MapType(T.StringType(), vt))).alias(key_name, "_v"))
    return m.select(key_name, "_v.*") if isinstance(vt, T.StructType) else m.withColumnRenamed("_v", "value")


def unpivot_coded(df: DataFrame, id_col: str, prefix: str, code_map: dict[str, str],
                  keep: list[str] | None = None, label_out: str = "label", value_out: str = "value") -> DataFrame:
    """IO6: wide coded counters (``cnt*`` fields) → (id, label) rows for values > 0,
    code translated through ``code_map`` (keys matched lower-cased), optionally only
    the ``keep`` labels. Rows without an id are skipped."""
    codes = [c for c in df.columns if c.startswith(prefix)]
    lower_map = {k.lower(): v for k, v in code_map.items()}
    pairs = [F.struct(F.lit(c).alias("_code"), F.col(c).cast("double").alias(value_out)) for c in codes]
    long = df.filter(F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "")) \
        .select(id_col, F.explode(F.array(*pairs)).alias("_p")).select(id_col, "_p.*")
    items = []
    for k, v in lower_map.items():
        items += [F.lit(k), F.lit(v)]
    mp = F.create_map(*items) if items else F.create_map().cast("map<string,string>")
    long = long.filter(F.col(value_out) > 0).withColumn(label_out, F.try_element_at(mp, F.lower(F.col("_code"))))
    if keep is not None:
        long = long.filter(F.col(label_out).isin(list(keep)))
    return long.drop("_code")


def read_union(spark: SparkSession, paths: list[str], required: list[str], schema=None) -> DataFrame:
    """IO7: several CSV files appended by column name; each must hold ``required``."""
    frames = []
    for p in paths:
        df = read_table(spark, p, schema)
        miss = [r for r in required if r not in df.columns]
        if miss:
            raise ValueError(f"{p}: missing {miss}; present {df.columns}")
        frames.append(df)
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_dir_with_key(spark: SparkSession, glob: str, suffix: str, key: str = "entity",
                      fmt: str = "csv", schema=None, path_pattern: str | None = None) -> DataFrame:
    """IO8: every file matching ``glob``; entity = file name without ``suffix`` (or the
    first group of ``path_pattern`` over the full path), placed as the first column."""
    if fmt == "csv":
        df = read_table(spark, glob, schema)
    else:
        df = spark.read.format(fmt).load(glob)
    if path_pattern:
        name = F.regexp_extract(F.col("_metadata.file_path"), path_pattern, 1)
    else:
        name = F.regexp_replace(F.col("_metadata.file_name"), _lit_suffix(suffix), "")
    return df.select(name.alias(key), *df.columns)


def _lit_suffix(suffix: str) -> str:
    from ..functions.text import regex_escape
    return regex_escape(suffix) + "$"


__all__ = ["read_table", "read_csv_encoded", "read_positional", "read_json_records", "read_keyed_json",
           "unpivot_coded", "read_union", "read_dir_with_key", "flatten", "resolve_columns"]
