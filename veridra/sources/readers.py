"""Readers: records of a class from files and databases.

Formats that Spark reads are read by Spark, in parallel. YAML is parsed by a function per file;
whole files are then the unit of parallelism. Of RDF, N-Triples and N-Quads are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridra.operators import checks
from veridra.plans import resolve
from veridra.plans.model import Schema, Slot

CORRUPT = "_corrupt"
#: Column that names a record's class.
TYPE = "@type"


@dataclass
class Options:
    cls: str | None = None
    #: source column to slot
    mapping: dict[str, str] = field(default_factory=dict)
    limit: int | None = None
    skip_invalid: bool = False
    delimiter: str = ","
    quote: str = '"'
    comment: str | None = None
    encoding: str = "UTF-8"
    row_tag: str | None = None
    #: JSON with an object a line, whose files can be split, rather than one document a file.
    lines: bool = False
    #: Delimited text whose quoted cells hold line ends; such files can't be split.
    multi_line: bool = False


def spark_type(s: Schema, slot: Slot, depth: int = 3) -> T.DataType:
    """The Spark type of a slot; records within records down to a depth, then their ids."""
    of = checks.base_range(s, slot.range)
    if of in s.classes and resolve.is_inlined(s, slot) and depth > 0:
        kind: T.DataType = struct_type(s, of, depth - 1)
    else:
        kind = T.LongType() if of in checks.INTEGERS else T.DecimalType(19, 4) if of == "decimal" else T.DoubleType() if of in checks.NUMBERS else T.BooleanType() if of in checks.BOOLEANS else T.DateType() if of == "date" else T.TimestampType() if of == "datetime" else T.StringType()
    return T.ArrayType(kind) if slot.multivalued else kind


def struct_type(s: Schema, cls: str, depth: int = 3) -> T.StructType:
    """The record type of a class, with its constraints as metadata."""
    out = []
    for name, slot in resolve.induced_slots(s, cls).items():
        keep = {k: getattr(slot, k) for k in ("pattern", "minimum_value", "maximum_value", "min_length", "max_length", "description") if getattr(slot, k) is not None}
        out.append(T.StructField(name, spark_type(s, slot, depth), not (slot.required or slot.identifier), keep))
    return T.StructType(out)


def _limited(df: DataFrame, o: Options) -> DataFrame:
    return df.limit(o.limit) if o.limit is not None else df


def rejected_rows(spark: SparkSession, path: str | list[str], s: Schema, options: Options | None = None, kind: str = "csv") -> int:
    """The number of rows that ``skip_invalid`` leaves out of delimited text."""
    o = replace(options or Options(), limit=None)
    read_ = {"csv": read_csv, "tsv": read_tsv}[kind]
    return read_(spark, path, s, replace(o, skip_invalid=False)).count() - read_(spark, path, s, replace(o, skip_invalid=True)).count()


def _typed(df: DataFrame, s: Schema | None, o: Options) -> DataFrame:
    """Text cells as values of the class's slots; empty cells are NULL, many values are split."""
    df = df.withColumnsRenamed(o.mapping)
    if s is None:
        return df
    cls = o.cls or resolve.class_for(s, df.columns)
    if cls is None:
        raise ValueError("no class fits the columns; name one")
    slots, out = resolve.induced_slots(s, cls), []
    bad = F.lit(False)
    for c in df.columns:
        cell = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        slot = slots.get(c)
        if c == CORRUPT:
            continue
        if slot is None:
            out.append(cell.alias(c))
            continue
        of = checks.base_range(s, slot.range)
        value = checks.convert_many(cell, of) if slot.multivalued else checks.convert(cell, of)
        bad = bad | (cell.isNotNull() & (value.isNull() if not slot.multivalued else F.exists(value, lambda e: e.isNull())))
        out.append(value.alias(c))
    bad = bad | (F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False))
    made = df.select(*out, bad.alias("__bad"))
    made = made.filter(~F.col("__bad")) if o.skip_invalid else made
    return made.drop("__bad").withColumn(TYPE, F.lit(cls))


def read_csv(spark: SparkSession, path: str | list[str], s: Schema | None = None, options: Options | None = None) -> DataFrame:
    """Rows under a header, all columns as text, then as the class's types."""
    o = options or Options()
    r = spark.read.option("header", True).option("sep", o.delimiter).option("quote", o.quote).option("escape", o.quote).option("encoding", o.encoding).option("mode", "PERMISSIVE").option("multiLine", o.multi_line).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if o.comment:
        r = r.option("comment", o.comment)
    header = r.csv(path).columns
    whole = T.StructType([*(T.StructField(c, T.StringType()) for c in header), T.StructField(CORRUPT, T.StringType())])
    df = r.schema(whole).option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    out = _typed(df, s, o)
    return _limited(out.drop(CORRUPT) if s is None else out, o)


def read_tsv(spark: SparkSession, path: str | list[str], s: Schema | None = None, options: Options | None = None) -> DataFrame:
    o = options or Options()
    o.delimiter = "\t"
    return read_csv(spark, path, s, o)


def read_json_lines(spark: SparkSession, path: str | list[str], s: Schema | None = None, options: Options | None = None) -> DataFrame:
    return read_json(spark, path, s, replace(options or Options(), lines=True))


def json_class(keys: Column, declared: Column, s: Schema) -> Column:
    """The class of a record by its declared type, else by most slots among its keys (the first of
    equal ones); NULL if no slot is."""
    names = resolve.concrete(s)
    overlaps = [F.size(F.array_intersect(keys, F.array(*map(F.lit, resolve.induced_slots(s, c))))) for c in names]
    best = F.array_max(F.array(*overlaps))
    found = F.coalesce(*[F.when((n == best) & (best > 0), F.lit(c)) for c, n in zip(names, overlaps, strict=True)])
    return F.when(declared.isin(list(s.classes)), declared).otherwise(found)


def read_json(spark: SparkSession, path: str | list[str], s: Schema | None = None, options: Options | None = None) -> DataFrame:
    """Objects, one a line or in an array; with a schema, the fields of one class, typed."""
    o = options or Options()
    r = spark.read.option("multiLine", not o.lines).option("mode", "DROPMALFORMED" if o.skip_invalid else "PERMISSIVE").option("encoding", o.encoding)
    if s is None or o.cls is None:
        return _limited(r.json(path).withColumnsRenamed(o.mapping), o)
    back = {b: a for a, b in o.mapping.items()}
    kind = struct_type(s, o.cls)
    wanted = T.StructType([*(T.StructField(back.get(f.name, f.name), f.dataType) for f in kind), T.StructField(TYPE, T.StringType())])
    df = r.schema(wanted).json(path).withColumnsRenamed(o.mapping)
    return _limited(df.filter(F.col(f"`{TYPE}`").isNull() | (F.col(f"`{TYPE}`") == o.cls)).withColumn(TYPE, F.lit(o.cls)), o)


def parsed_json(df: DataFrame, text: str, s: Schema) -> DataFrame:
    """``df`` with the class of each record's text and its unknown keys."""
    keys = F.json_object_keys(text)
    cls = json_class(keys, F.get_json_object(text, f"$['{TYPE}']"), s)
    known = F.create_map(*[x for c in s.classes for x in (F.lit(c), F.array(*map(F.lit, [TYPE, *resolve.induced_slots(s, c)])))])
    return df.withColumn("class", cls).withColumn("unknown", F.array_except(keys, F.element_at(known, F.col("class")))).withColumn("is_object", keys.isNotNull())


def read_xml(spark: SparkSession, path: str, s: Schema | None = None, options: Options | None = None) -> DataFrame:
    """Elements of a tag, which is the class's name unless given; attributes as @name, text as _text."""
    o = options or Options()
    r = spark.read.format("xml").option("rowTag", o.row_tag or o.cls or "row").option("attributePrefix", "@").option("valueTag", "_text").option("mode", "DROPMALFORMED" if o.skip_invalid else "PERMISSIVE")
    if s is not None and o.cls:
        r = r.schema(struct_type(s, o.cls))
    return _limited(r.load(path).withColumnsRenamed(o.mapping), o)


def _per_file(spark: SparkSession, path: str | list[str], parse: Callable[[str], Iterator[dict]]) -> DataFrame:
    """file and the JSON text of each record that ``parse`` finds in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [json.dumps(r, default=str) for r in parse(content.decode())]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.string())], names=["file", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, record string")


def read_yaml(spark: SparkSession, path: str | list[str], s: Schema | None = None, options: Options | None = None) -> DataFrame:
    """Documents or lists of records; with a class, as its type, else as JSON text."""

    def parse(text: str) -> Iterator[dict]:
        import yaml

        for doc in yaml.safe_load_all(text):
            yield from doc if isinstance(doc, list) else [doc] if doc is not None else []

    o = options or Options()
    df = _per_file(spark, path, parse)
    if s is None or o.cls is None:
        return _limited(df, o)
    return _limited(df.select(F.from_json("record", struct_type(s, o.cls)).alias("r")).select("r.*").withColumnsRenamed(o.mapping), o)


#: An N-Triples or N-Quads line: subject, predicate, object, graph.
TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'

#: Names of files in RDF formats that are not read: Turtle, TriG, RDF/XML, N3, JSON-LD.
OTHER_RDF = re.compile(r"\.(ttl|turtle|trig|rdf|owl|xml|n3|jsonld)(\.(gz|bz2|zst))?$", re.IGNORECASE)


def read_triples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """s, p, o, datatype, language, graph of N-Triples and N-Quads; other lines are left out. Files
    named as another RDF format are an error."""
    lines = spark.read.text(path)
    if other := [f for f in lines.inputFiles() if OTHER_RDF.search(f)]:
        raise ValueError(f"RDF format not supported, only N-Triples and N-Quads are: {other[0]}")
    return parsed_triples(lines)


def parsed_triples(lines: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("value", TRIPLE, i)
    bare = lambda c: F.regexp_replace(c, r"^<|>$", "")
    o = part(3)
    literal = o.startswith('"')
    text = F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1)
    for a, b in ((r"\\t", "\t"), (r"\\n", "\n"), (r"\\r", "\r"), (r'\\"', '"'), (r"\\\\", r"\\")):
        text = F.regexp_replace(text, a, b)
    return lines.filter(F.col("value").rlike(TRIPLE)).select(
        bare(part(1)).alias("s"), part(2).alias("p"), F.when(literal, text).otherwise(bare(o)).alias("o"),
        F.nullif(F.regexp_extract(o, r"\^\^<([^>]*)>$", 1), F.lit("")).alias("datatype"), F.nullif(F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1), F.lit("")).alias("language"),
        F.nullif(bare(part(4)), F.lit("")).alias("graph"),
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """One row, rejected: the lines that are no triple, nor blank, nor a comment."""
    bad = ~F.col("value").rlike(TRIPLE) & ~F.col("value").rlike(r"^\s*(#.*)?$")
    return lines.agg(F.count_if(bad).alias("rejected"))


def skolemised(triples: DataFrame, base: str) -> DataFrame:
    """Blank nodes as addresses under ``base``, by a hash of their label."""
    name = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit(base), F.substr(F.sha2(F.col(c), 256), F.lit(1), F.lit(32)))).otherwise(F.col(c))
    return triples.withColumns({"s": name("s"), "o": F.when(F.col("datatype").isNull() & F.col("language").isNull(), name("o")).otherwise(F.col("o"))})


def read_jdbc(spark: SparkSession, url: str, tables: list[str], partition: dict[str, tuple[str, int, int, int]] | None = None, properties: dict[str, str] | None = None, mapping: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """A frame for each table, whole. partition: by table, column, least, most and number of parts.
    mapping: table to class; others are named by ``pascal``."""
    out = {}
    for t in tables:
        by = (partition or {}).get(t)
        more = {"column": by[0], "lowerBound": by[1], "upperBound": by[2], "numPartitions": by[3]} if by else {}
        out[(mapping or {}).get(t, pascal(t))] = spark.read.jdbc(url, t, properties=properties or {}, **more)
    return out


def wanted_tables(names: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    return [n for n in names if (not include or n in include) and n not in (exclude or [])]


def pascal(name: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in name.replace("-", "_").split("_"))


def snake(name: str) -> str:
    import re

    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def at_json_path(text: Column, path: str) -> Column:
    """The value at a path ($.a.b[0]), as text; with [*], an array of all."""
    if "[*]" not in path:
        return F.get_json_object(text, path)
    head, _, rest = path.partition("[*]")
    items = F.from_json(F.get_json_object(text, head), "array<string>")
    return items if not rest else F.transform(items, lambda e: F.get_json_object(e, "$" + rest))


#: By format, how it is read: spark, path, schema, options.
READERS: dict[str, Callable[..., DataFrame]] = {"csv": read_csv, "tsv": read_tsv, "json": read_json, "jsonl": read_json_lines, "yaml": read_yaml, "yml": read_yaml, "xml": read_xml}


def read(spark: SparkSession, path: str, s: Schema | None = None, options: Options | None = None, kind: str | None = None) -> DataFrame:
    """By format, or by a path's ending."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("nt", "nq"):
        return read_triples(spark, path)
    if kind not in READERS:
        raise ValueError(f"there is no reader for {kind}")
    return READERS[kind](spark, path, s, options)


def loadable(s: Schema, kind: str = "csv") -> list[str]:
    """What keeps a schema's classes from being read from a format."""
    out = [f"{e}: {m}" for rule, e, m in resolve.lint(s) if rule in ("undefined_slot", "invalid_range")]
    out += [f"{c}: parent {p} is not defined" for c in s.classes for p in resolve.parents(s, c) if p not in s.classes]
    if kind in ("csv", "tsv"):
        out += [f"{c}.{n}: a column's name has no delimiters, quotes or line ends" for c in s.classes if all(p in s.classes for p in resolve.parents(s, c)) for n in resolve.induced_slots(s, c) if any(ch in n for ch in ',;\t|"\n')]
    return out


def _paged(fetch: Callable[[int], list[dict]], size: int) -> Iterator[dict]:
    page = 0
    while True:
        rows = fetch(page)
        yield from rows
        if len(rows) < size:
            return
        page += 1


def read_pages(spark: SparkSession, fetch: Callable[[int], list[dict]], size: int, kind: T.StructType) -> DataFrame:
    """Records of a paged service, fetched by one task until a page is short; ``fetch`` is by the
    caller, as no service can be reached from here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            for row in _paged(fetch, size):
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(row, default=str)])], names=["record"])

    return spark.range(1).repartition(1).mapInArrow(run, "record string").select(F.from_json("record", kind).alias("r")).select("r.*")
