"""Scans (S1-S4): JSON Lines, JSON-array files, parquet tables and named splits.

Every reader takes a declared schema (no inference pass over the data)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from prefengine.session import materialize

# Split aliases the reference applies when resolving a named split.
DEFAULT_SPLIT_ALIASES = {
    "test": "validation",
}
# Chat sources name their splits by use.
CHAT_SFT_SPLITS = {"train": "train_sft", "test": "test_sft"}
CHAT_PREFERENCE_SPLITS = {"train": "train_prefs", "test": "test_prefs"}


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per line (S1).  Splittable, so large files read in parallel."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


class QuarantineExceeded(ValueError):
    """More lines could not be read than the caller allows."""


def read_jsonl_quarantine(spark: SparkSession, path: str, schema: StructType | str, max_bad: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of JSON Lines (S1) that may hold broken lines: one scan, written once and split.

    Bad lines are (file, line, reason), the line whole; the reason is ``truncated`` (an object that ends early), ``syntax``
    (anything else that is no JSON), ``not an object``, or ``wrong type: <columns>``.  Blank lines are neither.  More
    than the share ``max_bad`` of bad lines raises QuarantineExceeded.  Columns of the schema that a line lacks
    are null; columns that the schema lacks are left out."""
    schema = schema if isinstance(schema, StructType) else _struct(schema)
    corrupt = "_corrupt"
    while corrupt in schema.fieldNames():
        corrupt = f"_{corrupt}"
    asked = StructType([*schema.fields, StructField(corrupt, StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter(F.trim("line") != "")
    parsed = F.from_json("line", asked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    # as the one item of an array, since the parser stops after a first value whatever follows it
    boxed = F.try_parse_json(F.concat(F.lit("["), "line", F.lit("]")))
    rows = lines.select("file", "line", parsed.alias("row"), boxed.alias("boxed"))
    alone = F.try_variant_get("boxed", "$[1]", "variant").isNull()
    rows = rows.withColumn("any", F.when(alone, F.try_variant_get("boxed", "$[0]", "variant"))).drop("boxed")
    kind = F.schema_of_variant("any")
    wrong = [F.when(F.col("row")[f.name].isNull() & F.try_variant_get("any", f"$['{f.name}']", "string").isNotNull(), F.lit(f.name)) for f in schema.fields]
    wrong = F.array_join(F.array_compact(F.array(*wrong)), ", ")
    reason = (F.when(F.col("any").isNull() & F.ltrim("line").startswith("{") & ~F.rtrim("line").endswith("}"), "truncated")
              .when(F.col("any").isNull(), "syntax").when(~kind.startswith("OBJECT"), "not an object")
              .when(F.col(f"row.{corrupt}").isNotNull() | (wrong != ""), F.concat(F.lit("wrong type: "), wrong)))
    table = materialize(rows.select("file", "line", "row", reason.alias("reason")), "lines")
    n, bad = table.agg(F.count(F.lit(1)), F.count("reason")).first()
    if bad > max_bad * n:
        raise QuarantineExceeded(f"{bad} of {n} lines of {path} can't be read; at most {max_bad:g} of them may be bad")
    good = table.filter(F.col("reason").isNull()).select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields])
    return good, table.filter(F.col("reason").isNotNull()).select("file", "line", "reason")


def _struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


#: What stands between two objects of an array that is written with an indent of two; inside a JSON string a line end
#: is escaped, so it stands nowhere else.
ARRAY_BREAK = "\n},\n{\n"


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array of objects each (S2), as the reference's streaming writer makes them.

    The scan cuts a file where one object ends and the next begins, so one large file is read by many tasks
    and no task holds more than an object at a time.  A piece is an array without its ends: it is closed again and
    parsed, whatever else stands in it (empty objects, nested lists, braces inside strings).  Files that are
    indented otherwise are one piece.  Anything that is no array of such objects raises."""
    struct = schema if isinstance(schema, StructType) else _struct(schema)
    pieces = spark.read.option("lineSep", ARRAY_BREAK).text(path).select(F.col("value").alias("piece"))
    piece = F.trim(F.col("piece"), F.lit(" \n\r\t"))
    # the first piece of a file starts with its bracket, the last ends with one in a line of its own
    opened = F.when(piece.startswith("["), piece).otherwise(F.concat(F.lit("[{\n"), piece))
    ended = F.col("piece").rlike(r"(^\s*\[\s*|\n)\][\s]*$") | (piece.startswith("[") & F.try_parse_json(piece).isNotNull())
    closed = F.when(ended, opened).otherwise(F.concat(opened, F.lit("\n}]")))
    rows = pieces.filter(piece != "").select(F.explode(F.from_json(closed, ArrayType(struct), {"mode": "FAILFAST"})).alias("r"))
    return rows.select("r.*")


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet scan (S3): filters and projections reach the scan (PushedFilters / ReadSchema)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def resolve_split(split: str, aliases: dict[str, str] | None = None) -> str:
    """Explicit split-name map (Q7)."""
    return (aliases if aliases is not None else DEFAULT_SPLIT_ALIASES).get(split, split)


def read_split(spark: SparkSession, root: str, split: str, aliases: dict[str, str] | None = None,
               schema: StructType | str | None = None) -> DataFrame:
    """Named split of a hive-partitioned table ``root/split=<name>/``.

    The equality filter on the partition column prunes whole directories."""
    name = resolve_split(split, aliases)
    return read_table(spark, root, schema).filter(F.col("split") == F.lit(name)).drop("split")


@dataclass(frozen=True)
class Source:
    """A split-partitioned table: its folder, its own split names, and splits that it does not hold
    but takes from another source ({split: name of the source})."""

    root: str
    aliases: dict[str, str] = field(default_factory=dict)
    elsewhere: dict[str, str] = field(default_factory=dict)


def read_source(spark: SparkSession, sources: dict[str, Source], name: str, split: str) -> DataFrame:
    """A split of a named source (S4), following ``elsewhere`` to the source that holds it."""
    seen = [name]
    while split in sources[name].elsewhere:
        name = sources[name].elsewhere[split]
        if name in seen:
            raise ValueError(f"split {split!r} is passed round in a circle: {[*seen, name]}")
        seen.append(name)
    return read_split(spark, sources[name].root, split, sources[name].aliases)


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
