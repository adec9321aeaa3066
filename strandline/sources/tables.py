"""Readers, writers and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strandline.plans.sizing import settle

PEPTIDE_SCHEMA = T.StructType([
    T.StructField("peptide_id", T.StringType()),
    T.StructField("Sequence", T.StringType()),
    T.StructField("Fatty_acid_chain", T.StringType()),
    T.StructField("Label", T.IntegerType()),
    T.StructField("Length", T.IntegerType()),
])
HISTORY_SCHEMA = "run string, fold int, epoch int, tag string, value double"
RAW = "raw_record"
SCORING_COLUMNS = ["Sequence", "Fatty_acid_chain"]
TRAINING_COLUMNS = ["Sequence", "Label", "Length"]

_FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}
_COMPRESSED = (".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate")


def format_of(path: str, format: str | None = None) -> str:
    """File format as given, or else by suffix in any letter case; a compression's suffix may follow."""
    if format is not None:
        if format not in _FORMATS.values():
            raise ValueError(f"unknown table format: {format} (use {', '.join(_FORMATS.values())})")
        return format
    name = path.lower().rstrip("/")
    for suffix in _COMPRESSED:
        name = name.removesuffix(suffix)
    for suffix, kind in _FORMATS.items():
        if name.endswith(suffix):
            return kind
    raise ValueError(f"unknown table format: {path} (use {', '.join(_FORMATS)})")


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None,
    multiline: bool = False, format: str | None = None,
) -> DataFrame:
    """Read a CSV (with header), Parquet or JSON table.

    Give a schema for large CSV or JSON files: without one Spark scans them once more.
    ``multiline`` allows line breaks inside quoted CSV fields, but such a file is not split.
    ``format`` is for paths without a suffix, such as folders.
    """
    kind = format_of(path, format)
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.options(header=True, escape='"', multiLine=multiline,
                                inferSchema=schema is None)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_peptides(spark: SparkSession, path: str) -> DataFrame:
    """Read a peptide CSV by the names in its header, in any order.

    ``Sequence``, ``Label`` and ``Length`` have to be there, ``Fatty_acid_chain`` may be. The first
    column of another name is the id, whatever it is called; further ones are left out. Columns
    that the file lacks are null. The driver reads the header only.
    """
    raw = spark.read.options(header=True, escape='"').csv(path)
    require_columns(raw, TRAINING_COLUMNS)
    known = [f.name for f in PEPTIDE_SCHEMA]
    own = "peptide_id" if "peptide_id" in raw.columns else next((c for c in raw.columns if c not in known), None)

    def column(field):
        name = own if field.name == "peptide_id" else field.name
        value = F.col(f"`{name}`") if name in raw.columns else F.lit(None)
        kind = field.dataType.simpleString()
        return (value if kind == "string" else F.expr(f"try_cast(`{name}` as {kind})")).cast(kind).alias(field.name)

    return raw.select([column(f) for f in PEPTIDE_SCHEMA])


def read_records(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Records of a CSV file that fit ``schema``, and those that don't, as ``raw_record`` with a ``reason``.

    Columns are found by the names in the header; those the file lacks are null, further ones are text. Without a schema, the
    peptide columns have their types. A line with another number of fields, or with a field that is not of
    its column's type, is a reject and never a record with nulls in it. Empty fields are null and no reason to reject.
    The parsed lines are written once to the checkpoint folder, for both results to read.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema or PEPTIDE_SCHEMA
    kinds = {f.name: f.dataType for f in wanted.fields}
    names = spark.read.options(header=True, escape='"').csv(path).columns
    asked = T.StructType([*(T.StructField(n, kinds.get(n, T.StringType())) for n in names), T.StructField(RAW, T.StringType())])
    # Every column is parsed whatever is selected, so that the same lines are rejected in every use of the table.
    rows = spark.read.schema(asked).options(
        header=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=RAW, columnPruning=False).csv(path)
    rows = settle(rows.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("__fields"), RAW)).select("__fields.*", RAW)
    lacking = [F.lit(None).cast(kinds[n]).alias(n) for n in kinds if n not in names]
    good = rows.where(F.col(RAW).isNull()).select(*[F.col(f"`{n}`") for n in names], *lacking)
    text = F.from_csv(F.col(RAW), ", ".join(f"`{n}` string" for n in names), {"escape": '"', "mode": "PERMISSIVE"})
    fields = F.size(F.split(F.regexp_replace(F.col(RAW), '"[^"]*"', ""), ",", -1))
    wrong = F.filter(F.array(*[F.when(text[n].isNotNull() & F.expr(f"try_cast(__text.`{n}` as {kinds[n].simpleString()})").isNull(), F.lit(n))
                               for n in names if n in kinds and kinds[n].typeName() != "string"]), lambda c: c.isNotNull())
    bad = rows.where(F.col(RAW).isNotNull()).select(RAW).withColumn("__text", text)
    reason = F.when(fields != len(names), F.concat(fields.cast("string"), F.lit(f" fields for {len(names)} columns"))).when(
        F.size(wrong) > 0, F.concat(F.lit("not of its type: "), F.array_join(wrong, ", "))).otherwise("unreadable line")
    return good, bad.select(RAW, reason.alias("reason"))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail with all missing column names; checks the schema only, runs no job."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing from the input: {missing}")
    return df


def write_table(df: DataFrame, path: str = "predictions.csv", mode: str = "overwrite") -> None:
    """Write a table as CSV (with header), Parquet or JSON, one file per task."""
    kind = format_of(path)
    writer = df.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.options(header=True, escape='"')
    writer.save(path)


def append_history(history: DataFrame, path: str, part: str | None = None) -> None:
    """Add ``(run, fold, epoch, tag, value)`` rows to the metric log, once for each run and ``part``.

    Without a ``part``, the rows themselves name it, so that writing the same rows again changes nothing, while later epochs of a run
    are added. With one, a run's part is replaced as a whole whatever it held, as when a run is repeated and comes
    out differently. Other runs and parts stay as they are; a write that fails leaves the old rows.
    """
    rows = settle(history.select("run", "fold", "epoch", "tag", "value"))
    if part is None:
        own = F.xxhash64(F.coalesce(F.to_json(F.struct("run", "fold", "epoch", "tag", "value")), F.lit("")))
        found = rows.agg(F.count(F.lit(1)), F.sum(own.cast("decimal(38,0)"))).first()
        part = f"rows-{found[0]}-{found[1]}"
    rows.withColumn("part", F.lit(part)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run", "part").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The metric log: ``run``, ``fold``, ``epoch``, ``tag``, ``value``."""
    return spark.read.schema(f"{HISTORY_SCHEMA}, part string").parquet(path).select("run", "fold", "epoch", "tag", "value")
