"""Readers and writers of responses, verdicts, side tables, pairs and training rows. Paths may lie in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _NUMBER, _TEXTS = T.StringType(), T.DoubleType(), T.ArrayType(T.StringType())
_METADATA = T.MapType(_TEXT, _TEXT)  # values that are no strings come as their JSON


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


RESPONSE = T.StructType([*_fields(_TEXT, "id", "question", "input", "gt", "answer", "model", "task"), *_fields(_METADATA, "metadata")])
COMPLETION = T.StructType([*_fields(_TEXT, "id", "input", "gt"), *_fields(_TEXTS, "completions"), *_fields(_TEXT, "model", "task"), *_fields(_METADATA, "metadata")])
#: Details of a verdict: the claims of ER, and the other dimensions as JSON, as their fields depend on the task.
_DETAILS = T.StructType([T.StructField("ER", T.StructType([*_fields(_TEXTS, "claimed_fgs", "verified_fgs", "fabricated_fgs", "wrong_classes"), *_fields(_TEXT, "reason")])), *_fields(_TEXT, "IR", "IO", "EO")])
VERDICT = T.StructType(
    [
        *_fields(_TEXT, "id", "task", "model", "pred_smiles", "pred_caption", "pred_label", "pred_product_block", "pred_reactants_block"),
        *_fields(_TEXTS, "pred_product_canonical", "pred_reactants_canonical"),
        *_fields(T.BooleanType(), "pred_valid", "exact_match"),
        *_fields(_NUMBER, "tanimoto", "caption_jaccard", "reactant_tanimoto", "product_tanimoto"),
        *_fields(T.LongType(), "reasoning_length"),
        *_fields(T.MapType(_TEXT, _NUMBER), "hallucination_scores"),
        *_fields(_NUMBER, "overall_hallucination_score"),
        *_fields(_DETAILS, "details"),
    ]
)


def read_array(spark: SparkSession, path: str, schema: T.StructType, indent: int | None = None) -> DataFrame:
    """The records of JSON arrays, or of objects with such an array under results, with `_file`, the path of their file.

    Without indent a file of any layout, plain or gzip, is one task. With it the files have one value a line, as JSON writers lay them out on request, and
    their records begin and end at that many blanks (the step of the indentation, or twice the step under results). A line break inside a
    string is escaped, so a brace at that place is a border of records and nothing else, and Spark splits a plain file at these borders over as many tasks
    as its size asks for. A file of another layout fails the read.
    """
    if indent is None:
        whole = T.StructType([*schema.fields, T.StructField("results", T.ArrayType(schema))])
        raw = spark.read.schema(whole).option("multiLine", True).json(path).withColumn("_file", F.col("_metadata.file_path"))
        return raw.select("_file", F.explode(F.coalesce("results", F.array(F.struct(*schema.fieldNames())))).alias("r")).select("r.*", "_file")
    edge = "\n" + " " * indent
    pieces = spark.read.option("lineSep", edge + "},").text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    start = F.instr("value", F.lit(edge + "{"))  # what stands before is the head of the file, or nothing
    body = F.substring_index(F.expr(f"substring(value, instr(value, '\n{' ' * indent}{{') + {indent + 1})"), edge + "}", 1)  # without the foot of the file
    blank = F.regexp_replace("value", r"[\[\]\s]", "") == ""  # an array of no records
    record = F.when(start > 0, F.concat(body, F.lit("}"))).when(~blank, F.raise_error(F.concat(F.lit("no record at this indentation in "), F.col("_file"))))
    return pieces.select("_file", F.from_json(record, schema, {"mode": "FAILFAST"}).alias("r")).filter("r IS NOT NULL").select("r.*", "_file")


def named_by_path(df: DataFrame) -> DataFrame:
    """model and task from the file's path (.../model/task.json) where the record has none, without `_file`."""
    model, task = (F.nullif(F.regexp_extract("_file", p, 1), F.lit("")) for p in (r"([^/]+)/[^/]+$", r"([^/]+?)\.json(?:\.gz)?$"))
    return df.withColumns({"model": F.coalesce("model", model), "task": F.coalesce("task", task)}).drop("_file")


def read_responses(spark: SparkSession, path: str, partitions: int | None = None, indent: int | None = None) -> DataFrame:
    """Responses from JSON arrays or objects with such an array under results; ids as text, an old `input` as question, metadata as text by name (null where
    absent); model and task as in named_by_path. A file is one task unless its indent is given (see read_array); pass partitions to spread what follows."""
    rows = named_by_path(read_array(spark, path, RESPONSE, indent))
    out = rows.withColumn("question", F.coalesce("question", "input")).drop("input")
    return out.repartition(partitions) if partitions else out


def read_completions(spark: SparkSession, path: str, indent: int | None = None) -> DataFrame:
    """Repeated samples: id, input, gt, completions, model, task, metadata; one row for each prompt."""
    return named_by_path(read_array(spark, path, COMPLETION, indent))


def samples_of(completions: DataFrame) -> DataFrame:
    """(model, task, id, gt, position, text): one row for each completion, in its order; a prompt without completions has none."""
    return completions.select("model", "task", "id", "gt", F.posexplode("completions").alias("position", "text"))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, plain or gzip; blank lines are skipped."""
    return spark.read.schema(VERDICT).json(path).filter("id IS NOT NULL")


def read_sidecar(spark: SparkSession, path: str, value: str = "map<string,string>") -> DataFrame:
    """(id, metadata) from one JSON object {id: {...}} per file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("id", "metadata"))


def read_pairs_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(key, structure, description) from tab-separated lines; the first line of each file is its header, quotes mean nothing and lines with under three parts drop out."""
    whole_lines = {"header": True, "sep": "\x01", "quote": "", "escape": ""}  # one column, so that tabs in the description stay
    parts = F.split("value", "\t", 3)
    lines = spark.read.options(**whole_lines).schema("value string").csv(path).filter(F.size(parts) >= 3)
    return lines.select(parts[0].alias("key"), parts[1].alias("structure"), parts[2].alias("description"))


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def select_by_index(df: DataFrame, position: str, splits: DataFrame, split: str) -> DataFrame:
    """Rows whose position is listed for the split in splits(split, indexes); val means valid, positions out of range select nothing."""
    wanted = splits.filter(F.col("split") == ("valid" if split == "val" else split)).select(F.explode("indexes").alias(position)).distinct()
    return df.join(wanted, position, "left_semi")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = ("model", "task")) -> None:
    """Overwrites only the (model, task) folders that df has."""
    df.write.format(fmt).option("partitionOverwriteMode", "dynamic").partitionBy(*by).mode("overwrite").save(path)


def flatten_tokens(df: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    return df.select(*keys, F.inline(tokens))


def melt_nested_maps(df: DataFrame, keys: list[str], shares: str, counts: str) -> DataFrame:
    """(keys, stratum, type, share, count) from two maps stratum -> type -> number; a type in either map gives a row."""
    def long(column: str, name: str) -> DataFrame:
        strata = df.select(*keys, F.explode(column).alias("stratum", "m"))
        return strata.select(*keys, "stratum", F.explode("m").alias("type", name))

    return long(shares, "share").join(long(counts, "count"), [*keys, "stratum", "type"], "full")
