"""Readers of the input files, each with its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "src long, dst long"
PAPERS = "paper_id string, title string, abstract string"
AUTHORS = "node_idx long, paper_id string, authors array<string>"
KEYWORDS = "node_idx long, domain array<string>, task array<string>, method array<string>, input_tokens long, output_tokens long, status string"
FLAT_KEYWORDS = "node_idx long, features array<string>"
PROFILES = "user_id long, author_name string, top_keywords array<string>, total_papers long"
INTERACTIONS = "user_id long, item_id long, paper_id string, keywords string"


def edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header-less CSV edge list of two columns or more; gzip is recognised by its name and, as it can't be split, spread again after reading."""
    line = spark.read.text(path).first()
    if line is not None and "," not in line["value"]:
        raise ValueError(f"{path} has fewer than 2 columns")
    df = spark.read.schema(EDGES).csv(path)
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


def node_count(edges: DataFrame) -> int:
    """The largest node of an edge list and one more; 0 for no edges."""
    return int(edges.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0))).first()[0])


def graph_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (src, dst), features (idx, features ARRAY<FLOAT>) and labels (idx, label_idx) of a benchmark folder.

    edge.csv.gz is header-less; node-feat.csv.gz and node-label.csv.gz have one line per node, whose number is the node:
    since files keep no order when read in parallel, a first column idx is expected where there is more than one column of
    labels, and features are one column of numbers separated by spaces after idx.
    """
    edges = edges_csv(spark, f"{folder}/edge.csv.gz")
    features = spark.read.schema("idx long, features string").csv(f"{folder}/node-feat.csv.gz").select("idx", F.transform(F.split(F.trim("features"), r"\s+"), lambda x: x.try_cast("float")).alias("features"))
    labels = spark.read.schema("idx long, label_idx int").csv(f"{folder}/node-label.csv.gz")
    return edges, features, labels


def node_sample(spark: SparkSession, path: str) -> DataFrame:
    """A saved sample: (idx, features, label_idx), labels unwrapped from lists of one."""
    df = spark.read.parquet(path)
    return df.withColumn("label_idx", F.try_element_at("label_idx", F.lit(1))) if dict(df.dtypes)["label_idx"].startswith("array") else df


def id_map_csv(spark: SparkSession, path: str) -> DataFrame:
    """(idx LONG, paper_id STRING) of a CSV with header; names are trimmed and lower-cased, `node idx` is idx; other names are taken by place."""
    df = spark.read.option("header", True).csv(path)
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    names = ["idx" if n == "node_idx" else n for n in names]
    if not {"idx", "paper_id"} <= set(names):
        names = ["idx", "paper_id", *names[2:]]
    return df.toDF(*names).select(F.col("idx").try_cast("long").alias("idx"), F.trim("paper_id").alias("paper_id"))


def categories_csv(spark: SparkSession, path: str) -> DataFrame:
    """(label_idx INT, category STRING): the first column is the index, `arxiv category` or the second the name."""
    df = spark.read.option("header", True).csv(path)
    name = next((c for c in df.columns if "category" in c.lower()), df.columns[1])
    return df.select(F.col(f"`{df.columns[0]}`").try_cast("int").alias("label_idx"), F.col(f"`{name}`").alias("category"))


def _first_letter(spark: SparkSession, path: str) -> str:
    """The first letter of a text file or folder that isn't blank."""
    row = spark.read.text(path).select(F.ltrim("value").alias("t")).where("t <> ''").select(F.substring("t", 1, 1)).first()
    return row[0] if row else ""


def papers_tsv(spark: SparkSession, path: str, *columns: str, one_line: bool = False) -> DataFrame:
    """A header-less TSV of papers; quoted fields may span lines. With columns, only those are parsed.

    A file whose fields may span lines is read by one task; with one_line, a record is a line and a file is split.
    """
    df = spark.read.schema(PAPERS).option("sep", "\t").option("multiLine", not one_line).option("escape", '"').csv(path)
    return df.select(*columns) if columns else df


def interactions_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INTERACTIONS).option("header", True).option("escape", '"').csv(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects, or JSON lines, with the given schema; missing fields are null. Lines are split among tasks, an array isn't."""
    return spark.read.schema(schema).option("multiLine", _first_letter(spark, path) == "[").json(path)


def keyword_results(spark: SparkSession, path: str) -> DataFrame:
    """Keyword results of either form: three arrays, or a flat `features` array, which then stands as method; missing arrays are empty."""
    df = json_array(spark, path, KEYWORDS + ", features array<string>")
    empty = F.array().cast("array<string>")
    return df.select("node_idx", F.coalesce("domain", empty).alias("domain"), F.coalesce("task", empty).alias("task"), F.coalesce("method", "features", empty).alias("method"), "input_tokens", "output_tokens", "status")


def keyword_map_json(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, keywords) of JSON objects of lists: one a line, or one that takes the whole file, which one task then reads."""
    lines = spark.read.text(path)
    first = lines.where(F.length(F.trim("value")) > 0).first()
    text = lines if first and first["value"].rstrip().endswith("}") else spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("paper_id", "keywords"))


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists, on whatever file system it names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    raise FileNotFoundError(", ".join(paths))


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table, or an empty one of its schema where the file is missing: a dimension that may fail open."""
    try:
        return json_array(spark, first_existing(spark, path), schema)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)


def enough_rows(df: DataFrame, least: int = 10) -> DataFrame:
    """df, or an error if it has fewer rows; no more than `least` rows are counted."""
    if df.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows")
    return df
