"""Feature matrices: readers, the two forms (one vector or one row for each entry), synthetic data.

The vector form is (sample_id, features array<double>), one row for each sample. The long form is (sample_id, feature,
value); absent entries are zeros there. Null vectors give no long rows; null entries stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlake.functions import keyed, vectors


def from_columns(df: DataFrame, sample: str, columns: list[str]) -> DataFrame:
    """The vector form of a wide table."""
    return df.select(F.col(sample).alias("sample_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))


def to_long(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The long form; features are called by `names`, or V1, V2 and so on."""
    x = df.select("sample_id", F.posexplode("features").alias("pos", "value"))
    name = F.concat(F.lit("V"), F.col("pos") + 1) if names is None else F.array(*map(F.lit, names))[F.col("pos")]
    return x.select("sample_id", name.alias("feature"), "value")


def from_long(df: DataFrame, features: list[str], fill: float = 0.0) -> DataFrame:
    """The vector form of a long table, in the order of `features`; entries that are absent become `fill`, repeated ones add up."""
    wide = df.groupBy("sample_id").pivot("feature", features).agg(F.sum("value")).na.fill(fill)
    return wide.select("sample_id", F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("features"))


def zero_filled(df: DataFrame) -> DataFrame:
    """A long table with a row for every sample and every distinct feature, however many; absent entries are 0, repeated ones add up."""
    x = df.groupBy("sample_id", "feature").agg(F.sum("value").alias("value"))
    every = x.select("sample_id").distinct().crossJoin(x.select("feature").distinct())
    own = x.withColumnsRenamed({"sample_id": "s_", "feature": "f_", "value": "v_"})
    both = every.join(own, F.col("sample_id").eqNullSafe(F.col("s_")) & (F.col("feature") == F.col("f_")), "left")
    return both.select("sample_id", "feature", F.coalesce("v_", F.lit(0.0)).cast("double").alias("value"))


def assay(df: DataFrame, name: str) -> DataFrame:
    """One assay of a container kept as (sample_id, feature, assay, value)."""
    return df.filter(F.col("assay") == name).select("sample_id", "feature", "value")


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", schema: str | None = None) -> DataFrame:
    """A delimited text file with a header, compressed or not; all columns are text unless a schema is given."""
    r = spark.read.option("sep", sep).option("header", True)
    return (r.schema(schema) if schema else r).csv(path)


def read_obo(spark: SparkSession, path: str, prefix: str = "GO") -> DataFrame:
    """(id, name, parents) of the terms of an ontology file whose id holds `prefix`, with line ends of either kind."""
    stanzas = spark.read.option("lineSep", "[Term]").text(path).select(F.regexp_replace("value", "\r", "").alias("value"))
    t = stanzas.select(F.concat(F.lit("\n"), F.regexp_extract("value", r"(?s)^\s*(.*?)(?:\n\n|\n\[|\s*$)", 1)).alias("value"))
    one = lambda field: F.regexp_extract("value", rf"\n{field}: *([^\n]*?) *(?:\n|$)", 1)
    up = F.regexp_extract_all("value", F.lit(r"\nis_a: *(\S+)"), F.lit(1))
    return t.select(one("id").alias("id"), one("name").alias("name"), up.alias("parents")).filter(F.col("id").contains(prefix))


def generate_archetypes(spark: SparkSession, vertices: list[list[float]], mean: float = 0.0, sd: float = 1.0, seed: int = 4355) -> DataFrame:
    """(arch_id, arch_name, position): the vertices with normal noise."""
    rows = [(i + 1, f"archetype_{i + 1}", [float(x) for x in v]) for i, v in enumerate(vertices)]
    a = spark.createDataFrame(rows, "arch_id int, arch_name string, position array<double>")
    if sd == 0:
        return a.withColumn("position", F.transform("position", lambda x: x + F.lit(mean)))
    return a.withColumn("position", F.transform("position", lambda x, d: x + mean + sd * keyed.normal(seed, "vertex", F.col("arch_id"), d)))


def generate_data(spark: SparkSession, vertices: list[list[float]], n: int, jitter: float = 0.1, size: float = 1.0, seed: int = 4355) -> DataFrame:
    """`n` samples: uniform weights scaled to the sum `size`, with normal noise on the weights, times the vertices."""
    k = len(vertices)
    w = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: keyed.uniform(seed, "weight", F.col("sample_id"), j))
    x = spark.range(n).select(F.col("id").alias("sample_id")).withColumn("w", w).withColumn("s", vectors.total(F.col("w")))
    x = x.withColumn("w", F.transform("w", lambda u, j: u / F.col("s") * size + (jitter * keyed.normal(seed, "jitter", F.col("sample_id"), j) if jitter else 0.0)))

    def coordinate(d: int) -> Column:
        return vectors.dot(F.col("w"), F.array(*[F.lit(float(v[d])) for v in vertices]))

    return x.select("sample_id", F.array(*[coordinate(d) for d in range(len(vertices[0]))]).alias("features"))


# Views of the test tables.


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("sample_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Long: how often each user did each kind of event; absent pairs are zeros."""
    t = spark.read.parquet(f"{d}/events.parquet")
    return t.groupBy(F.col("user_id").alias("sample_id"), F.col("event_type").alias("feature")).agg(F.count("*").cast("double").alias("value"))


def quantities(spark: SparkSession, d: str) -> DataFrame:
    """Long: the quantity of each part that each supplier delivered."""
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").cast("string").alias("feature")).agg(F.sum("l_quantity").alias("value"))


def part_sets(spark: SparkSession, d: str) -> DataFrame:
    """(set_id, gene): the parts of each brand."""
    t = spark.read.parquet(f"{d}/part.parquet")
    return t.select(F.col("p_brand").alias("set_id"), F.col("p_partkey").cast("string").alias("gene"))
