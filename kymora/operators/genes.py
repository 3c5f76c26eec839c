"""Gene tables: normalised counts, fold changes, result tables and sample axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.functions.scalar import volcano_distance
from kymora.operators.normalize import z_score
from kymora.operators.ordered import exact_quantiles
from kymora.operators.stats import first_valid
from kymora.session import cut_lineage


def size_factors(counts: DataFrame) -> DataFrame:
    """Median-of-ratios factor per sample, over genes counted in every sample; ``counts`` is stored, as it is read several times."""
    return _factors(cut_lineage(counts))


def _factors(counts: DataFrame) -> DataFrame:
    samples = counts.select("sample").distinct().agg(F.count(F.lit(1)).alias("__all"))
    logs = counts.filter("n > 0").withColumn("__l", F.log(F.col("n")))
    ref = logs.groupBy("gene_id").agg(F.avg("__l").alias("__m"), F.count(F.lit(1)).alias("__k")).crossJoin(samples)
    ref = ref.filter(F.col("__k") == F.col("__all")).select("gene_id", "__m")
    ratio = logs.join(ref, "gene_id").select("sample", (F.col("__l") - F.col("__m")).alias("ratio"))
    q = exact_quantiles(ratio, ["sample"], "ratio", {"__q": 0.5})
    return q.select("sample", F.exp("__q").alias("size_factor"))


def normalized_counts(counts: DataFrame) -> DataFrame:
    counts = cut_lineage(counts)
    return counts.join(_factors(counts), "sample").withColumn("norm", F.col("n") / F.col("size_factor"))


def fold_changes(counts: DataFrame, comparison: str, reference: str) -> DataFrame:
    """Mean of normalised counts and log2 ratio of two conditions' means."""
    n = normalized_counts(counts)
    g = n.groupBy("gene_id").agg(
        F.avg("norm").alias("base_mean"),
        F.avg(F.when(F.col("condition") == comparison, F.col("norm"))).alias("__a"), F.avg(F.when(F.col("condition") == reference, F.col("norm"))).alias("__b"),
    )
    lfc = F.when((F.col("__a") > 0) & (F.col("__b") > 0), F.log2(F.col("__a") / F.col("__b")))
    return g.select("gene_id", "base_mean", lfc.alias("log2_fold_change"))


def sample_axes(counts: DataFrame, top: int = 500, k: int = 2) -> DataFrame:
    """Principal axes of the samples on the most variable genes of log2(normalised + 1).

    Each row also carries the share of variance of its axes.  The matrix has one row per
    sample and ``top`` columns, whatever the size of the count table.  An axis points to the
    sample farthest out on it.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = normalized_counts(counts)
    samples = counts.select("sample").distinct()
    logs = n.select("gene_id", "sample", F.log2(F.col("norm") + 1).alias("v"))
    total = samples.agg(F.count(F.lit(1)).alias("__k"))
    spread = logs.groupBy("gene_id").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).crossJoin(total)
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("__k")) / (F.col("__k") - 1)
    genes = spread.orderBy(F.desc(F.round(var, 9)), "gene_id").limit(top).select("gene_id")
    grid = genes.crossJoin(samples).join(logs, ["gene_id", "sample"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    mean = F.avg("v").alias("m")
    grid = grid.join(grid.groupBy("gene_id").agg(mean), "gene_id").withColumn("v", F.col("v") - F.col("m"))
    rows = grid.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("gene_id", "v"))).alias("r"))
    vec = rows.select("sample", array_to_vector(F.transform("r", lambda x: x["v"])).alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="pc").fit(vec)
    share = [float(v) for v in model.explainedVariance]
    pcs = model.transform(vec).select("sample", vector_to_array("pc").alias("pc"))
    axis = [F.get("pc", F.lit(i)) for i in range(k)]
    far = pcs.agg(*[F.signum(F.max_by(a, F.struct(F.round(F.abs(a), 9), "sample"))).alias(f"__d{i}") for i, a in enumerate(axis)])
    return pcs.crossJoin(far).select(
        "sample", *[(a * F.col(f"__d{i}")).alias(f"pc{i + 1}") for i, a in enumerate(axis)], *[F.lit(share[i]).alias(f"share{i + 1}") for i in range(k)]
    )


def scored_results(results: DataFrame, pair: Sequence[str], lfc: str, p: str) -> DataFrame:
    """Volcano distance and its z score within each condition pair."""
    return z_score(results.withColumn("distance", volcano_distance(F.col(lfc), F.col(p))), pair, "distance", "z_score")


def fold_change_table(results: DataFrame, gene: str, pair: str, pairs: Sequence[str], lfc: str, attributes: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per gene: fold change per condition pair and the first known attributes."""
    attrs = first_valid(results, [gene], list(attributes), list(order))
    wide = results.groupBy(gene).pivot(pair, list(pairs)).agg(F.min_by(lfc, F.struct(*[F.col(o) for o in order])))
    return wide.join(attrs, gene)


def report_table(table: DataFrame, columns: Sequence[str], headers: Sequence[Sequence[str]], sort: str) -> DataFrame:
    """Text table in a fixed column order with header rows on top and blanks for nulls."""
    spark = table.sparkSession
    schema = "position long, " + ", ".join(f"`{c}` string" for c in columns)
    top = spark.createDataFrame([(i - len(headers), *h) for i, h in enumerate(headers)], schema)
    body = table.select(
        F.lit(0).cast("long").alias("position"), F.col(sort).alias("__k"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns]
    )
    both = body.unionByName(top, allowMissingColumns=True)
    return both.orderBy("position", F.col("__k").asc_nulls_last(), columns[0]).drop("__k")
