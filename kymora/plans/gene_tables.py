"""Gene-table operators on counts and results derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from kymora.operators import genes as GE
from kymora.operators import stats as A
from kymora.plans import inputs as I
from kymora.plans.registry import query, rounded, table
from kymora.sources import writers as WR
from kymora.streaming.incremental import process_new_files

DE = f"WITH {I.DE_SQL}"
PAIRS = ["A_F", "A_O", "N_F", "N_O", "R_F", "R_O"]


def _pair():
    return F.concat_ws("_", "comparison_condition", "reference_condition")


@query("a20_distinct_with_null", f"{DE} SELECT count(*) AS n FROM (SELECT DISTINCT CASE WHEN gene NOT LIKE '%7' THEN gene END AS gene FROM de WHERE pvalue < 0.05)")
def a20(spark, d):
    s = I.gene_results(spark, d).filter("pvalue < 0.05").withColumn("gene", F.when(~F.col("gene").endswith("7"), F.col("gene")))
    return A.distinct_values(s, "gene")


@query("a21_repeated_genes", f"{DE} SELECT gene, count(*) AS count, string_agg(DISTINCT comparison_condition || ' vs ' || reference_condition, ', ' ORDER BY comparison_condition || ' vs ' || reference_condition) AS comparisons FROM de WHERE pvalue < 0.2 GROUP BY 1 HAVING count(*) > 1")
def a21(spark, d):
    s = I.gene_results(spark, d).filter("pvalue < 0.2")
    out = A.repeated_with_labels(s, "gene", F.concat_ws(" vs ", "comparison_condition", "reference_condition"))
    return out.orderBy(F.desc("count"), "gene")


SC = f"""{DE}, v AS (SELECT *, sqrt(lfc * lfc + log10(greatest(pvalue, 1e-300)) ** 2) AS distance FROM de), z AS (SELECT *, (distance - avg(distance) OVER w) / stddev_samp(distance) OVER w AS z FROM v WINDOW w AS (PARTITION BY comparison_condition, reference_condition))"""


def _scored(spark, d):
    r = I.gene_results(spark, d).withColumn("pvalue", F.greatest("pvalue", F.lit(1e-300)))  # p = 0 is far, but finite
    return GE.scored_results(r, ["comparison_condition", "reference_condition"], "lfc", "pvalue")


@query("a22_z_summary", f"{SC} SELECT comparison_condition, reference_condition, round(min(z), 6) AS min, round(max(z), 6) AS max, round(avg(z), 6) + 0.0 AS mean, round(quantile_cont(z, 0.5), 6) AS median, count(*) FILTER (abs(z) > 2.5) AS n_extreme FROM z GROUP BY 1, 2")
def a22(spark, d):
    out = rounded(A.z_summary(_scored(spark, d), ["comparison_condition", "reference_condition"], "z_score", 2.5))
    return out.withColumn("mean", F.col("mean") + 0.0)


@query("p12_extreme_genes", f"{SC} SELECT gene, comparison_condition, reference_condition, round(z, 6) AS z_score FROM z WHERE abs(z) > 2.5")
def p12(spark, d):
    return rounded(_scored(spark, d).filter(F.abs("z_score") > 2.5).select("gene", "comparison_condition", "reference_condition", "z_score"))


def _annotated(spark, d):
    """Results with attributes that some rows lack."""
    r = I.gene_results(spark, d).withColumn("pair", _pair())
    return r.withColumns({"description": F.when(F.col("pvalue") > 0.3, F.concat(F.lit("about "), "pair")), "padj": F.when(F.col("pvalue") < 0.8, F.col("pvalue"))})


ANN = f"{DE}, an AS (SELECT *, comparison_condition || '_' || reference_condition AS pair, CASE WHEN pvalue > 0.3 THEN 'about ' || comparison_condition || '_' || reference_condition END AS description, CASE WHEN pvalue < 0.8 THEN pvalue END AS padj FROM de)"
FIRST = f"fv AS (SELECT gene, arg_min(description, pair) FILTER (description IS NOT NULL) AS description, arg_min(padj, pair) FILTER (padj IS NOT NULL) AS padj FROM an GROUP BY 1)"


@query("a23_first_valid", f"{ANN}, {FIRST} SELECT gene, description, padj FROM fv")
def a23(spark, d):
    return A.first_valid(_annotated(spark, d), ["gene"], ["description", "padj"], ["pair"])


def _wide(spark, d):
    return GE.fold_change_table(_annotated(spark, d), "gene", "pair", PAIRS, "lfc", ["description", "padj"], ["pair"])


WIDE = f"{ANN}, {FIRST}, wd AS (SELECT gene, " + ", ".join(f"min(lfc) FILTER (pair = '{p}') AS {p}" for p in PAIRS) + " FROM an GROUP BY 1)"


@query("o12_fold_change_table", f"{WIDE} SELECT wd.*, description, padj FROM wd JOIN fv USING (gene)")
def o12(spark, d):
    return _wide(spark, d)


@query("o13_report_table", f"{WIDE} SELECT 0 AS position, gene, " + ", ".join(f"CASE WHEN {p} IS NULL THEN '' ELSE printf('%.6f', {p}) END AS {p}" for p in PAIRS) + ", coalesce(description, '') AS description FROM wd JOIN fv USING (gene) "
       "UNION ALL SELECT -2, 'comparison_condition', 'A', 'A', 'N', 'N', 'R', 'R', 'description' UNION ALL SELECT -1, 'reference_condition', 'F', 'O', 'F', 'O', 'F', 'O', 'description'")
def o13(spark, d):
    w = _wide(spark, d).withColumns({p: F.format_string("%.6f", p) for p in PAIRS})
    w = w.withColumns({p: F.when(F.col(p) != "null", F.col(p)) for p in PAIRS})
    heads = [["comparison_condition", *[p[0] for p in PAIRS], "description"], ["reference_condition", *[p[2] for p in PAIRS], "description"]]
    return GE.report_table(w, ["gene", *PAIRS, "description"], heads, "padj")


SF = f"""WITH {I.COUNTS_SQL}, lg AS (SELECT *, ln(n) AS l FROM counts WHERE n > 0), rf AS (SELECT gene_id, avg(l) AS m FROM lg GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample) FROM counts)),
  sf AS (SELECT sample, exp(quantile_cont(l - m, 0.5)) AS f FROM lg JOIN rf USING (gene_id) GROUP BY 1), nm AS (SELECT counts.*, n / f AS v FROM counts JOIN sf USING (sample))"""


@query("t14_size_factors", f"{SF} SELECT sample, round(f, 6) AS size_factor FROM sf")
def t14(spark, d):
    return rounded(GE.size_factors(I.counts(spark, d)))


@query("t14_fold_changes", f"{SF} SELECT gene_id, round(avg(v), 5) AS base_mean, round(log2(avg(v) FILTER (condition = 'B') / avg(v) FILTER (condition = 'A')), 5) AS log2_fold_change FROM nm GROUP BY 1")
def t14b(spark, d):
    return rounded(GE.fold_changes(I.counts(spark, d), "B", "A"), 5)


def _top_axis(m: str, out: str) -> str:
    """Largest eigenvalue and its vector of the symmetric matrix in table ``m``: squared twelve times, only they are left."""
    steps = [f"{out}0 AS (SELECT m FROM {m})"]
    for i in range(12):
        square = "list_transform(m, lambda r: list_transform(m, lambda c: list_inner_product(r, c)))"
        steps.append(f"{out}{i + 1} AS (SELECT list_transform(q, lambda r: list_transform(r, lambda x: x / t)) AS m FROM (SELECT q, list_max(list_transform(q, lambda r: list_max(list_transform(r, lambda x: abs(x))))) AS t FROM (SELECT {square} AS q FROM {out}{i}) a) b)")
    far = f"(SELECT list_transform(range(1, len(m) + 1), lambda i: {{'d': m[i][i], 'i': i}}) AS d, m FROM {out}12) a"
    steps.append(f"{out}v AS (SELECT list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS v FROM (SELECT m[list_max(d).i] AS c FROM {far}) b)")
    steps.append(f"{out} AS (SELECT v, list_inner_product(v, list_transform(m, lambda r: list_inner_product(r, v))) AS l FROM {out}v, {m})")
    return ", ".join(steps)


AXES = f"""{SF}, lo AS (SELECT gene_id, sample, log2(v + 1) AS v FROM nm), sp AS (SELECT gene_id, sum(v) AS s, sum(v * v) AS q, (SELECT count(DISTINCT sample) FROM counts) AS k FROM lo GROUP BY 1),
  tg AS (SELECT gene_id FROM sp ORDER BY round((q - s * s / k) / (k - 1), 9) DESC, gene_id LIMIT 500),
  gr AS (SELECT gene_id, sample, coalesce(v, 0) AS v FROM tg CROSS JOIN (SELECT DISTINCT sample FROM counts) z LEFT JOIN lo USING (gene_id, sample)),
  ce AS (SELECT gene_id, sample, v - avg(v) OVER (PARTITION BY gene_id) AS v FROM gr),
  pr AS (SELECT a.sample AS a, b.sample AS b, sum(a.v * b.v) AS x FROM ce a JOIN ce b USING (gene_id) GROUP BY 1, 2),
  g1 AS (SELECT list(r ORDER BY a) AS m, list(a ORDER BY a) AS names FROM (SELECT a, list(x ORDER BY b) AS r FROM pr GROUP BY 1) z), {_top_axis('g1', 'e')},
  g2 AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM g1, e), {_top_axis('g2', 'f')},
  tr AS (SELECT list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i])) AS t FROM g1),
  ax AS (SELECT unnest(names) AS sample, unnest(e.v) * sqrt(e.l) AS a, unnest(f.v) * sqrt(f.l) AS b, e.l / t AS sa, f.l / t AS sb FROM g1, e, f, tr),
  sg AS (SELECT sign(arg_max(a, {{'r': round(abs(a), 9), 's': sample}})) AS da, sign(arg_max(b, {{'r': round(abs(b), 9), 's': sample}})) AS db FROM ax)"""


@query("t15_sample_axes", f"{AXES} SELECT sample, round(a * da, 6) AS pc1, round(b * db, 6) AS pc2, round(sa, 6) AS share1, round(sb, 6) AS share2 FROM ax, sg")
def t15(spark, d):
    return rounded(GE.sample_axes(I.counts(spark, d)))


@query("st1_incremental_files", "SELECT event_id, user_id, round(value / 2, 6) AS half FROM events WHERE value > 20")
def st1(spark, d):
    """The job runs over files as they arrive; results of all batches are read back."""
    src, out, chk = (WR.shared_folder(spark, n) for n in ("arrivals", "results", "progress"))
    table(spark, d, "events").select("event_id", "user_id", "value").write.partitionBy().parquet(src)
    job = lambda batch: batch.filter("value > 20").select("event_id", "user_id", F.round(F.col("value") / 2, 6).alias("half"))
    process_new_files(spark, src, "event_id long, user_id long, value double", job, out, chk).awaitTermination()
    return spark.read.parquet(out).drop("batch")
