"""Sources, cleaning, joins and reshaping on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kymora.functions import scalar as S
from kymora.operators import clean as C
from kymora.operators import compare as J
from kymora.operators import ordered as O
from kymora.operators import reshape as R
from kymora.plans import inputs as I
from kymora.plans.registry import query, rounded, table
from kymora.sources import readers as RD
from kymora.sources import writers as WR

# ---------------------------------------------------------------- sources

ORDER_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"


@query(
    "s1_csv_scan",
    "SELECT o_orderstatus, count(*) AS n, count(nullif(o_orderkey % 5, 0)) AS n_priced, "
    "round(sum(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END), 2) AS total FROM orders GROUP BY 1",
)
def s1(spark, d):
    """Written as CSV with NaN holes, read back with a stated schema; NaN arrives as null."""
    o = table(spark, d, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
    )
    path = WR.write_new(o, WR.shared_folder(spark, "csv"), "csv", header=True)
    df = RD.read_table(spark, path, ORDER_SCHEMA)
    return rounded(
        df.groupBy("o_orderstatus").agg(
            F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("n_priced"), F.sum("o_totalprice").alias("total")
        ),
        2,
    )


SAMPLES = [f"s{i}" for i in range(12)]


@query(
    "s2_count_matrix",
    f"WITH {I.COUNTS_SQL}, g AS (SELECT DISTINCT gene_id FROM counts) "
    "SELECT g.gene_id, s.sample, coalesce(c.n, 0) AS n FROM g CROSS JOIN (SELECT 's' || i AS sample FROM range(12) r(i)) s "
    "LEFT JOIN counts c ON c.gene_id = g.gene_id AND c.sample = s.sample",
)
def s2(spark, d):
    c = I.counts(spark, d)
    wide = R.pivot_long(c, ["gene_id"], "sample", SAMPLES, [F.first("n")]).na.fill(0)
    path = WR.write_new(wide, WR.shared_folder(spark, "matrix"), "csv", header=True, sep="\t")
    return RD.read_count_matrix(spark, path, SAMPLES)


@query(
    "s4_files_with_source",
    "SELECT o_orderpriority AS source, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders "
    "WHERE o_orderpriority <> '3-MEDIUM' GROUP BY 1",
)
def s4(spark, d):
    """One folder per group; the folder names the source, one group is excluded by name."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = WR.shared_folder(spark, "files")
    o.write.option("header", True).partitionBy("o_orderpriority").csv(path)
    df = RD.read_table_with_source(spark, path, "o_orderkey long, o_totalprice double", exclude="3-MEDIUM")
    df = df.withColumn("source", F.url_decode("source"))
    return rounded(df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


def _label_export(spark, d):
    """Label rows as an export: documents without a label have no projects."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    lab = O.first_per_key(table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"])
    j = docs.join(lab, "doc_id", "left")
    doc = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    objects = F.expr("transform(filter(sequence(0, quality + toxic), i -> i > 0), i -> named_struct('name', 'egg'))")
    cls = F.array(
        F.struct(
            F.lit("id").alias("name"),
            F.struct(
                F.when(F.col("quality") == 1, "Worm").otherwise("NotWorm").alias("name"),
                F.when(F.col("quality") == 1, "egg").otherwise("not_egg").alias("value"),
            ).alias("radio_answer"),
            F.array().cast("array<struct<name:string>>").alias("checklist_answers"),
        ),
        F.struct(
            F.lit("worm_part").alias("name"),
            F.lit(None).cast("struct<name:string,value:string>").alias("radio_answer"),
            F.when(F.col("toxic") == 1, F.array(F.struct(F.lit("Tail").alias("name")))).alias("checklist_answers"),
        ),
    )
    labels = F.array(F.struct(F.struct(objects.alias("objects"), cls.alias("classifications")).alias("annotations")))
    projects = F.when(F.col("quality").isNotNull(), F.create_map(F.lit("project"), F.struct(labels.alias("labels"))))
    out = j.select(F.struct(doc.alias("external_id")).alias("data_row"), projects.alias("projects"))
    path = WR.write_new(out, WR.shared_folder(spark, "labels"), "json")
    return RD.read_label_export(spark, path)


LAB_SQL = (
    "lab AS (SELECT doc_id, min({'q': quality, 't': toxic}) AS l FROM labels GROUP BY 1), "
    "d AS (SELECT 'doc' || documents.doc_id AS id, l.q AS quality, l.t AS toxic FROM documents LEFT JOIN lab ON lab.doc_id = documents.doc_id)"
)


@query("s6_label_object_counts", f"WITH {LAB_SQL} SELECT id AS image, CAST(coalesce(quality + toxic, 0) AS BIGINT) AS n_objects FROM d")
def s6(spark, d):
    return rounded(RD.count_label_objects(_label_export(spark, d)))


@query(
    "s7_label_classes",
    f"WITH {LAB_SQL} SELECT id AS mask, CASE quality WHEN 1 THEN 'worm' WHEN 0 THEN 'notworm' ELSE '' END AS class, "
    "CASE WHEN toxic = 1 THEN 'tail' WHEN quality = 1 THEN 'whole' ELSE '' END AS part FROM d",
)
def s7(spark, d):
    return RD.label_classes(_label_export(spark, d))


@query(
    "s7_label_answers",
    f"WITH {LAB_SQL} SELECT id AS external_id, CASE quality WHEN 1 THEN 'egg' ELSE 'not_egg' END AS classification "
    "FROM d WHERE quality IS NOT NULL",
)
def s7b(spark, d):
    return RD.label_answers(_label_export(spark, d), "id", ["egg", "not_egg"])


def _records(spark, d):
    v = F.col("vec_id")
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("r"), (v % 7).cast("string")).alias("folder"),
        F.concat(F.lit("rec"), v.cast("string")).alias("id"),
        F.col("label"),
        e.alias("lengths"),
        F.slice(e, 1, 33).alias("psd"),
        F.slice(e, F.lit(1), (v % 10).cast("int")).alias("f"),
    )


REC_SQL = """SELECT 'rec' || vec_id AS id, CAST(label AS BIGINT) AS label, i AS frame,
  round(CAST(embedding[i + 1] AS DOUBLE), 6) AS lengths,
  CASE WHEN i < 33 THEN round(CAST(embedding[i + 1] AS DOUBLE), 6) END AS psd,
  CASE WHEN i < vec_id % 10 THEN round(CAST(embedding[i + 1] AS DOUBLE), 6) END AS f
FROM embeddings, range(64) r(i)"""


@query("s8_flatten_records", REC_SQL)
def s8(spark, d):
    return rounded(RD.flatten_record(_records(spark, d), ["id", "label"], ["lengths", "psd", "f"]))


@query("s9_record_folder", REC_SQL + " WHERE 'r' || (vec_id % 7) IN ('r0', 'r1', 'r2')")
def s9(spark, d):
    """Records written as a table folder and read back, first three folders by name."""
    path = WR.write_new(_records(spark, d), WR.shared_folder(spark, "records"))
    recs = RD.first_folders(spark.read.parquet(path), "folder", 3)
    return rounded(RD.flatten_record(recs, ["id", "label"], ["lengths", "psd", "f"]))


@query("s9_whole_record_folder", REC_SQL)
def s9b(spark, d):
    """All folders."""
    path = WR.write_new(_records(spark, d), WR.shared_folder(spark, "records"))
    return rounded(RD.flatten_record(RD.first_folders(spark.read.parquet(path), "folder"), ["id", "label"], ["lengths", "psd", "f"]))


@query(
    "s10_summary_rows",
    "SELECT l_orderkey AS img_id, l_linenumber::BIGINT AS worm_id, l_quantity AS worm_area_px, l_tax AS radius FROM lineitem",
)
def s10(spark, d):
    li = table(spark, d, "lineitem")
    m = {"l_orderkey": "img_id", "l_linenumber": "worm_id", "l_quantity": "worm_area_px", "l_tax": "radius"}
    return rounded(RD.summary_rows(li, m, ["img_id", "worm_id"]))


@query(
    "s11_frame_inventory",
    """WITH v AS (SELECT user_id AS video_id, max(value) AS m, CAST(floor(max(value)) AS BIGINT) AS total,
         greatest(CAST(floor(30.0 / (1 + user_id % 12)) AS BIGINT), 1) AS step FROM events GROUP BY user_id),
       e AS (SELECT DISTINCT user_id AS video_id, CAST(floor(value) AS BIGINT) AS frame FROM events),
       x AS (SELECT video_id, unnest(range(0, total, step)) AS frame FROM v)
       SELECT video_id, frame, 'missing' AS state FROM (SELECT * FROM x EXCEPT SELECT * FROM e)
       UNION ALL SELECT video_id, frame, 'unexpected' FROM (SELECT * FROM e EXCEPT SELECT * FROM x)""",
)
def s11(spark, d):
    ev = table(spark, d, "events")
    videos = ev.groupBy(F.col("user_id").alias("video_id")).agg(F.floor(F.max("value")).alias("total"))
    seen = ev.select(F.col("user_id").alias("video_id"), F.floor("value").alias("frame"))
    step = RD.frame_interval(F.lit(30.0), 1 + F.col("video_id") % 12)
    return RD.frame_inventory(videos, seen, "total", step)


@query(
    "s12_unprocessed_inputs",
    """SELECT DISTINCT c_custkey AS key FROM customer
       WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
         AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def s12(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "key")
    inputs = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return RD.unprocessed(inputs, o.filter("o_orderstatus = 'P'"), "key", also=o.filter("o_orderstatus = 'F'"))


MEAS_SQL = """m AS (SELECT l_orderkey AS frame, 2 + l_linenumber % 3 AS object_id, avg(l_quantity) AS mean,
       avg(l_quantity) - 10.0 AS bg_corrected, count(*) AS pixel_count FROM lineitem GROUP BY ALL)"""


def _measurements(spark, d):
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("frame"), (2 + F.col("l_linenumber") % 3).alias("object_id"))
        .agg(F.avg("l_quantity").alias("mean"), F.count(F.lit(1)).alias("pixel_count"))
        .withColumn("bg_corrected", F.col("mean") - 10.0)
        .withColumn("background", F.lit(10.0))
    )


@query(
    "s13_wide_measurements",
    f"WITH {MEAS_SQL} SELECT frame, 10.0::DOUBLE AS background, "
    + ", ".join(
        f'round(max(mean) FILTER (object_id = {o}), 6) AS "{o}", round(max(bg_corrected) FILTER (object_id = {o}), 6) AS "{o}_bg_corrected", '
        f'CAST(coalesce(max(pixel_count) FILTER (object_id = {o}), 0) AS BIGINT) AS "{o}_pixel_count"'
        for o in (2, 3, 4)
    )
    + " FROM m GROUP BY frame",
)
def s13(spark, d):
    return rounded(WR.wide_measurements(_measurements(spark, d), ["frame"], "object_id", [2, 3, 4]))


@query(
    "s15_round_trip_differences",
    f"WITH {I.MASKS_SQL}, lost AS (SELECT * FROM mask_pixels WHERE y = 3 AND x = 5) "
    "SELECT video_id, frame::BIGINT AS frame, object_id::BIGINT AS object_id, y::BIGINT AS y, x::BIGINT AS x, 'first' AS side "
    "FROM lost ORDER BY 1, 2, 3, 4, 5 LIMIT 5",
)
def s15(spark, d):
    """Masks written and reloaded, with some pixels lost on the way."""
    px = I.mask_pixels(spark, d)
    path = WR.write_new(px.filter(~((F.col("y") == 3) & (F.col("x") == 5))), WR.shared_folder(spark, "masks"))
    return rounded(WR.differing_rows(px, spark.read.parquet(path), ["video_id", "frame", "object_id", "y", "x"]))


@query(
    "s16_without_prompt_frames",
    f"WITH {I.MASKS_SQL} SELECT video_id, frame, object_id, count(*) AS n FROM mask_pixels p WHERE NOT EXISTS "
    "(SELECT 1 FROM embeddings e WHERE label = 0 AND 'v' || (vec_id // 100) = p.video_id AND (vec_id // 4) % 25 = p.frame) GROUP BY ALL",
)
def s16(spark, d):
    v = F.col("vec_id")
    prompts = (
        table(spark, d, "embeddings")
        .filter("label = 0")
        .select(
            F.concat(F.lit("v"), F.floor(v / 100).cast("string")).alias("video_id"),
            (F.floor(v / 4) % 25).cast("int").alias("frame"),
        )
    )
    kept = WR.without_prompts(I.mask_pixels(spark, d), prompts, ["video_id", "frame"])
    return rounded(kept.groupBy("video_id", "frame", "object_id").agg(F.count(F.lit(1)).alias("n")))


@query("s17_first_occurrences", "SELECT p_name AS line, min(p_partkey) AS line_no, count(*) - 1 AS extra FROM part GROUP BY 1")
def s17(spark, d):
    lines = table(spark, d, "part").select(F.col("p_name").alias("line"), F.col("p_partkey").alias("line_no"))
    unique, repeated = RD.split_duplicates(lines, "line", "line_no")
    return O.null_safe_join(unique, repeated, ["line"]).withColumn("extra", F.coalesce("extra", F.lit(0)))


@query(
    "s18_image_pixels",
    """SELECT vec_id AS image, i // 8 AS y, i % 8 AS x, 0::BIGINT AS channel,
       CAST(CAST(trunc((CAST(embedding[i + 1] AS DOUBLE) + 0.6) * 200.0) AS BIGINT) AS DOUBLE) AS intensity
       FROM embeddings, range(64) r(i)""",
)
def s18(spark, d):
    """Byte images built from the vectors, unpacked as an image scan's rows are."""
    byte = F.transform(
        "embedding", lambda e: F.lpad(F.hex(((e.cast("double") + 0.6) * 200.0).cast("int")), 2, "0")
    )
    img = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("nChannels"),
        F.unhex(F.array_join(byte, "")).alias("data"),
    )
    return rounded(RD.unpack_images(img, ["image"]))


@query("s19_bibliography_entries", "SELECT 'k' || p_partkey AS key, p_brand AS journal FROM part")
def s19(spark, d):
    """One bibliography text per part type, split again into its entries."""
    entry = F.concat(
        F.lit("@article{k"), F.col("p_partkey").cast("string"), F.lit(", title={"), F.col("p_name"),
        F.lit("}, Journal = {"), F.col("p_brand"), F.lit("}}"),
    )
    texts = table(spark, d, "part").select(F.concat(F.lit("\n"), entry, F.lit("\n")).alias("text"))
    return RD.split_entries(texts, "text").select("key", "journal")


@query(
    "a24_frequency_ranking",
    "SELECT p_brand AS journal, count(*) AS n FROM part GROUP BY 1",
)
def a24(spark, d):
    entry = F.concat(F.lit("\n@article{k"), F.col("p_partkey").cast("string"), F.lit(', journal="'), F.col("p_brand"), F.lit('"}'))
    ents = RD.split_entries(table(spark, d, "part").select(entry.alias("text")), "text")
    return ents.groupBy("journal").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "journal")


@query(
    "s20_structure_profile",
    """SELECT 'lengths' AS name, 'array<double>' AS kind, count(*) AS n_records, min(len(embedding)) AS shortest, max(len(embedding)) AS longest, least(3, min(len(embedding))) AS sample_size FROM embeddings
       UNION ALL SELECT 'psd', 'array<double>', count(*), min(len(embedding) // 2 + 1), max(len(embedding) // 2 + 1), least(3, min(len(embedding) // 2 + 1)) FROM embeddings
       UNION ALL SELECT 'f', 'array<double>', count(*), min(vec_id % 10), max(vec_id % 10), 0 FROM embeddings""",
)
def s20(spark, d):
    p = RD.profile_structure(_records(spark, d), ["lengths", "psd", "f"])
    return rounded(p.withColumn("sample_size", F.size("sample")).drop("sample"))


@query(
    "s21_clip_frames",
    f"""WITH {I.SERIES_SQL}, n AS (SELECT subject, count(*) AS total FROM series GROUP BY 1)
    SELECT subject, frame, round(value, 6) AS value FROM series JOIN n USING (subject)
    WHERE frame >= least(15, total - 1) AND frame < least(55, total) AND (frame - least(15, total - 1)) % 3 = 0""",
)
def s21(spark, d):
    s = O.attach_stats(I.series(spark, d), ["subject"], F.count(F.lit(1)).alias("total"))
    out = RD.clip_frames(s, F.lit(10.0), F.lit(1.55), F.lit(4.0), F.col("total"), F.lit(3.0))
    return rounded(out.select("subject", "frame", "value"))


@query(
    "s22_keep_replicates",
    "SELECT p_partkey AS key FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 <> 0",
)
def s22(spark, d):
    rep = F.when(F.col("p_partkey") % 3 == 0, "01a").otherwise("02b")
    ext = F.when(F.col("p_size") % 2 == 0, ".png").otherwise(".txt")
    m = table(spark, d, "part").select(
        F.col("p_partkey").alias("key"), F.concat(F.lit("d1_"), rep, F.lit("_img"), ext).alias("name")
    )
    return RD.keep_replicates(m, "name").select("key")


@query(
    "s23_first_frames",
    """SELECT * FROM (SELECT p_brand AS folder, p_partkey AS frame_number,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS position FROM part) WHERE position <= 6""",
)
def s23(spark, d):
    m = table(spark, d, "part").select(
        F.col("p_brand").alias("folder"), F.concat(F.lit("rec_"), F.col("p_partkey").cast("string"), F.lit(".tif")).alias("name")
    )
    return RD.first_frames(m, "folder", "name", 6).select("folder", "frame_number", "position")


# ---------------------------------------------------------------- projections and filters


@query("p1_keep_and_rename", 'SELECT c_custkey AS worm, c_acctbal AS angle FROM customer')
def p1(spark, d):
    return C.keep_and_rename(table(spark, d, "customer"), {"c_custkey": "worm", "Angle": "loop", "c_acctbal": "angle"})


@query(
    "p2_fill_from_first_row",
    """WITH s AS (SELECT user_id AS file, event_id, CASE WHEN event_id % 4 = 1 THEN event_type END AS worm FROM events),
       f AS (SELECT file, worm AS w0 FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id) rn FROM s) WHERE rn = 1)
       SELECT file, event_id, coalesce(worm, w0) AS worm FROM s JOIN f USING (file)""",
)
def p2(spark, d):
    s = table(spark, d, "events").select(
        F.col("user_id").alias("file"), "event_id", F.when(F.col("event_id") % 4 == 1, F.col("event_type")).alias("worm")
    )
    return C.fill_from_first_row(s, "file", "event_id", ["worm"])


@query("p3_source_tags", "SELECT doc_id, 'sam' AS source, lang AS condition FROM documents")
def p3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lit("sam").alias("source"), F.col("lang").alias("condition"))


@query("p4_frame_base", f"WITH {I.SERIES_SQL} SELECT subject, event_id, frame + 1 AS frame FROM series")
def p4(spark, d):
    return I.series(spark, d).select("subject", "event_id", (F.col("frame") + 1).alias("frame"))


@query(
    "p5_lenient_numbers",
    "SELECT p_partkey AS key, try_cast(CASE WHEN p_size % 5 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS score FROM part",
)
def p5(spark, d):
    raw = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), S.parse_number(raw).alias("score"))


@query("p6_trim_headers", 'SELECT n_nationkey::BIGINT AS "key", n_name AS name FROM nation')
def p6(spark, d):
    df = table(spark, d, "nation").select(F.col("n_nationkey").alias(" key "), F.col("n_name").alias("name  "), F.lit(1).alias("feedback"))
    return rounded(C.trim_headers(df, ["feedback", "absent"]))


@query("p7_drop_null_rows", "SELECT event_id, value AS human FROM events WHERE event_id % 3 <> 0")
def p7(spark, d):
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("human"))
    return df.na.drop(subset=["human"])


@query("p8_grid_cell", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'")
def p8(spark, d):
    li = table(spark, d, "lineitem").filter((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"))
    return rounded(li.select("l_orderkey", "l_linenumber", "l_quantity"))


@query("p9_negated_flag", "SELECT event_id FROM events WHERE NOT (value > 20.0)")
def p9(spark, d):
    df = table(spark, d, "events").withColumn("z_axis_turn", F.col("value") > 20.0)
    return df.filter(~F.col("z_axis_turn")).select("event_id")


@query("p10_frame_window", f"WITH {I.SERIES_SQL} SELECT subject, frame, event_id FROM series WHERE frame BETWEEN 40 AND 45")
def p10(spark, d):
    return I.series(spark, d).filter(F.col("frame").between(40, 45)).select("subject", "frame", "event_id")


@query("p11_threshold_then_group", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value >= 1 AND value < 40 GROUP BY 1")
def p11(spark, d):
    ev = table(spark, d, "events").filter((F.col("value") >= 1) & (F.col("value") < 40))
    return rounded(ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@query("p12_abs_threshold", "SELECT event_id FROM events WHERE abs((value * 7.0) % 240.0 - 120.0) > 90")
def p12(spark, d):
    return I.readings(spark, d).filter(F.abs("angle") > 90).select("event_id")


@query(
    "p13_significant_single_letter",
    f"WITH {I.DE_SQL} SELECT gene, comparison_condition, reference_condition, pvalue FROM de "
    "WHERE length(comparison_condition) = 1 AND length(reference_condition) = 1 AND pvalue < 0.05",
)
def p13(spark, d):
    de = I.gene_results(spark, d)
    one = (F.length("comparison_condition") == 1) & (F.length("reference_condition") == 1)
    return de.filter(one & (F.col("pvalue") < 0.05)).select("gene", "comparison_condition", "reference_condition", "pvalue")


@query(
    "p14_drop_listed_pairs",
    "SELECT conv_id, turn, role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = c.turn AND length(x.text) % 3 = 0)",
)
def p14(spark, d):
    c = table(spark, d, "conversations")
    return C.drop_listed(c, c.filter(F.length("text") % 3 == 0), ["conv_id", "turn"]).select("conv_id", "turn", "role")


SIDE = "CASE user_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END"


def _side():
    return F.when(F.col("subject") % 3 == 0, "left").when(F.col("subject") % 3 == 1, "right")


@query(
    "p15_ventral_sign",
    "SELECT event_id, round(CASE WHEN user_id % 2 = 0 THEN -1 ELSE 1 END * ((value * 7.0) % 240.0 - 120.0), 6) + 0.0 AS angle FROM events",
)
def p15(spark, d):
    ventral = F.when(F.col("subject") % 2 == 0, -1).otherwise(1)
    return rounded(I.readings(spark, d).select("event_id", S.ventral_corrected(F.col("angle"), ventral).alias("angle")))


@query(
    "p16_side_sign",
    f"SELECT event_id, round(CASE WHEN {SIDE} = 'right' THEN -1 ELSE 1 END * ((value * 7.0) % 240.0 - 120.0), 6) AS angle FROM events",
)
def p16(spark, d):
    return rounded(I.readings(spark, d).select("event_id", S.side_corrected(F.col("angle"), _side()).alias("angle")))


@query(
    "p17_unified_angles",
    f"SELECT event_id, round(CASE WHEN {SIDE} = 'left' THEN 180 - value ELSE value END, 6) AS human, "
    "round(value / 100.0 * 90 + 90, 6) AS fiji, round((value * 7.0) % 240.0 - 120.0 + 90, 6) AS sam FROM events",
)
def p17(spark, d):
    r = I.readings(spark, d)
    return rounded(
        r.select(
            "event_id",
            S.unify_human_angle(F.col("value"), _side()).alias("human"),
            S.unify_scaled_angle(F.col("value") / 100.0).alias("fiji"),
            S.unify_shifted_angle(F.col("angle")).alias("sam"),
        )
    )


@query(
    "p18_angle_differences",
    "SELECT event_id, round(value - value / 2, 6) AS human_fiji, round(value - (value * 7.0) % 240.0, 6) AS human_sam FROM events",
)
def p18(spark, d):
    r = I.readings(spark, d).select("event_id", "value", (F.col("value") / 2).alias("fiji"), (F.col("value") * 7.0 % 240.0).alias("sam"))
    out = J.angle_differences(r, {"human_fiji": ("value", "fiji"), "human_sam": ("value", "sam")})
    return rounded(out.select("event_id", "human_fiji", "human_sam"))


BIN45 = "CASE WHEN value BETWEEN 0 AND 180 THEN CAST(greatest(1, ceil(value / 45.0)) AS BIGINT) END"
BIN30 = "CASE WHEN value BETWEEN 0 AND 180 THEN CAST(greatest(1, ceil(value / 30.0)) AS BIGINT) END"


@query("p19_angle_bins", f"SELECT event_id, {BIN45} AS bin45, {BIN30} AS bin30 FROM events")
def p19(spark, d):
    return table(spark, d, "events").select(
        "event_id", S.angle_bin(F.col("value"), 45.0).alias("bin45"), S.angle_bin(F.col("value"), 30.0).alias("bin30")
    )


CATEGORY = "CASE WHEN a BETWEEN -10 AND 10 THEN 'straight' WHEN a < -10 THEN 'in odor' WHEN a > 10 THEN 'in buffer' END"


@query("p20_odor_category", f"SELECT event_id, {CATEGORY} AS category FROM (SELECT event_id, (value * 7.0) % 240.0 - 120.0 AS a FROM events)")
def p20(spark, d):
    return I.readings(spark, d).select("event_id", S.odor_category(F.col("angle")).alias("category"))


@query(
    "p21_ratio_metrics",
    """SELECT l_orderkey, l_quantity, l_extendedprice, round(CASE WHEN l_tax <> 0 THEN l_discount / (l_tax / 2) END, 6) AS ratio,
       round(CASE WHEN l_tax <> 0 THEN (l_discount - l_tax) / l_tax END, 6) AS excess FROM lineitem""",
)
def p21(spark, d):
    return rounded(
        table(spark, d, "lineitem").select(
            "l_orderkey", "l_quantity", "l_extendedprice",
            S.amplitude_ratio(F.col("l_discount"), F.col("l_tax")).alias("ratio"),
            S.wavelength_excess(F.col("l_discount"), F.col("l_tax")).alias("excess"),
        )
    )


@query("p22_scale_and_clip", "SELECT event_id, round(greatest(0.0, least(1.0, (value - 5) / 50.0 / 0.5)), 6) AS scaled FROM events")
def p22(spark, d):
    x = (F.col("value") - 5) / 50.0
    return rounded(table(spark, d, "events").select("event_id", S.scaled_clip(x, 0.5).alias("scaled")))


@query(
    "p23_volcano_distance",
    f"WITH {I.DE_SQL} SELECT gene, comparison_condition, reference_condition, "
    "CASE WHEN pvalue = 0 THEN NULL ELSE round(sqrt(lfc * lfc + log10(pvalue) * log10(pvalue)), 6) END AS distance, pvalue = 0 AS infinite FROM de",
)
def p23(spark, d):
    de = I.gene_results(spark, d)
    dist = S.volcano_distance(F.col("lfc"), F.col("pvalue"))
    inf = dist == float("inf")
    return rounded(
        de.select("gene", "comparison_condition", "reference_condition", F.when(~inf, dist).alias("distance"), inf.alias("infinite"))
    )


@query("p24_required_columns", "SELECT s_suppkey, 0.0::DOUBLE AS wave_number, s_acctbal FROM supplier")
def p24(spark, d):
    df = C.ensure_columns(table(spark, d, "supplier"), ["s_acctbal", "wave_number"])
    return df.select("s_suppkey", "wave_number", "s_acctbal")


@query("p25_row_count_check", "SELECT user_id AS file, count(*) AS n_rows FROM events GROUP BY 1 HAVING count(*) <> 65")
def p25(spark, d):
    return C.unexpected_row_counts(table(spark, d, "events").withColumnRenamed("user_id", "file"), "file", 65)


LAG_SQL = f"""WITH {I.SERIES_SQL}, p AS (SELECT *, lag(angle) OVER (PARTITION BY subject ORDER BY frame) AS prev, frame % 3 = 0 AS bent FROM series)"""


@query("p26_frame_jumps", LAG_SQL + " SELECT subject, frame, round(abs(angle - prev), 6) AS change FROM p WHERE abs(angle - prev) > 30")
def p26(spark, d):
    return rounded(C.frame_jumps(I.series(spark, d), ["subject"], "frame", "angle").select("subject", "frame", "change"))


@query(
    "p27_impossible_switches",
    LAG_SQL
    + """ SELECT subject, frame, coalesce(prev * angle < 0 AND ((least(abs(prev), abs(angle)) > 30 AND abs(angle - prev) > 120)
          OR (least(abs(prev), abs(angle)) > 45 AND abs(angle - prev) > 90)), false) AS impossible,
          coalesce(abs(angle - prev) > 150, false) AS extreme FROM p""",
)
def p27(spark, d):
    p = C.with_previous(I.series(spark, d), ["subject"], "frame", "angle")
    prev, cur = F.col("prev"), F.col("angle")
    return p.select(
        "subject", "frame", S.forced_switch(prev, cur).alias("impossible"),
        F.coalesce(F.abs(cur - prev) > 150, F.lit(False)).alias("extreme"),
    )


@query(
    "p28_continuity_score",
    LAG_SQL
    + """, c AS (SELECT *, abs(angle - prev) AS ch, least(abs(prev), abs(angle)) AS sm,
            CASE WHEN bent THEN CASE WHEN abs(prev) > 60 THEN 25 ELSE 40 END ELSE 20 END AS allowed FROM p)
       SELECT subject, frame, round(CASE WHEN prev IS NULL THEN 0 ELSE
          (CASE WHEN ch <= allowed THEN allowed - ch WHEN ch - allowed > 50 THEN -3 * (ch - allowed) ELSE -2 * (ch - allowed) END)
          - (CASE WHEN prev * angle < 0 AND sm > 45 AND ch > 90 THEN 200 WHEN prev * angle < 0 AND sm > 30 AND ch > 60 THEN 100 ELSE 0 END) END, 6) AS score,
        CAST(CASE WHEN bent THEN CASE WHEN abs(angle) > 120 THEN 50 WHEN abs(angle) > 100 THEN 40 WHEN abs(angle) > 90 THEN 30 WHEN abs(angle) > 70 THEN 15
             WHEN abs(angle) < 50 THEN -60 WHEN abs(angle) < 70 THEN -30 ELSE 0 END
             ELSE CASE WHEN abs(angle) > 120 THEN -40 WHEN abs(angle) > 90 THEN -15 ELSE 0 END END AS BIGINT) AS bonus FROM c""",
)
def p28(spark, d):
    p = C.with_previous(I.series(spark, d), ["subject"], "frame", "angle")
    bent = F.col("frame") % 3 == 0
    return rounded(
        p.select(
            "subject", "frame", S.continuity_score(F.col("prev"), F.col("angle"), bent).alias("score"),
            S.bend_bonus(F.col("angle"), bent).alias("bonus"),
        )
    )


@query(
    "p29_bent_scaling",
    """WITH r AS (SELECT event_id, (value * 7.0) % 240.0 - 120.0 AS a, user_id % 2 = 0 AS bent FROM events),
       b AS (SELECT *, CASE WHEN abs(a * 1.6) > 5 THEN a * 1.6 ELSE a END AS t FROM r)
       SELECT event_id, round(CASE WHEN bent AND abs(a) < 60 THEN greatest(-160.0, least(160.0, a * least(90.0 / greatest(abs(a), 30.0), 2.5))) ELSE a END, 6) AS lifted,
         round(CASE WHEN NOT bent THEN a WHEN abs(t) <= 20 THEN t ELSE greatest(-175.0, least(175.0, t * CASE WHEN abs(t) > 80 THEN 1.4 WHEN abs(t) > 60 THEN 1.6 WHEN abs(t) > 40 THEN 1.8 ELSE 2.0 END)) END, 6) AS alternative FROM b""",
)
def p29(spark, d):
    bent = F.col("subject") % 2 == 0
    return rounded(
        I.readings(spark, d).select(
            "event_id", S.bent_scaled(F.col("angle"), bent).alias("lifted"), S.bent_alternative(F.col("angle"), bent).alias("alternative")
        )
    )


@query(
    "p30_diagnostic_issues",
    LAG_SQL
    + """ SELECT subject, frame, issue FROM (
          SELECT subject, frame, CASE WHEN abs(angle - prev) > 20 THEN 'Large angle change' END AS issue FROM p UNION ALL
          SELECT subject, frame, CASE WHEN prev * angle < 0 THEN 'Possible orientation flip' END FROM p UNION ALL
          SELECT subject, frame, CASE WHEN value < 5 OR coalesce(k, 0) < 5 THEN 'Small vector magnitude' END FROM p) WHERE issue IS NOT NULL""",
)
def p30(spark, d):
    p = C.with_previous(I.series(spark, d), ["subject"], "frame", "angle")
    change = F.abs(F.col("angle") - F.col("prev"))
    out = C.diagnostic_issues(p, change, F.col("prev") * F.col("angle") < 0, F.col("value"), F.col("k"))
    return out.select("subject", "frame", "issue")


@query(
    "p31_severity",
    "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN abs(a) < 80 THEN 'problematic' WHEN abs(a) > 90 THEN 'good' ELSE 'borderline' END AS tier "
    "FROM (SELECT (value * 7.0) % 240.0 - 120.0 AS a FROM events)) GROUP BY 1",
)
def p31(spark, d):
    return I.readings(spark, d).groupBy(S.severity(F.col("angle")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p32_edge_touch",
    """SELECT p_partkey AS key, (x = 0 OR y = 0 OR x + w = 60 OR y + h = 60) AS strict, (x <= 0 OR y <= 0 OR x + w >= 59 OR y + h >= 59) AS tolerant
       FROM (SELECT p_partkey, p_size - 1 AS x, p_partkey % 40 AS y, p_partkey % 13 AS w, p_size % 22 AS h FROM part)""",
)
def p32(spark, d):
    b = table(spark, d, "part").select(
        F.col("p_partkey").alias("key"), (F.col("p_size") - 1).alias("x"), (F.col("p_partkey") % 40).alias("y"),
        (F.col("p_partkey") % 13).alias("w"), (F.col("p_size") % 22).alias("h"),
    )
    box = [F.col(c) for c in "xywh"] + [F.lit(60), F.lit(60)]
    return b.select("key", S.touches_edge_strict(*box).alias("strict"), S.touches_edge(*box).alias("tolerant"))


@query(
    "p33_near_crop_edge",
    """SELECT key, ((abs(x0 + 40 - 40) <= 20 AND NOT abs(x0 + 40) <= 20) OR (abs(y0 + 10 - 10) <= 20 AND NOT abs(y0 + 10) <= 20)
         OR (abs(x1 + 40 - 240) <= 20 AND NOT abs(x1 + 40 - 300) <= 20) OR (abs(y1 + 10 - 210) <= 20 AND NOT abs(y1 + 10 - 220) <= 20)) AS near_edge
       FROM (SELECT p_partkey AS key, p_partkey % 97 AS x0, p_size AS y0, p_partkey % 97 + p_size * 3 AS x1, p_size + p_partkey % 180 AS y1 FROM part)""",
)
def p33(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    box = [k % 97, s, k % 97 + s * 3, s + k % 180]
    crop = [F.lit(v) for v in (40, 10, 240, 210)]
    image = [F.lit(v) for v in (0, 0, 300, 220)]
    return table(spark, d, "part").select(k.alias("key"), S.near_crop_edge(box, crop, image).alias("near_edge"))


@query("p34_quality_filters", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0.08 AND l_tax >= 0.05")
def p34(spark, d):
    li = table(spark, d, "lineitem").filter((F.col("l_discount") > 0.08) & (F.col("l_tax") >= 0.05))
    return li.select("l_orderkey", "l_partkey")


PROFILE = "[10.0 + 40.0 * CAST(x AS DOUBLE) for x in embedding]"


def _profile():
    return F.transform("embedding", lambda x: 10.0 + 40.0 * x.cast("double"))


FOLD_SQL = f"""prof AS (SELECT vec_id, label, {PROFILE} AS w FROM embeddings),
  fold AS (SELECT vec_id, label, w, NOT ((w[1] + w[2] + w[3]) / 3 < w[33] * 0.95 AND (w[61] + w[62] + w[63]) / 3 < w[33] * 0.95) AS folded FROM prof)"""


@query("p36_folded_test", f"WITH {FOLD_SQL} SELECT vec_id, folded FROM fold")
def p36(spark, d):
    return table(spark, d, "embeddings").select("vec_id", C.is_folded(_profile(), 0.05).alias("folded"))


@query(
    "p35_shape_check",
    f"""WITH {FOLD_SQL}, pts AS (SELECT vec_id, i, w[i] AS v, w FROM fold, range(2, 64) r(i) WHERE w[i] > w[i - 1] AND w[i] > w[i + 1]),
    prom AS (SELECT vec_id, v - greatest(
        least(v, coalesce((SELECT min(w[j]) FROM range(1, 65) q(j) WHERE j < i AND NOT EXISTS (SELECT 1 FROM range(1, 65) z(m) WHERE m >= j AND m < i AND w[m] > v)), v)),
        least(v, coalesce((SELECT min(w[j]) FROM range(1, 65) q(j) WHERE j > i AND NOT EXISTS (SELECT 1 FROM range(1, 65) z(m) WHERE m <= j AND m > i AND w[m] > v)), v))) AS p FROM pts),
    mx AS (SELECT vec_id, max(p) AS p FROM prom GROUP BY 1)
    SELECT f.vec_id, CASE WHEN label = 1 THEN 'many masks' WHEN label = 2 THEN 'pinhole' WHEN folded THEN 'folded' WHEN coalesce(mx.p, 0) >= 20 THEN 'merged' ELSE 'normal' END AS verdict
    FROM fold f LEFT JOIN mx USING (vec_id)""",
)
def p35(spark, d):
    w = _profile()
    verdict = C.shape_check(
        F.when(F.col("label") == 1, 2).otherwise(1), F.col("label") == 2, C.is_folded(w, 0.05), C.has_prominent_peak(w, 20.0)
    )
    return table(spark, d, "embeddings").select("vec_id", verdict.alias("verdict"))


# ---------------------------------------------------------------- text functions


@query(
    "f1_subject_names",
    """SELECT c_custkey AS key, CASE WHEN c_custkey = 7 THEN 'renamed' ELSE 'MMH' || c_custkey || '_10s' END AS subject FROM customer""",
)
def f1(spark, d):
    raw = F.concat(F.lit("AG_WT-"), F.when(F.col("c_custkey") % 2 == 0, "MMG").otherwise("MMH"), F.col("c_custkey").cast("string"), F.lit("_10s_crop_x"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), S.clean_subject_name(raw, {"MMH7_10s": "renamed"}).alias("subject")
    )


@query(
    "f2_file_parts",
    "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS viscosity, split_part(o_orderpriority, '-', 2) AS condition, o_orderstatus AS id FROM orders",
)
def f2(spark, d):
    v, c, i = S.file_parts(F.concat(F.lit("dir/"), F.col("o_orderpriority"), F.lit("-"), F.col("o_orderstatus")))
    return table(spark, d, "orders").select("o_orderkey", v.alias("viscosity"), c.alias("condition"), i.alias("id"))


@query("f3_prefix", "SELECT p_partkey AS key, split_part(p_name, ' ', 1) AS strain FROM part")
def f3(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), S.text_before(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("strain"))


@query(
    "f4_recording_ids",
    """SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN 'r' || p_partkey || '_03' WHEN 1 THEN 'r' || p_partkey || '_03'
         WHEN 2 THEN 'plain' ELSE 'AG' END AS video_id FROM part""",
)
def f4(spark, d):
    r = F.concat(F.lit("r"), F.col("p_partkey").cast("string"), F.lit("_03"))
    name = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("AG_WT-"), r, F.lit(S.COMBINED_SUFFIX)))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("AG_WT-"), r, F.lit(S.COMBINED_MARK + "_v2" + S.GENERIC_SUFFIX)))
        .when(F.col("p_partkey") % 4 == 2, F.lit("plain" + S.COMBINED_SUFFIX))
        .otherwise(F.concat(F.lit("AG_"), r, F.lit(".csv")))
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), S.recording_of_combined_file(F.concat(F.lit("a/"), name)).alias("video_id"))


@query("f5_sample_names", "SELECT s_suppkey, s_name AS sample FROM supplier")
def f5(spark, d):
    p = F.concat(F.lit("bam.v2."), F.col("s_name"), F.lit("_sorted.bam"))
    return table(spark, d, "supplier").select("s_suppkey", S.sample_of_path(p).alias("sample"))


@query("f6_condition_pairs", "SELECT DISTINCT l_returnflag AS comparison, l_linestatus AS reference, l_returnflag || '_' || l_linestatus AS pair FROM lineitem")
def f6(spark, d):
    name = F.concat(F.lit("res_"), F.col("l_returnflag"), F.lit("_vs_"), F.col("l_linestatus"), F.lit(".csv"))
    c, r = S.condition_pair(name)
    return table(spark, d, "lineitem").select(c.alias("comparison"), r.alias("reference"), F.concat_ws("_", c, r).alias("pair")).distinct()


@query(
    "f7_name_edits",
    "SELECT p_partkey AS key, regexp_replace(p_name, '[aeiou]', '#') AS first_replaced, replace(p_name, ' ', '_') AS joined, lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.jpg' AS file FROM part",
)
def f7(spark, d):
    n = F.col("p_name")
    first = F.regexp_replace(n, r"^([^aeiou]*)[aeiou]", "$1#")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("key"), first.alias("first_replaced"), F.translate(n, " ", "_").alias("joined"),
        F.concat(F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".jpg")).alias("file"),
    )


@query("f8_bytes_literals", "SELECT event_id, event_type AS shape FROM events")
def f8(spark, d):
    raw = F.concat(F.lit("b'"), F.col("event_type"), F.lit("'"))
    return table(spark, d, "events").select("event_id", S.decode_bytes_literal(raw).alias("shape"))


@query(
    "f9_array_literals",
    """SELECT vec_id, 64::BIGINT AS n, round(list_sum([round(CAST(x AS DOUBLE), 6) for x in embedding]) / 64, 6) AS mean,
       round(list_max([round(CAST(x AS DOUBLE), 6) for x in embedding]), 6) AS top FROM embeddings""",
)
def f9(spark, d):
    """Arrays printed as text and parsed back, then reduced."""
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: F.format_string("%.6f", x.cast("double"))), "  "), F.lit("]"))
    a = S.parse_array_literal(text)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return rounded(
        table(spark, d, "embeddings").select("vec_id", F.size(a).alias("n"), (total / F.size(a)).alias("mean"), F.array_max(a).alias("top"))
    )


# ---------------------------------------------------------------- joins


def _apart(same, frame="frame"):
    """The frame where ``same`` holds, else one that no other row has, so that all rows enter the join."""
    return F.when(same, F.col(frame)).otherwise(-1 - F.col(frame)).alias(frame)


def _three(spark, d):
    ev = table(spark, d, "events")
    k = F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("user_id"))
    base = ev.select(k.alias("worm"), F.col("event_id").alias("frame"), "value")
    other = base.select("worm", _apart(F.col("frame") % 3 == 0), (F.col("value") * 2).alias("fiji"))
    third = base.select("worm", _apart(F.col("frame") % 2 == 0), (F.col("value") + 1).alias("sam"))
    return base, other, third


EV3 = "b AS (SELECT CASE WHEN event_id % 11 <> 0 THEN user_id END AS worm, event_id AS frame, value FROM events)"


@query(
    "j1_chained_left_joins",
    f"WITH {EV3} SELECT worm, frame, value, CASE WHEN frame % 3 = 0 THEN value * 2 END AS fiji, CASE WHEN frame % 2 = 0 THEN value + 1 END AS sam FROM b",
)
def j1(spark, d):
    base, other, third = _three(spark, d)
    return J.left_join_chain(base, [other, third], ["worm", "frame"])


@query(
    "j2_full_join_suffixes",
    """SELECT coalesce(a.frame, b.frame) AS frame, a.v AS mean_sam_data, b.v AS mean_fiji_data FROM
       (SELECT event_id AS frame, value AS v FROM events) a FULL JOIN
       (SELECT CASE WHEN event_id % 2 = 0 THEN event_id ELSE -1 - event_id END AS frame, value * 2 AS v FROM events) b ON a.frame = b.frame""",
)
def j2(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("frame"), F.col("value").alias("mean"))
    b = ev.select(_apart(F.col("frame") % 2 == 0), (F.col("mean") * 2).alias("mean"))
    return J.suffix_join(ev, b, ["frame"], ("_sam_data", "_fiji_data"))


@query(
    "j3_overwrite_join",
    "SELECT event_id AS frame, user_id, CASE WHEN event_id % 2 = 0 THEN -value END AS angle FROM events",
)
def j3(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("frame"), "user_id", F.col("value").alias("angle"))
    new = ev.select(_apart(F.col("frame") % 2 == 0), (-F.col("angle")).alias("angle"))
    return J.overwrite_join(ev, new, ["frame"])


@query(
    "j4_fill_join",
    "SELECT o_orderkey, o_totalprice, c.c_mktsegment FROM orders LEFT JOIN customer c ON c.c_custkey = o_orderkey",
)
def j4(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.col("c_acctbal").alias("o_totalprice"), "c_mktsegment")
    return J.fill_join(o, c, ["o_orderkey"])


@query(
    "j5_paired_join",
    """WITH a AS (SELECT user_id, event_id, value FROM events),
       b AS (SELECT CASE WHEN user_id % 2 = 0 THEN user_id ELSE -1 - user_id END AS user_id, CASE WHEN event_id % 5 <> 0 THEN event_id ELSE -1 - event_id END AS event_id, value * 3 AS angle FROM events)
       SELECT a.user_id AS core_name, a.event_id AS frame, a.value, b.angle FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.event_id = b.event_id
       WHERE a.user_id IN (SELECT user_id FROM b)""",
)
def j5(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("core_name"), F.col("event_id").alias("frame"), "value")
    b = ev.select(_apart(F.col("core_name") % 2 == 0, "core_name"), _apart(F.col("frame") % 5 != 0), (F.col("value") * 3).alias("angle"))
    return J.paired_join(ev, b, "core_name", "frame", ["angle"])


@query(
    "j6_aggregate_back_join",
    "SELECT o_orderkey, o_custkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS mean_price, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
)
def j6(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = O.attach_stats(o, ["o_custkey"], F.avg("o_totalprice").alias("mean_price"), F.count(F.lit(1)).alias("n"))
    return rounded(out.select("o_orderkey", "o_custkey", "mean_price", "n"))


@query(
    "j7_annotation_lookup",
    f"WITH {I.DE_SQL} SELECT gene, comparison_condition, reference_condition, p_name AS gene_name, p_type AS description FROM de "
    "LEFT JOIN part ON gene = CASE WHEN p_size > 10 THEN 'g' ELSE 'no-' END || p_partkey",
)
def j7(spark, d):
    known = F.when(F.col("p_size") > 10, "g").otherwise("no-")
    ann = table(spark, d, "part").select(
        F.concat(known, F.col("p_partkey").cast("string")).alias("gene"), F.col("p_name").alias("gene_name"), F.col("p_type").alias("description")
    )
    de = I.gene_results(spark, d).select("gene", "comparison_condition", "reference_condition")
    return O.null_safe_join(de, ann, ["gene"])


@query(
    "j8_not_repeated",
    f"""WITH {I.DE_SQL}, s AS (SELECT CASE WHEN gene LIKE '%7' THEN NULL ELSE gene END AS gene, comparison_condition, reference_condition, pvalue FROM de WHERE pvalue < 0.05),
     r AS (SELECT gene FROM s GROUP BY 1 HAVING count(*) > 1)
     SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.gene IS NOT DISTINCT FROM s.gene)""",
)
def j8(spark, d):
    s = I.gene_results(spark, d).filter("pvalue < 0.05")
    s = s.withColumn("gene", F.when(~F.col("gene").endswith("7"), F.col("gene"))).select("gene", "comparison_condition", "reference_condition", "pvalue")
    repeated = s.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return O.null_safe_join(s, repeated, ["gene"], "left_anti")


@query("j9_reorder_by_key", f"WITH {I.DE_SQL} SELECT gene, min(pvalue) AS padj FROM de GROUP BY 1")
def j9(spark, d):
    return I.gene_results(spark, d).groupBy("gene").agg(F.min("pvalue").alias("padj")).orderBy(F.col("padj").asc_nulls_last(), "gene")


@query(
    "j10_inner_alignment",
    "SELECT l_orderkey AS frame, o_totalprice, max(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
)
def j10(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.max("l_quantity").alias("q"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame"), "o_totalprice")
    return li.join(o, "frame")


@query(
    "j11_column_bind",
    """WITH c AS (SELECT c_custkey + 1 AS frame, c_acctbal FROM customer), s AS (SELECT s_suppkey + 1 AS frame, s_acctbal FROM supplier)
       SELECT coalesce(c.frame, s.frame) AS frame, c_acctbal AS fiji_nrd_mean, s_acctbal AS fiji_nrv_mean FROM c FULL JOIN s ON c.frame = s.frame""",
)
def j11(spark, d):
    """Row position comes from the order of the key, counted per bucket of keys."""
    def file(name, key, value):
        df = table(spark, d, name).select(key, F.col(value).alias("mean"))
        return O.with_sorted_index(df, [], [key], "frame", 1).drop(key)

    return J.bind_columns({"fiji_nrd": file("customer", "c_custkey", "c_acctbal"), "fiji_nrv": file("supplier", "s_suppkey", "s_acctbal")}, "frame")


@query(
    "j21_paired_examples",
    """SELECT user_id AS worm, CAST(floor(value) AS BIGINT) AS frame, event_type AS source, count(*) AS n FROM events e WHERE event_type IN ('view', 'click')
       AND EXISTS (SELECT 1 FROM events a WHERE a.user_id = e.user_id AND floor(a.value) = floor(e.value) AND a.event_type = 'view')
       AND EXISTS (SELECT 1 FROM events a WHERE a.user_id = e.user_id AND floor(a.value) = floor(e.value) AND a.event_type = 'click') GROUP BY ALL""",
)
def j21(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("worm"), F.floor("value").alias("frame"), F.col("event_type").alias("source"))
    out = J.paired_examples(ev, "worm", "frame", "source", "view", "click")
    return out.groupBy("worm", "frame", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j22_class_lookup",
    "SELECT o_orderkey, coalesce(c_mktsegment, 'background') AS class FROM orders LEFT JOIN customer ON 'c' || c_custkey || '_f' = 'c' || (o_orderkey % 2000) || '_f'",
)
def j22(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    t = table(spark, d, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("_f")).alias("key"), F.col("c_mktsegment").alias("class")
    )
    key = F.concat(F.lit("c"), (F.col("o_orderkey") % 2000).cast("string"), F.lit("_f"))
    return J.lookup_or(o, t, key, "key", "class", "background").select("o_orderkey", "class")


# ---------------------------------------------------------------- sort, sets, reshape


@query("o1_multi_key_sort", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def o1(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy(
        "o_orderstatus", F.col("o_totalprice").desc_nulls_last(), "o_orderkey"
    )


@query("o2_value_last", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def o2(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(*R.last_value_order("o_orderpriority", "2-HIGH"))


@query(
    "o3_top_per_group",
    """SELECT o_orderstatus, o_orderkey, rank FROM (SELECT o_orderstatus, o_orderkey,
       row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10""",
)
def o3(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice").withColumn("part", F.col("o_orderkey") % 64)
    out = R.top_per_group(o, ["o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10, pre=["part"])
    return rounded(out.select("o_orderstatus", "o_orderkey", "rank"))


@query(
    "o4_extreme_rows",
    "SELECT user_id, arg_max(event_id, {'v': value, 'e': -event_id}) AS fastest, arg_min(event_id, {'v': value, 'e': event_id}) AS slowest FROM events GROUP BY 1",
)
def o4(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("fastest"),
        F.min_by("event_id", F.struct("value", "event_id")).alias("slowest"),
    )


@query(
    "o7_first_per_key",
    "SELECT l_orderkey, min({'q': l_quantity, 'p': l_extendedprice}).q AS l_quantity, min({'q': l_quantity, 'p': l_extendedprice}).p AS l_extendedprice FROM lineitem GROUP BY 1",
)
def o7(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    return O.first_per_key(li, ["l_orderkey"], ["l_quantity", "l_extendedprice"])


@query(
    "o8_union_unlike",
    "SELECT c_custkey AS key, c_acctbal AS fiji, NULL::VARCHAR AS side FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier",
)
def o8(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("fiji"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("side"))
    return R.union_tables(a, b)


@query(
    "o9_key_sets",
    """SELECT key, CASE WHEN o THEN CASE WHEN c THEN 'both' ELSE 'only orders' END ELSE 'only customers' END AS side FROM
       (SELECT key, bool_or(s = 1) AS o, bool_or(s = 2) AS c FROM (SELECT o_custkey AS key, 1 AS s FROM orders UNION ALL SELECT c_custkey, 2 FROM customer) GROUP BY 1)""",
)
def o9(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return (
        o.intersect(c).withColumn("side", F.lit("both"))
        .union(o.subtract(c).withColumn("side", F.lit("only orders")))
        .union(c.subtract(o).withColumn("side", F.lit("only customers")))
    )


@query(
    "o10_flagged_union",
    "SELECT user_id, event_id FROM events WHERE value > 100 UNION SELECT user_id, event_id FROM events WHERE event_type = 'error' UNION SELECT user_id, event_id FROM events WHERE value < 1",
)
def o10(spark, d):
    ev = table(spark, d, "events")
    k = ["user_id", "event_id"]
    return ev.filter("value > 100").select(*k).union(ev.filter("event_type = 'error'").select(*k)).union(ev.filter("value < 1").select(*k)).distinct()


KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "o11_long_to_wide",
    "SELECT user_id, "
    + ", ".join(f"round(avg(value) FILTER (event_type = '{k}'), 6) AS {k}_mean, count(*) FILTER (event_type = '{k}') AS {k}_count" for k in KINDS)
    + " FROM events GROUP BY 1",
)
def o11(spark, d):
    wide = R.pivot_long(
        table(spark, d, "events"), ["user_id"], "event_type", KINDS, [F.avg("value").alias("mean"), F.count(F.lit(1)).alias("count")]
    )
    return rounded(wide.na.fill(0, [f"{k}_count" for k in KINDS]))


@query("o14_profile_rows", "SELECT vec_id AS img_id, CAST(label AS BIGINT) AS worm_id, i AS location, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS radius FROM embeddings, range(64) r(i)")
def o14(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("img_id"), F.col("label").alias("worm_id"), "embedding")
    return rounded(R.explode_profile(e, ["img_id", "worm_id"], "embedding", "location", "radius"))


@query("o15_group_to_list", "SELECT p_brand AS image, list_sort(list_distinct(list(p_type))) AS masks FROM part GROUP BY 1")
def o15(spark, d):
    """Lists of a bounded value set: the distinct types of a brand."""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("image")).agg(F.sort_array(F.collect_set("p_type")).alias("masks"))


@query("o16_sample", "SELECT event_id, user_id FROM events ORDER BY ((event_id + 42) * 2654435761) % 4294967296, event_id LIMIT 100")
def o16(spark, d):
    rank = ((F.col("event_id") + 42) * F.lit(2654435761)) % F.lit(4294967296)
    return R.sample_by_hash(table(spark, d, "events").select("event_id", "user_id"), F.col("event_id"), 100, 42, rank)


# Multiplier and modulus of the ranking hash that SQL can repeat.
HASH_SQL = "(doc_id * 2654435761) % 4294967296"


@query(
    "o17_stratified_split",
    f"""SELECT doc_id, lang, CASE WHEN rn <= floor(n * 0.2) THEN 'validation' ELSE 'training' END AS split FROM
        (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {HASH_SQL}, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)""",
)
def o17(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    h = (F.col("doc_id") * F.lit(2654435761)) % F.lit(4294967296)
    return R.stratified_split(docs, "lang", "doc_id", 0.2, h)


@query(
    "o18_group_pairs",
    """WITH g AS (SELECT DISTINCT event_type AS e FROM events), p AS (SELECT a.e AS a, b.e AS b FROM g a, g b WHERE a.e < b.e),
       r AS (SELECT *, CASE WHEN 'signup' IN (a, b) THEN 'signup' WHEN 'error' IN (a, b) THEN 'error' ELSE a END AS reference FROM p)
       SELECT CASE WHEN a = reference THEN b ELSE a END AS comparison, reference FROM r""",
)
def o18(spark, d):
    g = table(spark, d, "events").select(F.col("event_type").alias("condition")).distinct()
    return R.group_pairs(g, "condition", ["signup", "error"])


@query(
    "o19_point_grids",
    "SELECT p_partkey AS image, round((x + 0.5) / n, 6) AS gx, round((y + 0.5) / n, 6) AS gy FROM (SELECT p_partkey, 2 + p_size % 4 AS n FROM part), range(6) a(x), range(6) b(y) WHERE x < n AND y < n",
)
def o19(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("image"), (2 + F.col("p_size") % 4).alias("n"))
    return rounded(R.point_grid(p, F.col("n")).select("image", "gx", "gy"))


@query(
    "o19_crop_boxes",
    """WITH p AS (SELECT p_partkey AS image, 200 + p_size AS h, 300 + p_size * 2 AS w FROM part),
       l AS (SELECT p.*, layer, CAST(2 ** layer AS BIGINT) AS side FROM p, range(3) r(layer)),
       o AS (SELECT *, CAST(floor(0.3413333333 * least(h, w) * (2.0 / side)) AS BIGINT) AS ov FROM l),
       c AS (SELECT *, CAST(ceil((ov * (side - 1) + w) / side) AS BIGINT) AS cw, CAST(ceil((ov * (side - 1) + h) / side) AS BIGINT) AS ch FROM o)
       SELECT image, layer, CASE WHEN layer = 0 THEN 0 ELSE (cw - ov) * ix END AS x0, CASE WHEN layer = 0 THEN 0 ELSE (ch - ov) * iy END AS y0,
         CAST(CASE WHEN layer = 0 THEN w ELSE least((cw - ov) * ix + cw, w) END AS BIGINT) AS x1, CAST(CASE WHEN layer = 0 THEN h ELSE least((ch - ov) * iy + ch, h) END AS BIGINT) AS y1
       FROM c, range(4) a(ix), range(4) b(iy) WHERE ix < side AND iy < side""",
)
def o19b(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("image"), (200 + F.col("p_size")).alias("h"), (300 + F.col("p_size") * 2).alias("w"))
    return rounded(R.crop_boxes(p, F.col("h"), F.col("w"), 2, 0.3413333333).drop("h", "w"))


@query("w24_sixth_parts", f"WITH {I.SERIES_SQL} SELECT subject, frame, ((frame + 1) * 6 - 1) // count(*) OVER (PARTITION BY subject) AS part FROM series")
def w24(spark, d):
    s = O.attach_stats(I.series(spark, d).select("subject", "frame"), ["subject"], F.count(F.lit(1)).alias("n"))
    return s.select("subject", "frame", S.part_of(F.col("frame"), F.col("n")).alias("part"))


@query(
    "f26_wrapped_angles",
    """WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d,
                  CAST(embedding[5] AS DOUBLE) AS f, CAST(embedding[6] AS DOUBLE) AS g FROM embeddings),
       w AS (SELECT *, degrees(atan2(a, b)) - degrees(atan2(c, d)) AS t FROM e)
       SELECT vec_id, round(CASE WHEN t > 180 THEN t - 360 WHEN t < -180 THEN t + 360 ELSE t END, 6) AS wrapped,
         round(degrees(atan2(a * d - b * c, a * c + b * d)), 6) AS signed,
         round(degrees(acos(greatest(-1, least(1, ((a - c) * (f - c) + (b - d) * (g - d)) / (sqrt((a - c) ** 2 + (b - d) ** 2) * sqrt((f - c) ** 2 + (g - d) ** 2)))))), 6) AS at_point FROM w""",
)
def f26(spark, d):
    """Angle differences, signed head bend (F25) and three-point angle."""
    e = [F.element_at("embedding", i).cast("double") for i in range(1, 7)]
    return rounded(
        table(spark, d, "embeddings").select(
            "vec_id", S.wrapped_angle(e[0], e[1], e[2], e[3]).alias("wrapped"), S.signed_angle(e[0], e[1], e[2], e[3]).alias("signed"),
            S.angle_at(*e).alias("at_point"),
        )
    )


@query(
    "f32_boxes",
    "SELECT p_partkey AS key, p_partkey % 50 + 7 AS x, p_size + 3 AS y, p_size * 2 AS w, p_partkey % 9 AS h FROM part",
)
def f32(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    box = S.uncrop_box([k % 50, s, k % 50 + s * 2, s + k % 9], [F.lit(7), F.lit(3)])
    x, y, w, h = S.xyxy_to_xywh(box)
    return table(spark, d, "part").select(k.alias("key"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
