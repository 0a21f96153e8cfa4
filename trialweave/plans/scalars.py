"""Column functions on the registry, the scores and the voxel table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave import fixtures as fx
from trialweave.functions import clean
from trialweave.functions import transforms as tr
from trialweave.operators import splits
from trialweave.plans.catalog import query
from trialweave.plans.joins import WEIGHTS, cohorts
from trialweave.sources.volumes import axis_permute

SWEEP_POINTS = 20
FIXED_LAMBDA = 0.5

@query(fx.with_views("registry") + """ SELECT "imageName", lower("set") AS "set" FROM registry""")
def str_lower(spark: SparkSession, sf: str) -> DataFrame:
    return fx.registry(spark, sf).select("imageName", F.lower("set").alias("set"))


@query(fx.with_views("paths") + """ SELECT name, split_part(name, '.', 1) AS stem FROM paths""")
def str_stem(spark: SparkSession, sf: str) -> DataFrame:
    return fx.paths(spark, sf).select("name", F.substring_index("name", ".", 1).alias("stem"))


@query(
    fx.with_views("registry")
    + """ SELECT "imageName",
    CASE stage_t WHEN '1a' THEN '1' WHEN '1b' THEN '1' WHEN '1c' THEN '1' WHEN '2a' THEN '2' WHEN '2b' THEN '2'
      ELSE stage_t END AS stage_t,
    CASE pdl1_number WHEN '<1' THEN '0' WHEN '1-49' THEN '25' ELSE pdl1_number END AS pdl1_number FROM registry"""
)
def value_map(spark: SparkSession, sf: str) -> DataFrame:
    return fx.registry(spark, sf).select(
        "imageName",
        clean.map_values(F.col("stage_t"), clean.STAGE_T).alias("stage_t"),
        clean.map_values(F.col("pdl1_number"), clean.PDL1_NUMBER).alias("pdl1_number"),
    )


@query(
    fx.with_views("registry")
    + """ SELECT "imageName",
    CASE pdl1_number WHEN '<1' THEN '0' WHEN '1-49' THEN '40' ELSE pdl1_number END AS pdl1_number FROM registry"""
)
def value_map_external(spark: SparkSession, sf: str) -> DataFrame:
    mapped = clean.map_values(F.col("pdl1_number"), clean.PDL1_NUMBER_EXTERNAL)
    return fx.registry(spark, sf).select("imageName", mapped.alias("pdl1_number"))


@query(
    fx.with_views("registry")
    + """ SELECT "imageName", CASE lower("set") WHEN 'lungmate-009' THEN 'train_set'
    WHEN 'lungmate-001' THEN 'validation_set' WHEN 'lungmate-002' THEN 'validation_set' ELSE lower("set") END AS "set"
    FROM registry"""
)
def value_map_many_to_one(spark: SparkSession, sf: str) -> DataFrame:
    roles = {"lungmate-009": "train_set", "lungmate-001": "validation_set", "lungmate-002": "validation_set"}
    return fx.registry(spark, sf).select("imageName", clean.map_values(F.lower("set"), roles).alias("set"))


@query(
    fx.with_views("registry")
    + """ SELECT * REPLACE (
    CASE WHEN pdl1_number IN ('Unknown', 'Others') THEN 'missing' ELSE pdl1_number END AS pdl1_number,
    CASE WHEN pdl1_expression IN ('Unknown', 'Others') THEN 'missing' ELSE pdl1_expression END AS pdl1_expression)
    FROM registry"""
)
def replace_everywhere(spark: SparkSession, sf: str) -> DataFrame:
    return clean.replace_everywhere(fx.registry(spark, sf), clean.UNKNOWN_VALUES, "missing")


@query(
    fx.with_views("registry") + """ SELECT "imageName", nullif(pdl1_number, 'Unknown') AS pdl1_number FROM registry"""
)
def sentinel_to_null(spark: SparkSession, sf: str) -> DataFrame:
    cleared = clean.sentinel_to_null(F.col("pdl1_number"), ["Unknown", "missing"])
    return fx.registry(spark, sf).select("imageName", cleared.alias("pdl1_number"))


@query(
    fx.with_views("registry") + """ SELECT "imageName", try_cast(pdl1_number AS DOUBLE) AS pdl1_number FROM registry"""
)
def to_numeric(spark: SparkSession, sf: str) -> DataFrame:
    parsed = clean.to_numeric(F.col("pdl1_number"), errors="null")
    return fx.registry(spark, sf).select("imageName", parsed.alias("pdl1_number"))


@query(
    fx.with_views("registry")
    + """ SELECT "imageName", smoker, CASE WHEN smoker = 0 THEN 0.0::DOUBLE ELSE cigarettes END AS cigarettes
    FROM registry"""
)
def conditional_assign(spark: SparkSession, sf: str) -> DataFrame:
    daily = clean.zero_where_zero(F.col("smoker"), F.col("cigarettes"))
    return fx.registry(spark, sf).select("imageName", "smoker", daily.alias("cigarettes"))


@query(
    fx.with_views("registry")
    + """ SELECT "imageName", try_cast(pdl1_number AS DOUBLE) IS NULL AS pdl1_number_none FROM registry"""
)
def missing_flag(spark: SparkSession, sf: str) -> DataFrame:
    number = clean.to_numeric(F.col("pdl1_number"), errors="null")
    return fx.registry(spark, sf).select("imageName", clean.missing_flag(number).alias("pdl1_number_none"))


@query(
    fx.with_views("registry")
    + """ SELECT "imageName", cast(try_cast(pdl1_number AS DOUBLE) IS NOT NULL AS int) AS pdl1_number_none FROM registry"""
)
def present_flag(spark: SparkSession, sf: str) -> DataFrame:
    number = clean.to_numeric(F.col("pdl1_number"), errors="null")
    return fx.registry(spark, sf).select("imageName", clean.present_flag(number).alias("pdl1_number_none"))


@query(
    fx.with_views("registry")
    + """ SELECT "imageName", coalesce(smoker, -1) AS smoker, coalesce(pdl1_number, 'Missing') AS pdl1_number
    FROM registry"""
)
def fill_constant(spark: SparkSession, sf: str) -> DataFrame:
    filled = fx.registry(spark, sf).fillna({"smoker": -1, "pdl1_number": "Missing"})
    return filled.select("imageName", "smoker", "pdl1_number")


@query(
    fx.with_views("registry")
    + """ SELECT "imageName", cast(cigarettes AS BIGINT) AS cigarettes, cast(smoker AS BIGINT) AS smoker FROM registry"""
)
def cast_nullable_int(spark: SparkSession, sf: str) -> DataFrame:
    return fx.registry(spark, sf).select(
        "imageName", F.col("cigarettes").cast("bigint").alias("cigarettes"), F.col("smoker").cast("bigint").alias("smoker")
    )


@query(
    fx.with_views("registry")
    + """ SELECT "imageName", coalesce(cast(smoker AS VARCHAR), 'Missing') AS smoker, cast(sex AS VARCHAR) AS sex
    FROM registry"""
)
def cast_string(spark: SparkSession, sf: str) -> DataFrame:
    texts = [clean.as_category_text(F.col(c)).alias(c) for c in ("smoker", "sex")]
    return fx.registry(spark, sf).select("imageName", *texts)


@query(fx.with_views("voxels") + """ SELECT image_name, z, y, x, cast("value" AS FLOAT) AS "value" FROM voxels""")
def cast_float32(spark: SparkSession, sf: str) -> DataFrame:
    return fx.voxels(spark, sf).select("image_name", "z", "y", "x", F.col("value").cast("float").alias("value"))


@query(fx.with_views("registry") + """ SELECT "imageName", round(ln("ORR" / 100 + 2), 6) AS y FROM registry""")
def log1p_target(spark: SparkSession, sf: str) -> DataFrame:
    return fx.registry(spark, sf).select("imageName", F.round(tr.log1p_target(F.col("ORR")), 6).alias("y"))


@query(
    fx.with_views("registry")
    + f""" SELECT "imageName", round((pow("ORR" / 100 + 1, {FIXED_LAMBDA}::DOUBLE) - 1) / {FIXED_LAMBDA}::DOUBLE, 6) AS y
    FROM registry"""
)
def boxcox_target(spark: SparkSession, sf: str) -> DataFrame:
    y = tr.boxcox(F.col("ORR") / 100 + 1, FIXED_LAMBDA)
    return fx.registry(spark, sf).select("imageName", F.round(y, 6).alias("y"))


@query(
    fx.with_views("registry")
    + """ SELECT "imageName", round(ln(2.3::DOUBLE), 6) AS cut_log1p,
    round((pow(1.3::DOUBLE, 0.5::DOUBLE) - 1) / 0.5::DOUBLE, 6) AS cut_boxcox,
    cast(ln("ORR" / 100 + 2) > ln(2.3::DOUBLE) AS int) AS above FROM registry"""
)
def transform_threshold(spark: SparkSession, sf: str) -> DataFrame:
    cut = tr.transform_cut()
    return fx.registry(spark, sf).select(
        "imageName",
        F.round(F.lit(cut), 6).alias("cut_log1p"),
        F.round(F.lit(tr.transform_cut(FIXED_LAMBDA)), 6).alias("cut_boxcox"),
        tr.binarize(tr.log1p_target(F.col("ORR")), cut).alias("above"),
    )


@query(fx.with_views("scored") + " SELECT id, model, cast(prob > 0.5 AS int) AS prediction FROM scored")
def binarize(spark: SparkSession, sf: str) -> DataFrame:
    return fx.scored(spark, sf).select("id", "model", tr.binarize(F.col("prob"), 0.5).alias("prediction"))


@query(
    fx.with_views("registry")
    + """ SELECT "imageName", least(greatest("ORR" / 20, 0.5::DOUBLE), 2.0::DOUBLE) AS bounded,
    CASE WHEN cigarettes IS NOT NULL THEN least(greatest(cigarettes / 10, 0.5::DOUBLE), 2.0::DOUBLE) END AS packs
    FROM registry"""
)
def clip(spark: SparkSession, sf: str) -> DataFrame:
    return fx.registry(spark, sf).select(
        "imageName",
        tr.clip(F.col("ORR") / 20, 0.5, 2.0).alias("bounded"),
        tr.clip(F.col("cigarettes") / 10, 0.5, 2.0).alias("packs"),
    )


@query(
    fx.with_views("scored")
    + """ , wide AS (SELECT id, max(prob) FILTER (WHERE model = 'a') AS a, max(prob) FILTER (WHERE model = 'b') AS b,
      max(prob) FILTER (WHERE model = 'c') AS c FROM scored GROUP BY id)
    SELECT id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS class FROM wide"""
)
def argmax_class(spark: SparkSession, sf: str) -> DataFrame:
    wide = fx.scored(spark, sf).groupBy("id").pivot("model", list(fx.SCORES)).agg(F.max("prob"))
    return wide.select("id", tr.argmax_class(F.array(*fx.SCORES)).alias("class"))


@query(
    fx.with_views("scored")
    + f""" , ends AS (SELECT model, min(prob) AS lo, max(prob) AS hi FROM scored GROUP BY model)
    SELECT model, cast(i AS int) AS i, round(lo + i * ((hi - lo) / 19::DOUBLE), 9) AS threshold
    FROM (SELECT model, lo, hi, unnest(range({SWEEP_POINTS})) AS i FROM ends)"""
)
def linspace(spark: SparkSession, sf: str) -> DataFrame:
    """Evenly spaced cuts between the smallest and the largest score of each model."""
    ends = fx.scored(spark, sf).groupBy("model").agg(F.min("prob").alias("lo"), F.max("prob").alias("hi"))
    cuts = F.posexplode(tr.linspace(F.col("lo"), F.col("hi"), SWEEP_POINTS)).alias("i", "threshold")
    return ends.select("model", cuts).withColumn("threshold", F.round("threshold", 9))


@query(
    fx.with_views("voxels")
    + """ , scanner AS (SELECT *, 10 * "value" AS raw, 1 + cast(image_name AS int) % 3 * 0.25::DOUBLE AS slope,
      -1024 AS intercept FROM voxels),
    zeroed AS (SELECT *, CASE WHEN raw < -1000 THEN 0 ELSE raw END AS inside FROM scanner)
    SELECT image_name, z, y, x,
      cast((CASE WHEN slope <> 1 THEN cast(trunc(slope * inside) AS int) ELSE inside END) + intercept AS SMALLINT) AS hu
    FROM zeroed"""
)
def hu_rescale(spark: SparkSession, sf: str) -> DataFrame:
    raw = (F.col("value") * 10).cast("int")
    slope = F.lit(1.0) + F.col("image_name").cast("int") % 3 * F.lit(0.25)
    hu = tr.hounsfield(raw, slope, F.lit(-1024))
    return fx.voxels(spark, sf).select("image_name", "z", "y", "x", hu.alias("hu"))


@query(fx.with_views("masks") + " SELECT image_name, x AS z, y, z AS x, mask FROM masks", name="axis_permute")
def permuted_masks(spark: SparkSession, sf: str) -> DataFrame:
    return axis_permute(fx.masks(spark, sf))


@query(
    fx.with_views("importances")
    + """ SELECT feature, importance, CASE feature WHEN 'small ring#0' THEN 'ring' WHEN 'red widget#1' THEN 'widget'
    ELSE feature END AS label FROM importances"""
)
def display_names(spark: SparkSession, sf: str) -> DataFrame:
    labels = {**clean.DISPLAY_NAMES, "small ring#0": "ring", "red widget#1": "widget"}
    return fx.importances(spark, sf).withColumn("label", clean.map_values(F.col("feature"), labels))


@query(
    fx.with_views("registry")
    + ","
    + WEIGHTS
    + """ SELECT t."imageName", t."Group", t.cycles, round(coalesce(w.weight, 1.0::DOUBLE), 9) AS weight FROM train t
    LEFT JOIN weights w ON t."Group" = w."Group" AND t.cycles = w.cycles"""
)
def reweight_to_target(spark: SparkSession, sf: str) -> DataFrame:
    train, val = cohorts(spark, sf)
    weighted = splits.reweight(train, val, ["Group", "cycles"])
    return weighted.select("imageName", "Group", "cycles", F.round("weight", 9).alias("weight"))


@query(
    fx.with_views("registry")
    + """ SELECT "imageName", "Group", CASE WHEN "set" = 'LungMate-009' THEN 'train' ELSE 'val' END AS part
    FROM registry WHERE "set" IN ('LungMate-009', 'LungMate-001', 'LungMate-002')
    UNION ALL SELECT "imageName", "Group", CASE WHEN "set" = 'LungMate-002' THEN 'val2' ELSE 'train2' END
    FROM registry WHERE "set" IN ('LungMate-009', 'LungMate-001', 'LungMate-002')"""
)
def split_cohort(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.registry(spark, sf).withColumn("set", F.lower("set"))
    parts = []
    for name, suffix in (("9_12", ""), ("19_2", "2")):
        train, val = splits.split_by_set(df, *splits.COHORT_SPLITS[name])
        parts += [train.withColumn("part", F.lit("train" + suffix)), val.withColumn("part", F.lit("val" + suffix))]
    keep = ["imageName", "Group", "part"]
    return parts[0].select(keep).union(parts[1].select(keep)).union(parts[2].select(keep)).union(parts[3].select(keep))


@query(
    fx.with_views("scored")
    + """ , r AS (SELECT id, label, row_number() OVER (ORDER BY md5(concat('21:', id))) AS pos, count(*) OVER () AS n
      FROM scored WHERE model = 'a')
    SELECT id, label, pos <= ceil(0.3::DOUBLE * n) AS is_test FROM r"""
)
def split_random(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.scored(spark, sf).filter("model = 'a'").select("id", "label")
    return splits.mark_random(rows, "id", 0.3, 21)


@query(
    fx.with_views("registry")
    + """ , external AS (SELECT "imageName", "Group", CASE pdl1_number WHEN '<1' THEN '0' WHEN '1-49' THEN '40'
      ELSE pdl1_number END AS pdl1_number FROM registry WHERE "set" = 'LungMate-Other')
    SELECT "imageName", "Group", nullif(pdl1_number, 'Unknown') AS pdl1_number, 'test' AS part FROM external
    UNION ALL SELECT "imageName", "Group", try_cast(pdl1_number AS DOUBLE)::BIGINT::VARCHAR, 'train' FROM registry
    WHERE "set" IN ('LungMate-009', 'LungMate-001', 'LungMate-002')"""
)
def split_external(spark: SparkSession, sf: str) -> DataFrame:
    """Train on the trial cohorts, test on another one that has its own value map."""
    df = fx.registry(spark, sf)
    train, test = splits.split_by_set(df, ["LungMate-009", "LungMate-001", "LungMate-002"], ["LungMate-Other"])
    number = clean.map_values(F.col("pdl1_number"), clean.PDL1_NUMBER_EXTERNAL)
    test = test.withColumn("pdl1_number", clean.sentinel_to_null(number, ["Unknown"])).withColumn("part", F.lit("test"))
    known = clean.to_numeric(F.col("pdl1_number"), errors="null").cast("bigint").cast("string")
    train = train.withColumn("pdl1_number", known).withColumn("part", F.lit("train"))
    keep = ["imageName", "Group", "pdl1_number", "part"]
    return train.select(keep).unionByName(test.select(keep))


@query(
    fx.with_views("scored")
    + """ SELECT id, label, cast((row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', id)), id) - 1) % 5 AS int)
    AS fold FROM scored WHERE model = 'a'"""
)
def kfold_stratified(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.scored(spark, sf).filter("model = 'a'").select("id", "label")
    return splits.stratified_folds(rows, "label", "id", k=5, seed=42)


@query(
    fx.with_views("scored")
    + """ SELECT id, label, cast((row_number() OVER (PARTITION BY label ORDER BY id) - 1) % 10 AS int) AS fold
    FROM scored WHERE model = 'a'"""
)
def kfold_plain(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.scored(spark, sf).filter("model = 'a'").select("id", "label")
    return splits.stratified_folds(rows, "label", "id", k=10, seed=None)
