"""Image features on the voxel table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave import fixtures as fx
from trialweave.imaging import extract as ex
from trialweave.imaging import extraction as job
from trialweave.imaging import filters as fl
from trialweave.imaging import intensity as it
from trialweave.imaging import prepare as pr
from trialweave.imaging import texture as tx
from trialweave.operators.relational import slice_thickness
from trialweave.plans import image_sql as sql
from trialweave.plans.catalog import query
from trialweave.session import scratch_path

KEY = ["image_name"]
VOXELS = fx.with_views("voxels")
LEVELS = f"{VOXELS}, {sql.levels()}"


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return pr.discretize(pr.voxel_mask(fx.voxels(spark, sf)), KEY)


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    """Single precision for the comparison, with noise around zero and exact halves moved out of the way."""
    values = [
        (F.round(F.col(n).cast("double") * (1 + 1e-12), 9) + F.lit(0.0)).cast("float").cast("double").alias(n)
        for n in names
    ]
    return df.select("image_name", *values)


def _class_sql(family: str, head: str = LEVELS) -> str:
    ctes = sql.class_ctes(family)
    if family in ("gldm", "ngtdm"):
        ctes = [sql.NEIGHBOUR_CTES, *ctes]
    return f"{head}, {', '.join(ctes)} SELECT image_name, {sql.rounded(sql.names_of(family))} FROM {family}_t"


@query(f"{VOXELS} SELECT * FROM voxels WHERE mask = 1")
def voxel_mask(spark: SparkSession, sf: str) -> DataFrame:
    return pr.voxel_mask(fx.voxels(spark, sf))


@query(
    fx.with_views("voxels", "masks")
    + """ , i AS (SELECT image_name, max(z) + 1 AS n_z_image, max(y) + 1 AS n_y_image, max(x) + 1 AS n_x_image,
      count(*) AS n_voxels_image FROM voxels GROUP BY 1),
    m AS (SELECT image_name, max(z) + 1 AS n_z_mask, max(y) + 1 AS n_y_mask, max(x) + 1 AS n_x_mask,
      count(*) AS n_voxels_mask FROM masks GROUP BY 1)
    SELECT *, n_z_image = n_z_mask AND n_y_image = n_y_mask AND n_x_image = n_x_mask AND n_voxels_image = n_voxels_mask
      AS geometry_ok FROM i FULL JOIN m USING (image_name)"""
)
def geometry_check(spark: SparkSession, sf: str) -> DataFrame:
    return pr.geometry_check(fx.voxels(spark, sf), fx.masks(spark, sf))


@query(
    fx.with_views("voxels", "masks")
    + """ , i AS (SELECT image_name, count(*) AS ni, count(*) FILTER (mask = 1) AS nr FROM voxels GROUP BY 1),
    m AS (SELECT image_name, count(*) AS nm FROM masks GROUP BY 1)
    SELECT image_name, CASE WHEN ni IS NULL OR ni <> nm THEN 'geometry' WHEN nr = 0 THEN 'empty mask'
      WHEN nr = 1 THEN 'single voxel' END AS reason FROM m LEFT JOIN i USING (image_name)"""
)
def quarantine_bad_images(spark: SparkSession, sf: str) -> DataFrame:
    """Every image once: with its fault, or with no reason when its voxels passed on."""
    good, bad = pr.quarantine(fx.voxels(spark, sf), fx.masks(spark, sf))
    passed = good.select("image_name").distinct().withColumn("reason", F.lit(None).cast("string"))
    return bad.unionByName(passed)


@query(
    fx.with_views("slices")
    + """ , ranked AS (SELECT *, row_number() OVER (PARTITION BY series
      ORDER BY z NULLS LAST, slice_location NULLS LAST, path) AS slot FROM slices),
    g AS (SELECT series, cast(count(*) AS int) AS n_z, 512 AS n_y, 512 AS n_x, max(pixel_spacing) AS spacing_y, max(pixel_spacing) AS spacing_x,
      coalesce(abs(max(z) FILTER (slot = 1) - max(z) FILTER (slot = 2)),
        abs(max(slice_location) FILTER (slot = 1) - max(slice_location) FILTER (slot = 2))) AS spacing_z
      FROM ranked GROUP BY series),
    p AS (SELECT *, cast(round_even(n_z * spacing_z, 0) AS int) AS new_n_z,
      cast(round_even(n_y * spacing_y, 0) AS int) AS new_n_y, cast(round_even(n_x * spacing_x, 0) AS int) AS new_n_x FROM g)
    SELECT series, new_n_z, new_n_y, new_n_x, round(new_n_z::DOUBLE / n_z, 6) AS zoom_z, round(new_n_y::DOUBLE / n_y, 6) AS zoom_y,
      round(new_n_x::DOUBLE / n_x, 6) AS zoom_x, round(spacing_z / nullif(new_n_z::DOUBLE / n_z, 0), 6) AS new_spacing_z,
      round(spacing_y / nullif(new_n_y::DOUBLE / n_y, 0), 6) AS new_spacing_y,
      round(spacing_x / nullif(new_n_x::DOUBLE / n_x, 0), 6) AS new_spacing_x FROM p"""
)
def resample_grid(spark: SparkSession, sf: str) -> DataFrame:
    slices = slice_thickness(fx.slices(spark, sf))
    volumes = slices.groupBy("series").agg(
        F.count("*").cast("int").alias("n_z"),
        F.first("thickness").alias("spacing_z"),
        F.max("pixel_spacing").alias("spacing_y"),
    )
    for axis in ("y", "x"):
        volumes = volumes.withColumns({f"n_{axis}": F.lit(512), f"spacing_{axis}": F.col("spacing_y")})
    plan = pr.resample_plan(volumes)
    ratios = [F.round(f"{c}_{a}", 6).alias(f"{c}_{a}") for c in ("zoom", "new_spacing") for a in "zyx"]
    return plan.select("series", *[f"new_n_{a}" for a in "zyx"], *ratios)


RESAMPLE_SQL = """ , e AS (SELECT image_name, max(z) + 1 AS n_z, max(y) + 1 AS n_y, max(x) + 1 AS n_x,
      1 + cast(image_name AS int) % 3 * 0.5::DOUBLE AS s_z, 0.75::DOUBLE AS s_y, 1.0::DOUBLE AS s_x FROM voxels GROUP BY 1),
    p AS (SELECT *, cast(round_even(n_z * s_z, 0) AS int) AS m_z, cast(round_even(n_y * s_y, 0) AS int) AS m_y,
      cast(round_even(n_x * s_x, 0) AS int) AS m_x FROM e),
    grid AS (SELECT *, unnest(range(m_x)) AS x FROM (SELECT *, unnest(range(m_y)) AS y FROM
      (SELECT *, unnest(range(m_z)) AS z FROM p))),
    spot AS (SELECT image_name, z, y, x, n_z, n_y, n_x, CASE WHEN m_z > 1 THEN z * (n_z - 1)::DOUBLE / (m_z - 1) ELSE 0 END AS az,
      CASE WHEN m_y > 1 THEN y * (n_y - 1)::DOUBLE / (m_y - 1) ELSE 0 END AS ay,
      CASE WHEN m_x > 1 THEN x * (n_x - 1)::DOUBLE / (m_x - 1) ELSE 0 END AS ax FROM grid),
    corners AS (SELECT a.*, c.*, least(floor(az) + c.cz, n_z - 1) AS vz, least(floor(ay) + c.cy, n_y - 1) AS vy,
      least(floor(ax) + c.cx, n_x - 1) AS vx,
      (CASE c.cz WHEN 1 THEN az - floor(az) ELSE 1 - (az - floor(az)) END)
      * (CASE c.cy WHEN 1 THEN ay - floor(ay) ELSE 1 - (ay - floor(ay)) END)
      * (CASE c.cx WHEN 1 THEN ax - floor(ax) ELSE 1 - (ax - floor(ax)) END) AS w
      FROM spot a, (VALUES (0,0,0),(0,0,1),(0,1,0),(0,1,1),(1,0,0),(1,0,1),(1,1,0),(1,1,1)) c(cz, cy, cx)),
    lin AS (SELECT k.image_name, k.z, k.y, k.x, sum(w * v."value") AS "value" FROM corners k JOIN voxels v
      ON v.image_name = k.image_name AND v.z = k.vz AND v.y = k.vy AND v.x = k.vx GROUP BY ALL)
    SELECT l.image_name, cast(l.z AS int) AS z, cast(l.y AS int) AS y, cast(l.x AS int) AS x,
      round(l."value", 6) + 0.0::DOUBLE AS "value", v.mask FROM lin l
    JOIN spot a ON a.image_name = l.image_name AND a.z = l.z AND a.y = l.y AND a.x = l.x
    JOIN voxels v ON v.image_name = l.image_name AND v.z = floor(az + 0.5) AND v.y = floor(ay + 0.5) AND v.x = floor(ax + 0.5)"""


@query(VOXELS + RESAMPLE_SQL)
def resample_volume(spark: SparkSession, sf: str) -> DataFrame:
    voxels = fx.voxels(spark, sf)
    sizes = voxels.groupBy("image_name").agg(*[(F.max(a) + 1).alias(f"n_{a}") for a in "zyx"])
    plan = pr.resample_plan(
        sizes.withColumns(
            {
                "spacing_z": F.lit(1.0) + F.col("image_name").cast("int") % 3 * F.lit(0.5),
                "spacing_y": F.lit(0.75),
                "spacing_x": F.lit(1.0),
            }
        )
    )
    resampled = pr.resample_volume(voxels, plan)
    return resampled.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(
    VOXELS
    + """ , s AS (SELECT image_name, avg("value") AS m, stddev_pop("value") AS d FROM voxels GROUP BY 1)
    SELECT v.image_name, z, y, x, mask, round(("value" - m) / d, 6) + 0.0::DOUBLE AS "value",
      round(least(greatest(("value" - m) / d, -1), 1) * 100, 6) + 0.0::DOUBLE AS clipped
    FROM voxels v JOIN s ON v.image_name = s.image_name"""
)
def intensity_normalize(spark: SparkSession, sf: str) -> DataFrame:
    voxels = fx.voxels(spark, sf)
    plain = pr.intensity_normalize(voxels, KEY)
    clipped = pr.intensity_normalize(voxels, KEY, outliers=1.0, scale=100.0).select(
        *KEY, "z", "y", "x", F.col("value").alias("clipped")
    )
    both = plain.join(clipped, [*KEY, "z", "y", "x"])
    return both.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("value", "clipped")})


@query(f"{LEVELS} SELECT image_name, z, y, x, g FROM lv")
def discretize(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select("image_name", "z", "y", "x", "g")


@query(_class_sql("firstorder"))
def firstorder(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(it.firstorder(_levels(spark, sf), KEY), it.FIRSTORDER)


@query(_class_sql("glcm"))
def glcm(spark: SparkSession, sf: str) -> DataFrame:
    cells = tx.glcm_cells(_levels(spark, sf), KEY)
    return _rounded(tx.glcm_features(cells, KEY), tx.GLCM)


@query(_class_sql("glrlm"))
def glrlm(spark: SparkSession, sf: str) -> DataFrame:
    cells = tx.glrlm_cells(_levels(spark, sf), KEY)
    return _rounded(tx.size_features(cells, KEY, "glrlm"), sql.names_of("glrlm"))


@query(_class_sql("gldm"))
def gldm(spark: SparkSession, sf: str) -> DataFrame:
    cells = tx.gldm_cells(tx.neighbour_cells(_levels(spark, sf), KEY), KEY)
    return _rounded(tx.size_features(cells, KEY, "gldm"), sql.names_of("gldm"))


@query(_class_sql("ngtdm"))
def ngtdm(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(tx.ngtdm_features(tx.neighbour_cells(_levels(spark, sf), KEY), KEY), tx.NGTDM)


@query(_class_sql("glszm"))
def glszm(spark: SparkSession, sf: str) -> DataFrame:
    cells = tx.glszm_cells(_levels(spark, sf), KEY)
    return _rounded(tx.size_features(cells, KEY, "glszm"), sql.names_of("glszm"))


@query(f"{LEVELS}, {sql.SHAPE_CTES} SELECT image_name, {sql.rounded(it.SHAPE)} FROM shape_t")
def shape_pca(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(it.shape_pca(pr.voxel_mask(fx.voxels(spark, sf)), KEY), it.SHAPE)


@query(
    f'{VOXELS}, {sql.log_ctes(1.0)} SELECT image_name, z, y, x, mask, round("value", 6) + 0.0::DOUBLE AS "value" FROM logged'
)
def filter_log(spark: SparkSession, sf: str) -> DataFrame:
    filtered = fl.filter_log(fx.voxels(spark, sf), KEY, 1.0)
    return filtered.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(
    f'{VOXELS}, {sql.wavelet_ctes()} SELECT image_name, z, y, x, filter, round("value", 6) + 0.0::DOUBLE AS "value", '
    "cast(mask AS int) AS mask FROM bands"
)
def filter_wavelet(spark: SparkSession, sf: str) -> DataFrame:
    filtered = fl.filter_wavelet(fx.voxels(spark, sf), KEY, 2)
    return filtered.withColumn("value", F.round("value", 6) + F.lit(0.0))


def _derived_ctes(classes: list[str], sigmas: list[float], wavelet_levels: int) -> list[str]:
    """All derived images under one key, and every class once over them."""
    derived = [
        """SELECT image_name || '|original' AS image_name, z, y, x, "value"::DOUBLE AS "value", mask FROM voxels"""
    ]
    ctes = []
    for n, s in enumerate(sigmas):
        ctes.append(sql.log_ctes(s, suffix=f"_{n}"))
        derived.append(
            f"""SELECT image_name || '|log-sigma-{s:g}-mm', z, y, x, "value", mask FROM logged_{n}"""
        )
    if wavelet_levels:
        ctes.append(sql.wavelet_ctes(levels=wavelet_levels))
        derived.append("""SELECT image_name || '|' || filter, z, y, x, "value", mask FROM bands""")
    ctes.append(f"unrounded AS ({' UNION ALL '.join(derived)})")
    ctes.append('derived AS (SELECT * REPLACE (round("value", 6) AS "value") FROM unrounded)')
    ctes.append(sql.levels("derived"))
    if "gldm" in classes or "ngtdm" in classes:
        ctes.append(sql.NEIGHBOUR_CTES)
    for family in classes:
        ctes += sql.class_ctes(family)
    ctes.append(f"shape_roi AS (SELECT * FROM voxels WHERE mask = 1), {sql.SHAPE_CTES.replace('FROM roi', 'FROM shape_roi')}")
    return ctes


def _extract_sql(classes: list[str], sigmas: list[float], wavelet_levels: int) -> str:
    ctes = _derived_ctes(classes, sigmas, wavelet_levels)
    columns, joins = [], ""
    for image in ex.image_types(sigmas, wavelet_levels):
        for family in classes:
            table = f'"{image}_{family}"'
            joins += f" LEFT JOIN {family}_t AS {table} ON {table}.image_name = s.image_name || '|{image}'"
            columns += [(f'{table}."{n}"', f"{image}_{family}_{n}") for n in sql.names_of(family)]
    columns += [(f's."{n}"', f"original_shape_{n}") for n in it.SHAPE]
    selected = ", ".join(f'{sql.single(c)} AS "{name}"' for c, name in columns)
    return f"{VOXELS}, {', '.join(ctes)} SELECT s.image_name, {selected} FROM shape_t s{joins}"


def _extract(spark: SparkSession, sf: str, classes: list[str], sigmas: list[float], wavelet_levels: int) -> DataFrame:
    wide = ex.extract_features(fx.voxels(spark, sf), classes, sigmas, wavelet_levels)
    return _rounded(wide, [c for c in wide.columns if c != "image_name"])


@query(_extract_sql(ex.CLASSES, [1.0], 0))
def extract_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every class on the original and a filtered image, one wide row per image."""
    return _extract(spark, sf, ex.CLASSES, [1.0], 0)


@query(_extract_sql(["firstorder"], [1.0, 2.0], 2))
def extract_features_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Every image type with the first-order class."""
    return _extract(spark, sf, ["firstorder"], [1.0, 2.0], 2)


def _job_sql(settings: job.Settings) -> str:
    """Usable images, normalised, under the name that the derived images start from; a row for each image and type, and the others with their reason."""
    head = fx.with_views("voxels", "masks").replace("voxels AS (", "given AS (").replace("FROM voxels", "FROM given")
    prepared = f"""sized AS (SELECT image_name, count(*) AS n, count(*) FILTER (mask = 1) AS nr, avg("value") AS m, stddev_pop("value") AS d FROM given GROUP BY 1),
    faults AS (SELECT image_name, CASE WHEN n IS NULL OR n <> nm THEN 'geometry' WHEN nr = 0 THEN 'empty mask' WHEN nr = 1 THEN 'single voxel' END AS reason
      FROM (SELECT image_name, count(*) AS nm FROM masks GROUP BY 1) LEFT JOIN sized USING (image_name)),
    voxels AS MATERIALIZED (SELECT image_name, z, y, x, (("value" - m) / d) * {settings.scale}::DOUBLE AS "value", mask
      FROM given JOIN sized USING (image_name) JOIN faults USING (image_name) WHERE reason IS NULL)"""
    ctes = _derived_ctes(settings.classes, settings.sigmas, settings.wavelet_levels)
    columns, joins = [], ""
    for family in settings.classes:
        joins += f" LEFT JOIN {family}_t ON {family}_t.image_name = u.image_name"
        columns += [f'{sql.single(f"{family}_t.{chr(34)}{n}{chr(34)}")} AS "{family}_{n}"' for n in sql.names_of(family)]
    columns += [f'{sql.single(f"shape_t.{chr(34)}{n}{chr(34)}")} AS "shape_{n}"' for n in it.SHAPE]
    joins += " LEFT JOIN shape_t ON shape_t.image_name || '|original' = u.image_name"
    nulls = ", ".join(f'NULL AS "{c}"' for c in [*[f"{f}_{n}" for f in settings.classes for n in sql.names_of(f)], *[f"shape_{n}" for n in it.SHAPE]])
    return f"""{head}, {prepared}, {', '.join(ctes)}, units AS (SELECT DISTINCT image_name FROM derived)
    SELECT split_part(u.image_name, '|', 1) AS image_name, split_part(u.image_name, '|', 2) AS filter, NULL AS reason, {', '.join(columns)} FROM units u{joins}
    UNION ALL SELECT image_name, NULL, reason, {nulls} FROM faults WHERE reason IS NOT NULL"""


JOB = job.Settings()


@query(_job_sql(JOB))
def extraction_job(spark: SparkSession, sf: str) -> DataFrame:
    """All image types times all classes of the usable images, normalised, and the others with their reason; the finished job is run a second time."""
    path = scratch_path(spark, "extraction")
    voxels, masks = fx.voxels(spark, sf), fx.masks(spark, sf)
    job.run(voxels, masks, path, JOB)
    if job.run(voxels, masks, path, JOB):
        raise AssertionError("a second run found work")
    done = job.features(spark, path, JOB)
    rounded = [(F.round(F.col(c) * (1 + 1e-12), 9) + F.lit(0.0)).cast("float").cast("double").alias(c) for c in JOB.columns()]
    listed = job.quarantined(spark, path).withColumn("filter", F.lit(None).cast("string"))
    return done.withColumn("reason", F.lit(None).cast("string")).select("image_name", "filter", "reason", *rounded).unionByName(listed, allowMissingColumns=True)
