"""Stand-in inputs built from the test tables; FIXTURES.md gives the rules.

The column formulas are plain SQL that Spark and DuckDB both read, so each view is written once and
used by the Spark queries and by the oracle alike. Names in double quotes become backticks for Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

REGISTRY = [
    "lpad(cast(c_custkey as string), 10, '0') as \"imageName\"",
    "case when r_regionkey in (0, 1) then 'LungMate-009' when r_regionkey = 2 then 'LungMate-001' "
    "when r_regionkey = 3 then 'LungMate-002' else 'LungMate-Other' end as \"set\"",
    "case when c_custkey % 29 = 0 then null when c_acctbal > 4500 then 1 else 0 end as \"Group\"",
    "c_acctbal / 100 - 10 as \"ORR\"",
    "cast(30 + c_custkey % 50 as double) as age",
    "cast(c_custkey % 2 as int) as sex",
    "case when c_custkey % 11 = 0 then null when c_custkey % 3 > 0 then 1 else 0 end as smoker",
    "case when c_custkey % 7 = 0 then null else cast(c_custkey % 40 as double) end as cigarettes",
    "case c_custkey % 5 when 0 then '<1' when 1 then '1-49' when 2 then 'Unknown' when 3 then null "
    "else cast(c_custkey % 100 as string) end as pdl1_number",
    "case c_mktsegment when 'FURNITURE' then 'Unknown' when 'MACHINERY' then 'Others' else c_mktsegment end "
    "as pdl1_expression",
    "n_name as diagnosis",
    "cast(case when c_custkey % 41 = 0 and r_regionkey in (0, 1) then 5 "
    "when c_custkey % 41 = 0 and r_regionkey in (2, 3) then 6 "
    "else 1 + (c_custkey + case when r_regionkey in (0, 1) then (c_nationkey % 2) * (c_custkey % 3) "
    "else 0 end) % 4 end as int) as cycles",
    "case c_custkey % 7 when 0 then '1a' when 1 then '1b' when 2 then '1c' when 3 then '2a' "
    "when 4 then '2b' when 5 then '3' else '4' end as stage_t",
]

# {distinct} and {symbols} are the two spots where the engines spell a function differently.
FEATURES = [
    "lpad(cast(d.doc_id as string), 10, '0') as \"imageName\"",
    "l.quality as label",
    "cast(n_chars as double) as n_chars",
    "cast(length(text) - length(replace(text, ' ', '')) + 1 as double) as n_words",
    "cast({distinct} as double) as n_distinct",
    "cast(length({symbols}) as double) as n_symbols",
    "lang",
    "source",
    "cast(length({symbols}) as double) / n_chars * 100 as \"ORR\"",
]
_SPARK_WORDS = {
    "distinct": "size(array_distinct(split(lower(text), ' ')))",
    "symbols": r"regexp_replace(text, '[\\p{L}\\s]', '')",
}
_DUCK_WORDS = {
    "distinct": "len(list_distinct(string_split(lower(text), ' ')))",
    "symbols": r"regexp_replace(text, '[\p{L}\s]', '', 'g')",
}

SCORES = {
    "a": "cast(n_chars as double) / (n_chars + cast(2000 as double))",
    "b": "cast(length(text) - length(replace(text, ' ', '')) as double) / (n_chars + cast(1 as double))",
    "c": "round(cast(n_chars as double) / (n_chars + cast(2000 as double)), 1)",
}

PATHS = [
    "cast(o_custkey as string) as pid",
    "cast(cast(o_orderdate as date) as string) as scan_date",
    "concat(case when o_orderkey % 17 = 0 then '.' else '' end, cast(o_orderkey as string), '.dcm') as name",
    "concat('ct/', cast(o_custkey as string), '/', cast(cast(o_orderdate as date) as string), '/', "
    "case when o_orderkey % 17 = 0 then '.' else '' end, cast(o_orderkey as string), '.dcm') as path",
    "o_orderstatus = 'F' as has_mask",
    "o_orderkey % 5 = 0 as is_done",
]

SLICES = [
    "cast(l_orderkey as string) as series",
    "l_linenumber * (1 + l_orderkey % 3) + cast(0.5 as double) as slice_location",
    "case when l_orderkey % 13 = 0 then null "
    "else l_linenumber * (1 + l_orderkey % 3) + cast(0.5 as double) end as z",
    "concat(cast(l_orderkey as string), '/', cast(l_linenumber as string)) as path",
    "cast(0.7 as double) + (l_orderkey % 4) / cast(10 as double) as pixel_spacing",
]

VOXELS = [
    "cast(vec_id as string) as image_name",
    "cast(floor(pos / 16) as int) as z",
    "cast(floor(pos / 4) as int) % 4 as y",
    "cast(pos as int) % 4 as x",
    "cast(floor(cast(v as double) * 1000) as int) as \"value\"",
    "case when cast(v as double) > cast(-0.1 as double) then 1 else 0 end as mask",
]


def _spark(columns: list[str]) -> list[str]:
    return [c.replace('"', "`") for c in columns]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def registry(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation, region = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    return joined.selectExpr(*_spark(REGISTRY))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").alias("d")
    return documents.join(table(spark, folder, "labels").alias("l"), F.col("d.doc_id") == F.col("l.doc_id"))


def features(spark: SparkSession, folder: str) -> DataFrame:
    columns = [_fill(c, _SPARK_WORDS) for c in _spark(FEATURES)]
    return _labelled(spark, folder).selectExpr(*columns)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Long score table (id, label, model, prob); each document is scored by three fixed formulas."""
    wide = _labelled(spark, folder).selectExpr(
        "cast(d.doc_id as string) as id", "l.quality as label", *[f"{sql} as {m}" for m, sql in SCORES.items()]
    )
    return wide.unpivot(["id", "label"], list(SCORES), "model", "prob")


def importances(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    total = part.agg(F.sum(F.col("p_retailprice").cast("decimal(20,4)")).cast("double")).first()[0]
    return part.select(
        F.expr("concat(p_name, '#', cast(p_partkey as string))").alias("feature"),
        F.round(F.col("p_retailprice") / F.lit(total), 12).alias("importance"),
    )


def paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(*PATHS)


def mask_paths(spark: SparkSession, folder: str) -> DataFrame:
    """One label file per (patient, date) that has a finished order."""
    return (
        paths(spark, folder)
        .filter("has_mask")
        .selectExpr("pid", "scan_date", "concat('label/', pid, '/', scan_date, '.nii.gz') as path")
        .distinct()
    )


def slices(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return keys.selectExpr(*SLICES)


def voxels(spark: SparkSession, folder: str, broken: bool = True) -> DataFrame:
    """One row per voxel; images whose id divides by 97 lose the plane z = 3."""
    exploded = table(spark, folder, "embeddings").selectExpr("vec_id", "posexplode(embedding) as (pos, v)")
    if broken:
        exploded = exploded.filter("not (vec_id % 97 = 0 and pos >= 48)")
    return exploded.selectExpr(*_spark(VOXELS))


def masks(spark: SparkSession, folder: str) -> DataFrame:
    return voxels(spark, folder, broken=False).drop("value")


def volumes(spark: SparkSession, folder: str) -> DataFrame:
    """One array per image, the form in which a volume arrives before it becomes a voxel table."""
    return table(spark, folder, "embeddings").selectExpr(
        "cast(vec_id as string) as image_name", "transform(embedding, v -> floor(cast(v as double) * 1000)) as pixels"
    )


def _fill(text: str, words: dict[str, str]) -> str:
    for name, sql in words.items():
        text = text.replace("{" + name + "}", sql)
    return text


def _list(columns: list[str]) -> str:
    return ", ".join(columns)


# The same views as SQL table expressions for the oracle.
VIEWS = {
    "registry": f"SELECT {_list(REGISTRY)} FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey",
    "features": f"SELECT {_fill(_list(FEATURES), _DUCK_WORDS)} FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "scored": " UNION ALL ".join(
        f"SELECT cast(d.doc_id as string) AS id, l.quality AS label, '{m}' AS model, {sql} AS prob "
        "FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
        for m, sql in SCORES.items()
    ),
    "importances": "SELECT concat(p_name, '#', cast(p_partkey as string)) AS feature, round(p_retailprice / "
    "(SELECT cast(sum(cast(p_retailprice as decimal(20,4))) as double) FROM part), 12) AS importance FROM part",
    "paths": f"SELECT {_list(PATHS)} FROM orders",
    "mask_paths": "SELECT DISTINCT pid, scan_date, concat('label/', pid, '/', scan_date, '.nii.gz') AS path "
    f"FROM (SELECT {_list(PATHS)} FROM orders) WHERE has_mask",
    "slices": f"SELECT {_list(SLICES)} FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)",
    "voxels": f"SELECT {_list(VOXELS)} FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS pos "
    "FROM embeddings) WHERE NOT (vec_id % 97 = 0 AND pos >= 48)",
    "masks": "SELECT image_name, z, y, x, mask FROM (SELECT "
    + _list(VOXELS)
    + " FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS pos FROM embeddings))",
}


def with_views(*names: str) -> str:
    """The head of an oracle query: WITH registry AS (...), features AS (...)"""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
