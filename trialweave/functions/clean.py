"""Value maps, missing-value rules and casts. Each function takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Maps of the registry columns. Fixed values.
STAGE_T = {"1a": "1", "1b": "1", "1c": "1", "2a": "2", "2b": "2", "4": "4"}
PDL1_NUMBER = {"<1": "0", "1-49": "25"}
PDL1_NUMBER_EXTERNAL = {"<1": "0", "1-49": "40"}
UNKNOWN_VALUES = ["Unknown", "Others"]

# Display names of features. Fixed values.
DISPLAY_NAMES = {
    "年龄": "age",
    "性别": "gender",
    "是否吸烟": "smoking",
    "每日吸烟数量": "smoking",
    "病理诊断_文本": "pathological_diagnosis",
    "病例完成治疗的周期数": "treatment_cycles",
    "临床试验分期T": "treatment_phase_T",
    "临床试验N分期": "treatment_phase_N",
    "临床试验分期": "treatment_phase",
    "wavelet2-LLL_gldm_LargeDependenceHighGrayLevelEmphasis": "wavelet2-LLL_gldm_LargeDHighGrayLevelEmphasis",
}


def map_values(column: Column, mapping: dict[str, str]) -> Column:
    """Replace listed values and keep all others, null included."""
    if not mapping:
        return column
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), column), column)


def replace_everywhere(df: DataFrame, values: list[str], replacement: str) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.replace(values, replacement, subset=texts)


def sentinel_to_null(column: Column, sentinels: list[str]) -> Column:
    return F.when(~column.isin(sentinels), column)


def to_numeric(column: Column, errors: str = "raise") -> Column:
    """Parse text; a bad value raises, or becomes null with errors='null'."""
    if errors == "null":
        return column.try_cast("double")
    return column.cast("double")


def zero_where_zero(condition: Column, column: Column) -> Column:
    """0 where the condition column is 0, else unchanged (non-smokers smoke no cigarettes)."""
    return F.when(condition == 0, F.lit(0.0)).otherwise(column)


def missing_flag(column: Column) -> Column:
    return column.isNull()


def present_flag(column: Column) -> Column:
    return column.isNotNull().cast("int")


def as_category_text(column: Column, missing: str = "Missing") -> Column:
    """Text form with one explicit category for null."""
    return F.coalesce(column.cast("string"), F.lit(missing))
