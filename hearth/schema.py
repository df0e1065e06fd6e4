"""Long-panel schema, geography columns and the dataset registry (SRC-1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values that must equal the reference's: the geography column names
# (matched case-insensitively), and the four default datasets.
GEOGRAPHY_COLUMNS = ("RegionID", "SizeRank", "RegionName", "RegionType", "StateName", "State", "Metro", "CountyName")

LONG_SCHEMA = T.StructType(
    [
        T.StructField("RegionID", T.LongType()),
        T.StructField("SizeRank", T.IntegerType()),
        T.StructField("RegionName", T.StringType()),
        T.StructField("RegionType", T.StringType()),
        T.StructField("StateName", T.StringType()),
        T.StructField("State", T.StringType()),
        T.StructField("Metro", T.StringType()),
        T.StructField("CountyName", T.StringType()),
        T.StructField("Date", T.DateType()),
        T.StructField("Value", T.DoubleType()),
        T.StructField("Dataset", T.StringType()),
        T.StructField("GeographyLevel", T.StringType()),
    ]
)

# Columns that are never model features (metadata); everything else except target_* is.
METADATA_COLUMNS = ("RegionID", "RegionName", "Date", "Value", "Dataset", "GeographyLevel")


@dataclass(frozen=True)
class DatasetInfo:
    """A monthly panel: its tag in ``Dataset``, its grain, the wide file it is read from."""

    name: str
    geography_level: str
    file_path: str
    short_name: str
    description: str


# The four panels that ``hearth.sources.panels`` derives (names and levels are referred to by queries).
DEFAULT_DATASETS = (
    DatasetInfo("home_values", "zip", "home_wide.csv", "home", "mean line price by supplier and month"),
    DatasetInfo("rents", "zip", "rent_wide.csv", "rent", "a twelfth of the mean unit price by supplier and month"),
    DatasetInfo("inventory_metro", "metro", "inventory_wide.csv", "inventory", "quantity shipped by nation and month"),
    DatasetInfo("sales_count_metro", "metro", "sales_wide.csv", "sales", "orders shipped by nation and month"),
)


class DatasetRegistry:
    """Driver-side registry of dataset descriptors (plain metadata, no data)."""

    def __init__(self, datasets=DEFAULT_DATASETS):
        self._by_name: dict[str, DatasetInfo] = {}
        for d in datasets:
            self.register(d)

    def register(self, info: DatasetInfo) -> None:
        self._by_name[info.name] = info

    def get(self, name: str) -> DatasetInfo | None:
        return self._by_name.get(name)

    def names(self) -> list[str]:
        return list(self._by_name)

    def as_rows(self) -> list[tuple[str, str, str, str]]:
        return [(d.short_name, d.name, d.description, d.geography_level) for d in self._by_name.values()]
