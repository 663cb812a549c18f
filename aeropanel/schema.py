"""Schemas, the station registry and the protocol of an evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEATHER = ["t2m_c", "blh", "ws10", "u10", "v10", "sp_hpa", "tp_mm"]
POLLUTANTS = ["no2", "pm25"]

RAW_AQ = "timestamp_utc timestamp, NO2 double, `PM2.5` double, PM10 double, O3 double, NO double, NOXasNO2 double, ws double, wd double, temp double, site_code string, year int"
MET = "timestamp_utc timestamp, t2m_c float, sp_hpa float, tp_mm float, blh float, ws10 float, wd10 float, u10 float, v10 float"
PREDICTIONS = "station string, pollutant string, model string, phase string, origin_pos long, lead long, yhat double"
MANIFEST = ["source", "city", "station", "year", "pull_date_utc", "sha256", "n_rows", "notes"]

# The published stations (code, city, tier, env_type, source, pollutants, koppen, note).
STATIONS = [
    ("SHDG", "sheffield", 1, "urban_background", "aurn", ["NO2", "PM2.5"], "Cfb", ""),
    ("SHBR", "sheffield", 1, "urban_traffic", "aurn", ["NO2", "PM2.5"], "Cfb", ""),
    ("KC1", "london", 1, "urban_background", "aurn", ["NO2", "PM2.5"], "Cfb", ""),
    ("MY1", "london", 1, "urban_traffic", "aurn", ["NO2", "PM2.5"], "Cfb", ""),
    ("BMLD", "birmingham", 1, "urban_background", "aurn", ["NO2", "PM2.5"], "Cfb", ""),
    ("BIRR", "birmingham", 1, "urban_traffic", "aurn", ["NO2", "PM2.5"], "Cfb", ""),
    ("MAN3", "manchester", 1, "urban_background", "aurn", ["NO2", "PM2.5"], "Cfb", ""),
    ("MAHG", "manchester", 1, "suburban_industrial", "aurn", ["NO2"], "Cfb", ""),
]
_STATION = "code string, city string, tier int, env_type string, source string, pollutants array<string>, koppen string, note string"


def stations(spark: SparkSession, pollutant: str | None = None) -> DataFrame:
    """The registry; with ``pollutant``, the stations that report it."""
    rows = spark.createDataFrame(STATIONS, _STATION)
    return rows.where(F.array_contains("pollutants", pollutant)) if pollutant else rows


@dataclass(frozen=True)
class Protocol:
    """Rolling origins: context, stride between origins, horizon; ``unit`` of the grid; half-open splits by label."""

    context: int = 512
    stride: int = 168
    horizon: int = 24
    max_horizon: int = 168
    train_stride: int = 6
    train_context: int = 168
    n_min: int = 50
    alpha: float = 0.1
    n_boot: int = 2000
    unit: str = "hour"
    start: str = "2019-01-01"
    end: str = "2025-01-01"
    splits: dict[str, tuple[str, str]] = field(default_factory=lambda: {"train": ("2019-01-01", "2023-01-01"), "cal": ("2023-01-01", "2023-07-01"), "test": ("2023-07-01", "2025-01-01")})


EVENTS = Protocol(context=72, stride=24, horizon=24, max_horizon=24, n_min=10, start="2024-01-01", end="2024-01-31", splits={"train": ("2024-01-01", "2024-01-16"), "cal": ("2024-01-16", "2024-01-21"), "test": ("2024-01-21", "2024-01-31")})
