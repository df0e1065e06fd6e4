"""Request validation and risk rules."""

from pyspark.sql import functions as F

from hearth.operators import scoring as sc

SCHEMA = "request_id long, zip_code string, state string, current_value double, property_type string, recent_rent double"


def test_validation_messages(spark):
    rows = [(1, "90210", "ca", 750000.0, "Condo", 3500.0), (2, "9021", "CA", 750000.0, "Condo", None),
            (3, "90210", "ZZ", 5000.0, "Condo", -1.0)]
    out = {r["request_id"]: r for r in sc.validate_requests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1]["valid"] and out[1]["state"] == "CA" and out[1]["errors"] == ""
    assert not out[2]["valid"] and out[2]["errors"] == sc.MSG_ZIP
    assert out[3]["errors"] == "; ".join([sc.MSG_STATE, sc.MSG_VALUE.format(10000), sc.MSG_RENT])


def test_risk_points(spark):
    rows = [(1, "90210", "TX", 3_000_000.0, "Condo", 1000.0), (2, "90210", "TX", 500_000.0, "Condo", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"p1": F.lit(6.0), "p3": F.lit(-6.0)})
    out = df.select("request_id", sc.risk_points(F.col("p1"), F.col("p3")).alias("pts")).collect()
    # 2 (1m > 5) + 3 (3m < -5) + 1 (value > 2M) + 1 (P/R = 250 > 30)
    assert {r["request_id"]: r["pts"] for r in out} == {1: 7, 2: 5}


def test_clip_and_round(spark):
    rows = [(1, "90210", "TX", 500_000.0, "Condo", None)]
    scored = sc.score(spark.createDataFrame(rows, SCHEMA), None, "2024-06-15").collect()[0]
    assert scored["success"] and -8 <= scored["return_1m"] <= 12
    assert scored["return_1m"] == round(scored["raw_1m"], 2)
    assert scored["risk_simple"] == "Medium"
