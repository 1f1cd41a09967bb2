import pytest
from pyspark.sql import types as T

from pitwall import schemas as S


def test_contract_accepts_extra_columns_and_rejects_changes(spark):
    df = spark.createDataFrame([("a", 1, 2, None, None, None, 7)],
                               "driver_name string, position int, timestamp long, race_id string, team_name string, "
                               "speed double, extra long")
    S.assert_contract(df, S.POSITION_WIRE)
    with pytest.raises(S.ContractError):
        S.assert_contract(df.drop("position"), S.POSITION_WIRE)
    with pytest.raises(S.ContractError):
        S.assert_contract(df.withColumn("position", df.position.cast("long")), S.POSITION_WIRE)
    with pytest.raises(S.ContractError, match="required"):
        S.assert_contract(df, S.POSITION_WIRE, check_nullability=True)


def test_contract_on_schema_object():
    S.assert_contract(S.ANOMALY_TABLE, T.StructType(S.ANOMALY_TABLE.fields[:2]))
