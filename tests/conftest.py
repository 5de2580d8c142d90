import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from marketloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(app="marketloom-tests", shuffle_partitions=4, memory="8g")


@pytest.fixture
def frame(spark):
    """Rows and a DDL schema to a DataFrame; ISO text becomes dates."""
    import datetime as dt

    from pyspark.sql import types as T

    def make(rows, ddl):
        schema = T.StructType.fromDDL(ddl)
        fix = {T.DateType: lambda v: dt.date.fromisoformat(v) if isinstance(v, str) else v,
               T.TimestampType: lambda v: dt.datetime.fromisoformat(v) if isinstance(v, str) else v}
        rows = [tuple(fix.get(type(f.dataType), lambda v: v)(v) for f, v in zip(schema.fields, row)) for row in rows]
        return spark.createDataFrame(rows, schema)

    return make
