"""Explicit schemas of the fixed tables; feature and task columns are named by settings."""

from pyspark.sql import types as T


KINDS = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "array<float>": T.ArrayType(T.FloatType()), "array<string>": T.ArrayType(T.StringType()),
    "map<text>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(text: str) -> T.StructType:
    """Built without a running session, unlike a DDL string."""
    pairs = [p.split() for p in text.split(",")]
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in pairs])


STAYS = _schema(
    "stay_id bigint, patient_id string, hadm_id bigint, intime timestamp, outtime timestamp, "
    "los_days double, age double, gender string, race string, admission_type string, "
    "insurance string, first_careunit string, height double, weight double"
)
MORTALITY = _schema(
    "stay_id bigint, date_of_death timestamp, death_time timestamp, death_date date, "
    "death_time_precision string, death_source string, hospital_expire_flag int, "
    "dischtime timestamp, discharge_location string"
)
DIAGNOSES = _schema("stay_id bigint, icd_code string, icd_version int")
EVENTS = _schema("stay_id bigint, charttime timestamp, feature_name string, valuenum double")
EMBEDDINGS = _schema("id bigint, embedding array<float>")
RUNS = _schema(
    "id string, url string, name string, group string, created_at string, tags array<string>, "
    "config string, summary map<text>, state string"
)
