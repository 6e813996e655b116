"""Declared schemas, so that no reader infers and absent fields read as NULL."""

from pyspark.sql import types as T

from jobgrain.fixed_values import SERVICE_COLUMNS


def _struct(*fields) -> T.StructType:
    """Fields are names of text columns or (name, type)."""
    return T.StructType([T.StructField(*((f, T.StringType()) if isinstance(f, str) else f)) for f in fields])


ID_NAME = _struct("id", "name")
NAMED = _struct("name")
SALARY = _struct(("from", T.DoubleType()), ("to", T.DoubleType()), "currency")
ADDRESS = _struct("city", "street", "building", "raw")
SNIPPET = _struct("requirement", "responsibility")

ENTITY_COLUMNS = ["experience", "employer", "area", "type", "schedule", "employment",
                  "employment_form", "department"]

POSTING_CORE = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
     T.StructField("salary", SALARY), T.StructField("salary_range", SALARY)]
    + [T.StructField(c, ID_NAME) for c in ENTITY_COLUMNS]
    + [T.StructField(c, T.ArrayType(ID_NAME)) for c in ("professional_roles", "work_format")]
    + [T.StructField(c, T.ArrayType(NAMED))
       for c in ("working_hours", "work_schedule_by_days", "key_skills")]
    + [T.StructField("address", ADDRESS), T.StructField("snippet", SNIPPET),
       T.StructField("published_at", T.StringType())]
)

# Service columns are only ever dropped; reading them as text keeps any shape.
POSTING_RAW = T.StructType(
    POSTING_CORE.fields + [T.StructField(c, T.StringType()) for c in SERVICE_COLUMNS])

PAGE = T.StructType([T.StructField("items", T.ArrayType(POSTING_CORE))])

ROLE_CATALOGUE = _struct(("categories", T.ArrayType(_struct("id", "name", ("roles", T.ArrayType(ID_NAME))))))

LEXICON = _struct("skill", "keyword")


def with_fields(schema: T.StructType, **types: str) -> T.StructType:
    """A copy of `schema` with more fields; `StructType.add` would change the schema a DataFrame keeps."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in types.items())).fields])
