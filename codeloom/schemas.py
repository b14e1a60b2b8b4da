"""Fixed schemas of the corpus data model.

Nested records map onto Spark structs; the recursive module/file tree is
stored as flat tables (a StructType cannot recurse).
"""

from pyspark.sql import types as T

PARAMETER = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
FIELD = PARAMETER

FUNCTION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("parameters", T.ArrayType(PARAMETER)),
        T.StructField("return_types", T.ArrayType(T.StringType())),
        T.StructField("body", T.StringType()),
    ]
)

# The interchange key is spelt "reciever"; kept for JSON compatibility.
METHOD = T.StructType([T.StructField("reciever", T.StringType()), T.StructField("function", FUNCTION)])

CLASS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("fields", T.ArrayType(FIELD)),
        T.StructField("methods", T.ArrayType(METHOD)),
    ]
)

INTERFACE = T.StructType([T.StructField("name", T.StringType()), T.StructField("methods", T.ArrayType(FUNCTION))])

FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("module", T.StringType()),
        T.StructField("classes", T.ArrayType(CLASS)),
        T.StructField("interfaces", T.ArrayType(INTERFACE)),
        T.StructField("functions", T.ArrayType(FUNCTION)),
    ]
)

# Extraction output: the File record plus the parse error (null when parsed).
FILE_META = T.StructType(list(FILE.fields) + [T.StructField("error", T.StringType())])

EDGE = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("target_file", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("source_element", T.StringType()),
        T.StructField("target_element", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)

# Every function definition at any depth (pre-order), with raw signature text.
ALL_FUNCTIONS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("func_no", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("params_text", T.StringType()),
        T.StructField("returns_text", T.StringType()),
        T.StructField("body_text", T.StringType()),
    ]
)

# Control-flow paths in long form: one row per emitted label.
PATH_LABELS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("func_no", T.LongType()),
        T.StructField("path_no", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("arm", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

TASK = T.StructType(
    [
        T.StructField("source_code", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("iterations", T.LongType()),
        T.StructField("best_coverage", T.DoubleType()),
        T.StructField("generated_test", T.StringType()),
        T.StructField("test_report", T.StringType()),
        T.StructField("code_type", T.StringType()),
    ]
)

# Edge weights by dependency type (fixed values of the analyzer).
WEIGHT_IMPORT = 1.0
WEIGHT_EXTENDS = 0.9
WEIGHT_USES = 0.7

# Retry-loop defaults (fixed values of the main program).
COVERAGE_THRESHOLD = 0.8
MAX_ITERATIONS = 3
WORKER_COUNT = 2
QUEUE_CAPACITY = 5 * WORKER_COUNT
