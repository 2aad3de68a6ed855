"""The feature-table schema.

The 30 feature names and the target name are fixed values of the data contract the
engine serves (a phishing-site feature table: every feature in {-1, 0, 1}, target
in {-1, 1}). They are stated here once, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: feature names of the data contract, natural order ----
FEATURE_COLUMNS = [
    "having_IP_Address", "URL_Length", "Shortining_Service", "having_At_Symbol",
    "double_slash_redirecting", "Prefix_Suffix", "having_Sub_Domain", "SSLfinal_State",
    "Domain_registeration_length", "Favicon", "port", "HTTPS_token", "Request_URL",
    "URL_of_Anchor", "Links_in_tags", "SFH", "Submitting_to_email", "Abnormal_URL",
    "Redirect", "on_mouseover", "RightClick", "popUpWidnow", "Iframe", "age_of_domain",
    "DNSRecord", "web_traffic", "Page_Rank", "Google_Index", "Links_pointing_to_page",
    "Statistical_report",
]
TARGET_COLUMN = "Result"
# ---- end fixed values ----

ALL_COLUMNS = FEATURE_COLUMNS + [TARGET_COLUMN]


def feature_schema(with_target: bool = True) -> T.StructType:
    """StructType of the declared table: every column BIGINT (declared int64)."""
    cols = ALL_COLUMNS if with_target else FEATURE_COLUMNS
    return T.StructType([T.StructField(c, T.LongType(), True) for c in cols])


def schema_from_yaml(path: str) -> tuple[T.StructType, list[str]]:
    """Build (StructType, numerical column list) from a YAML schema file.

    The YAML has ``columns: [{name: type}, ...]`` and ``numerical_columns: [...]``.
    """
    import yaml

    with open(path) as fh:
        doc = yaml.safe_load(fh)
    type_map = {"int64": T.LongType(), "int32": T.IntegerType(), "float64": T.DoubleType(),
                "float32": T.FloatType(), "object": T.StringType(), "str": T.StringType(),
                "bool": T.BooleanType()}
    fields = []
    for entry in doc.get("columns", []):
        (name, typ), = entry.items()
        fields.append(T.StructField(name, type_map.get(str(typ), T.StringType()), True))
    return T.StructType(fields), list(doc.get("numerical_columns", []))
