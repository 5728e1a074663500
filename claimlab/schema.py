"""Column layout of the claims table and the constants that define its rules."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw CSV columns in file order. `text` columns hold codes or dollar strings that
# cleaning turns into their declared type.
_RAW_COLUMNS = [
    ("SEQNO", "long"),
    ("RECTYPE", "string"),
    ("REPTYPE", "int"),
    ("ORIGYEAR", "int"),
    ("WORKSTAT", "string"),
    ("WORKCTRY", "string"),
    ("HOMESTAT", "string"),
    ("HOMECTRY", "string"),
    ("LICNSTAT", "string"),
    ("LICNFELD", "int"),
    ("PRACTAGE", "text"),
    ("GRAD", "text"),
    ("ALGNNATR", "text"),
    ("ALEGATN1", "text"),
    ("ALEGATN2", "text"),
    ("OUTCOME", "text"),
    ("MALYEAR1", "text"),
    ("MALYEAR2", "text"),
    ("PAYMENT", "text"),
    ("TOTALPMT", "text"),
    ("PAYNUMBR", "string"),
    ("NUMBPRSN", "text"),
    ("PAYTYPE", "string"),
    ("PYRRLTNS", "string"),
    ("PTAGE", "text"),
    ("PTSEX", "string"),
    ("PTTYPE", "string"),
    ("AAYEAR", "text"),
    ("AACLASS1", "text"),
    ("AACLASS2", "text"),
    ("AACLASS3", "text"),
    ("AACLASS4", "text"),
    ("AACLASS5", "text"),
    ("BASISCD1", "string"),
    ("BASISCD2", "string"),
    ("BASISCD3", "string"),
    ("BASISCD4", "string"),
    ("BASISCD5", "string"),
    ("AALENTYP", "string"),
    ("AALENGTH", "text"),
    ("AAEFYEAR", "text"),
    ("AASIGYR", "text"),
    ("TYPE", "int"),
    ("PRACTNUM", "long"),
    ("ACCRRPTS", "int"),
    ("NPMALRPT", "int"),
    ("NPLICRPT", "int"),
    ("NPCLPRPT", "int"),
    ("NPPSMRPT", "int"),
    ("NPDEARPT", "int"),
    ("NPEXCRPT", "int"),
    ("NPGARPT", "int"),
    ("NPCTMRPT", "int"),
    ("FUNDPYMT", "text"),
]

_SPARK_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "text": T.StringType(),
}

CLAIMS_SCHEMA = T.StructType(
    [
        T.StructField(name, _SPARK_TYPES[kind], True)
        for name, kind in _RAW_COLUMNS
    ]
)

# Column groups that share one cleaning rule.
CURRENCY_COLUMNS = ["PAYMENT", "TOTALPMT"]
DECIMAL_COLUMNS = ["AALENGTH"]
LONG_CODE_COLUMNS = ["PRACTNUM"]
CODED_INTEGER_COLUMNS = [
    "PRACTAGE",
    "GRAD",
    "ALGNNATR",
    "ALEGATN1",
    "ALEGATN2",
    "OUTCOME",
    "MALYEAR1",
    "MALYEAR2",
    "NUMBPRSN",
    "PTAGE",
    "AAYEAR",
    "AACLASS1",
    "AACLASS2",
    "AACLASS3",
    "AACLASS4",
    "AACLASS5",
    "AAEFYEAR",
    "AASIGYR",
    "FUNDPYMT",
    "PRACTNUM",
    "ACCRRPTS",
    "NPMALRPT",
    "NPLICRPT",
    "NPCLPRPT",
    "NPPSMRPT",
    "NPDEARPT",
    "NPEXCRPT",
    "NPGARPT",
    "NPCTMRPT",
    "TYPE",
    "REPTYPE",
]
CODE_STRING_COLUMNS = [
    "RECTYPE",
    "WORKSTAT",
    "HOMESTAT",
    "LICNSTAT",
    "PAYNUMBR",
    "PAYTYPE",
    "PYRRLTNS",
    "PTSEX",
    "PTTYPE",
    "AALENTYP",
    "BASISCD1",
    "BASISCD2",
    "BASISCD3",
    "BASISCD4",
    "BASISCD5",
]
COUNTRY_COLUMNS = ["WORKCTRY", "HOMECTRY"]
#: Columns that the reader gives as whole numbers.
INTEGER_COLUMNS = [name for name, kind in _RAW_COLUMNS if kind in ("int", "long")]

#: Declared kind of every column: Numeric, Dollar or String.
DECLARED_KINDS = {
    field.name: (
        "Dollar"
        if field.name in CURRENCY_COLUMNS
        else "String"
        if field.name in CODE_STRING_COLUMNS + COUNTRY_COLUMNS
        else "Numeric"
    )
    for field in CLAIMS_SCHEMA
}

# Record classes.
RECORD_CLASSES = {
    "M": "Malpractice (old format, pre-2004)",
    "P": "Malpractice (new format, post-2004)",
    "A": "Adverse Action (old format, pre-1999)",
    "C": "Adverse Action (CAAR, post-1999)",
}
PAYMENT_RECORD_TYPES = ["M", "P"]
ADVERSE_RECORD_TYPES = ["A", "C"]
PEER_STATES = ["WI", "MN", "IA", "IL", "MI", "IN", "OH"]

CATASTROPHIC_AMOUNT = 1_000_000
VALID_LAG_YEARS = (0, 50)

# Linkage tiers, their key columns and the widest report-year span an episode may have.
TIER_KEYS = {
    "strict": ["PRACTNUM", "STATE", "MALYEAR1", "MALYEAR2", "ALGNNATR", "PAYTYPE_STR"],
    "moderate": ["PRACTNUM", "STATE", "MALYEAR1", "ALGNNATR", "ORIGYEAR_WINDOW"],
    "exploratory": ["PRACTNUM", "STATE", "MALYEAR1"],
}
TIER_SPAN_LIMIT = {"strict": 3, "moderate": 5, "exploratory": 7}
