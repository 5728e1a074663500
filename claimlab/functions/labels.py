"""Code-to-label tables and the expressions that apply them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Allegation groups.
ALLEGATIONS = {
    1: "Diagnosis Related",
    10: "Anesthesia Related",
    20: "Surgery Related",
    30: "Medication Related",
    40: "IV & Blood Products Related",
    50: "Obstetrics Related",
    60: "Treatment Related",
    70: "Monitoring Related",
    80: "Equipment/Product Related",
    90: "Other Miscellaneous",
    100: "Behavioral Health Related",
}

# Payment modes and resolutions.
PAYMENT_MODES = {"S": "Single Payment", "M": "Multiple Payments", "U": "Unknown Payment Mode"}
NON_JUDGMENT = "Settlement/Non-Judgment"
RESOLUTIONS = {"J": "Judgment", "S": NON_JUDGMENT, "U": NON_JUDGMENT, "B": NON_JUDGMENT, "O": NON_JUDGMENT}
DETAILED_RESOLUTIONS = {
    "S": "Settlement",
    "J": "Judgment",
    "U": "Unknown/Before Settlement",
    "B": "Before Settlement",
    "O": "Other",
}

# Injury severity in three label forms (long, short, without number).
OUTCOMES_LONG = {
    1: "1-Emotional Only",
    2: "2-Insignificant Injury",
    3: "3-Minor Temporary",
    4: "4-Major Temporary",
    5: "5-Minor Permanent",
    6: "6-Significant Permanent",
    7: "7-Major Permanent",
    8: "8-Quad/Brain Damage",
    9: "9-Death",
    10: "10-Cannot Determine",
}
OUTCOMES_SHORT = {
    1: "1-Emotional",
    2: "2-Insignificant",
    3: "3-Minor Temp",
    4: "4-Major Temp",
    5: "5-Minor Perm",
    6: "6-Significant Perm",
    7: "7-Major Perm",
    8: "8-Quad/Brain",
    9: "9-Death",
    10: "10-Cannot Determine",
}
OUTCOMES_PLAIN = {
    1: "Emotional",
    2: "Insignificant",
    3: "Minor Temp",
    4: "Major Temp",
    5: "Minor Perm",
    6: "Significant Perm",
    7: "Major Perm",
    8: "Quad/Brain",
    9: "Death",
    10: "Cannot Determine",
}

# People.
SEXES = {"M": "Male", "F": "Female", "U": "Unknown"}
PATIENT_AGES = {
    -1: "Fetus",
    0: "Under 1 year",
    1: "Age 1-9",
    10: "Age 10-19",
    20: "Age 20-29",
    30: "Age 30-39",
    40: "Age 40-49",
    50: "Age 50-59",
    60: "Age 60-69",
    70: "Age 70-79",
    80: "Age 80-89",
    90: "Age 90-99",
}
PRACTITIONER_AGES = {
    10: "19 and under",
    20: "20-29",
    30: "30-39",
    40: "40-49",
    50: "50-59",
    60: "60-69",
    70: "70-79",
    80: "80+",
}

# Report-count columns and the action they count.
ADVERSE_ACTIONS = {
    "NPLICRPT": "Licensure Actions",
    "NPCLPRPT": "Clinical Privilege Actions",
    "NPPSMRPT": "Professional Society Actions",
    "NPDEARPT": "DEA Actions",
    "NPEXCRPT": "Medicare/Medicaid Exclusions",
    "NPGARPT": "Government Admin Actions",
    "NPCTMRPT": "Criminal Convictions",
}

# Fields of license, from the public format specification of the data file.
LICENSE_FIELDS = {
    10: "Allopathic Physician (MD)",
    15: "Physician Resident (MD)",
    20: "Osteopathic Physician (DO)",
    25: "Osteopathic Phys. Resident (DO)",
    30: "Dentist",
    35: "Dental Resident",
    50: "Pharmacist",
    55: "Pharmacy Intern",
    60: "Pharmacist, Nuclear",
    70: "Pharmacy Assistant",
    75: "Pharmacy Technician",
    76: "Other Pharmacy Service",
    100: "Registered Nurse",
    110: "Nurse Anesthetist",
    120: "Nurse Midwife",
    130: "Nurse Practitioner",
    134: "Doctor of Nursing Practice",
    135: "Advanced Nurse Practitioner",
    140: "LPN/Vocational Nurse",
    141: "Clinical Nurse Specialist",
    142: "Other Nurse Occupation",
    148: "Certified Nurse Aide/Nursing Asst",
    150: "Nurse Aide/Nursing Assistant",
    160: "Home Health Aide",
    165: "Health Care Aide/Direct Care Worker",
    170: "Psychiatric Technician",
    175: "Certified/Qualified Medication Aide",
    176: "Other Aide Occupation",
    200: "Dietitian",
    210: "Nutritionist",
    211: "Other Dietitian/Nutritionist",
    240: "Emergency Medical Responder",
    250: "Emergency Medical Technician (EMT)",
    260: "EMT, Cardiac/Critical Care",
    270: "Advanced EMT (AEMT)",
    280: "Paramedic",
    281: "Other Emergency Medical Services",
    300: "Clinical Social Worker",
    350: "Podiatrist",
    370: "Clinical Psychologist",
    371: "Psychologist",
    372: "School Psychologist",
    373: "Psychological Asst/Assoc/Examiner",
    374: "Other Psychologist/Psych Asst",
    400: "Audiologist",
    402: "Art/Recreation Therapist",
    405: "Massage Therapist",
    410: "Occupational Therapist",
    420: "Occup. Therapy Assistant",
    430: "Physical Therapist",
    440: "Phys. Therapy Assistant",
    450: "Rehabilitation Therapist",
    460: "Speech/Language Pathologist",
    470: "Hearing Aid/Instrument Specialist",
    471: "Other Speech/Language/Hearing Service",
    500: "Medical Technologist",
    501: "Medical/Clinical Lab Tech",
    502: "Medical/Clinical Lab Technician",
    503: "Surgical Technologist/Assistant",
    504: "Surgical Assistant",
    505: "Cytotechnologist",
    510: "Nuclear Med. Technologist",
    520: "Rad. Therapy Technologist",
    530: "Radiologic Technician/Technologist",
    540: "X-Ray Technician or Operator",
    550: "Limited X-Ray Machine Operator",
    551: "Other Technologist/Technician",
    600: "Acupuncturist",
    601: "Athletic Trainer",
    603: "Chiropractor",
    604: "Chiropractic Assistant",
    605: "Other Chiropractic Occupation",
    606: "Dental Assistant",
    607: "Dental Therapist/Dental Health Aide",
    609: "Dental Hygienist",
    612: "Denturist",
    613: "Other Dental Occupation",
    615: "Homeopath",
    618: "Medical Assistant",
    621: "Counselor, Mental Health",
    624: "Midwife, Lay (Non-Nurse)",
    627: "Naturopath",
    630: "Ocularist",
    633: "Optician",
    636: "Optometrist",
    637: "Other Eye/Vision Service",
    639: "Orthotics/Prosthetics Fitter",
    642: "Physician Assistant",
    645: "Phys. Asst., Osteopathic",
    647: "Perfusionist",
    648: "Podiatric Assistant",
    649: "Other Podiatric Service",
    651: "Prof. Counselor",
    652: "Sex Offender Counselor",
    653: "Pastoral Counselor",
    654: "Prof. Cnslr., Alcohol",
    657: "Prof. Cnslr., Family/Marriage",
    658: "Other Rehab/Respiratory/Restorative Service",
    660: "Addictions Counselor",
    661: "Marriage and Family Therapist",
    662: "Art Therapist",
    663: "Respiratory Therapist",
    664: "Recreation Therapist",
    665: "Dance Therapist",
    666: "Resp. Therapy Technician",
    667: "Music Therapist",
    668: "Other Behavioral Health Occupation",
    699: "Other Health Care Pract, Not Classified",
    752: "Adult Care Facility Admin",
    755: "Hospital Administrator",
    758: "Health Care Facility Admin",
    759: "Assisted Living Facility Admin",
    800: "Researcher, Clinical",
    810: "Insurance Agent/Broker",
    812: "Insurance Broker",
    820: "Corporate Officer",
    822: "Business Manager",
    830: "Business Owner",
    840: "Salesperson",
    850: "Accountant",
    853: "Bookkeeper",
    899: "Other Individual, Not Classified",
    998: "Subject Not Reportable",
    999: "Unspecified or Unknown",
    1301: "General/Acute Care Hospital",
    1302: "Psychiatric Hospital",
    1303: "Rehabilitation Hospital",
    1304: "Federal Hospital",
    1307: "Psychiatric Unit",
    1308: "Rehabilitation Unit",
    1310: "Laboratory/CLIA Laboratory",
    1320: "Health Insurance Co/Provider",
    1331: "Health Maintenance Organization",
    1335: "Preferred Provider Org",
    1336: "Provider Sponsored Organization",
    1338: "Religious/Fraternal Benefit Society Plan",
    1342: "Blood Bank",
    1343: "Durable Medical Equipment Supplier",
    1344: "Eyewear Equipment Supplier",
    1345: "Pharmacy (Organization)",
    1346: "Pharmaceutical Manufacturer",
    1347: "Biological Products Manufacturer",
    1348: "Organ Procurement Organization",
    1349: "Portable X-Ray Supplier",
    1351: "Fiscal/Billing/Management Agent",
    1352: "Purchasing Service",
    1353: "Nursing/Health Care Staffing Service",
    1361: "Chiropractic Group/Practice",
    1362: "Dental Group/Practice",
    1363: "Optician/Optometric Group/Practice",
    1364: "Podiatric Group/Practice",
    1365: "Medical Group/Practice",
    1366: "Mental Health/Substance Abuse Group",
    1367: "Physical/Occupational Therapy Group",
    1370: "Research Center/Facility",
    1381: "Adult Day Care Facility",
    1382: "Hospice/Hospice Care Provider",
    1383: "Intermed. Care Fclty Intellectual Disability/Substance Abuse",
    1386: "Residential Treatment Facility",
    1388: "Outpatient Rehab Facility",
    1389: "Nursing/Skilled Nursing Facility",
    1390: "Ambulance Service/Transportation Co",
    1391: "Ambulatory Surgical Center",
    1392: "Ambulatory Clinic/Center",
    1393: "Home Health Agency/Organization",
    1394: "Health Cntr/FQHC",
    1395: "Mental Health Center/Community MHC",
    1396: "Rural Health Clinic",
    1397: "Mammography Service Provider",
    1398: "End Stage Renal Disease Facility",
    1399: "Radiology/Imaging Center",
    1999: "Other Type not classified",
    9999: "Org. Type not specified",
}

# Inflation factors to the common dollar year, by report year from 1990 on.
CPI_FIRST_YEAR = 1990
CPI_FACTORS = [
    2.32, 2.22, 2.16, 2.10, 2.04, 1.99, 1.93, 1.89, 1.86, 1.82,
    1.76, 1.71, 1.69, 1.65, 1.60, 1.55, 1.50, 1.46, 1.41, 1.42,
    1.39, 1.35, 1.32, 1.30, 1.28, 1.28, 1.26, 1.24, 1.21, 1.18,
    1.17, 1.12, 1.03, 1.00, 0.97, 0.95,
]

#: Every label domain, for the dimension table and row-level lookups.
DOMAINS = {
    "allegation": ALLEGATIONS,
    "outcome_long": OUTCOMES_LONG,
    "outcome_short": OUTCOMES_SHORT,
    "outcome_plain": OUTCOMES_PLAIN,
    "patient_age": PATIENT_AGES,
    "practitioner_age": PRACTITIONER_AGES,
    "license_field": LICENSE_FIELDS,
    "sex": SEXES,
    "payment_mode": PAYMENT_MODES,
    "resolution": DETAILED_RESOLUTIONS,
}


def _sql_literal(value) -> str:
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(code: Column, table: dict, default: Column | str | None = None) -> Column:
    """Label of a code from a small literal table; `default` (or null) when the code is absent."""
    entries = ", ".join(_sql_literal(part) for pair in table.items() for part in pair)
    label = F.try_element_at(F.expr(f"map({entries})"), code)
    if default is None:
        return label
    return F.coalesce(label, default if isinstance(default, Column) else F.lit(default))


def rank_of(code: Column, table: dict) -> Column:
    """Position of a code in its table, so that labels sort by rank and not by text."""
    return lookup(code, {key: position for position, key in enumerate(table, start=1)})


def label_rank(label: Column, table: dict) -> Column:
    """Position of a label in its table."""
    return lookup(label, {text: position for position, text in enumerate(table.values(), start=1)})


def label_dimension(spark: SparkSession, domain: str) -> DataFrame:
    """Dimension table (code, label, ord) of one domain; a fixed number of rows, safe to broadcast."""
    rows = [(str(code), label, i) for i, (code, label) in enumerate(DOMAINS[domain].items(), start=1)]
    return spark.createDataFrame(rows, "code string, label string, ord int")


def with_label(df: DataFrame, code_column: str, domain: str, label_column: str) -> DataFrame:
    """Attach a domain's label by broadcast join; the dimension has a fixed size."""
    dim = label_dimension(df.sparkSession, domain).select(
        F.col("code").alias("_code"), F.col("label").alias(label_column)
    )
    joined = df.join(F.broadcast(dim), F.col(code_column).cast("string") == F.col("_code"), "left")
    return joined.drop("_code")
