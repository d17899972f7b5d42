"""Names, lists, labels and widths that decide the results.

Everything here must keep its exact spelling; the operators take these as
defaults and accept other values as arguments.
"""

# The ten target bacteria, lower case.
TARGET_ORGANISMS = (
    "escherichia coli",
    "klebsiella pneumoniae",
    "klebsiella aerogenes",
    "enterobacter cloacae",
    "enterobacter aerogenes",
    "pseudomonas aeruginosa",
    "acinetobacter baumannii",
    "stenotrophomonas maltophilia",
    "enterococcus faecium",
    "staphylococcus aureus",
)

# The eleven specimen types left out, lower case.
EXCLUDED_SPECIMENS = (
    "swab",
    "fluid,other",
    "foreign body",
    "foot culture",
    "fluid received in blood culture bottles",
    "ear",
    "fluid wound",
    "dialysis fluid",
    "skin scrapings",
    "foreign body - sonication culture",
    "eye",
)

# Susceptibility results, the preferred one first.
INTERPRETATIONS = ("R", "S", "I")

# LIKE pattern on the lower-cased antibiotic name -> class.
# The first pattern that matches decides.
ANTIBIOTIC_CLASS_PATTERNS = (
    ("%ceftriaxone%", "Cefalosporinas_3ra"),
    ("%cefepime%", "Cefalosporinas_4ta"),
    ("%ceftazidime%", "Cefalosporinas_3ra"),
    ("%meropenem%", "Carbapenems"),
    ("%imipenem%", "Carbapenems"),
    ("%trimeth%prim%sulfa%", "Sulfonamidas"),
    ("%linezolid%", "Oxazolidinonas"),
    ("%daptomycin%", "Lipopéptidos"),
    ("%oxacillin%", "Penicilinas_antiestaf"),
    ("%vancomycin%", "Glicopéptidos"),
)
OTHER_CLASS = "Otra_clase"

# Drugs that count as treatment, lower case, whole name.
TREATMENT_DRUGS = (
    "ceftriaxone",
    "cefepime",
    "ceftazidime",
    "meropenem",
    "imipenem",
    "trimethoprim-sulfamethoxazole",
    "linezolid",
    "daptomycin",
    "oxacillin",
    "vancomycin",
)

# Chronic kidney disease, type 2 diabetes, heart failure.
COMORBIDITY_PREFIXES = ("N18", "E11", "I50")

# Block -> organisms (lower case) and antibiotic classes.
ENTEROBACTERALES = (
    "escherichia coli",
    "klebsiella pneumoniae",
    "klebsiella aerogenes",
    "enterobacter cloacae",
    "enterobacter aerogenes",
)
RESISTANCE_BLOCKS = (
    ("Bloque 1", ENTEROBACTERALES, ("Cefalosporinas_3ra", "Cefalosporinas_4ta")),
    ("Bloque 2", ENTEROBACTERALES, ("Carbapenems",)),
    ("Bloque 3", ("pseudomonas aeruginosa", "acinetobacter baumannii"), ("Carbapenems",)),
    ("Bloque 4", ("stenotrophomonas maltophilia",), ("Sulfonamidas",)),
    ("Bloque 5", ("enterococcus faecium",), ("Oxazolidinonas", "Lipopéptidos")),
    ("Bloque 6", ("staphylococcus aureus",), ("Penicilinas_antiestaf", "Glicopéptidos")),
)
OTHER_BLOCK = "Otros"

# Exposure window in hours, longest stay that counts as improvement.
WINDOW_HOURS = 48
IMPROVEMENT_MAX_DAYS = 30

# Preview sizes.
CULTURE_DETAIL_ROWS = 10
POSITIVE_DETAIL_ROWS = 100
PRIOR_TREATMENT_ROWS = 10
