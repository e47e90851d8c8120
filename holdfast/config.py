"""Column roles, valid ranges, weights and labels of the learner table."""

from __future__ import annotations

ID = "student_id"
TARGET = "Dropped_Out"

# The source columns in file order.
SOURCE_COLUMNS = (
    "School",
    "Gender",
    "Age",
    "Address",
    "Family_Size",
    "Parental_Status",
    "Mother_Education",
    "Father_Education",
    "Mother_Job",
    "Father_Job",
    "Reason_for_Choosing_School",
    "Guardian",
    "Travel_Time",
    "Study_Time",
    "Number_of_Failures",
    "School_Support",
    "Family_Support",
    "Extra_Paid_Class",
    "Extra_Curricular_Activities",
    "Attended_Nursery",
    "Wants_Higher_Education",
    "Internet_Access",
    "In_Relationship",
    "Family_Relationship",
    "Free_Time",
    "Going_Out",
    "Weekend_Alcohol_Consumption",
    "Weekday_Alcohol_Consumption",
    "Health_Status",
    "Number_of_Absences",
    "Grade_1",
    "Grade_2",
    "Final_Grade",
    "Dropped_Out",
)

# yes/no columns.
BINARY_COLUMNS = (
    "School_Support",
    "Family_Support",
    "Extra_Paid_Class",
    "Extra_Curricular_Activities",
    "Attended_Nursery",
    "Wants_Higher_Education",
    "Internet_Access",
    "In_Relationship",
)

# Valid range of each numeric column that has one.
VALUE_RANGES = {
    "Age": (15, 22),
    "Travel_Time": (1, 4),
    "Study_Time": (1, 4),
    "Number_of_Failures": (0, 3),
    "Family_Relationship": (1, 5),
    "Free_Time": (1, 5),
    "Going_Out": (1, 5),
    "Weekend_Alcohol_Consumption": (1, 5),
    "Weekday_Alcohol_Consumption": (1, 5),
    "Health_Status": (1, 5),
    "Number_of_Absences": (0, 32),
    "Grade_1": (0, 20),
    "Grade_2": (0, 20),
    "Final_Grade": (0, 20),
}

NUMERIC_COLUMNS = (*VALUE_RANGES, "Mother_Education", "Father_Education")

CATEGORICAL_COLUMNS = tuple(
    c for c in SOURCE_COLUMNS
    if c not in NUMERIC_COLUMNS and c not in BINARY_COLUMNS and c != TARGET
)

# Texts read as a missing cell (the public default list of pandas.read_csv).
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Target texts that mean "dropped out".
TRUE_TEXTS = ("true", "1", "yes")

# Weights of the scores.
GRADE_WEIGHTS = {"Grade_1": 0.25, "Grade_2": 0.35, "Final_Grade": 0.40}
ALCOHOL_WEIGHTS = {"Weekday_Alcohol_Consumption": 0.6, "Weekend_Alcohol_Consumption": 0.4}
SOCIAL_WEIGHTS = {"Going_Out": 0.4, "alcohol_risk_score": 0.4, "Free_Time": 0.2}
SUPPORT_WEIGHTS = {"Family_Relationship": 0.5, "Family_Support": 2.0, "School_Support": 1.5}
ENGAGEMENT_WEIGHTS = {
    "Study_Time": 0.4,
    "Wants_Higher_Education": 1.5,
    "Internet_Access": 0.5,
    "Extra_Curricular_Activities": 0.5,
}
RISK_WEIGHTS = {
    "performance": 0.35,
    "social": 0.20,
    "absence": 0.20,
    "failure": 0.15,
    "engagement": 0.10,
}
GRADE_CEILING = 20
ABSENCE_THRESHOLD = 10

# The feature columns in the order they are built.
FEATURE_COLUMNS = (
    "academic_performance_score",
    "grade_progression",
    "alcohol_risk_score",
    "social_risk_index",
    "family_support_score",
    "engagement_score",
    "parental_education_level",
    "absence_risk_flag",
    "failure_history_flag",
    "combined_risk_score",
)

# Columns of the correlation matrix.
CORRELATION_COLUMNS = (
    "Grade_1",
    "Grade_2",
    "Final_Grade",
    "Number_of_Absences",
    "Number_of_Failures",
    "Study_Time",
    "Going_Out",
    "Weekend_Alcohol_Consumption",
    "Weekday_Alcohol_Consumption",
    "Health_Status",
    "academic_performance_score",
    "combined_risk_score",
    "engagement_score",
    "social_risk_index",
    "Dropped_Out",
)

GRADE_COLUMNS = ("Grade_1", "Grade_2", "Final_Grade")

# Labels of the target and of the weekly study time.
STATUS_LABELS = {0: "Actif", 1: "Décroché"}
STUDY_TIME_LABELS = {1: "<2h", 2: "2-5h", 3: "5-10h", 4: ">10h"}
RISK_BINS = 30

# Columns and ranges the quality rules look at.
REQUIRED_COLUMNS = (
    "Age",
    "Study_Time",
    "Number_of_Failures",
    "Number_of_Absences",
    "Grade_1",
    "Grade_2",
    "Final_Grade",
    "Dropped_Out",
)
QUALITY_RANGES = {**VALUE_RANGES, TARGET: (0, 1)}
QUALITY_FEATURES = (
    "academic_performance_score",
    "grade_progression",
    "alcohol_risk_score",
    "social_risk_index",
    "engagement_score",
    "combined_risk_score",
    "absence_risk_flag",
    "failure_history_flag",
)
MINIMUM_ROWS = 100

# Title and severity of each quality rule.
QUALITY_RULES = {
    "dq_required_columns": ("Colonnes requises présentes", "error"),
    "dq_no_missing": ("Absence de valeurs manquantes", "error"),
    "dq_no_duplicates": ("Absence de doublons", "warning"),
    "dq_column_types": ("Types de colonnes corrects", "error"),
    "dq_value_ranges": ("Valeurs dans les plages attendues", "warning"),
    "dq_target_balance": ("Variable cible non dégénérée (2 classes)", "error"),
    "dq_grade_consistency": ("Cohérence des notes (G1, G2, Final)", "warning"),
    "dq_min_rows": ("Dataset contient au moins {min_rows} lignes", "error"),
    "dq_feature_columns": ("Features engineered présentes", "warning"),
}

# Model inputs by role, in matrix order.
MODEL_NUMERIC_COLUMNS = (
    "Age",
    "Travel_Time",
    "Study_Time",
    "Number_of_Failures",
    "Family_Relationship",
    "Free_Time",
    "Going_Out",
    "Weekend_Alcohol_Consumption",
    "Weekday_Alcohol_Consumption",
    "Health_Status",
    "Number_of_Absences",
    "Grade_1",
    "Grade_2",
    "Final_Grade",
    "Mother_Education",
    "Father_Education",
    *FEATURE_COLUMNS,
)
ONE_HOT_PREFIXES = (
    "School",
    "Gender",
    "Address",
    "Family_Size",
    "Parental_Status",
    "Mother_Job",
    "Father_Job",
    "Reason_for_Choosing_School",
    "Guardian",
)
SCALED_COLUMNS = (
    "Age",
    "Number_of_Absences",
    "Grade_1",
    "Grade_2",
    "Final_Grade",
    "academic_performance_score",
    "grade_progression",
    "family_support_score",
    "engagement_score",
    "parental_education_level",
    "combined_risk_score",
)
TEST_SHARE = 0.2
SPLIT_SEED = 42


# Weights of the metrics in the composite score.
METRIC_WEIGHTS = {"f1": 0.40, "roc_auc": 0.30, "accuracy": 0.20, "recall": 0.10}

# Sentence that explains the selected model.
JUSTIFICATION = (
    "'%s' sélectionné avec F1=%.4f, ROC-AUC=%.4f, score composite=%.4f. "
    "F1 priorisé car dataset déséquilibré (15%% décrochage)."
)

# The classifiers and their settings.
MODELS = {
    "baseline_majority": {"kind": "majority"},
    "logistic_regression": {"kind": "logistic", "iterations": 1000, "balanced": True},
    "random_forest_v1": {"kind": "forest", "trees": 100, "depth": 10, "balanced": True},
    "random_forest_v2": {
        "kind": "forest", "trees": 200, "depth": 15, "min_split": 5, "balanced": True,
    },
    "gradient_boosting": {"kind": "boosting", "rounds": 100, "depth": 5, "rate": 0.1},
    "xgboost": {
        "kind": "boosting", "rounds": 200, "depth": 6, "rate": 0.1,
        "row_share": 0.8, "column_share": 0.8,
    },
}
MODEL_SEED = 42

# Titles of the checks a model must pass.
MODEL_CHECKS = {
    "finite": "Prédictions sans NaN/Inf",
    "repeatable": "Reproductibilité des prédictions",
    "classes": "Classes de sortie valides {0,1}",
    "single_row": "Prédiction échantillon unique",
    "size": "Taille sortie = taille entrée",
    "probability": "Probabilités dans [0,1] et somme=1",
    "sensitivity": "Sensibilité aux features",
}
SENSITIVITY_ROWS = 50
CLASS_NAMES = {0: "Actif (0)", 1: "Décroché (1)"}

# Request field, source column, type and default, in request order.
REQUEST_FIELDS = (
    ("age", "Age", "int", 18),
    ("travel_time", "Travel_Time", "int", 2),
    ("study_time", "Study_Time", "int", 3),
    ("failures", "Number_of_Failures", "int", 0),
    ("family_rel", "Family_Relationship", "int", 4),
    ("free_time", "Free_Time", "int", 3),
    ("going_out", "Going_Out", "int", 3),
    ("weekday_alcohol", "Weekday_Alcohol_Consumption", "int", 1),
    ("weekend_alcohol", "Weekend_Alcohol_Consumption", "int", 1),
    ("health", "Health_Status", "int", 4),
    ("absences", "Number_of_Absences", "int", 0),
    ("grade_1", "Grade_1", "int", 14),
    ("grade_2", "Grade_2", "int", 15),
    ("final_grade", "Final_Grade", "int", 16),
    ("mother_edu", "Mother_Education", "int", 2),
    ("father_edu", "Father_Education", "int", 2),
    ("mother_job", "Mother_Job", "string", "services"),
    ("father_job", "Father_Job", "string", "other"),
    ("school", "School", "string", "GP"),
    ("sex", "Gender", "string", "M"),
    ("address", "Address", "string", "U"),
    ("famsize", "Family_Size", "string", "GT3"),
    ("pstatus", "Parental_Status", "string", "T"),
    ("schoolsup", "School_Support", "string", "no"),
    ("famsup", "Family_Support", "string", "yes"),
    ("paid", "Extra_Paid_Class", "string", "no"),
    ("activities", "Extra_Curricular_Activities", "string", "yes"),
    ("nursery", "Attended_Nursery", "string", "yes"),
    ("higher", "Wants_Higher_Education", "string", "yes"),
    ("internet", "Internet_Access", "string", "yes"),
    ("romantic", "In_Relationship", "string", "no"),
)
# Model columns a request does not carry.
REQUEST_CONSTANTS = {"Reason_for_Choosing_School": "course", "Guardian": "mother"}
# Fields an uploaded file must have, under their own or their source name.
UPLOAD_FIELDS = (
    "age", "school", "sex", "grade_1", "grade_2", "final_grade", "failures", "absences",
    "study_time", "travel_time", "weekday_alcohol", "weekend_alcohol",
)
DECISION_THRESHOLD = 0.5
# Upper bound (exclusive) and name of each confidence band.
CONFIDENCE_BANDS = ((0.4, "Faible"), (0.6, "Moyenne"), (0.8, "Forte"))
TOP_CONFIDENCE = "Tres forte"
# Columns and outcome names of a displayed score.
DISPLAY_COLUMNS = (
    "school", "sex", "age", "absences", "grade_1", "grade_2", "final_grade",
    "prediction", "probability", "confidence",
)
OUTCOME_NAMES = {1: "Dropout", 0: "Active"}
