"""Constants the results depend on, stated once and in natural order."""

# Window labels.
GUARD, INTERICTAL, ICTAL = -1, 0, 1

# Scalp electrode positions accepted in a bipolar label.
ELECTRODES = (
    "FP1 FP2 FPZ F1 F2 F3 F4 F5 F6 F7 F8 FZ "
    "FC1 FC2 FC3 FC4 FC5 FC6 FCZ FT9 FT10 FT7 FT8 "
    "C1 C2 C3 C4 C5 C6 CZ CP1 CP2 CP3 CP4 CP5 CP6 CPZ "
    "T1 T2 T3 T4 T5 T6 T7 T8 TP7 TP8 "
    "P1 P2 P3 P4 P5 P6 P7 P8 PZ PO3 PO4 POZ "
    "O1 O2 OZ A1 A2 M1 M2"
).split()

# Labels known not to be scalp channels.
NON_EEG_LABELS = ["ECG", "EKG", "VNS", "EMG", "LOC", "ROC", "LUE", "RAE", "-", ".", ""]

# The canonical bipolar montage, in order.
CANONICAL_CHANNELS = [
    "FP1-F7", "F7-T7", "T7-P7", "P7-O1", "FP1-F3", "F3-C3", "C3-P3", "P3-O1", "FP2-F4",
    "F4-C4", "C4-P4", "P4-O2", "FP2-F8", "F8-T8", "T8-P8", "P8-O2", "FZ-CZ", "CZ-PZ",
]

# Frequency bands in Hz, edges inclusive.
BANDS = {
    "delta": (0.5, 4.0),
    "theta": (4.0, 8.0),
    "alpha": (8.0, 13.0),
    "beta": (13.0, 30.0),
    "gamma": (30.0, 80.0),
}

# Temporal feature names, cross-channel statistics, column-subset markers.
TEMPORAL_FEATURES = ["line_length", "variance", "hjorth_mobility", "hjorth_complexity"]
CHANNEL_STATS = ["mean", "max", "std", "median"]
AMPLITUDE_INVARIANT_MARKERS = ["_rel", "hjorth"]
AMPLITUDE_DEPENDENT_MARKERS = ["_log", "line_length", "variance"]

# Filter constants.
NOTCH_Q = 30.0
BANDPASS_ORDER = 4

# Record naming, case table size, the two cases that are one subject.
RECORD_ID_PATTERN = r"^(chb\d{2})[a-z]?_(\d+)\+?$"
N_CASES = 24
N_SUBJECTS = 23
SHARED_SUBJECT_CASES = {"chb21": "sub01"}
CASE_WITHOUT_DEMOGRAPHICS = "chb24"

# Expected totals of the annotated database.
EXPECTED_INTERVALS = 198
EXPECTED_INTERVALS_FIRST_23 = 182
EXPECTED_ANNOTATED_RECORDS = 141

# The one record on which the two interval sources disagree.
RESOLVED_INTERVALS = {"chb24_21": [(2804, 2872)]}
DISPUTED_SPANS = {"chb24_21": [(2404, 2804)]}

# Ledger states and the fields captured before raw data may go.
DONE_STATES = ["extracted", "raw_deleted", "skipped"]
EXTRACTED_STATES = ["extracted", "raw_deleted"]
KEEP_CASES = ["chb01", "chb12", "chb17"]
REQUIRED_BEFORE_DELETE = [
    "checksum_verified", "n_samples", "duration_sec", "channel_labels",
    "channel_stats", "features_path", "n_windows",
]

# Summary-text grammar (case-insensitive).
SUMMARY_FILE_NAME = r"(?i)^File\s*Name:\s*(\S+)"
SUMMARY_COUNT = r"(?i)^Number\s*of\s*Seizures\s*in\s*File:\s*(\d+)"
SUMMARY_TIME = r"(?i)^Seizure\s*(\d+)?\s*(Start|End)\s*Time:\s*([\d.]+)\s*(?:seconds)?"
SUMMARY_IGNORED = r"(?i)^(File\s*(Start|End)\s*Time|Channel\s|Channels\s)"
SUMMARY_EVENT_LINE = r"(?i)^Seizure"

# Annotation word codes.
ANNOTATION_CODES = {
    "END": 0, "NOTE": 22, "ONSET": 32, "OFFSET": 33, "SKIP": 59, "NUM": 60, "SUB": 61,
    "CHN": 62, "AUX": 63,
}
ANNOTATION_RATE_PATTERN = r"(?i)time\s+resolution:\s*([\d.]+)"
ANNOTATION_DEFAULT_HZ = 256.0

# Wide CSV layout.
CSV_CHANNELS = 18
CSV_SAMPLES = 2048
CSV_SAMPLE_RATE = 256

# Model names and their search grids.
MODELS = ["dummy", "logreg", "rf", "hgb"]
SEARCH_GRIDS = {
    "dummy": {},
    "logreg": {"C": [0.01, 0.1, 1.0, 10.0]},
    "rf": {"max_depth": [None, 12], "min_samples_leaf": [1, 5]},
    "hgb": {"learning_rate": [0.05, 0.1], "max_leaf_nodes": [15, 31]},
}

# Overlap thresholds of the sensitivity sweep.
OVERLAP_FRACTIONS = [0.1, 0.25, 0.5, 0.75]
