"""Label catalogue: what each label stands for, its weight when it is missed, and BIO tag ids."""

from __future__ import annotations

# Labels, their category numbers and recall weights.
CATEGORIES = {
    "NAME": "1", "LOCATION": "2", "DATE": "3", "AGE": "3b", "PHONE": "4", "FAX": "5", "EMAIL": "6", "SSN": "7", "MRN": "8",
    "HEALTHPLAN": "9", "ACCOUNT": "10", "LICENSE": "11", "VEHICLE": "12", "DEVICE": "13", "URL": "14", "IP": "15", "ID_OTHER": "18",
}
EXCLUDED = {16: "biometrics are no text", 17: "pictures of faces are no text"}
WEIGHTS = {
    "SSN": 5.0, "MRN": 4.0, "HEALTHPLAN": 4.0, "ACCOUNT": 3.0, "NAME": 3.0, "PHONE": 2.5, "EMAIL": 2.5, "DEVICE": 2.0, "LICENSE": 2.0,
    "VEHICLE": 2.0, "IP": 2.0, "URL": 1.5, "LOCATION": 2.0, "DATE": 2.0, "AGE": 2.0, "FAX": 2.0, "ID_OTHER": 2.5,
}
#: Labels of a common third-party detector and ours; the others are dropped.
FOREIGN = {
    "PERSON": "NAME", "LOCATION": "LOCATION", "DATE_TIME": "DATE", "PHONE_NUMBER": "PHONE", "EMAIL_ADDRESS": "EMAIL", "US_SSN": "SSN",
    "URL": "URL", "IP_ADDRESS": "IP", "MEDICAL_LICENSE": "LICENSE", "US_BANK_NUMBER": "ACCOUNT",
}
DEFAULT_WEIGHT = 2.0
LABELS = sorted(CATEGORIES)
TAGS = ["O"] + [f"{part}-{label}" for label in LABELS for part in "BI"]
TAG_IDS = {tag: n for n, tag in enumerate(TAGS)}
