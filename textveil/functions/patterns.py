"""The fourteen grammars in order of priority."""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    label: str
    regex: str
    ignore_case: bool
    guard: str  # cheap SQL condition on {text} without which nothing matches: a rare sign first, so that it is sought alone

    @property
    def java(self) -> str:
        """With Unicode classes, as the grammars mean them."""
        return ("(?iU)" if self.ignore_case else "(?U)") + self.regex

    @property
    def ascii(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.regex


# Patterns and the window before a phone number in which the word fax counts.
PATTERNS = [
    Pattern("SSN", r"\b\d{3}-\d{2}-\d{4}\b", False, r"{text} rlike '(?U)-\\d\\d-\\d{{4}}'"),
    Pattern("EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", False, "contains({text}, '@')"),
    Pattern("URL", r"\bhttps?://[^\s,)]+", False, "contains({text}, '://')"),
    Pattern("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", False, r"{text} rlike '(?U)\\.\\d{{1,3}}\\.'"),
    Pattern("PHONE_OR_FAX", r"\(\d{3}\)\s?\d{3}-\d{4}|\b\d{3}-\d{3}-\d{4}\b", False, r"{text} rlike '(?U)-(?<=\\d{{3}}-)\\d{{4}}'"),
    Pattern("MRN", r"\b(?:MRN|PCG|MER)-?\d{5,8}\b", False, "contains({text}, 'MRN') or contains({text}, 'PCG') or contains({text}, 'MER')"),
    Pattern("HEALTHPLAN", r"\b\d{2}-\d{4}-\d{3}\b", False, r"{text} rlike '(?U)-\\d{{4}}-\\d{{3}}'"),
    Pattern("ACCOUNT", r"\bACCT-\d{6,8}\b|\b(?:ED|OR|PT|RAD)-\d{2}-\d{4}-\d{3}\b", False, r"contains({text}, 'ACCT-') or {text} rlike '(?U)-\\d\\d-\\d{{4}}-\\d{{3}}'"),
    Pattern("LICENSE", r"\bNPI-\d{9,10}\b", False, "contains({text}, 'NPI-')"),
    Pattern("DEVICE", r"\bSN\d{5,7}-[A-Z]\b", False, "contains({text}, 'SN')"),
    Pattern("VEHICLE", r"\b[A-Z]{3}-\d{4}\b", False, r"{text} rlike '(?U)-(?<=[A-Z]{{3}}-)\\d{{4}}'"),
    Pattern(
        "DATE",
        r"\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s*\d{4}\b",
        False, r"{text} rlike '(?U)/\\d{{1,2}}/\\d\\d' or {text} rlike '(?U),\\s*\\d{{4}}'",
    ),
    Pattern("AGE", r"\bage\s+(9[0-9]|1\d{2})\b", True, "{text} rlike '(?i)age'"),
    Pattern("ID_OTHER", r"\b(?:EMS|CLAIM|PI)-\d{4}-\d{3,5}\b", True, r"{text} rlike '(?U)-\\d{{4}}-\\d{{3}}'"),
]
FAX_WINDOW, FAX_WORD = 25, r"\bfax\b"
