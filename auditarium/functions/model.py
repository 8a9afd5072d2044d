"""The data model: levels, compliance profiles, policies, and driver-style tables seen as audit events."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Level codes in order, from the least severe.
LEVEL_CODES = ("VRB", "DBG", "INF", "WRN", "ERR", "FTL")
VERBOSE, DEBUG, INFORMATION, WARNING, ERROR, FATAL = range(6)
FLAG_DELETED, FLAG_COMPACTED = 1, 2
#: Bytes of a record besides its payload.
RECORD_OVERHEAD = 72
#: The previous hash of a log's first record.
NO_HASH = "0" * 64
MISSING, REDACTED = "[MISSING_REQUIRED]", "[REDACTED]"


@dataclass(frozen=True)
class Profile:
    name: str
    signing: str
    retention_days: int
    min_days: int
    max_days: int
    mask: tuple[str, ...]
    required: tuple[str, ...]
    tamper_proof: bool
    access_log: bool
    immutable: bool
    encryption: str = "AES-256-GCM"


# The four supported profiles.
PROFILES = {
    p.name: p
    for p in (
        Profile("HIPAA", "Ed25519", 2190, 2190, 3650, ("SSN", "ssn", "SocialSecurityNumber", "MRN", "mrn", "MedicalRecordNumber", "DOB", "dob", "DateOfBirth", "birthdate", "AccountNumber", "account_number", "DL", "DriversLicense", "drivers_license", "Email", "email", "EmailAddress", "Phone", "phone", "PhoneNumber"), ("UserId", "PatientId", "Action", "Timestamp", "IPAddress"), True, True, True),
        Profile("PCI-DSS", "RSA-PSS", 365, 365, 2555, ("PAN", "pan", "CardNumber", "card_number", "CVV", "cvv", "SecurityCode", "security_code", "PIN", "pin", "CardholderName", "cardholder_name", "ExpiryDate", "expiry_date"), ("TransactionId", "MerchantId", "Amount", "Currency", "Timestamp"), True, True, False),
        Profile("SOX", "RSA-PSS", 2555, 2555, 3650, (), ("UserId", "TransactionId", "Amount", "Account", "Timestamp", "ApprovalChain"), True, True, True),
        Profile("GDPR", "", 1095, 0, 2190, ("Email", "email", "Name", "name", "FullName", "Address", "address", "Phone", "phone", "IPAddress", "ip_address", "DeviceId", "device_id", "NationalId", "national_id"), ("DataSubjectId", "Purpose", "LegalBasis", "Timestamp", "ConsentId"), False, True, False),
    )
}

# Patterns of sensitive text. Boundaries are ASCII ones, whatever the engine's \b means.
_EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
PATTERNS = {
    "SSN": r"\d{3}-?\d{2}-?\d{4}",
    "CREDITCARD": r"\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}",
    "PHONE": r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "IP": r"(?:\d{1,3}\.){3}\d{1,3}",
    "MRN": r"[A-Z]{2}\d{6,8}",
    "PAN": r"\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}",
}


#: Patterns whose matches begin and end with a word character need only look for one beside them; what a text with a match has in any case, quick to look for.
_WORDS = frozenset("SSN CREDITCARD PAN IP MRN".split())
GUARDS = {"SSN": r"\d{3}", "CREDITCARD": r"\d{4}", "PAN": r"\d{4}", "EMAIL": "@", "PHONE": r"\d{3}", "IP": r"\d\.\d", "MRN": r"\d{6}"}


def bounded(pattern: str, term: str = "") -> str:
    """pattern between ASCII word boundaries."""
    return f"(?<![0-9A-Za-z_]){pattern}(?![0-9A-Za-z_])" if term in _WORDS else f"{_EDGE}{pattern}{_EDGE}"


@dataclass(frozen=True)
class CompactionPolicy:
    min_segments: int = 5
    max_age_hours: int = 24
    min_segment_size: int = 1 << 20
    target_size: int = 64 << 20
    archive_days: int = 7
    ratio: float = 0.5

    def __post_init__(self):
        if not 0 <= self.ratio <= 1:
            raise ValueError(f"ratio must be between 0 and 1, not {self.ratio}")


@dataclass(frozen=True)
class LogConfig:
    """What a log is written with; values that can't work raise."""

    segment_bytes: int = 64 << 20
    sync: str = "interval"
    sync_ms: int = 100
    profile: str | None = None
    retry_attempts: int = 3
    backends: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if self.segment_bytes <= 0:
            raise ValueError("segment_bytes must be positive")
        if self.sync not in ("immediate", "interval", "batch"):
            raise ValueError(f"no sync mode {self.sync}")
        if self.sync_ms <= 0 or self.retry_attempts < 0:
            raise ValueError("sync_ms must be positive and retry_attempts not negative")
        if self.profile is not None and self.profile not in PROFILES:
            raise ValueError(f"no profile {self.profile}")


def level_code(level: Column) -> Column:
    """Three letters for a level's number, else L and the number."""
    codes = F.array(*map(F.lit, LEVEL_CODES))
    return F.when(level.between(0, len(LEVEL_CODES) - 1), F.element_at(codes, level + 1)).otherwise(F.concat(F.lit("L"), level.cast("string")))


def format_bytes(n: Column) -> Column:
    """Bytes as text, to base 1024 with one decimal (ties to even)."""
    text = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate("KMGTPE", 1):
        text = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}B", F.bround(n / float(1024**k), 1))).otherwise(text)
    return text


def profiles(spark: SparkSession) -> DataFrame:
    """The profiles as a table (four rows: safe to broadcast)."""
    rows = [(p.name, p.encryption, p.signing, list(p.mask), list(p.required), p.retention_days, p.min_days, p.max_days, True, bool(p.signing), p.tamper_proof, p.access_log, p.immutable) for p in PROFILES.values()]
    return spark.createDataFrame(rows, "name string, enc_algo string, sign_algo string, mask array<string>, audit_props array<string>, retention_days int, min_days int, max_days int, encryption boolean, signing boolean, tamper_proof boolean, access_log boolean, immutable boolean")


#: event types by level, of the driver's events table.
_LEVELS = {"error": ERROR, "purchase": WARNING, "signup": INFORMATION, "click": DEBUG}


def events_from_table(df: DataFrame, segment_rows: int = 1000) -> DataFrame:
    """A table event_id, ts, user_id, event_type, value, props as audit events. Narrow: each column is an expression of its row."""
    level = reduce(lambda done, x: done.when(F.col("event_type") == x[0], x[1]), _LEVELS.items(), F.when(F.lit(False), 0)).otherwise(VERBOSE)
    data = F.concat_ws("|", "event_id", "user_id", "event_type", "props")
    return df.select(
        (F.col("event_id") + 1).alias("sequence"), "ts", level.alias("level"), F.col("user_id").cast("string").alias("entity_id"), "event_type", "value", "props",
        data.alias("event_data"), (F.octet_length(data) + RECORD_OVERHEAD).cast("long").alias("size"), F.expr(f"event_id div {segment_rows}").alias("segment"),
        F.when(F.pmod("event_id", F.lit(10)) == 3, FLAG_DELETED).otherwise(0).alias("flags"),
    )
