"""Label recoding and attack-name mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: attack name -> category ------------------------------------------
CATEGORY = {
    "normal": ["normal"],
    "dos": ["neptune", "smurf", "pod", "teardrop", "land", "back", "apache2", "processtable",
            "mailbomb", "udpstorm"],
    "probe": ["ipsweep", "portsweep", "nmap", "satan", "mscan", "saint"],
    "r2l": ["guess_passwd", "ftp_write", "imap", "phf", "multihop", "warezmaster",
            "warezclient", "spy", "xlock", "xsnoop", "snmpguess", "snmpgetattack",
            "httptunnel", "sendmail", "named", "worm"],
    "u2r": ["buffer_overflow", "loadmodule", "rootkit", "perl", "sqlattack", "xterm", "ps"],
}

# --- fixed values: attack name -> threat name of the traffic log ----------------------
THREAT = {
    "benign": ["normal"],
    "ddos": ["neptune", "smurf", "pod", "teardrop", "land", "back", "apache2", "udpstorm",
             "processtable", "mailbomb"],
    "port_scan": ["ipsweep", "portsweep", "nmap", "satan", "mscan", "saint", "ps"],
    "brute_force": ["guess_passwd", "ftp_write", "imap", "phf", "multihop", "warezmaster",
                    "warezclient", "spy", "xlock", "xsnoop", "snmpguess", "snmpgetattack",
                    "httptunnel", "sendmail", "named"],
    "sql_injection": ["buffer_overflow", "loadmodule", "sqlattack"],
    "malware": ["worm", "rootkit"],
    "xss": ["perl", "xterm"],
}

# --- fixed values: attack name -> threat name, the short variant -----------------------
THREAT_SHORT = {
    "benign": ["normal"],
    "ddos": ["neptune", "smurf", "pod", "teardrop", "land", "back", "apache2", "processtable",
             "mailbomb"],
    "port_scan": ["ipsweep", "portsweep", "nmap", "satan", "mscan", "saint"],
    "brute_force": ["guess_passwd", "ftp_write", "imap", "warezmaster", "snmpguess"],
    "sql_injection": ["buffer_overflow"],
    "malware": ["rootkit"],
    "xss": ["perl", "xterm"],
}

MAPPINGS = {"category": CATEGORY, "threat": THREAT, "threat_short": THREAT_SHORT}
ATTACK_NAMES = sorted(n for names in CATEGORY.values() for n in names)


def map_attacks(df: DataFrame, mapping: str = "category", column: str = "attack_type",
                out: str = "mapped", unknown: str = "unknown") -> DataFrame:
    """Look the attack name up in a mapping table; names outside it give ``unknown``.

    The tables are fixed (at most 40 names), hence the broadcast hint.
    """
    rows = ", ".join(f"('{n}', '{label}')" for label, names in MAPPINGS[mapping].items() for n in names)
    lookup = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS m(_name, _label)")
    joined = df.join(F.broadcast(lookup), F.col(column) == F.col("_name"), "left")
    return joined.select(*df.columns, F.coalesce("_label", F.lit(unknown)).alias(out))


def is_attack(column: str = "attack_type") -> Column:
    return (F.col(column) != "normal").cast("int")


def zero_one(target: str = "Result") -> Column:
    """-1 becomes 0; 1 stays."""
    return F.when(F.col(target) == -1, 0).otherwise(F.col(target))


def verdict_text(prediction: Column, positive_label: int = 1) -> Column:
    """Readable label; which value means malicious is the caller's choice."""
    return F.when(prediction == positive_label, "Malicious").otherwise("Safe")


def pick_required(df: DataFrame, required: list[str], keep: list[str] = ()) -> DataFrame:
    """The required columns in order; everything else is dropped except ``keep``."""
    return df.select(*keep, *required)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, with the majority / minority ratio on every row."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
    ratio = counts.agg(F.try_divide(F.max("cnt"), F.min("cnt")))
    return counts.withColumn("imbalance_ratio", ratio.scalar())
