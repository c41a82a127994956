"""Record layouts and fixed value sets."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: enumerations of the traffic log ---------------------------------
THREAT_TYPES = [
    "benign", "phishing", "malware", "dos", "ddos", "probe", "r2l", "u2r", "brute_force",
    "sql_injection", "xss", "botnet", "infiltration", "web_attack", "unknown",
]
ACTIONS = ["allow", "block", "challenge", "log", "alert"]
RISK_LEVELS = ["safe", "low", "medium", "high", "critical"]
ORDERABLE = [
    "id", "timestamp", "source_ip", "dest_ip", "dest_port", "protocol", "method",
    "threat_type", "risk_level", "risk_score", "action", "processing_time_ms",
]

PREDICTION = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("prediction", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("inference_time_ms", T.DoubleType()),
])

GEO = T.StructType([
    T.StructField("country", T.StringType()),
    T.StructField("country_code", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

TRAFFIC_LOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("threat_type", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("action", T.StringType()),
    T.StructField("predictions", T.ArrayType(PREDICTION)),
    T.StructField("ensemble_score", T.DoubleType()),
    T.StructField("geo_location", GEO),
    T.StructField("features", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("captcha_required", T.BooleanType()),
    T.StructField("captcha_passed", T.BooleanType()),
    T.StructField("processing_time_ms", T.DoubleType()),
])

PACKET = T.StructType([
    T.StructField("pkt_no", T.LongType()),
    T.StructField("ts_s", T.DoubleType()),
    T.StructField("src_mac", T.StringType()),
    T.StructField("dst_mac", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("packet_size", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("ttl", T.IntegerType()),
    T.StructField("payload_size", T.IntegerType()),
    T.StructField("header_size", T.IntegerType()),
    T.StructField("window_size", T.IntegerType()),
    T.StructField("direction", T.IntegerType()),
])

# --- fixed values: the phishing feature table, in schema order ----------------------
PHISHING_FEATURES = [
    "having_IP_Address", "URL_Length", "Shortining_Service", "having_At_Symbol",
    "double_slash_redirecting", "Prefix_Suffix", "having_Sub_Domain", "SSLfinal_State",
    "Domain_registeration_length", "Favicon", "port", "HTTPS_token", "Request_URL",
    "URL_of_Anchor", "Links_in_tags", "SFH", "Submitting_to_email", "Abnormal_URL",
    "Redirect", "on_mouseover", "RightClick", "popUpWidnow", "Iframe", "age_of_domain",
    "DNSRecord", "web_traffic", "Page_Rank", "Google_Index", "Links_pointing_to_page",
    "Statistical_report",
]
PHISHING_TARGET = "Result"
PHISHING = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in [*PHISHING_FEATURES, PHISHING_TARGET]]
)

# --- fixed values: the NSL-KDD connection record, in file order ---------------------
KDD_FEATURES = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in", "num_compromised",
    "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells",
    "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count",
    "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
]
KDD_CATEGORICAL = ["protocol_type", "service", "flag"]
KDD_NUMERIC = [c for c in KDD_FEATURES if c not in KDD_CATEGORICAL]
KDD = T.StructType(
    [
        T.StructField(c, T.StringType() if c in KDD_CATEGORICAL else T.DoubleType())
        for c in KDD_FEATURES
    ]
    + [T.StructField("attack_type", T.StringType()), T.StructField("difficulty", T.IntegerType())]
)

# --- fixed values: the flow-meter record, in file order -----------------------------
CICIDS_FEATURES = [
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Fwd Packet Length Max",
    "Fwd Packet Length Min", "Fwd Packet Length Mean", "Bwd Packet Length Max",
    "Bwd Packet Length Min", "Bwd Packet Length Mean", "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Fwd IAT Total", "Fwd IAT Mean", "Bwd IAT Total",
    "Bwd IAT Mean", "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length", "FIN Flag Count", "SYN Flag Count",
    "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count",
]
CICIDS = T.StructType([T.StructField(c, T.DoubleType()) for c in CICIDS_FEATURES])


def missing_and_extra(columns: list[str], required: list[str]) -> tuple[list[str], list[str]]:
    """Names required but absent, and names present but not required."""
    return (
        [c for c in required if c not in columns],
        [c for c in columns if c not in required],
    )
