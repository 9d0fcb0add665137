"""Record layouts of the connection-record workload.

The names, types and orders below must equal the data they describe, so
they are fixed values, stated once and in file order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The KDD-Cup-99 connection-record spec (41 features, file
# order, "name: type." per line) preceded by the class-list line.
# ---------------------------------------------------------------------------
KDD_SPEC_TEXT = """\
back,buffer_overflow,ftp_write,guess_passwd,imap,ipsweep,land,loadmodule,multihop,neptune,nmap,normal,perl,phf,pod,portsweep,rootkit,satan,smurf,spy,teardrop,warezclient,warezmaster.
duration: continuous.
protocol_type: symbolic.
service: symbolic.
flag: symbolic.
src_bytes: continuous.
dst_bytes: continuous.
land: symbolic.
wrong_fragment: continuous.
urgent: continuous.
hot: continuous.
num_failed_logins: continuous.
logged_in: symbolic.
num_compromised: continuous.
root_shell: continuous.
su_attempted: continuous.
num_root: continuous.
num_file_creations: continuous.
num_shells: continuous.
num_access_files: continuous.
num_outbound_cmds: continuous.
is_host_login: symbolic.
is_guest_login: symbolic.
count: continuous.
srv_count: continuous.
serror_rate: continuous.
srv_serror_rate: continuous.
rerror_rate: continuous.
srv_rerror_rate: continuous.
same_srv_rate: continuous.
diff_srv_rate: continuous.
srv_diff_host_rate: continuous.
dst_host_count: continuous.
dst_host_srv_count: continuous.
dst_host_same_srv_rate: continuous.
dst_host_diff_srv_rate: continuous.
dst_host_same_src_port_rate: continuous.
dst_host_srv_diff_host_rate: continuous.
dst_host_serror_rate: continuous.
dst_host_srv_serror_rate: continuous.
dst_host_rerror_rate: continuous.
dst_host_srv_rerror_rate: continuous.
"""

# The 31 comma-separated fields of a streamed record, by
# position; "s" = string, "d" = double.
STREAM_RECORD_FIELDS = [
    ("timeStamp", "s"), ("srcIp", "s"), ("desIp", "s"), ("duration", "d"),
    ("protocol_type", "s"), ("service", "s"), ("flag", "s"), ("src_bytes", "d"),
    ("dst_bytes", "d"), ("land", "s"), ("wrong_fragment", "d"), ("urgent", "d"),
    ("count", "d"), ("srv_count", "d"), ("serror_rate", "d"), ("srv_serror_rate", "d"),
    ("rerror_rate", "d"), ("srv_rerror_rate", "d"), ("same_srv_rate", "d"),
    ("diff_srv_rate", "d"), ("srv_diff_host_rate", "d"), ("dst_host_count", "d"),
    ("dst_host_srv_count", "d"), ("dst_host_same_srv_rate", "d"),
    ("dst_host_diff_srv_rate", "d"), ("dst_host_same_src_port_rate", "d"),
    ("dst_host_srv_diff_host_rate", "d"), ("dst_host_serror_rate", "d"),
    ("dst_host_srv_serror_rate", "d"), ("dst_host_rerror_rate", "d"),
    ("dst_host_srv_rerror_rate", "d"),
]

# The assembler inputs of both feature pipelines, in order.
ASSEMBLER_INPUTS = [
    "duration", "protocol_type_Vec", "service_Vec", "flag_Vec", "src_bytes", "dst_bytes",
    "land_Vec", "wrong_fragment", "urgent", "count", "srv_count", "serror_rate",
    "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate",
    "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate",
    "dst_host_diff_srv_rate", "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate",
    "dst_host_serror_rate", "dst_host_srv_serror_rate", "dst_host_rerror_rate",
    "dst_host_srv_rerror_rate",
]

# The symbolic columns that are indexed and one-hot encoded.
SYMBOLIC_INPUTS = ["protocol_type", "service", "flag", "land"]

# Public column names of the two-stage pipeline.
FEATURES = "features"
SCALED_FEATURES = "scaledFeatures"
KMEANS_PREDICTION = "kmeansPrediction"
DISTANCE_TO_CENTERS = "distanceToCentersVector"
ASSEMBLED_FEATURES = "assemblerFeatures"
INDEXED_LABEL = "indexedLabel"
RF_PREDICTION = "rfPrediction"
PREDICTED_LABEL = "predictedLabel"


def stream_record_schema() -> T.StructType:
    return T.StructType([
        T.StructField(n, T.StringType() if t == "s" else T.DoubleType(), True)
        for n, t in STREAM_RECORD_FIELDS
    ])
