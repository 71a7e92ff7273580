"""Source column names, renames and lookup tables of the supported flow datasets."""

from __future__ import annotations

# Column order of the headerless connection-record files.
KDD_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes",
    "dst_bytes", "land", "wrong_fragment", "urgent", "hot",
    "num_failed_logins", "logged_in", "num_compromised", "root_shell",
    "su_attempted", "num_root", "num_file_creations", "num_shells",
    "num_access_files", "num_outbound_cmds", "is_host_login",
    "is_guest_login", "count", "srv_count", "serror_rate",
    "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate",
    "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate",
    "dst_host_serror_rate", "dst_host_srv_serror_rate",
    "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
    "attack_type", "difficulty_level",
]

# Attack name -> category; every name but "normal" is an attack.
KDD_TAXONOMY = {
    "normal": "Normal",
    "neptune": "DDoS",
    "warezclient": "Exploit",
    "ipsweep": "PortScan",
    "portsweep": "PortScan",
    "teardrop": "DoS",
    "nmap": "PortScan",
    "satan": "PortScan",
    "smurf": "DDoS",
    "pod": "DoS",
    "back": "DoS",
    "guess_passwd": "Brute",
    "ftp_write": "Exploit",
    "multihop": "Exploit",
    "rootkit": "Exploit",
    "buffer_overflow": "Exploit",
    "imap": "Exploit",
    "warezmaster": "Exploit",
    "phf": "Exploit",
    "land": "DoS",
    "loadmodule": "Exploit",
    "spy": "Exploit",
    "perl": "Exploit",
    "processtable": "DoS",
    "udpstorm": "DDoS",
    "xlock": "Exploit",
    "xsnoop": "Exploit",
    "snmpgetattack": "Exploit",
    "named": "Exploit",
    "xterm": "Exploit",
    "sendmail": "Exploit",
    "httptunnel": "Exploit",
    "worm": "Botnet",
    "mailbomb": "DDoS",
    "mscan": "PortScan",
    "apache2": "DoS",
    "saint": "PortScan",
    "ps": "Exploit",
    "sqlattack": "Exploit",
    "snmpguess": "Exploit",
}
TAXONOMY_DEFAULT = ("Unknown", 1)

PROTOCOL_CODES = {"tcp": 0, "udp": 1, "icmp": 2}

# Source column -> unified feature, per dataset family.
KDD_RENAMES = {
    "duration": "session_duration",
    "src_bytes": "byte_rate",
    "dst_bytes": "burst_length",
    "count": "conn_frequency",
    "srv_count": "unique_dst_ips",
    "dst_host_count": "packet_rate",
    "dst_host_srv_count": "inter_arrival_time",
    "same_srv_rate": "port_diversity",
    "diff_srv_rate": "protocol_distribution",
    "serror_rate": "response_time",
    "rerror_rate": "payload_size_mean",
    "srv_serror_rate": "payload_size_std",
}
UNSW_RENAMES = {
    "rate": "packet_rate",
    "sbytes": "byte_rate",
    "dbytes": "burst_length",
    "sinpkt": "inter_arrival_time",
    "ct_srv_src": "conn_frequency",
    "ct_dst_src_ltm": "unique_dst_ips",
    "dport": "port_diversity",
    "proto": "protocol_distribution",
    "res_bdy_len": "response_time",
    "dur": "session_duration",
    "smean": "payload_size_mean",
    "dmean": "payload_size_std",
    "label": "label",
    "attack_cat": "attack_cat",
}
CIC_RENAMES = {
    "Flow Duration": "session_duration",
    "Total Fwd Packets": "packet_rate",
    "Total Backward Packets": "burst_length",
    "Total Length of Fwd Packets": "byte_rate",
    "Fwd Packet Length Mean": "payload_size_mean",
    "Fwd Packet Length Std": "payload_size_std",
    "Flow IAT Mean": "inter_arrival_time",
    "Flow IAT Std": "response_time",
    "Destination Port": "port_diversity",
    "Label": "label",
}
RT_IOT_RENAMES = {
    "flow_duration": "session_duration",
    "fwd_pkts_tot": "packet_rate",
    "bwd_pkts_tot": "burst_length",
    "fwd_data_pkts_tot": "byte_rate",
    "flow_pkts_payload.mean": "payload_size_mean",
    "flow_pkts_payload.std": "payload_size_std",
    "flow_iat.mean": "inter_arrival_time",
    "flow_iat.std": "response_time",
}

KDD_CSV_LABELS = ["label", "class", "attack_type", "category"]

# Stand-in distributions for features a source lacks: (kind, first parameter, second parameter).
FEATURE_DEFAULTS = {
    "packet_rate": ("normal", 50.0, 10.0),
    "byte_rate": ("normal", 5000.0, 1000.0),
    "burst_length": ("normal", 10.0, 3.0),
    "inter_arrival_time": ("normal", 0.02, 0.005),
    "conn_frequency": ("normal", 5.0, 2.0),
    "unique_dst_ips": ("whole normal", 3.0, 1.0),
    "port_diversity": ("uniform", 0.1, 0.5),
    "protocol_distribution": ("integer", 0, 3),
    "response_time": ("normal", 0.1, 0.02),
    "session_duration": ("normal", 30.0, 10.0),
    "payload_size_mean": ("normal", 512.0, 100.0),
    "payload_size_std": ("normal", 50.0, 10.0),
    "time_of_day": ("integer", 0, 24),
    "day_of_week": ("integer", 0, 7),
}
