"""Domain constants shared by the operators."""

# The protocol numbers, tables, thresholds and wordings below must
# be exactly these for results to agree with the published behaviour.

FLOW_WINDOW_US = 5_000_000
BURST_GAP_US = 20_000
HEAD_PACKETS = 32

CBC_IV_LEN = 16
GCM_IV_LEN = 8
GCM_PAD_LEN = 4
CIPHER_BLOCK = 16
ICV_CANDIDATES = (12, 16, 24, 32)
STRUCTURE_FLOOR = 0.95
CONFORMAL_ALPHA = 0.1
KEY_SIZE_PRIOR = 0.7
PFS_ON_CONFIDENCE = 0.92
PFS_OFF_CONFIDENCE = 0.08
REPLAY_JUMP = 0x7FFFFFFF
SEQ_MAX_32 = 0xFFFFFFFF
UPDOWN_INFINITE = 1000.0

SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERITY_WEIGHTS = {"info": 0.0, "low": 1.0, "medium": 3.0, "high": 6.0, "critical": 10.0}
RISK_MAX = 25.0
GRADE_FLOORS = (("A", 90), ("B", 80), ("C", 70), ("D", 55))

IKEV2_EXCHANGES = {34: "IKE_SA_INIT", 35: "IKE_AUTH", 36: "CREATE_CHILD_SA", 37: "INFORMATIONAL"}
IKEV1_EXCHANGES = {2: "Main Mode", 4: "Aggressive Mode", 32: "Quick Mode"}
ENCR_IDS = {3: "3DES", 12: "AES-CBC", 20: "AES-GCM-16", 28: "ChaCha20-Poly1305"}
INTEG_IDS = {2: "HMAC-SHA1-96", 12: "HMAC-SHA2-256-128", 13: "HMAC-SHA2-384-192", 14: "HMAC-SHA2-512-256"}
DH_IDS = {2: "MODP-1024", 5: "MODP-1536", 14: "MODP-2048", 15: "MODP-3072", 16: "MODP-4096",
          19: "ECP-256", 20: "ECP-384", 21: "ECP-521", 31: "Curve25519"}
KE_SIZES = {2: 128, 5: 192, 14: 256, 15: 384, 16: 512, 19: 64, 20: 96, 21: 132, 31: 32}
NAT_NOTIFY = (16388, 16389, 16390, 16391)
PAYLOAD_SA, PAYLOAD_KE, PAYLOAD_NOTIFY, PAYLOAD_VENDOR = 33, 34, 41, 43
ATTR_KEY_LENGTH = 14

# DH names as they are written in proposal texts.
PROPOSAL_DH = {"modp1024": 2, "modp1536": 5, "modp2048": 14, "modp3072": 15, "modp4096": 16,
               "ecp256": 19, "ecp384": 20, "ecp521": 21, "curve25519": 31}
# The training-label table leaves out modp1536.
LABEL_DH = {k: v for k, v in PROPOSAL_DH.items() if k != "modp1536"}

# Vocabulary used by rules for values that inference or text labels abbreviate.
RULE_ENC = {"GCM": "AES-GCM-16", "CBC": "AES-CBC"}
RULE_INTEG = {"sha1": "HMAC-SHA1-96", "sha256": "HMAC-SHA2-256-128",
              "sha384": "HMAC-SHA2-384-192", "sha512": "HMAC-SHA2-512-256"}

TRAFFIC_CLASSES = ("icmp", "web", "email", "voip", "video", "messaging", "bulk")
THREAT_CLASSES = ("ddos", "beaconing", "dga", "dns_tunneling", "encrypted_malware",
                  "port_scan", "data_exfiltration")
INTERNAL_CIDRS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
COOLDOWN_US = 30_000_000
FLOW_IDLE_US = 60_000_000
HEURISTIC_VERSION = "heuristic-v1"

TRACKED_FIELDS = ("ike_version", "mode", "enc", "key_bits", "integ", "dh_group", "pfs", "nat_t")
SA_FEATURES = ("packet_count", "min_len", "p10_len", "p50_len", "p90_len", "mean_len", "std_len",
               "cbc_consistency", "icv_len", "natt", "ip_v6", "rekey_count", "rekey_len_min",
               "rekey_len_mean")
TRAFFIC_FEATURES = ("n_packets", "len_mean", "len_std", "len_p10", "len_p50", "len_p90", "iat_mean",
                    "iat_std", "bursts", "updown_ratio", "packets_per_s")
THREAT_FEATURES = {
    "beaconing": ("interval_mean", "interval_cv", "observations"),
    "dga": ("label_len", "entropy", "bigram_diversity", "digit_ratio", "name_len"),
    "dns_tunneling": ("name_len", "entropy", "queries_30s", "qtype"),
    "encrypted_malware": ("interval_mean", "interval_cv", "observations", "tls", "quic", "tls_version",
                          "quic_version", "handshake_len", "cipher_count", "sni_length",
                          "extension_count"),
}
MIN_MACRO_F1 = {"mode": 0.90, "cipher": 0.95, "integ": 0.95, "pfs": 0.90, "dh_group": 0.80, "traffic": 0.80}
HEAD_GATES = {"ece": 0.08, "coverage": 0.85}
THREAT_GATES = {"f1": 0.7, "pr_auc": 0.75, "ece": 0.1}
THREAT_THRESHOLD = 0.75

SESSION_MIN_PROTECTED = 20
REPORT_COLUMNS = ("rule_id", "title", "category", "severity", "likelihood", "confidence", "refs", "fix")

REMEDIATION = {
    "CRYPTO-001": "# Replace weak DH with an ECC group (RFC 8247 §2.4)\n"
                  "connections.<conn>\n  proposals = aes256gcm16-prfsha384-ecp384",
    "PFS-001": "# Enable PFS: add a DH group to esp_proposals (NIST SP 800-77r1 §4.2)\n"
               "connections.<conn>.children.<child>\n  esp_proposals = aes256gcm16-ecp384",
    "LIFE-001": "# Shorten CHILD_SA lifetime (rekey at most every 8 h)\n"
                "connections.<conn>.children.<child>\n  rekey_time = 8h",
    "LIFE-002": "# Shorten IKE SA lifetime (rekey at most every 24 h)\n"
                "connections.<conn>\n  rekey_time = 24h",
    "REPLAY-001": "# Enable replay protection (window > 0)\n"
                  "connections.<conn>.children.<child>\n  replay_window = 64",
    "META-001": "# Hide inner endpoints: prefer tunnel mode over transport\n"
                "connections.<conn>.children.<child>\n  mode = tunnel",
    "META-002": "# Avoid IKEv1 Aggressive Mode identity leak: use IKEv2 (or Main Mode)\n"
                "connections.<conn>\n  version = 2",
    "META-003": "# Add TFC padding so packet sizes stop revealing the application\n"
                "connections.<conn>.children.<child>\n  tfc_padding = mtu",
}
REMEDIATION_DEFAULT = "# no snippet for this rule yet"
