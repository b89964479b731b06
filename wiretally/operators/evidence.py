"""Ground-truth labels, gateway evidence and how predictions compare with them."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally import constants as C
from wiretally.functions import text
from wiretally.functions.binary import bind
from wiretally.functions.net import spi_text

FIELDS = C.TRACKED_FIELDS
VERIFIED = ("mode", "enc", "key_bits", "integ", "pfs", "dh_group")


def normalize_labels(df: DataFrame) -> DataFrame:
    """``ike_dh_group`` from the IKE proposal; ``dh_group`` from the ESP proposal only with PFS."""
    return df.withColumns({
        "ike_dh_group": text.dh_from_proposal("ike_proposal"),
        "dh_group": F.when(F.coalesce(F.col("pfs"), F.lit(False)), text.dh_from_proposal("esp_proposal"))})


def proposal_labels(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "cipher": text.proposal_cipher("esp_proposal"), "integ": text.proposal_integ("esp_proposal"),
        "dh_group": text.label_dh("esp_proposal"), "traffic": F.col("traffic_type")})


# --- gateway texts ----------------------------------------------------------

def _spi(value: Column) -> Column:
    """Canonical SPI text of up to eight hex digits with or without 0x, else null."""
    digits = F.regexp_extract(value, "^(?:0x)?([0-9a-fA-F]{1,8})$", 1)
    return F.when(digits != "", F.concat(F.lit("0x"), F.lpad(F.lower(digits), 8, "0")))


def _status_lines(state: Column) -> Column:
    """What each line of a status text says, read field by field, one struct a line.

    An SA's line is ``name: #number, field, field, ...``; an installed child's ends in its state, its mode
    and ``protocol:proposal``. A line of an SPI is ``in`` or ``out`` and eight hex digits. Each step is a
    ``transform`` of the one before, as nothing within a lambda is kept: a part named twice is worked out twice.
    """
    parts = F.transform(F.split(state, "\n"), lambda x: F.struct(
        x.alias("line"), F.split(F.trim(x), r"[\s,]+").alias("words"),
        F.transform(F.split(F.substring(x, F.length(F.substring_index(x, ":", 1)) + 2, F.length(x)), ","), lambda y: F.trim(y)).alias("fields")))
    placed = F.transform(parts, lambda x: F.struct(
        x["line"].alias("line"), x["words"].alias("words"), x["fields"].alias("fields"),
        (F.contains(x["line"], F.lit(":")) & F.startswith(F.get(x["fields"], F.lit(0)), F.lit("#"))).alias("numbered"),
        F.array_position(F.transform(x["fields"], lambda y: F.upper(y)), "INSTALLED").cast("int").alias("state")))
    ended = F.transform(placed, lambda x: F.struct(
        x["numbered"].alias("numbered"), x["state"].alias("state"), F.lower(F.get(x["fields"], x["state"])).alias("mode"),
        F.array_join(F.slice(x["fields"], x["state"] + 2, F.greatest(F.size(x["fields"]), F.lit(1))), ",").alias("last"),
        F.coalesce(x["numbered"] & (F.ltrim(x["line"]) == x["line"]), F.lit(False)).alias("outer"),
        F.when(F.get(x["words"], F.lit(0)).isin("in", "out") & (F.length(F.get(x["words"], F.lit(1))) == 8), _spi(F.get(x["words"], F.lit(1)))).alias("spi")))
    named = F.transform(ended, lambda x: F.struct(x.alias("x"), F.upper(F.substring_index(x["last"], ":", 1)).alias("protocol")))
    return F.transform(named, lambda n: F.struct(
        F.coalesce(n["x"]["numbered"] & (n["x"]["state"] > 0) & n["x"]["mode"].isin("tunnel", "transport") & n["protocol"].isin("ESP", "AH")
                   & F.contains(n["x"]["last"], F.lit(":")), F.lit(False)).alias("child"),
        n["x"]["mode"].alias("mode"), n["protocol"].alias("protocol"),
        F.substring(n["x"]["last"], F.length(n["protocol"]) + 2, F.length(n["x"]["last"])).alias("proposal"),
        n["x"]["outer"].alias("outer"), n["x"]["spi"].alias("spi")))


def parse_gateway_state(df: DataFrame, key="session_id", state="sa_state") -> DataFrame:
    """Installed child SAs in a gateway's status text, with the SPIs listed under each.

    A status text is one cell; its lines are folded in place, so nothing is
    shuffled and order never leaves the row. A child ends at the next child or
    at a line that begins another SA without indentation.
    """
    child = "struct<mode:string,protocol:string,proposal:string,spis:array<string>>"
    blank = F.struct(F.array().cast(f"array<{child}>").alias("done"), F.lit(None).cast(child).alias("open"))

    def step(acc, said):
        head, other, spi = said["child"], said["outer"], said["spi"]
        closed = F.when(acc["open"].isNotNull(), F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
        fresh = F.struct(said["mode"].alias("mode"), said["protocol"].alias("protocol"), said["proposal"].alias("proposal"),
                         F.array().cast("array<string>").alias("spis")).cast(child)
        grown = acc["open"].withField("spis", F.array_append(acc["open"]["spis"], spi))
        live = acc["open"].isNotNull()
        return F.struct(
            F.when(head, closed).when(live & spi.isNull() & other, closed).otherwise(acc["done"]).alias("done"),
            F.when(head, fresh).when(live & spi.isNotNull(), grown)
            .when(live & other, F.lit(None).cast(child)).otherwise(acc["open"]).alias("open"))

    found = F.aggregate("_lines", blank, step,
                        lambda acc: F.when(acc["open"].isNotNull(), F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))
    rows = (bind(bind(df, _lines=_status_lines(F.col(state))), _found=found).select(key, F.posexplode("_found").alias("child_no", "_c"))
            .select(key, "child_no", "_c.*").filter(F.size("spis") > 0))
    return rows.select(key, "child_no", "mode", text.gateway_enc("proposal", "protocol").alias("enc"),
                       text.gateway_bits("proposal", "protocol").alias("key_bits"),
                       text.gateway_integ("proposal").alias("integ"), "spis")


def parse_gateway_raw(df: DataFrame, key="session_id", raw="raw") -> DataFrame:
    """Installed child SAs in nested ``name {key=value ...}`` text.

    A child SA is an innermost block of its section: the blocks without inner
    braces that name a state and an SPI.
    """
    head = F.get(F.split(raw, "list-sas reply"), F.lit(0))
    blocks = F.regexp_extract_all(head, F.lit(r"\{([^{}]*\bspi-(?:in|out)=[^{}]*)\}"), F.lit(1))
    kv = F.str_to_map(F.regexp_replace(F.trim("block"), r"\s+", " "), F.lit(" "), F.lit("="))
    rows = df.select(key, F.posexplode(blocks).alias("child_no", "block")).withColumn("kv", kv)
    get = lambda name: F.try_element_at("kv", F.lit(name))
    protocol = F.upper(F.coalesce(get("protocol"), F.lit("ESP")))
    alg = F.coalesce(get("encr-alg"), F.lit(""))
    proposal = F.when(get("encr-keysize").isNotNull(), F.concat(alg, F.lit("-"), get("encr-keysize"))).otherwise(alg)
    spis = F.array_compact(F.array(_spi(get("spi-in")), _spi(get("spi-out"))))
    integ = F.when(get("integ-alg").isNotNull(), text.gateway_integ(get("integ-alg"))).otherwise(text.gateway_integ(proposal))
    return (rows.filter(get("state") == "INSTALLED").filter(F.size(spis) > 0)
            .select(key, "child_no", get("name").alias("name"), F.nullif(F.lower(get("mode")), F.lit("")).alias("mode"),
                    text.gateway_enc(proposal, protocol).alias("enc"), text.gateway_bits(proposal, protocol).alias("key_bits"),
                    integ.alias("integ"), text.dh_from_proposal(get("dh-group")).alias("dh_group"), spis.alias("spis")))


def union_children(after: DataFrame, before: DataFrame) -> DataFrame:
    return (after.withColumn("snapshot", F.lit("after"))
            .unionByName(before.withColumn("snapshot", F.lit("before")), allowMissingColumns=True))


def new_rekey_child(before: DataFrame, after: DataFrame, key="session_id") -> DataFrame:
    """The child with an SPI the earlier snapshot lacks, when there is exactly one per session."""
    old = before.select(key, F.explode("spis").alias("_spi")).distinct()
    child = after.withColumn("_id", F.struct(*[c for c in after.columns if c != key]))
    fresh = child.select(key, "_id", F.explode("spis").alias("_spi")).join(old, [key, "_spi"], "left_anti").select(key, "_id").distinct()
    alone = fresh.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_id")).filter("_n = 1")
    return alone.select(key, "_id.*")


def common_spis(a: DataFrame, b: DataFrame, key="session_id") -> DataFrame:
    left = a.select(key, F.explode("spis").alias("spi")).distinct()
    return left.join(b.select(key, F.explode("spis").alias("spi")).distinct(), [key, "spi"], "left_semi")


def match_gateway(children: DataFrame, sas: DataFrame, key="session_id") -> DataFrame:
    """Children with at least one SPI among the observed SAs; ``sas`` has (key, spi text)."""
    seen = sas.select(key, F.lower("spi").alias("_spi")).distinct()
    ids = [c for c in children.columns if c not in (key, "spis")]
    hits = (children.select(key, *ids, "spis", F.explode("spis").alias("_spi"))
            .join(seen, [key, "_spi"], "left_semi").drop("_spi"))
    return hits.distinct()


def _facts(fields, source, key="session_id"):
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return [key, F.lit(source).alias("source"), F.inline(pairs)]


def _agreed(children: DataFrame, sas: DataFrame, source: str, key: str) -> DataFrame:
    """The value of each field on which all children among the observed SAs agree."""
    plain = ("mode", "enc", "key_bits", "integ")
    return (match_gateway(children, sas, key).select(*_facts(plain, source, key)).filter("value IS NOT NULL")
            .groupBy(key, "source", "field").agg(F.min("value").alias("value"), F.max("value").alias("_hi"))
            .filter(F.col("value") == F.col("_hi")).drop("_hi"))


def verify_sessions(sessions: DataFrame, children: DataFrame, sas: DataFrame, labels: DataFrame,
                    rekeyed: DataFrame = None, source="gateway_vici", key="session_id", legacy: DataFrame = None) -> DataFrame:
    """Gateway-verified value per session and field, where all matched children agree.

    Only completed sessions are verified. ``rekeyed`` holds the observed rekey
    child of a session (spis, dh_group); with it PFS and the child DH group are
    known. ``labels`` gives the configured values to compare with. ``legacy``
    has one row (session, ``sa_state``) for each session that was stored without
    gateway evidence: its children are read from that status text, and its PFS
    and DH group are shown as configured, which is no comparison.
    """
    done = sessions.filter(F.col("status") == "completed").select(key)
    known = _agreed(children.join(done, key, "left_semi"), sas, source, key)
    if legacy is not None:
        stated = parse_gateway_state(legacy.join(done, key, "left_semi"), key)
        known = known.unionByName(_agreed(stated, sas, "legacy_sa_state", key))
    if rekeyed is not None:
        child = (match_gateway(rekeyed.join(done, key, "left_semi"), sas, key)
                 .withColumn("pfs", F.col("dh_group").isNotNull()))
        known = known.unionByName(child.select(*_facts(("pfs", "dh_group"), "gateway_vici_rekey", key)).filter("value IS NOT NULL"))
    expected = labels.select(*_facts(VERIFIED, "label", key)).drop("source").withColumnRenamed("value", "expected")
    out = (sessions.select(key).join(expected, key).join(known, [key, "field"], "left")
           .withColumn("source", F.coalesce("source", F.lit("unavailable"))))
    match = text.comparable("field", "value").eqNullSafe(text.comparable("field", "expected"))
    out = out.withColumn("match", F.when(F.col("expected").isNotNull() & F.col("value").isNotNull(), match))
    if legacy is None:
        return out
    out = out.join(legacy.select(key).distinct().withColumn("_legacy", F.lit(True)), key, "left")
    shown = F.col("_legacy") & F.col("field").isin("pfs", "dh_group") & F.col("value").isNull() & F.col("expected").isNotNull()
    return out.withColumns({"value": F.when(shown, F.col("expected")).otherwise(F.col("value")),
                            "source": F.when(shown, "configured").otherwise(F.col("source"))}).drop("_legacy")


def verification_totals(verified: DataFrame, key="session_id") -> DataFrame:
    return verified.groupBy(key).agg(
        F.count("expected").alias("eligible"), F.count("match").alias("compared"), F.count_if("match").alias("matched"))


# --- predictions against labels ---------------------------------------------

def best_evidence_sa(sas: DataFrame, key="session_id", fields=FIELDS, order="spi") -> DataFrame:
    """The SA of each session with most known fields (first by ``order`` on a tie)."""
    present = [f for f in (*fields, "traffic_top") if f in sas.columns]
    known = reduce(lambda a, b: a + b, [F.col(f).isNotNull().cast("int") for f in present])
    rest = [c for c in sas.columns if c != key]
    row = F.struct(*rest)
    return sas.groupBy(key).agg(F.max_by(row, F.struct(known, -F.col(order))).alias("_b")).select(key, "_b.*")


def field_matches(best: DataFrame, labels: DataFrame, key="session_id", fields=FIELDS) -> DataFrame:
    """Long form: one row per session and labelled field with the outcome.

    ``match`` is null where the prediction is missing or ambiguous.
    """
    used = [f for f in fields if f in labels.columns and f in best.columns]
    actual = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("actual")) for f in used],
                     F.struct(F.lit("traffic").alias("field"), F.col("traffic_top").cast("string").alias("actual")))
    expected = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("expected")) for f in used],
                       F.struct(F.lit("traffic").alias("field"), F.col("traffic_type").cast("string").alias("expected")))
    both = (labels.select(key, F.inline(expected)).filter("expected IS NOT NULL")
            .join(best.select(key, F.inline(actual)), [key, "field"]))
    said = text.comparable("field", "actual")
    return both.withColumn("match", F.when(said.isNotNull(), text.comparable("field", "expected").eqNullSafe(said)))


def session_accuracy(best: DataFrame, labels: DataFrame, key="session_id", fields=FIELDS) -> DataFrame:
    out = field_matches(best, labels, key, fields).groupBy(key).agg(
        F.count(F.lit(1)).alias("eligible"), F.count("match").alias("compared"), F.count_if("match").alias("matched"),
        F.count_if(F.col("match").isNull()).alias("missing"))
    return out.withColumn("match_rate", F.col("matched") / F.col("eligible"))


def lab_accuracy(matches: DataFrame) -> DataFrame:
    """Hits and comparisons per field, and over all fields (field null)."""
    return (matches.groupingSets([["field"], []], "field").agg(
        F.count_if("match").alias("hit"), F.count("match").alias("seen"), F.count(F.lit(1)).alias("eligible")))


def sanity_report(sas: DataFrame, labels: DataFrame, key="session_id", fields=FIELDS) -> DataFrame:
    """Case-insensitive equality of every known prediction with its label, per field and in total."""
    used = [f for f in fields if f in sas.columns and f in labels.columns]
    said = sas.select(*_facts(used, "sa", key)).drop("source").filter("value IS NOT NULL")
    truth = labels.select(*_facts(used, "label", key)).drop("source").withColumnRenamed("value", "truth")
    both = said.join(truth, [key, "field"])
    hit = F.lower("value") == F.lower(F.coalesce("truth", F.lit("none")))
    return both.groupingSets([["field"], []], "field").agg(F.count_if(hit).alias("hit"), F.count(F.lit(1)).alias("seen"))


def session_gate(sessions: DataFrame, minimum=C.SESSION_MIN_PROTECTED) -> DataFrame:
    """Keeps a reason text for sessions with too little evidence; null means accepted.

    Sessions with an AH proposal count AH packets when the column exists.
    """
    protected = F.col("esp_packets")
    if "ah_packets" in sessions.columns:
        protected = F.when(F.col("esp_proposal").startswith("ah-"), F.col("ah_packets")).otherwise(protected)
    bad = (protected < minimum) | (F.col("ike_packets") < 1)
    reason = F.concat(F.col("esp_packets").cast("string"), F.lit(" ESP, "), F.col("ike_packets").cast("string"), F.lit(" IKE"))
    return sessions.withColumn("reason", F.when(bad, reason))


def session_evidence_counts(packets: DataFrame, key="capture_id") -> DataFrame:
    from wiretally.functions.net import proto_class
    kind = packets.select(key, proto_class().alias("_k"))
    return kind.groupBy(key).agg(F.count_if(F.col("_k").isin("esp", "esp_in_udp")).alias("esp_packets"),
                                 F.count_if(F.col("_k") == "ah").alias("ah_packets"),
                                 F.count_if(F.col("_k") == "ike").alias("ike_packets"))


def dataset_summary(gated: DataFrame, sa_rows: DataFrame, windows: DataFrame) -> DataFrame:
    parts = [gated.filter("reason IS NULL").agg(F.lit("sessions").alias("item"), F.count(F.lit(1)).alias("rows")),
             gated.filter("reason IS NOT NULL").agg(F.lit("rejected").alias("item"), F.count(F.lit(1)).alias("rows")),
             sa_rows.agg(F.lit("sa_rows").alias("item"), F.count(F.lit(1)).alias("rows")),
             windows.agg(F.lit("windows").alias("item"), F.count(F.lit(1)).alias("rows"))]
    return reduce(DataFrame.unionByName, parts)


def session_listing(sessions: DataFrame, analyses: DataFrame, rejected: DataFrame) -> DataFrame:
    """Sessions with their latest analysis and, if newer than the manifest, the rejection reason.

    The latest analysis is a max_by aggregate, which combines before the shuffle.
    """
    latest = analyses.groupBy("session_id").agg(
        F.max(F.struct("created", "analysis_id", "status")).alias("_a")).select(
        "session_id", F.col("_a.analysis_id").alias("analysis_id"), F.col("_a.status").alias("status"))
    reject = rejected.groupBy("session_id").agg(F.max_by("reason", "rejected_at").alias("_reason"), F.max("rejected_at").alias("_at"))
    out = sessions.join(latest, "session_id", "left").join(reject, "session_id", "left")
    return out.withColumn("capture_issue", F.when(F.col("manifest_at") <= F.col("_at"), F.col("_reason"))).drop("_reason", "_at")


def missing_sessions(profiles: DataFrame, traffic=C.TRAFFIC_CLASSES, reps: int = 5, valid: DataFrame = None) -> DataFrame:
    """Planned sessions (profile x its traffic types x repetition) that have no valid session.

    The plan is expanded row by row from each profile, so its size is the plan's.
    """
    kinds = F.array(*[F.lit(t) for t in traffic])
    if "traffic" in profiles.columns:
        kinds = F.array_intersect(kinds, F.col("traffic"))
    plan = (profiles.select("profile", F.explode(kinds).alias("traffic_type"))
            .withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(reps))))
            .withColumn("session_id", F.format_string("%s-%s-%04d", "profile", "traffic_type", "repetition")))
    return plan if valid is None else plan.join(valid.select("session_id"), "session_id", "left_anti")
