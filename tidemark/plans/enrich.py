"""Filing and regulatory-record enrichment: taxonomies, states, year-over-year figures and source choice."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.numeric import growth, surprise_pct, surprise_state
from tidemark.functions.text import accession_dir, filing_available, item_numbers, local_day, norm_company, pad_cik

# Current-report items as item -> (category, subtype).
ITEMS = {
    "1.01": ("general_corporate", "material_agreement"), "1.02": ("general_corporate", "material_agreement"), "1.03": ("general_corporate", "bankruptcy_or_restructuring"),
    "1.04": ("general_corporate", "regulatory_disclosure"), "1.05": ("general_corporate", "cybersecurity_incident"), "2.01": ("general_corporate", "acquisition_or_divestiture"),
    "2.02": ("earnings", "results"), "2.03": ("capital_markets", "debt_or_financial_obligation"), "2.04": ("capital_markets", "debt_or_financial_obligation"),
    "2.05": ("general_corporate", "restructuring"), "2.06": ("general_corporate", "impairment"), "3.01": ("general_corporate", "listing_status"),
    "3.02": ("capital_markets", "equity_issuance"), "3.03": ("capital_markets", "security_holder_rights"), "4.01": ("general_corporate", "accountant_change"),
    "4.02": ("general_corporate", "financial_restatement"), "5.01": ("general_corporate", "control_change"), "5.02": ("general_corporate", "officer_or_director_change"),
    "5.03": ("general_corporate", "governance_amendment"), "5.04": ("general_corporate", "benefit_plan_suspension"), "5.05": ("general_corporate", "governance_amendment"),
    "5.06": ("general_corporate", "shell_company_status"), "5.07": ("general_corporate", "shareholder_vote"), "5.08": ("general_corporate", "shareholder_vote"),
    "6.01": ("capital_markets", "asset_backed_securities"), "6.02": ("capital_markets", "asset_backed_securities"), "6.03": ("capital_markets", "asset_backed_securities"),
    "6.04": ("capital_markets", "asset_backed_securities"), "6.05": ("capital_markets", "asset_backed_securities"), "7.01": ("general_corporate", "reg_fd_disclosure"),
    "8.01": ("general_corporate", "other"), "9.01": ("administrative", "exhibits_only"),
}
# Trial status -> category; phases a trial may carry.
TRIAL_STATUS = {
    "COMPLETED": "completed", "TERMINATED": "discontinued", "WITHDRAWN": "discontinued", "SUSPENDED": "discontinued", "RECRUITING": "ongoing", "NOT_YET_RECRUITING": "ongoing",
    "ACTIVE_NOT_RECRUITING": "ongoing", "ENROLLING_BY_INVITATION": "ongoing", "APPROVED_FOR_MARKETING": "regulatory_milestone", "UNKNOWN": "administrative", "WITHHELD": "administrative",
    "NO_LONGER_AVAILABLE": "administrative", "AVAILABLE": "administrative", "TEMPORARILY_NOT_AVAILABLE": "administrative",
}
# What a status leaves open.
TRIAL_NOTES = {
    "COMPLETED": "Finished; whether the primary endpoint was met needs the trial's own separate results data, not this status alone.",
    "TERMINATED": "Stopped early after already starting.",
    "WITHDRAWN": "Stopped before enrolling any participant.",
    "SUSPENDED": "Halted; not necessarily permanently.",
    "APPROVED_FOR_MARKETING": "The intervention itself reached market.",
    "UNKNOWN": "Status not verified within ClinicalTrials.gov's own required window -- a reporting gap, not a scientific or regulatory outcome.",
}
TRIAL_PHASES = ("NA", "EARLY_PHASE1", "PHASE1", "PHASE2", "PHASE3", "PHASE4")
# Venue and tape that carry the opening print of a listing.
LISTED_ON = {"NYSE": ("N", "A"), "NASDAQ": ("Q", "C")}
# Drug application prefixes (the longer first), submission status, type and class.
APPLICATION_PREFIXES = (("ANDA", "abbreviated_new_drug_application"), ("NDA", "new_drug_application"), ("BLA", "biologics_license_application"))
SUBMISSION_STATUS = {"AP": "approved", "TA": "tentative_approval"}
SUBMISSION_TYPE = {"ORIG": "original_application", "SUPPL": "supplement"}
SUBMISSION_CLASS = {
    "LABELING": "labeling", "MANUF (CMC)": "manufacturing_cmc", "EFFICACY": "efficacy", "TYPE 1": "new_molecular_entity", "TYPE 2": "new_active_ingredient", "TYPE 3": "new_dosage_form",
    "TYPE 4": "new_combination", "TYPE 5": "new_formulation_or_new_manufacturer", "TYPE 6": "new_indication_no_longer_used", "TYPE 7": "already_marketed_without_approved_nda",
    "TYPE 8": "partial_rx_to_otc_switch", "TYPE 9": "new_indication_distinct_nda_consolidated", "TYPE 9- BLA": "new_indication_distinct_bla_consolidated",
    "TYPE 10": "new_indication_distinct_nda_not_consolidated", "REMS": "rems", "N/A": "not_applicable", "BIOEQUIV": "bioequivalence", "S": "supplement", "MEDGAS": "medical_gas",
    "TYPE 1/4": "new_molecular_entity_and_new_combination", "TYPE 3/4": "new_dosage_form_and_new_combination", "TYPE 2/3": "new_active_ingredient_and_new_dosage_form",
    "TYPE 2/4": "new_active_ingredient_and_new_combination", "TYPE 4/5": "new_combination_and_new_formulation_or_manufacturer",
}
# Device decision codes of the two pathways -> category; device class text.
DECISION_510K = {c: "cleared" for c in ("SESE", "SN", "SESK", "SESU", "SEKD", "ST", "SESD", "SESP", "PT", "SI")}
DECISION_PMA = {"APPR": "approved", "OK30": "approved", "APRL": "post_approval_action", "APWD": "withdrawn", "APCV": "post_approval_action", "APCB": "approved"}
DEVICE_CLASS = {
    "1": "Class I (low to moderate risk): general controls", "2": "Class II (moderate to high risk): general controls and special controls",
    "3": "Class III (high risk): general controls and Premarket Approval (PMA)", "U": "Unclassified", "N": "Not classified", "F": "HDE",
}


def lookup(col, table: dict, default=None) -> Column:
    """A small closed vocabulary as a map literal: no join, no shuffle; unknown values take `default`."""
    c = F.col(col) if isinstance(col, str) else col
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    found = F.try_element_at(pairs, c)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def screen_filings(df: DataFrame, first, last, item=None) -> DataFrame:
    """V14. Filings of a date range, optionally only those carrying an item."""
    out = df.filter(F.col("filing_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return out if item is None else out.filter(F.array_contains("items", item))


def filing_state(item="2.02") -> Column:
    """V15. State of a current report as a candidate for one item; needs form and items_text. Other forms have none."""
    found = F.regexp_extract_all(F.coalesce("items_text", F.lit("")), F.lit(r"\b(\d+\.\d{2})\b"), F.lit(1))
    return (F.when(F.col("form") == "8-K/A", "AMENDMENT_REVIEW").when(F.col("form") != "8-K", None).when(F.col("items_text").isNull(), "ITEMS_UNAVAILABLE")
            .when(F.array_contains(found, item), "EARNINGS_CANDIDATE").otherwise("NOT_ITEM_" + item.replace(".", "_")))


ARCHIVE_ROOT = "https://www.sec.gov/Archives/edgar/data"


def filing_urls(df: DataFrame, root=ARCHIVE_ROOT) -> DataFrame:
    """V16. Index and document url of a filing; a document path with an unsafe part is never built and falls back to the index."""
    base = F.concat(F.lit(root + "/"), F.col("cik_no").cast("bigint").cast("string"), F.lit("/"), accession_dir("accession"), F.lit("/"))
    index = F.concat(base, F.col("accession"), F.lit("-index.html"))
    parts = F.split("primary_document", "/")
    safe = F.coalesce(F.forall(parts, lambda x: F.rlike(x, F.lit(r"^[A-Za-z0-9_.-]+$")) & ~x.isin(".", "..")), F.lit(False))
    return (df.withColumn("index_url", index).withColumn("primary_url", F.when(safe, F.concat(base, "primary_document")))
            .withColumn("document_state", F.when(safe, "PARSED_SAFE").otherwise("REVIEW_REQUIRED")).withColumn("url", F.coalesce("primary_url", "index_url")))


def current_reports(df: DataFrame, first, last, required) -> DataFrame:
    """V17. Current reports of a date range whose items overlap a required set, with well-shaped accessions."""
    d = df.withColumn("items", item_numbers("items_text"))
    return d.filter((F.col("form") == "8-K") & F.col("filing_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
                    & F.arrays_overlap("items", F.array(*[F.lit(x) for x in required])) & accession_dir("accession").isNotNull())


# Words of a security name that need a type review.
REVIEW_PATTERN = r"(?i)\b(warrants?|preferred|units?|depositary|depositary shares|rights)\b"


def listing_state() -> Column:
    """V18. Eligibility of a listing row: test_issue, etf, exchange, security_name; the first that applies."""
    return (F.when(F.col("test_issue") == "Y", "EXCLUDED_TEST").when(F.col("etf") == "Y", "EXCLUDED_ETF").when(F.col("exchange") == "OTHER", "EXCLUDED_EXCHANGE")
            .when(F.rlike(F.col("security_name"), F.lit(REVIEW_PATTERN)), "EXCLUDED_OR_REQUIRES_TYPE_REVIEW").otherwise("REQUIRES_IDENTITY_REVIEW"))


def valid_return(col) -> Column:
    c = F.col(col)
    return c.isNotNull() & ~F.isnan(c) & (c > -1) & (c < float("inf"))


def exclusion_reason(opening="gap", close="close_return") -> Column:
    """V19. Why a paired outcome is undefined: opening, then zero gap, then close."""
    return (F.when(~valid_return(opening), "opening_unavailable").when(F.col(opening) == 0, "zero_opening_gap").when(~valid_return(close), "close_unavailable"))


def classify_filings(df: DataFrame) -> DataFrame:
    """L3. One row per item of a filing with its category and subtype; an unknown item is unclassified."""
    cats, subs = {k: v[0] for k, v in ITEMS.items()}, {k: v[1] for k, v in ITEMS.items()}
    return (df.withColumn("item", F.explode("items")).withColumn("category", lookup("item", cats, "unclassified")).withColumn("subtype", lookup("item", subs)))


def classify_trials(df: DataFrame) -> DataFrame:
    """L4. From nested trial JSON in `record`: identity, title, status category and note, phases (unknown ones listed), conditions, sponsor.

    `refusal` says why a record is not to be used: no trial id, or a phase outside the vocabulary.
    """
    shape = ("identificationModule struct<nctId:string,briefTitle:string>, statusModule struct<overallStatus:string>, designModule struct<phases:array<string>>, "
             "conditionsModule struct<conditions:array<string>>, sponsorCollaboratorsModule struct<leadSponsor:struct<name:string>>")
    d = df.withColumn("_p", F.from_json("record", shape))
    phases = F.coalesce(F.col("_p.designModule.phases"), F.array().cast("array<string>"))
    unknown = F.array_except(phases, F.array(*[F.lit(x) for x in TRIAL_PHASES]))
    refusal = F.when(F.coalesce("_p.identificationModule.nctId", F.lit("")) == "", "MISSING_TRIAL_ID").when(F.size(unknown) > 0, "UNKNOWN_PHASE")
    return d.select(*df.columns, F.col("_p.identificationModule.nctId").alias("nct_id"), F.col("_p.identificationModule.briefTitle").alias("brief_title"), F.col("_p.statusModule.overallStatus").alias("status"),
                    lookup(F.col("_p.statusModule.overallStatus"), TRIAL_STATUS, "unclassified").alias("status_category"),
                    lookup(F.col("_p.statusModule.overallStatus"), TRIAL_NOTES).alias("status_note"), phases.alias("phases"),
                    unknown.alias("unknown_phases"), refusal.alias("refusal"),
                    F.coalesce(F.col("_p.conditionsModule.conditions"), F.array().cast("array<string>")).alias("conditions"),
                    F.col("_p.sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"))


def classify_applications(df: DataFrame) -> DataFrame:
    """L5. From drug application JSON in `record`: pathway by prefix and every submission's status, type and class."""
    shape = ("application_number string, sponsor_name string, submissions array<struct<submission_number:string,submission_type:string,submission_class_code:string,"
             "submission_status:string,submission_status_date:string>>")
    d = df.withColumn("_a", F.from_json("record", shape)).select(*df.columns, "_a.application_number", "_a.sponsor_name", F.explode_outer("_a.submissions").alias("_s"))
    pathway = F.lit("unclassified")
    for prefix, name in reversed(APPLICATION_PREFIXES):
        pathway = F.when(F.startswith("application_number", F.lit(prefix)), name).otherwise(pathway)
    return (d.withColumn("pathway", pathway).withColumn("submission_type_category", lookup(F.col("_s.submission_type"), SUBMISSION_TYPE, "unclassified"))
            .withColumn("submission_class_category", lookup(F.col("_s.submission_class_code"), SUBMISSION_CLASS, "unclassified"))
            .withColumn("submission_status_category", lookup(F.col("_s.submission_status"), SUBMISSION_STATUS, "unclassified")).select("*", "_s.submission_number").drop("_s"))


def classify_devices(df: DataFrame) -> DataFrame:
    """L6. Clearance and approval records of the two pathways in one table; a supplement makes the approval id unique."""
    cleared = F.col("pathway") == "510k"
    category = F.when(cleared, lookup("decision_code", DECISION_510K, "unclassified")).otherwise(lookup("decision_code", DECISION_PMA, "unclassified"))
    has = F.col("supplement_number").isNotNull() & (F.col("supplement_number") != "")
    sid = F.when(cleared, F.col("number")).otherwise(F.when(has, F.concat_ws("/", "number", "supplement_number")).otherwise(F.col("number")))
    return df.withColumn("submission_id", sid).withColumn("decision_category", category).withColumn("device_class_text", lookup("device_class", DEVICE_CLASS))


def quarterly(low=80, high=100, inclusive=False) -> Column:
    days = F.datediff("end", "start") + (1 if inclusive else 0)
    return days.between(low, high)


def first_disclosed(facts: DataFrame, keys=("entity", "tag", "end")) -> DataFrame:
    """W19. Of all facts of a period the one filed first (then by accession)."""
    rest = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("filed", "accn")).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def yoy_surprise(asks: DataFrame, facts: DataFrame, tolerance=25) -> DataFrame:
    """L7. For each (entity, tag, end, known_by): first disclosed value, the comparable quarter a year earlier and the surprise, from facts filed by then.

    The prior quarter ends within `tolerance` days of a year before; facts are met on (entity, tag, end day), each fact standing on the few days it may answer for,
    so no entity's facts are ever paired with all its others.
    """
    q = facts.filter(quarterly())
    body = F.struct("filed", "accn", "val", F.col("end").alias("_end"))
    now = (asks.join(q, ["entity", "tag", "end"], "left").filter("filed is null or filed <= known_by")
           .groupBy("entity", "tag", "end", "known_by").agg(F.min(F.when(F.col("filed").isNotNull(), body)).alias("cur")))
    asked = asks.join(now, ["entity", "tag", "end", "known_by"], "left")
    want = asked.select("entity", "tag", "end", "known_by", F.explode(F.sequence(F.date_sub("end", 365 + tolerance), F.date_sub("end", 365 - tolerance))).alias("_day"))
    past = q.select("entity", "tag", F.col("end").alias("_day"), "filed", "accn", "val")
    rank = F.struct(F.abs(F.datediff("_day", F.date_sub("end", 365))).alias("gap"), "filed", "accn", "val")
    prior = want.join(past, ["entity", "tag", "_day"]).filter("filed <= known_by").groupBy("entity", "tag", "end", "known_by").agg(F.min(rank).alias("pri"))
    out = asked.join(prior, ["entity", "tag", "end", "known_by"], "left")
    pri = F.when(F.col("cur").isNotNull(), F.col("pri.val"))
    return (out.withColumn("current_value", F.col("cur.val")).withColumn("prior_value", pri)
            .withColumn("state", surprise_state("current_value", "prior_value")).withColumn("surprise_pct", F.when(F.col("state") == "COMPUTED", surprise_pct("current_value", "prior_value"))).drop("cur", "pri"))


def surprise_for_filing(facts: DataFrame) -> DataFrame:
    """L8. Each filing asks about its own newest quarter, known by its own filing date."""
    newest = facts.filter(quarterly()).groupBy("entity", "tag", "accn").agg(F.max_by(F.struct("end", "filed"), F.struct("end")).alias("_n"))
    asks = newest.select("entity", "tag", "accn", F.col("_n.end").alias("end"), F.col("_n.filed").alias("known_by"))
    answers = yoy_surprise(asks.select("entity", "tag", "end", "known_by").distinct(), facts)
    return asks.join(answers, ["entity", "tag", "end", "known_by"])


def catalyst_features(items: DataFrame, surprise: DataFrame) -> DataFrame:
    """L9. Filings with exactly one earnings item: their other items and the surprise state and direction, if one was computed."""
    earn = F.col("category") == "earnings"
    g = items.groupBy("filing_id").agg(F.count_if(earn).alias("_e"), F.array_sort(F.collect_list(F.when(~earn, F.col("item")))).alias("co_filed_items"),
                                       F.max(F.when(earn, F.col("subtype"))).alias("subtype"))  # a filing has a handful of items
    direction = F.when(F.col("surprise_pct") > 0, "positive").when(F.col("surprise_pct") < 0, "negative").when(F.col("surprise_pct") == 0, "flat")
    return (g.filter("_e = 1").drop("_e").join(surprise.select("filing_id", "state", "surprise_pct"), "filing_id", "left")
            .withColumn("surprise_state", F.coalesce("state", F.lit("NOT_COMPUTED"))).withColumn("surprise_direction", direction).drop("state"))


def revenue_growth(facts: DataFrame) -> DataFrame:
    """L10. Per filing: the comparable revenue pair. One current and one prior value (340 to 390 days apart) per tag; an ambiguous tag spoils the filing; all usable tags must agree.

    Needs entity, accn, tag, start, end, val, period_end. A filing carries a bounded handful of figures.
    """
    q = facts.filter(quarterly(inclusive=True) & (F.col("val") >= 0)).select("entity", "accn", "tag", "start", "end", "val", "period_end").distinct()
    cur = F.col("end") == F.col("period_end")
    pri = F.datediff("period_end", "end").between(340, 390)
    t = q.groupBy("entity", "accn", "tag").agg(F.count_if(cur).alias("nc"), F.count_if(pri).alias("np"), F.max(F.when(cur, F.struct("start", "val"))).alias("c"), F.max(F.when(pri, F.struct("end", "start", "val"))).alias("p"))
    usable = (F.col("nc") == 1) & (F.col("np") == 1)
    ambiguous = ~usable & (F.col("nc") > 0) & (F.col("np") > 0)
    pair = F.when(usable & (F.col("p.val") > 0), F.struct(F.col("c.start").alias("cs"), F.col("c.val").alias("cv"), F.col("p.end").alias("pe"), F.col("p.start").alias("ps"), F.col("p.val").alias("pv")))
    g = t.groupBy("entity", "accn").agg(F.count_if(ambiguous).alias("bad"), F.count_distinct(pair).alias("k"), F.max(pair).alias("pair"))
    good = (F.col("bad") == 0) & (F.col("k") == 1)
    return g.select("entity", "accn", F.when(good, "usable").otherwise("unusable_revenue").alias("status"), F.when(good, growth(F.col("pair.cv"), F.col("pair.pv"))).alias("growth"))


def latest_filing_before(events: DataFrame, filings: DataFrame, key: str, zone: str, max_age=110, bucket_days=1) -> DataFrame:
    """J10. For each event the filing with the newest period (then earliest available, then accession) accepted in [published_at, deadline) and not late in the day.

    Events and filings meet on (key, bucket of days of acceptance), the window of an event covering only the few buckets up to its deadline; wide windows want wide buckets.
    """
    f = (filings.withColumn("available", filing_available("accepted_at", "filing_date", zone)).filter("available is not null")
         .withColumn("_day", F.floor(F.unix_date(F.to_date("accepted_at")) / bucket_days)).select(key, "_day", "accession", "accepted_at", "available", "period_end"))
    bucket = lambda c: F.floor(F.unix_date(F.to_date(c)) / bucket_days)
    e = events.withColumn("_day", F.explode(F.sequence(bucket("published_at"), bucket("deadline"))))
    age = F.datediff(local_day("published_at", zone), "period_end")
    ok = (F.col("accepted_at") >= F.col("published_at")) & (F.col("accepted_at") < F.col("deadline")) & (F.col("available") < F.col("deadline")) & age.between(0, max_age)
    best = F.min_by(F.struct("accession", "period_end", "available"), F.struct((-F.unix_date("period_end")).alias("p"), "available", "accession"))
    got = e.join(f, [key, "_day"]).filter(ok).groupBy("event_id").agg(best.alias("_b")).select("event_id", "_b.*")
    return events.join(got, "event_id", "left")


def prefer_sources(events: DataFrame, sources, key="event_id", value="value") -> DataFrame:
    """J11. The value of the first source that has one; `sources` are (name, DataFrame(key, value)) in order of trust."""
    out = events
    for name, df in sources:
        out = out.join(df.select(key, F.struct(F.lit(name).alias("source"), F.col(value).alias("value")).alias("_" + name)), key, "left")
    chosen = F.coalesce(*["_" + name for name, _ in sources])
    return out.withColumn("_c", chosen).select(*events.columns, F.col("_c.source").alias("source"), F.col("_c.value").alias("value"))


def revenue_pair_reason(published, zone, current="current_usd", prior="prior_usd", end="period_end", prior_end="prior_end") -> Column:
    """Why a pair of revenues is no year-over-year growth: age of the period (0 to 110 local days at publication), distance of the periods (340 to 390 days), amounts."""
    age = F.datediff(local_day(published, zone), end)
    return (F.when(~F.coalesce(age.between(0, 110), F.lit(False)), "PERIOD_AGE").when(~F.coalesce(F.datediff(end, prior_end).between(340, 390), F.lit(False)), "PERIOD_DISTANCE")
            .when(~F.coalesce((F.col(current) >= 0) & (F.col(prior) > 0), F.lit(False)), "INVALID_AMOUNTS"))


def wire_growth(wire: DataFrame, events: DataFrame, zone: str, key="event_id") -> DataFrame:
    """L11. Growth stated by the original wire, available a minute after publication; rows that disagree with their event are refused with a reason, late ones are unavailable.

    `wire` carries published_at, cutoff, source_url, basis and the revenue pair; `events` published_at, cutoff, source_url and deadline.
    """
    e = events.select(key, *[F.col(c).alias("_" + c) for c in ("published_at", "cutoff", "source_url", "deadline")])
    available = F.col("published_at") + F.expr("interval 1 minute")
    agrees = F.col("published_at").eqNullSafe(F.col("_published_at")) & F.col("cutoff").eqNullSafe(F.col("_cutoff"))
    reason = (F.when(~agrees, "TIMESTAMP_MISMATCH").when(~F.col("source_url").eqNullSafe(F.col("_source_url")) | (F.coalesce("basis", F.lit("")) == ""), "SOURCE_MISMATCH")
              .when(available >= F.col("_deadline"), "NOT_AVAILABLE_IN_TIME").otherwise(revenue_pair_reason("published_at", zone)))
    return _stated(wire.join(e, key).withColumn("reason", reason).withColumn("available_at", available), key, "original_wire")


def exhibit_growth(exhibits: DataFrame, events: DataFrame, submissions: DataFrame, zone: str, key="event_id") -> DataFrame:
    """L11. Growth stated by an 8-K exhibit 99.1 or 99.2, by F11's clock; identity against the event, timing against the submission index, no comparison caveat.

    `exhibits` carries accession, cik, form, exhibit, currency, release_url, accepted_at, filing_date, comparison_caveat and the revenue pair; `events` accession, cik,
    published_at and deadline; `submissions` accession, form, accepted_at and filing_date, any number of rows per accession, one of which must agree.
    """
    e = events.select(key, *[F.col(c).alias("_" + c) for c in ("accession", "cik", "published_at", "deadline")])
    stated = ("accession", "form", "accepted_at", "filing_date")
    s = submissions.select(*[F.col(c).alias("_s_" + c) for c in stated]).distinct().withColumn("_timed", F.lit(True))
    folder = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("bigint").cast("string"), F.lit("/"), F.replace(F.col("accession"), F.lit("-"), F.lit("")), F.lit("/"))
    same = (F.col("accession").eqNullSafe(F.col("_accession")) & F.col("cik").eqNullSafe(F.col("_cik")) & F.col("form").eqNullSafe(F.lit("8-K")) & F.coalesce(F.col("exhibit").isin("99.1", "99.2"), F.lit(False))
            & F.col("currency").eqNullSafe(F.lit("USD")) & F.coalesce(F.startswith(F.col("release_url"), folder), F.lit(False)))
    timed = F.coalesce("_timed", F.lit(False))
    available = filing_available("accepted_at", "filing_date", zone)
    reason = (F.when(~same, "IDENTITY_MISMATCH").when(~timed, "TIMING_MISMATCH").when(F.coalesce("comparison_caveat", F.lit("")) != "", "COMPARISON_CAVEAT")
              .when((F.col("accepted_at") < F.col("_published_at")) | available.isNull() | (available >= F.col("_deadline")), "NOT_AVAILABLE_IN_TIME").otherwise(revenue_pair_reason("_published_at", zone)))
    indexed = [F.col("accession") == F.col("_s_accession"), *[F.col(c).eqNullSafe(F.col("_s_" + c)) for c in stated[1:]]]
    j = exhibits.join(e, key).join(s, indexed, "left")
    return _stated(j.withColumn("reason", reason).withColumn("available_at", available), key, "sec_earnings_exhibit")


def _stated(rows, key, source):
    good = F.col("reason").isNull()
    growth = F.when(good, F.col("current_usd") / F.nullif("prior_usd", F.lit(0)) - 1)
    return rows.select(key, F.lit(source).alias("source"), "reason", F.when(good, F.col("available_at")).alias("available_at"), growth.alias("growth"))


def join_evidence(events: DataFrame, evidence: DataFrame, key="event_id", fields=("published_at", "cutoff")) -> DataFrame:
    """J14. Full comparison by id: rows on one side only, and rows whose fields disagree, with the names of what disagrees."""
    a = events.select(key, *[F.col(f).alias("_a_" + f) for f in fields], F.lit(True).alias("_a"))
    b = evidence.select(key, *[F.col(f).alias("_b_" + f) for f in fields], F.lit(True).alias("_b"))
    j = a.join(b, key, "full_outer")
    wrong = F.array_compact(F.array(*[F.when(~F.col("_a_" + f).eqNullSafe(F.col("_b_" + f)), F.lit(f)) for f in fields]))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.select(key, F.when(F.col("_b").isNull(), "EVIDENCE_MISSING").when(F.col("_a").isNull(), "EVENT_MISSING").when(F.size(wrong) > 0, "DISAGREES").otherwise("AGREES").alias("state"),
                    F.when(both, F.array_join(wrong, ",")).alias("fields"))


def match_names(records: DataFrame, companies: DataFrame, record_name="name", company_name="company") -> DataFrame:
    """J15. Sponsor match: normalized names equal, or one contained in the other.

    A name is contained in another exactly when it equals one of the other's substrings, so names meet by equality on text: the longer side offers its substrings of the
    lengths that occur on the shorter side. No pair is formed that does not match, however many names begin alike.
    """
    r = records.withColumn("_r", norm_company(record_name)).filter("_r != ''").select("_r").distinct()
    c = companies.withColumn("_c", norm_company(company_name)).filter("_c != ''").select("_c").distinct()

    def inside(long, lc, short, sc):
        lengths = short.agg(F.array_sort(F.collect_set(F.length(sc)))).scalar()  # distinct lengths of names, a few dozen
        sized = long.select(lc, F.explode(lengths).alias("_n")).filter(F.col("_n") <= F.length(lc))
        pieces = F.transform(F.sequence(F.lit(1), F.length(lc) - F.col("_n") + 1), lambda i: F.substring(F.col(lc), i, F.col("_n")))
        return sized.select(lc, F.explode(F.array_distinct(pieces)).alias(sc)).join(short, sc).select("_r", "_c")

    pairs = inside(r, "_r", c, "_c").unionByName(inside(c, "_c", r, "_r")).distinct()
    return (records.withColumn("_r", norm_company(record_name)).join(pairs, "_r").join(companies.withColumn("_c", norm_company(company_name)), "_c").drop("_r", "_c"))


def prefix_join(records: DataFrame, prefixes: DataFrame, name="name", prefix="prefix") -> DataFrame:
    """J16. Every prefix with the records that start with it; a prefix without records keeps one empty row. Met by equality on the prefix text, per prefix length."""
    lengths = F.array_sort(F.collect_set(F.length(prefix)))
    known = prefixes.agg(lengths.alias("l")).first()["l"] or []  # the distinct lengths of the search terms, a short list
    cut = records.withColumn("_p", F.explode(F.array_distinct(F.array(*[F.lower(F.substring(name, 1, int(n))) for n in known])))) if known else records.withColumn("_p", F.lit(None).cast("string"))
    cut = cut.withColumn("_hit", F.lit(True))
    return prefixes.withColumn("_p", F.lower(prefix)).join(cut, "_p", "left").drop("_p")


def exclude_near(pairs: DataFrame, dates: DataFrame, days: int, key="symbol") -> DataFrame:
    """J17. Flag (symbol, session) rows within n days of any listed date of the symbol; dates stand on the days they exclude, so rows meet by equality."""
    near = dates.select(key, F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))).alias("session")).distinct().withColumn("_n", F.lit(True))
    return pairs.join(near, [key, "session"], "left").withColumn("excluded", F.coalesce("_n", F.lit(False))).drop("_n")


def tag_source(events: DataFrame, specs: DataFrame, key="event_id") -> DataFrame:
    """J19. The one source each event belongs to; none or several is a fault."""
    n = specs.groupBy(key).agg(F.count(F.lit(1)).alias("n_sources"), F.min("source").alias("source"))
    return (events.select(key).join(n, key, "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
            .withColumn("state", F.when(F.col("n_sources") == 1, "TAGGED").when(F.col("n_sources") == 0, "NO_SOURCE").otherwise("SEVERAL_SOURCES")).withColumn("source", F.when(F.col("n_sources") == 1, F.col("source"))))


def partition_by_mask(rows: DataFrame, masks: DataFrame, clean: bool, key="event_id") -> DataFrame:
    """V22. Disposition of each row under its source mask: hard exclusions always, soft caveats only in the clean variant."""
    soft = F.col("soft") if clean else F.lit(False)
    return (rows.join(masks.select(key, "hard", "soft"), key, "left").withColumn("disposition", F.when(F.col("hard"), "hard_source_exclusion").when(soft, "soft_source_caveat").otherwise("accepted")).drop("hard", "soft"))


def issuers_by_exchange(df: DataFrame, allowed) -> DataFrame:
    """A9. Per issuer on an allowed exchange: sorted tickers and exchanges, smallest name."""
    return (df.filter(F.col("exchange").isin(*allowed)).groupBy(pad_cik("cik_no").alias("cik"))
            .agg(F.array_sort(F.collect_set("ticker")).alias("tickers"), F.array_sort(F.collect_set("exchange")).alias("exchanges"), F.min("name").alias("name")))


def issuer_pool(frame: DataFrame, keys=("cik", "accession"), fields=("name",)) -> DataFrame:
    """A10. Distinct filings per issuer; one accession with different contents is a conflict. Counts are partial aggregates; only the summary is returned."""
    f = frame.groupBy(*keys).agg((F.count_distinct(F.struct(*fields)) > 1).alias("conflict"), F.min(fields[0]).alias(fields[0]))
    return f.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("filings"), F.count_if("conflict").alias("conflicts"), F.min(fields[0]).alias("first_" + fields[0]), F.count_distinct(fields[0]).alias("n_names"), F.max(keys[1]).alias("last_accession"))


def opening_gaps(opens: DataFrame, bars: DataFrame, calendar) -> DataFrame:
    """L17. Each official open with the close of the session before it: gap, and the disposition (why there is none, or verified_open). Rows need security_id and session."""
    at = F.broadcast(calendar.sessions.select("session", (F.col("idx") - 1).alias("idx")))  # one row per session
    j = opens.join(at, "session").join(bars.select("security_id", "idx", F.col("close").alias("anchor_close")), ["security_id", "idx"], "left")
    state = F.coalesce("reason", F.when(F.col("anchor_close").isNull(), "missing_anchor"), F.lit("verified_open"))
    return j.withColumn("disposition", state).withColumn("opening_gap", F.when(state == "verified_open", F.col("official_open") / F.nullif("anchor_close", F.lit(0.0)) - 1)).drop("idx")


def event_openings(events: DataFrame, opens: DataFrame, listings: DataFrame, bars: DataFrame, calendar) -> DataFrame:
    """L17. Every event with the opening gap of its reaction session, or the first reason why there is none.

    `events` has event_id, symbol, security_id, cutoff, timing, reaction_idx and listed_from (since when the listing is known); `opens` is the result of `official_open`,
    `listings` (symbol, exchange). In order: unsupported_listing, unsupported_clock (no session, another timing than before or after hours, or frozen at or after the open),
    anchor_identity_unverified (listed after the anchor session's close), missing_anchor, ambiguous_official_open, no_official_open; else verified_open.
    """
    days = calendar.sessions.select("idx", "session", "open_utc", "close_utc")
    react = F.broadcast(days.select(F.col("idx").alias("reaction_idx"), "session", "open_utc"))
    anchor = F.broadcast(days.select((F.col("idx") + 1).alias("reaction_idx"), F.col("close_utc").alias("_anchor_close_at")))
    closes = bars.select("security_id", (F.col("idx") + 1).alias("reaction_idx"), F.col("close").alias("anchor_close"))
    e = events.join(react, "reaction_idx", "left").join(anchor, "reaction_idx", "left").join(listing_venues(listings).select("symbol", "venue"), "symbol", "left")
    j = e.join(closes, ["security_id", "reaction_idx"], "left").join(opens.select("symbol", "session", "official_open", "reason", F.lit(True).alias("_seen")), ["symbol", "session"], "left")
    clock = F.coalesce(F.col("timing").isin("premarket", "after_hours") & (F.col("cutoff") < F.col("open_utc")), F.lit(False))
    finite = (F.col("anchor_close") > 0) & (F.col("anchor_close") < float("inf"))
    state = (F.when(F.col("venue").isNull() | ~F.rlike("symbol", F.lit(r"^[A-Z][A-Z0-9.]{0,9}$")), "unsupported_listing").when(~clock, "unsupported_clock")
             .when(~F.coalesce(F.col("listed_from") <= F.col("_anchor_close_at"), F.lit(False)), "anchor_identity_unverified")
             .when(~F.coalesce(finite, F.lit(False)), "missing_anchor").when(F.col("_seen").isNull(), "no_official_open").otherwise(F.coalesce("reason", F.lit("verified_open"))))
    return (j.withColumn("disposition", state).withColumn("opening_gap", F.when(state == "verified_open", F.col("official_open") / F.col("anchor_close") - 1))
            .select(*events.columns, "session", "disposition", "opening_gap"))


def action_counts(actions: DataFrame, by=("security_id", "type")) -> DataFrame:
    """A28."""
    return actions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def latest_period(filings: DataFrame, by, period: Column, available: Column, value: str, tie: Column) -> DataFrame:
    """O9. Of each group the value of the newest period; of several filings of it the earliest available, then the first by `tie`."""
    return filings.groupBy(*by).agg(F.max_by(value, F.struct(period, -F.unix_micros(available), -tie)).alias(value))


def listing_venues(listings: DataFrame) -> DataFrame:
    """L16. symbol, venue and tape of every listing whose exchange has an official opening print; other exchanges are left out."""
    at = lambda k: lookup("exchange", {name: pair[k] for name, pair in LISTED_ON.items()})
    return listings.select("symbol", at(0).alias("venue"), at(1).alias("tape")).filter("venue is not null").distinct()


def opening_prints(trades: DataFrame, opens: DataFrame, listings: DataFrame) -> DataFrame:
    """L16, T1, T2. Prints with condition Q on the venue and the tape of their symbol's listing, with their session's open; of a trade batch or stream.

    `opens` holds one row per session, `listings` (symbol, exchange) one per symbol; the planner chooses the joins by their sizes. A print on the right venue but reported on
    another tape, or the reverse, is none of the listing's own.
    """
    t = trades.filter(F.array_contains("conditions", "Q")).join(opens, "session")
    own = listing_venues(listings).withColumnsRenamed({"venue": "print_venue", "tape": "print_tape"})
    return t.join(own, ["symbol", "print_venue", "print_tape"])


def suspect_print() -> Column:
    """L16, T2. Corrected prints, and those without an id or a finite positive price."""
    price = F.col("price")
    return F.col("correction").isNotNull() | F.col("trade_id").isNull() | price.isNull() | F.isnan(price) | ~((price > 0) & (price < float("inf")))


def official_open(trades: DataFrame, opens: DataFrame, listings: DataFrame, by, zone_open="open_utc", seconds=60) -> DataFrame:
    """L16. The unique official opening print of each (symbol, session): venue and tape of the listing, condition Q, inside [open, open + 60 s). Suspect or several different prints are ambiguous."""
    t = opening_prints(trades, opens, listings).filter((F.col("t") >= F.col(zone_open)) & (F.col("t") < F.col(zone_open) + F.make_dt_interval(secs=F.lit(seconds))))
    suspect = suspect_print()
    g = t.groupBy(*by).agg(F.count_if(suspect).alias("suspects"), F.count_distinct(F.when(~suspect, F.struct("trade_id", "t", "price"))).alias("prints"), F.max(F.when(~suspect, F.col("price"))).alias("price"))
    reason = F.when((F.col("suspects") > 0) | (F.col("prints") > 1), "ambiguous_official_open").when(F.col("prints") == 0, "no_official_open")
    return g.withColumn("reason", reason).withColumn("official_open", F.when(F.col("reason").isNull(), F.col("price"))).select(*by, "official_open", "reason")
