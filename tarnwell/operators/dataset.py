"""Dataset building: plan, acceptance of returned records, statistics, stratified split, chat records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import places

RISKS = ("low", "medium", "high")
# Word ranges, customer types, amounts, ambiguities, topics and their categories.
WORD_RANGES = ("25-40", "45-65", "70-95")
CUSTOMER_TYPES = ("retail customer", "small business", "corporate treasury", "nonprofit", "sole trader")
AMOUNT_BANDS = ("small routine payment", "moderate transfer", "large transfer", "no transaction yet")
AMBIGUITIES = ("clear evidence", "borderline evidence", "incomplete evidence")
TOPICS = (
    ("KYC", "KYC"), ("AML", "AML"), ("sanctions", "Sanctions"), ("PEP", "PEP"), ("suspicious transactions", "Suspicious Transactions"), ("source of funds", "Source of Funds"),
    ("enhanced due diligence", "Enhanced Due Diligence"), ("customer due diligence", "Customer Due Diligence"), ("transaction monitoring", "Transaction Monitoring"), ("record keeping", "Record Keeping"),
    ("high-risk jurisdictions", "High-Risk Jurisdictions"), ("escalation", "Escalation"), ("onboarding controls", "Onboarding Controls"), ("false positives", "False Positives"),
)
SPLITS = (("train", 8), ("validation", 1), ("test", 1))

# Of each topic in its order, the condition and the action of low, medium and high risk.
RULES = (
    (("identity evidence is complete and consistent", "continue identity approval"), ("identity details have a minor unresolved discrepancy", "pause approval and request clarification"), ("identity evidence is missing or suspected altered", "hold onboarding and escalate for verification")),
    (("activity matches the documented purpose and evidence", "continue routine review"), ("activity is unusual but an explanation awaits verification", "request supporting evidence and review"), ("unexplained layering or concealment indicators remain", "hold the activity and escalate to the compliance lead")),
    (("a screening match is disproved by identifiers", "document clearance and continue"), ("a screening match lacks enough identifiers to resolve", "pause processing and obtain identifiers"), ("identifiers confirm an internal restricted-list match", "block processing and escalate internally")),
    (("screening confirms no public-role connection", "continue standard review"), ("a possible public-role connection is unverified", "pause approval and clarify the connection"), ("a public role or close connection is confirmed", "perform enhanced due diligence and obtain senior approval before onboarding")),
    (("a flagged transaction has verified commercial purpose", "document the explanation and clear the flag"), ("a flagged transaction has plausible but unverified purpose", "request evidence before clearing the flag"), ("a flagged transaction remains inconsistent with its stated purpose", "hold processing and escalate the suspicion")),
    (("funding origin is supported by consistent documents", "accept the source and continue"), ("funding origin is plausible but documents are incomplete", "request missing source evidence"), ("funding origin is concealed or contradicted by documents", "hold acceptance and escalate for enhanced review")),
    (("enhanced checks and required approval are complete", "continue with documented monitoring"), ("enhanced checks lack a noncritical supporting item", "pause approval and obtain the item"), ("a material concern remains unresolved after enhanced checks", "hold approval and escalate to senior compliance")),
    (("ownership and business purpose are verified", "approve standard due diligence"), ("ownership or purpose requires further clarification", "request clarification before approval"), ("ownership is concealed or documents materially conflict", "hold approval and escalate for enhanced due diligence")),
    (("activity fits the verified profile", "retain routine monitoring"), ("activity deviates from the profile without verified explanation", "review the deviation and request evidence"), ("repeated unexplained deviations persist after review", "hold affected activity and escalate monitoring findings")),
    (("required review records are complete and retrievable", "archive under the internal retention schedule"), ("a required record is incomplete but recoverable", "recover the record and track remediation"), ("critical evidence is missing or records appear altered", "preserve available records and escalate the integrity issue")),
    (("no internal high-risk location connection is identified", "continue standard location review"), ("a possible internal high-risk location connection is unresolved", "clarify the connection before processing"), ("an internal high-risk location connection is confirmed", "perform enhanced review and obtain senior approval")),
    (("a documented concern is resolved within staff authority", "close the concern with evidence"), ("a concern remains unresolved without immediate material impact", "refer it to the compliance reviewer"), ("a material unresolved concern requires restricted authority", "hold the affected decision and escalate to the compliance lead")),
    (("all required onboarding controls are complete", "activate the account after approval"), ("a required noncritical onboarding check is pending", "keep activation paused until completion"), ("a critical check fails or approval is bypassed", "block activation and escalate the control breach")),
    (("independent identifiers disprove an alert", "document the mismatch and clear the alert"), ("an alert is plausible but identifiers are inconclusive", "retain the alert and obtain distinguishing evidence"), ("independent identifiers substantiate an alert", "retain the restriction and escalate the confirmed concern")),
)
POLICIES = tuple((topic, category, rules) for (topic, category), rules in zip(TOPICS, RULES, strict=True))


def policies(spark: SparkSession) -> DataFrame:
    """The static dimension: topic number, topic, category and rules. Fixed size, so it may be broadcast."""
    rows = [(i, t, c, [(r, cond, act) for r, (cond, act) in zip(RISKS, rules, strict=True)]) for i, (t, c, rules) in enumerate(POLICIES)]
    return spark.createDataFrame(rows, "number int, topic string, category string, rules array<struct<risk:string,condition:string,action:string>>")


def excerpt(rules: Column, style: Column) -> Column:
    """Policy text in one of two styles."""
    plain = F.transform(rules, lambda r: F.concat(F.lit("If "), r["condition"], F.lit(", assign "), r["risk"], F.lit(" risk and "), r["action"], F.lit(".")))
    turned = F.transform(rules, lambda r: F.concat(F.initcap(r["risk"]), F.lit(" risk applies when "), r["condition"], F.lit("; "), r["action"], F.lit(".")))
    return F.concat(F.lit("Internal policy: "), F.array_join(F.when(style % 2 == 0, plain).otherwise(turned), " "))


def seeded(key: Column, seed: int, tag: str) -> Column:
    """Hex order key of (key, seed, tag) that any engine can compute."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)), F.lit(tag)).cast("binary"))


def pick(values: tuple[str, ...], key: Column, seed: int, tag: str) -> Column:
    at = F.conv(F.substring(seeded(key, seed, tag), 1, 6), 16, 10).cast("int") % len(values)
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def assignment_plan(spark: SparkSession, n: int = 160, seed: int = 42) -> DataFrame:
    return assigned(spark.range(n), seed)


def assigned(numbers: DataFrame, seed: int = 42) -> DataFrame:
    """numbers: id, from 0 without gaps. Topics rotate, risks and styles rotate by cycle; topic and risk counts differ by at most one. ``place`` is a seeded order."""
    i = F.col("id")
    topics, cycle = len(POLICIES), F.floor(F.col("id") / len(POLICIES)).cast("int")
    x = numbers.withColumns({"number": (i % topics).cast("int"), "cycle": cycle}).join(F.broadcast(policies(numbers.sparkSession)), "number")
    risk = F.element_at(F.array(*map(F.lit, RISKS)), ((F.col("cycle") + F.col("number")) % 3 + 1).cast("int"))
    x = x.withColumn("target_risk", risk)
    return x.select(
        F.format_string("triage_%04d", i + 1).alias("id"),
        "topic",
        "category",
        excerpt(F.col("rules"), F.col("cycle")).alias("policy_excerpt"),
        "target_risk",
        pick(CUSTOMER_TYPES, i, seed, "customer").alias("customer_type"),
        pick(AMOUNT_BANDS, i, seed, "amount").alias("transaction_size"),
        F.element_at(F.array(*map(F.lit, WORD_RANGES)), F.col("cycle") % 3 + 1).alias("scenario_word_range"),
        F.when(F.col("target_risk") == "low", "clear evidence").otherwise(pick(AMBIGUITIES, i, seed, "ambiguity")).alias("ambiguity"),
        seeded(i, seed, "order").alias("place"),
    )


def batches(plan: DataFrame, size: int = 5, first: int = 1, written=None) -> DataFrame:
    """Plan rows dealt in order to batches of ``size``. One window orders a plan of a thousand rows at most; a larger one is sorted in ranges, with ``written``."""
    if written is not None:
        return places(plan.withColumnRenamed("place", "key"), "key", written).withColumn("batch_id", (F.floor((F.col("place") - 1) / size) + first).cast("long")).drop("place").withColumnRenamed("key", "place")
    n = F.row_number().over(Window.orderBy("place"))
    return plan.withColumn("batch_id", (F.floor((n - 1) / size) + first).cast("long"))


def pending(plan: DataFrame, accepted: DataFrame) -> DataFrame:
    return plan.join(accepted.select("id"), "id", "left_anti")


def next_batch(journal: DataFrame) -> DataFrame:
    return journal.agg((F.coalesce(F.max("batch_id"), F.lit(0)) + 1).alias("next_batch_id"))


#: Limits of a record's texts, in characters.
LIMITS = {"policy_excerpt": (30, 1600), "scenario": (20, 2000), "reason": (5, 400), "action": (15, 1000)}


def schema_ok(columns: list[str]) -> Column:
    """Rules of a record alone: id shape, lengths after trimming, risk enumeration."""
    ok = F.col("id").rlike(r"^[A-Za-z0-9_-]{1,80}$") & F.col("risk_level").isin(*RISKS)
    for name, (low, high) in LIMITS.items():
        if name in columns:
            ok = ok & F.length(F.trim(F.col(name))).between(low, high)
    return F.coalesce(ok, F.lit(False))


def accept(candidates: DataFrame, assignments: DataFrame) -> DataFrame:
    """candidates: batch_id, pos, id, topic, category, policy_excerpt, risk_level and texts; of each row the reason, or accepted.

    Order of reasons: schema, duplicate id, unrequested id, assignment mismatch, assigned-risk mismatch. Only
    an accepted row makes its id a duplicate for later rows, so the first row that passes all but that test wins.
    """
    plan = assignments.select("batch_id", "id", *[F.col(c).alias(f"want_{c}") for c in ("topic", "category", "policy_excerpt", "target_risk")], F.lit(True).alias("asked"))
    x = candidates.join(plan, ["batch_id", "id"], "left").withColumn("ok", schema_ok(candidates.columns))
    same = (F.col("topic") == F.col("want_topic")) & (F.col("category") == F.col("want_category")) & (F.col("policy_excerpt") == F.col("want_policy_excerpt"))
    own = F.when(~F.col("ok"), "schema_validation").when(F.col("asked").isNull(), "unrequested_id").when(~F.coalesce(same, F.lit(False)), "assignment_mismatch")
    own = own.when(F.col("risk_level") != F.col("want_target_risk"), "assigned_risk_mismatch")
    x = x.withColumn("own", own)
    order = F.struct("batch_id", "pos")
    w = Window.partitionBy("id")
    x = x.withColumn("winner", F.min(F.when(F.col("own").isNull(), order)).over(w))
    reason = F.when(F.col("own") == "schema_validation", F.col("own")).when(F.col("winner") < order, "duplicate_id").when(F.col("own").isNotNull(), F.col("own")).otherwise("accepted")
    return x.select(*candidates.columns, reason.alias("reason"))


def split_sizes(total: int) -> dict[str, int]:
    """80/10/10 by largest remainder, ties to the earlier split."""
    sizes = {n: total * w // 10 for n, w in SPLITS}
    order = sorted(SPLITS, key=lambda s: -(total * s[1] % 10))
    for n, _ in order[: total - sum(sizes.values())]:
        sizes[n] += 1
    return sizes


def stratum_level(df: DataFrame, total: int, levels: tuple[tuple[str, ...], ...] = (("topic", "risk"), ("topic",), ("risk",), ())) -> tuple[str, ...]:
    """First level whose strata fit: as many as the smaller holdout at most, and three rows in each at least."""
    sizes = split_sizes(total)
    for level in levels:
        if not level:
            return level
        n, least = df.groupBy(*level).count().agg(F.count("*"), F.min("count")).first()
        if n and n <= min(sizes["validation"], sizes["test"]) and least >= 3:
            return level
    return ()


def nth_of_group(df: DataFrame, groups: list[str], order: Column, bucket: Column, wanted: DataFrame) -> DataFrame:
    """wanted: ``groups`` and k. Adds ``at``: the k-th smallest ``order`` of the group. ``bucket`` must not fall as ``order`` grows.

    A selection instead of a sort: the buckets' counts tell in which of them a group's k-th row lies, and only that one is put in order.
    """
    x = df.select(*groups, order.alias("order"), bucket.alias("bucket"))
    counts = x.groupBy(*groups, "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = counts.withColumn("before", before).join(wanted, groups).where((F.col("before") < F.col("k")) & (F.col("k") <= F.col("before") + F.col("n")))
    rows = x.join(ends.select(*groups, "bucket", "k", "before"), [*groups, "bucket"])
    place = F.row_number().over(Window.partitionBy(*groups, "bucket", "k").orderBy("order"))
    return rows.withColumn("place", place).where(F.col("place") == F.col("k") - F.col("before")).select(*groups, "k", F.col("order").alias("at"))


def quotas(strata: DataFrame, total: int) -> DataFrame:
    """strata: stratum and n. Adds n_test and n_validation: shares rounded down, and one more for the largest remainders, ties by name.

    Strata have three rows at least (or there is one stratum), so no quota passes what a stratum has.
    """
    sizes = split_sizes(total)
    names = ("test", "validation")
    share = {c: F.col("n") * sizes[c] / F.lit(total) for c in names}
    base = {c: F.floor(share[c]) for c in names}
    left = strata.agg(*[(F.lit(sizes[c]) - F.sum(base[c])).alias(c) for c in names]).first()
    ranks = F.explode(F.array(*[F.struct(F.lit(c).alias("split"), (base[c] - share[c]).alias("rest")) for c in names]))
    x = strata.select("stratum", ranks.alias("x")).select("x.split", "x.rest", "stratum")
    wanted = strata.sparkSession.createDataFrame([(c, left[c]) for c in names if left[c]] or [("", 0)], "split string, k long")
    last = nth_of_group(x, ["split"], F.struct("rest", "stratum"), F.floor(F.col("rest") * 4096), wanted)
    cut = {r["split"]: r["at"] for r in last.collect()}  # two rows
    for c in names:
        own = base[c] - share[c]
        more = (own < F.lit(cut[c]["rest"])) | ((own == F.lit(cut[c]["rest"])) & (F.col("stratum") <= F.lit(cut[c]["stratum"]))) if c in cut else F.lit(False)
        strata = strata.withColumn(f"n_{c}", base[c] + more.cast("long"))
    return strata


def stratified_split(df: DataFrame, seed: int = 42, minimum: int = 120, key: str = "id", bucket_rows: int = 50_000) -> DataFrame:
    """df: key, topic, risk and, if it is to be checked, scenario_key (a hash of the normalised scenario). ``split`` of every row: exact totals, stratum quotas by largest remainder, seeded order.

    A row's order in its stratum is a hash of its key. The keys at which a stratum's test and validation rows end are found by selection (``nth_of_group``)
    over buckets of about ``bucket_rows`` rows by the hash's first digits, so no stratum, however hot, is sorted in one task; each row is then
    compared with its stratum's two ends. Strata stay in tables; Spark broadcasts them if they are small.
    """
    total, known = df.agg(F.count("*"), F.count_distinct(key)).first()
    if total < minimum:
        raise ValueError(f"a split needs {minimum} rows")
    if known != total:
        raise ValueError(f"{key} must be unique")
    if "scenario_key" in df.columns and df.agg(F.count_distinct("scenario_key")).first()[0] != total:
        raise ValueError("scenario_key must be unique")
    level = stratum_level(df, total)
    hashed = seeded(F.col(key), seed, "split")
    x = df.withColumns({"stratum": F.concat_ws("|", *[F.col(c) for c in level]) if level else F.lit("all"), "__hash": hashed})
    near = quotas(x.groupBy("stratum").agg(F.count("*").alias("n")), total)
    digits = 0
    while 16**digits * bucket_rows < total:
        digits += 1
    wanted = near.select("stratum", F.explode(F.array("n_test", F.col("n_test") + F.col("n_validation"))).alias("k")).where("k > 0").distinct()
    ends = nth_of_group(x, ["stratum"], F.struct("__hash", F.col(key).alias("key")), F.substring("__hash", 1, digits), wanted)
    at = near.join(ends.withColumnRenamed("stratum", "of"), F.col("stratum") == F.col("of"), "left")
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("at")))
    cuts = at.groupBy(F.col("stratum").alias("of")).agg(pick(F.col("n_test")).alias("test_end"), pick(F.col("n_test") + F.col("n_validation")).alias("validation_end"))
    own = F.struct("__hash", F.col(key).alias("key"))
    split = F.when(own <= F.col("test_end"), "test").when(own <= F.col("validation_end"), "validation").otherwise("train")
    return x.join(cuts, F.col("stratum") == F.col("of")).select(*df.columns, "stratum", split.alias("split"))


def leakage(split: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Values of each key that occur in several splits; none should."""
    parts = None
    for k in keys:
        one = split.groupBy(F.col(k).cast("string").alias("value")).agg(F.count_distinct("split").alias("splits")).where("splits > 1").select(F.lit(k).alias("key"), "value", "splits")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def crosstab(df: DataFrame, row: str = "topic", column: str = "risk", values: tuple[str, ...] = RISKS) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().fillna(0)


def nth_values(df: DataFrame, column: str, ranks: list[int], most: int = 100_000, accuracy: int = 10_000) -> dict[int, float]:
    """The values of the given ranks (from 1) among the non-null values of ``column``, exact.

    Each round narrows a rank's bracket to values that surely hold it, by an approximate percentile either side and exact counts, to a
    thousandth or less; at most ``most`` values are put in order in the end. Ties at a bracket's ends are settled by their counts.
    """
    x = df.select(F.col(column).alias("x")).where("x is not null")
    n = x.count()
    open_, found = {r: (None, None, 0, n) for r in ranks}, {}  # the ends (exclusive), how many lie below, how many within
    within = lambda lo, hi: (F.lit(True) if lo is None else F.col("x") > lo) & (F.lit(True) if hi is None else F.col("x") < hi)
    while open_:
        small = {r: b for r, b in open_.items() if b[3] <= most}
        if small:
            every = F.sort_array(F.collect_list("x"))
            brackets = {b[:2] for b in small.values()}
            for lo, hi in brackets:
                own = [r for r, b in small.items() if b[:2] == (lo, hi)]
                got = x.where(within(lo, hi)).agg(every.alias("all")).select(*[F.element_at("all", r - small[r][2]).cast("double") for r in own]).first()
                found |= dict(zip(own, got, strict=True))
        open_ = {r: b for r, b in open_.items() if r not in small}
        if not open_:
            break
        ends = []
        for r, (lo, hi, below, m) in open_.items():
            sides = [max(0.0, (r - below - 1) / m - 2 / accuracy), min(1.0, (r - below) / m + 2 / accuracy)]
            ends.append(F.percentile_approx(F.when(within(lo, hi), F.col("x")), sides, accuracy))
        ends = dict(zip(open_, x.agg(*ends).first(), strict=True))
        counted = [F.struct(F.count_if(F.col("x") < a), F.count_if(F.col("x") == a), F.count_if((F.col("x") > a) & (F.col("x") < b)), F.count_if(F.col("x") == b)) for a, b in ends.values()]
        for r, (under, at_a, between, at_b) in zip(list(open_), x.agg(*counted).first(), strict=True):
            (lo, hi, below, m), (a, b) = open_[r], ends[r]
            if under < r <= under + at_a:
                found[r] = float(a)
            elif a != b and under + at_a + between < r <= under + at_a + between + at_b:
                found[r] = float(b)
            elif r <= under:  # never, by the percentile's error bound
                open_[r] = (lo, a, below, under - below)
            elif r > under + at_a + (between + at_b if a != b else 0):
                open_[r] = (b, hi, under + at_a + (between + at_b if a != b else 0), below + m - under - at_a - (between + at_b if a != b else 0))
            else:
                open_[r] = (a, b, under + at_a, between)
        open_ = {r: b for r, b in open_.items() if r not in found}
    return found


def described(df: DataFrame, column: str, most: int = 100_000) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles (between ranks by a straight line); quartiles by selection, not by a sort in one task."""
    x = F.col(column)
    stats = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))
    n = df.agg(F.count(x)).first()[0]
    at = {name: ((n - 1) * k // 4 + 1, (n - 1) * k % 4 / 4) for k, name in ((1, "q25"), (2, "q50"), (3, "q75"))}
    value = nth_values(df, column, sorted({r + up for r, part in at.values() for up in (0, 1 if part else 0)}), most) if n else {}
    quartile = {name: value[r] + (part and part * (value[r + 1] - value[r])) if n else None for name, (r, part) in at.items()}
    return stats.select("n", "mean", "std", "least", *[F.lit(q).cast("double").alias(name) for name, q in quartile.items()], "most")


def histogram(df: DataFrame, column: str, bins: int = 15) -> DataFrame:
    """Counts of equal-width bins; the maximum belongs to the last. The range is one aggregate row, joined as such."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null").join(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / width) + 1, F.lit(bins)))
    return x.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def chat_records(df: DataFrame, system: str) -> DataFrame:
    """df: id, policy_excerpt, scenario, risk_level, category, reason, action. One record of three messages per row."""
    user = F.concat(F.lit("Policy:\n"), F.col("policy_excerpt"), F.lit("\n\nScenario:\n"), F.col("scenario"))
    answer = F.to_json(F.struct("risk_level", "category", "reason", "action"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return df.select("id", F.array(message("system", F.lit(system)), message("user", user), message("assistant", answer)).alias("messages"))


def journal_mismatches(assigned: DataFrame, plan: DataFrame) -> DataFrame:
    """assigned: batch_id and the columns of the plan, one row per assignment of a journal. Rows that no row of the plan equals; any is fatal."""
    own = [c for c in plan.columns if c in assigned.columns]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"p.{c}")) for c in own]
    return assigned.alias("a").join(plan.select(*own).alias("p"), same, "left_anti")


def generation_counts(journal: DataFrame, candidates: DataFrame, accepted: DataFrame, plan: DataFrame, before: DataFrame) -> DataFrame:
    """One row: failed batches, returned records, valid ones before and after, and plan rows without a valid record. before: ids valid at the start."""
    valid = accepted.select("id").distinct()
    counted = {
        "failed_batches": journal.where(F.col("error_category").isNotNull() | F.col("response").isNull()),
        "returned_count": candidates,
        "existing_valid": before.select("id").distinct(),
        "newly_generated": valid.join(before.select("id").distinct(), "id", "left_anti"),
        "missing_count": plan.join(valid, "id", "left_anti"),
    }
    rows = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in counted.items()]
    return reduce(DataFrame.unionByName, rows).agg(*[F.max(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in counted])


def uniqueness(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key: rows, distinct values, and whether they agree."""
    out = None
    for k in keys:
        one = df.agg(F.lit(k).alias("key"), F.count("*").alias("n"), F.count_distinct(k).alias("values"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("unique", F.col("n") == F.col("values"))


def prior_first(df: DataFrame, key: str = "norm_md5") -> DataFrame:
    """df: id, prior and ``key``. Of equal keys the first row stays, rows that an earlier run kept before others, then by id."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(~F.col("prior"), "id"))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")
