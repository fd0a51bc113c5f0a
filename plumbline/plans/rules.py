"""
Saved checks: what a rule is, and the built-in set for the insurance tables.

A rule's queries are SQL text with named parameters, or functions from a set of
tables and the parameter values to a DataFrame. The built-in rules are functions,
so rules that differ only in their entity are one function.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import NULL_TEXT, decode
from plumbline.operators.latest import duplicate_keys, latest_version
from plumbline.operators.linkage import apart, linked, unlinked
from plumbline.operators.mutate import customer_totals, with_totals
from plumbline.plans import mapping
from plumbline.schemas import ENTITIES
from plumbline.sources.tables import batch_of, keyed_batch_of

Query = str | Callable[[Mapping, Mapping], DataFrame]

# The kinds of check.
COMPARE = "SOURCE_TARGET_COMPARE"
NO_ROWS = "SQL_ROWCOUNT"
COUNTS = "ROW_COUNT_MATCH"
STATUS = "STATUS_COLUMN"
REPORT = "INFORMATIONAL"
KINDS = (COMPARE, NO_ROWS, COUNTS, STATUS, REPORT)


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    folder: str = "/"
    source: Query | None = None
    target: Query | None = None
    check: Query | None = None
    keys: tuple[str, ...] = ()
    compare: tuple[str, ...] = ()
    tolerance: float = 0
    defaults: dict = field(default_factory=dict)
    scope: str = "GENERIC"
    entity: str = ""
    layer: str = ""
    severity: str = "Medium"
    regression: bool = True
    active: bool = True
    version: int = 1
    test_id: str = ""
    source_name: str = ""  # which of the named sources each side reads
    target_name: str = ""


# ---------------------------------------------------------------- rule shapes
def violation(
    rows: DataFrame, key, column: str, expected: Column, actual: Column, reason
) -> DataFrame:
    """A rule query's result under the recognised column names."""
    return rows.select(
        key.alias("BUSINESS_KEY"),
        F.lit(column).alias("COLUMN_NAME"),
        expected.cast("string").alias("EXPECTED_VALUE"),
        actual.cast("string").alias("ACTUAL_VALUE"),
        (reason if isinstance(reason, Column) else F.lit(reason)).alias("FAILURE_REASON"),
    )


def blank_key(rows: DataFrame, key: str) -> DataFrame:
    bad = rows.filter(F.col(key).isNull() | (F.trim(key) == ""))
    return violation(
        bad, F.col(key), key, F.lit("a non-null policy id"),
        F.coalesce(F.col(key), F.lit(NULL_TEXT)), "Policy id is null or blank",
    )


def repeated_key(rows: DataFrame, key: str) -> DataFrame:
    return violation(
        duplicate_keys(rows, [key]), F.col(key), key, F.lit("1"), F.col("n_rows"),
        "Policy id appears more than once in the batch",
    )


def claim_without_policy(claims: DataFrame, *policies: DataFrame) -> DataFrame:
    return _unknown(unlinked(claims, "POLICY_ID", *policies))


def _unknown(claims: DataFrame) -> DataFrame:
    return violation(
        claims, F.col("CLAIM_ID"), "POLICY_ID",
        F.lit("an existing policy id"), F.col("POLICY_ID"),
        "Claim references a policy that is neither in the batch nor in curated",
    )


def approved_out_of_range(claims: DataFrame) -> DataFrame:
    approved, amount = F.col("APPROVED_AMOUNT"), F.col("CLAIM_AMOUNT")
    return violation(
        claims.filter((approved < 0) | (approved > amount)), F.col("CLAIM_ID"),
        "APPROVED_AMOUNT", F.concat(F.lit("0 .. "), amount.cast("string")), approved,
        "Approved amount is negative or exceeds the claim amount",
    )


def wrong_type_decode(stg: DataFrame, trn: DataFrame, same: tuple = ("POLICY_ID", "BATCH_ID")) -> DataFrame:
    """``same``: what a row has in common with its staged one; for rows of one batch the key will do."""
    expected = decode(F.col("POLICY_TYPE"), mapping.POLICY_TYPES)
    pairs = stg.select(*same, expected.alias("_expected")).join(trn.select(*same, "POLICY_TYPE_DESC"), list(same))
    return violation(
        pairs.filter(F.col("POLICY_TYPE_DESC") != F.col("_expected")), F.col("POLICY_ID"),
        "POLICY_TYPE_DESC", F.col("_expected"), F.col("POLICY_TYPE_DESC"),
        "Policy type was not decoded per the mapping rule",
    )


def invalid_term(trn: DataFrame) -> DataFrame:
    issue, expiry = F.col("ISSUE_DATE"), F.col("EXPIRY_DATE")
    days = mapping.term_days(issue, expiry)
    return violation(
        trn.filter((expiry < issue) | (F.col("POLICY_TERM_DAYS") != days)), F.col("POLICY_ID"),
        "POLICY_TERM_DAYS", days, F.col("POLICY_TERM_DAYS"),
        "Expiry precedes issue date, or the derived term is wrong",
    )


def wrong_ratio(stg: DataFrame, trn: DataFrame, same: tuple = ("CLAIM_ID", "BATCH_ID")) -> DataFrame:
    """``same``: as for ``wrong_type_decode``."""
    expected = mapping.claim_ratio(F.col("APPROVED_AMOUNT"), F.col("CLAIM_AMOUNT"))
    pairs = stg.select(*same, expected.alias("_expected")).join(trn.select(*same, "CLAIM_RATIO"), list(same))
    ratio = F.col("CLAIM_RATIO")
    off = F.abs(F.coalesce(ratio, F.lit(0)) - F.col("_expected")) > F.lit("0.0001").cast(
        "decimal(10,4)"
    )
    return violation(
        pairs.filter(off | ~ratio.between(0, 1)), F.col("CLAIM_ID"), "CLAIM_RATIO",
        F.col("_expected"), ratio,
        "Claim ratio does not match approved / claimed, or is outside 0..1",
    )


def nonstandard_email(trn: DataFrame) -> DataFrame:
    email = F.col("EMAIL")
    tidy = F.lower(F.trim(email))
    return violation(
        trn.filter((email != tidy) | ~email.like("%@%.%")), F.col("CUSTOMER_ID"), "EMAIL",
        tidy, email, "Email is not lower-cased/trimmed, or is not a valid address",
    )


def orphan_claims(claims: DataFrame, policies: DataFrame) -> DataFrame:
    return _orphans(unlinked(claims, "POLICY_ID", policies))


def _orphans(claims: DataFrame) -> DataFrame:
    return violation(
        claims, F.col("CLAIM_ID"), "POLICY_ID",
        F.lit("a policy present in POLICY_MASTER"), F.col("POLICY_ID"),
        "Curated claim points at a policy that does not exist",
    )


def outside_coverage(claims: DataFrame, policies: DataFrame) -> DataFrame:
    return _outside(with_cover(claims, policies, "inner"))


def with_cover(claims: DataFrame, policies: DataFrame, how: str) -> DataFrame:
    """Claims with the days that their policy covers; ``_known`` is NULL where an outer join finds none."""
    cover = policies.select("POLICY_ID", "ISSUE_DATE", "EXPIRY_DATE", F.lit(True).alias("_known"))
    return claims.select("CLAIM_ID", "POLICY_ID", "CLAIM_DATE").join(cover, "POLICY_ID", how)


_OUTSIDE = "CLAIM_DATE < ISSUE_DATE OR CLAIM_DATE > EXPIRY_DATE"


def _outside(pairs: DataFrame) -> DataFrame:
    claimed, issue, expiry = F.col("CLAIM_DATE"), F.col("ISSUE_DATE"), F.col("EXPIRY_DATE")
    return violation(
        pairs.filter(_OUTSIDE), F.col("CLAIM_ID"), "CLAIM_DATE",
        F.concat(issue.cast("string"), F.lit(" .. "), expiry.cast("string")), claimed,
        "Claim date falls outside the policy coverage window",
    )


def watermark_breach(
    trn: DataFrame, marks: DataFrame, key: str, process: str, batch_id: str
) -> DataFrame:
    """
    Rows of a batch outside its watermark window, and one row when the process
    was not committed for the batch. ``marks`` holds one row per process.
    """
    # The state table has one row per process, whatever the data's size.
    mark = marks.filter(F.col("PROCESS_NAME") == process).select(
        "PREVIOUS_WATERMARK", "BATCH_HIGH_WATERMARK", "LAST_BATCH_ID"
    )
    ts, low, high = (F.col(c) for c in
                     ("RECORD_EFFECTIVE_TS", "PREVIOUS_WATERMARK", "BATCH_HIGH_WATERMARK"))
    outside = trn.select(key, "RECORD_EFFECTIVE_TS", "BATCH_ID").join(
        F.broadcast(mark), F.col("BATCH_ID") == F.col("LAST_BATCH_ID")
    ).filter((ts <= low) | (ts > high))
    lower = F.coalesce(F.concat(F.lit("after "), low.cast("string")), F.lit("no lower bound"))
    breaches = violation(
        outside, F.col(key), "RECORD_EFFECTIVE_TS",
        F.concat(lower, F.lit(", up to "), high.cast("string")), ts,
        F.when(ts <= low,
               "Not newer than the previous batch's watermark: already-processed data sent again")
        .otherwise("Later than the high watermark committed for the batch"),
    )
    # Two one-row facts, stacked: rows carried, and the batch committed last.
    carried = trn.agg(F.count(F.lit(1)).alias("_n"), F.lit(None).cast("string").alias("_last"))
    committed = mark.agg(F.lit(0).cast("bigint").alias("_n"),
                         F.max("LAST_BATCH_ID").alias("_last"))
    last = F.col("_last")
    uncommitted = (
        carried.unionByName(committed).agg(F.sum("_n").alias("_n"), F.max("_last").alias("_last"))
        .filter((F.col("_n") > 0) & (last.isNull() | (last != batch_id)))
    )
    return breaches.unionByName(violation(
        uncommitted, F.lit(batch_id), "LAST_BATCH_ID", F.lit(batch_id),
        F.coalesce(last, F.lit("<no watermark>")),
        f"The {process} watermark was not committed for this batch",
    ))


def in_days(ts: Column, start, end) -> Column:
    """Both days inclusive, as a half-open range the scan can use."""
    first, after = _bounds(start, end)
    return (ts >= first) & (ts < after)


def _bounds(start, end) -> tuple[Column, Column]:
    first = F.lit(str(start)).cast("date").cast("timestamp_ntz")  # a time after the day is left out; years may have five digits
    return first, F.date_add(F.lit(str(end)).cast("date"), 1).cast("timestamp_ntz")


def latest_in_window(trn: DataFrame, key: str, start, end) -> DataFrame:
    """
    Latest version over all batches first; only then the date window. Versions before the window cannot be
    its result, nor hide one; those after it only hide others, whichever of them comes last, so they travel as
    their key alone and the first moment after the window.
    """
    ts = F.col("RECORD_EFFECTIVE_TS")
    first, after = _bounds(start, end)
    known = {key: F.col(key), "RECORD_EFFECTIVE_TS": F.least(ts, after).alias("RECORD_EFFECTIVE_TS")}
    slim = trn.filter(ts >= first).select(
        [known.get(c, F.when(ts < after, F.col(c)).alias(c)) for c in trn.columns])
    return latest_version(slim, key).filter(in_days(ts, start, end))


def touched_customers(tables: Mapping, batch: Callable[[str], DataFrame]) -> DataFrame:
    """Customers a batch changed through a customer, policy or claim row, with a source flag."""
    claimed = tables["POLICY_MASTER"].select("POLICY_ID", "CUSTOMER_ID").join(
        batch("TRN_CLAIM").select("POLICY_ID"), "POLICY_ID", "left_semi"
    )
    return (
        batch("TRN_CUSTOMER").select("CUSTOMER_ID")
        .unionByName(batch("TRN_POLICY").select("CUSTOMER_ID"))
        .unionByName(claimed.select("CUSTOMER_ID"))
    )


# ---------------------------------------------------------------- built-in set
def builtin_rules() -> list[Rule]:
    """The 25 saved checks and the four copies kept for regression runs."""
    rules = [
        *_staging(), *_transformation(), *_source_to_target(), *_linkage(),
        *_incremental(), *_historical(),
    ]
    # The checks kept as regression copies.
    copied = (
        "Policy transformation vs curated", "Claim transformation vs curated",
        "No orphan claims in curated", "Claim date inside policy coverage",
    )
    by_name = {r.name: r for r in rules}
    rules += [Rule(**{**by_name[n].__dict__, "folder": "/Regression"}) for n in copied]
    return [
        Rule(**{**r.__dict__, "test_id": f"TC-{i:04d}"}) for i, r in enumerate(rules, start=1)
    ]


def _rows(name: str, build: Callable[..., DataFrame], *needs: str, whole: tuple = (), read=batch_of, **about):
    """A no-rows rule over the batch's rows of ``needs``, as ``read``, and all rows of ``whole``."""
    def check(tables, p):
        return build(*[read(tables, t, p["batch_id"]) for t in needs],
                     *[tables[t] for t in whole])

    return Rule(name, NO_ROWS, check=check, **about)


def _unknown_policies(t: Mapping, p: Mapping) -> DataFrame:
    """Key and policy of the batch's staged claims whose policy is neither staged with them nor curated; in a run found once."""
    def find() -> DataFrame:
        claims = batch_of(t, "STG_CLAIM", p["batch_id"]).select("CLAIM_ID", "POLICY_ID")
        return unlinked(claims, "POLICY_ID", keyed_batch_of(t, "STG_POLICY", p["batch_id"]), t["POLICY_MASTER"])

    if not hasattr(t, "once"):
        return find()
    return t.once(("claims of unknown policies", p["batch_id"]), lambda: t.by_key(find(), "CLAIM_ID"))


def _staging() -> list[Rule]:
    about = {"folder": "/Staging", "layer": "Staging"}

    def recorded(tables, p):
        return batch_of(tables, "DQ_BATCH_METADATA", p["batch_id"]).select("SOURCE_ROWS")

    def staged(tables, p):
        stacked = None
        for name in ENTITIES:
            one = batch_of(tables, name, p["batch_id"]).select("BATCH_ID")
            stacked = one if stacked is None else stacked.unionByName(one)
        return stacked.agg(F.count(F.lit(1)).alias("STAGED_ROWS"))

    columns = ("CLAIM_ID", "POLICY_ID", "CUSTOMER_ID", "CLAIM_DATE", "CLAIM_AMOUNT",
               "APPROVED_AMOUNT", "CLAIM_STATUS", "INCIDENT_TYPE")
    return [
        Rule("File-to-stage row count reconciliation", COUNTS, source=recorded, target=staged,
             entity="All", severity="High", **about),
        Rule("Claims landing file vs staging", COMPARE, keys=("CLAIM_ID",),
             source=lambda t, p: t["CLAIMS"].select(*columns),
             target=lambda t, p: keyed_batch_of(t, "STG_CLAIM", p["batch_id"]).select(*columns),
             entity="Claim", severity="High", scope="SOURCE_TO_TARGET",
             source_name="flatfile", **about),
        _rows("Policy ID is mandatory", lambda s: blank_key(s, "POLICY_ID"), "STG_POLICY",
              entity="Policy", severity="Critical", **about),
        _rows("Duplicate policy check", lambda s: repeated_key(s, "POLICY_ID"), "STG_POLICY", read=keyed_batch_of,
              entity="Policy", severity="Critical", **about),
        Rule("Claim references an existing policy", NO_ROWS,
             check=lambda t, p: _unknown(_unknown_policies(t, p)),
             entity="Claim", severity="Critical", **about),
        _rows("Approved amount within claim amount", approved_out_of_range, "STG_CLAIM",
              entity="Claim", severity="High", **about),
    ]


def _transformation() -> list[Rule]:
    about = {"folder": "/Transformation", "layer": "Transformation"}
    return [
        _rows("Policy type decode", partial(wrong_type_decode, same=("POLICY_ID",)), "STG_POLICY", "TRN_POLICY",
              read=keyed_batch_of,
              entity="Policy", severity="High", **about),
        _rows("Policy term validity", invalid_term, "TRN_POLICY",
              entity="Policy", severity="High", **about),
        _rows("Claim ratio derivation", partial(wrong_ratio, same=("CLAIM_ID",)), "STG_CLAIM", "TRN_CLAIM",
              read=keyed_batch_of,
              entity="Claim", severity="High", **about),
        _rows("Email standardisation", nonstandard_email, "TRN_CUSTOMER",
              entity="Customer", severity="Medium", **about),
    ]


def _once(t: Mapping, what: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """Rows that several checks, or several parts of one, look at: kept for the run where there is one."""
    return t.once(what, make) if hasattr(t, "once") else make()


def _touched(t: Mapping, p: Mapping) -> DataFrame:
    return _once(t, ("touched customers", p["batch_id"]), lambda: touched_customers(
        t, lambda name: batch_of(t, name, p["batch_id"])).distinct())


def _claims_near(t: Mapping, p: Mapping) -> DataFrame:
    """
    Curated claims among which a check finds its batch's. In a run they are those that the batch staged or
    transformed, found once for all checks; else the whole table, which the check's own link goes through anyway.
    """
    def found() -> DataFrame:
        batches = [keyed_batch_of(t, name, p["batch_id"]) for name in ("TRN_CLAIM", "STG_CLAIM")]
        return linked(t["CLAIM_MASTER"].drop("LAST_UPDATED_TS"), "CLAIM_ID", *batches)  # no check of a batch reads it

    return t.once(("CLAIM_MASTER", p["batch_id"]), found) if hasattr(t, "once") else t["CLAIM_MASTER"]


def _source_to_target() -> list[Rule]:
    about = {"folder": "/Source-to-Target", "layer": "Curated", "scope": "SOURCE_TO_TARGET"}

    def rows_of(name, shape):
        return lambda t, p: shape(keyed_batch_of(t, name, p["batch_id"]))

    def curated(name, scope, key, tidy=lambda c: c):
        def rows(t, p):
            keys = keyed_batch_of(t, scope, p["batch_id"]).select(tidy(F.col(key)).alias(key))
            held = _claims_near(t, p) if name == "CLAIM_MASTER" else t[name]
            return linked(held, key, keys)

        return rows

    def expected_totals(t, p):
        def find() -> DataFrame:
            own = batch_of(t, "TRN_CUSTOMER", p["batch_id"]).select("CUSTOMER_ID")
            known = t["CUSTOMER_360"].select("CUSTOMER_ID").join(_touched(t, p), "CUSTOMER_ID", "left_semi")
            return own.unionByName(known).distinct()

        customers = _once(t, ("known customers", p["batch_id"]), find)
        return with_totals(customers, customer_totals(t["POLICY_MASTER"], t["CLAIM_MASTER"], customers))

    def actual_totals(t, p):
        return t["CUSTOMER_360"].join(_touched(t, p), "CUSTOMER_ID", "left_semi")

    def remapped_claims(t, p):
        if not hasattr(t, "once"):
            policies = (batch_of(t, "STG_POLICY", p["batch_id"]), t["POLICY_MASTER"])
            return mapping.claim_rows(mapping.map_claim(batch_of(t, "STG_CLAIM", p["batch_id"]), *policies))
        # In a run the staged claims lie by their key, and so do the few that are left out; their time is not compared.
        staged = apart(t.keyed("STG_CLAIM", p["batch_id"]), ["CLAIM_ID", "POLICY_ID"], _unknown_policies(t, p))
        return mapping.claim_rows(mapping.map_claim(staged.withColumn("LAST_UPDATED_TS", F.lit(None).cast("timestamp_ntz"))))

    return [
        Rule("Policy transformation vs curated", COMPARE, keys=("POLICY_ID",),
             compare=("POLICY_TYPE", "POLICY_STATUS", "PREMIUM_AMOUNT", "CUSTOMER_ID"),
             source=rows_of("TRN_POLICY", mapping.policy_rows),
             target=curated("POLICY_MASTER", "TRN_POLICY", "POLICY_ID"),
             entity="Policy", severity="Critical", **about),
        Rule("Claim transformation vs curated", COMPARE, keys=("CLAIM_ID",),
             compare=("POLICY_ID", "CLAIM_STATUS", "CLAIM_AMOUNT", "APPROVED_AMOUNT",
                      "CLAIM_RATIO"),
             source=rows_of("TRN_CLAIM", mapping.claim_rows),
             target=curated("CLAIM_MASTER", "TRN_CLAIM", "CLAIM_ID"),
             entity="Claim", severity="Critical", **about),
        Rule("Customer 360 aggregate reconciliation", COMPARE, keys=("CUSTOMER_ID",),
             compare=("TOTAL_PREMIUM", "TOTAL_CLAIMS", "TOTAL_CLAIM_AMOUNT"), tolerance=0.01,
             source=expected_totals, target=actual_totals,
             entity="Customer", severity="High", **about),
        Rule("Policy staging vs curated (mapping rules)", COMPARE, keys=("POLICY_ID",),
             compare=("CUSTOMER_ID", "POLICY_TYPE", "POLICY_STATUS", "PREMIUM_AMOUNT",
                      "ISSUE_DATE", "EXPIRY_DATE"),
             source=rows_of("STG_POLICY", lambda s: mapping.policy_rows(mapping.map_policy(s))),
             target=curated("POLICY_MASTER", "STG_POLICY", "POLICY_ID", F.trim),
             entity="Policy", severity="Critical", **about),
        Rule("Claim staging vs curated (mapping rules)", COMPARE, keys=("CLAIM_ID",),
             compare=("POLICY_ID", "CLAIM_DATE", "CLAIM_STATUS", "CLAIM_AMOUNT",
                      "APPROVED_AMOUNT", "CLAIM_RATIO"),
             source=remapped_claims,
             target=curated("CLAIM_MASTER", "STG_CLAIM", "CLAIM_ID"),
             entity="Claim", severity="Critical", **about),
        Rule("Customer staging vs curated (mapping rules)", COMPARE, keys=("CUSTOMER_ID",),
             compare=("CUSTOMER_NAME", "EMAIL"),
             source=rows_of("STG_CUSTOMER", mapping.map_customer),
             target=curated("CUSTOMER_360", "STG_CUSTOMER", "CUSTOMER_ID", F.trim),
             entity="Customer", severity="High", **about),
    ]


def _linkage() -> list[Rule]:
    about = {"folder": "/Linkage", "layer": "Curated", "entity": "Policy-Claim"}

    def of_batch(t, p):
        return linked(_claims_near(t, p), "CLAIM_ID", keyed_batch_of(t, "TRN_CLAIM", p["batch_id"]))

    def amiss(t, p):
        """In a run: the batch's claims that have no policy or lie outside its days, found together."""
        return t.once(("claims amiss", p["batch_id"]), lambda: with_cover(
            of_batch(t, p), t["POLICY_MASTER"], "left").filter(f"_known IS NULL OR {_OUTSIDE}"))

    def orphans(t, p):
        return _orphans(amiss(t, p).filter("_known IS NULL")) if hasattr(t, "once") else orphan_claims(
            of_batch(t, p), t["POLICY_MASTER"])

    def outside(t, p):
        return _outside(amiss(t, p)) if hasattr(t, "once") else outside_coverage(of_batch(t, p), t["POLICY_MASTER"])

    return [
        Rule("No orphan claims in curated", NO_ROWS, severity="Critical", check=orphans, **about),
        Rule("Claim date inside policy coverage", NO_ROWS, severity="High", check=outside, **about),
    ]


def _incremental() -> list[Rule]:
    about = {"folder": "/Incremental", "scope": "INCREMENTAL"}
    # Names of the three boundary checks.
    names = {
        "STG_POLICY": ("Incremental watermark boundary", "Policy"),
        "STG_CLAIM": ("Incremental claim watermark boundary", "Claim"),
        "STG_CUSTOMER": ("Incremental customer watermark boundary", "Customer"),
    }

    def boundary(stg):
        key, trn, _, process = ENTITIES[stg]
        return lambda t, p: watermark_breach(
            batch_of(t, trn, p["batch_id"]), t["DQ_WATERMARK"], key, process, p["batch_id"]
        )

    out = [
        Rule(name, NO_ROWS, check=boundary(stg), entity=entity, layer="Transformation",
             severity="Critical", **about)
        for stg, (name, entity) in names.items()
    ]
    out.append(Rule(
        "Watermark status report", REPORT, entity="All", layer="Control", severity="Low",
        regression=False, check=lambda t, p: t["DQ_WATERMARK"].orderBy("PROCESS_NAME"), **about,
    ))
    return out


def _historical() -> list[Rule]:
    window = {"history_start": "2026-07-01", "history_end": "2026-12-31"}
    shapes = {
        "STG_POLICY": ("policy", mapping.policy_rows,
                       ("CUSTOMER_ID", "POLICY_TYPE", "POLICY_STATUS", "PREMIUM_AMOUNT")),
        "STG_CLAIM": ("claim", mapping.claim_rows,
                      ("POLICY_ID", "CLAIM_STATUS", "CLAIM_AMOUNT", "APPROVED_AMOUNT")),
        "STG_CUSTOMER": ("customer", mapping.customer_rows, ("CUSTOMER_NAME", "EMAIL")),
    }
    out = []
    for stg, (word, shape, compare) in shapes.items():
        key, trn, curated, _ = ENTITIES[stg]

        def source(t, p, trn=trn, key=key, shape=shape):
            days = (p["history_start"], p["history_end"])
            return shape(latest_in_window(t[trn], key, *days))

        def target(t, p, curated=curated):
            days = (p["history_start"], p["history_end"])
            return t[curated].filter(in_days(F.col("LAST_UPDATED_TS"), *days))

        out.append(Rule(
            f"Historical {word} reconciliation (date range)", COMPARE, folder="/Historical",
            source=source, target=target, keys=(key,), compare=compare, defaults=dict(window),
            scope="HISTORICAL", entity=word.title(), layer="Curated", severity="High",
        ))
    return out
