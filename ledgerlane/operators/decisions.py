"""From candidates to one outcome per record: the cascade, the arithmetic checks, and the exception it amounts to.

The cascade is a chain of joins: records with exact hits never reach the candidate search, and only candidates that
corroborating evidence can't settle reach the verifier.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..schemas import CANDIDATE, CHECK, Policy
from ..scratch import materialize
from . import blocking, scoring, similarity
from .verdicts import HeuristicVerifier, Verifier

# Failing checks by severity of the exception they stand for.
CHECK_EXCEPTIONS = (
    ("currency_match", "CURRENCY_MISMATCH", "HIGH"),
    ("gross_amount_match", "AMOUNT_MISMATCH", "HIGH"),
    ("fee_tax_arithmetic", "FEE_TAX_INCONSISTENT", "HIGH"),
    ("refund_consistency", "REFUND_MISMATCH", "MEDIUM"),
    ("settlement_timing", "SETTLEMENT_DELAYED", "MEDIUM"),
)
UNMATCHED_EXCEPTIONS = {
    "PENDING_SETTLEMENT_WINDOW": ("PENDING_SETTLEMENT", "LOW"),
    "AMBIGUOUS_MULTIPLE": ("AMBIGUOUS_MATCH", "MEDIUM"),
    "SEMANTIC_UNRESOLVED": ("AMBIGUOUS_MATCH", "MEDIUM"),
    "PROVIDER_ERROR": ("PROVIDER_ERROR", "MEDIUM"),
}
MISSING = ("NO_CANDIDATES", "NO_ADMISSIBLE_CANDIDATE", "ALL_CANDIDATES_REJECTED")
HEADLINES = {
    "EXACT_REFERENCE": ("The reference is that of one settlement.", "Nothing to do."),
    "DISAMBIGUATED_BY_AMOUNT": ("Of several settlements with this reference, one has the amount.", "Nothing to do; tell the provider if references repeat often."),
    "CORROBORATED": ("The reference differs, but independent evidence agrees on one settlement.", "Nothing to do."),
    "SEMANTIC_CONFIRMED": ("The verifier confirmed the pairing.", "Nothing to do; check samples if reference formats drift."),
    "NO_CANDIDATES": ("No settlement was found for this record.", "Confirm the capture, then ask the provider for the settlement."),
    "NO_ADMISSIBLE_CANDIDATE": ("None of the records found is evidence of this payment.", "Treat it as missing; the refused records are listed with the reason."),
    "ALL_CANDIDATES_REJECTED": ("Every candidate was judged to be another payment.", "Treat it as missing; look for it under another reference."),
    "AMBIGUOUS_MULTIPLE": ("Several settlements fit and none stands out.", "Choose the settlement, or ask the provider about the duplicate."),
    "SEMANTIC_UNRESOLVED": ("The verifier could neither confirm nor refuse the best candidate.", "Compare the two records."),
    "PENDING_SETTLEMENT_WINDOW": ("The payment is too recent to be settled.", "Run again once the window has passed."),
    "PROVIDER_ERROR": ("The verifier could not be reached.", "Run again, or review by hand."),
}
CHECK_WORDS = {
    "currency_match": "the currencies differ",
    "gross_amount_match": "the gross amount is not the order amount",
    "fee_tax_arithmetic": "the net amount is not gross less fee, tax and refund",
    "settlement_timing": "it was settled late",
    "refund_consistency": "the refunds disagree",
}
MATCHED_ACTIONS = {
    "CURRENCY_MISMATCH": "Hold it and confirm the order's currency.",
    "AMOUNT_MISMATCH": "Compare both amounts with the provider.",
    "FEE_TAX_INCONSISTENT": "Recompute fees and tax for this payment method.",
    "REFUND_MISMATCH": "Compare the refund records of both sides.",
    "SETTLEMENT_DELAYED": "Ask the provider about the delay.",
    "LOW_CONFIDENCE_MATCH": "Confirm the proposed settlement.",
    "DUPLICATE_REFERENCE": "Decide which settlement belongs to the order.",
}


def lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    """A small fixed table as an expression."""
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def check(name: str, ok: Column, expected: Column, observed: Column, good: Column | str, bad: Column | str, warn: bool = False, confidence: Column | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(name).alias("name"), F.when(ok, "PASS").otherwise("WARN" if warn else "FAIL").alias("status"), expected.alias("expected"), observed.alias("observed"),
        F.when(ok, as_column(good)).otherwise(as_column(bad)).alias("detail"), (confidence if confidence is not None else F.lit(None)).cast("double").alias("confidence"),
    ).cast(CHECK)


def financial_flags(policy: Policy) -> dict[str, Column]:
    """Whether each of the five checks of a matched pair passes; ledger columns plain, settlement columns with s_."""
    c = F.col
    tol = policy.amount_tolerance_minor
    net = c("s_gross_amount_minor") - c("s_fee_minor") - c("s_tax_minor") - c("s_refund_amount_minor")
    delay = values.days_between(c("s_order_date"), c("s_settlement_date"))
    refunds = (c("status").isin("refunded", "partially_refunded") == (c("s_refund_amount_minor") > 0)) & values.amounts_match(c("refund_amount_minor"), c("s_refund_amount_minor"), tol)
    passes = {
        "currency_match": F.upper(c("currency")) == F.upper(c("s_currency")), "gross_amount_match": values.amounts_match(c("amount_minor"), c("s_gross_amount_minor"), tol),
        "fee_tax_arithmetic": values.amounts_match(c("s_net_amount_minor"), net, tol), "settlement_timing": delay <= policy.max_settlement_delay_days, "refund_consistency": refunds,
    }
    return {name: F.coalesce(ok, F.lit(False)) for name, ok in passes.items()}


def financial_checks(policy: Policy, passes: dict[str, Column]) -> Column:
    """The five checks of a matched pair, from whether they pass."""
    c = F.col
    text_of = lambda x: x.cast("string")
    ours, theirs = F.upper(c("currency")), F.upper(c("s_currency"))
    net = c("s_gross_amount_minor") - c("s_fee_minor") - c("s_tax_minor") - c("s_refund_amount_minor")
    delay = values.days_between(c("s_order_date"), c("s_settlement_date"))
    return F.array(
        check("currency_match", passes["currency_match"], ours, theirs, "one currency", F.concat(ours, F.lit(" against "), theirs)),
        check("gross_amount_match", passes["gross_amount_match"], text_of(c("amount_minor")), text_of(c("s_gross_amount_minor")), "the amounts agree", F.concat(F.lit("ordered "), text_of(c("amount_minor")), F.lit(", settled "), text_of(c("s_gross_amount_minor")))),
        check("fee_tax_arithmetic", passes["fee_tax_arithmetic"], text_of(net), text_of(c("s_net_amount_minor")), "net follows from gross, fee, tax and refund", F.concat(F.lit("net should be "), text_of(net))),
        check("settlement_timing", passes["settlement_timing"], F.lit(f"<= {policy.max_settlement_delay_days} days"), F.concat(text_of(delay), F.lit(" days")), "settled in time", F.concat(F.lit("took "), text_of(delay), F.lit(" days"))),
        check("refund_consistency", passes["refund_consistency"], text_of(c("refund_amount_minor")), text_of(c("s_refund_amount_minor")), "the refunds agree", "refund state or amount differs"),
    )


def assessment() -> Column:
    """A scored pair (with s_ columns of its settlement) as a stored candidate."""
    c = F.col
    return F.struct(
        c("s_payment_id").alias("payment_id"), c("s_order_reference").alias("order_reference"), c("s_gross_amount_minor").alias("gross_amount_minor"), c("s_settlement_date").alias("settlement_date"),
        scoring.supporting_signals().alias("supporting_signals"), scoring.contradicting_signals().alias("contradicting_signals"), F.round("score", 4).alias("evidence_score"),
        c("admissible"), c("admissibility_reason"), c("verdict").alias("semantic_verdict"), c("confidence").alias("semantic_confidence"),
    ).cast(CANDIDATE)


@dataclass
class Prepared:
    """Both populations with derived columns, and the token statistics of the settlements."""

    ledger: DataFrame
    settlements: DataFrame
    frequencies: DataFrame
    documents: int


def prepare(ledger: DataFrame, settlements: DataFrame) -> Prepared:
    """``ledger`` needs record_id and seq, ``settlements`` pop_seq, beside their canonical columns."""
    left, right = blocking.prepare_ledger(ledger), blocking.prepare_settlements(settlements)
    return Prepared(left, right, similarity.token_frequencies(right), right.count())


def scored_shortlist(data: Prepared, records: DataFrame, policy: Policy) -> DataFrame:
    """The scored shortlist of ``records`` (prepared ledger rows)."""
    # Both sides are read many times, by every source of candidates and by what scores them, so what these need is made once.
    wanted = ("order_date", "order_day", "cores", "ref_cores", "tokens")
    records = materialize(records.select("seq", "amount_minor", *wanted), "searched-records")
    settlements = materialize(data.settlements.select("pop_seq", "payment_id", "gross_amount_minor", *wanted), "searched-settlements")
    frequencies = materialize(data.frequencies, "token-frequencies")
    left = materialize(similarity.attach(records, "seq", frequencies, data.documents), "weighed-records")
    right = materialize(similarity.attach(settlements, "pop_seq", frequencies, data.documents).drop("weights"), "weighed-settlements")
    pool = scoring.promising_pool(blocking.candidate_pool(left, right, policy, promising=True), left, right, policy)
    # A few rows for each record: all that follows starts from this table instead of from the search.
    listed = materialize(scoring.rank_by_score(pool, left, right, policy), "shortlist")
    return scoring.pair_signals(scoring.join_pairs(listed, left, right), policy)


def judgeable(data: Prepared, records: DataFrame, policy: Policy) -> DataFrame:
    """The scored shortlist of ``records`` with the settlements' columns, as a table: the settled, the judged and the refused are each taken from it."""
    listed = scored_shortlist(data, records, policy).drop("l_weights", "l_cores", "l_ref_cores", "s_cores", "s_ref_cores")
    return materialize(listed.join(_settlement_columns(data.settlements).drop("s_gross_amount_minor", "s_order_date"), "pop_seq"), "judgeable")


def resolve_shortlist(listed: DataFrame, policy: Policy, verifier: Verifier) -> DataFrame:
    """seq, classification, pop_seq (or null), ai_* and considered: what the shortlist of each record amounts to."""
    c = F.col
    ranked = listed.withColumn("n_admissible", F.sum(c("admissible").cast("int")).over(Window.partitionBy("seq")))
    by_rank = Window.partitionBy("seq").orderBy("position")
    good = ranked.filter("admissible").withColumns({"place_admissible": F.row_number().over(by_rank), "runner_up": F.lead("score", 1, 0.0).over(by_rank)})
    settled = (
        (c("place_admissible") == 1) & (scoring.corroborating_count() >= 2) & (c("score") >= policy.deterministic_match_score)
        & (c("similarity") >= policy.deterministic_min_text_similarity)
        & (F.rint((c("score") - c("runner_up")) * scoring.GRAIN) >= round(policy.deterministic_match_margin * scoring.GRAIN))
    )
    good = good.withColumn("settled", F.max(settled).over(Window.partitionBy("seq")))
    asked = good.filter(~c("settled") & (c("place_admissible") <= policy.max_semantic_calls_per_record))
    blank = {"verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "backend": F.lit(None).cast("string")}
    if policy.enable_semantic_matching:
        judged = verifier.annotate(asked)
        # The walk stops at the first verdict other than DIFFERENT.
        stop = F.min(F.when(c("verdict") != "DIFFERENT", c("place_admissible"))).over(Window.partitionBy("seq"))
        judged = judged.withColumn("stop", stop).filter(c("stop").isNull() | (c("place_admissible") <= c("stop")))
    else:
        judged = asked.withColumns(blank).withColumn("stop", F.lit(None).cast("int"))
    kept = [x for x in judged.columns if x not in ("l_weights",)]
    rest = good.filter("settled").withColumns(blank).withColumn("stop", F.lit(None).cast("int"))
    none = ranked.filter("n_admissible = 0").withColumns({"place_admissible": c("position"), "runner_up": F.lit(0.0), "settled": F.lit(False), "stop": F.lit(None).cast("int")}).withColumns(blank)
    rows = judged.select(*kept).unionByName(rest.select(*kept)).unionByName(none.select(*kept))
    last = F.max_by(F.struct("verdict", "confidence", "backend", "pop_seq"), "place_admissible")
    found = rows.groupBy("seq").agg(
        F.first("settled").alias("settled"), F.first("n_admissible").alias("n_admissible"), last.alias("last"), F.min_by("pop_seq", "place_admissible").alias("top_pop_seq"),
        F.count("verdict").cast("int").alias("ai_calls"), F.array_sort(F.collect_list(F.struct("place_admissible", assessment().alias("a")))).alias("considered"),
    )
    verdict = c("last.verdict")
    classification = (
        F.when(c("n_admissible") == 0, "NO_ADMISSIBLE_CANDIDATE").when(c("settled"), "CORROBORATED").when(verdict == "SAME", "SEMANTIC_CONFIRMED")
        .when(verdict == "AMBIGUOUS", "SEMANTIC_UNRESOLVED").when(verdict == "ERROR", "PROVIDER_ERROR").otherwise("ALL_CANDIDATES_REJECTED")
    )
    return found.select(
        "seq", classification.alias("classification"), F.when(c("settled"), c("top_pop_seq")).when(verdict == "SAME", c("last.pop_seq")).alias("pop_seq"), "ai_calls",
        (c("ai_calls") > 0).alias("ai_invoked"), F.when(verdict != "ERROR", c("last.confidence")).alias("ai_confidence"), c("last.backend").alias("ai_backend"),
        F.transform("considered", lambda x: x.a).alias("considered_candidates"),
    )


def _settlement_columns(settlements: DataFrame) -> DataFrame:
    names = ("payment_id", "order_reference", "gross_amount_minor", "fee_minor", "tax_minor", "refund_amount_minor", "net_amount_minor", "order_date", "settlement_date", "currency")
    return settlements.select("pop_seq", *[F.col(n).alias(f"s_{n}") for n in names])


def resolve(data: Prepared, policy: Policy, verifier: Verifier, shortlists: DataFrame | None = None) -> DataFrame:
    """seq, classification, pop_seq, n_exact and ai_*: exact hits first, the candidate search (or the ``shortlists`` of one) for what has none."""
    c = F.col
    exact = blocking.exact_summary(data.ledger, data.settlements, policy)
    state = data.ledger.select("seq").join(exact, "seq", "left").withColumn("n_exact", F.coalesce("n_exact", F.lit(0)))
    empty = {"ai_calls": F.lit(0), "ai_invoked": F.lit(False), "ai_confidence": F.lit(None).cast("double"), "ai_backend": F.lit(None).cast("string"), "considered_candidates": F.lit(None).cast(f"array<{CANDIDATE}>")}
    direct = F.when(c("n_exact") == 1, "EXACT_REFERENCE").when(c("n_within") == 1, "DISAMBIGUATED_BY_AMOUNT").otherwise("AMBIGUOUS_MULTIPLE")
    done = state.filter("n_exact > 0").select("seq", "n_exact", direct.alias("classification"), c("exact_pop_seq").alias("pop_seq")).withColumns(empty)
    rest = state.filter("n_exact = 0").select("seq", "n_exact")
    if policy.enable_fuzzy_matching:
        records = data.ledger.join(rest.select("seq"), "seq", "left_semi")
        listed = judgeable(data, records, policy) if shortlists is None else shortlists
        found = resolve_shortlist(listed, policy, verifier)
        rest = rest.join(found, "seq", "left").withColumns({"classification": F.coalesce("classification", F.lit("NO_CANDIDATES")), "ai_calls": F.coalesce("ai_calls", F.lit(0)), "ai_invoked": F.coalesce("ai_invoked", F.lit(False))})
    else:
        rest = rest.withColumns({"classification": F.lit("NO_CANDIDATES"), "pop_seq": F.lit(None).cast("bigint"), **empty})
    return done.unionByName(rest)


def decide(data: Prepared, policy: Policy = Policy(), verifier: Verifier | None = None, as_of: object = None, shortlists: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """One result row per record. ``as_of`` defaults to the last settlement date."""
    c = F.col
    resolved = resolve(data, policy, verifier or HeuristicVerifier(), shortlists)
    rows = data.ledger.drop("ref_norm", "cores", "ref_cores", "tokens").join(resolved, "seq").join(_settlement_columns(data.settlements), "pop_seq", "left")
    moment = data.settlements.agg(F.max("settlement_date").alias("as_of")) if as_of is None else data.settlements.sparkSession.range(1).select(F.lit(as_of).cast("timestamp").alias("as_of"))
    rows = rows.join(F.broadcast(moment), how="cross")  # one row
    matched = c("pop_seq").isNotNull()
    due = c("order_date") + F.expr(f"INTERVAL {policy.settlement_expected_days} DAYS")
    pending = ~matched & c("classification").isin(*MISSING) & F.coalesce(c("as_of") < due, F.lit(False))
    rows = rows.withColumn("classification", F.when(pending, "PENDING_SETTLEMENT_WINDOW").otherwise(c("classification")))
    confident = c("ai_confidence").isNull() | (c("ai_confidence") >= policy.ai_confidence_threshold)
    hits = c("n_exact").cast("string")
    kind = c("classification")
    yes, no = F.lit(True), F.lit(False)
    first = (
        F.when(kind == "EXACT_REFERENCE", check("reference_match", yes, F.lit("1 candidate"), F.lit("1 candidate"), "the references agree", ""))
        .when(kind == "DISAMBIGUATED_BY_AMOUNT", check("reference_match", yes, F.lit("one by amount"), c("s_payment_id"), F.concat(hits, F.lit(" settlements have this reference, one the amount")), ""))
        .when(kind == "AMBIGUOUS_MULTIPLE", check("duplicate_reference", no, F.lit("one candidate"), F.concat(hits, F.lit(" candidates")), "", F.concat(hits, F.lit(" settlements have this reference and the amount decides nothing")), warn=True))
        .when(kind == "CORROBORATED", check("reference_match", yes, F.lit("corroborating evidence"), c("s_payment_id"), "independent evidence agrees", ""))
        .when(kind == "SEMANTIC_CONFIRMED", check("reference_match", confident, F.lit(f">= {policy.ai_confidence_threshold} confidence"), c("ai_confidence").cast("string"), "confirmed by the verifier", "confirmed, but without enough confidence", warn=True, confidence=c("ai_confidence")))
        .when(kind == "SEMANTIC_UNRESOLVED", check("reference_match", no, F.lit("SAME"), F.lit("AMBIGUOUS"), "", "the verifier can't tell", warn=True, confidence=c("ai_confidence")))
        .when(kind == "PROVIDER_ERROR", check("reference_match", no, F.lit("a verdict"), F.lit("an error"), "", "the verifier failed", warn=True))
        .when(kind == "PENDING_SETTLEMENT_WINDOW", check("settlement_presence", yes, F.concat(F.lit("due "), F.to_date(due).cast("string")), F.lit("not yet due"), "no settlement is due yet", ""))
        .otherwise(check("settlement_presence", no, F.lit("1 settlement"), F.lit("none"), "", lookup({k: v[0] for k, v in HEADLINES.items()}, kind)))
    )
    # What passes is known from plain columns; lists of checks are only looked through where one fails.
    rows = rows.withColumns({"_first": first, **{f"_ok_{name}": ~matched | ok for name, ok in financial_flags(policy).items()}})
    passes = {name: c(f"_ok_{name}") for name, _, _ in CHECK_EXCEPTIONS}
    rows = rows.withColumn("checks", F.when(matched, F.concat(F.array("_first"), financial_checks(policy, passes))).otherwise(F.array("_first")))
    any_failing = (c("_first.status") == "FAIL") | ~reduce(Column.__and__, passes.values())
    any_warning = c("_first.status") == "WARN"
    unsure = any_warning & (c("_first.name") == "reference_match")
    failing = F.filter("checks", lambda x: x.status == "FAIL")
    warning = F.filter("checks", lambda x: x.status == "WARN")
    said = lambda found: F.array_join(F.transform(found, lambda x: F.concat(x["name"], F.lit(": "), x.detail)), "; ")
    outcome = (
        F.when(matched & any_failing, "EXCEPTION").when(matched & any_warning, "HUMAN_REVIEW").when(matched, "RECONCILED")
        .when(kind.isin("AMBIGUOUS_MULTIPLE", "SEMANTIC_UNRESOLVED", "PROVIDER_ERROR"), "HUMAN_REVIEW").otherwise("EXCEPTION")
    )
    typed, graded = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for name, exception, severity in CHECK_EXCEPTIONS:
        typed, graded = typed.when(matched & ~passes[name], exception), graded.when(matched & ~passes[name], severity)
    typed = typed.when(matched & unsure, "LOW_CONFIDENCE_MATCH").when(~matched, lookup({k: v[0] for k, v in UNMATCHED_EXCEPTIONS.items()}, kind, "MISSING_SETTLEMENT"))
    graded = graded.when(matched & unsure, "MEDIUM").when(~matched, lookup({k: v[1] for k, v in UNMATCHED_EXCEPTIONS.items()}, kind, "HIGH"))
    words = F.transform(failing, lambda x: lookup(CHECK_WORDS, x["name"], ""))
    headline = lookup({k: v[0] for k, v in HEADLINES.items()}, kind, "This record could not be resolved.")
    refused = F.when((kind == "NO_ADMISSIBLE_CANDIDATE") & (F.size("considered_candidates") > 0), F.concat(F.lit(" The closest, "), F.try_element_at("considered_candidates", F.lit(1)).payment_id, F.lit(", was refused: "), F.try_element_at("considered_candidates", F.lit(1)).admissibility_reason, F.lit(".")))
    explanation = (
        F.when(matched & any_failing, F.concat(F.lit("A settlement was matched, but "), text.join_words(words, ", and "), F.lit(".")))
        .when(matched & any_warning, F.lit("A settlement was matched without enough confidence."))
        .otherwise(F.concat(headline, F.coalesce(refused, F.lit(""))))
    )
    rows = rows.withColumns(
        {
            "outcome": outcome, "exception_type": typed, "severity": graded, "explanation": explanation,
            "reason": F.when(matched & any_failing, said(failing)).when(matched & any_warning, said(warning)).when(matched, "all checks passed").otherwise(F.element_at("checks", 1).detail),
        }
    )
    action = F.when(matched & c("exception_type").isNotNull(), lookup(MATCHED_ACTIONS, c("exception_type"), "Review this record.")).otherwise(lookup({k: v[1] for k, v in HEADLINES.items()}, kind, "Review this record."))
    return rows.select(
        *data.ledger.drop("ref_norm", "cores", "ref_cores", "tokens").columns, "outcome", "reason", "checks", "classification", "exception_type", "severity", "explanation", action.alias("recommended_action"),
        F.coalesce("considered_candidates", F.lit(None).cast(f"array<{CANDIDATE}>")).alias("considered_candidates"), c("s_payment_id").alias("matched_payment_id"), c("n_exact").cast("int").alias("candidate_count"),
        "ai_invoked", "ai_calls", "ai_confidence", "ai_backend", F.lit(policy.ai_confidence_threshold).alias("policy_threshold"), F.lit(None).cast("double").alias("latency_ms"),
    )


#: What of a policy decides which candidates are found, and what is known of them.
SEARCH = (
    "amount_tolerance_minor", "candidate_search_window_days", "max_window_scan_candidates", "candidate_shortlist_size", "require_identity_evidence", "admissible_text_similarity", "treat_reference_contradiction_as_negative",
)


def decide_under(data: Prepared, policies: dict[str, Policy], verifier: Verifier | None = None, as_of: object = None) -> DataFrame:
    """The decisions of all records under several policies, with ``policy``: candidates are searched for once, and one plan decides.

    The policies may differ in tiers, thresholds and checks, but not in what the search depends on (``SEARCH``).
    """
    searching = [p for p in policies.values() if p.enable_fuzzy_matching]
    if len({tuple(getattr(p, n) for n in SEARCH) for p in searching}) > 1:
        raise ValueError("policies that search differently need searches of their own")
    found = None
    if searching:
        exact = blocking.exact_hits(data.ledger, data.settlements).select("seq").distinct()
        found = judgeable(data, data.ledger.join(exact, "seq", "left_anti"), searching[0])
    out = None
    for name, policy in policies.items():
        rows = decide(data, policy, verifier, as_of, found if policy.enable_fuzzy_matching else None).withColumn("policy", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
