"""Record layouts (as DDL), code lists and the policy of a reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

LEDGER = (
    "order_id string, reference_id string, amount_minor bigint, currency string, order_date timestamp, "
    "status string, refund_amount_minor bigint, description string"
)
SETTLEMENT = (
    "payment_id string, order_reference string, settlement_id string, gross_amount_minor bigint, fee_minor bigint, "
    "tax_minor bigint, refund_amount_minor bigint, net_amount_minor bigint, order_date timestamp, "
    "settlement_date timestamp, currency string, status string, description string"
)
CHECK = "struct<name:string,status:string,expected:string,observed:string,detail:string,confidence:double>"
CANDIDATE = (
    "struct<payment_id:string,order_reference:string,gross_amount_minor:bigint,settlement_date:timestamp,supporting_signals:array<string>,"
    "contradicting_signals:array<string>,evidence_score:double,admissible:boolean,admissibility_reason:string,semantic_verdict:string,semantic_confidence:double>"
)

# The codes of outcomes, classifications, exceptions, severities and review states.
OUTCOMES = ("RECONCILED", "EXCEPTION", "HUMAN_REVIEW")
CLASSIFICATIONS = (
    "EXACT_REFERENCE", "DISAMBIGUATED_BY_AMOUNT", "CORROBORATED", "SEMANTIC_CONFIRMED", "NO_CANDIDATES", "NO_ADMISSIBLE_CANDIDATE",
    "ALL_CANDIDATES_REJECTED", "AMBIGUOUS_MULTIPLE", "SEMANTIC_UNRESOLVED", "PENDING_SETTLEMENT_WINDOW", "PROVIDER_ERROR",
)
EXCEPTIONS = (
    "MISSING_SETTLEMENT", "PENDING_SETTLEMENT", "AMOUNT_MISMATCH", "CURRENCY_MISMATCH", "FEE_TAX_INCONSISTENT", "REFUND_MISMATCH", "SETTLEMENT_DELAYED",
    "LOW_CONFIDENCE_MATCH", "DUPLICATE_REFERENCE", "AMBIGUOUS_MATCH", "DUPLICATE_CLAIM", "AGGREGATED_SETTLEMENT", "PROVIDER_ERROR", "PROCESSING_ERROR",
)
SEVERITIES = ("HIGH", "MEDIUM", "LOW")
EVIDENCE_TIER = {"EXACT_REFERENCE": 4, "DISAMBIGUATED_BY_AMOUNT": 3, "CORROBORATED": 2, "SEMANTIC_CONFIRMED": 1}


@dataclass(frozen=True)
class Policy:
    """Thresholds of a run; they become literals of the plan."""

    amount_tolerance_minor: int = 2
    max_settlement_delay_days: int = 21
    ai_confidence_threshold: float = 0.85
    candidate_search_window_days: int = 21
    max_window_scan_candidates: int = 400
    candidate_shortlist_size: int = 5
    deterministic_match_score: float = 0.70
    deterministic_min_text_similarity: float = 0.25
    deterministic_match_margin: float = 0.10
    max_semantic_calls_per_record: int = 3
    require_identity_evidence: bool = True
    admissible_text_similarity: float = 0.20
    treat_reference_contradiction_as_negative: bool = True
    max_aggregation_candidates: int = 40
    settlement_expected_days: int = 2
    enable_fuzzy_matching: bool = True
    enable_semantic_matching: bool = True
