"""The reconciliation as plain SQL, step by step, to hold the Spark plans against. ``sql(step, select)`` closes the chain."""

from __future__ import annotations

from .population import base_sql, ledger_sql, settlements_sql

_TOKENS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> ''))"
_NORM = "regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]', '', 'g')"
_CORES = "regexp_extract_all(coalesce({0}, ''), '[0-9]{{4,}}')"
_DAYS = "CAST(abs(floor((epoch_us({1}) - epoch_us({0})) / 86400000000.0)) AS INTEGER)"


def tokens(c: str) -> str:
    return _TOKENS.format(c)


def norm(c: str) -> str:
    return _NORM.format(c)


def cores(*names: str) -> str:
    found = [_CORES.format(c) for c in names]
    return f"list_distinct({found[0] if len(found) == 1 else 'list_concat(' + ', '.join(found) + ')'})"


def days(a: str, b: str) -> str:
    return _DAYS.format(a, b)


_BASE_SCORE = (
    f"0.45 * CASE WHEN exact THEN 1.0::DOUBLE WHEN amount_minor > 0 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - least(abs(gross - amount_minor) / amount_minor::DOUBLE, 1.0::DOUBLE) * 2.0::DOUBLE) ELSE 0.0::DOUBLE END"
    " + 0.25::DOUBLE * CAST(shared_core AS INTEGER)::DOUBLE + 0.10::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - apart / 21.0::DOUBLE)"
)

STEPS: dict[str, str] = {
    "base": base_sql(),
    "ledger": ledger_sql("duckdb"),
    "settlements": settlements_sql("duckdb"),
    "lp": f"SELECT *, {norm('reference_id')} AS ref_norm, {cores('reference_id', 'description')} AS cores, {cores('reference_id')} AS ref_cores, CAST(order_date AS DATE) AS order_day, {tokens('description')} AS tokens FROM ledger",
    "sp": f"SELECT *, {norm('order_reference')} AS ref_norm, {cores('order_reference', 'description')} AS cores, {cores('order_reference')} AS ref_cores, CAST(order_date AS DATE) AS order_day, {tokens('description')} AS tokens FROM settlements",
    "df": "SELECT token, count(*) AS df FROM (SELECT unnest(tokens) AS token FROM sp) GROUP BY token",
    "exact": "SELECT l.seq, count(*) AS n_exact, count(*) FILTER (abs(l.amount_minor - s.gross_amount_minor) <= 2) AS n_within, min(s.pop_seq) AS only_hit, min(s.pop_seq) FILTER (abs(l.amount_minor - s.gross_amount_minor) <= 2) AS within_hit FROM lp l JOIN sp s ON l.ref_norm = s.ref_norm WHERE l.ref_norm <> '' GROUP BY l.seq",
    "rec": "SELECT * FROM lp WHERE seq NOT IN (SELECT seq FROM exact)",
    "amount_hits": "SELECT r.seq, s.pop_seq FROM rec r JOIN sp s ON s.gross_amount_minor = r.amount_minor",
    "core_hits": "SELECT DISTINCT r.seq, s.pop_seq FROM (SELECT seq, unnest(cores) AS core FROM rec) r JOIN (SELECT pop_seq, unnest(cores) AS core FROM sp) s ON r.core = s.core",
    "window_hits": "SELECT * FROM (SELECT r.seq, s.pop_seq, row_number() OVER (PARTITION BY r.seq ORDER BY abs(s.order_day - r.order_day), s.order_day, s.pop_seq) AS place FROM rec r JOIN sp s ON s.order_day BETWEEN r.order_day - 21 AND r.order_day + 21) WHERE place <= 400",
    "pool": "SELECT seq, pop_seq, min(key) // 1000 AS source, min(key) % 1000 AS place, bool_or(key = 1000) AS has_core FROM (SELECT seq, pop_seq, 0 AS key FROM amount_hits UNION ALL SELECT seq, pop_seq, 1000 FROM core_hits UNION ALL SELECT seq, pop_seq, 2000 + place FROM window_hits) GROUP BY seq, pop_seq",
    "plausible": "SELECT * FROM (SELECT *, max(ok) OVER (PARTITION BY seq) AS any_ok FROM (SELECT p.*, CAST(r.amount_minor <= 0 OR s.gross_amount_minor / r.amount_minor::DOUBLE BETWEEN 0.5 AND 2.0 AS INTEGER) AS ok FROM pool p JOIN rec r USING (seq) JOIN sp s USING (pop_seq))) WHERE ok = 1 OR any_ok = 0",
    "idf": "SELECT token, ln(((SELECT count(*) FROM sp) + 1)::DOUBLE / (df + 1)::DOUBLE) + 1.0 AS w FROM df",
    "lt": "SELECT t.seq, t.token, coalesce(i.w, ln(((SELECT count(*) FROM sp) + 1)::DOUBLE / 1.0) + 1.0) AS w FROM (SELECT seq, unnest(tokens) AS token FROM rec) t LEFT JOIN idf i USING (token)",
    "st": "SELECT t.pop_seq, t.token, i.w FROM (SELECT pop_seq, unnest(tokens) AS token FROM sp) t JOIN idf i USING (token)",
    "ltot": "SELECT seq, sum(w) AS w FROM lt GROUP BY seq",
    "stot": "SELECT pop_seq, sum(w) AS w FROM st GROUP BY pop_seq",
    "common": "SELECT p.seq, p.pop_seq, sum(l.w) AS w FROM plausible p JOIN lt l ON l.seq = p.seq JOIN st s ON s.pop_seq = p.pop_seq AND s.token = l.token GROUP BY p.seq, p.pop_seq",
    "pairs": f"""SELECT p.seq, p.pop_seq, p.source, p.place, r.amount_minor, s.gross_amount_minor AS gross, abs(s.gross_amount_minor - r.amount_minor) <= 2 AS exact, p.has_core AS shared_core,
        {days('r.order_date', 's.order_date')} AS apart, CASE WHEN len(r.tokens) = 0 AND len(s.tokens) = 0 THEN 1.0 WHEN coalesce(a.w, 0) + coalesce(b.w, 0) - coalesce(c.w, 0) <= 0 THEN 0.0 ELSE coalesce(c.w, 0.0) / (coalesce(a.w, 0) + coalesce(b.w, 0) - coalesce(c.w, 0)) END AS similarity,
        len(r.ref_cores) > 0 AND len(s.ref_cores) > 0 AND list_has_any(list_transform(r.ref_cores, lambda x: length(x)), list_transform(s.ref_cores, lambda x: length(x))) AS comparable,
        list_has_any(r.ref_cores, s.ref_cores) AS same_ref, r.tokens AS l_tokens, s.tokens AS s_tokens
        FROM plausible p JOIN rec r USING (seq) JOIN sp s USING (pop_seq) LEFT JOIN ltot a USING (seq) LEFT JOIN stot b USING (pop_seq) LEFT JOIN common c USING (seq, pop_seq)""",
    "scored": f"SELECT *, round_even(({_BASE_SCORE} + 0.20::DOUBLE * similarity) * 1000000000, 0) / 1000000000 AS score, comparable AND NOT same_ref AS contradiction, apart <= 21 AS in_window FROM pairs",
    "listed": """SELECT *, CASE WHEN contradiction THEN false WHEN NOT in_window THEN false WHEN shared_core THEN true WHEN similarity >= 0.20 THEN true WHEN exact AND NOT comparable THEN true ELSE false END AS admissible
        FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, source, place, pop_seq) AS position FROM scored) WHERE position <= 5""",
    "good": "SELECT *, row_number() OVER w AS nth, lead(score, 1, 0.0) OVER w AS runner_up FROM listed WHERE admissible WINDOW w AS (PARTITION BY seq ORDER BY position)",
    "settled": "SELECT seq, pop_seq FROM good WHERE nth = 1 AND exact::INTEGER + shared_core::INTEGER + (apart <= 3)::INTEGER >= 2 AND score >= 0.70 AND similarity >= 0.25 AND round_even((score - runner_up) * 1000000000, 0) >= 100000000",
    "judged": """SELECT *, CASE WHEN (j >= 0.6 AND close AND apart <= 21) OR (shared_core AND close) THEN 'SAME' WHEN j < 0.15 OR NOT close THEN 'DIFFERENT' ELSE 'AMBIGUOUS' END AS verdict,
        CASE WHEN j >= 0.6 AND close AND apart <= 21 THEN round_even(least(0.75, j), 2) WHEN shared_core AND close THEN 0.7 WHEN j < 0.15 OR NOT close THEN round_even(1 - j, 2) ELSE round_even(j, 2) END AS confidence
        FROM (SELECT *, exact OR abs(gross - amount_minor) <= greatest(2, floor(amount_minor * 0.02)) AS close, CASE WHEN len(list_distinct(list_concat(l_tokens, s_tokens))) = 0 THEN 1.0 ELSE len(list_intersect(l_tokens, s_tokens)) / len(list_distinct(list_concat(l_tokens, s_tokens)))::DOUBLE END AS j
              FROM good WHERE nth <= 3 AND seq NOT IN (SELECT seq FROM settled))""",
    "walk": "SELECT seq, max(nth) AS calls, arg_max(verdict, nth) AS verdict, arg_max(confidence, nth) AS confidence, arg_max(pop_seq, nth) AS pop_seq FROM (SELECT *, min(CASE WHEN verdict <> 'DIFFERENT' THEN nth END) OVER (PARTITION BY seq) AS stop FROM judged) WHERE stop IS NULL OR nth <= stop GROUP BY seq",
    "fuzzy": """SELECT r.seq, CASE WHEN l.seq IS NULL THEN 'NO_CANDIDATES' WHEN l.n = 0 THEN 'NO_ADMISSIBLE_CANDIDATE' WHEN t.seq IS NOT NULL THEN 'CORROBORATED' WHEN w.verdict = 'SAME' THEN 'SEMANTIC_CONFIRMED' WHEN w.verdict = 'AMBIGUOUS' THEN 'SEMANTIC_UNRESOLVED' ELSE 'ALL_CANDIDATES_REJECTED' END AS classification,
        CASE WHEN t.seq IS NOT NULL THEN t.pop_seq WHEN w.verdict = 'SAME' THEN w.pop_seq END AS pop_seq, coalesce(w.calls, 0) AS ai_calls, w.confidence AS ai_confidence
        FROM rec r LEFT JOIN (SELECT seq, count(*) FILTER (admissible) AS n FROM listed GROUP BY seq) l USING (seq) LEFT JOIN settled t USING (seq) LEFT JOIN walk w USING (seq)""",
    "resolved": """SELECT seq, n_exact, CASE WHEN n_exact = 1 THEN 'EXACT_REFERENCE' WHEN n_within = 1 THEN 'DISAMBIGUATED_BY_AMOUNT' ELSE 'AMBIGUOUS_MULTIPLE' END AS classification, CASE WHEN n_exact = 1 THEN only_hit WHEN n_within = 1 THEN within_hit END AS pop_seq, 0 AS ai_calls, NULL::DOUBLE AS ai_confidence FROM exact
        UNION ALL SELECT seq, 0, classification, pop_seq, ai_calls, ai_confidence FROM fuzzy""",
    "checked": f"""SELECT l.*, v.n_exact, v.pop_seq, v.ai_calls, v.ai_confidence, s.payment_id, s.gross_amount_minor AS s_gross, s.settlement_date AS s_settled,
        CASE WHEN v.pop_seq IS NULL AND v.classification IN ('NO_CANDIDATES', 'NO_ADMISSIBLE_CANDIDATE', 'ALL_CANDIDATES_REJECTED') AND (SELECT max(settlement_date) FROM sp) < l.order_date + INTERVAL 2 DAY THEN 'PENDING_SETTLEMENT_WINDOW' ELSE v.classification END AS classification,
        upper(l.currency) = upper(s.currency) AS currency_ok, abs(l.amount_minor - s.gross_amount_minor) <= 2 AS amount_ok, abs(s.net_amount_minor - (s.gross_amount_minor - s.fee_minor - s.tax_minor - s.refund_amount_minor)) <= 2 AS net_ok,
        {days('s.order_date', 's.settlement_date')} <= 21 AS timing_ok, (l.status IN ('refunded', 'partially_refunded')) = (s.refund_amount_minor > 0) AND abs(l.refund_amount_minor - s.refund_amount_minor) <= 2 AS refund_ok
        FROM ledger l JOIN resolved v USING (seq) LEFT JOIN sp s ON s.pop_seq = v.pop_seq""",
    "decided": """SELECT *, CASE WHEN pop_seq IS NULL THEN CASE WHEN classification IN ('AMBIGUOUS_MULTIPLE', 'SEMANTIC_UNRESOLVED', 'PROVIDER_ERROR') THEN 'HUMAN_REVIEW' ELSE 'EXCEPTION' END
            WHEN NOT (currency_ok AND amount_ok AND net_ok AND timing_ok AND refund_ok) THEN 'EXCEPTION' WHEN ai_confidence < 0.85 THEN 'HUMAN_REVIEW' ELSE 'RECONCILED' END AS outcome,
        CASE WHEN pop_seq IS NULL THEN CASE classification WHEN 'PENDING_SETTLEMENT_WINDOW' THEN 'PENDING_SETTLEMENT' WHEN 'AMBIGUOUS_MULTIPLE' THEN 'AMBIGUOUS_MATCH' WHEN 'SEMANTIC_UNRESOLVED' THEN 'AMBIGUOUS_MATCH' WHEN 'PROVIDER_ERROR' THEN 'PROVIDER_ERROR' ELSE 'MISSING_SETTLEMENT' END
            WHEN NOT currency_ok THEN 'CURRENCY_MISMATCH' WHEN NOT amount_ok THEN 'AMOUNT_MISMATCH' WHEN NOT net_ok THEN 'FEE_TAX_INCONSISTENT' WHEN NOT refund_ok THEN 'REFUND_MISMATCH' WHEN NOT timing_ok THEN 'SETTLEMENT_DELAYED' WHEN ai_confidence < 0.85 THEN 'LOW_CONFIDENCE_MATCH' END AS exception_type,
        CASE WHEN pop_seq IS NULL THEN CASE classification WHEN 'PENDING_SETTLEMENT_WINDOW' THEN 'LOW' WHEN 'AMBIGUOUS_MULTIPLE' THEN 'MEDIUM' WHEN 'SEMANTIC_UNRESOLVED' THEN 'MEDIUM' WHEN 'PROVIDER_ERROR' THEN 'MEDIUM' ELSE 'HIGH' END
            WHEN NOT (currency_ok AND amount_ok AND net_ok) THEN 'HIGH' WHEN NOT (refund_ok AND timing_ok) THEN 'MEDIUM' WHEN ai_confidence < 0.85 THEN 'MEDIUM' END AS severity FROM checked""",
    "claims": "SELECT payment_id, count(*) AS n_claims, max(tier) AS best FROM (SELECT payment_id, CASE classification WHEN 'EXACT_REFERENCE' THEN 4 WHEN 'DISAMBIGUATED_BY_AMOUNT' THEN 3 WHEN 'CORROBORATED' THEN 2 WHEN 'SEMANTIC_CONFIRMED' THEN 1 ELSE 0 END AS tier FROM decided WHERE payment_id IS NOT NULL AND outcome <> 'EXCEPTION') GROUP BY payment_id HAVING count(*) > 1",
    "tiers": "SELECT seq, payment_id, CASE classification WHEN 'EXACT_REFERENCE' THEN 4 WHEN 'DISAMBIGUATED_BY_AMOUNT' THEN 3 WHEN 'CORROBORATED' THEN 2 WHEN 'SEMANTIC_CONFIRMED' THEN 1 ELSE 0 END AS tier FROM decided WHERE payment_id IS NOT NULL AND outcome <> 'EXCEPTION'",
    "lost": "SELECT t.seq, c.n_claims FROM tiers t JOIN claims c USING (payment_id) JOIN (SELECT t.payment_id, count(*) AS n_best FROM tiers t JOIN claims c ON c.payment_id = t.payment_id AND c.best = t.tier GROUP BY t.payment_id) b USING (payment_id) WHERE NOT (t.tier = c.best AND b.n_best = 1)",
    # The populations hold far more than forty unmatched records, so no sums are looked for.
    "final": "SELECT d.* REPLACE (CASE WHEN x.seq IS NOT NULL THEN 'HUMAN_REVIEW' ELSE outcome END AS outcome, CASE WHEN x.seq IS NOT NULL THEN 'DUPLICATE_CLAIM' ELSE exception_type END AS exception_type, CASE WHEN x.seq IS NOT NULL THEN 'HIGH' ELSE severity END AS severity) FROM decided d LEFT JOIN lost x USING (seq)",
}


def sql(step: str, select: str, **more: str) -> str:
    """The chain up to ``step`` (and ``more`` steps after it), closed by a select."""
    names = list(STEPS)
    used = {k: STEPS[k] for k in names[: names.index(step) + 1]} | more
    heavy = {"lp", "sp", "rec", "pool", "plausible", "lt", "st", "pairs", "scored", "listed", "good", "exact"}
    return "WITH " + ",\n".join(f"{k} AS {'MATERIALIZED ' if k in heavy else ''}({v})" for k, v in used.items()) + "\n" + select
