"""The same questions in plain SQL, for comparison on the same Parquet tables.

`DOMAIN` restates the derivations of `sources/derived.py`; the bodies are
written without looking at the Spark plans: status requests are walked one by
one, duplicates are numbered by a window, NOT EXISTS stays NOT EXISTS.
"""

from __future__ import annotations

from casewright.schema import TABLES

# Fixed values, stated here once more so that a wrong one in the engine shows: segments, labels, steps, texts.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
LABELS = {
    "Open": "Offen – wartet auf Dokumente",
    "InReview": "In Prüfung",
    "Approved": "Genehmigt",
    "Rejected": "Abgelehnt",
    "Closed": "Geschlossen",
}
UNKNOWN_LABEL = "Unbekannter Status"
STEPS = {
    "Open": ("InReview", "Rejected"),
    "InReview": ("Approved", "Rejected"),
    "Approved": ("Closed",),
    "Rejected": ("Closed",),
}
CASE_NOT_FOUND = ("Fehler: CaseID ", " existiert nicht.")
CASE_STATUS = ('Fehler: Case hat Status "', '" – Dokumente können nicht mehr eingereicht werden.')
TYPE_NOT_FOUND = ("Fehler: DocumentTypeID ", " existiert nicht.")
DUPLICATE = 'Hinweis: Dieses Dokument wurde bereits eingereicht und ist noch aktiv (Status nicht "Abgelehnt").'
UBO_NOT_REPORTABLE = (
    "Fehler: UBO ",
    " ist für dieses Unternehmen nicht meldepflichtig (Beteiligungsanteil unter 25%).",
)
COMPLETE = 'OK – Dokument eingereicht. Alle Pflichtdokumente vollständig – Case wurde auf "In Prüfung" gesetzt.'
STILL_MISSING = ("OK – Dokument erfolgreich eingereicht. Es fehlen noch ", " Pflichtdokument(e).")
NOT_FOUND = "Fehler: CaseID nicht gefunden."
INVALID = ('Fehler: Ungültiger Statusübergang von "', '" nach "', '".')
UPDATED = ("OK – Status von Case ", ' auf "', '" gesetzt.')
CHECK_SUMMARY = ("Automatisch erstellt durch Trigger – Statusänderung auf: ", " (vorher: ", ")")
ADVANCED = "Status automatisch auf InReview gesetzt"
READY = "Alle Pflichtdokumente vorhanden – bereit für Genehmigung"
ONE_MISSING = "Noch 1 Pflichtdokument ausstehend"
MANY_MISSING = ("Noch ", " Pflichtdokumente ausstehend")
LISTED_TYPES = ("S", "U", "R")
SYSTEM_NAMES = (
    "dbo", "guest", "INFORMATION_SCHEMA", "sys", "db_owner", "db_accessadmin", "db_securityadmin", "db_ddladmin",
    "db_backupoperator", "db_datareader", "db_datawriter", "db_denydatareader", "db_denydatawriter", "public",
)

AS_OF = "TIMESTAMP '1998-06-01 12:00:00'"
AS_OF_DAY = "DATE '1998-06-01'"
OWNERSHIP_DAY = "DATE '1997-01-01'"


def _fold(x: str) -> str:
    return f"lower(rtrim({x}))"


def _quote(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _values(rows: tuple[tuple, ...]) -> str:
    return ", ".join(
        "(" + ", ".join([f"CAST({i} AS BIGINT)", *map(_quote, row)]) + ")" for i, row in enumerate(rows, 1)
    )


def _label(x: str) -> str:
    whens = " ".join(f"WHEN {_quote(k.lower())} THEN {_quote(v)}" for k, v in LABELS.items())
    return f"(CASE {_fold(x)} {whens} ELSE {_quote(UNKNOWN_LABEL)} END)"


def _allowed(old: str, new: str) -> str:
    steps = " OR ".join(
        f"({_fold(old)} = '{a.lower()}' AND {_fold(new)} IN ({', '.join(_quote(b.lower()) for b in targets)}))"
        for a, targets in STEPS.items()
    )
    return f"coalesce({steps}, FALSE)"


def _spelling(x: str) -> str:
    whens = " ".join(f"WHEN {_quote(k.lower())} THEN {_quote(k)}" for k in LABELS)
    return f"(CASE {_fold(x)} {whens} END)"


PROP = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

DOMAIN = {
    "country": """
        SELECT CAST(n_nationkey AS BIGINT) AS country_id,
               lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS country_code,
               n_name AS country_name, r_name AS region_name
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "segment": "SELECT seg - 1 AS seg, segment FROM (VALUES "
    + _values(tuple((s,) for s in SEGMENTS))
    + ") s(seg, segment)",
    "legal_form": """
        SELECT CAST(n_nationkey AS BIGINT) * 5 + seg AS legal_form_id,
               CAST(n_nationkey AS BIGINT) AS country_id,
               segment AS legal_form_code, n_name || ' ' || segment AS legal_form_name
        FROM nation JOIN segment ON TRUE""",
    "company": """
        SELECT c_custkey AS company_id, CAST(c_nationkey AS BIGINT) * 5 + seg AS legal_form_id,
               c_name AS company_name, 'HR-' || CAST(c_custkey AS VARCHAR) AS registration_number,
               CAST(NULL AS DATE) AS foundation_date, c_mktsegment AS industry_code,
               CAST(floor(c_acctbal / 10) AS INTEGER) AS employee_count,
               CAST(c_acctbal AS DECIMAL(18,2)) AS annual_revenue,
               DATE '1995-01-01' AS registration_date
        FROM customer LEFT JOIN segment ON segment = c_mktsegment""",
    "company_address": """
        SELECT conv_id * 1000 + turn AS company_address_id, conv_id AS company_id, turn AS country_id,
               CASE role WHEN 'user' THEN 'Registered' WHEN 'assistant' THEN 'physical'
                         ELSE 'system' END AS address_type,
               text AS street_address, CAST(NULL AS VARCHAR) AS postal_code,
               CAST(NULL AS VARCHAR) AS city, turn = 0 AS is_primary
        FROM conversations""",
    "ubo": """
        SELECT s_suppkey AS ubo_id, 'Supplier' AS first_name, split_part(s_name, '#', 2) AS last_name,
               CAST(NULL AS DATE) AS date_of_birth,
               lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS nationality,
               CASE WHEN s_acctbal >= 0 THEN
                    CASE WHEN s_nationkey < 12 THEN 'P-' ELSE 'p-' END
                    || CAST(CAST(floor(s_acctbal / 100) AS BIGINT) AS VARCHAR) END AS passport_no
        FROM supplier""",
    "ownership": """
        SELECT l_orderkey * 10 + l_linenumber AS ownership_id, o_custkey AS company_id,
               l_suppkey AS ubo_id, CAST(l_quantity * 2 AS DECIMAL(5,2)) AS ownership_percentage,
               l_linestatus = 'O' AS is_ownership_direct,
               CAST(o_orderdate AS DATE) AS valid_from,
               CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) END AS valid_to
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "document_type": """
        SELECT p_partkey % 7 + 1 AS document_type_id, min(p_name) AS document_type_name,
               CASE WHEN p_partkey % 7 + 1 >= 5 THEN 'UBO' ELSE 'Company' END AS document_scope
        FROM part GROUP BY p_partkey % 7 + 1""",
    "required_documents": """
        SELECT legal_form_id * 10 + document_type_id AS required_document_id, legal_form_id,
               document_type_id,
               CASE WHEN document_type_id = 3 THEN 'Enhanced' ELSE 'Standard' END AS requirement_level,
               document_type_id >= 5 AS applies_to_ubo,
               (legal_form_id + document_type_id) % 3 <> 0 AS is_mandatory
        FROM legal_form JOIN document_type ON TRUE
        WHERE legal_form_code <> 'MACHINERY'""",
    "onboarding_case": """
        SELECT o_orderkey AS case_id, o_custkey AS company_id, CAST(o_orderdate AS DATE) AS case_open_date,
               CASE WHEN o_orderstatus = 'O' THEN 'Open' WHEN o_orderstatus = 'P' THEN 'InReview'
                    WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Approved'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'Rejected' ELSE 'Closed' END AS case_status
        FROM orders""",
    "submitted_documents": """
        SELECT l_orderkey * 10 + l_linenumber AS submitted_document_id, l_orderkey AS case_id,
               CASE WHEN l_partkey % 7 + 1 >= 5 AND l_linenumber <> 7 THEN l_suppkey END AS ubo_id,
               l_partkey % 7 + 1 AS document_type_id, CAST(l_shipdate AS DATE) AS submission_date,
               CASE l_returnflag WHEN 'N' THEN 'Pending' WHEN 'A' THEN 'Verified'
                    ELSE 'Rejected' END AS document_status,
               CASE WHEN l_returnflag <> 'N' THEN CAST(l_shipdate AS DATE) END AS verification_date
        FROM lineitem""",
    "external_source": """
        SELECT CAST(r_regionkey AS BIGINT) + 1 AS external_source_id, r_name AS source_name,
               (SELECT lpad(CAST(min(n_nationkey) AS VARCHAR), 2, '0') FROM nation
                WHERE n_regionkey = r_regionkey) AS source_country,
               CASE r_regionkey WHEN 0 THEN 'Internal' ELSE 'Registry' END AS source_type
        FROM region""",
    "external_verification_check": f"""
        SELECT event_id AS external_check_id, event_id * 2 AS case_id,
               {PROP} // 16 + 1 AS external_source_id, CAST(ts AS DATE) AS check_date,
               CASE event_type WHEN 'purchase' THEN 'Passed' WHEN 'error' THEN 'Failed'
                    WHEN 'signup' THEN 'Manual' WHEN 'view' THEN 'Pending' END AS check_status,
               props AS result_summary
        FROM events""",
    "submit_requests": f"""
        SELECT event_id AS request_id,
               CASE WHEN {PROP} = 1 THEN -1 WHEN {PROP} > 1 THEN user_id * 4 + event_id % 4 END AS case_id,
               CASE WHEN {PROP} <> 2 THEN CAST(floor(value) AS BIGINT) % 9 END AS document_type_id,
               CASE WHEN event_type IN ('click', 'error') THEN CAST(floor(value) AS BIGINT) END AS ubo_id
        FROM events""",
    "status_requests": f"""
        SELECT event_id AS request_id,
               CASE WHEN {PROP} = 1 THEN -1 ELSE user_id * 4 + event_id % 4 END AS case_id,
               CASE WHEN {PROP} > 0 THEN
                    CASE event_type WHEN 'signup' THEN 'InReview' WHEN 'purchase' THEN 'approved '
                         WHEN 'error' THEN 'REJECTED' WHEN 'view' THEN 'Closed'
                         WHEN 'click' THEN 'Open' END END AS new_status
        FROM events""",
    # Steps shared by several queries.
    # Needed minus on file: a need is lacking where no live document of its case and type is left over.
    "live_types": f"""
        SELECT case_id, document_type_id FROM submitted_documents
        WHERE {_fold('document_status')} IS DISTINCT FROM 'rejected'""",
    "needs": """
        SELECT case_id, document_type_id, required_document_id, requirement_level
        FROM (SELECT * FROM required_documents WHERE is_mandatory AND NOT applies_to_ubo) rule
        NATURAL JOIN (SELECT company_id, legal_form_id FROM company) firm
        NATURAL JOIN (SELECT case_id, company_id FROM onboarding_case) file""",
    "lacking": """
        SELECT case_id, document_type_id FROM needs EXCEPT SELECT case_id, document_type_id FROM live_types""",
    "missing_rows": """
        SELECT case_id, required_document_id, document_type_id, requirement_level
        FROM needs NATURAL JOIN lacking""",
    "missing": """
        SELECT oc.case_id, count(m.case_id) AS missing
        FROM onboarding_case oc LEFT JOIN missing_rows m ON m.case_id = oc.case_id
        GROUP BY oc.case_id""",
    # One count per case and status first, then a column for each status.
    "by_status": f"""
        SELECT case_id, {_fold('document_status')} AS kind, count(*) AS n
        FROM submitted_documents GROUP BY ALL""",
    "stats": """
        WITH wide AS (
            SELECT case_id, CAST(sum(n) AS BIGINT) AS total_documents,
                   CAST(coalesce(sum(n) FILTER (kind = 'verified'), 0) AS BIGINT) AS verified_documents,
                   CAST(coalesce(sum(n) FILTER (kind = 'pending'), 0) AS BIGINT) AS pending_documents,
                   CAST(coalesce(sum(n) FILTER (kind = 'rejected'), 0) AS BIGINT) AS rejected_documents
            FROM by_status GROUP BY case_id)
        SELECT wide.*, file.case_status, firm.company_name
        FROM wide NATURAL JOIN onboarding_case file
        JOIN (SELECT company_id, company_name FROM company) firm USING (company_id)""",
    "reviewed": f"""
        SELECT oc.case_id, c.company_name, oc.case_status, m.missing,
               m.missing = 0 AND {_fold('oc.case_status')} = 'open' AS advances
        FROM onboarding_case oc JOIN company c ON c.company_id = oc.company_id
        JOIN missing m ON m.case_id = oc.case_id
        WHERE {_fold('oc.case_status')} IN ('open', 'inreview')""",
    "queue": """
        SELECT r.request_id, r.case_id, r.new_status, c.case_status,
               row_number() OVER (PARTITION BY r.case_id ORDER BY r.request_id) AS turn_no
        FROM status_requests r JOIN onboarding_case c ON c.case_id = r.case_id""",
    "walk": f"""
        SELECT request_id, case_id, new_status, turn_no, case_status AS old_status,
               {_allowed('case_status', 'new_status')} AS ok
        FROM queue WHERE turn_no = 1
        UNION ALL
        SELECT q.request_id, q.case_id, q.new_status, q.turn_no,
               CASE WHEN w.ok THEN w.new_status ELSE w.old_status END,
               {_allowed('CASE WHEN w.ok THEN w.new_status ELSE w.old_status END', 'q.new_status')}
        FROM walk w JOIN queue q ON q.case_id = w.case_id AND q.turn_no = w.turn_no + 1""",
    "changes": "SELECT request_id, case_id, old_status, new_status FROM walk WHERE ok",
    "decided": f"""
        SELECT * FROM changes
        WHERE {_fold('new_status')} IN ('approved', 'rejected')
          AND {_fold('old_status')} <> {_fold('new_status')}""",
    "audit_rows": f"""
        SELECT d.case_id, CAST(1 AS BIGINT) AS external_source_id,
               {AS_OF_DAY} AS check_date,
               CASE {_fold('d.new_status')} WHEN 'approved' THEN 'Passed' ELSE 'Failed' END AS check_status,
               {_quote(CHECK_SUMMARY[0])} || d.new_status || {_quote(CHECK_SUMMARY[1])}
                   || d.old_status || {_quote(CHECK_SUMMARY[2])} AS result_summary
        FROM decided d
        WHERE NOT EXISTS (SELECT 1 FROM external_verification_check e WHERE e.case_id = d.case_id)""",
    "documents_after": f"""
        SELECT sd.submitted_document_id, sd.case_id, sd.ubo_id, sd.document_type_id, sd.submission_date,
               d.case_id IS NOT NULL AND {_fold('sd.document_status')} = 'pending' AS changed,
               CASE WHEN d.case_id IS NULL OR {_fold('sd.document_status')} <> 'pending'
                         THEN sd.document_status
                    WHEN {_fold('d.new_status')} = 'approved' THEN 'Verified'
                    ELSE 'Rejected' END AS document_status,
               CASE WHEN d.case_id IS NOT NULL AND {_fold('sd.document_status')} = 'pending'
                         THEN {AS_OF_DAY} ELSE sd.verification_date END AS verification_date
        FROM submitted_documents sd LEFT JOIN decided d ON d.case_id = sd.case_id""",
    # Each test is a set of request ids; the first test that a request fails names its code.
    "reportable": """
        SELECT DISTINCT company_id, ubo_id FROM ownership WHERE ownership_percentage >= 25""",
    "on_file": f"""
        SELECT DISTINCT case_id, document_type_id, coalesce(ubo_id, -1) AS owner FROM submitted_documents
        WHERE {_fold('document_status')} IS DISTINCT FROM 'rejected'""",
    "judged": f"""
        SELECT ask.*, file.company_id, file.case_status,
               coalesce(
                   CASE WHEN file.case_id IS NULL THEN 'CASE_NOT_FOUND' END,
                   CASE WHEN {_fold('file.case_status')} IN ('approved', 'rejected', 'closed') THEN 'CASE_STATUS' END,
                   CASE WHEN kind.document_type_id IS NULL THEN 'TYPE_NOT_FOUND' END,
                   CASE WHEN old.case_id IS NOT NULL THEN 'DUPLICATE' END,
                   CASE WHEN ask.ubo_id IS NOT NULL AND own.ubo_id IS NULL THEN 'UBO_NOT_REPORTABLE' END,
                   'ACCEPTED') AS code
        FROM submit_requests ask
        LEFT JOIN onboarding_case file USING (case_id)
        LEFT JOIN document_type kind USING (document_type_id)
        LEFT JOIN on_file old ON (old.case_id, old.document_type_id, old.owner)
                               = (ask.case_id, ask.document_type_id, coalesce(ask.ubo_id, -1))
        LEFT JOIN reportable own ON own.company_id = file.company_id AND own.ubo_id = ask.ubo_id""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY case_id, document_type_id, ubo_id, code
                                     ORDER BY request_id) AS copy_no
        FROM judged""",
    "taken": """
        SELECT *, row_number() OVER (PARTITION BY case_id, document_type_id ORDER BY request_id) AS type_no,
               row_number() OVER (ORDER BY request_id)
                   + (SELECT max(submitted_document_id) FROM submitted_documents) AS new_document_id
        FROM ranked WHERE code = 'ACCEPTED' AND copy_no = 1""",
    "progressed": f"""
        SELECT t.*,
               m.missing - CAST(sum(CASE WHEN type_no = 1 THEN coalesce(n.need, 0) ELSE 0 END) OVER (
                   PARTITION BY t.case_id ORDER BY t.request_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS missing_after
        FROM taken t JOIN missing m ON m.case_id = t.case_id
        LEFT JOIN (SELECT case_id, document_type_id, count(*) AS need FROM missing_rows
                   GROUP BY case_id, document_type_id) n
          ON n.case_id = t.case_id AND n.document_type_id = t.document_type_id""",
    # The interleaved feed, one request of each case after the other; a case
    # carries its status and the lists of live documents and live types.
    "workflow_requests": """
        SELECT request_id * 2 AS request_id, 'submit' AS kind, case_id, document_type_id, ubo_id,
               CAST(NULL AS VARCHAR) AS new_status FROM submit_requests
        UNION ALL
        SELECT request_id * 2 + 1, 'status', case_id, NULL, NULL, new_status FROM status_requests""",
    "feed": """
        SELECT r.*, c.case_status, c.company_id,
               CASE WHEN r.ubo_id IS NULL THEN TRUE ELSE EXISTS (
                   SELECT 1 FROM ownership o WHERE o.company_id = c.company_id AND o.ubo_id = r.ubo_id
                                               AND o.ownership_percentage >= 25) END AS eligible,
               EXISTS (SELECT 1 FROM document_type t
                       WHERE t.document_type_id = r.document_type_id) AS known_type,
               CAST(r.document_type_id AS VARCHAR) || ':' || coalesce(CAST(r.ubo_id AS VARCHAR), '')
                   AS doc_key,
               row_number() OVER (PARTITION BY r.case_id ORDER BY r.request_id) AS turn_no
        FROM workflow_requests r JOIN onboarding_case c ON c.case_id = r.case_id""",
    "case_start": """
        SELECT oc.case_id, oc.case_status,
               coalesce(d.live_keys, []) AS live_keys, coalesce(d.live_types, []) AS live_types,
               coalesce(q.wanted, []) AS wanted
        FROM onboarding_case oc
        LEFT JOIN (SELECT case_id, list(CAST(document_type_id AS VARCHAR) || ':'
                                        || coalesce(CAST(ubo_id AS VARCHAR), '')) AS live_keys,
                          list(document_type_id) AS live_types
                   FROM live_docs GROUP BY case_id) d ON d.case_id = oc.case_id
        LEFT JOIN (SELECT c.company_id, list(rd.document_type_id) AS wanted
                   FROM company c JOIN required_documents rd ON rd.legal_form_id = c.legal_form_id
                   WHERE rd.is_mandatory AND NOT rd.applies_to_ubo
                   GROUP BY c.company_id) q ON q.company_id = oc.company_id""",
    "acted": f"""
        SELECT case_id, CAST(0 AS BIGINT) AS turn_no, CAST(NULL AS BIGINT) AS request_id,
               CAST(NULL AS VARCHAR) AS code, CAST(NULL AS BIGINT) AS missing_after,
               CAST(NULL AS VARCHAR) AS met, case_status AS now, live_keys, live_types, wanted
        FROM case_start WHERE case_id IN (SELECT case_id FROM feed)
        UNION ALL
        SELECT case_id, turn_no, request_id, code, missing_after, met,
               CASE WHEN kind = 'status' AND code = 'ACCEPTED' THEN {_spelling('new_status')}
                    WHEN kind = 'submit' AND missing_after = 0 AND {_fold('met')} = 'open' THEN 'InReview'
                    ELSE met END,
               live_keys, live_types, wanted
        FROM (SELECT *, CASE WHEN kind = 'submit' AND code = 'ACCEPTED' THEN
                             len(list_filter(wanted, lambda x: NOT list_contains(live_types, x)))
                        END AS missing_after
              FROM (SELECT * EXCLUDE (live_keys, live_types),
                           CASE WHEN kind = 'submit' AND code = 'ACCEPTED'
                                THEN list_append(live_keys, doc_key) ELSE live_keys END AS live_keys,
                           CASE WHEN kind = 'submit' AND code = 'ACCEPTED'
                                THEN list_append(live_types, document_type_id) ELSE live_types
                           END AS live_types
                    FROM (SELECT f.case_id, f.turn_no, f.request_id, f.kind, f.new_status, f.doc_key,
                                 f.document_type_id, a.now AS met, a.live_keys, a.live_types, a.wanted,
                                 CASE WHEN f.kind = 'status' THEN
                                           CASE WHEN {_allowed('a.now', 'f.new_status')}
                                                THEN 'ACCEPTED' ELSE 'INVALID' END
                                      WHEN {_fold('a.now')} NOT IN ('open', 'inreview') THEN 'CASE_STATUS'
                                      WHEN NOT f.known_type THEN 'TYPE_NOT_FOUND'
                                      WHEN list_contains(a.live_keys, f.doc_key) THEN 'DUPLICATE'
                                      WHEN NOT f.eligible THEN 'UBO_NOT_REPORTABLE'
                                      ELSE 'ACCEPTED' END AS code
                          FROM acted a JOIN feed f
                            ON f.case_id = a.case_id AND f.turn_no = a.turn_no + 1)))""",
    "acted_rows": "SELECT * FROM acted WHERE turn_no > 0",
    "handled": """
        SELECT r.request_id, r.kind, r.case_id, r.document_type_id, r.ubo_id, r.new_status AS asked_status,
               coalesce(a.code, CASE r.kind WHEN 'submit' THEN 'CASE_NOT_FOUND' ELSE 'NOT_FOUND' END)
                   AS code,
               a.missing_after, a.met, a.now,
               CASE WHEN r.kind = 'submit' AND a.code = 'ACCEPTED' THEN
                    (SELECT max(submitted_document_id) FROM submitted_documents)
                    + sum(CASE WHEN r.kind = 'submit' AND a.code = 'ACCEPTED' THEN 1 ELSE 0 END)
                        OVER (ORDER BY r.request_id) END AS new_document_id
        FROM workflow_requests r LEFT JOIN acted_rows a ON a.request_id = r.request_id""",
    "live_docs": f"""
        SELECT DISTINCT case_id, document_type_id, ubo_id FROM submitted_documents
        WHERE {_fold('document_status')} <> 'rejected'""",
}

#: Which other entries an entry reads.
NEEDS = {
    "legal_form": ("segment",),
    "company": ("segment",),
    "required_documents": ("legal_form", "document_type"),
    "live_types": ("submitted_documents",),
    "needs": ("required_documents", "company", "onboarding_case"),
    "lacking": ("needs", "live_types"),
    "missing_rows": ("needs", "lacking"),
    "missing": ("onboarding_case", "missing_rows"),
    "by_status": ("submitted_documents",),
    "stats": ("by_status", "onboarding_case", "company"),
    "reportable": ("ownership",),
    "on_file": ("submitted_documents",),
    "reviewed": ("onboarding_case", "company", "missing"),
    "queue": ("status_requests", "onboarding_case"),
    "walk": ("queue",),
    "changes": ("walk",),
    "decided": ("changes",),
    "audit_rows": ("decided", "external_verification_check"),
    "documents_after": ("submitted_documents", "decided"),
    "judged": ("submit_requests", "onboarding_case", "document_type", "on_file", "reportable"),
    "ranked": ("judged",),
    "taken": ("ranked", "submitted_documents"),
    "progressed": ("taken", "missing", "missing_rows"),
    "live_docs": ("submitted_documents",),
    "workflow_requests": ("submit_requests", "status_requests"),
    "feed": ("workflow_requests", "onboarding_case", "ownership", "document_type"),
    "case_start": ("onboarding_case", "live_docs", "company", "required_documents"),
    "acted": ("case_start", "feed"),
    "acted_rows": ("acted",),
    "handled": ("workflow_requests", "acted_rows", "submitted_documents"),
}


def _sql(body: str, *needs: str) -> str:
    """``body`` after the entries of `DOMAIN` that it needs, each once, in order."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in needs:
        add(name)
    parts = ",\n".join(f"{name} AS ({DOMAIN[name]})" for name in wanted)
    if body.startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return f"WITH RECURSIVE {parts}\n{body}"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _flags(conditions: dict[tuple[str, str], str], value: bool = True) -> str:
    shown = ", CAST({c} AS VARCHAR) AS value" if value else ""
    return _union(
        [
            f"SELECT '{t}' AS table_name, CAST({TABLES[t].key} AS VARCHAR) AS row_key, "
            f"'{c}' AS column_name{shown.format(c=c)} FROM {t} WHERE {cond}"
            for (t, c), cond in conditions.items()
        ]
    )


def _in_list(x: str, values: tuple[str, ...]) -> str:
    return f"{_fold(x)} IN ({', '.join(_quote(v.lower()) for v in values)})"


# What the rules forbid and the lengths they allow, stated apart from the schema that the jobs use.
CHECK_CONDITIONS = {
    ("company", "employee_count"): "employee_count < 0",
    ("company", "annual_revenue"): "annual_revenue < 0",
    ("company_address", "address_type"): f"{_fold('address_type')} NOT IN ('registered', 'physical')",
    ("ownership", "ownership_percentage"): "ownership_percentage < 0 OR ownership_percentage > 100",
    ("document_type", "document_scope"): f"{_fold('document_scope')} NOT IN ('company', 'ubo')",
    ("onboarding_case", "case_status"):
        f"{_fold('case_status')} NOT IN ('open', 'inreview', 'approved', 'rejected', 'closed')",
    ("submitted_documents", "document_status"): f"{_fold('document_status')} NOT IN ('pending', 'verified', 'rejected')",
    ("external_verification_check", "check_status"):
        f"{_fold('check_status')} NOT IN ('pending', 'passed', 'failed', 'manual')",
}
LENGTHS = {
    "country": {"country_code": 2, "country_name": 100, "region_name": 100},
    "legal_form": {"legal_form_code": 20, "legal_form_name": 100},
    "company": {"company_name": 200, "registration_number": 50, "industry_code": 20},
    "company_address": {"address_type": 20, "street_address": 255, "postal_code": 20, "city": 100},
    "ubo": {"first_name": 100, "last_name": 100, "nationality": 2, "passport_no": 50},
    "document_type": {"document_type_name": 100, "document_scope": 20},
    "required_documents": {"requirement_level": 50},
    "onboarding_case": {"case_status": 50},
    "submitted_documents": {"document_status": 50},
    "external_source": {"source_name": 100, "source_country": 2, "source_type": 50},
    "external_verification_check": {"check_status": 50},
}


ALL = tuple(TABLES)
COMPLETE_MESSAGE = _quote(COMPLETE)


def _wrap(parts: tuple[str, ...], *values: str) -> str:
    out = [_quote(parts[0])]
    for part, value in zip(parts[1:], values):
        out += [value, _quote(part)]
    return " || ".join(out)


def _text(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


VERDICT_SQL = f"""
    SELECT r.request_id,
           CASE WHEN r.code = 'ACCEPTED' AND r.copy_no > 1 THEN 'DUPLICATE' ELSE r.code END AS code,
           CASE WHEN r.code = 'CASE_NOT_FOUND' THEN {_wrap(CASE_NOT_FOUND, _text('r.case_id'))}
                WHEN r.code = 'CASE_STATUS' THEN {_wrap(CASE_STATUS, _label('r.case_status'))}
                WHEN r.code = 'TYPE_NOT_FOUND'
                    THEN {_wrap(TYPE_NOT_FOUND, _text('r.document_type_id'))}
                WHEN r.code = 'DUPLICATE' OR (r.code = 'ACCEPTED' AND r.copy_no > 1)
                    THEN {_quote(DUPLICATE)}
                WHEN r.code = 'UBO_NOT_REPORTABLE'
                    THEN {_wrap(UBO_NOT_REPORTABLE, _text('r.ubo_id'))}
                WHEN p.missing_after = 0 THEN {COMPLETE_MESSAGE}
                ELSE {_wrap(STILL_MISSING, _text('p.missing_after'))} END AS message,
           coalesce(p.new_document_id, 0) AS new_document_id,
           p.missing_after,
           CASE WHEN p.missing_after = 0 AND {_fold('p.case_status')} = 'open' THEN 'InReview'
                ELSE p.case_status END AS new_status
    FROM ranked r LEFT JOIN progressed p ON p.request_id = r.request_id"""

ORACLE: dict[str, str] = {
    "onboarding_overview": _sql(
        """WITH seat AS (
               SELECT legal_form_id, legal_form_name, legal_form_code, country.*
               FROM legal_form JOIN country USING (country_id)),
           firm AS (
               SELECT company_id, company_name, registration_number, employee_count, annual_revenue,
                      seat.* EXCLUDE (country_id, legal_form_id)
               FROM company JOIN seat USING (legal_form_id))
           SELECT firm.*, case_id, case_open_date, case_status
           FROM firm JOIN onboarding_case USING (company_id)""",
        "onboarding_case",
        "company",
        "legal_form",
        "country",
    ),
    "document_completion_stats": _sql("SELECT * FROM stats", "stats"),
    "document_completion_rate": _sql(
        """SELECT case_id, verified_documents, total_documents,
                  CAST(round(verified_documents / total_documents, 4) AS DECIMAL(6,4)) AS completion_rate
           FROM stats""",
        "stats",
    ),
    # Holdings outwards: those with their owner, and the companies that no holding names.
    "company_with_ubo": _sql(
        """WITH place AS (
               SELECT company_id, company_name, legal_form_name, country_name
               FROM country JOIN legal_form USING (country_id) JOIN company USING (legal_form_id)),
           held AS (
               SELECT company_id, ownership.ubo_id AS named, ubo.ubo_id,
                      concat_ws(' ', first_name, last_name) AS whole_name, nationality, ownership_percentage,
                      CASE is_ownership_direct WHEN TRUE THEN 'Direct' WHEN FALSE THEN 'Indirect' END AS way,
                      valid_from, valid_to, if(ownership_percentage < 25, 'Nein', 'Ja') AS verdict
               FROM ownership LEFT JOIN ubo ON ubo.ubo_id = ownership.ubo_id)
           SELECT place.*, ubo_id, if(ubo_id IS NULL, NULL, whole_name) AS ubo_full_name,
                  nationality AS ubo_nationality, ownership_percentage, way AS ownership_type,
                  valid_from, valid_to, verdict AS is_beneficial_owner
           FROM held JOIN place USING (company_id)
           UNION ALL BY NAME
           SELECT place.*, 'Kein UBO' AS is_beneficial_owner
           FROM place ANTI JOIN ownership USING (company_id)""",
        "company",
        "legal_form",
        "country",
        "ownership",
        "ubo",
    ),
    "ubo_reportable_flag": _sql(
        """SELECT ownership_id, ownership_percentage,
                  coalesce(ownership_percentage >= 25, FALSE) AS is_reportable FROM ownership""",
        "ownership",
    ),
    "case_status_label": _sql(
        f"SELECT request_id, new_status, {_label('new_status')} AS status_label FROM status_requests",
        "status_requests",
    ),
    "missing_mandatory_docs": _sql("SELECT case_id, missing FROM missing", "missing"),
    "missing_mandatory_detail": _sql("SELECT * FROM missing_rows", "missing_rows"),
    "missing_by_level": _sql(
        f"""SELECT case_id, min(requirement_level) AS requirement_level, count(*) AS missing
            FROM missing_rows GROUP BY case_id, {_fold('requirement_level')}""",
        "missing_rows",
    ),
    "missing_ubo_docs": _sql(
        f"""SELECT oc.case_id, count(*) AS required_documents,
                   count(CASE WHEN d.case_id IS NULL THEN 1 END) AS missing_documents
            FROM onboarding_case oc JOIN company c ON c.company_id = oc.company_id
            JOIN required_documents rd ON rd.legal_form_id = c.legal_form_id
                 AND rd.is_mandatory AND rd.applies_to_ubo
            JOIN (SELECT DISTINCT company_id, ubo_id FROM ownership
                  WHERE ownership_percentage >= 25
                    AND (valid_to IS NULL OR CAST(valid_to AS TIMESTAMP) >= {AS_OF})) o
              ON o.company_id = c.company_id
            LEFT JOIN live_docs d ON d.case_id = oc.case_id AND d.ubo_id = o.ubo_id
                                 AND d.document_type_id = rd.document_type_id
            GROUP BY oc.case_id""",
        "onboarding_case",
        "company",
        "required_documents",
        "ownership",
        "live_docs",
    ),
    "missing_ubo_docs_listed": _sql(
        f"""SELECT case_id, ubo_id, required_document_id, document_type_id
            FROM (SELECT DISTINCT case_id FROM status_requests WHERE new_status = 'InReview') asked
            JOIN onboarding_case USING (case_id) JOIN company USING (company_id)
            JOIN (SELECT * FROM required_documents WHERE is_mandatory AND applies_to_ubo) USING (legal_form_id)
            JOIN (SELECT DISTINCT company_id, ubo_id FROM ownership
                  WHERE ownership_percentage >= 25 AND NOT coalesce(valid_to < {AS_OF}, FALSE)) USING (company_id)
            WHERE (case_id, ubo_id, document_type_id) NOT IN (
                SELECT (case_id, ubo_id, document_type_id) FROM live_docs WHERE ubo_id IS NOT NULL)""",
        "status_requests",
        "onboarding_case",
        "company",
        "required_documents",
        "ownership",
        "live_docs",
    ),
    "reportable_owners_listed": _sql(
        """SELECT case_id, company_id, case_open_date, ubo_id, ownership_percentage
           FROM onboarding_case JOIN ownership USING (company_id)
           WHERE case_id IN (SELECT case_id FROM status_requests WHERE new_status = 'InReview')
             AND ownership_percentage >= 25
             AND case_open_date BETWEEN coalesce(valid_from, case_open_date) AND coalesce(valid_to, case_open_date)""",
        "status_requests",
        "onboarding_case",
        "ownership",
    ),
    "holdings_at_openings": _sql(
        """SELECT case_id, count(*) AS holdings, count(DISTINCT ubo_id) AS owners,
                  CAST(sum(ownership_percentage) AS DECIMAL(18,2)) AS total_percentage
           FROM onboarding_case JOIN ownership USING (company_id)
           WHERE ownership_percentage >= 25
             AND case_open_date BETWEEN coalesce(valid_from, case_open_date) AND coalesce(valid_to, case_open_date)
           GROUP BY case_id""",
        "onboarding_case",
        "ownership",
    ),
    # All holdings without those that ended before the moment asked about (a day ends as it begins).
    "active_ubos": _sql(
        f"""SELECT company_id, ubo_id, first_name, last_name, concat(first_name, ' ', last_name) AS full_name,
                   date_of_birth, nationality, ownership_percentage,
                   if(is_ownership_direct, 'Direct', 'Indirect') AS ownership_type, valid_from, valid_to,
                   ifnull(ownership_percentage, 0) >= 25 AS is_reportable
            FROM ownership JOIN ubo USING (ubo_id)
            WHERE NOT coalesce(valid_to < {AS_OF}, FALSE)""",
        "ubo",
        "ownership",
    ),
    "ownership_as_of": _sql(
        f"""SELECT * FROM ownership
            WHERE (valid_from IS NULL OR valid_from <= {OWNERSHIP_DAY})
              AND (valid_to IS NULL OR valid_to >= {OWNERSHIP_DAY})""",
        "ownership",
    ),
    "reportable_at_onboarding": _sql(
        """SELECT company_id, ubo_id, ownership_percentage, valid_from, valid_to, cases_opened
           FROM (SELECT o.*, (SELECT count(*) FROM onboarding_case oc
                              WHERE oc.company_id = o.company_id
                                AND (o.valid_from IS NULL OR o.valid_from <= oc.case_open_date)
                                AND (o.valid_to IS NULL OR o.valid_to >= oc.case_open_date)) AS cases_opened
                 FROM ownership o WHERE o.ownership_percentage >= 25)
           WHERE cases_opened > 0""",
        "onboarding_case",
        "ownership",
    ),
    "ownership_direct_indirect": _sql(
        """SELECT company_id,
                  count(CASE WHEN is_ownership_direct THEN 1 END) AS direct_holdings,
                  count(CASE WHEN NOT is_ownership_direct THEN 1 END) AS indirect_holdings,
                  CAST(coalesce(sum(CASE WHEN is_ownership_direct THEN ownership_percentage END), 0)
                       AS DECIMAL(18,2)) AS direct_percentage,
                  CAST(coalesce(sum(CASE WHEN NOT is_ownership_direct THEN ownership_percentage END), 0)
                       AS DECIMAL(18,2)) AS indirect_percentage
           FROM ownership GROUP BY company_id""",
        "ownership",
    ),
    "compliance_review_report": _sql(
        f"""SELECT case_id, company_name,
                   CASE WHEN advances THEN 'InReview' ELSE case_status END AS case_status,
                   missing AS missing_mandatory,
                   CASE WHEN advances THEN {_quote(ADVANCED)}
                        WHEN missing = 0 THEN {_quote(READY)}
                        WHEN missing = 1 THEN {_quote(ONE_MISSING)}
                        ELSE {_wrap(MANY_MISSING, _text('missing'))} END AS recommendation
            FROM reviewed ORDER BY missing_mandatory DESC, case_id""",
        "reviewed",
    ),
    "review_case_updates": _sql(
        "SELECT case_id, case_status AS old_status, 'InReview' AS new_status FROM reviewed WHERE advances",
        "reviewed",
    ),
    "cases_after_review": _sql(
        """SELECT oc.case_id, oc.company_id, oc.case_open_date,
                  CASE WHEN r.advances THEN 'InReview' ELSE oc.case_status END AS case_status
           FROM onboarding_case oc LEFT JOIN reviewed r ON r.case_id = oc.case_id""",
        "onboarding_case",
        "reviewed",
    ),
    "submit_document_verdicts": _sql(VERDICT_SQL, "ranked", "progressed"),
    "submit_new_documents": _sql(
        f"""SELECT new_document_id AS submitted_document_id, case_id, ubo_id, document_type_id,
                   {AS_OF_DAY} AS submission_date, 'Pending' AS document_status,
                   CAST(NULL AS DATE) AS verification_date
            FROM taken""",
        "taken",
    ),
    "submit_case_updates": _sql(
        f"""SELECT DISTINCT case_id, case_status AS old_status, 'InReview' AS new_status
            FROM progressed WHERE missing_after = 0 AND {_fold('case_status')} = 'open'""",
        "progressed",
    ),
    "status_update_verdicts": _sql(
        f"""SELECT r.request_id, r.case_id, r.new_status,
                   CASE WHEN w.request_id IS NULL THEN 'NOT_FOUND' WHEN w.ok THEN 'ACCEPTED'
                        ELSE 'INVALID' END AS code,
                   CASE WHEN w.request_id IS NULL THEN {_quote(NOT_FOUND)}
                        WHEN w.ok THEN {_wrap(UPDATED, _text('r.case_id'), _label('r.new_status'))}
                        ELSE {_wrap(INVALID, _label('w.old_status'), _label('r.new_status'))}
                   END AS message
            FROM status_requests r LEFT JOIN walk w ON w.request_id = r.request_id""",
        "status_requests",
        "walk",
    ),
    "status_changes": _sql("SELECT * FROM changes", "changes"),
    "cases_after_status_updates": _sql(
        """SELECT oc.case_id, oc.company_id, oc.case_open_date,
                  coalesce(l.new_status, oc.case_status) AS case_status
           FROM onboarding_case oc
           LEFT JOIN (SELECT case_id, arg_max(new_status, request_id) AS new_status
                      FROM changes GROUP BY case_id) l ON l.case_id = oc.case_id""",
        "onboarding_case",
        "changes",
    ),
    "status_change_documents": _sql("SELECT * EXCLUDE (changed) FROM documents_after", "documents_after"),
    "status_change_audit_checks": _sql("SELECT * FROM audit_rows", "audit_rows"),
    "checks_after_status_updates": _sql(
        """SELECT * FROM external_verification_check
           UNION ALL BY NAME
           SELECT (SELECT max(external_check_id) FROM external_verification_check)
                  + row_number() OVER (ORDER BY case_id) AS external_check_id, * FROM audit_rows""",
        "external_verification_check",
        "audit_rows",
    ),
    "workflow_verdicts": _sql(
        f"""SELECT request_id, kind, case_id, code,
                   CASE WHEN kind = 'status' AND code = 'NOT_FOUND' THEN {_quote(NOT_FOUND)}
                        WHEN kind = 'status' AND code = 'ACCEPTED'
                             THEN {_wrap(UPDATED, _text('case_id'), _label('asked_status'))}
                        WHEN kind = 'status'
                             THEN {_wrap(INVALID, _label('met'), _label('asked_status'))}
                        WHEN code = 'CASE_NOT_FOUND'
                             THEN {_wrap(CASE_NOT_FOUND, _text('case_id'))}
                        WHEN code = 'CASE_STATUS' THEN {_wrap(CASE_STATUS, _label('met'))}
                        WHEN code = 'TYPE_NOT_FOUND'
                             THEN {_wrap(TYPE_NOT_FOUND, _text('document_type_id'))}
                        WHEN code = 'DUPLICATE' THEN {_quote(DUPLICATE)}
                        WHEN code = 'UBO_NOT_REPORTABLE'
                             THEN {_wrap(UBO_NOT_REPORTABLE, _text('ubo_id'))}
                        WHEN missing_after = 0 THEN {COMPLETE_MESSAGE}
                        ELSE {_wrap(STILL_MISSING, _text('missing_after'))} END AS message,
                   CAST(coalesce(new_document_id, 0) AS BIGINT) AS new_document_id, missing_after,
                   CASE WHEN code = 'ACCEPTED' THEN now END AS new_status
            FROM handled""",
        "handled",
    ),
    "workflow_cases": _sql(
        """SELECT oc.case_id, oc.company_id, oc.case_open_date,
                  coalesce(l.now, oc.case_status) AS case_status
           FROM onboarding_case oc
           LEFT JOIN (SELECT case_id, arg_max(now, turn_no) AS now FROM acted GROUP BY case_id) l
             ON l.case_id = oc.case_id""",
        "onboarding_case",
        "acted",
    ),
    "workflow_documents": _sql(
        f"""SELECT d.submitted_document_id, d.case_id, d.ubo_id, d.document_type_id, d.submission_date,
                   CASE WHEN {_fold('d.document_status')} <> 'pending' OR e.now IS NULL THEN d.document_status
                        WHEN e.now = 'Approved' THEN 'Verified' ELSE 'Rejected' END AS document_status,
                   CASE WHEN {_fold('d.document_status')} = 'pending' AND e.now IS NOT NULL
                        THEN {AS_OF_DAY} ELSE d.verification_date END AS verification_date
            FROM (SELECT * FROM submitted_documents
                  UNION ALL
                  SELECT CAST(new_document_id AS BIGINT), case_id, ubo_id, document_type_id, {AS_OF_DAY},
                         'Pending', CAST(NULL AS DATE)
                  FROM handled WHERE new_document_id IS NOT NULL) d
            LEFT JOIN (SELECT case_id, now FROM handled
                       WHERE kind = 'status' AND code = 'ACCEPTED' AND now IN ('Approved', 'Rejected')) e
              ON e.case_id = d.case_id""",
        "submitted_documents",
        "handled",
    ),
    "audit_illegal_transitions": _sql(
        f"""SELECT r.request_id, r.case_id, oc.case_status AS old_status, r.new_status
            FROM status_requests r JOIN onboarding_case oc ON oc.case_id = r.case_id
            WHERE (r.new_status IS NULL OR {_fold('oc.case_status')} <> {_fold('r.new_status')})
              AND NOT {_allowed('oc.case_status', 'r.new_status')}""",
        "status_requests",
        "onboarding_case",
    ),
    "audit_ineligible_ubo_docs": _sql(
        """SELECT sd.submitted_document_id, sd.case_id, sd.ubo_id
           FROM submitted_documents sd LEFT JOIN onboarding_case oc ON oc.case_id = sd.case_id
           WHERE sd.ubo_id IS NOT NULL
             AND NOT EXISTS (SELECT 1 FROM ownership o
                             WHERE o.company_id = oc.company_id AND o.ubo_id = sd.ubo_id
                               AND o.ownership_percentage >= 25)""",
        "submitted_documents",
        "onboarding_case",
        "ownership",
    ),
    "audit_document_scope": _sql(
        f"""SELECT sd.submitted_document_id, sd.case_id, sd.ubo_id, sd.document_type_id, t.document_scope
            FROM submitted_documents sd JOIN document_type t ON t.document_type_id = sd.document_type_id
            WHERE ({_fold('t.document_scope')} = 'ubo') = (sd.ubo_id IS NULL)""",
        "submitted_documents",
        "document_type",
    ),
    "dq_primary_key": _sql(
        _union(
            [
                f"SELECT '{t.name}' AS table_name, CAST({t.key} AS VARCHAR) AS row_key, count(*) AS n_rows "
                f"FROM {t.name} GROUP BY {t.key} HAVING count(*) > 1 OR {t.key} IS NULL"
                for t in TABLES.values()
            ]
        ),
        *ALL,
    ),
    "dq_unique": _sql(
        _union(
            [
                f"SELECT '{t.name}' AS table_name, '{c}' AS column_name, min({c}) AS value, "
                f"count(*) AS n_rows FROM {t.name} GROUP BY {_fold(c)} HAVING count(*) > 1"
                for t in TABLES.values()
                for c in t.unique
            ]
        ),
        *ALL,
    ),
    "dq_not_null": _sql(
        _flags(
            {(t.name, c.name): f"{c.name} IS NULL" for t in TABLES.values() for c in t.columns if c.required},
            value=False,
        ),
        *ALL,
    ),
    "dq_domain": _sql(
        _flags(
            {(t, c): f"length({c}) > {most}" for t, columns in LENGTHS.items() for c, most in columns.items()}
        ),
        *ALL,
    ),
    "dq_check": _sql(_flags(CHECK_CONDITIONS), *ALL),
    "dq_foreign_key": _sql(
        _union(
            [
                f"SELECT '{t.name}' AS table_name, CAST(x.{t.key} AS VARCHAR) AS row_key, "
                f"'{c}' AS column_name, CAST(x.{c} AS VARCHAR) AS value FROM {t.name} x "
                f"WHERE x.{c} IS NOT NULL AND NOT EXISTS "
                f"(SELECT 1 FROM {parent} p WHERE p.{TABLES[parent].key} = x.{c})"
                for t in TABLES.values()
                for c, parent in t.foreign.items()
            ]
        ),
        *ALL,
    ),
    "dq_delete_guard": _sql(
        _union(
            [
                f"SELECT company_id, '{t.name}' AS child_table, '{c}' AS child_column FROM company d "
                f"WHERE d.annual_revenue < 0 AND EXISTS (SELECT 1 FROM {t.name} x WHERE x.{c} = d.company_id)"
                for t in TABLES.values()
                for c, parent in t.foreign.items()
                if parent == "company"
            ]
        ),
        *ALL,
    ),
    "dq_ownership_total": _sql(
        """SELECT company_id, CAST(sum(ownership_percentage) AS DECIMAL(18,2)) AS total_percentage
           FROM ownership GROUP BY company_id HAVING sum(ownership_percentage) > 100""",
        "ownership",
    ),
    "table_row_counts": _sql(
        _union([f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ALL]), *ALL
    ),
    "snapshot_roundtrip_counts": _sql(
        _union([f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ALL]), *ALL
    ),
    "append_with_defaults": _sql(
        f"""SELECT * FROM submitted_documents
            UNION ALL
            SELECT (SELECT max(submitted_document_id) FROM submitted_documents)
                   + row_number() OVER (ORDER BY request_id), case_id, ubo_id, document_type_id,
                   {AS_OF_DAY}, 'Pending', CAST(NULL AS DATE) FROM submit_requests""",
        "submitted_documents",
        "submit_requests",
    ),
    "staged_rejects": _sql(
        """SELECT 'ownership' AS table_name, CAST(ownership_id AS VARCHAR) AS row_key,
                  'ownership_percentage' AS column_name, CAST(ownership_percentage * 25 AS VARCHAR) AS value
           FROM ownership WHERE ownership_id % 10 = 3 AND ownership_percentage * 25 >= 1000
           UNION ALL
           SELECT 'ownership', CAST(ownership_id AS VARCHAR), 'valid_from', '1997-13-01'
           FROM ownership WHERE ownership_id % 10 = 7
           UNION ALL
           SELECT 'ownership', CAST(ownership_id AS VARCHAR), NULL,
                  CAST(ownership_id AS VARCHAR) || CASE ownership_id % 30 WHEN 8 THEN ',1'
                      WHEN 18 THEN ',1,2,30,true,1997-01-01,,more' ELSE ',1,2,"30,true,1997-01-01,' END
           FROM ownership WHERE ownership_id % 10 = 8""",
        "ownership",
    ),
    "staged_holdings": _sql(
        """SELECT * REPLACE (
               CAST(CASE ownership_id % 10 WHEN 3 THEN ownership_percentage * 25 ELSE ownership_percentage END
                    AS DECIMAL(5,2)) AS ownership_percentage,
               CASE ownership_id % 10 WHEN 5 THEN CAST(date_trunc('month', valid_from) AS DATE)
                    ELSE valid_from END AS valid_from)
           FROM ownership
           WHERE ownership_id % 10 <> 7 AND NOT (ownership_id % 10 = 3 AND ownership_percentage * 25 >= 1000)""",
        "ownership",
    ),
    "lookup_cases_by_status": _sql(
        f"SELECT * FROM onboarding_case WHERE {_fold('case_status')} = 'inreview'", "onboarding_case"
    ),
    "lookup_documents_by_case_status": _sql(
        f"SELECT * FROM submitted_documents WHERE case_id = 8 AND {_fold('document_status')} = 'pending'",
        "submitted_documents",
    ),
    "lookup_company_by_name": _sql(
        f"SELECT * FROM company WHERE {_fold('company_name')} = 'customer#000000042'", "company"
    ),
    "lookup_company_by_registration": _sql(
        f"SELECT * FROM company WHERE {_fold('registration_number')} = 'hr-42'", "company"
    ),
    "find_company_by_name": _sql(
        f"SELECT * FROM company WHERE {_fold('company_name')} = 'customer#000000042'", "company"
    ),
    "find_cases_by_status": _sql(
        f"SELECT * FROM onboarding_case WHERE {_fold('case_status')} = 'inreview'", "onboarding_case"
    ),
    "lookup_ubo_by_last_name": _sql("SELECT * FROM ubo WHERE rtrim(last_name) = '000000007'", "ubo"),
    "lookup_ownership_by_company": _sql("SELECT * FROM ownership WHERE company_id = 42", "ownership"),
    "cases_by_jurisdiction": "",
    "archive_closed_cases": _sql(
        f"""SELECT *, CASE WHEN {_fold('case_status')} = 'closed' THEN 'archive' ELSE 'running'
                      END AS stored_in FROM onboarding_case""",
        "onboarding_case",
    ),
    # Users with the role of their nation and the login of their number; roles have neither.
    "archive_closed_documents": _sql(
        f"""SELECT *, CASE WHEN case_id IN (SELECT case_id FROM onboarding_case
                                            WHERE {_fold('case_status')} = 'closed')
                           THEN 'archive' ELSE 'running' END AS stored_in FROM submitted_documents""",
        "onboarding_case",
        "submitted_documents",
    ),
    "access_roster": f"""
        WITH people AS (
            SELECT s_name AS principal, 'SQL_USER' AS type_desc, 'S' AS letter,
                   (SELECT any_value(c_name) FROM customer WHERE c_custkey = s_suppkey AND c_acctbal > 0) AS login,
                   (SELECT any_value(n_name) FROM nation WHERE n_nationkey = s_nationkey) AS member_of_role
            FROM supplier
            UNION ALL BY NAME
            SELECT n_name AS principal, 'DATABASE_ROLE' AS type_desc, 'R' AS letter FROM nation)
        SELECT principal, type_desc, ifnull(login, '-') AS login, ifnull(member_of_role, '-') AS member_of_role
        FROM people
        WHERE {_in_list('letter', LISTED_TYPES)} AND NOT {_in_list('principal', SYSTEM_NAMES)}
        ORDER BY type_desc, principal""",
    "sql_scalar_functions": _sql(
        f"""SELECT oc.case_id, {_label('oc.case_status')} AS status_label, m.missing
            FROM onboarding_case oc JOIN missing m ON m.case_id = oc.case_id""",
        "onboarding_case",
        "missing",
    ),
    "sql_ubos_by_company": _sql(
        f"""SELECT c.company_id, u.ubo_id, u.first_name || ' ' || u.last_name AS full_name,
                   o.ownership_percentage, o.ownership_percentage >= 25 AS is_reportable
            FROM company c JOIN ownership o ON o.company_id = c.company_id
            JOIN ubo u ON u.ubo_id = o.ubo_id
            WHERE o.valid_to IS NULL OR CAST(o.valid_to AS TIMESTAMP) >= {AS_OF}""",
        "company",
        "ownership",
        "ubo",
    ),
    "stream_status_change_checks": _sql("SELECT * FROM audit_rows", "audit_rows"),
    "stream_document_updates": _sql(
        """SELECT submitted_document_id, case_id, document_status, verification_date
           FROM documents_after WHERE changed""",
        "documents_after",
    ),
}
ORACLE["stream_workflow_verdicts"] = ORACLE["workflow_verdicts"]
ORACLE["cases_by_jurisdiction"] = ORACLE["onboarding_overview"]
ORACLE["stream_keyed_verdicts"] = ORACLE["workflow_verdicts"]


def _late_verdicts() -> str:
    """The walk over the requests that are not late, numbered by the time at which they were made."""
    wait, cuts = 3 * 86_400_000, ("2024-01-11", "2024-01-21")
    timed = f"""
        SELECT r.*, epoch_ms(e.ts) + r.request_id % 2 AS received,
               epoch_ms(e.ts) + r.request_id % 2 - CAST(floor(e.value * 100) AS BIGINT) * 36000 AS requested
        FROM all_requests r JOIN events e ON e.event_id = r.request_id // 2"""
    parts = " + ".join(f"(received >= epoch_ms(TIMESTAMP '{day}'))::INT" for day in cuts)
    clocked = f"""
        SELECT *, coalesce(requested + {wait} <= (SELECT max(b.received) FROM parted b WHERE b.part < a.part), FALSE) AS late
        FROM parted a"""
    numbered = "SELECT *, row_number() OVER (ORDER BY requested, request_id) AS turn FROM clocked WHERE NOT late"
    by_turn = "SELECT turn AS request_id, kind, case_id, document_type_id, ubo_id, new_status FROM numbered"
    before = f"workflow_requests AS ({DOMAIN['workflow_requests']})"
    after = ",\n".join(
        f"{name} AS ({body})"
        for name, body in {
            "all_requests": DOMAIN["workflow_requests"],
            "timed": timed,
            "parted": f"SELECT *, {parts} AS part FROM timed",
            "clocked": clocked,
            "numbered": numbered,
            "workflow_requests": by_turn,
        }.items()
    )
    walked = ORACLE["workflow_verdicts"].replace(before, after)
    head, body = walked.rsplit("\nSELECT request_id, kind", 1)
    return f"""{head}
        SELECT n.request_id, w.kind, w.case_id, w.code, w.message, w.missing_after, w.new_status
        FROM (SELECT request_id, kind{body}) w JOIN numbered n ON n.turn = w.request_id
        UNION ALL
        SELECT request_id, kind, case_id, 'LATE', NULL, NULL, NULL FROM clocked WHERE late"""


ORACLE["stream_late_verdicts"] = _late_verdicts()

ORACLE["published_documents"] = f"""
    SELECT submitted_document_id, case_id, ubo_id, document_type_id, submission_date, document_status, verification_date
    FROM ({_sql("SELECT * FROM submitted_documents", "submitted_documents")})
    UNION ALL BY NAME
    SELECT * FROM ({ORACLE["submit_new_documents"]})"""
ORACLE["published_checks"] = ORACLE["checks_after_status_updates"]
ORACLE["published_review"] = ORACLE["cases_after_review"]


def _captured_changes() -> str:
    """Rows that one version has more often than the other, counted by key."""
    versions, parts = [], []
    tables = {
        "onboarding_case": ("case_id", "cases_after_status_updates"),
        "submitted_documents": ("submitted_document_id", "status_change_documents"),
        "external_verification_check": ("external_check_id", "checks_after_status_updates"),
    }
    for name, (key, after) in tables.items():
        versions.append(f"old_{name} AS ({_sql(f'SELECT * FROM {name}', name)})")
        versions.append(f"all_{name} AS ({ORACLE[after]})")
    for name, (key, _) in tables.items():
        versions.append(
            f"""new_{name} AS (SELECT * FROM all_{name} WHERE coalesce(case_id NOT IN (
                    SELECT case_id FROM all_onboarding_case WHERE {_fold('case_status')} = 'closed'), TRUE))"""
        )
        columns = ", ".join(c.name for c in TABLES[name].columns)
        lost, gained = (
            f"(SELECT {columns} FROM {a}_{name} EXCEPT ALL SELECT {columns} FROM {b}_{name})" for a, b in (("old", "new"), ("new", "old"))
        )
        parts.append(
            f"""SELECT '{name}' AS table_name, {key} AS row_key,
                       CASE WHEN sum(o) = 0 THEN 'insert' WHEN sum(n) = 0 THEN 'delete' ELSE 'update' END AS change,
                       sum(o)::BIGINT AS n_old, sum(n)::BIGINT AS n_new
                FROM (SELECT {key}, 1 AS o, 0 AS n FROM {lost} UNION ALL SELECT {key}, 0, 1 FROM {gained}) GROUP BY {key}"""
        )
    return f"WITH {', '.join(versions)}\n{_union(parts)}"


ORACLE["captured_changes"] = _captured_changes()


def _captured(body: str, *needs: str) -> str:
    """``body`` over `moved`: the cases whose status differs between the two versions, whatever lay between."""
    moved = f"""
        SELECT a.case_id, o.case_status AS old_status, a.case_status AS new_status
        FROM ({ORACLE["cases_after_status_updates"]}) a
        JOIN ({_sql("SELECT * FROM onboarding_case", "onboarding_case")}) o ON o.case_id = a.case_id
        WHERE {_fold('o.case_status')} IS DISTINCT FROM {_fold('a.case_status')}"""
    told = f"SELECT * FROM moved WHERE {_fold('new_status')} IN ('approved', 'rejected')"
    return _sql(body, *needs).replace("WITH RECURSIVE ", f"WITH RECURSIVE moved AS ({moved}),\ntold AS ({told}),\n", 1)


ORACLE["captured_document_updates"] = _captured(
    f"""SELECT d.submitted_document_id, d.case_id, d.ubo_id, d.document_type_id, d.submission_date,
               CASE WHEN t.case_id IS NULL OR {_fold('d.document_status')} <> 'pending' THEN d.document_status
                    WHEN {_fold('t.new_status')} = 'approved' THEN 'Verified' ELSE 'Rejected' END AS document_status,
               CASE WHEN t.case_id IS NULL OR {_fold('d.document_status')} <> 'pending' THEN d.verification_date
                    ELSE {AS_OF_DAY} END AS verification_date
        FROM submitted_documents d LEFT JOIN told t ON t.case_id = d.case_id""",
    "submitted_documents",
)
ORACLE["captured_audit_checks"] = _captured(
    f"""SELECT external_check_id, case_id, external_source_id, check_date, check_status, result_summary
        FROM external_verification_check
        UNION ALL
        SELECT (SELECT max(external_check_id) FROM external_verification_check) + row_number() OVER (ORDER BY case_id),
               case_id, 1, {AS_OF_DAY},
               CASE WHEN {_fold('new_status')} = 'approved' THEN 'Passed' ELSE 'Failed' END,
               {_quote(CHECK_SUMMARY[0])} || new_status || {_quote(CHECK_SUMMARY[1])} || old_status || {_quote(CHECK_SUMMARY[2])}
        FROM told WHERE case_id NOT IN (SELECT case_id FROM external_verification_check)""",
    "external_verification_check",
)
ORACLE["captured_illegal_transitions"] = _captured(
    f"SELECT * FROM moved WHERE NOT coalesce({_allowed('old_status', 'new_status')}, FALSE)", "country"
)


def _digest_rows(name: str, source: str) -> str:
    told = ", '|', ".join(
        f"coalesce(length(CAST({c.name} AS VARCHAR)) || ':' || CAST({c.name} AS VARCHAR), '-')" for c in TABLES[name].columns
    )
    return f"""SELECT '{name}' AS table_name, coalesce({TABLES[name].key} % 64 + CASE WHEN {TABLES[name].key} % 64 < 0 THEN 64 ELSE 0 END, 0)::BIGINT
                      AS bucket, md5(concat({told})) AS md5 FROM ({source})"""


ORACLE["snapshot_digests"] = f"""
    SELECT table_name, bucket, count(*) AS n, CAST(sum(('0x' || substr(md5, 1, 15))::HUGEINT) AS VARCHAR) AS low,
           CAST(sum(('0x' || substr(md5, 16, 15))::HUGEINT) AS VARCHAR) AS high
    FROM ({_union([
        _digest_rows(name, ORACLE["cases_after_status_updates"] if name == "onboarding_case" else _sql(f"SELECT * FROM {name}", name))
        for name in TABLES
    ])}) GROUP BY table_name, bucket"""
