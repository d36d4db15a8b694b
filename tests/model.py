"""One-request-at-a-time models of the two procedures, in plain Python."""

from casewright.functions.rules import STATUS_LABELS, TRANSITIONS, UNKNOWN_STATUS_LABEL
from casewright.operators import lifecycle, submissions


def fold(text):
    return None if text is None else text.rstrip(" ").lower()


def label(status):
    return {k.lower(): v for k, v in STATUS_LABELS.items()}.get(fold(status), UNKNOWN_STATUS_LABEL)


def run_status_requests(requests, status):
    """``requests``: (id, case, target) in any order; ``status``: case -> status, updated in place."""
    allowed = {(a.lower(), b.lower()) for a, targets in TRANSITIONS.items() for b in targets}
    out, changes = {}, []
    for rid, case, target in sorted(requests):
        if status.get(case) is None:
            out[rid] = ("NOT_FOUND", lifecycle.NOT_FOUND)
        elif (fold(status[case]), fold(target)) in allowed:
            changes.append((rid, case, status[case], target))
            status[case] = target
            out[rid] = ("ACCEPTED", f'OK – Status von Case {case} auf "{label(target)}" gesetzt.')
        else:
            a, b = label(status[case]), label(target)
            out[rid] = ("INVALID", f'Fehler: Ungültiger Statusübergang von "{a}" nach "{b}".')
    return out, changes


class World:
    """The tables as plain rows, changed by one call after the other."""

    def __init__(self, rows):
        self.rows = rows
        self.case = {r["case_id"]: dict(r) for r in rows["onboarding_case"]}
        self.form = {r["company_id"]: r["legal_form_id"] for r in rows["company"]}
        self.types = {r["document_type_id"] for r in rows["document_type"]}
        self.documents = [dict(r) for r in rows["submitted_documents"]]
        self.checked = {r["case_id"] for r in rows["external_verification_check"]}
        self.last_id = max((d["submitted_document_id"] for d in self.documents), default=0)

    def missing(self, case_id):
        live = {
            d["document_type_id"]
            for d in self.documents
            if d["case_id"] == case_id and fold(d["document_status"]) != "rejected"
        }
        return sum(
            r["legal_form_id"] == self.form[self.case[case_id]["company_id"]]
            and r["is_mandatory"]
            and not r["applies_to_ubo"]
            and r["document_type_id"] not in live
            for r in self.rows["required_documents"]
        )

    def set_status(self, case_id, status):
        old = self.case[case_id]["case_status"]
        self.case[case_id]["case_status"] = status
        decision = {"approved": "Verified", "rejected": "Rejected"}.get(fold(status))
        if decision and fold(old) != fold(status):
            self.checked.add(case_id)
            for d in self.documents:
                if d["case_id"] == case_id and fold(d["document_status"]) == "pending":
                    d["document_status"] = decision

    def update(self, case_id, target):
        status = {c: r["case_status"] for c, r in self.case.items() if c == case_id}
        out, changes = run_status_requests([(0, case_id, target)], status)
        for _, c, _, new in changes:
            self.set_status(c, new)
        return out[0]

    def submit(self, c, t, u):
        if c not in self.case:
            return "CASE_NOT_FOUND", None if c is None else f"Fehler: CaseID {c} existiert nicht.", 0, None, None
        current = self.case[c]["case_status"]
        if fold(current) not in ("open", "inreview"):
            message = submissions.CASE_STATUS[0] + label(current) + submissions.CASE_STATUS[1]
            return "CASE_STATUS", message, 0, None, None
        if t not in self.types:
            message = None if t is None else f"Fehler: DocumentTypeID {t} existiert nicht."
            return "TYPE_NOT_FOUND", message, 0, None, None
        if any(
            (d["case_id"], d["document_type_id"], d["ubo_id"]) == (c, t, u)
            and fold(d["document_status"]) != "rejected"
            for d in self.documents
        ):
            return "DUPLICATE", submissions.DUPLICATE, 0, None, None
        if u is not None and not any(
            (o["company_id"], o["ubo_id"]) == (self.case[c]["company_id"], u) and o["ownership_percentage"] >= 25
            for o in self.rows["ownership"]
        ):
            message = submissions.UBO_NOT_REPORTABLE[0] + str(u) + submissions.UBO_NOT_REPORTABLE[1]
            return "UBO_NOT_REPORTABLE", message, 0, None, None
        self.last_id += 1
        self.documents.append(
            dict(case_id=c, document_type_id=t, ubo_id=u, document_status="Pending", submitted_document_id=self.last_id)
        )
        left = self.missing(c)
        if left == 0:
            if fold(current) == "open":
                self.set_status(c, "InReview")
            message = submissions.COMPLETE
        else:
            message = submissions.STILL_MISSING[0] + str(left) + submissions.STILL_MISSING[1]
        return "ACCEPTED", message, self.last_id, left, self.case[c]["case_status"]


def run_submissions(requests, rows):
    """``requests``: (id, case, type, owner); ``rows``: table name -> list of dicts."""
    world = World(rows)
    out = {rid: world.submit(c, t, u) for rid, c, t, u in sorted(requests, key=lambda r: r[0])}
    return out, {c: r["case_status"] for c, r in world.case.items()}


def run_feed(requests, rows):
    """``requests``: (id, kind, case, type, owner, target), handled in id order."""
    world, out = World(rows), {}
    for rid, kind, c, t, u, target in sorted(requests, key=lambda r: r[0]):
        if kind == "submit":
            out[rid] = world.submit(c, t, u)
        else:
            code, message = world.update(c, target)
            out[rid] = (code, message, 0, None, target if code == "ACCEPTED" else None)
    return out, world
