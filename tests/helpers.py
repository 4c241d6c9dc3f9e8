"""Books of a few entries for rule tests. An entry is a base record with what a test changes."""

from datetime import date

from ledgerloom.model import Ledger
from ledgerloom.schema import ACCOUNTS, ENTRIES

META = {"approval_threshold_cents": 1_000_000, "fiscal_year_end": "2025-12-31", "fiscal_year_start": "2025-01-01", "seed": 77}
_KINDS = {"asset": "1210 Bank, 1340 Debtors", "liability": "2410 Creditors, 2520 Provisions", "revenue": "4050 Ticket sales", "expense": "7310 Repairs, 7420 Freight, 7550 Postage"}
CHART = [(*a.split(" ", 1), kind, "debit" if kind in ("asset", "expense") else "credit", True, None) for kind, names in _KINDS.items() for a in names.split(", ")]
BANK, CREDITORS, REPAIRS, FREIGHT = "1210", "2410", "7310", "7420"


def lines(*sides):
    """Lines from (account, cents) pairs; credits are negative."""
    return [(i, account, max(cents, 0), max(-cents, 0)) for i, (account, cents) in enumerate(sides, 1)]


def entry(n, amount=431_270, **change):
    """Entry E-n: a quiet repair bill, a Tuesday, approved by another person."""
    day = change.get("posted", "2025-06-10")
    credit = change.get("credit")
    value = {
        "entry_seq": n, "entry_id": f"E-{n}", "posting_date": date.fromisoformat(day), "effective_date": date.fromisoformat(change.get("effective", day)),
        "description": change.get("text", "Repair of the loading dock gate"), "source": change.get("source", "GL"),
        "preparer_id": change.get("preparer", "P-01"), "approver_id": change.get("approver", "A-01"),
        "lines": lines((change.get("dr", REPAIRS), amount), (change.get("cr", BANK), -(amount if credit is None else credit))),
        "document": change.get("document"),
    }
    return tuple(value[f.name] for f in ENTRIES.fields)


def invoice(n, ref="INV-10001", vendor="V-01", cents=284_915, doc="2025-03-10", posted="2025-03-10", kind="invoice"):
    """A vendor's invoice, or the credit memo that undoes one."""
    dr, cr = (FREIGHT, CREDITORS)[:: 1 if kind == "invoice" else -1]
    return entry(n, cents, dr=dr, cr=cr, text=f"{vendor} {ref}", source="AP", posted=posted, document=(kind, vendor, ref, date.fromisoformat(doc)))


def ledger(spark, entries, meta=META, chart=CHART):
    return Ledger(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(chart, ACCOUNTS), None, dict(meta))


def flagged(rule, book):
    """The rule's flags by the number in the entry's id."""
    return {int(r["entry_id"].removeprefix("E-")): r for r in rule.flags(book).collect()}
