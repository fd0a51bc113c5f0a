"""A small insurance feed, built by rule: 30 customers, 40 policies, 50 claims."""

from datetime import datetime, timedelta

B1, B2, B3 = "BATCH_20260901_001", "BATCH_20260915_002", "BATCH_20260920_003"
START = datetime(2026, 7, 17, 4, 52)

CUSTOMER = "CUSTOMER_ID string, CUSTOMER_NAME string, EMAIL string, PHONE_NUMBER string, " \
    "CITY string, LAST_UPDATED_TS string"
POLICY = "POLICY_ID string, CUSTOMER_ID string, POLICY_NUMBER string, POLICY_TYPE string, " \
    "POLICY_STATUS string, PREMIUM_AMOUNT string, SUM_INSURED string, ISSUE_DATE string, " \
    "EXPIRY_DATE string, LAST_UPDATED_TS string"
CLAIM = "CLAIM_ID string, POLICY_ID string, CUSTOMER_ID string, CLAIM_DATE string, " \
    "CLAIM_AMOUNT string, APPROVED_AMOUNT string, CLAIM_STATUS string, INCIDENT_TYPE string, " \
    "LAST_UPDATED_TS string"


def _stamp(i, n):
    return str(START + timedelta(hours=i * 1080 // n))


def customers(n=30):
    cities = ["new-delhi", "Pune", " jaipur", "MUMBAI"]
    return [(f"C{1001 + i}", f" Person{i % 7} Name{i}", f"Person{i}@Example.com ",
             f"+91710{7420369 + i}", cities[i % 4], _stamp(i, n)) for i in range(n)]


def policies(n=40):
    kinds, states = ["AUTO", "home", " HEALTH ", "LIFE"], ["A", "I", "C", "L"]
    out = []
    for i in range(n):
        premium = "12000.00" if i == 4 else f"{5000 + 137 * i}.{i % 100:02d}"
        out.append((f"P{1001 + i}", f"C{1001 + i * 7 % 30}", f"PN-{i}", kinds[i % 4],
                    states[i // 3 % 4], premium, f"{100000 + i}.00", f"2025-02-{1 + i % 28:02d}",
                    f"2026-02-{1 + i % 28:02d}", _stamp(i, n)))
    return out


def claims(n=50):
    states = ["P", "A", "R", "S"]
    out = []
    for i in range(n):
        policy = "P1002" if i == 9 else f"P{1001 + i * 3 % 40}"
        out.append((f"CL{1001 + i}", policy, f"C{1001 + i % 30}", "2025-06-15",
                    f"{1000 + 10 * i}.50", None if i % 11 == 5 else f"{400 + 7 * i}.25",
                    "A" if i == 6 else states[i % 4], "Fire", _stamp(i, n)))
    return out


def changed(data, ddl, column, value, n=None):
    """The first n rows with one column replaced."""
    i = [c.split()[0] for c in ddl.split(", ")].index(column)
    return [tuple(value if j == i else v for j, v in enumerate(r)) for r in data[:n]]
