"""Clause wordings the clause view is built from, each with its expected reading.

Placeholders take values from the order the clause hangs on, so the texts vary with the data:
``{n}`` 10..209, ``{m}`` 14..33, ``{h}`` 7..9, ``{p}`` 25/50/75, ``{k}`` 6..35. The expected
reading is SQL over the same values (``pd`` is the contract's probation), written by hand, and
is the oracle of the detectors.
"""

from __future__ import annotations

LIMIT = "CASE WHEN {x}>180 THEN '{void}' WHEN {x}=180 THEN '{even}' ELSE '{kind}' END"


def _prob(x: str) -> tuple[str, str, str]:
    return (
        f"CASE WHEN {x}>180 THEN 'likely_void' WHEN {x}=180 THEN 'compliant' WHEN {x}<180 THEN 'better_than_law' END",
        f"CASE WHEN {x}>180 THEN 'high' ELSE 'none' END",
        "'high'",
    )


# (English, Arabic, [(rule, verdict SQL, severity SQL, confidence SQL)], stated types)
LIBRARY: list[tuple[str, str | None, list[tuple[str, str, str, str]], str]] = [
    ("The probation period shall be {n} days.", None, [("PROB-MAX-01", *_prob("n"))], ""),
    ("The probationary period may be extended by {n} days.", None, [("PROB-MAX-01", *_prob("(coalesce(pd,0)+n)"))], ""),
    ("The probation may be renewed once.", None, [("PROB-MAX-01", *_prob("(pd*2)"))], ""),
    (
        "The employee is entitled to {m} days of annual leave each year.", None,
        [("LEAVE-MIN-01", "CASE WHEN m<21 THEN 'likely_void' WHEN m=21 THEN 'compliant' ELSE 'better_than_law' END", "CASE WHEN m<21 THEN 'high' ELSE 'none' END", "'high'")], "",
    ),
    ("Annual leave must be taken within the same calendar year and may not be carried forward.", None, [("LEAVE-FORFEIT-01", "'unclear'", "'low'", "'high'")], ""),
    ("Any unused annual leave shall be forfeited without compensation.", None, [("LEAVE-FORFEIT-01", "'likely_void'", "'medium'", "'high'")], ""),
    (
        "Working hours are {h} hours a day and six days a week.", None,
        [("HOURS-MAX-01", "CASE WHEN h>8 THEN 'likely_void' WHEN h=8 THEN 'compliant' ELSE 'better_than_law' END", "CASE WHEN h>8 THEN 'high' ELSE 'none' END", "'high'")], "",
    ),
    ("Overtime is compensated by time off in lieu at the discretion of the employer.", None, [("OT-RATE-01", "'likely_void'", "'high'", "'high'")], ""),
    (
        "Overtime is paid at {p}% of the basic hourly wage.", None,
        [("OT-RATE-01", "CASE WHEN p<50 THEN 'likely_void' WHEN p=50 THEN 'compliant' ELSE 'better_than_law' END", "CASE WHEN p<50 THEN 'high' ELSE 'none' END", "CASE WHEN p<50 THEN 'high' ELSE 'medium' END")], "",
    ),
    ("The end-of-service award shall be calculated on the basis of the basic salary only.", None, [("EOS-BASE-01", "'likely_void'", "'high'", "'high'")], ""),
    ("End-of-service benefits are based on the last actual wage including all allowances.", None, [("EOS-BASE-01", "'compliant'", "'none'", "'high'")], ""),
    (
        "A party that ends this contract early without a legitimate reason shall pay the other party two (2) months’ basic salary as compensation.", None,
        [("COMP-ART77-01", "'worse_than_default'", "'medium'", "'high'")], "",
    ),
    (
        "This contract is for an unlimited period and ends upon completion of the project in accordance with Article 57 of the Labor Law.", None,
        [("TYPE-ART57-01", "'unclear'", "'high'", "'high'")], "specific_work,indefinite",
    ),
    ("The employer may transfer the employee to any of its branches anywhere in the Kingdom.", None, [("TRANSFER-KSA-01", "'worse_than_default'", "'medium'", "'high'")], ""),
    ("The employer may transfer the employee to another city only with the written consent of the employee.", None, [("TRANSFER-KSA-01", "'compliant'", "'none'", "'medium'")], ""),
    ("For three (3) years following the termination of employment, the employee shall not join any competitor anywhere.", None, [("NONCOMPETE-01", "'likely_void'", "'high'", "'high'")], ""),
    (
        "For {k} months after the end of the contract the employee shall not work for a competitor in Riyadh in the same role, because the job gives access to the employer’s clients.", None,
        [("NONCOMPETE-01", "CASE WHEN k>24 THEN 'likely_void' ELSE 'compliant' END", "CASE WHEN k>24 THEN 'high' ELSE 'none' END", "'high'")], "",
    ),
    ("The employee is not allowed to share the company's information or documents with others.", None, [("CONFIDENTIAL-01", "'unclear'", "'low'", "'medium'")], ""),
    ("The employee shall keep all company data confidential for two years after leaving.", None, [("CONFIDENTIAL-01", "'compliant'", "'none'", "'medium'")], ""),
    ("This contract supersedes all prior agreements between the parties.", None, [], ""),
    ("Salaries are paid through the bank at the end of each month.", None, [], ""),
    ("", "تُحسب مكافأة نهاية الخدمة على أساس الراتب الأساسي فقط.", [("EOS-BASE-01", "'likely_void'", "'high'", "'medium'")], ""),
    ("", "يجوز لصاحب العمل نقل الموظف إلى أي من فروعها داخل المملكة.", [("TRANSFER-KSA-01", "'worse_than_default'", "'medium'", "'medium'")], ""),
    ("The employee must work overtime whenever the work requires it.", None, [("OT-RATE-01", "'unclear'", "'medium'", "'high'")], ""),
    ("Employment is for a fixed term of one year.", None, [], "fixed_term"),
    (
        "The contract ends when the site project is completed and the completion certificate is issued, as defined in Annex A.", None,
        [("TYPE-ART57-01", "'compliant'", "'none'", "'medium'")], "specific_work",
    ),
    ("Employees hired for the site receive a meal allowance each month.", None, [], ""),
    ("The probation is 90 days. It may be extended by 60 days with notice of 15 days.", None, [("PROB-MAX-01", "'better_than_law'", "'none'", "'high'")], ""),
    ("Working hours in Ramadan shall be 7 hours a day.", None, [("HOURS-MAX-01", "'likely_void'", "'high'", "'high'")], ""),
    ("Annual leave is 21 days, and 25 days after five years of service.", None, [("LEAVE-MIN-01", "'likely_void'", "'high'", "'high'")], ""),
    ("Compensation for terminating this contract without a valid reason is fixed at {k} months of the total wage.", None, [("COMP-ART77-01", "'worse_than_default'", "'medium'", "'high'")], ""),
]


def sql_text(text: str | None) -> str:
    return "CAST(NULL AS {s})" if text is None else "'" + text.replace("'", "''") + "'"
