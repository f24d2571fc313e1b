"""The twelve planted employees, header variants, rejected rows."""

from pactum.operators.wages import check_wages, issue_rows, summary
from pactum.sources import wage_files

RECORD = "employee_id string, name string, basic double, housing double, transport double, total double"
CONTRACTS = [
    ("1000000011", 11111, 2778, 1111, 15000), ("2000000012", 6000, 1500, 500, 8000), ("1000000013", 10000, 2500, 1000, 13500),
    ("2000000014", 7000, 1750, 700, 9450), ("1000000015", 11111, 2778, 1111, 15000), ("2000000016", 5000, 1250, 500, 6750),
    ("1000000018", 9000, 2250, 900, 12150), ("2000000019", 4000, 1000, 400, 5400), ("1000000020", 8000, 2000, 800, 10800),
    ("2000000021", 6000, 1500, 600, 8100), ("1000000022", 12000, 3000, 1200, 16200),
]
PAYROLL = [
    "1000000011,A,11111.00,2778.00,1111.00", "2000000012,B,6000.00,1500.00,500.00", "1000000013,C,9000.00,2500.00,2000.00",
    "2000000014,D,7000.00,0.00,700.00", "1000000015,E,10000.00,2500.00,1000.00", "2000000016,F,5500.00,1375.00,550.00",
    "2000000017,G,4000.00,1000.00,400.00", "2000000019,H,4000.00,1000.00,400.00", "1000000020,I,8000.00,2000.00,800.00",
    "2000000021,J,6000.00,1500.00,1850.00", "1000000022,K,12000.00,3000.00,1200.00",
]
EXPECTED = {
    "1000000013": {"payroll_differs:basic"},
    "2000000014": {"payroll_differs:housing", "underpaid:total"},
    "1000000015": {"payroll_differs:basic", "payroll_differs:housing", "payroll_differs:transport", "underpaid:total"},
    "2000000016": {"payroll_differs:basic", "payroll_differs:housing"},
    "2000000017": {"no_contract:None"},
    "1000000018": {"not_paid:total"},
    "1000000022": {"offer_differs:total"},
}


def lines(spark, *texts):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, pos int, line string")


def test_planted_employees(spark):
    contracts = spark.createDataFrame([(i, "n", *map(float, a)) for i, *a in CONTRACTS], RECORD)
    offers = spark.createDataFrame(
        [(i, "n", None, None, None, 17000.0 if i == "1000000022" else float(a[3])) for i, *a in CONTRACTS], RECORD
    )
    head = "﻿EmployeeID,EmployeeName,BasicSalary,HousingAllowance,OtherAllowances"
    payroll, rejected, bad = wage_files.read_payroll(lines(spark, head, *PAYROLL))
    assert rejected.count() == 0 and bad.count() == 0
    checked = check_wages(contracts, offers, payroll)
    got = {}
    for r in issue_rows(checked).collect():
        got.setdefault(r.employee_id, set()).add(f"{r.kind}:{r.field}")
        if r.employee_id == "1000000015" and r.kind == "underpaid":
            assert r.gap == -1500 and r.articles == ["61"]
    assert got == EXPECTED
    assert tuple(summary(checked).first()) == (12, 7)


def test_header_variants_and_rejects(spark):
    text = ["Payroll September", "رقم الهوية / الإقامة,الاسم,الراتب الأساسي,بدل السكن,بدلات أخرى", '١٠٠٠٠٠٠٠١١,"Khan, Imran",٦٬٥٠٠٫٥,"1,000",', ",Total,1,2,3", "1000000012,X,abc,1,2"]
    paid, rejected, bad = wage_files.read_payroll(lines(spark, *text))
    row = paid.first()
    assert (row.employee_id, row.name, row.basic, row.housing, row.transport, row.total) == ("1000000011", "Khan, Imran", 6500.5, 1000.0, 0.0, 7500.5)
    assert sorted(r.error.split(":")[0] for r in rejected.collect()) == ["A row has no EmployeeID", 'BasicSalary "abc" is not a number.']
    _, _, bad = wage_files.read_payroll(lines(spark, "EmployeeID,EmployeeName", "1,a"))
    assert bad.first().missing == ["BasicSalary", "HousingAllowance", "OtherAllowances"]
