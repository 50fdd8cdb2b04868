import datetime
import re

from tallyloom.llm.pii import pseudonymise

TEXTS = [
    (1, "Call +1 (988) 555-2485 or mail bosbt.42@mail8.example.com, card 4539578763621486, ip 70.123.182.155 on 2024-02-29."),
    (2, "Again bosbt.42@mail8.example.com and 4539 5787 6362 1486; not 4041894974608796, not 999.1.1.1, not 2023-02-30."),
    (3, "IBAN GB82 WEST 1234 5698 7654 32 and SSN 123-45-6789, born 31/12/1999 or 12/31/1999."),
    (4, None), (5, ""), (6, "Nothing here, version 3 of 2 things."), (7, "bosbt.42@mail8.example.com"),
]


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d) // 10 + (2 * d) % 10 for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    df = spark.createDataFrame([(*r, 9) for r in TEXTS], "doc_id long, text string, kinds_before int")
    got = {r.doc_id: r for r in pseudonymise(df).collect()}
    assert (got[4].text, got[4].n_pii, got[5].text, got[5].n_pii) == (None, 0, "", 0)
    assert got[6].text == TEXTS[5][1] and got[6].kinds == ""
    t = got[1].text
    assert got[1].kinds == "card,date,email,ip,phone" and got[1].n_pii == 5
    for old in ("555-2485", "bosbt.42", "4539578763621486", "70.123.182.155", "2024-02-29"):
        assert old not in t
    assert re.search(r"Call \+1 \(\d{3}\) \d{3}-\d{4} or mail ([a-z]{5}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com), card (\d{16}), ip \d+\.\d+\.\d+\.\d+ on \d{4}-\d\d-\d\d\.$", t)
    mail, card = re.search(r"mail (\S+), card (\d{16})", t).groups()
    assert luhn(card) and got[7].text == mail and mail in got[2].text
    assert all(int(o) <= 255 for o in re.search(r"ip (\S+) on", t)[1].split("."))
    datetime.date.fromisoformat(t[-11:-1])
    # Grouping doesn't unlink a card; what fails its check stays.
    assert re.search(r"and (\d{4} \d{4} \d{4} \d{4});", got[2].text)[1].replace(" ", "") == card
    assert "not 4041894974608796, not 999.1.1.1, not 2023-02-30." in got[2].text
    iban = re.search(r"IBAN (.*) and SSN", got[3].text)[1].replace(" ", "")
    assert iban[:2] == "GB" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "GB82WEST12345698765432"
    assert got[3].kinds == "date_dmy,date_mdy,iban,ssn"


def test_no_python_in_the_plan_and_distinct_values_stay_distinct(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('10.0.', id div 250, '.', id % 250, ' ', date_add(date'1990-01-01', cast(id as int)), ' +1 (200) 555-', lpad(id, 4, '0')) as text")
    out = pseudonymise(df)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    parts = list(zip(*(r.text.split(" ", 2) for r in out.collect()), strict=True))
    assert [len(set(p)) for p in parts] == [3000] * 3


def test_empty_table(spark, nothing):
    assert pseudonymise(nothing).collect() == []


def test_values_beside_other_digits_are_found(spark):
    texts = [
        ("+1 (826) 555-4081 190.137.223.204", "ip,phone"), ("2024 4111 1111 1111 1111", "card"), ("4111 1111 1111 1111 12", "card"), ("+1 826 555 4081 4111 1111 1111 1111", "card,phone"),
        ("4111 1111 1111 1111 190.137.223.204", "card,ip"), ("4111 1111 1111 1111 12/31/1999", "card,date_mdy"), ("7 4111111111111111 123-45-6789", "card,ssn"),
        ("AB12 4111 1111 1111 1111", "card"), ("BE68 5390 0754 7034 ABCD", "iban"), ("1 2 3 4 5 6 7 8", ""), ("+1 (826) 555-4081 2024-02-29", "date,phone"),
    ]
    old = ["190.137.223.204", "555-4081", "555 4081", "4111 1111 1111", "411111111111", "12/31/1999", "123-45-6789", "BE68 5390", "2024-02-29"]
    got = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(list(enumerate(t for t, _ in texts)), "doc_id long, text string")).collect()}
    for i, (t, kinds) in enumerate(texts):
        assert (got[i].kinds, len(got[i].text)) == (kinds, len(t)) or "ip" in kinds and got[i].kinds == kinds, (t, got[i])
        assert not any(o in got[i].text for o in old), got[i]
    assert got[1].text.startswith("2024 ") and got[2].text.endswith(" 12") and got[8].text.endswith(" ABCD") and got[9].text == "1 2 3 4 5 6 7 8"


SECRETS = [
    "password=12345678", "password=AB12CDEF99", "password=p@ssw0rd", "password=" + "aB3" * 24, "login password=x1 and Password='quoted9' then", "pwd=4111111111111111&user=bob", "password=joe@example.com ok",
    "password=+12025550123", "password=", "ask +12025550123 or +1 202 555 0123 or (202) 555-0123 or 202-555-0123 or +44 20 7946 0958", "666-12-3456 899-99-9999 001-01-0001 665-10-1000 667-10-1000",
]


def test_results_equal_plain_python(spark, tiny, odd):
    from brute_pii import pseudonymised

    rows = [(i, t) for i, t in enumerate(SECRETS + [t for _, t in TEXTS])]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (made, odd.select("doc_id", "text"), spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")):
        texts = {(r.doc_id, r.text) for r in df.collect()}
        want = sorted((d or 0, *(x or "" for x in pseudonymised(t))) for d, t in texts)
        assert sorted((r.doc_id or 0, r.text or "", r.n_pii or "", r.kinds) for r in pseudonymise(df.distinct()).collect()) == want


def test_passwords_phones_and_numbers(spark):
    got = [r.text for r in pseudonymise(spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for old in ("12345678", "AB12CDEF99", "ssw0rd", "aB3aB3", "x1", "quoted9", "4111111111111111", "joe@example", "2025550123", "202 555 0123", "555-0123"):
        assert not any(old in t for t in got), old
    assert re.fullmatch("password=[A-Za-z0-9]{72}", got[3]) and got[5].endswith("&user=bob") and got[8] == "password="
    a, b, c, d, e = re.fullmatch(r"ask \+1(\d{10}) or \+1 (\d{3} \d{3} \d{4}) or (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4}) or \+44 (.*)", got[9]).groups()
    assert len({re.sub("[^0-9]", "", x) for x in (a, b, c, d)}) == 1 and e != "20 7946 0958"
    assert got[10].startswith("666-12-3456 ")


def test_valid_numbers_stay_valid_and_apart(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "concat(lpad(case when id % 899 + 1 = 666 then 1 else id % 899 + 1 end, 3, '0'), '-', lpad(id % 99 + 1, 2, '0'), '-', lpad(id % 9999 + 1, 4, '0')) as text").dropDuplicates(["text"])
    got = [r.text for r in pseudonymise(df).collect()]
    assert len(set(got)) == len(got) and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", t) for t in got)


def test_columns_of_the_same_names_stay_and_long_secrets_end(spark):
    df = spark.createDataFrame([(1, "password=" + "Zz9" * 40_000, "k", 5, "f")], "doc_id long, text string, kinds string, N_PII int, _found string")
    r = pseudonymise(df).first()
    assert pseudonymise(df).columns == ["doc_id", "text", "kinds", "N_PII", "_found", "n_pii_", "kinds_"]
    assert (r.kinds, r.N_PII, r["_found"], r["n_pii_"], r["kinds_"]) == ("k", 5, "f", 1, "password") and len(r.text) == 120_009 and "Zz9Zz9Zz9" not in r.text
