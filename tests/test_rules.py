"""Golden cases of the rules: order, rounding, nulls and the quirks that results depend on."""

import random
from datetime import date
from decimal import Decimal
from difflib import get_close_matches

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as t
from ledgerloom.functions.similarity import Ratio, names_similar, sequence_ratio, text_ratio
from ledgerloom.operators import aggregate, catalog, classify, cluster, duplicates, parse, recurring, resolve, review, validate
from ledgerloom.schema import RELATIONSHIPS

LEDGER = "statement_id long, seq int, transaction_id string, txn_date date, amount decimal(15,2), direction string, narration string, reference_number string, balance decimal(18,2), opening_balance decimal(15,2)"


def ledger(spark, rows):
    """Rows: (amount, direction, balance), or dicts of columns."""
    out = []
    for i, r in enumerate(rows, 1):
        d = {"amount": r[0], "direction": r[1], "balance": r[2]} if isinstance(r, tuple) else r
        out.append((d.get("statement_id", 1), i, f"tx_{i:06d}", d.get("txn_date", date(2026, 1, 1)), Decimal(str(d.get("amount", 1))), d.get("direction", "DEBIT"), d.get("narration", "x"), d.get("reference_number"), None if d.get("balance") is None else Decimal(str(d["balance"])), Decimal(str(d.get("opening", 1000)))))
    return spark.createDataFrame(out, LEDGER)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (t.reference_v1, "REFERENCE 12345", "ERENCE"), (t.reference_v1, "REFUND X", "UND"), (t.reference_v1, "UTR: A1", "A1"), (t.reference_v1, "nothing", None),
        (t.payment_mode_v1, "COFFEE", "BANK_CHARGE"), (t.payment_mode_v1, "UPI-john@ybl", "UPI"), (t.payment_mode_v1, "a@b", "UPI"), (t.payment_mode_v1, "hello", "UNKNOWN"),
        (t.payment_mode, "COFFEE", "UNKNOWN"), (t.payment_mode, "DEBIT CARD 1", "CARD"), (t.payment_mode, "INT PAID", "INTEREST"),
        (t.direction_v1, "Deposit", "DEBIT"), (t.direction_v1, "cr", "CREDIT"), (t.direction_of, "Deposit", "DEBIT"), (t.direction_of, "received", "CREDIT"), (t.direction_of, "?", "UNKNOWN"),
        (t.normalize_label, "__a b--c_", "A_B_C"), (t.normalize_label, "--", None), (t.normalize_name, " a#b  & c ", "A B & C"), (t.normalize_name, "!!", None),
        (t.upi_v1, "upi/john@ybl", "john@ybl"), (t.upi, "pay john@ybl ok", "john@ybl"), (t.upi, "a@mail3.example", None), (t.cheque_number, "CHQ #123", "123"),
        (t.ifsc, "neft-hdfc0123456-x", "HDFC0123456"), (t.narration_pattern, "Él-Niño 12_X", "él niño x"), (t.normalize_narration, None, ""), (t.digits, "a1-2", "12"),
        (t.counterparty_from_narration, "UPI/123-JOHN DOE|X", "JOHN DOE"), (t.counterparty_from_narration, "UPI/HDFC/123", None), (t.counterparty_from_narration, "NEFT-x@y-JOHN DOE", "X@Y"),
        (t.display_choice, "bank_charge", "Bank Charge"),
    ],
)
def test_text_rules(spark, f, text, want):
    assert one(spark, text, f) == want


@pytest.mark.parametrize(("text", "want"), [("1,200.50", "1200.50"), ("₹1,200.50", "1200.50"), ("Rs. 1,200.50", None), ("—", "0.00"), ("-", None), ("1-2", None), ("", "0.00"), (None, "0.00")])
def test_clean_amount(spark, text, want):
    got = one(spark, text, t.clean_amount)
    assert got == (None if want is None else Decimal(want))
    assert one(spark, "I1,200", t.clean_amount_legacy) == Decimal("1200.00")


def test_dates_and_vocabulary(spark):
    assert one(spark, "2026-01-01T10:00", t.iso_date) == date(2026, 1, 1)
    assert one(spark, "2026-99-99", t.iso_date) is None and one(spark, "2026-99-99", t.month_of_text) == "2026-99"
    assert one(spark, " wallet top-up ", lambda c: t.in_vocabulary(c, RELATIONSHIPS)) == "WALLET_TOP_UP"
    assert one(spark, "Acme Ltd", lambda c: t.grounded(c, F.lit("paid to acme"))) is True
    assert one(spark, "Al Bo", lambda c: t.grounded(c, F.lit("al bo"))) is False


def test_balance_gap_flips_the_row_that_carries_two_changes(spark):
    """A row without a balance stands between two printed ones: the carried change equals minus the next amount."""
    rows = [(100, "DEBIT", None), (50, "CREDIT", 950), (25, "DEBIT", None), (25, "DEBIT", 900)]
    got = validate.checked_rows(ledger(spark, rows)).orderBy("seq").collect()
    assert [r["corrected_direction"] for r in got] == ["DEBIT", "DEBIT", "DEBIT", "DEBIT"]
    assert [r["seq"] for r in got if r["checked"] and not r["reconciled"]] == [4]
    adjacent = validate.validate_adjacent(ledger(spark, rows)).first()
    assert adjacent["pairs"] == 0 and adjacent["balance_consistency"] == 0 and adjacent["validation_status"] == "FAIL"


def test_no_balances_at_all(spark):
    rows = ledger(spark, [(1, "DEBIT", None), (2, "CREDIT", None)])
    assert validate.validate(rows).first()["balance_consistency"] == 100.0
    assert validate.validate_adjacent(rows).first()["validation_status"] == "FAIL"


def test_unknown_directions_are_read_off_and_totals_follow(spark):
    rows = ledger(spark, [(100, "UNKNOWN", 1100), (40, "CREDIT", 1060), (7, "DEBIT", 1000)])
    v = validate.validate(rows).first()
    assert v["directions_corrected"] == 2 and v["credit_total"] == 100 and v["debit_total"] == 47 and v["balance_breaks"] == 1
    tiny = validate.checked_rows(ledger(spark, [(0.01, "UNKNOWN", 1000)])).first()
    assert tiny["corrected_direction"] == "CREDIT"


def test_descending_statements(spark):
    rows = ledger(spark, [(10, "CREDIT", 1010), (5, "DEBIT", 1000), (20, "CREDIT", 1005)])
    got = validate.validate_adjacent(rows).first()
    assert got["descending"] and got["fitting"] == 2 and got["validation_status"] == "PASS"


def test_upper_median(spark):
    assert aggregate.upper_median(ledger(spark, [(a, "DEBIT", None) for a in (1, 2, 3, 4)])).first()["median_amount"] == 3


def test_recurring_rules_differ(spark):
    monthly = [date(2026, 1, 1), date(2026, 2, 1), date(2026, 3, 1), date(2026, 4, 1)]
    same_day = monthly + monthly
    for days, bands, median in ((monthly, True, True), (same_day, True, True), (monthly[:2], False, False), (monthly + [monthly[0]] * 6, False, True)):
        rows = ledger(spark, [{"txn_date": d} for d in days])
        assert recurring.recurring_by_bands(rows, ["statement_id"]).first()["recurring"] is bands
        assert recurring.recurring_by_median(rows, ["statement_id"]).first()["recurring"] is median


def test_first_seen_wins_among_equals(spark):
    rows = ledger(spark, [{"amount": 5}, {"amount": 5}]).withColumns({"counterparty": F.when(F.col("seq") == 1, "Z").otherwise("A"), "payment_mode": F.lit("UPI"), "confidence": F.lit(1.0), "category": F.lit("C"), "relationship": F.when(F.col("seq") == 1, "R2").otherwise("R1")})
    assert [r["counterparty"] for r in aggregate.side_summary(rows, "DEBIT").orderBy("rank").collect()] == ["Z", "A"]
    assert aggregate.top_relationship(rows.withColumn("counterparty", F.lit("X"))).first()["top_relationship"] == "R2"
    assert [r["cluster_id"] for r in cluster.cluster_by_fields(rows, "counterparty").orderBy("rank").collect()] == ["CL0001", "CL0002"]


def test_unresolved_rows_share_one_row_a_side(spark):
    rows = ledger(spark, [{}, {}, {"direction": "CREDIT"}]).withColumns({"counterparty": F.lit(None).cast("string"), "payment_mode": F.lit("UPI"), "confidence": F.lit(0.5)})
    got = aggregate.side_summary(rows, "DEBIT").collect()
    assert len(got) == 1 and got[0]["counterparty"] is None and got[0]["counterparty_name"] == "UNRESOLVED" and got[0]["transaction_count"] == 2


def test_group_fields():
    assert cluster.group_fields("month, category,month,direction,nonsense") == ["direction", "month", "category"]
    assert cluster.group_fields(None) == ["direction", "category"] == cluster.group_fields("nonsense")


def test_canonical_names():
    assert dict(resolve.canonical_of(iter(["ACME TRADERS PVT LTD", "ACME TRADERS PVT LTDD", "ACME"]))) == {"ACME TRADERS PVT LTD": "ACME TRADERS PVT LTD", "ACME TRADERS PVT LTDD": "ACME TRADERS PVT LTD", "ACME": "ACME"}


def reading(**over):
    row = {
        "direction": "DEBIT", "payment_mode": "UPI", "identifiers": [], "evidence": [], "name": None, "name_key": "", "display_key": "", "alias_key": "", "pattern": "p", "merchant_id": None,
        "counterparty_type": "UNKNOWN", "possible_existing_id": None, "reading_confidence": 0.7,
    }
    row |= over
    if row["name"]:
        row["name_key"] = row["display_key"] = row["name"].lower()
    return row


def ladder(*rows):
    steps = resolve.Ladder()
    return [steps.resolve(reading(**r)) for r in rows]


def test_evidence_ladder():
    a, b = ladder({"identifiers": ["upi:x@y"]}, {"identifiers": ["upi:x@y"], "counterparty_type": "PERSON"})
    assert (a["match_type"], a["counterparty_name"], b["match_type"], b["counterparty_id"]) == ("NEW", "x@y", "EXACT", a["counterparty_id"])
    assert b["shown"] == ["account", "upi", "narration", "history"][1:] and b["counterparty_type"] == "PERSON"
    a, b = ladder({"name": "MANIKANDAN", "identifiers": ["ifsc:HDFC0123456"]}, {"name": "MANIKANDAN R", "identifiers": ["ifsc:HDFC0123456"]})
    assert b["match_type"] == "STRONG" and b["counterparty_id"] == a["counterparty_id"]
    a, b = ladder({"name": "RAVI"}, {"name": "RAVI"})
    assert b["match_type"] == "POSSIBLE" and b["counterparty_id"] != a["counterparty_id"] and b["possible_match_of"] == a["counterparty_id"] and b["requires_review"]
    a, b = ladder({"name": "RAVI", "identifiers": ["upi:a@b", "ifsc:HDFC0123456"]}, {"name": "RAVI", "identifiers": ["upi:c@d", "ifsc:HDFC0123456"]})
    assert b["match_type"] == "POSSIBLE"
    (a,) = ladder({"identifiers": ["ref:123456789"]})
    assert a["match_type"] == "UNKNOWN" and a["counterparty_id"] is None and a["requires_review"]


def test_similarity(spark):
    assert names_similar("manikandan", {"manikandan r"}, 0.85) and not names_similar("", {"a"}, 0.85) and not names_similar("ravi", {"kumar"}, 0.85)
    frame = spark.createDataFrame([("ab", "abc"), (None, "x")], "a string, b string").select(sequence_ratio(F.col("a"), F.col("b")).alias("r"))
    assert [r["r"] for r in frame.collect()] == [text_ratio("ab", "abc"), None]


def test_duplicate_tiers_and_ids(spark):
    rows = ledger(spark, [
        {"reference_number": "r1"}, {"reference_number": "r1"}, {"amount": 2, "narration": "paid to acme traders one"}, {"amount": 2, "narration": "paid to acme traders two"},
        {"amount": 3, "narration": "abc"}, {"amount": 3, "narration": "xyz"}, {"amount": 1},
    ]).withColumn("counterparty", F.lit(None).cast("string"))
    got = {r["seq"]: (r["duplicate_group_id"], r["confidence"]) for r in duplicates.duplicate_groups(rows).collect()}
    assert got == {1: ("DUP_0001", "HIGH"), 2: ("DUP_0001", "HIGH"), 3: ("DUP_0002", "POSSIBLE"), 4: ("DUP_0002", "POSSIBLE")}
    known = rows.withColumn("counterparty", F.lit("C"))
    got = {r["seq"]: r["confidence"] for r in duplicates.duplicate_groups(known).collect()}
    assert got == {1: "HIGH", 2: "HIGH", 3: "MEDIUM", 4: "MEDIUM", 5: "MEDIUM", 6: "MEDIUM"}  # row 7 is alone once the first two are high


def test_records_do_not_overlap_or_cross_pages(spark):
    record = ["01-01-2026", "text", "ref", "02-01-2026", "1.00", "", "5.00"]
    filled = [x or "0" for x in record]
    assert len(parse.records_of_lines(["head", *filled, *filled])) == 2
    assert parse.records_of_lines(filled[:6]) == [] and parse.records_of_lines(["01-01-2026", *["x"] * 6, *filled])[0] == filled
    pages = spark.createDataFrame([("s", 1, "\n\n".join(filled[:4])), ("s", 2, "\n".join(filled + ["tail"]))], "statement_id string, page_no int, text string")
    got = parse.transactions_from_pages(pages).collect()
    assert len(got) == 1 and got[0]["page"] == "page_2" and got[0]["withdrawal"] == 1 and got[0]["parse_error"] is None


def test_chunks_and_ranges(spark):
    texts = spark.createDataFrame([(1, "aaaaa\nbbbbb\n\nccccc\nddddd\neeeee"), (2, ""), (3, None)], "statement_id long, text string")
    got = sorted((r["statement_id"], r["start"], r["stop"]) for r in parse.line_ranges(texts, chunk_chars=20).collect())
    assert got == [(1, 0, 2), (1, 2, 4), (1, 4, 5)]
    import re

    assert parse.chunks_of_lines(["x" * 8, "2026-01-01 a", "y" * 8], 10, re.compile(t.DATE_LINE)) == ["x" * 8, "2026-01-01 a\n" + "y" * 8]


def test_account_and_table(spark):
    text = "Business Name\n ACME \nOpening Balance\n\n 5.00\nclosing balance\n7"
    got = parse.account_from_text(spark.createDataFrame([(1, text)], "statement_id long, text string")).first()
    assert (got["business_name"], got["opening_balance"], got["closing_balance"], got["business_type"]) == ("ACME", "5.00", "7", None)
    rows = spark.createDataFrame([(1, 0, "", "", ""), (1, 1, "ACME", "01-01-2026", "1,000.50"), (1, 2, "", "not a date", "5"), (1, 3, "", "02-01-2026", "1-2")], "statement_id long, row_no int, `Business Name` string, Date string, `Deposit (Cr)` string")
    account, transactions = parse.tabular_statement(rows)
    assert account.first()["business_name"] == "ACME"
    assert [(r["row_no"], r["deposit"], r["withdrawal"], r["parse_error"]) for r in transactions.orderBy("row_no").collect()] == [(1, Decimal("1000.50"), 0, None), (3, None, 0, "deposit")]


def test_review_rules(spark):
    rows = ledger(spark, [{"narration": "SELF TRF", "amount": 100}, {"amount": 1}, {"amount": 1}]).withColumns({"counterparty": F.lit(""), "category": F.lit("PERSONAL_EXPENSE"), "confidence": F.lit(0.5), "relationship": F.lit("REFUND"), "payment_mode": F.lit("UPI")})
    issues = {r["issue_type"] for r in review.anomalies(rows).filter("seq = 1").collect()}
    assert issues == {"low_confidence", "counterparty_unknown", "unusual_amount", "possible_internal_transfer", "possible_personal_expense"}
    validation = spark.createDataFrame([(1, 65.0)], "statement_id long, balance_consistency double")
    queue = review.queue_grouped(rows, validation, duplicates.exact_duplicate_rows(rows))
    by_type = {r["issue_type"]: r for r in queue.collect()}
    assert by_type["balance_mismatch"]["severity"] == "HIGH" and by_type["balance_mismatch"]["transaction_id"] is None
    assert "possible_refund" in by_type and "missing_reference" in by_type and "possible_duplicate" in by_type
    assert review.without_repeats(queue.unionByName(queue)).count() == queue.count()


def test_classification_guards(spark):
    rows = ledger(spark, [{}, {}, {}, {}]).withColumn("relationship", F.when(F.col("seq") == 4, "WALLET_TOP_UP").otherwise("PAYMENT"))
    made = spark.createDataFrame([(1, "tx_000001", "rent", 0.9, ["lease"], False), (1, "tx_000002", "rent", 0.3, ["lease"], False), (1, "tx_000004", "rent", 0.9, ["x"], False)], "statement_id long, transaction_id string, category string, confidence double, evidence array<string>, requires_review boolean")
    got = [(r["category"], r["category_review"]) for r in classify.classify(rows, made).orderBy("seq").collect()]
    assert got == [("RENT", False), ("UNKNOWN", True), ("UNKNOWN", True), ("UNKNOWN", True)]
    assert classify.unclassified(rows, made).count() == 1


def test_catalog(spark):
    table = spark.createDataFrame([(1, "a", False, True), (2, "", True, False), (2, "b", False, False)], "id int, name string, is_deleted boolean, is_active boolean")
    assert [catalog.alive(table).count(), catalog.dead(table).count(), catalog.active(table).count(), catalog.inactive(table).count()] == [2, 1, 1, 1]
    assert catalog.only_row_per_key(table, "id").collect()[0]["id"] == 1
    assert catalog.soft_deleted(table, F.col("id") == 1).filter("is_deleted").count() == 2 and catalog.hard_deleted(table, F.col("id") == 2).count() == 1
    assert catalog.blanks_as_null(table).filter("name is null").count() == 1
    assert [r["id"] for r in catalog.ordered(table, ["-id", "nonsense", "name"]).collect()] == [2, 2, 1]
    assert catalog.page(table, [F.asc("id")], 1, 1000).count() == 3
    nested = table.select(F.struct("id", "name").alias("who"), "is_deleted")
    assert catalog.projected(nested, {"key": "who.id", "gone": "is_deleted"}).dtypes == [("key", "int"), ("gone", "string")]


def test_totals_are_conserved(spark):
    from ledgerloom.sources.tables import ledger as star

    rows = star(spark, "/root/testdata/sf0.001").cache()
    whole = rows.agg(F.sum("amount")).first()[0]
    for fields in ("category", "counterparty,month", "payment_mode"):
        clusters = cluster.cluster_by_fields(rows, fields)
        assert clusters.agg(F.sum("total_amount")).first()[0] == whole
        members = clusters.select("statement_id", F.explode("transaction_ids").alias("t"))
        assert members.distinct().count() == members.count() == rows.count()


def scanned_ladder(rows):
    """The ladder by scanning all parties for every row."""
    parties, out = [], []
    for row in rows:
        ids = row["identifiers"]
        exact = next(((i, p) for kind in ("acct:", "upi:", "mid:") for i in ids if i.startswith(kind) for p in parties if i in p["exact"]), None)
        strong = [i for i in ids if i.startswith(("ifsc:", "ref:"))]
        clash = lambda p: any({i for i in ids if i.startswith(k)} and {i for i in p["ids"] if i.startswith(k)} and not {i for i in ids if i.startswith(k)} & {i for i in p["ids"] if i.startswith(k)} for k in ("acct:", "upi:"))
        like = lambda p: names_similar(row["name_key"], p["names"], 0.85)
        same = next((p for p in parties if set(strong) & p["ids"] and like(p) and not clash(p)), None)
        shown = row["name"] or next((i.split(":", 1)[1] for i in ids if i.startswith(("acct:", "upi:", "mid:"))), None)
        near = None
        if exact:
            match, party = "EXACT", exact[1]
        elif same:
            match, party = "STRONG", same
        elif shown:
            near = next((p["id"] for p in parties if row["direction"] in p["directions"] and row["payment_mode"] in p["modes"] and like(p)), None)
            match = "POSSIBLE" if near else "NEW"
            party = {"id": f"CP_{len(parties) + 1:05d}", "exact": set(), "ids": set(), "names": {row["display_key"] or shown.lower()}, "directions": set(), "modes": set()}
            parties.append(party)
        else:
            out.append(("UNKNOWN", None, None))
            continue
        taken = set().union(*(p["exact"] for p in parties))
        party["exact"] |= {i for i in ids if i.startswith(("acct:", "upi:", "mid:")) and i not in taken}
        party["ids"] |= set(ids)
        party["names"] |= {row["name_key"]} - {""}
        party["directions"].add(row["direction"])
        party["modes"].add(row["payment_mode"])
        out.append((match, party["id"], near))
    return out


def test_ladder_equals_a_scan():
    rng = random.Random(3)
    names = ["acme traders", "acme traders pvt", "acme trader", "ravi kumar", "ravi", "kumar stores", "zen", None]
    for _ in range(60):
        rows = []
        for _ in range(60):
            ids = [f"upi:u{rng.randint(0, 9)}@x"] * (rng.random() < 0.3) + [f"acct:{rng.randint(0, 4)}"] * (rng.random() < 0.15) + [f"ifsc:I{rng.randint(0, 3)}"] * (rng.random() < 0.5) + [f"ref:{rng.randint(0, 30)}"] * (rng.random() < 0.3)
            rows.append(reading(name=rng.choice(names), identifiers=ids, direction=rng.choice(["CREDIT", "DEBIT"]), payment_mode=rng.choice(["UPI", "NEFT"])))
        steps = resolve.Ladder()
        got = [steps.resolve(dict(r)) for r in rows]
        assert [(g["match_type"], g["counterparty_id"], g["possible_match_of"]) for g in got] == scanned_ladder(rows)


def test_canonical_names_equal_a_scan():
    rng = random.Random(4)
    names = list(dict.fromkeys("".join(rng.choice("AB") for _ in range(rng.randint(8, 26))) + rng.choice(["", " LTD", " PVT LTD"]) for _ in range(300)))
    known, want = [], {}
    for name in names:
        close = get_close_matches(name, known, n=1, cutoff=0.92)
        want[name] = close[0] if close else name
        known += [] if close else [name]
    assert dict(resolve.canonical_of(iter(names))) == want


def test_bounds_reject_no_ratio_at_the_threshold():
    rng = random.Random(5)
    for _ in range(4000):
        a = "".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, 14)))
        b = "".join(c if rng.random() < 0.85 else rng.choice("abcxyz") for c in a) + rng.choice(["", "q"])
        ratio = text_ratio(a, b)
        for threshold in (0.5, 0.85, 0.92):
            assert Ratio(b, threshold).of(a) == (ratio if ratio >= threshold else None)


def test_duplicate_numbers_follow_blocks(spark):
    """A block that begins with a flagged row is numbered by that row."""
    day, names = date(2026, 1, 1), {1: "A", 2: "B", 3: "B", 4: "A", 5: "A", 6: "A"}
    rows = ledger(spark, [{"reference_number": "r", "narration": "aaaa"}, {"narration": "bbbb"}, {"narration": "cccc"}, {"narration": "dddd"}, {"narration": "eeee"}, {"reference_number": "r", "narration": "ffff"}])
    rows = rows.withColumn("txn_date", F.lit(day)).withColumn("counterparty", F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("seq")))
    got = {r["seq"]: (r["duplicate_group_id"], r["confidence"]) for r in duplicates.duplicate_groups(rows).collect()}
    assert got == {1: ("DUP_0001", "HIGH"), 6: ("DUP_0001", "HIGH"), 4: ("DUP_0002", "MEDIUM"), 5: ("DUP_0002", "MEDIUM"), 2: ("DUP_0003", "MEDIUM"), 3: ("DUP_0003", "MEDIUM")}


def test_repeated_side_rows_keep_the_ledger(spark):
    rows = ledger(spark, [{"narration": "paid to acme"}, {"narration": "paid to zen"}])
    empty = classify.rule_readings(rows)
    twice = empty.withColumn("row_no", F.lit(1)).withColumn("counterparty_name_raw", F.lit("zen"))
    twice = twice.unionByName(empty.withColumn("row_no", F.lit(2)).withColumn("counterparty_name_raw", F.lit("acme"))).unionByName(twice.withColumn("transaction_id", F.lit("foreign")))
    assert [(r["seq"], r["name"]) for r in classify.normalize(rows, twice).orderBy("seq").collect()] == [(1, "acme"), (2, None)]
    made = spark.createDataFrame([(1, "tx_000001", "RENT", 0.9, ["e"], False, 1), (1, "tx_000001", "SALARY", 0.9, ["e"], False, 2), (1, "tx_000009", "RENT", 0.9, ["e"], False, 3)], "statement_id long, transaction_id string, category string, confidence double, evidence array<string>, requires_review boolean, row_no int")
    assert [(r["seq"], r["category"]) for r in classify.classify(rows.withColumn("relationship", F.lit("PAYMENT")), made).orderBy("seq").collect()] == [(1, "SALARY"), (2, "UNKNOWN")]
    merges = spark.createDataFrame([("RENT", "SALARY", 1), ("rent", "TRAVEL", 2)], "label string, canonical string, row_no int")
    assert {r["category"] for r in classify.merge_categories(rows.withColumn("category", F.lit("RENT")), merges).collect()} == {"TRAVEL"}
