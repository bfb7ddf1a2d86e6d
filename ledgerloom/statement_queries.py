"""Queries over statement text, side tables and whole pipelines, each beside the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import api
from ledgerloom.functions import text as t
from ledgerloom.operators import catalog, classify, cluster, duplicates, parse, readers, resolve
from ledgerloom.plans import evidence, grouped
from ledgerloom.queries import _ADJACENT, _LINES, _TIERS, CR, DR, L1, L1B, L2, NET, TOTALS, _mode_sql, doubled, flat, query
from ledgerloom.sources import tables

DATE_LINE = r"^\s*(\d{1,2}[-/. ]([A-Za-z]{3,9}|\d{1,2})[-/. ,]+\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})"
ST = (
    L2
    + """, st as (
  select statement_id, concat('Statement of ', cast(statement_id as varchar), chr(10), case when statement_id % 2 = 0 then 'Date Narration Debit Credit Balance' else 'Date Particulars Amount Dr or Cr' end, chr(10),
    string_agg(concat(strftime(txn_date, '%Y-%m-%d'), ' ', narration, ' ', cast(amount as varchar), ' ', case when direction = 'CREDIT' then 'Cr' else 'Withdrawal' end), chr(10) order by event_id)) as text
  from l2 group by 1
), sl as (select statement_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from st)"""
)
DENSE = ST + rf""", hd as (
  select *, sum(cast(regexp_matches(line, '\d[\d,]*\.?\d{{0,2}}') as int)) over (partition by statement_id order by line_no rows between current row and 11 following) as n, regexp_matches(line, '{DATE_LINE}') as is_date from sl
), first as (select statement_id, min(line_no) as first_line from hd where is_date and n >= 2 group by 1)"""


@query(f"with {DENSE} select * from first")
def boundary_heuristic(spark, sf_dir):
    texts = tables.statement_texts(spark, sf_dir)
    return flat(parse.first_transaction_line(parse.text_lines(texts)))


@query(f"""with {DENSE}, g as (select statement_id, statement_id % 7 as guess from st),
ok as (select distinct g.statement_id, guess from g join sl a on a.statement_id = g.statement_id and a.line_no = guess join hd b on b.statement_id = g.statement_id and b.line_no between guess - 1 and guess + 3 and b.is_date)
select st.statement_id, coalesce(guess, first_line) as first_line, case when guess is not null then 'llm' when first_line is not null then 'heuristic' end as method from st left join ok using (statement_id) left join first using (statement_id)""")
def boundaries_with_guesses(spark, sf_dir):
    texts = tables.statement_texts(spark, sf_dir)
    guesses = texts.select("statement_id", (F.col("statement_id") % 7).alias("first_transaction_line"))
    return flat(readers.boundaries(texts, guesses))


@query(f"""with {DENSE}, w as (select statement_id, string_agg(line, chr(10) order by line_no) filter (where line_no < first_line) as header, string_agg(line, chr(10) order by line_no) filter (where line_no >= first_line) as txn,
  string_agg(line, chr(10) order by line_no) filter (where line_no >= first_line - 30 and line_no < first_line + 55) as around from sl join first using (statement_id) group by 1)
select statement_id, sha256(header) as header_sha256, sha256(txn) as txn_sha256, sha256(substring(header, 1, 16000)) as shown_sha256, sha256(around) as layout_sha256 from w""")
def split_statements(spark, sf_dir):
    texts = tables.statement_texts(spark, sf_dir)
    found = readers.boundaries(texts)
    around = texts.join(found, "statement_id").select("statement_id", F.sha2(readers.layout_window(F.col("text"), F.col("first_line")), 256).alias("layout_sha256"))
    parts = readers.split_at(texts, found)
    shown = readers.header_window(F.col("header_text"))
    return parts.select("statement_id", F.sha2("header_text", 256).alias("header_sha256"), F.sha2("txn_text", 256).alias("txn_sha256"), F.sha2(shown, 256).alias("shown_sha256")).join(around, "statement_id")


@query(f"""with {DENSE} select statement_id, case when statement_id % 2 = 0 then 'date,narration,debit,credit,balance' else 'date,narration' end as column_names,
  case when statement_id % 2 = 0 then 'TWO_COLUMNS' else 'MARKED' end as direction_style, statement_id % 2 = 0 as has_balance from first""")
def layout_of_statements(spark, sf_dir):
    texts = tables.statement_texts(spark, sf_dir)
    heads = texts.withColumn("text", F.regexp_replace("text", r"(?m)^\d{4}-.*$", "2024-01-01 1.00 1.00"))
    return flat(readers.sniff_layout(heads, readers.boundaries(heads)), "statement_id", "column_names", "direction_style", "has_balance")


_READ = """select statement_id, seq, printf('{id}', seq) as transaction_id, strftime(txn_date, '%Y-%m-%d') as date, narration as description, cast(amount as double) as amount, direction, {more} from (
  select *, row_number() over (partition by statement_id order by event_id) as seq from l2)"""


@query(f"with {L2} {_READ.format(id='tx_%06d', more='0.8 as extraction_confidence').replace('0.8 as', 'cast(0.8 as double) as')}")
def read_chunks(spark, sf_dir):
    """Printed text read back in chunks by rule."""
    rows, _ = readers.read_chunks(tables.statement_texts(spark, sf_dir), readers.LineReader())
    return flat(rows, "statement_id", "seq", "transaction_id", "date", "description", "amount", "direction", "extraction_confidence")


@query(f"with {L2} {_READ.format(id='TXN_%05d', more='seq + 1 as source_line')}")
def read_ranges(spark, sf_dir):
    """Printed text read back in owned ranges by rule; lines are numbered from 0 after two heads."""
    rows, _ = readers.read_ranges(tables.statement_texts(spark, sf_dir), readers.LineReader())
    return flat(rows, "statement_id", "seq", "transaction_id", "date", "description", "amount", "direction", "source_line")


@query(f"with {L2} select statement_id, count(*) as read_rows, 'OK' as status, '' as failed from l2 group by 1")
def read_statuses(spark, sf_dir):
    _, states = readers.read_ranges(tables.statement_texts(spark, sf_dir), readers.LineReader())
    return flat(states, "statement_id", "read_rows", "status", "failed")


_FOLD = """with recursive lines as ({lines}), f as (
  select doc_id, 0 as pos, 0 as part, length(line) + {extra} as size from lines where pos = 0
  union all select l.doc_id, l.pos, f.part + cast({close} as int), case when {close} then 0 else f.size end + length(l.line) + {extra} from f join lines l on l.doc_id = f.doc_id and l.pos = f.pos + 1
)"""
_SPLIT = r"select doc_id, unnest(p) as line, unnest(range(len(p))) as pos from (select doc_id, regexp_split_to_array(regexp_replace(text, '(\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') as p from documents where text <> '')"
_FULL = rf"(f.size + length(l.line) > 3500 and (f.size > 5250 or regexp_matches(l.line, '{DATE_LINE}')))"


@query(_FOLD.format(lines=_SPLIT, extra=1, close=_FULL) + " select doc_id, f.part as chunk_no, sha256(string_agg(line, chr(10) order by f.pos)) as chunk_sha256 from f join lines using (doc_id, pos) group by 1, 2")
def chunk_lines(spark, sf_dir):
    found = parse.line_chunks(tables.table(spark, sf_dir, "documents"), "doc_id")
    return flat(found.select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("chunk_sha256")))


_FILLED = "select doc_id, line, row_number() over (partition by doc_id order by n) - 1 as pos from (select doc_id, trim(unnest(string_split(text, chr(10))), ' ') as line, unnest(range(len(string_split(text, chr(10))))) as n from documents) where line <> ''"


@query(_FOLD.format(lines=_FILLED, extra=8, close="(f.size >= 3500)") + ' select doc_id, min(pos) as "start", max(pos) + 1 as "stop" from f group by doc_id, part')
def chunk_ranges(spark, sf_dir):
    return flat(parse.line_ranges(tables.table(spark, sf_dir, "documents"), "doc_id"))


@query(f"""{_TIERS}, b as (
  select *, case when counterparty is not null then min(seq) over (partition by statement_id, txn_date, amount, direction, counterparty) end as medium_block from m
), k as (select statement_id, seq, case when high is not null then 1 else 2 end as tier, coalesce(high, medium_block) as block from b where high is not null or medium is not null)
select statement_id, seq, printf('DUP_%04d', dense_rank() over (partition by statement_id order by tier, block)) as duplicate_group_id, case tier when 1 then 'HIGH' else 'MEDIUM' end as confidence from k""")
def duplicate_groups(spark, sf_dir):
    """Narrations are made unlike, so that no group is one of likeness alone."""
    unlike = F.concat(F.sha2(F.col("row_id").cast("string"), 256))
    return flat(duplicates.duplicate_groups(doubled(spark, sf_dir).withColumn("narration", unlike)))


# The narrated ledger with balances, in places printed the wrong way.
L2B = (
    L2
    + """, l2s as (select * exclude (counterparty), counterparty as event_type, row_number() over (partition by statement_id order by event_id) as seq from l2), l1b as (
  select * exclude (direction), case when event_id % 5 <> 0 then 1000 + sum(case when direction = 'CREDIT' then amount else -amount end) over (partition by statement_id order by seq) end as balance,
    case when event_id % 13 = 0 then case direction when 'CREDIT' then 'DEBIT' else 'CREDIT' end else direction end as direction from l2s
)"""
)
_GROUPED = _ADJACENT.replace(L1B, L2B) + f""", made as (
  select *, case event_type when 'purchase' then 'PURCHASE' when 'click' then 'BANK_CHARGES' when 'error' then 'REFUND' when 'view' then 'INTERNAL_TRANSFER' else 'UNKNOWN' end as category,
    case when event_type = 'click' then 'POS' else {_mode_sql(t.MODES_V1, 'upper(narration)', 'UNKNOWN')} end as payment_mode,
    case event_type when 'error' then 'REIMBURSEMENT' when 'click' then 'CHARGE' when 'view' then 'TRANSFER' else case corrected when 'CREDIT' then 'RECEIPT' else 'PAYMENT' end end as relationship,
    case event_type when 'signup' then 0.55 else 0.9 end as confidence from e
)"""


def _judgements(spark, sf_dir) -> DataFrame:
    """Classifications of the balanced ledger: none for sign-ups, two for errors, of which the later counts, some foreign."""
    rows = tables.balanced_ledger(spark, sf_dir).filter("event_type <> 'signup'")
    of = lambda **named: F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in named.items()])
    made = rows.select(
        "statement_id", "transaction_id", of(purchase="purchase", click="Bank charges", error="REFUND", view="internal-transfer").alias("category"), of(purchase="CORNER SHOP", click="TERMINAL", error="GOODS DESK", view="OWN TILL").alias("counterparty"),
        of(purchase="UNKNOWN", click="POS", error="UNKNOWN", view="UNKNOWN").alias("payment_mode"), of(purchase="UNKNOWN", click="NONSENSE", error="REIMBURSEMENT").alias("relationship"), F.lit(0.9).alias("confidence"), F.lit(2).alias("row_no"),
    )
    earlier = made.filter("category = 'REFUND'").withColumns({"category": F.lit("RENT"), "row_no": F.lit(1), "confidence": F.lit(0.1)})
    return made.unionByName(earlier).unionByName(earlier.withColumn("transaction_id", F.lit("foreign")))


def _grouped(spark, sf_dir):
    ledger = tables.balanced_ledger(spark, sf_dir).select("statement_id", "seq", "transaction_id", "txn_date", "amount", "direction", "narration", "reference_number", "balance")
    return grouped.run(ledger, _judgements(spark, sf_dir), group_by="category,payment_mode")


@query(f"with {_GROUPED} select statement_id, seq, corrected as direction, category, payment_mode, relationship, confidence from made")
def grouped_pipeline_rows(spark, sf_dir):
    return flat(_grouped(spark, sf_dir)["rows"], "statement_id", "seq", "direction", "category", "payment_mode", "relationship", "confidence")


@query(f"""with {_GROUPED}, g as (select statement_id, corrected as direction, category, payment_mode, count(*) as transaction_count, cast(sum(amount) as double) as total_amount, sum(amount) as s, min(seq) as f from made group by 1, 2, 3, 4)
select * exclude (s, f), printf('CL%04d', row_number() over (partition by statement_id order by f)) as cluster_id, row_number() over (partition by statement_id order by direction, s desc, f) as rank from g""")
def grouped_pipeline(spark, sf_dir):
    return flat(_grouped(spark, sf_dir)["clusters"], "statement_id", "direction", "category", "payment_mode", "transaction_count", "total_amount", "cluster_id", "rank")


@query(f"""with {_GROUPED}, dd as (select * exclude (direction), corrected as direction from made)
select statement_id, {CR} as credit_total, {DR} as debit_total, {NET} as net, concat(strftime(min(txn_date), '%Y-%m-%d'), ' to ', strftime(max(txn_date), '%Y-%m-%d')) as statement_period,
  strftime(max(txn_date), '%Y-%m-%d') as statement_period_end, cast(count(distinct (direction, category, payment_mode)) as bigint) as n_clusters from dd group by 1""")
def grouped_pipeline_results(spark, sf_dir):
    found = grouped.result_rows(_grouped(spark, sf_dir))
    return flat(found.withColumn("n_clusters", F.size("clusters").cast("bigint")), "statement_id", "credit_total", "debit_total", "net", "statement_period", "statement_period_end", "n_clusters")


_CHECKED2 = L2B + """, p as (
  select *, balance - coalesce(last_value(balance ignore nulls) over (partition by statement_id order by seq rows between unbounded preceding and 1 preceding), 1000) as delta from l1b
), r as (select *, case when direction = 'CREDIT' then amount else -amount end as signed from p),
w as (select * exclude (direction), case when abs(delta + signed) <= 0.02 and not abs(delta - signed) <= 0.02 then case direction when 'CREDIT' then 'DEBIT' else 'CREDIT' end else direction end as direction from r)"""


def _evidence(spark, sf_dir):
    ledger = tables.balanced_ledger(spark, sf_dir).drop("event_type")
    made = _judgements(spark, sf_dir).select("statement_id", "transaction_id", "category", "confidence", F.array(F.lit("seen")).alias("evidence"), F.lit(False).alias("requires_review"), "row_no")
    return evidence.run(ledger, made)


@query(f"with {_CHECKED2} select statement_id, {TOTALS} from w group by 1")
def evidence_pipeline_totals(spark, sf_dir):
    return flat(_evidence(spark, sf_dir)["totals"])


@query(f"""with {_CHECKED2}, c as (select *, case event_type when 'purchase' then 'PURCHASE' when 'click' then 'BANK_CHARGES' when 'error' then 'REFUND' when 'view' then 'INTERNAL_TRANSFER' else 'UNKNOWN' end as category from w)
select statement_id, 'category' as dimension, category as key, {TOTALS} from c group by 1, 3 union all select statement_id, 'month', strftime(txn_date, '%Y-%m'), {TOTALS} from c group by 1, 3
union all select statement_id, 'payment_mode', {_mode_sql(t.MODES, 'upper(narration)', 'UNKNOWN')}, {TOTALS} from c group by 1, 3""")
def evidence_pipeline_groups(spark, sf_dir):
    return flat(_evidence(spark, sf_dir)["group_totals"])


@query(f"with {_CHECKED2} select statement_id, string_agg(printf('tx_%06d', seq), ',' order by seq) as unknown_transaction_ids from w where event_type = 'signup' group by 1")
def unknown_transactions(spark, sf_dir):
    return flat(_evidence(spark, sf_dir)["unknown"])


@query()
def evidence_pipeline(spark, sf_dir):
    return flat(_evidence(spark, sf_dir)["review_queue"], "statement_id", "transaction_id", "issue_type", "severity", "position")


@query(f"""with {L2} select event_id, case when counterparty = 'purchase' then 'Shop Ltd' end as name, case when counterparty = 'click' then 'UNKNOWN' else 'BUSINESS' end as counterparty_type,
  {_mode_sql(t.MODES, 'upper(narration)', 'NACH')} as payment_mode, counterparty = 'view' as own_account, case when counterparty = 'error' then 'WALLET_TOP_UP' else 'UNKNOWN' end as relationship from l2""")
def normalized_rows(spark, sf_dir):
    """Readings with repeats, of which the last counts."""
    rows = tables.narrated_ledger(spark, sf_dir).withColumn("transaction_id", F.col("event_id").cast("string")).withColumnRenamed("counterparty", "event_type")
    is_ = lambda kind: F.col("event_type") == kind
    none = {c: F.lit(None).cast(kind) for c, kind in classify.READING.items()}
    last = rows.select("statement_id", "transaction_id", *[c.alias(n) for n, c in (none | {
        "counterparty_name_raw": F.when(is_("purchase"), "Shop Ltd").otherwise("Nobody Known"), "counterparty_type": F.when(is_("click"), "alien").otherwise(" business "), "payment_mode": F.lit("nach"),
        "own_account_transfer_suspected": is_("view"), "relationship": F.when(is_("error"), "wallet top-up"), "confidence": F.lit(0.5),
    }).items()], F.lit(2).alias("row_no"))
    readings = last.unionByName(last.withColumns({"row_no": F.lit(1), "counterparty_name_raw": F.lit("okbank"), "counterparty_type": F.lit("PERSON")}))
    return flat(classify.normalize(rows, readings), "event_id", "name", "counterparty_type", "payment_mode", "own_account", "relationship")


@query(f"""with {L1}, r as (select *, case l_partkey % 3 when 0 then 'UNKNOWN' when 1 then 'BUSINESS' else 'PERSON' end as kind from l1 where counterparty is not null),
g as (select statement_id, counterparty, min(counterparty) as name, coalesce(arg_min(kind, seq) filter (where kind <> 'UNKNOWN'), 'UNKNOWN') as counterparty_type, array_to_string(list_sort(list(distinct concat('upi:', l_partkey % 4))), ',') as identifiers,
  coalesce(array_to_string(list_sort(list(distinct case when l_partkey % 2 = 0 then 'also ' || cast(l_partkey % 6 as varchar) end) filter (where l_partkey % 2 = 0)), ','), '') as aliases,
  array_to_string(list_sort(list(distinct payment_mode)), ',') as payment_modes, array_to_string(list_sort(list(distinct direction)), ',') as directions, {TOTALS} from r group by 1, 2)
select * exclude (counterparty), counterparty as counterparty_id, printf('CL_%04d', row_number() over (partition by statement_id order by counterparty)) as cluster_id from g""")
def party_registry(spark, sf_dir):
    rows = tables.ledger(spark, sf_dir).withColumns({
        "counterparty_id": F.col("counterparty"), "counterparty_name": F.col("counterparty"), "pattern": F.lit("p"),
        "counterparty_type": F.when(F.col("l_partkey") % 3 == 0, "UNKNOWN").when(F.col("l_partkey") % 3 == 1, "BUSINESS").otherwise("PERSON"),
        "identifiers": F.array(F.concat(F.lit("upi:"), (F.col("l_partkey") % 4).cast("string")), F.concat(F.lit("ref:"), F.col("l_orderkey").cast("string"))),
        "alias": F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("also "), (F.col("l_partkey") % 6).cast("string"))),
    })
    found = resolve.party_registry(rows, cluster.counterparty_clusters(rows))
    return flat(found.drop("patterns", "first_date", "last_date"))


_WORDS = "select event_id, event_type, cast(event_id % 1000 as varchar) as n, case event_id % 3 when 0 then strftime(ts, '%Y-%m-%d') when 1 then '2024-13-45' else 'n/a' end as day, case event_id % 4 when 0 then '—' when 1 then 'I1,200' when 2 then '₹ 7.50' else 'x' end as amount from events"


def _words(spark, sf_dir) -> DataFrame:
    i = F.col("event_id")
    return tables.table(spark, sf_dir, "events").select(
        "event_id", "event_type", (i % 1000).cast("string").alias("n"), F.when(i % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(i % 3 == 1, "2024-13-45").otherwise("n/a").alias("day"),
        F.when(i % 4 == 0, "—").when(i % 4 == 1, "I1,200").when(i % 4 == 2, "₹ 7.50").otherwise("x").alias("amount"),
    )


@query(f"""with w as ({_WORDS}) select event_id, case when event_type = 'click' then 'CREDIT' else 'DEBIT' end as grouped_direction, case event_type when 'click' then 'CREDIT' else 'UNKNOWN' end as direction,
  case event_id % 3 when 0 then day when 1 then day end as safe_date, case event_id % 3 when 2 then null else substring(day, 1, 7) end as month, cast(case event_id % 3 when 0 then cast(day as date) end as varchar) as iso from w""")
def direction_and_date_rules(spark, sf_dir):
    printed, day = F.col("event_type"), F.col("day")
    return flat(_words(spark, sf_dir).select("event_id", t.direction_v1(printed).alias("grouped_direction"), t.direction_of(printed).alias("direction"), t.iso_date_text(day).alias("safe_date"), t.month_of_text(day).alias("month"), t.iso_date(day).alias("iso")))


@query(f"""with w as ({_WORDS}) select event_id, cast(try_cast(replace(concat('-', n, ',000.50'), ',', '') as double) * -1 as double) as parsed, cast(case event_id % 4 when 0 then 0 when 1 then 1200 when 2 then 7.5 end as double) as legacy,
  event_id % 1000 <= 1 as near from w""")
def amount_rules(spark, sf_dir):
    rows = _words(spark, sf_dir)
    n = F.col("n").cast("decimal(15,2)")
    return flat(rows.select("event_id", t.parse_amount(F.concat(F.lit("-"), "n", F.lit(",000.50"))).alias("parsed"), t.clean_amount_legacy(F.col("amount")).alias("legacy"), t.near_amount(n / 100, F.lit(0)).alias("near")))


@query("select * from (select o_orderkey, cast(o_orderdate as varchar) as day, o_orderpriority as priority, cast(o_totalprice as double) as total from orders order by o_totalprice desc, o_orderkey limit 50)")
def ordered_projection(spark, sf_dir):
    """The fifty largest orders, under new names."""
    orders = tables.table(spark, sf_dir, "orders")
    top = catalog.ordered(orders, ["-o_totalprice", "nonsense", "o_orderkey"]).limit(50)
    return flat(catalog.projected(top, {"o_orderkey": "o_orderkey", "day": "o_orderdate", "priority": "o_orderpriority", "total": "o_totalprice"}))


@query("select o_orderkey, o_custkey from orders where o_orderkey = 7")
def point_lookup(spark, sf_dir):
    return catalog.by_id(tables.table(spark, sf_dir, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey")


@query(f"with {L1} select statement_id, cast(seq as bigint) as seq, case when l_partkey % 2 = 0 then relationship else 'RECEIPT' end as relationship from (select * exclude (relationship), case direction when 'CREDIT' then 'RECEIPT' else 'PAYMENT' end as relationship from l1) where true".replace("else 'RECEIPT' end as relationship from (", "else 'PURCHASE' end as relationship from ("))
def repaired_relationships(spark, sf_dir):
    rows = tables.ledger(spark, sf_dir).withColumns({"narration": F.lit("plain"), "category": F.lit("RENT"), "relationship": F.when(F.col("l_partkey") % 2 == 0, "NO SUCH").otherwise("PURCHASE")})
    return flat(classify.repair_relationships(rows), "statement_id", "seq", "relationship")


@query(f"with {L1} select statement_id, 0 as changed from l1 where counterparty is not null group by 1".replace("0 as changed", "cast(0 as bigint) as changed"))
def unchanged_names(spark, sf_dir):
    """Names too unlike to be one another's: codes of their digests."""
    rows = tables.ledger(spark, sf_dir).filter("counterparty is not null").withColumn("counterparty", F.sha2("counterparty", 256))
    return flat(resolve.changed_names(rows, resolve.with_canonical_names(rows)))


@query(f"with {L1}, g as (select statement_id, count(*) as n, {CR} as credit from l1 where direction = 'CREDIT' group by 1) select * from g")
def dated_credits(spark, sf_dir):
    rows = catalog.dated(tables.ledger(spark, sf_dir).withColumn("day", F.col("txn_date").cast("string")), "day").filter("direction = 'CREDIT'")
    return flat(rows.groupBy("statement_id").agg(F.count("*").alias("n"), F.sum("amount").alias("credit")))


@query(f"with {_LINES}, g as (select doc_id, count(*) as n_lines, min(line) as least_line from lines group by 1) select doc_id, n_lines, sha256(coalesce(least_line, '')) as least_sha256 from g")
def lines_of_texts(spark, sf_dir):
    lines = parse.text_lines(tables.table(spark, sf_dir, "documents"), "doc_id")
    return flat(lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("line").alias("l")).select("doc_id", "n_lines", F.sha2(F.coalesce("l", F.lit("")), 256).alias("least_sha256")))


@query(f"""with {L2} select statement_id, {CR} as credit_total, {DR} as debit_total, {NET} as net, concat(strftime(min(txn_date), '%Y-%m-%d'), ' to ', strftime(max(txn_date), '%Y-%m-%d')) as statement_period, 1 as warnings from l2 group by 1""".replace("1 as warnings", "cast(1 as bigint) as warnings"))
def statements_from_text(spark, sf_dir):
    """Printed text to nested results; no balance is printed, so each statement has the warning of a failed validation."""
    results, _, _ = api.process_texts(tables.statement_texts(spark, sf_dir), readers.LineReader())
    return flat(results["statement"].withColumn("warnings", F.size("warnings").cast("bigint")), "statement_id", "credit_total", "debit_total", "net", "statement_period", "warnings")


@query(f"""with {ST} select statement_id, 2 as first_line, 'heuristic' as method, count(*) - 2 as read_rows, 'OK' as status from sl group by 1""".replace("2 as first_line", "cast(2 as bigint) as first_line"))
def statement_statuses(spark, sf_dir):
    _, statuses, _ = api.process_texts(tables.statement_texts(spark, sf_dir), readers.LineReader())
    return flat(statuses, "statement_id", "first_line", "method", "read_rows", "status")


@query(f"with {L2} select statement_id, {TOTALS} from l2 group by 1")
def intelligence_from_text(spark, sf_dir):
    results, _, _ = api.intelligence_texts(tables.statement_texts(spark, sf_dir), readers.LineReader())
    return flat(results["totals"])


@query(f"""with {_GROUPED}, g as (select statement_id, corrected, category, payment_mode, min(seq) as f from made group by 1, 2, 3, 4),
cl as (select *, printf('CL%04d', row_number() over (partition by statement_id order by f)) as cluster_id from g)
select m.statement_id, printf('tx_%06d', seq) as transaction_id, cast(amount as double) as amount, m.corrected as direction, m.category, m.payment_mode, cluster_id from made m join cl on m.statement_id = cl.statement_id and m.corrected = cl.corrected and m.category = cl.category and m.payment_mode = cl.payment_mode""")
def grouped_transaction_tree(spark, sf_dir):
    rows = _grouped(spark, sf_dir)["transactions"]
    return flat(rows.select("statement_id", "transaction_id", "raw.amount", "raw.direction", "classification.category", "party.payment_mode", "cluster_id"))


@query(f"""with {_CHECKED2} select statement_id, printf('tx_%06d', seq) as transaction_id, cast(amount as double) as amount, direction, {_mode_sql(t.MODES, 'upper(narration)', 'UNKNOWN')} as payment_mode,
  case event_type when 'purchase' then 'PURCHASE' when 'click' then 'BANK_CHARGES' when 'error' then 'REFUND' when 'view' then 'INTERNAL_TRANSFER' else 'UNKNOWN' end as category from w""")
def evidence_transaction_tree(spark, sf_dir):
    rows = _evidence(spark, sf_dir)["transactions"]
    return flat(rows.select("statement_id", "transaction_id", "raw.amount", "raw.direction", "normalized.payment_mode", "classification.category"))
