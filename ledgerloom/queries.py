"""The engine's queries over the driver's tables, each beside the SQL it must equal.

Exact decimals leave as doubles, dates as text and lists joined by commas, so that values compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text as t
from ledgerloom.functions.similarity import sequence_ratio
from ledgerloom.operators import aggregate, catalog, classify, cluster, duplicates, parse, recurring, resolve, review, validate
from ledgerloom.plans import manual
from ledgerloom.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Views that the SQL below is written over.
L1 = """l1 as (
  select o.o_custkey as statement_id,
    row_number() over (partition by o.o_custkey order by l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) as seq,
    l.l_orderkey, l.l_partkey, cast(l.l_shipdate as date) as txn_date, cast(l.l_extendedprice as decimal(15,2)) as amount,
    case when l.l_returnflag = 'R' then 'CREDIT' else 'DEBIT' end as direction,
    case when l.l_partkey % 17 = 0 then null else s.s_name end as counterparty, p.p_type as category,
    case o.o_orderpriority when '1-URGENT' then 'RTGS' when '2-HIGH' then 'NEFT' when '3-MEDIUM' then 'UPI' when '4-NOT SPECIFIED' then 'IMPS' else 'CASH' end as payment_mode,
    case when l.l_returnflag = 'R' then 'RECEIPT' else 'PAYMENT' end as relationship,
    cast(1 - 5 * l.l_discount as decimal(3,2)) as confidence
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join supplier s on l.l_suppkey = s.s_suppkey join part p on l.l_partkey = p.p_partkey
)"""
L1B = L1 + """, l1b as (
  select l1.* exclude (direction), cast(c.c_acctbal as decimal(15,2)) as opening_balance,
    case when l_partkey % 5 = 0 then null else cast(c.c_acctbal as decimal(15,2))
      + sum(case when direction = 'CREDIT' then amount else -amount end) over (partition by statement_id order by seq)
      + case when l_partkey % 37 = 0 then 1 else 0 end end as balance,
    case when l_partkey % 11 = 0 then 'UNKNOWN' when l_partkey % 13 = 0 then case direction when 'CREDIT' then 'DEBIT' else 'CREDIT' end else direction end as direction
  from l1 join customer c on l1.statement_id = c.c_custkey
)"""
L2 = """l2 as (
  select user_id as statement_id, event_id, cast(ts as date) as txn_date, cast(value as decimal(15,2)) as amount,
    case when event_type in ('purchase', 'click') then 'DEBIT' else 'CREDIT' end as direction,
    case event_type when 'purchase' then concat('UPI/shop', json_extract_string(props,'$.k'), '@okbank/REF ', cast(event_id + 100000000 as varchar))
      when 'click' then concat('POS CARD FEE ', json_extract_string(props,'$.k')) when 'error' then concat('REFUND REVERSAL ', json_extract_string(props,'$.k'))
      when 'signup' then concat('NEFT-HDFC0', '123456-ACME TRADERS ', json_extract_string(props,'$.k')) else concat('CASH DEPOSIT SELF TRF ', json_extract_string(props,'$.k')) end as narration,
    event_type as counterparty, case when event_id % 40 = 0 then null else cast(event_id + 100000000 as varchar) end as reference_number
  from events
)"""
L2D = L2 + """, l2d as (
  select *, event_id as row_id from l2 union all select *, event_id + 10000000 as row_id from l2 where event_id % 20 = 0
)"""
MEAN = "((2 * sum(cast(coalesce(confidence, 0) * 100 as bigint)) + count(*)) // (2 * count(*))) / 100.0"
SUM = "cast(coalesce(sum(amount) filter (where direction = '{0}'), 0) as double)"
CR, DR = SUM.format("CREDIT"), SUM.format("DEBIT")
NET = "cast(coalesce(sum(amount) filter (where direction = 'CREDIT'), 0) - coalesce(sum(amount) filter (where direction = 'DEBIT'), 0) as double)"
TOTALS = f"count(*) as transaction_count, {CR} as total_credit, {DR} as total_debit, {NET} as net_amount"
DATES = "cast(min(txn_date) as varchar) as first_date, cast(max(txn_date) as varchar) as last_date"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns (all if none), in types that compare."""
    out = []
    for name, kind in (df.select(*columns) if columns else df).dtypes:
        c = F.col(name)
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind in ("int", "smallint"):
            c = c.cast("bigint")
        elif kind in ("date", "timestamp_ntz", "timestamp"):
            c = c.cast("string")
        elif kind.startswith("array"):
            c = F.array_join(c, ",")
        out.append(c.alias(name))
    return df.select(*out)


def narrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrated ledger with a sequence by event."""
    rows = tables.narrated_ledger(spark, sf_dir)
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("statement_id").orderBy("event_id")))
    return rows.withColumn("transaction_id", F.col("event_id").cast("string"))


def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.doubled_ledger(spark, sf_dir)
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("statement_id").orderBy("row_id")))
    return rows.withColumn("transaction_id", F.col("row_id").cast("string"))


@query(f"with {L1} select statement_id, {TOTALS}, {DATES} from l1 group by 1")
def totals_by_statement(spark, sf_dir):
    return flat(aggregate.statement_totals(tables.ledger(spark, sf_dir)))


_SIDE = """with {view} , g as (
  select statement_id, counterparty, count(*) as transaction_count, sum(amount) as total_, {dates}, array_to_string(list_sort(list(distinct payment_mode)), ',') as payment_modes,
    {mean} as confidence, min(seq) as first_seq from l1 where direction = '{side}' group by 1, 2
)
select statement_id, coalesce(counterparty, 'UNRESOLVED') as counterparty_name, transaction_count, cast(total_ as double) as total, first_date, last_date, payment_modes, confidence,
  row_number() over (partition by statement_id order by total_ desc, first_seq) as rank from g"""
_SIDE_COLUMNS = ("statement_id", "counterparty_name", "transaction_count", "total", "first_date", "last_date", "payment_modes", "confidence", "rank")


@query(_SIDE.format(view=L1, dates=DATES, mean=MEAN, side="DEBIT"))
def whom_did_we_pay(spark, sf_dir):
    return flat(aggregate.side_summary(tables.ledger(spark, sf_dir), "DEBIT"), *_SIDE_COLUMNS)


@query(_SIDE.format(view=L1, dates=DATES, mean=MEAN, side="CREDIT"))
def who_paid_us(spark, sf_dir):
    return flat(aggregate.side_summary(tables.ledger(spark, sf_dir), "CREDIT"), *_SIDE_COLUMNS)


_CLUSTER = """with {view}, k as (select *, {keys} from l1), gaps as (
  select *, date_diff('day', lag(txn_date) over (partition by statement_id, {names} order by txn_date), txn_date) as gap from k
), g as (
  select statement_id, {names}, count(*) as transaction_count, {cr} as credit_total, {dr} as debit_total, cast(sum(amount) as double) as total_amount, sum(amount) as exact_total, {dates}, {mean} as confidence,
    count(txn_date) >= 3 and count(*) filter (where gap between 20 and 40) >= greatest(2, (count(txn_date) - 1) // 2) as recurring, min(seq) as first_seq,
    string_agg(printf('tx_%06d', seq), ',' order by seq) as transaction_ids
  from gaps group by statement_id, {names}
)
select * exclude (exact_total, first_seq), printf('CL%04d', row_number() over (partition by statement_id order by first_seq)) as cluster_id,
  row_number() over (partition by statement_id order by direction, exact_total desc, first_seq) as rank from g"""
_KEY = {"category": "category", "month": "strftime(txn_date, '%Y-%m') as month", "counterparty": "coalesce(counterparty, 'UNKNOWN') as counterparty", "payment_mode": "payment_mode", "relationship": "relationship"}


def _cluster_sql(*fields: str) -> str:
    replaced = [f for f in fields if f in ("counterparty",)]
    keys = ", ".join(_KEY[f] for f in fields if f in ("month",)) or "1 as one"
    view = L1.replace("case when l.l_partkey % 17 = 0 then null else s.s_name end as counterparty", "coalesce(case when l.l_partkey % 17 = 0 then null else s.s_name end, 'UNKNOWN') as counterparty") if replaced else L1
    return _CLUSTER.format(view=view, keys=keys, names=", ".join(("direction", *fields)), cr=CR, dr=DR, dates=DATES, mean=MEAN)


def _clusters(spark, sf_dir, *fields):
    found = cluster.cluster_by_fields(tables.ledger(spark, sf_dir), fields)
    return flat(found, "statement_id", "direction", *fields, "transaction_count", "credit_total", "debit_total", "total_amount", "first_date", "last_date", "confidence", "recurring", "transaction_ids", "cluster_id", "rank")


@query(_cluster_sql("category"))
def cluster_v1_category(spark, sf_dir):
    return _clusters(spark, sf_dir, "category")


@query(_cluster_sql("counterparty", "month"))
def cluster_v1_counterparty_month(spark, sf_dir):
    return _clusters(spark, sf_dir, "counterparty", "month")


@query(_cluster_sql("payment_mode", "relationship"))
def cluster_v1_mode_relationship(spark, sf_dir):
    return _clusters(spark, sf_dir, "payment_mode", "relationship")


@query(f"""with {L1}, g as (
  select statement_id, coalesce(counterparty, 'UNKNOWN') as counterparty, count(*) as transaction_count, {CR} as total_received, {DR} as total_paid, {NET} as net_amount, {DATES},
    array_to_string(list_sort(list(distinct payment_mode)), ',') as payment_modes, {MEAN} as confidence, sum(amount) as moved, min(seq) as first_seq
  from l1 group by 1, 2)
select * exclude (moved, first_seq), row_number() over (partition by statement_id order by moved desc, first_seq) as rank, total_received > 0 as is_payer, total_paid > 0 as is_payee from g""")
def counterparty_summary_v1(spark, sf_dir):
    return flat(aggregate.counterparty_summary(tables.ledger(spark, sf_dir)).drop("first_seq"))


_KEYED = """with {view} select statement_id, {key} as key, count(*) as transaction_count, {cr} as credits, cast(coalesce(sum(amount) filter (where direction <> 'CREDIT'), 0) as double) as debits,
  cast(coalesce(sum(amount) filter (where direction = 'CREDIT'), 0) - coalesce(sum(amount) filter (where direction <> 'CREDIT'), 0) as double) as net from {table} group by 1, 2"""


@query(_KEYED.format(view=L1, table="l1", key="category", cr=CR))
def category_summary(spark, sf_dir):
    return flat(aggregate.category_summary(tables.ledger(spark, sf_dir)))


@query(_KEYED.format(view=L1, table="l1", key="payment_mode", cr=CR))
def mode_summary(spark, sf_dir):
    return flat(aggregate.payment_mode_summary(tables.ledger(spark, sf_dir)))


@query(_KEYED.format(view=L2, table="l2", key="strftime(txn_date, '%Y-%m')", cr=CR))
def month_summary(spark, sf_dir):
    return flat(aggregate.month_summary(tables.narrated_ledger(spark, sf_dir)))


@query(f"""with {L1} select statement_id, 'category' as dimension, category as key, {TOTALS} from l1 group by 1, 3
union all select statement_id, 'payment_mode', payment_mode, {TOTALS} from l1 group by 1, 3
union all select statement_id, 'month', strftime(txn_date, '%Y-%m'), {TOTALS} from l1 group by 1, 3""")
def grouping_sets_summary(spark, sf_dir):
    return flat(aggregate.group_totals(tables.ledger(spark, sf_dir)))


@query(f"with {L1} select statement_id, category, cast(sum(amount) filter (where direction = 'CREDIT') as double) as received, cast(sum(amount) filter (where direction = 'DEBIT') as double) as paid from l1 group by 1, 2")
def category_breakdown_pivot(spark, sf_dir):
    return flat(aggregate.category_breakdown(tables.ledger(spark, sf_dir)))


@query(f"with {L1} select statement_id, relationship, count(*) as n from l1 group by 1, 2")
def relationship_histogram(spark, sf_dir):
    return flat(aggregate.relationship_histogram(tables.ledger(spark, sf_dir)))


@query(f"""with {L1}, gaps as (
  select *, date_diff('day', lag(txn_date) over (partition by statement_id, counterparty order by txn_date), txn_date) as gap from l1 where counterparty is not null
), rel as (
  select statement_id, counterparty, relationship, count(*) as n, min(seq) as f from l1 where counterparty is not null group by 1, 2, 3
), top as (
  select statement_id, counterparty, relationship as top_relationship, row_number() over (partition by statement_id, counterparty order by n desc, f) as r from rel
), g as (
  select statement_id, counterparty, {TOTALS}, {DATES}, {MEAN} as cluster_confidence,
    count(distinct strftime(txn_date, '%Y-%m')) >= 3 and coalesce(median(gap) filter (where gap > 0) between 24 and 36, false) as recurring,
    concat(count(*), ' transaction(s) matched as NEW') as evidence from gaps group by 1, 2
)
select g.*, top_relationship, printf('CL_%04d', row_number() over (partition by statement_id order by counterparty)) as cluster_id,
  case when recurring then 'RECURRING_PAYMENT' else 'COUNTERPARTY' end as cluster_type from g join top using (statement_id, counterparty) where r = 1""")
def clusters_v2(spark, sf_dir):
    found = cluster.counterparty_clusters(tables.ledger(spark, sf_dir))
    return flat(found, "statement_id", "counterparty", "transaction_count", "total_credit", "total_debit", "net_amount", "first_date", "last_date", "cluster_confidence", "recurring", "evidence", "top_relationship", "cluster_id", "cluster_type")


@query(f"""with {L1}, gaps as (select *, date_diff('day', lag(txn_date) over (partition by statement_id, category order by txn_date), txn_date) as gap from l1)
select statement_id, category, count(txn_date) >= 3 and count(*) filter (where gap between 20 and 40) >= greatest(2, (count(txn_date) - 1) // 2) as recurring from gaps group by 1, 2""")
def recurring_v1(spark, sf_dir):
    return flat(recurring.recurring_by_bands(tables.ledger(spark, sf_dir), ["statement_id", "category"]))


@query(f"""with {L1}, gaps as (select *, date_diff('day', lag(txn_date) over (partition by statement_id, category order by txn_date), txn_date) as gap from l1)
select statement_id, category, count(distinct strftime(txn_date, '%Y-%m')) >= 3 and coalesce(median(gap) filter (where gap > 0) between 24 and 36, false) as recurring from gaps group by 1, 2""")
def recurring_v2(spark, sf_dir):
    return flat(recurring.recurring_by_median(tables.ledger(spark, sf_dir), ["statement_id", "category"]))


_ADJACENT = L1B + """, n as (
  select *, balance - lag(balance) over w as up, balance - lead(balance) over w as down, case when direction = 'CREDIT' then amount else -amount end as signed from l1b window w as (partition by statement_id order by seq)
), f as (select *, coalesce(cast(up = signed as int), 0) as fit_up, coalesce(cast(down = signed as int), 0) as fit_down from n),
d as (select *, sum(fit_down) over (partition by statement_id) > sum(fit_up) over (partition by statement_id) as descending from f),
c as (select *, case when descending then down else up end as delta, case when descending then fit_down else fit_up end as fits from d),
e as (select *, case when abs(delta) = amount then case when delta > 0 then 'CREDIT' else 'DEBIT' end else direction end as corrected from c)"""


@query(f"""with {_ADJACENT}, g as (
  select statement_id, count(*) as transaction_count, {CR} as credit_total, {DR} as debit_total, count(delta) as pairs, cast(coalesce(sum(fits) filter (where delta is not null), 0) as bigint) as fitting,
    count(*) - count(distinct (txn_date, amount, direction)) as duplicate_rows, count(*) filter (where direction not in ('CREDIT', 'DEBIT')) as missing_data,
    count(*) filter (where direction <> corrected) as directions_corrected, bool_or(descending) as descending from e group by 1)
select *, case when pairs > 0 and 100 * fitting >= 90 * pairs then 'PASS' when pairs > 0 and 100 * fitting >= 70 * pairs then 'WARNING' else 'FAIL' end as validation_status from g""")
def validate_v1(spark, sf_dir):
    found = validate.validate_adjacent(tables.damaged_ledger(spark, sf_dir))
    return flat(found, "statement_id", "transaction_count", "credit_total", "debit_total", "pairs", "fitting", "duplicate_rows", "missing_data", "directions_corrected", "descending", "validation_status")


_CHECKED = L1B + """, p as (
  select *, balance - coalesce(last_value(balance ignore nulls) over (partition by statement_id order by seq rows between unbounded preceding and 1 preceding), opening_balance) as delta from l1b
), r as (
  select *, case when direction <> 'UNKNOWN' then direction when abs(delta - amount) <= 0.02 then 'CREDIT' when abs(delta + amount) <= 0.02 then 'DEBIT' else 'UNKNOWN' end as read_direction from p
), s as (select *, case when read_direction = 'CREDIT' then amount else -amount end as signed from r),
v as (
  select * exclude (direction), direction as printed, coalesce(abs(delta - signed) <= 0.02, false) as fits, coalesce(abs(delta + signed) <= 0.02, false) and read_direction <> 'UNKNOWN' as flips from s
), w as (
  select *, delta is not null as checked, fits or flips as reconciled, case when flips and not fits then case when read_direction = 'CREDIT' then 'DEBIT' else 'CREDIT' end else read_direction end as direction from v
)"""


@query(f"""with {_CHECKED}, g as (
  select statement_id, count(*) as transaction_count, count(*) filter (where checked) as checked, count(*) filter (where reconciled) as reconciled,
    cast(sum(case when printed <> read_direction then 1 else 0 end + case when flips and not fits then 1 else 0 end) as bigint) as directions_corrected,
    {CR} as credit_total, {DR} as debit_total, count(*) filter (where checked and not reconciled) as balance_breaks, bool_or(direction = 'UNKNOWN' or txn_date is null) as incomplete_rows from w group by 1)
select *, case when checked > 0 and 100 * reconciled < 70 * checked then 'FAIL' when balance_breaks = 0 and not incomplete_rows then 'PASS' else 'WARNING' end as validation_status from g""")
def validate_v2(spark, sf_dir):
    found = validate.validate(tables.damaged_ledger(spark, sf_dir))
    return flat(found, "statement_id", "transaction_count", "checked", "reconciled", "directions_corrected", "credit_total", "debit_total", "balance_breaks", "incomplete_rows", "validation_status")


@query(f"with {_CHECKED} select statement_id, cast(seq as bigint) as seq, cast(amount as double) as amount, cast(delta as double) as delta, direction from w where checked and not reconciled")
def balance_breaks(spark, sf_dir):
    found = validate.balance_breaks(tables.damaged_ledger(spark, sf_dir)).withColumn("direction", F.col("corrected_direction"))
    return flat(found, "statement_id", "seq", "amount", "delta", "direction")


_NAME = r"nullif(trim(regexp_replace(upper(regexp_replace({0}, '[^A-Za-z0-9&.\-@ ]+', ' ', 'g')), ' +', ' ', 'g')), '')"


@query(f"with {L2D}, n as (select *, {_NAME.format('narration')} as norm from l2d), c as (select *, count(*) over (partition by statement_id, txn_date, amount, direction, counterparty, norm, reference_number) as group_rows from n) select row_id, group_rows from c where group_rows > 1")
def duplicates_exact_v1(spark, sf_dir):
    return flat(duplicates.exact_duplicate_rows(doubled(spark, sf_dir)), "row_id", "group_rows")


_TIERS = f"""with {L2D}, s as (select *, row_number() over (partition by statement_id order by row_id) as seq from l2d), h as (
  select *, case when reference_number is not null and count(*) over w > 1 then min(seq) over w end as high from s window w as (partition by statement_id, reference_number, amount, direction)
), m as (
  select *, case when high is null and count(*) over w > 1 then min(seq) over w end as medium from h window w as (partition by statement_id, txn_date, amount, direction, counterparty, high is null)
)"""


@query(f"{_TIERS} select row_id, cast(high as bigint) as first_seq from m where high is not null")
def duplicates_high(spark, sf_dir):
    return flat(duplicates.duplicate_tiers(doubled(spark, sf_dir)).filter("high is not null").withColumn("first_seq", F.col("high")), "row_id", "first_seq")


@query(f"{_TIERS} select row_id, cast(medium as bigint) as first_seq from m where medium is not null")
def duplicates_medium(spark, sf_dir):
    return flat(duplicates.duplicate_tiers(doubled(spark, sf_dir)).filter("medium is not null").withColumn("first_seq", F.col("medium")), "row_id", "first_seq")


@query()
def duplicates_possible(spark, sf_dir):
    rows = doubled(spark, sf_dir).withColumns({"reference_number": F.lit(None).cast("string"), "counterparty": F.lit(None).cast("string")})
    return flat(duplicates.possible_duplicates(duplicates.duplicate_tiers(rows)))


@query()
def duplicate_groups(spark, sf_dir):
    return flat(duplicates.duplicate_groups(doubled(spark, sf_dir)))


@query(f"""with {L2}, b as (select * replace (case when event_id % 50 = 0 then amount * 100 else amount end as amount) from l2), m as (select statement_id, list_sort(list(amount))[len(list(amount)) // 2 + 1] as median_amount from b group by 1)
select event_id, cast(amount as double) as amount, cast(median_amount as double) as median_amount from b join m using (statement_id) where median_amount > 0 and amount >= 10 * median_amount""")
def unusual_amounts(spark, sf_dir):
    """With a hundredfold amount here and there."""
    raised = F.when(F.col("event_id") % 50 == 0, F.col("amount") * 100).otherwise(F.col("amount"))
    rows = tables.narrated_ledger(spark, sf_dir).withColumn("amount", raised)
    found = rows.join(aggregate.upper_median(rows), "statement_id").filter("median_amount > 0 and amount >= 10 * median_amount")
    return flat(found, "event_id", "amount", "median_amount")


@query(f"with {L1} select statement_id, cast(list_sort(list(amount))[len(list(amount)) // 2 + 1] as double) as median_amount from l1 group by 1")
def upper_median(spark, sf_dir):
    return flat(aggregate.upper_median(tables.ledger(spark, sf_dir)))


_QUEUE_V1 = f"""with {L2D}, r as (
  select *, 'UNKNOWN' as category, case when event_id % 7 = 0 then 0.5 else 0.9 end as confidence, case when event_id % 9 = 0 then 'REFUND' else 'PAYMENT' end as relationship, {_NAME.format('narration')} as norm from l2d
), med as (select statement_id, list_sort(list(amount))[len(list(amount)) // 2 + 1] as median_amount from r group by 1),
c as (select r.*, median_amount, count(*) over (partition by statement_id, txn_date, amount, direction, counterparty, norm, reference_number) as n from r join med using (statement_id))
select row_id, issue, count(*) as n from (
  select row_id, 'possible_duplicate' as issue from c where n > 1
  union all select row_id, 'low_confidence' from c where confidence < 0.6
  union all select row_id, 'classification_unknown' from c
  union all select row_id, 'unusual_amount' from c where median_amount > 0 and amount >= 10 * median_amount
  union all select row_id, 'possible_internal_transfer' from c where contains(upper(narration), 'SELF TRF')
  union all select row_id, 'missing_reference' from c where reference_number is null and not regexp_matches(narration, '(?i)\\b(?:UTR|RRN|REF|REFERENCE)[\\s:/-]*([A-Za-z0-9]+)')
  union all select row_id, 'possible_refund' from c where relationship = 'REFUND'
) group by 1, 2"""


@query(_QUEUE_V1)
def review_queue_v1(spark, sf_dir):
    rows = doubled(spark, sf_dir).withColumns({
        "category": F.lit("UNKNOWN"), "confidence": F.when(F.col("event_id") % 7 == 0, 0.5).otherwise(0.9), "relationship": F.when(F.col("event_id") % 9 == 0, "REFUND").otherwise("PAYMENT"),
    })
    none = spark.createDataFrame([], "statement_id long, balance_consistency double")
    items = review.queue_grouped(rows, none, duplicates.exact_duplicate_rows(rows))
    return flat(items.groupBy(F.col("transaction_id").cast("bigint").alias("row_id"), F.col("issue_type").alias("issue")).agg(F.count("*").alias("n")))


def _reviewed(spark, sf_dir) -> DataFrame:
    """Ledger rows with the columns that the evidence-based queue reads."""
    part = F.col("l_partkey")
    return tables.ledger(spark, sf_dir).withColumns({
        "balance_break": part % 37 == 0, "extraction_confidence": F.col("confidence").cast("double"), "match_type": F.when(part % 19 == 0, "POSSIBLE").otherwise("NEW"),
        "possible_match_of": F.when(part % 19 == 0, "CP_00001"), "category": F.when(part % 23 == 0, "UNKNOWN").when(part % 7 == 0, "PERSONAL_EXPENSE").otherwise("PURCHASE"),
        "category_review": part % 29 == 0, "category_confidence": F.col("confidence").cast("double"), "own_account": part % 31 == 0, "evidence": F.array().cast("array<string>"),
        "duplicate_group_id": F.when(part % 41 == 0, "DUP_0001"), "duplicate_confidence": F.when(part % 41 == 0, F.when(part % 2 == 0, "HIGH").otherwise("MEDIUM")),
    })


_QUEUE_V2 = f"""with {L1}, r as (
  select *, l_partkey as k, case when l_partkey % 23 = 0 then 'UNKNOWN' when l_partkey % 7 = 0 then 'PERSONAL_EXPENSE' else 'PURCHASE' end as cat, l_partkey % 29 = 0 or l_partkey % 23 = 0 as unsure from l1
), i as (
  select statement_id, seq, 0 as rule_no, 'BALANCE_MISMATCH' as issue_type, 'HIGH' as severity from r where k % 37 = 0
  union all select statement_id, seq, 1, 'POOR_EXTRACTION', 'MEDIUM' from r where cast(confidence as double) < 0.6
  union all select statement_id, seq, 2, 'UNKNOWN_COUNTERPARTY', 'MEDIUM' from r where counterparty is null
  union all select statement_id, seq, 3, 'POSSIBLE_ENTITY_MATCH', 'MEDIUM' from r where counterparty is not null and k % 19 = 0
  union all select statement_id, seq, 4, 'UNCERTAIN_CLASSIFICATION', 'MEDIUM' from r where unsure
  union all select statement_id, seq, 5, 'PERSONAL_OR_BUSINESS_UNCLEAR', 'MEDIUM' from r where not unsure and cat = 'PERSONAL_EXPENSE' and cast(confidence as double) < 0.8
  union all select statement_id, seq, 6, 'INTERNAL_TRANSFER_SUSPECTED', 'HIGH' from r where k % 31 = 0
  union all select statement_id, seq, 7, 'DUPLICATE_SUSPECTED', case when k % 2 = 0 then 'HIGH' else 'MEDIUM' end from r where k % 41 = 0
)"""


@query(f"""{_QUEUE_V2} select statement_id, cast(seq as bigint) as seq, issue_type, severity,
  row_number() over (partition by statement_id order by case severity when 'HIGH' then 0 else 1 end, case issue_type when 'BALANCE_MISMATCH' then 0 else 1 end, seq, rule_no) as position from i""")
def review_queue_v2(spark, sf_dir):
    return flat(review.queue(_reviewed(spark, sf_dir)), "statement_id", "seq", "issue_type", "severity", "position")


@query(f"{_QUEUE_V2} select statement_id, printf('tx_%06d', seq) as transaction_id, array_to_string(list_sort(list(distinct issue_type)), ',') as review_flags from i group by 1, 2")
def review_flags(spark, sf_dir):
    return flat(review.flags(review.queue(_reviewed(spark, sf_dir))))


def _mode_sql(rules, text: str, otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, '{p}') then '{m}'" for m, p in rules) + f" else '{otherwise}' end"


@query(f"with {L2} select event_id, {_mode_sql(t.MODES_V1, 'upper(narration)', 'UNKNOWN')} as payment_mode from l2")
def payment_mode_v1(spark, sf_dir):
    return tables.narrated_ledger(spark, sf_dir).select("event_id", t.payment_mode_v1(F.col("narration")).alias("payment_mode"))


@query(f"with {L2} select event_id, {_mode_sql(t.MODES, 'upper(narration)', 'UNKNOWN')} as payment_mode from l2")
def payment_mode_v2(spark, sf_dir):
    return tables.narrated_ledger(spark, sf_dir).select("event_id", t.payment_mode(F.col("narration")).alias("payment_mode"))


@query(f"select doc_id, sha256(coalesce({_NAME.format('text')}, '')) as name_sha256 from documents")
def normalize_name(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce(t.normalize_name(F.col("text")), F.lit("")), 256).alias("name_sha256"))


@query("select doc_id, sha256(coalesce(nullif(upper(trim(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '_')), ''), '')) as label_sha256 from documents")
def normalize_label(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce(t.normalize_label(F.col("text")), F.lit("")), 256).alias("label_sha256"))


@query(f"with {L2} select event_id, trim(regexp_replace(lower(regexp_replace(narration, '\\d+', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) as pattern, trim(regexp_replace(upper(narration), '[^A-Z0-9]+', ' ', 'g')) as normalized from l2")
def narration_pattern(spark, sf_dir):
    return tables.narrated_ledger(spark, sf_dir).select("event_id", t.narration_pattern(F.col("narration"), "a-z0-9").alias("pattern"), t.normalize_narration(F.col("narration")).alias("normalized"))


@query(f"""with {L2} select event_id, nullif(regexp_extract(narration, '(?i)(?:upi[/:\\-])?([A-Za-z0-9._-]+@[A-Za-z0-9._-]+)', 1), '') as upi,
  nullif(regexp_extract(narration, '(?i)\\b(?:UTR|RRN|REF|REFERENCE)[\\s:/-]*([A-Za-z0-9]+)', 1), '') as reference, nullif(regexp_extract(narration, '(?i)\\b(?:CHEQUE|CHQ|CHK)[\\s:/#-]*(\\d+)', 1), '') as cheque from l2""")
def extract_ids_v1(spark, sf_dir):
    n = F.col("narration")
    return tables.narrated_ledger(spark, sf_dir).select("event_id", t.upi_v1(n).alias("upi"), t.reference_v1(n).alias("reference"), t.cheque_number(n).alias("cheque"))


@query(f"""with {L2} select event_id, nullif(regexp_extract(upper(narration), '\\b[A-Z]{{4}}0[A-Z0-9]{{6}}\\b', 0), '') as ifsc, lower(nullif(regexp_extract(narration, '\\b[\\w.\\-]{{2,}}@[A-Za-z]{{2,}}\\b', 0), '')) as upi,
  coalesce(reference_number, nullif(regexp_extract(narration, '\\b\\d{{9,22}}\\b', 0), '')) as reference from l2""")
def extract_ids_v2(spark, sf_dir):
    n = F.col("narration")
    return tables.narrated_ledger(spark, sf_dir).select("event_id", t.ifsc(n).alias("ifsc"), t.upi(n).alias("upi"), t.reference(n, F.col("reference_number")).alias("reference"))


_STOP = ", ".join(f"'{w}'" for w in (*t.NARRATION_STOP_WORDS, *t.BANK_WORDS))


@query(f"""with {L2}, parts as (select event_id, list_transform(regexp_split_to_array(narration, '[/|:\\-]+'), lambda x: {_NAME.format('x')}) as p from l2)
select event_id, list_filter(p, lambda x: x is not null and x not in ({_STOP}) and not regexp_full_match(x, '\\d+') and (contains(x, '@') or contains(x, ' ')))[1] as counterparty from parts""")
def split_counterparty(spark, sf_dir):
    return tables.narrated_ledger(spark, sf_dir).select("event_id", t.counterparty_from_narration(F.col("narration")).alias("counterparty"))


@query(f"""with {L2} select event_id, case when contains(upper(narration), 'REFUND') then 'REFUND' when contains(upper(narration), 'REVERS') then 'REVERSAL' when contains(upper(narration), 'INTEREST') then 'INTEREST'
  when contains(upper(narration), 'CHARGE') or contains(upper(narration), 'FEE') then 'CHARGE' when direction = 'CREDIT' then 'RECEIPT' else 'PAYMENT' end as relationship from l2""")
def relationship_rules(spark, sf_dir):
    return tables.narrated_ledger(spark, sf_dir).select("event_id", t.infer_relationship(F.col("narration"), F.lit("UNKNOWN"), F.col("direction")).alias("relationship"))


_CATEGORY_OF_TYPE = "case when l_partkey % 6 = 0 then 'LOAN_RECEIPT' when l_partkey % 6 = 1 then 'GST_PAYMENT' when l_partkey % 6 = 2 then 'SALES_RECEIPT' when l_partkey % 6 = 3 then 'PERSONAL_EXPENSE' when l_partkey % 6 = 4 then 'UNKNOWN' else 'RENT' end"


@query(f"""with {L1}, c as (select *, {_CATEGORY_OF_TYPE} as cat from l1)
select statement_id, cast(seq as bigint) as seq, case when cat = 'LOAN_RECEIPT' then 'loan' when cat = 'GST_PAYMENT' then 'tax' when cat = 'PERSONAL_EXPENSE' then 'personal'
  when direction = 'CREDIT' and cat = 'SALES_RECEIPT' then 'business_income' when direction = 'DEBIT' and cat <> 'UNKNOWN' then 'business_expense' else 'unknown' end as interpretation from c""")
def income_expense(spark, sf_dir):
    rows = tables.ledger(spark, sf_dir).withColumn("category", F.expr(_CATEGORY_OF_TYPE))
    return flat(rows.withColumn("interpretation", t.income_or_expense(F.col("category"), F.col("direction"))), "statement_id", "seq", "interpretation")


@query(f"with {L2} select event_id, contains(upper(narration), 'SELF TRF') as internal from l2")
def internal_transfer(spark, sf_dir):
    return tables.narrated_ledger(spark, sf_dir).select("event_id", t.possible_internal_transfer(F.col("narration"), F.lit("UNKNOWN")).alias("internal"))


@query(f"""with {L2}, n as (select *, trim(regexp_replace(upper(narration), '[^A-Z0-9]+', ' ', 'g')) as normalized_narration from l2), g as (
  select statement_id, normalized_narration, direction as transaction_type, count(*) as transaction_count, cast(sum(amount) as double) as total_amount, string_agg(cast(event_id as varchar), ',' order by event_id) as members, min(event_id) as f from n group by 1, 2, 3)
select * exclude (f), row_number() over (partition by statement_id order by f) as cluster_id from g""")
def manual_normalize_cluster(spark, sf_dir):
    rows = tables.narrated_ledger(spark, sf_dir)
    credit = F.col("direction") == "CREDIT"
    zero = F.lit(0).cast("decimal(15,2)")
    rows = rows.withColumns({"deposit": F.when(credit, F.col("amount")).otherwise(zero), "withdrawal": F.when(credit, zero).otherwise(F.col("amount"))}).drop("amount")
    return flat(manual.clusters(manual.normalized(rows, "direction"), "event_id", "event_id"), "statement_id", "normalized_narration", "transaction_type", "transaction_count", "total_amount", "members", "cluster_id")


_LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents)"


@query("select doc_id, length(text) as n_chars, len(string_split(text, chr(10))) as n_lines, array_to_string(list_transform(string_split(text, chr(10))[1:8], lambda x: substring(x, 1, 150)), chr(10)) as preview from documents")
def inspect_text(spark, sf_dir):
    return flat(parse.inspect(tables.table(spark, sf_dir, "documents"), "doc_id"))


@query("""select o_custkey, o_orderkey, o_orderstatus, cast(o_totalprice as double) as o_totalprice from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1""")
def latest_statement_per_file(spark, sf_dir):
    return catalog.latest_per_key(tables.table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("select o_orderkey, o_custkey from orders order by o_orderdate desc, o_orderkey desc limit 24 offset 48")
def paged_list(spark, sf_dir):
    return catalog.page(tables.table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_orderkey", "o_custkey")


@query("""with f as (select *, o_orderstatus = 'P' or o_custkey % 10 = 0 as is_deleted, o_orderstatus <> 'P' and o_custkey % 10 <> 0 and o_orderkey % 2 = 0 as is_active from orders)
select o_orderkey, case when is_deleted then 'dead' when is_active then 'active' else 'inactive' end as state from f""")
def soft_delete_views(spark, sf_dir):
    flagged = tables.table(spark, sf_dir, "orders").withColumns({"is_deleted": F.col("o_orderstatus") == "P", "is_active": (F.col("o_orderkey") % 2 == 0) & (F.col("o_orderstatus") != "P")})
    rows = catalog.soft_deleted(flagged, F.col("o_custkey") % 10 == 0)
    part = lambda df, name: df.select("o_orderkey", F.lit(name).alias("state"))
    return part(catalog.dead(rows), "dead").unionByName(part(catalog.active(rows), "active")).unionByName(part(catalog.inactive(rows), "inactive"))


@query("select l_orderkey, min(l_partkey) as l_partkey from lineitem group by 1 having count(*) = 1")
def get_or_none(spark, sf_dir):
    return catalog.only_row_per_key(tables.table(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", "l_partkey")


@query("""with v as (select conv_id, turn, case when role = 'user' then text end as asked, case when role = 'assistant' then text end as answered from conversations)
select conv_id, arg_min(asked, turn) filter (where asked is not null) as asked, arg_max(answered, turn) filter (where answered is not null) as answered from v group by 1""")
def coalesce_pages(spark, sf_dir):
    pages = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("asked"), F.when(F.col("role") == "assistant", F.col("text")).alias("answered"))
    return aggregate.first_and_last_known(pages, "conv_id", "turn", ["asked"], ["answered"])


@query(f"with {L1}, g as (select statement_id, counterparty, count(*) as n from l1 where counterparty is not null group by 1, 2), r as (select *, row_number() over (partition by statement_id order by n desc, counterparty) as rank from g) select * from r where rank <= 40")
def top_k_counterparties(spark, sf_dir):
    return flat(aggregate.top_counterparties(tables.ledger(spark, sf_dir)))


@query(f"with {L1}, g as (select statement_id, counterparty, count(*) as n, min(seq) as first_seq from l1 where counterparty is not null group by 1, 2) select statement_id, counterparty, n, row_number() over (partition by statement_id order by n desc, first_seq) as rank from g")
def frequent_names(spark, sf_dir):
    return flat(aggregate.frequent_names(tables.ledger(spark, sf_dir)).drop("first_seq"))


@query("select doc_id, coalesce(quality, -1) as quality, coalesce(toxic, 0) as toxic from documents left join labels using (doc_id)")
def left_default_join(spark, sf_dir):
    docs, labels = tables.table(spark, sf_dir, "documents").select("doc_id"), tables.table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def anti_missing(spark, sf_dir):
    docs, labels = tables.table(spark, sf_dir, "documents").select("doc_id"), tables.table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti")


@query(f"""{_QUEUE_V2}, f as (select statement_id, seq, list(distinct issue_type) as flags from i group by 1, 2)
select l1.statement_id, cast(l1.seq as bigint) as seq, flags is not null as requires_review, coalesce(list_contains(flags, 'DUPLICATE_SUSPECTED'), false) as possible_duplicate from l1 left join f using (statement_id, seq)""")
def exists_flags(spark, sf_dir):
    rows = _reviewed(spark, sf_dir)
    return flat(review.with_flags(rows, review.queue(rows)), "statement_id", "seq", "requires_review", "possible_duplicate")


@query(f"with {L1}, c as (select statement_id, case when l_partkey % 3 = 0 then 'PURCHASE' when l_partkey % 3 = 1 then 'RENT' else 'UTILITIES' end as category from l1) select statement_id, case category when 'PURCHASE' then 'INVENTORY' else category end as category, count(*) as n from c group by 1, 2")
def map_canonical(spark, sf_dir):
    rows = tables.ledger(spark, sf_dir).withColumn("category", F.when(F.col("l_partkey") % 3 == 0, "PURCHASE").when(F.col("l_partkey") % 3 == 1, "RENT").otherwise("UTILITIES"))
    merges = spark.createDataFrame([("purchase", "Inventory"), ("RENT", "NO SUCH LABEL")], "label string, canonical string")
    return flat(classify.merge_categories(rows, merges).groupBy("statement_id", "category").agg(F.count("*").alias("n")))


@query(f"""with {L1}, c as (select *, row_number() over (partition by statement_id order by seq) % 20 as x from l1)
select statement_id, cast(seq as bigint) as seq, case when l_partkey % 4 = 0 then 'UNKNOWN' when cast(confidence as double) < 0.4 or l_partkey % 5 = 0 then 'UNKNOWN' else 'PURCHASE' end as category,
  case when l_partkey % 4 = 0 then true else cast(confidence as double) < 0.6 or l_partkey % 5 = 0 end as category_review from c""")
def classification_guards(spark, sf_dir):
    rows = tables.ledger(spark, sf_dir)
    made = rows.filter("l_partkey % 4 <> 0").select("statement_id", "transaction_id", F.lit("purchase ").alias("category"), F.col("confidence").cast("double").alias("confidence"), F.when(F.col("l_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("invoice"))).alias("evidence"), F.lit(False).alias("requires_review"))
    return flat(classify.classify(rows, made), "statement_id", "seq", "category", "category_review")


@query(f"with {L1}, m as (select *, (seq - 1) // 20 as batch_no from l1) select statement_id, batch_no, count(*) as n, {CR} as credit from m group by 1, 2")
def row_batches(spark, sf_dir):
    rows = tables.ledger(spark, sf_dir).withColumn("batch_no", parse.batch_number(20))
    return flat(rows.groupBy("statement_id", "batch_no").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("direction") == "CREDIT", F.col("amount"))), F.lit(0).cast("decimal(25,2)")).alias("credit")))


@query(f"""with {L1}, g as (select statement_id, counterparty, direction, sum(amount) as s, min(seq) as f, string_agg(printf('tx_%06d', seq), ',' order by seq) as ids from l1 where counterparty is not null group by 1, 2, 3)
select statement_id, counterparty, cast(sum(s) as double) as total, min(f) as first_seq from g group by 1, 2""")
def cluster_members_total(spark, sf_dir):
    rows = tables.ledger(spark, sf_dir)
    clusters = cluster.counterparty_clusters(rows)
    back = cluster.cluster_of_transaction(rows, clusters).filter("cluster_id is not null")
    return flat(back.groupBy("statement_id", "counterparty").agg(F.sum("amount").alias("total"), F.min("seq").alias("first_seq")))


@query(f"with {L1}, g as (select statement_id, category, count(*) as n, min(seq) as f from l1 group by 1, 2), r as (select *, count(*) over (partition by statement_id) as labels, row_number() over (partition by statement_id order by n desc, f) as rank from g) select statement_id, category, n, rank from r where labels >= 3 and rank <= 100")
def frequent_categories(spark, sf_dir):
    return flat(aggregate.frequent_categories(tables.ledger(spark, sf_dir)))


@query(f"with {L1} select statement_id, {MEAN} as mean_confidence, count(*) filter (where cast(confidence as double) < 0.6) as low_confidence, count(*) filter (where counterparty is null) as unknown_counterparties, cast(0 as bigint) as unknown_categories from l1 group by 1")
def extraction_quality(spark, sf_dir):
    return flat(aggregate.extraction_quality(tables.ledger(spark, sf_dir)))


@query(f"""with {L1}, g as (select statement_id, coalesce(counterparty, 'UNKNOWN') as counterparty, direction, sum(amount) as s, min(seq) as f from l1 group by 1, 2, 3),
r as (select *, printf('CL%04d', row_number() over (partition by statement_id order by f)) as cluster_id, row_number() over (partition by statement_id order by direction, s desc, f) as rank from g)
select statement_id, counterparty, arg_min(cluster_id, rank) as cluster_id from r group by 1, 2""")
def first_cluster_of_counterparty(spark, sf_dir):
    return cluster.first_cluster_of_counterparty(tables.ledger(spark, sf_dir))


@query(f"""with {L1}, r as (select *, case when l_partkey % 19 = 0 then 'Supplier#000000001' end as related from l1 where counterparty is not null), g as (select statement_id, counterparty, list_sort(list(distinct related)) as related from r group by 1, 2),
c as (select *, printf('CL_%04d', row_number() over (partition by statement_id order by counterparty)) as cluster_id from g)
select a.statement_id, a.cluster_id, b.cluster_id as related_cluster_ids from c a left join c b on a.statement_id = b.statement_id and b.counterparty = a.related[1]""")
def related_clusters(spark, sf_dir):
    rows = tables.ledger(spark, sf_dir).withColumn("possible_match_of", F.when(F.col("l_partkey") % 19 == 0, "Supplier#000000001"))
    return flat(cluster.related_clusters(cluster.counterparty_clusters(rows)), "statement_id", "cluster_id", "related_cluster_ids")


@query(f"with {_CHECKED} select statement_id, cast(seq as bigint) as seq, cast(balance - delta as double) as previous_balance, cast(delta as double) as delta from w where delta is not null")
def carried_balances(spark, sf_dir):
    return flat(validate.carried_balance(tables.damaged_ledger(spark, sf_dir)).filter("delta is not null"), "statement_id", "seq", "previous_balance", "delta")


@query(f"with {_ADJACENT} select statement_id, cast(seq as bigint) as seq, direction, corrected as corrected_direction from e where direction <> corrected")
def adjacent_corrections(spark, sf_dir):
    return flat(validate.adjacent_checks(tables.damaged_ledger(spark, sf_dir)).filter("direction <> corrected_direction"), "statement_id", "seq", "direction", "corrected_direction")


@query(f"with {_CHECKED} select statement_id, {TOTALS} from w group by 1")
def corrected_totals(spark, sf_dir):
    rows = validate.checked_rows(tables.damaged_ledger(spark, sf_dir)).withColumn("direction", F.col("corrected_direction"))
    return flat(aggregate.statement_totals(rows).drop("first_date", "last_date"))


@query(f"with {_LINES}, c as (select *, string_agg(line, chr(10)) over (partition by doc_id order by line_no rows between 3 preceding and 8 following) as context from lines) select doc_id, line_no, sha256(context) as context_sha256 from c")
def context_lines(spark, sf_dir):
    found = parse.context_lines(parse.text_lines(tables.table(spark, sf_dir, "documents"), "doc_id"), "doc_id")
    return flat(found.select("doc_id", "line_no", F.sha2("context", 256).alias("context_sha256")))


@query("select doc_id, sha256(concat(substring(text, 1, 6000), chr(10), '...', chr(10), right(text, 1500))) as window_sha256 from documents")
def account_window(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.sha2(parse.account_window(F.col("text")), 256).alias("window_sha256"))


@query("select conv_id, turn, concat(upper(substring(role, 1, 1)), substring(role, 2)) as shown, nullif(case when role = 'user' then '' else role end, '') as kept from conversations")
def display_and_blanks(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "conversations")
    blanked = catalog.blanks_as_null(rows.select("conv_id", "turn", t.display_choice(F.col("role")).alias("shown"), F.when(F.col("role") == "user", "").otherwise(F.col("role")).alias("kept")))
    return blanked


@query(f"with {L2} select event_id, contains(lower(narration), 'acme') or contains(lower(narration), 'traders') as grounded, regexp_replace(narration, '[^0-9]', '', 'g') as digits from l2")
def grounded_names(spark, sf_dir):
    n = F.col("narration")
    return tables.narrated_ledger(spark, sf_dir).select("event_id", t.grounded(F.lit("Acme-Traders Co"), n).alias("grounded"), t.digits(n).alias("digits"))


_MONEY = "printf('%s,%03d.%02d', cast(event_id as varchar), event_id % 1000, event_id % 100)"


@query(f"select event_id, cast(try_cast(regexp_replace({_MONEY}, '[^0-9.\\-]', '', 'g') as decimal(15,2)) as double) as amount, case when event_id % 3 = 0 then 'DEBIT' when event_id % 3 = 1 then 'CREDIT' else 'UNKNOWN' end as direction from events")
def printed_amounts(spark, sf_dir):
    i = F.col("event_id")
    printed = F.concat(F.lit("₹ "), i.cast("string"), F.lit(","), F.format_string("%03d.%02d", i % 1000, i % 100))
    side = F.when(i % 3 == 0, " withdrawal").when(i % 3 == 1, "Receipt").otherwise("?")
    return flat(tables.table(spark, sf_dir, "events").select("event_id", t.clean_amount(printed).alias("amount"), t.direction_of(side).alias("direction")))


@query(f"""with {L2}, i as (select *, coalesce(reference_number, nullif(regexp_extract(narration, '\\b\\d{{9,22}}\\b', 0), '')) as ref, nullif(regexp_extract(upper(narration), '\\b[A-Z]{{4}}0[A-Z0-9]{{6}}\\b', 0), '') as code,
  lower(nullif(regexp_extract(narration, '\\b[\\w.\\-]{{2,}}@[A-Za-z]{{2,}}\\b', 0), '')) as upi from l2)
select event_id, array_to_string(list_filter([case when upi is not null then 'upi:' || upi end, case when code is not null then 'ifsc:' || code end, case when ref is not null then 'ref:' || ref end], lambda x: x is not null), ',') as identifiers,
  upi is not null and upi <> 'shop1@okbank' as conflicting from i""")
def identifiers(spark, sf_dir):
    n, none = F.col("narration"), F.lit(None).cast("string")
    ids = t.identifiers(none, t.upi(n), none, t.ifsc(n), t.reference(n, F.col("reference_number")))
    return flat(tables.narrated_ledger(spark, sf_dir).select("event_id", ids.alias("identifiers"), t.conflicting(ids, F.array(F.lit("upi:shop1@okbank"))).alias("conflicting")))


@query("select event_id, least(1.0, case when event_id % 2 = 0 then 0.5 else 0 end + case when event_id % 3 = 0 then 0.3 else 0 end + case when event_id % 5 = 0 then 0.25 else 0 end + case when event_id % 7 = 0 then 0.15 else 0 end)::double as score from events")
def evidence_scores(spark, sf_dir):
    i, no = F.col("event_id"), F.lit(False)
    return tables.table(spark, sf_dir, "events").select("event_id", t.evidence_score({"account": i % 2 == 0, "upi": i % 3 == 0, "merchant": i % 5 == 0}, no, i % 7 == 0, no, no).alias("score"))


@query(f"with {L2D}, u as (select * from l2d union all select * from l2d), r as (select *, row_number() over (partition by statement_id, event_id, narration order by row_id) as n from u) select event_id, row_id from r where n = 1")
def keep_first_items(spark, sf_dir):
    rows = tables.doubled_ledger(spark, sf_dir)
    items = rows.select("statement_id", F.col("event_id").alias("transaction_id"), F.col("row_id").alias("seq"), F.lit(0).alias("rule_no"), F.lit("x").alias("issue_type"), F.col("narration").alias("reason"), F.lit("LOW").alias("severity"))
    return review.without_repeats(items.unionByName(items)).select(F.col("transaction_id").alias("event_id"), F.col("seq").alias("row_id"))


@query(f"""with {L2}, n as (select *, trim(regexp_replace(upper(narration), '[^A-Z0-9]+', ' ', 'g')) as norm from l2 where event_type <> 'view'), g as (select statement_id, count(*) as transaction_count, count(distinct (norm, direction)) as cluster_count from n group by 1),
p as (select statement_id, count(distinct txn_date) as page_count from l2 group by 1)
select statement_id, page_count, coalesce(transaction_count, 0) as transaction_count, coalesce(cluster_count, 0) as cluster_count from p left join g using (statement_id)""".replace("event_type <> 'view'", "counterparty <> 'view'"))
def manual_summary(spark, sf_dir):
    """Days stand for pages; pages of views alone have no rows."""
    rows = tables.narrated_ledger(spark, sf_dir).withColumns({"normalized_narration": t.normalize_narration(F.col("narration")), "transaction_type": F.col("direction")})
    kept = rows.filter("counterparty <> 'view'")
    return flat(manual.summary(kept, manual.clusters(kept, "event_id", "event_id"), rows, "txn_date"))


@query()
def canonicalize_names(spark, sf_dir):
    return flat(resolve.canonical_names(tables.ledger(spark, sf_dir)))


def _printed(spark, sf_dir) -> DataFrame:
    rows = narrated(spark, sf_dir)
    return rows.withColumns({"balance": F.lit(None).cast("decimal(18,2)"), "opening_balance": F.lit(None).cast("decimal(15,2)"), "extraction_confidence": F.lit(0.9)}).drop("counterparty")


@query()
def resolve_entities(spark, sf_dir):
    rows = _printed(spark, sf_dir)
    found = resolve.resolve_counterparties(classify.normalize(rows, classify.rule_readings(rows)))
    return flat(found)


@query()
def narration_similarity(spark, sf_dir):
    """Neighbouring narrations of a statement and how alike they are."""
    rows = narrated(spark, sf_dir)
    before = F.lag("narration").over(Window.partitionBy("statement_id").orderBy("seq"))
    return rows.withColumn("before", before).filter("before is not null").select("event_id", sequence_ratio(F.upper("before"), F.upper("narration")).alias("ratio"))


import ledgerloom.statement_queries  # noqa: E402, F401  registers more queries
