"""DuckDB SQL for every query that SQL can express, written from the definitions.

Money is summed in integer cents and divided with integer arithmetic, so rounding
is exact; casts bring results to the types Spark returns.
"""

from __future__ import annotations

from workload.bank import PRELUDE


def _money(cents: str, digits: int = 18) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(26,0)) * 0.01 AS DECIMAL({digits},2))"


def _years(on: str, born: str) -> str:
    """Completed years; the last day of a month counts as a full month."""
    month_ends = f"(day({on} + 1) = 1 AND day({born} + 1) = 1)"
    short = f"CASE WHEN day({on}) < day({born}) AND NOT {month_ends} THEN 1 ELSE 0 END"
    months = f"12 * (year({on}) - year({born})) + month({on}) - month({born}) - {short}"
    return f"CAST(floor(({months}) / 12.0) AS BIGINT)"


TODAY = "DATE '2001-08-01'"

SILVER = f"""
silver_customers AS (
  SELECT customer_id, trim(first_name) AS first_name, trim(last_name) AS last_name,
         trim(first_name) || ' ' || trim(last_name) AS full_name,
         lower(trim(email)) AS email,
         nullif(regexp_replace(mobile, '[^0-9]', '', 'g'), '') AS mobile_clean,
         trim(gender) AS gender, date_of_birth, age,
         CASE WHEN age IS NULL OR age >= 65 THEN '65+' WHEN age >= 55 THEN '55-64'
              WHEN age >= 45 THEN '45-54' WHEN age >= 35 THEN '35-44'
              WHEN age >= 25 THEN '25-34' WHEN age >= 18 THEN '18-24' ELSE 'Under 18' END AS age_band,
         signup_date, CAST({TODAY} - signup_date AS INTEGER) AS days_since_signup,
         stamp AS _ingested_at
  FROM (SELECT *, {_years(TODAY, 'date_of_birth')} AS age FROM customers
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY stamp DESC) = 1)),
silver_products AS (
  SELECT customer_id, count(*) AS total_products,
         count(*) FILTER (kind = 'CREDIT CARD') AS credit_card_count,
         count(*) FILTER (kind = 'SAVINGS') AS savings_count,
         {_money("max(limit_cents) FILTER (kind = 'CREDIT CARD')")} AS max_credit_limit,
         {_money("coalesce(sum(limit_cents) FILTER (kind = 'CREDIT CARD'), 0)", 28)} AS total_credit_limit,
         min(enrollment_date) AS first_product_date, max(enrollment_date) AS latest_product_date,
         bool_or(kind = 'CREDIT CARD') AS has_credit_card, bool_or(kind = 'SAVINGS') AS has_savings,
         count(*) >= 2 AS is_multi_product,
         CASE (bool_or(kind = 'CREDIT CARD'), bool_or(kind = 'SAVINGS'))
              WHEN (true, true) THEN 'Savings + Credit Card' WHEN (true, false) THEN 'Credit Card Only'
              WHEN (false, true) THEN 'Savings Only' ELSE 'No Product' END AS product_segment,
         max(stamp) AS _ingested_at
  FROM enrollments GROUP BY customer_id),
silver_interactions AS (
  SELECT customer_id, count(*) AS total_interactions,
         count(*) FILTER (channel = 'EMAIL') AS email_interactions,
         count(*) FILTER (channel = 'CHAT') AS chat_interactions,
         count(*) FILTER (channel = 'CALL') AS call_interactions,
         min(interaction_date) AS first_interaction_date, max(interaction_date) AS last_interaction_date,
         arg_max(channel, (interaction_date, interaction_id)) AS last_interaction_type,
         max(stamp) AS _ingested_at
  FROM (SELECT *, upper(trim(interaction_type)) AS channel FROM interactions) GROUP BY customer_id),
silver_transactions AS (
  SELECT customer_id, count(*) AS total_transactions,
         count(*) FILTER (cents < 0) AS debit_count, count(*) FILTER (cents > 0) AS credit_count,
         {_money("sum(abs(cents))", 28)} AS total_transaction_value,
         {_money("sum(cents)", 28)} AS net_transaction_amount,
         CAST(CAST((2 * 10000 * sum(abs(cents)) + count(*)) // (2 * count(*)) AS DECIMAL(20,0))
              * 0.000001 AS DECIMAL(22,6)) AS avg_transaction_value,
         {_money("coalesce(sum(-cents) FILTER (cents < 0), 0)", 28)} AS total_debit_value,
         {_money("coalesce(sum(cents) FILTER (cents > 0), 0)", 28)} AS total_credit_value,
         {_money("max(balance_cents)")} AS max_balance, {_money("min(balance_cents)")} AS min_balance,
         CAST(min(transaction_date) AS DATE) AS first_transaction_date,
         CAST(max(transaction_date) AS DATE) AS last_transaction_date,
         {_money("arg_max(balance_cents, (transaction_date, transaction_id))")} AS current_balance,
         {_money("coalesce(sum(abs(cents)) FILTER (kind = 'CREDIT CARD'), 0)", 28)} AS credit_card_transaction_value,
         {_money("coalesce(sum(abs(cents)) FILTER (kind = 'SAVINGS'), 0)", 28)} AS savings_transaction_value,
         {_money("coalesce(sum(cents) FILTER (kind = 'CREDIT CARD'), 0)", 28)} AS credit_card_net_transaction_amount,
         {_money("coalesce(sum(cents) FILTER (kind = 'SAVINGS'), 0)", 28)} AS savings_net_transaction_amount,
         count(*) FILTER (kind = 'CREDIT CARD') AS credit_card_transaction_count,
         count(*) FILTER (kind = 'SAVINGS') AS savings_transaction_count,
         max(stamp) AS _ingested_at
  FROM (SELECT t.*, e.kind FROM transactions t LEFT JOIN enrollments e USING (product_id))
  GROUP BY customer_id)"""

_COUNTS = {
    "p": ["total_products", "credit_card_count", "savings_count"],
    "i": ["total_interactions", "email_interactions", "chat_interactions", "call_interactions"],
    "t": [
        "total_transactions",
        "debit_count",
        "credit_count",
        "credit_card_transaction_count",
        "savings_transaction_count",
    ],
}
_VALUES = [
    "total_transaction_value",
    "net_transaction_amount",
    "total_debit_value",
    "total_credit_value",
    "credit_card_transaction_value",
    "savings_transaction_value",
    "credit_card_net_transaction_amount",
    "savings_net_transaction_amount",
]
_AS_IS = {
    "p": ["max_credit_limit", "total_credit_limit", "first_product_date", "latest_product_date"],
    "i": ["first_interaction_date", "last_interaction_date", "last_interaction_type"],
    "t": [
        "max_balance",
        "min_balance",
        "current_balance",
        "first_transaction_date",
        "last_transaction_date",
    ],
}
_JOINED = ",\n         ".join(
    [f"coalesce({side}.{c}, 0) AS {c}" for side, cols in _COUNTS.items() for c in cols]
    + [f"coalesce(t.{c}, CAST(0 AS DECIMAL(28,2))) AS {c}" for c in _VALUES]
    + ["coalesce(t.avg_transaction_value, CAST(0 AS DECIMAL(22,6))) AS avg_transaction_value"]
    + [f"{side}.{c}" for side, cols in _AS_IS.items() for c in cols]
    + [f"coalesce(p.{c}, false) AS {c}" for c in ("has_credit_card", "has_savings", "is_multi_product")]
    + ["coalesce(p.product_segment, 'No Product') AS product_segment"]
    + [
        f"coalesce({side}._ingested_at, TIMESTAMP '1970-01-01') AS _{name}_ingested_at"
        for side, name in (("p", "products"), ("i", "interactions"), ("t", "transactions"))
    ]
)

def gold_layer(
    active: int = 90,
    risk: int = 180,
    high: int = 150000,
    medium: int = 50000,
    premium: int = 100000,
    engaged: tuple[int, int] = (10, 3),
    tenure: tuple[int, int, int] = (90, 365, 1095),
) -> str:
    return f"""
joined AS (
  SELECT c.* EXCLUDE (_ingested_at), c._ingested_at AS _customer_ingested_at,
         {_JOINED},
         CASE WHEN t.last_transaction_date >= i.last_interaction_date OR i.last_interaction_date IS NULL
              THEN t.last_transaction_date ELSE i.last_interaction_date END AS last_activity_date
  FROM silver_customers c
  LEFT JOIN silver_products p USING (customer_id)
  LEFT JOIN silver_interactions i USING (customer_id)
  LEFT JOIN silver_transactions t USING (customer_id)),
dated AS (
  SELECT *, CAST({TODAY} - last_transaction_date AS INTEGER) AS days_since_last_transaction,
         CAST({TODAY} - last_interaction_date AS INTEGER) AS days_since_last_interaction,
         CAST({TODAY} - last_activity_date AS INTEGER) AS days_since_last_activity
  FROM joined),
profile AS (
  SELECT *,
         days_since_last_activity IS NOT NULL AND days_since_last_activity <= {active} AS is_active_customer,
         CASE WHEN last_activity_date IS NULL THEN 'Never Active'
              WHEN days_since_last_activity > {risk} THEN 'Dormant'
              WHEN days_since_last_activity > {active} THEN 'At Risk' ELSE 'Active' END AS customer_status,
         CASE WHEN total_transaction_value <= 0 THEN 'No Transaction'
              WHEN total_transaction_value < {medium} THEN 'Low Value'
              WHEN total_transaction_value < {high} THEN 'Medium Value' ELSE 'High Value' END AS customer_value_segment,
         CASE WHEN has_credit_card AND total_transaction_value > {premium} - 0.001 THEN 'Premium'
              WHEN total_products > 1 THEN 'Standard' ELSE 'Basic' END AS customer_segment,
         CASE WHEN total_interactions = 0 THEN 'No CRM Engagement'
              WHEN total_interactions < {engaged[1]} THEN 'Low Engagement'
              WHEN total_interactions < {engaged[0]} THEN 'Moderately Engaged' ELSE 'Highly Engaged' END AS engagement_segment,
         CASE WHEN max_credit_limit > 0 THEN
           CAST(CAST((2 * CAST(credit_card_transaction_value * 100 AS HUGEINT) * 10000000000
                      + CAST(max_credit_limit * 100 AS HUGEINT))
                     // (2 * CAST(max_credit_limit * 100 AS HUGEINT)) AS DECIMAL(27,0))
                * 0.0000000001 AS DECIMAL(38,10)) END AS credit_card_activity_to_limit_ratio,
         CASE WHEN days_since_signup >= {tenure[2]} OR days_since_signup IS NULL THEN 'Mature'
              WHEN days_since_signup >= {tenure[1]} THEN 'Established'
              WHEN days_since_signup >= {tenure[0]} THEN 'Growing' ELSE 'New' END AS customer_lifecycle_stage,
         greatest(_customer_ingested_at, _products_ingested_at, _interactions_ingested_at,
                  _transactions_ingested_at) AS _latest_source_ingested_at
  FROM dated)"""


GOLD = gold_layer()


def _sql(body: str, *layers: str) -> str:
    return "WITH " + ",".join([PRELUDE, *layers]).lstrip() + "\n" + body


def _mean(cents: str, n: str = "count(*)") -> str:
    """Average of integer cents as decimal(22,6), ties away from zero."""
    total = f"sum({cents})"
    micro = f"sign({total}) * ((20000 * abs({total}) + {n}) // (2 * {n}))"
    return f"CAST(CAST({micro} AS DECIMAL(20,0)) * 0.000001 AS DECIMAL(22,6))"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


BRONZE_TABLES = {
    "customer_raw": "customers",
    "product_enrollments": "enrollments",
    "crm_interactions": "interactions",
    "transaction_history": "transactions",
}
BUILT_TABLES = {
    "silver_customers": "silver_customers",
    "silver_customer_products": "silver_products",
    "silver_customer_interactions": "silver_interactions",
    "silver_customer_transactions": "silver_transactions",
    "customer_profile": "profile",
}
_SQL_NAME = BRONZE_TABLES | BUILT_TABLES
_RENAMED = {
    "_ingested_at": "stamp",
    "limit": "limit_cents",
    "transaction_amount": "cents",
    "closing_balance": "balance_cents",
}


def _rule_count(kind: str, table: str, column: str, detail: str) -> str:
    """Failures of one column rule; `detail` is the list of values or the parent table."""
    source = _SQL_NAME[table]
    if column == "_gold_updated_at":
        return "0"
    renamed = _RENAMED.get(column, column) if table in BRONZE_TABLES else column
    if kind == "not_null":
        return f"(SELECT count(*) - count({renamed}) FROM {source})"
    if kind == "accepted_values":
        return f"(SELECT count(*) FROM {source} WHERE {renamed} NOT IN ({detail}))"
    if kind == "unique":
        inner = f"SELECT {renamed} FROM {source} WHERE {renamed} IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
        return f"(SELECT count(*) FROM ({inner}))"
    known = f"EXISTS (FROM {_SQL_NAME[detail]} p WHERE p.{renamed} = c.{renamed})"
    return f"(SELECT count(*) FROM {source} c WHERE {renamed} IS NOT NULL AND NOT {known})"


# The declared rules, one line per table and kind. `accepted_values` and
# `relationships` name the column, then the values or the parent table.
_DECLARED = """
customer_raw unique customer_id
customer_raw not_null customer_id first_name last_name email mobile gender date_of_birth signup_date _ingested_at
customer_raw accepted_values gender: 'Male', 'Female'
product_enrollments unique product_id
product_enrollments not_null product_id customer_id product_type enrollment_date _ingested_at
product_enrollments relationships customer_id: customer_raw
product_enrollments accepted_values product_type: 'Savings', 'Credit Card'
crm_interactions unique interaction_id
crm_interactions not_null interaction_id customer_id interaction_type interaction_date _ingested_at
crm_interactions relationships customer_id: customer_raw
crm_interactions accepted_values interaction_type: 'Email', 'Chat', 'Call'
transaction_history unique transaction_id
transaction_history not_null transaction_id customer_id product_id transaction_amount closing_balance transaction_date _ingested_at
transaction_history relationships customer_id: customer_raw
transaction_history relationships product_id: product_enrollments
silver_customers unique customer_id
silver_customers not_null customer_id email mobile_clean first_name last_name full_name gender date_of_birth signup_date age age_band days_since_signup _ingested_at
silver_customers accepted_values gender: 'Male', 'Female'
silver_customers accepted_values age_band: '18-24', '25-34', '35-44', '45-54', '55-64', '65+'
silver_customer_products unique customer_id
silver_customer_products not_null customer_id total_products credit_card_count savings_count total_credit_limit has_credit_card has_savings is_multi_product product_segment first_product_date latest_product_date _ingested_at
silver_customer_products relationships customer_id: silver_customers
silver_customer_products accepted_values product_segment: 'Savings + Credit Card', 'Credit Card Only', 'Savings Only', 'No Product'
silver_customer_interactions unique customer_id
silver_customer_interactions not_null customer_id total_interactions email_interactions chat_interactions call_interactions first_interaction_date last_interaction_date last_interaction_type _ingested_at
silver_customer_interactions relationships customer_id: silver_customers
silver_customer_interactions accepted_values last_interaction_type: 'EMAIL', 'CHAT', 'CALL'
silver_customer_transactions unique customer_id
silver_customer_transactions not_null customer_id total_transactions debit_count credit_count total_transaction_value net_transaction_amount avg_transaction_value total_debit_value total_credit_value first_transaction_date last_transaction_date max_balance min_balance current_balance credit_card_transaction_value savings_transaction_value credit_card_net_transaction_amount savings_net_transaction_amount credit_card_transaction_count savings_transaction_count _ingested_at
silver_customer_transactions relationships customer_id: silver_customers
customer_profile unique customer_id
customer_profile not_null customer_id first_name last_name full_name email mobile_clean gender date_of_birth age age_band signup_date days_since_signup total_products credit_card_count savings_count total_credit_limit product_segment has_credit_card has_savings is_multi_product total_interactions email_interactions chat_interactions call_interactions
customer_profile not_null total_transactions debit_count credit_count total_transaction_value net_transaction_amount avg_transaction_value total_debit_value total_credit_value credit_card_transaction_value savings_transaction_value credit_card_net_transaction_amount savings_net_transaction_amount credit_card_transaction_count savings_transaction_count
customer_profile not_null is_active_customer customer_status customer_value_segment customer_segment engagement_segment customer_lifecycle_stage _customer_ingested_at _products_ingested_at _interactions_ingested_at _transactions_ingested_at _latest_source_ingested_at _gold_updated_at
customer_profile relationships customer_id: silver_customers
customer_profile accepted_values gender: 'Male', 'Female', 'Other', 'Unknown', 'Prefer not to say'
customer_profile accepted_values age_band: 'Under 18', '18-24', '25-34', '35-44', '45-54', '55-64', '65+'
customer_profile accepted_values product_segment: 'Savings + Credit Card', 'Credit Card Only', 'Savings Only', 'No Product'
customer_profile accepted_values last_interaction_type: 'EMAIL', 'CHAT', 'CALL'
customer_profile accepted_values customer_status: 'Never Active', 'Active', 'At Risk', 'Dormant'
customer_profile accepted_values customer_value_segment: 'High Value', 'Medium Value', 'Low Value', 'No Transaction'
customer_profile accepted_values customer_segment: 'Premium', 'Standard', 'Basic'
customer_profile accepted_values engagement_segment: 'Highly Engaged', 'Moderately Engaged', 'Low Engagement', 'No CRM Engagement'
customer_profile accepted_values customer_lifecycle_stage: 'New', 'Growing', 'Established', 'Mature'
"""


def _declared() -> list[tuple[str, str, str, str]]:
    """(kind, table, column, detail) of every column rule that stops a run."""
    out = []
    for line in _DECLARED.strip().splitlines():
        table, kind, rest = line.split(" ", 2)
        column, _, detail = rest.partition(": ")
        out += [(kind, table, column, detail)] if detail else [(kind, table, c, "") for c in rest.split()]
    return out


_ASSERTION_COUNTS = {
    "assert_product_owner_match": """(SELECT count(*) FROM transactions t LEFT JOIN enrollments e
        ON t.product_id = e.product_id WHERE e.product_id IS NULL OR e.customer_id <> t.customer_id)""",
    "assert_value_identity": """(SELECT count(*) FROM silver_transactions
        WHERE total_debit_value + total_credit_value - total_transaction_value NOT BETWEEN -0.004 AND 0.004)""",
    "assert_non_negative": """(SELECT count(*) FROM profile
        WHERE least(age, days_since_signup, days_since_last_activity, total_products, credit_card_count,
                    savings_count, total_interactions, email_interactions, chat_interactions,
                    call_interactions, total_transactions, debit_count, credit_count,
                    total_transaction_value, total_debit_value, total_credit_value,
                    credit_card_transaction_value, savings_transaction_value,
                    credit_card_transaction_count, savings_transaction_count) < 0)""",
    "assert_recency_consistent": """(SELECT count(*) FROM profile
        WHERE (customer_status = 'Active') <> is_active_customer
           OR (is_active_customer AND coalesce(days_since_last_activity, 91) > 90)
           OR (customer_status = 'Never Active' AND last_activity_date IS NOT NULL))""",
    "assert_premium": """(SELECT count(*) FROM profile WHERE customer_segment = 'Premium'
        AND NOT (has_credit_card AND total_transaction_value >= 100000))""",
}


_ASSERTED = {
    "assert_product_owner_match": "transaction_history",
    "assert_value_identity": "silver_customer_transactions",
    "assert_non_negative": "customer_profile",
    "assert_recency_consistent": "customer_profile",
    "assert_premium": "customer_profile",
}


def _rule_summary() -> str:
    """Failures of every column rule and assertion."""
    email = ("unique", "silver_customers", "email", "")
    rows = [
        (f"{kind}_{table}_{column}", table, severity, _rule_count(kind, table, column, detail))
        for severity, declared in (("error", _declared()), ("warn", [email]))
        for kind, table, column, detail in declared
    ]
    rows += [(name, _ASSERTED[name], "error", count) for name, count in _ASSERTION_COUNTS.items()]
    counted = _union(
        [
            f"SELECT '{i}' AS rule_id, '{t}' AS table_name, '{s}' AS severity, CAST({n} AS BIGINT) AS failures"
            for i, t, s, n in rows
        ]
    )
    return _sql(
        f"SELECT *, CASE WHEN failures > 0 THEN severity ELSE 'pass' END AS status FROM ({counted})",
        SILVER,
        GOLD,
    )


_GOLD_DERIVED = [
    "_customer_ingested_at",
    "_products_ingested_at",
    "_interactions_ingested_at",
    "_transactions_ingested_at",
    "last_activity_date",
    "days_since_last_transaction",
    "days_since_last_interaction",
    "days_since_last_activity",
    "is_active_customer",
    "customer_status",
    "customer_value_segment",
    "customer_segment",
    "engagement_segment",
    "credit_card_activity_to_limit_ratio",
    "customer_lifecycle_stage",
    "_latest_source_ingested_at",
    "_gold_updated_at",
]
_CUSTOMER_COLUMNS = (
    "customer_id first_name last_name full_name email mobile_clean gender date_of_birth age "
    "age_band signup_date days_since_signup"
).split()
_PRODUCT_COLUMNS = [
    *_COUNTS["p"],
    *_AS_IS["p"],
    "has_credit_card",
    "has_savings",
    "is_multi_product",
    "product_segment",
]
_INTERACTION_COLUMNS = [*_COUNTS["i"], *_AS_IS["i"]]
_TRANSACTION_COLUMNS = [*_COUNTS["t"], *_VALUES, "avg_transaction_value", *_AS_IS["t"]]
COLUMNS = {
    "silver_customers": [*_CUSTOMER_COLUMNS, "_ingested_at"],
    "silver_customer_products": ["customer_id", *_PRODUCT_COLUMNS, "_ingested_at"],
    "silver_customer_interactions": ["customer_id", *_INTERACTION_COLUMNS, "_ingested_at"],
    "silver_customer_transactions": ["customer_id", *_TRANSACTION_COLUMNS, "_ingested_at"],
    "customer_profile": [
        *_CUSTOMER_COLUMNS,
        *_PRODUCT_COLUMNS,
        *_INTERACTION_COLUMNS,
        *_TRANSACTION_COLUMNS,
        *_GOLD_DERIVED,
    ],
}

_CUSTOMER_RAW = (
    "customer_id, first_name, last_name, email, mobile, gender, date_of_birth, signup_date"
)
_RAW_INTERACTIONS = (
    "SELECT interaction_id, customer_id, interaction_type, interaction_date, "
    "stamp AS _ingested_at FROM interactions"
)
_RAW_TRANSACTIONS = (
    f"SELECT transaction_id, product_id, customer_id, {_money('cents')} AS transaction_amount, "
    f"{_money('balance_cents')} AS closing_balance, transaction_date, stamp AS _ingested_at "
    "FROM transactions"
)
_MISOWNED = """misowned AS (
  SELECT transaction_id, product_id + CASE WHEN transaction_id % 70 = 0 THEN 7 ELSE 0 END AS product_id,
         customer_id + CASE WHEN transaction_id % 50 = 0 THEN 1 ELSE 0 END AS customer_id
  FROM transactions),
mismatched AS (
  SELECT m.transaction_id, m.customer_id AS transaction_customer_id, m.product_id,
         e.customer_id AS product_customer_id
  FROM misowned m LEFT JOIN enrollments e USING (product_id)
  WHERE e.customer_id IS NULL OR m.customer_id <> e.customer_id)"""


def _share(column: str, source: str) -> str:
    return (
        f"SELECT {column}, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM {source}), 1) AS pct "
        f"FROM {source} GROUP BY {column}"
    )


def _spread(name: str, source: str, column: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, '{column}' AS column_name, count(*) AS n_rows, "
        f"count(DISTINCT {column}) AS n_values, count(*) - count(DISTINCT {column}) AS n_duplicates FROM {source}"
    )


def _blank_rows() -> str:
    changed = {
        "customer_raw": "(SELECT * REPLACE (CASE WHEN customer_id % 17 = 0 THEN '' "
        "WHEN customer_id % 19 = 0 THEN NULL ELSE email END AS email) FROM customers)",
        "product_enrollments": "(SELECT * REPLACE (CASE WHEN customer_id % 23 <> 0 THEN limit_cents END "
        "AS limit_cents) FROM enrollments)",
    }
    columns = {
        "customer_raw": _CUSTOMER_RAW.split(", "),
        "product_enrollments": "product_id customer_id product_type enrollment_date limit".split(),
        "crm_interactions": "interaction_id customer_id interaction_type interaction_date".split(),
        "transaction_history": (
            "transaction_id product_id customer_id transaction_amount closing_balance transaction_date"
        ).split(),
    }
    return _union(
        [
            f"SELECT '{name}' AS table_name, '{c}' AS column_name, "
            f"count(*) FILTER (coalesce(CAST({_RENAMED.get(c, c)} AS VARCHAR), '') = '') AS n_blank "
            f"FROM {changed.get(name, source)}"
            for name, source in BRONZE_TABLES.items()
            for c in [*columns[name], "_ingested_at"]
        ]
    )


def _range(name: str, source: str, column: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, '{column}' AS column_name, CAST(min({column}) AS TIMESTAMP) AS earliest, "
        f"CAST(max({column}) AS TIMESTAMP) AS latest FROM {source}"
    )


def _orphan(label: str, child: str, key: str, parent: str) -> str:
    return (
        f"SELECT '{label}' AS reference, CAST(count(*) AS BIGINT) AS n_orphans FROM {child} "
        f"WHERE {key} NOT IN (SELECT {key} FROM {parent})"
    )


def _lacking(name: str, *sources: str) -> str:
    absent = " AND ".join(f"customer_id NOT IN (SELECT customer_id FROM {s})" for s in sources)
    return (
        f"SELECT '{name}' AS missing, count(*) FILTER ({absent}) AS n_customers, "
        f"round(100.0::DOUBLE * count(*) FILTER ({absent}) / count(*), 1) AS pct FROM customers"
    )


def _nearest_rank(percents: list[int]) -> str:
    wanted = _union(
        [f"SELECT 'p{p}' AS percentile, greatest((n * {p} + 99) // 100, 1) AS r FROM total" for p in percents]
    )
    return (
        f"SELECT percentile, {_money('cents')} AS value FROM ({wanted}) JOIN ranked USING (r)"
    )


_RANKED = """total AS (SELECT count(*) AS n FROM transactions),
ranked AS (SELECT cents, row_number() OVER (ORDER BY cents) AS r FROM transactions)"""

_FIRST_LOAD_INTERACTIONS = PRELUDE.replace("  FROM events)", "  FROM events WHERE event_id % 5 <> 0)")


def _stddev(cents: str) -> str:
    return f"stddev_samp(CAST({cents} AS DOUBLE) / 100)"


ORACLES: dict[str, str] = {
    "silver_customers": _sql("SELECT * FROM silver_customers", SILVER),
    "silver_products": _sql("SELECT * FROM silver_products", SILVER),
    "silver_interactions": _sql("SELECT * FROM silver_interactions", SILVER),
    "silver_transactions": _sql("SELECT * FROM silver_transactions", SILVER),
    "gold_profile": _sql("SELECT * FROM profile", SILVER, GOLD),
    "gold_custom_thresholds": _sql(
        "SELECT customer_id, is_active_customer, customer_status, customer_value_segment, "
        "customer_segment, engagement_segment, customer_lifecycle_stage FROM profile",
        SILVER,
        gold_layer(30, 60, 90000, 30000, 60000, (7, 5), (200, 500, 900)),
    ),
    "gold_status_summary": _sql(
        "SELECT customer_status, customer_segment, count(*) AS customers FROM profile GROUP BY ALL",
        SILVER,
        GOLD,
    ),
    "gold_segment_only": _sql(
        "SELECT customer_id, customer_segment, total_transaction_value FROM profile", SILVER, GOLD
    ),
    "deidentified_view": _sql(
        "SELECT customer_id, sha256(email) AS email, sha256(mobile_clean) AS mobile_clean, gender, age, "
        "age_band, signup_date, days_since_signup, _ingested_at FROM silver_customers",
        SILVER,
    ),
    "dedup_latest": """
        SELECT * FROM lineitem
        QUALIFY row_number() OVER (
          PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
                   l_tax, l_returnflag, l_linestatus) = 1""",
    "transactions_with_product_type": _sql(
        "SELECT transaction_id, product_id, kind FROM transactions LEFT JOIN enrollments USING (product_id)"
    ),
    "watermark": _sql(
        "SELECT max(stamp) AS high_water FROM transactions WHERE stamp < TIMESTAMP '2001-08-01'"
    ),
    "changed_keys": _sql(
        "SELECT DISTINCT customer_id FROM transactions WHERE transaction_id % 5 = 0"
    ),
    "history_of_changed": _sql(
        "SELECT transaction_id, customer_id FROM transactions WHERE customer_id IN "
        "(SELECT customer_id FROM transactions WHERE transaction_id % 5 = 0)"
    ),
    "incremental_transactions": _sql("SELECT * FROM silver_transactions", SILVER),
    "incremental_interactions": _sql("SELECT * FROM silver_interactions", SILVER),
    "backfill_interactions": _sql("SELECT * FROM silver_interactions", SILVER),
    "backfill_empty_window": (
        "WITH " + ",".join([_FIRST_LOAD_INTERACTIONS, SILVER]).lstrip() + "\nSELECT * FROM silver_interactions"
    ),
    "rule_summary": _rule_summary(),
    "rule_not_null": _sql(
        "SELECT * FROM silver_customers WHERE customer_id % 97 = 5 AND customer_id % 10 <> 0", SILVER
    ),
    "rule_unique": _sql(
        "SELECT lower(email) AS email, count(*) AS n FROM customers GROUP BY 1 HAVING count(*) > 1"
    ),
    "rule_accepted_values": _sql(
        "SELECT interaction_id, interaction_type FROM interactions "
        "WHERE interaction_type NOT IN ('Email', 'Chat', 'Call')"
    ),
    "rule_relationships": _sql(
        "SELECT transaction_id, product_id FROM transactions WHERE product_id % 10 > 2"
    ),
    "assert_product_owner_match": _sql("SELECT * FROM mismatched", _MISOWNED),
    "assert_product_owner_count": _sql("SELECT count(*) AS failures FROM mismatched", _MISOWNED),
    "assert_value_identity": _sql(
        "SELECT customer_id, CAST(total_transaction_value + 0.01 AS DECIMAL(28,2)) AS total_transaction_value, "
        "total_debit_value, total_credit_value FROM silver_transactions WHERE customer_id % 40 = 0",
        SILVER,
    ),
    "assert_recency_consistent": _sql(
        """
        SELECT customer_id, last_activity_date, days_since_last_activity,
               CASE WHEN customer_id % 30 = 0 THEN NOT is_active_customer ELSE is_active_customer END AS is_active_customer,
               CASE WHEN customer_id % 30 = 1 THEN 'Never Active' ELSE customer_status END AS customer_status
        FROM profile
        WHERE customer_id % 30 = 0 OR (customer_id % 30 = 1 AND last_activity_date IS NOT NULL)""",
        SILVER,
        GOLD,
    ),
    "assert_premium": _sql(
        "SELECT customer_id, 'Premium' AS customer_segment, has_credit_card, total_transaction_value "
        "FROM profile WHERE customer_id % 25 = 0 AND customer_segment <> 'Premium'",
        SILVER,
        GOLD,
    ),
    "assert_non_negative": _sql(
        """
        SELECT customer_id, age, days_since_signup,
               CASE WHEN customer_id % 33 = 0 THEN -1 ELSE total_products END AS total_products,
               total_interactions, total_transactions, credit_card_count, savings_count, email_interactions,
               chat_interactions, call_interactions, debit_count, credit_count, total_transaction_value,
               total_debit_value,
               CASE WHEN customer_id % 34 = 0 THEN -total_credit_value ELSE total_credit_value END AS total_credit_value,
               credit_card_transaction_value, savings_transaction_value, credit_card_transaction_count,
               savings_transaction_count, days_since_last_activity
        FROM profile
        WHERE customer_id % 33 = 0 OR (customer_id % 34 = 0 AND total_credit_value > 0)""",
        SILVER,
        GOLD,
    ),
    "freshness_status": _sql(
        """
        SELECT 'transactions' AS table_name, max(stamp) AS newest, CAST(36 * 3600 AS BIGINT) AS age_seconds,
               'warn' AS status FROM transactions
        UNION ALL
        SELECT 'first_load', max(stamp), CAST(60 * 3600 AS BIGINT), 'error' FROM transactions
        WHERE transaction_id % 5 <> 0"""
    ),
    "build_freshness": _sql(
        "SELECT 'customer_profile' AS table_name, max(TIMESTAMP '2001-08-01') AS newest, "
        "CAST(91 * 60 AS BIGINT) AS age_seconds, 'error' AS status FROM profile",
        SILVER,
        GOLD,
    ),
    "profile_counts": _sql(
        _union(
            [f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {s}" for n, s in BRONZE_TABLES.items()]
        )
    ),
    "profile_nulls": _sql(_blank_rows()),
    "profile_duplicates": _sql(
        _union(
            [
                _spread("customer_raw", "customers", "customer_id"),
                _spread("customer_raw", "customers", "email"),
                _spread("product_enrollments", "enrollments", "product_id"),
                _spread("crm_interactions", "interactions", "interaction_id"),
                _spread("transaction_history", "transactions", "transaction_id"),
                _spread("transaction_history", "transactions", "product_id"),
            ]
        )
    ),
    "profile_top_duplicates": _sql(
        "SELECT email, count(*) AS n FROM customers GROUP BY email HAVING count(*) > 1 "
        "ORDER BY n DESC, email LIMIT 10"
    ),
    "profile_ages": _sql(
        "SELECT min(age) AS min_age, max(age) AS max_age, avg(age) AS avg_age, "
        "count(*) FILTER (age < 18) AS under_18, count(*) FILTER (age > 100) AS over_100 FROM silver_customers",
        SILVER,
    ),
    "profile_phone_formats": _sql(
        "SELECT CASE WHEN mobile[1:2] = '09' THEN '09...' WHEN mobile[1:3] = '+63' THEN '+63...' "
        "ELSE 'other' END AS phone_format, count(*) AS n FROM customers GROUP BY 1"
    ),
    "profile_odd_phones": _sql(
        "SELECT customer_id, mobile FROM customers WHERE mobile = '--' ORDER BY customer_id LIMIT 20"
    ),
    "profile_gender": _sql(_share("gender", "customers")),
    "profile_product_types": _sql(_share("product_type", "enrollments")),
    "profile_distribution": _sql(_share("interaction_type", "interactions")),
    "profile_label_hygiene": _sql(
        "SELECT product_type, kind AS product_type_clean, count(*) AS n FROM enrollments GROUP BY ALL"
    ),
    "profile_limits": _sql(
        f"SELECT {_money('min(limit_cents)')} AS min_limit, {_money('max(limit_cents)')} AS max_limit, "
        f"{_mean('limit_cents')} AS avg_limit, count(*) FILTER (limit_cents < 0) AS negative_limits, "
        "count(*) FILTER (kind = 'SAVINGS' AND limit_cents <> 0) AS savings_with_nonzero_limit FROM enrollments"
    ),
    "profile_orphans": _sql(
        _union(
            [
                _orphan("enrollment to customer", "enrollments", "customer_id", "customers"),
                _orphan("interaction to customer", "interactions", "customer_id", "customers"),
                _orphan("transaction to product", "transactions", "product_id", "enrollments"),
                _orphan("transaction to customer", "transactions", "customer_id", "customers"),
                _orphan(
                    "transaction to even customer",
                    "transactions",
                    "customer_id",
                    "(SELECT * FROM customers WHERE customer_id % 2 = 0)",
                ),
            ]
        )
    ),
    "profile_products_per_customer": _sql(
        "SELECT min(n) AS min_products, max(n) AS max_products, avg(n) AS avg_products "
        "FROM (SELECT count(*) AS n FROM enrollments GROUP BY customer_id)"
    ),
    "profile_products_histogram": _sql(
        "SELECT n AS products_per_customer, count(*) AS num_customers "
        "FROM (SELECT count(*) AS n FROM enrollments GROUP BY customer_id) GROUP BY n"
    ),
    "profile_date_ranges": _sql(
        _union(
            [
                _range("customer_raw", "customers", "signup_date"),
                _range("crm_interactions", "interactions", "interaction_date"),
                _range("transaction_history", "transactions", "transaction_date"),
            ]
        )
    ),
    "profile_amount_stats": _sql(
        f"SELECT {_money('min(cents)')} AS min_amount, {_money('max(cents)')} AS max_amount, "
        f"{_mean('cents')} AS mean_amount, round({_stddev('cents')}, 3) AS stddev_amount FROM transactions"
    ),
    "profile_amount_percentiles": _sql(_nearest_rank([1, 25, 50, 75, 99]), _RANKED),
    "profile_outliers": _sql(
        """
        SELECT count(*) FILTER (abs(cents / 100 - mean) > 3 * sd) AS n_outliers
        FROM (SELECT cents, avg(cents / 100) OVER () AS mean, stddev_samp(cents / 100) OVER () AS sd
              FROM (SELECT CAST(cents AS DOUBLE) * CASE WHEN transaction_id % 211 = 0 THEN 9 ELSE 1 END AS cents
                    FROM transactions))"""
    ),
    "profile_balances": _sql(
        "SELECT count(*) FILTER (balance_cents < 0) AS n_negative, "
        "round(100.0::DOUBLE * count(*) FILTER (balance_cents < 0) / count(*), 1) AS pct_negative, "
        f"{_money('min(balance_cents)')} AS min_balance, {_money('max(balance_cents)')} AS max_balance, "
        f"{_mean('balance_cents')} AS avg_balance FROM transactions"
    ),
    "profile_naive_timestamps": _sql(
        "SELECT count(*) FILTER (transaction_id % 60 = 0 OR transaction_id % 77 = 0) AS n_zone_aware, "
        "count(*) AS n_rows FROM transactions"
    ),
    "profile_coverage": _sql(
        _union(
            [
                _lacking("products", "enrollments"),
                _lacking("crm", "interactions"),
                _lacking("transactions", "transactions"),
                _lacking("crm_and_transactions", "interactions", "transactions"),
            ]
        )
    ),
    "monitor_durations": """
        SELECT event_id AS job_id, 'mart_' || event_type AS job_name, ts AS start_time,
               CASE WHEN event_id % 100 <> 0 THEN ts + to_seconds(floor(value * 60)::BIGINT) END AS end_time,
               CASE WHEN event_id % 100 <> 0 THEN floor(value * 60)::BIGINT // 60 END AS duration_minutes,
               CASE WHEN event_type = 'click' THEN 'SUCCESS' ELSE 'FAILED' END AS state,
               event_id % 100 <> 0 AND floor(value * 60)::BIGINT // 60 > 60 AS is_long
        FROM events
        WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-18'""",
    "monitor_row_counts": _sql(
        "SELECT *, TIMESTAMP '2001-08-01' AS check_time, row_count < 1200 AS is_low FROM ("
        + _union([f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {s}" for n, s in BUILT_TABLES.items()])
        + ")",
        SILVER,
        GOLD,
    ),
    "monitor_row_drop": _sql(
        "SELECT table_name, row_count, CAST(row_count * CASE table_name WHEN 'crm_interactions' THEN 120 "
        "ELSE 105 END // 100 AS BIGINT) AS previous_count, table_name = 'crm_interactions' AS dropped FROM ("
        + _union([f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {s}" for n, s in BRONZE_TABLES.items()])
        + ")"
    ),
    "delimited_round_trip": _sql(
        f"SELECT {_CUSTOMER_RAW}, TIMESTAMP '2001-08-01' AS _ingested_at FROM customers"
    ),
    "bronze_views": _sql(_RAW_INTERACTIONS),
    "compacted_table": _sql(_RAW_INTERACTIONS),
    "clustered_table": _sql(_RAW_TRANSACTIONS),
    "clustered_by_two": _sql(_RAW_TRANSACTIONS),
    "audit_rows": _sql(
        "SELECT customer_id, age, age_band FROM silver_customers WHERE age < 18", SILVER
    ),
    "pipeline_refresh": _sql("SELECT * FROM profile", SILVER, GOLD),
    "pipeline_backfill": _sql("SELECT * FROM profile", SILVER, GOLD),
    "stream_refresh": _sql("SELECT * FROM silver_interactions", SILVER),
    "delimited_rejects": _sql(
        """
        SELECT customer_id,
               CASE WHEN customer_id % 50 <> 7 AND customer_id % 40 <> 3 THEN date_of_birth END AS date_of_birth,
               CASE WHEN customer_id % 40 = 3 THEN 'columns' WHEN customer_id % 50 = 7 THEN 'date_of_birth' ELSE '' END AS reasons,
               CASE WHEN customer_id % 40 = 3 THEN concat_ws('|', customer_id, first_name, last_name, email, mobile)
                    WHEN customer_id % 50 = 7
                    THEN concat_ws('|', customer_id, first_name, last_name, email, mobile, gender, 'unknown', signup_date) END AS line
        FROM customers"""
    ),
    "delivered_zone": _sql(
        "SELECT unnest(['n_zone_aware', 'n_rows']) AS metric, "
        "unnest([count(*) FILTER (transaction_id % 60 = 0 OR transaction_id % 77 = 0), count(*)]) AS value FROM transactions"
    ),
    "key_repeats": _sql(
        """
        SELECT key, n_rows, n_before FROM (
          SELECT transaction_id AS key,
                 CASE WHEN stamp = TIMESTAMP '2001-08-01' THEN 1 + (transaction_id % 55 = 0)::INTEGER ELSE 1 END::BIGINT AS n_rows,
                 CASE WHEN stamp = TIMESTAMP '2001-08-01' THEN 0 ELSE 1 END::BIGINT AS n_before
          FROM transactions WHERE stamp = TIMESTAMP '2001-08-01' OR transaction_id % 51 = 3)
        WHERE n_rows > 1 OR n_before > 0"""
    ),
    "key_unknown": _sql(
        "SELECT product_id AS key, count(*) AS n_rows FROM transactions WHERE stamp = TIMESTAMP '2001-08-01' AND product_id NOT IN "
        "(SELECT product_id FROM enrollments WHERE stamp = TIMESTAMP '2001-07-31') GROUP BY 1"
    ),
    "owner_gate_delta": _sql(
        """
        SELECT load, count(*) FILTER (e.customer_id IS NULL OR e.customer_id <> payer) AS failures
        FROM (SELECT load, product_id, stamp, customer_id + (transaction_id % 37 = 0)::INTEGER AS payer
              FROM transactions, (VALUES (1), (2)) l(load)
              WHERE load = 2 OR stamp = TIMESTAMP '2001-07-31') t
        LEFT JOIN enrollments e
          ON e.product_id = t.product_id AND (load = 2 OR e.stamp = TIMESTAMP '2001-07-31')
        GROUP BY load"""
    ),
    "stream_state": _sql("SELECT * FROM silver_interactions", SILVER),
    "partial_upsert": _sql("SELECT * FROM silver_interactions", SILVER),
    "append_refresh": _sql("SELECT * FROM silver_transactions", SILVER),
    "full_refresh_run": _sql("SELECT * FROM profile", SILVER, GOLD),
    "gate_counts": (
        f"SELECT rule_id, table_name, failures, status FROM ({_rule_summary()}) WHERE severity = 'error' "
        "AND (table_name LIKE 'silver%' OR table_name = 'customer_profile' OR rule_id LIKE 'assert%')"
    ),
    "gate_violations": (
        f"SELECT rule_id, table_name, failures FROM ({_rule_summary()}) WHERE severity = 'error' AND failures > 0 "
        "AND (table_name LIKE 'silver%' OR table_name = 'customer_profile' OR rule_id LIKE 'assert%')"
    ),
    "audit_all_rules": f"SELECT rule_id, table_name, failures FROM ({_rule_summary()}) WHERE failures > 0",
    "merged_percentiles": _sql(
        "SELECT unnest([1, 5, 25, 50, 75, 95, 99])::INTEGER AS percentile, count(*) AS n_values, "
        "count(DISTINCT stamp) AS n_loads, TRUE AS within FROM transactions"
    ),
}

# Decimal result columns per query.
_ACTIVITY = [*_VALUES, "avg_transaction_value", "max_balance", "min_balance", "current_balance"]
_LIMITS = ["max_credit_limit", "total_credit_limit"]
_PROFILE = [*_LIMITS, *_ACTIVITY, "credit_card_activity_to_limit_ratio"]
_TOTALS = ["total_transaction_value", "total_debit_value", "total_credit_value"]
_PAYMENT = ["transaction_amount", "closing_balance"]
DECIMALS: dict[str, list[str]] = {
    "silver_products": _LIMITS,
    "silver_transactions": _ACTIVITY,
    "incremental_transactions": _ACTIVITY,
    "gold_profile": _PROFILE,
    "pipeline_refresh": _PROFILE,
    "pipeline_backfill": _PROFILE,
    "full_refresh_run": _PROFILE,
    "append_refresh": _ACTIVITY,
    "gold_segment_only": _TOTALS[:1],
    "assert_premium": _TOTALS[:1],
    "assert_value_identity": _TOTALS,
    "assert_non_negative": [*_TOTALS, "credit_card_transaction_value", "savings_transaction_value"],
    "profile_limits": ["min_limit", "max_limit", "avg_limit"],
    "profile_amount_stats": ["min_amount", "max_amount", "mean_amount"],
    "profile_amount_percentiles": ["value"],
    "profile_balances": ["min_balance", "max_balance", "avg_balance"],
    "clustered_table": _PAYMENT,
    "clustered_by_two": _PAYMENT,
}


def as_doubles(name: str) -> str:
    """The SQL of a query with its decimals as doubles."""
    if name not in DECIMALS:
        return ORACLES[name]
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in DECIMALS[name])
    return f"SELECT * REPLACE ({casts}) FROM ({ORACLES[name]})"
