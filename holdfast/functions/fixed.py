"""These have to equal the published ones for results to agree."""

from __future__ import annotations

# Columns that must never reach a model.
LEAKAGE_COLUMNS = {
    "user_id", "customer_id", "target_churn", "churn_probability",
    "cluster", "rfm_score", "revenue_at_risk", "predicted_ltv",
    "priority_score", "intervention_cost", "RowNumber",
    "rrn", "txn_id", "txn_id_raw", "rrn_raw", "pan", "deductor_tan",
    "tan", "payer_vpa", "payee_vpa", "payer_vpa_raw", "payee_vpa_raw",
    "rfm_raw",
    "first_seen", "last_seen", "last_purchase",
    "_is_summary", "domain",
}

# Synthetic features that only add noise to bank summaries.
BANK_PRUNED_FEATURES = {
    "ipi_median", "ipi_std", "ipi_consistency", "ipi_ratio", "ipi_max",
    "recency_deviation", "recency_x_ipi", "monetary_x_frequency",
    "log_avg_basket_value", "log_monetary_velocity",
    "frequency_velocity", "monetary_per_txn",
}

RESERVED_COLUMNS = ["segment", "cluster", "r_score", "f_score", "m_score", "rfm_score", "rfm_raw"]

SUMMARY_AS_OF = "2024-05-10"
MIN_USERS_KEPT = 100

# Column names that give a domain away; two hits decide, tried in this order.
DOMAIN_SIGNATURES = {
    "upi": [
        "txnid", "txn_id", "sendervpa", "sender_vpa", "receivervpa", "receiver_vpa",
        "rrn", "upiid", "upi_id", "vpa", "responsecode", "response_code",
        "payername", "payer_name", "payeename", "payee_name", "senderupiid",
        "payervpa", "payer_vpa", "payeevpa", "payee_vpa", "payeruserid",
        "payer_user_id", "mcc", "failurereason", "failure_reason",
    ],
    "tax": [
        "pan", "fy", "incomehead", "income_head", "tdsamountinr", "tds_amount_inr",
        "deductortan", "deductor_tan", "section", "grossamount", "gross_amount",
        "dateofcredit", "date_of_credit", "taxableincome", "taxable_income",
        "grossamountinr", "gross_amount_inr", "deductorname", "deductor_name",
    ],
    "bank_churn": [
        "exited", "creditscore", "credit_score", "estimatedsalary", "estimated_salary",
        "numofproducts", "num_of_products", "hascrcard", "has_cr_card",
        "isactivemember", "is_active_member", "tenure", "balance", "churnflag",
        "churn_flag", "churn", "churned", "attrition",
    ],
    "retail": [
        "invoice", "invoiceno", "invoice_no", "stockcode", "stock_code",
        "invoicedate", "invoice_date", "customerid", "customer_id",
        "unitprice", "unit_price", "quantity",
    ],
}

# Canonical field -> raw names accepted for it, per domain.
UPI_MAPPING = {
    "user_id": ["payer_user_id", "user_id", "sender_vpa", "vpa", "upi_id", "customer_id", "payer_vpa"],
    "timestamp": ["ts", "txn_date", "timestamp", "txn_time", "date", "created_at", "time_stamp"],
    "amount": ["amount_inr", "amount", "txn_amount", "transaction_amount", "value"],
    "description": ["payee_name", "receiver_name", "merchant", "description", "txn_type", "remarks"],
    "status": ["status", "response_code", "result", "txn_status", "transaction_status"],
}
TAX_MAPPING = {
    "user_id": ["user_id", "pan", "tan", "customer_id"],
    "timestamp": ["date_of_credit", "date_of_payment", "timestamp", "date", "credit_date", "payment_date"],
    "amount": ["gross_amount_inr", "gross_amount", "amount", "income", "taxable_income"],
    "description": ["deductor_name", "income_head", "description", "section"],
}
BANK_CHURN_MAPPING = {
    "user_id": ["customerid", "customer_id", "user_id", "id"],
    "target_churn": ["exited", "churn", "churned", "churn_flag", "is_churn", "attrition"],
    "credit_score": ["creditscore", "credit_score"],
    "estimated_salary": ["estimatedsalary", "estimated_salary"],
    "is_active": ["isactivemember", "is_active_member"],
    "has_cr_card": ["hascrcard", "has_cr_card"],
    "age": ["age"],
    "geography": ["geography"],
    "gender": ["gender"],
    "tenure_months": ["tenure", "tenure_months"],
    "frequency": ["numofproducts", "num_of_products", "products", "total_transactions"],
    "monetary": ["balance", "monetary", "amount"],
}
RETAIL_MAPPING = {
    "user_id": ["userid", "customerid", "clientid", "customer_id"],
    "timestamp": ["InvoiceDate", "Date", "timestamp", "time", "Order Date", "date", "Invoice Date"],
    "amount": ["Price", "Total", "Amount", "revenue", "sum", "amount", "Total Price", "TotalPrice"],
    "unit_price": ["Price", "UnitPrice", "Unit Price", "price", "unit_price", "rate"],
    "quantity": ["Quantity", "Qty", "quantity", "count", "units"],
    "description": ["Description", "description", "Product", "product", "ProductDescription"],
}
GENERIC_MAPPING = {
    "user_id": [
        "userid", "customerid", "clientid", "id", "user", "uid", "account_number", "member_id",
        "customer_id", "payer_user_id", "UID", "Account", "VPA", "UPI ID", "PAN", "Payer Name",
        "Payer", "PayerUser_ID", "sender_vpa", "upi_id",
    ],
    "timestamp": [
        "InvoiceDate", "Date", "timestamp", "time", "Order Date", "date", "Invoice Date",
        "date_of_credit", "ts", "txn_date", "CreatedAt", "Date of Payment", "Payment Date",
        "Transaction Date", "CreditDate", "date_of_payment", "txn_time", "time_stamp",
    ],
    "amount": [
        "Price", "Total", "Amount", "revenue", "sum", "amount", "Total Price", "TotalPrice",
        "gross_amount_inr", "amount_inr", "TransactionAmount", "Transaction Amount", "TDS Amount",
        "Credit", "Debit", "payment_amount", "net_amount", "gross_amount", "txn_amount",
        "transaction_amount", "deposit", "withdrawal", "value",
    ],
    "monetary": [
        "balance", "amount", "total_spend", "revenue", "monetary", "value", "transaction_value",
        "spend", "wallet_balance", "gross_amount_inr", "amount_inr", "net_worth", "wallet", "funds",
        "capital", "current_balance",
    ],
    "unit_price": ["Price", "UnitPrice", "Unit Price", "price", "unit_price", "rate"],
    "quantity": ["Quantity", "Qty", "quantity", "count", "units"],
    "frequency": [
        "frequency", "orders", "numofproducts", "products_number", "transaction_count",
        "purchase_count", "order_count", "txn_count", "NumOfProducts",
    ],
    "tenure_months": [
        "tenure", "account_age", "membership_duration", "months_active", "customer_since", "Tenure",
    ],
    "target_churn": [
        "exited", "churn", "churned", "is_churn", "left", "attrition", "churn_flag",
        "target_churn", "Exited", "is_churned",
    ],
    "is_active": [
        "isactivemember", "active", "is_active", "active_member", "engagement_flag", "IsActiveMember",
    ],
    "credit_score": [
        "creditscore", "credit_rating", "score", "credit_worthiness", "CreditScore", "cibil_score",
    ],
    "monetary_velocity": [
        "estimated_salary", "income", "daily_spend", "velocity", "EstimatedSalary", "annual_income",
    ],
    "description": [
        "Description", "description", "Product", "product", "ProductDescription", "payee_name",
        "merchant", "receiver_name", "txn_type", "remarks",
    ],
}
MAPPINGS = {
    "upi": UPI_MAPPING,
    "tax": TAX_MAPPING,
    "bank_churn": BANK_CHURN_MAPPING,
    "retail": RETAIL_MAPPING,
    "generic": GENERIC_MAPPING,
}
CORE_FIELDS = ["user_id", "timestamp", "amount"]
NUMERIC_TARGETS = [
    "monetary", "unit_price", "quantity", "frequency", "tenure_months", "is_active",
    "credit_score", "monetary_velocity", "estimated_salary",
]
DESCRIPTION_NAMES = [
    "Description", "description", "Product", "product", "ProductDescription", "payee_name",
    "merchant", "receiver_name",
]
LATEST_DATE_NAMES = [
    "latest_transaction_date", "latest_transaction", "last_transaction_date", "transaction_date",
]
CHURNED_WORDS = ["yes", "true", "1", "exited", "churned", "churn", "left", "attrition", "1.0"]
BLANK_USER_IDS = ["0", "nan", "None", "null"]
FAILURE_WORDS = ["FAILURE", "FAILED", "ERR", "0"]

# Readable names of model features.
DRIVER_LABELS = {
    "gross_amount": "Gross Income Flow",
    "tds_amount": "Tax Deductions (TDS)",
    "income_head": "Income Source Diversity",
    "recency_deviation": "Order Delay (vs Typical)",
    "monetary_velocity": "Daily Income Velocity",
    "account_age": "Customer Tenure (Days)",
    "ipi_median": "Purchase Cycle (Days)",
    "ipi_std": "Purchase Timing Volatility",
    "ipi_consistency": "Behavioral Consistency (Habit Strength)",
    "recency": "Recency (Days Since Last Order)",
    "frequency": "Purchase Frequency (Order Count)",
    "monetary": "Spending Engagement (Wallet Share)",
    "avg_basket_value": "Average Order Value (AOV)",
    "credit": "Credit Rating",
    "balance": "Account Balance",
    "products": "Product Diversity",
    "active": "Account Activity Status",
    "fail": "Transaction Failure Rate",
    "salary": "Estimated Income",
    "age": "Customer Age",
    "is_failure": "Transaction Failure Rate",
    "response_code": "Network Error Sensitivity",
    "mcc": "Merchant Category Exposure",
    "status": "Payment Success Rate",
    "fy": "Fiscal Year Continuity",
    "pan": "PAN Verification Status",
}
DOMAIN_DRIVER_LABELS = {
    "upi": {
        "monetary_velocity": "Daily Transaction Volume",
        "frequency": "UPI Transaction Count",
        "monetary": "Total Spent via UPI",
        "recency": "Days Since Last Payment",
        "description": "Frequent Payees",
        "avg_basket_value": "Avg Transaction Size",
        "ipi_median": "Payment Interval (Days)",
        "ipi_std": "Payment Timing Volatility",
        "ipi_consistency": "Payment Habit Strength",
        "frequency_trend": "Transaction Frequency Trend",
        "monetary_trend": "Spending Volume Trend",
        "failure_rate": "UPI Failure Rate",
        "recency_deviation": "Payment Delay vs Normal",
    },
    "tax": {
        "monetary_velocity": "Daily Income Run-rate",
        "monetary": "Total Taxable Income",
        "frequency": "Filing/Credit Frequency",
        "recency": "Days Since Last Credit",
        "avg_basket_value": "Avg TDS Per Entry",
        "account_age": "Tax Relationship Duration",
        "ipi_median": "Filing Interval (Days)",
        "ipi_std": "Filing Timing Volatility",
        "ipi_consistency": "Filing Regularity Score",
        "frequency_trend": "Filing Frequency Trend",
        "monetary_trend": "Income Volume Trend",
        "tds_rate": "Effective TDS Rate",
        "income_diversity": "Income Source Diversity",
        "section_count": "TDS Section Coverage",
        "quarters_active": "Active Quarters",
        "recency_deviation": "Filing Delay vs Normal",
    },
}

# Drivers shown when no model can be trained.
FALLBACK_DRIVERS = [
    ("Recency", "recency", 0.5, "positive", "High"),
    ("Frequency", "frequency", 0.3, "negative", "Medium"),
    ("Monetary", "monetary", 0.2, "negative", "Low"),
]

# Names a what-if request may use for a feature.
FEATURE_ALIASES = {
    "recency": "recency",
    "order_delay": "recency",
    "days_since_last_purchase": "recency",
    "frequency": "frequency",
    "purchase_frequency": "frequency",
    "order_count": "frequency",
    "monetary": "monetary",
    "spending": "monetary",
    "wallet_share": "monetary",
    "amount": "monetary",
    "failure_rate": "failure_rate",
    "technical_failures": "failure_rate",
    "tds_rate": "tds_rate",
    "tax_burden": "tds_rate",
    "section_count": "section_count",
    "tax_diversity": "section_count",
    # ours: the bank presets name these two
    "balance": "monetary",
    "num_of_products": "frequency",
}

# name, feature, change in %, cost per user
CAMPAIGNS = [
    ("cashback", "monetary", 20.0, 200.0),
    ("push", "frequency", 15.0, 50.0),
    ("discount", "monetary", 25.0, 150.0),
    ("loyalty", "frequency", 30.0, 100.0),
    ("email", "recency", -30.0, 500.0),
]
# name, segment, feature, change in %, cost per user
PRESETS = {
    "upi": [
        ("strat_upi_failure", "Needs Attention", "failure_rate", -50.0, 25.0),
        ("strat_upi_fading", "At Risk", "monetary", 20.0, 100.0),
        ("strat_upi_champions", "Champions", "frequency", 25.0, 40.0),
    ],
    "bank_churn": [
        ("strat_bank_crosssell", "At Risk", "num_of_products", 30.0, 80.0),
        ("strat_bank_balance", "At Risk", "balance", 20.0, 120.0),
        ("strat_bank_champions", "Champions", "balance", 25.0, 300.0),
    ],
    "tax": [
        ("strat_tax_bundle", "Needs Attention", "section_count", 40.0, 150.0),
        ("strat_tax_reminders", "At Risk", "recency", -25.0, 30.0),
    ],
    "retail": [
        ("strat_retail_winback", "At Risk", "monetary", 20.0, 150.0),
        ("strat_retail_reengage", "Hibernating", "frequency", 15.0, 45.0),
    ],
}

PERSONAS = {
    "Champions": "The Loyal Giant",
    "Loyalists": "The Steady Pillar",
    "Promising": "The Rising Star",
    "At Risk": "The Fading Star",
    "Hibernating": "The Lost Soul",
    "Needs Attention": "The Drifting User",
    "New": "Onboarding",
}

SEGMENT_PROBLEMS = {
    "Champions": "Stable (%s%%) — protect & grow",
    "Loyalists": "Stable (%s%%) but growth opportunity",
    "Promising": "Rising (%s%%) — needs nurture",
    "At Risk": "High churn risk (%s%%) — urgent",
    "Hibernating": "Dormant (%s%%) — re-engage needed",
    "Needs Attention": "Irregular (%s%%) — friction present",
    "New": "Early (%s%%) — onboarding phase",
}
SEGMENT_ACTIONS = {
    "Champions": "VIP concierge + exclusive reward tier",
    "Loyalists": "Loyalty tier upgrade + cross-sell premium products",
    "Promising": "Onboarding nudge + early loyalty reward",
    "At Risk": "Urgent win-back offer + personalised outreach",
    "Hibernating": "High-value re-engagement incentive campaign",
    "Needs Attention": "Friction audit + targeted UX improvement",
    "New": "Second-purchase incentive + guided onboarding",
}

# Candidate thresholds always tried besides the scores themselves.
THRESHOLD_GRID = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]

DRIFT_REASONS = {
    "HIGH DRIFT": "%d of %d columns (%s%%) differ between the two periods. Scores trained on the old period are in doubt.",
    "LOW DRIFT": "%d of %d columns (%s%%) differ a little between the two periods. Scores can still be used.",
    "STABLE": "%d of %d columns (%s%%) differ between the two periods. Old and new rows look alike.",
}
DRIFT_ACTIONS = {
    "HIGH DRIFT": [
        "Train again on recent rows.",
        "Ask what changed outside the product, such as prices, seasons or rivals.",
        "Start with the columns that moved most.",
        "Plan shorter gaps between trainings.",
    ],
    "LOW DRIFT": [
        "Put the next training on the calendar of this month.",
        "Look at the moved columns again with the next data.",
    ],
    "STABLE": ["Keep the model and check again with the next data."],
}

# Event type -> churn change, the middle of the published ranges.
EVENT_RISK_WEIGHTS = {
    "transaction": -0.0125,
    "transaction_fail": 0.03,
    "plan_downgrade": 0.055,
}

# Wording of the hypotheses: title, hypothesis, test, statistic, impact. {f} driver name, {fl} the
# same in lower case, {a} current level, {b} target or retained level, {lift} expected lift.
IDENTIFIER_PARTS = ["pan", "tan", "id", "ts", "cluster", "rank", "score", "month", "year"]
CURRENCY_PARTS = ["monetary", "velocity", "amount", "spend", "value", "balance"]
HYPOTHESIS_TEXT = {
    ("recency", "tax"): (
        "Shorter waits: {f}",
        "Filers who leave show {a} days of {fl}. Bringing it under {b} days should win back about {lift}% of them.",
        "Split test: collect documents by a reminder on day {b} for one half.",
        "Goal: {b} days (a fifth less)",
        "Critical",
    ),
    ("recency", "upi"): (
        "Sooner return: {f}",
        "Payers who leave show {a} days of {fl}. A return before day {b} should lower churn by about {lift}%.",
        "Split test: offer a small reward on day {b} to one half.",
        "Goal: {b} days (a fifth less)",
        "Critical",
    ),
    ("recency", ""): (
        "Sooner return: {f}",
        "Customers who leave show {a} days of {fl}. A return before day {b} should lower churn by about {lift}%.",
        "Split test: send a message on day {b} to one half.",
        "Goal: {b} days (a fifth less)",
        "Critical",
    ),
    ("frequency", "tax"): (
        "More filings: {f}",
        "Filers with {b} of {fl} rarely leave. Easier filing up to that point should keep about {lift}% more.",
        "Split test: serve filers near {b} of {fl} first in one half.",
        "Goal: {b} (a quarter more)",
        "High",
    ),
    ("frequency", "upi"): (
        "More payments: {f}",
        "Payers with {b} of {fl} rarely leave. Rewarding that count should keep about {lift}% more.",
        "Split test: promise a reward at {b} of {fl} to one half.",
        "Goal: {b} (a quarter more)",
        "High",
    ),
    ("frequency", ""): (
        "More orders: {f}",
        "Customers with {b} of {fl} rarely leave. Rewarding that count should keep about {lift}% more.",
        "Split test: show a progress bar towards {b} of {fl} to one half.",
        "Goal: {b} (a quarter more)",
        "High",
    ),
    ("monetary", "tax"): (
        "Deeper relation: {f}",
        "{f} is {a} among filers who leave, against a goal of {b}. Advice for them should keep about {lift}% more.",
        "Split test: call half of the filers near {a} with an offer of advice.",
        "Goal: {b}",
        "Medium",
    ),
    ("monetary", ""): (
        "Deeper relation: {f}",
        "Raising {fl} from {a} to {b} should keep about {lift}% more of the accounts at risk.",
        "Split test: offer a second product to half of the customers near {a}.",
        "Goal: {b}",
        "Medium",
    ),
}
# Feature part -> title, hypothesis, test; {a} churn-side mean, {b} retained mean, ints as {ai} {bi}.
GAP_TEXT = {
    "section_count": (
        "More sections",
        "Filers who leave use {a:.1f} sections, those who stay {b:.1f}. Service for {bi} sections or more should lower churn by {lift}%.",
        "Split test: propose one more section to one half.",
    ),
    "tds_rate": (
        "Deductions in order",
        "The mean deduction is {a:.2f}% among those who leave and {b:.2f}% among those who stay. Help with matching it should lower churn by {lift}%.",
        "Split test: warn one half about deductions that do not match.",
    ),
    "income_diversity": (
        "More kinds of income",
        "Those who leave report {a:.1f} kinds of income, those who stay {b:.1f}. Help with several kinds should lower churn by {lift}%.",
        "Split test: open the tools for several incomes to one half.",
    ),
    "age": (
        "Age groups",
        "Those who stay are {bi} years old on average, those who leave {ai}. A design for each group should keep {lift}% more.",
        "Split test: show one half the design of its age group.",
    ),
    "credit": (
        "Credit standing",
        "A credit score near {bi} goes with staying, one near {ai} with leaving. Help with raising it should keep {lift}% more.",
        "Split test: offer one half a plan to raise the score.",
    ),
    "salary": (
        "Means to pay",
        "Customers with less income leave more often. Payment in parts should keep {lift}% more.",
        "Split test: let one half pay in parts.",
    ),
    "income": (
        "Means to pay",
        "Customers with less income leave more often. Payment in parts should keep {lift}% more.",
        "Split test: let one half pay in parts.",
    ),
    "": (
        "Close the gap: {f}",
        "{f} is {b:.1f} among those who stay and {a:.1f} among those who leave. Closing the gap should keep {lift}% more.",
        "Split test: address one half by its {f}.",
    ),
}
ONE_SIDED_HYPOTHESIS = (
    "Ask the quiet quarter",
    "The mean churn risk is {churn:.1f}%. Contacting the least active quarter should keep more customers.",
    "Split test: write to half of that quarter.",
    "Engagement",
    "Mean churn: {churn:.1f}%",
    "Medium",
)
DEFAULT_HYPOTHESIS = (
    "Ask the quiet ones",
    "Contact that follows past activity should keep five to ten percent more customers.",
    "Split test: a series of messages to one half.",
    "Behavioral",
    "Importance above 0.15",
    "Medium",
    7.5,
)

# Wording of the what-if answer.
FEATURE_DISPLAY = {
    "recency": "Recency (Days Since Last Purchase)",
    "frequency": "Purchase Frequency (Order Count)",
    "monetary": "Spending Engagement (Wallet Share)",
    "failure_rate": "Transaction Failure Rate (%)",
    "tds_rate": "TDS Compliance Rate",
    "section_count": "Tax Section Diversity",
}
MODEL_LIMITATION_NOTE = (
    "The scores do not fall under this change. The model may hardly look at the column, or the step may be too "
    "small to cross a split of its trees."
)
ROI_GOOD = "Worth doing: keeping %s%% of the segment brings ₹%s of lifetime value for ₹%s of cost."
ROI_BAD = "Not worth doing: it costs ₹%s and brings ₹%s of lifetime value. Lower the cost or choose customers of higher value."
