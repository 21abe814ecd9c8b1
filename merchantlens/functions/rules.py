"""Fixed business values.

Everything in this module is a plain constant whose value is part of the
expected results; operators take these as defaults and callers may replace them.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from decimal import Decimal

# --- Fixed values: payment statuses -----------------------------------------
SUCCESSFUL = "Successful"
REFUNDED = "Refunded"
FAILED = "Failed"

# --- Fixed values: fee rate by payment method; any other or none gets the last
FEE_RATES: dict[str, Decimal] = {
    "UPI": Decimal("0.000"),
    "Credit Card": Decimal("0.020"),
    "Debit Card": Decimal("0.009"),
    "Net Banking": Decimal("0.015"),
}
OTHER_FEE_RATE = Decimal("0.018")

# --- Fixed values: payment methods --------------------------------------------
PAYMENT_METHODS = ("UPI", "Credit Card", "Debit Card", "Net Banking", "Wallet")


@dataclass(frozen=True)
class Event:
    """A known day that departs from the usual rates."""

    event_date: date
    label: str
    payment_method: str | None = None
    volume_mult: float | None = None
    success_prob: float | None = None
    refund_prob: float | None = None


# --- Fixed values: event calendar --------------------------------------------
EVENTS: tuple[Event, ...] = (
    Event(date(2023, 5, 12), "Gateway outage", volume_mult=0.2),
    Event(date(2024, 2, 8), "Gateway outage", volume_mult=0.2),
    Event(date(2023, 9, 21), "Viral event", volume_mult=3.0),
    Event(date(2024, 7, 15), "Viral event", volume_mult=3.0),
    Event(date(2024, 8, 5), "High failure rate", payment_method="UPI", success_prob=0.60),
    Event(date(2023, 11, 20), "High refund day", refund_prob=0.15),
    Event(date(2024, 1, 5), "High refund day", refund_prob=0.15),
)

# --- Fixed values: usual success and refund probabilities ---------------------
UPI_SUCCESS = 0.95
CARD_SUCCESS = 0.92
OTHER_SUCCESS = 0.90
USUAL_REFUND = 0.03

# --- Fixed values: size bands by mean transactions a day ----------------------
SIZE_BANDS: tuple[tuple[str, float], ...] = (("Enterprise", 50.0), ("Mid-Market", 15.0))
SMALLEST_BAND = "SMB"

# --- Fixed values: model inputs, in training order ----------------------------
LAGS = (1, 7, 14, 30)
ROLLING = (7, 30)

# --- Fixed values: feature names as shown to merchants ------------------------
FEATURE_LABELS: dict[str, str] = {
    "rolling_avg_30d": "Monthly Sales Momentum",
    "rolling_avg_7d": "Weekly Sales Momentum",
    "revenue_lag_7": "Sales from Previous Week",
    "revenue_lag_1": "Sales from Yesterday",
    "revenue_lag_30": "Sales from Last Month",
    "day_of_month": "Payday / Time of Month",
    "day_of_week": "Day of the Week",
    "is_weekend": "Weekend Effect",
    "revenue_lag_14": "Sales from 2 Weeks Ago",
}
TOP_FEATURES = 6

# --- Fixed values: forecasting ------------------------------------------------
HORIZON = 30
HISTORY = 30
GBT_NAME = "GradientBoosting"
GBT_BAND = 0.15
BASELINE_NAME = "Baseline_EWMA"
BASELINE_BAND = 0.20
BASELINE_WEEKDAY = 1.1
BASELINE_WEEKEND = 0.8

# --- Fixed values: alerts -----------------------------------------------------
ALERT_REFUND_RATE = 4.0
VERDICT_REFUND_RATE = 3.0

# --- Fixed values: question intents, first match wins -------------------------
INTENTS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("payment", ("payment", "method")),
    ("refund", ("refund", "drop")),
    ("forecast", ("forecast", "future")),
)
DEFAULT_INTENT = "default"

# --- Fixed values: answer texts; %s marks a computed value --------------------
ANSWER_PAYMENT = (
    "Based on the currently selected data, **%s** is your most popular payment method, "
    "accounting for **%s%%** of all transactions. I recommend ensuring your %s checkout "
    "flow is completely frictionless."
)
ANSWER_REFUND_HIGH = (
    "I noticed your refund rate is currently at **%s%%**, which is higher than the platform "
    "average of 2.5%%. This is negatively impacting your net revenue. The anomaly detection "
    "system flags spikes primarily on weekends."
)
ANSWER_REFUND_HEALTHY = (
    "Your refund rate is healthy at **%s%%**. I don't see any major anomalies causing revenue "
    "drops in this period."
)
ANSWER_FORECAST = (
    "Looking ahead %s days, our Gradient Boosting model expects stable growth driven by strong "
    "monthly momentum. However, expect a slight dip on weekends based on your historical patterns."
)
ANSWER_DEFAULT = (
    "That's a great question about your data. In this specific period, you processed **%s** "
    "payments totaling **₹%s Cr**. Try asking me specifically about payment methods, refunds, "
    "or future forecasts!"
)
ANSWER_NO_DATA = "No data found for the selected filters."
