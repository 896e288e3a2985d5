"""Thresholds and other fixed values shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass


# Risk and anomaly limits. Operators take others as parameters.
@dataclass(frozen=True)
class Thresholds:
    critical: float = 75.0
    high: float = 50.0
    medium: float = 25.0
    low: float = 0.0
    alert: float = 70.0
    driver_rate: float = 20.0
    order_rate: float = 50.0
    fraud_rate: float = 50.0
    geographic_rank: float = 75.0
    anomaly_std: float = 2.0


THRESHOLDS = Thresholds()

# Labels, band edges, unit costs and lookup tables the results depend on.
RISK_LABELS = ["Low", "Medium", "High", "Critical"]
RISK_EDGES = [-1, 25, 50, 75, 100]
DRIVER_AGE_EDGES = [0, 25, 35, 45, 55, 100]
DRIVER_AGE_LABELS = ["18-25", "26-35", "36-45", "46-55", "55+"]
CUSTOMER_AGE_EDGES = [0, 25, 35, 45, 55, 65, 100]
CUSTOMER_AGE_LABELS = ["18-25", "26-35", "36-45", "46-55", "56-65", "65+"]
EXPERIENCE_EDGES = [-1, 25, 50, 100, None]
EXPERIENCE_LABELS = ["Novice", "Intermediate", "Experienced", "Expert"]
SPEND_EDGES = [-1, 500, 2000, 5000, None]
SPEND_LABELS = ["Low Value", "Medium Value", "High Value", "Premium"]
QUARTILE_SEGMENTS = ["Low Value", "Medium Value", "High Value", "VIP"]
PRICE_EDGES = [-1, 10, 25, 50, 100, None]
PRICE_LABELS = ["Very Low", "Low", "Medium", "High", "Premium"]
PRICE_BAND_EDGES = [None, 10, 25, 50, 100, None]
PRICE_BAND_LABELS = [
    "Budget (<$10)",
    "Core ($10-$25)",
    "Premium ($25-$50)",
    "High Value ($50-$100)",
    "Critical Value ($100+)",
]
ITEM_VALUE_USD = 15.0
DEFAULT_MARGIN = 0.22
MARGIN_BY_CATEGORY = {
    "Bakery": 0.24,
    "Beverages": 0.19,
    "Dairy": 0.18,
    "Electronics": 0.31,
    "Frozen": 0.22,
    "Household": 0.27,
    "Pantry": 0.21,
    "Personal Care": 0.33,
    "Produce": 0.26,
    "Snacks": 0.29,
    "Supermarket": 0.20,
}
REGION_COORDINATES = {
    "Altamonte Springs": (28.6611, -81.3656),
    "Apopka": (28.6934, -81.5322),
    "Clermont": (28.5494, -81.7729),
    "Kissimmee": (28.2919, -81.4076),
    "Orlando": (28.5383, -81.3792),
    "Sanford": (28.8029, -81.2695),
    "Winter Park": (28.6003, -81.3392),
}
DEFAULT_COORDINATES = (28.5383, -81.3792)
SLA_BY_RISK = {"Critical": "4h", "High": "12h", "Medium": "48h", "Low": "72h"}
SLA_BY_PRIORITY = {"Immediate": "4h", "Fast Track": "12h", "Review": "24h", "Monitor": "48h"}
