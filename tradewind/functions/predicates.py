"""The three revenue definitions. They do not reconcile with each other, so plans name the one they use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewind.schemas import CHECKOUT_STATUSES, RECOGNIZED_STATUSES


def recognized(status: str = "status") -> Column:
    """Money counted as revenue: paid and onwards."""
    return F.col(status).isin(*RECOGNIZED_STATUSES)


def not_cancelled(status: str = "status") -> Column:
    """Everything but cancelled; pending and refunded stay in."""
    return F.col(status) != "cancelled"


def sellable(status: str = "status") -> Column:
    """Line-level sales: neither cancelled nor refunded; pending stays in."""
    return ~F.col(status).isin("cancelled", "refunded")


def reached_checkout(status: str = "status") -> Column:
    return F.col(status).isin(*CHECKOUT_STATUSES)
