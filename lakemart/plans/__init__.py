"""Declared models and the report queries on them."""

from lakemart.plans.health import HEALTH
from lakemart.plans.model import Column, Model, summarize, view
from lakemart.plans.report import cross_filter, sum_by_category

__all__ = ["HEALTH", "Column", "Model", "cross_filter", "sum_by_category", "summarize", "view"]
