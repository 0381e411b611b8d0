"""Profiling, cleaning, validation, KPIs and chart datasets for Spark tables."""

from tablecare.operators.kpi import Kpi, kpis, scorecard
from tablecare.operators.profile import ProfileResult, profile
from tablecare.operators.validate import compare, roll_up, validate
from tablecare.plans.plan import Plan
from tablecare.plans.propose import propose, to_plan

__all__ = ["Kpi", "Plan", "ProfileResult", "compare", "kpis", "profile", "propose", "roll_up", "scorecard",
           "to_plan", "validate"]
