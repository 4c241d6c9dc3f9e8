"""Flagship plan: the general-ledger battery over the audit view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import rules as R
from ..operators.registry import evaluate_all
from . import views

#: Rules with parameters that suit the view's amounts and densities.
def gl_rules() -> list[R.Rule]:
    return [R.UnbalancedEntry(), R.PeriodEnd(1), R.WeekendHoliday(), R.RoundAmount(1_000_000, 100_000), R.BelowThreshold(65_000, 15), R.Description(10), R.DormantAccount(365), R.RarePairing(120, 500), R.Approval(), R.Duplicate(365), R.NearDuplicate(30, 0.02, 0.6)]


def battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All general-ledger flags. Eleven rules read the view, so its flat rows are kept (in
    memory, then on disk; a lost executor's part is computed again)."""
    return evaluate_all(views.gl(spark, sf_dir, keep=True), gl_rules())[0]
