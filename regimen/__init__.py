"""Training-plan analytics as Spark jobs.

A plan (owner -> routine -> day -> session -> exercise -> set) and the log of
performed workouts are tables; every question or change is a DataFrame job
over all owners at once.
"""

from regimen.session import get_spark, checkpoint_dir
from regimen.sources.tables import Model

__all__ = ["get_spark", "checkpoint_dir", "Model"]
