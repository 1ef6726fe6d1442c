"""All queries over the driver's tables and their SQL, by name."""

from trialloom.plans import evaluation, knowledge, logs, messages, pages, preference  # noqa: F401
from trialloom.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
