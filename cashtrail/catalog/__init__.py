"""Every query by its survey id, each with its SQL twin where SQL can express it."""

from . import adjudication, evidence, features, ledger, models, network, scores, sources  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
