"""All registered queries of the invoice and ledger operators."""

from . import candidate_queries, event_queries, fiscal_queries, party_queries, record_queries, scalar_queries  # noqa: F401
from .views import registry  # noqa: F401
