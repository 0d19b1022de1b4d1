"""Fixed parameters of the registered queries (shared by Spark and SQL)."""

from __future__ import annotations

from ordergate.operators.dashboard import Filters
from ordergate.operators.explorer import Query
from ordergate.sources.testdata import TESTDATA_TODAY

# The cut-off dates and the parameters each registered query uses.
HOY = TESTDATA_TODAY                # cut-off of the current run
HOY_ANTERIOR = "2000-06-30"         # cut-off of the previous run (refresh delta)
KPI_DESDE, KPI_HASTA = "2000-01-01", "2000-12-31"
EXPLORE_DESDE, EXPLORE_HASTA = "2000-01-01", "2000-01-31"
EXPLORE_REP = "Supplier#000000003"
EXPLORE_SEARCH = "  CUSTOMER#000000012 "
EXPLORE_TOTALS_SEARCH = "brand#1"
LOOKUP_ID = "p5979-6"
SYNC_ID = "00000000-0000-4000-8000-000000000001"
DASH_FILTERS = Filters(tipo_cliente="BUILDING")
NO_FILTERS = Filters()
DASH_ORDERS_REP = "Supplier#000000003"
DASH_ORDERS_FAMILY = "SMALL"

DASH_ALL_FILTERS = Filters(comercial="Supplier#000000012", zona="NATION_16", tipo_cliente="MACHINERY",
                           familia="MEDIUM", desde="1995-01-01", hasta="2000-12-31")
DASH_NO_MATCH = Filters(zona="no such zone")
DASH_ORDERS_ALL = Query(limite=7, offset=3, comercial="Supplier#000000012", zona="NATION_16",
                        tipo_cliente="MACHINERY", familia="MEDIUM", desde="1995-01-01", hasta="2000-12-31", orden="registro")
DEEP_LIMIT, DEEP_OFFSET = 40, 2990
INDEX_FILES = 16                    # the least number of files of an indexed table, so that small data has some to leave out


def as_text(value) -> str | None:
    return None if value in (None, "") else str(value)[:10]
