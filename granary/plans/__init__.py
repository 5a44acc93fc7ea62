"""The registered queries, bound to the test tables. Importing this registers them all."""

from . import blocks, fusion, geometry, integrity, layout, ledger, ranking, records, store, text  # noqa: F401
