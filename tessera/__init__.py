"""tessera: Spark-native ledger, refund-file and ingest engine for utility billing data.

Subpackages
-----------
functions  column expressions (padding, amounts, names, dates, codes)
sources    file and table scans (CSV policies, preamble files, XML, archives, listings)
sinks      table and file writers (append/overwrite/create-only, fixed-width payment files)
operators  ledger balances, refund candidates, numbering, record builders, reshaping, status
plans      composite jobs and the mapping of the driver tables onto the ledger schema
streaming  landing-folder ingest with Structured Streaming
"""

__version__ = "0.1.0"
