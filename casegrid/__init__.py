"""casegrid: a Spark-native complaint-document triage engine.

Every stage is a DataFrame transformation: listing and reading files,
normalising text, gating out off-topic or instruction-injecting text,
turning each document into one validated case record, drafting an email
and a summary from that record, and publishing results, a report, counts
and token usage.  Each row carries its own status and error code, so one
bad document never stops a run.
"""

__version__ = "0.1.0"
