"""Text screening on Spark: tables and streams of text in, findings, verdicts,
conversions and metrics out.  Every public function takes and returns
DataFrames (or Columns); nothing is collected to the driver."""

__version__ = "0.1.0"
