"""Evidence-grounded analysis of document and bibliographic collections on Spark."""
