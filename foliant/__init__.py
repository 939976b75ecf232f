"""Book-translation data jobs on Spark: segments, ledger, translation memory, glossary, QA, rendering and logs."""
