"""Text operators of a training-data pipeline over the documents, pages, benchmark and labels tables.

One module per operator; `queries.py` registers them, `/corpus_pipeline.py` chains five of them.
Conventions shared by all of them:

* a null text counts as the empty text (no words), unless an operator states otherwise;
* tables keep extra columns untouched where documents pass through, and repeated rows stay repeated;
* Python code runs on Arrow batches inside tasks; Spark reads, shuffles and writes.
"""
