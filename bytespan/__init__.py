"""bytespan: byte-offset entity annotations on text corpora, on Spark.

Every operator takes and returns DataFrames (or Columns); the core data
model is described in README.md:

* docs       (doc_id bigint, body binary)
* spans      (doc_id bigint, ord int, start int, len int, type string)
* windows    (doc_id, win, start, n, n_doc, text, spans)
* byte tags  (doc_id, pos, tag) in long form, or array<string> per window
"""

__version__ = "0.1.0"
