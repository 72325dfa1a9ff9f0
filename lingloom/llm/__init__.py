"""Operators for building training corpora: scans, deduplication, search, classifiers, tokenization.

Conventions shared by all of them:

* an operator takes a DataFrame and the names of its id and text columns; extra columns never clash,
  because an operator either returns its own columns only or works under ``__ll_`` names;
* a null text counts as an empty one; an empty table gives an empty result of the same schema;
* nothing that grows with the corpus is collected to the driver, and what is broadcast has a stated bound.
"""
