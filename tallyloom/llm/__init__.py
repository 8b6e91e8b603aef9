"""Operators that prepare training corpora. Nothing outside this subpackage imports it.

Every operator takes DataFrames and returns a DataFrame.  Conventions that hold for all of them:

* a null text counts as an empty one, unless an operator's docstring says otherwise;
* columns the operator does not know are ignored or carried, and are never looked up by name;
* rows that repeat (the same ``doc_id`` twice) are scored row by row, unless stated otherwise;
* an empty table gives an empty result with the same schema.
"""
