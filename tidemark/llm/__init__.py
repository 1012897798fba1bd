"""Operators of a training-data pipeline, one module per operator.

Nothing outside this package imports it. ``registry`` holds the registered
queries and their SQL. Conventions shared by all operators:

* a NULL text (or html, url) counts as empty unless a docstring says otherwise;
* repeated rows are separate rows and get the same decision;
* an empty table gives an empty result with the same schema;
* operators read only the columns they name, so extra columns (also ones
  that look like internal names, which start with ``_lm_``) do no harm.
"""
