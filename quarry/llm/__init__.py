"""Operators for preparing training corpora.

Nothing outside this subpackage (but for the guarded hook in
``__spark_entry__``) imports it.  Every operator takes a DataFrame and returns
a DataFrame; inputs are narrowed to the columns an operator reads, so extra
columns, whatever their names, do no harm.
"""
