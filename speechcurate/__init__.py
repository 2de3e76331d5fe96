"""PySpark-native curation of speech corpora.

Every operator is a function ``DataFrame -> DataFrame``. ``functions`` holds
column expressions, ``sources`` readers and writers, ``operators`` the
relational and vector operators, ``plans`` the multi-step jobs built from them
and ``catalog`` the queries over the stand-in tables.
"""
