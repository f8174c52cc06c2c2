"""Training-data operators. Nothing outside this subpackage imports it.

Each module holds one operator with a general interface and one thin query
``opN_<name>(spark, sf_dir)``; :mod:`signalmill.llm.registry` lists the queries.
"""
