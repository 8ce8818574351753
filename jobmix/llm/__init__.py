"""Operators for large-scale training-data pipelines.

One module per operator; :mod:`jobmix.llm.registry` maps the ``opN_<name>``
queries to them.  Nothing outside this folder imports it.
"""
