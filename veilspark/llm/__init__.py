"""Operators of a training-data pipeline. Nothing outside this folder imports them."""

from importlib import import_module

MODULES = ("exact_dedup", "line_dedup", "histogram_sort", "order_minhash", "simhash", "bpe", "dac_output", "toxicity_mil", "pii_crf", "packing", "crc_resample", "page_template", "whiten")


def registry() -> tuple[dict, dict]:
    """The queries and the SQL of all modules."""
    queries, oracle = {}, {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
