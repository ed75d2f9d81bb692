"""Queries and SQL of this subpackage, for the driver's entry module."""
from importlib import import_module

_WHERE = {
    "op1_chat": "chat",
    "op2_lm": "lm",
    "op3_mix": "mixing",
    "op4_neardup": "neardup",
    "op5_quality": "quality",
    "op6_license": "licenses",
    "op7_sharding": "sharding",
    "op8_jaccard": "jaccard",
    "op9_pii": "pii",
    "op10_byte_bpe": "bpe",
    "op11_exactdedup": "exactdedup",
    "op12_repair": "repair",
    "op13_clusters": "clustering",
    # the columns of an operator that SQL can express
    "quality_base": "quality",
    "license_base": "licenses",
    "mix_sizes": "mixing",
}


def queries():
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql():
    out = {}
    for name, module in _WHERE.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLES", {}).get(name)
        if sql:
            out[name] = sql
    return out
