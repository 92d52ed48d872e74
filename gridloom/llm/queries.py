"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op10_html, op1_langid, op2_warc, op3_superminhash, op4_dac, op5_exact, op6_mixing, op7_packing, op8_quality, op9_chaining

QUERIES = {
    "op1_error_correcting_codes": op1_langid.op1_error_correcting_codes,
    "op2_sharded_warc": op2_warc.op2_sharded_warc,
    "op3_superminhash": op3_superminhash.op3_superminhash,
    "op4_addressable_codes": op4_dac.op4_addressable_codes,
    "op5_tree_merge_dedup": op5_exact.op5_tree_merge_dedup,
    "op6_temperature_mixing": op6_mixing.op6_temperature_mixing,
    "op7_multi_length_packing": op7_packing.op7_multi_length_packing,
    "op8_decision_lists": op8_quality.op8_decision_lists,
    "op9_collinear_chaining": op9_chaining.op9_collinear_chaining,
    "op10_host_suffix_array": op10_html.op10_host_suffix_array,
}

ORACLES = {
    "op2_sharded_warc": op2_warc.ORACLE,
    "op5_tree_merge_dedup": op5_exact.ORACLE,
}
