"""Operators of a training-data pipeline, each with its registered query and, where SQL can say it, its oracle."""

from __future__ import annotations

from . import decontam, lm, mixing, neardup, pii, quality, repeats, sharding, topk, warc

_MODULES = (("op1_shard_hilbert", sharding), ("op2_lm_attention", lm), ("op3_quality_gam", quality), ("op4_pii_bootstrap", pii), ("op5_near_duplicates", neardup), ("op6_warc_sequential", warc), ("op7_mix_hash_threshold", mixing), ("op8_repeated_strings", repeats), ("op9_decontaminate", decontam), ("op10_exact_topk", topk))

QUERIES = {name: getattr(m, name) for name, m in _MODULES}
ORACLES = {name: m.ORACLE for name, m in _MODULES if m.ORACLE}

#: Parts of results that SQL can say where it cannot say the whole: name, query, oracle.
PART_QUERIES = {"pii_base_spans": pii.pii_base_spans}
PART_ORACLES = {"pii_base_spans": pii.BASE_ORACLE}
