"""The queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from ferrule.llm import ann, decontam, langid, licenses, lmscore, minhash, mixing, quality, repeats, sharding

QUERIES = {
    "op1_decontaminate": decontam.op1_decontaminate,
    "op2_near_duplicates": minhash.op2_near_duplicates,
    "op3_lm_score": lmscore.op3_lm_score,
    "op4_language": langid.op4_language,
    "op5_shard": sharding.op5_shard,
    "op6_nearest": ann.op6_nearest,
    "op7_repeats": repeats.op7_repeats,
    "op8_licenses": licenses.op8_licenses,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_quality": quality.op10_quality,
}
ORACLE_SQL = {
    "op1_decontaminate": decontam.OP1_SQL,
    "op2_near_duplicates": minhash.OP2_SQL,
    "op5_shard": sharding.OP5_SQL,
    "op6_nearest": ann.OP6_SQL,
    "op7_repeats": repeats.OP7_SQL,
    "op8_licenses": licenses.OP8_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
}
