"""The queries of this subpackage and, where SQL can say it, the same rows in DuckDB SQL."""

from __future__ import annotations

from . import decontaminate, language, licenses, media, mixing, neardup, negatives, packing, periodic, quality, rollup, sharding, substrings

QUERIES = {
    "op1_media": media.op1_media,
    "op2_licenses": licenses.op2_licenses,
    "op3_mixing": mixing.op3_mixing,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_language": language.op5_language,
    "op6_quality": quality.op6_quality,
    "op7_substrings": substrings.op7_substrings,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_token_counts": rollup.op9_token_counts,
    "op10_sharding": sharding.op10_sharding,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_packing": packing.op12_packing,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLE = {
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
