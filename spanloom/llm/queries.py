"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, htmltext, langid, licenses, mixing, neardup, pii, quality, sharding, topk

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_pii": pii.op2_pii,
    "op3_html": htmltext.op3_html,
    "op4_quality_rules": quality.op4_quality_rules,
    "quality_rules_lenient": quality.quality_rules_lenient,
    "op5_license_scan": licenses.op5_license_scan,
    "license_places": licenses.license_places,
    "op6_language": langid.op6_language,
    "op7_mixing": mixing.op7_mixing,
    "op8_topk": topk.op8_topk,
    "op9_sharding": sharding.op9_sharding,
    "op10_jaccard_join": neardup.op10_jaccard_join,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op4_quality_rules": quality.OP4_SQL, "quality_rules_lenient": quality.LENIENT_SQL, "license_places": licenses.PLACES_SQL, "op7_mixing": mixing.OP7_SQL, "op8_topk": topk.OP8_SQL, "op9_sharding": sharding.OP9_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
