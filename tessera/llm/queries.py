"""The registered queries of this subpackage and the SQL that some can be held against."""

from tessera.llm.conversation_repair import OP12_SQL, op12_conversation_repair
from tessera.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from tessera.llm.importance import OP11_SQL, op11_importance_resampling
from tessera.llm.language_id import op7_language_id
from tessera.llm.license_scan import op1_license_scan
from tessera.llm.lz_fingerprint import op2_lz_fingerprint
from tessera.llm.mixing import op9_mixing
from tessera.llm.near_dedup import op3_near_dedup
from tessera.llm.packing import op5_packing
from tessera.llm.sharding import op6_sharding
from tessera.llm.substring_dedup import op8_substring_dedup
from tessera.llm.suffix_dedup import op4_suffix_dedup
from tessera.llm.toxicity import op13_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_lz_fingerprint,
        op3_near_dedup,
        op4_suffix_dedup,
        op5_packing,
        op6_sharding,
        op7_language_id,
        op8_substring_dedup,
        op9_mixing,
        op10_exact_dedup,
        op11_importance_resampling,
        op12_conversation_repair,
        op13_toxicity,
    )
}

SQL = {"op10_exact_dedup": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op12_conversation_repair": OP12_SQL}
