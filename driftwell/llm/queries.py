"""The queries of this subpackage by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

from driftwell.llm import warc
from driftwell.llm.language_id import op1_language_id
from driftwell.llm.licenses import op4_licenses
from driftwell.llm.media import op9_media
from driftwell.llm.mixing import op10_mix
from driftwell.llm.packing import op7_packing
from driftwell.llm.quality_model import op6_quality_model
from driftwell.llm.quality_rules import ORACLE as QUALITY_RULES
from driftwell.llm.quality_rules import op3_quality_rules
from driftwell.llm.simhash import op8_simhash
from driftwell.llm.suffix_dedup import op2_suffix_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_licenses": op4_licenses,
    "op5_warc": warc.op5_warc,
    "op6_quality_model": op6_quality_model,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_media": op9_media,
    "op10_mix": op10_mix,
}
ORACLES: dict[str, str] = {"op3_quality_rules": QUALITY_RULES, "op5_warc": warc.ORACLE}
