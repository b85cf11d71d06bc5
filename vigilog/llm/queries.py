"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from vigilog.llm import (
    audit,
    chat,
    decontaminate,
    infill,
    jaccard,
    language,
    lines,
    mixing,
    secrets,
    tokens,
    urls,
    vectors,
    warc,
)

_MODULES = {
    "op1_jaccard_join": jaccard,
    "op2_url_filter": urls,
    "op3_mixing": mixing,
    "op4_token_files": tokens,
    "op5_vector_dedup": vectors,
    "op6_language": language,
    "op7_line_dedup": lines,
    "op8_decontaminate": decontaminate,
    "op9_secrets": secrets,
    "op10_warc": warc,
    "op11_filter_audit": audit,
    "op12_fill_middle": infill,
    "op13_chat_format": chat,
}
QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLES = {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
